"""Benchmark decontamination by Wu-Manber multi-pattern search over words.

A test item is cut into windows of ``window`` words; an item of fewer words is one window.  The
search runs over the words of a document.  A table of shifts says for the block of the last two
words under the window how far it can move without missing a match; where the shift is 0, the
block's bucket gives the test strings that end so, and comparing words confirms an occurrence.
Windows of another length have tables of their own.

The tables of the benchmark go to every task only up to ``most_bytes`` of test text; a larger
benchmark is searched in slices of that size, whose findings meet by document.
"""

from __future__ import annotations

import hashlib
from functools import lru_cache

import numpy as np
from pyspark.sql import DataFrame, functions as F

from ..session import materialize
from .common import id_and_text, map_arrow, map_batches, row_bytes

#: Lower-cases A-Z and makes a space of each byte that belongs to no word.
WORD_BYTES = bytes(b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else 32 for b in range(256))


def words(text: bytes) -> list[bytes]:
    return text.translate(WORD_BYTES).split()


class WuManber:
    """Windows of one length; ``patterns`` maps each to the items that hold it."""

    def __init__(self, patterns: dict[tuple[bytes, ...], list[int]]) -> None:
        self.length = len(next(iter(patterns)))
        self.block = min(2, self.length)
        self.far = self.length - self.block + 1
        self.shift: dict = {}
        self.bucket: dict = {}
        for pattern, items in patterns.items():
            for end in range(self.block, self.length + 1):
                key = pattern[end - self.block:end] if self.block == 2 else pattern[end - 1]
                self.shift[key] = min(self.shift.get(key, self.far), self.length - end)
            self.bucket.setdefault(key, {})[pattern] = items

    def search(self, text: list[bytes]):
        """Pairs of the first word's place and the items, in order."""
        n, m, far, shift = len(text), self.length, self.far, self.shift.get
        at = m - 1
        if self.block == 1:
            for i, word in enumerate(text):
                if word in self.bucket:
                    yield i, self.bucket[word][(word,)]
            return
        while at < n:
            key = (text[at - 1], text[at])
            step = shift(key, far)
            if step:
                at += step
                continue
            start = at - m + 1
            items = self.bucket[key].get(tuple(text[start:at + 1]))
            if items is not None:
                yield start, items
            at += 1


class Search:
    """All windows of some items."""

    def __init__(self, items: tuple[tuple[str, bytes], ...], window: int) -> None:
        by_length: dict[int, dict] = {}
        for name, text in items:
            w = words(text)
            if not w:
                continue
            m = min(window, len(w))
            for i in range(len(w) - m + 1):
                owners = by_length.setdefault(m, {}).setdefault(tuple(w[i:i + m]), [])
                if name not in owners:
                    owners.append(name)
        self.parts = [WuManber(p) for _, p in sorted(by_length.items())]

    def find(self, text: list[bytes]) -> tuple[np.ndarray, set[str]]:
        """Which words are hit, and the items found."""
        found, starts, lengths = set(), [], []
        for part in self.parts:
            for start, items in part.search(text):
                starts.append(start)
                lengths.append(part.length)
                found.update(items)
        change = np.zeros(len(text) + 1, dtype=np.int64)
        np.add.at(change, np.array(starts, dtype=np.int64), 1)
        np.add.at(change, np.array(starts, dtype=np.int64) + np.array(lengths, dtype=np.int64), -1)
        return np.cumsum(change[:-1]) > 0, found


@lru_cache(maxsize=2)
def _search(items: tuple, window: int) -> Search:
    return Search(items, window)


def runs(flags: np.ndarray) -> list[int]:
    """Starts and ends of the runs of True, in turn."""
    return np.flatnonzero(np.diff(np.concatenate([[0], flags.view(np.int8), [0]]))).tolist()


def _found(columns: dict, shared, window: int) -> dict:
    search = _search(shared.value, window)
    out: dict[str, list] = {"doc_id": columns["doc_id"], "n_words": [], "spans": [], "items": []}
    for text in row_bytes(columns["text"]):
        w = words(text)
        hit, items = search.find(w)
        out["n_words"].append(len(w))
        out["spans"].append(runs(hit) if items else [])
        out["items"].append(sorted(items))
    if "row_no" in columns:
        out["row_no"] = columns["row_no"]
    return out


def _summary(columns: dict) -> dict:
    n_hit = [sum(s[1::2]) - sum(s[::2]) for s in columns["spans"].to_pylist()]
    items = columns["items"].to_pylist()
    return {"doc_id": columns["doc_id"], "n_words": columns["n_words"], "n_hit": n_hit, "n_items": list(map(len, items)),
            "items_sha256": [hashlib.sha256(",".join(i).encode()).hexdigest() for i in items],
            "contaminated": [n > 0 for n in n_hit], "items": items, "spans": columns["spans"]}


def _merged(columns: dict) -> dict:
    spans = []
    for parts in columns["parts"].to_pylist():
        flat = [p for s in parts for p in zip(s[::2], s[1::2])]
        merged: list[int] = []
        for a, b in sorted(flat):
            if merged and a <= merged[-1]:
                merged[-1] = max(merged[-1], b)
            else:
                merged += [a, b]
        spans.append(merged)
    return {"doc_id": columns["doc_id"], "n_words": columns["n_words"], "spans": spans, "items": columns["items"]}


def slices(benchmark: DataFrame, most_bytes: int) -> list[DataFrame]:
    """The benchmark in parts of about ``most_bytes`` of text."""
    size = benchmark.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    n = max(1, -(-size // most_bytes))
    return [benchmark.filter(F.pmod(F.xxhash64("text", "item_id"), F.lit(n)) == k) if n > 1 else benchmark for k in range(n)]


def find_windows(docs: DataFrame, benchmark: DataFrame, window: int = 10, most_bytes: int = 16 << 20,
                 doc_id: str = "doc_id", text: str = "text", item_id: str = "item_id", item_text: str = "text") -> DataFrame:
    """What of each document occurs in the benchmark.

    ``doc_id, n_words, n_hit, n_items, items_sha256, contaminated, items`` (sorted as strings) and
    ``spans`` (starts and ends of the runs of hit words, in turn), one row for each row.  A null or
    empty text has no words and is clean; null and repeated ids are kept; items without words or id
    take no part, repeated items count once; an empty benchmark hits nothing.  Other columns are not
    looked at.  With one slice no row is shuffled.
    """
    spark = docs.sparkSession
    texts = id_and_text(docs, doc_id, text)
    items = (benchmark.select(F.col(item_id).cast("string").alias("item_id"), F.col(item_text).cast("string").alias("text"))
             .dropna().distinct())
    parts = slices(items, most_bytes)
    schema = "doc_id long, n_words long, spans array<long>, items array<string>"

    def searched(part: DataFrame, rows: DataFrame, fields: str) -> DataFrame:
        shared = spark.sparkContext.broadcast(tuple(sorted((r.item_id, r.text.encode()) for r in part.collect())))
        return map_batches(rows, fields, _found, shared, window)

    if len(parts) == 1:
        found = searched(parts[0], texts, schema)
    else:  # rows get a number, kept in a table, by which the slices meet
        texts = materialize(texts.withColumn("row_no", F.monotonically_increasing_id()), "decontaminate")
        rows = [searched(p, texts, schema + ", row_no long").filter((F.size("items") > 0) | F.lit(k == 0)) for k, p in enumerate(parts)]
        union = rows[0]
        for r in rows[1:]:
            union = union.unionByName(r)
        found = union.groupBy("row_no").agg(
            F.first("doc_id").alias("doc_id"), F.first("n_words").alias("n_words"), F.collect_list("spans").alias("parts"),
            F.array_sort(F.array_distinct(F.flatten(F.collect_list("items")))).alias("items")).drop("row_no")
        found = map_batches(found, schema, _merged)
    return map_batches(found, "doc_id long, n_words long, n_hit long, n_items long, items_sha256 string, "
                       "contaminated boolean, items array<string>, spans array<long>", _summary)


def _is_clean(batches, shared, window: int, text: str, most: float):
    search = _search(shared.value, window)
    for batch in batches:
        keep = []
        for t in row_bytes(batch.column(batch.schema.get_field_index(text))):
            w = words(t)
            keep.append(search.find(w)[0].sum() <= most * len(w))
        import pyarrow as pa
        yield batch.filter(pa.array(keep, type=pa.bool_()))


def drop_contaminated(docs: DataFrame, benchmark: DataFrame, window: int = 10, most_bytes: int = 16 << 20,
                      text: str = "text", item_id: str = "item_id", item_text: str = "text") -> DataFrame:
    """The rows of ``docs``, all columns, without those that hold a window of the benchmark."""
    items = (benchmark.select(F.col(item_id).cast("string").alias("item_id"), F.col(item_text).cast("string").alias("text"))
             .dropna().distinct())
    for part in slices(items, most_bytes):
        shared = docs.sparkSession.sparkContext.broadcast(tuple(sorted((r.item_id, r.text.encode()) for r in part.collect())))
        docs = map_arrow(docs, lambda batches, shared=shared: _is_clean(batches, shared, window, text, 0.0), docs.schema)
    return docs
