"""Removal of passages of 50 bytes that an earlier document has too.

Every string of 50 bytes is given to one anchor inside it: its 16 bytes of least hash, of equal ones the
first.  Equal strings have equal anchors at equal places, so only stretches of text around equal anchors can
hold them.

1. Each stretch (all strings of one anchor in one document) is sent by a bucket of its anchor as a few
   numbers.  Stretches that are equal as a whole are settled there (and before, inside a batch): all but
   those of the smallest id go.  Of the others, those whose anchor has several different stretches, and
   which share 33 bytes with another as far as a filter tells, are left open.
2. The text of open stretches is cut from the documents and sent by anchor; their suffixes are sorted
   (deep-shallow), and of equal strings all but those of the smallest id go.
3. Removed ranges meet their documents.

Anchors that a sample finds in many documents could fill a bucket.  Their strings are sent one by one,
by their own hash, after equal ones of a batch were settled, so that what a batch sends of one string is
one row.  Documents are told apart by id and a hash of the text, so rows that repeat an id may differ.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import DataFrame, functions as F
from pyspark.sql.types import LongType, StructField, StructType

from ..session import materialize
from .common import id_and_text, map_arrow, map_batches, mix, row_bytes, signed
from .suffix_sort import sort_suffixes

LENGTH, GRAM = 50, 16
SPAN = LENGTH - GRAM + 1  # grams of one string
HALF = (LENGTH - GRAM) // 2
SLICE = 1 << 16  # bytes whose grams are hashed together, eight numbers of eight bytes for each
PLACE = np.uint64((2 << 20) - 1)  # low bits that hold a place in a slice
PART = 6 << 20  # bytes of text that are looked at together
_rng = np.random.default_rng(50)
BYTE = _rng.integers(1, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
BASE = 0x9E3779B97F4A7C15
POWERS = [np.uint64(pow(BASE, 1 << k, 1 << 64)) for k in range(8)]
INVERSE = np.uint64(pow(BASE, -1, 1 << 64))
SHARDS, REMOVED, STRETCHES, OPEN = 0, 1, 2, 3  # kinds of rows
ROWS = "kind int, key long, tag long, data binary"


def anchored(blob: np.ndarray, starts: np.ndarray, lengths: np.ndarray):
    """All stretches of texts laid end to end: hash of anchor and of stretch, text, first string, strings, and two filters."""
    parts = [_slice(blob, starts, lengths, lo, min(lo + SLICE, len(blob))) for lo in range(0, len(blob), SLICE)]
    return _runs(*[np.concatenate(x) for x in zip(*parts)]) if parts else [np.empty(0, np.int64)] * 7


def _runs(h, g, text, s1, n, b, e):
    """Equal stretches that follow each other (a text of short period) as one, with the hash of one of them."""
    end = s1 + n
    heads = np.flatnonzero(heads_of(h, g, text) | np.append(True, s1[1:] != end[:-1])[:len(h)])
    tails = np.append(heads[1:], len(h))[:len(heads)] - 1
    return [h[heads], g[heads], text[heads], s1[heads], end[tails] - s1[heads], b[heads], e[heads]]


def _slice(blob, starts, lengths, lo, hi):
    base = max(0, lo - 2 * LENGTH)
    part = blob[base:min(len(blob), hi + 2 * LENGTH)]
    n = len(part)
    none = [np.empty(0, np.uint64)] * 2 + [np.empty(0, np.int64)] * 3 + [np.empty(0, np.uint8)] * 2
    if n < LENGTH:
        return none
    t = BYTE[part]
    h, size, k = t, 1, 0
    while size < GRAM:
        h = h[:-size] * POWERS[k] + h[size:]
        size, k = 2 * size, k + 1
    h = mix(h)
    v = (h & ~PLACE) | np.arange(len(h), dtype=np.uint64)  # of equal hashes the leftmost is the least
    size = 1
    while 2 * size <= SPAN:
        v = np.minimum(v[:-size], v[size:])
        size *= 2
    if SPAN > size:
        v = np.minimum(v[:size - SPAN], v[SPAN - size:])
    first, last = np.searchsorted(starts, [base, base + n], side="right") - 1
    own, size = starts[first:last + 1] - base, lengths[first:last + 1]
    w = np.arange(lo - base, min(hi - base, len(v)))
    text = np.searchsorted(own, w, side="right") - 1
    inside = w + LENGTH <= own[text] + size[text]
    w, text = w[inside], text[inside]
    if not len(w):
        return none
    at = (v[w] & PLACE).astype(np.int64)
    new = np.append(True, (at[1:] != at[:-1]) | (text[1:] != text[:-1]))
    heads = np.flatnonzero(new)
    tails = np.append(heads[1:], len(w)) - 1
    a, text, s1, s2 = at[heads], text[heads], w[heads], w[tails]
    up = np.cumprod(np.concatenate([[np.uint64(1)], np.full(n, np.uint64(BASE))]))
    down = np.cumprod(np.concatenate([[np.uint64(1)], np.full(n - 1, INVERSE)]))
    sums = np.concatenate([[np.uint64(0)], np.cumsum(t * down)])

    def piece(x, y):
        return mix((sums[y] - sums[x]) * up[x] + (y - x).astype(np.uint64))

    stretch = mix(piece(s1, s2 + LENGTH) + (a - s1).astype(np.uint64))
    begin, end = own[text], own[text] + size[text]
    before = np.where(a - HALF >= begin, (piece(np.maximum(a - HALF, 0), a + GRAM) & np.uint64(127)).astype(np.uint8) + 1, 0)
    behind = np.where(a + GRAM + HALF <= end, (piece(a, np.minimum(a + GRAM + HALF, n)) & np.uint64(127)).astype(np.uint8) + 1, 0)
    return [h[a], stretch, text + first, s1 - own[text], s2 - s1 + 1, before.astype(np.uint8), behind.astype(np.uint8)]


def low_bytes(x: np.ndarray, n: int) -> bytes:
    return np.ascontiguousarray(x.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :n]).tobytes()


class Pack:
    """Arrays of one row's ``data``, one after the other."""

    def __init__(self, data: bytes) -> None:
        self.data, self.at = data, 0

    def take(self, kind, n: int) -> np.ndarray:
        out = np.frombuffer(self.data, kind, n, self.at)
        self.at += out.nbytes
        return out

    def numbers(self, n: int, width: int) -> np.ndarray:
        out = np.zeros((n, 8), np.uint8)
        out[:, :width] = self.take(np.uint8, n * width).reshape(n, width)
        return out.view("<u8").ravel()


def heads_of(*columns: np.ndarray) -> np.ndarray:
    """Where a sorted run of equal rows begins."""
    new = np.zeros(len(columns[0]), bool)
    new[:1] = True
    for c in columns:
        new[1:] |= c[1:] != c[:-1]
    return new


def ranges(at: np.ndarray, end: np.ndarray) -> bytes:
    return np.stack([at, end], axis=1).astype("<i8").tobytes()


def settled(ids, tags, at, end):
    """Rows of removed ranges, one for each document."""
    order = np.lexsort((at, tags, ids))
    ids, tags, at, end = ids[order], tags[order], at[order], end[order]
    heads = np.flatnonzero(heads_of(ids, tags))
    for x, y in zip(heads.tolist(), np.append(heads[1:], len(ids)).tolist()):
        reach = np.maximum.accumulate(end[x:y])
        cut = np.flatnonzero(np.append(True, at[x + 1:y] > reach[:-1]))
        yield REMOVED, int(ids[x]), int(tags[x]), ranges(at[x:y][cut], np.append(reach[cut[1:] - 1], reach[-1]))


def as_batch(rows: list) -> pa.RecordBatch:
    kind, key, tag, data = zip(*rows) if rows else ((), (), (), ())
    return pa.RecordBatch.from_arrays([pa.array(kind, pa.int32()), pa.array(key, pa.int64()), pa.array(tag, pa.int64()), pa.array(data, pa.binary())],
                                      names=["kind", "key", "tag", "data"])


def batched(rows, most: int = 8 << 20):
    """Record batches of bounded size."""
    held, size = [], 0
    for row in rows:
        held.append(row)
        size += len(row[3]) + 64
        if size > most:
            yield as_batch(held)
            held, size = [], 0
    if held:
        yield as_batch(held)


def text_hash(text: bytes) -> int:
    return xxhash.xxh3_64_intdigest(text) - (1 << 63)


def _laid(batch: pa.RecordBatch):
    """Texts of a batch by ascending id, in parts of bounded size; rows without id and short texts are left out."""
    some = sorted((i, t) for i, t in zip(batch.column(0).to_pylist(), row_bytes(batch.column(1))) if i is not None and len(t) >= LENGTH)
    at = 0
    while at < len(some):
        end, size = at, 0
        while end < len(some) and (end == at or size + len(some[end][1]) <= PART):
            size += len(some[end][1])
            end += 1
        part = some[at:end]
        lengths = np.array([len(t) for _, t in part])
        yield (np.array([i for i, _ in part]), np.array([text_hash(t) for _, t in part]), np.frombuffer(b"".join(t for _, t in part), np.uint8),
               np.cumsum(lengths) - lengths, lengths)
        at = end


def _send(batches, buckets: int, hot):
    """Step 1 in the documents' tasks."""
    def rows():
        for batch in batches:
            for ids, tags, blob, starts, lengths in _laid(batch):
                h, g, text, s1, n, b, e = anchored(blob, starts, lengths)
                common = np.isin(h, hot.value) if len(hot.value) else np.zeros(len(h), bool)
                doc = ids[text]
                order = np.lexsort((doc, g, h))
                new = heads_of(h[order], g[order])
                least = doc[order][new][np.cumsum(new) - 1]
                gone = np.zeros(len(h), bool)
                gone[order] = doc[order] > least
                if gone.any():
                    yield from settled(doc[gone], tags[text[gone]], s1[gone], s1[gone] + n[gone] + LENGTH - 1)
                keep = np.flatnonzero(~gone & ~common)
                bucket = h[keep] % np.uint64(buckets)
                keep = keep[np.argsort(bucket, kind="stable")]
                cuts = np.searchsorted(np.sort(bucket), np.arange(buckets + 1, dtype=np.uint64))
                for k in np.flatnonzero(np.diff(cuts)).tolist():
                    x = keep[cuts[k]:cuts[k + 1]]
                    x = x[np.argsort(text[x], kind="stable")]
                    docs, counts = np.unique(text[x], return_counts=True)
                    yield SHARDS, k, None, b"".join([
                        np.array([len(x), len(docs)], "<i8").tobytes(), ids[docs].astype("<i8").tobytes(), tags[docs].astype("<i8").tobytes(),
                        counts.astype("<u4").tobytes(), low_bytes(h[x] // np.uint64(buckets), 5), low_bytes(g[x], 6),
                        (s1[x] & 0xFFFF).astype("<u2").tobytes(), (s1[x] >> 16).astype("<u4").tobytes(), n[x].astype("<u4").tobytes(),
                        b[x].tobytes(), e[x].tobytes()])
                x = np.flatnonzero(~gone & common)
                if len(x):  # single strings of common anchors, the smallest id of each in this part
                    text_of, at = np.repeat(text[x], n[x]), np.repeat(s1[x], n[x]) + within(n[x])
                    order, same = sort_suffixes(blob, starts[text_of] + at, LENGTH)
                    yield from _strings(ids[text_of][order], tags[text_of][order], at[order], (starts[text_of] + at)[order], same, blob, buckets)

    yield from batched(rows())


def within(counts: np.ndarray) -> np.ndarray:
    """0, 1, .. for each count in turn."""
    return np.arange(counts.sum()) - np.repeat(np.cumsum(counts) - counts, counts)


def _strings(ids, tags, at, place, same, blob, buckets):
    least = np.full(same[-1] + 1, np.iinfo(np.int64).max)
    np.minimum.at(least, same, ids)
    gone = ids > least[same]
    if gone.any():
        yield from settled(ids[gone], tags[gone], at[gone], at[gone] + LENGTH)
    keep = np.flatnonzero(~gone)
    raw = blob.tobytes()
    texts = [raw[p:p + LENGTH] for p in place[keep].tolist()]
    bucket = np.array([xxhash.xxh3_64_intdigest(t) % buckets for t in texts])
    for k in np.unique(bucket).tolist():
        x = np.flatnonzero(bucket == k)
        yield _stretch_row(k, ids[keep[x]], tags[keep[x]], at[keep[x]], np.ones(len(x), np.int64), b"".join(texts[i] for i in x.tolist()))


def _stretch_row(bucket: int, ids, tags, at, n, text: bytes):
    return STRETCHES, bucket, None, b"".join([np.array([len(ids)], "<i8").tobytes(), ids.astype("<i8").tobytes(), tags.astype("<i8").tobytes(),
                                              at.astype("<i8").tobytes(), n.astype("<i8").tobytes(), text])


def by_key(batches, kind: int, work):
    """Rows of other kinds as they are; those of ``kind`` by key, which come one after the other."""
    key, held = None, []
    for batch in batches:
        kinds, keys, tags = (batch.column(k).to_pylist() for k in range(3))
        for row_kind, row_key, tag, data in zip(kinds, keys, tags, batch.column(3)):
            if row_kind != kind:
                yield row_kind, row_key, tag, data.as_py()
                continue
            if row_key != key and held:
                yield from work(held, key)
                held = []
            key = row_key
            held.append(data.as_py())
    if held:
        yield from work(held, key)


def _classes(held: list[bytes], bucket: int):
    """Step 1 in a bucket's task."""
    columns: list[list] = [[] for _ in range(8)]
    for data in held:
        pack = Pack(data)
        n, docs = pack.take("<i8", 2).tolist()
        ids, tags, counts = pack.take("<i8", docs), pack.take("<i8", docs), pack.take("<u4", docs)
        h, g = pack.numbers(n, 5), pack.numbers(n, 6)
        s1 = pack.take("<u2", n).astype(np.int64) + (pack.take("<u4", n).astype(np.int64) << 16)
        for c, v in zip(columns, (np.repeat(ids, counts), np.repeat(tags, counts), h, g, s1, pack.take("<u4", n).astype(np.int64),
                                  pack.take(np.uint8, n), pack.take(np.uint8, n))):
            c.append(v)
    held.clear()
    ids, tags, h, g, s1, n, b, e = (np.concatenate(c) for c in columns)
    order = np.lexsort((ids, g, h))
    ids, tags, h, g, s1, n, b, e = (c[order] for c in (ids, tags, h, g, s1, n, b, e))
    new = heads_of(h, g)
    class_of = np.cumsum(new) - 1
    gone = ids > ids[new][class_of]
    if gone.any():
        yield from settled(ids[gone], tags[gone], s1[gone], s1[gone] + n[gone] + LENGTH - 1)
    heads = np.flatnonzero(new)  # one stretch of each class
    anchor = np.cumsum(heads_of(h)) - 1
    shared = np.zeros(len(heads), bool)
    for mark in (b, e):
        key = anchor[heads] * 256 + mark[heads]
        _, back, count = np.unique(key, return_inverse=True, return_counts=True)
        shared |= (count[back] > 1) & (mark[heads] > 0)
    left = np.flatnonzero(shared[class_of] & ~gone)
    left = left[np.lexsort((s1[left], tags[left], ids[left]))]
    starts = np.flatnonzero(heads_of(ids[left], tags[left]))
    for x, y in zip(starts.tolist(), np.append(starts[1:], len(left)).tolist()):
        part = left[x:y]
        data = s1[part].astype("<i8").tobytes() + n[part].astype("<i8").tobytes() + (h[part] * np.uint64(31) + np.uint64(bucket)).astype("<u8").tobytes()
        yield OPEN, int(ids[part[0]]), int(tags[part[0]]), data


def _cut(batches, buckets: int):
    """Step 2 in the documents' tasks: the text of open stretches, by bucket."""
    unpack = zstandard.ZstdDecompressor().decompress

    def rows():
        for batch in batches:
            found: dict[int, list] = {}
            for doc, tag, z, payloads in zip(*[c.to_pylist() for c in batch.columns]):
                text = unpack(z)
                for data in payloads:
                    s1, n, h = np.frombuffer(data, "<i8").reshape(3, -1)
                    for a, k, bucket in zip(s1.tolist(), n.tolist(), (h.view(np.uint64) % np.uint64(buckets)).tolist()):
                        found.setdefault(bucket, []).append((doc, tag, a, k, text[a:a + k + LENGTH - 1]))
            for bucket, parts in found.items():
                doc, tag, at, n, text = zip(*parts)
                yield _stretch_row(bucket, np.array(doc), np.array(tag), np.array(at), np.array(n), b"".join(text))

    yield from batched(rows())


def _sorted(held: list[bytes], bucket: int):
    """Step 2 in a bucket's task."""
    columns: list[list] = [[] for _ in range(5)]
    for data in held:
        pack = Pack(data)
        k = int(pack.take("<i8", 1)[0])
        for c in columns[:4]:
            c.append(pack.take("<i8", k))
        columns[4].append(pack.take(np.uint8, len(data) - pack.at))
    ids, tags, at, n, blob = (np.concatenate(c) for c in columns)
    size = n + LENGTH - 1
    begin = np.cumsum(size) - size
    step = within(n)
    owner = np.repeat(np.arange(len(n)), n)
    order, same = sort_suffixes(blob, begin[owner] + step, LENGTH)
    owner, step = owner[order], step[order]
    least = np.full(same[-1] + 1, np.iinfo(np.int64).max)
    np.minimum.at(least, same, ids[owner])
    gone = ids[owner] > least[same]
    owner, place = owner[gone], (at[owner] + step)[gone]
    if len(owner):
        yield from settled(ids[owner], tags[owner], place, place + LENGTH)


def _common(columns: dict) -> dict:
    out = []
    for text in row_bytes(columns["text"]):
        blob = np.frombuffer(text, np.uint8)
        out.append(np.unique(signed(anchored(blob, np.array([0]), np.array([len(text)]))[0])).tolist() if len(text) >= LENGTH else [])
    return {"anchors": out}


def common_anchors(docs: DataFrame, sample: int, least_share: float) -> np.ndarray:
    """Anchors in at least ``least_share`` of a sample of documents: few, as a text has few anchors a kilobyte.

    They decide only how their strings travel, never what is removed.
    """
    rows = docs.filter("doc_id is not null").sample(min(1.0, sample / max(1, docs.count())), seed=50).limit(2 * sample)
    found = map_batches(rows.select("text"), "anchors array<long>", _common).select(F.explode("anchors").alias("h"))
    many = found.groupBy("h").count().filter(F.col("count") >= max(5, least_share * sample)).select("h").collect()
    return np.sort(np.array([r.h for r in many], dtype=np.int64).view(np.uint64))


def _packed(columns: dict) -> dict:
    pack = zstandard.ZstdCompressor(level=3).compress
    texts = row_bytes(columns["text"])
    return {"doc_id": columns["doc_id"], "tag": [text_hash(t) for t in texts], "z": [pack(t) for t in texts]}


def removed_ranges(docs: DataFrame, bucket_bytes: int = 6 << 20, sample: int = 2000, least_share: float = 0.05) -> tuple[DataFrame, DataFrame]:
    """Packed texts ``doc_id, tag, z`` and removed ranges ``doc_id, tag, parts``."""
    spark = docs.sparkSession
    size = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    buckets = max(16, -(-size // bucket_bytes))
    hot = spark.sparkContext.broadcast(common_anchors(docs, sample, least_share))
    packed = map_batches(docs, "doc_id long, tag long, z binary", _packed)
    sent = map_arrow(docs, lambda b: _send(b, buckets, hot), ROWS)
    first = materialize(
        map_arrow(sent.repartition("kind", "key").sortWithinPartitions("kind", "key"),
                  lambda b: batched(by_key(b, SHARDS, _classes)), ROWS), "passages")
    open_parts = first.filter(F.col("kind") == OPEN).groupBy(F.col("key").alias("doc_id"), "tag").agg(F.collect_list("data").alias("parts"))
    cut = map_arrow(packed.join(open_parts, ["doc_id", "tag"]).select("doc_id", "tag", "z", "parts"), lambda b: _cut(b, buckets), ROWS)
    strings = cut.unionByName(first.filter(F.col("kind") == STRETCHES))
    second = map_arrow(strings.repartition("key").sortWithinPartitions("key"), lambda b: batched(by_key(b, STRETCHES, _sorted)), ROWS)
    gone = first.filter(F.col("kind") == REMOVED).unionByName(second)
    return packed, gone.groupBy(F.col("key").alias("doc_id"), "tag").agg(F.collect_list("data").alias("parts"))


def merged(parts: list[bytes] | None) -> list[tuple[int, int]]:
    """Maximal runs of removed bytes."""
    if not parts:
        return []
    at, end = np.frombuffer(b"".join(parts), "<i8").reshape(-1, 2).T
    order = np.argsort(at, kind="stable")
    at, reach = at[order], np.maximum.accumulate(end[order])
    cut = np.flatnonzero(np.append(True, at[1:] > reach[:-1]))
    return list(zip(at[cut].tolist(), np.append(reach[cut[1:] - 1], reach[-1]).tolist()))


def remaining(text: bytes, spans: list[tuple[int, int]]) -> bytes:
    last, out = 0, []
    for a, b in spans:
        out.append(text[last:a])
        last = b
    return b"".join([*out, text[last:]])


def _result(columns: dict) -> dict:
    unpack = zstandard.ZstdDecompressor().decompress
    out: dict[str, list] = {"doc_id": columns["doc_id"], "n_bytes": [], "n_removed": [], "n_spans": [], "kept_sha256": []}
    for z, parts in zip(columns["z"].to_pylist(), columns["parts"].to_pylist()):
        text, spans = unpack(z), merged(parts)
        out["n_bytes"].append(len(text))
        out["n_removed"].append(sum(b - a for a, b in spans))
        out["n_spans"].append(len(spans))
        out["kept_sha256"].append(hashlib.sha256(remaining(text, spans)).hexdigest())
    return out


def repeated_passages(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", **options) -> DataFrame:
    """``doc_id, n_bytes, n_removed, n_spans, kept_sha256`` of every row.

    Removed is each byte inside a 50-byte string that also starts in a row with a smaller id.  A null
    or empty text has no bytes; a row with a null id neither loses bytes nor makes others lose any;
    rows that repeat an id do not count as earlier for each other.  Other columns are not looked at.
    """
    packed, gone = removed_ranges(id_and_text(docs, doc_id, text), **options)
    rows = packed.join(gone, ["doc_id", "tag"], "left").select("doc_id", "z", "parts")
    return map_batches(rows, "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string", _result)


def drop_repeated_passages(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", **options) -> DataFrame:
    """The rows of ``docs``, all columns, with the removed bytes taken out of their texts.

    Where a cut falls inside a character, what is left of the character goes too; rows whose text
    changes keep all other columns as they are.
    """
    _, gone = removed_ranges(id_and_text(docs, doc_id, text), **options)
    taken = set(docs.columns)
    own, tag, parts = (next(n for n in ("_" * k + name for k in range(1, len(taken) + 2)) if n not in taken) for name in ("id", "tag", "parts"))
    tagged = _tagged(docs.withColumn(own, F.col(doc_id).cast("long")), text, tag)
    gone = gone.select(F.col("doc_id").alias(own), F.col("tag").alias(tag), F.col("parts").alias(parts))
    return _cut_texts(tagged.join(gone, [own, tag], "left"), docs, text, parts)


def _tagged(docs: DataFrame, text: str, tag: str) -> DataFrame:
    schema = StructType([*docs.schema.fields, StructField(tag, LongType())])

    def run(batches):
        for batch in batches:
            tags = [text_hash(t) for t in row_bytes(batch.column(batch.schema.get_field_index(text)).cast(pa.string()))]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(tags, pa.int64())], names=[*batch.schema.names, tag])

    return map_arrow(docs, run, schema)


def _cut_texts(met: DataFrame, docs: DataFrame, text: str, parts_name: str) -> DataFrame:
    names = docs.columns

    def run(batches):
        for batch in batches:
            parts = batch.column(batch.schema.get_field_index(parts_name)).to_pylist()
            columns = []
            for name in names:
                c = batch.column(batch.schema.get_field_index(name))
                if name == text:
                    c = pa.array([t if not p else remaining(t.encode(), merged(p)).decode(errors="ignore") for t, p in zip(c.to_pylist(), parts)], c.type)
                columns.append(c)
            yield pa.RecordBatch.from_arrays(columns, names=names)

    return map_arrow(met, run, docs.schema)
