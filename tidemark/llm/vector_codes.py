"""Product codes of vectors: four codebooks, refined in rounds, searched by Orchard's method.

Every codebook entry has a list of all entries sorted by their distance from it.  The search of a
part starts at a guess, walks the list of its current entry block by block, marks what it has
compared, jumps to the list of an entry that is nearer, and stops where the list's distances pass
twice the current one: by the triangle inequality nothing behind that place is as near.  All
arithmetic is on integers, so equal distances are equal and go to the lower index.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from ..session import materialize
from .common import map_arrow
from .whole_vectors import padded, whole_vectors, width_of

PARTS = 4
ENTRIES = 256
BLOCK = 32  # entries of a list compared at once
GROUP_ROWS = 8192  # rows searched together


class Orchard:
    """Nearest entry of one codebook, with each entry's distance-sorted list of all entries."""

    def __init__(self, entries: np.ndarray) -> None:
        largest = int(np.abs(entries).max(initial=0))
        self.kind = np.float64 if largest < 1 << 20 and 16 * entries.shape[1] * largest * largest < 1 << 51 else np.int64
        self.entries = entries.astype(self.kind)
        gaps = np.stack([((self.entries - e) ** 2).sum(axis=1) for e in self.entries]) if len(entries) else np.empty((0, 0), self.kind)
        self.near = np.argsort(gaps, axis=1, kind="stable")
        self.gaps = np.take_along_axis(gaps, self.near, axis=1)
        self.compared = 0  # distances that were worked out

    def distances(self, x: np.ndarray, entries: np.ndarray) -> np.ndarray:
        """Exact squared distances: products of whole numbers below 2 ** 53 are exact in any order."""
        e = self.entries[entries]
        self.compared += len(x) * len(entries)
        return (x * x).sum(axis=1)[:, None] - 2 * (x @ e.T) + (e * e).sum(axis=1)

    def assign(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Index of each row's nearest entry, ties to the lower one, and the squared distance."""
        small = np.abs(x).max(initial=0) < 1 << 20 and 16 * max(1, x.shape[1]) * int(np.abs(x).max(initial=0)) ** 2 < 1 << 51
        if not small and self.kind is np.float64:
            exact = Orchard(self.entries.astype(np.int64))
            exact.kind, exact.entries = np.int64, self.entries.astype(np.int64)
            exact.gaps = self.gaps.astype(np.int64)
            return exact.assign(x)
        x = x.astype(self.kind)
        n, k = len(x), len(self.entries)
        guess = np.arange(0, k, max(1, k // 16))
        first = self.distances(x, guess)
        at = first.argmin(axis=1)
        best, least = guess[at], first[np.arange(n), at]
        seen = np.zeros((n, k), dtype=bool)
        seen[:, guess] = True
        place = np.zeros(n, dtype=np.int64)
        live = np.arange(n)
        while len(live):
            key = best[live] * (k + BLOCK) + place[live]
            order = np.argsort(key, kind="stable")
            live, key = live[order], key[order]
            cuts = np.flatnonzero(np.append(True, key[1:] != key[:-1]))
            going = []
            for rows, head in zip(np.split(live, cuts[1:]), key[cuts].tolist()):
                entry, start = divmod(head, k + BLOCK)
                gaps = self.gaps[entry, start:start + BLOCK]
                rows = rows[gaps[0] <= 4 * least[rows]]  # beyond twice the distance: done
                if not len(rows):
                    continue
                some = self.near[entry, start:start + np.searchsorted(gaps, 4 * least[rows].max(), "right")]
                some = np.sort(some[~seen[np.ix_(rows, some)].all(axis=0)])
                place[rows] += BLOCK
                if len(some):
                    found = self.distances(x[rows], some)
                    seen[np.ix_(rows, some)] = True
                    at = found.argmin(axis=1)
                    near, index = found[np.arange(len(rows)), at], some[at]
                    better = (near < least[rows]) | ((near == least[rows]) & (index < best[rows]))
                    jump = rows[better]
                    best[jump], least[jump], place[jump] = index[better], near[better], 0
                going.append(rows[place[rows] < k])
            live = np.concatenate(going) if going else live[:0]
        return best, least.astype(np.int64)


def _groups(batches, width: int):
    """Whole columns of a few thousand rows at a time, and their parts."""
    held, rows = [], 0
    for batch in batches:
        held.append(batch)
        rows += batch.num_rows
        if rows >= GROUP_ROWS:
            yield _joined(held, width)
            held, rows = [], 0
    if rows:
        yield _joined(held, width)


def _joined(batches: list, width: int):
    table = pa.Table.from_batches(batches).combine_chunks()
    x = padded(table["v"], width)
    return table, np.split(x, PARTS, axis=1)


def _sums(batches, books, width: int):
    """Sum and number of each entry's parts over one task."""
    lists = [Orchard(b) for b in books.value]
    total = np.zeros((PARTS, ENTRIES, width // PARTS), dtype=np.int64)
    count = np.zeros((PARTS, ENTRIES), dtype=np.int64)
    for _, parts in _groups(batches, width):
        for p, (x, search) in enumerate(zip(parts, lists)):
            code, _ = search.assign(x)
            order = np.argsort(code, kind="stable")
            cuts = np.flatnonzero(np.append(True, np.diff(code[order]) != 0))
            total[p, code[order][cuts]] += np.add.reduceat(x[order], cuts, axis=0)
            count[p] += np.bincount(code, minlength=ENTRIES)
    p, e = np.nonzero(count)
    size = width // PARTS
    yield pa.RecordBatch.from_arrays(
        [pa.array(np.repeat(p, size), pa.int32()), pa.array(np.repeat(e, size), pa.int32()), pa.array(np.tile(np.arange(size), len(p)), pa.int32()),
         pa.array(total[p, e].ravel()), pa.array(np.repeat(count[p, e], size))], names=["part", "entry", "place", "total", "n"])


def _coded(batches, books, width: int):
    lists = [Orchard(b) for b in books.value]
    for table, parts in _groups(batches, width):
        found = [search.assign(x) for x, search in zip(parts, lists)]
        code = np.stack([f[0] for f in found], axis=1).astype(np.uint8).tobytes()
        codes = [code[i:i + PARTS].hex() for i in range(0, len(code), PARTS)]
        yield pa.RecordBatch.from_arrays([table["vec_id"].combine_chunks(), table["label"].combine_chunks(), pa.array(codes, pa.string()),
                                          pa.array(sum(f[1] for f in found), pa.int64())], names=["vec_id", "label", "code", "error"])


def train(rows: DataFrame, width: int, rounds: int) -> list[np.ndarray]:
    """The codebooks; what comes to the driver is one sum for each entry and place, whatever the rows."""
    spark = rows.sparkSession
    first = rows.orderBy(F.asc_nulls_last("vec_id"), "v").limit(ENTRIES).select("v").toArrow()
    books = np.split(padded(first["v"], width), PARTS, axis=1)
    for _ in range(rounds if width and len(books[0]) else 0):
        shared = spark.sparkContext.broadcast(books)
        sums = map_arrow(rows, lambda b: _sums(b, shared, width), "part int, entry int, place int, total long, n long", __name__)
        sums = sums.groupBy("part", "entry", "place").agg(F.sum(F.col("total").cast("decimal(38,0)")).alias("total"), F.sum("n").alias("n"))
        books = [b.copy() for b in books]
        for r in sums.collect():  # at most one row a component of the codebooks
            books[r.part][r.entry, r.place] = int(r.total) // r.n
    return books


def digest(books: list[np.ndarray]) -> str:
    """Digest of all components by part, entry and place."""
    return hashlib.sha256(",".join(str(c) for b in books for c in b.ravel().tolist()).encode()).hexdigest()


def product_codes(vectors: DataFrame, rounds: int = 4, vec_id: str = "vec_id", vector: str = "embedding", label: str = "label") -> DataFrame:
    """``vec_id, code, error, label_error, codebooks_sha256`` of every row with a whole vector.

    Components become ``floor(1024 * x)``, at most 2 ** 24 in size; vectors that are shorter than the longest, or
    a longest that four does not divide, count as filled up with zeros.  The codebooks start as the parts of the
    256 smallest ids (null ids last, equal ids by vector; all, if fewer) and are refined ``rounds`` times over all rows.
    Null vectors and vectors with null or non-finite components are dropped; null and repeated ids and repeated
    rows are kept, each row by itself; null labels are one label; other columns are not looked at.  No rows give no rows.
    """
    spark = vectors.sparkSession
    rows = whole_vectors(vectors, 1024, vec_id, vector, label)
    width = -(-width_of(rows) // PARTS) * PARTS
    books = train(rows, width, rounds)
    shared = spark.sparkContext.broadcast(books)
    schema = f"vec_id long, label {rows.schema['label'].dataType.simpleString()}, code string, error long"
    coded = materialize(map_arrow(rows, lambda b: _coded(b, shared, width), schema, __name__), "codes")
    sums = coded.groupBy("label").agg(F.sum("error").alias("label_error")).withColumnRenamed("label", "of")
    out = coded.join(sums, F.col("label").eqNullSafe(F.col("of")))
    return out.select("vec_id", "code", "error", "label_error", F.lit(digest(books)).alias("codebooks_sha256"))
