"""Hard negatives by angular triangle filtering.

Every row stores its angles to a few reference directions.  For an anchor at angle ``a`` and a row at
angle ``b`` to one reference, the angle between the two lies within ``|a - b|`` and ``a + b``; over all
references this gives an interval of their cosine, and times the norms a lower and an upper bound
of the score, widened by more than all rounding.  Only rows whose interval reaches into a window
that is asked for are scored, in whole numbers.  Rows lie in cells of their nearest reference;
the same test on a cell's smallest and largest angles rules out whole cells before anything is sent.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F

from ..session import materialize
from .common import map_arrow
from .whole_vectors import padded, whole_vectors, width_of

REFERENCES = 16
BLOCK_ROWS = 32_768  # rows of a unit, held in one task's memory
SLACK = 4e-6  # radians, beyond the rounding of arccos and of the stored 32-bit angles


def angles(x: np.ndarray, refs: np.ndarray) -> np.ndarray:
    """Angles to each reference; a zero vector, whose scores are all 0, gets right angles."""
    norm = np.sqrt((x * x).sum(axis=1))
    return np.arccos(np.clip((x @ refs.T) / np.where(norm > 0, norm, 1)[:, None], -1, 1))


def bounds(a: np.ndarray, a_norm: float, low: np.ndarray, high: np.ndarray, norm: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Least and largest score with anything at angles within ``low``..``high`` (rows by references) and norms up to ``norm``."""
    least = np.maximum(np.maximum(low - a, a - high).max(axis=1) - SLACK, 0)
    most = np.minimum(np.minimum(a + high, 2 * np.pi - (a + low)).min(axis=1) + SLACK, np.pi)
    size = a_norm * norm
    top, bottom = np.cos(np.minimum(least, np.pi)), np.cos(np.maximum(most, 0))
    return bottom * size - 1 - 1e-9 * size, top * size + 1 + 1e-9 * size


def scores(x: np.ndarray, q: np.ndarray, x_norm: np.ndarray, q_norm: float) -> np.ndarray:
    """Exact inner products of whole numbers."""
    if q_norm * x_norm.max(initial=0) < 1 << 52 and np.abs(q).max(initial=0) * np.abs(x).max(initial=0) * len(q) < 1 << 52:
        return (x.astype(np.float64) @ q.astype(np.float64)).astype(np.int64)
    return x @ q


def first(score: np.ndarray, ids: np.ndarray, k: int) -> np.ndarray:
    """Places of the first ``k``: higher scores, then smaller ids."""
    if len(score) > k:
        some = np.flatnonzero(score >= np.partition(score, len(score) - k)[len(score) - k])
    else:
        some = np.arange(len(score))
    return some[np.lexsort((ids[some], -score[some]))][:k]


class Unit:
    """A block of rows with their labels, norms and stored angles."""

    def __init__(self, batches: list, width: int) -> None:
        table = pa.Table.from_batches(batches).combine_chunks()
        self.x = padded(table["v"], width)
        self.ids, self.labels = table["vec_id"].to_numpy(), table["label"].to_numpy()
        self.angles = table["angles"].combine_chunks().flatten().to_numpy().reshape(len(self.x), -1).astype(np.float64)
        self.norm = np.sqrt((self.x.astype(np.float64) ** 2).sum(axis=1))
        self.of = {}
        for label in np.unique(self.labels).tolist():
            self.of[label] = np.flatnonzero(self.labels == label), np.flatnonzero(self.labels != label)

    def positives(self, q, angle, norm: float, anchor: int, label: int, k: int):
        """The first ``k`` rows of the anchor's label: likely ones first, then those whose bound reaches the k-th."""
        some = self.of.get(label, (np.empty(0, np.int64),))[0]
        some = some[self.ids[some] != anchor]
        if not len(some):
            return some, some
        _, top = bounds(angle, norm, self.angles[some], self.angles[some], self.norm[some])
        if len(some) > 8 * k:
            likely = np.argpartition(-top, 4 * k)[:4 * k]
            reached = np.sort(scores(self.x[some[likely]], q, self.norm[some[likely]], norm))[-k]
            some = some[top >= reached]
        score = scores(self.x[some], q, self.norm[some], norm)
        at = first(score, self.ids[some], k)
        return self.ids[some[at]], score[at]

    def negatives(self, q, angle, norm: float, anchor: int, label: int, windows: list, k: int):
        """For each window of scores, the first ``k`` rows of other labels inside it."""
        some = self.of[label][1] if label in self.of else np.arange(len(self.ids))
        some = some[self.ids[some] != anchor]
        low, top = bounds(angle, norm, self.angles[some], self.angles[some], self.norm[some])
        reach = np.zeros(len(some), dtype=bool)
        for bottom, ceiling in set(windows):
            reach |= (top >= bottom) & (low <= ceiling)
        some = some[reach]
        score = scores(self.x[some], q, self.norm[some], norm)
        for w, (bottom, ceiling) in enumerate(windows):
            inside = np.flatnonzero((score >= bottom) & (score <= ceiling))
            at = inside[first(score[inside], self.ids[some[inside]], k)]
            yield w, self.ids[some[at]], score[at]


def window(positive: int) -> tuple[int, int]:
    """Scores s with 80 * positive <= 100 * s <= 100 * positive."""
    return -(-4 * positive // 5), positive


def _units(batches, width: int):
    """Each unit's rows, then its anchors a batch at a time."""
    unit, held, block = None, [], None
    for batch in batches:
        units, kinds = batch.column(0).to_numpy(), batch.column(1).to_numpy()
        if not len(units):
            continue
        cuts = np.flatnonzero(np.append(True, (units[1:] != units[:-1]) | (kinds[1:] != kinds[:-1])))
        for a, b in zip(cuts.tolist(), np.append(cuts[1:], len(units)).tolist()):
            if units[a] != unit:
                unit, held, block = units[a], [], None
            if kinds[a] == 0:
                held.append(batch.slice(a, b - a))
            elif held:
                block = block or Unit(held, width)
                yield block, batch.slice(a, b - a)


def _anchors(part, width: int):
    q = padded(part["v"], width)
    norm = np.sqrt((q.astype(np.float64) ** 2).sum(axis=1))
    columns = (part[n].to_pylist() for n in ("anchor", "vec_id", "label", "angles", "positives"))
    for x, n, key, vec_id, label, angle, have in zip(q, norm, *columns):
        yield x, n, key, vec_id, label, np.array(angle), have


def _positives(batches, width: int, k: int):
    for block, part in _units(batches, width):
        out = [[], [], []]
        for q, norm, key, vec_id, label, angle, _ in _anchors(part, width):
            ids, score = block.positives(q, angle, norm, vec_id, label, k)
            out[0] += [key] * len(ids)
            out[1] += ids.tolist()
            out[2] += score.tolist()
        yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in out], names=["anchor", "positive_id", "positive_score"])


def _negatives(batches, width: int, k: int):
    for block, part in _units(batches, width):
        out = [[], [], [], [], []]
        for q, norm, key, vec_id, label, angle, have in _anchors(part, width):
            pairs = list(dict.fromkeys((p["positive_id"], p["positive_score"]) for p in have))
            for w, ids, score in block.negatives(q, angle, norm, vec_id, label, [window(s) for _, s in pairs], k):
                out[0] += [key] * len(ids)
                out[1] += [pairs[w][0]] * len(ids)
                out[2] += [pairs[w][1]] * len(ids)
                out[3] += ids.tolist()
                out[4] += score.tolist()
        names = ["anchor", "positive_id", "positive_score", "negative_id", "negative_score"]
        yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in out], names=names)


def _indexed(batches, refs: np.ndarray, width: int):
    """Stored angles, norm and cell of every row."""
    for batch in batches:
        x = padded(batch.column(2), width).astype(np.float64)
        angle = angles(x, refs).astype(np.float32)
        flat = pa.ListArray.from_arrays(pa.array(np.arange(0, angle.size + 1, len(refs)), pa.int32()), pa.array(angle.ravel()))
        yield pa.RecordBatch.from_arrays([*batch.columns, flat, pa.array(np.sqrt((x * x).sum(axis=1))), pa.array(angle.argmin(axis=1), pa.int32())],
                                         names=["vec_id", "label", "v", "angles", "norm", "cell"])


def _routed(batches, cells: dict):
    """Every anchor once for each unit of the cells that may hold a score it looks for; at most ``REFERENCES`` cells."""
    for batch in batches:
        unit, row = [], []
        for i, (angle, norm, have) in enumerate(zip(*(batch.column(n).to_pylist() for n in ("angles", "norm", "positives")))):
            low, top = bounds(np.array(angle), norm, cells["low"], cells["high"], cells["norm"])
            low = np.minimum(low, np.minimum(0, low))  # a row of the cell may be shorter than its longest
            top = np.maximum(top, 1)
            take = np.ones(len(top), dtype=bool) if have is None else np.zeros(len(top), dtype=bool)
            for p in have or []:
                bottom, ceiling = window(p["positive_score"])
                if bottom <= ceiling:
                    take |= (top >= bottom) & (low <= ceiling)
            for c in np.flatnonzero(take).tolist():
                unit += [cells["cell"][c] << 32 | s for s in range(cells["splits"][c])]
                row += [i] * cells["splits"][c]
        at = pa.array(row, pa.int64())
        names = ["anchor", "vec_id", "label", "v", "angles", "positives"]
        yield pa.RecordBatch.from_arrays([pa.array(unit, pa.int64()), pa.array(np.ones(len(unit), np.int32)), *[batch.column(n).take(at) for n in names]],
                                         names=["unit", "kind", *names])


def hard_negatives(vectors: DataFrame, anchors, positives: int = 5, negatives: int = 5, relabel=None, vec_id: str = "vec_id",
                   vector: str = "embedding", label: str = "label") -> DataFrame:
    """``anchor_id, positive_id, rank, negative_id, positive_score, negative_score``.

    ``anchors`` is a condition on ``vec_id``; ``relabel`` a Column over ``vec_id`` and ``label`` that replaces the label.
    Components become ``floor(256 * x)``, at most 2 ** 24 in size, shorter vectors count as filled up with zeros.
    Rows with a null id, label or vector, or a null or non-finite component, take no part.  Rows that repeat id, label and
    vector count once; a row that shares the anchor's id is never its partner; an id with several vectors is as many
    anchors.  Ties go to smaller ids.  Positives without negatives give no rows, nor do empty tables.
    """
    spark = vectors.sparkSession
    rows = whole_vectors(vectors, 256, vec_id, vector, label).withColumn("label", F.col("label").cast("long")).dropna(subset=["vec_id", "label"])
    if relabel is not None:
        rows = rows.withColumn("label", relabel.cast("long"))
    width = max(1, width_of(rows))
    picked = rows.orderBy(F.xxhash64("v"), "v", "vec_id", "label").limit(REFERENCES).select("v").toArrow()
    refs = padded(picked["v"], width).astype(np.float64)
    refs = refs[np.any(refs != 0, axis=1)]
    refs = np.eye(1, width) if not len(refs) else refs / np.sqrt((refs * refs).sum(axis=1))[:, None]
    kept = "vec_id long, label long, v array<int>"
    index = map_arrow(rows.dropDuplicates(["vec_id", "label", "v"]), lambda b: _indexed(b, refs, width),
                      f"{kept}, angles array<float>, norm double, cell int", __name__)
    index = materialize(index, "angles")
    places = [F.element_at("angles", r + 1) for r in range(len(refs))]
    stats = index.groupBy("cell").agg(F.count(F.lit(1)).alias("n"), F.max("norm").alias("norm"), F.array(*map(F.min, places)).alias("low"),
                                      F.array(*map(F.max, places)).alias("high")).collect()  # one row a reference
    if not stats:
        return spark.createDataFrame([], "anchor_id long, positive_id long, rank int, negative_id long, positive_score long, negative_score long")
    cells = {"cell": [s.cell for s in stats], "splits": [-(-s.n // BLOCK_ROWS) for s in stats], "norm": np.array([s.norm for s in stats]),
             "low": np.array([s.low for s in stats]), "high": np.array([s.high for s in stats])}
    splits = F.element_at(F.create_map(*[F.lit(v) for pair in zip(cells["cell"], cells["splits"]) for v in pair]), F.col("cell"))
    unit = F.col("cell").cast("long") * (1 << 32) + F.pmod(F.xxhash64("vec_id", "v"), splits)
    empty = F.lit(None).cast("array<struct<positive_id:bigint,positive_score:bigint>>")
    columns = ["unit", "kind", "anchor", "vec_id", "label", "v", "angles", "positives"]
    members = index.select(unit.alias("unit"), F.lit(0).alias("kind"), F.lit(None).cast("long").alias("anchor"), "vec_id", "label", "v", "angles",
                           empty.alias("positives"))
    asked = index.filter(anchors).withColumn("anchor", F.xxhash64("vec_id", "label", "v")).withColumn("positives", empty)

    def scored(of: DataFrame, run, schema: str, k: int) -> DataFrame:
        routed = map_arrow(of, lambda b: _routed(b, cells), f"unit long, kind int, anchor long, {kept}, angles array<float>, "
                           "positives array<struct<positive_id:bigint,positive_score:bigint>>", __name__)
        both = members.unionByName(routed.select(columns)).repartition("unit").sortWithinPartitions("unit", "kind")
        return map_arrow(both, lambda b: run(b, width, k), schema, __name__)

    near = scored(asked, _positives, "anchor long, positive_id long, positive_score long", positives)
    order = Window.partitionBy("anchor").orderBy(F.desc("positive_score"), "positive_id")
    near = near.withColumn("r", F.row_number().over(order)).filter(F.col("r") <= positives)
    near = near.groupBy("anchor").agg(F.collect_list(F.struct("positive_id", "positive_score")).alias("positives"))
    asked = materialize(asked.drop("positives").join(near, "anchor"), "positives")
    found = scored(asked, _negatives, "anchor long, positive_id long, positive_score long, negative_id long, negative_score long", negatives)
    order = Window.partitionBy("anchor", "positive_id", "positive_score").orderBy(F.desc("negative_score"), "negative_id")
    found = found.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= negatives)
    return found.join(asked.select("anchor", F.col("vec_id").alias("anchor_id")), "anchor").select(
        "anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score")
