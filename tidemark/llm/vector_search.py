"""Nearest vectors by a forest of random-projection trees and exact reranking.

Largest inner product is made nearness of directions by one more component (the same length for all
vectors).  Complete trees split at the sample median of a random projection.  A query walks all trees
through one priority queue, best margin first, until it has seen ``visits`` leaves; how many those
are is measured on the sample, so that the wanted recall is reached there.  Every vector is indexed in every
tree; inner products of the original vectors, in double precision, rank the members of the leaves.  A pair
may meet in several leaves: its score is summed in the order of the components, so it is the same in each.

Equal vectors are one entry of the index with its ``k + 1`` smallest ids (no other can be among the
nearest ``k``), so a vector that many rows share fills no leaf.  Large leaves are cut into blocks.
"""

from __future__ import annotations

import heapq
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F

from ..session import materialize
from .common import map_arrow

BLOCK_ROWS = 4096


def matrix(column: pa.Array) -> np.ndarray:
    """List column of equal lengths without nulls as rows of doubles."""
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    return flat.reshape(len(column), -1)


@dataclass
class Forest:
    """``planes[t, node]`` and ``cuts[t, node]``: complete trees in heap order; ``most`` is the largest squared length."""
    planes: np.ndarray
    cuts: np.ndarray
    depth: int
    most: float
    visits: int = 1

    def lifted(self, x: np.ndarray) -> np.ndarray:
        rest = np.sqrt(np.maximum(self.most - (x * x).sum(axis=1), 0.0))
        return np.concatenate([x, rest[:, None]], axis=1)

    def leaves(self, x: np.ndarray) -> np.ndarray:
        """Leaf of every row in every tree."""
        x = self.lifted(x)
        out = np.empty((len(x), len(self.planes)), np.int64)
        for t, (planes, cuts) in enumerate(zip(self.planes, self.cuts)):
            node = np.zeros(len(x), np.int64)
            for _ in range(self.depth):
                node = 2 * node + 1 + (np.einsum("ij,ij->i", x, planes[node]) >= cuts[node])
            out[:, t] = node - (1 << self.depth) + 1
        return out

    def search(self, q: np.ndarray, visits: int) -> list[tuple[int, int]]:
        """(tree, leaf) in the order of the shared queue."""
        q = np.append(q * np.sqrt(self.most) / max(np.linalg.norm(q), 1e-300), 0.0)
        margin = (self.planes @ q - self.cuts).tolist()
        inner, found = (1 << self.depth) - 1, []
        queue = [(-np.inf, t, 0) for t in range(len(margin))]
        while queue and len(found) < visits:
            bound, t, node = heapq.heappop(queue)
            if node >= inner:
                found.append((t, node - inner))
                continue
            m = margin[t][node]
            heapq.heappush(queue, (max(bound, -m), t, 2 * node + 2))
            heapq.heappush(queue, (max(bound, m), t, 2 * node + 1))
        return found


def grow(sample: np.ndarray, rows: int, most: float, k: int, trees: int, leaf_rows: int, recall: float, seed: int = 3) -> Forest:
    """A forest for ``rows`` vectors, and the visits that give ``recall`` on the sample."""
    rng = np.random.default_rng(seed)
    depth = 0
    while rows >> depth > leaf_rows and len(sample) >> (depth + 1) >= 8:
        depth += 1
    inner = max(1, (1 << depth) - 1)
    planes = rng.standard_normal((trees, inner, sample.shape[1] + 1))
    planes /= np.linalg.norm(planes, axis=2, keepdims=True)
    forest = Forest(planes, np.zeros((trees, inner)), depth, most)
    x = forest.lifted(sample)
    for t in range(trees):
        node = np.zeros(len(x), np.int64)
        for level in range(depth):
            side = np.einsum("ij,ij->i", x, planes[t][node])
            for n in range((1 << level) - 1, (2 << level) - 1):
                mine = side[node == n]
                forest.cuts[t, n] = np.median(mine) if len(mine) else 0.0
            node = 2 * node + 1 + (side >= forest.cuts[t][node])
    total = trees << depth
    leaf = forest.leaves(sample)
    seen = []
    for i in rng.permutation(len(sample))[:128]:
        near = sample @ sample[i]
        near[i] = -np.inf
        best = np.argsort(-near)[:min(k, len(sample) - 1)]
        rank = {key: r for r, key in enumerate(forest.search(sample[i], total))}
        seen += [min(rank[(t, int(leaf[b, t]))] for t in range(trees)) for b in best.tolist()]
    seen.sort()
    forest.visits = total if not seen else min(total, seen[min(len(seen) - 1, int(recall * len(seen)))] + 1)
    return forest


def usable(rows: DataFrame) -> DataFrame:
    """Rows with an id and a vector that is not null or zero and has only finite components, of the most frequent length."""
    bad = F.exists("v", lambda c: c.isNull() | F.isnan(c) | (F.abs(c) == float("inf")))
    rows = rows.filter(F.col("vec_id").isNotNull() & F.col("v").isNotNull()).filter(~bad & F.exists("v", lambda c: c != 0))
    sizes = rows.groupBy(F.size("v").alias("d")).count().orderBy(F.desc("count"), F.desc("d")).limit(1).collect()
    return rows.filter(F.size("v") == (sizes[0].d if sizes else 0))


def _indexed(batches, shared, blocks):
    """Every vector once for each tree, under its leaf's block."""
    forest = shared.value
    for batch in batches:
        if not batch.num_rows:
            continue
        ids = batch.column(0).to_numpy()
        leaf = forest.leaves(matrix(batch.column(1)))
        for t in range(leaf.shape[1]):
            n = blocks.value[t][leaf[:, t]]
            unit = (t << 40) | (leaf[:, t] << 20) | (ids.astype(np.uint64) % n.astype(np.uint64)).astype(np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(unit, pa.int64()), pa.array(np.zeros(len(ids), np.int32)), batch.column(0), batch.column(1), batch.column(2)],
                                             names=["unit", "kind", "id", "v", "low"])


def _routed(batches, shared, blocks):
    """Every query once for each block of the leaves it visits."""
    forest = shared.value
    for batch in batches:
        ids, v = batch.column(0).to_pylist(), matrix(batch.column(1)) if batch.num_rows else np.empty((0, 1))
        for at in range(0, len(ids), 256):
            unit, row = [], []
            for i in range(at, min(at + 256, len(ids))):
                for t, leaf in forest.search(v[i], forest.visits):
                    for b in range(int(blocks.value[t][leaf])):
                        unit.append((t << 40) | (leaf << 20) | b)
                        row.append(i)
            yield pa.RecordBatch.from_arrays([pa.array(unit, pa.int64()), pa.array(np.ones(len(unit), np.int32)),
                                              *[c.take(pa.array(row, pa.int64())) for c in batch.columns]], names=["unit", "kind", "id", "v", "low"])


def best(scores: np.ndarray, ids: np.ndarray, k: int) -> np.ndarray:
    """Places of the ``k`` largest scores, ties to the smaller id."""
    if len(scores) > k:
        some = np.flatnonzero(scores >= np.partition(scores, len(scores) - k)[len(scores) - k])
    else:
        some = np.arange(len(scores))
    return some[np.lexsort((ids[some], -scores[some]))][:k]


def products(q: np.ndarray, x: np.ndarray) -> np.ndarray:
    """Inner products with the rows of ``x``, summed in the order of the components whatever the shape."""
    return np.cumsum(x * q, axis=1)[:, -1]


def candidates(rough: np.ndarray, k: int, slack: float) -> np.ndarray:
    """Places that may hold one of the ``k`` largest scores, if ``rough`` ones are off by less than ``slack``."""
    if len(rough) <= k:
        return np.arange(len(rough))
    return np.flatnonzero(~(rough < np.partition(rough, len(rough) - k)[len(rough) - k] - 2 * slack))


def _ranked(batches, k: int):
    """Exact products inside each unit; a task keeps the best of each query over its units, ties to the smaller ``low``."""
    unit, members, names, lows, held = None, [], [], [], {}

    def flush():
        if held:
            q = list(held)
            yield pa.RecordBatch.from_arrays([
                pa.array(q, pa.int64()), pa.array([held[i][1].tolist() for i in q], pa.list_(pa.int64())),
                pa.array([held[i][0].tolist() for i in q], pa.list_(pa.float64()))], names=["q", "ids", "scores"])
        held.clear()

    for batch in batches:
        units, kinds = batch.column(0).to_numpy(), batch.column(1).to_numpy()
        ids, v, low = batch.column(2).to_numpy(), matrix(batch.column(3)) if batch.num_rows else None, batch.column(4).to_numpy()
        cuts = np.flatnonzero(np.append(True, (units[1:] != units[:-1]) | (kinds[1:] != kinds[:-1]))) if len(units) else np.empty(0, np.int64)
        for a, b in zip(cuts.tolist(), np.append(cuts[1:], len(units)).tolist()):
            if units[a] != unit:
                unit, members, names, lows = units[a], [], [], []
            if kinds[a] == 0:
                members.append(v[a:b])
                names.append(ids[a:b])
                lows.append(low[a:b])
            elif members:
                if len(members) > 1:
                    members, names, lows = [np.concatenate(members)], [np.concatenate(names)], [np.concatenate(lows)]
                x, who, least = members[0], names[0], lows[0]
                slack = 4 * x.shape[1] * np.finfo(float).eps * np.linalg.norm(x, axis=1).max()
                for lo in range(a, b, 512):
                    some = v[lo:min(b, lo + 512)]
                    for i, q, rough in zip(ids[lo:min(b, lo + 512)].tolist(), some, some @ x.T):
                        top = candidates(rough, k, slack * np.linalg.norm(q))
                        s, w, m = products(q, x[top]), who[top], least[top]
                        top = best(s, m, k)
                        s, w, m = s[top], w[top], m[top]
                        if i in held:
                            s, w, m = (np.concatenate(pair) for pair in zip(held[i], (s, w, m)))
                            w, first = np.unique(w, return_index=True)
                            s, m = s[first], m[first]
                            top = best(s, m, k)
                            s, w, m = s[top], w[top], m[top]
                        held[i] = s, w, m
        if len(held) > 100_000:
            yield from flush()
    yield from flush()


def nearest(vectors: DataFrame, queries, k: int = 20, trees: int = 3, leaf_rows: int = 1024, recall: float = 0.96,
            most_sample: int = 8192, vec_id: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """``query_id, rank, vec_id, score``: the ``k`` nearest of every query by inner product.

    ``queries`` is a condition on ``vec_id`` that names the query rows.  The forest is fitted on at most
    ``most_sample`` distinct vectors (64 MB); every vector is indexed.  Rows that repeat an id and vector
    count once; a query never finds its own id.  Ids that are null, and vectors that are null, zero,
    not finite or of a length other than the most frequent, take no part.  Ties go to smaller ids; other
    columns are not looked at.  No usable rows give no rows.
    """
    spark = vectors.sparkSession
    rows = vectors.select(F.col(vec_id).cast("long").alias("vec_id"), F.col(vector).cast("array<double>").alias("v"))
    rows = usable(rows).withColumns({"h1": F.xxhash64("v"), "h2": F.xxhash64(F.reverse("v"), F.lit(1))})
    place = F.row_number().over(Window.partitionBy("h1", "h2").orderBy("vec_id"))
    few = rows.dropDuplicates(["vec_id", "h1", "h2"]).withColumn("place", place).filter(F.col("place") <= k + 1)
    entries = few.groupBy("h1", "h2").agg(F.first("v").alias("v"), F.array_sort(F.collect_list("vec_id")).alias("all"))
    entries = materialize(entries.withColumn("id", F.xxhash64("h1", "h2")), "vectors")  # an id may repeat with other vectors
    asked = rows.filter(queries).select("vec_id", "h1", "h2").distinct().join(entries.select("h1", "h2", "id"), ["h1", "h2"])
    asked = materialize(asked.select(F.col("vec_id").alias("query_id"), F.col("id").alias("q")), "queries")
    n, d, most = entries.agg(F.count(F.lit(1)), F.max(F.size("v")), F.max(F.aggregate("v", F.lit(0.0), lambda s, c: s + c * c))).first()
    if not n:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    sample = entries.orderBy(F.xxhash64("id"), "id").limit(max(64, min(most_sample, (64 << 20) // (8 * d)))).select("v").toArrow()
    forest = grow(matrix(sample["v"].combine_chunks()), n, most, k, trees, leaf_rows, recall)
    shared = spark.sparkContext.broadcast(forest)
    leaves = 1 << forest.depth
    blocks = spark.sparkContext.broadcast(np.full((trees, leaves), max(1, -(-2 * n // (leaves * BLOCK_ROWS)))))
    schema = "unit long, kind int, id long, v array<double>, low long"
    low = F.element_at("all", 1).alias("low")
    index = map_arrow(entries.select("id", "v", low), lambda b: _indexed(b, shared, blocks), schema)
    wanted = entries.join(asked.select(F.col("q").alias("id")).distinct(), "id", "left_semi").select("id", "v", low)
    routed = map_arrow(wanted, lambda b: _routed(b, shared, blocks), schema)
    both = index.unionByName(routed).repartition("unit").sortWithinPartitions("unit", "kind")
    found = map_arrow(both, lambda b: _ranked(b, k + 1), "q long, ids array<long>, scores array<double>")
    pairs = found.select("q", F.explode(F.arrays_zip("ids", "scores")).alias("x")).groupBy("q", "x.ids").agg(F.max("x.scores").alias("scores"))
    by_score = Window.partitionBy("q").orderBy(F.desc("scores"), "ids")
    pairs = pairs.withColumn("r", F.dense_rank().over(Window.partitionBy("q").orderBy(F.desc("scores")))).filter(F.col("r") <= k + 1).drop("r")
    named = pairs.join(entries.select(F.col("id").alias("ids"), "all"), "ids").select("q", "scores", F.explode("all").alias("ids"))
    named = named.withColumn("r", F.row_number().over(by_score)).filter(F.col("r") <= k + 1)
    lists = named.groupBy("q").agg(F.array_sort(F.collect_list(F.struct((-F.col("scores")).alias("s"), F.col("ids").alias("i")))).alias("near"))
    near = asked.join(lists, "q").select("query_id", F.slice(F.filter("near", lambda x: x["i"] != F.col("query_id")), 1, k).alias("near"))
    out = near.select("query_id", F.posexplode("near").alias("p", "x"))
    return out.select("query_id", (F.col("p") + 1).cast("int").alias("rank"), F.col("x.i").alias("vec_id"), (-F.col("x.s")).alias("score"))
