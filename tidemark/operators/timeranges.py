"""Time ranges of equal size from sketches, and rows sent straight to them.

A sketch of the times of each artifact type, taken in one pass that reads no more than time and
type, gives the bounds.  They become a literal in the plan, a row finds its range by bisection, and
``repartitionById`` sends it there, so the builders are evaluated once and nothing is sampled.
A time that fills several ranges is spread over them by a hash, so no range is larger than another.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, functions as F

ALL = "*"  # stands for the type where types are not told apart
RANGE_ROWS = 500_000  # a range is sorted by one task, whose memory should not grow with the input
SKETCH_ITEMS = 16     # items a sketch keeps for each range
SKETCH_LEAST, SKETCH_MOST = 200, 65_535


@dataclass
class TimeRanges:
    """Ascending inner bounds of each type's ranges, and the number of the first one."""

    bounds: dict[str | None, list[int]]
    first: dict[str | None, int]
    count: int

    def range_of(self, kind: str | None, time: str, spread: Column | None) -> Column:
        """Number of the range of ``time`` among those of one type; rows at a repeated bound go by ``spread``."""
        bounds = self.bounds.get(kind)
        if not bounds:
            return F.lit(self.first.get(kind, 0))
        right = bisect(bounds, F.col(time), True)
        place = right
        if spread is not None and len(set(bounds)) < len(bounds):
            left = bisect(bounds, F.col(time), False)
            place = F.when(right - left > 1, left + F.pmod(spread, right - left + 1).cast("int")).otherwise(right)
        return place + self.first[kind]

    def column(self, time: str, kind: str | None, spread: Column | None) -> Column:
        """Number of the range of each row; a type that has none goes to the first range."""
        if kind is None:
            return self.range_of(ALL, time, spread)
        out = F.lit(0)
        for name in self.bounds:
            out = F.when(F.col(kind).eqNullSafe(F.lit(name)), self.range_of(name, time, spread)).otherwise(out)
        return out


def bisect(bounds: list[int], time: Column, after_equal: bool) -> Column:
    """How many bounds are less than ``time`` (or equal to it, if ``after_equal``), in logarithmic steps; a null is before all."""
    step, steps = 1, []
    while step <= len(bounds):
        steps.append(step)
        step *= 2
    known = F.lit(bounds)

    def halve(low: Column, width: Column) -> Column:
        at = F.get(known, low + width - 1)  # null behind the last bound
        return F.when(at <= time if after_equal else at < time, low + width).otherwise(low)

    return F.aggregate(F.lit(steps[::-1]), F.lit(0), halve)


def time_ranges(df: DataFrame, kind: str | None, time: str = "timestamp_ns", count: int | None = None) -> TimeRanges:
    """About ``count`` ranges, shared among the types by their rows, one at least for each.

    Without ``count``: the session's shuffle partitions, more where these would hold over ``RANGE_ROWS`` each.  The sketch
    keeps enough items for ranges of that number, and each type's bounds are asked at its own ranks, so ranges are even.
    What reaches the driver is one sketch for each type, of a size that the events do not change.
    """
    spark = df.sparkSession
    parts = count or int(spark.conf.get("spark.sql.shuffle.partitions"))
    named = F.lit(ALL) if kind is None else F.col(kind)
    sketch = F.kll_sketch_agg_bigint(F.coalesce(time, F.lit(0)), min(SKETCH_MOST, max(SKETCH_LEAST, SKETCH_ITEMS * parts)))
    rows = df.groupBy(named.alias("kind")).agg(F.count(time).alias("n"), sketch.alias("sketch")).collect()
    rows.sort(key=lambda r: (r.kind is not None, r.kind or ""))
    total = sum(r.n for r in rows) or 1
    count = count or max(parts, -(-total // RANGE_ROWS))
    shares = [max(1, round(count * r.n / total)) for r in rows]
    asked = {i: F.kll_sketch_get_quantile_bigint(F.lit(bytes(r.sketch)), F.lit([k / share for k in range(1, share)])).alias(str(i))
             for i, (r, share) in enumerate(zip(rows, shares)) if share > 1}
    found = spark.range(1).select(*asked.values()).first() if asked else {}
    bounds, first, at = {}, {}, 0
    for i, (r, share) in enumerate(zip(rows, shares)):
        bounds[r.kind] = list(found[str(i)]) if share > 1 else []
        first[r.kind] = at
        at += share
    return TimeRanges(bounds, first, max(1, at))


def spread_by_time(df: DataFrame, keys: list[str], kind: str | None = None, time: str = "timestamp_ns") -> DataFrame:
    """Rows in the order of types and times over the partitions, each sorted by ``keys``.

    The input partition is added to the hash that spreads a hot time, so exact copies part; both are the same when a lost
    task runs again.  Rows of a hot time are in the order of ``keys`` inside each of its partitions.
    """
    ranges = time_ranges(df, kind, time)
    spread = F.shiftrightunsigned(F.xxhash64(*[k for k in keys if k != time]), 2) + F.spark_partition_id()
    placed = df.withColumn("_range", ranges.column(time, kind, spread).cast("int"))
    return placed.repartitionById(ranges.count, "_range").sortWithinPartitions(*keys).drop("_range")
