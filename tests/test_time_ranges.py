"""Time ranges from sketches, and merging into a written timeline."""

import os
import tempfile

from pyspark.sql import functions as F

from tidemark.operators import timeline, timeranges
from tidemark.sources import merging, sinks

KEYS = ["artifact_type", "timestamp_ns", *timeline.SORT_TIES]


def events(spark, n=4000, hot=0.9):
    """Most rows at one time, half of them exact copies."""
    at = F.when(F.col("id") % 10 < int(10 * hot), 5_000).otherwise(F.col("id") * 7)
    kind = F.when(F.col("id") % 3 == 0, "EVTX").otherwise("MFT")
    rows = spark.range(0, n, 1, 4).select(at.alias("timestamp_ns"), kind.alias("artifact_type"), F.lit("S").alias("source"), F.lit("A").alias("artifact"),
                                          F.when(F.col("id") % 2 == 0, "copy").otherwise(F.concat(F.lit("row "), "id")).alias("message"))
    return timeline.normalize(rows)


def test_hot_time_is_spread_and_times_ascend(spark):
    df = events(spark)
    out = timeline.sort_timeline(df)
    parts = out.withColumn("p", F.spark_partition_id()).groupBy("p").agg(F.count("*").alias("n"), F.min("timestamp_ns").alias("a"), F.max("timestamp_ns").alias("b"))
    parts = sorted(parts.collect())
    assert sum(p.n for p in parts) == 4000 and max(p.n for p in parts) < 1.5 * 4000 / len(parts)
    assert all(x.b <= y.a for x, y in zip(parts, parts[1:]))
    times = [r[0] for r in out.select("timestamp_ns").collect()]
    assert times == sorted(times)


def test_ranges_are_even(spark):
    kind = F.when(F.col("id") % 13 < 7, "USNJRNL").when(F.col("id") % 13 < 12, "MFT").otherwise("EVTX")
    df = spark.range(0, 200_000, 1, 4).select((F.col("id") * 7919 % 200_003).alias("timestamp_ns"), kind.alias("artifact_type"))
    ranges = timeranges.time_ranges(df, "artifact_type", count=150)
    sizes = [r["count"] for r in df.groupBy(ranges.column("timestamp_ns", "artifact_type", None)).count().collect()]
    assert len(sizes) == ranges.count and max(sizes) < 1.25 * 200_000 / ranges.count


def test_ranges_grow_with_the_rows(spark, monkeypatch):
    monkeypatch.setattr(timeranges, "RANGE_ROWS", 100)
    out = timeline.sort_timeline(events(spark, hot=0.3))
    assert out.rdd.getNumPartitions() >= 40
    times = [r[0] for r in out.select("timestamp_ns").collect()]
    assert len(times) == 4000 and times == sorted(times)


def test_files_are_in_the_order_of_ties(spark):
    """One type a partition, so it is no sort key; the order inside the files stays."""
    path = os.path.join(tempfile.mkdtemp(prefix="spark-", dir="/tmp"), "t")
    sinks.write_parquet(events(spark, hot=0.3), path)
    plan = sinks._by_type_and_time(events(spark))._jdf.queryExecution().optimizedPlan().toString()
    assert "Sort [timestamp_ns" in plan
    for file in spark.read.parquet(path).inputFiles():
        rows = [(r.timestamp_ns, r.message) for r in spark.read.parquet(file).collect()]
        assert rows == sorted(rows)


def test_bisection_is_a_search(spark):
    bounds = [3, 3, 5, 9, 9, 9, 12]
    rows = spark.range(0, 15).select("id", timeranges.bisect(bounds, F.col("id"), True).alias("r"), timeranges.bisect(bounds, F.col("id"), False).alias("l")).collect()
    assert [(r.r, r.l) for r in rows] == [(sum(b <= k for b in bounds), sum(b < k for b in bounds)) for k in range(15)]
    assert spark.range(1).select(timeranges.bisect(bounds, F.lit(None).cast("long"), True)).first()[0] == 0


def test_plan_reads_each_input_once_and_samples_nothing(spark):
    plan = timeline.sort_timeline(events(spark))._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Range (0, 4000") == 1 and "rangepartitioning" not in plan
    empty = events(spark).limit(0)
    assert timeline.sort_timeline(empty).count() == 0


def test_files_of_a_type_cover_narrow_ranges(spark):
    path = os.path.join(tempfile.mkdtemp(prefix="spark-", dir="/tmp"), "t")
    sinks.write_parquet(events(spark, hot=0.0), path)
    files = spark.read.parquet(path).groupBy("artifact_type", F.input_file_name().alias("f")).agg(F.min("timestamp_ns").alias("a"), F.max("timestamp_ns").alias("b"))
    rows = sorted(files.collect(), key=lambda r: (r.artifact_type, r.a))
    assert len(rows) >= 4 and all(x.b <= y.a for x, y in zip(rows, rows[1:]) if x.artifact_type == y.artifact_type)


def test_merge_replaces_only_touched_ranges(spark):
    path = os.path.join(tempfile.mkdtemp(prefix="spark-", dir="/tmp"), "t")
    old = events(spark, hot=0.3)
    merging.write_mergeable(old, path, ranges=10)

    def files():
        return {os.path.join(d, f) for d, _, names in os.walk(path) for f in names if f.endswith(".parquet")}

    before = files()
    new = timeline.normalize(spark.createDataFrame([(27_000, "MFT", "late"), (27_001, "MFT", "late"), (1, "LNK", "another kind")], "timestamp_ns long, artifact_type string, message string"))
    assert merging.merge_timeline(new, path) == 2
    gone, added = before - files(), files() - before
    assert len({os.path.dirname(f) for f in gone}) == 1 and len({os.path.dirname(f) for f in added}) == 2
    columns = [c for c in old.columns if c != "extra"]
    got, want = merging.read_mergeable(spark, path).select(*columns), old.unionByName(new).select(*columns)
    assert got.exceptAll(want).count() == 0 and want.exceptAll(got).count() == 0
    assert merging.merge_timeline(new.limit(0), path) == 0
    assert merging.read_mergeable(spark, path).count() == 4003
