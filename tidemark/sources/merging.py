"""A written timeline that takes in new events without being written anew.

The timeline lies in one folder for each artifact type and time range; a table of the ranges' bounds
lies beside it.  New events are sent to the ranges they fall in, only these are read, merged and
replaced, and every other file stays as it is.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from ..operators.timeline import SORT_TIES
from ..operators.timeranges import TimeRanges, time_ranges
from ..session import materialize

RANGE = "time_range"
TASK_ROWS = 1_000_000  # about how many rows a task sorts and writes at most
KEYS = ["artifact_type", RANGE, "timestamp_ns", *SORT_TIES]


def _bounds_path(path: str) -> str:
    return f"{path.rstrip('/')}_bounds"


def _placed(df: DataFrame, ranges: TimeRanges) -> DataFrame:
    """A range never shares a time with another one here, so a range's rows are found by time alone."""
    return df.withColumn(RANGE, ranges.column("timestamp_ns", "artifact_type", None).cast("int"))


def _write(df: DataFrame, path: str, mode: str, task_rows: int = TASK_ROWS) -> None:
    """A range's rows over as many tasks and files as they fill, by the row's hash and input partition; no task has two ranges."""
    counts = {r[0]: r[1] for r in df.groupBy(RANGE).count().collect()}  # one row a range
    share = 2 * sum(counts.values()) // int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    task_rows = max(1, min(task_rows, share))  # small timelines are spread too
    widths = [max(1, -(-counts.get(i, 0) // task_rows)) for i in range(max(counts, default=0) + 1)]
    firsts = [sum(widths[:i]) for i in range(len(widths))]
    salt = F.shiftrightunsigned(F.xxhash64(*SORT_TIES), 2) + F.spark_partition_id()
    place = F.get(F.lit(firsts), F.col(RANGE)) + F.pmod(salt, F.get(F.lit(widths), F.col(RANGE)))
    spread = df.withColumn("_place", place.cast("int")).repartitionById(sum(widths), "_place").drop("_place")
    (spread.sortWithinPartitions(*KEYS).write.mode(mode).option("partitionOverwriteMode", "dynamic")
     .partitionBy("artifact_type", RANGE).parquet(path))


def write_mergeable(df: DataFrame, path: str, ranges: int | None = None) -> None:
    """A new timeline of about ``ranges`` time ranges (the session's shuffle partitions), with its bounds beside it."""
    found = time_ranges(df, "artifact_type", count=ranges)
    found = TimeRanges({k: sorted(set(b)) for k, b in found.bounds.items()}, found.first, found.count)
    rows = [(k, found.first[k], b) for k, b in found.bounds.items()]
    spark = df.sparkSession
    spark.createDataFrame(rows, "artifact_type string, first int, bounds array<bigint>").coalesce(1).write.parquet(_bounds_path(path))
    _write(_placed(df, found), path, "errorifexists")


def read_bounds(spark: SparkSession, path: str) -> TimeRanges:
    rows = spark.read.parquet(_bounds_path(path)).collect()  # one row an artifact type
    return TimeRanges({r.artifact_type: list(r.bounds) for r in rows}, {r.artifact_type: r["first"] for r in rows},
                      max((r["first"] + len(r.bounds) + 1 for r in rows), default=1))


def read_mergeable(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path).drop(RANGE)


def merge_timeline(new: DataFrame, path: str) -> int:
    """Merge ``new`` events into the timeline at ``path``; gives the number of ranges replaced.

    Events of a type that the timeline has no bounds for make one range of that type.  The merged ranges are
    written to scratch before they replace the old ones, so a run that fails half-way leaves them to be merged again.
    """
    spark = new.sparkSession
    placed = materialize(_placed(new, read_bounds(spark, path)), "merge-new")
    touched = placed.select("artifact_type", RANGE).distinct()
    old = spark.read.parquet(path)
    kept = old.join(F.broadcast(touched), ["artifact_type", RANGE], "left_semi")  # one row a range; partition columns: other folders are not read
    merged = materialize(kept.unionByName(placed, allowMissingColumns=True).select(*placed.columns), "merge")
    _write(merged, path, "overwrite")
    return touched.count()
