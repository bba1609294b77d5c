"""Counts, distinct, and newest-n per group."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, functions as F

MIB = 1 << 20


def artifact_summary(jobs: DataFrame) -> DataFrame:
    """Files and size in MiB (one decimal) per artifact type."""
    return (jobs.groupBy("artifact_type")
            .agg(F.count("*").alias("files"), F.sum("size_bytes").alias("size_bytes"))
            .withColumn("size_mb", F.round(F.col("size_bytes") / MIB, 1))
            .orderBy("artifact_type"))


def event_counts(events: DataFrame, errors: DataFrame | None = None) -> DataFrame:
    """Events per artifact type, with the count of failed inputs when given."""
    counts = events.groupBy("artifact_type").agg(F.count("*").alias("events"))
    if errors is None:
        return counts.withColumn("errors", F.lit(0).cast("bigint"))
    failed = errors.groupBy("artifact_type").agg(F.count("*").alias("errors"))
    return counts.join(failed, "artifact_type", "full").select(
        "artifact_type", F.coalesce("events", F.lit(0)).alias("events"),
        F.coalesce("errors", F.lit(0)).alias("errors"))


def run_summary(jobs: DataFrame, events: DataFrame, errors: DataFrame | None = None) -> DataFrame:
    """Files found, files done, events and errors of each artifact type, and of the whole run (``TOTAL``).

    ``jobs``: ``artifact_type, path``; ``errors``: ``artifact_type, path`` as given by ``isolate_errors``.
    A file with an error counts as not done.
    """
    errors = jobs.select("artifact_type", "path").limit(0) if errors is None else errors

    def part(rows: DataFrame, name: str, count) -> DataFrame:
        return rows.groupBy("artifact_type").agg(count.alias("n")).select("artifact_type", F.lit(name).alias("what"), "n")

    long = (part(jobs, "files", F.count_distinct("path")).unionByName(part(events, "events", F.count(F.lit(1))))
            .unionByName(part(errors, "errors", F.count(F.lit(1)))).unionByName(part(errors, "failed", F.count_distinct("path"))))

    def total(what: str):
        return F.coalesce(F.sum(F.when(F.col("what") == what, F.col("n"))), F.lit(0))

    rows = long.rollup("artifact_type").agg(
        total("files").alias("files"), total("failed").alias("failed"), total("events").alias("events"), total("errors").alias("errors"))
    return rows.select(F.coalesce("artifact_type", F.lit("TOTAL")).alias("artifact_type"), "files",
                       (F.col("files") - F.col("failed")).alias("files_done"), "events", "errors")


def errors_by_file(errors: DataFrame) -> DataFrame:
    """Errors of each file."""
    return errors.groupBy("artifact_type", "path").agg(F.count(F.lit(1)).alias("errors"))


def observe_counts(events: DataFrame, name: str = "timeline") -> DataFrame:
    """Attach live totals (rows, rows without a time) to any action on ``events``."""
    return events.observe(name, F.count(F.lit(1)).alias("events"),
                          F.count_if(F.col("timestamp_ns") == 0).alias("without_time"))


def source_baseline(events: DataFrame) -> DataFrame:
    return events.groupBy("source").agg(F.count("*").alias("events"))


def distinct_events(events: DataFrame, keys: tuple[str, ...] = ("timestamp_ns", "file_path")) -> DataFrame:
    """One row per key; of equal keys the smallest message is kept, so the result is stable."""
    maps = [c for c, kind in events.dtypes if kind.startswith("map")]  # not comparable: they travel beside the order
    others = sorted((c for c in events.columns if c not in (*keys, *maps)), key=lambda c: c != "message")
    rows = events.groupBy(*keys).agg(
        F.min(F.struct(*others)).alias("_row"), *[F.min_by(c, F.struct(*others)).alias(c) for c in maps])
    return rows.select(*[F.col(c) if c in (*keys, *maps) else F.col("_row")[c].alias(c) for c in events.columns])


def latest_n(df: DataFrame, by: list[str], order: str, n: int, ties: list[str] = (), spread: int = 64) -> DataFrame:
    """The ``n`` newest rows per group, whole even when one group holds most rows.

    Spark keeps at most ``n`` rows of a group in each input task before its one exchange, up to the session's
    ``windowGroupLimitThreshold``.  For a larger ``n`` a first step takes the newest of each of ``spread`` slices of a group; the
    slice mixes the row hash with the input partition, so exact copies spread too, and stays the same when a lost task runs again.
    """
    newest = [F.col(order).desc_nulls_last(), *[F.col(c).asc_nulls_last() for c in ties], F.col("_hash")]
    rows = df.withColumn("_hash", F.xxhash64(*df.columns))

    def first(rows: DataFrame, keys: list[str]) -> DataFrame:
        return rows.withColumn("_rank", F.row_number().over(Window.partitionBy(*keys).orderBy(*newest))).filter(F.col("_rank") <= n)

    if n > int(df.sparkSession.conf.get("spark.sql.optimizer.windowGroupLimitThreshold")):
        rows = rows.withColumn("_slice", F.pmod(F.shiftright("_hash", 2) + F.spark_partition_id(), F.lit(spread)))
        rows = first(rows, [*by, "_slice"]).drop("_slice")
    return first(rows, by).drop("_hash", "_rank")


def delta_counts(delta: DataFrame) -> DataFrame:
    """Deleted files and keys per snapshot."""
    is_file = F.col("artifact") == "Deleted File (VSS)"
    return delta.groupBy("snapshot_id").agg(
        F.count("*").alias("events"), F.count_if(is_file).alias("files"), F.count_if(~is_file).alias("keys"))
