"""Typed loads of record tables and timelines, and separation of bad rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from ..schema import RECORD_SCHEMAS
from ..session import materialize

CORRUPT = "_corrupt_record"


def read_records(spark: SparkSession, kind: str, path: str, fmt: str = "parquet", **options) -> DataFrame:
    """Open a decoded record table with its fixed schema (nothing is inferred).

    Text formats keep unparsable lines in ``_corrupt_record`` for ``isolate_errors``.
    """
    schema = RECORD_SCHEMAS[kind]
    reader = spark.read.options(**options).format(fmt)
    if fmt not in ("json", "csv"):
        return reader.schema(schema).load(path)
    rows = (reader.option("mode", "PERMISSIVE").option("columnNameOfCorruptRecord", CORRUPT)
            .schema(f"{schema}, {CORRUPT} STRING").load(path))
    # Spark refuses queries that touch the corrupt-record column alone (such as a count of errors);
    # the always-null second argument keeps another column in play.
    return rows.withColumn(CORRUPT, F.coalesce(CORRUPT, F.nullif("host_id", F.col("host_id"))))


def read_timeline(spark: SparkSession, path: str) -> DataFrame:
    """Re-open a written timeline; filters and column choice reach the scan."""
    return spark.read.parquet(path)


def _error_rows(bad: DataFrame, artifact_type: str | None, path: str | None) -> DataFrame:
    where = F.col(path) if path else F.lit(None).cast("string")
    return bad.select(F.lit(artifact_type).alias("artifact_type"), where.alias("path"),
                      F.to_json(F.struct(*bad.columns)).alias("error"))


def isolate_errors(df: DataFrame, ok: Column, artifact_type: str | None = None,
                   path: str | None = None) -> tuple[DataFrame, DataFrame]:
    """Split into usable rows and error rows (type, path, row as JSON): one bad row never stops a run.

    Lazy; each side reads the input for itself.  ``split_errors`` reads it once.
    """
    valid = F.coalesce(ok, F.lit(False))
    return df.filter(valid), _error_rows(df.filter(~valid), artifact_type, path)


def split_errors(df: DataFrame, ok: Column, artifact_type: str | None = None,
                 path: str | None = None) -> tuple[DataFrame, DataFrame]:
    """As ``isolate_errors``, in one pass over the input: rows are written once, into a folder for each side.

    Use it where the input is costly to read or to decode; ``drop_scratch`` deletes the folders.
    """
    flag = "_usable"
    written = materialize(df.withColumn(flag, F.coalesce(ok, F.lit(False))), "split", by=(flag,))
    return (written.filter(flag).select(*df.columns),
            _error_rows(written.filter(~F.col(flag)).select(*df.columns), artifact_type, path))


def tolerate_bad_files(spark: SparkSession) -> None:
    """Skip unreadable and vanished files instead of failing the job."""
    spark.conf.set("spark.sql.files.ignoreCorruptFiles", "true")
    spark.conf.set("spark.sql.files.ignoreMissingFiles", "true")
