"""Session settings and scratch space.

``configure`` sets the SQL settings the library relies on.  ``materialize`` cuts a
long lineage by writing a table into the shared folder named by ``spark.checkpoint.dir``,
so that lost executors never force a whole iterative plan to run again.
"""

from __future__ import annotations

import uuid
from collections.abc import Sequence

from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

_OWN_SCRATCH: list[str] = []
_WRITTEN: list[str] = []


def configure(spark: SparkSession) -> SparkSession:
    """Pin UTC, lossy text decoding (bad UTF-16 becomes U+FFFD) and bounded Arrow batches."""
    spark.conf.set("spark.sql.session.timeZone", "UTC")
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(64 << 20))
    spark.conf.set("spark.sql.legacy.codingErrorAction", "true")
    spark.conf.set("spark.sql.codegen.hugeMethodLimit", "8000")  # what the JVM compiles; larger methods would be interpreted
    spark.conf.set("spark.sql.maxConcurrentOutputFileWriters", "32")  # a task of few folders writes them side by side and sorts nothing for it
    _ship_helpers()
    return spark


def _ship_helpers() -> None:
    """Send the few Python helpers with their tasks, so executors need no copy of this package."""
    from .sources import binaryfiles, ordered, textfiles
    for module in (binaryfiles, ordered, textfiles):
        cloudpickle.register_pickle_by_value(module)


def use_scratch(path: str) -> None:
    """Name a shared folder for sessions that do not set ``spark.checkpoint.dir`` themselves (tests, benches)."""
    _OWN_SCRATCH[:] = [path]


def scratch_dir(spark: SparkSession) -> str:
    """Shared scratch folder: ``spark.checkpoint.dir``, else the one given to ``use_scratch``."""
    shared = spark.conf.get("spark.checkpoint.dir", None) or (_OWN_SCRATCH[0] if _OWN_SCRATCH else None)
    if not shared:
        raise ValueError("set spark.checkpoint.dir to a folder that every executor can reach")
    return shared.rstrip("/")


def scratch_path(spark: SparkSession, label: str) -> str:
    """A fresh path below the scratch folder."""
    return f"{scratch_dir(spark)}/tidemark/{label}-{uuid.uuid4().hex}"


def computed_once(df: DataFrame, *columns: Column | str, keep: Sequence[str] = ()) -> DataFrame:
    """``select`` for costly columns that later filters ask for.

    A filter is moved below a plain ``select`` together with one copy of the column's expression for each place
    that names it; it is not moved below a generator, here of a single row.  Columns of ``keep`` are passed by it, so
    that they are still left out where nothing asks for them.
    """
    return df.select(*keep, F.inline(F.array(F.struct(*columns))))


def materialize(df: DataFrame, label: str, by: tuple[str, ...] = ()) -> DataFrame:
    """Write ``df`` as a scratch table, in folders of the columns ``by`` if any, and return the re-opened table."""
    spark = df.sparkSession
    path = scratch_path(spark, label)
    df.write.mode("overwrite").partitionBy(*by).parquet(path)
    _WRITTEN.append(path)
    return spark.read.schema(df.schema).parquet(path)


def drop_scratch(spark: SparkSession) -> int:
    """Delete the scratch tables that ``materialize`` wrote, once no DataFrame needs them; gives their number.

    The caller owns them: call this after the final write of a run.
    """
    files = spark.sparkContext._jvm.org.apache.hadoop.fs
    for path in _WRITTEN:
        where = files.Path(path)
        where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)
    count = len(_WRITTEN)
    _WRITTEN.clear()
    return count
