"""Helpers shared by the operators of this subpackage."""

from __future__ import annotations

import ctypes
import gc
import os
import sys
import tempfile
import zipfile
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F

from ..session import configure


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One of the given tables, with the session set up."""
    configure(spark).conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "2000")  # texts make large rows
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(16 << 20))
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def map_arrow(df: DataFrame, run: Callable, schema, owner: str = "") -> DataFrame:
    """``mapInArrow`` on executors that may have no copy of this package: Spark sends them one."""
    context = df.sparkSession.sparkContext
    if not getattr(context, "_tidemark_sent", False):
        top = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
        path = os.path.join(tempfile.mkdtemp(), "tidemark_package.zip")
        with zipfile.ZipFile(path, "w") as out:
            for folder, _, names in os.walk(top):
                for name in names:
                    if name.endswith(".py"):
                        full = os.path.join(folder, name)
                        out.write(full, os.path.relpath(full, os.path.dirname(top)))
        context.addPyFile(path)
        context._tidemark_sent = True
    owner = owner or run.__module__

    def owned(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        claim(owner)
        try:
            yield from run(batches)
        finally:
            give_back()

    return df.mapInArrow(owned, schema)


_OWNER = [""]


def claim(owner: str) -> None:
    """A worker process serves several operators in turn: only the one at work keeps its caches."""
    if _OWNER[0] != owner:
        for name, module in list(sys.modules.items()):
            if name.startswith(f"{__package__}.") and name != owner and hasattr(module, "drop_caches"):
                module.drop_caches()
        _OWNER[0] = owner
        gc.collect()
        give_back()


_TRIM = getattr(ctypes.CDLL(None), "malloc_trim", None)  # of the GNU library alone


def give_back() -> None:
    """What is free in this process goes back to the system: a waiting worker's memory counts for its executor too."""
    pa.default_memory_pool().release_unused()
    if _TRIM is not None:
        _TRIM(0)


def map_batches(df: DataFrame, schema: str, per_batch: Callable[..., dict], *extra) -> DataFrame:
    """``per_batch(columns, *extra)`` for every Arrow batch; ``columns`` and its result map names to lists or arrays."""
    from pyspark.sql.types import StructType
    from pyspark.sql.pandas.types import to_arrow_schema
    arrow = to_arrow_schema(StructType.fromDDL(schema))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                out = per_batch({n: batch.column(i) for i, n in enumerate(batch.schema.names)}, *extra)
                yield pa.RecordBatch.from_arrays([as_arrow(out[f.name], f.type) for f in arrow], schema=arrow)

    return map_arrow(df, run, schema, per_batch.__module__)


def as_arrow(values, kind: pa.DataType) -> pa.Array:
    return values.cast(kind) if isinstance(values, pa.Array) else pa.array(values, type=kind)


def texts(column: pa.Array) -> list[str]:
    """Texts of one batch; a null is an empty text."""
    return [t or "" for t in column.to_pylist()]


def row_bytes(column: pa.Array) -> list[bytes]:
    """UTF-8 bytes of every text of one batch; a null is an empty text."""
    return [b or b"" for b in column.cast(pa.binary()).to_pylist()]


def mix(x: np.ndarray) -> np.ndarray:
    """Finalizer over unsigned 64-bit numbers (a bijection)."""
    x = x ^ (x >> np.uint64(31))
    x = x * np.uint64(0x9E3779B97F4A7C15)
    x = x ^ (x >> np.uint64(29))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    return x ^ (x >> np.uint64(32))


def signed(x: np.ndarray) -> np.ndarray:
    return x.view(np.int64)


def id_and_text(docs: DataFrame, doc_id: str, text: str) -> DataFrame:
    """The two columns an operator needs, under fixed names, so that other columns cannot clash."""
    return docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).cast("string").alias("text"))
