"""Write timelines: Parquet, JSON Lines, CSV, review CSV, catalog table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.types import StructType

from ..functions.textcols import macb_desc
from ..operators.timeline import SORT_TIES, filter_time, filter_type, sort_timeline, time_bound
from ..operators.timeranges import spread_by_time
from ..schema import TIMELINE_FIELDS
from .ordered import read_in_order
from .records import read_timeline


def _by_type_and_time(df: DataFrame) -> DataFrame:
    """Each file covers one narrow time range of one type; hot times and copies are spread over files.

    A partition holds one type.  Where tasks write their few types side by side (see ``configure``) the type is no sort key,
    so that most comparisons end at the time; elsewhere Spark would sort by the type once more.
    """
    side_by_side = int(df.sparkSession.conf.get("spark.sql.maxConcurrentOutputFileWriters")) > 0
    return spread_by_time(df, ([] if side_by_side else ["artifact_type"]) + ["timestamp_ns", *SORT_TIES], "artifact_type")


# Row groups carry a filter of their paths, no larger than the paths need, so that one path is found without reading the rest.
PATH_FILTER = {"parquet.bloom.filter.enabled#file_path": "true", "parquet.bloom.filter.adaptive.enabled": "true"}


def write_parquet(df: DataFrame, path: str, by_type: bool = True, sort: bool = True, mode: str = "errorifexists") -> None:
    """Snappy Parquet: the eleven columns and ours, one folder per artifact type by default."""
    if by_type:
        out = _by_type_and_time(df) if sort else df
        out.write.mode(mode).options(**PATH_FILTER).partitionBy("artifact_type").parquet(path)
    else:
        (sort_timeline(df) if sort else df).write.mode(mode).options(**PATH_FILTER).parquet(path)


# A packed text file is read by one task, so it takes no more rows than this.
PACKED_ROWS = 1_000_000


def _packing(compression: str | None) -> dict[str, str]:
    return {"compression": compression, "zlib.compress.level": "BEST_SPEED", "maxRecordsPerFile": str(PACKED_ROWS)} if compression else {}


def write_jsonl(df: DataFrame, path: str, mode: str = "errorifexists", compression: str | None = None) -> None:
    """One object per line in schema order, nulls kept; ``compression``: such as gzip, which takes about a tenth of the space."""
    df.select(*TIMELINE_FIELDS).write.mode(mode).options(**_packing(compression)).option("ignoreNullFields", "false").json(path)


def write_csv(df: DataFrame, path: str, fields: list[str] | None = None, mode: str = "errorifexists", compression: str | None = None,
              quote_empty: bool = False) -> None:
    """Header and eleven columns; quotes doubled, null as an empty field; ``compression`` as in ``write_jsonl``.

    An empty text is an empty field too, unless ``quote_empty`` writes it as two quotes, which ``read_csv`` tells from null.
    """
    (df.select(*(fields or TIMELINE_FIELDS)).write.mode(mode).options(**_packing(compression))
     .option("header", True).option("escape", '"').option("emptyValue", '""' if quote_empty else "")
     .option("ignoreLeadingWhiteSpace", False).option("ignoreTrailingWhiteSpace", False).csv(path))


def read_csv(spark: SparkSession, path: str, schema: StructType | None = None) -> DataFrame:
    """What ``write_csv`` wrote; without ``schema`` every column is text.

    Only an empty field is null.  The second escape is the quote itself: left out, it is the zero character, and the
    reader would drop that one from texts that hold quotes.
    """
    reader = spark.read.option("header", True).option("escape", '"').option("multiLine", True)
    reader = reader.option("nullValue", None).option("charToEscapeQuoteEscaping", '"')
    return (reader.schema(schema) if schema else reader).csv(path)


def timesketch_view(df: DataFrame, strict_ref: bool = False) -> DataFrame:
    """The eight columns of the review tool; null reads as empty."""
    def text(c):
        return F.coalesce(c, F.lit(""))

    return df.select(
        text("timestamp_iso").alias("datetime"),
        macb_desc(F.coalesce("macb", F.lit("")), "artifact", strict_ref).alias("timestamp_desc"),
        F.left(text("artifact"), F.lit(6)).alias("source_short"), text("artifact").alias("source_long"),
        text("message").alias("message"), text("message_short").alias("message_short"),
        text("hostname").alias("hostname"), text("file_path").alias("filename"))


def write_timesketch(df: DataFrame, path: str, mode: str = "errorifexists", compression: str | None = None) -> None:
    view = timesketch_view(df)
    write_csv(view, path, view.columns, mode, compression)


def write_table(df: DataFrame, name: str, mode: str = "errorifexists") -> None:
    """Catalog table, one partition per artifact type, time-sorted inside each file."""
    _by_type_and_time(df).write.mode(mode).options(**PATH_FILTER).partitionBy("artifact_type").format("parquet").saveAsTable(name)


def convert(spark: SparkSession, source: str, target: str, fmt: str = "csv", start: str | None = None,
            end: str | None = None, artifact_type: str | None = None, mode: str = "errorifexists") -> None:
    """Re-open a written timeline, filter it, and write CSV or JSON Lines in time order.

    The files of a sorted timeline are read in order; any other one is sorted.
    """
    rows = read_in_order(spark, source, time_bound(start), time_bound(end), artifact_type)
    if rows is None:
        rows = sort_timeline(filter_type(filter_time(read_timeline(spark, source), start, end), artifact_type))
    {"csv": write_csv, "jsonl": write_jsonl}[fmt](rows, target, mode=mode)
