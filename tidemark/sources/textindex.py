"""Substring search that opens only the files that can hold the text.

Beside a written timeline lies a table with one bitmap of three-letter sequences (hashed to ``BITS``)
for each file and 4 KiB of its bits.  A search drops the files that lack one of the text's sequences
and applies the plain test to the rest, so its result never depends on the index.
"""

from __future__ import annotations

from urllib.parse import unquote

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from ..operators.timeline import filter_type, grep
from .records import read_timeline

BITS = 1 << 18
BUCKET = 32_768  # bits of one bitmap
WINDOW = 1_000


def _index_path(path: str) -> str:
    return f"{path.rstrip('/')}_trigrams"


def trigram_rows(df: DataFrame, text: str, *keep: str) -> DataFrame:
    """Rows ``keep, place``: the places (from 1) of the three-letter sequences of a text column; none for null and shorter texts.

    Texts are cut into overlapping windows first, since finding a letter walks from the start of its string; windows of
    single-byte letters are cut as bytes, without a walk.
    """
    long_enough = df.filter(F.length(text) >= 3)
    windows = long_enough.select(*keep, text, F.explode(F.sequence(F.lit(1), F.greatest(F.length(text) - 2, F.lit(1)), F.lit(WINDOW))).alias("_at")).select(
        *keep, F.substring(F.col(text), F.col("_at"), F.lit(WINDOW + 2)).alias("_window"))
    plain = F.when(F.octet_length("_window") == F.length("_window"), F.col("_window").cast("binary")).alias("_bytes")
    starts = windows.select(*keep, "_window", plain, F.explode(F.sequence(F.lit(1), F.greatest(F.length("_window") - 2, F.lit(1)))).alias("_at"))
    three = [F.substring(F.col(c), F.col("_at"), F.lit(3)).cast("binary") for c in ("_bytes", "_window")]
    return starts.select(*keep, (F.pmod(F.xxhash64(F.coalesce(*three)), F.lit(BITS)) + 1).alias("place"))


def index_messages(spark: SparkSession, path: str, mode: str = "overwrite") -> None:
    """Write the bitmaps of all files of a timeline; one pass over the message column.

    A task's sequences of one file are made distinct before they move: at most ``BITS`` rows a file and task.  They carry a number
    for the file, its hash, which takes its name again at the end; files of one hash would share their bits, which rules out less.
    """
    whole, name = read_timeline(spark, path), F.col("_metadata.file_path")
    seen = trigram_rows(whole.select(F.xxhash64(name).alias("number"), "message"), "message", "number").distinct()
    bits = seen.groupBy("number", F.bitmap_bucket_number("place").alias("bucket")).agg(
        F.bitmap_construct_agg(F.bitmap_bit_position("place")).alias("bits"))
    names = whole.filter(F.col("_metadata.row_index") == 0).select(F.xxhash64(name).alias("number"), name.alias("file"))  # one row a file
    bitmaps = bits.join(names, "number").select("file", "bucket", "bits")
    bitmaps.write.mode(mode).parquet(_index_path(path))


def _has(bits: str, place: int) -> Column:
    byte = F.conv(F.hex(F.substring(bits, place // 8 + 1, 1)), 16, 10).cast("int")
    return byte.bitwiseAND(F.lit(1 << place % 8)) != 0


def files_with(spark: SparkSession, path: str, text: str) -> list[str] | None:
    """Files that may hold ``text``, one name each; None where the text is too short to rule any out.

    Files written after the index count as possible.
    """
    places = [r.place for r in trigram_rows(spark.range(1).select(F.lit(text).alias("text")), "text").distinct().collect()]
    if not places:
        return None
    wanted: dict[int, list[int]] = {}
    for place in places:
        wanted.setdefault(1 + (place - 1) // BUCKET, []).append((place - 1) % BUCKET)
    index = spark.read.parquet(_index_path(path))
    holds = F.lit(False)
    for bucket, bits in wanted.items():
        every = F.lit(True)
        for place in bits:
            every = every & _has("bits", place)
        holds = holds | ((F.col("bucket") == bucket) & every)
    full = index.groupBy("file").agg((F.count_if(holds) == len(wanted)).alias("full"))
    known = {r.file: r.full for r in full.collect()}
    return [f for f in read_timeline(spark, path).inputFiles() if known.get(_plain(f), known.get(f, True))]


def _plain(name: str) -> str:
    """Local names are listed with three slashes in one place and one in another."""
    return name.replace("file:///", "file:/", 1) if name.startswith("file:///") else name.replace("file:/", "file:///", 1)


def grep_timeline(spark: SparkSession, path: str, text: str, artifact_type: str | None = None) -> DataFrame:
    """Rows of a written and indexed timeline whose message holds ``text``."""
    files = files_with(spark, path, text)
    whole = read_timeline(spark, path)
    if files is None:
        rows = whole
    elif not files:
        rows = whole.filter(F.lit(False))
    else:
        rows = spark.read.schema(whole.schema).option("basePath", path).parquet(*[unquote(f) for f in files])
    return grep(filter_type(rows, artifact_type), text)
