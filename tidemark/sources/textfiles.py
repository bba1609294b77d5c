"""Text, XML and line files.

Every reader has two halves: ``read_*`` opens files, ``parse_*`` takes rows shaped like
``spark.read.format("binaryFile")`` (``path``, ``content`` and, for history files,
``modificationTime``), so the same code runs on files, tables and streams.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from ..functions.bytescols import text_by_bom
from ..functions.textcols import cp1252_text, strip
from ..functions.timecols import filetime_to_ns, parse_iso_ts, parse_text_ts
from ..functions.xmlcols import first_values
from ..session import computed_once

# Every character that ends a line in the PCA files.
LINE_BREAK = r"\r\n|[\n\r\x0B\f\x1C-\x1E\x{85}\x{2028}\x{2029}]"


def owned_by(files: DataFrame, image_id: str | None, host_id: str | None) -> DataFrame:
    """Add the image and host that the files come from, where given."""
    given = {n: F.lit(v) for n, v in (("image_id", image_id), ("host_id", host_id)) if v is not None}
    return files.withColumns(given) if given else files


def binary_files(spark: SparkSession, path: str, glob: str | None = None, image_id: str | None = None,
                 host_id: str | None = None) -> DataFrame:
    reader = spark.read.format("binaryFile").option("recursiveFileLookup", "true")
    return owned_by((reader.option("pathGlobFilter", glob) if glob else reader).load(path), image_id, host_id)


def _scanned_path() -> Column:
    """The path of a text scan's file, which the metadata escape."""
    return F.url_decode(F.replace("_metadata.file_path", F.lit("+"), F.lit("%2B")))


def byte_lines(lines: DataFrame) -> DataFrame:
    """Lines of a text scan as rows of ``path`` and ``content``, their bytes as they stand in the file."""
    return lines.select(_scanned_path().alias("path"), F.col("value").cast("binary").alias("content"))


def binary_lines(spark: SparkSession, path: str, glob: str, image_id: str | None = None, host_id: str | None = None) -> DataFrame:
    """As ``binary_files``, one row a line: a task holds one line of a file and not the file, and large files are split."""
    lines = spark.read.option("recursiveFileLookup", "true").option("pathGlobFilter", glob).text(path)
    return owned_by(byte_lines(lines), image_id, host_id)


def _keep(df: DataFrame) -> list[str]:
    return [c for c in ("host_id", "image_id", "path", "logical_path") if c in df.columns]


def _lines(df: DataFrame, text: Column, breaks: str) -> DataFrame:
    return df.select(*_keep(df), F.posexplode(F.split(text, breaks)).alias("line_no", "line"))


# ---- compatibility assistant ------------------------------------------------------------

def parse_pca_launch(files: DataFrame) -> DataFrame:
    """CP-1252 ``path|timestamp`` lines, split at the first bar; unusable lines are left out.

    A row is a whole file or a single line of one (``byte_lines``): no byte of a character ends a line, so both give the same.
    """
    keep, bar = _keep(files), F.instr("line", "|")
    with_bar = files.filter(F.contains("content", F.lit(bytearray(b"|"))))
    halves = computed_once(
        _lines(with_bar, cp1252_text("content"), LINE_BREAK).filter(bar > 0), strip(F.left("line", bar - 1)).alias("exe_path"),
        strip(F.substring("line", bar + 1, F.length("line"))).alias("_time"), keep=keep)
    return computed_once(halves, parse_text_ts("_time").alias("timestamp_ns"), keep=[*keep, "exe_path"]).filter("timestamp_ns <> 0")


def parse_pca_general(files: DataFrame) -> DataFrame:
    """UTF-16LE lines of eight bar-separated fields (at least three), a byte-order mark allowed."""
    text = F.decode("content", "UTF-16LE")
    lines = _lines(files, text, LINE_BREAK).withColumn(
        "line", F.ltrim(strip("line"), F.lit("\ufeff")))
    fields = F.split("line", r"\|")

    def field(i: int) -> Column:
        return F.coalesce(strip(F.get(fields, F.lit(i))), F.lit(""))

    return (lines.filter((F.col("line") != "") & (F.size(fields) >= 3)).select(
        *_keep(files), parse_text_ts(field(0)).alias("timestamp_ns"),
        F.coalesce(field(1).try_cast("int"), F.lit(-1)).alias("status"),
        field(2).alias("exe_path"), field(4).alias("company"), field(5).alias("version"),
        field(7).alias("exit_info")).filter("timestamp_ns <> 0"))


def read_pca_launch(spark: SparkSession, path: str, image_id: str | None = None, host_id: str | None = None) -> DataFrame:
    """Launch lists of any size as splittable lines."""
    return parse_pca_launch(binary_lines(spark, path, "[Pp]ca[Aa]pp[Ll]aunch[Dd]ic.txt", image_id, host_id))


def read_pca_general(spark: SparkSession, path: str, image_id: str | None = None, host_id: str | None = None) -> DataFrame:
    return parse_pca_general(binary_files(spark, path, "[Pp]ca[Gg]eneral[Dd]b[01].txt", image_id, host_id))


# ---- error reports ----------------------------------------------------------------------

def key_values(text: Column) -> Column:
    """``key``/``val`` of every line that holds ``=``, in line order, split at the first one, both trimmed."""
    lines = F.transform(F.split(text, r"\n"), lambda x: strip(F.ltrim(x, F.lit("\ufeff"))))
    return F.transform(F.filter(lines, lambda x: F.instr(x, "=") > 0), lambda x: F.struct(
        strip(F.substring_index(x, "=", 1)).alias("key"),
        strip(F.substring(x, F.instr(x, "=") + 1, F.length(x))).alias("val")))


def parse_wer(files: DataFrame) -> DataFrame:
    """One row per report: last event time and type, first non-empty application and version.

    Each report is read inside its row, so nothing is shuffled and streams can be parsed too.  A file without
    any ``key=value`` line gives no row.
    """
    def pick(key: str, usable: Callable[[Column], Column], place: int) -> Column:
        return F.try_element_at(F.filter("_pairs", lambda p: (p["key"] == key) & usable(p["val"])), F.lit(place))["val"]

    def any_value(_val: Column) -> Column:
        return F.lit(True)

    def filled(val: Column) -> Column:
        return val != ""

    keep = _keep(files)
    reports = files.select(*keep, key_values(text_by_bom("content")).alias("_pairs")).filter(F.size("_pairs") > 0)
    found = reports.select(
        *keep, pick("EventTime", lambda v: v.rlike(r"^\+?[0-9]{1,20}$"), -1).try_cast("decimal(20,0)").alias("_time"),
        pick("EventType", any_value, -1).alias("event_type"),
        pick("Sig[0].Value", filled, 1).alias("app_name"), pick("Sig[1].Value", filled, 1).alias("app_version"))
    return found.withColumn("event_time", F.when(filetime_to_ns("_time") > 0, F.col("_time").cast("bigint"))
                            .otherwise(F.lit(0).cast("bigint"))).drop("_time")


def read_wer(spark: SparkSession, path: str, image_id: str | None = None, host_id: str | None = None) -> DataFrame:
    return parse_wer(binary_files(spark, path, "*.wer", image_id, host_id))


# ---- scheduled tasks --------------------------------------------------------------------

_TASK_FIELDS = {
    "date": ("RegistrationInfo", "Date"),
    "author": ("RegistrationInfo", "Author"),
    "command": ("Exec", "Command"),
    "arguments": ("Exec", "Arguments"),
    "trigger_start": (None, "StartBoundary"),
}


def parse_tasks(files: DataFrame, root: str = "") -> DataFrame:
    """First filled value of each task element; ``.job`` files and dateless tasks are left out."""
    # A declared encoding no longer holds once the bytes are text.
    xml = F.regexp_replace(F.ltrim(text_by_bom("content"), F.lit("\ufeff")), r"^\s*<\?xml[^>]*\?>", "")
    name = F.substring_index("path", root.rstrip("/") + "/", -1) if root else F.ltrim("path", F.lit("/"))
    tasks = computed_once(
        files.filter(~F.col("path").endswith(".job")), *_keep(files), F.concat(F.lit("\\"), F.replace(name, F.lit("/"), F.lit("\\"))).alias("task_name"),
        first_values(xml, _TASK_FIELDS, ("trigger_type", "Trigger")).alias("_t"))
    return computed_once(
        tasks, *_keep(files), "task_name", parse_iso_ts("_t.date").alias("date_ns"), "_t.author", "_t.command",
        "_t.arguments", "_t.trigger_start", "_t.trigger_type").filter("date_ns <> 0 OR trigger_start <> ''")


def read_tasks(spark: SparkSession, path: str, image_id: str | None = None, host_id: str | None = None) -> DataFrame:
    return parse_tasks(binary_files(spark, path, None, image_id, host_id), root=path)


# ---- shell history ----------------------------------------------------------------------

def parse_pshistory(lines: DataFrame) -> DataFrame:
    """Trimmed command lines, without blanks and ``#`` comments.

    ``lines``: ``path``, ``mtime`` (TIMESTAMP) and ``value``, one row per line.
    """
    command = strip("value")
    keep = [c for c in _keep(lines)]
    return lines.filter((command != "") & ~command.startswith("#")).select(
        *keep, (F.unix_micros("mtime") * 1000).alias("mtime_ns"), command.alias("command"))


def file_lines(lines: DataFrame) -> DataFrame:
    """Lines of a text scan with the path and time of their file."""
    return lines.select(
        _scanned_path().alias("path"),
        F.col("_metadata.file_modification_time").alias("mtime"), F.make_valid_utf8("value").alias("value"))


def read_pshistory(spark: SparkSession, path: str, image_id: str | None = None, host_id: str | None = None) -> DataFrame:
    """History files as splittable text; the file time comes from the scan's metadata."""
    lines = (spark.read.option("recursiveFileLookup", "true")
             .option("pathGlobFilter", "ConsoleHost_history.txt").text(path))
    return parse_pshistory(owned_by(file_lines(lines), image_id, host_id))
