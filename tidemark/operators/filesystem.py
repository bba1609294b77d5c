"""Events from file-table entries, the change journal and the transaction log."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from ..functions.textcols import usn_reasons
from ..functions.timecols import YEAR_2200_NS, filetime_to_ns
from .paths import resolve_paths
from .timeline import RECOVERED_ARTIFACT, to_events

# Positions in the stored arrays: created, modified, mft_modified, accessed.
_MACB = [("M", 1), ("A", 3), ("C", 2), ("B", 0)]


def _macb_cells(ns: dict[str, Column], **more: Column) -> list[Column]:
    """One struct per flag: set at the first flag of each distinct time > 0, else null."""
    cells = []
    for pos, (flag, _) in enumerate(_MACB):
        first = ns[flag] > 0
        for earlier, _ in _MACB[:pos]:
            first = first & (ns[flag] != ns[earlier])
        flags = F.concat(*[F.when(ns[f] == ns[flag], F.lit(f)).otherwise(F.lit(".")) for f, _ in _MACB])
        fields = [ns[flag].alias("ns"), flags.alias("macb"), *[v.alias(k) for k, v in more.items()]]
        cells.append(F.when(first, F.struct(*fields)))
    return cells


def macb_group(times: Column) -> Column:
    """Group four file times by equal value: array of ``(ns, macb)`` for the distinct ns > 0.

    Each distinct time is emitted at its first flag and carries every flag that shares it.
    Plain comparisons within the row: no shuffle, no aggregation.
    """
    ns = {flag: filetime_to_ns(F.get(times, F.lit(i))) for flag, i in _MACB}
    return F.array_compact(F.array(*_macb_cells(ns)))


def mft_events(mft: DataFrame, paths: DataFrame | None = None, first: bool = False) -> DataFrame:
    """One event per distinct time of the standard-information and file-name attributes.

    ``paths`` (from ``resolve_paths``) is joined before times are exploded, so that each
    entry crosses the shuffle once.  ``first`` keeps only the first event of each entry that has
    any: enough where events are asked for their paths alone.
    """
    if paths is not None:
        mft = mft.join(paths.select("image_id", "entry", "file_path"), ["image_id", "entry"], "left")
    elif "file_path" not in mft.columns:
        mft = mft.withColumn("file_path", F.lit(None).cast("string"))
    timed = mft.select(
        "host_id", "image_id", "entry", "name", "file_path",
        *[filetime_to_ns(F.get(F.col(attr), F.lit(i))).alias(f"{attr}_{flag}")
          for attr in ("si", "fn") for flag, i in _MACB])
    cells = [cell for attr in ("si", "fn")
             for cell in _macb_cells({f: F.col(f"{attr}_{f}") for f, _ in _MACB}, is_fn=F.lit(attr == "fn"))]
    if first:
        cells = [F.coalesce(*cells)]
    rows = timed.select("host_id", "image_id", "entry", "name", "file_path",
                        F.inline(F.array(*cells))).filter("ns IS NOT NULL")
    return to_events(
        rows, artifact_type="MFT", source="$MFT",
        artifact=F.when(F.col("is_fn"), "$FILE_NAME").otherwise("$STANDARD_INFORMATION"),
        ts=F.col("ns"), macb=F.col("macb"), message=F.col("name"), file_path=F.col("file_path"),
        is_fn=F.col("is_fn"), extra={"mft_entry": F.col("entry")})


def mft_events_with_paths(mft: DataFrame, root: int = 5) -> DataFrame:
    """The records meet their parent's path in the last join of the walk, so each crosses one shuffle."""
    return mft_events(resolve_paths(mft, root, carry=("host_id", "name", "si", "fn")))


DIRECTORY_ATTRIBUTE = 0x10


def usn_events(usn: DataFrame, paths: DataFrame | None = None) -> DataFrame:
    """``File|Directory name - reasons``; the parent directory path is joined when known."""
    name = F.coalesce("file_name", F.lit("<unknown>"))
    if paths is not None:
        parents = paths.select("image_id", F.col("entry").alias("parent_entry"), F.col("file_path").alias("_dir"))
        usn = usn.join(parents, ["image_id", "parent_entry"], "left")
        path = F.concat_ws("\\", "_dir", name)
    else:
        path = name
    recovered = F.coalesce("recovered", F.lit(False)) if "recovered" in usn.columns else F.lit(False)
    kind = F.when(F.col("file_attrs").bitwiseAND(F.lit(DIRECTORY_ATTRIBUTE)) != 0, "Directory").otherwise("File")
    reasons = F.when(recovered, usn_reasons("reason", ascending=True)).otherwise(usn_reasons("reason"))
    return to_events(
        usn, artifact_type="USNJRNL", source="$UsnJrnl:$J",
        artifact=F.when(recovered, RECOVERED_ARTIFACT).otherwise("$UsnJrnl"),
        ts=filetime_to_ns("filetime"), file_path=path,
        message=F.concat(kind, F.lit(" "), name, F.lit(" - "), reasons),
        extra={"reasons": reasons, "file_attributes": F.col("file_attrs")})


# Redo operations of the transaction log that carry file times.
LOGFILE_OPS = {
    0x02: "MFT Record",
    0x0C: "AddIdx-Root",
    0x0E: "AddIdx-Alloc",
    0x12: "UpdateFN-Root",
    0x13: "UpdateFN-Alloc",
}
OP_FILE_RECORD = 0x02


def logfile_events(rec: DataFrame) -> DataFrame:
    """One event per non-zero time (M, A, C, B) of the logged file names and file records."""
    is_record = F.col("redo_op") == OP_FILE_RECORD
    has_fn = F.col("fn").isNotNull()
    times = F.when(is_record & ~has_fn, F.col("si")).otherwise(F.col("fn"))
    cells = F.array(*[
        F.struct(filetime_to_ns(F.get(times, F.lit(i)), YEAR_2200_NS).alias("ns"), F.lit(flag).alias("macb"))
        for flag, i in _MACB])
    named = rec.filter(F.col("redo_op").isin(list(LOGFILE_OPS)) & (F.coalesce("fn_name", F.lit("")) != ""))
    rows = named.select("*", has_fn.alias("_from_fn"), F.inline(cells)).filter("ns > 0")
    op = F.lit(None).cast("string")
    for code, text in LOGFILE_OPS.items():
        op = F.when(F.col("redo_op") == code, F.lit(f"$LogFile {text}")).otherwise(op)
    folder = F.when((F.col("redo_op") == OP_FILE_RECORD) & F.col("is_dir"), "[DIR] ").otherwise("")
    return to_events(
        rows, artifact_type="LOGFILE", source="LOGFILE", artifact=op, ts=F.col("ns"),
        macb=F.col("macb"), message=F.concat(folder, "fn_name"), is_fn=F.col("_from_fn"),
        extra={"lsn": F.col("lsn")})


def timestomp(mft: DataFrame) -> DataFrame:
    """Entries whose standard-information times precede the file-name times.

    Both sets of times sit in one record, so this is a row-local comparison; see
    ``timestomp_events`` for a finished timeline.
    """
    def ns(column, i):
        return filetime_to_ns(F.get(F.col(column), F.lit(i)))

    rows = mft.select(
        "host_id", "image_id", "entry", "name",
        ns("si", 0).alias("si_created_ns"), ns("fn", 0).alias("fn_created_ns"),
        ns("si", 1).alias("si_modified_ns"), ns("fn", 1).alias("fn_modified_ns"))
    early_birth = (F.col("si_created_ns") > 0) & (F.col("si_created_ns") < F.col("fn_created_ns"))
    early_write = (F.col("si_modified_ns") > 0) & (F.col("si_modified_ns") < F.col("fn_modified_ns"))
    return (rows.withColumn("born_before_fn", early_birth).withColumn("written_before_fn", early_write)
            .filter("born_before_fn OR written_before_fn"))


def timestomp_events(timeline: DataFrame) -> DataFrame:
    """The creation-time check on written events: one aggregation per (image, entry)."""
    born = timeline.filter((F.col("source") == "$MFT") & F.col("macb").contains("B")).select(
        "host_id", "image_id", F.col("extra")["mft_entry"].cast("bigint").alias("entry"),
        "is_fn_timestamp", "timestamp_ns", "file_path")
    return (
        born.groupBy("host_id", "image_id", "entry").agg(
            F.min("file_path").alias("file_path"),
            F.min(F.when(~F.col("is_fn_timestamp"), F.col("timestamp_ns"))).alias("si_created_ns"),
            F.min(F.when(F.col("is_fn_timestamp"), F.col("timestamp_ns"))).alias("fn_created_ns"))
        .filter("si_created_ns < fn_created_ns"))
