"""Events from text, XML and small fixed-layout files."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from ..functions.textcols import blank_to_null, first_filled, fmt_size, prefixed
from ..functions.timecols import filetime_to_ns, parse_iso_ts
from .timeline import to_events


def recycle_events(rec: DataFrame) -> DataFrame:
    ns = filetime_to_ns("filetime")
    return to_events(
        rec.filter(ns > 0), artifact_type="RECYCLEBIN", source="RECYCLEBIN", artifact="Recycle Bin",
        ts=ns, file_path=F.col("original_path"),
        message=F.concat(F.lit("Deleted: "), "original_path", F.lit(" ("), fmt_size("file_size"), F.lit(")")))


def task_events(tasks: DataFrame) -> DataFrame:
    """Registration event, and a trigger event when the start boundary is a second instant."""
    command, start = blank_to_null("command"), blank_to_null("trigger_start")
    action = F.coalesce(F.concat_ws(" ", command, blank_to_null("arguments")), F.lit(""))
    action = F.when(command.isNull(), "(no action)").otherwise(action)
    kind = blank_to_null(F.lower(F.regexp_replace(F.coalesce("trigger_type", F.lit("")), "(Trigger)+$", "")))
    when = F.left(start, F.lit(16))
    trigger = F.coalesce(
        F.concat(F.lit("Trigger: "), kind, F.lit(" @ "), when), prefixed("Trigger: ", kind),
        prefixed("Trigger: ", when))
    date_ns, start_ns = F.col("date_ns"), parse_iso_ts(F.coalesce("trigger_start", F.lit("")))

    head = F.concat(F.lit("Task: "), "task_name", F.lit(" | Action: "), action)
    registered = F.struct(
        F.when(date_ns != 0, date_ns).otherwise(start_ns).alias("ns"),
        F.lit("Scheduled Task").alias("artifact"),
        F.concat_ws(" | ", head, trigger, prefixed("Author: ", "author")).alias("text"))
    fires = (date_ns != 0) & start.isNotNull() & (start_ns != date_ns)
    fired = F.struct(
        F.when(fires, start_ns).otherwise(F.lit(0).cast("bigint")).alias("ns"),
        F.lit("Scheduled Task Trigger").alias("artifact"),
        F.concat(F.lit("Task Trigger: "), F.col("task_name"), F.lit(" | Action: "), action, F.lit(" | "),
                 F.coalesce(trigger, F.lit(""))).alias("text"))
    rows = tasks.select("*", F.inline(F.array(registered, fired))).filter("ns <> 0")
    return to_events(
        rows, artifact_type="TASK", source="TASK", artifact=F.col("artifact"), ts=F.col("ns"),
        file_path=F.col("task_name"), message=F.col("text"))


def wer_events(reports: DataFrame) -> DataFrame:
    """One crash event per report; the folder name stands in for a missing application."""
    ns = filetime_to_ns("event_time")
    slashed = F.translate("path", "\\", "/")
    folder = F.regexp_extract(slashed, "([^/]+)/[^/]*$", 1)
    app = first_filled("app_name", folder, F.lit("unknown"))
    return to_events(
        reports.filter(ns > 0), artifact_type="WER", source="WER", artifact="WER Crash Report", ts=ns,
        file_path=F.col("path"),
        message=F.concat_ws(" | ", F.concat(F.lit("Crash: "), app), prefixed("type=", "event_type"),
                            prefixed("ver=", "app_version")))


def pshistory_events(lines: DataFrame) -> DataFrame:
    return to_events(
        lines.filter("mtime_ns > 0"), artifact_type="PSHISTORY", source="PSHISTORY",
        artifact="PowerShell History", ts=F.col("mtime_ns"), file_path=F.col("path"),
        message=F.col("command"))
