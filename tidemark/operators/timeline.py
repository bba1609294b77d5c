"""Whole-timeline operators: shape, union, sort, enrich, filter, preview."""

from __future__ import annotations

import logging
from datetime import datetime, timezone
from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F

from ..functions.textcols import first_filled, short80, strip
from ..functions.timecols import NS, as_col, clamp_ns, ns_to_iso
from ..schema import EVENT_FIELDS, EVENT_SCHEMA
from ..session import materialize
from .timeranges import spread_by_time

log = logging.getLogger(__name__)

SORT_TIES = ["source", "artifact", "file_path", "macb", "message"]


def _field(df: DataFrame, name: str) -> Column:
    kind = EVENT_SCHEMA[name].dataType
    return F.col(name).cast(kind) if name in df.columns else F.lit(None).cast(kind)


def normalize(df: DataFrame, drop_zero: bool = False) -> DataFrame:
    """Conform to the event schema: missing columns null, time clamped, text derived.

    ``timestamp_iso`` always follows ``timestamp_ns``; ``message_short`` defaults to the
    first 80 characters; ``drop_zero`` leaves out events without a usable time.
    """
    derived = {
        "timestamp_ns": clamp_ns(_field(df, "timestamp_ns")),
        "timestamp_iso": ns_to_iso(clamp_ns(_field(df, "timestamp_ns"))),
        "hostname": F.coalesce(_field(df, "hostname"), F.lit("")),
        "message_short": F.coalesce(_field(df, "message_short"), short80(_field(df, "message"))),
        "tz_offset_secs": F.coalesce(_field(df, "tz_offset_secs"), F.lit(0)),
        "is_fn_timestamp": F.coalesce(_field(df, "is_fn_timestamp"), F.lit(False)),
    }
    out = df.select(*[derived.get(n, _field(df, n)).alias(n) for n in EVENT_FIELDS])
    return out.filter("timestamp_ns > 0") if drop_zero else out


def to_events(
    df: DataFrame,
    *,
    artifact_type: str,
    source: str,
    artifact,
    ts: Column,
    message: Column,
    macb="M",
    file_path=None,
    hostname=None,
    is_fn=False,
    message_short=None,
    extra: dict | None = None,
) -> DataFrame:
    """Project a record DataFrame onto the event schema."""
    def value(v):
        return v if isinstance(v, Column) else F.lit(v)

    path_parts = [file_path] if file_path is not None else []
    if "logical_path" in df.columns:
        path_parts.append(F.col("logical_path"))
    columns = {
        "host_id": _field(df, "host_id"),
        "image_id": _field(df, "image_id"),
        "artifact_type": F.lit(artifact_type),
        "timestamp_ns": ts,
        "macb": value(macb),
        "source": F.lit(source),
        "artifact": value(artifact),
        "hostname": value(hostname),
        "file_path": first_filled(*path_parts) if path_parts else F.lit(None),
        "message": message,
        "message_short": value(message_short),
        "is_fn_timestamp": value(is_fn),
    }
    if extra:
        pairs = [x for k, v in extra.items() for x in (F.lit(k), v.cast("string"))]
        columns["extra"] = F.create_map(*pairs)
    return normalize(df.select(*[c.alias(n) for n, c in columns.items()]))


def fill_file_path(df: DataFrame) -> DataFrame:
    """Blank ``file_path`` falls back to target path, executable name, then logical path."""
    names = [n for n in ("file_path", "target_path", "exe_name", "logical_path") if n in df.columns]
    return df.withColumn("file_path", first_filled(*names))


def union_timelines(*dfs: DataFrame) -> DataFrame:
    """Bag union of event DataFrames."""
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), dfs)


def _sort_keys(df: DataFrame) -> list[str]:
    return ["timestamp_ns"] + [c for c in SORT_TIES + ["host_id"] if c in df.columns]


def sort_timeline(df: DataFrame) -> DataFrame:
    """Ascending by time, ties by the other keys.

    The ranges come from a sketch of the times, so the events are built once; see ``timeranges``.
    """
    return spread_by_time(df, _sort_keys(df))


def fill_hostname(df: DataFrame) -> DataFrame:
    """Blank host names take the earliest event-log host of the same ``host_id``.

    The lookup has one row per host.  It is written first, so that Spark knows its size: a small
    one is broadcast and the timeline is not moved, a large one is joined with hot hosts split.
    """
    named = df.filter((F.col("artifact_type") == "EVTX") & (strip("hostname") != ""))
    hosts = materialize(named.groupBy("host_id").agg(
        F.min(F.struct("timestamp_ns", "hostname"))["hostname"].alias("_first_host")), "hosts")
    filled = F.coalesce(F.when(strip("hostname") != "", F.col("hostname")), F.col("_first_host"), F.lit(""))
    return df.join(hosts, "host_id", "left").withColumn("hostname", filled).select(*df.columns)


def iso_to_ns(text: str) -> int:
    """ISO text to nanoseconds; a zone offset is honoured, naive text is UTC."""
    moment = datetime.fromisoformat(text)
    if moment.tzinfo is None:
        moment = moment.replace(tzinfo=timezone.utc)
    delta = moment - datetime(1970, 1, 1, tzinfo=timezone.utc)
    return (delta.days * 86_400 + delta.seconds) * NS + delta.microseconds * 1000


def time_bound(text: str | None) -> int | None:
    """Nanoseconds of a bound; none for no text, and for invalid text, which logs a warning."""
    if not text:
        return None
    try:
        return iso_to_ns(text)
    except ValueError as exc:
        log.warning("invalid timestamp ignored: %s", exc)
        return None


def filter_time(df: DataFrame, start: str | None = None, end: str | None = None) -> DataFrame:
    """Inclusive time range; invalid text logs a warning and filters nothing."""
    for text, above in ((start, True), (end, False)):
        bound = time_bound(text)
        if bound is None:
            continue
        df = df.filter(F.col("timestamp_ns") >= bound if above else F.col("timestamp_ns") <= bound)
    return df


def filter_type(df: DataFrame, artifact_type: str | None = None, artifact: str | None = None) -> DataFrame:
    """Keep one artifact type (a partition column when written by us) or one exact artifact."""
    if artifact_type:
        df = df.filter(F.col("artifact_type") == artifact_type.upper())
    return df.filter(F.col("artifact") == artifact) if artifact else df


def grep(df: DataFrame, text: str) -> DataFrame:
    """Literal, case-sensitive substring of the message."""
    return df.filter(F.col("message").contains(text))


PREVIEW_FIELDS = ["timestamp_iso", "macb", "artifact", "is_fn_timestamp", "file_path", "message"]


def preview(df: DataFrame, n: int = 50) -> DataFrame:
    """First ``n`` events in time order, six columns (top-n per partition, then merged)."""
    return df.orderBy(*_sort_keys(df)).limit(n).select(*PREVIEW_FIELDS)


def analyst_query(df: DataFrame, sql: str, view: str = "timeline") -> DataFrame:
    """Run SQL text over the timeline registered as a view."""
    df.createOrReplaceTempView(view)
    return df.sparkSession.sql(sql)


RECOVERED_ARTIFACT = "$J (Recovered)"


def tag_recovered(df: DataFrame) -> DataFrame:
    """Add ``recovered``: carved rather than read from a live file."""
    return df.withColumn("recovered", as_col("artifact") == RECOVERED_ARTIFACT)


def only_recovered(df: DataFrame) -> DataFrame:
    return tag_recovered(df).filter("recovered")
