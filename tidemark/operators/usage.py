"""Events from resource-usage tables, with ids resolved through the id map."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from ..functions.bytescols import sid_from_bytes
from ..functions.textcols import blank_to_null, iface_name, prefixed, resolve_sid, thousands
from ..functions.timecols import filetime_to_ns, srum_time_to_ns
from ..session import materialize
from .timeline import to_events

SID_ENTRY = 3


def id_display(idmap: DataFrame) -> DataFrame:
    """Two display texts per (db_id, id_index): as an ``app`` (the third ``!`` part of ``!!…``), as a ``user`` (a decoded SID).

    Ids are told apart by their kind: an app takes a SID entry, and a user another one, only where the map has no
    entry of its own kind for the number, not where that entry is blank.
    """
    text = F.col("id_text")
    parts = F.split(text, "!")
    marked = F.coalesce(F.get(parts, F.lit(2)), F.ltrim(text, F.lit("!")))
    plain = F.when(text.startswith("!!"), marked).otherwise(text)
    is_sid = F.coalesce(F.col("id_type"), F.lit(0)) == SID_ENTRY
    shown = blank_to_null(F.when(is_sid, sid_from_bytes("id_blob")).otherwise(plain))
    entries = idmap.select("db_id", "id_index", is_sid.alias("is_sid"), shown.alias("display"))

    def text_of(own: Column, other: Column) -> Column:
        return F.when(F.count_if(own) > 0, F.max(F.when(own, F.col("display")))).otherwise(F.max(F.when(other, F.col("display"))))

    sid, named = F.col("is_sid"), ~F.col("is_sid")
    both = entries.groupBy("db_id", "id_index").agg(text_of(named, sid).alias("app"), text_of(sid, named).alias("user"))
    return both.filter(F.col("app").isNotNull() | F.col("user").isNotNull())


def srum_ids(usage: DataFrame, idmap: DataFrame) -> DataFrame:
    """Add ``app_name`` and ``user_name``.

    The map has one row per id; it is written once and joined twice without a hint: a small map is broadcast
    by its measured size, a large one is hash-joined with hot ids split by the adaptive planner.
    """
    shown = materialize(id_display(idmap), "srum-ids")
    apps = shown.select("db_id", F.col("id_index").alias("app_id"), F.col("app").alias("_app"))
    users = shown.select("db_id", F.col("id_index").alias("user_id"), F.col("user").alias("_user"))
    joined = usage.join(apps, ["db_id", "app_id"], "left").join(users, ["db_id", "user_id"], "left")
    app = F.coalesce("_app", F.col("app_id").cast("string"), F.lit("Unknown"))
    user = F.coalesce(resolve_sid(F.coalesce("_user", F.col("user_id").cast("string"))), F.lit(""))
    return joined.withColumn("app_name", app).withColumn("user_name", user).drop("_app", "_user")


def _metric(name: str, c: str, unit: str) -> Column:
    return F.when(F.col(c) != 0, F.concat(F.lit(f"{name}="), thousands(c), F.lit(unit)))


def _usage_events(rows: DataFrame, artifact: str, ts: Column, *parts: Column) -> DataFrame:
    message = F.concat_ws("  |  ", F.concat(F.lit("App: "), "app_name"), prefixed("User: ", "user_name"), *parts)
    return to_events(rows.filter(ts > 0), artifact_type="SRUM", source="SRUM", artifact=artifact,
                     ts=ts, file_path=F.col("app_name"), message=message)


def srum_app_events(usage: DataFrame, idmap: DataFrame) -> DataFrame:
    metrics = F.concat_ws(
        "  ", _metric("fg_cycles", "fg_cycles", ""), _metric("bg_cycles", "bg_cycles", ""),
        _metric("fg_read", "fg_read", "B"), _metric("bg_read", "bg_read", "B"),
        _metric("fg_write", "fg_write", "B"), _metric("bg_write", "bg_write", "B"))
    return _usage_events(srum_ids(usage, idmap), "SRUM AppTimeline",
                         srum_time_to_ns("ts_ole", "ts_long"), blank_to_null(metrics))


def srum_net_events(usage: DataFrame, idmap: DataFrame) -> DataFrame:
    return _usage_events(srum_ids(usage, idmap), "SRUM Network", srum_time_to_ns("ts_ole", "ts_long"),
                         _metric("sent", "bytes_sent", "B"), _metric("recv", "bytes_recvd", "B"))


def srum_conn_events(usage: DataFrame, idmap: DataFrame) -> DataFrame:
    started = filetime_to_ns("connect_start")
    ts = F.when(started > 0, started).otherwise(srum_time_to_ns("ts_ole", "ts_long"))
    lasted = F.when(F.col("connected_secs") != 0, F.concat(
        F.lit("duration="), F.col("connected_secs").cast("string"), F.lit("s")))
    return _usage_events(srum_ids(usage, idmap), "SRUM NetworkConn", ts,
                         prefixed("Network: ", "profile_name"), iface_name("interface_type"), lasted)
