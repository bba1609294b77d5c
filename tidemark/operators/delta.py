"""Deleted items: what snapshots hold and the current state lacks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from ..functions.textcols import any_of, base_name
from ..functions.timecols import as_col
from .timeline import union_timelines

# Volume areas that never count as deleted files.
SKIPPED_PREFIXES = ["\\system volume information", "\\$"]
HIVE_PREFIXES = ["HKLM", "HKCU", "HKU", "HKCR", "HKCC"]


def current_paths(events: DataFrame) -> DataFrame:
    """Distinct (host, path) of live file-table events."""
    return (events.filter((F.col("source") == "$MFT") & (F.coalesce("file_path", F.lit("")) != ""))
            .select("host_id", "file_path").distinct())


def key_identity(message) -> Column:
    """Key path inside a registry message: the last part that starts with a hive name."""
    message = F.coalesce(as_col(message), F.lit(""))
    parts = F.transform(F.split(message, r" \| "), F.trim)
    keys = F.filter(parts, lambda p: any_of([p.startswith(h) for h in HIVE_PREFIXES]))
    return F.coalesce(F.try_element_at(keys, F.lit(-1)), message)


def _key_of(events: DataFrame, from_message: bool) -> Column:
    if from_message or "extra" not in events.columns:
        return key_identity("message")
    return F.col("extra")["full_path"]


def current_keys(events: DataFrame, from_message: bool = False) -> DataFrame:
    """Distinct (host, key) of live registry events.

    The key is the stored ``full_path``; ``from_message`` takes it out of the message instead,
    for timelines whose events carry no extras.
    """
    keys = events.filter(F.col("source") == "REGISTRY").select(
        "host_id", _key_of(events, from_message).alias("key_id"))
    return keys.filter("key_id <> ''").distinct()


def _without(rows: DataFrame, current: DataFrame, keys: list[str]) -> DataFrame:
    """Rows whose ``keys`` are not among ``current``.

    A hash of the keys leads them, since hosts and paths that begin alike make a sort compare whole texts.
    """
    led = [df.withColumn("_led", F.xxhash64(*keys)) for df in (rows, current)]
    return led[0].join(led[1], ["_led", *keys], "left_anti").drop("_led")


def _tagged(rows: DataFrame, artifact: str, verb: str, shown: Column, short: Column) -> DataFrame:
    mark = F.concat(F.lit("[VSS#"), F.col("snapshot_id").cast("string"), F.lit(f"] {verb}: "))
    return (rows.withColumn("message_short", F.concat(F.lit(f"{verb}: "), short))
            .withColumn("message", F.concat(mark, shown))
            .withColumn("source", F.lit("SHADOWCOPY"))
            .withColumn("artifact", F.lit(artifact))
            .withColumn("artifact_type", F.lit("SHADOWCOPY")))


def snapshot_file_delta(snapshot: DataFrame, current: DataFrame) -> DataFrame:
    """Snapshot file events whose path is gone.

    ``snapshot``: file-table events plus ``snapshot_id`` (any number of snapshots at once);
    ``current``: (host_id, file_path) as given by ``current_paths``.
    """
    low = F.lower("file_path")
    kept = snapshot.filter((F.coalesce("file_path", F.lit("")) != "")
                           & ~any_of([low.startswith(p) for p in SKIPPED_PREFIXES]))
    gone = _without(kept, current, ["host_id", "file_path"]).select(*snapshot.columns)
    return _tagged(gone, "Deleted File (VSS)", "Deleted", F.col("file_path"), base_name("file_path"))


def snapshot_key_delta(snapshot: DataFrame, current: DataFrame, from_message: bool = False) -> DataFrame:
    """Snapshot registry events whose key is gone; ``current`` as given by ``current_keys``."""
    keyed = snapshot.withColumn("key_id", _key_of(snapshot, from_message)).filter("key_id <> ''")
    gone = _without(keyed, current, ["host_id", "key_id"]).select(*snapshot.columns, "key_id")
    return _tagged(gone, "Deleted Registry Key (VSS)", "Deleted key", F.col("message"),
                   base_name("key_id")).drop("key_id")


def multi_snapshot_delta(files: DataFrame | None, keys: DataFrame | None, current: DataFrame) -> DataFrame:
    """All snapshots against the one current timeline: one anti join per kind, not per snapshot."""
    parts = []
    if files is not None:
        parts.append(snapshot_file_delta(files, current_paths(current)))
    if keys is not None:
        parts.append(snapshot_key_delta(keys, current_keys(current)))
    return union_timelines(*parts)
