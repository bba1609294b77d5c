"""Events from execution traces: prefetch, shortcuts, jump lists, compatibility lists, inventory."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, functions as F

from ..functions.textcols import (blank_to_null, drive_type_name, first_filled, pca_status_name,
                                  prefixed)
from ..functions.timecols import filetime_to_ns
from .timeline import to_events


def prefetch_events(pf: DataFrame) -> DataFrame:
    """One event per non-zero run time."""
    exe, files = F.col("exe_name"), F.col("files")
    full = F.coalesce(
        F.try_element_at(F.filter(files, lambda f: F.upper(f).endswith(F.upper(exe))), F.lit(1)),
        F.try_element_at(files, F.lit(1)))
    runs = pf.filter(F.coalesce(exe, F.lit("")) != "").select(
        "*", first_filled(full, exe).alias("_exe_path"),
        F.explode(F.filter("run_times", lambda t: t > 0)).alias("_run"))
    return to_events(
        runs, artifact_type="PREFETCH", source="PREFETCH", artifact="Prefetch",
        ts=filetime_to_ns("_run"), file_path=F.col("_exe_path"),
        message=F.concat(exe, F.lit(" - Executed (run count: "), F.col("run_count").cast("string"), F.lit(")")),
        extra={"exe_name": exe, "exe_path": F.col("_exe_path"), "run_count": F.col("run_count"),
               "prefetch_hash": F.format_string("%08X", F.col("hash")), "version": F.col("version"),
               "modules": F.array_join("files", "|")})


def lnk_events(lnk: DataFrame) -> DataFrame:
    """Up to three events per shortcut: target born, last accessed, last modified."""
    target = first_filled("target_path", F.lit("(unknown target)"))
    serial = F.format_string("%08X", F.col("drive_serial"))
    volume = F.when(F.col("drive_serial") != 0, F.concat(
        F.lit(" ["), drive_type_name("drive_type"), F.lit(" "), serial,
        F.coalesce(prefixed("; vol:", "volume_label"), F.lit("")), F.lit("]")))
    tail = F.concat(
        target, F.coalesce(prefixed(" ", "arguments"), F.lit("")), F.coalesce(volume, F.lit("")),
        F.coalesce(prefixed("; tracked:", "machine_id"), F.lit("")))
    stages = [("B", "LNK target born: ", "created"), ("A", "LNK target last accessed: ", "accessed"),
              ("M", "LNK target last modified: ", "written")]
    cells = F.array(*[
        F.struct(filetime_to_ns(c).alias("ns"), F.lit(m).alias("macb"), F.lit(verb).alias("verb"))
        for m, verb, c in stages])
    rows = lnk.select("*", F.inline(cells)).filter("ns > 0")
    return to_events(
        rows, artifact_type="LNK", source="LNK", artifact="LNK", ts=F.col("ns"), macb=F.col("macb"),
        message=F.concat("verb", tail), file_path=F.col("target_path"),
        extra={"target_path": F.col("target_path"), "drive_type": F.col("drive_type"),
               "drive_serial": serial, "volume_label": F.col("volume_label"),
               "arguments": F.col("arguments"), "machine_id": F.col("machine_id"),
               "droid_file_id": F.col("droid_file_id")})


def jumplist_events(entries: DataFrame) -> DataFrame:
    ns = filetime_to_ns("filetime")
    rows = entries.filter((ns > 0) & blank_to_null("target_path").isNotNull())
    return to_events(
        rows, artifact_type="JUMPLIST", source="JUMPLIST", artifact="JumpList", ts=ns, macb="A",
        message=F.concat(F.lit("JumpList accessed: "), "target_path"), file_path=F.col("target_path"),
        extra={"target_path": F.col("target_path"), "destlist_version": F.col("destlist_version")})


def pca_launch_events(rec: DataFrame) -> DataFrame:
    return to_events(
        rec.filter("timestamp_ns <> 0"), artifact_type="PCASVC", source="PCASVC",
        artifact="PcaAppLaunchDic", ts=F.col("timestamp_ns"), file_path=F.col("exe_path"),
        message=F.concat(F.lit("Executed (GUI): "), "exe_path"))


def pca_general_events(rec: DataFrame) -> DataFrame:
    detail = F.concat_ws(
        " | ", F.concat(F.lit("Status: "), pca_status_name("status")), prefixed("Path: ", "exe_path"),
        prefixed("By: ", "company"), prefixed("v", "version"), blank_to_null("exit_info"))
    return to_events(
        rec.filter("timestamp_ns <> 0"), artifact_type="PCASVC", source="PCASVC",
        artifact="PcaGeneralDb", ts=F.col("timestamp_ns"), file_path=F.col("exe_path"),
        message=F.concat(F.lit("PCA: "), detail))


# ---- application inventory --------------------------------------------------------------

def _hash_suffix(c: str):
    digest = F.regexp_replace(F.coalesce(c, F.lit("")), "^0000", "")
    return F.when(digest != "", F.concat(F.lit(" SHA1="), digest)).otherwise("")


def amcache_file_events(rec: DataFrame) -> DataFrame:
    path = first_filled("lower_case_long_path", "full_path", "name", "key_name")
    ns = filetime_to_ns("last_write")
    return to_events(
        rec.filter(ns > 0), artifact_type="AMCACHE", source="AMCACHE",
        artifact="Amcache.hve InventoryApplicationFile", ts=ns, file_path=path,
        message=F.concat(path, _hash_suffix("file_id")))


def amcache_driver_events(rec: DataFrame) -> DataFrame:
    path = first_filled("image_path", "driver_name", "key_name")
    ns = filetime_to_ns("last_write")
    return to_events(
        rec.filter(ns > 0), artifact_type="AMCACHE", source="AMCACHE",
        artifact="Amcache.hve InventoryDriverBinary", ts=ns, file_path=path,
        message=F.concat_ws(" | ", path, prefixed("inf=", "inf_path"), prefixed("csum=", "checksum"),
                            prefixed("type=", "driver_type")))


def amcache_app_events(rec: DataFrame) -> DataFrame:
    ns = filetime_to_ns("last_write")
    return to_events(
        rec.filter(ns > 0), artifact_type="AMCACHE", source="AMCACHE",
        artifact="Amcache.hve InventoryApplication", ts=ns,
        message=F.concat_ws(" | ", first_filled("name", "key_name"), prefixed("pub=", "publisher"),
                            prefixed("ver=", "version"), prefixed("installed=", "install_date")))


def amcache_legacy_events(legacy: DataFrame, *modern: DataFrame) -> DataFrame:
    """Old-layout entries of hives that gave no event in any ``modern`` table.

    The modern tables are reduced to their distinct hive ids, which meet in one anti join.
    """
    hives = [t.filter(filetime_to_ns("last_write") > 0).select("hive_id") for t in modern]
    if hives:
        legacy = legacy.join(reduce(DataFrame.union, hives).distinct(), "hive_id", "left_anti")
    path = first_filled("v15", "key_name")
    own, key = filetime_to_ns("v17"), filetime_to_ns("last_write")
    ns = F.when(own > 0, own).otherwise(key)
    return to_events(
        legacy.filter(ns > 0), artifact_type="AMCACHE", source="AMCACHE", artifact="Amcache.hve Legacy",
        ts=ns, file_path=path, message=F.concat(path, _hash_suffix("v101")))
