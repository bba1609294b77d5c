"""Events from registry keys and shell bags."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from ..functions.bytescols import reg_value_text
from ..functions.textcols import base_name, blank_to_null, looks_like_hex, rot13, strip
from ..functions.timecols import filetime_to_ns
from .paths import registry_paths, shellbag_paths
from .timeline import to_events


def value_pairs(values) -> Column:
    """``(name, text)`` of each stored value; unnamed values read ``(default)``."""
    def pair(v):
        name = F.coalesce(blank_to_null(v["name"]), F.lit("(default)"))
        text = F.coalesce(v["text"], reg_value_text(v["type"], v["raw"]), F.lit(""))
        return F.struct(name.alias("name"), text.alias("text"))

    return F.coalesce(F.transform(values, pair), F.array().cast("array<struct<name:string,text:string>>"))


def whole_values(values) -> Column:
    """All values of a key, uncut, as JSON objects in one array."""
    def pair(v):
        return F.struct(F.coalesce(blank_to_null(v["name"]), F.lit("(default)")).alias("name"),
                        F.coalesce(v["text"], reg_value_text(v["type"], v["raw"], whole=True), F.lit("")).alias("text"))

    return F.coalesce(F.to_json(F.transform(values, pair)), F.lit("[]"))


_LIST_MARKS = ["mrulist", "mrulistex", "(default)"]


def _names_or(items: Column, prefix: str, fallback: Column) -> Column:
    """First five items joined by ``; ``, or the fallback when there is none."""
    return F.when(F.size(items) > 0, F.concat(F.lit(prefix), F.array_join(F.slice(items, 1, 5), "; "))).otherwise(fallback)


def registry_plugins(path: Column, key_name: Column, values: Column, upper: Column | None = None) -> Column:
    """``struct(artifact, message)`` for keys of known meaning, else null; first rule wins.

    ``upper``: the upper-case path, when it is already a column.
    """
    upper = F.upper(path) if upper is None else upper

    def first(n):
        return F.slice(values, 1, n)

    def texts(pairs):
        return F.transform(pairs, lambda v: v["text"])

    def result(artifact, message):
        return F.struct(F.lit(artifact).alias("artifact"), message.alias("message"))

    def autorun(title):
        items = F.array_join(F.transform(first(6), lambda v: F.concat(
            v["name"], F.lit("="), F.left(v["text"], F.lit(70)))), "; ")
        return result("Persistence", F.when(
            F.size(values) > 0, F.concat(F.lit(f"{title} | "), items, F.lit(" | "), path)
        ).otherwise(F.concat(F.lit(f"{title}: "), path)))

    def recent(title):
        told = texts(F.filter(first(10), lambda v: ~F.lower(v["name"]).isin(_LIST_MARKS)
                              & (v["text"] != "") & ~looks_like_hex(v["text"])))
        return result("MRU", _names_or(told, f"{title}: ", F.concat(F.lit(f"{title}: "), key_name, F.lit(" | "), path)))

    named = F.filter(first(10), lambda v: v["name"] != "(default)")
    assisted = F.transform(named, lambda v: base_name(rot13(v["name"])))
    bam_named = F.filter(first(8), lambda v: v["name"] != "(default)")
    bam_paths = F.transform(F.filter(bam_named, lambda v: v["text"].contains("\\")), lambda v: base_name(v["text"]))
    bam = F.when(F.size(bam_paths) > 0, bam_paths).otherwise(F.transform(bam_named, lambda v: v["name"]))
    office = F.transform(F.filter(first(10), lambda v: v["name"].startswith("Item ")),
                         lambda v: strip(F.substring_index(v["text"], "]", -1)))
    office = F.transform(F.filter(office, lambda p: p != ""), base_name)

    return (
        F.when(upper.endswith("\\CURRENTVERSION\\RUN"), autorun("AutoRun"))
        .when(upper.endswith("\\CURRENTVERSION\\RUNONCE"), autorun("AutoRunOnce"))
        .when(upper.endswith("\\CURRENTVERSION\\RUNSERVICES"), autorun("AutoRunServices"))
        .when(upper.contains("\\USERASSIST\\") & upper.endswith("\\COUNT"), result("Execution", _names_or(
            assisted, "UserAssist: ", F.concat(F.lit("UserAssist Count: "), path))))
        .when(upper.contains("\\BAM\\") & upper.contains("\\USERSETTINGS\\"), result("BAM", _names_or(
            bam, "BAM last run: ", F.concat(F.lit("BAM UserSettings: "), path))))
        .when(upper.endswith("\\APPCOMPATCACHE"), result("ShimCache", F.concat(F.lit("ShimCache: "), path)))
        .when(upper.contains("\\RECENTDOCS"), recent("RecentDocs"))
        .when(upper.contains("\\OPENSAVEPIDLMRU"), result("MRU", F.concat(
            F.lit("OpenSave MRU: "), key_name, F.lit(" | "), path)))
        .when(upper.contains("\\OPENSAVEFILENAME") | upper.contains("\\OPENSAVEMRU"), recent("OpenSave MRU"))
        .when(upper.contains("\\LASTVISITEDPIDLMRU") | upper.contains("\\LASTVISITEDMRU"), recent("LastVisited MRU"))
        .when(upper.contains("\\OFFICE\\") & (upper.endswith("\\FILE MRU") | upper.endswith("\\PLACE MRU")),
              result("MRU", _names_or(office, "Office MRU: ", F.concat(F.lit("Office MRU: "), path))))
        .when(upper.contains("\\BAGMRU"), result("ShellBag", F.concat(F.lit("ShellBag: "), path)))
    )


SHOWN_VALUES = 6


def default_message(path: Column, values: Column) -> Column:
    """``path | n=v, … (six), +k more``."""
    shown = F.array_join(F.transform(F.slice(values, 1, SHOWN_VALUES), lambda v: F.concat(
        v["name"], F.lit("="), v["text"])), ", ")
    more = F.when(F.size(values) > SHOWN_VALUES, F.concat(
        F.lit(", +"), (F.size(values) - SHOWN_VALUES).cast("string"), F.lit(" more"))).otherwise("")
    return F.when(F.size(values) > 0, F.concat(path, F.lit(" | "), shown, more)).otherwise(path)


def registry_events(keys: DataFrame, paths: DataFrame | None = None) -> DataFrame:
    """One event per key with a write time; ``paths`` as given by ``registry_paths``."""
    if "full_path" not in keys.columns:
        if paths is None:
            records = [c for c in ("host_id", "image_id", "name", "last_write", "values", "logical_path") if c in keys.columns]
            keys = registry_paths(keys, carry=tuple(records))
        else:
            keys = keys.join(paths.select("hive_id", "rel_off", "full_path"), ["hive_id", "rel_off"])
    ns = filetime_to_ns("last_write")
    rows = keys.filter(ns > 0).withColumns({
        "full_path": F.coalesce("full_path", F.lit("")), "_upper": F.upper("full_path"),
        "_pairs": value_pairs(F.col("values"))})
    rows = rows.withColumn("_rule", registry_plugins(
        F.col("full_path"), F.col("name"), F.col("_pairs"), F.col("_upper")))
    return to_events(
        rows, artifact_type="REGISTRY", source="REGISTRY", ts=ns,
        artifact=F.coalesce(F.col("_rule")["artifact"], F.lit("Registry Key")),
        message=F.coalesce(F.col("_rule")["message"], default_message(F.col("full_path"), F.col("_pairs"))),
        extra={"full_path": F.col("full_path"), "values": whole_values(F.col("values"))})


def shellbag_events(nodes: DataFrame, items: DataFrame) -> DataFrame:
    """One event per distinct (hive, time, folder path) below the bag root."""
    paths = shellbag_paths(nodes, items)
    ns = filetime_to_ns("last_write")
    rows = (nodes.join(paths, ["hive_id", "node"]).filter(ns > 0)
            .withColumn("_ns", ns).dropDuplicates(["hive_id", "_ns", "path"]))
    return to_events(
        rows, artifact_type="SHELLBAG", source="SHELLBAG", artifact="ShellBag", ts=F.col("_ns"),
        file_path=F.col("path"), message=F.concat(F.lit("ShellBag: "), "path"))
