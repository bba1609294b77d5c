"""Nothing is cut or dropped: long texts, deep paths, large databases, all values, hosts of every source."""

import json
import struct

import pytest
from pyspark.sql import functions as F

from tidemark import session as sessions
from tidemark.operators import aggregates, browsing, eventlog, execution, filesystem, paths, registry, timeline
from tidemark.schema import RECORD_SCHEMAS
from tidemark.sources import binaryfiles, textfiles

FT = 116_444_736_000_000_000 + 17_000_000_000_000_000


def test_long_recycle_path(spark):
    name = "C:\\" + "d" * 900
    v2 = struct.pack("<qqqI", 2, 5, FT, len(name) + 1) + (name + "\0").encode("utf-16-le")
    v1 = struct.pack("<qqq", 1, 5, FT) + (name + "\0").encode("utf-16-le")
    rows = spark.createDataFrame([("a", bytearray(v2)), ("b", bytearray(v1))], "path string, content binary")
    assert {r.original_path for r in binaryfiles.parse_recycle_i(rows).collect()} == {name}


def test_deep_path_is_whole(spark):
    edges = spark.createDataFrame([("i", 100 + k, f"n{k}", 101 + k if k < 79 else 5) for k in range(80)],
                                  "image_id string, entry bigint, name string, parent bigint")
    got = {r.entry: r.file_path for r in paths.resolve_paths(edges).collect()}
    assert got[100] == "\\" + "\\".join(f"n{k}" for k in range(79, -1, -1))


def test_large_databases_keep_all_rows(spark):
    many = spark.range(120_000)
    visits = many.select(F.lit("h").alias("host_id"), F.lit("i").alias("image_id"), F.lit("db").alias("db_id"), F.lit("Chrome").alias("browser"),
                         F.lit(1).cast("bigint").alias("url_id"), (F.col("id") + 13_344_473_600_000_000).alias("visit_time"))
    urls = spark.createDataFrame([("h", "i", "db", 1, "u", "t")], RECORD_SCHEMAS["chromium_urls"])
    assert browsing.chromium_visit_events(visits, urls).count() == 120_000
    assert browsing.chromium_visit_events(visits, urls, limit=10).count() == 10
    places = many.select(F.lit("h").alias("host_id"), F.lit("i").alias("image_id"), F.lit("db").alias("db_id"),
                         F.lit(1).cast("bigint").alias("place_id"), (F.col("id") + 1_700_000_000_000_000).alias("visit_date"))
    assert browsing.firefox_visit_events(places, urls).count() == 120_000
    feed = many.select(F.lit("h").alias("host_id"), F.lit("i").alias("image_id"), F.lit("db").alias("db_id"), F.lit("[]").alias("app_id"),
                       F.lit(5).alias("activity_type"), (F.col("id") + 1_700_000_000).alias("start_time"), F.lit(0).cast("bigint").alias("end_time"),
                       F.lit(0).cast("bigint").alias("last_modified_time"), F.lit("{}").alias("payload"))
    assert browsing.wintimeline_events(feed).count() == 120_000


def test_all_registry_values_in_extra(spark):
    values = [(f"v{k}", 1, bytearray((f"text {k} " + "x" * 200).encode("utf-16-le")), None) for k in range(12)]
    values.append(("multi", 7, bytearray("\0".join(f"part{k}" for k in range(9)).encode("utf-16-le")), None))
    values.append(("raw", 3, bytearray(range(40)), None))
    key = ("h", "i", "hive", "SOFTWARE", 1, 0, "K", 0, FT, values)
    keys = spark.createDataFrame([key], RECORD_SCHEMAS["registry_keys"]).withColumn("full_path", F.lit("HKLM\\K"))
    event = registry.registry_events(keys).first()
    got = {v["name"]: v["text"] for v in json.loads(event.extra["values"])}
    assert len(got) == 14 and got["v11"] == "text 11 " + "x" * 200
    assert got["multi"].count("part") == 9 and got["raw"] == bytes(range(40)).hex()
    assert "+8 more" in event.message


def test_all_event_strings_and_modules_in_extra(spark):
    strings = [f"string number {k} " + "y" * 300 for k in range(9)]
    row = ("h", "i", 1, FT, 4104, 4, None, "Chan", "PC", strings, [], "f.evtx")
    record = spark.createDataFrame([row], RECORD_SCHEMAS["evtx"])
    assert json.loads(eventlog.evtx_events(record).first().extra["strings"]) == strings
    names = spark.createDataFrame([(None, 4104, "own")], "provider string, event_id int, name string")
    assert eventlog.evtx_events(record, names).count() == 1
    pf = spark.createDataFrame([("h", "i", "a.exe", [f"m{k}" for k in range(30)], 3, [FT + k for k in range(12)], 1, 30)], RECORD_SCHEMAS["prefetch"])
    events = execution.prefetch_events(pf).collect()
    assert len(events) == 12 and events[0].extra["modules"].count("|") == 29


def test_distinct_events_keep_extra(spark):
    rows = [(1, "p", "b", {"k": "b"}), (1, "p", "a", {"k": "a"}), (2, None, "c", None)]
    events = spark.createDataFrame(rows, "timestamp_ns bigint, file_path string, message string, extra map<string,string>")
    got = sorted((r.timestamp_ns, r.message, r.extra) for r in aggregates.distinct_events(events).collect())
    assert got == [(1, "a", {"k": "a"}), (2, "c", None)]


@pytest.fixture
def mixed(spark, tmp_path):
    """An event-log record, a text file and a journal page of one host."""
    (tmp_path / "PcaAppLaunchDic.txt").write_bytes(b"C:\\a.exe|2024-01-02 03:04:05\r\n")
    launches = execution.pca_launch_events(textfiles.read_pca_launch(spark, str(tmp_path), "img0", "host0"))
    name = "f.txt".encode("utf-16-le")
    record = struct.pack("<IHHQQQQIIIIHH", 60 + len(name) + 2, 2, 0, 1, 5, 0, FT, 256, 0, 0, 32, len(name), 60) + name + b"\0\0"
    page = spark.createDataFrame([("host0", "img0", 0, bytearray(record), bytearray(), bytearray())], RECORD_SCHEMAS["binary_chunks"])
    journal = filesystem.usn_events(binaryfiles.scan_usn(page))
    log = spark.createDataFrame([("host0", "img0", 1, FT, 1, 4, None, "Chan", "PC1", ["x"], [], "f.evtx")], RECORD_SCHEMAS["evtx"])
    return timeline.union_timelines(launches, journal, eventlog.evtx_events(log))


def test_hosts_reach_every_source(mixed):
    got = timeline.fill_hostname(mixed).collect()
    assert len(got) == 3 and all((r.host_id, r.image_id, r.hostname) == ("host0", "img0", "PC1") for r in got)


def test_host_lookup_does_not_move_the_timeline(spark):
    rows = [(f"host{k % 10}", "i", k, FT + k, 1, 4, None, "Chan", f"PC{k % 10}" if k < 10 else " ", ["x"], [], "f.evtx") for k in range(200)]
    events = eventlog.evtx_events(spark.createDataFrame(rows, RECORD_SCHEMAS["evtx"]))
    plan = timeline.fill_hostname(events)._jdf.queryExecution().executedPlan().toString()
    assert "BroadcastHashJoin" in plan and "hashpartitioning(host_id" not in plan


def test_scratch_folder_is_required_and_cleaned(spark, tmp_path, monkeypatch):
    class Bare:
        conf = type("C", (), {"get": staticmethod(lambda key, default=None: default)})

    monkeypatch.setattr(sessions, "_OWN_SCRATCH", [])
    with pytest.raises(ValueError):
        sessions.scratch_dir(Bare)
    sessions.use_scratch(str(tmp_path))
    assert sessions.scratch_dir(Bare) == str(tmp_path)
    monkeypatch.setattr(sessions, "_WRITTEN", [])
    table = sessions.materialize(spark.range(3), "t")
    assert table.count() == 3 and sessions.drop_scratch(spark) == 1 and sessions.drop_scratch(spark) == 0
