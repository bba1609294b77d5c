import json
import os
import tempfile

from pyspark.sql import functions as F

from tidemark.operators import aggregates, execution, filesystem, textual, timeline
from tidemark.plans import timeline_run
from tidemark.schema import TIMELINE_FIELDS, TIMELINE_SCHEMA
from tidemark.sources import artifacts, records, sinks, textfiles
from test_builders import FT, brief, rows


def folder(**files):
    root = tempfile.mkdtemp(prefix="spark-", dir="/tmp")
    for name, body in files.items():
        path = os.path.join(root, name.replace("__", "/"))
        os.makedirs(os.path.dirname(path), exist_ok=True)
        with open(path, "wb") as f:
            f.write(body)
    return root


def fresh():
    return os.path.join(tempfile.mkdtemp(prefix="spark-", dir="/tmp"), "out")


def test_pca(spark):
    root = folder(**{"PcaAppLaunchDic.txt": "C:\\café.exe|2024-01-02 03:04:05.678\r\nno bar\r\nx|never\r\n\r\nC:\\b|2024-01-02 03:04:05\r\n".encode("cp1252"),
                     "PcaGeneralDb0.txt": "\ufeff2024-01-02 03:04:05|2|C:\\a|d|Co|1.0|id|exit\r\n2024-01-02 03:04:06|x|C:\\b\r\nonly|two\r\n".encode("utf-16-le")})
    base = 1_704_164_645 * 10**9
    assert brief(execution.pca_launch_events(textfiles.read_pca_launch(spark, root))) == [
        (base, "Executed (GUI): C:\\b"), (base + 678_000_000, "Executed (GUI): C:\\café.exe")]
    assert brief(execution.pca_general_events(textfiles.read_pca_general(spark, root))) == [
        (base, "PCA: Status: Abnormal exit | Path: C:\\a | By: Co | v1.0 | exit"), (base + 10**9, "PCA: Status: status=-1 | Path: C:\\b")]


def test_wer(spark):
    text = f"EventType=APPCRASH\r\nEventTime={FT + 10}\r\nSig[0].Value=\r\nSig[0].Value=a=b.exe\r\nSig[0].Value=late\r\nSig[1].Value=1.0\r\n"
    root = folder(App_x__Report=b"skip", **{"App_x__r.wer": b"\xff\xfe" + text.encode("utf-16-le"), "App_y__r.wer": f"\ufeffEventTime={FT + 20}\nEventTime=zz".encode(),
                                          "App_z__r.wer": b"EventType=X"})
    assert brief(textual.wer_events(textfiles.read_wer(spark, root))) == [(1000, "Crash: a=b.exe | type=APPCRASH | ver=1.0"), (2000, "Crash: App_y")]


def test_task_files(spark):
    xml = ('<?xml version="1.0" encoding="UTF-16"?><Task xmlns="u"><RegistrationInfo><Date>2024-01-02T03:04:05</Date><Author>A&amp;B</Author></RegistrationInfo>'
           '<Triggers><LogonTrigger><StartBoundary>2024-01-03T00:00:00</StartBoundary></LogonTrigger><TimeTrigger/></Triggers>'
           '<Actions><Exec><Command>c.exe</Command><Arguments>-a</Arguments></Exec></Actions></Task>')
    root = folder(**{"sub__one": b"\xff\xfe" + xml.encode("utf-16-le"), "two": b"<Task><Triggers><BootTrigger><StartBoundary>2024-01-01T00:00", "old.job": xml.encode(),
                     "three": b"<Task><Triggers><BootTrigger><StartBoundary>2024-01-01T00:00</StartBoundary></BootTrigger><oops"})
    got = brief(textual.task_events(textfiles.read_tasks(spark, root)), "file_path", "message")
    assert got == [("\\sub\\one", "Task Trigger: \\sub\\one | Action: c.exe -a | Trigger: logon @ 2024-01-03T00:00"),
                   ("\\sub\\one", "Task: \\sub\\one | Action: c.exe -a | Trigger: logon @ 2024-01-03T00:00 | Author: A&B"),
                   ("\\three", "Task: \\three | Action: (no action) | Trigger: boot @ 2024-01-01T00:00")]


def test_history(spark):
    root = folder(u__ConsoleHost_history=b"no", **{"u__ConsoleHost_history.txt": b"dir\r\n\r\n# note\n  ls -l \ndir\n"})
    path = os.path.join(root, "u/ConsoleHost_history.txt")
    os.utime(path, (1_700_000_000, 1_700_000_000))
    got = textual.pshistory_events(textfiles.read_pshistory(spark, root))
    assert brief(got) == [(1_700_000_000 * 10**9, c) for c in ("dir", "dir", "ls -l")]


def test_artifacts(spark):
    root = folder(**{"windows__system32__winevt__logs__A.EVTX": b"12345", "Windows__Prefetch__a.pf": b"123", "Windows__Prefetch__x__b.pf": b"1", "Users__bob__NTUSER.DAT": b"1234",
                     "Users__bob__x__NTUSER.DAT": b"9", "notes.txt": b"1"})
    files = artifacts.list_files(spark, root, "img")
    jobs = artifacts.dedupe_artifacts(artifacts.classify_artifacts(files))
    assert [tuple(r) for r in jobs.select("artifact_type", "path", "size_bytes").collect()] == [
        ("EVTX", "windows/system32/winevt/logs/A.EVTX", 5), ("PREFETCH", "Windows/Prefetch", 4), ("REGISTRY", "Users/bob/NTUSER.DAT", 4), ("SHELLBAG", "Users/bob/NTUSER.DAT", 4)]
    assert brief(aggregates.artifact_summary(jobs), "artifact_type", "files") == [(t, 1) for t in ("EVTX", "PREFETCH", "REGISTRY", "SHELLBAG")]


def test_bad_rows_are_set_aside(spark):
    root = folder(**{"a.json": b'{"entry": 5, "name": "x"}\nnot json\n'})
    df = records.read_records(spark, "mft", root, "json")
    good, errors = records.isolate_errors(df, F.col(records.CORRUPT).isNull(), "MFT")
    assert [r.entry for r in good.collect()] == [5] and "not json" in errors.first().error
    assert brief(aggregates.event_counts(good.withColumn("artifact_type", F.lit("MFT")), errors), "events", "errors") == [(1, 1)]


def sample(spark):
    usn = rows(spark, "usn", *[{"parent_entry": 7, "filetime": FT + i, "reason": 1, "file_attrs": 0, "file_name": f'q"{i},x'} for i in range(50, 0, -1)])
    return timeline.union_timelines(filesystem.usn_events(usn), filesystem.mft_events(rows(spark, "mft", {"entry": 1, "name": "n", "si": [FT + 10] * 4})))


def test_parquet_table_and_view(spark):
    events, path = sample(spark), fresh()
    sinks.write_parquet(events, path)
    back = records.read_timeline(spark, path)
    assert brief(back) == brief(events)
    plan = timeline.filter_type(timeline.filter_time(back, "1970-01-01"), "MFT")._jdf.queryExecution().executedPlan().toString()
    assert "PushedFilters" in plan and "artifact_type" in plan.split("PartitionFilters")[1][:80]
    first, total = timeline_run.view(spark, path, 3, "usnjrnl", "FILE_")
    assert total == 0 and first.count() == 0
    first, total = timeline_run.view(spark, path, 3, "usnjrnl", "DATA_OVERWRITE")
    assert total == 50 and [r.timestamp_iso for r in first.collect()] == [f"1970-01-01T00:00:00.000000{i}Z" for i in (1, 2, 3)]
    sinks.write_table(events, "timeline_table", "overwrite")
    assert spark.table("timeline_table").count() == 51
    spark.sql("DROP TABLE timeline_table")


def lines(path):
    names = sorted(n for n in os.listdir(path) if n.startswith("part-"))
    return [line for n in names for line in open(os.path.join(path, n), encoding="utf-8").read().splitlines()]


def test_text_sinks(spark):
    events, stored = sample(spark), fresh()
    sinks.write_parquet(events, stored, by_type=False)
    out = fresh()
    sinks.convert(spark, stored, out, "jsonl", end="1970-01-01T00:00:00.000003", artifact_type="usnjrnl")
    got = [json.loads(x) for x in lines(out)]
    assert [list(r) for r in got] == [TIMELINE_FIELDS] * 30 and [r["timestamp_ns"] for r in got] == sorted(r["timestamp_ns"] for r in got)
    out = fresh()
    sinks.write_csv(events.filter("artifact_type = 'MFT'").coalesce(1), out)
    assert lines(out) == [",".join(TIMELINE_FIELDS), '1000,1970-01-01T00:00:00.000001Z,MACB,$MFT,$STANDARD_INFORMATION,,,n,n,false,0']
    out = fresh()
    sinks.write_timesketch(events.coalesce(1), out)
    assert lines(out)[0] == "datetime,timestamp_desc,source_short,source_long,message,message_short,hostname,filename"
    assert '"File q""50,x - DATA_OVERWRITE"' in "\n".join(lines(out))


def test_latest_n_with_copies(spark):
    df = spark.range(4000).selectExpr("'hot' AS db", "id % 3 AS t").unionByName(spark.createDataFrame([("cold", 1), ("cold", 5)], "db string, t bigint"))
    got = aggregates.latest_n(df, ["db"], "t", 1500)
    few = aggregates.latest_n(df, ["db"], "t", 5)
    assert few.groupBy("db").count().agg(F.max("count")).first()[0] <= 5
    plan = few._jdf.queryExecution().executedPlan().toString()
    assert plan.count("hashpartitioning") == 1 and "WindowGroupLimit" in plan
    assert brief(got.groupBy("db", "t").count(), "db", "t", "count") == [("cold", 1, 1), ("cold", 5, 1), ("hot", 1, 167), ("hot", 2, 1333)]


def test_counts(spark):
    events = aggregates.observe_counts(sample(spark))
    assert brief(aggregates.event_counts(events), "artifact_type", "events", "errors") == [("MFT", 1, 0), ("USNJRNL", 50, 0)]
    assert brief(aggregates.distinct_events(events.select("timestamp_ns", "file_path", "message")), "timestamp_ns")[:2] == [(100,), (200,)]


def test_whole_run(spark):
    mft = rows(spark, "mft", {"entry": 5, "name": ".", "parent": 5, "si": [FT + 10] * 4}, {"entry": 9, "name": "d", "parent": 5, "si": [FT + 10] * 4})
    tables = {
        "mft": mft, "usn": rows(spark, "usn", {"parent_entry": 9, "filetime": FT + 20, "reason": 2, "file_attrs": 0, "file_name": "f"}),
        "evtx": rows(spark, "evtx", {"filetime": FT + 30, "event_id": 1102, "level": 0, "channel": "Security", "computer": "PC9", "strings": [], "u32s": []}),
        "mft_snapshot": rows(spark, "mft_snapshot", *[{"entry": e, "name": n, "parent": p, "si": [FT + 5] * 4, "snapshot_id": s} for s in (1, 2) for e, n, p in ((5, ".", 5), (9, "d", 5), (8, "lost", 9))]),
        "registry_keys": rows(spark, "registry_keys", {"hive_id": "s", "hive_file": "SYSTEM", "rel_off": 1, "parent_rel": 0, "name": "R", "flags": 4, "last_write": FT + 40}),
        "registry_snapshot": rows(spark, "registry_snapshot", *[{"hive_id": "s", "hive_file": "SYSTEM", "rel_off": r, "parent_rel": 1, "name": n, "flags": f, "last_write": FT + 1, "snapshot_id": 1} for r, n, f in ((1, "R", 4), (2, "Gone", 0))]),
    }
    got = timeline.sort_timeline(timeline_run.build_timeline(tables, recovered_usn=tables["usn"].withColumn("recovered", F.lit(True))))
    seen = [(r.source, r.file_path, r.hostname) for r in got.collect()]
    assert ("$UsnJrnl:$J", "\\d\\f", "PC9") in seen and ("$UsnJrnl:$J", "f", "PC9") in seen
    gone = [r.message for r in got.filter("source = 'SHADOWCOPY'").collect()]
    assert sorted(gone) == ["[VSS#1] Deleted key: HKLM\\SYSTEM\\Gone", "[VSS#1] Deleted: \\d\\lost", "[VSS#2] Deleted: \\d\\lost"]


def test_merging_a_new_type_is_spread_over_tasks(spark, tmp_path):
    from tidemark.operators.timeline import normalize
    from tidemark.sources import merging
    path = f"{tmp_path}/merged"

    def of(kind, n):
        return normalize(spark.range(n).selectExpr(f"'{kind}' AS artifact_type", "1000 + id % 50 AS timestamp_ns", "concat('m', id) AS message"))

    merging.write_mergeable(of("EVTX", 100), path)
    merging.merge_timeline(of("MFT", 4000), path)
    back = merging.read_mergeable(spark, path)
    assert back.groupBy("artifact_type").count().orderBy("artifact_type").collect() == [("EVTX", 100), ("MFT", 4000)]
    sizes = [r["count"] for r in back.filter("artifact_type = 'MFT'").groupBy("_metadata.file_path").count().collect()]
    assert len(sizes) > 1 and max(sizes) < 3000


def test_packed_text_files_hold_every_row(spark, tmp_path):
    import glob
    from tidemark.operators.timeline import normalize
    from tidemark.schema import TIMELINE_SCHEMA
    from tidemark.sources import sinks
    rows = normalize(spark.range(1000).selectExpr("1000 + id AS timestamp_ns", "concat('say \"', id, '\", x') AS message"))
    sinks.write_jsonl(rows, f"{tmp_path}/j", compression="gzip")
    sinks.write_timesketch(rows, f"{tmp_path}/t", compression="gzip")
    assert glob.glob(f"{tmp_path}/j/*.json.gz") and glob.glob(f"{tmp_path}/t/*.csv.gz")
    want = {r.message for r in rows.select("message").collect()}
    assert {r.message for r in spark.read.schema(TIMELINE_SCHEMA).json(f"{tmp_path}/j").collect()} == want
    back = spark.read.option("header", True).option("escape", '"').csv(f"{tmp_path}/t")
    assert {r.message for r in back.collect()} == want and back.count() == 1000


def test_csv_gives_back_every_text(spark, tmp_path):
    """Empty text is not null; a zero character beside quotes stays; a value may hold any line break."""
    texts = [None, "", " ", '"', "\0", '"\0', '\0"', 'a"b\0c,', "a\r\nb\rc\n", "\\", '\\"', '""', "#", "x" * 3000 + '"\0"' + "y" * 3000]
    rows = spark.createDataFrame(list(enumerate(texts)), "timestamp_ns long, message string")
    kept = timeline.normalize(rows).withColumn("message_short", F.col("message"))
    sinks.write_csv(kept.repartition(3), f"{tmp_path}/c", quote_empty=True)
    back = sinks.read_csv(spark, f"{tmp_path}/c", TIMELINE_SCHEMA)
    assert sorted((r.timestamp_ns, r.message, r.message_short, r.hostname) for r in back.collect()) == [(i, t, t, "") for i, t in enumerate(texts)]


def test_csv_query_tells_empty_text_from_null(spark, tmp_path):
    import duckdb
    from tidemark.plans.oracle import ORACLE
    from tidemark.plans.queries import QUERIES
    texts = [None, "", 'said "\0"', "a,\r\nb", "plain"]
    rows = [(i, t, x) for i, (t, x) in enumerate((t, x) for t in texts for x in ("en", "", None))]
    spark.createDataFrame(rows, "doc_id long, text string, lang string").coalesce(1).write.parquet(f"{tmp_path}/documents.parquet")
    got = QUERIES["csv_round_trip"](spark, str(tmp_path))
    columns = ", ".join(sorted(got.columns))
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{tmp_path}/documents.parquet/*.parquet'")
    want = con.execute(f"SELECT {columns} FROM ({ORACLE['csv_round_trip']})").fetchall()
    assert sorted(map(repr, want)) == sorted(repr(tuple(r)) for r in got.select(*sorted(got.columns)).collect())
