from pyspark.sql import functions as F

from tidemark.operators import browsing, delta, eventlog, execution, filesystem, registry, textual, timeline, usage
from tidemark.schema import RECORD_SCHEMAS

FT = 116_444_736_000_000_000


def rows(spark, kind, *records):
    """Record table from dicts; missing fields are null."""
    df = spark.createDataFrame([], RECORD_SCHEMAS[kind])
    full = [tuple({"host_id": "h", "image_id": "i", **r}.get(c) for c in df.columns) for r in records]
    return spark.createDataFrame(full, df.schema)


def brief(df, *columns):
    return sorted(tuple(r) for r in df.select(*(columns or ("timestamp_ns", "message"))).collect())


def test_mft_grouping_and_timestomp(spark):
    mft = rows(spark, "mft", {"entry": 9, "name": "a", "parent": 5, "si": [FT + 10, FT + 10, FT + 20, 0], "fn": [FT + 30, FT + 10, None, 5]},
               {"entry": 10, "name": "b", "parent": 5})
    got = brief(filesystem.mft_events(mft), "timestamp_ns", "macb", "is_fn_timestamp")
    assert got == [(1000, "M...", True), (1000, "M..B", False), (2000, "..C.", False), (3000, "...B", True)]
    assert [r.entry for r in filesystem.timestomp(mft).collect()] == [9]
    events = filesystem.mft_events(mft)
    assert brief(filesystem.timestomp_events(events), "entry", "si_created_ns", "fn_created_ns") == [(9, 1000, 3000)]


def test_first_event_of_each_entry_has_every_path(spark):
    times = [None, [0, 0, 0, 0], [None, FT + 1, None, None], [FT + 10, FT + 10, FT + 20, 0], [FT + 5] * 4, [5, None, 0, FT + 7]]
    mft = rows(spark, "mft", *[{"entry": i * 6 + j, "name": "n", "si": si, "fn": fn} for i, si in enumerate(times) for j, fn in enumerate(times)])
    mft = mft.withColumn("file_path", F.format_string("p%d", F.col("entry").bitwiseAND(F.lit(~1))))
    every, first = filesystem.mft_events(mft), filesystem.mft_events(mft, first=True)
    assert first.columns == every.columns and first.drop("extra").exceptAll(every.drop("extra")).isEmpty()
    entries = [r.entry for r in first.select(F.col("extra")["mft_entry"].alias("entry")).collect()]
    assert sorted(entries) == sorted({r.entry for r in every.select(F.col("extra")["mft_entry"].alias("entry")).collect()})
    assert len(entries) < mft.count() and len(entries) < every.count()
    first, every = (brief(delta.current_paths(e), "host_id", "file_path") for e in (first, every))
    assert first == every


def test_macb_conserves_flags(spark):
    mft = spark.range(625).select(F.lit("h").alias("host_id"), F.lit("i").alias("image_id"), F.col("id").alias("entry"), F.lit("n").alias("name"),
                                  F.array(*[(F.lit(FT - 1) + F.floor(F.col("id") / 5**k) % 5).cast("bigint") for k in range(4)]).alias("si"),
                                  F.lit(None).cast("array<bigint>").alias("fn"))
    want = {}
    for r in mft.collect():
        for flag, i in (("M", 1), ("A", 3), ("C", 2), ("B", 0)):
            if r.si[i] > FT:
                want.setdefault((r.entry, (r.si[i] - FT) * 100), set()).add(flag)
    got = {(int(r.extra["mft_entry"]), r.timestamp_ns): set(r.macb) - {"."} for r in filesystem.mft_events(mft).collect()}
    assert got == want


def test_usn(spark):
    usn = rows(spark, "usn", {"parent_entry": 7, "filetime": FT + 10, "reason": 0x100, "file_attrs": 0x10, "file_name": "d"},
               {"parent_entry": 8, "filetime": 0, "reason": 0, "file_attrs": 0, "recovered": True})
    paths = spark.createDataFrame([("i", 7, "\\top")], "image_id string, entry bigint, file_path string")
    got = brief(filesystem.usn_events(usn, paths), "timestamp_ns", "artifact", "file_path", "message")
    assert got == [(0, "$J (Recovered)", "<unknown>", "File <unknown> - 0x00000000"), (1000, "$UsnJrnl", "\\top\\d", "Directory d - FILE_CREATE")]


def test_logfile(spark):
    log = rows(spark, "logfile", {"redo_op": 2, "is_dir": True, "fn_name": "n", "si": [FT + 1, FT + 2, 0, FT + 4]},
               {"redo_op": 0x13, "fn_name": "m", "fn": [FT + 1, 0, 0, 0]}, {"redo_op": 3, "fn_name": "x", "fn": [FT + 1] * 4},
               {"redo_op": 0x0C, "fn_name": "far", "fn": [FT + 10**17] * 4})
    assert brief(filesystem.logfile_events(log), "timestamp_ns", "macb", "artifact", "message", "is_fn_timestamp") == [
        (100, "B", "$LogFile MFT Record", "[DIR] n", False), (100, "B", "$LogFile UpdateFN-Alloc", "m", True),
        (200, "M", "$LogFile MFT Record", "[DIR] n", False), (400, "A", "$LogFile MFT Record", "[DIR] n", False)]


def test_evtx_messages(spark):
    rec = rows(spark, "evtx",
               {"filetime": FT + 10, "event_id": 4624, "level": 0, "channel": "Security", "computer": "DC1",
                "strings": ["SYSTEM", "S-1-5-18", "alice", "alice", "10.0.0.1"], "u32s": [99, 3]},
               {"filetime": FT + 20, "event_id": 4634, "level": 2, "channel": "", "file_name": "Foo%4Bar.evtx", "strings": ["bob", "WS-GATE01"], "u32s": [2]},
               {"filetime": FT + 30, "event_id": 4104, "level": 3, "channel": "PS", "strings": ["C:\\x\\run.PS1\"", "z" * 30], "u32s": []},
               {"filetime": FT + 40, "event_id": 4104, "level": 4, "channel": "PS", "strings": ["y" * 170, "Level"], "u32s": []},
               {"filetime": FT + 50, "event_id": 9, "level": 1, "channel": "http://a", "file_name": "Z.EVTX", "strings": ["12", "{g}"], "u32s": []},
               {"filetime": FT + 60, "event_id": 4625, "level": 0, "channel": "Security", "strings": ["-"], "u32s": [10]})
    got = [r.message for r in eventlog.evtx_events(rec).orderBy("timestamp_ns").collect()]
    assert got == [
        "EventID 4624 - Successful Logon [Security] - Type 3 (Network) | Account: alice",
        "EventID 4634 [ERROR] - Logoff [Foo/Bar] - Account: bob | Target: WS-GATE01",
        "EventID 4104 [WARNING] - PowerShell Script Block Logged [PS] - Script: C:\\x\\run.PS1\"",
        "EventID 4104 - PowerShell Script Block Logged [PS] - " + "y" * 160 + "...",
        "EventID 9 [CRITICAL] [Z]",
        "EventID 4625 - Failed Logon [Security] - Type 10 (RemoteInteractive)"]
    hosts = [r.hostname for r in eventlog.evtx_events(rec).orderBy("timestamp_ns").collect()]
    assert hosts == ["DC1", "WS-GATE01", "", "", "", ""]


def test_evtx_provider_names_and_hosts(spark, one):
    rec = rows(spark, "evtx", {"filetime": FT + 1, "event_id": 12, "level": 0, "channel": "c", "strings": [], "u32s": []}).withColumn("provider", F.lit("P"))
    own = spark.createDataFrame([("P", 12, "Own")], "provider string, event_id int, name string")
    assert [r.message for r in eventlog.evtx_events(rec, own).collect()] == ["EventID 12 - Own [c]"]
    def host(*s):
        return eventlog.evtx_hostname(F.array(*[F.lit(x) for x in s]))
    assert one(host("KB123456", "SERVER01"), host("server-x", "DESKTOP-AB1"), host("DEAD-BEEF"), host("A-B-C-D-XYZ"), host("WORKGROUP", "ABCDE1")) == [
        "SERVER01", "DESKTOP-AB1", "", "", ""]


def test_execution(spark):
    pf = rows(spark, "prefetch", {"exe_name": "A.EXE", "files": ["\\l.dll", "\\b\\a.exe"], "run_count": 3, "run_times": [FT + 10, 0, FT + 20], "hash": 255, "version": 30},
              {"exe_name": "B.EXE", "files": [], "run_count": 1, "run_times": [FT + 30]})
    assert brief(execution.prefetch_events(pf), "timestamp_ns", "file_path", "message") == [
        (1000, "\\b\\a.exe", "A.EXE - Executed (run count: 3)"), (2000, "\\b\\a.exe", "A.EXE - Executed (run count: 3)"),
        (3000, "B.EXE", "B.EXE - Executed (run count: 1)")]
    lnk = rows(spark, "lnk", {"target_path": "C:\\t", "volume_label": "V", "arguments": "-q", "machine_id": "m", "drive_type": 3, "drive_serial": 255, "created": FT + 10, "accessed": 0, "written": FT + 20},
               {"target_path": "", "drive_serial": 0, "created": 0, "accessed": FT + 30, "written": 0})
    assert brief(execution.lnk_events(lnk), "timestamp_ns", "macb", "message") == [
        (1000, "B", "LNK target born: C:\\t -q [Fixed 000000FF; vol:V]; tracked:m"),
        (2000, "M", "LNK target last modified: C:\\t -q [Fixed 000000FF; vol:V]; tracked:m"),
        (3000, "A", "LNK target last accessed: (unknown target)")]


def test_amcache(spark):
    new = rows(spark, "amcache_file", {"hive_id": "a", "key_name": "k", "full_path": "C:\\f", "file_id": "0000abc", "last_write": FT + 10},
               {"hive_id": "c", "key_name": "k", "last_write": 0})
    old = rows(spark, "amcache_legacy", {"hive_id": "a", "key_name": "x", "last_write": FT + 5}, {"hive_id": "b", "key_name": "y", "v17": FT + 20, "last_write": FT + 5},
               {"hive_id": "c", "key_name": "z", "v15": "p", "v101": "0000ff", "v17": 0, "last_write": FT + 30})
    assert brief(execution.amcache_file_events(new)) == [(1000, "C:\\f SHA1=abc")]
    assert brief(execution.amcache_legacy_events(old, new)) == [(2000, "y"), (3000, "p SHA1=ff")]


def test_srum(spark):
    ids = rows(spark, "srum_idmap", {"db_id": "d", "id_index": 1, "id_type": 1, "id_text": "!!app.exe!2020!x"},
               {"db_id": "d", "id_index": 2, "id_type": 3, "id_blob": bytes([1, 1, 0, 0, 0, 0, 0, 5]) + (18).to_bytes(4, "little")})
    net = rows(spark, "srum_net", {"db_id": "d", "ts_ole": 25570.0, "app_id": 1, "user_id": 2, "bytes_sent": 4096, "bytes_recvd": 131072},
               {"db_id": "d", "ts_ole": 0.0, "app_id": 1}, {"db_id": "d", "ts_long": FT + 10, "app_id": 9, "user_id": 8, "bytes_sent": 0})
    day = 86_400 * 10**9
    assert brief(usage.srum_net_events(net, ids)) == [
        (1000, "App: 9  |  User: 8"), (day, "App: app.exe  |  User: SYSTEM  |  sent=4,096B  |  recv=131,072B")]
    app = rows(spark, "srum_app", {"db_id": "d", "ts_ole": 25570.0, "fg_cycles": 1234, "bg_read": 5, "fg_read": 0})
    assert brief(usage.srum_app_events(app, ids)) == [(day, "App: Unknown  |  fg_cycles=1,234  bg_read=5B")]
    conn = rows(spark, "srum_conn", {"db_id": "d", "connect_start": FT + 10, "app_id": 1, "profile_name": "home", "connected_secs": 60, "interface_type": 71})
    assert brief(usage.srum_conn_events(conn, ids)) == [(1000, "App: app.exe  |  Network: home  |  WiFi  |  duration=60s")]


def test_srum_ids_of_two_kinds_with_one_number(spark):
    sid = bytes([1, 1, 0, 0, 0, 0, 0, 5]) + (18).to_bytes(4, "little")
    ids = rows(spark, "srum_idmap", *[{"db_id": "d", **e} for e in (
        {"id_index": 1, "id_type": 0, "id_text": "zz.exe"}, {"id_index": 1, "id_type": 3, "id_blob": sid},
        {"id_index": 2, "id_type": 0, "id_text": ""}, {"id_index": 2, "id_type": 3, "id_blob": sid},
        {"id_index": 3, "id_type": 0, "id_text": "a.exe"}, {"id_index": 3, "id_type": 3, "id_blob": b"\1"},
        {"id_index": 4, "id_type": None, "id_text": "svc"}, {"id_index": 5, "id_type": 3, "id_blob": sid})])
    net = rows(spark, "srum_net", *[{"db_id": "d", "ts_long": FT + 10 * i, "app_id": i, "user_id": i} for i in range(1, 6)])
    assert [m for _, m in brief(usage.srum_net_events(net, ids))] == [
        "App: zz.exe  |  User: SYSTEM", "App: 2  |  User: SYSTEM", "App: a.exe  |  User: 3", "App: svc  |  User: svc", "App: S-1-5-18  |  User: SYSTEM"]


def test_browsing(spark):
    e = 11_644_473_600_000_000
    visits = rows(spark, "chromium_visits", *[{"db_id": d, "browser": "Edge", "url_id": 1 + i % 2, "visit_time": e + i} for d in ("a", "b") for i in range(1, 6)],
                  {"db_id": "a", "browser": "Edge", "url_id": 1, "visit_time": 0}, {"db_id": "a", "browser": "Edge", "url_id": 77, "visit_time": e + 9})
    urls = rows(spark, "chromium_urls", *[{"db_id": d, "id": i, "url": f"u{i}", "title": t} for d in ("a", "b") for i, t in ((1, "T"), (2, "u2"))])
    got = brief(browsing.chromium_visit_events(visits, urls, limit=3))
    assert got == sorted([(n * 1000, f"Browser Visit: u{1 + n % 2}" + (' - "T"' if n % 2 == 0 else "") + " [Edge]") for n in (3, 4, 5)] * 2)
    down = rows(spark, "chromium_downloads", {"browser": "Chrome", "start_time": e + 1, "target_path": "C:\\d\\f.zip", "tab_url": "u", "received_bytes": 0, "total_bytes": 1500},
                {"browser": "Chrome", "start_time": e + 2, "target_path": "", "tab_url": "v"})
    assert brief(browsing.chromium_download_events(down), "timestamp_ns", "file_path", "message") == [
        (1000, "C:\\d\\f.zip", "Browser Download: f.zip from u [Chrome] (1,500 bytes)"), (2000, "v", "Browser Download: unknown from v [Chrome]")]
    act = rows(spark, "activity", {"db_id": "x.db", "app_id": "[]", "activity_type": 5, "start_time": 7, "last_modified_time": 9, "payload": '{"displayText":"doc"}'},
               {"db_id": "x.db", "activity_type": 3, "start_time": 0, "last_modified_time": 8}, {"db_id": "x.db", "start_time": 0, "last_modified_time": 0})
    assert brief(browsing.wintimeline_events(act), "timestamp_ns", "file_path", "message") == [
        (7 * 10**9, "doc", "Timeline: App Focus | doc"), (8 * 10**9, "x.db", "Timeline: Type3")]


def test_registry_rules(spark):
    values = [("Item 1", 1, None, "[F0][T1]C:\\d\\a.docx"), ("", 1, None, "x" * 75), ("b", 4, b"\x05\0\0\0", None)]
    keys = rows(spark, "registry_keys", *[{"hive_id": "h", "rel_off": i, "name": "n", "flags": 0, "last_write": FT + 10 + i, "values": v} for i, v in enumerate(
        [values, values, values * 3, None])]).withColumn("full_path", F.element_at(F.array(*[F.lit(p) for p in (
            "HKCU\\X\\CurrentVersion\\Run", "HKCU\\Office\\16\\File MRU", "HKLM\\SYSTEM\\K", "HKLM\\Q\\AppCompatCache")]), (F.col("rel_off") + 1).cast("int")))
    got = [(r.artifact, r.message) for r in registry.registry_events(keys).orderBy("timestamp_ns").collect()]
    shown = "Item 1=[F0][T1]C:\\d\\a.docx"
    assert got == [
        ("Persistence", f"AutoRun | {shown}; (default)={'x' * 70}; b=5 | HKCU\\X\\CurrentVersion\\Run"), ("MRU", "Office MRU: a.docx"),
        ("Registry Key", f"HKLM\\SYSTEM\\K | {shown}, (default)={'x' * 75}, b=5, {shown}, (default)={'x' * 75}, b=5, +3 more"),
        ("ShimCache", "ShimCache: HKLM\\Q\\AppCompatCache")]


def test_tasks(spark):
    tasks = rows(spark, "tasks", {"task_name": "\\t", "date_ns": 5, "author": "me", "command": "c", "arguments": "-x", "trigger_start": "1970-01-01T00:00:01", "trigger_type": "LogonTrigger"},
                 {"task_name": "\\u", "date_ns": 0, "trigger_start": "1970-01-01T00:00:02"}, {"task_name": "\\v", "date_ns": 0, "trigger_start": "soon"})
    assert brief(textual.task_events(tasks), "timestamp_ns", "artifact", "message") == [
        (5, "Scheduled Task", "Task: \\t | Action: c -x | Trigger: logon @ 1970-01-01T00:00 | Author: me"),
        (10**9, "Scheduled Task Trigger", "Task Trigger: \\t | Action: c -x | Trigger: logon @ 1970-01-01T00:00"),
        (2 * 10**9, "Scheduled Task", "Task: \\u | Action: (no action) | Trigger: 1970-01-01T00:00")]


def test_delta(spark):
    live = rows(spark, "mft", {"entry": 1, "name": "keep", "si": [FT + 10] * 4})
    live = filesystem.mft_events(live.withColumn("file_path", F.lit("\\keep")))
    snap = rows(spark, "mft", *[{"entry": i, "name": "n", "si": [FT + 10] * 4} for i in range(4)]).withColumn(
        "file_path", F.element_at(F.array(*[F.lit(p) for p in ("\\keep", "\\d\\gone", "\\$Extend\\x", "\\System Volume Information\\y")]), (F.col("entry") + 1).cast("int")))
    snaps = filesystem.mft_events(snap)
    two = snaps.withColumn("snapshot_id", F.lit(1)).unionByName(snaps.withColumn("snapshot_id", F.lit(2)))
    assert brief(delta.multi_snapshot_delta(two, None, live), "snapshot_id", "source", "message", "message_short") == [
        (i, "SHADOWCOPY", f"[VSS#{i}] Deleted: \\d\\gone", "Deleted: gone") for i in (1, 2)]


def test_key_identity(one):
    texts = ["AutoRun | a=b | HKCU\\X\\Run", "HKLM\\A | v=1, w=2", "UserAssist: x", "HKLM\\A"]
    assert one(*[delta.key_identity(F.lit(t)) for t in texts]) == ["HKCU\\X\\Run", "HKLM\\A", "UserAssist: x", "HKLM\\A"]


def test_normalize_fill_and_filters(spark):
    df = spark.createDataFrame([("h", "EVTX", -5, "", "m" * 90), ("h", "EVTX", 7, "PC", "x"), ("h", "MFT", 3, None, "y"), ("g", "MFT", 4, " ", "z")],
                               "host_id string, artifact_type string, timestamp_ns bigint, hostname string, message string")
    events = timeline.normalize(df)
    assert brief(events, "timestamp_ns", "hostname", "message_short")[0] == (0, "", "m" * 80)
    assert brief(timeline.fill_hostname(events), "timestamp_ns", "hostname") == [(0, "PC"), (3, "PC"), (4, ""), (7, "PC")]
    assert timeline.normalize(df, drop_zero=True).count() == 3
    assert timeline.iso_to_ns("1970-01-01T02:00:01.5+02:00") == 1_500_000_000
    assert timeline.filter_time(events, "1970-01-01", "bad").count() == 4
    assert timeline.filter_time(events, None, "1970-01-01T00:00:00").count() == 1
    assert [r.timestamp_ns for r in timeline.sort_timeline(events).collect()] == [0, 3, 4, 7]
    assert timeline.union_timelines(events, events, df).count() == 12
