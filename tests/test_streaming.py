import glob
import os
import tempfile

from tidemark.operators import aggregates, execution, filesystem, textual
from tidemark.plans import records_from_tables as R
from tidemark.sources import binaryfiles, textfiles
from tidemark.streaming import ingest
from test_builders import FT, brief, rows


def test_stream_matches_batch_and_resumes(spark):
    root = tempfile.mkdtemp(prefix="spark-", dir="/tmp")
    inbox, out, mark, counts = (os.path.join(root, n) for n in ("in", "out", "mark", "counts"))
    first = rows(spark, "usn", *[{"parent_entry": 7, "filetime": FT + i, "reason": 1, "file_attrs": 0, "file_name": f"f{i}"} for i in range(20)])
    second = rows(spark, "usn", {"parent_entry": 7, "filetime": FT + 99, "reason": 1, "file_attrs": 0, "file_name": "new"})
    first.repartition(3).write.parquet(inbox)

    def run():
        stream = ingest.read_record_stream(spark, inbox, "usn", files_per_batch=1)
        ingest.stream_ingest(stream, filesystem.usn_events, out, mark).awaitTermination()
        return brief(spark.read.parquet(out))

    assert run() == brief(filesystem.usn_events(first))
    second.write.mode("append").parquet(inbox)
    assert run() == brief(filesystem.usn_events(first.unionByName(second)))
    assert run() == brief(filesystem.usn_events(first.unionByName(second)))
    stream = ingest.read_record_stream(spark, inbox, "usn")
    ingest.stream_counts(filesystem.usn_events(stream), counts, os.path.join(root, "mark2")).awaitTermination()
    assert brief(ingest.read_counts(spark, counts), "artifact_type", "events") == [("USNJRNL", 21)]


def test_each_path_is_written_once(spark):
    root = tempfile.mkdtemp(prefix="spark-", dir="/tmp")
    inbox, out, mark = (os.path.join(root, n) for n in ("in", "out", "mark"))
    kept = spark.conf.get("spark.sql.streaming.stateStore.providerClass")
    schema = "host_id string, file_path string, source string"
    try:
        for batch in (["a", "b", "a", None, ""], ["b", "c"], ["a", "c", "d"]):
            spark.createDataFrame([("h", p, "$MFT") for p in batch], schema).write.mode("append").parquet(inbox)
            stream = ingest.read_record_stream(spark, inbox, schema=schema)
            ingest.stream_delta_sets(stream, out, mark).awaitTermination()
        assert brief(ingest.read_current_paths(spark, out), "host_id", "file_path") == [("h", p) for p in "abcd"]
        ingest.compact_delta_sets(spark, out, os.path.join(root, "small"))
        assert ingest.read_current_paths(spark, os.path.join(root, "small")).count() == 4
    finally:
        spark.conf.set("spark.sql.streaming.stateStore.providerClass", kept)


def test_a_batch_commits_one_state_part_a_core(spark):
    root = tempfile.mkdtemp(prefix="spark-", dir="/tmp")
    inbox, out, mark, counts = (os.path.join(root, n) for n in ("in", "out", "mark", "counts"))
    changed = ("spark.sql.streaming.stateStore.providerClass", "spark.sql.shuffle.partitions")
    kept = {key: spark.conf.get(key) for key in changed}
    schema = "host_id string, file_path string, source string, artifact_type string"
    stream = lambda: ingest.read_record_stream(spark, inbox, schema=schema)
    parts = lambda q: q.awaitTermination() or q.lastProgress["stateOperators"][0]["numShufflePartitions"]
    cores = spark.sparkContext.defaultParallelism
    try:
        spark.conf.set("spark.sql.shuffle.partitions", 40)
        for batch, given in (("abca", None), ("acd", 3)):  # the checkpoint keeps the number it began with
            spark.createDataFrame([("h", p, "$MFT", "MFT") for p in batch], schema).write.mode("append").parquet(inbox)
            assert parts(ingest.stream_delta_sets(stream(), out, mark, given)) == cores < 40
            assert spark.conf.get("spark.sql.shuffle.partitions") == "40"
        assert brief(ingest.read_current_paths(spark, out), "host_id", "file_path") == [("h", p) for p in "abcd"]
        assert parts(ingest.stream_delta_sets(stream(), out + "3", mark + "3", 3)) == 3
        assert parts(ingest.stream_counts(stream(), counts, mark + "_counts")) == cores
        assert brief(ingest.read_counts(spark, counts), "artifact_type", "events") == [("MFT", 7)]
        spark.conf.set("spark.sql.shuffle.partitions", 2)
        assert parts(ingest.stream_delta_sets(stream(), out + "2", mark + "2")) == 2
    finally:
        for key, value in kept.items():
            spark.conf.set(key, value)


def test_listener_totals_and_changed_counts(spark):
    root = tempfile.mkdtemp(prefix="spark-", dir="/tmp")
    inbox, out, mark = (os.path.join(root, n) for n in ("in", "out", "mark"))
    schema = "artifact_type string, timestamp_ns long"
    seen = []
    for batch in ([("A", 0), ("B", 1)], [("A", 2)], [("A", 0), ("A", 5)]):
        spark.createDataFrame(batch, schema).coalesce(1).write.mode("append").parquet(inbox)
        listener = ingest.LiveCounts()
        spark.streams.addListener(listener)
        events = aggregates.observe_counts(ingest.read_record_stream(spark, inbox, schema=schema))
        ingest.stream_counts(events, out, mark).awaitTermination()
        seen.append(dict(listener.wait()))
        spark.streams.removeListener(listener)
    assert [(s["events"], s["without_time"]) for s in seen] == [(2, 1), (1, 0), (2, 1)]
    assert brief(ingest.read_counts(spark, out), "artifact_type", "events") == [("A", 4), ("B", 1)]
    assert spark.read.parquet(out).filter("artifact_type = 'B'").count() == 1  # written when it changed


def journal(spark, n, at=0):
    """Records of a real layout: each in a block of 128 bytes."""
    rows = R.usn_chunks(spark, "/root/testdata/sf0.001").filter("substring(content, 13, 1) = X'02'").limit(n + at)
    return b"".join(bytes(r.content).ljust(128, b"\0") for r in rows.select("content").collect()[at:])


def test_growing_journal_is_read_once(spark):
    root = tempfile.mkdtemp(prefix="spark-", dir="/tmp")
    folder, out, mark = (os.path.join(root, n) for n in ("j", "out", "mark"))
    os.mkdir(folder)
    data = journal(spark, 3000)
    assert len(data) > 5 * 65_536

    def put(name, size):
        with open(os.path.join(folder, name), "wb") as f:
            f.write(data[:size])

    def run(complete=False):
        pages = binaryfiles.read_page_stream(spark, folder, "img", 65_536, "h", complete)
        ingest.stream_ingest(pages, lambda p: filesystem.usn_events(binaryfiles.scan_usn(p)), out, mark).awaitTermination()
        return spark.read.parquet(out).count() if glob.glob(out + "/*/*.parquet") else 0

    put("a", 60_000)
    assert run() == 0  # its last unit may still grow
    put("a", 3 * 65_536 + 100)
    assert run() == run() == 2 * 512
    put("a", len(data))
    put("b", 128 * 700)
    put("_copying", 128 * 700)
    whole = spark.createDataFrame([("img", data), ("img", data[:128 * 700])], "image_id string, content binary")
    want = filesystem.usn_events(binaryfiles.scan_usn(binaryfiles.chunk_files(whole, 65_536)))
    assert run(True) == run(True) == want.count() == 3700
    got = spark.read.parquet(out)
    assert brief(got, "timestamp_ns", "message") == brief(want, "timestamp_ns", "message")
    assert {(r.host_id, r.image_id) for r in got.select("host_id", "image_id").distinct().collect()} == {("h", "img")}
    pages = binaryfiles.read_pages(spark, folder, "img", 65_536)
    assert pages.count() == -(-len(data) // 65_536) + 2 and binaryfiles.scan_usn(pages).count() == 3700


def test_page_size_of_a_stream_keeps_to_units(spark):
    try:
        binaryfiles.read_page_stream(spark, "/tmp", "img", 1000)
        assert False
    except ValueError:
        pass


def test_text_files_as_streams(spark):
    root = tempfile.mkdtemp(prefix="spark-", dir="/tmp")
    inbox = os.path.join(root, "in")

    def put(name, body):
        path = os.path.join(inbox, name)
        os.makedirs(os.path.dirname(path), exist_ok=True)
        with open(path, "wb") as f:
            f.write(body)

    def run(name, pattern, parse, build, read=ingest.read_file_stream):
        out = os.path.join(root, name)
        ingest.stream_ingest(read(spark, inbox, pattern, 1, image_id="i", host_id="h"), lambda f: build(parse(f)), out, out + "_mark").awaitTermination()
        return brief(spark.read.parquet(out), "host_id", "message")

    jobs = [("wer", "*.wer", textfiles.parse_wer, textual.wer_events), ("task", "*.xml", textfiles.parse_tasks, textual.task_events),
            ("pca", "PcaAppLaunchDic.txt", textfiles.parse_pca_launch, execution.pca_launch_events)]
    put("a/x.wer", f"EventTime={FT + 10}\nSig[0].Value=one".encode())
    put("a/t.xml", b"<Task><RegistrationInfo><Date>2024-01-02T03:04:05</Date></RegistrationInfo><torn")
    put("a/PcaAppLaunchDic.txt", b"C:\\b|2024-01-02 03:04:05\r\n")
    put("u/ConsoleHost_history.txt", b"dir\n# no\n")
    first = [run(*job) for job in jobs]
    assert [len(x) for x in first] == [1, 1, 1] and first[0] == [("h", "Crash: one")]
    history = ("history", "ConsoleHost_history.txt", textfiles.parse_pshistory, textual.pshistory_events, ingest.read_line_stream)
    assert run(*history) == [("h", "dir")]
    put("b/y.wer", f"EventTime={FT + 10}\nSig[0].Value=two".encode())
    put("v/ConsoleHost_history.txt", b"ls\n")
    assert run(*jobs[0]) == run(*jobs[0]) == [("h", "Crash: one"), ("h", "Crash: two")]
    assert run(*history) == [("h", "dir"), ("h", "ls")]


def test_a_task_of_few_types_sorts_nothing_to_write_them(spark, tmp_path):
    """Folders are written side by side; without the setting a task sorts all of its rows by folder first."""
    from tidemark import configure
    rows = configure(spark).range(10).selectExpr("id", "concat('K', id % 3) AS artifact_type")
    assert int(spark.conf.get("spark.sql.maxConcurrentOutputFileWriters")) >= 3
    rows.write.partitionBy("artifact_type").parquet(f"{tmp_path}/out")
    assert spark.read.parquet(f"{tmp_path}/out").count() == 10


def test_launch_lists_are_read_line_by_line(spark, tmp_path):
    """A task holds a line of a launch list, never a whole list, and a large list is split; bytes that are no UTF-8 stay."""
    from tidemark.plans import queries
    lines = b"".join(b" C:\\caf\xe9%d.exe |2024-01-02 03:04:%02d.5\r\nno bar\nx|never\x0bC:\\b%d|2024-01-02 03:04:05\r" % (i, i % 60, i) for i in range(2000)) + b"\xe9|2024-01-02 03:04:05"
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "PcaAppLaunchDic.txt").write_bytes(lines)
    kept = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "16k")
    try:
        rows = textfiles.binary_lines(spark, str(tmp_path / "in"), "*.txt")
        assert rows.rdd.getNumPartitions() > 4 and max(len(r.content) for r in rows.collect()) < 100
        whole = textfiles.parse_pca_launch(textfiles.binary_files(spark, str(tmp_path / "in"), "*.txt"))
        want = brief(whole, "exe_path", "timestamp_ns")
        assert len(want) == 4001 and want[-1][0] == "é" and ("C:\\café7.exe", 1_704_164_647_500_000_000) in want
        assert brief(textfiles.read_pca_launch(spark, str(tmp_path / "in")), "exe_path", "timestamp_ns") == want
        stream = ingest.read_byte_line_stream(spark, str(tmp_path / "in"), image_id="i", host_id="h")
        build = lambda x: execution.pca_launch_events(textfiles.parse_pca_launch(x))
        ingest.stream_ingest(stream, build, f"{tmp_path}/out", f"{tmp_path}/mark").awaitTermination()
        got = spark.read.parquet(f"{tmp_path}/out")
        assert brief(got, "file_path", "timestamp_ns") == want and got.filter("host_id = 'h' AND image_id = 'i'").count() == 4001
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", kept)


def test_launch_list_query_holds_no_whole_files(spark, monkeypatch):
    from tidemark.plans.queries import QUERIES
    seen = []

    def watched(files):
        seen.append(files._jdf.queryExecution().analyzed().toString())
        return parse(files)

    parse = textfiles.parse_pca_launch
    monkeypatch.setattr(textfiles, "parse_pca_launch", watched)
    assert QUERIES["stream_text_ingest"](spark, "/root/testdata/sf0.001").count() > 0
    assert seen and all("text" in plan.lower() and "binaryfile" not in plan.lower() for plan in seen)
