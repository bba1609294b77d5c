"""From a folder of evidence to a timeline, and one-pass separation of bad rows."""

import struct

import pytest
from pyspark.sql import functions as F

from tidemark.plans import records_from_tables as R, timeline_run
from tidemark.schema import RECORD_SCHEMAS
from tidemark.sources import records
from test_builders import FT, brief

SF = "/root/testdata/sf0.001"
TASK = b"<Task><RegistrationInfo><Date>2024-01-02T03:04:05</Date></RegistrationInfo></Task>"


def journal(*names):
    out = b""
    for name in names:
        raw = name.encode("utf-16-le")
        size = (60 + len(raw) + 7) // 8 * 8
        out += (struct.pack("<IHHQQQQIIIIHH", size, 2, 0, 1, 5, 0, FT + 50, 256, 0, 0, 32, len(raw), 60) + raw).ljust(size, b"\0")
    return out


def put(root, name, body):
    path = root / name
    path.parent.mkdir(parents=True, exist_ok=True)
    path.write_bytes(body)


def entries(spark, n):
    rows = R.mft_pages(spark, SF).filter("substring(content, 23, 1) = X'01'").orderBy("chunk_off").limit(n)
    return b"".join(bytes(r.content) for r in rows.select("content").collect())


def note(path):
    raw = (path + "\0").encode("utf-16-le")
    return struct.pack("<qqqI", 2, 10, FT + 10, len(raw) // 2) + raw


VOLUME = {
    "journal": "$Extend/$J", "table": "$MFT", "launch": "Windows/appcompat/pca/PcaAppLaunchDic.txt", "task": "windows/System32/Tasks/sub/one",
    "wer": "ProgramData/Microsoft/Windows/WER/ReportArchive/App x/Report.WER", "bin": "$Recycle.Bin/S-1/$IABC.txt",
    "history": "Users/bob/AppData/Roaming/Microsoft/Windows/PowerShell/PSReadLine/ConsoleHost_history.txt"}
EXTRACTED = {
    "journal": "UsnJrnl_J", "table": "MFT", "launch": "PcaAppLaunchDic.txt", "task": "Tasks/sub/one", "wer": "wer/a/b/Report.wer",
    "bin": "RecycleBin/S-1/$IABC.txt", "history": "pshistory/bob/ConsoleHost_history.txt"}


@pytest.mark.parametrize("places", [VOLUME, EXTRACTED])
def test_a_folder_becomes_a_timeline(spark, tmp_path, places):
    root = tmp_path / "an image"
    bodies = {"journal": journal("f1", "f2"), "table": entries(spark, 5), "launch": b"C:\\a.exe|2024-01-02 03:04:05\r\n", "task": TASK,
              "wer": f"EventTime={FT + 10}\nSig[0].Value=app".encode(), "bin": note("C:\\gone.txt"), "history": b"dir\n"}
    for what, name in places.items():
        put(root, name, bodies[what])
    put(root, "elsewhere/PcaAppLaunchDic.txt", bodies["launch"])  # right name, wrong place
    put(root, "elsewhere/x.wer", bodies["wer"])
    put(root, "UsnJrnl_Max", journal("max"))
    log = spark.createDataFrame([("h1", "i1", 1, FT + 1, 1, 4, None, "Chan", "PC1", ["x"], [], "f.evtx")], RECORD_SCHEMAS["evtx"])
    got = timeline_run.build_timeline_from_folder(spark, str(root), "i1", "h1", {"evtx": log})
    rows = got.collect()
    seen = {}
    for r in rows:
        seen.setdefault(r.artifact_type, set()).add(r.message)
        assert (r.host_id, r.image_id, r.hostname) == ("h1", "i1", "PC1")
    assert set(seen) == {"EVTX", "USNJRNL", "MFT", "PCASVC", "TASK", "WER", "PSHISTORY", "RECYCLEBIN"}
    assert seen["PCASVC"] == {"Executed (GUI): C:\\a.exe"} and seen["WER"] == {"Crash: app"} and seen["PSHISTORY"] == {"dir"}
    assert len(seen["USNJRNL"]) == 2 and not any("max" in m for m in seen["USNJRNL"])
    assert sum(r.artifact_type == "PCASVC" for r in rows) == 1 and any("\\sub\\one" in m for m in seen["TASK"])


def test_folder_without_evidence(spark, tmp_path):
    put(tmp_path, "notes.txt", b"x")
    assert timeline_run.build_timeline_from_folder(spark, str(tmp_path), "i").count() == 0
    assert timeline_run.evidence_tables(spark, str(tmp_path), "i") == {}


def test_split_reads_its_input_once(spark):
    seen = spark.sparkContext.accumulator(0)

    def count(batches):
        for batch in batches:
            seen.add(batch.num_rows)
            yield batch

    df = spark.range(100).selectExpr("id", "IF(id % 7 = 0, NULL, id) AS v", "concat('p', id % 3) AS path").mapInArrow(count, "id bigint, v bigint, path string")
    good, errors = records.split_errors(df, F.col("v") > 3, "USNJRNL", "path")
    lazy_good, lazy_errors = records.isolate_errors(df, F.col("v") > 3, "USNJRNL", "path")
    assert good.columns == df.columns and good.count() + errors.count() == 100 and seen.value == 100
    assert brief(good, "id", "v", "path") == brief(lazy_good, "id", "v", "path")
    assert brief(errors, "artifact_type", "path", "error") == brief(lazy_errors, "artifact_type", "path", "error")
    for side in (good, errors):
        plan = side._jdf.queryExecution().executedPlan().toString()
        assert plan.count("FileScan") == 1 and "PartitionFilters: [" in plan and "MapInArrow" not in plan
    nothing, none = records.split_errors(df.limit(0), F.col("v") > 3)
    assert nothing.count() == 0 and none.count() == 0
