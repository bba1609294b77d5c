"""Written timelines read back in time order without a sort."""

import glob
import json
import os
import random
import tempfile

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from tidemark.operators import timeline
from tidemark.sources import ordered, sinks
from test_time_ranges import events


def fresh():
    return os.path.join(tempfile.mkdtemp(prefix="spark-", dir="/tmp"), "t")


def in_order(path):
    """Rows of JSON Lines in the order of the files."""
    return [json.loads(line) for f in sorted(glob.glob(path + "/part-*")) for line in open(f, encoding="utf-8")]


def key(row):
    return (row["timestamp_ns"], *[(row[k] is not None, row[k] or "") for k in ordered.TIES])


def test_ties_are_those_of_the_sort():
    assert ordered.TIES == timeline.SORT_TIES


@pytest.mark.parametrize("by_type", [True, False])
def test_conversion_equals_a_sort(spark, by_type):
    stored, out = fresh(), fresh()
    df = events(spark, hot=0.0).withColumn("file_path", F.when(F.col("timestamp_ns") % 2 == 0, "p"))
    sinks.write_parquet(df, stored, by_type=by_type)
    sinks.convert(spark, stored, out, "jsonl", start="1970-01-01T00:00:00.000007", end="1970-01-01T00:00:00.000020")
    got = in_order(out)
    want = [r.asDict() for r in df.filter("timestamp_ns BETWEEN 7000 AND 20000").collect()]
    assert [key(r) for r in got] == sorted(key(r) for r in want)
    rows = ordered.read_in_order(spark, stored)
    assert rows.rdd.getNumPartitions() > 1 and rows.count() == 4000
    assert "Exchange" not in rows._jdf.queryExecution().executedPlan().toString()


def test_one_type_and_hot_time(spark):
    stored, out = fresh(), fresh()
    sinks.write_parquet(events(spark), stored)
    sinks.convert(spark, stored, out, "jsonl", artifact_type="mft")
    times = [r["timestamp_ns"] for r in in_order(out)]
    assert times == sorted(times) and len(times) == events(spark).filter("artifact_type = 'MFT'").count()


def test_a_hot_time_is_one_run_for_each_file():
    files = [("a", 0, 5, 10), ("b", 5, 5, 10), ("c", 5, 5, 10), ("d", 5, 9, 10), ("e", 3, 7, 10)]
    assert ordered.time_slices(files, hot_rows=8) == [
        (0, 2, ["a"]), (3, 4, ["a", "e"]), *[(5, 5, [p]) for p in "bcaed"], (6, 9, ["e", "d"])]
    assert len(ordered.time_slices(files)) < 4
    assert [r[:2] for r in ordered.time_slices(files, 5, 5, 8)] == [(5, 5)] * 5
    assert ordered.time_slices(files, 10, 20, 8) == []


def test_unsorted_files_are_sorted(spark):
    stored, out = fresh(), fresh()
    shuffled = events(spark, hot=0.0).repartition(3).sortWithinPartitions(F.desc("timestamp_ns"))
    sinks.write_parquet(shuffled, stored, sort=False)
    assert ordered.read_in_order(spark, stored) is None
    sinks.convert(spark, stored, out, "jsonl")
    times = [r["timestamp_ns"] for r in in_order(out)]
    assert len(times) == 4000 and times == sorted(times)
    assert ordered.read_in_order(spark, stored, artifact_type="LNK") is None


def test_bounds_outside_give_no_rows(spark):
    stored = fresh()
    sinks.write_parquet(events(spark), stored)
    assert ordered.read_in_order(spark, stored, start=10**15).count() == 0


def test_slices_cover_every_time_once():
    rng = random.Random(3)
    for _ in range(200):
        files = []
        for i in range(rng.randint(1, 12)):
            lo = rng.randint(0, 30)
            files.append((f"f{i}", lo, lo + rng.choice([0, 0, 5, 20]), rng.randint(1, 50)))
        start, end = rng.choice([(None, None), (5, 25), (12, 12)])
        runs = ordered.time_slices(files, start, end, rng.choice([10, 10**6]))
        assert all(a[1] < b[0] or a[:2] == b[:2] for a, b in zip(runs, runs[1:]))
        for path, lo, hi, _rows in files:
            for t in range(lo, hi + 1):
                inside = (start is None or t >= start) and (end is None or t <= end)
                assert sum(path in r[2] and r[0] <= t <= r[1] for r in runs) == inside


def test_merge_of_ascending_sources():
    rng = random.Random(4)

    def table(rows):
        columns = {f.name: pa.array([None] * len(rows), f.type) for f in ordered.ARROW_SCHEMA}
        columns["timestamp_ns"], columns["message"] = pa.array([r[0] for r in rows], pa.int64()), pa.array([r[1] for r in rows], pa.string())
        return pa.table(columns, schema=ordered.ARROW_SCHEMA)

    for held in (10**6, 3):
        for _ in range(100):
            sources = [sorted((rng.randint(0, 8), rng.choice("abc")) for _ in range(rng.randint(0, 12))) for _ in range(rng.randint(1, 4))]
            parts = [iter([table(s[i:i + 2]) for i in range(0, len(s), 2)]) for s in sources]
            got = [(t, m) for out in ordered.merged(parts, held) for t, m in zip(out["timestamp_ns"].to_pylist(), out["message"].to_pylist())]
            want = sorted(r for s in sources for r in s)
            assert sorted(got) == want and [t for t, _ in got] == [t for t, _ in want]
            if held > 100:
                assert got == want
