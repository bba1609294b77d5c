"""Search by index and by path over a written timeline."""

import os
import tempfile

from pyspark.sql import functions as F

from tidemark.operators import timeline
from tidemark.sources import records, sinks, textindex

WORDS = ["alpha", "beta", "gamma", "delta", "épsilon", "zeta 😀 x", "100%", "a\\b"]


def written(spark, folder="a timeline"):
    """Eight time ranges, each with its own word and its own paths."""
    path = os.path.join(tempfile.mkdtemp(prefix="spark-", dir="/tmp"), folder)
    word = F.element_at(F.array(*[F.lit(w) for w in WORDS]), (F.col("id") / 500).cast("int") + 1)
    rows = spark.range(0, 4000, 1, 3).select(
        (F.col("id") * 10 + 1).alias("timestamp_ns"), F.lit("MFT").alias("artifact_type"),
        F.when(F.col("id") % 100 != 3, F.concat(F.lit("touch "), word, F.lit(" "), (F.col("id") % 10).cast("string"))).alias("message"),
        F.concat(F.lit("\\dir\\f"), F.xxhash64("id").cast("string")).alias("file_path"))
    kept = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "8")
    try:
        sinks.write_parquet(timeline.normalize(rows), path)
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", kept)
    return path


def read_rows(df):
    """Rows that the scan of a collected query gave to its filter."""
    df.collect()
    return df._jdf.queryExecution().executedPlan().collectLeaves().head().metrics().get("numOutputRows").get().value()


def test_search_equals_a_scan_and_opens_few_files(spark):
    path = written(spark)
    textindex.index_messages(spark, path)
    total = len(spark.read.parquet(path).inputFiles())
    assert total >= 8
    for text in [*WORDS, "touch", "ta", "", "nowhere", "beta 7", "😀", "ma 1"]:
        want = timeline.grep(records.read_timeline(spark, path), text)
        got = textindex.grep_timeline(spark, path, text)
        assert got.columns == want.columns and sorted(r.timestamp_ns for r in got.collect()) == sorted(r.timestamp_ns for r in want.collect())
        files = textindex.files_with(spark, path, text)
        if len(text) < 3:
            assert files is None
        if text in WORDS:
            assert 1 <= len(files) <= 3
    assert textindex.files_with(spark, path, "nowhere") == []
    assert textindex.grep_timeline(spark, path, "touch", "usn").count() == 0


def test_sequences_of_long_and_short_texts(spark):
    texts = ["".join(chr(97 + (k * k) % 23) for k in range(n)) for n in (0, 1, 2, 3, 4, 999, 1000, 1001, 1002, 1003, 2500)] + [None, "é😀x", "😀😀😀😀"]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "n int, t string")
    got = {r.n: r.k for r in textindex.trigram_rows(df, "t", "n").groupBy("n").agg(F.count("*").alias("k")).collect()}
    assert got == {i: len(t) - 2 for i, t in enumerate(texts) if t and len(t) > 2}
    whole = {r.p for r in df.filter("n = 10").selectExpr("explode(sequence(1, 2498)) AS i", "t").selectExpr(f"pmod(xxhash64(substring(t, i, 3)), {textindex.BITS}) + 1 AS p").collect()}
    assert {r.place for r in textindex.trigram_rows(df.filter("n = 10"), "t").collect()} == whole


def test_sequences_carry_no_file_names(spark):
    """One sequence a letter: what each carries and hashes is a number, not its file's path."""
    path = written(spark)
    plans = []
    kept = textindex.trigram_rows
    try:
        textindex.trigram_rows = lambda df, text, *keep: plans.append(df.select(*keep).dtypes) or kept(df, text, *keep)
        textindex.index_messages(spark, path)
    finally:
        textindex.trigram_rows = kept
    assert [t for _, t in plans[0]] == ["bigint"]
    index = spark.read.parquet(textindex._index_path(path))
    known = {n for f in spark.read.parquet(path).inputFiles() for n in (f, textindex._plain(f))}
    assert index.columns == ["file", "bucket", "bits"] and {r.file for r in index.collect()} <= known
    assert index.groupBy("file", "bucket").count().filter("count > 1").count() == 0


def test_files_after_the_index_are_searched(spark):
    path = written(spark)
    textindex.index_messages(spark, path)
    late = spark.createDataFrame([(5, "MFT", "late alpha"), (6, "MFT", "unrelated")], "timestamp_ns long, artifact_type string, message string")
    sinks.write_parquet(timeline.normalize(late), path, mode="append")
    assert [r.message for r in textindex.grep_timeline(spark, path, "late alpha").collect()] == ["late alpha"]
    assert len(textindex.files_with(spark, path, "late alpha")) <= 3  # the new files alone


def test_one_path_reads_few_rows(spark):
    path = written(spark)
    back = records.read_timeline(spark, path)
    some = back.filter("timestamp_ns = 20001").first().file_path
    found = back.filter(F.col("file_path") == some)
    assert read_rows(found) <= 1200 and found.count() == 1
    # a sketch gives ranges of about 500 rows; this one lies across two of them
    narrow = timeline.filter_time(back, "1970-01-01T00:00:00.000020", "1970-01-01T00:00:00.000021")
    assert read_rows(narrow) <= 1200 and narrow.count() == 100
