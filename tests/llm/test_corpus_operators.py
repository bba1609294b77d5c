"""Operators that compare documents or vectors, and the pipeline, against brute force."""

import hashlib
import math
import random
import tracemalloc

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from tests.llm.conftest import STORY, TEXTS, same
from tidemark.llm import common, near_duplicates, quality, repeated_passages, suffix_sort, vector_search
from tidemark.llm.components import components

SF = "/root/testdata/sf0.001"


def shingles(text):
    w = (text or "").encode().lower().split()
    return frozenset(tuple(w[k:k + 5]) for k in range(max(1, len(w) - 4))) if w else frozenset()


def brute_components(rows):
    """By id; rows with the same id are one node."""
    sets = [(i, shingles(t)) for i, t in rows if i is not None]
    least = {i: i for i, _ in sets}

    def find(x):
        while least[x] != x:
            x = least[x]
        return x
    for a, (i, s) in enumerate(sets):
        for j, t in sets[:a]:
            if s and t and 100 * len(s & t) >= 75 * len(s | t):
                x, y = sorted((find(i), find(j)))
                least[y] = x
    return find


def expected_near(rows):
    find = brute_components(rows)
    for i, t in rows:
        c = i if i is None or not shingles(t) else find(i)
        yield i, len(shingles(t)), c, c == i


NEAR = ["doc_id", "n_shingles", "component_id", "kept"]


def test_near_duplicates_odd_rows(spark, docs, no_docs):
    same(near_duplicates.near_duplicates(docs), list(expected_near(TEXTS)), NEAR)
    kept = near_duplicates.drop_near_duplicates(docs)
    assert kept.columns == docs.columns
    gone = {i for i, _, _, k in expected_near(TEXTS) if not k}
    same(kept, [t for t in TEXTS if t[0] not in gone], ["doc_id", "text"])
    assert near_duplicates.near_duplicates(no_docs).count() == 0


def test_near_duplicates_of_the_table(spark):
    table = spark.read.parquet(f"{SF}/documents.parquet")
    want = list(expected_near([(r.doc_id, r.text) for r in table.collect()]))
    assert sum(not w[3] for w in want) > 5
    same(near_duplicates.near_duplicates(table), want, NEAR)


def test_near_duplicates_hidden_centre(spark):
    """Copies that are all like the last one, but mostly not like each other."""
    order = random.Random(8)
    base = [f"b{k}" for k in range(200)]
    rows = []
    for k in range(60):
        w = list(base)
        for at in order.sample(range(200), 5):
            w[at] = f"x{k}_{at}"
        rows.append((k, " ".join(w)))
    rows.append((99, " ".join(base)))
    want = list(expected_near(rows))
    assert len({w[2] for w in want}) < 30
    same(near_duplicates.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")), want, NEAR)


def test_min_max_values_agree_as_the_sets_do():
    a = near_duplicates.shingle_set(" ".join(f"w{k}" for k in range(2004)).encode())
    b = near_duplicates.shingle_set(" ".join(f"w{k}" for k in range(300, 2304)).encode())
    (la, ha), (lb, hb) = near_duplicates.signature(a), near_duplicates.signature(b)
    likeness = len(np.intersect1d(a, b)) / len(np.union1d(a, b))
    assert abs(np.mean(np.concatenate([la == lb, ha == hb])) - likeness) < 0.15


def test_components(spark):
    edges = [(k, k + 1) for k in range(40)] + [(100, 90), (95, 100), (7, 7), (300, 301), (301, 300), (300, 301)]
    got = components(spark.createDataFrame(edges, "a long, b long"))
    want = [(k, 0) for k in range(41)] + [(90, 90), (95, 90), (100, 90), (300, 300), (301, 300)]
    same(got, want, ["id", "component"])
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


def expected_passages(rows):
    first = {}
    for i, t in sorted((i, (t or "").encode()) for i, t in rows if i is not None):
        for p in range(len(t) - 49):
            first.setdefault(t[p:p + 50], i)
    for i, t in rows:
        t = (t or "").encode()
        gone = bytearray(len(t))
        for p in range(len(t) - 49):
            if i is not None and first[t[p:p + 50]] < i:
                gone[p:p + 50] = b"\1" * 50
        kept = bytes(c for c, g in zip(t, gone) if not g)
        spans = sum(g and not (p and gone[p - 1]) for p, g in enumerate(gone))
        yield (i, len(t), sum(gone), spans, hashlib.sha256(kept).hexdigest()), kept


PASSAGES = ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"]


@pytest.mark.parametrize("share", [0.05, 0.0])  # at 0, anchors of five documents count as common
def test_repeated_passages_odd_rows(spark, docs, no_docs, share):
    same(repeated_passages.repeated_passages(docs, least_share=share), [w for w, _ in expected_passages(TEXTS)], PASSAGES)
    cut = repeated_passages.drop_repeated_passages(docs, least_share=share)
    assert cut.columns == docs.columns
    same(cut, [(i, t if t is None else k.decode(errors="ignore")) for (i, t), (_, k) in zip(TEXTS, expected_passages(TEXTS))], ["doc_id", "text"])
    assert repeated_passages.repeated_passages(no_docs).count() == 0


@pytest.mark.parametrize("share", [0.05, 0.0])
def test_repeated_passages_of_the_table(spark, share):
    table = spark.read.parquet(f"{SF}/documents.parquet")
    want = [w for w, _ in expected_passages([(r.doc_id, r.text) for r in table.collect()])]
    assert sum(w[2] > 0 for w in want) > 10
    same(repeated_passages.repeated_passages(table, bucket_bytes=20_000, least_share=share), want, PASSAGES)


def test_repeated_passages_random_splices(spark):
    order = random.Random(5)
    pool = ["".join(order.choice("ab") for _ in range(order.randint(30, 90))) for _ in range(25)] + ["a" * 70, "ab" * 40, "é" * 30]
    rows = [(order.randint(0, 200), "".join(order.choice(pool) for _ in range(order.randint(0, 6)))) for _ in range(150)]
    want = [w for w, _ in expected_passages(rows)]
    same(repeated_passages.repeated_passages(spark.createDataFrame(rows, "doc_id long, text string")), want, PASSAGES)


def test_repeated_passages_of_one_character_at_every_place(spark):
    """Pairs of documents that share only a run of 50 to 60 equal characters."""
    order = random.Random(7)
    rows = []
    for k in range(64):
        run = chr(33 + k) * (50 + k % 11)
        for i, at in ((k, order.randrange(64)), (100 + k, k)):
            filling = "".join(order.choice("abcdefghij") for _ in range(192 - len(run)))
            rows.append((i, filling[:at] + run + filling[at:]))
    want = [w for w, _ in expected_passages(rows)]
    assert sum(w[2] > 0 for w in want) == 64
    same(repeated_passages.repeated_passages(spark.createDataFrame(rows, "doc_id long, text string").coalesce(1)), want, PASSAGES)


def test_strings_have_one_anchor_at_every_place():
    """The anchor of a string and its place in it depend on its 50 bytes alone."""
    for text in (b"-" * 50, b"| --- " * 9, b"ab" * 25, bytes(range(50))):
        text = text[:50]
        found = set()
        for place in range(130):
            blob = np.frombuffer(b"x" * place + text, np.uint8)
            h, g, of, *_ = repeated_passages.anchored(blob, np.array([0, place]), np.array([place, 50]))
            found |= set(zip(h[of == 1].tolist(), g[of == 1].tolist()))
        assert len(found) == 1


def test_runs_of_equal_stretches_are_one():
    blob = np.frombuffer(b"-" * 5000, np.uint8)
    h, g, text, s1, n, b, e = repeated_passages.anchored(blob, np.array([0]), np.array([5000]))
    assert len(h) < 5 and n.sum() == 4951


def test_slices_of_long_texts_make_the_same_strings(monkeypatch):
    """Every 50-byte string is in one stretch, whatever the slices."""
    blob = np.frombuffer((STORY * 30 + "end").encode(), np.uint8)
    starts, lengths = np.array([0, 1000, 1030]), np.array([1000, 30, len(blob) - 1030])
    for size in (1 << 20, 700, 64):
        monkeypatch.setattr(repeated_passages, "SLICE", size)
        h, g, text, s1, n, b, e = repeated_passages.anchored(blob, starts, lengths)
        got = sorted((int(t), int(s) + k) for t, s, m in zip(text, s1, n) for k in range(m))
        assert got == [(0, k) for k in range(951)] + [(2, k) for k in range(lengths[2] - 49)]


def test_freed_memory_goes_back():
    """A waiting worker holds no more than its caches."""
    def held():
        with open("/proc/self/statm") as f:
            return int(f.read().split()[1]) * 4096
    blocks = [b"x" * 100_000 for _ in range(2000)]
    last, most = b"y" * 100_000, held()
    del blocks
    common.give_back()
    assert len(last) and most - held() > 150_000_000


def test_stretches_of_a_part_take_little_memory():
    """Six megabytes of text are anchored in less than eleven bytes for each."""
    order = random.Random(8)
    blob = np.frombuffer(order.randbytes(repeated_passages.PART), np.uint8)
    tracemalloc.start()
    repeated_passages.anchored(blob, np.array([0]), np.array([len(blob)]))
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 11 * len(blob)


def test_deep_shallow_sort():
    order = random.Random(6)
    for alphabet, length, shallow in (("ab", 50, 16), ("a", 50, 16), ("abc\0\xff", 20, 8), ("ab", 5, 16)):
        blob = "".join(order.choice(alphabet) for _ in range(900)).encode("latin-1")
        at = np.array([order.randrange(900 - length) for _ in range(700)])
        got, same_class = suffix_sort.sort_suffixes(np.frombuffer(blob, np.uint8), at, length, shallow)
        texts = [blob[p:p + length] for p in at[got].tolist()]
        assert texts == sorted(texts) and sorted(got.tolist()) == list(range(700))
        assert same_class.tolist() == [sorted(set(texts)).index(t) for t in texts]
    assert len(suffix_sort.sort_suffixes(np.empty(0, np.uint8), np.empty(0, np.int64), 50)[0]) == 0


def test_quality_odd_rows(spark, docs, no_docs):
    marks = [(1, 1, 0, "x"), (4, None, 0, "x"), (None, 1, 0, "x"), (10, 0, 0, "x"), (12, 0, 1, "x"), (12, 1, 0, "x"), (777, 1, 0, "x"), (1, 1, 0, "x")]
    ratings = quality.graded(spark.createDataFrame(marks, "doc_id long, quality int, toxic int, text string"))
    model = quality.train(docs, ratings, buckets=1 << 12)
    got = quality.judge(docs, model).collect()
    assert sorted(map(repr, (r.doc_id for r in got))) == sorted(map(repr, (i for i, _ in TEXTS)))
    assert all(0 <= r.expected_grade <= 2 and 0 <= r.p_tail <= 1 and r.kept == (r.p_tail >= 0.5) for r in got)
    kept = quality.keep_good(docs, model)
    assert kept.columns == docs.columns and kept.count() == sum(r.kept for r in got)
    assert quality.judge(no_docs, model).count() == 0 and quality.keep_good(no_docs, model).count() == 0
    unrated = quality.train(docs, ratings.limit(0), buckets=1 << 12)
    assert quality.keep_good(docs, unrated).count() == len(TEXTS)


def test_quality_thresholds_are_ordered_and_tails_shrink():
    rows = [np.array([k % 3, 5]) for k in range(90)]
    model = quality.fit(rows, np.array([k % 3 for k in range(90)]), 3, 8)
    assert list(model.thresholds) == sorted(model.thresholds)
    tail = model.at_least(np.array([model.weights[r].sum() for r in rows]))
    assert (tail[:, 0] >= tail[:, 1]).all()
    assert [int(round(x)) for x in tail.sum(axis=1)[:3]] == [0, 1, 2]


def test_quality_held_out_accuracy(spark):
    """Fit on three quarters of the rated documents; judge the rest."""
    sf = "/root/testdata/sf0.1"
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    ratings = quality.graded(spark.read.parquet(f"{sf}/labels.parquet"))
    model = quality.train(docs, ratings.filter("doc_id % 4 > 0"))
    judged = quality.judge(docs, model).join(ratings.filter("doc_id % 4 = 0"), "doc_id")
    kept = {r.grade: r.kept for r in judged.groupBy("grade").agg(F.avg(F.col("kept").cast("int")).alias("kept")).collect()}
    assert kept[2] > 0.97 and kept[1] < 0.2 and kept[0] < 0.3


def test_vector_search_odd_rows(spark):
    order = np.random.default_rng(9)
    rows = [(k, order.standard_normal(6).tolist(), 1) for k in range(150)]
    rows += [(k, rows[20][1], 1) for k in range(150, 230)]  # one vector of many rows
    rows += [(300, None, 1), (320, [0.0] * 6, 1), (340, [1.0, None, 0.0, 0.0, 0.0, 0.0], 1), (360, [math.inf, 0.0, 0.0, 0.0, 0.0, 0.0], 1), (380, [math.nan] * 6, 1),
             (None, [1.0] * 6, 1), (400, [1.0] * 5, 1), (420, [], 1), (40, rows[40][1], 1), (440, [-1e30] * 6, 1), (460, [1e-30] * 6, 1)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, score int")
    good = {}
    for i, v, _ in rows:
        if i is not None and v and len(v) == 6 and all(x is not None and math.isfinite(x) for x in v) and any(v):
            good[i] = np.array(v)
    for options in ({"leaf_rows": 16, "recall": 1.0}, {}):
        got = vector_search.nearest(df, F.col("vec_id") % 20 == 0, **options).collect()
        for q in [i for i in good if i % 20 == 0]:
            mine = sorted((r["rank"], r.vec_id, r.score) for r in got if r.query_id == q)
            assert [m[0] for m in mine] == list(range(1, 21))
            assert all(abs(s - good[q] @ good[i]) <= 1e-9 * max(1, abs(s)) and i != q for _, i, s in mine)
            assert [(-s, i) for _, i, s in mine] == sorted((-s, i) for _, i, s in mine)
            if not options:  # one leaf: all vectors are compared
                want = sorted((-float(good[q] @ v), i) for i, v in good.items() if i != q)[:20]
                assert np.allclose([m[2] for m in mine], [-w[0] for w in want])
        assert {r.query_id for r in got} == {i for i in good if i % 20 == 0}
    assert vector_search.nearest(df.limit(0), F.lit(True)).count() == 0
    assert vector_search.nearest(df.filter("vec_id = 40"), F.lit(True)).count() == 0
    few = vector_search.nearest(df.filter("vec_id < 5"), F.lit(True), k=20).collect()
    assert len(few) == 20 and max(r["rank"] for r in few) == 4


def test_vector_search_recall(spark):
    order = np.random.default_rng(10)
    centres = order.standard_normal((40, 24))
    x = (centres[order.integers(0, 40, 6000)] + 0.5 * order.standard_normal((6000, 24))) * order.uniform(0.5, 2, (6000, 1))
    df = spark.createDataFrame([(k, v.tolist()) for k, v in enumerate(x)], "vec_id long, embedding array<double>")
    got = vector_search.nearest(df, F.col("vec_id") % 20 == 0, leaf_rows=128).collect()
    found = {}
    for r in got:
        found.setdefault(r.query_id, set()).add(r.vec_id)
    hits = 0
    for q in range(0, 6000, 20):
        s = x @ x[q]
        s[q] = -np.inf
        hits += len(found[q] & set(np.argsort(-s)[:20].tolist()))
    assert hits >= 0.9 * 300 * 20


def test_vector_search_over_many_tasks_finds_an_id_once(spark):
    order = np.random.default_rng(12)
    x = order.standard_normal((3000, 61))
    df = spark.createDataFrame([(k, v.tolist()) for k, v in enumerate(x)], "vec_id long, embedding array<double>")
    held = {"spark.sql.shuffle.partitions": "13", "spark.sql.adaptive.coalescePartitions.enabled": "false"}
    before = {key: spark.conf.get(key) for key in held}
    try:
        for key, value in held.items():
            spark.conf.set(key, value)
        got = vector_search.nearest(df, F.col("vec_id") % 20 == 0, leaf_rows=64, recall=1.0).collect()
    finally:
        for key, value in before.items():
            spark.conf.set(key, value)
    assert len(got) == 150 * 20 == len({(r.query_id, r.vec_id) for r in got})


def test_vector_search_ties_go_to_the_smaller_id(spark):
    """Different vectors of integers with equal scores, more than are asked for."""
    order = np.random.default_rng(14)
    x = np.concatenate([order.integers(1, 3, (400, 1)), order.integers(-1, 2, (400, 5))], axis=1).astype(float)
    x[0] = [4, 0, 0, 0, 0, 0]
    df = spark.createDataFrame([(k, v.tolist()) for k, v in enumerate(x)], "vec_id long, embedding array<double>")
    for options in ({}, {"leaf_rows": 32, "recall": 1.0}):
        got = vector_search.nearest(df, F.col("vec_id") % 50 == 0, k=5, **options).collect()
        for q in range(0, 400, 50) if not options else [0]:
            want = sorted((-float(x[q] @ v), k) for k, v in enumerate(x) if k != q)[:5]
            assert [(-r.score, r.vec_id) for r in sorted(got, key=lambda r: r["rank"]) if r.query_id == q] == want


def test_vector_search_scores_do_not_depend_on_the_leaf():
    order = np.random.default_rng(13)
    x, q = order.standard_normal((500, 96)), order.standard_normal(96)
    whole = vector_search.products(q, x)
    for n in (1, 2, 7, 64, 333):
        some = order.permutation(500)[:n]
        assert vector_search.products(q, x[some]).tolist() == whole[some].tolist()


def test_pipeline_stages(spark):
    """Each stage against brute force on its own input."""
    import corpus_pipeline
    from tests.llm.test_text_operators import brute_windows
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    bench = [(r.item_id, r.text) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality", "near_duplicates", "repeated_passages", "decontamination", "tokens"]
    rows = {}
    for name, stage in corpus_pipeline.STAGES:
        before = [(r.doc_id, r.text) for r in docs.collect()]
        after = stage(spark, docs, SF)
        if name != "tokens":
            assert after.columns == docs.columns
            after = spark.createDataFrame(after.collect(), docs.schema)
        rows[name] = after.count()
        if name == "near_duplicates":
            want = {i for i, _, _, k in expected_near(before) if k}
            assert {r.doc_id for r in after.collect()} == want
        elif name == "repeated_passages":
            want = {w[0]: k.decode(errors="ignore") for w, k in expected_passages(before)}
            assert {r.doc_id: r.text for r in after.collect()} == want
        elif name == "decontamination":
            want = {w[0] for w in brute_windows(before, bench) if not w[-1]}
            assert {r.doc_id for r in after.collect()} == want
        elif name == "tokens":
            assert {r.decoded_sha256 for r in after.collect()} == {hashlib.sha256(t.encode()).hexdigest() for _, t in before}
        docs = after
    assert rows["quality"] < 200 and rows["tokens"] > 100
    same(corpus_pipeline.run(spark, SF), [tuple(r) for r in docs.collect()], docs.columns)


def test_pipeline_keeps_good_rated_documents(spark):
    kept = {r.doc_id for r in __import__("corpus_pipeline").keep_quality(spark, spark.read.parquet(f"{SF}/documents.parquet"), SF).collect()}
    good = duckdb.sql(f"SELECT doc_id FROM '{SF}/labels.parquet' WHERE quality = 1 AND toxic = 0").fetchall()
    assert sum(i in kept for (i,) in good) >= 0.97 * len(good)
