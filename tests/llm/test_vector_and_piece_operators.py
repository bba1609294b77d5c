"""Vector codes, hard negatives and merge-type pieces against brute force and the library."""

import hashlib
import random

import numpy as np
import public_tokenizers as P
import pytest
from pyspark.sql import functions as F

from tests.llm.conftest import TEXTS, same
from tidemark.llm import hard_negatives, piece_bpe, vector_codes

SF = "/root/testdata/sf0.001"
PIECES = P.path("piece_bpe_32k.model")
VECTORS = "vec_id long, embedding array<double>, label int, v string, code string, cell int, anchor string, unit long"
NAN, INF = float("nan"), float("inf")


def frame(spark, rows):
    return spark.createDataFrame([(i, v, c, "x", "y", 1, "z", 2) for i, v, c in rows], VECTORS).repartition(3)


def whole(rows, scale):
    """Rows with a whole vector, as whole numbers."""
    return [(i, [int(np.floor(scale * c)) for c in v], c_) for i, v, c_ in rows if v is not None and all(c is not None and np.isfinite(c) for c in v)]


def some_rows(n, d, seed, ids=None):
    rng = np.random.default_rng(seed)
    centres = rng.normal(size=(7, d))
    rows = [(i if ids is None else ids[i], (centres[i % 7] + rng.normal(size=d) * rng.choice([0.01, 0.3])).round(3).tolist(), i % 4) for i in range(n)]
    rows += [(7000 + i, rows[5][1], 1) for i in range(n // 3)]  # copies of one vector
    return rows + [(9001, None, 1), (9002, [None] * d, 1), (9003, [NAN] * d, 2), (9004, [INF] * d, 2), (9005, [0.0] * d, None), (9006, [0.0] * d, 3)]


def codes_by_hand(rows, rounds=4):
    """Every distance of every part, in Python's whole numbers."""
    kept = whole(rows, 1024)
    width = max((len(v) for _, v, _ in kept), default=0)
    width = -(-width // 4) * 4
    kept = [(i, v + [0] * (width - len(v)), c) for i, v, c in kept]
    first = sorted(kept, key=lambda r: (r[0] is None, r[0] or 0, r[1]))[:256]
    size, found, books = width // 4, [], []
    for p in range(4):
        parts = [tuple(v[p * size:(p + 1) * size]) for _, v, _ in kept]
        book = [v[p * size:(p + 1) * size] for _, v, _ in first]
        near = lambda x: min((sum((a - b) ** 2 for a, b in zip(x, e)), k) for k, e in enumerate(book))
        for _ in range(rounds):
            at = [near(x)[1] for x in parts]
            book = [[sum(col) // len(own) for col in zip(*own)] if (own := [x for x, a in zip(parts, at) if a == k]) else e for k, e in enumerate(book)]
        found.append([near(x) for x in parts])
        books.append(book)
    text = ",".join(str(c) for b in books for e in b for c in e)
    sha = hashlib.sha256(text.encode()).hexdigest()
    errors = [sum(f[n][0] for f in found) for n in range(len(kept))]
    total = {}
    for (_, _, label), e in zip(kept, errors):
        total[label] = total.get(label, 0) + e
    return [(i, "".join(f"{f[n][1]:02x}" for f in found), errors[n], total[label], sha) for n, (i, _, label) in enumerate(kept)]


CODES = ["vec_id", "code", "error", "label_error", "codebooks_sha256"]


@pytest.mark.parametrize("rows", [
    some_rows(300, 8, 1), some_rows(20, 4, 2), [(1, [0.5, 1.0, -2.0, 3.0], None)], [(None, [0.5] * 4, 1), (2, [0.25] * 4, None), (2, [0.25] * 4, None)],
    [(1, [0.1, 0.2, 0.3], 1), (2, [0.5] * 6, 1), (3, [], 2)], [(1, [], 1), (2, [], 1)], [(1, [9000.0, -9000.0, 1e-9, 0.0], 1), (2, [8999.0, 0.0, 0.0, -1e-9], 1)],
    [(i, [float(i % 2)] * 4, 0) for i in range(300)]])
def test_codes_are_those_of_all_distances(spark, rows):
    same(vector_codes.product_codes(frame(spark, rows)), codes_by_hand(rows), CODES)


def test_codes_of_no_rows(spark):
    assert vector_codes.product_codes(frame(spark, [])).count() == 0
    assert vector_codes.product_codes(frame(spark, [(1, None, 1), (2, [NAN], 1)])).count() == 0


def test_orchard_is_exact_and_compares_less():
    rng = np.random.default_rng(3)
    centres = rng.integers(-2000, 2000, size=(16, 12))
    entries = (centres[rng.integers(0, 16, 256)] + rng.integers(-9, 10, size=(256, 12))).astype(np.int64)
    entries[40] = entries[200] = entries[7]  # ties
    x = np.concatenate([entries, centres[rng.integers(0, 16, 4000)] + rng.integers(-30, 31, size=(4000, 12))])
    search = vector_codes.Orchard(entries)
    code, error = search.assign(x)
    every = ((x[:, None, :] - entries[None]) ** 2).sum(axis=2)
    assert (code == every.argmin(axis=1)).all() and (error == every.min(axis=1)).all()
    assert search.compared < 0.7 * every.size
    far = x * 4000
    code, error = search.assign(far)
    every = ((far[:, None, :] - entries[None]) ** 2).sum(axis=2)
    assert (code == every.argmin(axis=1)).all() and (error == every.min(axis=1)).all()


def negatives_by_hand(rows, step):
    kept = {(i, tuple(v), (c + 1) % 10 if i % 7 == 0 else c) for i, v, c in whole(rows, 256) if i is not None and c is not None}
    out = []
    for a, x, label in kept:
        if a % step:
            continue
        scored = sorted((-sum(p * q for p, q in zip(x, y)), i, c) for i, y, c in kept if i != a)
        for s, i in [(-s, i) for s, i, c in scored if c == label][:5]:
            inside = [(j, -t) for t, j, c in scored if c != label and 80 * s <= -100 * t <= 100 * s][:5]
            out += [(a, i, r + 1, j, s, t) for r, (j, t) in enumerate(inside)]
    return out


@pytest.mark.parametrize("rows", [some_rows(300, 8, 4), some_rows(40, 3, 5), [(0, [1.0, 0.0], 1), (5, [1.0, 0.0], 1), (6, [0.9, 0.1], 2), (6, [0.9, 0.1], 2), (None, [1.0, 0.0], 1)],
                                  [(10, [-1.0, 0.0], 1), (5, [1.0, 0.0], 1), (6, [1.0], 2), (8, [], 2)], [(i, [0.0, 0.0], i % 2) for i in range(30)], [(20, [50.0], 3)]])
@pytest.mark.parametrize("block", [16, 32_768])
def test_hard_negatives_are_those_of_all_scores(spark, rows, block, monkeypatch):
    monkeypatch.setattr(hard_negatives, "BLOCK_ROWS", block)
    moved = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    got = hard_negatives.hard_negatives(frame(spark, rows), F.col("vec_id") % 10 == 0, relabel=moved)
    same(got, negatives_by_hand(rows, 10), ["anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score"])


def test_hard_negatives_of_no_rows(spark):
    for rows in ([], [(1, None, 1), (2, [1.0], None)]):
        assert hard_negatives.hard_negatives(frame(spark, rows), F.col("vec_id") % 10 == 0).count() == 0


def test_score_bounds_hold_and_rule_out():
    rng = np.random.default_rng(6)
    centres = rng.integers(-250, 250, size=(5, 6))
    x = centres[rng.integers(0, 5, 3000)] + rng.integers(-8, 9, size=(3000, 6))
    refs = centres / np.linalg.norm(centres, axis=1)[:, None]
    angle = hard_negatives.angles(x.astype(float), refs).astype(np.float32).astype(float)
    norm = np.linalg.norm(x, axis=1)
    out = 0
    for q, a, n in zip(x[:50], angle, norm):
        low, top = hard_negatives.bounds(a, n, angle, angle, norm)
        score = x @ q
        assert (low <= score).all() and (score <= top).all()
        out += (top < 0.8 * score.max()).sum()
    assert out > 50 * 1500  # most rows need no scoring


@pytest.fixture(scope="module")
def library():
    import sentencepiece
    return sentencepiece.SentencePieceProcessor(model_file=PIECES)


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


def test_pieces_are_the_library(spark, docs, no_docs, library):
    def want(rows):
        for i, t in rows:
            ids = library.encode(t or "", add_eos=True)
            yield i, len(ids), sha(" ".join(map(str, ids))), sha(library.decode(ids))
    columns = ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"]
    same(piece_bpe.round_trip(docs, PIECES), list(want(TEXTS)), columns)
    table = spark.read.parquet(f"{SF}/documents.parquet")
    same(piece_bpe.round_trip(table, PIECES), list(want([(r.doc_id, r.text) for r in table.collect()])), columns)
    assert piece_bpe.round_trip(no_docs, PIECES).count() == 0
    back = piece_bpe.decode(piece_bpe.encode(docs, PIECES), PIECES)
    same(back, [(i, (t or "").replace("▁", " ")) for i, t in TEXTS], ["doc_id", "text"])


def test_pieces_of_random_texts(library):
    code, draw = piece_bpe.Pieces(PIECES), random.Random(7)
    vocabulary = [library.id_to_piece(i) for i in range(259, library.get_piece_size())]
    texts = ["".join(draw.choice(vocabulary) for _ in range(draw.randint(1, 9))) for _ in range(2000)]
    texts += [t.replace("▁", " ") for t in texts]
    texts += ["".join(draw.choice("abeinorst ,.\n'é的😀\x00") for _ in range(draw.randint(1, 60))) for _ in range(2000)]
    texts += [c * n for c in " ▁x=-.\n的" for n in range(1, 70)] + [" " * n + "the" for n in range(40)]
    texts.append("".join(draw.choice("abcdefghij") for _ in range(100_000)))  # one word
    for text, ids in zip(texts, code.encode(texts)):
        assert ids.tolist() == library.encode(text, add_eos=True)
        assert code.decode(ids.tolist()).decode() == library.decode(ids.tolist())
