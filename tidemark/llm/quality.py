"""Quality by ordinal cumulative-link regression on graded ratings.

Grades 0 (worst) to K-1; P(grade <= k) = sigmoid(t_k - s), one score ``s`` of shared hashed-text
weights for all grades and ordered thresholds ``t_k``.  Features are the distinct hashed words of the
whole text, the starts of these words, and a few hashed shape marks (shares of words with symbols, of
capitals, of repeated words); those seen in fewer than ``rare`` rated documents get no weight.  The score
gives the expected grade and the tail probability P(grade >= g) by which documents are selected.
"""

from __future__ import annotations

import re
from dataclasses import dataclass
from functools import lru_cache
from itertools import chain

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, functions as F

from .common import map_arrow, map_batches, texts

SYMBOLS = re.compile(r"[^\w\s.,;:'\"()-]")
CAPITALS = re.compile(r"\b[A-Z]{2,}\b")
STEPS = 12


def _bucket(word: str, buckets: int) -> int:
    return xxhash.xxh3_64_intdigest(word.encode()) % buckets


class WordBuckets(dict):
    """Of each word, its bucket and that of its start, from a bounded cache; words with symbols are also kept apart."""

    def __init__(self, buckets: int) -> None:
        self.buckets, self.marked = buckets, set()

    def __missing__(self, word: str) -> tuple[int, int]:
        if len(self) > 300_000:
            self.clear()
            self.marked.clear()
        bare = word.strip(".,;:!?\"'()")
        if SYMBOLS.search(word):
            self.marked.add(word)
        self[word] = found = (_bucket(bare, self.buckets), _bucket("^" + bare[:4], self.buckets))
        return found


@lru_cache(maxsize=2)
def _words(buckets: int) -> WordBuckets:
    return WordBuckets(buckets)


def drop_caches() -> None:
    _words.cache_clear()


def _step(share: float) -> int:
    """Shares on a scale that is fine near zero."""
    return min(STEPS, int(round(4 * np.log2(1 + 7 * share))))


def features(text: str, buckets: int) -> set[int]:
    """Distinct buckets of one text."""
    words, cache = text.lower().split(), _words(buckets)
    own = set(words)
    n = max(1, len(words))
    found = set(chain.from_iterable(map(cache.__getitem__, own)))
    marks = {
        "marked": len(own & cache.marked) / max(1, len(own)),
        "capitals": len(CAPITALS.findall(text)) / n,
        "repeated": 1 - len(own) / n,
        "again": sum(map(str.__eq__, words, words[1:])) / n if len(own) < n else 0.0,
    }
    for k, share in marks.items():
        found |= _shape(k, _step(share), buckets)
    return found


@lru_cache(maxsize=4096)
def _shape(name: str, step: int, buckets: int) -> frozenset[int]:
    """One mark for each step of the scale that is reached."""
    return frozenset(_bucket(f"\x00{name}\x00{s}", buckets) for s in range(step + 1))


@dataclass
class Model:
    """Shared weights, ordered thresholds, and the scale of the score."""
    weights: np.ndarray
    thresholds: np.ndarray

    def scores(self, batch: list[str]) -> np.ndarray:
        weight = self.weights.tolist()
        return np.array([sum(map(weight.__getitem__, features(t, len(weight)))) for t in batch])

    def at_least(self, score: np.ndarray) -> np.ndarray:
        """P(grade >= k + 1) for every threshold k, one row for each score."""
        return 1 / (1 + np.exp(-np.clip(score[:, None] - self.thresholds[None, :], -500, 500)))


def fit(rows: list[np.ndarray], grades: np.ndarray, n_grades: int, buckets: int, epochs: int = 8, rate: float = 0.1,
        decay: float = 1e-4, rare: int = 3, seed: int = 7) -> Model:
    """Maximum likelihood by AdaGrad over single rows; thresholds stay in order by a projection."""
    if not len(rows):
        return Model(np.zeros(buckets), np.arange(n_grades - 1) - 1e3)  # nothing known: all are kept
    seen_in = np.bincount(np.concatenate(rows), minlength=buckets)
    rows = [r[seen_in[r] >= rare] for r in rows]
    below = np.array([(np.sum(grades <= k) + 0.5) / (len(grades) + 1) for k in range(n_grades - 1)])
    t = np.log(below / (1 - below))
    w, seen, seen_t = np.zeros(buckets), np.full(buckets, 1e-2), np.full(n_grades - 1, 1e-2)
    order = np.random.default_rng(seed)
    for _ in range(epochs):
        for r in order.permutation(len(rows)):
            at, y = rows[r], int(grades[r])
            s = w[at].sum()
            f = 1 / (1 + np.exp(-np.clip(t - s, -30, 30)))  # P(grade <= k)
            high, low = (f[y] if y < n_grades - 1 else 1.0), (f[y - 1] if y else 0.0)
            p = max(high - low, 1e-9)
            d_high, d_low = high * (1 - high), low * (1 - low)
            g = (d_high - d_low) / p  # of -log p by the score
            step = g + decay * w[at]
            seen[at] += step * step
            w[at] -= rate * step / np.sqrt(seen[at])
            for k, d in ((y, -d_high / p), (y - 1, d_low / p)):
                if 0 <= k < n_grades - 1:
                    seen_t[k] += d * d
                    t[k] -= rate * d / np.sqrt(seen_t[k])
            t = np.maximum.accumulate(t)
    return Model(np.round(w * 2 ** 20) / 2 ** 20, t)  # sums are exact, whatever their order


def grade_of(quality: Column, toxic: Column) -> Column:
    """Grades from two marks: 0 toxic, 1 poor, 2 good; null where a mark is missing."""
    return F.when(quality.isNull() | toxic.isNull(), None).when(toxic > 0, 0).when(quality > 0, 2).otherwise(1)


def graded(labels: DataFrame, doc_id: str = "doc_id", quality: str = "quality", toxic: str = "toxic") -> DataFrame:
    """``doc_id, grade`` of a table of marks."""
    return labels.select(F.col(doc_id).alias("doc_id"), grade_of(F.col(quality), F.col(toxic)).alias("grade"))


def _featured(columns: dict, buckets: int) -> dict:
    return {"grade": columns["grade"], "at": [sorted(features(t, buckets)) for t in texts(columns["text"])]}


def train(docs: DataFrame, ratings: DataFrame, n_grades: int = 3, buckets: int = 1 << 18, most_rows: int = 12_000,
          doc_id: str = "doc_id", text: str = "text") -> Model:
    """Fit on rated documents; ``ratings`` has ``doc_id, grade``.

    At most ``most_rows`` ratings are used, those whose ids have the smallest hashes (of an id rated
    twice, the lowest grade).  Only ids and feature numbers of that sample reach the driver.  Null
    ids and grades, and ratings of no document, take no part; without ratings all documents pass.
    """
    sample = (ratings.select(F.col("doc_id").cast("long").alias("rated"), F.col("grade").cast("int").alias("grade")).dropna()
              .groupBy("rated").agg(F.min("grade").alias("grade"))
              .orderBy(F.xxhash64("rated"), "rated").limit(most_rows))
    rows = docs.select(F.col(doc_id).cast("long").alias("rated"), F.col(text).cast("string").alias("text"))
    rows = rows.join(F.broadcast(sample), "rated").select("grade", "text")  # at most most_rows ids
    got = map_batches(rows, "grade int, at array<int>", _featured, buckets).toArrow()
    at = [np.array(a, dtype=np.int64) for a in got["at"].to_pylist()]
    order = sorted(range(len(at)), key=lambda k: (len(at[k]), at[k].tobytes()))  # the same model in every run
    grades = np.array(got["grade"].to_pylist(), dtype=np.int64)
    return fit([at[k] for k in order], grades[order], n_grades, buckets)


def _graded(text: pa.Array, shared, lowest: int):
    model: Model = shared.value
    tail = model.at_least(model.scores(texts(text)))
    return tail.sum(axis=1), tail[:, lowest - 1]


def _judged(columns: dict, shared, lowest: int, least: float) -> dict:
    expected, tail = _graded(columns["text"], shared, lowest)
    return {"doc_id": columns["doc_id"], "expected_grade": expected, "p_tail": tail, "kept": tail >= least}


def judge(docs: DataFrame, model: Model, lowest: int = 2, least: float = 0.5, doc_id: str = "doc_id",
          text: str = "text") -> DataFrame:
    """``doc_id, expected_grade, p_tail, kept`` of every row, in no shuffle.

    ``p_tail`` is P(grade >= lowest); rows with at least ``least`` are kept.  A null text counts as
    empty; null and repeated ids are kept as they are; other columns are not looked at.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)  # a fixed number of weights
    rows = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).cast("string").alias("text"))
    return map_batches(rows, "doc_id long, expected_grade double, p_tail double, kept boolean", _judged, shared, lowest, least)


def keep_good(docs: DataFrame, model: Model, lowest: int = 2, least: float = 0.5, text: str = "text") -> DataFrame:
    """The rows of ``docs``, all columns, that ``judge`` keeps."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches):
        for batch in batches:
            _, tail = _graded(batch.column(batch.schema.get_field_index(text)), shared, lowest)
            yield batch.filter(pa.array(tail >= least, type=pa.bool_()))

    return map_arrow(docs, run, docs.schema)
