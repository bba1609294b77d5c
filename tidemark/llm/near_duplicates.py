"""Near duplicates by min-max hashing.

Each document is the set of its distinct shingles of five words.  Under each permutation both the
smallest and the largest value are kept, so one evaluation gives two signature values; a band holds
the smallest and largest values of two permutations.  Documents that share a band are candidates,
and sets are compared in full before two documents are linked.

Equal sets form a class first, and only one document of each class is hashed on.  In a bucket no
pairs are listed: each member is compared with the bucket's most popular member (the one with the
most company in all its buckets).  Links make components; where a bucket then still holds several
components, all pairs of different components that sketches do not rule out are compared
(after further centres, if there are very many), so no link among candidates is lost.
"""

from __future__ import annotations

import math

import numpy as np
import xxhash
from pyspark.sql import DataFrame, functions as F

from ..session import materialize
from .common import id_and_text, map_batches, mix, row_bytes, signed
from .components import components

WORDS = 5
BANDS = 32
PERMUTATIONS = 2 * BANDS
SKETCH_AGREES = 95  # of 128 bits; a pair at a similarity of 0.75 has 112 +- 3.7
COMPARED = 4096  # sketches a member of a bucket may be compared with, on average, before other centres are tried
_rng = np.random.default_rng(20)
FACTORS = _rng.integers(1, 1 << 63, PERMUTATIONS, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
SHIFTS = _rng.integers(0, 1 << 63, PERMUTATIONS, dtype=np.uint64)
PLACES = _rng.integers(1, 1 << 63, WORDS + 1, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def shingle_set(text: bytes) -> np.ndarray:
    """Sorted 64-bit hashes of the distinct shingles; empty without words."""
    words = text.lower().split()  # of bytes: A-Z and ASCII white space
    if not words:
        return np.empty(0, np.uint64)
    known: dict[bytes, int] = {}
    hashes = np.array([known.get(w) or known.setdefault(w, xxhash.xxh3_64_intdigest(w)) for w in words], dtype=np.uint64)
    n = max(1, len(hashes) - WORDS + 1)
    total = np.zeros(n, np.uint64)
    for k in range(min(WORDS, len(hashes))):
        total += mix(hashes[k:k + n] * PLACES[k])
    return np.unique(mix(total * PLACES[WORDS] + np.uint64(min(WORDS, len(hashes)))))


def signature(shingles: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Smallest and largest value under each permutation."""
    low, high = np.full(PERMUTATIONS, np.iinfo(np.uint64).max, np.uint64), np.zeros(PERMUTATIONS, np.uint64)
    for at in range(0, len(shingles), 4096):
        part = shingles[at:at + 4096]
        values = part[None, :] * FACTORS[:, None]
        values ^= values >> np.uint64(32)
        values *= SHIFTS[:, None] | np.uint64(1)
        values ^= values >> np.uint64(29)
        np.minimum(low, values.min(axis=1), out=low)
        np.maximum(high, values.max(axis=1), out=high)
    return low, high


def band_keys(low: np.ndarray, high: np.ndarray) -> np.ndarray:
    """One key for each band: the four values of two permutations, and the band."""
    four = [low[0::2], high[0::2], low[1::2], high[1::2]]
    total = np.arange(BANDS, dtype=np.uint64) * PLACES[0]
    for k, v in enumerate(four):
        total = mix(total + v * PLACES[k + 1])
    return total


def sketch(low: np.ndarray, high: np.ndarray) -> tuple[int, int]:
    """One bit of each of the 128 values."""
    return tuple(signed(np.packbits((mix(v) & np.uint64(1)).astype(np.uint8)).view(np.uint64))[0].item() for v in (low, high))


def parity(shingles: np.ndarray) -> tuple[int, np.ndarray]:
    """An odd sketch: parities of how many shingles fall on each of 1,024 places, and the sampling level for large sets.

    The exclusive or of two such sketches tells how many shingles two sets do not share.
    """
    level = max(0, (len(shingles) // 1000).bit_length())
    some = shingles[shingles >> np.uint64(64 - level) == 0] if level else shingles
    odd = np.bincount((mix(some) & np.uint64(1023)).astype(np.int64), minlength=1024) & 1
    return level, signed(np.packbits(odd.astype(np.uint8)).view(np.uint64))


PARITIES = [f"p{k}" for k in range(16)]


def _signed_rows(columns: dict) -> dict:
    out: dict[str, list] = {"doc_id": columns["doc_id"], "n": [], "d1": [], "d2": [], "keys": [], "s1": [], "s2": [], "level": [],
                            "parity": []}
    for text in row_bytes(columns["text"]):
        shingles = shingle_set(text)
        out["n"].append(len(shingles))
        if len(shingles):
            digest = xxhash.xxh3_128_intdigest(shingles.tobytes())
            low, high = signature(shingles)
            s1, s2 = sketch(low, high)
            row = ((digest >> 64) - (1 << 63), (digest & (1 << 64) - 1) - (1 << 63), signed(band_keys(low, high)), s1, s2,
                   *parity(shingles))
        else:
            row = (None,) * 7
        for name, value in zip(("d1", "d2", "keys", "s1", "s2", "level", "parity"), row):
            out[name].append(value)
    return out


SIGNED = "doc_id long, n int, d1 long, d2 long, keys array<long>, s1 long, s2 long, level int, parity array<long>"


def _sets(columns: dict) -> dict:
    sets = [shingle_set(t) for t in row_bytes(columns["text"])]
    return {"id": columns["id"], "center": columns["center"], "n": list(map(len, sets)), "shingles": [s.tobytes() for s in sets]}


def _compared(columns: dict) -> dict:
    linked = []
    for a, b in zip(columns["mine"], columns["other"]):
        a, b = np.frombuffer(a.as_buffer(), np.uint64), np.frombuffer(b.as_buffer(), np.uint64)
        if len(a) > len(b):
            a, b = b, a
        both = int((b[np.minimum(np.searchsorted(b, a), len(b) - 1)] == a).sum())
        linked.append(100 * both >= 75 * (len(a) + len(b) - both))
    return {"a": columns["center"], "b": columns["id"], "linked": linked}


def sets_of(ids: DataFrame, texts: DataFrame) -> DataFrame:
    """``id, center, shingles`` of the rows ``id, center``.

    The ids grow with the corpus, so they meet the texts in a shuffle at every size.
    """
    met = texts.select(F.col("doc_id").alias("id"), "text").join(ids.hint("merge"), "id").select("id", "center", "text")
    return map_batches(met, "id long, center long, n int, shingles binary", _sets)


def _alike(met: DataFrame) -> DataFrame:
    return map_batches(met.select("center", "id", "mine", "other"), "a long, b long, linked boolean", _compared).filter("linked").select("a", "b")


def confirmed(pairs: DataFrame, texts: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Those of the pairs (``center``, ``id``) whose full sets are similar enough, as ``a, b``, and the sets used.

    Texts meet the pairs by document, are made sets there, and the sets meet by centre.  A much used
    centre stands on the right of that join, whose left side Spark can split.
    """
    ends = pairs.select("center", "id").union(pairs.select("center", F.col("center").alias("id")).distinct())
    sets = materialize(sets_of(ends, texts), "sets")
    mine = sets.filter("id <> center").select("id", "center", F.col("shingles").alias("mine"))
    other = sets.filter("id = center").select("center", F.col("shingles").alias("other"))
    return _alike(mine.join(other, "center")), sets


def confirmed_with(pairs: DataFrame, sets: DataFrame, texts: DataFrame) -> DataFrame:
    """The same for pairs whose sets are known for the most part; the others are made first."""
    known = sets.groupBy("id").agg(F.first("shingles").alias("shingles"))
    ends = pairs.select("id").union(pairs.select("center")).distinct()
    missing = materialize(ends.join(known.select("id"), "id", "left_anti").withColumn("center", F.lit(0).cast("long")), "missing")
    if not missing.isEmpty():
        known = known.union(texts.select(F.col("doc_id").alias("id"), "text").join(missing, "id").select("id", "center", "text")
                            .transform(lambda rows: map_batches(rows, "id long, center long, n int, shingles binary", _sets))
                            .select("id", "shingles"))
    met = pairs.join(known.select("id", F.col("shingles").alias("mine")), "id")
    return _alike(met.join(known.select(F.col("id").alias("center"), F.col("shingles").alias("other")), "center"))


def plausible(a: str, b: str):
    """Sizes within the bound and, of sets taken whole, parities (both exact); other sketches that agree well enough (4.5
    deviations and more)."""
    def x(name):
        return F.col(f"{a}.{name}")

    def y(name):
        return F.col(f"{b}.{name}")

    agree = F.lit(128) - F.bit_count(x("s1").bitwiseXOR(y("s1"))) - F.bit_count(x("s2").bitwiseXOR(y("s2")))
    differ = F.bit_count(x("p0").bitwiseXOR(y("p0")))
    for p in PARITIES[1:]:
        differ = differ + F.bit_count(x(p).bitwiseXOR(y(p)))
    unshared = (x("n") + y("n")) / 7.0 / F.pow(F.lit(2.0), x("level"))  # at most, at a similarity of 0.75
    places = 512 * (1 - F.pow(F.lit(1 - 2 / 1024), unshared))
    # Pairs of unshared shingles that share a place: about unshared^2 / 2048, each takes two away.
    own = F.least(unshared * math.sqrt(2 / 1024), F.lit(16.0))
    spread = F.sqrt(own * own + unshared)  # a sample adds its own; without one, no more places than shingles can differ
    return ((100 * F.least(x("n"), y("n")) >= 75 * F.greatest(x("n"), y("n"))) & (agree >= SKETCH_AGREES)
            & ((x("level") != y("level")) | (differ <= F.when(x("level") > 0, places + 5 * spread).otherwise(unshared + 1e-6))))


def _centred(buckets: DataFrame, facts: DataFrame, order) -> DataFrame:
    """Each member with its bucket's centre: the one that comes last by ``order``; plausible pairs only, each once."""
    centres = buckets.groupBy("key").agg(F.max_by(F.struct("id", "component"), order).alias("c"))
    pairs = (buckets.join(centres, "key").filter(F.col("component") != F.col("c.component"))
             .select(F.col("c.id").alias("center"), "id").distinct())
    return _filtered(pairs, facts)


def _filtered(pairs: DataFrame, facts: DataFrame) -> DataFrame:
    mine, other = facts.alias("m"), facts.alias("o")
    met = pairs.alias("x").join(mine, F.col("x.id") == F.col("m.id")).join(other, F.col("x.center") == F.col("o.id"))
    return met.filter(plausible("m", "o")).select("x.center", "x.id")


def _relabelled(buckets: DataFrame, labels: DataFrame) -> DataFrame:
    """Buckets with their members' components, without buckets of one component."""
    buckets = buckets.drop("component").join(labels, "id", "left").withColumn("component", F.coalesce("component", "id"))
    mixed = (buckets.groupBy("key").agg(F.min("component").alias("low"), F.max("component").alias("high"))
             .filter("low < high").select("key"))
    return buckets.join(mixed, "key", "left_semi")


def rows_and_components(docs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """All rows with their class's smallest id, and the components of those ids that have links."""
    rows = materialize(map_batches(docs, SIGNED, _signed_rows), "signed")
    some = rows.filter("d1 is not null and doc_id is not null")
    classes = some.groupBy("d1", "d2").agg(
        F.min("doc_id").alias("id"), F.first("n").alias("n"), F.first("keys").alias("keys"), F.first("s1").alias("s1"),
        F.first("s2").alias("s2"), F.first("level").alias("level"), F.first("parity").alias("parity"))
    classes = materialize(classes, "classes")
    facts = classes.select("id", "n", "s1", "s2", "level", *[F.get("parity", F.lit(k)).alias(p) for k, p in enumerate(PARITIES)])
    found = classes.select("id", F.explode("keys").alias("key"))
    shared = found.groupBy("key").agg(F.count(F.lit(1)).alias("size")).filter("size > 1")
    buckets = found.join(shared, "key")
    company = buckets.groupBy("id").agg(F.sum("size").alias("company"))
    buckets = materialize(buckets.join(company, "id").select("key", "id", "size", "company", F.col("id").alias("component")), "buckets")
    member = [F.col("company"), -F.col("id")]
    # rows that repeat an id with another text join their classes
    again = (some.groupBy("doc_id").agg(F.count_distinct("d1", "d2").alias("k")).filter("k > 1").select("doc_id")
             .join(some, "doc_id").join(classes.select("d1", "d2", "id"), ["d1", "d2"]).select(F.col("doc_id").alias("a"), F.col("id").alias("b")))
    pairs = materialize(_centred(buckets, facts, F.struct(*member)), "pairs")
    close, sets = confirmed(pairs, docs)
    links = materialize(close.union(again), "links")
    labels = components(links)
    left = materialize(_relabelled(buckets, labels), "buckets")
    members, rest = _pairs_left(left)
    tried = 0
    while members and rest > COMPARED * members and tried < 4:  # too many pairs to look at: other centres first
        tried += 1
        order = F.struct(F.xxhash64("key", "id", F.lit(tried)), F.col("id"))
        more = materialize(confirmed_with(materialize(_centred(left, facts, order), "pairs"), sets, docs), "links")
        links = links.union(more)
        labels = components(links)
        left = materialize(_relabelled(left, labels), "buckets")
        members, rest = _pairs_left(left)
    if members:  # all that is left
        both = left.join(facts, "id")
        a, b = both.alias("a"), both.alias("b")
        fits = plausible("a", "b")
        pairs = (a.join(b, (F.col("a.key") == F.col("b.key")) & (F.col("a.component") < F.col("b.component")) & fits)
                 .select(F.col("a.id").alias("center"), F.col("b.id").alias("id")).distinct())
        more = materialize(confirmed_with(materialize(pairs, "pairs"), sets, docs), "links")
        if not more.isEmpty():
            labels = components(links.union(more))
    return rows.join(classes.select("d1", "d2", "id"), ["d1", "d2"], "left").select("doc_id", "n", "id"), labels


def _pairs_left(buckets: DataFrame) -> tuple[int, float]:
    """Members of buckets, and pairs of different components in them."""
    sizes = (buckets.groupBy("key", "component").count()
             .groupBy("key").agg(F.sum("count").alias("n"), F.sum(F.col("count") * F.col("count")).alias("q")))
    members, rest = sizes.agg(F.sum("n"), F.sum((F.col("n") * F.col("n") - F.col("q")) / 2)).first()
    return members or 0, rest or 0


def near_duplicates(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """``doc_id, n_shingles, component_id, kept`` of every row.

    ``component_id`` is the smallest id that links reach; a row without words, or with a null id, is
    alone (component: its own id, or null) and kept.  Rows that repeat an id are one document: their links
    meet.  ``kept``: the row is its component's smallest id.  Other columns are not looked at.
    """
    rows, labels = rows_and_components(id_and_text(docs, doc_id, text))
    met = rows.join(labels, "id", "left")
    component = F.when(F.col("doc_id").isNotNull(), F.coalesce("component", "id", "doc_id"))
    return met.select("doc_id", F.col("n").cast("long").alias("n_shingles"), component.alias("component_id"),
                      (component.eqNullSafe(F.col("doc_id"))).alias("kept"))


def drop_near_duplicates(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """The rows of ``docs``, all columns, without those whose component has a smaller id; of rows that repeat an id all stay."""
    gone = near_duplicates(docs, doc_id, text).filter(~F.col("kept")).select(F.col("doc_id").alias("__gone")).distinct()
    return docs.join(gone, docs[doc_id].cast("long") == gone["__gone"], "left_anti")
