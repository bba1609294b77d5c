"""Byte-level BPE encoding and decoding with a segment tree over byte positions.

A word (one match of the splitting pattern) starts as its bytes.  Position ``i`` holds the rank of
the pair of the token at ``i`` and the next live one; a segment tree over the positions holds the
leftmost minimum, so the root names the next merge.  A merge changes three leaves (the left token,
its neighbour before it, and the one that goes), each a logarithmic point update.  Words of like
length share numpy trees, one row each; a long word has a tree of its own in plain lists.
"""

from __future__ import annotations

import base64
import gc
import hashlib
import re
from functools import lru_cache

import numpy as np
import regex
from pyspark.sql import DataFrame

from .common import id_and_text, map_batches, texts

NONE = np.iinfo(np.int64).max
LONG_WORD = 128  # bytes; longer words get a tree of their own
CACHED_CHUNKS = 1_400_000
HELD_CHUNKS = 250_000  # of an ``Encoder``, which shares an executor with what earlier stages left behind
#: A space that has white space on both sides (or before it and the end behind it) may lie inside a match.
#: Letters, then punctuation: two matches, whatever stands around.
WORD_AND_MARKS = re.compile(r"([A-Za-zÀ-ÖØ-öø-ɏ]+)([!-/:-@\[-`{-~]+)").fullmatch
UNSURE_SPACE = re.compile(r"\s (?:\s|\Z)")


class Ranks:
    """A vocabulary of ranks; the rank of a token is its id."""

    def __init__(self, path: str) -> None:
        with open(path, "rb") as lines:
            self.ids = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
        self.tokens = [b""] * (max(self.ids.values()) + 1)
        for token, i in self.ids.items():
            self.tokens[i] = token
        self.decimal = [str(i) for i in range(len(self.tokens))]
        self.byte_ids = np.array([self.ids[bytes([b])] for b in range(256)], dtype=np.int64)
        get, pairs = self.ids.get, {}
        for token, i in self.ids.items():
            for cut in range(1, len(token)):
                a, b = get(token[:cut]), get(token[cut:])
                if a is not None and b is not None:
                    pairs[a << 32 | b] = i
        self.pairs = pairs
        self.keys = np.array(sorted(pairs), dtype=np.int64)
        self.merged = np.array([pairs[k] for k in self.keys.tolist()], dtype=np.int64)

    def rank(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Rank of each pair, NONE where the pair is no token."""
        key = left << 32 | right
        at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
        return np.where(self.keys[at] == key, self.merged[at], NONE)

    def encode_words(self, words: list[bytes]) -> list[bytes]:
        """Ids of each word, as unsigned 32-bit numbers."""
        out: list = [b""] * len(words)
        classes: dict[int, list[int]] = {}
        get = self.ids.get
        for k, word in enumerate(words):
            known = get(word)
            if known is not None:
                out[k] = known.to_bytes(4, "little")
            elif len(word) > LONG_WORD:
                out[k] = np.array(self._long_word(word), dtype="<u4").tobytes()
            elif word:
                classes.setdefault(max(1, (len(word) - 1).bit_length()), []).append(k)
        for depth, members in classes.items():
            for at in range(0, len(members), 8192):
                part = members[at:at + 8192]
                ids, ends = self._words([words[k] for k in part], depth)
                start = 0
                for k, end in zip(part, ends):
                    out[k] = ids[start:end]
                    start = end
        return out

    def _words(self, words: list[bytes], depth: int) -> tuple[bytes, list[int]]:
        """Words of at most ``2 ** depth`` bytes, one row of every array for each word."""
        size, rows = 1 << depth, len(words)
        lengths = np.fromiter(map(len, words), np.int64, rows)
        places = np.arange(size)
        inside = places < lengths[:, None]
        token = np.full((rows, size), -1, dtype=np.int64)
        token[inside] = self.byte_ids[np.frombuffer(b"".join(words), np.uint8)]
        after = np.broadcast_to(places + 1, (rows, size)).copy()
        after[np.arange(rows), lengths - 1] = size  # the end
        before = np.broadcast_to(places - 1, (rows, size)).copy()
        tree = np.full((rows, 2 * size), NONE, dtype=np.int64)
        r, c = np.nonzero(places < lengths[:, None] - 1)
        rank = self.rank(token[r, c], token[r, c + 1])
        tree[r, size + c] = np.where(rank == NONE, NONE, rank * size + c)
        for level in range(depth - 1, -1, -1):
            a = tree[:, 2 << level:4 << level]
            tree[:, 1 << level:2 << level] = np.minimum(a[:, ::2], a[:, 1::2])
        token, after, before, tree = token.ravel(), after.ravel(), before.ravel(), tree.ravel()

        live = np.nonzero(tree[1::2 * size] != NONE)[0]
        while len(live):
            base, root_of = live * size, live * (2 * size)
            root = tree[root_of + 1]
            at = root % size
            here = base + at
            gone = after[here]
            behind = after[base + gone]
            token[here] = root // size
            token[base + gone] = -1
            after[here] = behind
            tree[root_of + size + gone] = tree[root_of + size + at] = NONE
            some = np.nonzero(behind < size)[0]  # a pair with the token behind
            near, far = here[some], base[some] + behind[some]
            before[far] = at[some]
            rank = self.rank(token[near], token[far])
            tree[root_of[some] + size + at[some]] = np.where(rank == NONE, NONE, rank * size + at[some])
            left = before[here]
            some = np.nonzero(left >= 0)[0]  # a pair with the token before
            ahead = left[some]
            rank = self.rank(token[base[some] + ahead], token[here[some]])
            tree[root_of[some] + size + ahead] = np.where(rank == NONE, NONE, rank * size + ahead)
            node = np.concatenate([size + gone, size + at, size + ahead])
            tree_of = np.concatenate([root_of, root_of, root_of[some]])
            for _ in range(depth):  # the three point updates, level by level
                node = node >> 1
                low = tree_of + 2 * node
                tree[tree_of + node] = np.minimum(tree[low], tree[low + 1])
            live = live[tree[root_of + 1] != NONE]
        kept = token >= 0
        return token[kept].astype("<u4").tobytes(), (4 * np.cumsum(kept.reshape(rows, size).sum(axis=1))).tolist()

    def _long_word(self, word: bytes) -> list[int]:
        """The same for one long word."""
        n, get, none = len(word), self.pairs.get, int(NONE)
        size = 1 << (n - 1).bit_length()
        token = self.byte_ids[np.frombuffer(word, np.uint8)].tolist()
        after, before = [*range(1, n), -1], list(range(-1, n - 1))
        tree = [none] * (2 * size)
        for i in range(n - 1):
            rank = get(token[i] << 32 | token[i + 1])
            if rank is not None:
                tree[size + i] = rank * size + i
        for node in range(size - 1, 0, -1):
            tree[node] = min(tree[2 * node], tree[2 * node + 1])

        def put(place: int, value: int) -> None:
            node = place + size
            tree[node] = value
            while node > 1:
                value = min(value, tree[node ^ 1])
                node >>= 1
                if tree[node] == value:
                    break
                tree[node] = value

        while tree[1] != none:
            rank, i = divmod(tree[1], size)
            gone = after[i]
            k = after[gone]
            token[i], token[gone], after[i] = rank, -1, k
            put(gone, none)
            rank = None
            if k >= 0:
                before[k] = i
                rank = get(token[i] << 32 | token[k])
            put(i, none if rank is None else rank * size + i)
            if (p := before[i]) >= 0:
                rank = get(token[p] << 32 | token[i])
                put(p, none if rank is None else rank * size + p)
        return [t for t in token if t >= 0]

    def decode(self, ids: list[int]) -> bytes:
        return b"".join(map(self.tokens.__getitem__, ids))


class ChunkCache:
    """Ids of texts through the ids of their chunks, as unsigned 32-bit numbers.

    A match of the splitting pattern holds white space only at its start, or is white space as a
    whole.  So a space begins a new match unless white space lies on both sides of it, and a text
    can be cut before its spaces.  ``encode_chunks`` gets each new chunk once, ``encode_whole``
    the texts that cannot be cut surely.
    """

    def __init__(self, encode_chunks, encode_whole, whole_if: str = "", most: int = CACHED_CHUNKS) -> None:
        self.known: dict[str, bytes] = {}  # of the chunks behind a space
        self.first: dict[str, bytes] = {}  # of the chunks at a text's start
        self.encode_chunks, self.encode_whole, self.whole_if, self.most = encode_chunks, encode_whole, whole_if, most

    def encode(self, batch: list[str]) -> list[np.ndarray]:
        gc.disable()  # many small objects and no cycles
        try:
            return self._encode(batch)
        finally:
            gc.enable()

    def _encode(self, batch: list[str]) -> list[np.ndarray]:
        known, out, at = self.known, [], 0
        while at < len(batch):  # a few megabytes at a time
            for cache in (known, self.first):
                if len(cache) > self.most:
                    cache.clear()
            end, size = at, 0
            while end < len(batch) and (end == at or size < 4_000_000):
                size += len(batch[end])
                end += 1
            cut = [None if UNSURE_SPACE.search(t) or (self.whole_if and self.whole_if in t) else t.split(" ")
                   for t in batch[at:end]]
            found, new, starts = [], set(), set()
            for pieces in cut:  # each piece is looked up once; those not known are filled in below
                ids = [] if pieces is None else list(map(known.get, pieces))
                if ids:
                    ids[0] = b""
                    starts.add(pieces[0])
                if None in ids:
                    new.update([p for p, i in zip(pieces, ids) if i is None])
                found.append(ids)
            parted = {p: m.groups() for p in new if (m := WORD_AND_MARKS(p))}
            new = list(({p for p in new if p not in parted} | {w for w, _ in parted.values()}).difference(known))
            starts = [p for p in starts.union(m for _, m in parted.values()) if p not in self.first]
            known.update(zip(new, self.encode_chunks([" " + p for p in new])))
            self.first.update(zip(starts, self.encode_chunks(starts)))
            for p, (word, marks) in parted.items():
                known[p] = known[word] + self.first[marks]
            for text, pieces, parts in zip(batch[at:end], cut, found):
                if pieces:
                    if None in parts:
                        parts = [known[p] if i is None else i for p, i in zip(pieces, parts)]
                    parts[0] = self.first[pieces[0]]
                ids = self.encode_whole(text) if pieces is None else b"".join(parts)
                out.append(np.frombuffer(ids, dtype="<u4"))
            at = end
        return out


class Encoder:
    """Whole texts to ids and back."""

    def __init__(self, path: str, pattern: str) -> None:
        self.ranks, self.matches = Ranks(path), regex.compile(pattern).findall
        self.cache = ChunkCache(self.encode_chunks, lambda t: self.encode_chunks([t])[0], most=HELD_CHUNKS)

    def encode_chunks(self, chunks: list[str]) -> list[bytes]:
        split = [[c] if c[1:].isalpha() and c.isascii() and (c[0] == " " or c[0].isalpha()) else self.matches(c)
                 for c in chunks]  # letters behind a space are one match
        words = list({w for ws in split for w in ws})
        ids = dict(zip(words, self.ranks.encode_words([w.encode() for w in words])))
        return [ids[ws[0]] if len(ws) == 1 else b"".join([ids[w] for w in ws]) for ws in split]


@lru_cache(maxsize=2)
def encoder(path: str, pattern: str) -> Encoder:
    return Encoder(path, pattern)


def drop_caches() -> None:
    encoder.cache_clear()


def _digests(columns: dict, path: str, pattern: str) -> dict:
    code = encoder(path, pattern)
    out: dict[str, list] = {"doc_id": columns["doc_id"], "n_tokens": [], "ids_sha256": [], "decoded_sha256": []}
    for ids in map(np.ndarray.tolist, code.cache.encode(texts(columns["text"]))):
        out["n_tokens"].append(len(ids))
        out["ids_sha256"].append(hashlib.sha256(" ".join(map(code.ranks.decimal.__getitem__, ids)).encode()).hexdigest())
        out["decoded_sha256"].append(hashlib.sha256(code.ranks.decode(ids)).hexdigest())
    return out


def _ids(columns: dict, path: str, pattern: str) -> dict:
    return {"doc_id": columns["doc_id"], "ids": encoder(path, pattern).cache.encode(texts(columns["text"]))}


def _decoded(columns: dict, path: str, pattern: str) -> dict:
    ranks = encoder(path, pattern).ranks
    return {"doc_id": columns["doc_id"], "decoded": [ranks.decode(i or []) for i in columns["ids"].to_pylist()]}


def encode(docs: DataFrame, path: str, pattern: str, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """``doc_id, ids``: the ids of every whole text.

    One row for each row, in no shuffle; a null or empty text has no ids, a null or repeated
    doc_id is kept as it is, and other columns are not looked at.
    """
    return map_batches(id_and_text(docs, doc_id, text), "doc_id long, ids array<int>", _ids, path, pattern)


def decode(encoded: DataFrame, path: str, pattern: str) -> DataFrame:
    """``doc_id, decoded``: the bytes of every row of ``encode``; null ids give no bytes."""
    return map_batches(encoded.select("doc_id", "ids"), "doc_id long, decoded binary", _decoded, path, pattern)


def round_trip(docs: DataFrame, path: str, pattern: str, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """``doc_id, n_tokens, ids_sha256, decoded_sha256``: encode, then decode the ids; edge cases as in ``encode``."""
    schema = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string"
    return map_batches(id_and_text(docs, doc_id, text), schema, _digests, path, pattern)
