"""Merge-type pieces by a prefix table.

The merges of a text end in a row of pieces of which each two neighbours, taken alone, would end as
just these two; and a row of pieces with that property is the only one.  So every prefix of a word
has one last piece: the piece that ends there (the automaton of all pieces finds those) and goes
together with the last piece of the prefix before it.  The table is filled from left to right, and
the ids are read from its end backwards.

Words are cut where no piece can lie on both sides: between two characters that stand side by side
in no piece.  Whether two pieces go together is found by merging the two alone, and kept.
"""

from __future__ import annotations

import gc
import hashlib
import re
from functools import lru_cache

import ahocorasick
import numpy as np
from pyspark.sql import DataFrame

from .common import id_and_text, map_batches, texts

MARK = "▁"  # a space inside pieces
CACHED = 400_000  # words, and as many parts of words, kept by a worker
CACHED_PAIRS = 800_000
LONGEST_KEPT = 64  # longer words are not kept
#: A run of marks and the characters behind it; no piece has a mark behind another character.
WORDS = re.compile(f"{MARK}*[^{MARK}]+|{MARK}+").findall


class Pieces:
    """A model of merge type with byte fallback, read through the library's accessors."""

    def __init__(self, path: str) -> None:
        import sentencepiece
        model = sentencepiece.SentencePieceProcessor(model_file=path)
        every = range(model.get_piece_size())
        self.text = [model.id_to_piece(i) for i in every]
        plain = [i for i in every if not (model.is_control(i) or model.is_unknown(i) or model.is_byte(i) or model.is_unused(i))]
        self.ids = {self.text[i]: i for i in plain}
        self.score = {self.text[i]: model.get_score(i) for i in plain}
        self.byte_ids = [model.piece_to_id(f"<0x{b:02X}>") for b in range(256)]
        self.end = model.eos_id()
        self.bytes = [b""] * len(self.text)
        for i in plain:
            self.bytes[i] = self.text[i].replace(MARK, " ").encode()
        for b, i in enumerate(self.byte_ids):
            self.bytes[i] = bytes([b])
        if model.unk_id() in self.byte_ids or any(MARK in p.lstrip(MARK) for p in self.ids) or model.decode(model.encode("  a  b ")) != "  a  b ":
            raise ValueError("the model has no byte pieces, loses spaces, or has pieces with a space behind another character")
        self.side_by_side = {p[i:i + 2] for p in self.ids for i in range(len(p) - 1)}
        self.pairs: dict[int, bool] = {}
        self.words: dict[str, bytes] = {}
        self.parts: dict[str, list[int]] = {}
        self.automaton = ahocorasick.Automaton()
        for piece, i in self.ids.items():
            if self.merged(piece) == [i]:  # others can never be the end of merging
                self.automaton.add_word(piece, (i, len(piece)))
        self.automaton.make_automaton()

    def merged(self, text: str) -> list[int]:
        """Ids by merging the best pair again and again, the leftmost of equal ones: only for a few characters."""
        parts, score = list(text), self.score.get
        while len(parts) > 1:
            best, at = None, -1
            for i in range(len(parts) - 1):
                s = score(parts[i] + parts[i + 1])
                if s is not None and (best is None or s > best):
                    best, at = s, i
            if best is None:
                break
            parts[at:at + 2] = [parts[at] + parts[at + 1]]
        return [self.ids.get(p, -1) for p in parts]

    def together(self, left: int, right: int) -> bool:
        """Whether merging both alone ends as just these two."""
        key = left << 32 | right
        known = self.pairs.get(key)
        if known is None:
            if len(self.pairs) > CACHED_PAIRS:
                self.pairs.clear()
            known = self.pairs[key] = self.merged(self.text[left] + self.text[right]) == [left, right]
        return known

    def prefix_table(self, part: str) -> list[int]:
        """Ids of one part through the last piece of each of its prefixes."""
        n = len(part)
        last, size, get = [-1] * (n + 1), [0] * (n + 1), self.pairs.get
        for end, (i, length) in self.automaton.iter(part):
            end += 1
            if size[end]:
                continue
            start = end - length
            if start:
                if not size[start]:
                    continue
                known = get(last[start] << 32 | i)
                if not (self.together(last[start], i) if known is None else known):
                    continue
            last[end], size[end] = i, length
        if not size[n]:  # a part is cut at every unknown character, so this means a vocabulary that has no such table
            raise ValueError(f"no last piece for {part[:40]!r}")
        out = []
        while n:
            out.append(last[n])
            n -= size[n]
        out.reverse()
        return out

    def cut(self, word: str) -> list[str]:
        """Parts between characters that stand side by side in no piece."""
        beside = self.side_by_side
        at = [0, *[i for i in range(1, len(word)) if word[i - 1:i + 1] not in beside], len(word)]
        return [word[a:b] for a, b in zip(at, at[1:])]

    def word(self, word: str) -> bytes:
        """Ids of one word as unsigned 32-bit numbers."""
        out: list[int] = []
        for part in self.cut(word):
            ids = self.parts.get(part)
            if ids is None:
                if len(part) == 1 and part not in self.ids:
                    ids = [self.byte_ids[b] for b in part.encode()]
                else:
                    ids = self.prefix_table(part)
                if len(part) <= LONGEST_KEPT:
                    self.parts[part] = ids
            out += ids
        return np.array(out, dtype="<u4").tobytes()

    def encode(self, batch: list[str]) -> list[np.ndarray]:
        """Ids of whole texts, the end id behind each."""
        end, out, words = np.array([self.end], dtype="<u4").tobytes(), [], self.words
        gc.disable()  # many small objects and no cycles
        try:
            for text in batch:
                if len(words) > CACHED or len(self.parts) > CACHED:
                    words.clear()
                    self.parts.clear()
                found = []
                for w in WORDS(MARK + text.replace(" ", MARK)) if text else ():
                    ids = words.get(w)
                    if ids is None:
                        ids = self.word(w)
                        if len(w) <= LONGEST_KEPT:
                            words[w] = ids
                    found.append(ids)
                out.append(np.frombuffer(b"".join(found) + end, dtype="<u4"))
        finally:
            gc.enable()
        return out

    def decode(self, ids: list[int]) -> bytes:
        """UTF-8 text of ids: the mark put before a text goes, other marks are spaces, the end id is nothing."""
        joined = b"".join(map(self.bytes.__getitem__, ids))
        if ids and self.text[ids[0]].startswith(MARK):
            joined = joined[1:]
        return joined.decode("utf-8", "replace").encode()


@lru_cache(maxsize=2)
def pieces(path: str) -> Pieces:
    return Pieces(path)


def drop_caches() -> None:
    pieces.cache_clear()


def _digests(columns: dict, path: str) -> dict:
    model = pieces(path)
    out: dict[str, list] = {"doc_id": columns["doc_id"], "n_tokens": [], "ids_sha256": [], "decoded_sha256": []}
    for ids in map(np.ndarray.tolist, model.encode(texts(columns["text"]))):
        out["n_tokens"].append(len(ids))
        out["ids_sha256"].append(hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest())
        out["decoded_sha256"].append(hashlib.sha256(model.decode(ids)).hexdigest())
    return out


def _ids(columns: dict, path: str) -> dict:
    return {"doc_id": columns["doc_id"], "ids": pieces(path).encode(texts(columns["text"]))}


def _decoded(columns: dict, path: str) -> dict:
    model = pieces(path)
    return {"doc_id": columns["doc_id"], "text": [model.decode(i or []).decode() for i in columns["ids"].to_pylist()]}


def encode(docs: DataFrame, path: str, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """``doc_id, ids``: the ids of every whole text and the end id.

    One row for each row, in no shuffle; a null or empty text has the end id alone, null and repeated
    ids are kept as they are, names of control pieces inside texts are ordinary text, and other
    columns are not looked at.  ``path`` is a model of merge type with byte fallback that keeps all characters.
    """
    return map_batches(id_and_text(docs, doc_id, text), "doc_id long, ids array<int>", _ids, path)


def decode(encoded: DataFrame, path: str) -> DataFrame:
    """``doc_id, text`` of every row of ``encode``; null ids give an empty text."""
    return map_batches(encoded.select("doc_id", "ids"), "doc_id long, text string", _decoded, path)


def round_trip(docs: DataFrame, path: str, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """``doc_id, n_tokens, ids_sha256, decoded_sha256``: encode, then decode the ids; edge cases as in ``encode``."""
    schema = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string"
    return map_batches(id_and_text(docs, doc_id, text), schema, _digests, path)
