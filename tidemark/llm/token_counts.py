"""Token counts of whole texts by overlap resynchronisation.

Texts up to ``chunk`` characters are encoded at once.  A longer one is encoded in chunks that
overlap by ``overlap`` bytes.  Both encodings of an overlap carry offsets; the text is spliced
at a place where both have a token edge and which is proven stable: the place before the mark of a
space, behind a character that is none.  No piece of the vocabulary holds that mark behind another
character (checked when the model is loaded), so no merge ever crosses the place and the encoding
on either side of it does not depend on the other.  Where an overlap has no such place, it is
doubled, up to the end of the text.
"""

from __future__ import annotations

from functools import lru_cache

from pyspark.sql import DataFrame

from .common import id_and_text, map_batches, row_bytes, texts

SPACE_MARK = "▁"
MARK = SPACE_MARK.encode()


class PieceCounter:
    """Counts tokens of one model, without begin and end tokens."""

    def __init__(self, path: str, chunk: int, overlap: int) -> None:
        import sentencepiece
        self.model = sentencepiece.SentencePieceProcessor(model_file=path)
        self.chunk, self.overlap = chunk, overlap
        pieces = [self.model.id_to_piece(i) for i in range(self.model.get_piece_size())]
        self.edges_stable = not any(SPACE_MARK in p.lstrip(SPACE_MARK) for p in pieces)
        #: True if the model keeps all characters, so that offsets of chunks mean offsets of the text.
        self.keeps_text = self._keeps_text()

    def _keeps_text(self) -> bool:
        probe = "  a  b \n c"
        return self.model.decode(self.model.encode(probe)) == probe

    def count(self, batch: list[str]) -> list[int]:
        out: list = [0] * len(batch)
        plain = not (self.edges_stable and self.keeps_text)
        short = [k for k, t in enumerate(batch) if plain or len(t) <= self.chunk]
        for k, ids in zip(short, self.model.encode([batch[k] for k in short], num_threads=1)):
            out[k] = len(ids)
        for k in set(range(len(batch))).difference(short):
            out[k] = self.spliced(batch[k].encode())
        return out

    def edges(self, text: bytes, start: int, end: int) -> list[int]:
        """Where the tokens of ``text[start:end]`` begin, as offsets of ``text``.

        Every chunk but the first starts at a space, and the mark put before a text stands for it.
        """
        begin = start + 1 if start else 0
        spans = self.model.encode(text[begin:end].decode(), return_type="proto").pieces
        return [begin + s.begin if k or not start else start for k, s in enumerate(spans)]

    def spliced(self, text: bytes) -> int:
        """Tokens of a long text, chunk by chunk."""
        total, start, end = 0, 0, whole(text, self.chunk)
        here = self.edges(text, start, end)
        while end < len(text):
            width = self.overlap
            while True:  # a stable place where both encodings have an edge, else a wider overlap
                low, high = max(start + 1, end - width), whole(text, end + width)
                cut = self.splice(text, here, low, end, high)
                if cut is not None:
                    break
                if high == len(text) and low == start + 1:
                    return total + len(self.edges(text, start, len(text)))
                width *= 2
                end = high
                here = self.edges(text, start, end)
            total += sum(e < cut for e in here)
            start, end = cut, whole(text, cut + self.chunk)
            here = self.edges(text, start, end)
        return total + len(here)

    def splice(self, text: bytes, here: list[int], low: int, end: int, high: int) -> int | None:
        """The last stable place of ``text[low:end]`` at which the encoding from the first one on has an edge too."""
        at = text.find(b" ", low, end)
        while at >= 0 and not stable(text, at):
            at = text.find(b" ", at + 1, end)
        if at < 0:
            return None
        mine = {e for e in here if at <= e < end}
        both = [e for e in self.edges(text, at, high) if e in mine and stable(text, e)]
        return both[-1] if both else None


def whole(text: bytes, end: int) -> int:
    """``end`` or the next place that cuts no character, at most the end of the text."""
    while end < len(text) and text[end] & 0xC0 == 0x80:
        end += 1
    return min(end, len(text))


def stable(text: bytes, at: int) -> bool:
    """A lone space between two characters that no token has on both its sides."""
    behind = text[at + 1:at + 4]
    return (text[at:at + 1] == b" " and text[at - 1:at] not in (b"", b" ") and text[max(0, at - 3):at] != MARK
            and behind[:1] not in (b"", b" ") and behind != MARK)


@lru_cache(maxsize=2)
def counter(path: str, chunk: int, overlap: int) -> PieceCounter:
    return PieceCounter(path, chunk, overlap)


def drop_caches() -> None:
    counter.cache_clear()


def _counts(columns: dict, path: str, chunk: int, overlap: int, limit: int) -> dict:
    n = counter(path, chunk, overlap).count(texts(columns["text"]))
    return {"doc_id": columns["doc_id"], "n_bytes": [len(b) for b in row_bytes(columns["text"])], "n_tokens": n,
            "over_limit": [x > limit for x in n]}


def count_tokens(docs: DataFrame, path: str, limit: int = 4096, chunk: int = 65536, overlap: int = 2048,
                 doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """``doc_id, n_bytes, n_tokens, over_limit`` of every row, in no shuffle.

    ``path`` is a sentencepiece model.  A null or empty text has no bytes and no tokens; null and
    repeated ids are kept as they are; other columns are not looked at.
    """
    schema = "doc_id long, n_bytes long, n_tokens long, over_limit boolean"
    return map_batches(id_and_text(docs, doc_id, text), schema, _counts, path, chunk, overlap, limit)
