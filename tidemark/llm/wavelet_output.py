"""Token ids as wavelet-matrix files.

Documents are range-partitioned by id, so partitions follow each other in id order; each is cut
into shards of about ``shard_tokens`` ids, and each shard becomes one file image, kept as one binary
cell of a Parquet table (so that any store that Spark can write will do).

File format, little-endian: magic ``WMX1``; unsigned 32-bit number of bit planes; unsigned 64-bit
number of ids, of documents; per document the signed 64-bit doc_id (the smallest number stands for
null) and unsigned 64-bit number of its ids; then for each plane, highest bit first, the unsigned
64-bit count of zeros, one unsigned 32-bit number of ones before every 512 bits, and the bits,
packed, the first in the lowest bit.  Each plane is stably partitioned by its bit for the next.
"""

from __future__ import annotations

import os
import struct
import zlib
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, functions as F

from ..session import scratch_path
from .byte_bpe import ChunkCache
from .common import id_and_text, map_arrow, map_batches, texts

MAGIC = b"WMX1"
BLOCK = 512
NO_ID = -(1 << 63)
SHARD_SCHEMA = "part int, seq long, start_in_part long, n_docs long, n_tokens long, file binary"


class WaveletMatrix:
    """Succinct ids: access, rank (count), select (occurrences)."""

    def __init__(self, n: int, planes: list[tuple[int, np.ndarray, np.ndarray]]) -> None:
        self.n, self.planes = n, planes  # zeros, ones before each block, packed bits

    @staticmethod
    def build(ids: np.ndarray) -> WaveletMatrix:
        bits = max(1, int(ids.max()).bit_length()) if len(ids) else 1
        ids = ids.astype(np.uint16 if bits <= 16 else np.uint32)
        planes = []
        for b in range(bits - 1, -1, -1):
            one = (ids & ids.dtype.type(1 << b)).astype(bool)
            packed = np.packbits(one, bitorder="little")
            padded = np.zeros(-(-len(one) // BLOCK) * (BLOCK // 8), np.uint8)
            padded[:len(packed)] = packed
            per_block = np.bitwise_count(padded).reshape(-1, BLOCK // 8).sum(axis=1, dtype=np.uint32)
            before = np.concatenate([[0], np.cumsum(per_block)]).astype("<u4")
            planes.append((len(ids) - int(before[-1]), before, packed))
            ids = np.concatenate([ids.compress(~one), ids.compress(one)])
        return WaveletMatrix(len(ids), planes)

    def _ones(self, plane: int, at: int) -> int:
        """Ones among the first ``at`` bits of a plane."""
        _, before, packed = self.planes[plane]
        block = at // BLOCK
        low = block * (BLOCK // 8)
        part = packed[low:at // 8]
        rest = int(packed[at // 8]) & ((1 << at % 8) - 1) if at % 8 else 0
        return int(before[block]) + int(np.bitwise_count(part).sum()) + rest.bit_count()

    def access(self, at: int) -> int:
        value = 0
        for p, (zeros, _, packed) in enumerate(self.planes):
            bit = int(packed[at // 8]) >> at % 8 & 1
            ones = self._ones(p, at)
            value, at = value << 1 | bit, zeros + ones if bit else at - ones
        return value

    def _range(self, value: int, end: int) -> tuple[int, int]:
        """Where ``value`` lies below the last plane, among the first ``end`` ids."""
        if value >> len(self.planes):
            return 0, 0
        low, high = 0, end
        for p, (zeros, _, _) in enumerate(self.planes):
            a, b = self._ones(p, low), self._ones(p, high)
            low, high = (zeros + a, zeros + b) if value >> (len(self.planes) - 1 - p) & 1 else (low - a, high - b)
        return low, high

    def count(self, value: int, end: int | None = None) -> int:
        """How often ``value`` occurs among the first ``end`` ids."""
        low, high = self._range(value, self.n if end is None else end)
        return high - low

    def occurrence(self, value: int, k: int) -> int:
        """Place of the ``k``-th ``value``, counted from 0; IndexError if there is none."""
        low, high = self._range(value, self.n)
        if not 0 <= k < high - low:
            raise IndexError(k)
        at = low + k
        for p in range(len(self.planes) - 1, -1, -1):
            zeros = self.planes[p][0]
            one = value >> (len(self.planes) - 1 - p) & 1
            at = self._select(p, one, at - zeros if one else at)
        return at

    def _select(self, plane: int, one: int, k: int) -> int:
        """Place of the ``k``-th bit that is ``one``."""
        _, before, packed = self.planes[plane]
        counts = before if one else np.arange(len(before), dtype=np.int64) * BLOCK - before
        block = int(np.searchsorted(counts, k, side="right")) - 1
        bits = np.unpackbits(packed[block * (BLOCK // 8):(block + 1) * (BLOCK // 8)], bitorder="little")
        return block * BLOCK + int(np.flatnonzero(bits == one)[k - int(counts[block])])

    def all_ids(self) -> np.ndarray:
        """All ids in their order, plane by plane from the lowest bit."""
        kind = np.uint16 if len(self.planes) <= 16 else np.uint32
        ids = np.zeros(self.n, dtype=kind)
        for b, (zeros, _, packed) in enumerate(reversed(self.planes)):
            one = np.unpackbits(packed, count=self.n, bitorder="little").view(bool)
            out = np.empty_like(ids)
            out[~one] = ids[:zeros]
            out[one] = ids[zeros:] | kind(1 << b)
            ids = out
        return ids


def write_file(doc_ids: list, lengths: list[int], ids: np.ndarray) -> bytes:
    matrix = WaveletMatrix.build(ids)
    parts = [MAGIC, struct.pack("<IQQ", len(matrix.planes), matrix.n, len(doc_ids)),
             np.array([NO_ID if d is None else d for d in doc_ids], dtype="<i8").tobytes(), np.array(lengths, dtype="<u8").tobytes()]
    for zeros, before, packed in matrix.planes:
        parts += [struct.pack("<Q", zeros), before.tobytes(), packed.tobytes()]
    return b"".join(parts)


def read_file(data: bytes) -> tuple[list, np.ndarray, WaveletMatrix]:
    """Document ids, number of ids of each document, and the matrix."""
    if data[:4] != MAGIC:
        raise ValueError("not a token file")
    bits, n, docs = struct.unpack_from("<IQQ", data, 4)
    at = 24
    doc_ids = [None if d == NO_ID else d for d in np.frombuffer(data, "<i8", docs, at).tolist()]
    lengths = np.frombuffer(data, "<u8", docs, at + 8 * docs).astype(np.int64)
    at += 16 * docs
    blocks, size, planes = -(-n // BLOCK) + 1, -(-n // 8), []
    for _ in range(bits):
        zeros = struct.unpack_from("<Q", data, at)[0]
        planes.append((zeros, np.frombuffer(data, "<u4", blocks, at + 8), np.frombuffer(data, np.uint8, size, at + 8 + 4 * blocks)))
        at += 8 + 4 * blocks + size
    return doc_ids, lengths, WaveletMatrix(n, planes)


class LibraryEncoder:
    """The tokenizers library, asked once for each chunk of text (cut where no token can lie across)."""

    def __init__(self, path: str) -> None:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer
        self.library = Tokenizer.from_file(path)
        vocabulary = self.library.get_vocab()
        self.begins = np.zeros(max(vocabulary.values(), default=0) + 1, bool)  # tokens that begin with a space, written as G with a dot
        self.begins[[i for t, i in vocabulary.items() if t.startswith("\u0120")]] = True
        special = [t.content for t in self.library.get_added_tokens_decoder().values()]
        if len(special) == 1 and " " not in special[0]:
            self.cache = ChunkCache(self.encode, lambda t: self.encode([t])[0], special[0])
            self.encode_texts = self.cache.encode
        else:
            self.encode_texts = lambda batch: [np.frombuffer(i, "<u4") for i in self.encode(batch)]

    def encode(self, batch: list[str]) -> list[bytes]:
        """Chunks behind a space go to the library many at a time, as one text, whose ids part where a token begins with the space."""
        out: list = [b""] * len(batch)
        behind = [k for k, t in enumerate(batch) if t[:1] == " " and not (t[1:2].isspace() or t[-1].isspace()) and t.count(" ") == 1]
        rest = set(range(len(batch))).difference(behind)
        for at in range(0, len(behind), 200):
            part = behind[at:at + 200]
            found = self.library.encode_batch_fast(["".join([batch[k] for k in part])], add_special_tokens=False)[0]
            ids = np.array(found.ids, dtype="<u4")
            cuts = np.flatnonzero(self.begins[ids]).tolist()
            if len(cuts) != len(part) or cuts[0]:
                rest.update(part)
                continue
            ids = ids.tobytes()
            for k, a, b in zip(part, cuts, [*cuts[1:], len(found.ids)]):
                out[k] = ids[4 * a:4 * b]
        rest = sorted(rest)
        for k, e in zip(rest, self.library.encode_batch_fast([batch[k] for k in rest], add_special_tokens=False)):
            out[k] = np.array(e.ids, dtype="<u4").tobytes()
        return out


@lru_cache(maxsize=2)
def library_encoder(path: str) -> LibraryEncoder:
    return LibraryEncoder(path)


def drop_caches() -> None:
    library_encoder.cache_clear()


def _shards(batches, path: str, end_id: int, shard_tokens: int):
    encode = library_encoder(path).encode_texts
    part, seq, start = TaskContext.get().partitionId(), 0, 0
    doc_ids, pieces, size = [], [], 0

    def image():
        lengths = [len(p) for p in pieces]
        return pa.RecordBatch.from_pydict({
            "part": pa.array([part], pa.int32()), "seq": pa.array([seq], pa.int64()),
            "start_in_part": pa.array([start], pa.int64()), "n_docs": pa.array([len(doc_ids)], pa.int64()),
            "n_tokens": pa.array([size], pa.int64()),
            "file": pa.array([write_file(doc_ids, lengths, np.concatenate(pieces))], pa.binary())})

    for batch in batches:
        end = np.array([end_id], dtype=np.uint32)
        for doc, ids in zip(batch.column(0).to_pylist(), encode(texts(batch.column(1)))):
            ids = np.concatenate([ids, end])
            if size and size + len(ids) > shard_tokens:
                yield image()
                seq, start = seq + 1, start + size
                doc_ids, pieces, size = [], [], 0
            doc_ids.append(doc)
            pieces.append(ids)
            size += len(ids)
    if size:
        yield image()


def write_token_files(docs: DataFrame, out: str, tokenizer: str, end_id: int = 0, shard_tokens: int = 2_000_000,
                      doc_id: str = "doc_id", text: str = "text") -> None:
    """Write the ids of every whole text, ``end_id`` behind each, in ascending order of doc_id, to the table ``out``.

    Null ids come first; rows that repeat an id lie side by side in an order left open; a null or
    empty text has only the end id; no rows make an empty table.  A shard holds at least one
    document, so a text longer than a shard has one of its own.
    """
    texts = id_and_text(docs, doc_id, text)
    placed = texts.repartitionByRange(F.col("doc_id")).sortWithinPartitions("doc_id")
    map_arrow(placed, lambda b: _shards(b, tokenizer, end_id, shard_tokens), SHARD_SCHEMA).write.parquet(out)


def _read(columns: dict) -> dict:
    out: dict[str, list] = {"doc_id": [], "start": [], "n_tokens": [], "ids_crc32": []}
    for data, start in zip(columns["file"].to_pylist(), columns["start"].to_pylist()):
        doc_ids, lengths, matrix = read_file(data)
        ids = matrix.all_ids().astype("<u4")
        ends = np.cumsum(lengths)
        for doc, n, end in zip(doc_ids, lengths.tolist(), ends.tolist()):
            out["doc_id"].append(doc)
            out["start"].append(start + end - n)
            out["n_tokens"].append(n)
            out["ids_crc32"].append(zlib.crc32(ids[end - n:end].tobytes()))
    return out


def read_token_files(spark, path: str) -> DataFrame:
    """``doc_id, start, n_tokens, ids_crc32`` of every document in the files.

    Only one number for each range partition (not for each file) goes through the driver.
    """
    files = spark.read.schema(SHARD_SCHEMA).parquet(path)
    sizes = files.groupBy("part").agg(F.sum("n_tokens").alias("n")).orderBy("part").collect()
    starts, total = {}, 0
    for r in sizes:
        starts[r.part], total = total, total + r.n
    placed = files.select("file", (_lookup(starts) + F.col("start_in_part")).alias("start"))
    return map_batches(placed, "doc_id long, start long, n_tokens long, ids_crc32 long", _read)


def _lookup(starts: dict[int, int]):
    """Ids before each partition, by its number: an array, as partitions are numbered from 0."""
    last = max(starts, default=0)
    row, known = [], 0
    for p in range(last + 1):
        known = starts.get(p, known)
        row.append(str(known))
    return F.element_at(F.split(F.lit(",".join(row)), ",").cast("array<bigint>"), F.col("part") + 1)


def token_files(docs: DataFrame, tokenizer: str, end_id: int = 0, out: str | None = None, **options) -> DataFrame:
    """Write the files and read them back; ``out`` is a fresh folder below the shared scratch folder by default."""
    spark = docs.sparkSession
    out = out or scratch_path(spark, "token_files")
    write_token_files(docs, out, tokenizer, end_id, **options)
    return read_token_files(spark, out)
