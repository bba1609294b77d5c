"""Fixed-layout binary records: recycle-bin notes, change-journal pages, file-table entries.

Spark splits and distributes the pages; inside a task numpy views find and slice the records
of one Arrow batch at a time.
"""

from __future__ import annotations

import os
from collections.abc import Callable, Iterator
from pathlib import Path

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession, functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, InputPartition

from ..functions.bytescols import le_i64, le_u32, utf16le_counted, utf16le_z
from ..functions.timecols import filetime_to_ns
from ..schema import RECORD_SCHEMAS
from ..session import computed_once
from .textfiles import _keep, binary_files

MIB = 1 << 20
RECORD_MAX = 65_536   # longest journal record; longer lengths are no records
UNIT = 65_536         # the walk starts anew at each multiple of this in a file
PARTITION_BYTES = 32 * MIB
ENTRY_MASK = (1 << 48) - 1
HELD_BYTES = 4 * MIB   # of pages whose records a task takes apart at once; a batch may hold 64 MiB


# ---- recycle bin ------------------------------------------------------------------------

def parse_recycle_i(files: DataFrame) -> DataFrame:
    """``$I`` notes: version 1 (path at 24) and 2 (length at 24, path at 28)."""
    body = F.col("content")
    version, chars = le_i64(body, 0), le_u32(body, 24)
    path = (
        F.when((version == 1) & (F.length(body) >= 26), utf16le_z(body, 24))
        .when((version == 2) & (chars > 0) & (F.length(body) >= chars * 2 + 28), utf16le_counted(body, 28, chars))
    )
    notes = computed_once(
        files.filter(F.length(body) >= 24), *_keep(files), le_i64(body, 16).alias("filetime"), path.alias("original_path"),
        le_i64(body, 8).alias("file_size"))
    return notes.filter((filetime_to_ns("filetime") > 0) & (F.coalesce("original_path", F.lit("")) != ""))


def read_recycle_i(spark: SparkSession, path: str, image_id: str | None = None, host_id: str | None = None) -> DataFrame:
    return parse_recycle_i(binary_files(spark, path, "$[Ii]?*", image_id, host_id))


# ---- pages ------------------------------------------------------------------------------

_CHUNK_SCHEMA = "image_id STRING, chunk_off BIGINT, content BINARY, prev_tail BINARY, next_head BINARY"


def chunk_files(files: DataFrame, chunk_bytes: int = MIB) -> DataFrame:
    """Cut whole-file rows (``image_id``, ``content``) into pages with both neighbours' edges.

    ``prev_tail`` and ``next_head`` hold up to 64 KiB before and after the page, so a record
    crossing an edge is read once, by the page it starts in, without a shuffle.
    """
    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for image, blob in zip(batch.column("image_id").to_pylist(), batch.column("content")):
                view = memoryview(blob.as_buffer()) if blob.is_valid else memoryview(b"")
                for off in range(0, len(view), chunk_bytes):
                    end = off + chunk_bytes
                    yield pa.RecordBatch.from_pydict({
                        "image_id": pa.array([image], pa.string()),
                        "chunk_off": pa.array([off], pa.int64()),
                        "content": pa.array([bytes(view[off:end])], pa.binary()),
                        "prev_tail": pa.array([bytes(view[max(off - RECORD_MAX, 0):off])], pa.binary()),
                        "next_head": pa.array([bytes(view[end:end + RECORD_MAX])], pa.binary())})

    return files.select("image_id", "content").mapInArrow(cut, _CHUNK_SCHEMA)


def with_neighbours(chunks: DataFrame, page_bytes: int = MIB) -> DataFrame:
    """Add ``prev_tail`` and ``next_head`` (64 KiB each) to stored pages of equal size.

    Every page sends its edges to the pages within 64 KiB and one equi-join on (image, page number)
    brings them home.  The pages of a very large image are spread over all tasks; a window per
    image would pull them into one.  ``read_pages`` needs no such step.
    """
    page = F.call_function("div", F.col("chunk_off"), F.lit(page_bytes))
    reach = -(-RECORD_MAX // page_bytes)
    steps = F.array(*[F.lit(d) for d in range(-reach, reach + 1) if d])
    sent = chunks.select("image_id", page.alias("_from"), F.explode(steps).alias("_step"), "content")
    tail = F.substring("content", F.greatest(F.length("content") - RECORD_MAX, F.lit(0)) + 1, F.lit(RECORD_MAX))
    edge = F.when(F.col("_step") > 0, tail).otherwise(F.substring("content", 1, RECORD_MAX))
    part = F.struct(F.col("_from").alias("at"), edge.alias("edge"))

    def joined(side: Column) -> Column:
        parts = F.array_sort(F.collect_list(F.when(side, part)))
        return F.aggregate(F.transform(parts, lambda x: x["edge"]), F.lit(b""), lambda done, x: F.concat(done, x))

    edges = sent.groupBy("image_id", (F.col("_from") + F.col("_step")).alias("_page")).agg(
        joined(F.col("_step") > 0).alias("_before"), joined(F.col("_step") < 0).alias("_behind"))
    last = F.substring("_before", F.greatest(F.length("_before") - RECORD_MAX, F.lit(0)) + 1, F.lit(RECORD_MAX))
    rows = chunks.withColumn("_page", page).join(edges, ["image_id", "_page"], "left")
    return rows.withColumns({"prev_tail": last, "next_head": F.substring("_behind", 1, RECORD_MAX)}).drop("_page", "_before", "_behind")


class PageSource(DataSource):
    """Byte ranges of large files as pages with both neighbours' edges; the last page of a file may be short.

    Options: ``path`` (a file or a folder of files, by any address that pyarrow's file systems know), ``page_bytes``,
    ``image_id``, ``host_id``; for streams also ``complete`` (the files no longer grow).
    """

    @classmethod
    def name(cls) -> str:
        return "evidence_pages"

    def schema(self) -> str:
        return "host_id STRING, " + _CHUNK_SCHEMA

    def reader(self, schema) -> DataSourceReader:
        return PageReader(self.options)

    def streamReader(self, schema) -> DataSourceStreamReader:
        return PageStream(self.options)


class _Pages:
    """Each partition reads a run of whole pages of one file and the edges beside them."""

    def __init__(self, options: dict) -> None:
        self.path, self.page = options["path"], int(options.get("page_bytes", MIB))
        self.image, self.host = options.get("image_id"), options.get("host_id")
        self.complete = options.get("complete", "false").lower() == "true"

    def _sizes(self) -> dict[str, int]:
        """Size of each file; names that start with ``_`` or ``.`` are not evidence."""
        from pyarrow import fs
        files, path = fs.FileSystem.from_uri(self.path)
        info = files.get_file_info(path)
        found = files.get_file_info(fs.FileSelector(path)) if info.type == fs.FileType.Directory else [info]
        return {f.path: f.size for f in found if f.type == fs.FileType.File and f.base_name[0] not in "_."}

    def _runs(self, name: str, start: int, end: int, size: int) -> list[InputPartition]:
        step = max(self.page, PARTITION_BYTES // self.page * self.page)
        return [InputPartition((name, at, min(at + step, end), size)) for at in range(start, end, step)]

    def read(self, partition: InputPartition) -> Iterator[pa.RecordBatch]:
        from pyarrow import fs
        name, start, end, size = partition.value
        with fs.FileSystem.from_uri(self.path)[0].open_input_file(name) as data:
            for off in range(start, end, self.page):
                low, stop = max(off - RECORD_MAX, 0), min(off + self.page, end)
                data.seek(low)
                block = data.read(min(stop + RECORD_MAX, size) - low)
                yield pa.RecordBatch.from_pydict({
                    "host_id": pa.array([self.host], pa.string()), "image_id": pa.array([self.image], pa.string()),
                    "chunk_off": pa.array([off], pa.int64()), "content": pa.array([block[off - low:stop - low]], pa.binary()),
                    "prev_tail": pa.array([block[:off - low]], pa.binary()), "next_head": pa.array([block[stop - low:]], pa.binary())})


class PageReader(_Pages, DataSourceReader):
    def partitions(self) -> list[InputPartition]:
        return [run for name, size in self._sizes().items() for run in self._runs(name, 0, size, size)]


class PageStream(_Pages, DataSourceStreamReader):
    """Files that grow, read once: the offset is the number of bytes done of each file.

    While a file grows its last units stay unread, so that every page read has its whole right edge and a batch that
    runs again reads the same bytes; a run with ``complete`` reads the rest.
    """

    def initialOffset(self) -> dict:
        return {}

    def latestOffset(self) -> dict:
        return {name: size if self.complete else max(0, (size - RECORD_MAX) // UNIT * UNIT) for name, size in sorted(self._sizes().items())}

    def partitions(self, start: dict, end: dict) -> list[InputPartition]:
        sizes = self._sizes()
        return [run for name, stop in end.items() for run in self._runs(name, start.get(name, 0), stop, sizes.get(name, stop))]


def _address(path: str) -> str:
    return path if "://" in path or path.startswith("file:") else Path(os.path.abspath(path)).as_uri()


def read_page_stream(spark: SparkSession, path: str, image_id: str, page_bytes: int = MIB, host_id: str | None = None,
                     complete: bool = False) -> DataFrame:
    """Pages of growing files as a stream; ``page_bytes`` is a multiple of 64 KiB.  Parse them with ``scan_usn``."""
    if page_bytes % UNIT:
        raise ValueError(f"page_bytes has to be a multiple of {UNIT}")
    spark.dataSource.register(PageSource)
    reader = spark.readStream.format("evidence_pages").options(path=_address(path), page_bytes=page_bytes, image_id=image_id, complete=complete)
    return (reader.option("host_id", host_id) if host_id is not None else reader).load()


def read_pages(spark: SparkSession, path: str, image_id: str, page_bytes: int = MIB, host_id: str | None = None) -> DataFrame:
    """Pages of a file of any size, or of a folder's files, read by byte ranges; no page is shuffled to get its edges."""
    spark.dataSource.register(PageSource)
    reader = spark.read.format("evidence_pages").option("path", _address(path)).option("page_bytes", page_bytes).option("image_id", image_id)
    return (reader.option("host_id", host_id) if host_id is not None else reader).load()


def _hosted(pages: DataFrame, decode: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """Decode pages whose records keep the page's ``host_id``; without that column it is null."""
    if "host_id" not in pages.columns:
        return decode(pages).withColumn("host_id", F.lit(None).cast("string"))
    both = F.to_json(F.struct("host_id", "image_id"))
    ids = F.from_json("image_id", "host_id STRING, image_id STRING")
    return decode(pages.withColumn("image_id", both)).withColumns({"host_id": ids["host_id"], "image_id": ids["image_id"]})


# ---- numpy helpers ----------------------------------------------------------------------

def _gather(data: np.ndarray, offs: np.ndarray, width: int) -> np.ndarray:
    """Little-endian unsigned integers of ``width`` bytes at ``offs``."""
    cells = data[offs[:, None] + np.arange(width)]
    return np.ascontiguousarray(cells).view(f"<u{width}").ravel().astype(np.int64 if width < 8 else np.uint64)


def _text(raw: bytes) -> str:
    return raw.decode("utf-16-le", errors="replace")


# ---- change journal ---------------------------------------------------------------------

MIN_USN, MAX_NAME = 60, 1 << 16
_USN_SCHEMA = RECORD_SCHEMAS["usn"].replace("host_id STRING, ", "")


def _stretch_offsets(stretch: np.ndarray, file_off: int, own: int, own_end: int, carve: bool) -> list[tuple[int, int]]:
    """Start and length of the version-2 records that start in ``own:own_end`` of a stretch, at any alignment.

    The walk starts anew at each unit of the file, so it is the same for every way to cut pages.
    """
    found, limit = [], len(stretch)
    first = max((file_off + own) // UNIT * UNIT - file_off, 0)
    for unit in range(first, own_end, UNIT):
        pos = unit
        while pos < min(unit + UNIT, own_end) and pos + MIN_USN <= limit:
            length, version = (int(x) for x in stretch[pos:pos + 8].view("<u4"))
            fits = MIN_USN <= length <= min(limit - pos, RECORD_MAX)
            if carve:
                fits = fits and length % 8 == 0 and version == 2
            if fits and version & 0xFFFF == 2 and pos >= own:
                found.append((pos, length))
            pos += length if fits else 8
    return found


def _batch_offsets(data: np.ndarray, base: np.ndarray, own: np.ndarray, own_end: np.ndarray, end: np.ndarray,
                   file_off: np.ndarray, carve: bool) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start, length and page number of the version-2 records of 8-aligned pages in one buffer.

    Page ``i`` owns the records that start in ``own[i]:own_end[i]`` of its stretch ``base[i]:end[i]``, which
    lies at ``file_off[i]`` of its file.  Possible records are found by whole-array tests; the walk then
    visits only those, from the start of the unit of the file that a page begins in.  A page whose walk
    leaves the 8-byte grid is read again byte-exactly.
    """
    words = data.view("<u4")
    spots = np.flatnonzero(words[::2] >= MIN_USN)
    offs, length, version = spots * 8, words[spots * 2].astype(np.int64), words[spots * 2 + 1]
    page = np.searchsorted(base, offs, side="right") - 1
    unit = (offs - base[page] + file_off[page]) // UNIT
    first = (own - base + file_off) // UNIT
    fits = (offs < own_end[page]) & (offs + length <= end[page]) & (length <= RECORD_MAX) & (unit >= first[page])
    if carve:
        fits &= (length % 8 == 0) & (version == 2)
    columns = [x[fits] for x in (offs, length, version & 0xFFFF, page, unit)]
    starts, lengths, pages, ragged, free, current = [], [], [], set(), 0, None
    for start, size, major, owner, part in zip(*(c.tolist() for c in columns)):
        if (owner, part) != current:
            current, free = (owner, part), 0
        if start < free:
            continue
        free = start + size
        if size % 8:
            ragged.add(owner)
        if major == 2 and start >= own[owner]:
            starts.append(start)
            lengths.append(size)
            pages.append(owner)
    if ragged:
        kept = [row for row in zip(starts, lengths, pages) if row[2] not in ragged]
        for owner in ragged:
            lo, hi = int(base[owner]), int(end[owner])
            exact = _stretch_offsets(data[lo:hi], int(file_off[owner]), int(own[owner]) - lo, int(own_end[owner]) - lo, carve)
            kept += [(lo + at, size, owner) for at, size in exact]
        starts, lengths, pages = (list(c) for c in zip(*kept)) if kept else ([], [], [])
    return tuple(np.array(c, dtype=np.int64) for c in (starts, lengths, pages))


def _slices(batch: pa.RecordBatch, parts: list[str], most: int) -> Iterator[pa.RecordBatch]:
    """Runs of rows that hold about ``most`` bytes in the columns ``parts``, one row at least."""
    sizes = sum(pc.fill_null(pc.binary_length(batch.column(c)), 0).to_numpy(zero_copy_only=False).astype(np.int64) for c in parts)
    cuts = [0, *(np.flatnonzero(np.diff(np.cumsum(sizes) // most)) + 1).tolist(), batch.num_rows]
    yield from (batch.slice(at, end - at) for at, end in zip(cuts, cuts[1:]) if end > at)


def _usn_batch(pages: list[tuple[int, bytes, bytes, bytes]], carve: bool) -> tuple[pa.Array, pa.RecordBatch]:
    """Decode the journal records of a batch of pages (offset, previous tail, content, next head): each one's page, and its fields."""
    places = np.array([i for i, p in enumerate(pages) if p[2].strip(b"\0")], dtype=np.int64)
    pages = [pages[i] for i in places.tolist()]
    sizes = np.array([[len(part) for part in p[1:]] for p in pages], dtype=np.int64).reshape(-1, 3)
    ends = np.cumsum(sizes, axis=1)
    padded = (ends[:, 2] + 7) // 8 * 8
    base = np.concatenate([[0], np.cumsum(padded)]).astype(np.int64)[:-1]
    blob = b"".join(b"".join(p[1:]).ljust(n, b"\0") for p, n in zip(pages, padded.tolist()))
    data = np.frombuffer(blob, dtype=np.uint8)
    file_off = np.array([p[0] for p in pages], dtype=np.int64) - sizes[:, 0]
    offs, lengths, owner = _batch_offsets(data, base, *(base + ends[:, i] for i in range(3)), file_off, carve)
    name_len, name_off = _gather(data, offs + 56, 2), _gather(data, offs + 58, 2)
    inside = name_off + name_len <= lengths
    kept_len = name_len if carve else name_len // 2 * 2   # a live journal drops half a character
    names = [_text(blob[o + p:o + p + n]) if ok else None
             for o, p, n, ok in zip(offs.tolist(), name_off.tolist(), kept_len.tolist(), inside.tolist())]
    out = pa.RecordBatch.from_pydict({
        "parent_entry": pa.array((_gather(data, offs + 16, 8) & np.uint64(ENTRY_MASK)).astype(np.int64)),
        "filetime": pa.array(_gather(data, offs + 32, 8).view(np.int64)),
        "reason": pa.array(_gather(data, offs + 40, 4)),
        "file_attrs": pa.array(_gather(data, offs + 52, 4)),
        "file_name": pa.array(names, pa.string()),
        "recovered": pa.array(np.full(len(offs), carve))})
    kept = inside & (name_len > 0) if carve else np.ones(len(offs), dtype=bool)
    return pa.array(places[owner[kept]]), out.filter(pa.array(kept)) if carve else out


def _usn_records(chunks: DataFrame, carve: bool, page_bytes: int) -> DataFrame:
    parts = ["prev_tail", "content", "next_head"]
    columns = ["image_id", "chunk_off", *parts]
    most = HELD_BYTES

    def decode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for rows in _slices(batch, parts, most):
                off, *bodies = (rows.column(c).to_pylist() for c in columns[1:])
                owner, found = _usn_batch([(o or 0, *(p or b"" for p in row)) for o, *row in zip(off, *bodies)], carve)
                yield pa.RecordBatch.from_arrays([rows.column("image_id").take(owner), *found.columns, rows.column("host_id").take(owner)],
                                                 names=["image_id", *found.schema.names, "host_id"])

    if not set(columns) <= set(chunks.columns):
        chunks = with_neighbours(chunks, page_bytes)
    host = F.col("host_id") if "host_id" in chunks.columns else F.lit(None)
    return chunks.select(*columns, host.cast("string").alias("host_id")).mapInArrow(decode, _USN_SCHEMA + ", host_id STRING")


def scan_usn(chunks: DataFrame, page_bytes: int = MIB) -> DataFrame:
    """Journal records of ``$J`` pages; each page reads the records that start in it."""
    return _usn_records(chunks, False, page_bytes)


def carve_usn(chunks: DataFrame, page_bytes: int = MIB) -> DataFrame:
    """Journal records anywhere in raw pages, under stricter checks; marked as recovered."""
    return _usn_records(chunks, True, page_bytes)


# ---- file table -------------------------------------------------------------------------

ENTRY_BYTES, SECTOR = 1024, 512
ATTR_STANDARD, ATTR_NAME, ATTR_END = 0x10, 0x30, 0xFFFFFFFF
DOS_NAMESPACE = 2
_MFT_SCHEMA = RECORD_SCHEMAS["mft"].replace("host_id STRING, ", "")


def _fix_sectors(entries: np.ndarray) -> None:
    """Put the saved bytes back at the end of both sectors, where the update mark matches."""
    flat = np.arange(len(entries))
    usa = entries[:, 4:6].copy().view("<u2").ravel().astype(np.int64)
    count = entries[:, 6:8].copy().view("<u2").ravel().astype(np.int64)
    for sector in (1, 2):
        spot = sector * SECTOR - 2
        ok = (usa > 0) & (count > sector) & (usa + count * 2 <= ENTRY_BYTES)
        rows = flat[ok]
        mark = entries[rows[:, None], usa[ok][:, None] + np.arange(2)]
        rows = rows[(entries[rows, spot:spot + 2] == mark).all(axis=1)]
        entries[rows, spot:spot + 2] = entries[rows[:, None], usa[rows][:, None] + sector * 2 + np.arange(2)]


def _u(entries: np.ndarray, rows: np.ndarray, offs: np.ndarray, width: int) -> np.ndarray:
    cells = entries[rows[:, None], offs[:, None] + np.arange(width)]
    return np.ascontiguousarray(cells).view(f"<u{width}").ravel().astype(np.int64)


def _attribute_offsets(entries: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Content offset of the last usable standard-information and file-name attribute, or -1.

    All entries advance one attribute per step.
    """
    total = len(entries)
    si, fn = np.full(total, -1, np.int64), np.full(total, -1, np.int64)
    rows = np.arange(total)
    offs = entries[:, 20:22].copy().view("<u2").ravel().astype(np.int64)
    while len(rows):
        alive = offs + 24 <= ENTRY_BYTES
        rows, offs = rows[alive], offs[alive]
        kind, size = _u(entries, rows, offs, 4), _u(entries, rows, offs + 4, 4)
        alive = (kind != ATTR_END) & (size > 0) & (offs + size <= ENTRY_BYTES)
        rows, offs, kind, size = rows[alive], offs[alive], kind[alive], size[alive]
        resident = entries[rows, offs + 8] == 0
        length, start = _u(entries, rows, offs + 16, 4), offs + _u(entries, rows, offs + 20, 2)
        hit = resident & (kind == ATTR_STANDARD) & (length >= 32) & (start + 32 <= ENTRY_BYTES)
        si[rows[hit]] = start[hit]
        hit = resident & (kind == ATTR_NAME) & (length >= 66) & (start + 66 <= ENTRY_BYTES)
        r, s = rows[hit], start[hit]
        named = (entries[r, s + 65] != DOS_NAMESPACE) & (s + 66 + entries[r, s + 64].astype(np.int64) * 2 <= ENTRY_BYTES)
        fn[r[named]] = s[named]
        offs = offs + size
    return si, fn


def _four_times(entries: np.ndarray, base: np.ndarray) -> pa.Array:
    """Lists of the four file times at ``base``; null where there is no attribute."""
    have = base >= 0
    cells = entries[np.flatnonzero(have)[:, None], base[have][:, None] + np.arange(32)]
    times = np.ascontiguousarray(cells).view("<i8").ravel()
    ends = np.concatenate([[0], np.cumsum(have * 4)]).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(ends), pa.array(times, pa.int64()), mask=pa.array(~have))


def _mft_batch(images: list[str], offsets: list[int], contents: list[bytes]) -> pa.RecordBatch:
    """Decode the file-table entries of a batch of pages."""
    counts = [len(c) // ENTRY_BYTES for c in contents]
    blob = b"".join(c[:n * ENTRY_BYTES] for c, n in zip(contents, counts))
    entries = np.frombuffer(blob, dtype=np.uint8).reshape(-1, ENTRY_BYTES)
    numbers = np.concatenate([np.arange(n) + off // ENTRY_BYTES for off, n in zip(offsets, counts)])
    owner = np.repeat(np.arange(len(images)), counts)
    used = (entries[:, :4] == np.frombuffer(b"FILE", np.uint8)).all(axis=1) & ((entries[:, 22] & 1) == 1)
    entries, numbers, owner = entries[used].copy(), numbers[used], owner[used]
    _fix_sectors(entries)
    si, fn = _attribute_offsets(entries)
    rows = np.flatnonzero(fn >= 0)
    parents = np.full(len(entries), 5, np.int64)   # no name: child of the root
    parents[rows] = _u(entries, rows, fn[rows], 8) & ENTRY_MASK
    blob = entries.tobytes()
    names = []
    for i, (number, at) in enumerate(zip(numbers.tolist(), fn.tolist())):
        base = i * ENTRY_BYTES + at
        name = _text(blob[base + 66:base + 66 + blob[base + 64] * 2]) if at >= 0 else ""
        names.append(name or f"entry#{number}")
    return pa.RecordBatch.from_pydict({
        "image_id": pa.array([images[i] for i in owner.tolist()], pa.string()),
        "entry": pa.array(numbers.astype(np.int64)), "name": pa.array(names, pa.string()),
        "parent": pa.array(parents), "si": _four_times(entries, si),
        "fn": _four_times(entries, np.where(fn >= 0, fn + 8, -1))})


def decode_mft(pages: DataFrame) -> DataFrame:
    """File-table entries of pages (``image_id``, ``chunk_off``, ``content``).

    Pages hold whole 1024-byte entries; the entry number follows from the byte offset.  Sector
    fix-ups are applied; free entries and bad signatures are left out.
    """
    def decode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield _mft_batch(*(batch.column(c).to_pylist() for c in ("image_id", "chunk_off", "content")))

    return _hosted(pages, lambda rows: rows.select("image_id", "chunk_off", "content").mapInArrow(decode, _MFT_SCHEMA))
