"""A written timeline read back in time order without a sort.

The files of a sorted timeline are ascending.  Tasks read each file's time range; the ranges cut the time
line into slices of about one file's rows, each slice is one partition, and partitions follow one another
in time.  Where several files meet in a slice (as those of different types do) they are merged batch by
batch.  Nothing is shuffled and no row is held longer than its time takes to pass.
"""

from __future__ import annotations

from bisect import bisect_right
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from ..schema import TIMELINE_FIELDS, TIMELINE_SCHEMA
from ..session import materialize

TIME = "timestamp_ns"
TIES = ["source", "artifact", "file_path", "macb", "message"]
BATCH_ROWS = 32_768
HOT_ROWS = 131_072     # a file of a single time with so many rows shows that the time is a hot one
HELD_ROWS = 1_000_000  # rows of one time that wait for their ties; beyond it they leave in several sorted parts
DDL = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in TIMELINE_SCHEMA)
_ARROW = {"bigint": pa.int64(), "int": pa.int32(), "boolean": pa.bool_(), "string": pa.string()}
ARROW_SCHEMA = pa.schema([(f.name, _ARROW[f.dataType.simpleString()]) for f in TIMELINE_SCHEMA])
FIELDS = list(TIMELINE_FIELDS)


def _open(path: str):
    from pyarrow import fs
    return fs.FileSystem.from_uri(path.replace("s3a://", "s3://", 1))


def _dataset(path: str):
    from pyarrow import dataset
    files, name = _open(path)
    return dataset.dataset(name, filesystem=files, format="parquet")


def _range_of(path: str) -> tuple[str, int | None, int | None, int, bool]:
    """Least and greatest time, rows, and whether the times ascend and are known; reads the time column alone."""
    low = high = None
    rows, ascending = 0, True
    for batch in _dataset(path).to_batches(columns=[TIME], batch_size=1 << 20, use_threads=False, batch_readahead=1, fragment_readahead=1):
        if not batch.num_rows:
            continue
        column = batch.column(0)
        if column.null_count:
            return path, None, None, rows, False
        times = column.to_numpy(zero_copy_only=False)
        ascending = ascending and bool((times[1:] >= times[:-1]).all()) and (high is None or int(times[0]) >= high)
        low = int(times.min()) if low is None else min(low, int(times.min()))
        high = int(times.max()) if high is None else max(high, int(times.max()))
        rows += len(times)
    return path, low, high, rows, ascending


def file_ranges(spark: SparkSession, path: str, artifact_type: str | None = None) -> DataFrame:
    """One row a file of the timeline: ``path, low, high, rows, ascending``; empty files have null times."""
    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for name in batch.column("path").to_pylist():
                row = _range_of(name)
                yield pa.RecordBatch.from_pydict({k: pa.array([v], t) for k, v, t in zip(
                    ("path", "low", "high", "rows", "ascending"), row, (pa.string(), pa.int64(), pa.int64(), pa.int64(), pa.bool_()))})

    files = (spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", "*.parquet")
             .load(path).select("path"))
    if artifact_type:
        files = files.filter(F.col("path").contains(f"/artifact_type={artifact_type.upper()}/"))
    return files.mapInArrow(read, "path STRING, low BIGINT, high BIGINT, rows BIGINT, ascending BOOLEAN")


def time_slices(files: list[tuple[str, int, int, int]], start: int | None = None,
                end: int | None = None, hot_rows: int = HOT_ROWS) -> list[tuple[int, int, list[str]]]:
    """Runs ``(low, high, paths)`` in time order, both bounds inclusive, from ``(path, low, high, rows)`` of each file.

    A slice ends before the first file that starts after about one mean file's rows.  The rows of a hot time (one that fills
    a file of ``hot_rows`` or more) make one run for each file that holds some.
    """
    files = sorted((lo, hi, rows, path) for path, lo, hi, rows in files
                   if (start is None or hi >= start) and (end is None or lo <= end))
    if not files:
        return []
    mean = sum(f[2] for f in files) / len(files)
    cuts, filled, hot = [files[0][0]], 0, {}
    for lo, hi, rows, path in files:
        alone = lo == hi and rows >= hot_rows
        if lo > cuts[-1] and (alone or filled >= mean):
            cuts.append(lo)
            filled = 0
        if alone:
            hot.setdefault(lo, []).append(path)
        else:
            filled += rows
    members: list[list[tuple[str, int]]] = [[] for _ in cuts]
    for lo, hi, rows, path in files:
        if path not in hot.get(lo, ()):
            for i in range(bisect_right(cuts, lo) - 1, bisect_right(cuts, hi)):
                members[i].append((path, hi))
    last = max(f[1] for f in files)
    out = []
    for i, cut in enumerate(cuts):
        stop = cuts[i + 1] - 1 if i + 1 < len(cuts) else last
        low, high = max(cut, start if start is not None else cut), min(stop, end if end is not None else stop)
        if cut in hot:
            out += [(cut, cut, [p]) for p in hot[cut] + [p for p, _ in members[i]]] if low == cut else []
            low = max(low, cut + 1)
        inside = [p for p, hi in members[i] if hi >= low]
        if inside and low <= high:
            out.append((low, high, inside))
    return out


def _rows(path: str, low: int, high: int) -> Iterator[pa.Table]:
    """Batches of a file within the bounds; row groups outside them are not read."""
    inside = (pc.field(TIME) >= low) & (pc.field(TIME) <= high)
    for batch in _dataset(path).to_batches(columns=FIELDS, filter=inside, batch_size=BATCH_ROWS, use_threads=False,
                                           batch_readahead=1, fragment_readahead=1):
        if batch.num_rows:
            yield pa.Table.from_batches([batch]).cast(ARROW_SCHEMA)


def _sorted(tables: list[pa.Table]) -> pa.Table:
    rows = pa.concat_tables(tables)
    keys = [(k, "ascending") for k in [TIME, *TIES]]
    return rows.take(pc.sort_indices(rows, sort_keys=keys, null_placement="at_start"))


def merged(sources: list[Iterator[pa.Table]], held_rows: int = HELD_ROWS) -> Iterator[pa.Table]:
    """Merge ascending sources: what lies before the least last time of the open sources is sorted and leaves."""
    held: dict[int, pa.Table] = {}
    open_ = dict(enumerate(sources))
    hungry = set(open_)
    while open_ or held:
        for i in sorted(hungry & set(open_)):
            more = next(open_[i], None)
            if more is None:
                del open_[i]
            else:
                held[i] = pa.concat_tables([held[i], more]) if i in held else more
        times = {i: t.column(TIME).to_numpy() for i, t in held.items()}
        bound = min((int(times[i][-1]) for i in open_), default=None)
        side = "right" if bound is not None and sum(map(len, times.values())) > held_rows else "left"
        ready = {i: len(x) if bound is None else int(np.searchsorted(x, bound, side)) for i, x in times.items()}
        if any(ready.values()):
            yield _sorted([held[i].slice(0, n) for i, n in ready.items() if n])
            held = {i: t.slice(ready[i]) for i, t in held.items() if ready[i] < t.num_rows}
            hungry = {i for i in open_ if i not in held}
        else:  # all of the earliest rows share the bound
            hungry = {i for i in open_ if int(times[i][-1]) == bound}


class OrderedSource(DataSource):
    """Options: ``ranges`` (a written table of ``file_ranges``), ``start`` and ``end`` in nanoseconds or absent."""

    @classmethod
    def name(cls) -> str:
        return "ordered_timeline"

    def schema(self) -> str:
        return DDL

    def reader(self, schema) -> DataSourceReader:
        return OrderedReader(self.options)


class OrderedReader(DataSourceReader):
    def __init__(self, options: dict) -> None:
        self.ranges = options["ranges"]
        self.start, self.end = (int(options[k]) if k in options else None for k in ("start", "end"))

    def partitions(self) -> list[InputPartition]:
        table = _dataset(self.ranges).to_table(columns=["path", "low", "high", "rows"]).to_pylist()
        files = [(r["path"], r["low"], r["high"], r["rows"]) for r in table if r["rows"]]
        return [InputPartition(run) for run in time_slices(files, self.start, self.end)] or [InputPartition((0, 0, []))]

    def read(self, partition: InputPartition) -> Iterator[pa.RecordBatch]:
        low, high, paths = partition.value
        sources = [_rows(p, low, high) for p in paths]
        for table in (sources[0] if len(sources) == 1 else merged(sources)):
            yield from table.combine_chunks().to_batches()


def read_in_order(spark: SparkSession, path: str, start: int | None = None, end: int | None = None,
                  artifact_type: str | None = None) -> DataFrame | None:
    """The eleven columns of a written timeline, partition after partition in time order, within inclusive bounds.

    None where this cannot be done: files that were written without order or hold null times, a type that is
    no folder of the timeline, or an address that pyarrow's file systems do not know.  Rows of one
    time in several partitions, or of more than ``HELD_ROWS``, are in the order of their ties inside each part only.
    What planning reads is one row a file, in the worker that makes the partitions.
    """
    try:
        _open(spark.read.parquet(path).inputFiles()[0])
    except (pa.ArrowInvalid, IndexError):
        return None
    ranges = materialize(file_ranges(spark, path, artifact_type), "file-ranges")
    seen = ranges.agg(F.bool_and("ascending").alias("ascending"), F.sum("rows").alias("rows")).first()
    if not seen.ascending or not seen.rows:
        return None
    spark.dataSource.register(OrderedSource)
    options = {k: str(v) for k, v in (("start", start), ("end", end)) if v is not None}
    return spark.read.format("ordered_timeline").options(ranges=_folder(ranges), **options).load()


def _folder(df: DataFrame) -> str:
    return df.inputFiles()[0].rpartition("/")[0]
