"""Structured Streaming: events as record files arrive, running counts, current-path table.

The builders keep no state, so they run unchanged on streams.  Host names, order and
snapshot deltas need the whole timeline and run afterwards as batch jobs.
"""

from __future__ import annotations

import threading
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.streaming import DataStreamWriter, StreamingQuery, StreamingQueryListener

from ..operators.delta import current_paths
from ..schema import RECORD_SCHEMAS
from ..sources.textfiles import byte_lines, file_lines, owned_by


def read_record_stream(spark: SparkSession, directory: str, kind: str | None = None, schema: str | None = None,
                       fmt: str = "parquet", files_per_batch: int = 1000, glob: str | None = None) -> DataFrame:
    """New files of a record directory as a stream with a fixed schema."""
    reader = (spark.readStream.format(fmt).schema(schema or RECORD_SCHEMAS[kind])
              .option("maxFilesPerTrigger", files_per_batch))
    return (reader.option("pathGlobFilter", glob) if glob else reader).load(directory)


WHOLE_FILE = "path STRING, modificationTime TIMESTAMP, length BIGINT, content BINARY"


def read_file_stream(spark: SparkSession, directory: str, glob: str | None = None, files_per_batch: int = 1000,
                     image_id: str | None = None, host_id: str | None = None) -> DataFrame:
    """New files of an evidence folder as whole-file rows, for the ``parse_*`` functions of text and recycle-bin files.

    These read each file inside its row, so they hold no state and their events can be appended.  A task holds whole
    files, several times over as text: launch lists, which have no bound, come as lines (``read_byte_line_stream``).
    """
    reader = (spark.readStream.format("binaryFile").schema(WHOLE_FILE).option("recursiveFileLookup", "true")
              .option("maxFilesPerTrigger", files_per_batch))
    return owned_by((reader.option("pathGlobFilter", glob) if glob else reader).load(directory), image_id, host_id)


def read_line_stream(spark: SparkSession, directory: str, glob: str = "ConsoleHost_history.txt", files_per_batch: int = 1000,
                     image_id: str | None = None, host_id: str | None = None) -> DataFrame:
    """Lines of new history files with their path and file time, for ``parse_pshistory``."""
    return owned_by(file_lines(_line_stream(spark, directory, glob, files_per_batch)), image_id, host_id)


def read_byte_line_stream(spark: SparkSession, directory: str, glob: str = "[Pp]ca[Aa]pp[Ll]aunch[Dd]ic.txt", files_per_batch: int = 1000,
                          image_id: str | None = None, host_id: str | None = None) -> DataFrame:
    """New files as one row a line, as bytes, for ``parse_pca_launch``: large files are split and a task holds one line."""
    return owned_by(byte_lines(_line_stream(spark, directory, glob, files_per_batch)), image_id, host_id)


def _line_stream(spark: SparkSession, directory: str, glob: str, files_per_batch: int) -> DataFrame:
    return (spark.readStream.option("recursiveFileLookup", "true").option("pathGlobFilter", glob)
            .option("maxFilesPerTrigger", files_per_batch).text(directory))


def stream_ingest(records: DataFrame, build: Callable[[DataFrame], DataFrame], target: str,
                  checkpoint: str) -> StreamingQuery:
    """Append built events to a Parquet folder, exactly once per input file."""
    return (build(records).writeStream.format("parquet").outputMode("append")
            .partitionBy("artifact_type").option("checkpointLocation", checkpoint)
            .trigger(availableNow=True).start(target))


def stream_counts(events: DataFrame, target: str, checkpoint: str) -> StreamingQuery:
    """Keep running event counts per artifact type.

    Each batch writes only the types whose count has changed, into a folder of its own, so a batch that
    runs again replaces itself; ``read_counts`` takes each type's newest row.
    """
    def upsert(batch: DataFrame, batch_id: int) -> None:
        batch.coalesce(1).write.mode("overwrite").parquet(f"{target}/batch_id={batch_id}")

    counts = events.groupBy("artifact_type").agg(F.count("*").alias("events"))
    writer = (counts.writeStream.outputMode("update").foreachBatch(upsert)
              .option("checkpointLocation", checkpoint).trigger(availableNow=True))
    return start_keyed(writer, events.sparkSession)


def start_keyed(writer: DataStreamWriter, spark: SparkSession, partitions: int | None = None) -> StreamingQuery:
    """Start a stream that keeps state, in ``partitions`` parts: one a core, and no more than a shuffle has, unless given.

    Every batch opens and commits each part, however few rows it has, so the parts follow the cores that share this
    work and not the session's shuffles.  The checkpoint fixes their number at the first start: give it for a state
    that is to outgrow these cores.  The session's own setting holds again once the stream has started.
    """
    key = "spark.sql.shuffle.partitions"
    kept = spark.conf.get(key)
    spark.conf.set(key, str(partitions or min(int(kept), spark.sparkContext.defaultParallelism)))
    try:
        return writer.start()
    finally:
        spark.conf.set(key, kept)


class LiveCounts(StreamingQueryListener):
    """Totals of ``observe_counts`` while streams run: every progress report adds its batch's numbers.

    ``totals`` maps the metric to its sum over the batches reported so far; ``wait`` returns once a stream has
    ended and all its reports are in.
    """

    def __init__(self, name: str = "timeline") -> None:
        self.name, self.totals, self.ended = name, {}, threading.Event()

    def onQueryStarted(self, event) -> None:
        pass

    def onQueryIdle(self, event) -> None:
        pass

    def onQueryProgress(self, event) -> None:
        row = event.progress.observedMetrics.get(self.name)
        for key, value in (row.asDict() if row is not None else {}).items():
            self.totals[key] = self.totals.get(key, 0) + (value or 0)

    def onQueryTerminated(self, event) -> None:
        self.ended.set()

    def wait(self, seconds: float = 60) -> dict[str, int]:
        self.ended.wait(seconds)
        return self.totals


def use_keyed_state(spark: SparkSession) -> None:
    """Keep the keys of streams in RocksDB on the executors' disks, with their changes in the checkpoint, not on the heap."""
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    spark.conf.set("spark.sql.streaming.stateStore.rocksdb.changelogCheckpointing.enabled", "true")
    # Counting keys looks each new one up once more; a set's keys are the rows it has written.
    spark.conf.set("spark.sql.streaming.stateStore.rocksdb.trackTotalNumberOfRows", "false")


def stream_delta_sets(events: DataFrame, target: str, checkpoint: str, partitions: int | None = None) -> StreamingQuery:
    """Collect the paths seen so far: a state of all (host, path) lets each path through once, whatever the batches.

    Each batch writes a folder of its own, so that a repeated batch replaces itself; ``read_current_paths`` gives
    the set that the snapshot anti join takes.
    """
    def append(batch: DataFrame, batch_id: int) -> None:
        batch.write.mode("overwrite").parquet(f"{target}/batch_id={batch_id}")

    use_keyed_state(events.sparkSession)
    writer = (current_paths(events).writeStream.outputMode("append").foreachBatch(append).option("checkpointLocation", checkpoint)
              .trigger(availableNow=True))
    return start_keyed(writer, events.sparkSession, partitions)


def read_counts(spark: SparkSession, target: str) -> DataFrame:
    """Newest count of each type."""
    return spark.read.parquet(target).groupBy("artifact_type").agg(F.max_by("events", "batch_id").alias("events"))


def compact_delta_sets(spark: SparkSession, target: str, compacted: str) -> None:
    """Write the paths of all batches so far as one table with few files."""
    read_current_paths(spark, target).write.mode("overwrite").parquet(f"{compacted}/batch_id=-1")


def read_current_paths(spark: SparkSession, target: str) -> DataFrame:
    """Paths seen so far; the stream has written each once."""
    return spark.read.parquet(target).select("host_id", "file_path")
