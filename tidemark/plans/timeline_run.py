"""A whole run as one lazy plan: record tables in, finished timeline out."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import DataFrame, Observation, SparkSession, functions as F

from ..operators import browsing, eventlog, execution, filesystem, paths, registry, textual, usage
from ..operators.delta import multi_snapshot_delta
from ..operators.timeline import filter_type, grep, preview, fill_hostname, union_timelines
from ..schema import EVENT_SCHEMA
from ..sources import artifacts, binaryfiles, textfiles
from ..sources.records import read_timeline

# Record table -> builder, where one table is enough.
SINGLE = {
    "evtx": eventlog.evtx_events,
    "prefetch": execution.prefetch_events,
    "lnk": execution.lnk_events,
    "jumplist": execution.jumplist_events,
    "pca_launch": execution.pca_launch_events,
    "pca_general": execution.pca_general_events,
    "amcache_file": execution.amcache_file_events,
    "amcache_driver": execution.amcache_driver_events,
    "amcache_app": execution.amcache_app_events,
    "logfile": filesystem.logfile_events,
    "registry_keys": registry.registry_events,
    "chromium_downloads": browsing.chromium_download_events,
    "activity": browsing.wintimeline_events,
    "wer": textual.wer_events,
    "tasks": textual.task_events,
    "pshistory": textual.pshistory_events,
    "recycle_i": textual.recycle_events,
}
# Builders over several record tables; each runs when its first table is present.
JOINED = [
    (("srum_app", "srum_idmap"), usage.srum_app_events),
    (("srum_net", "srum_idmap"), usage.srum_net_events),
    (("srum_conn", "srum_idmap"), usage.srum_conn_events),
    (("chromium_visits", "chromium_urls"), browsing.chromium_visit_events),
    (("moz_historyvisits", "moz_places"), browsing.firefox_visit_events),
    (("moz_annos", "moz_places", "moz_anno_attributes"), browsing.firefox_download_events),
    (("shellbag_nodes", "shellbag_items"), registry.shellbag_events),
]


def live_events(tables: Mapping[str, DataFrame]) -> DataFrame:
    """Events of every record table present."""
    parts = [build(tables[kind]) for kind, build in SINGLE.items() if kind in tables]
    parts += [build(*[tables[k] for k in kinds]) for kinds, build in JOINED if all(k in tables for k in kinds)]
    resolved = None
    if "mft" in tables:
        resolved = paths.resolve_paths(tables["mft"].select("image_id", "entry", "name", "parent"))
        parts.append(filesystem.mft_events(tables["mft"], resolved))
    if "usn" in tables:
        parts.append(filesystem.usn_events(tables["usn"], resolved))
    if "amcache_legacy" in tables:
        modern = [tables[k] for k in ("amcache_file", "amcache_driver", "amcache_app") if k in tables]
        parts.append(execution.amcache_legacy_events(tables["amcache_legacy"], *modern))
    return union_timelines(*parts)


def build_timeline(tables: Mapping[str, DataFrame], recovered_usn: DataFrame | None = None) -> DataFrame:
    """Live events, carved journal records, snapshot deltas, host names filled.  Unsorted."""
    live = live_events(tables)
    parts = [live]
    if recovered_usn is not None:
        parts.append(filesystem.usn_events(recovered_usn))
    if "mft_snapshot" in tables or "registry_snapshot" in tables:
        parts.append(multi_snapshot_delta(
            _snapshot_events(tables.get("mft_snapshot"), ["image_id"], filesystem.mft_events_with_paths),
            _snapshot_events(tables.get("registry_snapshot"), ["image_id", "hive_id"], registry.registry_events),
            live))
    return fill_hostname(union_timelines(*parts))


def _snapshot_events(records: DataFrame | None, scope: list[str], build) -> DataFrame | None:
    """Events of all snapshots in one plan: the snapshot id becomes part of each id scope."""
    if records is None:
        return None
    marked = records.withColumns(
        {c: F.concat_ws("#", c, F.col("snapshot_id").cast("string")) for c in scope})
    return build(marked).withColumns({
        "snapshot_id": F.substring_index("image_id", "#", -1).cast("int"),
        "image_id": F.regexp_replace("image_id", "#[0-9]+$", "")})


DIRECTORIES = ("TASK", "RECYCLEBIN")
PAGED = ("MFT", "USNJRNL")


def evidence_tables(spark: SparkSession, root: str, image_id: str, host_id: str | None = None) -> dict[str, DataFrame]:
    """Record tables of one image's evidence below ``root``, a mounted volume or an extracted folder.

    Holds what is read from files here: file table, journal, launch lists, error reports, tasks, shell history and
    recycle-bin notes, each only where the listing has it.  Small files are found by name and kept where they lie in
    their artifact's place; file table and journal are read by byte ranges.  For many images, append each one's tables
    to shared ones and build a single timeline from these.
    """
    listed = artifacts.list_files(spark, root, image_id, host_id)
    jobs = artifacts.classify_artifacts(listed).unionByName(artifacts.classify_artifacts(listed, artifacts.EXTRACTED_PATTERNS))
    places = F.collect_set(F.when(F.col("artifact_type").isin(*DIRECTORIES, *PAGED), F.col("path")))
    found = {r.artifact_type: sorted(r.places) for r in jobs.groupBy("artifact_type").agg(places.alias("places")).collect()}
    base, owner = root.rstrip("/"), (image_id, host_id or image_id)

    def named(kind: str, glob: str, read=textfiles.binary_files) -> DataFrame:
        return read(spark, base, glob, *owner).filter(artifacts.belongs(artifacts.below(F.col("path"), base), kind))

    def pages(kind: str) -> DataFrame:
        parts = [binaryfiles.read_pages(spark, f"{base}/{p}", image_id, host_id=owner[1]) for p in found[kind]]
        return union_timelines(*parts)

    tables: dict[str, DataFrame] = {}
    if "MFT" in found:
        tables["mft"] = binaryfiles.decode_mft(pages("MFT"))
    if "USNJRNL" in found:
        tables["usn"] = binaryfiles.scan_usn(pages("USNJRNL"))
    if "PCASVC" in found:
        tables["pca_launch"] = textfiles.parse_pca_launch(named("PCASVC", "[Pp]ca[Aa]pp[Ll]aunch[Dd]ic.txt", textfiles.binary_lines))
        tables["pca_general"] = textfiles.parse_pca_general(named("PCASVC", "[Pp]ca[Gg]eneral[Dd]b[01].txt"))
    if "WER" in found:
        tables["wer"] = textfiles.parse_wer(named("WER", "*.[Ww][Ee][Rr]"))
    if "PSHISTORY" in found:
        history = textfiles.read_pshistory(spark, base, *owner)
        tables["pshistory"] = history.filter(artifacts.belongs(artifacts.below(F.col("path"), base), "PSHISTORY"))
    if "TASK" in found:
        tables["tasks"] = union_timelines(*[textfiles.read_tasks(spark, f"{base}/{p}", *owner) for p in found["TASK"]])
    if "RECYCLEBIN" in found:
        tables["recycle_i"] = union_timelines(*[binaryfiles.read_recycle_i(spark, f"{base}/{p}", *owner) for p in found["RECYCLEBIN"]])
    return tables


def build_timeline_from_folder(spark: SparkSession, root: str, image_id: str, host_id: str | None = None,
                               tables: Mapping[str, DataFrame] | None = None) -> DataFrame:
    """A whole run over one image's folder: its readable files and the given record tables in one timeline, host names filled.

    ``tables`` holds what other tools decoded (event logs, registry and so on); a kind given there replaces the folder's.
    A folder without evidence and without tables gives an empty timeline.
    """
    known = evidence_tables(spark, root, image_id, host_id) | dict(tables or {})
    return build_timeline(known) if known else spark.createDataFrame([], EVENT_SCHEMA)


def view(spark: SparkSession, path: str, n: int = 50, artifact_type: str | None = None,
         text: str | None = None) -> tuple[DataFrame, int]:
    """First ``n`` rows of a written timeline and the number of matching rows, counted by the job that finds the rows."""
    rows = filter_type(read_timeline(spark, path), artifact_type)
    rows = grep(rows, text) if text else rows
    seen = Observation()
    first = preview(rows.observe(seen, F.count(F.lit(1)).alias("rows")), n)
    return spark.createDataFrame(first.collect(), first.schema), seen.get["rows"]
