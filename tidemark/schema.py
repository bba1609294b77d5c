"""Event schema and the record tables the builders read."""

from __future__ import annotations

from pyspark.sql import types as T

TIMELINE_FIELDS = [
    "timestamp_ns", "timestamp_iso", "macb", "source", "artifact", "hostname",
    "file_path", "message", "message_short", "is_fn_timestamp", "tz_offset_secs",
]

EVENT_SCHEMA = T.StructType([
    T.StructField("host_id", T.StringType()),
    T.StructField("image_id", T.StringType()),
    T.StructField("artifact_type", T.StringType()),
    T.StructField("timestamp_ns", T.LongType()),
    T.StructField("timestamp_iso", T.StringType()),
    T.StructField("macb", T.StringType()),
    T.StructField("source", T.StringType()),
    T.StructField("artifact", T.StringType()),
    T.StructField("hostname", T.StringType()),
    T.StructField("file_path", T.StringType()),
    T.StructField("message", T.StringType()),
    T.StructField("message_short", T.StringType()),
    T.StructField("is_fn_timestamp", T.BooleanType()),
    T.StructField("tz_offset_secs", T.IntegerType()),
    T.StructField("extra", T.MapType(T.StringType(), T.StringType())),
])

EVENT_FIELDS = EVENT_SCHEMA.fieldNames()
TIMELINE_SCHEMA = T.StructType([EVENT_SCHEMA[name] for name in TIMELINE_FIELDS])

_KEYS = "host_id STRING, image_id STRING, "

# FILETIME columns are BIGINT counts of 100 ns since 1601-01-01 UTC.
RECORD_SCHEMAS: dict[str, str] = {
    "artifact_files": _KEYS + "path STRING, length BIGINT, modification_time TIMESTAMP",
    "mft": _KEYS + "entry BIGINT, name STRING, parent BIGINT, si ARRAY<BIGINT>, fn ARRAY<BIGINT>",
    "usn": _KEYS + "parent_entry BIGINT, filetime BIGINT, reason BIGINT, file_attrs BIGINT, "
                   "file_name STRING, recovered BOOLEAN",
    "binary_chunks": _KEYS + "chunk_off BIGINT, content BINARY, prev_tail BINARY, next_head BINARY",
    "evtx": _KEYS + "record_number BIGINT, filetime BIGINT, event_id INT, level INT, provider STRING, "
                    "channel STRING, computer STRING, strings ARRAY<STRING>, "
                    "u32s ARRAY<BIGINT>, file_name STRING",
    "prefetch": _KEYS + "exe_name STRING, files ARRAY<STRING>, run_count BIGINT, "
                        "run_times ARRAY<BIGINT>, hash BIGINT, version INT",
    "lnk": _KEYS + "target_path STRING, volume_label STRING, arguments STRING, "
                   "machine_id STRING, droid_file_id STRING, drive_type INT, "
                   "drive_serial BIGINT, created BIGINT, accessed BIGINT, written BIGINT",
    "jumplist": _KEYS + "target_path STRING, filetime BIGINT, destlist_version INT",
    "registry_keys": _KEYS + "hive_id STRING, hive_file STRING, rel_off BIGINT, "
                             "parent_rel BIGINT, name STRING, flags INT, last_write BIGINT, "
                             "values ARRAY<STRUCT<name: STRING, type: INT, raw: BINARY, text: STRING>>",
    "shellbag_nodes": _KEYS + "hive_id STRING, node BIGINT, parent BIGINT, slot INT, "
                              "is_root BOOLEAN, last_write BIGINT",
    "shellbag_items": _KEYS + "hive_id STRING, node BIGINT, slot INT, item_name STRING",
    "srum_idmap": _KEYS + "db_id STRING, id_index INT, id_type INT, id_text STRING, id_blob BINARY",
    "srum_app": _KEYS + "db_id STRING, ts_ole DOUBLE, ts_long BIGINT, app_id INT, user_id INT, "
                        "fg_cycles BIGINT, bg_cycles BIGINT, fg_read BIGINT, bg_read BIGINT, "
                        "fg_write BIGINT, bg_write BIGINT",
    "srum_net": _KEYS + "db_id STRING, ts_ole DOUBLE, ts_long BIGINT, app_id INT, user_id INT, "
                        "bytes_sent BIGINT, bytes_recvd BIGINT",
    "srum_conn": _KEYS + "db_id STRING, connect_start BIGINT, ts_ole DOUBLE, ts_long BIGINT, "
                         "app_id INT, user_id INT, profile_name STRING, connected_secs BIGINT, "
                         "interface_type INT",
    "amcache_file": _KEYS + "hive_id STRING, key_name STRING, lower_case_long_path STRING, "
                            "full_path STRING, name STRING, file_id STRING, last_write BIGINT",
    "amcache_driver": _KEYS + "hive_id STRING, key_name STRING, image_path STRING, "
                              "driver_name STRING, checksum STRING, inf_path STRING, "
                              "driver_type STRING, last_write BIGINT",
    "amcache_app": _KEYS + "hive_id STRING, key_name STRING, name STRING, publisher STRING, "
                           "version STRING, install_date STRING, last_write BIGINT",
    "amcache_legacy": _KEYS + "hive_id STRING, key_name STRING, v15 STRING, v101 STRING, "
                              "v17 BIGINT, last_write BIGINT",
    "logfile": _KEYS + "lsn BIGINT, redo_op INT, is_dir BOOLEAN, fn_name STRING, "
                       "fn ARRAY<BIGINT>, si ARRAY<BIGINT>",
    "chromium_visits": _KEYS + "db_id STRING, browser STRING, url_id BIGINT, visit_time BIGINT",
    "chromium_urls": _KEYS + "db_id STRING, id BIGINT, url STRING, title STRING",
    "chromium_downloads": _KEYS + "db_id STRING, browser STRING, start_time BIGINT, "
                                  "target_path STRING, tab_url STRING, received_bytes BIGINT, "
                                  "total_bytes BIGINT",
    "moz_historyvisits": _KEYS + "db_id STRING, place_id BIGINT, visit_date BIGINT",
    "moz_places": _KEYS + "db_id STRING, id BIGINT, url STRING, title STRING",
    "moz_annos": _KEYS + "db_id STRING, place_id BIGINT, anno_attribute_id BIGINT, "
                         "date_added BIGINT, content STRING",
    "moz_anno_attributes": _KEYS + "db_id STRING, id BIGINT, name STRING",
    "activity": _KEYS + "db_id STRING, app_id STRING, activity_type INT, start_time BIGINT, "
                        "end_time BIGINT, last_modified_time BIGINT, payload STRING",
    "pca_launch": _KEYS + "path STRING, exe_path STRING, timestamp_ns BIGINT",
    "pca_general": _KEYS + "path STRING, timestamp_ns BIGINT, status INT, exe_path STRING, "
                           "company STRING, version STRING, exit_info STRING",
    "wer": _KEYS + "path STRING, event_time BIGINT, event_type STRING, app_name STRING, "
                   "app_version STRING",
    "tasks": _KEYS + "path STRING, task_name STRING, date_ns BIGINT, author STRING, "
                     "command STRING, arguments STRING, trigger_start STRING, trigger_type STRING",
    "pshistory": _KEYS + "path STRING, mtime_ns BIGINT, command STRING",
    "recycle_i": _KEYS + "path STRING, filetime BIGINT, original_path STRING, file_size BIGINT",
}

# Snapshot tables are the live tables plus the snapshot they were taken from.
for _kind in ("mft", "registry_keys"):
    RECORD_SCHEMAS[_kind.replace("registry_keys", "registry") + "_snapshot"] = (
        RECORD_SCHEMAS[_kind] + ", snapshot_id INT, snapshot_ns BIGINT"
    )
