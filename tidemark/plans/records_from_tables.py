"""Record tables derived by projection from the star-schema tables.

The queries of ``plans.queries`` run every operator over these, so their work grows with the
given tables.  Blank, null and malformed values are mixed in by key arithmetic to exercise
each skip rule; no row is left out to make a query cheaper.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from ..session import computed_once

FT_EPOCH = 116_444_736_000_000_000


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def micros(c: str) -> str:
    return f"unix_micros(CAST({c} AS TIMESTAMP))"


def filetime(c: str) -> str:
    return f"({micros(c)} * 10 + {FT_EPOCH})"


DAY_TICKS = 864_000_000_000


# ---- binary layout ----------------------------------------------------------------------

def pack_le(c, width: int) -> Column:
    """Integer column as ``width`` little-endian bytes."""
    c = F.lit(c) if isinstance(c, int) else c
    c, low = c.cast("bigint"), F.lit(0x0F0F0F0F0F0F0F0F)
    swapped = F.shiftleft(c.bitwiseAND(low), 4).bitwiseOR(F.shiftrightunsigned(c, 4).bitwiseAND(low))  # the halves of each byte
    digits = F.reverse(F.lpad(F.hex(swapped), 16, "0"))  # bytes backwards, their halves in order again
    return F.unhex(F.left(digits, F.lit(2 * width)))


def pad_to(c: Column, size) -> Column:
    """Binary column padded with zero bytes up to ``size``."""
    size = F.lit(size) if isinstance(size, int) else size
    return F.concat(c, F.unhex(F.repeat(F.lit("00"), (size - F.length(c)).cast("int"))))


def utf16(c: Column) -> Column:
    return F.encode(c, "UTF-16LE")


# ---- event log --------------------------------------------------------------------------

EVENT_IDS = [4624, 4625, 4648, 4634, 4672, 4103, 4104, 7036, 1000, 9999, 12]


def evtx(spark: SparkSession, sf_dir: str) -> DataFrame:
    ids = ", ".join(map(str, EVENT_IDS))
    return table(spark, sf_dir, "events").selectExpr(
        "concat('host', user_id) AS host_id", "concat('img', user_id) AS image_id",
        "event_id AS record_number", f"{filetime('ts')} AS filetime",
        "CAST(event_id % 5 AS INT) AS level",
        "CASE event_id % 4 WHEN 0 THEN 'Security' WHEN 1 THEN '' WHEN 2 THEN 'http://x' END AS channel",
        "CASE event_id % 3 WHEN 0 THEN '' WHEN 2 THEN concat('PC-', user_id) END AS computer",
        "array(event_type, props, concat('user', user_id), CASE WHEN event_id % 2 = 0"
        " THEN concat('C:', chr(92), 'jobs', chr(92), event_type, '.ps1') ELSE concat('value is ', value) END,"
        " 'SYSTEM', concat('WS-', upper(event_type), user_id), 'Level',"
        " concat('a much longer line about ', event_type, ' number ', event_id)) AS strings",
        "array(event_id % 13, 3L) AS u32s",
        "concat('Microsoft-Windows-', event_type, '%4Operational.evtx') AS file_name",
        f"array({ids})[event_id % {len(EVENT_IDS)}] AS event_id")


# ---- file system ------------------------------------------------------------------------

def mft(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A four-way tree over the order keys; entry 0 is the root."""
    ft = filetime("o_orderdate")
    return table(spark, sf_dir, "orders").selectExpr(
        "'host0' AS host_id", "'img0' AS image_id", "o_orderkey AS entry",
        "concat(lower(o_orderstatus), '-', o_orderkey) AS name", "o_orderkey div 4 AS parent",
        f"array({ft}, {ft} + (o_orderkey % 3) * {DAY_TICKS}, {ft} + (o_orderkey % 2) * {DAY_TICKS},"
        f" CASE WHEN o_orderkey % 7 = 0 THEN 0L ELSE {ft} END) AS si",
        f"CASE WHEN o_orderkey % 11 <> 0 THEN array({ft} + (o_orderkey % 5 - 2) * {DAY_TICKS}, {ft}, {ft}, {ft}) END AS fn")


def usn(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "lineitem").selectExpr(
        "'host0' AS host_id", "'img0' AS image_id",
        "CASE WHEN l_linenumber = 7 THEN -1L ELSE l_orderkey END AS parent_entry",
        f"{filetime('l_shipdate')} AS filetime", f"{USN_REASON} AS reason",
        "CASE WHEN l_returnflag = 'R' THEN 16L ELSE 32L END AS file_attrs",
        "CASE WHEN l_linenumber <> 6 THEN concat('f', l_partkey, '.dat') END AS file_name",
        "l_linestatus = 'O' AS recovered")


# Reason words put on journal records, by line number.
USN_REASON = ("CASE l_linenumber WHEN 1 THEN 256L WHEN 2 THEN 2147484160L WHEN 3 THEN 3L WHEN 4 THEN 16L"
              " WHEN 5 THEN 12292L ELSE 34816L END")


def usn_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One small journal page per line item: eight zero bytes, a record, a stray tail."""
    rows = table(spark, sf_dir, "lineitem").selectExpr(
        "*", f"{filetime('l_shipdate')} AS ft", f"{USN_REASON} AS reason", "concat('f', l_partkey, '.dat') AS name")
    name = utf16(F.col("name"))
    size = F.ceil((F.length(name) + 60) / 8) * 8
    body = F.concat(
        pack_le(size, 4), pack_le(F.when(F.col("l_linenumber") == 3, 3).otherwise(2), 2), pack_le(0, 2),
        pack_le(F.col("l_partkey"), 8), pack_le(F.col("l_orderkey") + (F.lit(7) * F.lit(1 << 48)), 8),
        pack_le(0, 8), pack_le(F.col("ft"), 8), pack_le(F.col("reason"), 4), pack_le(0, 4), pack_le(0, 4),
        pack_le(F.when(F.col("l_returnflag") == "R", 16).otherwise(32), 4),
        pack_le(F.length(name), 2), pack_le(60, 2), name)
    page = F.concat(pack_le(0, 8), pad_to(body, size), pack_le(13, 8))
    return rows.select(F.lit("host0").alias("host_id"), F.lit("img0").alias("image_id"), F.lit(0).cast("bigint").alias("chunk_off"),
                       page.alias("content"), F.lit(b"").alias("prev_tail"), F.lit(b"").alias("next_head"))


def write_journals(spark: SparkSession, sf_dir: str, path: str) -> None:
    """Journal files below ``path``: the small pages padded to 128 bytes, one behind the other.

    The text sink writes the bytes as they are; its separator is the zero byte that ends each block.
    """
    block = F.substring(pad_to(F.col("content"), 128), F.lit(1), F.lit(127))
    usn_chunks(spark, sf_dir).select(block.cast("string").alias("value")).write.option("lineSep", "\0").text(path)


def mft_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One 1024-byte file-table entry per order, laid out with two resident attributes."""
    rows = mft(spark, sf_dir).join(
        table(spark, sf_dir, "orders").selectExpr("o_orderkey AS entry", "o_orderstatus"), "entry")
    name = utf16(F.col("name"))

    def attribute(kind: int, content: Column) -> Column:
        size = F.ceil((F.length(content) + 24) / 8) * 8
        return pad_to(F.concat(pack_le(kind, 4), pack_le(size, 4), pack_le(0, 8),
                               pack_le(F.length(content), 4), pack_le(24, 2), pack_le(0, 2), content), size)

    def times(column: str) -> Column:
        return F.concat(*[pack_le(F.coalesce(F.get(F.col(column), F.lit(i)), F.lit(0)), 8) for i in range(4)])

    fn = F.concat(pack_le(F.col("parent") + F.lit(3) * F.lit(1 << 48), 8), times("fn"), pack_le(0, 24 - 16),
                  pack_le(0, 8), pack_le(32, 4), pack_le(0, 4), pack_le(F.length(name) / 2, 1),
                  pack_le(F.when(F.col("entry") % 13 == 0, 2).otherwise(1), 1), name)
    head = pad_to(F.concat(F.lit(b"FILE"), pack_le(48, 2), pack_le(3, 2), pack_le(0, 8), pack_le(1, 2),
                           pack_le(1, 2), pack_le(56, 2),
                           pack_le(F.when(F.col("o_orderstatus") == "P", 0).otherwise(1), 2)), 56)
    entry = F.concat(head, attribute(0x10, times("si")), attribute(0x30, fn), pack_le(0xFFFFFFFF, 4))
    return rows.select("image_id", (F.col("entry") * 1024).alias("chunk_off"), pad_to(entry, 1024).alias("content"))


def logfile(spark: SparkSession, sf_dir: str) -> DataFrame:
    ft = filetime("l_shipdate")
    return table(spark, sf_dir, "lineitem").selectExpr(
        "'host0' AS host_id", "'img0' AS image_id", "l_orderkey AS lsn",
        "array(2, 3, 12, 14, 18, 19, 33)[l_linenumber - 1] AS redo_op", "l_returnflag = 'R' AS is_dir",
        "CASE WHEN l_partkey % 9 <> 0 THEN concat('n', l_partkey) ELSE '' END AS fn_name",
        f"CASE WHEN l_suppkey % 2 = 0 OR l_linenumber > 2 THEN array({ft}, 0L, {ft} + 10, {ft}) END AS fn",
        f"array({ft}, {ft} + 5, 0L, {ft}) AS si")


def artifact_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A listing with one file per line item, spread over known and unknown places."""
    return table(spark, sf_dir, "lineitem").selectExpr(
        "'host0' AS host_id", "concat('img', l_suppkey % 3) AS image_id",
        f"CASE {' '.join(f'WHEN l_linenumber = {k} THEN {v}' for k, v in FILE_PLACES.items())} ELSE"
        " concat('Other/', l_orderkey) END AS path",
        "CAST(l_quantity AS BIGINT) * 1000 + l_linenumber AS length")


_KEY = "l_orderkey, '_', l_partkey, '_', l_suppkey"
# Paths of the derived listing, by line number.
FILE_PLACES = {
    1: f"concat('windows/SYSTEM32/winevt/Logs/', {_KEY}, '.EVTX')",
    2: "concat('Windows/Prefetch/a', l_orderkey, '.pf')",
    3: "concat('Users/u', l_suppkey, '/NTUSER.DAT')",
    4: f"concat('Users/u', l_suppkey, '/AppData/Local/Google/Chrome/User Data/P', l_partkey, '/History')",
    5: "'$MFT'",
    6: f"concat('Users/u', l_suppkey, '/deeper/', l_partkey, '/NTUSER.DAT')",
}


# ---- execution --------------------------------------------------------------------------

def prefetch(spark: SparkSession, sf_dir: str) -> DataFrame:
    ft = filetime("o_orderdate")
    return table(spark, sf_dir, "orders").selectExpr(
        "'host0' AS host_id", "'img0' AS image_id",
        "CASE WHEN o_orderkey % 17 = 0 THEN '' ELSE concat('APP', o_custkey, '.EXE') END AS exe_name",
        "CASE o_orderkey % 3 WHEN 0 THEN array(concat(chr(92), 'lib', chr(92), 'a.dll'),"
        " concat(chr(92), 'bin', chr(92), 'app', o_custkey, '.exe')) WHEN 1 THEN"
        " array(concat(chr(92), 'x', o_orderkey)) ELSE CAST(array() AS ARRAY<STRING>) END AS files",
        "o_orderkey AS run_count", f"array({ft}, 0L, {ft} + 70, 5L) AS run_times",
        "o_orderkey AS hash", "30 AS version")


def lnk(spark: SparkSession, sf_dir: str) -> DataFrame:
    ft = filetime("o_orderdate")
    return table(spark, sf_dir, "orders").selectExpr(
        "'host0' AS host_id", "'img0' AS image_id",
        "CASE WHEN o_orderkey % 5 = 0 THEN '' ELSE concat('C:', chr(92), 'd', chr(92), o_orderkey, '.txt') END AS target_path",
        "CASE WHEN o_orderkey % 3 = 0 THEN 'DATA' ELSE '' END AS volume_label",
        "CASE WHEN o_orderkey % 4 = 0 THEN o_orderpriority ELSE '' END AS arguments",
        "CASE WHEN o_orderkey % 7 = 0 THEN 'ws01' ELSE '' END AS machine_id", "'' AS droid_file_id",
        "CAST(o_orderkey % 8 AS INT) AS drive_type",
        "CASE WHEN o_orderkey % 2 = 0 THEN o_orderkey * 65537 ELSE 0L END AS drive_serial",
        f"{ft} AS created", f"CASE WHEN o_orderstatus = 'F' THEN 0L ELSE {ft} + 1 END AS accessed",
        f"CASE WHEN o_orderstatus = 'P' THEN 9L ELSE {ft} + 2 END AS written")


def jumplist(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "orders").selectExpr(
        "'host0' AS host_id", "'img0' AS image_id",
        "CASE WHEN o_orderkey % 6 = 0 THEN '' ELSE concat('D:', chr(92), o_orderpriority) END AS target_path",
        f"CASE WHEN o_orderstatus = 'P' THEN 0L ELSE {filetime('o_orderdate')} END AS filetime",
        "4 AS destlist_version")


def pca_launch_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "orders").selectExpr(
        "concat('pca/', o_orderkey) AS path",
        "concat(' C:', chr(92), 'café', chr(92), o_orderkey, '.exe |', CAST(CAST(o_orderdate AS DATE) AS STRING),"
        " ' 01:02:03.', o_orderkey % 1000, chr(13), chr(10), 'no bar here', chr(10), 'C:', chr(92),"
        " 'bad.exe|yesterday', chr(10), chr(10), 'x.exe|2024-02-30 00:00:00') AS text")
    return rows.select("path", F.encode("text", "ISO-8859-1").alias("content"))


def pca_general_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document as one file: each text line becomes the path field of a record."""
    line = F.transform(F.split("text", "\n"), lambda x, i: F.concat_ws(
        "|", F.format_string("2024-01-%02d 00:00:%02d", i % 28 + 1, i % 60), (i % 7).cast("string"),
        F.translate(x, "|", "/"), F.lit("desc"), F.when(i % 2 == 0, F.concat(F.lit("Co"), i.cast("string"))).otherwise(""),
        F.lit("1.0"), F.lit("id"), F.when(i % 3 == 0, F.lit("exit")).otherwise("")))
    text = F.concat(F.lit("\ufeff"), F.array_join(line, "\r\n"), F.lit("\r\n\r\nonly|two"))
    return table(spark, sf_dir, "documents").select(
        F.concat(F.lit("pca/"), F.col("doc_id").cast("string")).alias("path"), utf16(text).alias("content"))


# ---- text files -------------------------------------------------------------------------

def wer_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document inside one report, between the known keys; odd documents as UTF-16."""
    rows = table(spark, sf_dir, "documents").selectExpr(
        "doc_id", "concat('WER/App_', doc_id, '/Report.wer') AS path",
        f"concat('EventType=', lang, chr(10), text, chr(10), CASE WHEN doc_id % 10 = 0 THEN 'EventTime=soon' ELSE"
        f" concat('EventTime = ', {FT_EPOCH} + doc_id * 10000000) END, chr(13), chr(10), 'Sig[0].Value=', chr(10),"
        " CASE WHEN doc_id % 4 = 0 THEN '' ELSE concat('Sig[0].Value=app', doc_id, '=x', chr(10)) END,"
        " 'Sig[0].Value=late', CASE WHEN doc_id % 3 = 0 THEN concat(chr(10), 'Sig[1].Value=', n_chars) ELSE '' END) AS text")
    plain = F.encode("text", "UTF-8")
    wide = F.concat(F.lit(b"\xff\xfe"), utf16(F.col("text")))
    return rows.select("path", F.when(F.col("doc_id") % 2 == 0, plain).otherwise(wide).alias("content"))


def task_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "orders").selectExpr(
        "o_orderkey", "concat('Tasks/', o_orderstatus, '/t', o_orderkey, CASE WHEN o_orderkey % 29 = 0 THEN '.job' ELSE '' END) AS path",
        "concat('<?xml version=\"1.0\" encoding=\"UTF-16\"?><Task xmlns=\"http://t\"><RegistrationInfo>',"
        " CASE WHEN o_orderkey % 4 <> 0 THEN concat('<Date>', CAST(CAST(o_orderdate AS DATE) AS STRING), 'T10:30:00.1234567</Date>') ELSE '' END,"
        " CASE WHEN o_orderkey % 3 = 0 THEN concat('<Author>A &amp; ', o_custkey, '</Author>') ELSE '' END,"
        " '</RegistrationInfo><Triggers>', CASE WHEN o_orderkey % 5 <> 0 THEN concat('<CalendarTrigger><StartBoundary>',"
        " CAST(CAST(o_orderdate AS DATE) AS STRING), 'T11:00:00Z</StartBoundary></CalendarTrigger>') ELSE '' END,"
        " '</Triggers><Actions>', CASE WHEN o_orderkey % 7 <> 0 THEN concat('<Exec><Command>c', o_custkey, '.exe</Command>',"
        " CASE WHEN o_orderkey % 2 = 0 THEN '<Arguments>-x 1</Arguments>' ELSE '' END, '</Exec>') ELSE '' END,"
        " '</Actions></Task>', CASE WHEN o_orderkey % 31 = 0 THEN '<broken' ELSE '' END) AS xml")
    wide = F.concat(F.lit(b"\xff\xfe"), utf16(F.col("xml")))
    return computed_once(rows, "path", F.when(F.col("o_orderkey") % 2 == 0, wide).otherwise(F.encode("xml", "UTF-8")).alias("content"))


def history_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every line of every document as a shell command; each fifth line a comment, each seventh padded."""
    return table(spark, sf_dir, "documents").select(
        F.concat(F.lit("hist/"), F.col("doc_id").cast("string")).alias("path"),
        F.timestamp_seconds(F.col("doc_id") + 1_700_000_000).alias("mtime"),
        F.posexplode(F.split("text", "\n")).alias("i", "line"),
    ).select("path", "mtime", F.when(F.col("i") % 5 == 4, F.concat(F.lit(" # "), "line"))
             .when(F.col("i") % 7 == 6, F.concat(F.lit("\t "), F.col("line"), F.lit("  "))).otherwise(F.col("line")).alias("value"))


def recycle_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One note per order in layout 1, 2 or an unknown 3."""
    rows = table(spark, sf_dir, "orders").selectExpr(
        "o_orderkey", "concat('$Recycle.Bin/$I', o_orderkey) AS path", "o_orderkey % 4 AS kind",
        f"CASE WHEN o_orderkey % 13 = 0 THEN 0L ELSE {filetime('o_orderdate')} END AS ft",
        "CASE WHEN o_orderkey % 10 = 9 THEN '' ELSE concat('C:', chr(92), 'del', chr(92), o_orderpriority, o_orderkey) END AS name",
        "CAST(o_totalprice * 5000 AS BIGINT) AS size")
    name = F.concat(utf16(F.col("name")), pack_le(0, 2))
    version = F.when(F.col("kind") == 0, 1).when(F.col("kind") == 3, 3).otherwise(2)
    head = F.concat(pack_le(version, 8), pack_le(F.col("size"), 8), pack_le(F.col("ft"), 8))
    body = F.when(version == 1, F.concat(head, pad_to(name, 520))).otherwise(
        F.concat(head, pack_le(F.length(name) / 2, 4), name))
    return computed_once(rows, "path", body.alias("content"))


# ---- registry ---------------------------------------------------------------------------

def registry_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An eight-way key tree over the order keys with zero to eight values per key."""
    rows = table(spark, sf_dir, "orders").selectExpr(
        "'host0' AS host_id", "'img0' AS image_id", "'h0' AS hive_id", "'C:/x/software' AS hive_file",
        "o_orderkey AS rel_off", "o_orderkey div 8 AS parent_rel",
        "CASE WHEN o_orderkey = 0 THEN 'ROOT' ELSE concat('k', o_orderkey) END AS name",
        "CASE WHEN o_orderkey = 0 THEN 4 ELSE 0 END AS flags",
        f"CASE WHEN o_orderkey % 9 = 8 THEN 0L ELSE {filetime('o_orderdate')} END AS last_write",
        "o_orderpriority", "o_orderkey", "o_custkey")

    def value(i: Column) -> Column:
        return F.struct(
            F.when(i == 0, "").otherwise(F.concat(F.lit("v"), i.cast("string"))).alias("name"),
            F.when(i % 2 == 0, 1).otherwise(4).alias("type"),
            F.when(i % 2 == 0, utf16(F.concat("o_orderpriority", F.lit("\0")))).otherwise(pack_le(F.col("o_custkey"), 4)).alias("raw"),
            F.lit(None).cast("string").alias("text"))

    count = (F.col("o_orderkey") % 9).cast("int")
    values = F.transform(F.when(count > 0, F.sequence(F.lit(0), count - 1)).otherwise(F.array().cast("array<int>")), value)
    return rows.withColumn("values", values)


# Key paths that reach each registry rule, by order key modulo their number.
RULE_PATHS = [
    "HKCU\\Software\\Microsoft\\Windows\\CurrentVersion\\Run",
    "HKCU\\Software\\Microsoft\\Windows\\CurrentVersion\\RunOnce",
    "HKLM\\SOFTWARE\\Microsoft\\Windows\\CurrentVersion\\RunServices",
    "HKCU\\Software\\Microsoft\\Windows\\CurrentVersion\\Explorer\\UserAssist\\{G}\\Count",
    "HKLM\\SYSTEM\\ControlSet001\\Services\\bam\\State\\UserSettings\\S-1-5-21",
    "HKLM\\SYSTEM\\ControlSet001\\Control\\Session Manager\\AppCompatCache",
    "HKCU\\Software\\Explorer\\RecentDocs\\.txt",
    "HKCU\\Software\\ComDlg32\\OpenSavePidlMRU\\txt",
    "HKCU\\Software\\ComDlg32\\OpenSaveMRU\\txt",
    "HKCU\\Software\\ComDlg32\\LastVisitedMRU",
    "HKCU\\Software\\Microsoft\\Office\\16.0\\Word\\File MRU",
    "HKCU\\Software\\Microsoft\\Windows\\Shell\\BagMRU\\0",
    "HKLM\\SOFTWARE\\Vendor\\Plain",
]


def ruled_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Keys with a known path and three text values (none for every sixth key)."""
    paths = F.array(*[F.lit(p) for p in RULE_PATHS])
    rows = table(spark, sf_dir, "orders").select(
        F.lit("host0").alias("host_id"), F.lit("img0").alias("image_id"), F.lit("h0").alias("hive_id"),
        F.col("o_orderkey").alias("rel_off"), F.col("o_orderpriority").alias("name"), F.expr(filetime("o_orderdate")).alias("last_write"),
        F.element_at(paths, (F.col("o_orderkey") % len(RULE_PATHS) + 1).cast("int")).alias("full_path"), "o_orderkey", "o_custkey")

    def text_value(name: str, text: Column) -> Column:
        return F.struct(F.lit(name).alias("name"), F.lit(1).alias("type"), F.lit(None).cast("binary").alias("raw"), text.alias("text"))

    key = F.col("o_orderkey").cast("string")
    some = F.array(
        text_value("Item 1", F.concat(F.lit("[F00]C:\\docs\\a"), key, F.lit(".docx"))),
        text_value("", F.concat(F.lit("deadbeef"), F.lpad(F.col("o_custkey").cast("string"), 8, "0"))),
        text_value("MRUListEx", F.lit("C:\\skip\\me")))
    none = F.slice(some, 1, 0)
    return rows.withColumn("values", F.when(F.col("o_orderkey") % 6 == 5, none).otherwise(some)).drop("o_orderkey", "o_custkey")


def shellbag_nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "orders").selectExpr(
        "'host0' AS host_id", "'img0' AS image_id", "'h0' AS hive_id", "o_orderkey AS node", "o_orderkey div 4 AS parent",
        "CAST(o_orderkey % 4 AS INT) AS slot", "o_orderkey = 0 AS is_root",
        f"CASE WHEN o_orderkey % 10 = 9 THEN 0L ELSE {filetime('o_orderdate')} END AS last_write")


def shellbag_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "orders").selectExpr(
        "'h0' AS hive_id", "o_orderkey div 4 AS node", "CAST(o_orderkey % 4 AS INT) AS slot",
        "CASE WHEN o_orderkey % 23 <> 22 THEN concat('d', o_orderkey % 3) END AS item_name")


# ---- resource usage ---------------------------------------------------------------------

SID_BASE = 1_000_000


def srum_idmap(spark: SparkSession, sf_dir: str) -> DataFrame:
    parts = table(spark, sf_dir, "part").selectExpr(
        "'db0' AS db_id", "CAST(p_partkey AS INT) AS id_index", "0 AS id_type",
        "CASE p_size % 3 WHEN 0 THEN concat('!!', p_name, '.exe!', p_brand, '!x') WHEN 1 THEN p_name ELSE '' END AS id_text",
        "CAST(NULL AS BINARY) AS id_blob")
    key = F.col("s_suppkey")
    sid = F.concat(F.lit(bytes([1, 3, 0, 0, 0, 0, 0, 5])), pack_le(21, 4), pack_le(key * 1000, 4),
                   pack_le(F.lit(500) + key % 3, 4))
    users = table(spark, sf_dir, "supplier").select(
        F.lit("db0").alias("db_id"), (key + SID_BASE).cast("int").alias("id_index"), F.lit(3).alias("id_type"),
        F.lit(None).cast("string").alias("id_text"),
        F.when(key % 7 == 6, F.lit(bytes([1, 1, 0]))).otherwise(sid).alias("id_blob"))
    return parts.unionByName(users)


_OLE = f"CAST({micros('l_shipdate')} AS DOUBLE) / 86400000000.0 + 25569.0"


def _usage(spark: SparkSession, sf_dir: str, *more: str) -> DataFrame:
    return table(spark, sf_dir, "lineitem").selectExpr(
        "'host0' AS host_id", "'img0' AS image_id", "'db0' AS db_id",
        f"CASE l_linenumber WHEN 1 THEN {_OLE} WHEN 2 THEN 0.0D END AS ts_ole",
        f"CASE WHEN l_linenumber > 3 THEN {filetime('l_shipdate')} WHEN l_linenumber = 3 THEN 5L END AS ts_long",
        "CASE WHEN l_linenumber <> 6 THEN CAST(l_partkey AS INT) END AS app_id",
        f"CASE WHEN l_linenumber <> 5 THEN CAST(l_suppkey + {SID_BASE} AS INT) END AS user_id", *more)


def srum_app(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _usage(spark, sf_dir, "l_partkey * 1000 AS fg_cycles", "CAST(l_quantity AS BIGINT) AS bg_cycles",
                  "CAST(l_tax * 100 AS BIGINT) AS fg_read", "CAST(NULL AS BIGINT) AS bg_read",
                  "CAST(l_discount * 100 AS BIGINT) AS fg_write", "l_suppkey * 12345 AS bg_write")


def srum_net(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _usage(spark, sf_dir, "CAST(l_extendedprice * 100 AS BIGINT) AS bytes_sent",
                  "CAST(l_discount * 100 AS BIGINT) * 4096 AS bytes_recvd")


def srum_conn(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _usage(spark, sf_dir,
                  f"CASE WHEN l_returnflag = 'R' THEN {filetime('l_shipdate')} + 7 ELSE 0L END AS connect_start",
                  "CASE WHEN l_returnflag = 'A' THEN concat('net', l_suppkey) ELSE '' END AS profile_name",
                  "CAST(l_quantity AS BIGINT) - 1 AS connected_secs",
                  "array(6, 23, 71, 131, 99, CAST(NULL AS INT), 6)[l_linenumber - 1] AS interface_type")


# ---- application inventory --------------------------------------------------------------

def _inventory(spark: SparkSession, sf_dir: str, *more: str, hives: int = 50) -> DataFrame:
    return table(spark, sf_dir, "orders").selectExpr(
        "'host0' AS host_id", "'img0' AS image_id", f"concat('hive', o_custkey % {hives}) AS hive_id",
        "concat('key', o_orderkey) AS key_name",
        f"CASE WHEN o_orderkey % 8 = 7 THEN 0L ELSE {filetime('o_orderdate')} END AS last_write", *more)


def amcache_file(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _inventory(
        spark, sf_dir, "CASE WHEN o_orderkey % 3 = 0 THEN concat('c:', chr(92), o_orderkey) ELSE '' END AS lower_case_long_path",
        "CASE WHEN o_orderkey % 3 = 1 THEN concat('D:', chr(92), o_orderkey) END AS full_path",
        "CASE WHEN o_orderkey % 2 = 0 THEN o_orderpriority END AS name",
        "CASE o_orderkey % 4 WHEN 0 THEN concat('0000ab', o_orderkey) WHEN 1 THEN concat('cd', o_orderkey) WHEN 2 THEN '' END AS file_id")


def amcache_driver(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _inventory(
        spark, sf_dir, "CASE WHEN o_orderkey % 2 = 0 THEN concat('drv', o_orderkey, '.sys') END AS image_path",
        "CASE WHEN o_orderkey % 3 = 0 THEN o_orderpriority END AS driver_name",
        "CASE WHEN o_orderkey % 4 = 0 THEN concat('c', o_custkey) END AS checksum",
        "CASE WHEN o_orderkey % 5 = 0 THEN 'oem.inf' ELSE '' END AS inf_path", "o_orderstatus AS driver_type")


def amcache_app(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _inventory(
        spark, sf_dir, "CASE WHEN o_orderkey % 6 <> 0 THEN o_orderpriority END AS name",
        "CASE WHEN o_orderkey % 2 = 0 THEN concat('pub', o_custkey) ELSE '' END AS publisher",
        "CASE WHEN o_orderkey % 3 = 0 THEN '1.0' END AS version",
        "CASE WHEN o_orderkey % 5 = 0 THEN CAST(CAST(o_orderdate AS DATE) AS STRING) END AS install_date")


def amcache_legacy(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Twenty of its seventy hives are of the old layout alone."""
    return _inventory(
        spark, sf_dir, "CASE WHEN o_orderkey % 2 = 0 THEN concat('old', o_orderkey) END AS v15",
        "CASE WHEN o_orderkey % 3 = 0 THEN concat('0000', o_custkey) END AS v101",
        f"CASE WHEN o_orderkey % 5 = 0 THEN {filetime('o_orderdate')} + 11 ELSE 0L END AS v17", hives=70)


# ---- browsing ---------------------------------------------------------------------------

def chromium_visits(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").selectExpr(
        "'host0' AS host_id", "'img0' AS image_id", "concat('db', user_id % 10) AS db_id",
        "CASE WHEN user_id % 2 = 0 THEN 'Chrome' ELSE 'Edge' END AS browser", "event_id % 300 AS url_id",
        f"CASE WHEN event_id % 19 = 0 THEN 0L ELSE {micros('ts')} + 11644473600000000 END AS visit_time")


def chromium_urls(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every page in each of the ten databases; titles blank, equal to the URL, or telling."""
    return table(spark, sf_dir, "pages").selectExpr(
        "page_id AS id", "url", "CASE page_id % 3 WHEN 0 THEN '' WHEN 1 THEN url ELSE concat('page ', page_id) END AS title",
        "explode(sequence(0, 9)) AS _db").selectExpr("concat('db', _db) AS db_id", "id", "url", "title")


def chromium_downloads(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "lineitem").selectExpr(
        "'host0' AS host_id", "'img0' AS image_id", "'db0' AS db_id", "'Chrome' AS browser",
        f"CASE WHEN l_linenumber = 7 THEN 0L ELSE {micros('l_shipdate')} + 11644473600000000 END AS start_time",
        "CASE WHEN l_linenumber <> 2 THEN concat('C:', chr(92), 'dl', chr(92), 'f', l_partkey, '.zip') ELSE '' END AS target_path",
        "CASE WHEN l_linenumber <> 3 THEN concat('http://s', l_suppkey) ELSE '' END AS tab_url",
        "CASE WHEN l_linenumber < 4 THEN l_partkey * 1000 ELSE 0L END AS received_bytes",
        "CASE WHEN l_linenumber = 5 THEN 0L ELSE l_orderkey END AS total_bytes")


def moz_visits(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").selectExpr(
        "'host0' AS host_id", "'img0' AS image_id", "concat('db', user_id % 10) AS db_id", "event_id % 300 AS place_id",
        f"CASE WHEN event_id % 19 = 0 THEN 0L ELSE {micros('ts')} END AS visit_date")


def moz_annos(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "lineitem").selectExpr(
        "'host0' AS host_id", "'img0' AS image_id", "concat('db', l_suppkey % 10) AS db_id", "l_partkey % 300 AS place_id",
        "CAST(l_linenumber AS BIGINT) AS anno_attribute_id",
        f"CASE WHEN l_returnflag = 'N' THEN 0L ELSE {micros('l_shipdate')} END AS date_added",
        "CASE WHEN l_orderkey % 5 = 0 THEN '' ELSE concat('file:///C:/dl/', l_orderkey, '.bin') END AS content")


def moz_anno_attributes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Attribute ids by database: which line numbers mean a download depends on the nation key."""
    return table(spark, sf_dir, "nation").selectExpr(
        "concat('db', n_nationkey % 10) AS db_id", "CAST(n_nationkey % 7 + 1 AS BIGINT) AS id",
        "CASE WHEN n_regionkey < 3 THEN 'downloads/destinationFileURI' ELSE 'other' END AS name")


def activity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").selectExpr(
        "'host0' AS host_id", "'img0' AS image_id", "concat('act', user_id % 5, '.db') AS db_id",
        "CASE event_id % 4 WHEN 0 THEN '[{\"application\":\"\"},{\"application\":\"C:\\\\\\\\bin\\\\\\\\app.exe\"}]'"
        " WHEN 1 THEN concat('[{\"application\":\"', event_type, '\"}]') WHEN 2 THEN '{\"application\":\"x\"}' ELSE 'bad' END AS app_id",
        "CAST(array(5, 6, 11, 12, 15, 16, 99)[event_id % 7] AS INT) AS activity_type",
        f"CASE WHEN event_id % 3 = 0 THEN 0L ELSE {micros('ts')} div 1000000 END AS start_time", "0L AS end_time",
        f"CASE WHEN event_id % 6 = 0 THEN 0L ELSE {micros('ts')} div 1000000 + 5 END AS last_modified_time",
        "CASE event_id % 5 WHEN 0 THEN props WHEN 1 THEN concat('{\"displayText\":\" ', event_type, ' ', event_id, ' \"}')"
        " WHEN 2 THEN concat('{\"payload\":{\"description\":\"in ', event_type, '\"}}')"
        " WHEN 3 THEN concat('{\"userTimeline\":\"{\\\\\"contentUri\\\\\":\\\\\"', event_type, '\\\\\"}\"}') END AS payload")
