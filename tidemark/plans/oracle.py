"""The same results in DuckDB SQL, for comparison with ``plans.queries``.

Written against the raw tables; only the fixed word lists and code tables are shared with
the library.
"""

from __future__ import annotations

from ..functions import lookups as L
from .records_from_tables import DAY_TICKS, EVENT_IDS, FT_EPOCH, RULE_PATHS, SID_BASE

ORACLE: dict[str, str] = {}

BS = "chr(92)"
I64_MAX = 9_223_372_036_854_775_807


def ft(c: str) -> str:
    return f"(epoch_us({c}) * 10 + {FT_EPOCH})"


def ft_ns(c: str) -> str:
    """FILETIME expression to nanoseconds, 0 when unusable."""
    return f"(CASE WHEN {c} BETWEEN {FT_EPOCH} AND {FT_EPOCH + I64_MAX // 100} THEN ({c} - {FT_EPOCH}) * 100 ELSE 0 END)"


def iso(ns: str) -> str:
    return (f"strftime(make_timestamp({ns} // 1000), '%Y-%m-%dT%H:%M:%S') || CASE WHEN {ns} % 1000000000 = 0 THEN '' "
            f"ELSE '.' || rtrim(lpad(CAST({ns} % 1000000000 AS VARCHAR), 9, '0'), '0') END || 'Z'")


def q(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def in_list(words) -> str:
    return "(" + ", ".join(q(w) for w in words) + ")"


def pick(words, index: str) -> str:
    """SQL list element by 0-based index expression."""
    return f"list_extract([{', '.join(words)}], CAST({index} + 1 AS BIGINT))"


def case_of(code: str, names: dict, default: str) -> str:
    arms = " ".join(f"WHEN {code} = {q(k) if isinstance(k, str) else k} THEN {q(v)}" for k, v in names.items())
    return f"CASE {arms} ELSE {default} END"


def group3(n: str) -> str:
    """Thousands grouping."""
    return f"format('{{:,}}', CAST({n} AS BIGINT))"


def parts(sep: str, *items: str) -> str:
    """Join the items that are neither null nor empty-marked (null) by ``sep``."""
    return f"array_to_string(list_filter([{', '.join(items)}], lambda p: p IS NOT NULL), {q(sep)})"


def pre(prefix: str, c: str) -> str:
    return f"CASE WHEN {c} <> '' THEN {q(prefix)} || {c} END"


def events(rows: str, *, kind: str, source: str, artifact: str, message: str, ns: str = "ns", macb: str = "'M'",
           file_path: str = "NULL", hostname: str = "''", is_fn: str = "false", short: str | None = None,
           host: str = "host_id", image: str = "image_id", more: str = "") -> str:
    """Event columns over a row query."""
    inner = (f"SELECT {host} AS host_id, {image} AS image_id, {ns} AS ns, {macb} AS macb, {artifact} AS artifact, "
             f"{hostname} AS hostname, {file_path} AS file_path, {message} AS message, {is_fn} AS is_fn"
             f"{', ' + more if more else ''} FROM ({rows}) r")
    extra = ", " + more.split(" AS ")[-1] if more else ""
    return (f"SELECT CAST(host_id AS VARCHAR) AS host_id, CAST(image_id AS VARCHAR) AS image_id, {q(kind)} AS artifact_type, "
            f"CAST(CASE WHEN ns >= 0 THEN ns ELSE 0 END AS BIGINT) AS timestamp_ns, "
            f"{iso('(CASE WHEN ns >= 0 THEN ns ELSE 0 END)')} AS timestamp_iso, macb, {q(source)} AS source, artifact, "
            f"hostname, CAST(NULLIF(file_path, '') AS VARCHAR) AS file_path, message, "
            f"{short or 'left(message, 80)'} AS message_short, is_fn AS is_fn_timestamp, CAST(0 AS INTEGER) AS tz_offset_secs"
            f"{extra} FROM ({inner}) e")


# ---- scalar functions -------------------------------------------------------------------

ORACLE["filetime_to_ns"] = f"""
WITH r AS (SELECT event_id, CASE event_id % 7 WHEN 0 THEN 0 WHEN 1 THEN {FT_EPOCH} - event_id
             WHEN 2 THEN {I64_MAX} - event_id ELSE {ft('ts')} + event_id % 10 END AS f FROM events)
SELECT event_id, {ft_ns('f')} AS ns,
       CASE WHEN {ft_ns('f')} > 7258118400000000000 THEN 0 ELSE {ft_ns('f')} END AS capped_ns FROM r"""

ORACLE["browser_times_to_ns"] = """
SELECT event_id,
       CASE WHEN event_id % 5 < 2 THEN 0 ELSE epoch_us(ts) * 1000 END AS webkit_ns,
       CASE WHEN event_id % 4 = 0 THEN 0 ELSE epoch_us(ts) * 1000 END AS unix_us_ns,
       CASE WHEN event_id % 3 = 0 THEN 0 ELSE epoch_us(ts) // 1000000 * 1000000000 END AS unix_s_ns
FROM events"""

ORACLE["ole_to_ns"] = """
WITH r AS (SELECT event_id, CASE event_id % 6 WHEN 0 THEN 0.5 WHEN 1 THEN 25000.25 + event_id WHEN 2 THEN 120001.0
             ELSE CAST(epoch_us(ts) AS DOUBLE) / 86400000000.0 + 25569.0 END AS d FROM events)
SELECT event_id, CASE WHEN d BETWEEN 1 AND 120000
       THEN greatest(CAST(trunc((CAST(d AS DOUBLE) - 25569.0::DOUBLE) * 86400.0::DOUBLE * 1e9::DOUBLE) AS BIGINT), 0) // 1000000
       ELSE 0 END AS ms FROM r"""

ORACLE["srum_times"] = f"""
WITH r AS (SELECT event_id,
             CASE WHEN event_id % 5 = 0 THEN 40000.0::DOUBLE + event_id
                  WHEN event_id % 3 = 0 THEN 32768.0::DOUBLE + (event_id * 123456789)::DOUBLE / 137438953472.0::DOUBLE END AS d,
             CASE WHEN event_id % 3 = 1 THEN {ft('ts')} END AS l FROM events)
SELECT event_id, CASE WHEN d BETWEEN 1 AND 120000
       THEN CAST(trunc((d - 25569.0::DOUBLE) * 86400.0::DOUBLE * 1e9::DOUBLE) AS BIGINT)
       WHEN l IS NOT NULL THEN {ft_ns('l')} ELSE 0 END AS ns FROM r"""

ORACLE["text_times"] = """
SELECT event_id,
       CASE event_id % 4 WHEN 0 THEN epoch_us(ts) // 1000000 * 1000000000 WHEN 1 THEN epoch_us(ts) * 1000 ELSE 0 END AS plain_ns,
       CASE event_id % 4 WHEN 0 THEN epoch_us(ts) // 60000000 * 60000000000 WHEN 1 THEN epoch_us(ts) * 1000 + 789
            WHEN 2 THEN 0 ELSE epoch_us(ts) // 1000000 * 1000000000 END AS iso_ns,
       epoch_us(ts) * 1000 - CASE WHEN event_id % 2 = 0 THEN 1 ELSE -1 END * (event_id % 720) * 60000000000 AS wmi_ns
FROM events"""

ORACLE["ns_to_iso"] = f"""
WITH r AS (SELECT event_id, CASE WHEN event_id % 11 = 0 THEN epoch_us(ts) // 1000000 * 1000000000
             ELSE epoch_us(ts) * 1000 + event_id % 1000 END AS ns FROM events)
SELECT event_id, {iso('ns')} AS iso, CASE WHEN event_id % 3 = 2 THEN event_id ELSE 0 END AS clamped FROM r"""

ORACLE["bytes_le"] = """
SELECT l_orderkey, l_linenumber, l_partkey, l_partkey % 65536 AS u16, l_orderkey + 2147483648 AS u32,
       l_orderkey * 4294967296 + l_suppkey AS i64, CAST(0 AS BIGINT) AS past_end, l_returnflag AS counted,
       l_returnflag AS wide, 'abc' AS narrow FROM lineitem"""

_BITS = ("(CASE WHEN l_linestatus = 'F' THEN 64 + CASE WHEN l_returnflag = 'R' THEN 2147483648 ELSE 0 END ELSE "
         "CAST(l_quantity AS BIGINT) * 256 + l_linenumber + CASE WHEN l_returnflag = 'R' THEN 2147483648 ELSE 0 END END)")


def reasons(c: str, ascending: bool = False) -> str:
    bits = sorted(L.USN_REASONS) if ascending else L.USN_REASONS
    names = parts("|", *[f"CASE WHEN ({c} & {b}) <> 0 THEN '{n}' END" for b, n in bits])
    return f"CASE WHEN {names} <> '' THEN {names} ELSE '0x' || lpad(upper(to_hex({c})), 8, '0') END"


ORACLE["usn_reason_text"] = f"""
WITH r AS (SELECT *, {_BITS} AS bits FROM lineitem)
SELECT l_orderkey, l_linenumber, l_partkey, {reasons('bits')} AS reasons, {reasons('bits', True)} AS ascending FROM r"""


def cut(c: str, n: int) -> str:
    return f"CASE WHEN length({c}) > {n} THEN left({c}, {n}) || '...' ELSE {c} END"


ORACLE["short_text"] = f"SELECT doc_id, {cut('text', 120)} AS cut, left(text, 80) AS short FROM documents"


def size_sql(c: str) -> str:
    return (f"CASE WHEN {c} >= 1073741824 THEN printf('%.1f GB', {c} / 1073741824.0::DOUBLE) "
            f"WHEN {c} >= 1048576 THEN printf('%.1f MB', {c} / 1048576.0::DOUBLE) "
            f"WHEN {c} >= 1024 THEN ({c} // 1024) || ' KB' ELSE {c} || ' bytes' END")


ORACLE["size_text"] = f"""
WITH r AS (SELECT *, CAST(trunc(l_extendedprice * 100) AS BIGINT) * CASE l_linenumber WHEN 1 THEN 1000 WHEN 2 THEN 1
             WHEN 3 THEN 300000 ELSE 20 END AS size FROM lineitem)
SELECT l_orderkey, l_linenumber, l_partkey, {size_sql('size')} AS size, {size_sql('l_partkey')} AS small,
       {group3('size')} AS grouped FROM r"""

_ROT = ("translate({}, 'abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ', "
        "'nopqrstuvwxyzabcdefghijklmNOPQRSTUVWXYZABCDEFGHIJKLM')")


def base_sql(c: str) -> str:
    return f"list_extract(string_split({c}, {BS}), -1)"


ORACLE["rot13_names"] = f"""
SELECT p_partkey, 'P:' || {BS} || 'Cnegf' || {BS} || {_ROT.format('p_name')} AS turned, {_ROT.format('p_name')} AS base,
       'C:' || {BS} || 'x' || {BS} || p_name AS path FROM part"""

_SID = "'S-1-5-21-' || s_suppkey * 1000 || '-' || (500 + s_suppkey % 3)"


def sid_name(c: str) -> str:
    return (f"CASE WHEN {c} LIKE '%-500' THEN 'Administrator (' || {c} || ')' WHEN {c} LIKE '%-501' THEN "
            f"'Guest (' || {c} || ')' ELSE {case_of(c, L.KNOWN_SIDS, c)} END")


ORACLE["sid_names"] = f"""
WITH r AS (SELECT s_suppkey, CASE WHEN s_suppkey % 7 <> 6 THEN {_SID} END AS built,
             {pick([q(s) for s in L.KNOWN_SIDS], f's_suppkey % {len(L.KNOWN_SIDS)}')} AS sid FROM supplier)
SELECT CAST(s_suppkey AS INTEGER) AS id_index, built, {sid_name('built')} AS built_name, {sid_name('sid')} AS known_name FROM r"""

ORACLE["reg_value_text"] = f"""
WITH r AS (SELECT *, l_returnflag || chr(0) || repeat(l_linestatus, CAST(l_partkey % 100 + 1 AS BIGINT)) AS txt,
             l_returnflag || ' | ' || repeat(l_linestatus, CAST(l_partkey % 100 + 1 AS BIGINT)) AS multi,
             lpad(lower(to_hex(l_orderkey)), 16, '0') AS big FROM lineitem),
 h AS (SELECT *, big[15:16] || big[13:14] || big[11:12] || big[9:10] || big[7:8] || big[5:6] || big[3:4] || big[1:2] AS le FROM r),
 v AS (SELECT *, CASE l_linenumber WHEN 1 THEN {cut('txt', 80)} WHEN 2 THEN le || le || CASE WHEN l_suppkey % 3 > 0 THEN '...' ELSE '' END
         WHEN 3 THEN CAST(l_orderkey AS VARCHAR) WHEN 4 THEN CAST(CAST('0x' || le[1:8] AS BIGINT) AS VARCHAR)
         WHEN 5 THEN {cut('multi', 80)} WHEN 6 THEN CAST(l_orderkey AS VARCHAR) ELSE le END AS text FROM h)
SELECT l_orderkey, l_linenumber, l_partkey, text, regexp_matches(rtrim(text, '.'), '^[0-9a-fA-F]{{8,}}$') AS hex FROM v"""

ORACLE["code_labels"] = f"""
WITH r AS (SELECT *, CAST(l_partkey % 140 AS INTEGER) AS c, CASE WHEN l_linenumber <> 7 THEN CAST(l_partkey % 140 AS INTEGER) END AS m FROM lineitem)
SELECT l_orderkey, l_linenumber, l_partkey, {case_of('c', L.LOGON_TYPES, "'Unknown'")} AS logon,
       {case_of('c', L.DRIVE_TYPES, "'Unknown'")} AS drive, {case_of('m', L.INTERFACE_TYPES, "'iface=' || m")} AS iface,
       {case_of('m', L.PCA_STATUSES, "'status=' || coalesce(m, -1)")} AS status,
       {case_of('m', L.ACTIVITY_TYPES, "'Type' || coalesce(CAST(m AS VARCHAR), 'None')")} AS activity,
       {case_of('l_linenumber', L.LEVEL_TAGS, "''")} AS level FROM r"""

_ACTIVITY = """
SELECT event_id, 'host0' AS host_id, 'img0' AS image_id, 'act' || user_id % 5 || '.db' AS db_id, event_type, props,
  CASE event_id % 4 WHEN 0 THEN '[{"application":""},{"application":"C:' || chr(92) || chr(92) || 'bin' || chr(92) || chr(92) || 'app.exe"}]'
    WHEN 1 THEN '[{"application":"' || event_type || '"}]' WHEN 2 THEN '{"application":"x"}' ELSE 'bad' END AS app_id,
  CASE event_id % 4 WHEN 0 THEN 'app.exe' WHEN 1 THEN event_type WHEN 2 THEN 'x' ELSE '' END AS app,
  list_extract([5, 6, 11, 12, 15, 16, 99], CAST(event_id % 7 + 1 AS BIGINT)) AS activity_type,
  CASE WHEN event_id % 3 = 0 THEN 0 ELSE epoch_us(ts) // 1000000 END AS start_time,
  CASE WHEN event_id % 6 = 0 THEN 0 ELSE epoch_us(ts) // 1000000 + 5 END AS last_modified_time,
  CASE event_id % 5 WHEN 0 THEN props WHEN 1 THEN '{"displayText":" ' || event_type || ' ' || event_id || ' "}'
    WHEN 2 THEN '{"payload":{"description":"in ' || event_type || '"}}'
    WHEN 3 THEN '{"userTimeline":"{' || chr(92) || '"contentUri' || chr(92) || '":' || chr(92) || '"' || event_type || chr(92) || '"}"}' END AS payload,
  CASE event_id % 5 WHEN 1 THEN event_type || ' ' || event_id WHEN 2 THEN 'in ' || event_type WHEN 3 THEN event_type ELSE '' END AS shown
FROM events"""

ORACLE["activity_text"] = f"SELECT app_id, payload, app, shown FROM ({_ACTIVITY})"


def guid_sql(c: str) -> str:
    return f"(strlen({c}) = 36 AND length({c}) - length(replace({c}, '-', '')) = 4)"


def template_noise(c: str) -> str:
    tests = [guid_sql(c), f"contains({c}, '://')", f"{c} IN {in_list(L.CHANNEL_WORDS + L.FIELD_LABELS)}"]
    tests += [f"starts_with({c}, {q(p)})" for p in L.PROVIDER_PREFIXES]
    tests += [f"contains({c}, {q(p)})" for p in L.PROVIDER_FRAGMENTS]
    return "(" + " OR ".join(tests) + ")"


def noise(c: str) -> str:
    return (f"(strlen({c}) <= 2 OR starts_with({c}, '{{') OR contains({c}, chr(10)) OR contains({c}, chr(13)) OR "
            f"starts_with({c}, '#') OR regexp_full_match({c}, '[0-9-]*') OR starts_with({c}, 'Microsoft ') OR {template_noise(c)})")


_LABELS = [*L.FIELD_LABELS, *L.CHANNEL_WORDS, "Microsoft-X", "a-b-c", "0f8fad5b-d9cb-469f-a165-70867728950e", "{x}",
           "http://x", "12-34", "Logoff user"]
ORACLE["noise_strings"] = f"""
WITH w AS (SELECT word, count(*) AS n FROM (SELECT unnest(regexp_split_to_array(text, '[ \\n]')) AS word FROM documents) GROUP BY word
           UNION ALL
           SELECT word, count(*) AS n FROM (SELECT {pick([q(w) for w in _LABELS], f'event_id % {len(_LABELS)}')} AS word FROM events) GROUP BY word)
SELECT word, n, {noise('word')} AS noise, {guid_sql('word')} AS guid FROM w"""

ORACLE["browser_names"] = """
SELECT page_id, CASE WHEN page_id % 4 = 0 OR page_id % 3 = 1 THEN 'Firefox' WHEN page_id % 4 = 1 THEN 'Edge' ELSE 'Chrome' END AS browser
FROM pages"""

# ---- file system ------------------------------------------------------------------------

_MFT = f"""
SELECT o_orderkey AS entry, lower(o_orderstatus) || '-' || o_orderkey AS name, o_orderkey // 4 AS parent, o_orderstatus,
       'host0' AS host_id, 'img0' AS image_id, {ft_ns(ft('o_orderdate'))} AS d, {DAY_TICKS * 100} AS day FROM orders"""

_TIMES = f"""
WITH r AS ({_MFT}), t AS (
  SELECT *, false AS is_fn, unnest([{{'f': 'B', 'ns': d}}, {{'f': 'M', 'ns': d + entry % 3 * day}}, {{'f': 'C', 'ns': d + entry % 2 * day}},
         {{'f': 'A', 'ns': CASE WHEN entry % 7 = 0 THEN 0 ELSE d END}}]) AS u FROM r
  UNION ALL
  SELECT *, true AS is_fn, unnest([{{'f': 'B', 'ns': d + (entry % 5 - 2) * day}}, {{'f': 'M', 'ns': d}}, {{'f': 'C', 'ns': d}},
         {{'f': 'A', 'ns': d}}]) AS u FROM r WHERE entry % 11 <> 0)
SELECT host_id, image_id, entry, name, o_orderstatus, is_fn, u.ns AS ns,
       CASE WHEN bool_or(u.f = 'M') THEN 'M' ELSE '.' END || CASE WHEN bool_or(u.f = 'A') THEN 'A' ELSE '.' END ||
       CASE WHEN bool_or(u.f = 'C') THEN 'C' ELSE '.' END || CASE WHEN bool_or(u.f = 'B') THEN 'B' ELSE '.' END AS macb
FROM t WHERE u.ns > 0 GROUP BY ALL"""

ORACLE["macb_group"] = f"SELECT entry, ns, macb FROM ({_TIMES}) WHERE NOT is_fn"

_PATHS = f"""
(WITH RECURSIVE p AS (
  SELECT o_orderkey AS entry, {BS} AS file_path, '' AS stem FROM orders WHERE o_orderkey = 0
  UNION ALL
  SELECT c.o_orderkey, p.stem || {BS} || lower(c.o_orderstatus) || '-' || c.o_orderkey,
         p.stem || {BS} || lower(c.o_orderstatus) || '-' || c.o_orderkey
  FROM orders c JOIN p ON c.o_orderkey // 4 = p.entry AND c.o_orderkey <> 0)
SELECT 'img0' AS image_id, entry, file_path FROM p)"""

ORACLE["mft_paths"] = f"SELECT image_id, entry, file_path FROM {_PATHS}"


def mft_events_sql(rows: str, file_path: str, more: str = "") -> str:
    return events(rows, kind="MFT", source="$MFT", artifact="CASE WHEN is_fn THEN '$FILE_NAME' ELSE '$STANDARD_INFORMATION' END",
                  macb="macb", message="name", file_path=file_path, is_fn="is_fn", more=more)


ORACLE["mft_events"] = mft_events_sql(
    f"SELECT t.*, p.file_path FROM ({_TIMES}) t LEFT JOIN {_PATHS} p ON p.entry = t.entry", "file_path")

_REASON = ("CASE l_linenumber WHEN 1 THEN 256 WHEN 2 THEN 2147484160 WHEN 3 THEN 3 WHEN 4 THEN 16 WHEN 5 THEN 12292 ELSE 34816 END")
_USN = f"""
SELECT 'host0' AS host_id, 'img0' AS image_id, CASE WHEN l_linenumber = 7 THEN -1 ELSE l_orderkey END AS parent_entry,
       epoch_us(l_shipdate) * 1000 AS ns, {_REASON} AS reason, CASE WHEN l_returnflag = 'R' THEN 'Directory' ELSE 'File' END AS kind,
       CASE WHEN l_linenumber <> 6 THEN 'f' || l_partkey || '.dat' ELSE '<unknown>' END AS name, l_linestatus = 'O' AS recovered,
       l_linenumber, l_returnflag, l_partkey, l_orderkey FROM lineitem"""


def usn_events_sql(rows: str, file_path: str = "name", recovered: str = "recovered", host: str = "host_id") -> str:
    text = f"CASE WHEN {recovered} THEN {reasons('reason', True)} ELSE {reasons('reason')} END"
    return events(rows, kind="USNJRNL", source="$UsnJrnl:$J", host=host,
                  artifact=f"CASE WHEN {recovered} THEN '$J (Recovered)' ELSE '$UsnJrnl' END",
                  message=f"kind || ' ' || name || ' - ' || {text}", file_path=file_path)


ORACLE["usn_with_paths"] = usn_events_sql(
    f"SELECT u.*, p.file_path AS dir FROM ({_USN}) u LEFT JOIN {_PATHS} p ON p.entry = u.parent_entry",
    file_path=f"CASE WHEN dir IS NULL THEN name ELSE dir || {BS} || name END")

ORACLE["usn_scan"] = f"""
SELECT 'img0' AS image_id, l_orderkey AS parent_entry, {ft('l_shipdate')} AS filetime, CAST({_REASON} AS BIGINT) AS reason,
       CAST(CASE WHEN l_returnflag = 'R' THEN 16 ELSE 32 END AS BIGINT) AS file_attrs, 'f' || l_partkey || '.dat' AS file_name,
       false AS recovered FROM lineitem WHERE l_linenumber <> 3"""
ORACLE["usn_carve"] = usn_events_sql(
    f"SELECT * REPLACE ('f' || l_partkey || '.dat' AS name, 'host0' AS host_id) FROM ({_USN}) WHERE l_linenumber <> 3",
    recovered="true")
ORACLE["journal_pages"] = ORACLE["usn_scan"]
ORACLE["stream_journal"] = usn_events_sql(
    f"SELECT * REPLACE ('f' || l_partkey || '.dat' AS name, 'host0' AS host_id) FROM ({_USN}) WHERE l_linenumber <> 3",
    recovered="false")

ORACLE["mft_decode"] = f"""
WITH r AS (SELECT *, {ft('o_orderdate')} AS f, o_orderkey AS k, o_orderkey % 13 <> 0 AS named FROM orders WHERE o_orderstatus <> 'P')
SELECT 'img0' AS image_id, k AS entry, CASE WHEN named THEN lower(o_orderstatus) || '-' || k ELSE 'entry#' || k END AS name,
       CASE WHEN named THEN k // 4 ELSE 5 END AS parent, f AS si_created, CASE WHEN k % 7 = 0 THEN 0 ELSE f END AS si_accessed,
       CASE WHEN named THEN CASE WHEN k % 11 = 0 THEN 0 ELSE f + (k % 5 - 2) * {DAY_TICKS} END END AS fn_created,
       CASE WHEN named THEN CASE WHEN k % 11 = 0 THEN 0 ELSE f END END AS fn_modified FROM r"""

_LOG = f"""
WITH r AS (SELECT *, list_extract([2, 3, 12, 14, 18, 19, 33], l_linenumber) AS op, {ft('l_shipdate')} AS f,
             l_suppkey % 2 = 0 OR l_linenumber > 2 AS has_fn FROM lineitem WHERE l_partkey % 9 <> 0),
 t AS (SELECT *, unnest(CASE WHEN has_fn THEN [{{'m': 'M', 'f': 0}}, {{'m': 'A', 'f': f}}, {{'m': 'C', 'f': f + 10}}, {{'m': 'B', 'f': f}}]
                          ELSE [{{'m': 'M', 'f': f + 5}}, {{'m': 'A', 'f': f}}, {{'m': 'C', 'f': 0}}, {{'m': 'B', 'f': f}}] END) AS u
         FROM r WHERE op IN (2, 12, 14, 18, 19) AND (op = 2 OR has_fn))
SELECT 'host0' AS host_id, 'img0' AS image_id, {ft_ns('u.f')} AS ns, u.m AS macb, has_fn,
       '$LogFile ' || CASE op WHEN 2 THEN 'MFT Record' WHEN 12 THEN 'AddIdx-Root' WHEN 14 THEN 'AddIdx-Alloc'
                       WHEN 18 THEN 'UpdateFN-Root' ELSE 'UpdateFN-Alloc' END AS artifact,
       CASE WHEN op = 2 AND l_returnflag = 'R' THEN '[DIR] ' ELSE '' END || 'n' || l_partkey AS message FROM t WHERE u.f > 0"""
ORACLE["logfile_events"] = events(_LOG, kind="LOGFILE", source="LOGFILE", artifact="artifact", macb="macb", message="message", is_fn="has_fn")

_STOMP = f"""
SELECT 'host0' AS host_id, 'img0' AS image_id, entry, name, d AS si_created_ns,
       CASE WHEN entry % 11 <> 0 THEN d + (entry % 5 - 2) * day ELSE 0 END AS fn_created_ns, d + entry % 3 * day AS si_modified_ns,
       CASE WHEN entry % 11 <> 0 THEN d ELSE 0 END AS fn_modified_ns FROM ({_MFT})"""
ORACLE["timestomp"] = f"""
SELECT *, si_created_ns < fn_created_ns AS born_before_fn, si_modified_ns < fn_modified_ns AS written_before_fn
FROM ({_STOMP}) WHERE si_created_ns < fn_created_ns OR si_modified_ns < fn_modified_ns"""
ORACLE["timestomp_events"] = f"""
SELECT host_id, image_id, entry, CAST(NULL AS VARCHAR) AS file_path, si_created_ns, fn_created_ns FROM ({_STOMP})
WHERE fn_created_ns > 0 AND si_created_ns < fn_created_ns"""

# ---- event log --------------------------------------------------------------------------

_EVTX = f"""
SELECT *, 'host' || user_id AS host_id, 'img' || user_id AS image_id, epoch_us(ts) * 1000 AS ns,
  list_extract([{', '.join(map(str, EVENT_IDS))}], CAST(event_id % {len(EVENT_IDS)} + 1 AS BIGINT)) AS eid, CAST(event_id % 5 AS INTEGER) AS level,
  CASE WHEN event_id % 4 = 0 THEN 'Security' ELSE 'Microsoft-Windows-' || event_type || '/Operational' END AS channel,
  CASE event_id % 3 WHEN 0 THEN '' WHEN 2 THEN 'PC-' || user_id END AS computer,
  [event_type, props, 'user' || user_id, CASE WHEN event_id % 2 = 0 THEN 'C:' || {BS} || 'jobs' || {BS} || event_type || '.ps1'
     ELSE 'value is ' || CAST(value AS VARCHAR) END, 'SYSTEM', 'WS-' || upper(event_type) || user_id, 'Level',
   'a much longer line about ' || event_type || ' number ' || event_id] AS strings,
  [event_id % 13, 3] AS u32s FROM events"""

_GENERIC = (f"NULLIF(array_to_string(list_transform(list_filter(strings, lambda s: s <> '' AND NOT {noise('s')})[1:3], "
            f"lambda s: {cut('s', 80)}), ' | '), '')")
_SKIP = in_list(sorted({w.lower() for w in L.NOT_ACCOUNTS}))
_NAMES = (f"list_filter(strings, lambda s: NOT (s = '' OR lower(s) IN {_SKIP} OR starts_with(s, 'S-1-') OR starts_with(s, '%%') "
          f"OR starts_with(s, 'Microsoft') OR contains(s, 'Auditing') OR contains(s, '://') OR contains(s, {BS}) OR trim(s) <> s "
          f"OR regexp_full_match(s, '[0-9]+') OR regexp_matches(s, '^[0-9].*[.].*[.]')))")
_CODE = "list_extract(list_filter(u32s, lambda v: v BETWEEN 2 AND 11), 1)"


def logon(typed: str) -> str:
    code = f"CASE WHEN {typed} THEN 'Type ' || {_CODE} || ' (' || {case_of(_CODE, L.LOGON_TYPES, chr(39) + 'Unknown' + chr(39))} || ')' END"
    account, target = f"list_extract({_NAMES}, 1)", f"list_extract({_NAMES}, 2)"
    return f"NULLIF({parts(' | ', code, f'{q('Account: ')} || {account}', f'CASE WHEN {target} <> {account} THEN {q('Target: ')} || {target} END')}, '')"


_SCRIPTS = "list_filter(strings, lambda s: length(s) >= 10 AND regexp_matches(lower(s), '[.]ps1\"?$'))"
_PROSE = f"list_filter(strings, lambda s: length(s) >= 20 AND NOT regexp_matches(lower(s), '[.]ps1\"?$') AND NOT {template_noise('s')})"
_LONGEST = f"list_extract(list_filter({_PROSE}, lambda s: length(s) = list_max(list_transform({_PROSE}, lambda t: length(t)))), 1)"
_SCRIPT = (f"CASE WHEN len({_SCRIPTS}) > 0 THEN 'Script: ' || {cut(f'list_extract({_SCRIPTS}, 1)', 200)} ELSE {cut(_LONGEST, 160)} END")

ORACLE["logon_snippet"] = f"SELECT event_id AS record_number, {logon('true')} AS typed, {logon('false')} AS untyped FROM ({_EVTX})"
ORACLE["script_snippet"] = f"SELECT event_id AS record_number, {_SCRIPT} AS script, {_GENERIC} AS generic FROM ({_EVTX})"
# Of the derived strings only the WS-<TYPE><user> one is upper case, hyphenated and long enough.
_HOST = "'WS-' || upper(event_type) || user_id"
ORACLE["evtx_hosts"] = f"SELECT event_id AS record_number, {_HOST} AS host FROM ({_EVTX})"

_NAME_ROWS = ", ".join(f"({k}, {q(v)})" for k, v in L.EVENT_NAMES.items())


def evtx_events_sql(where_host: str, strings: str | None = None) -> str:
    rows = f"SELECT * REPLACE ({strings} AS strings) FROM ({_EVTX})" if strings else _EVTX
    snippet = (f"coalesce(CASE WHEN eid IN (4103, 4104) THEN {_SCRIPT} WHEN eid IN (4624, 4625, 4648) THEN {logon('true')} "
               f"WHEN eid IN (4634, 4647, 4672, 4776) THEN {logon('false')} END, {_GENERIC})")
    joined = f"SELECT r.*, n.name, {snippet} AS snippet FROM ({rows}) r LEFT JOIN (VALUES {_NAME_ROWS}) n(id, name) ON n.id = r.eid"
    message = (f"'EventID ' || eid || {case_of('level', L.LEVEL_TAGS, chr(39) * 2)} || coalesce(' - ' || name, '') || "
               f"' [' || channel || ']' || coalesce(' - ' || snippet, '')")
    return events(joined, kind="EVTX", source="EVTX", artifact="'Windows Event Log'", message=message,
                  hostname=f"coalesce(NULLIF(computer, ''), {where_host})")


ORACLE["evtx_message"] = evtx_events_sql(_HOST)

# ---- execution --------------------------------------------------------------------------

_PREFETCH = f"""
WITH r AS (SELECT *, o_orderkey AS k, 'APP' || o_custkey || '.EXE' AS exe, {ft('o_orderdate')} AS f FROM orders WHERE o_orderkey % 17 <> 0),
 t AS (SELECT *, unnest([f, f + 70, 5]) AS run FROM r)
SELECT 'host0' AS host_id, 'img0' AS image_id, exe, k, {ft_ns('run')} AS ns,
       CASE k % 3 WHEN 0 THEN {BS} || 'bin' || {BS} || 'app' || o_custkey || '.exe' WHEN 1 THEN {BS} || 'x' || k ELSE exe END AS path FROM t"""
ORACLE["prefetch_events"] = events(_PREFETCH, kind="PREFETCH", source="PREFETCH", artifact="'Prefetch'", file_path="path",
                                   message="exe || ' - Executed (run count: ' || k || ')'")

_LNK = f"""
WITH r AS (SELECT *, o_orderkey AS k, {ft('o_orderdate')} AS f, CASE WHEN o_orderkey % 5 = 0 THEN '' ELSE 'C:' || {BS} || 'd' || {BS} || o_orderkey || '.txt' END AS target FROM orders),
 t AS (SELECT *, unnest([{{'m': 'B', 'v': 'born', 'f': f}}, {{'m': 'A', 'v': 'last accessed', 'f': CASE WHEN o_orderstatus = 'F' THEN 0 ELSE f + 1 END}},
        {{'m': 'M', 'v': 'last modified', 'f': CASE WHEN o_orderstatus = 'P' THEN 9 ELSE f + 2 END}}]) AS u FROM r)
SELECT 'host0' AS host_id, 'img0' AS image_id, {ft_ns('u.f')} AS ns, u.m AS macb, target,
   'LNK target ' || u.v || ': ' || CASE WHEN target = '' THEN '(unknown target)' ELSE target END || CASE WHEN k % 4 = 0 THEN ' ' || o_orderpriority ELSE '' END ||
   CASE WHEN k % 2 = 0 AND k <> 0 THEN ' [' || {case_of('(k % 8)', L.DRIVE_TYPES, "'Unknown'")} || ' ' || lpad(upper(to_hex(k * 65537)), CAST(greatest(8, length(to_hex(k * 65537))) AS INTEGER), '0')
        || CASE WHEN k % 3 = 0 THEN '; vol:DATA' ELSE '' END || ']' ELSE '' END || CASE WHEN k % 7 = 0 THEN '; tracked:ws01' ELSE '' END AS message
FROM t WHERE {ft_ns('u.f')} > 0"""
ORACLE["lnk_events"] = events(_LNK, kind="LNK", source="LNK", artifact="'LNK'", macb="macb", message="message", file_path="target")

ORACLE["jumplist_events"] = events(
    f"SELECT 'host0' AS host_id, 'img0' AS image_id, epoch_us(o_orderdate) * 1000 AS ns, 'D:' || {BS} || o_orderpriority AS target "
    "FROM orders WHERE o_orderkey % 6 <> 0 AND o_orderstatus <> 'P'",
    kind="JUMPLIST", source="JUMPLIST", artifact="'JumpList'", macb="'A'", message="'JumpList accessed: ' || target", file_path="target")

ORACLE["pca_launch"] = events(
    f"SELECT *, 'C:' || {BS} || 'café' || {BS} || o_orderkey || '.exe' AS exe, epoch_us(o_orderdate) * 1000 + 3723000000000 + "
    "CAST(rpad(CAST(o_orderkey % 1000 AS VARCHAR), 9, '0') AS BIGINT) AS ns FROM orders",
    kind="PCASVC", source="PCASVC", artifact="'PcaAppLaunchDic'", message="'Executed (GUI): ' || exe", file_path="exe", host="NULL", image="NULL")

_PCA = f"""
WITH l AS (SELECT doc_id, string_split(text, chr(10)) AS lines FROM documents),
 r AS (SELECT doc_id, unnest(lines) AS x, unnest(range(len(lines))) AS i FROM l)
SELECT trim(translate(x, '|', '/')) AS path, i, CAST(i % 7 AS INTEGER) AS status,
       1704067200000000000 + (i % 28) * 86400000000000 + (i % 60) * 1000000000 AS ns FROM r"""
ORACLE["pca_general"] = events(
    _PCA, kind="PCASVC", source="PCASVC", artifact="'PcaGeneralDb'", file_path="path", host="NULL", image="NULL",
    message="'PCA: ' || " + parts(" | ", f"'Status: ' || {case_of('status', L.PCA_STATUSES, chr(39) + 'status=' + chr(39) + ' || status')}",
                                  pre("Path: ", "path"), "CASE WHEN i % 2 = 0 THEN 'By: Co' || i END", "'v1.0'",
                                  "CASE WHEN i % 3 = 0 THEN 'exit' END"))


def amcache(rows: str, artifact: str, message: str, file_path: str) -> str:
    base = (f"SELECT 'host0' AS host_id, 'img0' AS image_id, *, o_orderkey AS k, 'key' || o_orderkey AS key, epoch_us(o_orderdate) * 1000 AS ns "
            f"FROM orders WHERE o_orderkey % 8 <> 7")
    return events(f"SELECT *, {rows} FROM ({base})", kind="AMCACHE", source="AMCACHE", artifact=q(f"Amcache.hve {artifact}"),
                  message=message, file_path=file_path)


ORACLE["amcache_files"] = amcache(
    f"CASE k % 3 WHEN 0 THEN 'c:' || {BS} || k WHEN 1 THEN 'D:' || {BS} || k ELSE CASE WHEN k % 2 = 0 THEN o_orderpriority ELSE key END END AS path",
    "InventoryApplicationFile", "path || CASE k % 4 WHEN 0 THEN ' SHA1=ab' || k WHEN 1 THEN ' SHA1=cd' || k ELSE '' END", "path")
ORACLE["amcache_drivers"] = amcache(
    "CASE WHEN k % 2 = 0 THEN 'drv' || k || '.sys' WHEN k % 3 = 0 THEN o_orderpriority ELSE key END AS path", "InventoryDriverBinary",
    "path || CASE WHEN k % 5 = 0 THEN ' | inf=oem.inf' ELSE '' END || CASE WHEN k % 4 = 0 THEN ' | csum=c' || o_custkey ELSE '' END || ' | type=' || o_orderstatus",
    "path")
ORACLE["amcache_apps"] = amcache(
    "CASE WHEN k % 6 <> 0 THEN o_orderpriority ELSE key END AS app", "InventoryApplication",
    "app || CASE WHEN k % 2 = 0 THEN ' | pub=pub' || o_custkey ELSE '' END || CASE WHEN k % 3 = 0 THEN ' | ver=1.0' ELSE '' END || "
    "CASE WHEN k % 5 = 0 THEN ' | installed=' || CAST(CAST(o_orderdate AS DATE) AS VARCHAR) ELSE '' END", "NULL")

_LEGACY = f"""
WITH r AS (SELECT 'host0' AS host_id, 'img0' AS image_id, *, 'hive' || o_custkey % 70 AS hive, o_orderkey AS k FROM orders),
 modern AS (SELECT DISTINCT 'hive' || o_custkey % 50 AS hive FROM r WHERE k % 8 <> 7)
SELECT *, CASE WHEN k % 2 = 0 THEN 'old' || k ELSE 'key' || k END AS path, epoch_us(o_orderdate) * 1000 + CASE WHEN k % 5 = 0 THEN 1100 ELSE 0 END AS ns
FROM r WHERE hive NOT IN (SELECT hive FROM modern) AND (k % 5 = 0 OR k % 8 <> 7)"""
ORACLE["amcache_legacy"] = events(_LEGACY, kind="AMCACHE", source="AMCACHE", artifact="'Amcache.hve Legacy'", file_path="path",
                                  message="path || CASE WHEN k % 3 = 0 THEN ' SHA1=' || o_custkey ELSE '' END")

# ---- text files -------------------------------------------------------------------------

_WER = """
SELECT doc_id, 'WER/App_' || doc_id || '/Report.wer' AS path, doc_id * 1000000000 AS ns, lang,
       CASE WHEN doc_id % 4 = 0 THEN 'late' ELSE 'app' || doc_id || '=x' END AS app,
       CASE WHEN doc_id % 3 = 0 THEN CAST(n_chars AS VARCHAR) ELSE '' END AS ver FROM documents WHERE doc_id % 10 <> 0"""
ORACLE["wer_reports"] = events(_WER, kind="WER", source="WER", artifact="'WER Crash Report'", file_path="path", host="NULL", image="NULL",
                               message="'Crash: ' || app || ' | type=' || lang || CASE WHEN ver <> '' THEN ' | ver=' || ver ELSE '' END")

_TASKS = f"""
WITH r AS (SELECT *, o_orderkey AS k, {BS} || o_orderstatus || {BS} || 't' || o_orderkey AS task, strftime(o_orderdate, '%Y-%m-%d') AS d,
             CASE WHEN o_orderkey % 4 <> 0 THEN epoch_us(o_orderdate) * 1000 + 37800123456700 ELSE 0 END AS date_ns,
             CASE WHEN o_orderkey % 5 <> 0 THEN epoch_us(o_orderdate) * 1000 + 39600000000000 ELSE 0 END AS start_ns,
             CASE WHEN o_orderkey % 7 = 0 THEN '(no action)' ELSE 'c' || o_custkey || '.exe' || CASE WHEN o_orderkey % 2 = 0 THEN ' -x 1' ELSE '' END END AS action
           FROM orders WHERE o_orderkey % 29 <> 0),
 t AS (SELECT *, CASE WHEN start_ns > 0 THEN 'Trigger: calendar @ ' || d || 'T11:00' ELSE '' END AS trg FROM r)
SELECT task, CASE WHEN date_ns > 0 THEN date_ns ELSE start_ns END AS ns, 'Scheduled Task' AS artifact,
       'Task: ' || task || ' | Action: ' || action || CASE WHEN trg <> '' THEN ' | ' || trg ELSE '' END ||
       CASE WHEN k % 3 = 0 THEN ' | Author: A & ' || o_custkey ELSE '' END AS message FROM t WHERE date_ns > 0 OR start_ns > 0
UNION ALL
SELECT task, start_ns, 'Scheduled Task Trigger', 'Task Trigger: ' || task || ' | Action: ' || action || ' | ' || trg FROM t WHERE date_ns > 0 AND start_ns > 0"""
ORACLE["task_events"] = events(_TASKS, kind="TASK", source="TASK", artifact="artifact", message="message", file_path="task", host="NULL", image="NULL")

_HISTORY = """
WITH l AS (SELECT doc_id, string_split(text, chr(10)) AS lines FROM documents),
 r AS (SELECT doc_id, trim(unnest(lines)) AS x, unnest(range(len(lines))) AS i FROM l)
SELECT 'hist/' || doc_id AS path, (doc_id + 1700000000) * 1000000000 AS ns, x FROM r WHERE i % 5 <> 4 AND x <> '' AND NOT starts_with(x, '#')"""
ORACLE["pshistory_lines"] = events(_HISTORY, kind="PSHISTORY", source="PSHISTORY", artifact="'PowerShell History'", message="x",
                                   file_path="path", host="NULL", image="NULL")

_RECYCLE = f"""
SELECT 'C:' || {BS} || 'del' || {BS} || o_orderpriority || o_orderkey AS path, CAST(trunc(o_totalprice * 5000) AS BIGINT) AS size, epoch_us(o_orderdate) * 1000 AS ns
FROM orders WHERE o_orderkey % 13 <> 0 AND o_orderkey % 10 <> 9 AND o_orderkey % 4 <> 3"""
ORACLE["recycle_events"] = events(_RECYCLE, kind="RECYCLEBIN", source="RECYCLEBIN", artifact="'Recycle Bin'", file_path="path",
                                  message=f"'Deleted: ' || path || ' (' || {size_sql('size')} || ')'", host="NULL", image="NULL")

# ---- registry ---------------------------------------------------------------------------

_KEYS = f"""
WITH RECURSIVE p AS (
  SELECT o_orderkey AS k, 'HKLM' || {BS} || 'SOFTWARE' AS path FROM orders WHERE o_orderkey = 0
  UNION ALL SELECT c.o_orderkey, p.path || {BS} || 'k' || c.o_orderkey FROM orders c JOIN p ON c.o_orderkey // 8 = p.k AND c.o_orderkey <> 0),
 r AS (SELECT o.*, p.path, o_orderkey % 9 AS n FROM orders o JOIN p ON p.k = o.o_orderkey WHERE o_orderkey % 9 <> 8),
 v AS (SELECT *, list_transform(range(n), lambda i: CASE WHEN i = 0 THEN '(default)' ELSE 'v' || i END || '=' ||
              CASE WHEN i % 2 = 0 THEN o_orderpriority ELSE CAST(o_custkey AS VARCHAR) END) AS vals FROM r)
SELECT 'host0' AS host_id, 'img0' AS image_id, epoch_us(o_orderdate) * 1000 AS ns,
       path || CASE WHEN n > 0 THEN ' | ' || array_to_string(vals[1:6], ', ') || CASE WHEN n > 6 THEN ', +' || (n - 6) || ' more' ELSE '' END ELSE '' END AS message FROM v"""
ORACLE["registry_extra"] = f"""
SELECT path AS full_path, CAST(i AS INTEGER) AS place, CASE WHEN i = 0 THEN '(default)' ELSE 'v' || i END AS value_name,
       CASE WHEN i % 2 = 0 THEN o_orderpriority ELSE CAST(o_custkey AS VARCHAR) END AS value_text
FROM (SELECT r.*, unnest(range(n)) AS i FROM ({_KEYS.replace("SELECT 'host0' AS host_id", "SELECT path, n, o_orderpriority, o_custkey, 'host0' AS host_id")}) r)"""
ORACLE["registry_events"] = events(_KEYS, kind="REGISTRY", source="REGISTRY", artifact="'Registry Key'", message="message")

_RULED = f"""
WITH r AS (SELECT *, o_orderkey AS k, CAST(o_orderkey % {len(RULE_PATHS)} AS INTEGER) AS rule, o_orderkey % 6 = 5 AS bare,
             {pick([q(p) for p in RULE_PATHS], f'o_orderkey % {len(RULE_PATHS)}')} AS base, left(base, 4) || @key || substr(base, 5) AS path,
             'C:' || {BS} || 'docs' || {BS} || 'a' || o_orderkey || '.docx' AS doc FROM orders),
 v AS (SELECT *, '[F00]' || doc AS item, 'Item 1=[F00]' || doc || '; (default)=deadbeef' || lpad(CAST(o_custkey AS VARCHAR), 8, '0') || '; MRUListEx=C:' || {BS} || 'skip' || {BS} || 'me' AS listed FROM r)
SELECT 'host0' AS host_id, 'img0' AS image_id, epoch_us(o_orderdate) * 1000 AS ns, k, path,
  CASE WHEN rule < 3 THEN 'Persistence' WHEN rule = 3 THEN 'Execution' WHEN rule = 4 THEN 'BAM' WHEN rule = 5 THEN 'ShimCache'
       WHEN rule < 11 THEN 'MRU' WHEN rule = 11 THEN 'ShellBag' ELSE 'Registry Key' END AS artifact,
  CASE rule WHEN 0 THEN CASE WHEN bare THEN 'AutoRun: ' || path ELSE 'AutoRun | ' || listed || ' | ' || path END
    WHEN 1 THEN CASE WHEN bare THEN 'AutoRunOnce: ' || path ELSE 'AutoRunOnce | ' || listed || ' | ' || path END
    WHEN 2 THEN CASE WHEN bare THEN 'AutoRunServices: ' || path ELSE 'AutoRunServices | ' || listed || ' | ' || path END
    WHEN 3 THEN CASE WHEN bare THEN 'UserAssist Count: ' || path ELSE 'UserAssist: Vgrz 1; ZEHYvfgRk' END
    WHEN 4 THEN CASE WHEN bare THEN 'BAM UserSettings: ' || path ELSE 'BAM last run: a' || k || '.docx; me' END
    WHEN 5 THEN 'ShimCache: ' || path
    WHEN 6 THEN CASE WHEN bare THEN 'RecentDocs: ' || o_orderpriority || ' | ' || path ELSE 'RecentDocs: ' || item END
    WHEN 7 THEN 'OpenSave MRU: ' || o_orderpriority || ' | ' || path
    WHEN 8 THEN CASE WHEN bare THEN 'OpenSave MRU: ' || o_orderpriority || ' | ' || path ELSE 'OpenSave MRU: ' || item END
    WHEN 9 THEN CASE WHEN bare THEN 'LastVisited MRU: ' || o_orderpriority || ' | ' || path ELSE 'LastVisited MRU: ' || item END
    WHEN 10 THEN CASE WHEN bare THEN 'Office MRU: ' || path ELSE 'Office MRU: a' || k || '.docx' END
    WHEN 11 THEN 'ShellBag: ' || path
    ELSE path || CASE WHEN bare THEN '' ELSE ' | ' || replace(listed, '; ', ', ') END END AS message FROM v"""
ORACLE["registry_plugins"] = events(_RULED.replace("@key", "''"), kind="REGISTRY", source="REGISTRY", artifact="artifact", message="message")

_BAGS = f"""
WITH RECURSIVE p AS (
  SELECT o_orderkey AS k, '' AS path FROM orders WHERE o_orderkey = 0
  UNION ALL SELECT c.o_orderkey, p.path || CASE WHEN p.path = '' THEN '' ELSE {BS} END || 'd' || c.o_orderkey % 3
  FROM orders c JOIN p ON c.o_orderkey // 4 = p.k AND c.o_orderkey <> 0 AND c.o_orderkey % 23 <> 22)
SELECT DISTINCT 'host0' AS host_id, 'img0' AS image_id, epoch_us(o.o_orderdate) * 1000 AS ns, p.path
FROM p JOIN orders o ON o.o_orderkey = p.k WHERE p.k <> 0 AND p.k % 10 <> 9"""
ORACLE["shellbag_events"] = events(_BAGS, kind="SHELLBAG", source="SHELLBAG", artifact="'ShellBag'", message="'ShellBag: ' || path", file_path="path")

# ---- resource usage ---------------------------------------------------------------------

_OLE_NS = ("CAST(trunc(((CAST(epoch_us(l_shipdate) AS DOUBLE) / 86400000000.0::DOUBLE + 25569.0::DOUBLE) - 25569.0::DOUBLE) * 86400.0::DOUBLE * 1e9::DOUBLE) AS BIGINT)")
_USAGE = f"""
SELECT l.*, 'host0' AS host_id, 'img0' AS image_id, CASE WHEN l_linenumber = 1 THEN {_OLE_NS} WHEN l_linenumber > 3 THEN epoch_us(l_shipdate) * 1000 ELSE 0 END AS ns,
  CASE WHEN l_linenumber = 6 THEN 'Unknown' WHEN p_size % 3 = 0 THEN p_name || '.exe' WHEN p_size % 3 = 1 THEN p_name ELSE CAST(l_partkey AS VARCHAR) END AS app,
  CASE WHEN l_linenumber = 5 THEN '' WHEN s_suppkey % 7 = 6 OR s_suppkey IS NULL THEN CAST(l_suppkey + {SID_BASE} AS VARCHAR) ELSE {sid_name(f'({_SID})')} END AS usr
FROM lineitem l LEFT JOIN part ON p_partkey = l_partkey LEFT JOIN supplier ON s_suppkey = l_suppkey"""


def metric(name: str, expr: str, unit: str) -> str:
    return f"CASE WHEN ({expr}) <> 0 THEN '{name}=' || {group3(expr)} || '{unit}' END"


def usage_sql(artifact: str, *tail: str, ns: str = "ns") -> str:
    message = parts("  |  ", "'App: ' || app", pre("User: ", "usr"), *tail)
    rows = f"SELECT * REPLACE ({ns} AS ns) FROM ({_USAGE}) WHERE ({ns}) > 0"
    return events(rows, kind="SRUM", source="SRUM", artifact=q(artifact), message=message, file_path="app")


_METRICS = parts("  ", metric("fg_cycles", "l_partkey * 1000", ""), metric("bg_cycles", "CAST(l_quantity AS BIGINT)", ""),
                 metric("fg_read", "CAST(trunc(l_tax * 100) AS BIGINT)", "B"), metric("fg_write", "CAST(trunc(l_discount * 100) AS BIGINT)", "B"),
                 metric("bg_write", "l_suppkey * 12345", "B"))
ORACLE["srum_app"] = usage_sql("SRUM AppTimeline", f"NULLIF({_METRICS}, '')")
ORACLE["srum_net"] = usage_sql("SRUM Network", metric("sent", "CAST(trunc(l_extendedprice * 100) AS BIGINT)", "B"),
                               metric("recv", "CAST(trunc(l_discount * 100) AS BIGINT) * 4096", "B"))
_IFACE = pick(["'Ethernet'", "'PPP'", "'WiFi'", "'VPN'", "'iface=99'", "NULL", "'Ethernet'"], "l_linenumber - 1")
ORACLE["srum_conn"] = usage_sql(
    "SRUM NetworkConn", "CASE WHEN l_returnflag = 'A' THEN 'Network: net' || l_suppkey END", _IFACE,
    "CASE WHEN l_quantity <> 1 THEN 'duration=' || (CAST(l_quantity AS BIGINT) - 1) || 's' END",
    ns="CASE WHEN l_returnflag = 'R' THEN epoch_us(l_shipdate) * 1000 + 700 ELSE ns END")

# ---- browsing ---------------------------------------------------------------------------

_TITLE = "CASE WHEN page_id % 3 = 2 THEN ' - \"page ' || page_id || '\"' ELSE '' END"
_VISITS = """
SELECT 'host0' AS host_id, 'img0' AS image_id, epoch_us(ts) * 1000 AS ns, CASE WHEN user_id % 2 = 0 THEN 'Chrome' ELSE 'Edge' END AS browser, page_id, url
FROM events JOIN pages ON page_id = event_id % 300 WHERE event_id % 19 <> 0"""
ORACLE["visit_join"] = events(_VISITS, kind="BROWSER", source="BROWSER", artifact="'Browser Visit (' || browser || ')'", file_path="url",
                              message=f"'Browser Visit: ' || url || {_TITLE} || ' [' || browser || ']'")
ORACLE["firefox_visits"] = events(_VISITS, kind="BROWSER", source="BROWSER", artifact="'Browser Visit (Firefox)'", file_path="url",
                                  message=f"'Browser Visit: ' || url || {_TITLE} || ' [Firefox]'")

_DOWNLOADS = f"""
SELECT *, 'host0' AS host_id, 'img0' AS image_id, epoch_us(l_shipdate) * 1000 AS ns, 'f' || l_partkey || '.zip' AS name, 'http://s' || l_suppkey AS origin,
  CASE WHEN l_linenumber < 4 AND l_partkey > 0 THEN l_partkey * 1000 WHEN l_linenumber <> 5 THEN l_orderkey ELSE 0 END AS size FROM lineitem WHERE l_linenumber <> 7"""
ORACLE["chromium_downloads"] = events(
    _DOWNLOADS, kind="BROWSER", source="BROWSER", artifact="'Browser Download (Chrome)'",
    file_path=f"CASE WHEN l_linenumber <> 2 THEN 'C:' || {BS} || 'dl' || {BS} || name ELSE origin END",
    message="'Browser Download: ' || CASE WHEN l_linenumber <> 2 THEN name ELSE 'unknown' END || CASE WHEN l_linenumber <> 3 THEN ' from ' || origin ELSE '' END || "
            f"' [Chrome]' || CASE WHEN size > 0 THEN ' (' || {group3('size')} || ' bytes)' ELSE '' END")

_ANNOS = f"""
SELECT 'host0' AS host_id, 'img0' AS image_id, epoch_us(l_shipdate) * 1000 AS ns, url, l_orderkey,
  CASE WHEN l_orderkey % 5 = 0 THEN '' ELSE l_orderkey || '.bin' END AS name
FROM lineitem JOIN pages ON page_id = l_partkey % 300
WHERE l_returnflag <> 'N' AND (l_suppkey % 10, l_linenumber) IN (SELECT (n_nationkey % 10, n_nationkey % 7 + 1) FROM nation WHERE n_regionkey < 3)"""
ORACLE["anno_semi"] = events(
    _ANNOS, kind="BROWSER", source="BROWSER", artifact="'Browser Download (Firefox)'",
    file_path=f"CASE WHEN name = '' THEN url ELSE 'C:' || {BS} || 'dl' || {BS} || name END",
    message="'Browser Download: ' || CASE WHEN name = '' THEN 'unknown' ELSE name END || ' from ' || url || ' [Firefox]'")

_ACT_ROWS = f"""
SELECT *, CASE WHEN start_time > 0 THEN start_time ELSE last_modified_time END * 1000000000 AS ns FROM ({_ACTIVITY})
WHERE start_time > 0 OR last_modified_time > 0"""
ORACLE["activity_events"] = events(
    _ACT_ROWS, kind="WINTIMELINE", source="WINTIMELINE", artifact="'Windows Timeline'",
    file_path="CASE WHEN shown <> '' THEN shown ELSE db_id END",
    message=parts(" | ", f"'Timeline: ' || {case_of('activity_type', L.ACTIVITY_TYPES, chr(39) + 'Type' + chr(39) + ' || activity_type')}",
                  pre("app=", "app"), "NULLIF(left(shown, 120), '')"))

ORACLE["latest_n_visits"] = """
SELECT user_id, event_id, event_type FROM events
QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id) <= 20"""

# ---- timeline operators -----------------------------------------------------------------

_LIVE = f"({evtx_events_sql(_HOST)}) UNION ALL ({mft_events_sql(_TIMES, 'NULL')}) UNION ALL ({usn_events_sql(_USN)})"


def live(where: str = "true", columns: str = "*") -> str:
    return f"SELECT {columns} FROM ({_LIVE}) t WHERE {where}"


ORACLE["timeline_union_sort"] = live()
ORACLE["time_filter"] = live("timestamp_ns BETWEEN 852069600000000000 AND 1705320000000000000")
ORACLE["type_filter"] = live("artifact_type = 'USNJRNL'")
ORACLE["artifact_filter"] = live("artifact = '$FILE_NAME'")
ORACLE["grep_message"] = live("contains(message, 'DATA_EXTEND')")
ORACLE["recovered_only"] = live("artifact = '$J (Recovered)'")
ORACLE["parquet_round_trip"] = live()
ORACLE["merge_timeline"] = live()
ORACLE["table_round_trip"] = live()
ORACLE["records_round_trip"] = ORACLE["evtx_message"]
_ELEVEN = ("timestamp_ns, timestamp_iso, macb, source, artifact, hostname, file_path, message, message_short, is_fn_timestamp, tz_offset_secs")
ORACLE["jsonl_round_trip"] = live(columns=_ELEVEN)
ORACLE["convert_time_type"] = live("artifact_type = 'MFT' AND timestamp_ns >= 820454400000000000", _ELEVEN)
ORACLE["grep_indexed"] = ORACLE["grep_message"]
ORACLE["path_lookup"] = live("file_path = 'f77.dat'")
ORACLE["source_baseline"] = f"SELECT source, count(*) AS events FROM ({_LIVE}) GROUP BY source"
ORACLE["preview"] = f"""
SELECT timestamp_iso, macb, artifact, is_fn_timestamp, file_path, message FROM ({_LIVE})
ORDER BY timestamp_ns, source, artifact, file_path NULLS FIRST, macb, message, host_id LIMIT 50"""
ORACLE["analyst_query"] = f"""
SELECT timestamp_iso, source, artifact, message FROM ({_LIVE}) WHERE timestamp_iso > '1998' AND source = '$MFT'
ORDER BY timestamp_ns, message, artifact, macb LIMIT 1000"""
ORACLE["timesketch_view"] = f"""
SELECT timestamp_iso AS datetime, artifact || ' ' || coalesce(NULLIF({parts(', ', *[f"CASE WHEN contains(macb, '{k}') THEN '{v}' END" for k, v in L.MACB_LABELS.items()])}, ''), 'Timestamp') AS timestamp_desc,
       left(artifact, 6) AS source_short, artifact AS source_long, message, message_short, hostname, coalesce(file_path, '') AS filename FROM ({_LIVE})"""

ORACLE["timesketch_file"] = ORACLE["timesketch_view"]

# Strings are replaced by one word here, so only the record's own computer names a host.
_QUIET = evtx_events_sql("''", "['x']")
_BY_ATTR = usn_events_sql(f"SELECT * REPLACE ('host' || CASE WHEN l_returnflag = 'R' THEN 16 ELSE 32 END AS host_id) FROM ({_USN})")
ORACLE["fill_hostname"] = f"""
WITH t AS (({_QUIET}) UNION ALL ({_BY_ATTR})),
 h AS (SELECT host_id, arg_min(hostname, timestamp_ns) AS first_host FROM t WHERE artifact_type = 'EVTX' AND trim(hostname) <> '' GROUP BY host_id)
SELECT t.* REPLACE (CASE WHEN trim(hostname) <> '' THEN hostname ELSE coalesce(first_host, '') END AS hostname) FROM t LEFT JOIN h USING (host_id)"""

ORACLE["fill_file_path"] = f"""
SELECT CASE WHEN o_orderkey % 2 = 0 THEN o_orderkey * 65537 ELSE 0 END AS drive_serial, {ft('o_orderdate')} AS created,
  coalesce(CASE WHEN o_orderkey % 4 = 0 THEN o_orderpriority END, CASE WHEN o_orderkey % 5 <> 0 THEN 'C:' || {BS} || 'd' || {BS} || o_orderkey || '.txt' END,
           CASE WHEN o_orderkey % 7 = 0 THEN 'ws01' END, 'Users/x.lnk') AS file_path,
  CASE WHEN o_orderkey % 5 = 0 THEN '' ELSE 'C:' || {BS} || 'd' || {BS} || o_orderkey || '.txt' END AS target_path,
  CASE WHEN o_orderkey % 7 = 0 THEN 'ws01' ELSE '' END AS exe_name, 'Users/x.lnk' AS logical_path FROM orders"""

_PLACES = [
    ("MFT", "$MFT"), ("evtx/System.evtx", "Windows\\System32\\winevt\\Logs\\System.evtx"),
    ("userhives/bob/NTUSER.DAT", "Users\\bob\\NTUSER.DAT"),
    ("browser/amy/Chrome_Default_History", "Users\\amy\\AppData\\Local\\Chrome_Default_History"),
    ("wintimeline/amy/ActivitiesCache.db", "Users\\amy\\AppData\\Local\\ConnectedDevicesPlatform\\*\\ActivitiesCache.db"),
    ("pshistory/bob/ConsoleHost_history.txt",
     "Users\\bob\\AppData\\Roaming\\Microsoft\\Windows\\PowerShell\\PSReadLine\\ConsoleHost_history.txt"),
    ("wer/amy/R1/Report.wer", "amy\\R1\\Report.wer"), ("sru/SRUDB.dat", "Windows\\System32\\sru\\SRUDB.dat"),
    ("Tasks", "Tasks"), ("Prefetch", "Windows\\Prefetch")]
ORACLE["logical_paths"] = f"""
SELECT o_orderkey, {pick([q(a) for a, _ in _PLACES], 'o_orderkey % 10')} AS path,
       {pick([q(b) for _, b in _PLACES], 'o_orderkey % 10')} AS logical_path FROM orders"""

_KEY3 = "l_orderkey || '_' || l_partkey || '_' || l_suppkey"
_JOBS = f"""
WITH f AS (SELECT *, 'img' || l_suppkey % 3 AS image_id, CAST(l_quantity AS BIGINT) * 1000 + l_linenumber AS length FROM lineitem),
 j AS (
  SELECT image_id, 'EVTX' AS artifact_type, 'windows/SYSTEM32/winevt/Logs/' || {_KEY3} || '.EVTX' AS path, false AS is_directory, length FROM f WHERE l_linenumber = 1
  UNION ALL SELECT image_id, 'PREFETCH', 'Windows/Prefetch', true, length FROM f WHERE l_linenumber = 2
  UNION ALL SELECT image_id, unnest(['SHELLBAG', 'REGISTRY']), 'Users/u' || l_suppkey || '/NTUSER.DAT', false, length FROM f WHERE l_linenumber = 3
  UNION ALL SELECT image_id, 'BROWSER', 'Users/u' || l_suppkey || '/AppData/Local/Google/Chrome/User Data/P' || l_partkey || '/History', false, length FROM f WHERE l_linenumber = 4
  UNION ALL SELECT image_id, 'MFT', '$MFT', false, length FROM f WHERE l_linenumber = 5)
SELECT 'host0' AS host_id, image_id, artifact_type, path, is_directory, CAST(sum(length) AS BIGINT) AS size_bytes FROM j GROUP BY ALL"""
ORACLE["artifact_jobs"] = _JOBS
ORACLE["extracted_jobs"] = f"""
WITH f AS (SELECT *, 'img' || l_suppkey % 3 AS image_id, CAST(l_quantity AS BIGINT) AS length FROM lineitem),
 j AS (
  SELECT image_id, 'EVTX' AS artifact_type, 'evtx/' || {_KEY3} || '.evtx' AS path, false AS is_directory, length,
         'Windows' || {BS} || 'System32' || {BS} || 'winevt' || {BS} || 'Logs' || {BS} || {_KEY3} || '.evtx' AS logical_path FROM f WHERE l_linenumber = 1
  UNION ALL SELECT image_id, 'PREFETCH', 'Prefetch', true, length, 'Windows' || {BS} || 'Prefetch' FROM f WHERE l_linenumber = 2
  UNION ALL SELECT image_id, unnest(['SHELLBAG', 'REGISTRY']), 'userhives/u' || l_suppkey || '/NTUSER.DAT', false, length,
                   'Users' || {BS} || 'u' || l_suppkey || {BS} || 'NTUSER.DAT' FROM f WHERE l_linenumber = 3
  UNION ALL SELECT image_id, 'BROWSER', 'browser/u' || l_suppkey || '/Edge_' || l_partkey || '_History', false, length,
                   'Users' || {BS} || 'u' || l_suppkey || {BS} || 'AppData' || {BS} || 'Local' || {BS} || 'Edge_' || l_partkey || '_History' FROM f WHERE l_linenumber = 4
  UNION ALL SELECT image_id, 'MFT', 'MFT', false, length, '$MFT' FROM f WHERE l_linenumber = 5
  UNION ALL SELECT image_id, 'WER', 'wer_system/' || {_KEY3} || '/a/Report.wer', false, length, {_KEY3} || {BS} || 'a' || {BS} || 'Report.wer' FROM f WHERE l_linenumber = 6)
SELECT 'host0' AS host_id, image_id, artifact_type, path, is_directory, CAST(sum(length) AS BIGINT) AS size_bytes, logical_path FROM j GROUP BY ALL"""
ORACLE["artifact_summary"] = f"SELECT artifact_type, count(*) AS files, CAST(sum(size_bytes) AS BIGINT) AS size_bytes FROM ({_JOBS}) GROUP BY artifact_type"

ORACLE["event_counts"] = """
SELECT 'USNJRNL' AS artifact_type, count(*) FILTER (l_linenumber <> 6) AS events, count(*) FILTER (l_linenumber = 6) AS errors FROM lineitem
UNION ALL SELECT 'EVTX', count(*), 0 FROM events"""
ORACLE["errors_by_file"] = """
SELECT 'USNJRNL' AS artifact_type, 'usn/' || l_orderkey % 100 AS path, count(*) AS errors FROM lineitem WHERE l_linenumber = 6 GROUP BY ALL"""
ORACLE["run_summary"] = """
WITH u AS (SELECT 'usn/' || l_orderkey % 100 AS path, l_linenumber = 6 AS bad FROM lineitem),
 r AS (SELECT 'USNJRNL' AS artifact_type, count(DISTINCT path) AS files, count(DISTINCT path) FILTER (bad) AS failed,
              count(*) FILTER (NOT bad) AS events, count(*) FILTER (bad) AS errors FROM u
       UNION ALL SELECT 'EVTX', count(DISTINCT event_type), 0, count(*), 0 FROM events)
SELECT artifact_type, files, files - failed AS files_done, events, errors FROM r
UNION ALL SELECT 'TOTAL', CAST(sum(files) AS BIGINT), CAST(sum(files - failed) AS BIGINT), CAST(sum(events) AS BIGINT), CAST(sum(errors) AS BIGINT) FROM r"""
ORACLE["host_fill_all_sources"] = f"""
SELECT artifact_type, 'host1' AS host_id, 'img1' AS image_id, count(*) AS events, count(*) AS named
FROM (SELECT artifact_type FROM ({ORACLE["evtx_message"]}) UNION ALL SELECT artifact_type FROM ({ORACLE["pca_launch"]})
      UNION ALL SELECT artifact_type FROM ({ORACLE["usn_carve"]}) UNION ALL SELECT 'MFT' FROM ({_LIVE}) WHERE artifact_type = 'MFT')
GROUP BY artifact_type"""
ORACLE["distinct_events"] = f"""
SELECT timestamp_ns, file_path, min(message) AS message FROM ({usn_events_sql(_USN)}) GROUP BY timestamp_ns, file_path"""

# ---- snapshots --------------------------------------------------------------------------

_SNAP_ROWS = f"""
SELECT t.*, CASE WHEN t.entry % 50 = 49 THEN '{chr(92)}$Extend' || p.file_path ELSE p.file_path END AS path, s.id AS snapshot_id,
       NOT EXISTS (SELECT 1 FROM lineitem WHERE l_linestatus = 'O' AND l_orderkey = t.entry) AS dead
FROM ({_TIMES}) t JOIN {_PATHS} p ON p.entry = t.entry, (VALUES (1), (2)) s(id) WHERE s.id = 1 OR t.o_orderstatus = 'F'"""
_FILE_DELTA = events(
    f"SELECT * FROM ({_SNAP_ROWS}) WHERE dead AND entry % 50 <> 49", kind="SHADOWCOPY", source="SHADOWCOPY",
    artifact="'Deleted File (VSS)'", macb="macb", file_path="path", is_fn="is_fn", message="'[VSS#' || snapshot_id || '] Deleted: ' || path",
    short=f"'Deleted: ' || list_extract(string_split(file_path, {BS}), -1)", more="snapshot_id AS snapshot_id")
ORACLE["snapshot_file_delta"] = _FILE_DELTA

_KEY_ROWS = f"""
SELECT r.*, r.message AS text FROM ({_RULED.replace('@key', BS + ' || o_orderkey')}) r
WHERE NOT EXISTS (SELECT 1 FROM lineitem WHERE l_returnflag = 'R' AND l_orderkey = r.k)"""
_KEY_DELTA = events(
    _KEY_ROWS, kind="SHADOWCOPY", source="SHADOWCOPY", artifact="'Deleted Registry Key (VSS)'",
    message="'[VSS#3] Deleted key: ' || text", short=f"'Deleted key: ' || {base_sql('key')}", more="path AS key").replace(
    "tz_offset_secs, key FROM", "tz_offset_secs, CAST(3 AS INTEGER) AS snapshot_id FROM")
ORACLE["snapshot_key_delta"] = _KEY_DELTA
ORACLE["vss_counts"] = f"""
SELECT snapshot_id, count(*) AS events, count(*) FILTER (artifact = 'Deleted File (VSS)') AS files,
       count(*) FILTER (artifact <> 'Deleted File (VSS)') AS keys
FROM (SELECT artifact, snapshot_id FROM ({_FILE_DELTA}) UNION ALL SELECT artifact, snapshot_id FROM ({_KEY_DELTA})) GROUP BY snapshot_id"""

# ---- sinks and streams ------------------------------------------------------------------

ORACLE["stream_ingest"] = usn_events_sql(_USN)
ORACLE["stream_text_ingest"] = ORACLE["pca_launch"]
ORACLE["stream_counts"] = "SELECT 'EVTX' AS artifact_type, count(*) AS events FROM events"
ORACLE["live_counts"] = "SELECT unnest(['EVTX', 'TOTAL']) AS artifact_type, count(*) AS events FROM events"
ORACLE["stream_current_paths"] = f"SELECT 'host0' AS host_id, file_path FROM {_PATHS}"
ORACLE["csv_round_trip"] = f"""
SELECT doc_id * 1000 AS timestamp_ns, {iso('(doc_id * 1000)')} AS timestamp_iso, 'M' AS macb, 'SRC' AS source, 'say "' || lang || '", x' AS artifact,
       text AS message, left(text, 80) AS message_short, false AS is_fn_timestamp, CAST(0 AS INTEGER) AS tz_offset_secs,
       CASE WHEN doc_id % 2 = 0 THEN lang END AS file_path, CAST(NULL AS VARCHAR) AS hostname FROM documents"""
