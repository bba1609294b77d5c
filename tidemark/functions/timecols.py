"""Time conversions as Column expressions; every result is BIGINT nanoseconds, UTC.

Spark's TIMESTAMP keeps microseconds, file times tick every 100 ns, so instants stay LONG.
Each conversion returns 0 for null, non-positive or unrepresentable input.
"""

from __future__ import annotations

import struct

from pyspark.sql import Column, functions as F

FILETIME_EPOCH = 116_444_736_000_000_000      # 100 ns ticks from 1601 to 1970
WEBKIT_EPOCH_US = 11_644_473_600 * 1_000_000  # microseconds from 1601 to 1970
OLE_EPOCH_DAYS = 25_569.0                     # days from 1899-12-30 to 1970
OLE_MIN, OLE_MAX = 1.0, 120_000.0
I64_MAX = 9_223_372_036_854_775_807
YEAR_2200_NS = 7_258_118_400_000_000_000
NS = 1_000_000_000


def as_col(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def _double_bits(x: float) -> int:
    return struct.unpack("<q", struct.pack("<d", x))[0]


def integer_div(c: Column, divisor: int) -> Column:
    """Whole-number division (toward zero) without a detour through DOUBLE."""
    return F.call_function("div", c, F.lit(divisor))


def filetime_to_ns(c, max_ns: int = I64_MAX) -> Column:
    c = as_col(c)
    inside = c.between(FILETIME_EPOCH, FILETIME_EPOCH + max_ns // 100)
    return F.when(inside, ((c - FILETIME_EPOCH) * 100).cast("bigint")).otherwise(F.lit(0).cast("bigint"))


def ns_to_filetime(c) -> Column:
    """Inverse of ``filetime_to_ns`` (drops digits below 100 ns)."""
    return integer_div(as_col(c), 100) + FILETIME_EPOCH


def webkit_us_to_ns(c) -> Column:
    c = as_col(c)
    inside = c.between(WEBKIT_EPOCH_US + 1, WEBKIT_EPOCH_US + I64_MAX // 1000)
    return F.when(inside, (c - WEBKIT_EPOCH_US) * 1000).otherwise(F.lit(0).cast("bigint"))


def unix_us_to_ns(c) -> Column:
    c = as_col(c)
    return F.when(c.between(1, I64_MAX // 1000), c * 1000).otherwise(F.lit(0).cast("bigint"))


def unix_s_to_ns(c) -> Column:
    c = as_col(c)
    return F.when(c.between(1, I64_MAX // NS), c * NS).otherwise(F.lit(0).cast("bigint"))


def timestamp_to_ns(c) -> Column:
    """TIMESTAMP or TIMESTAMP_NTZ (read as UTC) to nanoseconds."""
    return F.unix_micros(as_col(c).cast("timestamp")) * 1000


def ole_to_ns(c) -> Column:
    c = as_col(c)
    seconds = (c - OLE_EPOCH_DAYS) * 86_400.0
    ns = (seconds * 1e9).cast("bigint")
    return F.when(c.between(OLE_MIN, OLE_MAX), F.greatest(ns, F.lit(0))).otherwise(F.lit(0).cast("bigint"))


def bits_to_double(c) -> Column:
    """Read the bits of a positive BIGINT as an IEEE-754 double (for 1.0 <= value < 2**31)."""
    c = as_col(c)
    exponent = F.shiftrightunsigned(c, 52) - 1023
    fraction = c.bitwiseAND(F.lit((1 << 52) - 1)).cast("double") / float(1 << 52)
    return F.pow(F.lit(2.0), exponent.cast("double")) * (fraction + 1.0)


def srum_time_to_ns(ts_double, ts_long) -> Column:
    """First usable of: OLE double; BIGINT holding the bits of an OLE double; FILETIME."""
    ts_double, ts_long = as_col(ts_double), as_col(ts_long)
    ole_bits = ts_long.between(_double_bits(OLE_MIN), _double_bits(OLE_MAX))
    from_double = ole_to_ns(ts_double)
    from_long = F.when(ole_bits, ole_to_ns(bits_to_double(ts_long))).otherwise(filetime_to_ns(ts_long))
    return F.when(from_double > 0, from_double).otherwise(from_long)


def _civil_to_ns(text: Column, fmt: str, fraction: Column) -> Column:
    seconds = F.unix_seconds(F.try_to_timestamp(text, F.lit(fmt)))
    nanos = F.rpad(F.substring(fraction, 1, 9), 9, "0").cast("bigint")
    return F.coalesce(seconds * NS + nanos, F.lit(0).cast("bigint"))


_TEXT_TS = r"^(\d{4}-\d{1,2}-\d{1,2} \d{1,2}:\d{1,2}:\d{1,2})(?:\.(\d{1,6}))?$"
_ISO_TS = r"^(\d{4}-\d{1,2}-\d{1,2}T\d{1,2}:\d{1,2})(?:(:\d{1,2})(?:\.(\d+))?)?$"
_WMI_TS = r"^(\d{14})\.(\d{6})([+-])(\d{3})"


def parse_text_ts(c) -> Column:
    """``YYYY-MM-DD HH:MM:SS[.f]`` read as UTC; 0 when malformed."""
    text = F.trim(as_col(c))
    whole = F.nullif(F.regexp_extract(text, _TEXT_TS, 1), F.lit(""))
    return _civil_to_ns(whole, "yyyy-M-d H:m:s", F.regexp_extract(text, _TEXT_TS, 2))


def parse_iso_ts(c) -> Column:
    """``YYYY-MM-DDTHH:MM[:SS[.f…]][Z]`` read as UTC, fraction kept to the nanosecond."""
    text = F.regexp_replace(F.trim(as_col(c)), "Z+$", "")
    minute = F.nullif(F.regexp_extract(text, _ISO_TS, 1), F.lit(""))
    second = F.regexp_extract(text, _ISO_TS, 2)
    whole = F.concat(minute, F.when(second == "", F.lit(":0")).otherwise(second))
    return _civil_to_ns(whole, "yyyy-M-d'T'H:m:s", F.regexp_extract(text, _ISO_TS, 3))


def parse_wmi_ts(c) -> Column:
    """``yyyymmddHHMMSS.ffffff±UUU`` with the zone offset in minutes."""
    text = as_col(c)
    whole = F.nullif(F.regexp_extract(text, _WMI_TS, 1), F.lit(""))
    local = _civil_to_ns(whole, "yyyyMMddHHmmss", F.regexp_extract(text, _WMI_TS, 2))
    minutes = F.regexp_extract(text, _WMI_TS, 4).try_cast("bigint")
    sign = F.when(F.regexp_extract(text, _WMI_TS, 3) == "+", F.lit(1)).otherwise(F.lit(-1))
    return F.when(local != 0, local - sign * minutes * (60 * NS)).otherwise(F.lit(0).cast("bigint"))


def ns_to_iso(c) -> Column:
    """``YYYY-MM-DDTHH:MM:SS[.f]Z`` without trailing zeros; a fixed text when out of range."""
    given = as_col(c)
    ns = given.try_cast("bigint")
    nanos = F.pmod(ns, F.lit(NS))
    seconds = integer_div(ns - nanos, NS)
    base = F.date_format(F.timestamp_seconds(seconds), "yyyy-MM-dd'T'HH:mm:ss")
    digits = F.rtrim(F.lpad(nanos.cast("string"), 9, "0"), F.lit("0"))
    text = F.concat(base, F.when(nanos == 0, F.lit("")).otherwise(F.concat(F.lit("."), digits)), F.lit("Z"))
    return F.when(ns.isNotNull(), text).when(given.isNotNull(), F.lit("1601-01-01T00:00:00Z"))


def clamp_ns(c) -> Column:
    """Null, negative or beyond 64 bits becomes 0."""
    ns = as_col(c).try_cast("bigint")
    return F.when(ns >= 0, ns).otherwise(F.lit(0).cast("bigint"))
