"""Little-endian reads and counted / NUL-ended strings out of BINARY columns.

Offsets are 0-based.  A read past the end gives 0 or an empty string, never an error.
"""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from .timecols import as_col


def _off(o) -> Column:
    return F.lit(o) if isinstance(o, int) else as_col(o)


def _le_digits(b: Column, off: Column, width: int) -> Column:
    digits = F.hex(F.substring(b, off + 1, F.lit(width)))
    return F.concat(*[F.substring(digits, 2 * i + 1, 2) for i in reversed(range(width))])


def _le_signed(b, off, width: int) -> Column:
    b, off = as_col(b), _off(off)
    value = F.conv(_le_digits(b, off, width), 16, -10).cast("bigint")
    return F.when(F.length(b) >= off + width, value).otherwise(F.lit(0).cast("bigint"))


def le_u16(b, off) -> Column:
    return _le_signed(b, off, 2)


def le_u32(b, off) -> Column:
    return _le_signed(b, off, 4)


def le_i64(b, off) -> Column:
    """Eight bytes as BIGINT; values from 2**63 up wrap to negative."""
    return _le_signed(b, off, 8)


def le_u64(b, off) -> Column:
    """Eight bytes as an unsigned DECIMAL(20,0)."""
    value = le_i64(b, off).cast("decimal(20,0)")
    return F.when(value < 0, value + F.lit(str(1 << 64)).cast("decimal(20,0)")).otherwise(value).cast("decimal(20,0)")


def be_u32(b, off) -> Column:
    b, off = as_col(b), _off(off)
    value = F.conv(F.hex(F.substring(b, off + 1, F.lit(4))), 16, 10).cast("bigint")
    return F.when(F.length(b) >= off + 4, value).otherwise(F.lit(0).cast("bigint"))


def utf16le(b, off, n) -> Column:
    """``n`` UTF-16 code units from ``off``."""
    return F.decode(F.substring(as_col(b), _off(off) + 1, _off(n) * 2), "UTF-16LE")


def until_nul(text: Column) -> Column:
    return F.substring_index(text, "\0", 1)


def utf16le_z(b, off) -> Column:
    """UTF-16LE text up to the first NUL or the end."""
    return until_nul(F.decode(F.substring(as_col(b), _off(off) + 1, F.length(as_col(b))), "UTF-16LE"))


def utf16le_counted(b, off, n) -> Column:
    """Counted UTF-16LE text, cut at the first NUL."""
    return until_nul(utf16le(b, off, n))


def ascii_z(b, off) -> Column:
    """One-byte text up to the first NUL or the end; bad UTF-8 is replaced."""
    raw = F.substring(as_col(b), _off(off) + 1, F.length(as_col(b)))
    return until_nul(F.make_valid_utf8(raw.cast("string")))


def text_by_bom(b) -> Column:
    """UTF-16LE after an ``FF FE`` mark, else UTF-8; malformed units are replaced."""
    b = as_col(b)
    wide = F.substring(b, 1, 2) == F.lit(b"\xff\xfe")
    utf16 = F.decode(F.substring(b, F.lit(3), F.length(b)), "UTF-16LE")
    return F.when(wide, utf16).otherwise(F.make_valid_utf8(b.cast("string")))


def sid_from_bytes(b) -> Column:
    """Binary security id to ``S-rev-authority-sub…``; null when too short."""
    b = as_col(b)
    count = F.conv(F.hex(F.substring(b, 2, 1)), 16, 10).cast("int")
    revision = F.conv(F.hex(F.substring(b, 1, 1)), 16, 10)
    authority = F.conv(F.hex(F.substring(b, 3, 6)), 16, 10)
    subs = F.transform(
        F.when(count > 0, F.sequence(F.lit(0), count - 1)).otherwise(F.array().cast("array<int>")),
        lambda i: F.conv(_le_digits(b, i * 4 + 8, 4), 16, 10),
    )
    text = F.concat(F.lit("S-"), F.concat_ws("-", revision, authority, subs))
    return F.when((F.length(b) >= 8) & (F.length(b) >= count * 4 + 8), text)


# Registry value types.
REG_SZ, REG_EXPAND_SZ, REG_BINARY, REG_DWORD, REG_DWORD_BE = 1, 2, 3, 4, 5
REG_LINK, REG_MULTI_SZ, REG_QWORD = 6, 7, 11


def reg_value_text(kind, raw, whole: bool = False) -> Column:
    """Display text of a registry value, cut to 80 characters; ``whole`` cuts nothing."""
    kind, raw = as_col(kind), as_col(raw)
    hexed = F.lower(F.hex(raw))
    wide = F.decode(raw, "UTF-16LE")
    parts = F.filter(F.split(wide, "\0"), lambda p: p != "")
    parts = parts if whole else F.slice(parts, 1, 5)
    short_hex = F.concat(F.lower(F.hex(F.substring(raw, 1, 16))),
                         F.when(F.length(raw) > 16, F.lit("...")).otherwise(F.lit("")))
    text = (
        F.when(kind.isin(REG_SZ, REG_EXPAND_SZ, REG_LINK), F.rtrim(wide, F.lit("\0")))
        .when((kind == REG_DWORD) & (F.length(raw) >= 4), le_u32(raw, 0).cast("string"))
        .when((kind == REG_DWORD_BE) & (F.length(raw) >= 4), be_u32(raw, 0).cast("string"))
        .when((kind == REG_QWORD) & (F.length(raw) >= 8), le_u64(raw, 0).cast("string"))
        .when(kind == REG_MULTI_SZ, F.array_join(parts, " | "))
        .when(kind == REG_BINARY, hexed if whole else short_hex)
        .otherwise(hexed)
    )
    return text if whole else F.when(F.length(text) > 80, F.concat(F.left(text, F.lit(80)), F.lit("..."))).otherwise(text)
