"""Text, size and label functions as Column expressions."""

from __future__ import annotations

from functools import reduce
from itertools import chain
from operator import or_

from pyspark.sql import Column, functions as F

from . import lookups as L
from .timecols import as_col, integer_div


def label(code, names: dict, default) -> Column:
    """Fixed code table as a literal map, with a default for unknown codes."""
    table = F.create_map(*[F.lit(x) for x in chain.from_iterable(names.items())])
    code = as_col(code)
    if all(isinstance(k, int) for k in names):
        code = code.cast("int")
    found = F.when(code.isNotNull(), F.try_element_at(table, code))
    return F.coalesce(found, F.lit(default) if isinstance(default, str) else default)


def blank_to_null(c) -> Column:
    return F.nullif(as_col(c), F.lit(""))


def first_filled(*cols) -> Column:
    """First value that is neither null nor empty."""
    return F.coalesce(*[blank_to_null(c) for c in cols])


def prefixed(prefix: str, c) -> Column:
    """``prefix + value``, null when the value is null or empty (for ``concat_ws``)."""
    return F.concat(F.lit(prefix), blank_to_null(c))


def let(value: Column, body) -> Column:
    """``body(value)`` with ``value`` computed once per row, however often the body uses it."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


# Unicode white space.
WHITE_SPACE = ("\t\n\x0b\x0c\r \x85\xa0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a"
               "\u2028\u2029\u202f\u205f\u3000")


def strip(c) -> Column:
    """Trim Unicode white space at both ends."""
    return F.trim(as_col(c), F.lit(WHITE_SPACE))


def any_of(tests) -> Column:
    return reduce(or_, tests)


# ---- change journal ---------------------------------------------------------------------

def usn_reasons(c, ascending: bool = False) -> Column:
    """Names of the set reason bits joined by ``|``; hexadecimal when none is known."""
    c = as_col(c).cast("bigint")
    bits = sorted(L.USN_REASONS) if ascending else L.USN_REASONS
    known = sum(bit for bit, _ in bits)
    return F.concat_ws(
        "|", *[F.when(c.bitwiseAND(F.lit(bit)) != 0, F.lit(name)) for bit, name in bits],
        F.when(c.bitwiseAND(F.lit(known)) == 0, F.format_string("0x%08X", c)))


# ---- lengths and numbers ----------------------------------------------------------------

def trunc(c, n: int) -> Column:
    c = as_col(c)
    return F.when(F.length(c) > n, F.concat(F.left(c, F.lit(n)), F.lit("..."))).otherwise(c)


def short80(c) -> Column:
    return F.left(F.coalesce(as_col(c), F.lit("")), F.lit(80))


def _tenths(c: Column, unit: int, suffix: str) -> Column:
    """One decimal digit, exact ties to even, in whole-number arithmetic."""
    rest = F.pmod(c, F.lit(unit)) * 10
    floor = integer_div(c, unit) * 10 + integer_div(rest, unit)
    left = F.pmod(rest, F.lit(unit)) * 2
    up = (left > unit) | ((left == unit) & (F.pmod(floor, F.lit(2)) == 1))
    value = floor + F.when(up, 1).otherwise(0)
    return F.concat(integer_div(value, 10).cast("string"), F.lit("."),
                    F.pmod(value, F.lit(10)).cast("string"), F.lit(suffix))


def fmt_size(c) -> Column:
    c = as_col(c).cast("bigint")
    return (
        F.when(c >= 1 << 30, _tenths(c, 1 << 30, " GB"))
        .when(c >= 1 << 20, _tenths(c, 1 << 20, " MB"))
        .when(c >= 1 << 10, F.concat(integer_div(c, 1 << 10).cast("string"), F.lit(" KB")))
        .otherwise(F.concat(c.cast("string"), F.lit(" bytes")))
    )


def thousands(c) -> Column:
    return F.format_number(as_col(c), 0)


# ---- names ------------------------------------------------------------------------------

def rot13(c) -> Column:
    low, up = "abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
    return F.translate(as_col(c), low + up, low[13:] + low[:13] + up[13:] + up[:13])


def base_name(c) -> Column:
    return F.substring_index(as_col(c), "\\", -1)


def file_uri_to_path(c) -> Column:
    text = F.replace(as_col(c), F.lit("file:///"), F.lit(""))
    return F.replace(text, F.lit("/"), F.lit("\\"))


def resolve_sid(c) -> Column:
    sid = as_col(c)
    return (
        F.when(sid.endswith("-500"), F.concat(F.lit("Administrator ("), sid, F.lit(")")))
        .when(sid.endswith("-501"), F.concat(F.lit("Guest ("), sid, F.lit(")")))
        .otherwise(label(sid, L.KNOWN_SIDS, sid))
    )


def looks_like_hex(c) -> Column:
    return F.regexp_replace(as_col(c), r"\.*$", "").rlike(r"^[0-9a-fA-F]{8,}\s*$")


def cp1252_text(b) -> Column:
    """Windows-1252 bytes to text; the five undefined bytes become U+FFFD."""
    latin = F.decode(as_col(b), "ISO-8859-1")
    return F.translate(latin, L.CP1252_BYTES + L.CP1252_UNDEFINED,
                       L.CP1252_CHARS + "�" * len(L.CP1252_UNDEFINED))


# ---- code labels ------------------------------------------------------------------------

def logon_type_name(c) -> Column:
    return label(c, L.LOGON_TYPES, "Unknown")


def drive_type_name(c) -> Column:
    return label(c, L.DRIVE_TYPES, "Unknown")


def iface_name(c) -> Column:
    """Null stays null; unknown types print as ``iface=n``."""
    c = as_col(c)
    return F.when(c.isNotNull(), label(c, L.INTERFACE_TYPES, F.concat(F.lit("iface="), c.cast("string"))))


def pca_status_name(c) -> Column:
    c = F.coalesce(as_col(c).cast("int"), F.lit(-1))
    return label(c, L.PCA_STATUSES, F.concat(F.lit("status="), c.cast("string")))


def activity_name(c) -> Column:
    c = as_col(c)
    return label(c, L.ACTIVITY_TYPES, F.concat(F.lit("Type"), F.coalesce(c.cast("string"), F.lit("None"))))


def level_tag(c) -> Column:
    return label(c, L.LEVEL_TAGS, "")


def macb_desc(macb, artifact, strict_ref: bool = False) -> Column:
    """Artifact followed by the meaning of its time flags.

    One flag, alone or in a ``.``-padded group, gives its label; several flags give all
    labels joined by ``, ``.  ``strict_ref`` labels only bare one-letter flags.
    """
    macb, artifact = as_col(macb), as_col(artifact)
    if strict_ref:
        desc = label(macb, L.MACB_LABELS, "Timestamp")
    else:
        found = F.concat_ws(", ", *[F.when(macb.contains(k), F.lit(v)) for k, v in L.MACB_LABELS.items()])
        desc = F.coalesce(blank_to_null(found), F.lit("Timestamp"))
    return F.concat_ws(" ", blank_to_null(artifact), desc)


# ---- activity JSON ----------------------------------------------------------------------

def timeline_app_name(c) -> Column:
    """First non-empty ``application`` of a JSON array; only the file name of a path."""
    entries = F.from_json(as_col(c), "array<struct<application: string>>")
    first = F.try_element_at(F.filter(entries, lambda e: F.coalesce(e["application"], F.lit("")) != ""), F.lit(1))
    return F.coalesce(base_name(first["application"]), F.lit(""))


_OUTER_KEYS = ("displayText", "description", "contentUri", "activationUri")
_INNER_KEYS = ("displayText", "description", "contentUri")


def _json_text(c: Column, path: str) -> Column:
    return blank_to_null(F.get_json_object(c, path))


def timeline_payload(c) -> Column:
    """Display text of an activity payload, looking one level down when needed."""
    c = as_col(c)
    outer = [_json_text(c, f"$.{k}") for k in _OUTER_KEYS]
    nested = F.coalesce(_json_text(c, "$.userTimeline"), _json_text(c, "$.payload"))
    inner = [_json_text(nested, f"$.{k}") for k in _INNER_KEYS]
    return F.coalesce(strip(F.coalesce(*outer, *inner)), F.lit(""))


# ---- event-log noise --------------------------------------------------------------------

_GUID = r"^[^-]*(-[^-]*){4}$"


def is_guid(c) -> Column:
    """36 bytes with exactly four hyphens."""
    c = as_col(c)
    return (F.octet_length(c) == 36) & c.rlike(_GUID)


def is_template_noise(c) -> Column:
    """Guids, URLs, provider and channel names, and field labels."""
    c = as_col(c)
    return any_of(
        [is_guid(c), c.contains("://"), c.isin(L.CHANNEL_WORDS + L.FIELD_LABELS)]
        + [c.startswith(p) for p in L.PROVIDER_PREFIXES]
        + [c.contains(f) for f in L.PROVIDER_FRAGMENTS]
    )


def is_evtx_noise(c) -> Column:
    """Strings that say nothing about the event."""
    c = as_col(c)
    return any_of([
        F.octet_length(c) <= 2,
        c.startswith("{"),
        c.contains("\n"), c.contains("\r"), c.startswith("#"),
        c.rlike("^[0-9-]*$"),
        c.startswith("Microsoft "),
        is_template_noise(c),
    ])
