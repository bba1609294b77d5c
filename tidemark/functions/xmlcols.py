"""First values of XML elements as one expression, also from documents that break off.

A document is cut into marks and texts by one pattern, and a fold over them keeps the open elements
and the values found so far.  The first error ends the reading of that document, not the job; what
stood before it is kept.  Built-in XML functions give nothing for such a document or fail.
"""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, functions as F

from .textcols import strip

# CDATA, comment, instruction, tag (a quoted value may hold ``>``), text, or a ``<`` that opens none of them.
TOKEN = (r"""(?s)<!\[CDATA\[.*?\]\]>|<!--.*?-->|<\?.*?\?>"""
         r"""|<(?!!--|!\[CDATA\[|\?)[^<>"']*+(?:"[^"<]*+"[^<>"']*+|'[^'<]*+'[^<>"']*+)*+>|[^<]++|<""")
NAMED = {"&lt;": "<", "&gt;": ">", "&quot;": '"', "&apos;": "'"}
REFERENCE = r"&(?:amp|lt|gt|quot|apos|#[0-9]{1,7}|#x[0-9A-Fa-f]{1,6});"
OTHER, START, END, EMPTY, TEXT, ERROR = range(6)


def unescape(text: Column) -> Column:
    """Character references as characters; each is replaced once."""
    for name, char in NAMED.items():
        text = F.replace(text, F.lit(name), F.lit(char))

    def numbered(part: Column, i: Column) -> Column:
        rest = F.replace(part, F.lit("&amp;"), F.lit("&"))
        number = F.regexp_extract(part, "^(x[0-9A-Fa-f]+|[0-9]+);", 1)
        code = F.when(number.startswith("x"), F.conv(F.substring(number, 2, 6), 16, 10)).otherwise(number).cast("int")
        char = F.decode(F.unhex(F.lpad(F.hex(code), 8, "0")), "UTF-32")
        return F.when((i == 0) | (number == ""), rest).otherwise(F.concat(char, F.regexp_replace(rest, "^x?[0-9A-Fa-f]+;", "")))

    return F.array_join(F.transform(F.split(text, "&#"), numbered), "")


def _named(raw: Column) -> Column:
    """A mark and the name in its tag; empty for texts and for marks that are no tags."""
    tag = raw.startswith("<") & ~raw.startswith("<!") & ~raw.startswith("<?")
    return F.struct(raw.alias("raw"), F.when(tag, F.regexp_extract(raw, r"^</?([^\s/>]+)", 1)).otherwise("").alias("name"))


def _token(mark: Column) -> Column:
    """Kind, name, name without prefix, and text of one mark.  Texts without ``&`` need no further look."""
    raw, name = mark["raw"], mark["name"]
    cdata, plain = raw.startswith("<![CDATA["), ~raw.startswith("<") & ~raw.contains("&")
    marked = F.when(name == "", ERROR).when(raw.startswith("</"), END).when(raw.endswith("/>"), EMPTY).otherwise(START)
    kind = (F.when(plain | cdata, TEXT).when(raw.startswith("<!") | raw.startswith("<?"), OTHER).when(raw.startswith("<"), marked)
            .when(F.regexp_replace(raw, REFERENCE, "").contains("&"), ERROR).otherwise(TEXT))
    text = (F.when(plain, raw).when(cdata, F.substring(raw, F.lit(10), F.length(raw) - 12))
            .when(~raw.startswith("<"), unescape(raw)).otherwise(""))
    return F.struct(kind.alias("kind"), name.alias("name"), _local(name).alias("local"), text.alias("text"))


def _local(name: Column) -> Column:
    return F.substring_index(name, ":", -1)


def first_values(xml: Column, fields: Mapping[str, tuple[str | None, str]], tag_ending: tuple[str, str] | None = None) -> Column:
    """A struct with the first filled text of each field's element, trimmed; empty where there is none.

    ``fields``: field name to (parent's name or None for any, element's name), without prefixes.  The text of an
    element is what follows its last inner mark.  ``tag_ending`` = (field, ending) gives the name of the first element
    that ends so.  Reading stops at a torn mark, an end that does not fit, or an unknown reference; a document type
    with declarations of its own counts as such an error.  Null gives empty fields.
    """
    marks = F.transform(F.regexp_extract_all(F.coalesce(xml, F.lit("")), F.lit(TOKEN), F.lit(0)), _named)
    tokens = F.transform(marks, _token)
    names = list(fields) + ([tag_ending[0]] if tag_ending else [])
    nothing = F.lit(None).cast("string")
    state = F.struct(F.array().cast("array<string>").alias("open"), F.lit("").alias("text"), F.lit(False).alias("ended"),
                     *[nothing.alias(n) for n in names])

    def step(s: Column, t: Column) -> Column:
        """One case for each kind of mark, so that a mark costs no more than its own."""
        kind, depth = t["kind"], F.size(s["open"])
        last, above = F.get(s["open"], depth - 1), F.get(s["open"], depth - 2)

        def then(open_: Column, text: Column, ended: bool = False, **found: Column) -> Column:
            return F.struct(open_.alias("open"), text.alias("text"), F.lit(ended).alias("ended"),
                            *[found.get(n, s[n]).alias(n) for n in names])

        found = {}
        for field, (parent, tag) in fields.items():
            here = t["local"] == tag
            here = here if parent is None else here & (_local(above) == parent)
            found[field] = F.coalesce(s[field], F.when(here, F.nullif(strip(s["text"]), F.lit(""))))
        first_tag = {}
        if tag_ending:
            field, ending = tag_ending
            first_tag[field] = F.coalesce(s[field], F.when(t["local"].endswith(ending), t["local"]))
        nothing_yet = F.lit("")
        return (F.when(s["ended"] | (kind == OTHER), s)
                .when(kind == TEXT, then(s["open"], F.concat(s["text"], t["text"])))
                .when(kind == START, then(F.concat(s["open"], F.array(t["name"])), nothing_yet, **first_tag))
                .when(kind == EMPTY, then(s["open"], nothing_yet, **first_tag))
                .when((kind == END) & F.coalesce(last == t["name"], F.lit(False)),
                      then(F.slice(s["open"], F.lit(1), depth - 1), nothing_yet, **found))
                .otherwise(then(s["open"], nothing_yet, True)))

    return F.aggregate(tokens, state, step, lambda s: F.struct(*[F.coalesce(s[n], F.lit("")).alias(n) for n in names]))
