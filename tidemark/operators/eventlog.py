"""Events from decoded event-log records."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from ..functions import lookups as L
from ..functions.textcols import (any_of, blank_to_null, is_evtx_noise, is_template_noise, let, level_tag,
                                  logon_type_name, strip, trunc)
from ..functions.timecols import filetime_to_ns
from .timeline import to_events


def event_name_table(spark: SparkSession, names: dict[int, str] | None = None) -> DataFrame:
    """The fixed event-id table as an inline relation (142 rows, so broadcast is bounded)."""
    rows = ", ".join(f"({k}, '{v}')" for k, v in (names or L.EVENT_NAMES).items())
    return spark.sql(f"SELECT * FROM VALUES {rows} AS t(event_id, event_name)")


def evtx_names(rec: DataFrame, by_provider: DataFrame | None = None) -> DataFrame:
    """Add ``event_name`` by id; ``by_provider`` (provider, event_id, name) overrides the default."""
    named = rec.join(F.broadcast(event_name_table(rec.sparkSession)), "event_id", "left")
    if by_provider is None:
        return named
    special = by_provider.select("provider", "event_id", F.col("name").alias("_own"))
    return (named.join(special, ["provider", "event_id"], "left")
            .withColumn("event_name", F.coalesce("_own", "event_name")).drop("_own"))


def evtx_generic_snippet(strings) -> Column:
    """First three telling strings, each cut at 80; null when none is left."""
    clean = F.slice(F.filter(strings, lambda s: (s != "") & ~is_evtx_noise(s)), 1, 3)
    return let(clean, lambda c: F.when(F.size(c) > 0, F.array_join(F.transform(c, lambda s: trunc(s, 80)), " | ")))


_NOT_ACCOUNTS = sorted({w.lower() for w in L.NOT_ACCOUNTS})


def _not_account(s: Column) -> Column:
    return any_of([
        s == "", s.startswith("S-1-"), s.startswith("%%"), s.startswith("Microsoft"),
        s.contains("\\"), s.contains("Auditing"), s.contains("://"),
        F.lower(s).isin(_NOT_ACCOUNTS), strip(s) != s, s.rlike("^[0-9]+$|^[0-9].*\\..*\\."),
    ])


def evtx_logon_snippet(strings, u32s, with_type: Column) -> Column:
    """``Type n (name) | Account: a | Target: t``, each part when present."""
    codes = F.filter(F.when(with_type, u32s), lambda v: (v >= 2) & (v <= 11))
    kinds = F.transform(F.slice(codes, 1, 1), lambda v: F.concat(
        F.lit("Type "), v.cast("string"), F.lit(" ("), logon_type_name(v), F.lit(")")))
    names = F.slice(F.filter(strings, lambda s: ~_not_account(s)), 1, 2)

    def text(n: Column) -> Column:
        account, target = F.get(n, F.lit(0)), F.get(n, F.lit(1))
        return F.concat_ws(" | ", kinds, F.concat(F.lit("Account: "), account),
                           F.when(target != account, F.concat(F.lit("Target: "), target)))

    return let(let(names, text), blank_to_null)


def evtx_script_snippet(strings) -> Column:
    """Path of the first script file, else the longest telling string of 20 characters or more."""
    def is_script(s):
        return F.lower(F.right(s, F.lit(5))).rlike('\\.ps1"?$')

    scripts = F.filter(strings, lambda s: (F.length(s) >= 10) & is_script(s))
    prose = F.filter(strings, lambda s: (F.length(s) >= 20) & ~is_script(s) & ~is_template_noise(s))
    longest = F.array_max(F.transform(prose, lambda s, i: F.struct(
        F.length(s).alias("n"), (-i).alias("i"), s.alias("s"))))["s"]
    return F.coalesce(
        let(F.get(scripts, F.lit(0)), lambda s: F.concat(F.lit("Script: "), trunc(s, 200))),
        let(longest, lambda s: trunc(s, 160)))


_NOT_COMPUTERS = sorted({w.lower() for w in L.NOT_COMPUTERS})


def evtx_hostname(strings) -> Column:
    """Computer name guessed from the strings of a record; empty when none is convincing.

    A name is upper case, five characters or more, without dots, with a letter beyond A..F
    (so no hexadecimal fragment).  Hyphenated names win over plain ones, which need a digit.
    """
    def candidate(s):
        return (
            s.rlike("^(?=.*[G-Z])[A-Z][A-Z0-9-]{3,62}[A-Z0-9]$") & (F.length(s) >= 5)
            & ~F.lower(s).isin(_NOT_COMPUTERS) & ~is_evtx_noise(s)
        )

    def hyphenated(s):
        return s.contains("-") & ~s.rlike("(-.*){4}")

    def numbered(s):
        return ~s.contains("-") & s.rlike("[0-9]") & ~s.startswith("KB")

    return let(F.filter(strings, candidate), lambda likely: F.coalesce(
        *[F.get(F.filter(likely, rule), F.lit(0)) for rule in (hyphenated, numbered)], F.lit("")))


SCRIPT_IDS = [4103, 4104]
TYPED_LOGON_IDS = [4624, 4625, 4648]
LOGON_IDS = TYPED_LOGON_IDS + [4634, 4647, 4672, 4776]


def evtx_snippet(rec: DataFrame) -> Column:
    """The snippet rule of each event id, falling back to the generic one."""
    event_id = rec["event_id"]
    special = (
        F.when(event_id.isin(SCRIPT_IDS), evtx_script_snippet(F.col("strings")))
        .when(event_id.isin(LOGON_IDS), evtx_logon_snippet(
            F.col("strings"), F.col("u32s"), event_id.isin(TYPED_LOGON_IDS)))
    )
    return F.coalesce(special, evtx_generic_snippet(F.col("strings")))


def evtx_events(rec: DataFrame, by_provider: DataFrame | None = None) -> DataFrame:
    """``EventID n[ LEVEL] - name [channel] - snippet``, every part after the id optional."""
    named = evtx_names(rec.withColumn("_snippet", evtx_snippet(rec)), by_provider)
    given = F.coalesce("channel", F.lit(""))
    stem = F.regexp_replace(F.regexp_replace("file_name", r"(\.evtx)+$", ""), r"(\.EVTX)+$", "")
    channel = F.when((given == "") | given.contains("://"),
                     F.coalesce(F.replace(stem, F.lit("%4"), F.lit("/")), given)).otherwise(given)
    message = F.concat(
        F.lit("EventID "), F.col("event_id").cast("string"), level_tag("level"),
        F.coalesce(F.concat(F.lit(" - "), "event_name"), F.lit("")),
        F.when(channel != "", F.concat(F.lit(" ["), channel, F.lit("]"))).otherwise(""),
        F.coalesce(F.concat(F.lit(" - "), "_snippet"), F.lit("")))
    computer = F.coalesce(blank_to_null("computer"), evtx_hostname(F.col("strings")))
    return to_events(
        named, artifact_type="EVTX", source="EVTX", artifact="Windows Event Log",
        ts=filetime_to_ns("filetime"), message=message, hostname=computer,
        extra={"event_id": F.col("event_id"), "record_number": F.col("record_number"),
               "channel": channel, "level": F.col("level"), "strings": F.to_json("strings")})
