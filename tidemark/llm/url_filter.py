"""URL filter: listed rules, else logistic regression on hashed character n-grams of host and path.

Everything is DataFrame expressions.  The model is trained by gradient descent over a small
labelled URL table; its weights are one constant array of ``buckets`` numbers, so scoring needs no
join and no shuffle.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from ..session import materialize

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"

#: (rule, verdict): a host with all its subdomains and the start of the path.
RULES = [("net/", "block"), ("example.net/en/", "allow"), ("example.com/de/", "block"), ("org/fr/", "allow")]

#: A small labelled table: names of hosts people block, and of hosts they do not.
BLOCKED_HOSTS = """casino-win casino-bonus online-casino best-slots slots-play free-bets sport-bets poker-room jackpot-win
cheap-pills pills-shop viagra-deal pharma-cheap adult-x adult-cams xxx-video porn-tube hot-cams sex-chat ads-track adserver
track-click click-ads popunder-ads spam-farm link-farm seo-spam free-money quick-loan payday-loan win-prize lottery-win
crack-serial warez-down torrent-crack fake-watch replica-bags phish-login malware-drop""".split()
ALLOWED_HOSTS = """news weather library museum history science nature garden kitchen recipes travel maps music cinema books
reading school university health sports football chess community city council archive journal letters review gallery
photography engineering software docs developer mathematics physics chemistry biology philosophy language dictionary
encyclopedia parents city-news open-library school-board world-atlas food-recipes local-weather health-guide art-museum book-review
music-class thered thonon tionand erhein ouring bleand""".split()
#: Both kinds of names stand in the same places, so that the places themselves say nothing.
LABELLED = [(f"https://{before}{name}{behind}", label)
            for label, names in ((1, BLOCKED_HOSTS), (0, ALLOWED_HOSTS)) for name in names
            for before, behind in (("www.", ".example.com/en/12"), ("blog.", ".example.net/de/3.html"),
                                   ("m.", ".example.org/fr/77?x=1"), ("", ".example.com/es/415/"))]


def host_and_path(url: Column) -> tuple[Column, Column]:
    """Both empty where there is no ``://`` or no url; only A-Z are lower-cased."""
    at = F.instr(url, "://")
    rest = F.when(at > 0, F.substr(url, at + 3)).otherwise(F.lit(""))
    host = F.translate(F.regexp_extract(rest, "^[^/?#]*", 0), UPPER, LOWER)
    path = F.regexp_extract(rest, "^[^/?#]*([^?#]*)", 1)
    return F.coalesce(host, F.lit("")), F.coalesce(path, F.lit(""))


def rule_of(host: Column, path: Column, rules: list[tuple[str, str]]) -> tuple[Column, Column]:
    """The longest rule that fits and its verdict, else nulls; equally long rules: the first in text order."""
    fits: Column = F.lit(None).cast("string")
    verdict: Column = F.lit(None).cast("string")
    for rule, says in sorted(rules, key=lambda r: (len(r[0]), [-ord(c) for c in r[0]])):
        name, slash, rest = rule.partition("/")
        fit = ((host == name) | host.endswith("." + name)) & path.startswith(slash + rest)
        fits = F.when(fit, F.lit(rule)).otherwise(fits)
        verdict = F.when(fit, F.lit(says)).otherwise(verdict)
    return fits, verdict


def hashed_grams(host: Column, path: Column, buckets: int, sizes: tuple[int, ...] = (3, 4, 5)) -> Column:
    """Distinct buckets of the character n-grams of host and path, each with its part's mark."""
    def grams(text: Column, mark: str) -> Column:
        padded = F.concat(F.lit("^"), text, F.lit("$"))
        return F.flatten(F.array(*[
            F.transform(F.sequence(F.lit(1), F.greatest(F.length(padded) - F.lit(n - 1), F.lit(1))),
                        lambda i, n=n: F.pmod(F.xxhash64(F.lit(mark), F.substr(padded, i, F.lit(n))), F.lit(buckets)).cast("int"))
            for n in sizes]))
    return F.array_distinct(F.concat(grams(host, "h"), grams(path, "p")))


def constant(weights: dict[int, float], buckets: int) -> Column:
    """The weights as a constant array (folded once by the optimizer)."""
    return F.split(F.lit(",".join(f"{weights[k]:.6g}" if k in weights else "0" for k in range(buckets))), ",").cast("array<double>")


def score(grams: Column, weights: dict[int, float], bias: float, buckets: int) -> Column:
    """Log-odds of block."""
    w = constant(weights, buckets)
    total = F.aggregate(grams, F.lit(0.0), lambda s, k: s + F.get(w, k))
    return F.lit(bias) + total / F.sqrt(F.greatest(F.size(grams), F.lit(1)).cast("double"))


def labelled_table(spark: SparkSession, rows: list[tuple[str, int]] | None = None) -> DataFrame:
    """``url, label`` (1: block) of the built-in table or of ``rows``."""
    rows = LABELLED if rows is None else rows
    one = F.explode(F.array(*[F.struct(F.lit(u).alias("url"), F.lit(y).alias("label")) for u, y in rows]))
    return spark.range(0, 1, 1, 1).select(one.alias("r")).select("r.*")


def train(labelled: DataFrame, buckets: int = 1 << 15, rounds: int = 20, rate: float = 40.0, decay: float = 1e-4,
          most_rows: int = 10_000) -> tuple[dict[int, float], float]:
    """Weights by bucket and bias.

    At most ``most_rows`` labelled urls are used, those with the smallest hashes; nulls take no
    part.  Each round is one aggregation to at most ``buckets`` sums, the gradient.  Without both
    labels every url is allowed.
    """
    rows = labelled.select(F.col("url").cast("string"), F.col("label").cast("int")).dropna().distinct()
    rows = rows.orderBy(F.xxhash64("url"), "url", "label").limit(most_rows)
    host, path = host_and_path(F.col("url"))
    rows = materialize(rows.select("label", hashed_grams(host, path, buckets).alias("grams")), "url_filter")
    n, blocked = rows.agg(F.count(F.lit(1)), F.sum("label")).first()
    if not n or not blocked or blocked == n:
        return {}, -1.0
    weights: dict[int, float] = {}
    speed: dict[int, float] = {}
    bias = math.log(blocked / (n - blocked))
    for _ in range(rounds):
        error = F.col("label") - 1 / (1 + F.exp(-score(F.col("grams"), weights, bias, buckets)))
        steps = (rows.select("grams", (error / F.sqrt(F.size("grams").cast("double"))).alias("step"))
                 .select(F.explode("grams").alias("k"), "step").groupBy("k").agg(F.sum("step").alias("step")).collect())
        for r in steps:
            speed[r.k] = 0.8 * speed.get(r.k, 0.0) + rate * (r.step / n - decay * weights.get(r.k, 0.0))
            weights[r.k] = weights.get(r.k, 0.0) + speed[r.k]
    return weights, bias


def judge(pages: DataFrame, rules: list[tuple[str, str]] = RULES, labelled: DataFrame | None = None,
          buckets: int = 1 << 15, page_id: str = "page_id", url: str = "url") -> DataFrame:
    """``page_id, host, path, rule, verdict, log_odds`` of every row.

    A null url, or one without ``://``, has empty host and path; no rule fits it and the model
    judges the empty parts.  Null and repeated ids are kept as they are; other columns are not
    looked at.  ``log_odds`` is the model's for block, also where a rule decides.
    """
    spark = pages.sparkSession
    weights, bias = train(labelled_table(spark) if labelled is None else labelled, buckets)
    host, path = host_and_path(F.col("url"))
    rows = pages.select(F.col(page_id).cast("long").alias("page_id"), F.col(url).cast("string").alias("url"))
    rows = rows.select("page_id", host.alias("host"), path.alias("path"))
    rule, says = rule_of(F.col("host"), F.col("path"), rules)
    log_odds = score(hashed_grams(F.col("host"), F.col("path"), buckets), weights, bias, buckets)
    rows = rows.select("page_id", "host", "path", rule.alias("rule"), says.alias("says"), log_odds.alias("log_odds"))
    verdict = F.coalesce("says", F.when(F.col("log_odds") > 0, F.lit("block")).otherwise(F.lit("allow")))
    return rows.select("page_id", "host", "path", "rule", verdict.alias("verdict"), "log_odds")
