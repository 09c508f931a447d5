"""Page filter by address rules and by empirical-Bayes host reputation."""
from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

from lociflow.llm.scratch import Scratch

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
MAX_RULES = 1000


def address(url: str) -> tuple[Column, Column]:
    """Host (A-Z lower-cased) and path; both empty where the url is null or has no ``://``."""
    at = F.instr(url, "://")
    rest = F.when(at > 0, F.expr(f"substring({url}, instr({url}, '://') + 3)")).otherwise("")
    host = F.translate(F.regexp_extract(rest, "^([^/?#]*)", 1), UPPER, LOWER)
    return F.coalesce(host, F.lit("")), F.coalesce(F.regexp_extract(rest, "^[^/?#]*([^?#]*)", 1), F.lit(""))


def matching_rule(rules: Sequence[str]) -> Column:
    """The longest of ``host/path`` rules that fits columns ``host`` and ``path``, else null."""
    if len(rules) > MAX_RULES:
        raise ValueError(f"{len(rules)} rules; at most {MAX_RULES} go into one expression")
    fits = []
    for rule in sorted(set(rules), key=lambda r: (-len(r), -len(r.partition("/")[0]), r)):
        host, slash, path = rule.partition("/")
        own = (F.col("host") == host) | F.col("host").endswith("." + host)
        fits.append(F.when(own & F.col("path").startswith(slash + path), F.lit(rule)))
    return F.coalesce(*fits, F.lit(None).cast("string"))


def _concentration(level: DataFrame) -> float:
    """Strength of the prior of ``level(k, n, prior)`` by the moments of the beta-binomial:
    E(k - n·prior)² = n·prior·(1 - prior)·(1 + (n - 1)·rho), strength = 1/rho - 1. rho is kept in 0.001 … 0.5."""
    v = F.col("n") * F.col("prior") * (1 - F.col("prior"))
    extra, unit = level.agg(F.sum(F.pow(F.col("k") - F.col("n") * F.col("prior"), 2) - v), F.sum(v * (F.col("n") - 1))).first()
    rho = extra / unit if unit else 0.001
    return 1 / min(0.5, max(0.001, rho)) - 1


def host_reputation(hosts: DataFrame, suffixes: Sequence[str] = (), z: float = 1.645) -> DataFrame:
    """``host, bad_low``: lower posterior bound of the share of bad pages.

    ``hosts(host, k, n)`` counts bad and judged pages, each host once. A suffix is
    shrunk to the overall share, a registered domain to its suffix, a host to its
    domain; how strongly is estimated at each level. Nothing is sized by pages here,
    only by hosts. ``suffixes`` names public suffixes of two labels; else it is the last label.
    """
    label = F.substring_index("host", ".", -1)
    two = F.substring_index("host", ".", -2)
    is_two = two.isin(*suffixes) if suffixes else F.lit(False)
    named = hosts.select("host", "k", "n", F.when(is_two, two).otherwise(label).alias("suffix"),
                         F.when(is_two, F.substring_index("host", ".", -3)).otherwise(two).alias("domain"))
    k, n = hosts.agg(F.sum("k"), F.sum("n")).first()
    overall = (k or 0) / n if n else 0.0
    level = named.groupBy("suffix").agg(F.sum("k").alias("k"), F.sum("n").alias("n")).withColumn("prior", F.lit(overall))
    s = _concentration(level)
    level = level.select("suffix", ((F.col("prior") * s + F.col("k")) / (F.col("n") + s)).alias("prior"))
    level = named.groupBy("suffix", "domain").agg(F.sum("k").alias("k"), F.sum("n").alias("n")).join(level, "suffix")
    s = _concentration(level)
    level = level.select("suffix", "domain", ((F.col("prior") * s + F.col("k")) / (F.col("n") + s)).alias("prior"))
    level = named.join(level, ["suffix", "domain"])
    s = _concentration(level)
    a, total = F.col("prior") * s + F.col("k"), F.col("n") + s
    mean = a / total
    return level.select("host", (mean - z * F.sqrt(mean * (1 - mean) / (total + 1))).alias("bad_low"))


def filter_urls(pages: DataFrame, outcomes: DataFrame, block: Sequence[str] = (), allow: Sequence[str] = (),
                bad_share: float | None = None, suffixes: Sequence[str] = (), z: float = 1.645,
                id_col: str = "page_id", url_col: str = "url") -> DataFrame:
    """``page_id, host, path, rule, verdict, bad_low`` of every row of ``pages``.

    The longest rule that fits decides; else a page is blocked if the lower
    posterior bound of its host's bad share exceeds ``bad_share``, by default the share of all judged pages: a
    host is blocked that is worse than the rest beyond doubt.
    ``outcomes(page_id, bad)`` holds judged pages, null ``bad`` or ``page_id`` not
    counting; repeated outcomes of a page count once, as bad if any is. Rows with a
    null or odd url have empty host and path, and the empty host has a reputation
    like any other. Repeated rows each get a row, and count each. Empty tables work.
    A hot host is one row of the reputation; counting it combines before the shuffle, and adaptive execution
    splits its side of the join.
    """
    host, path = address("url")
    pages = pages.select(F.col(id_col).alias("page_id"), F.col(url_col).alias("url"))
    parsed = pages.select("page_id", host.alias("host"), path.alias("path"))
    judged = (outcomes.where("page_id IS NOT NULL AND bad IS NOT NULL").groupBy("page_id")
              .agg(F.max(F.col("bad").cast("long")).alias("bad")))
    counts = (parsed.select("page_id", "host").join(judged, "page_id", "left").groupBy("host")
              .agg(F.coalesce(F.sum("bad"), F.lit(0)).alias("k"), F.count("bad").alias("n")))
    counts = Scratch(pages.sparkSession).write(counts, "hosts")
    if bad_share is None:
        k, n = counts.agg(F.sum("k"), F.sum("n")).first()
        bad_share = k / n if n else 1.0
    reputation = host_reputation(counts, suffixes, z)
    rule = matching_rule([*block, *allow])
    by_rule = F.when(F.col("rule").isin(*allow), "allow").when(F.col("rule").isNotNull(), "block")
    by_host = F.when(F.col("bad_low") > bad_share, "block").otherwise("allow")
    return parsed.withColumn("rule", rule).join(reputation, "host", "left").select(
        "page_id", "host", "path", "rule", F.coalesce(by_rule, by_host).alias("verdict"), "bad_low")
