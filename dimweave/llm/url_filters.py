"""URL filters: pattern rules indexed by their rarest literal token. [native]

Every rule names the literal tokens it cannot match without.  The token that
is rarest over all URLs becomes the rule's index entry; a URL's own tokens
fetch candidate rules by a hash join, and only candidates run their regular
expression.  Built-in functions only.

Rules are judged over distinct URLs, so repeated URLs are judged once and a
hot host is spread by its paths.

Defined results: a null or empty URL, or one without ``://``, has empty host
and path, fits no rule and is allowed; repeated rows give repeated rows; an
empty table gives an empty table; columns other than the named ones pass by.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import ascii_lower, table

#: Rules beyond this many are joined by a shuffle instead of a broadcast.
BROADCAST_RULES = 50_000


@dataclass(frozen=True)
class Rule:
    """A URL rule.  `pattern` (Java syntax) runs on ``host + path``; `tokens`
    are lower-case literals that every match contains as whole tokens.  The
    longest `name` wins among rules of the same `rank`, lower ranks first."""

    name: str
    verdict: str
    pattern: str
    tokens: tuple[str, ...]
    rank: int = 0


def site_rule(verdict: str, site: str) -> Rule:
    """A rule ``host/path``: fits the host, all subdomains and every path that starts with the given one."""
    host, _, path = site.partition("/")
    # the path's last token may go on in the URL, so only tokens closed by a separator are literal tokens
    closed = re.split(r"[^a-z0-9]+", path.lower())[:-1]
    tokens = tuple(t for t in [*re.split(r"[^a-z0-9]+", host.lower()), *closed] if t)
    return Rule(site, verdict, rf"^([^/]*\.)?{re.escape(host)}{re.escape('/' + path)}", tokens)


#: The production rules: sites first (rank 0), then words that stand for unwanted hosts.
SITE_RULES = (
    site_rule("block", "com/en/"),
    site_rule("allow", "example.com/en/7"),
    site_rule("allow", "net/de/"),
    site_rule("block", "example.net/de/8"),
    site_rule("block", "org/es/"),
)
WORD_RULES = tuple(
    Rule(f"word:{w}", "block", rf"^[^/]*\b{w}\b", (w,), rank=1) for w in ("adult", "porn", "xxx", "casino", "betting", "escort", "viagra", "torrent", "malware", "phishing")
)


def url_host(url: Column) -> Column:
    """After the first ``://`` up to ``/``, ``?``, ``#`` or the end, A-Z lower-cased; empty without ``://``."""
    return F.coalesce(ascii_lower(F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1)), F.lit(""))


def url_path(url: Column) -> Column:
    """What follows the host, up to ``?``, ``#`` or the end; empty without ``://``."""
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def _rules_frame(spark: SparkSession, rules: tuple[Rule, ...]) -> DataFrame:
    rows = [(r.name, r.verdict, r.pattern, r.rank, t) for r in rules for t in sorted(set(r.tokens))]
    return spark.createDataFrame(rows, "rule string, verdict string, pattern string, rank int, token string")


def judge_urls(pages: DataFrame, rules: tuple[Rule, ...], url: str = "url") -> DataFrame:
    """(url, host, path, rule, rank, verdict) for each distinct URL of `pages`; rule is null where none fits."""
    if bad := [r.name for r in rules if not r.tokens]:
        raise ValueError(f"rules without a literal token can't be indexed: {bad}")
    spark = pages.sparkSession
    urls = pages.select(F.col(url).alias("url")).distinct().select("url", url_host(F.col("url")).alias("host"), url_path(F.col("url")).alias("path"))
    urls = urls.withColumn("site", F.concat("host", "path"))
    entries = _rules_frame(spark, rules)
    small = (lambda d: F.broadcast(d)) if len(rules) <= BROADCAST_RULES else (lambda d: d)
    tokens = urls.select("url", "site", F.explode(F.array_distinct(F.filter(F.split(ascii_lower(F.col("site")), "[^a-z0-9]+"), lambda t: t != ""))).alias("token"))
    # how many URLs hold each literal of the rules; the rarest is the rule's index entry
    held = tokens.join(small(entries.select("token").distinct()), "token").groupBy("token").agg(F.count("*").alias("held"))
    index = (
        entries.join(held, "token", "left")
        .groupBy("rule", "verdict", "pattern", "rank")
        .agg(F.min_by("token", F.struct(F.coalesce("held", F.lit(0)), -F.length("token"), "token")).alias("token"))
    )
    fits = tokens.join(small(index), "token").where(F.expr("site rlike pattern"))
    best = fits.groupBy("url").agg(F.max_by(F.struct("rule", "rank", "verdict"), F.struct(-F.col("rank"), F.length("rule"), "rule")).alias("best"))
    return urls.join(best, "url", "left").select("url", "host", "path", "best.rule", "best.rank", F.coalesce("best.verdict", F.lit("allow")).alias("verdict"))


def filter_urls(pages: DataFrame, rules: tuple[Rule, ...] = SITE_RULES + WORD_RULES, url: str = "url", key: str = "page_id") -> DataFrame:
    """(key, host, path, rule, verdict, method) for each row of `pages`.

    rule: the site rule that decides, else null; method: the word rule that
    decides where no site rule fits.  verdict: allow or block.
    """
    judged = judge_urls(pages, rules, url).withColumnRenamed("url", "judged_url")
    return pages.select(F.col(key), F.col(url).alias("url_")).join(judged, F.col("url_").eqNullSafe(F.col("judged_url")), "left").select(
        key, "host", "path", F.when(F.col("rank") == 0, F.col("rule")).alias("rule"), "verdict", F.when(F.col("rank") > 0, F.col("rule")).alias("method")
    )


def op10_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return filter_urls(table(spark, sf_dir, "pages"))


def _sql() -> str:
    hits = ",\n".join(
        "({}, {}, {}, {})".format(*(f"'{x}'" if isinstance(x, str) else x for x in (r.name, r.verdict, r.pattern, r.rank))) for r in SITE_RULES + WORD_RULES
    )
    lower = "translate({}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
    return f"""
WITH rules(name, v, pattern, rank) AS (VALUES {hits}),
u AS (SELECT DISTINCT url,
  coalesce({lower.format("regexp_extract(url, '(?s)^.*?://([^/?#]*)', 1)")}, '') AS host,
  coalesce(regexp_extract(url, '(?s)^.*?://[^/?#]*([^?#]*)', 1), '') AS path FROM pages),
f AS (SELECT url, name, v, rank, row_number() OVER (PARTITION BY url ORDER BY rank, length(name) DESC, name DESC) AS n
  FROM u JOIN rules ON regexp_matches(host || path, pattern)),
j AS (SELECT u.*, f.name, f.v, f.rank FROM u LEFT JOIN f ON u.url = f.url AND n = 1)
SELECT page_id, host, path, CASE WHEN rank = 0 THEN name END AS rule, coalesce(v, 'allow') AS verdict,
  CASE WHEN rank > 0 THEN name END AS method
FROM pages LEFT JOIN j ON pages.url IS NOT DISTINCT FROM j.url"""


QUERIES = {"op10_url_filters": op10_url_filters}
ORACLE = {"op10_url_filters": _sql()}
