"""URL filters: explicit host rules, then empirical-Bayes reputation of hosts.

Labelled pages are binomial outcomes of their host. A host's bad rate is shrunk to its registered domain's,
that to its suffix's, that to the overall rate: each level is a beta prior around its parent's posterior
mean, whose strength is fitted by moments over all groups of the level (beta-binomial overdispersion). A
host is blocked when the lower bound of its posterior, mean less ``z`` standard deviations, is over a limit.

Counts are combined map-side per host, so a host with a third of all pages is one row. Hosts without labels
have their parents' estimate. Rules are a parameter list; the longest that fits wins over the reputation.

A null url, or one without ``://``, has an empty host and path, and is judged like a host of its own. Pages with
null ids count and are answered. Repeated rows count as often as they occur. No labels: nothing is blocked. Extra
columns of pages are ignored. An empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import ascii_lower, hint_small, materialize

#: Suffixes under which names are registered, beyond the last label.
SECOND_LEVEL_SUFFIXES = ("co.uk", "org.uk", "ac.uk", "com.au", "co.jp", "com.br")
Z = 1.645
LIMIT = 0.5


def with_host_and_path(pages: DataFrame, url: str = "url") -> DataFrame:
    at = F.instr(F.col(url), "://")
    rest = F.when(at > 0, F.substr(F.col(url), at + 3)).otherwise(F.lit(""))
    pages = pages.withColumn("rest", F.coalesce(rest, F.lit("")))
    return (
        pages.withColumn("host", ascii_lower(F.regexp_extract("rest", r"^([^/?#]*)", 1)))
        .withColumn("path", F.regexp_extract("rest", r"^[^/?#]*([^?#]*)", 1))
        .drop("rest")
    )


def rule_columns(rules: Sequence[tuple[str, str]]) -> tuple[Column, Column]:
    """(rule, its verdict) of the longest of ``rules`` (verdict, "host/path") that fits host and path; null if none."""
    rule, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for action, text in sorted(rules, key=lambda r: len(r[1])):
        host, _, path = text.partition("/")
        fits = ((F.col("host") == host) | F.col("host").endswith("." + host)) & F.col("path").startswith("/" + path)
        rule, verdict = F.when(fits, text).otherwise(rule), F.when(fits, action).otherwise(verdict)
    return rule, verdict


def with_levels(hosts: DataFrame) -> DataFrame:
    labels = F.split("host", r"\.")
    two = F.array_join(F.slice(labels, F.greatest(F.size(labels) - 1, F.lit(1)), F.lit(2)), ".")
    suffix = F.when(two.isin(*SECOND_LEVEL_SUFFIXES), two).otherwise(F.element_at(labels, -1))
    size = F.size(F.split("suffix", r"\.")) + 1
    domain = F.array_join(F.slice(labels, F.greatest(F.size(labels) - size + 1, F.lit(1)), size), ".")
    return hosts.withColumn("suffix", suffix).withColumn("domain", domain)


def _posterior(groups: DataFrame, key: str) -> DataFrame:
    """Adds alpha and beta of each group (n, bad) around its prior mean ``m``."""
    v = F.col("m") * (1 - F.col("m"))
    fit = groups.agg(
        F.sum(F.when(F.col("n") > 0, F.pow(F.col("bad") - F.col("n") * F.col("m"), 2) / F.col("n") - v)).alias("over"),
        F.sum(v * F.greatest(F.col("n") - 1, F.lit(0))).alias("room"),
    ).select(F.least(F.lit(0.5), F.greatest(F.lit(1e-4), F.coalesce(F.try_divide("over", "room"), F.lit(1e-4)))).alias("rho"))
    strength = 1 / F.col("rho") - 1
    return groups.join(F.broadcast(fit)).select(  # fit is one row
        *groups.columns, (F.col("m") * strength + F.col("bad")).alias("alpha"), ((1 - F.col("m")) * strength + F.col("n") - F.col("bad")).alias("beta")
    )


def reputation(hosts: DataFrame, z: float = Z) -> DataFrame:
    """``(host, mean, lower)`` from ``hosts(host, n, bad)``: labelled and bad pages of every host."""
    mean = (F.col("alpha") / (F.col("alpha") + F.col("beta"))).alias("m")
    hosts = with_levels(hosts)
    overall = hosts.agg(((F.sum("bad") + 0.5) / (F.sum("n") + 1)).alias("m"))

    def level(key: str, parent: DataFrame, on: str | None) -> DataFrame:
        keys = [key] if on is None or on == key else [key, on]
        groups = hosts.groupBy(*keys).agg(F.sum("n").alias("n"), F.sum("bad").alias("bad"))
        groups = groups.join(F.broadcast(parent)) if on is None else groups.join(hint_small(parent), on)
        return _posterior(groups, key)

    suffixes = materialize(level("suffix", overall, None), "suffixes")
    domains = materialize(level("domain", suffixes.select("suffix", mean), "suffix"), "domains")
    found = level("host", domains.select("domain", mean), "domain")
    total = F.col("alpha") + F.col("beta")
    deviation = F.sqrt(F.col("alpha") * F.col("beta") / (total * total * (total + 1)))
    return found.select("host", mean.alias("mean"), (mean - z * deviation).alias("lower"))


def judged(pages: DataFrame, outcomes: DataFrame, rules: Sequence[tuple[str, str]], limit: float = LIMIT, z: float = Z) -> DataFrame:
    """``(page_id, url, host, path, mean, lower, rule, verdict)`` of every page; ``outcomes(page_id, bad)`` are the labelled pages."""
    parsed = with_host_and_path(pages.select("page_id", "url"))
    known = outcomes.groupBy("page_id").agg(F.max("bad").alias("bad"))
    hosts = (
        parsed.select("page_id", "host")
        .join(known, "page_id", "left")
        .groupBy("host")
        .agg(F.count("bad").alias("n"), F.coalesce(F.sum("bad"), F.lit(0)).alias("bad"))
    )
    hosts = materialize(hosts, "hosts")
    scores = hint_small(materialize(reputation(hosts, z), "reputation"))
    rule, action = rule_columns(rules)
    learned = F.when(F.col("lower") > limit, F.lit("block")).otherwise(F.lit("allow"))
    return parsed.join(scores, "host", "left").withColumn("rule", rule).withColumn("verdict", F.coalesce(action, learned))


SQL = """
WITH p AS (SELECT page_id, CASE WHEN strpos(url, '://') > 0 THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS rest FROM pages),
q AS (SELECT page_id, translate(regexp_extract(rest, '^([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
  regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path FROM p),
known AS (SELECT doc_id AS page_id, max(1 - quality) AS bad FROM labels GROUP BY 1),
h AS (SELECT host, count(bad) AS n, coalesce(sum(bad), 0) AS bad FROM q LEFT JOIN known USING (page_id) GROUP BY 1),
parts AS (SELECT host, n, bad, string_split(host, '.') AS l FROM h),
s AS (SELECT *, CASE WHEN array_to_string(l[greatest(len(l) - 1, 1):], '.') IN ('co.uk', 'org.uk', 'ac.uk', 'com.au', 'co.jp', 'com.br')
  THEN array_to_string(l[greatest(len(l) - 1, 1):], '.') ELSE l[-1] END AS suffix FROM parts),
t AS (SELECT host, n, bad, suffix, array_to_string(l[greatest(len(l) - len(string_split(suffix, '.')), 1):], '.') AS domain FROM s),
g0 AS (SELECT (sum(bad) + 0.5) / (sum(n) + 1) AS m FROM t),
g1 AS (SELECT suffix, m, sum(n) AS n, sum(bad) AS bad FROM t, g0 GROUP BY 1, 2),
r1 AS (SELECT least(0.5, greatest(1e-4, coalesce(sum(CASE WHEN n > 0 THEN pow(bad - n * m, 2) / n - m * (1 - m) END) / nullif(sum(m * (1 - m) * greatest(n - 1, 0)), 0), 1e-4))) AS rho FROM g1),
p1 AS (SELECT suffix, (m * (1 / rho - 1) + bad) / (1 / rho - 1 + n) AS m FROM g1, r1),
g2 AS (SELECT domain, suffix, m, sum(n) AS n, sum(bad) AS bad FROM t JOIN p1 USING (suffix) GROUP BY 1, 2, 3),
r2 AS (SELECT least(0.5, greatest(1e-4, coalesce(sum(CASE WHEN n > 0 THEN pow(bad - n * m, 2) / n - m * (1 - m) END) / nullif(sum(m * (1 - m) * greatest(n - 1, 0)), 0), 1e-4))) AS rho FROM g2),
p2 AS (SELECT domain, (m * (1 / rho - 1) + bad) / (1 / rho - 1 + n) AS m FROM g2, r2),
g3 AS (SELECT host, m, n, bad FROM t JOIN p2 USING (domain)),
r3 AS (SELECT least(0.5, greatest(1e-4, coalesce(sum(CASE WHEN n > 0 THEN pow(bad - n * m, 2) / n - m * (1 - m) END) / nullif(sum(m * (1 - m) * greatest(n - 1, 0)), 0), 1e-4))) AS rho FROM g3),
p3 AS (SELECT host, m * (1 / rho - 1) + bad AS a, (1 - m) * (1 / rho - 1) + n - bad AS b FROM g3, r3),
f AS (SELECT host, a / (a + b) - 1.645 * sqrt(a * b / ((a + b) * (a + b) * (a + b + 1))) AS lower FROM p3),
ruled AS (SELECT *, CASE
  WHEN (host = 'example.net' OR host LIKE '%.example.net') AND starts_with(path, '/en/') THEN 'example.net/en/'
  WHEN (host = 'example.com' OR host LIKE '%.example.com') AND starts_with(path, '/de/') THEN 'example.com/de/'
  WHEN (host = 'org' OR host LIKE '%.org') AND starts_with(path, '/fr/') THEN 'org/fr/'
  WHEN (host = 'net' OR host LIKE '%.net') AND starts_with(path, '/') THEN 'net/' END AS rule FROM q LEFT JOIN f USING (host))
SELECT page_id, host, path, rule, CASE rule WHEN 'example.net/en/' THEN 'allow' WHEN 'org/fr/' THEN 'allow' WHEN 'net/' THEN 'block' WHEN 'example.com/de/' THEN 'block'
  ELSE CASE WHEN lower > 0.5 THEN 'block' ELSE 'allow' END END AS verdict FROM ruled
"""
