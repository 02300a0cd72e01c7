"""URL filter: path rules, and beyond them empirical-Bayes reputations of hosts.

Page outcomes (1: the labels call the page's document bad) are counted by host, registered domain
(the last two labels) and suffix (the last). The beta-binomial prior of a suffix is centred on the overall rate, that
of a domain on its suffix's posterior mean, that of a host on its domain's; each level's strength is the
method-of-moments estimate from how much the rates of its members differ. A host is blocked where
the lower bound of its posterior (mean less ``Z`` deviations) exceeds ``LIMIT``.

A page's label is that of the document its url ends in (``/<lang>/<doc_id>``). Null urls and those
without ``://`` have an empty host and path; pages without a label count for nothing but get
their host's verdict. A host without labelled pages is judged as one of none under its domain's posterior mean, which
without labelled pages is its suffix's, or else the overall rate. Repeated pages are counted and judged as often as they occur. Without any labels nothing is blocked beyond the rules.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ._tables import lower_ascii, written

#: (host, path, verdict); the longest that fits decides.
RULES = [("net", "/", "block"), ("example.net", "/en/", "allow"), ("example.com", "/de/", "block"), ("org", "/fr/", "allow")]
LIMIT = 0.5
Z = 1.645
LEAST_STRENGTH, MOST_STRENGTH = 1.0, 1000.0

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def _parts(pages: DataFrame) -> DataFrame:
    url = F.coalesce("url", F.lit(""))
    host = lower_ascii(F.regexp_extract(url, "://([^/?#]*)", 1))
    split = pages.select("page_id", host.alias("host"), F.regexp_extract(url, "://[^/?#]*([^?#]*)", 1).alias("path"))
    return split.withColumn("domain", F.substring_index("host", ".", -2)).withColumn("suffix", F.substring_index("host", ".", -1))


def _rule(rules: list[tuple[str, str, str]], value) -> Column:
    """value(host, path, verdict) of the longest rule that fits; null where none does."""
    out = F.lit(None).cast("string")
    for host, path, verdict in sorted(rules, key=lambda r: len(r[0] + r[1])):
        fits = ((F.col("host") == host) | F.col("host").endswith("." + host)) & F.col("path").startswith(path)
        out = F.when(fits, F.lit(value(host, path, verdict))).otherwise(out)
    return out


def _strength(level: DataFrame) -> DataFrame:
    """One row: pseudo-counts of a level's prior, from members (n, bad)."""
    sums = level.where("n > 0").agg(F.sum("n").alias("m"), F.sum("bad").alias("b"), F.count("*").alias("k"), F.sum(F.col("n") * F.col("n")).alias("q"), F.sum(F.col("bad") * F.col("bad") / F.col("n")).alias("r"))
    p = F.col("b") / F.col("m")
    v = p * (1 - p)
    between = F.col("r") - F.col("b") * p - v * (F.col("k") - 1)
    rho = F.try_divide(between, v * (F.col("m") - F.col("q") / F.col("m") - (F.col("k") - 1)))
    strength = F.when(rho > 0, F.least(F.lit(MOST_STRENGTH), F.greatest(F.lit(LEAST_STRENGTH), 1 / rho - 1))).otherwise(MOST_STRENGTH)
    return sums.where("m > 0").select(p.alias("rate"), strength.alias("strength"))


def reputations(pages: DataFrame, outcomes: DataFrame) -> DataFrame:
    """host and the lower bound of its rate of bad pages, for every host of the pages, or none without outcomes; ``outcomes(page_id, bad)``."""
    found = _parts(pages).join(outcomes.select("page_id", "bad"), "page_id", "left")
    hosts = written(found.groupBy("host", "domain", "suffix").agg(F.count("bad").cast("double").alias("n"), F.coalesce(F.sum("bad"), F.lit(0)).cast("double").alias("bad")), "hosts")
    domains = hosts.groupBy("domain", "suffix").agg(F.sum("n").alias("n"), F.sum("bad").alias("bad"))
    suffixes = domains.groupBy("suffix").agg(F.sum("n").alias("n"), F.sum("bad").alias("bad"))
    shrunk = lambda prior: (F.col("bad") + F.col("strength") * prior) / (F.col("n") + F.col("strength"))
    # The strengths are one row each.
    top = suffixes.crossJoin(F.broadcast(_strength(suffixes))).select("suffix", shrunk(F.col("rate")).alias("of_suffix"))
    mid = domains.join(top, "suffix").crossJoin(F.broadcast(_strength(domains))).select("domain", shrunk(F.col("of_suffix")).alias("of_domain"))
    low = hosts.join(mid, "domain").crossJoin(F.broadcast(_strength(hosts)))
    mean = shrunk(F.col("of_domain"))
    return low.select("host", (mean - Z * F.sqrt(mean * (1 - mean) / (F.col("n") + F.col("strength") + 1))).alias("bound"))


def labelled_outcomes(pages: DataFrame, labels: DataFrame) -> DataFrame:
    """``(page_id, bad)`` from labels of the documents the urls name: bad if the quality is 0."""
    known = labels.where(F.col("doc_id").isNotNull() & F.col("quality").isNotNull()).groupBy(F.col("doc_id").cast("long").alias("doc")).agg(F.max("quality").alias("quality"))
    named = _parts(pages).select("page_id", F.expr("try_cast(nullif(regexp_extract(path, '^/[^/]+/([0-9]+)', 1), '') as bigint)").alias("doc")).where("doc is not null").distinct()
    return named.join(known, "doc").groupBy("page_id").agg(F.max(F.when(F.col("quality") == 0, 1).otherwise(0)).alias("bad"))


def judge(pages: DataFrame, labels: DataFrame, rules: list[tuple[str, str, str]] = RULES, limit: float = LIMIT) -> DataFrame:
    """Per page: page_id, host, path, rule (null where none fits), verdict."""
    bounds = reputations(pages, labelled_outcomes(pages, labels))
    judged = _parts(pages).join(bounds, "host", "left")
    own = F.when(F.coalesce("bound", F.lit(0.0)) > limit, "block").otherwise("allow")
    return judged.select("page_id", "host", "path", _rule(rules, lambda h, p, v: h + p).alias("rule"), F.coalesce(_rule(rules, lambda h, p, v: v), own).alias("verdict"))


def _case(value) -> str:
    fits = lambda h, p: f"(host = '{h}' OR ends_with(host, '.{h}')) AND starts_with(path, '{p}')"
    return "CASE " + " ".join(f"WHEN {fits(h, p)} THEN '{value(h, p, v)}'" for h, p, v in sorted(RULES, key=lambda r: -len(r[0] + r[1]))) + " END"


def _strength_sql(level: str) -> str:
    return f"""SELECT rate, CASE WHEN rho > 0 THEN least({MOST_STRENGTH}, greatest({LEAST_STRENGTH}, 1 / rho - 1)) ELSE {MOST_STRENGTH} END AS strength FROM (
    SELECT rate, (r - b * rate - rate * (1 - rate) * (k - 1)) / nullif(rate * (1 - rate) * (m - q / m - (k - 1)), 0) AS rho FROM (
      SELECT sum(n) AS m, sum(bad) AS b, count(*) AS k, sum(n * n) AS q, sum(bad * bad / n) AS r, sum(bad) / sum(n) AS rate FROM {level} WHERE n > 0) WHERE m > 0)"""


ORACLE = f"""
WITH split AS (
  SELECT page_id, translate(regexp_extract(coalesce(url, ''), '://([^/?#]*)', 1), '{_UPPER}', '{_LOWER}') AS host, regexp_extract(coalesce(url, ''), '://[^/?#]*([^?#]*)', 1) AS path FROM pages),
parts AS (SELECT *, array_to_string(list_reverse(list_slice(list_reverse(string_split(host, '.')), 1, 2)), '.') AS domain, list_reverse(string_split(host, '.'))[1] AS suffix FROM split),
named AS (SELECT DISTINCT page_id, TRY_CAST(nullif(regexp_extract(path, '^/[^/]+/([0-9]+)', 1), '') AS BIGINT) AS doc FROM parts),
outcomes AS (SELECT page_id, max(CASE WHEN quality = 0 THEN 1 ELSE 0 END) AS bad FROM named JOIN (SELECT doc_id, max(quality) AS quality FROM labels WHERE quality IS NOT NULL GROUP BY doc_id) l ON doc = doc_id GROUP BY page_id),
hosts AS (SELECT host, domain, suffix, count(bad)::DOUBLE AS n, coalesce(sum(bad), 0)::DOUBLE AS bad FROM parts LEFT JOIN outcomes USING (page_id) GROUP BY ALL),
domains AS (SELECT domain, suffix, sum(n) AS n, sum(bad) AS bad FROM hosts GROUP BY ALL),
suffixes AS (SELECT suffix, sum(n) AS n, sum(bad) AS bad FROM domains GROUP BY ALL),
s1 AS ({_strength_sql("suffixes")}), s2 AS ({_strength_sql("domains")}), s3 AS ({_strength_sql("hosts")}),
top AS (SELECT suffix, (bad + strength * rate) / (n + strength) AS of_suffix FROM suffixes, s1),
mid AS (SELECT domain, (bad + strength * of_suffix) / (n + strength) AS of_domain FROM domains JOIN top USING (suffix), s2),
low AS (SELECT host, n, strength, (bad + strength * of_domain) / (n + strength) AS mean FROM hosts JOIN mid USING (domain), s3),
bounds AS (SELECT host, mean - {Z} * sqrt(mean * (1 - mean) / (n + strength + 1)) AS bound FROM low)
SELECT page_id, host, path, {_case(lambda h, p, v: h + p)} AS rule,
  coalesce({_case(lambda h, p, v: v)}, CASE WHEN coalesce(bound, 0) > {LIMIT} THEN 'block' ELSE 'allow' END) AS verdict
FROM parts LEFT JOIN bounds USING (host)
"""
