"""URL filter: exact host and path rules first, then empirical-Bayes host reputation.

Labelled page outcomes are counted for hosts, registered domains and suffixes. Each level's rate is drawn to the one
above it by a beta prior whose strength is estimated from how far the level's rates spread beyond chance. A host is
blocked when the upper bound of its posterior lies below one half. DataFrame functions only.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .runtime import cut

#: (verdict, host, path); a rule fits its host and all subdomains, and paths that start with its own
RULES = (("allow", "com", "/"), ("block", "example.com", "/en/"), ("allow", "www.example.com", "/en/"), ("block", "net", "/es/"), ("block", "net", "/fr/"))
#: Public suffixes of two labels.
TWO_LABELS = ("ac.uk", "co.jp", "co.nz", "co.uk", "com.au", "com.br", "com.cn", "gov.uk", "org.uk")
Z = 1.645
LEVEL = 0.5
LEAST, MOST, UNKNOWN = 1.0, 1000.0, 10.0


def lower_ascii(c):
    return F.translate(c, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def parts(pages: DataFrame, page_id: str = "page_id", url: str = "url") -> DataFrame:
    """page_id, host, path; both empty for a null url or one without `://`."""
    u = F.col(url)
    at = F.instr(u, "://")
    rest = F.when(at > 0, F.substring(u, at + 3, F.length(u))).otherwise(F.lit(""))
    before = F.substring_index(F.substring_index(F.coalesce(rest, F.lit("")), "#", 1), "?", 1)  # up to the first ? or #
    host = F.substring_index(before, "/", 1)
    return pages.select(F.col(page_id).alias("page_id"), lower_ascii(host).alias("host"), F.substring(before, F.length(host) + 1, F.length(before)).alias("path"))


def ruled(rows: DataFrame, rules=RULES) -> DataFrame:
    """Adds rule and rule_verdict: those of the longest rule that fits, else null."""
    rule, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for v, host, path in sorted(rules, key=lambda r: len(r[1] + r[2])):
        fits = ((F.col("host") == host) | F.col("host").endswith("." + host)) & F.col("path").startswith(path)
        rule, verdict = F.when(fits, F.lit(host + path)).otherwise(rule), F.when(fits, F.lit(v)).otherwise(verdict)
    return rows.withColumn("rule", rule).withColumn("rule_verdict", verdict)


def strength(level: DataFrame) -> float:
    """Prior strength from the counts n, k of a level's members, by the moments of their rates."""
    r = level.where("n > 0").agg(F.count("*").alias("g"), F.sum("n").alias("n"), F.sum("k").alias("k"), F.sum(F.col("k") * F.col("k") / F.col("n")).alias("kk"), F.sum(F.col("n").cast("double") * F.col("n")).alias("nn")).first()
    if not r["n"] or r["g"] < 2 or r["k"] in (0, r["n"]):
        return UNKNOWN
    p = r["k"] / r["n"]
    spread, chance = r["kk"] - r["n"] * p * p, p * (1 - p)
    rho = (spread - chance * (r["g"] - 1)) / (chance * (r["n"] - r["nn"] / r["n"] - (r["g"] - 1)) or 1.0)
    return min(MOST, max(LEAST, (1 - rho) / rho)) if rho > 0 else MOST


def reputation(outcomes: DataFrame) -> DataFrame:
    """host, rate, upper of every host of outcomes (host, good: true, false, or null where a page has no label)."""
    hosts = outcomes.groupBy("host").agg(F.count("good").alias("n"), F.count_if("good").alias("k"))
    bare = F.split("host", ":")[0]
    label = F.split(bare, r"\.")
    two = F.substring_index(bare, ".", -2)
    suffix = F.when(two.isin(*TWO_LABELS), two).otherwise(F.substring_index(bare, ".", -1))
    domain = F.when(two.isin(*TWO_LABELS) & (F.size(label) > 2), F.substring_index(bare, ".", -3)).otherwise(two)
    hosts = cut(hosts.withColumn("suffix", suffix).withColumn("domain", domain))
    domains = hosts.groupBy("suffix", "domain").agg(F.sum("n").alias("n"), F.sum("k").alias("k"))
    suffixes = domains.groupBy("suffix").agg(F.sum("n").alias("n"), F.sum("k").alias("k"))
    total = suffixes.agg(F.sum("n").alias("n"), F.sum("k").alias("k")).first()
    root = ((total["k"] or 0) + 1.0) / ((total["n"] or 0) + 2.0)
    drawn = lambda above, m: (F.col("k") + m * above) / (F.col("n") + m)
    suffixes = suffixes.select("suffix", drawn(F.lit(root), strength(suffixes)).alias("suffix_rate"))
    domains = domains.join(suffixes, "suffix").select("suffix", "domain", drawn(F.col("suffix_rate"), strength(domains)).alias("domain_rate"))
    m = strength(hosts)
    found = hosts.join(domains, ["suffix", "domain"]).withColumn("rate", drawn(F.col("domain_rate"), m))
    sd = F.sqrt(F.col("rate") * (1 - F.col("rate")) / (F.col("n") + m + 1))
    return found.select("host", "rate", (F.col("rate") + Z * sd).alias("upper"))


def filter_urls(pages: DataFrame, page_id: str = "page_id", url: str = "url", rules=RULES) -> DataFrame:
    """page_id, host, path, rule, verdict for each row of pages.

    The pages that a rule decides are the labelled outcomes of their hosts (allowed: good). The rule's verdict stands
    for these; others take block if their host's upper posterior bound is under one half, else allow. A null url has an
    empty host, which is a host like any other. Repeated rows stay and count again. An empty table gives no rows.
    """
    rows = ruled(parts(pages, page_id, url), rules)
    rates = reputation(rows.select("host", (F.col("rule_verdict") == "allow").alias("good")))
    by_host = F.when(F.col("upper") < LEVEL, F.lit("block")).otherwise(F.lit("allow"))
    return rows.join(rates.withColumnRenamed("host", "of"), F.col("host") == F.col("of")).select("page_id", "host", "path", "rule", F.coalesce("rule_verdict", by_host).alias("verdict"))


_MOMENTS = """(
  SELECT CASE WHEN n IS NULL OR n = 0 OR g < 2 OR k = 0 OR k = n THEN 10.0
              WHEN rho > 0 THEN least(1000.0, greatest(1.0, (1 - rho) / rho)) ELSE 1000.0 END
  FROM (SELECT *, (kk - n * (k / n) * (k / n) - (k / n) * (1 - k / n) * (g - 1)) / nullif((k / n) * (1 - k / n) * (n - nn / n - (g - 1)), 0) AS rho
        FROM (SELECT count(*)::DOUBLE AS g, sum(n)::DOUBLE AS n, sum(k)::DOUBLE AS k, sum(k::DOUBLE * k / n) AS kk, sum(n::DOUBLE * n) AS nn FROM {0} WHERE n > 0)))"""

SQL = rf"""
WITH u AS (SELECT page_id, CASE WHEN position('://' IN url) > 0 THEN substr(url, position('://' IN url) + 3) ELSE '' END AS rest FROM pages),
p AS (SELECT page_id, translate(regexp_extract(rest, '^([^/?#]*)([^?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
             regexp_extract(rest, '^([^/?#]*)([^?#]*)', 2) AS path FROM u),
r AS (SELECT *, CASE
        WHEN (host = 'www.example.com' OR ends_with(host, '.www.example.com')) AND starts_with(path, '/en/') THEN 'www.example.com/en/'
        WHEN (host = 'example.com' OR ends_with(host, '.example.com')) AND starts_with(path, '/en/') THEN 'example.com/en/'
        WHEN (host = 'net' OR ends_with(host, '.net')) AND starts_with(path, '/es/') THEN 'net/es/'
        WHEN (host = 'net' OR ends_with(host, '.net')) AND starts_with(path, '/fr/') THEN 'net/fr/'
        WHEN (host = 'com' OR ends_with(host, '.com')) AND starts_with(path, '/') THEN 'com/' END AS rule FROM p),
v AS (SELECT *, CASE WHEN rule IN ('com/', 'www.example.com/en/') THEN 'allow' WHEN rule IS NOT NULL THEN 'block' END AS said FROM r),
h AS (SELECT host, count(said)::DOUBLE AS n, count(CASE WHEN said = 'allow' THEN 1 END)::DOUBLE AS k,
             regexp_extract(split_part(host, ':', 1), '[^.]*$') AS one,
             regexp_extract(split_part(host, ':', 1), '([^.]*\.)?[^.]*$') AS two,
             regexp_extract(split_part(host, ':', 1), '([^.]*\.)?([^.]*\.)?[^.]*$') AS three FROM v GROUP BY host),
hh AS (SELECT host, n, k, CASE WHEN two IN {TWO_LABELS!r} THEN two ELSE one END AS suffix,
              CASE WHEN two IN {TWO_LABELS!r} THEN three ELSE two END AS domain FROM h),
dd AS (SELECT suffix, domain, sum(n) AS n, sum(k) AS k FROM hh GROUP BY suffix, domain),
ss AS (SELECT suffix, sum(n) AS n, sum(k) AS k FROM dd GROUP BY suffix),
root AS (SELECT (coalesce(sum(k), 0) + 1.0) / (coalesce(sum(n), 0) + 2.0) AS rate FROM ss),
s2 AS (SELECT suffix, (k + m * (SELECT rate FROM root)) / (n + m) AS rate FROM (SELECT *, {_MOMENTS.format("ss")} AS m FROM ss)),
d2 AS (SELECT d.suffix, d.domain, (k + m * s2.rate) / (n + m) AS rate FROM (SELECT *, {_MOMENTS.format("dd")} AS m FROM dd) d JOIN s2 ON d.suffix = s2.suffix),
h2 AS (SELECT h.host, (k + m * d2.rate) / (n + m) AS rate, n + m + 1 AS size FROM (SELECT *, {_MOMENTS.format("hh")} AS m FROM hh) h JOIN d2 ON h.suffix = d2.suffix AND h.domain = d2.domain)
SELECT v.page_id, v.host, v.path, v.rule,
       coalesce(v.said, CASE WHEN h2.rate + 1.645 * sqrt(h2.rate * (1 - h2.rate) / h2.size) < 0.5 THEN 'block' ELSE 'allow' END) AS verdict
FROM v JOIN h2 ON v.host = h2.host
"""
