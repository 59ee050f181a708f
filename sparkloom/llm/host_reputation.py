"""URL filter: explicit rules first, then an empirical-Bayes reputation of the host.

Labelled page outcomes are counted per host, registered domain and public suffix.
Each level has a beta prior: its mean is the posterior mean of the level above (at
the top the overall share of bad pages), its strength is fitted to that level's
spread by the method of moments. A host is blocked where even the lower bound of
its posterior share of bad pages exceeds ``THRESHOLD``.

Only DataFrame functions are used. Three numbers a level come to the driver.

Defined results: a null url, or one without ``://``, has an empty host and path; such
pages share the host ''. A host without labels has its domain's prior. Without any
label no host is blocked. Outcomes that are null, or of pages that aren't there, don't
count; of several outcomes for a page the worst counts. Pages that share a page_id
keep a row each. A null page_id has no outcome. An empty table gives an empty result.
Columns other than id and url are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ._shared import column, join_counted, staged, table

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
URL = r"(?s)^.*?://([^/?#]*)([^?#]*)"
#: (verdict, rule); a rule is a host, then the beginning of a path.
RULES = (("allow", "org/"), ("block", "example.org/es/"), ("block", "example.org/en/1"), ("allow", "com/fr/"), ("block", "com/de/"))
#: Second labels under which registries of countries (two letters) give out names; a suffix of two labels has one of them,
#: or is in the parameter ``suffixes``. Any other host's suffix is its last label.
SECOND = ("ac", "co", "com", "edu", "go", "gob", "gouv", "gov", "mil", "ne", "net", "nom", "or", "org")
SUFFIXES = ()
#: Standard deviations below the posterior mean, and the share of bad pages that blocks.
Z, THRESHOLD = 1.645, 0.5
WEAKEST, STRONGEST = 1.0, 1000.0


def host(url: Column) -> Column:
    return F.translate(F.regexp_extract(F.coalesce(url, F.lit("")), URL, 1), UPPER, LOWER)


def path(url: Column) -> Column:
    return F.regexp_extract(F.coalesce(url, F.lit("")), URL, 2)


def rule_column(at_host: Column, at_path: Column, rules=RULES) -> tuple[Column, Column]:
    """The longest rule that fits and its verdict; both null if none does."""
    rule = verdict = None
    for what, text in sorted(rules, key=lambda r: (len(r[1]), r[1]), reverse=True):
        rule_host, slash, rest = text.partition("/")
        fits = ((at_host == rule_host) | at_host.endswith("." + rule_host)) & at_path.startswith(slash + rest)
        rule = F.when(fits, text) if rule is None else rule.when(fits, text)
        verdict = F.when(fits, what) if verdict is None else verdict.when(fits, what)
    return (F.lit(None).cast("string"),) * 2 if rule is None else (rule, verdict)


def domain_and_suffix(host: Column, suffixes=SUFFIXES) -> tuple[Column, Column]:
    """Registered domain and public suffix, without user name and port; an address in numbers is its own."""
    name = F.regexp_replace(F.regexp_replace(host, "^.*@", ""), ":[0-9]*$", "")
    labels = F.split(name, r"\.")
    last_two = F.concat_ws(".", F.slice(labels, F.greatest(F.size(labels) - 1, F.lit(1)), 2))
    two = last_two.rlike(rf"^({'|'.join(SECOND)})\.[a-z][a-z]$")
    of_suffix = F.when(two | last_two.isin(*suffixes) if suffixes else two, 2).otherwise(1)
    number = name.rlike(r"^[0-9]+(\.[0-9]+){3}$")
    tail = lambda n: F.when(number, name).otherwise(F.concat_ws(".", F.slice(labels, F.greatest(F.size(labels) - n + 1, F.lit(1)), n)))
    return tail(of_suffix + 1), tail(of_suffix)


def _moments(groups: DataFrame) -> Column:
    """n, bad, groups with labels, and the sum of bad * bad / n, as one struct."""
    return groups.filter("n > 0").agg(F.sum("n").alias("n"), F.sum("bad").alias("bad"), F.count(F.lit(1)).alias("k"), F.sum(F.col("bad") * F.col("bad") / F.col("n")).alias("s"))


def strength(n: int, bad: int, k: int, s: float) -> float:
    """The beta prior's weight, in pages, that explains how the groups' shares spread."""
    share = bad / n
    binomial = share * (1 - share)
    spread = s / n - share * share
    beyond = spread - binomial * k / n
    return STRONGEST if beyond <= 0 else round(min(STRONGEST, max(WEAKEST, (binomial - spread) / beyond)), 6)


def reputations(pages: DataFrame, outcomes: DataFrame, suffixes=SUFFIXES) -> DataFrame:
    """(host, n_pages, n, bad, mean, low) of every host of ``pages`` (page_id, host); ``outcomes`` is (page_id, bad 0 or 1)."""
    worst = outcomes.filter("bad IS NOT NULL").groupBy("page_id").agg(F.max("bad").alias("bad"))
    labelled = pages.filter("page_id IS NOT NULL").join(worst, "page_id").select("host", "bad", F.lit(0).alias("page"))
    seen = pages.select("host", F.lit(None).cast("int").alias("bad"), F.lit(1).alias("page"))
    counted = seen.unionAll(labelled).groupBy("host").agg(F.sum("page").alias("n_pages"), F.count("bad").alias("n"), F.coalesce(F.sum("bad"), F.lit(0)).cast("long").alias("bad"))
    domain, suffix = domain_and_suffix(F.col("host"), suffixes)
    hosts = staged(counted.select("host", "n_pages", domain.alias("domain"), suffix.alias("suffix"), "n", "bad"), "hosts")
    domains = staged(hosts.groupBy("domain", "suffix").agg(F.sum("n").alias("n"), F.sum("bad").alias("bad")), "domains")
    suffixes = staged(domains.groupBy("suffix").agg(F.sum("n").alias("n"), F.sum("bad").alias("bad")), "suffixes")
    rows = [_moments(level).first() for level in (hosts, domains, suffixes)]
    strengths = [strength(*r) if r["n"] else STRONGEST for r in rows]
    overall = rows[0]["bad"] / rows[0]["n"] if rows[0]["n"] else 0.0

    def mean(prior, weight: float) -> Column:
        return (prior * weight + F.col("bad")) / (F.lit(weight) + F.col("n"))

    suffixes = suffixes.select("suffix", mean(F.lit(overall), strengths[2]).alias("suffix_mean"))
    domains = staged(domains.join(suffixes, "suffix").select("domain", mean(F.col("suffix_mean"), strengths[1]).alias("domain_mean")), "domainmeans")
    weight = strengths[0]
    posterior = hosts.join(domains, "domain").withColumn("mean", mean(F.col("domain_mean"), weight))
    deviation = F.sqrt(F.col("mean") * (1 - F.col("mean")) / (F.lit(weight) + F.col("n") + 1))
    return staged(posterior.select("host", "n_pages", "n", "bad", "mean", (F.col("mean") - Z * deviation).alias("low")), "reputations")


def judge(pages: DataFrame, outcomes: DataFrame, rules=RULES, id_col: str = "page_id", url_col: str = "url", suffixes=SUFFIXES) -> DataFrame:
    """(page_id, host, path, rule, verdict, host_labelled, host_bad) for every row of ``pages``."""
    parsed = pages.select(column(id_col).alias("page_id"), host(column(url_col)).alias("host"), path(column(url_col)).alias("path"))
    known = reputations(parsed.select("page_id", "host"), outcomes, suffixes)
    rule, by_rule = rule_column(F.col("host"), F.col("path"), rules)
    by_method = F.when(F.col("low") > THRESHOLD, "block").otherwise("allow")
    return join_counted(parsed, known, "host", "n_pages").select(
        "page_id", "host", "path", rule.alias("rule"), F.coalesce(by_rule, by_method).alias("verdict"), F.col("n").alias("host_labelled"), F.col("bad").alias("host_bad")
    )


def op7_host_reputation(spark: SparkSession, sf_dir: str) -> DataFrame:
    labels = table(spark, sf_dir, "labels").select(F.col("doc_id").alias("page_id"), F.when((F.col("quality") == 0) | (F.col("toxic") == 1), 1).otherwise(0).alias("bad"))
    return judge(table(spark, sf_dir, "pages"), labels)


QUERIES = {"op7_host_reputation": op7_host_reputation}
ORACLES = {
    "op7_host_reputation": r"""
WITH p AS (
  SELECT page_id, translate(regexp_extract(coalesce(url, ''), '(?s)^.*?://([^/?#]*)([^?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
    regexp_extract(coalesce(url, ''), '(?s)^.*?://([^/?#]*)([^?#]*)', 2) AS path FROM pages
), o AS (
  SELECT doc_id AS page_id, max(CASE WHEN quality = 0 OR toxic = 1 THEN 1 ELSE 0 END) AS bad FROM labels GROUP BY doc_id
), h0 AS (
  SELECT host, count(bad) AS n, coalesce(sum(bad), 0) AS bad FROM p LEFT JOIN o USING (page_id) GROUP BY host
), h1 AS (
  SELECT *, string_split(name, '.') AS l FROM (SELECT *, regexp_replace(regexp_replace(host, '^.*@', ''), ':[0-9]*$', '') AS name FROM h0)
), h2 AS (
  SELECT *, CASE WHEN regexp_matches(array_to_string(l[-2:], '.'), '^(ac|co|com|edu|go|gob|gouv|gov|mil|ne|net|nom|or|org)\.[a-z][a-z]$') THEN 2 ELSE 1 END AS k,
    regexp_matches(name, '^[0-9]+(\.[0-9]+){3}$') AS number FROM h1
), h AS (
  SELECT host, n, bad, CASE WHEN number THEN name ELSE array_to_string(CASE k WHEN 2 THEN l[-3:] ELSE l[-2:] END, '.') END AS domain,
    CASE WHEN number THEN name ELSE array_to_string(CASE k WHEN 2 THEN l[-2:] ELSE l[-1:] END, '.') END AS suffix FROM h2
), d AS (
  SELECT domain, suffix, sum(n) AS n, sum(bad) AS bad FROM h GROUP BY ALL
), s AS (
  SELECT suffix, sum(n) AS n, sum(bad) AS bad FROM d GROUP BY suffix
), m AS (
  SELECT 'h' AS level, sum(n) AS n, sum(bad) AS b, count(*) AS k, sum(bad * bad / n) AS s FROM h WHERE n > 0
  UNION ALL SELECT 'd', sum(n), sum(bad), count(*), sum(bad * bad / n) FROM d WHERE n > 0
  UNION ALL SELECT 's', sum(n), sum(bad), count(*), sum(bad * bad / n) FROM s WHERE n > 0
), v AS (
  SELECT level, b / n AS share, (b / n) * (1 - b / n) AS binomial, s / n - (b / n) * (b / n) AS spread, k / n AS per FROM m
), w AS (
  SELECT level, share, CASE WHEN share IS NULL OR spread - binomial * per <= 0 THEN 1000.0::DOUBLE
    ELSE round(least(1000.0::DOUBLE, greatest(1.0::DOUBLE, (binomial - spread) / (spread - binomial * per))), 6) END AS strength FROM v
), sm AS (
  SELECT suffix, (coalesce(share, 0) * strength + bad) / (strength + n) AS sm FROM s, w WHERE level = 's'
), dm AS (
  SELECT domain, (sm * strength + bad) / (strength + n) AS dm FROM d JOIN sm USING (suffix), w WHERE level = 'd'
), hm AS (
  SELECT host, n, bad, strength, (dm * strength + bad) / (strength + n) AS mean FROM h JOIN dm USING (domain), w WHERE level = 'h'
), rep AS (
  SELECT host, n, bad, mean - 1.645 * sqrt(mean * (1 - mean) / (strength + n + 1)) AS low FROM hm
), r AS (
  SELECT page_id, host, path, n, bad, low,
    CASE WHEN (host = 'example.org' OR ends_with(host, '.example.org')) AND starts_with(path, '/en/1') THEN 'example.org/en/1'
      WHEN (host = 'example.org' OR ends_with(host, '.example.org')) AND starts_with(path, '/es/') THEN 'example.org/es/'
      WHEN (host = 'com' OR ends_with(host, '.com')) AND starts_with(path, '/fr/') THEN 'com/fr/'
      WHEN (host = 'com' OR ends_with(host, '.com')) AND starts_with(path, '/de/') THEN 'com/de/'
      WHEN (host = 'org' OR ends_with(host, '.org')) AND starts_with(path, '/') THEN 'org/' END AS rule
  FROM p JOIN rep USING (host)
)
SELECT page_id, host, path, rule,
  CASE WHEN rule IN ('org/', 'com/fr/') THEN 'allow' WHEN rule IS NOT NULL THEN 'block' WHEN low > 0.5 THEN 'block' ELSE 'allow' END AS verdict,
  n::BIGINT AS host_labelled, bad::BIGINT AS host_bad FROM r
"""
}
