"""URL verdicts by rules and by empirical-Bayes reputation of hosts.

Labelled page outcomes are counted by host, registered domain and suffix. Each level's
beta prior has its parent's posterior mean and a concentration fitted by moments over the
groups of the level; a page is blocked if its host's rate of bad pages exceeds the rate of all
labelled pages with a posterior probability of SURE or more. All of it is DataFrame operations;
only twelve sums reach the driver.
"""

from __future__ import annotations

from statistics import NormalDist

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .scratch import materialise, table

#: (verdict, host, path); the rule string is host + path.
RULES = [("allow", "com", "/"), ("block", "example.com", "/en/"), ("allow", "www.example.com", "/en/"), ("block", "net", "/es/"), ("block", "net", "/fr/")]
#: Public suffixes of two labels; registered domains below them have three.
TWO_LEVEL = ("co.uk", "org.uk", "ac.uk", "gov.uk", "com.au", "net.au", "org.au", "co.nz", "co.jp", "com.br", "com.cn", "co.in", "co.za", "com.mx", "com.tr")
#: A page is blocked when the lower posterior bound of its host's rate, with probability SURE, exceeds LIMIT times the rate of all pages.
SURE, LIMIT = 0.9, 1.0
#: A host of more than one in HEAVY pages is joined by broadcast, as its rows would all meet in one task.
HEAVY = 1000

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def host_and_path(url: Column) -> tuple[Column, Column]:
    """Host (A-Z lower-cased) and path; both empty for null or without ``://``."""
    at = F.instr(url, "://")
    rest = F.when(at > 0, F.substring(url, at + 3, F.lit(1 << 30))).otherwise("")
    host = F.translate(F.regexp_extract(rest, r"^([^/?#]*)", 1), _UPPER, _LOWER)
    return host, F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1)


def matching_rule(host: Column, path: Column, rules: list[tuple[str, str, str]] = RULES) -> tuple[Column, Column]:
    """Rule string and verdict of the longest rule that fits, else null."""
    rule, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for what, h, p in sorted(rules, key=lambda r: len(r[1] + r[2])):
        fits = ((host == h) | F.endswith(host, F.lit("." + h))) & F.startswith(path, F.lit(p))
        rule, verdict = F.when(fits, h + p).otherwise(rule), F.when(fits, what).otherwise(verdict)
    return rule, verdict


def registered_domain(host: Column) -> Column:
    labels = F.split(host, r"\.")
    n = F.size(labels)
    two = F.array_join(F.slice(labels, F.greatest(n - 1, F.lit(1)), 2), ".")
    three = F.array_join(F.slice(labels, F.greatest(n - 2, F.lit(1)), 3), ".")
    numeric = host.rlike(r"^[0-9.]+(:[0-9]+)?$")
    return F.when(numeric, host).when(two.isin(*TWO_LEVEL), three).otherwise(two)


def suffix(domain: Column) -> Column:
    return F.when(F.instr(domain, ".") > 0, F.regexp_replace(domain, r"^[^.]*\.", "")).otherwise(domain)


def _concentration(k: float, m: float, s2: float, s: float, rate: float) -> float:
    """Of the beta prior, by moments: ``k`` groups, ``m`` pages, sums of squared sizes and of weighted squared errors."""
    over = s / (rate * (1 - rate)) - (k - 1)
    under = m - s2 / m - (k - 1)
    rho = min(max(over / under if under > 0 else 0.0, 0.001), 0.999)
    return 1 / rho - 1


_Z = NormalDist().inv_cdf(SURE)
_LAMBDA = (_Z * _Z - 3) / 6


def beta_bound(a: Column, b: Column) -> Column:
    """The value that a beta variable exceeds with probability SURE, by formula 26.5.22 of Abramowitz and Stegun.

    0 where ``a`` is below 1, where the density is greatest at 0; a ``b`` below 1 counts as 1,
    which lowers the bound.
    """
    b = F.greatest(b, F.lit(1.0))
    p, q = 1 / (2 * a - 1), 1 / (2 * b - 1)
    h = 2 / (p + q)
    w = _Z * F.sqrt(h + _LAMBDA) / h - (q - p) * (_LAMBDA + 5 / 6 - 2 / (3 * h))
    return F.when(a >= 1, a / (a + b * F.exp(2 * w))).otherwise(0.0)


def host_reputation(outcomes: DataFrame) -> DataFrame:
    """``host, domain, suffix, rows, n, bad, mean, lower, rate`` from ``outcomes (host, bad)``.

    Every host counts, with or without labels; ``bad`` is 0, 1 or null (unlabelled), and repeated
    rows count one by one. ``rate`` is that of all labelled rows. Without any label, it and every
    mean are one half. An empty table gives an empty result.
    """
    hosts = outcomes.groupBy("host").agg(F.count("*").alias("rows"), F.count("bad").alias("n"), F.coalesce(F.sum("bad"), F.lit(0)).alias("bad"))
    hosts = hosts.withColumn("domain", registered_domain(F.col("host"))).withColumn("suffix", suffix(F.col("domain")))
    domains = hosts.groupBy("domain", "suffix").agg(F.sum("n").alias("dn"), F.sum("bad").alias("dbad"))
    suffixes = domains.groupBy("suffix").agg(F.sum("dn").alias("sn"), F.sum("dbad").alias("sbad"))
    total = suffixes.agg(F.sum("sn").alias("n"), F.sum("sbad").alias("bad")).first()
    n, bad = total.n or 0, total.bad or 0
    rate = (bad + 1) / (n + 2)

    def fitted(df: DataFrame, n_col: str, bad_col: str) -> float:
        c, b = F.col(n_col).cast("double"), F.col(bad_col)
        r = df.where(F.col(n_col) > 0).agg(F.count("*").alias("k"), F.sum(c).alias("m"), F.sum(c * c).alias("s2"), F.sum(c * F.pow(b / c - rate, F.lit(2))).alias("s")).first()
        return _concentration(r.k, r.m, r.s2, r.s, rate) if r.k else 1.0

    k_suffix, k_domain, k_host = fitted(suffixes, "sn", "sbad"), fitted(domains, "dn", "dbad"), fitted(hosts, "n", "bad")
    suffixes = suffixes.select("suffix", ((F.col("sbad") + k_suffix * rate) / (F.col("sn") + k_suffix)).alias("smean"))
    domains = domains.join(suffixes, "suffix").select("domain", ((F.col("dbad") + k_domain * F.col("smean")) / (F.col("dn") + k_domain)).alias("dmean"))
    out = hosts.join(domains, "domain")
    size = F.col("n") + k_host
    good = F.col("bad") + k_host * F.col("dmean")
    out = out.withColumn("lower", beta_bound(good, size - good))
    return out.select("host", "domain", "suffix", "rows", "n", "bad", (good / size).alias("mean"), "lower", F.lit(rate).alias("rate"))


def judge_urls(pages: DataFrame, outcomes: DataFrame, rules: list[tuple[str, str, str]] = RULES) -> DataFrame:
    """``page_id, host, path, rule, verdict, bad_rate, lower`` of ``pages (page_id, url)``.

    ``outcomes (url, bad)`` are labelled pages. Null urls and urls without ``://`` have empty
    host and path and count as one host; repeated rows are judged alike, and null ids keep
    their rows. Other columns do not matter; without outcomes, rules decide and all else is
    allowed; an empty table gives an empty result.
    """
    host, path = host_and_path(F.col("url"))
    parts = pages.select("page_id", host.alias("host"), path.alias("path"))
    seen = outcomes.select(host_and_path(F.col("url"))[0].alias("host"), "bad")
    hosts = seen.unionByName(parts.select("host", F.lit(None).cast("int").alias("bad")))
    known = materialise(host_reputation(hosts).select("host", "rows", F.struct("mean", "lower", "rate").alias("seen")), "hosts")
    total = known.agg(F.sum("rows")).first()[0] or 0
    heavy = F.broadcast(known.where(F.col("rows") * HEAVY > total).select("host", "seen"))  # fewer than HEAVY hosts
    light = parts.join(heavy, "host", "left_anti").join(known.select("host", "seen"), "host")
    rule, verdict = matching_rule(F.col("host"), F.col("path"), rules)
    own = F.when(F.col("seen.lower") > LIMIT * F.col("seen.rate"), "block").otherwise("allow")
    judged = parts.join(heavy, "host").unionByName(light)
    return judged.select("page_id", "host", "path", rule.alias("rule"), F.coalesce(verdict, own).alias("verdict"), F.round("seen.mean", 9).alias("bad_rate"), F.round("seen.lower", 9).alias("lower"))


def page_outcomes(pages: DataFrame, labels: DataFrame) -> DataFrame:
    """``url, bad``: a page is bad if the document that its path names is labelled as of low quality or toxic."""
    doc = F.expr("try_cast(regexp_extract(url, '://[^/?#]*/[^?#]*?([0-9]+)', 1) AS BIGINT)")
    known = labels.where("doc_id IS NOT NULL").groupBy("doc_id").agg(F.max(F.when((F.col("quality") == 0) | (F.col("toxic") == 1), 1).otherwise(0)).alias("bad"))
    return pages.select("url", doc.alias("doc_id")).join(known, "doc_id").select("url", "bad")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages, labels = table(spark, sf_dir, "pages"), table(spark, sf_dir, "labels")
    return judge_urls(pages.select("page_id", "url"), page_outcomes(pages, labels))


def _oracle() -> str:
    fits = "\n".join(f"    WHEN (host = '{h}' OR ends_with(host, '.{h}')) AND starts_with(path, '{p}') THEN '{h}{p}|{v}'" for v, h, p in sorted(RULES, key=lambda r: -len(r[1] + r[2])))
    two = ", ".join(f"'{x}'" for x in TWO_LEVEL)

    def level(name: str, source: str, n: str, bad: str) -> str:
        return f"""{name} AS (
  SELECT CASE WHEN count(*) = 0 THEN 1.0::DOUBLE ELSE 1 / least(greatest(CASE WHEN sum({n}) - sum({n}::DOUBLE * {n}) / sum({n}) - (count(*) - 1) > 0 THEN
    (sum({n} * pow({bad}::DOUBLE / {n} - rate, 2)) / any_value(rate * (1 - rate)) - (count(*) - 1)) / (sum({n}) - sum({n}::DOUBLE * {n}) / sum({n}) - (count(*) - 1))
    ELSE 0 END, 0.001::DOUBLE), 0.999::DOUBLE) - 1 END AS k FROM {source}, base WHERE {n} > 0)"""

    return f"""
WITH known AS (SELECT doc_id, max(CASE WHEN quality = 0 OR toxic = 1 THEN 1 ELSE 0 END) AS bad FROM labels GROUP BY doc_id),
parts AS (
  SELECT page_id, url, CASE WHEN instr(url, '://') > 0 THEN substr(url, instr(url, '://') + 3) ELSE '' END AS rest FROM pages),
split AS (
  SELECT page_id, url, translate(regexp_extract(rest, '^([^/?#]*)', 1), '{_UPPER}', '{_LOWER}') AS host,
    regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path FROM parts),
counted AS (
  SELECT s.host, k.bad FROM split s LEFT JOIN known k
  ON k.doc_id = TRY_CAST(nullif(regexp_extract(s.url, '://[^/?#]*/[^?#]*?([0-9]+)', 1), '') AS BIGINT)),
named AS (
  SELECT host, count(bad) AS n, coalesce(sum(bad), 0) AS bad,
    CASE WHEN regexp_matches(host, '^[0-9.]+(:[0-9]+)?$') THEN host
      WHEN array_to_string(string_split(host, '.')[-2:], '.') IN ({two}) THEN array_to_string(string_split(host, '.')[-3:], '.')
      ELSE array_to_string(string_split(host, '.')[-2:], '.') END AS domain
  FROM counted GROUP BY host),
hosts AS (SELECT *, CASE WHEN instr(domain, '.') > 0 THEN regexp_replace(domain, '^[^.]*\\.', '') ELSE domain END AS suffix FROM named),
domains AS (SELECT domain, suffix, sum(n) AS dn, sum(bad) AS dbad FROM hosts GROUP BY domain, suffix),
suffixes AS (SELECT suffix, sum(dn) AS sn, sum(dbad) AS sbad FROM domains GROUP BY suffix),
base AS (SELECT (sum(sbad) + 1)::DOUBLE / (sum(sn) + 2) AS rate FROM suffixes),
{level("ks", "suffixes", "sn", "sbad")},
{level("kd", "domains", "dn", "dbad")},
{level("kh", "hosts", "n", "bad")},
sm AS (SELECT suffix, (sbad + k * rate) / (sn + k) AS smean FROM suffixes, ks, base),
dm AS (SELECT domain, (dbad + k * smean) / (dn + k) AS dmean FROM domains JOIN sm USING (suffix), kd),
hm AS (
  SELECT host, a / (a + b) AS mean, CASE WHEN a >= 1 THEN a / (a + greatest(b, 1) * exp(2 * ({_Z}::DOUBLE * sqrt(h + {_LAMBDA}::DOUBLE) / h - (q - p) * ({_LAMBDA}::DOUBLE + 5 / 6.0::DOUBLE - 2 / (3 * h))))) ELSE 0 END AS lower
  FROM (SELECT *, 2 / (p + q) AS h FROM (SELECT *, 1 / (2 * a - 1) AS p, 1 / (2 * greatest(b, 1) - 1) AS q FROM (
    SELECT host, bad + k * dmean AS a, n + k - (bad + k * dmean) AS b FROM hosts JOIN dm USING (domain), kh)))),
judged AS (
  SELECT page_id, host, path, mean, lower, rate,
    CASE
{fits}
    END AS hit FROM split JOIN hm USING (host), base)
SELECT page_id, host, path, split_part(hit, '|', 1) AS rule,
  CASE WHEN hit IS NOT NULL THEN split_part(hit, '|', 2) WHEN lower > {LIMIT}::DOUBLE * rate THEN 'block' ELSE 'allow' END AS verdict,
  round(mean, 9) AS bad_rate, round(lower, 9) AS lower
FROM judged
"""


ORACLE = _oracle()
