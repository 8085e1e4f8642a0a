"""URL filter: fixed rules, then empirical-Bayes host reputation.

Labelled page outcomes (bad or not) are counted by host, registered domain and
suffix.  At each level the rate of bad pages has a beta prior whose mean is the
posterior mean of the level above and whose strength is estimated from the
spread of the rates at that level (method of moments for the beta-binomial).
A host is blocked when, by its posterior's lower bound, the odds of a bad page
are at least ``RATIO`` times those of all labelled pages: the limit follows the
corpus and is fitted to none.  All steps are DataFrame operations.
"""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from plumbline.scratch import materialise

#: (verdict, host and path) as stated in the contract of op2.
RULES = (("block", "net/"), ("allow", "example.net/en/"), ("block", "example.com/de/"), ("allow", "org/fr/"))
#: Suffixes of several labels, under which domains are registered (a parameter;
#: a full public list may be given); fixed values.
LONG_SUFFIXES = ("co.uk", "org.uk", "ac.uk", "gov.uk", "com.au", "net.au", "org.au", "co.jp", "co.nz", "co.za", "com.br", "com.mx", "co.in", "com.cn", "com.tr")
#: Posterior standard deviations below the mean at which the bound lies.
BOUND_SD = 1.645
#: How many times the overall odds of a bad page a host's bound must reach.
RATIO = 2.0
#: Bounds of the prior strengths: pages that a prior is worth.
STRENGTHS = (1.0, 1000.0)


def host_of(url: Column) -> Column:
    """After the first ``://`` up to ``/``, ``?``, ``#`` or the end, A-Z
    lower-cased; empty without ``://`` or for null."""
    raw = F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://([^/?#]*)", 1)
    upper = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
    return F.translate(raw, upper, upper.lower())


def path_of(url: Column) -> Column:
    """What follows the host up to ``?``, ``#`` or the end."""
    return F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://[^/?#]*([^?#]*)", 1)


def rule_for(host: Column, path: Column, rules: tuple[tuple[str, str], ...] = RULES) -> tuple[Column, Column]:
    """(rule, verdict) of the longest rule that fits, null if none does."""
    rule, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for kind, text in sorted(rules, key=lambda r: len(r[1])):
        name, _, rest = text.partition("/")
        fits = ((host == name) | host.endswith("." + name)) & path.startswith("/" + rest)
        rule, verdict = F.when(fits, text).otherwise(rule), F.when(fits, kind).otherwise(verdict)
    return rule, verdict


def site_of(host: Column) -> Column:
    """The host without user and port, by which reputation is counted."""
    return F.regexp_replace(F.regexp_replace(host, r"^.*@", ""), r":[0-9]*$", "")


def _last(labels: Column, n: Column | int) -> Column:
    n = F.least(F.lit(n) if isinstance(n, int) else n, F.size(labels))
    return F.concat_ws(".", F.slice(labels, -n, n))


def suffix_of(site: Column, suffixes: Iterable[str] = LONG_SUFFIXES) -> Column:
    """The longest listed suffix of the site, else its last label."""
    labels = F.split(site, r"\.")
    by_length: dict[int, list[str]] = {}
    for s in suffixes:
        by_length.setdefault(s.count(".") + 1, []).append(s)
    out = F.element_at(labels, -1)
    for n in sorted(by_length):
        out = F.when((F.size(labels) >= n) & _last(labels, n).isin(*by_length[n]), _last(labels, n)).otherwise(out)
    return out


def domain_of(site: Column, suffixes: Iterable[str] = LONG_SUFFIXES) -> Column:
    """The suffix and one label more; the site itself if it has no more."""
    return _last(F.split(site, r"\."), F.size(F.split(suffix_of(site, suffixes), r"\.")) + 1)


def _strength(level: DataFrame) -> float:
    """Strength (alpha + beta) of the beta prior around ``prior`` by moments,
    from rows of ``n`` pages and ``bad`` of them.  One row is collected."""
    m = F.col("prior")
    rate = F.col("bad") / F.col("n")
    row = level.filter("n > 0").agg(
        F.sum(F.col("n") * (rate - m) * (rate - m)).alias("seen"),
        F.sum(m * (1 - m)).alias("noise"),
        F.sum((F.col("n") - 1) * m * (1 - m)).alias("room"),
    )
    seen, noise, room = row.first()
    low, high = STRENGTHS
    if not room or seen is None:
        return low
    share = (seen - noise) / room  # between-group share of the variance: 1 / (strength + 1)
    return high if share <= 1 / (high + 1) else min(high, max(low, 1 / share - 1))


def host_reputation(pages: DataFrame, outcomes: DataFrame, bound_sd: float = BOUND_SD, suffixes: Iterable[str] = LONG_SUFFIXES) -> DataFrame:
    """``(site, bad_rate, lower_bound, overall, host_*, domain_*, suffix_*)`` of
    every site in ``pages`` (page_id, site), given ``outcomes`` (page_id, bad
    boolean; one row a page); for each level its labelled pages ``n``, ``bad``
    ones, ``prior`` mean and ``strength``.  Sites without outcomes take their
    domain's or suffix's rate.  A page counts once however often it is listed
    for a site."""
    marked = pages.join(outcomes.filter("bad is not null"), "page_id").select("site", "page_id", "bad").distinct()
    seen = marked.groupBy("site").agg(F.count("*").alias("n"), F.sum(F.col("bad").cast("long")).alias("bad"))
    every = pages.groupBy("site").agg(F.count("*").alias("pages"))
    sites = every.join(seen, "site", "left").select(
        "site", domain_of(F.col("site"), suffixes).alias("domain"), suffix_of(F.col("site"), suffixes).alias("suffix"), F.coalesce("n", F.lit(0)).alias("n"), F.coalesce("bad", F.lit(0)).alias("bad")
    )
    sites = materialise(sites, "reputation-sites")

    n, bad = sites.agg(F.sum("n"), F.sum("bad")).first()
    overall = ((bad or 0) + 0.5) / ((n or 0) + 1.0)
    counts = (F.sum("n").alias("n"), F.sum("bad").alias("bad"))
    named = lambda level: [F.col(c).alias(f"{level}_{c}") for c in ("n", "bad", "prior", "strength")]
    by_suffix = _posterior(sites.groupBy("suffix").agg(*counts).withColumn("prior", F.lit(overall)))
    by_suffix = by_suffix.select("suffix", F.col("mean").alias("prior"), *named("suffix"))
    by_domain = _posterior(sites.groupBy("suffix", "domain").agg(*counts).join(by_suffix, "suffix"))
    by_domain = by_domain.select("suffix", "domain", F.col("mean").alias("prior"), *named("domain"), *[f"suffix_{c}" for c in ("n", "bad", "prior", "strength")])
    scored = _posterior(sites.join(by_domain, ["suffix", "domain"]))
    rounded = lambda level: [F.col(f"{level}_n"), F.col(f"{level}_bad"), F.round(f"{level}_prior", 9).alias(f"{level}_prior"), F.round(f"{level}_strength", 6).alias(f"{level}_strength")]
    return scored.select("site", "mean", "sd", *named("host"), *[f"{level}_{c}" for level in ("domain", "suffix") for c in ("n", "bad", "prior", "strength")]).select(
        "site",
        F.round("mean", 9).alias("bad_rate"),
        F.round(F.col("mean") - bound_sd * F.col("sd"), 9).alias("lower_bound"),
        F.round(F.lit(overall), 9).alias("overall"),
        *[c for level in ("host", "domain", "suffix") for c in rounded(level)],
    )


def _posterior(level: DataFrame) -> DataFrame:
    k = F.lit(_strength(level))
    a, b = F.col("prior") * k + F.col("bad"), (1 - F.col("prior")) * k + F.col("n") - F.col("bad")
    return level.withColumns({"strength": k, "mean": a / (a + b), "sd": F.sqrt(a * b / ((a + b) * (a + b) * (a + b + 1)))})


def judge(pages: DataFrame, outcomes: DataFrame, rules: tuple[tuple[str, str], ...] = RULES, ratio: float = RATIO, bound_sd: float = BOUND_SD, suffixes: Iterable[str] = LONG_SUFFIXES) -> DataFrame:
    """``(page_id, host, path, rule, verdict, bad_rate, lower_bound, overall,
    ...)`` of every page (page_id, url): the longest fitting rule's verdict,
    else ``block`` if the odds at the lower bound of the host's bad rate are at
    least ``ratio`` times the overall odds; then the counts, priors and strengths of
    its levels.

    A null url, or one without ``://``, has an empty host and path; the empty
    host is judged like any other.  Without outcomes nothing but rules blocks.
    Repeated rows are judged each and are evidence once; null and very long
    urls, and page ids of any type, are taken as they are; columns of other
    names are not looked at.  The join to the hosts is a plain equi-join, which
    adaptive execution splits where one host holds many pages.
    """
    url = F.col("url").cast("string")
    parsed = pages.select("page_id", host_of(url).alias("host"), path_of(url).alias("path")).withColumn("site", site_of(F.col("host")))
    reputation = host_reputation(parsed, outcomes, bound_sd, suffixes)
    rule, verdict = rule_for(F.col("host"), F.col("path"), rules)
    found = F.when((F.col("lower_bound") * (1 - F.col("overall")) >= ratio * F.col("overall") * (1 - F.col("lower_bound"))) & (F.col("suffix_n") > 0), "block").otherwise("allow")
    told = [c for c in reputation.columns if c != "site"]
    return parsed.join(reputation, "site").select("page_id", "host", "path", rule.alias("rule"), F.coalesce(verdict, found).alias("verdict"), *told)


def _level(name: str, rows: str) -> str:
    """Posterior means of the rows (key columns, n, bad, prior) in SQL."""
    return f"""
{name}_fit AS (
  SELECT sum(n * (bad / n - prior) * (bad / n - prior)) AS seen, sum(prior * (1 - prior)) AS noise, sum((n - 1) * prior * (1 - prior)) AS room
  FROM {rows} WHERE n > 0),
{name}_k AS (
  SELECT CASE WHEN room IS NULL OR room = 0 THEN 1.0 WHEN (seen - noise) / room <= 1 / 1001.0::DOUBLE THEN 1000.0
              ELSE least(1000.0, greatest(1.0, 1 / ((seen - noise) / room) - 1)) END::DOUBLE AS k FROM {name}_fit),
{name}_ab AS (SELECT r.*, k, prior * k + bad AS a, (1 - prior) * k + n - bad AS b FROM {rows} r CROSS JOIN {name}_k),
{name} AS (SELECT *, a / (a + b) AS mean, sqrt(a * b / ((a + b) * (a + b) * (a + b + 1))) AS sd FROM {name}_ab)"""


#: DuckDB SQL of op2 over the views ``pages`` and ``labels``.
SQL = (
    r"""
WITH parsed AS (
  SELECT page_id, lower(regexp_extract(coalesce(url, ''), '(?s)^.*?://([^/?#]*)', 1)) AS host,
         regexp_extract(coalesce(url, ''), '(?s)^.*?://[^/?#]*([^?#]*)', 1) AS path
  FROM pages),
sited AS (SELECT *, regexp_replace(regexp_replace(host, '^.*@', ''), ':[0-9]*$', '') AS site FROM parsed),
outcomes AS (SELECT doc_id AS page_id, bool_or(quality = 0) AS bad FROM labels WHERE quality IS NOT NULL GROUP BY doc_id),
seen AS (SELECT site, count(*)::DOUBLE AS n, sum(bad::INT)::DOUBLE AS bad FROM (SELECT DISTINCT site, page_id, bad FROM sited JOIN outcomes USING (page_id)) GROUP BY site),
labelled AS (SELECT site, string_split(site, '.') AS l, coalesce(n, 0) AS n, coalesce(bad, 0) AS bad FROM (SELECT DISTINCT site FROM sited) LEFT JOIN seen USING (site)),
suffixed AS (SELECT *, CASE WHEN list_contains(["""
    + ", ".join(f"'{x}'" for x in LONG_SUFFIXES)
    + r"""], array_to_string(l[-2:], '.')) THEN 2 ELSE 1 END AS w FROM labelled),
hosts AS (SELECT site, n, bad, array_to_string(l[-w:], '.') AS suffix, array_to_string(l[-w - 1:], '.') AS domain FROM suffixed),
overall AS (SELECT (sum(bad) + 0.5::DOUBLE) / (sum(n) + 1) AS rate FROM hosts),
s0 AS (SELECT suffix, sum(n) AS n, sum(bad) AS bad, (SELECT rate FROM overall) AS prior FROM hosts GROUP BY suffix),"""
    + _level("s1", "s0")
    + """,
d0 AS (SELECT suffix, domain, sum(h.n) AS n, sum(h.bad) AS bad, any_value(s1.mean) AS prior FROM hosts h JOIN s1 USING (suffix) GROUP BY suffix, domain),"""
    + _level("d1", "d0")
    + """,
h0 AS (SELECT suffix, domain, site, h.n, h.bad, d1.mean AS prior FROM hosts h JOIN d1 USING (suffix, domain)),"""
    + _level("h1", "h0")
    + r""",
judged AS (
  SELECT page_id, host, path, round(h1.mean, 9) AS bad_rate, round(h1.mean - 1.645::DOUBLE * h1.sd, 9) AS lower_bound,
         round((SELECT rate FROM overall), 9) AS overall, h1.n::BIGINT AS host_n, h1.bad::BIGINT AS host_bad, round(h1.prior, 9) AS host_prior, round(h1.k, 6) AS host_strength,
         d1.n::BIGINT AS domain_n, d1.bad::BIGINT AS domain_bad, round(d1.prior, 9) AS domain_prior, round(d1.k, 6) AS domain_strength,
         s1.n::BIGINT AS suffix_n, s1.bad::BIGINT AS suffix_bad, round(s1.prior, 9) AS suffix_prior, round(s1.k, 6) AS suffix_strength,
         CASE WHEN (host = 'example.net' OR host LIKE '%.example.net') AND starts_with(path, '/en/') THEN 'example.net/en/'
              WHEN (host = 'example.com' OR host LIKE '%.example.com') AND starts_with(path, '/de/') THEN 'example.com/de/'
              WHEN (host = 'org' OR host LIKE '%.org') AND starts_with(path, '/fr/') THEN 'org/fr/'
              WHEN (host = 'net' OR host LIKE '%.net') AND starts_with(path, '/') THEN 'net/' END AS rule
  FROM sited JOIN h1 USING (site) JOIN d1 USING (suffix, domain) JOIN s1 USING (suffix))
SELECT * EXCLUDE (rule), rule,
       CASE rule WHEN 'net/' THEN 'block' WHEN 'example.net/en/' THEN 'allow' WHEN 'example.com/de/' THEN 'block' WHEN 'org/fr/' THEN 'allow'
            ELSE CASE WHEN lower_bound * (1 - overall) >= 2 * overall * (1 - lower_bound) AND suffix_n > 0 THEN 'block' ELSE 'allow' END END AS verdict
FROM judged
"""
)
