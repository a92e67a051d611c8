"""Operator 9, URL filters by empirical-Bayes host reputation (DataFrame operations only).

Path rules come first. The pages that a rule judges are the labelled outcomes (1 = blocked) from
which every host's reputation is learned: a beta-binomial prior is shrunk from all hosts to the
public suffix, from there to the registered domain and on to the host; each level's concentration
is estimated from the spread of its children by moments. A page without a rule is blocked when its
host's posterior lies above ``BOUND`` with a probability of ``SURE`` at least, that is when its lower
bound (the beta quantile at 1 - SURE) does. Outcomes are aggregated per host before any join.

In the hierarchy a host stands without user, port and final dot, under its public suffix (last label,
or one of ``SUFFIXES``) and one label more; addresses are their own suffix and domain. All outcomes
count, however many: the terms of the beta tail grow with the square root of a host's outcomes.

The join of pages with hosts has a hot key where a host has very many pages; it relies on adaptive
execution to split that partition.

Defined results: a null url, or one without ``://``, has empty host and path, fits no rule and is
allowed; repeated rows are judged each; an empty table gives an empty result.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import lower_ascii, stage

#: (rule, verdict): host, then path.
RULES = (("org/", "allow"), ("example.org/es/", "block"), ("example.org/en/1", "block"), ("com/fr/", "allow"), ("com/de/", "block"))
BOUND, SURE = 0.5, 0.95
#: Terms of the beta tail: so many, and so many times the square root of the larger count.
TERMS, MORE_TERMS = 200, 8
#: Public suffixes of two labels that are read; any other suffix is the last label.
SUFFIXES = """
ac.at co.at gv.at or.at com.au edu.au gov.au net.au org.au com.br gov.br net.br org.br com.cn edu.cn gov.cn net.cn org.cn com.co com.eg com.es org.es gouv.fr asso.fr com.fr
com.gr com.hk edu.hk gov.hk org.hk co.hu co.id ac.id go.id or.id ac.il co.il gov.il org.il ac.in co.in gov.in net.in org.in ac.ir co.ir gov.it ac.jp co.jp go.jp ne.jp or.jp
ac.ke co.ke ac.kr co.kr go.kr or.kr com.mx gob.mx org.mx com.my gov.my ac.nz co.nz govt.nz net.nz org.nz com.pe com.ph gov.ph com.pk edu.pk com.pl edu.pl gov.pl net.pl org.pl
com.pt gov.pt com.ro com.ru com.sa edu.sa gov.sa com.sg edu.sg gov.sg org.sg ac.th co.th go.th in.th com.tr edu.tr gov.tr org.tr com.tw edu.tw gov.tw org.tw com.ua gov.ua
ac.uk co.uk gov.uk ltd.uk me.uk net.uk nhs.uk org.uk plc.uk sch.uk com.ve com.vn edu.vn gov.vn ac.za co.za gov.za net.za org.za github.io gitlab.io blogspot.com wordpress.com
""".split()


def split_url(url: Column) -> tuple[Column, Column]:
    """Host and path of a url, both empty when there is no ``://``."""
    url = F.coalesce(url, F.lit(""))
    host = lower_ascii(F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1))
    path = F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1)
    return host, path


def rule_of(host: Column, path: Column, rules) -> tuple[Column, Column]:
    """The longest rule that fits, and its verdict; null where none does."""
    rule, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for text, says in sorted(rules, key=lambda r: (len(r[0]), r[0])):
        where, start = text.split("/", 1)
        fits = ((host == where) | host.endswith(f".{where}")) & path.startswith(f"/{start}")
        rule, verdict = F.when(fits, text).otherwise(rule), F.when(fits, says).otherwise(verdict)
    return rule, verdict


def domain_of(host: Column) -> tuple[Column, Column]:
    """Registered domain and public suffix of a host."""
    bare = F.regexp_replace(F.regexp_replace(host, r"^.*@|:[0-9]*$", ""), r"\.+$", "")
    last = F.substring_index(bare, ".", -2)
    two = last.isin(SUFFIXES)
    address = bare.rlike(r"^[0-9]+(\.[0-9]+){3}$|^\[")
    domain = F.when(address, bare).when(two, F.substring_index(bare, ".", -3)).otherwise(last)
    return domain, F.when(address, bare).when(two, last).otherwise(F.substring_index(bare, ".", -1))


def _log_gamma(x: Column) -> Column:
    """Stirling's series, eight steps further on."""
    z = x + 8
    product = x
    for i in range(1, 8):
        product = product * (x + i)
    return (z - 0.5) * F.log(z) - z + 0.5 * math.log(2 * math.pi) + 1 / (12 * z) - 1 / (360 * z**3) + 1 / (1260 * z**5) - F.log(product)


def beta_above(hosts: DataFrame, bound: float) -> DataFrame:
    """``above``: the probability that a beta variable of columns ``a`` and ``b`` exceeds ``bound``.

    The distribution function by its continued fraction, from its last term back, on the side on which
    it converges in a number of terms that grows with the square root of the larger of a and b. The
    logarithms lose digits as a and b grow: about 1e-8 of the result is lost at 1e7.
    """
    right = F.lit(bound) > (F.col("a") + 1) / (F.col("a") + F.col("b") + 2)
    sided = hosts.withColumns(
        {"right": right, "p": F.when(right, F.col("b")).otherwise(F.col("a")), "q": F.when(right, F.col("a")).otherwise(F.col("b")), "y": F.when(right, 1 - bound).otherwise(bound)}
    )
    p, q, y = F.col("p"), F.col("q"), F.col("y")

    def term(h: Column, k: Column) -> Column:
        m = F.floor(k / 2)
        odd = -(p + m) * (p + q + m) * y / ((p + 2 * m) * (p + 2 * m + 1))
        even = m * (q - m) * y / ((p + 2 * m - 1) * (p + 2 * m))
        return 1 + F.when(k % 2 == 1, odd).otherwise(even) / h

    fraction = F.aggregate(F.sequence(F.lit(TERMS) + (F.ceil(F.sqrt(F.greatest(p, q))) * MORE_TERMS).cast("int"), F.lit(1), F.lit(-1)), F.lit(1.0), term)
    below = F.exp(p * F.log(y) + q * F.log(1 - y) + _log_gamma(p + q) - _log_gamma(p) - _log_gamma(q)) / p / fraction
    return sided.withColumn("above", F.when(F.col("right"), below).otherwise(1 - below))


def _moments(children: DataFrame, level: str) -> DataFrame:
    """One row: what the beta-binomial concentration of a level's labelled children follows from."""
    return children.where("n > 0").agg(
        F.lit(level).alias("level"), F.count(F.lit(1)).cast("double").alias("k"), F.sum("n").cast("double").alias("n"), F.sum("x").cast("double").alias("x"),
        F.sum(F.col("x") * F.col("x") / F.col("n")).alias("q"), F.sum(F.col("n") * F.col("n")).cast("double").alias("n2"),
    )


def _concentration(m) -> float:
    """By moments, between 1 and 1000; 1000 where children differ no more than chance makes them."""
    p = m["x"] / m["n"] if m["n"] else 0.0
    if not 0 < p < 1:
        return 1000.0
    spread, effective = (m["q"] - m["n"] * p * p) / (p * (1 - p)), m["n"] - m["n2"] / m["n"]
    excess = spread - (m["k"] - 1)
    return max(1.0, min(1000.0, (effective - (m["k"] - 1)) / excess - 1)) if excess > 0 else 1000.0


def host_reputation(outcomes: DataFrame, bound: float = BOUND) -> DataFrame:
    """``(host, n, x)`` counts to ``(host, rate, above)``: posterior block rate, probability that it exceeds ``bound``.

    Three rows of sums are collected, one a level; hosts, domains and suffixes stay tables.
    """
    domain, suffix = domain_of(F.col("host"))
    hosts = stage(outcomes.withColumns({"suffix": suffix, "domain": domain}), "hosts")
    domains = hosts.groupBy("domain", "suffix").agg(F.sum("n").alias("n"), F.sum("x").alias("x"))
    suffixes = domains.groupBy("suffix").agg(F.sum("n").alias("n"), F.sum("x").alias("x"))
    levels = {"suffix": suffixes, "domain": domains, "host": hosts}
    moments = {r["level"]: r for r in _moments(suffixes, "suffix").unionAll(_moments(domains, "domain")).unionAll(_moments(hosts, "host")).collect()}
    m = {level: F.lit(_concentration(moments[level])) for level in levels}
    p = ((moments["host"]["x"] or 0.0) + 0.5) / ((moments["host"]["n"] or 0.0) + 1)
    suffix = suffixes.select("suffix", ((F.col("x") + m["suffix"] * p) / (F.col("n") + m["suffix"])).alias("prior"))
    domain = domains.join(suffix, "suffix").select("domain", ((F.col("x") + m["domain"] * F.col("prior")) / (F.col("n") + m["domain"])).alias("prior"))
    host = hosts.join(domain, "domain").select(
        "host", (F.col("x") + m["host"] * F.col("prior")).alias("a"), (F.col("n") - F.col("x") + m["host"] * (1 - F.col("prior"))).alias("b")
    )
    return beta_above(host, bound).select("host", (F.col("a") / (F.col("a") + F.col("b"))).alias("rate"), "above")


def filter_urls(pages: DataFrame, rules=RULES, id_col: str = "page_id", url_col: str = "url", bound: float = BOUND) -> DataFrame:
    """One row per page: ``page_id, host, path, rule, verdict, score`` (probability that its host's rate exceeds the bound)."""
    host, path = split_url(F.col(url_col))
    judged = pages.select(F.col(id_col).alias("page_id"), host.alias("host"), path.alias("path"))
    rule, verdict = rule_of(F.col("host"), F.col("path"), rules)
    judged = judged.select("*", rule.alias("rule"), verdict.alias("says"))
    counts = judged.where("host <> ''").groupBy("host").agg(
        F.count("says").alias("n"), F.count(F.when(F.col("says") == "block", 1)).alias("x")
    )
    return judged.join(host_reputation(counts, bound), "host", "left").select(
        "page_id", "host", "path", "rule",
        F.coalesce("says", F.when(F.col("above") >= SURE, "block").otherwise("allow")).alias("verdict"),
        F.round("above", 6).alias("score"),
    )


def _sql_concentration(table: str, name: str) -> str:
    return f"""{name} AS (
  SELECT greatest(1.0::DOUBLE, least(1000.0::DOUBLE, coalesce((eff - (k - 1)) / nullif(greatest(spread - (k - 1), 0.0::DOUBLE), 0.0::DOUBLE) - 1, 1000.0::DOUBLE))) AS m
  FROM (SELECT k, (q - s * p * p) / nullif(p * (1 - p), 0) AS spread, s - s2 / nullif(s, 0) AS eff
        FROM (SELECT count(*)::DOUBLE AS k, sum(n)::DOUBLE AS s, sum(n * n)::DOUBLE AS s2, sum(x)::DOUBLE / nullif(sum(n)::DOUBLE, 0) AS p, sum((x * x)::DOUBLE / n) AS q FROM {table} WHERE n > 0)))"""


SQL = rf"""
WITH u AS (
  SELECT page_id,
         translate(regexp_extract(coalesce(url, ''), '(?s)^.*?://([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
         regexp_extract(coalesce(url, ''), '(?s)^.*?://[^/?#]*([^?#]*)', 1) AS path
  FROM pages),
j AS (
  SELECT *, CASE
    WHEN (host = 'example.org' OR host LIKE '%.example.org') AND path LIKE '/en/1%' THEN 'example.org/en/1'
    WHEN (host = 'example.org' OR host LIKE '%.example.org') AND path LIKE '/es/%' THEN 'example.org/es/'
    WHEN (host = 'com' OR host LIKE '%.com') AND path LIKE '/fr/%' THEN 'com/fr/'
    WHEN (host = 'com' OR host LIKE '%.com') AND path LIKE '/de/%' THEN 'com/de/'
    WHEN (host = 'org' OR host LIKE '%.org') AND path LIKE '/%' THEN 'org/' END AS rule
  FROM u),
s AS (SELECT *, CASE WHEN rule IN ('org/', 'com/fr/') THEN 'allow' WHEN rule IS NOT NULL THEN 'block' END AS says FROM j),
g0 AS (
  SELECT host, count(says) AS n, count(CASE WHEN says = 'block' THEN 1 END) AS x,
         string_split(regexp_replace(regexp_replace(host, '^.*@|:[0-9]*$', '', 'g'), '\.+$', ''), '.') AS l FROM s WHERE host <> '' GROUP BY host),
h AS (
  SELECT host, n, x,
         CASE WHEN address THEN array_to_string(l, '.') WHEN two THEN array_to_string(l[-3:], '.') ELSE array_to_string(l[-2:], '.') END AS domain,
         CASE WHEN address THEN array_to_string(l, '.') WHEN two THEN array_to_string(l[-2:], '.') ELSE l[-1] END AS suffix
  FROM (SELECT *, array_to_string(l[-2:], '.') IN ('{"', '".join(SUFFIXES)}') AS two, regexp_matches(array_to_string(l, '.'), '^[0-9]+(\.[0-9]+){{3}}$|^\[') AS address FROM g0)),
d AS (SELECT domain, suffix, sum(n) AS n, sum(x) AS x FROM h GROUP BY ALL),
f AS (SELECT suffix, sum(n) AS n, sum(x) AS x FROM d GROUP BY ALL),
g AS (SELECT (sum(x) + 0.5::DOUBLE) / (sum(n) + 1) AS p FROM f),
{_sql_concentration("f", "mf")}, {_sql_concentration("d", "md")}, {_sql_concentration("h", "mh")},
pf AS (SELECT suffix, (x + mf.m * p) / (n + mf.m) AS p FROM f, g, mf),
pd AS (SELECT domain, (x + md.m * pf.p) / (n + md.m) AS p FROM d JOIN pf USING (suffix), md),
pa AS (SELECT host, x + mh.m * pd.p AS a, n - x + mh.m * (1 - pd.p) AS b FROM h JOIN pd USING (domain), mh),
ps AS (SELECT *, {BOUND}::DOUBLE > (a + 1) / (a + b + 2) AS far FROM pa),
pq AS (SELECT host, far, CASE WHEN far THEN b ELSE a END AS p, CASE WHEN far THEN a ELSE b END AS q, CASE WHEN far THEN 1 - {BOUND}::DOUBLE ELSE {BOUND}::DOUBLE END AS y FROM ps),
pf2 AS (
  SELECT host, far, exp(p * ln(y) + q * ln(1 - y) + lgamma(p + q) - lgamma(p) - lgamma(q)) / p / list_reduce(
    list_prepend(1.0::DOUBLE, list_transform(range({TERMS} + {MORE_TERMS} * ceil(sqrt(greatest(p, q)))::BIGINT, 0, -1), lambda k: k::DOUBLE)),
    lambda h, k: 1 + CASE WHEN k % 2 = 1 THEN -(p + (k - 1) / 2) * (p + q + (k - 1) / 2) * y / ((p + k - 1) * (p + k)) ELSE k / 2 * (q - k / 2) * y / ((p + k - 1) * (p + k)) END / h) AS below
  FROM pq),
b AS (SELECT host, CASE WHEN far THEN below ELSE 1 - below END AS above FROM pf2)
SELECT page_id, host, path, rule, coalesce(says, CASE WHEN above >= {SURE} THEN 'block' ELSE 'allow' END) AS verdict, round(above, 6) AS score
FROM s LEFT JOIN b USING (host)
"""
