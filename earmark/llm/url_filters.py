"""URL filter: fixed rules first, then empirical-Bayes host reputation.

The share of bad pages of a host is shrunk through beta-binomial priors: suffix
towards all pages, registered domain towards its suffix, host towards its domain.
The prior strength of each level comes from the spread between its members by the
method of moments. A host is blocked when the lower posterior bound of its bad share
passes ``limit``; a host nobody labelled inherits its parents' posterior.

Main path: built-in functions. Outcomes are counted by host with partial aggregates
before any join; pages join the host table, a shuffle join that may be split when
one host holds much of the rows. The registered domain is the label before the public
suffix (``TWO_LABELS``, else the last label), without user information and port. Null urls and urls without ``://`` have an empty
host and path and are judged by the overall share. Repeated page rows each get their
verdict; very long urls are read whole; hosts are told apart by name, so there are no ties; without
any labels the share is ``start``; an empty table gives no rows; other columns are not read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import ascii_lower, cut

#: Fixed rules: verdict and host/path.
RULES = (
    ("allow", "com/"),
    ("block", "example.com/en/"),
    ("allow", "www.example.com/en/"),
    ("block", "net/es/"),
    ("block", "net/fr/"),
)
LEVELS = ("suffix", "domain", "host")
#: Public suffixes of two labels; any other suffix is the last label.
TWO_LABELS = (
    "ac.jp", "ac.nz", "ac.uk", "ac.za", "co.id", "co.il", "co.in", "co.jp", "co.ke", "co.kr", "co.nz", "co.th", "co.uk", "co.za",
    "com.ar", "com.au", "com.br", "com.cn", "com.co", "com.eg", "com.hk", "com.mx", "com.my", "com.ng", "com.pe", "com.ph", "com.pk",
    "com.pl", "com.sa", "com.sg", "com.tr", "com.tw", "com.ua", "com.vn", "edu.au", "edu.cn", "gov.au", "gov.uk", "ne.jp", "net.au",
    "net.nz", "or.jp", "or.kr", "org.au", "org.br", "org.nz", "org.uk", "org.za",
)


def split_url(url: Column) -> tuple[Column, Column]:
    at = F.instr(url, "://")
    rest = F.substring(url, at + 3, F.length(url))
    has = F.coalesce(at > 0, F.lit(False))
    host = ascii_lower(F.regexp_extract(rest, r"(?s)^[^/?#]*", 0))
    path = F.regexp_extract(rest, r"(?s)^[^/?#]*([^?#]*)", 1)
    return F.when(has, host).otherwise(""), F.when(has, path).otherwise("")


def rule_of(host: Column, path: Column) -> Column:
    """The longest rule that fits, or null."""
    best = F.lit(None).cast("string")
    for _, rule in sorted(RULES, key=lambda r: len(r[1])):
        name, slash, tail = rule.partition("/")
        fits = ((host == name) | host.endswith("." + name)) & path.startswith(slash + tail)
        best = F.when(fits, F.lit(rule)).otherwise(best)
    return best


def reputation(outcomes: DataFrame, *, start: float = 0.2, strongest: float = 1000.0) -> DataFrame:
    """host, alpha and beta of each host's posterior, from (host, bad as 0/1 or null)."""
    parts = F.split("host", r"\.")
    last = lambda n: F.concat_ws(".", *[F.element_at(parts, -i) for i in range(n, 0, -1)])
    two = (F.size(parts) > 1) & last(2).isin(*TWO_LABELS)
    hosts = outcomes.groupBy("host").agg(F.count("bad").alias("n"), F.coalesce(F.sum("bad"), F.lit(0)).alias("b"))
    hosts = hosts.withColumn("suffix", F.when(two, last(2)).otherwise(last(1))).withColumn(
        "domain", F.when(two & (F.size(parts) > 2), last(3)).when(~two & (F.size(parts) > 1), last(2)).otherwise(F.col("host"))
    )
    hosts = cut(hosts)
    total = hosts.agg(F.sum("n").alias("n"), F.sum("b").alias("b")).first()
    mean = F.lit((total["b"] + start) / (total["n"] + 1) if total["n"] else start)
    up = hosts.withColumn("__mean", mean)
    for level in LEVELS:
        members = hosts.groupBy(level).agg(F.sum("n").alias("n"), F.sum("b").alias("b"))
        above = up.groupBy(level).agg(F.first("__mean").alias("__mean"))
        members = members.join(above, level)
        # moments: E[(b - n m)^2] = m (1 - m) n (1 + (n - 1) r), with r = 1 / (strength + 1)
        m, n = F.col("__mean"), F.col("n")
        sums = members.agg(
            F.sum((F.col("b") - n * m) * (F.col("b") - n * m) - m * (1 - m) * n).alias("extra"),
            F.sum(m * (1 - m) * n * (n - 1)).alias("room"),
        ).first()
        extra, room = sums["extra"] or 0.0, sums["room"] or 0.0
        r = extra / room if room > 0 else 0.0
        r = min(max(r, 1 / (strongest + 1)), 0.5)
        k = 1 / r - 1
        alpha, beta = F.col("b") + k * m, n - F.col("b") + k * (1 - m)
        members = members.select(level, alpha.alias("__alpha"), beta.alias("__beta"))
        up = hosts.join(members, level).withColumn("__mean", F.col("__alpha") / (F.col("__alpha") + F.col("__beta")))
    return up.select("host", F.col("__alpha").alias("alpha"), F.col("__beta").alias("beta"))


def judge(pages: DataFrame, labels: DataFrame, *, limit: float = 0.25, z: float = 1.64) -> DataFrame:
    """page_id, host, path, rule, verdict and the bound, for each row of (page_id, url); labels (doc_id, quality, toxic)."""
    host, path = split_url(F.col("url"))
    seen = pages.select("page_id", host.alias("host"), path.alias("path")).withColumn("rule", rule_of(F.col("host"), F.col("path")))
    bad = F.when(F.col("quality").isNull() & F.col("toxic").isNull(), None).otherwise(
        F.when((F.col("quality") == 0) | (F.col("toxic") == 1), 1).otherwise(0)
    )
    told = labels.select(F.col("doc_id").alias("__id"), bad.alias("bad")).filter("__id is not null and bad is not null")
    told = told.groupBy("__id").agg(F.max("bad").alias("bad"))
    # user information and port tell nothing of the owner
    owner = F.regexp_extract("host", r"(?s)^(?:.*@)?([^:]*)", 1)
    seen = seen.withColumn("__owner", owner)
    known = reputation(seen.join(told, seen["page_id"] == told["__id"], "left").select(F.col("__owner").alias("host"), "bad"))
    a, b = F.col("alpha"), F.col("beta")
    p = a / (a + b)
    bound = p - z * F.sqrt(p * (1 - p) / (a + b + 1))
    known = cut(known.select(F.col("host").alias("__host"), F.round(bound, 9).alias("bad_bound")))
    by_rule = F.create_map(*[F.lit(x) for v, r in RULES for x in (r, v)])
    verdict = F.coalesce(by_rule[F.col("rule")], F.when(F.col("bad_bound") > limit, "block").otherwise("allow"))
    return seen.join(known, seen["__owner"] == known["__host"], "left").select(
        "page_id", "host", "path", "rule", verdict.alias("verdict"), F.round("bad_bound", 5).alias("bad_bound")
    )


def _oracle() -> str:
    """The same in DuckDB SQL."""
    fits = " ".join(
        f"when (host = '{n}' or ends_with(host, '.{n}')) and starts_with(path, '/{t}') then '{r}'"
        for r in sorted((r for _, r in RULES), key=len, reverse=True)
        for n, _, t in [r.partition("/")]
    )
    verdicts = " ".join(f"when '{r}' then '{v}'" for v, r in RULES)
    steps, above = "", "(select *, (select m from root) as mean from hosts)"
    for level in LEVELS:
        steps += f""",
m_{level} as (select h.{level}, sum(n) n, sum(b) b, any_value(mean) mean from {above} h group by h.{level}),
k_{level} as (select 1 / least(greatest(coalesce(case when sum(mean * (1 - mean) * n * (n - 1)) > 0
    then sum((b - n * mean) * (b - n * mean) - mean * (1 - mean) * n) / sum(mean * (1 - mean) * n * (n - 1)) end, 0), 1 / 1001.0::double), 0.5) - 1 k from m_{level}),
p_{level} as (select {level}, b + k * mean al, n - b + k * (1 - mean) be from m_{level}, k_{level}),
u_{level} as (select hosts.*, al, be, al / (al + be) mean from hosts join p_{level} using ({level}))"""
        above = f"u_{level}"
    return f"""
with cutup as (select page_id, coalesce(instr(url, '://'), 0) as pos, url from pages),
rest as (select page_id, case when pos > 0 then substr(url, pos + 3) else '' end as r from cutup),
seen as (select page_id,
    translate(regexp_extract(r, '^[^/?#]*', 0), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') host,
    regexp_extract(r, '^[^/?#]*([^?#]*)', 1) path from rest),
ruled as (select *, case {fits} end as "rule" from seen),
told as (select doc_id, max(case when quality = 0 or toxic = 1 then 1 else 0 end) bad from labels
    where doc_id is not null and (quality is not null or toxic is not null) group by doc_id),
hosts0 as (select regexp_extract(host, '^(?:.*@)?([^:]*)', 1) host, count(bad) n, coalesce(sum(bad), 0)::double b from ruled left join told on page_id = doc_id group by 1),
hosts1 as (select *, string_split(host, '.') as p, len(p) > 1 and p[-2] || '.' || p[-1] in ('{"', '".join(TWO_LABELS)}') as two from hosts0),
hosts as (select host, n, b, case when two then p[-2] || '.' || p[-1] else p[-1] end suffix,
    case when two and len(p) > 2 then p[-3] || '.' || p[-2] || '.' || p[-1] when not two and len(p) > 1 then p[-2] || '.' || p[-1] else host end as domain from hosts1),
root as (select case when sum(n) > 0 then (sum(b) + 0.2::double) / (sum(n) + 1) else 0.2::double end m from hosts){steps},
bounds as (select host, al / (al + be) p, al + be s from u_host),
bounded as (select host, round(p - 1.64::double * sqrt(p * (1 - p) / (s + 1)), 9) bound from bounds)
select page_id, ruled.host, path, "rule", coalesce(case "rule" {verdicts} end, case when bound > 0.25 then 'block' else 'allow' end) verdict,
    round(bound, 5) bad_bound
from ruled left join bounded on bounded.host = regexp_extract(ruled.host, '^(?:.*@)?([^:]*)', 1)
"""


ORACLE = _oracle()
