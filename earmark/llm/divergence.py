"""Divergence of each source from the other sources of its language, term by term, in whole numbers.

Terms are the matches of one pattern, which in UTF-8 are runs of letters A-Z and bytes from 0x80 on: Arrow batches are
translated and split as bytes, and counted in a bounded table. Counts by (lang, source, term) are summed
before they shuffle. A language keeps the terms of at least ``least_docs`` of its
documents. Groups meet the kept vocabulary of their language, so terms a group
lacks count as zeros, and a self-join on language and term adds up the divergence of
each pair of sources; a ranking window closes.

Hot languages and sources: what shuffles is one row a group and term at most, dealt by
language *and* term; the densifying join deals a language's vocabulary out by a salt,
for which its groups are repeated.

Nulls in text, lang and source count as empty strings, so null and '' are one group; a
null doc_id changes nothing, and each row is a document, repeated rows included. Empty and
term-less documents still make their group occur. Very long texts are split whole. Equal
values rank by the item's UTF-8 bytes. An empty table gives no rows. Other columns are not read.
"""

from __future__ import annotations

from collections import Counter
from itertools import count

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import LOWER, UPPER, cut, give_back

TERM = r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+"
#: The bytes of a text with A-Z lower-cased and a blank for each byte outside TERM.
LETTERS = bytes(b + 32 if 65 <= b <= 90 else b if 97 <= b <= 122 or b >= 128 else 32 for b in range(256))
#: Terms a task counts before it hands them on.
HELD = 400_000
SCALE = 1_000_000_000
SALTS = 32


def _share(count: Column, total: Column, terms: Column) -> Column:
    """1 + floor(SCALE * (count + 2) / (total + 2 * terms)), exact also where the product passes a long."""
    num = (count + 2).cast("decimal(20,0)") * F.lit(SCALE).cast("decimal(10,0)")
    den = (total + 2 * terms).cast("decimal(20,0)")
    return 1 + F.call_function("div", num, den)


def _gap(p: Column, q: Column) -> Column:
    return F.call_function("div", (p - q) * (p - q), p + q)


def _named(docs: DataFrame) -> DataFrame:
    return docs.select(*[F.coalesce(c, F.lit("")).alias(c) for c in ("lang", "source", "text")])


def numbered(docs: DataFrame) -> tuple[DataFrame, Column]:
    """(lang, source, g) of each group that occurs, and the expression of g: one number in place of two strings in each key."""
    groups = cut(_named(docs).select("lang", "source").distinct(), parts=8)
    for seed in count():
        g = F.xxhash64(F.lit(seed), "lang", "source")
        groups = groups.withColumn("g", g)
        if groups.agg(F.count("*") == F.count_distinct("g")).first()[0]:
            return groups, g


def term_counts(docs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Groups, and occurrences n and documents d of each term by (lang, source)."""
    groups, g = numbered(docs)
    schema = pa.schema([("g", pa.int64()), ("term", pa.binary()), ("n", pa.int64()), ("d", pa.int64())])

    def run(batches):
        held: dict[int, tuple[Counter, Counter]] = {}
        room = 0

        def table():
            for number, (n, d) in held.items():
                # each term that occurs is in a document
                yield pa.RecordBatch.from_arrays([pa.array([number] * len(d), pa.int64()), pa.array(d.keys(), pa.binary()), pa.array([n[t] for t in d], pa.int64()), pa.array(d.values(), pa.int64())], schema=schema)
            held.clear()

        for batch in batches:
            for number, text in zip(batch.column("g").to_pylist(), batch.column("text")):
                n, d = held.setdefault(number, (Counter(), Counter()))
                before = len(d)
                terms = text.as_py().translate(LETTERS).split()
                n.update(terms)
                d.update(set(terms))
                room += len(d) - before
                if room > HELD:
                    yield from table()
                    room = 0
        yield from table()
        give_back()

    rows = _named(docs).select(g.alias("g"), F.col("text").cast("binary").alias("text")).mapInArrow(run, "g long, term binary, n long, d long")
    counts = rows.groupBy("g", F.col("term").cast("string").alias("term")).agg(F.sum("n").alias("n"), F.sum("d").alias("d"))
    return groups, counts.join(groups, "g").select("lang", "source", "term", "n", "d")


def audit(docs: DataFrame, *, least_docs: int = 10, top_terms: int = 10) -> DataFrame:
    """Rows (lang, source, part, item, value, rank): divergence from each other source, and the terms that stand out most."""
    groups, counts = term_counts(docs)
    counts = cut(counts)
    kept = cut(counts.groupBy("lang", "term").agg(F.sum("n").alias("lang_n"), F.sum("d").alias("d")).filter(F.col("d") >= least_docs).drop("d"))
    langs = kept.groupBy("lang").agg(F.count("*").alias("terms"), F.sum("lang_n").alias("lang_total"))
    held = cut(counts.join(kept, ["lang", "term"], "left_semi").select("lang", "source", "term", "n"))
    totals = held.groupBy("lang", "source").agg(F.sum("n").alias("total"))
    groups = cut(groups.join(totals, ["lang", "source"], "left").select("lang", "source", F.coalesce("total", F.lit(0)).alias("total")), parts=8)

    salt = F.pmod(F.xxhash64("term"), F.lit(SALTS)).cast("int")
    spread = groups.join(langs, "lang").withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    dense = kept.withColumn("salt", salt).join(spread, ["lang", "salt"]).drop("salt").join(held, ["lang", "source", "term"], "left")
    n = F.coalesce("n", F.lit(0))
    dense = cut(dense.select("lang", "term", "source", n.alias("n"), _share(n, F.col("total"), F.col("terms")).alias("p"),
                             _share(F.col("lang_n"), F.col("lang_total"), F.col("terms")).alias("q")))

    # the gap is the same both ways: each pair of sources is summed once
    one = dense.select("lang", "term", "source", "p")
    other = dense.select("lang", "term", F.col("source").alias("item"), F.col("p").alias("p2"))
    sums = one.join(other, ["lang", "term"]).filter(F.col("source") < F.col("item"))
    sums = sums.groupBy("lang", "source", "item").agg(F.sum(_gap(F.col("p"), F.col("p2"))).alias("value"))
    sums = sums.unionByName(sums.select("lang", F.col("item").alias("source"), F.col("source").alias("item"), "value"))
    others = groups.select("lang", F.col("source").alias("item"))
    pairs = groups.join(others, "lang").filter(F.col("source") != F.col("item")).join(sums, ["lang", "source", "item"], "left")
    pairs = pairs.select("lang", "source", F.lit("pair").alias("part"), "item", F.coalesce("value", F.lit(0)).alias("value"))

    order = Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item")
    pairs = pairs.withColumn("rank", F.row_number().over(order))
    terms = dense.filter((F.col("n") > 0) & (F.col("p") > F.col("q")))
    terms = terms.select("lang", "source", F.lit("term").alias("part"), F.col("term").alias("item"), _gap(F.col("p"), F.col("q")).alias("value"))
    terms = terms.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= top_terms)
    return pairs.unionByName(terms)


ORACLE = rf"""
WITH d AS (SELECT coalesce(lang, '') AS lang, coalesce(source, '') AS source,
             regexp_extract_all(translate(coalesce(text, ''), '{UPPER}', '{LOWER}'), '{TERM}') AS terms FROM documents),
c AS (SELECT lang, source, term, count(*) AS n FROM (SELECT lang, source, unnest(terms) AS term FROM d) GROUP BY ALL),
k AS (SELECT lang, term FROM (SELECT lang, unnest(list_distinct(terms)) AS term FROM d) GROUP BY ALL HAVING count(*) >= 10),
g AS (SELECT DISTINCT lang, source FROM d),
x AS (SELECT g.lang, g.source, k.term, coalesce(c.n, 0)::HUGEINT AS n FROM g JOIN k USING (lang) LEFT JOIN c USING (lang, source, term)),
y AS (SELECT *, sum(n) OVER (PARTITION BY lang, source) AS total, count(*) OVER (PARTITION BY lang, source) AS v,
        sum(n) OVER (PARTITION BY lang, term) AS ln, sum(n) OVER (PARTITION BY lang) AS ltotal FROM x),
z AS (SELECT lang, source, term, n, 1 + (1000000000::HUGEINT * (n + 2)::HUGEINT) // (total + 2 * v)::HUGEINT AS p,
        1 + (1000000000::HUGEINT * (ln + 2)::HUGEINT) // (ltotal + 2 * v)::HUGEINT AS q FROM y),
s AS (SELECT a.lang, a.source, b.source AS item, sum(((a.p - b.p) * (a.p - b.p)) // (a.p + b.p)) AS value
      FROM z a JOIN z b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source GROUP BY ALL),
r AS (SELECT g.lang, g.source, 'pair' AS part, o.source AS item, coalesce(s.value, 0)::BIGINT AS value
      FROM g JOIN g o ON g.lang = o.lang AND g.source <> o.source LEFT JOIN s ON s.lang = g.lang AND s.source = g.source AND s.item = o.source),
t AS (SELECT lang, source, 'term' AS part, term AS item, (((p - q) * (p - q)) // (p + q))::BIGINT AS value FROM z WHERE n > 0 AND p > q),
u AS (SELECT *, row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item)::INT AS rank FROM (SELECT * FROM r UNION ALL SELECT * FROM t))
SELECT lang, source, part, item, value, rank FROM u WHERE part = 'pair' OR rank <= 10
"""
