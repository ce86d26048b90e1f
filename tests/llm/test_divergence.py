"""Divergence of sources against dictionaries and fractions of whole numbers."""

import re
from collections import Counter

from pyspark.sql import functions as F

from earmark.llm import divergence

TERM = re.compile(divergence.TERM)
A_Z = str.maketrans(divergence.UPPER, divergence.LOWER)
DOCS = "doc_id long, text string, lang string, source string"


def brute(rows, least=10, top=10):
    n, d, groups = Counter(), Counter(), set()
    for _, text, lang, source in rows:
        lang, source = lang or "", source or ""
        groups.add((lang, source))
        terms = TERM.findall((text or "").translate(A_Z))
        n.update((lang, source, t) for t in terms)
        d.update((lang, t) for t in set(terms))
    out = []
    for lang in {g[0] for g in groups}:
        kept = sorted(t for (la, t), c in d.items() if la == lang and c >= least)
        sources = sorted(s for la, s in groups if la == lang)

        def shares(counts, kept=kept):
            total = sum(counts.values())
            return {t: 1 + 10**9 * (counts[t] + 2) // (total + 2 * len(kept)) for t in kept}

        p = {s: shares({t: n[lang, s, t] for t in kept}) for s in sources}
        q = shares({t: sum(n[lang, s, t] for s in sources) for t in kept})

        def gap(x, y):
            return (x - y) ** 2 // (x + y)

        for s in sources:
            pair = [(o, sum(gap(p[s][t], p[o][t]) for t in kept)) for o in sources if o != s]
            term = [(t, gap(p[s][t], q[t])) for t in kept if n[lang, s, t] > 0 and p[s][t] > q[t]]
            for part, items, limit in (("pair", pair, None), ("term", term, top)):
                ranked = sorted(items, key=lambda x: (-x[1], x[0].encode()))[:limit]
                out += [(lang, s, part, item, value, i) for i, (item, value) in enumerate(ranked, 1)]
    return sorted(out)


def got(df, **options):
    return sorted(map(tuple, divergence.audit(df, **options).collect()))


def test_small_tables(spark):
    words = ["the", "The", "of", "É", "é", "straße", "x1y", "na\x00me", "\U0001f600", "über"]
    rows = [(i, " ".join(words[(i * k + k // 3) % len(words)] for k in range(i % 17)), ["en", "de", None, ""][i % 4], ["a", "b", "c", None][i // 4 % 4]) for i in range(200)]
    rows += [(1, None, "en", "a"), (None, "the", None, None), (5, "", "only", "one"), (6, "", "two", "one"), (6, "?!", "two", "other"), (7, "the " * 40000, "en", "a")]
    df = spark.createDataFrame(rows, DOCS).withColumn("term", F.lit("x")).withColumn("n", F.lit(1)).withColumn("total", F.lit(1))
    want = brute(rows)
    assert got(df) == want and {r[2] for r in want} == {"pair", "term"}
    assert ("two", "one", "pair", "other", 0, 1) in want
    assert got(df, least_docs=3, top_terms=2) == brute(rows, 3, 2)
    assert got(df.limit(0)) == []


def test_shares_beyond_a_long(spark):
    big = 900_000_000_000_000
    row = spark.range(1).select(divergence._share(F.lit(big), F.lit(3 * big), F.lit(7)).alias("p")).first()
    assert row.p == 1 + 10**9 * (big + 2) // (3 * big + 14)


def test_terms_are_counted_as_bytes(spark, monkeypatch):
    """Texts are split and counted in batches, in tables of bounded size, not as a row a term."""
    monkeypatch.setattr(divergence, "HELD", 7)
    rows = [(i, f"Aé {chr(0x40 + i % 50)}x-{i % 3}y\x7f\U0001f600 Z{'z' * (i % 5)}", "en", "ab"[i % 2]) for i in range(120)]
    df = spark.createDataFrame(rows, DOCS)
    _, counts = divergence.term_counts(df)
    plan = counts._jdf.queryExecution().executedPlan().toString()
    assert "MapInArrow" in plan and "Generate" not in plan
    assert got(df) == brute(rows)
