"""Overlap join by bins against all pairs."""

import random

from pyspark.sql import functions as F

from earmark.operators import windows


def brute(left, right):
    out = []
    for sa, q, s, e in left:
        for sb, r, t, f in right:
            if sa == sb and e > s and f > t:
                share = round(max(0.0, min(e, f) - max(s, t)) / min(e - s, f - t), 6)
                if share >= 0.5:
                    out.append((sa, q, r, share))
    return sorted(out)


def test_all_lengths(spark):
    r = random.Random(3)

    def spans(n):
        out = []
        for i in range(n):
            s = r.choice([r.uniform(-50, 50), float(r.randrange(-20, 20)), 0.0])
            out.append((r.randrange(2), i, s, s + r.choice([0.0, -1.0, 1.0, 2.0, 4.0, 0.001, r.uniform(0, 8), r.uniform(0, 300)])))
        return out

    left, right = spans(150), spans(170)
    right += [(0, 900 + i, s, e) for i, (_, _, s, e) in enumerate(left[:20])]
    a, b = spark.createDataFrame(left, "source long, q long, s double, e double"), spark.createDataFrame(right, "source long, r long, s double, e double")
    got = sorted(map(tuple, windows.overlapping(a, b).collect()))
    assert [g[:3] for g in got] == [w[:3] for w in brute(left, right)] and len(got) > 300
    assert windows.overlapping(a.limit(0), b).count() == 0


def test_one_source_of_many_spans(spark):
    """300,000 spans of one source: each meets its neighbours only."""
    a = spark.range(300_000).select(F.lit(1).alias("source"), F.col("id").alias("q"), (F.col("id") * 1.0).alias("s"), (F.col("id") + 2.0).alias("e"))
    got = windows.overlapping(a, a.withColumnRenamed("q", "r"))
    assert got.count() == 3 * 300_000 - 2
