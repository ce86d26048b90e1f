"""The stored index gives the rows of searches without one, and reads less."""

import random

import pytest
from pyspark.sql import functions as F

from earmark.operators import fingerprint, postings


def rows(spark, texts, key):
    return spark.createDataFrame([(i, p, h) for i, items in texts.items() for p, h in enumerate(items)], f"{key} long, pos int, h long")


@pytest.fixture(scope="module")
def case(spark):
    r = random.Random(3)
    hot, rare = list(range(8)), [r.randrange(1 << 32) for _ in range(3000)]
    refs = {i: [r.choice(hot) if r.random() < 0.08 else r.choice(rare) for _ in range(r.randint(1, 60))] for i in range(400)}
    refs[7], refs[8] = refs[3][:], [h ^ (1 << r.randrange(32)) for h in refs[3]]
    queries = {i: list(refs[i][2:40]) for i in range(0, 40, 2)}
    queries |= {100: hot * 4, 101: [5], 102: [r.randrange(1 << 32)], 103: [h ^ 3 for h in refs[50]], 104: [*refs[60], *refs[60]]}
    q, ref = rows(spark, queries, "query_id"), rows(spark, refs, "doc_id")
    return q, ref, postings.build(spark, "t", "case", lambda: ref, 4)


def same(a, b):
    cols = sorted(a.columns)
    return sorted(map(str, a.select(cols).collect())) == sorted(map(str, b.select(cols).collect()))


@pytest.mark.parametrize(("budget", "top"), [(1, 50), (60, 1), (60, 5), (200, 50), (10_000, 5)])
def test_pruned_candidates(case, top, budget):
    q, ref, index = case
    assert same(postings.candidates(q, index, top, budget), fingerprint.candidates(q, ref, top))


def test_full_alignment_by_neighbours(case):
    q, ref, index = case
    assert same(postings.alignment(q, index), fingerprint.alignment(q, ref))


@pytest.mark.parametrize("per_second", [1.0, 7.5])
def test_search(case, per_second):
    q, ref, index = case
    durations = q.groupBy("query_id").agg((F.count("*") / per_second).alias("duration"))
    assert same(postings.search(q, index, durations, budget=60), fingerprint.search(q, ref, durations))


def test_exclusions(case, spark):
    q, ref, index = case
    durations = q.groupBy("query_id").agg((F.count("*") / 1.0).alias("duration"))
    out = spark.createDataFrame([(0, 0), (2, 2), (2, 3), (4, 4)], "query_id long, doc_id long")
    got = {r.query_id: r.doc_id for r in postings.search(q, index, durations, excluded=out).collect()}
    assert got[0] != 0 and got[2] not in (2, 3) and got[4] != 4 and got[6] == 6


def test_ended_queries_skip_their_long_lists(case):
    q, _, index = case
    got = {r.query_id: r for r in postings.touched(q, index, 1, 60).collect()}
    early = [r for r in got.values() if r.ended and r.read < r.postings]
    assert len(early) >= 3 and all(r.read * 2 < r.postings for r in early) and got[100].read == got[100].postings


def test_references_do_not_shuffle(case):
    q, _, index = case
    plan = postings._hits(postings.plan(q, index).filter("early"), index)._jdf.queryExecution().executedPlan().toString()
    scans = [x for x in plan.splitlines() if "FileScan" in x]
    assert scans and "Bucketed: true" in plan


def test_a_search_without_a_stored_index_gives_the_same_and_writes_no_references(case, spark):
    q, ref, index = case
    whole = ref.groupBy("doc_id").agg(F.array_sort(F.collect_list(F.struct("pos", "h"))).alias("s")).select("doc_id", F.transform("s", lambda x: x["h"]).alias("items"))
    loose = postings.unstored(whole, lambda rows: rows.select("doc_id", F.size("items").cast("long").alias("n"), F.posexplode("items").alias("pos", "h")), lambda rows: rows)
    for top, budget in ((5, 60),):
        assert same(postings.candidates(q, loose, top, budget), fingerprint.candidates(q, ref, top))
    assert same(postings.touched(q, loose, 1, 60), postings.touched(q, index, 1, 60))
    assert same(postings.alignment(q, loose), fingerprint.alignment(q, ref))
    assert same(postings.alignment(q, postings.near(q, loose)), fingerprint.alignment(q, ref))
    kept = postings._asked_of(q.filter("query_id = 101"), loose).postings
    assert kept.count() == ref.filter("h = 5").count() < ref.count()
