"""Blocks that meet give the scores of the alignment by rows."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from earmark.operators import fingerprint, meetings
from earmark.plans import catalogue
from earmark.sources import adapters


@pytest.fixture(scope="module")
def texts():
    r = random.Random(5)
    hot, rare = list(range(6)), [r.randrange(1 << 32) for _ in range(2000)]
    out = {i: [r.choice(hot) if r.random() < 0.1 else r.choice(rare) for _ in range(r.randint(1, 50))] for i in range(200)}
    out[7], out[8], out[9] = out[4][:], [h ^ (1 << r.randrange(32)) for h in out[4]], [h ^ 0x80000001 for h in out[4]]
    return out | {300: [3] * 70, 304: [3] * 40 + [7], 308: [0, (1 << 32) - 1]}


@pytest.mark.parametrize(("least", "limits"), [(0.1, (10**6, 10**6, 10**6)), (0.1, (300, 200, 50)), (0.5, (300, 4000, 7))])
def test_pairs_equal_alignment(spark, monkeypatch, texts, least, limits):
    for name, value in zip(("QUERY_ITEMS", "REFERENCE_ITEMS", "PAIRS"), limits):
        monkeypatch.setattr(meetings, name, value)
    seq = spark.createDataFrame([(i, i % 4 == 0, x) for i, x in texts.items()], "doc_id long, asked boolean, items array<long>")
    items = seq.select("doc_id", F.posexplode("items").alias("pos", "h"))
    want = fingerprint.alignment(items.filter("doc_id % 4 = 0").withColumnRenamed("doc_id", "query_id"), items).filter(F.col("score") >= least)
    got = sorted(map(tuple, meetings.close(seq, least).collect()))
    assert got == sorted(map(tuple, want.collect())) and len(got) > 50


def test_neighbours_come_once(spark):
    r = random.Random(1)
    h = [r.randrange(1 << 32) for _ in range(40)]
    h = sorted({x ^ f for x in h for f in (0, 1, 1 << 31, 3 << 10, 1 << 11 | 1 << 22, 7)})
    signed = np.array(h, np.uint32).view(np.int32).tolist()
    df = spark.createDataFrame([(x, i % 2 == 0) for i, x in enumerate(signed)], "h int, asked boolean")
    got = [tuple(x) for x in meetings.neighbours(df).collect()]
    assert sorted(got) == sorted((signed[i], signed[j]) for i in range(0, len(h), 2) for j in range(len(h)) if (h[i] ^ h[j]).bit_count() <= 2)


def test_held_out_documents_meet_in_blocks(spark, sf):
    """No row for each two equal items: what leaves the meeting of two blocks are pairs of texts."""
    plan = catalogue.QUERIES["heldout_exclusions"](spark, sf)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("MapInArrow") >= 1 and "bit_count" not in plan


def test_short_sequences_equal_sequences(spark):
    texts = ["a b c", "a b", "", None, "  Ein  Wort\tund\nnoch EINS \r\n", "İstanbul ΣΑΣ straße \u00a0x y\u2003z", "日本 語 の 文 章", "x " * 3000, "w" * 200 + " v u t"]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    want = {x.doc_id: [h - (1 << 31) for h in x["items"]] for x in adapters.sequences(df, "doc_id", "doc_id").collect()}
    got = {x.doc_id: list(x["items"]) for x in adapters.short_sequences(df, "doc_id").collect()}
    assert got == want and len(got) >= 6


def test_hashes_are_dealt_packed(spark, monkeypatch):
    """A task deals its hashes in at most one row a group, however many there are."""
    seen = []
    first = meetings._near

    def spied(df, values, bits):
        seen.append(sum(1 for _ in first(df, values, bits)._jdf.queryExecution().analyzed().toString().split("Generate")) - 1)
        return first(df, values, bits)

    monkeypatch.setattr(meetings, "_near", spied)
    seq = spark.createDataFrame([(i, i % 4 == 0, [i * 31 + j for j in range(50)]) for i in range(40)], "doc_id long, asked boolean, items array<long>")
    assert meetings.close(seq, 0.1).count() > 0 and seen == [0]
