"""Removal of repeated passages against a version that keeps every window in a dictionary."""

import hashlib
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from earmark.llm import queries, repeated_passages

DOCS = "doc_id long, text string"


def brute(rows, window=50):
    split = [(i, (t or "").encode().split()) for i, t in rows]
    least = {}
    for i, w in split:
        if i is not None:
            for s in range(len(w) - window + 1):
                key = tuple(w[s : s + window])
                least[key] = min(i, least.get(key, i))
    out = []
    for i, w in split:
        gone = np.zeros(len(w), bool)
        for s in range(len(w) - window + 1 if i is not None else 0):
            if least[tuple(w[s : s + window])] < i:
                gone[s : s + window] = True
        kept = b" ".join(x for x, g in zip(w, gone) if not g)
        out.append((i, len(w), int(gone.sum()), hashlib.sha256(kept).hexdigest()))
    return sorted(out, key=str)


def got(spark, rows):
    df = spark.createDataFrame(rows, DOCS).withColumn("shard", F.lit("x")).withColumn("words", F.lit(1)).withColumn("phrase", F.lit(2))
    return sorted(map(tuple, repeated_passages.query(df.repartition(3)).collect()), key=str)


def test_whole_table(spark, sf):
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()]
    want = brute(rows)
    assert sorted(map(tuple, queries.QUERIES["op13_repeated_passages"](spark, sf).collect()), key=str) == want
    assert sum(r[2] for r in want) > 1000


@pytest.mark.parametrize("seed", range(3))
def test_generated_texts(spark, seed):
    r = random.Random(seed)
    vocabulary = [f"w{i}" for i in range(r.choice([3, 40, 5000]))]
    pieces = [[r.choice(vocabulary) for _ in range(r.choice([49, 50, 51, 60, 90, 200]))] for _ in range(12)]
    rows = []
    for i in range(120):
        words = []
        for _ in range(r.randint(1, 6)):
            p = r.choice(pieces)
            a = r.choice([0, 0, r.randrange(len(p))])
            words += p[a : a + r.choice([30, 50, 55, 400])] if r.random() < 0.6 else [r.choice(vocabulary) for _ in range(r.randint(1, 90))]
        rows.append((r.choice([i, i, i // 2, -i]), r.choice([" ", "\n", " \t"]).join(words)))
    rows += [(500, " ".join(pieces[0])), (501, " ".join(pieces[0])), (500, " ".join(pieces[1]))]
    assert got(spark, rows) == brute(rows)


def test_odd_rows(spark, monkeypatch):
    monkeypatch.setattr(repeated_passages, "STRETCH", 1 << 20)
    same = "same " * 300
    long = " ".join(f"w{i % 977}" for i in range(30_000))
    rows = [(1, None), (2, ""), (3, " \n"), (4, same), (5, same), (5, same), (None, same), (None, None), (6, long), (7, long + " end"), (8, "é 你好 \x00 " * 40), (9, "é 你好 \x00 " * 41)]
    assert got(spark, rows) == brute(rows)
    assert got(spark, []) == []


def test_stretches_of_a_long_text(monkeypatch):
    r = np.random.default_rng(1)
    hashes = r.integers(0, 1 << 63, 5000).astype(np.uint64)
    monkeypatch.setattr(repeated_passages, "STRETCH", 700)
    seen = []
    for s, e in repeated_passages._stretches(5000, 50):
        _, _, start, count = repeated_passages.blocks(hashes[s:e], np.array([e - s]), 50)
        seen += [s + x for a, n in zip(start, count) for x in range(a, a + n)]
    assert seen == list(range(4951))


def test_removed_text_stays_readable(spark):
    rows = [(1, " ".join(f"a{i}" for i in range(60))), (2, "before " + " ".join(f"a{i}" for i in range(60)) + " after")]
    out = {r.doc_id: r for r in repeated_passages.strip(spark.createDataFrame(rows, DOCS)).collect()}
    assert out[2].kept == "before after" and out[2].n_removed == 60 and out[2].gone and not out[1].gone


def test_automaton_keeps_the_least_owner():
    a = repeated_passages.Automaton([(b"x y z", 5), (b"x y z", 3), (b"y z q", 9)])
    assert a.covered(b"x y z q".split(), 4).tolist() == [True, True, True, False]
    assert a.covered(b"x y z q".split(), 3) is None
    assert a.covered(b"x y z q".split(), 10).tolist() == [True] * 4
