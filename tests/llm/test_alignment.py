"""Alignment of two tokenizers against whole-text encoding and dictionaries."""

import hashlib
from collections import Counter

import numpy as np
import sentencepiece
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from earmark.llm import alignment, queries

ODD = [
    "", "a", " a", "  two  blanks ", "tab\tand\nlines\n\n and\r\n", "café 你好 \U0001f600 é", "nul \x00 and \x1c sep \x85 nel \xa0 nbsp 　 wide",
    "<|endoftext|> <s> </s> <unk> <0x41>", "block ▁ is lost", "don't I'll we've 'S it''s", "x" * 5000, "a b c d e f g " * 900, " ", "\n", "▁",
    "don 't x 's 12 34,5 -- ... !!! a​b ﻿z", "ﬁ ① Ａ",
]


def whole(text):
    tok = Tokenizer.from_file(queries.BYTE_TOKENIZER)
    tok.encode_special_tokens = True
    sp = sentencepiece.SentencePieceProcessor(model_file=queries.PIECE_TOKENIZER)
    letters = alignment._byte_letters()
    names = {i: t for t, i in tok.get_vocab().items()}
    if not text:
        return None
    a, b = tok.encode(" " + text, add_special_tokens=False).ids, sp.encode(text)
    ab = [bytes(letters[c] for c in names[i]) for i in a]
    bb = [alignment.Pair._piece(sp.id_to_piece(i)) for i in b]
    want = (" " + text).encode()
    if b"".join(ab) != want or b"".join(bb) != want:
        return None
    return a, np.cumsum([len(x) for x in ab]), b, np.cumsum([len(x) for x in bb])


def brute(rows, encode=whole):
    docs, held = [], Counter()
    for i, t in rows:
        e = encode(t)
        groups, links = [], []
        if e:
            a, ae, b, be = e
            x = y = 0
            for c in sorted(set(ae.tolist()) & set(be.tolist())):
                ga, gb = [], []
                while x < len(a) and ae[x] <= c:
                    ga.append(a[x])
                    x += 1
                while y < len(b) and be[y] <= c:
                    gb.append(b[y])
                    y += 1
                groups.append((ga, gb))
                links += [(p, q) for p in ga for q in gb]
            assert x == len(a) and y == len(b)
        held.update(set(links))
        docs.append((i, e, groups, links))
    most = {}
    for (p, _), n in held.items():
        most[p] = max(most.get(p, 0), n)
    out = []
    for i, e, groups, links in docs:
        text = ";".join(",".join(map(str, x)) + "|" + ",".join(map(str, y)) for x, y in groups)
        out.append((i, len(e[0]) if e else 0, len(e[2]) if e else 0, len(groups), len(links), sum(held[x] == most[x[0]] for x in links),
                    sum(held[x] for x in links), hashlib.sha256(text.encode()).hexdigest() if e else ""))
    return sorted(out, key=str)


def got(df):
    return sorted(map(tuple, df.collect()), key=str)


def test_chunks_give_the_tokens_of_whole_texts(spark, sf):
    texts = ODD + [r.text for r in spark.read.parquet(f"{sf}/documents.parquet").select("text").collect()][:60]
    pair = alignment.Pair(queries.BYTE_TOKENIZER, queries.PIECE_TOKENIZER)
    for _ in range(2):
        for t, f in zip(texts, pair.encode(texts)):
            w = whole(t)
            assert (f is None) == (w is None), t
            if f:
                assert [list(x) for x in f] == [list(x) for x in w], t


def test_no_piece_joins_across_a_blank():
    sp = sentencepiece.SentencePieceProcessor(model_file=queries.PIECE_TOKENIZER)
    assert not [p for p in map(sp.id_to_piece, range(sp.get_piece_size())) if "▁" in p.lstrip("▁")]


def test_odd_rows(spark, monkeypatch):
    monkeypatch.setattr(alignment, "CHUNK_BYTES", 3000)
    rows = [(i, t) for i, t in enumerate(ODD)] + [(1, "a"), (1, "a b"), (None, "a b"), (None, "a b"), (7, None)]
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumn("chunk", F.lit("x")).withColumn("pair", F.lit(1)).withColumn("row", F.lit(1))
    assert got(alignment.align(df, queries.BYTE_TOKENIZER, queries.PIECE_TOKENIZER)) == brute(rows)
    assert got(alignment.align(df.limit(0), queries.BYTE_TOKENIZER, queries.PIECE_TOKENIZER)) == []


def test_whole_table(spark, sf):
    pair = alignment.Pair(queries.BYTE_TOKENIZER, queries.PIECE_TOKENIZER)
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()]
    assert got(queries.QUERIES["op11_alignment"](spark, sf)) == brute(rows, lambda t: pair.encode([t or ""])[0])


def test_only_texts_chunk_by_chunk_shuffle(spark, sf):
    rows = spark.read.parquet(f"{sf}/documents.parquet").limit(5).select(F.lit(0).alias("chunk"), "doc_id", "text")
    plan = alignment.aligned(alignment.tokenise(rows, queries.BYTE_TOKENIZER, queries.PIECE_TOKENIZER), 32000)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("MapInArrow") == 1 and "PythonUDF" not in plan


def test_groups_are_cut_once_a_chunk(spark, sf, monkeypatch):
    """No array of a whole text's tokens leaves the tokenizers: the plan cuts no ends, and chunks met before are not cut again."""
    rows = spark.read.parquet(f"{sf}/documents.parquet").limit(5).select(F.lit(0).alias("chunk"), "doc_id", "text")
    plan = alignment.aligned(alignment.tokenise(rows, queries.BYTE_TOKENIZER, queries.PIECE_TOKENIZER), 32000)._jdf.queryExecution().executedPlan().toString()
    assert "array_intersect" not in plan and "array_except" not in plan
    pair = alignment.Pair(queries.BYTE_TOKENIZER, queries.PIECE_TOKENIZER)
    first = pair.describe(["the cat sat on 12 mats", "the cat \U0001f600"])
    monkeypatch.setattr(pair, "grouped", None)
    again = pair.describe(["the cat sat on 12 mats", "the cat \U0001f600"])
    assert all(np.array_equal(x, y) for x, y in zip(first, again)) and len(first[2]) > 5
