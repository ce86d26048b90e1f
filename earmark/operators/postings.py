"""Inverted index over hash sequences, stored or read from the references, and a search that reads the postings of its queries only.

``build`` writes three tables once for a set of references: ``lists`` (one row a hash: number of
references that hold it, highest count in one), ``postings`` (one row a place of a hash in a reference),
both bucketed and sorted by hash, and ``sequences`` (one row a reference), bucketed by
reference. Searches join on the bucketing column, so references never shuffle.

``unstored`` is for one search: writing all postings costs more than it saves there. Postings are read
from the references, and only those of the hashes asked are kept; sequences are made of the references asked.

Prefilter. The k references with most equal items are found without reading the long lists of
most queries. Lists are taken rarest first up to a budget of postings a query; a
reference outside them gains at most ``rest``, the sum of what the other lists can give. Where the k-th of the
references seen has more than that, none unseen can pass it: the query ends early, and the hits of those
that still may are completed from their sequences. Only the other queries read their long lists.

Full scan. Hashes within two bits of an item are 529, so a full alignment of a query is an
equi-join of its items' neighbours with the postings: the queries grow, not the references. It runs for short queries
and those near the threshold alone.
"""

from __future__ import annotations

from collections.abc import Callable
from itertools import combinations
from typing import NamedTuple

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..config import DEFAULT, Thresholds
from ..sources import store
from . import fingerprint

#: Postings a query reads before it looks whether it may end.
BUDGET = 20_000


class Index(NamedTuple):
    """lists: None where they are to be counted from the postings; sequences: (doc_id, items) of given (doc_id)."""

    lists: DataFrame | None
    postings: DataFrame
    sequences: Callable[[DataFrame], DataFrame]


def _placed(sequences: DataFrame) -> DataFrame:
    return sequences.select("doc_id", F.size("items").alias("size"), F.posexplode("items").alias("pos", "h"))


def _lists(postings: DataFrame) -> DataFrame:
    counts = postings.groupBy("h", "doc_id").agg(F.count("*").alias("m"))
    return counts.groupBy("h").agg(F.count("*").alias("length"), F.max("m").cast("int").alias("most"))


def build(spark: SparkSession, name: str, signature: str, references, buckets: int) -> Index:
    """The index of references() (doc_id, pos, h); ``signature`` tells one set of references from another."""

    def sequences():
        items = references()
        return items.groupBy("doc_id").agg(F.array_sort(F.collect_list(F.struct("pos", "h"))).alias("s")).select("doc_id", F.transform("s", lambda x: x["h"]).alias("items"))

    seq = store.bucketed(spark, f"{name}_sequences", signature, sequences, "doc_id", buckets)
    post = store.bucketed(spark, f"{name}_postings", signature, lambda: _placed(seq), "h", buckets, ("doc_id",))
    lists = store.bucketed(spark, f"{name}_lists", signature, lambda: _lists(post), "h", buckets)
    return Index(lists, post, lambda ids: seq.join(ids, "doc_id", "left_semi"))


def unstored(references: DataFrame, items: Callable[[DataFrame], DataFrame], sequences: Callable[[DataFrame], DataFrame]) -> Index:
    """The index of references (doc_id, ...), whose items() are (doc_id, pos, h, n) and whose sequences() are (doc_id, items); nothing is written but
    what a search asks for. Sequences are written before they are exploded, or Spark makes them once more to drop empty ones."""
    post = items(references).select("doc_id", F.col("n").cast("int").alias("size"), "pos", "h")
    return Index(None, post, lambda ids: store.cut(sequences(references.join(store.cut(ids), "doc_id", "left_semi"))))


def _asked_of(q: DataFrame, index: Index) -> Index:
    """The index with the lists of the hashes of q alone, where lists are not stored."""
    if index.lists is not None:
        return index
    post = store.cut(index.postings.join(store.cut(q.select("h").distinct()), "h", "left_semi"))
    return Index(_lists(post), post, index.sequences)


def near(q: DataFrame, index: Index, max_bits: int = 2) -> Index:
    """The index with the postings that a full alignment of q meets, for many alignments of parts of q."""
    post = store.cut(index.postings.join(store.cut(_neighbours(q, max_bits).select("h").distinct()), "h", "left_semi"))
    return Index(None, post, index.sequences)


def _asked(q: DataFrame, index: Index) -> DataFrame:
    """(query_id, h, n, length, gain): items of a query by the list they stand in; gain is the most hits one reference gets by it."""
    mine = q.groupBy("query_id", "h").agg(F.count("*").alias("n"))
    return mine.join(index.lists, "h").select("query_id", "h", "n", "length", (F.col("n") * F.col("most")).alias("gain"))


def plan(q: DataFrame, index: Index, budget: int = BUDGET) -> DataFrame:
    """The lists of each query with ``early``: those to read first, rarest first up to the budget, the rarest in any case."""
    index = _asked_of(q, index)
    w = Window.partitionBy("query_id").orderBy("length", "h")
    before = F.coalesce(F.sum("length").over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    return _asked(q, index).withColumn("early", (before == 0) | (before + F.col("length") <= budget))


def candidates(q: DataFrame, index: Index, top: int, budget: int = BUDGET) -> DataFrame:
    """(query_id, doc_id, hits, rank) of the ``top`` references with most equal items, as ``fingerprint.candidates`` gives them."""
    index = _asked_of(q, index)
    lists = store.cut(plan(q, index, budget))
    rest = lists.groupBy("query_id").agg(F.coalesce(F.sum(F.when(~F.col("early"), F.col("gain"))), F.lit(0)).alias("rest"))
    hits = store.cut(_hits(lists.filter("early"), index))
    place = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("hits")))
    bar = hits.withColumn("place", place).filter(F.col("place") == top).select("query_id", F.col("hits").alias("bar"))
    state = store.cut(rest.join(bar, "query_id", "left").withColumn("ended", (F.col("rest") == 0) | F.coalesce(F.col("bar") > F.col("rest"), F.lit(False))))

    # nothing unseen can pass the bar: complete those that still may from their own sequences
    may = hits.join(state.filter("ended"), "query_id").filter((F.col("rest") == 0) | (F.col("hits") + F.col("rest") >= F.col("bar"))).select("query_id", "doc_id", "hits")
    late = lists.filter("not early")
    own = store.cut(may.join(late.select("query_id").distinct(), "query_id", "left_semi").select("query_id", "doc_id"))
    own = own.join(index.sequences(own.select("doc_id").distinct()), "doc_id")
    more = own.select("query_id", "doc_id", F.explode("items").alias("h")).join(late.select("query_id", "h", "n"), ["query_id", "h"])
    ended = may.unionByName(more.select("query_id", "doc_id", F.col("n").alias("hits")))
    # the others, if there are any, read their long lists too
    opened = late.join(state.filter("not ended"), "query_id", "left_semi")
    rows = ended.unionByName(hits.join(state.filter("not ended"), "query_id", "left_semi")).unionByName(_hits(opened, index))
    total = rows.groupBy("query_id", "doc_id").agg(F.sum("hits").alias("hits"))
    w = Window.partitionBy("query_id").orderBy(F.desc("hits"), "doc_id")
    return total.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= top)


def _hits(lists: DataFrame, index: Index) -> DataFrame:
    rows = lists.select("query_id", "h", "n").join(index.postings, "h")
    return rows.groupBy("query_id", "doc_id").agg(F.sum("n").alias("hits"))


def touched(q: DataFrame, index: Index, top: int, budget: int = BUDGET) -> DataFrame:
    """(query_id, lists, postings, read, ended): what a query's lists hold and what its search reads of them."""
    index = _asked_of(q, index)
    lists = plan(q, index, budget)
    hits = _hits(lists.filter("early"), index)
    place = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("hits")))
    bar = hits.withColumn("place", place).filter(F.col("place") == top).select("query_id", F.col("hits").alias("bar"))
    sums = lists.groupBy("query_id").agg(
        F.count("*").alias("lists"), F.sum("length").alias("postings"), F.sum(F.when(F.col("early"), F.col("length")).otherwise(0)).alias("first"),
        F.sum(F.when(F.col("early"), 0).otherwise(F.col("gain"))).alias("rest"))
    ended = (F.col("rest") == 0) | F.coalesce(F.col("bar") > F.col("rest"), F.lit(False))
    return sums.join(bar, "query_id", "left").select("query_id", "lists", "postings", F.when(ended, F.col("first")).otherwise(F.col("postings")).alias("read"), ended.alias("ended"))


def _flips(bits: int = 2) -> list[int]:
    """All 32-bit numbers with at most ``bits`` ones: zero first."""
    return [sum(1 << b for b in some) for n in range(bits + 1) for some in combinations(range(32), n)]


def _neighbours(q: DataFrame, max_bits: int) -> DataFrame:
    """(query_id, i, nq, h): all hashes within so many bits of each query item."""
    flips = F.array(*[F.lit(x).cast("long") for x in _flips(max_bits)])
    rows = fingerprint._counted(q, "query_id").select("query_id", F.col("pos").alias("i"), F.col("n").alias("nq"), "h", F.explode(flips).alias("flip"))
    return rows.select("query_id", "i", "nq", F.col("h").bitwiseXOR(F.col("flip")).alias("h"))


def alignment(q: DataFrame, index: Index, max_bits: int = 2) -> DataFrame:
    """(query_id, doc_id, score) against all references: the neighbours of each query item meet the postings."""
    near = store.cut(_neighbours(q, max_bits))  # its size is known then, and a small one meets the postings without a shuffle of them
    met = near.join(index.postings, "h").select("query_id", "doc_id", F.least("nq", F.col("size").cast("long")).alias("shorter"), "i", F.col("pos").alias("j"))
    at = met.groupBy("query_id", "doc_id", (F.col("i") - F.col("j")).alias("off")).agg(F.count("*").alias("count"), F.min("shorter").alias("shorter"))
    best = at.groupBy("query_id", "doc_id").agg(F.max("count").alias("best"), F.min("shorter").alias("shorter"))
    return best.select("query_id", "doc_id", F.round(F.col("best") / F.col("shorter"), 6).alias("score"))


def candidate_scores(q: DataFrame, index: Index, pairs: DataFrame, max_bits: int = 2) -> DataFrame:
    """Alignment of given pairs only; the references' items come from their sequences."""
    wanted = pairs.select("doc_id").distinct()
    items = index.sequences(wanted).select("doc_id", F.size("items").cast("long").alias("n"), F.posexplode("items").alias("pos", "h"))
    return fingerprint.alignment(q, items, pairs, max_bits)


def search(q: DataFrame, index: Index, durations: DataFrame, t: Thresholds = DEFAULT, excluded: DataFrame | None = None, budget: int = BUDGET) -> DataFrame:
    """Prefiltered search with its fallback; rows equal ``fingerprint.search``.

    excluded (query_id, doc_id): references a query must not find, in neither search.
    """

    def allowed(rows: DataFrame) -> DataFrame:
        return rows if excluded is None else rows.join(excluded, ["query_id", "doc_id"], "left_anti")

    if excluded is None:
        some = candidates(q, index, t.prefilter_top, budget)
    else:
        # so many more that the excluded ones leave enough
        most = excluded.groupBy("query_id").count().agg(F.max("count")).first()[0] or 0
        more = allowed(candidates(q, index, t.prefilter_top + most, budget))
        w = Window.partitionBy("query_id").orderBy(F.desc("hits"), "doc_id")
        some = more.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= t.prefilter_top)
    fast = store.cut(candidate_scores(q, index, store.cut(some.select("query_id", "doc_id")), t.max_bit_error))
    best = durations.join(fast.groupBy("query_id").agg(F.max("score").alias("best")), "query_id", "left")
    gap = F.abs(F.coalesce("best", F.lit(0.0)) - fingerprint.min_score(F.col("duration"), t))
    again = best.filter((F.col("duration") < t.prefilter_min_seconds) | (gap <= t.prefilter_band)).select("query_id")
    again = store.cut(again)
    slow = allowed(alignment(q.join(again, "query_id", "left_semi"), index, t.max_bit_error))
    scores = fast.join(again, "query_id", "left_anti").unionByName(slow)
    return fingerprint.verdicts(scores, durations, t)
