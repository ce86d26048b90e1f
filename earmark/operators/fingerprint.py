"""Search by aligned hash sequences.

Candidates come from an inverted-index equi-join on whole hashes. Alignment counts,
for each offset, item pairs whose hashes differ in at most two bits. That theta join
is run as an equi-join too: 32 bits are cut into five chunks, and hashes that differ
in at most two bits agree in three of them, so pairs meet on 18 to 20 bits and are
verified by population count; the first agreeing choice alone reports a pair.
"""

from __future__ import annotations

from itertools import combinations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..config import DEFAULT, NOISE_FLOOR, NOISE_MARGIN, Thresholds

THREE = ((0, 11), (11, 11), (22, 10))
FIVE = ((0, 7), (7, 7), (14, 6), (20, 6), (26, 6))


def min_score(duration: Column, t: Thresholds = DEFAULT) -> Column:
    """Acceptance threshold for a query of some seconds: the noise floor with its margin, never below the base."""
    floor = F.lit(NOISE_FLOOR[-1][1])
    for (x0, y0), (x1, y1) in reversed(list(zip(NOISE_FLOOR, NOISE_FLOOR[1:]))):
        floor = F.when(duration < x1, y0 + (duration - x0) * ((y1 - y0) / (x1 - x0))).otherwise(floor)
    floor = F.when(duration <= NOISE_FLOOR[0][0], NOISE_FLOOR[0][1]).otherwise(floor)
    return F.when(F.coalesce(duration, F.lit(0)) <= 0, t.fingerprint).otherwise(
        F.greatest(F.lit(t.fingerprint), floor * NOISE_MARGIN)
    )


def hash_hits(q: DataFrame, r: DataFrame) -> DataFrame:
    """Histogram of equal (query item, reference item) pairs; repeats multiply.

    Both sides are counted by hash first, so a hash that is everywhere meets as one row a text.
    """
    a = q.groupBy("query_id", "h").agg(F.count("*").alias("n"))
    b = r.groupBy("doc_id", "h").agg(F.count("*").alias("m"))
    return a.join(b, "h").groupBy("query_id", "doc_id").agg(F.sum(F.col("n") * F.col("m")).alias("hits"))


def candidates(q: DataFrame, r: DataFrame, top: int) -> DataFrame:
    w = Window.partitionBy("query_id").orderBy(F.desc("hits"), "doc_id")
    return hash_hits(q, r).withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= top)


def _masks(chunks: tuple, agree: int) -> list[int]:
    """Bits of each choice of ``agree`` chunks."""
    return [sum(((1 << n) - 1) << at for at, n in some) for some in combinations(chunks, agree)]


def _chunked(df: DataFrame, keys: list[str], masks: list[int]) -> DataFrame:
    parts = [F.struct(F.lit(i).alias("c"), F.col("h").bitwiseAND(F.lit(m)).alias("x")) for i, m in enumerate(masks)]
    return df.select(*keys, F.explode(F.array(*parts)).alias("k")).select(*keys, "k.c", "k.x")


def alignment(q: DataFrame, r: DataFrame, pairs: DataFrame | None = None, max_bits: int = 2, hits: bool = False) -> DataFrame:
    """(query_id, doc_id, score[, hits]): pairs on the best offset over the shorter length; pairs limits what is compared.

    hits: pairs of equal items at any offset.

    Of max_bits + 3 chunks, three agree; of max_bits + 1, one does, which is enough where
    the query is part of the key.
    """
    q, r = _counted(q, "query_id"), _counted(r, "doc_id")
    masks = _masks(FIVE, 3) if pairs is None else _masks(THREE, 1)
    if max_bits > 2:
        raise ValueError("hashes that differ in more than two bits need more chunks")
    a = q.select("query_id", F.col("pos").alias("i"), "h", F.col("n").alias("nq"))
    a = _chunked(a, ["query_id", "i", "h", "nq"], masks).withColumnRenamed("h", "ha")
    b = r.select("doc_id", F.col("pos").alias("j"), "h", F.col("n").alias("nr"))
    if pairs is not None:
        b = b.join(pairs.select("query_id", "doc_id"), "doc_id")
        met = _chunked(b, ["query_id", "doc_id", "j", "h", "nr"], masks).join(a, ["query_id", "c", "x"])
    else:
        met = _chunked(b, ["doc_id", "j", "h", "nr"], masks).join(a, ["c", "x"])
    differ = F.col("ha").bitwiseXOR(F.col("h"))
    first = F.lit(len(masks))
    for i, m in reversed(list(enumerate(masks))):
        first = F.when(differ.bitwiseAND(F.lit(m)) == 0, i).otherwise(first)
    best = (
        met.filter((F.bit_count(differ) <= max_bits) & (F.col("c") == first))
        .groupBy("query_id", "doc_id", (F.col("i") - F.col("j")).alias("off"))
        .agg(F.count("*").alias("count"), F.count_if(differ == 0).alias("equal"), F.min(F.least("nq", "nr")).alias("n"))
        .groupBy("query_id", "doc_id").agg(F.max("count").alias("best"), F.sum("equal").alias("hits"), F.min("n").alias("n"))
    )
    return best.select("query_id", "doc_id", F.round(F.col("best") / F.col("n"), 6).alias("score"), *(["hits"] if hits else []))


def _counted(items: DataFrame, key: str) -> DataFrame:
    """Items with the number ``n`` of those of their key, where they don't carry it."""
    return items if "n" in items.columns else items.join(items.groupBy(key).agg(F.count("*").alias("n")), key)


def verdicts(scores: DataFrame, durations: DataFrame, t: Thresholds = DEFAULT) -> DataFrame:
    """Best reference of each query (ties to the smaller id) and its verdict."""
    best = scores.groupBy("query_id").agg(F.max_by("doc_id", F.struct("score", -F.col("doc_id"))).alias("doc_id"), F.max("score").alias("score"))
    limit = F.round(min_score(F.col("duration"), t), 6)
    return durations.join(best, "query_id", "left").select(
        "query_id", "doc_id", F.coalesce("score", F.lit(0.0)).alias("score"), limit.alias("threshold"),
        F.when(F.col("score") >= limit, "EXACT_MATCH").otherwise("UNKNOWN").alias("match_type"),
    )


def search(q: DataFrame, r: DataFrame, durations: DataFrame, t: Thresholds = DEFAULT) -> DataFrame:
    """Prefiltered search: the references with most equal items count; for short queries and those near the threshold, all do.

    Equal items are among those the alignment meets, so one pass over the references gives the prefilter, the scores
    of its candidates and those of the fallback.
    """
    scores = alignment(q, r, None, t.max_bit_error, hits=True)
    mine = Window.partitionBy("query_id")
    rank = F.row_number().over(mine.orderBy(F.desc("hits"), "doc_id"))
    scores = scores.withColumn("fast", (F.col("hits") > 0) & (rank <= t.prefilter_top))
    scores = scores.withColumn("best", F.coalesce(F.max(F.when(F.col("fast"), F.col("score"))).over(mine), F.lit(0.0)))
    near = (F.col("duration") < t.prefilter_min_seconds) | (F.abs(F.col("best") - min_score(F.col("duration"), t)) <= t.prefilter_band)
    kept = scores.join(durations, "query_id").filter(F.col("fast") | near)
    return verdicts(kept.select("query_id", "doc_id", "score"), durations, t)


def within_duration(pairs: DataFrame, window: float) -> DataFrame:
    """Pairs whose lengths differ by at most the window; off at 0 or when either is missing or 0."""
    if window <= 0:
        return pairs
    a, b = F.coalesce("q_duration", F.lit(0)), F.coalesce("r_duration", F.lit(0))
    return pairs.filter((a == 0) | (b == 0) | (F.abs(a - b) <= window))


def plausible(n: Column, duration: Column) -> Column:
    """4 s - 20 <= n <= 12 s + 20 for s = min(duration, 120) > 0; null is implausible."""
    s = F.least(duration, F.lit(120.0))
    return F.coalesce((s > 0) & n.between(4 * s - 20, 12 * s + 20), F.lit(False))


def change_signature(df: DataFrame, id_: str) -> DataFrame:
    return df.agg(F.count("*").alias("n"), F.min(id_).alias("first_id"), F.max(id_).alias("last_id"))


def variants(seqs: DataFrame) -> DataFrame:
    """(id, kind, items): cropped, shifted, bit-flipped and thinned forms of item sequences, as fixtures of known truth."""
    x = F.col("items")
    n = F.size(x)
    kinds = {
        "original": x,
        "crop": F.slice(x, F.floor(n / 4).cast("int") + 1, F.greatest(F.floor(n / 2).cast("int"), F.lit(1))),
        "shift": F.concat(F.array(F.lit(0).cast("bigint"), F.lit(1).cast("bigint")), x),
        "flip": F.transform(x, lambda v, i: v.bitwiseXOR(F.call_function("shiftleft", F.lit(1).cast("bigint"), F.pmod(v + i, F.lit(32)).cast("int")))),
        "thin": F.filter(x, lambda v, i: i % 5 != 4),
    }
    rows = F.array(*[F.struct(F.lit(k).alias("kind"), c.alias("items")) for k, c in kinds.items()])
    return seqs.filter(n > 0).select("id", F.explode(rows).alias("r")).select("id", "r.kind", "r.items")
