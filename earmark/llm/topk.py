"""Exact top-k by inner product with norm-bucketed retrieval.

Vectors are grouped by length into bands, bands into buckets of bounded size (rows of
one length are salted over several buckets). A pilot of the longest vectors, bounded
by ``pilot_rows``, gives every query a first threshold; a query is sent only to the
bands whose length can still reach it. In a bucket, candidates are walked from the
longest: the threshold over query length times chunk length is the local cosine
threshold. Above 1 the chunk is pruned by length; when it is high, the largest query
coordinates plus a Cauchy-Schwarz bound on the others prune candidates; else the
whole product is taken. What remains is verified by the integer product, so results
are exact. Ties go to the smaller id.

Vectors that are null or hold nulls, NaN or infinities take no part; shorter vectors
count as filled up with zeros; a repeated query id is asked once, repeated rows all
stay candidates, rows with the query's id are its own; vectors whose products could
pass 64 bits are refused; an empty table gives no rows; other columns are not read.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

OUT = "query_id long, vec_id long, score long"


def quantised(vectors: DataFrame, scale: int = 256) -> DataFrame:
    """vec_id, v (array of long) and norm of the rows that take part."""
    x = F.col("embedding")
    whole = x.isNotNull() & F.forall(
        x, lambda e: e.isNotNull() & ~F.isnan(e.cast("double")) & (F.abs(e.cast("double")) < float("inf"))
    )
    q = F.transform(x, lambda e: F.floor(e.cast("double") * scale))
    square = lambda a, e: a + e.cast("double") * e.cast("double")
    return (
        vectors.select("vec_id", "embedding")
        .filter(F.coalesce(whole, F.lit(False)))
        .select("vec_id", q.alias("v"))
        .withColumn("norm", F.sqrt(F.aggregate("v", F.lit(0.0), square)))
    )


def _matrix(vs: pd.Series, width: int) -> np.ndarray:
    out = np.zeros((len(vs), width), np.int64)
    for i, v in enumerate(vs):
        out[i, : len(v)] = v
    return out


def _products(q: np.ndarray, c: np.ndarray) -> np.ndarray:
    """Exact integer products; through floating point where 53 bits hold every sum."""
    most = int(np.abs(q).max(initial=0)) * int(np.abs(c).max(initial=0)) * max(q.shape[1], 1)
    if most < 1 << 53:
        return (q.astype(np.float64) @ c.astype(np.float64).T).astype(np.int64)
    return q @ c.T


def _best(rows: np.ndarray, k: int) -> np.ndarray:
    """The k best of (query, id, score) rows by query; best first, ties to the smaller id."""
    rows = rows[np.lexsort((rows[:, 1], -rows[:, 2], rows[:, 0]))]
    first = np.flatnonzero(np.r_[True, rows[1:, 0] != rows[:-1, 0]])
    rank = np.arange(len(rows)) - np.repeat(first, np.diff(np.r_[first, len(rows)]))
    return rows[rank < k]


def _walk(qid, q, cid, c, k: int, floor, chunk: int = 1024, block: int = 512) -> np.ndarray:
    """Best k of the candidates for each query; floor: scores that are surely reached elsewhere."""
    if not len(qid) or not len(cid):
        return np.empty((0, 3), np.int64)
    length = np.sqrt((c.astype(np.float64) ** 2).sum(1))
    order = np.argsort(-length, kind="stable")
    cid, c, length = cid[order], c[order], length[order]
    out = []
    for b in range(0, len(qid), block):
        ids, qs, limit = qid[b : b + block], q[b : b + block], floor[b : b + block].astype(np.float64).copy()
        qlen = np.sqrt((qs.astype(np.float64) ** 2).sum(1))
        got = np.empty((0, 3), np.int64)
        for s in range(0, len(cid), chunk):
            cs, at = c[s : s + chunk], cid[s : s + chunk]
            live = np.flatnonzero(qlen * length[s] >= limit - 0.5)
            if not len(live):
                break  # later chunks are shorter still
            with np.errstate(divide="ignore", invalid="ignore"):
                cosine = np.median(limit[live] / (qlen[live] * length[s]))
            qi = qs[live]
            keep = np.arange(len(at))
            if cosine > 0.6 and q.shape[1] > 8:
                lead = np.argsort(-np.abs(qi).sum(0))[: q.shape[1] // 4]
                rest = np.setdiff1d(np.arange(q.shape[1]), lead)
                part = qi[:, lead].astype(np.float64) @ cs[:, lead].astype(np.float64).T
                qr = np.sqrt((qi[:, rest].astype(np.float64) ** 2).sum(1))
                cr = np.sqrt((cs[:, rest].astype(np.float64) ** 2).sum(1))
                keep = np.flatnonzero((part + np.outer(qr, cr) * (1 + 1e-9) >= limit[live][:, None] - 0.5).any(0))
            score = _products(qi, cs[keep])
            hit = (score >= limit[live][:, None]) & (at[keep][None, :] != ids[live][:, None])
            if not hit.any():
                continue
            i, j = np.nonzero(hit)
            new = np.stack([live[i], at[keep][j], score[i, j]], 1)
            got = _best(np.concatenate([got, new]), k)
            counts = np.bincount(got[:, 0], minlength=len(ids))
            full = np.flatnonzero(counts >= k)
            last = np.cumsum(counts) - 1
            limit[full] = np.maximum(limit[full], got[last[full], 2])
        if len(got):
            out.append(np.stack([ids[got[:, 0]], got[:, 1], got[:, 2]], 1))
    return np.concatenate(out) if out else np.empty((0, 3), np.int64)


def _places(band: int, parts: int) -> Column:
    return F.transform(F.sequence(F.lit(0), F.lit(parts - 1)), lambda i: F.struct(F.lit(band).alias("band"), i.alias("part")))


def search(
    vectors: DataFrame,
    asked: Column,
    *,
    k: int = 5,
    bands: int = 8,
    bucket_rows: int = 8192,
    query_rows: int = 16384,
    pilot_rows: int = 1024,
) -> DataFrame:
    """query_id, rank, vec_id, score: the k highest products of each asked row with all other rows."""
    spark = vectors.sparkSession
    rows = quantised(vectors)
    facts = rows.agg(
        F.count("*").alias("n"), F.count_if(asked).alias("asked"), F.max(F.size("v")).alias("width"), F.max("norm").alias("top"),
        F.percentile_approx("norm", [i / bands for i in range(1, bands)], 1000).alias("cuts"),
    ).first()
    n, width = facts["n"], facts["width"] or 0
    if (facts["top"] or 0.0) ** 2 >= 2.0**63:
        raise OverflowError("products of these vectors pass 64 bits")
    cuts = sorted(set(facts["cuts"] or []))
    band = F.lit(0)
    for c in cuts:
        band = band + (F.col("norm") > c).cast("int")
    rows = rows.withColumn("band", band)
    # at most ``bands`` rows, and at most ``pilot_rows`` vectors
    sizes = {r["band"]: (r["n"], r["top"]) for r in rows.groupBy("band").agg(F.count("*").alias("n"), F.max("norm").alias("top")).collect()}
    pilot = rows.orderBy(F.desc("norm"), "vec_id").limit(pilot_rows).select("vec_id", "v").toPandas()
    pid, pv = pilot["vec_id"].to_numpy(np.int64), _matrix(pilot["v"], width)

    def first_floor(batches):
        for pdf in batches:
            q, ids = _matrix(pdf["v"], width), pdf["vec_id"].to_numpy(np.int64)
            score = _products(q, pv).astype(np.float64)
            score[ids[:, None] == pid[None, :]] = -np.inf
            low = np.partition(score, -k, 1)[:, -k] if len(pid) >= k else np.full(len(q), -np.inf)
            yield pdf.assign(floor=low)

    queries = rows.filter(asked).dropDuplicates(["vec_id"])
    queries = queries.select("vec_id", "v", "norm").mapInPandas(first_floor, "vec_id long, v array<long>, norm double, floor double")
    parts = {b: -(-m // bucket_rows) for b, (m, _) in sizes.items()}
    blocks = max(1, -(-facts["asked"] // query_rows))
    reach = [
        F.when(F.col("norm") * float(top) >= F.col("floor") - 0.5, _places(b, parts[b]))
        .otherwise(F.array().cast("array<struct<band:int,part:int>>"))
        for b, (_, top) in sorted(sizes.items())
    ]
    if not reach:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score long")
    sent = queries.withColumn("block", F.pmod(F.xxhash64("vec_id"), F.lit(blocks)).cast("int")).select(
        "vec_id", "v", "floor", "block", F.explode(F.concat(*reach)).alias("to")
    ).select("vec_id", "v", "floor", "block", "to.band", "to.part")
    by_band = F.create_map(*[F.lit(x) for b, p in sorted(parts.items()) for x in (b, p)])
    filed = rows.select(
        "vec_id", "v", "band",
        F.pmod(F.xxhash64("vec_id", "v"), by_band[F.col("band")]).cast("int").alias("part"),
        F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))).alias("block"),
    )

    def meet(asking: pd.DataFrame, there: pd.DataFrame) -> pd.DataFrame:
        got = _walk(
            asking["vec_id"].to_numpy(np.int64), _matrix(asking["v"], width),
            there["vec_id"].to_numpy(np.int64), _matrix(there["v"], width),
            k, asking["floor"].to_numpy(np.float64),
        )
        return pd.DataFrame(got, columns=["query_id", "vec_id", "score"])

    key = ["band", "part", "block"]
    found = sent.groupBy(*key).cogroup(filed.groupBy(*key)).applyInPandas(meet, OUT)
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    return found.withColumn("rank", rank).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


ORACLE = """
with v as (select vec_id, [floor(256 * x::double)::bigint for x in embedding] as v from embeddings
    where embedding is not null and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0),
s as (select q.vec_id as query_id, c.vec_id, list_dot_product(q.v::double[], c.v::double[])::bigint as score
    from v q join v c on q.vec_id % 50 = 0 and q.vec_id <> c.vec_id),
r as (select *, row_number() over (partition by query_id order by score desc, vec_id)::int as "rank" from s)
select query_id, "rank", vec_id, score from r where "rank" <= 5
"""
