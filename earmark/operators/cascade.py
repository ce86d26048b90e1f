"""Early-exit cascade: fingerprint, then embedding, then cover, else unknown."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..config import DEFAULT, Thresholds


def decide(scores: DataFrame, t: Thresholds = DEFAULT) -> DataFrame:
    """scores: query_id, fp_score and fp_limit, mert_score, cover_score with their ids; a null score is a tier that did not run.

    The score of an unknown query is that of the embedding tier, even if the cover tier ran.
    """
    exact = F.coalesce(F.col("fp_score") >= F.coalesce("fp_limit", F.lit(t.fingerprint)), F.lit(False))
    near = F.coalesce(F.col("mert_score") >= t.embedding, F.lit(False))
    cover = F.coalesce(F.round("cover_score", 4) >= t.cover, F.lit(False))
    kind = F.when(exact, "EXACT_MATCH").when(near, "NEAR_MATCH").when(cover, "COVER_MATCH").otherwise("UNKNOWN")
    pick = lambda a, b, c, d: F.when(exact, F.col(a)).when(near, F.col(b)).when(cover, F.col(c)).otherwise(d)
    return scores.select(
        "query_id",
        kind.alias("match_type"),
        pick("fp_id", "mert_id", "cover_id", F.lit(None)).alias("matched_id"),
        pick("fp_score", "mert_score", "cover_score", F.coalesce("mert_score", F.lit(0.0))).alias("score"),
        F.when(exact, "FINGERPRINT").when(near, "EMBEDDING").when(cover, "COVER").otherwise("NONE").alias("stage"),
        F.when(F.col("fp_score").isNull() & F.col("mert_score").isNull(), "TIERS_UNAVAILABLE")
        .when(exact, "ABOVE_FINGERPRINT_THRESHOLD").when(near, "ABOVE_EMBEDDING_THRESHOLD").when(cover, "ABOVE_COVER_THRESHOLD")
        .otherwise("BELOW_ALL_THRESHOLDS").alias("reason"),
    )


def without(candidates: DataFrame, excluded: DataFrame) -> DataFrame:
    """Excluded (query_id, recording_id) pairs leave before any tier scores them."""
    return candidates.join(excluded, ["query_id", "recording_id"], "left_anti")
