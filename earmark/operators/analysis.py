"""From the windows of a long input to a decision, in waves.

Wave i holds the i-th window of every input that has no exact match so far, so windows after the first exact one are never
evaluated. Within a wave the tiers run one after the other, each on what the tiers before left open. A wave is an
ordinary batch of queries: all inputs of it are searched at once, and there are as many waves as the
plan has windows at most.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..config import DEFAULT, Thresholds
from ..sources import store
from . import cascade

Tier = Callable[[DataFrame], DataFrame]


def wave(rows: DataFrame, fingerprints: Tier, embeddings: Tier, covers: Tier, t: Thresholds = DEFAULT) -> DataFrame:
    """Decisions of the windows in rows (query_id, job, window_idx, ...).

    Tiers give (query_id, id, score) for the rows they get, the first one also ``limit``. The columns vec_ran and cover_ran say
    which tiers ran; the first one always does.
    """
    fp = store.cut(fingerprints(rows).select("query_id", F.col("id").alias("fp_id"), F.col("score").alias("fp_score"), F.col("limit").alias("fp_limit")))
    exact = fp.filter("fp_score >= fp_limit").select("query_id")
    open_ = rows.join(exact, "query_id", "left_anti")
    vec = store.cut(embeddings(open_).select("query_id", F.col("id").alias("mert_id"), F.col("score").alias("mert_score")))
    near = vec.filter(F.col("mert_score") >= t.embedding).select("query_id")
    left = open_.join(near, "query_id", "left_anti")
    cov = covers(left).select("query_id", F.col("id").alias("cover_id"), F.col("score").alias("cover_score"))
    ran = rows.select("query_id", "job", "window_idx").join(open_.select("query_id", F.lit(True).alias("vec_ran")), "query_id", "left")
    ran = ran.join(left.select("query_id", F.lit(True).alias("cover_ran")), "query_id", "left")
    for part in (fp, vec, cov):
        ran = ran.join(part, "query_id", "left")
    kept = ran.select("query_id", "job", "window_idx", F.coalesce("vec_ran", F.lit(False)).alias("vec_ran"), F.coalesce("cover_ran", F.lit(False)).alias("cover_ran"))
    return kept.join(cascade.decide(ran, t), "query_id")


def scan(windows: DataFrame, fingerprints: Tier, embeddings: Tier, covers: Tier, most: int = 8, t: Thresholds = DEFAULT) -> DataFrame:
    """Decisions of all windows that are evaluated: windows (query_id, job, window_idx, ...), window_idx from 0 below ``most``."""
    done: DataFrame | None = None
    for i in range(most):
        rows = windows.filter(F.col("window_idx") == i)
        if done is not None:
            rows = rows.join(done.filter("match_type = 'EXACT_MATCH'").select("job"), "job", "left_anti")
        rows = store.cut(rows)
        if rows.isEmpty():
            break
        out = store.cut(wave(rows, fingerprints, embeddings, covers, t))
        done = out if done is None else done.unionByName(out)
    return done if done is not None else wave(windows, fingerprints, embeddings, covers, t)


def counts(scanned: DataFrame) -> DataFrame:
    """(job, scanned, vec_windows, cover_windows, stopped_early, windows): what each input cost and the record of its windows."""
    record = F.array_sort(F.collect_list(F.struct("window_idx", F.col("match_type").alias("type"), "stage", F.round("score", 4).alias("score"))))
    return scanned.groupBy("job").agg(
        F.count("*").alias("scanned"), F.count_if("vec_ran").alias("vec_windows"), F.count_if("cover_ran").alias("cover_windows"),
        F.bool_or(F.col("match_type") == "EXACT_MATCH").alias("stopped_early"), record.alias("windows"),
    )


def response(x: DataFrame) -> DataFrame:
    """(job, response): one nested document a job from decided rows ``d`` with their match, rights and ``counts``."""
    c = F.col
    return x.select("job", F.struct(
        F.struct(c("title").alias("track"), "artist", c("rid").alias("recording_id"), "composition_id").alias("identity"),
        F.struct(c("match_type").alias("type"), F.round("identity_confidence", 4).alias("confidence"), c("stage").alias("pipeline_stage")).alias("match"),
        F.struct(
            c("license_type").alias("license"), "copyright_status", "attribution_required", "commercial_use_allowed", "monetization_allowed",
            c("rights_source").alias("source"), c("has_rights").alias("rights_found"), c("rights_predicted").alias("predicted"),
        ).alias("rights"),
        F.struct(c("d.risk").alias("risk"), c("d.category").alias("category"), c("d.condition").alias("condition"), "identity_confidence", "rights_confidence", c("d.decision_confidence").alias("decision_confidence")).alias("assessment"),
        c("action").alias("recommendation"),
        F.struct("windows", c("scanned").alias("windows_scanned"), "stopped_early").alias("evidence"),
    ).alias("response"))
