"""Registry of unidentified items: listing, statistics, matching, learned features, upsert."""

from __future__ import annotations


import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..config import DEFAULT, Thresholds
from ..functions.text import found

SORTS = {"last_seen": ("last_seen_at",), "first_seen": ("first_seen_at",), "count": ("sighting_count", "last_seen_at")}
UUID = r"^[0-9a-fA-F]{8}(-[0-9a-fA-F]{4}){3}-[0-9a-fA-F]{12}$"


def classify(match_type: Column, risk: Column, recording_id: Column) -> Column:
    """Kind of unknown: not identified, identified with unknown rights, or null (known, or a tier did not run)."""
    return F.when(match_type == "UNKNOWN", "NOT_IDENTIFIED").when((risk == "UNKNOWN") & recording_id.isNotNull(), "RIGHTS_UNKNOWN")


def wanted(kind: str | None = None, status: str | None = None, q: str | None = None, columns: tuple[str, ...] = ("title",)) -> Column:
    """The conjunction of the filters that are given; q is an id or part of a text."""
    import re

    out = F.lit(True)
    if kind:
        out = out & (F.col("kind") == kind)
    if status:
        out = out & (F.col("review_status") == status)
    if q:
        own = F.col("unknown_id") == q if re.match(UUID, q) else F.lit(False)
        out = out & (own | found(F.lit(q), *[F.col(c) for c in columns]))
    return out


def page(df: DataFrame, sort: str, limit: int, offset: int, tie: str) -> DataFrame:
    """A page in a whitelisted order, unique ids breaking ties."""
    return df.orderBy(*[F.desc(c) for c in SORTS[sort]], tie).offset(offset).limit(limit)


def entries(sightings: DataFrame) -> DataFrame:
    """Counters and snapshot of each entry from its sightings."""
    last = lambda c: F.max_by(c, F.struct("seen_at", "sighting_id"))
    return sightings.groupBy("unknown_id").agg(
        F.min("seen_at").alias("first_seen_at"), F.max("seen_at").alias("last_seen_at"), F.count("*").alias("sighting_count"),
        last("platform").alias("last_platform"), last("match_score").alias("last_score"),
    )


def last_sightings(sightings: DataFrame, n: int = 50) -> DataFrame:
    w = Window.partitionBy("unknown_id").orderBy(F.desc("seen_at"), F.desc("sighting_id"))
    return sightings.withColumn("place", F.row_number().over(w)).filter(F.col("place") <= n)


def by_day(sightings: DataFrame, today: str, days: int = 30, offset_minutes: int = 0) -> DataFrame:
    """Sightings per local date over a spine of days, empty days included."""
    spine = sightings.sparkSession.range(1).select(
        F.explode(F.sequence(F.date_sub(F.lit(today).cast("date"), days - 1), F.lit(today).cast("date"))).alias("day")
    )
    local = F.to_date(F.col("seen_at") + F.make_interval(mins=F.lit(offset_minutes)))
    counts = sightings.groupBy(local.alias("day")).agg(F.count("*").alias("n"))
    return spine.join(counts, "day", "left").select(F.col("day").cast("string").alias("day"), F.coalesce("n", F.lit(0)).alias("n"))


def counts_by(df: DataFrame, column: str) -> DataFrame:
    return df.groupBy(F.coalesce(column, F.lit("—")).alias("value")).agg(F.count("*").alias("n"))


def recent_features(features: DataFrame, entries_: DataFrame, model_version: str, most: int = 500) -> DataFrame:
    """Features of the entries seen last that have no identity, of one model version."""
    recent = entries_.filter("kind = 'NOT_IDENTIFIED'").orderBy(F.desc("last_seen_at"), "unknown_id").limit(most).select("unknown_id")
    return features.filter(F.col("model_version") == model_version).join(recent, "unknown_id", "left_semi")


def match_entry(fp: DataFrame, mert: DataFrame, cover: DataFrame, t: Thresholds = DEFAULT) -> DataFrame:
    """Entry of each query: by fingerprint, else embedding, else cover; each (query_id, unknown_id, score[, threshold])."""

    def best(df: DataFrame, ok: Column, method: str, order: int) -> DataFrame:
        w = Window.partitionBy("query_id").orderBy(F.desc("score"), "unknown_id")
        top = df.filter(ok).withColumn("__r", F.row_number().over(w)).filter("__r = 1")
        return top.select("query_id", "unknown_id", "score", F.lit(method).alias("method"), F.lit(order).alias("__order"))

    got = (
        best(fp, F.col("score") >= F.col("threshold"), "FINGERPRINT", 0)
        .unionByName(best(mert, F.col("score") >= t.embedding, "EMBEDDING", 1))
        .unionByName(best(cover, F.col("score") >= t.cover, "COVER", 2))
    )
    return got.groupBy("query_id").agg(F.min_by(F.struct("unknown_id", "score", "method"), "__order").alias("m")).select("query_id", "m.*")


def novel(features: DataFrame, threshold: float, room: int, noise: np.ndarray | None = None) -> DataFrame:
    """Greedy choice within each entry, in order: a segment is kept if no kept one is as near as the threshold.

    Segments as near to a noise prototype are dropped first. An entry's features are
    bounded by ``room`` kept rows; the fold is inherently ordered, so an entry is one group.
    """

    def fold(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["seg_start", "vec_id"])
        kept: list[np.ndarray] = []
        rows = []
        for row in pdf.itertuples():
            v = np.asarray(row.embedding, np.float64)
            if noise is not None and len(noise) and (noise @ v).max() >= threshold:
                continue
            if len(kept) < room and (not kept or (np.stack(kept) @ v).max() < threshold):
                kept.append(v)
                rows.append((row.entry, row.vec_id))
        return pd.DataFrame(rows, columns=["entry", "vec_id"])

    return features.select("entry", "vec_id", "seg_start", "embedding").groupBy("entry").applyInPandas(fold, "entry long, vec_id long")


def noise_like(features: DataFrame, prototypes: DataFrame, threshold: float) -> DataFrame:
    """features (vec_id, embedding) with ``noise``: whether a prototype (embedding) is as near as the threshold.

    Prototypes are a handful of rows by definition; they are brought to the driver as a parameter of the expression."""
    rows = [[float(x) for x in r["embedding"]] for r in prototypes.select("embedding").collect()]
    dot = lambda p: F.aggregate(F.zip_with("embedding", F.array(*[F.lit(x) for x in p]), lambda a, b: a.cast("double") * b), F.lit(0.0), lambda s, x: s + x)
    near = F.greatest(*[dot(p) for p in rows], F.lit(-2.0), F.lit(-2.0))
    return features.withColumn("noise", near >= threshold)


def keyed(sightings: DataFrame, links: DataFrame) -> DataFrame:
    """Entry key of each sighting, when sightings and the links among them are known: the first of its linked group."""
    return sightings.join(links, "sighting_id", "left").withColumn("entry", F.coalesce("entry", "sighting_id"))


def upsert(state: DataFrame, sightings: DataFrame) -> DataFrame:
    """State after a batch of keyed sightings: counters add up, the last sighting gives the snapshot, a hint stays if the new one is null."""
    last = lambda c: F.max_by(c, F.struct("seen_at", "sighting_id"))
    new = sightings.groupBy("unknown_id").agg(
        F.min("seen_at").alias("n_first"), F.max("seen_at").alias("n_last"), F.count("*").alias("n_count"), last("platform").alias("n_platform"),
        F.max_by("hint", F.when(F.col("hint").isNotNull(), F.struct("seen_at", "sighting_id"))).alias("n_hint"),
    )
    newer = F.col("last_seen_at").isNull() | (F.col("n_last") >= F.col("last_seen_at"))
    return state.join(new, "unknown_id", "full").select(
        "unknown_id",
        F.least("first_seen_at", "n_first").alias("first_seen_at"), F.greatest("last_seen_at", "n_last").alias("last_seen_at"),
        (F.coalesce("sighting_count", F.lit(0)) + F.coalesce("n_count", F.lit(0))).alias("sighting_count"),
        F.when(newer & F.col("n_platform").isNotNull(), F.col("n_platform")).otherwise(F.col("last_platform")).alias("last_platform"),
        F.coalesce(F.when(newer, F.col("n_hint")), "hint", "n_hint").alias("hint"),
    )


STATE = "unknown_id long, first_seen_at timestamp_ntz, last_seen_at timestamp_ntz, sighting_count long, last_platform string, hint long"


def reviewed(entries_: DataFrame, updates: DataFrame) -> DataFrame:
    """Partial updates: a field counts if ``set_<field>`` is true, blank text clears it; the time follows the status."""
    u = updates.select("unknown_id", *[F.col(c).alias(f"u_{c}") for c in updates.columns if c != "unknown_id"])
    joined = entries_.join(u, "unknown_id", "left")

    def field(c: str) -> Column:
        given = F.coalesce(F.col(f"u_set_{c}"), F.lit(False))
        return F.when(given, F.nullif(F.trim(f"u_{c}"), F.lit(""))).otherwise(F.col(c)).alias(c)

    status = F.coalesce("u_review_status", "review_status")
    at = F.when(F.col("u_review_status").isNull(), F.col("reviewed_at")).when(F.col("u_review_status") == "PENDING", None).otherwise(F.col("u_at"))
    rest = [c for c in entries_.columns if c not in ("review_title", "review_note", "review_status", "reviewed_at")]
    return joined.select(*rest, field("review_title"), field("review_note"), status.alias("review_status"), at.alias("reviewed_at"))


def admitted(events: DataFrame, limit: int = 10, seconds: int = 60) -> DataFrame:
    """Sliding-window admission per key: at most ``limit`` admitted events in (now - seconds, now]; refused ones don't count.

    Greedy in time order. After a gap of ``seconds`` nothing is remembered, so the stretches between gaps are dealt out apart; sorted
    events stream through a partition, and only the last ``limit`` admitted times are held, however many events a key has.
    """
    us = F.unix_micros(F.col("ts").cast("timestamp"))
    order = Window.partitionBy("key").orderBy("ts", "event_id")
    gap = us - F.lag(us).over(order) >= seconds * 1_000_000
    stretch = F.sum(F.coalesce(gap, F.lit(False)).cast("int")).over(order.rowsBetween(Window.unboundedPreceding, 0))

    def run(frames):
        from collections import deque

        at, recent = None, deque()
        for pdf in frames:
            ok, wait = [], []
            for key, part, now in zip(pdf["key"], pdf["stretch"], pdf["now"]):
                if (key, part) != at:
                    at, recent = (key, part), deque()
                while recent and recent[0] <= now - seconds * 1_000_000:
                    recent.popleft()
                ok.append(len(recent) < limit)
                wait.append(0 if ok[-1] else max(1, -(-(seconds * 1_000_000 - (now - recent[0])) // 1_000_000)))
                if ok[-1]:
                    recent.append(now)
            yield pd.DataFrame({"event_id": pdf["event_id"], "key": pdf["key"], "admitted": ok, "retry_after": wait})

    rows = events.select("event_id", "key", "ts", us.alias("now")).withColumn("stretch", stretch).drop("ts")
    rows = rows.repartition("key", "stretch").sortWithinPartitions("key", "stretch", "now", "event_id")
    return rows.mapInPandas(run, "event_id long, key long, admitted boolean, retry_after long")
