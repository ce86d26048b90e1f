"""Multi-source merge, pruning, relabelling, sampling, quality checks."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def merge(sources: list[DataFrame], key: str) -> DataFrame:
    """Union of sources with one row a key: the first source wins, then its first row (``row_no``)."""
    tagged = [s.withColumn("__p", F.lit(i)) for i, s in enumerate(sources)]
    rows = reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), tagged)
    w = Window.partitionBy(key).orderBy("__p", "row_no")
    return rows.withColumn("__r", F.row_number().over(w)).filter("__r = 1").drop("__r", "__p")


def last_by_key(df: DataFrame, key: str, order: str) -> DataFrame:
    """The last row of each key in input order."""
    w = Window.partitionBy(key).orderBy(F.desc(order))
    return df.withColumn("__r", F.row_number().over(w)).filter("__r = 1").drop("__r")


def prune(child: DataFrame, parent: DataFrame, key: str) -> DataFrame:
    return child.join(parent.select(key).distinct(), key, "left_semi")


def relabelled(df: DataFrame, column: str, when: Column, value: Column) -> DataFrame:
    """``changed`` marks rows whose value is not what it was."""
    new = F.when(when, value).otherwise(F.col(column))
    return df.withColumn("__new", new).withColumn("changed", ~F.col("__new").eqNullSafe(F.col(column))).drop(column).withColumnRenamed("__new", column)


#: The sources whose rows are relabelled, and the label of simulated rows.
SIMULATED_SET, DECLARED_SET = "dataset_G_vietnam_100k_api", "MTG-Jamendo"
SIMULATED_SOURCE = "SIMULATED (dataset_G_vietnam_100k_api: tên bài, ID Spotify và cờ quyền là dữ liệu tổng hợp, chưa đối chiếu nguồn thật)"
VERIFIED_SETS = ("FMA",)


def relabelled_recordings(rows: DataFrame) -> DataFrame:
    """recordings with metadata_verified as their dataset says; ``changed`` marks rows that were not so."""
    return relabelled(rows, "metadata_verified", F.lit(True), F.coalesce(F.col("source_dataset").isin(*VERIFIED_SETS), F.lit(False)))


def relabelled_rights(rows: DataFrame, now_year: int) -> DataFrame:
    """rights (with their recording's source_dataset and release_year): simulated rows lose their check and get creator
    flags that exclude each other, and too young recordings are not free; a nan label gets its text. ``changed`` marks rows
    that are no longer what they were."""
    from .rights import creator_flags, publisher_source, recording_pd_plausible

    simulated = F.coalesce(F.col("source_dataset") == SIMULATED_SET, F.lit(False))
    young = simulated & F.coalesce(F.col("recording_public_domain"), F.lit(False)) & ~recording_pd_plausible(F.col("release_year"), now_year)
    bought, agreed = creator_flags(F.col("license_type"), F.col("revenue_share_required"))
    nan = ~simulated & (F.trim("source") == "Spotify API / nan")
    new = {
        "source": F.when(simulated, SIMULATED_SOURCE).when(nan, publisher_source(F.lit(None).cast("string"))).otherwise(F.col("source")),
        "verified_at": F.when(~simulated, F.col("verified_at")),
        "license_purchased": F.when(simulated, bought).otherwise(F.col("license_purchased")),
        "revenue_share_agreed": F.when(simulated, agreed).otherwise(F.col("revenue_share_agreed")),
        "copyright_status": F.when(young, "PROTECTED").otherwise(F.col("copyright_status")),
        **{c: F.when(young, False).otherwise(F.col(c)) for c in ("recording_public_domain", "commercial_use_allowed", "monetization_allowed")},
    }
    return _marked(rows, new)


def relabelled_compositions(rows: DataFrame) -> DataFrame:
    """compositions (with their source_dataset): simulated ones lose their check, and a verified status becomes possible;
    declared ones lose their check."""
    simulated, declared = (F.coalesce(F.col("source_dataset") == x, F.lit(False)) for x in (SIMULATED_SET, DECLARED_SET))
    new = {
        "source": F.when(simulated, SIMULATED_SOURCE).otherwise(F.col("source")),
        "verified_at": F.when(~simulated & ~declared, F.col("verified_at")),
        "public_domain_status": F.when(simulated & (F.col("public_domain_status") == "verified"), "possible").otherwise(F.col("public_domain_status")),
    }
    return _marked(rows, new)


def _marked(rows: DataFrame, new: dict[str, Column]) -> DataFrame:
    same = reduce(Column.__and__, [c.eqNullSafe(F.col(k)) for k, c in new.items()])
    return rows.withColumns({**new, "changed": ~same})


def stratified(df: DataFrame, stratum: str, id_: str, n: int, seed: str = "s") -> DataFrame:
    """Round robin over strata, larger strata first, in seeded order within each, until n rows."""
    rows = df.withColumn("__h", F.md5(F.concat_ws(":", F.lit(seed), F.col(id_).cast("string"))))
    sizes = df.groupBy(stratum).agg(F.count("*").alias("__size"))
    # the first n of each salted share of a stratum hold the first n of the stratum; what is left is at most n rows a share
    share = Window.partitionBy(stratum, F.substring("__h", -2, 2)).orderBy("__h", id_)
    some = rows.withColumn("__r", F.row_number().over(share)).filter(F.col("__r") <= n).drop("__r")
    turn = F.row_number().over(Window.partitionBy(stratum).orderBy("__h", id_))
    first = some.withColumn("turn", turn).filter(F.col("turn") <= n).join(sizes, some[stratum].eqNullSafe(sizes[stratum])).drop(sizes[stratum])
    return first.orderBy("turn", F.desc("__size"), stratum, id_).limit(n).drop("__size", "__h")


def capped(df: DataFrame, stratum: str, item: str, order: str, cap: int) -> DataFrame:
    """Rows of the first ``cap`` distinct items of each stratum, by first appearance."""
    first = df.groupBy(stratum, item).agg(F.min(order).alias("__first"))
    w = Window.partitionBy(stratum).orderBy("__first", item)
    keep = first.withColumn("__r", F.row_number().over(w)).filter(F.col("__r") <= cap).select(stratum, item)
    return df.join(keep, [stratum, item], "left_semi")


def floor_classes(df: DataFrame, label: str, least: int) -> DataFrame:
    keep = df.groupBy(label).count().filter(F.col("count") >= least).select(label)
    return df.join(keep, label, "left_semi")


def orphans(child: DataFrame, parent: DataFrame, key: str) -> DataFrame:
    return child.filter(F.col(key).isNotNull()).join(parent.select(key).distinct(), key, "left_anti")


def check(name: str, severity: str, bad: DataFrame, detail: str) -> DataFrame:
    """One row: PASS, or the severity when rows are bad."""
    return bad.agg(F.count("*").alias("n")).select(
        F.lit(name).alias("check"), F.when(F.col("n") == 0, "PASS").otherwise(severity).alias("status"), F.col("n"), F.lit(detail).alias("detail")
    )


def checked(df: DataFrame, checks: dict[str, tuple[str, Column, str]]) -> DataFrame:
    """A row for each check, {name: (severity, bad, detail)}: all from one aggregate of df."""
    one = df.agg(*[F.count_if(bad).alias(name) for name, (_, bad, _) in checks.items()])
    rows = F.array(*[F.struct(F.lit(k).alias("check"), F.lit(sev).alias("severity"), F.col(k).alias("n"), F.lit(text).alias("detail")) for k, (sev, _, text) in checks.items()])
    x = one.select(F.explode(rows).alias("r")).select("r.*")
    return x.select("check", F.when(F.col("n") == 0, "PASS").otherwise(F.col("severity")).alias("status"), "n", "detail")


def cyclic_partner(df: DataFrame, id_: str, override: str | None = None, per_range: int = 100_000) -> DataFrame:
    """(id, other): the next id in order, the last going to the first; an explicit partner goes before.

    Ids are dealt to ranges of about ``per_range`` by approximate quantiles; each range orders its
    own, and one row a range, the first id of the next range that has any, joins the ranges.
    """
    ids = df.select(F.col(id_).alias("id")).filter("id is not null").distinct()
    n = ids.count()
    bounds = ids.approxQuantile("id", [i / -(-n // per_range) for i in range(1, -(-n // per_range))], 1e-4) if n > per_range else []
    place = reduce(Column.__add__, [(F.col("id") > F.lit(b)).cast("int") for b in bounds], F.lit(0))
    placed = ids.withColumn("part", place)
    firsts = placed.groupBy("part").agg(F.min("id").alias("first"))  # a row a range
    w = Window.orderBy("part")
    heads = firsts.select("part", F.coalesce(F.lead("first").over(w), F.min("first").over(Window.partitionBy(F.lit(0)))).alias("head"))
    nxt = F.lead("id").over(Window.partitionBy("part").orderBy("id"))
    out = placed.withColumn("other", nxt).join(F.broadcast(heads), "part").select("id", F.coalesce("other", "head").alias("other"))
    if override is None:
        return out
    given = df.select(F.col(id_).alias("id"), F.col(override).alias("given")).filter("given is not null")
    return out.join(given, "id", "left").select("id", F.coalesce("given", "other").alias("other"))


def audio_targets(recordings: DataFrame, rights: DataFrame, license_type: str | None = None) -> DataFrame:
    """Recordings with an audio path that is not simulated and, if a license is named, rights of that type."""
    rows = recordings.filter("audio_path is not null and not startswith(audio_path, 'simulated/')")
    if license_type is None:
        return rows
    return rows.join(rights.filter(F.col("license_type") == license_type), "recording_id", "left_semi")


def seeded_sample(df: DataFrame, id_: str, n: int, seed: int) -> DataFrame:
    """n rows in the order of a seeded hash, then by id; all of them if there are no more."""
    h = F.sha2(F.concat_ws(":", F.lit(str(seed)), F.col(id_).cast("string")), 256)
    return df.orderBy(h, id_).limit(n).orderBy(id_)


#: Transformations of the query plan, their parameters, and the match they should give.
PLAN_FIELDS = "transformation string, snr double, pitch_shift double, tempo_factor double, codec string, bitrate int, segment_start double, duration double, expected_match_type string"
TRANSFORMATIONS = (
    ("original", None, 0.0, 1.00, "wav", 1411, 0.0, 30.0, "EXACT_MATCH"),
    ("crop_15s", None, 0.0, 1.00, "wav", 1411, 30.0, 15.0, "EXACT_MATCH"),
    ("crop_10s", None, 0.0, 1.00, "wav", 1411, 60.0, 10.0, "EXACT_MATCH"),
    ("mp3_128k", None, 0.0, 1.00, "mp3", 128, 0.0, 30.0, "EXACT_MATCH"),
    ("mp3_64k", None, 0.0, 1.00, "mp3", 64, 0.0, 30.0, "EXACT_MATCH"),
    ("aac_96k", None, 0.0, 1.00, "aac", 96, 0.0, 30.0, "EXACT_MATCH"),
    ("noise_snr20", 20.0, 0.0, 1.00, "wav", 1411, 0.0, 30.0, "EXACT_MATCH"),
    ("noise_snr10", 10.0, 0.0, 1.00, "wav", 1411, 0.0, 30.0, "NEAR_MATCH"),
    ("noise_snr5", 5.0, 0.0, 1.00, "wav", 1411, 0.0, 30.0, "NEAR_MATCH"),
    ("voice_overlay", 15.0, 0.0, 1.00, "wav", 1411, 0.0, 30.0, "NEAR_MATCH"),
    ("gain_minus12db", None, 0.0, 1.00, "wav", 1411, 0.0, 30.0, "EXACT_MATCH"),
    ("eq_lowpass_4k", None, 0.0, 1.00, "wav", 1411, 0.0, 30.0, "NEAR_MATCH"),
    ("pitch_plus_1", None, 1.0, 1.00, "wav", 1411, 0.0, 30.0, "NEAR_MATCH"),
    ("pitch_minus_1", None, -1.0, 1.00, "wav", 1411, 0.0, 30.0, "NEAR_MATCH"),
    ("pitch_plus_2", None, 2.0, 1.00, "wav", 1411, 0.0, 30.0, "NEAR_MATCH"),
    ("pitch_minus_2", None, -2.0, 1.00, "wav", 1411, 0.0, 30.0, "NEAR_MATCH"),
    ("tempo_0_90", None, 0.0, 0.90, "wav", 1411, 0.0, 30.0, "NEAR_MATCH"),
    ("tempo_0_95", None, 0.0, 0.95, "wav", 1411, 0.0, 30.0, "NEAR_MATCH"),
    ("tempo_1_05", None, 0.0, 1.05, "wav", 1411, 0.0, 30.0, "NEAR_MATCH"),
    ("tempo_1_10", None, 0.0, 1.10, "wav", 1411, 0.0, 30.0, "NEAR_MATCH"),
    ("reencode_mp3_chain", None, 0.0, 1.00, "mp3", 192, 0.0, 30.0, "EXACT_MATCH"),
)
OUTSIDE = ("out_of_database", None, 0.0, 1.00, "wav", 1411, 0.0, 30.0, "UNKNOWN")


def query_plan(recordings: DataFrame, indexed: DataFrame, n: int, unknown: int) -> DataFrame:
    """n recordings, those with vectors (``indexed``) first, by all transformations; and the last ``unknown`` without
    vectors, which must not be found. Ids break ties."""
    spark = recordings.sparkSession
    rows = recordings.select("recording_id", "composition_id").join(indexed.select("recording_id").distinct().withColumn("__has", F.lit(1)), "recording_id", "left")
    known = rows.orderBy(F.desc_nulls_last("__has"), "recording_id").limit(n)
    absent = rows.filter("__has is null").orderBy(F.desc("recording_id")).limit(unknown)
    kinds = lambda some: F.broadcast(spark.createDataFrame(some, PLAN_FIELDS))  # noqa: E731  22 rows
    return known.crossJoin(kinds(list(TRANSFORMATIONS))).union(absent.crossJoin(kinds([OUTSIDE]))).drop("__has")
