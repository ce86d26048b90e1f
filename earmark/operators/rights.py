"""Rights: lookup with fallback, simulated rights, latest per key."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..sources.adapters import bucket

DATASETS = ("YouTube Audio Library", "Creator Music", "MTG-Jamendo", "FMA", "Public Domain Archive")


def latest(df: DataFrame, key: str, tie: str) -> DataFrame:
    """The row verified last for each key, nulls last, ties to the smaller id."""
    w = Window.partitionBy(key).orderBy(F.desc_nulls_last("verified_at"), tie)
    return df.withColumn("__r", F.row_number().over(w)).filter("__r = 1").drop("__r")


def lookup(recordings: DataFrame, rights: DataFrame) -> DataFrame:
    """Rights of each recording: its own, else those of its composition; scope tells which."""
    own = latest(rights.filter("recording_id is not null"), "recording_id", "rights_id").drop("composition_id")
    shared = latest(rights.filter("recording_id is null and composition_id is not null"), "composition_id", "rights_id").drop("recording_id")
    cols = [c for c in rights.columns if c not in ("recording_id", "composition_id")]
    a = own.select("recording_id", F.struct(*cols).alias("__own"))
    b = shared.select("composition_id", F.struct(*cols).alias("__shared"))
    joined = recordings.join(a, "recording_id", "left").join(b, "composition_id", "left")
    picked = F.coalesce("__own", "__shared")
    scope = F.when(F.col("__own").isNotNull(), "recording").when(F.col("__shared").isNotNull(), "composition")
    return joined.select(*recordings.columns, scope.alias("scope"), *[picked[c].alias(c) for c in cols])


def simulated(recordings: DataFrame, verified_at: str) -> DataFrame:
    """Deterministic rights by source dataset; buckets of a salted hash choose variants."""
    b = lambda salt: bucket(F.col("recording_id"), salt, 100)
    data = F.get(F.array(*[F.lit(x) for x in DATASETS]), F.col("src"))
    audio, creator, jamendo, fma, archive = (data == x for x in DATASETS)
    variant = F.when(
        jamendo, F.when(b("jamendo") < 40, "CC_BY").when(b("jamendo") < 60, "CC_BY_SA").when(b("jamendo") < 85, "CC_BY_NC").otherwise("CC_BY_NC_ND")
    ).when(fma & (b("fma") < 50), F.when(b("fma_cc") < 60, "CC_BY").otherwise("CC_BY_NC"))
    blocked, bought, free = b("fma_policy") < 30, b("cm") < 50, b("pd") < 60
    cc = variant.isNotNull()
    kind = F.coalesce(variant, F.when(audio, "AUDIO_LIBRARY").when(creator, "CREATOR_MUSIC").when(fma, "CONTENT_ID").when(archive, "PUBLIC_DOMAIN").otherwise("UNKNOWN"))
    nc, nd = F.coalesce(variant.contains("NC"), F.lit(False)), F.coalesce(variant.contains("ND"), F.lit(False))
    return recordings.select(
        F.concat(F.lit("r"), F.col("recording_id").cast("string")).alias("rights_id"), "recording_id", "composition_id",
        kind.alias("license_type"),
        F.when(audio, "LICENSED").when(archive & free, "PUBLIC_DOMAIN").when(kind == "UNKNOWN", "UNKNOWN").otherwise("PROTECTED").alias("copyright_status"),
        F.when(cc, True).when(audio, b("ytal") < 40).when(kind == "UNKNOWN", True).otherwise(False).alias("attribution_required"),
        F.when(cc, ~nc).when(audio | creator, True).when(archive, free).otherwise(False).alias("commercial_use_allowed"),
        F.when(cc, ~nd).when(audio, True).when(archive, free).otherwise(False).alias("modification_allowed"),
        F.when(cc, ~nc).when(audio | creator, True).when(archive, free).otherwise(False).alias("monetization_allowed"),
        F.when(creator, ~bought).when(fma & ~cc, ~blocked).otherwise(False).alias("revenue_share_required"),
        F.when(fma & ~cc, F.when(blocked, "BLOCK_OR_TAKEDOWN").otherwise("MONETIZE_CLAIM")).otherwise("NONE").alias("policy_action"),
        (creator & bought).alias("license_purchased"), (creator & ~bought).alias("revenue_share_agreed"), (archive & free).alias("recording_public_domain"),
        F.lit("2020-01-01").alias("valid_from"), F.lit("2030-12-31").alias("valid_until"),
        F.concat(F.lit("SIMULATED ("), data, F.lit(")")).alias("rights_source"),
        F.to_timestamp_ntz(F.lit(verified_at)).alias("verified_at"),
    )


def creator_flags(license_type: Column, share: Column) -> tuple[Column, Column]:
    """(license purchased, revenue share agreed): for creator music one of the two, else no purchase; share is read as text."""
    agreed = F.coalesce(F.lower(F.trim(share.cast("string"))).isin("true", "1"), F.lit(False))
    return F.coalesce(license_type == "CREATOR_MUSIC", F.lit(False)) & ~agreed, agreed


def recording_pd_plausible(year: Column, now_year: int) -> Column:
    """Whether a recording of that year, a number or its text, may be out of protection."""
    return F.coalesce(year.cast("string").try_cast("double").try_cast("int") <= now_year - 70, F.lit(False))


#: Label of a missing publisher, and notes on where rights come from.
NO_PUBLISHER = "không rõ hãng phát hành"
SOURCE_NOTES = {
    "fma_metadata": "Dữ liệu khai báo bởi nghệ sĩ trên Free Music Archive (không được xác minh độc lập)",
    "jamendo_api": "Dữ liệu giấy phép từ Jamendo Licensing API",
    "simulated": "Dữ liệu thử nghiệm nội bộ (giả lập)",
}


def publisher_source(label: Column) -> Column:
    """Where rights of a label's tracks come from; a missing label (null, blank, nan) has a text of its own."""
    text = F.trim(F.coalesce(label, F.lit("")))
    return F.concat(F.lit("Spotify API / "), F.when((text == "") | (F.lower(text) == "nan"), NO_PUBLISHER).otherwise(text))


def source_note(source: Column) -> Column:
    """A sentence on the source of rights; null without one."""
    note = F.concat(F.lit("Dữ liệu từ nguồn: "), source)
    for k, v in SOURCE_NOTES.items():
        note = F.when(source == k, v).otherwise(note)
    return F.when(F.coalesce(source, F.lit("")) != "", note)


def with_predicted(facts: DataFrame, model_version: str) -> DataFrame:
    """Rights a model predicts (predicted_type, probability) stand in where there are none: a match type of their own,
    a source that costs them confidence, nothing verified."""
    from ..functions import license as L

    code = L.code_of_type(F.col("predicted_type"))
    use = ~F.col("has_rights") & code.isNotNull()
    source = F.concat(
        F.lit(f"PREDICTED bởi {model_version} (xác suất "), F.col("probability").cast("string"), F.lit(") — KHÔNG tra từ nguồn nào")
    )
    given = {
        "match_type": F.lit("LICENSE_PREDICTED"), "has_rights": F.lit(True), "license_type": F.col("predicted_type"), "rights_source": source,
        "copyright_status": L.flag(code, "copyright_status"), "attribution_required": L.flag(code, "attribution_required"),
        "commercial_use_allowed": L.flag(code, "commercial_use_allowed"), "modification_allowed": L.flag(code, "modification_allowed"),
        "monetization_allowed": L.flag(code, "monetization_allowed"), "verified_at": F.lit(None), "revenue_share_required": F.lit(False),
        "policy_action": F.lit("NONE"), "license_purchased": F.lit(False), "revenue_share_agreed": F.lit(False),
    }
    return facts.withColumn("rights_predicted", use).withColumns({k: F.when(use, v).otherwise(F.col(k)) for k, v in given.items()})
