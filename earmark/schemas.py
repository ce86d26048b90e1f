"""Schemas of the engine's tables, enumerations, and schema-tolerant import."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

TABLES = {
    "compositions": "composition_id string, title string, composer string, year int, public_domain_status string, source string, verified_at timestamp_ntz",
    "recordings": "recording_id string, composition_id string, title string, artist string, album string, release_year int, duration double, source_dataset string, source_track_id string, audio_path string, metadata_verified boolean",
    "rights": "rights_id string, recording_id string, composition_id string, license_type string, copyright_status string, attribution_required boolean, commercial_use_allowed boolean, modification_allowed boolean, monetization_allowed boolean, revenue_share_required boolean, policy_action string, license_purchased boolean, revenue_share_agreed boolean, recording_public_domain boolean, territory string, platform string, valid_from date, valid_until date, source string, source_url string, verified_at timestamp_ntz",
    "fingerprints": "fingerprint_id string, recording_id string, algorithm string, fingerprint string, duration double, created_at timestamp_ntz",
    "embeddings": "embedding_id string, recording_id string, segment_start double, segment_end double, model string, model_version string, dimension int, vector array<float>",
    "test_queries": "query_id string, recording_id string, composition_id string, transformation string, snr double, pitch_shift double, tempo_factor double, codec string, bitrate int, segment_start double, duration double, expected_match_type string",
    "jobs": "job_id string, status string, stage string, filename string, platform string, commercial_use boolean, monetization boolean, error_code string, error_message string, result variant, created_at timestamp_ntz, updated_at timestamp_ntz",
    "feedback": "feedback_id string, job_id string, recording_id string, verdict string, note string, created_at timestamp_ntz",
    "analysis_results": "job_id string, candidates string, fingerprint_score double, embedding_score double, cover_score double, match_type string, risk_level string, decision_confidence double, decision_reason string, latency_ms double, model_version string, timestamp timestamp_ntz",
    "unknown_tracks": "unknown_id string, kind string, recording_id string, fingerprint string, fingerprint_duration double, first_filename string, first_seen_at timestamp, last_seen_at timestamp, sighting_count int, last_filename string, last_platform string, last_risk_level string, hint_recording_id string, hint_score double, review_status string, review_title string, review_note string, reviewed_at timestamp",
    "unknown_sightings": "sighting_id string, unknown_id string, job_id string, seen_at timestamp, platform string, commercial_use boolean, monetization boolean, match_score double, match_method string, risk_level string, category string",
    "unknown_track_features": "feature_id string, unknown_id string, feature_type string, model_version string, segment_start double, segment_end double, dimension int, vector array<float>",
}

ENUMS = {
    "job_status": ("QUEUED", "PROCESSING", "DONE", "FAILED"),
    "risk_level": ("LOW", "CONDITIONAL", "HIGH", "UNKNOWN"),
    "unknown_kind": ("NOT_IDENTIFIED", "RIGHTS_UNKNOWN"),
    "verdict": ("Correct", "Incorrect", "Unsure"),
}


def schema(name: str) -> T.StructType:
    return T._parse_datatype_string(TABLES[name])


def valid(c: Column, enum: str) -> Column:
    """Whether a value is one of the enumeration's; null is not."""
    return F.coalesce(c.isin(*ENUMS[enum]), F.lit(False))


def repaired(name: str) -> str:
    """A column name without the ``_m<digits>`` suffix a merge left on it."""
    return re.sub(r"_m\d+$", "", name)


def conform(df: DataFrame, name: str) -> DataFrame:
    """Columns of the table that df has, under repaired names, cast without failing; the first of equal names counts."""
    have: dict[str, str] = {}
    for c in df.columns:
        have.setdefault(repaired(c), c)
    return df.select(*[
        F.col(f"`{have[f.name]}`").try_cast(f.dataType).alias(f.name) for f in schema(name).fields if f.name in have
    ])
