"""Brute force, round trips and properties of operators SQL does not cover."""

import uuid

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from earmark.functions import license as L
from earmark.functions import text as T
from earmark.operators import audio_features, codec, etl, fingerprint, jobs, registry, rules, vectors, windows
from earmark.schemas import TABLES, conform, repaired, schema
from earmark.sources import files


def test_codec_round_trip():
    rng = np.random.default_rng(1)
    for n in (0, 1, 2, 50):
        items = [int(x) for x in rng.integers(0, 2**32, n)]
        assert codec.decode(codec.encode(items)) == items
    assert codec.decode("!!") is None
    assert codec.decode("AQ") is None
    assert codec.decode(codec.encode([1, 2, 3])[:-2]) is None


def test_uuid5(spark):
    names = ["a", "Supplier#1", "é", "6BA7B811-9DAD-11D1-80B4-00C04FD430C8", " ", None]
    got = spark.createDataFrame([(x,) for x in names], "n string").select(T.uuid5(F.col("n"), str(uuid.NAMESPACE_URL)).alias("u")).collect()
    want = [str(uuid.uuid5(uuid.NAMESPACE_URL, x)) for x in names[:3]] + [names[3].lower(), None, None]
    assert [r.u for r in got] == want


def test_alignment_against_loops(spark):
    rng = np.random.default_rng(2)
    q = [(i, p, int(h)) for i in range(3) for p, h in enumerate(rng.integers(0, 2**32, 20))]
    r = [(10 + i, p, h ^ (1 << int(rng.integers(0, 32)))) for i, p, h in q if p > 4] + [(20, p, int(h)) for p, h in enumerate(rng.integers(0, 64, 30))]
    q += [(5, p, int(h)) for p, h in enumerate(rng.integers(0, 64, 12))]
    got = fingerprint.alignment(spark.createDataFrame(q, "query_id long, pos int, h long"), spark.createDataFrame(r, "doc_id long, pos int, h long")).collect()
    want = {}
    for a in {x[0] for x in q}:
        for b in {x[0] for x in r}:
            hits = {}
            x, y = [v for v in q if v[0] == a], [v for v in r if v[0] == b]
            for _, i, h in x:
                for _, j, k in y:
                    if bin(h ^ k).count("1") <= 2:
                        hits[i - j] = hits.get(i - j, 0) + 1
            if hits:
                want[a, b] = round(max(hits.values()) / min(len(x), len(y)), 6)
    assert {(g.query_id, g.doc_id): g.score for g in got} == want


def test_prefilter_equals_full_scan(spark, sf):
    from earmark.plans import similarity

    a = similarity.fp_search_verdict(spark, sf).filter("match_type = 'EXACT_MATCH'").select("query_id", "doc_id")
    b = similarity.fp_search_full_scan(spark, sf).filter("match_type = 'EXACT_MATCH'").select("query_id", "doc_id")
    assert a.exceptAll(b).isEmpty() and b.exceptAll(a).isEmpty()


def test_excluded_equals_filtered_index(spark):
    rng = np.random.default_rng(3)
    rows = [(i, i // 2, 0, rng.normal(size=8).tolist()) for i in range(60)]
    s = spark.createDataFrame(rows, "vec_id long, recording_id long, seg_start long, embedding array<double>")
    a = vectors.retrieve(s.filter("vec_id = 7"), s, exclude_own=True)
    b = vectors.retrieve(s.filter("vec_id = 7"), s.filter("recording_id <> 3"))
    cols = ["query_id", "recording_id", "score", "hits"]
    assert a.select(*cols).collect() == b.select(*cols).collect()


def test_rotation_recovers_shift(spark):
    rng = np.random.default_rng(4)
    v = rng.normal(size=60)
    shifted = np.roll(v.reshape(12, 5), 3, axis=0).ravel()
    x = spark.createDataFrame([(1, v.tolist()), (2, shifted.tolist())], "vec_id long, v array<double>").withColumn("v", vectors.normalised(F.col("v")))
    top = vectors.rotation_search(x.filter("vec_id = 1"), x, 12, 5, 1).first()
    assert (top.vec_id, top.oti) == (2, 3) and top.score == pytest.approx(1.0)
    native = x.filter("vec_id = 1").select(vectors.rotated(F.col("v"), 3, 12, 5).alias("r")).first().r
    assert np.allclose(native, x.filter("vec_id = 2").first().v)


def fact(**over):
    base = dict(
        license_type="CC_BY", copyright_status="PROTECTED", attribution_required="true", commercial_use_allowed="true", monetization_allowed="true",
        policy_action=None, license_purchased=None, revenue_share_agreed=None, recording_public_domain=None, composition_pd="verified", license_valid="true",
        ctx_commercial="false", ctx_monetization="false", has_rights=True, match_type="EXACT_MATCH", identity_confidence=0.99, rc=0.9,
    )
    return base | over


RULE_CASES = [
    (fact(license_type="AUDIO_LIBRARY", attribution_required="False"), "LOW", "FREE_TO_USE"),
    (fact(license_type="audio_library"), "CONDITIONAL", "ATTRIBUTION_REQUIRED"),
    (fact(license_type="AUDIO_LIBRARY", attribution_required=None), "UNKNOWN", "HUMAN_REVIEW_REQUIRED"),
    (fact(license_type="CREATOR_MUSIC", license_purchased="true"), "LOW", "FULL_REVENUE_RETAINED"),
    (fact(license_type="CREATOR_MUSIC", license_purchased="true", license_valid="false"), "UNKNOWN", "HUMAN_REVIEW_REQUIRED"),
    (fact(license_type="CREATOR_MUSIC", license_purchased="false", revenue_share_agreed="true"), "CONDITIONAL", "REVENUE_SHARE_APPLIED"),
    (fact(license_type="CREATOR_MUSIC", license_purchased="false", revenue_share_agreed="false"), "HIGH", "LICENSE_REQUIRED"),
    (fact(license_type="CONTENT_ID", policy_action="MONETIZE_CLAIM"), "CONDITIONAL", "REVENUE_REDIRECTED"),
    (fact(license_type="COMMERCIAL", policy_action="block_or_takedown"), "HIGH", "VIDEO_BLOCKED_OR_STRIKE"),
    (fact(license_type="CONTENT_ID", policy_action=None), "UNKNOWN", "HUMAN_REVIEW_REQUIRED"),
    (fact(license_type="CONTENT_ID", policy_action="NONE"), "UNKNOWN", "HUMAN_REVIEW_REQUIRED"),
    (fact(license_type="CC_BY_NC", commercial_use_allowed="false", ctx_commercial="true"), "HIGH", "NON_COMMERCIAL_VIOLATION"),
    (fact(license_type="CC_BY_NC", monetization_allowed="false", ctx_monetization="true"), "HIGH", "MONETIZATION_NOT_PERMITTED"),
    (fact(license_type="CC0", attribution_required="true"), "LOW", "FREE_TO_USE"),
    (fact(), "CONDITIONAL", "ATTRIBUTION_REQUIRED"),
    (fact(attribution_required="false"), "LOW", "FREE_TO_USE"),
    (fact(license_type="PUBLIC_DOMAIN", recording_public_domain="true"), "LOW", "FREE_TO_USE"),
    (fact(license_type="PUBLIC_DOMAIN", recording_public_domain="false", ctx_commercial="true"), "HIGH", "RECORDING_PERMISSION_REQUIRED"),
    (fact(license_type="OTHER", copyright_status="public_domain", recording_public_domain="false"), "CONDITIONAL", "RECORDING_PERMISSION_REQUIRED"),
    (fact(license_type="PUBLIC_DOMAIN", composition_pd=None), "UNKNOWN", "HUMAN_REVIEW_REQUIRED"),
    (fact(license_type="PUBLIC_DOMAIN", composition_pd="no", recording_public_domain="true"), "CONDITIONAL", "COMPOSITION_PERMISSION_REQUIRED"),
    (fact(license_type="WEIRD"), "UNKNOWN", "UNCATEGORIZED"),
    (fact(match_type="UNKNOWN"), "UNKNOWN", "HUMAN_REVIEW_REQUIRED"),
    (fact(match_type="NO_MATCH", has_rights=False), "LOW", "MONETIZABLE_UNTIL_RETROACTIVE_CLAIM"),
    (fact(match_type=None, has_rights=False), "LOW", "MONETIZABLE_UNTIL_RETROACTIVE_CLAIM"),
    (fact(has_rights=False), "UNKNOWN", "HUMAN_REVIEW_REQUIRED"),
    (fact(match_type="NEAR_MATCH", identity_confidence=0.97), "UNKNOWN", "HUMAN_REVIEW_REQUIRED"),
    (fact(rc=0.49), "UNKNOWN", "HUMAN_REVIEW_REQUIRED"),
    (fact(rc=0.50), "CONDITIONAL", "ATTRIBUTION_REQUIRED"),
]


def test_rule_engine(spark):
    keys = list(fact())
    kinds = {"has_rights": "boolean", "identity_confidence": "double", "rc": "double"}
    rows = [tuple(f[k] for k in keys) + (i,) for i, (f, _, _) in enumerate(RULE_CASES)]
    df = spark.createDataFrame(rows, ", ".join(f"{k} {kinds.get(k, 'string')}" for k in keys) + ", i int")
    got = {r.i: r.d for r in df.select("i", rules.decide(F.col("rc")).alias("d")).collect()}
    assert [(got[i].risk, got[i].condition) for i in range(len(RULE_CASES))] == [(r, c) for _, r, c in RULE_CASES]
    gated = got[len(RULE_CASES) - 2]
    assert gated.provisional == "CONDITIONAL" and gated.decision_confidence == 0.0


def test_admission_batch(spark):
    base = pd.Timestamp("2024-01-01")
    rows = [(i, 1, (base + pd.Timedelta(seconds=s)).to_pydatetime()) for i, s in enumerate([0, 1, 2, 30, 60, 61.5])]
    got = registry.admitted(spark.createDataFrame(rows, "event_id long, key long, ts timestamp_ntz"), 2, 60).orderBy("event_id").collect()
    assert [g.admitted for g in got] == [True, True, False, False, True, True]
    assert got[2].retry_after == 58


def test_novelty(spark):
    rows = [(1, i, i, v) for i, v in enumerate([[1.0, 0.0], [0.999, 0.04], [0.0, 1.0], [0.7, 0.7]])]
    df = spark.createDataFrame(rows, "entry long, vec_id long, seg_start long, embedding array<double>")
    assert {r.vec_id for r in registry.novel(df, 0.95, 8).collect()} == {0, 2, 3}
    assert {r.vec_id for r in registry.novel(df, 0.95, 1).collect()} == {0}
    assert {r.vec_id for r in registry.novel(df, 0.95, 8, np.array([[1.0, 0.0]])).collect()} == {2, 3}


def test_streaming_registry_equals_batch(spark, sf, tmp_path):
    from earmark.plans.registry import _sightings
    from earmark.streaming.registry import RegistryTable, fold_sightings

    s = _sightings(spark, sf)
    for i in range(3):
        s.filter(F.col("sighting_id") % 3 == i).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
    stream = spark.readStream.schema(s.schema).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in")
    table = RegistryTable(spark, f"file://{tmp_path}/state")
    fold_sightings(stream, table, f"{tmp_path}/ckpt").awaitTermination()
    cols = ["unknown_id", "first_seen_at", "last_seen_at", "sighting_count", "last_platform"]
    want = registry.upsert(spark.createDataFrame([], registry.STATE), s).select(*cols)
    got = table.read().select(*cols)
    assert got.exceptAll(want).isEmpty() and want.exceptAll(got).isEmpty()
    before = table.read().count()
    table.fold(s, 0)
    assert table.read().count() == before


def test_files(spark, tmp_path):
    p = f"{tmp_path}/c.csv"
    with open(p, "w") as f:
        f.write("composition_id,title_m3,year,bogus\nx,T,1999,1\ny,U,notayear,2\n")
    df = files.read_csv(spark, p, "compositions")
    assert df.columns == ["composition_id", "title", "year"]
    assert [r.year for r in df.orderBy("composition_id").collect()] == [1999, None]
    assert files.load_table(spark, p, f"{tmp_path}/t", "compositions") == 2
    assert repaired("a_m12") == "a" and all(schema(t).fields for t in TABLES)
    a = spark.createDataFrame([(1, "a"), (2, "b")], "k long, v string")
    b = spark.createDataFrame([(1, "a"), (2, "c")], "k long, v string")
    files.replace_checked(a, b, 1, f"{tmp_path}/r")
    with pytest.raises(ValueError):
        files.replace_checked(a, b, 2, f"{tmp_path}/r2")
    c = files.Checkpoint(spark, f"{tmp_path}/ck", "sig1", "k long, v string")
    assert c.todo(a, "k").count() == 2
    c.add(a.filter("k = 1"))
    assert [r.k for r in c.todo(a, "k").collect()] == [2]
    assert files.Checkpoint(spark, f"{tmp_path}/ck", "sig2", "k long, v string").todo(a, "k").count() == 2
    assert {(r.k, r.v) for r in files.replace_by_key(a, b.filter("k = 2"), "k").collect()} == {(1, "a"), (2, "c")}


def test_small_functions(spark):
    row = spark.range(1).select(
        T.clean(F.lit(" a\x00b ")).alias("clean"), T.track_number(F.lit("x/000002.mp3")).alias("track"), T.year(F.lit("abc")).alias("year"),
        T.composer(F.lit("Song (Bach)"), F.lit("X")).alias("composer"), T.client_ip(F.lit("1.1.1.1, 2.2.2.2"), F.lit("9.9.9.9"), 1).alias("ip"),
        L.code_from_url(F.lit("https://creativecommons.org/licenses/nc-by/4.0")).alias("code"), jobs.http_status(F.lit("NOPE")).alias("http"),
        T.found(F.lit("50%"), F.lit("sold 50% off")).alias("found"), fingerprint.plausible(F.lit(100), F.lit(10.0)).alias("ok"),
        fingerprint.min_score(F.lit(5.0)).alias("floor"), vectors.semitones(F.lit(1)).alias("semi"),
    ).first()
    assert (row.clean, row.track, row.year, row.composer, row.ip) == ("ab", "2", 2020, "Bach", "2.2.2.2")
    assert (row.code, row.http, row.found, row.ok, row.semi) == ("by-nc", 500, True, True, "-1 semitones")
    assert row.floor == pytest.approx(0.3684 * 1.15)


def test_descriptor():
    c = np.random.default_rng(5).random((12, 200))
    d = audio_features.descriptor(c, 64)
    assert d.shape == (768,) and np.isclose((d * d).sum(), 1)
    assert not audio_features.descriptor(np.ones((12, 10)), 64).any()
    assert audio_features.resampled(c[:, :10], 64).shape == (12, 64)


def test_partner_and_review(spark):
    df = spark.createDataFrame([(1, None), (3, 9), (7, None)], "id long, given long")
    assert {(r.id, r.other) for r in etl.cyclic_partner(df, "id", "given").collect()} == {(1, 3), (3, 9), (7, 1)}
    e = spark.createDataFrame([(1, "t", "n", "PENDING", None)], "unknown_id long, review_title string, review_note string, review_status string, reviewed_at string")
    u = spark.createDataFrame([(1, " ", True, None, False, "REVIEWED", "now")], "unknown_id long, review_title string, set_review_title boolean, review_note string, set_review_note boolean, review_status string, at string")
    r = registry.reviewed(e, u).first()
    assert (r.review_title, r.review_note, r.review_status, r.reviewed_at) == (None, "n", "REVIEWED", "now")


def test_windows_properties(spark):
    rows = spark.createDataFrame([(float(x),) for x in (5, 30, 31, 100, 1000)], "d double").select("d", windows.plan_windows(F.col("d")).alias("w")).collect()
    for r in rows:
        assert r.w[0] == 0 and len(r.w) <= 8
        if r.d > 30:
            assert abs(r.w[-1] - (r.d - 30)) < 0.01


def test_conform_order(spark):
    df = spark.createDataFrame([("1", "x")], "year string, composition_id string")
    assert conform(df, "compositions").columns == ["composition_id", "year"]
