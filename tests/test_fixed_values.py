"""Values the engine must give for known inputs."""

import json

import numpy as np
import pytest
from pyspark.sql import functions as F

from earmark.operators import audio_features, etl, evaluation, index, jobs, registry, rights, rules, vectors, windows
from earmark.sources import files


def one(spark, **cols):
    return spark.range(1).select(*[c.alias(k) for k, c in cols.items()]).first()


def test_production_features(spark):
    rate, t = 2000, np.linspace(0, 3, 6000)
    tone = np.sin(2 * np.pi * 220 * t)
    signals = {
        0: np.zeros(100), 1: tone * 0.05, 2: tone * 0.9, 3: np.tanh(tone * 20) * 0.99, 4: tone * 0.5 * np.linspace(0.01, 0.9, 6000), 5: np.clip(tone * 2, -1, 1), 6: tone * 0.3,
    }
    df = spark.createDataFrame([(k, v.tolist()) for k, v in signals.items()] + [(9, None)], "id long, x array<double>")
    p = audio_features.production(df, "x", rate)
    score, label = audio_features.polish(F.col("crest_factor_db"), F.col("rms_dbfs"), F.col("dynamic_range_db"))
    got = {r.id: r for r in p.withColumn("polish", score).withColumn("label", label).collect()}
    assert got[0].rms_dbfs is None and got[9].polish is None and got[0].label is None
    assert got[3].crest_factor_db < got[4].crest_factor_db and got[1].rms_dbfs < got[2].rms_dbfs
    assert got[2].dynamic_range_db < got[4].dynamic_range_db and got[5].clipping_ratio > 0.01 and got[6].clipping_ratio == 0
    assert got[3].polish > got[1].polish and got[2].duration_s == 3.0
    r = one(spark, a=audio_features.polish(F.lit(8.0), F.lit(-14.0), F.lit(4.0))[0], b=audio_features.polish(F.lit(20.0), F.lit(-26.0), F.lit(18.0))[0], c=audio_features.polish(F.lit(14.0), F.lit(-20.0), F.lit(11.0))[0])
    assert (r.a, r.b, r.c) == (1.0, 0.0, 0.5)


def test_resampling():
    ones = np.ones((12, 5))
    assert audio_features.resampled(ones, 64).shape == (12, 64) and (audio_features.resampled(ones, 64) > 0).all()
    x = np.arange(500.0)[None, :]
    for n in (500, 65, 64, 7):
        assert audio_features.resampled(x[:, :n], 64).shape == (1, 64)
    assert np.allclose(audio_features.resampled(x[:, :5], 2), [[0.5, 3.0]])
    assert audio_features.resampled(x[:, :3], 5).tolist() == [[0, 0, 1, 2, 2]]


def test_creator_flags_exclude_each_other(spark):
    shares = [None, "True", "False", "nan", "", "1", " true "]
    rows = spark.createDataFrame([(k, s) for k in ("CREATOR_MUSIC", "CC_BY", None) for s in shares], "k string, s string")
    bought, agreed = rights.creator_flags(F.col("k"), F.col("s"))
    got = {(r.k, r.s): (r.b, r.a) for r in rows.withColumns({"b": bought, "a": agreed}).collect()}
    assert all(b != a for (k, _), (b, a) in got.items() if k == "CREATOR_MUSIC")
    assert got["CREATOR_MUSIC", "nan"] == (True, False) and got["CC_BY", "nan"] == (False, False) and got["CC_BY", "True"] == (False, True)


def test_age_of_recordings(spark):
    years = spark.createDataFrame([("1950.0",), ("",), (None,), ("1956",), ("1957",), ("x",)], "y string")
    assert [r.p for r in years.select(rights.recording_pd_plausible(F.col("y"), 2026).alias("p")).collect()] == [True, False, False, True, False, False]
    assert one(spark, a=rights.publisher_source(F.lit("nan"))).a == "Spotify API / không rõ hãng phát hành"


def test_kinds_of_unknown(spark):
    rows = [("UNKNOWN", "UNKNOWN", None), ("UNKNOWN", "LOW", 1), ("EXACT_MATCH", "UNKNOWN", 1), ("EXACT_MATCH", "LOW", 1), ("NO_MATCH", "LOW", None), ("UNAVAILABLE", "UNKNOWN", None), (None, "UNKNOWN", None), ("LICENSE_PREDICTED", "UNKNOWN", 1)]
    df = spark.createDataFrame(rows, "m string, r string, i long")
    got = [r.k for r in df.select(registry.classify(F.col("m"), F.col("r"), F.col("i")).alias("k")).collect()]
    assert got == ["NOT_IDENTIFIED", "NOT_IDENTIFIED", "RIGHTS_UNKNOWN", None, None, None, None, "RIGHTS_UNKNOWN"]


def test_statuses(spark):
    codes = {"FILE_TOO_LARGE": 413, "UNSUPPORTED_FORMAT": 415, "RATE_LIMITED": 429, "UNAUTHORIZED": 401, "NO_AUDIO": 422, "MODEL_FAILURE": 503, "TIMEOUT": 504, "UNKNOWN_TRACK": 404, "INTERNAL_ERROR": 500, "ELSE": 500}
    assert one(spark, **{k: jobs.http_status(F.lit(k)) for k in codes}).asDict() == codes and len(jobs.HTTP_STATUS) == 12


def test_query_plan(spark):
    rec = spark.createDataFrame([(i, f"c{i}") for i in range(10)], "recording_id long, composition_id string")
    plan = etl.query_plan(rec, spark.createDataFrame([(7,), (8,), (8,)], "recording_id long"), 3, 2).collect()
    assert len(plan) == 3 * 21 + 2 and {r.recording_id for r in plan if r.transformation == "original"} == {7, 8, 0}
    assert {r.recording_id for r in plan if r.transformation == "out_of_database"} == {9, 6}
    told = {r.transformation: r.expected_match_type for r in plan}
    assert told["noise_snr20"] == told["reencode_mp3_chain"] == "EXACT_MATCH" and told["eq_lowpass_4k"] == "NEAR_MATCH" and told["out_of_database"] == "UNKNOWN"


def test_segments(spark):
    lengths = [0.5, 1.0, 9.0, 15.0, 25.0, 24.9, 124.999999999999, 125.0, 300.0]
    df = spark.createDataFrame([(x,) for x in lengths], "d double").select("d", windows.plan_segments(F.col("d")).alias("s"))
    got = {r.d: [(round(x.start, 2), round(x.end, 2)) for x in r.s] for r in df.collect()}
    assert got[0.5] == [] and got[1.0] == [(0, 1)] and got[9.0] == [(0, 9)] and got[15.0] == [(0, 15)]
    assert got[25.0] == [(0, 15), (10, 25)] and got[24.9] == [(0, 15)]
    assert len(got[125.0]) == 12 and got[125.0][-1] == (110, 125) and len(got[300.0]) == 12 and got[300.0][-1] == (285, 300)
    assert one(spark, a=windows.plan_windows(F.lit(90.0), most=1)).a == [0.0]


def test_rules_from_files(spark, tmp_path):
    told = {"groups": [
        {"order": n - i, "name": g[0], "match": {k: list(v) for k, v in g[1].items()},
         "rules": [{"when": {k: list(v) for k, v in w.items()}, "risk": r, "condition": c} for w, r, c in g[2]]}
        for n, (i, g) in [(len(rules.GROUPS), x) for x in enumerate(rules.GROUPS)]
    ]}
    (tmp_path / "r.json").write_text(json.dumps(told))
    assert rules.load_groups(str(tmp_path / "r.json")) == rules.GROUPS[::-1]
    yaml = pytest.importorskip("yaml")
    (tmp_path / "r.yaml").write_text(yaml.safe_dump(told))
    assert rules.load_groups(str(tmp_path / "r.yaml")) == rules.GROUPS[::-1]
    del told["groups"][0]["match"]
    (tmp_path / "bad.json").write_text(json.dumps(told))
    with pytest.raises(KeyError):
        rules.load_groups(str(tmp_path / "bad.json"))


def test_leave_one_out_with_large_recordings(spark):
    rng = np.random.default_rng(3)
    v = rng.normal(size=(160, 8))
    g = np.where(np.arange(160) < 70, 1000, np.arange(160) // 2)
    df = spark.createDataFrame([(i, int(g[i]), v[i].tolist()) for i in range(160)], "vec_id long, recording_id long, embedding array<double>")
    p = np.round(v @ v.T, 6)
    np.fill_diagonal(p, -np.inf)
    want = {}
    for i in range(160):
        best = {k: p[i, g == k].max() for k in set(g.tolist())}
        if best[g[i]] > -np.inf:
            want[i] = 1 + sum(b > best[g[i]] for k, b in best.items() if k != g[i])
    for rows in (16, 4096):
        assert {r.query_id: r["rank"] for r in vectors.leave_one_out_ranks(df, rows=rows).collect()} == want
    both = {r.query_id: (r.own, r.other) for r in vectors.own_and_other(df, "recording_id").collect()}
    assert both[0] == (p[0, g == 1000].max(), p[0, g != 1000].max())


def test_index(spark):
    meta = spark.createDataFrame([("1", "a"), ("2", "b"), ("2", "c")], "source_track_id string, recording_id string")
    uuid = "0" * 8 + "-0000-0000-0000-" + "0" * 12
    rows = spark.createDataFrame([(" 1 ", "3,4"), ("2", "1,0"), (uuid, "0,0"), ("1", "1"), ("1", "x,1"), ("9", "x,1")], "recording_id string, vector string")
    got = [(r.recording_id, r.how, r.vector) for r in index.remapped(rows, meta, 2).collect()]
    assert sorted(got, key=str) == sorted([("a", "remapped", [0.6, 0.8]), ("2", "unmapped", None), (uuid, "already_uuid", [0.0, 0.0]), ("a", "bad_dim", None), ("a", "bad_values", None), ("9", "unmapped", None)], key=str)
    with pytest.raises(ValueError):
        index.loaded(spark.range(3).withColumnRenamed("id", "pos"), spark.range(2).withColumnRenamed("id", "pos"))
    assert index.loaded_or_none(spark, "/nowhere/at/all", ("x",)) is None
    with pytest.raises(ValueError):
        index.required(spark.range(1), ("x",))


def test_partners_across_ranges(spark):
    df = spark.createDataFrame([(i * i,) for i in range(50)] + [(None,)], "id long")
    for per in (7, 1000):
        assert {(r.id, r.other) for r in etl.cyclic_partner(df, "id", per_range=per).collect()} == {(i * i, (i + 1) % 50 * ((i + 1) % 50)) for i in range(50)}


def test_publishing_what_reads_its_target(spark, tmp_path):
    path = f"{tmp_path}/t"
    spark.range(10).write.parquet(path)
    old = spark.read.parquet(path)
    new = old.select(F.when(F.col("id") == 3, 30).otherwise(F.col("id")).alias("id"))
    files.replace_checked(old, new, 1, path)
    assert {r.id for r in spark.read.parquet(path).collect()} == {0, 1, 2, 4, 5, 6, 7, 8, 9, 30}


def test_safe_picks(spark):
    sweep = spark.createDataFrame([(0.5, 0.9, 0.3, 0.1), (0.6, 0.8, 0.04, 0.0), (0.7, 0.8, 0.04, 0.0), (0.8, 0.5, 0.001, 0.0)], "tau double, f1 double, false_match_rate double, noise_match_rate double")
    pick = lambda df: evaluation.safe_pick(df).first()
    assert tuple(pick(sweep)) == (0.8, True) and tuple(pick(sweep.filter("tau < 0.8"))) == (0.6, True) and tuple(pick(sweep.filter("tau < 0.6"))) == (0.5, False)


def test_adding_tracks(spark, tmp_path):
    t = spark.createDataFrame([("a.mp3", "T", "A", 2024, 12.5, "AQAA", "CC_BY"), ("b.mp3", "U", "B", 1999, 3.0, "AQAB", None)], "path string, title string, artist string, year int, duration double, fingerprint string, license string")
    files.add_tracks(t.limit(1), str(tmp_path))
    files.add_tracks(t, str(tmp_path))
    got = {n: spark.read.parquet(f"{tmp_path}/{n}") for n in files.TRACK_TABLES}
    assert {n: df.count() for n, df in got.items()} == dict.fromkeys(files.TRACK_TABLES, 2)
    joined = got["recordings"].join(got["compositions"], "composition_id").join(got["fingerprints"], "recording_id").join(got["rights"], "recording_id")
    assert joined.count() == 2
