"""Queries of the whole analysis, the index, registry matching, and calibration with noise."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..config import DEFAULT
from ..functions import text as T
from ..operators import analysis, audio_features, codec, etl, evaluation, fingerprint, index, jobs, postings, redaction, registry, rights, rules, vectors, windows
from ..sources import adapters as A
from ..sources import store
from . import evaluation as EV
from . import registry as RG
from . import rights as RI
from . import similarity as S

WIDTH = 64


# --- index


def _stored(spark, d):
    """Vectors as text, some of another width, some with a word in them, some zero; ids of a source, or shaped as UUIDs."""
    e = A.table(spark, d, "embeddings")
    v = F.transform("embedding", lambda x: F.when(F.col("vec_id") % 17 == 0, 0.0).otherwise(x.cast("double")).cast("string"))
    v = F.when(F.col("vec_id") % 11 == 0, F.slice(v, 1, WIDTH - 1)).when(F.col("vec_id") % 13 == 0, F.concat(F.array(F.lit("x")), F.slice(v, 2, WIDTH - 1))).otherwise(v)
    h = F.md5(F.col("vec_id").cast("string"))
    own = F.concat_ws("-", *[F.substring(h, a, n) for a, n in ((1, 8), (9, 4), (13, 4), (17, 4), (21, 12))])
    id_ = F.when(F.col("vec_id") % 7 == 0, own).otherwise(F.col("vec_id").cast("string"))
    return e.select("vec_id", id_.alias("recording_id"), F.array_join(v, ",").alias("vector"), (F.col("vec_id") % 3).cast("string").alias("model_version"), F.size(v).alias("dimension"))


def _metadata(spark, d):
    """Source ids of all parts; odd parts have one of their own, of the even ones three share one."""
    p = A.table(spark, d, "part")
    source = F.when(F.col("p_partkey") % 2 == 1, F.col("p_partkey")).otherwise(F.floor(F.col("p_partkey") / 6) * 2)
    return p.select(source.cast("string").alias("source_track_id"), F.concat(F.lit("rec-"), F.col("p_partkey").cast("string")).alias("recording_id"))


def index_build_remap(spark, d):
    r = index.remapped(_stored(spark, d), _metadata(spark, d), WIDTH)
    norm = F.sqrt(F.aggregate("vector", F.lit(0.0), lambda a, x: a + x * x))
    return r.select("vec_id", "recording_id", "how", F.round(F.get("vector", F.lit(1)), 5).alias("v1"), F.round(norm, 5).alias("norm"))


def index_build_stats(spark, d):
    return index.remapped(_stored(spark, d), _metadata(spark, d), WIDTH).groupBy("how").agg(F.count("*").alias("n"))


def index_from_table(spark, d):
    r = index.from_table(_stored(spark, d), "1", WIDTH)
    return r.select("vec_id", F.round(F.get("vector", F.lit(0)), 5).alias("v0"))


def index_load(spark, d):
    """Vectors and ids by position, after the check that there are as many of each."""
    e = A.table(spark, d, "embeddings")
    got = index.loaded(e.select(F.col("vec_id").alias("pos"), "embedding"), e.select(F.col("vec_id").alias("pos"), F.concat(F.lit("r"), F.floor(F.col("vec_id") / 2).cast("string")).alias("recording_id")))
    return got.select("pos", "recording_id", F.size("embedding").alias("width"))


NAMES = ("Attribution", "Attribution-NonCommercial", "Public Domain Mark", "CC0 1.0 Universal")


def label_decode(spark, d):
    li = index.required(A.table(spark, d, "lineitem"), ("l_orderkey", "l_linenumber"))
    return li.groupBy(index.decoded_label(F.col("l_linenumber") - 2, NAMES).alias("label")).agg(F.count("*").alias("n"))


# --- rules that stand alone


def creator_music(spark, d):
    share = F.get(F.array(*[F.lit(x) for x in ("True", " true ", "1", "nan", "", "False")]), F.pmod("l_partkey", F.lit(7)).cast("int"))
    kind = F.when(F.col("l_returnflag") == "R", "CREATOR_MUSIC").when(F.col("l_returnflag") == "A", "CC_BY")
    bought, agreed = rights.creator_flags(kind, share)
    return A.table(spark, d, "lineitem").groupBy(kind.alias("kind"), share.alias("share"), bought.alias("purchased"), agreed.alias("agreed")).agg(F.count("*").alias("n"))


def recording_pd(spark, d):
    year = F.when(F.col("p_partkey") % 5 == 0, F.lit("")).when(F.col("p_partkey") % 5 == 1, "n/a").when(F.col("p_partkey") % 5 == 2, F.concat((F.col("p_size") + 1930).cast("string"), F.lit(".0"))).otherwise((F.col("p_size") + 1930).cast("string"))
    return A.table(spark, d, "part").select("p_partkey", rights.recording_pd_plausible(year, 2026).alias("plausible"))


def source_texts(spark, d):
    label = F.get(F.array(*[F.lit(x) for x in (None, "", " nan ", "Label A", " Label B ")]), F.pmod("p_partkey", F.lit(5)).cast("int"))
    source = F.get(F.array(*[F.lit(x) for x in (None, "", "fma_metadata", "jamendo_api", "simulated", "Other")]), F.pmod("p_partkey", F.lit(6)).cast("int"))
    return A.table(spark, d, "part").select("p_partkey", rights.publisher_source(label).alias("rights_source"), rights.source_note(source).alias("note"))


def confidence_breakdown(spark, d):
    b = rules.confidence_breakdown(RI._as_of())
    x = RI._facts(spark, d).select("recording_id", b.alias("b"))
    return x.select("recording_id", F.array_join(F.transform("b.penalties", lambda p: p["code"]), ",").alias("codes"), F.col("b.final").alias("final"))


def _predicted(spark, d):
    kinds = ("CC_BY", "CC_BY_NC", "CC_BY_NC_ND", "UNKNOWN")
    kind = F.get(F.array(*[F.lit(x) for x in kinds]), A.bucket(F.col("recording_id"), "pred", 4))
    return RI._facts(spark, d).withColumn("predicted_type", kind).withColumn("probability", A.bucket(F.col("recording_id"), "prob", 100) / 100)


def predicted_rights(spark, d):
    """Decisions where a model's license stands in for rights that are missing."""
    x = rights.with_predicted(_predicted(spark, d), "m1").withColumn("rights_confidence", rules.rights_confidence(RI._as_of()))
    x = x.filter("rights_predicted").select("recording_id", "license_type", "rights_confidence", rules.decide(F.col("rights_confidence")).alias("d"))
    return x.select("recording_id", "license_type", "rights_confidence", F.col("d.risk").alias("risk"), F.col("d.condition").alias("condition"))


# --- analysis of a long input


def _windows(spark, d):
    """Windows of orders: lines are windows, their parts the recordings they resemble."""
    li = A.table(spark, d, "lineitem")
    w = li.groupBy(F.col("l_orderkey").alias("job"), F.col("l_linenumber").alias("window_idx")).agg(F.max(F.struct("l_quantity", "l_returnflag", "l_partkey")).alias("m"))
    q, flag = F.col("m.l_quantity"), F.col("m.l_returnflag")
    kind = F.when(q >= 48, "EXACT_MATCH").when(flag == "R", "NEAR_MATCH").when(flag == "A", "COVER_MATCH").otherwise("UNKNOWN")
    confidence = F.when(q > 5, q / 50).otherwise(0.0)
    return w.select(
        "job", "window_idx", kind.alias("match_type"), F.round(F.when(confidence != 0, confidence).otherwise(q / 100), 4).alias("score"),
        F.col("m.l_partkey").alias("recording_id"),
    )


def analysis_windows(spark, d):
    """Records of the windows scanned: those up to the first exact match, in order."""
    w = windows.scanned(_windows(spark, d), "job")
    rows = F.array_sort(F.collect_list(F.struct("window_idx", "match_type", "score")))
    return w.groupBy("job").agg(
        F.count("*").alias("scanned"), F.bool_or(F.col("match_type") == "EXACT_MATCH").alias("stopped_early"),
        F.array_join(F.transform(rows, lambda r: F.concat_ws(":", r["window_idx"].cast("string"), r["match_type"])), ",").alias("windows"),
    )


def analysis_response(spark, d):
    """Best window, its recording's rights, the decision and what to do, one row a job."""
    best = windows.best_window(_windows(spark, d), "job").select("job", "window_idx", "scanned", "match_type", "score", "recording_id")
    known = F.col("match_type") != "UNKNOWN"
    best = best.withColumn("rid", F.when(known, F.col("recording_id"))).drop("recording_id")
    facts = _predicted(spark, d).drop("match_type", "identity_confidence").withColumnRenamed("recording_id", "rid")
    x = best.join(facts, "rid", "left").withColumns({"has_rights": F.coalesce("has_rights", F.lit(False)), "identity_confidence": F.col("score")})
    x = rights.with_predicted(x, "m1").withColumn("rights_confidence", rules.rights_confidence(RI._as_of()))
    x = x.withColumn("d", rules.decide(F.col("rights_confidence")))
    return x.select(
        "job", "window_idx", "scanned", "match_type", "score", F.col("rid").alias("recording_id"), "title", "license_type", "rights_confidence",
        "d.category", "d.risk", "d.condition", "d.decision_confidence", rules.recommendation(F.col("d.condition")).alias("action"),
        registry.classify(F.col("match_type"), F.col("d.risk"), F.col("rid")).alias("unknown_kind"),
    )


#: Windows of a passage: so many items, at most so many windows.
SPAN, MOST = 20, 8


def _passage_windows(spark, d):
    """(query_id, job, window_idx, start, vec_id) of the windows of every passage, an item a second, and their items."""
    items = A.query_items(spark, d)
    n = A.table(spark, d, "embeddings").count()
    jobs = items.groupBy(F.col("query_id").alias("job")).agg(F.count("*").cast("double").alias("duration"))
    w = jobs.select("job", F.posexplode(windows.plan_windows(F.col("duration"), float(SPAN), MOST)).alias("window_idx", "start"))
    w = w.withColumns({"query_id": F.col("job") * 10 + F.col("window_idx"), "vec_id": F.pmod(F.col("job") * 7 + F.col("window_idx") * 3, F.lit(n))})
    first = F.floor("start")
    parts = items.withColumnRenamed("query_id", "job").drop("n").join(w.select("query_id", "job", "start"), "job").filter((F.col("pos") >= first) & (F.col("pos") < first + SPAN))
    return w, parts.select("query_id", (F.col("pos") - first).cast("int").alias("pos"), "h")


def _tiers(spark, d, parts):
    """The three tiers over the documents and vectors. A third of the windows may find the vector's own recording."""
    index, s, x = postings.near(parts, A.index_of(spark, d)), A.segments(spark, d), S._descriptors(spark, d)

    def fingerprints(rows):
        q = parts.join(rows.select("query_id"), "query_id", "left_semi")
        got = fingerprint.verdicts(postings.alignment(q, index), q.groupBy("query_id").agg(F.count("*").cast("double").alias("duration")))
        return got.select("query_id", F.col("doc_id").alias("id"), "score", F.col("threshold").alias("limit"))

    def embeddings(rows):
        own = rows.withColumn("own", F.pmod(F.col("job") + F.col("window_idx"), F.lit(3)) == 0)
        found = None
        for flag in (True, False):
            some = own.filter(F.col("own") == F.lit(flag))
            asked = s.join(some.select("vec_id").distinct(), "vec_id", "left_semi")
            got = vectors.retrieve(asked, s, k=1, exclude_own=not flag).select(F.col("query_id").alias("vec_id"), F.col("recording_id").alias("id"), "score")
            got = some.select("query_id", "vec_id").join(got, "vec_id")
            found = got if found is None else found.unionByName(got)
        return found

    def covers(rows):
        asked = x.join(rows.select("vec_id").distinct(), "vec_id", "left_semi")
        got = vectors.rotation_search(asked, x.union(S._moved(x)), S.PITCHES, S.FRAMES, 1)
        return rows.select("query_id", F.col("vec_id").alias("asked")).join(got.select(F.col("query_id").alias("asked"), F.col("vec_id").alias("id"), "score"), "asked")

    return fingerprints, embeddings, covers


def analyze_queries(spark, d):
    """Every passage from its windows to the decision; the response's fields, one row a passage."""
    w, parts = _passage_windows(spark, d)
    scanned = analysis.scan(store.cut(w), *_tiers(spark, d, store.cut(parts)), MOST)
    n = A.table(spark, d, "part").count()
    best = windows.best_window(scanned, "job").drop("scanned").join(analysis.counts(scanned), "job")
    best = best.withColumn("rid", F.when(F.col("match_type") != "UNKNOWN", F.pmod("matched_id", F.lit(n)) + 1)).withColumnRenamed("score", "identity_confidence")
    facts = _predicted(spark, d).drop("match_type", "identity_confidence").withColumnRenamed("recording_id", "rid")
    x = best.join(facts, "rid", "left").withColumn("has_rights", F.coalesce("has_rights", F.lit(False)))
    x = rights.with_predicted(x, "m1").withColumn("rights_confidence", rules.rights_confidence(RI._as_of()))
    x = x.withColumn("d", rules.decide(F.col("rights_confidence"))).withColumn("action", rules.recommendation(F.col("d.condition")))
    r = analysis.response(x).join(x.select("job", "window_idx", "vec_windows", "cover_windows"), "job")
    records = F.array_join(F.transform("response.evidence.windows", lambda v: F.concat_ws(":", v["window_idx"].cast("string"), v["stage"])), ",")
    return r.select(
        "job", "window_idx", "vec_windows", "cover_windows", "response.identity.recording_id", "response.identity.track", "response.match.type", "response.match.confidence",
        "response.match.pipeline_stage", "response.rights.license", "response.rights.rights_found", "response.assessment.risk", "response.assessment.condition",
        "response.assessment.rights_confidence", "response.recommendation", "response.evidence.windows_scanned", "response.evidence.stopped_early", records.alias("windows"),
    )


def hint_candidate(spark, d):
    """The first candidate of each job without a match, as a hint."""
    first = F.min_by(F.struct(F.col("l_partkey").alias("recording_id"), (F.col("l_discount") * 10).alias("score")), F.struct("l_linenumber", "l_partkey", "l_discount"))
    c = A.table(spark, d, "lineitem").groupBy("l_orderkey").agg(first.alias("c"))
    return c.select("l_orderkey", F.col("c.recording_id").alias("hint"), F.round("c.score", 4).alias("hint_score"))


def candidate_labels(spark, d):
    """Titles and artists of candidates; null where the catalogue lacks one."""
    c = A.table(spark, d, "lineitem").select(F.col("l_orderkey").alias("query_id"), F.col("l_linenumber").alias("rank"), F.col("l_partkey").alias("recording_id"))
    known = A.recordings(spark, d).filter("recording_id % 3 <> 0").select("recording_id", F.col("title").alias("track"), "artist")
    return c.join(known, "recording_id", "left").select("query_id", "rank", "recording_id", "track", "artist")


def recognize_describe(spark, d):
    """The best reference of each query without a threshold, with its work and rights."""
    best = postings.alignment(A.query_items(spark, d), A.index_of(spark, d)).groupBy("query_id").agg(F.max_by("doc_id", F.struct("score", -F.col("doc_id"))).alias("recording_id"), F.max("score").alias("score"))
    rec = A.recordings(spark, d).select("recording_id", "title", "artist", "composition_id")
    works = rec.select("composition_id", F.lower("composition_id").alias("composition_title")).distinct()
    held = RI._rights(spark, d).filter("recording_id is not null").select("recording_id", "license_type", "copyright_status")
    return best.join(rec, "recording_id").join(works, "composition_id", "left").join(held, "recording_id", "left").select(
        "query_id", "recording_id", "score", "title", "artist", "composition_title", "license_type", "copyright_status"
    )


# --- registry


def _similar(spark, d, score, name, at):
    li = A.table(spark, d, "lineitem")
    rows = li.groupBy(F.col("l_orderkey").alias("query_id"), F.col("l_suppkey").alias("unknown_id")).agg(F.max(score).alias("score"))
    return rows.withColumn("threshold", F.lit(at)) if name == "fp" else rows


def registry_match(spark, d):
    """Entry of each sighting by fingerprint, else embedding, else cover."""
    fp, mert, cover = _similar(spark, d, F.col("l_quantity") / 50, "fp", 0.96), _similar(spark, d, F.col("l_discount") * 10, "mert", 0), _similar(spark, d, F.round(F.col("l_tax") * 12, 4), "cover", 0)
    return registry.match_entry(fp, mert, cover).select("query_id", "unknown_id", F.round("score", 4).alias("score"), "method")


def registry_match_upsert(spark, d):
    """A batch of sightings matched to entries, those without one becoming entries of their own, folded into the state of earlier ones."""
    s = RG._sightings(spark, d)
    found = registry_match(spark, d).select(F.col("query_id").alias("sighting_id"), F.col("unknown_id").alias("entry"))
    old, new = s.filter("sighting_id % 2 = 0"), s.filter("sighting_id % 2 = 1")
    keyed = registry.keyed(new, found).withColumn("unknown_id", F.col("entry")).drop("entry")
    state = registry.upsert(registry.upsert(spark.createDataFrame([], registry.STATE), old), keyed)
    return state.select("unknown_id", "first_seen_at", "last_seen_at", "sighting_count")


def registry_features_recent(spark, d):
    """Features of the 20 entries seen last, of one model version."""
    e = registry.entries(RG._sightings(spark, d)).withColumn("kind", F.when(F.col("unknown_id") % 4 == 0, "RIGHTS_UNKNOWN").otherwise("NOT_IDENTIFIED"))
    f = A.table(spark, d, "embeddings").select((F.col("vec_id") % 90).alias("unknown_id"), "vec_id", (F.col("vec_id") % 2).cast("string").alias("model_version"))
    return registry.recent_features(f, e, "1", 20).select("unknown_id", "vec_id")


# --- calibration with noise


def _noise(spark, d):
    """Scores of noise probes: three colours, ten seeds."""
    rows = [(f"{c}_{s}",) for c in ("white", "pink", "brown") for s in range(10)]
    return spark.createDataFrame(rows, "name string").withColumn("score", A.bucket(F.col("name"), "noise", 70) / 100.0)


def noise_probes(spark, d):
    return _noise(spark, d)


def cover_noise_sweep(spark, d):
    known = EV._scores(spark, d)
    return evaluation.noise_sweep(known.select("score", (F.col("truth") == 1).alias("ok")), known.select(F.round(1 - F.col("score"), 6).alias("score")), _noise(spark, d), evaluation.grid(spark, 0.0, 1.0, 20))


def cover_threshold_pick(spark, d):
    return evaluation.safe_pick(cover_noise_sweep(spark, d))


def cover_grid_pick(spark, d):
    """The rule of the grid with the highest recall, then precision, then the stricter rule, within a bound of false matches."""
    g = S.cover_rule_grid(spark, d).filter("absolute = 2").groupBy("low", "delta").agg(F.sum("accepted").alias("accepted"), F.sum("correct").alias("correct"), F.sum("n").alias("n"))
    return evaluation.grid_pick(g.withColumn("false_rate", (F.col("accepted") - F.col("correct")) / F.col("n")), 0.9)


# --- experiments


def query_axis(spark, d):
    """Query time in source time: the manifest's value, else that of the transformation."""
    name = F.get(F.array(*[F.lit(x) for x in ("tempo_0_90", "tempo_1_10", "pitch_plus_1", "original")]), F.pmod("l_partkey", F.lit(4)).cast("int"))
    crop = F.when(F.col("l_linenumber") == 1, "").when(F.col("l_linenumber") == 2, "n/a").otherwise(F.col("l_quantity").cast("string"))
    tempo = F.when(F.col("l_linenumber") < 4, "").when(F.col("l_linenumber") == 4, "-1").otherwise("1.05")
    pitch = F.when(F.col("l_linenumber") < 6, "").otherwise("-3")
    start, factor, steps = windows.query_axis(name, crop, tempo, pitch)
    x = A.table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", start.alias("crop_start"), factor.alias("factor"), steps.alias("steps"))
    return x.withColumn("source_time", F.round(F.col("crop_start") + 7 * F.col("factor"), 4))


def augment_targets(spark, d):
    """Recordings with audio of their own and a license, and a seeded sample of them in order."""
    path = F.when(F.col("recording_id") % 4 == 0, None).when(F.col("recording_id") % 4 == 1, F.lit("simulated/x.mp3")).otherwise(F.concat(F.lit("audio/"), F.col("recording_id").cast("string")))
    rec = A.recordings(spark, d).withColumn("audio_path", path)
    return etl.audio_targets(rec, RI._rights(spark, d), "CC_BY").select("recording_id", "audio_path")


def augment_sample(spark, d):
    rec = A.recordings(spark, d)
    return etl.seeded_sample(rec, "recording_id", 25, 7).select("recording_id")


def tempo_histogram(spark, d):
    li = A.table(spark, d, "lineitem")
    return li.filter("l_discount > 0.04").groupBy(F.col("l_returnflag").alias("transformation"), F.round(0.9 + F.pmod("l_partkey", F.lit(5)) * 0.05, 2).alias("factor")).agg(F.count("*").alias("n"))


def same_protocol(spark, d):
    """Parameters of two result sets that differ; they may be joined when there are none."""
    a = spark.createDataFrame([("window_s", "15.0"), ("overlap_min", "0.5"), ("hop_s", "5.0")], "name string, value string")
    n = A.table(spark, d, "region").agg(F.count("*").cast("double").cast("string").alias("value")).select(F.lit("hop_s").alias("name"), "value")
    b = spark.createDataFrame([("window_s", "15.0"), ("extra", "1")], "name string, value string").union(n)
    return evaluation.protocol_differences(a, b)


def fingerprint_uniqueness(spark, d):
    return A.table(spark, d, "documents").agg(F.count("*").alias("n"), F.round(F.count_distinct("text") / F.count("*"), 6).alias("ratio"))


def end_to_end(spark, d):
    """Risk decided for what was found against the risk of the true recording at perfect identity, by condition."""
    x = RI._facts(spark, d).withColumn("rights_confidence", rules.rights_confidence(RI._as_of()))
    sure = x.withColumns({"match_type": F.lit("EXACT_MATCH"), "identity_confidence": F.lit(1.0)})
    truth = sure.select("recording_id", rules.decide(F.col("rights_confidence"))["risk"].alias("true_risk"))
    x = x.withColumns({"held_out": F.col("recording_id") % 3 == 0, "right": A.bucket(F.col("recording_id"), "hit", 10) < 8})
    said = x.select("recording_id", "held_out", "right", "match_type", rules.decide(F.col("rights_confidence"))["risk"].alias("risk"))
    rows = said.join(truth, "recording_id").withColumn("true_risk", F.when(F.col("held_out"), "UNKNOWN").otherwise(F.col("true_risk")))
    return evaluation.end_to_end_summary(rows)


def insert_absent_jobs(spark, d):
    o = A.table(spark, d, "orders")
    log = o.filter("o_orderkey % 2 = 0").select((F.col("o_orderkey") % 500).alias("job_id"))
    return jobs.insert_absent(log, o.select((F.col("o_orderkey") % 700).alias("job_id"))).select("job_id")


def service_state(spark, d):
    p = A.table(spark, d, "part")
    state = jobs.degraded(F.col("p_size") > 5, F.col("p_partkey") % 7 != 0, F.col("p_partkey") % 5 != 0)
    return p.groupBy(state.alias("state")).agg(F.count("*").alias("n"))


def duration_window(spark, d):
    li = A.table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", F.col("l_quantity").alias("q_duration"), F.when(F.col("l_linenumber") > 2, F.col("l_tax") * 500).alias("r_duration"))
    return fingerprint.within_duration(li, 8.0).groupBy("l_linenumber").agg(F.count("*").alias("n"))


def class_floor(spark, d):
    return etl.floor_classes(A.table(spark, d, "part").select("p_brand", "p_type"), "p_type", 3).groupBy("p_type").agg(F.count("*").alias("n"))


def tempo_spans(spark, d):
    """Spans of a query by tempo that come out equally long are one; its factor is the nearest."""
    q = A.table(spark, d, "part").select(F.col("p_partkey").alias("query_id"), (F.col("p_size") + 10.0).alias("length"))
    s = q.select("query_id", "length", F.explode(windows.query_spans(30.0, (0.90, 0.95, 1.00, 1.05, 1.10))).alias("s")).select("query_id", "s.factor", "s.seconds", F.least(F.col("length"), F.floor(F.col("s.seconds") + 0.5)).alias("actual"))
    return windows.collapsed_spans(s, "actual")


def index_segments(spark, d):
    x = A.table(spark, d, "orders").select("o_orderkey", windows.cents(F.col("o_totalprice") / 4000).alias("duration"))
    return x.select("o_orderkey", F.posexplode(windows.index_segments(F.col("duration"))).alias("idx", "s")).select("o_orderkey", "idx", F.round("s.start", 2).alias("start"), F.round("s.end", 2).alias("end"))


def production_features(spark, d):
    x = A.table(spark, d, "embeddings").select(F.col("vec_id").alias("id"), F.when(F.col("vec_id") % 9 == 0, F.slice("embedding", 1, 40)).otherwise(F.col("embedding")).alias("x"))
    p = audio_features.production(x, "x", 64)
    score, label = audio_features.polish(F.col("crest_factor_db"), F.col("rms_dbfs") + 10, F.col("dynamic_range_db"))
    return p.select("id", *audio_features.FEATURES, score.alias("polish"), label.alias("label"))


def iso_times(spark, d):
    return A.table(spark, d, "orders").select("o_orderkey", T.iso(F.col("o_orderdate")).alias("iso"))


def vector_bytes(spark, d):
    """Vectors as stored bytes and read back; those of another width give null."""
    e = A.table(spark, d, "embeddings").withColumn("v", F.when(F.col("vec_id") % 10 == 0, F.slice("embedding", 1, 60)).otherwise(F.col("embedding")))
    x = e.withColumn("b", codec.bytes_of_vector(F.col("v"))).withColumn("back", codec.vector_of_bytes(F.col("b"), WIDTH))
    return x.select("vec_id", F.length("b").alias("n_bytes"), (F.col("back") == F.col("embedding")).alias("same"))


def undecodable(spark, d):
    """How many stored strings can be read as fingerprints."""
    q = A.query_items(spark, d)
    seq = q.groupBy("query_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("pos", "h"))), lambda s: s["h"]).alias("items"))
    text = F.when(F.col("query_id") % 4 == 0, "!!").otherwise(codec.encoded(F.col("items")))
    return codec.readable(seq.select("query_id", text.alias("text")), "text")[1]


def noise_segments(spark, d):
    e = A.table(spark, d, "embeddings")
    out = registry.noise_like(e.select("vec_id", "embedding"), e.filter("vec_id in (3, 5, 8)"), 0.25)
    return out.select("vec_id", "noise")


def held_out_leaks(spark, d):
    """Answers that lie in their own exclusion set."""
    li = A.table(spark, d, "lineitem")
    answers = li.select(F.col("l_suppkey").alias("query_source"), (F.col("l_partkey") % 50).alias("answer"))
    exclusions = A.table(spark, d, "supplier").select(F.col("s_suppkey").alias("source"), (F.col("s_suppkey") % 50).alias("excluded"))
    return evaluation.leaks(answers, exclusions).groupBy("query_source").agg(F.count("*").alias("n"))


def cover_descriptors(spark, d):
    """Descriptors of two lengths of chroma: 5 frames to 8, and 5 frames to 2."""
    c = A.table(spark, d, "embeddings").select(F.col("vec_id").alias("id"), F.transform(F.slice("embedding", 1, 60), lambda x: F.abs(x).cast("double")).alias("chroma"))
    up, down = (audio_features.descriptors(c, 12, n).select("id", F.lit(n).alias("frames"), F.posexplode("v").alias("i", "x")) for n in (8, 2))
    return up.union(down).select("id", "frames", "i", F.round("x", 5).alias("x"))


def public_projection(spark, d):
    """Evidence as the public sees it: no thresholds, two digits."""
    li = A.table(spark, d, "lineitem")
    e = li.select("l_orderkey", "l_linenumber", F.struct(F.round(F.col("l_tax") * 7.0 + 0.001, 4).alias("score"), F.lit(0.9).alias("threshold"), F.struct(F.lit(0.3).alias("threshold"), F.col("l_suppkey").alias("id")).alias("best")).alias("e"))
    out = e.withColumn("p", T.rounded_struct(F.col("e"), e.schema["e"].dataType))
    return out.select("l_orderkey", "l_linenumber", F.to_json("p").alias("json"))


def public_documents(spark, d):
    """Event properties of no fixed shape, as the public sees them."""
    e = A.table(spark, d, "events")
    inner = F.concat(F.lit('{"threshold":0.3,"score":'), F.round(F.col("value") * 7 + 0.001, 4).cast("string"), F.lit(',"list":[{"thresholds":[1,2],"v":'), F.round(F.col("value") / 3, 5).cast("string"), F.lit('},"x",null]}'))
    text = F.when(F.col("event_type") == "error", F.col("props")).otherwise(F.concat(F.lit('{"props":'), "props", F.lit(',"min_rights_confidence":0.5,"evidence":'), inner, F.lit("}")))
    return redaction.public(e.select("event_id", text.alias("json")), "event_id", "json")


GROUP_TYPES = ("AUDIO_LIBRARY", "CREATOR_MUSIC", "CONTENT_ID", "CC_BY", "PUBLIC_DOMAIN")


def rights_integrity(spark, d):
    """Checks of rights against their recordings, by one aggregate."""
    r = RI._rights(spark, d).join(A.recordings(spark, d).select("recording_id", "release_year"), "recording_id", "left")
    simulated = F.upper(F.coalesce("rights_source", F.lit(""))).startswith("SIMULATED")
    old = rights.recording_pd_plausible(F.col("release_year"), 2026)
    rows = etl.checked(r, {
        "verified_simulated": ("FAIL", simulated & F.col("verified_at").isNotNull(), "simulated rights that claim a check"),
        "recording_pd_age": ("FAIL", F.col("recording_public_domain") & ~old & F.coalesce(F.col("license_type") != "CC0", F.lit(True)), "free recordings that are too young"),
        "creator_flags": ("FAIL", (F.col("license_type") == "CREATOR_MUSIC") & (F.col("license_purchased") == F.col("revenue_share_agreed")), "creator music bought and shared, or neither"),
        "missing_license": ("WARN", F.col("license_type").isNull(), "rights without a license type"),
    })
    seen = r.agg(F.collect_set("license_type").alias("t"), F.collect_set("copyright_status").alias("s"))  # a handful of values
    gap = lambda have, want: F.size(F.array_except(F.array(*[F.lit(x) for x in want]), have)).cast("long")
    cover = seen.select(F.explode(F.array(
        F.struct(F.lit("rule_groups").alias("check"), gap("t", GROUP_TYPES).alias("n"), F.lit("groups without rights").alias("detail")),
        F.struct(F.lit("statuses").alias("check"), gap("s", ("PROTECTED", "PUBLIC_DOMAIN", "LICENSED")).alias("n"), F.lit("statuses without rights").alias("detail")),
    )).alias("r")).select("r.check", F.when(F.col("r.n") == 0, "PASS").otherwise("WARN").alias("status"), "r.n", "r.detail")
    return rows.union(cover)


def registry_detail(spark, d):
    """Entries with the catalogue row of their recording and that of their hint."""
    e = registry.upsert(spark.createDataFrame([], registry.STATE), RG._sightings(spark, d)).withColumn("recording_id", F.when(F.col("unknown_id") % 4 == 0, F.col("unknown_id") + 1))
    rec = A.recordings(spark, d)
    r = rec.select(F.col("recording_id").alias("rid"), F.col("artist").alias("catalogue_artist"))
    h = rec.select(F.col("recording_id").alias("hid"), F.col("title").alias("hint_title"), F.col("artist").alias("hint_artist"))
    return e.join(r, e["recording_id"] == r["rid"], "left").join(h, e["hint"] == h["hid"], "left").select("unknown_id", "sighting_count", "catalogue_artist", "hint", "hint_title", "hint_artist")


def relabel_three(spark, d):
    """How many rows of recordings, rights and compositions the relabelling changes, and what they become."""
    rec = A.recordings(spark, d).select("recording_id", "composition_id", "release_year", F.get(F.array(*[F.lit(x) for x in (etl.SIMULATED_SET, "MTG-Jamendo", "FMA", "Spotify", None)]), F.pmod("recording_id", F.lit(5)).cast("int")).alias("source_dataset"))
    a = etl.relabelled_recordings(rec.withColumn("metadata_verified", F.col("recording_id") % 2 == 0)).select(F.lit("recordings").alias("t"), "changed", F.col("metadata_verified").cast("string").alias("value"))
    r = RI._rights(spark, d).filter("recording_id is not null").drop("composition_id").join(rec.drop("composition_id"), "recording_id")
    r = r.withColumn("source", F.when(F.col("recording_id") % 7 == 0, " Spotify API / nan").otherwise(F.col("rights_source")))
    b = etl.relabelled_rights(r, 2026).select(F.lit("rights"), "changed", F.concat_ws("|", "source", F.col("license_purchased").cast("string"), F.col("revenue_share_agreed").cast("string"), "copyright_status", F.col("verified_at").isNull().cast("string")))
    c = rec.select("composition_id", "source_dataset", F.lit("x").alias("source"), F.lit("t").alias("verified_at"), A.pd_status(F.col("composition_id")).alias("public_domain_status"))
    c = etl.relabelled_compositions(c).select(F.lit("compositions"), "changed", F.concat_ws("|", "source", "public_domain_status", F.coalesce("verified_at", F.lit("-"))))
    return a.union(b).union(c).groupBy("t", "changed", "value").agg(F.count("*").alias("n"))


def margin_runner_up(spark, d):
    """Best recording of each query, the next other one, and the next of another class."""
    li = A.table(spark, d, "lineitem")
    scores = li.select(F.col("l_orderkey").alias("query_id"), F.col("l_suppkey").alias("recording_id"), (F.col("l_quantity") / 50).alias("score"))
    classes = A.table(spark, d, "supplier").select(F.col("s_suppkey").alias("recording_id"), (F.col("s_suppkey") % 3).cast("string").alias("cls"))
    return vectors.top_two(scores, classes)


def unknown_rejection_sweep(spark, d):
    li = A.table(spark, d, "lineitem")
    known = li.filter("l_linenumber <= 4").select((F.col("l_quantity") / 50).alias("score"), (F.col("l_returnflag") == "N").alias("ok"))
    return evaluation.unknown_sweep(known, li.filter("l_linenumber > 4").select((F.col("l_quantity") / 100).alias("score")), evaluation.grid(spark, 0.0, 1.0, 10))


def two_false_rates(spark, d):
    li = A.table(spark, d, "lineitem")
    r = li.select((F.col("l_quantity") / 50).alias("score"), (F.col("l_returnflag") == "N").alias("ok"), (F.col("l_tax") * 10).alias("held"), F.when(F.col("l_linenumber") > 1, F.col("l_discount") * 9).alias("held_exact"))
    return evaluation.two_rate_sweep(r, evaluation.grid(spark, 0.0, 1.0, 10))


def normalised_fields(spark, d):
    p = A.table(spark, d, "part")
    artist, title = F.when(F.col("p_partkey") % 3 == 0, F.lit(" ")).otherwise(F.col("p_brand")), F.when(F.col("p_partkey") % 2 == 0, F.concat("p_name", F.lit(" (Some One)")))
    ms = F.when(F.col("p_partkey") % 5 == 0, None).otherwise(F.col("p_retailprice") * 7)
    return p.select("p_partkey", T.composer(title, artist).alias("composer"), T.seconds(F.round(ms, 0)).alias("seconds"), T.year(F.when(F.col("p_partkey") % 4 == 0, "n/a").otherwise("1987-05")).alias("year"))


QUERIES = {f.__name__: f for f in (
    registry_detail, relabel_three, margin_runner_up, unknown_rejection_sweep, two_false_rates, normalised_fields, rights_integrity, vector_bytes, undecodable, noise_segments, held_out_leaks, cover_descriptors, public_projection, public_documents, index_build_remap, index_build_stats, index_from_table, index_load, label_decode, creator_music, recording_pd, source_texts, confidence_breakdown, predicted_rights,
    analysis_windows, analysis_response, analyze_queries, hint_candidate, candidate_labels, recognize_describe, registry_match, registry_match_upsert, registry_features_recent,
    noise_probes, cover_noise_sweep, cover_threshold_pick, cover_grid_pick, query_axis, augment_targets, augment_sample, tempo_histogram, same_protocol,
    fingerprint_uniqueness, end_to_end, insert_absent_jobs, service_state, duration_window, class_floor, tempo_spans, index_segments, production_features, iso_times,
)}

# --- SQL

_STORED = """st as (select vec_id, list_transform(embedding, lambda x: case when vec_id % 17 = 0 then 0::double else x::double end) as v0, md5(vec_id::varchar) as h from embeddings),
sv as (select vec_id, case when vec_id % 7 = 0 then h[1:8] || '-' || h[9:12] || '-' || h[13:16] || '-' || h[17:20] || '-' || h[21:32] else vec_id::varchar end as rid, v0, (vec_id % 3)::varchar as model_version,
    vec_id % 11 = 0 as bad_dim, vec_id % 11 <> 0 and vec_id % 13 = 0 as bad_values, sqrt(list_sum(list_transform(v0, lambda x: x * x))) as norm from st),
m0 as (select (case when p_partkey % 2 = 1 then p_partkey else p_partkey // 6 * 2 end)::varchar as src, 'rec-' || p_partkey as rec from part), mp as (select src, min(rec) as target from m0 group by src having count(*) = 1),
hw as (select sv.*, target, case when bad_dim then 'bad_dim' when target is null and len(rid) <> 36 then 'unmapped' when bad_values then 'bad_values' when target is not null then 'remapped' else 'already_uuid' end as how from sv left join mp on src = rid)"""
_LI_W = """g as (select l_orderkey as job, l_linenumber as window_idx, max((l_quantity, l_returnflag, l_partkey)) as m from lineitem group by all),
w as (select job, window_idx, m[3] as recording_id, case when m[1] >= 48 then 'EXACT_MATCH' when m[2] = 'R' then 'NEAR_MATCH' when m[2] = 'A' then 'COVER_MATCH' else 'UNKNOWN' end as match_type,
    round(case when m[1] > 5 then m[1] / 50 else m[1] / 100 end, 4) as score from g),
s as (select *, min(case when match_type = 'EXACT_MATCH' then window_idx end) over (partition by job) as stop from w), v as (select *, case match_type when 'EXACT_MATCH' then 3 when 'COVER_MATCH' then 2 when 'NEAR_MATCH' then 1 else 0 end as k from s where stop is null or window_idx <= stop)"""
_KIND = f"['CC_BY', 'CC_BY_NC', 'CC_BY_NC_ND', 'UNKNOWN'][{A.sql_bucket('recording_id', 'pred', 4)} + 1]"


def _with_predicted_sql(facts: str, cols: str) -> str:
    """Facts with a model's license where rights are missing."""
    use = "(not has and ptype <> 'UNKNOWN')"
    lic = {"attribution_required": "true", "commercial_use_allowed": "ptype = 'CC_BY'", "monetization_allowed": "ptype = 'CC_BY'", "license_purchased": "false", "revenue_share_agreed": "false"}
    flags = ", ".join(f"case when {use} then {v} else {k} end as {k}" for k, v in lic.items())
    return f"""select {cols}, case when {use} then 'LICENSE_PREDICTED' else match_type end as match_type, has or {use} as has, {use} as predicted, case when {use} then ptype else license_type end as license_type,
    case when {use} then 'PROTECTED' else copyright_status end as copyright_status, {flags}, case when {use} then 'NONE' else policy_action end as policy_action, coalesce(recording_public_domain, false) as recording_public_domain,
    ic, com, mon, valid, pd, case when {use} then round(1 - {rules.PENALTIES["predicted_source"]}::double - {rules.PENALTIES["unverified"]}::double, 4) else rc end as rc from {facts}"""


_PRED = f"{RI._HEADG}, {RI._FACT}, f1 as (select *, {_KIND} as ptype from facts)"
_MATCH = """b1 as (select l_orderkey as query_id, l_suppkey as unknown_id, max(l_quantity / 50) as fp, max(l_discount * 10) as mert, max(round(l_tax * 12, 4)) as cover from lineitem group by all),
b2 as (select query_id, unknown_id, fp as score, 'FINGERPRINT' as method, 0 as o from b1 where fp >= 0.96 union all select query_id, unknown_id, mert, 'EMBEDDING', 1 from b1 where mert >= 0.98 union all select query_id, unknown_id, cover, 'COVER', 2 from b1 where cover >= 0.90),
mt as (select query_id, unknown_id, round(score, 4) as score, method from b2 qualify row_number() over (partition by query_id order by o, score desc, unknown_id) = 1)"""
_NOISE = f"nz as (select name, {A.sql_bucket('name', 'noise', 70)} / 100.0::double as score from (select c || '_' || s as name from unnest(['white', 'pink', 'brown']) a(c), unnest(generate_series(0, 9)) b(s)))"
_NSWEEP = f"""{EV._SC} hd as (select round(1 - score, 6) as score from scored), {_NOISE}, taus as (select round(i * 0.05::double, 4) as tau from (select unnest(generate_series(0, 20)) as i)),
ag as (select tau, (select count(*) from scored where score >= tau and truth is not null) as a, (select count(*) from scored where score >= tau and truth = 1) as c, (select count(*) from scored) as alla,
    (select count(*) from hd where score >= tau) as h, (select count(*) from nz where score >= tau) as n from taus),
pr as (select *, case when a > 0 then c / a::double else 0 end as p, case when alla > 0 then c / alla::double else 0 end as r from ag),
nsweep as (select tau, a as accepted, round(p, 4) as "precision", round(r, 4) as recall, round(case when p + r > 0 then 2 * p * r / (p + r) else 0 end, 4) as f1, round(h / alla::double, 4) as false_match_rate, round(n / 30.0::double, 4) as noise_match_rate from pr)"""
_DB = "20 * log10(greatest({x}, 1e-10))"
_DESC = """c as (select vec_id as id, (i - 1) // 5 as r, (i - 1) % 5 as f, abs(embedding[i])::double as x from embeddings, unnest(generate_series(1, 60)) t(i)),
res as (select id, 8 as frames, r, k as f, x from c join (select k, [0, 1, 1, 2, 2, 3, 3, 4][k + 1] as src from unnest(generate_series(0, 7)) t(k)) on f = src
    union all select id, 2, r, case when f < 2 then 0 else 1 end, avg(x) from c group by all),
cen as (select *, x - avg(x) over (partition by id, frames, f) as y from res), nor as (select *, sqrt(sum(y * y) over (partition by id, frames, f)) as n from cen),
fr as (select *, case when n > 1e-8 then y / n else 0 end as z from nor), whole as (select *, sqrt(sum(z * z) over (partition by id, frames)) as w from fr)"""
def _bad(name: str, severity: str, bad: str, detail: str) -> str:
    return f"select '{name}' as \"check\", case when n = 0 then 'PASS' else '{severity}' end as status, n, '{detail}' as detail from (select count(*) filter (where {bad}) as n from j)"


_GRID10 = "taus as (select round(i * 0.1::double, 4) as tau from (select unnest(generate_series(0, 10)) as i))"
_DSET = f"['{etl.SIMULATED_SET}', 'MTG-Jamendo', 'FMA', 'Spotify', null][recording_id % 5 + 1]"
ORACLE = {
    "registry_detail": """with s as (select user_id, count(*) as n, arg_max(event_id % 7, (ts, event_id)) filter (where event_id % 3 = 0) as hint from events group by 1)
select user_id as unknown_id, n as sighting_count, r.p_brand as catalogue_artist, hint, h.p_name as hint_title, h.p_brand as hint_artist from s left join part r on user_id % 4 = 0 and r.p_partkey = user_id + 1 left join part h on h.p_partkey = hint""",
    "relabel_three": f"""with {A.SQL_REC}, {RI._SIM}, rs as (select *, {_DSET} as ds from rec), ra as (select recording_id % 2 = 0 as old, coalesce(ds = 'FMA', false) as new from rs),
r0 as (select r.*, rs.ds, rs.release_year, case when r.recording_id % 7 = 0 then ' Spotify API / nan' else rights_source end as src from rights r join rs using (recording_id)),
r1 as (select *, coalesce(ds = '{etl.SIMULATED_SET}', false) as sim, revenue_share_required as share, coalesce(ds = '{etl.SIMULATED_SET}', false) and coalesce(recording_public_domain, false) and not release_year <= 1956 as young from r0),
r2 as (select *, case when sim then '{etl.SIMULATED_SOURCE}' when trim(src) = 'Spotify API / nan' then 'Spotify API / {rights.NO_PUBLISHER}' else src end as src2, case when not sim then verified_at end as at2,
    case when sim then coalesce(license_type = 'CREATOR_MUSIC', false) and not share else license_purchased end as bought, case when sim then share else revenue_share_agreed end as agreed, case when young then 'PROTECTED' else copyright_status end as cs2 from r1),
c as (select coalesce(ds = '{etl.SIMULATED_SET}', false) as sim, coalesce(ds = 'MTG-Jamendo', false) as dec, {A.sql_pd("composition_id")} as pd from rs),
u as (select 'recordings' as t, old <> new as changed, new::varchar as value from ra union all
select 'rights', src2 is distinct from src or at2 is distinct from verified_at or bought is distinct from license_purchased or agreed is distinct from revenue_share_agreed or cs2 is distinct from copyright_status or (young and (recording_public_domain or commercial_use_allowed or monetization_allowed)),
    concat_ws('|', src2, bought::varchar, agreed::varchar, cs2, (at2 is null)::varchar) from r2 union all
select 'compositions', sim or dec, concat_ws('|', case when sim then '{etl.SIMULATED_SOURCE}' else 'x' end, case when sim and pd = 'verified' then 'possible' else pd end, case when sim or dec then '-' else 't' end) from c)
select t, changed, value, count(*) as n from u group by all""",
    "margin_runner_up": """with p as (select l_orderkey as query_id, l_suppkey as rid, max(l_quantity / 50) as score from lineitem group by all), f as (select * from p qualify row_number() over (partition by query_id order by score desc, rid) = 1)
select f.query_id, f.rid as best, f.score as s1, max(p.score) as s2_any, max(case when p.rid % 3 <> f.rid % 3 then p.score end) as s2_dedup from f left join p on p.query_id = f.query_id and p.rid <> f.rid group by all""",
    "unknown_rejection_sweep": f"""with {_GRID10}, k as (select l_quantity / 50 as s, l_returnflag = 'N' as ok from lineitem where l_linenumber <= 4), u as (select l_quantity / 100 as s from lineitem where l_linenumber > 4),
a as (select tau, (select count(*) from k where s >= tau)::double as k, (select count(*) from k where s >= tau and ok)::double as c, (select count(*) from u where s >= tau)::double as u, (select count(*) from k)::double as nk, (select count(*) from u)::double as nu from taus)
select tau, round(u / nu, 4) as false_match_rate, round(1 - u / nu, 4) as unknown_recall, round(case when nu - u + nk - k > 0 then (nu - u) / (nu - u + nk - k) else 0 end, 4) as unknown_precision, round(c / nk, 4) as true_accept_rate, round((k - c) / nk, 4) as wrong_accept_rate from a""",
    "two_false_rates": f"""with {_GRID10}, r as (select l_quantity / 50 as s, l_returnflag = 'N' as ok, l_tax * 10 as h, case when l_linenumber > 1 then l_discount * 9 else l_tax * 10 end as e from lineitem),
a as (select tau, count(*) filter (where s >= tau) as k, count(*) filter (where s >= tau and ok) as c, count(*) filter (where h >= tau) as h, count(*) filter (where e >= tau) as e, count(*)::double as n from taus, r group by 1),
p as (select *, case when k > 0 then c / k::double else 0 end as p, c / n as r from a)
select tau, round(p, 4) as "precision", round(r, 4) as recall, round(case when p + r > 0 then 2 * p * r / (p + r) else 0 end, 4) as f1, round(h / n, 4) as false_positive_rate, round(e / n, 4) as false_positive_rate_exact_only, k as accepted from p""",
    "normalised_fields": """select p_partkey, case when p_partkey % 2 = 0 then 'Some One' when p_partkey % 3 = 0 then 'Unknown Composer' else p_brand end as composer,
case when p_partkey % 5 = 0 then 0 else round(round(p_retailprice * 7, 0) / 1000, 2) end as seconds, case when p_partkey % 4 = 0 then 2020 else 1987 end::int as year from part""",
    "rights_integrity": f"with {A.SQL_REC}, {RI._SIM}, j as (select r.*, rec.release_year from rights r left join rec using (recording_id)) " + " union all ".join([
        _bad("verified_simulated", "FAIL", "starts_with(upper(coalesce(rights_source, '')), 'SIMULATED') and verified_at is not null", "simulated rights that claim a check"),
        _bad("recording_pd_age", "FAIL", "recording_public_domain and not coalesce(release_year <= 1956, false) and coalesce(license_type <> 'CC0', true)", "free recordings that are too young"),
        _bad("creator_flags", "FAIL", "license_type = 'CREATOR_MUSIC' and license_purchased = revenue_share_agreed", "creator music bought and shared, or neither"),
        _bad("missing_license", "WARN", "license_type is null", "rights without a license type"),
        f"select 'rule_groups', case when n = 0 then 'PASS' else 'WARN' end, n, 'groups without rights' from (select count(*) as n from unnest(['{"', '".join(GROUP_TYPES)}']) t(x) where x not in (select license_type from j where license_type is not null))",
        "select 'statuses', case when n = 0 then 'PASS' else 'WARN' end, n, 'statuses without rights' from (select count(*) as n from unnest(['PROTECTED', 'PUBLIC_DOMAIN', 'LICENSED']) t(x) where x not in (select copyright_status from j where copyright_status is not null))",
    ]),
    "vector_bytes": "select vec_id, (case when vec_id % 10 = 0 then 240 else 256 end)::int as n_bytes, case when vec_id % 10 <> 0 then true end as same from embeddings",
    "undecodable": f"with {A.SQL_Q}, k as (select distinct query_id from q) select count(*) filter (where query_id % 4 <> 0) as read, count(*) filter (where query_id % 4 = 0) as skipped from k",
    "noise_segments": "with e as (select vec_id, embedding::double[] as v from embeddings) select vec_id, (select max(list_dot_product(e.v, p.v)) from e p where p.vec_id in (3, 5, 8)) >= 0.25 as noise from e",
    "held_out_leaks": "select l_suppkey as query_source, count(*) as n from lineitem join supplier on s_suppkey = l_suppkey where l_partkey % 50 = s_suppkey % 50 group by 1",
    "cover_descriptors": f"with {_DESC} select id, frames, (r * frames + f)::int as i, round(case when w > 1e-8 then z / w else z end, 5) as x from whole",
    "public_projection": """select l_orderkey, l_linenumber, '{"score":' || round(round(l_tax * 7 + 0.001, 4), 2)::double || ',"best":{"id":' || l_suppkey || '}}' as json from lineitem""",
    "public_documents": """select event_id, case when event_type = 'error' then '{"k":' || json_extract_string(props, '$.k') || '}' else '{"evidence":{"list":[{"v":' || round(round(value / 3, 5), 2)::double || '},"x",null],"score":'
    || round(round(value * 7 + 0.001, 4), 2)::double || '},"props":{"k":' || json_extract_string(props, '$.k') || '}}' end as json from events""",
    "index_build_remap": f"""with {_STORED} select vec_id, case when how = 'remapped' then target else coalesce(target, rid) end as recording_id, how,
round(case when how in ('remapped', 'already_uuid') then case when norm > 0 then v0[2] / norm else 0 end end, 5) as v1, round(case when how in ('remapped', 'already_uuid') then case when norm > 0 then 1::double else 0 end end, 5) as norm from hw""",
    "index_build_stats": f"with {_STORED} select how, count(*) as n from hw group by 1",
    "index_from_table": f"with {_STORED} select vec_id, round(case when norm > 0 then v0[1] / norm else 0 end, 5) as v0 from sv where model_version = '1' and not bad_dim and not bad_values",
    "index_load": "select vec_id as pos, 'r' || (vec_id // 2) as recording_id, len(embedding)::int as width from embeddings",
    "label_decode": "select case when l_linenumber >= 2 then ['" + "', '".join(NAMES) + "'][l_linenumber - 1] end as label, count(*) as n from lineitem group by 1",
    "creator_music": """with x as (select case l_returnflag when 'R' then 'CREATOR_MUSIC' when 'A' then 'CC_BY' end as kind, ['True', ' true ', '1', 'nan', '', 'False'][l_partkey % 7 + 1] as share from lineitem),
y as (select *, coalesce(lower(trim(share)) in ('true', '1'), false) as agreed from x) select kind, share, coalesce(kind = 'CREATOR_MUSIC', false) and not agreed as purchased, agreed, count(*) as n from y group by all""",
    "recording_pd": "select p_partkey, p_partkey % 5 > 1 and p_size + 1930 <= 1956 as plausible from part",
    "source_texts": f"""select p_partkey, 'Spotify API / ' || case p_partkey % 5 when 3 then 'Label A' when 4 then 'Label B' else '{rights.NO_PUBLISHER}' end as rights_source,
case p_partkey % 6 when 2 then '{rights.SOURCE_NOTES["fma_metadata"]}' when 3 then '{rights.SOURCE_NOTES["jamendo_api"]}' when 4 then '{rights.SOURCE_NOTES["simulated"]}' when 5 then 'Dữ liệu từ nguồn: Other' end as note from part""",
    "confidence_breakdown": f"""{RI._HEADG}, {RI._FACT} select recording_id, case when has then array_to_string(list_filter([case when license_type is null or license_type in ('UNKNOWN', '') then 'missing_license_type' end,
case when copyright_status is null then 'missing_copyright_status' end, case when starts_with(rights_source, 'SIMULATED') then 'simulated_source' end, case when verified_at is null then 'unverified' end,
case when verified_at is null and starts_with(rights_source, 'SIMULATED') then 'simulated_unverified' end, case when date '{A.AS_OF}' - verified_at > 365 then 'stale_penalty' end,
case when not (date '{A.AS_OF}' >= valid_from and date '{A.AS_OF}' <= valid_until) then 'license_expired' end], lambda x: x is not null), ',') else '' end as codes, rc as final from facts""",
    "predicted_rights": f"""{_PRED}, f2 as ({_with_predicted_sql("f1", "recording_id")}), dec as ({RI._decide_sql("f2", "com", "mon")}), {RI._OUT} select recording_id, license_type, rc as rights_confidence, risk, condition from result where predicted""",
    "analysis_windows": f"""with {_LI_W} select job, count(*) as scanned, bool_or(match_type = 'EXACT_MATCH') as stopped_early, string_agg(window_idx || ':' || match_type, ',' order by window_idx) as windows from v group by 1""",
    "analysis_response": f"""{_PRED}, {_LI_W},
bw as (select *, count(*) over (partition by job) as scanned from v qualify row_number() over (partition by job order by k > 0 desc, score desc, k desc, window_idx) = 1),
b as (select job, window_idx, scanned, match_type as kind, score, case when match_type <> 'UNKNOWN' then recording_id end as rid from bw),
j as (select b.*, f.* exclude (recording_id, match_type, ic, has, rc, ptype), kind as match_type, score as ic, coalesce(f.has, false) as has, case when coalesce(f.has, false) then f.rc else 0 end as rc, coalesce(f.ptype, 'UNKNOWN') as ptype, part.p_name as title
    from b left join f1 f on f.recording_id = b.rid left join part on p_partkey = b.rid),
f2 as ({_with_predicted_sql("j", "job, window_idx, scanned, score, rid, title")}), dec as ({RI._decide_sql("f2", "com", "mon")}), {RI._OUT}
select job, window_idx, scanned, match_type, score, rid as recording_id, title, license_type, rc as rights_confidence, category, risk, condition, decision_confidence, {RI._RECS} as action,
case when match_type = 'UNKNOWN' then 'NOT_IDENTIFIED' when risk = 'UNKNOWN' and rid is not null then 'RIGHTS_UNKNOWN' end as unknown_kind from result""",
    "analyze_queries": f"""{_PRED}, {S._BASE.removeprefix("with ")},
qn as (select query_id as job, count(*) as n from q group by 1), qk as (select *, case when n <= {SPAN} then 1 else least({MOST}, greatest(2, ceil(n / {SPAN})::int)) end as k from qn),
pl as (select job, i::int as window_idx, case when k = 1 then 0 else floor(i * (n - {SPAN}) / (k - 1) * 100 + 0.5) / 100 end as start, job * 10 + i as query_id, (job * 7 + i * 3) % (select count(*) from embeddings) as vec_id from qk, unnest(generate_series(0, k - 1)) t(i)),
wq as (select pl.query_id, (pos - floor(start))::int as pos, h from pl join q on q.query_id = job where pos >= floor(start) and pos < floor(start) + {SPAN}), {S._near(None, "slow", "wq")},
dur as (select query_id, count(*)::double as duration from wq group by 1),
fpb as (select * from slow qualify row_number() over (partition by query_id order by score desc, doc_id) = 1), {A.SQL_SEG},
vp as (select p.query_id, b.recording_id, max(round(list_dot_product(a.v, b.v), 6)) as score from pl p join seg a on a.vec_id = p.vec_id join seg b on a.recording_id <> b.recording_id or (job + window_idx) % 3 = 0 group by all),
vb as (select query_id, recording_id as mert_id, score as mert_score from vp qualify row_number() over (partition by query_id order by score desc, recording_id) = 1),
{S._ROT.format(which="vec_id in (select vec_id from pl)").removeprefix("with ").replace("best as (", "cbest as (").replace("from best)", "from cbest)").replace("desc_ as (select", "desc0 as (select").replace("from d0),", S._MOVED)},
jn as (select pl.job, window_idx, doc_id as fp_id, coalesce(f.score, 0) as fp_score, {S._floor_sql("duration")} as threshold, mert_id, mert_score, cv.vec_id as cover_id, cv.score as cover_score
    from pl join dur using (query_id) left join fpb f using (query_id) left join vb using (query_id) left join (select * from top where "rank" = 1) cv on cv.query_id = pl.vec_id),
kk as (select *, case when fp_score >= threshold then 3 when mert_score >= {DEFAULT.embedding} then 1 when round(cover_score, 4) >= {DEFAULT.cover} then 2 else 0 end as k from jn),
ww as (select job, window_idx, k, case k when 3 then fp_id when 1 then mert_id when 2 then cover_id end as matched_id, case k when 3 then fp_score when 1 then mert_score when 2 then cover_score else coalesce(mert_score, 0) end as score,
    case k when 3 then 'FINGERPRINT' when 1 then 'EMBEDDING' when 2 then 'COVER' else 'NONE' end as stage, min(case when k = 3 then window_idx end) over (partition by job) as stop from kk),
v2 as (select * from ww where stop is null or window_idx <= stop),
ct as (select job, count(*) as windows_scanned, count(*) filter (where k <> 3) as vec_windows, count(*) filter (where k not in (1, 3)) as cover_windows, bool_or(k = 3) as stopped_early, string_agg(window_idx || ':' || stage, ',' order by window_idx) as windows from v2 group by job),
b as (select job, window_idx, stage, score, case k when 3 then 'EXACT_MATCH' when 2 then 'COVER_MATCH' when 1 then 'NEAR_MATCH' else 'UNKNOWN' end as kind, case when k > 0 then matched_id % (select count(*) from part) + 1 end as rid
    from v2 qualify row_number() over (partition by job order by k > 0 desc, score desc, k desc, window_idx) = 1),
j as (select b.*, f.* exclude (recording_id, match_type, ic, has, rc, ptype), kind as match_type, score as ic, coalesce(f.has, false) as has, case when coalesce(f.has, false) then f.rc else 0 end as rc, coalesce(f.ptype, 'UNKNOWN') as ptype, part.p_name as title
    from b left join f1 f on f.recording_id = b.rid left join part on p_partkey = b.rid),
f2 as ({_with_predicted_sql("j", "job, window_idx, stage, score, rid, title")}), dec as ({RI._decide_sql("f2", "com", "mon")}), {RI._OUT}
select job, window_idx, vec_windows, cover_windows, rid as recording_id, title as track, match_type as type, round(score, 4) as confidence, stage as pipeline_stage, license_type as license, has as rights_found, risk, condition, rc as rights_confidence,
    {RI._RECS} as recommendation, windows_scanned, stopped_early, windows from result join ct using (job)""",
    "hint_candidate": "select l_orderkey, arg_min(l_partkey, (l_linenumber, l_partkey, l_discount)) as hint, round(arg_min(l_discount * 10, (l_linenumber, l_partkey, l_discount)), 4) as hint_score from lineitem group by 1",
    "candidate_labels": "select l_orderkey as query_id, l_linenumber as rank, l_partkey as recording_id, p_name as track, p_brand as artist from lineitem left join part on p_partkey = l_partkey and p_partkey % 3 <> 0",
    "recognize_describe": f"""{S._BASE}, {S._near(None, "slow")}, best as (select * from slow qualify row_number() over (partition by query_id order by score desc, doc_id) = 1), {A.SQL_REC}, {RI._SIM}
select query_id, doc_id as recording_id, score, p_name as title, p_brand as artist, lower(p_type) as composition_title, license_type, copyright_status from best join part on p_partkey = doc_id left join rights on rights.recording_id = doc_id""",
    "registry_match": f"with {_MATCH} select * from mt",
    "registry_match_upsert": f"""with {_MATCH}, s as (select event_id, user_id, ts from events), u as (select user_id as unknown_id, ts from s where event_id % 2 = 0 union all
select coalesce(mt.unknown_id, event_id), ts from s left join mt on query_id = event_id where event_id % 2 = 1) select unknown_id, min(ts) as first_seen_at, max(ts) as last_seen_at, count(*) as sighting_count from u group by 1""",
    "registry_features_recent": "with e as (select user_id, max(ts) as t from events where user_id % 4 <> 0 group by 1 order by t desc, user_id limit 20) select vec_id % 90 as unknown_id, vec_id from embeddings where vec_id % 2 = 1 and vec_id % 90 in (select user_id from e)",
    "noise_probes": f"with {_NOISE} select * from nz",
    "cover_noise_sweep": f"{_NSWEEP} select * from nsweep",
    "cover_threshold_pick": f"""{_NSWEEP}, t as (select (select tau from nsweep where false_match_rate <= 0.005 and noise_match_rate = 0 order by f1 desc, tau limit 1) as a, (select tau from nsweep where false_match_rate <= 0.05 and noise_match_rate = 0 order by f1 desc, tau limit 1) as b,
(select tau from nsweep order by f1 desc, tau desc limit 1) as c) select coalesce(a, b, c) as tau, coalesce(a, b) is not null as safe from t""",
    "cover_grid_pick": S.ORACLE["cover_rule_grid"].replace("select fold, absolute", ", grid as (select fold, absolute", 1) + """), g2 as (select low, delta, sum(accepted) as a, sum(correct) as c, sum(n) as n from grid where absolute = 2 group by all),
g3 as (select low, delta, round(case when a > 0 then c / a::double else 0 end, 4) as "precision", round(c / n::double, 4) as recall from g2 where round((a - c) / n::double, 4) <= 0.9)
select low, delta, "precision", recall from g3 order by recall desc, "precision" desc, delta desc, low desc limit 1""",
    "query_axis": """with x as (select l_orderkey, l_linenumber, case when l_linenumber <= 2 then 30::double else l_quantity end as crop_start,
case when l_linenumber > 4 then 1.05::double else case l_partkey % 4 when 0 then 0.9::double when 1 then 1.1::double else 1 end end as factor, case when l_linenumber >= 6 then -3 when l_partkey % 4 = 2 then 1 else 0 end::int as steps from lineitem)
select *, round(crop_start + 7 * factor, 4) as source_time from x""",
    "augment_targets": f"with {A.SQL_REC}, {RI._SIM} select recording_id, 'audio/' || recording_id as audio_path from rec where recording_id % 4 > 1 and recording_id in (select recording_id from rights where license_type = 'CC_BY' and recording_id is not null)",
    "augment_sample": "select p_partkey as recording_id from part order by sha256('7:' || p_partkey), p_partkey limit 25",
    "tempo_histogram": "select l_returnflag as transformation, round(0.9 + l_partkey % 5 * 0.05::double, 2) as factor, count(*) as n from lineitem where l_discount > 0.04 group by all",
    "same_protocol": """with a(name, value) as (values ('window_s', '15.0'), ('overlap_min', '0.5'), ('hop_s', '5.0')), b as (select 'window_s' as name, '15.0' as actual union all select 'extra', '1' union all select 'hop_s', count(*)::double::varchar from region)
select name, value as expected, actual from a left join b using (name) where value is distinct from actual""",
    "fingerprint_uniqueness": "select count(*) as n, round(count(distinct text) / count(*)::double, 6) as ratio from documents",
    "end_to_end": f"""{RI._HEADG}, {RI._FACT}, dec as ({RI._decide_sql("facts", "com", "mon")}), {RI._OUT}, said as (select recording_id, match_type, risk from result),
fs as (select * replace ('EXACT_MATCH' as match_type, 1::double as ic) from facts), dec2 as ({RI._decide_sql("fs", "com", "mon")}), {RI._OUT.replace("from dec)", "from dec2)").replace("out_", "out2").replace("fin as", "fin2 as").replace("from fin)", "from fin2)").replace("result as", "result2 as")},
r as (select recording_id, said.match_type, said.risk, recording_id % 3 = 0 as held_out, {A.sql_bucket("recording_id", "hit", 10)} < 8 as right_, case when recording_id % 3 = 0 then 'UNKNOWN' else w.risk end as truth from said join result2 w using (recording_id))
select held_out, count(*) as n, round(avg(case when risk = truth then 1::double else 0 end), 6) as accuracy, count(*) filter (where match_type = 'UNKNOWN') as unknown, count(*) filter (where not held_out and not right_) as failures,
round(count(*) filter (where not held_out and not right_ and risk = truth) / greatest(count(*) filter (where not held_out and not right_), 1)::double, 4) as right_by_luck from r group by 1""",
    "insert_absent_jobs": "select distinct o_orderkey % 700 as job_id from orders where o_orderkey % 700 not in (select o_orderkey % 500 from orders where o_orderkey % 2 = 0)",
    "service_state": "select case when p_size > 5 and p_partkey % 7 <> 0 and p_partkey % 5 <> 0 then 'OK' else 'DEGRADED' end as state, count(*) as n from part group by 1",
    "duration_window": "with x as (select l_linenumber, l_quantity as q, case when l_linenumber > 2 then l_tax * 500 end as r from lineitem) select l_linenumber, count(*) as n from x where coalesce(q, 0) = 0 or coalesce(r, 0) = 0 or abs(q - r) <= 8 group by 1",
    "class_floor": "select p_type, count(*) as n from part group by 1 having count(*) >= 3",
    "tempo_spans": """with s as (select p_partkey as query_id, f as factor, 30 / f as seconds, least(p_size + 10.0::double, floor(30 / f + 0.5)) as actual from part, (select unnest([0.9::double, 0.95::double, 1::double, 1.05::double, 1.1::double]) as f)),
b as (select query_id, actual, arg_min(factor, abs(seconds - actual)) as factor, min(abs(seconds - actual)) as off from s group by all) select query_id, actual, case when off <= 0.5 then factor end as factor from b""",
    "index_segments": """with x as (select o_orderkey, floor(o_totalprice / 4000 * 100 + 0.5) / 100 as duration from orders)
select o_orderkey, 0 as idx, 0::double as start, round(duration, 2) as "end" from x where duration > 1 and duration < 15 union all
select o_orderkey, i::int, i * 10::double, i * 10::double + 15 from x, unnest(generate_series(0, floor((duration - 15) / 10)::int)) t(i) where duration >= 15""",
    "production_features": f"""with e as (select vec_id as id, embedding::double[] as v from embeddings), fr as (select id, (i - 1) // 3 as k, sqrt(avg(v[i] * v[i])) as rms from e, unnest(generate_series(1, 63)) t(i) group by all),
d as (select id, {_DB.format(x="rms")} as db from fr), l as (select id, db, max(db) over (partition by id) as top from d), s as (select id, quantile_cont(db, 0.95) - quantile_cont(db, 0.10) as spread from l where db > top - 40 group by 1),
p as (select id, {_DB.format(x="list_max(list_transform(v, lambda x: abs(x)))")} as peak, {_DB.format(x="sqrt(list_avg(list_transform(v, lambda x: x * x)))")} as rms, list_avg(list_transform(v, lambda x: (abs(x) >= 0.999)::int)) as clip from e),
o as (select id, id % 9 = 0 as short, round(peak, 2) as peak, round(rms, 2) as rms, round(peak - rms, 2) as crest, round(spread, 2) as spread, round(clip, 6) as clip from p join s using (id)),
q as (select *, (greatest(0, least(1, (rms + 10 + 26) / 12)) + greatest(0, least(1, (20 - crest) / 12)) + greatest(0, least(1, (18 - spread) / 14))) / 3 as score from o)
select id, case when not short then peak end as peak_dbfs, case when not short then rms end as rms_dbfs, case when not short then crest end as crest_factor_db, case when not short then spread end as dynamic_range_db,
case when not short then clip end as clipping_ratio, case when not short then 1.0::double end as duration_s, case when not short then round(score, 3) end as polish,
case when short then null when score >= 0.66 then '{audio_features.LABELS[0][1]}' when score >= 0.4 then '{audio_features.LABELS[1][1]}' else '{audio_features.LABELS[2][1]}' end as label from q""",
    "iso_times": "select o_orderkey, strftime(o_orderdate, '%Y-%m-%dT%H:%M:%S') as iso from orders",
}
