"""Queries of the similarity tiers."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..config import DEFAULT, NOISE_FLOOR, NOISE_MARGIN
from ..operators import cascade, etl, evaluation, fingerprint, meetings, postings, vectors
from ..sources import adapters as A
from ..sources import store

TOP = DEFAULT.prefilter_top


def _q(spark: SparkSession, d: str) -> DataFrame:
    return A.query_items(spark, d)


def _durations(q: DataFrame, per_second: float) -> DataFrame:
    return q.groupBy("query_id").agg((F.count("*") / per_second).alias("duration"))


def fp_prefilter_topk(spark, d):
    return postings.candidates(_q(spark, d), A.index_of(spark, d), TOP)


def fp_alignment_score(spark, d):
    q, index = _q(spark, d), A.index_of(spark, d)
    return postings.candidate_scores(q, index, postings.candidates(q, index, TOP).select("query_id", "doc_id"))


def fp_search_verdict(spark, d):
    q = _q(spark, d)
    return postings.search(q, A.index_of(spark, d), _durations(q, 1.0))


def fp_search_full_scan(spark, d):
    q = _q(spark, d)
    return fingerprint.verdicts(postings.alignment(q, A.index_of(spark, d)), _durations(q, 1.0))


def fp_search_short_query(spark, d):
    q = _q(spark, d)
    return postings.search(q, A.index_of(spark, d), _durations(q, 7.5))


def fp_search_touched(spark, d):
    """What the search of each query reads of its lists, with a budget of 40 postings."""
    return postings.touched(_q(spark, d), A.index_of(spark, d), 5, 40)


def fp_search_excluded(spark, d):
    """Search where a query may not find the document of its own best hits: held-out protocol in both searches."""
    q, index = _q(spark, d), A.index_of(spark, d)
    own = postings.candidates(q, index, 1).select("query_id", "doc_id")
    return postings.search(q, index, _durations(q, 1.0), excluded=own)


def fp_duplicate_classes(spark, d):
    docs = A.table(spark, d, "documents")
    return docs.groupBy(F.md5("text").alias("fp")).agg(F.count("*").alias("n"), F.min("doc_id").alias("first_id")).filter("n > 1")


def fp_change_signature(spark, d):
    return fingerprint.change_signature(A.table(spark, d, "documents"), "doc_id")


def heldout_exclusions(spark, d):
    """What is held out for each source: a stated set of documents, scored against all of them. Equal texts are scored once."""
    docs = A.table(spark, d, "documents").withColumn("cls", F.md5("text"))
    sources = docs.filter(F.col("doc_id") % 25 == 0).select("doc_id", "cls")
    texts = store.cut(docs.groupBy("cls").agg(F.min("doc_id").alias("doc_id"), F.bool_or(F.col("doc_id") % 25 == 0).alias("asked")))
    one = docs.join(texts, ["cls", "doc_id"]).select("doc_id", "asked", "text")
    near = meetings.close(A.short_sequences(one, "doc_id", "asked"), 0.1).filter("query_id <> doc_id")
    named = sources.join(texts.select("cls", F.col("doc_id").alias("query_id")), "cls").select(F.col("doc_id").alias("id"), "query_id")
    return evaluation.held_out(
        docs.select(F.col("doc_id").alias("id"), "cls"),
        named.join(near, "query_id").select("id", F.col("doc_id").alias("other"), "score"), etl.cyclic_partner(sources, "doc_id"),
    )


# --- vectors


def vec_topk_recordings(spark, d):
    s = A.segments(spark, d)
    return vectors.retrieve(s.filter(F.col("vec_id") % 25 == 0), s).select("query_id", "recording_id", "score", "seg_start", "hits", "rank")


def vec_exclude_equiv(spark, d):
    s = A.segments(spark, d)
    return vectors.retrieve(s.filter(F.col("vec_id") % 25 == 0), s, exclude_own=True).select("query_id", "recording_id", "score", "hits", "rank")


def vec_leave_one_out_recall(spark, d):
    return vectors.recall_table(vectors.leave_one_out_ranks(A.segments(spark, d)))


def vec_map_segment(spark, d):
    return vectors.average_precision(A.segments(spark, d), "label")


def vec_pair_distribution(spark, d):
    return vectors.pair_summary(vectors.pair_distribution(A.segments(spark, d), "label"))


def _loo(spark, d):
    """Best score of each vector within its own label and within any other."""
    return vectors.own_and_other(A.segments(spark, d), "label")


def vec_unknown_sweep(spark, d):
    rows = _loo(spark, d)
    long = rows.select(F.col("own").alias("score"), F.lit(1).alias("truth")).union(rows.select("other", F.lit(0)))
    return evaluation.sweep(long, evaluation.grid(spark, 0.0, 0.5, 20))


def vec_target_pick(spark, d):
    sweeps = vec_unknown_sweep(spark, d)
    return evaluation.target_pick(sweeps, 0.05).select("tau")


def recording_mean_vectors(spark, d):
    m = vectors.mean_vectors(A.segments(spark, d), "recording_id")
    return m.select("recording_id", F.posexplode("v").alias("i", "x")).select("recording_id", "i", F.round("x", 5).alias("x"))


#: 64 components and eight zeros make twelve rows of six.
PITCHES, FRAMES = 12, 6


def _descriptors(spark, d):
    v = F.concat(F.transform("embedding", lambda x: x.cast("double")), F.array_repeat(F.lit(0.0), PITCHES * FRAMES - 64))
    return A.table(spark, d, "embeddings").select("vec_id", vectors.normalised(v).alias("v"))


def _moved(x: DataFrame) -> DataFrame:
    """A fourth of the descriptors once more under ids of their own, moved up by three semitones."""
    beyond = x.agg((F.max("vec_id") + 1).alias("beyond"))
    return x.filter("vec_id % 4 = 1").crossJoin(beyond).select((F.col("vec_id") + F.col("beyond")).alias("vec_id"), vectors.rotated(F.col("v"), 3, PITCHES, FRAMES).alias("v"))


def cover_identify(spark, d):
    """Covers over tempo spans and rotations. A span of some seconds is described by as many 33rds of the components; queries last
    24 to 34 seconds, may not find themselves, and every second one may not find the two ids after it either."""
    e = A.table(spark, d, "embeddings").select("vec_id", "embedding")

    def described(span):
        n = F.floor(span * 64 / 33).cast("int")
        return vectors.normalised(F.transform(F.sequence(F.lit(0), F.lit(PITCHES * FRAMES - 1)), lambda i: F.when(i < n, F.get("embedding", i).cast("double")).otherwise(0.0)))

    asked = e.filter("vec_id % 25 = 0").select(F.col("vec_id").alias("query_id"), (24.0 + F.col("vec_id") % 11).alias("length"))
    excluded = F.when(F.col("vec_id") % 50 == 0, F.array(*[F.col("vec_id") + i for i in range(3)])).otherwise(F.array("vec_id"))
    rows = vectors.tempo_rows(asked).join(e, F.col("query_id") == F.col("vec_id")).select("vec_id", "row", "tempo_factor", described(F.col("span")).alias("v"), excluded.alias("excluded"))
    refs = e.select("vec_id", described(F.lit(30)).alias("v"))
    return vectors.identify_covers(rows, refs.union(_moved(refs)), PITCHES, FRAMES)


def _cover(spark, d, k=5):
    x = _descriptors(spark, d)
    return vectors.rotation_search(x.filter(F.col("vec_id") % 25 == 0), x, PITCHES, FRAMES, k)


def cover_rotation_best(spark, d):
    return _cover(spark, d).select("query_id", "vec_id", "oti", "score", "rank", vectors.semitones(F.col("oti")).alias("shift"))


def _top_two(spark, d):
    two = _cover(spark, d, 2)
    return two.groupBy("query_id").agg(
        F.max(F.when(F.col("rank") == 1, F.col("score"))).alias("s1"), F.max(F.when(F.col("rank") == 2, F.col("score"))).alias("s2"),
        F.max(F.when(F.col("rank") == 1, F.col("vec_id"))).alias("best"),
    )


def cover_margin_top2(spark, d):
    t = _top_two(spark, d)
    return t.select("query_id", "s1", "s2", F.round(F.col("s1") - F.col("s2"), 6).alias("margin"), vectors.accepted_by_margin(F.col("s1"), F.col("s2"), 0.55, 0.45, 0.02).alias("accepted"))


#: Thresholds of the margin rules; none accepts by s1 alone from 2.0 on.
ABSOLUTE, LOW, DELTA = (0.50, 0.55, 0.60, 2.0), tuple(round(0.30 + 0.02 * i, 2) for i in range(7)), tuple(round(0.005 * j, 3) for j in range(21))


def _margin_records(spark, d):
    """(fold, s1, margin, ok) of each query; ok: the best match has its label. Folds alternate by query."""
    label = A.table(spark, d, "embeddings").select("vec_id", "label")
    rows = _top_two(spark, d).join(label.select(F.col("vec_id").alias("query_id"), F.col("label").alias("lq")), "query_id").join(
        label.select(F.col("vec_id").alias("best"), F.col("label").alias("lb")), "best"
    )
    fold = F.pmod(F.floor(F.col("query_id") / 25), F.lit(2)).cast("int")
    return rows.select(fold.alias("fold"), "s1", F.round(F.col("s1") - F.col("s2"), 6).alias("margin"), (F.col("lq") == F.col("lb")).alias("ok"))


def cover_rule_grid(spark, d):
    """Every rule of the grid, and the one that accepts from the threshold on only."""
    rows = _margin_records(spark, d)
    counts = evaluation.rule_counts(rows, ABSOLUTE, LOW, DELTA, ("fold",))
    return counts.unionByName(evaluation.rule_counts(rows, (0.55,), (1.01,), (0.0,), ("fold",)))


def cover_rule_folds(spark, d):
    """The margin rule chosen on one fold, scored on the other; accepted wrong matches are false ones, at most half of all."""
    counts = evaluation.rule_counts(_margin_records(spark, d), ABSOLUTE, LOW, DELTA, ("fold",))
    return evaluation.two_fold(counts.withColumn("false_accepted", F.col("accepted") - F.col("correct")), 0.5)


def cover_margin_stats(spark, d):
    t = _top_two(spark, d).select((F.col("s1") - F.col("s2")).alias("m"))
    p = lambda q: F.round(F.percentile("m", q), 5)
    return t.agg(*[p(q / 100).alias(f"p{q:02d}") for q in (5, 25, 50, 75, 95)])


def cascade_verdict(spark, d):
    """All tiers at their thresholds. Even queries may find their own recording; a fourth of the references
    stand a second time, moved up by three semitones; what is left matches nothing."""
    q = _q(spark, d)
    fp = postings.search(q, A.index_of(spark, d), _durations(q, 1.0)).select("query_id", F.when(F.col("score") > 0, F.col("doc_id")).alias("fp_id"), F.col("score").alias("fp_score"), F.col("threshold").alias("fp_limit"))
    s = A.segments(spark, d)
    ids = q.select("query_id").distinct()
    asked = s.join(ids, s["vec_id"] == ids["query_id"], "left_semi")
    vec = vectors.retrieve(asked.filter("vec_id % 2 = 0"), s, k=1).union(vectors.retrieve(asked.filter("vec_id % 2 = 1"), s, k=1, exclude_own=True))
    x = _descriptors(spark, d)
    moved = _moved(x)
    cov = vectors.rotation_search(x.join(ids, x["vec_id"] == ids["query_id"], "left_semi"), x.union(moved), PITCHES, FRAMES, 1)
    rows = (
        fp.join(vec.select("query_id", F.col("recording_id").alias("mert_id"), F.col("score").alias("mert_score")), "query_id", "left")
        .join(cov.select("query_id", F.col("vec_id").alias("cover_id"), F.col("score").alias("cover_score")), "query_id", "left")
    )
    return cascade.decide(rows)


# --- SQL

_HITS = """
qa as (select query_id, h, count(*) as n from q group by all), ra as (select doc_id, h, count(*) as m from r group by all),
hits as (select query_id, doc_id, sum(n * m)::bigint as hits from qa join ra using (h) group by all),
mine_ as (select query_id, doc_id from hits qualify row_number() over (partition by query_id order by hits desc, doc_id) = 1),
cand as (select *, row_number() over (partition by query_id order by hits desc, doc_id)::int as "rank" from hits {where} qualify "rank" <= {top})"""


def _near(pairs: str | None, name: str, q: str = "q", also: str = "") -> str:
    limit = f"join {pairs} p on p.query_id = a.query_id and p.doc_id = b.doc_id" if pairs else ""
    cut = ["h & 2047", "(h >> 11) & 2047", "(h >> 22) & 1023"]
    sides = " union all ".join(f"select {{id}}, pos, h, {i} as c, {x} as x from {{t}}" for i, x in enumerate(cut))
    return f"""
{name}_q as ({sides.format(id="query_id", t=q)}), {name}_r as ({sides.format(id="doc_id", t="r")}),
{name}_m as (select distinct a.query_id, b.doc_id, a.pos as i, b.pos as j from {name}_q a join {name}_r b on a.c = b.c and a.x = b.x {limit} where bit_count(xor(a.h, b.h)) <= 2 {also}),
{name}_o as (select query_id, doc_id, i - j as off, count(*) as n from {name}_m group by all),
{name}_b as (select query_id, doc_id, max(n) as best from {name}_o group by all),
{name} as (select query_id, doc_id, round(best::double / least(nq, nr), 6) as score from {name}_b
    join (select query_id, count(*) as nq from {q} group by all) using (query_id) join (select doc_id, count(*) as nr from r group by all) using (doc_id))"""


def _floor_sql(x: str) -> str:
    parts = [f"when {x} <= 0 then {DEFAULT.fingerprint}::double", f"when {x} <= 5 then greatest({DEFAULT.fingerprint}::double, {NOISE_FLOOR[0][1]}::double * {NOISE_MARGIN}::double)"]
    for (x0, y0), (x1, y1) in zip(NOISE_FLOOR, NOISE_FLOOR[1:]):
        parts.append(f"when {x} < {x1} then greatest({DEFAULT.fingerprint}::double, ({y0}::double + ({x} - {x0}::double) * {(y1 - y0) / (x1 - x0)!r}::double) * {NOISE_MARGIN}::double)")
    return "round(case " + " ".join(parts) + f" else greatest({DEFAULT.fingerprint}::double, {NOISE_FLOOR[-1][1]}::double * {NOISE_MARGIN}::double) end, 6)"


def _verdict_sql(scores: str, per_second: float) -> str:
    return f"""
dur as (select query_id, count(*) / {per_second}::double as duration from q group by query_id),
best as (select query_id, doc_id, score from {scores} qualify row_number() over (partition by query_id order by score desc, doc_id) = 1),
verdict as (select query_id, doc_id, coalesce(score, 0::double) as score, {_floor_sql("duration")} as threshold,
    case when score >= {_floor_sql("duration")} then 'EXACT_MATCH' else 'UNKNOWN' end as match_type from dur left join best using (query_id))"""


_BASE = f"with {A.SQL_Q}, {A.SQL_R}"
_CAND = _HITS.format(top=TOP, where="")


def _search_sql(per_second: float, where: str = "", also: str = "") -> str:
    return f"""{_BASE}, {_HITS.format(top=TOP, where=where)}, {_near("cand", "fast")},
dd as (select query_id, count(*) / {per_second}::double as duration from q group by query_id),
close as (select query_id from dd left join (select query_id, max(score) as best from fast group by query_id) using (query_id)
    where duration < {DEFAULT.prefilter_min_seconds} or abs(coalesce(best, 0) - {_floor_sql("duration")}) <= {DEFAULT.prefilter_band}),
q2 as (select * from q where query_id in (select query_id from close)), {_near(None, "slow", "q2", also)},
scored as (select * from fast where query_id not in (select query_id from close) union all select * from slow),{_verdict_sql("scored", per_second)}"""


_PAIRS = f"with {A.SQL_SEG}, pair as (select a.vec_id as query_id, a.recording_id as qr, a.label as ql, b.vec_id, b.recording_id, b.seg_start, b.label, round(list_dot_product(a.v, b.v), 6) as score from seg a join seg b on true)"
_QP = _PAIRS.replace("on true", "on a.vec_id % 25 = 0")
_RETR = """, probe as (select *, row_number() over (partition by query_id order by score desc, vec_id) as r from pair {where}),
grp as (select query_id, recording_id, max(score) as score, arg_min(seg_start, r) as seg_start, count(*) as hits from probe where r <= least({n}, 100) group by all)
select query_id, recording_id, score, {seg} hits, row_number() over (partition by query_id order by score desc, recording_id)::int as "rank" from grp qualify "rank" <= 5"""
_LOO = _PAIRS + ", gm as (select query_id, any_value({own}) as own_group, {grp} as grp, max(score) as best from pair where query_id <> vec_id group by query_id, {grp})"
_SWEEP = """
taus as (select round({lo} + i * {step}::double, 4) as tau from (select unnest(generate_series(0, {n})) as i)),
agg as (select tau, count(*) filter (where score >= tau and truth = 1) as tp, count(*) filter (where score >= tau and truth = 0) as fp,
    count(*) filter (where truth = 1) as pos, count(*) filter (where truth = 0) as neg from taus, scored where score is not null and truth is not null group by tau),
pr as (select *, case when tp + fp > 0 then tp / (tp + fp)::double else 0 end as p, case when pos > 0 then tp / pos::double else 0 end as r from agg),
sweep as (select tau, tp, fp, round(p, 6) as "precision", round(r, 6) as recall, round(case when p + r > 0 then 2 * p * r / (p + r) else 0 end, 6) as f1,
    round(case when neg > 0 then fp / neg::double else 0 end, 6) as fpr from pr)"""
_UNK = _LOO.format(own="ql", grp="label") + ", o as (select query_id, max(case when grp = own_group then best end) as own, max(case when grp <> own_group then best end) as other from gm group by query_id), scored as (select own as score, 1 as truth from o union all select other, 0 from o)," + _SWEEP.format(lo="0.0::double", step="0.025", n=20)
_ROT = f"""with d0 as (select vec_id, list_concat([x::double for x in embedding], list_transform(generate_series(1, {PITCHES * FRAMES - 64}), lambda i: 0::double)) as v from embeddings),
desc_ as (select vec_id, list_transform(v, lambda x: x / sqrt(list_sum(list_transform(v, lambda y: y * y)))) as v from d0),
rot as (select vec_id as query_id, k as oti, list_transform(generate_series(0, {PITCHES * FRAMES - 1}), lambda i: v[((((i // {FRAMES}) - k + {PITCHES}) % {PITCHES}) * {FRAMES} + i % {FRAMES} + 1)::int]) as v
    from desc_ join (select unnest(generate_series(0, {PITCHES - 1})) as k) on {{which}}),
pr as (select query_id, oti, d.vec_id, round(list_dot_product(rot.v, d.v), 6) as score from rot join desc_ d on d.vec_id <> query_id),
best as (select query_id, vec_id, max(score) as score, arg_min(oti, (-score, oti)) as oti from pr group by all),
top as (select *, row_number() over (partition by query_id order by score desc, vec_id)::int as "rank" from best)"""
_COVER = _ROT.format(which="vec_id % 25 = 0")
_MOVED = f"""from d0), desc_ as (select * from desc0 union all
    select vec_id + (select max(vec_id) + 1 from desc0), list_transform(generate_series(0, {PITCHES * FRAMES - 1}), lambda i: v[((((i // {FRAMES}) - 3 + {PITCHES}) % {PITCHES}) * {FRAMES} + i % {FRAMES} + 1)::int]) from desc0 where vec_id % 4 = 1),"""
_SHIFT = "(case when (12 - oti) % 12 > 6 then (12 - oti) % 12 - 12 else (12 - oti) % 12 end)"
_TWO = _COVER + ', two as (select query_id, max(case when "rank" = 1 then score end) as s1, max(case when "rank" = 2 then score end) as s2, max(case when "rank" = 1 then vec_id end) as best from top where "rank" <= 2 group by query_id)'

_RULES = """, rec as (select s1, s2, a.label = b.label as ok, ((query_id // 25) % 2)::int as fold from two join embeddings a on a.vec_id = query_id join embeddings b on b.vec_id = best),
rules as (select a as absolute, round(0.30 + 0.02 * i, 2)::double as low, round(0.005 * j, 3)::double as delta from (select unnest([0.5::double, 0.55::double, 0.6::double, 2.0::double]) as a), (select unnest(generate_series(0, 6)) as i), (select unnest(generate_series(0, 20)) as j)
    union all select 0.55::double, 1.01::double, 0::double), hits as (select *, s1 >= absolute or (s1 >= low and round(s1 - s2, 6) >= delta) as hit from rec, rules) """

QUERIES = {f.__name__: f for f in (
    fp_prefilter_topk, fp_alignment_score, fp_search_verdict, fp_search_full_scan, fp_search_short_query, fp_search_touched, fp_search_excluded, fp_duplicate_classes, fp_change_signature,
    heldout_exclusions, vec_topk_recordings, vec_exclude_equiv, vec_leave_one_out_recall, vec_map_segment, vec_pair_distribution, vec_unknown_sweep,
    vec_target_pick, recording_mean_vectors, cover_rotation_best, cover_margin_top2, cover_rule_grid, cover_rule_folds, cover_margin_stats, cover_identify, cascade_verdict,
)}
ORACLE = {
    "fp_prefilter_topk": f'{_BASE}, {_CAND} select query_id, doc_id, hits, "rank" from cand',
    "fp_alignment_score": f"{_BASE}, {_CAND}, {_near('cand', 'fast')} select * from fast",
    "fp_search_verdict": _search_sql(1.0) + " select * from verdict",
    "fp_search_full_scan": f"{_BASE}, {_near(None, 'slow')},{_verdict_sql('slow', 1.0)} select * from verdict",
    "fp_search_short_query": _search_sql(7.5) + " select * from verdict",
    "fp_search_touched": f"""{_BASE}, qa as (select query_id, h, count(*) as n from q group by all), ra as (select doc_id, h, count(*) as m from r group by all),
l as (select h, count(*) as len, max(m) as most from ra group by h), p as (select query_id, h, n, len, n * most as gain, coalesce(sum(len) over (partition by query_id order by len, h rows between unbounded preceding and 1 preceding), 0) as before from qa join l using (h)),
e as (select *, before = 0 or before + len <= 40 as early from p), hits as (select query_id, doc_id, sum(n * m) as hits from e join ra using (h) where early group by all),
bar as (select query_id, hits as bar from hits qualify row_number() over (partition by query_id order by hits desc) = 5),
s as (select query_id, count(*) as lists, sum(len)::bigint as postings, sum(case when early then len else 0 end)::bigint as first, sum(case when early then 0 else gain end) as rest from e group by query_id)
select query_id, lists, postings, case when rest = 0 or coalesce(bar > rest, false) then first else postings end as read, rest = 0 or coalesce(bar > rest, false) as ended from s left join bar using (query_id)""",
    "fp_search_excluded": _search_sql(1.0, "where not exists (select 1 from mine_ m where m.query_id = hits.query_id and m.doc_id = hits.doc_id)", "and not exists (select 1 from mine_ m where m.query_id = a.query_id and m.doc_id = b.doc_id)") + " select * from verdict",
    "fp_duplicate_classes": "select md5(text) as fp, count(*) as n, min(doc_id) as first_id from documents group by 1 having count(*) > 1",
    "fp_change_signature": "select count(*) as n, min(doc_id) as first_id, max(doc_id) as last_id from documents",
    "heldout_exclusions": f"""with {A.SQL_R}, src as (select doc_id as id from documents where doc_id % 25 = 0),
q as (select doc_id as query_id, pos, h from r where doc_id % 25 = 0), {_near(None, "fast")},
held as (select id as a, text from src join documents on doc_id = id union select query_id, d.text from fast join documents d using (doc_id) where query_id <> doc_id and score >= 0.1),
partner as (select id, coalesce(lead(id) over (order by id), first_value(id) over (order by id)) as other from src),
whole as (select a, text from held union select p.id, o.text from partner p join held o on o.a = p.other)
select a as source, doc_id as excluded from whole join documents using (text)""",
    "vec_topk_recordings": _QP + _RETR.format(where="", n="(select count(*) from seg)", seg="seg_start,"),
    "vec_exclude_equiv": _QP + _RETR.format(where="where qr <> recording_id", n="(select count(*) - 2 from seg)", seg=""),
    "vec_leave_one_out_recall": _LOO.format(own="qr", grp="recording_id") + """,
mine as (select query_id, best as mine from gm where grp = own_group), rk as (select g.query_id, 1 + count(*) filter (where grp <> own_group and best > mine) as r from gm g join mine using (query_id) group by g.query_id)
select count(*) as n, round(avg(case when r <= 1 then 1.0::double else 0 end), 6) as recall_1, round(avg(case when r <= 5 then 1.0::double else 0 end), 6) as recall_5, round(avg(case when r <= 10 then 1.0::double else 0 end), 6) as recall_10, round(avg(1 / r::double), 6) as mrr from rk""",
    "vec_map_segment": _PAIRS + """, o as (select *, rank() over (partition by query_id order by score desc) as pos from pair where query_id <> vec_id),
rel as (select query_id, pos, rank() over (partition by query_id order by pos) as j from o where label = ql), ap as (select query_id, avg(j / pos::double) as ap from rel group by query_id)
select count(*) as n, round(avg(ap), 6) as map from ap""",
    "vec_pair_distribution": _PAIRS + """, p as (select ql = label as same, score, floor((score + 1) / 2 * 2000)::bigint as bin from pair where query_id < vec_id),
h as (select same, bin, count(*) as n from p group by all), c as (select same, bin, sum(n) over (partition by same order by bin) as cum, sum(n) over (partition by same) as total from h),
e as (select same, round(min(case when cum >= 0.5 * total then (bin + 1) * 2 / 2000.0::double - 1 end), 6) as p50, round(min(case when cum >= 0.99 * total then (bin + 1) * 2 / 2000.0::double - 1 end), 6) as p99 from c group by same),
s as (select same, count(*) as n, round(avg(score), 5) as mean, round(stddev_pop(score), 5) as std, max(score) as top from p group by same) select same, n, mean, std, top, p50, p99 from s join e using (same)""",
    "vec_unknown_sweep": _UNK + " select * from sweep",
    "vec_target_pick": _UNK + " select (select tau from sweep where fpr <= 0.05 order by recall desc, tau limit 1) as tau",
    "recording_mean_vectors": f"""with {A.SQL_SEG}, e as (select recording_id, i, avg(v[i]) as x from seg, (select unnest(generate_series(1, 64)) as i) group by all),
n as (select recording_id, sqrt(sum(x * x)) as n from e group by recording_id), u as (select recording_id, i, x / n as x from e join n using (recording_id))
select recording_id, (i - 1)::int as i, round(x, 5) as x from u""",
    "cover_rotation_best": _COVER + f"""select query_id, vec_id, oti::int as oti, score, "rank", case when {_SHIFT} = 0 then 'same key' when {_SHIFT} = 6 then 'tritone'
    when {_SHIFT} > 0 then '+' || {_SHIFT} || ' semitones' else {_SHIFT} || ' semitones' end as shift from top where "rank" <= 5""",
    "cover_margin_top2": _TWO + " select query_id, s1, s2, round(s1 - s2, 6) as margin, s1 >= 0.55 or (s1 >= 0.45 and s1 - s2 >= 0.02) as accepted from two",
    "cover_rule_grid": _TWO + _RULES + "select fold, absolute, low, delta, count(*) filter (where hit) as accepted, count(*) filter (where hit and ok) as correct, count(*) as n from hits group by all",
    "cover_rule_folds": _TWO + _RULES + """, g as (select fold, absolute, low, delta, count(*) filter (where hit) as accepted, count(*) filter (where hit and ok) as correct, count(*) as n from hits where low <> 1.01 group by all),
m as (select *, round(case when accepted > 0 then correct / accepted::double else 0 end, 4) as "precision", round(correct / n::double, 4) as recall, round((accepted - correct) / n::double, 4) as false_rate from g),
c as (select 1 - fold as fold, absolute, low, delta, recall as tuned_recall from m where false_rate <= 0.5 qualify row_number() over (partition by fold order by recall desc, "precision" desc, delta desc, low desc, absolute desc) = 1)
select fold, absolute, low, delta, tuned_recall, accepted, correct, n, "precision", recall, false_rate from c join m using (fold, absolute, low, delta)""",
    "cover_margin_stats": _TWO + ", m as (select s1 - s2 as m from two) select " + ", ".join(f"round(quantile_cont(m, {q / 100}), 5) as p{q:02d}" for q in (5, 25, 50, 75, 95)) + " from m",
    "cover_identify": f"""with e as (select vec_id, embedding::double[] as v from embeddings),
sp as (select vec_id, i as "row", f, 30 / f as seconds, least(24.0::double + vec_id % 11, floor(30 / f + 0.5)) as span from e, (select unnest([0, 1, 2, 3, 4]) as i, unnest([0.9::double, 0.95::double, 1::double, 1.05::double, 1.1::double]) as f) where vec_id % 25 = 0),
st as (select vec_id, span, min("row") as "row", arg_min(f, (abs(seconds - span), "row")) as f, min(abs(seconds - span)) as off from sp group by all),
dr as (select vec_id, "row", case when off <= 0.5 then f end as tempo_factor, list_transform(generate_series(1, {PITCHES * FRAMES}), lambda i: case when i <= floor(span * 64 / 33) then v[i] else 0 end) as v from st join e using (vec_id)),
dn as (select vec_id, "row", tempo_factor, list_transform(v, lambda x: x / sqrt(list_sum(list_transform(v, lambda y: y * y)))) as v from dr),
r0 as (select vec_id, list_transform(generate_series(1, {PITCHES * FRAMES}), lambda i: case when i <= floor(30 * 64 / 33) then v[i] else 0 end) as v from e),
r1 as (select vec_id, list_transform(v, lambda x: x / sqrt(list_sum(list_transform(v, lambda y: y * y)))) as v from r0),
refs as (select * from r1 union all select vec_id + (select max(vec_id) + 1 from r1), list_concat(v[{(PITCHES - 3) * FRAMES + 1}:], v[:{(PITCHES - 3) * FRAMES}]) from r1 where vec_id % 4 = 1),
rot as (select vec_id as query_id, "row", tempo_factor, k as oti, case when k = 0 then v else list_concat(v[({PITCHES} - k) * {FRAMES} + 1:], v[:({PITCHES} - k) * {FRAMES}]) end as v from dn, (select unnest(generate_series(0, {PITCHES - 1})) as k)),
pr as (select query_id, "row", tempo_factor, oti, x.vec_id, round(list_dot_product(rot.v, x.v), 6) as score from rot join refs x on x.vec_id <> query_id and not (query_id % 50 = 0 and x.vec_id in (query_id + 1, query_id + 2))),
best as (select query_id, vec_id as recording_id, max(score) as score, arg_min((oti, tempo_factor), (-score, "row", oti)) as a from pr group by all),
top as (select *, a[1] as oti, row_number() over (partition by query_id order by score desc, recording_id)::int as "rank" from best qualify "rank" <= 5)
select query_id, "rank", recording_id, round(score, 4) as score, oti::int as oti, case when {_SHIFT} = 0 then 'same key' when {_SHIFT} = 6 then 'tritone' when {_SHIFT} > 0 then '+' || {_SHIFT} || ' semitones' else {_SHIFT} || ' semitones' end as shift,
    a[2] as tempo_factor, max(round(score, 4)) over (partition by query_id) >= {DEFAULT.cover} as matched, "rank" = 1 and round(score, 4) >= {DEFAULT.cover} as is_match from top""",
    "cascade_verdict": _search_sql(1.0) + f""", {A.SQL_SEG},
vp as (select a.vec_id as query_id, b.recording_id, max(round(list_dot_product(a.v, b.v), 6)) as score from seg a join seg b on a.recording_id <> b.recording_id or a.vec_id % 2 = 0 where a.vec_id in (select item_id from benchmark) group by all),
vb as (select query_id, recording_id as mert_id, score as mert_score from vp qualify row_number() over (partition by query_id order by score desc, recording_id) = 1),
{_ROT.format(which="vec_id in (select item_id from benchmark)").removeprefix("with ").replace("best as (", "cbest as (").replace("from best)", "from cbest)").replace("desc_ as (select", "desc0 as (select").replace("from d0)," , _MOVED)},
j as (select query_id, case when score > 0 then doc_id end as fp_id, score as fp_score, threshold, mert_id, mert_score, cv.vec_id as cover_id, cv.cs as cover_score
    from verdict left join vb using (query_id) left join (select query_id, vec_id, score as cs from top where "rank" = 1) cv using (query_id)),
k as (select *, case when fp_score >= threshold then 1 when mert_score >= {DEFAULT.embedding} then 2 when round(cover_score, 4) >= {DEFAULT.cover} then 3 else 0 end as t from j)
select query_id, ['UNKNOWN', 'EXACT_MATCH', 'NEAR_MATCH', 'COVER_MATCH'][t + 1] as match_type, case t when 1 then fp_id when 2 then mert_id when 3 then cover_id end as matched_id,
    case t when 1 then fp_score when 2 then mert_score when 3 then cover_score else coalesce(mert_score, 0::double) end as score,
    ['NONE', 'FINGERPRINT', 'EMBEDDING', 'COVER'][t + 1] as stage, ['BELOW_ALL_THRESHOLDS', 'ABOVE_FINGERPRINT_THRESHOLD', 'ABOVE_EMBEDDING_THRESHOLD', 'ABOVE_COVER_THRESHOLD'][t + 1] as reason from k""",
}
