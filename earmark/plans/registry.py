"""Queries of the registry, jobs, admission and ETL."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import text as T
from ..operators import etl, jobs, learning, registry, vectors
from ..sources import adapters as A
from ..sources import store

TODAY = "2024-01-30"


def _sightings(spark, d) -> DataFrame:
    e = A.table(spark, d, "events")
    return e.select(
        F.col("event_id").alias("sighting_id"), F.col("user_id").alias("unknown_id"), F.col("ts").alias("seen_at"), F.col("event_type").alias("platform"),
        F.col("value").alias("match_score"), F.when(F.col("event_id") % 3 == 0, F.col("event_id") % 7).alias("hint"),
    )


def _entries(spark, d) -> DataFrame:
    e = registry.entries(_sightings(spark, d))
    rec = A.recordings(spark, d).select(F.col("recording_id").alias("rid"), "title", "artist")
    named = e.join(rec, (e["unknown_id"] == rec["rid"]) & (F.col("rid") % 2 == 0), "left")
    return named.withColumn("kind", F.when(F.col("unknown_id") % 4 == 0, "RIGHTS_UNKNOWN").otherwise("NOT_IDENTIFIED")).withColumn(
        "review_status", F.when(F.col("unknown_id") % 5 == 0, "REVIEWED").otherwise("PENDING")
    ).withColumn("label", T.display_label(F.lit(None).cast("string"), F.col("title"), F.col("artist"), F.concat(F.lit("file-"), F.col("unknown_id").cast("string"))))


def registry_list_page(spark, d):
    rows = _entries(spark, d).filter(registry.wanted(kind="NOT_IDENTIFIED", status="PENDING", q="BRAND", columns=("title", "artist", "label")))
    page = registry.page(rows, "count", 20, 5, "unknown_id")
    return page.select("unknown_id", "kind", "sighting_count", "last_seen_at", "label")


def registry_entry_detail(spark, d):
    return registry.last_sightings(_sightings(spark, d), 50).select("unknown_id", "sighting_id", "place")


def registry_stats_totals(spark, d):
    """Totals, counts by kind and by status in one grouping-sets aggregate."""
    e = _entries(spark, d)
    return e.groupingSets([[], [F.col("kind")], [F.col("review_status")]], F.col("kind"), F.col("review_status")).agg(
        F.count("*").alias("n"), F.coalesce(F.sum("sighting_count"), F.lit(0)).alias("sightings"), F.count_if(F.col("sighting_count") > 60).alias("resighted")
    ).select("kind", "review_status", "n", "sightings", "resighted")


def registry_counts_by(spark, d):
    return registry.counts_by(_sightings(spark, d).withColumn("platform", F.nullif("platform", F.lit("click"))), "platform")


def registry_sightings_by_day(spark, d):
    s = _sightings(spark, d)
    return registry.by_day(s, TODAY, 30, 420)


def registry_top_resighted(spark, d):
    return registry.page(_entries(spark, d).filter("sighting_count > 1"), "count", 5, 0, "unknown_id").select("unknown_id", "sighting_count")


def registry_job_rate(spark, d):
    """Registered entries over finished jobs since the first sighting's job."""
    o = A.table(spark, d, "orders")
    jobs_ = o.select(F.col("o_orderkey").alias("job_id"), F.col("o_orderstatus").alias("s"), F.col("o_orderdate").alias("created_at"))
    seen = _sightings(spark, d).select(F.col("sighting_id").alias("job_id")).distinct()
    first = F.broadcast(jobs_.join(seen, "job_id", "left_semi").agg(F.min("created_at").alias("t0")))
    done = jobs_.crossJoin(first).filter("created_at >= t0 and s = 'F'").agg(F.count("*").alias("done"))
    reg = _sightings(spark, d).agg(F.count_distinct("unknown_id").alias("registered"))
    return done.crossJoin(reg).select("done", "registered", F.round(F.when(F.col("done") > 0, F.col("registered") / F.col("done")), 6).alias("rate"))


def registry_upsert_batch(spark, d):
    """Two batches folded into an empty state."""
    s = _sightings(spark, d)
    state = spark.createDataFrame([], registry.STATE)
    for half in (0, 1):
        state = registry.upsert(state, s.filter(F.col("sighting_id") % 2 == half))
    return state.select("unknown_id", "first_seen_at", "last_seen_at", "sighting_count", "last_platform")


def unknown_classification(spark, d):
    li = A.table(spark, d, "lineitem")
    kind = F.get(F.array(*[F.lit(x) for x in ("EXACT_MATCH", "UNKNOWN", "NO_MATCH", "LICENSE_PREDICTED")]), F.pmod("l_partkey", F.lit(4)).cast("int"))
    c = registry.classify(kind, F.when(F.col("l_returnflag") == "R", "UNKNOWN").otherwise("LOW"), F.when(F.col("l_linenumber") > 1, F.col("l_partkey")))
    return li.groupBy(F.coalesce(c, F.lit("none")).alias("kind")).agg(F.count("*").alias("n"))


def rate_limit_events(spark, d):
    e = A.table(spark, d, "events").select("event_id", (F.col("user_id") % 20).alias("key"), "ts")
    return registry.admitted(e, limit=10, seconds=3600 * 24)


def novelty_filter(spark, d):
    s = A.table(spark, d, "embeddings").select((F.col("vec_id") % 25).alias("entry"), "vec_id", F.col("vec_id").alias("seg_start"), "embedding")
    return registry.novel(s, 0.25, 8)


def job_latest_state(spark, d):
    c = A.table(spark, d, "conversations")
    status = F.get(F.array(*[F.lit(x) for x in ("QUEUED", "PROCESSING", "DONE")]), F.least("turn", F.lit(2)).cast("int"))
    e = c.select(F.col("conv_id").alias("job_id"), status.alias("status"), F.col("turn").alias("at"))
    return jobs.latest_state(e)


def job_history(spark, d):
    o = A.table(spark, d, "orders").select((F.col("o_orderkey") % 200).alias("job_id"), F.col("o_orderkey").alias("at"), F.col("o_orderpriority").alias("risk"))
    return jobs.history(o, 50, "1-URGENT")


def job_errors(spark, d):
    code = F.get(F.array(*[F.lit(x) for x in (*jobs.HTTP_STATUS, "OTHER")]), F.pmod("o_orderkey", F.lit(13)).cast("int"))
    return A.table(spark, d, "orders").groupBy(jobs.http_status(code).alias("http")).agg(F.count("*").alias("n"))


# --- ETL


def _sources(spark, d) -> list[DataFrame]:
    p = A.table(spark, d, "part")
    cols = [F.col("p_name").alias("title"), F.col("p_brand").alias("artist"), F.col("p_partkey").alias("row_no")]
    key = lambda m: (F.col("p_partkey") % m).alias("key")
    n = p.count()
    return [
        p.filter("p_partkey % 3 = 0").select(key(n // 2 + 1), *cols, F.lit("a").alias("source")),
        p.filter("p_partkey % 3 = 1").select(key(n // 3 + 1), *cols, F.col("p_size").alias("year"), F.lit("b").alias("source")),
        p.filter("p_partkey % 3 = 2").select(key(n // 4 + 1), *cols, F.lit("c").alias("source")),
    ]


def etl_merge_sources(spark, d):
    merged = etl.merge(_sources(spark, d), "key")
    parents = A.table(spark, d, "supplier").select(F.col("s_suppkey").alias("key"))
    return etl.prune(merged, parents, "key").select("key", "title", "artist", "year", "source")


def etl_relabel(spark, d):
    r = A.recordings(spark, d).withColumn("source", F.when(F.col("src") == 0, "YouTube").when(F.col("src") == 1, None).otherwise("FMA"))
    out = etl.relabelled(r, "source", F.col("source").isNull() | (F.col("size") > 40), F.lit("SIMULATED"))
    return out.groupBy("source", "changed").agg(F.count("*").alias("n"))


def etl_stratified_sample(spark, d):
    return etl.stratified(A.table(spark, d, "part").select("p_partkey", "p_brand"), "p_brand", "p_partkey", 100).select("p_partkey", "p_brand", "turn")


def etl_capped(spark, d):
    li = A.table(spark, d, "lineitem").select("l_returnflag", "l_suppkey", "l_orderkey")
    return etl.capped(li, "l_returnflag", "l_suppkey", "l_orderkey", 5).groupBy("l_returnflag").agg(F.count("*").alias("n"), F.count_distinct("l_suppkey").alias("items"))


def etl_last_row_wins(spark, d):
    o = A.table(spark, d, "orders").select("o_custkey", "o_orderkey", "o_orderstatus")
    return etl.last_by_key(o, "o_custkey", "o_orderkey")


def etl_uuid5(spark, d):
    return A.table(spark, d, "supplier").select("s_suppkey", T.uuid5(F.col("s_name"), "6ba7b811-9dad-11d1-80b4-00c04fd430c8").alias("uuid"))


def test_plan_cross(spark, d):
    return etl.query_plan(A.recordings(spark, d), A.segments(spark, d), 50, 25)


def quality_suite(spark, d):
    """Checks of the tables, those of one table by one aggregate."""
    li, o = A.table(spark, d, "lineitem"), A.table(spark, d, "orders")
    p, c, e, docs = A.table(spark, d, "part"), A.table(spark, d, "customer"), A.table(spark, d, "embeddings"), A.table(spark, d, "documents")
    known = lambda df, key, name: df.select(F.col(key).alias(f"__{name}")).distinct()
    lines = li.join(known(o, "o_orderkey", "o"), F.col("l_orderkey") == F.col("__o"), "left").join(known(p, "p_partkey", "p"), F.col("l_partkey") == F.col("__p"), "left")
    buyers = o.join(known(c, "c_custkey", "c"), F.col("o_custkey") == F.col("__c"), "left")
    told = docs.join(known(A.table(spark, d, "labels"), "doc_id", "l"), F.col("doc_id") == F.col("__l"), "left")
    checks = [
        etl.checked(lines, {
            "fk_lineitem_orders": ("FAIL", F.col("l_orderkey").isNotNull() & F.col("__o").isNull(), "lines without an order"),
            "fk_lineitem_part": ("FAIL", F.col("l_partkey").isNotNull() & F.col("__p").isNull(), "lines without a part"),
        }),
        etl.checked(buyers, {
            "fk_orders_customer": ("FAIL", F.col("o_custkey").isNotNull() & F.col("__c").isNull(), "orders without a customer"),
            "null_keys": ("FAIL", F.col("o_orderkey").isNull(), "orders without a key"),
        }),
        etl.check("orphan_customers", "WARN", etl.orphans(c.select(F.col("c_custkey").alias("k")), o.select(F.col("o_custkey").alias("k")), "k"), "customers without an order"),
        etl.checked(e, {"vector_width": ("FAIL", F.size("embedding") != 64, "vectors of another width")}),
        etl.check("duplicate_texts", "WARN", docs.groupBy(F.md5("text")).count().filter("count > 1"), "texts that repeat"),
        etl.checked(told, {
            "plausible_length": ("FAIL", F.length("text") != F.col("n_chars"), "length is not n_chars"),
            "label_coverage": ("WARN", F.col("__l").isNull(), "documents without labels"),
        }),
        etl.check("all_returnflags", "WARN", li.agg(F.count_distinct("l_returnflag").alias("n")).filter("n < 3"), "classes without rows"),
    ]
    return reduce(DataFrame.unionByName, checks)


_S = "s as (select event_id as sighting_id, user_id as unknown_id, ts as seen_at, event_type as platform, value as match_score from events)"
_E = f"""{_S}, e0 as (select unknown_id, min(seen_at) as first_seen_at, max(seen_at) as last_seen_at, count(*) as sighting_count, arg_max(platform, (seen_at, sighting_id)) as last_platform from s group by unknown_id),
e as (select e0.*, p_name as title, p_brand as artist, case when unknown_id % 4 = 0 then 'RIGHTS_UNKNOWN' else 'NOT_IDENTIFIED' end as kind, case when unknown_id % 5 = 0 then 'REVIEWED' else 'PENDING' end as review_status,
    coalesce(p_name || ' — ' || p_brand, 'file-' || unknown_id) as label from e0 left join part on p_partkey = unknown_id and p_partkey % 2 = 0)"""


def _check_sql(name: str, severity: str, sql: str, detail: str) -> str:
    return f"select '{name}' as \"check\", case when n = 0 then 'PASS' else '{severity}' end as status, n, '{detail}' as detail from (select count(*) as n from ({sql}))"


def registry_learned(spark, d):
    """Every recording seen once, every third again a day later with its first vector only, and every third moved in pitch.

    Sightings are compared with all entries that are not forgotten; those that could match have one bucket."""
    e = A.segments(spark, d).groupBy("recording_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("seg_start", "embedding"))), lambda s: F.transform(s["embedding"], lambda x: x.cast("double"))).alias("v"))
    v = e.select("recording_id", F.transform("v", lambda x: vectors.normalised(x)).alias("mert"))
    cover = F.concat(F.col("mert")[0], F.array_repeat(F.lit(0.0), 8))
    second = F.lit(1_000_000)
    day = F.lit(86_400_000_000)
    none = F.lit(None)
    once = store.cut(v.select(F.col("recording_id").alias("id"), "mert", cover.alias("cover")))
    # later sightings have features of the first ones, and rotations score alike, so links of the first ones hold for all
    base = once.join(learning.linked(once, 12), "id").select("bucket", "id", (F.col("id") * 60 * second).alias("at"), "mert", "cover")
    base = store.cut(base)
    part = base.filter("id % 3 = 0").select("bucket", "id", (F.col("at") + day).alias("at"), F.slice("mert", 1, 1).alias("mert"), none.cast("array<double>").alias("cover"))
    moved = base.filter("id % 3 = 1").select("bucket", "id", (F.col("at") + day).alias("at"), none.cast("array<array<double>>").alias("mert"), vectors.rotated(F.col("cover"), 4, 12, 6).alias("cover"))
    beyond = base.agg((F.max("id") + 1).alias("beyond"))
    again = part.union(moved).crossJoin(beyond).withColumn("id", F.col("id") + F.col("beyond")).drop("beyond")
    rows = base.union(again).select(
        "bucket", F.col("id").alias("sighting_id"), F.col("at").alias("seen_at"), none.cast("array<long>").alias("items"), none.cast("double").alias("duration"), "mert", "cover", none.cast("long").alias("hint"))
    return learning.learned(rows, 12, caps=learning.Caps())


QUERIES = {f.__name__: f for f in (
    registry_learned,
    registry_list_page, registry_entry_detail, registry_stats_totals, registry_counts_by, registry_sightings_by_day, registry_top_resighted, registry_job_rate,
    registry_upsert_batch, unknown_classification, rate_limit_events, novelty_filter, job_latest_state, job_history, job_errors,
    etl_merge_sources, etl_relabel, etl_stratified_sample, etl_capped, etl_last_row_wins, etl_uuid5, test_plan_cross, quality_suite,
)}
_T = ", ".join("(" + ", ".join("null" if x is None else repr(x) for x in row) + ")" for row in (*etl.TRANSFORMATIONS, etl.OUTSIDE))
ORACLE = {
    "registry_list_page": f"with {_E} select unknown_id, kind, sighting_count, last_seen_at, label from e where kind = 'NOT_IDENTIFIED' and review_status = 'PENDING' and (contains(lower(coalesce(title, '')), 'brand') or contains(lower(coalesce(artist, '')), 'brand') or contains(lower(label), 'brand')) order by sighting_count desc, last_seen_at desc, unknown_id limit 20 offset 5",
    "registry_entry_detail": f"with {_S} select unknown_id, sighting_id, row_number() over (partition by unknown_id order by seen_at desc, sighting_id desc)::int as place from s qualify place <= 50",
    "registry_stats_totals": f"with {_E} select kind, review_status, count(*) as n, coalesce(sum(sighting_count), 0)::bigint as sightings, count(*) filter (where sighting_count > 60) as resighted from e group by grouping sets ((), (kind), (review_status))",
    "registry_counts_by": f"with {_S} select coalesce(nullif(platform, 'click'), '—') as value, count(*) as n from s group by 1",
    "registry_sightings_by_day": f"with {_S}, d as (select (date '{TODAY}' - i::int) as day from (select unnest(generate_series(0, 29)) as i)), c as (select (seen_at + interval 420 minute)::date as day, count(*) as n from s group by 1) select d.day::varchar as day, coalesce(n, 0) as n from d left join c on c.day = d.day",
    "registry_top_resighted": f"with {_E} select unknown_id, sighting_count from e where sighting_count > 1 order by sighting_count desc, last_seen_at desc, unknown_id limit 5",
    "registry_job_rate": "with t as (select min(o_orderdate) as t0 from orders where o_orderkey in (select event_id from events)), a as (select count(*) as done from orders, t where o_orderdate >= t0 and o_orderstatus = 'F'), b as (select count(distinct user_id) as registered from events) select done, registered, case when done > 0 then round(registered / done::double, 6) end as rate from a, b",
    "registry_upsert_batch": f"with {_E} select unknown_id, first_seen_at, last_seen_at, sighting_count, last_platform from e",
    "unknown_classification": "select case when l_partkey % 4 = 1 then 'NOT_IDENTIFIED' when l_returnflag = 'R' and l_linenumber > 1 then 'RIGHTS_UNKNOWN' else 'none' end as kind, count(*) as n from lineitem group by 1",
    "job_latest_state": "select conv_id as job_id, case max(least(turn, 2)) when 0 then 'QUEUED' when 1 then 'PROCESSING' else 'DONE' end as status, max(turn) as updated_at, count(*) as n_events from conversations group by 1",
    "job_history": "with o as (select o_orderkey % 200 as job_id, o_orderkey as at_, o_orderpriority as risk from orders), l as (select * from o qualify row_number() over (partition by job_id order by at_ desc) = 1), t as (select * from l order by at_ desc, job_id limit 50) select job_id, at_ as at, risk from t where risk = '1-URGENT'",
    "job_errors": "select [413, 415, 429, 401, 422, 422, 503, 503, 504, 404, 422, 500, 500][o_orderkey % 13 + 1] as http, count(*) as n from orders group by 1",
    "etl_merge_sources": """with n as (select count(*) as n from part), u as (
select p_partkey % (n // 2 + 1) as key, p_name as title, p_brand as artist, null::int as year, 'a' as source, 0 as p, p_partkey as r from part, n where p_partkey % 3 = 0
union all select p_partkey % (n // 3 + 1), p_name, p_brand, p_size, 'b', 1, p_partkey from part, n where p_partkey % 3 = 1 union all select p_partkey % (n // 4 + 1), p_name, p_brand, null, 'c', 2, p_partkey from part, n where p_partkey % 3 = 2),
m as (select * from u qualify row_number() over (partition by key order by p, r) = 1) select key, title, artist, year, source from m where key in (select s_suppkey from supplier)""",
    "etl_relabel": f"""with {A.SQL_REC}, r as (select size, case src when 0 then 'YouTube' when 1 then null else 'FMA' end as source from rec), n as (select source, case when source is null or size > 40 then 'SIMULATED' else source end as new from r)
select new as source, source is distinct from new as changed, count(*) as n from n group by all""",
    "etl_stratified_sample": "with r as (select p_partkey, p_brand, row_number() over (partition by p_brand order by md5('s:' || p_partkey), p_partkey)::int as turn, count(*) over (partition by p_brand) as size from part) select p_partkey, p_brand, turn from r order by turn, size desc, p_brand, p_partkey limit 100",
    "etl_capped": "with f as (select l_returnflag, l_suppkey, min(l_orderkey) as f from lineitem group by all), k as (select * from f qualify row_number() over (partition by l_returnflag order by f, l_suppkey) <= 5) select l_returnflag, count(*) as n, count(distinct l_suppkey) as items from lineitem join k using (l_returnflag, l_suppkey) group by 1",
    "etl_last_row_wins": "select o_custkey, o_orderkey, o_orderstatus from orders qualify row_number() over (partition by o_custkey order by o_orderkey desc) = 1",
    "test_plan_cross": f"""with r as (select p_partkey as recording_id, p_type as composition_id, p_partkey in (select vec_id // 2 from embeddings) as has from part), k as (select * from r order by has desc, recording_id limit 50),
u as (select * from r where not has order by recording_id desc limit 25), t(transformation, snr, pitch_shift, tempo_factor, codec, bitrate, segment_start, duration, expected_match_type) as (values {_T})
select k.recording_id, k.composition_id, transformation, snr::double as snr, pitch_shift::double as pitch_shift, tempo_factor::double as tempo_factor, codec, bitrate, segment_start::double as segment_start, duration::double as duration, expected_match_type from k, t where transformation <> 'out_of_database'
union all select u.recording_id, u.composition_id, transformation, snr::double, pitch_shift::double, tempo_factor::double, codec, bitrate, segment_start::double, duration::double, expected_match_type from u, t where transformation = 'out_of_database'""",
    "etl_uuid5": """with h as (select s_suppkey, sha1(unhex('6ba7b8119dad11d180b400c04fd430c8') || encode(s_name)) as h from supplier)
select s_suppkey, h[1:8] || '-' || h[9:12] || '-5' || h[14:16] || '-' || printf('%02x', ((('0x' || h[17:18])::int & 63) | 128)) || h[19:20] || '-' || h[21:32] as uuid from h""",
    "rate_limit_events": """with recursive e as (select event_id, user_id % 20 as key, epoch_us(ts) as t, row_number() over (partition by user_id % 20 order by ts, event_id) as r from events),
f as (select event_id, key, r, true as admitted, 0::bigint as retry_after, [t] as recent from e where r = 1
union all select event_id, key, r, len(kept) < 10, case when len(kept) < 10 then 0 else greatest(1, ceil(86400 - (t - kept[1]) / 1e6)::bigint) end, case when len(kept) < 10 then list_append(kept, t) else kept end
    from (select e.*, list_filter(f.recent, lambda x: x > e.t - 86400000000) as kept from f join e on e.key = f.key and e.r = f.r + 1))
select event_id, key, admitted, retry_after from f""",
    "novelty_filter": """with recursive e as (select vec_id % 25 as entry, vec_id, embedding::double[] as v, row_number() over (partition by vec_id % 25 order by vec_id) as r from embeddings),
f as (select entry, vec_id, r, true as kept, [v] as all_ from e where r = 1
union all select entry, vec_id, r, ok, case when ok then list_append(all_, v) else all_ end
    from (select e.*, f.all_, len(f.all_) < 8 and list_max(list_transform(f.all_, lambda x: list_dot_product(x, e.v))) < 0.25 as ok from f join e on e.entry = f.entry and e.r = f.r + 1))
select entry, vec_id from f where kept""",
    "quality_suite": " union all ".join([
        _check_sql("fk_lineitem_orders", "FAIL", "select 1 from lineitem where l_orderkey not in (select o_orderkey from orders)", "lines without an order"),
        _check_sql("fk_lineitem_part", "FAIL", "select 1 from lineitem where l_partkey not in (select p_partkey from part)", "lines without a part"),
        _check_sql("fk_orders_customer", "FAIL", "select 1 from orders where o_custkey not in (select c_custkey from customer)", "orders without a customer"),
        _check_sql("orphan_customers", "WARN", "select 1 from customer where c_custkey not in (select o_custkey from orders)", "customers without an order"),
        _check_sql("vector_width", "FAIL", "select 1 from embeddings where len(embedding) <> 64", "vectors of another width"),
        _check_sql("duplicate_texts", "WARN", "select text from documents group by text having count(*) > 1", "texts that repeat"),
        _check_sql("plausible_length", "FAIL", "select 1 from documents where length(text) <> n_chars", "length is not n_chars"),
        _check_sql("label_coverage", "WARN", "select 1 from documents where doc_id not in (select doc_id from labels)", "documents without labels"),
        _check_sql("all_returnflags", "WARN", "select 1 from (select count(distinct l_returnflag) as n from lineitem) where n < 3", "classes without rows"),
        _check_sql("null_keys", "FAIL", "select 1 from orders where o_orderkey is null", "orders without a key"),
    ]),
}
