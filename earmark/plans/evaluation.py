"""Queries of sweeps, comparisons, robustness, calibration, models and codecs."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..operators import audio_features, codec, crossfit, evaluation, fingerprint, ml
from ..sources import adapters as A


def _scores(spark, d):
    x = A.table(spark, d, "documents").join(A.table(spark, d, "labels"), "doc_id")
    return x.select(F.col("quality").alias("truth"), (F.least(F.col("n_chars"), F.lit(5000)) / 5000).alias("score"))


def eval_threshold_sweep(spark, d):
    return evaluation.sweep(_scores(spark, d), evaluation.grid(spark, 0.0, 1.0, 20))


def eval_calibrated_threshold(spark, d):
    return evaluation.calibrate(eval_threshold_sweep(spark, d), (0.05, 0.3)).select(
        "tau", "safe", F.round(evaluation.tightened(F.lit(0.3), F.col("tau")), 4).alias("applied")
    )


SYSTEMS = ("embedding", "fingerprint", "cover", "fp_embedding", "full")


def _results(spark, d):
    """Five systems over the lines of orders: each accepts and is right by buckets of the line."""
    li = A.table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_quantity", "l_returnflag", "l_extendedprice")
    li = li.withColumn("q", F.col("l_orderkey") * 10 + F.col("l_linenumber"))
    systems = [F.struct(F.lit(s).alias("system"), A.bucket(F.concat_ws("-", F.lit(s), F.col("q").cast("string")), "acc", 10).alias("b")) for s in SYSTEMS]
    long = li.select("*", F.explode(F.array(*systems)).alias("s"))
    return long.select(
        "q", F.col("l_returnflag").alias("transformation"), "s.system", (F.col("s.b") < 8).alias("accepted"), (F.col("s.b") < 6).alias("correct"),
        (F.col("l_quantity") > 5).alias("known"), (F.col("l_extendedprice") / 100).alias("latency"),
    )


def eval_five_systems(spark, d):
    return evaluation.system_summary(_results(spark, d))


def eval_by_transformation(spark, d):
    return evaluation.by_transformation(_results(spark, d), list(SYSTEMS))


def eval_robustness_families(spark, d):
    """Family means weighted by their counts; blind spots are families at 5 % or less."""
    per = _results(spark, d).groupBy("transformation", "system").agg(F.count("*").alias("n"), F.avg((F.col("accepted") & F.col("correct")).cast("double")).alias("acc"))
    fam = per.withColumn("family", F.when(F.col("transformation") == "N", "clean").otherwise("changed"))
    return fam.groupBy("family", "system").agg(
        F.sum("n").alias("n"), F.round(F.sum(F.col("acc") * F.col("n")) / F.sum("n"), 6).alias("acc"), (F.min("acc") <= 0.05).alias("blind")
    )


def eval_union_recall(spark, d):
    """Share of orders whose truth (the first part) is among the union of two candidate lists."""
    li = A.table(spark, d, "lineitem")
    g = li.groupBy("l_orderkey").agg(
        F.min_by("l_partkey", F.struct("l_linenumber", "l_partkey")).alias("truth"), F.collect_set(F.when(F.col("l_returnflag") == "N", F.col("l_partkey"))).alias("a"),
        F.collect_set(F.when(F.col("l_quantity") > 30, F.col("l_partkey"))).alias("b"),
    )
    hit = lambda c: F.round(F.avg(F.arrays_overlap(c, F.array("truth")).cast("double")), 6)
    return g.agg(F.count("*").alias("n"), hit(F.col("a")).alias("recall_a"), hit(F.col("b")).alias("recall_b"), hit(F.array_union("a", "b")).alias("recall_union"))


def _classes(spark, d):
    c = F.col("l_extendedprice")
    said = F.when(c > 60000, "HIGH").when(c > 30000, "CONDITIONAL").when(c > 8000, "LOW").otherwise("UNKNOWN")
    q = F.col("l_quantity")
    truth = F.when(q > 35, "HIGH").when(q > 18, "CONDITIONAL").otherwise("LOW")
    return A.table(spark, d, "lineitem").select(truth.alias("truth"), said.alias("predicted"), "l_returnflag", "l_linestatus")


def eval_confusion_matrix(spark, d):
    return evaluation.confusion(_classes(spark, d))


def eval_class_report(spark, d):
    return evaluation.class_report(eval_confusion_matrix(spark, d))


def eval_overall(spark, d):
    return evaluation.overall(eval_confusion_matrix(spark, d))


def eval_slices(spark, d):
    """Accuracy overall, by condition and by context in one grouping-sets pass."""
    x = _classes(spark, d)
    ok = (F.col("truth") == F.col("predicted")).cast("double")
    return x.groupingSets([[], [F.col("l_returnflag")], [F.col("l_linestatus")]], F.col("l_returnflag"), F.col("l_linestatus")).agg(
        F.count("*").alias("n"), F.round(F.avg(ok), 6).alias("accuracy")
    ).select("l_returnflag", "l_linestatus", "n", "accuracy")


def eval_latency_percentiles(spark, d):
    x = A.table(spark, d, "lineitem").withColumn("ms", F.col("l_extendedprice") / 10)
    return evaluation.latency(x, "l_returnflag", "ms")


def eval_label_spread(spark, d):
    """Share of customers with more than one priority among their orders."""
    o = A.table(spark, d, "orders").groupBy("o_custkey").agg(F.count_distinct("o_orderpriority").alias("k"))
    return o.agg(F.count("*").alias("n"), F.round(F.avg((F.col("k") > 1).cast("double")), 6).alias("share"))


def eval_same_queries(spark, d):
    a, b = A.table(spark, d, "lineitem").select(F.col("l_orderkey").alias("q")).distinct(), A.table(spark, d, "orders").select(F.col("o_orderkey").alias("q"))
    return a.exceptAll(b).agg(F.count("*").alias("only_a")).crossJoin(b.exceptAll(a).agg(F.count("*").alias("only_b")))


def codec_decode(spark, d):
    """Documents' items written as fingerprint strings and read back."""
    q = A.query_items(spark, d)
    seq = q.groupBy("query_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("pos", "h"))), lambda s: s["h"]).alias("items"))
    x = seq.withColumn("text", codec.encoded(F.col("items"))).withColumn("got", codec.decoded(F.col("text")))
    return x.select("query_id", F.size("got").alias("n"), (F.col("got") == F.col("items")).alias("same"), fingerprint.plausible(F.size("got"), F.size("got") / 7.5).alias("plausible"))


def pooling_compare(spark, d):
    f = A.table(spark, d, "embeddings").select((F.col("vec_id") % 100).alias("k"), F.col("embedding").alias("v"))
    p = audio_features.pooled(f, "k")
    x = p.select("k", F.posexplode("mean_std").alias("i", "x"))
    return x.select("k", "i", F.round("x", 5).alias("x"))


def license_classifier_cv(spark, d):
    e = A.table(spark, d, "embeddings").withColumn("artist", F.col("vec_id") % 50)
    rows = ml.prepared(e, "embedding", "label", "artist", 3)
    cv = ml.cross_validated(rows, "by_group", (0.1, 1.0), 3, 8)
    return ml.complexity(cv)


def license_protocols(spark, d):
    """Cross-validation by row, by artist, and the commonest class: macro-F1 and accuracy of two strengths."""
    e = A.table(spark, d, "embeddings").select(F.col("vec_id").alias("id"), F.transform("embedding", lambda x: x.cast("double")).alias("x"), F.col("label").cast("int").alias("label"), (F.col("vec_id") % 50).alias("artist"))
    classes = e.select("label").distinct().select("label", (F.row_number().over(Window.orderBy("label")) - 1).alias("y"))
    rows = e.join(F.broadcast(classes), "label")
    return crossfit.protocols(rows, "artist", 3, (0.1, 1.0), classes.count(), 64, 12)


def license_folds(spark, d):
    """The fold of each artist, and how many of each class it brings."""
    e = A.table(spark, d, "embeddings").select("label", (F.col("vec_id") % 50).alias("artist"))
    return crossfit.group_folds(e, "artist", "label", 3)


def eval_error_breakdown(spark, d):
    return evaluation.error_breakdown(_results(spark, d).filter("system = 'full'"), "R")


def eval_distribution(spark, d):
    return evaluation.described(A.table(spark, d, "events"), "event_type", "value")


def eval_window_summary(spark, d):
    w = A.table(spark, d, "lineitem").groupBy(F.col("l_orderkey").alias("query_id")).agg(F.count_if(F.col("l_quantity") < 48).alias("n"), F.count("*").alias("planned"))
    return evaluation.window_summary(w, 5)


def eval_best_relevant(spark, d):
    li = A.table(spark, d, "lineitem")
    x = li.select(F.col("l_orderkey").alias("query_id"), F.col("l_linenumber").alias("oti"), F.col("l_quantity").alias("score"), (F.col("l_returnflag") == "N").alias("relevant"))
    return evaluation.best_relevant(x, "oti").groupBy("oti").agg(F.count("*").alias("n"))


def fp_variants_accepted(spark, d):
    """Share of each kind of variant whose best reference is its source."""
    r = A.query_items(spark, d).select(F.col("query_id").alias("doc_id"), "pos", "h")
    seqs = r.groupBy(F.col("doc_id").alias("id")).agg(F.transform(F.array_sort(F.collect_list(F.struct("pos", "h"))), lambda s: s["h"]).alias("items"))
    v = fingerprint.variants(seqs).withColumn("query_id", F.concat_ws("|", F.col("id").cast("string"), "kind"))
    q = v.select("query_id", F.posexplode("items").alias("pos", "h"))
    best = fingerprint.alignment(q, r).groupBy("query_id").agg(F.max_by("doc_id", F.struct("score", -F.col("doc_id"))).alias("doc_id"), F.max("score").alias("score"))
    own = F.coalesce((F.col("doc_id") == F.split("query_id", "[|]")[0].cast("long")) & (F.col("score") >= 0.3), F.lit(False))
    return v.select("query_id", "kind").join(best, "query_id", "left").groupBy("kind").agg(F.count("*").alias("n"), F.round(F.avg(own.cast("double")), 4).alias("accepted"))


QUERIES = {f.__name__: f for f in (
    eval_error_breakdown, eval_distribution, eval_window_summary, eval_best_relevant, fp_variants_accepted, eval_threshold_sweep, eval_calibrated_threshold, eval_five_systems, eval_by_transformation, eval_robustness_families, eval_union_recall, eval_confusion_matrix,
    eval_class_report, eval_overall, eval_slices, eval_latency_percentiles, eval_label_spread, eval_same_queries, codec_decode, pooling_compare, license_classifier_cv, license_protocols, license_folds,
)}

from .similarity import _SWEEP  # noqa: E402

_SC = "with scored as (select quality as truth, least(n_chars, 5000) / 5000.0::double as score from documents join labels using (doc_id)),"
_RES = f"""with r0 as (select l_orderkey * 10 + l_linenumber as q, l_returnflag as transformation, l_quantity, l_extendedprice, s as system from lineitem, unnest(['{"', '".join(SYSTEMS)}']) t(s)),
r1 as (select *, {A.sql_bucket("(system || '-' || q)", "acc", 10)} as b from r0), res as (select transformation, system, b < 8 as accepted, b < 6 as correct, l_quantity > 5 as known, l_extendedprice / 100 as latency from r1)"""
_CL = """with c as (select case when l_quantity > 35 then 'HIGH' when l_quantity > 18 then 'CONDITIONAL' else 'LOW' end as truth,
case when l_extendedprice > 60000 then 'HIGH' when l_extendedprice > 30000 then 'CONDITIONAL' when l_extendedprice > 8000 then 'LOW' else 'UNKNOWN' end as predicted, l_returnflag, l_linestatus from lineitem),
m as (select truth, predicted, count(*) as n from c group by all), k as (select truth as cls from m union select predicted from m),
s as (select cls, coalesce((select sum(n) from m where truth = cls), 0)::bigint as support, coalesce((select sum(n) from m where predicted = cls), 0)::bigint as said, coalesce((select sum(n) from m where truth = cls and predicted = cls), 0)::bigint as tp from k),
pr as (select *, case when said > 0 then tp / said::double else 0 end as p, case when support > 0 then tp / support::double else 0 end as r from s),
rep as (select cls, support, round(p, 6) as "precision", round(r, 6) as recall, round(case when p + r > 0 then 2 * p * r / (p + r) else 0 end, 6) as f1 from pr)"""
from .similarity import _near  # noqa: E402

_VARIANTS = f"""with {A.SQL_Q}, r as (select query_id as doc_id, pos, h from q), seq as (select query_id as id, list(h order by pos) as x from q group by 1),
kinds as (select id, 'original' as kind, x from seq union all select id, 'crop', x[len(x) // 4 + 1 : len(x) // 4 + greatest(len(x) // 2, 1)] from seq union all select id, 'shift', list_concat([0::bigint, 1::bigint], x) from seq
    union all select id, 'flip', [xor(v, (1::bigint << ((v + i - 1) % 32)::int)) for v, i in x] from seq union all select id, 'thin', [v for v, i in x if (i - 1) % 5 <> 4] from seq),
vq as (select id || '|' || kind as query_id, (p - 1)::int as pos, x[p] as h from kinds, unnest(generate_series(1, len(x))) t(p)), {_near(None, "fv", "vq")},
best as (select * from fv qualify row_number() over (partition by query_id order by score desc, doc_id) = 1)
select kind, count(*) as n, round(avg(case when doc_id = id and score >= 0.3 then 1::double else 0 end), 4) as accepted from kinds left join best on query_id = id || '|' || kind group by 1"""
ORACLE = {
    "fp_variants_accepted": _VARIANTS,
    "codec_decode": f"with {A.SQL_Q}, n as (select query_id, count(*)::int as n from q group by 1) select query_id, n, true as same, n between 4 * least(n / 7.5::double, 120) - 20 and 12 * least(n / 7.5::double, 120) + 20 as plausible from n",
    "eval_error_breakdown": _RES + " select case when transformation = 'R' then 'special' else 'other' end as kind, transformation, count(*) filter (where accepted and not correct) as wrong, count(*) filter (where not accepted) as missed, count(*) as n from res where system = 'full' group by all",
    "eval_distribution": "select event_type, count(value) as n, round(avg(value), 6) as mean, max(value) as top, round(quantile_cont(value::double, 0.95), 4) as p from events group by 1",
    "eval_window_summary": "with w as (select l_orderkey, count(*) filter (where l_quantity < 48) as n, count(*) as planned from lineitem group by 1) select count(*) as queries, round(avg(n), 4) as mean_windows, round(avg(case when n < planned then 1.0::double else 0 end), 6) as early, round(avg(case when n >= 5 then 1.0::double else 0 end), 6) as exhausted from w",
    "eval_best_relevant": "with b as (select l_orderkey, arg_max(l_linenumber, (l_quantity, -l_linenumber)) as oti from lineitem where l_returnflag = 'N' group by 1) select oti, count(*) as n from b group by 1",
    "eval_threshold_sweep": _SC + _SWEEP.format(lo="0.0::double", step="0.05", n=20) + " select * from sweep",
    "eval_calibrated_threshold": _SC + _SWEEP.format(lo="0.0::double", step="0.05", n=20) + """, a as (select (select tau from sweep where fpr <= 0.05 order by f1 desc, tau limit 1) as t1, (select tau from sweep where fpr <= 0.3 order by f1 desc, tau limit 1) as t2, (select tau from sweep order by f1 desc, tau desc limit 1) as t3)
select coalesce(t1, t2, t3) as tau, coalesce(t1, t2) is not null as safe, round(greatest(0.3::double, coalesce(t1, t2, t3)), 4) as applied from a""",
    "eval_five_systems": _RES + """, a as (select system, count(*) as n, count(*) filter (where accepted) as acc, count(*) filter (where accepted and correct) as c, count(*) filter (where known) as k, avg(latency) as l from res group by 1), p as (select *, c / acc::double as p, c / k::double as r from a)
select system, n, acc as accepted, c as correct, acc - c as wrong, n - acc as abstained, round(p, 6) as "precision", round(r, 6) as recall, round(2 * p * r / (p + r), 6) as f1, round(l, 4) as latency_mean from p""",
    "eval_by_transformation": _RES + " select transformation, " + ", ".join(f"round(avg(case when accepted and correct then 1.0::double else 0 end) filter (where system = '{s}'), 6) as \"{s}\"" for s in SYSTEMS) + " from res group by 1",
    "eval_robustness_families": _RES + """, p as (select transformation, system, count(*) as n, avg(case when accepted and correct then 1.0::double else 0 end) as acc from res group by all)
select case when transformation = 'N' then 'clean' else 'changed' end as family, system, sum(n)::bigint as n, round(sum(acc * n) / sum(n), 6) as acc, min(acc) <= 0.05 as blind from p group by 1, 2""",
    "eval_union_recall": """with g as (select l_orderkey, arg_min(l_partkey, (l_linenumber, l_partkey)) as truth from lineitem group by 1), h as (select g.l_orderkey, max((l_partkey = truth and l_returnflag = 'N')::int) as a, max((l_partkey = truth and l_quantity > 30)::int) as b from g join lineitem l using (l_orderkey) group by 1)
select count(*) as n, round(avg(a::double), 6) as recall_a, round(avg(b::double), 6) as recall_b, round(avg(greatest(a, b)::double), 6) as recall_union from h""",
    "eval_confusion_matrix": _CL + " select * from m",
    "eval_class_report": _CL + " select * from rep",
    "eval_overall": _CL + " select (select sum(n)::bigint from m) as n, (select round(sum(case when truth = predicted then n else 0 end) / sum(n)::double, 6) from m) as accuracy, (select round(avg(f1), 5) from rep where support > 0) as macro_f1",
    "eval_slices": _CL + " select l_returnflag, l_linestatus, count(*) as n, round(avg(case when truth = predicted then 1.0::double else 0 end), 6) as accuracy from c group by grouping sets ((), (l_returnflag), (l_linestatus))",
    "eval_latency_percentiles": "select l_returnflag, count(*) as n, round(avg(x), 4) as mean, round(quantile_cont(x, 0.5), 4) as p50, round(quantile_cont(x, 0.95), 4) as p95, round(max(x), 4) as max from (select l_returnflag, l_extendedprice::double / 10 as x from lineitem) group by 1",
    "eval_label_spread": "select count(*) as n, round(avg(case when k > 1 then 1.0::double else 0 end), 6) as share from (select o_custkey, count(distinct o_orderpriority) as k from orders group by 1)",
    "eval_same_queries": "select (select count(*) from (select distinct l_orderkey from lineitem except all select o_orderkey from orders)) as only_a, (select count(*) from (select o_orderkey from orders except all select distinct l_orderkey from lineitem)) as only_b",
    "pooling_compare": """with e as (select vec_id % 100 as k, i, embedding[i]::double as x from embeddings, (select unnest(generate_series(1, 64)) as i))
select k, (i - 1)::int as i, round(avg(x), 5) as x from e group by all union all select k, (i + 63)::int, round(coalesce(stddev_samp(x), 0), 5) from e group by k, i""",
}
