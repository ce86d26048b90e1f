"""Sweeps, rankings, confusion, robustness and calibration."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..sources import store


def ratio(a: Column, b: Column) -> Column:
    return F.when(b > 0, a / b).otherwise(0.0)


def f1(p: Column, r: Column) -> Column:
    return F.when(p + r > 0, 2 * p * r / (p + r)).otherwise(0.0)


def grid(spark, low: float, high: float, steps: int) -> DataFrame:
    """steps + 1 thresholds, at 4 digits."""
    return spark.range(steps + 1).select(F.round(F.lit(low) + F.col("id") * ((high - low) / steps), 4).alias("tau"))


def sweep(scores: DataFrame, taus: DataFrame) -> DataFrame:
    """Precision, recall, F1 and false-positive rate of ``score >= tau`` against ``truth``.

    Scores are counted by threshold cell first: one pass and a small cumulative sum, not a product with the grid.
    """
    levels = [r["tau"] for r in taus.orderBy("tau").collect()]  # the grid is a parameter
    cell = F.size(F.filter(F.array(*[F.lit(x) for x in levels]), lambda x: x <= F.col("score")))
    cells = scores.filter("score is not null and truth is not null").groupBy(cell.alias("cell")).agg(
        F.count_if(F.col("truth") == 1).alias("good"), F.count_if(F.col("truth") == 0).alias("bad")
    )
    place = F.broadcast(taus.sparkSession.createDataFrame([(i + 1, x) for i, x in enumerate(levels)], "i int, tau double"))
    all_ = cells.agg(F.sum("good").alias("pos"), F.sum("bad").alias("neg"))
    got = place.join(cells, F.col("cell") >= F.col("i"), "left").groupBy("tau").agg(
        F.coalesce(F.sum("good"), F.lit(0)).alias("tp"), F.coalesce(F.sum("bad"), F.lit(0)).alias("fp")
    ).crossJoin(F.broadcast(all_))
    p, r = ratio(F.col("tp"), F.col("tp") + F.col("fp")), ratio(F.col("tp"), F.col("pos"))
    return got.select(
        "tau", "tp", "fp", F.round(p, 6).alias("precision"), F.round(r, 6).alias("recall"), F.round(f1(p, r), 6).alias("f1"),
        F.round(ratio(F.col("fp"), F.col("neg")), 6).alias("fpr"),
    )


def calibrate(sweeps: DataFrame, bounds: tuple[float, ...] = (0.005, 0.05)) -> DataFrame:
    """Threshold of the highest F1 under the tightest false-positive bound that leaves any, ties to the lower threshold;
    without any, the highest F1 with the higher threshold, marked unsafe."""
    key = F.struct("f1", -F.col("tau"))
    picks = [F.max_by("tau", F.when(F.col("fpr") <= b, key)).alias(f"b{i}") for i, b in enumerate(bounds)]
    last = F.max_by("tau", F.struct("f1", "tau")).alias("last")
    got = sweeps.agg(*picks, last)
    names = [f"b{i}" for i in range(len(bounds))]
    return got.select(F.coalesce(*names, "last").alias("tau"), F.coalesce(*names).isNotNull().alias("safe"))


def unknown_sweep(known: DataFrame, unknown: DataFrame, taus: DataFrame) -> DataFrame:
    """Of known queries (score, ok) and unknown ones (score): false matches, recall and precision of rejecting the unknown,
    and right and wrong accepts of the known, by threshold; 4 digits."""
    levels = [r["tau"] for r in taus.orderBy("tau").collect()]  # the grid is a parameter
    cell = F.size(F.filter(F.array(*[F.lit(x) for x in levels]), lambda x: x <= F.col("score"))).alias("cell")
    rows = known.select(cell, F.lit(1).alias("k"), F.col("ok").cast("int").alias("ok")).union(unknown.select(cell, F.lit(0), F.lit(0)))
    cells = rows.groupBy("cell").agg(F.sum("k").alias("k"), F.sum("ok").alias("c"), F.count_if(F.col("k") == 0).alias("u"))
    place = F.broadcast(taus.sparkSession.createDataFrame([(i + 1, x) for i, x in enumerate(levels)], "i int, tau double"))
    whole = F.broadcast(cells.agg(F.sum("k").alias("all_k"), F.sum("u").alias("all_u")))
    got = place.join(cells, F.col("cell") >= F.col("i"), "left").groupBy("tau").agg(*[F.coalesce(F.sum(x), F.lit(0)).alias(x) for x in "kcu"]).crossJoin(whole)
    out_u, out_k = F.col("all_u") - F.col("u"), F.col("all_k") - F.col("k")
    digits = lambda c: F.round(c, 4)
    return got.select(
        "tau", digits(ratio(F.col("u"), F.col("all_u"))).alias("false_match_rate"), digits(1 - ratio(F.col("u"), F.col("all_u"))).alias("unknown_recall"),
        digits(ratio(out_u, out_u + out_k)).alias("unknown_precision"), digits(ratio(F.col("c"), F.col("all_k"))).alias("true_accept_rate"),
        digits(ratio(F.col("k") - F.col("c"), F.col("all_k"))).alias("wrong_accept_rate"),
    )


def two_rate_sweep(results: DataFrame, taus: DataFrame) -> DataFrame:
    """Precision, recall and F1 of accepted answers, and two shares of false accepts: without all that is held out, and
    without exact copies only (held_exact, or held where null). results: score, ok, held, held_exact."""
    levels = [r["tau"] for r in taus.orderBy("tau").collect()]  # the grid is a parameter
    cell = lambda c: F.size(F.filter(F.array(*[F.lit(x) for x in levels]), lambda x: x <= c))
    kinds = F.array(
        F.struct(cell(F.col("score")).alias("cell"), F.lit("a").alias("k"), F.col("ok").cast("int").alias("ok")),
        F.struct(cell(F.col("held")).alias("cell"), F.lit("h").alias("k"), F.lit(0).alias("ok")),
        F.struct(cell(F.coalesce("held_exact", "held")).alias("cell"), F.lit("e").alias("k"), F.lit(0).alias("ok")),
    )
    cells = results.select(F.explode(kinds).alias("x")).select("x.*").groupBy("cell").agg(*[F.count_if(F.col("k") == k).alias(k) for k in "ahe"], F.sum("ok").alias("c"))
    place = F.broadcast(taus.sparkSession.createDataFrame([(i + 1, x) for i, x in enumerate(levels)], "i int, tau double"))
    whole = F.broadcast(cells.agg(F.sum("a").alias("n")))
    got = place.join(cells, F.col("cell") >= F.col("i"), "left").groupBy("tau").agg(*[F.coalesce(F.sum(x), F.lit(0)).alias(x) for x in "ahec"]).crossJoin(whole)
    p, r = ratio(F.col("c"), F.col("a")), ratio(F.col("c"), F.col("n"))
    return got.select(
        "tau", F.round(p, 4).alias("precision"), F.round(r, 4).alias("recall"), F.round(f1(p, r), 4).alias("f1"),
        F.round(ratio(F.col("h"), F.col("n")), 4).alias("false_positive_rate"), F.round(ratio(F.col("e"), F.col("n")), 4).alias("false_positive_rate_exact_only"),
        F.col("a").alias("accepted"),
    )


def noise_sweep(top1: DataFrame, held_out: DataFrame, noise: DataFrame, taus: DataFrame) -> DataFrame:
    """Precision, recall and F1 of accepting the best answer at ``score >= tau`` (top1: score, ok), and the shares of
    held-out and of noise probes that are accepted; 4 digits. Scores are counted by threshold cell first."""
    levels = [r["tau"] for r in taus.orderBy("tau").collect()]  # the grid is a parameter
    cell = F.size(F.filter(F.array(*[F.lit(x) for x in levels]), lambda x: x <= F.col("score"))).alias("cell")
    kinds = [top1.select(cell, F.lit("a").alias("k"), F.col("ok").cast("int").alias("ok")), held_out.select(cell, F.lit("h"), F.lit(0)), noise.select(cell, F.lit("n"), F.lit(0))]
    cells = kinds[0].union(kinds[1]).union(kinds[2]).groupBy("cell").agg(
        *[F.count_if(F.col("k") == k).alias(k) for k in "ahn"], F.sum("ok").alias("c")
    )
    place = F.broadcast(taus.sparkSession.createDataFrame([(i + 1, x) for i, x in enumerate(levels)], "i int, tau double"))
    whole = F.broadcast(cells.agg(*[F.sum(k).alias(f"all_{k}") for k in "ahn"]))
    got = place.join(cells, F.col("cell") >= F.col("i"), "left").groupBy("tau").agg(*[F.coalesce(F.sum(k), F.lit(0)).alias(k) for k in "ahnc"]).crossJoin(whole)
    p, r = ratio(F.col("c"), F.col("a")), ratio(F.col("c"), F.col("all_a"))
    return got.select(
        "tau", F.col("a").alias("accepted"), F.round(p, 4).alias("precision"), F.round(r, 4).alias("recall"), F.round(f1(p, r), 4).alias("f1"),
        F.round(ratio(F.col("h"), F.col("all_h")), 4).alias("false_match_rate"), F.round(ratio(F.col("n"), F.col("all_n")), 4).alias("noise_match_rate"),
    )


def safe_pick(sweeps: DataFrame, bounds: tuple[float, ...] = (0.005, 0.05)) -> DataFrame:
    """The threshold that accepts no noise and, under the tightest bound of false matches that leaves any, has the highest
    F1, ties to the lower; without any, the highest F1 with the higher threshold, marked unsafe."""
    key = F.struct("f1", -F.col("tau"))
    picks = [F.max_by("tau", F.when((F.col("false_match_rate") <= b) & (F.col("noise_match_rate") == 0), key)).alias(f"b{i}") for i, b in enumerate(bounds)]
    names = [f"b{i}" for i in range(len(bounds))]
    got = sweeps.agg(*picks, F.max_by("tau", F.struct("f1", "tau")).alias("last"))
    return got.select(F.coalesce(*names, "last").alias("tau"), F.coalesce(*names).isNotNull().alias("safe"))


def grid_pick(grid_: DataFrame, most_false: float) -> DataFrame:
    """The rule (low, delta) of the highest recall, then precision, then the larger delta, then the higher low, among
    those whose false_rate is within the bound. grid_: low, delta, accepted, correct, n, false_rate."""
    p, r = F.round(ratio(F.col("correct"), F.col("accepted")), 4), F.round(ratio(F.col("correct"), F.col("n")), 4)
    rows = grid_.filter(F.round("false_rate", 4) <= most_false).withColumns({"precision": p, "recall": r})
    best = F.max_by(F.struct("low", "delta", "precision", "recall"), F.struct("recall", "precision", "delta", "low"))
    return rows.agg(best.alias("b")).select("b.*")


def rule_counts(records: DataFrame, absolutes: tuple[float, ...], lows: tuple[float, ...], deltas: tuple[float, ...], by: tuple[str, ...] = ()) -> DataFrame:
    """(*by, absolute, low, delta, accepted, correct, n): how many records each margin rule accepts, and how many of those are right.

    records: by, s1, margin, ok. A rule accepts from s1 >= absolute on, or where s1 >= low and margin >= delta. Records are counted once,
    by how many thresholds of each kind they reach; running sums over the three axes of these cells give every rule its counts, so
    no row is multiplied by the rules and what the sums run over is as large as the grid.
    """
    axes = {"a": ("s1", sorted(absolutes)), "l": ("s1", sorted(lows)), "d": ("margin", sorted(deltas))}
    reached = {k: sum(((F.coalesce(F.col(c), F.lit(float("-inf"))) >= x).cast("int") for x in xs), F.lit(0)) for k, (c, xs) in axes.items()}
    cells = records.groupBy(*by, *[v.alias(k) for k, v in reached.items()]).agg(F.count("*").alias("m"), F.count_if("ok").alias("h"))
    groups = cells.select(*by).distinct() if by else None
    spark = records.sparkSession
    dense = spark.createDataFrame([(a, l, d) for a in range(len(absolutes) + 1) for l in range(len(lows) + 1) for d in range(len(deltas) + 1)], "a int, l int, d int")  # noqa: E741
    dense = F.broadcast(dense) if groups is None else groups.crossJoin(F.broadcast(dense))
    cells = dense.join(cells, [*by, "a", "l", "d"], "left").na.fill(0, ["m", "h"])
    total = Window.partitionBy(*by) if by else Window.partitionBy(F.lit(0))
    upper = lambda axis, rest: Window.partitionBy(*by, *rest).orderBy(F.desc(axis))
    at_least = cells.groupBy(*by, "a").agg(F.sum("m").alias("m"), F.sum("h").alias("h"))
    above = upper("a", ()).rowsBetween(Window.unboundedPreceding, -1)
    at_least = at_least.select(*by, "a", *[F.coalesce(F.sum(c).over(above), F.lit(0)).alias(f"{c}_abs") for c in "mh"], F.sum("m").over(total).alias("n"))
    for axis, order in (("d", F.desc("d")), ("l", F.desc("l")), ("a", F.asc("a"))):
        w = Window.partitionBy(*by, *[x for x in "ald" if x != axis]).orderBy(order).rowsBetween(Window.unboundedPreceding, -1 if axis != "a" else 0)
        cells = cells.select(*by, "a", "l", "d", *[F.coalesce(F.sum(c).over(w), F.lit(0)).alias(c) for c in "mh"])
    value = lambda xs, i: F.element_at(F.array(*[F.lit(float(x)) for x in sorted(xs)]), i + 1)
    inside = (F.col("a") < len(absolutes)) & (F.col("l") < len(lows)) & (F.col("d") < len(deltas))
    got = cells.filter(inside).join(at_least, [*by, "a"])
    return got.select(
        *by, value(absolutes, F.col("a")).alias("absolute"), value(lows, F.col("l")).alias("low"), value(deltas, F.col("d")).alias("delta"),
        (F.col("m_abs") + F.col("m")).alias("accepted"), (F.col("h_abs") + F.col("h")).alias("correct"), "n",
    )


def two_fold(counts: DataFrame, most_false: float) -> DataFrame:
    """(fold, absolute, low, delta, tuned_recall, accepted, correct, n, precision, recall, false_rate): the rule chosen on one fold and scored on
    the other, for each fold as the scored one. counts: fold, rule, accepted, correct, n, false_accepted; a fold without a rule
    within the bound has no row."""
    p, r = F.round(ratio(F.col("correct"), F.col("accepted")), 4), F.round(ratio(F.col("correct"), F.col("n")), 4)
    rows = counts.withColumns({"precision": p, "recall": r, "false_rate": F.round(ratio(F.col("false_accepted"), F.col("n")), 4)})
    order = F.struct("recall", "precision", "delta", "low", "absolute")
    chosen = rows.filter(F.col("false_rate") <= most_false).groupBy("fold").agg(F.max_by(F.struct("absolute", "low", "delta", F.col("recall").alias("tuned_recall")), order).alias("c"))
    chosen = chosen.select((1 - F.col("fold")).alias("fold"), "c.*")
    return chosen.join(rows, ["fold", "absolute", "low", "delta"]).select(
        "fold", "absolute", "low", "delta", "tuned_recall", "accepted", "correct", "n", "precision", "recall", "false_rate")


def protocol_differences(a: DataFrame, b: DataFrame) -> DataFrame:
    """Parameters of a (name, value) that b lacks or gives another value; two result sets compare only without any."""
    other = b.select(F.col("name").alias("n"), F.col("value").alias("actual"))
    return a.join(other, a["name"] == other["n"], "left").filter(~F.col("value").eqNullSafe(F.col("actual"))).select("name", F.col("value").alias("expected"), "actual")


def end_to_end_summary(rows: DataFrame) -> DataFrame:
    """Risk accuracy by condition, and on known rows how often the risk is right although the recording is not.

    rows: held_out, right, match_type, risk, true_risk."""
    ok, wrong = F.col("risk") == F.col("true_risk"), ~F.col("held_out") & ~F.col("right")
    return rows.groupBy("held_out").agg(
        F.count("*").alias("n"), F.round(F.avg(ok.cast("double")), 6).alias("accuracy"), F.count_if(F.col("match_type") == "UNKNOWN").alias("unknown"),
        F.count_if(wrong).alias("failures"), F.round(F.count_if(wrong & ok) / F.greatest(F.count_if(wrong), F.lit(1)), 4).alias("right_by_luck"),
    )


def tightened(old: Column, new: Column, allow_loosening: bool = False) -> Column:
    return new if allow_loosening else F.greatest(old, new)


def target_pick(sweeps: DataFrame, target: float) -> DataFrame:
    """Threshold of the highest recall with a false-positive rate of at most target, null if there is none."""
    return sweeps.agg(F.max_by("tau", F.when(F.col("fpr") <= target, F.struct("recall", -F.col("tau")))).alias("tau"))


def system_summary(results: DataFrame) -> DataFrame:
    """results: system, accepted, correct, known, latency."""
    ok = F.col("accepted") & F.col("correct")
    n, c = F.count_if("accepted"), F.count_if(ok)
    p, r = ratio(c, n), ratio(c, F.count_if("known"))
    return results.groupBy("system").agg(
        F.count("*").alias("n"), n.alias("accepted"), c.alias("correct"), (n - c).alias("wrong"), (F.count("*") - n).alias("abstained"),
        F.round(p, 6).alias("precision"), F.round(r, 6).alias("recall"), F.round(f1(p, r), 6).alias("f1"), F.round(F.avg("latency"), 4).alias("latency_mean"),
    )


def by_transformation(results: DataFrame, systems: list[str]) -> DataFrame:
    hit = (F.col("accepted") & F.col("correct")).cast("double")
    return results.groupBy("transformation").pivot("system", systems).agg(F.round(F.avg(hit), 6))


def confusion(df: DataFrame) -> DataFrame:
    return df.groupBy("truth", "predicted").agg(F.count("*").alias("n"))


def class_report(counts: DataFrame) -> DataFrame:
    """Precision, recall, F1 and support of each class; classes are those of truth or prediction."""
    t = counts.groupBy(F.col("truth").alias("cls")).agg(F.sum("n").alias("support"), F.sum(F.when(F.col("truth") == F.col("predicted"), F.col("n"))).alias("tp"))
    p = counts.groupBy(F.col("predicted").alias("cls")).agg(F.sum("n").alias("said"))
    z = lambda c: F.coalesce(c, F.lit(0))
    pr, rc = ratio(z("tp"), z("said")), ratio(z("tp"), z("support"))
    return t.join(p, "cls", "full").select(
        "cls", z("support").alias("support"), F.round(pr, 6).alias("precision"), F.round(rc, 6).alias("recall"), F.round(f1(pr, rc), 6).alias("f1")
    )


def overall(counts: DataFrame) -> DataFrame:
    """Accuracy, and macro-F1 over classes that have support."""
    report = class_report(counts).agg(F.round(F.avg(F.when(F.col("support") > 0, F.col("f1"))), 5).alias("macro_f1"))
    acc = counts.agg(F.sum("n").alias("n"), F.round(F.sum(F.when(F.col("truth") == F.col("predicted"), F.col("n")).otherwise(0)) / F.sum("n"), 6).alias("accuracy"))
    return acc.crossJoin(report)


def quantiles(df: DataFrame, key: str, value: str, qs: dict[str, float]) -> DataFrame:
    """(key, *qs): exact quantiles by linear interpolation, nulls left out, without a group that meets in one task.

    Values are counted, then dealt to ranges of (key, value): what comes before a range is a sum over few rows, and the running
    count inside it is the range's own."""
    counts = df.filter(F.col(value).isNotNull()).groupBy(key, value).agg(F.count("*").alias("m"))
    parts = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    # written once, since the ranges are drawn by sampling and read twice
    dealt = store.cut(counts.repartitionByRange(parts, key, value).withColumn("part", F.spark_partition_id()))
    sums = dealt.groupBy(F.col(key).alias("__key"), F.col("part").alias("p")).agg(F.sum("m").alias("own"))
    sums = sums.select("__key", "p", F.coalesce(F.sum("own").over(Window.partitionBy("__key").orderBy("p").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("before"),
                       F.sum("own").over(Window.partitionBy("__key")).alias("all"))
    run = dealt.join(F.broadcast(sums), F.col(key).eqNullSafe(F.col("__key")) & (F.col("part") == F.col("p")))
    last = F.col("before") + F.sum("m").over(Window.partitionBy(key, "part").orderBy(value).rowsBetween(Window.unboundedPreceding, 0))
    run = run.withColumn("last", last)
    out = []
    for name, q in qs.items():
        # places from 0 of the two values that a quantile lies between
        at = F.lit(q) * (F.col("all") - 1)
        holds = lambda place: (F.col("last") - F.col("m") <= place) & (place < F.col("last"))
        low = F.max(F.when(holds(F.floor(at)), F.col(value)))
        high = F.max(F.when(holds(F.ceil(at)), F.col(value)))
        share = F.max(at - F.floor(at))
        out.append(F.when(share == 0, low).otherwise(low * (1 - share) + high * share).alias(name))
    return run.groupBy(key).agg(*out)


def latency(df: DataFrame, key: str, column: str) -> DataFrame:
    """Count, mean, median, 95th percentile and maximum of a column by key."""
    c = F.col(column)
    plain = df.groupBy(key).agg(F.count(c).alias("n"), F.round(F.avg(c), 4).alias("mean"), F.round(F.max(c), 4).alias("max"))
    found = quantiles(df, key, column, {"p50": 0.5, "p95": 0.95}).withColumnRenamed(key, "__key")
    got = plain.join(found, F.col(key).eqNullSafe(F.col("__key")), "left")
    return got.select(key, "n", "mean", F.round("p50", 4).alias("p50"), F.round("p95", 4).alias("p95"), "max")


def same_queries(a: DataFrame, b: DataFrame, key: str) -> bool:
    """Whether two result sets hold the same queries."""
    x, y = a.select(key), b.select(key)
    return x.exceptAll(y).isEmpty() and y.exceptAll(x).isEmpty()


def held_out(exact: DataFrame, near: DataFrame, partner: DataFrame, near_floor: float = 0.10) -> DataFrame:
    """(source, excluded): the exact class, near-duplicates with their exact classes, and all that of the partner.

    exact: (id, cls); near: (id, other, score) of the sources; partner: (id, other), a row a source. A source is
    linked to classes first, and classes are written out for sources only, never against themselves."""
    cls = lambda name: exact.select(F.col("id").alias(name), "cls")
    sources = partner.select(F.col("id").alias("a"))
    close = near.filter(F.col("score") >= near_floor).select(F.col("id").alias("a"), F.col("other").alias("n"))
    held = sources.join(cls("a"), "a").union(close.join(cls("n"), "n").select("a", "cls")).distinct()
    others = partner.select(F.col("id").alias("s"), F.col("other").alias("a")).join(held, "a").select(F.col("s").alias("a"), "cls")
    return held.union(others).distinct().join(cls("b"), "cls").select(F.col("a").alias("source"), F.col("b").alias("excluded"))


def leaks(answers: DataFrame, exclusions: DataFrame) -> DataFrame:
    """Answers inside their own exclusion set; must be empty."""
    return answers.join(exclusions, (answers["query_source"] == exclusions["source"]) & (answers["answer"] == exclusions["excluded"]), "left_semi")


def threshold_mismatches(config: dict[str, float], rules: dict[str, float]) -> list[str]:
    return sorted(k for k in config if k not in rules or abs(config[k] - rules[k]) > 1e-9)


def error_breakdown(df: DataFrame, special: str) -> DataFrame:
    """Wrong accepts and misses by transformation, one transformation counted apart. df: transformation, accepted, correct."""
    group = F.when(F.col("transformation") == special, "special").otherwise("other")
    return df.groupBy(group.alias("kind"), "transformation").agg(
        F.count_if(F.col("accepted") & ~F.col("correct")).alias("wrong"), F.count_if(~F.col("accepted")).alias("missed"), F.count("*").alias("n")
    )


def described(df: DataFrame, key: str, value: str, q: float = 0.95) -> DataFrame:
    """Count, mean, maximum and a percentile of a value by key."""
    return df.groupBy(key).agg(F.count(value).alias("n"), F.round(F.avg(value), 6).alias("mean"), F.max(value).alias("top"), F.round(F.percentile(value, q), 4).alias("p"))


def window_summary(windows: DataFrame, budget: int) -> DataFrame:
    """Windows a query, share stopped early and share that used the whole budget. windows: query_id, n, planned."""
    return windows.agg(
        F.count("*").alias("queries"), F.round(F.avg("n"), 4).alias("mean_windows"), F.round(F.avg((F.col("n") < F.col("planned")).cast("double")), 6).alias("early"),
        F.round(F.avg((F.col("n") >= budget).cast("double")), 6).alias("exhausted"),
    )


def best_relevant(df: DataFrame, value: str) -> DataFrame:
    """The value at the best relevant row of each query, ties to the smaller value."""
    return df.filter("relevant").groupBy("query_id").agg(F.max_by(value, F.struct("score", -F.col(value))).alias(value))
