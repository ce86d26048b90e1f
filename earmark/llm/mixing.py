"""Mixing overlapping sources to target weights by min-cost flow.

A text may stand under several sources. Documents are aggregated by membership pattern,
the set of sources their text stands under, and within a pattern by the source they are
rows of. Token capacity flows from a pattern through these cells to source quotas. What
a pattern gives costs more the more often its texts repeat, under whichever source:
nothing a token for the first time through, 1 for the second, 2 up to four times, 3 up
to eight, and so on. So a text that several sources hold is used in the one that
needs it, and repeats come where first uses run out. A cell gives at most ``repeats`` times its size. The flow is solved on the
aggregate in the driver by shortest augmenting paths, all paths of one cost at once; the
number of cells is checked against ``most_patterns``, and where no text stands under
two sources the flow is a target for each source, however many there are. A cell's flow
is whole repetitions of all its documents plus a remainder, which goes to its documents
in seeded hash order; the one document at the edge is taken in part.

The remainder's edge is found without sorting a source: sizes are summed by hash
bucket, running sums over at most 4096 buckets a cell find the edge bucket, and
only that bucket's documents are ordered. A hot source thus never meets in one task.

Null texts have size 0 and take nothing; a null source is one more source, last in
order; very long texts have their whole size; repeated rows are separate documents and
share the text's pattern; ties of the hash order go to the smaller id, then size; an
empty table gives no rows; columns other than those named are not read.
"""

from __future__ import annotations

from collections import deque

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import WORD_SEP, cut, words_of

BUCKET_HEX = 3


def fill(caps: list[float], weights: list[float], total: float) -> list[float]:
    """Shares of total by weight; what exceeds a cap is shared again among the others."""
    target = [0.0] * len(caps)
    open_, left = set(range(len(caps))), float(total)
    while open_:
        w = sum(weights[i] for i in open_)
        over = {i for i in open_ if left * weights[i] / w > caps[i]}
        if not over:
            for i in open_:
                target[i] = left * weights[i] / w
            break
        for i in over:
            target[i] = float(caps[i])
        left -= sum(caps[i] for i in over)
        open_ -= over
    return target


def levels(units: int, most: int) -> list[tuple[int, int]]:
    """(tokens, cost) of the first time through ``units`` tokens, the second, the third and fourth, and so on, up to ``most``."""
    out, done, cost = [], 0, 0
    while done < most:
        upto = min(most, max(units, 1) << cost)
        out.append((upto - done, cost))
        done, cost = upto, cost + 1
    return out


def flow(patterns: list[tuple[int, dict[int, int]]], quotas: list[int], repeats: int) -> list[dict[int, int]]:
    """Tokens each pattern gives each source at least cost; patterns: (tokens of its different texts, tokens of its cells by source).

    Primal-dual: distances by cost, then all augmenting paths of that cost at once.
    """
    n_p, n_s = len(patterns), len(quotas)
    source, sink = n_p + n_s, n_p + n_s + 1
    graph: list[list[int]] = [[] for _ in range(sink + 1)]
    to, room, cost = [], [], []

    def arc(a: int, b: int, cap: int, c: int) -> int:
        for x, y, r, d in ((a, b, cap, c), (b, a, 0, -c)):
            graph[x].append(len(to))
            to.append(y)
            room.append(r)
            cost.append(d)
        return len(to) - 2

    cells: list[dict[int, int]] = []
    for p, (units, members) in enumerate(patterns):
        for tokens, c in levels(units, repeats * sum(members.values())):
            arc(source, p, tokens, c)
        cells.append({s: arc(p, n_p + s, repeats * n, 0) for s, n in sorted(members.items())})
    for s, quota in enumerate(quotas):
        arc(n_p + s, sink, quota, 0)
    far = float("inf")
    while True:
        best = [far] * (sink + 1)
        best[source], queue, waits = 0, deque([source]), {source}
        while queue:
            x = queue.popleft()
            waits.discard(x)
            for e in graph[x]:
                if room[e] and best[x] + cost[e] < best[to[e]]:
                    best[to[e]] = best[x] + cost[e]
                    if to[e] not in waits:
                        waits.add(to[e])
                        queue.append(to[e])
        if best[sink] == far:
            break
        # on arcs of shortest paths, push until none is left; arcs once found useless stay so within the phase
        at, path, on = [0] * (sink + 1), [], {source}
        x = source
        while True:
            if x == sink:
                push = min(room[e] for e in path)
                for e in path:
                    room[e] -= push
                    room[e ^ 1] += push
                first = next(i for i, e in enumerate(path) if not room[e])
                for e in path[first:]:
                    on.discard(to[e])
                x = to[path[first] ^ 1]
                del path[first:]
                continue
            while at[x] < len(graph[x]):
                e = graph[x][at[x]]
                if room[e] and best[to[e]] == best[x] + cost[e] and to[e] not in on:
                    break
                at[x] += 1
            if at[x] < len(graph[x]):
                e = graph[x][at[x]]
                path.append(e)
                x = to[e]
                on.add(x)
            elif x == source:
                break
            else:
                on.discard(x)
                x = to[path.pop() ^ 1]
                at[x] += 1
    return [{s: room[e ^ 1] for s, e in mine.items()} for mine in cells]


def mix(
    docs: DataFrame,
    size: Column,
    source: Column,
    *,
    text: Column | None = None,
    carry: tuple[str, ...] = ("doc_id", "source"),
    names: tuple[str, str] = ("size", "taken"),
    weights: tuple[int, ...] = (1, 2, 3),
    repeats: int = 3,
    seed: str = "mix",
    most_patterns: int = 20_000,
) -> tuple[DataFrame, DataFrame]:
    """(the carried columns, size and taken, under ``names``, for each row; source, source_size and target for each source).

    source: what a row counts for. text: rows whose texts are equal share a pattern, the set of their sources; without
    it each row's pattern is its source. Sources weigh ``weights`` in turn, by code point, null last, and share 100 %
    of all sizes.
    """
    spark = docs.sparkSession
    key = F.md5(F.concat_ws(":", F.lit(seed), F.coalesce(F.col("doc_id").cast("string"), F.lit("null"))))
    named = lambda c: F.to_json(F.struct(c.alias("s")), {"ignoreNullFields": "false"})
    fp = F.lit(None).cast("binary") if text is None else F.unhex(F.md5(F.trim(F.regexp_replace(F.coalesce(text, F.lit("")), WORD_SEP, " "))))
    rows = docs.select(
        F.struct(*[F.col(f"`{c}`") for c in carry]).alias("__row"), size.cast("long").alias("__size"), F.coalesce("doc_id", F.lit(-1)).alias("__id"),
        source.alias("__source"), named(source).alias("__own"), key.alias("__key"), fp.alias("__fp"),
    )
    if text is None:
        rows = cut(rows.withColumns({"__pattern": F.col("__own"), "__unit": F.col("__size").cast("double")}).drop("__fp"))
    else:
        rows = cut(rows)
        several = rows.filter("__size > 0").groupBy("__fp").agg(F.array_sort(F.collect_set("__own")).alias("__m"), F.count("*").alias("__n"))
        several = several.filter("__n > 1").select(F.col("__fp").alias("__fp2"), F.array_join("__m", ",").alias("__m"), "__n")
        joined = rows.join(several, rows["__fp"] == several["__fp2"], "left")
        unit = F.col("__size") / F.coalesce("__n", F.lit(1))
        rows = cut(joined.withColumns({"__pattern": F.coalesce("__m", "__own"), "__unit": unit}).drop("__fp", "__fp2", "__m", "__n"))
    bucket = F.substring("__key", 1, BUCKET_HEX)
    cell = ["__pattern", "__own"]
    sums = cut(rows.groupBy(*cell, "__source", bucket.alias("__bucket")).agg(F.sum("__size").alias("__tokens"), F.sum("__unit").alias("__units")))
    told = sums.groupBy(*cell, "__source").agg(F.sum("__tokens").alias("n"), F.sum("__units").alias("u"))
    if text is not None:
        told = told.limit(most_patterns + 1)
    told = told.collect()
    if text is not None and len(told) > most_patterns:
        raise ValueError(f"more than {most_patterns} patterns and sources")
    told.sort(key=lambda r: (r["__pattern"], r["__own"]))
    sources = sorted({r["__source"] for r in told}, key=lambda s: (s is None, s or ""))
    place = {s: i for i, s in enumerate(sources)}
    sizes = [0] * len(sources)
    patterns: dict[str, tuple[float, dict[int, int]]] = {}
    for r in told:
        i = place[r["__source"]]
        sizes[i] += r["n"]
        units, members = patterns.get(r["__pattern"], (0.0, {}))
        patterns[r["__pattern"]] = (units + r["u"], {**members, i: r["n"]})
    heavy = [weights[i % len(weights)] for i in range(len(sources))]
    target = fill([float(repeats * x) for x in sizes], heavy, sum(sizes))
    quotas = [int(t + 0.5) for t in target]
    if all(len(m) == 1 for _, m in patterns.values()) and len(patterns) == len(sources):
        given = [{i: min(quotas[i], repeats * n) for i, n in m.items()} for _, m in patterns.values()]
    else:
        given = flow([(int(u + 0.5), m) for u, m in patterns.values()], quotas, repeats)
    give = {(k, i): g for k, mine in zip(patterns, given) for i, g in mine.items()}
    plan = [
        (r["__pattern"], r["__own"], *(divmod(give[r["__pattern"], place[r["__source"]]], r["n"]) if r["n"] else (0, 0))) for r in told
    ]
    plan_df = spark.createDataFrame(plan, "__pattern string, __own string, __copies long, __rest long")
    w = Window.partitionBy(*cell).orderBy("__bucket").rowsBetween(Window.unboundedPreceding, -1)
    edges = (
        sums.withColumn("__before", F.coalesce(F.sum("__tokens").over(w), F.lit(0)))
        .join(plan_df, cell)
        .filter((F.col("__before") < F.col("__rest")) & (F.col("__before") + F.col("__tokens") >= F.col("__rest")))
        .groupBy(*cell, "__copies", "__rest").agg(F.min("__bucket").alias("__edge"), F.min_by("__before", "__bucket").alias("__before"))
    )
    # a row a cell; no edge where nothing is left over
    whole = cut(plan_df.join(edges.drop("__copies", "__rest"), cell, "left"))
    rows = rows.withColumn("__bucket", bucket).join(F.broadcast(whole) if len(plan) <= most_patterns else whole, cell)
    inside = F.col("__bucket") == F.col("__edge")
    plain = rows.filter(~F.coalesce(inside, F.lit(False))).withColumn(
        "__more", F.when(F.col("__bucket") < F.col("__edge"), F.col("__size")).otherwise(F.lit(0))
    )
    w = Window.partitionBy(*cell).orderBy("__key", "__id", "__size").rowsBetween(Window.unboundedPreceding, -1)
    before = F.col("__before") + F.coalesce(F.sum("__size").over(w), F.lit(0))
    edged = rows.filter(inside).withColumn("__more", F.least(F.col("__size"), F.greatest(F.col("__rest") - before, F.lit(0))))
    taken = (F.col("__copies") * F.col("__size") + F.col("__more")).cast("long").alias(names[1])
    out = plain.unionByName(edged).select("__row.*", F.col("__size").alias(names[0]), taken)
    facts = spark.createDataFrame(
        [(s, int(x), round(t, 6)) for s, x, t in zip(sources, sizes, target)], "source string, source_size long, target double"
    )
    return out, facts


def query(docs: DataFrame) -> DataFrame:
    rows, facts = mix(docs, F.size(words_of(F.col("text"))), F.col("source"), text=F.col("text"))
    facts = facts.withColumnRenamed("source", "__source")
    return rows.join(facts, rows["source"].eqNullSafe(facts["__source"])).select("doc_id", "size", "source_size", "target", "taken")
