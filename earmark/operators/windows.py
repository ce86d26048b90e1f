"""Window planning and choice of the best window."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def cents(x: Column) -> Column:
    """Two digits, halves up, by plain arithmetic."""
    return F.floor(x * 100 + 0.5) / 100


def plan_windows(duration: Column, window: float = 30.0, most: int = 8) -> Column:
    """Starts: 0, evenly spaced, the tail; rounded to 2 digits."""
    n = F.least(F.lit(most), F.greatest(F.lit(2), F.ceil(duration / window).cast("int")))
    tail = duration - window
    spread = F.transform(F.sequence(F.lit(0), n - 1), lambda i: cents(i * tail / (n - 1)))
    return F.when((duration <= window) | F.lit(most <= 1), F.array(F.lit(0.0))).otherwise(spread)


def plan_segments(duration: Column, window: float = 15.0, hop: float = 10.0, most: int = 12) -> Column:
    """(start, end) of feature segments: none below a second, one up to the window, a grid of hops, else evenly spaced."""
    tail = duration - window
    grid = F.floor(tail / hop + 1e-9).cast("int") + 1
    even = F.transform(F.sequence(F.lit(0), F.lit(most - 1)), lambda i: cents(i * tail / (most - 1)))
    hops = F.transform(F.sequence(F.lit(0), grid - 1), lambda i: F.round(i * F.lit(hop), 2))
    starts = F.when(duration <= window, F.array(F.lit(0.0))).when(grid <= most, hops).otherwise(even)
    spans = F.transform(starts, lambda s: F.struct(s.alias("start"), cents(F.least(s + window, duration)).alias("end")))
    return F.when(duration < 1, F.array().cast("array<struct<start:double,end:double>>")).otherwise(spans)


def index_segments(duration: Column, window: float = 15.0, hop: float = 10.0) -> Column:
    """(start, end) of the segments an index is built from: whole windows, or the whole of a file shorter than one."""
    short = F.array(F.struct(F.lit(0.0).alias("start"), duration.cast("double").alias("end")))
    return F.when(duration <= 1, F.array().cast("array<struct<start:double,end:double>>")).when(duration < window, short).otherwise(evaluation_windows(duration, hop, window))


def evaluation_windows(duration: Column, hop: float = 10.0, window: float = 15.0) -> Column:
    """(start, end) of whole windows; a tail shorter than the window is dropped."""
    n = F.floor((duration - window) / hop).cast("int")
    return F.when(duration < window, F.array().cast("array<struct<start:double,end:double>>")).otherwise(
        F.transform(F.sequence(F.lit(0), n), lambda i: F.struct((i * F.lit(hop)).alias("start"), (i * F.lit(hop) + window).alias("end")))
    )


PRIORITY = {"EXACT_MATCH": 3, "COVER_MATCH": 2, "NEAR_MATCH": 1}


def scanned(windows: DataFrame, key: str) -> DataFrame:
    """Windows up to the first exact match of their key; those after it were never scanned."""
    exact = F.min(F.when(F.col("match_type") == "EXACT_MATCH", F.col("window_idx"))).over(Window.partitionBy(key))
    return windows.withColumn("__stop", exact).filter("__stop is null or window_idx <= __stop").drop("__stop")


def best_window(windows: DataFrame, key: str) -> DataFrame:
    """One window a key among those scanned: highest confidence among matches, then kind of match; without any match
    the highest score; the earliest wins ties."""
    seen = scanned(windows, key)
    kind = F.coalesce(*[F.when(F.col("match_type") == k, p) for k, p in PRIORITY.items()], F.lit(0))
    w = Window.partitionBy(key).orderBy(F.desc(kind > 0), F.desc("score"), F.desc(kind), "window_idx")
    ranked = seen.withColumn("__r", F.row_number().over(w)).withColumn("scanned", F.count("*").over(Window.partitionBy(key)))
    return ranked.filter("__r = 1").drop("__r")


def overlap_share(s1: Column, e1: Column, s2: Column, e2: Column) -> Column:
    """Overlap over the shorter of two spans."""
    return F.greatest(F.lit(0.0), F.least(e1, e2) - F.greatest(s1, s2)) / F.least(e1 - s1, e2 - s2)


def overlapping(left: DataFrame, right: DataFrame, share: float = 0.5) -> DataFrame:
    """(source, q, r, share): spans of one source that overlap by at least ``share`` (0.5 or more, at six digits) of the shorter one.

    left: (source, q, s, e), right: (source, r, s, e). An overlap of half of a span holds the span's middle, so the middle of the shorter span
    lies in the longer one: a join of points with spans. Spans of lengths up to 2**c lie in the one or two bins of width 2**c they
    touch; a point looks into its bin of every width in use from its own span's on. Pairs meet in a bin about as wide as the longer of
    them, so a source of any number of spans is dealt over its bins, and the work follows the output. Spans that end
    before they start, or where they start, overlap nothing.
    """
    if share < 0.5:
        raise ValueError("the middle of the shorter span lies in the longer one from a share of 0.5 on")
    slack = 1e-6

    def sized(df: DataFrame, key: str) -> DataFrame:
        d = df.filter("e > s").select("source", F.col(key).alias("id"), F.col("s").cast("double").alias("s"), F.col("e").cast("double").alias("e"))
        return d.withColumn("c", F.ceil(F.log2(F.col("e") - F.col("s"))).cast("int"))

    def bins(x: Column, c: Column) -> Column:
        return F.floor(x / F.pow(F.lit(2.0), c)).cast("long")

    a, b = sized(left, "q"), sized(right, "r")
    widths = a.select("c").union(b.select("c")).agg(F.array_sort(F.collect_set("c")).alias("widths"))  # one row, a value a power of two in use

    def meet(points: DataFrame, spans: DataFrame, shorter) -> DataFrame:
        room = (F.col("e") - F.col("s")) * slack
        filed = spans.select("source", "id", "s", "e", "c", F.explode(F.sequence(bins(F.col("s") - room, F.col("c")), bins(F.col("e") + room, F.col("c")))).alias("bin"))
        asked = points.crossJoin(F.broadcast(widths)).select("source", F.col("id").alias("pid"), F.col("s").alias("ps"), F.col("e").alias("pe"), F.explode(F.filter("widths", lambda w: w >= F.col("c"))).alias("c"))
        middle = (F.col("ps") + F.col("pe")) / 2
        asked = asked.withColumn("middle", middle).withColumn("bin", bins(F.col("middle"), F.col("c")))
        size, other = F.col("pe") - F.col("ps"), F.col("e") - F.col("s")
        inside = (F.col("middle") >= F.col("s") - slack * size) & (F.col("middle") <= F.col("e") + slack * size)
        met = asked.join(filed, ["source", "c", "bin"]).filter(shorter(size, other) & inside)
        return met.select("source", "pid", "id", F.round(overlap_share(F.col("ps"), F.col("pe"), F.col("s"), F.col("e")), 6).alias("share"))

    one = meet(a, b, lambda x, y: x <= y).select("source", F.col("pid").alias("q"), F.col("id").alias("r"), "share")
    two = meet(b, a, lambda x, y: x < y).select("source", F.col("id").alias("q"), F.col("pid").alias("r"), "share")
    return one.unionByName(two).filter(F.col("share") >= share)


#: Where queries are cut, and what transformations do to time and pitch.
CROP_START = 30.0
TEMPO_FACTORS = {"tempo_0_90": 0.90, "tempo_0_95": 0.95, "tempo_1_05": 1.05, "tempo_1_10": 1.10}
PITCH_STEPS = {"pitch_plus_1": 1, "pitch_plus_2": 2, "pitch_minus_1": -1, "pitch_minus_2": -2}


def query_axis(transformation: Column, crop: Column, tempo: Column, pitch: Column) -> tuple[Column, Column, Column]:
    """(crop start, tempo factor, pitch steps) of a query: the manifest's texts where they are numbers (the factor above 0),
    else those of the transformation. A query's time t is start + t * factor in its source."""

    def known(values: dict, default):
        out = F.lit(default)
        for k, v in values.items():
            out = F.when(transformation == k, v).otherwise(out)
        return out

    factor = tempo.try_cast("double")
    return (
        F.coalesce(crop.try_cast("double"), F.lit(CROP_START)),
        F.coalesce(F.when(factor > 0, factor), known(TEMPO_FACTORS, 1.0)),
        F.coalesce(pitch.try_cast("int"), known(PITCH_STEPS, 0)),
    )


def query_spans(base: float, factors: tuple[float, ...]) -> Column:
    return F.array(*[F.struct(F.lit(f).alias("factor"), F.lit(base / f).alias("seconds")) for f in factors])


def collapsed_spans(spans: DataFrame, actual: str) -> DataFrame:
    """Spans of equal actual length become one; its factor is the nearest in seconds, null if over half a second off."""
    off = F.abs(F.col("seconds") - F.col(actual))
    best = spans.groupBy("query_id", actual).agg(F.min_by("factor", off).alias("factor"), F.min(off).alias("off"))
    return best.withColumn("factor", F.when(F.col("off") <= 0.5, F.col("factor"))).drop("off")
