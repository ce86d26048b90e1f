"""Weakly supervised quality rules.

Each rule votes good (1), bad (-1) or abstains (0). Expectation-maximisation over
the counts of vote patterns estimates how often every rule votes each way on good
and on bad texts; a document is kept when its posterior probability of being good
reaches a bound. No labels are read.

Main path: one scan of the texts with built-in functions writes a narrow feature
table; a partial aggregate counts vote patterns (at most 3^7 rows, whatever the
input); the EM runs on those counts in the driver; the posterior is a column
expression. Null texts have no words and fail the base test; very long texts are read
whole; a rule that ties between good and bad abstains, and a posterior equal to the
bound keeps the row; empty tables give no rows; repeated rows are judged alike, each on
its own; other columns are not read (``keep`` hands them on).
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import BLANKS, WORD_SEP, cut, let

SYMBOLS = "#*$%&|<>"
#: Words of nothing but these are bare marks.
MARKS = SYMBOLS + "!?.,;:-_=+/\\~^'\"()[]{}@`"

#: Low bits of a window's sort key that hold its place; a text of more words than
#: this many bits can number is refused by Spark's own limit on array cells first.
POS_BITS = 27


def _count_chars(text: Column, chars: str) -> Column:
    return (F.length(text) - F.length(F.translate(text, chars, ""))).cast("long")


def _repeat_words(words: Column) -> Column:
    """Words that stand in a three-word window found twice or more."""

    def covered(found: Column) -> Column:
        spread = F.transform(
            found,
            lambda p, i: F.when(i == 0, F.lit(3)).otherwise(F.least(F.lit(3), p - F.get(found, i - 1))),
        )
        return F.aggregate(spread, F.lit(0).cast("long"), lambda a, x: a + x)

    def positions(marked: Column) -> Column:
        twice = F.filter(
            marked,
            lambda m, i: m["w"].eqNullSafe(F.get(marked, i - 1)["w"]) | m["w"].eqNullSafe(F.get(marked, i + 1)["w"]),
        )
        return let(F.sort_array(F.transform(twice, lambda m: m["p"])), covered)

    def exact(ws: Column, sorted_keys: Column) -> Column:
        # Equal hash bits only propose windows; their words decide.
        near = F.filter(
            sorted_keys,
            lambda x, i: (F.shiftright(x, POS_BITS) == F.shiftright(F.get(sorted_keys, i - 1), POS_BITS))
            | (F.shiftright(x, POS_BITS) == F.shiftright(F.get(sorted_keys, i + 1), POS_BITS)),
        )
        at = F.transform(near, lambda x: x.bitwiseAND(F.lit((1 << POS_BITS) - 1)).cast("int"))
        named = F.transform(
            at,
            lambda p: F.struct(
                F.concat_ws(" ", F.get(ws, p), F.get(ws, p + 1), F.get(ws, p + 2)).alias("w"), p.alias("p")
            ),
        )
        return let(F.sort_array(named), positions)

    def windows(ws: Column) -> Column:
        keys = F.transform(
            F.slice(ws, 1, F.size(ws) - 2),
            lambda w, i: F.shiftleft(F.xxhash64(w, F.get(ws, i + 1), F.get(ws, i + 2)), POS_BITS) + i,
        )
        return let(F.sort_array(keys), lambda k: exact(ws, k))

    return F.when(F.size(words) < 4, F.lit(0).cast("long")).otherwise(let(words, windows))


def features(docs: DataFrame, carry: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """The carried columns as ``__row`` and the counts the rules look at, from one scan of the texts."""
    text = F.coalesce(F.col("text"), F.lit(""))
    words = F.filter(F.split(F.col("__t"), WORD_SEP), lambda w: w != "")
    lines = F.filter(F.split(F.col("__t"), "\n"), lambda line: F.length(F.translate(line, BLANKS, "")) > 0)
    mine = docs.select(F.struct(*[F.col(f"`{c}`") for c in carry]).alias("__row"), text.alias("__t"))
    return mine.select("__row", "__t", words.alias("__w"), lines.alias("__l")).select(
        "__row",
        F.size("__w").cast("long").alias("n_words"),
        F.length(F.translate("__t", BLANKS, "")).cast("long").alias("word_chars"),
        _count_chars(F.col("__t"), SYMBOLS).alias("n_symbols"),
        (F.size("__l") - F.size(F.array_distinct("__l"))).cast("long").alias("n_dup_lines"),
        _repeat_words(F.col("__w")).alias("n_repeat_words"),
        F.size("__l").cast("long").alias("n_lines"),
        _count_chars(F.col("__t"), "ABCDEFGHIJKLMNOPQRSTUVWXYZ").alias("n_upper"),
        _count_chars(F.col("__t"), "!").alias("n_bangs"),
        F.size(F.filter("__w", lambda w: (F.length(w) < 4) & (F.translate(w, MARKS, "") == ""))).cast("long").alias("n_bare"),
        F.size(F.filter("__w", lambda w: F.length(w) <= 3)).cast("long").alias("n_short"),
    )


def _vote(bad: Column, good: Column) -> Column:
    return F.when(bad, F.lit(-1)).when(good, F.lit(1)).otherwise(F.lit(0))


def rules() -> dict[str, Column]:
    """Votes of each rule; the limits are fractions of words or characters."""
    c = F.col
    n, chars = F.greatest(c("n_words"), F.lit(1)), F.greatest(c("word_chars"), F.lit(1))
    never = F.lit(False)
    return {
        "symbols": _vote(c("n_symbols") * 10 > n, never),
        "capitals": _vote(c("n_upper") * 3 > chars, never),
        "bangs": _vote(c("n_bangs") * 10 > n, never),
        "bare_marks": _vote(c("n_bare") * 10 > n, never),
        "word_length": _vote((chars > 12 * n) | (chars < 2 * n), (chars >= 3 * n) & (chars <= 9 * n)),
        "short_words": _vote(c("n_short") * 16 < n, c("n_short") * 7 >= n),
        "repeats": _vote(
            (c("n_repeat_words") * 4 > n) | (c("n_dup_lines") * 3 > c("n_lines")),
            (c("n_repeat_words") * 12 <= n) & (c("n_dup_lines") * 10 <= c("n_lines")),
        ),
    }


def fit(patterns: list[tuple[tuple[int, ...], int]], rounds: int = 60, hold: float = 0.02) -> tuple[float, list[dict[int, tuple[float, float]]]]:
    """EM for one hidden class and conditionally independent rules.

    patterns: vote vectors and their counts. Returns the prior of good and, by
    rule, for each vote its probability on good and on bad texts. The start holds
    rules to be better than chance and stays as a prior worth ``hold`` of the rows,
    which fixes which class is called good.
    """
    k = len(patterns[0][0]) if patterns else 0
    start = {1: (0.6, 0.35), 0: (0.395, 0.35), -1: (0.005, 0.3)}
    prior, table = 0.85, [start] * k
    held = hold * sum(n for _, n in patterns)
    for _ in range(rounds):
        sums = [{v: [1e-3 + held * p for p in start[v]] for v in start} for _ in range(k)]
        good = bad = 1.0
        for votes, n in patterns:
            odds = math.log(prior) - math.log1p(-prior)
            odds += sum(math.log(table[j][v][0]) - math.log(table[j][v][1]) for j, v in enumerate(votes))
            p = 1 / (1 + math.exp(-max(-500.0, min(500.0, odds))))
            good, bad = good + n * p, bad + n * (1 - p)
            for j, v in enumerate(votes):
                sums[j][v][0] += n * p
                sums[j][v][1] += n * (1 - p)
        prior = min(max(good / (good + bad), 1e-3), 1 - 1e-3)
        table = []
        for s in sums:
            g, b = sum(x[0] for x in s.values()), sum(x[1] for x in s.values())
            table.append({v: (x[0] / g, x[1] / b) for v, x in s.items()})
    return prior, table


def judge(
    docs: DataFrame, *, carry: tuple[str, ...] = ("doc_id",), least_words: int = 50, most_repeat_percent: int = 50, bound: float = 0.5
) -> DataFrame:
    """``__row`` (the carried columns), features, base_failed, posterior quality and kept for each row."""
    names = list(rules())
    voted = cut(features(docs, carry).select("*", *[v.alias(f"vote_{k}") for k, v in rules().items()]))
    votes = [f"vote_{k}" for k in names]
    counted = voted.groupBy(*votes).count().collect()  # 3^7 rows at most
    patterns = sorted((tuple(r[v] for v in votes), r["count"]) for r in counted)
    prior, table = fit(patterns)
    odds = F.lit(math.log(prior) - math.log1p(-prior))
    for v, probs in zip(votes, table):
        w = {x: math.log(g) - math.log(b) for x, (g, b) in probs.items()}
        odds = odds + F.when(F.col(v) == 1, F.lit(w[1])).when(F.col(v) == -1, F.lit(w[-1])).otherwise(F.lit(w[0]))
    failed = (F.col("n_words") < least_words) | (F.col("n_repeat_words") * 100 > F.col("n_words") * most_repeat_percent)
    return voted.select(
        *[c for c in voted.columns],
        failed.alias("base_failed"),
        (1 / (1 + F.exp(-odds))).alias("quality"),
    ).withColumn("kept", ~F.col("base_failed") & (F.col("quality") >= bound))


def query(docs: DataFrame) -> DataFrame:
    return judge(docs).select(
        "__row.doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "quality"
    )


def keep(docs: DataFrame, **how) -> DataFrame:
    """The rows of docs that are kept, with their columns; how: limits of ``judge``."""
    return judge(docs, carry=tuple(docs.columns), **how).filter("kept").select("__row.*")
