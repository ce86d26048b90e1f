"""Stratified group folds, and one pass over the rows for the models of all folds and strengths at once.

Folds are drawn from per-group class counts: groups that hold the same counts are one row, so the driver sees the distinct count
vectors and never the groups. Fits share their passes: a batch of rows meets the weights of every model in one product,
partial gradients add up by a vector aggregate on the executors, and only the weights of the models, of a size that rows don't
change, travel.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.stat import Summarizer
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def deal(patterns: list[tuple[tuple[int, ...], int]], folds: int) -> list[list[int]]:
    """How many groups of each pattern (class counts, number of groups) each fold gets.

    Patterns come in the order of falling spread of their counts. Each group in turn goes to the fold after which the shares of the
    classes deviate least between folds, on average over classes; then to the smaller fold, then to the first.
    """
    total = np.maximum(sum((np.array(c) * m for c, m in patterns), np.zeros(len(patterns[0][0]))), 1) if patterns else None
    held, out = None, []
    for counts, m in patterns:
        c = np.array(counts, float) / total
        held = np.zeros((folds, len(counts))) if held is None else held
        given = [0] * folds
        for _ in range(m):
            trial = held[None] + np.eye(folds)[:, :, None] * c  # fold that takes it, fold, class
            spread = trial.std(axis=1).mean(axis=1).round(12)
            size = (held * total).sum(1).round(6)
            best = min(range(folds), key=lambda f: (spread[f], size[f], f))
            held[best] += c
            given[best] += 1
        out.append(given)
    return out


def group_folds(rows: DataFrame, group: str, label: str, folds: int) -> DataFrame:
    """(group, fold): no group in two folds, classes as even as they can be dealt greedily. Of groups alike, the smaller ones by name go to the earlier folds."""
    classes = [r[0] for r in rows.select(label).distinct().orderBy(label).collect()]
    per = rows.groupBy(group).agg(F.array(*[F.count_if(F.col(label) == c) for c in classes]).alias("counts"))
    patterns = [(tuple(r["counts"]), r["n"]) for r in per.groupBy("counts").agg(F.count("*").alias("n")).collect()]
    patterns.sort(key=lambda p: (-round(float(np.std(p[0])), 12), p[0]))
    dealt = [(list(c), f, sum(given[: f + 1])) for (c, _), given in zip(patterns, deal(patterns, folds)) for f in range(folds)]
    last = rows.sparkSession.createDataFrame(dealt, "counts array<long>, fold int, last long")
    place = F.row_number().over(Window.partitionBy("counts").orderBy(group))
    placed = per.withColumn("place", place).join(last, "counts").filter(F.col("place") <= F.col("last"))
    return placed.groupBy(group).agg(F.min("fold").alias("fold"))


class Models:
    """Weights of every (fold left out, strength) as one array (models, classes, width + 1)."""

    def __init__(self, folds: int, strengths: tuple[float, ...], classes: int, width: int):
        self.left_out = np.repeat(np.arange(folds), len(strengths))
        self.strength = np.tile(np.array(strengths, float), folds)
        self.classes, self.width = classes, width
        self.weights = np.zeros((len(self.left_out), classes, width + 1))

    def logits(self, x: np.ndarray) -> np.ndarray:
        """(rows, models, classes), by one product."""
        w = self.weights.reshape(-1, self.width + 1)
        return (np.c_[x, np.ones(len(x))] @ w.T).reshape(len(x), len(self.left_out), self.classes)


def _arrays(pdf: pd.DataFrame) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    return np.stack(pdf["x"].to_numpy()).astype(float), pdf["y"].to_numpy(), pdf["fold"].to_numpy()


def gradients(rows: DataFrame, models: Models, weight: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(loss, gradient) of each model over the rows outside its fold, rows weighted by class; one pass."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total = np.zeros((len(models.left_out), models.classes, models.width + 2))
        for pdf in frames:
            x, y, fold = _arrays(pdf)
            z = models.logits(x)
            z -= z.max(2, keepdims=True)
            p = np.exp(z)
            s = p.sum(2)
            w = weight[:, y].T * (fold[:, None] != models.left_out[None, :])
            loss = w * (np.log(s) - np.take_along_axis(z, y[:, None, None], 2)[:, :, 0])
            p /= s[:, :, None]
            p[np.arange(len(y))[:, None], np.arange(p.shape[1])[None, :], y[:, None]] -= 1
            p *= w[:, :, None]
            total[:, :, :-1] += (p.reshape(len(x), -1).T @ np.c_[x, np.ones(len(x))]).reshape(total[:, :, :-1].shape)
            total[:, 0, -1] += loss.sum(0)
        yield pd.DataFrame([(m, k, total[m, k].tolist()) for m in range(total.shape[0]) for k in range(total.shape[1])], columns=["m", "k", "g"])

    parts = rows.select("x", "y", "fold").mapInPandas(run, "m int, k int, g array<double>")
    sums = parts.groupBy("m", "k").agg(vector_to_array(Summarizer.sum(array_to_vector("g"))).alias("g")).collect()
    out = np.zeros((len(models.left_out), models.classes, models.width + 2))
    for r in sums:
        out[r["m"], r["k"]] = r["g"]
    return out[:, :, -1].sum(1), out[:, :, :-1]


def fit(rows: DataFrame, folds: int, strengths: tuple[float, ...], classes: int, width: int, iterations: int = 30) -> Models:
    """Multinomial models with balanced classes of every fold and strength. rows: x array<double>, y int from 0, fold int.

    Steps have the length that the last two gradients suggest, for each model its own; a step that raises a loss by much is halved and taken again.
    """
    models = Models(folds, strengths, classes, width)
    counts = np.zeros((folds, classes))
    for r in rows.groupBy("fold", "y").count().collect():
        counts[r["fold"], r["y"]] = r["count"]
    train = (counts.sum(0)[None] - counts)[models.left_out]
    n = train.sum(1)
    weight = np.where(train > 0, n[:, None] / (np.maximum((train > 0).sum(1), 1)[:, None] * np.maximum(train, 1)), 0.0)
    decay = np.ones(models.weights.shape)
    decay[:, :, -1] = 0

    def at(w):
        models.weights = w
        loss, grad = gradients(rows, models, weight)
        ridge = 1 / (models.strength * n)
        return loss / n + 0.5 * ridge * (w * w * decay).sum((1, 2)), grad / n[:, None, None] + ridge[:, None, None] * w * decay

    w = models.weights
    loss, grad = at(w)
    step = np.ones(len(loss))
    for _ in range(iterations):
        new = w - step[:, None, None] * grad
        new_loss, new_grad = at(new)
        bad = new_loss > loss + 1e-4 * np.abs(loss)
        s, d = new - w, new_grad - grad
        sy = (s * d).sum((1, 2))
        suggested = np.where(sy > 1e-18, (s * s).sum((1, 2)) / np.maximum(sy, 1e-18), step)
        keep = ~bad[:, None, None]
        w, grad, loss = np.where(keep, new, w), np.where(keep, new_grad, grad), np.where(bad, loss, new_loss)
        step = np.where(bad, step / 2, np.clip(suggested, 1e-3, 1e4))
        if np.abs(grad).max() < 1e-5:
            break
    models.weights = w
    return models


def confusion(rows: DataFrame, models: Models) -> DataFrame:
    """(fold, strength, test, y, predicted, n) of every model over all rows, in one pass."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in frames:
            x, y, fold = _arrays(pdf)
            said = models.logits(x).argmax(2)
            rows_, cols = np.indices(said.shape)
            got = pd.DataFrame({"m": cols.ravel(), "test": fold[rows_.ravel()] == models.left_out[cols.ravel()], "y": y[rows_.ravel()], "predicted": said.ravel()})
            yield got.groupby(["m", "test", "y", "predicted"]).size().reset_index(name="n")

    parts = rows.select("x", "y", "fold").mapInPandas(run, "m int, test boolean, y int, predicted int, n long")
    named = rows.sparkSession.createDataFrame([(m, int(f), float(c)) for m, (f, c) in enumerate(zip(models.left_out, models.strength))], "m int, fold int, strength double")
    return parts.groupBy("m", "test", "y", "predicted").agg(F.sum("n").alias("n")).join(F.broadcast(named), "m").select("fold", "strength", "test", "y", "predicted", "n")


def scores(counts: DataFrame, by: tuple[str, ...]) -> DataFrame:
    """(*by, n, accuracy, macro_f1) of confusion counts; a class that is neither true nor said takes no part, one never right counts 0."""
    total = counts.groupBy(*by).agg(F.sum("n").alias("n"), (F.sum(F.when(F.col("y") == F.col("predicted"), F.col("n")).otherwise(0)) / F.sum("n")).alias("accuracy"))
    sides = counts.select(*by, F.explode(F.array(
        F.struct(F.col("y").alias("cls"), F.col("n").alias("true"), F.lit(0).cast("long").alias("said"), F.when(F.col("y") == F.col("predicted"), F.col("n")).otherwise(0).alias("hit")),
        F.struct(F.col("predicted").alias("cls"), F.lit(0).cast("long").alias("true"), F.col("n").alias("said"), F.lit(0).cast("long").alias("hit")))).alias("s"))
    per = sides.groupBy(*by, "s.cls").agg(F.sum("s.true").alias("true"), F.sum("s.said").alias("said"), F.sum("s.hit").alias("hit"))
    f1 = per.groupBy(*by).agg(F.avg(2 * F.col("hit") / (F.col("true") + F.col("said"))).alias("macro_f1"))
    return total.join(f1, list(by)).select(*by, "n", F.round("accuracy", 4).alias("accuracy"), F.round("macro_f1", 4).alias("macro_f1"))


def protocols(rows: DataFrame, group: str, folds: int, strengths: tuple[float, ...], classes: int, width: int, iterations: int = 30) -> DataFrame:
    """(protocol, strength, test, n, accuracy, macro_f1): A folds by row, B by group, C the commonest class always.

    rows: id, x, y and the group. The gap between A and B is what knowing the group is worth.
    """
    by_row = rows.withColumn("fold", F.pmod(F.xxhash64("id"), F.lit(folds)).cast("int"))
    by_group = rows.join(group_folds(rows, group, "y", folds), group)
    out = None
    for name, dealt in (("A_by_row", by_row), ("B_by_group", by_group)):
        got = scores(confusion(dealt, fit(dealt, folds, strengths, classes, width, iterations)), ("strength", "test"))
        got = got.select(F.lit(name).alias("protocol"), "strength", "test", "n", "accuracy", "macro_f1")
        out = got if out is None else out.unionByName(got)
    most = rows.groupBy("y").count()
    first = most.agg(F.max_by("y", F.struct("count", -F.col("y"))).alias("predicted"))
    base = scores(most.crossJoin(first).select("y", "predicted", F.col("count").alias("n"), F.lit(True).alias("test")), ("test",))
    return out.unionByName(base.select(F.lit("C_commonest").alias("protocol"), F.lit(None).cast("double").alias("strength"), "test", "n", "accuracy", "macro_f1"))
