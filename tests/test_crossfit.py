"""Folds and joint fits against single groups and single models."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from earmark.operators import crossfit


def brute_deal(groups, folds):
    """groups: {name: counts}; one at a time, in the order of falling spread, counts, name."""
    total = np.maximum(sum(np.array(c) for c in groups.values()), 1)
    held = [np.zeros(len(total)) for _ in range(folds)]
    sizes = [0] * folds
    tally = {}
    for name, c in sorted(groups.items(), key=lambda g: (-round(float(np.std(g[1])), 12), tuple(g[1]), g[0])):
        def cost(f, c=c):
            shares = np.array([(h + (np.array(c) if i == f else 0)) / total for i, h in enumerate(held)])
            return round(float(shares.std(0).mean()), 12), sizes[f], f
        f = min(range(folds), key=cost)
        held[f] = held[f] + np.array(c)
        sizes[f] += sum(c)
        tally.setdefault(tuple(c), []).append(f)
    return {c: np.bincount(fs, minlength=folds).tolist() for c, fs in tally.items()}


@pytest.fixture(scope="module")
def rows(spark):
    r = random.Random(6)
    rng = np.random.default_rng(6)
    centres = rng.normal(size=(3, 6))
    out = []
    for i in range(900):
        y = r.choice([0, 0, 0, 1, 1, 2])
        out.append((i, (centres[y] + rng.normal(size=6) * 1.5).tolist(), y, f"g{r.randrange(120) if y else r.randrange(40)}"))
    return spark.createDataFrame(out, "id long, x array<double>, y int, artist string").cache()


def test_group_folds(rows):
    folds = crossfit.group_folds(rows, "artist", "y", 4).cache()
    assert folds.count() == rows.select("artist").distinct().count() == folds.select("artist").distinct().count()
    counts = {r.artist: [r.a, r.b, r.c] for r in rows.groupBy("artist").agg(*[F.count_if(F.col("y") == k).alias(n) for k, n in enumerate("abc")]).collect()}
    got = {}
    for r in folds.collect():
        got.setdefault(tuple(counts[r.artist]), [0] * 4)[r.fold] += 1
    assert got == brute_deal(counts, 4)
    shares = np.array([[r.a, r.b, r.c] for r in rows.join(folds, "artist").groupBy("fold").agg(*[F.count_if(F.col("y") == k).alias(n) for k, n in enumerate("abc")]).collect()], float)
    assert (abs(shares / shares.sum(0) - 0.25) < 0.03).all()


def single(x, y, classes, strength, weight):
    """Newton steps of one weighted multinomial model."""
    n, k = len(y), classes
    a = np.c_[x, np.ones(n)]
    d = a.shape[1]
    w = np.zeros((k, d))
    ridge = np.tile(np.r_[np.ones(d - 1), 1e-9], k) / strength
    for _ in range(40):
        z = a @ w.T
        p = np.exp(z - z.max(1, keepdims=True))
        p /= p.sum(1, keepdims=True)
        g = ((p - np.eye(k)[y]) * weight[y][:, None]).T @ a
        h = np.zeros((k * d, k * d))
        for i in range(k):
            for j in range(k):
                q = weight[y] * p[:, i] * ((i == j) - p[:, j])
                h[i * d : i * d + d, j * d : j * d + d] = (a * q[:, None]).T @ a
        w = w - np.linalg.solve(h + np.diag(ridge) + 1e-9 * np.eye(k * d), g.ravel() + ridge * w.ravel()).reshape(k, d)
    return w


def test_joint_fits_equal_single_ones(rows):
    dealt = rows.withColumn("fold", F.pmod("id", F.lit(3)).cast("int"))
    models = crossfit.fit(dealt, 3, (0.05, 1.0), 3, 6, iterations=120)
    data = dealt.toPandas()
    x, y, fold = np.stack(data["x"]), data["y"].to_numpy(), data["fold"].to_numpy()
    for m, (f, c) in enumerate(zip(models.left_out, models.strength)):
        t = fold != f
        weight = t.sum() / (3 * np.bincount(y[t], minlength=3))
        want = single(x[t], y[t], 3, c, weight)
        p = lambda w: np.c_[x, np.ones(len(x))] @ (w - w.mean(0)).T
        assert np.abs(p(models.weights[m]) - p(want)).max() < 0.02


def test_scores(spark, rows):
    counts = spark.createDataFrame([(0, 0, 5), (0, 1, 2), (1, 1, 3), (2, 0, 1)], "y int, predicted int, n long").withColumn("k", F.lit(1))
    r = crossfit.scores(counts, ("k",)).first()
    f = [2 * 5 / (7 + 6), 2 * 3 / (3 + 5), 0.0]
    assert (r.n, r.accuracy, r.macro_f1) == (11, round(8 / 11, 4), round(sum(f) / 3, 4))


def test_protocols(rows):
    got = {(r.protocol, r.test): r for r in crossfit.protocols(rows, "artist", 3, (1.0,), 3, 6, 15).collect()}
    base = got["C_commonest", True]
    assert got["A_by_row", True].n == got["B_by_group", True].n == base.n == 900 and got["B_by_group", False].n == 1800
    assert got["B_by_group", True].macro_f1 > base.macro_f1 + 0.2 and abs(got["A_by_row", True].accuracy - got["B_by_group", True].accuracy) < 0.1
