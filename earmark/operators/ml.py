"""Advisory license classifier: grouped cross-validation, complexity sweep, top classes."""

from __future__ import annotations

from pyspark.ml.classification import LogisticRegression, LogisticRegressionModel
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sources.adapters import bucket


def prepared(df: DataFrame, features: str, label: str, group: str, folds: int = 5) -> DataFrame:
    """vec, y, the fold of the group (so that no group is in two folds) and a random fold for comparison."""
    return df.select(
        array_to_vector(F.transform(features, lambda x: x.cast("double"))).alias("vec"), F.col(label).cast("double").alias("y"),
        bucket(F.col(group), "fold", folds).alias("by_group"), F.pmod(F.xxhash64(features), F.lit(folds)).cast("int").alias("by_row"),
    )


def cross_validated(rows: DataFrame, fold: str, strengths: tuple[float, ...], folds: int = 5, iterations: int = 20) -> DataFrame:
    """(strength, fold, train and test accuracy); strength is the inverse of the regularisation."""
    rows = rows.persist()
    out = []
    for c in strengths:
        for k in range(folds):
            train, test = rows.filter(F.col(fold) != k), rows.filter(F.col(fold) == k)
            model = LogisticRegression(featuresCol="vec", labelCol="y", regParam=1.0 / c, maxIter=iterations, tol=1e-4).fit(train)
            acc = lambda d: d.agg(F.avg((F.col("prediction") == F.col("y")).cast("double"))).first()[0]
            out.append((c, k, acc(model.transform(train)), acc(model.transform(test))))
    rows.unpersist()
    return rows.sparkSession.createDataFrame(out, "strength double, fold int, train double, test double")


def complexity(cv: DataFrame) -> DataFrame:
    """Bias, variance gap and total error of each strength; the pick is the least error, then the least strength; edge marks a pick at the grid's end."""
    per = cv.groupBy("strength").agg((1 - F.avg("train")).alias("bias"), (F.avg("train") - F.avg("test")).alias("gap"), (1 - F.avg("test")).alias("error"))
    best = per.agg(F.min_by("strength", F.struct("error", "strength")).alias("pick"), F.min("strength").alias("lo"), F.max("strength").alias("hi"))
    return per.crossJoin(F.broadcast(best)).select(
        "strength", F.round("bias", 4).alias("bias"), F.round("gap", 4).alias("gap"), F.round("error", 4).alias("error"),
        (F.col("strength") == F.col("pick")).alias("picked"), ((F.col("pick") == F.col("lo")) | (F.col("pick") == F.col("hi"))).alias("edge"),
    )


def majority(rows: DataFrame) -> DataFrame:
    counts = rows.groupBy("y").count()
    return counts.agg((F.max("count") / F.sum("count")).alias("majority"))


def top_classes(model: LogisticRegressionModel, rows: DataFrame, n: int = 3) -> DataFrame:
    """The n likeliest classes with their probabilities, best first."""
    p = F.transform(vector_to_array("probability"), lambda x, i: F.struct((-F.round(x, 4)).alias("k"), i.alias("cls")))
    best = F.transform(F.slice(F.array_sort(p), 1, n), lambda s: F.struct(s["cls"].alias("cls"), (-s["k"]).alias("probability")))
    return model.transform(rows).withColumn("top", best)
