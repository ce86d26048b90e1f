"""Life of the vector index: build, remap of source ids, load with its checks; decoding of stored labels."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.columns import let

UUID_SHAPE = r"^.{8}-.{4}-.{4}-.{4}-.{12}$"


def parsed(text: Column, width: int) -> tuple[Column, Column]:
    """(vector, fault) of a comma-joined vector: ``bad_dim``, ``bad_values`` or null."""
    parts = F.split(F.coalesce(text, F.lit("")), ",")
    vector = F.transform(parts, lambda x: F.trim(x).try_cast("double"))
    fault = F.when(F.size(parts) != width, "bad_dim").when(F.exists(vector, lambda x: x.isNull()), "bad_values")
    return vector, fault


def unit(vector: Column) -> Column:
    """The vector at length one; a zero vector stays zero."""
    length = lambda v: F.sqrt(F.aggregate(v, F.lit(0.0), lambda a, x: a + x * x))
    return let(vector, lambda v: let(length(v), lambda n: F.when(n > 0, F.transform(v, lambda x: x / n)).otherwise(v)))


def source_map(metadata: DataFrame) -> DataFrame:
    """(source_track_id, target) of the source ids that stand in one row only; ambiguous ones are dropped."""
    one = metadata.groupBy("source_track_id").agg(F.count("*").alias("n"), F.min("recording_id").alias("target"))
    return one.filter("n = 1").select("source_track_id", "target")


def remapped(rows: DataFrame, metadata: DataFrame, width: int) -> DataFrame:
    """rows (recording_id, vector as text, ...) with ``how``: bad_dim, remapped, already_uuid, unmapped or bad_values.

    Ids of the source become recording ids; rows to index are those remapped or already_uuid, with ``vector`` at length one.
    """
    vector, fault = parsed(F.col("vector"), width)
    found = rows.withColumns({"__v": vector, "__fault": fault, "source_track_id": F.trim("recording_id")}).join(source_map(metadata), "source_track_id", "left")
    own = F.col("source_track_id").rlike(UUID_SHAPE)
    how = (
        F.when(F.col("__fault") == "bad_dim", "bad_dim")
        .when(F.col("target").isNull() & ~own, "unmapped")
        .when(F.col("__fault") == "bad_values", "bad_values")
        .when(F.col("target").isNotNull(), "remapped")
        .otherwise("already_uuid")
    )
    kept = F.col("how").isin("remapped", "already_uuid")
    return found.withColumn("how", how).withColumn("recording_id", F.coalesce("target", "source_track_id")).withColumn(
        "vector", F.when(kept, unit(F.col("__v")))
    ).drop("__v", "__fault", "source_track_id", "target")


def from_table(embeddings: DataFrame, version: str, width: int) -> DataFrame:
    """Vectors of one model version and width, parsed and at length one; faulty ones are dropped."""
    vector, fault = parsed(F.col("vector"), width)
    mine = embeddings.filter((F.col("model_version") == version) & (F.col("dimension") == width))
    return mine.withColumns({"__v": vector, "__fault": fault}).filter("__fault is null").withColumn("vector", unit(F.col("__v"))).drop("__v", "__fault")


def loaded(vectors: DataFrame, ids: DataFrame) -> DataFrame:
    """vectors (pos, v) with their ids (pos, recording_id); an error if their numbers differ."""
    n, m = vectors.count(), ids.count()
    if n != m:
        raise ValueError(f"index and id map differ: {n} vectors, {m} ids; build the index again")
    return vectors.join(ids, "pos")


def loaded_or_none(spark, path: str, columns: tuple[str, ...]) -> DataFrame | None:
    """A table that may be missing or lack columns: None then, so that its tier is skipped."""
    from pyspark.errors import AnalysisException

    try:
        df = spark.read.parquet(path)
    except AnalysisException:
        return None
    return df if set(columns) <= set(df.columns) else None


def decoded_label(position: Column, names: tuple[str, ...]) -> Column:
    """The name at a position, null beyond the list."""
    return F.get(F.array(*[F.lit(x) for x in names]), F.when(position >= 0, position).cast("int"))


def required(df: DataFrame, columns: tuple[str, ...]) -> DataFrame:
    missing = sorted(set(columns) - set(df.columns))
    if missing:
        raise ValueError("missing columns: " + ", ".join(missing))
    return df
