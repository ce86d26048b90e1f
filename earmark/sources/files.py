"""CSV and Parquet sources and guarded sinks."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..schemas import conform, schema


def read_csv(spark: SparkSession, path: str, name: str) -> DataFrame:
    """A master file by its header: text columns, conformed to the table; bad casts give null."""
    return conform(spark.read.csv(path, header=True, multiLine=True, escape='"'), name)


def read_typed_csv(spark: SparkSession, path: str, fields: T.StructType) -> DataFrame:
    return spark.read.schema(fields.add("_corrupt_record", "string")).csv(path, header=True, mode="PERMISSIVE", columnNameOfCorruptRecord="_corrupt_record")


def load_table(spark: SparkSession, source: str, target: str, name: str) -> int:
    """Replace a table by a CSV file; the file is read and counted before the old table is touched."""
    return publish(read_csv(spark, source, name), target)


def publish(df: DataFrame, target: str) -> int:
    """Replace a table by df, which may read it: write beside it, count, then swap by renaming.

    A failure before the swap leaves the old table; one between its two renames leaves it under ``.old``.
    """
    spark, path = df.sparkSession, target.rstrip("/")
    staged, old = f"{path}.staged", f"{path}.old"
    df.write.mode("overwrite").parquet(staged)
    n = spark.read.schema(df.schema).parquet(staged).count()
    jvm = spark.sparkContext._jvm
    place = lambda p: jvm.org.apache.hadoop.fs.Path(p)
    fs = place(path).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    fs.delete(place(old), True)
    if fs.exists(place(path)) and not fs.rename(place(path), place(old)):
        raise OSError(f"cannot move {path}")
    if not fs.rename(place(staged), place(path)):
        raise OSError(f"cannot move {staged}")
    fs.delete(place(old), True)
    return n


def write_new(df: DataFrame, path: str, force: bool = False) -> None:
    df.write.mode("overwrite" if force else "errorifexists").parquet(path)


def replace_checked(old: DataFrame, new: DataFrame, expected_changes: int, path: str) -> None:
    """Publish new only if it has as many rows as old and exactly the expected number of differing rows."""
    if old.count() != new.count():
        raise ValueError("row counts differ")
    changed = old.exceptAll(new).count()
    if changed != expected_changes:
        raise ValueError(f"{changed} rows differ, {expected_changes} expected")
    publish(new, path)


def copy_common(source: DataFrame, target_columns: list[str]) -> DataFrame:
    """The columns both sides have, in the target's order."""
    return source.select(*[c for c in target_columns if c in source.columns])


def replace_by_key(old: DataFrame, new: DataFrame, key: str) -> DataFrame:
    """Rows of old whose key is not in new, and all of new."""
    return old.join(new.select(key).distinct(), key, "left_anti").unionByName(new, allowMissingColumns=True)


def replace_partition(df: DataFrame, path: str, column: str) -> None:
    """Overwrite only the partitions of ``column`` that df holds."""
    df.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(column).parquet(path)


def save_result(metrics: DataFrame, path: str, experiment: str, parameters: dict[str, str]) -> None:
    """Metrics as JSON lines with provenance columns."""
    note = F.create_map(*[F.lit(x) for kv in sorted(parameters.items()) for x in kv]) if parameters else F.lit(None)
    metrics.withColumn("experiment", F.lit(experiment)).withColumn("parameters", note).withColumn(
        "spark_version", F.lit(metrics.sparkSession.version)
    ).write.mode("overwrite").json(path)


class Checkpoint:
    """Finished keys of a long run; work under another signature is not seen."""

    def __init__(self, spark: SparkSession, root: str, signature: str, fields: str):
        self.spark, self.path, self.fields = spark, f"{root.rstrip('/')}/signature={signature}", fields

    def done(self) -> DataFrame:
        try:
            return self.spark.read.schema(self.fields).parquet(self.path)
        except Exception as e:  # nothing has been written yet
            if "PATH_NOT_FOUND" not in str(e):
                raise
            return self.spark.createDataFrame([], self.fields)

    def todo(self, work: DataFrame, key: str) -> DataFrame:
        return work.join(self.done().select(key), key, "left_anti")

    def add(self, results: DataFrame) -> None:
        results.write.mode("append").parquet(self.path)


TRACK_TABLES = ("compositions", "recordings", "fingerprints", "rights")


def track_rows(track: DataFrame) -> dict[str, DataFrame]:
    """Rows of the four tables for tracks that each bring title, artist, year, duration, path, fingerprint and license.

    Ids come from the path, so a track that is added again gets the same ones.
    """
    id_ = lambda kind: F.concat(F.lit(f"{kind}-"), F.md5(F.concat(F.lit(f"{kind}:"), F.col("path"))))
    t = track.withColumns({k: id_(k) for k in ("composition", "recording", "right", "fp")}).withColumn("at", F.localtimestamp())
    same = {"source": F.lit("manual"), "verified_at": F.col("at")}
    rows = {
        "compositions": {"composition_id": F.col("composition"), "title": F.col("title"), "composer": F.col("artist"), "year": F.col("year"), "public_domain_status": F.lit("no"), **same},
        "recordings": {
            "recording_id": F.col("recording"), "composition_id": F.col("composition"), "title": F.col("title"), "artist": F.col("artist"), "release_year": F.col("year"),
            "duration": F.col("duration"), "source_dataset": F.lit("manual"), "source_track_id": F.col("path"), "audio_path": F.col("path"), "metadata_verified": F.lit(True),
        },
        "fingerprints": {"fingerprint_id": F.col("fp"), "recording_id": F.col("recording"), "algorithm": F.lit("chromaprint"), "fingerprint": F.col("fingerprint"), "duration": F.col("duration"), "created_at": F.col("at")},
        "rights": {"rights_id": F.col("right"), "recording_id": F.col("recording"), "composition_id": F.col("composition"), "license_type": F.col("license"), "copyright_status": F.lit("PROTECTED"), **same},
    }
    return {k: conform(t.select(*[c.alias(n) for n, c in cols.items()]), k) for k, cols in rows.items()}


def add_tracks(track: DataFrame, root: str) -> None:
    """Append tracks to the four tables under ``root``, parents first; a failure between leaves parents without children,
    which the integrity checks report and which adding the track again completes."""
    spark = track.sparkSession
    for name, rows in track_rows(track).items():
        path, key = f"{root.rstrip('/')}/{name}", rows.columns[0]
        try:
            rows = rows.join(spark.read.parquet(path).select(key), key, "left_anti")
        except Exception as e:  # the table is new
            if "PATH_NOT_FOUND" not in str(e):
                raise
        rows.write.mode("append").parquet(path)
