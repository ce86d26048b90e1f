"""Job life cycle over an event log."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Error codes and their HTTP status.
HTTP_STATUS = {
    "FILE_TOO_LARGE": 413, "UNSUPPORTED_FORMAT": 415, "RATE_LIMITED": 429, "UNAUTHORIZED": 401, "NO_AUDIO": 422, "NO_MUSIC": 422,
    "MODEL_FAILURE": 503, "DATABASE_FAILURE": 503, "TIMEOUT": 504, "UNKNOWN_TRACK": 404, "LOW_CONFIDENCE": 422, "INTERNAL_ERROR": 500,
}
STEPS = {"QUEUED": 0, "PROCESSING": 1, "DONE": 2, "FAILED": 2}


def latest_state(events: DataFrame) -> DataFrame:
    """Status of each job: its last event; a finished job is not reopened."""
    step = F.coalesce(*[F.when(F.col("status") == k, v) for k, v in STEPS.items()], F.lit(-1))
    order = F.struct(F.when(step == 2, 1).otherwise(0), F.col("at"), step, F.col("status"))
    return events.groupBy("job_id").agg(F.max_by("status", order).alias("status"), F.max("at").alias("updated_at"), F.count("*").alias("n_events"))


def insert_absent(log: DataFrame, new: DataFrame) -> DataFrame:
    """New rows whose job has no row yet, one a job."""
    return new.dropDuplicates(["job_id"]).join(log.select("job_id"), "job_id", "left_anti")


def http_status(code: Column) -> Column:
    table = F.create_map(*[F.lit(x) for kv in HTTP_STATUS.items() for x in kv])
    return F.coalesce(table[code], F.lit(500))


def degraded(db_up: Column, index_loaded: Column, rules_ok: Column) -> Column:
    return F.when(db_up & index_loaded & rules_ok, "OK").otherwise("DEGRADED")


def history(rows: DataFrame, most: int = 50, risk: str | None = None) -> DataFrame:
    """Newest first, one row a job, at most ``most`` rows, then filtered by risk."""
    w = Window.partitionBy("job_id").orderBy(F.desc("at"))
    kept = rows.withColumn("__r", F.row_number().over(w)).filter("__r = 1").drop("__r").orderBy(F.desc("at"), "job_id").limit(most)
    return kept if risk is None else kept.filter(F.col("risk") == risk)
