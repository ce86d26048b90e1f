"""Bucketed tables in the shared folder: written once for a set of rows, read without a shuffle after."""

from __future__ import annotations

import atexit
import hashlib
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_own: dict[str, str] = {}


def shared_folder(spark: SparkSession) -> str:
    """The folder ``spark.checkpoint.dir`` names; one of our own only in local mode, deleted when the driver ends."""
    app = spark.sparkContext.applicationId
    if app not in _own:
        named = spark.conf.get("spark.checkpoint.dir", None)
        if not named and not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        root = named.rstrip("/") if named else "file://" + tempfile.mkdtemp(prefix="earmark-store-")
        _own[app] = f"{root}/earmark-store-{app}"
        jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()

        def remove() -> None:
            try:
                path = jvm.org.apache.hadoop.fs.Path(_own[app] if named else root)
                path.getFileSystem(conf).delete(path, True)
            except Exception:  # the session or the store has gone
                pass

        atexit.register(remove)
    return _own[app]


def bucketed(spark: SparkSession, name: str, signature: str, build, key: str, buckets: int, sort: tuple[str, ...] = ()) -> DataFrame:
    """The table ``name`` of the rows ``signature`` tells apart, bucketed and sorted by key; build() makes it where it is new.

    Each bucket is one file, since rows are dealt by the same hash before they are written.
    """
    table = f"{name}_{hashlib.md5(f'{spark.sparkContext.applicationId}:{signature}:{buckets}'.encode()).hexdigest()[:16]}"
    if not spark.catalog.tableExists(table):
        rows = build().repartition(buckets, key)
        rows.write.mode("overwrite").bucketBy(buckets, key).sortBy(key, *sort).option("path", f"{shared_folder(spark)}/{table}").format("parquet").saveAsTable(table)
    return spark.table(table)


def cut(df: DataFrame) -> DataFrame:
    """df written to the shared folder and read again, where several steps read it; it goes when the driver ends."""
    path = f"{shared_folder(df.sparkSession)}/{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
