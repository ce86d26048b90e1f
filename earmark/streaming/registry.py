"""The registry as a stream; admission and the registry that learns are in ``ordered``."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..operators import registry


class RegistryTable:
    """Registry state as versioned Parquet: a batch writes the next version, and a batch that is run again changes nothing."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")

    def _versions(self) -> list[int]:
        jvm = self.spark.sparkContext._jvm
        root = jvm.org.apache.hadoop.fs.Path(self.path)
        fs = root.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration())
        if not fs.exists(root):
            return []
        names = [s.getPath().getName() for s in fs.listStatus(root)]
        done = [n for n in names if n.startswith("v=") and fs.exists(jvm.org.apache.hadoop.fs.Path(root, f"{n}/_SUCCESS"))]
        return sorted(int(n[2:]) for n in done)

    def read(self) -> DataFrame:
        v = self._versions()
        if not v:
            return self.spark.createDataFrame([], registry.STATE)
        return self.spark.read.schema(registry.STATE).parquet(f"{self.path}/v={v[-1]}")

    def fold(self, batch: DataFrame, batch_id: int) -> None:
        done = self._versions()
        if done and batch_id <= done[-1]:
            return
        state = registry.upsert(self.read(), batch).select(*[f.name for f in self.read().schema.fields])
        state.write.mode("overwrite").parquet(f"{self.path}/v={batch_id}")
        self._forget(keep=2)

    def _forget(self, keep: int) -> None:
        """Delete versions before the last ``keep``, which no reader of the current one needs."""
        jvm = self.spark.sparkContext._jvm
        for v in self._versions()[:-keep]:
            p = jvm.org.apache.hadoop.fs.Path(f"{self.path}/v={v}")
            p.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)


def fold_sightings(stream: DataFrame, table: RegistryTable, checkpoint: str) -> StreamingQuery:
    """Keyed sightings into the registry, one writer, everything available then stop."""
    return (
        stream.writeStream.foreachBatch(table.fold).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    )


def daily(stream: DataFrame, offset_minutes: int = 0, late: str = "1 day") -> DataFrame:
    """Sightings per local day with a watermark for late ones."""
    local = F.col("seen_at") + F.make_interval(mins=F.lit(offset_minutes))
    return stream.withColumn("local", local).withWatermark("local", late).groupBy(F.window("local", "1 day")).agg(F.count("*").alias("n"))
