"""Running counts over the append-only audit log."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

AUDIT_SCHEMA = "ts timestamp, stage string, event string, photo_id string"


def watch(spark: SparkSession, path: str, files_per_batch: int = 1) -> DataFrame:
    """The audit log as a stream of JSON lines."""
    return spark.readStream.schema(AUDIT_SCHEMA).option("maxFilesPerTrigger", files_per_batch).json(path)


def follow_counts(log: DataFrame, path: str, checkpoint: str):
    """Keep counts per stage and event; each batch stores the rows it changed (I4)."""
    counts = log.groupBy("stage", "event").agg(F.count(F.lit(1)).alias("n"))

    def store(rows, batch_id):
        rows.write.mode("overwrite").parquet(f"{path}/batch_id={batch_id}")

    return (
        counts.writeStream.outputMode("update").option("checkpointLocation", checkpoint)
        .foreachBatch(store).trigger(availableNow=True).start()
    )


def current_counts(spark: SparkSession, path: str) -> DataFrame:
    """Latest count of every stage and event."""
    return spark.read.parquet(path).groupBy("stage", "event").agg(F.max_by("n", "batch_id").alias("n"))
