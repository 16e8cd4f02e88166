"""Report files and the appendable score table."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def write_report(rows: DataFrame, path: str, columns: list[str], order: list[Column]) -> None:
    """CSV with header and a Parquet twin, in order across the part files.

    The sort is a range shuffle and each task writes its own part, so a report
    of any size needs no single writer.
    """
    ordered = rows.select(*columns).orderBy(*order)
    ordered.write.mode("overwrite").option("header", True).option("escape", '"').csv(f"{path}/csv")
    ordered.write.mode("overwrite").parquet(f"{path}/parquet")


def append_scores(scores: DataFrame, path: str, run_date: str) -> None:
    """Add one run's scores under its date."""
    scores.withColumn("run_date", F.lit(run_date)).write.mode("append").partitionBy("run_date").parquet(path)


def read_scores(spark: SparkSession, path: str) -> DataFrame:
    """Scores with one row per photo, the latest run wins."""
    rows = spark.read.parquet(path)
    fields = [c for c in rows.columns if c not in ("photo_id", "run_date")]
    last = F.max(F.struct(F.col("run_date").cast("string").alias("run_date"), *fields)).alias("last")
    return rows.groupBy("photo_id").agg(last).select("photo_id", "last.*")


def unscored(work: DataFrame, path: str) -> DataFrame:
    """Work that no earlier run has scored, for resuming."""
    done = work.sparkSession.read.parquet(path).select("photo_id")
    return work.join(done, "photo_id", "left_anti")
