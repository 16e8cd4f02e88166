"""Verdicts that follow new evidence, recomputing only the segments it touches."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fieldproof.operators.coverage import VERDICT_COLUMNS, dedup_entries, judge, verdicts

_BUCKETS = 64
_ENTRY = (
    "segment_id string, cluster_id string, photo_id string, segment_t double, reasons array<string>, compliant boolean,"
    " is_representative boolean, batch_id long, bucket int"
)


def as_own_clusters(uploads: DataFrame) -> DataFrame:
    """Each upload is a cluster of its own, named by its photo id."""
    return uploads.withColumns({"cluster_id": F.col("photo_id"), "is_representative": F.lit(True)})


def with_uploads(base: DataFrame, uploads: DataFrame) -> DataFrame:
    """Base photos plus uploads, missing columns empty."""
    both = base.withColumn("cluster_id", F.col("cluster_id").cast("string"))
    return both.unionByName(as_own_clusters(uploads), allowMissingColumns=True)


def affected_segments(photos: DataFrame) -> DataFrame:
    return photos.filter("coalesce(segment_id, '') <> ''").select("segment_id").distinct()


def recompute(base: DataFrame, segments: DataFrame, entries: DataFrame, affected: DataFrame) -> DataFrame:
    """Base verdicts with the affected segments' rows replaced."""
    fresh = verdicts(
        segments.join(affected, "segment_id", "left_semi"), entries.join(affected, "segment_id", "left_semi")
    )
    return base.select(*VERDICT_COLUMNS).join(affected, "segment_id", "left_anti").unionByName(fresh)


def retract(base: DataFrame, uploads: DataFrame, live_sources: DataFrame, segments: DataFrame, current: DataFrame) -> DataFrame:
    """Verdicts after uploads whose source file is gone are taken back."""
    kept = uploads.join(live_sources.select("source"), "source", "left_semi")
    gone = affected_segments(uploads.join(live_sources.select("source"), "source", "left_anti"))
    entries = dedup_entries(judge(with_uploads(base, kept)))
    return recompute(current, segments, entries, gone)


class VerdictStore:
    """Entries and verdicts on shared storage, one folder per micro-batch.

    Every batch overwrites only its own folders, so a replayed batch leaves the
    same state. Entries are bucketed by segment; a batch reads the buckets of
    its own segments and never the whole history.
    """

    def __init__(self, spark: SparkSession, path: str, segments: DataFrame):
        self.spark, self.path, self.segments = spark, path, segments

    def _write_entries(self, entries: DataFrame, batch_id: int) -> None:
        bucket = F.pmod(F.xxhash64("segment_id"), F.lit(_BUCKETS)).cast("int")
        (entries.withColumn("bucket", bucket).write.mode("overwrite").partitionBy("bucket")
         .parquet(f"{self.path}/entries/batch_id={batch_id}"))

    def _write_verdicts(self, rows: DataFrame, batch_id: int) -> None:
        rows.select(*VERDICT_COLUMNS).write.mode("overwrite").parquet(f"{self.path}/verdicts/batch_id={batch_id}")

    def bootstrap(self, base: DataFrame) -> None:
        """State before any arrival, as batch -1."""
        self._write_entries(dedup_entries(judge(base)), -1)
        self._write_verdicts(verdicts(self.segments, self._entries(-1)), -1)

    def _entries(self, up_to: int, buckets: list[int] | None = None) -> DataFrame:
        rows = self.spark.read.schema(_ENTRY).parquet(f"{self.path}/entries").filter(F.col("batch_id") <= up_to)
        return rows if buckets is None else rows.filter(F.col("bucket").isin(buckets))

    def apply(self, arrivals: DataFrame, batch_id: int) -> None:
        """Fold one micro-batch in."""
        self._write_entries(dedup_entries(judge(as_own_clusters(arrivals))), batch_id)
        own = self.spark.read.schema(_ENTRY).parquet(f"{self.path}/entries").filter(F.col("batch_id") == batch_id)
        buckets = [r.bucket for r in own.select("bucket").distinct().collect()]  # at most _BUCKETS values
        affected = own.select("segment_id").distinct()
        history = self._entries(batch_id, buckets).join(affected, "segment_id", "left_semi")
        entries = dedup_entries(history)
        self._write_verdicts(verdicts(self.segments.join(affected, "segment_id", "left_semi"), entries), batch_id)

    def current(self) -> DataFrame:
        """Latest verdict row per segment."""
        rows = self.spark.read.parquet(f"{self.path}/verdicts")
        fields = [c for c in VERDICT_COLUMNS if c != "segment_id"]
        return rows.groupBy("segment_id").agg(
            F.max(F.struct("batch_id", *fields)).alias("last")
        ).select("segment_id", *[F.col("last")[f].alias(f) for f in fields])

    def follow(self, arrivals: DataFrame, checkpoint: str):
        """Start the stream that keeps the verdicts current, taking what is available."""
        return (
            arrivals.writeStream.option("checkpointLocation", checkpoint)
            .foreachBatch(lambda rows, batch_id: self.apply(rows, batch_id))
            .trigger(availableNow=True).start()
        )
