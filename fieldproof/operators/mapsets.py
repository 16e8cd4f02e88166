"""Point and line sets behind the map, and the effect of an upload batch."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def map_points(geomatch: DataFrame, uploads: DataFrame) -> DataFrame:
    """Displayable points: base photos on the site, and all located uploads."""
    located = geomatch.filter("lat IS NOT NULL AND lon IS NOT NULL")
    ids = uploads.select("photo_id")
    base = located.join(ids, "photo_id", "left_anti").filter("coalesce(fcp_assignment, '') <> 'off_cluster'")
    live = located.join(ids, "photo_id", "left_semi")
    return base.select("photo_id", "lat", "lon", F.lit("base").alias("layer")).unionByName(
        live.select("photo_id", "lat", "lon", F.lit("upload").alias("layer"))
    )


def verdict_map(segments: DataFrame, verdicts: DataFrame) -> DataFrame:
    """Planned lines with verdict, RED where none exists (J14), and their layer."""
    shown = verdicts.select("segment_id", "verdict", "photo_count", F.coalesce("reasons", F.lit("")).alias("reasons"))
    return segments.join(shown, "segment_id", "left").withColumns({
        "verdict": F.coalesce("verdict", F.lit("RED")), "reasons": F.coalesce("reasons", F.lit("")),
        "photo_count": F.coalesce("photo_count", F.lit(0)),
        "layer": F.when(F.coalesce("is_connected_to_home", F.lit(False)), "house").otherwise("trunk"),
    })


def coverage_gaps(segments: DataFrame, verdicts: DataFrame) -> DataFrame:
    """Lines that received no photo at all."""
    return verdict_map(segments, verdicts).filter(F.col("photo_count") == 0)


def verdict_transitions(before: DataFrame, after: DataFrame, affected: DataFrame) -> DataFrame:
    """Changed verdicts of affected segments, counted."""
    return (
        affected.select("segment_id").distinct()
        .join(before.select("segment_id", F.col("verdict").alias("before")), "segment_id", "left")
        .join(after.select("segment_id", F.col("verdict").alias("after")), "segment_id", "left")
        .withColumn("before", F.coalesce("before", F.lit("RED")))
        .withColumn("after", F.coalesce("after", "before"))
        .filter("before <> after")
        .groupBy("before", "after").agg(F.count(F.lit(1)).alias("segments"))
    )
