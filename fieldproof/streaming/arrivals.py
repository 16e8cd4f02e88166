"""Uploads as they arrive: repeats dropped, places found without a geocoder."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fieldproof.functions.geo import utm33
from fieldproof.functions.numbers import exact_round
from fieldproof.functions.text import overlay_coordinates
from fieldproof.operators.locate import GEOMATCH_COLUMNS, snap_photos
from fieldproof.session import cut_lineage


def first_arrivals(uploads: DataFrame, watermark: str | None = None) -> DataFrame:
    """Uploads whose (name, bytes) key was not seen before.

    With ``watermark`` the state is bounded to that delay on ``arrived``;
    without it every key is remembered.
    """
    if watermark:
        return uploads.withWatermark("arrived", watermark).dropDuplicatesWithinWatermark(["name", "bytes"])
    return uploads.dropDuplicates(["name", "bytes"])


def collect_arrivals(uploads: DataFrame, path: str, checkpoint: str):
    """Append first arrivals to Parquet; the file sink and checkpoint make it exactly-once."""
    return (
        first_arrivals(uploads).writeStream.format("parquet").outputMode("append")
        .option("path", path).option("checkpointLocation", checkpoint)
        .trigger(availableNow=True).start()
    )


def locate_arrivals(arrivals: DataFrame, lines: DataFrame, zones: DataFrame, site: DataFrame) -> DataFrame:
    """Location rows of one micro-batch from printed coordinates only.

    The address is not consulted, so the conflict flag is always false, and
    labels are not compared. An arrival without readable coordinates, or without
    a line, comes out with coord_source none.
    """
    parsed = cut_lineage(arrivals.select("photo_id", overlay_coordinates(F.col("overlay_latlon")).alias("_at")))
    east, north = utm33(F.col("_at.lon"), F.col("_at.lat"))
    rows = cut_lineage(snap_photos(parsed.filter("_at IS NOT NULL").withColumns({"px": east, "py": north}), lines, zones, site).select(
        "photo_id", exact_round(F.col("_at.lat"), 7).alias("lat"), exact_round(F.col("_at.lon"), 7).alias("lon"),
        F.lit("overlay_latlon").alias("coord_source"), "segment_id",
        exact_round(F.col("segment_t"), 4).alias("segment_t"),
        exact_round(F.col("snap_distance_m"), 2).alias("snap_distance_m"),
        "fcp_name", "fcp_assignment", F.lit("no_label").alias("label_match"),
        F.lit(False).alias("latlon_vs_address_flag"),
    ).select(*GEOMATCH_COLUMNS))
    given = {"coord_source": F.lit("none"), "label_match": F.lit("no_label"), "latlon_vs_address_flag": F.lit(False)}
    nowhere = parsed.join(rows.select("photo_id"), "photo_id", "left_anti").select(*[
        F.col(c) if c == "photo_id" else given.get(c, F.lit(None).cast(rows.schema[c].dataType)).alias(c) for c in GEOMATCH_COLUMNS])
    return rows.unionByName(nowhere)


def follow_uploads(uploads: DataFrame, store, lines: DataFrame, zones: DataFrame, site: DataFrame, path: str, checkpoint: str):
    """The live chain: scored uploads are located, judged and folded into the verdicts, batch by batch.

    ``uploads`` carries the quality columns with overlay_latlon; ``store`` is a
    VerdictStore. A replayed batch overwrites its own folders and nothing else.
    """
    def apply(rows, batch_id):
        scored = cut_lineage(rows.dropDuplicates(["photo_id"]))
        locate_arrivals(scored, lines, zones, site).write.mode("overwrite").parquet(f"{path}/batch_id={batch_id}")
        located = rows.sparkSession.read.parquet(f"{path}/batch_id={batch_id}")
        store.apply(scored.join(located, "photo_id"), batch_id)

    return (
        uploads.writeStream.option("checkpointLocation", checkpoint).foreachBatch(apply)
        .trigger(availableNow=True).start()
    )


def follow_locations(arrivals: DataFrame, lines: DataFrame, zones: DataFrame, site: DataFrame, path: str, checkpoint: str):
    """Locate each micro-batch against the static geometry; one folder per batch."""
    def apply(rows, batch_id):
        locate_arrivals(rows, lines, zones, site).write.mode("overwrite").parquet(f"{path}/batch_id={batch_id}")

    return (
        arrivals.writeStream.option("checkpointLocation", checkpoint).foreachBatch(apply)
        .trigger(availableNow=True).start()
    )
