"""File formats: tables written out and read back through the readers."""

import io
import json
import os
import re
import zipfile

import pandas as pd
from pyspark.sql import functions as F

from fieldproof.operators.reports import deficiencies
from fieldproof.plans import tables as t
from fieldproof.plans.catalog import query, scaled, scaled_sql
from fieldproof.plans.coverage_queries import VERDICT_SQL, verdict_rows
from fieldproof.operators.coverage import VERDICT_COLUMNS
from fieldproof.session import cut_lineage, scratch_path
from fieldproof.sources import archives, features, files, sinks


def _write_documents(docs, path):
    """One file per row, a thousand to a folder, named by document and row."""
    rows = docs.select("doc_id", "value", F.monotonically_increasing_id().alias("row"))
    folder = re.sub(r"^file:(//)?(?=/)", "", path)
    if not folder.startswith("/"):  # no mount: Spark's writer makes a folder for each document
        docs.write.partitionBy("doc_id").text(path)
        return

    def write(part):
        for r in part:
            lot = os.path.join(folder, str(r.row // 1000))
            os.makedirs(lot, exist_ok=True)
            with open(os.path.join(lot, f"{r.doc_id}-{r.row}.txt"), "wb") as out:
                out.write(r.value.encode() + b"\n")

    os.makedirs(folder, exist_ok=True)
    rows.foreachPartition(write)


@query("S1", """SELECT doc_id, strlen(coalesce(text, ''))::BIGINT + 1 AS bytes, sha1(coalesce(text, '') || chr(10)) AS content_sha1 FROM documents""")
def photo_file_scan(spark, sf):
    """Every document written as a file of its own, then found by suffix and read."""
    path = scratch_path(spark, "files")
    _write_documents(t.read(spark, sf, "documents").select("doc_id", F.coalesce("text", F.lit("")).alias("value")), path)
    found = files.scan_files(spark, path, ["TXT"])
    name = F.regexp_extract("rel_path", r"(?:doc_id=-?\d+/[^/]+|-?\d+-\d+\.txt)$", 0)
    doc_id = F.regexp_extract(name, r"(-?\d+)", 1).try_cast("long")
    with files.packed_by_size(spark):
        return cut_lineage(found.select(doc_id.alias("doc_id"), "bytes", F.sha1("content").alias("content_sha1")))


def _feature(key):
    """One line feature as JSON text, under either identifier spelling."""
    return F.to_json(F.struct(
        F.lit("Feature").alias("type"),
        F.struct(F.col("segment_id").alias(key), F.col("fcp_name").alias("fcpName"),
                 F.col("duct_main_short").alias("ductMainShort"), F.col("is_connected_to_home").alias("isConnectedToHome")).alias("properties"),
        F.struct(F.lit("LineString").alias("type"), F.array(
            F.array("x0", "y0"), F.array(F.col("x0") + F.col("length_m"), F.col("y0"))).alias("coordinates")).alias("geometry")))


def _collections(spark, sf):
    """Collections of up to 200 line features, one JSON text each."""
    lot = F.floor(F.col("line_order") / 200)
    text = F.when(lot % 2 == 0, _feature("externalID")).otherwise(_feature("globalID"))
    return (
        t.segments(spark, sf).select(lot.alias("lot"), "line_order", text.alias("feature"))
        .groupBy("lot").agg(F.sort_array(F.collect_list(F.struct("line_order", "feature"))).alias("fs"))
        .select("lot", F.concat(
            F.lit('{"type": "FeatureCollection", "features": ['),
            F.array_join(F.transform("fs", lambda f: f["feature"]), ","), F.lit("]}")).alias("value"))
    )


@query("S2", """SELECT segment_id, fcp_name, duct_main_short, coalesce(is_connected_to_home, false) AS home, (line_order % 200)::INT AS feature_no,
  x0 AS x1, y0 AS y1, x0 + length_m AS x2 FROM segments""")
def feature_scan(spark, sf):
    path = scratch_path(spark, "features")
    _collections(spark, sf).select("value").write.text(path)
    rows = features.lines(features.read_features(spark, path, one_per_line=True))
    return rows.select(
        "segment_id", "fcp_name", "duct_main_short", F.coalesce("is_connected_to_home", F.lit(False)).alias("home"), "feature_no",
        F.col("coords")[0][0].alias("x1"), F.col("coords")[0][1].alias("y1"), F.col("coords")[1][0].alias("x2"))


@query("S3", "SELECT event_id, user_id, event_type FROM events WHERE event_id % 17 <> 0 AND event_id % 19 <> 0")
def json_rows(spark, sf):
    """Event rows with blank and broken lines mixed in."""
    path = scratch_path(spark, "rows")
    good = F.to_json(F.struct("event_id", "user_id", "event_type"))
    line = F.when(F.col("event_id") % 17 == 0, "").when(F.col("event_id") % 19 == 0, F.substring(good, 1, 20)).otherwise(good)
    t.read(spark, sf, "events").select(line.alias("value")).write.text(path)
    schema = spark.createDataFrame([], "event_id long, user_id long, event_type string").schema
    return files.read_json_rows(spark, path, schema)


@query("S4", """SELECT segment_id, CASE WHEN line_order % 5 = 0 THEN NULL ELSE length_m END AS length_m,
  CASE WHEN line_order % 3 = 0 THEN 0 ELSE line_order END AS photo_count, CASE WHEN line_order % 4 = 0 THEN '' ELSE 'a; "b", c' END AS reasons,
  line_order % 2 = 0 AS flagged FROM segments""")
def typed_csv(spark, sf):
    path = scratch_path(spark, "cells")
    n = F.col("line_order")
    t.segments(spark, sf).select(
        "segment_id", F.when(n % 5 == 0, "n/a").otherwise(F.col("length_m").cast("string")).alias("length_m"),
        F.when(n % 3 == 0, "").otherwise(n.cast("string")).alias("photo_count"),
        F.when(n % 4 == 0, "").otherwise('a; "b", c').alias("reasons"),
        F.when(n % 2 == 0, "True").when(n % 3 == 0, "").otherwise("no").alias("flagged"),
    ).write.options(header=True, escape='"').csv(path)
    rows = files.read_text_csv(spark, path, ["segment_id", "length_m", "photo_count", "reasons", "flagged"])
    return rows.select("segment_id", files.number_or_null("length_m").alias("length_m"), files.count_or_zero("photo_count").alias("photo_count"),
                       "reasons", files.flag("flagged").alias("flagged"))


@query("S4", f"SELECT {VERDICT_SQL} FROM verdicts")
def verdict_file_roundtrip(spark, sf):
    path = scratch_path(spark, "verdicts")
    verdict_rows(spark, sf).select(VERDICT_COLUMNS).write.options(header=True, escape='"').csv(path)
    return files.read_verdicts(spark, path, VERDICT_COLUMNS)


def _zip(members) -> bytes:
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as archive:
        for name, data in members:
            archive.writestr(name, data)
    return out.getvalue()


def _packed(frame, make):
    """Archives of at most 50 rows each, built per bounded group."""
    return frame.groupBy("lot").applyInPandas(make, "archive string, content binary")


@query("S5", """SELECT 'lot' || (doc_id // 50) || '.zip' AS archive, 'lot' || (doc_id // 50) || '.zip/IMG-' || doc_id || '.JPG' AS member, strlen(text)::BIGINT AS bytes, sha1(text) AS photo_id, '' AS error
FROM documents WHERE doc_id // 50 % 4 <> 3 UNION ALL
SELECT DISTINCT 'lot' || (doc_id // 50) || '.zip', 'lot' || (doc_id // 50) || '.zip', 9::BIGINT, NULL, 'corrupt archive: BadZipFile' FROM documents WHERE doc_id // 50 % 4 = 3""")
def archive_members(spark, sf):
    """Documents packed fifty to a zip next to files that must be ignored; every fourth zip is damaged."""

    def make(rows):
        lot = int(rows["lot"].iloc[0])
        members = [(f"a/IMG-{d}.JPG", text) for d, text in zip(rows["doc_id"], rows["text"])]
        ignored = [("__MACOSX/a/x.jpg", "x"), ("a/._y.jpg", "x"), ("Thumbs.db", "x"), ("notes.txt", "x")]
        content = b"not a zip" if lot % 4 == 3 else _zip(members + ignored)
        return pd.DataFrame({"archive": [f"lot{lot}.zip"], "content": [content]})

    docs = t.read(spark, sf, "documents").select(F.floor(F.col("doc_id") / 50).alias("lot"), "doc_id", "text")
    found = archives.expand_archives(_packed(docs, make))
    return found.select("archive", "member", "bytes", F.sha1("content").alias("photo_id"), F.coalesce("error", F.lit("")).alias("error"))


_LOTS = "SELECT line_order // 50 AS lot, count(*) AS n, min(x0) AS x1, max(x0 + length_m) AS x2, min(y0) AS y1, max(y0) AS y2 FROM segments GROUP BY 1"


@query("S6", f"""SELECT archive, lot_id, tag, synthesised, {scaled_sql('x1', 4)} AS west, {scaled_sql('x2', 4)} AS east FROM (
  SELECT CASE WHEN lot % 3 = 0 THEN 'CLP' || (10000 + lot % 1000) || 'A-P1-B00 lot' || lot || '.zip' ELSE 'lot' || lot || '.zip' END AS archive,
    CASE lot % 3 WHEN 0 THEN 'CLP' || (10000 + lot % 1000) || 'A-P1-B00' WHEN 1 THEN 'CLP20000-P2' ELSE 'uploaded-lot' END AS lot_id, tag,
    tag = 'cluster' OR lot % 2 = 1 AS synthesised,
    CASE WHEN tag = 'cluster' OR lot % 2 = 1 THEN x1 - 0.0005::DOUBLE ELSE -5::DOUBLE END AS x1,
    CASE WHEN tag = 'cluster' OR lot % 2 = 1 THEN x2 + 0.0005::DOUBLE ELSE 5::DOUBLE END AS x2
  FROM ({_LOTS}), (VALUES ('fcps'), ('cluster')) v(tag))""")
def lot_bundles(spark, sf):
    """Line collections packed as bundles, with the zone file present in every second one."""

    def make(rows):
        lot = int(rows["lot"].iloc[0])
        lines = json.dumps({"features": [
            {"properties": {"externalID": s}, "geometry": {"type": "LineString", "coordinates": [[a, y], [b, y]]}}
            for s, a, b, y in zip(rows["segment_id"], rows["x0"], rows["xe"], rows["y0"])]})
        zone = json.dumps({"features": [{"properties": {"kmlDescriptionSimple": "F012 [81]"}, "geometry": {
            "type": "Polygon", "coordinates": [[[-5, -5], [5, -5], [5, 5], [-5, -5]]]}}]})
        prefix = "CLP20000-P2_" if lot % 3 == 1 else ""
        members = [(f"{prefix}Trenches.geojson", lines), ("second_Trenches.geojson", "{}"), ("IMG-1.jpg", "x")]
        if lot % 5 == 0:  # the line file inside its own zip
            members[0] = (f"{prefix}Trenches_geojson.zip", _zip([(f"{prefix}Trenches.geojson", lines)]))
        if lot % 2 == 0:
            members.append(("FCP_Polygons.geojson", zone))
        name = f"CLP{10000 + lot % 1000}A-P1-B00 lot{lot}.zip" if lot % 3 == 0 else f"lot{lot}.zip"
        return pd.DataFrame({"archive": [name], "content": [_zip(members)]})

    lots = t.segments(spark, sf).select(
        F.floor(F.col("line_order") / 50).alias("lot"), "segment_id", "x0", "y0", (F.col("x0") + F.col("length_m")).alias("xe"))
    parts = archives.open_bundles(_packed(lots, make))
    rings = archives.bundle_polygons(parts).withColumn("xs", F.transform(F.flatten("rings"), lambda c: c[0]))
    return rings.join(archives.lot_ids(parts), "archive").select(
        "archive", "lot_id", "tag", "synthesised", scaled(F.array_min("xs"), 4).alias("west"), scaled(F.array_max("xs"), 4).alias("east"))


@query("S7", f"SELECT {VERDICT_SQL} FROM verdicts WHERE verdict <> 'GREEN'")
def report_files(spark, sf):
    path = scratch_path(spark, "report")
    order = [F.col("fcp_name"), F.desc("length_m"), F.col("segment_id")]
    sinks.write_report(deficiencies(verdict_rows(spark, sf)), path, VERDICT_COLUMNS, order)
    return files.read_verdicts(spark, f"{path}/csv", VERDICT_COLUMNS)


@query("S8", "SELECT photo_id, cost_nano, CASE WHEN k % 2 = 0 THEN '2026-01-01' ELSE '2026-01-02' END AS run_date FROM photos")
def appended_scores(spark, sf):
    """Two runs over the same work list; the second skips what the first has done."""
    path = scratch_path(spark, "scores")
    work = t.photos(spark, sf).select("photo_id", "cost_nano", "k")
    sinks.append_scores(work.filter("k % 2 = 0").drop("k"), path, "2026-01-01")
    sinks.append_scores(sinks.unscored(work.drop("k"), path), path, "2026-01-02")
    return sinks.read_scores(spark, path).select("photo_id", "cost_nano", "run_date")
