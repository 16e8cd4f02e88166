"""Manifest, duplicates, clusters and pending work."""

from pyspark.sql import functions as F

from fieldproof.operators import components, locate, manifest, similarity
from fieldproof.operators.budget import within_budget as admitted
from fieldproof.plans import tables as t
from fieldproof.plans.catalog import query
from fieldproof.plans.text_queries import FAMILY_SQL


def content_files(spark, sf):
    return manifest.with_content_id(t.files(spark, sf)).drop("content")


def clustered(spark, sf):
    return components.cluster_photos(t.fingerprints(spark, sf))


@query("W6", "SELECT photo_id, filename, rel_path, bytes, mtime FROM manifest")
def first_occurrences(spark, sf):
    return manifest.first_occurrences(content_files(spark, sf))


@query("W6", "SELECT photo_id, 'ingest' AS stage, 'byte_identical_skip' AS event, count(*) - 1 AS copies FROM files GROUP BY 1 HAVING count(*) > 1")
def skipped_copies(spark, sf):
    return manifest.skipped_copies(content_files(spark, sf))


@query("A22", f"""SELECT count(*) AS families, count(*) FILTER (lo = hi) AS recalled, count(*) FILTER (lo = hi)::DOUBLE / count(*) AS recall
FROM (SELECT family, min(cluster_id) AS lo, max(cluster_id) AS hi FROM (
  SELECT {FAMILY_SQL} AS family, bytes % 3 AS cluster_id FROM manifest) GROUP BY 1 HAVING count(*) > 1)""")
def family_recall(spark, sf):
    kept = manifest.first_occurrences(content_files(spark, sf))
    clusters = kept.select("photo_id", (F.col("bytes") % 3).alias("cluster_id"))
    return manifest.family_recall(kept, clusters)


@query("J1", """SELECT q.photo_id, coalesce(m.rel_path, '') AS rel_path FROM (
  SELECT sha1(CASE WHEN doc_id % 4 = 0 THEN text || 'x' ELSE text END) AS photo_id FROM documents) q LEFT JOIN manifest m USING (photo_id)""")
def manifest_paths(spark, sf):
    kept = manifest.first_occurrences(content_files(spark, sf))
    asked = t.read(spark, sf, "documents").select(
        F.sha1(F.when(F.col("doc_id") % 4 == 0, F.concat("text", F.lit("x"))).otherwise(F.col("text"))).alias("photo_id"))
    return manifest.with_path(asked, kept)


@query("J2", """SELECT photo_id, concat_ws('/', segment_id, photo_id) AS rel_path FROM photos
WHERE photo_id IN (SELECT photo_id FROM forensics WHERE is_representative) AND photo_id NOT IN (SELECT photo_id FROM quality)""")
def pending_photos(spark, sf):
    # Paths are spelled out for the pending photos only, as they hold the id once more.
    folders = t.photos(spark, sf).select("photo_id", F.col("segment_id").alias("rel_path"))
    pending = manifest.pending_photos(t.short_ids(folders), t.short_ids(t.forensics(spark, sf)), t.short_ids(t.quality(spark, sf)))
    return pending.select(t.spelled_id("photo_id"), F.concat_ws("/", "rel_path", t.spelled_id("photo_id")).alias("rel_path"))


@query("J3", """SELECT f.photo_id, CASE WHEN o.photo_id IS NULL THEN l.photo_id END AS duplicate_of,
  CASE WHEN o.photo_id IS NULL THEN l.phase ELSE o.phase END AS phase, CASE WHEN o.photo_id IS NULL THEN l.relevance ELSE o.relevance END AS relevance
FROM forensics f LEFT JOIN quality o USING (photo_id)
LEFT JOIN (SELECT cluster_id, q.* FROM forensics JOIN quality q USING (photo_id) WHERE is_representative) l ON l.cluster_id = f.cluster_id
WHERE o.photo_id IS NOT NULL OR l.photo_id IS NOT NULL""")
def effective_quality(spark, sf):
    known = locate.effective_quality(t.short_ids(t.forensics(spark, sf)), t.short_ids(t.quality(spark, sf)))
    return known.select(t.spelled_id("photo_id"), t.spelled_id("duplicate_of"), "phase", "relevance")


@query("J4", """SELECT CASE WHEN c.cluster_id IS NULL THEN r.photo_id ELSE m.photo_id END AS photo_id, r.segment_id, r.segment_t FROM (
  SELECT p.photo_id, p.segment_id, p.segment_t FROM photos p JOIN forensics f USING (photo_id) WHERE f.is_representative) r
LEFT JOIN (SELECT * FROM forensics WHERE cluster_id % 23 <> 0) c USING (photo_id)
LEFT JOIN (SELECT * FROM forensics WHERE cluster_id % 23 <> 0) m ON m.cluster_id = c.cluster_id""")
def inherited_locations(spark, sf):
    located = t.clustered_photos(spark, sf).filter("leads").select("photo_id", "segment_id", "segment_t")
    clusters = t.forensics(spark, sf).filter("cluster_id % 23 <> 0")
    placed = locate.inherit_locations(t.short_ids(located), t.short_ids(clusters))
    return placed.select(t.spelled_id("photo_id"), "segment_id", "segment_t")


@query("J11", """SELECT a_fp, b_fp, distance, (SELECT count(*) FROM fingerprints WHERE phash = a_fp) AS a_photos,
  (SELECT count(*) FROM fingerprints WHERE phash = b_fp) AS b_photos FROM fp_pairs""")
def similar_fingerprints(spark, sf):
    return similarity.similar_pairs(t.fingerprints(spark, sf))


@query("A1", "SELECT photo_id, phash, cluster_id, photo_id = cluster_id AS is_representative FROM clusters")
def photo_clusters(spark, sf):
    return clustered(spark, sf)


@query("A2", "SELECT cluster_id, count(*) AS members, min(photo_id) AS representative FROM clusters GROUP BY 1")
def cluster_sizes(spark, sf):
    return components.cluster_sizes(clustered(spark, sf))


@query("A2", """SELECT cluster_id, count(*) AS members, min(photo_id) AS representative FROM clusters GROUP BY 1 HAVING count(*) > 1
ORDER BY members DESC, cluster_id LIMIT 5""")
def largest_clusters(spark, sf):
    return components.largest_clusters(clustered(spark, sf))


@query("W5", """SELECT photo_id, cost_nano, spent_before FROM (
  SELECT photo_id, cost_nano, coalesce(sum(cost_nano) OVER (ORDER BY photo_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS spent_before
  FROM usage) WHERE spent_before <= (SELECT sum(cost_nano) FROM usage) // 3""")
def within_budget(spark, sf):
    calls = t.priced(t.usage(spark, sf)).select("photo_id", "cost_nano")
    # The cap is one third of the total, so the query has a boundary at every scale.
    cap = calls.agg(F.floor(F.sum("cost_nano") / 3).cast("bigint").alias("cap")).first().cap
    return admitted(calls, cap)
