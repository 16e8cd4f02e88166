"""Uploads and streams: batch and incremental must agree."""

from pyspark.sql import functions as F

from fieldproof.operators import coverage as cov
from fieldproof.operators.mapsets import verdict_transitions as transitions
from fieldproof.plans import tables as t
from fieldproof.plans.catalog import query
from fieldproof.plans.coverage_queries import VERDICT_SQL
from fieldproof.session import scratch_path
from fieldproof.streaming import arrivals, audit_log, incremental


def _merged(spark, sf):
    photos = t.photos(spark, sf)
    return incremental.with_uploads(t.early(photos), t.late(photos))


def _before(spark, sf):
    return cov.coverage(t.early(t.photos(spark, sf)), t.segments(spark, sf))


def _after(spark, sf):
    affected = incremental.affected_segments(t.late(t.photos(spark, sf)))
    entries = cov.dedup_entries(cov.judge(_merged(spark, sf)))
    return incremental.recompute(_before(spark, sf), t.segments(spark, sf), entries, affected)


@query("U1", """SELECT photo_id, CASE WHEN k % 29 = 0 THEN photo_id ELSE cluster_id::VARCHAR END AS cluster_id,
  CASE WHEN k % 29 = 0 THEN true ELSE is_representative END AS is_representative FROM photos""")
def merged_uploads(spark, sf):
    return _merged(spark, sf).select("photo_id", "cluster_id", "is_representative")


@query("I1", f"SELECT {VERDICT_SQL} FROM verdicts_merged")
def incremental_verdicts(spark, sf):
    return _after(spark, sf)


@query("J15", """SELECT b.verdict AS before, a.verdict AS after, count(*) AS segments FROM verdicts_early b JOIN verdicts_merged a USING (segment_id)
WHERE a.verdict <> b.verdict GROUP BY 1, 2""")
def verdict_transitions(spark, sf):
    return transitions(_before(spark, sf), _after(spark, sf), t.late(t.photos(spark, sf)))


@query("U3", f"""SELECT {VERDICT_SQL} FROM verdicts_early""")
def retracted_uploads(spark, sf):
    """Taking back every upload restores the verdicts from before."""
    photos = t.photos(spark, sf)
    uploads = t.late(photos).withColumn("source", F.concat(F.lit("lot"), (F.col("k") % 3).cast("string")))
    live = uploads.select("source").filter("source = 'none'")
    return incremental.retract(t.early(photos), uploads, live, t.segments(spark, sf), _after(spark, sf))


@query("I1, I5", f"SELECT {VERDICT_SQL} FROM verdicts_merged")
def streamed_verdicts(spark, sf):
    """Late photos arrive as files in three micro-batches."""
    path = scratch_path(spark, "verdicts")
    photos = t.photos(spark, sf)
    late = t.late(photos)
    store = incremental.VerdictStore(spark, f"{path}/store", t.segments(spark, sf))
    store.bootstrap(t.early(photos))
    for part in range(3):
        late.filter(F.floor(F.col("k") / t.LIVE_RULE) % 3 == part).write.mode("append").parquet(f"{path}/arrivals")
        stream = spark.readStream.schema(late.schema).parquet(f"{path}/arrivals")
        store.follow(stream, f"{path}/checkpoint").awaitTermination()  # all new files, however many, are one batch
    return store.current()


_UPLOADS = "SELECT 'photo_' || (doc_id // 2) || '.jpg' AS name, n_chars // 1000 AS bytes FROM documents"


def _collect_uploads(spark, sf, path, *runs):
    """Each run finds new parts of the uploads, in any number of files, and takes them as one batch."""
    docs = t.read(spark, sf, "documents").select(
        F.concat(F.lit("photo_"), F.floor(F.col("doc_id") / 2).cast("string"), F.lit(".jpg")).alias("name"),
        F.floor(F.col("n_chars") / 1000).alias("bytes"), (F.col("doc_id") % 3).alias("part"))
    for parts in runs:
        docs.filter(F.col("part").isin(parts)).select("name", "bytes").write.mode("append").parquet(f"{path}/in")
        stream = spark.readStream.schema("name string, bytes long").parquet(f"{path}/in")
        arrivals.collect_arrivals(stream, f"{path}/out", f"{path}/checkpoint").awaitTermination()
    return spark.read.parquet(f"{path}/out")


@query("I2", f"SELECT DISTINCT name, bytes FROM ({_UPLOADS})")
def first_arrivals(spark, sf):
    return _collect_uploads(spark, sf, scratch_path(spark, "uploads"), [0], [1], [2])


@query("I5", f"SELECT DISTINCT name, bytes FROM ({_UPLOADS})")
def resumed_arrivals(spark, sf):
    """The same intake stopped after two parts and started again for the rest."""
    return _collect_uploads(spark, sf, scratch_path(spark, "resumed"), [0, 1], [2])


@query("I4", "SELECT stage, event, count(*) AS n FROM audit_events GROUP BY 1, 2")
def streamed_audit_counts(spark, sf):
    path = scratch_path(spark, "audit")
    log = t.audit_events(spark, sf).select(F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss").alias("ts"), "stage", "event", "photo_id", "event_id")
    for part in range(3):
        log.filter(F.col("event_id") % 3 == part).drop("event_id").coalesce(1).write.mode("append").json(f"{path}/log")
    audit_log.follow_counts(audit_log.watch(spark, f"{path}/log"), f"{path}/counts", f"{path}/checkpoint").awaitTermination()
    return audit_log.current_counts(spark, f"{path}/counts")
