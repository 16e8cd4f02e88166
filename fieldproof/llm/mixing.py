"""Systematic sampling of sources to target weights.

A source's documents share one rate, target / source size. Within a source they
stand in the order of size class, a hash bucket and doc_id; a document at rank r
covers (rate * (r - 1), rate * r], one offset per source is added, and it is
emitted once per whole number in its interval. Classes of like size in turn keep
the taken words near the target.

Defined cases: null text has size 0; null source is a source of its own, last in
order; sources of size 0 get target 0; repeated rows are documents of their own
(ties in doc_id have no order, so they are exchangeable); a null doc_id takes
part; an empty table gives no rows; extra columns are kept by ``sample`` and
not read by ``plan``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from fieldproof.llm.common import WORD, whole_text
from fieldproof.session import cut_lineage

#: Weights dealt to the sources in order, again from the first after the last.
WEIGHTS = (5, 2, 1)
#: A target is at most so many times the size of its source.
MOST_COPIES = 3
SEED = "mix"


_SOURCE = ["no_source", "source_key"]


def targets(sizes: DataFrame) -> DataFrame:
    """no_source, source_key, source_size, target from one row per source.

    With caps sorted by cap / weight, the capped sources are the first ones, up
    to where the rest's share by weight no longer reaches the cap: what sharing
    the excess again and again ends in. The windows hold one row per source.
    """
    weight = F.get(F.array(*[F.lit(w).cast("long") for w in WEIGHTS]), ((F.col("place") - 1) % len(WEIGHTS)).cast("int"))
    everything = Window.partitionBy().rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    ranked = (
        sizes.withColumn("place", F.row_number().over(Window.orderBy(*_SOURCE))).withColumn("weight", weight)
        .withColumn("cap", F.lit(MOST_COPIES).cast("long") * F.col("source_size"))
    )
    by_ratio = Window.orderBy(F.col("cap").cast("double") / F.col("weight").cast("double"), "place")
    earlier = F.coalesce(F.sum("cap").over(by_ratio.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    shared = ranked.withColumn("rest", F.sum("source_size").over(everything) - earlier).withColumn(
        "weights", F.sum("weight").over(by_ratio.rowsBetween(0, Window.unboundedFollowing))
    )
    ratio = lambda w, rest, weights: w.cast("double") * rest.cast("double") / weights.cast("double")
    free = shared.withColumn("free", F.col("cap").cast("double") > ratio(F.col("weight"), F.col("rest"), F.col("weights")))
    # Of the free sources the first has the largest sum of weights from it on.
    first = F.max(F.when(F.col("free"), F.struct("weights", "rest"))).over(everything)
    return free.withColumn("first", first).select(
        *_SOURCE, "source_size",
        F.when(F.col("free"), ratio(F.col("weight"), F.col("first.rest"), F.col("first.weights")))
        .otherwise(F.col("cap").cast("double")).alias("target"),
    )


def _measured(docs: DataFrame) -> DataFrame:
    """One narrow row per document with its size, size class (eight an octave) and hash bucket."""
    text = whole_text("text")
    rows = docs.select(
        F.col("doc_id").cast("long").alias("doc_id"), F.col("source").isNull().alias("no_source"),
        F.coalesce(F.col("source").cast("string"), F.lit("")).alias("source_key"),
        F.xxhash64(text).alias("h"), F.regexp_count(text, F.lit(WORD)).cast("long").alias("size"),
    )
    bits = F.length(F.bin("size"))
    return rows.withColumn(
        "class", bits * 16 + F.expr("shiftright(size, greatest(length(bin(size)) - 4, 0))").cast("int")
    ).withColumn("bucket", F.substring(F.md5(F.coalesce(F.col("doc_id").cast("string"), F.lit(""))), 1, 2))


def plan(docs: DataFrame) -> DataFrame:
    """doc_id, h (hash of the text), source, size, source_size, target, copies and taken (words) of every row.

    Ranks come from counts of classes, then of buckets in a class, then from the
    rows of one bucket, so no window holds a source's documents.
    """
    rows = cut_lineage(_measured(docs))
    group = [*_SOURCE, "class", "bucket"]
    buckets = cut_lineage(rows.groupBy(*group).agg(F.count(F.lit(1)).alias("n"), F.sum("size").alias("words")))
    classes = cut_lineage(buckets.groupBy(*_SOURCE, "class").agg(F.sum("n").alias("n"), F.sum("words").alias("words")))
    rated = cut_lineage(targets(classes.groupBy(*_SOURCE).agg(F.sum("words").alias("source_size"))))
    before = lambda keys, by: F.coalesce(
        F.sum("n").over(Window.partitionBy(*keys).orderBy(by).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)
    )
    class_start = classes.select(*_SOURCE, "class", before(_SOURCE, "class").alias("class_start"))
    offset = (F.conv(F.substring(F.md5(F.concat(F.lit(SEED), "source_key")), 1, 4), 16, 10).cast("double") + 0.5) / 65536.0
    starts = cut_lineage(
        buckets.withColumn("bucket_start", before([*_SOURCE, "class"], "bucket"))
        .join(class_start, [*_SOURCE, "class"]).join(rated, _SOURCE)
        .select(
            *group, "source_size", "target", (F.col("class_start") + F.col("bucket_start")).alias("start"), offset.alias("offset"),
            F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size").cast("double")).otherwise(0.0).alias("rate"),
        )
    )
    rank = F.row_number().over(Window.partitionBy(*group).orderBy("doc_id", "size", "h"))
    upto = lambda rank: F.floor(F.col("offset") + F.col("rate") * rank.cast("double"))
    return (
        rows.withColumn("nth", rank).join(starts, group)
        .withColumn("copies", upto(F.col("start") + F.col("nth")) - upto(F.col("start") + F.col("nth") - 1))
        .select(
            "doc_id", "h", F.when(~F.col("no_source"), F.col("source_key")).alias("source"), "size", "source_size", "target",
            "copies", (F.col("copies") * F.col("size")).alias("taken"),
        )
    )


def sample(docs: DataFrame) -> DataFrame:
    """The mix itself: every row of ``docs`` as many times as its copies, all columns kept.

    Of rows that repeat doc_id, source and text the first stands for all their copies.
    """
    copies = cut_lineage(
        plan(docs).groupBy("doc_id", "source", "h").agg(F.sum("copies").alias("copies")).filter("copies > 0")
        .select(F.col("doc_id").alias("mix_id"), F.col("source").alias("mix_source"), F.col("h").alias("mix_h"), "copies")
    )
    whole = docs.select(
        F.struct("*").alias("row"), F.col("doc_id").cast("long").alias("id"),
        F.col("source").cast("string").alias("source"), F.xxhash64(whole_text("text")).alias("h"),
    )
    same = Window.partitionBy("id", "source", "h").orderBy("h")
    on = F.col("id").eqNullSafe(F.col("mix_id")) & F.col("source").eqNullSafe(F.col("mix_source")) & (F.col("h") == F.col("mix_h"))
    return (
        whole.join(copies, on).withColumn("n", F.row_number().over(same)).filter("n = 1")
        .withColumn("copy", F.explode(F.sequence(F.lit(1).cast("long"), F.col("copies")))).select("row.*")
    )


#: The same rows from DuckDB.
SQL = f"""
WITH d AS (
  SELECT doc_id, source IS NULL AS no_source, coalesce(source, '') AS source_key,
    len(regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+'))::BIGINT AS size
  FROM documents),
c AS (
  SELECT *, length(bin(size)) * 16 + (size >> greatest(length(bin(size)) - 4, 0)) AS class,
    substr(md5(coalesce(doc_id::VARCHAR, '')), 1, 2) AS bucket FROM d),
s AS (SELECT no_source, source_key, sum(size)::BIGINT AS source_size FROM d GROUP BY ALL),
p AS (SELECT *, row_number() OVER (ORDER BY no_source, source_key) AS place FROM s),
w AS (SELECT *, [{", ".join(map(str, WEIGHTS))}][(place - 1) % {len(WEIGHTS)} + 1]::BIGINT AS weight, {MOST_COPIES} * source_size AS cap FROM p),
r AS (
  SELECT *, (sum(source_size) OVER () - coalesce(sum(cap) OVER (ORDER BY cap::DOUBLE / weight::DOUBLE, place
      ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))::BIGINT AS rest,
    (sum(weight) OVER (ORDER BY cap::DOUBLE / weight::DOUBLE, place ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING))::BIGINT AS weights
  FROM w),
f AS (SELECT *, cap::DOUBLE > weight::DOUBLE * rest::DOUBLE / weights::DOUBLE AS free FROM r),
l AS (SELECT max(weights) AS weights, arg_max(rest, weights) AS rest FROM f WHERE free),
t AS (
  SELECT no_source, source_key, source_size,
    CASE WHEN free THEN weight::DOUBLE * l.rest::DOUBLE / l.weights::DOUBLE ELSE cap::DOUBLE END AS target,
    (('0x' || substr(md5('{SEED}' || source_key), 1, 4))::INT::DOUBLE + 0.5) / 65536.0 AS u
  FROM f LEFT JOIN l ON TRUE),
k AS (
  SELECT c.*, target, source_size, u, CASE WHEN source_size > 0 THEN target / source_size::DOUBLE ELSE 0.0 END AS rate,
    row_number() OVER (PARTITION BY no_source, source_key ORDER BY class, bucket, doc_id NULLS FIRST, size) AS rank
  FROM c JOIN t USING (no_source, source_key)),
n AS (SELECT *, (floor(u + rate * rank::DOUBLE) - floor(u + rate * (rank - 1)::DOUBLE))::BIGINT AS copies FROM k)
SELECT doc_id, CASE WHEN NOT no_source THEN source_key END AS source, size, source_size, target, copies, copies * size AS taken FROM n
"""
