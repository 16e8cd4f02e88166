"""The registered queries of this folder and their SQL: thin digests of what the operators return."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fieldproof.llm import (
    bpe, context_mixing, credentials, language, merkle, mixing, order_minhash, simhash, substring_dedup, template, topk, warc, zone_clusters,
)
from fieldproof.llm.common import table


def op1_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every place of a paragraph or passage that repeats, and the place that is kept for it."""
    return substring_dedup.all_repeats(table(spark, sf_dir, "documents")).drop("h")


def op2_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 20 best other vectors of every vector whose id 20 divides."""
    return topk.top_k(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 20 == 0)


def op3_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ids of every document and the text decoded from them, as digests."""
    docs = table(spark, sf_dir, "documents")
    return bpe.round_trip(docs.withColumn("doc_id", F.col("doc_id").cast("long"))).select(
        "doc_id", F.expr("octet_length(ids) div 4").alias("n_tokens"), F.sha2("ids", 256).alias("ids_sha256"),
        F.sha2(F.encode("decoded", "UTF-8"), 256).alias("decoded_sha256"),
    )


def op4_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every page as read back from the packages written for the whole table."""
    return warc.read(warc.archive(table(spark, sf_dir, "pages")), with_payload=False).drop("payload")


def op5_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Language of every document from its text and the pages that show it."""
    return language.identify(table(spark, sf_dir, "documents"), table(spark, sf_dir, "pages")).drop("h")


def op6_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprint and near-duplicate component of every document."""
    found = simhash.near_duplicates(table(spark, sf_dir, "documents"))
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def op7_context_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Unigram base and context-mixing score of every document."""
    return context_mixing.scores(table(spark, sf_dir, "documents"))


def op8_order_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprints of every document and of its edited text."""
    return order_minhash.edited_pairs(table(spark, sf_dir, "documents"))


def op9_template(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Main text of every page."""
    return template.extract(table(spark, sf_dir, "pages")).withColumn("n_chars", F.length("text").cast("long"))


def op10_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Copies and words that the mix takes of every document."""
    return mixing.plan(table(spark, sf_dir, "documents")).drop("h")


def op11_merkle(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Leaf, proof and root of every document, and the root that its version folds to."""
    return merkle.manifest(table(spark, sf_dir, "documents"))


def op12_zone_clusters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cluster of every vector after three rounds, with its distance and the inertia."""
    return zone_clusters.cluster(table(spark, sf_dir, "embeddings"))


def op13_credentials(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts and spans of the secrets in every document."""
    return credentials.digest(credentials.find(table(spark, sf_dir, "documents")))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {f.__name__: f for f in (op1_substring_dedup, op2_topk, op3_bpe, op4_warc, op5_language, op6_simhash, op7_context_mixing, op8_order_minhash, op9_template, op10_mixing, op11_merkle, op12_zone_clusters, op13_credentials)}

SQL: dict[str, str] = {"op2_topk": topk.SQL, "op10_mixing": mixing.SQL, "op11_merkle": merkle.SQL, "op12_zone_clusters": zone_clusters.SQL, "op13_credentials": credentials.SQL}
