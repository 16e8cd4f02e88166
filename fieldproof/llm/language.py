"""Language by Bayesian evidence fusion: text likelihood, declared language, address suffix, host prior.

Text: hashed byte trigrams, one multinomial per language, fitted on a bounded
sample of labelled rows. The mean log-likelihood counts as at most ``TEXT_WEIGHT``
trigrams, so a long text does not drown the rest. The other evidence comes from
grouped counts over the whole corpus of what the text alone says: how often a
language's documents declare each language, and priors by collection, address
suffix, domain and host, each level smoothed towards the one above it. The
posterior is the product; a document stays if it has letters and its best
language reaches ``LEAST``.

Defined cases: null and letterless texts have no language and are rejected; where
a document has no address, its collection is its host and suffix and domain are
empty; several addresses of a document count as one each in its declarations, its
host is the smallest; rows that repeat a doc_id are judged each by its own text; a
table without labels rejects nothing but letterless rows; extra columns are kept
by ``keep`` and not read by ``identify``.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fieldproof.llm.common import map_batches, whole_text
from fieldproof.session import cut_lineage

BUCKETS, SAMPLE_ROWS, LEAST_ROWS = 1 << 15, 3000, 20
TEXT_WEIGHT, LEAST, SMOOTHING = 100.0, 0.5, 8.0
ANCESTORS = ("all", "source", "suffix", "domain", "host")


def trigrams(text: str) -> np.ndarray:
    """Bucket of every three bytes of the text, A-Z lower-cased."""
    b = np.frombuffer(text.encode().lower(), np.uint8).astype(np.uint32)
    if len(b) < 3:
        return np.zeros(0, np.uint32)
    return ((b[:-2] << 16 | b[1:-1] << 8 | b[2:]) * np.uint32(2654435761)) >> np.uint32(32 - BUCKETS.bit_length() + 1)


def _trigram_counts(rows: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
    """(lang, bucket, n) of the batch's texts."""
    seen: dict[str, np.ndarray] = {}
    for lang, text in zip(rows.column(0).to_pylist(), rows.column(1)):
        seen[lang] = seen.get(lang, 0) + np.bincount(trigrams(text.as_py()), minlength=BUCKETS)
    for lang, n in seen.items():
        at = np.flatnonzero(n)
        yield pa.RecordBatch.from_arrays([pa.array([lang] * len(at), pa.string()), pa.array(at.astype(np.int32)), pa.array(n[at])], ["lang", "bucket", "n"])


def fit(labelled: DataFrame) -> tuple[list[str], np.ndarray]:
    """(languages, log-probability of each bucket by language) from rows of text and lang.

    The sample has distinct whole texts, of each language those of lowest hash:
    an equal part of SAMPLE_ROWS, LEAST_ROWS at least. Tasks count their
    trigrams, so the driver gets hashes and BUCKETS counts a language at most.
    """
    few = labelled.filter(F.col("lang").isNotNull() & F.col("text").isNotNull()).select(
        "lang", "text", F.xxhash64("text", F.lit("sample")).alias("h")
    )
    distinct = cut_lineage(few.select("lang", "h").distinct())
    sizes = {row.lang: row["count"] for row in distinct.groupBy("lang").count().collect()}
    counts: dict[str, np.ndarray] = {}
    if sizes:
        part = max(SAMPLE_ROWS // len(sizes), LEAST_ROWS)
        # Hashes are even over 64 bits: below the bound are about four times the part, of which the lowest stay.
        bounds = [(lang, min((1 << 63) - 1, (4 * part << 64) // n - (1 << 63))) for lang, n in sizes.items()]
        low = labelled.sparkSession.createDataFrame(bounds, "lang string, bound long")
        found: dict[str, list[int]] = {}
        for row in distinct.join(F.broadcast(low), "lang").filter("h <= bound").select("lang", "h").collect():
            found.setdefault(row.lang, []).append(row.h)
        picks = [(lang, h) for lang, hashes in found.items() for h in sorted(hashes)[:part]]
        chosen = labelled.sparkSession.createDataFrame(picks, "lang string, h long")
        texts = few.join(F.broadcast(chosen), ["lang", "h"]).groupBy("lang", "h").agg(F.any_value("text").alias("text"))
        seen = map_batches(texts.select("lang", "text"), _trigram_counts, "lang string, bucket int, n long")
        for row in seen.groupBy("lang", "bucket").agg(F.sum("n").alias("n")).collect():
            counts.setdefault(row.lang, np.zeros(BUCKETS, np.int64))[row.bucket] = row.n
        for lang in found:
            counts.setdefault(lang, np.zeros(BUCKETS, np.int64))
    names = sorted(counts)
    table = np.array([np.log((counts[n] + 0.1) / (counts[n].sum() + 0.1 * BUCKETS)) for n in names], np.float32)
    return names, table.reshape(len(names), BUCKETS)


def text_evidence(docs: DataFrame, names: list[str], table: np.ndarray) -> DataFrame:
    """doc_id, h, source, text_log: weighted log-likelihood by language, null without letters."""
    shared = docs.sparkSession.sparkContext.broadcast(np.ascontiguousarray(table.T))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        by_bucket = shared.value
        for batch in batches:
            out: list[list[float] | None] = []
            for text in batch.column(3):
                text = text.as_py()
                total, n = np.zeros(by_bucket.shape[1]), 0
                if any(map(str.isalpha, text)):
                    for at in range(0, len(text), 1 << 18):
                        found = trigrams(text[at:at + (1 << 18)])
                        total += by_bucket[found].sum(axis=0, dtype=np.float64)
                        n += len(found)
                out.append((total / n * min(n, TEXT_WEIGHT)).tolist() if n else None)
            yield pa.RecordBatch.from_arrays([*batch.columns[:3], pa.array(out, pa.list_(pa.float64()))], ["doc_id", "h", "source", "text_log"])

    text = whole_text("text")
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64(text).alias("h"), F.col("source").cast("string").alias("source"), text.alias("text"))
    return rows.mapInArrow(run, "doc_id long, h long, source string, text_log array<double>")


def addresses(pages: DataFrame) -> DataFrame:
    """doc_id, declared (counts by language), suffix, domain, host of the pages that show a document.

    The document's number ends the path of the address.
    """
    host = F.regexp_extract(F.lower("url"), r"^[a-z][a-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]*)", 1)
    declared = F.lower(F.regexp_extract(F.coalesce("html", F.lit("")), r"(?i)<html\b[^>]*?\blang\s*=\s*[\"']?([a-z]{2,3})", 1))
    parts = F.split("host", r"\.")
    return (
        pages.filter(F.col("url").isNotNull())
        .select(F.expr(r"try_cast(regexp_extract(url, '^[^?#]*/([0-9]+)(?:\\.[a-z]+)?/?(?:[?#]|$)', 1) as bigint)").alias("doc_id"), host.alias("host"), declared.alias("declared"))
        .filter(F.col("doc_id").isNotNull())
        .select("doc_id", "host", F.element_at(parts, -1).alias("suffix"), F.array_join(F.slice(parts, F.greatest(F.size(parts) - 2, F.lit(1)), 3), ".").alias("domain"), "declared")
        .groupBy("doc_id").agg(F.min(F.struct("host", "suffix", "domain")).alias("at"), F.min(F.when(F.col("declared") != "", F.col("declared"))).alias("declared"), F.count_distinct("declared").alias("declarations"))
        .select("doc_id", "at.host", "at.suffix", "at.domain", F.when(F.col("declarations") == 1, F.col("declared")).alias("declared"))
    )


def _counts(names: list[str]) -> list[Column]:
    return [F.sum((F.col("said") == i).cast("long")).alias(f"c{i}") for i in range(len(names))]


def _smoothed(names: list[str], above: Column) -> Column:
    """Share of each language, pulled towards the level above by SMOOTHING documents."""
    total = sum((F.col(f"c{i}") for i in range(len(names))), F.lit(0)) + F.lit(SMOOTHING)
    return F.array(*[(F.col(f"c{i}") + F.lit(SMOOTHING) * F.element_at(above, i + 1)) / total for i in range(len(names))])


def priors(evidence: DataFrame, names: list[str]) -> DataFrame:
    """One row per (source, suffix, domain, host) with its hierarchically smoothed prior."""
    levels = list(ANCESTORS[1:])
    by_host = cut_lineage(evidence.groupBy(*levels).agg(*_counts(names)))
    flat = F.array(*[F.lit(1.0 / len(names))] * len(names))
    above = by_host.agg(*[F.sum(f"c{i}").alias(f"c{i}") for i in range(len(names))]).select(_smoothed(names, flat).alias("prior"))
    known = above
    for depth in range(1, len(levels) + 1):
        keys = levels[:depth]
        here = by_host.groupBy(*keys).agg(*[F.sum(f"c{i}").alias(f"c{i}") for i in range(len(names))])
        # The first level joins the one row of the whole corpus.
        joined = here.join(known.withColumnRenamed("prior", "above"), keys[:-1]) if depth > 1 else here.join(F.broadcast(known.withColumnRenamed("prior", "above")))
        known = cut_lineage(joined.select(*keys, _smoothed(names, F.col("above")).alias("prior")))
    return known


def identify(docs: DataFrame, pages: DataFrame | None = None) -> DataFrame:
    """doc_id, h, lang, confidence, text_lang, declared, host, kept of every row of ``docs`` (doc_id, text, lang, source)."""
    names, table = fit(docs)
    text = cut_lineage(text_evidence(docs, names, table))
    none = F.lit(None).cast("string")
    if pages is None:
        shown = text.withColumns({"host": none, "suffix": none, "domain": none, "declared": none})
    else:
        shown = text.join(cut_lineage(addresses(pages)), "doc_id", "left")
    empty = lambda c: F.coalesce(F.col(c), F.lit(""))
    best = lambda scores: F.array_position(scores, F.array_max(scores)).cast("int") - 1
    evidence = cut_lineage(shown.select(
        "doc_id", "h", "text_log", "declared", empty("source").alias("source"), empty("suffix").alias("suffix"),
        empty("domain").alias("domain"), F.coalesce("host", "source", F.lit("")).alias("host"),
        best(F.col("text_log")).alias("said"),
    ))
    if not names:
        return evidence.select("doc_id", "h", none.alias("lang"), F.lit(None).cast("double").alias("confidence"), none.alias("text_lang"), "declared", "host", F.col("text_log").isNotNull().alias("kept"))
    prior = priors(evidence, names)
    declares = cut_lineage(evidence.filter("declared IS NOT NULL AND said IS NOT NULL").groupBy("declared").agg(*_counts(names)))
    spoken = declares.agg(*[F.sum(f"c{i}").alias(f"t{i}") for i in range(len(names))], F.count(F.lit(1)).alias("kinds"))
    likely = cut_lineage(
        declares.join(F.broadcast(spoken)).select(
            "declared",
            F.array(*[F.log((F.col(f"c{i}") + 1.0) / (F.coalesce(f"t{i}", F.lit(0)) + F.col("kinds") + 1.0)) for i in range(len(names))]).alias("declared_log"),
        )
    )
    joined = evidence.join(prior, list(ANCESTORS[1:]), "left").join(likely, "declared", "left")
    one = lambda i: (
        F.element_at("text_log", i + 1) + F.coalesce(F.element_at("declared_log", i + 1), F.lit(0.0))
        + F.log(F.coalesce(F.element_at("prior", i + 1), F.lit(1.0 / len(names))))
    )
    scored = joined.withColumn("scores", F.when(F.col("text_log").isNotNull(), F.array(*[one(i) for i in range(len(names))])))
    top = F.array_max("scores")
    confidence = 1.0 / F.aggregate("scores", F.lit(0.0), lambda acc, x: acc + F.exp(x - top))
    named = lambda i: F.get(F.array(*[F.lit(n) for n in names]), i)
    return scored.withColumn("confidence", F.when(F.col("scores").isNotNull(), confidence)).select(
        "doc_id", "h", named(best(F.col("scores"))).alias("lang"), "confidence", named(F.col("said")).alias("text_lang"), "declared", "host",
        F.coalesce(F.col("confidence") >= LEAST, F.lit(False)).alias("kept"),
    )


def keep(docs: DataFrame, pages: DataFrame | None = None) -> DataFrame:
    """The rows of ``docs`` that are not rejected, all columns kept."""
    gone = cut_lineage(
        identify(docs, pages).filter("NOT kept").select(F.col("doc_id").alias("gone_id"), F.col("h").alias("gone_h")).distinct()
    )
    whole = docs.select(F.struct("*").alias("row"), F.col("doc_id").cast("long").alias("id"), F.xxhash64(whole_text("text")).alias("h"))
    return whole.join(gone, F.col("id").eqNullSafe(F.col("gone_id")) & (F.col("h") == F.col("gone_h")), "left_anti").select("row.*")
