"""SimHash near-duplicates: pivot distance tables inside buckets of agreeing bits.

A pair that differs in at most three of 64 bits agrees on at least three of six
blocks of bits; every choice of three blocks is a key, which gives the buckets
(pivots alone would leave all pairs to one another). Inside a bucket the
distances to fixed reference fingerprints are the coordinates: by the triangle
inequality a pair whose coordinates differ by more than the limit anywhere is no
link, and only the rest is verified bit by bit.

Defined cases: null text is empty; a text without words has fingerprint zero and
is linked like any other; repeated rows are rows; a null doc_id takes part and
never names a group that has another; extra columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from fieldproof.llm.common import map_batches, whole_text, word_runs
from fieldproof.llm.links import cells, components, join_within_cells, whole_cells
from fieldproof.session import cut_lineage

SHINGLE_WORDS, MOST_BITS, SEED = 3, 3, 42
BLOCKS = (11, 11, 11, 11, 10, 10)
PIVOTS = np.array([xxhash.xxh64_intdigest(b"pivot %d" % i) for i in range(24)], np.uint64)


def fingerprint(text: str) -> int:
    """64-bit majority of the XXH64 of the three-word shingles, repeats counted."""
    ones, total = np.zeros(64, np.int64), 0
    digest, glue = xxhash.xxh64_intdigest, b" ".join
    for words in word_runs(text, 1 << 20, SHINGLE_WORDS - 1):
        if len(words) < SHINGLE_WORDS:
            if total or not words:
                continue
            hashes = [digest(glue(words), SEED)]
        else:
            hashes = [digest(glue(w), SEED) for w in zip(words, words[1:], words[2:])]
        for k in range(0, len(hashes), 1 << 16):
            part = np.array(hashes[k:k + (1 << 16)], ">u8")
            ones += np.unpackbits(part.view(np.uint8).reshape(-1, 8), axis=1).sum(axis=0, dtype=np.int64)
        total += len(hashes)
    return int.from_bytes(np.packbits(2 * ones > total).tobytes(), "big")


def fingerprints(docs: DataFrame) -> DataFrame:
    """doc_id, h (hash of the text), fp (the 64 bits as a signed long) of every row."""

    def batch(rows: pa.RecordBatch) -> pa.RecordBatch:
        fp = np.array([fingerprint(t) for t in rows.column(2).to_pylist()], np.uint64).view(np.int64)
        return pa.RecordBatch.from_arrays([rows.column(0), rows.column(1), pa.array(fp)], ["doc_id", "h", "fp"])

    text = whole_text("text")
    rows = docs.select(F.col("doc_id").cast("long"), F.xxhash64(text).alias("h"), text.alias("text"))
    return map_batches(rows, batch, "doc_id long, h long, fp long")


def _masks() -> list[int]:
    edges = np.cumsum((0, *BLOCKS)).tolist()
    block = [((1 << (hi - lo)) - 1) << lo for lo, hi in zip(edges, edges[1:])]
    masks = [sum(c) for c in combinations(block, len(BLOCKS) - MOST_BITS)]
    return [m - (1 << 64) if m >> 63 else m for m in masks]


def keyed(fps: DataFrame) -> DataFrame:
    """One row per fingerprint and choice of agreeing blocks."""
    keys = F.array(*[F.xxhash64(F.col("fp").bitwiseAND(F.lit(m).cast("long")), F.lit(i)) for i, m in enumerate(_masks())])
    return fps.select("fp", F.explode(keys).alias("key"))


def links_in_cells(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Star links of the components inside each cell."""
    for frame in whole_cells(frames):
        bits = frame["fp"].to_numpy().view(np.uint64)
        table = np.bitwise_count(bits[:, None] ^ PIVOTS[None, :]).astype(np.int8)

        def linked(i: np.ndarray, j: np.ndarray, bits=bits, table=table) -> np.ndarray:
            near = np.abs(table[i, 0] - table[j, 0]) <= MOST_BITS
            left = np.flatnonzero(near)
            left = left[np.abs(table[i[left]] - table[j[left]]).max(axis=1, initial=0) <= MOST_BITS]
            near[:] = False
            near[left] = np.bitwise_count(bits[i[left]] ^ bits[j[left]]) <= MOST_BITS
            return near

        label = join_within_cells(frame["cell"].to_numpy(), linked)
        moved = np.flatnonzero(label != np.arange(len(label)))
        fp = frame["fp"].to_numpy()
        yield pd.DataFrame({"a": fp[moved], "b": fp[label[moved]]})


def _classes(rows: DataFrame) -> DataFrame:
    """fp, component (a fingerprint that names it), first (smallest doc_id of the fingerprint)."""
    fps = cut_lineage(rows.groupBy("fp").agg(F.min("doc_id").alias("first")))
    found = components(cells(keyed(fps), "fp").mapInPandas(links_in_cells, "a long, b long"))
    return cut_lineage(
        fps.join(found.withColumnRenamed("node", "fp"), "fp", "left")
        .select("fp", "first", F.coalesce("component", "fp").alias("component"))
    )


def near_duplicates(docs: DataFrame) -> DataFrame:
    """doc_id, fp, component_id: the smallest doc_id reachable over links of at most three bits."""
    rows = cut_lineage(fingerprints(docs))
    classes = _classes(rows)
    names = cut_lineage(classes.groupBy("component").agg(F.min("first").alias("component_id")))
    named = cut_lineage(classes.join(names, "component").select("fp", "component_id"))
    return rows.join(named, "fp").select("doc_id", "fp", "component_id")


def keep_one(docs: DataFrame) -> DataFrame:
    """The rows of ``docs`` without near-duplicates, all columns kept.

    Of each group the row of smallest doc_id stays (of rows with that doc_id
    one text, of repeated rows one; null doc_ids come last).
    """
    rows = cut_lineage(fingerprints(docs))
    order = F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "h")
    kept = cut_lineage(
        rows.join(_classes(rows).select("fp", "component"), "fp")
        .groupBy("component").agg(F.min(order).alias("kept"))
        .select(F.col("kept.doc_id").alias("keep_id"), F.col("kept.h").alias("keep_h"))
    )
    whole = docs.select(
        F.struct("*").alias("row"), F.col("doc_id").cast("long").alias("id"), F.xxhash64(whole_text("text")).alias("h")
    )
    same = Window.partitionBy("id", "h").orderBy("h")
    return (
        whole.join(kept, F.col("id").eqNullSafe(F.col("keep_id")) & (F.col("h") == F.col("keep_h")))
        .withColumn("n", F.row_number().over(same)).filter("n = 1").select("row.*")
    )
