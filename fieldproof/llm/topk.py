"""Exact top-k search by inner product: exhaustive accumulation, one term at a time.

Candidates and queries are dealt into blocks, and a cell is one block of each.
In a cell the candidates' non-zero components are postings per dimension; each
dimension scatters its postings, weighted by the queries' components, into dense
score arrays. A partition step selects the best of the cell, a window merges
cells. A stated query set against all rows has that many pairs by nature; no pair
leaves a cell but the k best of a query.

Defined cases: vectors that are null or hold null or non-finite components take
no part, nor do null ids; rows that repeat an id are queries and candidates of their
own, so the other rows of a query's id are candidates too; missing components count
as zero; scores are longs and wrap beyond 64 bits; ties go to the smaller id; an
empty table gives no rows; extra columns are not read.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from fieldproof.session import cut_lineage

#: Rows of a block: enough blocks for the cluster, bounded in memory.
LEAST_ROWS, MOST_ROWS, BLOCKS_PER_CORE = 256, 16_384, 4
#: Scores of one step, few enough for a core's cache.
SCORES_AT_ONCE = 1 << 17


def quantized(vectors: DataFrame, scale: int = 64) -> DataFrame:
    """vec_id, v: floor(scale * component) of every usable vector."""
    usable = F.forall("embedding", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf")))
    return (
        vectors.filter(F.col("vec_id").isNotNull() & F.col("embedding").isNotNull()).filter(usable)
        .select(F.col("vec_id").cast("long"), F.transform("embedding", lambda x: F.floor(F.lit(float(scale)) * x.cast("double"))).alias("v"))
    )


def best_of_cell(ids: np.ndarray, keys: np.ndarray, rows: np.ndarray, query_ids: np.ndarray, query_keys: np.ndarray, queries: np.ndarray, k: int) -> pd.DataFrame:
    """query_id, query_key, vec_id, score of the k best rows of each query; ``ids`` ascend, keys are unique."""
    # Half the bytes where no score can leave them.
    largest = rows.shape[1] * float(np.abs(rows.astype(float)).max(initial=0)) * float(np.abs(queries.astype(float)).max(initial=0))
    kind = np.int32 if largest < 2 ** 31 else np.int64
    rows, queries = rows.astype(kind), queries.astype(kind)
    postings = [(j, at, rows[at, j][:, None]) for j in range(rows.shape[1]) if len(at := np.flatnonzero(rows[:, j]))]
    n, step, out = len(ids), max(1, SCORES_AT_ONCE // max(1, len(ids))), []
    for low in range(0, len(query_ids), step):
        weights, asked, asked_keys = (x[low:low + step] for x in (queries, query_ids, query_keys))
        scores, scratch = np.zeros((n, len(asked)), kind), np.empty((n, len(asked)), kind)
        for j, at, values in postings:
            term = weights[:, j]
            if not term.any():
                continue
            if len(at) == n:
                scores += np.multiply(values, term, out=scratch)
            else:
                scores[at] += np.multiply(values, term, out=scratch[:len(at)])
        scores = np.ascontiguousarray(scores.T)
        if n > k + 1:
            floor = np.partition(scores, n - k - 1, axis=1)[:, n - k - 1]
            query, at = np.nonzero(scores >= floor[:, None])
        else:
            query, at = np.divmod(np.arange(scores.size), n)
        other = keys[at] != asked_keys[query]
        query, at = query[other], at[other]
        score = scores[query, at].astype(np.int64)
        order = np.lexsort((at, -score, query))
        query, at, score = query[order], at[order], score[order]
        first = np.searchsorted(query, query)
        best = np.arange(len(query)) - first < k
        out.append(pd.DataFrame({"query_id": asked[query[best]], "query_key": asked_keys[query[best]], "vec_id": ids[at[best]], "score": score[best]}))
    return pd.concat(out, ignore_index=True)


def _dense(vectors: pd.Series, width: int) -> np.ndarray:
    out = np.zeros((len(vectors), width), np.int64)
    for i, v in enumerate(vectors):
        out[i, : len(v)] = v
    return out


def top_k(vectors: DataFrame, is_query: Column, k: int = 20) -> DataFrame:
    """query_id, rank, vec_id, score: the k best other rows of every row where ``is_query`` holds."""
    # The keys are written with the rows, so every later read finds the same.
    rows = cut_lineage(quantized(vectors).withColumn("query", is_query).withColumn("key", F.monotonically_increasing_id()))
    size = rows.agg(F.count(F.lit(1)).alias("n"), F.count_if("query").alias("q")).first()
    cores = rows.sparkSession.sparkContext.defaultParallelism
    per_block = min(MOST_ROWS, max(LEAST_ROWS, math.ceil(size.n / (BLOCKS_PER_CORE * cores))))
    blocks, query_blocks = max(1, math.ceil(size.n / per_block)), max(1, math.ceil(size.q / MOST_ROWS))
    place = lambda n, salt: F.pmod(F.xxhash64("key", F.lit(salt)), F.lit(n)).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    candidates = rows.select("vec_id", "key", "v", F.lit(False).alias("asks"), place(blocks, "row").alias("i"), every(query_blocks).alias("j"))
    asking = rows.filter("query").select("vec_id", "key", "v", F.lit(True).alias("asks"), place(query_blocks, "query").alias("j"), every(blocks).alias("i"))

    def cell(frame: pd.DataFrame) -> pd.DataFrame:
        asks = frame["asks"].to_numpy()
        ours, theirs = frame[~asks].sort_values("vec_id"), frame[asks]
        if not len(ours) or not len(theirs):
            return pd.DataFrame({"query_id": [], "query_key": [], "vec_id": [], "score": []}, dtype="int64")
        width = max(map(len, frame["v"]))
        return best_of_cell(*(x for side in (ours, theirs) for x in (side["vec_id"].to_numpy(), side["key"].to_numpy(), _dense(side["v"], width))), k)

    # A fixed number of tasks: by size the cells of a small table would fall to a few.
    dealt = candidates.unionByName(asking).repartition(min(blocks * query_blocks, 16 * BLOCKS_PER_CORE * cores), "i", "j")
    best = dealt.groupBy("i", "j").applyInPandas(cell, "query_id long, query_key long, vec_id long, score long")
    order = Window.partitionBy("query_key").orderBy(F.desc("score"), "vec_id")
    return best.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


#: The same rows from DuckDB, for queries at every twentieth id.
SQL = """
WITH q AS (
  SELECT vec_id, row_number() OVER () AS key, list_transform(embedding, lambda x: floor(64 * x::DOUBLE)::BIGINT) AS v FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND list_bool_and(list_transform(embedding, lambda x: x IS NOT NULL AND isfinite(x)))),
s AS (
  SELECT a.key, a.vec_id AS query_id, b.vec_id AS vec_id, list_sum(list_transform(list_zip(a.v, b.v), lambda z: z[1] * z[2]))::BIGINT AS score
  FROM q a JOIN q b ON a.key <> b.key WHERE a.vec_id % 20 = 0),
r AS (SELECT *, row_number() OVER (PARTITION BY key ORDER BY score DESC, vec_id)::INT AS rank FROM s)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 20
"""
