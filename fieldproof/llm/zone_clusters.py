"""Centroid clustering over zone maps: Hilbert-ordered blocks with min/max boxes.

Vectors become integers and are ordered along a Hilbert curve through their grid
cells; runs of BLOCK_ROWS neighbours are written once as blocks with the least
and greatest value of every component. In each round a task takes a block's box:
a centroid whose least distance to the box exceeds another one's greatest is no
vector's nearest, so only the rest are compared, exactly and for the whole block
at once. A task sends on one row per cluster (count and component sums), and the
driver gets one row per cluster and holds the ``k`` centroids alone.

Defined cases: vectors that are null, of another length, or hold null or
non-finite components take no part; components are cut to 2**27 either way, so
that squared distances fit 64 bits; rows that repeat an id are vectors of their
own; a null id hashes as an empty one; equal hashes go by the vector; distances
tie to the smaller number; with fewer vectors than ``k`` each starts a centroid;
an inertia beyond 64 bits is null; an empty table gives no rows; extra columns
are not read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fieldproof.session import cut_lineage

BLOCK_ROWS, GRID_BITS, LARGEST = 256, 4, 1 << 27
_BLOCK = "ids array<long>, data binary, low binary, high binary"


def quantized(vectors: DataFrame, width: int, scale: int = 64) -> DataFrame:
    """vec_id, v: floor(scale * component) of every usable vector of ``width`` components."""
    usable = F.forall("embedding", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf")))
    whole = F.transform("embedding", lambda x: F.floor(F.least(F.greatest(F.lit(float(scale)) * x.cast("double"), F.lit(-float(LARGEST))), F.lit(float(LARGEST)))).cast("int"))
    kept = vectors.filter(F.col("embedding").isNotNull() & (F.size("embedding") == width)).filter(usable)
    return kept.select(F.col("vec_id").cast("long"), whole.alias("v"))


def hilbert_keys(cells: np.ndarray, bits: int) -> list[bytes]:
    """Place of every row of grid cells along the Hilbert curve, as bytes that sort like it.

    The coordinates are turned into the transposed index bit by bit, over all rows at once.
    """
    x = np.ascontiguousarray(cells.T).astype(np.int64)
    for level in range(bits - 1, 0, -1):
        bit, lower = 1 << level, (1 << level) - 1
        for axis in range(len(x)):
            turned = (x[axis] & bit) != 0
            swap = np.where(turned, 0, (x[0] ^ x[axis]) & lower)
            x[0] ^= np.where(turned, lower, swap)
            x[axis] ^= swap
    for axis in range(1, len(x)):
        x[axis] ^= x[axis - 1]
    flips = np.zeros(x.shape[1], np.int64)
    for level in range(bits - 1, 0, -1):
        flips ^= np.where(x[-1] & (1 << level), (1 << level) - 1, 0)
    x ^= flips
    planes = np.stack([(x >> level) & 1 for level in range(bits - 1, -1, -1)])  # bit, axis, row
    packed = np.packbits(planes.reshape(-1, x.shape[1]).T.astype(np.uint8), axis=1)
    return [row.tobytes() for row in packed]


def _matrix(column: pa.ListArray, width: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(-1, width).astype(np.int64)


def packed_type(low: int, high: int) -> np.dtype:
    """Smallest integers that hold all components, so that a batch of blocks stays small."""
    return next(np.dtype(t) for t in (np.int8, np.int16, np.int32) if np.iinfo(t).min <= low and high <= np.iinfo(t).max)


def blocks(rows: DataFrame, width: int) -> tuple[DataFrame, np.dtype]:
    """Zone-mapped blocks of ``rows`` (vec_id, v): ids, components, the box around them; and the integers' type."""
    span = rows.agg(F.min(F.array_min("v")).alias("low"), F.max(F.array_max("v")).alias("high")).first()
    low, cells = span.low or 0, 1 << GRID_BITS
    step = max(1, -(-((span.high or 0) - low + 1) // cells))
    kind = packed_type(low, span.high or 0)

    def with_key(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                keys = hilbert_keys((_matrix(batch.column("v"), width) - low) // step, GRID_BITS)
                yield pa.RecordBatch.from_arrays([batch.column("vec_id"), batch.column("v"), pa.array(keys, pa.binary())], ["vec_id", "v", "key"])

    def packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids: list = []
        data = np.zeros((0, width), kind)
        for batch in _then_none(batches):
            if batch is not None:
                ids += batch.column("vec_id").to_pylist()
                data = np.concatenate([data, _matrix(batch.column("v"), width).astype(kind)])
            full = len(ids) if batch is None else len(ids) - len(ids) % BLOCK_ROWS
            cuts = [(ids[i:min(full, i + BLOCK_ROWS)], data[i:min(full, i + BLOCK_ROWS)]) for i in range(0, full, BLOCK_ROWS)]
            ids, data = ids[full:], data[full:]
            if cuts:
                yield pa.RecordBatch.from_arrays([
                    pa.array([some for some, _ in cuts], pa.list_(pa.int64())), pa.array([d.tobytes() for _, d in cuts], pa.binary()),
                    pa.array([d.min(0).tobytes() for _, d in cuts], pa.binary()), pa.array([d.max(0).tobytes() for _, d in cuts], pa.binary()),
                ], ["ids", "data", "low", "high"])

    # The row number splits a vector that many rows share; it is written, so it stays.
    keyed = cut_lineage(rows.mapInArrow(with_key, "vec_id long, v array<int>, key binary").withColumn("no", F.monotonically_increasing_id()))
    order = ("key", "vec_id", "no")
    return cut_lineage(keyed.repartitionByRange(*order).sortWithinPartitions(*order).select("vec_id", "v").mapInArrow(packed, _BLOCK)), kind


def _then_none(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch | None]:
    yield from batches
    yield None


def candidates(low: np.ndarray, high: np.ndarray, centroids: np.ndarray) -> np.ndarray:
    """Numbers of the centroids that can be nearest to some point of the box, ties included."""
    outside = np.maximum(low - centroids, 0) + np.maximum(centroids - high, 0)
    across = np.maximum(np.abs(centroids - low), np.abs(high - centroids))
    return np.flatnonzero((outside * outside).sum(1) <= (across * across).sum(1).min())


def nearest(data: np.ndarray, low: np.ndarray, high: np.ndarray, centroids: np.ndarray) -> tuple[np.ndarray, np.ndarray, int]:
    """(cluster, squared distance) of every row of a block, and how many centroids were compared."""
    chosen = candidates(low, high, centroids)
    distances = np.empty((len(chosen), len(data)), np.int64)
    for i, c in enumerate(chosen):
        apart = data - centroids[c]
        distances[i] = np.einsum("ij,ij->i", apart, apart)
    at = distances.argmin(0)
    return chosen[at], distances[at, np.arange(len(data))], len(chosen)


def _each_block(batches: Iterator[pa.RecordBatch], centroids: np.ndarray, kind: np.dtype):
    width = centroids.shape[1]
    for batch in batches:
        for ids, data, low, high in zip(*(batch.column(c) for c in ("ids", "data", "low", "high"))):
            rows = np.frombuffer(data.as_py(), kind).reshape(-1, width).astype(np.int64)
            box = (np.frombuffer(b.as_py(), kind).astype(np.int64) for b in (low, high))
            yield ids.values, rows, *nearest(rows, *box, centroids)


def moved(table: DataFrame, kind: np.dtype, centroids: np.ndarray) -> tuple[np.ndarray, dict]:
    """The centroids after one round, and its counts: rows, comparisons made, comparisons without boxes."""
    k, width = centroids.shape

    def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        count, total, made, compared = np.zeros(k, np.int64), np.zeros((k, width), np.int64), 0, 0
        for _, rows, cluster, _, chosen in _each_block(batches, centroids, kind):
            count += np.bincount(cluster, minlength=k)
            np.add.at(total, cluster, rows)
            made, compared = made + len(rows), compared + chosen * len(rows)
        used = np.flatnonzero(count)
        work = np.zeros(len(used), np.int64)
        work[:1] = compared
        yield pa.RecordBatch.from_arrays(
            [pa.array(used), pa.array(count[used]), pa.array(work), pa.array(list(total[used]), pa.list_(pa.int64()))], ["cluster", "n", "compared", "total"])

    parts = table.mapInArrow(sums, "cluster long, n long, compared long, total array<long>")
    exact = lambda c: F.sum(c.cast("decimal(38,0)"))
    rows = parts.groupBy("cluster").agg(
        F.sum("n").alias("n"), F.sum("compared").alias("compared"),
        F.array(*(exact(F.col("total")[i]) for i in range(width))).alias("total")).collect()
    out = centroids.copy()
    for row in rows:
        out[row.cluster] = [int(x) // row.n for x in row.total]
    n = sum(r.n for r in rows)
    return out, {"rows": n, "compared": sum(r.compared for r in rows), "without_boxes": n * k}


def first_centroids(rows: DataFrame, k: int) -> np.ndarray:
    """The ``k`` vectors of smallest sha256 of ``1:<vec_id>``."""
    by_hash = F.sha2(F.concat(F.lit("1:"), F.coalesce(F.col("vec_id").cast("string"), F.lit(""))), 256)
    return np.array([r.v for r in rows.select(by_hash.alias("h"), "v").orderBy("h", "v").limit(k).collect()], np.int64)


def _by_cluster(values: list) -> Column:
    return F.element_at(F.array(*(F.lit(v) for v in values)), F.col("cluster") + 1)


def cluster(vectors: DataFrame, k: int = 16, rounds: int = 3, width: int = 64) -> DataFrame:
    """vec_id, cluster, distance, cluster_inertia, inertia, centroid_sha256 of every usable vector."""
    rows = quantized(vectors, width)
    centroids = first_centroids(rows, k)
    if not len(centroids):
        return vectors.sparkSession.createDataFrame(
            [], "vec_id long, cluster int, distance long, cluster_inertia long, inertia long, centroid_sha256 string")
    table, kind = blocks(rows, width)
    for _ in range(rounds):
        centroids, _ = moved(table, kind, centroids)

    def assigned(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for ids, _, numbers, distances, _ in _each_block(batches, centroids, kind):
            yield pa.RecordBatch.from_arrays([ids, pa.array(numbers.astype(np.int32)), pa.array(distances)], ["vec_id", "cluster", "distance"])

    found = cut_lineage(table.mapInArrow(assigned, "vec_id long, cluster int, distance long"))
    sums = {r.cluster: int(r.d) for r in found.groupBy("cluster").agg(F.sum(F.col("distance").cast("decimal(38,0)")).alias("d")).collect()}
    fits = lambda x: x if x < 1 << 63 else None
    digests = [hashlib.sha256(",".join(map(str, c.tolist())).encode()).hexdigest() for c in centroids]
    return found.select(
        "vec_id", "cluster", "distance", _by_cluster([fits(sums.get(c, 0)) for c in range(len(centroids))]).cast("long").alias("cluster_inertia"),
        F.lit(fits(sum(sums.values()))).cast("long").alias("inertia"), _by_cluster(digests).alias("centroid_sha256"))


def _sql(k: int = 16, rounds: int = 3, width: int = 64) -> str:
    """The same rows from DuckDB, every vector against every centroid."""
    near = """
a{r} AS (
  SELECT rid, any_value(vec_id) AS vec_id, any_value(v) AS v, min([d, c]) AS best FROM (
    SELECT q.rid, q.vec_id, q.v, c.c, list_sum(list_transform(list_zip(q.v, c.v), lambda z: (z[1] - z[2]) * (z[1] - z[2])))::BIGINT AS d
    FROM q CROSS JOIN c{r} c) GROUP BY rid)"""
    move = """
s{r} AS (
  SELECT c, i, sum(x)::BIGINT AS s, count(*) AS n FROM (SELECT best[2] AS c, unnest(v) AS x, unnest(range({width})) AS i FROM a{r}) GROUP BY c, i),
c{next} AS (
  SELECT c.c, coalesce(m.v, c.v) AS v FROM c{r} c LEFT JOIN (
    SELECT c, list((s - ((s % n) + n) % n) // n ORDER BY i) AS v FROM s{r} GROUP BY c) m USING (c))"""
    steps = ",".join(near.format(r=r) + "," + move.format(r=r, next=r + 1, width=width) for r in range(rounds))
    return f"""
WITH q AS (
  SELECT row_number() OVER () AS rid, vec_id, list_transform(embedding, lambda x: floor(greatest(least(64 * x::DOUBLE, {LARGEST}), -{LARGEST}))::BIGINT) AS v FROM embeddings
  WHERE len(embedding) = {width} AND list_bool_and(list_transform(embedding, lambda x: x IS NOT NULL AND isfinite(x)))),
c0 AS (SELECT row_number() OVER (ORDER BY sha256('1:' || coalesce(vec_id::VARCHAR, '')), v) - 1 AS c, v FROM q QUALIFY c < {k}),{steps},{near.format(r=rounds)}
SELECT vec_id, best[2]::INT AS cluster, best[1] AS distance, (sum(best[1]) OVER (PARTITION BY best[2]))::BIGINT AS cluster_inertia,
  (sum(best[1]) OVER ())::BIGINT AS inertia, (SELECT sha256(array_to_string(v, ',')) FROM c{rounds} WHERE c = best[2]) AS centroid_sha256
FROM a{rounds}"""


SQL = _sql()
