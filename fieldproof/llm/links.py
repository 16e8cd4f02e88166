"""Links from shared bucket keys, without pairs of a whole bucket in one task, and their components."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fieldproof.session import cut_lineage

#: Rows of one side of a cell: what a task compares at once.
CELL_ROWS = 512


def cells(keyed: DataFrame, node: str, cell_rows: int = CELL_ROWS) -> DataFrame:
    """``keyed`` (column ``key`` and others) dealt into cells of bounded size, sorted by cell.

    Keys of one row go, and of buckets with the same members one is kept. A
    bucket of n rows is cut by a hash of ``node`` into ceil(n / cell_rows) chunks and every pair of chunks is a cell, so each two rows
    of a bucket meet in one cell, no cell holds more than about two chunks, and
    the cells of a hot bucket spread over tasks. The join with the sizes has a
    plain exchange on both sides, so a hot key is split at run time too.
    """
    members = [F.count(F.lit(1)).alias("bucket_rows"), F.bit_xor(F.xxhash64(node)).alias("x"), F.min(node).alias("m"), F.max(node).alias("n")]
    buckets = keyed.groupBy("key").agg(*members).filter("bucket_rows > 1")
    sizes = cut_lineage(buckets.groupBy("bucket_rows", "x", "m", "n").agg(F.min("key").alias("key")).select("key", "bucket_rows"))
    chunks = F.ceil(F.col("bucket_rows") / F.lit(cell_rows)).cast("int")
    placed = (
        keyed.join(sizes, "key").withColumn("chunks", chunks)
        .withColumn("chunk", F.pmod(F.xxhash64(F.col(node), F.lit("chunk")), F.col("chunks")).cast("int"))
        .withColumn("other", F.explode(F.sequence(F.lit(0), F.col("chunks") - 1)))
        .withColumn("cell", F.struct("key", F.least("chunk", "other").alias("i"), F.greatest("chunk", "other").alias("j")))
        .withColumn("cell", F.xxhash64("cell"))
        .drop("key", "bucket_rows", "chunks", "chunk", "other")
    )
    return placed.repartition("cell").sortWithinPartitions("cell", node)


def whole_cells(frames: Iterator[pd.DataFrame], least: int = 20_000) -> Iterator[pd.DataFrame]:
    """Frames sorted by cell regrouped so that no cell is cut; about ``least`` rows each."""
    held: list[pd.DataFrame] = []
    rows = 0
    for frame in frames:
        held.append(frame)
        rows += len(frame)
        if rows < least:
            continue
        frame = pd.concat(held, ignore_index=True)
        last = int(np.searchsorted(frame["cell"].to_numpy(), frame["cell"].iloc[-1]))
        if last:
            yield frame.iloc[:last].reset_index(drop=True)
        held, rows = [frame.iloc[last:]], len(frame) - last
    if rows:
        yield pd.concat(held, ignore_index=True)


def join_within_cells(cell: np.ndarray, linked: Callable[[np.ndarray, np.ndarray], np.ndarray]) -> np.ndarray:
    """Index of the first row of each row's component inside its cell.

    ``linked`` gets two index arrays of rows of one cell and says which pairs
    are links. Pairs already joined are not asked again.
    """
    n = len(cell)
    starts = np.flatnonzero(np.r_[True, cell[1:] != cell[:-1]])
    end = np.repeat(np.r_[starts[1:], n], np.diff(np.r_[starts, n]))
    parent = list(range(n))

    def find(x: int) -> int:
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    label, index, lag = np.arange(n), np.arange(n), 1
    while True:
        index = index[index + lag < end[index]]
        if not len(index):
            return label
        open_pairs = index[label[index] != label[index + lag]]
        if len(open_pairs):
            found = open_pairs[linked(open_pairs, open_pairs + lag)]
            for a in found.tolist():
                x, y = find(a), find(a + lag)
                parent[max(x, y)] = min(x, y)
            if len(found):
                label = np.asarray(parent)
                while not np.array_equal(up := label[label], label):
                    label = up
        lag += 1


def components(edges: DataFrame, most_rounds: int = 200) -> DataFrame:
    """(node, component) for every node of ``edges`` (two columns of one type).

    Each round moves every node to the neighbour, or itself, of lowest hash,
    and edges to what their ends became, until no edge is left; the moves are
    then composed. The order changes with the round, so chains shrink by a
    share of their length in each. Minima are combined before the shuffle. The
    joins read written tables, so a hub's rows are split at run time.
    """
    a, b = edges.columns[:2]
    current = cut_lineage(edges.select(F.col(a).alias("a"), F.col(b).alias("b")).filter("a <> b").distinct())
    moves: list[DataFrame] = []
    for turn in range(most_rounds):
        if current.isEmpty():
            break
        rank = lambda c, turn=turn: F.struct(F.xxhash64(F.col(c), F.lit(turn)).alias("r"), F.col(c).alias("n"))
        both = current.select(F.col("a").alias("node"), rank("b").alias("to")).unionByName(
            current.select(F.col("b").alias("node"), rank("a").alias("to"))
        )
        move = both.groupBy("node").agg(F.min("to").alias("to")).select("node", F.least(rank("node"), "to").getField("n").alias("to"))
        moves.append(cut_lineage(move))
        left, right = moves[-1].toDF("a", "x"), moves[-1].toDF("b", "y")
        moved = current.join(left, "a").join(right, "b").filter("x <> y")
        current = cut_lineage(moved.select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).distinct())
    else:
        raise RuntimeError(f"components still changing after {most_rounds} rounds")
    if not moves:
        return current.select(F.col("a").alias("node"), F.col("b").alias("component"))
    found = moves[0].toDF("node", "component")
    for move in moves[1:]:
        step = move.toDF("component", "next")
        found = found.join(step, "component", "left").select("node", F.coalesce("next", "component").alias("component"))
    return found
