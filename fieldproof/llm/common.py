"""Small helpers shared by the operators of this folder."""

from __future__ import annotations

import re
from collections.abc import Callable, Iterable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: A word is a run without ASCII white space.
WORD = r"[^\x20\x09-\x0D]+"
_WORD_BYTES = re.compile(WORD.encode())


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def whole_text(column: str | Column) -> Column:
    """The text, empty where null."""
    return F.coalesce(F.col(column) if isinstance(column, str) else column, F.lit(""))


def lower_words(text: str) -> list[bytes]:
    """Words of the text in UTF-8 with A-Z lower-cased; bytes.lower and bytes.split know ASCII only."""
    return text.encode().lower().split()


def word_runs(text: str, size: int, overlap: int) -> Iterator[list[bytes]]:
    """The words in runs of ``size``, each repeating the last ``overlap`` words before it.

    A text of usual length is one run; only a very long one is cut, so that its
    words never stand in memory together.
    """
    data = text.encode().lower()
    if len(data) <= 4 * size:
        yield data.split()
        return
    run: list[bytes] = []
    for match in _WORD_BYTES.finditer(data):
        run.append(match.group())
        if len(run) == size:
            yield run
            run = run[size - overlap:]
    yield run


#: Python objects are made of so many bytes of a batch at once.
SLICE_BYTES = 4 << 20


def slices(batch: pa.RecordBatch, most: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """The batch in runs of rows of about ``most`` bytes."""
    rows = max(1, batch.num_rows * most // max(1, batch.nbytes))
    for low in range(0, batch.num_rows, rows):
        yield batch.slice(low, rows)


def map_batches(df: DataFrame, fn: Callable[[pa.RecordBatch], pa.RecordBatch | Iterable[pa.RecordBatch]], schema: str) -> DataFrame:
    """``fn`` on every Arrow batch of ``df``, in slices of bounded size."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch):
                out = fn(part)
                if isinstance(out, pa.RecordBatch):
                    yield out
                else:
                    yield from out

    return df.mapInArrow(run, schema)
