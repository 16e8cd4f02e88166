"""Order MinHash fingerprints, and their likeness to an edited text's.

A k-mer of code points with the number of its occurrence is one element. Each of
``SLOTS`` slots takes, of the elements whose hash falls to it, the ``TAKEN`` of
lowest hash, puts them in the order of their places in the text and hashes that
tuple; so a slot agrees where the same elements stand in the same order. (One
hash per element deals it to a slot; that needs one pass instead of one per
slot.) Likeness is the share of agreeing slots among those either text fills.

``edited_pairs`` needs each document's successor. Ids are cut into ranges at ids
that exist, so the first row of the next range, which is sent along, closes each
range, and no window spans the table.

Defined cases: null text is empty; a text shorter than k is one element, an empty
one has none and equals only empty ones; null doc_ids come first; rows that
repeat a doc_id stand in order of a hash of their text; a single row is its own
successor; extra columns are not read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fieldproof.llm.common import whole_text

K, SLOTS, TAKEN = 10, 64, 2
RANGE_ROWS = 500
_FIRST = -(1 << 63)
_B = [pow(0x9E3779B97F4A7C15, e, 1 << 64) for e in range(K + 1)]
_PLACE = np.uint64((1 << 20) - 1)


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(31))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(33))


def _kmers(text: str) -> np.ndarray:
    """A hash of every run of K code points; of the whole text where it is shorter."""
    c = np.frombuffer(text.encode("utf-32-le"), np.uint32).astype(np.uint64) + np.uint64(1)
    if len(c) < K:
        return _mix(np.array([sum(int(x) * b for x, b in zip(c, _B)) + len(c) & (1 << 64) - 1], np.uint64))
    two = c[:-1] + c[1:] * np.uint64(_B[1])
    four = two[:-2] + two[2:] * np.uint64(_B[2])
    eight = four[:-4] + four[4:] * np.uint64(_B[4])
    return _mix(eight[:len(c) - K + 1] + two[8:] * np.uint64(_B[8]))


def _by_hash(high: np.ndarray, place: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(hashes of 44 bits, places) in order of both."""
    if len(high) <= 1 << 20:
        packed = np.sort(high << np.uint64(20) | place)
        return packed >> np.uint64(20), packed & _PLACE
    order = np.lexsort((place, high))
    return high[order], place[order]


def signature(text: str) -> np.ndarray:
    """One number of 16 bits a slot, 0 for an empty slot."""
    out = np.zeros(SLOTS, np.uint16)
    if not text:
        return out
    kmers = _kmers(text)
    same, place = _by_hash(kmers >> np.uint64(20), np.arange(len(kmers), dtype=np.uint64))
    index = np.arange(len(same))
    first = np.r_[True, same[1:] != same[:-1]]
    nth = index - np.maximum.accumulate(np.where(first, index, 0))
    element = _mix(same * np.uint64(0xD6E8FEB86659FD93) + nth.astype(np.uint64)) >> np.uint64(20)
    element, place = _by_hash(element, place)
    edge = np.searchsorted(element, np.arange(SLOTS, dtype=np.uint64) << np.uint64(44 - SLOTS.bit_length() + 1))
    count = np.diff(np.r_[edge, len(element)])
    at = np.minimum(edge[:, None] + np.arange(TAKEN), len(element) - 1)
    there = np.arange(TAKEN) < count[:, None]
    where = np.where(there, place[at].astype(np.int64), np.iinfo(np.int64).max)
    ordered = np.take_along_axis(np.where(there, element[at], np.uint64(0)), np.argsort(where, axis=1, kind="stable"), axis=1)
    tuples = np.zeros(SLOTS, np.uint64)
    for i in range(TAKEN):
        tuples = _mix(tuples * np.uint64(_B[1]) + ordered[:, i] + np.uint64(i))
    filled = count > 0
    out[filled] = (tuples[filled] % np.uint64(65_535)).astype(np.uint16) + np.uint16(1)
    return out


def likeness(a: np.ndarray, b: np.ndarray) -> float:
    filled = (a > 0) | (b > 0)
    return float((a == b)[filled].mean()) if filled.any() else 1.0


def _hex(signature_: np.ndarray) -> str:
    return signature_.astype(">u2").tobytes().hex()


def _cuts(ids: DataFrame) -> tuple[list[int], int | None]:
    """Ids, ascending, that each begin a range, and the smallest id; as many ranges as shuffle partitions need.

    Each cut is the least id of a range partition, as a long: quantiles are
    doubles, which miss ids beyond 2^53.
    """
    size = ids.agg(F.count(F.lit(1)).alias("n"), F.min("id").alias("least")).first()
    partitions = int(ids.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ranges = max(1, min(size.n // RANGE_ROWS, 4 * partitions))
    if ranges == 1:
        return [], size.least

    def least(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found = [pc.min(batch.column(0)).as_py() for batch in batches if batch.num_rows]
        if found:
            yield pa.RecordBatch.from_arrays([pa.array([min(found)], pa.int64())], ["id"])

    found = ids.repartitionByRange(ranges, "id").mapInArrow(least, "id long").collect()
    return sorted({row.id for row in found} - {size.least}), size.least


def edited_pairs(docs: DataFrame) -> DataFrame:
    """doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next of every row.

    The edited text is the document with its last floor(n_chars / 2) code points
    replaced by the first as many of the next document.
    """
    cuts, least = _cuts(docs.select(F.coalesce(F.col("doc_id").cast("long"), F.lit(_FIRST)).alias("id")))
    if least is None:
        cuts, least = [], _FIRST
    text = whole_text("text")
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64(text).alias("h"), text.alias("text"))

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        begins, starts = np.array(cuts, np.int64), {c: i for i, c in enumerate(cuts)}
        for batch in batches:
            out: list[tuple] = []
            for doc, h, t in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2)):
                t = t.as_py()
                key = _FIRST if doc is None else doc
                raw = t.encode()
                body, sign = pa.compress(raw, "zstd", asbytes=True), signature(t).tobytes()
                row = (doc, key, h, len(raw), body, sign)
                out.append((int(np.searchsorted(begins, key, "right")), 0, *row))
                if key in starts:
                    out.append((starts[key], 1, *row))
                if key == least:
                    out.append((len(cuts), 1, *row))
            yield pa.RecordBatch.from_arrays(
                [pa.array(c, k) for c, k in zip(zip(*out), kinds)], ["part", "ahead", "doc_id", "key", "h", "size", "body", "sign"]
            )

    kinds = [pa.int32(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.binary(), pa.binary()]
    dealt = rows.mapInArrow(deal, "part int, ahead int, doc_id long, key long, h long, size long, body binary, sign binary")
    order = dealt.repartition("part").sortWithinPartitions("part", "ahead", "key", "h")

    def edit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = None
        for batch in batches:
            out: list[tuple] = []
            for part, ahead, doc, _, _, size, body, sign in zip(*(c.to_pylist() for c in batch.columns)):
                t = pa.decompress(body, size, "zstd", asbytes=True).decode()
                own = np.frombuffer(sign, np.uint16)
                if held and held[0] == part:
                    _, before_doc, before, before_sign = held
                    half = len(before) // 2
                    edited = before[:len(before) - half] + t[:half]
                    edited_sign = signature(edited)
                    out.append((
                        before_doc, len(before), hashlib.sha256(edited.encode()).hexdigest(), _hex(before_sign), _hex(edited_sign),
                        likeness(before_sign, edited_sign), likeness(before_sign, own),
                    ))
                elif held:
                    raise ValueError(f"range {held[0]} of ids has no closing row")
                held = None if ahead else (part, doc, t, own)
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out), result)], names)
        if held:
            raise ValueError(f"range {held[0]} of ids has no closing row")

    names = ["doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"]
    result = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.float64(), pa.float64()]
    return order.mapInArrow(edit, "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double")
