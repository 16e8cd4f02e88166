"""Passages that repeat inside paragraphs that are else unlike.

Every run of ``PASSAGE_WORDS`` words, lines aside, is a sliding paragraph; its
signature is one MinHash over its runs of ``RUN_WORDS`` words (one band of one row:
the run of least hash), so two equal passages of that length always share a
chosen run, wherever they stand. Shared runs are candidates only. Neighbouring
sliding paragraphs of one chosen run are a block, one row with a 128-bit digest
of all its words, so the rows follow the runs and not the words. Equal blocks are
one class. Where all places of a run are one class, the class decides; where
they are several (the ends of an equal passage), the sliding paragraphs of one
place of each class are compared by digests of their words. Of equal ones the
first place (smallest doc_id, then word) stays, every other one is a removal.
Neighbouring sliding paragraphs with neighbouring first places are one span, so
a span is the whole equal passage and never shorter than ``PASSAGE_WORDS``. Where
fewer than ``PASSAGE_WORDS`` words come round again and again, their first places
do too; that is one span as well, and its first place may hold fewer rounds.

A removal always points at an earlier place. That place may in part be inside a
removal itself, which points further back; so each removed word stays somewhere.
Lines that are removed for one that is only similar are left out by ``barriers``:
no sliding paragraph reaches into them, so none points at words that go.

Defined cases: null text and texts of fewer words have no passages; where one
word repeats, only the first of equal neighbouring runs is chosen, and sliding
paragraphs of one word alone are always candidates; one that overlaps its own
first place is no removal; null doc_ids come last in the order of places; rows
that repeat doc_id and text have the same places; extra columns are not read.
"""

from __future__ import annotations

import re
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fieldproof.llm.common import WORD, lower_words, map_batches
from fieldproof.session import cut_lineage

#: Equal passages of so many words are always found, by runs of so many.
PASSAGE_WORDS, RUN_WORDS = 50, 25

_BASE = np.uint64(0x9E3779B97F4A7C15)
_POWERS = np.cumprod(np.full(RUN_WORDS, _BASE, np.uint64))
_SPANS = "doc_id long, h long, first_word int, n_words int, kept_doc_id long, kept_first_word int, kept boolean"
_WORD = re.compile(WORD)


def run_hashes(words: list[bytes]) -> np.ndarray:
    """Hash of every run of RUN_WORDS words: a polynomial of the words' XXH64, modulo 2^64."""
    each = np.array([xxhash.xxh64_intdigest(w) for w in words], np.uint64)
    out = np.zeros(len(words) - RUN_WORDS + 1, np.uint64)
    for j, power in enumerate(_POWERS):
        out += each[j:j + len(out)] * power
    return out


def _least_runs(found: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(first word of the run of least hash of every sliding paragraph, whether each run can be chosen)."""
    none = np.iinfo(np.uint64).max
    order = np.where(np.r_[False, found[1:] == found[:-1]], none, found)
    size = PASSAGE_WORDS - RUN_WORDS + 1
    least = np.lib.stride_tricks.sliding_window_view(order, size).argmin(axis=1)
    return least + np.arange(len(least)), order < none


def chosen_runs(words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """(first word, hash) of the run of least hash of every sliding paragraph, each once."""
    if len(words) < PASSAGE_WORDS:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    found = run_hashes(words)
    least, able = _least_runs(found)
    first = np.unique(least)
    first = first[able[first]]
    return first, found[first].view(np.int64)


def _byte_starts(words: list[bytes]) -> np.ndarray:
    """Where every word begins in the words joined by one space, and where a next one would."""
    return np.cumsum(np.r_[0, np.array([len(w) + 1 for w in words], np.int64)])


def blocks(words: list[bytes], firsts: Iterable[int], closed: Iterable[tuple[int, int]] = ()) -> Iterator[tuple[int, int, bool, int, bytes]]:
    """(first word, sliding paragraphs, whether of one word alone, hash of the run, digest of the words) of every block.

    A block is neighbouring sliding paragraphs that chose one run at one of ``firsts``, or that have one word
    alone: those are equal, and the digest is that of one of them. None reaches into ``closed`` (first word, end).
    """
    if len(words) < PASSAGE_WORDS:
        return
    found = run_hashes(words)
    least, able = _least_runs(found)
    wanted = ~able
    wanted[list(firsts)] = True
    open_ = wanted[least]
    for low, high in closed:
        open_[max(0, low - PASSAGE_WORDS + 1):high] = False
    at = np.flatnonzero(open_)
    if not len(at):
        return
    flat = ~able[least]
    run = np.where(flat, -1, least)
    begins = np.flatnonzero(np.r_[True, (at[1:] != at[:-1] + 1) | (run[at[1:]] != run[at[:-1]])])
    ends = np.r_[begins[1:], len(at)]
    data, start = b" ".join(words), _byte_starts(words)
    for low, high in zip(at[begins].tolist(), at[ends - 1].tolist()):
        alone = bool(flat[low])
        end = (low if alone else high) + PASSAGE_WORDS
        yield low, high - low + 1, alone, int(found[least[low]].view(np.int64)), xxhash.xxh3_128_digest(data[start[low]:start[end] - 1])


def _line_words(text: str, lines: set[int]) -> list[tuple[int, int]]:
    """(first word, end) of the numbered lines."""
    out, at = [], 0
    for number, line in enumerate(text.split("\n")):
        n = len(lower_words(line))
        if number in lines:
            out.append((at, at + n))
        at += n
    return out


_BLOCKS = "doc_id long, h long, first_word int, n int, flat boolean, run long, block binary"
_WINDOWS = "block binary, j int, passage binary"


def _as_batch(rows: list[tuple], kinds: list[pa.DataType], names: list[str]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], names)


def _found_blocks(rows: pa.RecordBatch, most: int = 20_000) -> Iterator[pa.RecordBatch]:
    kinds = [pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.bool_(), pa.int64(), pa.binary()]
    names = ["doc_id", "h", "first_word", "n", "flat", "run", "block"]
    out: list[tuple] = []
    for doc, h, text, firsts, lines in zip(*rows.columns):
        text, lines = text.as_py(), lines.as_py()
        closed = _line_words(text, set(lines)) if lines else ()
        for block in blocks(lower_words(text), firsts.as_py(), closed):
            out.append((doc.as_py(), h.as_py(), *block))
            if len(out) >= most:
                yield _as_batch(out, kinds, names)
                out = []
    if out:
        yield _as_batch(out, kinds, names)


def _windows(rows: pa.RecordBatch, most: int = 20_000) -> Iterator[pa.RecordBatch]:
    """Digest of every sliding paragraph of the named blocks of each text."""
    kinds, names = [pa.binary(), pa.int32(), pa.binary()], ["block", "j", "passage"]
    out: list[tuple] = []
    for text, named in zip(*rows.columns):
        words = lower_words(text.as_py())
        data, start = b" ".join(words), _byte_starts(words)
        for b in named.as_py():
            for j in range(b["n"]):
                first = b["first_word"] + j
                out.append((b["block"], j, xxhash.xxh3_128_digest(data[start[first]:start[first + PASSAGE_WORDS] - 1])))
            if len(out) >= most:
                yield _as_batch(out, kinds, names)
                out = []
    if out:
        yield _as_batch(out, kinds, names)


def _runs(rows: pa.RecordBatch, most: int = 100_000) -> Iterator[pa.RecordBatch]:
    yield from _by_place(rows, (chosen_runs(lower_words(t.as_py())) for t in rows.column(2)), "run", most)


def _by_place(rows: pa.RecordBatch, found: Iterable[tuple[np.ndarray, np.ndarray]], name: str, most: int) -> Iterator[pa.RecordBatch]:
    """One row per (first word, hash) found in each text, about ``most`` at a time."""
    kept: list[tuple[np.ndarray, np.ndarray, int]] = []
    names = ["doc_id", "h", "first_word", name]

    def flush() -> pa.RecordBatch:
        at = pa.array(np.repeat([k[2] for k in kept], [len(k[0]) for k in kept]))
        first, run = (np.concatenate([k[i] for k in kept]) for i in (0, 1))
        kept.clear()
        return pa.RecordBatch.from_arrays([rows.column(0).take(at), rows.column(1).take(at), pa.array(first.astype(np.int32)), pa.array(run)], names)

    held = 0
    for place, (first, run) in enumerate(found):
        if len(first):
            kept.append((first, run, place))
            held += len(first)
        if held >= most:
            yield flush()
            held = 0
    if kept:
        yield flush()


def _places(texts: DataFrame) -> DataFrame:
    """doc_id, h, first_word, run of every chosen run of more than one place.

    ``texts`` has doc_id, h (hash of the text) and text. Values are counted
    first, alone and combined before the shuffle, so only places of repeated
    ones go on; the joins read written tables, where a hot value is split.
    """
    runs = cut_lineage(map_batches(texts, _runs, "doc_id long, h long, first_word int, run long"))
    again = cut_lineage(runs.groupBy("run").agg(F.count(F.lit(1)).alias("n")).filter("n > 1").select("run"))
    return cut_lineage(runs.join(again, "run"))


def _place() -> Column:
    return F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "h", "first_word")


def repeated_runs(texts: DataFrame) -> DataFrame:
    """doc_id, h, first_word, kept_doc_id, kept_first_word, kept of every chosen run of more than one place."""
    places = _places(texts)
    kept = cut_lineage(places.groupBy("run").agg(F.min(_place()).alias("keep")))
    same = F.col("doc_id").eqNullSafe(F.col("keep.doc_id")) & (F.col("h") == F.col("keep.h")) & (F.col("first_word") == F.col("keep.first_word"))
    return places.join(kept, "run").select(
        "doc_id", "h", "first_word", F.col("keep.doc_id").alias("kept_doc_id"), F.col("keep.first_word").alias("kept_first_word"), same.alias("kept"),
    )


def _pieces(first: int, n: int, flat: bool, parts: list[dict]) -> Iterator[tuple[int, int, int, int, dict]]:
    """(first word, sliding paragraphs, kept first word, step of the kept place, part) without what overlaps its own first place."""
    for part in parts:
        low, kept = first + part["j"], part["keep"]["first_word"]
        if not flat:
            if not (part["own"] and 0 < low - kept < PASSAGE_WORDS):
                yield low, part["n"], kept, 1, part
        elif not (part["own"]):
            yield low, n, kept, 0, part
        else:
            if low == kept:
                yield low, 1, kept, 0, part
            far = max(low, kept + PASSAGE_WORDS)
            if far < low + n:
                yield far, low + n - far, kept, 0, part


def _joined(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Spans of neighbouring sliding paragraphs; the blocks come in the order of their places."""
    kinds = [pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.int64(), pa.int32(), pa.bool_()]
    names = ["doc_id", "h", "first_word", "n_words", "kept_doc_id", "kept_first_word", "kept"]
    at = last = seen = None

    def span() -> tuple:
        doc, h, kept_doc, kept_h = at[:4]
        return doc, h, at[4], last[0] - at[4] + PASSAGE_WORDS, kept_doc, at[5], (doc, h, at[4]) == (kept_doc, kept_h, at[5])

    out: list[tuple] = []
    for batch in batches:
        for doc, h, first, n, flat, parts in zip(*(c.to_pylist() for c in batch.columns)):
            if seen == (doc, h, first):
                continue  # a row that repeats doc_id and text
            seen = (doc, h, first)
            for part in parts:
                part["own"] = (doc, h) == (part["keep"]["doc_id"], part["keep"]["h"])
            for low, size, kept, step, part in _pieces(first, n, flat, parts):
                where = [doc, h, part["keep"]["doc_id"], part["keep"]["h"]]
                # Where words come round (one word alone, or a few), so do the first places; two that overlap say they do.
                if not (at and where == at[:4] and low == last[0] + 1 and 0 <= last[1] + 1 - kept < PASSAGE_WORDS):
                    if at:
                        out.append(span())
                    at = [*where, low, kept]
                last = (low + size - 1, kept + (size - 1) * step)
        if out:
            yield _as_batch(out, kinds, names)
            out = []
    if at:
        yield _as_batch([span()], kinds, names)


def _decided(found: DataFrame, texts: DataFrame) -> DataFrame:
    """block, parts of every class of ``found`` that repeats: the first place of each stretch of its sliding paragraphs."""
    last = F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "h", (F.col("first_word") + F.when(F.col("flat"), F.col("n") - 1).otherwise(0)).alias("first_word"))
    classes = cut_lineage(
        found.groupBy("run", "block")
        .agg(F.min(_place()).alias("keep"), F.max(last).alias("last"), F.max(F.when(F.col("flat"), 1).otherwise(F.col("n"))).alias("n"))
    )
    mixed = cut_lineage(classes.groupBy("run").agg(F.count(F.lit(1)).alias("classes")).filter("classes > 1").select("run"))
    part = lambda j, n, keep: F.struct(j.cast("int").alias("j"), n.cast("int").alias("n"), keep.alias("keep"))
    alone = classes.join(mixed, "run", "left_anti").filter("keep < last").select(
        "block", F.array(part(F.lit(0), F.col("n"), F.col("keep"))).alias("parts")
    )
    several = cut_lineage(classes.join(mixed, "run").select("block", "keep", "last", "n"))
    wanted = cut_lineage(
        several.groupBy(F.col("keep.doc_id").alias("id"), F.col("keep.h").alias("hash"))
        .agg(F.collect_list(F.struct("block", "keep.first_word", "n")).alias("named"))
    )
    # Rows that repeat doc_id and text would repeat their sliding paragraphs; grouped below, they change nothing.
    some = texts.join(wanted, texts.doc_id.eqNullSafe(wanted.id) & (texts.h == wanted.hash)).select("text", "named")
    shifted = lambda place: F.col(place).withField("first_word", F.col(f"{place}.first_word") + F.col("j"))
    windows = cut_lineage(
        map_batches(some, _windows, _WINDOWS).join(several, "block").select("block", "j", "passage", shifted("keep").alias("keep"), shifted("last").alias("last"))
    )
    first = cut_lineage(windows.groupBy("passage").agg(F.min("keep").alias("keep"), F.max("last").alias("last")).filter("keep < last").select("passage", "keep"))
    by_window = (
        windows.select("block", "j", "passage").join(first, "passage").groupBy("block")
        .agg(F.sort_array(F.collect_set(part(F.col("j"), F.lit(1), F.col("keep")))).alias("parts"))
    )
    return cut_lineage(alone.unionByName(by_window))


def repeated_spans(texts: DataFrame, barriers: DataFrame | None = None) -> DataFrame:
    """doc_id, h, first_word, n_words, kept_doc_id, kept_first_word, kept of every passage of more than one place.

    Each span is as long as it equals its first place, or goes round in it, PASSAGE_WORDS at least.
    ``barriers`` (doc_id, h, line) are lines that no passage reaches into.
    """
    firsts = _places(texts).select("doc_id", "h", "first_word", F.lit(None).cast("int").alias("line"))
    if barriers is not None:
        firsts = firsts.unionByName(barriers.select("doc_id", "h", F.lit(None).cast("int").alias("first_word"), "line"))
    near = cut_lineage(
        firsts.groupBy(F.col("doc_id").alias("id"), F.col("h").alias("hash"))
        .agg(F.collect_set("first_word").alias("firsts"), F.collect_set("line").alias("lines"))
    )
    some = texts.join(near, texts.doc_id.eqNullSafe(near.id) & (texts.h == near.hash)).select("doc_id", "h", "text", "firsts", "lines")
    found = cut_lineage(map_batches(some, _found_blocks, _BLOCKS))
    return (
        found.select("doc_id", "h", "first_word", "n", "flat", "block").join(_decided(found, texts), "block")
        .select("doc_id", "h", "first_word", "n", "flat", "parts")
        .repartition("doc_id", "h").sortWithinPartitions("doc_id", "h", "first_word")
        .mapInArrow(_joined, _SPANS)
    )


def cut(text: str, lines: Iterable[int], first_words: Iterable[int], least_words: int = 0) -> str:
    """The text without the numbered lines and without the runs that begin at the numbered words.

    Lines of fewer than ``least_words`` words keep what a run has of them; a line
    of which nothing but white space is left goes too.
    """
    return cut_spans(text, lines, [(first, RUN_WORDS) for first in first_words], least_words)


def cut_spans(text: str, lines: Iterable[int], passages: Iterable[tuple[int, int]], least_words: int = 0) -> str:
    """As ``cut``, with passages of (first word, number of words)."""
    gone, wanted = set(lines), sorted({tuple(p) for p in passages})
    words = [m.span() for m in _WORD.finditer(text)] if wanted else []
    spans: list[list[int]] = []
    for first, n in wanted:
        low, high = words[first][0], words[first + n - 1][1]
        if spans and low <= spans[-1][1] + 1:
            spans[-1][1] = max(spans[-1][1], high)
        else:
            spans.append([low, high])
    out, at, k = [], 0, 0
    for number, line in enumerate(text.split("\n")):
        end = at + len(line)
        if number not in gone:
            parts, low = [], at
            while k < len(spans) and spans[k][1] < at:
                k += 1
            here = k
            while here < len(spans) and spans[here][0] < end:
                parts.append(text[low:max(low, spans[here][0])])
                low = max(low, min(end, spans[here][1]))
                here += 1
            whole = here == k or len(line.split()) < least_words
            left = line if whole else "".join([*parts, text[low:end]])
            if whole or left.strip():
                out.append(left)
        at = end + 1
    return "\n".join(out)
