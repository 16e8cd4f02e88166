"""Logistic mixing of hashed-context bit predictors.

A text is its token sequence: words, A-Z lower-cased, each with a space after it,
then an end. Its bytes are symbols of five bits for the 31 most frequent bytes, an
escape and eight bits for the rest; the end is an escape of a byte that UTF-8
lacks. Contexts are the last two or six bytes of the word so far, and the last
three or six with the document's state; a hash of each picks a row of a table of
fixed size, and the node in the tree of bits a predictor. What the rows hold are
counts over all training texts, added up in Spark and turned into log-odds once;
tasks map the table from the shared folder into memory. A bit's log-odds are
mixed by weights gated by its level and by how often its context was seen. The
weights a text begins with are fitted by Newton steps over every training token
until they settle: the texts fall into two halves (equal texts into one), each
half's tokens meet the table of the other, and tasks send sums of gradients and
curvatures alone.

Three things adapt while a text is read, all from what stands before: the weights,
moved by a gradient step after every byte; the state, which kind of document this
is by its frequent words so far; and the share of the state's prediction against
the neutral one under the fitted weights, moved by a step after every block. Kinds are clusters of the training texts' most frequent words by what they
stand beside, from a table of all training texts. The sum of -log p is the text's
cost. Contexts end at the word, so a task looks a word's log-odds up once per state, and
counts of words by state and half are all that the tables and the fit need.

Token counts for the base score are exact: the ``FREQUENT`` most frequent tokens
go to the tasks, all others are joined.

Defined cases: null text is empty (its end still counts); a null doc_id's text is
empty, so it is held out; repeated rows are scored each; without training tokens
the tables are empty, there is one state and every bit costs one bit; extra
columns are not read.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Callable, Iterator, Sequence
from dataclasses import dataclass, field
from functools import reduce
from itertools import islice, repeat
from urllib.parse import unquote, urlparse

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyarrow import fs
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fieldproof.llm.common import slices, whole_text
from fieldproof.session import cut_lineage, scratch_path

#: Bytes of the word that a context sees, whether it sees the state, and the bits of a row number in its table.
REACH, WITH_STATE, ROW_BITS = (2, 3, 6, 6), (False, True, False, True), (16, 18, 18, 19)
FIRST_CELL = [sum(1 << b + 5 for b in ROW_BITS[:k]) for k in range(len(ROW_BITS) + 1)]
CHUNK, ESCAPE_CELLS, ESCAPE, END_BYTE = 1 << 13, 1 << 16, 31, 0xFF
TABLE_CELLS = FIRST_CELL[-1] + ESCAPE_CELLS
#: Ranges of cells, (first, end), of which a task counts one: a quarter of the table at most, or little more.
_BOUNDS = [0, FIRST_CELL[2], FIRST_CELL[3], (FIRST_CELL[3] + FIRST_CELL[4]) // 2, TABLE_CELLS]
RANGES = list(zip(_BOUNDS, _BOUNDS[1:]))
#: Frequent tokens sent to the tasks; distinct words a task remembers, bytes of texts it splits and rows it sends at once.
FREQUENT, REMEMBERED, BYTES_AT_ONCE, ROWS_AT_ONCE = 1 << 18, 150_000, 1 << 20, 50_000
#: Bytes of texts that are scored together, byte by byte.
BYTES_ABREAST = 1 << 22
STATES, STATE_WORDS, BESIDE_SCALE = 6, 300, 256.0
WORDS_AT_ONCE, SHARE_RATE, WEIGHT_RATE = 10_000, 0.5, 0.015
SETTLED, FIT_WORDS, MOST_STEP, START, PRIOR, FOLDS = 0.02, 20_000, 0.4, 0.35, 20.0, 2
#: Where the blocks of a text end: each is about four times as long as those before it.
BLOCK_ENDS = np.array([8 * 4 ** k for k in range(24)], np.int64)
SCALE, GATES, MOST_LOG_ODDS = 12.0, 12, 17.0  # of log-odds in a table of bytes; of weights; of a mixed bit
END = b"\n"

_CODE = np.arange(32)
_PATH = np.array([[(1 << b) | (s >> (5 - b)) for b in range(5)] for s in _CODE], np.int32)
_BITS = np.array([[(s >> (4 - b)) & 1 for b in range(5)] for s in _CODE], np.int8)
_PATH8 = np.array([[(1 << b) | (s >> (8 - b)) for b in range(8)] for s in range(256)], np.int32)
_BITS8 = np.array([[(s >> (7 - b)) & 1 for b in range(8)] for s in range(256)], np.int8)
_MULT = np.uint64(0x9E3779B97F4A7C15)


def held_out(doc_id: Column) -> Column:
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % 10 == 0


def symbols(words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, place in its word of each byte) of tokens, each closed by a space; the end is one byte."""
    data = np.frombuffer(b"".join([bytes([END_BYTE]) if w == END else w + b" " for w in words]), np.uint8)
    first = np.r_[True, (data[:-1] == 32) | (data[:-1] == END_BYTE)][:len(data)]
    index = np.arange(len(data))
    return data, index - np.maximum.accumulate(np.where(first, index, 0))


def context_rows(data: np.ndarray, place: np.ndarray, state: np.ndarray | int, wanted: Sequence[int] = range(len(REACH))) -> list[np.ndarray]:
    """For each of the ``wanted`` contexts the first cell of the row of every byte."""
    value, rows = np.zeros(len(data), np.uint64), []
    byte = data.astype(np.uint64) + np.uint64(1)
    for back in range(1, max((REACH[k] for k in wanted), default=0) + 1):
        there = np.zeros(len(data), np.uint64)
        there[back:] = byte[:-back]
        there[place < back] = 0
        value = value * np.uint64(259) + there
        for k in (k for k in wanted if REACH[k] == back):
            seen = value * np.uint64(16) + np.asarray(state, np.uint64) if WITH_STATE[k] else value
            rows.append(((seen + np.uint64(k + 1)) * _MULT >> np.uint64(64 - ROW_BITS[k])).astype(np.int64) * 32 + FIRST_CELL[k])
    return rows


def _before(data: np.ndarray, place: np.ndarray, where: np.ndarray) -> np.ndarray:
    """The byte before each, in its word; 0 at its begin."""
    return np.where(place[where] > 0, data[np.maximum(where - 1, 0)], 0).astype(np.int64)


def _fresh(data: np.ndarray, place: np.ndarray) -> np.ndarray:
    """Which bytes a word does not share with the begin of the word before it."""
    starts = np.flatnonzero(place == 0)
    lengths = np.diff(np.r_[starts, len(data)])
    other = np.repeat(np.r_[0, starts[:-1]], lengths) + place
    there = place < np.repeat(np.r_[0, lengths[:-1]], lengths)
    unlike = ~there | (data[np.where(there, other, 0)] != data)
    shared = np.minimum.reduceat(np.where(unlike, place, place + len(data)), starts)
    return place >= np.repeat(shared, lengths)


def _sources(fresh: np.ndarray, place: np.ndarray) -> np.ndarray:
    """The fresh byte that each byte equals: the last one at the same place of a word."""
    order = np.argsort(place.astype(np.uint16) if place.max(initial=0) < 1 << 16 else place, kind="stable")
    last = np.maximum.accumulate(np.where(fresh[order], np.arange(len(order)), 0))
    out = np.empty(len(fresh), np.int64)
    out[order] = order[last]
    return out


def _spread(cost: np.ndarray, fresh: np.ndarray, place: np.ndarray) -> np.ndarray:
    """Costs of all bytes from those of the fresh ones."""
    by_byte = np.zeros(len(fresh))
    by_byte[fresh] = cost
    return by_byte[_sources(fresh, place)]


def codes_of(bytes_in_order: list[int]) -> np.ndarray:
    """Five-bit code of every byte; ESCAPE where it has none."""
    code = np.full(256, ESCAPE, np.uint8)
    code[bytes_in_order[:ESCAPE]] = np.arange(len(bytes_in_order[:ESCAPE]))
    return code


def _log_odds(counts: np.ndarray, width: int) -> np.ndarray:
    """Scaled log-odds of a one at every node of the trees in rows of ``width`` symbol counts; node 0 has the gate."""
    below = np.zeros((counts.size // width, 2 * width), np.float32)
    below[:, width:] = counts.reshape(-1, width)
    for node in range(width - 1, 0, -1):
        below[:, node] = below[:, 2 * node] + below[:, 2 * node + 1]
    zero, one = below[:, 0::2].copy(), below[:, 1::2].copy()
    zero[:, 0] = one[:, 0] = 0
    odds = np.rint(np.log((one + 0.4) / (zero + 0.4)) * SCALE)
    odds[:, 0] = np.minimum(np.log2(below[:, 1] + 1), GATES - 1)
    return np.clip(odds, -127, 127).astype(np.int8).ravel()


@dataclass
class Model:
    code: np.ndarray
    path: str
    kinds: dict[bytes, int]  # place of the words that tell the states apart
    by_kind: np.ndarray  # log-probability of each such word by state
    weights: np.ndarray = field(default_factory=lambda: np.full((GATES, len(REACH), 5), START, np.float32))

    def table(self) -> np.ndarray:
        parts = urlparse(self.path)
        if parts.scheme in ("", "file"):
            return np.memmap(unquote(parts.path), np.int8, "r")
        store, place = fs.FileSystem.from_uri(self.path)
        with store.open_input_stream(place) as file:
            return np.frombuffer(file.read(), np.int8)


def tokens(column: pa.Array) -> tuple[np.ndarray, np.ndarray, list[bytes]]:
    """(number of every token, tokens of each text, the numbered words) of texts, ends included."""
    split = pc.ascii_split_whitespace(pc.ascii_lower(column))
    coded = split.flatten().dictionary_encode()
    words = coded.dictionary.cast(pa.binary()).to_pylist()
    code, size = coded.indices.to_numpy(), pc.list_value_length(split).to_numpy().astype(np.int64)
    text = np.repeat(np.arange(len(size)), size)
    if b"" in words:  # stands before and after outer white space
        there = code != words.index(b"")
        code, text = code[there], text[there]
    size = np.bincount(text, minlength=len(size))
    return np.insert(code, np.cumsum(size), len(words)), size + 1, [*words, END]


@dataclass
class Read:
    """Tokens of some texts as numbers, and their blocks: where each begins, its text, its place in it, its state."""

    ids: np.ndarray
    texts: int
    text: np.ndarray
    begin: np.ndarray
    size: np.ndarray
    block_text: np.ndarray
    block: np.ndarray
    state: np.ndarray


class Reader:
    """Numbers words in the order in which they are met and tells the states of texts."""

    def __init__(self, kinds: dict[bytes, int], by_kind: np.ndarray) -> None:
        self.kinds = kinds
        # The last kind is for all other words, which tell nothing.
        self.by_kind = np.vstack([by_kind, np.zeros((1, by_kind.shape[1]))])
        self.forget()

    def forget(self) -> None:
        self.number: defaultdict[bytes, int] = defaultdict()
        self.number.default_factory = self.number.__len__
        self.words: list[bytes] = []
        self.kind = np.zeros(0, np.int64)

    def read(self, column: pa.Array) -> Read:
        """The state of a block follows from the words of its text before it; it is 0 where they tell nothing."""
        code, lengths, distinct = tokens(column)
        ids = np.fromiter(map(self.number.__getitem__, distinct), np.int64, len(distinct))[code]
        fresh = list(islice(self.number, len(self.words), None))
        self.words += fresh
        other = len(self.kinds)
        self.kind = np.r_[self.kind, np.fromiter((self.kinds.get(w, other) for w in fresh), np.int64, len(fresh))]
        n = len(lengths)
        text = np.repeat(np.arange(n), lengths)
        place = np.arange(len(ids)) - np.repeat(np.cumsum(lengths) - lengths, lengths)
        number = np.searchsorted(BLOCK_ENDS, place, "right")
        begin = np.flatnonzero((place == 0) | np.r_[True, number[1:] != number[:-1]])
        size = np.diff(np.r_[begin, len(ids)])
        of, kind = np.repeat(np.arange(len(begin)), size), self.kind[ids]
        told = np.bincount(of, kind < other, len(begin))
        belief = np.stack([np.bincount(of, column[kind], len(begin)) for column in self.by_kind.T], axis=1)
        block_text, block, state = text[begin], number[begin], np.zeros(len(begin), np.int64)
        known, believed = np.zeros(n), np.zeros((n, belief.shape[1]))
        for k in range(int(block.max(initial=-1)) + 1):
            mine = np.flatnonzero(block == k)
            at = block_text[mine]
            state[mine] = np.where(known[at] > 0, 1 + believed[at].argmax(axis=1), 0)
            known[at] += told[mine]
            believed[at] += belief[mine]
        return Read(ids, n, text, begin, size, block_text, block, state)


def cluster(words: list[bytes], beside: np.ndarray) -> tuple[dict[bytes, int], np.ndarray]:
    """(words, log-probability by cluster) of a mixture of word distributions, by expectation maximization.

    ``beside`` has for each word how often which word stands in the same text.
    """
    if not len(words):
        return {}, np.zeros((0, 1))
    unit = beside / np.maximum(np.linalg.norm(beside, axis=1, keepdims=True), 1e-9)
    # Begin with words that are each as unlike the ones before as can be.
    seeds = [int(beside.sum(axis=1).argmax())]
    while len(seeds) < min(STATES, len(words)):
        seeds.append(int((unit @ unit[seeds].T).max(axis=1).argmin()))
    prob = beside[seeds] + beside.mean(axis=0) + 0.01
    for _ in range(20):
        log = np.log(prob / prob.sum(axis=1, keepdims=True)).T
        fit_ = beside @ log
        share = np.exp(fit_ - fit_.max(axis=1, keepdims=True))
        share /= share.sum(axis=1, keepdims=True)
        prob = share.T @ beside + 0.05
    return {w: i for i, w in enumerate(words)}, np.log(prob / prob.sum(axis=1, keepdims=True)).T


class Scorer:
    """Costs of words and texts under a model."""

    def __init__(self, model: Model) -> None:
        self.model, self.table = model, np.asarray(model.table())
        self.reader = Reader(model.kinds, model.by_kind)
        self.known: dict[int, np.ndarray] = {}

    def forget(self) -> None:
        self.reader.forget()
        self.known.clear()

    def word_costs(self, words: list[bytes], state: int) -> np.ndarray:
        """-ln p of every word with its closing space.

        Contexts end at the word, so bytes that a word shares with the begin of
        the word before it cost the same and are worked out once.
        """
        weights = self.model.weights
        data, place = symbols(words)
        once = _fresh(data, place)
        where_kept = np.flatnonzero(once)
        rows, sym = [row[once] for row in context_rows(data, place, state)], self.model.code[data[once]]
        path, sign = _PATH[sym], (2 * _BITS[sym] - 1).astype(np.float32)
        inputs = [self.table.take(row[:, None] + path).astype(np.float32) for row in rows]
        gate = self.table.take(rows[-1])
        z = np.zeros_like(sign)
        for k, x in enumerate(inputs):
            x *= np.float32(1 / SCALE)
            z += x * weights[:, k].take(gate, axis=0)
        z *= sign
        u = np.exp(-np.clip(z, -MOST_LOG_ODDS, MOST_LOG_ODDS, out=z))
        # The product of five terms stays in range, and one logarithm does for a symbol.
        cost = np.log((1 + u).prod(axis=1).astype(np.float64))
        escaped = np.flatnonzero(sym == ESCAPE)
        where = where_kept[escaped]
        odds = self.table[FIRST_CELL[-1]:][(_before(data, place, where) << 8)[:, None] + _PATH8[data[where]]].astype(np.float32) / SCALE
        cost[escaped] += np.log1p(np.exp(-odds * (2 * _BITS8[data[where]] - 1))).sum(axis=1, dtype=np.float64)
        cost = _spread(cost, once, place)
        return np.add.reduceat(cost, np.flatnonzero(place == 0)) if len(cost) else cost

    def curvature(self, words: list[bytes], state: np.ndarray, times: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(gradients, curvatures) of the log-likelihood of ``words``, each so many ``times``, by gate and level."""
        n = len(REACH)
        gradient, curve = np.zeros((GATES, 5, n)), np.zeros((GATES, 5, n, n))
        for s in np.unique(state).tolist():
            mine = sorted(zip((words[i] for i in np.flatnonzero(state == s).tolist()), times[state == s].tolist()))
            data, place = symbols([w for w, _ in mine])
            once = _fresh(data, place)
            # A fresh byte counts as often as the words that share it.
            weight = np.bincount(_sources(once, place), np.repeat([c for _, c in mine], np.diff(np.r_[np.flatnonzero(place == 0), len(place)])), len(data))[once]
            rows, sym = [row[once] for row in context_rows(data, place, s)], self.model.code[data[once]]
            path, sign = _PATH[sym], (2 * _BITS[sym] - 1).astype(np.float32)
            x = np.stack([self.table.take(row[:, None] + path).astype(np.float32) for row in rows], axis=2)
            x *= np.float32(1 / SCALE)
            gate = self.table.take(rows[-1])
            for g in np.unique(gate).tolist():
                at = np.flatnonzero(gate == g)
                for b in range(5):
                    some, signs, counts = x[at, b].astype(np.float64), sign[at, b], weight[at]
                    z = np.clip((some @ self.model.weights[g, :, b]) * signs, -MOST_LOG_ODDS, MOST_LOG_ODDS)
                    miss = 1 / (1 + np.exp(z))
                    gradient[g, b] += (counts * signs * miss) @ some
                    curve[g, b] += some.T @ (some * (counts * miss * (1 - miss))[:, None])
        return gradient, curve

    def _costs_of(self, state: int, ids: np.ndarray) -> np.ndarray:
        """Costs of numbered words under one state; those not met before are worked out."""
        known, words = self.known.get(state, np.zeros(0)), self.reader.words
        if len(known) < len(words):
            known = self.known[state] = np.r_[known, np.full(len(words) - len(known), np.nan)]
        missing = np.unique(ids[np.isnan(known[ids])])
        if len(missing):
            some = pa.array([words[i] for i in missing.tolist()], pa.binary())
            order = pc.sort_indices(some)
            some, missing = some.take(order), missing[order.to_numpy()]
            for at in range(0, len(some), WORDS_AT_ONCE):
                known[missing[at:at + WORDS_AT_ONCE]] = self.word_costs(some.slice(at, WORDS_AT_ONCE).to_pylist(), state)
        return known[ids]

    def _inputs(self, words: list[bytes], state: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """(log-odds of the bits that came, gate, cost of escaped bits) of every byte of words, and the words' lengths."""
        data, place = symbols(words)
        lengths = np.diff(np.r_[np.flatnonzero(place == 0), len(place)])
        rows, sym = context_rows(data, place, np.repeat(state, lengths)), self.model.code[data]
        odds = np.stack([self.table.take(row[:, None] + _PATH[sym]) for row in rows], axis=1)
        odds *= (2 * _BITS[sym] - 1)[:, None]
        odds = odds.reshape(len(data), -1)
        escaped, rest = np.flatnonzero(sym == ESCAPE), np.zeros(len(data), np.float32)
        spelled = self.table[FIRST_CELL[-1]:][(_before(data, place, escaped) << 8)[:, None] + _PATH8[data[escaped]]].astype(np.float32) / SCALE
        rest[escaped] = np.log1p(np.exp(-spelled * (2 * _BITS8[data[escaped]] - 1))).sum(axis=1)
        return odds, self.table.take(rows[-1]), rest, lengths

    def adapted(self, read: Read) -> np.ndarray:
        """-ln p of every token under its block's state, by weights that learn from every byte of the text before it.

        Each text begins with the fitted weights, and a gradient step follows
        each byte: its five bits have weights of their own, so they are taken
        at once. Texts are independent, so all of them take their next byte
        together; a word's log-odds under a state are looked up once.
        """
        states, state = self.reader.by_kind.shape[1] + 1, np.repeat(read.state, read.size)
        pair, which = np.unique(read.ids * states + state, return_inverse=True)
        parts = [self._inputs([self.reader.words[i] for i in (some // states).tolist()], some % states)
                 for some in (pair[at:at + WORDS_AT_ONCE] for at in range(0, len(pair), WORDS_AT_ONCE))]
        if not parts:
            return np.zeros(0)
        odds, gate, rest, lengths = (np.concatenate(c) for c in zip(*parts))
        gate, first = gate.astype(np.int32), np.cumsum(lengths) - lengths
        # The bytes of all tokens in order, as numbers of bytes of the looked-up words.
        size = lengths[which]
        begin = np.cumsum(size) - size
        byte = np.repeat((first[which] - begin).astype(np.int32), size)
        byte += np.arange(len(byte), dtype=np.int32)
        length = np.bincount(read.text, size, read.texts).astype(np.int64)
        order = np.argsort(-length, kind="stable")
        at, length = (np.cumsum(length) - length)[order], length[order]
        still = len(length) - np.searchsorted(length[::-1], np.arange(length.max(initial=0)), "right")  # texts that have a byte at each place
        weights = np.tile(self.model.weights.reshape(GATES, -1), (read.texts, 1))  # of every text by gate; four contexts of five levels
        own, product = np.arange(read.texts, dtype=np.int32) * np.int32(GATES), np.empty(len(byte), np.float32)
        over = np.tile(np.eye(5, dtype=np.float32), (len(REACH), 1))  # adds up contexts, or hands to each
        scale, least, most, rate = (np.float32(v) for v in (1 / SCALE, -MOST_LOG_ODDS, MOST_LOG_ODDS, WEIGHT_RATE))
        for k, m in enumerate(still.tolist()):
            spot = at[:m] + k
            here = byte.take(spot)
            row = gate.take(here)
            row += own[:m]
            x, w = odds.take(here, axis=0) * scale, weights.take(row, axis=0)
            u = np.exp(-np.minimum(np.maximum((w * x) @ over, least), most))
            v = 1 + u
            product[spot] = v[:, 0] * v[:, 1] * v[:, 2] * v[:, 3] * v[:, 4]  # stays in range
            u *= rate
            u /= v
            x *= u @ over.T
            w += x
            weights[row] = w
        np.log(product, out=product)
        product += rest.take(byte)
        return np.add.reduceat(product, begin, dtype=np.float64)

    def costs(self, read: Read) -> np.ndarray:
        """-ln p of each text that was read."""
        plain, own = self._costs_of(0, read.ids), self.adapted(read)
        block, total, lean = np.repeat(read.block, read.size), np.zeros(read.texts), np.full(read.texts, 2.0)
        for k in range(int(read.block.max(initial=-1)) + 1):
            mine, tokens = read.block == k, block == k
            text, size = read.block_text[mine], read.size[mine]
            begin = np.cumsum(size) - size
            share = 1 / (1 + np.exp(-lean[text]))
            each, rest = np.repeat(np.log(share), size) - own[tokens], np.repeat(np.log1p(-share), size) - plain[tokens]
            # ln of share * e^-own + (1 - share) * e^-plain
            both = np.logaddexp(each, rest)
            total[text] -= np.add.reduceat(both, begin)
            step = np.add.reduceat(np.exp(np.minimum(each - both, 0)), begin) - share * size
            lean[text] = np.clip(lean[text] + SHARE_RATE * step / np.sqrt(size), -6, 6)
        return total


def abreast(batch: pa.RecordBatch, column: int, most: int) -> Iterator[pa.RecordBatch]:
    """The batch in runs of about ``most`` bytes of text, by length, so that long texts have company to their end."""
    ordered = batch.take(pc.sort_indices(pc.binary_length(batch.column(column))))
    ends = np.cumsum(pc.binary_length(ordered.column(column)).to_numpy().astype(np.int64))
    total = int(ends.max(initial=0))
    run = (ends - 1) * max(1, round(total / most)) // max(1, total)
    cuts = np.r_[0, np.flatnonzero(np.diff(run)) + 1, len(run)]
    for low, high in zip(cuts[:-1].tolist(), cuts[1:].tolist()):
        yield ordered.slice(low, high - low)


def _texts(docs: DataFrame) -> DataFrame:
    text = whole_text("text")
    doc_id = F.col("doc_id").cast("long")
    return docs.select(doc_id.alias("doc_id"), F.xxhash64(text).alias("h"), held_out(doc_id).alias("held_out"), text.alias("text"))


def token_counts(training: DataFrame, kinds: dict[bytes, int], by_kind: np.ndarray) -> DataFrame:
    """token, state, fold, c over the training texts (text, fold), ends included."""
    shared = training.sparkSession.sparkContext.broadcast((kinds, by_kind))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        reader = Reader(*shared.value)
        ways = FOLDS * (reader.by_kind.shape[1] + 1)
        found = np.zeros(0, np.int64)

        def rows() -> Iterator[pa.RecordBatch]:
            every = np.flatnonzero(found)
            for first in range(0, len(every), ROWS_AT_ONCE):
                at = every[first:first + ROWS_AT_ONCE]
                token, way = np.divmod(at, ways)
                words = pa.array([reader.words[i] for i in token.tolist()], pa.binary())
                columns = [words, pa.array((way // FOLDS).astype(np.int32)), pa.array((way % FOLDS).astype(np.int32)), pa.array(found[at])]
                yield pa.RecordBatch.from_arrays(columns, ["token", "state", "fold", "c"])

        for batch in batches:
            for part in slices(batch, BYTES_AT_ONCE):
                read = reader.read(part.column(0))
                way = np.repeat(read.state, read.size) * FOLDS + part.column(1).to_numpy().astype(np.int64)[read.text]
                key, n = np.unique(read.ids * ways + way, return_counts=True)
                found = np.r_[found, np.zeros(len(reader.words) * ways - len(found), np.int64)]
                found[key] += n
                if len(reader.words) > REMEMBERED:
                    yield from rows()
                    reader.forget()
                    found = np.zeros(0, np.int64)
        yield from rows()

    partial = training.select("text", F.col("fold").cast("int")).mapInArrow(count, "token binary, state int, fold int, c long")
    return partial.groupBy("token", "state", "fold").agg(F.sum("c").alias("c"))


def words_beside(training: DataFrame, words: list[bytes]) -> np.ndarray:
    """How often each two of ``words`` stand in the same training text, a text's pairs scaled to its number of such words.

    Whole numbers are added, so the sums do not depend on the order of rows.
    """
    size = len(words)
    shared = training.sparkSession.sparkContext.broadcast({w: i for i, w in enumerate(words)})

    def beside(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kinds, sums = shared.value, np.zeros((size, size))
        for batch in batches:
            for part in slices(batch, BYTES_AT_ONCE):
                code, lengths, distinct = tokens(part.column(0))
                kind = np.fromiter(map(kinds.get, distinct, repeat(size)), np.int64, len(distinct))[code]
                key = np.repeat(np.arange(len(lengths)), lengths)[kind < size] * size + kind[kind < size]
                counts = np.bincount(key, minlength=len(lengths) * size).reshape(-1, size)
                scaled = np.rint(BESIDE_SCALE * counts / np.sqrt(np.maximum(counts.sum(axis=1, keepdims=True), 1)))
                sums += scaled.T @ scaled
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(size)), pa.array(list(sums), pa.list_(pa.float64()))], ["word", "n"])

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[int, np.ndarray] = {}
        for batch in batches:
            for word, n in zip(batch.column(0).to_pylist(), batch.column(1)):
                sums[word] = sums.get(word, 0) + n.values.to_numpy()
        if sums:
            yield pa.RecordBatch.from_arrays([pa.array(sums.keys(), pa.int64()), pa.array(list(sums.values()), pa.list_(pa.float64()))], ["word", "n"])

    sent = training.select("text").mapInArrow(beside, "word long, n array<double>")
    found = sent.repartition("word").mapInArrow(add, "word long, n array<double>").toArrow()  # STATE_WORDS rows
    out = np.zeros((size, size))
    for word, n in zip(found.column("word").to_pylist(), found.column("n")):
        out[word] = n.values.to_numpy()
    return out / BESIDE_SCALE ** 2


def byte_order(counts: DataFrame) -> list[int]:
    """Bytes of the training texts, most frequent first (256 rows at most)."""

    def histogram(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(256, np.int64)
        for batch in batches:
            data, place = symbols(batch.column(0).to_pylist())
            weight = np.repeat(batch.column(1).to_numpy(), np.diff(np.r_[np.flatnonzero(place == 0), len(place)]))
            total += np.bincount(data, weight, 256).astype(np.int64)
        total[END_BYTE] = 0
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(256)), pa.array(total)], ["byte", "n"])

    found = counts.select("token", "c").mapInArrow(histogram, "byte long, n long").groupBy("byte").agg(F.sum("n").alias("n"))
    return [r.byte for r in found.filter("n > 0").orderBy(F.desc("n"), "byte").collect()]


def build_tables(counts: DataFrame, code: np.ndarray) -> list[str]:
    """Paths of the tables of log-odds of each half and of all, from counts of tokens by state (the neutral state gets every state's).

    A task counts one of RANGES in an array of its size, so that a worker holds a
    part of the table and never all of it, and sends, per chunk of cells, the
    ones that are not zero; a chunk's sums are kept as they stream in, so
    neither side grows with the corpus.
    """
    def counting(low: int, high: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
        def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            cells = np.zeros(high - low, np.float32)
            mine = [k for k in range(len(REACH)) if FIRST_CELL[k] < high and low < FIRST_CELL[k + 1]]
            with_state = [k for k in mine if WITH_STATE[k]]
            split = any(FIRST_CELL[k] < low or high < FIRST_CELL[k + 1] for k in mine)

            def add_up(at: np.ndarray, weight: np.ndarray) -> None:
                if split:
                    here = (at >= low) & (at < high)
                    at, weight = at[here], weight[here]
                np.add.at(cells, at - low, weight)

            for batch in batches:
                data, place = symbols(batch.column(0).to_pylist())
                lengths = np.diff(np.r_[np.flatnonzero(place == 0), len(place)])
                state = np.repeat(batch.column(1).to_numpy(), lengths)
                weight = np.repeat(batch.column(2).to_numpy().astype(np.float32), lengths)
                sym = code[data]
                for row in context_rows(data, place, state, mine):
                    add_up(row + sym, weight)
                told = state > 0
                for row in context_rows(data, place, 0, with_state):
                    add_up((row + sym)[told], weight[told])
                if high > FIRST_CELL[-1]:
                    where = np.flatnonzero(sym == ESCAPE)
                    add_up(FIRST_CELL[-1] + (_before(data, place, where) << 8) + data[where], weight[where])
            out = []
            for first in range(0, high - low, CHUNK):
                part = cells[first:first + CHUNK]
                at = np.flatnonzero(part)
                if len(at):
                    out.append(((low + first) // CHUNK, at.astype(np.uint16).tobytes(), part[at].tobytes()))
                if len(out) >= 256:
                    yield pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*out)], ["chunk", "at", "n"])
                    out = []
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*out)], ["chunk", "at", "n"])

        return count

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[int, np.ndarray] = {}
        for batch in batches:
            for chunk, at, n, fold in zip(*(c.to_pylist() for c in batch.columns)):
                cells = sums.setdefault(chunk, np.zeros((FOLDS, CHUNK)))[fold]
                cells[np.frombuffer(at, np.uint16)] += np.frombuffer(n, np.float32)
        for chunk, cells in sums.items():
            width = 32 if chunk * CHUNK < FIRST_CELL[-1] else 256
            odds = [_log_odds(some, width).tobytes() for some in (*cells, cells.sum(axis=0))]
            yield pa.RecordBatch.from_arrays([pa.array([chunk] * len(odds), pa.int64()), pa.array(range(len(odds)), pa.int32()), pa.array(odds, pa.binary())], ["chunk", "whose", "odds"])

    sent = [
        counts.filter(F.col("fold") == f).select("token", "state", "c").mapInArrow(counting(*part), "chunk long, at binary, n binary").withColumn("fold", F.lit(f))
        for f in range(FOLDS) for part in RANGES]
    added = reduce(DataFrame.unionByName, sent).repartition("chunk").mapInArrow(add, "chunk long, whose int, odds binary")
    found, paths = added.toArrow(), []  # at most TABLE_CELLS bytes a table
    for whose in range(FOLDS + 1):
        table = np.zeros(TABLE_CELLS, np.int8)
        for chunk, mine, odds in zip(found.column("chunk").to_pylist(), found.column("whose").to_pylist(), found.column("odds")):
            if mine == whose:
                table[chunk * CHUNK:(chunk + 1) * CHUNK] = np.frombuffer(odds.as_py(), np.int8)
        paths.append(f"{scratch_path(counts.sparkSession, 'mixing')}/odds.bin")
        store, place = fs.FileSystem.from_uri(paths[-1])
        store.create_dir(place.rpartition("/")[0], recursive=True)
        with store.open_output_stream(place) as out:
            out.write(table.tobytes())
    return paths


def newton_step(counts: DataFrame, halves: list[Model], most: float = MOST_STEP) -> np.ndarray:
    """Weights after one Newton step from those of ``halves``, over every token of ``counts``, each under the other half's table.

    No weight moves by more than ``most``, as a step from afar may go too far.
    """
    shared = counts.sparkSession.sparkContext.broadcast([(m.code, m.path, m.kinds, m.by_kind, m.weights) for m in halves])

    def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorers, n = [Scorer(Model(*parts)) for parts in shared.value], len(REACH)
        total = np.zeros((GATES, 5, n + n * n))
        for batch in batches:
            for first in range(0, batch.num_rows, FIT_WORDS):
                words, state, fold, times = (c.to_pylist() if i == 0 else c.to_numpy() for i, c in enumerate(batch.slice(first, FIT_WORDS).columns))
                for f in np.unique(fold).tolist():
                    mine = np.flatnonzero(fold == f)
                    gradient, curve = scorers[1 - f].curvature([words[i] for i in mine.tolist()], state[mine], times[mine])
                    total[..., :n] += gradient
                    total[..., n:] += curve.reshape(GATES, 5, n * n)
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(total.size)), pa.array(total.ravel())], ["cell", "x"])

    sent = counts.select("token", "state", "fold", "c").mapInArrow(sums, "cell long, x double")
    n, weights = len(REACH), halves[0].weights.astype(np.float64)
    total = np.zeros(GATES * 5 * (n + n * n))
    for r in sent.groupBy("cell").agg(F.sum("x").alias("x")).collect():  # one row per cell
        total[r.cell] = r.x
    total = total.reshape(GATES, 5, n + n * n)
    for g in range(GATES):
        for b in range(5):
            pull = PRIOR * (START - weights[g, :, b])
            step = np.linalg.solve(total[g, b, n:].reshape(n, n) + PRIOR * np.eye(n), total[g, b, :n] + pull)
            weights[g, :, b] += np.clip(step, -most, most)
    # Rounded, as sums of fractions depend on their order in the last digits.
    return np.round(weights, 4).astype(np.float32)


def fit_weights(counts: DataFrame, halves: list[Model]) -> None:
    """Newton steps until they settle; behind one that moves no weight by SETTLED the next moves them by its square.

    The most that a step may move is halved after every eighth, so the steps
    come to an end in any case.
    """
    moved, steps = float("inf"), 0
    while moved > SETTLED:
        weights = newton_step(counts, halves, MOST_STEP / 2 ** (steps // 8))
        moved, steps = float(np.abs(weights - halves[0].weights).max()), steps + 1
        for model in halves:
            model.weights = weights


def fit(rows: DataFrame) -> tuple[Model, DataFrame]:
    """Model and counts (token, c), all from every training text."""
    training = rows.filter("NOT held_out").select("text", F.pmod("h", F.lit(FOLDS)).alias("fold"))
    none = {}, np.zeros((0, 1))
    counts = cut_lineage(token_counts(training.withColumn("fold", F.lit(0)), *none).select("token", "c"))
    frequent = [bytes(r.token) for r in counts.orderBy(F.desc("c"), "token").limit(STATE_WORDS).collect()]
    kinds, by_kind = cluster(frequent, words_beside(training, frequent)) if frequent else none
    by_state = cut_lineage(token_counts(training, kinds, by_kind))
    code = codes_of(byte_order(counts))
    *halves, whole = (Model(code, path, kinds, by_kind) for path in build_tables(by_state, code))
    if frequent:
        fit_weights(by_state, halves)
        whole.weights = halves[0].weights
    return whole, counts


def scores(docs: DataFrame) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score, bits_per_byte of every row."""
    spark = docs.sparkSession
    rows = _texts(docs)
    model, by_token = fit(rows)
    counts = by_token.select("token", F.xxhash64("token").alias("hash"), "c")
    size = counts.agg(F.coalesce(F.sum("c"), F.lit(0)).alias("n"), F.count(F.lit(1)).alias("v")).first()
    total, below = size.n, size.n + 0.1 * (size.v + 1)
    frequent = counts.orderBy(F.desc("c"), "token").limit(FREQUENT).select("token", "c").toArrow()
    term = {t.as_py(): float(np.log10((c + 0.1) / below)) for t, c in zip(frequent.column("token"), frequent.column("c").to_pylist())}
    # Bounded by FREQUENT tokens and the sizes of the model.
    shared = spark.sparkContext.broadcast((term, model.code, model.path, model.kinds, model.by_kind, model.weights))

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        term, *parts = shared.value
        scorer = Scorer(Model(*parts))
        terms, hashes, sizes = np.zeros(0), np.zeros(0, np.uint64), np.zeros(0, np.int64)
        for batch in batches:
            for part in abreast(batch, 3, BYTES_ABREAST):
                if len(scorer.reader.words) > REMEMBERED:
                    scorer.forget()
                    terms, hashes, sizes = terms[:0], hashes[:0], sizes[:0]
                read = scorer.reader.read(part.column(3))
                fresh = scorer.reader.words[len(terms):]
                terms = np.r_[terms, np.fromiter((term.get(w, np.nan) for w in fresh), float, len(fresh))]
                hashes = np.r_[hashes, np.fromiter((0 if w in term else xxhash.xxh64_intdigest(w, 42) for w in fresh), np.uint64, len(fresh))]
                sizes = np.r_[sizes, np.fromiter(map(len, fresh), np.int64, len(fresh))]
                n, words = read.texts, len(terms)
                key, times = np.unique(read.text * words + read.ids, return_counts=True)
                text, token = np.divmod(key, words)
                rare = np.isnan(terms[token])
                base = np.bincount(text[~rare], terms[token[~rare]] * times[~rare], n)
                known = np.bincount(text[~rare], times[~rare], n).astype(np.int64)
                lengths = np.bincount(read.text, minlength=n)
                n_bytes = np.bincount(read.text, sizes[read.ids], n).astype(np.int64) + lengths - 1
                ends = pa.array(np.r_[0, np.cumsum(np.bincount(text[rare], minlength=n))].astype(np.int32))
                yield pa.RecordBatch.from_arrays([
                    *part.columns[:3], *map(pa.array, (lengths, known, base, scorer.costs(read), n_bytes)),
                    pa.ListArray.from_arrays(ends, pa.array(hashes[token[rare]].view(np.int64))),
                    pa.ListArray.from_arrays(ends, pa.array(times[rare].astype(np.int32))),
                ], names)

    names = ["doc_id", "h", "held_out", "n_tokens", "known", "base", "cost", "n_bytes", "rare", "times"]
    scored = cut_lineage(rows.mapInArrow(score, (
        "doc_id long, h long, held_out boolean, n_tokens long, known long, base double, cost double, n_bytes long, rare array<long>, times array<int>"
    )))
    one = F.explode(F.arrays_zip("rare", "times"))
    rare = scored.select("doc_id", "h", one.alias("r")).select("doc_id", "h", F.col("r.rare").alias("hash"), F.col("r.times").alias("times"))
    c = F.coalesce("c", F.lit(0))
    rest = cut_lineage(
        rare.join(counts.select("hash", "c"), "hash", "left").groupBy("doc_id", "h")
        .agg(F.sum(F.col("times") * F.log10((c + 0.1) / F.lit(float(below)))).alias("rest"), F.sum(F.when(c > 0, F.col("times")).otherwise(0)).alias("rest_known"))
        .toDF("rest_id", "rest_h", "rest", "rest_known")
    )
    # Rows that repeat doc_id and text have added up their rare tokens together.
    repeated = scored.groupBy("doc_id", "h").agg(F.count(F.lit(1)).alias("m")).filter("m > 1").toDF("again_id", "again_h", "m")
    same = lambda a, b: F.col("doc_id").eqNullSafe(F.col(a)) & (F.col("h") == F.col(b))
    m = F.coalesce("m", F.lit(1))
    return scored.join(rest, same("rest_id", "rest_h"), "left").join(cut_lineage(repeated), same("again_id", "again_h"), "left").select(
        "doc_id", "held_out", "n_tokens", (F.col("known") + F.coalesce(F.col("rest_known") / m, F.lit(0)).cast("long")).alias("n_known"),
        F.lit(total).cast("long").alias("train_tokens"), (F.col("base") + F.coalesce(F.col("rest") / m, F.lit(0.0))).alias("base_score"),
        (-F.col("cost") / float(np.log(10))).alias("score"), (F.col("cost") / float(np.log(2)) / F.col("n_bytes")).alias("bits_per_byte"),
    )
