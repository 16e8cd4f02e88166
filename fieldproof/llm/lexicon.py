"""A minimal acyclic transducer from words to lists of ids, in one file that tasks map into memory.

Words that end alike share states. An arc carries the number of words that come
before it in its state, so the numbers on a path add up to the word's place in
order, and the place leads to the ids.
"""

from __future__ import annotations

import json
from collections.abc import Sequence
from urllib.parse import unquote, urlparse

import numpy as np
from pyarrow import fs

_NAMES = ("arc_key", "arc_target", "arc_before", "final", "ids_at", "ids")


def build(entries: Sequence[tuple[bytes, Sequence[int]]]) -> dict[str, np.ndarray]:
    """Arrays of the transducer of distinct words, by adding them in order and sharing finished states."""
    entries = sorted(entries)
    known: dict[tuple, int] = {}
    arcs: list[tuple] = []
    words_below: list[int] = []

    def settle(node: list) -> int:
        """Number of the one state that has these arcs; node: [is final, {label: child}]."""
        signature = (node[0], tuple(node[1].items()))
        state = known.get(signature)
        if state is None:
            state = known[signature] = len(arcs)
            arcs.append(signature)
            words_below.append(node[0] + sum(words_below[t] for t in node[1].values()))
        return state

    path: list[list] = [[0, {}]]
    previous = b""
    for word, _ in entries:
        same = 0
        while same < min(len(word), len(previous)) and word[same] == previous[same]:
            same += 1
        for depth in range(len(previous), same, -1):
            path[depth - 1][1][previous[depth - 1]] = settle(path.pop())
        for _ in word[same:]:
            path.append([0, {}])
        path[-1][0] = 1
        previous = word
    for depth in range(len(previous), 0, -1):
        path[depth - 1][1][previous[depth - 1]] = settle(path.pop())
    root = settle(path[0])
    renamed = {root: 0} | {s: s + 1 for s in range(root)}
    key, target, before = [], [], []
    final = np.zeros(len(arcs), np.uint8)
    for state, (is_final, out) in enumerate(arcs):
        count = final[renamed[state]] = is_final
        count = int(count)
        for label, child in out:
            key.append(renamed[state] << 8 | label)
            target.append(renamed[child])
            before.append(count)
            count += words_below[child]
    order = np.argsort(np.array(key, np.uint64))
    lengths = np.array([0, *(len(ids) for _, ids in entries)], np.int64)
    return {
        "arc_key": np.array(key, np.uint64)[order], "arc_target": np.array(target, np.uint32)[order],
        "arc_before": np.array(before, np.uint32)[order], "final": final, "ids_at": np.cumsum(lengths).astype(np.uint32),
        "ids": np.array([i for _, ids in entries for i in ids], np.uint32),
    }


def save(arrays: dict[str, np.ndarray], path: str) -> None:
    """One file: a line that says where the arrays lie, then the arrays, each from a multiple of 64 bytes."""
    at, head = 0, {}
    for name in _NAMES:
        head[name] = (at, len(arrays[name]), arrays[name].dtype.str)
        at += -(-arrays[name].nbytes // 64) * 64
    line = json.dumps(head).encode()
    line += b" " * (-(len(line) + 1) % 64) + b"\n"
    store, place = fs.FileSystem.from_uri(path)
    store.create_dir(place.rpartition("/")[0], recursive=True)
    with store.open_output_stream(place) as out:
        out.write(line)
        for name in _NAMES:
            data = arrays[name].tobytes()
            out.write(data + b"\0" * (-len(data) % 64))


class Lexicon:
    """Read side: maps the file where it is a file, else holds its bytes."""

    def __init__(self, path: str) -> None:
        parts = urlparse(path)
        if parts.scheme in ("", "file"):
            data = np.memmap(unquote(parts.path), np.uint8, "r")
        else:
            store, place = fs.FileSystem.from_uri(path)
            with store.open_input_stream(place) as file:
                data = np.frombuffer(file.read(), np.uint8)
        end = int(np.flatnonzero(data[:4096] == 10)[0])
        head = json.loads(bytes(data[:end]))
        for name, (at, n, kind) in head.items():
            at += end + 1
            setattr(self, name, data[at:at + n * np.dtype(kind).itemsize].view(kind))

    def places(self, words: list[bytes]) -> np.ndarray:
        """Place of each word in order, -1 for a word it doesn't have; all words walk together, a byte a step."""
        lengths = np.array([len(w) for w in words])
        starts = np.cumsum(lengths) - lengths
        data = np.frombuffer(b"".join(words), np.uint8)
        state, place = np.zeros(len(words), np.uint64), np.zeros(len(words), np.int64)
        alive, depth = np.arange(len(words)), 0
        place[lengths == 0] = -1
        while len(alive := alive[lengths[alive] > depth]) and len(self.arc_key):
            key = state[alive] << np.uint64(8) | data[starts[alive] + depth]
            arc = np.minimum(np.searchsorted(self.arc_key, key), len(self.arc_key) - 1)
            hit = self.arc_key[arc] == key
            place[alive[~hit]] = -1
            alive, arc = alive[hit], arc[hit]
            state[alive] = self.arc_target[arc]
            place[alive] += self.arc_before[arc]
            depth += 1
        place[(place >= 0) & (self.final[state.astype(np.int64)] == 0)] = -1
        return place

    def outputs(self, place: int) -> np.ndarray:
        return self.ids[self.ids_at[place]:self.ids_at[place + 1]]
