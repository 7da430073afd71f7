"""A minimal acyclic transducer: words to id lists, sharing suffixes.

Words are inserted in byte order and states that accept the same suffixes are
merged at once, so the automaton stays minimal. Every state counts the words
it accepts; adding the counts of the branches passed over numbers the words in
order, and the number points into one array of outputs. All parts are flat
arrays in a single file, which readers memory-map.
"""

from __future__ import annotations

import io
import os
import struct
from collections.abc import Iterable, Sequence

import numpy as np

_MAGIC = b"TFLX1\0\0\0"


def compile_words(entries: Iterable[tuple[bytes, Sequence[int]]]) -> bytes:
    """The transducer of distinct non-empty words as bytes."""
    entries = sorted(entries)
    register: dict[tuple, int] = {}
    states: list[tuple[bool, tuple[tuple[int, int], ...]]] = []
    path: list[tuple[bool, list[tuple[int, int]]]] = [(False, [])]
    previous = b""

    def freeze(depth: int) -> None:
        while len(path) > depth + 1:
            final, arcs = path.pop()
            key = (final, tuple(arcs))
            if (at := register.get(key)) is None:
                at = register[key] = len(states)
                states.append(key)
            path[-1][1].append((previous[len(path) - 1], at))

    for word, _ in entries:
        shared = 0
        while shared < min(len(word), len(previous)) and word[shared] == previous[shared]:
            shared += 1
        freeze(shared)
        path += [(False, []) for _ in word[shared:]]
        path[-1] = (True, path[-1][1])
        previous = word
    freeze(0)
    states.append((False, tuple(path[0][1])))
    count = np.zeros(len(states), np.int64)
    key, target, skip = [], [], []
    for at, (final, arcs) in enumerate(states):
        passed = int(final)
        for byte, to in arcs:
            key.append(at * 256 + byte)
            target.append(to)
            skip.append(passed)
            passed += int(count[to])
        count[at] = passed
    ids = [np.asarray(ids, np.int32) for _, ids in entries]
    begin = np.zeros(len(ids) + 1, np.int64)
    np.cumsum([len(x) for x in ids], out=begin[1:])
    parts = [np.asarray(key, np.int64), np.asarray(target, np.int32), np.asarray(skip, np.int32), np.asarray([f for f, _ in states], np.uint8), begin, np.concatenate(ids) if ids else np.zeros(0, np.int32)]
    out = io.BytesIO()
    out.write(_MAGIC + struct.pack("<7q", len(states) - 1, *map(len, parts)))
    for part in parts:
        out.write(b"\0" * (-out.tell() % 8) + part.tobytes())
    return out.getvalue()


class Transducer:
    """Look-up in a compiled transducer, from bytes or a memory-mapped file."""

    def __init__(self, source: bytes | str):
        raw = np.memmap(source, np.uint8, "r") if isinstance(source, (str, os.PathLike)) else np.frombuffer(source, np.uint8)
        if raw[:8].tobytes() != _MAGIC:
            raise ValueError("not a transducer")
        self.root, *sizes = struct.unpack("<7q", raw[8:64].tobytes())
        at, parts = 64, []
        for size, kind in zip(sizes, (np.int64, np.int32, np.int32, np.uint8, np.int64, np.int32)):
            at += -at % 8
            parts.append(raw[at : at + size * np.dtype(kind).itemsize].view(kind))
            at += size * np.dtype(kind).itemsize
        self.key, self.target, self.skip, self.final, self.begin, self.ids = parts

    def numbers(self, words: Sequence[bytes]) -> np.ndarray:
        """The number of each word, -1 for words the transducer lacks; one byte of all words per step."""
        n = len(words)
        out = np.full(n, -1, np.int64)
        if not n or not len(self.key):
            return out
        size = np.fromiter(map(len, words), np.int64, n)
        start = np.concatenate([[0], np.cumsum(size)[:-1]])
        data = np.frombuffer(b"".join(words), np.uint8)
        state = np.full(n, self.root, np.int64)
        number = np.zeros(n, np.int64)
        live = np.flatnonzero(size > 0)
        depth = 0
        while len(live):
            want = state[live] * 256 + data[start[live] + depth]
            at = np.minimum(np.searchsorted(self.key, want), len(self.key) - 1)
            hit = self.key[at] == want
            live, at = live[hit], at[hit]
            number[live] += self.skip[at]
            state[live] = self.target[at]
            depth += 1
            done = size[live] == depth
            ended = live[done]
            accepted = ended[self.final[state[ended]] == 1]
            out[accepted] = number[accepted]
            live = live[~done]
        return out

    def outputs(self, number: int) -> np.ndarray:
        return self.ids[self.begin[number] : self.begin[number + 1]]
