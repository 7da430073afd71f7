"""Problem 7: encoding a corpus with a public byte-level tokenizer.

The commonest words of the whole corpus are counted first and compiled with
their ids into a minimal acyclic transducer (``transducer``), which lies in
the shared folder and is memory-mapped by the workers. Texts are split by the
vocabulary's own pattern; the distinct words of a batch are looked up in the
transducer together, and words it lacks are merged exactly by the ranks of
the vocabulary. The ids are those of the tokenizer, whatever the lexicon holds.

Defined results: null and empty text have the empty list of ids; special
tokens are never produced, their strings are ordinary text. The lexicon is
bounded by ``LEXICON`` words, so is what the driver gathers for it.
"""

from __future__ import annotations

import functools
import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tarnfold.llm.transducer import Transducer, compile_words
from tarnfold.llm.vocabulary import PATTERN, byte_ranks
from tarnfold.storage import local_path, scratch

VOCABULARY = "byte_bpe_50k"
#: Words of the lexicon at most, and how often a word must occur.
LEXICON, LEAST = 65536, 2
#: Bytes of the longest word kept in the lexicon and in a worker's memory; units kept by a worker.
LONGEST, KEPT = 64, 1 << 18


# Fixed value: white space as the vocabulary's pattern sees it.
_SPACE = "\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"
#: White space and what follows up to the next: the pattern always parts words at the start of such a unit.
units = re.compile(f"[{_SPACE}]*[^{_SPACE}]+|[{_SPACE}]+").findall


@functools.cache
def _splitter():
    import regex

    return regex.compile(PATTERN).findall


def merge(word: bytes, ranks: dict[bytes, int]) -> list[int]:
    """Ids of one word: the adjoining pair of least rank is merged until none is left."""
    if (one := ranks.get(word)) is not None:
        return [one]
    if len(word) > 256:
        return _merge_long(word, ranks)
    parts = [word[i : i + 1] for i in range(len(word))]
    far = 1 << 60
    rank = [ranks.get(parts[i] + parts[i + 1], far) for i in range(len(parts) - 1)]
    while rank:
        least = min(rank)
        if least == far:
            break
        i = rank.index(least)
        parts[i : i + 2] = [parts[i] + parts[i + 1]]
        del rank[i]
        if i < len(rank):
            rank[i] = ranks.get(parts[i] + parts[i + 1], far)
        if i:
            rank[i - 1] = ranks.get(parts[i - 1] + parts[i], far)
    return [ranks[p] for p in parts]


def _merge_long(word: bytes, ranks: dict[bytes, int]) -> list[int]:
    """The same for very long words, with a heap of pairs."""
    import heapq

    n = len(word)
    after, before, end = list(range(1, n + 1)), list(range(-1, n - 1)), list(range(1, n + 1))
    alive = [True] * n
    heap = [(r, i, i + 2) for i in range(n - 1) if (r := ranks.get(word[i : i + 2])) is not None]
    heapq.heapify(heap)
    while heap:
        _, i, stop = heapq.heappop(heap)
        j = after[i] if alive[i] else n
        if j >= n or not alive[j] or end[j] != stop:
            continue
        alive[j], end[i], after[i] = False, stop, after[j]
        if after[j] < n:
            before[after[j]] = i
        for a, b in ((before[i], i), (i, after[i])):
            if a >= 0 and b < n and (r := ranks.get(word[a : end[b]])) is not None:
                heapq.heappush(heap, (r, a, end[b]))
    out, i = [], 0
    while i < n:
        out.append(ranks[word[i : end[i]]])
        i = after[i]
    return out


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    met, total, split = Counter(), Counter(), _splitter()

    def spend() -> None:
        for unit, n in met.items():
            for word in split(unit):
                total[word] += n
        met.clear()

    for batch in batches:
        for text in batch.column(0).to_pylist():
            met.update(units(text))
        if len(met) > KEPT:
            spend()
    spend()
    words = [(w, n) for w, n in total.items() if len(w) <= LONGEST]
    for a in range(0, len(words), 1 << 16):
        part = words[a : a + (1 << 16)]
        yield pa.RecordBatch.from_arrays([pa.array([w for w, _ in part], pa.string()), pa.array([n for _, n in part], pa.int64())], ["word", "n"])


def common_words(df: DataFrame, text: str, most: int = LEXICON, least: int = LEAST) -> list[str]:
    """The commonest words of the corpus, at most ``most``; counted over all texts."""
    counted = df.select(F.col(text).alias("_text")).where(F.length("_text") > 0).mapInArrow(_count, "word string, n long")
    top = counted.groupBy("word").agg(F.sum("n").alias("n")).where(F.col("n") >= least).orderBy(F.desc("n"), "word").limit(most)
    return [r[0] for r in top.select("word").collect()]


def lexicon(spark: SparkSession, words: list[str], vocabulary: str = VOCABULARY, folder: str | None = None) -> str | bytes:
    """The compiled lexicon: a path in the shared folder where that is a file system, else the bytes themselves."""
    ranks = byte_ranks(vocabulary, folder)
    data = compile_words((b := w.encode(), merge(b, ranks)) for w in words)
    at = local_path(scratch(spark, "lexicon"))
    if at is None:
        return data
    import os

    os.makedirs(os.path.dirname(at), exist_ok=True)
    with open(at, "wb") as file:
        file.write(data)
    return at


class Encoder:
    """Ids of texts in one worker: the transducer for common words, exact merges for the others.

    Units met before are remembered with their ids, within a bound.
    """

    def __init__(self, source: str | bytes, vocabulary: str, folder: str | None):
        self.known, self.ranks, self.split = Transducer(source), byte_ranks(vocabulary, folder), _splitter()
        self.code: dict[str, int] = {}
        self._reset()

    def _reset(self) -> None:
        """Forgets the units met; ids of unit c are ids[begin[c]:begin[c + 1]]."""
        self.code.clear()
        self.words: dict[str, list[int]] = {}
        self.ids, self.begin = np.zeros(0, np.int32), np.zeros(1, np.int64)

    def _learn(self, new: list[str]) -> None:
        split = [self.split(u) for u in new]
        words = sorted({w for s in split for w in s}.difference(self.words))
        raw = [w.encode() for w in words]
        for word, b, k in zip(words, raw, self.known.numbers(raw).tolist()):
            self.words[word] = self.known.outputs(k).tolist() if k >= 0 else merge(b, self.ranks)
        lists = [[i for w in s for i in self.words[w]] for s in split]
        self.code.update(zip(new, range(len(self.begin) - 1, len(self.begin) - 1 + len(new))))
        self.begin = np.concatenate([self.begin, self.begin[-1] + np.cumsum([len(x) for x in lists])])
        self.ids = np.concatenate([self.ids, np.asarray([i for x in lists for i in x], np.int32)])

    def _codes(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
        """Codes of all units of the texts, and where each text's begin."""
        if len(self.code) > KEPT:
            self._reset()
        split = [units(t) if t else [] for t in texts]
        begin = np.concatenate([[0], np.cumsum([len(s) for s in split])]).astype(np.int64)
        met = [u for s in split for u in s]
        if new := set(met).difference(self.code):
            self._learn(list(new))
        return np.fromiter(map(self.code.__getitem__, met), np.int64, len(met)), begin

    def encode(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
        """All ids in a row, and where each text's begin."""
        codes, begin = self._codes(texts)
        size = self.begin[codes + 1] - self.begin[codes]
        at = np.concatenate([[0], np.cumsum(size)])
        index = np.arange(at[-1]) + np.repeat(self.begin[codes] - at[:-1], size)
        return self.ids[index], at[begin]

    def sizes(self, texts: list[str | None]) -> np.ndarray:
        """The number of ids of each text."""
        codes, begin = self._codes(texts)
        at = np.concatenate([[0], np.cumsum(self.begin[codes + 1] - self.begin[codes])])
        return np.diff(at[begin])


@functools.lru_cache(maxsize=2)
def _encoder(source: str | bytes, vocabulary: str, folder: str | None) -> Encoder:
    return Encoder(source, vocabulary, folder)


#: Texts that are encoded together.
_TOGETHER = 512


def _encode(source: str | bytes, vocabulary: str, folder: str | None, only_sizes: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = _encoder(source, vocabulary, folder)
        for whole in batches:
            for a in range(0, whole.num_rows, _TOGETHER):
                batch = whole.slice(a, _TOGETHER)
                texts = batch.column(1).to_pylist()
                if only_sizes:
                    out = pa.array(encoder.sizes(texts).astype(np.int32))
                else:
                    ids, begin = encoder.encode(texts)
                    out = pa.ListArray.from_arrays(pa.array(begin.astype(np.int32)), pa.array(ids))
                yield pa.RecordBatch.from_arrays([batch.column(0), out], ["_key", "_out"])

    return run


def _mapped(df: DataFrame, key: str, text: str, out: str, only_sizes: bool, vocabulary: str, folder: str | None) -> DataFrame:
    source = lexicon(df.sparkSession, common_words(df, text), vocabulary, folder)
    kind = df.schema[key].dataType.simpleString()
    rows = df.select(F.col(key).alias("_key"), F.col(text).alias("_text"))
    made = rows.mapInArrow(_encode(source, vocabulary, folder, only_sizes), f"_key {kind}, _out {'int' if only_sizes else 'array<int>'}")
    return made.withColumnsRenamed({"_key": key, "_out": out})


def encode(df: DataFrame, key: str, text: str, vocabulary: str = VOCABULARY, folder: str | None = None) -> DataFrame:
    """Key and ids of every row of ``df``; other columns are not carried."""
    return _mapped(df, key, text, "ids", False, vocabulary, folder)


def token_counts(df: DataFrame, key: str, text: str, vocabulary: str = VOCABULARY, folder: str | None = None) -> DataFrame:
    """Key and number of ids (``n_tokens``) of every row of ``df``."""
    return _mapped(df, key, text, "n_tokens", True, vocabulary, folder)
