"""Problem 9: languages of documents and of segments in another language.

Each language has probabilities of the pieces of a fixed public vocabulary. A
word's probability is the sum over all its segmentations into pieces, by the
forward algorithm; a sentence's is the product over its words. The piece
probabilities are fitted on labelled sample sentences by expectation
maximisation over all segmentations (forward and backward), smoothed with the
pieces of all languages together.

A sentence needs an end mark and ``LEAST_WORDS`` words; identifiers, numbers
and single words have no language. Its language is the most probable one, a
switch away from the rest of the document costing ``SWITCH``.

Defined results: null, empty and blank texts and texts without a sentence give
no row; decomposed accents are composed, lost accents are trained for; repeated
keys are each judged. An empty sample table raises ValueError.
"""

from __future__ import annotations

import functools
import math
import re
import unicodedata
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tarnfold.llm.vocabulary import FOLDER

PIECES = "piece_bpe_32k.model"
#: Sample sentences of one language that the fit uses at most; rounds of the fit.
SAMPLES, ROUNDS = 2000, 4
#: Weight of the shared pieces, of the uniform floor in these, and of samples without accents.
SHARED, FLOOR, BARE = 40.0, 0.05, 0.4
#: Words of a sentence (two East Asian characters count as one); log odds against leaving the document's language; least probability of a found language.
LEAST_WORDS, SWITCH, LEAST = 4, 4.0, 0.9

# Names of the languages as labels give them.
NAMES = {
    "en": ("eng", "english"), "de": ("deu", "ger", "german"), "fr": ("fra", "fre", "french"), "es": ("spa", "spanish"),
    "it": ("ita", "italian"), "pt": ("por", "portuguese"), "nl": ("nld", "dut", "dutch"), "pl": ("pol", "polish"),
    "sv": ("swe", "swedish"), "ru": ("rus", "russian"), "ja": ("jpn", "japanese"), "zh": ("zho", "chi", "chinese"),
}

_EAST = "぀-ヿ㐀-鿿々ー"
_SENTENCE = re.compile(r"[^.!?。！？…\r\n]+(?:[.!?…]+[\"'”’»)\]]*(?=\s|$|[" + _EAST + r"])|[。！？]+[」』”]?)")
_RUN = re.compile(f"[{_EAST}]+")
_WORD = re.compile(r"[^\W\d_]+(?:['’\-][^\W\d_]+)*\Z")
_STRIP = "\"'“”‘’«»„()[]{}<>.,;:!?…*#-–—•/\\|`。、，！？：；「」"


@functools.cache
def _pieces(folder: str | None) -> tuple[dict[str, int], int]:
    """Lower-case pieces of the vocabulary → row, and the longest."""
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=f"{folder or FOLDER}/{PIECES}")
    out: dict[str, int] = {}
    for k in range(model.get_piece_size()):
        piece = model.id_to_piece(k).lower()
        if not model.is_control(k) and not model.is_byte(k) and not model.is_unknown(k) and piece:
            out.setdefault(piece, len(out))
    return out, max(map(len, out))


def normal(token: str) -> list[str]:
    """Words of a token between white space: letters only, lower case, marked at the start as the vocabulary does."""
    if not token.isascii():
        token = unicodedata.normalize("NFC", token)
        if runs := _RUN.findall(token):
            return runs
    token = token.strip(_STRIP)
    if not _WORD.match(token):
        return []
    return ["▁" + w for w in re.split(r"[\-’']", token.lower()) if w]


class Model:
    """Piece probabilities by language and the forward algorithm over them."""

    def __init__(self, table: np.ndarray, langs: list[str], folder: str | None):
        self.table, self.langs = table, langs
        self.pieces, self.longest = _pieces(folder)
        self.floor = table.min(0) * 0.01

    def _arcs(self, word: str) -> list[list[tuple[int, int]]]:
        """For each end the (start, row) of the pieces that end there; a lone unknown character has row -1."""
        get, out = self.pieces.get, []
        for i in range(1, len(word) + 1):
            arcs = [(j, k) for j in range(max(0, i - self.longest), i) if (k := get(word[j:i])) is not None]
            if not any(j == i - 1 for j, _ in arcs):
                arcs.append((i - 1, -1))
            out.append(arcs)
        return out

    def word(self, word: str) -> np.ndarray:
        """Log probability of a word in every language, summed over its segmentations."""
        alpha, log = [np.ones(len(self.langs))], 0.0
        for arcs in self._arcs(word):
            total = np.zeros(len(self.langs))
            for j, k in arcs:
                total += alpha[j] * (self.table[k] if k >= 0 else self.floor)
            alpha.append(total)
            if (top := total.max()) < 1e-200:
                alpha = alpha[: -self.longest] + [a / top for a in alpha[-self.longest :]]
                log += math.log(top)
        return np.log(np.maximum(alpha[-1], 1e-300)) + log

    def expect(self, words: dict[str, float], lang: int, into: np.ndarray) -> None:
        """Adds the expected counts of pieces over all segmentations of weighted words of one language."""
        p = self.table[:, lang]
        for word, weight in words.items():
            arcs = self._arcs(word)
            n = len(word)
            forward, backward = np.zeros(n + 1), np.zeros(n + 1)
            forward[0] = backward[n] = 1.0
            for i in range(1, n + 1):
                forward[i] = sum(forward[j] * (p[k] if k >= 0 else self.floor[lang]) for j, k in arcs[i - 1])
            if forward[n] <= 0:
                continue
            for i in range(n, 0, -1):
                for j, k in arcs[i - 1]:
                    step = p[k] if k >= 0 else self.floor[lang]
                    if k >= 0:
                        into[k] += weight * forward[j] * step * backward[i] / forward[n]
                    backward[j] += step * backward[i]


def fit(samples: list[tuple[str, str]], folder: str | None = None) -> tuple[np.ndarray, list[str]]:
    """Piece probabilities (pieces, languages) from (language, text) samples, and the languages in order."""
    if not samples:
        raise ValueError("no samples to fit languages on")
    langs = sorted({lang for lang, _ in samples})
    pieces, _ = _pieces(folder)
    words: list[dict[str, float]] = [{} for _ in langs]
    for lang, text in samples:
        for form, weight in ((text, 1.0), ("".join(c for c in unicodedata.normalize("NFD", text) if not unicodedata.combining(c)), BARE)):
            for token in form.split():
                for w in normal(token):
                    for part in [w] if len(w) < 60 else [w[i : i + 60] for i in range(0, len(w), 60)]:
                        words[langs.index(lang)][part] = words[langs.index(lang)].get(part, 0.0) + weight
    model = Model(np.full((len(pieces), len(langs)), 1 / len(pieces)), langs, folder)
    for _ in range(ROUNDS):
        counts = np.zeros_like(model.table)
        for k, own in enumerate(words):
            column = np.zeros(len(pieces))
            model.expect(own, k, column)
            counts[:, k] = column
        shared = counts.sum(1) / max(counts.sum(), 1e-9) * (1 - FLOOR) + FLOOR / len(pieces)
        table = (counts + SHARED * shared[:, None]) / (counts.sum(0) + SHARED)
        model = Model(table, langs, folder)
    return table, langs


class Judge:
    """Judges the sentences of texts in one worker; tokens met before are remembered within a bound."""

    KEPT = 1 << 18

    def __init__(self, table: np.ndarray, langs: list[str], folder: str | None):
        self.model, self.langs = Model(table, langs, folder), langs
        self.code: dict[str, int] = {}
        self._reset()

    def _reset(self) -> None:
        self.code.clear()
        self.rows = np.zeros((0, len(self.langs) + 1), np.float32)

    def _learn(self, tokens: list[str]) -> None:
        rows = np.zeros((len(tokens), len(self.langs) + 1), np.float32)
        for row, token in zip(rows, tokens):
            for w in normal(token):
                row[:-1] += self.model.word(w)
                row[-1] += 1.0 if w[0] == "▁" else len(w) / 2
        self.code.update(zip(tokens, range(len(self.rows), len(self.rows) + len(tokens))))
        self.rows = np.concatenate([self.rows, rows])

    def sentences(self, texts: list[str | None]) -> tuple[np.ndarray, list[tuple[int, int, int]]]:
        """Log probabilities (sentences, languages) and (text number, start, end) of the sentences with enough words."""
        if len(self.code) > self.KEPT:
            self._reset()
        spans, tokens, sizes = [], [], []
        for k, text in enumerate(texts):
            for m in _SENTENCE.finditer(text or ""):
                own = m.group().split()
                if own and (len(own) >= LEAST_WORDS or not m.group().isascii()):
                    spans.append((k, m.start(), m.end()))
                    tokens += own
                    sizes.append(len(own))
        if not spans:
            return np.zeros((0, len(self.langs))), []
        if new := set(tokens).difference(self.code):
            self._learn(list(new))
        codes = np.fromiter(map(self.code.__getitem__, tokens), np.int64, len(tokens))
        total = np.add.reduceat(self.rows[codes], np.concatenate([[0], np.cumsum(sizes)[:-1]]), axis=0)
        good = total[:, -1] >= LEAST_WORDS
        return total[good, :-1].astype(np.float64), [s for s, ok in zip(spans, good) if ok]

    def judge(self, texts: list[str | None]) -> list[tuple[int, int, int, int, float]]:
        """(text number, start, end, language number, confidence) of every sentence."""
        logs, spans = self.sentences(texts)
        if not spans:
            return []
        owner = np.asarray([s[0] for s in spans])
        begin = np.flatnonzero(np.r_[True, owner[1:] != owner[:-1]])
        count = np.diff(np.r_[begin, len(owner)])
        free = np.exp(logs - logs.max(1, keepdims=True))
        free /= free.sum(1, keepdims=True)
        main = np.repeat(np.add.reduceat(free, begin, axis=0).argmax(1), count)
        logs = logs - SWITCH
        logs[np.arange(len(logs)), main] += SWITCH
        p = np.exp(logs - logs.max(1, keepdims=True))
        p /= p.sum(1, keepdims=True)
        best = p.argmax(1)
        return [(k, a, b, int(g), float(c)) for (k, a, b), g, c in zip(spans, best, p[np.arange(len(p)), best])]


def named(label: Column) -> Column:
    """The two-letter code of the language that a label names, else null."""
    base = F.regexp_extract(F.lower(F.trim(label)), r"^([a-z]+)(?:[-_][a-z0-9]+)*$", 1)
    known = {name: code for code, names in NAMES.items() for name in (code, *names)}
    table = F.create_map(*[F.lit(x) for pair in known.items() for x in pair])
    whole = F.lower(F.trim(label))
    return F.when((F.length(base) <= 3) | (base == whole), table[base])


@functools.lru_cache(maxsize=1)
def _judge(key: bytes, shape: tuple[int, int], langs: tuple[str, ...], folder: str | None) -> Judge:
    return Judge(np.frombuffer(key, np.float64).reshape(shape), list(langs), folder)


_TOGETHER = 256


def _run(broadcast, shape, langs, folder, found: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        judge = _judge(broadcast.value, shape, tuple(langs), folder)
        for whole in batches:
            for a in range(0, whole.num_rows, _TOGETHER):
                batch = whole.slice(a, _TOGETHER)
                rows = judge.judge(batch.column(1).to_pylist())
                if found:
                    best: dict[tuple[int, int], float] = {}
                    for k, _, _, g, c in rows:
                        best[k, g] = max(best.get((k, g), 0.0), c)
                    out = [(k, langs[g], c) for (k, g), c in best.items()]
                    columns = [pa.array([x[1] for x in out], pa.string()), pa.array([x[2] for x in out], pa.float64())]
                else:
                    out = _segments(rows, langs)
                    columns = [pa.array([x[1] for x in out], pa.int32()), pa.array([x[2] for x in out], pa.int32()), pa.array([x[3] for x in out], pa.int32()), pa.array([x[4] for x in out], pa.string()), pa.array([x[5] for x in out], pa.float64())]
                keys = batch.column(0).take(pa.array([x[0] for x in out], pa.int64()))
                yield pa.RecordBatch.from_arrays([keys, *columns], ["_key", "lang", "confidence"] if found else ["_key", "segment", "start_offset", "end_offset", "lang", "confidence"])

    return run


def _segments(rows: list[tuple[int, int, int, int, float]], langs: list[str]) -> list[tuple[int, int, int, int, str, float]]:
    """Adjoining sentences of one language joined; confidence is their mean weighted by length."""
    out: list[list] = []
    for k, a, b, g, c in rows:
        if out and out[-1][0] == k and out[-1][4] == langs[g]:
            last = out[-1]
            last[5], last[6], last[3] = last[5] + c * (b - a), last[6] + b - a, b
        else:
            number = out[-1][1] + 1 if out and out[-1][0] == k else 0
            out.append([k, number, a, b, langs[g], c * (b - a), b - a])
    return [(k, n, a, b, g, c / w) for k, n, a, b, g, c, w in out]


def _mapped(df: DataFrame, key: str, text: str, samples: DataFrame, folder: str | None, found: bool) -> DataFrame:
    spark = df.sparkSession
    known = samples.select(F.lower(F.col("lang")), F.col("text")).where("lang is not null and text is not null").orderBy("sample_id").limit(SAMPLES * len(NAMES)).collect()
    table, langs = fit([(r[0], r[1]) for r in known], folder)
    data = spark.sparkContext.broadcast(table.tobytes())
    kind = df.schema[key].dataType.simpleString()
    schema = f"_key {kind}, " + ("lang string, confidence double" if found else "segment int, start_offset int, end_offset int, lang string, confidence double")
    rows = df.select(F.col(key).alias("_key"), F.col(text).alias("_text")).where(F.length("_text") > 0)
    return rows.mapInArrow(_run(data, table.shape, langs, folder, found), schema).withColumnRenamed("_key", key)


def spoken(df: DataFrame, key: str, text: str, samples: DataFrame, folder: str | None = None) -> DataFrame:
    """Key, lang and confidence of every language that a text has a sentence in, most of its confidences at least ``LEAST``."""
    return _mapped(df, key, text, samples, folder, True).where(F.col("confidence") >= LEAST)


def segments(df: DataFrame, key: str, text: str, samples: DataFrame, folder: str | None = None) -> DataFrame:
    """Segments of one language: key, segment, start_offset, end_offset, lang, confidence."""
    return _mapped(df, key, text, samples, folder, False)
