"""Problem 6: splitting oversized texts at natural boundaries.

A text is cut from prefix sums of its token lengths. Every token end is a
boundary with a rank (paragraph, line, sentence, word); the boundaries of each
rank are one sorted array. From a piece's start the last boundary not beyond
the limit is found by binary search, the strongest rank first, as long as the
piece stays at least half full; a text without any boundary there is cut hard.
The next piece starts ``overlap`` characters before the end of the last one.

Defined results: null and empty text give no piece; a text within the limit is
one piece; lengths are Unicode code points; a hard cut does not part a
combining mark or joiner from its base; repeated rows are each split, the
found query lists a chunk once.
"""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

LIMIT = 1000
OVERLAP = 200

_TOKEN = re.compile(r"\S+\s*|\s+")
_SENTENCE_END = re.compile(r"[.!?…][\"'”’»)\]]*\s+$|[。！？][」』”]*\s*$")
_WIDE_END = re.compile(r"[。！？；][」』”]?")
PARAGRAPH, LINE, SENTENCE, WORD = 3, 2, 1, 0


def boundaries(text: str) -> list[np.ndarray]:
    """Sorted end offsets of the tokens, by rank: paragraph, line, sentence, word."""
    tokens = _TOKEN.findall(text)
    ends = np.cumsum(np.fromiter(map(len, tokens), np.int64, len(tokens)))
    rank = np.zeros(len(tokens), np.int8)
    for k, token in enumerate(tokens):
        if "\n" in token or "\r" in token:
            rank[k] = PARAGRAPH if token.count("\n") > 1 or token.count("\r") > 1 and "\n" not in token else LINE
        elif _SENTENCE_END.search(token):
            rank[k] = SENTENCE
    wide = np.fromiter((m.end() for m in _WIDE_END.finditer(text)), np.int64)
    found = [ends[rank == r] for r in (PARAGRAPH, LINE)]
    return [*found, np.union1d(ends[rank == SENTENCE], wide), ends]


def _joined(text: str, at: int) -> bool:
    """Whether a cut before ``at`` would part one visible character."""
    c = text[at]
    return c in "‍️" or text[at - 1] == "‍" or bool(unicodedata.combining(c)) or (c == "\n" and text[at - 1] == "\r")


def cut(text: str, limit: int = LIMIT, overlap: int = OVERLAP) -> list[tuple[int, int]]:
    """Offsets [start, end) of the pieces of ``text``."""
    n = len(text)
    if n == 0:
        return []
    if n <= limit:
        return [(0, n)]
    ranks, pieces, start = boundaries(text), [], 0
    while True:
        if n - start <= limit:
            pieces.append((start, n))
            return pieces
        most = start + limit
        least = start + max(overlap + 1, limit // 2)
        end = 0
        for ends in ranks:
            k = np.searchsorted(ends, most, "right") - 1
            if k >= 0 and ends[k] >= least:
                end = int(ends[k])
                break
        if not end:
            end = most
            while end > least and _joined(text, end):
                end -= 1
        pieces.append((start, end))
        begin = max(start + 1, end - overlap)
        # a piece doesn't begin inside a character, unless that has more parts than the overlap has places
        whole = next((at for at in range(begin, max(start, begin - overlap), -1) if not _joined(text, at)), begin)
        start = whole


def _pieces(key: str, text: str, limit: int, overlap: int, with_text: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, index, starts, ends, texts = [], [], [], [], []
            for i, t in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                for k, (a, b) in enumerate(cut(t, limit, overlap)):
                    ids.append(i)
                    index.append(k)
                    starts.append(a)
                    ends.append(b)
                    if with_text:
                        texts.append(t[a:b])
            columns = [pa.array(ids, batch.column(0).type), pa.array(index, pa.int32()), pa.array(starts, pa.int32()), pa.array(ends, pa.int32())]
            names = [key, "piece_index", "start_offset", "end_offset"]
            if with_text:
                columns.append(pa.array(texts, pa.string()))
                names.append(text)
            yield pa.RecordBatch.from_arrays(columns, names)

    return run


def split(df: DataFrame, key: str, text: str, limit: int = LIMIT, overlap: int = OVERLAP, only_over: bool = False, with_text: bool = True) -> DataFrame:
    """Pieces of ``df[text]`` keyed by ``df[key]``: key, piece_index, start_offset, end_offset and the piece.

    ``only_over`` keeps texts above the limit only; that test runs in the JVM, so
    short texts never reach Python. Other columns of ``df`` are not carried.
    """
    if not 0 <= overlap < limit:
        raise ValueError("overlap must be at least 0 and below the limit")
    size: Column = F.char_length(F.col(text))
    rows = df.select(F.col(key).alias("_key"), F.col(text).alias("_text")).where(size > (limit if only_over else 0))
    kind = df.schema[key].dataType.simpleString()
    schema = f"`{key}` {kind}, piece_index int, start_offset int, end_offset int" + (f", `{text}` string" if with_text else "")
    return rows.mapInArrow(_pieces(key, text, limit, overlap, with_text), schema)
