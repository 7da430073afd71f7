"""Embedders: the plug-in protocol and a deterministic one for tests and offline use."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator, Sequence
from typing import Protocol

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tarnfold.errors import EmbeddingFailed


class Embedder(Protocol):
    """Turns passages and queries into vectors of ``dimension`` values."""

    dimension: int

    def passages(self, texts: Sequence[str]) -> np.ndarray: ...

    def query(self, text: str) -> list[float]: ...


class HashEmbedder:
    """Unit vectors from hashed words: the same on every machine and run, alike for texts that share words."""

    def __init__(self, dimension: int = 384):
        self.dimension = dimension
        self.known: dict[str, np.ndarray] = {}

    def _word(self, word: str) -> np.ndarray:
        seed = int.from_bytes(hashlib.sha256(word.encode()).digest()[:4], "little")
        return np.random.Generator(np.random.PCG64(seed)).standard_normal(self.dimension, np.float32)

    def passages(self, texts: Sequence[str]) -> np.ndarray:
        known = self.known
        if len(known) > 1 << 16:
            known.clear()
        out = np.zeros((len(texts), self.dimension))
        for row, text in zip(out, texts):
            for word in (text or "").lower().split() or [""]:
                if word not in known:
                    known[word] = self._word(word)
                row += known[word]
        return (out / np.maximum(np.linalg.norm(out, axis=1, keepdims=True), 1e-12)).astype(np.float32)

    def query(self, text: str) -> list[float]:
        return self.passages([text])[0].tolist()


def embedder(name: str) -> Embedder:
    """The embedder of a name: ``hash-N``, or a model of an installed library."""
    if name.startswith("hash-"):
        return HashEmbedder(int(name[5:]))
    try:
        from fastembed import TextEmbedding
    except ImportError as e:
        raise EmbeddingFailed(f"no library for model {name}") from e

    class Model:
        def __init__(self) -> None:
            self.model = TextEmbedding(model_name=name)
            self.dimension = len(self.query("x"))

        def passages(self, texts: Sequence[str]) -> np.ndarray:
            return np.stack(list(self.model.embed(list(texts)))).astype(np.float32) if texts else np.zeros((0, self.dimension), np.float32)

        def query(self, text: str) -> list[float]:
            return next(iter(self.model.query_embed(text))).tolist()

    return Model()


_LOADED: dict[str, Embedder] = {}


def embed(df: DataFrame, id_col: str, text_col: str, model: str = "hash-384") -> DataFrame:
    """Vectors of texts: chunk_id, embedding. One model per worker, one Arrow batch at a time; null text has no row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if model not in _LOADED:
            _LOADED[model] = embedder(model)
        for batch in batches:
            x = _LOADED[model].passages(batch.column(1).to_pylist())
            ends = pa.array(np.arange(len(x) + 1, dtype=np.int32) * (x.shape[1] if len(x) else 0))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.ListArray.from_arrays(ends, pa.array(x.ravel(), pa.float32()))], ["chunk_id", "embedding"])

    rows = df.select(F.col(id_col).cast("long").alias("chunk_id"), F.col(text_col).alias("_text")).where("_text is not null")
    return rows.mapInArrow(run, "chunk_id long, embedding array<float>")
