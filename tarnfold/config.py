"""Settings of the index service, passed on explicitly."""

from __future__ import annotations

import os
from collections.abc import Mapping
from dataclasses import dataclass

# File names left out by default, chunk geometry in characters.
EXCLUDED = ("*.iso", "*.zip", "*.tar.gz", "*.tar.bz2", "*.7z", "*.rar", "*.exe", "*.dll", "*.bin", "*.dat")
CHUNK_SIZE, CHUNK_OVERLAP = 1000, 200
MAX_FILE_BYTES = 50 * 1024 * 1024
PROMPT = "Describe what is shown in a few factual sentences, with any text that can be read."
# Model that each captioning backend uses unless told otherwise.
VISION_MODELS = {"gemini": "gemini-2.5-flash", "openai": "gpt-4o-mini", "ollama": "llava"}


@dataclass(frozen=True)
class Config:
    """``workers``: tasks that extract at once, at least; ``batch``: files of one such task; ``hash-N`` as the embedding model needs no library."""

    root: str = "tarnfold-index"
    paths: tuple[str, ...] = ()
    workers: int = 20
    batch: int = 50
    embedding_model: str = "BAAI/bge-small-en-v1.5"
    excluded: tuple[str, ...] = EXCLUDED
    chunk_size: int = CHUNK_SIZE
    chunk_overlap: int = CHUNK_OVERLAP
    vision_backend: str = "none"
    vision_model: str = ""
    vision_timeout: int = 120
    vision_prompt: str = PROMPT

    def __post_init__(self) -> None:
        if not 0 <= self.chunk_overlap < self.chunk_size:
            raise ValueError("chunk_overlap must be at least 0 and below chunk_size")

    @property
    def caption_model(self) -> str:
        return self.vision_model or VISION_MODELS.get(self.vision_backend, "")


def parts(value: str, separator: str) -> tuple[str, ...]:
    """The non-blank parts of a list in one string."""
    return tuple(p.strip() for p in value.split(separator) if p.strip())


def from_env(env: Mapping[str, str] = os.environ) -> Config:
    """Settings from TARNFOLD_* variables; paths are separated by colons, patterns by commas."""
    get = lambda name, default: env.get(f"TARNFOLD_{name}", default)
    return Config(
        root=get("ROOT", Config.root), paths=parts(get("PATHS", ""), ":"), workers=int(get("INDEX_WORKERS", "20")), batch=int(get("INDEX_BATCH", "50")),
        embedding_model=get("EMBEDDING_MODEL", Config.embedding_model), excluded=parts(get("EXCLUDE_PATTERNS", ",".join(EXCLUDED)), ","),
        chunk_size=int(get("CHUNK_SIZE", str(CHUNK_SIZE))), chunk_overlap=int(get("CHUNK_OVERLAP", str(CHUNK_OVERLAP))),
        vision_backend=get("VISION_BACKEND", "none").lower(), vision_model=get("VISION_MODEL", ""), vision_timeout=int(get("VISION_TIMEOUT", "120")), vision_prompt=get("VISION_PROMPT", PROMPT),
    )
