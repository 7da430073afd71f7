"""The public tokenizer files: where they lie and what they hold."""

from __future__ import annotations

import base64
import functools
import os

#: Folder of the files; a parameter of every operator that needs one, or this environment variable.
FOLDER = os.environ.get("TARNFOLD_TOKENIZERS", "/opt/tokenizers")

# Fixed value: how the byte-level vocabulary splits text before merging.
PATTERN = r"'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"


@functools.cache
def byte_ranks(name: str = "byte_bpe_50k", folder: str | None = None) -> dict[bytes, int]:
    """Token bytes → id of a byte-level vocabulary."""
    with open(f"{folder or FOLDER}/{name}.tiktoken", "rb") as file:
        return {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, file)}


@functools.cache
def word_ranks(folder: str | None = None) -> dict[str, int]:
    """Lower-case words of ASCII letters that are whole words of the vocabulary → rank of the commoner spelling."""
    out: dict[str, int] = {}
    for token, rank in byte_ranks(folder=folder).items():
        word = token[1:] if token[:1] == b" " else b""
        if len(word) >= 3 and word.isalpha() and word.isascii():
            text = word.decode().lower()
            out[text] = min(rank, out.get(text, rank))
    return out


@functools.cache
def ordinary_words(folder: str | None = None) -> frozenset[str]:
    """Words of three or more ASCII letters that the vocabulary has in lower case: no names."""
    found = (token[1:] for token in byte_ranks(folder=folder) if token[:1] == b" ")
    return frozenset(w.decode() for w in found if len(w) >= 3 and w.isalpha() and w.isascii() and w.islower())
