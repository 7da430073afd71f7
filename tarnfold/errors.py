"""Exceptions of the service, and the classification of error messages."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Parts of messages of failures that may pass.
TRANSIENT = ("connection reset", "dns", "503", "timeout", "temporary failure", "name resolution", "broken pipe", "connection refused", "network unreachable")


# The messages of these errors.


class IndexError_(Exception):
    """Base of all errors of the service."""


class FileNotIndexed(IndexError_):
    def __init__(self, path: str):
        super().__init__(f"File not indexed: {path}")


class PathNotFound(IndexError_):
    def __init__(self, path: str):
        super().__init__(f"Path not found: {path}")


class ExtractionFailed(IndexError_):
    def __init__(self, path: str, reason: str):
        super().__init__(f"Failed to extract text from {path}: {reason}")


class EmbeddingFailed(IndexError_):
    def __init__(self, reason: str):
        super().__init__(f"Embedding failed: {reason}")


class UnsupportedFileType(IndexError_):
    def __init__(self, path: str, suffix: str):
        super().__init__(f"Unsupported file type '{suffix}' for: {path}")


def classify_error(message: Column) -> Column:
    """``transient`` where a message holds one of the known parts in any case, else ``permanent``."""
    return F.when(F.lower(message).rlike("|".join(TRANSIENT)), "transient").otherwise("permanent")
