"""Validation of request parameters."""

from __future__ import annotations

from dataclasses import dataclass

# Bounds of requests.
PATH_MAX, QUERY_MAX, SEARCH_MAX, LIST_MAX = 4096, 2000, 100, 500


def text(name: str, value: object, most: int, optional: bool = False) -> None:
    if value is None and optional:
        return
    if not isinstance(value, str) or not (0 if optional else 1) <= len(value) <= most:
        raise ValueError(f"{name} must be text of {0 if optional else 1} to {most} characters")


def whole(name: str, value: object, least: int, most: int | None = None) -> None:
    if isinstance(value, bool) or not isinstance(value, int) or value < least or (most is not None and value > most):
        raise ValueError(f"{name} must be a whole number from {least}" + (f" to {most}" if most is not None else ""))


@dataclass(frozen=True)
class Search:
    query: str
    path: str | None = None
    limit: int = 10

    def __post_init__(self) -> None:
        text("query", self.query, QUERY_MAX)
        text("path", self.path, PATH_MAX, optional=True)
        whole("limit", self.limit, 1, SEARCH_MAX)


@dataclass(frozen=True)
class Similar:
    file_path: str
    limit: int = 10

    def __post_init__(self) -> None:
        text("file_path", self.file_path, PATH_MAX)
        whole("limit", self.limit, 1, SEARCH_MAX)


@dataclass(frozen=True)
class OnePath:
    path: str

    def __post_init__(self) -> None:
        text("path", self.path, PATH_MAX)


@dataclass(frozen=True)
class Reindex:
    path: str | None = None

    def __post_init__(self) -> None:
        text("path", self.path, PATH_MAX, optional=True)


@dataclass(frozen=True)
class Listing:
    path: str | None = None
    limit: int = 50
    offset: int = 0

    def __post_init__(self) -> None:
        text("path", self.path, PATH_MAX, optional=True)
        whole("limit", self.limit, 1, LIST_MAX)
        whole("offset", self.offset, 0)


@dataclass(frozen=True)
class Chunks:
    file_path: str
    limit: int = 50

    def __post_init__(self) -> None:
        text("file_path", self.file_path, PATH_MAX)
        whole("limit", self.limit, 1, LIST_MAX)


@dataclass(frozen=True)
class Quality:
    path: str | None = None
    show_resolved: bool = False
    limit: int = 100

    def __post_init__(self) -> None:
        text("path", self.path, PATH_MAX, optional=True)
        whole("limit", self.limit, 1, LIST_MAX)
