"""Column functions on paths: file types, name patterns, prefixes."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

# Suffixes of each type of file. Markdown comes before text, which has its suffixes too.
TEXT = [
    ".txt", ".md", ".markdown", ".rst", ".csv", ".tsv", ".json", ".yaml", ".yml", ".toml",
    ".ini", ".cfg", ".py", ".js", ".ts", ".go", ".rs", ".java", ".c", ".cpp",
    ".h", ".sh", ".bash", ".zsh", ".fish", ".html", ".htm", ".xml", ".svg", ".sql",
    ".r", ".rb", ".pl", ".lua", ".tex", ".bib", ".org", ".log", ".conf", ".env",
]
IMAGE = [".jpg", ".jpeg", ".png", ".gif", ".heic", ".heif", ".webp", ".bmp", ".tiff", ".tif"]
VIDEO = [".mp4", ".mov", ".avi", ".webm", ".mkv"]
TYPES = {"pdf": [".pdf"], "docx": [".docx"], "markdown": [".md", ".markdown"], "text": TEXT, "image": IMAGE, "video": VIDEO}
NEEDS_CAPTION = ("image", "video")
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def base_name(path: Column) -> Column:
    return F.element_at(F.split(path, "/"), -1)


def suffix(path: Column) -> Column:
    """Lower-case last suffix with its dot; empty for names without one, as those that only begin with a dot."""
    return F.lower(F.regexp_extract(base_name(path), r"^.+(\.[^.]+)$", 1))


def file_type(path: Column) -> Column:
    """Type of a path by its suffix, null where it has none of the known ones."""
    found = F.lit(None).cast("string")
    for kind, suffixes in reversed(TYPES.items()):
        found = F.when(suffix(path).isin(suffixes), kind).otherwise(found)
    return found


def supported(captions: bool) -> list[str]:
    """Suffixes that are indexed; images and videos need a captioning backend."""
    return sorted({s for kind, suffixes in TYPES.items() if captions or kind not in NEEDS_CAPTION for s in suffixes})


def glob_regex(patterns: list[str] | tuple[str, ...]) -> str:
    """One anchored pattern for file names that match any of the globs."""
    def one(glob: str) -> str:
        out, i = "", 0
        while i < len(glob):
            c = glob[i]
            i += 1
            if c == "*":
                out += ".*"
            elif c == "?":
                out += "."
            elif c == "[" and (end := glob.find("]", i + 1)) > 0:
                body = glob[i:end].replace("\\", "\\\\")
                out += "[" + ("^" + body[1:] if body[0] == "!" else body) + "]"
                i = end + 1
            else:
                out += re.escape(c)
        return out

    return "(?s)^(?:" + "|".join(map(one, patterns)) + ")$"


def ascii_lower(c: Column) -> Column:
    return F.translate(c, _UPPER, _LOWER)


def has_prefix(path: Column, prefix: str | None, compat: bool = True, boundary: bool = False) -> Column:
    """Whether a path begins with ``prefix``; none or an empty one lets all through.

    ``compat`` follows the SQL LIKE of the index: per cent and underscore in
    the prefix are wildcards and ASCII case is ignored. ``boundary`` asks for a
    separator behind the prefix. Otherwise the prefix is taken literally.
    """
    if not prefix:
        return F.lit(True)
    prefix = prefix + "/" if boundary else prefix
    if not compat:
        return path.startswith(prefix)
    return F.expr("true") if prefix == "" else F.call_function("like", ascii_lower(path), F.lit(prefix.translate(str.maketrans(_UPPER, _LOWER)) + "%"), F.lit("\x01"))
