"""Column functions on text: repair, blank test, overlapping windows, tokens."""

from __future__ import annotations

import unicodedata

from pyspark.sql import Column
from pyspark.sql import functions as F

#: A character that is no white space; with the four separator controls the class is exactly Unicode's.
NON_BLANK = r"(?U)[^\s\x1c-\x1f]"
# Combining marks that the keyword index drops, and letters that it takes for others.
MARKS = "".join(chr(c) for lo, hi in ((0x300, 0x304), (0x306, 0x30C), (0x30F, 0x30F), (0x311, 0x311), (0x31B, 0x31B), (0x323, 0x328), (0x32D, 0x32E), (0x330, 0x331)) for c in range(lo, hi + 1))
_OTHERS = dict(zip("µſςϐϑϕϖϰϱϵ", "μsσβθφπκρε"))


def _folds() -> dict[str, str]:
    """Lower-case letters that are an ASCII letter with one mark, and this letter."""
    out = dict(_OTHERS)
    for c in map(chr, range(0x80, 0x1F00)):
        parts = unicodedata.normalize("NFD", c)
        if c == c.lower() and len(parts) == 2 and parts[0].isascii() and parts[0].isalpha() and unicodedata.category(parts[1]) == "Mn":
            out[c] = parts[0]
    return out


FOLDS = _folds()
ACCENTED, BASES = "".join(FOLDS), "".join(FOLDS.values())
TOKEN = r"[\p{L}\p{N}\p{Co}]+"


def decoded(content: Column) -> Column:
    """Text of UTF-8 bytes: invalid ones become U+FFFD, all line ends line feeds."""
    return F.regexp_replace(F.make_valid_utf8(content.cast("string")), "\r\n?", "\n")


def is_blank(text: Column) -> Column:
    return ~text.rlike(NON_BLANK)


def windows(text: Column, size: int = 1000, overlap: int = 200) -> Column:
    """Overlapping windows of ``size`` characters, a step of size − overlap apart, up to the first that reaches the end; blank ones are left out."""
    if not 0 <= overlap < size:
        raise ValueError("overlap must be at least 0 and below size")
    step = size - overlap
    last = F.greatest(F.lit(0), F.ceil((F.char_length(text) - size) / F.lit(float(step))).cast("int"))
    cut = F.transform(F.sequence(F.lit(0), last), lambda i: F.substring(text, i * step + 1, F.lit(size)))
    return F.filter(cut, lambda x: x.rlike(NON_BLANK))


def tokens(text: Column) -> Column:
    """Tokens of the keyword index: runs of letters and digits, lower case, letters with one accent folded, combining marks dropped."""
    return F.regexp_extract_all(F.translate(F.lower(text), ACCENTED + MARKS, BASES), F.lit(TOKEN), F.lit(0))
