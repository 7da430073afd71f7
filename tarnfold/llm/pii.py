"""Problem 3: personal information inside free text.

A character-level bidirectional LSTM with CRF transitions (``bilstm``), trained
in numpy on labelled spans (``pii_training``), tags e-mail addresses, phone
numbers, numbers given by an authority, street addresses and names. It reads every
character of every text, as one sequence up to ``WINDOW`` characters; longer
texts are read in windows that overlap and meet in the middle of the overlap.
No pattern decides what is read. Equal texts of a batch are read once. A
mention found once in a text is marked at its other occurrences too.

Metadata is read as JSON: every string value is tagged with its key as
context and replaced in place, so that all else stays byte for byte; text
that is no valid JSON is handled in the same way literal by literal.

Defined results: null and empty texts have no mention; repeated rows count
once; texts of any length are covered whole; a mention spans what belongs to
it, without the words around. A name is taken over a line end where a given
and a family part of the table meet there. An empty name table switches its
hint off.
"""

from __future__ import annotations

import functools
import json
import pkgutil
import re
from collections.abc import Iterator

import io

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tarnfold.llm import bilstm
from tarnfold.llm.vocabulary import ordinary_words

KINDS = ("email", "phone", "id_number", "address", "name")
WINDOW, STRIDE, HIDDEN, FEATURES = 1024, 896, 32, 3
#: Windows read together.
TOGETHER = 4096

_UPPER_ACCENTED = "ÀÁÂÃÄÅÆÇÈÉÊËÌÍÎÏÐÑÒÓÔÕÖØÙÚÛÜÝÞŁŚŻŹĆĄĘŃŠŽČŘ"
_LOWER_ACCENTED = "àáâãäåæçèéêëìíîïðñòóôõöøùúûüýþßłśżźćąęńšžčřőű"


@functools.cache
def _table() -> np.ndarray:
    """Class of every character of the basic plane: 0 padding, ASCII by itself, the others by kind."""
    t = np.full(0x10000, 104, np.int16)
    for c in range(32, 127):
        t[c] = c - 31
    t[[9, 11, 12]] = 1
    t[0xA0] = 1
    t[[10, 13]] = 96
    for c in _UPPER_ACCENTED:
        t[ord(c)] = 97
    for c in _LOWER_ACCENTED:
        t[ord(c)] = 98
    t[0x410:0x430], t[0x430:0x450] = 99, 100
    t[0x3040:0x3100], t[0x4E00:0xA000] = 101, 102
    t[[0x2019, 0x2018]] = t[ord("'")]
    t[[0x201C, 0x201D, 0x201E]] = t[ord('"')]
    t[[0x2010, 0x2011, 0x2012, 0x2013]] = t[ord("-")]
    t[[0x3001, 0xFF0C, 0x3002, 0xFF1A]] = 103
    t[0xB0], t[0xBA] = 105, 105
    return t


def number_of_classes() -> int:
    return 106


def classes_of(text: str) -> np.ndarray:
    code = np.frombuffer(text.encode("utf-32-le"), np.uint32)
    return _table().take(code, mode="clip")


_TOKEN = re.compile(r"[^\W\d_]{2,}")
#: Latin-1: letters in lower case, spaces for all else.
_LETTERS = bytes(ord(c.lower()) if re.match(r"[^\W\d_]", c) else 32 for c in map(chr, range(256)))
_NEXT_LINE = re.compile(r"\n[ \t\xa0]*([^\W\d_]{2,})")
_BROKEN = re.compile(r"(?:[^\W\d_]+\.?[ \xa0])*([^\W\d_]+),?[ \t\xa0]*\r?\n[ \t\xa0]*([^\W\d_]+)(?:[ \xa0][^\W\d_]+\.?)*")


class Lexicon:
    """Marks the characters of known parts of names: given, family, and words that begin with a capital after a known one."""

    def __init__(self, given: list[str], families: list[str]):
        self.kind = {w.lower(): 0 for w in given} | {w.lower(): 1 for w in families}
        self.latin = {w.encode("latin-1", "ignore") for w in self.kind}

    def occurs(self, text: str) -> bool:
        """Whether a part of the table may be in ``text``; false only where none is."""
        try:
            return not self.latin.isdisjoint(text.encode("latin-1").translate(_LETTERS).split())
        except UnicodeEncodeError:
            return not self.kind.keys().isdisjoint(map(str.lower, _TOKEN.findall(text)))

    def broken(self, text: str, a: int, b: int) -> bool:
        """Whether the only break in [a, b) is a line end between a given and a family part."""
        m = _BROKEN.fullmatch(text, a, b)
        return bool(m) and {self.kind.get(m[1].lower()), self.kind.get(m[2].lower())} == {0, 1}

    def joined(self, text: str) -> str:
        """``text``, as long as before, with spaces for line ends between a given and a family part."""
        out, end = [], 0
        for m in _NEXT_LINE.finditer(text):
            if (kind := self.kind.get(m[1].lower())) is not None:
                head = text[: m.start()].removesuffix("\r").rstrip(" \t\xa0")
                b = len(head) - head.endswith(",")
                a = b
                while a and head[a - 1].isalpha():
                    a -= 1
                if self.kind.get(head[a:b].lower()) == 1 - kind:
                    out += [text[end : len(head)], " " * (m.start(1) - len(head))]
                    end = m.start(1)
        return "".join([*out, text[end:]]) if out else text

    def flags(self, text: str) -> np.ndarray:
        out = np.zeros((len(text), FEATURES), np.uint8)
        if not self.occurs(text):
            return out
        for m in _TOKEN.finditer(text):
            if (k := self.kind.get(m.group().lower())) is not None:
                out[m.start() : m.end(), k] = 1
                out[max(0, m.start() - 24) : m.end() + 24, 2] = 1
        return out


def windows(length: int, a: int, b: int) -> list[int]:
    """Starts of the windows over [a, b), which end with the text; the last has what is left and the overlap, as nothing else need be read again."""
    if b - a <= WINDOW:
        return [min(max(0, (a + b - WINDOW) // 2), max(0, length - WINDOW))]
    return list(range(a, b - (WINDOW - STRIDE), STRIDE))


@functools.cache
def weights() -> bilstm.Params:
    with np.load(io.BytesIO(pkgutil.get_data(__name__, "pii_weights.npz"))) as file:
        return {k: file[k].astype(np.float32) for k in file.files}


class Tagger:
    """Tags many texts together in one worker: the network reads every character of each."""

    def __init__(self, given: list[str], families: list[str]):
        self.lexicon, self.network = Lexicon(given, families), bilstm.Network(weights())

    def _codes(self, text: str) -> np.ndarray:
        text = self.lexicon.joined(text) if "\n" in text else text
        codes, flags = classes_of(text) << FEATURES, self.lexicon.flags(text)
        if flags.any():
            codes += flags @ (1 << np.arange(FEATURES, dtype=np.int16))
        return codes

    def tag(self, texts: list[str | None]) -> list[list[tuple[int, int, str]]]:
        """Sorted spans (start, end, kind) of each text; equal texts are read once."""
        codes = {text: self._codes(text) for text in dict.fromkeys(filter(None, texts))}
        where = [(text, s) for text in codes for s in windows(len(text), 0, len(text))]
        where.sort(key=lambda w: -min(WINDOW, len(w[0]) - w[1]))
        own: dict[str, list[tuple[int, np.ndarray | None]]] = {}
        for c in range(0, len(where), TOGETHER):
            part = where[c : c + TOGETHER]
            for (text, s), label in zip(part, self.network.read([codes[text][s : s + WINDOW] for text, s in part])):
                own.setdefault(text, []).append((s, label))
        spans = {text: _spans(text, _reconcile(text, found), self.lexicon) for text, found in own.items() if any(label is not None for _, label in found)}
        return [spans.get(text, []) for text in texts]


def _reconcile(text: str, own: list[tuple[int, np.ndarray | None]]) -> np.ndarray:
    """One label per character: windows that overlap meet in the middle between their edges."""
    label = np.zeros(len(text), np.int8)
    end = 0
    for s, found in sorted(own, key=lambda w: w[0]):
        n = min(WINDOW, len(text) - s)
        skip = (end - s) // 2 if s else 0
        label[s + skip : s + n] = 0 if found is None else found[skip:]
        end = s + n
    return label


def _spans(text: str, label: np.ndarray, lexicon: Lexicon) -> list[tuple[int, int, str]]:
    edge = np.flatnonzero(np.diff(np.concatenate([[0], label, [0]])))
    raw = [(int(a), int(b), KINDS[label[a] - 1]) for a, b in zip(edge[:-1], edge[1:]) if label[a]]
    out: list[tuple[int, int, str]] = []
    for a, b, kind in raw:
        a, b = fitted(text, a, b, kind, lexicon)
        if b > a and plausible(text, a, b, kind, lexicon) and not (out and a < out[-1][1]):
            out.append((a, b, kind))
    more = []
    for a, b, kind in out:
        if kind in ("email", "phone", "id_number") and text.count(text[a:b]) > 1:
            at = text.find(text[a:b])
            while at >= 0:
                if not any(at < e and s < at + b - a for s, e, _ in out + more):
                    more.append((at, at + b - a, kind))
                at = text.find(text[a:b], at + 1)
    return sorted(out + more)


_FULL_WORD = re.compile(r"[^\W\d_]{2,}")
_SOME_MAIL = re.compile(r"(?i)[\w.+\-]+\s?(?:@|\(at\)|\[at\]|&#64;|＠| at )\s?[\w\-]+")
_PHONE_LEFT = re.compile(r"[+(\d][\d ().\-\xa0]*\Z")
_PHONE_RIGHT = re.compile(r"[\d()./\-]*\d")
_SENTENCE_IN_NAME = re.compile(r".*(?:[^\W\d_]{3,}[.:!?]\s+|[\r\n]+)", re.S)
# Words that open a line or a sentence and are no part of a name.
_NOT_FIRST = frozenset("das die der ein eine het det ett les los las the regards thanks saluti cordialement cumprimentos grüße saludos kind dear env while kennwort benutzer the from note mail tel phone monday tuesday wednesday thursday friday saturday sunday montag dienstag mittwoch donnerstag freitag samstag sonntag vraag chiedere fråga bitte appeler llamar avisar falar and und et y i e och en".split())


def fitted(text: str, a: int, b: int, kind: str, lexicon: Lexicon) -> tuple[int, int]:
    """The span without marks at its edges, whole where the tagger began or ended inside a word or number."""
    if kind == "phone":
        if a and text[a - 1] in "0123456789+(" and (m := _PHONE_LEFT.search(text, max(0, a - 12), a)):
            a = m.start()
        if m := _PHONE_RIGHT.match(text, b, min(len(text), b + 8)):
            b = m.end()
        if text[a] == "(" and text[a:b].count("(") > text[a:b].count(")"):
            a += 1
    elif kind in ("id_number", "name", "email"):
        inner = "[^\\W_\u3040-\u9fff]" if kind != "email" else "[a-zA-Z0-9_.+\\-]"
        if m := re.compile(inner + "{1,12}\\Z").search(text, max(0, a - 12), a):
            a = m.start()
        if m := re.compile(inner + "{1,12}").match(text, b, min(len(text), b + 12)):
            b = m.end()
    while a < b and text[a] in " \t\r\n,;:\"'<./-" or a < b and text[a] == "(" and kind != "phone":
        a += 1
    while a < b and text[b - 1] in " \t\r\n,;:\"'>.-/" or a < b and text[b - 1] in "()" and (kind != "email" or text[b - 1] == "("):
        if kind == "name" and text[b - 1] == "." and b - a > 1 and re.search(r"(?:^|\s)[^\W\d_]\.$", text[a:b]):
            break
        b -= 1
    if kind == "name":
        if not lexicon.broken(text, a, b) and (m := _SENTENCE_IN_NAME.match(text, a, b)):
            head, tail = (a, m.end()), (m.end(), b)
            first = text[a:b].splitlines()[0].rstrip(".:!? ")
            a, b = tail if len(_FULL_WORD.findall(text[slice(*tail)])) >= 2 else (a, a + len(first)) if "\n" in text[slice(*head)] or len(_FULL_WORD.findall(first)) >= 2 else tail
        if m := re.compile(r"(.+?), [^\W\d_]+(?:straße|str|weg|gasse|allee|platz|ul)\b").match(text, a, b):
            b = m.end(1)
        while (m := re.compile(r"[^\W\d_]+[ ,]+").match(text, a, b)) and m.group().strip(" ,").lower() in _NOT_FIRST:
            a = m.end()
    return a, b


def _joins(c: str) -> bool:
    """Whether a character would continue a word or number; East Asian ones stand beside either without a space."""
    return c.isalnum() and not "\u3040" <= c <= "\u9fff"


_WORD_BEFORE, _WORD_AFTER = re.compile(r"([^\W\d_]+)[ \xa0]+\Z"), re.compile(r"[ \xa0]+([^\W\d_]+)")
# Words in lower case that stand inside addresses, and ends of words for streets.
_IN_STREETS = frozenset("de del la las los da do das dos du des dei della di el le bis ter rue avenue place boulevard chemin quai allée impasse ul al im am an der den zum zur van aan op apt".split())
_STREET_ENDS = ("str", "straße", "strasse", "weg", "gasse", "allee", "platz", "ring", "ufer", "damm", "straat", "laan", "gracht", "kade", "plein", "gatan", "vägen", "torget", "gränd")
# Ordinary words of two letters, which the public vocabulary does not tell from pieces of words.
_SHORT = frozenset("am an as at be by do go he if in is it me my no of on or so to up us we".split())
# Words in lower case that stand inside names.
_PARTICLES = frozenset("de da di del della der den van von zu la le el e y i".split())


def plausible(text: str, a: int, b: int, kind: str, lexicon: Lexicon) -> bool:
    """An exact check of what every mention of a kind has; torn spans fail it."""
    s, before, after = text[a:b], text[a - 1 : a], text[b : b + 1]
    if kind == "email":
        return bool(_SOME_MAIL.search(s)) and not re.match(r"git@|@", s) and not re.search(r"://[^\s/@]*:?[^\s/@]*$", text[max(0, a - 80) : a])
    digits = sum(c.isdigit() for c in s)
    if kind == "phone":
        return 7 <= digits <= 18 and not _joins(before) and before not in (",", "_") and not _joins(after) and not re.match(r"\d{4}-\d\d-\d\d|\d{1,3}\.\d{1,3}\.\d{1,3}\.\d", s) and " / " not in s and not re.search(r" \d$", s) and not re.search(r"[a-z]", s.replace("ext", ""))
    if kind == "id_number":
        return digits >= (6 if re.search("[A-Z]", s) else 9) and not re.search(r"[A-Z0-9]{17}", s) and not _joins(before) and not _joins(after) and before not in (",", ".", "/", "_", "=", "+") and after not in ("/", "_", "+", "=") and not re.search(r"[a-z]", s) and not re.match(r"\d{4}-\d\d(?:-|$)", s)
    if kind == "address":
        if any(w.islower() and w not in _IN_STREETS and not w.endswith(_STREET_ENDS) for w in _FULL_WORD.findall(s)):
            return False
        words = _FULL_WORD.findall(s)
        if len(words) == 2 and len(re.findall(r"\d+", s)) == 1 and not re.search(r"[,\n]", s):  # a street at most, without a place
            return False
        return digits >= 1 and len(words) >= 2 and len(s) >= 12 and bool(re.search(r"[ ,]\d|\d[ ,]", s)) and not re.search(r"[=$<>;{}]", s)
    words = _FULL_WORD.findall(s)
    if digits or not words or _joins(before) or _joins(after) or before in ("_", "/", "{", "$", "@", "-") or after in ("_", "/", "(", "@") or re.search(r"[_/${}=|@#\[\]<>«»“”:]", s) or len(words) > 6:
        return False
    if not any(w.lower() in lexicon.kind for w in words):
        if not re.search(r"\b[^\W\d_]\.", s) and all(w.lower() in ordinary_words() or w.lower() in _SHORT for w in words if w not in _PARTICLES):
            return False
        if s.isupper() and any(m and m[1].isupper() for m in (_WORD_BEFORE.search(text, max(0, a - 24), a), _WORD_AFTER.match(text, b))):
            return False
    odd = [w for w in words if not (w.istitle() or w.isupper() or w.islower() or re.match(r"(?:Mc|Mac|De|Di|Van|Le|La|O)[A-Z]", w))]
    low = [w for w in words if w.islower() and w not in _PARTICLES]
    strange = [w for w in low if w not in lexicon.kind]
    return not odd and (not strange or len(low) == len(words) == 2 and min(map(len, strange)) > 3) and any(len(w) >= 3 for w in words) and (len(words) >= 2 or bool(re.search(r"\b[^\W\d_]\.", s))) and not (s.isupper() and len(words) > 3)


def mark(text: str, spans: list[tuple[int, int, str]]) -> str:
    """``text`` with each span replaced by its kind in capitals, in brackets."""
    parts, at = [], 0
    for a, b, kind in spans:
        parts += [text[at:a], f"[{kind.upper()}]"]
        at = b
    return "".join([*parts, text[at:]])


_LITERAL = re.compile(r'"((?:[^"\\]|\\.)*)"(\s*:)?', re.S)


def literals(raw: str) -> list[tuple[int, int, str, str]]:
    """String values of JSON text: (start, end) of the literal with its quotes, the value, the last key before."""
    out, key, end = [], "", 0
    for m in _LITERAL.finditer(raw):
        try:
            value = json.loads(f'"{m[1]}"', strict=False)
        except ValueError:
            value = m[1]
        if m[2]:
            key = value
        else:
            out.append((m.start(), m.start() + len(m[1]) + 2, value, key))
        end = m.end()
    if (cut := raw.find('"', end)) >= 0 and cut + 1 < len(raw):
        out.append((cut, len(raw), raw[cut + 1 :], key))
    if not out and raw.strip() and raw.strip()[0] not in "{[":
        out.append((0, len(raw), raw, ""))
    return out


def _contextual(value: str, key: str) -> tuple[str, int]:
    head = f"{key}: " if key and not re.fullmatch(r"[kv]", key) else ""
    return head + value, len(head)


def tag_rows(tagger: Tagger, contents: list[str | None], metas: list[str | None]) -> tuple[list[list[tuple[int, int, str]]], list[list[tuple[int, int, str, str, list[tuple[int, int, str]]]]]]:
    """Spans of the contents; of each metadata text its literals (start, end, value, quote, spans) with mentions."""
    texts = list(contents)
    where: list[tuple[int, int, int, str, int]] = []
    for row, raw in enumerate(metas):
        if raw:
            for a, b, value, key in literals(raw):
                if value:
                    text, head = _contextual(value, key)
                    where.append((row, a, b, value, head))
                    texts.append(text)
    found = tagger.tag(texts)
    meta: list[list] = [[] for _ in metas]
    for (row, a, b, value, head), spans in zip(where, found[len(contents) :]):
        own = [(max(0, s - head), e - head, k) for s, e, k in spans if e > head]
        if own:
            meta[row].append((a, b, value, '"' if metas[row][a : a + 1] == '"' else "", own))
    return found[: len(contents)], meta


def masked_meta(raw: str, found: list[tuple[int, int, str, str, list[tuple[int, int, str]]]]) -> str:
    parts, at = [], 0
    for a, b, value, quote, spans in found:
        new = mark(value, spans)
        closed = quote and raw[b - 1] == '"' and b - 1 > a
        body = json.dumps(new, ensure_ascii=raw.isascii())[1:-1] if closed else new
        parts += [raw[at:a], quote, body, '"' if closed else ""]
        at = b
    return "".join([*parts, raw[at:]])


@functools.lru_cache(maxsize=1)
def _tagger(given: tuple[str, ...], families: tuple[str, ...]) -> Tagger:
    return Tagger(list(given), list(families))


_TOGETHER_ROWS = 2048


def _batches(given: tuple[str, ...], families: tuple[str, ...], with_text: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tagger = _tagger(given, families)
        for whole in batches:
            for c in range(0, whole.num_rows, _TOGETHER_ROWS):
                batch = whole.slice(c, _TOGETHER_ROWS)
                contents, metas = batch.column(1).to_pylist(), batch.column(2).to_pylist()
                spans, meta = tag_rows(tagger, contents, metas)
                row, first, second = [], [], []
                for k in range(len(contents)):
                    if with_text:
                        if spans[k] or meta[k]:
                            row.append(k)
                            first.append(mark(contents[k], spans[k]) if spans[k] else contents[k])
                            second.append(masked_meta(metas[k], meta[k]) if meta[k] else metas[k])
                    else:
                        kinds = {("content", kind) for _, _, kind in spans[k]} | {("metadata", kind) for *_, own in meta[k] for _, _, kind in own}
                        for field, kind in sorted(kinds):
                            row.append(k)
                            first.append(field)
                            second.append(kind)
                yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(row, pa.int64())), pa.array(first, pa.string()), pa.array(second, pa.string())], ["_key", "_first", "_second"])

    return run


def _mapped(df: DataFrame, key: str, content: str, metadata: str, names: DataFrame, with_text: bool) -> DataFrame:
    parts = names.select("name_part", "kind").where("name_part is not null").distinct().orderBy("name_part", "kind").collect()
    given = tuple(r[0] for r in parts if r[1] == "given")
    families = tuple(r[0] for r in parts if r[1] == "family")
    rows = df.select(F.col(key).alias("_key"), F.col(content).alias("_content"), F.col(metadata).alias("_metadata")).where("_content is not null or _metadata is not null")
    kind = df.schema[key].dataType.simpleString()
    return rows.mapInArrow(_batches(given, families, with_text), f"_key {kind}, _first string, _second string")


def mentions(df: DataFrame, key: str, content: str, metadata: str, names: DataFrame) -> DataFrame:
    """Key, field (``content`` or ``metadata``) and pii_type of the mentions of each row."""
    return _mapped(df, key, content, metadata, names, False).withColumnsRenamed({"_key": key, "_first": "field", "_second": "pii_type"})


def masked(df: DataFrame, key: str, content: str, metadata: str, names: DataFrame) -> DataFrame:
    """The rows with a mention: key, content and metadata with placeholders."""
    return _mapped(df, key, content, metadata, names, True).withColumnsRenamed({"_key": key, "_first": content, "_second": metadata})
