"""Problem 2: garbled text from wrong character encoding.

Bytes of one encoding read in another turn each character into a fixed
sequence of other characters. These sequences are computed once for all pairs
of encodings and matched together by one Aho-Corasick automaton; adjoining
matches of one pair form a span, and only accepted spans are replaced, so
correct text in between stays as it is. Text garbled twice is repaired by
running again over the result.

Pairs whose sequences are single ordinary letters (one-byte encodings of
Russian, double-byte ones of Chinese and Japanese) are matched by letter pairs
of the garbled alphabet and accepted for a run as a whole, by how common the
restored characters are. A replacement character U+FFFD is a case that cannot
be restored and is left.

Defined results: null, empty and pure ASCII text are no case; unusual but
intended characters (symbols, emoji, box drawing, Greek, capitals) are none.
"""

from __future__ import annotations

import bisect
import functools
import math
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# One-byte encodings that text is wrongly read in.
READERS = ("cp1252", "latin-1", "cp437", "cp850", "mac_roman", "cp1251", "koi8_r", "cp1250", "iso8859_2", "cp1254", "cp1257", "cp1253")
# Letters beyond ASCII of the languages written in Latin script.
LATIN = "ÀÁÂÃÄÅÆÇÈÉÊËÌÍÎÏÐÑÒÓÔÕÖØÙÚÛÜÝÞßàáâãäåæçèéêëìíîïðñòóôõöøùúûüýþÿĄąĆćČčĎďĘęĚěĞğİıŁłŃńŇňŐőŒœŘřŚśŞşŠšŤťŮůŰűŸŹźŻżŽž"
# Signs of Latin-1 that stand in ordinary text.
SIGNS = "\xa0¡¢£¤¥¦§¨©ª«¬\xad®¯°±²³´µ¶·¸¹º»¼½¾¿×÷"
# Frequency of the Russian letters in running text, in percent.
RUSSIAN = dict(zip("оеаинтсрвлкмдпуяыьгзбчйхжшюцщэфъё", (10.97, 8.45, 8.01, 7.35, 6.70, 6.26, 5.47, 4.73, 4.54, 4.40, 3.49, 3.21, 2.98, 2.81, 2.62, 2.01, 1.90, 1.74, 1.70, 1.65, 1.59, 1.44, 1.21, 0.97, 0.94, 0.73, 0.64, 0.48, 0.36, 0.32, 0.26, 0.04, 0.20)))
REPLACEMENT = "�"

_CYRILLIC = [chr(c) for c in (*range(0x410, 0x450), 0x401, 0x451)]
_GREEK = [chr(c) for c in range(0x391, 0x3CA) if c != 0x3A2]


def _bytes_of(reader: str) -> dict[int, str]:
    """Byte → character of a reader; a byte without meaning passes through as a control character."""
    out = {}
    for b in range(0x80, 0x100):
        try:
            out[b] = bytes([b]).decode(reader)
        except UnicodeDecodeError:
            out[b] = chr(b)
    return out


def _wide() -> list[str]:
    """Characters of three and four UTF-8 bytes: punctuation, symbols, emoji, kana, the national sets of ideographs."""
    ranges = ((0x2010, 0x2060), (0x20A0, 0x20C0), (0x2100, 0x2150), (0x2190, 0x2400), (0x2500, 0x27C0), (0x2B00, 0x2B60), (0x3000, 0x3100), (0xFE0E, 0xFE10), (0xFF00, 0xFFF0), (0xFFFD, 0xFFFE), (0x1F000, 0x1FB00), (0x1E00, 0x1F00))
    found = [chr(c) for lo, hi in ranges for c in range(lo, hi)] + ["​", "‌", "‍", "﻿"]
    for c in map(chr, range(0x4E00, 0xA000)):
        for national in ("gb2312", "shift_jis"):
            try:
                c.encode(national)
            except UnicodeEncodeError:
                continue
            found.append(c)
            break
    return found


#: Kinds of unit: wide is certain, latin is certain in a Western reader, pair needs company.
WIDE, NARROW, PAIR, KANA, HANZI, BYTE = "wide", "narrow", "pair", "kana", "hanzi", "byte"


@functools.cache
def automaton():
    """All garbled sequences; value: [(pair, kind, restored, length)]."""
    import ahocorasick

    units: dict[str, list[tuple[str, str, str]]] = {}
    narrow, cyrillic = [*LATIN, *SIGNS], {*_CYRILLIC, *_GREEK}
    wide = _wide()
    for reader in READERS:
        table = _bytes_of(reader)
        controls = [chr(c) for c in range(0x80, 0xA0)] if reader in ("cp1252", "latin-1") else []  # of text garbled twice
        for c in [*narrow, *controls, *_CYRILLIC, *_GREEK, *wide]:
            seq = "".join(table[b] for b in c.encode())
            kind = WIDE if len(seq) > 2 else PAIR if c in cyrillic or reader in ("cp1251", "koi8_r", "cp1253") else NARROW
            units.setdefault(seq, []).append((f"utf-8>{reader}", kind, c))
    table = _bytes_of("cp1252")
    for c in map(chr, (*range(0x3041, 0x3094), *range(0x30A1, 0x30F7))):
        for true in ("shift_jis", "euc_jp"):
            seq = "".join(table.get(b, chr(b)) for b in c.encode(true))
            units.setdefault(seq, []).append((f"{true}>cp1252", KANA, c))
    for lead in range(0xB0, 0xD8):
        for trail in range(0xA1, 0xFF):
            try:
                c = bytes([lead, trail]).decode("gb2312")
            except UnicodeDecodeError:
                continue
            units.setdefault(table[lead] + table[trail], []).append(("gb2312>cp1252", HANZI, c))
    for true in ("cp1251", "koi8_r", "iso8859_5"):
        byte = {c: c.encode(true)[0] for c in _CYRILLIC}
        for a in _CYRILLIC:
            for b in _CYRILLIC[32:]:
                units.setdefault(table[byte[a]] + table[byte[b]], []).append((f"{true}>cp1252", BYTE, a + b))
    found = ahocorasick.Automaton()
    for seq, meanings in units.items():
        found.add_word(seq, (len(seq), meanings))
    found.make_automaton()
    return found


@functools.cache
def _reverse(reader: str) -> dict[str, int]:
    return {c: b for b, c in _bytes_of(reader).items()}


def _log_russian(text: str) -> float:
    """Mean log frequency of the letters; a capital inside a word counts as unlikely."""
    total = n = 0
    for k, c in enumerate(text):
        if c.isalpha():
            total += math.log(RUSSIAN.get(c.lower(), 0.001) / 100) - 2.0 * (c.isupper() and k > 0 and text[k - 1].isalpha() and text[k - 1].islower())
            n += 1
    return total / max(n, 1)


_HIGH_RUN = re.compile(r"[\xa1-\xffŒœŠšŸŽžƒˆ˜–-›€™\x80-\x9f]+")
_HIGH_PHRASE = re.compile(r"[\xa1-\xff]+(?:[ ,.;:\-]{1,2}[\xa1-\xff]+)*")
_CYRILLIC_RUN = re.compile(r"[А-яЁё]{3,}(?:[ ,.\-]{1,2}[А-яЁё]+)*")
_LETTER = re.compile(r"[^\W\d_]")


def _spans_of_units(text: str) -> tuple[list[tuple[int, int, str]], set[str]]:
    """Accepted spans (start, end, restored) of UTF-8 read in a one-byte encoding; hints of the other kinds."""
    by: dict[str, list[tuple[int, int, str, str]]] = {}
    hints: set[str] = set()
    for end, (size, meanings) in automaton().iter(text):
        for pair, kind, c in meanings:
            if kind in (KANA, HANZI, BYTE):
                hints.add(kind)
            else:
                by.setdefault(pair, []).append((end + 1 - size, end + 1, kind, c))
    spans = []
    for pair, found in by.items():
        found.sort(key=lambda u: (u[0], u[0] - u[1]))
        run: list[tuple[int, int, str, str]] = []
        for unit in [*found, (len(text) + 9, 0, "", "")]:
            if run and unit[0] < run[-1][1]:
                continue
            if run and (unit[0] > run[-1][1]):
                kinds = {u[2] for u in run}
                if kinds != {PAIR} or len(run) > 1 or _alone(text, run[0]):
                    spans.append((run[0][0], run[-1][1], "".join(u[3] for u in run)))
                run = []
            run.append(unit)
    return spans, hints


def _alone(text: str, unit: tuple[int, int, str, str]) -> bool:
    """A single two-letter unit counts only inside a word of Latin letters that its reader's alphabet doesn't belong to."""
    start, end, _, c = unit
    before, after = text[start - 1 : start], text[end : end + 1]
    near = [x for x in (before, after) if _LETTER.match(x or "")]
    return c in LATIN and bool(near) and all(x.isascii() for x in near) and not text[start].isascii()


def _decode(run: str, true: str) -> str | None:
    try:
        return bytes(_reverse("cp1252").get(c, ord(c) & 0xFF) for c in run).decode(true)
    except UnicodeDecodeError:
        return None


def _spans_of_runs(text: str, hints: set[str]) -> list[tuple[int, int, str]]:
    """Accepted spans of one-byte Russian and double-byte Chinese and Japanese read as cp1252."""
    spans: list[tuple[int, int, str]] = []
    if KANA in hints:
        spans += _japanese(text)
    if BYTE in hints:
        for m in _HIGH_PHRASE.finditer(text):
            run, a, b = m.group(), m.start(), m.end()
            high = sum(not c.isascii() for c in run)
            if high < 3 or _touches_ascii(text, a, b):
                continue
            best = None
            for true in ("cp1251", "koi8_r", "iso8859_5"):
                t = _decode(run, true)
                if t and all(c.isascii() or c.lower() in RUSSIAN for c in t):
                    score = _log_russian(t)
                    best = max(best or (score, t), (score, t))
            if best and best[0] > (-3.3 if high == 3 else -3.6):
                spans.append((a, b, best[1]))
    if HANZI in hints:
        for m in _HIGH_RUN.finditer(text):
            run, a = m.group(), m.start()
            even = len(run) // 2 * 2
            if even < 6:
                continue
            t = _decode(run[:even], "gb18030")
            byte = _reverse("cp1252")
            if t and sum(0x4E00 <= ord(c) < 0xA000 or c in "，。、；：？！“”（）" for c in t) > 0.8 * len(t) and sum(0xB0 <= byte.get(run[k], ord(run[k]) & 0xFF) < 0xD8 for k in range(0, even, 2)) > 0.3 * even:
                spans.append((a, a + even, t))
    return spans


def _touches_ascii(text: str, a: int, b: int) -> bool:
    return any(c.isascii() and c.isalpha() for c in (text[a - 1 : a], text[b : b + 1]))


_SHIFTED = re.compile(r"(?:[\x81-\x83‚ƒ][^\s]|[^\x00-\x7f][^\s]|[!-~])*(?:[\x82‚][^\x00-\x7f]|[\x83ƒ][^\s])(?:[\x81-\x83‚ƒ][^\s]|[^\x00-\x7f][^\s]|[!-~])*")


def _japanese(text: str) -> list[tuple[int, int, str]]:
    """Runs without white space that read as Shift JIS and hold at least two kana, half of what is not ASCII being Japanese."""
    out = []
    for m in _SHIFTED.finditer(text):
        run = m.group()
        for cut in range(0, min(len(run), 3)):
            body = run[: len(run) - cut]
            t = _decode(body, "cp932")
            if t is None:
                continue
            other = [c for c in t if not c.isascii()]
            kana = sum(0x3041 <= ord(c) < 0x3100 for c in other)
            if kana >= 2 and sum(0x3000 <= ord(c) < 0xA000 for c in other) >= 0.8 * len(other):
                out.append((m.start(), m.start() + len(body), t))
            break
    return out


def _swapped(text: str) -> list[tuple[int, int, str]]:
    """Runs of Cyrillic words that are KOI8-R read as cp1251, or the reverse: the letters only fit once exchanged."""
    out = []
    for m in _CYRILLIC_RUN.finditer(text):
        run = m.group()
        if sum(map(str.isalpha, run)) < 5:
            continue
        plain = run.lower()
        if sum(map(plain.count, "оеаинт")) > 0.36 * len(plain):
            continue
        now = _log_russian(run if not run.isupper() else plain)
        for reader, true in (("cp1251", "koi8_r"), ("koi8_r", "cp1251"), ("cp1251", "cp866"), ("cp1251", "iso8859_5")):
            try:
                t = run.encode(reader).decode(true)
            except UnicodeError:
                continue
            if all(c.isascii() or c.lower() in RUSSIAN for c in t) and _log_russian(t) > max(now + 0.45, -3.5):
                out.append((m.start(), m.end(), t))
                break
    return out


# Letters of Polish, the Central European text that is read as Western.
POLISH = "ąćęłńóśźżĄĆĘŁŃÓŚŹŻ"
_WORD = re.compile(r"[a-zA-ZÀ-ÿœŒŸŽžŠš³¹¿±¶¼¯¦¬£¥¡]*[À-ÿœŒŸŽžŠš³¹¿±¶¼¯¦¬£¥¡][a-zA-ZÀ-ÿœŒŸŽžŠš³¹¿±¶¼¯¦¬£¥¡]*")
_INSIDE = re.compile(r"[a-zóñêæ][³¹¿±¶¼][a-zóñêæ]")
_AT_END = re.compile(r"[a-zóñêæ]{3}[¹±](?![\w³¹¿±¶¼])")
_LINE = re.compile(r"[^\r\n]+")


_VOWELS = frozenset("aeiouyóąę")
_CONSONANTS = re.compile(r"[^aeiouyóąę\W\d_]{5,}")


def _polish(word: str) -> bool:
    """Whether a restored word can be Polish: its letters, no nasal vowel beside another vowel (but behind i), no long run of consonants."""
    low = word.lower()
    if _VOWELS.isdisjoint(low) or any(c in "qvx" for c in low) or _CONSONANTS.search(low):
        return False
    return not any(c in "ąę" and ((k and low[k - 1] in _VOWELS - {"i"}) or (k + 1 < len(low) and low[k + 1] in _VOWELS)) for k, c in enumerate(low))


def _central(text: str) -> list[tuple[int, int, str]]:
    """Words of Polish in cp1250 or ISO 8859-2 read as Western: a sign inside a long enough word gives the line away.

    In such a line the words change whose every character beyond ASCII stands
    for a Polish letter and that can be Polish. A word of fewer than five letters,
    as units and formulas are (m³h, x±sd), gives nothing away without others beside it.
    """
    out = []
    if not _INSIDE.search(text):
        return out
    for line in _LINE.finditer(text):
        if not (_INSIDE.search(line.group()) or len(_AT_END.findall(line.group())) > 1):
            continue
        for true in ("cp1250", "iso8859_2") if not re.search(r"[a-z][±¶¼][a-z]", line.group()) else ("iso8859_2", "cp1250"):
            words = []
            for m in _WORD.finditer(line.group()):
                t = _decode(m.group(), true)
                if t and t != m.group() and all(c.isascii() or c in POLISH for c in t) and (_polish(t) or len(t) == 1):
                    words.append((line.start() + m.start(), line.start() + m.end(), t))
            sure = [(a, b) for a, b, _ in words if b - a >= 5 and _INSIDE.search(text[a:b])]
            short = [a for a, b, _ in words if _INSIDE.search(text[a:b])]
            if sure or short and (len(short) >= 3 or sum(b - a >= 5 for a, b, _ in words) >= 2) and len(words) >= 3:
                out += words
                break
    return out


_CYRILLIC_ANY = re.compile(r"[А-я]{3}")
#: Garbled sequences begin with two characters beyond ASCII, not both Cyrillic letters of Russian nor both East Asian.
_SUSPECT = re.compile(r"(?:[^\x00-\x7f\u0410-\u044fЁё\u3000-\u9fff\uff00-\uffef][^\x00-\x7f]|[\u0410-\u044fЁё][^\x00-\x7f\u0410-\u044fЁё])")


def _apart(spans: list[tuple[int, int, str]]) -> list[tuple[int, int, str]]:
    """The spans without overlap, longer ones first, in the order of the text."""
    kept: list[tuple[int, int, str]] = []
    for s in sorted(spans, key=lambda s: (s[0] - s[1], s[0])):
        at = bisect.bisect(kept, s)
        if (at and kept[at - 1][1] > s[0]) or (at < len(kept) and kept[at][0] < s[1]):
            continue
        kept.insert(at, s)
    return kept


def repair(text: str | None) -> tuple[bool, str | None]:
    """Whether ``text`` has a garbled sequence, and the text with every accepted span replaced."""
    if not text or text.isascii():
        return False, text
    found, met = REPLACEMENT in text, set()
    while text not in met:
        met.add(text)
        spans, hints = _spans_of_units(text) if _SUSPECT.search(text) else ([], set())
        if hints:
            inside = lambda run: sum(min(b, run[1]) - max(a, run[0]) for a, b, _ in spans if a < run[1] and run[0] < b)
            spans = spans + [run for run in _spans_of_runs(text, hints) if inside(run) < 0.8 * (run[1] - run[0])]
        if _CYRILLIC_ANY.search(text):
            spans = spans + _swapped(text)
        spans = _apart(spans + _central(text))
        if not spans:
            break
        found = True
        parts, at = [], 0
        for start, end, restored in spans:
            parts += [text[at:start], restored]
            at = end
        text = "".join([*parts, text[at:]])
    return found, text


def _repair_batches(with_text: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys, texts = [], []
            for key, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                found, restored = repair(text)
                if found:
                    keys.append(key)
                    texts.append(restored)
            columns = [pa.array(keys, batch.column(0).type)] + [pa.array(texts, pa.string())] * with_text
            yield pa.RecordBatch.from_arrays(columns, ["_key", "_text"][: 1 + with_text])

    return run


def restore(df: DataFrame, key: str, text: str, with_text: bool = True) -> DataFrame:
    """The rows of ``df`` with a garbled sequence: the key and the restored text.

    Pure ASCII rows are left out in the JVM. Other columns are not carried.
    """
    rows = df.select(F.col(key).alias("_key"), F.col(text).alias("_text")).where(F.octet_length("_text") > F.char_length("_text"))
    kind = df.schema[key].dataType.simpleString()
    out = rows.mapInArrow(_repair_batches(with_text), f"_key {kind}" + ", _text string" * with_text)
    return out.withColumnsRenamed({"_key": key, "_text": text})
