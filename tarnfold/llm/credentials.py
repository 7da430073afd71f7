"""Problem 5: credentials embedded in source code, configuration and prose.

Every literal near an assignment context (a credential word, a login command,
a connection URL, an authorisation header) is segmented into dictionary words
by Viterbi over the words of a public vocabulary. What the words leave
unexplained is the residual; a literal whose residual is long is a secret.
Placeholders, masks, references to variables and stores, known hash formats
and settings about credentials are excluded before. Blocks of private keys are
found by their frame, also where the chunk begins or ends inside one.

Defined results: null and empty text give no row; lines end at line feed and
count from 1; a credential over several lines counts on its first; repeated
rows of a chunk count once.
"""

from __future__ import annotations

import functools
import math
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tarnfold.llm.vocabulary import word_ranks

MARK = "[REDACTED]"
#: Characters a residual must have, in all and as a share of the literal.
LEAST_RESIDUAL = 4
LEAST_SHARE = 0.3

# Words for credentials in the languages of the corpus, as they stand before a literal.
NOUNS = r"passwords?|passwd|passphrase|passcode|pass|pwd|secret|token|api[ _-]?key|apikey|access[ _-]?key|auth[ _-]?key|private[ _-]?key|signing[ _-]?key|encryption[ _-]?key|client[ _-]?key|credentials?|kennwort|passwort|mot de passe|contrase(?:ñ|n|Ã±)a|clave|parola d.ordine|wachtwoord|has(?:ł|l)o|lösenord(?:et)?|senha|пароль|ключ доступа|パスワード|密码|口令|密碼"
_NOUN = re.compile(rf"(?i){NOUNS}")
# One of these, in lower case, stands in every line with a credential.
TRIGGERS = ("pass", "pwd", "secret", "token", "key", "credential", "authorization", "kennwort", "contrase", "clave", "parola d", "wachtwoord", "hasł", "haslo", "lösenord", "senha", "пароль", "ключ доступа", "パスワード", "密码", "口令", "密碼", "://", "basic ", "bearer", "login", "log in", "benutzer", "username", "akia", "ghp_", "gho_", "ghs_", "ghu_", "ghr_", "github_pat", "xox", "_live_", "aiza", "glpat", "eyj")

_QUOTED = r"\"(?P<q1>[^\"\n]{4,})\"|'(?P<q2>[^'\n]{4,})'|`(?P<q3>[^`\n]{4,})`"
_BARE = r"(?P<bare>[^\s\"'`<>()\[\]{},;][^\s\"'`<>,]{3,})"
_KEYED = rf"(?:{NOUNS}|(?<=[a-zA-Z_])_?key|(?<=[a-z])Key)"
#: name = literal, "name": literal, name: literal, ENV NAME literal.
_ASSIGNED = re.compile(rf"(?i:(?P<name>{_KEYED}(?:[_\-]?(?:id|value|default|prod|dev|test|old|new|\d))?)[\"']?\]?\s*(?::=|=>|=|:|\s(?:is|ist|est|es|är|to|jest|to jest|é|è|—|-)\s)\s*)(?:{_QUOTED}|{_BARE})")
_ENV = re.compile(rf"\b(?:ENV|ARG|export|set|SET|setx)\s+(?P<name>[A-Z][A-Z0-9_]*(?:SECRET|TOKEN|KEY|PASSWORD|PASSWD|PWD|PASS)[A-Z0-9_]*)[ =]+(?:{_QUOTED}|{_BARE})")
_ATTRIBUTE = re.compile(r"(?i)(?:key|name|id)\s*=\s*\"(?P<name>[^\"]*(?:password|passwd|pwd|secret|token|apikey|accesskey|connectionkey|credential)[^\"]*)\"\s+value\s*=\s*\"(?P<q1>[^\"\n]{4,})\"")
_OPTION = re.compile(rf"(?i)(?:--?(?:password|passwd|pass|token|secret|api-key|access-key)[ =]|\bsshpass\s+-p\s*|\blogin\s+\S+\s+password\s+|\b(?:curl|wget)\b[^\n]*?\s-u\s+[^\s:]+:)(?:{_QUOTED}|{_BARE})")
_URL = re.compile(r"\b[a-zA-Z][a-zA-Z0-9+.\-]*://[^\s/:@\"']*:(?P<bare>[^\s@/\"']{3,})@")
_HEADER = re.compile(r"(?i)\b(?:basic|bearer|token)\s+(?P<bare>[A-Za-z0-9+/_.\-]{12,}={0,2})")
_HEADER_NAME = re.compile(r"(?i)\bx-(?:auth|api|access)[\w\-]*(?:token|key)\b[\"']?\s*[:=,]?\s*[\"']?(?P<bare>[A-Za-z0-9+/_.\-]{12,}={0,2})")
#: A credential word in prose; the literal follows within the sentence.
_PROSE = re.compile(r"(?i)\b(?:passwords?|passphrase|passcode|api[ -]key|access[ -]key|secret|token|credentials?|kennwort|passwort|mot de passe|contrase(?:ñ|n)a|clave|wachtwoord|has(?:ł|l)o|lösenord(?:et)?|senha|пароль)\b|パスワード|密码|口令|密碼")
_PROSE_TOKEN = re.compile(r"[^\s\"'`“”„()<>;\u3000-\u9fff\uff00-\uffef]{5,}")
_SENTENCE = re.compile(r"[.!?](?=\s|$)|[。！？\n]")
_NEXT_WORD = re.compile(r"\s+([^\W\d_]+)\s")
_LOGIN = re.compile(r"(?i)\b(?:log(?:in| in| on)(?: as| with)?|user(?:name)?|benutzer)\s+[\w.\-]+\s*[/:,]\s*(?P<bare>[^\s/,;()\"']{5,})")
#: Formats that vendors give their tokens; they are secrets wherever they stand.
_KNOWN = re.compile(r"(?<![\w+/.\-])(?P<bare>AKIA[A-Z0-9]{12,16}|gh[pousr]_[A-Za-z0-9]{30,}|github_pat_\w{30,}|xox[abpr]-[\w\-]{10,}|sk_live_\w{16,}|[a-z]{2,5}_live_\w{16,}|AIza[\w\-]{30,}|glpat-[\w\-]{16,}|eyJ[\w\-]{10,}\.[\w\-]{10,}\.[\w\-]*|eyJ[\w\-]{20,}\.eyJ[\w\-]{10,})(?![\w+/])")

_KEY_BEGIN = re.compile(r"-----BEGIN (?:[A-Z0-9]+ )*PRIVATE KEY(?: BLOCK)?-----")
_KEY_END = re.compile(r"-----END (?:[A-Z0-9]+ )*PRIVATE KEY(?: BLOCK)?-----")
_FRAME = re.compile(r"-----(BEGIN|END) ((?:[A-Z0-9]+ )*(?:KEY|CERTIFICATE)(?: BLOCK)?)-----")

_PLACEHOLDER = re.compile(r"(?i)^(?:[*•x.\-_#?]+|<.*>|\[.*\]|\{.*\}|\$.*|%.*%|.*\$\{.*|.*\{\{.*|(?:your|my|insert|enter|put|replace|example|sample|dummy|test|fake|change|todo|xxx|none|null|nil|true|false|undefined|redacted|masked|hidden|removed|secret|password|passwd|placeholder|changeme|change_me|default|empty|string|str|int|bool|bytes|optional)(?:[\W_].*)?|.*(?:changeme|redacted|placeholder|example|your[_-]).*)$")
_REFERENCE = re.compile(r"(?i)^(?:os\.|process\.|env\b|getenv|config\b|settings\b|self\.|this\.|vault|secrets?\.|ssm:|arn:|keyring|op://|sops|file:|/|~/|\./|[a-z_]\w*\(|[a-z_]\w*(?:\.[a-z_]\w*)*\[|[a-z_]\w*\.[a-z_]\w*\()|\)$|\(")
_BASE64 = re.compile(r"(?=[^0-9]*[0-9])(?=[^A-Z]*[A-Z])(?=[^a-z]*[a-z])[A-Za-z0-9+/]{24,}={0,2}")
_HASH = re.compile(r"(?i)^(?:sha\d*[-:]|md5[-:]|W/|[0-9a-f]{8}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{12}$|\$2[aby]\$|\$argon|\$[156]\$|data:)")
#: Contexts in which a digest, not a secret, follows.
_DIGEST_NAME = re.compile(r"(?i)\b(?:sha\d*|md5|checksum|digest|etag|hash|fingerprint|commit|uuid|integrity)\b")
_SETTING = re.compile(r"(?i)(?:min|max|length|len|count|size|limit|expir\w*|ttl|age|policy|required|enabled|rotation|days|hours|timeout|type|field|file|path|url|uri|name|label|header|prefix|regex|pattern|hint|version|algorithm|issuer|audience|scope|reset|strength|history)[_\-]?\d*$")


@functools.cache
def _lexicon(vocabulary: str | None) -> tuple[dict[str, float], int]:
    ranks = word_ranks(vocabulary)
    total = math.log(2 + max(ranks.values(), default=1))
    words = {w: math.log(2 + r) / total * 6 + 1.5 for w, r in ranks.items() if len(w) >= 3}
    return words, max(map(len, words), default=0)


def residual(literal: str, vocabulary: str | None = None) -> int:
    """Characters of ``literal`` that the cheapest segmentation leaves outside dictionary words and separators."""
    words, longest = _lexicon(vocabulary)
    low, n = literal.lower(), len(literal)
    cost, left = [0.0] * (n + 1), [0] * (n + 1)
    for i in range(1, n + 1):
        loose = not low[i - 1] in "_-. /:"
        cost[i], left[i] = cost[i - 1] + (3.2 if loose else 0.2), left[i - 1] + loose
        for j in range(max(0, i - longest), i - 2):
            if (c := words.get(low[j:i])) is not None and cost[j] + c < cost[i] and _whole(literal, j, i):
                cost[i], left[i] = cost[j] + c, left[j]
    return left[n]


def _whole(s: str, a: int, b: int) -> bool:
    """A word begins and ends at a change of kind or case, and is of one case but for its first letter."""
    piece = s[a:b]
    if not (piece.islower() or piece.isupper() or piece.istitle()):
        return False
    return (a == 0 or not s[a - 1].isalpha() or (s[a - 1].islower() and s[a].isupper())) and (b == len(s) or not s[b].isalpha() or (s[b - 1].islower() and s[b].isupper()))


def is_secret(literal: str, vocabulary: str | None = None, prose: bool = False) -> bool:
    """Whether a literal in a credential context is a secret.

    In prose a literal needs a digit, a sign inside or mixed case beside its residual.
    """
    s = literal.strip().rstrip("\\")
    if prose:
        s = s.rstrip(".,;:!?。")
    if len(s) < 5 or _PLACEHOLDER.match(s) or (_REFERENCE.search(s) and not _BASE64.fullmatch(s)) or _HASH.match(s) or s.isdigit():
        return False
    if prose and not (re.search(r"\d", s) or re.search(r"[A-Za-z][^\w\s.\-'’/:][A-Za-z0-9]|[a-z][A-Z]|[A-Z]{2}[a-z]", s)):
        return False
    n = residual(s, vocabulary)
    return n >= LEAST_RESIDUAL and n >= LEAST_SHARE * len(s)


def _value(m: re.Match) -> tuple[str, int, int]:
    for group in ("q1", "q2", "q3", "bare"):
        if group in m.re.groupindex and m.group(group) is not None:
            return m.group(group), m.start(group), m.end(group)
    return "", 0, 0


def _triggered(text: str) -> bool:
    low = text.lower()
    return any(word in low for word in TRIGGERS)


def find(text: str | None, vocabulary: str | None = None) -> list[tuple[int, int]]:
    """Spans [start, end) of the credentials in ``text``, sorted and apart."""
    if not text or not _triggered(text):
        return []
    spans = _key_blocks(text) if "KEY" in text else []
    at = 0
    for line in text.split("\n"):
        if len(line) > 7 and _triggered(line) and not _FRAME.search(line):
            spans += [(at + a, at + b) for a, b in _in_line(line, vocabulary)]
        at += len(line) + 1
    kept: list[tuple[int, int]] = []
    for s in sorted(spans, key=lambda s: (s[0], -s[1])):
        if not kept or s[0] >= kept[-1][1]:
            kept.append(s)
    return kept


def _in_line(line: str, vocabulary: str | None) -> list[tuple[int, int]]:
    out = []

    def take(m: re.Match, prose: bool = False) -> None:
        value, a, b = _value(m)
        if not any(a < e and s < b for s, e in out) and is_secret(value, vocabulary, prose):
            out.append((a, b - (len(value) - len(value.rstrip(".,;")) if prose else 0)))

    for m in _KNOWN.finditer(line):
        out.append(m.span("bare"))
    for rule in (_URL, _HEADER, _HEADER_NAME, _ATTRIBUTE, _OPTION, _ENV):
        for m in rule.finditer(line):
            if rule is not _HEADER or re.search(r"\d|[a-z][A-Z]", m["bare"]):
                take(m)
    for m in _ASSIGNED.finditer(line):
        a = m.start("name")
        while a and (line[a - 1].isalnum() or line[a - 1] in "_.-"):
            a -= 1
        name = line[a : m.end("name")]
        if _SETTING.search(name) and not _NOUN.fullmatch(name) or _DIGEST_NAME.search(name) or re.search(r"(?i)public", name):
            continue
        tail = line[m.end() : m.end() + 1]
        if m["bare"] is not None and (tail in ("(", "[") or re.search(r"[(\[]", m["bare"])):
            continue
        take(m)
    for m in _LOGIN.finditer(line):
        take(m, prose=True)
    read = 0
    for m in _PROSE.finditer(line):
        if line[m.end() : m.end() + 1] in ("=", "_", "(", "-") or line[m.start() - 1 : m.start()] in ("_", "-") or line[m.end() : m.end() + 3].lstrip()[:1] == "=":
            continue
        if m.end() < read:
            continue
        stop = _SENTENCE.search(line, m.end())
        end = stop.start() if stop else len(line)
        for t in _PROSE_TOKEN.finditer(line, m.end()):
            if t.start() > end:
                break
            value = t.group().rstrip(".,:")
            a, b = t.start(), t.start() + len(value)
            if "=" not in value[:-2] and not _MAIL.search(value) and is_secret(value, vocabulary, prose=True):
                if not any(a < e and s < b for s, e in out):
                    out.append((a, b))
                if (after := _NEXT_WORD.match(line, b)) and after[1].istitle():  # a new sentence without a full stop between
                    end = b
                    break
        read = end
    return out


_MAIL = re.compile(r"^[\w.+\-]+@[\w\-]+\.[\w.\-]+$|^https?:|^\w+\[\d+\]$|^\d[\d.:,/\-]*$")


_BODY = re.compile(r"[A-Za-z0-9+/=]{16,}\Z")


def _key_blocks(text: str) -> list[tuple[int, int]]:
    out = []
    lines, at = [], 0
    for line in text.split("\n"):
        lines.append((at, line.rstrip("\r")))
        at += len(line) + 1
    k = 0
    while k < len(lines):
        begin = _KEY_BEGIN.search(lines[k][1])
        if begin:
            start, j, end = lines[k][0] + begin.start(), k, None
            rest = lines[k][1][begin.end() :]
            if stop := _KEY_END.search(rest):
                out.append((start, lines[k][0] + begin.end() + stop.end()))
                k += 1
                continue
            end = lines[k][0] + len(lines[k][1])
            for j in range(k + 1, len(lines)):
                if stop := _KEY_END.search(lines[j][1]):
                    end = lines[j][0] + stop.end()
                    break
                if lines[j][1].strip() and not _BODY.match(lines[j][1].strip()) and not re.match(r"[A-Za-z\-]+: ", lines[j][1]):
                    j -= 1
                    break
                end = lines[j][0] + len(lines[j][1])
            out.append((start, end))
            k = max(j, k) + 1
            continue
        if stop := _KEY_END.search(lines[k][1]):
            j = k
            while j and re.match(r"[A-Za-z0-9+/=]+\Z", lines[j - 1][1].strip()):
                j -= 1
            out.append((lines[j][0], lines[k][0] + stop.end()))
        k += 1
    return out


def redact(text: str, vocabulary: str | None = None) -> str:
    """``text`` with each credential replaced; quotes, separators and line ends stay."""
    parts, at = [], 0
    for a, b in find(text, vocabulary):
        parts += [text[at:a], MARK]
        at = b
    return "".join([*parts, text[at:]])


def _batches(vocabulary: str | None, with_text: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys, lines, texts = [], [], []
            for key, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                spans = find(text, vocabulary)
                if not spans:
                    continue
                if with_text:
                    keys.append(key)
                    texts.append(redact(text, vocabulary))
                else:
                    for n in sorted({text.count("\n", 0, a) + 1 for a, _ in spans}):
                        keys.append(key)
                        lines.append(n)
            second = pa.array(texts, pa.string()) if with_text else pa.array(lines, pa.int64())
            yield pa.RecordBatch.from_arrays([pa.array(keys, batch.column(0).type), second], ["_key", "_out"])

    return run


def _candidates(df: DataFrame, key: str, text: str) -> DataFrame:
    return df.select(F.col(key).alias("_key"), F.col(text).alias("_text")).where(F.col("_text").isNotNull())


def locate(df: DataFrame, key: str, text: str, vocabulary: str | None = None) -> DataFrame:
    """One row per key and line on which a credential starts: key, line_no."""
    kind = df.schema[key].dataType.simpleString()
    return _candidates(df, key, text).mapInArrow(_batches(vocabulary, False), f"_key {kind}, _out long").withColumnsRenamed({"_key": key, "_out": "line_no"})


def redacted(df: DataFrame, key: str, text: str, vocabulary: str | None = None) -> DataFrame:
    """The rows of ``df`` that hold a credential: key and redacted text."""
    kind = df.schema[key].dataType.simpleString()
    return _candidates(df, key, text).mapInArrow(_batches(vocabulary, True), f"_key {kind}, _out string").withColumnsRenamed({"_key": key, "_out": text})
