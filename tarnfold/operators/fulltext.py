"""Keyword search: query grammar, postings, BM25.

A query is parsed on the driver into an expression over the token array of a
row. One aggregation gathers the corpus statistics (rows, tokens, rows per
phrase), which is one row; scoring is a projection and a top-k.

Over texts (``search``) the token array is made for every row. Over a stored
index (``lookup``) only the postings of the query's words are read, from the
buckets that hold them, and the array of a row is filled at their positions.
"""

from __future__ import annotations

import re
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tarnfold.functions.text import FOLDS, MARKS, tokens

# BM25 parameters and the floor of the inverse document frequency.
K1, B, IDF_FLOOR, NEAR_DEFAULT = 1.2, 0.75, 1e-6, 10
#: Buckets of the stored index.
BUCKETS = 64
_FOLD = str.maketrans({**FOLDS, **dict.fromkeys(MARKS)})


class QueryError(ValueError):
    """A keyword query that doesn't follow the grammar."""


@dataclass(frozen=True)
class Phrase:
    words: tuple[str, ...]
    prefix: bool = False
    initial: bool = False

    def at(self, t: Column, i: Column, x: Column) -> Column:
        """Whether the phrase begins at position ``i`` (from 0), where token ``x`` stands."""
        tests = []
        for k, w in enumerate(self.words):
            token = x if k == 0 else F.get(t, i + k)
            tests.append(token.startswith(w) if self.prefix and k == len(self.words) - 1 else token == w)
        if self.initial:
            tests.append(i == 0)
        out = tests[0]
        for test in tests[1:]:
            out = out & test
        return F.coalesce(out, F.lit(False))

    def places(self, t: Column) -> Column:
        """Positions at which the phrase begins."""
        marked = F.transform(t, lambda x, i: F.when(self.at(t, i, x), i))
        return F.array_compact(marked)

    def count(self, t: Column) -> Column:
        if not self.words:
            return F.lit(0)
        return F.size(F.filter(t, lambda x, i: self.at(t, i, x)))


@dataclass(frozen=True)
class Node:
    kind: str
    parts: tuple = ()
    phrases: tuple[Phrase, ...] = ()
    reach: int = NEAR_DEFAULT

    def all_phrases(self, above: tuple[Node, ...] = ()) -> list[tuple[Phrase, tuple[Node, ...]]]:
        """Phrases with the conjunctions that they stand in below the root: where one of these fails, the phrase doesn't count."""
        own = [(p, above) for p in self.phrases]
        return own + [p for part in self.parts for p in part.all_phrases((*above, part) if part.kind in ("and", "not", "near") else above)]

    def matches(self, t: Column) -> Column:
        if self.kind == "phrase":
            return self.phrases[0].count(t) > 0
        if self.kind == "near":
            return _near(self, t)
        a = [p.matches(t) for p in self.parts]
        out = a[0]
        for x in a[1:]:
            out = out & x if self.kind == "and" else out | x if self.kind == "or" else out & ~x
        return out


def _near(node: Node, t: Column) -> Column:
    """Whether there are instances of all phrases with at most ``reach`` tokens between the end of the first and the start of the last."""
    if any(not p.words for p in node.phrases):
        return F.lit(False)
    places = [p.places(t) for p in node.phrases]

    def step(k: int, starts: list[Column]) -> Column:
        if k == len(places):
            if len(starts) == 1:
                return F.lit(True)
            first = F.least(*[s + len(p.words) + F.when(s == F.least(*starts), 0).otherwise(1 << 30) for s, p in zip(starts, node.phrases)])
            return F.greatest(*starts) - first <= node.reach
        return F.exists(places[k], lambda s: step(k + 1, [*starts, s]))

    return step(0, [])


def _within(above: tuple[Node, ...], t: Column) -> Column:
    out = F.lit(True)
    for node in above:
        out = out & node.matches(t)
    return out


_LEX = re.compile(r'\s*(?:(?P<string>"(?:[^"]|"")*")|(?P<op>[()+*:{},^\-])|(?P<word>[A-Za-z0-9_\x1a\x80-\U0010ffff]+))')


def words_of(text: str) -> tuple[str, ...]:
    """Tokens of a bareword or string, as the index has them."""
    import unicodedata

    folded = text.lower().translate(_FOLD)
    return tuple(re.findall(r"(?:(?!_)[^\W])+", "".join(c if unicodedata.category(c)[0] in "LN" or unicodedata.category(c) == "Co" else " " for c in folded)))


@dataclass
class Parser:
    """Grammar: phrases, prefix*, "strings", ^initial, a + b, NEAR(…, n), column filters, AND, OR, NOT, brackets; bare words are joined by AND."""

    text: str
    columns: tuple[str, ...] = ("content",)
    items: list[tuple[str, str]] = field(default_factory=list)
    at: int = 0

    def parse(self) -> Node:
        pos = 0
        while pos < len(self.text):
            m = _LEX.match(self.text, pos)
            if not m or m.end() == pos:
                if self.text[pos:].strip():
                    raise QueryError(f"syntax error near {self.text[pos:]!r}")
                break
            self.items.append((m.lastgroup or "", m.group(m.lastgroup or 0)))
            pos = m.end()
        if not self.items:
            raise QueryError("empty query")
        node = self._or()
        if self.at < len(self.items):
            raise QueryError(f"syntax error near {self.items[self.at][1]!r}")
        return node

    def _peek(self, k: int = 0) -> tuple[str, str]:
        return self.items[self.at + k] if self.at + k < len(self.items) else ("", "")

    def _take(self, value: str) -> None:
        if self._peek()[1] != value:
            raise QueryError(f"expected {value!r}")
        self.at += 1

    def _chain(self, word: str, kind: str, below) -> Node:
        parts = [below()]
        while self._peek() == ("word", word):
            self.at += 1
            parts.append(below())
        return parts[0] if len(parts) == 1 else Node(kind, tuple(parts))

    def _or(self) -> Node:
        return self._chain("OR", "or", self._and)

    def _and(self) -> Node:
        return self._chain("AND", "and", self._not)

    def _not(self) -> Node:
        return self._chain("NOT", "not", self._implicit)

    def _implicit(self) -> Node:
        bracketed = self._peek() == ("op", "(")
        parts = [self._unit()]
        while not bracketed and ((kind := self._peek())[0] in ("word", "string") and kind not in (("word", "OR"), ("word", "AND"), ("word", "NOT")) or kind[1] in ("^", "{")):
            parts.append(self._unit())
        return parts[0] if len(parts) == 1 else Node("and", tuple(parts))

    def _unit(self) -> Node:
        kind, value = self._peek()
        if value == "(" and kind == "op":
            self.at += 1
            node = self._or()
            self._take(")")
            return node
        if kind == "op" and value in ("{", "-") or kind == "word" and self._peek(1) == ("op", ":"):
            self._columns()
            return self._unit()
        if (kind, value) == ("word", "NEAR") and self._peek(1) == ("op", "("):
            return self._near_group()
        return Node("phrase", phrases=(self._phrase(),))

    def _columns(self) -> None:
        if self._peek()[1] == "-":
            raise QueryError("every column is left out")
        names = [self._peek()[1]]
        if names[0] == "{":
            self.at += 1
            names = []
            while self._peek()[0] == "word":
                names.append(self._peek()[1])
                self.at += 1
            self._take("}")
        else:
            self.at += 1
        if not names or any(n.lower() not in self.columns for n in names):
            raise QueryError(f"no such column: {' '.join(names)}")
        self._take(":")

    def _near_group(self) -> Node:
        self.at += 2
        phrases, reach = [], NEAR_DEFAULT
        while self._peek()[0] in ("word", "string"):
            phrases.append(self._phrase())
        if self._peek()[1] == ",":
            self.at += 1
            if not self._peek()[1].isdigit():
                raise QueryError("expected a number in NEAR")
            reach = int(self._peek()[1])
            self.at += 1
        self._take(")")
        if not phrases:
            raise QueryError("empty NEAR")
        return Node("near", phrases=tuple(phrases), reach=reach)

    def _phrase(self) -> Phrase:
        initial = False
        if self._peek() == ("op", "^"):
            initial = True
            self.at += 1
        words: list[str] = []
        while True:
            kind, value = self._peek()
            if kind not in ("word", "string") or (kind, value) in (("word", "OR"), ("word", "AND"), ("word", "NOT")):
                raise QueryError(f"syntax error near {value!r}")
            self.at += 1
            words += words_of(value[1:-1].replace('""', '"') if kind == "string" else value)
            prefix = self._peek() == ("op", "*")
            self.at += prefix
            if self._peek() != ("op", "+") or prefix:
                return Phrase(tuple(words), prefix, initial)
            self.at += 1


def parse(query: str) -> Node:
    return Parser(query).parse()


def search(rows: DataFrame, query: str, limit: int, id_col: str = "chunk_id", text_col: str = "content", strict: bool = False, unique: bool = False) -> DataFrame:
    """The ``limit`` best rows for a keyword query: ``id_col`` and score, least first, ties by id.

    A query against the grammar gives no rows, unless ``strict`` (then
    QueryError). Null texts count as no row of the index. Ids count once; unless
    they are ``unique``, counts (not texts) are shuffled for that.
    """
    try:
        node = parse(query)
    except QueryError:
        if strict:
            raise
        return rows.select(id_col, F.lit(0.0).alias("score")).limit(0)
    t = F.col("_t")
    whole = rows.where(F.col(text_col).isNotNull()).select(id_col, _once(tokens(F.col(text_col))).alias("_t"))
    counted = _counted(whole.withColumn("_dl", F.size(t)), node, id_col)
    if not unique:
        counted = counted.dropDuplicates([id_col])
    totals = counted.agg(F.count(F.lit(1)).alias("_n"), F.avg("_dl").alias("_avg"))
    return _scored(counted, totals, node, id_col, limit)


def _counted(rows: DataFrame, node: Node, id_col: str) -> DataFrame:
    """Hits and counts of all phrases in rows of tokens ``_t`` and length ``_dl``."""
    found, t = node.all_phrases(), F.col("_t")
    out = rows.select(id_col, "_dl", node.matches(t).alias("_hit"), *[p.count(t).alias(f"_f{k}") for k, (p, _) in enumerate(found)], *[_within(above, t).alias(f"_w{k}") for k, (_, above) in enumerate(found)])
    return out.withColumns({f"_e{k}": F.when(F.col(f"_w{k}"), F.col(f"_f{k}")).otherwise(0) for k in range(len(found))})


def _scored(counted: DataFrame, totals: DataFrame, node: Node, id_col: str, limit: int) -> DataFrame:
    """The best hits; ``totals``: one row of the rows of the corpus and their mean length."""
    n = len(node.all_phrases())
    stats = counted.agg(F.count(F.lit(1)).alias("_any"), *[F.count_if(F.col(f"_f{k}") > 0).alias(f"_d{k}") for k in range(n)]).crossJoin(F.broadcast(totals))
    score = F.lit(0.0)
    for k in range(n):
        idf = F.log((F.col("_n") - F.col(f"_d{k}") + 0.5) / (F.col(f"_d{k}") + 0.5))
        idf = F.when(idf <= 0, IDF_FLOOR).otherwise(idf)
        f = F.col(f"_e{k}")
        score = score - idf * (f * (K1 + 1)) / (f + K1 * (1 - B + B * F.col("_dl") / F.col("_avg")))
    hits = counted.where("_hit").crossJoin(F.broadcast(stats)).select(id_col, score.alias("score"))
    return hits.orderBy("score", id_col).limit(limit)


def _once(value: Column) -> Column:
    """``value`` as one generated row: computed once, where a plain column would be put into every expression that reads it."""
    return F.explode(F.array(value))


def bucket(token: Column) -> Column:
    """The bucket of the stored index that a token is in."""
    return F.pmod(F.xxhash64(token), F.lit(BUCKETS)).cast("int")


def indexed(rows: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """The rows of the stored index: bucket, token, chunk_id, length of the chunk in tokens, positions of the token."""
    t = F.col("_t")
    own = rows.where(F.col(text_col).isNotNull()).select(F.col(id_col).cast("long").alias("chunk_id"), tokens(F.col(text_col)).alias("_t"))
    each = own.select("chunk_id", F.size(t).alias("dl"), F.explode(F.array_distinct(t)).alias("token"), "_t")
    return each.select(bucket(F.col("token")).alias("bucket"), "token", "chunk_id", "dl", F.array_compact(F.transform("_t", lambda x, i: F.when(x == F.col("token"), i))).alias("positions"))


def corpus(rows: DataFrame, text_col: str) -> DataFrame:
    """One row of corpus statistics: n rows, n tokens."""
    return rows.where(F.col(text_col).isNotNull()).agg(F.count(F.lit(1)).alias("n"), F.coalesce(F.sum(F.size(tokens(F.col(text_col)))), F.lit(0)).cast("long").alias("tokens"))


def lookup(index: DataFrame, stats: DataFrame, query: str, limit: int, id_col: str = "chunk_id", strict: bool = False) -> DataFrame:
    """``search`` over a stored index: reads the postings of the query's words only.

    ``index``: rows of ``indexed``; ``stats``: columns n and tokens, added up.
    """
    try:
        node = parse(query)
    except QueryError:
        if strict:
            raise
        return index.select(F.col("chunk_id").alias(id_col), F.lit(0.0).alias("score")).limit(0)
    words, starts = set(), set()
    for p, _ in node.all_phrases():
        words |= set(p.words[: len(p.words) - p.prefix])
        starts |= set(p.words[-1:] if p.prefix else ())
    wanted = F.lit(False)
    if words:
        in_bucket = F.col("bucket").isin([r[0] for r in index.sparkSession.createDataFrame([(w,) for w in sorted(words)], "w string").select(bucket(F.col("w"))).collect()])
        wanted = wanted | (in_bucket & F.col("token").isin(sorted(words)))
    for w in sorted(starts):
        wanted = wanted | F.col("token").startswith(w)
    read = index.where(wanted).groupBy("chunk_id").agg(F.first("dl").alias("_dl"), F.collect_list(F.transform("positions", lambda i: F.struct(i.alias("i"), F.col("token").alias("w")))).alias("_at"))
    at = read.select(F.col("chunk_id").alias(id_col), "_dl", _once(F.map_from_entries(F.flatten("_at"))).alias("_m"))
    rows = at.select(id_col, "_dl", _once(F.transform(F.sequence(F.lit(0), F.col("_dl") - 1), lambda i: F.try_element_at(F.col("_m"), i))).alias("_t"))
    totals = stats.agg(F.sum("n").alias("_n"), (F.sum("tokens") / F.sum("n")).alias("_avg"))
    return _scored(_counted(rows, node, id_col), totals, node, id_col, limit)


def postings(rows: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """Token, id, frequency and positions: the keyword index itself."""
    each = rows.where(F.col(text_col).isNotNull()).select(id_col, F.posexplode(tokens(F.col(text_col))).alias("pos", "token"))
    return each.groupBy("token", id_col).agg(F.count(F.lit(1)).alias("tf"), F.sort_array(F.collect_list("pos")).alias("positions"))


def document_frequency(rows: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """Token, number of rows with it, number of occurrences; counts are combined before either shuffle."""
    each = rows.where(F.col(text_col).isNotNull()).select(id_col, F.explode(tokens(F.col(text_col))).alias("token"))
    own = each.groupBy(id_col, "token").agg(F.count(F.lit(1)).alias("_n"))
    return own.groupBy("token").agg(F.count(F.lit(1)).alias("n_rows"), F.sum("_n").cast("long").alias("n_total"))
