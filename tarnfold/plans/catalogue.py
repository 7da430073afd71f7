"""The core queries by name, with the SQL that they are checked against.

All read whole tables. Rows repeated in a table count once. Floating results
are rounded to six places in both engines; limits are features of the query
(top-k, pages) and totally ordered.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tarnfold.config import Config
from tarnfold.errors import classify_error
from tarnfold.functions import paths, text
from tarnfold.functions.exif import gps_column
from tarnfold.operators import catalog, fulltext, hybrid, sync, vector
from tarnfold.sources import scan as source
from tarnfold.sources.embed import embed
from tarnfold.storage import local_path, materialise, scratch
from tarnfold.tables import table

Query = Callable[[SparkSession, str], DataFrame]
_QUERIES: dict[str, Query] = {}
_SQL: dict[str, str] = {}

# Fixed choices of the registered queries.
WORDS, LIMIT = "naïve pictures", 10
PREFIX = "/srv/vault/b"


def query(sql: str | None = None):
    """Registers a query under its function's name."""

    def add(f: Query) -> Query:
        _QUERIES[f.__name__] = f
        if sql is not None:
            _SQL[f.__name__] = sql
        return f

    return add


def queries() -> dict[str, Query]:
    return dict(_QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(_SQL)


def _t(spark: SparkSession, d: str, name: str) -> DataFrame:
    """A table without repeated rows, by its id where it has one."""
    df = table(spark, d, name)
    return df.dropDuplicates(["id"] if "id" in df.columns else ["chunk_id"] if "chunk_id" in df.columns else df.columns)


def _vectors(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "chunks_vec").where(F.size("embedding") == 384)


# SQL parts

_F = "f AS (SELECT DISTINCT * FROM files)"
_C = "c AS (SELECT DISTINCT * FROM chunks)"
_E = "e AS (SELECT DISTINCT * FROM index_errors)"
_R = "r AS (SELECT DISTINCT * FROM index_runs)"
_V = "v AS (SELECT DISTINCT ON (chunk_id) chunk_id, embedding FROM chunks_vec WHERE len(embedding) = 384)"
_SUFFIX = r"lower(regexp_extract(regexp_extract(path, '[^/]*$'), '^.+(\.[^.]+)$', 1))"
_TYPE = f"""CASE WHEN {_SUFFIX} = '.pdf' THEN 'pdf' WHEN {_SUFFIX} = '.docx' THEN 'docx' WHEN {_SUFFIX} IN ('.md', '.markdown') THEN 'markdown'
WHEN {_SUFFIX} IN ('.txt', '.rst', '.csv', '.tsv', '.json', '.yaml', '.yml', '.toml', '.ini', '.cfg', '.py', '.js', '.ts', '.go', '.rs', '.java', '.c', '.cpp', '.h', '.sh', '.bash', '.zsh', '.fish', '.html', '.htm', '.xml', '.svg', '.sql', '.r', '.rb', '.pl', '.lua', '.tex', '.bib', '.org', '.log', '.conf', '.env') THEN 'text'
WHEN {_SUFFIX} IN ('.jpg', '.jpeg', '.png', '.gif', '.heic', '.heif', '.webp', '.bmp', '.tiff', '.tif') THEN 'image' WHEN {_SUFFIX} IN ('.mp4', '.mov', '.avi', '.webm', '.mkv') THEN 'video' END"""
_SPACE = r"[^\t-\r \x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}\x1c-\x1f]"
_WINDOWS = f"""w AS (SELECT doc_id, i, substring(text, i * 800 + 1, 1000) AS content FROM (SELECT doc_id, text, unnest(range(0, 1 + greatest(0, ceil((length(text) - 1000) / 800.0)::BIGINT))) AS i FROM documents WHERE text IS NOT NULL)),
p AS (SELECT doc_id, (row_number() OVER (PARTITION BY doc_id ORDER BY i) - 1)::INT AS chunk_index, content FROM w WHERE regexp_matches(content, '{_SPACE}'))"""
# Letters with accents of the languages in the tables, their bases, and the combining marks; written out apart from the engine's rule.
_LETTERS = "àáâãäåāăąçćčďèéêëēěęìíîïīñńňòóôõöőùúûüūůűýÿřśşšťźżžğțșµς", "aaaaaaaaacccdeeeeeeeiiiiinnnoooooouuuuuuuyyrssstzzzgtsμσ"
_MARKED = "".join(map(chr, (0x300, 0x301, 0x302, 0x303, 0x304, 0x306, 0x307, 0x308, 0x30A, 0x30B, 0x30C, 0x323, 0x327, 0x328)))
_TOKENS = f"regexp_extract_all(translate(lower(content), '{_LETTERS[0]}{_MARKED}', '{_LETTERS[1]}'), '[\\p{{L}}\\p{{N}}\\p{{Co}}]+')"


def _bm25(phrases: list[str], hit: str, more: str = "") -> str:
    """SQL of a keyword search: ``phrases`` are counts over the token list t, ``hit`` a test over f0, f1 …"""
    f = ", ".join(f"({p}) AS f{k}" for k, p in enumerate(phrases))
    d = ", ".join(f"count(*) FILTER (f{k} > 0) AS d{k}" for k in range(len(phrases)))
    s = " + ".join(f"(CASE WHEN ln((n - d{k} + 0.5) / (d{k} + 0.5)) <= 0 THEN 1e-6 ELSE ln((n - d{k} + 0.5) / (d{k} + 0.5)) END) * (f{k} * 2.2) / (f{k} + 1.2 * (0.25 + 0.75 * dl / av))" for k in range(len(phrases)))
    return f"""{_C}, t AS (SELECT id AS chunk_id, {_TOKENS} AS t FROM c WHERE content IS NOT NULL), k AS (SELECT chunk_id, len(t) AS dl, t, {f} FROM t),
s AS (SELECT count(*) AS n, avg(dl) AS av, {d} FROM k), b AS (SELECT chunk_id, -({s}) AS score FROM k, s WHERE {hit} ORDER BY score, chunk_id LIMIT {LIMIT}){more}"""


def _one(word: str) -> str:
    return f"len(list_filter(t, lambda x: x = '{word}'))"


_RESULT = "SELECT chunk_id, round(score, 6) AS score FROM b"


def _rounded(df: DataFrame, *columns: str) -> DataFrame:
    return df.withColumns({c: F.round(c, 6) for c in columns})


_INDEX: dict[tuple[str, str], tuple[DataFrame, DataFrame]] = {}


def keyword_index(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    """Postings and statistics of all chunks, written once per session and directory, by bucket and sorted by token."""
    key = (spark.sparkContext.applicationId, d)
    if key not in _INDEX:
        rows = _t(spark, d, "chunks").select("id", "content")
        postings = materialise(fulltext.indexed(rows, "id", "content").repartition("bucket").sortWithinPartitions("bucket", "token"), "postings", by="bucket")
        _INDEX[key] = postings, materialise(fulltext.corpus(rows, "content"), "corpus")
    return _INDEX[key]


def _keyword(spark: SparkSession, d: str, words: str) -> DataFrame:
    return _rounded(fulltext.lookup(*keyword_index(spark, d), words, LIMIT), "score")


# Text and files


@query(f"WITH {_F} SELECT path, {_SUFFIX} AS suffix, {_TYPE} AS detected, regexp_extract(path, '[^/]*$') AS name, regexp_matches(regexp_extract(path, '[^/]*$'), '^(?:.*\\.iso|.*\\.zip|.*\\.log)$') AS excluded FROM f")
def file_catalog(spark, d):
    """Names, suffixes, detected types and an exclusion test of all files."""
    p = F.col("path")
    return _t(spark, d, "files").select("path", paths.suffix(p).alias("suffix"), paths.file_type(p).alias("detected"), paths.base_name(p).alias("name"), paths.base_name(p).rlike(paths.glob_regex(["*.iso", "*.zip", "*.log"])).alias("excluded"))


def _documents(spark, d) -> DataFrame:
    return table(spark, d, "documents").where("text is not null").select("doc_id", F.posexplode(text.windows(F.col("text"))).alias("chunk_index", "content"))


@query(f"WITH {_WINDOWS} SELECT * FROM p")
def chunk_documents(spark, d):
    """All documents in overlapping windows of 1,000 characters."""
    return _documents(spark, d)


@query(f"WITH {_WINDOWS} SELECT count(*) AS n_chunks, count(DISTINCT doc_id) AS n_docs, sum(length(content))::BIGINT AS n_chars, max(chunk_index)::INT AS last_index FROM p")
def chunk_stats(spark, d):
    """Counts over the windows of all documents."""
    return _documents(spark, d).agg(F.count(F.lit(1)).alias("n_chunks"), F.countDistinct("doc_id").alias("n_docs"), F.sum(F.char_length("content")).alias("n_chars"), F.max("chunk_index").alias("last_index"))


@query(f"SELECT doc_id, text IS NULL OR NOT regexp_matches(text, '{_SPACE}') AS blank FROM documents")
def chunk_blank_dropped(spark, d):
    """Which documents are blank and so give no chunk."""
    return table(spark, d, "documents").select("doc_id", F.coalesce(text.is_blank(F.col("text")), F.lit(True)).alias("blank"))


@query("SELECT doc_id, sha256(text) AS checksum, strlen(text) AS n_bytes FROM documents WHERE text IS NOT NULL")
def checksum_documents(spark, d):
    """SHA-256 and byte length of all texts."""
    return table(spark, d, "documents").where("text is not null").select("doc_id", F.sha2("text", 256).alias("checksum"), F.octet_length("text").cast("long").alias("n_bytes"))


# Vectors


def _query_vector(spark, d) -> DataFrame:
    return table(spark, d, "embeddings").where("vec_id = 0").select(F.col("embedding").cast("array<double>").alias("query"))


_KNN = "q AS (SELECT embedding::DOUBLE[] AS q FROM embeddings WHERE vec_id = 0), k AS (SELECT vec_id, list_distance(embedding::DOUBLE[], q) AS distance FROM embeddings, q ORDER BY distance, vec_id LIMIT 30)"


@query(f"WITH {_KNN} SELECT vec_id, round(distance, 6) AS distance FROM k")
def knn_topk(spark, d):
    """The thirty vectors nearest to one, exactly."""
    return _rounded(vector.knn(table(spark, d, "embeddings"), _query_vector(spark, d), 30, "vec_id"), "distance")


@query("SELECT query_id, vec_id, round(distance, 6) AS distance FROM (SELECT a.vec_id AS query_id, b.vec_id, list_distance(a.embedding::DOUBLE[], b.embedding::DOUBLE[]) AS distance FROM embeddings a, embeddings b WHERE a.vec_id % 50 = 0) QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY distance, vec_id) <= 30")
def knn_every_50th(spark, d):
    """The thirty vectors nearest to each whose id is divisible by 50, exactly."""
    rows = table(spark, d, "embeddings")
    return _rounded(vector.knn_join(rows, rows.where("vec_id % 50 = 0"), 30, "vec_id"), "distance")


_QV = f"{_V}, q AS (SELECT embedding::DOUBLE[] AS q FROM v ORDER BY chunk_id LIMIT 1), k AS (SELECT chunk_id, list_distance(embedding::DOUBLE[], q) AS distance FROM v, q WHERE NOT list_contains(list_transform(embedding, lambda x: isnan(x)), true) ORDER BY distance, chunk_id LIMIT 30)"
_DESCRIBED = "g AS (SELECT k.chunk_id, k.distance, c.content, c.metadata, c.chunk_index, f.path, f.file_type FROM k JOIN c ON c.id = k.chunk_id JOIN f ON f.id = c.file_id)"


def _first_vector(spark, d) -> DataFrame:
    return _vectors(spark, d).orderBy("chunk_id").limit(1).select(F.col("embedding").cast("array<double>").alias("query"))


@query(f"WITH {_F}, {_C}, {_QV}, {_DESCRIBED} SELECT chunk_id, round(distance, 6) AS distance, content, metadata, chunk_index, path, file_type FROM g")
def knn_join_chunks_files(spark, d):
    """The thirty chunks nearest to the first one's vector, with their files."""
    near = vector.described(vector.knn(_vectors(spark, d), _first_vector(spark, d), 30), table(spark, d, "chunks"), _t(spark, d, "files"))
    return _rounded(near, "distance")


@query(f"WITH {_F}, {_C}, {_QV}, {_DESCRIBED} SELECT chunk_id, round(distance, 6) AS distance, path FROM g WHERE lower(path) LIKE '/srv/%'")
def knn_path_postfilter(spark, d):
    """The same with a path prefix applied to the thirty, so that fewer are left."""
    near = hybrid.vector_hits(_vectors(spark, d), table(spark, d, "chunks"), _t(spark, d, "files"), _first_vector(spark, d), LIMIT, "/srv/")
    return _rounded(near.select("chunk_id", "distance", "path"), "distance")


_CENTROID = "m AS (SELECT label, i, avg(x::DOUBLE) AS m FROM (SELECT label, unnest(embedding) AS x, unnest(range(len(embedding))) AS i FROM embeddings) GROUP BY label, i)"


@query(f"WITH {_CENTROID} SELECT label, i::INT AS i, round(m, 6) AS m FROM m")
def file_centroid(spark, d):
    """Mean vectors of the labels, by position."""
    return _rounded(vector.centroid(table(spark, d, "embeddings"), "label").select("label", F.posexplode("centroid").alias("i", "m")), "m")


_OWN = f"{_F}, {_C}, {_V}, own AS (SELECT min(path) AS path FROM f), x AS (SELECT v.embedding FROM v JOIN c ON c.id = v.chunk_id JOIN f ON f.id = c.file_id WHERE f.path = (SELECT path FROM own)), a AS (SELECT i, avg(e::DOUBLE) AS m FROM (SELECT unnest(embedding) AS e, unnest(range(len(embedding))) AS i FROM x) GROUP BY i), q AS (SELECT list(m ORDER BY i) AS q FROM a), k AS (SELECT chunk_id, list_distance(embedding::DOUBLE[], q) AS distance FROM v, q WHERE NOT list_contains(list_transform(embedding, lambda x: isnan(x)), true) ORDER BY distance, chunk_id LIMIT 60)"


@query(f"WITH {_OWN}, {_DESCRIBED}, b AS (SELECT *, row_number() OVER (PARTITION BY path ORDER BY distance, chunk_id) AS rn FROM g WHERE path <> (SELECT path FROM own)) SELECT path, file_type, round(distance, 6) AS distance, substring(content, 1, 200) AS sample_content FROM b WHERE rn = 1 ORDER BY b.distance, b.chunk_id LIMIT {LIMIT}")
def similar_files(spark, d):
    """The ten files most like the first by path."""
    files = _t(spark, d, "files")
    own = files.agg(F.min("path")).head()[0] or ""
    return _rounded(hybrid.similar(_vectors(spark, d), table(spark, d, "chunks"), files, own, LIMIT), "distance")


# Keywords


@query(f"WITH {_C}, t AS (SELECT id, unnest({_TOKENS}) AS token FROM c WHERE content IS NOT NULL) SELECT token, count(DISTINCT id) AS n_rows, count(*) AS n_total FROM t GROUP BY token")
def token_df(spark, d):
    """Rows and occurrences of every token."""
    return fulltext.document_frequency(_t(spark, d, "chunks"), "id", "content")


@query(f"WITH {_C}, t AS (SELECT id, unnest(t) AS token, unnest(range(len(t))) AS pos FROM (SELECT id, {_TOKENS} AS t FROM c WHERE content IS NOT NULL)) SELECT token, id AS chunk_id, count(*) AS tf, min(pos)::INT AS first_pos, max(pos)::INT AS last_pos FROM t GROUP BY token, id")
def token_postings(spark, d):
    """The keyword index: frequency and places of each token in each chunk."""
    out = fulltext.postings(_t(spark, d, "chunks").withColumnRenamed("id", "chunk_id"), "chunk_id", "content")
    return out.select("token", "chunk_id", "tf", F.element_at("positions", 1).alias("first_pos"), F.element_at("positions", -1).alias("last_pos"))


@query(f"WITH {_bm25([_one('naive'), _one('pictures')], 'f0 > 0 AND f1 > 0')} {_RESULT}")
def bm25_search(spark, d):
    """The ten best chunks for two words."""
    return _keyword(spark, d, WORDS)


@query(f"WITH {_bm25([_one('naive'), _one('pictures')], 'f0 > 0 AND f1 > 0')} {_RESULT}")
def bm25_over_texts(spark, d):
    """The same without a stored index: all texts are tokenised."""
    rows = table(spark, d, "chunks").select(F.col("id").alias("chunk_id"), "content")
    return _rounded(fulltext.search(rows, WORDS, LIMIT), "score")


_PAIR = "len(list_filter(range(len(t)), lambda i: t[i + 1] = 'spare' AND t[i + 2] = 'parts'))"


@query(f"WITH {_bm25([_PAIR], 'f0 > 0')} {_RESULT}")
def fts_phrase(spark, d):
    """The ten best chunks for a phrase."""
    return _keyword(spark, d, '"spare parts"')


@query(f"WITH {_bm25(['len(list_filter(t, lambda x: starts_with(x, ' + repr('pict') + ')))'], 'f0 > 0')} {_RESULT}")
def fts_prefix(spark, d):
    """The ten best chunks for a prefix."""
    return _keyword(spark, d, "pict*")


@query(f"WITH {_bm25([_one('naive'), _one('harbour')], 'f0 > 0 OR f1 > 0')} {_RESULT}")
def fts_or(spark, d):
    """The ten best chunks for either of two words."""
    return _keyword(spark, d, "naïve OR harbour")


@query(f"WITH {_bm25([_one('harbour'), _one('naive')], 'f0 > 0 AND NOT f1 > 0')} {_RESULT}")
def fts_not(spark, d):
    """The ten best chunks with one word and without another."""
    return _keyword(spark, d, "harbour NOT naïve")


_NEAR = "len(list_filter(range(len(t)), lambda i: t[i + 1] = 'upper' AND len(list_filter(range(len(t)), lambda j: t[j + 1] = 'shelf' AND i <> j AND abs(i - j) - 1 <= 2)) > 0)) > 0"


@query(f"WITH {_bm25([_one('upper'), _one('shelf')], _NEAR)} {_RESULT}")
def fts_near(spark, d):
    """The ten best chunks with two words at most two words apart."""
    return _keyword(spark, d, "NEAR(upper shelf, 2)")


@query(f"WITH {_bm25([_one('naive'), _one('pictures')], 'false')} {_RESULT}")
def fts_syntax_error(spark, d):
    """A query against the grammar finds nothing."""
    return _keyword(spark, d, "naïve AND (pictures")


_MERGE = """, fk AS (SELECT b.chunk_id, b.score, c.content, c.metadata, c.chunk_index, f.path, f.file_type FROM b JOIN c ON c.id = b.chunk_id JOIN f ON f.id = c.file_id),
u AS (SELECT 0 AS branch, distance AS o, chunk_id, content, chunk_index, path, file_type, 'vector' AS source, distance AS vector_distance, NULL::DOUBLE AS fts_score FROM g {where} UNION ALL SELECT 1, score, chunk_id, content, chunk_index, path, file_type, 'fts', NULL, score FROM fk WHERE chunk_id NOT IN (SELECT chunk_id FROM g {where}))
SELECT chunk_id, content, chunk_index, path, file_type, source, round(vector_distance, 6) AS vector_distance, round(fts_score, 6) AS fts_score FROM u ORDER BY branch, o, chunk_id LIMIT 10"""
_BOTH = f"WITH {_F}, {_bm25([_one('naive'), _one('pictures')], 'f0 > 0 AND f1 > 0')}, {_QV.replace(' k AS', ' kk AS')}, k2 AS (SELECT * FROM kk), " + _DESCRIBED.replace("FROM k ", "FROM k2 k ")


def _hybrid(spark, d, path: str | None) -> DataFrame:
    found = hybrid.search(_vectors(spark, d), table(spark, d, "chunks"), _t(spark, d, "files"), WORDS, _first_vector(spark, d), LIMIT, path, index=keyword_index(spark, d))
    return _rounded(found.drop("metadata"), "vector_distance", "fts_score")


@query(_BOTH + _MERGE.format(where=""))
def hybrid_search(spark, d):
    """Vector rows first, keyword rows behind them, ten in all."""
    return _hybrid(spark, d, None)


@query(_BOTH + _MERGE.format(where="WHERE lower(path) LIKE '/backup/%'"))
def hybrid_keyword_fallback(spark, d):
    """With few vector rows in scope the keyword rows come up, from anywhere."""
    return _hybrid(spark, d, "/backup/")


# Prefixes and deletion


@query(f"WITH {_F} SELECT id, path FROM f WHERE lower(path) LIKE '{PREFIX}%'")
def prefix_filter_sibling(spark, d):
    """A prefix lets sibling folders through, whatever the case."""
    return _t(spark, d, "files").where(paths.has_prefix(F.col("path"), PREFIX)).select("id", "path")


@query(f"WITH {_F} SELECT id, path FROM f WHERE lower(path) LIKE '/srv/vault/baker/%'")
def prefix_delete_boundary(spark, d):
    """What removing a directory removes: only what lies below it."""
    return sync.under(_t(spark, d, "files"), "/srv/vault/baker", True).select("id", "path")


@query(f"WITH {_F}, {_C}, {_V}, g AS (SELECT id FROM f WHERE id % 7 = 0), kc AS (SELECT * FROM c WHERE file_id IS NULL OR file_id NOT IN (SELECT id FROM g)), dead AS (SELECT id FROM c WHERE file_id IN (SELECT id FROM g)) SELECT (SELECT count(*) FROM f WHERE id % 7 <> 0) AS n_files, (SELECT count(*) FROM kc) AS n_chunks, (SELECT sum(id)::BIGINT FROM kc) AS chunk_ids, (SELECT count(*) FROM v WHERE chunk_id NOT IN (SELECT id FROM dead)) AS n_vectors")
def delete_cascade(spark, d):
    """What is left of files, chunks and vectors once every seventh file is deleted."""
    files = _t(spark, d, "files")
    f, c, v = sync.delete_files(files.where("id % 7 = 0").select(F.col("id").alias("file_id")), files, table(spark, d, "chunks").select("id", "file_id").dropDuplicates(["id"]), _vectors(spark, d).select("chunk_id").distinct())
    n = lambda df, name: df.agg(F.count(F.lit(1)).alias(name))
    return n(f, "n_files").crossJoin(c.agg(F.count(F.lit(1)).alias("n_chunks"), F.sum("id").alias("chunk_ids"))).crossJoin(n(v, "n_vectors"))


# Reports


@query(f"WITH {_F}, {_R} SELECT count(*) AS total_files, coalesce(sum(file_size), 0)::BIGINT AS total_size, coalesce(sum(chunk_count), 0)::BIGINT AS total_chunks, max(indexed_at) AS last_indexed, (SELECT max(id) FROM r) AS last_run_id, (SELECT count(DISTINCT file_type) FROM f) AS n_types FROM f")
def index_status(spark, d):
    """Totals of the index and its last run, one row."""
    s = catalog.status(_t(spark, d, "files"), _t(spark, d, "index_runs"))
    return s.select("total_files", "total_size", "total_chunks", "last_indexed", F.col("last_run.id").alias("last_run_id"), F.size("by_type").cast("long").alias("n_types"))


@query(f"WITH {_F} SELECT file_type, count(*) AS n FROM f GROUP BY file_type")
def files_by_type(spark, d):
    """Files of each type."""
    return catalog.by_type(_t(spark, d, "files"))


@query(f"WITH {_F} SELECT max(indexed_at) AS last_indexed FROM f")
def last_indexed(spark, d):
    """When a file was last indexed."""
    return _t(spark, d, "files").agg(F.max("indexed_at").alias("last_indexed"))


@query(f"WITH {_R} SELECT * FROM r ORDER BY id DESC LIMIT 1")
def last_run(spark, d):
    """The run with the greatest id."""
    return catalog.last_run(_t(spark, d, "index_runs"))


@query(f"WITH {_F} SELECT id, path, file_type, file_size, chunk_count, indexed_at FROM f WHERE lower(path) LIKE '/srv/%' ORDER BY indexed_at DESC NULLS LAST, path, id LIMIT 50 OFFSET 20")
def list_files_page(spark, d):
    """The second page of files below a prefix, latest first."""
    return catalog.list_files(_t(spark, d, "files"), "/srv/", 50, 20)


@query(f"WITH {_F}, {_C} SELECT c.id AS chunk_id, chunk_index, content, metadata FROM c WHERE file_id = (SELECT id FROM f WHERE path = (SELECT min(path) FROM f)) ORDER BY chunk_index, c.id LIMIT 50")
def get_chunks(spark, d):
    """The chunks of the first file by path."""
    files = _t(spark, d, "files")
    path = files.agg(F.min("path")).head()[0] or ""
    own = table(spark, d, "chunks").join(F.broadcast(files.where(F.col("path") == path).select(F.col("id").alias("file_id"))), "file_id", "left_semi")
    return catalog.get_chunks(own.dropDuplicates(["id"]), files, path)


@query(f"WITH {_R} SELECT * FROM r ORDER BY id DESC LIMIT 20")
def run_log(spark, d):
    """The twenty latest runs."""
    return catalog.log(_t(spark, d, "index_runs"))


@query(f"WITH {_R} SELECT lower(status) AS status, count(*) AS n, sum(files_found)::BIGINT AS found, sum(files_indexed)::BIGINT AS indexed, sum(files_skipped)::BIGINT AS skipped, sum(files_errored)::BIGINT AS errored, sum(total_chunks)::BIGINT AS chunks FROM r GROUP BY 1")
def run_totals(spark, d):
    """Counters of the runs by state."""
    s = lambda c, n: F.sum(c).alias(n)
    return _t(spark, d, "index_runs").groupBy(F.lower("status").alias("status")).agg(F.count(F.lit(1)).alias("n"), s("files_found", "found"), s("files_indexed", "indexed"), s("files_skipped", "skipped"), s("files_errored", "errored"), s("total_chunks", "chunks"))


_CLASS = "CASE WHEN regexp_matches(lower(error_message), 'connection reset|dns|503|timeout|temporary failure|name resolution|broken pipe|connection refused|network unreachable') THEN 'transient' ELSE 'permanent' END"


@query(f"WITH {_E} SELECT id, error_message, {_CLASS} AS class FROM e")
def error_classify(spark, d):
    """Every error by whether it may pass."""
    return _t(spark, d, "index_errors").select("id", "error_message", classify_error(F.col("error_message")).alias("class"))


_LATEST = f"{_E}, l AS (SELECT * FROM e WHERE lower(path) LIKE '/%' ORDER BY created_at DESC NULLS LAST, id DESC LIMIT 10000)"


@query(f"WITH {_LATEST} SELECT count(*) AS total, count(*) FILTER (resolved = 1) AS resolved, count(*) - count(*) FILTER (resolved = 1) AS unresolved FROM l")
def error_quality_summary(spark, d):
    """How many of the latest errors are resolved."""
    return catalog.quality(_t(spark, d, "index_errors"), "/")


@query(f"WITH {_LATEST} SELECT error_type, count(*) AS n FROM l GROUP BY error_type")
def error_quality_by_type(spark, d):
    """The latest errors by type."""
    return catalog.quality_by_type(_t(spark, d, "index_errors"), "/")


@query(f"WITH {_E} SELECT * FROM e WHERE resolved = 0 ORDER BY created_at DESC NULLS LAST, id DESC LIMIT 100")
def errors_unresolved(spark, d):
    """The hundred latest open errors."""
    return catalog.errors(_t(spark, d, "index_errors"))


@query(f"WITH {_E}, {_F} SELECT e.id, CASE WHEN s.path IS NOT NULL AND resolved = 0 THEN 1 ELSE resolved END AS resolved, CASE WHEN s.path IS NOT NULL AND resolved = 0 THEN TIMESTAMP '2026-01-01 00:00:00' ELSE resolved_at END AS resolved_at FROM e LEFT JOIN (SELECT DISTINCT path FROM f WHERE chunk_count > 0) s ON s.path = e.path")
def error_resolve(spark, d):
    """The error log once all files with chunks are stored again."""
    stored = _t(spark, d, "files").where("chunk_count > 0")
    return sync.resolve(_t(spark, d, "index_errors"), stored, "2026-01-01 00:00:00").select("id", "resolved", "resolved_at")


# Synchronisation


@query(
    f"""WITH {_F}, s AS (SELECT path, CASE WHEN id % 5 = 0 THEN file_size + 1 ELSE file_size END AS file_size, CASE WHEN id % 3 = 0 THEN 1.0 ELSE mtime END AS mtime, CASE WHEN id % 15 = 0 THEN 'x' ELSE checksum END AS checksum FROM f WHERE id % 11 <> 0 UNION ALL SELECT path || '.new', 1, 1.0, 'n' FROM f WHERE id % 13 = 0)
SELECT coalesce(s.path, f.path) AS path, f.id AS file_id, CASE WHEN s.path IS NULL THEN 'missing' WHEN f.path IS NULL THEN 'new' WHEN f.mtime IS NOT NULL AND s.mtime = f.mtime AND s.file_size = f.file_size THEN 'unchanged' WHEN s.checksum IS DISTINCT FROM f.checksum THEN 'changed' WHEN f.mtime IS NULL THEN 'backfill' ELSE 'unchanged' END AS action FROM s FULL JOIN f ON s.path = f.path"""
)
def sync_plan(spark, d):
    """New, changed, unchanged and missing files of a later scan."""
    files = _t(spark, d, "files")
    later = files.where("id % 11 <> 0").select("path", F.expr("if(id % 5 = 0, file_size + 1, file_size)").alias("file_size"), F.expr("if(id % 3 = 0, 1.0D, mtime)").alias("mtime"), F.expr("if(id % 15 = 0, 'x', checksum)").alias("checksum"))
    new = files.where("id % 13 = 0").select(F.concat("path", F.lit(".new")).alias("path"), F.lit(1).cast("long").alias("file_size"), F.lit(1.0).alias("mtime"), F.lit("n").alias("checksum"))
    return sync.plan(later.union(new), files).select("path", "file_id", "action")


@query(f"WITH {_C}, {_V}, q AS (SELECT embedding::DOUBLE[] AS q FROM v ORDER BY chunk_id LIMIT 1), h AS (SELECT c.file_id, v.chunk_id, list_distance(embedding::DOUBLE[], q) AS distance FROM v JOIN c ON c.id = v.chunk_id, q WHERE NOT list_contains(list_transform(embedding, lambda x: isnan(x)), true)), b AS (SELECT *, row_number() OVER (PARTITION BY file_id ORDER BY distance, chunk_id) AS rn FROM h) SELECT file_id, chunk_id, round(distance, 6) AS distance FROM b WHERE rn = 1")
def dedup_first_by_rank(spark, d):
    """The nearest chunk of every file."""
    far = _vectors(spark, d).crossJoin(F.broadcast(_first_vector(spark, d))).select("chunk_id", vector.l2(F.col("embedding"), F.col("query")).alias("distance")).where(~F.isnan("distance"))
    hits = far.join(table(spark, d, "chunks").select(F.col("id").alias("chunk_id"), "file_id").distinct(), "chunk_id")
    return _rounded(vector.best_per_group(hits, "file_id", ["distance", "chunk_id"]).select("file_id", "chunk_id", "distance"), "distance")


@query(f"WITH {_C} SELECT id, CASE WHEN json_valid(metadata) THEN metadata::JSON->>'lang' END AS lang, CASE WHEN json_valid(metadata) THEN (metadata::JSON->>'page')::INT END AS page FROM c WHERE metadata IS NOT NULL")
def metadata_json(spark, d):
    """Language and page from the metadata of chunks, null where it is no valid JSON."""
    m = F.from_json("metadata", "lang string, page int")
    return table(spark, d, "chunks").where("metadata is not null").select("id", m["lang"].alias("lang"), m["page"].alias("page")).dropDuplicates(["id"])


@query(f"WITH {_E}, x AS (SELECT id, path, CASE WHEN resolved = 0 THEN 'error' ELSE 'indexed' END AS status FROM e) SELECT * FROM x WHERE (SELECT count(*) FROM x) <= 200 OR status = 'error'")
def details_cap(spark, d):
    """Result rows: all of few, of many the errors only."""
    return catalog.details(_t(spark, d, "index_errors").select("id", "path", F.when(F.col("resolved") == 0, "error").otherwise("indexed").alias("status")))


@query(f"WITH {_E} SELECT count(*) FILTER (resolved = 1) AS files_indexed, 0::BIGINT AS files_skipped, count(*) FILTER (resolved = 0) AS files_errored, 0::BIGINT AS files_removed, sum(length(path))::BIGINT AS total_chunks FROM e")
def result_summary(spark, d):
    """Counters over result rows."""
    return catalog.summary(_t(spark, d, "index_errors").select(F.when(F.col("resolved") == 0, "error").otherwise("indexed").alias("status"), F.length("path").alias("chunk_count")))


@query("SELECT event_id, printf('GPS: %.4f°N, %.4f°E', (10 + user_id % 50 + 30 / 60.0 + 15 / 3600.0) * (CASE WHEN user_id % 2 = 0 THEN -1 ELSE 1 END), (20 + user_id % 90 + 45 / 60.0 + 36 / 3600.0) * 1.0) AS gps FROM events")
def exif_gps(spark, d):
    """Coordinates in degrees, minutes and seconds as a caption has them."""
    lat = F.array((F.lit(10) + F.col("user_id") % 50).cast("double"), F.lit(30.0), F.lit(15.0))
    lon = F.array((F.lit(20) + F.col("user_id") % 90).cast("double"), F.lit(45.0), F.lit(36.0))
    return table(spark, d, "events").select("event_id", gps_column(lat, F.when(F.col("user_id") % 2 == 0, "S").otherwise("N"), lon, F.lit("E")).alias("gps"))


# A small tree of files, those that a scan leaves out among them.
TREE = {
    "notes/one.txt": "First note\nwith two lines", "notes/two.md": "# Zwei\n\nGrüße aus Köln", "notes/.hidden.txt": "hidden", "notes/empty.txt": "", "notes/paper.tex": "\\section{A}", "notes/page.css": "b { }",
    "notes/.git/config.ini": "[core]", "src/tool.py": "print('naïve')", "src/run.fish": "echo 1", "src/a b%_.sql": "SELECT 1", "src/image.iso": "x", "src/photo.jpg": "x", "src/README": "no suffix",
}
_SEEN = ["notes/one.txt", "notes/two.md", "notes/empty.txt", "notes/paper.tex", "src/tool.py", "src/run.fish", "src/a b%_.sql"]
_BODIES = "(VALUES " + ", ".join(f"('{name.split('/')[1]}', '{TREE[name].replace(chr(39), chr(39) * 2)}')" for name in _SEEN) + ") AS t(name, body)"


def _tree(spark: SparkSession) -> str:
    """The folder of the fixed tree, written anew in the shared folder."""
    root = scratch(spark, "tree")
    jvm = spark._jvm
    for name, body in TREE.items():
        at = jvm.org.apache.hadoop.fs.Path(f"{root}/{name}")
        out = at.getFileSystem(spark._jsc.hadoopConfiguration()).create(at, True)
        out.write(bytearray(body.encode()))
        out.close()
    return local_path(root) or root


@query(f"SELECT name, strlen(body)::BIGINT AS file_size FROM {_BODIES}")
def scan_fs(spark, d):
    """The scan of a small tree of files."""
    root = _tree(spark)
    return source.scan(source.listing(spark, root), Config(), root).select(paths.base_name(F.col("path")).alias("name"), "file_size")


@query(f"SELECT name, length(body)::INT AS n_chars, sha256(body) AS checksum, body AS text FROM {_BODIES}")
def extract_fs(spark, d):
    """Text and checksum of every file of that tree."""
    root = _tree(spark)
    found = source.scan(source.listing(spark, root), Config(), root)
    texts = source.extract(found.select("path"), Config()).join(source.checksums(found.select("path")), "path")
    return texts.where("error is null").select(paths.base_name(F.col("path")).alias("name"), F.char_length("text").alias("n_chars"), "checksum", "text")


@query()
def embed_hash(spark, d):
    """Vectors of all chunks by the deterministic embedder."""
    return embed(_t(spark, d, "chunks"), "id", "content")
