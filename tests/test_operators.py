import random
import sqlite3

import pytest
from pyspark.sql import functions as F

from tarnfold.operators import catalog, fulltext, hybrid, sync, vector
from tarnfold.schema import empty

WORDS = "alpha beta gamma delta epsilon café über zeta_eta x1 it's gęś žluťoučky kůň Şeker İstanbul ête\u0301 ŁÓDŹ Ελλάς ﬁn".split()


@pytest.fixture(scope="module")
def corpus(spark):
    r = random.Random(5)
    rows = [(i, " ".join(r.choice(WORDS) for _ in range(r.randint(0, 30)))) for i in range(1, 200)]
    db = sqlite3.connect(":memory:")
    db.execute("CREATE VIRTUAL TABLE t USING fts5(content)")
    db.executemany("INSERT INTO t(rowid, content) VALUES (?, ?)", rows)
    return spark.createDataFrame(rows, "chunk_id long, content string").cache(), db


QUERIES = ["alpha beta", "alpha OR delta", "alpha NOT beta", '"alpha beta"', "gam*", "cafe uber", "zeta_eta", "content:alpha", "(alpha OR beta) gamma", "alpha AND (beta NOT gamma)", "^alpha", "alpha + beta", "alpha beta OR gamma", '"alpha be" *', "NEAR(alpha beta, 1)", "what is?", "it's", "C++", "a/b", "foo-bar", "", "nope:x", "alpha AND", "(alpha", '"open']


@pytest.fixture(scope="module")
def stored(spark, corpus):
    return fulltext.indexed(corpus[0], "chunk_id", "content").cache(), fulltext.corpus(corpus[0], "content").cache()


@pytest.mark.parametrize("q", QUERIES + ["ges", "zlutoucky OR kun", "seker istanbul", "ete", "łodz", "ελλασ", "alp* NOT gam*"])
@pytest.mark.parametrize("over", ["texts", "index"])
def test_keyword_search_equals_fts5(corpus, stored, q, over):
    df, db = corpus
    try:
        want = db.execute("SELECT rowid, rank FROM t WHERE t MATCH ? ORDER BY rank, rowid LIMIT 500", (q,)).fetchall()
    except sqlite3.OperationalError:
        want = []
    got = [tuple(r) for r in (fulltext.search(df, q, 500) if over == "texts" else fulltext.lookup(*stored, q, 500)).collect()]
    assert {i for i, _ in got} == {i for i, _ in want}
    if "NEAR" not in q:
        score = dict(want)
        assert all(abs(s - score[i]) < 1e-9 for i, s in got)


def test_keyword_search_edges(spark):
    none = spark.createDataFrame([], "chunk_id long, content string")
    assert fulltext.search(none, "a", 5).collect() == []
    nulls = spark.createDataFrame([(1, None), (2, ""), (3, "a b a")], "chunk_id long, content string")
    assert [r[0] for r in fulltext.search(nulls, "a", 5).collect()] == [3]
    with pytest.raises(fulltext.QueryError):
        fulltext.search(nulls, "(", 5, strict=True)
    assert {tuple(r) for r in fulltext.document_frequency(nulls, "chunk_id", "content").collect()} == {("a", 1, 2), ("b", 1, 1)}


def test_knn_and_centroid(spark):
    rows = [(1, [0.0, 0.0]), (2, [3.0, 4.0]), (3, [0.0, 0.0]), (4, None), (5, [1.0]), (6, [float("nan"), 0.0])]
    df = spark.createDataFrame(rows, "chunk_id long, embedding array<float>")
    assert [tuple(r) for r in vector.knn(df, [0.0, 0.0], 3).collect()] == [(1, 0.0), (3, 0.0), (2, 5.0)]
    g = df.where("chunk_id < 3").withColumn("g", F.lit(1))
    assert vector.centroid(g, "g").head().centroid == [1.5, 2.0]


def _index(spark):
    files = spark.createDataFrame([(1, "/a/x"), (2, "/a/y"), (3, "/b/z")], "id long, path string").withColumn("file_type", F.lit("text"))
    chunks = spark.createDataFrame([(10, 1, 0, "red fox"), (11, 1, 1, "red dog"), (20, 2, 0, "blue fox"), (30, 3, 0, "green owl")], "id long, file_id long, chunk_index int, content string").withColumn("metadata", F.lit(None).cast("string"))
    vectors = spark.createDataFrame([(10, [0.0, 0.0]), (11, [0.0, 1.0]), (20, [0.0, 2.0])], "chunk_id long, embedding array<float>")
    return vectors, chunks, files


def test_hybrid_search(spark):
    v, c, f = _index(spark)
    got = [(r.chunk_id, r.source) for r in hybrid.search(v, c, f, "owl OR fox", [0.0, 0.0], 10).collect()]
    assert got == [(10, "vector"), (11, "vector"), (20, "vector"), (30, "fts")]
    assert [r.chunk_id for r in hybrid.search(v, c, f, "owl", [0.0, 0.0], 2).collect()] == [10, 11]
    assert [(r.chunk_id, r.source) for r in hybrid.search(v, c, f, "owl", [0.0, 0.0], 2, "/b").collect()] == [(30, "fts")]
    assert [r.chunk_id for r in hybrid.search(v, c, f, "owl OR fox", [0.0, 0.0], 9, "/b", scoped=True).collect()] == [30]
    assert len(hybrid.search(v, c, f, "what is?", [0.0, 0.0], 10).collect()) == 3
    like = hybrid.similar(v, c, f, "/a/x", 5).collect()
    assert [(r.path, r.distance, r.sample_content) for r in like] == [("/a/y", 1.5, "blue fox")]
    assert hybrid.similar(v, c, f, "/b/z", 5).collect() == []


def test_sync_plan_and_deletion(spark):
    files = spark.createDataFrame([(1, "a", "h1", 5, 1.0), (2, "b", "h2", 5, None), (3, "c", "h3", 5, 1.0), (4, "d", "h4", 5, 1.0)], "id long, path string, checksum string, file_size long, mtime double")
    scan = spark.createDataFrame([("a", 5, 1.0, None), ("b", 5, 2.0, "h2"), ("c", 6, 2.0, "other"), ("e", 1, 1.0, "h")], "path string, file_size long, mtime double, checksum string")
    got = {r.path: (r.action, r.checksum) for r in sync.plan(scan, files).collect()}
    assert got == {"a": ("unchanged", "h1"), "b": ("backfill", "h2"), "c": ("changed", "other"), "d": ("missing", "h4"), "e": ("new", "h")}
    assert {r.path: r.action for r in sync.plan(scan, files, force=True).collect()}["a"] == "changed"
    v, c, f = _index(spark)
    left = sync.delete_files(spark.createDataFrame([(1,)], "file_id long"), f, c, v)
    assert [sorted(r[0] for r in x.select(x.columns[0]).collect()) for x in (left[0].select("id"), left[1].select("id"), left[2])] == [[2, 3], [20, 30], [20]]


def test_reports(spark):
    assert catalog.status(empty(spark, "files"), empty(spark, "runs")).head().total_files == 0
    log = spark.createDataFrame([(1, "/p", 0), (2, "/p", 1), (3, "/q", 0)], "id long, path string, resolved int").withColumns({"created_at": F.lit("2024-01-01").cast("timestamp"), "error_type": F.lit("transient"), "resolved_at": F.lit(None).cast("timestamp")})
    assert tuple(catalog.quality(log, "/p").head()) == (2, 1, 1)
    assert [r.id for r in catalog.errors(log, None).collect()] == [3, 2, 1]
    done = sync.resolve(log, spark.createDataFrame([("/p",)], "path string"), "2024-02-01").orderBy("id").collect()
    assert [r.resolved for r in done] == [1, 1, 0] and done[0].resolved_at is not None and done[1].resolved_at is None
    many = spark.range(300).select(F.when(F.col("id") < 5, "error").otherwise("indexed").alias("status"))
    assert catalog.details(many).count() == 5 and catalog.details(many.limit(150)).count() == 150
    events = spark.createDataFrame([(1, 1, "running"), (1, 2, "completed")], "id long, seq int, status string")
    assert [tuple(r) for r in sync.latest_runs(events).collect()] == [(1, "completed")]
