"""Hybrid search and similar files, composed of vector and keyword search."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tarnfold.functions.paths import has_prefix
from tarnfold.operators import fulltext, vector

# How many times the limit is fetched by vector; more rows for similar files; characters of a sample.
OVERFETCH, SIMILAR_EXTRA, SAMPLE = 3, 10, 200


def vector_hits(vectors: DataFrame, chunks: DataFrame, files: DataFrame, query: list[float] | DataFrame, limit: int, path: str | None = None, compat: bool = True, scoped: bool = False, unique: bool = False) -> DataFrame:
    """The nearest ``3 × limit`` chunks with their files.

    A path prefix is applied to these afterwards, so fewer may be left;
    ``scoped`` applies it before instead.
    """
    if scoped and path:
        inside = chunks.join(files.where(has_prefix(F.col("path"), path, compat)).select(F.col("id").alias("file_id")), "file_id", "left_semi")
        vectors = vectors.join(inside.select(F.col("id").alias("chunk_id")), "chunk_id", "left_semi")
    near = vector.described(vector.knn(vectors, query, OVERFETCH * limit, unique=unique), chunks, files)
    return near.where(has_prefix(F.col("path"), path, compat))


def merge(vectors: DataFrame, keywords: DataFrame, limit: int) -> DataFrame:
    """Vector rows first, then keyword rows not among them, cut to ``limit``; scores are not fused.

    ``vectors`` has distance, ``keywords`` has score; ranks are by these, ties by chunk_id.
    """
    first = vectors.select(F.lit(0).alias("branch"), F.col("distance").alias("_o"), "*").withColumn("source", F.lit("vector")).withColumnRenamed("distance", "vector_distance")
    second = keywords.select(F.lit(1).alias("branch"), F.col("score").alias("_o"), "*").withColumn("source", F.lit("fts")).withColumnRenamed("score", "fts_score")
    both = first.unionByName(second, allowMissingColumns=True)
    return vector.best_per_group(both, "chunk_id", ["branch"]).orderBy("branch", "_o", "chunk_id").limit(limit).drop("branch", "_o")


def search(vectors: DataFrame, chunks: DataFrame, files: DataFrame, text: str, query: list[float] | DataFrame, limit: int = 10, path: str | None = None, compat: bool = True, scoped: bool = False, unique: bool = False, index: tuple[DataFrame, DataFrame] | None = None) -> DataFrame:
    """Hybrid search: chunk_id, content, metadata, chunk_index, path, file_type, source, vector_distance, fts_score.

    Keyword hits are not restricted to ``path`` unless ``scoped``; a query
    that keyword search can't parse has vector rows only. ``index``: postings
    and statistics of a stored keyword index, which is read instead of texts.
    """
    near = vector_hits(vectors, chunks, files, query, limit, path, compat, scoped, unique)
    pool = chunks
    if scoped and path:
        pool = chunks.join(files.where(has_prefix(F.col("path"), path, compat)).select(F.col("id").alias("file_id")), "file_id", "left_semi")
    if index is not None and pool is chunks:
        found = fulltext.lookup(*index, text, limit)
    else:
        found = fulltext.search(pool.withColumnRenamed("id", "chunk_id"), text, limit, unique=unique)
    return merge(near, vector.described(found, chunks, files), limit)


def similar(vectors: DataFrame, chunks: DataFrame, files: DataFrame, file_path: str, limit: int = 10, unique: bool = False) -> DataFrame:
    """Files like one: its chunks' mean vector, the nearest chunks, the best one of each other file.

    path, file_type, distance, sample_content. A file without vectors has none like it.
    """
    own = chunks.join(F.broadcast(files.where(F.col("path") == file_path).select(F.col("id").alias("file_id")).limit(1)), "file_id", "left_semi")
    mine = vectors.join(own.select(F.col("id").alias("chunk_id")), "chunk_id", "left_semi").withColumn("_g", F.lit(1))  # one file may hold any share of the chunks: no forced broadcast
    mine = mine if unique else mine.dropDuplicates(["chunk_id"])
    query = vector.centroid(mine, "_g").select(F.col("centroid").alias("query"))
    near = vector.described(vector.knn(vectors, query, OVERFETCH * (limit + SIMILAR_EXTRA), unique=unique), chunks, files)
    best = vector.best_per_group(near.where(F.col("path") != file_path), "path", ["distance", "chunk_id"])
    return best.select("path", "file_type", "distance", F.substring("content", 1, SAMPLE).alias("sample_content"), "chunk_id").orderBy("distance", "chunk_id").limit(limit).drop("chunk_id")
