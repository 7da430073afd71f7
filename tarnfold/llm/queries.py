"""Queries pN_... and the SQL that checks them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tarnfold.llm import credentials, encoding, garbled, languages, neighbours, packing, pii, similar, splitting
from tarnfold.tables import table


def p1_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The pairs of chunks of which one is among the ten most similar of the other."""
    near = neighbours.nearest(table(spark, sf_dir, "chunks_vec"), "chunk_id", "embedding")
    return neighbours.pairs(near, "chunk_id").withColumnsRenamed({"id_a": "chunk_id_a", "id_b": "chunk_id_b"})


def p2_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The chunks with a garbled sequence."""
    return garbled.restore(table(spark, sf_dir, "chunks"), "id", "content", with_text=False).select(F.col("id").alias("chunk_id")).distinct()


def p2_restored(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The garbled chunks with their restored content."""
    return garbled.restore(table(spark, sf_dir, "chunks"), "id", "content").select(F.col("id").alias("chunk_id"), "content").dropDuplicates(["chunk_id"])


def p3_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The kinds of personal information in the content and the metadata of chunks."""
    found = pii.mentions(table(spark, sf_dir, "chunks"), "id", "content", "metadata", table(spark, sf_dir, "name_parts"))
    return found.select(F.col("id").alias("chunk_id"), "field", "pii_type").distinct()


def p3_masked(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The chunks with personal information, with placeholders in its place."""
    out = pii.masked(table(spark, sf_dir, "chunks"), "id", "content", "metadata", table(spark, sf_dir, "name_parts"))
    return out.withColumnRenamed("id", "chunk_id").dropDuplicates(["chunk_id"])


def _contents(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    return similar.similar(table(spark, sf_dir, "chunks"), "id", "content", 0.6, words=3, least=20)


def _paths(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    return similar.similar(table(spark, sf_dir, "files"), "id", "path", 0.6, chars=4)


def p4_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The pairs of chunks alike in content and of files alike in path."""
    out = None
    for kind, (links, members) in (("content", _contents(spark, sf_dir)), ("path", _paths(spark, sf_dir))):
        found = similar.pairs(members, links, "id").select(F.lit(kind).alias("kind"), "id_a", "id_b")
        out = found if out is None else out.unionByName(found)
    return out


def p4_classes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per chunk of at least 20 words: the class of equal sets it is in, and the links of this."""
    links, members = _contents(spark, sf_dir)
    return similar.classes(members, links, "id").withColumnRenamed("id", "chunk_id")


def p4_path_classes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per file: the class of equal sets its path is in, and the links of this."""
    links, members = _paths(spark, sf_dir)
    return similar.classes(members, links, "id").withColumnRenamed("id", "file_id")


def p5_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The lines of chunks on which a credential starts."""
    return credentials.locate(table(spark, sf_dir, "chunks"), "id", "content").select(F.col("id").alias("chunk_id"), "line_no").distinct()


def p5_redacted(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The chunks that hold credentials, with these redacted."""
    return credentials.redacted(table(spark, sf_dir, "chunks"), "id", "content").select(F.col("id").alias("chunk_id"), "content").dropDuplicates(["chunk_id"])


def p6_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All pieces of the chunks above 1,000 characters."""
    chunks = table(spark, sf_dir, "chunks").select("id", "content").dropDuplicates(["id"])
    return splitting.split(chunks, "id", "content", only_over=True).withColumnRenamed("id", "chunk_id")


def p6_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The chunks that the splitter cuts into more than one piece."""
    pieces = splitting.split(table(spark, sf_dir, "chunks"), "id", "content", only_over=True, with_text=False)
    return pieces.where(F.col("piece_index") == 1).select(F.col("id").alias("chunk_id")).distinct()


def p7_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ids of every document's text."""
    return encoding.encode(table(spark, sf_dir, "documents"), "doc_id", "text")


def p8_containers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The documents, by tokens, in containers of 2,048."""
    sizes = encoding.token_counts(table(spark, sf_dir, "documents"), "doc_id", "text")
    return packing.pack(sizes, "doc_id", "n_tokens").withColumnRenamed("size", "n_tokens")


def p9_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The languages that a document has a sentence in and its label does not name."""
    documents = table(spark, sf_dir, "documents")
    keyed = documents.select(F.struct("doc_id", "lang").alias("key"), "text")
    found = languages.spoken(keyed, "key", "text", table(spark, sf_dir, "lang_samples"))
    named = languages.named(F.col("key.lang"))
    return found.where(named.isNull() | (named != F.col("lang"))).select(F.col("key.doc_id").alias("doc_id"), "lang").distinct()


def p9_segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The segments of documents, each in one language, with their confidence."""
    return languages.segments(table(spark, sf_dir, "documents"), "doc_id", "text", table(spark, sf_dir, "lang_samples"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {"p1_found": p1_found, "p2_found": p2_found, "p2_restored": p2_restored, "p3_found": p3_found, "p3_masked": p3_masked, "p4_found": p4_found, "p4_classes": p4_classes, "p4_path_classes": p4_path_classes, "p5_found": p5_found, "p5_redacted": p5_redacted, "p6_found": p6_found, "p6_pieces": p6_pieces, "p7_ids": p7_ids, "p8_containers": p8_containers, "p9_found": p9_found, "p9_segments": p9_segments}


_WORD_SETS = """c AS (SELECT DISTINCT id, content FROM chunks WHERE content IS NOT NULL), w AS (SELECT id, list_filter(regexp_split_to_array(lower(content), '[ \\t\\r\\n]+'), lambda x: x <> '') AS w FROM c),
s AS (SELECT DISTINCT id, w[i] || ' ' || w[i + 1] || ' ' || w[i + 2] AS g FROM (SELECT id, w, unnest(range(1, len(w) - 1)) AS i FROM w WHERE len(w) >= 20))"""
_PATH_SETS = "f AS (SELECT DISTINCT id, lower(path) AS p FROM files WHERE path IS NOT NULL), z AS (SELECT DISTINCT id, substring(p, i, 4) AS g FROM (SELECT id, p, unnest(range(1, length(p) - 2)) AS i FROM f))"


def _alike(kind: str, sets: str) -> str:
    """SQL of the pairs of sets that share 60 % of their union."""
    return f"""SELECT '{kind}' AS kind, id_a, id_b FROM (SELECT a.id AS id_a, b.id AS id_b, count(*) AS o FROM {sets} a JOIN {sets} b ON a.g = b.g AND a.id < b.id GROUP BY 1, 2)
JOIN (SELECT id, count(*) AS n FROM {sets} GROUP BY id) x ON x.id = id_a JOIN (SELECT id, count(*) AS n FROM {sets} GROUP BY id) y ON y.id = id_b WHERE o * 10 >= 6 * (x.n + y.n - o)"""


def oracle_sql() -> dict[str, str]:
    return {
        "p4_found": f"WITH {_WORD_SETS}, {_PATH_SETS} {_alike('content', 's')} UNION ALL {_alike('path', 'z')}",
        "p6_found": "SELECT DISTINCT id AS chunk_id FROM chunks WHERE length(content) > 1000",
    }
