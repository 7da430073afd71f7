"""Schemas of the index and its defaults."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.types import StructType

SCHEMAS = {
    "files": "id long, path string, checksum string, file_type string, file_size long, mtime double, chunk_count int, indexed_at timestamp",
    "chunks": "id long, file_id long, chunk_index int, content string, metadata string",
    "vectors": "chunk_id long, embedding array<float>",
    "postings": "bucket int, token string, chunk_id long, dl int, positions array<int>",
    "corpus": "n long, tokens long",
    "runs": "id long, started_at timestamp, finished_at timestamp, path string, status string, files_found int, files_indexed int, files_skipped int, files_errored int, total_chunks int, error_message string, seq int",
    "errors": "id long, run_id long, path string, error_message string, error_type string, created_at timestamp, resolved_at timestamp, resolved int",
}


def schema(name: str) -> StructType:
    return StructType.fromDDL(SCHEMAS[name])


#: Tables whose files are laid out by the values of a column.
LAID_OUT = {"postings": "bucket"}


def empty(spark: SparkSession, name: str) -> DataFrame:
    return spark.createDataFrame([], schema(name))


def conform(df: DataFrame, name: str) -> DataFrame:
    """``df`` in the schema ``name``; columns that older data lack (as mtime once) become null."""
    blank = empty(df.sparkSession, name)
    return blank.unionByName(df, allowMissingColumns=True).select(blank.columns)
