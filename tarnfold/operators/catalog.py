"""Reports on the index: status, lists, logs, chunks, error quality."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tarnfold.functions.paths import has_prefix

# Errors that the quality report looks at; details that an answer lists in full.
QUALITY_SCAN, DETAILS = 10_000, 200
FILE_COLUMNS = ("id", "path", "file_type", "file_size", "chunk_count", "indexed_at")


def status(files: DataFrame, runs: DataFrame) -> DataFrame:
    """One row: totals, counts by type, latest index time and the latest run."""
    totals = files.agg(F.count(F.lit(1)).alias("total_files"), F.coalesce(F.sum("file_size"), F.lit(0)).cast("long").alias("total_size"), F.coalesce(F.sum("chunk_count"), F.lit(0)).cast("long").alias("total_chunks"), F.max("indexed_at").alias("last_indexed"))
    types = by_type(files).agg(F.map_from_entries(F.sort_array(F.collect_list(F.struct("file_type", "n")))).alias("by_type"))
    last = runs.agg(F.max_by(F.struct(*runs.columns), F.col("id")).alias("last_run"))
    return totals.crossJoin(F.broadcast(types)).crossJoin(F.broadcast(last))


def by_type(files: DataFrame) -> DataFrame:
    return files.groupBy("file_type").agg(F.count(F.lit(1)).alias("n"))


def last_run(runs: DataFrame) -> DataFrame:
    return runs.orderBy(F.desc("id")).limit(1)


def list_files(files: DataFrame, path: str | None = None, limit: int = 50, offset: int = 0, compat: bool = True) -> DataFrame:
    """A page of files, latest indexed first, ties by path and id."""
    return files.where(has_prefix(F.col("path"), path, compat)).select(*FILE_COLUMNS).orderBy(F.desc("indexed_at"), "path", "id").offset(offset).limit(limit)


def log(runs: DataFrame, limit: int = 20) -> DataFrame:
    return runs.orderBy(F.desc("id")).limit(limit)


def get_chunks(chunks: DataFrame, files: DataFrame, file_path: str, limit: int = 50) -> DataFrame:
    """The chunks of a file in order: chunk_id, chunk_index, content, metadata."""
    own = files.where(F.col("path") == file_path).select(F.col("id").alias("file_id")).limit(1)
    found = chunks.join(F.broadcast(own), "file_id", "left_semi")
    return found.select(F.col("id").alias("chunk_id"), "chunk_index", "content", "metadata").orderBy("chunk_index", "chunk_id").limit(limit)


def parsed(rows: DataFrame, column: str = "metadata") -> DataFrame:
    """``rows`` with the JSON text of a column as a value (variant), null where it is none."""
    return rows.withColumn(column, F.try_parse_json(column))


def errors(log_: DataFrame, resolved: bool | None = False, path: str | None = None, limit: int = 100, compat: bool = True) -> DataFrame:
    """The latest errors: unresolved, resolved, or all (None)."""
    rows = log_.where(has_prefix(F.col("path"), path, compat))
    if resolved is not None:
        rows = rows.where(F.col("resolved") == int(resolved))
    return rows.orderBy(F.desc("created_at"), F.desc("id")).limit(limit)


def quality(log_: DataFrame, path: str | None = None, compat: bool = True) -> DataFrame:
    """One row over the latest errors: total, resolved, unresolved."""
    latest = errors(log_, None, path, QUALITY_SCAN, compat)
    return latest.agg(F.count(F.lit(1)).alias("total"), F.count_if(F.col("resolved") == 1).alias("resolved")).withColumn("unresolved", F.col("total") - F.col("resolved"))


def quality_by_type(log_: DataFrame, path: str | None = None, compat: bool = True) -> DataFrame:
    return errors(log_, None, path, QUALITY_SCAN, compat).groupBy("error_type").agg(F.count(F.lit(1)).alias("n"))


def summary(results: DataFrame) -> DataFrame:
    """One row of counters over result rows (status, chunk_count)."""
    count = lambda s: F.count_if(F.col("status") == s)
    return results.agg(count("indexed").alias("files_indexed"), count("skipped").alias("files_skipped"), count("error").alias("files_errored"), count("removed").alias("files_removed"), F.coalesce(F.sum("chunk_count"), F.lit(0)).cast("long").alias("total_chunks"))


def details(results: DataFrame, most: int = DETAILS) -> DataFrame:
    """All result rows where there are at most ``most``, else the errors only."""
    total = results.agg(F.count(F.lit(1)).alias("_n"))
    return results.crossJoin(F.broadcast(total)).where((F.col("_n") <= most) | (F.col("status") == "error")).drop("_n")
