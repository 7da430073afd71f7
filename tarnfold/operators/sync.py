"""Incremental synchronisation as relational operators."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tarnfold.functions.paths import has_prefix


def plan(scan: DataFrame, files: DataFrame, force: bool = False) -> DataFrame:
    """What to do with each path of a scan and of the index.

    ``scan``: path, file_size, mtime, checksum (its column may be computed from
    bytes; it is read only where size or time differ). ``files``: the index.
    path, file_id, action (new, changed, unchanged, backfill, missing),
    checksum, mtime. Where size and time both agree the stored checksum stands;
    ``backfill`` is unchanged content whose stored time is unknown.
    """
    f = files.select(F.col("path").alias("_p"), F.col("id").alias("file_id"), F.col("checksum").alias("_c"), F.col("file_size").alias("_s"), F.col("mtime").alias("_m"))
    both = scan.join(f, scan["path"] == f["_p"], "full_outer")
    fast = F.col("_m").isNotNull() & (F.col("mtime") == F.col("_m")) & (F.col("file_size") == F.col("_s"))
    checksum = F.when(fast, F.col("_c")).otherwise(F.col("checksum"))
    same = checksum == F.col("_c")
    action = (
        F.when(F.col("path").isNull(), "missing").when(F.col("_p").isNull(), "new").when(F.lit(force) | ~F.coalesce(same, F.lit(False)), "changed").when(F.col("_m").isNull(), "backfill").otherwise("unchanged")
    )
    return both.select(F.coalesce("path", "_p").alias("path"), "file_id", action.alias("action"), F.coalesce(checksum, F.col("_c")).alias("checksum"), F.coalesce("mtime", "_m").alias("mtime"))


def delete_files(ids: DataFrame, files: DataFrame, chunks: DataFrame, vectors: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Files, chunks and vectors without those of the files ``ids`` (a column ``file_id``)."""
    gone = ids.select("file_id").distinct()
    kept = files.join(gone.withColumnRenamed("file_id", "id"), "id", "left_anti")
    dead = chunks.join(gone, "file_id", "left_semi").select(F.col("id").alias("chunk_id"))
    return kept, chunks.join(gone, "file_id", "left_anti"), vectors.join(dead, "chunk_id", "left_anti")


def under(files: DataFrame, path: str, directory: bool, compat: bool = True) -> DataFrame:
    """The files that removing ``path`` removes: itself, or all below it where it is a directory."""
    hit = has_prefix(F.col("path"), path.rstrip("/"), compat, boundary=True) if directory else F.col("path") == path
    return files.where(hit)


def resolve(log: DataFrame, stored: DataFrame, now: object) -> DataFrame:
    """The error log with the open errors of the stored paths (a column ``path``) resolved at ``now``."""
    ok = stored.select("path").where("path is not null").distinct().withColumn("_ok", F.lit(True))
    rows = log.join(ok, "path", "left")
    hit = F.coalesce("_ok", F.lit(False)) & (F.col("resolved") == 0)
    return rows.select(*[F.when(hit, F.lit(1)).otherwise(F.col(c)).alias(c) if c == "resolved" else F.when(hit, F.lit(now).cast("timestamp")).otherwise(F.col(c)).alias(c) if c == "resolved_at" else F.col(c) for c in log.columns])


def resolvable(log: DataFrame, stored: DataFrame) -> DataFrame:
    """The open errors of the stored paths: what ``resolve`` changes."""
    return log.where("resolved = 0").join(stored.select("path").distinct(), "path", "left_semi")


def latest_runs(events: DataFrame) -> DataFrame:
    """The state of each run from its append-only events: the last by ``seq``."""
    return events.groupBy("id").agg(F.max_by(F.struct(*[c for c in events.columns if c not in ("id", "seq")]), F.col("seq")).alias("_s")).select("id", "_s.*")
