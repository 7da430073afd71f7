"""Exact vector search: Euclidean distance, top-k, centroids."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type


def l2(vector: Column, query: Column) -> Column:
    """Euclidean distance in double precision; null where lengths differ."""
    squares = F.aggregate(F.zip_with(vector, query, lambda a, b: (a.cast("double") - b) * (a.cast("double") - b)), F.lit(0.0), lambda x, y: x + y)
    return F.when(F.size(vector) == F.size(query), F.sqrt(squares))


def _best(q: np.ndarray, k: int, kind: pa.DataType, names: list[str]):
    """The ``k`` nearest distinct ids of each partition: what leaves it doesn't grow with its rows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, far = None, np.zeros(0)
        for batch in batches:
            right = pc.and_(pc.equal(pc.list_value_length(batch.column(1)), len(q)), pc.is_valid(batch.column(0))).fill_null(False)
            column, own = batch.column(1).filter(right), batch.column(0).filter(right).to_numpy(zero_copy_only=False)
            x = pc.list_flatten(column).to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, len(q))
            with np.errstate(invalid="ignore", over="ignore"):
                d = np.sqrt(((x - q) ** 2).sum(1))
            ok = ~np.isnan(d)
            ids, far = (own[ok] if ids is None else np.concatenate([ids, own[ok]])), np.concatenate([far, d[ok]])
            order = np.lexsort((ids, far))
            _, first = np.unique(ids[order], return_index=True)
            keep = order[np.sort(first)[:k]]
            ids, far = ids[keep], far[keep]
        if ids is not None and len(ids):
            yield pa.RecordBatch.from_arrays([pa.array(ids, kind), pa.array(far)], names)

    return run


def knn(vectors: DataFrame, query: list[float] | DataFrame, k: int, id_col: str = "chunk_id", vector_col: str = "embedding", unique: bool = False) -> DataFrame:
    """The ``k`` nearest vectors: ``id_col`` and distance, ties by id.

    ``query`` is a vector or a frame with a column ``query``, whose first row
    is read at once. Null ids, null vectors and those of another length, with
    null or with NaN take no part. Ids count once, with their least distance.
    Every task keeps its ``k`` nearest, so only these are shuffled.
    """
    kind = vectors.schema[id_col].dataType
    if isinstance(query, DataFrame):
        first = query.select("query").head()
        query = first[0] if first else None
    if not query:
        return vectors.select(id_col, F.lit(0.0).alias("distance")).limit(0)
    rows = vectors.select(id_col, F.col(vector_col).cast("array<double>").alias("_v"))
    near = rows.mapInArrow(_best(np.asarray(query, float), k, to_arrow_type(kind), [id_col, "distance"]), f"`{id_col}` {kind.simpleString()}, distance double")
    return near.groupBy(id_col).agg(F.min("distance").alias("distance")).orderBy("distance", id_col).limit(k)


def _blocks(rows: DataFrame, key: str, vector: str, size: int, prefix: str) -> DataFrame:
    """Rows gathered to blocks of about ``size``: ids and vectors as lists."""
    n = max(1, -(-rows.count() // size))
    block = F.pmod(F.xxhash64(key), F.lit(n))
    return rows.groupBy(block.alias("_b")).agg(F.collect_list(F.struct(F.col(key).cast("long").alias("id"), F.col(vector).cast("array<double>").alias("v"))).alias("_s")).select(F.col("_s.id").alias(f"{prefix}_ids"), F.col("_s.v").alias(f"{prefix}_vs"))


def _nearest_of_blocks(k: int):
    def run(batches):
        for batch in batches:
            for q_ids, q_vs, r_ids, r_vs in zip(*(batch.column(i).to_pylist() for i in range(4))):
                ids, out = np.asarray(r_ids, np.int64), ([], [], [])
                width = np.asarray([len(v) for v in r_vs])
                same = {n: (ids[width == n], np.asarray([v for v in r_vs if len(v) == n], float)) for n in {len(v) for v in q_vs} & set(width.tolist())}
                for q, v in zip(q_ids, q_vs):
                    if len(v) in same:
                        own, x = same[len(v)]
                        far = np.sqrt(((x - np.asarray(v, float)) ** 2).sum(1))
                        best = [i for i in np.lexsort((own, far)) if not np.isnan(far[i])][:k]
                        out[0].extend([q] * len(best)), out[1].extend(own[best].tolist()), out[2].extend(far[best].tolist())
                yield pa.RecordBatch.from_arrays([pa.array(out[0], pa.int64()), pa.array(out[1], pa.int64()), pa.array(out[2], pa.float64())], ["query_id", "_id", "distance"])

    return run


def knn_join(vectors: DataFrame, queries: DataFrame, k: int, id_col: str = "chunk_id", vector_col: str = "embedding", block: int = 512) -> DataFrame:
    """The ``k`` nearest vectors of every row of ``queries`` (same columns): query_id, ``id_col``, distance, ties by id.

    Blocks of queries meet blocks of all rows, so neither side is gathered whole. Vectors with null take no part.
    """
    whole = lambda df: df.select(id_col, vector_col).where(F.col(vector_col).isNotNull() & ~F.exists(vector_col, lambda x: x.isNull())).dropDuplicates([id_col])
    met = _blocks(whole(queries), id_col, vector_col, block, "q").crossJoin(_blocks(whole(vectors), id_col, vector_col, block, "r"))
    found = met.mapInArrow(_nearest_of_blocks(k), "query_id long, _id long, distance double")
    return best_k(found.withColumnRenamed("_id", id_col), "query_id", ["distance", id_col], k)


def best_k(hits: DataFrame, group: str, order: list[str], k: int) -> DataFrame:
    """The first ``k`` rows of each group in the given order."""
    return hits.withColumn("_rn", F.row_number().over(Window.partitionBy(group).orderBy(*order))).where(F.col("_rn") <= k).drop("_rn")


def described(hits: DataFrame, chunks: DataFrame, files: DataFrame) -> DataFrame:
    """Hits joined with their chunks and files, rows repeated in these once; the few hits are the side that is sent around."""
    found = chunks.join(F.broadcast(hits), chunks["id"] == hits["chunk_id"]).select("chunk_id", *[c for c in hits.columns if c != "chunk_id"], "file_id", "content", "metadata", "chunk_index").dropDuplicates(["chunk_id"])
    f = files.select(F.col("id").alias("_fid"), "path", "file_type")
    return f.join(F.broadcast(found), F.col("_fid") == F.col("file_id")).drop("_fid", "file_id").dropDuplicates(["chunk_id"])


def centroid(vectors: DataFrame, by: str, vector_col: str = "embedding") -> DataFrame:
    """Mean vector (not renormalised) of each group: ``by``, ``centroid`` array of double.

    Values are averaged by position with partial aggregation, so no group is gathered whole.
    """
    each = vectors.where(F.col(vector_col).isNotNull()).select(by, F.posexplode(vector_col).alias("_i", "_x"))
    mean = each.groupBy(by, "_i").agg(F.avg(F.col("_x").cast("double")).alias("_m"))
    return mean.groupBy(by).agg(F.transform(F.sort_array(F.collect_list(F.struct("_i", "_m"))), lambda z: z["_m"]).alias("centroid"))


def best_per_group(hits: DataFrame, group: str, order: list[str]) -> DataFrame:
    """The first row of each group in the given order."""
    return hits.withColumn("_rn", F.row_number().over(Window.partitionBy(group).orderBy(*order))).where("_rn = 1").drop("_rn")
