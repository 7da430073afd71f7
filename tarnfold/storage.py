"""Shared scratch storage: cutting lineage with written tables.

Intermediate results that are read more than once are written as Parquet below
the folder that ``spark.checkpoint.dir`` names. That folder is shared by all
executors, so a lost executor costs only the tasks it was running. A session
without the setting (tests, a laptop) gets a temporary folder once.
"""

from __future__ import annotations

import atexit
import contextlib
import shutil
import tempfile
import uuid
from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

_KEY = "spark.checkpoint.dir"


def shared_dir(spark: SparkSession) -> str:
    """The shared folder of the session; set to a temporary one only where it is unset."""
    at = spark.conf.get(_KEY, None) or spark.sparkContext.getConf().get(_KEY, None)
    if not at:
        at = "file://" + tempfile.mkdtemp(prefix="tarnfold-")
        atexit.register(shutil.rmtree, local_path(at), True)
        spark.conf.set(_KEY, at)
    return at.rstrip("/")


#: Folders written by the requests that are under way, so that these can remove them.
_SCOPES: list[list[str]] = []


def scratch(spark: SparkSession, name: str) -> str:
    """A fresh path for one intermediate result."""
    folder = f"{shared_dir(spark)}/tarnfold-{uuid.uuid4().hex[:12]}"
    if _SCOPES:
        _SCOPES[-1].append(folder)
    return f"{folder}/{name}"


@contextlib.contextmanager
def removing_scratch(spark: SparkSession) -> Iterator[None]:
    """Removes the intermediate results written within, for work whose answer is whole at the end."""
    _SCOPES.append([])
    try:
        yield
    finally:
        for folder in _SCOPES.pop():
            drop_scratch(spark, folder)


def local_path(uri: str) -> str | None:
    """The file-system path of a ``file:`` URI or plain path, else None."""
    if uri.startswith("file:"):
        return "/" + uri[5:].lstrip("/")
    return uri if "://" not in uri else None


def materialise(df: DataFrame, name: str, spark: SparkSession | None = None, by: str | None = None) -> DataFrame:
    """Writes ``df`` to the shared folder, in folders by the values of a column where asked, and returns a frame that reads it back."""
    spark = spark or df.sparkSession
    path = scratch(spark, name)
    writer = df.write if by is None else df.write.partitionBy(by)
    writer.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def numbered(df: DataFrame, order: list, column: str, start: int) -> DataFrame:
    """``df`` with the numbers from ``start`` on in the given order: a distributed sort and one count per partition, no single task for all rows."""
    rows = materialise(df.orderBy(*order).withColumns({"_part": F.spark_partition_id(), "_at": F.monotonically_increasing_id()}), "numbered")
    first = {}
    for part, n in sorted((r[0], r[1]) for r in rows.groupBy("_part").agg(F.count(F.lit(1))).collect()):
        first[part] = start
        start += n
    at = F.col("_at").bitwiseAND(F.lit((1 << 33) - 1))
    offset = F.try_element_at(F.create_map(*[F.lit(x) for pair in first.items() for x in pair]), F.col("_part")) if first else F.lit(start)
    return rows.withColumn(column, (offset + at).cast("long")).drop("_part", "_at")


def drop_scratch(spark: SparkSession, uri: str) -> None:
    """Removes a written intermediate result."""
    path = spark._jvm.org.apache.hadoop.fs.Path(uri)
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)
