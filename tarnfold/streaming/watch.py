"""Keeping a keyword table up to date from a stream of chunk files.

An extension: the batch operators are applied to each micro-batch, so a
stream's result equals that of one batch over all input.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery

from tarnfold.operators import fulltext
from tarnfold.schema import schema


def stream_postings(spark: SparkSession, source: str, target: str, checkpoint: str) -> StreamingQuery:
    """Appends the postings of every new chunk file below ``source`` to Parquet in ``target``, each file once."""
    chunks = spark.readStream.schema(schema("chunks")).parquet(source)

    def write(batch: DataFrame, number: int) -> None:
        fulltext.postings(batch.dropDuplicates(["id"]), "id", "content").write.mode("overwrite").parquet(f"{target}/batch={number}")

    return chunks.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
