"""Documents arriving over time: each micro-batch is chunked, deduplicated against the store and appended."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery

from graphloom.operators.chunking import new_chunks, simple_chunks


def _stored(spark: SparkSession, folder: str, schema) -> DataFrame:
    try:
        return spark.read.schema(schema).parquet(folder)
    except Exception as e:
        if "PATH_NOT_FOUND" in str(e):
            return spark.createDataFrame([], schema)
        raise


def ingest_batch(documents: DataFrame, folder: str, batch: int, max_size: int = 400, overlap: int = 0) -> None:
    """Append the new chunks of one batch under ``folder/batch=N``.

    A batch delivered again overwrites its own folder and doesn't see it as
    stored, so that a restart after a lost driver changes nothing.
    """
    spark = documents.sparkSession
    chunks = simple_chunks(documents, max_size, overlap)
    known = _stored(spark, folder, chunks.schema.add("batch", T.IntegerType())).filter(f"batch <> {batch}")
    fresh = new_chunks(chunks, known, ["doc_id", "chunk_order_idx"])
    fresh.write.mode("overwrite").parquet(f"{folder}/batch={batch}")


def ingest_stream(documents: DataFrame, folder: str, checkpoint: str, max_size: int = 400, overlap: int = 0) -> StreamingQuery:
    """Ingest a streaming DataFrame of (doc_id, text) until what is available is read."""
    return (
        documents.writeStream.foreachBatch(lambda df, n: ingest_batch(df, folder, n, max_size, overlap))
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )
