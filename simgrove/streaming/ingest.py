"""Streams of functions: into an index, and against one. Beyond the batch operators; state lives in the tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..operators.index import SimHashIndex, index_entries
from ..operators.search import search_buckets


def function_key(file_id="file_id", address="address", a="hash_a", b="hash_b"):
    """A function id that doesn't depend on arrival: a batch that is written again writes the same ids."""
    return F.xxhash64(file_id, address, a, b)


def ingest(stream: DataFrame, index: SimHashIndex, checkpoint: str, **trigger) -> StreamingQuery:
    """Append each batch of (file_id, address, hash_a, hash_b) to the index, one folder per batch number, so that
    a batch repeated after a failure replaces itself."""

    def write(batch: DataFrame, number: int) -> None:
        held = batch.withColumn("function_id", function_key()).select("function_id", "file_id", "address", "hash_a", "hash_b").persist()
        held.write.mode("overwrite").parquet(f"{index.path}/stream/functions/batch={number}")
        index_entries(held, index.permutations).write.mode("overwrite").partitionBy("perm").parquet(f"{index.path}/stream/entries/batch={number}")
        held.unpersist()

    return stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(**(trigger or {"availableNow": True})).start()


def match(stream: DataFrame, functions: DataFrame, sink: str, checkpoint: str, n: int = 5, permutations: int = 28, **trigger) -> StreamingQuery:
    """Search each batch of queries (query_id, qa, qb) and write the matches of batch k below sink/batch=k."""

    def write(batch: DataFrame, number: int) -> None:
        search_buckets(batch, functions, n, permutations).write.mode("overwrite").parquet(f"{sink}/batch={number}")

    return stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(**(trigger or {"availableNow": True})).start()
