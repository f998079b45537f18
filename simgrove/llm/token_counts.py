"""Token counts (operator 8): lengths only, from Arrow batches."""

from __future__ import annotations

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .encoding import TokenCounter, of_worker

#: Bytes of text that are worked on at once within an Arrow batch; kernels take some 100 bytes of memory for each.
SLICE_BYTES = 2_000_000


def byte_slices(batch: pa.RecordBatch, column: str, most: int = SLICE_BYTES):
    """The batch in slices of about `most` bytes of that column; one row at least."""
    size = pc.binary_length(batch.column(column)).fill_null(0).to_numpy()
    at, held = 0, 0
    for i, n in enumerate(size):
        held += int(n)
        if held >= most:
            yield batch.slice(at, i + 1 - at)
            at, held = i + 1, 0
    if at < batch.num_rows:
        yield batch.slice(at)


def count_tokens(docs: DataFrame, tokenizer_path: str, limit: int = 512) -> DataFrame:
    """doc_id, n_bytes (UTF-8), n_tokens, over_limit (n_tokens > limit) for each row of docs.

    The file is one of a byte-level BPE for the library ``tokenizers``; its path must exist on every
    executor. No shuffle; memory per task is one slice of texts plus the bounded chunk cache. A null
    or empty text has 0 bytes and 0 tokens; repeated rows each give a row; an empty table gives none;
    other columns are ignored.
    """

    def run(batches):
        counter = of_worker(TokenCounter, tokenizer_path)
        for whole in batches:
            for batch in byte_slices(whole, "text"):
                text = batch.column("text").fill_null("")
                n = counter.counts(text.to_pylist())
                size = pc.cast(pc.binary_length(text), pa.int64())
                yield pa.RecordBatch.from_arrays([batch.column("doc_id"), size, pa.array(n), pa.array(n > limit)], names=["doc_id", "n_bytes", "n_tokens", "over_limit"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select(F.col("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(run, f"doc_id {kind}, n_bytes bigint, n_tokens bigint, over_limit boolean")
