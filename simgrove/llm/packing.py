"""Packing (operator 3): concatenate and cut.

Pass 1 encodes each document and notes how many tokens stand before it in its partition; the sums of
the partitions' totals give each partition's global offset. Pass 2 cuts the one long stream at every
multiple of the window. A document that a window's end falls into gives boundary records: one piece
on either side. Only the last sequence is padded.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .encoding import WordEncoder, of_worker
from .store import Workspace
from .token_counts import byte_slices

PIECES = "doc_id {kind}, start bigint, length bigint, tokens binary, doc_tokens bigint, sequence_id bigint, offset bigint"


def encode_documents(docs: DataFrame, tokenizer_path: str, end_id: int) -> DataFrame:
    """doc_id, part, before (tokens of the same partition that stand before), n, ids (little-endian, 2 or 4 bytes each)."""

    def run(batches):
        encoder, part, before = of_worker(WordEncoder, tokenizer_path), TaskContext.get().partitionId(), 0
        for whole in batches:
            for batch in byte_slices(whole, "text", 4_000_000):
                ids, bounds = encoder.encode(batch.column("text"), end_id)
                size, n = encoder.dtype.itemsize, np.diff(bounds)
                packed = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(n), [None, pa.py_buffer(bounds * size), pa.py_buffer(ids)])
                yield pa.RecordBatch.from_arrays(
                    [batch.column("doc_id"), pa.array(np.full(len(n), part, np.int64)), pa.array(before + bounds[:-1]), pa.array(n), packed.cast(pa.binary())],
                    names=["doc_id", "part", "before", "n", "ids"],
                )
                before += int(bounds[-1])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select(F.col("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(run, f"doc_id {kind}, part bigint, before bigint, n bigint, ids binary")


def pack(docs: DataFrame, tokenizer_path: str, window: int = 4096, end_id: int = 2) -> DataFrame:
    """The pieces of all documents: doc_id, start, length, tokens (unsigned 32-bit little-endian ids),
    doc_tokens, sequence_id, offset.

    Every id, the closing end_id of each document included, lies in exactly one piece; a sequence's
    pieces are gapless from offset 0 and hold at most window ids; all sequences but the last are full.
    A null or empty text is its end_id alone; repeated rows are packed each; an empty table gives no
    pieces. Sequence numbers follow the order of the input's partitions.
    """
    space = Workspace(docs.sparkSession, "packing", docs)
    coded = space.keep(encode_documents(docs, tokenizer_path, end_id), "coded")
    totals = space.keep(coded.groupBy("part").agg(F.sum("n").alias("total")), "totals")
    # One row per input partition, so the running sum over them is small however many documents there are.
    earlier = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    bases = totals.select("part", F.coalesce(F.sum("total").over(earlier), F.lit(0)).alias("base"))
    placed = coded.join(bases, "part").select("doc_id", "n", (F.col("base") + F.col("before")).alias("at"), "ids")

    def run(batches):
        for batch in batches:
            n, at, ids = batch.column("n").to_numpy(), batch.column("at").to_numpy(), batch.column("ids")
            first = at // window
            pieces = (at + n - 1) // window - first + 1
            row = np.repeat(np.arange(len(n)), pieces)
            k = np.arange(len(row)) - np.repeat(np.cumsum(pieces) - pieces, pieces)
            sequence = first[row] + k
            begin = np.maximum(sequence * window, at[row])
            end = np.minimum((sequence + 1) * window, at[row] + n[row])
            tokens, known = [], -1
            for i, a, b in zip(row.tolist(), (begin - at[row]).tolist(), (end - at[row]).tolist(), strict=True):
                if i != known:
                    raw = ids[i].as_buffer()
                    values, known = np.frombuffer(raw, f"<u{len(raw) // int(n[i])}").astype("<u4"), i
                tokens.append(values[a:b].tobytes())
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id").take(pa.array(row)), pa.array(begin - at[row]), pa.array(end - begin), pa.array(tokens, pa.binary()), pa.array(n[row]), pa.array(sequence), pa.array(begin - sequence * window)],
                names=["doc_id", "start", "length", "tokens", "doc_tokens", "sequence_id", "offset"],
            )

    return placed.mapInArrow(run, PIECES.format(kind=docs.schema["doc_id"].dataType.simpleString()))
