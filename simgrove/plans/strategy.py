"""Plan-shape decisions that Catalyst can't make: what is computed once, and which side may be broadcast."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Hamming tests above which a caller should go through buckets instead of a sweep.
EXACT_LIMIT = 5_000_000_000
#: Rows of a side that may be broadcast; a row of hashes takes about 40 bytes.
BROADCAST_ROWS = 100_000
#: Shuffle files go when the write that needed them is over.
_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
_folders: dict[str, str] = {}


def use_exact(queries: int, indexed: int) -> bool:
    return queries * indexed <= EXACT_LIMIT


def kept(df: DataFrame) -> DataFrame:
    """df written once to the folder in spark.checkpoint.dir, and read back: for a costly table that is read several
    times. Where the session names no folder: a temporary one on a local master, an error on a cluster."""
    spark = df.sparkSession
    at = spark.conf.get("spark.checkpoint.dir", None)
    if not at:
        master = spark.sparkContext.master
        if master != "local" and not master.startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        at = _folders.setdefault(spark.sparkContext.applicationId, "file://" + tempfile.mkdtemp(prefix="simgrove-"))
    path = f"{at.rstrip('/')}/kept-{uuid.uuid4().hex[:12]}"
    before = spark.conf.get(_CLEANUP, "false")
    spark.conf.set(_CLEANUP, "true")
    try:
        df.write.parquet(path)
    finally:
        spark.conf.set(_CLEANUP, before)
    return spark.read.schema(df.schema).parquet(path)


def spread(df: DataFrame) -> DataFrame:
    """df over all cores where its source has fewer splits than that; larger sources aren't shuffled."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df if df.rdd.getNumPartitions() >= cores else df.repartition(cores)


def small(df: DataFrame, rows: int = BROADCAST_ROWS) -> bool:
    """Whether df has at most that many rows. df should be a table or kept: it is read up to one row beyond them."""
    return df.limit(rows + 1).count() <= rows


def broadcast_if_small(df: DataFrame, rows: int = BROADCAST_ROWS) -> DataFrame:
    return F.broadcast(df) if small(df, rows) else df
