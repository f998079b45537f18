"""The similarity index: functions with their hashes, and a bucket entry for each permutation."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .. import schemas
from ..plans.permutation import bucket_positions


def explode_buckets(hashes: DataFrame, permutations: int = 28, a: str = "hash_a", b: str = "hash_b") -> DataFrame:
    """Each row once per permutation, with perm and bucket: no shuffle, eight bits picked at a time over a whole batch.
    (As SQL functions these are 224 bit picks a row, and compiling them takes longer than running them.)"""
    positions, columns = bucket_positions(permutations), hashes.columns

    def run(batches):
        for batch in batches:
            words = [batch.column(c).to_numpy().view(np.uint64) for c in (b, a)]
            for perm, picked in enumerate(positions):
                bucket = np.zeros(batch.num_rows, np.uint64)
                for p in picked:
                    bucket = bucket << np.uint64(1) | words[p // 64] >> np.uint64(p % 64) & np.uint64(1)
                yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(np.full(batch.num_rows, perm, np.int32)), pa.array(bucket.astype(np.int32))], names=[*columns, "perm", "bucket"])

    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in hashes.schema.fields)
    return hashes.mapInArrow(run, f"{kinds}, perm int, bucket int")


def index_entries(functions: DataFrame, permutations: int = 28) -> DataFrame:
    return explode_buckets(functions.select("function_id", "hash_a", "hash_b"), permutations).select("perm", "bucket", "hash_a", "hash_b", "function_id")


def assign_ids(functions: DataFrame, largest: int = 0) -> DataFrame:
    """Adds function_id: largest + 1, + 2, ... without gaps; the same rows get the same ids in any run.

    Two passes: rows are dealt over blocks by hash and counted, then numbered within their block in order of
    (file_id, address, hash). Blocks depend on values only, so both passes agree; no task sees all rows."""
    key = ["file_id", "address", "hash_a", "hash_b"]
    blocks = int(functions.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = functions.withColumn("_block", F.pmod(F.xxhash64(*key), F.lit(blocks)))
    counts = dealt.groupBy("_block").agg(F.count(F.lit(1)).alias("_n"))
    earlier = Window.orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)
    bases = counts.select("_block", F.coalesce(F.sum("_n").over(earlier), F.lit(0)).alias("_base"))
    place = F.row_number().over(Window.partitionBy("_block").orderBy(*key))
    return dealt.withColumn("_at", place).join(F.broadcast(bases), "_block").withColumn("function_id", F.lit(largest) + F.col("_base") + F.col("_at")).drop("_block", "_at", "_base")


class SimHashIndex:
    """An index as Parquet tables below a path: functions, entries by permutation, and its parameters."""

    def __init__(self, spark: SparkSession, path: str, create: bool = False, buckets: int = 28):
        self.spark, self.path = spark, path.rstrip("/")
        if create:
            spark.createDataFrame([(buckets,)], "permutations int").coalesce(1).write.mode("overwrite").parquet(f"{self.path}/params")
            spark.createDataFrame([], schemas.FUNCTIONS).write.mode("overwrite").parquet(f"{self.path}/functions")
            spark.createDataFrame([], schemas.INDEX_ENTRIES).write.mode("overwrite").partitionBy("perm").parquet(f"{self.path}/entries")
        self.permutations = spark.read.parquet(f"{self.path}/params").first()[0]
        if self.permutations != buckets:
            raise ValueError(f"index has {self.permutations} permutations, not {buckets}")

    @property
    def functions(self) -> DataFrame:
        return self.spark.read.schema(schemas.FUNCTIONS).parquet(f"{self.path}/functions")

    @property
    def entries(self) -> DataFrame:
        return self.spark.read.schema(schemas.INDEX_ENTRIES).parquet(f"{self.path}/entries")

    def add(self, functions: DataFrame) -> int:
        """Append functions (file_id, address, hash_a, hash_b); ids go on from the largest. Equal keys may repeat."""
        largest = self.functions.agg(F.max("function_id")).first()[0] or 0
        numbered = assign_ids(functions, largest).select("function_id", "file_id", "address", "hash_a", "hash_b")
        numbered.write.mode("append").parquet(f"{self.path}/functions")
        added = self.functions.filter(F.col("function_id") > largest)
        index_entries(added, self.permutations).write.mode("append").partitionBy("perm").parquet(f"{self.path}/entries")
        return added.count()

    def stats(self) -> DataFrame:
        return index_stats(self.functions, self.entries)

    def dump(self, every_permutation: bool = False) -> DataFrame:
        entries = self.entries if every_permutation else self.entries.filter("perm = 0")
        return entries.join(self.functions.select("function_id", "file_id", "address"), "function_id").select("perm", "hash_a", "hash_b", "file_id", "address")


def index_stats(functions: DataFrame, entries: DataFrame) -> DataFrame:
    """entries, functions, permutations: one row."""
    per = entries.agg(F.count(F.lit(1)).alias("entries"), (F.max("perm") + 1).alias("permutations"))
    return per.crossJoin(functions.agg(F.count(F.lit(1)).alias("functions")))


def merge_metadata(known: DataFrame, new: DataFrame, key: tuple[str, ...] = ("file_id", "address")) -> DataFrame:
    """Rows of both; where a key stands in both, the new row."""
    return new.unionByName(known.join(new.select(*key).distinct(), list(key), "left_anti"))
