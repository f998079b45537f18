"""Retrieval quality: distance histograms, means, ROC."""

from __future__ import annotations

import math
from collections.abc import Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.bits import hamming128
from ..plans.strategy import kept

#: Distance matrix: hashes of a block (a multiple of 8, so that repetitions fall on whole bytes), and blocks of a task's side.
BLOCK, BLOCKS = 1024, 4


def pair_distances(pairs: DataFrame, hashes: DataFrame) -> DataFrame:
    """Adds distance to pairs (a, b); hashes: key, hash_a, hash_b. Pairs of unknown keys go."""
    left = hashes.select(F.col("key").alias("a"), F.col("hash_a").alias("a1"), F.col("hash_b").alias("a2"))
    right = hashes.select(F.col("key").alias("b"), F.col("hash_a").alias("b1"), F.col("hash_b").alias("b2"))
    return pairs.join(left, "a").join(right, "b").withColumn("distance", hamming128("a1", "a2", "b1", "b2")).drop("a1", "a2", "b1", "b2")


def histogram(distances: DataFrame, *by: str) -> DataFrame:
    return distances.groupBy(*by, "distance").agg(F.count(F.lit(1)).alias("pairs"))


def difference_of_means(distances: DataFrame) -> DataFrame:
    """attraction, repulsion, difference: mean distances; distances has attract (boolean)."""
    near, far = F.avg(F.when(F.col("attract"), F.col("distance"))), F.avg(F.when(~F.col("attract"), F.col("distance")))
    return distances.agg(near.alias("attraction"), far.alias("repulsion"), (far - near).alias("difference"))


def distance_statistics(hashes: DataFrame) -> DataFrame:
    """least, mean, most distance over all unordered pairs of different keys."""
    left = hashes.select(F.col("key").alias("a"), F.col("hash_a").alias("a1"), F.col("hash_b").alias("a2"))
    right = hashes.select(F.col("key").alias("b"), F.col("hash_a").alias("b1"), F.col("hash_b").alias("b2"))
    return left.join(right, F.col("a") < F.col("b")).agg(*[f(hamming128("a1", "a2", "b1", "b2")).alias(n) for f, n in ((F.min, "least"), (F.avg, "mean"), (F.max, "most"))])


def _blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A partition's hashes, BLOCK to a row; the blocks are numbered over all partitions."""
    part, batches = TaskContext.get().partitionId() << 32, list(batches)
    rows = pa.Table.from_batches(batches) if batches else []
    for at in range(0, len(rows), BLOCK):
        block = rows.slice(at, BLOCK).combine_chunks()
        lists = [pa.ListArray.from_arrays([0, len(block)], c.chunk(0)) for c in block.columns]
        yield pa.RecordBatch.from_arrays([pa.array([part + at]), *lists], names=["block", *block.column_names])


def distance_matrix(hashes: DataFrame) -> DataFrame:
    """a, b, distance of every hash against every hash, itself included. hashes: key, hash_a, hash_b.

    Hashes go to a kept table in blocks, and tasks take BLOCKS of these against as many rows. A hash meets a block that
    isn't before its own: first come its rows with the block's keys, then, for another block, the same distances with a
    and b exchanged. So a distance is found once, and in files the block's keys and a row's distances are repetitions,
    which a codec takes out. hashes is counted, so it should be a file or kept."""
    hashes = hashes.select("key", "hash_a", "hash_b")
    schema = "block bigint, " + ", ".join(f"{f.name} array<{f.dataType.simpleString()}>" for f in hashes.schema)
    dealt = hashes.repartition(max(1, math.ceil(hashes.count() / (16 * BLOCK))))
    blocks = kept(dealt.mapInArrow(_blocks, schema))
    number, cores = blocks.count(), hashes.sparkSession.sparkContext.defaultParallelism
    blocks = blocks.repartition(max(1, min(number, max(math.ceil(number / BLOCKS), math.isqrt(2 * cores) + 1))))
    row = F.explode(F.arrays_zip("key", "hash_a", "hash_b")).alias("row")
    rows = blocks.select(F.col("block").alias("own"), row).select("own", F.col("row.key").alias("a"), F.col("row.hash_a").alias("a1"), F.col("row.hash_b").alias("a2"))
    # Never a broadcast: a task would hold all rows that come of one row of the other side.
    met = blocks.join(rows.hint("shuffle_replicate_nl"), F.col("own") <= F.col("block"))
    size = F.size("key")
    turns = F.when(F.col("own") == F.col("block"), size).otherwise(2 * size)
    met = met.select("*", F.explode(F.sequence(F.lit(0), turns - 1)).alias("turn"))
    there, at = F.col("turn") < size, F.when(F.col("turn") < size, F.col("turn")).otherwise(F.col("turn") - size)
    key, b1, b2 = (F.get(c, at) for c in ("key", "hash_a", "hash_b"))
    return met.select(F.when(there, F.col("a")).otherwise(key).alias("a"), F.when(there, key).otherwise(F.col("a")).alias("b"), hamming128("a1", "a2", b1, b2).alias("distance"))


def family_subset(families: DataFrame, number: int | None = None, least: int = 1, salt: str = "subset") -> DataFrame:
    """Families (family, size) of at least that many members; the first `number` of them in hash order if given."""
    kept = families.filter(F.col("size") >= least)
    return kept if number is None else kept.orderBy(F.md5(F.concat(F.lit(f"{salt}:"), F.col("family").cast("string"))), "family").limit(number)


def relevant_counts(distances: DataFrame, most: int) -> DataFrame:
    """family, relevant, results: results within that distance, and how many of them are of the family."""
    return distances.filter(F.col("distance") <= most).groupBy("family").agg(F.sum(F.col("relevant").cast("int")).alias("relevant"), F.count(F.lit(1)).alias("results"))


def roc(distances: DataFrame, spark: SparkSession, totals: DataFrame | None = None) -> DataFrame:
    """threshold 0 to 127, tpr, fpr, irr: macro-averaged over families.

    distances: family, distance, relevant (boolean), one row per search result. totals: family, all_good, all_bad, what
    could have been found; without it the results are all there is. A family that has totals and no results counts with
    rates of 0. The results meet in a histogram per family first, so the threshold table multiplies 129 rows per family
    and not the results."""
    per = distances.groupBy("family", "distance").agg(F.sum(F.col("relevant").cast("int")).alias("good"), F.sum((~F.col("relevant")).cast("int")).alias("bad"))
    steps = spark.range(128).select(F.col("id").cast("int").alias("threshold"))
    within = F.col("distance") <= F.col("threshold")
    cut = per.crossJoin(F.broadcast(steps)).groupBy("family", "threshold").agg(F.sum(F.when(within, F.col("good")).otherwise(0)).alias("good"), F.sum(F.when(within, F.col("bad")).otherwise(0)).alias("bad"))
    if totals is None:
        totals = per.groupBy("family").agg(F.sum("good").alias("all_good"), F.sum("bad").alias("all_bad"))
    every = totals.crossJoin(F.broadcast(steps))
    cut = every.join(cut, ["family", "threshold"], "left").fillna(0, ["good", "bad"])
    rate = lambda x, y: F.when(F.col(y) > 0, F.col(x) / F.col(y))
    cut = cut.select("threshold", rate("good", "all_good").alias("tpr"), rate("bad", "all_bad").alias("fpr"), F.when(F.col("good") + F.col("bad") > 0, F.col("bad") / (F.col("good") + F.col("bad"))).alias("irr"))
    return cut.groupBy("threshold").agg(F.avg("tpr").alias("tpr"), F.avg("fpr").alias("fpr"), F.avg("irr").alias("irr"))
