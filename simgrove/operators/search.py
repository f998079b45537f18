"""Nearest hashes: exactly, by buckets, and the reports built on them."""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .index import explode_buckets

#: Functions and queries that are compared at once.
BLOCK = 16_384
#: Exact search: functions and queries of a block. Of each block a query keeps its n nearest, so functions are many.
FUNCTIONS, QUERIES = 65_536, 8_192
TURN, STRIP = 32, 4_096
FOUND = "query_id {kind}, function_id {other}, distance int"


def _nearest(queries: pa.Table, functions: pa.Table, n: int, distinct_ids: bool) -> pa.Table:
    """The n nearest functions of a block for each query, by distance and then id.

    Functions go by in order of their ids, in strips that grow, so a later one only counts if it is nearer than the n-th
    found so far; few are, and only these are sorted. Distances stay bytes."""
    out_q, out_f, out_d = [], [], []
    order = np.argsort(functions["function_id"].to_numpy(), kind="stable")
    ids = functions["function_id"].to_numpy()[order]
    fa, fb = (functions[c].to_numpy()[order].view(np.uint64) for c in ("hash_a", "hash_b"))
    names, qa, qb = queries["query_id"].to_numpy(), *(queries[c].to_numpy().view(np.uint64) for c in ("qa", "qb"))
    # A key of distance and place is unique, so the n least keys are the n nearest.
    most, none = min(n, len(ids)), 129 * len(ids)
    strip = STRIP if 8 * most <= STRIP else max(1, len(ids))
    words, ones, more = (np.empty(TURN * strip, kind) for kind in (np.uint64, np.uint8, np.uint8))
    for lo in range(0, len(names) if most > 0 else 0, TURN):
        q = slice(lo, lo + TURN)
        rows = len(names[q])
        best, far = np.full((rows, most), none), np.full(rows, 129, np.uint8)
        start, wide = 0, min(strip, 16 * most)
        while start < len(ids):
            f = slice(start, start + wide)
            x, distance, b = (y[: rows * len(ids[f])].reshape(rows, -1) for y in (words, ones, more))
            np.bitwise_count(np.bitwise_xor(qa[q, None], fa[f], out=x), out=distance)
            distance += np.bitwise_count(np.bitwise_xor(qb[q, None], fb[f], out=x), out=b)
            if distinct_ids:
                distance[names[q, None] == ids[f]] = 129
            near = np.flatnonzero(distance < far[:, None])
            row, at = np.divmod(near, distance.shape[1])
            at += start
            start, wide = start + wide, min(strip, 2 * wide)
            if not len(row):
                continue
            # The least keys of each row that found some, with those it had.
            open_, count = np.unique(row, return_counts=True)
            width = int(count.max())
            keys = np.full((len(open_), most + width), none)
            keys[:, :most] = best[open_]
            first = np.cumsum(count) - count
            keys[np.repeat(np.arange(len(open_)), count), most + np.arange(len(row)) - np.repeat(first, count)] = distance.ravel()[near].astype(np.int64) * len(ids) + at
            best[open_] = np.partition(keys, most - 1, axis=1)[:, :most]
            far[open_] = best[open_].max(axis=1) // len(ids)
        row, column = np.nonzero(best < none)
        found = best[row, column]
        out_q.append(names[q][row])
        out_f.append(ids[found % len(ids)])
        out_d.append((found // len(ids)).astype(np.int32))
    columns = [np.concatenate(x) if x else np.zeros(0, np.int64) for x in (out_q, out_f, out_d)]
    return pa.table({"query_id": columns[0], "function_id": columns[1], "distance": columns[2].astype(np.int32)})


def _nearest_in_buckets(queries: pa.Table, functions: pa.Table, n: int, distinct_ids: bool) -> pa.Table:
    """As _nearest, each query among the functions of its own bucket."""
    queries, functions = queries.sort_by("bucket"), functions.sort_by("bucket")
    asked, held = queries["bucket"].to_numpy(), functions["bucket"].to_numpy()
    out = [_nearest(queries.slice(0, 0), functions, n, distinct_ids)]
    for bucket in np.intersect1d(asked, held).tolist():
        (q, q_end), (f, f_end) = (np.searchsorted(x, [bucket, bucket + 1]).tolist() for x in (asked, held))
        out.append(_nearest(queries.slice(q, q_end - q), functions.slice(f, f_end - f), n, distinct_ids))
    return pa.concat_tables(out)


def _top(found: DataFrame, n: int) -> DataFrame:
    """The n nearest of each query, by distance and then id; Spark limits each task's groups before the shuffle."""
    w = Window.partitionBy("query_id").orderBy("distance", "function_id")
    best = found.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= n)
    return best.withColumn("similarity", 128 - F.col("distance"))


def _cogrouped(queries: DataFrame, functions: DataFrame, keys: list[str], n: int, distinct_ids: bool) -> DataFrame:
    schema = FOUND.format(kind=queries.schema["query_id"].dataType.simpleString(), other=functions.schema["function_id"].dataType.simpleString())
    rank = _nearest_in_buckets if "bucket" in queries.columns else _nearest
    return queries.groupBy(*keys).cogroup(functions.groupBy(*keys)).applyInArrow(lambda q, f: rank(q, f, n, distinct_ids), schema)


def _parts(df: DataFrame, name: str, parts: Column) -> DataFrame:
    return df.withColumn(name, F.pmod(F.xxhash64(*df.columns), parts))


def _each(df: DataFrame, name: str, parts: Column) -> DataFrame:
    return df.withColumn(name, F.explode(F.sequence(F.lit(0).cast("bigint"), parts - 1)))


def search_exact(queries: DataFrame, functions: DataFrame, n: int = 5, distinct_ids: bool = False) -> DataFrame:
    """query_id, function_id, distance, similarity, rank. queries: query_id, qa, qb; functions: function_id, hash_a, hash_b.

    A stated set of queries against all functions, in blocks of QUERIES by FUNCTIONS: of each block only the n nearest
    of a query leave its task. Both tables are counted, so they should be files or kept."""
    queries, functions = queries.select("query_id", "qa", "qb"), functions.select("function_id", "hash_a", "hash_b")
    turns, parts = (F.lit(max(1, math.ceil(df.count() / size))).cast("bigint") for df, size in ((queries, QUERIES), (functions, FUNCTIONS)))
    asked = _each(_parts(queries, "turn", turns), "part", parts)
    held = _each(_parts(functions, "part", parts), "turn", turns)
    return _top(_cogrouped(asked, held, ["part", "turn"], n, distinct_ids), n)


def search_buckets(queries: DataFrame, functions: DataFrame, n: int = 5, permutations: int = 28, distinct_ids: bool = False, entries: DataFrame | None = None) -> DataFrame:
    """As search_exact, among functions that share a bucket with the query under one of the permutations.

    Only entries of buckets that a query falls into are shuffled (the list of these has 256 rows a permutation at most,
    and is broadcast). A task ranks a zone, some neighbouring buckets of a permutation, bucket by bucket, and only the
    n nearest of a query leave it, so no candidate pair is shuffled. Zones are as many as BLOCK functions a zone ask
    for, up to one for each bucket; those of more than BLOCK functions or queries are cut into parts. functions is
    counted and read twice, so it should be a file or kept."""
    if entries is None:
        entries = explode_buckets(functions.select("function_id", "hash_a", "hash_b"), permutations)
    asked = explode_buckets(queries.select("query_id", "qa", "qb"), permutations, "qa", "qb")
    zones = min(256, max(1, math.ceil(functions.count() / BLOCK)))
    zone = F.floor(F.col("bucket") * zones / 256).alias("zone")
    asked = asked.select("*", zone)
    held = entries.select("function_id", "hash_a", "hash_b", "perm", "bucket", zone).join(F.broadcast(asked.select("perm", "bucket").distinct()), ["perm", "bucket"], "left_semi")
    keys = ["perm", "zone"]
    turns = asked.groupBy(*keys).agg(F.ceil(F.count(F.lit(1)) / BLOCK).alias("turns"))
    sizes = F.broadcast(held.groupBy(*keys).agg(F.ceil(F.count(F.lit(1)) / BLOCK).alias("parts")).join(turns, keys))
    asked = _each(_parts(asked.join(sizes, keys), "turn", F.col("turns")), "part", F.col("parts"))
    held = _each(_parts(held.join(sizes, keys), "part", F.col("parts")), "turn", F.col("turns"))
    block = [*keys, "part", "turn"]
    found = _cogrouped(asked.select("query_id", "qa", "qb", "bucket", *block), held.select("function_id", "hash_a", "hash_b", "bucket", *block), block, n, distinct_ids)
    return _top(found.distinct(), n)


def at_least(found: DataFrame, share: float = 0.8) -> DataFrame:
    """Matches whose similarity is above share of all 128 bits."""
    return found.filter(F.col("similarity") > share * 128)


def with_metadata(found: DataFrame, functions: DataFrame, metadata: DataFrame) -> DataFrame:
    """Adds the matched function's key, file name, function name and vulnerability where known.

    metadata: file_id, address, file_name, function_name, vulnerable."""
    named = found.join(functions.select("function_id", "file_id", "address"), "function_id")
    files = metadata.groupBy("file_id").agg(F.min("file_name").alias("file_name"))
    names = metadata.select("file_id", "address", "function_name", "vulnerable")
    return named.join(files, "file_id", "left").join(names, ["file_id", "address"], "left")


def report_scale(similarity) -> Column:
    """0 to 1 for matches of 64 to 128 equal bits."""
    return F.greatest(F.col(similarity) / 128 - 0.5, F.lit(0.0)) * 2


def odds_table(spark: SparkSession, indexed: int) -> DataFrame:
    """equal_bits 0 to 128, odds that a random hash of an index of that size agrees so far (Infinity where erf is 1)."""
    rows = []
    for c in range(129):
        p = 1 - math.erf(abs(c - 64) / math.sqrt(32) / math.sqrt(2))
        rows.append((c, 1 / p / indexed if p > 0 else float("inf")))
    return spark.createDataFrame(rows, "equal_bits int, odds double").coalesce(1)


def consecutive_matches(best: DataFrame, order: str = "position", above: int = 104) -> DataFrame:
    """run, first, last, length of maximal runs of neighbours (by order within key) whose best match lies above."""
    w = Window.partitionBy("key").orderBy(order)
    numbered = best.withColumn("_i", F.row_number().over(w)).filter(F.col("similarity") > above)
    grouped = numbered.withColumn("run", F.col("_i") - F.row_number().over(w))
    return grouped.groupBy("key", "run").agg(F.min(order).alias("first"), F.max(order).alias("last"), F.count(F.lit(1)).alias("length")).drop("run")
