"""Approximate nearest neighbours (operator 5): multi-probe p-stable hashing.

Each of L tables projects unit vectors on k random directions (entries of a 2-stable, that is normal,
law; made orthogonal) and cuts the projections into cells of one width. A query visits cells around its
own in the order of the estimated probability that a neighbour at distance r falls there, until these
probabilities add up to a set success. Candidates of all tables are ranked by their exact cosine.

Equal vectors are searched as one: of each only the smallest ids can be among the nearest.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .store import Workspace, broadcast_if_small, shuffle_width

#: Rows that the neighbour distance r is estimated on, at most (smallest hash of the id).
SAMPLE_ROWS = 4096
SAMPLE_QUERIES = 256
#: Vectors of one cell that are ranked in one go, and queries that visit it; larger cells are split.
CELL_ROWS = 4096
VISIT_ROWS = 1024
#: Cells that are held at once while visits are listed.
PROBE_ROWS = 1_000_000
WIDTH = 2.0


def clean(vectors: DataFrame) -> DataFrame:
    """vec_id, v (array<double>) of the distinct rows that take part: no null id, vector or component, finite, not zero."""
    v = F.col("embedding").cast("array<double>")
    good = F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists("v", lambda x: x != 0)
    return vectors.select("vec_id", v.alias("v")).filter(F.col("vec_id").isNotNull() & F.col("v").isNotNull()).filter(good)


def _classes(rows: DataFrame, most: int, width: int) -> DataFrame:
    """v, ids: the `most` smallest ids of each distinct vector. Ranked in two steps, so that a vector with
    very many copies is spread over several tasks first."""
    salts = max(2, math.isqrt(width))
    rows = rows.withColumn("salt", F.pmod(F.xxhash64("vec_id"), F.lit(salts)))
    some = rows.withColumn("place", F.row_number().over(Window.partitionBy("v", "salt").orderBy("vec_id"))).filter(F.col("place") <= most)
    few = some.withColumn("place", F.row_number().over(Window.partitionBy("v").orderBy("vec_id"))).filter(F.col("place") <= most)
    return few.groupBy("v").agg(F.sort_array(F.collect_list("vec_id")).alias("ids"))


def _matrix(column: pa.Array) -> np.ndarray:
    flat = column.flatten().to_numpy(zero_copy_only=False)
    return flat.reshape(len(column), -1) if len(column) else np.zeros((0, 0))


def _unit(v: np.ndarray) -> np.ndarray:
    v = v / np.abs(v).max(axis=1, keepdims=True)
    return v / np.sqrt((v * v).sum(axis=1, keepdims=True))


def cosine(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Row by row, in double precision on the original vectors, always summed in the same order."""
    return (a * b).sum(axis=1) / (np.sqrt((a * a).sum(axis=1)) * np.sqrt((b * b).sum(axis=1)))


def _tables(dim: int, tables: int, k: int, seed: int) -> list[tuple[np.ndarray, np.ndarray]]:
    rng = np.random.default_rng([seed, dim])
    out = []
    for _ in range(tables):
        a = rng.normal(size=(dim, k))
        if k <= dim:
            a = np.linalg.qr(a)[0] * math.sqrt(dim)
        out.append((a, rng.uniform(0, WIDTH, k)))
    return out


_ERF = np.vectorize(math.erf, otypes=[float])


def _cells(unit: np.ndarray, a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    y = (unit @ a + b) / WIDTH
    cell = np.floor(y).astype(np.int64)
    return cell, y - cell


def _code(cell: np.ndarray) -> np.ndarray:
    """One number per cell. Two cells that bear the same one only share their candidates."""
    odd = np.random.default_rng(97).integers(0, 2**63, cell.shape[-1], dtype=np.int64) | 1
    with np.errstate(over="ignore"):
        return (cell * odd).sum(axis=-1)


def probes(unit: np.ndarray, a: np.ndarray, b: np.ndarray, r: float, success: float) -> tuple[np.ndarray, np.ndarray]:
    """(query, cell code) of the visits of one table: cells at most one step away in each projection, likeliest first
    until their probabilities reach `success`.

    Cells are put together projection by projection; what is less likely than `least` goes at once, so a query holds
    1 / least cells at most. Queries that don't reach `success` so are tried again with a smaller `least`."""
    cell, inside = _cells(unit, a, b)
    k, spread = cell.shape[1], r / WIDTH * math.sqrt(2)
    part = np.stack([(_ERF((d + 1 - inside) / spread) - _ERF((d - inside) / spread)) / 2 for d in (-1, 0, 1)], axis=2)
    out_query, out_code, todo, least = [], [], np.arange(len(cell)), 1 / 256
    while len(todo):
        again = []
        rows = max(1, int(PROBE_ROWS * least))
        for lo in range(0, len(todo), rows):
            own = todo[lo : lo + rows]
            query, likely, at = own, np.ones(len(own)), cell[own]
            for j in range(k):
                likely = likely[:, None] * part[query, j]
                i, step = np.nonzero(likely >= least if least > 1e-12 else np.ones_like(likely, bool))
                likely, query, at = likely[i, step], query[i], at[i]
                at[:, j] += step - 1
            order = np.lexsort((-likely, query))
            query, likely, at = query[order], likely[order], at[order]
            first = np.searchsorted(query, own)
            reached = np.cumsum(likely)
            reached -= np.repeat(reached[first] - likely[first], np.diff(np.append(first, len(query)))) if len(query) else 0
            total = np.bincount(np.searchsorted(own, query), weights=likely, minlength=len(own))
            enough = (total >= success) | (least <= 1e-12)
            again.append(own[~enough])
            use = enough[np.searchsorted(own, query)] & (reached - likely < success)
            out_query.append(query[use])
            out_code.append(_code(at[use]))
        todo, least = np.concatenate(again), least / 8
    if not out_query:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    return np.concatenate(out_query), np.concatenate(out_code)


def _neighbour_distance(classes: DataFrame, nearest: int) -> float:
    """Distance of unit vectors at which the nearest-th neighbour is found within a bounded sample; in the
    whole table it is nearer, so the estimate errs to more visits."""
    rows = classes.orderBy(F.xxhash64("ids"), "ids").limit(SAMPLE_ROWS).select("v").toPandas()["v"]
    by_dim: dict[int, list] = {}
    for v in rows:
        by_dim.setdefault(len(v), []).append(v)
    found = [0.7]
    for vs in by_dim.values():
        u = _unit(np.array(vs, dtype=np.float64))
        dots = u[:SAMPLE_QUERIES] @ u.T
        if len(vs) > 1:
            at = min(nearest, len(vs) - 1)
            found += np.sqrt(np.maximum(2 - 2 * -np.sort(-dots, axis=1)[:, at], 1e-6)).tolist()
    return float(np.median(found))


def _rank(queries: pa.Table, index: pa.Table, nearest: int) -> pa.Table:
    """The nearest few of one block of the index for each query that visits it, with exact scores."""
    out_q, out_v, out_s = [], [], []
    if queries.num_rows and index.num_rows:
        qv, iv = _matrix(queries["v"].combine_chunks()), _matrix(index["v"].combine_chunks())
        qid, ids = queries["query_id"].to_pylist(), index["ids"].to_pylist()
        iu = _unit(iv)
        for lo in range(0, len(qv), 1024):
            near = _unit(qv[lo : lo + 1024]) @ iu.T
            m = min(nearest + 1, near.shape[1])
            least = -np.partition(-near, m - 1, axis=1)[:, m - 1 : m] - 1e-9
            for i, j in zip(*np.nonzero(near >= least), strict=True):
                out_q.append(lo + i)
                out_v.append(j)
        q, v = np.array(out_q, np.int64), np.array(out_v, np.int64)
        scores = cosine(qv[q], iv[v])
        per: dict[int, list] = {}
        for a, b, s in zip(q.tolist(), v.tolist(), scores.tolist(), strict=True):
            per.setdefault(a, []).extend((-s, i) for i in ids[b] if i != qid[a])
        best = [(qid[a], i, -s) for a, found in per.items() for s, i in sorted(found)[:nearest]]
        out_q, out_v, out_s = ([b[c] for b in best] for c in range(3))
    return pa.table({"query_id": pa.array(out_q, pa.int64()), "vec_id": pa.array(out_v, pa.int64()), "score": pa.array(out_s, pa.float64())})


def nearest_neighbours(vectors: DataFrame, every: int = 50, nearest: int = 5, tables: int = 4, success: float = 0.6, seed: int = 5) -> DataFrame:
    """query_id, rank, vec_id, score: the `nearest` rows found for each query, a row whose vec_id is divisible
    by `every`; all rows but the query's own are candidates. Largest cosine first, ties to the smaller vec_id.

    Vectors null, zero, or with null or non-finite components take no part; neither does a null vec_id.
    Only vectors of one length are compared. Repeated rows count once. A query for which the visited cells
    hold fewer than `nearest` candidates is ranked against all rows, in blocks. Empty tables give no rows.
    """
    spark = vectors.sparkSession
    space, width = Workspace(spark, "neighbours", vectors), shuffle_width(spark)
    rows = clean(vectors.select("vec_id", "embedding")).select(F.col("vec_id").cast("bigint").alias("vec_id"), "v")
    classes = space.keep(_classes(rows, nearest + 1, width), "classes")
    n = classes.count()
    # Projections grow with the logarithm of the vectors, so that a cell's size doesn't grow with them.
    k = max(2, round(math.log(max(n, 200) / 200) / 1.22))
    r = _neighbour_distance(classes, nearest)
    queries = space.keep(rows.filter(F.col("vec_id") % every == 0).distinct().select(F.col("vec_id").alias("query_id"), "v"), "queries", small=True)

    def place(kind):
        def run(batches):
            for batch in batches:
                size = np.array([len(x) for x in batch.column("v")]) if batch.num_rows else np.zeros(0, int)
                for dim in np.unique(size):
                    part = batch.take(pa.array(np.flatnonzero(size == dim)))
                    unit = _unit(_matrix(part.column("v")))
                    for t, (a, b) in enumerate(_tables(int(dim), tables, k, seed)):
                        if kind == "index":
                            row, cell = np.arange(len(unit)), _code(_cells(unit, a, b)[0])
                        else:
                            row, cell = probes(unit, a, b, r, success)
                        m = len(row)
                        taken = (part if kind == "index" else part.select(["query_id"])).take(pa.array(row))
                        yield pa.RecordBatch.from_arrays([pa.array(np.full(m, dim, np.int32)), pa.array(np.full(m, t, np.int32)), pa.array(cell), *taken.columns], names=["dim", "tab", "cell", *taken.schema.names])

        return run

    index = space.keep(classes.select("ids", "v").mapInArrow(place("index"), "dim int, tab int, cell bigint, ids array<bigint>, v array<double>"), "index")
    visits = queries.mapInArrow(place("visits"), "dim int, tab int, cell bigint, query_id bigint")
    cell = ["dim", "tab", "cell"]
    visits = space.keep(visits, "visits")
    # Large cells are cut into parts of their vectors times parts of the queries that visit them.
    held = index.groupBy(*cell).agg(F.ceil(F.count(F.lit(1)) / CELL_ROWS).alias("parts"))
    asked = visits.groupBy(*cell).agg(F.ceil(F.count(F.lit(1)) / VISIT_ROWS).alias("turns"))
    large = space.keep(held.join(asked, cell).filter("parts > 1 or turns > 1"), "large", small=True)
    few = broadcast_if_small(large)
    parts, turns = F.coalesce("parts", F.lit(1)), F.coalesce("turns", F.lit(1))
    each = lambda n: F.explode(F.sequence(F.lit(0).cast("bigint"), n - 1))
    index = index.join(few, cell, "left").withColumn("part", F.pmod(F.xxhash64("ids"), parts)).withColumn("turn", each(turns)).drop("parts", "turns")
    visits = visits.join(few, cell, "left").withColumn("turn", F.pmod(F.xxhash64("query_id"), turns)).withColumn("part", each(parts)).drop("parts", "turns")
    visits = visits.join(queries.hint("merge"), "query_id")
    schema = "query_id bigint, vec_id bigint, score double"
    found = visits.groupBy(*cell, "part", "turn").cogroup(index.groupBy(*cell, "part", "turn")).applyInArrow(lambda a, b: _rank(a, b, nearest), schema)
    found = space.keep(found.distinct(), "found")

    # Exactly, in blocks, for queries that found too few.
    short = queries.join(found.groupBy("query_id").count().filter(F.col("count") >= nearest), "query_id", "left_anti")
    short = space.keep(short, "short", small=True)
    if short.limit(1).count():
        blocks = max(1, math.ceil(n / CELL_ROWS))
        every_row = classes.select(F.size("v").alias("dim"), F.pmod(F.xxhash64("ids"), F.lit(blocks)).alias("part"), "ids", "v")
        everywhere = short.select(F.size("v").alias("dim"), F.explode(F.sequence(F.lit(0).cast("bigint"), F.lit(blocks - 1).cast("bigint"))).alias("part"), "query_id", "v")
        whole = everywhere.groupBy("dim", "part").cogroup(every_row.groupBy("dim", "part")).applyInArrow(lambda a, b: _rank(a, b, nearest), schema)
        found = found.unionByName(whole).distinct()
    best = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    return found.withColumn("rank", best).filter(F.col("rank") <= nearest).select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")
