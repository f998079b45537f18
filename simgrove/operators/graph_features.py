"""Bit-exact features and hashes of functions given as graph rows: Arrow functions around the uint64 family."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import reference_hash as R
from ..functions.immediates import extract_immediates, is_useful

FEATURE_ROWS = "graph_id bigint, feature_type string, pos int, occurrence int, feature_a bigint, feature_b bigint"
ALL = ("graphlet", "mnemonic", "immediate")


def _signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def prepared(graphs: DataFrame) -> DataFrame:
    """graph_id, nodes (addresses), edges, mnemonics (in address order), constants: what the hash family needs.

    graphs: graph_id and the GRAPH schema's nodes and edges. Constants are found by SQL functions on exploded
    operands (all but each block's last instruction) and put in order again, one group per graph."""
    blocks = graphs.select("graph_id", F.explode("nodes").alias("n")).select("graph_id", "n.address", "n.instructions")
    body = F.slice("instructions", 1, F.greatest(F.size("instructions") - 1, F.lit(0)))
    steps = blocks.select("graph_id", "address", F.posexplode(body).alias("pos", "i"))
    operands = steps.select("graph_id", "address", "pos", F.posexplode("i.operands").alias("part", "operand"))
    values = operands.select("graph_id", "address", "pos", "part", F.posexplode(extract_immediates("operand")).alias("at", "value")).filter(is_useful("value"))
    ordered = F.array_sort(F.collect_list(F.struct("address", "pos", "part", "at", "value")))
    constants = values.groupBy("graph_id").agg(F.transform(ordered, lambda x: x["value"]).alias("constants"))
    listed = F.array_sort(F.transform("nodes", lambda n: F.struct(n["address"].alias("address"), F.transform(F.coalesce(n["instructions"], F.array()), lambda i: i["mnemonic"]).alias("m"))))
    flat = graphs.select("graph_id", "edges", listed.alias("nodes"))
    return flat.join(constants, "graph_id", "left").select(
        "graph_id",
        F.transform("nodes", lambda n: _word(n["address"])).alias("nodes"),
        F.transform("edges", lambda e: F.struct(_word(e["source"]).alias("src"), _word(e["destination"]).alias("dst"))).alias("edges"),
        F.flatten(F.transform("nodes", lambda n: n["m"])).alias("mnemonics"),
        F.coalesce("constants", F.array().cast("array<bigint>")).alias("constants"),
    )


def _word(address: Column) -> Column:
    """An unsigned address as a bigint with the same bits."""
    high = F.lit(str(1 << 63)).cast("decimal(20,0)")
    return F.when(address >= high, (address - high - high).cast("bigint")).otherwise(address.cast("bigint"))


def _features(row, use):
    mask = R.MASK
    graph = R.Graph([n & mask for n in row["nodes"]], [(e["src"] & mask, e["dst"] & mask) for e in row["edges"]])
    return R.function_features(graph, row["mnemonics"] or [], [c & mask for c in row["constants"] or []], use)


def graph_features(graphs: DataFrame, use: tuple[str, ...] = ALL) -> DataFrame:
    """FEATURE_ROWS of each graph, in order."""

    def run(batches):
        for batch in batches:
            rows = [(r["graph_id"], kind, pos, n, _signed(a), _signed(b)) for r in batch.to_pylist() for pos, (kind, n, a, b) in enumerate(_features(r, use))]
            names = ["graph_id", "feature_type", "pos", "occurrence", "feature_a", "feature_b"]
            kinds = [pa.int64(), pa.string(), pa.int32(), pa.int32(), pa.int64(), pa.int64()]
            columns = list(zip(*rows, strict=True)) or [()] * 6
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names=names)

    return prepared(graphs).mapInArrow(run, FEATURE_ROWS)


def graph_simhash(graphs: DataFrame, weights: dict[int, float] | None = None, use: tuple[str, ...] = ALL, defaults: dict[str, float] = R.DEFAULT_WEIGHTS) -> DataFrame:
    """graph_id, hash_a, hash_b: single-precision sums in feature order, bit for bit. weights: feature word 0 to weight."""

    def run(batches):
        for batch in batches:
            found = [(r["graph_id"], *map(_signed, R.simhash(_features(r, use), weights, defaults))) for r in batch.to_pylist()]
            columns = list(zip(*found, strict=True)) or [()] * 3
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], names=["graph_id", "hash_a", "hash_b"])

    return prepared(graphs).mapInArrow(run, "graph_id bigint, hash_a bigint, hash_b bigint")


def whole_graph_hashes(graphs: DataFrame) -> DataFrame:
    """graph_id, address (least node), hash: the structural hash of each whole graph from its entry."""

    def run(batches):
        for batch in batches:
            rows = []
            for r in batch.to_pylist():
                graph = R.Graph([n & R.MASK for n in r["nodes"]], [(e["src"] & R.MASK, e["dst"] & R.MASK) for e in r["edges"]])
                if graph.nodes:
                    rows.append((r["graph_id"], _signed(graph.nodes[0]), _signed(R.structural_hash(graph.tuples(graph.nodes[0]), R.SEEDS))))
            columns = list(zip(*rows, strict=True)) or [()] * 3
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], names=["graph_id", "address", "hash"])

    return prepared(graphs).mapInArrow(run, "graph_id bigint, address bigint, hash bigint")
