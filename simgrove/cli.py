"""Command line: one command per tool. Graphs come as JSON exports; native binaries aren't disassembled here.

python -m simgrove.cli COMMAND --help
"""

from __future__ import annotations

import argparse

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .functions.bits import hex64, hex128, parse_feature_hash
from .operators import evaluate, graph, graph_features, search, train
from .operators.index import SimHashIndex
from .sources import readers, writers


def _graphs(spark: SparkSession, a) -> DataFrame:
    """graph_id, name, nodes, edges, file_id, address, branching of an executable's JSON, above the least size."""
    read = readers.read_executable(spark, a.input).select(F.col("position").cast("bigint").alias("graph_id"), "graph.*")
    file = F.lit(a.file_id) if getattr(a, "file_id", None) else F.substring(F.sha2(F.lit(a.input), 256), 1, 16)
    flat = read.select("graph_id", F.explode("nodes").alias("n")).select("graph_id", F.col("n.address").cast("decimal(20,0)").cast("bigint").alias("node"))
    edges = _edges(read)
    known = read.withColumn("file_id", F.conv(file, 16, -10).cast("bigint")).join(graph.function_addresses(flat), "graph_id")
    sized = known.join(graph.branching_nodes(edges), "graph_id", "left").fillna(0, ["branching"])
    if getattr(a, "no_shared_blocks", False):
        blocks = flat.select(F.lit(0).alias("file_id"), F.col("node").alias("address"), "graph_id")
        sized = sized.join(graph.without_shared_blocks(blocks), "graph_id")
    if getattr(a, "function_address", None):
        sized = sized.filter(F.col("address") == int(a.function_address, 16))
    return sized.filter(F.col("branching") > getattr(a, "minimum_function_size", -1))


def _edges(read: DataFrame) -> DataFrame:
    e = read.select("graph_id", F.posexplode("edges").alias("ord", "e"))
    return e.select("graph_id", F.col("e.source").cast("bigint").alias("src"), F.col("e.destination").cast("bigint").alias("dst"), "ord")


def _weights(spark, a) -> dict[int, float] | None:
    if not getattr(a, "weights", None):
        return None
    return {r.feature_a & graph_features.R.MASK: r.weight for r in readers.read_weights(spark, a.weights).collect()}


def _use(a) -> tuple[str, ...]:
    return tuple(k for k, off in (("graphlet", a.disable_graphs), ("mnemonic", a.disable_instructions), ("immediate", a.disable_immediates)) if not off)


def _hashed(spark, a, use=graph_features.ALL) -> DataFrame:
    graphs = _graphs(spark, a)
    return graphs.drop("nodes", "edges").join(graph_features.graph_simhash(graphs.select("graph_id", "nodes", "edges"), _weights(spark, a), use), "graph_id")


def _show(lines: DataFrame, order: str = "value") -> None:
    for row in lines.orderBy(order).toLocalIterator():
        print(row["value"])


def disassemble(spark, a):
    nodes = _graphs(spark, a).select("graph_id", F.explode("nodes").alias("n")).select("graph_id", F.col("n.address").cast("bigint").alias("address"), "n.instructions")
    _show(writers.disassembly(nodes), "graph_id")


def dotgraphs(spark, a):
    writers.write_text(writers.dot_lines(_edges(_graphs(spark, a))), a.output)


def graphhashes(spark, a):
    found = graph_features.whole_graph_hashes(_graphs(spark, a).select("graph_id", "nodes", "edges"))
    _show(found.select(F.concat_ws(" ", hex64("hash"), hex64("address")).alias("value")))


def addfunctionstoindex(spark, a):
    print(SimHashIndex(spark, a.index, buckets=a.buckets).add(_hashed(spark, a).select("file_id", "address", "hash_a", "hash_b")), "functions added")


def createfunctionindex(spark, a):
    SimHashIndex(spark, a.index, create=True, buckets=a.buckets)


def functionfingerprints(spark, a):
    if not a.verbose:
        return _show(writers.fingerprint_lines(_hashed(spark, a, _use(a))))
    graphs = _graphs(spark, a)
    features = graph_features.graph_features(graphs.select("graph_id", "nodes", "edges"), _use(a))
    return _show(writers.feature_lines(features.join(graphs.select("graph_id", "file_id", "address"), "graph_id")))


def matchfunctionsfromindex(spark, a):
    index = SimHashIndex(spark, a.index, buckets=a.buckets)
    hashed = _hashed(spark, a)
    asked = hashed.select(F.col("graph_id").alias("query_id"), F.col("hash_a").alias("qa"), F.col("hash_b").alias("qb"))
    found = search.at_least(search.search_buckets(asked, index.functions, a.max_matches, index.permutations, entries=index.entries), a.minimum_percentage)
    metadata = readers.read_metadata(spark, a.metadata) if a.metadata else spark.createDataFrame([], "file_id bigint, address bigint, file_name string, function_name string, vulnerable boolean")
    named = search.with_metadata(found, index.functions, metadata).join(hashed.select(F.col("graph_id").alias("query_id"), F.col("file_id").alias("f"), F.col("address").alias("a"), "branching"), "query_id")
    _show(named.select("query_id", "rank", F.concat_ws(" ", hex64("f"), hex64("a"), F.col("branching").cast("string"), F.col("similarity").cast("string"), hex64("file_id"), hex64("address"), "file_name", "function_name").alias("value")).orderBy("query_id", "rank"), "query_id")


def dumpfunctionindexinfo(spark, a):
    SimHashIndex(spark, a.index, buckets=a.buckets).stats().show(truncate=False)


def growfunctionindex(spark, a):
    """Tables grow by themselves: nothing to do but to see that the index is there."""
    SimHashIndex(spark, a.index, buckets=a.buckets)


def dumpfunctionindex(spark, a):
    _show(writers.index_dump_lines(SimHashIndex(spark, a.index, buckets=a.buckets).dump(a.verbose)))


def queryindexforhash(spark, a):
    index = SimHashIndex(spark, a.index, buckets=a.buckets)
    words = parse_feature_hash(F.lit(a.hash))
    asked = spark.range(1).select(F.col("id").alias("query_id"), words[0].alias("qa"), words[1].alias("qb"))
    found = search.search_buckets(asked, index.functions, a.max_matches, index.permutations, entries=index.entries).join(index.functions, "function_id")
    _show(found.select("rank", F.concat_ws(" ", F.col("similarity").cast("string"), hex64("file_id"), hex64("address"), hex128("hash_a", "hash_b")).alias("value")), "rank")


def trainsimhashweights(spark, a):
    features, attract, repulse = readers.load_training_set(spark, a.data)
    save = (lambda step, w: None) if not a.snapshots else (lambda step, w: w.tofile(f"{a.snapshots}/{step}.snapshot"))
    learnt = train.train(features, attract, repulse, a.train_steps, a.solver == "lbfgs", snapshot=save)
    writers.write_text(writers.weight_lines(learnt), a.weights)


def dumpsinglefunctionfeatures(spark, a):
    features = graph_features.graph_features(_graphs(spark, a).select("graph_id", "nodes", "edges"))
    _show(features.select("pos", hex128("feature_a", "feature_b").alias("value")), "pos")


def evalsimhashweights(spark, a):
    from .operators.simhash import simhash128, with_weights

    features, attract, repulse = readers.load_training_set(spark, a.data)
    pairs = attract.withColumn("attract", F.lit(True)).unionByName(repulse.withColumn("attract", F.lit(False)))
    for name, weights in (("untrained", None), ("trained", readers.read_weights(spark, a.weights))):
        hashes = simhash128(with_weights(features, weights, typed=False))
        found = evaluate.pair_distances(pairs, hashes)
        print(name)
        _show(writers.histogram_lines(evaluate.histogram(found)))
        evaluate.difference_of_means(found).show()


def stemsymbol(spark, a):
    from .functions.symbols import stem_symbol

    _show(spark.createDataFrame([(a.symbol,)], "s string").select(stem_symbol("s").alias("value")))


def visualizeflowgraphs(spark, a):
    """The graphs' JSON, for a page to draw."""
    _show(_graphs(spark, a).select(F.to_json(F.struct("edges", "name", "nodes")).alias("value")))


# command: (function, options). An option: name, default; a default of False makes a switch, None a required value.
_INDEX, _INPUT = [("index", None), ("buckets", 50)], [("input", None), ("file_id", ""), ("function_address", ""), ("no_shared_blocks", False)]
_SIZE = [("minimum_function_size", 5), ("weights", "")]
COMMANDS = {
    "disassemble": (disassemble, _INPUT),
    "dotgraphs": (dotgraphs, [*_INPUT, ("output", None)]),
    "graphhashes": (graphhashes, _INPUT),
    "addfunctionstoindex": (addfunctionstoindex, [*_INDEX, *_INPUT, *_SIZE]),
    "addsinglefunctiontoindex": (addfunctionstoindex, [*_INDEX, *_INPUT, ("weights", "")]),
    "createfunctionindex": (createfunctionindex, _INDEX),
    "functionfingerprints": (functionfingerprints, [*_INPUT, *_SIZE, ("disable_graphs", False), ("disable_instructions", False), ("disable_immediates", False), ("verbose", False)]),
    "matchfunctionsfromindex": (matchfunctionsfromindex, [*_INDEX, *_INPUT, *_SIZE, ("max_matches", 5), ("minimum_percentage", 0.8), ("metadata", "")]),
    "dumpfunctionindexinfo": (dumpfunctionindexinfo, _INDEX),
    "growfunctionindex": (growfunctionindex, [*_INDEX, ("size_to_grow", 0)]),
    "dumpfunctionindex": (dumpfunctionindex, [*_INDEX, ("verbose", False)]),
    "trainsimhashweights": (trainsimhashweights, [("data", None), ("weights", None), ("train_steps", 500), ("solver", "lbfgs"), ("snapshots", "")]),
    "dumpsinglefunctionfeatures": (dumpsinglefunctionfeatures, _INPUT),
    "evalsimhashweights": (evalsimhashweights, [("data", None), ("weights", None)]),
    "stemsymbol": (stemsymbol, [("symbol", None)]),
    "visualizeflowgraphs": (visualizeflowgraphs, _INPUT),
    "queryindexforhash": (queryindexforhash, [*_INDEX, ("hash", None), ("max_matches", 5)]),
}


def main(arguments: list[str] | None = None, spark: SparkSession | None = None) -> None:
    parser = argparse.ArgumentParser(prog="simgrove")
    commands = parser.add_subparsers(dest="command", required=True)
    for name, (_, options) in COMMANDS.items():
        command = commands.add_parser(name)
        for option, default in options:
            if default is False:
                command.add_argument(f"--{option}", action="store_true")
            else:
                command.add_argument(f"--{option}", default=default, required=default is None, type=str if default in (None, "") else type(default))
    a = parser.parse_args(arguments)
    COMMANDS[a.command][0](spark or SparkSession.builder.appName("simgrove").getOrCreate(), a)


if __name__ == "__main__":
    main()
