"""Relational operators on graphs: edges(graph_id, src, dst, ord), nodes(graph_id, node)."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def nodes_of(edges: DataFrame, nodes: DataFrame | None = None) -> DataFrame:
    """All nodes: both ends of every edge, and those given."""
    ends = edges.select("graph_id", F.explode(F.array("src", "dst")).alias("node"))
    return (ends if nodes is None else ends.unionByName(nodes.select("graph_id", "node"))).distinct()


def out_edges(edges: DataFrame, node) -> DataFrame:
    return edges.filter(F.col("src") == node)


def in_edges(edges: DataFrame, node) -> DataFrame:
    return edges.filter(F.col("dst") == node)


def without_calls(edges: DataFrame) -> DataFrame:
    """Edges of the flow inside a function: no call and no return edges."""
    return edges.filter(~F.col("type").isin("CALL", "RET"))


def degrees(edges: DataFrame) -> DataFrame:
    """graph_id, node, out_degree, in_degree; repeated edges count."""
    ends = edges.select("graph_id", F.explode(F.array(F.struct(F.col("src").alias("node"), F.lit(1).alias("o"), F.lit(0).alias("i")), F.struct(F.col("dst").alias("node"), F.lit(0).alias("o"), F.lit(1).alias("i")))).alias("e"))
    return ends.groupBy("graph_id", "e.node").agg(F.sum("e.o").alias("out_degree"), F.sum("e.i").alias("in_degree"))


def branching_nodes(edges: DataFrame) -> DataFrame:
    """graph_id, branching: number of nodes with more than one outgoing edge (0 is listed, too)."""
    return degrees(edges).groupBy("graph_id").agg(F.sum((F.col("out_degree") > 1).cast("int")).alias("branching"))


def both_ways(edges: DataFrame) -> DataFrame:
    return edges.select("graph_id", "src", "dst").unionByName(edges.select("graph_id", F.col("dst").alias("src"), F.col("src").alias("dst")))


def hops(edges: DataFrame, starts: DataFrame, most: int) -> DataFrame:
    """graph_id, start, node, hop: distance from each start (graph_id, start) along the edges, up to most.

    One join per hop; nodes that were reached before go at once, so cycles don't multiply rows. Each hop
    reads all before it, so the plan doubles: for a few hops, bfs_order for more."""
    if most > 4:
        raise ValueError("more than four hops: use bfs_order")
    found = starts.select("graph_id", "start", F.col("start").alias("node"), F.lit(0).alias("hop"))
    step = edges.select("graph_id", F.col("src").alias("node"), F.col("dst").alias("next")).distinct()
    front = found
    for hop in range(1, most + 1):
        reached = front.join(step, ["graph_id", "node"]).select("graph_id", "start", F.col("next").alias("node")).distinct()
        front = reached.join(found, ["graph_id", "start", "node"], "left_anti").withColumn("hop", F.lit(hop))
        found = found.unionByName(front)
    return found


def bfs_order(edges: DataFrame, starts: DataFrame) -> DataFrame:
    """Distance of each node of a graph from each of its starts, -1 for nodes that aren't reached.

    A graph's edges meet in one array (a function's graph is small), and the walk is a fold over it, with as many
    steps as the graph has nodes: no path without a cycle is longer."""
    per = edges.select("graph_id", "src", "dst").distinct().groupBy("graph_id").agg(F.collect_list(F.struct("src", "dst")).alias("edges"))

    def walk(e):
        begin = F.struct(F.map_from_arrays(F.array("start"), F.array(F.lit(0))).alias("seen"), F.array("start").alias("front"))

        def step(state, hop):
            fresh = F.array_distinct(F.transform(F.filter(e, lambda x: F.array_contains(state["front"], x["src"]) & ~F.map_contains_key(state["seen"], x["dst"])), lambda x: x["dst"]))
            return F.struct(F.map_concat(state["seen"], F.map_from_arrays(fresh, F.transform(fresh, lambda _: hop))).alias("seen"), fresh.alias("front"))

        return F.aggregate(F.sequence(F.lit(1), F.size(F.array_distinct(F.transform(e, lambda x: x["src"])))), begin, step)["seen"]

    seen = per.join(starts, "graph_id").withColumn("seen", walk(F.col("edges")))
    every = F.array_distinct(F.concat(F.transform("edges", lambda x: x["src"]), F.transform("edges", lambda x: x["dst"]), F.array("start")))
    listed = seen.select("graph_id", "start", F.explode(every).alias("node"), "seen")
    return listed.select("graph_id", "start", "node", F.coalesce(F.try_element_at("seen", F.col("node")), F.lit(-1)).alias("hop"))


def balls(edges: DataFrame, radius: int = 3, most: int = 30, nodes: DataFrame | None = None) -> DataFrame:
    """graph_id, radius, center, node for each node within 1, ..., radius edges (either way) of each center;
    balls with more than most nodes are left out."""
    starts = nodes_of(edges, nodes).select("graph_id", F.col("node").alias("start"))
    near = hops(both_ways(edges), starts, radius)
    at = near.select("graph_id", F.col("start").alias("center"), "node", F.explode(F.sequence(F.greatest("hop", F.lit(1)), F.lit(radius))).alias("radius"))
    sized = at.groupBy("graph_id", "radius", "center").agg(F.count(F.lit(1)).alias("size")).filter(F.col("size") <= most)
    return at.join(sized, ["graph_id", "radius", "center"])


def induced_edges(found: DataFrame, edges: DataFrame) -> DataFrame:
    """graph_id, radius, center, src, dst of the edges that lie inside each ball of balls()."""
    ends = [found.select("graph_id", "radius", "center", F.col("node").alias(c)) for c in ("src", "dst")]
    return edges.select("graph_id", "src", "dst").join(ends[0], ["graph_id", "src"]).join(ends[1], ["graph_id", "radius", "center", "dst"])


def native_structure(edges: DataFrame) -> DataFrame:
    """graph_id, structure: MD5 over the sorted (out-degree, in-degree) pairs of all edges; the native graph hash."""
    d = degrees(edges)
    ends = edges.join(d.select("graph_id", F.col("node").alias("src"), F.concat_ws(",", "out_degree", "in_degree").alias("s")), ["graph_id", "src"])
    ends = ends.join(d.select("graph_id", F.col("node").alias("dst"), F.concat_ws(",", "out_degree", "in_degree").alias("d")), ["graph_id", "dst"])
    return ends.groupBy("graph_id").agg(F.md5(F.array_join(F.array_sort(F.collect_list(F.concat_ws(">", "s", "d"))), "|")).alias("structure"))


def function_addresses(nodes: DataFrame) -> DataFrame:
    """graph_id, address: the least node address as an unsigned number."""
    flip = F.lit(-(1 << 63)).cast("bigint")
    return nodes.groupBy("graph_id").agg(F.min(F.col("node").bitwiseXOR(flip)).alias("least")).select("graph_id", F.col("least").bitwiseXOR(flip).alias("address"))


def shared_blocks(blocks: DataFrame) -> DataFrame:
    """Blocks (file_id, address) that belong to more than one function (graph_id)."""
    return blocks.groupBy("file_id", "address").agg(F.countDistinct("graph_id").alias("functions")).filter("functions > 1")


def without_shared_blocks(blocks: DataFrame) -> DataFrame:
    """Functions that hold no shared block."""
    bad = blocks.join(shared_blocks(blocks), ["file_id", "address"], "left_semi").select("graph_id").distinct()
    return blocks.select("graph_id").distinct().join(bad, "graph_id", "left_anti")


def consecutive_edges(sequence: DataFrame, key: str, node: str, *order: str) -> DataFrame:
    """graph_id, src, dst, ord: distinct steps from a node to a different next one, in order of first appearance."""
    w = Window.partitionBy(key).orderBy(*order)
    steps = sequence.select(F.col(key).alias("graph_id"), F.col(node).alias("src"), F.lead(node).over(w).alias("dst"), F.row_number().over(w).alias("at"))
    first = steps.filter("dst is not null and dst <> src").groupBy("graph_id", "src", "dst").agg(F.min("at").alias("at"))
    return first.select("graph_id", "src", "dst", (F.row_number().over(Window.partitionBy("graph_id").orderBy("at")) - 1).alias("ord"))


def union_all(frames: list[DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionByName, frames)
