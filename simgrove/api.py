"""Objects for interactive use: one flow graph, a hasher, a search index. Batches belong in DataFrames."""

from __future__ import annotations

import json
import math

from pyspark.sql import SparkSession

from .functions import reference_hash as R
from .operators.index import SimHashIndex
from .operators.search import search_buckets

MASK = R.MASK


class FlowgraphWithInstructions:
    """A flow graph: nodes by address, edges in order, instructions of nodes."""

    def __init__(self):
        self.nodes: set[int] = set()
        self.edges: list[tuple[int, int]] = []
        self.instructions: dict[int, list[tuple[str, list[str]]]] = {}

    def add_node(self, address: int) -> None:
        self.nodes.add(address & MASK)

    def add_edge(self, source: int, destination: int) -> None:
        self.nodes |= {source & MASK, destination & MASK}
        self.edges.append((source & MASK, destination & MASK))

    def add_instructions(self, address: int, instructions) -> None:
        self.instructions[address & MASK] = [(m, list(o)) for m, o in instructions]

    def size(self) -> int:
        return len(self.nodes)

    def number_of_branching_nodes(self) -> int:
        starts = [s for s, _ in self.edges]
        return sum(starts.count(s) > 1 for s in set(starts))

    def to_json(self) -> str:
        nodes = [{"address": n, "instructions": [{"mnemonic": m, "operands": o} for m, o in self.instructions.get(n, [])]} for n in sorted(self.nodes)]
        edges = [{"source": s, "destination": d} for s, d in sorted(self.edges, key=lambda e: e[0])]
        return json.dumps({"edges": edges, "name": "CFG", "nodes": nodes}, separators=(",", ":"))

    def from_json(self, text: str) -> bool:
        """False, with nothing changed, where a required key is missing."""
        try:
            read = json.loads(text)
            nodes = [(n["address"], [(i["mnemonic"], list(i["operands"])) for i in n["instructions"]]) for n in read["nodes"]]
            edges = [(e["source"], e["destination"]) for e in read["edges"]]
        except (KeyError, TypeError, ValueError):
            return False
        for address, instructions in nodes:
            self.add_node(address)
            self.add_instructions(address, instructions)
        for s, d in edges:
            self.add_edge(s, d)
        return True

    def mnemonics(self) -> list[str]:
        return [m for a in sorted(self.instructions) for m, _ in self.instructions[a]]


class SimHasher:
    """Hashes of single graphs. The three default weights are honoured; weights maps feature words to weights."""

    def __init__(self, weights: dict[int, float] | None = None, mnem_weight: float = 0.05, graphlet_weight: float = 1.0, immediate_weight: float = 4.0, spark: SparkSession | None = None):
        self.weights, self.spark = weights, spark
        self.defaults = {"mnemonic": mnem_weight, "graphlet": graphlet_weight, "immediate": immediate_weight}

    def calculate_hash(self, graph: FlowgraphWithInstructions) -> tuple[int, int]:
        """The 128-bit hash as two unsigned words, by way of the batch operator: the operands need SQL functions."""
        from pyspark.sql import functions as F

        from .operators.graph_features import graph_simhash
        from .sources.readers import parse_graph

        spark = self.spark or SparkSession.builder.getOrCreate()
        row = spark.createDataFrame([(0, graph.to_json())], "graph_id bigint, value string")
        parsed = row.select("graph_id", parse_graph("value").alias("g")).select("graph_id", F.col("g.nodes").alias("nodes"), F.col("g.edges").alias("edges"))
        found = graph_simhash(parsed, self.weights, defaults=self.defaults).first()
        return found.hash_a & MASK, found.hash_b & MASK


def _signed(x: int) -> int:
    x &= MASK
    return x - (1 << 64) if x >> 63 else x


class SimHashSearchIndex:
    """An index at a path: add hashes, find the nearest."""

    def __init__(self, path: str, create: bool = False, buckets: int = 28, spark: SparkSession | None = None):
        self.spark = spark or SparkSession.builder.getOrCreate()
        self.index = SimHashIndex(self.spark, path, create, buckets)

    def add_functions(self, rows) -> None:
        """rows: (hash_a, hash_b, file_id, address)."""
        data = [(_signed(f), _signed(a), _signed(x), _signed(y)) for x, y, f, a in rows]
        self.index.add(self.spark.createDataFrame(data, "file_id bigint, address bigint, hash_a bigint, hash_b bigint"))

    def add_function(self, hash_a: int, hash_b: int, file_id: int, address: int) -> None:
        self.add_functions([(hash_a, hash_b, file_id, address)])

    def query_top_N(self, hash_a: int, hash_b: int, how_many: int) -> list[tuple[float, int, int]]:  # noqa: N802
        """(similarity, file_id, address), nearest first, ties by function id."""
        asked = self.spark.createDataFrame([(0, _signed(hash_a), _signed(hash_b))], "query_id bigint, qa bigint, qb bigint")
        found = search_buckets(asked, self.index.functions, how_many, self.index.permutations, entries=self.index.entries)
        rows = found.join(self.index.functions.select("function_id", "file_id", "address"), "function_id").orderBy("rank").collect()
        return [(float(r.similarity), r.file_id & MASK, r.address & MASK) for r in rows]

    def indexed_functions(self) -> int:
        return self.index.functions.count()

    def get_used_size(self) -> int:
        """Number of entries; files grow by themselves, so that none are free."""
        return self.index.entries.count()

    def get_free_size(self) -> int:
        return 0

    def odds_of_random_hit(self, equal_bits: float) -> float:
        p = 1 - math.erf(abs(int(equal_bits) - 64) / math.sqrt(32) / math.sqrt(2))
        n = self.indexed_functions()
        return 1 / p / n if p and n else float("inf")


def distance(a1: int, b1: int, a2: int, b2: int) -> int:
    return (a1 ^ a2).bit_count() + (b1 ^ b2).bit_count()


def register_functions(spark: SparkSession) -> None:
    """SQL functions: hamming128(a1, b1, a2, b2), hex128(a, b), immediate_words(text), is_useful_immediate(v)."""
    from .functions.immediates import PATTERN

    spark.sql("CREATE OR REPLACE TEMPORARY FUNCTION hamming128(a1 BIGINT, b1 BIGINT, a2 BIGINT, b2 BIGINT) RETURNS INT RETURN bit_count(a1 ^ a2) + bit_count(b1 ^ b2)")
    spark.sql("CREATE OR REPLACE TEMPORARY FUNCTION hex128(a BIGINT, b BIGINT) RETURNS STRING RETURN concat(lpad(lower(hex(a)), 16, '0'), lpad(lower(hex(b)), 16, '0'))")
    spark.sql("CREATE OR REPLACE TEMPORARY FUNCTION is_useful_immediate(v BIGINT) RETURNS BOOLEAN RETURN v > 16384 OR v < -16384 OR (v & 3) <> 0 AND (v > 10 OR v < 0)")
    pattern = PATTERN.replace("\\", "\\\\")
    spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION immediate_words(t STRING) RETURNS ARRAY<STRING> RETURN regexp_extract_all(t, '{pattern}', 1)")
