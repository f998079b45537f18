"""Writers: each returns lines (value) or writes them as text."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.bits import hex64, hex128


def graph_json(graph="graph") -> Column:
    """A graph as JSON, nodes in address order, numbers unsigned."""
    g = F.col(graph) if isinstance(graph, str) else graph
    by_address = F.array_sort(g["nodes"], lambda a, b: F.when(a["address"] < b["address"], -1).when(a["address"] > b["address"], 1).otherwise(0))
    return F.to_json(F.struct(g["edges"].alias("edges"), F.coalesce(g["name"], F.lit("CFG")).alias("name"), by_address.alias("nodes")))


def _unsigned_hex(word: Column) -> Column:
    return F.lower(F.hex(word))


def dot_lines(edges: DataFrame) -> DataFrame:
    """graph_id, value: a digraph text."""
    line = F.concat(F.lit("  blk_"), _unsigned_hex(F.col("src")), F.lit(" -> blk_"), _unsigned_hex(F.col("dst")), F.lit(";"))
    body = edges.groupBy("graph_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("src", "ord", line.alias("line")))), lambda x: x["line"]), "\n").alias("body"))
    return body.select("graph_id", F.concat(F.lit("digraph G {\n"), "body", F.lit("\n}\n")).alias("value"))


def disassembly(nodes: DataFrame) -> DataFrame:
    """graph_id, value: blocks in address order with their instruction counts and instructions."""
    text = F.array_join(F.transform("instructions", lambda i: F.concat(F.lit("\t\t"), i["mnemonic"], F.lit(" "), F.array_join(i["operands"], ", "))), "\n")
    block = F.concat(F.lit("\t["), _unsigned_hex(F.col("address")), F.lit("] ("), F.size("instructions").cast("string"), F.lit(")\n"), text)
    listed = nodes.groupBy("graph_id").agg(F.min("address").alias("entry"), F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("address", block.alias("b")))), lambda x: x["b"]), "\n").alias("body"))
    return listed.select("graph_id", F.concat(F.lit("["), _unsigned_hex(F.col("entry")), F.lit("]\n"), "body").alias("value"))


def weight_lines(weights: DataFrame) -> DataFrame:
    return weights.select(F.concat(hex128("feature_a", "feature_b"), F.lit(" "), F.format_string("%f", F.col("weight").cast("double"))).alias("value"))


def index_dump_lines(dump: DataFrame) -> DataFrame:
    return dump.select(F.concat_ws(" ", F.col("perm").cast("string"), hex64("hash_a"), hex64("hash_b"), hex64("file_id"), hex64("address")).alias("value"))


def fingerprint_lines(hashes: DataFrame) -> DataFrame:
    """file:address and the 32-digit hash."""
    return hashes.select(F.concat(hex64("file_id"), F.lit(":"), hex64("address"), F.lit(" "), hex128("hash_a", "hash_b")).alias("value"))


def feature_lines(features: DataFrame) -> DataFrame:
    """file:address and all features of a function, in order."""
    held = features.groupBy("file_id", "address").agg(F.array_sort(F.collect_list(F.struct("pos", hex128("feature_a", "feature_b").alias("f")))).alias("fs"))
    return held.select(F.concat(hex64("file_id"), F.lit(":"), hex64("address"), F.lit(" "), F.array_join(F.transform("fs", lambda x: x["f"]), " ")).alias("value"))


def pair_lines(pairs: DataFrame) -> DataFrame:
    return pairs.select(F.concat(hex64("file_a"), F.lit(":"), hex64("address_a"), F.lit(" "), hex64("file_b"), F.lit(":"), hex64("address_b")).alias("value"))


def metadata_lines(metadata: DataFrame) -> DataFrame:
    return metadata.select(F.concat_ws(" ", hex64("file_id"), "file_name", hex64("address"), F.base64(F.encode("function_name", "UTF-8")), F.col("vulnerable").cast("string")).alias("value"))


def histogram_lines(histogram: DataFrame) -> DataFrame:
    """Blocks of distance and count, in order of distance."""
    return histogram.groupBy().agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("distance", "pairs"))), lambda x: F.concat_ws(" ", x["distance"].cast("string"), x["pairs"].cast("string"))), "\n").alias("value"))


def feature_dictionary(features: DataFrame, payload: DataFrame) -> DataFrame:
    """Distinct features with what they stand for. payload: feature_a, feature_b, payload."""
    return features.select("feature_type", "feature_a", "feature_b").distinct().join(payload, ["feature_a", "feature_b"], "left")


def write_text(lines: DataFrame, path: str, mode: str = "overwrite") -> None:
    lines.select("value").write.mode(mode).text(path)
