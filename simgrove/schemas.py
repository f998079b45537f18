"""Explicit schemas: nothing is inferred from data."""

from __future__ import annotations

from pyspark.sql import types as T

INSTRUCTION = T.StructType([T.StructField("mnemonic", T.StringType()), T.StructField("operands", T.ArrayType(T.StringType()))])
# Addresses are unsigned 64-bit numbers; above 2^63 they only fit a decimal.
_ADDRESS = T.DecimalType(20, 0)
GRAPH = T.StructType([
    T.StructField("name", T.StringType()),
    T.StructField("nodes", T.ArrayType(T.StructType([T.StructField("address", _ADDRESS), T.StructField("instructions", T.ArrayType(INSTRUCTION))]))),
    T.StructField("edges", T.ArrayType(T.StructType([T.StructField("source", _ADDRESS), T.StructField("destination", _ADDRESS)]))),
])
EXECUTABLE = T.StructType([T.StructField("flowgraphs", T.ArrayType(GRAPH))])
NODES = "graph_id bigint, address bigint, instructions array<struct<mnemonic:string,operands:array<string>>>"
EDGES = "graph_id bigint, src bigint, dst bigint, ord int"
FEATURES = "file_id bigint, address bigint, feature_type string, pos int, occurrence int, feature_a bigint, feature_b bigint"
WEIGHTS = "feature_a bigint, weight float"
FUNCTIONS = "function_id bigint, file_id bigint, address bigint, hash_a bigint, hash_b bigint"
INDEX_ENTRIES = "perm int, bucket int, hash_a bigint, hash_b bigint, function_id bigint"
METADATA = "file_id string, file_name string, address string, function_name string, vulnerable string"
