"""Readers: graph JSON, text files of features, pairs, weights and metadata, index dumps, symbol listings."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import schemas
from ..functions.bits import parse_feature_hash, parse_hex64
from ..functions.symbols import decode_name, file_id


def parse_graph(column) -> Column:
    """A graph of its JSON text; null where a required key is missing anywhere."""
    graph = F.from_json(column, schemas.GRAPH)
    complete = (
        graph["nodes"].isNotNull()
        & graph["edges"].isNotNull()
        & F.forall(graph["nodes"], lambda n: n["address"].isNotNull() & n["instructions"].isNotNull() & F.forall(n["instructions"], lambda i: i["mnemonic"].isNotNull() & i["operands"].isNotNull()))
        & F.forall(graph["edges"], lambda e: e["source"].isNotNull() & e["destination"].isNotNull())
    )
    return F.when(complete, graph)


def read_graphs(spark: SparkSession, path: str) -> DataFrame:
    """graph (the GRAPH schema) of JSON files of one graph each; files that aren't complete give null."""
    return spark.read.text(path, wholetext=True).select(F.input_file_name().alias("file"), parse_graph("value").alias("graph"))


def read_executable(spark: SparkSession, path: str) -> DataFrame:
    """file, position, graph of executables' JSON files."""
    read = spark.read.schema(schemas.EXECUTABLE).json(path, multiLine=True)
    return read.select(F.input_file_name().alias("file"), F.posexplode("flowgraphs").alias("position", "graph"))


def find_files(spark: SparkSession, path: str, glob: str = "*") -> DataFrame:
    """path, length, file_id of files at any depth; content is read for its hash only."""
    found = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", glob).load(path)
    return found.select("path", "length", file_id(F.col("content")).alias("file_id"))


def read_lines(spark: SparkSession, path: str) -> DataFrame:
    """tokens: each line split at blanks; empty tokens within a line stay, trailing ones go."""
    return _tokens(spark.read.text(path))


def _function(text) -> tuple[Column, Column]:
    parts = F.split(text, ":")
    return parse_hex64(F.get(parts, 0)), parse_hex64(F.get(parts, 1))


def read_functions(spark: SparkSession, path: str) -> DataFrame:
    """file_id, address, pos, feature_a, feature_b of functions.txt."""
    lines = read_lines(spark, path).select(F.get("tokens", 0).alias("name"), F.posexplode(F.filter(F.slice("tokens", 2, 1 << 30), lambda t: t != "")).alias("pos", "feature"))
    (file, address), (a, b) = _function(F.col("name")), parse_feature_hash("feature")
    return lines.select(file.alias("file_id"), address.alias("address"), "pos", a.alias("feature_a"), b.alias("feature_b"))


def feature_set(functions: DataFrame) -> DataFrame:
    return functions.select("feature_a", "feature_b").distinct().orderBy("feature_a", "feature_b")


def _tokens(lines: DataFrame) -> DataFrame:
    return lines.select(F.split(F.regexp_replace("value", " +$", ""), " ").alias("tokens"))


def read_pairs(spark: SparkSession, path: str) -> DataFrame:
    """file_a, address_a, file_b, address_b of a pair file."""
    return parse_pairs(spark.read.text(path))


def parse_pairs(lines: DataFrame) -> DataFrame:
    tokens = _tokens(lines)
    (fa, aa), (fb, ab) = _function(F.get("tokens", 0)), _function(F.get("tokens", 1))
    return tokens.select(fa.alias("file_a"), aa.alias("address_a"), fb.alias("file_b"), ab.alias("address_b")).filter("file_b is not null")


def read_weights(spark: SparkSession, path: str) -> DataFrame:
    """feature_a, weight: keys are the first word of a 32- or 35-character id, or 16 digits; the last line of a key counts.

    Lines are read in splits; their order is that of the splits in the file and of the lines within one."""
    read = spark.read.text(path)
    return parse_weights(read.select("value", F.struct("_metadata.file_path", "_metadata.file_block_start", F.monotonically_increasing_id()).alias("line")))


def parse_weights(lines: DataFrame) -> DataFrame:
    """lines: value, and line, which orders them."""
    parts = F.split("value", " ")
    name = F.get(parts, 0)
    key = F.when(F.length(name) == 16, parse_hex64(name)).when(F.length(name).isin(32, 35), parse_feature_hash(name)[0])
    kept = lines.filter(F.size(parts) >= 2).select("line", key.alias("feature_a"), F.get(parts, 1).try_cast("float").alias("weight")).filter("feature_a is not null and weight is not null")
    return kept.groupBy("feature_a").agg(F.max_by("weight", "line").alias("weight"))


def read_metadata(spark: SparkSession, path: str) -> DataFrame:
    """file_id, file_name, address, function_name, vulnerable; lines without five parts are left out."""
    return parse_metadata(spark.read.text(path))


def parse_metadata(lines: DataFrame) -> DataFrame:
    parts = F.split("value", " ")
    lines = lines.filter(F.size(parts) == 5)
    return lines.select(parse_hex64(parts[0]).alias("file_id"), parts[1].alias("file_name"), parse_hex64(parts[2]).alias("address"), decode_name(parts[3]).alias("function_name"), (F.lower(parts[4]) == "true").alias("vulnerable"))


def read_index_dump(spark: SparkSession, path: str) -> DataFrame:
    """perm, hash_a, hash_b, file_id, address of a text dump; header lines don't parse and go."""
    return parse_index_dump(spark.read.text(path))


def parse_index_dump(lines: DataFrame) -> DataFrame:
    parts = F.split(F.trim("value"), r"\s+")
    rows = lines.filter(F.size(parts) == 5).select(parts[0].try_cast("int").alias("perm"), *[parse_hex64(parts[i]).alias(n) for i, n in ((1, "hash_a"), (2, "hash_b"), (3, "file_id"), (4, "address"))])
    return rows.dropna()


def labelled_dump(dump: DataFrame, symbols: DataFrame) -> DataFrame:
    """The dump's functions with their symbol names."""
    return dump.join(symbols.select("file_id", "address", "file_name", "function_name"), ["file_id", "address"])


def elf_symbols(lines: DataFrame) -> DataFrame:
    """address, name of a symbol table listing's functions in .text."""
    return lines.filter(F.col("value").contains(" F .text")).select(parse_hex64(F.regexp_extract("value", r"^([0-9a-fA-F]+) ", 1)).alias("address"), F.regexp_extract("value", r"(\S.*)$", 1).alias("_v")).select("address", F.regexp_extract("_v", r" F \.text\s+[0-9a-fA-F]+\s+(?:\.hidden )?(.*)$", 1).alias("name"))


def pe_symbols(lines: DataFrame, base: int) -> DataFrame:
    """address, name of a debug dump's functions; addresses are moved by the image base."""
    row = lines.filter(F.col("value").contains("Function") & F.col("value").contains("static") & ~F.col("value").contains("crt"))
    return row.select((parse_hex64(F.regexp_extract("value", r"\[([0-9a-fA-F]+)\]", 1)) + F.lit(base)).alias("address"), F.regexp_extract("value", r"static, (?:\[[^\]]*\])*,?\s*(.*)$", 1).alias("name"))


def load_training_set(spark: SparkSession, folder: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """features (key, feature_a, feature_b), attract and repulse (a, b) of a training folder; a missing repulse file is empty."""
    key = lambda f, a: F.concat_ws(":", F.hex(f), F.hex(a))
    functions = read_functions(spark, f"{folder}/functions.txt").select(key("file_id", "address").alias("key"), "feature_a", "feature_b")
    out = [functions]
    for name in ("attract", "repulse"):
        try:
            pairs = read_pairs(spark, f"{folder}/{name}.txt")
            out.append(pairs.select(key("file_a", "address_a").alias("a"), key("file_b", "address_b").alias("b")))
        except Exception as e:
            if "PATH_NOT_FOUND" not in str(e):
                raise
            out.append(spark.createDataFrame([], "a string, b string"))
    return tuple(out)
