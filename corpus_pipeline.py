"""A training corpus from documents: quality rules, line dedup, near duplicates, source mix, packing.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame, written as Parquet and reread as the
next one's docs. All but the last return the columns of documents.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from simgrove.llm.jaccard_join import keep_one_of_each
from simgrove.llm.line_windows import remove_repeated_windows
from simgrove.llm.mixing import mix_documents
from simgrove.llm.packing import pack
from simgrove.llm.quality import keep_good
from simgrove.llm.registry import vocabulary
from simgrove.llm.store import Workspace, documents

TOKENIZER = "word_bpe_49k.json"


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 4: documents that the rules reject go."""
    return keep_good(docs)


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 6: later occurrences of three-line windows go; every document stays, with what is left of its text."""
    cleaned = remove_repeated_windows(docs)
    if "n_chars" in docs.columns:
        cleaned = cleaned.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType))
    return cleaned.select(*docs.columns)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 7: of each group of near duplicates the document with the least id stays."""
    return keep_one_of_each(docs)


def source_mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 2: each document as often as the mix takes it."""
    return mix_documents(docs)


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 3: the pieces of the packed sequences."""
    pieces = pack(docs, vocabulary(TOKENIZER))
    return pieces.select("doc_id", "start", "length", F.crc32("tokens").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")


STAGES = [
    ("quality rules", quality_rules),
    ("line dedup", line_dedup),
    ("n-gram Jaccard join", near_duplicates),
    ("source mix", source_mix),
    ("packing", packing),
]

#: Sub-word encoding can't be written in SQL; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    space = Workspace(spark, "pipeline")
    docs = documents(spark, sf_dir)
    for i, (_, stage) in enumerate(STAGES):
        docs = space.keep(stage(spark, docs, sf_dir), f"stage{i}")
    return docs
