"""Queries opN_<name> over whole tables, and the SQL for those that SQL can express."""

from __future__ import annotations

from pyspark.sql import functions as F

from .line_windows import ORACLE_SQL as LINE_WINDOWS_SQL
from .quality import ORACLE_SQL as QUALITY_SQL
from .store import documents


def vocabulary(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_suffix_dedup(spark, sf_dir):
    from .suffix_dedup import remove_repeated_bytes

    found = remove_repeated_bytes(documents(spark, sf_dir))
    return found.select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"))


def op2_source_mix(spark, sf_dir):
    from .mixing import repeats

    return repeats(documents(spark, sf_dir)).select("doc_id", "size", "source_size", "target", (F.col("size") * F.col("times")).alias("taken"))


def op3_pack_sequences(spark, sf_dir):
    from .packing import pack

    pieces = pack(documents(spark, sf_dir), vocabulary("word_bpe_49k.json"))
    return pieces.select("doc_id", "start", "length", F.crc32("tokens").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")


def op4_line_frequency(spark, sf_dir):
    from .quality import quality

    return quality(documents(spark, sf_dir)).drop("host", "content")


def op5_nearest_neighbours(spark, sf_dir):
    from .neighbours import nearest_neighbours

    return nearest_neighbours(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))


def op6_line_windows(spark, sf_dir):
    from .line_windows import remove_repeated_windows

    cleaned = remove_repeated_windows(documents(spark, sf_dir))
    return cleaned.select("doc_id", "n_removed", "n_spans", F.sha2(F.coalesce("text", F.lit("")), 256).alias("kept_sha256"))


def op7_jaccard_components(spark, sf_dir):
    from .jaccard_join import jaccard_components

    return jaccard_components(documents(spark, sf_dir)).select("doc_id", "n_shingles", "component_id")


def op8_token_counts(spark, sf_dir):
    from .token_counts import count_tokens

    return count_tokens(documents(spark, sf_dir), vocabulary("byte_bpe_50k.json"))


def op9_license_scan(spark, sf_dir):
    from .licenses import scan_licenses

    return scan_licenses(documents(spark, sf_dir))


def op10_toxicity(spark, sf_dir):
    from .toxicity import score_toxicity

    return score_toxicity(documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/labels.parquet"))


QUERIES = {f.__name__: f for f in (op1_suffix_dedup, op2_source_mix, op3_pack_sequences, op4_line_frequency, op5_nearest_neighbours, op6_line_windows, op7_jaccard_components, op8_token_counts, op9_license_scan, op10_toxicity)}
ORACLES: dict[str, str] = {"op4_line_frequency": QUALITY_SQL, "op6_line_windows": LINE_WINDOWS_SQL}
