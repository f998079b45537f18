"""Features of token sequences: n-grams, occurrence numbers, constants."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.bits import md5_words
from ..functions.immediates import extract_immediates, is_useful


def trigrams(tokens: DataFrame, key: str = "key", order: tuple[str, ...] = ("pos",), token: str = "token") -> DataFrame:
    """key, pos (from 0), m1, m2, m3: three tokens in a row of each key; blocks are run together in their order."""
    w = Window.partitionBy(key).orderBy(*order)
    placed = tokens.select(key, (F.row_number().over(w) - 1).alias("pos"), F.col(token).alias("m1"), F.lead(token, 1).over(w).alias("m2"), F.lead(token, 2).over(w).alias("m3"))
    return placed.filter(F.col("m3").isNotNull())


def text_tokens(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """key, pos, token: the words of a text, split at ASCII white space."""
    words = F.regexp_extract_all(F.col(text), F.lit(r"([^ \t\r\n]+)"), F.lit(1))
    return docs.select(F.col(key).alias("key"), F.posexplode(words).alias("pos", "token"))


def text_trigrams(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """As trigrams over text_tokens, without a shuffle: a text's words are neighbours in one array."""
    words = F.regexp_extract_all(F.col(text), F.lit(r"([^ \t\r\n]+)"), F.lit(1))
    held = docs.select(F.col(key).alias("key"), words.alias("w")).filter(F.size("w") >= 3)
    starts = F.sequence(F.lit(0), F.size("w") - 3)
    grams = F.transform(starts, lambda i: F.struct(i.alias("pos"), F.get("w", i).alias("m1"), F.get("w", i + 1).alias("m2"), F.get("w", i + 2).alias("m3")))
    return held.select("key", F.explode(grams).alias("g")).select("key", "g.*")


def number_occurrences(features: DataFrame, key: str = "key", feature: str = "feature", order: str = "pos") -> DataFrame:
    """Adds occurrence: 0 for the first of equal features of a key, 1 for the next, and so on."""
    return features.withColumn("occurrence", F.row_number().over(Window.partitionBy(key, feature).orderBy(order)) - 1)


def occurrence_counts(features: DataFrame, key: str = "key", feature: str = "feature") -> DataFrame:
    """key, feature, occurrence without their places: partial counts instead of a window over every feature."""
    counted = features.groupBy(key, feature).agg(F.count(F.lit(1)).alias("n"))
    return counted.select(key, feature, F.explode(F.sequence(F.lit(0), (F.col("n") - 1).cast("int"))).alias("occurrence"))


def native_features(grams: DataFrame, kind: str = "mnemonic") -> DataFrame:
    """key, feature_type, occurrence, feature_a, feature_b: MD5 words of the gram and its occurrence number."""
    return described_features(grams, kind).drop("payload")


def described_features(grams: DataFrame, kind: str = "mnemonic") -> DataFrame:
    """As native_features, with payload, the gram that a feature stands for."""
    named = grams.select("key", F.concat_ws(" ", "m1", "m2", "m3").alias("feature"))
    a, b = md5_words(F.concat(F.lit(f"{kind}:"), "feature", F.lit("#"), F.col("occurrence").cast("string")))
    return occurrence_counts(named).select("key", F.lit(kind).alias("feature_type"), "occurrence", a.alias("feature_a"), b.alias("feature_b"), F.col("feature").alias("payload"))


def immediates(instructions: DataFrame) -> DataFrame:
    """key, address, pos, value: useful constants of all but each block's last instruction.

    instructions: key, address, instructions (array of mnemonic and operands)."""
    body = F.when(F.size("instructions") > 1, F.slice("instructions", 1, F.size("instructions") - 1))
    each = instructions.select("key", "address", F.posexplode(body).alias("pos", "i")).select("key", "address", "pos", F.explode("i.operands").alias("operand"))
    found = each.select("key", "address", "pos", F.explode(extract_immediates("operand")).alias("value"))
    return found.filter(is_useful("value"))


def use_features(features: DataFrame, graphs: bool = True, mnemonics: bool = True, constants: bool = True) -> DataFrame:
    """Features of the kinds that are switched on."""
    kinds = [k for k, on in (("graphlet", graphs), ("mnemonic", mnemonics), ("immediate", constants)) if on]
    return features.filter(F.col("feature_type").isin(kinds))


def split_blocks_after_calls(instructions: DataFrame, calls: tuple[str, ...] = ("call",)) -> DataFrame:
    """Adds block: a block ends after a call. instructions: key, pos, mnemonic."""
    earlier = Window.partitionBy("key").orderBy("pos").rowsBetween(Window.unboundedPreceding, -1)
    return instructions.withColumn("block", F.coalesce(F.sum(F.col("mnemonic").isin(*calls).cast("int")).over(earlier), F.lit(0)))
