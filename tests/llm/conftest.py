import random

import pytest
from pyspark.sql import types as T

PROSE = "the of and to in a is that for it as was with be by on not he his but at are this have from or had an they which one you were all her she there would their we him been has when who will no more if out so up said what its about than into them can only other time new some could these two may first then do any like my now over such our man me even most made after also well many must before".split()

SCHEMA = T.StructType([
    T.StructField("doc_id", T.LongType()),
    T.StructField("text", T.StringType()),
    T.StructField("lang", T.StringType()),
    T.StructField("source", T.StringType()),
    T.StructField("n_chars", T.LongType()),
    # Names that computed columns use, too.
    T.StructField("row", T.StringType()),
    T.StructField("ord", T.StringType()),
    T.StructField("key", T.StringType()),
    T.StructField("size", T.StringType()),
    T.StructField("token", T.StringType()),
    T.StructField("n_removed", T.StringType()),
    # Names that helper columns have, in another case.
    *[T.StructField(n, T.StringType()) for n in ("_KEY", "line_key", "marked_id", "marked_starts", "mix_key", "MIX_N", "mix_rows", "kept_id", "place", "rejected_content", "toxic", "labelled", "host", "content")],
])


def sentence(rng, n):
    return " ".join(rng.choice(PROSE) for _ in range(n))


def prose(seed, lines=8, words=14):
    rng = random.Random(seed)
    return "\n".join(sentence(rng, rng.randint(words // 2, words)) for _ in range(lines))


def near(text, seed, share=0.02):
    rng = random.Random(seed)
    return " ".join(rng.choice(PROSE) + "x" if rng.random() < share else w for w in text.split(" "))


def table(spark, texts, sources=None, ids=None):
    ids = list(range(len(texts))) if ids is None else ids
    rows = [(i, t, "en", (sources[k] if sources else f"src{k % 3}"), len(t or ""), "r", "o", "k", "s", "t", "n", *"abcdefghijklmn") for k, (i, t) in enumerate(zip(ids, texts, strict=True))]
    return spark.createDataFrame(rows, SCHEMA)


def hard_texts():
    """Prose, copies, near copies, shared passages and lines, and the awkward cases."""
    base = [prose(i) for i in range(24)]
    passage = prose(900, 3, 20)
    shared = [prose(300 + i, 3) + "\n" + passage + "\n" + prose(400 + i, 2) for i in range(8)]
    copies = [base[0]] * 5 + [base[1]] * 2
    nears = [near(base[2], i) for i in range(12)] + [near(base[3], 50 + i, 0.06) for i in range(12)]
    odd = [
        None, "", " ", "\n\n\n", "\t \x0b\x0c\r\n", "word", "two words", "four words in all", "a b c d e", "a a a a a a a a a a a a a a a a a a a a a a",
        "é" * 300, "ab" * 400, "x" * 5000, " ".join(["lang"] * 400), prose(77, 400, 30), "It's  odd: spaces　and ünïcödé <|endoftext|> ***", "line\n" * 40,
        "A b C d E f", "a B c D e F", "\x00nul\x00 bytes in here and some more words to follow", "z" * 99, "z" * 100, "z" * 101, "q" * 250,
    ]
    return base + shared + copies + nears + odd


@pytest.fixture(scope="session")
def texts():
    return hard_texts()


@pytest.fixture(scope="session")
def docs(spark, texts):
    return table(spark, texts).repartition(5).cache()


@pytest.fixture(scope="session")
def none(spark):
    return spark.createDataFrame([], SCHEMA)


@pytest.fixture(scope="session")
def repeated(spark):
    """Null and repeated ids, repeated rows."""
    a, b, c = prose(1), prose(2), prose(3)
    return table(spark, [a, a, a, b, c, b, None, "", a + " tail"], ["x", "x", None, "y", None, "y", "x", None, "x"], [5, 5, 5, 5, None, None, None, 7, 9])
