import itertools
import re

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from simgrove.functions import bits, immediates, symbols
from simgrove.functions import reference_hash as R
from simgrove.plans import permutation

WORDS = [0, 1, -1, 5, 1 << 62, -(1 << 63), 0x0123456789ABCDEF, -0x0123456789ABCDEF]
M = (1 << 64) - 1


def test_permutation_is_a_bijection():
    assert sorted(permutation.source_positions()) == list(range(128))
    assert sum(permutation.permuted(1 << i).bit_length() - 1 for i in range(128)) == 8128


def test_buckets_of_the_first_permutations():
    found = permutation.bucket_positions(4)
    assert found[0] == tuple(range(127, 119, -1))
    assert found[1] == (71, 99, 106, 108, 68, 44, 80, 43) and found[2] == (10, 58, 36, 81, 98, 6, 38, 12)


@given(st.integers(0, (1 << 128) - 1), st.integers(0, 30))
@settings(max_examples=50, deadline=None)
def test_picks_are_the_top_bits_of_the_permuted_hash(value, k):
    picked = 0
    for p in permutation.bucket_positions(k + 1)[k]:
        picked = picked << 1 | (value >> p & 1)
    assert picked == permutation.permuted(value, k) >> 120


def test_words(spark):
    pairs = list(itertools.product(WORDS, WORDS))
    df = spark.createDataFrame(pairs, "a bigint, b bigint")
    rows = df.select("a", "b", bits.hex128("a", "b").alias("h"), bits.hamming128("a", "b", F.lit(0).cast("bigint"), F.lit(-1).cast("bigint")).alias("d"), *[bits.rotl64("a", n).alias(f"r{n}") for n in (0, 1, 7, 63)], bits.bit_pick("a", "b", [127, 64, 63, 0]).alias("p")).collect()
    for r in rows:
        a, b = r.a & M, r.b & M
        assert r.h == f"{a:016x}{b:016x}" and r.d == a.bit_count() + 64 - b.bit_count()
        assert all(r[f"r{n}"] & M == R.rotl(a, n) for n in (0, 1, 7, 63))
        assert r.p == (a >> 63) << 3 | (a & 1) << 2 | (b >> 63) << 1 | (b & 1)


def test_hash_texts(spark):
    texts = ["0" * 31 + "f", "aa." + "f" * 32, "f" * 33, "", "zz" * 16, "00000000000000010000000000000002"]
    a, b = bits.parse_feature_hash("t")
    found = spark.createDataFrame([(t,) for t in texts], "t string").select(a.alias("a"), b.alias("b")).collect()
    assert [(r.a, r.b) for r in found] == [(0, 15), (-1, -1), (0, 0), (0, 0), (0, 0), (1, 2)]


def test_immediates_of_registers_and_indices(spark):
    cases = {"EAX": [], "AH": [], "EBP": [], "RCX + ffffffffffffffc0": [0xFFFFFFFFFFFFFFC0], "R13 + RCX * 8 + ffffffffffffffd0": [8, 0xFFFFFFFFFFFFFFD0], "[ECX + 4]": [4], "0x10 20h": [0x10], "0x10, 20h": [0x10, 0x20], "1" * 17: [M], "-5": [(1 << 64) - 5, 5], "": []}
    rows = spark.createDataFrame([(k,) for k in cases], "t string").select("t", immediates.extract_immediates("t").alias("v")).collect()
    for r in rows:
        assert [x & M for x in r.v] == cases[r.t], r.t


def plain_immediates(text):
    out = []
    for m in re.finditer(r"(?:[^0-9A-Za-z_]|0x|^)([0-9a-fA-F]+)(?:h|[^0-9A-Za-z_]|$)", text):
        for g in (m.group(0), m.group(1)):
            n = re.match(r"\s*([-+]?)(?:0[xX](?=[0-9a-fA-F]))?([0-9a-fA-F]*)", g)
            v = int(n.group(2) or "0", 16)
            v = M if v > M else (-v & M if n.group(1) == "-" else v)
            if v and (not out or out[-1] != v):
                out.append(v)
    return out


@pytest.mark.parametrize("seed", range(3))
def test_immediates_of_random_operands(spark, seed):
    rng = np.random.default_rng(seed)
    texts = ["".join(rng.choice(list("0123456789abcdefABCDEFxXhg+-*[], _"), rng.integers(0, 24))) for _ in range(400)]
    rows = spark.createDataFrame([(t,) for t in texts], "t string").select("t", immediates.extract_immediates("t").alias("v")).collect()
    for r in rows:
        assert [x & M for x in r.v] == plain_immediates(r.t), r.t


def test_useful_immediates(spark):
    cases = {0x4000: False, 0x4001: True, 0x8000: True, 8: False, 9: False, 10: False, 11: True, 12: False, 13: True, -1: True, -4: False, -5: True, -0x5000: True}
    rows = spark.createDataFrame([(k,) for k in cases], "v bigint").select("v", immediates.is_useful("v").alias("u")).collect()
    assert {r.v: r.u for r in rows} == cases


GRAPH = [(0x806C811, "sub lea push call"), (0x806C820, "add jmp"), (0x806C825, "mov"), (0x806C827, "sub lea push call"), (0x806C836, "mov call")]
EDGES = [(0x806C811, 0x806C820), (0x806C820, 0x806C825), (0x806C820, 0x806C827), (0x806C825, 0x806C827), (0x806C827, 0x806C836)]


def test_known_hash():
    graph = R.Graph([n for n, _ in GRAPH], EDGES)
    mnemonics = [m for _, t in GRAPH for m in t.split()]
    assert R.simhash(R.function_features(graph, mnemonics, [])) == (0xACEB07449170DFCF, 0x56DF46C771E9A4DF)


def test_graph_hashes_in_step_equal_single_ones():
    import random

    rng = random.Random(4)
    graphs = [R.Graph(range(rng.randint(1, 9)), [(rng.randrange(9), rng.randrange(9)) for _ in range(rng.randint(0, 14))]) for _ in range(30)]
    balls = [g.tuples(g.nodes[0]) for g in graphs]
    numbers = np.array([edge for ball in balls for edges in ball for edge in edges], np.int64).reshape(-1, 10)
    factors = np.array([[R.seed(i, n % 5) for i in range(3)] for n in range(30)], np.uint64)
    found = R.structural_hashes(numbers, np.array([len(e) for ball in balls for e in ball]), np.array([len(b) for b in balls]), factors)
    assert found.tolist() == [R.structural_hash(ball, tuple(f)) for ball, f in zip(balls, factors.tolist(), strict=True)]


def test_features_of_a_function_are_unique():
    graph = R.Graph([n for n, _ in GRAPH], EDGES)
    found = [f[2:] for f in R.function_features(graph, ["mov"] * 40, [5, 5, 7, 5])]
    assert len(set(found)) == len(found)


def test_zero_weights_set_all_bits():
    graph = R.Graph([n for n, _ in GRAPH], EDGES)
    zero = dict.fromkeys(R.DEFAULT_WEIGHTS, 0.0)
    assert R.simhash(R.function_features(graph, ["a", "b", "c"], [9]), None, zero) == (M, M)
    some = dict(R.DEFAULT_WEIGHTS, mnemonic=0.0)
    assert R.simhash(R.function_features(graph, ["a", "b", "c"], []), None, some) == R.simhash(R.function_features(graph, [], [], ("graphlet",)))


def test_balls_and_sizes():
    chain = R.Graph(range(40), [(i, i + 1) for i in range(39)])
    assert chain.ball(10, 2, 30).nodes == [8, 9, 10, 11, 12] and chain.ball(10, 3, 6) is None


def test_splitter():
    assert symbols.split_outside_brackets("Array<unsigned char>::Addr(unsigned long)") == ["Array<unsigned char>::Addr(unsigned long)"]
    assert len(symbols.split_outside_brackets("public HRESULT Get(const struct _GUID &, void * *)")) == 3


def test_stemming(spark):
    cases = {"main": "main", "public: int __cdecl Foo::bar(class Baz *,int)": "Foo::bar( Baz*, int)", "void f(void)": "f()", "no parenthesis": ""}
    rows = spark.createDataFrame([(k,) for k in cases], "s string").select("s", symbols.stem_symbol("s").alias("t")).collect()
    assert {r.s: r.t for r in rows} == cases


def test_file_id(spark):
    import hashlib

    row = spark.createDataFrame([(bytearray(b"abc"),)], "c binary").select(symbols.file_id(F.col("c")).alias("f")).first()
    assert row.f == hashlib.sha256(b"abc").hexdigest()[:16]
