"""Pairs to learn from: families, splits, attraction and repulsion. All choices follow hashes, so reruns agree."""

from __future__ import annotations

import hashlib
import math

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..plans.strategy import kept

#: Members of a family that meet as many others in one block, and pairs that are hashed at once.
BLOCK, TURN = 4096, 32_768
_ROTATIONS = [r for group in ((7, 12, 17, 22), (5, 9, 14, 20), (4, 11, 16, 23), (6, 10, 15, 21)) for r in group * 4]
_SINES = [int(abs(math.sin(i + 1)) * 2**32) & 0xFFFFFFFF for i in range(64)]
_START = (0x67452301, 0xEFCDAB89, 0x98BADCFE, 0x10325476)

def hash_order(*columns, salt: str = "") -> Column:
    """A reproducible random order that other engines can follow."""
    return F.md5(F.concat(F.lit(salt), *[F.concat(F.lit(":"), F.col(c).cast("string")) for c in columns]))


def _md5(words: list) -> list[np.ndarray]:
    """MD5 of messages of one padded block: the four words of each digest. words: 16 of uint32, arrays or single ones."""
    a, b, c, d = (np.uint32(x) for x in _START)
    for i in range(64):
        if i < 16:
            f, g = d ^ (b & (c ^ d)), i
        elif i < 32:
            f, g = c ^ (d & (b ^ c)), (5 * i + 1) % 16
        elif i < 48:
            f, g = b ^ c ^ d, (3 * i + 5) % 16
        else:
            f, g = c ^ (b | ~d), 7 * i % 16
        x = f + (a + (words[g] + np.uint32(_SINES[i])))
        a, d, c, b = d, c, b, b + (x << np.uint32(_ROTATIONS[i]) | x >> np.uint32(32 - _ROTATIONS[i]))
    return [np.asarray(x + np.uint32(y)) for x, y in zip((a, b, c, d), _START, strict=True)]


def _first_words(head: bytes, left: list[bytes], right: list[bytes]) -> np.ndarray:
    """The first eight bytes, as a big-endian number, of the MD5 of head + x + b":" + y for each x of left and y of right; the x
    are of one length, and so are the y."""
    size = len(head) + len(left[0]) + 1 + len(right[0])
    if size > 55:
        return np.array([[int.from_bytes(hashlib.md5(head + x + b":" + y).digest()[:8]) for y in right] for x in left], np.uint64)
    tail = b"\x80" + bytes(55 - size) + (8 * size).to_bytes(8, "little")
    mine = np.frombuffer(b"".join(head + x + b":" + bytes(64 - size + len(right[0])) for x in left), "<u4").reshape(-1, 16)
    theirs = np.frombuffer(b"".join(bytes(size - len(y)) + y + tail for y in right), "<u4").reshape(-1, 16)
    words = []
    for i in range(16):  # a word that no row or no column changes stays a single one
        x, y = (w[:1, i] if (w[:, i] == w[0, i]).all() else w[:, i] for w in (mine, theirs))
        words.append(x[:, None] | y[None, :])
    with np.errstate(over="ignore"):
        a, b = (np.broadcast_to(w, (len(left), len(right))) for w in _md5(words)[:2])
    return a.byteswap().astype(np.uint64) << np.uint64(32) | b.byteswap()


def _least_hashes(most: int, kind: str):
    """Of each block of members (side 0) and others (side 1) of a family, for each set the pairs that can be among the
    `most` least by MD5: all whose first eight bytes aren't above the `most`-th."""

    def run(block: pa.Table) -> pa.Table:
        out = []
        sides = [block.filter(pc.equal(block["side"], s)) for s in (0, 1)]
        for wanted in (False, True):
            for ours, theirs in _SETS[kind][wanted]:
                x, y = (t.filter(pc.equal(t["validation"], v)) for t, v in zip(sides, (ours, theirs), strict=True))
                i, j = _least_of(x, y, most)
                out.append(pa.table({"validation": pa.array(np.full(len(i), wanted)), "a": x["key"].take(pa.array(i)), "b": y["key"].take(pa.array(j))}))
        return pa.concat_tables(out)

    return run


#: Which members (of training, of validation) are paired, for either set.
_SETS = {
    "within": {False: [(False, False)], True: [(True, True)]},
    "across": {False: [(False, False)], True: [(False, True), (True, False)]},
}


def _least_of(x: pa.Table, y: pa.Table, most: int) -> tuple[np.ndarray, np.ndarray]:
    """Rows of x and of y, x before y in place, of the pairs with the `most` least hashes, and any that equal the last of them."""
    held: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
    waiting, bound = 0, None

    def cut():
        nonlocal held, waiting, bound
        h, i, j = (np.concatenate(c) for c in zip(*held, strict=True))
        if len(h) > most:
            bound = np.partition(h, most - 1)[most - 1]
            h, i, j = h[h <= bound], i[h <= bound], j[h <= bound]
        held, waiting = [(h, i, j)], 0

    names, places = [], []
    for t in (x, y):
        text = [v.encode() for v in t["text"].to_pylist()]
        groups: dict[int, list[int]] = {}
        for i, v in enumerate(text):
            groups.setdefault(len(v), []).append(i)
        names.append({n: ([text[i] for i in g], np.array(g)) for n, g in groups.items()})
        places.append(t["place"].to_numpy())
    for left, at_left in names[0].values():
        for right, at_right in names[1].values():
            rows = max(1, TURN // len(right))
            for lo in range(0, len(left), rows):
                i, j = at_left[lo : lo + rows], at_right
                before = places[0][i][:, None] < places[1][j]
                if not before.any():
                    continue
                h = _first_words(b"attract:", left[lo : lo + rows], right)
                r, c = np.nonzero(before if bound is None else before & (h <= bound))
                held.append((h[r, c], i[r], j[c]))
                waiting += len(r)
                if waiting > max(4 * most, TURN):
                    cut()
    if not held:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    cut()
    return held[0][1:]


def least_attraction_pairs(split: DataFrame, most: int, across: bool = False) -> DataFrame:
    """validation, a, b (a < b): pairs of one family that can be among the `most` first of their set by the MD5 of
    attract:a:b; a few more than these. Each pair is hashed once, in blocks of BLOCK by BLOCK members, and only the least
    of a block leave it."""
    w = Window.partitionBy("family").orderBy("key")
    placed = split.filter("family is not null and key is not null and validation is not null").select("family", "key", "validation", F.col("key").cast("string").alias("text"), F.row_number().over(w).alias("at"), F.dense_rank().over(w).alias("place"))
    placed = placed.withColumn("part", F.floor((F.col("at") - 1) / BLOCK).cast("bigint"))
    placed = placed.withColumn("last", F.max("part").over(Window.partitionBy("family")))
    left = placed.withColumn("i", F.col("part")).withColumn("j", F.explode(F.sequence("part", "last"))).withColumn("side", F.lit(0))
    right = placed.withColumn("j", F.col("part")).withColumn("i", F.explode(F.sequence(F.lit(0).cast("bigint"), "part"))).withColumn("side", F.lit(1))
    blocks = left.unionByName(right).select("family", "i", "j", "side", "key", "text", "place", "validation")
    # Blocks are few bytes and much work, so their number of tasks is stated: else Spark runs them in one.
    blocks = blocks.repartition(int(split.sparkSession.conf.get("spark.sql.shuffle.partitions")), "family", "i", "j")
    kind = split.schema["key"].dataType.simpleString()
    return blocks.groupBy("family", "i", "j").applyInArrow(_least_hashes(most, "across" if across else "within"), f"validation boolean, a {kind}, b {kind}")


def percent(*columns, salt: str = "") -> Column:
    """0 to 99 by hash."""
    return F.pmod(F.conv(F.substring(hash_order(*columns, salt=salt), 1, 8), 16, 10).cast("bigint"), F.lit(100))


def families(members: DataFrame, least: int = 1) -> DataFrame:
    """family, size of families with at least that many members."""
    return members.groupBy("family").agg(F.count(F.lit(1)).alias("size")).filter(F.col("size") >= least)


def split_families(members: DataFrame, validation: int = 20, salt: str = "split") -> DataFrame:
    """Adds validation (boolean): whole families, about that many percent of them."""
    return members.withColumn("validation", percent("family", salt=salt) < validation)


def attraction_pairs(members: DataFrame, most: int | None = None, salt: str = "attract") -> DataFrame:
    """family, a, b with a < b of one family; the first `most` in hash order if given."""
    left, right = members.select("family", F.col("key").alias("a")), members.select("family", F.col("key").alias("b"))
    pairs = left.join(right, "family").filter("a < b")
    return pairs if most is None else pairs.orderBy(hash_order("a", "b", salt=salt), "a", "b").limit(most)


def chain_pairs(members: DataFrame, salt: str = "chain") -> DataFrame:
    """family, a, b: each member with the next in hash order; as many pairs as members, whatever a family's size."""
    w = Window.partitionBy("family").orderBy(hash_order("key", salt=salt), "key")
    return members.select("family", F.col("key").alias("x"), F.lead("key").over(w).alias("y")).filter("y is not null").select("family", F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b"))


def repulsion_pairs(members: DataFrame, salt: str = "repulse", blocks: int = 64) -> DataFrame:
    """a, b (a < b) of different families: within blocks by hash, each member with the next in a random order."""
    block = F.pmod(F.conv(F.substring(hash_order("key", salt=salt + "-block"), 1, 8), 16, 10).cast("bigint"), F.lit(blocks))
    w = Window.partitionBy("block").orderBy(hash_order("key", salt=salt), "key")
    placed = members.select("key", "family", block.alias("block"))
    pairs = placed.select(F.col("key").alias("x"), F.col("family").alias("fx"), F.lead("key").over(w).alias("y"), F.lead("family").over(w).alias("fy"))
    return pairs.filter("y is not null and fx <> fy").select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).distinct()


def seen_split(members: DataFrame, salt: str = "seen") -> DataFrame:
    """Adds validation: one member of each family of two or more; the rest trains."""
    w = Window.partitionBy("family").orderBy(hash_order("key", salt=salt), "key")
    sized = members.withColumn("_n", F.count(F.lit(1)).over(Window.partitionBy("family")))
    return sized.withColumn("validation", (F.row_number().over(w) == 1) & (F.col("_n") > 1)).drop("_n")


def training_sets(split: DataFrame, most: int = 500_000, across: bool = False) -> DataFrame:
    """validation, attract, a, b: attraction and repulsion pairs of both sets, at most `most` attraction pairs each
    (the report's own limit), and as many repulsion pairs as attraction pairs where there are so many.

    split: key, family, validation. across: a validation member is paired with training members, as families are in both sets."""
    every = kept(least_attraction_pairs(split, most, across))
    out = []
    for validation in (False, True):
        attract = every.filter(F.col("validation") == validation).orderBy(hash_order("a", "b", salt="attract"), "a", "b").limit(most)
        some = repulsion_pairs(split.filter(F.col("validation") == validation)).orderBy(hash_order("a", "b", salt="match"), "a", "b").limit(attract.count())
        out += [x.select(F.lit(validation).alias("validation"), F.lit(kind).alias("attract"), "a", "b") for kind, x in ((True, attract), (False, some))]
    return out[0].unionByName(out[1]).unionByName(out[2]).unionByName(out[3])


def symbols_with_code(symbols: DataFrame, functions: DataFrame) -> DataFrame:
    """Symbols of functions that were found, by lower-cased name."""
    return symbols.join(functions.select("file_id", "address").distinct(), ["file_id", "address"], "left_semi").orderBy(F.lower("function_name"))
