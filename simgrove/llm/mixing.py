"""Mixing sources to target weights (operator 2): balanced sampling by the cube method.

A source's target over its size gives the same expected number of repeats for each of its documents.
The whole part is taken outright; the fractional parts are inclusion probabilities, and the cube
method's flight moves them through the null space of the balancing constraints (number of documents,
tokens) until all but a few are 0 or 1. Blocks fly by themselves; what is left in them, at most one
unit per constraint, flies on in larger company, until one block is left. LANDING of its units, one of
each size class, don't fly: with the two that the flight leaves they are the landing problem, solved by
trying every choice. All other units are decided by the flight, so their inclusion probabilities are exact.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .store import Workspace, broadcast_if_small, fresh_names

#: Units that fly together at most.
BLOCK = 2_000
#: Units of a source's last block that are kept for the landing.
LANDING = 14
#: Parts that equal rows are numbered in.
SALTS = 64
EPS = 1e-9


def word_count(text) -> Column:
    """Number of [^\\x20\\x09-\\x0D]+ in the text; 0 for null."""
    return F.coalesce(F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("bigint")


def targets(sizes: DataFrame, space: Workspace, weights: tuple[int, ...] = (1, 2, 3), most: float = 3.0) -> DataFrame:
    """source, source_size, target. Sources in code-point order, null last, weigh 1, 2, 3, 1, ... and share
    the size of all; a target stops at `most` times its source's size and the excess goes to the others by weight."""
    per = space.keep(sizes.groupBy("source").agg(F.sum("size").alias("source_size")), "sources", small=True)
    # A row per source: the numbering is a window over the sources only, not over documents.
    place = F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())) - 1
    weight = F.element_at(F.array(*[F.lit(w) for w in weights]), (place % len(weights) + 1).cast("int"))
    per = space.keep(per.select("source", "source_size", weight.alias("weight"), (F.col("source_size") * most).alias("limit")), "weights", small=True)
    total = per.agg(F.sum("source_size")).first()[0] or 0
    capped, rate = 0, None
    while True:
        # Sources above the last rate's cap keep their limit; the rest share what is left. Capped sources stay so, and
        # are counted: one without words adds nothing to the sum of limits, but its weight goes.
        under = per if rate is None else per.filter(F.col("weight") * F.lit(rate) <= F.col("limit"))
        number, over = (0, 0.0) if rate is None else per.filter(F.col("weight") * F.lit(rate) > F.col("limit")).agg(F.count(F.lit(1)), F.sum("limit")).first()
        share = under.agg(F.sum("weight")).first()[0]
        if not share or (rate is not None and number == capped):
            break
        rate, capped = (total - float(over or 0)) / float(share), number
    full = F.lit(rate if rate is not None else 0.0)
    return per.select("source", "source_size", F.least(F.col("limit"), F.col("weight") * full).cast("double").alias("target"))


def fly(p: np.ndarray, sizes: np.ndarray, rng: np.random.Generator) -> np.ndarray:
    """The flight: p with all but at most two entries 0 or 1; sums of p and of p * size stay."""
    p = p.copy()
    x = np.stack([np.ones(len(p)), sizes.astype(np.float64)])
    # Constraints of the sample per unit of inclusion probability, scaled for a sound null space.
    x[1] /= max(x[1].max(initial=0.0), 1.0)
    active = [i for i in range(len(p)) if EPS < p[i] < 1 - EPS]
    coins = rng.random(len(active) + 1)
    held, rest, step = active[:3], iter(active[3:]), 0
    a0, a1 = x[0].tolist(), x[1].tolist()
    while len(held) == 3:
        i, j, k = held
        # A vector of the null space of the 2 x 3 constraint matrix: the cross product of its rows.
        u = [a0[j] * a1[k] - a0[k] * a1[j], a0[k] * a1[i] - a0[i] * a1[k], a0[i] * a1[j] - a0[j] * a1[i]]
        if max(map(abs, u)) < 1e-12:
            u = [1.0, -1.0, 0.0]  # equal sizes: any exchange keeps both constraints
        up = down = float("inf")
        for c, v in zip(held, u, strict=True):
            if v > 0:
                up, down = min(up, (1 - p[c]) / v), min(down, p[c] / v)
            elif v < 0:
                up, down = min(up, p[c] / -v), min(down, (1 - p[c]) / -v)
        move = up if coins[step] * (up + down) < down else -down
        step += 1
        for c, v in zip(held, u, strict=True):
            p[c] += move * v
        left = []
        for c in held:
            if p[c] < EPS:
                p[c] = 0.0
            elif p[c] > 1 - EPS:
                p[c] = 1.0
            else:
                left.append(c)
        while len(left) < 3:
            following = next(rest, None)
            if following is None:
                break
            left.append(following)
        held = left
        if len(held) == 3 and step >= len(coins):
            coins, step = rng.random(len(p) + 1), 0
    return p


def reserve(sizes: np.ndarray, p: np.ndarray) -> np.ndarray:
    """Places of up to LANDING units that don't fly but wait for the landing: one of every size class, so that their
    sums are dense."""
    open_ = np.flatnonzero((p > EPS) & (p < 1 - EPS))
    if len(open_) <= LANDING:
        return open_
    order = open_[np.argsort(sizes[open_], kind="stable")]
    return order[np.linspace(0, len(order) - 1, LANDING).round().astype(int)]


def land(p: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """The small landing problem: of all choices among the units that are still open, LANDING + 2 at most, the
    one nearest to the expected tokens; among equally near ones, nearest to the expected number of documents."""
    open_ = np.flatnonzero((p > EPS) & (p < 1 - EPS))
    out = np.round(p)
    if len(open_):
        masks = np.arange(1 << len(open_), dtype=np.int64)
        tokens, units = np.zeros(len(masks)), np.zeros(len(masks))
        for i, o in enumerate(open_):
            chosen = (masks >> i) & 1
            tokens += chosen * float(sizes[o])
            units += chosen
        off = np.abs(tokens - float((p[open_] * sizes[open_]).sum()))
        near = np.flatnonzero(off <= off.min() + 1e-6)
        best = near[np.argmin(np.abs(units[near] - p[open_].sum()))]
        out[open_] = (best >> np.arange(len(open_))) & 1
    return out


def _flight(table: pa.Table) -> pa.Table:
    """One block; if it is all that is left of its source, it lands."""
    order = table.sort_by([("row", "ascending")])
    p, sizes, last = order["p"].to_numpy(), order["size"].to_numpy(), order["blocks"][0].as_py() == 1
    key = f"{order['group'][0].as_py()}:{len(p)}:{order['row'][0].as_py()}"
    rng = np.random.default_rng(int.from_bytes(hashlib.blake2b(key.encode(), digest_size=8).digest(), "little"))
    flying = np.ones(len(p), bool)
    if last:
        flying[reserve(sizes, p)] = False
    shuffled = rng.permutation(np.flatnonzero(flying))
    flown = p.copy()
    flown[shuffled] = fly(p[shuffled], sizes[shuffled], rng)
    if last:
        flown = land(flown, sizes)
    return pa.table({"row": order["row"], "group": order["group"], "size": order["size"], "p": pa.array(flown)})


def repeats(docs: DataFrame, weights: tuple[int, ...] = (1, 2, 3), most: int = 3) -> DataFrame:
    """One row per row of docs: doc_id, content (hash of the row), size, source_size, target, times.

    times, at most `most`, is how often the mix takes the document; the sum of size * times over a source
    comes within about a document of its target. Reruns agree: the flight's choices are drawn from the
    rows themselves. A null text has size 0, null sources are one source, repeated rows are units of their
    own; an empty table gives no rows. Other columns are ignored.
    """
    space = Workspace(docs.sparkSession, "mixing", docs)
    text = F.col("text").cast("string")
    sizes = docs.select("doc_id", F.col("source").cast("string").alias("source"), F.xxhash64("doc_id", "source", text).alias("content"), word_count(text).alias("size"))
    # Equal rows are numbered so that each is a unit with a key of its own that reruns reproduce.
    copies = sizes.groupBy("doc_id", "source", "content", "size").agg(F.count(F.lit(1)).alias("copies"))
    units = copies.select("doc_id", "source", "content", "size", F.explode(F.sequence(F.lit(1), F.col("copies").cast("int"))).alias("copy"))
    units = space.keep(units.withColumn("row", F.xxhash64("content", "copy", F.lit(7))), "units")
    goal = space.keep(targets(units, space, weights, float(most)), "targets", small=True)
    ratio = F.when(F.col("source_size") > 0, F.least(F.col("target") / F.col("source_size"), F.lit(float(most)))).otherwise(F.lit(0.0))
    aimed = goal.select(F.col("source").alias("_source"), "source_size", "target", ratio.alias("ratio"))
    joined = units.join(broadcast_if_small(aimed), F.col("source").eqNullSafe(F.col("_source"))).drop("_source")
    base = F.floor(F.col("ratio") + EPS).cast("double")
    group = F.coalesce(F.concat(F.lit("="), F.col("source")), F.lit("-"))
    planned = space.keep(joined.select("doc_id", "content", "copy", "row", "size", "source_size", "target", group.alias("group"), base.alias("base"), F.greatest(F.col("ratio") - base, F.lit(0.0)).alias("p")), "planned")
    schema = "row bigint, group string, size bigint, p double"

    flying = planned.filter(f"p > {EPS} and p < {1 - EPS}").select("row", "group", "size", "p")
    settled, level = [], 0
    while True:
        per = flying.groupBy("group").agg(F.ceil(F.count(F.lit(1)) / BLOCK).cast("int").alias("blocks"))
        per = space.keep(per, f"blocks{level}", small=True)
        if not per.limit(1).count():
            break
        dealt = flying.join(per, "group").withColumn("block", F.pmod(F.xxhash64("row", F.lit(level)), F.col("blocks")))
        flown = space.keep(dealt.select("row", "group", "size", "p", "block", "blocks").groupBy("group", "block").applyInArrow(_flight, schema), f"flown{level}")
        settled.append(flown.filter(f"p <= {EPS} or p >= {1 - EPS}").select("row", F.round("p").cast("int").alias("extra")))
        flying, level = flown.filter(f"p > {EPS} and p < {1 - EPS}"), level + 1
    out = planned
    if settled:
        extra = settled[0]
        for s in settled[1:]:
            extra = extra.unionByName(s)
        out = out.join(extra.hint("merge"), "row", "left")
    else:
        out = out.withColumn("extra", F.lit(0))
    times = (F.col("base") + F.coalesce("extra", F.round("p"), F.lit(0))).cast("int")
    return out.select("doc_id", "content", "copy", "size", "source_size", "target", F.least(times, F.lit(most)).alias("times"))


def mix_documents(docs: DataFrame, **how) -> DataFrame:
    """The rows of docs, each as often as the mix takes it, with all their columns. Rows equal in doc_id, source and
    text share their repeats: they are taken as often as all of them together, the first ones by their other columns
    once more where that doesn't come out even."""
    space = Workspace(docs.sparkSession, "mixed", docs)
    key, id_, content, times, rows, at, n = fresh_names(docs, "mix_key", "mix_id", "mix_content", "mix_times", "mix_rows", "mix_at", "mix_n")
    chosen = repeats(docs, **how).groupBy(F.col("doc_id").alias(id_), F.col("content").alias(content)).agg(F.sum("times").alias(times), F.count(F.lit(1)).alias(rows))
    chosen = space.keep(chosen.filter(F.col(times) > 0), "chosen", small=True)
    keyed = docs.withColumn(key, F.xxhash64("doc_id", F.col("source").cast("string"), F.col("text").cast("string")))
    joined = keyed.join(chosen.hint("merge"), keyed["doc_id"].eqNullSafe(chosen[id_]) & (keyed[key] == chosen[content])).select(*[keyed[c] for c in [*docs.columns, key]], times, rows)
    single = joined.filter(F.col(rows) == 1).withColumn(n, F.explode(F.sequence(F.lit(1), F.col(times).cast("int"))))
    single = single.select(*[single[c] for c in docs.columns])
    if not chosen.filter(F.col(rows) > 1).limit(1).count():
        return single
    # Equal rows are numbered, first in SALTS parts by their other columns, so that very many of them aren't one task's.
    others = [F.col(c).cast("string") for c in docs.columns]
    part, before = fresh_names(joined, "mix_part", "mix_before")
    several = joined.filter(F.col(rows) > 1).withColumn(part, F.pmod(F.xxhash64(*others), F.lit(SALTS)))
    sizes = several.groupBy("doc_id", key, part).agg(F.count(F.lit(1)).alias(n))
    earlier = Window.partitionBy("doc_id", key).orderBy(part).rowsBetween(Window.unboundedPreceding, -1)
    offsets = sizes.select(F.col("doc_id").alias(id_), F.col(key).alias(content), F.col(part).alias(at), F.coalesce(F.sum(n).over(earlier), F.lit(0)).alias(before))
    numbered = several.join(offsets, several["doc_id"].eqNullSafe(offsets[id_]) & (several[key] == offsets[content]) & (several[part] == offsets[at]))
    place = F.col(before) + F.row_number().over(Window.partitionBy("doc_id", key, part).orderBy(*others)) - 1
    number = F.floor(F.col(times) / F.col(rows)) + (place < F.col(times) % F.col(rows)).cast("int")
    numbered = numbered.select(*[several[c] for c in docs.columns], number.cast("int").alias(n)).filter(F.col(n) > 0)
    again = numbered.withColumn(times, F.explode(F.sequence(F.lit(1), F.col(n))))
    return single.unionByName(again.select(*[again[c] for c in docs.columns]))
