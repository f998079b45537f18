"""Learning feature weights from attraction and repulsion pairs.

Spark computes loss and gradient, the driver holds the weight vector: one number per feature of the training
functions. A pair's term touches only its own features, so the gradient travels as (feature, value) partial sums.
"""

from __future__ import annotations

from collections import deque
from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Smoothing constants of the loss, and the number that normalises a set of pairs.
STEP_SMOOTHING, DISTANCE_SMOOTHING, ROOT_SMOOTHING, PAIRS_UNIT = 1.0, 0.1, 0.01, 64.0


def signs(words: np.ndarray) -> np.ndarray:
    """+1 and -1 by bit of n 128-bit hashes (n x 2 words)."""
    bits = np.unpackbits(np.ascontiguousarray(words, "<i8").view(np.uint8).reshape(len(words), 16), axis=1, bitorder="little")
    return bits.astype(np.float64) * 2 - 1


def pair_loss(x: np.ndarray, y: np.ndarray, attract: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Loss of each pair of float states (n x 128), and its derivatives by x and y. Repulsion mirrors x."""
    turn = np.where(attract, 1.0, -1.0)[:, None]
    u = x * turn
    p, d = u * y, u - y
    root = np.sqrt(p * p + STEP_SMOOTHING)
    step = 1 - p / root
    by_p = -STEP_SMOOTHING / root**3
    away = np.sqrt(d * d + DISTANCE_SMOOTHING)
    far = np.sqrt(away + ROOT_SMOOTHING)
    by_d = d / away / (2 * far)
    return (step * far).sum(axis=1), turn * (by_p * y * far + step * by_d), by_p * u * far - step * by_d


def pair_losses(pairs: DataFrame) -> DataFrame:
    """Adds loss to pairs: attract, and the float states x and y of both sides (arrays of one length)."""
    columns = pairs.drop("x", "y").columns

    def run(batches):
        for batch in batches:
            n = batch.num_rows
            x, y = (batch.column(c).flatten().to_numpy(zero_copy_only=False).reshape(n, -1) if n else np.zeros((0, 1)) for c in "xy")
            loss = pair_loss(x, y, batch.column("attract").to_numpy(zero_copy_only=False).astype(bool))[0]
            yield pa.RecordBatch.from_arrays([*[batch.column(c) for c in columns], pa.array(loss)], names=[*columns, "loss"])

    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in pairs.schema.fields if f.name in columns)
    return pairs.mapInArrow(run, f"{kinds}, loss double")


def pair_features(pairs: DataFrame, features: DataFrame) -> DataFrame:
    """a, b, attract, fa, fb: both functions' features as arrays of (index, word a, word b). Pairs of unknown
    functions go. features: key, index, feature_a, feature_b; pairs: a, b, attract."""
    per = features.groupBy("key").agg(F.collect_list(F.struct("index", "feature_a", "feature_b")).alias("f"))
    return pairs.join(per.select(F.col("key").alias("a"), F.col("f").alias("fa")), "a").join(per.select(F.col("key").alias("b"), F.col("f").alias("fb")), "b")


def index_features(features: DataFrame) -> DataFrame:
    """feature_a, feature_b, index: dense numbers of the distinct features."""
    from .index import assign_ids

    distinct = features.select("feature_a", "feature_b").distinct()
    renamed = distinct.select(F.col("feature_a").alias("file_id"), F.col("feature_b").alias("address"), F.lit(0).alias("hash_a"), F.lit(0).alias("hash_b"))
    return assign_ids(renamed).select(F.col("file_id").alias("feature_a"), F.col("address").alias("feature_b"), (F.col("function_id") - 1).alias("index"))


def loss_and_gradient(terms: DataFrame, weights: np.ndarray, attracting: int, repelling: int) -> tuple[float, np.ndarray]:
    """Sum of the terms, each over its set's size / 64, and the gradient. terms as of pair_features."""
    held = terms.sparkSession.sparkContext.broadcast(weights)

    def run(batches):
        total, gradient = 0.0, {}
        for batch in batches:
            w = held.value
            for row in batch.to_pylist():
                each = []
                for side in ("fa", "fb"):
                    index = np.array([f["index"] for f in row[side]], np.int64)
                    each.append((index, signs(np.array([(f["feature_a"], f["feature_b"]) for f in row[side]], np.int64))))
                states = [(w[i][:, None] * s).sum(axis=0)[None] for i, s in each]
                loss, dx, dy = pair_loss(*states, np.array([row["attract"]]))
                unit = PAIRS_UNIT / (attracting if row["attract"] else repelling)
                total += float(loss[0]) * unit
                for (index, s), d in zip(each, (dx, dy), strict=True):
                    for i, g in zip(index.tolist(), (s @ d[0] * unit).tolist(), strict=True):
                        gradient[i] = gradient.get(i, 0.0) + g
        gradient[-1] = total
        yield pa.RecordBatch.from_arrays([pa.array(list(gradient), pa.int64()), pa.array(list(gradient.values()), pa.float64())], names=["index", "value"])

    rows = terms.mapInArrow(run, "index bigint, value double").groupBy("index").agg(F.sum("value").alias("value")).toPandas()
    held.destroy()
    out = np.zeros(len(weights))
    index, value = rows["index"].to_numpy(), rows["value"].to_numpy()
    out[index[index >= 0]] = value[index >= 0]
    return float(value[index == -1].sum()), out


def initial_weights(n: int, seed: int = 0) -> np.ndarray:
    return 1 + 0.01 * np.random.default_rng(seed).normal(size=n)


def lbfgs(f: Callable, w: np.ndarray, steps: int = 100, memory: int = 10, tolerance: float = 1e-8, snapshot: Callable | None = None) -> np.ndarray:
    """Limited-memory BFGS: two-loop recursion and a backtracking line search. snapshot(step, w) every 20 steps."""
    pairs: deque = deque(maxlen=memory)
    loss, g = f(w)
    for step in range(1, steps + 1):
        q, back = g.copy(), []
        for s, y, r in reversed(pairs):
            a = r * (s @ q)
            back.append(a)
            q -= a * y
        if pairs:
            s, y, _ = pairs[-1]
            q *= (s @ y) / (y @ y)
        else:
            q /= max(np.abs(g).max(), 1e-12)
        for (s, y, r), a in zip(pairs, reversed(back), strict=True):
            q += (a - r * (y @ q)) * s
        slope, size = -(g @ q), 1.0
        if slope >= 0:
            q, slope, _ = g.copy(), -(g @ g), pairs.clear()
        for _ in range(30):
            tried, tg = f(w - size * q)
            if tried <= loss + 1e-4 * size * slope:
                break
            size /= 2
        else:
            return w
        s, y = -size * q, tg - g
        if s @ y > 1e-12:
            pairs.append((s, y, 1 / (s @ y)))
        gain, w, loss, g = loss - tried, w + s, tried, tg
        if snapshot and step % 20 == 0:
            snapshot(step, w)
        if gain < tolerance * max(1.0, abs(loss)) or np.abs(g).max() < tolerance:
            break
    return w


def sgd(f: Callable, w: np.ndarray, steps: int = 500, enough: float = 1.0, snapshot: Callable | None = None) -> np.ndarray:
    """Gradient steps of length 10 / (largest component * step number), cut by 100 while they don't help; ends when
    the loss is below enough or the smoothed gain vanishes."""
    loss, g = f(w)
    smooth = None
    for step in range(1, steps + 1):
        most = np.abs(g).max()
        if loss < enough or most == 0:
            break
        size = 10 / (most * step)
        for _ in range(8):
            tried, tg = f(w - size * g)
            if tried < loss:
                break
            size /= 100
        else:
            break
        smooth = loss - tried if smooth is None else 0.9 * smooth + 0.1 * (loss - tried)
        w, loss, g = w - size * g, tried, tg
        if snapshot and step % 20 == 0:
            snapshot(step, w)
        if smooth < 1e-9 * max(1.0, loss):
            break
    return w


def train(features: DataFrame, attract: DataFrame, repulse: DataFrame, steps: int = 100, use_lbfgs: bool = True, seed: int = 0, snapshot: Callable | None = None) -> DataFrame:
    """feature_a, feature_b, weight. features: key, feature_a, feature_b; attract, repulse: a, b."""
    dictionary = index_features(features).cache()
    numbered = features.join(dictionary, ["feature_a", "feature_b"])
    pairs = attract.select("a", "b", F.lit(True).alias("attract")).unionByName(repulse.select("a", "b", F.lit(False).alias("attract")))
    terms = pair_features(pairs, numbered).cache()
    sizes = {r["attract"]: r["count"] for r in terms.groupBy("attract").count().collect()}
    n = dictionary.count()

    def f(w):
        return loss_and_gradient(terms, w, sizes.get(True, 1), sizes.get(False, 1))

    w = (lbfgs if use_lbfgs else sgd)(f, initial_weights(n, seed), steps, snapshot=snapshot)
    rows = features.sparkSession.createDataFrame(pa.table({"index": pa.array(range(n), pa.int64()), "weight": pa.array(w)}))
    return dictionary.join(rows, "index").select("feature_a", "feature_b", "weight")
