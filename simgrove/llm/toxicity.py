"""Toxicity (operator 10): a weighted finite-state pattern grammar over clauses.

A clause (up to sentence punctuation or a line's end) is a string of word classes: insult, threat, modal,
target, negation, reporting, other. The insults, words and word beginnings that stand in toxic documents far
more often than in others, are learned from labelled documents. Five small transducers are composed into one
table of states: negation (its scope is the next three words), reported speech (to the clause's end), target
(one within three words before or after an insult), insult and threat (a violent verb; aimed, where a modal stands
before and a target follows). The table reads a clause once and emits its matches by channel: plain, aimed and
doubted insults, plain, aimed and doubted threats. A document's matches per channel, and its strongest clause,
go through a logistic curve whose weights are fitted on the same labelled documents. Language, source, labels
and ids are never inputs.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import kernels as K
from .store import Workspace
from .token_counts import byte_slices

U = np.uint64

#: Labelled rows that the classifier is fitted on, at most: those with the smallest crc32 of their id.
MAX_TRAINING_ROWS = 20_000
PREFIXES = (4, 5, 6)
LETTERS = np.zeros(256, bool)
LETTERS[0x41:0x5B] = LETTERS[0x61:0x7B] = LETTERS[0x80:] = True
CLAUSE_ENDS = np.zeros(256, bool)
CLAUSE_ENDS[list(b".!?;:\n")] = True

#: Closed word classes of the grammar, for the four languages of the corpus.
WORD_CLASSES = {
    "threat": "kill hurt destroy die burn crush beat stab töten sterben zerstören verbrennen schlagen tuer mourir détruire brûler frapper matar morir destruir quemar golpear",
    "modal": "will shall should must gonna going hope werde werden wird sollst musst hoffe vais va vas dois devrais espère voy va vas debes deberías espero",
    "target": "you your yours yourself they them he she him her du dich dir dein euch ihr sie er tu toi ton vous votre ils elles él ella tú usted ustedes ellos",
    "negation": "not never no nor neither cannot nicht nie kein keine keinen niemals ne pas jamais aucun nunca jamás ningún tampoco",
    "reported": "said says told wrote writes called quoted claimed sagte sagt schrieb behauptete dit disait écrit déclaré dijo dice escribió llamó",
}
#: Input symbols, by rising priority where a word has several.
SYMBOLS = ("other", "target", "modal", "reported", "negation", "threat", "insult")
#: Output channels; 0 is no output.
CHANNELS = ("", "insult", "insult aimed", "insult doubted", "threat", "threat aimed", "threat doubted")
#: Words that a negation reaches, and that may stand between an insult and its target.
REACH = 3


class Transducer:
    """start state, and step(state, symbol, tags) -> (state, tags): what it adds to the tags of the word it reads."""

    def __init__(self, start, step):
        self.start, self.step = start, step


def _negation(left, symbol, tags):
    if symbol == "negation":
        return REACH, tags
    return max(left - 1, 0), tags | {"doubted"} if left else tags


def _reported(on, symbol, tags):
    return on or symbol == "reported", tags | {"doubted"} if on else tags


def _target(left, symbol, tags):
    if symbol == "target":
        return REACH, tags
    return max(left - 1, 0), tags | {"aimed"} if left else tags


def _insult(left, symbol, tags):
    """An insult that has no target before it waits for one behind it."""
    if symbol == "insult":
        channel = "insult doubted" if "doubted" in tags else "insult aimed" if "aimed" in tags else "insult"
        return REACH if channel == "insult" else 0, tags | {channel}
    if symbol == "target" and left:
        return 0, tags | {"insult aimed"}
    return max(left - 1, 0), tags


def _threat(stage, symbol, tags):
    """Stages: 0; 1 behind a modal; 2 behind a modal and a violent verb."""
    if symbol == "threat":
        return (2 if stage else 0), tags | {"threat doubted" if "doubted" in tags else "threat"}
    if symbol == "target" and stage == 2:
        return 0, tags | {"threat aimed"}
    return max(stage, 1) if symbol == "modal" else stage, tags


#: The grammar: read in this order, each sees the tags of those before it.
GRAMMAR = (Transducer(0, _negation), Transducer(False, _reported), Transducer(0, _target), Transducer(0, _insult), Transducer(0, _threat))


def compose(parts: tuple[Transducer, ...] = GRAMMAR) -> tuple[np.ndarray, np.ndarray]:
    """following (state, symbol -> state) and emits (state, symbol, channel -> matches) of the parts' composition; state 0
    is the start, other states are numbered as they are reached."""
    states, following, emits = {tuple(p.start for p in parts): 0}, [], []
    waiting = list(states)
    while waiting:
        state = waiting.pop(0)
        row, out = [], []
        for symbol in SYMBOLS:
            reached, tags = [], frozenset()
            for part, at in zip(parts, state, strict=True):
                at, tags = part.step(at, symbol, tags)
                reached.append(at)
            reached = tuple(reached)
            if reached not in states:
                states[reached] = len(states)
                waiting.append(reached)
            row.append(states[reached])
            out.append([0, *[int(c in tags) for c in CHANNELS[1:]]])
        following.append(row)
        emits.append(out)
    return np.array(following), np.array(emits, np.int8)


def letter_words(raw: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    return K.spans(LETTERS[raw], bounds)


def features(raw: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> list[np.ndarray]:
    """Hashes of each word and of its first 4, 5 and 6 bytes (0 where it is not longer)."""
    out = [K.span_hashes(raw, starts, ends)]
    for n in PREFIXES:
        longer = ends - starts > n
        hashes = np.zeros(len(starts), U)
        hashes[longer] = K.span_hashes(raw, starts[longer], starts[longer] + n, salt=n)
        out.append(hashes)
    return out


def _class_hashes() -> dict[str, np.ndarray]:
    out = {}
    for name, words in WORD_CLASSES.items():
        column = pa.array(words.split())
        raw, bounds = K.text_bytes(column)
        out[name] = np.sort(K.span_hashes(raw, bounds[:-1], bounds[1:]))
    return out


def _among(values: np.ndarray, table: np.ndarray) -> np.ndarray:
    """Index of each value in the sorted table, -1 where it is absent."""
    if not len(table):
        return np.full(len(values), -1)
    at = np.minimum(np.searchsorted(table, values), len(table) - 1)
    return np.where(table[at] == values, at, -1)


class Grammar:
    """keys: sorted hashes of the lexicon; weights: of each, between 0 and 1."""

    def __init__(self, keys: np.ndarray, weights: np.ndarray, parts: tuple[Transducer, ...] = GRAMMAR):
        self.keys, self.weights, self.classes = keys, weights, _class_hashes()
        self.following, self.emits = compose(parts)

    def evidence(self, column: pa.Array) -> np.ndarray:
        """Per text: matches of each channel, an insult counting by its lexical weight, and in the first column the
        strongest clause, its matches that aren't doubted."""
        raw, bounds = K.text_bytes(column)
        out = np.zeros((len(bounds) - 1, len(CHANNELS)))
        lower = K.LOWER[raw]
        starts, ends = letter_words(lower, bounds)
        if not len(starts):
            return out
        insult = np.zeros(len(starts))
        whole = None
        for hashes in features(lower, starts, ends):
            whole = hashes if whole is None else whole
            at = _among(hashes, self.keys)
            insult = np.maximum(insult, np.where(at >= 0, self.weights[at] if len(self.weights) else 0.0, 0.0))
        symbol = np.zeros(len(starts), np.int64)
        for i, name in enumerate(SYMBOLS):
            if name in self.classes:
                symbol[_among(whole, self.classes[name]) >= 0] = i
        symbol[insult > 0] = SYMBOLS.index("insult")
        # Clauses: a word begins one if a clause end or a document's start lies between it and the word before.
        stops = np.zeros(len(raw) + 1, np.int64)
        np.cumsum(CLAUSE_ENDS[raw], out=stops[1:])
        owner = np.searchsorted(bounds, starts, "right") - 1
        begins = np.ones(len(starts), bool)
        begins[1:] = (stops[starts[1:]] > stops[starts[:-1]]) | (owner[1:] != owner[:-1])
        first = np.flatnonzero(begins)
        length = np.diff(np.append(first, len(starts)))
        # Only clauses with an insult or a threat can match. They are read in step, longest first.
        can = np.add.reduceat((symbol >= SYMBOLS.index("threat")).astype(np.int64), first) > 0
        first, length = first[can], length[can]
        order = np.argsort(-length, kind="stable")
        first, length = first[order], length[order]
        state, matches = np.zeros(len(first), np.int64), np.zeros((len(first), len(CHANNELS)))
        going = np.searchsorted(-length, -np.arange(1, int(length.max(initial=0)) + 1), "right")
        for t, n in enumerate(going.tolist()):
            word = first[:n] + t
            read = symbol[word]
            emitted = self.emits[state[:n], read]
            hit = np.flatnonzero(emitted.any(axis=1))
            if len(hit):
                weight = np.where(insult[word[hit]] > 0, insult[word[hit]], 1.0)
                matches[hit] += emitted[hit] * weight[:, None]
            state[:n] = self.following[state[:n], read]
        sure = [CHANNELS.index(c) for c in ("insult", "insult aimed", "threat aimed")]
        document = owner[first]
        np.add.at(out, document, matches)
        out[:, 0] = 0.0
        np.maximum.at(out[:, 0], document, matches[:, sure].sum(axis=1))
        return out


def _feature_counts(sample: DataFrame) -> DataFrame:
    """feature, documents with it that are toxic, documents with it that are not; of the sample."""

    def run(batches):
        for whole in batches:
            for batch in byte_slices(whole, "text"):
                raw, bounds = K.text_bytes(batch.column("text"))
                lower = K.LOWER[raw]
                starts, ends = letter_words(lower, bounds)
                owner = np.searchsorted(bounds, starts, "right") - 1
                toxic = batch.column("toxic").to_numpy(zero_copy_only=False).astype(bool)
                found, value = [], []
                for hashes in features(lower, starts, ends):
                    real = hashes != 0
                    pair = np.stack([hashes[real], owner[real].astype(U)], axis=1)
                    order = np.lexsort((pair[:, 1], pair[:, 0]))
                    pair = pair[order]
                    fresh = np.ones(len(pair), bool)
                    fresh[1:] = (pair[1:] != pair[:-1]).any(axis=1)
                    found.append(pair[fresh, 0])
                    value.append(toxic[pair[fresh, 1].astype(np.int64)])
                found, value = np.concatenate(found), np.concatenate(value)
                keys, back = np.unique(found, return_inverse=True)
                yes = np.bincount(back, weights=value, minlength=len(keys)).astype(np.int64)
                yield pa.RecordBatch.from_arrays([pa.array(keys.view(np.int64)), pa.array(yes), pa.array(np.bincount(back, minlength=len(keys)) - yes)], names=["feature", "yes", "no"])

    return sample.mapInArrow(run, "feature bigint, yes bigint, no bigint").groupBy("feature").agg(F.sum("yes").alias("yes"), F.sum("no").alias("no"))


def held_out(doc_id) -> F.Column:
    return F.crc32(doc_id.cast("string")) % 5 == 0


def training_sample(docs: DataFrame, labels: DataFrame, most: int = MAX_TRAINING_ROWS) -> DataFrame:
    """text, toxic of labelled documents outside the held-out fifth; at most `most` labelled rows, by crc32 of the id.
    A document with several labels is toxic if one of them says so."""
    known = labels.select(F.col("doc_id").alias("labelled"), F.col("toxic").cast("int").alias("toxic")).filter(F.col("labelled").isNotNull() & F.col("toxic").isNotNull() & ~held_out(F.col("labelled")))
    known = known.groupBy("labelled").agg(F.max("toxic").alias("toxic")).orderBy(F.crc32(F.col("labelled").cast("string")), "labelled").limit(most)
    texts = docs.select(F.col("doc_id").alias("id"), F.col("text").cast("string").alias("text"))
    return texts.join(F.broadcast(known), F.col("id") == F.col("labelled")).select("text", "toxic")


def lexicon(sample: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """Sorted hashes and weights of the words and word beginnings that stand far more often in toxic documents."""
    n = dict(sample.groupBy("toxic").count().collect())
    yes, no = n.get(1, 0), n.get(0, 0)
    if not yes:
        return np.zeros(0, U), np.zeros(0)
    odds = F.log((F.col("yes") + 0.1) / (yes + 0.2)) - F.log((F.col("no") + 0.1) / (no + 0.2))
    # So no more than 50 times the features of an average toxic document of the sample can be entries.
    support = max(3, round(0.02 * yes))
    rows = _feature_counts(sample).filter(F.col("yes") >= support).select("feature", "yes", "no", odds.alias("odds")).filter(F.col("odds") > 2.0).toPandas()
    hashed = rows["feature"].to_numpy(np.int64).view(U)
    order = np.argsort(hashed)
    share = (rows["yes"] + 0.1) / (rows["yes"] + rows["no"] * yes / max(no, 1) + 0.2)
    # A word seen in few documents may be there by chance: its weight is lower.
    certainty = 1 - np.exp(-rows["yes"] / max(6.0, 0.01 * yes))
    return hashed[order], (share * certainty).to_numpy()[order]


def fit(docs: DataFrame, labels: DataFrame, space: Workspace, most: int = MAX_TRAINING_ROWS) -> tuple[Grammar, np.ndarray]:
    """The grammar and the curve's weights (constant, strongest clause, channels). With no toxic row, scores stay near 0.

    The curve is fitted on what each half of the sample shows through the other half's lexicon, so that words that
    are toxic by chance don't count as evidence."""
    sample = space.keep(training_sample(docs, labels, most).withColumn("fold", F.pmod(F.xxhash64("text"), F.lit(2))), "sample")
    halves = [sample.filter(F.col("fold") == i) for i in range(2)]
    tables = [_evidence(half, Grammar(*lexicon(other))).toPandas() for half, other in zip(halves, reversed(halves), strict=True)]
    x = _shape(np.array([f for t in tables for f in t["found"]]).reshape(-1, len(CHANNELS)))
    y = np.concatenate([t["toxic"].to_numpy(np.float64) for t in tables])
    w = _logistic(x, y)
    w[0] -= _best_cut(x @ w, y)
    grammar = Grammar(*lexicon(sample))
    space.only()
    return grammar, w


def _best_cut(z: np.ndarray, y: np.ndarray) -> float:
    """The cut with the fewest errors on the sample, half way between two values; it becomes a score of 0.5."""
    if not y.any() or y.all():
        return 0.0
    order = np.argsort(z)
    z, y = z[order], y[order]
    errors = np.concatenate([[0], np.cumsum(y)]) + (len(y) - y.sum()) - np.concatenate([[0], np.cumsum(1 - y)])
    possible = np.flatnonzero(z[1:] > z[:-1]) + 1
    if not len(possible):
        return 0.0
    at = possible[np.argmin(errors[possible])]
    return float((z[at - 1] + z[at]) / 2)


def _evidence(sample: DataFrame, grammar: Grammar) -> DataFrame:
    def run(batches):
        for whole in batches:
            for batch in byte_slices(whole, "text"):
                found = grammar.evidence(batch.column("text"))
                yield pa.RecordBatch.from_arrays([batch.column("toxic"), pa.array(found.tolist(), pa.list_(pa.float64()))], names=["toxic", "found"])

    return sample.select("toxic", "text").mapInArrow(run, "toxic int, found array<double>")


def _shape(found: np.ndarray) -> np.ndarray:
    """Constant, strongest clause, logarithms of the channels' matches."""
    return np.concatenate([np.ones((len(found), 1)), found[:, :1], np.log1p(found[:, 1:])], axis=1)


def _logistic(x: np.ndarray, y: np.ndarray, ridge: float = 0.02) -> np.ndarray:
    """Ridge logistic regression by Newton steps."""
    w = np.zeros(x.shape[1])
    if not len(y) or not y.any():
        return np.concatenate([[-3.0], np.zeros(x.shape[1] - 1)])
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        gradient = x.T @ (p - y) + ridge * w
        hessian = (x * (p * (1 - p))[:, None]).T @ x + ridge * np.eye(len(w))
        step = np.linalg.solve(hessian, gradient)
        w -= step
        if np.abs(step).max() < 1e-8:
            break
    return w


def score_toxicity(docs: DataFrame, labels: DataFrame, most: int = MAX_TRAINING_ROWS) -> DataFrame:
    """One row per row of docs: doc_id, held_out, score (0 to 1), predicted (1 if score >= 0.5, else 0).

    Fitted on at most `most` labelled rows outside the held-out fifth; every document is scored whole.
    A null or empty text has no evidence and gets the curve's constant. A null doc_id is not held out.
    Repeated rows get a row each, an empty table none; without labels every score is low and equal.
    """
    space = Workspace(docs.sparkSession, "toxicity", docs)
    grammar, w = fit(docs, labels, space, most)

    def run(batches):
        for whole in batches:
            for batch in byte_slices(whole, "text"):
                score = 1 / (1 + np.exp(-np.clip(_shape(grammar.evidence(batch.column("text"))) @ w, -30, 30)))
                yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("held_out"), pa.array(score), pa.array((score >= 0.5).astype(np.int32))], names=["doc_id", "held_out", "score", "predicted"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    given = docs.select("doc_id", F.coalesce(held_out(F.col("doc_id")), F.lit(False)).alias("held_out"), F.col("text").cast("string").alias("text"))
    return given.mapInArrow(run, f"doc_id {kind}, held_out boolean, score double, predicted int")
