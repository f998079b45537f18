"""Quality rules (operator 4): document statistics and cross-document line frequency."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import kernels as K
from .store import Workspace, broadcast_if_small, fresh_names
from .token_counts import byte_slices

U = np.uint64
SYMBOLS = np.zeros(256, bool)
SYMBOLS[list(b"#*$%&|<>")] = True
STARTS_CODE_POINT = (np.arange(256) & 0xC0) != 0x80
NEWLINE = 0x0A
STATISTICS = "row bigint, doc_id {kind}, host string, content bigint, n_words bigint, word_chars bigint, n_symbols bigint, n_dup_lines bigint, n_repeat_words bigint, lines array<struct<line:bigint,words:int>>"


def _repeats_in_document(keys: np.ndarray, owners: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Flags of keys that stand twice or more in their document, and of those that also stand earlier in it."""
    own = K.mix(keys + owners.astype(U) * K.STEP)
    order = np.argsort(own, kind="stable")
    same = own[order][1:] == own[order][:-1]
    twice, again = np.zeros(len(keys), bool), np.zeros(len(keys), bool)
    again[order[1:][same]] = True
    twice[order[1:][same]] = twice[order[:-1][same]] = True
    return twice, again


def text_statistics(column: pa.Array) -> dict[str, np.ndarray]:
    """Per text n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words; and its distinct normalised lines
    (lower-cased words joined by one space) with their word counts, as flat arrays with bounds."""
    raw, bounds = K.text_bytes(column)
    n = len(bounds) - 1
    plain = K.PLAIN[raw]
    starts, ends = K.spans(plain, bounds)
    first = K.per_document(bounds, starts)
    n_words = np.diff(first)
    out = {"n_words": n_words, "word_chars": K.counts_between(plain & STARTS_CODE_POINT[raw], bounds), "n_symbols": K.counts_between(SYMBOLS[raw], bounds)}

    words = K.span_hashes(raw, starts, ends)
    owner = np.repeat(np.arange(n), n_words)
    windows = K.window_hashes(words, 5)
    inside = (np.arange(len(windows)) + 5) <= first[1:][owner[: len(windows)]]
    twice = np.zeros(len(windows), bool)
    twice[inside] = _repeats_in_document(windows[inside], owner[: len(windows)][inside])[0]
    change = np.zeros(len(words) + 6, np.int64)
    np.add.at(change, np.flatnonzero(twice), 1)
    np.add.at(change, np.flatnonzero(twice) + 5, -1)
    out["n_repeat_words"] = K.counts_between(np.cumsum(change)[: len(words)] > 0, first)

    l_starts, l_ends = K.spans(raw != NEWLINE, bounds)
    l_first = np.searchsorted(starts, l_starts, "left")
    l_words = np.searchsorted(starts, l_ends, "left") - l_first
    real = l_words > 0
    l_starts, l_ends, l_first, l_words = l_starts[real], l_ends[real], l_first[real], l_words[real]
    l_owner = np.searchsorted(bounds, l_starts, "right") - 1
    again = _repeats_in_document(K.span_hashes(raw, l_starts, l_ends), l_owner)[1]
    l_bounds = np.searchsorted(l_owner, np.arange(n + 1), "left")
    out["n_dup_lines"] = K.counts_between(again, l_bounds)

    lower = K.span_hashes(K.LOWER[raw], starts, ends)
    if len(l_first):
        k = np.arange(len(words)) - np.repeat(l_first, l_words)
        line = K.mix(np.add.reduceat(K.mix(lower + k.astype(U) * K.STEP), l_first) + l_words.astype(U))
    else:
        line = np.zeros(0, U)
    fresh = ~_repeats_in_document(line, l_owner)[1]
    out |= {"line": line[fresh], "line_words": l_words[fresh], "line_bounds": np.searchsorted(l_owner[fresh], np.arange(n + 1), "left")}
    return out


def _host(source: Column) -> Column:
    return F.coalesce(F.concat(F.lit("="), source.cast("string")), F.lit("-"))


def _statistics(docs: DataFrame) -> DataFrame:
    def run(batches):
        row = TaskContext.get().partitionId() << 36
        for whole in batches:
            for batch in byte_slices(whole, "text"):
                s = text_statistics(batch.column("text"))
                m = batch.num_rows
                lines = pa.StructArray.from_arrays([pa.array(s["line"].view(np.int64)), pa.array(s["line_words"].astype(np.int32))], ["line", "words"])
                counts = [pa.array(s[c].astype(np.int64)) for c in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.arange(row, row + m)), batch.column("doc_id"), batch.column("host"), batch.column("content"), *counts, pa.ListArray.from_arrays(pa.array(s["line_bounds"].astype(np.int32)), lines)],
                    names=["row", "doc_id", "host", "content", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "lines"],
                )
                row += m

    given = docs.select("doc_id", _host(F.col("source")).alias("host"), F.xxhash64("text").alias("content"), F.col("text").cast("string").alias("text"))
    return given.mapInArrow(run, STATISTICS.format(kind=docs.schema["doc_id"].dataType.simpleString()))


def quality(docs: DataFrame, min_documents: int = 5, host_share: float = 0.10, left_share: float = 0.2, min_words: int = 10) -> DataFrame:
    """One row per row of docs: doc_id, host, content (hash of the text), n_words, word_chars, n_symbols, n_dup_lines,
    n_repeat_words, base_failed, kept, n_lines_removed, n_words_left.

    Lines are normalised (words lower-cased, one space) and hashed; for each host (source) the distinct documents that
    hold a line are counted. A line is above the limits when more than host_share of the host's documents hold it,
    and more than min_documents: in fewer, nothing can be called frequent. Such lines are removed, whatever stands
    around them. A document is kept unless the base rule fails it or fewer than min_words words, or less than left_share
    of its words, are left.

    A null or empty text has no words and fails the base rule. Null sources form one host. Rows equal in doc_id, source
    and text are one document, each with its row. An empty table gives no rows; other columns are ignored.
    Hot lines and hosts meet in partial counts before any shuffle. Frequent lines are at most 1 / host_share for each
    line of a host's average document; they are broadcast if few, else the join may be split where skewed.
    """
    space = Workspace(docs.sparkSession, "quality", docs)
    stats = space.keep(_statistics(docs), "statistics")
    exploded = stats.select("row", "host", "doc_id", "content", F.explode("lines").alias("l")).select("row", "host", "doc_id", "content", "l.*")
    held = exploded.select("host", "line", "doc_id", "content").distinct()
    seen = held.groupBy("host", "line").agg(F.count(F.lit(1)).alias("documents")).filter(F.col("documents") > min_documents)
    hosts = stats.select("host", "doc_id", "content").distinct().groupBy("host").agg(F.count(F.lit(1)).alias("host_documents"))
    above = seen.join(hosts, "host").filter(F.col("documents") > host_share * F.col("host_documents"))
    above = space.keep(above.select("host", "line"), "above", small=True)
    lost = exploded.select("row", "host", "line", "words").join(broadcast_if_small(above), ["host", "line"]).groupBy("row").agg(F.count(F.lit(1)).alias("n_lines_removed"), F.sum("words").alias("gone"))
    judged = stats.drop("lines").join(lost.hint("merge"), "row", "left").fillna(0, ["n_lines_removed", "gone"])
    left = F.col("n_words") - F.col("gone")
    failed = (F.col("n_words") < 10) | (100 * F.col("n_repeat_words") > 20 * F.col("n_words"))
    depleted = (F.col("gone") > 0) & ((left < min_words) | (left < left_share * F.col("n_words")))
    return judged.select("doc_id", "host", "content", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", failed.alias("base_failed"), (~failed & ~depleted).alias("kept"), "n_lines_removed", left.alias("n_words_left"))


def keep_good(docs: DataFrame, **limits) -> DataFrame:
    """The rows of docs that quality() keeps, with all their columns. A verdict depends only on doc_id, source and
    text, so it is carried back by these."""
    space = Workspace(docs.sparkSession, "quality-rejects", docs)
    id_, host, content = fresh_names(docs, "rejected_id", "rejected_host", "rejected_content")
    rejects = quality(docs, **limits).filter(~F.col("kept")).select(F.col("doc_id").alias(id_), F.col("host").alias(host), F.col("content").alias(content))
    rejects = space.keep(rejects.distinct(), "rejects", small=True)
    same = docs["doc_id"].eqNullSafe(rejects[id_]) & (_host(docs["source"]) == rejects[host]) & (F.xxhash64(docs["text"]) == rejects[content])
    return docs.join(rejects.hint("merge"), same, "left_anti")


#: The same rows. Words: w; windows of five words, their texts with how often they stand in the document; lines.
ORACLE_SQL = r"""
WITH texts AS (
  SELECT doc_id, coalesce('=' || source, '-') AS host, coalesce(text, '') AS text, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents
), base AS (
  SELECT doc_id, host, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(list_sum(list_transform(w, lambda x: length(x))), 0) AS BIGINT) AS word_chars,
    CAST(length(regexp_replace(text, '[^#*$%&|<>]', '', 'g')) AS BIGINT) AS n_symbols FROM texts
), windows AS (
  SELECT doc_id, i, array_to_string(w[i : i + 4], ' ') AS five FROM (SELECT doc_id, w, unnest(range(1, len(w) - 3)) AS i FROM texts WHERE len(w) >= 5)
), twice AS (
  SELECT doc_id, i FROM windows QUALIFY count(*) OVER (PARTITION BY doc_id, five) > 1
), repeated AS (
  SELECT doc_id, count(DISTINCT i + j) AS n_repeat_words FROM twice, (VALUES (0), (1), (2), (3), (4)) v(j) GROUP BY doc_id
), lines AS (
  SELECT doc_id, host, line, regexp_extract_all(line, '[^\x20\x09-\x0D]+') AS w FROM (SELECT doc_id, host, unnest(string_split(text, chr(10))) AS line FROM texts)
), held AS (
  SELECT doc_id, host, line, translate(array_to_string(w, ' '), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS norm, len(w) AS words FROM lines WHERE len(w) > 0
), dups AS (
  SELECT doc_id, count(*) - count(DISTINCT line) AS n_dup_lines FROM held GROUP BY doc_id
), own AS (
  SELECT DISTINCT doc_id, host, norm, words FROM held
), hosts AS (
  SELECT host, count(DISTINCT doc_id) AS n FROM texts GROUP BY host
), above AS (
  SELECT o.host, o.norm FROM own o JOIN hosts h ON h.host = o.host GROUP BY o.host, o.norm, h.n HAVING count(*) > 5 AND count(*) > 0.10 * h.n
), lost AS (
  SELECT o.doc_id, count(*) AS n_lines_removed, sum(o.words) AS gone FROM own o JOIN above a ON a.host = o.host AND a.norm = o.norm GROUP BY o.doc_id
), joined AS (
  SELECT b.*, CAST(coalesce(d.n_dup_lines, 0) AS BIGINT) AS n_dup_lines, CAST(coalesce(r.n_repeat_words, 0) AS BIGINT) AS n_repeat_words,
    CAST(coalesce(l.n_lines_removed, 0) AS BIGINT) AS n_lines_removed, CAST(n_words - coalesce(l.gone, 0) AS BIGINT) AS n_words_left
  FROM base b LEFT JOIN dups d USING (doc_id) LEFT JOIN repeated r USING (doc_id) LEFT JOIN lost l USING (doc_id)
), failed AS (
  SELECT *, n_words < 10 OR 100 * n_repeat_words > 20 * n_words AS base_failed FROM joined
)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
  NOT base_failed AND NOT (n_words_left < n_words AND (n_words_left < 10 OR n_words_left < 0.2 * n_words)) AS kept, n_lines_removed, n_words_left
FROM failed
"""
