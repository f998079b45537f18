"""Line dedup (operator 6): overlapping windows of three lines.

Each three consecutive lines that hold a word are hashed; a window that also begins earlier (smaller
doc_id, or same document and earlier line) is a repeat, and the lines it covers are removed.
"""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .store import Workspace, broadcast_if_small, fresh_names

LINES = 3
_WORD = re.compile(r"[^\x20\x09-\x0D]")


def _windows(docs: DataFrame) -> DataFrame:
    """doc_id, content (document order), at (number of the window's first line), h1 and h2 (128 bits of its text)."""
    lines = F.filter(F.split("text", "\\n", -1), lambda line: line.rlike(r"[^\x20\x09-\x0D]"))
    numbered = docs.select("doc_id", "content", lines.alias("lines")).filter(F.size("lines") >= LINES)
    hashed = F.transform(
        F.sequence(F.lit(0), F.size("lines") - LINES),
        lambda i: F.struct(
            i.alias("at"),
            F.xxhash64(F.lit(1), *[F.get("lines", i + j) for j in range(LINES)]).alias("h1"),
            F.xxhash64(*[F.get("lines", i + j) for j in reversed(range(LINES))], F.lit(2)).alias("h2"),
        ),
    )
    return numbered.select("doc_id", "content", F.explode(hashed).alias("w")).select("doc_id", "content", "w.*")


def repeated_windows(docs: DataFrame, space: Workspace) -> DataFrame:
    """doc_id, content, starts: the first lines of the windows that begin earlier elsewhere. docs: doc_id, content, text.

    The least place of each window is found by partial minima, so a window of a third of all documents costs a row
    per task; only windows that stand more than once are kept to mark the later ones. They are broadcast where few,
    else joined by sorting, where a hot window may be split.
    """
    windows = _windows(docs)
    place = F.struct("doc_id", "content", "at")
    first = windows.groupBy("h1", "h2").agg(F.min(place).alias("first"), F.max(place).alias("last"))
    first = space.keep(first.filter("first < last").select("h1", "h2", "first"), "first", small=True)
    later = windows.join(broadcast_if_small(first), ["h1", "h2"]).filter(F.col("first") < place)
    return later.groupBy("doc_id", "content").agg(F.collect_set("at").alias("starts"))


def _clean(columns: list[str], starts_name: str):
    def run(batches):
        for batch in batches:
            texts, starts = batch.column("text").to_pylist(), batch.column(starts_name).to_pylist()
            out, counts = [], []
            for t, s in zip(texts, starts, strict=True):
                if not s:
                    out.append(t)
                    counts.append((0, 0, []))
                    continue
                lines = t.split("\n")
                holds = [i for i, line in enumerate(lines) if _WORD.search(line)]
                gone = np.zeros(len(holds) + 1, bool)
                for j in range(LINES):
                    gone[np.array(s) + j] = True
                spans = int((gone[1:] & ~gone[:-1]).sum() + gone[0])
                removed = {holds[i] for i in np.flatnonzero(gone)}
                out.append("\n".join(line for i, line in enumerate(lines) if i not in removed))
                counts.append((len(removed), spans, sorted(removed)))
            n, spans, removed = zip(*counts, strict=True) if counts else ((), (), ())
            made = {"text": pa.array(out, pa.string()), "n_removed": pa.array(n, pa.int64()), "n_spans": pa.array(spans, pa.int64()), "removed": pa.array(removed, pa.list_(pa.int64()))}
            yield pa.RecordBatch.from_arrays([made[c] if c in made else batch.column(c) for c in columns], names=columns)

    return run


def remove_repeated_windows(docs: DataFrame) -> DataFrame:
    """All columns of docs with text cleaned, and n_removed, n_spans, removed (numbers of removed lines, from 0).

    Lines are the parts of the text between newlines; those without a word belong to no window and are
    never removed. Documents are ordered by doc_id (null first), for equal doc_ids by a hash of the text;
    rows equal in both count as one document. n_spans: maximal runs of removed lines, counting only lines
    that hold a word. Texts with fewer than three such lines are unchanged; a null text stays null. An
    empty table gives an empty one; columns of docs with one of the new names are replaced.
    """
    space = Workspace(docs.sparkSession, "line-windows", docs)
    docs = docs.drop("n_removed", "n_spans", "removed").withColumn("text", F.col("text").cast("string"))
    columns = docs.columns
    key, id_, content, starts = fresh_names(docs, "line_key", "marked_id", "marked_content", "marked_starts")
    given = docs.select("doc_id", F.xxhash64("text").alias("content"), "text").filter(F.col("text").contains("\n"))
    marked = space.keep(repeated_windows(given, space), "marked", small=True)
    space.only("marked")
    marked = marked.select(F.col("doc_id").alias(id_), F.col("content").alias(content), F.col("starts").alias(starts))
    keyed = docs.withColumn(key, F.xxhash64("text"))
    joined = keyed.join(marked.hint("merge"), keyed["doc_id"].eqNullSafe(marked[id_]) & (keyed[key] == marked[content]), "left").select(*[keyed[c] for c in columns], starts)
    kinds = [f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema.fields]
    new = ["n_removed", "n_spans", "removed"]
    return joined.mapInArrow(_clean([*columns, *new], starts), ", ".join([*kinds, "n_removed bigint", "n_spans bigint", "removed array<bigint>"]))


ORACLE_SQL = r"""
WITH lines AS (
  SELECT doc_id, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS i FROM documents
), words AS (
  SELECT doc_id, line, i, row_number() OVER (PARTITION BY doc_id ORDER BY i) AS k FROM lines WHERE regexp_matches(line, '[^\x20\x09-\x0D]')
), windows AS (
  SELECT doc_id, k, line || chr(10) || lead(line, 1) OVER w || chr(10) || lead(line, 2) OVER w AS body
  FROM words WINDOW w AS (PARTITION BY doc_id ORDER BY k)
), later AS (
  SELECT doc_id, k FROM (SELECT doc_id, k, row_number() OVER (PARTITION BY body ORDER BY doc_id, k) AS place FROM windows WHERE body IS NOT NULL) t WHERE place > 1
), gone AS (
  SELECT DISTINCT doc_id, k + j AS k FROM later, (VALUES (0), (1), (2)) AS v(j)
), runs AS (
  SELECT doc_id, count(*) AS n_removed, count(*) FILTER (WHERE before IS NULL OR before < k - 1) AS n_spans
  FROM (SELECT doc_id, k, lag(k) OVER (PARTITION BY doc_id ORDER BY k) AS before FROM gone) t GROUP BY doc_id
), kept AS (
  SELECT l.doc_id, string_agg(l.line, chr(10) ORDER BY l.i) AS body
  FROM lines l LEFT JOIN words w USING (doc_id, i) LEFT JOIN gone g ON g.doc_id = w.doc_id AND g.k = w.k
  WHERE g.k IS NULL GROUP BY l.doc_id
)
SELECT d.doc_id, CAST(coalesce(r.n_removed, 0) AS BIGINT) AS n_removed, CAST(coalesce(r.n_spans, 0) AS BIGINT) AS n_spans, sha256(coalesce(k.body, '')) AS kept_sha256
FROM documents d LEFT JOIN runs r USING (doc_id) LEFT JOIN kept k USING (doc_id)
"""
