"""Suffix-array dedup (operator 1): bytes of strings of 100 that also start earlier.

A suffix array of the whole corpus would need all of it in one place. Two equal strings of `length`
bytes also hold the same anchor: the k-gram with the least hash among theirs. So

1. every text is cut into segments, runs of windows (strings of `length` bytes) with one anchor;
   equal segments are found by a hash of their text, and only the first of each is looked at further;
2. different segments with an equal anchor come together with their text. The suffixes at their windows
   are sorted, the array of common prefixes is scanned with a stack, and each interval whose members differ
   in the byte before them is a maximal repeat, reported with all its occurrences;
3. of each repeat all occurrences but the earliest are covered; covered bytes are removed.

An anchor with very many different segments is dealt over several blocks; what each block leaves as
its first occurrence of a window meets the other blocks' by the window's 128-bit hash.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import kernels as K
from .store import Workspace, in_document_order, shuffle_width
from .token_counts import byte_slices

U = np.uint64
GRAM = 32
#: Different segments of one anchor that are sorted together; more are dealt over blocks.
GROUP = 1000
#: Bytes of segments that are sorted at once.
BLOCK_BYTES = 1_500_000
SECOND_CODE = np.random.Generator(np.random.PCG64(977)).integers(0, 2**64, 256, dtype=U) | U(1)
_M = 2**64
_INVERSE = pow(int(K.STEP), -1, _M)

SEGMENTS = "key bigint, a bigint, b bigint, ord bigint, at bigint"
OCCURRENCES = "contested boolean, key bigint, ord bigint, start bigint, length bigint, windows int"


def gram_hashes(raw: np.ndarray, k: int) -> np.ndarray:
    """Hash of raw[i : i + k] for each i (of what is left, near the end), by doubling."""
    n, total, done, size, part = len(raw), None, 0, 1, K.BYTE_CODE[raw]
    while True:
        if k & 1:
            shifted = np.zeros(n, U)
            if done < n:
                shifted[: n - done] = part[done:]
            shifted *= U(pow(int(K.STEP), done, _M))
            total = shifted if total is None else total + shifted
            done += size
        k >>= 1
        if not k:
            return K.mix(total)
        following = part.copy()
        if size < n:
            following[: n - size] += part[size:] * U(pow(int(K.STEP), size, _M))
        part, size = following, size * 2


def sliding_minimum(keys: np.ndarray, width: int) -> np.ndarray:
    def meet(x, step):
        out = x.copy()
        if step < len(x):
            np.minimum(x[:-step], x[step:], out=out[:-step])
        return out

    size = 1
    while size * 2 <= width:
        keys, size = meet(keys, size), size * 2
    return meet(keys, width - size) if size < width else keys


def segments(raw: np.ndarray, bounds: np.ndarray, length: int) -> dict[str, np.ndarray]:
    """The segments of a batch: doc (index), start (in the document), windows, anchor, a, b (hashes of text and shape)."""
    n, k = len(raw), min(GRAM, length)
    size = np.diff(bounds)
    if n < length:
        return {c: np.zeros(0, np.int64 if c in ("doc", "start", "windows") else U) for c in ("doc", "start", "windows", "anchor", "a", "b")}
    grams = gram_hashes(raw, k)
    keyed = (grams & U(0xFFFFFFFF00000000)) | np.arange(n, dtype=U)
    where = (sliding_minimum(keyed, length - k + 1) & U(0xFFFFFFFF)).astype(np.int64)
    inside = np.zeros(n + 1, np.int8)
    long = size >= length
    np.add.at(inside, bounds[:-1][long], 1)
    np.add.at(inside, bounds[1:][long] - length + 1, -1)
    valid = np.flatnonzero(np.cumsum(inside[:-1], dtype=np.int8))
    spot = where[valid]
    new = np.ones(len(valid), bool)
    new[1:] = (spot[1:] != spot[:-1]) | (valid[1:] != valid[:-1] + 1)
    first = np.flatnonzero(new)
    begin, windows = valid[first], np.diff(np.append(first, len(valid)))
    spot, end = spot[first], begin + windows - 1 + length
    power, inverse = np.full(n + 1, K.STEP, U), np.full(n + 1, U(_INVERSE), U)
    power[0] = inverse[0] = 1
    np.multiply.accumulate(power, out=power)
    np.multiply.accumulate(inverse, out=inverse)
    shape = windows.astype(U) * U(0xC2B2AE3D27D4EB4F) + (spot - begin).astype(U) * U(0x165667B19E3779F9)
    lanes = []
    for code in (K.BYTE_CODE, SECOND_CODE):
        total = np.zeros(n + 1, U)
        np.cumsum(code[raw] * power[:n], out=total[1:])
        lanes.append(K.mix((total[end] - total[begin]) * inverse[begin] + shape))
    doc = np.searchsorted(bounds, begin, "right") - 1
    return {"doc": doc, "start": begin - bounds[doc], "windows": windows, "anchor": grams[spot], "a": lanes[0], "b": lanes[1]}


def _runs(doc: np.ndarray, start: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Union of intervals, by document."""
    order = np.lexsort((start, doc))
    doc, start, end = doc[order], start[order], end[order]
    if not len(doc):
        return doc, start, end
    base = np.concatenate([[0], np.cumsum(doc[1:] != doc[:-1])]) * (int(end.max()) + 1)
    reach = np.maximum.accumulate(end + base) - base
    new = np.ones(len(doc), bool)
    new[1:] = (doc[1:] != doc[:-1]) | (start[1:] > reach[:-1])
    first = np.flatnonzero(new)
    return doc[first], start[first], reach[np.append(first[1:], len(doc)) - 1]


def _cut(length: int):
    """Rows of SEGMENTS: the first of equal segments of a batch (at: start, windows and nothing else packed), and,
    spread by document with no windows and their length in a, runs covered by the later ones."""
    shift = length.bit_length()

    def run(batches):
        for whole in batches:
            for batch in byte_slices(whole, "text"):
                raw, bounds = K.text_bytes(batch.column("text"))
                s = segments(raw, bounds, length)
                ord_ = batch.column("ord").to_numpy()[s["doc"]]
                mixed = K.mix(s["anchor"] ^ K.mix(s["a"] + s["b"] * K.STEP))
                order = np.lexsort((s["start"], ord_, mixed))
                same = np.zeros(len(order), bool)
                same[1:] = mixed[order[1:]] == mixed[order[:-1]]
                first, later = order[~same], order[same]
                _, c_start, c_end = covered = _runs(ord_[later], s["start"][later], s["start"][later] + s["windows"][later] - 1 + length)
                c_ord = covered[0]
                none = np.zeros(len(c_ord), np.int64)
                columns = (
                    (s["anchor"][first].view(np.int64), K.mix(c_ord.astype(U) + c_start.astype(U) * K.STEP).view(np.int64)),
                    (s["a"][first].view(np.int64), c_end - c_start),
                    (s["b"][first].view(np.int64), none),
                    (ord_[first], c_ord),
                    (s["start"][first] << shift | s["windows"][first], c_start << shift),
                )
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(c)) for c in columns], names=["key", "a", "b", "ord", "at"])

    return run


def _meet(length: int):
    """From SEGMENTS sorted by key, a, b, ord, at: covered runs, and the first segments of contested anchors."""
    shift = length.bit_length()

    def emit(contested, key, ord_, start, size, windows):
        return pa.RecordBatch.from_arrays([pa.array(x) for x in (contested, key, ord_, start, size, windows)], names=["contested", "key", "ord", "start", "length", "windows"])

    def run(batches):
        last, seen, held = None, 0, None  # the row before; different segments of its anchor; the only one so far
        for batch in batches:
            key, a, b, ord_, at = (c.to_numpy() for c in batch.columns)
            start, windows = at >> shift, (at & ((1 << shift) - 1)).astype(np.int32)
            loose = windows == 0
            if loose.any():
                yield emit(np.zeros(int(loose.sum()), bool), key[loose], ord_[loose], start[loose], a[loose], windows[loose])
                key, a, b, ord_, start, windows = (x[~loose] for x in (key, a, b, ord_, start, windows))
            if not len(key):
                continue
            fresh, opens = np.ones(len(key), bool), np.ones(len(key), bool)
            opens[1:] = key[1:] != key[:-1]
            fresh[1:] = opens[1:] | (a[1:] != a[:-1]) | (b[1:] != b[:-1])
            if last is not None and last[0] == key[0]:
                opens[0] = False
                fresh[0] = (a[0], b[0]) != last[1:]
            if opens[0]:
                seen, held = 0, None
            group = np.cumsum(opens)
            distinct = np.bincount(group, weights=fresh).astype(np.int64)
            distinct[0] += 0 if opens[0] else seen
            contested = fresh & (distinct[group] > 1)
            later = ~fresh
            if held is not None and distinct[0] > 1 and not opens[0]:
                yield emit(*[np.array([x]) for x in held])
                held = None
            rows = contested | later
            size = windows.astype(np.int64) - 1 + length
            yield emit(contested[rows], key[rows], ord_[rows], start[rows], size[rows], windows[rows])
            end = group[-1]
            if end or opens[0]:
                held = None
            seen = int(distinct[end])
            if seen == 1:
                alone = np.flatnonzero(fresh & (group == end))
                if len(alone):
                    i = alone[0]
                    held = (True, key[i], ord_[i], start[i], size[i], windows[i])
            last = (key[-1], a[-1], b[-1])

    return run


def _extract(batches):
    """The text of each contested segment of a document."""
    for batch in batches:
        keys, parts, ords, starts, windows, texts = [], [], [], [], [], []
        for ord_, text, found in zip(batch.column("ord").to_pylist(), batch.column("text"), batch.column("found").to_pylist(), strict=True):
            raw = memoryview(text.as_buffer())
            for f in found:
                keys.append(f["key"])
                parts.append(f["part"])
                ords.append(ord_)
                starts.append(f["start"])
                windows.append(f["windows"])
                texts.append(bytes(raw[f["start"] : f["start"] + f["length"]]))
        yield pa.RecordBatch.from_arrays(
            [pa.array(keys, pa.int64()), pa.array(parts, pa.int64()), pa.array(ords, pa.int64()), pa.array(starts, pa.int64()), pa.array(windows, pa.int32()), pa.array(texts, pa.binary())],
            names=["key", "part", "ord", "start", "windows", "segment"],
        )


class RepeatArray:
    """An enhanced suffix array over the windows of some segments: suffixes run to their segment's end."""

    def __init__(self, texts: list[bytes], windows: np.ndarray, length: int):
        size = np.array([len(t) for t in texts], np.int64)
        width = int(size.max(initial=0)) + 1
        raw = np.frombuffer(b"".join(texts) + bytes(width), np.uint8)
        base = np.cumsum(size) - size
        self.segment = np.repeat(np.arange(len(texts)), windows)
        self.offset = np.arange(len(self.segment)) - np.repeat(np.cumsum(windows) - windows, windows)
        at = base[self.segment] + self.offset
        left = size[self.segment] - self.offset
        rows = np.lib.stride_tricks.sliding_window_view(raw, width)[at]
        # Past its end a suffix is filled with 0 and closed by its length, so that shorter ones sort first.
        rows[np.arange(width) >= left[:, None]] = 0
        rows = np.concatenate([rows, (left.astype(">u4")).view(np.uint8).reshape(-1, 4), np.ones((len(left), 1), np.uint8)], axis=1)
        self.order = np.argsort(np.ascontiguousarray(rows).view(f"S{rows.shape[1]}").ravel(), kind="stable")
        rows, left = rows[self.order], left[self.order]
        differ = rows[1:, :width] != rows[:-1, :width]
        common = np.where(differ.any(axis=1), differ.argmax(axis=1), width)
        #: Common prefix of each suffix with the one before; 0 below `length`.
        self.lcp = np.zeros(len(left) + 1, np.int64)
        shared = np.minimum(common, np.minimum(left[1:], left[:-1]))
        self.lcp[1:-1] = np.where(shared >= length, shared, 0)
        before = at[self.order] - 1
        #: Byte before each suffix; differs from all others (256 + its place) where the segment begins.
        self.before = np.where(self.offset[self.order] > 0, raw[np.maximum(before, 0)], 256 + np.arange(len(left)))

    def maximal_repeats(self):
        """(length, first place, last place) of the intervals of the common-prefix tree whose members have more
        than one byte before them: the stack holds the open intervals, each with the byte that all share so far."""
        lcp, before = self.lcp.tolist(), self.before.tolist()
        active = np.flatnonzero(self.lcp[:-1] | self.lcp[1:])
        # Groups with no interval above them are far apart: each run of active places is scanned by itself.
        if not len(active):
            return
        cuts = np.flatnonzero(self.lcp[active] == 0)
        for lo, hi in zip(cuts.tolist(), np.append(cuts[1:], len(active)).tolist(), strict=True):
            start, end = int(active[lo]), int(active[hi - 1])
            stack = []  # [common prefix, first place, byte before or -1 if they differ]
            for i in range(start, end + 2):
                height = lcp[i] if i > start and i <= end else 0
                first, byte = i - 1, before[i - 1]
                while stack and stack[-1][0] > height:
                    tall, first, left = stack.pop()
                    if left != -1 and left != byte:
                        left = -1
                    byte = left
                    if left == -1:
                        yield tall, first, i - 1
                if i > end:
                    break
                if height:
                    if stack and stack[-1][0] == height:
                        if stack[-1][2] != byte:
                            stack[-1][2] = -1
                    else:
                        stack.append([height, first, byte])


def _sort_blocks(length: int):
    """Covered runs of each block (kind 0), and of blocks of a dealt anchor the first of each window (kind 1)."""

    def block(rows):
        texts, windows = [r[4] for r in rows], np.array([r[3] for r in rows], np.int64)
        ords, starts = np.array([r[1] for r in rows], np.int64), np.array([r[2] for r in rows], np.int64)
        array = RepeatArray(texts, windows, length)
        ord_ = ords[array.segment][array.order]
        place = (starts[array.segment] + array.offset)[array.order]
        c_ord, c_start, c_end = [], [], []
        for size, lo, hi in array.maximal_repeats():
            o, p = ord_[lo : hi + 1], place[lo : hi + 1]
            first = np.lexsort((p, o))[0]
            rest = np.arange(len(o)) != first
            c_ord.append(o[rest])
            c_start.append(p[rest])
            c_end.append(p[rest] + size)
        if c_ord:
            c_ord, c_start, c_end = _runs(np.concatenate(c_ord), np.concatenate(c_start), np.concatenate(c_end))
            n = len(c_ord)
            yield np.zeros(n, np.int32), c_ord, c_start, c_end - c_start, np.zeros(n, np.int64), np.zeros(n, np.int64)
        dealt = np.array([r[0] >= 0 for r in rows])
        if dealt.any():
            group = np.cumsum(array.lcp[:-1] == 0)
            order = np.lexsort((place, ord_, group))
            firsts = order[np.concatenate([[True], group[order][1:] != group[order][:-1]])]
            firsts = firsts[dealt[array.segment[array.order[firsts]]]]
            back = array.order[firsts]
            digests = b"".join(hashlib.blake2b(texts[s][o : o + length], digest_size=16).digest() for s, o in zip(array.segment[back].tolist(), array.offset[back].tolist(), strict=True))
            halves = np.frombuffer(digests, np.int64).reshape(-1, 2)
            yield np.ones(len(firsts), np.int32), ord_[firsts], place[firsts], np.full(len(firsts), length, np.int64), halves[:, 0].copy(), halves[:, 1].copy()

    def run(batches):
        rows, size, group = [], 0, None
        for batch in batches:
            for key, part, ord_, start, windows, segment in zip(*[c.to_pylist() for c in batch.columns], strict=True):
                if (key, part) != group and size >= BLOCK_BYTES:
                    for out in block(rows):
                        yield pa.RecordBatch.from_arrays([pa.array(x) for x in out], names=["kind", "ord", "start", "length", "h1", "h2"])
                    rows, size = [], 0
                group = (key, part)
                rows.append((part, ord_, start, windows, segment))
                size += len(segment)
        if rows:
            for out in block(rows):
                yield pa.RecordBatch.from_arrays([pa.array(x) for x in out], names=["kind", "ord", "start", "length", "h1", "h2"])

    return run


def repeated_bytes(docs: DataFrame, space: Workspace, length: int) -> DataFrame:
    """ord, start, length of runs to remove (they may overlap). docs: ord (unique), text."""
    width = shuffle_width(docs.sparkSession)
    cut = docs.select("ord", "text").mapInArrow(_cut(length), SEGMENTS)
    sorted_ = cut.repartition(width, "key").sortWithinPartitions("key", "a", "b", "ord", "at")
    met = space.keep(sorted_.mapInArrow(_meet(length), OCCURRENCES), "met")
    contested = met.filter("contested")
    hot = space.keep(contested.groupBy("key").agg(F.ceil(F.count(F.lit(1)) / GROUP).alias("parts")).filter("parts > 1"), "hot", small=True)
    dealt = contested.join(hot, "key", "left").withColumn("part", F.when(F.col("parts").isNull(), F.lit(-1)).otherwise(F.pmod(F.xxhash64("ord", "start"), "parts")))
    wanted = dealt.groupBy("ord").agg(F.collect_list(F.struct("key", "part", "start", "length", "windows")).alias("found"))
    held = docs.select("ord", "text").join(wanted.hint("merge"), "ord").select("ord", F.col("text").cast("binary").alias("text"), "found")
    pieces = held.mapInArrow(_extract, "key bigint, part bigint, ord bigint, start bigint, windows int, segment binary")
    blocks = pieces.repartition(width, "key", "part").sortWithinPartitions("key", "part", "ord", "start")
    found = space.keep(blocks.mapInArrow(_sort_blocks(length), "kind int, ord bigint, start bigint, length bigint, h1 bigint, h2 bigint"), "found")
    across = found.filter("kind = 1")
    place = F.struct("ord", "start")
    first = across.groupBy("h1", "h2").agg(F.min(place).alias("first"), F.max(place).alias("last")).filter("first < last").select("h1", "h2", "first")
    first = space.keep(first, "first", small=True)
    later = across.join(first, ["h1", "h2"]).filter(F.col("first") < place)
    covered = met.filter("not contested").select("ord", "start", "length")
    return covered.unionByName(found.filter("kind = 0").select("ord", "start", "length")).unionByName(later.select("ord", "start", "length"))


def _remove(batches):
    for batch in batches:
        n_bytes, n_removed, n_spans, kept, spans = [], [], [], [], []
        for text, found in zip(batch.column("text"), batch.column("found").to_pylist(), strict=True):
            raw = text.as_buffer().to_pybytes() if text.is_valid else b""
            runs = []
            if found:
                start = np.array([f["start"] for f in found], np.int64)
                end = start + np.array([f["length"] for f in found], np.int64)
                _, start, end = _runs(np.zeros(len(start), np.int64), start, end)
                runs = list(zip(start.tolist(), end.tolist(), strict=True))
            at, left = 0, []
            for a, b in runs:
                left.append(raw[at:a])
                at = b
            left.append(raw[at:])
            n_bytes.append(len(raw))
            n_removed.append(sum(b - a for a, b in runs))
            n_spans.append(len(runs))
            kept.append(b"".join(left))
            spans.append([{"start": a, "end": b} for a, b in runs])
        kind = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))
        yield pa.RecordBatch.from_arrays(
            [batch.column("doc_id"), pa.array(n_bytes, pa.int64()), pa.array(n_removed, pa.int64()), pa.array(n_spans, pa.int64()), pa.array(kept, pa.binary()), pa.array(spans, kind)],
            names=["doc_id", "n_bytes", "n_removed", "n_spans", "kept", "spans"],
        )


def remove_repeated_bytes(docs: DataFrame, length: int = 100) -> DataFrame:
    """One row per row of docs: doc_id, n_bytes, n_removed, n_spans, kept (binary), spans (start, end of removed runs).

    A byte is removed if a string of `length` bytes that covers it also starts earlier: in a smaller doc_id,
    or earlier in its document; strings are judged on the input and never cross documents. kept may begin or
    end inside a UTF-8 sequence. A null text is empty. Null doc_ids come first; rows with one doc_id and
    different texts are ordered by a hash of the text; rows equal in both are one document, each with its
    row. Texts shorter than `length` are whole. An empty table gives no rows; other columns are ignored.
    """
    space = Workspace(docs.sparkSession, "suffix-dedup", docs)
    ordered, unique = in_document_order(docs, space)
    covered = repeated_bytes(ordered if unique else ordered.dropDuplicates(["ord"]), space, length).groupBy("ord").agg(F.collect_list(F.struct("start", "length")).alias("found"))
    covered = space.keep(covered, "covered")
    space.only("covered", "places", "place-totals")
    joined = ordered.join(covered.hint("merge"), "ord", "left").select("doc_id", F.col("text").cast("binary").alias("text"), "found")
    kind = docs.schema["doc_id"].dataType.simpleString()
    return joined.mapInArrow(_remove, f"doc_id {kind}, n_bytes bigint, n_removed bigint, n_spans bigint, kept binary, spans array<struct<start:bigint,end:bigint>>")
