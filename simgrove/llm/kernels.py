"""numpy kernels over an Arrow batch of texts: words, lines and their 64-bit hashes.

All work on UTF-8 bytes. A class such as ``[^\\x20\\x09-\\x0D]`` holds every non-ASCII code point, so
deciding byte by byte gives the same words as deciding code point by code point.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa

U = np.uint64
_rng = np.random.Generator(np.random.PCG64(20240607))
BYTE_CODE = _rng.integers(0, 2**64, 256, dtype=U) | U(1)
STEP = U(0x9E3779B97F4A7C15)
#: Bytes up to which a span is hashed by a polynomial: modulo 2^64 one is sound for short spans only.
LONG_SPAN = 63
POWERS = np.full(LONG_SPAN, STEP, U)
POWERS[0] = 1
np.multiply.accumulate(POWERS, out=POWERS)

#: Bytes that stand in words of ``[^\x20\x09-\x0D]+``.
PLAIN = np.ones(256, bool)
PLAIN[[0x20, *range(0x09, 0x0E)]] = False
#: Bytes that stand in words of ``[^\x00-\x2F\x3A-\x60\x7B-\x7F]+``.
ALNUM = np.zeros(256, bool)
ALNUM[0x30:0x3A] = ALNUM[0x61:0x7B] = ALNUM[0x80:] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[0x41:0x5B] += 0x20


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser (a bijection), so that low and high bits are usable alike."""
    x = x ^ (x >> U(30))
    x = x * U(0xBF58476D1CE4E5B9)
    x ^= x >> U(27)
    x *= U(0x94D049BB133111EB)
    x ^= x >> U(31)
    return x


def text_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes of all texts one after the other, and n + 1 bounds. A null counts as empty."""
    if column.null_count:
        column = column.fill_null("" if not pa.types.is_binary(column.type) and not pa.types.is_large_binary(column.type) else b"")
    column = column.cast(pa.large_binary())
    offsets = np.frombuffer(column.buffers()[1], np.int64, len(column) + 1 + column.offset)[column.offset :]
    data = column.buffers()[2]
    raw = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return raw[offsets[0] : offsets[-1]], offsets - offsets[0]


def spans(inside: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the maximal runs of True that cross no bound."""
    if not len(inside):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    cut = np.zeros(len(inside) + 1, bool)
    cut[bounds] = True
    before = np.empty(len(inside) + 1, bool)
    before[0], before[1:] = False, inside
    after = np.empty(len(inside) + 1, bool)
    after[:-1], after[-1] = inside, False
    starts = np.flatnonzero(after & (~before | cut))
    ends = np.flatnonzero(before & (~after | cut))
    return starts, ends


def span_hashes(raw: np.ndarray, starts: np.ndarray, ends: np.ndarray, salt: int = 0) -> np.ndarray:
    """A 64-bit hash of each span's bytes. Spans are disjoint and in order; longer ones than LONG_SPAN go through BLAKE2."""
    out = np.zeros(len(starts), U)
    if not len(starts):
        return out
    lengths = ends - starts
    long = lengths > LONG_SPAN
    short = (lengths > 0) & ~long
    s, n = starts[short], lengths[short]
    if len(s):
        first = np.cumsum(n) - n
        k = np.arange(int(n.sum()), dtype=np.int64) - np.repeat(first, n)
        values = BYTE_CODE[raw[k + np.repeat(s, n)]] * POWERS[k]
        out[short] = mix(np.add.reduceat(values, first) + n.astype(U) * U(0xD1342543DE82EF95) + U(salt))
    for i in np.flatnonzero(long):
        out[i] = int.from_bytes(hashlib.blake2b(raw[starts[i] : ends[i]].tobytes(), digest_size=8, salt=salt.to_bytes(8, "little")).digest(), "little")
    return out


def equal_spans(raw: np.ndarray, starts: np.ndarray, other: np.ndarray, other_starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """Whether raw and other hold the same bytes in spans of equal lengths; compared eight bytes at a time."""

    def words(data):
        padded = np.concatenate([data, np.zeros(8, np.uint8)])
        return np.ndarray(len(data) + 1, "<u8", padded, strides=(1,))

    a, b, same, at = words(raw), words(other), np.ones(len(lengths), bool), np.arange(len(lengths))
    done = 0
    while len(at):
        left = np.minimum(lengths[at] - done, 8).astype(U)
        mask = np.where(left == 8, ~U(0), (U(1) << (left % U(8) * U(8))) - U(1))
        same[at] &= (a[starts[at] + done] ^ b[other_starts[at] + done]) & mask == 0
        done += 8
        at = at[lengths[at] > done]
    return same


def window_hashes(words: np.ndarray, width: int, salt: int = 0) -> np.ndarray:
    """Hash of words[i : i + width] for each i that has so many; order matters."""
    n = len(words) - width + 1
    if n <= 0:
        return np.zeros(0, U)
    total = np.full(n, U(salt) * U(0xA24BAED4963EE407) + U(width), U)
    for j in range(width):
        total = total * STEP + words[j : j + n]
    return mix(total)


def per_document(bounds: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """Index of the first of the (ordered) starts in each document, then their number: n + 1 bounds into starts."""
    return np.searchsorted(starts, bounds, "left")


def counts_between(flags: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """How many flags are set in each [bounds[i], bounds[i + 1])."""
    total = np.zeros(len(flags) + 1, np.int64)
    np.cumsum(flags, out=total[1:])
    return total[bounds[1:]] - total[bounds[:-1]]


def shingle_sets(column: pa.Array, width: int = 5) -> tuple[np.ndarray, np.ndarray]:
    """Distinct word shingles of each text, A-Z lower-cased: hashes in ascending order, and n + 1 bounds.

    With fewer words than width, the whole sequence is the one shingle; without words the set is empty.
    """
    raw, bounds = text_bytes(column)
    raw = LOWER[raw]
    starts, ends = spans(PLAIN[raw], bounds)
    words = span_hashes(raw, starts, ends)
    first = per_document(bounds, starts)
    n_words = np.diff(first)
    found = window_hashes(words, width)
    doc = np.repeat(np.arange(len(n_words)), n_words)
    last = np.minimum(first[doc] + n_words[doc], len(words))
    whole = np.arange(len(words)) + width <= last
    values, owners = found[whole[: len(found)]], doc[: len(found)][whole[: len(found)]]
    few = np.flatnonzero((n_words > 0) & (n_words < width))
    if len(few):
        extra = np.array([window_hashes(words[first[d] : first[d + 1]], int(n_words[d]))[0] for d in few], U)
        values, owners = np.concatenate([values, extra]), np.concatenate([owners, few])
    order = np.lexsort((values, owners))
    values, owners = values[order], owners[order]
    fresh = np.ones(len(values), bool)
    fresh[1:] = (values[1:] != values[:-1]) | (owners[1:] != owners[:-1])
    values, owners = values[fresh], owners[fresh]
    return values, np.searchsorted(owners, np.arange(len(n_words) + 1), "left")
