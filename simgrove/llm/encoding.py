"""Exact sub-word encoding with a bounded cache of chunks.

A text is cut where the tokenizer's own pre-tokenisation always cuts; each distinct chunk is encoded
by the library once per worker and looked up afterwards. Texts of any length are handled whole: a
long one is simply many chunks. The cache is emptied when it reaches ``CACHE_ENTRIES``.
"""

from __future__ import annotations

import itertools
import json
import os
import re

import numpy as np
import pyarrow as pa

from . import kernels as K

CACHE_ENTRIES = 400_000
LONG_CHUNK = 64
#: Characters handed to the library at once.
BATCH_CHARS = 1_000_000

_TWO_SPACES = re.compile(r"\s\s")
#: Characters of a part between spaces that is cut further.
LONG_PART = 512
_SPACES = "\\t\\n\\x0b\\x0c\\r \\x85\\xa0\\u1680\\u2000-\\u200a\\u2028\\u2029\\u202f\\u205f\\u3000"
_LETTERS = "A-Za-z\\u3041-\\u3096\\u30a1-\\u30fa\\u4e00-\\u9fa5\\uac00-\\ud7a3"
_SAFE = re.compile(f"(?<=[^{_SPACES}])(?=[{_SPACES}])|(?<=[{_LETTERS}])(?=[.,;:!?()\\[\\]{{}}/\\u3001\\u3002\\uff01\\uff0c\\uff1a\\uff1b\\uff1f])")
_BETWEEN_WORDS = re.compile(r"(?<=\S)(?= \S)")
_tokenizers: dict[str, object] = {}


def tokenizer(path: str):
    if path not in _tokenizers:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        _tokenizers[path] = Tokenizer.from_file(path)
    return _tokenizers[path]


def byte_balanced(chunks: list[str]):
    """Lists of chunks that hold about BATCH_CHARS characters each."""
    at, size = 0, 0
    for i, c in enumerate(chunks):
        size += len(c)
        if size >= BATCH_CHARS:
            yield chunks[at : i + 1]
            at, size = i + 1, 0
    if at < len(chunks):
        yield chunks[at:]


class ChunkCache:
    """value(chunk) for chunks of a batch; value is made from the ids that the library gives."""

    def __init__(self, path: str, prefix: str, value):
        self.path, self.prefix, self.value, self.known = path, prefix, value, {}

    def learn(self, chunks: set[str]) -> dict:
        """A mapping that holds every given chunk."""
        if len(self.known) > CACHE_ENTRIES:
            self.known = {}
        new = [c for c in chunks if c not in self.known]
        encoder, long = tokenizer(self.path), {}
        for batch in byte_balanced(new):
            for c, e in zip(batch, encoder.encode_batch_fast([self.prefix + c for c in batch], add_special_tokens=False), strict=True):
                (self.known if len(c) <= LONG_CHUNK else long)[c] = self.value(e.ids)
        return self.known if not long else _Both(long, self.known)


class _Both(dict):
    def __init__(self, first: dict, second: dict):
        super().__init__(first)
        self.second = second

    def __missing__(self, key):
        return self.second[key]


class TokenCounter:
    """Token counts for byte-level BPE whose pattern takes one leading space into the next word.

    A single space between two non-space characters always starts a pre-token there, and no special
    token holds a space, so such a place is safe to cut at. A part that is still long is cut before other white
    space, and between a letter and a punctuation mark that begins no special token: there a pre-token ends, too.
    A run of letters, or of white space, stays in one piece.
    """

    def __init__(self, path: str):
        self.head, self.rest = ChunkCache(path, "", len), ChunkCache(path, " ", len)

    def counts(self, texts: list[str]) -> np.ndarray:
        heads, rests = [], []
        for t in texts:
            parts = t.split(" ") if not _TWO_SPACES.search(t) else None
            if parts is None:
                parts = _BETWEEN_WORDS.split(t)
                parts[1:] = [p[1:] for p in parts[1:]]
            heads.append(parts[:1])
            rests.append(parts[1:])
            if len(t) > LONG_PART and max(map(len, parts)) > LONG_PART:
                finer = [_SAFE.split(p) if len(p) > LONG_PART else [p] for p in parts]
                heads[-1] = finer[0] + [x for f in finer[1:] for x in f[1:]]
                rests[-1] = [f[0] for f in finer[1:]]
        head = self.head.learn(set().union(*heads) if heads else set())
        rest = self.rest.learn(set().union(*rests) if rests else set())
        return np.array([sum(head[x] for x in h if x) + sum(map(rest.__getitem__, r)) for h, r in zip(heads, rests, strict=True)], np.int64)


#: Bytes that make a chunk special: controls, the apostrophe, and UTF-8 parts outside of Latin letters.
_SPECIAL = np.zeros(256, bool)
_SPECIAL[[*range(0x20), 0x27, 0x7F, 0xC0, 0xC1, 0xC2, *range(0xCA, 0x100)]] = True
_LETTER = np.zeros(256, bool)
_LETTER[[*range(0x41, 0x5B), *range(0x61, 0x7B), *range(0x80, 0x100)]] = True


def units(raw: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Bytes (A-Z lower-cased where that is safe), starts and ends of the units to encode by themselves.

    A chunk between white space of ASCII is cut where letters and other characters meet: the tokenizer
    separates them. A chunk with an apostrophe ("'s" goes with its letters), "<|" (special tokens),
    controls, combining marks or other scripts stays whole.
    """
    plain = K.PLAIN[raw]
    starts, ends = K.spans(plain, bounds)
    special = _SPECIAL[raw] & plain
    if len(raw) > 1:
        special[:-1] |= (raw[:-1] == 0x3C) & (raw[1:] == 0x7C)
        special[:-1] |= (raw[:-1] == 0xC3) & ((raw[1:] == 0x97) | (raw[1:] == 0xB7))
    seen = np.zeros(len(raw) + 1, np.int32)
    np.cumsum(special, out=seen[1:])
    odd = seen[ends] > seen[starts]
    whole = np.zeros(len(raw) + 1, np.int8)
    whole[starts[odd]] += 1
    whole[ends[odd]] -= 1
    whole = np.cumsum(whole[:-1], dtype=np.int8).astype(bool)
    letter = _LETTER[raw]
    begin = np.zeros(len(raw) + 1, bool)
    begin[1:-1] = (letter[1:] != letter[:-1]) & ~whole[1:] & plain[1:] & plain[:-1]
    begin[starts] = True
    stop = begin.copy()
    stop[starts] = False
    stop[ends] = True
    return np.where(whole, raw, K.LOWER[raw]), np.flatnonzero(begin[:-1]), np.flatnonzero(stop)


def cuts_at_words(path: str) -> bool:
    """Whether the file's rules are those that units() follows: white space becomes one space, letters are lower-cased,
    and runs of letters, single digits and runs of other characters are encoded each by itself."""
    with open(path, encoding="utf-8") as f:
        rules = json.load(f)
    steps = [n.get("type") for n in (rules.get("normalizer") or {}).get("normalizers", [])]
    split = ((rules.get("pre_tokenizer") or {}).get("pretokenizers") or [{}])[0]
    # Fixed value: the pattern that a pre-token must match.
    pattern = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
    return steps == ["NFC", "Replace", "Lowercase"] and split.get("type") == "Split" and split.get("pattern") == {"Regex": pattern} and split.get("invert") is True


#: Bytes of a unit whose key is its text itself.
SHORT_UNIT = 7


def _unit_keys(raw: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A short unit's bytes, with its length in the eighth; of a longer one 56 bits of hash below 0xFF."""
    size = ends - starts
    words = np.ndarray(len(raw) + 1, "<u8", np.concatenate([raw, np.zeros(8, np.uint8)]), strides=(1,))
    held = np.minimum(size, SHORT_UNIT).astype(np.uint64)
    keys = words[starts] & ((np.uint64(1) << held * np.uint64(8)) - np.uint64(1)) | held << np.uint64(56)
    long = size > SHORT_UNIT
    keys[long] = K.span_hashes(raw, starts[long], ends[long]) | np.uint64(0xFF << 56)
    return keys


class WordEncoder:
    """Token ids for a tokenizer that drops white space and encodes each word by itself.

    Distinct units are looked up by a 64-bit key in sorted arrays, longer ones compared byte by byte; only unknown ones
    go to the library. With a tokenizer of other rules, whole texts do.
    """

    MOST = 1_500_000

    def __init__(self, path: str):
        self.path, self.by_words = path, cuts_at_words(path)
        self.dtype = np.dtype("<u2") if tokenizer(path).get_vocab_size() <= 65536 else np.dtype("<u4")
        self.forget()

    def forget(self):
        self.hashes = np.zeros(0, np.uint64)
        #: Of each unit: place and number of its ids, place and number of its bytes.
        self.at, self.n, self.byte_at, self.bytes = (np.zeros(0, np.int64) for _ in range(4))
        self.ids, self.raw = np.zeros(0, self.dtype), np.zeros(0, np.uint8)

    def _encode(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Places and numbers of the ids of each text, which are appended."""
        ids = [e.ids for batch in byte_balanced(texts) for e in tokenizer(self.path).encode_batch_fast(batch, add_special_tokens=False)]
        n = np.fromiter(map(len, ids), np.int64, len(ids))
        at = len(self.ids) + np.cumsum(n) - n
        self.ids = np.concatenate([self.ids, np.fromiter(itertools.chain.from_iterable(ids), self.dtype, int(n.sum()))])
        return at, n

    def _learn(self, hashes: np.ndarray, units: list[bytes]) -> None:
        at, n = self._encode([u.decode() for u in units])
        size = np.fromiter(map(len, units), np.int64, len(units))
        byte_at = len(self.raw) + np.cumsum(size) - size
        self.raw = np.concatenate([self.raw, np.frombuffer(b"".join(units), np.uint8)])
        places = np.searchsorted(self.hashes, hashes)
        self.hashes, self.at, self.n, self.byte_at, self.bytes = (np.insert(old, places, new) for old, new in ((self.hashes, hashes), (self.at, at), (self.n, n), (self.byte_at, byte_at), (self.bytes, size)))

    def _whole(self, column: pa.Array, end_id: int) -> tuple[np.ndarray, np.ndarray]:
        ids = [[*e.ids, end_id] for batch in byte_balanced(column.fill_null("").to_pylist()) for e in tokenizer(self.path).encode_batch_fast(batch, add_special_tokens=False)]
        bounds = np.concatenate([[0], np.cumsum(np.fromiter(map(len, ids), np.int64, len(ids)))])
        return np.fromiter(itertools.chain.from_iterable(ids), self.dtype, int(bounds[-1])), bounds

    def encode(self, column: pa.Array, end_id: int) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts one after the other, each closed by end_id, and n + 1 bounds."""
        if not self.by_words:
            return self._whole(column, end_id)
        raw, bounds = K.text_bytes(column)
        raw, starts, ends = units(raw, bounds)
        keys = _unit_keys(raw, starts, ends)
        distinct, first, back = np.unique(keys, return_index=True, return_inverse=True)
        if len(self.hashes) > self.MOST:
            self.forget()
        place = np.minimum(np.searchsorted(self.hashes, distinct), max(len(self.hashes) - 1, 0))
        unknown = np.flatnonzero(self.hashes[place] != distinct) if len(self.hashes) else np.arange(len(distinct))
        if len(unknown):
            data = raw.tobytes()
            self._learn(distinct[unknown], [data[a:b] for a, b in zip(starts[first[unknown]].tolist(), ends[first[unknown]].tolist(), strict=True)])
        place = np.searchsorted(self.hashes, distinct)[back]
        n, at = self.n[place], self.at[place]
        long = np.flatnonzero(ends - starts > SHORT_UNIT)
        size, held = (ends - starts)[long], place[long]
        other = self.bytes[held] != size
        other[~other] = ~K.equal_spans(raw, starts[long[~other]], self.raw, self.byte_at[held[~other]], size[~other])
        if other.any():  # another unit bears the same hash
            odd, data = long[other], raw.tobytes()
            at[odd], n[odd] = self._encode([data[a:b].decode() for a, b in zip(starts[odd].tolist(), ends[odd].tolist(), strict=True)])
        before = np.zeros(len(n) + 1, np.int64)
        np.cumsum(n, out=before[1:])
        words = K.per_document(bounds, starts)
        out_bounds = before[words] + np.arange(len(bounds))
        flat = self.ids[np.repeat(at - before[:-1], n) + np.arange(before[-1])]
        out = np.empty(len(flat) + len(bounds) - 1, self.dtype)
        last = np.zeros(len(out), bool)
        last[out_bounds[1:] - 1] = True
        out[last], out[~last] = end_id, flat
        return out, out_bounds


_made: dict[tuple, object] = {}


def of_worker(kind, path: str):
    """One encoder per Python worker and file; a worker outlives its task."""
    return _made.get((kind, path)) or _made.setdefault((kind, path), kind(path))
