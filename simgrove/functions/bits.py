"""64- and 128-bit arithmetic on columns. An unsigned 64-bit word is a bigint with the same bits."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F


def hex64(word) -> Column:
    """16 lower-case hex digits of a word."""
    return F.lpad(F.lower(F.hex(word)), 16, "0")


def hex128(a, b) -> Column:
    return F.concat(hex64(a), hex64(b))


def parse_hex64(digits) -> Column:
    """The word of up to 16 hex digits; null for more, or for other characters."""
    digits = F.col(digits) if isinstance(digits, str) else digits
    return F.when(digits.rlike("^[0-9a-fA-F]{1,16}$"), F.conv(digits, 16, -10).cast("bigint"))


def parse_feature_hash(text) -> tuple[Column, Column]:
    """Both words of a 32-digit id, or of a 35-character one with an xx. prefix; anything else gives zeros."""
    text = F.col(text) if isinstance(text, str) else text
    body = F.when(F.length(text) == 35, F.substring(text, 4, 32)).when(F.length(text) == 32, text)
    return tuple(F.coalesce(parse_hex64(F.substring(body, at, 16)), F.lit(0).cast("bigint")) for at in (1, 17))


def bit(word, n: int) -> Column:
    """Bit n of a word, as 0 or 1."""
    return F.shiftrightunsigned(word, n).bitwiseAND(F.lit(1).cast("bigint"))


def rotl64(word, n: int) -> Column:
    """Rotation to the left. A shift by 64 would be none, so 0 is a case of its own."""
    n %= 64
    word = F.col(word) if isinstance(word, str) else word
    return word if n == 0 else F.shiftleft(word, n).bitwiseOR(F.shiftrightunsigned(word, 64 - n))


def bit_pick(a, b, positions: list[int]) -> Column:
    """A number made of the given bits of a * 2^64 + b, first position first."""
    picked = [F.shiftleft(bit(a, p - 64) if p >= 64 else bit(b, p), len(positions) - 1 - i) for i, p in enumerate(positions)]
    return reduce(lambda x, y: x.bitwiseOR(y), picked).cast("int")


def pack_bits(states: list[Column]) -> Column:
    """A word whose bit n is 1 where states[n] is 0 or more."""
    return reduce(lambda x, y: x.bitwiseOR(y), [F.when(s >= 0, F.lit(1 << n if n < 63 else -(1 << 63)).cast("bigint")).otherwise(F.lit(0).cast("bigint")) for n, s in enumerate(states)])


def hamming128(a1, b1, a2, b2) -> Column:
    """Number of differing bits of two 128-bit hashes."""
    a1, b1, a2, b2 = (F.col(x) if isinstance(x, str) else x for x in (a1, b1, a2, b2))
    return F.bit_count(a1.bitwiseXOR(a2)) + F.bit_count(b1.bitwiseXOR(b2))


def md5_words(text) -> tuple[Column, Column]:
    """The native hash family: both halves of the MD5 of a text as words."""
    digest = F.md5(text)
    return tuple(F.conv(F.substring(digest, at, 16), 16, -10).cast("bigint") for at in (1, 17))
