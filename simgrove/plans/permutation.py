"""The fixed permutation of 128 bits behind the index, as a table of source positions.

A bucket needs eight bits of the permuted hash, and Hamming distance doesn't change under a permutation.
So no permuted hash is ever made: the table says which bits of the plain hash form bucket k.
"""

from __future__ import annotations

from functools import lru_cache

BITS = 128
BUCKET_BITS = 8

# The exchanges that make up the permutation, in order: high and low half of the mask, distance.
EXCHANGES = (
    (0x1110444400100110, 0x4501005550510550, 1),
    (0x2123333100302210, 0x3110101001022210, 2),
    (0x0C010C0D09040901, 0x0A0C01010A040B00, 4),
    (0x0052006700FE0041, 0x00AB002900330000, 8),
    (0x0000678F0000BD05, 0x0000236300000000, 16),
    (0x0000000004C30052, 0x0000000000000000, 32),
    (0x0000000000000000, 0x3782CCFD884D7006, 64),
    (0x0000000096739FB5, 0x00000000F20085BE, 32),
    (0x000076F900004A91, 0x000018220000ECF9, 16),
    (0x00BF001D00720029, 0x001300C40053007C, 8),
    (0x06040A09050F0A04, 0x0D0202050C010C0F, 4),
    (0x1231022131331030, 0x2232233111022130, 2),
    (0x0140545111411015, 0x0010144154505040, 1),
)


@lru_cache
def source_positions() -> tuple[int, ...]:
    """For each position of the permuted hash, the position its bit comes from."""
    at = list(range(BITS))
    for high, low, distance in EXCHANGES:
        mask = high << 64 | low
        for p in (p for p in range(BITS) if mask >> p & 1):
            at[p], at[p + distance] = at[p + distance], at[p]
    return tuple(at)


@lru_cache
def bucket_positions(permutations: int) -> tuple[tuple[int, ...], ...]:
    """The source positions of each permutation's bucket, highest bit first; permutation 0 is the identity."""
    step, now, out = source_positions(), tuple(range(BITS)), []
    for _ in range(permutations):
        out.append(tuple(now[BITS - 1 - i] for i in range(BUCKET_BITS)))
        now = tuple(now[p] for p in step)
    return tuple(out)


def permuted(value: int, times: int = 1) -> int:
    for _ in range(times):
        value = sum((value >> p & 1) << i for i, p in enumerate(source_positions()))
    return value
