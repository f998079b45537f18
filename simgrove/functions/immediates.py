"""Constants in operands."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed value: a hex word after a non-word character, 0x or the start, up to h, a non-word character or the end.
PATTERN = r"(?:\W|0x|^)(\p{XDigit}+)(?:h|\W|$)"
_FULL = "ffffffffffffffff"


def _number(text: Column) -> Column:
    """A hex number as strtoull reads it: blanks, a sign and 0x may come first, rubbish may follow; too large
    gives the largest word; nothing gives 0. Bits of an unsigned word, as a bigint."""
    sign = F.regexp_extract(text, r"^\s*([-+]?)", 1)
    digits = F.regexp_extract(text, r"^\s*[-+]?(?:0[xX](?=\p{XDigit}))?0*(\p{XDigit}*)", 1)
    kept = F.when(F.length(digits) > 16, F.lit(_FULL)).when(F.length(digits) == 0, F.lit("0")).otherwise(digits)
    word = F.conv(kept, 16, -10).cast("bigint")
    # Two's complement without overflow: the least word is its own negative; a saturated one stays.
    negative = F.when(F.length(digits) > 16, word).when(word == F.lit(-(1 << 63)).cast("bigint"), word).otherwise(-word)
    return F.when(sign == "-", negative).otherwise(word)


def extract_immediates(operand) -> Column:
    """The non-zero numbers of an operand, in order; of equal neighbours one. Whole match and group both count."""
    operand = F.col(operand) if isinstance(operand, str) else operand
    whole, group = (F.regexp_extract_all(operand, F.lit(PATTERN), F.lit(i)) for i in (0, 1))
    both = F.flatten(F.zip_with(whole, group, lambda w, g: F.array(_number(w), _number(g))))
    values = F.filter(both, lambda v: v != 0)
    return F.filter(values, lambda v, i: (i == 0) | (v != F.get(values, i - 1)))


def is_useful(value) -> Column:
    """Above 0x4000 in absolute value as a signed word, or not divisible by 4 and, unsigned, above 10."""
    value = F.col(value) if isinstance(value, str) else value
    large = (value > 0x4000) | (value < -0x4000)
    return large | ((value.bitwiseAND(F.lit(3).cast("bigint")) != 0) & ((value > 10) | (value < 0)))
