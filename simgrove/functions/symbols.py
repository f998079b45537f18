"""Symbol names: stemming of demangled names, Base64 names."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

# Literal replacements, in order.
REPLACEMENTS = (
    ("struct", ""),
    ("class", ""),
    ("enum", ""),
    ("(void)", "()"),
    ("& ", "&"),
    (",", ", "),
    ("bool&", "bool &"),
    (" *", "*"),
    (" __ptr64", ""),
    ("__ptr64", ""),
    ("__int64", "long"),
    (" &", "&"),
    (" ,", ","),
    (" )", ")"),
)


def normalise_symbol(name) -> Column:
    column = F.col(name) if isinstance(name, str) else name
    for old, new in REPLACEMENTS:
        column = F.replace(column, F.lit(old), F.lit(new))
    return column


def split_outside_brackets(text: str) -> list[str]:
    """Parts between blanks that stand in no bracket."""
    parts, depth = [""], 0
    for c in text:
        depth += (c in "(<[") - (c in ")>]")
        if c == " " and depth <= 0:
            parts.append("")
        else:
            parts[-1] += c
    return parts


def stem(text: str) -> str:
    """A normalised name without its return type (leading parts with no parenthesis) and without a trailing [...] part."""
    if all(c.isascii() and (c.isalnum() or c == "_") for c in text):
        return text
    parts = split_outside_brackets(text)
    while parts and "(" not in parts[0]:
        parts.pop(0)
    if parts and parts[-1].startswith("[") and len(parts[-1]) > 2:
        parts.pop()
    out = ""
    for i, part in enumerate(parts):
        last, follower = i == len(parts) - 1, parts[i + 1] if i + 1 < len(parts) else ""
        glued = part.endswith("(") or (i + 2 < len(parts) and follower.startswith("&"))
        out += part if last or glued else part + " "
    return out.replace("  ", " ")


def stem_symbol(name) -> Column:
    """SQL for the replacements, one Arrow function for the bracket-aware part."""
    @F.pandas_udf("string")
    def stems(names: pd.Series) -> pd.Series:
        return names.map(lambda n: None if n is None else stem(n))

    return stems(normalise_symbol(name))


def decode_name(name) -> Column:
    return F.unbase64(name).cast("string")


def file_id(content) -> Column:
    """First 64 bits of the SHA-256 of a file, as 16 hex digits."""
    return F.substring(F.sha2(content, 256), 1, 16)
