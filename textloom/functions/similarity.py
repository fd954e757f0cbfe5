"""String similarity: native bounds first, exact ratios in Arrow batches for what is left."""

from __future__ import annotations

from difflib import SequenceMatcher

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T


def common_subsequence(a: str, b: str) -> int:
    """Length of the longest common subsequence, by bit vectors."""
    masks: dict[str, int] = {}
    for i, c in enumerate(a):
        masks[c] = masks.get(c, 0) | 1 << i
    row = (1 << len(a)) - 1
    full = row
    for c in b:
        x = row & masks.get(c, 0)
        row = ((row + x) | (row - x)) & full
    return len(a) - row.bit_count()


def indel(a: str | None, b: str | None) -> float | None:
    """100 * (1 - insertions and deletions / lengths); two empty strings are alike."""
    if a is None or b is None:
        return None
    n = len(a) + len(b)
    return 200.0 * common_subsequence(a, b) / n if n else 100.0


def matcher(a: str | None, b: str | None) -> float | None:
    return None if a is None or b is None else SequenceMatcher(None, a, b).ratio()


@F.pandas_udf(T.DoubleType())
def indel_ratio(a: pd.Series, b: pd.Series) -> pd.Series:
    return pd.Series([indel(x, y) for x, y in zip(a, b, strict=True)], dtype="float64")


@F.pandas_udf(T.DoubleType())
def matcher_ratio(a: pd.Series, b: pd.Series) -> pd.Series:
    return pd.Series([matcher(x, y) for x, y in zip(a, b, strict=True)], dtype="float64")


def may_reach(a: Column, b: Column, ratio: float | Column) -> Column:
    """Necessary for a ratio (0 to 1) of either kind: few enough edits for the lengths. Levenshtein's distance is never the larger one."""
    room = F.floor((F.length(a) + F.length(b)) * (F.lit(1.0) - (F.lit(ratio) if isinstance(ratio, float) else ratio)) + F.lit(1e-6)).cast("int")
    return F.levenshtein(a, b) <= room


def token_distance(a: Column, b: Column) -> Column:
    """Edit distance between two arrays of words, natively: every distinct word becomes one private-use character."""
    known = F.array_distinct(F.concat(a, b))
    coded = lambda xs: F.array_join(F.transform(xs, lambda w: F.decode(F.unhex(F.lpad(F.hex(F.array_position(known, w) + 0xDFFF), 4, "0")), "UTF-16BE")), "")
    return F.levenshtein(coded(a), coded(b))
