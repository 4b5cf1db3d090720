"""Similarities: numbers, edits, glyph confusions and token sets."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType

from fieldwright.functions import constants as K


def numeric_similarity(a: Column, b: Column) -> Column:
    """1 less the relative difference, from 0 to 1; two nulls are alike, one null is not."""
    top = F.greatest(F.abs(a), F.abs(b))
    ratio = F.greatest(F.lit(0.0), 1 - F.try_divide(F.abs(a - b).cast("double"), top.cast("double")))
    return F.when(a.isNull() & b.isNull(), 1.0).when(a.isNull() | b.isNull(), 0.0).when((a == b) | (top == 0), 1.0).otherwise(ratio)


def close(a: Column, b: Column, tolerance: float = 0.02) -> Column:
    """Equal up to a tolerance, or a ten-thousandth of b where that is more; null is close to nothing."""
    return F.coalesce(F.abs(a - b) <= F.greatest(F.lit(tolerance), F.abs(b) * 1e-4), F.lit(False))


def char_misread(truth: Column, seen: Column) -> Column:
    """True: one or two glyphs were confused; false: another edit of one or two; null: no such edit."""
    lt, ls = F.length(truth), F.length(seen)
    d = F.levenshtein(truth, seen)
    known = [p for a, b in K.GLYPH_PAIRS for p in (a + b, b + a)]
    pairs = F.zip_with(F.split(truth, ""), F.split(seen, ""), lambda x, y: F.when(x != y, F.concat(x, y)))
    glyphs = F.forall(pairs, lambda p: p.isNull() | p.isin(*known))
    near = (lt > 0) & (ls > 0) & (F.abs(lt - ls) <= 1) & d.between(1, 2)
    return F.when(near, (lt == ls) & F.coalesce(glyphs, F.lit(False)))


def _common(a: str, b: str) -> int:
    """Length of the longest common subsequence, bit-parallel over b."""
    where: dict[str, int] = {}
    for i, ch in enumerate(b):
        where[ch] = where.get(ch, 0) | 1 << i
    full = (1 << len(b)) - 1
    row = full
    for ch in a:
        hit = row & where.get(ch, 0)
        row = ((row + hit) | (row - hit)) & full
    return len(b) - row.bit_count()


def indel_ratio(a: str, b: str) -> float:
    """100 times twice the common subsequence over both lengths."""
    n = len(a) + len(b)
    return 100.0 * 2 * _common(a, b) / n if n else 100.0


def token_set_ratio(a: str | None, b: str | None) -> float:
    """Likeness of two texts as sets of words, 0 to 100; null or empty is like nothing."""
    if not a or not b:
        return 0.0
    x, y = set(a.split()), set(b.split())
    if not x or not y:
        return 0.0
    both, only_a, only_b = " ".join(sorted(x & y)), " ".join(sorted(x - y)), " ".join(sorted(y - x))
    if both and (not only_a or not only_b):
        return 100.0
    with_a, with_b = f"{both} {only_a}".strip(), f"{both} {only_b}".strip()
    best = indel_ratio(with_a, with_b)
    return max(best, indel_ratio(both, with_a), indel_ratio(both, with_b)) if both else best


@F.pandas_udf(DoubleType())
def fuzzy_score(a: pd.Series, b: pd.Series) -> pd.Series:
    return pd.Series(np.fromiter((token_set_ratio(x, y) for x, y in zip(a, b, strict=True)), float, len(a)))


@F.pandas_udf(DoubleType())
def text_ratio(a: pd.Series, b: pd.Series) -> pd.Series:
    """indel_ratio of two texts; null where one is null."""
    return pd.Series([None if x is None or y is None else indel_ratio(x, y) for x, y in zip(a, b, strict=True)], dtype=float)
