"""Keyword overlap, longest-common-subsequence ratios and cosine."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType

from ..schemas import DEFAULTS, Params
from .numbers import half_up
from .text import tokenize


def keyword_overlap(a: Column, b: Column) -> Column:
    """Common distinct tokens over the root of the product of both counts; 0 if either has none."""
    x, y = F.array_distinct(tokenize(a)), F.array_distinct(tokenize(b))
    return token_overlap(x, y)


def token_overlap(x: Column, y: Column) -> Column:
    both = F.size(F.array_intersect(x, y))
    return F.when((F.size(x) > 0) & (F.size(y) > 0), both / F.sqrt((F.size(x) * F.size(y)).cast("double"))).otherwise(F.lit(0.0))


def lcs_length(a: str, b: str) -> int:
    """Longest common subsequence, bit-parallel over whole-number bit sets (Hyyrö 2004)."""
    if len(a) > len(b):
        a, b = b, a
    places: dict[str, int] = {}
    for i, c in enumerate(a):
        places[c] = places.get(c, 0) | 1 << i
    full = (1 << len(a)) - 1
    v = full
    for c in b:
        u = v & places.get(c, 0)
        v = (v + u | v - u) & full
    return (v ^ full).bit_count()


def ratio(a: str, b: str) -> float:
    return 200.0 * lcs_length(a, b) / (len(a) + len(b)) if a or b else 100.0


def token_set_ratio(a: str, b: str) -> float:
    """Best of three ratios over common words, and common words with either side's rest."""
    x, y = set(a.split()), set(b.split())
    common = " ".join(sorted(x & y))
    left = f"{common} {' '.join(sorted(x - y))}".strip()
    right = f"{common} {' '.join(sorted(y - x))}".strip()
    return max(ratio(common, left), ratio(common, right), ratio(left, right))


def _fuzzy(a: str | None, b: str | None) -> float:
    if not a or not b or not a.strip() or not b.strip():
        return 0.0
    return token_set_ratio(a.lower(), b.lower()) / 100.0


@F.pandas_udf(DoubleType())
def fuzzy_ratio(a: pd.Series, b: pd.Series) -> pd.Series:
    """0 if either is blank, else the token set ratio of both in lower case, 0 to 1."""
    return pd.Series([_fuzzy(x, y) for x, y in zip(a, b, strict=True)], dtype="float64")


def semantic_score(a: Column, b: Column, params: Params = DEFAULTS) -> Column:
    return half_up(F.lit(params.overlap_weight) * keyword_overlap(a, b) + F.lit(params.fuzzy_weight) * fuzzy_ratio(a, b), 4)


def cosine(a: Column, b: Column) -> Column:
    """0 for empty vectors, unequal lengths or a zero norm; components are doubles."""
    zero = F.lit(0.0)
    dot = F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), zero, lambda t, x: t + x)
    na = F.aggregate(a, zero, lambda t, x: t + x.cast("double") * x.cast("double"))
    nb = F.aggregate(b, zero, lambda t, x: t + x.cast("double") * x.cast("double"))
    sound = (F.size(a) > 0) & (F.size(a) == F.size(b)) & (na > 0) & (nb > 0)
    return F.when(sound, dot / (F.sqrt(na) * F.sqrt(nb))).otherwise(zero)


def character_error_rate(truth: Column, found: Column) -> Column:
    return F.levenshtein(truth, found) / F.greatest(F.length(truth), F.lit(1)).cast("double")




def levenshtein_share(truth: Column, found: Column) -> Column:
    """Character error rate: edits over the length of the truth; an empty truth counts as one character."""
    return F.levenshtein(F.coalesce(truth, F.lit("")), F.coalesce(found, F.lit(""))) / F.greatest(F.length(F.coalesce(truth, F.lit(""))), F.lit(1))
