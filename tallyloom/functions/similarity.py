"""String similarities as Column expressions; Jaro-Winkler as a vectorised function."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType

from tallyloom.functions.text import tokenize


def levenshtein_similarity(a: Column, b: Column) -> Column:
    """1 less the edit distance over the longer length; 1 for two empty strings."""
    longest = F.greatest(F.length(a), F.length(b))
    return F.when(longest == 0, F.lit(1.0)).otherwise(F.lit(1.0) - F.levenshtein(a, b) / longest)


def _trigrams(text: Column) -> Column:
    padded = F.concat(F.lit("  "), F.upper(text), F.lit(" "))
    return F.array_distinct(F.transform(F.sequence(F.lit(1), F.length(padded) - 2), lambda k: F.substring(padded, k, F.lit(3))))


def _jaccard(x: Column, y: Column) -> Column:
    union = F.size(F.array_union(x, y))
    return F.when(union == 0, F.lit(0.0)).otherwise(F.size(F.array_intersect(x, y)) / union)


def trigram_similarity(a: Column, b: Column) -> Column:
    """Jaccard index of the padded trigrams; 0 if a side is empty."""
    return F.when((F.length(a) == 0) | (F.length(b) == 0), F.lit(0.0)).otherwise(_jaccard(_trigrams(a), _trigrams(b)))


def token_set_ratio(a: Column, b: Column) -> Column:
    """0.7 of the word Jaccard plus 0.3 of the trigrams of the sorted words; 0 without a
    shared word; 6 places."""
    x, y = F.array_distinct(tokenize(a)), F.array_distinct(tokenize(b))
    line = lambda words: F.array_join(F.sort_array(words), " ")
    mixed = 0.7 * _jaccard(x, y) + 0.3 * trigram_similarity(line(x), line(y))
    return F.when(F.size(F.array_intersect(x, y)) == 0, F.lit(0.0)).otherwise(F.round(mixed, 6))


def jaro(a: str, b: str) -> float:
    """Jaro similarity; window half the longer length less one, whole half transpositions."""
    if a == b:
        return 1.0
    if not a or not b:
        return 0.0
    reach = max(max(len(a), len(b)) // 2 - 1, 0)
    used = [False] * len(b)
    hits_a = []
    for i, c in enumerate(a):
        for j in range(max(0, i - reach), min(len(b), i + reach + 1)):
            if not used[j] and b[j] == c:
                used[j] = True
                hits_a.append(c)
                break
    if not hits_a:
        return 0.0
    hits_b = [b[j] for j in range(len(b)) if used[j]]
    swaps = sum(x != y for x, y in zip(hits_a, hits_b, strict=True)) // 2
    m = len(hits_a)
    return (m / len(a) + m / len(b) + (m - swaps) / m) / 3


def jaro_winkler(a: str, b: str) -> float:
    """Jaro with up to four leading equal letters rewarded from 0.7 on."""
    base = jaro(a, b)
    if base < 0.7:
        return base
    prefix = 0
    while prefix < min(4, len(a), len(b)) and a[prefix] == b[prefix]:
        prefix += 1
    return base + prefix * 0.1 * (1 - base)


def jaro_similarity(a: Column, b: Column) -> Column:
    """Jaro, vectorised; null if a side is null.  Call it on distinct pairs."""

    @F.pandas_udf(DoubleType())
    def run(x: pd.Series, y: pd.Series) -> pd.Series:
        return pd.Series([None if p is None or q is None else jaro(p, q) for p, q in zip(x, y, strict=True)], dtype="float64")

    return run(a, b)


def jaro_winkler_similarity(a: Column, b: Column) -> Column:
    """Jaro-Winkler, vectorised; null if a side is null.  Call it on distinct pairs."""

    @F.pandas_udf(DoubleType())
    def run(x: pd.Series, y: pd.Series) -> pd.Series:
        return pd.Series([None if p is None or q is None else jaro_winkler(p, q) for p, q in zip(x, y, strict=True)], dtype="float64")

    return run(a, b)
