"""String and set similarities as columns; those without a built-in are Arrow UDFs."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T


def _norm(c: Column) -> Column:
    return F.lower(F.trim(c))


def levenshtein_similarity(a: Column, b: Column) -> Column:
    """1 - distance / longer length, in lower case without outer space; equal: 1, one side empty: 0."""
    a, b = _norm(a), _norm(b)
    longer = F.greatest(F.length(a), F.length(b))
    return F.when(a == b, 1.0).when(F.least(F.length(a), F.length(b)) == 0, 0.0).otherwise(1 - F.levenshtein(a, b) / longer)


def bigrams(c: Column) -> Column:
    return F.array_distinct(F.when(F.length(c) > 1, F.transform(F.sequence(F.lit(1), F.length(c) - 1), lambda i: c.substr(i, F.lit(2)))).otherwise(F.array(c)))


def bigram_jaccard(a: Column, b: Column) -> Column:
    """Jaccard of the sets of character pairs; a string of one character is its own pair."""
    a, b = _norm(a), _norm(b)
    x, y = bigrams(a), bigrams(b)
    return F.when(a == b, 1.0).otherwise(F.size(F.array_intersect(x, y)) / F.size(F.array_union(x, y)))


def word_set(c: Column, least: int = 1) -> Column:
    return F.array_distinct(F.filter(F.split(F.lower(c), "[^a-z0-9]+"), lambda w: F.length(w) >= least))


def jaccard(x: Column, y: Column, both_empty: float = 1.0) -> Column:
    union = F.size(F.array_union(x, y))
    return F.when(union == 0, both_empty).otherwise(F.size(F.array_intersect(x, y)) / union)


def _jaro(s: str, t: str) -> float:
    if s == t:
        return 1.0
    if not s or not t:
        return 0.0
    window = max(max(len(s), len(t)) // 2 - 1, 0)
    used, order = [False] * len(t), []
    for i, c in enumerate(s):
        for j in range(max(0, i - window), min(len(t), i + window + 1)):
            if not used[j] and t[j] == c:
                used[j] = True
                order.append(c)
                break
    m = len(order)
    if not m:
        return 0.0
    swapped = sum(a != b for a, b in zip(order, (c for c, u in zip(t, used, strict=True) if u), strict=True)) / 2
    return (m / len(s) + m / len(t) + (m - swapped) / m) / 3


@F.pandas_udf(T.DoubleType())
def jaro_winkler(a: pd.Series, b: pd.Series) -> pd.Series:
    """Jaro similarity raised by a tenth of its distance to 1 for each of up to four equal first characters."""
    out = []
    for s, t in zip(a.fillna("").str.lower().str.strip(), b.fillna("").str.lower().str.strip(), strict=True):
        j, p = _jaro(s, t), 0
        while p < min(4, len(s), len(t)) and s[p] == t[p]:
            p += 1
        out.append(j + p * 0.1 * (1 - j))
    return pd.Series(out, dtype="float64")


def property_similarity(a: Column, b: Column) -> Column:
    """Mean over the keys of both maps: equal values 1, a missing side 0.5, otherwise their Levenshtein similarity."""
    keys = F.array_union(F.map_keys(a), F.map_keys(b))
    each = F.transform(keys, lambda k: F.when(F.element_at(a, k).isNull() | F.element_at(b, k).isNull(), 0.5).otherwise(levenshtein_similarity(F.element_at(a, k), F.element_at(b, k))))
    return F.when(F.size(keys) == 0, 1.0).otherwise(F.aggregate(each, F.lit(0.0), lambda acc, x: acc + x) / F.size(keys))


def field_similarity(pairs: list[tuple[Column, Column]]) -> Column:
    """``property_similarity`` of records whose keys are known: one pair of columns for each, a null side counts 0.5."""
    each = [F.when(a.isNull() | b.isNull(), 0.5).when(a == b, 1.0).otherwise(levenshtein_similarity(a, b)) for a, b in pairs]
    return sum(each[1:], each[0]) / len(each)


def dot(x: Column, y: Column) -> Column:
    return F.aggregate(F.zip_with(x.cast("array<double>"), y.cast("array<double>"), lambda p, q: p * q), F.lit(0.0), lambda acc, v: acc + v)


def cosine(x: Column, y: Column) -> Column:
    length = F.sqrt(dot(x, x)) * F.sqrt(dot(y, y))
    return F.when(length > 0, dot(x, y) / length).otherwise(0.0)


def euclidean(x: Column, y: Column) -> Column:
    return F.sqrt(F.aggregate(F.zip_with(x.cast("array<double>"), y.cast("array<double>"), lambda p, q: (p - q) * (p - q)), F.lit(0.0), lambda acc, v: acc + v))


def manhattan(x: Column, y: Column) -> Column:
    return F.aggregate(F.zip_with(x.cast("array<double>"), y.cast("array<double>"), lambda p, q: F.abs(p - q)), F.lit(0.0), lambda acc, v: acc + v)


def _mean(x: Column) -> Column:
    return F.aggregate(x.cast("array<double>"), F.lit(0.0), lambda acc, v: acc + v) / F.size(x)


def pearson(x: Column, y: Column) -> Column:
    centred = lambda v: F.transform(v.cast("array<double>"), lambda e: e - _mean(v))
    return cosine(centred(x), centred(y))


def softmax(x: Column) -> Column:
    """Positive shares of one, the larger the value the larger."""
    v = x.cast("array<double>")
    powers = F.transform(v, lambda e: F.exp(e - F.array_max(v)))
    total = F.aggregate(powers, F.lit(0.0), lambda acc, e: acc + e)
    return F.transform(powers, lambda e: e / total)


def min_max(x: Column) -> Column:
    """Values from 0, the least, to 1, the largest; all 0 if they are equal."""
    v = x.cast("array<double>")
    low, high = F.array_min(v), F.array_max(v)
    return F.transform(v, lambda e: F.when(high > low, (e - low) / (high - low)).otherwise(0.0))
