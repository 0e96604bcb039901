"""Column functions over arrays and texts."""

from functools import reduce

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T


def degree2(x: Column) -> Column:
    """The vector, then the upper triangle of its outer product, row by row."""
    products = F.transform(x, lambda a, i: F.transform(F.slice(x, i + 1, F.size(x) - i), lambda b: a * b))
    return F.concat(x, F.flatten(products))


def band(x: Column, lo: int, hi: int | None) -> Column:
    """A slice of an array with negative places, the end exclusive; none stands for the array's end."""
    size = F.size(x)
    start = size + lo if lo < 0 else F.lit(lo)
    end = size if hi is None else size + hi if hi < 0 else F.lit(hi)
    return F.slice(x, start + 1, end - start)


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, v: s + v)


def cosine(a: Column, b: Column) -> Column:
    """Null where either vector is zero."""
    size = F.sqrt(dot(a, a)) * F.sqrt(dot(b, b))
    return dot(a, b) / F.when(size > 0, size)


def rouge_l(candidate: Column, reference: Column) -> Column:
    """F-measure of the longest common subsequence of two word arrays of any length; 0 where either is empty or null."""
    return _rouge_l(candidate, reference)


@F.pandas_udf(T.DoubleType())
def _rouge_l(candidate: pd.Series, reference: pd.Series) -> pd.Series:
    return pd.Series([_f_measure(c, r) for c, r in zip(candidate, reference, strict=True)], dtype=float)


def _f_measure(c, r) -> float:
    """A bit for each word of the reference tells where the longest common subsequence grows."""
    if c is None or r is None or not len(c) or not len(r):
        return 0.0
    at: dict = {}
    for i, w in enumerate(r):
        at[w] = at.get(w, 0) | 1 << i
    full = v = (1 << len(r)) - 1
    for w in c:
        u = v & at.get(w, 0)
        v = ((v + u) | (v - u)) & full
    return 2.0 * (len(r) - v.bit_count()) / (len(c) + len(r))


def words(text: Column) -> Column:
    """Lower-case runs of letters and digits."""
    return F.regexp_extract_all(F.lower(text), F.lit("[a-z0-9]+"), 0)


def total(columns: list[Column]) -> Column:
    return reduce(lambda a, b: a + b, columns)
