"""Edit distances: the built-in one, and two with transpositions as Arrow functions behind cheap built-in guards."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, functions as F
from pyspark.sql.types import IntegerType


def levenshtein(a, b) -> Column:
    return F.levenshtein(F.lower(a), F.lower(b))


def damerau_distance(a: str, b: str) -> int:
    """Unrestricted: a transposed pair may be edited again. A metric."""
    a, b = a.lower(), b.lower()
    far = len(a) + len(b)
    row_of: dict[str, int] = {}
    d = {(-1, -1): far}
    for i in range(len(a) + 1):
        d[i, -1], d[i, 0] = far, i
    for j in range(len(b) + 1):
        d[-1, j], d[0, j] = far, j
    for i in range(1, len(a) + 1):
        column = 0
        for j in range(1, len(b) + 1):
            k, m = row_of.get(b[j - 1], 0), column
            if a[i - 1] == b[j - 1]:
                column = j
            d[i, j] = min(d[i - 1, j - 1] + (a[i - 1] != b[j - 1]), d[i, j - 1] + 1, d[i - 1, j] + 1, d[k - 1, m - 1] + (i - k - 1) + 1 + (j - m - 1))
        row_of[a[i - 1]] = i
    return d[len(a), len(b)]


def osa_distance(a: str, b: str) -> int:
    """Restricted: each pair is transposed at most once and not edited again."""
    before, above = [], list(range(len(b) + 1))
    for i in range(1, len(a) + 1):
        row = [i]
        for j in range(1, len(b) + 1):
            best = min(above[j] + 1, row[j - 1] + 1, above[j - 1] + (a[i - 1] != b[j - 1]))
            if i > 1 and j > 1 and a[i - 1] == b[j - 2] and a[i - 2] == b[j - 1]:
                best = min(best, before[j - 2] + 1)
            row.append(best)
        before, above = above, row
    return above[-1]


def _each(f):
    def run(a: pd.Series, b: pd.Series) -> pd.Series:
        return pd.Series([None if x is None or y is None else f(x, y) for x, y in zip(a, b, strict=True)], dtype="Int32")

    return F.pandas_udf(run, IntegerType())


def damerau(a, b) -> Column:
    return _each(damerau_distance)(a, b)


def osa(a, b) -> Column:
    return _each(osa_distance)(a, b)


def may_be_within(a, b, most: int) -> Column:
    """False only if a and b are farther apart than most: each transposition is at most two plain edits."""
    return (F.abs(F.length(a) - F.length(b)) <= most) & (F.levenshtein(a, b, 2 * most) >= 0)


def deletions(word, most: int = 2) -> Column:
    """The word and all that is left of it with up to most characters taken out. Words within that many edits share one of these."""
    out = F.array(word)
    for _ in range(most):
        out = F.array_union(out, F.flatten(F.transform(out, lambda w: F.when(F.length(w) > 0, F.transform(F.sequence(F.lit(1), F.greatest(F.length(w), F.lit(1))), lambda i: F.concat(F.substring(w, F.lit(1), i - 1), F.substring(w, i + 1, F.length(w))))).otherwise(F.array(w)))))
    return out
