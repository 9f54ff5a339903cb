"""How alike two short strings are."""

from __future__ import annotations

from difflib import SequenceMatcher

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType


def token_jaccard(a: str | Column, b: str | Column) -> Column:
    """Shared over all white-space tokens; 0 if a side has none."""
    x = F.array_remove(F.array_distinct(F.split(a, r"\s+")), "")
    y = F.array_remove(F.array_distinct(F.split(b, r"\s+")), "")
    return F.when((F.size(x) == 0) | (F.size(y) == 0), F.lit(0.0)).otherwise(F.size(F.array_intersect(x, y)) / F.size(F.array_union(x, y)))


def length_bound(a: Column, b: Column) -> Column:
    """What the sequence ratio of two strings can reach at most, by their lengths alone."""
    return 2.0 * F.least(F.length(a), F.length(b)) / (F.length(a) + F.length(b))


@F.pandas_udf(DoubleType())
def sequence_ratio(a: pd.Series, b: pd.Series) -> pd.Series:
    """Ratcliff-Obershelp ratio. Batches come and go through Arrow; a matcher is kept while the second string repeats."""
    out, matcher, last = [], SequenceMatcher(None), None
    for x, y in zip(a, b, strict=True):
        if x is None or y is None:
            out.append(None)
            continue
        if y != last:
            matcher.set_seq2(y)
            last = y
        matcher.set_seq1(x)
        out.append(matcher.ratio())
    return pd.Series(out, dtype="float64")
