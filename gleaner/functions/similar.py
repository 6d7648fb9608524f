"""Likeness of short names."""

from __future__ import annotations

from difflib import SequenceMatcher

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from gleaner.functions.text import overlap


@F.pandas_udf(T.DoubleType())
def blocks_ratio(a: pd.Series, b: pd.Series) -> pd.Series:
    """The share of letters in matching blocks, each different pair worked out once; null where a side is null."""
    pairs = pd.MultiIndex.from_arrays([a, b])
    codes, different = pd.factorize(pairs)
    ratios = [None if not isinstance(x, str) or not isinstance(y, str) else SequenceMatcher(None, x, y).ratio() for x, y in different]
    return pd.Series(ratios, dtype="float64").take(codes).reset_index(drop=True)


def likeness(a: Column, b: Column) -> Column:
    """Of two normalised names the greater of common words and matching blocks, 0 to 1; null where one is blank.

    Names that are equal or have equal words need no comparison of letters."""
    a, b = F.nullif(F.trim(a), F.lit("")), F.nullif(F.trim(b), F.lit(""))
    words = overlap(F.array_distinct(F.split(a, r"\s+")), F.array_distinct(F.split(b, r"\s+")))
    open_ = a.isNotNull() & b.isNotNull() & (words < 1)
    letters = F.when(open_, blocks_ratio(F.when(open_, a), F.when(open_, b)))
    return F.when(a.isNull() | b.isNull(), None).otherwise(F.greatest(words, F.coalesce(letters, F.lit(0.0))))
