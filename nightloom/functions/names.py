"""Names in columns of pandas: what has no built-in function."""

from __future__ import annotations

import difflib
import unicodedata

import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StringType


def clean(name: str | None) -> str | None:
    return None if name is None else "".join(unicodedata.normalize("NFKC", name).split())


@F.pandas_udf(StringType())
def normalized(name: pd.Series) -> pd.Series:
    """Compatibility forms made plain, white space removed; null stays null."""
    return name.map(clean, na_action="ignore")


@F.pandas_udf(DoubleType())
def similarity(a: pd.Series, b: pd.Series) -> pd.Series:
    """Ratio of matching characters of two normalised names; null if either is."""
    return pd.Series([None if x is None or y is None else difflib.SequenceMatcher(None, clean(x), clean(y)).ratio() for x, y in zip(a, b, strict=True)], dtype="float64")


@F.pandas_udf(DoubleType())
def ratio(a: pd.Series, b: pd.Series) -> pd.Series:
    """Ratio of matching characters of two names as they are."""
    matcher, out = difflib.SequenceMatcher(), []
    last = None
    for x, y in zip(a, b, strict=True):
        if y != last:  # the index of a second name serves all its neighbours
            matcher.set_seq2(y)
            last = y
        matcher.set_seq1(x)
        out.append(matcher.ratio())
    return pd.Series(out, dtype="float64")
