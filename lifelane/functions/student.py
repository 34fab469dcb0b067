"""Student's t distribution for result tables of a few rows."""

from __future__ import annotations

import math

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F


def two_sided(t: float | None, df: float | None) -> float | None:
    """The share of the distribution beyond |t| on both sides: a regularised incomplete beta function by its continued fraction."""
    if t is None or df is None or math.isnan(t) or math.isnan(df) or df <= 0:
        return None
    if math.isinf(t):
        return 0.0
    a, b, x = df / 2, 0.5, df / (df + t * t)
    if x > (a + 1) / (a + b + 2):
        return 1.0 - _beta(b, a, 1 - x)
    return _beta(a, b, x)


def _beta(a: float, b: float, x: float) -> float:
    if x <= 0:
        return 0.0
    tiny, c = 1e-300, 1.0
    d = 1 / (1 - (a + b) * x / (a + 1) or tiny)
    total = d
    for m in range(1, 500):
        for k in (m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m)), -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1))):
            d = 1 / (1 + k * d or tiny)
            c = 1 + k / c or tiny
            total *= c * d
        if abs(c * d - 1) < 1e-15:
            break
    return math.exp(math.lgamma(a + b) - math.lgamma(a) - math.lgamma(b) + a * math.log(x) + b * math.log1p(-x)) * total / a


def upper(share: float, df: float | None) -> float | None:
    """The t that leaves share beyond it on both sides, by bisection."""
    if df is None or math.isnan(df) or df <= 0:
        return None
    lo, hi = 0.0, 1.0
    while two_sided(hi, df) > share:
        hi *= 2
    for _ in range(200):
        mid = (lo + hi) / 2
        lo, hi = (mid, hi) if two_sided(mid, df) > share else (lo, mid)
    return (lo + hi) / 2


def p_value(t: Column, df: Column) -> Column:
    @F.pandas_udf("double")
    def run(t: pd.Series, df: pd.Series) -> pd.Series:
        return pd.Series([two_sided(x, n) for x, n in zip(t, df, strict=True)], dtype="float64")

    return run(t.cast("double"), df.cast("double"))


def critical(share: float, df: Column) -> Column:
    @F.pandas_udf("double")
    def run(df: pd.Series) -> pd.Series:
        return pd.Series([upper(share, n) for n in df], dtype="float64")

    return run(df.cast("double"))
