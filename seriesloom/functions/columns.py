"""Null, rounding and rank rules that every operator follows: NaN counts as missing, division by zero gives null."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

DIGITS = 6


def missing_to_null(x: Column) -> Column:
    """NaN and infinities as null, so that aggregates skip them."""
    return F.when(F.isnan(x) | (F.abs(x) == float("inf")), None).otherwise(x)


def rounded(x: Column, digits: int = DIGITS) -> Column:
    return F.round(x, digits)


def divide(a: Column, b: Column) -> Column:
    return F.try_divide(a, b)


def average_rank(value: Column, *keys: str) -> Column:
    """Rank from 1 within the keys; ties share the mean of their ranks."""
    order = Window.partitionBy(*keys).orderBy(value)
    ties = Window.partitionBy(*keys, value)
    return F.rank().over(order) + (F.count("*").over(ties) - 1) / 2.0


def quantile(x: Column, p: float) -> Column:
    """Quantile by linear interpolation between order statistics."""
    return F.percentile(x, F.lit(p))


def conform(df: DataFrame, names_and_types: dict[str, str]) -> DataFrame:
    """Exactly these columns in this order: missing ones as null, others dropped, all cast."""
    have = set(df.columns)
    return df.select(*((F.col(n) if n in have else F.lit(None)).cast(t).alias(n) for n, t in names_and_types.items()))


def varies(x: Column) -> Column:
    """Whether an aggregate's values differ: where means of parts are merged, rounding gives equal ones a deviation above zero."""
    return F.min(x) < F.max(x)


def bias_corrected_skewness(x: Column) -> Column:
    n = F.count(x)
    return F.when((n > 2) & varies(x), F.skewness(x) * F.sqrt(n * (n - 1.0)) / (n - 2))


def bias_corrected_kurtosis(x: Column) -> Column:
    """Excess kurtosis of a sample."""
    n = F.count(x)
    return F.when((n > 3) & varies(x), (n - 1.0) / ((n - 2.0) * (n - 3.0)) * ((n + 1.0) * F.kurtosis(x) + 6.0))
