"""Memory of a series: autocorrelations, portmanteau statistics, variance ratios and Hurst exponents.

All take returns (series_id, rn, r, n) and give one row for each series (and lag, horizon or order).
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F

#: Lags and orders of the contract; fixed values.
ACF_LAGS = [*range(1, 21), 25, 30, 40, 50, 75, 100, 125, 150, 200, 250]
IACF_UP_TO = [5, 10, 20, 50, 100, 250]
LJUNG_BOX_ORDERS = [5, 10, 20, 50]
VARIANCE_RATIO_STEPS = [2, 5, 10]
HURST_MIN, HURST_MAX, HURST_COUNT, HURST_SCALES = 16, 256, 12, 4


def _order() -> WindowSpec:
    return Window.partitionBy("series_id").orderBy("rn")


def _all() -> WindowSpec:
    return Window.partitionBy("series_id")


def acf(returns: DataFrame, lags: list[int] = ACF_LAGS, value: Column | None = None) -> DataFrame:
    """(series_id, n, lag, acf): biased, about the mean of all; null beyond the series. One window pass for all lags."""
    x = F.col("r") if value is None else value
    rows = returns.select("series_id", "rn", x.alias("x")).withColumn("d", F.col("x") - F.avg("x").over(_all()))
    rows = rows.select("series_id", "d", *(F.lead("d", k).over(_order()).alias(f"d{k}") for k in lags))
    square = F.sum(F.col("d") * F.col("d"))
    sums = rows.groupBy("series_id").agg(F.count("*").alias("n"), *(F.try_divide(F.sum(F.col("d") * F.col(f"d{k}")), square).alias(f"a{k}") for k in lags))
    pairs = F.explode(F.array(*(F.struct(F.lit(k).alias("lag"), F.col(f"a{k}").alias("acf")) for k in lags)))
    return sums.select("series_id", "n", pairs.alias("p")).select("series_id", "n", "p.lag", "p.acf")


def acf_arrays(returns: DataFrame, lags: list[int], values: dict[str, Column]) -> DataFrame:
    """(series_id, n, name...): for each value an array of its autocorrelations at the lags, from one window pass and one aggregation for all."""
    rows = returns.select("series_id", "rn", *(v.alias(f"_{name}") for name, v in values.items()))
    rows = rows.withColumns({f"_{name}": F.col(f"_{name}") - F.avg(f"_{name}").over(_all()) for name in values})
    ahead = [F.lead(f"_{name}", k).over(_order()).alias(f"_{name}_{k}") for name in values for k in lags]
    rows = rows.select("series_id", *(f"_{name}" for name in values), *ahead)
    square = {name: F.sum(F.col(f"_{name}") * F.col(f"_{name}")) for name in values}
    arrays = [F.array(*(F.try_divide(F.sum(F.col(f"_{name}") * F.col(f"_{name}_{k}")), square[name]) for k in lags)).alias(name) for name in values]
    return rows.groupBy("series_id").agg(F.count("*").alias("n"), *arrays)


def integrated_acf(grid: DataFrame, up_to: list[int] = IACF_UP_TO) -> DataFrame:
    """Sum of absolute autocorrelations over the grid's lags up to each bound."""
    bounds = grid.withColumn("up_to", F.explode(F.array(*(F.lit(k) for k in up_to)))).where("lag <= up_to")
    return bounds.groupBy("series_id", "up_to").agg(F.sum(F.abs("acf")).alias("iacf"))


def ljung_box(returns: DataFrame, orders: list[int] = LJUNG_BOX_ORDERS, value: Column | None = None) -> DataFrame:
    """Q statistic over every lag up to each order."""
    every = acf(returns, list(range(1, max(orders) + 1)), value)
    terms = every.withColumn("order", F.explode(F.array(*(F.lit(m) for m in orders)))).where("lag <= order and acf is not null")
    q = F.first("n") * (F.first("n") + 2.0) * F.sum(F.col("acf") * F.col("acf") / (F.col("n") - F.col("lag")))
    return terms.groupBy("series_id", "order").agg(q.alias("q"))


def variance_ratio(returns: DataFrame, steps: list[int] = VARIANCE_RATIO_STEPS) -> DataFrame:
    """Variance of overlapping sums of q returns against q times the variance of one."""
    sums = returns
    for q in steps:
        sums = sums.withColumn(f"s{q}", F.when(F.col("rn") >= q - 1, F.sum("r").over(_order().rowsBetween(-(q - 1), 0))))
    ratio = lambda q: F.when(F.count("*") > q + 2, F.try_divide(F.var_samp(f"s{q}"), q * F.var_samp("r")))
    wide = sums.groupBy("series_id").agg(*(ratio(q).alias(f"v{q}") for q in steps))
    pairs = F.explode(F.array(*(F.struct(F.lit(q).alias("q"), F.col(f"v{q}").alias("variance_ratio")) for q in steps)))
    return wide.select("series_id", pairs.alias("p")).select("series_id", "p.*")


def log_windows(low: int = HURST_MIN, high: int = HURST_MAX, count: int = HURST_COUNT) -> list[int]:
    """Window lengths in even steps of their logarithm, cut to integers."""
    return sorted({max(int(w), 2) for w in np.geomspace(low, high, count)})


def _chunks(rows: DataFrame, low: int = HURST_MIN, high: int = HURST_MAX) -> DataFrame:
    """Rows (series_id, n, rn, x) once for each window length w that fits at least twice, in whole chunks."""
    windows = F.explode(F.array(*(F.lit(w) for w in log_windows(low, high))))
    out = rows.withColumn("w", windows).where("w <= n div 2 and rn < (n div w) * w and n div w >= 2")
    return out.where(F.col("n") >= max(2 * low, 64)).withColumn("chunk", F.expr("rn div w"))


def _slope(scales: DataFrame) -> DataFrame:
    slope = F.when(F.count("*") >= HURST_SCALES, F.regr_slope(F.log("level"), F.log("w")))
    return scales.where("level > 0").groupBy("series_id").agg(slope.alias("hurst"))


def hurst_rs(returns: DataFrame, low: int = HURST_MIN, high: int = HURST_MAX) -> DataFrame:
    """Rescaled range: slope of the log mean R/S over the log window length."""
    key = ["series_id", "w", "chunk"]
    rows = _chunks(returns.select("series_id", "n", "rn", F.col("r").alias("x")), low, high)
    # both windows have one order, so one sort serves them
    order = Window.partitionBy(*key).orderBy("rn")
    whole, so_far = (order.rowsBetween(Window.unboundedPreceding, end) for end in (Window.unboundedFollowing, Window.currentRow))
    rows = rows.withColumn("d", F.col("x") - F.avg("x").over(whole))
    rows = rows.withColumn("y", F.sum("d").over(so_far))
    spans = rows.groupBy(*key).agg((F.max("y") - F.min("y")).alias("range"), F.stddev_samp("x").alias("s")).where("s > 0")
    return _slope(spans.groupBy("series_id", "w").agg(F.avg(F.col("range") / F.col("s")).alias("level")))


def hurst_dfa(returns: DataFrame, low: int = HURST_MIN, high: int = HURST_MAX) -> DataFrame:
    """Detrended fluctuation: slope of the log mean residual root mean square over the log window length."""
    profile = returns.withColumn("d", F.col("r") - F.avg("r").over(_all())).select("series_id", "n", "rn", F.sum("d").over(_order()).alias("x"))
    rows = _chunks(profile, low, high).withColumn("t", F.expr("cast(rn % w as double)"))
    rest = F.regr_syy("x", "t") - F.regr_sxy("x", "t") * F.regr_sxy("x", "t") / F.regr_sxx("x", "t")
    spans = rows.groupBy("series_id", "w", "chunk").agg(F.sqrt(F.greatest(rest, F.lit(0.0)) / F.count("*")).alias("f"))
    return _slope(spans.groupBy("series_id", "w").agg(F.avg("f").alias("level")))
