"""Distribution, tails and complexity of a series, and its basic features; one row for each series.

All take returns (series_id, rn, r, n). Tail measures are about the series' mean.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, WindowSpec
from pyspark.sql import functions as F

from ..functions.columns import bias_corrected_kurtosis, bias_corrected_skewness, divide

HILL_SHARE, HILL_LEAST, HILL_ROWS = 0.05, 5, 50
VOLATILITY_WINDOW = 20
AMI_BINS = 24


def _order() -> WindowSpec:
    return Window.partitionBy("series_id").orderBy("rn")


def _all() -> WindowSpec:
    return Window.partitionBy("series_id")


def noise_fn(returns: DataFrame) -> DataFrame:
    """Deviation of first differences against that of the series."""
    steps = returns.withColumn("d", F.col("r") - F.lag("r").over(_order()))
    return steps.groupBy("series_id").agg(divide(F.stddev_samp("d"), F.stddev_samp("r")).alias("noise_fn"))


def permutation_entropy(returns: DataFrame) -> DataFrame:
    """Entropy of the orders of three successive values, ties by place, against that of six equal shares."""
    a, b, c = F.col("a"), F.col("b"), F.col("c")
    rows = returns.select("series_id", F.col("r").alias("a"), F.lead("r", 1).over(_order()).alias("b"), F.lead("r", 2).over(_order()).alias("c")).where("c is not null")
    kind = F.when((a <= b) & (b <= c), 0).when((a <= c) & (c < b), 1).when((b < a) & (a <= c), 2).when((b <= c) & (c < a), 3).when((c < a) & (a <= b), 4).otherwise(5)
    counts = rows.groupBy("series_id", kind.alias("kind")).agg(F.count("*").alias("k"))
    share = counts.withColumn("p", F.col("k") / F.sum("k").over(_all()))
    return share.groupBy("series_id").agg((-F.sum(F.col("p") * F.log("p")) / F.log(F.lit(6.0))).alias("permutation_entropy"))


def _centred(returns: DataFrame) -> DataFrame:
    return returns.select("series_id", "rn", (F.col("r") - F.avg("r").over(_all())).alias("x"))


def fisher_kurtosis(returns: DataFrame) -> DataFrame:
    return _centred(returns).groupBy("series_id").agg(bias_corrected_kurtosis(F.col("x")).alias("kurtosis"))


def moors_kurtosis(returns: DataFrame) -> DataFrame:
    """Kurtosis by octiles."""
    q = _centred(returns).groupBy("series_id").agg(F.percentile("x", F.array(*(F.lit(k / 8) for k in (1, 3, 5, 7, 2, 6)))).alias("q"))
    e1, e3, e5, e7, low, high = (F.col("q")[i] for i in range(6))
    return q.select("series_id", F.when(F.abs(high - low) > 1e-12, ((e7 - e5) + (e3 - e1)) / (high - low)).alias("moors"))


def tail_ratios(returns: DataFrame) -> DataFrame:
    """Outer quantiles (1 % and 99 %) against quartiles: both sides, upper, lower."""
    q = _centred(returns).groupBy("series_id").agg(F.percentile("x", F.array(*(F.lit(p) for p in (0.01, 0.25, 0.75, 0.99)))).alias("q"))
    q01, q25, q75, q99 = (F.col("q")[i] for i in range(4))
    both = divide(F.abs(q99) + F.abs(q01), F.abs(q75) + F.abs(q25))
    return q.select("series_id", both.alias("tail_both"), divide(q99, q75).alias("tail_up"), divide(F.abs(q01), F.abs(q25)).alias("tail_low"))


def hill_index(returns: DataFrame, share: float = HILL_SHARE) -> DataFrame:
    """Tail index from the largest absolute values over the next one below them."""
    rows = _centred(returns).where("x <> 0").select("series_id", F.abs("x").alias("a"), "rn")
    rows = rows.withColumn("nth", F.row_number().over(_all().orderBy(F.desc("a"), "rn"))).withColumn("n", F.count("*").over(_all())).where(F.col("n") >= HILL_ROWS)
    rows = rows.withColumn("k", F.least(F.greatest(F.lit(HILL_LEAST), F.floor(F.col("n") * share)), F.col("n") - 1))
    rows = rows.where("nth <= k + 1").withColumn("bound", F.max(F.when(F.col("nth") == F.col("k") + 1, F.col("a"))).over(_all()))
    return rows.where("nth <= k").groupBy("series_id").agg(F.first("k").alias("k"), divide(F.lit(1.0), F.avg(F.log(F.col("a") / F.col("bound")))).alias("hill"))


def distribution(returns: DataFrame, share: float = HILL_SHARE) -> DataFrame:
    """(series_id, n_obs, kurtosis, moors, tail_both, tail_up, tail_low, hill): the five measures above from one exchange and one aggregation."""
    octiles, tails = [k / 8 for k in (1, 3, 5, 7, 2, 6)], [0.01, 0.25, 0.75, 0.99]
    a, nth, m, k = F.col("a"), F.col("nth"), F.col("m"), F.col("k")
    rows = returns.select("series_id", "rn", "r", (F.col("r") - F.avg("r").over(_all())).alias("x")).withColumn("a", F.abs("x"))
    rows = rows.withColumns({"nth": F.row_number().over(_all().orderBy(F.desc("a"), "rn")), "m": F.count_if(F.col("x") != 0).over(_all())})
    rows = rows.withColumn("k", F.least(F.greatest(F.lit(HILL_LEAST), F.floor(m * share)), m - 1))
    rows = rows.withColumn("bound", F.max(F.when(nth == k + 1, a)).over(_all()))
    log_excess = F.avg(F.when((m >= HILL_ROWS) & (nth <= k), F.log(a / F.col("bound"))))
    q = F.percentile("x", F.array(*(F.lit(p) for p in octiles + tails))).alias("q")
    one = rows.groupBy("series_id").agg(F.count("r").alias("n_obs"), bias_corrected_kurtosis(F.col("x")).alias("kurtosis"), q, divide(F.lit(1.0), log_excess).alias("hill"))
    e1, e3, e5, e7, low, high, q01, q25, q75, q99 = (F.col("q")[i] for i in range(10))
    both = divide(F.abs(q99) + F.abs(q01), F.abs(q75) + F.abs(q25))
    moors = F.when(F.abs(high - low) > 1e-12, ((e7 - e5) + (e3 - e1)) / (high - low))
    return one.select("series_id", "n_obs", "kurtosis", moors.alias("moors"), both.alias("tail_both"), divide(q99, q75).alias("tail_up"), divide(F.abs(q01), F.abs(q25)).alias("tail_low"), "hill")


def mutual_information(returns: DataFrame, lag: int = 1, bins: int = AMI_BINS) -> DataFrame:
    """Mutual information of values ``lag`` apart, from a histogram of equal bins over each axis."""
    pairs = returns.select("series_id", F.col("r").alias("a"), F.lead("r", lag).over(_order()).alias("b")).where("b is not null")
    place = lambda c: F.least(F.floor((F.col(c) - F.min(c).over(_all())) / (F.max(c).over(_all()) - F.min(c).over(_all())) * bins), F.lit(bins - 1))
    cells = pairs.select("series_id", place("a").alias("i"), place("b").alias("j")).groupBy("series_id", "i", "j").agg(F.count("*").alias("k"))
    cells = cells.withColumns({"n": F.sum("k").over(_all()), "ki": F.sum("k").over(Window.partitionBy("series_id", "i")), "kj": F.sum("k").over(Window.partitionBy("series_id", "j"))})
    term = F.col("k") / F.col("n") * F.log(F.col("k").cast("double") * F.col("n") / (F.col("ki").cast("double") * F.col("kj")))
    return cells.groupBy("series_id").agg(F.sum(term).alias("ami"))


def lyapunov_time(rates: DataFrame, rate: str, least: float = 1e-3) -> DataFrame:
    """One over the divergence rate; null, with a flag, where that is not positive or too near zero."""
    x = F.col(rate)
    flag = F.when(x.isNull(), "lyapunov_time_missing_lle").when(x <= 0, "lyapunov_time_nonpositive_lle").when(x < least, "lyapunov_time_near_zero_lle").otherwise("")
    return rates.withColumns({"lyapunov_time": F.when(x >= least, 1.0 / x), "flag": flag})


def rolling_volatility(returns: DataFrame, window: int = VOLATILITY_WINDOW) -> DataFrame:
    """Population deviation of the last ``window`` returns, where there are so many."""
    return returns.withColumn("vol", F.when(F.col("rn") >= window - 1, F.stddev_pop("r").over(_order().rowsBetween(-(window - 1), 0)))).where("vol is not null")


def basic_features(returns: DataFrame) -> DataFrame:
    rows = returns.withColumns({
        "before": F.lag("r").over(_order()),
        "vol": F.when(F.col("rn") >= VOLATILITY_WINDOW - 1, F.stddev_pop("r").over(_order().rowsBetween(-(VOLATILITY_WINDOW - 1), 0))),
    })
    share = lambda condition: F.avg(F.when(condition, 1.0).otherwise(0.0))
    r, before = F.col("r"), F.col("before")
    paired = lambda condition: F.avg(F.when(before.isNull(), None).when(condition, 1.0).otherwise(0.0))
    return rows.groupBy("series_id").agg(
        F.count("*").alias("n_obs"), F.avg("r").alias("mean"), F.stddev_pop("r").alias("std"),
        bias_corrected_skewness(r).alias("skew"), bias_corrected_kurtosis(r).alias("kurt"),
        share(r > 0).alias("positive_share"), share(r < 0).alias("negative_share"),
        paired(r * before < 0).alias("sign_change_rate"), paired((r < 0) != (before < 0)).alias("zero_crossing_rate"),
        F.avg(F.abs("r")).alias("mean_abs"), F.avg("vol").alias("vol_mean"), F.stddev_samp("vol").alias("vol_std"),
    )
