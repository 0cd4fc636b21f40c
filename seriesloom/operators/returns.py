"""Log returns, length policy, horizon targets, lag windows and rolling-origin folds."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .catalog import MINIMUM, TARGET

#: Lag window for each horizon, in steps.
WINDOWS = {1: 64, 5: 32, 20: 16}
FOLDS = 3
#: A series' prices are dealt to so many parts before its last ones are looked for.
PARTS = 32


def log_returns(prices: DataFrame) -> DataFrame:
    """(series_id, market, date, r, rn, n) for series whose closes are all positive; rn counts from 0."""
    by_series = Window.partitionBy("series_id")
    clean = F.count_if(F.col("close") > 0).over(by_series) == F.count("*").over(by_series)
    order = by_series.orderBy("date", "close")
    step = F.when(F.col("close") > 0, F.log("close")) - F.lag(F.when(F.col("close") > 0, F.log("close"))).over(order)
    steps = prices.select("series_id", "market", "date", clean.alias("clean"), step.alias("r")).where("clean and r is not null")
    return steps.select("series_id", "market", "date", "r", (F.row_number().over(by_series.orderBy("date")) - 1).alias("rn"), F.count("*").over(by_series).alias("n"))


def length_policy(returns: DataFrame, target: int = TARGET, minimum: int = MINIMUM) -> DataFrame:
    """Series below the minimum go; of those above the target the last ones stay; rn counts from 0 again."""
    kept = returns.where((F.col("n") >= minimum) & (F.col("rn") >= F.col("n") - target))
    return kept.select("series_id", "market", "date", "r", (F.col("rn") - F.greatest(F.col("n") - target, F.lit(0))).alias("rn"), F.least("n", F.lit(target)).alias("n"), (F.col("n") < target).alias("short_series"))


def last_returns(prices: DataFrame, target: int = TARGET, minimum: int = MINIMUM) -> DataFrame:
    """What :func:`length_policy` keeps of :func:`log_returns`, from the last ``target + 1`` prices of each series alone.

    Sizes come from an aggregation, and the last prices of a series are among the last ones of its parts, so no task sorts a long series.
    """
    good = F.count_if(F.col("close") > 0)
    sizes = prices.groupBy("series_id").agg(F.count("*").alias("_rows"), good.alias("_good")).where("_rows = _good")
    sizes = sizes.select("series_id", (F.col("_rows") - 1).alias("_n")).where(F.col("_n") >= minimum)
    newest = [F.desc("date"), F.desc("close")]
    nth = lambda *keys: F.row_number().over(Window.partitionBy("series_id", *keys).orderBy(*newest))
    rows = prices.select("series_id", "market", "date", "close", F.pmod(F.xxhash64("date", "close"), F.lit(PARTS)).alias("_part"))
    near = rows.join(sizes, "series_id").withColumn("_nth", nth("_part")).where(F.col("_nth") <= target + 1).withColumn("_back", nth())
    step = F.log("close") - F.lead(F.log("close")).over(Window.partitionBy("series_id").orderBy(*newest))
    kept = near.withColumn("r", step).where((F.col("_back") <= target) & (F.col("_back") <= F.col("_n")))
    size = F.least("_n", F.lit(target))
    return kept.select("series_id", "market", "date", "r", (size - F.col("_back")).alias("rn"), size.alias("n"), (F.col("_n") < target).alias("short_series"))


def horizon_targets(returns: DataFrame, horizon: int) -> DataFrame:
    """y: the sum of the next ``horizon`` returns, where there are so many."""
    ahead = Window.partitionBy("series_id").orderBy("rn").rowsBetween(1, horizon)
    return returns.withColumn("y", F.sum("r").over(ahead)).where(F.col("rn") < F.col("n") - horizon)


def trailing_sums(returns: DataFrame, horizon: int) -> DataFrame:
    """f: the sum of the last ``horizon`` returns, where there are so many."""
    back = Window.partitionBy("series_id").orderBy("rn").rowsBetween(-(horizon - 1), 0)
    return returns.withColumn("f", F.sum("r").over(back)).where(F.col("rn") >= horizon - 1)


def supervised(returns: DataFrame, horizon: int, window: int | None = None) -> DataFrame:
    """Rows (series_id, date, i, m, x, y): the window of trailing sums at each anchor, and its target; i counts from 0."""
    window = window or WINDOWS[horizon]
    order = Window.partitionBy("series_id").orderBy("rn")
    sums = returns.withColumn("y", F.sum("r").over(order.rowsBetween(1, horizon))).withColumn("f", F.sum("r").over(order.rowsBetween(-(horizon - 1), 0)))
    rows = sums.where(F.col("rn") >= horizon - 1).withColumn("x", F.collect_list("f").over(order.rowsBetween(-(window - 1), 0)))
    first = horizon - 1 + window - 1
    rows = rows.where((F.col("rn") >= first) & (F.col("rn") < F.col("n") - horizon))
    return rows.select("series_id", "market", "date", (F.col("rn") - first).alias("i"), (F.col("n") - horizon - first).alias("m"), "x", "y", F.col("f").alias("last"))


def fold_bounds(m, folds: int = FOLDS):
    """(test size, first training size) for m rows."""
    test = F.greatest(F.lit(1), F.floor(m / (folds + 1)))
    return test, m - folds * test


def with_folds(rows: DataFrame, folds: int = FOLDS) -> DataFrame:
    """Each row once for each fold it takes part in: part is train or test; training always starts at the first row."""
    test, initial = fold_bounds(F.col("m"), folds)
    out = rows.withColumn("_test", test).withColumn("_initial", initial).withColumn("fold", F.explode(F.sequence(F.lit(1), F.lit(folds))))
    start = F.col("_initial") + (F.col("fold") - 1) * F.col("_test")
    part = F.when(F.col("i") < start, "train").when(F.col("i") < start + F.col("_test"), "test")
    return out.withColumn("part", part).withColumn("train_n", start).where("part is not null").drop("_test", "_initial")


def split_metadata(folded: DataFrame) -> DataFrame:
    """First and last anchors of training and test for each series and fold."""
    of = lambda f, part, name: f(F.when(F.col("part") == part, F.col("date"))).alias(name)
    return folded.groupBy("series_id", "fold").agg(
        F.count_if(F.col("part") == "train").alias("n_train"), F.count_if(F.col("part") == "test").alias("n_test"),
        of(F.min, "train", "train_start"), of(F.max, "train", "train_end"), of(F.min, "test", "test_start"), of(F.max, "test", "test_end"),
    )


def fold_leaks(splits: DataFrame) -> DataFrame:
    """Folds in which training does not end before the test begins: there should be none."""
    return splits.agg(F.count("*").alias("n_folds"), F.count_if(F.col("train_end") >= F.col("test_start")).alias("n_violations"))


def fold_segments(splits: DataFrame, returns: DataFrame) -> DataFrame:
    """Range join: each fold's returns from the first to the last training anchor."""
    s = splits.select("series_id", "fold", "train_start", "train_end")
    return returns.join(s, "series_id").where("date between train_start and train_end")
