"""Predictions of simple models and all measures of a forecast's quality, as plans.

A task is (series_id, horizon, model, fold). Predictions are rows with y and prediction; training facts are
joined, so a task's measures are one aggregation.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.columns import divide
from .returns import FOLDS, WINDOWS, supervised, with_folds

TASK = ["series_id", "horizon", "model", "fold"]
METRICS = ["mae", "mse", "rmse", "mase", "mape", "smape", "huber", "directional_accuracy", "medae", "bias", "r2", "r2_oos"]
MODELS = ["naive_last", "naive_mean", "naive_zero"]


def folded_targets(returns: DataFrame, horizons: Sequence[int] = (1, 5, 20), folds: int = FOLDS) -> DataFrame:
    """Rows (series_id, horizon, fold, part, i, train_n, y, last) of every horizon."""
    out = None
    for h in horizons:
        rows = with_folds(supervised(returns, h, WINDOWS[h]).drop("x"), folds).withColumn("horizon", F.lit(h))
        out = rows if out is None else out.unionByName(rows)
    return out


def with_train_facts(folded: DataFrame) -> DataFrame:
    """Every row with its fold's training facts: the mean, the mean over all but the last fifth, the mean absolute step.

    Windows over the fold's rows, which are together anyway: no join back, and the folds are made once.
    """
    own = Window.partitionBy("series_id", "horizon", "fold")
    train = F.col("part") == "train"
    tail = F.greatest(F.lit(1), F.floor(F.col("train_n") * 0.2))
    rows = folded.withColumn("_step", F.when(train, F.abs(F.col("y") - F.lag("y").over(own.orderBy("i")))))
    facts = {
        "train_mean": F.avg(F.when(train, F.col("y"))).over(own),
        "fit_mean": F.avg(F.when(train & (F.col("i") < F.col("train_n") - tail), F.col("y"))).over(own),
        "train_step": F.avg("_step").over(own),
    }
    return rows.withColumns(facts).drop("_step")


def naive_predictions(folded: DataFrame) -> DataFrame:
    """Test rows with the predictions zero, mean of the fitted part, and last trailing sum."""
    rows = with_train_facts(folded).where("part = 'test'")
    said = F.array(*(F.struct(F.lit(m).alias("model"), v.cast("double").alias("prediction")) for m, v in (("naive_zero", F.lit(0.0)), ("naive_mean", F.col("fit_mean")), ("naive_last", F.col("last")))))
    flat = rows.withColumn("s", F.explode(said))
    return flat.select("series_id", "market", "horizon", "fold", "i", "date", "y", "train_mean", "train_step", "s.model", "s.prediction")


def naive_tasks(folded: DataFrame) -> DataFrame:
    """The tasks that :func:`naive_predictions` has rows of, without their predictions."""
    rows = folded.where("part = 'test'").select("series_id", "horizon", "fold").distinct()
    return rows.withColumn("model", F.explode(F.array(*(F.lit(m) for m in MODELS)))).select(*TASK)


def task_metrics(predictions: DataFrame, keys: Sequence[str] = TASK) -> DataFrame:
    """The twelve measures of each task."""
    y, p = F.col("y"), F.col("prediction")
    e = y - p
    a = F.abs(e)
    quad = F.least(a, F.lit(1.0))
    both = F.abs(y) + F.abs(p)
    out = predictions.groupBy(*keys).agg(
        F.count("*").alias("n_test"), F.avg(a).alias("mae"), F.avg(e * e).alias("mse"), F.first("train_step").alias("_step"),
        (100 * F.avg(F.when(F.abs(y) > 1e-12, F.abs(e / y)))).alias("mape"), (100 * F.avg(F.when(both > 1e-12, 2 * a / both))).alias("smape"),
        F.avg(0.5 * quad * quad + (a - quad)).alias("huber"), F.avg(F.when(F.signum(y) == F.signum(p), 1.0).otherwise(0.0)).alias("directional_accuracy"),
        F.median(a).alias("medae"), F.avg(p - y).alias("bias"), F.sum(e * e).alias("_sse"), (F.var_pop(y) * F.count(y)).alias("_sst"),
        F.sum((y - F.col("train_mean")) * (y - F.col("train_mean"))).alias("_ref"),
    )
    return out.select(
        *keys, "n_test", "mae", "mse", F.sqrt("mse").alias("rmse"), divide(F.col("mae"), F.col("_step")).alias("mase"), "mape", "smape", "huber", "directional_accuracy", "medae", "bias",
        F.when(F.col("n_test") > 1, 1 - divide(F.col("_sse"), F.col("_sst"))).alias("r2"), (1 - divide(F.col("_sse"), F.col("_ref"))).alias("r2_oos"),
    )


def series_metrics(tasks: DataFrame, metrics: Sequence[str] = METRICS) -> DataFrame:
    """Mean, median and population deviation over folds."""
    each = [f(m).alias(f"{m}_{n}") for m in metrics for n, f in (("mean", F.avg), ("median", F.median), ("std", F.stddev_pop))]
    return tasks.groupBy("series_id", "horizon", "model").agg(F.count("*").alias("n_folds"), *each)


def model_summary(tasks: DataFrame) -> DataFrame:
    """Spread of errors and directional accuracy over all tasks of a model and horizon."""
    of = lambda m: [F.avg(m).alias(f"{m}_mean"), F.stddev_pop(m).alias(f"{m}_std"), F.var_pop(m).alias(f"{m}_var"), F.median(m).alias(f"{m}_median"), F.percentile(m, F.lit(0.25)).alias(f"{m}_q25"), F.percentile(m, F.lit(0.75)).alias(f"{m}_q75")]
    return tasks.groupBy("model", "horizon").agg(F.count("*").alias("n_tasks"), *of("rmse"), *of("directional_accuracy"))


def winners(means: DataFrame, metric: str, keys: Sequence[str], ascending: bool = True) -> DataFrame:
    """The best model within the keys; ties to the smaller name."""
    value = F.col(metric)
    order = Window.partitionBy(*keys).orderBy(value.asc_nulls_last() if ascending else value.desc_nulls_last(), "model")
    return means.withColumn("nth", F.row_number().over(order)).where("nth = 1").drop("nth")


def model_ranking(tasks: DataFrame, metric: str = "rmse", ascending: bool = True) -> DataFrame:
    """Models of each horizon by their mean."""
    means = tasks.groupBy("horizon", "model").agg(F.avg(metric).alias("mean"))
    value = F.round("mean", 12)
    order = Window.partitionBy("horizon").orderBy(value.asc_nulls_last() if ascending else value.desc_nulls_last(), "model")
    return means.withColumn("place", F.row_number().over(order))


def model_wins(series: DataFrame, metric: str = "rmse_mean", ascending: bool = True) -> DataFrame:
    """How many series each model is best for, with its share; models without a win have zero."""
    value = F.col(metric)
    order = Window.partitionBy("series_id", "horizon").orderBy(value.asc_nulls_last() if ascending else value.desc_nulls_last(), "model")
    every = series.withColumn("nth", F.row_number().over(order)).groupBy("horizon", "model").agg(F.count_if(F.col("nth") == 1).alias("wins"))
    return every.withColumn("share", F.col("wins") / F.sum("wins").over(Window.partitionBy("horizon")))


def coverage(tasks: DataFrame, expected: DataFrame) -> DataFrame:
    """Series that each model lacks of those expected, and missing values, by horizon."""
    n = expected.agg(F.count_distinct("series_id").alias("expected"))
    seen = tasks.groupBy("model", "horizon").agg(F.count_distinct("series_id").alias("observed"), F.min("fold").alias("fold_min"), F.max("fold").alias("fold_max"), F.count_if(F.col("rmse").isNull()).alias("n_missing"))
    return seen.join(F.broadcast(n)).withColumn("lacking", F.col("expected") - F.col("observed")).drop("expected")
