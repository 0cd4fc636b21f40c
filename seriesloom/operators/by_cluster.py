"""Forecast quality by cluster: performance, comparison with a baseline, best models, what routing by cluster gains."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.columns import average_rank, divide

KEY = ["config", "cluster", "horizon"]


def keep_last(mapping: DataFrame, keys: list[str], ordinal: str) -> DataFrame:
    nth = F.row_number().over(Window.partitionBy(*keys).orderBy(F.desc(ordinal)))
    return mapping.withColumn("_nth", nth).where("_nth = 1").drop("_nth")


def performance(series: DataFrame, assignments: DataFrame, metrics=("mae", "rmse", "mase", "directional_accuracy")) -> DataFrame:
    """Mean and median over a cluster's series of their mean measures."""
    rows = series.join(assignments, "series_id")
    each = [f(f"{m}_mean").alias(f"{m}_{n}") for m in metrics for n, f in (("mean", F.avg), ("median", F.median))]
    return rows.groupBy(*KEY, "model").agg(F.count_distinct("series_id").alias("n_series"), *each)


def relative_to_baseline(perf: DataFrame, baseline: str = "naive_zero", metric: str = "rmse_mean") -> DataFrame:
    """Difference and ratio to the baseline model of the same cluster; null where it is absent."""
    base = F.max(F.when(F.col("model") == baseline, F.col(metric))).over(Window.partitionBy(*KEY))
    rows = perf.select(*KEY, "model", metric, base.alias("baseline"))
    return rows.withColumns({"difference": F.col(metric) - F.col("baseline"), "ratio": divide(F.col(metric), F.col("baseline"))})


def best_by_cluster(perf: DataFrame) -> DataFrame:
    """Best model of each cluster by each measure; ties to the smaller name."""
    low = [F.min_by("model", F.struct(F.round(f"{m}_mean", 12), "model")).alias(f"best_{m}") for m in ("mae", "rmse", "mase")]
    high = F.min_by("model", F.struct(-F.round("directional_accuracy_mean", 12), "model")).alias("best_directional_accuracy")
    return perf.groupBy(*KEY).agg(*low, high)


def utility(perf: DataFrame, metric: str = "rmse_mean", low_is_better: bool = True) -> DataFrame:
    """Gain of the best model of each cluster over the one best model, weighted by series; diversity and rank spread."""
    sign = 1.0 if low_is_better else -1.0
    own, by_model = Window.partitionBy("config", "horizon"), Window.partitionBy("config", "horizon", "model")
    n = F.col("n_series")
    rows = perf.where(F.col(metric).isNotNull()).withColumn("cost", F.round(sign * F.col(metric), 12))
    rows = rows.withColumn("whole", divide(F.sum(F.col("cost") * n).over(by_model), F.sum(n).over(by_model).cast("double")))
    rows = rows.withColumns({
        "best": F.min(F.struct(F.round("whole", 12).alias("at"), F.col("model"), F.col("whole"))).over(own),
        "nth": F.row_number().over(Window.partitionBy(*KEY).orderBy("cost", "model")),
        "rank": average_rank(F.col("cost"), *KEY),
    })
    rows = rows.withColumns({"spread": F.var_pop("rank").over(by_model), "once": F.row_number().over(by_model.orderBy("cluster"))})
    first = F.col("nth") == 1
    out = rows.groupBy("config", "horizon").agg(
        F.first("best").alias("best"), divide(F.sum(F.when(first, F.col("cost") * n)), F.sum(F.when(first, n)).cast("double")).alias("cluster_cost"),
        F.count_distinct(F.when(first, F.col("model"))).alias("n_best_models"), F.avg(F.when(F.col("once") == 1, F.col("spread"))).alias("rank_variance"),
    )
    gain = F.col("best.whole") - F.col("cluster_cost")
    return out.select("config", "horizon", F.col("best.model").alias("global_best"), (sign * F.col("best.whole")).alias("global_score"), (sign * F.col("cluster_cost")).alias("cluster_score"), gain.alias("regret_improvement"), "n_best_models", "rank_variance")


def kruskal_h(series: DataFrame, assignments: DataFrame, metric: str = "rmse_mean") -> DataFrame:
    """Kruskal-Wallis statistic, with correction for ties, of a measure over the clusters."""
    key = ["config", "model", "horizon"]
    rows = series.join(assignments, "series_id").where(F.col(metric).isNotNull()).withColumn("v", F.round(metric, 12))
    rows = rows.withColumns({"rank": average_rank(F.col("v"), *key), "ties": F.count("*").over(Window.partitionBy(*key, "v"))})
    # each of t tied rows brings (t**3 - t) / t
    rows = rows.withColumn("tied", F.col("ties") * F.col("ties") - 1.0)
    groups = rows.groupBy(*key, "cluster").agg(F.sum("rank").alias("r"), F.count("*").alias("k"), F.sum("tied").alias("tied"))
    total = groups.groupBy(*key).agg(F.sum(F.col("r") * F.col("r") / F.col("k")).alias("s"), F.sum("k").cast("double").alias("n"), F.count("*").alias("n_clusters"), F.sum("tied").alias("tied"))
    n = F.col("n")
    h = divide(12.0 / (n * (n + 1)) * F.col("s") - 3 * (n + 1), 1 - F.col("tied") / (n * n * n - n))
    return total.where("n_clusters > 1").select(*key, "n_clusters", h.alias("h"))


def missing_baseline(perf: DataFrame, baseline: str = "naive_zero") -> DataFrame:
    """Clusters and horizons that the baseline model has no measure for."""
    base = F.max(F.when(F.col("model") == baseline, F.col("rmse_mean"))).over(Window.partitionBy(*KEY))
    return perf.select(*KEY, base.alias("_base")).where("_base is null").select(*KEY).distinct()


def kruskal(series: DataFrame, assignments: DataFrame, metrics=("mae", "rmse", "mase", "directional_accuracy")) -> DataFrame:
    """(config, model, horizon, metric, n_clusters, h, p, note) for every measure; fewer than two clusters give a note."""
    from .series_kernels import chi2_tail

    out = None
    for m in metrics:
        one = kruskal_h(series, assignments, f"{m}_mean").withColumn("metric", F.lit(m))
        out = one if out is None else out.unionByName(one)
    out = out.withColumn("_freedom", F.col("n_clusters") - 1).withColumn("p", chi2_tail("h", "_freedom")).drop("_freedom").withColumn("note", F.lit(""))
    few = series.join(assignments, "series_id").groupBy("config", "model", "horizon").agg(F.count_distinct("cluster").alias("n_clusters")).where("n_clusters < 2")
    names = F.explode(F.array(*(F.lit(m) for m in metrics))).alias("metric")
    none = F.lit(None).cast("double")
    return out.unionByName(few.select("config", "model", "horizon", "n_clusters", names, none.alias("h"), none.alias("p"), F.lit("fewer than two clusters").alias("note")))
