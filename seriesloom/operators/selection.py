"""Which clustering configurations to keep: eligibility, best ones, comparison of two feature sets, checks of a shortlist.

Metrics are rows (config, feature_set, method, k, score, silhouette, max_share, min_size, n_small).
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

MAX_SHARE, MOST_SMALL, LEAST_SIZE = 0.9, 2, 5


def eligible_configs(metrics: DataFrame, max_share: float = MAX_SHARE, most_small: int = MOST_SMALL) -> DataFrame:
    """Ranked configurations of two clusters or more without one that holds nearly all or many small ones; all ranked, if none is."""
    ranked = metrics.where("score is not null")
    good = (F.col("k") >= 2) & (F.col("max_share") <= max_share) & (F.coalesce("n_small", F.lit(999)) <= most_small)
    some = F.max(good.cast("int")).over(Window.partitionBy(F.lit(1)))
    return ranked.withColumns({"_good": good, "_some": some}).where("_good or _some = 0").drop("_good", "_some")


def top_configs(metrics: DataFrame, top: int = 3, **limits) -> DataFrame:
    """The best ``top`` of each feature set and method, with their place."""
    own = Window.partitionBy("feature_set", "method").orderBy(F.desc(F.round("score", 9)), F.desc(F.round("silhouette", 9)), "config")
    return eligible_configs(metrics, **limits).withColumn("place", F.row_number().over(own)).where(F.col("place") <= top)


def select_configs(metrics: DataFrame, ks: Sequence[int] = range(2, 9), max_share: float = MAX_SHARE, least_size: int = LEAST_SIZE) -> DataFrame:
    """(selection_scope, k_bucket, config, ...): the best of all, and the best of each feature set and number of clusters."""
    fit = metrics.where(F.col("score").isNotNull() & (F.col("max_share") <= max_share) & (F.col("min_size") >= least_size))
    order = [F.desc(F.round("score", 9)), F.desc(F.round("silhouette", 9)), "config"]
    first = lambda df, *keys: df.withColumn("_nth", F.row_number().over(Window.partitionBy(*(keys or [F.lit(1)])).orderBy(*order))).where("_nth = 1").drop("_nth")
    best = first(fit).select(F.lit("overall").alias("selection_scope"), F.lit("overall").alias("k_bucket"), *metrics.columns)
    each = first(fit.where(F.col("k").isin(*ks)), "feature_set", "k").select(F.lit("best_k").alias("selection_scope"), F.col("k").cast("string").alias("k_bucket"), *metrics.columns)
    return best.unionByName(each)


def with_balance(selected: DataFrame, balance: DataFrame, stability: DataFrame) -> DataFrame:
    """Selected configurations with the spread of their clusters' shares and their mean agreement, where there are any."""
    spread = balance.groupBy("config").agg(F.count_distinct("cluster").alias("n_clusters"), F.min("share").alias("share_min"), F.max("share").alias("share_max"), F.stddev_samp("share").alias("share_std"))
    return selected.join(spread, "config", "left").join(stability.select("config", "ari_mean", "nmi_mean"), "config", "left")


def method_comparison(rows: DataFrame, base: str = "base", other: str = "with_chaos") -> DataFrame:
    """Both feature sets' configurations of each scope side by side, and what the second gains."""
    values = ["config", "k", "share_max", "share_min", "silhouette", "ari_mean", "nmi_mean"]
    pick = lambda s, c: F.max(F.when(F.col("feature_set") == s, F.col(c))).alias(f"{s}_{c}")
    wide = rows.groupBy("selection_scope", "k_bucket").agg(*(pick(s, c) for s in (base, other) for c in values))
    gain = lambda c: (F.col(f"{other}_{c}") - F.col(f"{base}_{c}")).alias(f"delta_{c}")
    return wide.select("*", gain("silhouette"), gain("share_max"), gain("ari_mean"))


def validate_shortlist(shortlist: DataFrame, selected: DataFrame, assignments: DataFrame) -> DataFrame:
    """(config, in_selected, in_assignments, available) of every shortlisted configuration."""
    here = lambda df, name: df.select("config").distinct().withColumn(name, F.lit(True))
    rows = shortlist.select("config").distinct().join(here(selected, "in_selected"), "config", "left").join(here(assignments, "in_assignments"), "config", "left")
    rows = rows.na.fill(False, ["in_selected", "in_assignments"])
    return rows.withColumn("available", F.col("in_assignments"))


def selected_assignments(selected: DataFrame, assignments: DataFrame) -> DataFrame:
    """The labels of the selected configurations, as they were computed."""
    return assignments.join(selected.select("config").distinct(), "config", "left_semi")


def heatmap(profiles: DataFrame) -> DataFrame:
    """(config, cluster, dim, z, column_order): profiles for a heatmap, columns by their largest distance from the mean."""
    most = profiles.groupBy("config", "dim").agg(F.round(F.max(F.abs("z")), 9).alias("_most"))
    order = most.withColumn("column_order", F.row_number().over(Window.partitionBy("config").orderBy(F.desc("_most"), "dim"))).drop("_most")
    return profiles.join(order, ["config", "dim"]).select("config", "cluster", "dim", "z", "column_order")
