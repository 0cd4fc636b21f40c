"""Queries over clusterings that are really fitted: mixtures and hierarchical ones on two sets of features, chosen and labelled from their stored models.

The feature sets are the first half of each vector (base) and all of it (with_chaos).
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.columns import rounded
from ..operators import cluster_store, clusters, selection, series_kernels
from ..settings import chosen
from ..sources.panels import table
from ..sources.shared import stored
from .cluster_queries import components, ks

QUERIES: dict = {}
SQL: dict[str, str] = {}


def query(name: str):
    def add(f):
        QUERIES[name] = f
        return f

    return add


def matrices(spark, sf_dir) -> dict[str, DataFrame]:
    rows = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("point"), F.col("embedding").alias("vector")).where("vector is not null")
    return {"base": rows.withColumn("vector", F.slice("vector", 1, 32)), "with_chaos": rows}


def grid() -> list[tuple]:
    return series_kernels.grid_configs(("robust",), (4,), ks(), ("gmm", "ward"))


def fits(spark, sf_dir) -> tuple[DataFrame, DataFrame]:
    """The stored models of both sets, and rows (feature_set, point, vector, clusters) with the labels under all of a set's models, by their names."""
    models, labels = [], []
    for name, matrix in matrices(spark, sf_dir).items():
        store = stored(cluster_store.fit_store(matrix, grid(), chosen("seed", 42)), "models").withColumn("feature_set", F.lit(name))
        models.append(store.withColumn("config", F.concat(F.lit(f"{name}_"), "config")))
        labels.append(cluster_store.with_labels(matrix, store).withColumn("feature_set", F.lit(name)))
    both = lambda parts: reduce(lambda a, b: a.unionByName(b), parts)
    return both(models), stored(both(labels), "labels")


def _widths(models: DataFrame) -> dict[str, list[tuple[str, int]]]:
    """Names and numbers of clusters of each set's fitted configurations, in the order of the labels."""
    found: dict[str, list] = {}
    for r in models.where("status = 'success'").select("feature_set", "config", "k").orderBy("feature_set", "config").collect():
        found.setdefault(r["feature_set"], []).append((r["config"], r["k"]))
    return found


def labelled(models: DataFrame, labels: DataFrame) -> DataFrame:
    """(config, point, cluster, vector) of every row under every model."""
    each = labels.select("feature_set", "point", "vector", F.posexplode("clusters").alias("at", "cluster"))
    names = [(s, at, config) for s, own in _widths(models).items() for at, (config, _) in enumerate(own)]
    named = labels.sparkSession.createDataFrame(names, "feature_set string, at int, config string")
    return each.join(F.broadcast(named), ["feature_set", "at"]).select("config", "point", "cluster", "vector")


def metrics_of(models: DataFrame, labels: DataFrame) -> DataFrame:
    """Measures and ranks of each configuration, with the method and the set that it really has."""
    rows, first, spaces = labelled(models, labels), {}, _widths(models)
    points = components(rows)
    least = rows.groupBy("config", "cluster").count().groupBy("config").agg(F.min("count").alias("min_size"))
    begin = F.array().cast("array<int>")
    for name, own in spaces.items():
        ends = [sum(k for _, k in own[:at]) for at in range(len(own))]
        first |= {config: (name, at) for (config, _), at in zip(own, ends, strict=True)}
        begin = F.when(F.col("feature_set") == name, F.array(*map(F.lit, ends))).otherwise(begin)
    sizes = rows.groupBy("config", "cluster").count().collect()  # as many as clusters
    known = [(first[r["config"]][0], r["config"], first[r["config"]][1] + r["cluster"], r["count"]) for r in sizes]
    coded = labels.select(F.col("feature_set").alias("space"), "point", "vector", F.zip_with("clusters", begin, lambda c, b: c + b).alias("codes"))
    parts = [clusters.silhouette_of(coded, known), clusters.calinski_harabasz(points), clusters.davies_bouldin(points), clusters.size_facts(rows), least]
    ranked = clusters.ranking(reduce(lambda a, b: a.join(b, "config"), parts)).drop("k")
    return stored(ranked.join(models.select("config", "feature_set", "method", "k"), "config").select("config", "feature_set", "method", "k", "score", "silhouette", "max_share", "min_size", "n_small"), "metrics")


def _selected(metrics: DataFrame) -> DataFrame:
    return selection.select_configs(metrics, ks(), chosen("max_share", selection.MAX_SHARE), chosen("least_size", selection.LEAST_SIZE))


@query("fitted_config_metrics")
def fitted_config_metrics(spark, sf_dir):
    return metrics_of(*fits(spark, sf_dir))


@query("fitted_top_configs")
def fitted_top_configs(spark, sf_dir):
    return selection.top_configs(metrics_of(*fits(spark, sf_dir)))


@query("fitted_selected_configs")
def fitted_selected_configs(spark, sf_dir):
    return _selected(metrics_of(*fits(spark, sf_dir)))


@query("fitted_selected_assignments")
def fitted_selected_assignments(spark, sf_dir):
    """Every vector's label and confidence under each selected configuration, from its stored model."""
    models, labels = fits(spark, sf_dir)
    wanted = _selected(metrics_of(models, labels)).select("config").distinct()
    out = None
    for name, matrix in matrices(spark, sf_dir).items():
        part = cluster_store.label_all(matrix, models.where(F.col("feature_set") == name).join(wanted, "config", "left_semi"))
        out = part if out is None else out.unionByName(part)
    return out


@query("fitted_method_comparison")
def fitted_method_comparison(spark, sf_dir):
    """The best of each set against one another; stability is the agreement with the other method of the same set and number of clusters."""
    models, labels = fits(spark, sf_dir)
    pair = models.select("config", "feature_set", "k", "method")
    other = pair.select(F.col("config").alias("other"), "feature_set", "k", F.col("method").alias("_m"))
    met = pair.join(other, ["feature_set", "k"]).where("method <> _m").select("config", "other")
    rows = labelled(models, labels)
    two = rows.select("config", "point", F.col("cluster").alias("a")).join(met, "config").join(rows.select(F.col("config").alias("other"), "point", F.col("cluster").alias("b")), ["other", "point"])
    agreement = clusters.agreement(two.select("config", "a", "b")).withColumnsRenamed({"ari": "ari_mean", "nmi": "nmi_mean"})
    return selection.method_comparison(selection.with_balance(_selected(metrics_of(models, labels)), clusters.balance(rows), agreement))


@query("condensed_ward_clusters")
def condensed_ward_clusters(spark, sf_dir):
    """Hierarchical clusters of all vectors, however many there are."""
    return cluster_store.condensed_ward(matrices(spark, sf_dir)["with_chaos"], ks())


@query("condensed_ward_balance")
def condensed_ward_balance(spark, sf_dir):
    return clusters.balance(cluster_store.condensed_ward(matrices(spark, sf_dir)["with_chaos"], ks())).withColumn("share", rounded(F.col("share")))
