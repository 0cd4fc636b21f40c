"""Learned routing: a classifier picks each series' model from its features; training and test series are apart."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.ml import Pipeline
from pyspark.ml.classification import LogisticRegression, RandomForestClassifier
from pyspark.ml.feature import StandardScaler, StringIndexer, VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.ml.regression import GBTRegressor, LinearRegression, RandomForestRegressor
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import kernels
from ..functions.columns import divide
from .routing import scoring_rows


def balanced_weights(rows: DataFrame, label: str) -> DataFrame:
    """Rows with ``weight``: all over classes times the class's own count."""
    counts = rows.groupBy(label).agg(F.count("*").alias("_n"))
    total = rows.agg(F.count("*").alias("_all"), F.count_distinct(label).alias("_k"))
    return rows.join(counts, label).join(F.broadcast(total)).withColumn("weight", F.col("_all") / (F.col("_k") * F.col("_n"))).drop("_n", "_all", "_k")


def classifier(kind: str, features: Sequence[str], label: str = "best", seed: int = 42) -> Pipeline:
    last = {
        "logistic": lambda: LogisticRegression(featuresCol="scaled", labelCol="_label", weightCol="weight", regParam=0.01, maxIter=100),
        "forest": lambda: RandomForestClassifier(featuresCol="scaled", labelCol="_label", weightCol="weight", numTrees=50, maxDepth=8, minInstancesPerNode=3, seed=seed),
    }[kind]()
    return Pipeline(stages=[StringIndexer(inputCol=label, outputCol="_label", stringOrderType="alphabetAsc", handleInvalid="skip"), VectorAssembler(inputCols=list(features), outputCol="_vector", handleInvalid="skip"), StandardScaler(inputCol="_vector", outputCol="scaled", withMean=True, withStd=True), last])


def route(rows: DataFrame, features: Sequence[str], kind: str = "logistic", label: str = "best") -> DataFrame:
    """(series_id, horizon, truth, predicted, confidence) of test rows, from a fit on training rows (column ``split``)."""
    train = balanced_weights(rows.where("split = 'train'"), label)
    model = classifier(kind, features, label).fit(train)
    names = F.array(*(F.lit(n) for n in model.stages[0].labels))
    said = model.transform(rows.where("split = 'test'").withColumn("weight", F.lit(1.0)))
    return said.select("series_id", "horizon", F.col(label).alias("truth"), F.element_at(names, F.col("prediction").cast("int") + 1).alias("predicted"), F.array_max(vector_to_array("probability")).alias("confidence"))


def route_by_regression(rows: DataFrame, features: Sequence[str], targets: Sequence[str], seed: int = 42) -> DataFrame:
    """Each model's error predicted from features; the smallest prediction is chosen. Rows have one error column for each model."""
    test = VectorAssembler(inputCols=list(features), outputCol="_vector", handleInvalid="skip")
    train, out = test.transform(rows.where("split = 'train'")), test.transform(rows.where("split = 'test'"))
    for t in targets:
        fit = RandomForestRegressor(featuresCol="_vector", labelCol=t, predictionCol=f"_p_{t}", numTrees=30, maxDepth=6, seed=seed).fit(train)
        out = fit.transform(out)
    said = F.array(*(F.struct(F.col(f"_p_{t}").alias("p"), F.lit(t).alias("model"), F.col(t).alias("cost")) for t in targets))
    best = F.array_min(said)
    return out.select("series_id", "horizon", best["model"].alias("chosen"), best["cost"].alias("achieved"), F.least(*targets).alias("oracle"))


def regret(routed: DataFrame) -> DataFrame:
    """Mean cost of the choices against the best possible, by horizon."""
    return routed.groupBy("horizon").agg(F.count("*").alias("n"), F.avg("achieved").alias("achieved"), F.avg("oracle").alias("oracle"), divide(F.sum(F.when(F.col("achieved") <= F.col("oracle"), 1).otherwise(0)), F.count("*")).alias("hit_rate"))


SCORERS = {
    "forest": lambda seed: RandomForestRegressor(featuresCol="_vector", labelCol="cost", numTrees=30, maxDepth=6, seed=seed),
    "boosted": lambda seed: GBTRegressor(featuresCol="_vector", labelCol="cost", maxIter=30, maxDepth=4, seed=seed),
    "ridge": lambda seed: LinearRegression(featuresCol="_vector", labelCol="cost", regParam=1e-3, elasticNetParam=0.0),
}


def _scored(rows: DataFrame, features: Sequence[str], models: Sequence[str], kind: str, seed: int):
    names = [*features, *(f"model__{m}" for m in models)]
    long = VectorAssembler(inputCols=names, outputCol="_vector", handleInvalid="skip").transform(scoring_rows(rows, features, models))
    return SCORERS[kind](seed).fit(long.where("split = 'train'")), long, names


def route_by_scoring(rows: DataFrame, features: Sequence[str], models: Sequence[str], kind: str = "boosted", seed: int = 42) -> DataFrame:
    """One regression over features and model together; the model of the smallest predicted cost is chosen for each test row."""
    fit, long, _ = _scored(rows, features, models, kind, seed)
    said = fit.transform(long.where("split = 'test'"))
    best = F.min_by(F.struct("model", "cost"), F.struct("prediction", "model"))
    return said.groupBy("series_id", "horizon").agg(best.alias("b"), F.min("cost").alias("oracle")).select("series_id", "horizon", F.col("b.model").alias("chosen"), F.col("b.cost").alias("achieved"), "oracle")


def feature_importances(rows: DataFrame, features: Sequence[str], models: Sequence[str], kind: str = "forest", seed: int = 42) -> DataFrame:
    """(feature, importance) of the scoring model's trees; as many rows as features."""
    fit, _, names = _scored(rows, features, models, kind, seed)
    return rows.sparkSession.createDataFrame(sorted(zip(names, map(float, fit.featureImportances.toArray()), strict=True)), "feature string, importance double")


def top_two(rows: DataFrame, features: Sequence[str], kind: str = "logistic", label: str = "best") -> DataFrame:
    """(series_id, horizon, truth, first, second, confidence, in_top_two): the two most probable classes of each test row."""
    train = balanced_weights(rows.where("split = 'train'"), label)
    model = classifier(kind, features, label).fit(train)
    said = model.transform(rows.where("split = 'test'").withColumn("weight", F.lit(1.0)))
    names = F.array(*(F.lit(n) for n in model.stages[0].labels))
    ranked = F.array_sort(F.arrays_zip((F.transform(vector_to_array("probability"), lambda p: -p)).alias("p"), names.alias("name")))
    out = said.select("series_id", "horizon", F.col(label).alias("truth"), ranked.alias("_r"))
    first, second = F.col("_r")[0], F.try_element_at("_r", F.lit(2))
    return out.select("series_id", "horizon", "truth", first["name"].alias("first"), second["name"].alias("second"), (-first["p"]).alias("confidence"), ((F.col("truth") == first["name"]) | F.coalesce(F.col("truth") == second["name"], F.lit(False))).alias("in_top_two"))


def neighbour_information(features: DataFrame, labels: DataFrame, neighbours: int = 3) -> DataFrame:
    """(feature, information): mutual information of each feature with the series' class from distances to the nearest rows of the class.

    features: long (series_id, feature, value) of training series only; a feature is one task, with a row for each series.
    """

    def one(pdf: pd.DataFrame) -> pd.DataFrame:
        x, y = pdf["value"].to_numpy(float), pdf["label"].to_numpy()
        x = x / max(x.std(), 1e-12)
        n, terms, sizes = len(x), [], []
        for c in np.unique(y):
            own = np.sort(x[y == c])
            m = len(own)
            if m < 2:
                continue
            k = min(neighbours, m - 1)
            at = np.arange(m)
            # the k nearest of a sorted row lie within k places of it
            near = np.stack([np.abs(own - own[np.clip(at + d, 0, m - 1)]) + np.where((at + d < 0) | (at + d >= m), np.inf, 0) for d in range(-k, k + 1) if d])
            radius = np.sort(near, axis=0)[k - 1] * (1 - 1e-9)  # less than the distance itself, whatever the rounding
            every = np.sort(x)
            inside = np.searchsorted(every, own + radius, side="right") - np.searchsorted(every, own - radius, side="left")
            terms.append(sum(kernels.digamma(k) - kernels.digamma(max(int(i), 1)) for i in inside))
            sizes.append(m)
        used = sum(sizes)
        value = max(0.0, kernels.digamma(used) + sum(terms) / used - sum(m * kernels.digamma(m) for m in sizes) / used) if used else None
        return pd.DataFrame({"feature": [pdf["feature"].iloc[0]], "information": [value], "n": [n]})

    rows = features.where("value is not null").join(labels.select("series_id", "label"), "series_id")
    return rows.groupBy("feature").applyInPandas(one, "feature string, information double, n long")


def select_features(information: DataFrame, top: int = 30, least: int = 5) -> DataFrame:
    """The most informative features, at least ``least`` of them; ties to the smaller name."""
    order = Window.partitionBy(F.lit(1)).orderBy(F.desc_nulls_last("information"), "feature")
    return information.withColumn("place", F.row_number().over(order)).where(F.col("place") <= max(top, least))
