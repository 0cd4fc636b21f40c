"""What follows from the sums of a table's values and of their products: ridge regression on many targets, and principal scores.

One pass sums the products in each task; what meets are as many numbers as pairs of columns, however many rows there are. So
the tables are of any length and of some hundred columns.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


@dataclass
class Moments:
    """Rows, means and centred sums of products of the components of an array column."""

    n: int
    mean: np.ndarray
    products: np.ndarray


def moments(rows: DataFrame, vector: str = "vector", width: int | None = None) -> Moments:
    """Over rows whose vector has no null or non-finite component. The tasks' sums are about their own means, so large means cost no digits."""
    usable = rows.select(F.col(vector).cast("array<double>").alias("v")).where(F.col("v").isNotNull() & ~F.exists("v", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf"))))
    width = width if width is not None else usable.agg(F.max(F.size("v"))).first()[0] or 0

    def part(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        n, mean, products = 0, np.zeros(width), np.zeros((width, width))
        for pdf in batches:
            if not len(pdf):
                continue
            x = np.stack(pdf["v"].to_numpy())
            own = x.mean(axis=0)
            c = x - own
            step = own - mean
            products += c.T @ c + np.outer(step, step) * (n * len(x) / (n + len(x)))
            mean += step * len(x) / (n + len(x))
            n += len(x)
        if n:
            yield pd.DataFrame({"n": [n], "mean": [mean.tobytes()], "products": [products.tobytes()]})

    found = usable.where(F.size("v") == width).mapInPandas(part, "n long, mean binary, products binary")
    total = Moments(0, np.zeros(width), np.zeros((width, width)))
    for r in found.orderBy("n", "mean").toLocalIterator():  # one row a task
        mean, products = np.frombuffer(r["mean"]), np.frombuffer(r["products"]).reshape(width, width)
        step, n = mean - total.mean, total.n + r["n"]
        total.products = total.products + products + np.outer(step, step) * (total.n * r["n"] / n)
        total.mean, total.n = total.mean + step * r["n"] / n, n
    return total


# ---- ridge on many targets ---------------------------------------------------------------------------------------

INTERCEPT = "(intercept)"


@dataclass
class MultiRidge:
    """Coefficients by penalty, feature and target; intercepts by penalty and target."""

    features: list[str]
    targets: list[str]
    alphas: list[float]
    coefficients: np.ndarray
    intercepts: np.ndarray

    def table(self, spark) -> DataFrame:
        """(alpha, target, feature, coefficient), the intercept among them: as many rows as numbers."""
        rows = [(a, t, f, float(self.coefficients[i, k, j])) for i, a in enumerate(self.alphas) for j, t in enumerate(self.targets) for k, f in enumerate(self.features)]
        rows += [(a, t, INTERCEPT, float(self.intercepts[i, j])) for i, a in enumerate(self.alphas) for j, t in enumerate(self.targets)]
        return spark.createDataFrame(rows, "alpha double, target string, feature string, coefficient double")

    def predicted(self, alpha: float, target: str) -> Column:
        i, j = self.alphas.index(alpha), self.targets.index(target)
        total = F.lit(float(self.intercepts[i, j]))
        for k, f in enumerate(self.features):
            total = total + F.lit(float(self.coefficients[i, k, j])) * F.col(f).cast("double")
        return total


def fit_multi_ridge(rows: DataFrame, features: Sequence[str], targets: Sequence[str], alphas: Sequence[float] = (1.0,), standardise: bool = False) -> MultiRidge:
    """All targets and penalties from one aggregation; the intercept is not penalised.

    Minimises the summed squares plus alpha times the squared coefficients (of standardised features, if asked for). Rows with a missing
    feature or target take no part; a feature without variance gets coefficient zero; without rows everything is zero.
    """
    features, targets, alphas = list(features), list(targets), [float(a) for a in alphas]
    m = moments(rows.select(F.array(*(F.col(c).cast("double") for c in features + targets)).alias("vector")), width=len(features) + len(targets))
    p = len(features)
    xx, xy = m.products[:p, :p], m.products[:p, p:]
    scale = np.sqrt(np.diag(xx) / max(m.n, 1)) if standardise else np.ones(p)
    varies = np.diag(xx) > 1e-14 * np.maximum(1.0, m.n * m.mean[:p] ** 2)
    inverse = np.where(varies, 1 / np.where(scale > 0, scale, 1.0), 0.0)
    gram, cross = xx * np.outer(inverse, inverse), xy * inverse[:, None]
    out = np.zeros((len(alphas), p, len(targets)))
    for i, a in enumerate(alphas):
        out[i] = np.linalg.lstsq(gram + a * np.eye(p), cross, rcond=None)[0] * inverse[:, None] if m.n else 0.0
    return MultiRidge(features, targets, alphas, out, m.mean[p:][None, :] - np.einsum("k,ikj->ij", m.mean[:p], out))


def route_by_multi_ridge(rows: DataFrame, features: Sequence[str], targets: Sequence[str], alphas: Sequence[float] = (0.1, 1.0, 10.0), choose_on: str = "validation") -> DataFrame:
    """(series_id, horizon, chosen, achieved, oracle) of test rows: every model's error predicted by one fit on training rows, the smallest chosen.

    The penalty is the one whose choices cost least on rows with split ``choose_on``, or on the training rows where there are none; ties to the smaller.
    """
    fit = fit_multi_ridge(rows.where("split = 'train'"), features, targets, alphas, standardise=True)
    said = lambda a: F.array_min(F.array(*(F.struct(fit.predicted(a, t).alias("p"), F.lit(t).alias("model"), F.col(t).alias("cost")) for t in targets)))
    order = F.when(F.col("split") == choose_on, 0).otherwise(1)
    costs = rows.where(F.col("split").isin("train", choose_on)).groupBy(order.alias("o")).agg(*(F.avg(said(a)["cost"]).alias(f"a{i}") for i, a in enumerate(fit.alphas))).orderBy("o").first()
    found = [costs[f"a{i}"] if costs and costs[f"a{i}"] is not None else 0.0 for i in range(len(fit.alphas))]
    best = min(range(len(found)), key=lambda i: (round(found[i], 12), fit.alphas[i]))
    return rows.where("split = 'test'").withColumn("_s", said(fit.alphas[best])).select("series_id", "horizon", F.col("_s.model").alias("chosen"), F.col("_s.cost").alias("achieved"), F.least(*targets).alias("oracle"))


# ---- principal scores --------------------------------------------------------------------------------------------


@dataclass
class Axes:
    """Principal axes in rows, the mean, and each axis's share of the variance."""

    mean: np.ndarray
    axes: np.ndarray
    shares: np.ndarray

    def scores(self, vector: str = "vector") -> list[Column]:
        """A column for each axis; missing components stand at the mean."""
        centre = F.array(*(F.lit(float(v)) for v in self.mean))
        out = []
        for axis in self.axes:
            weights = F.array(*(F.lit(float(v)) for v in axis))
            known = F.zip_with(F.col(vector).cast("array<double>"), centre, lambda x, c: F.when(x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")), 0.0).otherwise(x - c))
            out.append(F.aggregate(F.zip_with(known, weights, lambda d, w: d * w), F.lit(0.0), lambda a, v: a + v))
        return out


def principal_axes(matrix: DataFrame, k: int = 2, vector: str = "vector") -> Axes:
    """The first axes of the table's covariance; of an axis and its opposite the one whose largest loading (the first of equal ones) is positive."""
    m = moments(matrix, vector)
    values, vectors = np.linalg.eigh(m.products / max(m.n, 1)) if len(m.mean) else (np.zeros(0), np.zeros((0, 0)))
    values, axes = np.maximum(values[::-1], 0.0), vectors[:, ::-1].T[:k]
    lead = [int(np.flatnonzero(np.abs(a) >= np.abs(a).max() - 1e-9)[0]) for a in axes]
    signs = np.array([1.0 if a[j] >= 0 else -1.0 for a, j in zip(axes, lead, strict=True)])
    return Axes(m.mean, axes * signs[:, None] if len(axes) else axes, values[:k] / values.sum() if len(values) and values.sum() > 0 else np.zeros(min(k, len(values))))


def principal_scores(matrix: DataFrame, k: int = 2, id_col: str = "point", vector: str = "vector") -> DataFrame:
    """(point, pc1, pc2, ..., share_1, ...): every row's place on the first axes, for a scatter of a clustering; null vectors have null places."""
    found = principal_axes(matrix, k, vector)
    scores = [F.when(F.col(vector).isNotNull(), s).alias(f"pc{i + 1}") for i, s in enumerate(found.scores(vector))]
    return matrix.select(id_col, *scores, *(F.lit(float(s)).alias(f"share_{i + 1}") for i, s in enumerate(found.shares)))
