"""Fitted clusterings as a table, labels of any table under them, and hierarchical clustering of condensed rows.

A fit is made on all rows of a table; what it learned (medians, scaler, axes, mixture or centres) is one row of a table.
Labels come from such a row alone, in one pass over the rows, so a table of any length can be labelled, and a chosen
configuration need not be fitted again.

:func:`condensed_ward` has no such matrix. Tasks condense their rows to clustering features (number, mean, sum of squares), and these
meet in ever fewer tasks until few enough are left for Ward's method, which weighs them by their numbers. A
row gets the label of its nearest feature. Where there are no more distinct rows than features, each is a feature of its own and
the result is that of Ward's method on all rows.
"""

from __future__ import annotations

import json
from collections.abc import Iterator, Sequence
from statistics import NormalDist

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import kernels
from ..sources.shared import stored
from . import series_kernels

STORE_SCHEMA = "config string, method string, scaler string, d int, k int, model string, status string"
LABEL_SCHEMA = "config string, point long, cluster int, confidence double, entropy double"
#: How many times ``per_task`` features a task of :func:`clustering_features` condenses.
TASK_LOADS = 32


class FittedScaler:
    """A scaler with what it learned, so that other rows can be scaled alike."""

    def __init__(self, kind: str, given: dict) -> None:
        self.kind, self.given = kind, given

    @classmethod
    def fit(cls, kind: str, x: np.ndarray) -> FittedScaler:
        given: dict = {"fill": np.nan_to_num(np.nanmedian(x, axis=0)).tolist() if len(x) else [0.0] * x.shape[1]}
        if kind == "robust":
            low, mid, high = np.quantile(x, [0.25, 0.5, 0.75], axis=0)
            given |= {"centre": mid.tolist(), "spread": np.where(high > low, high - low, 1.0).tolist()}
        elif kind == "quantile":
            given["knots"], given["scores"] = [], []
            for c in range(x.shape[1]):
                values, times = np.unique(x[:, c], return_counts=True)
                rank = np.cumsum(times) - (times - 1) / 2
                given["knots"].append(values.tolist())
                given["scores"].append([NormalDist().inv_cdf((r - 0.5) / len(x)) for r in rank])
        return cls(kind, given)

    def apply(self, x: np.ndarray) -> np.ndarray:
        x = np.where(np.isfinite(x), x, np.array(self.given["fill"]))
        if self.kind == "robust":
            return (x - np.array(self.given["centre"])) / np.array(self.given["spread"])
        if self.kind == "quantile":
            return np.column_stack([np.interp(x[:, c], k, s) for c, (k, s) in enumerate(zip(self.given["knots"], self.given["scores"], strict=True))])
        return x


class FittedClustering:
    """Scaler, axes, and a mixture's parameters or the centres of hierarchical clusters."""

    def __init__(self, scaler: FittedScaler, mean: np.ndarray | None, axes: np.ndarray | None, mixture: kernels.Mixture | None, centres: np.ndarray | None) -> None:
        self.scaler, self.mean, self.axes, self.mixture, self.centres = scaler, mean, axes, mixture, centres

    @classmethod
    def fit(cls, x: np.ndarray, scaler: str, d: int, ks: Sequence[int], method: str, seed: int) -> Iterator[FittedClustering]:
        """The fit of each number of clusters; one tree serves all of them."""
        fitted = FittedScaler.fit(scaler, x)
        z, mean, axes = fitted.apply(x), None, None
        if d:
            mean = z.mean(axis=0)
            axes = kernels.axes(z - mean, min(d, *z.shape))
            z = (z - mean) @ axes.T
        merges = kernels.ward_merges(z) if method == "ward" else []
        for k in ks:
            if method == "ward":
                labels = kernels.cut(merges, len(z), k)
                yield cls(fitted, mean, axes, None, np.stack([z[labels == c].mean(axis=0) for c in range(labels.max() + 1)]))
            else:
                yield cls(fitted, mean, axes, kernels.fit_mixture(z, k, seed=seed)[0], None)

    def label(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Clusters, confidences and entropies; under hierarchical clusters the nearest centre, with confidence one."""
        z = self.scaler.apply(x)
        z = z if self.axes is None else (z - self.mean) @ self.axes.T
        if self.mixture is None:
            near = ((z[:, None] - self.centres[None]) ** 2).sum(axis=2).argmin(axis=1)
            return near, np.ones(len(z)), np.zeros(len(z))
        return kernels.said_by(self.mixture.chances(z)[0])

    def dump(self) -> str:
        plain = lambda a: None if a is None else a.tolist()
        mixture = None if self.mixture is None else {"log_weights": plain(self.mixture.log_weights), "means": plain(self.mixture.means), "factors": plain(self.mixture.factors)}
        return json.dumps({"scaler": self.scaler.kind, "given": self.scaler.given, "mean": plain(self.mean), "axes": plain(self.axes), "mixture": mixture, "centres": plain(self.centres)})

    @classmethod
    def read(cls, text: str) -> FittedClustering:
        r = json.loads(text)
        whole = lambda a: None if a is None else np.array(a, float)
        mixture = None if r["mixture"] is None else kernels.Mixture(*(np.array(r["mixture"][f], float) for f in ("log_weights", "means", "factors")))
        return cls(FittedScaler(r["scaler"], r["given"]), whole(r["mean"]), whole(r["axes"]), mixture, whole(r["centres"]))


def fit_store(matrix: DataFrame, grid: Sequence[tuple], seed: int = 42, fit_rows: int | None = None) -> DataFrame:
    """One row (config, ..., model, status) for each configuration of ``series_kernels.grid_configs``; a mixture, or a tree with all its numbers of clusters, is a task.

    The fit is the grid's own, of all rows in the order of their points, which every task gets (``series_kernels.MATRIX_BYTES`` bounds them). Only a caller
    who names ``fit_rows`` has it made on so many, those with the smallest hashes. A configuration that fails has its error in ``status``.
    """
    rows = matrix.where("vector is not null")
    x = series_kernels.local_matrix(rows if fit_rows is None else rows.orderBy(F.xxhash64("point"), "point").limit(fit_rows))[1]
    shared = matrix.sparkSession.sparkContext.broadcast(x)
    units: dict[tuple, list] = {}
    for c in grid:
        config, scaler, d, k, method = c
        units.setdefault((scaler, d, method, None if method == "ward" else k), []).append((config, k))
    each = sorted(((s, d, m, [c for c, _ in own], [k for _, k in own]) for (s, d, m, _), own in units.items()), key=lambda u: (u[2] != "ward", -max(u[4])))

    def fit(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            out = []
            for u in pdf.itertuples(index=False):
                found: dict[str, tuple] = {c: (None, "failed: ValueError") for c in u.configs}  # as many clusters as rows
                some = [(c, k) for c, k in zip(u.configs, u.ks, strict=True) if len(shared.value) > k]
                try:
                    for (c, _), model in zip(some, FittedClustering.fit(shared.value.astype(float), u.scaler, u.d, [k for _, k in some], u.method, seed) if some else (), strict=True):
                        found[c] = model.dump(), "success"
                except Exception as e:  # noqa: BLE001  one configuration's error is its row
                    found |= {c: (None, f"failed: {type(e).__name__}") for c, _ in some if found[c][0] is None}
                out += [(c, u.method, u.scaler, u.d, k, *found[c]) for c, k in zip(u.configs, u.ks, strict=True)]
            yield pd.DataFrame(out, columns=["config", "method", "scaler", "d", "k", "model", "status"])

    spark = matrix.sparkSession
    configs = spark.createDataFrame(spark.sparkContext.parallelize(each, max(1, len(each))), "scaler string, d int, method string, configs array<string>, ks array<int>")
    return configs.mapInPandas(fit, STORE_SCHEMA)


def label_all(matrix: DataFrame, store: DataFrame) -> DataFrame:
    """Labels of every row of a table of any size under every stored configuration. The models are as many as someone has chosen; rows stay where they are."""
    models = store.where("status = 'success'").select("config", "model").orderBy("config").collect()
    shared = matrix.sparkSession.sparkContext.broadcast([(r["config"], r["model"]) for r in models])

    def label(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        fitted = [(c, FittedClustering.read(m)) for c, m in shared.value]
        for pdf in batches:
            if not len(pdf):
                continue
            x = np.array([[np.nan if v is None else v for v in row] for row in pdf["vector"]], float)
            for config, model in fitted:
                own, sure, entropy = model.label(x)
                yield pd.DataFrame({"config": config, "point": pdf["point"], "cluster": own, "confidence": sure, "entropy": entropy})

    rows = matrix.select("point", F.col("vector").cast("array<double>").alias("vector")).where("vector is not null")
    return rows.mapInPandas(label, LABEL_SCHEMA)


def with_labels(matrix: DataFrame, store: DataFrame) -> DataFrame:
    """The rows with ``clusters``, their labels under every stored configuration in the order of their names: a vector is there once for all of them."""
    models = [r["model"] for r in store.where("status = 'success'").select("config", "model").orderBy("config").collect()]
    shared = matrix.sparkSession.sparkContext.broadcast(models)

    @F.pandas_udf("array<int>")
    def label(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        fitted = [FittedClustering.read(m) for m in shared.value]
        for vectors in batches:
            x = np.array([[np.nan if v is None else v for v in row] for row in vectors], float)
            own = np.array([model.label(x)[0] for model in fitted], np.int32).reshape(len(fitted), len(vectors))
            yield pd.Series(list(own.T), dtype=object)

    return matrix.where("vector is not null").withColumn("clusters", label(F.col("vector").cast("array<double>")))


# ---- condensed hierarchical clustering ---------------------------------------------------------------------------


def condense(n: np.ndarray, mean: np.ndarray, square: np.ndarray, most: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Clustering features merged until there are at most so many: of pairs that are each other's nearest, those whose union costs least go first.

    n: points; mean: their means; square: their squared distances from the mean, summed.
    """
    while len(n) > most:
        s = (mean * mean).sum(axis=1)
        d = np.maximum(s[:, None] + s[None, :] - 2 * (mean @ mean.T), 0) * (n[:, None] * n[None, :] / (n[:, None] + n[None, :]))
        np.fill_diagonal(d, np.inf)
        near = d.argmin(axis=1)
        first = np.flatnonzero((near[near] == np.arange(len(n))) & (np.arange(len(n)) < near))
        cost = d[first, near[first]]
        if not len(first):  # only where ties go in a circle
            first, cost = np.array([int(d.min(axis=1).argmin())]), np.zeros(1)
        first = first[np.argsort(cost, kind="stable")][: len(n) - most]
        second = near[first]
        total = n[first] + n[second]
        step = mean[second] - mean[first]
        square[first] += square[second] + (step * step).sum(axis=1) * n[first] * n[second] / total
        mean[first] += step * (n[second] / total)[:, None]
        n[first] = total
        stay = np.ones(len(n), bool)
        stay[second] = False
        n, mean, square = n[stay], mean[stay], square[stay]
    return n, mean, square


FEATURE_SCHEMA = "n double, mean array<double>, square double"


def clustering_features(matrix: DataFrame, most: int = 4096, per_task: int = 1024) -> DataFrame:
    """(n, mean, square): at most ``most`` clustering features of all rows; a task holds at most twice ``per_task`` at a time.

    Equal rows are one feature. While more are left, tasks condense TASK_LOADS times ``per_task`` of them to ``per_task``; the last one gets down to ``most``.
    """
    per_task = min(per_task, most)
    rows = matrix.select(F.col("vector").cast("array<double>").alias("mean")).where("vector is not null and not exists(vector, x -> x is null or isnan(x))")
    # equal rows are counted before they move, however many there are
    left = rows.groupBy("mean").agg(F.count("*").cast("double").alias("n")).select("n", "mean", F.lit(0.0).alias("square"))
    left = stored(left, "features")

    def reducer(size: int):
        def reduce(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            held: tuple[np.ndarray, np.ndarray, np.ndarray] | None = None
            for pdf in batches:
                for at in range(0, len(pdf), size):
                    some = pdf.iloc[at : at + size]
                    new = some["n"].to_numpy(float).copy(), np.stack(some["mean"].to_numpy()).astype(float), some["square"].to_numpy(float).copy()
                    held = new if held is None else tuple(np.concatenate([a, b]) for a, b in zip(held, new, strict=True))
                    held = condense(*held, size)
            if held is not None:
                yield pd.DataFrame({"n": held[0], "mean": list(held[1]), "square": held[2]})

        return reduce

    count = left.count()
    while count > most:
        tasks = count // (TASK_LOADS * per_task)
        if tasks > 1:  # rows that are close come to one task, in a fixed order
            dealt, size = left.repartitionByRange(tasks, "mean").sortWithinPartitions("mean"), per_task
        else:
            dealt, size = left.coalesce(1).sortWithinPartitions("mean"), most
        left, before = stored(dealt.mapInPandas(reducer(size), FEATURE_SCHEMA), "features"), count
        count = left.count()
        if count >= before:
            raise ValueError("features don't get fewer")
    return left


def condensed_ward(matrix: DataFrame, ks: Sequence[int] = range(2, 9), most: int = 4096, per_task: int = 1024) -> DataFrame:
    """(config, point, cluster) of every row for each number of clusters: Ward's method over at most ``most`` weighted clustering features.

    Rows that are null or have a missing component take no part. Clusters are numbered by the smallest of their features.
    """
    spark = matrix.sparkSession
    found = sorted(((tuple(r["mean"]), r["n"]) for r in clustering_features(matrix, most, per_task).collect()))  # at most `most` rows
    mean = np.array([m for m, _ in found], float) if found else np.zeros((0, 0))
    sizes = np.array([n for _, n in found], float)
    labels = {k: kernels.ward(mean, k, sizes) if len(mean) > 1 else np.zeros(len(mean), int) for k in ks}  # one feature or none has no merges
    shared = spark.sparkContext.broadcast((mean, labels))

    def assign(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        centres, by_k = shared.value
        square = (centres * centres).sum(axis=1)
        for pdf in batches:
            for at in range(0, len(pdf), 1024):
                some = pdf.iloc[at : at + 1024]
                x = np.stack(some["vector"].to_numpy()).astype(float)
                # the nearest by the expanded square, then exactly among those that rounding can't tell apart
                d = square[None, :] - 2 * (x @ centres.T)
                close = d <= d.min(axis=1, keepdims=True) + 1e-9 * (1 + np.abs(d).max(axis=1, keepdims=True))
                near = close.argmax(axis=1)
                for i in np.flatnonzero(close.sum(axis=1) > 1):
                    js = np.flatnonzero(close[i])
                    near[i] = js[((centres[js] - x[i]) ** 2).sum(axis=1).argmin()]
                for k, own in by_k.items():
                    yield pd.DataFrame({"config": f"condensed_ward_{k}", "point": some["point"].to_numpy(), "cluster": own[near]})

    rows = matrix.select("point", F.col("vector").cast("array<double>").alias("vector")).where("vector is not null and not exists(vector, x -> x is null or isnan(x))")
    return rows.mapInPandas(assign, "config string, point long, cluster int")
