"""Operators that need a sequential or pairwise pass over one series: spectrum, complexity, chaos, models, clusterings.

The length policy bounds a series, so it travels as one array; tasks are spread by series and by what is computed.
"""

from __future__ import annotations

import time
from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import kernels, models
from .returns import FOLDS, WINDOWS

#: A matrix that is clustered goes to every task, as it is given: floats take half the bytes of doubles.
MATRIX_BYTES = 256 << 20
#: Ward compares all rows in one task, whose memory grows like the rows; so many bytes of distances are what a million rows have.
WARD_BYTES = 8 << 40
#: Refits that a task of the bootstrap does.
REFITS = 5


def spread(rows: DataFrame, *keys: str) -> DataFrame:
    """Rows dealt by the keys to a fixed number of tasks: few rows that each cost much time must not be put together."""
    return rows.repartition(4 * int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")), *keys)


def as_arrays(returns: DataFrame) -> DataFrame:
    """(series_id, r): each series' returns in order, as one array."""
    ordered = F.transform(F.sort_array(F.collect_list(F.struct("rn", "r"))), lambda s: s["r"])
    return returns.groupBy("series_id").agg(ordered.alias("r"))


def _each(arrays: DataFrame, kernel, fields: str) -> DataFrame:
    """The kernel's dict for each series, as columns; a series that fails gets nulls and its error in ``status``."""
    names = [f.split()[0] for f in fields.split(", ")]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            out = []
            for sid, r in zip(pdf["series_id"], pdf["r"], strict=True):
                x = np.asarray(r, float)
                try:
                    found, status = kernel(x[np.isfinite(x)]), "success"
                except Exception as e:  # noqa: BLE001  one series' error is a row, not the job's end
                    found, status = {}, f"failed: {type(e).__name__}"
                out.append((sid, *(found.get(n) for n in names), status))
            yield pd.DataFrame(out, columns=["series_id", *names, "status"])

    return spread(arrays, "series_id").mapInPandas(run, f"series_id string, {fields}, status string")


def spectral_features(returns: DataFrame, method: str = "welch") -> DataFrame:
    """Slope, entropy and flatness from Welch's averaged segments or from the full-length periodogram."""
    return _each(as_arrays(returns), lambda x: kernels.spectral(x, method=method), "slope double, entropy double, flatness double")


def periodograms(returns: DataFrame) -> DataFrame:
    """(series_id, k, frequency, power) of every positive frequency of each series about its mean."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for sid, r in zip(pdf["series_id"], pdf["r"], strict=True):
                x = np.asarray(r, float)
                x = x[np.isfinite(x)]
                if len(x) >= 8:
                    f, p = kernels.periodogram(x - x.mean())
                    yield pd.DataFrame({"series_id": sid, "k": np.arange(1, len(f)), "frequency": f[1:], "power": p[1:]})

    return spread(as_arrays(returns), "series_id").mapInPandas(run, "series_id string, k long, frequency double, power double")


def lempel_ziv(returns: DataFrame) -> DataFrame:
    return _each(as_arrays(returns), lambda x: {"lz": kernels.lempel_ziv(x)}, "lz double")


def sample_entropy(returns: DataFrame) -> DataFrame:
    return _each(as_arrays(returns), lambda x: {"sampen": kernels.sample_entropy(x)}, "sampen double")


def chaos_features(returns: DataFrame) -> DataFrame:
    return _each(as_arrays(returns), kernels.chaos, "delay int, delay_method string, dimension int, dimension_method string, correlation_dimension double, lyapunov double")


def delays(returns: DataFrame) -> DataFrame:
    """(series_id, delay, method, status): the embedding delay of each series and the rule that gave it."""

    def one(x: np.ndarray) -> dict:
        delay, method = kernels.choose_delay(x)
        return {"delay": delay, "method": method}

    return _each(as_arrays(returns), one, "delay int, method string")


def chi2_tail(statistic: str, freedom: str):
    """Column of chi-squared tail probabilities."""

    @F.pandas_udf(T.DoubleType())
    def tail(q: pd.Series, m: pd.Series) -> pd.Series:
        return pd.Series([None if pd.isna(a) else kernels.chi2_tail(a, b) for a, b in zip(q, m, strict=True)], dtype=float)

    return tail(F.col(statistic), F.col(freedom).cast("double"))


def windows_of(r: np.ndarray, horizon: int, window: int) -> tuple[np.ndarray, np.ndarray]:
    """(X, y): windows of trailing sums and sums of the next returns, at every anchor that has both."""
    total = np.concatenate([[0.0], np.cumsum(r)])
    f = total[horizon:] - total[:-horizon]
    m = len(r) - horizon - (horizon - 1 + window - 1)
    if m < FOLDS + 2:
        return np.empty((0, window)), np.empty(0)
    return np.lib.stride_tricks.sliding_window_view(f, window)[:m], f[window - 1 + horizon :][:m]


def forecast_tasks(returns: DataFrame, names: Sequence[str], horizons: Sequence[int] = (1, 5, 20), folds: int = FOLDS, settings: dict[str, dict] | None = None, done: DataFrame | None = None) -> DataFrame:
    """Test predictions of every series, horizon, model and fold, with training facts, time and status.

    Models are fitted on training rows without their last fifth. Tasks in ``done`` (series_id, horizon, model)
    are left out, so that a run can be resumed.
    """
    settings = settings or {}
    for n in names:
        models.make(n, **settings.get(n, {}))
    tasks = as_arrays(returns).withColumn("horizon", F.explode(F.array(*(F.lit(h) for h in horizons)))).withColumn("model", F.explode(F.array(*(F.lit(n) for n in names))))
    if done is not None:
        tasks = tasks.join(done.select("series_id", "horizon", "model").distinct(), ["series_id", "horizon", "model"], "left_anti")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        columns = ["series_id", "horizon", "model", "fold", "i", "y", "prediction", "train_mean", "train_step", "seconds", "status"]
        for pdf in batches:
            for sid, r, h, name in pdf[["series_id", "r", "horizon", "model"]].itertuples(index=False):
                x, y = windows_of(np.asarray(r, float), h, WINDOWS[h])
                test = max(1, len(y) // (folds + 1))
                for fold in range(1, folds + 1):
                    at = len(y) - folds * test + (fold - 1) * test
                    if at < 10:
                        continue
                    fit, began = at - max(1, int(at * 0.2)), time.perf_counter()
                    p, status = np.full(test, np.nan), "success"
                    try:
                        model = models.make(name, **settings.get(name, {}))
                        model.fit(x[:fit], y[:fit])
                        p = np.asarray(model.predict(x[at : at + test]), float)
                    except Exception as e:  # noqa: BLE001  one task's error is its status
                        status = f"failed: {type(e).__name__}"
                    rows = {"i": np.arange(at, at + test), "y": y[at : at + test], "prediction": p}
                    yield pd.DataFrame(rows).assign(series_id=sid, horizon=h, model=name, fold=fold, train_mean=y[:at].mean(), train_step=np.abs(np.diff(y[:at])).mean(), seconds=time.perf_counter() - began, status=status)[columns]

    return spread(tasks, "series_id", "horizon", "model").mapInPandas(run, "series_id string, horizon int, model string, fold int, i long, y double, prediction double, train_mean double, train_step double, seconds double, status string")


def tune(returns: DataFrame, name: str, candidates: dict[str, dict], horizons: Sequence[int] = (5,)) -> DataFrame:
    """Task measures of each candidate's settings of one model, under ``candidate``."""
    from .forecasts import TASK, task_metrics

    out = None
    for key, settings in candidates.items():
        part = task_metrics(forecast_tasks(returns, [name], horizons, settings={name: settings}).where("status = 'success'"), TASK).withColumn("candidate", F.lit(key))
        out = part if out is None else out.unionByName(part)
    return out


def best_candidates(tuned: DataFrame, metric: str = "mae") -> DataFrame:
    """The candidate of the smallest mean for each model and horizon; ties to the smaller name."""
    means = tuned.groupBy("model", "horizon", "candidate").agg(F.avg(metric).alias("mean"))
    best = F.min_by(F.struct("candidate", "mean"), F.struct(F.round("mean", 12), "candidate"))
    return means.groupBy("model", "horizon").agg(best.alias("b"), F.count("*").alias("n_candidates")).select("model", "horizon", "b.candidate", "b.mean", "n_candidates")


def registry_table(spark, active: Sequence[str], supported: Sequence[str]) -> DataFrame:
    """Every registered model: in use, usable, or only registered."""
    rows = [(n, "active" if n in active else "inactive_but_supported" if n in supported else "registered_not_selected") for n in sorted(models.REGISTRY)]
    return spark.createDataFrame(rows, "model string, status string")


def permuted_target_ratio(returns: DataFrame, name: str = "ridge_lag", horizon: int = 1, seed: int = 2026, least_ratio: float = 1.05) -> DataFrame:
    """Error of a model trained on shuffled targets against the honest one, for each series, and whether it is as much worse as it should be."""

    def ratio(r: np.ndarray) -> dict[str, float | None]:
        x, y = windows_of(r, horizon, WINDOWS[horizon])
        at = len(y) - max(1, len(y) // (FOLDS + 1))
        if at < 20:
            return {"honest": None, "permuted": None}
        out = {}
        for key, t in (("honest", y[:at]), ("permuted", np.random.default_rng(seed).permutation(y[:at]))):
            model = models.make(name)
            model.fit(x[:at], t)
            out[key] = float(np.sqrt(((model.predict(x[at:]) - y[at:]) ** 2).mean()))
        return out

    return _each(as_arrays(returns), ratio, "honest double, permuted double").withColumn("ratio", F.try_divide("permuted", "honest")).withColumn("passed", F.col("ratio") >= least_ratio)


def speed_summary(predictions: DataFrame) -> DataFrame:
    """Time and failures of each model."""
    tasks = predictions.groupBy("model", "series_id", "horizon", "fold").agg(F.first("seconds").alias("seconds"), F.first("status").alias("status"))
    return tasks.groupBy("model").agg(F.count("*").alias("n_tasks"), F.sum("seconds").alias("seconds"), F.count_if(F.col("status") != "success").alias("n_failed"))


def grid_configs(scalers: Sequence[str], dims: Sequence[int | None], ks: Sequence[int], methods: Sequence[str]) -> list[tuple]:
    """(config, scaler, axes or 0 for the original space, clusters, method) of every combination."""
    return [(f"{s}_{f'pca{d}' if d else 'original'}_{m}_{k}", s, d or 0, k, m) for s in scalers for d in dims for m in methods for k in ks]


def local_matrix(rows: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """Points and vectors of rows (point, vector), in the order of the points and of the type they are given in; missing components are their column's median."""
    rows = rows.select("point", "vector").where("vector is not null")
    n, width, least = rows.agg(F.count("*"), F.max(F.size("vector")), F.min(F.size("vector"))).first()
    if not n:
        return np.zeros(0, int), np.zeros((0, 0))
    kind = np.float32 if isinstance(rows.schema["vector"].dataType.elementType, T.FloatType) else np.float64
    if n * width * np.dtype(kind).itemsize > MATRIX_BYTES:
        raise ValueError(f"a matrix of {n} rows is too large to be clustered in one task; at most {MATRIX_BYTES} bytes")
    if width != least:
        raise ValueError(f"vectors of {least} and of {width} components")
    found = rows.orderBy("point").toArrow()
    points = found["point"].to_pandas(integer_object_nulls=True).to_numpy()
    values = found["vector"].combine_chunks().flatten().to_numpy(zero_copy_only=False).astype(kind).reshape(n, width)
    if np.isnan(values).any():
        values = np.where(np.isnan(values), np.nan_to_num(np.nanmedian(values.astype(float), axis=0)), values)
    return points, values


def cluster_grid(
    matrix: DataFrame, scalers: Sequence[str] = ("identity", "robust", "quantile"), dims: Sequence[int | None] = (None, 2, 3, 4, 5, 6), ks: Sequence[int] = range(2, 9), methods: Sequence[str] = ("gmm", "ward"), bootstraps: int = 0, share: float = 0.8, seed: int = 42
) -> DataFrame:
    """Labels of every configuration (scaler, axes, method, clusters), a mixture or a whole tree in each task.

    matrix: rows (point, vector), the feature table of a screened panel; missing components take their column's median. It is broadcast,
    so its size is checked (floats stay floats until a task has them). A configuration that fails is one row with its error in ``status``. With bootstraps, rows give
    the agreement of fits on subsamples with the fit on all instead.
    """
    rows = matrix.select("point", "vector")
    n = rows.where("vector is not null").count() if "ward" in methods else 0
    if n * n * 8 > WARD_BYTES:
        raise ValueError(f"Ward compares {n} x {n} rows in one task; at most {WARD_BYTES} bytes of distances")
    points, values = local_matrix(rows)
    width = values.shape[1]
    shared = rows.sparkSession.sparkContext.broadcast((points, values))
    # one row for each task: a mixture, or the tree of a space with all its numbers of clusters; those that take longest come first
    units: dict[tuple, list] = {}
    for config, scaler, d, k, method in grid_configs(scalers, dims, ks, methods):
        units.setdefault((scaler, d, method, None if method == "ward" else k), []).append((config, k))
    slow = sorted(units.items(), key=lambda u: -(u[0][1] or width or 0) * max(k for _, k in u[1]))
    refits = [list(range(at, min(at + REFITS, bootstraps + 1))) for at in range(1, bootstraps + 1, REFITS)] or [[]]
    each = [(scaler, d, method, [c for c, _ in own], [k for _, k in own], nths) for (scaler, d, method, _), own in slow for nths in refits]
    configs = rows.sparkSession.createDataFrame(rows.sparkSession.sparkContext.parallelize(each, max(1, len(each))), "scaler string, d int, method string, configs array<string>, ks array<int>, nths array<int>")

    def fits(x: np.ndarray, unit, nth: int) -> dict[str, tuple | Exception]:
        """Labels, confidences and entropies of each of the task's configurations, or its error."""
        out: dict[str, tuple | Exception] = {}
        merges, x = None, x.astype(float)
        for config, k in zip(unit.configs, unit.ks, strict=True):
            if len(x) <= k:
                continue
            try:
                if merges is None:
                    z = kernels.SCALERS[unit.scaler](x)
                    z = kernels.principal(z, min(unit.d, *z.shape)) if unit.d else z
                if unit.method == "ward":
                    merges = kernels.ward_merges(z) if merges is None else merges
                    out[config] = kernels.cut(merges, len(z), k), np.ones(len(z)), np.zeros(len(z))
                else:
                    out[config] = kernels.gaussian_mixture(z, k, seed=seed + nth)
            except Exception as e:  # noqa: BLE001  one configuration's error is a row, not the job's end
                out[config] = e
        return out

    def labels(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        points, x = shared.value
        for pdf in batches:
            for unit in pdf.itertuples(index=False):
                for config, found in fits(x, unit, 0).items():
                    if isinstance(found, Exception):
                        yield pd.DataFrame({"config": [config], "point": [None], "cluster": [None], "confidence": [None], "entropy": [None], "status": [f"failed: {type(found).__name__}"]})
                    else:
                        yield pd.DataFrame({"config": config, "point": points, "cluster": found[0], "confidence": found[1], "entropy": found[2], "status": "success"})

    def stability(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        points, x = shared.value
        size = int(len(points) * share)
        for pdf in batches:
            for unit in pdf.itertuples(index=False):
                out, whole = [], fits(x, unit, 0)
                for nth in unit.nths:
                    pick = np.sort(np.random.default_rng(seed + nth).choice(len(points), size, replace=False))
                    for config, part in fits(x[pick], unit, int(nth)).items():
                        if failed := next((e for e in (whole[config], part) if isinstance(e, Exception)), None):
                            out.append((config, nth, None, None, f"failed: {type(failed).__name__}"))
                        else:
                            a, b = whole[config][0][pick], part[0]
                            out.append((config, nth, kernels.adjusted_rand(a, b), kernels.normalised_information(a, b), "success"))
                yield pd.DataFrame(out, columns=["config", "nth", "ari", "nmi", "status"])

    if bootstraps:
        return configs.mapInPandas(stability, "config string, nth int, ari double, nmi double, status string")
    return configs.mapInPandas(labels, "config string, point long, cluster int, confidence double, entropy double, status string")


def assignment_confidence(labels: DataFrame) -> DataFrame:
    """Mean and least of the largest probabilities of each configuration's points, and their mean entropy."""
    return labels.where("status = 'success'").groupBy("config").agg(F.avg("confidence").alias("confidence_mean"), F.min("confidence").alias("confidence_min"), F.avg("entropy").alias("entropy_mean"))


def stability_summary(runs: DataFrame) -> DataFrame:
    """Mean and deviation of the agreement of each configuration's refits, and how many failed."""
    each = [f(m).alias(f"{m}_{n}") for m in ("ari", "nmi") for n, f in (("mean", F.avg), ("std", F.stddev_samp))]
    return runs.groupBy("config").agg(F.count_if(F.col("status") == "success").alias("n"), F.count_if(F.col("status") != "success").alias("n_failed"), *each)


def mixtures_at_scale(matrix: DataFrame, dims: Sequence[int] = (2, 4), ks: Sequence[int] = (3, 5), seed: int = 42) -> DataFrame:
    """Labels (config, point, cluster, confidence) of Gaussian mixtures on principal axes, fitted over the distributed table: no bound on rows."""
    from pyspark.ml.clustering import GaussianMixture
    from pyspark.ml.feature import PCA, StandardScaler
    from pyspark.ml.functions import array_to_vector, vector_to_array

    rows = matrix.where("vector is not null").select("point", array_to_vector("vector").alias("_raw"))
    scaled = StandardScaler(inputCol="_raw", outputCol="_scaled", withMean=True).fit(rows).transform(rows).drop("_raw").persist()
    out = None
    for d in dims:
        axes = PCA(k=d, inputCol="_scaled", outputCol="features").fit(scaled).transform(scaled).select("point", "features")
        for k in ks:
            said = GaussianMixture(k=k, seed=seed).fit(axes).transform(axes)
            part = said.select(F.lit(f"pca{d}_gmm_{k}").alias("config"), "point", F.col("prediction").alias("cluster"), F.array_max(vector_to_array("probability")).alias("confidence"))
            out = part if out is None else out.unionByName(part)
    return out
