"""Checks that nothing of a test reaches its training: places of windows, targets across the split, order of rows.

The places are read out of the windows themselves: the operator that makes them gets the numbers of the returns as
returns, so a sum of h following ones tells which they were.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import models
from .returns import FOLDS, WINDOWS, supervised, with_folds
from .series_kernels import _each, as_arrays, windows_of


def window_places(returns: DataFrame, horizon: int, window: int | None = None) -> DataFrame:
    """Rows (series_id, i, m, feature_first, feature_last, target_first, target_last): which returns each window and its target hold."""
    window = window or WINDOWS[horizon]
    rows = supervised(returns.withColumn("r", F.col("rn").cast("double")), horizon, window)
    half = (horizon - 1) / 2
    place = lambda total, offset: F.round(total / horizon + offset).cast("long")
    oldest, newest = F.col("x")[0], F.element_at("x", -1)
    return rows.select(
        "series_id", "market", "date", "i", "m", "last", "y", place(oldest, -half).alias("feature_first"), place(newest, half).alias("feature_last"), place(F.col("y"), -half).alias("target_first"), place(F.col("y"), half).alias("target_last")
    )


def window_alignment(returns: DataFrame, horizons: Sequence[int] = (1, 5, 20), folds: int = FOLDS, windows: Mapping[int, int] = WINDOWS) -> DataFrame:
    """By horizon and fold: windows, those that hold a return of their own target, those of another width or with a gap before the target,
    and training rows whose target reaches into the first test target (there is no gap between training and test)."""
    out = None
    for h in horizons:
        w = windows[h]
        rows = with_folds(window_places(returns, h, w), folds)
        first_test = F.min(F.when(F.col("part") == "test", F.col("target_first"))).alias("_first_test")
        starts = rows.groupBy("series_id", "fold").agg(first_test)
        wrong = (F.col("target_last") - F.col("target_first") + 1 != h) | (F.col("feature_last") - F.col("feature_first") + 1 != h + w - 1) | (F.col("target_first") != F.col("feature_last") + 1)
        found = rows.join(starts, ["series_id", "fold"]).groupBy("fold").agg(
            F.count("*").alias("n_windows"), F.count_if(F.col("feature_last") >= F.col("target_first")).alias("n_leaks"), F.count_if(wrong).alias("n_misaligned"),
            F.count_if((F.col("part") == "train") & (F.col("target_last") >= F.col("_first_test"))).alias("n_overlapping_targets"),
        )
        part = found.select(F.lit(h).alias("horizon"), "*")
        out = part if out is None else out.unionByName(part)
    return out


def row_order_invariance(returns: DataFrame, names: Sequence[str] = ("ridge_lag", "esn"), horizon: int = 5, seed: int = 2026, tolerance: float = 1e-3) -> DataFrame:
    """(series_id, gap_<model>, passed, status): the largest change of a test prediction, in deviations of the target, when the training rows come in another order.

    A model that is fitted by least squares must not care, but for the rounding of single precision; a series too short for ten training rows has null gaps and does not pass.
    """
    window = WINDOWS[horizon]

    def gaps(r: np.ndarray) -> dict[str, float | None]:
        x, y = windows_of(r, horizon, window)
        at = len(y) - max(1, len(y) // (FOLDS + 1))
        if at < 10:
            return {f"gap_{n}": None for n in names}
        order, out = np.random.default_rng(seed).permutation(at), {}
        for n in names:
            said = []
            for rows in (np.arange(at), order):
                model = models.make(n)
                model.fit(x[:at][rows], y[:at][rows])
                said.append(np.asarray(model.predict(x[at:]), float))
            out[f"gap_{n}"] = float(np.abs(said[0] - said[1]).max() / max(y[:at].std(), 1e-300))
        return out

    found = _each(as_arrays(returns), gaps, ", ".join(f"gap_{n} double" for n in names))
    passed = F.coalesce(F.greatest(*(F.col(f"gap_{n}") for n in names)) <= tolerance, F.lit(False)) if len(names) > 1 else F.coalesce(F.col(f"gap_{names[0]}") <= tolerance, F.lit(False))
    return found.withColumn("passed", passed)
