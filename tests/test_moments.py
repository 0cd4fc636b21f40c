"""Ridge on many targets, principal scores, periodograms and leakage checks against plain NumPy."""

import numpy as np
import pytest
from pyspark.sql import Window

from seriesloom.functions import kernels
from seriesloom.operators import leakage, moments, series_kernels


def frame(spark, x, names):
    return spark.createDataFrame([tuple(None if v is None or np.isnan(v) else float(v) for v in row) for row in x], ", ".join(f"{n} double" for n in names))


@pytest.mark.parametrize("standardise", [False, True])
def test_multi_ridge_equals_normal_equations(spark, standardise):
    rng = np.random.default_rng(1)
    x = np.column_stack([rng.normal(1e6, 3, 300), rng.normal(0, 0.1, 300), np.full(300, 7.0), rng.normal(5, 2, 300)])
    y = np.column_stack([x[:, 0] * 0.5 + rng.normal(size=300), x[:, 3] - 20 * x[:, 1], rng.normal(size=300)])
    names, targets = ["a", "b", "same", "c"], ["t1", "t2", "t3"]
    gaps = np.full((2, 7), np.nan)
    gaps[1, :6] = 1.0
    rows = frame(spark, np.vstack([np.hstack([x, y]), gaps]), names + targets).repartition(5)
    fit = moments.fit_multi_ridge(rows, names, targets, (0.5, 100.0), standardise)
    c = x - x.mean(axis=0)
    scale = np.where(c.std(axis=0) > 0, c.std(axis=0), 1.0) if standardise else np.ones(4)
    for i, a in enumerate((0.5, 100.0)):
        w = np.linalg.solve((c / scale).T @ (c / scale) + a * np.eye(4), (c / scale).T @ (y - y.mean(axis=0))) / scale[:, None]
        w[2] = 0
        assert np.allclose(fit.coefficients[i], w, atol=1e-7) and np.allclose(fit.intercepts[i], y.mean(axis=0) - x.mean(axis=0) @ w, rtol=1e-7, atol=1e-3)
    said = np.array([r[0] for r in rows.where("t3 is not null").orderBy("a").select(fit.predicted(100.0, "t2")).collect()])
    assert np.allclose(said, (fit.intercepts[1, 1] + x @ fit.coefficients[1, :, 1])[np.argsort(x[:, 0])], atol=1e-6)
    assert fit.table(spark).count() == 2 * 3 * 5
    none = moments.fit_multi_ridge(rows.limit(0), names, targets)
    assert not none.coefficients.any() and not none.intercepts.any()


def test_principal_scores(spark):
    rng = np.random.default_rng(4)
    x = rng.normal(size=(400, 6)) @ np.diag([5, 3, 1, 1, 0.5, 0.1]) @ np.linalg.qr(rng.normal(size=(6, 6)))[0] + 100
    rows = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)] + [(900, None), (901, [None] * 6), (902, [float("nan")] + [100.0] * 5)], "point long, vector array<double>")
    got = {r.point: r for r in moments.principal_scores(rows, 2).collect()}
    c = x - x.mean(axis=0)
    _, s, vt = np.linalg.svd(c, full_matrices=False)
    for k in range(2):
        axis = vt[k] * np.sign(vt[k][np.abs(vt[k]).argmax()])
        assert np.allclose([got[i][f"pc{k + 1}"] for i in range(400)], c @ axis, atol=1e-8)
        assert abs(got[0][f"share_{k + 1}"] - s[k] ** 2 / (s**2).sum()) < 1e-10
    assert got[900].pc1 is None and got[901].pc1 == 0.0 and np.isfinite(got[902].pc1)
    assert moments.principal_scores(rows.limit(0), 2).count() == 0


def test_periodogram_keeps_energy():
    """Parseval: the mean of squares is the sum of the density over its frequencies, for even and odd lengths."""
    rng = np.random.default_rng(0)
    for n in (8, 9, 500, 501):
        x = rng.normal(size=n)
        _, p = kernels.periodogram(x)
        assert abs(p.sum() / n - (x * x).mean()) < 1e-12
    assert kernels.periodogram(rng.normal(size=7)) is None
    t = np.arange(400)
    f, p = kernels.periodogram(np.cos(2 * np.pi * 40 * t / 400))
    assert f[p.argmax()] == 0.1 and p.max() == pytest.approx(p.sum())


RETURNS = "series_id string, market string, date long, rn int, n int, r double"


def returns(spark, lengths):
    rng = np.random.default_rng(5)
    return spark.createDataFrame([(f"s{k}", "US", i, i, n, float(x)) for k, n in enumerate(lengths) for i, x in enumerate(rng.normal(0, 1, n))], RETURNS)


def test_places_of_windows(spark):
    data = returns(spark, (60,))
    for r in leakage.window_places(data, 3, 4).collect():
        anchor = r.i + 2 + 3
        assert (r.feature_first, r.feature_last, r.target_first, r.target_last) == (anchor - 5, anchor, anchor + 1, anchor + 3)
    found = {(r.horizon, r.fold): r for r in leakage.window_alignment(data, (1, 3), windows={1: 5, 3: 4}).collect()}
    assert all(r.n_leaks == r.n_misaligned == 0 for r in found.values())
    assert all(r.n_overlapping_targets == h - 1 for (h, _), r in found.items())


def test_windows_that_leak_are_counted(spark, monkeypatch):
    """Windows shifted by one return hold a part of their target."""
    honest = leakage.supervised

    def shifted(rows, horizon, window=None):
        ahead = leakage.F.lead("r", 1).over(Window.partitionBy("series_id").orderBy("rn"))
        out = honest(rows, horizon, window)
        late = honest(rows.withColumn("r", leakage.F.coalesce(ahead, "r")), horizon, window).select("series_id", "i", leakage.F.col("x").alias("_x"))
        return out.join(late, ["series_id", "i"]).withColumn("x", leakage.F.col("_x")).drop("_x")

    monkeypatch.setattr(leakage, "supervised", shifted)
    found = leakage.window_alignment(returns(spark, (60,)), (3,), windows={3: 4}).collect()
    assert all(r.n_leaks == r.n_misaligned == r.n_windows for r in found)


def test_row_order(spark, monkeypatch):
    got = {r.series_id: r for r in leakage.row_order_invariance(returns(spark, (200, 30)), horizon=5).collect()}
    assert got["s0"].passed and got["s0"].gap_esn < 1e-6 and not got["s1"].passed and got["s1"].gap_esn is None
    # a trained net sees its rows in their order
    other = leakage.row_order_invariance(returns(spark, (200,)), ("vanilla_mlp",), horizon=5).first()
    assert not other.passed and other.status == "success"


def test_both_densities(spark):
    data = returns(spark, (300,))
    a, b = (series_kernels.spectral_features(data, method=m).first() for m in ("welch", "periodogram"))
    assert a.status == b.status == "success" and a.flatness != b.flatness
