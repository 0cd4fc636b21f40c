"""Closed forms, seeded sanity checks and contracts of the panel operators."""

import math

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from seriesloom.functions import kernels, models
from seriesloom.functions.columns import conform
from seriesloom.operators import by_cluster, catalog, clusters, dependence, forecasts, returns, routing, screening, series_kernels, shape
from seriesloom.sources import files


def panel(spark, **series):
    rows = [(sid, "X", pd.Timestamp("2020-01-01") + pd.Timedelta(days=i), float(c)) for sid, closes in series.items() for i, c in enumerate(closes)]
    return spark.createDataFrame(pd.DataFrame(rows, columns=["series_id", "market", "date", "close"])).withColumn("ticker", F.col("series_id"))


def returns_of(spark, **series):
    rows = [(sid, "X", pd.Timestamp("2020-01-01") + pd.Timedelta(days=i), i, len(r), float(v)) for sid, r in series.items() for i, v in enumerate(r)]
    return spark.createDataFrame(pd.DataFrame(rows, columns=["series_id", "market", "date", "rn", "n", "r"]))


def test_log_returns(spark):
    got = returns.log_returns(panel(spark, a=[100, 110, 121], bad=[1, 0, 2])).orderBy("rn").toPandas()
    assert got.series_id.unique().tolist() == ["a"]
    np.testing.assert_allclose(got.r, [math.log(1.1)] * 2)


def test_catalog_cascade(spark):
    got = catalog.series_catalog(panel(spark, long=[1] * 8, mid=[1] * 5, short=[1] * 2, zero=[1, 0, 1]), target=8, minimum=5).toPandas().set_index("series_id")
    assert got.status.to_dict() == {"long": "valid_target", "mid": "valid_min_only", "short": "invalid", "zero": "invalid"}
    assert got.reason.to_dict() == {"long": "ok", "mid": "ok", "short": "too_short", "zero": "nonpositive_close"}


def test_length_policy(spark):
    kept = returns.length_policy(returns_of(spark, a=[1] * 21, b=[1] * 17, c=[1] * 14), target=20, minimum=15)
    got = kept.groupBy("series_id").agg(F.count("*").alias("n"), F.min("rn").alias("low"), F.max("rn").alias("high"), F.first("short_series").alias("short")).toPandas().set_index("series_id")
    assert got.n.to_dict() == {"a": 20, "b": 17}
    assert got.high.to_dict() == {"a": 19, "b": 16} and got.short.to_dict() == {"a": False, "b": True}


def test_horizon_targets(spark):
    r = returns_of(spark, a=[0.1, -0.2, 0.3, 0.4, -0.1])
    one = [x.y for x in returns.horizon_targets(r, 1).orderBy("rn").collect()]
    two = [x.y for x in returns.horizon_targets(r, 2).orderBy("rn").collect()]
    np.testing.assert_allclose(one, [-0.2, 0.3, 0.4, -0.1])
    np.testing.assert_allclose(two, [0.1, 0.7, 0.3])


def test_windows_agree_with_arrays(spark):
    x = np.random.default_rng(1).normal(size=80)
    rows = returns.supervised(returns_of(spark, a=x), 5, 8).orderBy("i").collect()
    X, y = series_kernels.windows_of(x, 5, 8)
    assert len(rows) == len(X)
    np.testing.assert_allclose([r.x for r in rows], X)
    np.testing.assert_allclose([r.y for r in rows], y)


def test_folds_are_ordered(spark):
    splits = returns.split_metadata(returns.with_folds(returns.supervised(returns_of(spark, a=np.arange(60.0)), 5, 8)))
    got = splits.orderBy("fold").collect()
    assert len(got) == 3 and all(s.train_end < s.test_start for s in got)
    assert returns.fold_leaks(splits).first().n_violations == 0


def test_memory_of_closed_forms(spark):
    """A sign that flips every step and a straight line, whose measures follow from their formulas."""
    n = 2000
    r = returns_of(spark, flip=np.array([1.0, -1.0] * (n // 2)), line=np.arange(n, dtype=float))
    grid = {(x.series_id, x.lag): x.acf for x in dependence.acf(r).collect()}
    assert all(abs(grid["flip", k] - (-1) ** k * (n - k) / n) < 1e-12 for k in dependence.ACF_LAGS)
    centred = np.arange(n) - (n - 1) / 2
    assert all(abs(grid["line", k] - (centred[k:] * centred[: n - k]).sum() / (n * (n * n - 1) / 12)) < 1e-9 for k in (1, 10, 250))
    sums = {x.up_to: x.iacf for x in dependence.integrated_acf(dependence.acf(r)).where("series_id = 'flip'").collect()}
    assert sums[5] == pytest.approx(sum((n - k) / n for k in range(1, 6))) and sums[20] == pytest.approx(sum((n - k) / n for k in range(1, 21)))
    q = {x.order: x for x in dependence.ljung_box(r).withColumn("p", series_kernels.chi2_tail("q", "order")).where("series_id = 'flip'").collect()}
    assert all(q[m].q == pytest.approx((n + 2) / n * sum(n - k for k in range(1, m + 1))) and q[m].p < 1e-200 for m in (5, 50))
    ratio = {x.q: x.variance_ratio for x in dependence.variance_ratio(r).where("series_id = 'flip'").collect()}
    assert ratio[2] == 0 and ratio[10] == 0 and ratio[5] == pytest.approx(1 / 5, rel=1e-2)  # five flips sum to one, two or ten to none
    # a line's chunks: ranges over deviations grow like the window, residuals of its parabola like the window's square
    assert dependence.hurst_rs(r).where("series_id = 'line'").first().hurst == pytest.approx(1.0, abs=0.02)
    assert dependence.hurst_dfa(r).where("series_id = 'line'").first().hurst == pytest.approx(2.0, abs=0.02)


def test_tails_of_closed_forms(spark):
    """Even steps from -1 to 1, and both signs of a power law's quantiles."""
    n, alpha = 4000, 2.5
    law = (n / np.arange(1.0, n + 1)) ** (1 / alpha)
    r = returns_of(spark, even=np.linspace(-1, 1, n + 1), law=np.concatenate([law, -law]))
    at = lambda f, c: {x.series_id: x[c] for x in f(r).collect()}
    assert at(shape.fisher_kurtosis, "kurtosis")["even"] == pytest.approx(-1.2, abs=0.01)
    assert at(shape.moors_kurtosis, "moors")["even"] == pytest.approx(1.0)
    for c in ("tail_both", "tail_up", "tail_low"):
        assert at(shape.tail_ratios, c)["even"] == pytest.approx(0.98 / 0.5)
    hill = {x.series_id: x for x in shape.hill_index(r).collect()}
    k = hill["law"].k
    largest = np.sort(np.concatenate([law, law]))[::-1]
    assert k == 400 and hill["law"].hill == pytest.approx(1 / np.log(largest[:k] / largest[k]).mean()) == pytest.approx(alpha, rel=0.02)


def test_noise_fn(spark):
    x = np.array([0, 1, 0, 1, 0.0])
    got = shape.noise_fn(returns_of(spark, a=x)).first().noise_fn
    assert got == pytest.approx(np.diff(x).std(ddof=1) / x.std(ddof=1))


def test_spectra_of_one_wave_and_one_beat():
    beat = np.zeros(1024)
    beat[512] = 1.0
    flat, wave = kernels.spectral(beat), kernels.spectral(np.cos(2 * np.pi * 32 * np.arange(1024) / 256))
    assert flat["entropy"] > 0.999 and flat["flatness"] > 0.99 and abs(flat["slope"]) < 0.05
    assert wave["entropy"] < 0.25 and wave["flatness"] < 1e-6


def test_counts_of_patterns():
    flip = np.array([0.0, 1.0] * 32)
    assert kernels.lempel_ziv(flip) == pytest.approx(3 * 6 / 64)  # a zero, a one, and all the rest
    assert kernels.lempel_ziv(np.full(12, 2.0)) is None
    # templates match where they begin at places of the same parity: 50 and 49 of length two, 49 and 49 of length three
    pairs = lambda n: n * (n - 1) / 2
    assert kernels.sample_entropy(np.array([0.0, 1.0] * 50)) == pytest.approx(-np.log(2 * pairs(49) / (pairs(50) + pairs(49))))


def test_rules_of_the_dimension():
    choose = kernels.choose_dimension
    assert choose({2: 0.3, 3: 0.05, 4: 0.0}) == (3, "strict_threshold")
    assert choose({2: 0.9, 3: 0.31, 4: 0.305, 5: 0.301}) == (3, "stable_plateau")
    assert choose({2: 0.9, 3: 0.31, 4: 0.2, 5: 0.25}) == (4, "best_available")
    assert choose({}) == (None, "failed")
    assert kernels.choose_delay(np.zeros(60)) == (1, "acf_zero")


def test_chi_squared_of_even_freedom():
    for x in (0.1, 3.0, 40.0):
        assert kernels.chi2_tail(x, 2) == pytest.approx(np.exp(-x / 2))
        assert kernels.chi2_tail(x, 4) == pytest.approx(np.exp(-x / 2) * (1 + x / 2))


def test_exponents_of_doubling_and_of_a_rotation():
    """Doubling on a circle of prime length, exactly, parts states by two at every step; a rotation never does."""
    prime = 1_000_003
    doubled = np.array([pow(2, t, prime) * 12_345 % prime / prime for t in range(1500)])
    assert 0.45 < kernels.largest_lyapunov(kernels.embed(doubled, 2, 1)) < 0.75
    turned = np.cos(2 * np.pi * np.arange(1500) * (np.sqrt(5) - 1) / 2)
    assert abs(kernels.largest_lyapunov(kernels.embed(turned, 2, 1))) < 0.02


def test_correlation_dimension_is_of_all_states():
    """The plain sum over all pairs of 1,990 states."""
    rng = np.random.default_rng(11)
    v = rng.normal(size=(1990, 3)) * np.where(np.arange(1990)[:, None] % 5 == 2, 0.01, 1.0)
    d = np.sqrt(((v[:, None] - v[None]) ** 2).sum(axis=2))[np.triu_indices(len(v), 1)]
    r = np.logspace(*np.log10(np.quantile(d, [0.05, 0.8])), 24)
    x, y, best = np.log(r), np.log([(d < b).mean() for b in r]), (-1.0, 0.0)
    for i in range(19):
        slope, inter = np.polyfit(x[i : i + 6], y[i : i + 6], 1)
        best = max(best, (1 - ((y[i : i + 6] - slope * x[i : i + 6] - inter) ** 2).sum() / ((y[i : i + 6] - y[i : i + 6].mean()) ** 2).sum(), slope))
    assert kernels.correlation_dimension(v) == pytest.approx(best[1], rel=1e-4)


def test_welch_of_parseval():
    x = np.random.default_rng(0).normal(size=4096)
    f, p = kernels.welch(x)
    assert (p.sum() * f[1]) == pytest.approx(x.var(), rel=0.1)


def test_lyapunov_time(spark):
    got = shape.lyapunov_time(spark.createDataFrame([(5e-4,), (-1.0,), (0.5,)], "rate double"), "rate").collect()
    assert [r.flag for r in got] == ["lyapunov_time_near_zero_lle", "lyapunov_time_nonpositive_lle", ""] and got[2].lyapunov_time == 2.0


@pytest.mark.parametrize("name", list(models.REGISTRY))
def test_models_learn(name):
    rng = np.random.default_rng(3)
    x = rng.normal(size=(300, 8))
    y = x[:, -1] * 0.8 + rng.normal(size=300) * 0.05
    m = models.make(name, **({"epochs": 60} if hasattr(models.REGISTRY[name](), "epochs") else {}))
    m.fit(x[:250], y[:250])
    p = m.predict(x[250:])
    assert p.shape == (50,) and np.isfinite(p).all()
    if name in ("ridge_lag", "esn", "vanilla_mlp", "lstm_forecast"):
        assert ((p - y[250:]) ** 2).mean() < 0.5 * y[250:].var()


def test_gradients():
    rng = np.random.default_rng(5)
    x, y = rng.normal(size=(6, 5)), rng.normal(size=6)
    for m in (models.Perceptron(hidden=(4, 3), chaos=3.8), models.Lstm(size=3)):
        m.start(5, rng)
        out, cache = m.forward(x)
        grads = m.backward(cache, 2 * (out - y))
        for k, g in grads.items():
            at = tuple(np.unravel_index(np.abs(g).argmax(), g.shape))
            keep = m.params[k][at]
            loss = []
            for d in (1e-6, -1e-6):
                m.params[k][at] = keep + d
                loss.append(((m.forward(x)[0] - y) ** 2).sum())
            m.params[k][at] = keep
            assert g[at] == pytest.approx((loss[0] - loss[1]) / 2e-6, rel=1e-4)


def test_forecast_tasks(spark):
    x = {f"s{k}": np.sin(np.linspace(0, 40, 160)) + k * 0.1 for k in range(2)}
    got = series_kernels.forecast_tasks(returns_of(spark, **x), ["naive_zero", "ridge_lag"], (1,)).persist()
    assert got.where("status <> 'success'").count() == 0
    m = forecasts.task_metrics(got).toPandas().groupby("model").rmse.mean()
    assert m["ridge_lag"] < m["naive_zero"]
    done = got.where("model = 'ridge_lag'").select("series_id", "horizon", "model")
    again = series_kernels.forecast_tasks(returns_of(spark, **x), ["naive_zero", "ridge_lag"], (1,), done=done)
    assert {r.model for r in again.select("model").distinct().collect()} == {"naive_zero"}


def test_screening(spark):
    rows = [(f"s{i}", f, v) for i in range(3) for f, v in (("x", i + 1.0), ("y", 2.0 * (i + 1)), ("gap", 1.0 if i == 0 else None), ("flat", 0.001))]
    long = spark.createDataFrame(rows, "series_id string, feature string, value double")
    q = screening.feature_quality(long)
    pairs = screening.correlated_pairs(long)
    assert [(r.feature_1, r.feature_2) for r in pairs.collect()] == [("x", "y")]
    got = {r.feature: r.status for r in screening.screening(q, pairs).collect()}
    assert got["gap"] == "review_high_missing" and got["flat"] == "review_low_variance"
    edges = spark.createDataFrame([("a", "b"), ("b", "c"), ("x", "y")], "feature_1 string, feature_2 string")
    assert {r.feature: r.root for r in screening.feature_groups(edges).collect()} == {"a": "a", "b": "a", "c": "a", "x": "x", "y": "x"}


def test_cluster_fits():
    rng = np.random.default_rng(42)
    x = np.concatenate([rng.normal(c, 0.3, (30, 2)) for c in (0, 4, 8)])
    truth = np.repeat([0, 1, 2], 30)
    assert kernels.adjusted_rand(kernels.ward(x, 3), truth) == 1.0
    assert kernels.adjusted_rand(kernels.gaussian_mixture(x, 3)[0], truth) == 1.0


def test_agreement_of_equal_labels(spark):
    got = clusters.agreement(spark.createDataFrame([("c", i % 3, i % 3) for i in range(30)], "config string, a int, b int")).first()
    assert got.ari == pytest.approx(1) and got.nmi == pytest.approx(1)


def test_upsert_and_conform(spark):
    old = spark.createDataFrame([(1, 1, 1.0), (2, 1, 1.0)], "k int, o int, v double")
    new = spark.createDataFrame([(2, 1, 5.0), (3, 1, 3.0)], "k int, o int, v double")
    assert {r.k: r.v for r in catalog.resume_upsert(old, new, ["k"], "o").collect()} == {1: 1.0, 2: 5.0, 3: 3.0}
    assert conform(old, {"v": "string", "z": "long"}).dtypes == [("v", "string"), ("z", "bigint")]


def test_price_files(spark, tmp_path):
    (tmp_path / "ru").mkdir()
    (tmp_path / "us").mkdir()
    (tmp_path / "ru" / "GAZP_D1.csv").write_text("datetime,open,high,low,close,volume\n2020-01-02,1,2,0.5,x,100\n2020-01-01,1,2,0.5,1.5,100\n")
    (tmp_path / "us" / "AAPL.txt").write_text("Date,Open,High,Low,Close,Volume,OpenInt\n2020-01-01,1,2,0.5,10.5,100,0\n")
    ru = files.read_price_files(spark, str(tmp_path / "ru"), "RU").orderBy("date").collect()
    assert [r.series_id for r in ru] == ["RU:GAZP"] * 2 and [r.close for r in ru] == [1.5, None]
    us = files.read_price_files(spark, str(tmp_path / "us"), "US").collect()
    assert us[0].series_id == "US:AAPL" and us[0].close == 10.5
    files.write_bundle({"prices": files.read_price_files(spark, str(tmp_path / "us"), "US")}, str(tmp_path / "out"))
    assert spark.read.parquet(str(tmp_path / "out" / "prices")).count() == 1
    with pytest.raises(ValueError):
        files.require(spark.range(1), "close")


def test_routing(spark):
    rows = [(f"s{i}", 1, m, 1.0 + k + (i % 2) * (1 - 2 * k)) for i in range(8) for k, m in enumerate(("a", "b"))]
    s = spark.createDataFrame(rows, "series_id string, horizon int, model string, rmse_mean double")
    regret = {r.model: r.regret for r in routing.oracle_regret(s).collect()}
    assert regret["a"] == pytest.approx(0.5) and regret["b"] == pytest.approx(0.5)
    e = routing.evaluation(spark.createDataFrame([("a", "a"), ("a", "b"), ("b", "b")], "truth string, predicted string")).first()
    assert e.accuracy == pytest.approx(2 / 3) and e.balanced_accuracy == pytest.approx(0.75)


def test_keep_last(spark):
    rows = spark.createDataFrame([(1, 1, "x"), (1, 2, "y")], "k int, o int, v string")
    assert by_cluster.keep_last(rows, ["k"], "o").first().v == "y"


def test_kernel_queries_run_whole_jobs(spark, monkeypatch):
    """Registered over all horizons, the models' own settings, the whole grid and 30 bootstraps."""
    from unittest.mock import MagicMock

    from seriesloom.plans import kernel_queries as k

    tasks, grid = MagicMock(), MagicMock()
    monkeypatch.setattr(k.series_kernels, "forecast_tasks", tasks)
    monkeypatch.setattr(k.series_kernels, "cluster_grid", grid)
    monkeypatch.setattr(k.forecasts, "task_metrics", MagicMock())
    monkeypatch.setattr(k.clusters, "balance", MagicMock())
    for name in ("esn_forecast", "mlp_forecast", "lstm_forecast"):
        k.QUERIES[name](spark, "/root/testdata/sf0.001")
        assert tasks.call_args.args[2] == (1, 5, 20) and not tasks.call_args.kwargs.get("settings")
    for name in ("gmm_clusters", "ward_clusters", "cluster_grid_balance", "bootstrap_stability"):
        k.QUERIES[name](spark, "/root/testdata/sf0.001")
        assert not {"dims", "ks"} & set(grid.call_args.kwargs)
    assert grid.call_args.kwargs["bootstraps"] == 30
