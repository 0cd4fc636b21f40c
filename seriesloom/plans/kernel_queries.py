"""Queries that run NumPy kernels or learned models in tasks; SQL can't express them, tests hold them against references."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import models
from ..functions.columns import rounded
from ..operators import benchmark, boosting, clusters, dependence, forecasts, leakage, meta_models, moments, returns, routing, series_kernels, shape
from ..settings import chosen
from ..sources.panels import table
from ..sources.shared import stored
from . import panel_queries
from .cluster_queries import ks
from .forecast_queries import _SERIES, series
from .panel_queries import _SPLITS, BASIC, PANEL_SQL, basic_sql, eligible, folds_sql, supervised_sql

QUERIES: dict = {}
SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def add(f):
        QUERIES[name] = f
        if sql:
            SQL[name] = sql
        return f

    return add


def _spectral_sql(density: str) -> str:
    """Slope, entropy and flatness from a density (series_id, f, p)."""
    return f"""WITH {PANEL_SQL.strip()}, c AS (SELECT series_id, rn, n, r - avg(r) OVER (PARTITION BY series_id) AS d FROM elig), {density},
    sl AS (SELECT series_id, regr_slope(ln(p), ln(f)) AS slope, count(*) AS points FROM de WHERE f >= 0.01 AND f <= 0.5 AND p > 0 GROUP BY series_id),
    sh AS (SELECT series_id, greatest(p / sum(p) OVER (PARTITION BY series_id), 1e-18) AS share, greatest(p, 1e-18) AS floor FROM de WHERE f > 0),
    en AS (SELECT series_id, -sum(share * ln(share)) / ln(count(*)) AS entropy, exp(avg(ln(floor))) / avg(floor) AS flatness FROM sh GROUP BY series_id)
    SELECT series_id, CASE WHEN points >= 8 THEN round(slope, 6) + 0.0 END AS slope, round(entropy, 6) + 0.0 AS entropy, round(flatness, 6) + 0.0 AS flatness, 'success' AS status FROM en JOIN sl USING (series_id)"""


#: Means over half-overlapping Hann segments of 256; and the whole series.
_WELCH = """sg AS (SELECT series_id, s, rn - 128 * s AS t, d * (0.5 - 0.5 * cos(2 * pi() * (rn - 128 * s) / 256)) AS v FROM c, (SELECT unnest(range(0, 20)) AS s) WHERE rn >= 128 * s AND rn < 128 * s + 256 AND 128 * s + 256 <= n),
    ft AS (SELECT series_id, s, k, sum(v * cos(2 * pi() * k * t / 256)) AS re, sum(v * sin(2 * pi() * k * t / 256)) AS im FROM sg, (SELECT unnest(range(0, 129)) AS k) GROUP BY ALL),
    de AS (SELECT series_id, k / 256 AS f, avg(re * re + im * im) / (SELECT sum((0.5 - 0.5 * cos(2 * pi() * t / 256)) ** 2) FROM (SELECT unnest(range(0, 256)) AS t)) * CASE WHEN k BETWEEN 1 AND 127 THEN 2 ELSE 1 END AS p FROM ft GROUP BY series_id, k)"""
_WHOLE = """ft AS (SELECT series_id, k, any_value(n) AS n, sum(d * cos(2 * pi() * k * rn / n)) AS re, sum(d * sin(2 * pi() * k * rn / n)) AS im FROM c, (SELECT unnest(range(0, 1001)) AS k) WHERE 2 * k <= n GROUP BY ALL),
    de AS (SELECT series_id, k / n AS f, (re * re + im * im) / n * CASE WHEN k > 0 AND 2 * k < n THEN 2 ELSE 1 END AS p FROM ft)"""
_SPECTRAL = ("slope", "entropy", "flatness")


@query("spectral_features", _spectral_sql(_WELCH))
def spectral_features(spark, sf_dir):
    return series_kernels.spectral_features(eligible(spark, sf_dir)).withColumns({c: rounded(F.col(c)) for c in _SPECTRAL})


@query("periodogram_features", _spectral_sql(_WHOLE))
def periodogram_features(spark, sf_dir):
    return series_kernels.spectral_features(eligible(spark, sf_dir), method="periodogram").withColumns({c: rounded(F.col(c)) for c in _SPECTRAL})


@query(
    "periodogram",
    f"""WITH {PANEL_SQL.strip()}, c AS (SELECT series_id, rn, n, r - avg(r) OVER (PARTITION BY series_id) AS d FROM elig),
    f AS (SELECT series_id, k, any_value(n) AS n, sum(d * cos(2 * pi() * k * rn / n)) AS re, sum(d * sin(2 * pi() * k * rn / n)) AS im FROM c, (SELECT unnest(range(1, 33)) AS k) GROUP BY ALL)
    SELECT series_id, k::BIGINT AS k, round(k / n, 9) AS frequency, round(CASE WHEN 2 * k < n THEN 2 ELSE 1 END * (re * re + im * im) / n, 6) + 0.0 AS power FROM f WHERE 2 * k <= n""",
)
def periodogram(spark, sf_dir):
    """The 32 longest periods of every series."""
    rows = series_kernels.periodograms(eligible(spark, sf_dir)).where("k <= 32")
    return rows.select("series_id", "k", rounded(F.col("frequency"), 9).alias("frequency"), rounded(F.col("power")).alias("power"))


@query(
    "lz_complexity",
    f"""WITH RECURSIVE {PANEL_SQL.strip()}, md AS (SELECT series_id, median(r) AS m FROM elig GROUP BY series_id), st AS (SELECT e.series_id, string_agg(CASE WHEN r > m THEN '1' ELSE '0' END, '' ORDER BY rn) AS bits, count(*) AS n FROM elig e JOIN md USING (series_id) GROUP BY e.series_id),
    lz(series_id, pos, size, phrases) AS (SELECT series_id, 0, 1, 0 FROM st UNION ALL
      SELECT series_id, CASE WHEN seen THEN pos ELSE pos + size END, CASE WHEN seen THEN size + 1 ELSE 1 END, CASE WHEN seen THEN phrases ELSE phrases + 1 END
      FROM (SELECT lz.*, pos + size <= n AND contains(substr(bits, 1, (pos + size - 1)::BIGINT), substr(bits, (pos + 1)::BIGINT, size::BIGINT)) AS seen FROM lz JOIN st USING (series_id) WHERE pos < n))
    SELECT series_id, round(max(phrases) * log2(any_value(n)) / any_value(n), 6) + 0.0 AS lz, 'success' AS status FROM lz JOIN st USING (series_id) GROUP BY series_id""",
)
def lz_complexity(spark, sf_dir):
    return series_kernels.lempel_ziv(eligible(spark, sf_dir)).withColumn("lz", rounded(F.col("lz")))


@query(
    "delay_selection",
    f"""WITH {PANEL_SQL.strip()}, pr AS (SELECT a.series_id, k.lag, a.r AS a, b.r AS b FROM elig a JOIN (SELECT unnest(range(1, 51)) AS lag) k ON true JOIN elig b ON b.series_id = a.series_id AND b.rn = a.rn + k.lag),
    ex AS (SELECT series_id, lag, min(a) AS la, max(a) AS ha, min(b) AS lb, max(b) AS hb FROM pr GROUP BY ALL),
    ce AS (SELECT series_id, lag, least(floor((a - la) / (ha - la) * 24), 23) AS i, least(floor((b - lb) / (hb - lb) * 24), 23) AS j, count(*)::DOUBLE AS k FROM pr JOIN ex USING (series_id, lag) GROUP BY ALL),
    mg AS (SELECT *, sum(k) OVER (PARTITION BY series_id, lag) AS n, sum(k) OVER (PARTITION BY series_id, lag, i) AS ki, sum(k) OVER (PARTITION BY series_id, lag, j) AS kj FROM ce),
    mi AS (SELECT series_id, lag, sum(k / n * ln(k * n / (ki * kj))) AS m FROM mg GROUP BY ALL),
    lo AS (SELECT series_id, min(lag) AS delay FROM (SELECT *, lag(m) OVER w AS before, lead(m) OVER w AS after FROM mi WINDOW w AS (PARTITION BY series_id ORDER BY lag)) WHERE m < before AND m <= after GROUP BY series_id)
    SELECT series_id, delay::INTEGER AS delay, 'ami' AS method, 'success' AS status FROM lo""",
)
def delay_selection(spark, sf_dir):
    """The first minimum of mutual information over 50 lags, which every eligible series of the tables has."""
    return series_kernels.delays(eligible(spark, sf_dir))


@query(
    "sample_entropy",
    f"""WITH {PANEL_SQL.strip()}, t AS (SELECT series_id, rn, r AS a, lead(r, 1) OVER w AS b, lead(r, 2) OVER w AS c, 0.2 * stddev_samp(r) OVER (PARTITION BY series_id) AS tol FROM elig WINDOW w AS (PARTITION BY series_id ORDER BY rn)),
    p AS (SELECT x.series_id, greatest(abs(x.a - y.a), abs(x.b - y.b)) <= x.tol AS near2, x.c IS NOT NULL AND y.c IS NOT NULL AND greatest(abs(x.a - y.a), abs(x.b - y.b), abs(x.c - y.c)) <= x.tol AS near3
      FROM t x JOIN t y ON x.series_id = y.series_id AND x.rn < y.rn WHERE x.b IS NOT NULL AND y.b IS NOT NULL)
    SELECT series_id, round(-ln((count(*) FILTER (WHERE near3)) / (count(*) FILTER (WHERE near2))), 6) AS sampen, 'success' AS status FROM p GROUP BY series_id""",
)
def sample_entropy(spark, sf_dir):
    return series_kernels.sample_entropy(eligible(spark, sf_dir)).withColumn("sampen", rounded(F.col("sampen")))


@query("chaos_features")
def chaos_features(spark, sf_dir):
    return series_kernels.chaos_features(eligible(spark, sf_dir))


def chi2_sql(x: str, freedom: str) -> str:
    """The tail of a chi-squared statistic: one less the series of the lower incomplete gamma function."""
    return f"CASE WHEN {x} IS NOT NULL THEN greatest(1 - list_sum(list_transform(range(0, 600), lambda i: exp(({freedom} / 2 + i) * ln(greatest({x}, 1e-300) / 2) - {x} / 2 - lgamma({freedom} / 2 + i + 1)))), 0) END"


@query("ljung_box_p", panel_queries.SQL["ljung_box_stat"].replace('round(any_value(n)', '(any_value(n)').replace("(n - lag)), 5) AS q", "(n - lag))) AS q").replace('SELECT series_id, "order", (any_value', 'SELECT series_id, "order", round(q, 5) AS q, round(' + chi2_sql("q", '"order"') + ', 6) + 0.0 AS p FROM (SELECT series_id, "order", (any_value') + ")")
def ljung_box_p(spark, sf_dir):
    found = dependence.ljung_box(eligible(spark, sf_dir)).withColumn("p", series_kernels.chi2_tail("q", "order"))
    return found.select("series_id", "order", rounded(F.col("q"), 5).alias("q"), rounded(F.col("p")).alias("p"))


def _forecast(name: str, names: list[str], horizons: tuple[int, ...]):
    @query(name)
    def run(spark, sf_dir):
        return forecasts.task_metrics(series_kernels.forecast_tasks(eligible(spark, sf_dir), names, chosen("horizons", horizons), chosen("folds", returns.FOLDS)))


_forecast("ridge_forecast", ["naive_zero", "naive_mean", "ridge_lag"], (1, 5, 20))
_forecast("esn_forecast", ["esn", "chaotic_esn", "transient_chaotic_esn"], (1, 5, 20))
_forecast("mlp_forecast", ["vanilla_mlp", "chaotic_mlp", "chaotic_logistic_net"], (1, 5, 20))
_forecast("lstm_forecast", ["lstm_forecast", "chaotic_lstm_forecast"], (1, 5, 20))


@query("speed_summary")
def speed_summary(spark, sf_dir):
    return series_kernels.speed_summary(series_kernels.forecast_tasks(eligible(spark, sf_dir), ["naive_zero", "naive_mean", "ridge_lag"], chosen("horizons", (1, 5, 20)), chosen("folds", returns.FOLDS)))


def grid(spark, sf_dir, **how):
    """The whole grid of clusterings, or the stage's numbers of clusters and seed where they are set."""
    if chosen("k_min", None) or chosen("k_max", None):
        how["ks"] = ks()
    if seed := chosen("seed", None):
        how["seed"] = seed
    return series_kernels.cluster_grid(_vectors(spark, sf_dir), **how)


def _vectors(spark, sf_dir):
    return table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("point"), F.col("embedding").alias("vector"))


def _matrix(spark, sf_dir):
    return _vectors(spark, sf_dir).withColumn("vector", F.col("vector").cast("array<double>"))


@query("gmm_clusters")
def gmm_clusters(spark, sf_dir):
    return grid(spark, sf_dir, methods=("gmm",))


@query("ward_clusters")
def ward_clusters(spark, sf_dir):
    return grid(spark, sf_dir, methods=("ward",))


@query("cluster_grid_balance")
def cluster_grid_balance(spark, sf_dir):
    return clusters.balance(grid(spark, sf_dir).where("status = 'success'"))


@query("assignment_confidence")
def assignment_confidence(spark, sf_dir):
    return series_kernels.assignment_confidence(grid(spark, sf_dir, methods=("gmm",)))


@query("bootstrap_stability")
def bootstrap_stability(spark, sf_dir):
    """Refits of every space, method and number of clusters under robust scaling; the other scalers are a parameter."""
    return series_kernels.stability_summary(grid(spark, sf_dir, scalers=("robust",), bootstraps=chosen("bootstraps", 30)))


@query("mixtures_at_scale")
def mixtures_at_scale(spark, sf_dir):
    return series_kernels.mixtures_at_scale(_matrix(spark, sf_dir))


def _segments(spark, sf_dir):
    """Each fold's training returns as a series of its own."""
    from pyspark.sql import Window

    data = eligible(spark, sf_dir)
    splits = returns.split_metadata(returns.with_folds(returns.supervised(data, 5), chosen("folds", returns.FOLDS)))
    rows = returns.fold_segments(splits, data).select(F.concat_ws("|", "series_id", F.col("fold").cast("string")).alias("series_id"), "date", "r")
    own = Window.partitionBy("series_id")
    return rows.select("series_id", "r", (F.row_number().over(own.orderBy("date")) - 1).alias("rn"), F.count("*").over(own).alias("n"))


@query("fold_aware_features", f"""WITH {PANEL_SQL.strip()}, {_SPLITS.lstrip().removeprefix('+')}, seg AS (SELECT e.series_id || '|' || s.fold AS series_id, e.r, row_number() OVER (PARTITION BY e.series_id, s.fold ORDER BY e.date) - 1 AS rn FROM splits s JOIN elig e ON e.series_id = s.series_id AND e.date BETWEEN s.train_start AND s.train_end),
  {basic_sql('seg')} SELECT series_id, n_obs::BIGINT AS n_obs, """ + ", ".join(f"round({c}, 6) + 0.0 AS {c}" for c in BASIC) + " FROM bf")
def fold_aware_features(spark, sf_dir):
    b = shape.basic_features(_segments(spark, sf_dir))
    return b.select("series_id", "n_obs", *(rounded(F.col(c)).alias(c) for c in BASIC))


def _meta_rows(spark, sf_dir):
    s = series(spark, sf_dir)
    best = forecasts.winners(s.select("series_id", "horizon", "model", "rmse_mean"), "rmse_mean", ["series_id", "horizon"]).select("series_id", "horizon", F.col("model").alias("best"))
    wide = routing.task_matrix(s, forecasts.MODELS)
    features = shape.basic_features(eligible(spark, sf_dir)).na.fill(0.0)
    split = routing.hash_split(s.select("series_id").distinct(), test_share=3, seed=chosen("seed", 42))
    # a few rows for each series, which the learners read many times
    return stored(wide.join(best, ["series_id", "horizon"]).join(features, "series_id").join(split, "series_id"), "meta-rows")


@query("routing_classifier")
def routing_classifier(spark, sf_dir):
    return meta_models.route(_meta_rows(spark, sf_dir), BASIC, "logistic")


@query("routing_forest")
def routing_forest(spark, sf_dir):
    return meta_models.route(_meta_rows(spark, sf_dir), BASIC, "forest")


@query("routing_regression")
def routing_regression(spark, sf_dir):
    return meta_models.route_by_regression(_meta_rows(spark, sf_dir), BASIC, forecasts.MODELS)


@query("routing_boosted_classes")
def routing_boosted_classes(spark, sf_dir):
    return boosting.route_by_boosting(_meta_rows(spark, sf_dir), BASIC)


@query("ridge_tuning")
def ridge_tuning(spark, sf_dir):
    grid = {f"alpha_{a}": {"alpha": a} for a in (0.001, 0.1, 10.0)}
    return series_kernels.best_candidates(series_kernels.tune(eligible(spark, sf_dir), "ridge_lag", grid))


@query("permuted_target_ratio")
def permuted_target_ratio(spark, sf_dir):
    return series_kernels.permuted_target_ratio(eligible(spark, sf_dir), least_ratio=chosen("least_ratio", 1.05))


_PLACES = ", ".join(supervised_sql(h, w) for h, w in ((1, 64), (5, 32), (20, 16)))


@query(
    "window_alignment",
    f"""WITH {PANEL_SQL.strip()}, {_PLACES}, vall AS (SELECT series_id, horizon, i, m, rn FROM v1 UNION ALL SELECT series_id, horizon, i, m, rn FROM v5 UNION ALL SELECT series_id, horizon, i, m, rn FROM v20), {folds_sql("SELECT * FROM vall", "fd")},
    st AS (SELECT series_id, horizon, fold, min(rn) AS start FROM fd WHERE part = 'test' GROUP BY ALL)
    SELECT horizon, fold::INTEGER AS fold, count(*)::BIGINT AS n_windows, 0::BIGINT AS n_leaks, 0::BIGINT AS n_misaligned, (count(*) FILTER (WHERE part = 'train' AND rn + horizon >= start + 1))::BIGINT AS n_overlapping_targets
    FROM fd JOIN st USING (series_id, horizon, fold) GROUP BY ALL""",
)
def window_alignment(spark, sf_dir):
    return leakage.window_alignment(eligible(spark, sf_dir), folds=chosen("folds", returns.FOLDS))


@query("row_order_invariance")
def row_order_invariance(spark, sf_dir):
    return leakage.row_order_invariance(eligible(spark, sf_dir))


@query("principal_scores")
def principal_scores(spark, sf_dir):
    return moments.principal_scores(_matrix(spark, sf_dir))


_TARGETS = forecasts.MODELS
_RIDGE = f"""{_SERIES}, {basic_sql("elig")}, mx AS (SELECT s.series_id, s.horizon, f.skew AS x1, f.zero_crossing_rate AS x2, """ + ", ".join(f"max(s.rmse_mean) FILTER (WHERE s.model = '{t}') AS {t}" for t in _TARGETS) + """ FROM sm s JOIN bf f USING (series_id) GROUP BY ALL),
  mo AS (SELECT avg(x1) AS m1, avg(x2) AS m2, regr_sxx(x1, x1) AS s11, regr_sxx(x2, x2) AS s22, regr_sxy(x1, x2) AS s12 FROM mx),
  yo AS (""" + " UNION ALL ".join(f"SELECT '{t}' AS target, avg({t}) AS my, regr_sxy({t}, x1) AS c1, regr_sxy({t}, x2) AS c2 FROM mx" for t in _TARGETS) + """),
  sv AS (SELECT alpha, target, ((s22 + alpha) * c1 - s12 * c2) / ((s11 + alpha) * (s22 + alpha) - s12 * s12) AS w1, ((s11 + alpha) * c2 - s12 * c1) / ((s11 + alpha) * (s22 + alpha) - s12 * s12) AS w2, m1, m2, my FROM mo, yo, (VALUES (0.1::DOUBLE), (1.0), (10.0)) a(alpha))
  SELECT alpha, target, 'skew' AS feature, round(w1, 6) + 0.0 AS coefficient FROM sv UNION ALL SELECT alpha, target, 'zero_crossing_rate', round(w2, 6) + 0.0 FROM sv UNION ALL SELECT alpha, target, '(intercept)', round(my - w1 * m1 - w2 * m2, 6) + 0.0 FROM sv"""


@query("multi_ridge_coefficients", _RIDGE)
def multi_ridge_coefficients(spark, sf_dir):
    """Every model's error on two features of the series, for three penalties, from one aggregation."""
    rows = _meta_rows(spark, sf_dir)
    return moments.fit_multi_ridge(rows, ["skew", "zero_crossing_rate"], _TARGETS, (0.1, 1.0, 10.0)).table(spark).withColumn("coefficient", rounded(F.col("coefficient")))


@query("routing_multi_ridge")
def routing_multi_ridge(spark, sf_dir):
    return moments.route_by_multi_ridge(_meta_rows(spark, sf_dir), BASIC, forecasts.MODELS)


_ACTIVE, _SUPPORTED = ["naive_zero", "naive_mean", "ridge_lag", "esn"], ["chaotic_esn", "vanilla_mlp", "lstm_forecast"]


_REGISTERED = ", ".join(f"('{m}', '{'active' if m in _ACTIVE else 'inactive_but_supported' if m in _SUPPORTED else 'registered_not_selected'}')" for m in sorted(models.REGISTRY))


@query("registry_table", f"""{_SERIES}, ta AS (SELECT sum(n_folds)::BIGINT AS n FROM sm WHERE model = 'naive_zero') SELECT t.model, t.status, CASE WHEN t.status = 'active' THEN ta.n ELSE 0 END AS n_tasks FROM (VALUES {_REGISTERED}) t(model, status), ta""")
def registry_table(spark, sf_dir):
    """Every registered model's part in a benchmark of the eligible series, and the tasks that it has there."""
    planned = benchmark.tasks_of(eligible(spark, sf_dir), benchmark.Benchmark(_ACTIVE)).groupBy("model").agg(F.count("*").alias("n_tasks"))
    return series_kernels.registry_table(spark, _ACTIVE, _SUPPORTED).join(planned, "model", "left").na.fill(0, ["n_tasks"])
