"""Queries over forecasts of the eligible series: measures, rankings, analysis by cluster, routing and tuning tables."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions.columns import rounded
from ..operators import by_cluster, catalog, forecasts, returns, routing
from ..settings import chosen
from ..sources.shared import stored
from .panel_queries import PANEL_SQL, eligible, folds_sql, supervised_sql

QUERIES: dict = {}
SQL: dict[str, str] = {}

_FOLDED = ", ".join(supervised_sql(h, w) for h, w in ((1, 64), (5, 32), (20, 16)))
_PREDICTED = f"""WITH {PANEL_SQL.strip()}, {_FOLDED}, vall AS (SELECT series_id, market, date, horizon, i, m, y, last FROM v1 UNION ALL SELECT series_id, market, date, horizon, i, m, y, last FROM v5 UNION ALL SELECT series_id, market, date, horizon, i, m, y, last FROM v20),
  {folds_sql("SELECT * FROM vall", "fd")},
  tr AS (SELECT series_id, horizon, fold, avg(y) AS train_mean, avg(y) FILTER (WHERE i < train_n - greatest(1, floor(train_n * 0.2))) AS fit_mean, avg(step) AS train_step
    FROM (SELECT *, abs(y - lag(y) OVER (PARTITION BY series_id, horizon, fold ORDER BY i)) AS step FROM fd WHERE part = 'train') GROUP BY ALL),
  pd AS (SELECT f.series_id, f.market, f.horizon, f.fold, f.i, f.y, t.train_mean, t.train_step, k.model, CASE k.model WHEN 'naive_zero' THEN 0 WHEN 'naive_mean' THEN t.fit_mean ELSE f.last END AS p
    FROM fd f JOIN tr t ON f.series_id = t.series_id AND f.horizon = t.horizon AND f.fold = t.fold, (VALUES ('naive_zero'), ('naive_mean'), ('naive_last')) k(model) WHERE f.part = 'test')"""
_TASKS = _PREDICTED + """, tk AS (SELECT series_id, horizon, model, fold, count(*) AS n_test, avg(abs(y - p)) AS mae, avg((y - p) * (y - p)) AS mse, sqrt(avg((y - p) * (y - p))) AS rmse, avg(abs(y - p)) / nullif(any_value(train_step), 0) AS mase,
    100 * avg(abs((y - p) / y)) FILTER (WHERE abs(y) > 1e-12) AS mape, 100 * avg(2 * abs(y - p) / (abs(y) + abs(p))) FILTER (WHERE abs(y) + abs(p) > 1e-12) AS smape,
    avg(0.5 * least(abs(y - p), 1) * least(abs(y - p), 1) + abs(y - p) - least(abs(y - p), 1)) AS huber, avg((sign(y) = sign(p))::INTEGER) AS directional_accuracy, median(abs(y - p)) AS medae, avg(p - y) AS bias,
    CASE WHEN count(*) > 1 THEN 1 - sum((y - p) * (y - p)) / nullif(var_pop(y) * count(*), 0) END AS r2, 1 - sum((y - p) * (y - p)) / nullif(sum((y - train_mean) * (y - train_mean)), 0) AS r2_oos FROM pd GROUP BY ALL)"""
_MEANS = ", ".join(f"avg({m}) AS {m}_mean, median({m}) AS {m}_median, stddev_pop({m}) AS {m}_std" for m in forecasts.METRICS)
_SERIES = _TASKS + f", sm AS (SELECT series_id, horizon, model, count(*) AS n_folds, {_MEANS} FROM tk GROUP BY ALL)"
_ASSIGN = """, asg AS (SELECT series_id, 'market' AS config, CASE market WHEN 'US' THEN 1 ELSE 0 END AS cluster FROM (SELECT DISTINCT series_id, market FROM elig)
    UNION ALL SELECT series_id, 'hash', (('0x' || substr(md5(series_id), 1, 4))::INTEGER % 3)::INTEGER FROM (SELECT DISTINCT series_id FROM elig))"""
_PERF = _SERIES + _ASSIGN + """, pf AS (SELECT config, cluster, horizon, model, count(DISTINCT s.series_id) AS n_series, """ + ", ".join(f"avg({m}_mean) AS {m}_mean, median({m}_mean) AS {m}_median" for m in ("mae", "rmse", "mase", "directional_accuracy")) + " FROM sm s JOIN asg USING (series_id) GROUP BY ALL)"


def query(name: str, sql: str):
    def add(f):
        QUERIES[name] = f
        SQL[name] = sql
        return f

    return add


def r(c: str, digits: int = 6) -> str:
    return f"round({c}, {digits}) + 0.0 AS {c}"


def rr(*names: str, digits: int = 6):
    return [rounded(F.col(c), digits).alias(c) for c in names]


def folded(spark, sf_dir):
    return forecasts.folded_targets(eligible(spark, sf_dir), chosen("horizons", (1, 5, 20)), chosen("folds", returns.FOLDS))


def predictions(spark, sf_dir):
    return forecasts.naive_predictions(folded(spark, sf_dir))


def tasks(spark, sf_dir):
    """Measures of every task, stored: they are few rows, and most queries read them several times."""
    return stored(forecasts.task_metrics(predictions(spark, sf_dir)), "tasks")


def series(spark, sf_dir):
    return forecasts.series_metrics(tasks(spark, sf_dir))


def assignments(spark, sf_dir):
    """Two clusterings of the eligible series: by market, and by a hash of the id."""
    ids = eligible(spark, sf_dir).select("series_id", "market").distinct()
    number = F.conv(F.substring(F.md5("series_id"), 1, 4), 16, 10).cast("int")
    by_market = ids.select("series_id", F.lit("market").alias("config"), F.when(F.col("market") == "US", 1).otherwise(0).alias("cluster"))
    return by_market.unionByName(ids.select("series_id", F.lit("hash").alias("config"), (number % 3).alias("cluster")))


def performance(spark, sf_dir):
    return by_cluster.performance(series(spark, sf_dir), assignments(spark, sf_dir))


@query("naive_predictions", _PREDICTED + " SELECT series_id, horizon, model, fold, i::BIGINT AS i, round(y, 6) + 0.0 AS y, round(p, 6) + 0.0 AS prediction FROM pd")
def naive_predictions(spark, sf_dir):
    return predictions(spark, sf_dir).select("series_id", "horizon", "model", "fold", F.col("i").cast("long").alias("i"), *rr("y", "prediction"))


#: Means of ratios to y itself reach millions where y is nearly zero; they are compared with fewer digits.
_DIGITS = {"mape": 2}


@query("fold_metrics", _TASKS + " SELECT series_id, horizon, model, fold, n_test::BIGINT AS n_test, " + ", ".join(r(m, _DIGITS.get(m, 6)) for m in forecasts.METRICS) + " FROM tk")
def fold_metrics(spark, sf_dir):
    return tasks(spark, sf_dir).select(*forecasts.TASK, "n_test", *(rounded(F.col(m), _DIGITS.get(m, 6)).alias(m) for m in forecasts.METRICS))


_KEPT = [f"{m}_{n}" for m in ("mae", "rmse", "mase", "directional_accuracy", "r2_oos", "bias") for n in ("mean", "median", "std")]


@query("series_metrics", _SERIES + " SELECT series_id, horizon, model, n_folds::BIGINT AS n_folds, " + ", ".join(r(c) for c in _KEPT) + " FROM sm")
def series_metrics(spark, sf_dir):
    return series(spark, sf_dir).select("series_id", "horizon", "model", "n_folds", *rr(*_KEPT))


_SUMMARY = {"mean": "avg({0})", "std": "stddev_pop({0})", "var": "var_pop({0})", "median": "median({0})", "q25": "quantile_cont({0}, .25)", "q75": "quantile_cont({0}, .75)"}


@query("model_summary", _TASKS + " SELECT model, horizon, count(*)::BIGINT AS n_tasks, " + ", ".join(f"round({f.format(m)}, 6) + 0.0 AS {m}_{n}" for m in ("rmse", "directional_accuracy") for n, f in _SUMMARY.items()) + " FROM tk GROUP BY ALL")
def model_summary(spark, sf_dir):
    s = forecasts.model_summary(tasks(spark, sf_dir))
    return s.select("model", "horizon", "n_tasks", *rr(*(f"{m}_{n}" for m in ("rmse", "directional_accuracy") for n in _SUMMARY)))


@query("model_ranking", _TASKS + ", mm AS (SELECT horizon, model, avg(rmse) AS mean FROM tk GROUP BY ALL) SELECT horizon, model, round(mean, 6) AS mean, (row_number() OVER (PARTITION BY horizon ORDER BY round(mean, 12), model))::INTEGER AS place FROM mm")
def model_ranking(spark, sf_dir):
    return forecasts.model_ranking(tasks(spark, sf_dir)).withColumn("mean", rounded(F.col("mean")))


@query("winners_by_horizon", _TASKS + ", mm AS (SELECT horizon, model, round(avg(directional_accuracy), 9) AS mean FROM tk GROUP BY ALL), nn AS (SELECT *, row_number() OVER (PARTITION BY horizon ORDER BY mean DESC, model) AS nth FROM mm) SELECT horizon, model, round(mean, 6) AS mean FROM nn WHERE nth = 1")
def winners_by_horizon(spark, sf_dir):
    means = tasks(spark, sf_dir).groupBy("horizon", "model").agg(F.round(F.avg("directional_accuracy"), 9).alias("mean"))
    return forecasts.winners(means, "mean", ["horizon"], ascending=False).withColumn("mean", rounded(F.col("mean")))


_WINS = """, ww AS (SELECT horizon, model, row_number() OVER (PARTITION BY series_id, horizon ORDER BY rmse_mean, model) AS nth FROM sm), wc AS (SELECT horizon, model, count(*) FILTER (WHERE nth = 1) AS wins FROM ww GROUP BY ALL)"""


@query("model_wins", _SERIES + _WINS + " SELECT horizon, model, wins::BIGINT AS wins, round(wins / sum(wins) OVER (PARTITION BY horizon), 6) AS share FROM wc")
def model_wins(spark, sf_dir):
    return forecasts.model_wins(series(spark, sf_dir)).withColumn("share", rounded(F.col("share")))


@query("coverage_by_model", _TASKS + " SELECT model, horizon, count(DISTINCT series_id)::BIGINT AS observed, min(fold)::INTEGER AS fold_min, max(fold)::INTEGER AS fold_max, (count(*) FILTER (WHERE rmse IS NULL))::BIGINT AS n_missing, (SELECT count(*) FROM cat)::BIGINT - count(DISTINCT series_id)::BIGINT AS lacking FROM tk GROUP BY ALL")
def coverage_by_model(spark, sf_dir):
    from ..sources.panels import price_panel

    return forecasts.coverage(tasks(spark, sf_dir), price_panel(spark, sf_dir).select("series_id"))


@query("coverage_anti_join", _SERIES + " SELECT series_id FROM cat WHERE series_id NOT IN (SELECT series_id FROM sm)")
def coverage_anti_join(spark, sf_dir):
    from ..sources.panels import price_panel

    return price_panel(spark, sf_dir).select("series_id").distinct().join(series(spark, sf_dir), "series_id", "left_anti")


_PERF_COLUMNS = [f"{m}_{n}" for m in ("mae", "rmse", "mase", "directional_accuracy") for n in ("mean", "median")]


@query("cluster_model_perf", _PERF + " SELECT config, cluster::INTEGER AS cluster, horizon, model, n_series::BIGINT AS n_series, " + ", ".join(r(c) for c in _PERF_COLUMNS) + " FROM pf")
def cluster_model_perf(spark, sf_dir):
    return performance(spark, sf_dir).select("config", "cluster", "horizon", "model", "n_series", *rr(*_PERF_COLUMNS))


@query("relative_to_baseline", _PERF + """, rb AS (SELECT a.*, b.rmse_mean AS base FROM pf a LEFT JOIN pf b ON a.config = b.config AND a.cluster = b.cluster AND a.horizon = b.horizon AND b.model = 'naive_zero')
  SELECT config, cluster::INTEGER AS cluster, horizon, model, round(rmse_mean - base, 6) + 0.0 AS difference, round(rmse_mean / base, 6) AS ratio FROM rb""")
def relative_to_baseline(spark, sf_dir):
    return by_cluster.relative_to_baseline(performance(spark, sf_dir), chosen("baseline", "naive_zero")).select("config", "cluster", "horizon", "model", *rr("difference", "ratio"))


@query("best_model_by_cluster", _PERF + " SELECT config, cluster::INTEGER AS cluster, horizon, " + ", ".join(f"first(model ORDER BY round({m}_mean, 12), model) AS best_{m}" for m in ("mae", "rmse", "mase")) + ", first(model ORDER BY round(directional_accuracy_mean, 12) DESC, model) AS best_directional_accuracy FROM pf GROUP BY config, cluster, horizon")
def best_model_by_cluster(spark, sf_dir):
    return by_cluster.best_by_cluster(performance(spark, sf_dir))


@query(
    "clustering_utility",
    _PERF + """, c0 AS (SELECT config, cluster, horizon, model, n_series, round(rmse_mean, 12) AS cost FROM pf), gl AS (SELECT config, horizon, model, sum(cost * n_series) / sum(n_series) AS cost FROM c0 GROUP BY ALL),
  gb AS (SELECT config, horizon, first(model ORDER BY round(cost, 12), model) AS global_best, min(cost) AS global_score FROM gl GROUP BY ALL),
  cb0 AS (SELECT *, row_number() OVER (PARTITION BY config, cluster, horizon ORDER BY cost, model) AS nth, rank() OVER (PARTITION BY config, cluster, horizon ORDER BY cost) + (count(*) OVER (PARTITION BY config, cluster, horizon, cost) - 1) / 2.0 AS rk FROM c0),
  cb AS (SELECT config, horizon, sum(cost * n_series) / sum(n_series) AS cluster_score, count(DISTINCT model) AS n_best_models FROM cb0 WHERE nth = 1 GROUP BY ALL),
  rv AS (SELECT config, horizon, avg(v) AS rank_variance FROM (SELECT config, horizon, model, var_pop(rk) AS v FROM cb0 GROUP BY ALL) GROUP BY ALL)
  SELECT config, horizon, global_best, round(global_score, 6) AS global_score, round(cluster_score, 6) AS cluster_score, round(global_score - cluster_score, 6) + 0.0 AS regret_improvement, n_best_models::BIGINT AS n_best_models, round(rank_variance, 6) + 0.0 AS rank_variance
  FROM gb JOIN cb USING (config, horizon) JOIN rv USING (config, horizon)""",
)
def clustering_utility(spark, sf_dir):
    u = by_cluster.utility(performance(spark, sf_dir))
    return u.select("config", "horizon", "global_best", "n_best_models", *rr("global_score", "cluster_score", "regret_improvement", "rank_variance"))


@query(
    "kruskal_h",
    _SERIES + _ASSIGN + """, k0 AS (SELECT config, cluster, model, horizon, round(rmse_mean, 12) AS v FROM sm JOIN asg USING (series_id)),
  k1 AS (SELECT *, rank() OVER (PARTITION BY config, model, horizon ORDER BY v) + (count(*) OVER (PARTITION BY config, model, horizon, v) - 1) / 2.0 AS rk FROM k0),
  kt AS (SELECT config, model, horizon, sum(t * t * t - t) AS tied FROM (SELECT config, model, horizon, v, count(*) AS t FROM k0 GROUP BY ALL) GROUP BY ALL),
  k2 AS (SELECT config, model, horizon, cluster, sum(rk) AS r, count(*) AS k FROM k1 GROUP BY ALL), k3 AS (SELECT config, model, horizon, sum(r * r / k) AS s, sum(k)::DOUBLE AS n, count(*) AS n_clusters FROM k2 GROUP BY ALL)
  SELECT config, model, horizon, n_clusters::BIGINT AS n_clusters, round((12 / (n * (n + 1)) * s - 3 * (n + 1)) / (1 - tied / (n * n * n - n)), 6) + 0.0 AS h FROM k3 JOIN kt USING (config, model, horizon) WHERE n_clusters > 1""",
)
def kruskal_h(spark, sf_dir):
    return by_cluster.kruskal_h(series(spark, sf_dir), assignments(spark, sf_dir)).withColumn("h", rounded(F.col("h")))


@query("task_pivot", _SERIES + " SELECT series_id, horizon, " + ", ".join(f"round(avg(rmse_mean) FILTER (WHERE model = '{m}'), 6) AS {m}" for m in forecasts.MODELS) + " FROM sm GROUP BY ALL")
def task_pivot(spark, sf_dir):
    return routing.task_matrix(series(spark, sf_dir), forecasts.MODELS).select("series_id", "horizon", *rr(*forecasts.MODELS))


def _candidates(rows: str, order: str) -> str:
    return f""", q0 AS ({rows}), q1 AS (SELECT series_id, horizon, model, round(rmse_mean, 12) AS cost FROM q0), qw AS (SELECT horizon, model, count(*) FILTER (WHERE nth = 1) AS wins FROM (SELECT *, row_number() OVER (PARTITION BY series_id, horizon ORDER BY cost, model) AS nth FROM q1) GROUP BY ALL),
  qm AS (SELECT horizon, model, avg(cost) AS mean, min(avg(cost)) OVER (PARTITION BY horizon) AS best FROM q1 GROUP BY horizon, model), qg AS (SELECT *, mean - best AS gap, CASE WHEN (mean - best) / greatest(abs(best), 1e-12) <= 0.05 THEN 1 ELSE 0 END AS close FROM qm JOIN qw USING (horizon, model)),
  qp AS (SELECT *, row_number() OVER (PARTITION BY horizon ORDER BY {order}round(gap, 12), wins DESC, model) AS place FROM qg) SELECT horizon, model, place::INTEGER AS place, wins::BIGINT AS wins, round(mean, 6) AS mean, round(gap, 6) + 0.0 AS gap FROM qp WHERE place <= 2"""


_SPLIT = ", spl AS (SELECT DISTINCT series_id, CASE WHEN ('0x' || substr(md5(series_id || ':42'), 1, 8))::BIGINT % 5 = 0 THEN 'test' ELSE 'train' END AS split FROM sm)"


@query("candidate_sets", _SERIES + _candidates("SELECT * FROM sm", "close DESC, "))
def candidate_sets(spark, sf_dir):
    return routing.candidate_sets(series(spark, sf_dir), top=2).select("horizon", "model", "place", "wins", *rr("mean", "gap"))


@query("candidate_sets_train_only", _SERIES + _SPLIT + _candidates("SELECT sm.* FROM sm JOIN spl USING (series_id) WHERE split = 'train'", ""))
def candidate_sets_train_only(spark, sf_dir):
    s = series(spark, sf_dir)
    train = s.join(routing.hash_split(s.select("series_id").distinct()).where("split = 'train'"), "series_id", "left_semi")
    return routing.candidate_sets(train, top=2, tolerance=None).select("horizon", "model", "place", "wins", *rr("mean", "gap"))


@query(
    "best_single_global",
    _SERIES + _SPLIT + """, bt AS (SELECT horizon, model, avg(rmse_mean) AS m FROM sm JOIN spl USING (series_id) WHERE split = 'train' GROUP BY ALL), bb AS (SELECT horizon, first(model ORDER BY round(m, 12), model) AS best_model FROM bt GROUP BY horizon),
  te AS (SELECT sm.* FROM sm JOIN spl USING (series_id) WHERE split = 'test'), bo AS (SELECT horizon, avg(v) AS oracle, count(*) AS n_test FROM (SELECT horizon, series_id, min(rmse_mean) AS v FROM te GROUP BY ALL) GROUP BY horizon),
  ba AS (SELECT te.horizon, best_model, avg(rmse_mean) AS achieved FROM te JOIN bb ON te.horizon = bb.horizon AND te.model = bb.best_model GROUP BY ALL)
  SELECT horizon, best_model, n_test::BIGINT AS n_test, round(achieved, 6) AS achieved, round(oracle, 6) AS oracle, round(achieved - oracle, 6) + 0.0 AS regret FROM ba JOIN bo USING (horizon)""",
)
def best_single_global(spark, sf_dir):
    s = series(spark, sf_dir)
    best = routing.best_single(s, routing.hash_split(s.select("series_id").distinct()))
    return best.select("horizon", "best_model", "n_test", *rr("achieved", "oracle", "regret"))


@query("oracle_regret", _SERIES + ", lo AS (SELECT *, min(rmse_mean) OVER (PARTITION BY series_id, horizon) AS least FROM sm) SELECT horizon, model, round(avg(rmse_mean), 6) AS mean, round(avg(least), 6) AS oracle, round(avg(rmse_mean) - avg(least), 6) + 0.0 AS regret, round(avg((rmse_mean <= least)::INTEGER), 6) AS hit_rate FROM lo GROUP BY ALL")
def oracle_regret(spark, sf_dir):
    return routing.oracle_regret(series(spark, sf_dir)).select("horizon", "model", *rr("mean", "oracle", "regret", "hit_rate"))


# A routing rule to judge: choose by the hash of the series, with a confidence from another part of it.
_CHOICES = _SERIES + """, bs AS (SELECT series_id, horizon, first(model ORDER BY rmse_mean, model) AS truth FROM sm GROUP BY ALL),
  chx AS (SELECT series_id, horizon, truth, ['naive_last', 'naive_mean', 'naive_zero'][(('0x' || substr(md5(series_id), 1, 4))::INTEGER % 3) + 1] AS predicted, (('0x' || substr(md5(series_id), 5, 4))::INTEGER % 100) / 100.0::DOUBLE AS confidence, 'naive_zero' AS baseline FROM bs),
  chc AS (SELECT *, CASE WHEN confidence >= 0.5 THEN predicted ELSE baseline END AS chosen FROM chx)"""


def _choices(spark, sf_dir):
    best = forecasts.winners(series(spark, sf_dir).select("series_id", "horizon", "model", "rmse_mean"), "rmse_mean", ["series_id", "horizon"])
    number = lambda at: F.conv(F.substring(F.md5("series_id"), at, 4), 16, 10).cast("int")
    said = F.element_at(F.array(*(F.lit(m) for m in forecasts.MODELS)), number(1) % 3 + 1)
    rows = best.select("series_id", "horizon", F.col("model").alias("truth"), said.alias("predicted"), ((number(5) % 100) / 100.0).alias("confidence"), F.lit("naive_zero").alias("baseline"))
    return routing.confidence_fallback(rows, 0.5)


@query("confidence_fallback", _CHOICES + " SELECT series_id, horizon, truth, predicted, confidence, baseline, chosen FROM chc")
def confidence_fallback(spark, sf_dir):
    return _choices(spark, sf_dir)


@query("confusion_matrix", _CHOICES + " SELECT truth, chosen AS predicted, count(*)::BIGINT AS n FROM chc GROUP BY ALL")
def confusion_matrix(spark, sf_dir):
    return routing.confusion(_choices(spark, sf_dir).select("truth", F.col("chosen").alias("predicted")))


_CLASSES = _CHOICES + """, lb AS (SELECT truth AS label FROM chc UNION SELECT chosen FROM chc), pc AS (SELECT label, (SELECT count(*) FROM chc WHERE truth = label) AS support, (SELECT count(*) FROM chc WHERE chosen = label) AS said, (SELECT count(*) FROM chc WHERE truth = label AND chosen = label) AS hits FROM lb),
  pr AS (SELECT label, support, coalesce(hits / nullif(said, 0), 0) AS precision, coalesce(hits / nullif(support, 0), 0) AS recall FROM pc), f1 AS (SELECT *, coalesce(2 * precision * recall / nullif(precision + recall, 0), 0) AS f1 FROM pr)"""


@query("per_class_f1", _CLASSES + " SELECT label, support::BIGINT AS support, round(precision, 6) AS precision, round(recall, 6) AS recall, round(f1, 6) AS f1 FROM f1")
def per_class_f1(spark, sf_dir):
    s = routing.class_scores(_choices(spark, sf_dir).select("truth", F.col("chosen").alias("predicted")))
    return s.select("label", "support", *rr("precision", "recall", "f1"))


@query("routing_evaluation", _CLASSES + " SELECT round(sum(recall * support) / sum(support), 6) AS accuracy, round(avg(recall) FILTER (WHERE support > 0), 6) AS balanced_accuracy, round(avg(f1), 6) AS macro_f1, round(sum(f1 * support) / sum(support), 6) AS weighted_f1 FROM f1")
def routing_evaluation(spark, sf_dir):
    e = routing.evaluation(_choices(spark, sf_dir).select("truth", F.col("chosen").alias("predicted")))
    return e.select(*rr("accuracy", "balanced_accuracy", "macro_f1", "weighted_f1"))


@query("resume_upsert", _TASKS + """, un AS (SELECT series_id, horizon, model, fold, rmse, 0 AS src FROM tk WHERE fold <= 2 UNION ALL SELECT series_id, horizon, model, fold, rmse + 1, 1 FROM tk WHERE fold >= 2),
  ur AS (SELECT *, row_number() OVER (PARTITION BY series_id, horizon, model, fold ORDER BY src DESC) AS nth FROM un) SELECT series_id, horizon, model, fold, round(rmse, 6) AS rmse FROM ur WHERE nth = 1""")
def resume_upsert(spark, sf_dir):
    t = tasks(spark, sf_dir).select(*forecasts.TASK, "rmse")
    merged = catalog.resume_upsert(t.where("fold <= 2"), t.where("fold >= 2").withColumn("rmse", F.col("rmse") + 1), forecasts.TASK, "fold")
    return merged.withColumn("rmse", rounded(F.col("rmse")))


@query("candidate_best", _SERIES + ", cd AS (SELECT model, avg(mae_mean) AS mae, count(*) AS n FROM sm GROUP BY model) SELECT split_part(model, '_', 1) AS family, first(model ORDER BY round(mae, 12), model) AS best, round(min(mae), 6) AS mae, sum(n)::BIGINT AS n_tasks FROM cd GROUP BY family")
def candidate_best(spark, sf_dir):
    each = series(spark, sf_dir).groupBy("model").agg(F.avg("mae_mean").alias("mae"), F.count("*").alias("n"))
    family = F.split_part("model", F.lit("_"), F.lit(1)).alias("family")
    return each.groupBy(family).agg(F.min_by("model", F.struct(F.round("mae", 12), "model")).alias("best"), rounded(F.min("mae")).alias("mae"), F.sum("n").alias("n_tasks"))


@query("pair_comparison", _SERIES + """, pv AS (SELECT series_id, horizon, max(rmse_mean) FILTER (WHERE model = 'naive_zero') AS base, max(rmse_mean) FILTER (WHERE model = 'naive_mean') AS other FROM sm GROUP BY ALL)
  SELECT horizon, count(*)::BIGINT AS n, round(avg(other - base), 6) + 0.0 AS mean_difference, round(median(other - base), 6) + 0.0 AS median_difference, round(avg((other < base)::INTEGER), 6) AS share_better FROM pv GROUP BY horizon""")
def pair_comparison(spark, sf_dir):
    wide = routing.task_matrix(series(spark, sf_dir), ["naive_mean", "naive_zero"])
    gap = F.col("naive_mean") - F.col("naive_zero")
    return wide.groupBy("horizon").agg(F.count("*").alias("n"), rounded(F.avg(gap)).alias("mean_difference"), rounded(F.median(gap)).alias("median_difference"), rounded(F.avg(F.when(gap < 0, 1.0).otherwise(0.0))).alias("share_better"))


@query("winner_distribution", _SERIES + _WINS + ", wd AS (SELECT horizon, max(wins) AS top, sum(wins) AS n FROM wc GROUP BY horizon) SELECT horizon, n::BIGINT AS n, round(top / n, 6) AS majority_share FROM wd")
def winner_distribution(spark, sf_dir):
    w = forecasts.model_wins(series(spark, sf_dir)).groupBy("horizon").agg(F.sum("wins").alias("n"), F.max("wins").alias("top"))
    return w.select("horizon", "n", rounded(F.col("top") / F.col("n")).alias("majority_share"))
