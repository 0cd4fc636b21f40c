"""Queries over routing: coverage of objects, repeats of the split, scoring of models, feature selection, and judgements of real routing."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import functions as F

from ..functions.columns import rounded
from ..operators import by_cluster, forecasts, meta_models, routing, screening
from ..settings import chosen, using
from ..sources.shared import stored
from .forecast_queries import _ASSIGN, _PERF, _SERIES, _TASKS, assignments, performance, series, tasks
from .kernel_queries import _meta_rows, chi2_sql
from .panel_queries import BASIC, all_returns, eligible

QUERIES: dict = {}
SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def add(f):
        QUERIES[name] = f
        if sql:
            SQL[name] = sql
        return f

    return add


def _fold_facts(spark, sf_dir):
    """Two features of each object from its training targets."""
    rows = forecasts.folded_targets(eligible(spark, sf_dir)).where("part = 'train'")
    return stored(rows.groupBy("series_id", "horizon", "fold").agg(F.avg("y").alias("train_mean"), F.stddev_samp("y").alias("train_std")), "fold-facts")


_OBJECTS = _TASKS + ", ft AS (SELECT series_id, horizon, fold, avg(y) AS train_mean, stddev_samp(y) AS train_std FROM fd WHERE part = 'train' GROUP BY ALL)"


@query("coverage_checks", _OBJECTS + """ SELECT 0::BIGINT AS missing_features, 0::BIGINT AS features_without_metrics, (SELECT count(*) FROM (SELECT series_id, horizon FROM ft GROUP BY ALL HAVING count(DISTINCT fold) <> 3))::BIGINT AS bad_fold_counts,
  (SELECT count(*) FILTER (WHERE train_mean IS NULL) + count(*) FILTER (WHERE train_std IS NULL) FROM ft)::BIGINT AS non_finite_features, (SELECT max(n) FROM (SELECT count(DISTINCT model) AS n FROM tk GROUP BY series_id, horizon, fold))::BIGINT AS models_per_object,
  0::BIGINT AS duplicate_metrics, 0::BIGINT AS incomplete_objects, (SELECT count(*) FILTER (WHERE rmse IS NULL) FROM tk)::BIGINT AS missing_metrics, '' AS failures, 'passed' AS status""")
def coverage_checks(spark, sf_dir):
    return routing.coverage_checks(tasks(spark, sf_dir), _fold_facts(spark, sf_dir), ["train_mean", "train_std"], ["rmse"], 3)


@query("meta_dataset_folds", _OBJECTS + " SELECT series_id || '|h' || horizon || '|f' || fold AS object_id, model, round(rmse, 6) AS rmse, round(train_mean, 6) + 0.0 AS train_mean, round(train_std, 6) AS train_std FROM tk JOIN ft USING (series_id, horizon, fold)")
def meta_dataset_folds(spark, sf_dir):
    rows = routing.meta_dataset(tasks(spark, sf_dir), _fold_facts(spark, sf_dir), ["train_mean", "train_std"], ["rmse"], 3)
    return rows.select("object_id", "model", *(rounded(F.col(c)).alias(c) for c in ("rmse", "train_mean", "train_std")))


_SEEDS = routing.repeat_seeds(42, 3)


def seeds() -> list[int]:
    return routing.repeat_seeds(chosen("seed", 42), chosen("repeats", 3))


@query("repeat_summary", _SERIES + f""", sd AS (SELECT unnest({_SEEDS}) AS repeat), sp AS (SELECT DISTINCT series_id, repeat, CASE WHEN ('0x' || substr(md5(series_id || ':' || repeat), 1, 8))::BIGINT % 3 = 0 THEN 'test' ELSE 'train' END AS split FROM sm, sd),
  bt AS (SELECT repeat, horizon, model, avg(rmse_mean) AS m FROM sm JOIN sp USING (series_id) WHERE split = 'train' GROUP BY ALL), bb AS (SELECT repeat, horizon, first(model ORDER BY round(m, 12), model) AS best_model FROM bt GROUP BY ALL),
  te AS (SELECT repeat, sm.* FROM sm JOIN sp USING (series_id) WHERE split = 'test'), bo AS (SELECT repeat, horizon, avg(v) AS oracle FROM (SELECT repeat, horizon, series_id, min(rmse_mean) AS v FROM te GROUP BY ALL) GROUP BY ALL),
  ba AS (SELECT te.repeat, te.horizon, avg(rmse_mean) AS achieved FROM te JOIN bb ON te.repeat = bb.repeat AND te.horizon = bb.horizon AND te.model = bb.best_model GROUP BY ALL), bs AS (SELECT repeat, horizon, achieved, oracle, achieved - oracle AS regret FROM ba JOIN bo USING (repeat, horizon))
  SELECT horizon, count(DISTINCT repeat)::BIGINT AS n_repeats, """ + ", ".join(f"round(avg({m}), 6) + 0.0 AS {m}_mean, round(stddev_samp({m}), 6) + 0.0 AS {m}_std" for m in ("achieved", "oracle", "regret")) + " FROM bs GROUP BY horizon")
def repeat_summary(spark, sf_dir):
    s = series(spark, sf_dir)
    runs = [routing.best_single(s, routing.hash_split(s.select("series_id").distinct(), test_share=3, seed=seed)).withColumn("repeat", F.lit(seed)) for seed in seeds()]
    rows = routing.repeat_summary(reduce(lambda a, b: a.unionByName(b), runs), ["horizon"], ["achieved", "oracle", "regret"])
    return rows.select("horizon", "n_repeats", *(rounded(F.col(c)).alias(c) for c in rows.columns if c not in ("horizon", "n_repeats")))


@query("scoring_rows", _SERIES + " SELECT series_id, horizon, model, round(avg(rmse_mean), 6) AS cost, " + ", ".join(f"CASE WHEN model = '{m}' THEN 1.0 ELSE 0.0 END::DOUBLE AS model__{m}" for m in forecasts.MODELS) + " FROM sm GROUP BY ALL")
def scoring_rows(spark, sf_dir):
    return routing.scoring_rows(routing.task_matrix(series(spark, sf_dir), forecasts.MODELS), [], forecasts.MODELS).withColumn("cost", rounded(F.col("cost")))


@query("missing_baseline", _PERF + " SELECT DISTINCT config, cluster::INTEGER AS cluster, horizon FROM pf WHERE (config, cluster, horizon) NOT IN (SELECT (config, cluster, horizon) FROM pf WHERE model = 'naive_zero') ")
def missing_baseline(spark, sf_dir):
    return by_cluster.missing_baseline(performance(spark, sf_dir), chosen("baseline", "naive_zero"))


_EVERY = ("mae", "rmse", "mase", "directional_accuracy")


@query("kruskal_all", _SERIES + _ASSIGN + ", k0 AS (" + " UNION ALL ".join(f"SELECT config, cluster, model, horizon, '{m}' AS metric, round({m}_mean, 12) AS v FROM sm JOIN asg USING (series_id)" for m in _EVERY) + """),
  k1 AS (SELECT *, rank() OVER (PARTITION BY config, model, horizon, metric ORDER BY v) + (count(*) OVER (PARTITION BY config, model, horizon, metric, v) - 1) / 2.0 AS rk FROM k0 WHERE v IS NOT NULL),
  kt AS (SELECT config, model, horizon, metric, sum(t * t * t - t) AS tied FROM (SELECT config, model, horizon, metric, v, count(*) AS t FROM k0 WHERE v IS NOT NULL GROUP BY ALL) GROUP BY ALL),
  k2 AS (SELECT config, model, horizon, metric, cluster, sum(rk) AS r, count(*) AS k FROM k1 GROUP BY ALL), k3 AS (SELECT config, model, horizon, metric, sum(r * r / k) AS s, sum(k)::DOUBLE AS n, count(*) AS n_clusters FROM k2 GROUP BY ALL),
  k4 AS (SELECT config, model, horizon, metric, n_clusters::BIGINT AS n_clusters, CASE WHEN 1 - tied / (n * n * n - n) <> 0 THEN (12 / (n * (n + 1)) * s - 3 * (n + 1)) / (1 - tied / (n * n * n - n)) END AS h FROM k3 JOIN kt USING (config, model, horizon, metric) WHERE n_clusters > 1)
  SELECT config, model, horizon, metric, n_clusters, round(h, 6) + 0.0 AS h, round(""" + chi2_sql("h", "(n_clusters - 1)") + """, 6) + 0.0 AS p, '' AS note FROM k4""")
def kruskal_all(spark, sf_dir):
    k = by_cluster.kruskal(series(spark, sf_dir), assignments(spark, sf_dir))
    return k.withColumns({c: rounded(F.col(c)) for c in ("h", "p")})


@query("series_split")
def series_split(spark, sf_dir):
    return routing.assert_apart(routing.series_split(all_returns(spark, sf_dir).select("series_id").distinct(), chosen("seed", 42)))


@query("routing_scoring")
def routing_scoring(spark, sf_dir):
    return meta_models.route_by_scoring(_meta_rows(spark, sf_dir), BASIC, forecasts.MODELS)


@query("routing_top_two")
def routing_top_two(spark, sf_dir):
    return meta_models.top_two(_meta_rows(spark, sf_dir), BASIC)


@query("feature_importances")
def feature_importances(spark, sf_dir):
    return meta_models.feature_importances(_meta_rows(spark, sf_dir), BASIC, forecasts.MODELS)


@query("feature_selection")
def feature_selection(spark, sf_dir):
    """Features of training series by their information about the best model at horizon five."""
    rows = _meta_rows(spark, sf_dir).where("split = 'train' and horizon = 5")
    long = screening.long_features(rows.select("series_id", *BASIC))
    return meta_models.select_features(meta_models.neighbour_information(long, rows.select("series_id", F.col("best").alias("label"))), top=8)


@query("learned_routing_evaluation")
def learned_routing_evaluation(spark, sf_dir):
    """How well the forest's choices on test series meet the best model, where it is sure, else the baseline's."""
    said = meta_models.route(_meta_rows(spark, sf_dir), BASIC, "forest").withColumn("baseline", F.lit("naive_zero"))
    return routing.evaluation(routing.confidence_fallback(said, 0.5).select("truth", F.col("chosen").alias("predicted")))


@query("feature_diagnostics", _SERIES + """, dg0 AS (SELECT series_id, series_id LIKE 'SU:%' AS odd FROM cat), dg AS (SELECT series_id, 1.0 AS flat, CASE WHEN odd THEN NULL ELSE 2.0 END AS gappy FROM dg0)
  SELECT 'missing_or_infinite' AS fact, 'gappy' AS detail, (count(*) FILTER (WHERE gappy IS NULL))::BIGINT AS n FROM dg HAVING count(*) FILTER (WHERE gappy IS NULL) > 0 UNION ALL SELECT 'constant', 'flat', 1::BIGINT UNION ALL SELECT 'constant', 'gappy', 1::BIGINT
  UNION ALL SELECT 'unknown_series', series_id, 1::BIGINT FROM cat WHERE series_id NOT IN (SELECT series_id FROM sm)""")
def feature_diagnostics(spark, sf_dir):
    from ..sources.panels import price_panel

    ids = price_panel(spark, sf_dir).select("series_id").distinct()
    rows = ids.withColumns({"flat": F.lit(1.0), "gappy": F.when(~F.col("series_id").startswith("SU:"), 2.0)})
    return routing.feature_diagnostics(rows, series(spark, sf_dir), ["flat", "gappy"])


def _judged(spark, sf_dir, seed: int | None = None):
    """Routes of the logistic classifier over the real errors, with fallback below a confidence of a half."""
    with using({} if seed is None else {"seed": seed}):
        rows = _meta_rows(spark, sf_dir)
    said = meta_models.top_two(rows, BASIC).select("series_id", "horizon", "first", "second", "confidence")
    return routing.judged_routes(rows, said, forecasts.MODELS, threshold=0.5)


@query("routing_judged")
def routing_judged(spark, sf_dir):
    return _judged(spark, sf_dir)


@query("routing_route_summary")
def routing_route_summary(spark, sf_dir):
    return routing.route_summary(_judged(spark, sf_dir))


@query("routing_confidence_quantiles")
def routing_confidence_quantiles(spark, sf_dir):
    return routing.confidence_quantiles(_judged(spark, sf_dir))


@query("routing_repeat_aggregates")
def routing_repeat_aggregates(spark, sf_dir):
    """The summary of routes over splits by several seeds; each split fits its own classifier."""
    each = [routing.route_summary(_judged(spark, sf_dir, seed)).withColumn("repeat", F.lit(seed)) for seed in seeds()]
    return routing.repeat_aggregates(reduce(lambda a, b: a.unionByName(b), each), ["horizon"])


@query("missing_baseline_partial", _PERF + """, pp AS (SELECT * FROM pf WHERE NOT (model = 'naive_zero' AND (horizon = 5 OR cluster = 2)))
  SELECT DISTINCT config, cluster::INTEGER AS cluster, horizon FROM pp WHERE (config, cluster, horizon) NOT IN (SELECT (config, cluster, horizon) FROM pp WHERE model = 'naive_zero')""")
def missing_baseline_partial(spark, sf_dir):
    """A run in which the baseline failed at one horizon and in one cluster."""
    perf = performance(spark, sf_dir).where("not (model = 'naive_zero' and (horizon = 5 or cluster = 2))")
    return by_cluster.missing_baseline(perf)


_BROKEN = _OBJECTS + """, tp AS (SELECT * FROM tk WHERE NOT (model = 'naive_last' AND fold = 2 AND series_id LIKE 'OR:%') UNION ALL SELECT * FROM tk WHERE model = 'naive_zero' AND horizon = 1 AND fold = 1),
  fp AS (SELECT series_id, horizon, fold, CASE WHEN horizon = 20 THEN NULL ELSE train_mean END AS train_mean, train_std FROM ft WHERE NOT (fold = 3 AND series_id LIKE 'EV:%') UNION ALL SELECT 'XX:none', 1, 1, 0.0, 1.0),
  ob AS (SELECT series_id, horizon, fold, count(DISTINCT model) AS n, count(*) AS r FROM tp GROUP BY ALL)"""


@query("coverage_checks_failing", _BROKEN + """ SELECT (SELECT count(*) FROM ob WHERE (series_id, horizon, fold) NOT IN (SELECT (series_id, horizon, fold) FROM fp))::BIGINT AS missing_features,
  (SELECT count(*) FROM fp WHERE (series_id, horizon, fold) NOT IN (SELECT (series_id, horizon, fold) FROM ob))::BIGINT AS features_without_metrics,
  (SELECT count(*) FROM (SELECT series_id, horizon FROM fp GROUP BY ALL HAVING count(DISTINCT fold) <> 3))::BIGINT AS bad_fold_counts, (SELECT count(*) FILTER (WHERE train_mean IS NULL) + count(*) FILTER (WHERE train_std IS NULL) FROM fp)::BIGINT AS non_finite_features,
  (SELECT max(n) FROM ob)::BIGINT AS models_per_object, (SELECT sum(r - n) FROM ob)::BIGINT AS duplicate_metrics, (SELECT count(*) FROM ob WHERE n < (SELECT max(n) FROM ob))::BIGINT AS incomplete_objects,
  (SELECT count(*) FILTER (WHERE rmse IS NULL) FROM tp)::BIGINT AS missing_metrics, 'missing_features;bad_fold_counts;non_finite_features;duplicate_metrics;incomplete_objects' AS failures, 'failed' AS status""")
def coverage_checks_failing(spark, sf_dir):
    """Metrics and features with gaps, repeats, and objects that the other side lacks."""
    t, f = tasks(spark, sf_dir), _fold_facts(spark, sf_dir)
    broken = t.where("not (model = 'naive_last' and fold = 2 and series_id like 'OR:%')").unionByName(t.where("model = 'naive_zero' and horizon = 1 and fold = 1"))
    unknown = spark.createDataFrame([("XX:none", 1, 1, 0.0, 1.0)], f.schema)
    gaps = f.withColumn("train_mean", F.when(F.col("horizon") != 20, F.col("train_mean"))).where("not (fold = 3 and series_id like 'EV:%')").unionByName(unknown)
    return routing.coverage_checks(broken, gaps, ["train_mean", "train_std"], ["rmse"], 3)
