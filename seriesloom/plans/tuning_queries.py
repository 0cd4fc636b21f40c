"""Queries over tuning results: shrunken means and shrunken last sums as candidates, and echo-state networks fitted in tasks."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import functions as F

from ..functions.columns import rounded
from ..operators import forecasts, series_kernels, tuning
from .forecast_queries import _PREDICTED, folded
from .panel_queries import eligible

QUERIES: dict = {}
SQL: dict[str, str] = {}

#: (candidate, model, family, compare_group, shrinkage); the mean as the plain variant, the last sum as the other.
CANDIDATES = [(f"{m}_{a}", f"{m}_shrink", "shrinkage", "g1", a) for m in ("mean", "last") for a in (0.25, 0.5, 1.0)]
SHORTLIST = [("mean_0.5", "practical_main", "small and steady"), ("last_0.25", "chaotic_counterpart", "follows the last sum"), ("last_9", "exploratory_chaotic", "never run")]
PAIRS = [("mean_shrink", "last_shrink", None)]
_MEASURES = ("mae", "rmse", "mase", "directional_accuracy")
_LEVEL = _PREDICTED + ", cd(candidate, model, family, compare_group, a) AS (VALUES " + ", ".join(f"('{c}', '{m}', '{f}', '{g}', {a})" for c, m, f, g, a in CANDIDATES) + """),
  cp AS (SELECT cd.candidate, pd.series_id, pd.horizon, pd.fold, pd.y, pd.train_step, cd.a * pd.p AS p FROM pd JOIN cd ON pd.model = CASE cd.model WHEN 'mean_shrink' THEN 'naive_mean' ELSE 'naive_last' END),
  ct AS (SELECT candidate, series_id, horizon, fold, avg(abs(y - p)) AS mae, sqrt(avg((y - p) * (y - p))) AS rmse, avg(abs(y - p)) / nullif(any_value(train_step), 0) AS mase, avg((sign(y) = sign(p))::INTEGER) AS directional_accuracy FROM cp GROUP BY ALL),
  cs AS (SELECT candidate, series_id, horizon, avg(mae) AS mae, avg(rmse) AS rmse, avg(mase) AS mase, avg(directional_accuracy) AS directional_accuracy FROM ct GROUP BY ALL),
  lv AS (SELECT candidate, horizon, any_value(model) AS model, any_value(family) AS family, any_value(compare_group) AS compare_group, count(*) AS n_series, avg(mae) AS mae, avg(rmse) AS rmse, avg(mase) AS mase, avg(directional_accuracy) AS directional_accuracy FROM cs JOIN cd USING (candidate) GROUP BY candidate, horizon)"""
_MEANS = """, mh AS (SELECT model, candidate, compare_group, family, avg(mae) AS mae, avg(rmse) AS rmse, avg(mase) AS mase, avg(directional_accuracy) AS directional_accuracy FROM lv GROUP BY ALL)"""


def query(name: str, sql: str | None = None):
    def add(f):
        QUERIES[name] = f
        if sql:
            SQL[name] = sql
        return f

    return add


def _r(*names: str):
    return [rounded(F.col(c)).alias(c) for c in names]


def results(spark, sf_dir):
    said = forecasts.naive_predictions(folded(spark, sf_dir))
    known = spark.createDataFrame(CANDIDATES, "candidate string, model string, family string, compare_group string, a double")
    kind = F.when(F.col("model") == "mean_shrink", "naive_mean").otherwise("naive_last")
    each = F.broadcast(known.select("candidate", "a", kind.alias("model")))  # six rows
    rows = said.join(each, "model").withColumns({"prediction": F.col("a") * F.col("prediction"), "seconds": F.lit(0.0), "status": F.lit("success")})
    return tuning.candidate_level(rows, known.drop("a"))


@query("candidate_level", _LEVEL + " SELECT candidate, model, horizon, n_series::BIGINT AS n_series, " + ", ".join(f"round({m}, 6) + 0.0 AS {m}" for m in _MEASURES) + ", 'success' AS status FROM lv")
def candidate_level(spark, sf_dir):
    return results(spark, sf_dir).select("candidate", "model", "horizon", "n_series", *_r(*_MEASURES), "status")


@query("best_by_model", _LEVEL + ", bm AS (SELECT *, row_number() OVER (PARTITION BY model, horizon ORDER BY round(mae, 12), candidate) AS nth FROM lv) SELECT model, horizon, candidate, round(mae, 6) AS mae FROM bm WHERE nth = 1")
def best_by_model(spark, sf_dir):
    return tuning.best_by_model(results(spark, sf_dir)).select("model", "horizon", "candidate", *_r("mae"))


@query("best_over_horizons", _LEVEL + _MEANS + ", bo AS (SELECT *, row_number() OVER (PARTITION BY model ORDER BY round(mae, 12), candidate) AS nth FROM mh) SELECT model, candidate, compare_group, round(mae, 6) AS mae, round(rmse, 6) AS rmse, 'success' AS status FROM bo WHERE nth = 1")
def best_over_horizons(spark, sf_dir):
    return tuning.best_over_horizons(results(spark, sf_dir)).select("model", "candidate", "compare_group", *_r("mae", "rmse"), "status")


@query("variant_comparison", _LEVEL + """, vb AS (SELECT *, row_number() OVER (PARTITION BY horizon, compare_group, model ORDER BY round(mae, 12), candidate) AS nth FROM lv)
  SELECT b.horizon, b.compare_group, b.candidate AS base_candidate, o.candidate AS chaotic_candidate, round(b.mae, 6) AS base_mae, round(o.mae, 6) AS chaotic_mae, round(o.mae - b.mae, 6) + 0.0 AS chaotic_difference, round(o.mae / b.mae, 6) AS chaotic_ratio
  FROM vb b JOIN vb o ON b.horizon = o.horizon AND b.compare_group = o.compare_group AND b.nth = 1 AND o.nth = 1 AND b.model = 'mean_shrink' AND o.model = 'last_shrink'""")
def variant_comparison(spark, sf_dir):
    rows = tuning.compare_variants(results(spark, sf_dir), PAIRS)
    return rows.select("horizon", "compare_group", "base_candidate", "chaotic_candidate", *_r("base_mae", "chaotic_mae", "chaotic_difference", "chaotic_ratio"))


_SHORT = _LEVEL + _MEANS + ", sl(candidate, role, rationale) AS (VALUES " + ", ".join(str(s) for s in SHORTLIST) + """), su AS (SELECT sl.*, mh.model, mh.family, mh.mae, CASE WHEN mh.candidate IS NULL THEN 'missing_candidate' ELSE 'success' END AS status,
  CASE WHEN mh.candidate IS NULL THEN 'candidate=' || sl.candidate || ' not found' ELSE '' END AS notes, mh.candidate IS NOT NULL AS selected FROM sl LEFT JOIN mh USING (candidate))"""


def _summary(spark, sf_dir):
    return tuning.shortlist_summary(results(spark, sf_dir), spark.createDataFrame(SHORTLIST, "candidate string, role string, rationale string"))


@query("shortlist_summary", _SHORT + " SELECT candidate, role, model, round(mae, 6) AS mae, status, notes, selected FROM su")
def shortlist_summary(spark, sf_dir):
    return _summary(spark, sf_dir).select("candidate", "role", "model", *_r("mae"), "status", "notes", "selected")


@query("family_summary", _SHORT + """ SELECT family, min(candidate) FILTER (WHERE role = 'practical_main') AS best_practical, min(candidate) FILTER (WHERE role = 'chaotic_counterpart') AS best_chaotic,
  round(avg(mae) FILTER (WHERE role = 'chaotic_counterpart') - avg(mae) FILTER (WHERE role = 'practical_main'), 6) + 0.0 AS chaotic_minus_practical FROM su WHERE family IS NOT NULL GROUP BY family""")
def family_summary(spark, sf_dir):
    return tuning.family_summary(_summary(spark, sf_dir)).select("family", "best_practical", "best_chaotic", *_r("chaotic_minus_practical"))


#: Two settings of each of three echo-state networks.
NETWORKS = {f"{m}_{n}": (m, {"size": n}) for m in ("esn", "chaotic_esn", "transient_chaotic_esn") for n in (48, 96)}


@query("echo_state_tuning")
def echo_state_tuning(spark, sf_dir):
    """Echo-state networks against their chaotic variants on every series, horizon and fold: the tuning stage itself."""
    data = eligible(spark, sf_dir)
    parts = [series_kernels.forecast_tasks(data, [m], settings={m: s}).withColumn("candidate", F.lit(c)) for c, (m, s) in NETWORKS.items()]
    known = spark.createDataFrame([(c, m, "reservoir", f"size_{s['size']}") for c, (m, s) in NETWORKS.items()], "candidate string, model string, family string, compare_group string")
    return tuning.compare_variants(tuning.candidate_level(reduce(lambda a, b: a.unionByName(b), parts), known))
