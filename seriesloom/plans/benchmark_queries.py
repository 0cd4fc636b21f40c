"""Queries over a benchmark that is run, stopped and resumed: the last 80 returns of every series, so that some folds are too short."""

from __future__ import annotations

from ..functions.columns import rounded
from ..operators import benchmark, forecasts, returns
from ..settings import chosen
from ..sources.shared import new_folder, stored
from .forecast_queries import _TASKS
from .panel_queries import eligible, prices

QUERIES: dict = {}
SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def add(f):
        QUERIES[name] = f
        if sql:
            SQL[name] = sql
        return f

    return add


SHORT = benchmark.Benchmark(["naive_zero", "naive_mean"])
#: The panel with at most 80 and at least 60 returns a series, and the tasks that it has.
_SHORT = _TASKS.replace("2000", "80").replace("1500", "60")
_JOBS = _SHORT + f""", jb AS (SELECT DISTINCT f.series_id, f.horizon, k.fold, k.model, f.m - 3 * greatest(1, f.m // 4) + (k.fold - 1) * greatest(1, f.m // 4) AS train_n
    FROM (SELECT DISTINCT series_id, horizon, m FROM vall WHERE m >= 5) f, (SELECT unnest([1, 2, 3]) AS fold, m.model FROM (VALUES ('naive_zero'), ('naive_mean')) m(model)) k)"""


def short_returns(spark, sf_dir):
    """The last returns of every series, stored: every run over them would read the panel again."""
    return stored(returns.last_returns(prices(spark, sf_dir), 80, 60), "short-returns")


def resumed(spark, sf_dir):
    """A run of the shortest horizon, and a second one over all three that only does the rest and what failed."""
    folder, data = new_folder(spark, "benchmark"), short_returns(spark, sf_dir)
    benchmark.run_benchmark(data, folder, benchmark.Benchmark(SHORT.models, horizons=(1,)), "first", waves=2)
    return benchmark.run_benchmark(data, folder, SHORT, "second", waves=2)


_MEASURES = [m for m in forecasts.METRICS if m not in ("mape", "smape", "r2", "r2_oos")]


@query("benchmark_fold_metrics", _JOBS + " SELECT series_id, horizon, model, fold, n_test::BIGINT AS n_test, " + ", ".join(f"round({m}, 6) + 0.0 AS {m}" for m in _MEASURES) + " FROM tk JOIN jb USING (series_id, horizon, model, fold) WHERE train_n >= 10")
def benchmark_fold_metrics(spark, sf_dir):
    rows = benchmark.fold_metrics(resumed(spark, sf_dir))
    return rows.select(*forecasts.TASK, "n_test", *(rounded(rows[m]).alias(m) for m in _MEASURES))


@query("benchmark_resume_summary", _JOBS + " SELECT CASE WHEN horizon = 1 AND train_n >= 10 THEN 'first' ELSE 'second' END AS run_id, CASE WHEN train_n >= 10 THEN 'success' ELSE 'error' END AS status, count(*)::BIGINT AS n FROM jb GROUP BY ALL")
def benchmark_resume_summary(spark, sf_dir):
    return benchmark.resume_summary(resumed(spark, sf_dir))


@query("benchmark_errors", _JOBS + " SELECT series_id, horizon, model, fold, 'error' AS status, 'insufficient_data' AS error_type, train_n || ' training rows' AS notes FROM jb WHERE train_n < 10")
def benchmark_errors(spark, sf_dir):
    return benchmark.errors(resumed(spark, sf_dir)).select(*forecasts.TASK, "status", "error_type", "notes")


@query("benchmark_error_summary", _JOBS + " SELECT model, 'insufficient_data' AS error_type, count(*)::BIGINT AS n FROM jb WHERE train_n < 10 GROUP BY model")
def benchmark_error_summary(spark, sf_dir):
    return benchmark.error_summary(resumed(spark, sf_dir))


@query("benchmark_timeouts", _JOBS.replace("'naive_zero'), ('naive_mean'", "'vanilla_mlp'), ('lstm_forecast'") + " SELECT model, CASE WHEN train_n < 10 THEN 'insufficient_data' ELSE 'OutOfTime' END AS error_type, count(*)::BIGINT AS n FROM jb GROUP BY ALL")
def benchmark_timeouts(spark, sf_dir):
    """Neural models that may take no time: every task that has rows is a timeout, and none is lost."""
    config = benchmark.Benchmark(["vanilla_mlp", "lstm_forecast"], max_fit_seconds=0.0)
    return benchmark.error_summary(benchmark.run_benchmark(short_returns(spark, sf_dir), new_folder(spark, "benchmark"), config, "only", waves=1))


@query("benchmark_metrics", _TASKS + " SELECT series_id, horizon, model, fold, n_test::BIGINT AS n_test, " + ", ".join(f"round({m}, 6) + 0.0 AS {m}" for m in _MEASURES) + " FROM tk WHERE model IN ('naive_zero', 'naive_mean')")
def benchmark_metrics(spark, sf_dir):
    """The benchmark that the settings describe, over the eligible series; two naive models where they say nothing."""
    config = benchmark.Benchmark(
        chosen("models", ["naive_zero", "naive_mean"]), tuple(chosen("horizons", (1, 5, 20))), chosen("folds", returns.FOLDS), settings=chosen("model_overrides", {}),
        max_fit_seconds=chosen("max_fit_seconds", None), max_predict_seconds=chosen("max_predict_seconds", None), limits=chosen("limits", {}),
    )
    rows = benchmark.fold_metrics(benchmark.run_benchmark(eligible(spark, sf_dir), new_folder(spark, "benchmark"), config, "only", waves=2))
    return rows.select(*forecasts.TASK, "n_test", *(rounded(rows[m]).alias(m) for m in _MEASURES))


NEURAL = ["vanilla_mlp", "chaotic_mlp", "chaotic_logistic_net", "lstm_forecast", "chaotic_lstm_forecast"]


@query("training_audit")
def training_audit(spark, sf_dir):
    """Every neural model on every series at horizon 5 over all folds: parameters, losses by epoch, and how trainings went."""
    config = benchmark.Benchmark(NEURAL, horizons=(5,), max_fit_seconds=600.0)
    table = benchmark.run_benchmark(eligible(spark, sf_dir), new_folder(spark, "benchmark"), config, "audit", waves=1)
    return benchmark.training_audit(table, benchmark.training_parameters(spark, config))
