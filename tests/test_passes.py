"""The panel is read once for all readers of its tasks, and tasks of a benchmark are given on together."""

import pandas as pd

from seriesloom.operators import benchmark, blocks, forecasts, returns
from seriesloom.plans import benchmark_queries, cluster_queries, feature_queries, forecast_queries, routing_queries, selection_queries, store_queries

SF = "/root/testdata/sf0.001"


def test_tasks_and_facts_are_stored(spark):
    for made in (forecast_queries.tasks(spark, SF), routing_queries._fold_facts(spark, SF)):
        assert not any("testdata" in f for f in made.inputFiles())


def test_rows_of_a_batch_are_one_frame():
    config = benchmark.Benchmark(["naive_zero"], horizons=(1,))
    tasks = pd.DataFrame([(f"s{i}", [0.01 * (j % 7) for j in range(100)], 1, 64, "naive_zero", 1, f"t{i}", "h") for i in range(300)], columns=["series_id", "r", "horizon", "window", "model", "fold", "task_id", "config_hash"])
    frames = list(benchmark._work(config, "only", 0)(iter([tasks])))
    assert [len(f) for f in frames] == [256, 44]
    assert pd.concat(frames)["task_id"].tolist() == tasks["task_id"].tolist()


def test_vectors_move_as_they_are_given_and_metrics_are_stored(spark):
    """A choice among configurations reads its metrics twice, and floats need half the bytes of doubles."""
    assert cluster_queries.vectors(spark, SF).schema["vector"].dataType.elementType.simpleString() == "float"
    assert cluster_queries.points(spark, SF).schema["x"].dataType.simpleString() == "double"
    assert store_queries.matrices(spark, SF)["base"].schema["vector"].dataType.elementType.simpleString() == "float"
    assert not any("testdata" in f for f in selection_queries.metrics(spark, SF).inputFiles())


def test_screening_reads_the_panel_once(spark):
    screened, pairs = feature_queries._screened(spark, SF)
    assert not any("testdata" in f for df in (screened, pairs) for f in df.inputFiles())


def test_runs_of_a_benchmark_share_the_returns(spark):
    assert not any("testdata" in f for f in benchmark_queries.short_returns(spark, SF).inputFiles())


def test_blocks_are_computed_once(spark):
    rows = spark.range(3).selectExpr("concat('s', id) series_id", "uuid() drawn", "'' feature_warning_flags", "0 feature_warning_count", "'success' feature_status")
    table = blocks.master({"A": rows})
    assert table.collect() == table.collect()


def test_names_of_tasks_need_no_predictions(spark):
    made = forecast_queries.folded(spark, "/root/testdata/sf0.01")
    names = forecasts.naive_tasks(made)
    assert set(names.collect()) == set(forecasts.naive_predictions(made).select(*forecasts.TASK).distinct().collect())
    assert names.count() == len(set(names.collect())) > 0


def test_last_returns_are_those_of_whole_series(spark):
    """Ties of dates, bad closes, and series just below, at and above both bounds."""
    rows = [(f"s{n}", "US", f"2020-01-{1 + i // 3:02d}", 1.0 + (i * 7) % 11) for n in (5, 6, 7, 20, 21, 22, 60) for i in range(n)] + [("bad", "RU", f"2020-01-{1 + i:02d}", float(i)) for i in range(25)] + [("gap", "RU", "2020-01-01", None)] * 25
    prices = spark.createDataFrame(rows, "series_id string, market string, date string, close double")
    want = returns.length_policy(returns.log_returns(prices), 20, 5)
    got = returns.last_returns(prices, 20, 5)
    assert sorted(got.columns) == sorted(want.columns) and dict(got.dtypes) == dict(want.dtypes)
    assert sorted(got.select(*want.columns).collect()) == sorted(want.collect()) and got.count() > 0
