"""The benchmark that is stopped and resumed, its limits of time, and the audit of training against SQL on its written table."""

import glob
import os

import duckdb
import numpy as np
import pytest

from seriesloom.functions import models
from seriesloom.operators import benchmark

RETURNS = "series_id string, rn int, n int, r double"


@pytest.fixture(scope="module")
def returns(spark):
    rng = np.random.default_rng(3)
    rows = [(f"s{k}", i, n, float(x)) for k, n in enumerate((150, 160, 170, 60, 20)) for i, x in enumerate(rng.normal(0, 0.01, n))]
    return spark.createDataFrame(rows, RETURNS)


CONFIG = benchmark.Benchmark(["naive_zero", "naive_mean", "ridge_lag"], horizons=(1, 5), windows={1: 16, 5: 8})
KEYS = ["task_id", "series_id", "horizon", "model", "fold", "status", "error_type", "n_train", "n_test", "predictions"]


def rows_of(table):
    return sorted(map(str, benchmark.newest(table).select(*KEYS).collect()))


def test_a_stopped_run_is_resumed_with_the_rest(spark, returns, tmp_path):
    whole = benchmark.run_benchmark(returns, str(tmp_path / "whole"), CONFIG, "whole")
    n = whole.count()
    assert n == 4 * 2 * 3 * 3  # four series are long enough for a window, each has two horizons, three models and three folds
    folder = str(tmp_path / "stopped")
    first = benchmark.run_benchmark(returns, folder, CONFIG, "first", stop_after=3)
    done = first.count()
    assert 0 < done < n
    second = benchmark.run_benchmark(returns, folder, CONFIG, "second")
    assert second.where("run_id = 'second'").count() == n - first.where("status = 'success'").count()
    assert rows_of(second) == rows_of(whole)
    third = benchmark.run_benchmark(returns, folder, CONFIG, "third")
    assert third.where("run_id = 'third'").count() == benchmark.errors(second).count()
    assert rows_of(third) == rows_of(whole)


def test_files_of_a_killed_wave(spark, returns, tmp_path):
    """Whatever part of a wave's files is there, each row is a whole task and the next run does the others."""
    folder = str(tmp_path / "killed")
    benchmark.run_benchmark(returns, folder, CONFIG, "first", waves=1)
    before = rows_of(benchmark.read_run(spark, folder))
    files = sorted(glob.glob(f"{folder}/part-*.parquet"))
    for f in files[::2]:
        os.remove(f)
        crc = os.path.join(folder, f".{os.path.basename(f)}.crc")
        if os.path.exists(crc):
            os.remove(crc)
    left = benchmark.read_run(spark, folder).count()
    assert 0 < left < len(before)
    assert rows_of(benchmark.run_benchmark(returns, folder, CONFIG, "second", waves=2)) == before


def test_a_changed_setting_redoes_its_model_only(spark, returns, tmp_path):
    folder = str(tmp_path / "changed")
    benchmark.run_benchmark(returns, folder, CONFIG, "first", waves=1)
    other = benchmark.Benchmark(CONFIG.models, CONFIG.horizons, windows=CONFIG.windows, settings={"ridge_lag": {"alpha": 100.0}})
    table = benchmark.run_benchmark(returns, folder, other, "second", waves=1)
    again = benchmark.newest(table.where("run_id = 'second' and status = 'success'"))
    assert {r.model for r in again.select("model").distinct().collect()} == {"ridge_lag"}
    assert other.task_hash("ridge_lag", 1) != CONFIG.task_hash("ridge_lag", 1) and other.task_hash("naive_zero", 1) == CONFIG.task_hash("naive_zero", 1)
    assert other.task_hash("ridge_lag", 1) != other.task_hash("ridge_lag", 5)
    with pytest.raises(ValueError):
        benchmark.Benchmark(["ridge_lag"], settings={"ridge_lag": {"beta": 1}})
    with pytest.raises(ValueError):
        benchmark.Benchmark(["ridge_lag"], horizons=(7,))


def test_limits_of_time(spark, returns, tmp_path):
    config = benchmark.Benchmark(["vanilla_mlp", "esn", "naive_zero"], (1,), windows={1: 16}, max_fit_seconds=0.0, limits={"esn": {"max_fit_seconds": 1000.0}})
    table = benchmark.run_benchmark(returns, str(tmp_path / "limits"), config, "only", waves=1)
    said = {(r.model, r.status): r["count"] for r in benchmark.audit(table).groupBy("model", "status").count().collect()}
    assert said == {("vanilla_mlp", "timeout"): 12, ("esn", "success"): 12, ("naive_zero", "success"): 12}
    assert {r.error_type for r in benchmark.errors(table).collect()} == {"OutOfTime"}
    assert benchmark.fold_metrics(table).count() == 24


def test_a_deadline_ends_training():
    model = models.make("vanilla_mlp", epochs=10_000, patience=10_000)
    model.deadline = models.Deadline(0.5)
    rng = np.random.default_rng(0)
    with pytest.raises(models.OutOfTime):
        model.fit(rng.normal(size=(400, 8)), rng.normal(size=400))
    assert 0 < len(model.trace["val_loss"]) < 10_000


def test_traces_and_diagnoses(spark, returns, tmp_path):
    config = benchmark.Benchmark(["vanilla_mlp", "chaotic_mlp", "ridge_lag"], (5,), windows={5: 8}, settings={"vanilla_mlp": {"epochs": 12, "patience": 3, "rate": 0.02}})
    folder = str(tmp_path / "traces")
    table = benchmark.run_benchmark(returns, folder, config, "only", waves=1)
    for r in table.where("model = 'vanilla_mlp' and status = 'success'").collect():
        assert len(r.train_loss) == len(r.val_loss) <= 12 and r.stop_reason == ("patience" if len(r.val_loss) - (1 + int(np.argmin(r.val_loss))) == 3 else "epochs")
        assert r.n_parameters == 8 * 128 + 128 + 128 * 64 + 64 + 64 + 1
    got = {tuple(r) for r in benchmark.training_diagnoses(table).select("series_id", "model", "fold", "epochs", "best_epoch", "last_val_loss", "best_val_loss", "verdict").collect()}
    want = duckdb.sql(f"""WITH t AS (SELECT *, coalesce(len(val_loss), 0)::INTEGER AS epochs, list_min(val_loss) AS best FROM read_parquet('{folder}/*.parquet') WHERE status = 'success')
      SELECT series_id, model, fold, epochs, list_position(val_loss, best)::INTEGER, val_loss[-1], best,
        CASE WHEN epochs = 0 THEN 'no_epochs' WHEN NOT isfinite(train_loss[-1]) OR NOT isfinite(val_loss[-1]) OR train_loss[-1] > train_loss[1] THEN 'diverged'
             WHEN list_position(val_loss, best) = 1 THEN 'never_improved' WHEN val_loss[-1] >= 1.1 * best THEN 'overfitted' WHEN stop_reason = 'patience' THEN 'stopped_early' ELSE 'ran_out_of_epochs' END FROM t""").fetchall()
    assert got == set(want) and len(got) == 36 - benchmark.errors(table).count()
    said = {r.model: r for r in benchmark.training_audit(table, benchmark.training_parameters(spark, config)).collect()}
    assert said["vanilla_mlp"].max_epochs == 12 and said["vanilla_mlp"].overrides == '{"epochs": 12, "patience": 3, "rate": 0.02}' and said["ridge_lag"].no_epochs == 1.0
    assert all(abs(sum(r[v] for v in ("diverged", "never_improved", "overfitted", "stopped_early", "ran_out_of_epochs", "no_epochs")) - 1) < 1e-12 for r in said.values())


def test_empty_panel(spark, returns, tmp_path):
    table = benchmark.run_benchmark(returns.limit(0), str(tmp_path / "none"), CONFIG, "only", waves=1)
    assert table.count() == 0 and benchmark.error_summary(table).count() == 0
