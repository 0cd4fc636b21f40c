"""Settings that files give reach the operators: different results and hashes; a shortlist's file drives a benchmark."""

import pytest
import yaml

from seriesloom import cli, config
from seriesloom.operators import tuning
from seriesloom.plans import registry
from seriesloom.settings import chosen, using
from seriesloom.sources.files import latest_manifest

DIR = "/root/testdata/sf0.001"


def write(path, **root):
    path.write_text(yaml.safe_dump(root))
    return str(path)


def test_chosen_inside_only():
    assert chosen("target", 1) == 1
    with using({"target": 2}):
        with using({"minimum": 3}):
            assert (chosen("target", 1), chosen("minimum", 1)) == (2, 3)
        assert chosen("minimum", 1) == 1
    assert chosen("target", 1) == 1


def test_files_extend_files(tmp_path):
    write(tmp_path / "base.yaml", tables="t", output="o", stage="catalog", settings={"target": 900, "minimum": 700})
    write(tmp_path / "more.yaml", extends="base.yaml", settings={"minimum": 500})
    c = config.load(write(tmp_path / "top.yaml", extends=["more.yaml"], output="elsewhere"))
    assert c.settings == {"target": 900, "minimum": 500} and (c.tables, c.output) == ("t", "elsewhere")
    write(tmp_path / "a.yaml", extends="b.yaml")
    with pytest.raises(ValueError, match="extends itself"):
        config.load(write(tmp_path / "b.yaml", extends="a.yaml"))
    with pytest.raises(ValueError, match="settings without a stage"):
        config.load(write(tmp_path / "c.yaml", tables="t", output="o", settings={"target": 1}))


def test_two_files_give_two_results(spark, tmp_path):
    found, hashes = {}, {}
    for n, (target, minimum) in enumerate(((900, 500), (100, 60))):
        path = write(tmp_path / f"{n}.yaml", tables=DIR, output=str(tmp_path / f"out{n}"), stage="catalog", settings={"target": target, "minimum": minimum})
        cli.main(["config", path])
        found[n] = {(r.status, r["count"]) for r in spark.read.parquet(str(tmp_path / f"out{n}/series_catalog")).groupBy("status").count().collect()}
        hashes[n] = latest_manifest(spark, str(tmp_path / f"out{n}/manifest"))["config_hash"]
    assert found[0] != found[1] and hashes[0] != hashes[1]


@pytest.mark.parametrize("name", sorted(config.STAGES))
def test_no_setting_is_only_recorded(name):
    """Every setting of every stage is one that some plan asks for."""
    import pathlib
    import re

    asked = {m for p in pathlib.Path(registry.__file__).parent.glob("*.py") for m in re.findall(r'chosen\("(\w+)"', p.read_text())}
    assert set(config.STAGES[name][1]) <= asked
    assert set(config.STAGES[name][0]) <= set(registry.all_queries())


def test_settings_change_plans(spark):
    run = registry.all_queries()["cluster_balance"]
    with using({"k_min": 3, "k_max": 4}):
        assert {r.config for r in run(spark, DIR).select("config").distinct().collect()} == {"k3", "k4"}
    assert run(spark, DIR).select("config").distinct().count() == 7


def test_a_shortlist_drives_a_benchmark(spark, tmp_path):
    summary = spark.createDataFrame([("r1", "ridge_lag", "linear", "main", True), ("r2", "ridge_lag", "linear", "other", True), ("gone", None, None, "other", False)], "candidate string, model string, family string, role string, selected boolean")
    tuning.shortlist_yaml(summary, {"r1": {"alpha": 5000.0}, "r2": {"alpha": 0.01}}, str(tmp_path / "short.yaml"))
    chosen_here = {"horizons": [5], "folds": 2}
    results = {}
    for candidate in ("r1", "r2"):
        path = write(tmp_path / f"{candidate}.yaml", tables=DIR, output=str(tmp_path / candidate), stage="benchmark", shortlist={"source": "short.yaml", "candidates": [candidate], "keep": ["naive_zero"]}, target=80, minimum=60, settings=chosen_here)
        c = config.load(path)
        assert c.settings["models"] == ["naive_zero", "ridge_lag"] and c.settings["model_overrides"] == {"ridge_lag": {"alpha": 5000.0 if candidate == "r1" else 0.01}}
        cli.main(["config", path])
        rows = spark.read.parquet(str(tmp_path / candidate / "benchmark_metrics")).collect()
        assert {r.model for r in rows} == {"naive_zero", "ridge_lag"} and {r.fold for r in rows} == {1, 2} and {r.horizon for r in rows} == {5}
        results[candidate] = {(r.series_id, r.fold, r.model): r.rmse for r in rows}
    same, other = ({k for k in results["r1"] if k[2] == m} for m in ("naive_zero", "ridge_lag"))
    assert all(results["r1"][k] == results["r2"][k] for k in same) and any(results["r1"][k] != results["r2"][k] for k in other)
    with pytest.raises(ValueError, match="no such candidates"):
        config.load(write(tmp_path / "bad.yaml", tables=DIR, output="o", stage="benchmark", shortlist={"source": "short.yaml", "candidates": ["nobody"]}))
