"""Readers' fallbacks, stages, selections, blocks and routing checks on small tables."""

import math
import tracemalloc

import numpy as np
import pytest
from pyspark.sql import functions as F

from seriesloom import cli, config
from seriesloom.functions import kernels
from seriesloom.operators import blocks, by_cluster, meta_models, routing, screening, selection, series_kernels, tuning
from seriesloom.plans.registry import all_queries
from seriesloom.sources import files


def test_stages_name_registered_queries():
    known = all_queries()
    assert all(n in known for names, _ in config.STAGES.values() for n in names)


def test_config_fills_a_stage_and_refuses_unknown(tmp_path):
    path = tmp_path / "c.yaml"
    path.write_text("stage: block_c\ntables: t\noutput: o\nsettings: {hill_share: 0.1}\n")
    c = config.load(str(path))
    assert c.queries == config.STAGES["block_c"][0] and c.settings == {"hill_share": 0.1}
    path.write_text("stage: block_c\ntables: t\noutput: o\nsettings: {nope: 1}\n")
    with pytest.raises(ValueError, match="nope"):
        config.load(str(path))


def test_stage_report_and_latest_manifest(spark, tmp_path):
    cli.report(spark, "/root/testdata/sf0.001", str(tmp_path / "a"), ["length_distribution"], "catalog")
    found = files.latest_manifest(spark, str(tmp_path / "a" / "manifest"), "catalog")
    assert found["stage"] == "catalog"
    with pytest.raises(ValueError, match="no manifest"):
        files.latest_manifest(spark, str(tmp_path / "a" / "manifest"), "other")


def test_unreadable_files_become_invalid_rows(spark, tmp_path):
    (tmp_path / "GOOD_D1.csv").write_text("datetime,open,high,low,close,volume\n2020-01-01,1,1,1,1,1\n2020-01-02,1,1,1,2,1\n")
    (tmp_path / "EMPTY_D1.csv").write_text("")
    from seriesloom.operators.catalog import series_catalog

    rows = files.read_price_files(spark, str(tmp_path), "RU")
    out = files.with_unreadable(series_catalog(rows), files.list_files(spark, str(tmp_path), "*_D1.csv"), "RU")
    got = {r["series_id"]: (r["n_rows"], r["status"], r["reason"]) for r in out.collect()}
    assert got == {"RU:GOOD": (2, "invalid", "too_short"), "RU:EMPTY": (0, "invalid", "read_error")}


def test_external_series_keeps_the_last_row_of_a_date(spark):
    rows = spark.createDataFrame([("a", "2020-01-01", "1", 1), ("a", "2020-01-02", "2", 2), ("a", "2020-01-02", "4", 3), ("a", "x", "5", 4), ("a", "2020-01-03", "-1", 5), ("b", "2020-01-01", "1", 6)], "series_id string, date string, close string, at int")
    got = files.external_series(rows, 2, ordinal="at").collect()
    assert [(r["series_id"], round(r["r"], 9)) for r in got] == [("a", round(math.log(4), 9))]


def test_resume_by_configuration(spark):
    tasks = spark.createDataFrame([("a", 1, "m", 1), ("a", 1, "m", 2)], "series_id string, horizon int, model string, fold int")
    done = tasks.where("fold = 1").select(files.task_identity({"x": 1}).alias("task_id"), F.lit("success").alias("status"))
    assert [r["fold"] for r in files.left_to_do(tasks, done, {"x": 1}).collect()] == [2]
    assert files.left_to_do(tasks, done, {"x": 2}).count() == 2
    assert [r["fold"] for r in files.restrict(tasks, folds=[2], max_series=1).collect()] == [2]


def test_selected_series(spark):
    rows = spark.createDataFrame([("b", 1), ("a", 2), ("b", 3), ("c", 4)], "series_id string, at int")
    assert [r[0] for r in files.select_series(rows, "at", most=2).collect()] == ["b", "a"]
    assert [r[0] for r in files.select_series(rows, "at", "sorted", ids=["c", "b"]).collect()] == ["b", "c"]
    assert files.sample_series(rows, 2).count() == 2


def test_correlation_prune_weighs_all_features(spark):
    rng = np.random.default_rng(0)
    base = rng.normal(size=(60, 3))
    x = {"a": base[:, 0], "b": base[:, 0] + 0.05 * base[:, 1], "c": base[:, 1] + 0.4 * base[:, 0], "d": base[:, 2], "e": np.zeros(60)}
    rows = [(str(i), n, float(v[i])) for n, v in x.items() for i in range(60)]
    kept = screening.correlation_prune(spark.createDataFrame(rows, "series_id string, feature string, value double"))
    r = {n: np.mean([abs(np.corrcoef(v, w)[0, 1]) if v.std() and w.std() else 0.0 for w in x.values()]) for n, v in x.items()}
    loser = "a" if r["a"] > r["b"] else "b"
    assert kept == [n for n in "abcde" if n != loser]


def test_ward_equals_plain_merging():
    def plain(x, k):
        groups = [[i] for i in range(len(x))]
        cost = lambda a, b: len(a) * len(b) / (len(a) + len(b)) * ((x[a].mean(axis=0) - x[b].mean(axis=0)) ** 2).sum()
        while len(groups) > k:
            i, j = min(((i, j) for i in range(len(groups)) for j in range(i + 1, len(groups))), key=lambda p: cost(groups[p[0]], groups[p[1]]))
            groups[i] += groups.pop(j)
        out = np.empty(len(x), int)
        for n, g in enumerate(groups):
            out[g] = n
        return out

    x = np.random.default_rng(3).normal(size=(40, 3))
    for k in (1, 2, 5, 9):
        assert kernels.adjusted_rand(kernels.ward(x, k), plain(x, k)) == 1.0


def test_normalised_information_and_digamma():
    a = np.array([0, 0, 1, 1, 2, 2])
    assert kernels.normalised_information(a, a[::-1].copy()) == pytest.approx(1.0)
    assert kernels.normalised_information(np.zeros(4, int), np.zeros(4, int)) == 1.0
    assert kernels.digamma(1.0) == pytest.approx(-0.5772156649, abs=1e-9)


def test_a_failing_configuration_is_a_row(spark, monkeypatch):
    rows = spark.createDataFrame([(i, [float(i), float(i % 3)]) for i in range(12)], "point long, vector array<double>")
    out = series_kernels.cluster_grid(rows, scalers=("identity", "absent"), dims=(None,), ks=(2,), methods=("ward",))
    got = {r["config"]: r["status"] for r in out.collect()}
    assert got == {"identity_original_ward_2": "success", "absent_original_ward_2": "failed: KeyError"}


def test_deviations_that_only_rounding_tells_apart_are_ties(spark):
    groups = spark.createDataFrame([("negative_share", "g"), ("positive_share", "g"), ("a", "h"), ("b", "h")], "feature string, root string")
    facts = [("negative_share", 0.3), ("positive_share", 0.30000000000000004), ("a", 1e-20), ("b", 2e-20)]
    screened = spark.createDataFrame([(f, "keep_candidate", 0.0, 0.0, std) for f, std in facts], "feature string, status string, missing_rate double, warning_coverage double, std double")
    assert {(r["root"], r["representative"]) for r in screening.representatives(groups, screened).collect()} == {("g", "negative_share"), ("h", "b")}


def test_a_constant_feature_has_no_deviation(spark):
    """The mean of a part of 49 rows, merged, is not one: the deviation was 7e-17, so a constant had a skewness."""
    ids = spark.range(0, 147, 1, 3).withColumn("series_id", F.concat(F.lit("s"), "id"))
    long = ids.select("series_id", F.lit("constant").alias("feature"), (F.col("id") * 0 + 1.0).alias("value"))
    found = screening.feature_quality(long).first()
    assert found["std"] == 0 and found["skew"] is None
    gaps = ids.select("series_id", F.lit("gaps").alias("feature"), F.when(F.col("id") % 49 > 0, F.sin("id")).alias("value"))
    x = ids.select("series_id", F.lit("x").alias("feature"), F.cos("id").alias("value"))
    every = long.unionByName(gaps).unionByName(x)
    pairs = screening.correlated_pairs(every, threshold=0.0).where("feature_1 = 'constant' or feature_2 = 'constant'").collect()
    assert all(r["pearson"] is None and r["spearman"] is None for r in pairs)
    assert all(r["r"] is None for r in screening.pearson_pairs(every).where("feature_1 = 'constant' or feature_2 = 'constant'").collect())
    assert {r["feature"]: r["scaling"] for r in screening.scaling_plan(every).collect()}["constant"] == "standard"


def test_ward_bound(spark, monkeypatch):
    monkeypatch.setattr(series_kernels, "WARD_BYTES", 8 * 10 * 10)
    rows = spark.createDataFrame([(i, [float(i)]) for i in range(12)], "point long, vector array<double>")
    with pytest.raises(ValueError, match="Ward"):
        series_kernels.cluster_grid(rows, methods=("ward",))


def test_selection_falls_back_to_any_ranked(spark):
    rows = [("a", "base", "gmm", 3, 0.5, 0.2, 0.95, 1, 0), ("b", "base", "gmm", 3, None, 0.2, 0.5, 9, 0)]
    m = spark.createDataFrame(rows, "config string, feature_set string, method string, k int, score double, silhouette double, max_share double, min_size int, n_small int")
    assert [r["config"] for r in selection.top_configs(m).collect()] == ["a"]
    assert selection.select_configs(m).count() == 0


def test_sanitise_and_duplicates(spark):
    rows = spark.createDataFrame([("a", float("nan"), 1.0), ("b", float("inf"), 2.0)], "series_id string, x double, y double")
    clean, audit = blocks.sanitise(rows, ["series_id"])
    assert [r["x"] for r in clean.orderBy("series_id").collect()] == [None, None]
    assert {(r["series_id"], r["feature"], r["problem"]) for r in audit.collect()} == {("a", "x", "nan"), ("b", "x", "infinite")}
    twice = blocks.with_flags(rows.union(rows), {})
    with pytest.raises(ValueError, match="several rows"):
        blocks.master({"A": twice})


def test_missing_curated_feature_raises(spark):
    with pytest.raises(ValueError, match="missing features"):
        blocks.final_sets(spark.createDataFrame([("a",)], "series_id string"))


def test_coverage_gate(spark):
    tasks = spark.createDataFrame([("a", 1, 1, "m", 0.5), ("a", 1, 1, "n", None), ("b", 1, 1, "m", 0.5)], "series_id string, horizon int, fold int, model string, rmse double")
    facts = spark.createDataFrame([("a", 1, 1, float("inf")), ("c", 1, 1, 1.0)], "series_id string, horizon int, fold int, x double")
    row = routing.coverage_checks(tasks, facts, ["x"], ["rmse"], 1).first()
    assert (row["missing_features"], row["features_without_metrics"], row["non_finite_features"], row["incomplete_objects"], row["missing_metrics"], row["status"]) == (1, 1, 1, 1, 1, "failed")
    with pytest.raises(ValueError, match="missing_features"):
        routing.meta_dataset(tasks, facts, ["x"], ["rmse"], 1)


def test_split_is_disjoint_and_seeded(spark):
    ids = spark.createDataFrame([(f"s{i}",) for i in range(20)], "series_id string")
    a, b = (sorted(map(tuple, routing.series_split(ids, 7).collect())) for _ in range(2))
    assert a == b and sorted({s for _, s in a}) == ["test", "train", "validation"]
    assert sum(s == "test" for _, s in a) == 4 and sum(s == "validation" for _, s in a) == 2
    with pytest.raises(ValueError, match="several parts"):
        routing.assert_apart(spark.createDataFrame([("a", "train"), ("a", "test")], "series_id string, split string"))


def test_information_finds_the_telling_feature(spark):
    rng = np.random.default_rng(5)
    label = rng.integers(0, 2, 120)
    told = label * 3 + rng.normal(size=120)
    rows = [(str(i), "told", float(told[i])) for i in range(120)] + [(str(i), "noise", float(v)) for i, v in enumerate(rng.normal(size=120))]
    labels = spark.createDataFrame([(str(i), str(v)) for i, v in enumerate(label)], "series_id string, label string")
    got = {r["feature"]: r["information"] for r in meta_models.neighbour_information(spark.createDataFrame(rows, "series_id string, feature string, value double"), labels).collect()}
    assert got["told"] > 0.3 > 0.15 > got["noise"]


def test_failed_fold_fails_its_series(spark):
    rows = [("c", "s", 1, "m", f, 0, 1.0, 0.5, 0.0, 1.0, 0.1, "failed: X" if f == 2 else "success") for f in (1, 2)]
    said = spark.createDataFrame(rows, "candidate string, series_id string, horizon int, model string, fold int, i int, y double, prediction double, train_mean double, train_step double, seconds double, status string")
    known = spark.createDataFrame([("c", "m", "f", "g")], "candidate string, model string, family string, compare_group string")
    row = tuning.candidate_level(said, known).first()
    assert (row["status"], row["mae"], row["notes"]) == ("failed", None, "failed: X")


def test_shortlist_file(spark, tmp_path):
    import yaml

    known = spark.createDataFrame([("c", "m", "f", "r", True), ("d", "m", "f", "r", False)], "candidate string, model string, family string, role string, selected boolean")
    tuning.shortlist_yaml(known, {"c": {"size": 3}}, str(tmp_path / "s.yaml"))
    assert yaml.safe_load((tmp_path / "s.yaml").read_text()) == {"model_overrides": [{"candidate": "c", "model": "m", "family": "f", "role": "r", "settings": {"size": 3}}]}


def test_missing_baseline_rows(spark):
    perf = spark.createDataFrame([("x", 0, 1, "naive_zero", 1.0), ("x", 1, 1, "other", 1.0)], "config string, cluster int, horizon int, model string, rmse_mean double")
    assert [tuple(r) for r in by_cluster.missing_baseline(perf).collect()] == [("x", 1, 1)]


def test_sample_entropy_counts_every_pair():
    def plain(x, m=2):
        tol, n = 0.2 * x.std(ddof=1), len(x)
        near = lambda size, count: sum(np.abs(x[i : i + size] - x[j : j + size]).max() <= tol for i in range(count) for j in range(i))
        b, a = near(m, n - m + 1), near(m + 1, n - m)
        return -math.log(a / b)

    for n in (60, 513, 515):
        x = np.random.default_rng(n).normal(size=n).round(1)
        if n < 100:
            assert kernels.sample_entropy(x) == plain(x)
        t = np.lib.stride_tricks.sliding_window_view(x, 3)
        a = (np.abs(t[:, None] - t[None]).max(axis=2) <= 0.2 * x.std(ddof=1)).sum() - len(t)
        u = np.lib.stride_tricks.sliding_window_view(x, 2)
        b = (np.abs(u[:, None] - u[None]).max(axis=2) <= 0.2 * x.std(ddof=1)).sum() - len(u)
        assert kernels.sample_entropy(x) == pytest.approx(-math.log(a / b))


def test_block_a_equals_its_parts(spark):
    from seriesloom.operators import dependence

    rng = np.random.default_rng(2)
    rows = [(s, i, float(v), n) for s, n in (("a", 300), ("b", 40)) for i, v in enumerate(rng.normal(size=n))]
    data = spark.createDataFrame(rows, "series_id string, rn int, r double, n int")
    got = {r["series_id"]: r for r in blocks.block_a(data).collect()}
    for r in dependence.acf(data).collect():
        assert got[r["series_id"]][f"acf_lag_{r['lag']}"] == pytest.approx(r["acf"], abs=1e-12)
    for r in dependence.ljung_box(data, value=F.abs("r")).collect():
        assert got[r["series_id"]][f"lb_absret_stat_{r['order']}"] == pytest.approx(r["q"], rel=1e-9)
    for r in dependence.integrated_acf(dependence.acf(data)).collect():
        assert got[r["series_id"]][f"iacf_abs_1_{r['up_to']}"] == pytest.approx(r["iacf"], rel=1e-9)
    assert "hurst_rs_too_short" in got["b"]["feature_warning_flags"] and got["b"]["feature_status"] == "warning"


def test_ward_of_more_rows_than_distances_are_held(monkeypatch):
    x = np.random.default_rng(8).normal(size=(300, 4))
    x[40:90] = x[3]  # copies are merged first
    sizes = np.random.default_rng(9).integers(1, 6, 300).astype(float)
    held = [kernels.ward(x, k) for k in (1, 3, 8, 240)] + [kernels.ward(x, 4, sizes)]
    monkeypatch.setattr(kernels, "WARD_HELD", 20)
    sought = [kernels.ward(x, k) for k in (1, 3, 8, 240)] + [kernels.ward(x, 4, sizes)]
    assert [kernels.adjusted_rand(a, b) for a, b in zip(held, sought, strict=True)] == [1.0] * 5


def test_ward_of_thousands_of_rows_holds_no_square_of_them():
    x = np.random.default_rng(10).normal(size=(4000, 3))
    tracemalloc.start()
    merges = kernels.ward_merges(x)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert len(merges) == 3999 and peak < 4000 * 4000 * 8 / 2
    assert (kernels.cut(merges, 4000, 5) == kernels.cut(sorted(kernels._held_merges(x, np.ones(4000))), 4000, 5)).all()


def test_clusters_are_numbered_by_their_smallest_row(monkeypatch):
    x = np.random.default_rng(14).normal(size=(900, 12))
    for held in (2048, 64):
        monkeypatch.setattr(kernels, "WARD_HELD", held)
        own = kernels.ward(x, 6)
        assert (np.diff([np.flatnonzero(own == c)[0] for c in range(6)]) > 0).all()


@pytest.mark.parametrize(("width", "far"), [(3, 1.0), (12, 1.0), (3, 1e4)])
def test_mixtures_equal_the_plain_fit(width, far):
    """Few columns, many columns, and values that sums of products can't hold."""
    rng = np.random.default_rng(15)
    x = (rng.normal(size=(700, width)) + 3 * rng.integers(0, 3, 700)[:, None]) * far + 50
    pick = np.random.default_rng(42).choice(700, 3, replace=False)
    resp, before = np.eye(3)[((x[:, None] - x[pick][None]) ** 2).sum(axis=2).argmin(axis=1)], -np.inf
    for _ in range(100):
        weight = resp.sum(axis=0) + 1e-9
        mean = resp.T @ x / weight[:, None]
        log = np.empty((700, 3))
        for c in range(3):
            spread = ((x - mean[c]) * resp[:, c, None]).T @ (x - mean[c]) / weight[c] + 1e-6 * np.eye(width)
            gap = x - mean[c]
            log[:, c] = np.log(weight[c] / 700) - 0.5 * ((gap * np.linalg.solve(spread, gap.T).T).sum(axis=1) + np.linalg.slogdet(2 * np.pi * spread)[1])
        total = np.logaddexp.reduce(log, axis=1)
        resp = np.exp(log - total[:, None])
        if abs(total.mean() - before) < 1e-4:
            break
        before = total.mean()
    found, chances = kernels.fit_mixture(x, 3, starts=1)
    assert np.allclose(found.means, mean, rtol=1e-6, atol=1e-6 * far) and np.allclose(chances, resp, atol=1e-6)


def test_a_matrix_of_floats_is_held_as_floats(spark, monkeypatch):
    monkeypatch.setattr(series_kernels, "MATRIX_BYTES", 40 * 2 * 4)
    rows = spark.createDataFrame([(i, [float(i % 7), float(i * i % 11)]) for i in range(40)], "point long, vector array<float>")
    got = series_kernels.cluster_grid(rows, scalers=("identity", "quantile"), dims=(2,), ks=(3,))
    assert got.where("status = 'success'").count() == 4 * 40
    with pytest.raises(ValueError, match="too large"):
        series_kernels.cluster_grid(rows.selectExpr("point", "cast(vector as array<double>) as vector"))


def test_a_tree_is_built_once_for_all_numbers_of_clusters(spark):
    rows = spark.createDataFrame([(i, [float(i % 7), float(i * i % 11)]) for i in range(40)], "point long, vector array<double>")
    got = series_kernels.cluster_grid(rows, scalers=("identity",), dims=(None, 2), ks=(2, 3, 5), methods=("gmm", "ward"))
    assert got.rdd.getNumPartitions() == 8  # six mixtures and two trees
    assert {r["config"]: r["n"] for r in got.groupBy("config").agg(F.count_distinct("cluster").alias("n")).where("config like '%ward%'").collect()} == {f"identity_{s}_ward_{k}": k for s in ("original", "pca2") for k in (2, 3, 5)}
    runs = series_kernels.cluster_grid(rows, scalers=("identity",), dims=(None,), ks=(2, 50), methods=("ward",), bootstraps=12)
    assert sorted((r["config"], r["nth"]) for r in runs.collect()) == [("identity_original_ward_2", i) for i in range(1, 13)]
