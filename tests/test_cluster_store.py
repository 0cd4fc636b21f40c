"""Stored models give the labels of the fits they came from; condensed Ward equals Ward where features are single rows."""

import duckdb
import numpy as np
import pytest

from seriesloom.functions import kernels
from seriesloom.operators import cluster_store, clusters, series_kernels
from seriesloom.plans import store_queries

MATRIX = "point long, vector array<double>"


def blobs(rng, n, d=5, k=4, spread=0.4):
    centre = rng.normal(0, 6, (k, d))
    own = rng.integers(0, k, n)
    return centre[own] + rng.normal(0, spread, (n, d)), own


def frame(spark, x):
    return spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], MATRIX)


@pytest.mark.parametrize("gaps", [False, True])
def test_labels_are_those_of_the_grid(spark, gaps):
    rng = np.random.default_rng(1)
    x = np.round(blobs(rng, 120)[0], 1)
    if gaps:
        x[3, 1] = x[50, 0] = np.nan
    matrix = frame(spark, x)
    scalers, dims, ks = ("identity", "robust", "quantile"), (None, 2), (2, 4)
    want = {(r.config, r.point): r for r in series_kernels.cluster_grid(matrix, scalers, dims, ks, ("gmm",)).collect()}
    store = cluster_store.fit_store(matrix, series_kernels.grid_configs(scalers, dims, ks, ("gmm",)))
    got = {(r.config, r.point): r for r in cluster_store.label_all(matrix, store).collect()}
    assert got.keys() == want.keys()
    assert all(got[k].cluster == want[k].cluster and abs(got[k].confidence - want[k].confidence) < 1e-6 and abs(got[k].entropy - want[k].entropy) < 1e-6 for k in got)


def test_store_scores_more_rows_than_it_fitted(spark):
    rng = np.random.default_rng(2)
    x, own = blobs(rng, 3000)
    store = cluster_store.fit_store(frame(spark, x), series_kernels.grid_configs(("robust",), (3,), (4,), ("gmm", "ward")), fit_rows=200)
    got = cluster_store.label_all(frame(spark, x), store).toPandas()
    for _, part in got.groupby("config"):
        assert len(part) == 3000 and kernels.adjusted_rand(own, part.sort_values("point").cluster.to_numpy()) > 0.99


def test_failures_are_rows(spark):
    store = cluster_store.fit_store(frame(spark, np.zeros((3, 2))), series_kernels.grid_configs(("identity",), (None,), (2, 3), ("gmm",)))
    assert {r.k: r.status for r in store.collect()} == {2: "success", 3: "failed: ValueError"}
    empty = frame(spark, np.zeros((1, 2))).limit(0)
    assert cluster_store.fit_store(empty, series_kernels.grid_configs(("identity",), (None,), (2,), ("gmm",))).where("status = 'success'").count() == 0


def test_condensed_ward_is_ward_on_few_rows(spark):
    x = blobs(np.random.default_rng(3), 150)[0]
    got = cluster_store.condensed_ward(frame(spark, x), (2, 3, 5), most=150).toPandas()
    for k in (2, 3, 5):
        own = got[got.config == f"condensed_ward_{k}"].sort_values("point").cluster.to_numpy()
        assert kernels.adjusted_rand(kernels.ward(x, k), own) == 1.0


def test_equal_rows_weigh_by_their_number(spark):
    rng = np.random.default_rng(4)
    x = rng.normal(size=(40, 3))
    many = np.vstack([x, np.repeat(x[:5], 30, axis=0)])
    got = cluster_store.condensed_ward(frame(spark, many), (3,), most=60).toPandas().sort_values("point").cluster.to_numpy()
    assert kernels.adjusted_rand(kernels.ward(many, 3), got) == 1.0


def test_condensed_features_keep_the_sums(spark):
    rng = np.random.default_rng(5)
    x, own = blobs(rng, 4000, spread=0.3)
    features = cluster_store.clustering_features(frame(spark, x), most=64, per_task=32).toPandas()
    n, mean = features.n.to_numpy(), np.stack(features["mean"])
    assert len(n) <= 64 and n.sum() == 4000 and np.allclose((n[:, None] * mean).sum(axis=0), x.sum(axis=0))
    total = ((x - x.mean(axis=0)) ** 2).sum()
    assert np.isclose(features.square.sum() + (n[:, None] * (mean - x.mean(axis=0)) ** 2).sum(), total)
    got = cluster_store.condensed_ward(frame(spark, x), (4,), most=64, per_task=32).toPandas().sort_values("point").cluster.to_numpy()
    assert kernels.adjusted_rand(own, got) > 0.99


def test_ten_times_the_bound_of_ward(spark):
    """More rows than Ward's distances may be held for."""
    x, own = blobs(np.random.default_rng(6), 85_000, d=3, spread=0.2)
    matrix = spark.createDataFrame([(i, v) for i, v in enumerate(x.round(4).tolist())], MATRIX).repartition(8)
    with pytest.raises(ValueError, match="Ward holds"):
        series_kernels.cluster_grid(matrix, ("identity",), (None,), (4,), ("ward",))
    got = cluster_store.condensed_ward(matrix, (4,), most=512, per_task=512).toPandas().sort_values("point").cluster.to_numpy()
    assert len(got) == len(x) and kernels.adjusted_rand(own, got) > 0.99
    assert cluster_store.condensed_ward(matrix.limit(0), (2,)).count() == 0


def test_selection_over_fits_against_sql(spark, tmp_path):
    folder = "/root/testdata/sf0.001"
    models, labels = store_queries.fits(spark, folder)
    metrics = store_queries.metrics_of(models, labels)
    metrics.write.parquet(str(tmp_path / "metrics"))
    got = {(r.selection_scope, r.k_bucket, r.feature_set, r.config) for r in store_queries._selected(metrics).collect()}
    want = duckdb.sql(f"""WITH m AS (SELECT * FROM read_parquet('{tmp_path}/metrics/*.parquet') WHERE max_share <= 0.9 AND min_size >= 5)
      SELECT 'overall', 'overall', feature_set, config FROM (SELECT *, row_number() OVER (ORDER BY round(score, 9) DESC, round(silhouette, 9) DESC, config) AS n FROM m) WHERE n = 1
      UNION ALL SELECT 'best_k', k::VARCHAR, feature_set, config FROM (SELECT *, row_number() OVER (PARTITION BY feature_set, k ORDER BY round(score, 9) DESC, round(silhouette, 9) DESC, config) AS n FROM m) WHERE n = 1""").fetchall()
    assert got == set(want) and len(got) > 2
    assert metrics.count() == 28 and {r.method for r in metrics.select("method").distinct().collect()} == {"gmm", "ward"}


def test_silhouette_is_bounded(spark):
    rows = spark.createDataFrame([("c", i, i % 2, [float(i)]) for i in range(30)], "config string, point long, cluster int, vector array<double>")
    with pytest.raises(ValueError, match="all pairs"):
        clusters.silhouette(rows, most=29)
    assert clusters.silhouette(rows, most=30).count() == 1


def test_a_fit_is_of_all_rows(spark):
    """More rows than fits once took: the stored models are those of the grid on all of them."""
    x = np.random.default_rng(13).normal(size=(9000, 2)).astype(np.float32)
    matrix = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "point long, vector array<float>").repartition(4)
    got = {r.method: cluster_store.FittedClustering.read(r.model) for r in cluster_store.fit_store(matrix, series_kernels.grid_configs(("identity",), (None,), (3,), ("gmm", "ward"))).collect()}
    want = kernels.fit_mixture(x.astype(float), 3)[0]
    assert np.allclose(got["gmm"].mixture.means, want.means) and np.allclose(got["gmm"].mixture.factors, want.factors)
    own = kernels.ward(x.astype(float), 3)
    assert np.allclose(got["ward"].centres, [x[own == c].astype(float).mean(axis=0) for c in range(3)])
