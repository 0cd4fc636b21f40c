"""Judgement of routes against SQL on their written inputs, and correlations of features with and without gaps."""

import duckdb
import numpy as np
import pytest

from seriesloom.operators import routing, screening

MODELS = ["a", "b", "c"]


@pytest.fixture(scope="module")
def written(spark, tmp_path_factory):
    folder = tmp_path_factory.mktemp("routes")
    rng = np.random.default_rng(8)
    rows = [(f"s{k}", h, "train" if k % 3 else "test", *map(float, rng.random(3).round(2))) for k in range(60) for h in (1, 5)]
    said = []
    for s, h, split, *_ in rows:
        first, second = rng.choice(MODELS, 2, replace=False).tolist()
        if split == "test":
            said.append((s, h, first, second, round(float(rng.random()), 2)))
    a = spark.createDataFrame(rows, "series_id string, horizon int, split string, a double, b double, c double")
    b = spark.createDataFrame(said, "series_id string, horizon int, first string, second string, confidence double")
    for name, df in (("rows", a), ("said", b)):
        df.write.parquet(f"{folder}/{name}")
    return spark.read.parquet(f"{folder}/rows"), spark.read.parquet(f"{folder}/said"), folder


SQL = """WITH r AS (SELECT * FROM read_parquet('{0}/rows/*.parquet')), p AS (SELECT * FROM read_parquet('{0}/said/*.parquet')),
  u AS (UNPIVOT r ON a, b, c INTO NAME model VALUE cost),
  m AS (SELECT horizon, model, avg(cost) AS m FROM u WHERE split = 'train' GROUP BY ALL), bs AS (SELECT horizon, first(model ORDER BY {1} round(m, 12), model) AS single FROM m GROUP BY horizon),
  o AS (SELECT series_id, horizon, first(model ORDER BY {1} cost, model) AS best FROM u WHERE split = 'test' GROUP BY ALL),
  j AS (SELECT o.*, single, first, second, confidence, confidence < 0.4 AS fell, CASE WHEN confidence < 0.4 THEN single ELSE first END AS chosen FROM o JOIN p USING (series_id, horizon) JOIN bs USING (horizon)),
  d AS (SELECT j.*, (SELECT cost FROM u WHERE u.series_id = j.series_id AND u.horizon = j.horizon AND model = chosen) AS achieved, (SELECT cost FROM u WHERE u.series_id = j.series_id AND u.horizon = j.horizon AND model = best) AS oracle,
    (SELECT cost FROM u WHERE u.series_id = j.series_id AND u.horizon = j.horizon AND model = single) AS base FROM j)"""


@pytest.mark.parametrize("low", [True, False])
def test_routes_against_sql(spark, written, low):
    rows, said, folder = written
    judged = routing.judged_routes(rows, said, MODELS, threshold=0.4, low=low)
    sign, order = (1, "") if low else (-1, "-")
    base = SQL.format(folder, order)
    got = {(r.series_id, r.horizon, r.selected_model, r.oracle_model, r.best_single_model, r.hit, r.top2_hit, r.fallback_applied, round(r.improvement, 9), round(r.gap, 9)) for r in judged.collect()}
    want = duckdb.sql(base + f" SELECT series_id, horizon, chosen, best, single, chosen = best, chosen = best OR second = best, fell, round({sign} * (base - achieved), 9), round({sign} * (achieved - oracle), 9) FROM d").fetchall()
    assert got == set(want) and len(got) == 40
    got = {r.horizon: r for r in routing.route_summary(judged).collect()}
    want = duckdb.sql(base + """, l AS (SELECT DISTINCT horizon, model FROM (SELECT horizon, best AS model FROM d UNION SELECT horizon, chosen FROM d)),
      e AS (SELECT l.*, (SELECT count(*) FROM d WHERE d.horizon = l.horizon AND best = model) AS support, (SELECT count(*) FROM d WHERE d.horizon = l.horizon AND chosen = model) AS named, (SELECT count(*) FROM d WHERE d.horizon = l.horizon AND best = model AND chosen = model) AS hits FROM l)
      SELECT horizon, avg(hits / nullif(support, 0)), avg(2 * hits / (support + named)), sum(2 * hits / (support + named) * support) / sum(support), sum(hits) / sum(support) FROM e GROUP BY horizon""").fetchall()
    for h, balanced, macro, weighted, accuracy in want:
        r = got[h]
        assert np.allclose([r.balanced_accuracy, r.macro_f1, r.weighted_f1, r.accuracy, r.hit_rate], [balanced, macro, weighted, accuracy, accuracy]) and r.n_test_objects == 20
    quantiles = {(r.horizon, r.hit): (r.n, r.confidence_q50) for r in routing.confidence_quantiles(judged).collect()}
    want = duckdb.sql(base + " SELECT horizon, chosen = best, count(*), quantile_cont(confidence, 0.5) FROM d GROUP BY ALL").fetchall()
    assert quantiles == {(h, hit): (n, pytest.approx(q)) for h, hit, n, q in want}


def test_repeats_keep_missing_keys(spark, written):
    rows, said, _ = written
    one = routing.route_summary(routing.judged_routes(rows, said, MODELS)).withColumn("candidates", routing.F.lit(None).cast("string"))
    both = one.withColumn("repeat", routing.F.lit(1)).unionByName(one.withColumn("repeat", routing.F.lit(2)).withColumn("achieved", routing.F.col("achieved") + 1))
    got = routing.repeat_aggregates(both, ["horizon", "candidates"]).collect()
    assert len(got) == 2 and all(r.n_repeats == 2 and r.achieved_std == pytest.approx(0.5**0.5) and r.candidates is None and r.fallback_rate_mean == 0 for r in got)


def test_correlations_of_whole_and_gappy_features(spark):
    """Every pair as if it were alone, whether both features are whole or not."""
    rng = np.random.default_rng(9)
    x = rng.normal(size=(50, 5)).round(1)
    x[:, 1] = 3 * x[:, 0] + 1
    x[:, 3] = np.exp(x[:, 2])
    x[7, 4] = np.nan
    x[:, 4] = x[:, 4] + 5 * x[:, 0]
    rows = [(f"s{i}", f"f{j}", None if np.isnan(x[i, j]) else float(x[i, j])) for i in range(50) for j in range(5)] + [(f"s{i}", "same", 2.0) for i in range(50)]
    got = {(r.feature_1, r.feature_2): r for r in screening.correlated_pairs(spark.createDataFrame(rows, "series_id string, feature string, value double"), 0.0).collect()}
    rank = lambda v: np.array([(v < a).sum() + ((v == a).sum() + 1) / 2 for a in v])
    for i in range(5):
        for j in range(i + 1, 5):
            both = ~np.isnan(x[:, i]) & ~np.isnan(x[:, j])
            a, b, r = x[both, i], x[both, j], got[f"f{i}", f"f{j}"]
            assert r.n == both.sum() and r.pearson == pytest.approx(np.corrcoef(a, b)[0, 1]) and r.spearman == pytest.approx(np.corrcoef(rank(a), rank(b))[0, 1])
    assert got["f0", "same"].pearson is None and got["f0", "f1"].relation == "potential_duplicate" and len(got) == 15
    none = screening.correlated_pairs(spark.createDataFrame([], "series_id string, feature string, value double"))
    assert none.count() == 0
