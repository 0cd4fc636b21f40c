"""Every query with SQL, on the smallest tables and with a scaled policy, against DuckDB on the same files."""

import duckdb
import pytest

from seriesloom.plans import registry

DIR = "/root/testdata/sf0.01"
TABLES = "region nation customer supplier part orders lineitem events embeddings".split()
#: One query for each family; the driver compares all of them.
SOME = [
    "series_catalog", "duplicate_dates", "core_profile_hash", "last_n_returns", "target_h5", "lag_window_matrix", "split_metadata", "fold_leak_violations", "fold_aware_range_join", "acf_grid", "integrated_acf",
    "ljung_box_stat", "variance_ratio", "hurst_rs", "hurst_dfa", "permutation_entropy", "moors_kurtosis", "hill_index", "ami_lag", "basic_features", "feature_quality", "scaling_plan",
    "key_features", "silhouette", "ari_nmi", "ranking_score", "fold_metrics", "clustering_utility", "kruskal_h", "candidate_sets_train_only", "best_single_global", "per_class_f1", "resume_upsert", "sample_entropy",
    "screening_notes", "representatives", "consolidated_sets", "interpretability", "correlation_prune", "top_configs", "method_comparison", "candidate_level", "best_over_horizons", "shortlist_summary", "block_c_features", "block_c_summary", "meta_dataset_folds", "repeat_summary",
    "external_returns", "selected_series", "restricted_tasks", "tasks_left_to_do", "unreadable_files", "sanitise_audit", "sanitised_rows", "feature_coverage", "conformed_schema", "keep_last_row", "fold_feature_shift",
]


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{DIR}/{t}.parquet')")
    return c


@pytest.mark.parametrize("name", SOME)
def test_equals_sql(spark, duck, name):
    got = registry.all_queries()[name](spark, DIR).toPandas()
    want = duck.execute(registry.all_sql()[name]).df()
    columns = sorted(want.columns)
    assert sorted(got.columns) == columns
    got, want = (d[columns].sort_values(columns).reset_index(drop=True) for d in (got, want))
    assert len(got) == len(want) > 0
    for c in columns:
        assert ((got[c] == want[c]) | (got[c].isna() & want[c].isna())).all(), c


def test_every_sql_has_a_query():
    assert set(registry.all_sql()) <= set(registry.all_queries())
