"""Registered queries under settings other than their defaults, with their SQL under the same ones."""

from __future__ import annotations

import functools

from ..operators import dependence, routing
from ..settings import using
from . import block_queries, feature_queries, forecast_queries, panel_queries, routing_queries, selection_queries

QUERIES: dict = {}
SQL: dict[str, str] = {}

_LENGTHS = (("2000", "700"), ("1500", "300"))
_TWO_FOLDS = (("- 3 * greatest(1, m // 4)", "- 2 * greatest(1, m // 3)"), ("greatest(1, m // 4)", "greatest(1, m // 3)"), ("(VALUES (1), (2), (3)) k(fold)", "(VALUES (1), (2)) k(fold)"))
_NEW_WINDOWS = ", ".join(f"({w})" for w in dependence.log_windows(8, 64))


def _under(name: str, module, query: str, settings: dict, *changes: tuple[str, str]) -> None:
    run, sql = module.QUERIES[query], module.SQL[query]
    for old, new in changes:
        if old not in sql:
            raise ValueError(f"{query}: its SQL has no {old!r}")
        sql = sql.replace(old, new)

    @functools.wraps(run)
    def changed(spark, sf_dir):
        with using(settings):
            return run(spark, sf_dir)

    QUERIES[name], SQL[name] = changed, sql


_under("catalog_other_lengths", panel_queries, "series_catalog", {"target": 700, "minimum": 300}, *_LENGTHS)
_under("length_distribution_other_lengths", panel_queries, "length_distribution", {"target": 700, "minimum": 300}, ("'1500-1999'", "'300-699'"), ("< 1500", "< 300"), ("< 2000", "< 700"), ("'<1500'", "'<300'"), ("'>=2000'", "'>=700'"))
_under("last_n_returns_other_lengths", panel_queries, "last_n_returns", {"target": 700, "minimum": 300}, *_LENGTHS)
_under("core_profile_other_seed", panel_queries, "core_profile_hash", {"seed": 7}, (":42'", ":7'"))
_under("hurst_rs_other_windows", panel_queries, "hurst_rs", {"hurst_min": 8, "hurst_max": 64}, (panel_queries._WINDOWS, _NEW_WINDOWS))
_under("hill_other_share", panel_queries, "hill_index", {"hill_share": 0.1}, ("0.05", "0.1"))
_under("block_c_other_share", block_queries, "block_c_features", {"hill_share": 0.1}, ("0.05", "0.1"))
_under("feature_quality_other_bound", feature_queries, "feature_quality", {"high_missing": 0.9}, (">= 0.2", ">= 0.9"))
_under("split_metadata_two_folds", panel_queries, "split_metadata", {"folds": 2}, *_TWO_FOLDS)
_under("fold_metrics_two_folds", forecast_queries, "fold_metrics", {"folds": 2, "horizons": [1, 5]}, *_TWO_FOLDS, (" UNION ALL SELECT series_id, market, date, horizon, i, m, y, last FROM v20", ""))
_under("relative_to_other_baseline", forecast_queries, "relative_to_baseline", {"baseline": "naive_mean"}, ("b.model = 'naive_zero'", "b.model = 'naive_mean'"))
_under("repeat_summary_other_seeds", routing_queries, "repeat_summary", {"seed": 7, "repeats": 4}, (str(routing.repeat_seeds(42, 3)), str(routing.repeat_seeds(7, 4))))
_under("selected_configs_other_bounds", selection_queries, "selected_configs", {"max_share": 0.4, "least_size": 40}, ("max_share <= 0.9 AND min_size >= 5", "max_share <= 0.4 AND min_size >= 40"))
