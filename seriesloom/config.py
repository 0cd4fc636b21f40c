"""Stage configurations from YAML: a mapping at the root, files that it extends, the stage's defaults filled in, unknown keys refused.

Every setting of a stage reaches the plans of its queries; there is none that is only recorded.
"""

from __future__ import annotations

import os
from collections.abc import Mapping, Sequence
from dataclasses import dataclass, field, fields
from typing import Any

import yaml

from .sources.files import config_hash

_LENGTHS = {"target": 2000, "minimum": 1500}
_HURST = {"hurst_min": 16, "hurst_max": 256}
_FOLDS = {"horizons": [1, 5, 20], "folds": 3}
#: The queries and default settings of each stage. Fixed values.
STAGES: dict[str, tuple[tuple[str, ...], dict]] = {
    "catalog": (("series_catalog", "catalog_status_counts", "length_distribution", "flag_breakdown"), _LENGTHS),
    "returns": (("log_returns", "last_n_returns", "core_profile_hash", "extended_profile_hash"), _LENGTHS | {"seed": 42}),
    "block_a": (("block_a_features", "block_a_ranges", "block_a_summary"), dict(_HURST)),
    "block_b": (("block_b_features", "block_b_ranges", "block_b_summary"), {}),
    "block_c": (("block_c_features", "block_c_ranges", "block_c_summary"), {"hill_share": 0.05}),
    "block_d": (("block_d_features", "block_d_ranges", "block_d_summary"), {"least_returns": 300}),
    "screening": (("feature_quality", "high_corr_pairs", "screening_status", "screening_notes", "warning_coverage"), {"high_missing": 0.2, "correlated": 0.9, "warning_heavy": 0.3}),
    "consolidation": (("candidate_pool", "corr_groups", "representatives", "consolidated_sets", "scaling_plan"), {"high_missing": 0.2, "correlated": 0.9, "warning_heavy": 0.3}),
    "final_features": (("final_feature_set",), _HURST | {"hill_share": 0.05, "least_returns": 300}),
    "clustering": (("cluster_grid_balance", "assignment_confidence", "bootstrap_stability", "ranking_score", "top_configs"), {"k_min": 2, "k_max": 8, "bootstraps": 30, "seed": 42}),
    "profiling": (("selected_configs", "selected_assignments", "cluster_balance", "cluster_profiles", "key_features", "method_comparison", "profile_heatmap"), {"k_min": 2, "k_max": 8, "max_share": 0.9, "least_size": 5}),
    "forecasting": (("fold_metrics", "series_metrics", "model_summary", "model_ranking", "winners_by_horizon", "speed_summary", "split_metadata"), dict(_FOLDS)),
    "benchmark": (("benchmark_metrics",), _FOLDS | {"models": ["naive_zero", "naive_mean", "ridge_lag"], "model_overrides": {}, "max_fit_seconds": None, "max_predict_seconds": None, "limits": {}}),
    "cluster_analysis": (("shortlist_validation", "cluster_model_perf", "relative_to_baseline", "missing_baseline", "best_model_by_cluster", "clustering_utility", "kruskal_all"), _FOLDS | {"baseline": "naive_zero"}),
    "tuning": (("candidate_level", "best_by_model", "best_over_horizons", "variant_comparison", "echo_state_tuning"), {}),
    "shortlist": (("shortlist_summary", "family_summary"), {}),
    "leakage": (("fold_leak_violations", "permuted_target_ratio", "window_alignment", "row_order_invariance"), {"folds": 3, "least_ratio": 1.05}),
    "fold_features": (("fold_aware_final_features", "fold_aware_comparison"), {"folds": 3}),
    "routing": (("coverage_checks", "candidate_sets", "candidate_sets_train_only", "routing_classifier", "routing_regression", "routing_multi_ridge", "routing_boosted_classes", "routing_scoring", "routing_top_two", "repeat_summary", "feature_importances", "learned_routing_evaluation"), {"seed": 42, "repeats": 3}),
}


@dataclass(frozen=True)
class StageConfig:
    """Where tables are, what to run, where to write, the length policy (of every stage) and the stage's own settings."""

    tables: str
    output: str
    stage: str = ""
    queries: tuple[str, ...] = ()
    target: int = 2000
    minimum: int = 1500
    format: str = "parquet"
    settings: Mapping = field(default_factory=dict)

    def given(self) -> dict[str, Any]:
        """All that the plans of its queries are made with."""
        return {"target": self.target, "minimum": self.minimum, **self.settings}

    def identity(self) -> str:
        return config_hash({f.name: getattr(self, f.name) for f in fields(self)})


def merged(below: Mapping[str, Any], above: Mapping[str, Any]) -> dict[str, Any]:
    """Both mappings; where both have a mapping these are merged, else the upper value stands."""
    out = dict(below)
    for k, v in above.items():
        out[k] = merged(out[k], v) if isinstance(out.get(k), Mapping) and isinstance(v, Mapping) else v
    return out


def read_yaml(path: str, seen: tuple[str, ...] = ()) -> dict[str, Any]:
    """The file's mapping over those of the files that it ``extends`` (a path or a list, beside the file), the later over the earlier."""
    path = os.path.abspath(path)
    if path in seen:
        raise ValueError(f"{path}: extends itself")
    with open(path, encoding="utf-8") as f:
        root = yaml.safe_load(f)
    if not isinstance(root, dict):
        raise ValueError(f"{path}: a mapping is expected at the root")
    below = root.pop("extends", None) or []
    out: dict[str, Any] = {}
    for other in [below] if isinstance(below, str) else below:
        out = merged(out, read_yaml(os.path.join(os.path.dirname(path), other), (*seen, path)))
    return merged(out, root)


def shortlisted(path: str, candidates: Sequence[str] = (), keep: Sequence[str] = ()) -> dict[str, Any]:
    """Models, their overrides, and what is missing, from a shortlist's file (see ``tuning.shortlist_yaml``).

    candidates: those to take, all if none is named; keep: models that run besides them with their own settings. Of two candidates of a model
    the later one's settings stand.
    """
    rows = {r["candidate"]: r for r in read_yaml(path).get("model_overrides", [])}
    wanted = list(candidates) or list(rows)
    found = [rows[c] for c in wanted if c in rows]
    models = list(dict.fromkeys([*keep, *(r["model"] for r in found)]))
    return {"models": models, "model_overrides": {r["model"]: dict(r.get("settings") or {}) for r in found}, "missing": sorted(c for c in wanted if c not in rows)}


def load(path: str, overrides: Mapping | None = None) -> StageConfig:
    """A stage's configuration. ``shortlist`` (source, candidates, keep) takes a benchmark's models and overrides from a shortlist's file."""
    values = merged(read_yaml(path), overrides or {})
    short = values.pop("shortlist", None)
    known = {f.name for f in fields(StageConfig)}
    if unknown := set(values) - known:
        raise ValueError(f"{path}: unknown keys {sorted(unknown)}")
    stage, settings = values.get("stage", ""), dict(values.get("settings") or {})
    if short:
        if stage != "benchmark":
            raise ValueError(f"{path}: a shortlist belongs to the stage benchmark")
        given = shortlisted(os.path.join(os.path.dirname(os.path.abspath(path)), short["source"]), short.get("candidates", ()), short.get("keep", ()))
        if given["missing"]:
            raise ValueError(f"{path}: no such candidates {given['missing']}")
        settings = merged({k: given[k] for k in ("models", "model_overrides")}, settings)
    if stage:
        if stage not in STAGES:
            raise ValueError(f"{path}: no such stage {stage!r}")
        names, defaults = STAGES[stage]
        defaults = {k: values.get(k, v) if k in _LENGTHS else v for k, v in defaults.items()}
        if unknown := set(settings) - set(defaults):
            raise ValueError(f"{path}: unknown settings {sorted(unknown)} of stage {stage}")
        settings, values["queries"] = merged(defaults, settings), values.get("queries") or names
    elif settings:
        raise ValueError(f"{path}: settings without a stage")
    values["queries"], values["settings"] = tuple(values.get("queries") or ()), settings
    return StageConfig(**values)
