"""Queries over feature blocks of the eligible series, their table, ranges, counters and curated sets."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.columns import rounded
from ..operators import blocks, shape
from ..settings import chosen
from ..sources.shared import stored
from .kernel_queries import _segments
from .panel_queries import _CENTRED, PANEL_SQL, eligible, hurst_windows

def _above(name: str, bound: float):
    return lambda: F.col(name) > bound


def _below(name: str, bound: float):
    return lambda: F.col(name) < bound


QUERIES: dict = {}
SQL: dict[str, str] = {}

_C = f"""WITH {PANEL_SQL.strip()}, {_CENTRED.removeprefix("+ ")}, nk AS (SELECT series_id, count(*) AS n_obs, kurtosis(d) AS kurtosis, quantile_cont(d, .01) AS a, quantile_cont(d, .25) AS b, quantile_cont(d, .75) AS e, quantile_cont(d, .99) AS f,
    ((quantile_cont(d, .875) - quantile_cont(d, .625)) + (quantile_cont(d, .375) - quantile_cont(d, .125))) / (quantile_cont(d, .75) - quantile_cont(d, .25)) AS robust_kurtosis FROM c GROUP BY series_id),
  ha AS (SELECT series_id, abs(d) AS a, row_number() OVER (PARTITION BY series_id ORDER BY abs(d) DESC, rn) AS nth, count(*) OVER (PARTITION BY series_id) AS n FROM c WHERE d <> 0), hk AS (SELECT *, least(greatest(5, floor(n * 0.05)::BIGINT), n - 1) AS k FROM ha WHERE n >= 50),
  hi AS (SELECT k.series_id, 1 / avg(ln(k.a / t.a)) AS hill_tail_index FROM hk k JOIN hk t ON k.series_id = t.series_id AND t.nth = t.k + 1 WHERE k.nth <= k.k GROUP BY k.series_id),
  bc AS (SELECT series_id, n_obs, kurtosis, robust_kurtosis, (abs(f) + abs(a)) / (abs(e) + abs(b)) AS tail_ratio_symmetric, f / e AS tail_ratio_upper, abs(a) / abs(b) AS tail_ratio_lower, hill_tail_index FROM nk LEFT JOIN hi USING (series_id)),
  fl AS (SELECT *, list_filter([CASE WHEN kurtosis < 0 THEN 'kurtosis_negative' END, CASE WHEN tail_ratio_upper < 0 THEN 'tail_ratio_upper_negative' END, CASE WHEN hill_tail_index > 10 THEN 'hill_tail_index_gt_10' END], lambda x: x IS NOT NULL) AS flags FROM bc)"""
_MEASURES = ["kurtosis", "robust_kurtosis", "tail_ratio_symmetric", "tail_ratio_upper", "tail_ratio_lower", "hill_tail_index"]


def query(name: str, sql: str | None = None):
    def add(f):
        QUERIES[name] = f
        if sql:
            SQL[name] = sql
        return f

    return add


@query("block_a_features")
def block_a_features(spark, sf_dir):
    return blocks.block_a(eligible(spark, sf_dir), *hurst_windows())


@query("block_b_features")
def block_b_features(spark, sf_dir):
    return blocks.block_b(eligible(spark, sf_dir))


@query("block_c_features", _C + " SELECT series_id, n_obs::BIGINT AS n_obs, " + ", ".join(f"round({m}, 6) + 0.0 AS {m}" for m in _MEASURES) + ", array_to_string(flags, ';') AS feature_warning_flags, len(flags)::INTEGER AS feature_warning_count, CASE WHEN len(flags) > 0 THEN 'warning' ELSE 'success' END AS feature_status FROM fl")
def block_c_features(spark, sf_dir):
    rows = blocks.block_c(eligible(spark, sf_dir), chosen("hill_share", shape.HILL_SHARE))
    return rows.withColumns({m: rounded(F.col(m)) for m in _MEASURES})


@query("block_d_features")
def block_d_features(spark, sf_dir):
    return blocks.block_d(eligible(spark, sf_dir), chosen("least_returns", blocks.LEAST_RETURNS["D"]))


@query("block_c_ranges", _C + ", lc AS (" + " UNION ALL ".join(f"SELECT '{m}' AS feature, {m} AS v FROM bc" for m in _MEASURES) + ") SELECT feature, " + ", ".join(f'round({f}(v), 6) + 0.0 AS "{n}"' for f, n in (("min", "min"), ("max", "max"), ("avg", "mean"), ("median", "median"))) + " FROM lc GROUP BY feature")
def block_c_ranges(spark, sf_dir):
    rows = blocks.ranges(blocks.block_c(eligible(spark, sf_dir), chosen("hill_share", shape.HILL_SHARE)))
    return rows.select("feature", *(rounded(F.col(c)).alias(c) for c in ("min", "max", "mean", "median")))


_FACTS = {"series_total": "true", "series_successful": "len(flags) = 0", "series_with_warnings": "len(flags) > 0"} | {f"nan_{m}": f"{m} IS NULL" for m in _MEASURES} | {"kurtosis_lt_0": "kurtosis < 0", "hill_tail_index_gt_10": "hill_tail_index > 10"}


@query("block_c_summary", _C + " " + " UNION ALL ".join(f"SELECT '{n}' AS fact, (count(*) FILTER (WHERE {c}))::BIGINT AS n FROM fl" for n, c in _FACTS.items()))
def block_c_summary(spark, sf_dir):
    return blocks.summary(blocks.block_c(eligible(spark, sf_dir), chosen("hill_share", shape.HILL_SHARE)), {"kurtosis_lt_0": F.col("kurtosis") < 0, "hill_tail_index_gt_10": F.col("hill_tail_index") > 10})


#: Values that a block's summary counts besides those that are missing, by block.
_OUTLYING = {
    "A": {"hurst_rs_gt_1": _above("hurst_rs", 1.0), "hurst_dfa_gt_1": _above("hurst_dfa", 1.0), "vr_q10_lt_0": _below("vr_q10", 0.0)},
    "B": {"spectral_flatness_gt_1": _above("spectral_flatness", 1.0), "sample_entropy_lt_0": _below("sample_entropy", 0.0)},
    "D": {"correlation_dimension_lt_0": _below("correlation_dimension", 0.0), "largest_lyapunov_exponent_lt_0": _below("largest_lyapunov_exponent", 0.0)},
}


def _tables_of(letter: str, rows) -> None:
    @query(f"block_{letter.lower()}_ranges")
    def block_ranges(spark, sf_dir):
        return blocks.ranges(rows(spark, sf_dir))

    @query(f"block_{letter.lower()}_summary")
    def block_summary(spark, sf_dir):
        return blocks.summary(rows(spark, sf_dir), {name: f() for name, f in _OUTLYING[letter].items()})


for _letter, _rows in (("A", block_a_features), ("B", block_b_features), ("D", block_d_features)):
    _tables_of(_letter, _rows)


def _all(spark, sf_dir):
    """Every block over the eligible series, whose returns are stored: each block reads them several times."""
    data = stored(eligible(spark, sf_dir), "eligible")
    given = {"A": hurst_windows(), "C": (chosen("hill_share", shape.HILL_SHARE),), "D": (chosen("least_returns", blocks.LEAST_RETURNS["D"]),)}
    return {k: f(data, *given.get(k, ())) for k, f in blocks.BLOCKS.items()}


@query("block_master")
def block_master(spark, sf_dir):
    return blocks.master(_all(spark, sf_dir))


@query("final_feature_set")
def final_feature_set(spark, sf_dir):
    return blocks.final_sets(blocks.master(_all(spark, sf_dir)))[1]


@query("fold_aware_final_features")
def fold_aware_final_features(spark, sf_dir):
    return blocks.fold_features(_segments(spark, sf_dir))


@query("fold_aware_comparison")
def fold_aware_comparison(spark, sf_dir):
    names = [f for fs in (blocks.BASE_FEATURES | blocks.CHAOS_FEATURES).values() for f in fs]
    whole = blocks.final_sets(blocks.master(_all(spark, sf_dir)))[1]
    return blocks.compare_features(whole, blocks.fold_features(_segments(spark, sf_dir)), names)
