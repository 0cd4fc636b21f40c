"""Feature blocks: one wide row for each series with its measures, warning flags and status; the table of all blocks; curated sets.

Block A is memory, B spectrum and complexity, C distribution and tails, D non-linear dynamics. A flag says why a measure is missing or
odd; any flag turns the status from success to warning, and a series whose kernel fails has status failed.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.columns import missing_to_null
from ..sources.shared import stored
from . import dependence, series_kernels, shape

FLAGS, COUNT, STATUS = "feature_warning_flags", "feature_warning_count", "feature_status"
LEAST_RETURNS = {"A": 3, "B": 8, "C": 4, "D": 300}

#: The curated features by block; fixed values.
BASE_FEATURES = {
    "A": ["hurst_rs", "hurst_dfa", "acf_lag_2", "acf_lag_5", "acf_lag_10", "acf_lag_25", "acf_lag_50", "acf_lag_100", "abs_acf_lag_2", "abs_acf_lag_5", "abs_acf_lag_10", "abs_acf_lag_25", "abs_acf_lag_50", "vr_q10", "lb_ret_stat_50"],
    "B": ["lz_complexity", "permutation_entropy", "spectral_flatness"],
    "C": ["kurtosis", "robust_kurtosis", "tail_ratio_upper", "hill_tail_index"],
}
CHAOS_FEATURES = {"D": ["correlation_dimension", "embedding_dimension", "selected_delay_tau"]}


def with_flags(rows: DataFrame, rules: Mapping[str, Column], failed: Column | None = None) -> DataFrame:
    """The rows with the joined names of the rules that hold, their number, and the status."""
    names = F.array(*(F.when(F.coalesce(bad, F.lit(False)), F.lit(name)) for name, bad in rules.items()))
    out = rows.withColumn("_flags", F.array_compact(names))
    status = F.when(F.size("_flags") > 0, "warning").otherwise("success")
    status = F.when(F.coalesce(failed, F.lit(False)), "failed").otherwise(status) if failed is not None else status
    return out.withColumns({FLAGS: F.array_join("_flags", ";"), COUNT: F.size("_flags"), STATUS: status}).drop("_flags")


def _pivot(long: DataFrame, key: str, value: str, names: Mapping[int, str]) -> DataFrame:
    """A column for each of the known keys."""
    wide = long.groupBy("series_id").pivot(key, list(names)).agg(F.first(value))
    return wide.select("series_id", *(F.col(str(k)).alias(n) for k, n in names.items()))


def _sizes(returns: DataFrame) -> DataFrame:
    return returns.groupBy("series_id").agg(F.count("r").alias("n_obs"))


def _join(parts: Sequence[DataFrame]) -> DataFrame:
    return reduce(lambda a, b: a.join(b, "series_id", "left"), parts)


def block_a(returns: DataFrame, hurst_min: int = dependence.HURST_MIN, hurst_max: int = dependence.HURST_MAX) -> DataFrame:
    """Hurst exponents, autocorrelations of returns and their sizes, their sums, portmanteau statistics, variance ratios."""
    parts = [_sizes(returns), dependence.hurst_rs(returns, hurst_min, hurst_max).withColumnRenamed("hurst", "hurst_rs"), dependence.hurst_dfa(returns, hurst_min, hurst_max).withColumnRenamed("hurst", "hurst_dfa")]
    lags = sorted({*range(1, max(dependence.LJUNG_BOX_ORDERS) + 1), *dependence.ACF_LAGS})
    grid = dependence.acf_arrays(returns, lags, {"_ret": F.col("r"), "_absret": F.abs("r")})
    at = {k: i for i, k in enumerate(lags)}
    columns, n = {}, F.col("n")
    for value, acf, iacf, lb in (("_ret", "acf_lag", "iacf_abs_1", "lb_ret"), ("_absret", "abs_acf_lag", "iacf_absret_1", "lb_absret")):
        r = lambda k, value=value: F.col(value)[at[k]]
        columns |= {f"{acf}_{k}": r(k) for k in dependence.ACF_LAGS}
        columns |= {f"{iacf}_{u}": reduce(lambda a, b: a + b, (F.coalesce(F.abs(r(k)), F.lit(0.0)) for k in dependence.ACF_LAGS if k <= u)) for u in dependence.IACF_UP_TO}
        columns |= {f"{lb}_stat_{m}": n * (n + 2.0) * reduce(lambda a, b: a + b, (F.when(r(k).isNotNull(), r(k) * r(k) / (n - k)).otherwise(0.0) for k in range(1, m + 1))) for m in dependence.LJUNG_BOX_ORDERS}
    wide = grid.select("series_id", *(c.alias(name) for name, c in columns.items()))
    for lb in ("lb_ret", "lb_absret"):
        wide = wide.withColumns({f"_o{m}": F.lit(float(m)) for m in dependence.LJUNG_BOX_ORDERS}).withColumns({f"{lb}_p_{m}": series_kernels.chi2_tail(f"{lb}_stat_{m}", f"_o{m}") for m in dependence.LJUNG_BOX_ORDERS})
    parts.append(wide.drop(*(f"_o{m}" for m in dependence.LJUNG_BOX_ORDERS)))
    parts.append(_pivot(dependence.variance_ratio(returns), "q", "variance_ratio", {q: f"vr_q{q}" for q in dependence.VARIANCE_RATIO_STEPS}))
    rows, n = _join(parts), F.col("n_obs")
    short = n < max(2 * hurst_min, 64)
    rules = {}
    for h in ("hurst_rs", "hurst_dfa"):
        rules |= {f"{h}_too_short": short, f"{h}_unstable": ~short & F.col(h).isNull(), f"{h}_out_of_range": (F.col(h) < 0) | (F.col(h) > 1.5)}
    for q in dependence.VARIANCE_RATIO_STEPS:
        rules |= {f"vr_q{q}_too_short": n <= q + 2, f"vr_q{q}_unstable": (n > q + 2) & F.col(f"vr_q{q}").isNull()}
    for lb in ("lb_ret", "lb_absret"):
        rules[f"{lb}_p_out_of_range"] = reduce(lambda a, b: a | b, ((F.col(f"{lb}_p_{m}") < 0) | (F.col(f"{lb}_p_{m}") > 1) for m in dependence.LJUNG_BOX_ORDERS))
    return with_flags(rows, rules)


def block_b(returns: DataFrame) -> DataFrame:
    """Slope, entropy and flatness of the spectrum, noise of differences, orders, compressibility and regularity."""
    spectral = series_kernels.spectral_features(returns).select("series_id", F.col("slope").alias("spectral_slope"), F.col("entropy").alias("spectral_entropy"), F.col("flatness").alias("spectral_flatness"), F.col("status").alias("_s1"))
    lz = series_kernels.lempel_ziv(returns).select("series_id", F.col("lz").alias("lz_complexity"), F.col("status").alias("_s2"))
    sampen = series_kernels.sample_entropy(returns).select("series_id", F.col("sampen").alias("sample_entropy"), F.col("status").alias("_s3"))
    rows = _join([_sizes(returns), spectral, shape.noise_fn(returns), shape.permutation_entropy(returns), lz, sampen])
    n = F.col("n_obs")
    rules = {
        "series_too_short_for_block_b": n < LEAST_RETURNS["B"], "spectral_slope_nonfinite": F.col("spectral_slope").isNull(), "spectral_entropy_nonfinite": F.col("spectral_entropy").isNull(), "spectral_flatness_nonfinite": F.col("spectral_flatness").isNull(),
        "noise_fn_zero_std": (n > 2) & F.col("noise_fn").isNull(), "perm_entropy_too_short": F.col("permutation_entropy").isNull(), "lz_single_symbol": F.col("lz_complexity").isNull(), "lz_complexity_negative": F.col("lz_complexity") < 0,
        "sampen_nonfinite": F.col("sample_entropy").isNull(),
    }
    failed = reduce(lambda a, b: a | b, (F.coalesce(F.col(c), F.lit("")).startswith("failed") for c in ("_s1", "_s2", "_s3")))
    return with_flags(rows, rules, failed).drop("_s1", "_s2", "_s3")


def block_c(returns: DataFrame, hill_share: float = shape.HILL_SHARE) -> DataFrame:
    """Kurtosis by moments and by octiles, ratios of outer quantiles to quartiles, and the tail index."""
    names = {"moors": "robust_kurtosis", "tail_both": "tail_ratio_symmetric", "tail_up": "tail_ratio_upper", "tail_low": "tail_ratio_lower", "hill": "hill_tail_index"}
    rows = shape.distribution(returns, hill_share).withColumnsRenamed(names)
    n = F.col("n_obs")
    rules = {
        "series_too_short_for_block_c": n < LEAST_RETURNS["C"], "kurtosis_too_short": n < 4, "kurtosis_negative": F.col("kurtosis") < 0, "robust_kurtosis_denominator_near_zero": F.col("robust_kurtosis").isNull(),
        **{f"tail_ratio_{s}_denominator_near_zero": F.col(f"tail_ratio_{s}").isNull() for s in ("symmetric", "upper", "lower")}, **{f"tail_ratio_{s}_negative": F.col(f"tail_ratio_{s}") < 0 for s in ("symmetric", "upper", "lower")},
        "hill_too_short": F.col("hill_tail_index").isNull() & (n < shape.HILL_ROWS), "hill_nonfinite": F.col("hill_tail_index").isNull() & (n >= shape.HILL_ROWS), "hill_tail_index_gt_10": F.col("hill_tail_index") > 10,
    }
    return with_flags(rows, rules)


def block_d(returns: DataFrame, least_returns: int = LEAST_RETURNS["D"]) -> DataFrame:
    """Delay, embedding dimension, correlation dimension, largest Lyapunov exponent and its time; series of enough returns only."""
    sizes = _sizes(returns)
    enough = sizes.where(F.col("n_obs") >= least_returns)
    found = series_kernels.chaos_features(returns.join(enough.select("series_id"), "series_id", "left_semi"))
    timed = shape.lyapunov_time(found.select("series_id", "lyapunov"), "lyapunov").select("series_id", "lyapunov_time", F.col("flag").alias("_time_flag"))
    rows = _join([sizes, found.withColumnsRenamed({"delay": "selected_delay_tau", "dimension": "embedding_dimension", "lyapunov": "largest_lyapunov_exponent", "status": "_kernel"}), timed])
    short = F.col("n_obs") < least_returns
    rules = {
        "series_too_short_for_block_d": short, "tau_fallback_default": F.col("delay_method") == "fallback_default", "fnn_unstable": F.col("dimension_method") == "best_available",
        "correlation_dimension_scaling_fit_failed": ~short & F.col("correlation_dimension").isNull(), "correlation_dimension_negative": F.col("correlation_dimension") < 0, "lyapunov_nonfinite": ~short & F.col("largest_lyapunov_exponent").isNull(),
        **{f: F.col("_time_flag") == f for f in ("lyapunov_time_nonpositive_lle", "lyapunov_time_near_zero_lle")},
    }
    return with_flags(rows, rules, F.coalesce(F.col("_kernel"), F.lit("")).startswith("failed")).drop("_kernel", "_time_flag")


#: Blocks by letter; a caller may register another.
BLOCKS = {"A": block_a, "B": block_b, "C": block_c, "D": block_d}


def measures(rows: DataFrame) -> list[str]:
    """The numeric columns of a block that are measures."""
    return [c for c, t in rows.dtypes if t in ("double", "float", "int", "bigint") and c not in ("n_obs", COUNT)]


def ranges(rows: DataFrame) -> DataFrame:
    """(feature, min, max, mean, median) of each measure."""
    names = measures(rows)
    long = rows.select("series_id", *(F.col(c).cast("double").alias(c) for c in names)).unpivot("series_id", names, "feature", "value")
    return long.groupBy("feature").agg(F.min("value").alias("min"), F.max("value").alias("max"), F.avg("value").alias("mean"), F.median("value").alias("median"))


def summary(rows: DataFrame, out_of_range: Mapping[str, Column] | None = None) -> DataFrame:
    """(fact, n): rows, successes, warnings, missing values of each measure, and rows for which a given condition holds."""
    facts = {"series_total": F.lit(True), "series_successful": F.col(STATUS) == "success", "series_with_warnings": F.col(STATUS) != "success"}
    facts |= {f"nan_{c}": F.col(c).isNull() for c in measures(rows)} | dict(out_of_range or {})
    one = rows.agg(*(F.count_if(F.coalesce(c, F.lit(False))).alias(n) for n, c in facts.items()))
    return one.unpivot([], list(facts), "fact", "n")


def master(blocks: Mapping[str, DataFrame]) -> DataFrame:
    """Full outer join of the blocks, one row for each series: measures, status and flags of each block, and counts of flags.

    A block with two rows for one series raises: that would multiply rows; blocks are stored, since this check reads them too. A name that an earlier block has taken gets the block's letter.
    """
    out, taken = None, {"series_id"}
    for letter, rows in blocks.items():
        rows = stored(rows, f"block-{letter}")
        if not rows.groupBy("series_id").count().where("count > 1").isEmpty():
            raise ValueError(f"block {letter} has several rows for a series")
        names = {c: f"block_{letter}_{ {FLAGS: 'warning_flags', COUNT: 'warning_count', STATUS: 'status'}[c] }" if c in (FLAGS, COUNT, STATUS) else f"{c}__block_{letter}" if c in taken else c for c in rows.columns if c != "series_id"}
        taken |= set(names.values())
        part = rows.withColumnsRenamed(names)
        out = part if out is None else out.join(part, "series_id", "full_outer")
    out = out.na.fill(0, [f"block_{k}_warning_count" for k in blocks]).na.fill("", [f"block_{k}_warning_flags" for k in blocks]).na.fill("missing", [f"block_{k}_status" for k in blocks])
    every = reduce(lambda a, b: a + b, (F.col(f"block_{k}_warning_count") for k in blocks))
    some = reduce(lambda a, b: a + b, (F.when(F.col(f"block_{k}_warning_flags") != "", 1).otherwise(0) for k in blocks))
    return out.withColumns({"overall_warning_count": every, "warning_blocks_count": some})


def final_sets(table: DataFrame, key: Sequence[str] = ("series_id",)) -> tuple[DataFrame, DataFrame]:
    """The curated features of the base set, and those with the chaos features; raises if the table lacks one."""
    base = [f for fs in BASE_FEATURES.values() for f in fs]
    chaos = [f for fs in CHAOS_FEATURES.values() for f in fs]
    if missing := [c for c in (*key, *base, *chaos) if c not in table.columns]:
        raise ValueError(f"missing features: {missing}")
    return table.select(*key, *base), table.select(*key, *base, *chaos)


def sanitise(rows: DataFrame, keys: Sequence[str]) -> tuple[DataFrame, DataFrame]:
    """The rows with NaN and infinities as null, and an audit (keys, feature, problem) of each value so changed."""
    names = [c for c, t in rows.dtypes if t in ("double", "float") and c not in keys]
    long = rows.select(*keys, *(F.col(c).cast("double").alias(c) for c in names)).unpivot(list(keys), names, "feature", "value")
    problem = F.when(F.isnan("value"), "nan").when(F.abs("value") == float("inf"), "infinite")
    audit = long.withColumn("problem", problem).where("problem is not null").drop("value")
    return rows.withColumns({c: missing_to_null(F.col(c)) for c in names}), audit


def fold_features(segments: DataFrame, done: DataFrame | None = None) -> DataFrame:
    """The curated features of each fold's training returns, as of a series of its own; folds in ``done`` are left out, so a run can be resumed."""
    todo = segments if done is None else segments.join(done.select("series_id").distinct(), "series_id", "left_anti")
    return final_sets(master({k: f(todo) for k, f in BLOCKS.items()}))[1]


def compare_features(whole: DataFrame, parts: DataFrame, names: Sequence[str]) -> DataFrame:
    """(feature, n, mean_absolute, median_absolute): how features of training returns differ from those of whole series. parts: series_id is ``whole|fold``."""
    long = lambda df: df.select("series_id", *(F.col(c).cast("double").alias(c) for c in names)).unpivot("series_id", list(names), "feature", "value")
    a = long(whole).withColumnRenamed("value", "full_series")
    b = long(parts).withColumn("series_id", F.regexp_replace("series_id", r"\|[^|]*$", "")).withColumnRenamed("value", "train_only")
    gap = F.abs(F.col("full_series") - F.col("train_only"))
    return b.join(a, ["series_id", "feature"]).groupBy("feature").agg(F.count(gap).alias("n"), F.avg(gap).alias("mean_absolute"), F.median(gap).alias("median_absolute"))


def coverage_summary(rows: DataFrame, expected: int) -> DataFrame:
    """(feature, n, missing, mean, std) of each measure, and a row ``coverage`` that counts the rows against those expected."""
    names = measures(rows)
    long = rows.select("series_id", *(F.col(c).cast("double").alias(c) for c in names)).unpivot("series_id", names, "feature", "value")
    each = long.groupBy("feature").agg(F.count("value").alias("n"), F.count_if(F.col("value").isNull()).alias("missing"), F.avg("value").alias("mean"), F.stddev_samp("value").alias("std"))
    whole = rows.agg(F.lit("coverage").alias("feature"), F.count("*").alias("n"), (F.lit(expected) - F.count("*")).alias("missing"), F.lit(None).cast("double").alias("mean"), F.lit(None).cast("double").alias("std"))
    return each.unionByName(whole)
