"""Feature tables: quality, correlated pairs, screening, groups, representatives, scaling.

Features are long rows (series_id, feature, value), so a table of any width is the same plan.
"""

from __future__ import annotations

from statistics import NormalDist

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.columns import average_rank, bias_corrected_skewness, divide, varies
from ..sources.shared import stored
from . import moments

HIGH_MISSING, LOW_STD, FEW_VALUES, CORRELATED, DUPLICATE, WARNING_HEAVY = 0.2, 1e-6, 5, 0.9, 0.98, 0.3


def long_features(wide: DataFrame, key: str = "series_id") -> DataFrame:
    """Every column but the key, unpivoted as doubles."""
    names = [c for c in wide.columns if c != key]
    return wide.select(key, *(F.col(c).cast("double").alias(c) for c in names)).unpivot([key], names, "feature", "value")


def join_blocks(blocks: dict[str, DataFrame], key: str = "series_id") -> DataFrame:
    """Full outer join of feature blocks with a status column for each; names that clash get the block's suffix."""
    out, taken = None, {key}
    for name, df in blocks.items():
        for c in df.columns:
            if c != key and c in taken:
                df = df.withColumnRenamed(c, f"{c}__{name}")
        taken |= set(df.columns)
        df = df.withColumn(f"{name}_status", F.lit("success"))
        out = df if out is None else out.join(df, key, "full_outer")
    return out.withColumns({f"{n}_status": F.coalesce(f"{n}_status", F.lit("missing")) for n in blocks})


def feature_quality(features: DataFrame, high_missing: float = HIGH_MISSING) -> DataFrame:
    """Counts, moments, quartiles and flags of each feature."""
    v = F.col("value")
    q = features.groupBy("feature").agg(
        F.count("*").alias("n_rows"), F.count_if(v.isNull()).alias("n_missing"), F.count_distinct("value").alias("n_unique"),
        F.avg("value").alias("mean"), F.when((F.count("value") > 1) & ~varies(v), 0.0).otherwise(F.stddev_samp("value")).alias("std"), F.min("value").alias("min"), F.max("value").alias("max"),
        F.percentile("value", F.array(F.lit(0.25), F.lit(0.5), F.lit(0.75))).alias("q"), bias_corrected_skewness(v).alias("skew"),
    )
    q = q.withColumns({"q25": F.col("q")[0], "median": F.col("q")[1], "q75": F.col("q")[2], "missing_rate": F.col("n_missing") / F.col("n_rows")}).drop("q")
    return q.withColumns({
        "iqr": F.col("q75") - F.col("q25"),
        "high_missing": F.col("missing_rate") >= high_missing,
        "low_variance": F.coalesce(F.col("std") <= LOW_STD, F.lit(False)),
        "near_constant": F.col("n_unique") <= FEW_VALUES,
    })


PAIR_SCHEMA = "feature_1 string, feature_2 string, n long, pearson double, spearman double"


def _correlation(x: str, y: str):
    """Correlation of two columns; null where one of them is constant."""
    return F.when(varies(F.col(x)) & varies(F.col(y)), divide(F.covar_pop(x, y), F.stddev_pop(x) * F.stddev_pop(y)))


def _whole_pairs(rows: DataFrame, names: list[str], constant: set[str]) -> DataFrame:
    """Correlations of features that every series has: ranked once each, and all products from one pass over a row for each series."""
    ranked = rows.where(F.col("feature").isin(names)).withColumn("rank", average_rank(F.col("value"), "feature"))
    held = F.array_sort(F.collect_list(F.struct("feature", "value", "rank")))
    vectors = ranked.groupBy("series_id").agg(held.alias("h")).select(F.concat(F.transform("h", lambda s: s["value"]), F.transform("h", lambda s: s["rank"].cast("double"))).alias("vector"))
    k = len(names)
    m = moments.moments(vectors, width=2 * k)
    size = np.sqrt(np.diag(m.products))

    def related(i: int, j: int) -> float | None:
        return float(m.products[i, j] / (size[i] * size[j])) if size[i] * size[j] > 0 and not constant & {names[i % k], names[j % k]} else None

    found = [(names[i], names[j], m.n, related(i, j), related(k + i, k + j)) for i in range(k) for j in range(i + 1, k)]
    return rows.sparkSession.createDataFrame(found, PAIR_SCHEMA)


def _gappy_pairs(rows: DataFrame, names: list[str]) -> DataFrame:
    """Correlations of pairs of which one feature at least is among the names, each over the series that have both."""
    gappy = F.col("feature").isin(names)
    a = rows.select("series_id", F.col("feature").alias("feature_1"), F.col("value").alias("x"), gappy.alias("g1"))
    b = rows.select("series_id", F.col("feature").alias("feature_2"), F.col("value").alias("y"), gappy.alias("g2"))
    pairs = a.join(b, "series_id").where("feature_1 < feature_2 and (g1 or g2)")
    ranked = pairs.withColumns({"rx": average_rank(F.col("x"), "feature_1", "feature_2"), "ry": average_rank(F.col("y"), "feature_1", "feature_2")})
    return ranked.groupBy("feature_1", "feature_2").agg(F.count("*").alias("n"), _correlation("x", "y").alias("pearson"), _correlation("rx", "ry").alias("spearman"))


def correlated_pairs(features: DataFrame, threshold: float = CORRELATED) -> DataFrame:
    """Pairs of features (first name smaller) whose Pearson or rank correlation over common rows reaches the threshold.

    Only features with gaps are paired series by series; a feature has one row for each series at most. The features are stored once,
    since several passes read them.
    """
    features = stored(features.select("series_id", "feature", "value"), "features")
    rows = features.where("value is not null")
    finite = F.count_if(~(F.isnan("value") | (F.abs("value") == float("inf"))))
    every = features.agg(F.count_distinct("series_id")).first()[0]
    found = rows.groupBy("feature").agg(finite.alias("n"), varies(F.col("value")).alias("varies")).collect()  # one row a feature
    counts, constant = {r["feature"]: r["n"] for r in found}, {r["feature"] for r in found if not r["varies"]}
    whole, gaps = sorted(f for f, n in counts.items() if n == every), sorted(f for f, n in counts.items() if n != every)
    both = _whole_pairs(rows, whole, constant) if len(whole) > 1 else None
    if gaps or both is None:
        part = _gappy_pairs(rows, gaps)
        both = part if both is None else both.unionByName(part)
    both = both.where("n >= 3")
    strength = F.greatest(F.abs(F.coalesce("pearson", F.lit(0.0))), F.abs(F.coalesce("spearman", F.lit(0.0))))
    relation = F.when(strength >= DUPLICATE, "potential_duplicate").otherwise("strongly_related")
    return both.where(strength >= threshold).withColumn("relation", relation)


def warning_coverage(blocks: dict[str, DataFrame], flags: str = "feature_warning_flags") -> DataFrame:
    """(block, warning_coverage): the share of each block's rows that carry a flag."""
    out = None
    for name, df in blocks.items():
        part = df.agg(F.avg(F.when(F.coalesce(F.trim(flags), F.lit("")) != "", 1.0).otherwise(0.0)).alias("warning_coverage")).select(F.lit(name).alias("block"), "warning_coverage")
        out = part if out is None else out.unionByName(part)
    return out


def screening(quality: DataFrame, pairs: DataFrame, block_of: DataFrame | None = None, coverage: DataFrame | None = None, warning_heavy: float = WARNING_HEAVY) -> DataFrame:
    """A status and notes for each feature: all missing, much missing, hardly varying, heavy with warnings, correlated, or keep.

    block_of: (feature, block); coverage: (block, warning_coverage). Features of block D with many warnings are held in reserve.
    """
    ends = pairs.select(F.col("feature_1").alias("feature"), F.col("feature_2").alias("partner")).union(pairs.select("feature_2", "feature_1"))
    ends = ends.groupBy("feature").agg(F.min("partner").alias("partner"))
    rows = quality.join(ends, "feature", "left").withColumn("correlated", F.col("partner").isNotNull())
    rows = rows.join(block_of, "feature", "left") if block_of is not None else rows.withColumn("block", F.lit(None).cast("string"))
    rows = rows.join(coverage, "block", "left") if coverage is not None else rows.withColumn("warning_coverage", F.lit(0.0))
    heavy = F.coalesce(F.col("warning_coverage") >= warning_heavy, F.lit(False))
    cases = [
        (F.col("missing_rate") >= 0.99, "drop_candidate", F.lit("all values missing")),
        (F.col("high_missing"), "review_high_missing", F.lit("high missingness")),
        (F.col("near_constant") | F.col("low_variance"), "review_low_variance", F.lit("very low variance")),
        (heavy & F.coalesce(F.col("block") == "D", F.lit(False)), "reserve_candidate", F.lit("heavy warning coverage in block D")),
        (heavy, "review_warning_heavy", F.lit("heavy warning coverage")),
        (F.col("correlated"), "review_highly_correlated", F.concat(F.lit("highly correlated with "), "partner")),
    ]
    status, note = F.when(*[(c, F.lit(n)) for c, n, _ in cases[:1]][0]), F.when(cases[0][0], cases[0][2])
    for c, n, t in cases[1:]:
        status, note = status.when(c, n), note.when(c, t)
    rows = rows.withColumns({"status": status.otherwise("keep_candidate"), "note": note.otherwise("no major issues detected")})
    also = F.when(F.col("correlated") & ~F.col("status").isin("review_highly_correlated", "drop_candidate"), F.concat(F.lit("highly correlated with "), "partner"))
    return rows.withColumn("notes", F.concat_ws("; ", "note", also)).drop("note")


INCLUDED = ("keep_candidate", "review_highly_correlated", "reserve_candidate")
EXCLUDED = ("review_high_missing", "review_low_variance", "drop_candidate")


def candidate_pool(screened: DataFrame) -> DataFrame:
    """Whether each feature's status lets it into the pool, and why."""
    inside = F.col("status").isin(*INCLUDED)
    reason = F.when(inside, "included_by_screening_status").when(F.col("status").isin(*EXCLUDED), "excluded_by_screening_status").otherwise("excluded_not_whitelisted")
    return screened.select("feature", "block", "status", inside.alias("included"), reason.alias("reason"))


def interpretability(feature: str = "feature"):
    """How easily a feature is explained, by its name: long lags cost, summaries and spectra gain. The scores are fixed values."""
    name = F.col(feature)
    named = lambda *parts: F.when(F.greatest(*(F.coalesce(F.contains(name, F.lit(p)), F.lit(False)) for p in parts)), 1.0).otherwise(0.0)
    lag = F.expr(f"try_cast(element_at(split({feature}, '_lag_'), -1) AS INT)")
    return (
        F.when(name.startswith("iacf_"), 2.5).otherwise(0.0) - F.when(name.startswith("acf_lag_") | name.startswith("abs_acf_lag_"), 2.0).otherwise(0.0)
        + F.when(name.startswith("lb_"), 0.5).otherwise(0.0) + named("spectral_", "entropy", "kurtosis", "tail_ratio") + named("largest_lyapunov_exponent", "correlation_dimension")
        - F.when(F.contains(name, F.lit("_lag_")) & lag.isNotNull(), F.least(lag / 100.0, F.lit(2.0))).otherwise(0.0)
    )


def consolidated_sets(screened: DataFrame, chosen: DataFrame, groups: DataFrame) -> DataFrame:
    """(set_name, feature, block, status): pooled features outside any group, and one of each group; block D only in the extended set."""
    pool = candidate_pool(screened).where("included").select("feature", "block", "status")
    single = pool.join(groups.select("feature"), "feature", "left_anti")
    picked = pool.join(chosen.select(F.col("representative").alias("feature")), "feature", "left_semi")
    every = single.unionByName(picked)
    sets = F.when(F.coalesce(F.col("block") == "D", F.lit(False)), F.array(F.lit("with_chaos"))).otherwise(F.array(F.lit("base"), F.lit("with_chaos")))
    return every.select(F.explode(sets).alias("set_name"), "feature", "block", "status")


def feature_groups(pairs: DataFrame) -> DataFrame:
    """(feature, root): connected groups of correlated features, named by their smallest member.

    Labels fall along links until none changes; there are as many nodes as the feature table has columns.
    """
    links = pairs.select(F.col("feature_1").alias("a"), F.col("feature_2").alias("b"))
    links = links.union(links.select("b", "a")).collect()
    root: dict[str, str] = {}
    for a, _ in links:
        root.setdefault(a, a)
    changed = True
    while changed:
        changed = False
        for a, b in links:
            if root[b] < root[a]:
                root[a], changed = root[b], True
    return pairs.sparkSession.createDataFrame(list(root.items()), "feature string, root string")


def representatives(groups: DataFrame, screened: DataFrame) -> DataFrame:
    """The member to keep of each group: best status, fewest missing and warnings, largest deviation, easiest to explain, shortest and smallest name."""
    order = {"keep_candidate": 0, "reserve_candidate": 1, "review_highly_correlated": 2}
    rank = F.coalesce(F.create_map(*(F.lit(x) for kv in order.items() for x in kv))[F.col("status")], F.lit(4))
    rows = groups.join(screened, "feature").withColumn("size", F.count("*").over(Window.partitionBy("root")))
    filled = lambda c, x: F.coalesce(F.col(c), F.lit(x))
    # deviations that only rounding tells apart, as those of a share and its complement, are ties
    std = F.format_string("%.11e", filled("std", 0.0)).cast("double")
    own = Window.partitionBy("root").orderBy(rank, filled("missing_rate", 1.0), filled("warning_coverage", 1.0), F.desc(std), F.desc(interpretability()), F.length("feature"), "feature")
    return rows.withColumn("nth", F.row_number().over(own)).where("nth = 1").select("root", "size", F.col("feature").alias("representative"))


def scaling_plan(features: DataFrame) -> DataFrame:
    """How to scale each feature, by skewness and the share of values beyond 1.5 quartile ranges."""
    q = features.groupBy("feature").agg(F.percentile("value", F.array(F.lit(0.25), F.lit(0.75))).alias("q"), bias_corrected_skewness(F.col("value")).alias("skew"))
    low, high = F.col("q")[0], F.col("q")[1]
    rows = features.where("value is not null").join(q, "feature")
    outside = (F.col("value") < low - 1.5 * (high - low)) | (F.col("value") > high + 1.5 * (high - low))
    facts = rows.groupBy("feature").agg(F.avg(F.when(outside, 1.0).otherwise(0.0)).alias("outlier_share"), F.first("skew").alias("skew"))
    steep = F.abs(F.coalesce("skew", F.lit(0.0)))
    plan = F.when((F.col("outlier_share") >= 0.15) | (steep >= 2), "rank").when((F.col("outlier_share") >= 0.05) | (steep >= 1), "robust").otherwise("standard")
    return facts.withColumn("scaling", plan)


def median_impute(features: DataFrame) -> DataFrame:
    medians = features.groupBy("feature").agg(F.median("value").alias("median"))
    return features.join(medians, "feature").select("series_id", "feature", F.coalesce("value", "median").alias("value"), F.col("value").isNull().alias("imputed"))


def robust_scale(features: DataFrame) -> DataFrame:
    """(value - median) / quartile range; a range of zero divides by one."""
    q = features.groupBy("feature").agg(F.percentile("value", F.array(F.lit(0.25), F.lit(0.5), F.lit(0.75))).alias("q"))
    spread = F.col("q")[2] - F.col("q")[0]
    return features.join(q, "feature").select("series_id", "feature", ((F.col("value") - F.col("q")[1]) / F.when(spread == 0, 1.0).otherwise(spread)).alias("scaled"))


def class_information(features: DataFrame, labels: DataFrame, bins: int = 5) -> DataFrame:
    """Mutual information of each feature, in equal bins over its range, with the series' class."""
    own = Window.partitionBy("feature")
    low, high = F.min("value").over(own), F.max("value").over(own)
    rows = features.where("value is not null").join(labels, "series_id")
    place = F.when(high > low, F.least(F.floor((F.col("value") - low) / (high - low) * bins), F.lit(bins - 1))).otherwise(F.lit(0))
    cells = rows.withColumn("bin", place).groupBy("feature", "bin", "label").agg(F.count("*").cast("double").alias("k"))
    cells = cells.withColumns({"n": F.sum("k").over(own), "ki": F.sum("k").over(Window.partitionBy("feature", "bin")), "kj": F.sum("k").over(Window.partitionBy("feature", "label"))})
    return cells.groupBy("feature").agg(F.sum(F.col("k") / F.col("n") * F.log(F.col("k") * F.col("n") / (F.col("ki") * F.col("kj")))).alias("information"))


def pearson_pairs(features: DataFrame) -> DataFrame:
    """(feature_1, feature_2, r): absolute Pearson correlation of every two features over common rows; null where one is constant.

    Each feature also stands with itself, so that a mean over a feature's rows is over all features.
    """
    rows = features.where("value is not null")
    a = rows.select("series_id", F.col("feature").alias("feature_1"), F.col("value").alias("x"))
    b = rows.select("series_id", F.col("feature").alias("feature_2"), F.col("value").alias("y"))
    return a.join(b, "series_id").where("feature_1 <= feature_2").groupBy("feature_1", "feature_2").agg(F.abs(_correlation("x", "y")).alias("r"))


def correlation_prune(features: DataFrame, threshold: float = CORRELATED) -> list[str]:
    """Names that stay when, pair by pair in order of names, of two correlated ones that with the larger mean over all features goes.

    There are as many names as the feature table has columns, so the pairs are read by the driver.
    """
    found = {(r["feature_1"], r["feature_2"]): round(r["r"] or 0.0, 12) for r in pearson_pairs(features).collect()}
    names = sorted({n for k in found for n in k})
    mean = {n: round(sum(v for k, v in found.items() if n in k) / len(names), 12) for n in names}
    gone: set[str] = set()
    for (a, b), v in sorted(found.items()):
        if a != b and v > threshold and a not in gone and b not in gone:
            gone.add(a if mean[a] > mean[b] else b)
    return [n for n in names if n not in gone]


def quantile_normal(features: DataFrame) -> DataFrame:
    """Each value as the normal quantile of its mean rank among the feature's values."""
    @F.pandas_udf("double")
    def probit(p: pd.Series) -> pd.Series:
        return p.map(NormalDist().inv_cdf)

    rows = features.where("value is not null").withColumns({"rank": average_rank(F.col("value"), "feature"), "n": F.count("*").over(Window.partitionBy("feature"))})
    return rows.select("series_id", "feature", probit((F.col("rank") - 0.5) / F.col("n")).alias("normal"))
