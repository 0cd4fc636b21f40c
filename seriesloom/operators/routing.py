"""Routing each series to a model: matrices, candidate sets, the price of a choice, and how to judge a classifier."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.columns import divide


def task_matrix(series: DataFrame, models: Sequence[str], metric: str = "rmse_mean") -> DataFrame:
    """One column for each model; rows with a gap go."""
    return series.groupBy("series_id", "horizon").pivot("model", list(models)).agg(F.avg(metric)).na.drop("any")


def candidate_sets(series: DataFrame, top: int, metric: str = "rmse_mean", low: bool = True, tolerance: float | None = 0.05) -> DataFrame:
    """The best ``top`` models of each horizon by mean, wins and name; with a tolerance, those close to the best come first."""
    value = F.col(metric)
    rows = series.where(value.isNotNull()).select("series_id", "horizon", "model", F.round(value if low else -value, 12).alias("cost"))
    nth = F.row_number().over(Window.partitionBy("series_id", "horizon").orderBy("cost", "model"))
    means = rows.withColumn("nth", nth).groupBy("horizon", "model").agg(F.avg("cost").alias("mean"), F.count_if(F.col("nth") == 1).alias("wins"))
    own = Window.partitionBy("horizon")
    means = means.withColumn("gap", F.col("mean") - F.min("mean").over(own))
    close = F.when(F.col("gap") / F.greatest(F.abs(F.min("mean").over(own)), F.lit(1e-12)) <= tolerance, 1).otherwise(0) if tolerance is not None else F.lit(0)
    means = means.withColumn("close", close)
    order = own.orderBy(F.desc("close"), F.round("gap", 12), F.desc("wins"), "model")
    return means.withColumn("place", F.row_number().over(order)).where(F.col("place") <= top)


def hash_split(ids: DataFrame, test_share: int = 5, seed: int = 42) -> DataFrame:
    """(series_id, split): a fifth of the series to the test by a seeded hash of the id, the same on every engine."""
    digest = F.conv(F.substring(F.md5(F.concat("series_id", F.lit(f":{seed}"))), 1, 8), 16, 10).cast("long")
    return ids.select("series_id", F.when(digest % test_share == 0, "test").otherwise("train").alias("split"))


def best_single(series: DataFrame, split: DataFrame, metric: str = "rmse_mean") -> DataFrame:
    """The model of the smallest training mean, its test mean, and that of an oracle's choices."""
    rows = series.join(split, "series_id")
    train = rows.where("split = 'train'").groupBy("horizon", "model").agg(F.avg(metric).alias("m"))
    pick = train.groupBy("horizon").agg(F.min_by("model", F.struct(F.round("m", 12), "model")).alias("best_model"))
    test = rows.where("split = 'test'")
    oracle = test.groupBy("horizon", "series_id").agg(F.min(metric).alias("v")).groupBy("horizon").agg(F.avg("v").alias("oracle"), F.count("*").alias("n_test"))
    own = test.join(pick, "horizon").where("model = best_model").groupBy("horizon", "best_model").agg(F.avg(metric).alias("achieved"))
    return own.join(oracle, "horizon").withColumn("regret", F.col("achieved") - F.col("oracle"))


def oracle_regret(series: DataFrame, metric: str = "rmse_mean") -> DataFrame:
    """For each model: its mean, the mean of the best choices, and how often it is the best."""
    least = F.min(metric).over(Window.partitionBy("series_id", "horizon"))
    rows = series.withColumn("least", least)
    return rows.groupBy("horizon", "model").agg(F.avg(metric).alias("mean"), F.avg("least").alias("oracle"), (F.avg(metric) - F.avg("least")).alias("regret"), F.avg(F.when(F.col(metric) <= F.col("least"), 1.0).otherwise(0.0)).alias("hit_rate"))


def confidence_fallback(choices: DataFrame, threshold: float) -> DataFrame:
    """The predicted model where the confidence reaches the threshold, else the baseline's."""
    return choices.withColumn("chosen", F.when(F.col("confidence") >= threshold, F.col("predicted")).otherwise(F.col("baseline")))


def confusion(pairs: DataFrame) -> DataFrame:
    return pairs.groupBy("truth", "predicted").agg(F.count("*").alias("n"))


def class_scores(pairs: DataFrame) -> DataFrame:
    """Precision, recall and F1 of each class that is true or predicted somewhere."""
    cells = confusion(pairs)
    true = cells.groupBy(F.col("truth").alias("label")).agg(F.sum("n").alias("support"), F.sum(F.when(F.col("truth") == F.col("predicted"), F.col("n")).otherwise(0)).alias("hits"))
    said = cells.groupBy(F.col("predicted").alias("label")).agg(F.sum("n").alias("predicted"))
    rows = true.join(said, "label", "full_outer").na.fill(0, ["support", "hits", "predicted"])
    precision, recall = (F.coalesce(divide(F.col("hits"), F.col(c)), F.lit(0.0)) for c in ("predicted", "support"))
    f1 = F.coalesce(divide(2 * precision * recall, precision + recall), F.lit(0.0))
    return rows.select("label", "support", precision.alias("precision"), recall.alias("recall"), f1.alias("f1"))


def evaluation(pairs: DataFrame) -> DataFrame:
    """Accuracy, balanced accuracy, macro and weighted F1."""
    s = class_scores(pairs)
    right = F.sum(F.col("recall") * F.col("support"))
    return s.agg(divide(right, F.sum("support")).alias("accuracy"), F.avg(F.when(F.col("support") > 0, F.col("recall"))).alias("balanced_accuracy"), F.avg("f1").alias("macro_f1"), divide(F.sum(F.col("f1") * F.col("support")), F.sum("support")).alias("weighted_f1"))


#: Ids that a split by NumPy's generator takes to the driver, at most; :func:`hash_split` has no bound.
MOST_IDS = 1_000_000


def series_split(ids: DataFrame, seed: int = 42, test: float = 0.2, validation: float = 0.1) -> DataFrame:
    """(series_id, split): sorted ids shuffled by NumPy's generator, cut into test, validation and train. There are as many ids as series."""
    held = ids.select("series_id").distinct().limit(MOST_IDS + 1).collect()
    if len(held) > MOST_IDS:
        raise ValueError(f"more than {MOST_IDS} series; use hash_split")
    names = sorted(r["series_id"] for r in held)
    if len(names) < 3 or test <= 0 or validation < 0 or test + validation >= 1:
        raise ValueError("a split needs three series at least, and shares that leave some to train on")
    names = np.random.default_rng(seed).permutation(np.array(names)).tolist()
    n_test, n_val = max(1, round(len(names) * test)), round(len(names) * validation)
    n_val = max(0, min(n_val, len(names) - n_test - 1))
    rows = [(s, "test" if i < n_test else "validation" if i < n_test + n_val else "train") for i, s in enumerate(names)]
    return ids.sparkSession.createDataFrame(rows, "series_id string, split string")


def assert_apart(split: DataFrame) -> DataFrame:
    """The split, or an error if a series is in two parts."""
    if not split.groupBy("series_id").agg(F.count_distinct("split").alias("n")).where("n > 1").isEmpty():
        raise ValueError("series in several parts of the split")
    return split


def repeat_seeds(base: int, repeats: int) -> list[int]:
    return [base + 9973 * i for i in range(repeats)]


def repeat_summary(rows: DataFrame, keys: Sequence[str], metrics: Sequence[str]) -> DataFrame:
    """Mean and sample deviation of each metric over repeats (column ``repeat``); missing keys are a group."""
    each = [f(m).alias(f"{m}_{n}") for m in metrics for n, f in (("mean", F.avg), ("std", F.stddev_samp))]
    return rows.groupBy(*keys).agg(F.count_distinct("repeat").alias("n_repeats"), *each)


def judged_routes(rows: DataFrame, said: DataFrame, models: Sequence[str], keys: Sequence[str] = ("horizon",), threshold: float | None = None, low: bool = True) -> DataFrame:
    """Every test row's route: what was chosen, what the best single model and the best of all would have cost, and whether the choice was right.

    rows: (series_id, keys..., split, a cost column for each model); said: (series_id, keys..., first, second, confidence) of test rows, the two
    most probable models. Below the threshold of confidence the best single model is taken; that is the one of the best mean over training
    rows of the keys (ties: the order of ``models``). Costs are better when low, or when high.
    """
    sign = 1.0 if low else -1.0
    cost = lambda name: F.element_at(F.map_from_arrays(F.array(*(F.lit(m) for m in models)), F.array(*models)), name)
    mean = F.array(*(F.struct((sign * F.round(F.avg(m), 12)).alias("mean"), F.lit(i).alias("place"), F.lit(m).alias("model")) for i, m in enumerate(models)))
    single = rows.where("split = 'train'").groupBy(*keys).agg(F.array_min(mean)["model"].alias("best_single_model"))
    best = F.array_min(F.array(*(F.struct((sign * F.col(m)).alias("cost"), F.lit(i).alias("place"), F.lit(m).alias("model")) for i, m in enumerate(models))))["model"]
    test = rows.where("split = 'test'").withColumn("oracle_model", best).join(said, ["series_id", *keys]).join(single, list(keys), "left")
    falls = F.lit(False) if threshold is None else F.coalesce(F.col("confidence") < threshold, F.lit(True)) & F.col("best_single_model").isNotNull()
    test = test.withColumn("fallback_applied", falls).withColumn("selected_model", F.when(F.col("fallback_applied"), F.col("best_single_model")).otherwise(F.col("first")))
    test = test.withColumns({"achieved": cost(F.col("selected_model")), "oracle": cost(F.col("oracle_model")), "baseline": cost(F.col("best_single_model"))})
    hit = F.col("selected_model") == F.col("oracle_model")
    return test.select(
        "series_id", *keys, "selected_model", F.col("second").alias("selected_model_top2"), "oracle_model", "best_single_model", "achieved", "oracle", "baseline", (sign * (F.col("baseline") - F.col("achieved"))).alias("improvement"),
        (sign * (F.col("achieved") - F.col("oracle"))).alias("gap"), hit.alias("hit"), (hit | F.coalesce(F.col("second") == F.col("oracle_model"), F.lit(False))).alias("top2_hit"), "confidence", "fallback_applied",
    )


def route_summary(judged: DataFrame, keys: Sequence[str] = ("horizon",)) -> DataFrame:
    """One row by the keys: mean costs and gains, rates of hits and fallbacks, accuracy, balanced accuracy, macro and weighted F1."""
    share = lambda c: F.avg(F.col(c).cast("double"))
    means = judged.groupBy(*keys).agg(
        F.count_distinct("series_id").alias("n_test_series"), F.count("*").alias("n_test_objects"), *(F.avg(c).alias(c) for c in ("achieved", "baseline", "oracle", "improvement", "gap")),
        share("hit").alias("hit_rate"), share("top2_hit").alias("top2_hit_rate"), share("fallback_applied").alias("fallback_rate"),
    )
    pairs = judged.groupBy(*keys, F.col("oracle_model").alias("truth"), F.col("selected_model").alias("said")).agg(F.count("*").alias("n"))
    of = lambda c, name: pairs.groupBy(*keys, F.col(c).alias("label")).agg(F.sum("n").alias(name), F.sum(F.when(F.col("truth") == F.col("said"), F.col("n")).otherwise(0)).alias(f"_{name}"))
    each = of("truth", "support").join(of("said", "named"), [*keys, "label"], "full_outer").na.fill(0, ["support", "named", "_support", "_named"])
    hits = F.greatest("_support", "_named")
    each = each.withColumn("recall", F.when(F.col("support") > 0, hits / F.col("support"))).withColumn("f1", F.coalesce(divide(2.0 * hits, F.col("support") + F.col("named")), F.lit(0.0)))
    scores = each.groupBy(*keys).agg(F.avg("recall").alias("balanced_accuracy"), F.avg("f1").alias("macro_f1"), divide(F.sum(F.col("f1") * F.col("support")), F.sum("support")).alias("weighted_f1"))
    return means.join(scores, list(keys)).withColumn("accuracy", F.col("hit_rate"))


#: The aggregates of repeats: the mean of each, and for the achieved cost its deviation too. Fixed values.
REPEATED = ["achieved", "baseline", "oracle", "improvement", "gap", "hit_rate", "accuracy", "balanced_accuracy", "macro_f1", "weighted_f1", "top2_hit_rate", "fallback_rate"]


def repeat_aggregates(summaries: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Means over repeats (column ``repeat``) of a route summary's measures, with the number of repeats; missing keys are a group of their own."""
    return summaries.groupBy(*keys).agg(F.count_distinct("repeat").alias("n_repeats"), F.stddev_samp("achieved").alias("achieved_std"), *(F.avg(c).alias(f"{c}_mean") for c in REPEATED))


def confidence_quantiles(judged: DataFrame, keys: Sequence[str] = ("horizon",)) -> DataFrame:
    """Quantiles of the confidence of routes that were right and of those that were not, and their mean gap to the best."""
    at = F.percentile("confidence", F.array(*(F.lit(p) for p in (0.1, 0.25, 0.5, 0.75, 0.9))))
    rows = judged.groupBy(*keys, "hit").agg(F.count("*").alias("n"), F.avg("gap").alias("gap_mean"), at.alias("q"))
    return rows.select(*keys, "hit", "n", "gap_mean", *(F.col("q")[i].alias(f"confidence_q{p}") for i, p in enumerate((10, 25, 50, 75, 90))))


OBJECT = ["series_id", "horizon", "fold"]


def coverage_checks(tasks: DataFrame, features: DataFrame, names: Sequence[str], metrics: Sequence[str], expected_folds: int) -> DataFrame:
    """One row of counts that must all be zero before objects (series, horizon, fold) can be routed, and whether they are."""
    objects, held = tasks.select(*OBJECT).distinct(), features.select(*OBJECT).distinct()
    folds = features.groupBy("series_id", "horizon").agg(F.count_distinct("fold").alias("n")).where(F.col("n") != expected_folds)
    bad = lambda c: F.col(c).isNull() | F.isnan(c) | (F.abs(c) == float("inf"))
    cells = features.agg(*(F.count_if(bad(c)).alias(c) for c in names)).select(sum((F.col(c) for c in names), F.lit(0)).cast("long").alias("non_finite_features"))
    models = tasks.groupBy(*OBJECT).agg(F.count_distinct("model").alias("n"), F.count("*").alias("rows"))
    sizes = models.agg(F.max("n").alias("models_per_object"), F.sum(F.col("rows") - F.col("n")).alias("duplicate_metrics"))
    incomplete = models.join(F.broadcast(sizes.select("models_per_object"))).agg(F.count_if(F.col("n") < F.col("models_per_object")).alias("incomplete_objects"))
    nulls = tasks.agg(sum((F.count_if(bad(m)) for m in metrics), F.lit(0)).alias("missing_metrics"))
    parts = [
        objects.join(held, OBJECT, "left_anti").agg(F.count("*").alias("missing_features")), held.join(objects, OBJECT, "left_anti").agg(F.count("*").alias("features_without_metrics")),
        folds.agg(F.count("*").alias("bad_fold_counts")), cells, sizes, incomplete, nulls,
    ]
    one = reduce(lambda a, b: a.join(F.broadcast(b)), parts)  # each is one row
    failing = [c for c in ("missing_features", "bad_fold_counts", "non_finite_features", "duplicate_metrics", "incomplete_objects", "missing_metrics")]
    failed = F.array_compact(F.array(*(F.when(F.col(c) > 0, F.lit(c)) for c in failing)))
    return one.withColumns({"failures": F.array_join(failed, ";"), "status": F.when(F.size(failed) > 0, "failed").otherwise("passed")})


def meta_dataset(tasks: DataFrame, features: DataFrame, names: Sequence[str], metrics: Sequence[str], expected_folds: int) -> DataFrame:
    """Tasks with the features of their object, under ``object_id``; raises if a check of the coverage fails."""
    found = coverage_checks(tasks, features, names, metrics, expected_folds).first()
    if found["status"] != "passed":
        raise ValueError(f"objects can't be routed: {found['failures']}")
    rows = tasks.select(*OBJECT, "model", *metrics).join(features.select(*OBJECT, *names), OBJECT)
    return rows.withColumn("object_id", F.concat(F.col("series_id"), F.lit("|h"), F.col("horizon").cast("string"), F.lit("|f"), F.col("fold").cast("string")))


def scoring_rows(rows: DataFrame, features: Sequence[str], models: Sequence[str]) -> DataFrame:
    """One row for each object and model: the features, the model as columns of zero and one, and its cost. Rows have a cost column for each model."""
    costs = F.array(*(F.struct(F.lit(m).alias("model"), F.col(m).alias("cost")) for m in models))
    keep = [c for c in rows.columns if c not in models]
    long = rows.select(*keep, F.explode(costs).alias("_c")).select(*keep, "_c.model", "_c.cost")
    return long.withColumns({f"model__{m}": F.when(F.col("model") == m, 1.0).otherwise(0.0) for m in models})


def feature_diagnostics(features: DataFrame, expected: DataFrame, names: Sequence[str]) -> DataFrame:
    """(fact, detail, n): missing or infinite cells and constant values by feature, series that lack features, and series that no one asked for."""
    long = features.select("series_id", *(F.col(c).cast("double").alias(c) for c in names)).unpivot("series_id", list(names), "feature", "value")
    value = F.when(F.isnan("value") | (F.abs("value") == float("inf")), None).otherwise(F.col("value"))
    each = long.withColumn("value", value).groupBy("feature").agg(F.count_if(F.col("value").isNull()).alias("gaps"), F.count_distinct("value").alias("kinds"))
    gaps = each.where("gaps > 0").select(F.lit("missing_or_infinite").alias("fact"), F.col("feature").alias("detail"), F.col("gaps").alias("n"))
    flat = each.where("kinds <= 1").select(F.lit("constant").alias("fact"), F.col("feature").alias("detail"), F.col("kinds").alias("n"))
    ids, wanted = features.select("series_id").distinct(), expected.select("series_id").distinct()
    lone = lambda a, b, name: a.join(b, "series_id", "left_anti").select(F.lit(name).alias("fact"), F.col("series_id").alias("detail"), F.lit(1).cast("long").alias("n"))
    return gaps.unionByName(flat).unionByName(lone(wanted, ids, "series_without_features")).unionByName(lone(ids, wanted, "unknown_series"))
