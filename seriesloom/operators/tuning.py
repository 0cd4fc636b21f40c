"""Tuning of models: candidates' means over horizons, the best of each model, variants side by side, and the final shortlist.

Results are rows (model, family, candidate, compare_group, horizon, status, notes, seconds, mae, rmse, mase, directional_accuracy), a row for
each candidate and horizon.
"""

from __future__ import annotations

import json
from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.columns import divide
from .forecasts import TASK, task_metrics

MEASURES = ["mae", "rmse", "mase", "directional_accuracy", "seconds"]
#: Models that differ in their activation or dynamics only: plain, chaotic, and a further chaotic one. Fixed values.
TRIPLETS = [("esn", "chaotic_esn", "transient_chaotic_esn"), ("vanilla_mlp", "chaotic_mlp", None), ("lstm_forecast", "chaotic_lstm_forecast", None)]


def candidate_level(predictions: DataFrame, candidates: DataFrame) -> DataFrame:
    """Results of candidates from their predictions (columns of a task, and candidate); candidates: (candidate, model, family, compare_group).

    A fold that fails fails its series and horizon; a candidate succeeds on a horizon if any series does.
    """
    bad = F.max(F.when(F.col("status") != "success", 1).otherwise(0)).over(Window.partitionBy("candidate", "series_id", "horizon"))
    rows = predictions.withColumn("_bad", bad)
    tasks = task_metrics(rows.where("_bad = 0"), ["candidate", *TASK]).groupBy("candidate", "horizon", "series_id").agg(*(F.avg(m).alias(m) for m in MEASURES[:-1]))
    good = tasks.groupBy("candidate", "horizon").agg(F.count("*").alias("n_series"), *(F.avg(m).alias(m) for m in MEASURES[:-1]))
    cost = rows.groupBy("candidate", "horizon", "series_id", "fold").agg(F.first("seconds").alias("s"), F.first("status").alias("status"))
    cost = cost.groupBy("candidate", "horizon").agg(F.avg("s").alias("seconds"), F.array_join(F.array_sort(F.collect_set(F.when(F.col("status") != "success", F.col("status")))), "; ").alias("notes"))
    out = cost.join(good, ["candidate", "horizon"], "left").join(candidates, "candidate")
    return out.withColumn("status", F.when(F.coalesce("n_series", F.lit(0)) > 0, "success").otherwise("failed"))


def best_over_horizons(results: DataFrame) -> DataFrame:
    """Each model's best candidate by its means over horizons: those that never failed everywhere first, then error, then name."""
    means = results.groupBy("model", "candidate", "compare_group").agg(*(F.avg(m).alias(m) for m in MEASURES), F.min(F.when(F.col("status") == "success", 0).otherwise(1)).alias("_failed"))
    own = Window.partitionBy("model").orderBy("_failed", F.round("mae", 12).asc_nulls_last(), "candidate")
    best = means.withColumn("_nth", F.row_number().over(own)).where("_nth = 1")
    return best.select("model", "candidate", "compare_group", *MEASURES, F.when(F.col("_failed") == 0, "success").otherwise("failed").alias("status"))


def best_by_model(results: DataFrame) -> DataFrame:
    """Each model's candidate of the least error for each horizon."""
    own = Window.partitionBy("model", "horizon").orderBy(F.round("mae", 12).asc_nulls_last(), "candidate")
    return results.where("status = 'success'").withColumn("_nth", F.row_number().over(own)).where("_nth = 1").drop("_nth")


def compare_variants(results: DataFrame, triplets: Sequence[tuple[str, str, str | None]] = TRIPLETS) -> DataFrame:
    """The best plain candidate of each comparison group and horizon beside the best chaotic ones: errors, times, differences and ratios.

    Groups without the plain or the chaotic model give no row.
    """
    kinds = [(m, base, role) for base, chaotic, other in triplets for m, role in ((base, "base"), (chaotic, "chaotic"), (other, "secondary")) if m]
    roles = F.create_map(*(F.lit(x) for m, _, role in kinds for x in (m, role)))
    bases = F.create_map(*(F.lit(x) for m, base, _ in kinds for x in (m, base)))
    rows = results.where(F.coalesce("compare_group", F.lit("")) != "").withColumns({"role": roles[F.col("model")], "base_model": bases[F.col("model")]}).where("role is not null")
    own = Window.partitionBy("horizon", "compare_group", "model").orderBy(F.round("mae", 12).asc_nulls_last(), "candidate")
    first = rows.withColumn("_nth", F.row_number().over(own)).where("_nth = 1")
    pick = lambda role, c, name: F.max(F.when(F.col("role") == role, F.col(c))).alias(f"{role}_{name}")
    wide = first.groupBy("horizon", "compare_group", "base_model").agg(*(pick(r, c, n) for r in ("base", "chaotic", "secondary") for c, n in (("candidate", "candidate"), ("mae", "mae"), ("seconds", "seconds"))))
    wide = wide.where("base_candidate is not null and chaotic_candidate is not null")
    gap = lambda r: (F.col(f"{r}_mae") - F.col("base_mae")).alias(f"{r}_difference")
    return wide.select("*", gap("chaotic"), gap("secondary"), divide(F.col("chaotic_mae"), F.col("base_mae")).alias("chaotic_ratio"), divide(F.col("chaotic_seconds"), F.col("base_seconds")).alias("time_ratio"))


def shortlist_summary(results: DataFrame, shortlist: DataFrame) -> DataFrame:
    """One row for each shortlisted candidate (candidate, role, rationale): means over horizons, how many succeeded, up to three notes; absent ones say so."""
    means = results.groupBy("candidate").agg(
        F.min("model").alias("model"), F.min("family").alias("family"), F.min("compare_group").alias("compare_group"), *(F.avg(m).alias(m) for m in MEASURES),
        F.count_if(F.col("status") == "success").alias("_good"), F.count("*").alias("_all"),
        F.array_join(F.slice(F.array_sort(F.collect_set(F.when(F.coalesce("notes", F.lit("")) != "", F.col("notes")))), 1, 3), "; ").alias("notes"),
    )
    rows = shortlist.join(means, "candidate", "left")
    status = F.when(F.col("_all").isNull(), "missing_candidate").when(F.col("_good") == F.col("_all"), "success").when(F.col("_good") > 0, "partial_success").otherwise("failed")
    notes = F.when(F.col("_all").isNull(), F.concat(F.lit("candidate="), "candidate", F.lit(" not found"))).otherwise(F.col("notes"))
    return rows.select("candidate", F.coalesce("role", F.lit("unassigned")).alias("role"), "rationale", "model", "family", "compare_group", *MEASURES, status.alias("status"), notes.alias("notes"), F.col("_all").isNotNull().alias("selected"))


def family_summary(summary: DataFrame) -> DataFrame:
    """Each family's candidate of each role, its mean time, and what the chaotic ones cost in error."""
    at = lambda *roles: F.min(F.when(F.col("role").isin(*roles), F.col("candidate")))
    mean = lambda *roles: F.avg(F.when(F.col("role").isin(*roles), F.col("mae")))
    chaotic = ("chaotic_counterpart", "exploratory_chaotic", "nonlinear_specialist")
    return summary.where("family is not null").groupBy("family").agg(
        at("practical_main").alias("best_practical"), at("chaotic_counterpart").alias("best_chaotic"), at("exploratory_chaotic", "nonlinear_specialist").alias("best_exploratory"),
        F.avg("seconds").alias("seconds"), (mean(*chaotic) - mean("practical_main")).alias("chaotic_minus_practical"),
    )


def shortlist_yaml(summary: DataFrame, settings: Mapping[str, Mapping], path: str) -> None:
    """Write the shortlisted candidates with their settings, in the form that a benchmark's ``model_overrides`` takes.

    A shortlist has as many rows as someone has written down, so the driver writes the file.
    """
    import yaml

    rows = summary.where("selected").select("candidate", "model", "family", "role").orderBy("candidate").collect()
    root = {"model_overrides": [{**r.asDict(), "settings": json.loads(json.dumps(dict(settings.get(r["candidate"], {})), default=str))} for r in rows]}
    with open(path, "w", encoding="utf-8") as f:
        yaml.safe_dump(root, f, sort_keys=True)
