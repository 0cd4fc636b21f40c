"""A forecasting benchmark that can be stopped and resumed, with limits of time, an audit, and traces of training.

A task is a series, horizon, model and fold under one configuration. Its row holds everything that it gave: status, times, the
trace of its training, and its predictions as an array. A run appends such rows to a table in waves. So there is no moment at
which a prediction is stored without its audit, whatever a killed run leaves behind: a task's row is there as a whole or not
at all. The next run leaves out the tasks whose newest row under the same configuration hash says success, and does the rest;
a changed setting of one model gives only that model's tasks another hash.

Metrics, splits, errors, speed and resumption are queries over that table.
"""

from __future__ import annotations

import json
import time
from collections.abc import Iterator, Mapping, Sequence
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import models
from ..sources.files import config_hash
from ..sources.shared import exists
from .forecasts import task_metrics
from .returns import FOLDS, WINDOWS
from .series_kernels import as_arrays, spread, windows_of

LEAST_TRAIN = 10
#: Tasks whose rows are given on together.
ROWS = 256
TASK_SCHEMA = (
    "task_id string, config_hash string, run_id string, wave int, written timestamp, series_id string, horizon int, model string, fold int, status string, error_type string, notes string, "
    "n_train long, n_test long, fit_seconds double, predict_seconds double, n_parameters long, stop_reason string, train_loss array<double>, val_loss array<double>, "
    "train_mean double, train_step double, predictions array<struct<i: long, y: double, prediction: double>>"
)
#: The columns of a task's audit row: all but what only its predictions need.
AUDIT = ["task_id", "config_hash", "run_id", "wave", "written", "series_id", "horizon", "model", "fold", "status", "error_type", "notes", "n_train", "n_test", "fit_seconds", "predict_seconds"]


@dataclass(frozen=True)
class Benchmark:
    """What is run: models with their settings, horizons with their windows, folds, and limits of seconds for each model."""

    models: Sequence[str]
    horizons: Sequence[int] = (1, 5, 20)
    folds: int = FOLDS
    windows: Mapping[int, int] = field(default_factory=lambda: dict(WINDOWS))
    settings: Mapping[str, Mapping] = field(default_factory=dict)
    max_fit_seconds: float | None = None
    max_predict_seconds: float | None = None
    limits: Mapping[str, Mapping[str, float]] = field(default_factory=dict)

    def __post_init__(self) -> None:
        for name in self.models:
            models.make(name, **self.settings.get(name, {}))
        if missing := [h for h in self.horizons if h not in self.windows]:
            raise ValueError(f"no window for horizons {missing}")

    def limit(self, model: str, kind: str) -> float | None:
        return self.limits.get(model, {}).get(kind, getattr(self, kind))

    def task_hash(self, model: str, horizon: int) -> str:
        """Identity of all settings that a task's result depends on."""
        limits = {k: self.limit(model, k) for k in ("max_fit_seconds", "max_predict_seconds")}
        return config_hash({"model": model, "settings": dict(self.settings.get(model, {})), "horizon": horizon, "window": self.windows[horizon], "folds": self.folds, **limits})


def fold_places(n: int, folds: int, fold: int) -> tuple[int, int]:
    """(training rows, test rows) of a fold among n windows: folds of equal test parts at the end, each trained on all before it."""
    test = max(1, n // (folds + 1))
    return n - folds * test + (fold - 1) * test, test


def tasks_of(returns: DataFrame, config: Benchmark) -> DataFrame:
    """Every task with its series' returns; series too short for any window have none."""
    kinds = [F.struct(F.lit(m).alias("model"), F.lit(h).alias("horizon"), F.lit(config.windows[h]).alias("window"), F.lit(config.task_hash(m, h)).alias("config_hash")) for m in config.models for h in config.horizons]
    each = as_arrays(returns).select("series_id", "r", F.inline(F.array(*kinds)))
    usable = each.where(F.size("r") - F.col("horizon") - (F.col("horizon") + F.col("window") - 2) >= config.folds + 2)
    folded = usable.withColumn("fold", F.explode(F.sequence(F.lit(1), F.lit(config.folds))))
    task_id = F.concat_ws("|", "series_id", F.concat(F.lit("h"), F.col("horizon").cast("string")), "model", F.concat(F.lit("f"), F.col("fold").cast("string")), F.concat(F.lit("cfg"), F.substring("config_hash", 1, 12)))
    return folded.withColumn("task_id", task_id)


def newest(table: DataFrame) -> DataFrame:
    """One row for each task, the one that was written last."""
    order = Window.partitionBy("task_id", "config_hash").orderBy(F.desc("written"), F.desc("run_id"), F.desc("wave"))
    return table.withColumn("_nth", F.row_number().over(order)).where("_nth = 1").drop("_nth")


def remaining(tasks: DataFrame, table: DataFrame) -> DataFrame:
    """Tasks whose newest row does not say success."""
    done = newest(table.select("task_id", "config_hash", "run_id", "wave", "written", "status")).where("status = 'success'").select("task_id", "config_hash")
    return tasks.join(done, ["task_id", "config_hash"], "left_anti")


def _work(config: Benchmark, run_id: str, wave: int):
    columns = [c.split()[0] for c in TASK_SCHEMA.replace("struct<i: long, y: double, prediction: double>", "x").split(", ")]

    def one(sid: str, r, h: int, window: int, name: str, fold: int) -> dict:
        x, y = windows_of(np.asarray(r, float), h, window)
        at, test = fold_places(len(y), config.folds, fold)
        row: dict = {"status": "success", "error_type": None, "notes": None, "n_train": at, "n_test": test, "predictions": []}
        if at < LEAST_TRAIN:
            return row | {"status": "error", "error_type": "insufficient_data", "notes": f"{at} training rows"}
        fit = at - max(1, int(at * 0.2))
        row |= {"train_mean": float(y[:at].mean()), "train_step": float(np.abs(np.diff(y[:at])).mean())}
        began = time.perf_counter()
        model = None
        try:
            model = models.make(name, **config.settings.get(name, {}))
            model.deadline = models.Deadline(config.limit(name, "max_fit_seconds"))
            model.fit(x[:fit], y[:fit])
            row["fit_seconds"], began = time.perf_counter() - began, time.perf_counter()
            model.deadline = models.Deadline(config.limit(name, "max_predict_seconds"))
            said = np.asarray(model.predict(x[at : at + test]), float)
            row["predict_seconds"] = time.perf_counter() - began
            row["predictions"] = [{"i": at + k, "y": float(a), "prediction": float(p)} for k, (a, p) in enumerate(zip(y[at : at + test], said, strict=True))]
            row["n_parameters"] = models.n_parameters(model)
        except models.OutOfTime as e:
            row |= {"status": "timeout", "error_type": "OutOfTime", "notes": str(e)}
        except Exception as e:  # noqa: BLE001  one task's error is its row, not the job's end
            row |= {"status": "error", "error_type": type(e).__name__, "notes": str(e)[:500]}
        trace = getattr(model, "trace", None) or {}
        return row | {k: trace.get(k) for k in ("stop_reason", "train_loss", "val_loss")}

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for at in range(0, len(pdf), ROWS):
                out = []
                for t in pdf.iloc[at : at + ROWS].itertuples(index=False):
                    found = one(t.series_id, t.r, t.horizon, t.window, t.model, t.fold)
                    key = {"task_id": t.task_id, "config_hash": t.config_hash, "run_id": run_id, "wave": wave, "written": pd.Timestamp.now(tz="UTC"), "series_id": t.series_id, "horizon": t.horizon, "model": t.model, "fold": t.fold}
                    out.append([(key | found).get(c) for c in columns])
                yield pd.DataFrame(out, columns=columns)

    return run


def run_benchmark(returns: DataFrame, folder: str, config: Benchmark, run_id: str, waves: int = 8, stop_after: int | None = None) -> DataFrame:
    """Do what is left of the configuration's tasks and append it to the table in ``folder``; returns that table.

    The tasks are dealt to ``waves``, each of which is one append, so a run that is killed loses at most its last wave. ``stop_after``
    ends it after so many, as a kill would. Defined cases: a series too short for a window has no tasks; a fold of fewer
    than LEAST_TRAIN training rows is an error row; an empty panel or nothing left to do appends no rows.
    """
    spark = returns.sparkSession
    tasks = tasks_of(returns, config).persist()
    try:
        deal = F.pmod(F.xxhash64("series_id", "horizon", "model", "fold"), F.lit(waves))
        for wave in range(waves if stop_after is None else min(stop_after, waves)):
            part = tasks.where(deal == wave)
            if exists(spark, folder):
                part = remaining(part, read_run(spark, folder))
            done = spread(part, "series_id", "horizon", "model", "fold").mapInPandas(_work(config, run_id, wave), TASK_SCHEMA)
            done.write.mode("append").parquet(folder)
    finally:
        tasks.unpersist()
    return read_run(spark, folder)


def read_run(spark, folder: str) -> DataFrame:
    return spark.read.schema(TASK_SCHEMA).parquet(folder)


def audit(table: DataFrame) -> DataFrame:
    """The newest audit row of every task; its scan reads no predictions."""
    return newest(table.select(*AUDIT))


def predictions(table: DataFrame) -> DataFrame:
    """The predictions of successful tasks, in the columns that measures take."""
    keep = ["series_id", "horizon", "model", "fold", "train_mean", "train_step"]
    rows = newest(table).where("status = 'success'")
    seconds = F.coalesce("fit_seconds", F.lit(0.0)) + F.coalesce("predict_seconds", F.lit(0.0))
    return rows.select(*keep, seconds.alias("seconds"), "status", F.inline("predictions"))


def fold_metrics(table: DataFrame) -> DataFrame:
    return task_metrics(predictions(table))


def errors(table: DataFrame) -> DataFrame:
    return audit(table).where(F.col("status").isin("error", "timeout"))


def error_summary(table: DataFrame) -> DataFrame:
    return errors(table).groupBy("model", "error_type").agg(F.count("*").alias("n"))


def resume_summary(table: DataFrame) -> DataFrame:
    """Tasks by the run that did them last and their status."""
    return audit(table).groupBy("run_id", "status").agg(F.count("*").alias("n"))


def run_speed(table: DataFrame) -> DataFrame:
    """Count, mean, median and sum of each model's seconds over tasks that ended well."""
    seconds = F.coalesce("fit_seconds", F.lit(0.0)) + F.coalesce("predict_seconds", F.lit(0.0))
    done = audit(table).where("status = 'success'").select("model", seconds.alias("s"))
    return done.groupBy("model").agg(F.count("*").alias("n"), F.avg("s").alias("mean"), F.median("s").alias("median"), F.sum("s").alias("sum"))


# ---- training audit ----------------------------------------------------------------------------------------------


def training_parameters(spark, config: Benchmark) -> DataFrame:
    """One row for each model: how it is trained, its overrides, and what it is made of."""
    rows = []
    for name in config.models:
        m = models.make(name, **config.settings.get(name, {}))
        trained = isinstance(m, models.Trained)
        size = getattr(m, "hidden", None) or getattr(m, "size", None)
        rows.append((
            name, "neural" if trained else "reservoir" if hasattr(m, "leak") or isinstance(m, models.LogisticNet) else "linear", m.epochs if trained else None, trained and m.patience > 0, m.patience if trained else None,
            m.rate if trained else None, m.batch if trained else None, None if size is None else json.dumps(size), "last_20pct_of_train_no_shuffle" if trained else "unused", trained, getattr(m, "seed", None),
            json.dumps(dict(config.settings.get(name, {})), sort_keys=True), config.limit(name, "max_fit_seconds"),
        ))
    return spark.createDataFrame(rows, "model string, family string, max_epochs int, early_stopping boolean, patience int, rate double, batch int, hidden string, validation string, shuffle boolean, seed int, overrides string, max_fit_seconds double")


def training_diagnoses(table: DataFrame) -> DataFrame:
    """What each successful task's trace says about its training; tasks without epochs have null losses and the verdict ``no_epochs``.

    Verdicts, the first that fits: ``diverged`` (a last loss that is not finite, or a training loss above the first one),
    ``never_improved`` (the first epoch was the best), ``overfitted`` (the last loss on the tail is above the best by a tenth
    or more while the training loss fell), ``stopped_early`` (patience ran out), ``ran_out_of_epochs``.
    """
    rows = newest(table).where("status = 'success'")
    first, last = (lambda c: F.try_element_at(c, F.lit(1))), (lambda c: F.try_element_at(c, F.lit(-1)))
    train, val = F.col("train_loss"), F.col("val_loss")
    best = F.array_min(val)
    facts = rows.select(
        "series_id", "horizon", "model", "fold", F.col("n_parameters"), F.size(val).alias("epochs"), F.array_position(val, best).cast("int").alias("best_epoch"),
        first(train).alias("first_train_loss"), last(train).alias("last_train_loss"), first(val).alias("first_val_loss"), last(val).alias("last_val_loss"), best.alias("best_val_loss"), "stop_reason",
    )
    facts = facts.withColumn("epochs", F.greatest(F.coalesce("epochs", F.lit(0)), F.lit(0)))
    finite = lambda c: ~(F.isnan(c) | (F.abs(c) == float("inf")))
    verdict = (
        F.when(F.col("epochs") == 0, "no_epochs").when(~finite(F.col("last_train_loss")) | ~finite(F.col("last_val_loss")) | (F.col("last_train_loss") > F.col("first_train_loss")), "diverged")
        .when(F.col("best_epoch") == 1, "never_improved").when(F.col("last_val_loss") >= 1.1 * F.col("best_val_loss"), "overfitted").when(F.col("stop_reason") == "patience", "stopped_early").otherwise("ran_out_of_epochs")
    )
    gain = F.try_divide(F.col("first_val_loss") - F.col("best_val_loss"), F.col("first_val_loss"))
    return facts.withColumns({"gain": gain, "gap": F.try_divide("last_val_loss", "last_train_loss"), "verdict": verdict})


def training_audit(table: DataFrame, parameters: DataFrame) -> DataFrame:
    """By model: how it is trained, and how its trainings went."""
    d = training_diagnoses(table)
    share = lambda v: F.avg((F.col("verdict") == v).cast("double")).alias(v)
    verdicts = [share(v) for v in ("diverged", "never_improved", "overfitted", "stopped_early", "ran_out_of_epochs", "no_epochs")]
    went = d.groupBy("model").agg(F.count("*").alias("n_tasks"), F.max("n_parameters").alias("n_parameters"), F.avg("epochs").alias("epochs_mean"), F.avg("best_epoch").alias("best_epoch_mean"), F.avg("gain").alias("gain_mean"), F.median("gap").alias("gap_median"), *verdicts)
    return parameters.join(went, "model", "left")
