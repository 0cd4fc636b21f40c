"""Price files in two layouts, and report bundles.

Files are read with declared types in permissive mode; what does not parse becomes null. The ticker is the file's name.
"""

from __future__ import annotations

import hashlib
import json
from collections.abc import Mapping
from datetime import UTC, datetime
from urllib.parse import unquote

import numpy as np
import yaml
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: Columns by layout; fixed values of the formats.
LAYOUTS = {
    "RU": {"glob": "*_D1.csv", "columns": "datetime string, open string, high string, low string, close string, volume string", "date": "datetime", "suffix": r"_D1\.csv$"},
    "US": {"glob": "*.txt", "columns": "Date string, Open string, High string, Low string, Close string, Volume string, OpenInt string", "date": "Date", "suffix": r"\.[^.]*$"},
}
CANONICAL = ["series_id", "ticker", "market", "date", "open", "high", "low", "close", "volume"]


def read_price_files(spark: SparkSession, folder: str, market: str) -> DataFrame:
    """All files of a market's layout under the folder, in canonical columns."""
    layout = LAYOUTS[market]
    raw = spark.read.schema(layout["columns"]).option("header", True).option("mode", "PERMISSIVE").option("pathGlobFilter", layout["glob"]).csv(folder)
    named = raw.withColumn("ticker", F.regexp_replace(F.col("_metadata.file_name"), layout["suffix"], ""))
    return standardise(named, market, layout["date"])


def standardise(df: DataFrame, market: str, date_col: str = "date") -> DataFrame:
    """Canonical names and types; values that don't parse become null."""
    by_lower = {c.lower(): c for c in df.columns}
    number = lambda n: F.expr(f"try_cast(`{by_lower[n]}` AS DOUBLE)") if n in by_lower else F.lit(None).cast("double")
    date = F.expr(f"try_cast(`{date_col}` AS TIMESTAMP)")
    names = [c for c in CANONICAL if c not in ("series_id", "ticker", "market", "date")]
    return df.select(F.concat_ws(":", F.lit(market), "ticker").alias("series_id"), "ticker", F.lit(market).alias("market"), date.alias("date"), *(number(n).alias(n) for n in names))


def require(df: DataFrame, *columns: str) -> DataFrame:
    if missing := [c for c in columns if c not in df.columns]:
        raise ValueError(f"missing columns: {missing}")
    return df


def read_table(spark: SparkSession, path: str) -> DataFrame:
    """CSV or Parquet by the path's suffix."""
    return spark.read.option("header", True).csv(path) if path.endswith(".csv") else spark.read.parquet(path)


def write_bundle(sheets: Mapping[str, DataFrame], folder: str, readme: Mapping[str, str] | None = None, fmt: str = "parquet") -> None:
    """A report: one table for each sheet, and a readme table that describes them."""
    for name, df in sheets.items():
        writer = df.write.mode("overwrite")
        (writer.option("header", True).csv if fmt == "csv" else writer.parquet)(f"{folder}/{name}")
    if sheets:
        spark = next(iter(sheets.values())).sparkSession
        rows = [(n, (readme or {}).get(n, ""), ",".join(df.columns)) for n, df in sheets.items()]
        spark.createDataFrame(rows, "sheet string, description string, columns string").coalesce(1).write.mode("overwrite").json(f"{folder}/readme")


def config_hash(config: Mapping) -> str:
    """Identity of a configuration: SHA-256 of its sorted JSON."""
    return hashlib.sha256(json.dumps(config, sort_keys=True, default=str).encode()).hexdigest()


def manifest(spark: SparkSession, path: str, stage: str, config: Mapping, **facts) -> None:
    """One JSON row that says what ran, with which configuration and results."""
    row = {"stage": stage, "config_hash": config_hash(config), "written": datetime.now(UTC).isoformat(), "config": json.dumps(config, sort_keys=True, default=str), "facts": json.dumps(facts, default=str)}
    spark.createDataFrame([row]).coalesce(1).write.mode("overwrite").json(path)


def list_files(spark: SparkSession, folder: str, glob: str = "*") -> DataFrame:
    """(path, file) of the files under a folder, empty ones too, by lower-case name. The driver lists them; none is read."""
    paths = spark.read.format("binaryFile").option("pathGlobFilter", glob).load(folder).inputFiles()
    rows = sorted(((p, unquote(p.rsplit("/", 1)[-1])) for p in paths), key=lambda r: (r[1].lower(), r[1]))
    return spark.createDataFrame(rows, "path string, file string")


def with_unreadable(catalog: DataFrame, files: DataFrame, market: str) -> DataFrame:
    """The catalog (series_id, n_rows, status, reason and more), and a row of zeros with status invalid for each file that gave no rows."""
    suffix = LAYOUTS[market]["suffix"]
    ids = files.select(F.concat_ws(":", F.lit(market), F.regexp_replace("file", suffix, "")).alias("series_id"), F.lit(True).alias("_file"))
    both = ids.join(catalog, "series_id", "full_outer")
    lost = F.col("status").isNull()
    filled = {c: F.when(lost, F.lit(0)).otherwise(F.col(c)).alias(c) for c, t in catalog.dtypes if c.startswith("n_") and t in ("int", "bigint")}
    fixed = filled | {"status": F.coalesce("status", F.lit("invalid")).alias("status"), "reason": F.coalesce("reason", F.lit("read_error")).alias("reason")}
    return both.select(*(fixed.get(c, F.col(c)) for c in catalog.columns))


def external_series(rows: DataFrame, minimum: int, series: str = "series_id", date: str = "date", close: str = "close", ordinal: str | None = None) -> DataFrame:
    """(series_id, date, r): log returns of loose tables: values that don't parse or aren't positive go, the last row of a date stays, short series go."""
    parsed = rows.select(F.col(series).alias("series_id"), F.expr(f"try_cast(`{date}` AS TIMESTAMP)").alias("date"), F.expr(f"try_cast(`{close}` AS DOUBLE)").alias("close"), (F.col(ordinal) if ordinal else F.monotonically_increasing_id()).alias("_at"))
    whole = parsed.where("date is not null and close > 0")
    nth = F.row_number().over(Window.partitionBy("series_id", "date").orderBy(F.desc("_at")))
    last = whole.withColumn("_nth", nth).where("_nth = 1")
    own = Window.partitionBy("series_id")
    long = last.withColumn("_n", F.count("*").over(own)).where(F.col("_n") >= minimum)
    step = F.log("close") - F.lag(F.log("close")).over(own.orderBy("date"))
    return long.select("series_id", "date", step.alias("r")).where("r is not null")


#: Ids that a sample by NumPy's generator takes to the driver, at most.
MOST_IDS = 1_000_000


def sample_series(ids: DataFrame, size: int, seed: int = 42) -> DataFrame:
    """So many ids without replacement by NumPy's generator, in their order; there are as many ids as files."""
    held = ids.select("series_id").distinct().limit(MOST_IDS + 1).collect()
    if len(held) > MOST_IDS:
        raise ValueError(f"more than {MOST_IDS} series to sample from")
    names = sorted(r[0] for r in held)
    picked = np.sort(np.random.default_rng(seed).choice(len(names), min(size, len(names)), replace=False))
    return ids.sparkSession.createDataFrame([(names[i],) for i in picked.tolist()], "series_id string")


def select_series(rows: DataFrame, ordinal: str, order: str = "first_n", ids: list[str] | None = None, most: int | None = None) -> DataFrame:
    """Ids in the table's order (ties by id) or sorted, of those named, at most so many."""
    first = rows.groupBy("series_id").agg(F.min(ordinal).alias("_at"))
    first = first.where(F.col("series_id").isin(ids)) if ids else first
    first = first.orderBy(*(["_at"] if order == "first_n" else []), "series_id")
    return (first.limit(most) if most else first).select("series_id")


def restrict(rows: DataFrame, series_ids=None, horizons=None, folds=None, models=None, max_series: int | None = None) -> DataFrame:
    """Rows of the given series, horizons, folds and models; with ``max_series``, of the first series by id."""
    for column, wanted in (("series_id", series_ids), ("horizon", horizons), ("fold", folds), ("model", models)):
        rows = rows.where(F.col(column).isin(list(wanted))) if wanted else rows
    return rows.join(rows.select("series_id").distinct().orderBy("series_id").limit(max_series), "series_id", "left_semi") if max_series else rows


def task_identity(config: Mapping):
    """Column that names a task: series, horizon, model, fold and the configuration's hash."""
    return F.concat_ws("|", "series_id", F.concat(F.lit("h"), F.col("horizon").cast("string")), "model", F.concat(F.lit("f"), F.col("fold").cast("string")), F.lit(f"cfg{config_hash(config)[:12]}"))


def left_to_do(tasks: DataFrame, audit: DataFrame, config: Mapping) -> DataFrame:
    """Tasks that the audit (task_id, status) does not hold as successful under this very configuration."""
    named = tasks.withColumn("task_id", task_identity(config))
    return named.join(audit.where("status = 'success'").select("task_id").distinct(), "task_id", "left_anti")


def latest_manifest(spark: SparkSession, folder: str, stage: str | None = None) -> dict:
    """The newest manifest under a folder by the time that it states (not by its file's), of a stage if one is named."""
    rows = spark.read.option("recursiveFileLookup", True).json(folder)
    rows = rows.where(F.col("stage") == stage) if stage else rows
    found = rows.orderBy(F.desc("written"), "config_hash").limit(1).collect()
    if not found:
        raise ValueError(f"no manifest under {folder}")
    return found[0].asDict()


def write_run(folder: str, stage: str, config: Mapping, tables: Mapping[str, DataFrame]) -> None:
    """A run's bundle: its tables, those that a stage always has (metrics, splits, errors, predictions) named as given, its configuration and a manifest."""
    write_bundle(tables, f"{folder}/tables")
    spark = next(iter(tables.values())).sparkSession
    spark.createDataFrame([(yaml.safe_dump(json.loads(json.dumps(dict(config), default=str)), sort_keys=True),)], "value string").coalesce(1).write.mode("overwrite").text(f"{folder}/config")
    manifest(spark, f"{folder}/manifest", stage, config, tables=sorted(tables))
