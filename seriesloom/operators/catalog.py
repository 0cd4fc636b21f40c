"""Series catalog: what each series holds, and whether it is long and clean enough."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

TARGET = 2000
MINIMUM = 1500


def series_catalog(prices: DataFrame, target: int = TARGET, minimum: int = MINIMUM) -> DataFrame:
    """One row for each series, with status and reason by the cascade nonpositive, long, minimal, short, failed."""
    positive = F.count(F.when(F.col("close") > 0, 1))
    n = F.count("*")
    facts = prices.groupBy("series_id").agg(
        F.min("ticker").alias("ticker"),
        F.min("market").alias("market"),
        n.alias("n_rows"),
        F.min("date").alias("first_date"),
        F.max("date").alias("last_date"),
        (n - F.count_distinct("date")).alias("n_duplicate_dates"),
        F.count_if(F.col("close").isNull()).alias("n_missing_close"),
        F.coalesce(F.bool_or(F.col("close") <= 0), F.lit(False)).alias("has_nonpositive_close"),
        ((n >= 2) & (n == positive)).alias("can_compute"),
    )
    bad, ok, rows = F.col("has_nonpositive_close"), F.col("can_compute"), F.col("n_rows")
    status = F.when(bad, "invalid").when((rows >= target) & ok, "valid_target").when((rows >= minimum) & ok, "valid_min_only").otherwise("invalid")
    reason = F.when(bad, "nonpositive_close").when((rows >= minimum) & ok, "ok").when(rows < minimum, "too_short").otherwise("validation_failed")
    return facts.withColumns({"status": status, "reason": reason})


def status_counts(catalog: DataFrame) -> DataFrame:
    return catalog.groupBy("market", "status", "reason").agg(F.count("*").alias("n_series"), F.sum("n_rows").alias("n_rows"))


def length_bucket(n: Column, target: int = TARGET, minimum: int = MINIMUM) -> Column:
    return F.when(n < minimum, f"<{minimum}").when(n < target, f"{minimum}-{target - 1}").otherwise(f">={target}")


def length_distribution(catalog: DataFrame, target: int = TARGET, minimum: int = MINIMUM) -> DataFrame:
    return catalog.groupBy(length_bucket(F.col("n_rows"), target, minimum).alias("bucket")).agg(F.count("*").alias("n_series"))


def duplicate_dates(rows: DataFrame, series: str, date: str) -> DataFrame:
    """Dates that a series has more than once."""
    return rows.groupBy(series, date).agg(F.count("*").alias("n")).where("n > 1")


def sort_violations(rows: DataFrame, series: str, ordinal: str, date: str) -> DataFrame:
    """Series whose dates go back, in the order given."""
    before = F.lag(date).over(Window.partitionBy(series).orderBy(ordinal))
    return rows.withColumn("_before", before).groupBy(series).agg(F.count_if(F.col(date) < F.col("_before")).alias("n_backwards"))


def core_profile(catalog: DataFrame, seed: int = 42, most: int | None = None) -> DataFrame:
    """All series of the first market and as many (or ``most``) of the second, drawn by a seeded hash of their ids."""
    ru = catalog.where("market = 'RU'").select("series_id", "market")
    us = catalog.where("market = 'US'").select("series_id", "market")
    drawn = us.withColumn("nth", F.row_number().over(Window.partitionBy("market").orderBy(F.md5(F.concat("series_id", F.lit(f":{seed}"))), "series_id")))
    quota = ru.agg(F.count("*").alias("quota") if most is None else F.lit(most).alias("quota"))
    return drawn.join(F.broadcast(quota)).where("nth <= quota").select("series_id", "market").unionByName(ru)


def resume_upsert(old: DataFrame, new: DataFrame, keys: list[str], ordinal: str) -> DataFrame:
    """Rows of both, the newest for each key: new before old, then the largest ordinal."""
    both = old.withColumn("_src", F.lit(0)).unionByName(new.withColumn("_src", F.lit(1)), allowMissingColumns=True)
    nth = F.row_number().over(Window.partitionBy(*keys).orderBy(F.desc("_src"), F.desc(ordinal)))
    return both.withColumn("_nth", nth).where("_nth = 1").drop("_src", "_nth")


def keep_last_per_date(rows: DataFrame, series: str, date: str, ordinal: str) -> DataFrame:
    """Of rows that share a series and a date, the one with the largest ordinal."""
    nth = F.row_number().over(Window.partitionBy(series, date).orderBy(F.desc(ordinal)))
    return rows.withColumn("_nth", nth).where("_nth = 1").drop("_nth")


def flag_breakdown(rows: DataFrame, flags: str, separator: str = ";") -> DataFrame:
    """How often each warning flag occurs in a column of joined flags."""
    one = rows.select(F.explode(F.split(flags, separator)).alias("flag")).where("flag <> ''")
    return one.groupBy("flag").agg(F.count("*").alias("n"))
