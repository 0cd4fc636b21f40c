"""Long panels of daily series (series_id, ticker, market, date, close) derived from the order tables.

Prices are summed as whole cents, so an average does not depend on the order of rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

PANEL_COLUMNS = ["series_id", "ticker", "market", "date", "close"]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _daily(rows: DataFrame, prefix: str, ticker, date: str, price: str, market: str) -> DataFrame:
    cents = F.sum(F.round(F.col(price) * 100).cast("long")).cast("double")
    daily = rows.groupBy(ticker.cast("string").alias("ticker"), F.col(date).alias("date")).agg((cents / F.count("*") / 100.0).alias("close"))
    return daily.select(F.concat(F.lit(prefix), "ticker").alias("series_id"), "ticker", F.lit(market).alias("market"), "date", "close")


def price_panel(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Line items by flag and status, orders by priority, events by type, line items by supplier."""
    lines, orders, events = (table(spark, sf_dir, t) for t in ("lineitem", "orders", "events"))
    flags = _daily(lines, "LI:", F.concat("l_returnflag", "l_linestatus"), "l_shipdate", "l_extendedprice", "US")
    priorities = _daily(orders, "OR:", F.col("o_orderpriority"), "o_orderdate", "o_totalprice", "RU")
    kinds = events.select(F.concat(F.lit("EV:"), "event_type").alias("series_id"), F.col("event_type").alias("ticker"), F.lit("RU").alias("market"), F.col("ts").alias("date"), F.col("value").alias("close"))
    suppliers = _daily(lines, "SU:", F.col("l_suppkey"), "l_shipdate", "l_extendedprice", "US")
    return flags.unionByName(priorities).unionByName(kinds).unionByName(suppliers)


def dense_panel(spark: SparkSession, sf_dir: str, groups: int = 150) -> DataFrame:
    """Three times so many series: line items by supplier, by part and by order, each key dealt to groups; for load, at any scale."""
    lines = table(spark, sf_dir, "lineitem")
    parts = [_daily(lines, f"{c[2:].upper()}:", F.col(c) % groups, "l_shipdate", "l_extendedprice", "US") for c in ("l_suppkey", "l_partkey", "l_orderkey")]
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


#: The same panels as DuckDB common table expressions: px (prices), ret (log returns), elig (after the length policy).
PANEL_SQL = """
px AS (
  SELECT 'LI:' || l_returnflag || l_linestatus AS series_id, l_returnflag || l_linestatus AS ticker, 'US' AS market, l_shipdate AS date,
         sum(round(l_extendedprice * 100)::BIGINT)::DOUBLE / count(*) / 100.0 AS close FROM lineitem GROUP BY ALL
  UNION ALL
  SELECT 'OR:' || o_orderpriority, o_orderpriority, 'RU', o_orderdate, sum(round(o_totalprice * 100)::BIGINT)::DOUBLE / count(*) / 100.0 FROM orders GROUP BY ALL
  UNION ALL
  SELECT 'EV:' || event_type, event_type, 'RU', ts, value FROM events
  UNION ALL
  SELECT 'SU:' || l_suppkey, l_suppkey::VARCHAR, 'US', l_shipdate, sum(round(l_extendedprice * 100)::BIGINT)::DOUBLE / count(*) / 100.0 FROM lineitem GROUP BY ALL
), cat AS (
  SELECT series_id, any_value(ticker) AS ticker, any_value(market) AS market, count(*) AS n_rows, min(date) AS first_date, max(date) AS last_date,
         count(*) - count(DISTINCT date) AS n_duplicate_dates, count(*) FILTER (WHERE close IS NULL) AS n_missing_close,
         coalesce(bool_or(close <= 0), false) AS has_nonpositive_close,
         count(*) >= 2 AND count(*) = count(*) FILTER (WHERE close > 0) AS can_compute
  FROM px GROUP BY series_id
), judged AS (
  SELECT *, CASE WHEN has_nonpositive_close THEN 'invalid' WHEN n_rows >= 2000 AND can_compute THEN 'valid_target'
                 WHEN n_rows >= 1500 AND can_compute THEN 'valid_min_only' ELSE 'invalid' END AS status,
         CASE WHEN has_nonpositive_close THEN 'nonpositive_close' WHEN n_rows >= 1500 AND can_compute THEN 'ok'
              WHEN n_rows < 1500 THEN 'too_short' ELSE 'validation_failed' END AS reason
  FROM cat
), steps AS (
  SELECT p.series_id, p.market, p.date, ln(p.close) - lag(ln(p.close)) OVER (PARTITION BY p.series_id ORDER BY p.date, p.close) AS r
  FROM px p JOIN cat c ON p.series_id = c.series_id WHERE c.can_compute
), ret AS (
  SELECT series_id, market, date, r, row_number() OVER (PARTITION BY series_id ORDER BY date) - 1 AS rn, count(*) OVER (PARTITION BY series_id) AS n FROM steps WHERE r IS NOT NULL
), elig AS (
  SELECT series_id, market, date, r, rn - greatest(n - 2000, 0) AS rn, least(n, 2000) AS n, n < 2000 AS short_series FROM ret WHERE n >= 1500 AND rn >= n - 2000
)
"""
