"""Queries over what stages read and resume: loose series, filters of a run, audits, schemas, and changes of fold features."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.columns import conform, rounded
from ..operators import blocks, by_cluster, forecasts
from ..operators.forecasts import TASK
from ..sources import files
from ..sources.panels import PANEL_SQL, table
from ..sources.shared import stored
from .forecast_queries import _TASKS, folded, tasks
from .panel_queries import all_returns

QUERIES: dict = {}
SQL: dict[str, str] = {}


def query(name: str, sql: str):
    def add(f):
        QUERIES[name] = f
        SQL[name] = sql
        return f

    return add


_CUSTOMER_SERIES = """WITH o AS (SELECT o_custkey AS series_id, o_orderdate AS date, o_totalprice AS close, row_number() OVER (PARTITION BY o_custkey, o_orderdate ORDER BY o_orderkey DESC) AS nth FROM orders WHERE o_totalprice > 0),
  l AS (SELECT *, count(*) OVER (PARTITION BY series_id) AS n FROM o WHERE nth = 1), r AS (SELECT series_id, date, ln(close) - lag(ln(close)) OVER (PARTITION BY series_id ORDER BY date) AS r FROM l WHERE n >= 10)
  SELECT series_id, strftime(date, '%Y-%m-%d') AS date, round(r, 6) + 0.0 AS r FROM r WHERE r IS NOT NULL"""


@query("external_returns", _CUSTOMER_SERIES)
def external_returns(spark, sf_dir):
    """Customers' orders as loose series of ten dates at least."""
    rows = files.external_series(table(spark, sf_dir, "orders"), 10, "o_custkey", "o_orderdate", "o_totalprice", "o_orderkey")
    return rows.select("series_id", F.date_format("date", "yyyy-MM-dd").alias("date"), rounded(F.col("r")).alias("r"))


@query("selected_series", "SELECT 'SU:' || l_suppkey AS series_id FROM lineitem GROUP BY l_suppkey ORDER BY min(l_orderkey * 10 + l_linenumber), series_id LIMIT 5")
def selected_series(spark, sf_dir):
    """The first five suppliers in the order of line items: the filter that a run of few series sets."""
    rows = table(spark, sf_dir, "lineitem").select(F.concat(F.lit("SU:"), F.col("l_suppkey").cast("string")).alias("series_id"), (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("at"))
    return files.select_series(rows, "at", most=5)


@query("restricted_tasks", _TASKS + """, rt AS (SELECT * FROM tk WHERE horizon IN (1, 5) AND fold IN (2, 3) AND model IN ('naive_zero', 'naive_mean'))
  SELECT series_id, horizon, model, fold, round(rmse, 6) AS rmse FROM rt WHERE series_id IN (SELECT DISTINCT series_id FROM rt ORDER BY series_id LIMIT 5)""")
def restricted_tasks(spark, sf_dir):
    """The filter of a run: all tasks pass it, those it names stay, of the first five series."""
    rows = files.restrict(tasks(spark, sf_dir), horizons=[1, 5], folds=[2, 3], models=["naive_zero", "naive_mean"], max_series=5)
    return rows.select(*TASK, rounded(F.col("rmse")).alias("rmse"))


_RUN = {"horizons": [1, 5, 20], "folds": 3}


@query("tasks_left_to_do", _TASKS + f" SELECT series_id || '|h' || horizon || '|' || model || '|f' || fold || '|cfg{files.config_hash(_RUN)[:12]}' AS task_id FROM tk WHERE fold > 1")
def tasks_left_to_do(spark, sf_dir):
    """Tasks of a run whose audit has the first fold as done, the second as failed, and the third under another configuration."""
    every = stored(forecasts.naive_tasks(folded(spark, sf_dir)), "tasks")  # names alone: no measure is asked for
    done = every.where("fold <= 2").select(files.task_identity(_RUN).alias("task_id"), F.when(F.col("fold") == 1, "success").otherwise("failed").alias("status"))
    other = every.where("fold = 3").select(files.task_identity({**_RUN, "folds": 4}).alias("task_id"), F.lit("success").alias("status"))
    return files.left_to_do(every, done.unionByName(other), _RUN).select("task_id")


@query("unreadable_files", """WITH c AS (SELECT 'US:' || l_suppkey AS series_id, count(*) AS n_rows FROM lineitem WHERE l_suppkey % 2 = 0 GROUP BY l_suppkey), f AS (SELECT 'US:' || s_suppkey AS series_id FROM supplier)
  SELECT coalesce(f.series_id, c.series_id) AS series_id, coalesce(n_rows, 0)::BIGINT AS n_rows, CASE WHEN n_rows IS NULL THEN 'invalid' ELSE 'valid' END AS status, CASE WHEN n_rows IS NULL THEN 'read_error' ELSE 'ok' END AS reason FROM f FULL JOIN c ON f.series_id = c.series_id""")
def unreadable_files(spark, sf_dir):
    """A file for each supplier, of which those of odd keys gave no rows."""
    name = lambda key: F.col(key).cast("string")
    rows = table(spark, sf_dir, "lineitem").where("l_suppkey % 2 = 0").groupBy(F.concat(F.lit("US:"), name("l_suppkey")).alias("series_id")).agg(F.count("*").alias("n_rows"))
    listed = table(spark, sf_dir, "supplier").select(F.concat(name("s_suppkey"), F.lit(".txt")).alias("file"))
    return files.with_unreadable(rows.withColumns({"status": F.lit("valid"), "reason": F.lit("ok")}), listed, "US")


@query("sanitise_audit", "SELECT c_custkey, 'low' AS feature, 'nan' AS problem FROM customer WHERE c_acctbal < 0 UNION ALL SELECT c_custkey, 'high', 'infinite' FROM customer WHERE c_acctbal > 9000")
def sanitise_audit(spark, sf_dir):
    balance = F.col("c_acctbal").cast("double")
    rows = table(spark, sf_dir, "customer").select("c_custkey", F.when(balance < 0, float("nan")).otherwise(balance).alias("low"), F.when(balance > 9000, float("-inf")).otherwise(balance).alias("high"))
    return blocks.sanitise(rows, ["c_custkey"])[1]


@query("sanitised_rows", "SELECT c_custkey, CASE WHEN c_acctbal >= 0 THEN round(c_acctbal, 2) END AS low, CASE WHEN c_acctbal <= 9000 THEN round(c_acctbal, 2) END AS high FROM customer")
def sanitised_rows(spark, sf_dir):
    balance = F.col("c_acctbal").cast("double")
    rows = table(spark, sf_dir, "customer").select("c_custkey", F.when(balance < 0, float("nan")).otherwise(balance).alias("low"), F.when(balance > 9000, float("inf")).otherwise(balance).alias("high"))
    return blocks.sanitise(rows, ["c_custkey"])[0].select("c_custkey", *(rounded(F.col(c), 2).alias(c) for c in ("low", "high")))


@query("feature_coverage", f"""WITH {PANEL_SQL.strip()}, fc AS (SELECT series_id, avg(r) AS mean_return, stddev_samp(r) AS volatility, CASE WHEN count(*) >= 1500 THEN max(r) END AS largest FROM ret GROUP BY series_id), fl AS (UNPIVOT (SELECT mean_return, volatility, coalesce(largest, 'nan'::DOUBLE) AS largest FROM fc) ON mean_return, volatility, largest INTO NAME feature VALUE v)
  SELECT feature, (count(*) FILTER (WHERE NOT isnan(v)))::BIGINT AS n, (count(*) FILTER (WHERE isnan(v)))::BIGINT AS missing, round(avg(v) FILTER (WHERE NOT isnan(v)), 6) + 0.0 AS mean, round(stddev_samp(v) FILTER (WHERE NOT isnan(v)), 6) AS std FROM fl GROUP BY feature
  UNION ALL SELECT 'coverage', count(*)::BIGINT, ((SELECT count(*) FROM cat) - count(*))::BIGINT, NULL, NULL FROM fc""")
def feature_coverage(spark, sf_dir):
    """Facts of each measure of a feature table, and how many series of the catalog it lacks."""
    from ..sources.panels import price_panel

    size = F.count("*")
    rows = all_returns(spark, sf_dir).groupBy("series_id").agg(F.avg("r").alias("mean_return"), F.stddev_samp("r").alias("volatility"), F.when(size >= 1500, F.max("r")).alias("largest"))
    s = blocks.coverage_summary(rows, price_panel(spark, sf_dir).select("series_id").distinct().count())
    return s.select("feature", "n", "missing", rounded(F.col("mean")).alias("mean"), rounded(F.col("std")).alias("std"))


@query("conformed_schema", "SELECT s_suppkey::BIGINT AS series, s_name AS name, NULL::DOUBLE AS volume FROM (SELECT s_suppkey, s_name FROM supplier)")
def conformed_schema(spark, sf_dir):
    rows = table(spark, sf_dir, "supplier").withColumnsRenamed({"s_suppkey": "series", "s_name": "name"})
    return conform(rows, {"series": "long", "name": "string", "volume": "double"})


@query("keep_last_row", "SELECT o_custkey, o_orderkey, o_orderstatus FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey DESC) AS nth FROM orders) WHERE nth = 1")
def keep_last_row(spark, sf_dir):
    return by_cluster.keep_last(table(spark, sf_dir, "orders").select("o_custkey", "o_orderkey", "o_orderstatus"), ["o_custkey"], "o_orderkey")


@query("fold_feature_shift", _TASKS + """, wh AS (SELECT series_id, avg(y) AS mean_target, stddev_samp(y) AS std_target FROM v5 GROUP BY series_id), pa AS (SELECT series_id, fold, avg(y) AS mean_target, stddev_samp(y) AS std_target FROM fd WHERE part = 'train' AND horizon = 5 GROUP BY ALL),
  gp AS (SELECT 'mean_target' AS feature, abs(w.mean_target - p.mean_target) AS g FROM wh w JOIN pa p USING (series_id) UNION ALL SELECT 'std_target', abs(w.std_target - p.std_target) FROM wh w JOIN pa p USING (series_id))
  SELECT feature, count(g)::BIGINT AS n, round(avg(g), 6) AS mean_absolute, round(median(g), 6) AS median_absolute FROM gp GROUP BY feature""")
def fold_feature_shift(spark, sf_dir):
    """How two features of a fold's training targets differ from those of the whole series, at horizon five."""
    rows = folded(spark, sf_dir).where("horizon = 5")
    facts = [F.avg("y").alias("mean_target"), F.stddev_samp("y").alias("std_target")]
    whole = rows.dropDuplicates(["series_id", "i"]).groupBy("series_id").agg(*facts)
    parts = rows.where("part = 'train'").groupBy(F.concat_ws("|", "series_id", "fold").alias("series_id")).agg(*facts)
    shift = blocks.compare_features(whole, parts, ["mean_target", "std_target"])
    return shift.select("feature", "n", rounded(F.col("mean_absolute")).alias("mean_absolute"), rounded(F.col("median_absolute")).alias("median_absolute"))
