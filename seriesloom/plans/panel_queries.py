"""Queries over the price panels: catalog, returns, windows, folds and features."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.columns import rounded
from ..operators import catalog, dependence, returns, shape
from ..settings import chosen
from ..sources.panels import PANEL_SQL, price_panel, table

QUERIES: dict = {}
SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def add(f):
        QUERIES[name] = f
        if sql:
            SQL[name] = f"WITH {PANEL_SQL.strip()}{',' if sql.lstrip().startswith('+') else ''} {sql.lstrip().removeprefix('+')}"
        return f

    return add


def prices(spark: SparkSession, sf_dir: str) -> DataFrame:
    return price_panel(spark, sf_dir)


def all_returns(spark: SparkSession, sf_dir: str) -> DataFrame:
    return returns.log_returns(price_panel(spark, sf_dir))


def policy() -> tuple[int, int]:
    return chosen("target", catalog.TARGET), chosen("minimum", catalog.MINIMUM)


def judged(spark: SparkSession, sf_dir: str) -> DataFrame:
    return catalog.series_catalog(prices(spark, sf_dir), *policy())


def eligible(spark: SparkSession, sf_dir: str, target: int | None = None, minimum: int | None = None) -> DataFrame:
    most, least = policy()
    return returns.last_returns(prices(spark, sf_dir), target or most, minimum or least)


def day(c: str):
    return F.date_format(c, "yyyy-MM-dd").alias(c)


@query(
    "series_catalog",
    """SELECT series_id, ticker, market, n_rows::BIGINT AS n_rows, strftime(first_date, '%Y-%m-%d') AS first_date, strftime(last_date, '%Y-%m-%d') AS last_date,
    n_duplicate_dates::BIGINT AS n_duplicate_dates, n_missing_close::BIGINT AS n_missing_close, has_nonpositive_close, can_compute, status, reason FROM judged""",
)
def series_catalog(spark, sf_dir):
    return judged(spark, sf_dir).withColumns({"first_date": day("first_date"), "last_date": day("last_date")})


@query("catalog_status_counts", "SELECT market, status, reason, count(*)::BIGINT AS n_series, sum(n_rows)::BIGINT AS n_rows FROM judged GROUP BY ALL")
def catalog_status_counts(spark, sf_dir):
    return catalog.status_counts(judged(spark, sf_dir))


@query("length_distribution", "SELECT CASE WHEN n_rows < 1500 THEN '<1500' WHEN n_rows < 2000 THEN '1500-1999' ELSE '>=2000' END AS bucket, count(*)::BIGINT AS n_series FROM cat GROUP BY ALL")
def length_distribution(spark, sf_dir):
    return catalog.length_distribution(judged(spark, sf_dir), *policy())


@query("duplicate_dates", "SELECT l_suppkey, strftime(l_shipdate, '%Y-%m-%d') AS l_shipdate, count(*)::BIGINT AS n FROM lineitem GROUP BY ALL HAVING count(*) > 1")
def duplicate_dates(spark, sf_dir):
    return catalog.duplicate_dates(table(spark, sf_dir, "lineitem"), "l_suppkey", "l_shipdate").withColumn("l_shipdate", day("l_shipdate"))


@query("sort_violations", "+ b AS (SELECT user_id, ts, lag(ts) OVER (PARTITION BY user_id ORDER BY event_id) AS p FROM events) SELECT user_id, (count(*) FILTER (WHERE ts < p))::BIGINT AS n_backwards FROM b GROUP BY user_id")
def sort_violations(spark, sf_dir):
    return catalog.sort_violations(table(spark, sf_dir, "events"), "user_id", "event_id", "ts")


@query(
    "core_profile_hash",
    """+ u AS (SELECT series_id, market, row_number() OVER (ORDER BY md5(series_id || ':42'), series_id) AS nth FROM cat WHERE market = 'US')
    SELECT series_id, market FROM u WHERE nth <= (SELECT count(*) FROM cat WHERE market = 'RU') UNION ALL SELECT series_id, market FROM cat WHERE market = 'RU'""",
)
def core_profile_hash(spark, sf_dir):
    return catalog.core_profile(judged(spark, sf_dir), chosen("seed", 42))


@query("log_returns", "SELECT series_id, rn::INTEGER AS rn, n::BIGINT AS n, round(r, 6) + 0.0 AS r FROM ret")
def log_returns(spark, sf_dir):
    return all_returns(spark, sf_dir).select("series_id", "rn", "n", rounded(F.col("r")).alias("r"))


@query("last_n_returns", "SELECT series_id, rn::BIGINT AS rn, n::BIGINT AS n, short_series, round(r, 6) + 0.0 AS r FROM elig")
def last_n_returns(spark, sf_dir):
    return eligible(spark, sf_dir).select("series_id", F.col("rn").cast("long").alias("rn"), F.col("n").cast("long").alias("n"), "short_series", rounded(F.col("r")).alias("r"))


def _target(h: int):
    sql = f"""+ t AS (SELECT series_id, rn, n, sum(r) OVER (PARTITION BY series_id ORDER BY rn ROWS BETWEEN 1 FOLLOWING AND {h} FOLLOWING) AS y FROM elig)
    SELECT series_id, rn::BIGINT AS rn, round(y, 6) + 0.0 AS y FROM t WHERE rn < n - {h}"""

    @query(f"target_h{h}", sql)
    def run(spark, sf_dir):
        return returns.horizon_targets(eligible(spark, sf_dir), h).select("series_id", F.col("rn").cast("long").alias("rn"), rounded(F.col("y")).alias("y"))


for _h in (1, 5, 20):
    _target(_h)


@query(
    "trailing_h5",
    """+ t AS (SELECT series_id, rn, sum(r) OVER (PARTITION BY series_id ORDER BY rn ROWS BETWEEN 4 PRECEDING AND CURRENT ROW) AS f FROM elig)
    SELECT series_id, rn::BIGINT AS rn, round(f, 6) + 0.0 AS f FROM t WHERE rn >= 4""",
)
def trailing_h5(spark, sf_dir):
    return returns.trailing_sums(eligible(spark, sf_dir), 5).select("series_id", F.col("rn").cast("long").alias("rn"), rounded(F.col("f")).alias("f"))


def supervised_sql(h: int, w: int) -> str:
    return f"""t{h} AS (SELECT series_id, market, date, rn, n, sum(r) OVER (PARTITION BY series_id ORDER BY rn ROWS BETWEEN 1 FOLLOWING AND {h} FOLLOWING) AS y,
      sum(r) OVER (PARTITION BY series_id ORDER BY rn ROWS BETWEEN {h - 1} PRECEDING AND CURRENT ROW) AS f FROM elig),
    s{h} AS (SELECT series_id, market, date, {h} AS horizon, rn - {h + w - 2} AS i, n - {h} - {h + w - 2} AS m, y, f AS last,
      sum(f) OVER (PARTITION BY series_id ORDER BY rn ROWS BETWEEN {w - 1} PRECEDING AND CURRENT ROW) AS x_sum,
      first_value(f) OVER (PARTITION BY series_id ORDER BY rn ROWS BETWEEN {w - 1} PRECEDING AND CURRENT ROW) AS x_first, rn, n FROM t{h} WHERE rn >= {h - 1}),
    v{h} AS (SELECT * FROM s{h} WHERE i >= 0 AND rn < n - {h})"""


def folds_sql(rows: str, name: str) -> str:
    return f"""{name} AS (SELECT * FROM (SELECT v.*, k.fold, greatest(1, m // 4) AS ts, m - 3 * greatest(1, m // 4) + (k.fold - 1) * greatest(1, m // 4) AS train_n,
      CASE WHEN i < m - 3 * greatest(1, m // 4) + (k.fold - 1) * greatest(1, m // 4) THEN 'train' WHEN i < m - 3 * greatest(1, m // 4) + k.fold * greatest(1, m // 4) THEN 'test' END AS part
      FROM ({rows}) v, (VALUES (1), (2), (3)) k(fold)) WHERE part IS NOT NULL)"""


@query("lag_window_matrix", f"+ {supervised_sql(5, 32)} SELECT series_id, i::BIGINT AS i, 32 AS width, round(x_first, 6) + 0.0 AS x_first, round(last, 6) + 0.0 AS x_last, round(x_sum, 6) + 0.0 AS x_sum, round(y, 6) + 0.0 AS y FROM v5")
def lag_window_matrix(spark, sf_dir):
    rows = returns.supervised(eligible(spark, sf_dir), 5)
    total = F.aggregate("x", F.lit(0.0), lambda a, v: a + v)
    return rows.select("series_id", F.col("i").cast("long").alias("i"), F.size("x").alias("width"), rounded(F.col("x")[0]).alias("x_first"), rounded(F.element_at("x", -1)).alias("x_last"), rounded(total).alias("x_sum"), rounded(F.col("y")).alias("y"))


_SPLITS = f"""+ {supervised_sql(5, 32)}, {folds_sql("SELECT series_id, date, i, m FROM v5", "folded")},
    splits AS (SELECT series_id, fold, (count(*) FILTER (WHERE part = 'train'))::BIGINT AS n_train, (count(*) FILTER (WHERE part = 'test'))::BIGINT AS n_test,
      min(date) FILTER (WHERE part = 'train') AS train_start, max(date) FILTER (WHERE part = 'train') AS train_end,
      min(date) FILTER (WHERE part = 'test') AS test_start, max(date) FILTER (WHERE part = 'test') AS test_end FROM folded GROUP BY ALL)"""


def _splits(spark, sf_dir):
    return returns.split_metadata(returns.with_folds(returns.supervised(eligible(spark, sf_dir), 5), chosen("folds", returns.FOLDS)))


@query("rolling_origin_folds", _SPLITS + " SELECT series_id, fold, n_train, n_test FROM splits")
def rolling_origin_folds(spark, sf_dir):
    return _splits(spark, sf_dir).select("series_id", "fold", "n_train", "n_test")


@query("split_metadata", _SPLITS + " SELECT series_id, fold, " + ", ".join(f"strftime({c}, '%Y-%m-%d') AS {c}" for c in ("train_start", "train_end", "test_start", "test_end")) + " FROM splits")
def split_metadata(spark, sf_dir):
    return _splits(spark, sf_dir).select("series_id", "fold", *(day(c) for c in ("train_start", "train_end", "test_start", "test_end")))


@query("fold_leak_violations", _SPLITS + " SELECT count(*)::BIGINT AS n_folds, (count(*) FILTER (WHERE train_end >= test_start))::BIGINT AS n_violations FROM splits")
def fold_leak_violations(spark, sf_dir):
    return returns.fold_leaks(_splits(spark, sf_dir))


@query("fold_aware_range_join", _SPLITS + " SELECT s.series_id, s.fold, count(*)::BIGINT AS n, round(avg(e.r), 8) + 0.0 AS mean, round(stddev_samp(e.r), 6) AS std FROM splits s JOIN elig e ON e.series_id = s.series_id AND e.date BETWEEN s.train_start AND s.train_end GROUP BY ALL")
def fold_aware_range_join(spark, sf_dir):
    rows = returns.fold_segments(_splits(spark, sf_dir), eligible(spark, sf_dir))
    return rows.groupBy("series_id", "fold").agg(F.count("*").alias("n"), rounded(F.avg("r"), 8).alias("mean"), rounded(F.stddev_samp("r")).alias("std"))


_CENTRED = "+ c AS (SELECT series_id, rn, n, r, r - avg(r) OVER (PARTITION BY series_id) AS d FROM elig)"


def acf_sql(lags: str, value: str = "r") -> str:
    return f"""+ a0 AS (SELECT series_id, rn, n, {value} - avg({value}) OVER (PARTITION BY series_id) AS d FROM elig),
    acf AS (SELECT a.series_id, any_value(a.n) AS n, k.lag, sum(a.d * b.d) / any_value(q.s) AS acf FROM a0 a JOIN (SELECT unnest({lags}) AS lag) k ON true
      JOIN a0 b ON b.series_id = a.series_id AND b.rn = a.rn + k.lag JOIN (SELECT series_id, sum(d * d) AS s FROM a0 GROUP BY 1) q ON q.series_id = a.series_id GROUP BY a.series_id, k.lag)"""


_LAGS = str(dependence.ACF_LAGS)


@query("acf_grid", acf_sql(_LAGS) + " SELECT series_id, lag, round(acf, 6) + 0.0 AS acf FROM acf")
def acf_grid(spark, sf_dir):
    return dependence.acf(eligible(spark, sf_dir)).select("series_id", "lag", rounded(F.col("acf")).alias("acf"))


@query("abs_acf_grid", acf_sql(_LAGS, "abs(r)") + " SELECT series_id, lag, round(acf, 6) + 0.0 AS acf FROM acf")
def abs_acf_grid(spark, sf_dir):
    return dependence.acf(eligible(spark, sf_dir), value=F.abs("r")).select("series_id", "lag", rounded(F.col("acf")).alias("acf"))


@query("integrated_acf", acf_sql(_LAGS) + " SELECT series_id, up_to, round(sum(abs(acf)), 6) AS iacf FROM acf, (SELECT unnest([5, 10, 20, 50, 100, 250]) AS up_to) u WHERE lag <= up_to GROUP BY ALL")
def integrated_acf(spark, sf_dir):
    return dependence.integrated_acf(dependence.acf(eligible(spark, sf_dir))).select("series_id", "up_to", rounded(F.col("iacf")).alias("iacf"))


def _ljung(name: str, value: str, column):
    sql = acf_sql("range(1, 51)::INTEGER[]", value) + """ SELECT series_id, "order", round(any_value(n) * (any_value(n) + 2.0) * sum(acf * acf / (n - lag)), 5) AS q
        FROM acf, (SELECT unnest([5, 10, 20, 50]) AS "order") o WHERE lag <= "order" GROUP BY series_id, "order" """

    @query(name, sql)
    def run(spark, sf_dir):
        return dependence.ljung_box(eligible(spark, sf_dir), value=column()).select("series_id", "order", rounded(F.col("q"), 5).alias("q"))


_ljung("ljung_box_stat", "r", lambda: F.col("r"))
_ljung("ljung_box_abs_stat", "abs(r)", lambda: F.abs("r"))


@query(
    "variance_ratio",
    "+ " + ", ".join(f"""w{q} AS (SELECT series_id, r, CASE WHEN rn >= {q - 1} THEN sum(r) OVER (PARTITION BY series_id ORDER BY rn ROWS BETWEEN {q - 1} PRECEDING AND CURRENT ROW) END AS s FROM elig)""" for q in dependence.VARIANCE_RATIO_STEPS)
    + " UNION ALL ".join(f" SELECT series_id, {q} AS q, round(var_samp(s) / ({q} * var_samp(r)), 6) AS variance_ratio FROM w{q} GROUP BY series_id" for q in dependence.VARIANCE_RATIO_STEPS),
)
def variance_ratio(spark, sf_dir):
    return dependence.variance_ratio(eligible(spark, sf_dir)).withColumn("variance_ratio", rounded(F.col("variance_ratio")))


def hurst_windows() -> tuple[int, int]:
    return chosen("hurst_min", dependence.HURST_MIN), chosen("hurst_max", dependence.HURST_MAX)


_WINDOWS = ", ".join(f"({w})" for w in dependence.log_windows())


@query(
    "hurst_rs",
    f"""+ ch AS (SELECT series_id, w, rn, rn // w AS chunk, r FROM elig, (VALUES {_WINDOWS}) k(w) WHERE w <= n // 2 AND n // w >= 2 AND rn < (n // w) * w),
    dv AS (SELECT *, r - avg(r) OVER (PARTITION BY series_id, w, chunk) AS d FROM ch),
    cu AS (SELECT *, sum(d) OVER (PARTITION BY series_id, w, chunk ORDER BY rn) AS y FROM dv),
    sp AS (SELECT series_id, w, chunk, max(y) - min(y) AS rg, stddev_samp(r) AS s FROM cu GROUP BY ALL HAVING stddev_samp(r) > 0),
    lv AS (SELECT series_id, w, avg(rg / s) AS level FROM sp GROUP BY ALL)
    SELECT series_id, round(regr_slope(ln(level), ln(w)), 6) AS hurst FROM lv GROUP BY series_id""",
)
def hurst_rs(spark, sf_dir):
    return dependence.hurst_rs(eligible(spark, sf_dir), *hurst_windows()).withColumn("hurst", rounded(F.col("hurst")))


@query(
    "hurst_dfa",
    f"""{_CENTRED}, pr AS (SELECT series_id, rn, n, sum(d) OVER (PARTITION BY series_id ORDER BY rn) AS x FROM c),
    ch AS (SELECT series_id, w, rn // w AS chunk, (rn % w)::DOUBLE AS t, x FROM pr, (VALUES {_WINDOWS}) k(w) WHERE w <= n // 2 AND n // w >= 2 AND rn < (n // w) * w),
    sp AS (SELECT series_id, w, chunk, sqrt(greatest(regr_syy(x, t) - regr_sxy(x, t) * regr_sxy(x, t) / regr_sxx(x, t), 0) / count(*)) AS f FROM ch GROUP BY ALL),
    lv AS (SELECT series_id, w, avg(f) AS level FROM sp GROUP BY ALL)
    SELECT series_id, round(regr_slope(ln(level), ln(w)), 6) AS hurst FROM lv GROUP BY series_id""",
)
def hurst_dfa(spark, sf_dir):
    return dependence.hurst_dfa(eligible(spark, sf_dir), *hurst_windows()).withColumn("hurst", rounded(F.col("hurst")))


@query("noise_fn", "+ s AS (SELECT series_id, r, r - lag(r) OVER (PARTITION BY series_id ORDER BY rn) AS d FROM elig) SELECT series_id, round(stddev_samp(d) / stddev_samp(r), 6) AS noise_fn FROM s GROUP BY series_id")
def noise_fn(spark, sf_dir):
    return shape.noise_fn(eligible(spark, sf_dir)).withColumn("noise_fn", rounded(F.col("noise_fn")))


@query(
    "permutation_entropy",
    """+ t AS (SELECT series_id, r AS a, lead(r, 1) OVER w AS b, lead(r, 2) OVER w AS c FROM elig WINDOW w AS (PARTITION BY series_id ORDER BY rn)),
    k AS (SELECT series_id, CASE WHEN a <= b AND b <= c THEN 0 WHEN a <= c AND c < b THEN 1 WHEN b < a AND a <= c THEN 2 WHEN b <= c AND c < a THEN 3 WHEN c < a AND a <= b THEN 4 ELSE 5 END AS kind, count(*) AS n FROM t WHERE c IS NOT NULL GROUP BY ALL),
    p AS (SELECT series_id, n / sum(n) OVER (PARTITION BY series_id) AS p FROM k) SELECT series_id, round(-sum(p * ln(p)) / ln(6), 6) AS permutation_entropy FROM p GROUP BY series_id""",
)
def permutation_entropy(spark, sf_dir):
    return shape.permutation_entropy(eligible(spark, sf_dir)).withColumn("permutation_entropy", rounded(F.col("permutation_entropy")))


@query("fisher_kurtosis", _CENTRED + " SELECT series_id, round(kurtosis(d), 6) AS kurtosis FROM c GROUP BY series_id")
def fisher_kurtosis(spark, sf_dir):
    return shape.fisher_kurtosis(eligible(spark, sf_dir)).withColumn("kurtosis", rounded(F.col("kurtosis")))


@query("moors_kurtosis", _CENTRED + " SELECT series_id, round(((quantile_cont(d, .875) - quantile_cont(d, .625)) + (quantile_cont(d, .375) - quantile_cont(d, .125))) / (quantile_cont(d, .75) - quantile_cont(d, .25)), 6) AS moors FROM c GROUP BY series_id")
def moors_kurtosis(spark, sf_dir):
    return shape.moors_kurtosis(eligible(spark, sf_dir)).withColumn("moors", rounded(F.col("moors")))


@query(
    "tail_ratios",
    _CENTRED + """, q AS (SELECT series_id, quantile_cont(d, .01) AS a, quantile_cont(d, .25) AS b, quantile_cont(d, .75) AS e, quantile_cont(d, .99) AS f FROM c GROUP BY series_id)
    SELECT series_id, round((abs(f) + abs(a)) / (abs(e) + abs(b)), 6) AS tail_both, round(f / e, 6) AS tail_up, round(abs(a) / abs(b), 6) AS tail_low FROM q""",
)
def tail_ratios(spark, sf_dir):
    t = shape.tail_ratios(eligible(spark, sf_dir))
    return t.select("series_id", *(rounded(F.col(c)).alias(c) for c in ("tail_both", "tail_up", "tail_low")))


@query(
    "hill_index",
    _CENTRED + """, a AS (SELECT series_id, abs(d) AS a, row_number() OVER (PARTITION BY series_id ORDER BY abs(d) DESC, rn) AS nth, count(*) OVER (PARTITION BY series_id) AS n FROM c WHERE d <> 0),
    k AS (SELECT *, least(greatest(5, floor(n * 0.05)::BIGINT), n - 1) AS k FROM a WHERE n >= 50), b AS (SELECT series_id, a AS bound FROM k WHERE nth = k + 1)
    SELECT k.series_id, any_value(k.k)::BIGINT AS k, round(1 / avg(ln(k.a / b.bound)), 6) AS hill FROM k JOIN b ON k.series_id = b.series_id WHERE k.nth <= k.k GROUP BY k.series_id""",
)
def hill_index(spark, sf_dir):
    return shape.hill_index(eligible(spark, sf_dir), chosen("hill_share", shape.HILL_SHARE)).select("series_id", "k", rounded(F.col("hill")).alias("hill"))


@query(
    "ami_lag",
    """+ p AS (SELECT series_id, r AS a, lead(r) OVER (PARTITION BY series_id ORDER BY rn) AS b FROM elig), v AS (SELECT * FROM p WHERE b IS NOT NULL),
    e AS (SELECT series_id, min(a) AS la, max(a) AS ha, min(b) AS lb, max(b) AS hb FROM v GROUP BY 1),
    g AS (SELECT v.series_id, least(floor((a - la) / (ha - la) * 24), 23) AS i, least(floor((b - lb) / (hb - lb) * 24), 23) AS j, count(*)::DOUBLE AS k FROM v JOIN e ON v.series_id = e.series_id GROUP BY ALL),
    m AS (SELECT *, sum(k) OVER (PARTITION BY series_id) AS n, sum(k) OVER (PARTITION BY series_id, i) AS ki, sum(k) OVER (PARTITION BY series_id, j) AS kj FROM g)
    SELECT series_id, round(sum(k / n * ln(k * n / (ki * kj))), 6) AS ami FROM m GROUP BY series_id""",
)
def ami_lag(spark, sf_dir):
    return shape.mutual_information(eligible(spark, sf_dir)).withColumn("ami", rounded(F.col("ami")))


@query(
    "lyapunov_time",
    """+ m AS (SELECT series_id, round(avg(r), 7) + 0.0 AS rate FROM elig GROUP BY series_id) SELECT series_id, rate, CASE WHEN rate >= 1e-5 THEN round(1 / rate, 3) END AS lyapunov_time,
    CASE WHEN rate IS NULL THEN 'lyapunov_time_missing_lle' WHEN rate <= 0 THEN 'lyapunov_time_nonpositive_lle' WHEN rate < 1e-5 THEN 'lyapunov_time_near_zero_lle' ELSE '' END AS flag FROM m""",
)
def lyapunov_time(spark, sf_dir):
    rates = eligible(spark, sf_dir).groupBy("series_id").agg(rounded(F.avg("r"), 7).alias("rate"))
    return shape.lyapunov_time(rates, "rate", least=1e-5).withColumn("lyapunov_time", rounded(F.col("lyapunov_time"), 3))


@query("rolling_volatility", "+ v AS (SELECT series_id, rn, stddev_pop(r) OVER (PARTITION BY series_id ORDER BY rn ROWS BETWEEN 19 PRECEDING AND CURRENT ROW) AS vol FROM elig) SELECT series_id, rn::BIGINT AS rn, round(vol, 6) AS vol FROM v WHERE rn >= 19")
def rolling_volatility(spark, sf_dir):
    return shape.rolling_volatility(eligible(spark, sf_dir)).select("series_id", F.col("rn").cast("long").alias("rn"), rounded(F.col("vol")).alias("vol"))


def basic_sql(source: str) -> str:
    return f"""bf0 AS (SELECT series_id, r, lag(r) OVER w AS p, CASE WHEN rn >= 19 THEN stddev_pop(r) OVER (w ROWS BETWEEN 19 PRECEDING AND CURRENT ROW) END AS vol FROM {source} WINDOW w AS (PARTITION BY series_id ORDER BY rn)),
    bf AS (SELECT series_id, count(*) AS n_obs, avg(r) AS mean, stddev_pop(r) AS std, skewness(r) AS skew, kurtosis(r) AS kurt, avg((r > 0)::INTEGER) AS positive_share, avg((r < 0)::INTEGER) AS negative_share,
      avg((r * p < 0)::INTEGER) AS sign_change_rate, avg(((r < 0) <> (p < 0))::INTEGER) AS zero_crossing_rate, avg(abs(r)) AS mean_abs, avg(vol) AS vol_mean, stddev_samp(vol) AS vol_std FROM bf0 GROUP BY series_id)"""


BASIC = ["mean", "std", "skew", "kurt", "positive_share", "negative_share", "sign_change_rate", "zero_crossing_rate", "mean_abs", "vol_mean", "vol_std"]


@query("basic_features", f"+ {basic_sql('elig')} SELECT series_id, n_obs::BIGINT AS n_obs, " + ", ".join(f"round({c}, 6) + 0.0 AS {c}" for c in BASIC) + " FROM bf")
def basic_features(spark, sf_dir):
    b = shape.basic_features(eligible(spark, sf_dir))
    return b.select("series_id", "n_obs", *(rounded(F.col(c)).alias(c) for c in BASIC))


@query("extended_profile_hash", """+ u AS (SELECT series_id, market, row_number() OVER (ORDER BY md5(series_id || ':42'), series_id) AS nth FROM cat WHERE market = 'US')
    SELECT series_id, market FROM u WHERE nth <= 800 UNION ALL SELECT series_id, market FROM cat WHERE market = 'RU'""")
def extended_profile_hash(spark, sf_dir):
    return catalog.core_profile(judged(spark, sf_dir), chosen("seed", 42), most=800)


@query("dedup_keep_last", "+ k AS (SELECT l_suppkey, l_shipdate, l_orderkey, l_linenumber, row_number() OVER (PARTITION BY l_suppkey, l_shipdate ORDER BY l_orderkey * 10 + l_linenumber DESC) AS nth FROM lineitem) SELECT l_suppkey, strftime(l_shipdate, '%Y-%m-%d') AS l_shipdate, l_orderkey * 10 + l_linenumber AS ordinal FROM k WHERE nth = 1")
def dedup_keep_last(spark, sf_dir):
    rows = table(spark, sf_dir, "lineitem").select("l_suppkey", "l_shipdate", (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("ordinal"))
    return catalog.keep_last_per_date(rows, "l_suppkey", "l_shipdate", "ordinal").withColumn("l_shipdate", day("l_shipdate"))


@query("flag_breakdown", "+ f AS (SELECT CASE WHEN n_rows < 1500 THEN 'short;' ELSE '' END || CASE WHEN n_duplicate_dates > 0 THEN 'duplicates;' ELSE '' END || status AS flags FROM judged) SELECT flag, count(*)::BIGINT AS n FROM (SELECT unnest(string_split(flags, ';')) AS flag FROM f) WHERE flag <> '' GROUP BY flag")
def flag_breakdown(spark, sf_dir):
    c = judged(spark, sf_dir)
    flags = F.concat(F.when(F.col("n_rows") < policy()[1], "short;").otherwise(""), F.when(F.col("n_duplicate_dates") > 0, "duplicates;").otherwise(""), "status")
    return catalog.flag_breakdown(c.select(flags.alias("flags")), "flags")
