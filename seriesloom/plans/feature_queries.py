"""Queries over a table of features: the basic features of every series of the panels, with planted gaps."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.columns import rounded
from ..operators import screening, shape
from ..settings import chosen
from ..sources.shared import stored
from .panel_queries import BASIC, PANEL_SQL, all_returns, basic_sql

QUERIES: dict = {}
SQL: dict[str, str] = {}

_LONG = " UNION ALL ".join(
    f"SELECT series_id, '{c}' AS feature, round({'CASE WHEN n_obs % 3 <> 0 THEN ' + c + ' END' if c == 'skew' else c}, 9) + 0.0 AS value FROM bf" for c in BASIC
) + " UNION ALL SELECT series_id, 'twice_std', round(2 * std, 9) FROM bf UNION ALL SELECT series_id, 'constant', 1.0 FROM bf"
_BASE = f"WITH {PANEL_SQL.strip()}, {basic_sql('ret')}, lf AS ({_LONG})"
_QUALITY = """, q AS (SELECT feature, count(*) AS n_rows, count(*) FILTER (WHERE value IS NULL) AS n_missing, count(DISTINCT value) AS n_unique, avg(value) AS mean, stddev_samp(value) AS std,
    min(value) AS min, max(value) AS max, quantile_cont(value, .25) AS q25, median(value) AS median, quantile_cont(value, .75) AS q75, skewness(value) AS skew FROM lf GROUP BY feature),
  ql AS (SELECT *, n_missing / n_rows AS missing_rate, q75 - q25 AS iqr, n_missing / n_rows >= 0.2 AS high_missing, coalesce(std <= 1e-6, false) AS low_variance, n_unique <= 5 AS near_constant FROM q)"""
_PAIRS = """, pr AS (SELECT a.series_id, a.feature AS feature_1, b.feature AS feature_2, a.value AS x, b.value AS y FROM lf a JOIN lf b ON a.series_id = b.series_id AND a.feature < b.feature WHERE a.value IS NOT NULL AND b.value IS NOT NULL),
  rk AS (SELECT *, rank() OVER (PARTITION BY feature_1, feature_2 ORDER BY x) + (count(*) OVER (PARTITION BY feature_1, feature_2, x) - 1) / 2.0 AS rx,
                   rank() OVER (PARTITION BY feature_1, feature_2 ORDER BY y) + (count(*) OVER (PARTITION BY feature_1, feature_2, y) - 1) / 2.0 AS ry FROM pr),
  cp0 AS (SELECT feature_1, feature_2, count(*) AS n, CASE WHEN stddev_pop(x) > 0 AND stddev_pop(y) > 0 THEN corr(x, y) END AS pearson, CASE WHEN stddev_pop(rx) > 0 AND stddev_pop(ry) > 0 THEN corr(rx, ry) END AS spearman FROM rk GROUP BY ALL HAVING count(*) >= 3),
  cp AS (SELECT *, greatest(abs(coalesce(pearson, 0)), abs(coalesce(spearman, 0))) AS strength FROM cp0 WHERE greatest(abs(coalesce(pearson, 0)), abs(coalesce(spearman, 0))) >= 0.9)"""
#: The block of each basic feature; fixed values of these queries.
BLOCK_OF = {"sign_change_rate": "A", "zero_crossing_rate": "A", "mean": "B", "mean_abs": "B", "positive_share": "B", "negative_share": "B", "vol_mean": "D", "vol_std": "D"} | {c: "C" for c in ("std", "skew", "kurt", "twice_std", "constant")}
_STATUS = _QUALITY + _PAIRS + f""", bo(feature, block) AS (VALUES {", ".join(f"('{f}', '{b}')" for f, b in BLOCK_OF.items())}),
  wc(block, warning_coverage) AS (SELECT 'C', avg((coalesce(kurt < 0, false))::INTEGER) FROM bf UNION ALL SELECT 'D', avg((n_obs < 1500)::INTEGER) FROM bf UNION ALL SELECT 'A', avg((n_obs < 64)::INTEGER) FROM bf UNION ALL SELECT 'B', 0.0),
  pt AS (SELECT feature, min(partner) AS partner FROM (SELECT feature_1 AS feature, feature_2 AS partner FROM cp UNION ALL SELECT feature_2, feature_1 FROM cp) GROUP BY feature),
  st0 AS (SELECT ql.*, bo.block, wc.warning_coverage, pt.partner, pt.partner IS NOT NULL AS correlated, wc.warning_coverage >= 0.3 AS heavy FROM ql JOIN bo ON ql.feature = bo.feature LEFT JOIN wc ON wc.block = bo.block LEFT JOIN pt ON pt.feature = ql.feature),
  st AS (SELECT *, CASE WHEN missing_rate >= 0.99 THEN 'drop_candidate' WHEN high_missing THEN 'review_high_missing' WHEN near_constant OR low_variance THEN 'review_low_variance' WHEN heavy AND block = 'D' THEN 'reserve_candidate'
         WHEN heavy THEN 'review_warning_heavy' WHEN correlated THEN 'review_highly_correlated' ELSE 'keep_candidate' END AS status,
         CASE WHEN missing_rate >= 0.99 THEN 'all values missing' WHEN high_missing THEN 'high missingness' WHEN near_constant OR low_variance THEN 'very low variance' WHEN heavy AND block = 'D' THEN 'heavy warning coverage in block D'
         WHEN heavy THEN 'heavy warning coverage' WHEN correlated THEN 'highly correlated with ' || partner ELSE 'no major issues detected' END AS note FROM st0)"""
_GROUPS = _STATUS + """, lk AS (SELECT feature_1 AS a, feature_2 AS b FROM cp UNION SELECT feature_2, feature_1 FROM cp), rc AS (SELECT a AS feature, a AS seen FROM lk UNION SELECT r.feature, l.b FROM rc r JOIN lk l ON r.seen = l.a),
  gr AS (SELECT feature, min(seen) AS root FROM rc GROUP BY feature)"""

_POOLED = _STATUS + """, pl AS (SELECT feature FROM st WHERE status IN ('keep_candidate', 'review_highly_correlated', 'reserve_candidate')),
  plk AS (SELECT feature_1 AS a, feature_2 AS b FROM cp WHERE feature_1 IN (FROM pl) AND feature_2 IN (FROM pl) UNION SELECT feature_2, feature_1 FROM cp WHERE feature_1 IN (FROM pl) AND feature_2 IN (FROM pl)),
  prc AS (SELECT a AS feature, a AS seen FROM plk UNION SELECT r.feature, l.b FROM prc r JOIN plk l ON r.seen = l.a), pg AS (SELECT feature, min(seen) AS root FROM prc GROUP BY feature),
  pp AS (SELECT g.feature, row_number() OVER (PARTITION BY g.root ORDER BY CASE s.status WHEN 'keep_candidate' THEN 0 WHEN 'reserve_candidate' THEN 1 ELSE 2 END, s.missing_rate, coalesce(s.warning_coverage, 1), coalesce(s.std, 0) DESC, length(s.feature), s.feature) AS nth FROM pg g JOIN st s ON g.feature = s.feature)"""


def query(name: str, sql: str):
    def add(f):
        QUERIES[name] = f
        SQL[name] = _BASE.replace("WITH ", "WITH RECURSIVE ", 1) + sql
        return f

    return add


def basic(spark, sf_dir):
    """A row of basic features for each series, stored: most queries read them several times, and each pass would read the panel again."""
    return stored(shape.basic_features(all_returns(spark, sf_dir)), "basic")


def long_of(wide):
    """Long features, rounded so that both engines see equal values: gaps in one, one a multiple, one constant."""
    wide = wide.withColumns({"skew": F.when(F.col("n_obs") % 3 != 0, F.col("skew")), "twice_std": 2 * F.col("std"), "constant": F.lit(1.0)})
    return screening.long_features(wide.drop("n_obs")).withColumn("value", F.round("value", 9))


def features(spark, sf_dir):
    return long_of(basic(spark, sf_dir))


@query("master_features", f", a AS (SELECT series_id, std, kurt FROM bf), b AS (SELECT series_id, {'std'} , mean_abs FROM bf WHERE n_obs % 2 = 0) SELECT coalesce(a.series_id, b.series_id) AS series_id, round(a.std, 6) AS std, round(a.kurt, 5) + 0.0 AS kurt, CASE WHEN a.series_id IS NULL THEN 'missing' ELSE 'success' END AS shape_status, round(b.std, 6) AS std__size, round(b.mean_abs, 6) AS mean_abs, CASE WHEN b.series_id IS NULL THEN 'missing' ELSE 'success' END AS size_status FROM a FULL JOIN b ON a.series_id = b.series_id")
def master_features(spark, sf_dir):
    b = basic(spark, sf_dir)
    joined = screening.join_blocks({"shape": b.select("series_id", rounded(F.col("std")).alias("std"), rounded(F.col("kurt"), 5).alias("kurt")), "size": b.where("n_obs % 2 = 0").select("series_id", rounded(F.col("std")).alias("std"), rounded(F.col("mean_abs")).alias("mean_abs"))})
    return joined


_ROUND = ["mean", "std", "min", "max", "q25", "median", "q75", "skew", "missing_rate", "iqr"]


@query("feature_quality", _QUALITY + " SELECT feature, n_rows::BIGINT AS n_rows, n_missing::BIGINT AS n_missing, n_unique::BIGINT AS n_unique, high_missing, low_variance, near_constant, " + ", ".join(f"round({c}, 5) + 0.0 AS {c}" for c in _ROUND if c != "skew") + ", CASE WHEN std > 0 THEN round(skew, 5) + 0.0 END AS skew FROM ql")
def feature_quality(spark, sf_dir):
    q = screening.feature_quality(features(spark, sf_dir), chosen("high_missing", screening.HIGH_MISSING))
    exact = [c for c in q.columns if c not in _ROUND]
    skew = F.when(F.col("std") > 0, rounded(F.col("skew"), 5)).alias("skew")
    return q.select(*exact, *(rounded(F.col(c), 5).alias(c) for c in _ROUND if c != "skew"), skew)


@query("high_corr_pairs", _PAIRS + " SELECT feature_1, feature_2, n::BIGINT AS n, round(pearson, 6) AS pearson, round(spearman, 6) AS spearman, CASE WHEN strength >= 0.98 THEN 'potential_duplicate' ELSE 'strongly_related' END AS relation FROM cp")
def high_corr_pairs(spark, sf_dir):
    p = screening.correlated_pairs(features(spark, sf_dir), chosen("correlated", screening.CORRELATED))
    return p.select("feature_1", "feature_2", "n", rounded(F.col("pearson")).alias("pearson"), rounded(F.col("spearman")).alias("spearman"), "relation")


def blocks(b):
    """The flags of each block's rows, from basic features: few returns, or light tails."""
    flag = lambda bad, name: b.select("series_id", F.when(bad, name).otherwise("").alias("feature_warning_flags"))
    return {"A": flag(F.col("n_obs") < 64, "hurst_rs_too_short"), "B": flag(F.lit(False), ""), "C": flag(F.col("kurt") < 0, "kurtosis_negative"), "D": flag(F.col("n_obs") < 1500, "series_too_short_for_block_d")}


def _screened(spark, sf_dir):
    b = basic(spark, sf_dir)
    long = long_of(b)
    pairs = screening.correlated_pairs(long, chosen("correlated", screening.CORRELATED))
    return screening.screening(screening.feature_quality(long, chosen("high_missing", screening.HIGH_MISSING)), pairs, spark.createDataFrame(list(BLOCK_OF.items()), "feature string, block string"), screening.warning_coverage(blocks(b)), chosen("warning_heavy", screening.WARNING_HEAVY)), pairs


@query("warning_coverage", _STATUS + " SELECT block, round(warning_coverage, 6) + 0.0 AS warning_coverage FROM wc")
def warning_coverage(spark, sf_dir):
    return screening.warning_coverage(blocks(basic(spark, sf_dir))).withColumn("warning_coverage", rounded(F.col("warning_coverage")))


@query("screening_notes", _STATUS + " SELECT feature, block, status, note || CASE WHEN correlated AND status NOT IN ('review_highly_correlated', 'drop_candidate') THEN '; highly correlated with ' || partner ELSE '' END AS notes FROM st")
def screening_notes(spark, sf_dir):
    return _screened(spark, sf_dir)[0].select("feature", "block", "status", "notes")


@query("candidate_pool", _STATUS + """ SELECT feature, block, status, status IN ('keep_candidate', 'review_highly_correlated', 'reserve_candidate') AS included,
  CASE WHEN status IN ('keep_candidate', 'review_highly_correlated', 'reserve_candidate') THEN 'included_by_screening_status' WHEN status IN ('review_high_missing', 'review_low_variance', 'drop_candidate') THEN 'excluded_by_screening_status' ELSE 'excluded_not_whitelisted' END AS reason FROM st""")
def candidate_pool(spark, sf_dir):
    return screening.candidate_pool(_screened(spark, sf_dir)[0])


@query("screening_status", _STATUS + " SELECT feature, correlated, status FROM st")
def screening_status(spark, sf_dir):
    return _screened(spark, sf_dir)[0].select("feature", "correlated", "status")


@query("corr_groups", _GROUPS + " SELECT feature, root FROM gr")
def corr_groups(spark, sf_dir):
    return screening.feature_groups(screening.correlated_pairs(features(spark, sf_dir), chosen("correlated", screening.CORRELATED)))


@query("representatives", _GROUPS + """, rp AS (SELECT g.root, s.feature, count(*) OVER (PARTITION BY g.root) AS size, row_number() OVER (PARTITION BY g.root ORDER BY CASE s.status WHEN 'keep_candidate' THEN 0 WHEN 'reserve_candidate' THEN 1 WHEN 'review_highly_correlated' THEN 2 ELSE 4 END,
    s.missing_rate, coalesce(s.warning_coverage, 1), coalesce(s.std, 0) DESC, CASE WHEN s.feature LIKE '%kurtosis%' THEN 1 ELSE 0 END DESC, length(s.feature), s.feature) AS nth FROM gr g JOIN st s ON g.feature = s.feature)""" + " SELECT root, size::BIGINT AS size, feature AS representative FROM rp WHERE nth = 1")
def representatives(spark, sf_dir):
    screened, pairs = _screened(spark, sf_dir)
    return screening.representatives(screening.feature_groups(pairs), screened)


@query("consolidated_sets", _POOLED + """, cs AS (SELECT feature, block, status FROM st WHERE status IN ('keep_candidate', 'review_highly_correlated', 'reserve_candidate') AND (feature NOT IN (SELECT feature FROM pg) OR feature IN (SELECT feature FROM pp WHERE nth = 1)))
  SELECT 'with_chaos' AS set_name, feature, block, status FROM cs UNION ALL SELECT 'base', feature, block, status FROM cs WHERE block <> 'D'""")
def consolidated_sets(spark, sf_dir):
    screened, pairs = _screened(spark, sf_dir)
    pool = screening.candidate_pool(screened).where("included").select("feature")
    inside = pairs.join(pool.withColumnRenamed("feature", "feature_1"), "feature_1", "left_semi").join(pool.withColumnRenamed("feature", "feature_2"), "feature_2", "left_semi")
    groups = screening.feature_groups(inside)
    return screening.consolidated_sets(screened, screening.representatives(groups, screened), groups)


_NAMES = ["iacf_abs_1_20", "acf_lag_5", "abs_acf_lag_250", "lb_ret_stat_50", "spectral_entropy", "robust_kurtosis", "tail_ratio_upper", "largest_lyapunov_exponent", "hurst_rs", "cross_lag_x"]


@query("interpretability", f", nm AS (SELECT unnest({_NAMES}) AS feature)" + """ SELECT feature, round(CASE WHEN starts_with(feature, 'iacf_') THEN 2.5 ELSE 0 END - CASE WHEN starts_with(feature, 'acf_lag_') OR starts_with(feature, 'abs_acf_lag_') THEN 2 ELSE 0 END
  + CASE WHEN starts_with(feature, 'lb_') THEN 0.5 ELSE 0 END + CASE WHEN contains(feature, 'spectral_') OR contains(feature, 'entropy') OR contains(feature, 'kurtosis') OR contains(feature, 'tail_ratio') THEN 1 ELSE 0 END
  + CASE WHEN contains(feature, 'largest_lyapunov_exponent') OR contains(feature, 'correlation_dimension') THEN 1 ELSE 0 END - CASE WHEN regexp_matches(feature, '_lag_[0-9]+$') THEN least(regexp_extract(feature, '([0-9]+)$', 1)::INTEGER / 100.0, 2) ELSE 0 END, 6)::DOUBLE AS score FROM nm""")
def interpretability(spark, sf_dir):
    names = spark.createDataFrame([(n,) for n in _NAMES], "feature string")
    return names.select("feature", rounded(screening.interpretability()).alias("score"))


@query("scaling_plan", """, sq AS (SELECT feature, quantile_cont(value, .25) AS a, quantile_cont(value, .75) AS b, CASE WHEN stddev_pop(value) > 0 THEN skewness(value) END AS skew FROM lf GROUP BY feature),
  so AS (SELECT l.feature, avg((value < a - 1.5 * (b - a) OR value > b + 1.5 * (b - a))::INTEGER) AS outlier_share, any_value(skew) AS skew FROM lf l JOIN sq ON l.feature = sq.feature WHERE value IS NOT NULL GROUP BY l.feature)
  SELECT feature, round(outlier_share, 6) AS outlier_share, CASE WHEN outlier_share >= 0.15 OR abs(coalesce(skew, 0)) >= 2 THEN 'rank' WHEN outlier_share >= 0.05 OR abs(coalesce(skew, 0)) >= 1 THEN 'robust' ELSE 'standard' END AS scaling FROM so""")
def scaling_plan(spark, sf_dir):
    p = screening.scaling_plan(features(spark, sf_dir))
    return p.select("feature", rounded(F.col("outlier_share")).alias("outlier_share"), "scaling")


@query("median_impute", ", md AS (SELECT feature, median(value) AS m FROM lf GROUP BY feature) SELECT series_id, l.feature, round(coalesce(value, m), 6) + 0.0 AS value, value IS NULL AS imputed FROM lf l JOIN md ON l.feature = md.feature")
def median_impute(spark, sf_dir):
    return screening.median_impute(features(spark, sf_dir)).withColumn("value", rounded(F.col("value")))


@query("robust_scale", ", rq AS (SELECT feature, median(value) AS m, quantile_cont(value, .75) - quantile_cont(value, .25) AS s FROM lf GROUP BY feature) SELECT series_id, l.feature, round((value - m) / CASE WHEN s = 0 THEN 1 ELSE s END, 5) + 0.0 AS scaled FROM lf l JOIN rq ON l.feature = rq.feature")
def robust_scale(spark, sf_dir):
    return screening.robust_scale(features(spark, sf_dir)).withColumn("scaled", rounded(F.col("scaled"), 5))


@query("tidy_unpivot", " SELECT series_id, feature, round(value, 6) + 0.0 AS value FROM lf")
def tidy_unpivot(spark, sf_dir):
    return features(spark, sf_dir).withColumn("value", rounded(F.col("value")))


@query("class_information", """, cb AS (SELECT l.feature, c.market AS label, value, min(value) OVER (PARTITION BY l.feature) AS lo, max(value) OVER (PARTITION BY l.feature) AS hi FROM lf l JOIN cat c ON c.series_id = l.series_id WHERE value IS NOT NULL),
  cc AS (SELECT feature, CASE WHEN hi > lo THEN least(floor((value - lo) / (hi - lo) * 5), 4) ELSE 0 END AS bin, label, count(*)::DOUBLE AS k FROM cb GROUP BY ALL), cd AS (SELECT *, sum(k) OVER (PARTITION BY feature) AS n, sum(k) OVER (PARTITION BY feature, bin) AS ki, sum(k) OVER (PARTITION BY feature, label) AS kj FROM cc)
  SELECT feature, round(sum(k / n * ln(k * n / (ki * kj))), 6) + 0.0 AS information FROM cd GROUP BY feature""")
def class_information(spark, sf_dir):
    labels = all_returns(spark, sf_dir).select("series_id", F.col("market").alias("label")).distinct()
    return screening.class_information(features(spark, sf_dir), labels).withColumn("information", rounded(F.col("information")))


@query("correlation_prune", """, ap AS (SELECT a.feature AS f1, b.feature AS f2, coalesce(round(abs(CASE WHEN stddev_pop(a.value) > 0 AND stddev_pop(b.value) > 0 THEN corr(a.value, b.value) END), 12), 0) AS v FROM lf a JOIN lf b ON a.series_id = b.series_id AND a.feature <= b.feature WHERE a.value IS NOT NULL AND b.value IS NOT NULL GROUP BY ALL),
  am AS (SELECT f, round(sum(v) / count(*), 12) AS m FROM (SELECT f1 AS f, v FROM ap UNION ALL SELECT f2, v FROM ap WHERE f1 <> f2) GROUP BY f), an AS (SELECT f1, f2, row_number() OVER (ORDER BY f1, f2) AS n, CASE WHEN x.m > y.m THEN f1 ELSE f2 END AS loser FROM ap JOIN am x ON x.f = f1 JOIN am y ON y.f = f2 WHERE f1 <> f2 AND v > 0.9),
  ag AS (SELECT 0::BIGINT AS n, []::VARCHAR[] AS gone UNION ALL SELECT ag.n + 1, CASE WHEN list_contains(gone, f1) OR list_contains(gone, f2) THEN gone ELSE list_append(gone, loser) END FROM ag JOIN an ON an.n = ag.n + 1)
  SELECT f AS feature FROM am WHERE NOT list_contains((SELECT gone FROM ag ORDER BY n DESC LIMIT 1), f)""")
def correlation_prune(spark, sf_dir):
    return spark.createDataFrame([(n,) for n in screening.correlation_prune(features(spark, sf_dir))], "feature string")


def quantile_normal(spark, sf_dir):
    return screening.quantile_normal(features(spark, sf_dir))


QUERIES |= {"quantile_normal": quantile_normal}
