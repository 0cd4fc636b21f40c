"""Queries that choose among clusterings of two feature sets: the first half of each vector (base), and all of it (with_chaos)."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import functions as F

from ..functions.columns import rounded
from ..operators import clusters, selection
from ..settings import chosen
from ..sources.shared import stored
from .cluster_queries import _BASE, _CH, _DB, _PROFILE, _SIL, _SIZES, components, ks, points, vectors

QUERIES: dict = {}
SQL: dict[str, str] = {}

_TWO = _BASE.replace("cfg AS (SELECT k, 'k' || k AS config FROM (SELECT unnest(range(2, 9)) AS k))", "cfg AS (SELECT k, s, s || '_k' || k AS config FROM (SELECT unnest(range(2, 9)) AS k), (VALUES ('base'), ('with_chaos')) t(s))").replace(
    "e.embedding FROM embeddings e", "CASE WHEN c.s = 'base' THEN e.embedding[1:32] ELSE e.embedding END AS embedding FROM embeddings e"
)
_METRICS = _TWO + _DB + _CH + _SIL + _SIZES + """, mn AS (SELECT config, min(size) AS min_size FROM sz GROUP BY config), rm AS (SELECT * FROM si JOIN ch USING (config) JOIN db USING (config) JOIN sf USING (config) JOIN mn USING (config)),
  rs AS (SELECT *, silhouette + 0.35 * coalesce((calinski_harabasz - min(calinski_harabasz) OVER ()) / nullif(max(calinski_harabasz) OVER () - min(calinski_harabasz) OVER (), 0), 0)
    - 0.35 * coalesce((davies_bouldin - min(davies_bouldin) OVER ()) / nullif(max(davies_bouldin) OVER () - min(davies_bouldin) OVER (), 0), 0) - 0.5 * max_share - 0.3 * (n_small + n_single) / k AS score FROM rm),
  mt AS (SELECT config, regexp_replace(config, '_k[0-9]+$', '') AS feature_set, CASE WHEN k % 2 = 0 THEN 'ward' ELSE 'gmm' END AS method, k, score, silhouette, max_share, min_size, n_small FROM rs)"""
_SELECTED = _METRICS + """, fi AS (SELECT * FROM mt WHERE max_share <= 0.9 AND min_size >= 5), se AS (SELECT 'overall' AS selection_scope, 'overall' AS k_bucket, * FROM (SELECT *, row_number() OVER (ORDER BY round(score, 9) DESC, round(silhouette, 9) DESC, config) AS nth FROM fi) WHERE nth = 1
  UNION ALL SELECT 'best_k', k::VARCHAR, * FROM (SELECT *, row_number() OVER (PARTITION BY feature_set, k ORDER BY round(score, 9) DESC, round(silhouette, 9) DESC, config) AS nth FROM fi) WHERE nth = 1)"""


def query(name: str, sql: str):
    def add(f):
        QUERIES[name] = f
        SQL[name] = sql
        return f

    return add


def both(spark, sf_dir):
    """The vectors of every configuration of both feature sets."""
    rows = vectors(spark, sf_dir)
    half = rows.select(F.concat(F.lit("base_"), "config").alias("config"), "point", "cluster", F.slice("vector", 1, 32).alias("vector"))
    return half.unionByName(rows.withColumn("config", F.concat(F.lit("with_chaos_"), "config")))


def metrics(spark, sf_dir):
    """Measures of every configuration, stored: they are few rows, and what chooses among them reads them several times."""
    v = both(spark, sf_dir)
    p = components(v)
    least = v.groupBy("config", "cluster").count().groupBy("config").agg(F.min("count").alias("min_size"))
    parts = [clusters.silhouette(v, space=F.regexp_replace("config", "_k[0-9]+$", "")), clusters.calinski_harabasz(p), clusters.davies_bouldin(p), clusters.size_facts(v), least]
    ranked = clusters.ranking(reduce(lambda a, b: a.join(b, "config"), parts))
    named = ranked.withColumns({"feature_set": F.regexp_replace("config", "_k[0-9]+$", ""), "method": F.when(F.col("k") % 2 == 0, "ward").otherwise("gmm")})
    return stored(named.select("config", "feature_set", "method", "k", "score", "silhouette", "max_share", "min_size", "n_small"), "metrics")


def selected(spark, sf_dir):
    return selection.select_configs(metrics(spark, sf_dir), ks(), chosen("max_share", selection.MAX_SHARE), chosen("least_size", selection.LEAST_SIZE))


@query("eligible_configs", _METRICS + " SELECT config, k::BIGINT AS k, round(score, 6) + 0.0 AS score FROM mt WHERE k >= 2 AND max_share <= 0.9 AND n_small <= 2")
def eligible_configs(spark, sf_dir):
    return selection.eligible_configs(metrics(spark, sf_dir)).select("config", "k", rounded(F.col("score")).alias("score"))


@query("top_configs", _METRICS + """, tc AS (SELECT *, row_number() OVER (PARTITION BY feature_set, method ORDER BY round(score, 9) DESC, round(silhouette, 9) DESC, config) AS place FROM mt WHERE k >= 2 AND max_share <= 0.9 AND n_small <= 2)
  SELECT feature_set, method, place::INTEGER AS place, config, round(score, 6) + 0.0 AS score FROM tc WHERE place <= 3""")
def top_configs(spark, sf_dir):
    return selection.top_configs(metrics(spark, sf_dir)).select("feature_set", "method", "place", "config", rounded(F.col("score")).alias("score"))


@query("selected_configs", _SELECTED + " SELECT selection_scope, k_bucket, config, feature_set, round(score, 6) + 0.0 AS score FROM se")
def selected_configs(spark, sf_dir):
    return selected(spark, sf_dir).select("selection_scope", "k_bucket", "config", "feature_set", rounded(F.col("score")).alias("score"))


@query("selected_assignments", _SELECTED + " SELECT DISTINCT v.config, v.point, v.cluster FROM vec v WHERE v.config IN (SELECT config FROM se)")
def selected_assignments(spark, sf_dir):
    return selection.selected_assignments(selected(spark, sf_dir), both(spark, sf_dir)).select("config", "point", "cluster")


_AGREE = """, cl AS (SELECT v.config, v.cluster AS a, (v.point % 4)::INTEGER AS b, count(*)::DOUBLE AS k FROM vec v GROUP BY ALL), cm AS (SELECT *, sum(k) OVER (PARTITION BY config) AS n, sum(k) OVER (PARTITION BY config, a) AS ka, sum(k) OVER (PARTITION BY config, b) AS kb FROM cl),
  ra AS (SELECT config, sum(ka * (ka - 1) / 2) AS r FROM (SELECT DISTINCT config, a, ka FROM cm) GROUP BY config), rb AS (SELECT config, sum(kb * (kb - 1) / 2) AS r FROM (SELECT DISTINCT config, b, kb FROM cm) GROUP BY config),
  tt AS (SELECT config, sum(k * (k - 1) / 2) AS c, any_value(n * (n - 1) / 2) AS t, sum(k / n * ln(k * n / (ka * kb))) AS mi, -sum(k / n * ln(ka / n)) AS ha, -sum(k / n * ln(kb / n)) AS hb FROM cm GROUP BY config),
  ag AS (SELECT tt.config, (c - ra.r * rb.r / t) / ((ra.r + rb.r) / 2 - ra.r * rb.r / t) AS ari_mean, 2 * mi / (ha + hb) AS nmi_mean FROM tt JOIN ra USING (config) JOIN rb USING (config))"""


@query("method_comparison", _SELECTED + _AGREE + """, bs AS (SELECT config, max(size / n) AS share_max, min(size / n) AS share_min FROM sz GROUP BY config), mc AS (SELECT se.*, share_max, share_min, ari_mean, nmi_mean FROM se LEFT JOIN bs USING (config) LEFT JOIN ag USING (config))
  SELECT selection_scope, k_bucket, """ + ", ".join(f"max(config) FILTER (WHERE feature_set = '{s}') AS {s}_config" for s in ("base", "with_chaos")) + ", " + ", ".join(f"round(max({c}) FILTER (WHERE feature_set = 'with_chaos') - max({c}) FILTER (WHERE feature_set = 'base'), 6) + 0.0 AS delta_{c}" for c in ("silhouette", "share_max", "ari_mean")) + " FROM mc GROUP BY ALL")
def method_comparison(spark, sf_dir):
    v = both(spark, sf_dir)
    agreement = clusters.agreement(v.select("config", F.col("cluster").alias("a"), (F.col("point") % 4).cast("int").alias("b"))).withColumnsRenamed({"ari": "ari_mean", "nmi": "nmi_mean"})
    rows = selection.method_comparison(selection.with_balance(selected(spark, sf_dir), clusters.balance(v), agreement))
    return rows.select("selection_scope", "k_bucket", "base_config", "with_chaos_config", *(rounded(F.col(c)).alias(c) for c in ("delta_silhouette", "delta_share_max", "delta_ari_mean")))


_SHORT = ["base_k3", "with_chaos_k5", "no_such_config"]


@query("shortlist_validation", _SELECTED + f", sh AS (SELECT unnest({_SHORT}) AS config)" + " SELECT config, config IN (SELECT config FROM se) AS in_selected, config IN (SELECT config FROM vec) AS in_assignments, config IN (SELECT config FROM vec) AS available FROM sh")
def shortlist_validation(spark, sf_dir):
    return selection.validate_shortlist(spark.createDataFrame([(c,) for c in _SHORT], "config string"), selected(spark, sf_dir), both(spark, sf_dir))


@query("profile_heatmap", _BASE + _PROFILE + """, hm AS (SELECT config, dim, round(max(abs(z)), 9) AS m FROM pf GROUP BY ALL), ho AS (SELECT config, dim, row_number() OVER (PARTITION BY config ORDER BY m DESC, dim) AS column_order FROM hm)
  SELECT config, cluster, dim::INTEGER AS dim, round(z, 6) + 0.0 AS z, column_order::INTEGER AS column_order FROM pf JOIN ho USING (config, dim)""")
def profile_heatmap(spark, sf_dir):
    return selection.heatmap(clusters.profiles(points(spark, sf_dir))).withColumn("z", rounded(F.col("z")))
