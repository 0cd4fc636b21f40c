"""Queries over clusterings of the embedding table: labels as given, and labels modulo k as further configurations."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import functions as F

from ..functions.columns import rounded
from ..operators import clusters
from ..settings import chosen
from ..sources.panels import table

QUERIES: dict = {}
SQL: dict[str, str] = {}



def ks() -> range:
    return range(chosen("k_min", 2), chosen("k_max", 8) + 1)


_BASE = """WITH cfg AS (SELECT k, 'k' || k AS config FROM (SELECT unnest(range(2, 9)) AS k)),
  vec AS (SELECT c.config, e.vec_id AS point, (e.label % c.k)::INTEGER AS cluster, e.embedding FROM embeddings e, cfg c),
  pts AS (SELECT config, point, cluster, unnest(range(len(embedding))) AS dim, unnest(embedding)::DOUBLE AS x FROM vec),
  cen AS (SELECT config, cluster, dim, avg(x) AS c, count(*) AS n FROM pts GROUP BY ALL),
  dst AS (SELECT p.config, p.cluster, p.point, sum((x - c) * (x - c)) AS d2 FROM pts p JOIN cen USING (config, cluster, dim) GROUP BY ALL)"""
_DB = """, sp AS (SELECT config, cluster, avg(sqrt(d2)) AS s FROM dst GROUP BY ALL), ap AS (SELECT a.config, a.cluster AS i, b.cluster AS j, sqrt(sum((a.c - b.c) * (a.c - b.c))) AS d FROM cen a JOIN cen b ON a.config = b.config AND a.dim = b.dim AND a.cluster <> b.cluster GROUP BY ALL),
  wr AS (SELECT ap.config, i, max((x.s + y.s) / d) AS w FROM ap JOIN sp x ON x.config = ap.config AND x.cluster = i JOIN sp y ON y.config = ap.config AND y.cluster = j GROUP BY ALL), db AS (SELECT config, avg(w) AS davies_bouldin FROM wr GROUP BY config)"""
_CH = """, wi AS (SELECT config, sum(d2) AS w, count(*) AS n, count(DISTINCT cluster) AS k FROM dst GROUP BY config), al AS (SELECT config, dim, avg(x) AS m FROM pts GROUP BY ALL),
  be AS (SELECT c.config, sum(c.n * (c.c - a.m) * (c.c - a.m)) AS b FROM cen c JOIN al a USING (config, dim) GROUP BY 1), ch AS (SELECT wi.config, (b / (k - 1)) / (w / (n - k)) AS calinski_harabasz FROM wi JOIN be USING (config))"""
_SIL = """, far AS (SELECT a.config, a.point, a.cluster, b.cluster AS other, sum(list_distance(a.embedding::DOUBLE[], b.embedding::DOUBLE[])) AS t, count(*) AS n FROM vec a JOIN vec b ON a.config = b.config GROUP BY ALL),
  ea AS (SELECT config, point, max(CASE WHEN other = cluster AND n > 1 THEN t / (n - 1) END) AS a, min(CASE WHEN other <> cluster THEN t / n END) AS b FROM far GROUP BY ALL),
  si AS (SELECT config, avg(CASE WHEN a IS NULL OR b IS NULL THEN 0 ELSE (b - a) / greatest(a, b) END) AS silhouette FROM ea GROUP BY config)"""
_SIZES = """, sz AS (SELECT config, cluster, count(*) AS size, sum(count(*)) OVER (PARTITION BY config) AS n FROM vec GROUP BY config, cluster),
  sf AS (SELECT config, count(*) AS k, max(size) / max(n) AS max_share, count(*) FILTER (WHERE size < ceil(n * 0.05)) AS n_small, count(*) FILTER (WHERE size = 1) AS n_single FROM sz GROUP BY config)"""


def query(name: str, sql: str):
    def add(f):
        QUERIES[name] = f
        SQL[name] = _BASE + sql
        return f

    return add


def vectors(spark, sf_dir):
    """Every vector, of the table's own type, once for each configuration k2 to k8, its cluster the label modulo k."""
    rows = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("point"), "label", F.col("embedding").alias("vector"))
    return rows.withColumn("k", F.explode(F.array(*(F.lit(k) for k in ks())))).select(F.concat(F.lit("k"), "k").alias("config"), "point", F.expr("label % k").cast("int").alias("cluster"), "vector")


def components(rows):
    """(config, point, cluster, dim, x): the vectors' components as doubles."""
    return rows.select("config", "point", "cluster", F.posexplode("vector").alias("dim", "x")).withColumn("x", F.col("x").cast("double"))


def points(spark, sf_dir):
    return components(vectors(spark, sf_dir))


@query("cluster_balance", _SIZES + " SELECT config, cluster, size::BIGINT AS size, round(size / n, 6) AS share, (dense_rank() OVER (PARTITION BY config ORDER BY size DESC))::INTEGER AS size_rank FROM sz")
def cluster_balance(spark, sf_dir):
    return clusters.balance(vectors(spark, sf_dir)).withColumn("share", rounded(F.col("share")))


_PROFILE = """, pw AS (SELECT config, dim, avg(x) AS mean_all, stddev_samp(x) AS std_all FROM pts GROUP BY ALL), po AS (SELECT config, cluster, dim, avg(x) AS mean, median(x) AS median, stddev_samp(x) AS std FROM pts GROUP BY ALL),
  pf AS (SELECT po.*, CASE WHEN std_all > 0 THEN (mean - mean_all) / std_all ELSE 0 END AS z FROM po JOIN pw USING (config, dim))"""


@query("cluster_profiles", _PROFILE + " SELECT config, cluster, dim::INTEGER AS dim, round(mean, 6) + 0.0 AS mean, round(median, 6) + 0.0 AS median, round(std, 6) AS std, round(z, 6) + 0.0 AS z FROM pf")
def cluster_profiles(spark, sf_dir):
    p = clusters.profiles(points(spark, sf_dir))
    return p.select("config", "cluster", "dim", *(rounded(F.col(c)).alias(c) for c in ("mean", "median", "std", "z")))


@query("key_features", _PROFILE + ", kf AS (SELECT *, row_number() OVER (PARTITION BY config, cluster ORDER BY abs(round(z, 9)) DESC, dim) AS nth FROM pf) SELECT config, cluster, dim::INTEGER AS dim, nth::INTEGER AS nth, round(z, 6) + 0.0 AS z FROM kf WHERE nth <= 5")
def key_features(spark, sf_dir):
    k = clusters.key_dimensions(clusters.profiles(points(spark, sf_dir)))
    return k.select("config", "cluster", "dim", "nth", rounded(F.col("z")).alias("z"))


@query("davies_bouldin", _DB + " SELECT config, round(davies_bouldin, 6) AS davies_bouldin FROM db")
def davies_bouldin(spark, sf_dir):
    return clusters.davies_bouldin(points(spark, sf_dir)).withColumn("davies_bouldin", rounded(F.col("davies_bouldin")))


@query("calinski_harabasz", _CH + " SELECT config, round(calinski_harabasz, 6) AS calinski_harabasz FROM ch")
def calinski_harabasz(spark, sf_dir):
    return clusters.calinski_harabasz(points(spark, sf_dir)).withColumn("calinski_harabasz", rounded(F.col("calinski_harabasz")))


@query("silhouette", _SIL + " SELECT config, round(silhouette, 6) + 0.0 AS silhouette FROM si")
def silhouette(spark, sf_dir):
    return clusters.silhouette(vectors(spark, sf_dir), space=F.lit("all")).withColumn("silhouette", rounded(F.col("silhouette")))


@query(
    "ari_nmi",
    """, cl AS (SELECT v.config, v.cluster AS a, (v.point % 4)::INTEGER AS b, count(*)::DOUBLE AS k FROM vec v GROUP BY ALL), cm AS (SELECT *, sum(k) OVER (PARTITION BY config) AS n, sum(k) OVER (PARTITION BY config, a) AS ka, sum(k) OVER (PARTITION BY config, b) AS kb FROM cl),
  ra AS (SELECT config, sum(ka * (ka - 1) / 2) AS r FROM (SELECT DISTINCT config, a, ka FROM cm) GROUP BY config), rb AS (SELECT config, sum(kb * (kb - 1) / 2) AS r FROM (SELECT DISTINCT config, b, kb FROM cm) GROUP BY config),
  tt AS (SELECT config, sum(k * (k - 1) / 2) AS c, any_value(n * (n - 1) / 2) AS t, sum(k / n * ln(k * n / (ka * kb))) AS mi, -sum(k / n * ln(ka / n)) AS ha, -sum(k / n * ln(kb / n)) AS hb FROM cm GROUP BY config)
  SELECT tt.config, round((c - ra.r * rb.r / t) / ((ra.r + rb.r) / 2 - ra.r * rb.r / t), 6) + 0.0 AS ari, round(2 * mi / (ha + hb), 6) + 0.0 AS nmi FROM tt JOIN ra USING (config) JOIN rb USING (config)""",
)
def ari_nmi(spark, sf_dir):
    pairs = vectors(spark, sf_dir).select("config", F.col("cluster").alias("a"), (F.col("point") % 4).cast("int").alias("b"))
    return clusters.agreement(pairs).select("config", rounded(F.col("ari")).alias("ari"), rounded(F.col("nmi")).alias("nmi"))


@query(
    "ranking_score",
    _DB + _CH + _SIL + _SIZES + """, rm AS (SELECT * FROM si JOIN ch USING (config) JOIN db USING (config) JOIN sf USING (config)), rs AS (SELECT config, silhouette + 0.35 * coalesce((calinski_harabasz - min(calinski_harabasz) OVER ()) / nullif(max(calinski_harabasz) OVER () - min(calinski_harabasz) OVER (), 0), 0)
    - 0.35 * coalesce((davies_bouldin - min(davies_bouldin) OVER ()) / nullif(max(davies_bouldin) OVER () - min(davies_bouldin) OVER (), 0), 0) - 0.5 * max_share - 0.3 * (n_small + n_single) / k AS score FROM rm)
  SELECT config, round(score, 6) + 0.0 AS score, (row_number() OVER (ORDER BY round(score, 9) DESC, config))::INTEGER AS place FROM rs""",
)
def ranking_score(spark, sf_dir):
    v, p = vectors(spark, sf_dir), points(spark, sf_dir)
    parts = [clusters.silhouette(v, space=F.lit("all")), clusters.calinski_harabasz(p), clusters.davies_bouldin(p), clusters.size_facts(v)]
    ranked = clusters.ranking(reduce(lambda a, b: a.join(b, "config"), parts))
    return ranked.select("config", rounded(F.col("score")).alias("score"), "place")
