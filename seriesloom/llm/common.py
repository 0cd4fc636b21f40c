"""Small helpers that the text operators share: column checks, the shared folder, and linked groups."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: ASCII white space, and the letters of which A-Z are lowered; fixed values of the contracts.
ASCII_SPACE = " \t\n\x0b\x0c\r"
UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
LOWER = "abcdefghijklmnopqrstuvwxyz"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def need(df: DataFrame, *columns: str) -> None:
    """Raise if the frame lacks one of the columns."""
    if missing := [c for c in columns if c not in df.columns]:
        raise ValueError(f"missing columns {missing}; there are {df.columns}")


def ascii_lower(column: Column) -> Column:
    return F.translate(column, UPPER, LOWER)


def shuffle_partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def small_batches(spark: SparkSession, rows: int = 1000) -> None:
    """Let Python workers of this session get at most so many rows at a time: whole texts may be long."""
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    now = int(spark.conf.get(name))
    if now <= 0 or now > rows:
        spark.conf.set(name, str(rows))


def shared_dir(spark: SparkSession) -> str:
    """The folder that all executors share: ``spark.checkpoint.dir`` where it is set.

    Only a session in one local process gets a folder of its own if none is named.
    """
    sc = spark.sparkContext
    if named := sc.getConf().get("spark.checkpoint.dir") or sc.getCheckpointDir():
        return named
    if not sc.master.startswith("local") or sc.master.startswith("local-cluster"):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    sc.setCheckpointDir(tempfile.mkdtemp(prefix="seriesloom-"))
    return sc.getCheckpointDir()


#: Folders of the tables that this process has written and not yet deleted, in their order.
_written: list[str] = []


def written(df: DataFrame, name: str) -> DataFrame:
    """The frame, written once as a table in the shared folder and read back.

    This cuts the lineage: a lost executor loses none of it, and several readers don't compute it again. A result may read the
    table until it is itself written, so it stays; :func:`only` deletes the tables behind a result that needs them no more,
    and all of an application's lie in one folder of its id.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark).rstrip('/')}/seriesloom/{spark.sparkContext.applicationId}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    _written.append(path)
    return spark.read.schema(df.schema).parquet(path)


def _delete(spark: SparkSession, path: str) -> None:
    folder = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    folder.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(folder, True)
    if path in _written:
        _written.remove(path)


def forget(df: DataFrame) -> None:
    """Delete the files of a table made by :func:`written` when nothing reads it any more."""
    for file in df.inputFiles()[:1]:
        folder = file.rsplit("/", 1)[0]
        _delete(df.sparkSession, next((p for p in _written if p.rsplit("/", 1)[-1] == folder.rsplit("/", 1)[-1]), folder))


def only(make: Callable[[], DataFrame], name: str) -> DataFrame:
    """What ``make`` returns, written as a table, without the tables that were written on the way to it."""
    before = len(_written)
    out = written(make(), name)
    for path in _written[before:-1]:
        _delete(out.sparkSession, path)
    return out


def semi_join_counted(rows: DataFrame, keys: DataFrame, on: list[str]) -> DataFrame:
    """The rows whose key is one of ``keys``, a table of unique keys with the number ``n`` of rows that each has.

    Keys above a quarter of an even share of a partition are at most four for each partition: these are broadcast, so their rows
    stay where they are; only the rows of the other keys move.
    """
    share = (keys.agg(F.sum("n")).first()[0] or 0) / (4 * shuffle_partitions(rows.sparkSession))
    hot = F.broadcast(keys.where(F.col("n") > share).select(on))
    rest = keys.where(F.col("n") <= share).select(on)
    return rows.join(hot, on, "left_semi").unionByName(rows.join(hot, on, "left_anti").join(rest, on, "left_semi"))


def components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """Connected groups of undirected edges: one row ``(node, root)`` for each node that an edge names.

    Alternates two star steps (each node links its larger neighbours to its smallest one, then its smaller
    ones) until no edge changes; the rounds grow with the logarithm of the longest chain. Every round is
    aggregations and joins on node keys and goes to a table in the shared folder. A node that is linked to
    very many others is only ever aggregated by ``min`` (map-side) or is a join key that Spark may split.
    """
    e = edges.select(F.col(a).alias("u"), F.col(b).alias("v")).where("u <> v")
    now = written(e.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(), "edges")
    before = None
    while True:
        both = now.unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.join(low, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        star = large.where("u <> v").distinct()
        # edges now point from the larger node to a smaller one
        least = star.groupBy("u").agg(F.min("v").alias("m"))
        small = star.join(least, "u").select(F.col("v").alias("x"), "m").where("x <> m")
        small = small.select(F.col("x").alias("u"), F.col("m").alias("v"))
        after = written(small.unionByName(least.select("u", F.col("m").alias("v"))).distinct(), "edges")
        # settled once no node has two parents and no parent has a parent
        done = _settled(after)
        if before is not None:
            forget(before)
        before, now = now, after
        if done:
            break
    forget(before)
    roots = now.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct()
    return now.select(F.col("u").alias("node"), F.col("v").alias("root")).unionByName(roots)


def _settled(edges: DataFrame) -> bool:
    twice = edges.groupBy("u").count().where("count > 1").limit(1)
    chained = edges.select("u").join(edges.select(F.col("v").alias("u")), "u", "left_semi").limit(1)
    return twice.unionByName(chained.select("u", F.lit(1).cast("long").alias("count"))).isEmpty()
