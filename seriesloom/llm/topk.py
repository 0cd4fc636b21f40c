"""Exact top-k inner products: vectors by descending length, SVD-rotated partial sums, Cauchy-Schwarz bounds.

Candidates are dealt by ranges of descending length into groups of about ``GROUP_ROWS``; a group stays where it is, and blocks
of queries, a stated set, come to it. Vectors are turned by the singular vectors of all candidates (from their summed
second moments), so that the first coordinates carry most of a product. With p the partial sum of the first
coordinates, no product can exceed p + |rest of q| |rest of c|; only pairs whose bound reaches the query's k-th best so
far are computed, in integers.

There are two passes. The first takes all queries to the group of the longest vectors, of which every ``FIRST_BLOCKS`` blocks of queries
get a copy in a task of their own; it gives each query a k-th score. The second takes a query only to the groups whose longest vector times the query's length can reach that score: these
are a run of groups from the longest on, so a query block needs no list of groups, and groups beyond are never read for it.
Candidates move once (once for every ``QUERY_BLOCKS`` blocks of queries, so that no task has to meet an unbounded number of them); what moves
besides are query blocks, for groups that they can't pass over. Where all vectors are of one length the bound passes nothing
over, and query blocks go to all groups: an exact search can't do with less.

Defined cases: vectors that are null, empty, or hold null or non-finite components take no part, nor do those of
another length than the commonest (the larger on ties), with which no inner product is defined; equal scores rank the smaller id first; a row that
repeats another counts again as a candidate, once as a query; "the query's own" row is every row of its id, whatever the vector; a
null id is no query and no candidate; an empty table gives no rows; extra columns are ignored. Scores are exact while sums of products stay below 2**53.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import need, shuffle_partitions, written

CANDIDATES_PER_BLOCK = 2048
QUERIES_PER_BLOCK = 128
#: Candidates that a group holds, about; and blocks of queries that one task takes to a group.
GROUP_ROWS = 8192
QUERY_BLOCKS = 512
#: Blocks of queries that one task takes to the first group, which all of them meet.
FIRST_BLOCKS = 16
#: Groups whose tops the driver reads, at most: a query block may be sent to the groups between two of them for nothing.
GATES = 1024
STEPS = (8, 24)


def scaled(vector: Column, factor: float = 256.0) -> Column:
    """The components as floor(factor * x)."""
    return F.transform(vector, lambda x: F.floor(x.cast("double") * F.lit(factor)).cast("long"))


def _valid(vectors: DataFrame, id_col: str, vector_col: str, factor: float) -> DataFrame:
    need(vectors, id_col, vector_col)
    v = F.col("v")
    bad = lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf"))
    rows = vectors.select(F.col(id_col).cast("long").alias("id"), F.col(vector_col).alias("v"))
    rows = rows.where(F.col("id").isNotNull() & v.isNotNull() & (F.size(v) > 0) & ~F.exists(v, lambda x: bad(x.cast("double"))))
    return rows.select("id", scaled(v, factor).alias("v"))


def rotation(moments: np.ndarray) -> np.ndarray:
    """Right singular vectors of the candidates, most energy first, from their second moments."""
    _, vectors = np.linalg.eigh(moments)
    return vectors[:, ::-1]


def _second_moments(rows: DataFrame, dim: int) -> np.ndarray:
    """Sum of v v' over all rows: one small matrix from each task."""

    def part(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total = np.zeros((dim, dim))
        for pdf in batches:
            if len(pdf):
                m = np.stack(pdf["v"].to_numpy()).astype(float)
                total += m.T @ m
        yield pd.DataFrame({"at": np.arange(dim * dim), "x": total.ravel()})

    summed = rows.mapInPandas(part, "at int, x double").groupBy("at").agg(F.sum("x").alias("x")).toPandas()
    return summed.sort_values("at")["x"].to_numpy().reshape(dim, dim) if len(summed) else np.eye(dim)


def _blocks(rows: DataFrame, size: int, bounds: bool = False) -> DataFrame:
    """(top, ids, matrix): blocks of rows in their order, with the largest length; with bounds, of queries: also keys, needs and ``upto``, the largest."""

    def cut(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for at in range(0, len(pdf), size):
                some = pdf.iloc[at : at + size]
                m = np.stack(some["v"].to_numpy()).astype("<i8")
                block = {"top": [float(some["length"].max())], "ids": [some["id"].to_numpy("<i8").tobytes()], "matrix": [m.tobytes()]}
                if bounds:
                    block |= {"keys": [some["q"].to_numpy("<i8").tobytes()], "needs": [some["need"].to_numpy("<f8").tobytes()], "upto": [int(some["upto"].max())]}
                yield pd.DataFrame(block)

    return rows.mapInPandas(cut, "top double, ids binary, matrix binary" + ", keys binary, needs binary, upto int" * bounds)


class Best:
    """Running k best (score, id) for each query of a block; ties to the smaller id. Products below ``needs`` don't matter."""

    def __init__(self, ids: np.ndarray, queries: np.ndarray, turn: np.ndarray, k: int, needs: np.ndarray | None = None):
        self.ids, self.q, self.k = ids, queries, k
        self.needs = np.full(len(ids), -np.inf) if needs is None else needs
        self.turned = queries.astype(float) @ turn
        self.length = np.sqrt((self.turned**2).sum(axis=1))
        self.rest = [np.sqrt((self.turned[:, s:] ** 2).sum(axis=1)) for s in STEPS]
        self.turn = turn
        n = len(ids)
        self.score = np.full((n, k), np.iinfo(np.int64).min)
        self.who = np.full((n, k), np.iinfo(np.int64).max)
        self.found = np.zeros(n, np.int64)

    def _needed(self) -> np.ndarray:
        """What a product must reach to matter; equal scores matter, for a smaller id."""
        return np.maximum(self.needs, np.where(self.found >= self.k, self.score[:, -1].astype(float), -np.inf))

    def take(self, top: float, ids: np.ndarray, c: np.ndarray, turned: np.ndarray | None = None) -> None:
        slack = 1e-9 * (1 + self.length * top)  # rounding of the turned sums
        needed = self._needed() - slack
        rows = np.flatnonzero(self.length * top >= needed)
        if not len(rows):
            return
        turned = c.astype(float) @ self.turn if turned is None else turned
        open_ = np.ones((len(rows), len(ids)), bool)
        partial, done = np.zeros(open_.shape), 0
        for step, rest in zip(STEPS, self.rest, strict=True):
            partial += self.turned[rows, done:step] @ turned[:, done:step].T
            done = step
            left = np.sqrt((turned[:, step:] ** 2).sum(axis=1))
            open_ &= partial + rest[rows, None] * left[None, :] >= needed[rows, None]
        for at, r in enumerate(rows.tolist()):
            some = np.flatnonzero(open_[at] & (ids != self.ids[r]))
            if not len(some):
                continue
            score = np.concatenate([self.score[r, : self.found[r]], c[some] @ self.q[r]])
            who = np.concatenate([self.who[r, : self.found[r]], ids[some]])
            order = np.lexsort((who, -score))[: self.k]
            n = self.found[r] = len(order)
            self.score[r, :n], self.who[r, :n] = score[order], who[order]

    def rows(self) -> pd.DataFrame:
        q = np.repeat(np.arange(len(self.ids)), self.found)
        nth = np.concatenate([np.arange(n) for n in self.found.tolist()]) if len(q) else q
        return pd.DataFrame({"at": q, "query_id": self.ids[q], "vec_id": self.who[q, nth], "score": self.score[q, nth]})


def _meet(queries: DataFrame, candidates: DataFrame, turn, dim: int, k: int, query_blocks: int, a_task: int | None = None) -> DataFrame:
    """(q, query_id, vec_id, score): the k best of each query in each group that its block (columns of :func:`_blocks`, g) is sent to."""
    lanes = max(1, -(-query_blocks // (a_task or QUERY_BLOCKS)))
    none = F.lit(None).cast("binary")
    copies = F.explode(F.sequence(F.lit(0), F.lit(lanes - 1))).alias("lane")
    held = candidates.select("g", copies, F.lit(0).alias("kind"), "top", "ids", "matrix", none.alias("keys"), none.alias("needs"))
    lane = F.pmod(F.xxhash64("keys", F.lit(1)), F.lit(lanes)).cast("int").alias("lane")
    asking = queries.select("g", lane, F.lit(1).alias("kind"), "top", "ids", "matrix", "keys", "needs")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        now, group = None, []
        for pdf in batches:
            for g, lane, kind, top, ids, matrix, keys, needs in pdf[["g", "lane", "kind", "top", "ids", "matrix", "keys", "needs"]].itertuples(index=False):
                m, who = np.frombuffer(matrix, "<i8").reshape(-1, dim), np.frombuffer(ids, "<i8")
                if (g, lane) != now:
                    now, group = (g, lane), []
                if kind == 0:
                    group.append((top, who, m, m.astype(float) @ turn.value))
                    continue
                best = Best(who, m, turn.value, k, np.frombuffer(needs, "<f8"))
                for block in group:
                    best.take(*block)
                found = best.rows()
                yield found.assign(q=np.frombuffer(keys, "<i8")[found["at"].to_numpy()])[["q", "query_id", "vec_id", "score"]]

    met = held.unionByName(asking).repartition("g", "lane").sortWithinPartitions("g", "lane", "kind", F.desc("top"))
    return met.mapInPandas(run, "q long, query_id long, vec_id long, score long")


def top_k(vectors: DataFrame, queries: DataFrame, k: int = 5, id_col: str = "vec_id", vector_col: str = "embedding", factor: float = 256.0, group_rows: int = GROUP_ROWS) -> DataFrame:
    """(query_id, rank, vec_id, score): each query's k largest integer products over all other ids."""
    spark = vectors.sparkSession
    rows = written(_valid(vectors, id_col, vector_col, factor), "vectors")
    common = rows.groupBy(F.size("v").alias("dim")).count().orderBy(F.desc("count"), F.desc("dim")).limit(1).collect()
    dim, n = (common[0]["dim"], common[0]["count"]) if common else (1, 0)
    rows = rows.where(F.size("v") == dim)
    turn = spark.sparkContext.broadcast(rotation(_second_moments(rows, dim)))
    length = F.sqrt(F.aggregate("v", F.lit(0.0), lambda a, x: a + x.cast("double") * x))
    dealt = rows.withColumn("length", length).repartitionByRange(max(1, -(-n // group_rows)), F.desc("length"), "id").sortWithinPartitions(F.desc("length"), "id")
    candidates = written(_blocks(dealt, CANDIDATES_PER_BLOCK).withColumn("g", F.spark_partition_id()), "candidate-blocks")
    asked = _valid(queries, id_col, vector_col, factor).where(F.size("v") == dim).distinct().withColumn("length", length)
    asked = written(asked.withColumn("q", F.monotonically_increasing_id()), "queries")
    blocks = -(-asked.count() // QUERIES_PER_BLOCK)
    parts = max(1, min(shuffle_partitions(spark), blocks))
    low, high = candidates.agg(F.min("g"), F.max("g")).first()
    low, high = low or 0, high or 0

    # first pass: every query meets the group of the longest vectors
    every = asked.select("*", F.lit(float("-inf")).alias("need"), F.lit(low).alias("upto")).repartitionByRange(parts, "q")
    first = _blocks(every, QUERIES_PER_BLOCK, bounds=True).withColumn("g", F.lit(low))
    found = written(_meet(first, candidates.where(F.col("g") == low), turn, dim, k, blocks, FIRST_BLOCKS), "first-scores")
    if high > low:
        # second pass: groups whose longest vector can still reach the k-th score
        step = -(-(high + 1) // GATES)
        gates = candidates.where((F.col("g") % step == 0) & (F.col("g") > low)).groupBy("g").agg(F.max("top").alias("top")).orderBy("g").collect()  # at most GATES rows
        kth = found.groupBy("q").agg(F.when(F.count("*") >= k, F.min("score").cast("double")).alias("kth"))
        least = F.when((F.col("kth") > 0) & (F.col("length") > 0), F.col("kth") / F.col("length") * (1 - 1e-9)).otherwise(F.lit(0.0))
        shut = F.array(*(F.struct(F.lit(r["g"]).alias("g"), F.lit(r["top"]).alias("top")) for r in gates)) if gates else None
        upto = F.coalesce(F.try_element_at(F.filter(shut, lambda x: x["top"] < F.col("least")), F.lit(1))["g"] - 1, F.lit(high)) if gates else F.lit(high)
        open_ = asked.join(kth, "q", "left").withColumn("least", least).withColumn("need", F.coalesce("kth", F.lit(float("-inf")))).withColumn("upto", upto.cast("int"))
        open_ = open_.where(F.col("upto") > low).select("id", "v", "length", "q", "need", "upto").repartitionByRange(parts, "upto", "q").sortWithinPartitions("upto", "q")
        second = written(_blocks(open_, QUERIES_PER_BLOCK, bounds=True), "query-blocks")
        sent = second.withColumn("g", F.explode(F.sequence(F.lit(low + 1), F.col("upto"))))
        found = found.unionByName(_meet(sent, candidates.where(F.col("g") > low), turn, dim, k, blocks))
    order = Window.partitionBy("q").orderBy(F.desc("score"), "vec_id")
    ranked = found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
    return ranked.select("query_id", "rank", "vec_id", "score")


def op1_exact_topk(spark, sf_dir: str) -> DataFrame:
    from .common import table

    vectors = table(spark, sf_dir, "embeddings")
    return top_k(vectors, vectors.where("vec_id % 50 = 0"))


OP1_SQL = """
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS e FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), pairs AS (
  SELECT q.vec_id AS query_id, c.vec_id AS vec_id, list_dot_product(q.e, c.e)::BIGINT AS score
  FROM v q JOIN v c ON c.vec_id <> q.vec_id WHERE q.vec_id % 50 = 0
), ranked AS (
  SELECT *, (row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id))::INTEGER AS rank FROM pairs
)
SELECT query_id, rank, vec_id, score FROM ranked WHERE rank <= 5
"""
