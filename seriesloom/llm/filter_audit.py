"""Interaction audit of document filters by the multilinear extension.

Every document gets a mask of the filters that it fails. All that an audit asks for follows from how many documents of a part
have each mask, so only these counts are aggregated. A part's removal polynomial is R(x) = sum over masks m of
count(m) * (1 - product over i in m of (1 - x_i)): how many documents go when filter i acts with probability x_i. Its values at
corners of the cube are what a set of filters removes, which gives survivors, removals and redundancy of every order of the
filters. A filter's Shapley value is the integral over t from 0 to 1 of the polynomial's partial derivative on the diagonal
(t, ..., t); with exact rationals, times the number of orders, it is the integer of its removals summed over all orders.

Filters A to D look at a text alone, so equal texts share them; E fails where a smaller document id has the same text. Rows
that agree in id, text and part are counted before they move, and the smallest id of a text is found from counts of
(text, part, labels), so a text that fills a third of the table is as many rows as it has parts and labels when it meets itself.

Defined cases: a null or empty text has no words and fails A only (and E, if a smaller id has none either: null and empty are the
same text); a row without an id has no labels, passes E and is no smaller id to others; rows that repeat an id and a text are
each counted, and pass or fail E together; a document is good (toxic) if any of its rows of labels says so; labels that are
null or of unknown ids count for nothing; a null part is the empty string; an empty table gives no rows; very long
texts are judged whole; extra columns, whatever their names, take no part.
"""

from __future__ import annotations

import itertools
import math
from collections.abc import Iterator, Mapping
from fractions import Fraction

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import ASCII_SPACE, UPPER, need

#: The filters of the contract, by letter; a filter's bit in a mask is its place here.
LETTERS = "ABCDE"
SYMBOLS = "[#$%&*|]"

AUDIT_SCHEMA = "part string, filter_order string, step int, filter string, kept long, removed long, redundant long, unique_fails long, good_lost long, toxic_lost long, shapley long"


class RemovalPolynomial:
    """The multilinear polynomial of what filters remove, from counts by mask; coefficients by set of variables."""

    def __init__(self, counts: Mapping[int, int], width: int) -> None:
        self.width, self.total = width, sum(counts.values())
        self.coefficients: dict[int, int] = {}
        for mask, n in counts.items():
            part = mask
            while part:  # 1 - product(1 - x_i) is, over non-empty parts of the mask, the sum of -(-1)^size times their products
                self.coefficients[part] = self.coefficients.get(part, 0) + (n if part.bit_count() % 2 else -n)
                part = (part - 1) & mask

    def at(self, corner: int) -> int:
        """What the filters of this set remove: the value where their variables are 1 and all others 0."""
        return sum(c for part, c in self.coefficients.items() if part & ~corner == 0)

    def derivative_on_diagonal(self, i: int) -> list[int]:
        """Coefficients, by power of t, of the partial derivative by variable i at (t, ..., t)."""
        powers = [0] * self.width
        for part, c in self.coefficients.items():
            if part >> i & 1:
                powers[part.bit_count() - 1] += c
        return powers

    def shapley(self, i: int) -> Fraction:
        return sum((Fraction(c, k + 1) for k, c in enumerate(self.derivative_on_diagonal(i))), Fraction(0))


def audit_rows(part: str, counts: Mapping[int, tuple[int, int, int]], letters: str = LETTERS) -> Iterator[tuple]:
    """All orders and steps of one part, from (documents, good ones, toxic ones) by mask."""
    width = len(letters)
    every, good, toxic = (RemovalPolynomial({m: c[k] for m, c in counts.items()}, width) for k in range(3))
    full = (1 << width) - 1
    orders = math.factorial(width)
    alone = [every.at(1 << i) for i in range(width)]
    unique = [every.at(full) - every.at(full ^ 1 << i) for i in range(width)]
    shapley = [every.shapley(i) * orders for i in range(width)]
    corners = [(every.at(s), good.at(s), toxic.at(s)) for s in range(full + 1)]
    for order in itertools.permutations(range(width)):
        name, before = "".join(letters[i] for i in order), 0
        for step, i in enumerate(order, 1):
            after = before | 1 << i
            gone, good_gone, toxic_gone = (b - a for a, b in zip(corners[before], corners[after], strict=True))
            yield part, name, step, letters[i], every.total - corners[after][0], gone, alone[i] - gone, unique[i], good_gone, toxic_gone, int(shapley[i])
            before = after


def text_mask(text: Column, min_words: int = 200, distinct_percent: int = 50, capital_percent: int = 3) -> Column:
    """Bits of the filters that look at one text: few words, few distinct ones, capitals, symbols."""
    words = F.filter(F.split(F.translate(text, ASCII_SPACE, " " * len(ASCII_SPACE)), " "), lambda w: w != "")
    one = F.struct(words.alias("words"))
    judged = F.transform(F.array(one), lambda s: F.when(F.size(s["words"]) < min_words, 1).otherwise(0) + F.when(100 * F.size(F.array_distinct(s["words"])) < distinct_percent * F.size(s["words"]), 2).otherwise(0))[0]
    capitals = F.char_length(text) - F.char_length(F.translate(text, UPPER, ""))
    return judged + F.when(100 * capitals.cast("long") > capital_percent * F.char_length(text), 4).otherwise(0) + F.when(text.rlike(SYMBOLS), 8).otherwise(0)


def mask_counts(docs: DataFrame, labels: DataFrame, part_col: str = "lang", id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(part, mask, n, good, toxic): documents of each part by the filters that they fail."""
    need(docs, id_col, text_col, part_col)
    need(labels, "doc_id", "quality", "toxic")
    text = F.coalesce(F.col(text_col), F.lit(""))
    rows = docs.select(F.col(id_col).alias("id"), F.coalesce(F.col(part_col).cast("string"), F.lit("")).alias("part"), F.unhex(F.sha2(text, 256)).alias("same"), text_mask(text).alias("mask"))
    rows = rows.groupBy("id", "part", "same", "mask").agg(F.count("*").alias("n"))

    flag = lambda name: F.max(F.coalesce((F.col(name) == 1).cast("int"), F.lit(0))).alias(name)
    marks = labels.where("doc_id is not null").groupBy(F.col("doc_id").alias("id")).agg(flag("quality"), flag("toxic")).where("quality + toxic > 0")
    # rows without an id meet no labels: a salt deals them out, where one null key would take them all
    salt = F.when(F.col("id").isNull(), F.pmod(F.xxhash64("same"), F.lit(997))).otherwise(F.lit(0)).alias("salt")
    rows = rows.select("*", salt).join(marks.withColumn("salt", F.lit(0).cast("long")), ["id", "salt"], "left").na.fill(0, ["quality", "toxic"])

    kinds = rows.groupBy("same", "mask", "part", "quality", "toxic").agg(F.sum("n").alias("n"), F.min(F.when(F.col("id").isNotNull(), F.struct("id", "n"))).alias("first"), F.sum(F.when(F.col("id").isNull(), F.col("n")).otherwise(0)).alias("no_id"))
    each = kinds.withColumn("least", F.min("first.id").over(Window.partitionBy("same")))
    fresh = F.col("no_id") + F.when(F.col("first.id") == F.col("least"), F.col("first.n")).otherwise(0)
    both = each.select("part", "quality", "toxic", F.inline(F.array(F.struct(F.col("mask").alias("mask"), fresh.alias("n")), F.struct((F.col("mask") + 16).alias("mask"), (F.col("n") - fresh).alias("n")))))
    return both.groupBy("part", "mask").agg(F.sum("n").alias("n"), F.sum(F.col("n") * F.col("quality")).alias("good"), F.sum(F.col("n") * F.col("toxic")).alias("toxic")).where("n > 0")


def audit(counts: DataFrame) -> DataFrame:
    """Every order and step of every part; a part's task gets one row for each of its masks, at most 32."""

    def part(pdf: pd.DataFrame) -> pd.DataFrame:
        by_mask = {int(r.mask): (int(r.n), int(r.good), int(r.toxic)) for r in pdf.itertuples()}
        return pd.DataFrame(list(audit_rows(pdf["part"].iloc[0], by_mask)), columns=[c.split()[0] for c in AUDIT_SCHEMA.split(", ")])

    return counts.groupBy("part").applyInPandas(part, AUDIT_SCHEMA)


def op12_filter_audit(spark, sf_dir: str) -> DataFrame:
    from .common import table

    return audit(mask_counts(table(spark, sf_dir, "documents").select("doc_id", "text", "lang"), table(spark, sf_dir, "labels"))).drop("filter")


OP12_SQL = r"""
WITH texts AS (
  SELECT doc_id, coalesce(lang, '') AS part, coalesce(text, '') AS text,
         list_filter(string_split_regex(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda w: w <> '') AS words
  FROM documents
), judged AS (
  SELECT d.part, d.doc_id,
         length(d.words) < 200 AS fa,
         100 * coalesce(length(list_distinct(d.words)), 0) < 50 * length(d.words) AS fb,
         100 * (length(d.text) - length(regexp_replace(d.text, '[A-Z]', '', 'g'))) > 3 * length(d.text) AS fc,
         regexp_matches(d.text, '[#$%&*|]') AS fd,
         coalesce(d.doc_id > min(d.doc_id) OVER (PARTITION BY d.text), false) AS fe,
         coalesce(l.good, false) AS good, coalesce(l.toxic, false) AS toxic
  FROM texts d LEFT JOIN (SELECT doc_id, bool_or(quality = 1) AS good, bool_or(toxic = 1) AS toxic FROM labels GROUP BY doc_id) l USING (doc_id)
), letters AS (
  SELECT unnest(['A', 'B', 'C', 'D', 'E']) AS f
), orders AS (
  SELECT a.f || b.f || c.f || d.f || e.f AS filter_order
  FROM letters a JOIN letters b ON b.f <> a.f JOIN letters c ON c.f NOT IN (a.f, b.f)
       JOIN letters d ON d.f NOT IN (a.f, b.f, c.f) JOIN letters e ON e.f NOT IN (a.f, b.f, c.f, d.f)
), failed AS (
  SELECT part, concat(CASE WHEN fa THEN 'A' ELSE '' END, CASE WHEN fb THEN 'B' ELSE '' END, CASE WHEN fc THEN 'C' ELSE '' END, CASE WHEN fd THEN 'D' ELSE '' END, CASE WHEN fe THEN 'E' ELSE '' END) AS fails,
         count(*) AS n, count(*) FILTER (WHERE good) AS good, count(*) FILTER (WHERE toxic) AS toxic
  FROM judged GROUP BY ALL
), stepped AS (
  SELECT f.part, o.filter_order, s.step::INTEGER AS step, substr(o.filter_order, s.step::INTEGER, 1) AS letter, f.fails, f.n, f.good, f.toxic,
         contains(f.fails, substr(o.filter_order, s.step::INTEGER, 1)) AS hit,
         length(translate(f.fails, substr(o.filter_order, 1, s.step::INTEGER - 1), '')) < length(f.fails) AS gone
  FROM failed f CROSS JOIN orders o CROSS JOIN (SELECT unnest(range(1, 6)) AS step) s
), counted AS (
  SELECT part, filter_order, step, letter,
         coalesce(sum(n) FILTER (WHERE NOT gone AND NOT hit), 0)::BIGINT AS kept,
         coalesce(sum(n) FILTER (WHERE NOT gone AND hit), 0)::BIGINT AS removed,
         coalesce(sum(n) FILTER (WHERE gone AND hit), 0)::BIGINT AS redundant,
         coalesce(sum(n) FILTER (WHERE fails = letter), 0)::BIGINT AS unique_fails,
         coalesce(sum(good) FILTER (WHERE NOT gone AND hit), 0)::BIGINT AS good_lost,
         coalesce(sum(toxic) FILTER (WHERE NOT gone AND hit), 0)::BIGINT AS toxic_lost
  FROM stepped GROUP BY ALL
)
SELECT part, filter_order, step, kept, removed, redundant, unique_fails, good_lost, toxic_lost,
       (sum(removed) OVER (PARTITION BY part, letter))::BIGINT AS shapley
FROM counted
"""
