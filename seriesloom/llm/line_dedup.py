"""Line dedup on DataFrame functions only.

A line's key is the line without ASCII white space at its ends, A-Z lowered. Keys of at least ``min_chars``
code points that at least ``min_docs`` documents hold lose their lines everywhere but in the largest document id.

Only 128-bit hashes of keys travel, with document and position. They are dealt by ranges of the hash and sorted
by document (largest first) and position, so that one pass over each range sees a key's first occurrence before
all others. A key that would fill a task by itself (more than an even share of the rows; there are fewer such
keys than tasks, whatever the data) is instead aggregated before its rows move, and its verdict is broadcast.
The result of the pass is a sparse keep bitmap for each document, not text; :func:`apply_keep` applies it.

Defined cases: a null or empty text is one empty line; rows that repeat a document id count as one document;
a row without an id keeps all its lines and counts for none; an empty table gives no rows; extra columns stay, but for ones
named kept_text, n_lines or n_dropped, which are replaced.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import ASCII_SPACE, ascii_lower, need, shuffle_partitions, written

WORD = 32


def _base(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    need(docs, id_col, text_col)
    text = F.coalesce(F.col(text_col), F.lit(""))
    return docs.select(F.col(id_col).alias("doc_id"), text.alias("text")).withColumn("text_hash", F.xxhash64("text"))


def line_keys(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_chars: int = 20) -> DataFrame:
    """One row (doc_id, text_hash, pos, h1, h2) for each line whose key is long enough."""
    lines = _base(docs, id_col, text_col).where("doc_id is not null").select("doc_id", "text_hash", F.posexplode(F.split("text", "\n", -1)).alias("pos", "line"))
    keys = lines.select("doc_id", "text_hash", "pos", ascii_lower(F.btrim("line", F.lit(ASCII_SPACE))).alias("key"))
    keys = keys.where(F.char_length("key") >= min_chars)
    return keys.select("doc_id", "text_hash", "pos", F.xxhash64("key").alias("h1"), F.xxhash64(F.lit(7), "key").alias("h2"))


def keep_bitmaps(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_chars: int = 20, min_docs: int = 3) -> DataFrame:
    """(doc_id, text_hash, words): for documents that lose lines, the words of the bitmap that aren't all ones.

    ``words`` maps a word's index to its 32 bits, in which a zero stands for a dropped line; every word that
    is missing keeps its lines.
    """
    spark = docs.sparkSession
    tasks = shuffle_partitions(spark)
    rows = written(line_keys(docs, id_col, text_col, min_chars), "lines")
    share = rows.count() // tasks
    hot = rows.groupBy("h1", "h2").agg(F.count("*").alias("n")).where(F.col("n") > share)  # fewer than `tasks` rows
    hot = written(hot.select("h1", "h2"), "hot-lines")

    cold = rows.join(F.broadcast(hot), ["h1", "h2"], "left_anti").repartitionByRange(tasks, "h1", "h2")
    by_doc = Window.partitionBy("h1", "h2").orderBy(F.col("doc_id").desc())
    whole = Window.partitionBy("h1", "h2").orderBy(F.col("doc_id").desc()).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    seen = cold.withColumn("keeper", F.first("doc_id").over(by_doc)).withColumn("nth", F.dense_rank().over(by_doc)).withColumn("n_docs", F.last("nth").over(whole))
    drop_cold = seen.where((F.col("n_docs") >= min_docs) & (F.col("doc_id") < F.col("keeper"))).select("doc_id", "text_hash", "pos")

    held = rows.join(F.broadcast(hot), ["h1", "h2"], "left_semi")
    verdict = held.groupBy("h1", "h2").agg(F.max("doc_id").alias("keeper"), F.countDistinct("doc_id").alias("n_docs")).where(F.col("n_docs") >= min_docs)
    drop_hot = held.join(F.broadcast(verdict), ["h1", "h2"]).where("doc_id < keeper").select("doc_id", "text_hash", "pos")

    bits = drop_cold.unionByName(drop_hot).select("doc_id", "text_hash", (F.col("pos") / WORD).cast("int").alias("word"), F.expr(f"shiftleft(1L, pos % {WORD})").alias("bit"))
    words = bits.groupBy("doc_id", "text_hash", "word").agg(F.bit_or("bit").alias("dropped"))
    entry = F.struct("word", (F.lit(2**WORD - 1).bitwiseXOR(F.col("dropped"))).alias("bits"))
    return words.groupBy("doc_id", "text_hash").agg(F.map_from_entries(F.collect_list(entry)).alias("words"))


def apply_keep(docs: DataFrame, bitmaps: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The documents with columns kept_text, n_lines and n_dropped, in place of any of those names; every other column stays as it is."""
    need(docs, id_col, text_col)
    all_columns = [c for c in docs.columns if c not in ("kept_text", "n_lines", "n_dropped")]
    text = F.coalesce(F.col(text_col), F.lit(""))
    left = docs.withColumn("_sl_text", text).withColumn("_sl_hash", F.xxhash64("_sl_text"))
    right = bitmaps.select(F.col("doc_id").alias("_sl_id"), F.col("text_hash").alias("_sl_hash_r"), F.col("words").alias("_sl_words"))
    joined = left.join(right.hint("shuffle_hash"), (F.col(id_col) == F.col("_sl_id")) & (F.col("_sl_hash") == F.col("_sl_hash_r")), "left")
    kept = F.expr(
        f"array_join(filter(split(_sl_text, '\\n', -1), (x, i) -> "
        f"(shiftright(coalesce(element_at(_sl_words, cast(i div {WORD} as int)), {2**WORD - 1}L), cast(i % {WORD} as int)) & 1L) = 1L), '\\n')"
    )
    lost = F.expr(f"aggregate(map_values(_sl_words), 0L, (n, w) -> n + {WORD} - bit_count(w))")
    return joined.select(
        *(F.col(c) for c in all_columns),
        F.when(F.col("_sl_words").isNull(), F.col("_sl_text")).otherwise(kept).alias("kept_text"),
        (F.char_length("_sl_text") - F.char_length(F.translate("_sl_text", "\n", "")) + 1).cast("long").alias("n_lines"),
        F.coalesce(lost, F.lit(0)).cast("long").alias("n_dropped"),
    )


def line_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_chars: int = 20, min_docs: int = 3) -> DataFrame:
    """The documents with kept_text, n_lines and n_dropped."""
    return apply_keep(docs, keep_bitmaps(docs, id_col, text_col, min_chars, min_docs), id_col, text_col)


def op8_line_dedup(spark, sf_dir: str) -> DataFrame:
    from .common import table

    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return line_dedup(docs).select("doc_id", "n_lines", "n_dropped", F.sha2("kept_text", 256).alias("kept_sha256"))


OP8_SQL = r"""
WITH lines AS (
  SELECT doc_id, u.pos AS pos, u.line AS line,
         translate(trim(u.line, chr(32)||chr(9)||chr(10)||chr(11)||chr(12)||chr(13)), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key
  FROM (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS ls FROM documents) d,
       LATERAL (SELECT unnest(d.ls) AS line, generate_subscripts(d.ls, 1) AS pos) u
), shared AS (
  SELECT key, max(doc_id) AS keeper FROM lines WHERE length(key) >= 20 GROUP BY key HAVING count(DISTINCT doc_id) >= 3
), judged AS (
  SELECT l.*, (s.key IS NOT NULL AND l.doc_id <> s.keeper) AS dropped FROM lines l LEFT JOIN shared s ON l.key = s.key
)
SELECT doc_id, count(*)::BIGINT AS n_lines, (count(*) FILTER (WHERE dropped))::BIGINT AS n_dropped,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (WHERE NOT dropped), '')) AS kept_sha256
FROM judged GROUP BY doc_id
"""
