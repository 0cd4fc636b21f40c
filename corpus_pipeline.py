"""Five stages that turn the documents table into packed training sequences.

Each stage takes (spark, docs, sf_dir) and works on all that the one before it kept; its result is written as Parquet and
read again as the next one's documents. All but the last return the columns of documents.

Defined cases, in every stage: a null or empty text is a document without words, lines or personal data, and is packed as the
end id alone; a row without an id is judged like any other, keeps its lines, and of near copies without any id one stays; rows
that repeat an id and a text are one row after the near-dedup stage; ties go to the smaller id; an empty table stays empty; columns
besides those of documents go with their rows, and ones whose names clash with inner columns keep their values, but for
n_chars, which is brought up to date.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from seriesloom.llm import line_dedup, packing, pii, quality, simhash
from seriesloom.llm.common import forget, only, table, written  # noqa: F401  tests write stages as run() does

#: Words that a packing task remembers; tasks of the stages before leave less memory than packing alone has.
TOKENIZER_MEMO = 150_000


def _with_text(docs: DataFrame, columns: list[str]) -> DataFrame:
    """The columns of documents, the number of characters brought up to date."""
    return docs.withColumn("n_chars", F.char_length("text").cast("long")).select(columns)


def keep_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the importance resampler selects; those it rejects go."""
    return quality.select_quality(docs, table(spark, sf_dir, "labels")).select(docs.columns)


def drop_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, without the lines that at least three hold, except where the largest id holds them."""
    kept = line_dedup.line_dedup(docs)
    return _with_text(kept.withColumn("text", F.col("kept_text")), docs.columns)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies, the one with the smallest id."""
    return simhash.near_dedup(docs).select(docs.columns)


def hide_personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, personal data replaced by its kind."""
    return _with_text(pii.hide_spans(docs), docs.columns)


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all documents with their places in sequences of at most 4096 tokens."""
    model = spark.sparkContext.broadcast(packing.WordTokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"), end_id=1, memo_entries=TOKENIZER_MEMO))
    return packing.pack_documents(docs, model)


STAGES = [
    ("quality classifier", keep_quality),
    ("line dedup", drop_lines),
    ("SimHash near-dedup", drop_near_copies),
    ("PII", hide_personal_data),
    ("best-fit packing", pack_sequences),
]

#: SQL can express neither the quality model nor the fingerprints' groups; tests hold run() against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for k, (_, stage) in enumerate(STAGES):
        before = docs
        docs = only(lambda stage=stage, docs=docs: stage(spark, docs, sf_dir), f"stage-{k}")
        if k:
            forget(before)  # nothing reads it any more
    return docs
