"""Quality selection by importance resampling with hashed n-gram models.

Two multinomials over hashed n-grams (words, pairs of words, pairs of word shapes; a word that repeats the one before
is a pair of its own) are counted: one over all documents, one over documents labelled good. A document's log
importance weight is the sum, over its n-grams, of the log ratio of the two. Adding Gumbel noise and taking the
k largest keys is sampling without replacement in proportion to the weights.

The raw model counts every document. The target model and the cut are fitted on labelled rows: at most
``sample_rows`` of each label, those with the smallest hashes of their ids. A fifth of those is held out of the target
model; the cut is set on it so that at most ``max_loss`` of its good rows fall below, or lower, where that rejects no fewer bad ones.
With ``k`` unset, k is the number of documents whose key reaches the cut, so the choice needs no sort: it is the Gumbel top-k of that k, row for row.

Weights are the generative models' own, sums over all n-grams, not means: the likelihood ratio of a document grows with its
length, so unit noise decides between short documents and those near the cut, and long ones are nearly always decided by their weight. That is
what the model says of them; scaling by length would keep some long junk and lose some long good documents, whose share of clean documents the contract wants whole.

That leaves little to chance where documents are long. :func:`resample` is the sampler itself: exactly k documents without replacement, a
document's weight being that of ``tilt`` of its n-grams at their mean log ratio, whatever its length, so the noise decides among
documents of like quality and every seed draws another sample.

Defined cases: texts of any length count whole; extra columns stay, but for ones named ``log_weight`` or ``key``, which are replaced; an empty table gives no rows; equal keys at the cut all stay; a null or empty text has no n-grams and log weight zero; a null id gets noise like any other; labels
that are null or of unknown documents count for nothing; with no good labels every weight is zero and all
rows are kept; rows that repeat are judged alike.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import need, small_batches, written

BITS = 14
SHAPE_BITS = 12
BUCKETS = 2 * (1 << BITS) + (1 << SHAPE_BITS)
MEMO_ENTRIES = 150_000
SAMPLE_ROWS = 20_000
#: Weight, in n-grams, with which the target model leans on the raw one.
LEAN = 20_000.0
REPEAT = 0

_tokens = re.compile(r"\w+|[^\w\s]+").findall


def _shape(token: str) -> int:
    if token.isdecimal():
        return 1
    if not (token[0].isalnum() or token[0] == "_"):
        return 16 + xxhash.xxh32_intdigest(token) % 200
    if token.islower():
        return 2
    if token.isupper():
        return 3 if len(token) > 1 else 4
    return 4 if token.istitle() else 5


class NgramHasher:
    """Buckets of a text's n-grams; numbers count as one word, words by their lower case."""

    def __init__(self) -> None:
        self._memo: dict[str, int] = {}

    def _code(self, token: str) -> int:
        word = "0" if token.isdecimal() else token.lower()
        return (xxhash.xxh64_intdigest(word, 5) & ~0xFF) | _shape(token)

    def buckets(self, text: str) -> np.ndarray:
        words = _tokens(text)
        memo = self._memo
        if new := set(words).difference(memo):
            if len(memo) + len(new) > MEMO_ENTRIES:
                memo.clear()
                new = set(words)
            for w in new:
                memo[w] = self._code(w)
        code = np.fromiter(map(memo.__getitem__, words), np.uint64, len(words))
        h, shape = code >> np.uint64(8), code & np.uint64(0xFF)
        a, b = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F)
        one = (h * a) >> np.uint64(64 - BITS)
        two = ((h[:-1] * a + h[1:] * b) * a) >> np.uint64(64 - BITS)
        two[h[:-1] == h[1:]] = REPEAT
        forms = ((shape[:-1] * np.uint64(256) + shape[1:]) * a) >> np.uint64(64 - SHAPE_BITS)
        return np.concatenate([one, two + np.uint64(1 << BITS), forms + np.uint64(2 << BITS)]).astype(np.int64)


def ngram_counts(docs: DataFrame, text_col: str = "text") -> np.ndarray:
    """Counts of all buckets over all rows: one vector from each task, summed by bucket."""

    def part(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        hasher, total, some, size = NgramHasher(), np.zeros(BUCKETS, np.int64), [], 0
        for pdf in batches:
            for text in pdf["text"]:
                if text:
                    some.append(hasher.buckets(text))
                    size += len(some[-1])
                    if size > 500_000:
                        total += np.bincount(np.concatenate(some), minlength=BUCKETS)
                        some, size = [], 0
        if some:
            total += np.bincount(np.concatenate(some), minlength=BUCKETS)
        at = np.flatnonzero(total)
        yield pd.DataFrame({"bucket": at, "n": total[at]})

    rows = docs.select(F.col(text_col).alias("text")).mapInPandas(part, "bucket int, n long").groupBy("bucket").agg(F.sum("n").alias("n")).collect()  # at most BUCKETS rows
    counts = np.zeros(BUCKETS, np.int64)
    for r in rows:
        counts[r["bucket"]] = r["n"]
    return counts


def log_ratios(target: np.ndarray, raw: np.ndarray) -> np.ndarray:
    if not target.sum() or not raw.sum():
        return np.zeros(BUCKETS)
    p = (raw + 1.0) / (raw.sum() + len(raw))
    q = (target + LEAN * p) / (target.sum() + LEAN)
    return np.log(q / p)


def log_weight(ratios, text: Column) -> Column:
    """A double column: the sum of the log ratios of the text's n-grams. ratios: a broadcast vector."""

    @F.pandas_udf(T.DoubleType())
    def weigh(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        hasher, table = NgramHasher(), ratios.value
        for texts in batches:
            yield pd.Series([float(table[hasher.buckets(t)].sum()) if t else 0.0 for t in texts], dtype=float)

    return weigh(F.coalesce(text, F.lit("")))


def gumbel(id_col: Column, seed: int) -> Column:
    """Standard Gumbel noise from the row's id alone, so that a task that runs again draws the same."""
    u = (F.shiftrightunsigned(F.xxhash64(id_col, F.lit(seed)), 11).cast("double") + 0.5) / F.lit(float(1 << 53))
    return -F.log(-F.log(u))


def choose_cut(keys: np.ndarray, good: np.ndarray, max_loss: float) -> float:
    """The key below which rows are rejected: the best separation that loses at most max_loss of the good rows."""
    if not good.any():
        return -math.inf
    top = np.sort(keys[good])[int(max_loss * good.sum())]
    bad = np.sort(keys[~good])
    below = bad[bad < top]
    # halfway into the gap under the lowest good key that must stay
    return float((top + below[-1]) / 2) if len(below) else float(top) - 1.0


def top_k(scored: DataFrame, k: int, key_col: str = "key", bins: int = 1000) -> DataFrame:
    """The k rows of largest key; equal keys at the end all stay. Narrows the cut by counts in bins, without a sort."""
    total = scored.count()
    if k >= total:
        return scored
    if k <= 0:
        return scored.limit(0)
    low, high = scored.agg(F.min(key_col), F.max(key_col)).first()
    above = 0  # rows above `high`
    for _ in range(12):
        if high <= low:
            break
        width = (high - low) / bins
        inside = scored.where((F.col(key_col) >= low) & (F.col(key_col) <= high))
        counts = inside.groupBy(F.least(F.floor((F.col(key_col) - low) / width), F.lit(bins - 1)).alias("bin")).agg(F.count("*").alias("n"), F.min(key_col).alias("least"), F.max(key_col).alias("most")).orderBy(F.desc("bin")).collect()
        for r in counts:
            if above + r["n"] >= k:
                low, high = r["least"], r["most"]
                break
            above += r["n"]
        if above + r["n"] == k:
            break
    return scored.where(F.col(key_col) >= low)


def _labelled(docs: DataFrame, labels: DataFrame, quality: int, rows: int) -> DataFrame:
    """At most so many documents with this label, in a few files; the ids are few, so they are broadcast."""
    ids = labels.where(F.col("quality") == quality).select(F.col("doc_id").alias("_sl_id")).where("_sl_id is not null").distinct()
    some = ids.orderBy(F.xxhash64("_sl_id", F.lit(3)), "_sl_id").limit(rows)
    return docs.join(F.broadcast(some), F.col("doc_id") == F.col("_sl_id"), "left_semi").select("doc_id", "text").repartition(6)


def select_quality(docs: DataFrame, labels: DataFrame, k: int | None = None, sample_rows: int = SAMPLE_ROWS, max_loss: float = 0.002, seed: int = 42) -> DataFrame:
    """The selected documents with log_weight and key; every column of the documents stays."""
    need(docs, "doc_id", "text")
    need(labels, "doc_id", "quality")
    spark = docs.sparkSession
    small_batches(spark)
    good = written(_labelled(docs, labels, 1, sample_rows), "good")
    bad = written(_labelled(docs, labels, 0, sample_rows), "bad")
    held = F.pmod(F.xxhash64("doc_id", F.lit(9)), F.lit(5)) == 0
    ratios = spark.sparkContext.broadcast(log_ratios(ngram_counts(good.where(~held)), ngram_counts(docs)))
    keyed = lambda df, at: df.withColumn("log_weight", log_weight(ratios, F.col("text"))).withColumn("key", F.col("log_weight") + gumbel(F.col(at), seed))
    scored = keyed(docs, "doc_id")
    if k is not None:
        return top_k(written(scored, "keys"), k)
    seen = keyed(good.where(held), "doc_id").select("key", F.lit(True).alias("good")).unionByName(keyed(bad, "doc_id").select("key", F.lit(False).alias("good"))).collect()  # at most 2 * sample_rows
    cut = choose_cut(np.array([r["key"] for r in seen]), np.array([r["good"] for r in seen], bool), max_loss)
    return scored.where(F.col("key") >= cut) if math.isfinite(cut) else scored


def mean_log_ratio(ratios, text: Column) -> Column:
    """A double column: the mean log ratio of the text's n-grams, zero without any. ratios: a broadcast vector."""

    @F.pandas_udf(T.DoubleType())
    def weigh(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        hasher, table = NgramHasher(), ratios.value
        for texts in batches:
            found = (hasher.buckets(t) if t else np.zeros(0, np.int64) for t in texts)
            yield pd.Series([float(table[b].mean()) if len(b) else 0.0 for b in found], dtype=float)

    return weigh(F.coalesce(text, F.lit("")))


def resample(docs: DataFrame, labels: DataFrame, k: int, tilt: float = 20.0, sample_rows: int = SAMPLE_ROWS, seed: int = 42, keep: list[str] | None = None) -> DataFrame:
    """k documents drawn without replacement in proportion to exp(tilt * mean log ratio): columns ``keep`` (all of the documents'), log_weight, key.

    All are kept where there are no more than k; of equal keys at the end all stay, as of rows that repeat.
    """
    need(docs, "doc_id", "text")
    need(labels, "doc_id", "quality")
    spark = docs.sparkSession
    small_batches(spark)
    good = written(_labelled(docs, labels, 1, sample_rows), "good")
    ratios = spark.sparkContext.broadcast(log_ratios(ngram_counts(good), ngram_counts(docs)))
    weighed = docs.withColumn("log_weight", mean_log_ratio(ratios, F.col("text")) * tilt)
    keyed = weighed.withColumn("key", F.col("log_weight") + gumbel(F.col("doc_id"), seed))
    columns = [c for c in (docs.columns if keep is None else keep) if c not in ("log_weight", "key")]
    return top_k(written(keyed.select(*columns, "log_weight", "key"), "keys"), k)


def quality_resample(spark, sf_dir: str) -> DataFrame:
    """A tenth of the documents, drawn by their quality."""
    from .common import table

    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return resample(docs, table(spark, sf_dir, "labels"), docs.count() // 10, keep=["doc_id"])


def op2_quality(spark, sf_dir: str) -> DataFrame:
    from .common import table

    chosen = select_quality(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
    return chosen.select("doc_id", "log_weight", "key")
