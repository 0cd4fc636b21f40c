"""Document fingerprints by MinHash.

A signature holds, for each of ``PERMUTATIONS`` universal hash functions (odd multiplier, offset, upper half of 64
bits), the smallest value over a text's shingles of five words, computed as numpy arrays. The share of equal
places in two signatures estimates the Jaccard likeness of their shingle sets. A fingerprint is the signature's
lower 16 bits in hexadecimal, so different minima look equal once in 65,536 places.

:func:`near_duplicates` joins signature bands in Spark and verifies Jaccard likeness on the shingle sets themselves.
:func:`with_next` pairs each document with the next by descending id without a global sort: rows are dealt to
ranges that begin at rows of the table, and a range's first row is also sent to the range before it.

Defined cases: a null or empty text has no shingles, and a signature of its own that equals only its like; fewer than
five words are one shingle; of rows that share an id, the order is by text; rows without an id come last; rows that repeat, however often, each have a row; a table of
one row is its own next; extra columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import components, need, shuffle_partitions, small_batches, written

PERMUTATIONS = 128
WORDS = 5
BANDS = 32
CHUNK = 2048
MEMO_ENTRIES = 300_000
BUCKET_ROWS = 2000
#: Bytes of a text that tell apart, beside the id, where a range begins.
START_BYTES = 64
#: Rows that repeat more often than this share of a part are counted instead of moved.
OFTEN = 64
#: Stands for a null id inside, so that ids stay whole numbers in tasks.
NO_ID = -(1 << 63)

_random = np.random.default_rng(20_240_601)
MULTIPLIERS = _random.integers(0, 1 << 63, PERMUTATIONS, dtype=np.uint64) << np.uint64(1) | np.uint64(1)
OFFSETS = _random.integers(0, 1 << 63, PERMUTATIONS, dtype=np.uint64)
_BASE = np.uint64(0x9E3779B97F4A7C15)


class Signer:
    """Shingle hashes and signatures of texts, with a bounded memo of word hashes."""

    def __init__(self) -> None:
        self._memo: dict[bytes, int] = {}

    def shingles(self, text: str) -> np.ndarray:
        words = text.encode().lower().split()
        memo = self._memo
        if new := set(words).difference(memo):
            if len(memo) + len(new) > MEMO_ENTRIES:
                memo.clear()
                new = set(words)
            digest = xxhash.xxh64_intdigest
            for w in new:
                memo[w] = digest(w, 1)
        h = np.fromiter(map(memo.__getitem__, words), np.uint64, len(words))
        if not len(h):
            return h
        width = min(WORDS, len(h))
        out = h[: len(h) - width + 1].copy()
        for k in range(1, width):
            out *= _BASE
            out += h[k : len(h) - width + 1 + k]
        out ^= out >> np.uint64(31)
        out *= np.uint64(0xBF58476D1CE4E5B9)
        out ^= out >> np.uint64(32)
        return out

    def signature(self, text: str) -> np.ndarray:
        """The minima, as unsigned 32-bit integers; all ones for no shingles."""
        x = self.shingles(text)
        least = np.full(PERMUTATIONS, np.iinfo(np.uint64).max, np.uint64)
        for at in range(0, len(x), CHUNK):
            table = MULTIPLIERS[:, None] * x[None, at : at + CHUNK]
            table += OFFSETS[:, None]
            np.minimum(least, table.min(axis=1), out=least)
        return (least >> np.uint64(32)).astype(np.uint32)


def hex_of(signature: np.ndarray) -> str:
    return (signature & 0xFFFF).astype(">u2").tobytes().hex()


def likeness(a: np.ndarray, b: np.ndarray) -> float:
    return float(((a & 0xFFFF) == (b & 0xFFFF)).mean())


def signatures(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, signature): the signature as little-endian unsigned 32-bit integers."""
    need(docs, id_col, text_col)

    @F.pandas_udf(T.BinaryType())
    def sign(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        signer = Signer()
        for texts in batches:
            yield pd.Series([signer.signature(t).astype("<u4").tobytes() for t in texts], dtype=object)

    return docs.select(F.col(id_col).alias("doc_id"), sign(F.coalesce(F.col(text_col), F.lit(""))).alias("signature"))


def near_duplicates(docs: DataFrame, threshold: float = 0.8, bands: int = BANDS, bucket_rows: int = BUCKET_ROWS) -> DataFrame:
    """(doc_id, class_id) of every row: the smallest id that links of Jaccard likeness at the threshold or above reach.

    Defined cases: null and empty texts are one class; a row without an id has its text's class, which is null where no row of the class has
    an id; rows that repeat each have a row; an empty table gives no rows; extra columns, whatever their names, are ignored.

    Only distinct texts are compared, and within a bucket only those that are not yet linked, so groups of copies cost no
    pairs. A bucket above ``bucket_rows`` is dealt by a hash of its texts into blocks, and a task compares two of its blocks: every
    two texts of a bucket meet, however many it holds, and no task reads more than about ``bucket_rows`` of them. Buckets with the
    same members are one. Banding finds a pair at likeness s with probability 1 - (1 - s**r)**bands for r = PERMUTATIONS / bands (0.9999999 at
    the threshold, for the defaults).
    """
    need(docs, "doc_id", "text")
    small_batches(docs.sparkSession)
    rows = PERMUTATIONS // bands
    text = F.coalesce(F.col("text"), F.lit(""))
    key = F.unhex(F.md5(text)).alias("key")

    @F.pandas_udf("array<bigint>")
    def band_keys(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        signer = Signer()
        for texts in batches:
            out = []
            for t in texts:
                s = signer.signature(t)
                out.append([xxhash.xxh64_intdigest(s[b * rows : (b + 1) * rows].tobytes(), b) >> 1 for b in range(bands)])
            yield pd.Series(out, dtype=object)

    @F.pandas_udf(T.BinaryType())
    def shingle_set(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        signer = Signer()
        for texts in batches:
            yield pd.Series([np.unique(signer.shingles(t)).astype("<u8").tobytes() for t in texts], dtype=object)

    named = written(docs.select("doc_id", key, band_keys(text).alias("keys")), "bands")
    # keys and band hashes alone move to find the buckets; texts move once, one of each group of copies, for the sets
    unique = written(named.groupBy("key").agg(F.min("doc_id").alias("least"), F.first("keys").alias("keys")), "distinct-bands")
    firsts = unique.select("key", "least")
    at = unique.select("key", F.posexplode("keys").alias("band", "bucket"))
    members = [F.count("*").alias("n"), F.bit_xor(F.xxhash64("key")).alias("x"), F.bit_xor(F.xxhash64("key", F.lit(1))).alias("y")]
    buckets = at.groupBy("band", "bucket").agg(*members).where("n > 1").groupBy("n", "x", "y").agg(F.min(F.struct("band", "bucket")).alias("b")).select("b.band", "b.bucket", "n")
    at = written(at.join(buckets, ["band", "bucket"]), "buckets")
    texts = docs.groupBy(key).agg(F.min(text).alias("text")).join(at.select("key").distinct(), "key", "left_semi")
    sets = texts.select("key", shingle_set("text").alias("shingles"))
    blocks = F.when(F.col("n") > bucket_rows, F.ceil(F.col("n") * 2 / bucket_rows)).otherwise(1).cast("int")
    dealt = at.withColumn("blocks", blocks).withColumn("block", F.pmod(F.xxhash64("key"), "blocks").cast("int")).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    dealt = dealt.select("band", "bucket", F.least("block", "other").alias("low"), F.greatest("block", "other").alias("high"), (F.col("block") > F.col("other")).alias("upper"), "key")
    place = ["band", "bucket", "low", "high"]
    meet = dealt.join(sets, "key").repartition(*place).sortWithinPartitions(*place, "upper", "key")

    def compare(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        now, members = None, []
        for pdf in batches:
            found = []
            for band, bucket, low, high, upper, key, shingles in pdf[[*place, "upper", "key", "shingles"]].itertuples(index=False):
                if (band, bucket, low, high) != now:
                    now, members = (band, bucket, low, high), []
                mine = np.frombuffer(shingles, "<u8")
                near = {}
                for other, theirs, group, above in members:
                    # of two blocks only rows of one meet rows of the other; each block also has a task of its own
                    if group in near or (low != high and above == upper):
                        continue
                    if min(len(mine), len(theirs)) < threshold * max(len(mine), len(theirs)):
                        continue
                    common = len(np.intersect1d(mine, theirs, assume_unique=True))
                    if common >= threshold * (len(mine) + len(theirs) - common):
                        near[group] = other
                found += [(key, other) for other in near.values()]
                own = min(near, default=len(members))
                members = [(k, s, own if g in near else g, u) for k, s, g, u in members] if len(near) > 1 else members
                members.append((key, mine, own, upper))
            yield pd.DataFrame(found, columns=["a", "b"], dtype=object)

    linked = components(meet.mapInPandas(compare, "a binary, b binary"))
    rooted = firsts.join(linked.select(F.col("node").alias("key"), "root"), "key", "left").select("key", "least", F.coalesce("root", "key").alias("root"))
    least = rooted.groupBy("root").agg(F.min("least").alias("class_id"))
    return named.select("doc_id", "key").join(rooted.join(least, "root").select("key", "class_id"), "key").select("doc_id", "class_id")


def with_next(docs: DataFrame, parts: int | None = None) -> DataFrame:
    """The rows (doc_id, text), dealt so that each task holds whole ranges of (descending id, text): columns part, last, id, text, times.

    Within a part rows are to be read by ``last``, then descending id and text; the row with ``last`` set only serves as the next one
    of the row before it. Ranges begin at pairs of an id and the first bytes of a text, so rows that share an id, or have none, are
    dealt out as well. Rows that repeat an id and a text very often are one row with their number, ``times``: all of them but one have
    their own text as the next one.
    """
    parts = parts or 4 * shuffle_partitions(docs.sparkSession)
    text = F.coalesce(F.col("text"), F.lit(""))
    rows = docs.select(F.coalesce(F.col("doc_id").cast("long"), F.lit(NO_ID)).alias("id"), text.alias("text"))
    start = F.substring(F.encode("text", "utf-8"), 1, START_BYTES)
    rows = rows.select("*", F.bitwise_not("id").alias("back"), start.alias("start"), F.xxhash64("text").alias("h1"), F.xxhash64(F.lit(7), "text").alias("h2"))
    same = ["back", "start", "h1", "h2"]
    counts = written(rows.groupBy(*same).agg(F.count("*").alias("times")), "id-counts")
    total = counts.agg(F.sum("times")).first()[0] or 0
    often = counts.where(F.col("times") > max(1, total // (OFTEN * parts)))  # fewer than OFTEN * parts rows
    dealt = counts.repartitionByRange(parts, "back", "start").groupBy(F.spark_partition_id()).agg(F.min(F.struct("back", "start")).alias("first"))
    starts = sorted((r["first"]["back"], bytes(r["first"]["start"])) for r in dealt.collect())  # one a part

    single = rows.join(F.broadcast(often.select(*same)), same, "left_anti").withColumn("times", F.lit(1).cast("long"))
    one = rows.join(F.broadcast(often.select(*same)), same, "left_semi").groupBy(*same).agg(F.first("id").alias("id"), F.first("text").alias("text"))
    own = single.unionByName(one.join(F.broadcast(often), same)).withColumn("at", F.struct("back", "start"))
    begins = F.array(*(F.struct(F.lit(b).cast("long").alias("back"), F.lit(s).alias("start")) for b, s in starts or [(0, b"")]))
    own = own.withColumn("part", F.size(F.filter(begins, lambda x: x <= F.col("at"))) - 1)
    # the first row of a range serves the range before it; the table's first row serves the last range
    before = F.when(F.array_contains(begins, F.col("at")), F.array(F.pmod(F.col("part") - 1, F.lit(max(1, len(starts)))))).otherwise(F.array().cast("array<int>"))
    uses = F.concat(F.array(F.struct(F.col("part").alias("part"), F.lit(False).alias("last"))), F.transform(before, lambda p: F.struct(p.alias("part"), F.lit(True).alias("last"))))
    dealt = own.select("id", "text", "times", F.explode(uses).alias("use")).select("id", "text", "times", "use.part", "use.last")
    return dealt.repartition("part").sortWithinPartitions("part", "last", F.desc("id"), "text")


def edited_fingerprints(docs: DataFrame) -> DataFrame:
    """Fingerprints of every text and of its edited text, whose last half is the beginning of the next document."""
    need(docs, "doc_id", "text")
    small_batches(docs.sparkSession)

    def stream(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        signer, part, before, served = Signer(), None, None, False

        def result(an_id: int, text: str, sign: np.ndarray, after: str, after_sign: np.ndarray, times: int) -> tuple:
            half = len(text) // 2
            edited = text[: len(text) - half] + after[:half]
            changed = signer.signature(edited)
            return an_id, len(text), hashlib.sha256(edited.encode()).hexdigest(), hex_of(sign), hex_of(changed), likeness(sign, changed), likeness(sign, after_sign), times

        for pdf in batches:
            out = []
            for an_id, text, times, p, last in pdf[["id", "text", "times", "part", "last"]].itertuples(index=False):
                if p != part:
                    part, before, served = p, None, False
                if served:
                    continue
                own = signer.signature(text)
                if before is not None:
                    out.append(result(*before, text, own, 1))
                if times > 1 and not last:
                    out.append(result(an_id, text, own, text, own, times - 1))
                before, served = (an_id, text, own), last
            yield pd.DataFrame(out, columns=["id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next", "times"])

    schema = "id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double, times long"
    found = with_next(docs).mapInPandas(stream, schema)
    doc_id = F.when(F.col("id") != NO_ID, F.col("id")).alias("doc_id")
    named = [doc_id, *(c for c in found.columns if c not in ("id", "times"))]
    # rows that repeat come back in two steps, so that no array grows with their number
    thousands = found.select(*named, (F.col("times") - 1).alias("rest"), F.explode(F.sequence(F.lit(0), F.floor((F.col("times") - 1) / 1000))).alias("k"))
    return thousands.withColumn("_", F.explode(F.array_repeat(F.lit(0), F.least(F.lit(1000), F.col("rest") - F.col("k") * 1000 + 1).cast("int")))).drop("_", "rest", "k")


def op4_minhash(spark, sf_dir: str) -> DataFrame:
    from .common import table

    return edited_fingerprints(table(spark, sf_dir, "documents"))


def minhash_classes(spark, sf_dir: str) -> DataFrame:
    """The class of near copies of every document: the banded join with verified likeness, over the whole table."""
    from .common import table

    return near_duplicates(table(spark, sf_dir, "documents"))
