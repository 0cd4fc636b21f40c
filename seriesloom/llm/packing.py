"""Best-fit packing of documents into training sequences, under several capacities at once.

A document is its tokenizer ids and an end id. Only documents longer than a sequence are cut. A sequence has
capacities for tokens, for documents and for attention cost (the sum of squared lengths). Pieces are placed longest
first; among the open sequences in which a piece keeps within every capacity, the one with the smallest weighted
norm of what would be left over is taken (or, with ``score="dot"``, the largest weighted dot product of the piece's
demands and what is left). A new sequence is opened only if none has room.

Pieces that fill a sequence are placed by themselves. The others are dealt by a hash into shards of about
``shard_pieces`` pieces, whatever the data's size, and each shard is packed in one task; a shard wastes less than
about one sequence against packing all at once. Only lengths move; ids stay where they were made.

Defined cases: a null or empty text is the end id alone; rows that repeat an id are packed as documents of their
own, dealt over all shards however many they are; an empty table gives no rows; extra columns are ignored.
"""

from __future__ import annotations

import json
import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import need, small_batches, written

MEMO_ENTRIES = 400_000
MAX_FILE_BYTES = 50_000_000
#: Signs that a word may end in and that form a token apart from the letters before them.
SIGNS = ".,;:!?*$&%#|()\"-"
#: Characters that Python's str.split() parts at, though the tokenizer doesn't take them as white space.
ODD_SPACE = re.compile("[\x1c-\x1f]").search
#: So many words of letters are encoded as one text.
WORDS_AT_ONCE = 500


class WordTokenizer:
    """Ids by a ``tokenizers`` file whose pre-tokenizer drops white space, so that words can be encoded one by one.

    Equal words between white space have equal ids; each is encoded once and kept in a bounded memo.
    """

    def __init__(self, definition: str, end_id: int, memo_entries: int = MEMO_ENTRIES):
        if len(definition) > MAX_FILE_BYTES:
            raise ValueError("the tokenizer file is too large to broadcast")
        self.definition, self.end_id, self.memo_entries = definition, end_id, memo_entries
        self._tokenizer = None

    @classmethod
    def from_file(cls, path: str, end_id: int = 1, memo_entries: int = MEMO_ENTRIES) -> WordTokenizer:
        with open(path, encoding="utf-8") as f:
            return cls(f.read(), end_id, memo_entries)

    def __getstate__(self) -> dict:
        return {"definition": self.definition, "end_id": self.end_id, "memo_entries": self.memo_entries, "_tokenizer": None}

    def _open(self) -> None:
        import os

        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self._tokenizer = Tokenizer.from_str(self.definition)
        self._tokenizer.encode_special_tokens = True
        model = json.loads(self.definition)["model"]
        suffix = model.get("end_of_word_suffix")
        self._ends = np.zeros(max(model["vocab"].values()) + 1, bool)
        if suffix:
            self._ends[[i for token, i in model["vocab"].items() if token.endswith(suffix)]] = True
        self._memo: dict[str, bytes] = {}
        self._end = int(self.end_id).to_bytes(4, "little")

    def _learn(self, words: list[str]) -> None:
        """Put the words in the memo. Signs after a last letter are a token of their own, and ASCII case is lowered, so words share what comes before."""
        memo, stems, compound = self._memo, set(), []
        for word in words:
            stem = word.rstrip(SIGNS)
            if stem and stem[-1].isalpha():
                tail = word[len(stem) :]
                if stem.isascii():
                    stem = stem.lower()
                if tail or stem != word:
                    compound.append((word, stem, tail))
                    stems.add(tail)
                stems.add(stem)
            else:
                stems.add(word)
        self._encode([s for s in stems if s not in memo])
        for word, stem, tail in compound:
            memo[word] = memo[stem] + memo[tail]

    def _encode(self, words: list[str]) -> None:
        """Words of letters go together as one text: each ends at a token with the end-of-word suffix."""
        memo, letters, others = self._memo, [], []
        for word in words:
            (letters if word.isalpha() else others).append(word)
        for at in range(0, len(letters), WORDS_AT_ONCE):
            some = letters[at : at + WORDS_AT_ONCE]
            ids = np.array(self._tokenizer.encode_batch_fast([" ".join(some)], add_special_tokens=False)[0].ids, "<u4")
            ends = (np.flatnonzero(self._ends[ids]) + 1) * 4
            if len(ends) != len(some):
                others += some
                continue
            raw, start = ids.tobytes(), 0
            for word, end in zip(some, ends.tolist(), strict=True):
                memo[word] = raw[start:end]
                start = end
        for at in range(0, len(others), 2000):
            some = others[at : at + 2000]
            for word, code in zip(some, self._tokenizer.encode_batch_fast(some, add_special_tokens=False), strict=True):
                memo[word] = np.array(code.ids, "<u4").tobytes()

    def encode(self, texts: list[str]) -> list[bytes]:
        """Each text's ids and the end id, as little-endian unsigned 32-bit integers."""
        if self._tokenizer is None:
            self._open()
        out = []
        for at in range(0, len(texts), 256):
            runs = [[t] if ODD_SPACE(t) else t.split() for t in texts[at : at + 256]]
            new = set().union(*runs).difference(self._memo)
            if len(self._memo) + len(new) > self.memo_entries:
                self._memo.clear()
                new = set().union(*runs)
            self._learn(list(new))
            of = self._memo.__getitem__
            out += [b"".join(map(of, words)) + self._end for words in runs]
        return out


def token_ids(model, text: Column) -> Column:
    """A binary column: the text's ids and the end id as little-endian 32-bit integers. model: a broadcast WordTokenizer."""

    @F.pandas_udf(T.BinaryType())
    def ids(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        tokenizer = model.value
        for texts in batches:
            yield pd.Series(tokenizer.encode(texts.tolist()), dtype=object)

    return ids(F.coalesce(text, F.lit("")))


def pieces(coded: DataFrame, id_col: str = "doc_id", ids_col: str = "ids", tokens: int = 4096) -> DataFrame:
    """One row (doc_id, piece, start, length, piece_ids) for each piece of at most so many tokens."""
    need(coded, id_col, ids_col)
    cut = coded.select(F.col(id_col).alias("doc_id"), F.col(ids_col).alias("_ids"))
    numbers = F.expr(f"sequence(0, cast((octet_length(_ids) div 4 - 1) div {tokens} as int))")
    cut = cut.select("doc_id", "_ids", F.explode(numbers).alias("piece"))
    piece_ids = F.substring("_ids", F.col("piece") * (4 * tokens) + 1, F.lit(4 * tokens))
    return cut.select("doc_id", "piece", (F.col("piece").cast("long") * tokens).alias("start"), piece_ids.alias("piece_ids")).withColumn("length", (F.octet_length("piece_ids") / 4).cast("long"))


def best_fit(lengths: np.ndarray, tokens: int, documents: int, attention: float, weights=(1.0, 0.001, 0.001), score: str = "norm") -> tuple[np.ndarray, np.ndarray]:
    """(bin, offset) of each piece. Pieces are placed in the order given, which should be longest first."""
    caps = np.array([tokens, documents, attention], float)
    scale = np.array(weights, float) / caps**2
    n = len(lengths)
    where, offset = np.empty(n, np.int64), np.empty(n, np.int64)
    left = np.empty((3, 1024))
    label = np.empty(1024, np.int64)
    m = made = 0
    least = lengths[n - 1] if n else 0
    for i, length in enumerate(lengths.tolist()):
        demand = (length, 1, length * length)
        if demand[0] > tokens or demand[1] > documents or demand[2] > attention:
            raise ValueError(f"a piece of {length} tokens exceeds a capacity")
        open_left = left[:, :m]
        room = np.flatnonzero((open_left[0] >= length) & (open_left[1] >= 1) & (open_left[2] >= demand[2]))
        if len(room):
            some = open_left[:, room]
            if score == "norm":
                value = scale[0] * (some[0] - length) ** 2 + scale[1] * (some[1] - 1) ** 2 + scale[2] * (some[2] - demand[2]) ** 2
            else:
                value = -(scale[0] * length * some[0] + scale[1] * some[1] + scale[2] * demand[2] * some[2])
            b = room[np.argmin(value)]
        else:
            if m == left.shape[1]:
                left, label = np.concatenate([left, np.empty_like(left)], axis=1), np.concatenate([label, label])
            b, label[m] = m, made
            left[:, b] = caps
            m, made = m + 1, made + 1
        where[i], offset[i] = label[b], tokens - left[0, b]
        left[0, b] -= length
        left[1, b] -= 1
        left[2, b] -= demand[2]
        if left[0, b] < least or left[1, b] < 1:  # nothing fits any more: close it
            m -= 1
            left[:, b], label[b] = left[:, m], label[m]
    return where, offset


def pack(placed: DataFrame, tokens: int = 4096, documents: int | None = None, attention: float | None = None, shard_pieces: int = 20_000, weights=(1.0, 0.001, 0.001), score: str = "norm") -> DataFrame:
    """The rows of pieces (with their ``length``) with ``sequence_id`` and ``offset``."""
    need(placed, "length")
    documents, attention = documents or tokens, attention or float(tokens) ** 2
    names, schema = placed.columns, T.StructType([*placed.schema.fields, T.StructField("sequence_id", T.LongType()), T.StructField("offset", T.LongType())])
    # a number of each row, so that rows that repeat are dealt to all shards; the table holds it, so a task that runs again finds the same
    rows = written(placed.withColumn("_sl_row", F.monotonically_increasing_id()), "pieces")
    part = F.col("length") < tokens
    shards = max(1, -(-rows.where(part).count() // shard_pieces))
    shard = F.pmod(F.xxhash64(*names, "_sl_row"), F.lit(shards))

    def one(pdf: pd.DataFrame) -> pd.DataFrame:
        number = int(pdf["_sl_shard"].iloc[0])
        pdf = pdf.drop(columns="_sl_shard").sort_values(["length", *(c for c in names if c != "length")], ascending=[False] + [True] * (len(names) - 1), kind="stable")
        where, offset = best_fit(pdf["length"].to_numpy(np.int64), tokens, documents, attention, weights, score)
        return pdf.assign(sequence_id=(number << 40) + where, offset=offset)

    packed = rows.where(part).select(*names, shard.alias("_sl_shard")).groupBy("_sl_shard").applyInPandas(one, schema)
    full = rows.where(~part).select(*names, (-1 - F.monotonically_increasing_id()).alias("sequence_id"), F.lit(0).cast("long").alias("offset"))
    return packed.unionByName(full)


def sequences(packed: DataFrame) -> DataFrame:
    """(sequence_id, ids): the packed sequences themselves, from rows that still have ``piece_ids``."""
    need(packed, "sequence_id", "offset", "piece_ids")
    parts = F.sort_array(F.collect_list(F.struct("offset", "piece_ids")))
    return packed.groupBy("sequence_id").agg(F.aggregate(parts, F.lit(b""), lambda a, x: F.concat(a, x["piece_ids"])).alias("ids"))


def pack_documents(docs: DataFrame, model, tokens: int = 4096, **how) -> DataFrame:
    """(doc_id, piece, start, length, ids_crc32, sequence_id, offset) of every piece of the documents."""
    need(docs, "doc_id", "text")
    small_batches(docs.sparkSession)
    coded = docs.select("doc_id", token_ids(model, F.col("text")).alias("ids"))
    cut = pieces(coded, tokens=tokens).select("doc_id", "piece", "start", "length", F.crc32("piece_ids").alias("ids_crc32"))
    return pack(cut, tokens, **how)


def op6_best_fit_packing(spark, sf_dir: str, name: str = "word_bpe_49k.json") -> DataFrame:
    import public_tokenizers

    from .common import table

    model = spark.sparkContext.broadcast(WordTokenizer.from_file(public_tokenizers.path(name), end_id=1))
    return pack_documents(table(spark, sf_dir, "documents"), model)
