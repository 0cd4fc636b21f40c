"""Byte-level BPE encoding and decoding with a two-tier lookup.

Each match of the pre-token pattern is encoded by itself. The first tier is a minimal perfect hash over the
vocabulary (one slot for each entry, no empty slots): a pre-token that is a vocabulary entry gets its id from one
probe, which compares the entry's bytes. Only misses are merged, lowest rank first and leftmost on ties, with a
heap over a doubly linked list of bytes. A bounded memo keeps what was resolved lately.

Rank files are parsed on the driver and broadcast: their size is the vocabulary's, and is checked.

Defined cases: null is the empty text, which has no ids and decodes to no bytes; texts are encoded whole, however
long; special tokens' strings are ordinary text; rows that repeat have equal ids, a row without an id is encoded like any other; an empty
table gives no rows; extra columns are ignored.
"""

from __future__ import annotations

import base64
import heapq
from collections.abc import Iterator

import numpy as np
import pandas as pd
import regex
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

MAX_VOCABULARY = 1_000_000
MEMO_ENTRIES = 300_000
#: Texts of a batch are handled in runs of about this many characters.
RUN_CHARS = 1_000_000


class PerfectHash:
    """Minimal perfect hash over distinct byte strings, by hash-and-displace.

    Keys fall into buckets; large buckets first, each gets the smallest displacement that sends all its keys to
    free slots; buckets of one key then take the slots that are left.
    """

    def __init__(self, keys: list[bytes], per_bucket: int = 4):
        self.n = len(keys)
        self.buckets = max(1, self.n // per_bucket)
        h = self._hashes(keys)
        bucket = (h % np.uint64(self.buckets)).astype(np.int64)
        order = np.argsort(bucket, kind="stable")
        sizes = np.bincount(bucket, minlength=self.buckets)
        ends = np.cumsum(sizes)
        self.shift = np.zeros(self.buckets, np.int64)
        self.slot_key = np.full(self.n, -1, np.int64)
        free = np.ones(self.n, bool)
        singles = []
        for b in np.argsort(-sizes, kind="stable"):
            if sizes[b] == 0:
                break
            members = order[ends[b] - sizes[b] : ends[b]]
            if sizes[b] == 1:
                singles.append((b, members[0]))
                continue
            tried = 0
            while True:
                d = np.arange(tried, tried + 256, dtype=np.uint64)
                slots = self._displaced(h[members][:, None], d[None, :])
                fits = free[slots].all(axis=0)
                if len(members) > 1:
                    s = np.sort(slots, axis=0)
                    fits &= (s[1:] != s[:-1]).all(axis=0)
                if fits.any():
                    at = int(np.argmax(fits))
                    self.shift[b] = tried + at
                    self.slot_key[slots[:, at]] = members
                    free[slots[:, at]] = False
                    break
                tried += 256
                if tried > 1 << 22:
                    raise ValueError("two keys have the same hash")
        for (b, member), slot in zip(singles, np.flatnonzero(free), strict=True):
            self.shift[b] = -1 - slot
            self.slot_key[slot] = member

    @staticmethod
    def _hashes(keys: list[bytes]) -> np.ndarray:
        digest = xxhash.xxh64_intdigest
        return np.fromiter((digest(k, 11) for k in keys), np.uint64, len(keys))

    def _displaced(self, h: np.ndarray, d: np.ndarray) -> np.ndarray:
        x = (h ^ (d * np.uint64(0x9E3779B97F4A7C15))) * np.uint64(0xBF58476D1CE4E5B9)
        return ((x ^ (x >> np.uint64(32))) % np.uint64(self.n)).astype(np.int64)

    def slots(self, keys: list[bytes]) -> np.ndarray:
        """A slot for each key; only for keys of the set does it mean anything, so compare what it holds."""
        h = self._hashes(keys)
        shift = self.shift[(h % np.uint64(self.buckets)).astype(np.int64)]
        return np.where(shift < 0, -1 - shift, self._displaced(h, np.maximum(shift, 0).astype(np.uint64)))


def merge_bytes(word: bytes, ranks: dict[bytes, int]) -> list[bytes]:
    """The vocabulary entries that a pre-token's bytes merge to: lowest rank first, leftmost first on ties.

    A heap holds the possible merges as integers that order by rank and place; ``after`` and ``before`` link the
    pieces. An entry is stale when the piece it starts at, or the end it would reach, is there no more.
    """
    n = len(word)
    size = n + 1
    after = list(range(1, n + 1))  # start of the next piece, which is this piece's end; 0: merged away
    before = list(range(-1, n - 1))
    of = ranks.get
    heap = [(r * size + i) * size + i + 2 for i in range(n - 1) if (r := of(word[i : i + 2])) is not None]
    heapq.heapify(heap)
    pop, push = heapq.heappop, heapq.heappush
    while heap:
        x, end = divmod(pop(heap), size)
        i = x % size
        j = after[i]
        if not j or j >= n or after[j] != end:
            continue
        after[j] = 0
        after[i] = end
        if end < n:
            before[end] = i
            if (r := of(word[i : after[end]])) is not None:
                push(heap, (r * size + i) * size + after[end])
        if (p := before[i]) >= 0 and (r := of(word[p:end])) is not None:
            push(heap, (r * size + p) * size + end)
    pieces, i = [], 0
    while i < n:
        pieces.append(word[i : after[i]])
        i = after[i]
    return pieces


class ByteBpe:
    """A vocabulary of ranks with its pattern: encodes texts to little-endian 32-bit ids and decodes those."""

    def __init__(self, ranks: dict[bytes, int], pattern: str):
        if len(ranks) > MAX_VOCABULARY:
            raise ValueError(f"a vocabulary of {len(ranks)} entries is too large to broadcast; at most {MAX_VOCABULARY}")
        if missing := [b for b in range(256) if bytes([b]) not in ranks]:
            raise ValueError(f"the vocabulary lacks {len(missing)} of the 256 bytes")
        self.ranks, self.pattern = ranks, pattern
        keys = list(ranks)
        self.table = PerfectHash(keys)
        self.slot_bytes = [keys[k] for k in self.table.slot_key]
        self._start()

    @classmethod
    def from_file(cls, path: str, pattern: str) -> ByteBpe:
        with open(path, "rb") as lines:
            ranks = {base64.b64decode(a): int(b) for a, b in (line.split() for line in lines)}
        return cls(ranks, pattern)

    def _start(self) -> None:
        # the pattern's \s means Unicode's White_Space
        self._find = regex.compile(self.pattern.replace(r"[^\s", r"[^\p{White_Space}").replace(r"\s", r"\p{White_Space}").replace(r"\S", r"\P{White_Space}")).findall
        self._memo: dict[str, bytes] = {}
        self._bytes_of: list[bytes] = [b""] * (max(self.ranks.values()) + 1)
        for k, v in self.ranks.items():
            self._bytes_of[v] = k
        self._id_bytes = {k: v.to_bytes(4, "little") for k, v in self.ranks.items()}

    def __getstate__(self) -> dict:
        return {k: v for k, v in self.__dict__.items() if k not in ("_find", "_memo", "_bytes_of", "_id_bytes")}

    def __setstate__(self, state: dict) -> None:
        self.__dict__.update(state)
        self._start()

    def _resolve(self, words: list[str]) -> None:
        raw = [w.encode() for w in words]
        slots = self.table.slots(raw)
        memo, ranks, held, of = self._memo, self.ranks, self.slot_bytes, self._id_bytes.__getitem__
        for word, key, slot in zip(words, raw, slots.tolist(), strict=True):
            memo[word] = of(key) if held[slot] == key else b"".join(map(of, merge_bytes(key, ranks)))

    def encode(self, texts: list[str]) -> list[bytes]:
        out: list[bytes] = []
        run: list[list[str]] = []
        size = 0
        for text in texts:
            run.append(self._find(text))
            size += len(text)
            if size > RUN_CHARS:
                out += self._encode_run(run)
                run, size = [], 0
        return out + self._encode_run(run)

    def _encode_run(self, run: list[list[str]]) -> list[bytes]:
        new = set().union(*run).difference(self._memo) if run else set()
        if len(self._memo) + len(new) > MEMO_ENTRIES:
            self._memo.clear()
            new = set().union(*run)
        if new:
            self._resolve(list(new))
        of = self._memo.__getitem__
        return [b"".join(map(of, words)) for words in run]

    def decode(self, ids: bytes) -> bytes:
        return b"".join(map(self._bytes_of.__getitem__, np.frombuffer(ids, "<u4").tolist()))


def encode(model, text: Column) -> Column:
    """A binary column with the text's ids as little-endian unsigned 32-bit integers. model: a broadcast ByteBpe."""

    @F.pandas_udf(T.BinaryType())
    def ids(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        bpe = model.value
        for texts in batches:
            yield pd.Series(bpe.encode(texts.fillna("").tolist()), dtype=object)

    return ids(F.coalesce(text, F.lit("")))


def decode(model, ids: Column) -> Column:
    """A binary column with the bytes that the ids stand for."""

    @F.pandas_udf(T.BinaryType())
    def text_bytes(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        bpe = model.value
        for rows in batches:
            yield pd.Series([bpe.decode(x) for x in rows], dtype=object)

    return text_bytes(ids)


def ids_array(ids: Column) -> Column:
    """The binary ids as an array of longs, for users who want numbers."""

    @F.pandas_udf(T.ArrayType(T.LongType()))
    def numbers(rows: pd.Series) -> pd.Series:
        return rows.map(lambda x: np.frombuffer(x, "<u4").astype("int64"))

    return numbers(ids)


def op10_byte_bpe(spark, sf_dir: str, name: str = "byte_bpe_multi_50k.tiktoken") -> DataFrame:
    import public_tokenizers

    from .common import small_batches, table

    small_batches(spark)
    model = spark.sparkContext.broadcast(ByteBpe.from_file(public_tokenizers.path(name), public_tokenizers.PATTERN))
    coded = table(spark, sf_dir, "documents").select("doc_id", encode(model, F.col("text")).alias("ids"))
    both = coded.withColumn("decoded", decode(model, F.col("ids")))
    return both.select(
        "doc_id",
        (F.octet_length("ids") / 4).cast("long").alias("n_tokens"),
        F.sha2("ids", 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
    )
