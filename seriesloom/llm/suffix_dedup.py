"""Suffix-array dedup: removes every byte covered by a string of ``length`` bytes that also starts elsewhere.

Each string of that length holds a landmark: of its substrings of ``GRAM`` bytes the one with the smallest hash, the
leftmost on ties. Equal strings have equal landmarks, so strings are only compared within the group of their landmark.
Neighbouring strings of a text mostly share a landmark; such a run is one *stretch* of text. What remains after
exact copies of whole texts and of whole stretches are counted by hash (those are removed as they are) is sorted:
the distinct stretches of a group go to one task, which builds a suffix array over the strings that start in them.

The array is built in two stages. Suffixes that are smaller than their successors are sorted directly; the others are
induced by a scan over the buckets of first bytes, from smaller buckets to larger ones: a suffix that is larger than
its successor follows its successor's order. Common prefixes of neighbours in the array then tell which strings
occur twice. Order and prefixes matter up to ``length`` bytes only.

A group above ``GROUP_STRETCHES`` stretches is dealt to several tasks; the distinct strings of each then meet by hash across
tasks, so its result is whole too. Only texts' hashes, landmarks and stretches that need sorting are shuffled, and the
texts themselves once to be cut into stretches and once to be cleaned.

Defined cases: null is the empty text; texts are UTF-8 bytes and may come out cut inside a character; rows that share id
and text are copies of each other; matches never cross texts; an empty table gives no rows; extra columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import need, semi_join_counted, small_batches, written

LENGTH = 400
GRAM = 128
GROUP_STRETCHES = 20_000
#: Strings sorted together where groups are small.
BLOCK_STARTS = 100_000
PLACE_BITS = 24
PLACES = (1 << PLACE_BITS) - 1

_BASE = 0x9E3779B97F4A7C15  # odd, so it has an inverse modulo 2**64
_INVERSE = pow(_BASE, -1, 1 << 64)
_VALUES = np.random.default_rng(7).integers(0, 1 << 63, 256, dtype=np.uint64)


class Landmarks:
    """Finds the stretches of texts: runs of strings that share a landmark."""

    def __init__(self, length: int = LENGTH, gram: int | None = None) -> None:
        self.length, self.gram = length, gram or min(GRAM, max(1, length // 3))
        self._grow(1 << 13)

    def _grow(self, n: int) -> None:
        with np.errstate(over="ignore"):
            self._up = np.cumprod(np.concatenate([[np.uint64(1)], np.full(n, _BASE, np.uint64)]), dtype=np.uint64)
            self._down = np.cumprod(np.concatenate([[np.uint64(1)], np.full(n, _INVERSE, np.uint64)]), dtype=np.uint64)

    def _part(self, raw: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        n, w, width = len(raw), self.gram, self.length - self.gram + 1
        if n >= len(self._up):
            self._grow(2 * n)
        sums = np.zeros(n + 1, np.uint64)
        np.cumsum(_VALUES[np.frombuffer(raw, np.uint8)] * self._up[:n], out=sums[1:])
        h = (sums[w:] - sums[:-w]) * self._down[: n - w + 1]
        h ^= h >> np.uint64(32)
        h *= np.uint64(0xD6E8FEB86659FD93)
        h ^= h >> np.uint64(29)
        key = (h << np.uint64(PLACE_BITS)) | np.arange(len(h), dtype=np.uint64)
        rows = -(-len(key) // width)
        padded = np.full(rows * width, np.iinfo(np.uint64).max, np.uint64)
        padded[: len(key)] = key
        ahead = np.minimum.accumulate(padded.reshape(rows, width), axis=1).ravel()
        behind = np.minimum.accumulate(padded.reshape(rows, width)[:, ::-1], axis=1)[:, ::-1].ravel()
        least = np.minimum(behind[: n - self.length + 1], ahead[width - 1 : width + n - self.length])
        cuts = np.flatnonzero(least[1:] != least[:-1]) + 1
        first = np.concatenate([[0], cuts])
        last = np.concatenate([cuts - 1, [len(least) - 1]])
        return (least[first] & np.uint64(PLACES)).astype(np.int64), first, last

    def stretches(self, raw: bytes) -> list[tuple[int, int, int, int]]:
        """(landmark's hash, stretch's hash, first start, last start) of each stretch."""
        out = []
        digest = xxhash.xxh64_intdigest
        step = PLACES - self.length
        for at in range(0, max(0, len(raw) - self.length + 1), step):
            part = raw[at : at + step + self.length - 1]
            place, first, last = self._part(part)
            for p, a, b in zip(place.tolist(), first.tolist(), last.tolist(), strict=True):
                out.append((digest(part[p : p + self.gram]) >> 1, digest(part[a : b + self.length], 1) >> 1, at + a, at + b))
        return out


def _kinds(text: np.ndarray, ends: np.ndarray, length: int) -> np.ndarray:
    """True where a suffix is larger than its successor, by the bytes of its own piece and up to ``length`` of them.

    ends: the last place of each piece of the text.
    """
    n = len(text)
    change = np.zeros(n, bool)
    change[:-1] = text[1:] != text[:-1]
    edge = np.zeros(n, bool)
    edge[ends] = True
    stop = np.flatnonzero(change | edge)
    run_end = stop[np.searchsorted(stop, np.arange(n))]
    follows = text[np.minimum(run_end + 1, n - 1)]
    return ~edge[run_end] & (run_end + 1 - np.arange(n) < length) & (text > follows)


def _sort_directly(raw: bytes, text: np.ndarray, places: np.ndarray, limit: np.ndarray) -> np.ndarray:
    """The places by the bytes from each up to its limit: by eight bytes at once, then ties by the rest."""
    padded = np.concatenate([text, np.zeros(8, np.uint8)])
    at = places[:, None] + np.arange(8)[None, :]
    first = np.where(at < limit[:, None], padded[at], 0).astype(np.uint8).view(">u8").ravel().astype(np.uint64)
    order = np.argsort(first, kind="stable")
    places, limit, first = places[order], limit[order], first[order]
    cuts = np.concatenate([[0], np.flatnonzero(first[1:] != first[:-1]) + 1, [len(first)]])
    size = np.diff(cuts)
    listed, ends = places.tolist(), limit.tolist()
    for a, n in zip(cuts[:-1][size > 1].tolist(), size[size > 1].tolist(), strict=True):
        listed[a : a + n] = [p for _, p in sorted((raw[p:e], p) for p, e in zip(listed[a : a + n], ends[a : a + n], strict=True))]
    return np.array(listed, np.int64)


def suffix_order(pieces: list[bytes], starts: list[int], length: int = LENGTH) -> tuple[bytes, np.ndarray]:
    """(all pieces, places): the strings of ``length`` bytes at the first ``starts`` places of each piece, in sorted order."""
    raw = b"".join(pieces)
    text = np.frombuffer(raw, np.uint8)
    sizes = np.array([len(p) for p in pieces])
    begin = np.concatenate([[0], np.cumsum(sizes)[:-1]])
    n = np.array(starts)
    larger = _kinds(text, begin + sizes - 1, length)
    # suffixes to sort: the asked ones, and after them each piece's next ones up to the first that is sorted directly
    edges = np.zeros(len(raw) + 1, np.int64)
    np.add.at(edges, begin, 1)
    np.add.at(edges, begin + n, -1)
    wanted = np.cumsum(edges)[:-1].astype(bool)
    direct_at = np.flatnonzero(~larger)
    past = begin + n - 1
    helper = direct_at[np.searchsorted(direct_at, past)]  # a piece's last place is always direct
    spread = np.zeros(len(raw) + 1, np.int64)
    np.add.at(spread, begin, 1)
    np.add.at(spread, helper + 1, -1)
    used = np.cumsum(spread).astype(bool)[:-1]
    first_of_piece = np.zeros(len(raw), bool)
    first_of_piece[begin] = True
    piece_end = np.repeat(begin + sizes, sizes)

    direct = np.flatnonzero(used & ~larger)
    direct = _sort_directly(raw, text, direct, np.minimum(direct + length, piece_end[direct]))
    heads = text[direct]
    bounds = np.searchsorted(heads, np.arange(257))
    induced: list[list[np.ndarray]] = [[] for _ in range(256)]
    order = []
    for c in np.unique(text[used]).tolist():
        front = np.concatenate(induced[c]) if induced[c] else np.zeros(0, np.int64)
        bucket = []
        while len(front):
            bucket.append(front)
            before = front[~first_of_piece[front]] - 1
            front = before[used[before] & larger[before] & (text[before] == c)]
        bucket.append(direct[bounds[c] : bounds[c + 1]])
        whole = np.concatenate(bucket)
        order.append(whole)
        before = whole[~first_of_piece[whole]] - 1
        before = before[used[before] & larger[before] & (text[before] > c)]
        heads_before = text[before]
        by = np.argsort(heads_before, kind="stable")
        before, heads_before = before[by], heads_before[by]
        for part in np.split(before, np.flatnonzero(heads_before[1:] != heads_before[:-1]) + 1):
            if len(part):
                induced[int(text[part[0]])].append(part)
    places = np.concatenate(order) if order else np.zeros(0, np.int64)
    return raw, places[wanted[places]]


def repeated(raw: bytes, places: np.ndarray, length: int = LENGTH) -> np.ndarray:
    """The places whose string is also a neighbour's: adjacent common prefixes of at least ``length``."""
    if len(places) < 2:
        return np.zeros(0, np.int64)
    text = np.frombuffer(raw, np.uint8)
    a, b = places[:-1], places[1:]
    maybe = np.ones(len(a), bool)
    for k in (0, length // 3, length // 2, length - 1):
        maybe &= text[a + k] == text[b + k]
    same = [i for i in np.flatnonzero(maybe).tolist() if raw[a[i] : a[i] + length] == raw[b[i] : b[i] + length]]
    return np.unique(np.concatenate([a[same], b[same]])) if same else np.zeros(0, np.int64)


def _base(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    text = F.coalesce(F.col(text_col), F.lit(""))
    rows = docs.select(F.col(id_col).alias("doc_id"), text.alias("text"))
    return rows.withColumn("id", F.coalesce(F.col("doc_id").cast("long"), F.lit(-(1 << 63)))).withColumn("th", F.xxhash64("text"))


def repeated_runs(docs: DataFrame, length: int = LENGTH, id_col: str = "doc_id", text_col: str = "text", group_stretches: int = GROUP_STRETCHES) -> DataFrame:
    """(id, th, runs): byte ranges that repeated strings cover, for each text (by id and hash) that has some."""
    need(docs, id_col, text_col)
    small_batches(docs.sparkSession)
    base = _base(docs, id_col, text_col)

    # whole copies: one of each stays in the search, all of them go if they are long enough
    keys = base.select("id", "th", F.xxhash64(F.lit(7), "text").alias("th2"), F.octet_length("text").alias("n")).where(F.col("n") >= length)
    keys = written(keys, "texts")
    copies = written(keys.groupBy("th", "th2").agg(F.count("*").alias("n")).where("n > 1"), "copies")
    copied = semi_join_counted(keys, copies, ["th", "th2"]).select("id", "th", F.lit(0).alias("a"), F.col("n").alias("b"))

    def mark(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        landmarks = Landmarks(length)
        for pdf in batches:
            out = [(i, t, *s) for i, t, text in pdf[["id", "th", "text"]].itertuples(index=False) for s in landmarks.stretches(text.encode())]
            yield pd.DataFrame(out, columns=["id", "th", "mark", "stretch", "a", "b"])

    marks = base.where(F.octet_length("text") >= length).select("id", "th", "text").mapInPandas(mark, "id long, th long, mark long, stretch long, a int, b int")
    marks = written(marks, "landmarks")
    place = F.struct("th", "a")
    stretches = marks.groupBy("mark", "stretch").agg(F.count("*").alias("n"), F.min(place).alias("low"), F.max(place).alias("high"), F.min(F.struct("id", "th", "a", "b")).alias("one"))
    stretches = written(stretches.select("mark", "stretch", "n", (F.col("low") != F.col("high")).alias("twice"), "one"), "stretches")

    # a stretch that occurs twice is covered wherever it is
    whole = semi_join_counted(marks, stretches.where("twice"), ["mark", "stretch"]).select("id", "th", "a", (F.col("b") + length).alias("b"))

    # landmarks with several stretches: the stretches' texts meet, one of each
    several = stretches.groupBy("mark").agg(F.count("*").alias("size")).where("size > 1")
    ship = stretches.join(several, "mark").select("mark", "size", "twice", "one.*")
    wanted = ship.groupBy("id", "th").agg(F.collect_list(F.struct("mark", "size", "twice", "a", "b")).alias("cuts"))
    cut = base.join(wanted.hint("shuffle_hash"), ["id", "th"])
    slices = cut.select("id", "th", F.encode("text", "utf-8").alias("raw"), F.explode("cuts").alias("cut")).select(
        "id", "th", "cut.mark", "cut.size", "cut.twice", "cut.a", F.expr(f"substring(raw, cut.a + 1, cut.b - cut.a + {length})").alias("piece")
    )
    tasks = F.ceil(F.col("size") / F.lit(group_stretches)).cast("int")
    dealt = slices.withColumn("part", F.pmod(F.xxhash64("id", "th", "a"), tasks)).withColumn("parts", tasks)

    def sort(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        columns = ["mark", "id", "th", "a", "b", "string"]

        def block(rows: list[tuple]) -> pd.DataFrame:
            pieces = [r[6] for r in rows]
            raw, places = suffix_order(pieces, [len(p) - length + 1 for p in pieces], length)
            hits = repeated(raw, places, length)
            begin = np.concatenate([[0], np.cumsum([len(p) for p in pieces])[:-1]])
            owner = np.searchsorted(begin, hits, side="right") - 1
            cuts = np.flatnonzero((np.diff(hits) != 1) | (np.diff(owner) != 0)) + 1 if len(hits) else []
            out = []
            for run in np.split(np.arange(len(hits)), cuts) if len(hits) else []:
                mark, id_, th, a, twice, parts, _ = rows[owner[run[0]]]
                if not twice:
                    low = a + int(hits[run[0]] - begin[owner[run[0]]])
                    out.append((mark, id_, th, low, low + len(run) - 1 + length, None))
            if rows[0][5] > 1:  # other tasks hold more of this group: its distinct strings meet by hash
                seen, hit = {}, set(hits.tolist())
                for p in places.tolist():
                    k = xxhash.xxh64_intdigest(raw[p : p + length], 3) >> 1
                    if k not in seen:
                        seen[k] = p
                for k, p in seen.items():
                    o = int(np.searchsorted(begin, p, side="right") - 1)
                    mark, id_, th, a, twice, *_ = rows[o]
                    low = a + int(p - begin[o])
                    out.append((mark, id_, th, low, -1 if twice or p in hit else low + length, k))
            # a column of its own: hashes beside nulls must not pass through doubles
            return pd.DataFrame([r[:5] for r in out], columns=columns[:5]).assign(string=pd.array([r[5] for r in out], dtype="Int64"))

        rows, starts, now, group, group_starts = [], 0, None, [], 0
        for pdf in batches:
            for r in pdf[["mark", "id", "th", "a", "twice", "parts", "part", "piece"]].itertuples(index=False):
                if (r.mark, r.part) != now:
                    if group and group[0][5] > 1:
                        yield block(group)
                    else:
                        rows, starts = rows + group, starts + group_starts
                    if starts > BLOCK_STARTS:
                        yield block(rows)
                        rows, starts = [], 0
                    now, group, group_starts = (r.mark, r.part), [], 0
                group.append((r.mark, r.id, r.th, r.a, r.twice, r.parts, r.piece))
                group_starts += len(r.piece) - length + 1
        if group and group[0][5] > 1:
            yield block(group)
            group = []
        if rows + group:
            yield block(rows + group)

    order = dealt.repartition("mark", "part").sortWithinPartitions("mark", "part")
    found = written(order.mapInPandas(sort, "mark long, id long, th long, a int, b int, string long"), "runs")
    runs = found.where("string is null").select("id", "th", "a", "b")
    across = found.where("string is not null")
    both = across.groupBy("mark", "string").count().where("count > 1").select("mark", "string")
    met = across.where("b >= 0").join(both, ["mark", "string"], "left_semi").select("id", "th", "a", "b")
    everything = copied.unionByName(whole).unionByName(runs).unionByName(met)
    # a set: rows that repeat an id and a text bring the same runs, however many they are
    return everything.groupBy("id", "th").agg(F.collect_set(F.struct("a", "b")).alias("runs"))


def remove_runs(docs: DataFrame, runs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_bytes, n_removed, n_spans, kept): the texts' bytes without the runs."""
    base = _base(docs, id_col, text_col)
    joined = base.join(runs.hint("shuffle_hash"), ["id", "th"], "left")

    @F.pandas_udf("struct<n_removed:long,n_spans:long,kept:binary>")
    def clean(texts: pd.Series, lists: pd.Series) -> pd.DataFrame:
        out = []
        for text, found in zip(texts, lists, strict=True):
            raw = text.encode()
            merged: list[list[int]] = []
            for a, b in sorted((r["a"], r["b"]) for r in found) if found is not None else ():
                if merged and a <= merged[-1][1]:
                    merged[-1][1] = max(merged[-1][1], b)
                else:
                    merged.append([a, b])
            parts, at = [], 0
            for a, b in merged:
                parts.append(raw[at:a])
                at = b
            out.append((sum(b - a for a, b in merged), len(merged), b"".join(parts) + raw[at:]))
        return pd.DataFrame(out, columns=["n_removed", "n_spans", "kept"])

    cleaned = joined.select("doc_id", F.octet_length("text").cast("long").alias("n_bytes"), clean("text", "runs").alias("c"))
    return cleaned.select("doc_id", "n_bytes", "c.*")


def op9_suffix_dedup(spark, sf_dir: str) -> DataFrame:
    from .common import table

    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    cleaned = remove_runs(docs, repeated_runs(docs))
    digests = cleaned.withColumn("kept_sha256", F.sha2("kept", 256)).withColumn("has_repeats", F.col("n_removed") > 0)
    # what is kept, as text: bytes of a character that was cut become U+FFFD here, not in the digest
    return digests.select("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "has_repeats", F.make_valid_utf8(F.col("kept").cast("string")).alias("text"))
