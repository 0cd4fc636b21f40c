"""SimHash near-dedup: fingerprints of whole texts, and links between those that differ in few bits.

Words are maximal runs of other than ASCII white space in the text with A-Z lowered; every shingle of
``words_per_shingle`` words, repeats included, votes with the bits of its XXH64 (seed 42); a fingerprint bit is set
if over half the shingles set it.

Only distinct fingerprints are searched. Two that differ in at most ``radius`` bits agree in at least one of
``radius + 1`` blocks of bits, so each fingerprint goes to one shard for each block. A shard's fingerprints go into
a BK-tree (children keyed by their integer Hamming distance to the parent), which each next fingerprint
searches along edges within the radius only, and the shard reports links that span its linked groups, at most one
for each fingerprint. A shard above ``shard_rows`` is split again by blocks of the bits that its members
do not share, until none is: members that share all but 12 bits are few enough by themselves. So all links
between different fingerprints count, no shard is unbounded, and copies never meet each other in pairs.

Trees are built in the task that searches them. They grow with the data, so they are not broadcast.

Defined cases: a null or empty text has fingerprint zero, which links like any other; fewer words than a shingle are
one shingle; a row without an id is grouped but is never the smallest id; rows that repeat are in one group; texts of any length count whole; an empty table gives no
rows; extra columns are ignored or kept.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import ascii_lower, components, need, small_batches, written

SEED = 42
BITS = 64
SHARD_ROWS = 4096
CHUNK = 1 << 15
KEY_MULTIPLIERS = np.random.default_rng(11).integers(0, 1 << 62, 16, dtype=np.uint64) << np.uint64(1) | np.uint64(1)


def shingles(text: str, words_per_shingle: int) -> list[bytes]:
    words = text.encode().lower().split()  # bytes know ASCII white space and case only
    if len(words) <= words_per_shingle:
        return [b" ".join(words)] if words else []
    return list(map(b" ".join, zip(*(words[k:] for k in range(words_per_shingle)), strict=False)))


def shingle_hashes(text: str, words_per_shingle: int) -> np.ndarray:
    digest = xxhash.xxh64_intdigest
    return np.array([digest(s, SEED) for s in shingles(text, words_per_shingle)], "<u8")


def _bits_to_int(hashes: np.ndarray) -> int:
    """The bits that are set in over half of the hashes; zero for none."""
    votes = np.zeros(BITS, np.int64)
    for at in range(0, len(hashes), CHUNK):
        bits = np.unpackbits(hashes[at : at + CHUNK].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        votes += bits.sum(axis=0, dtype=np.uint32)
    return int(np.packbits(votes * 2 > len(hashes), bitorder="little").view("<u8")[0])


def fingerprint_of(text: str, words_per_shingle: int = 3) -> int:
    """The 64-bit fingerprint of one text."""
    return _bits_to_int(shingle_hashes(text, words_per_shingle))


def fingerprint(text: Column, words_per_shingle: int = 3) -> Column:
    """A long column with the fingerprint's 64 bits."""

    @F.pandas_udf(T.LongType())
    def of(texts: pd.Series) -> pd.Series:
        return pd.Series(np.array([fingerprint_of(t, words_per_shingle) for t in texts], np.uint64).view(np.int64))

    return of(F.coalesce(text, F.lit("")))


def hex_digits(fp: Column) -> Column:
    return F.lpad(F.lower(F.hex(fp)), 16, "0")


class BKTree:
    """Distinct integers, searched by Hamming distance."""

    def __init__(self) -> None:
        self.values: list[int] = []
        self.children: list[dict[int, int]] = []

    def add(self, value: int) -> None:
        self.values.append(value)
        self.children.append({})
        new = len(self.values) - 1
        at = 0
        while new:
            d = (self.values[at] ^ value).bit_count()
            if (below := self.children[at].get(d)) is None:
                self.children[at][d] = new
                return
            at = below

    def near(self, value: int, radius: int) -> Iterator[tuple[int, int]]:
        """(distance, place) of all values within the radius."""
        todo = [0] if self.values else []
        while todo:
            at = todo.pop()
            d = (self.values[at] ^ value).bit_count()
            if d <= radius:
                yield d, at
            if below := self.children[at]:
                if len(below) > 2 * radius + 1:
                    todo += [below[k] for k in range(d - radius, d + radius + 1) if k in below]
                else:
                    todo += [c for k, c in below.items() if -radius <= k - d <= radius]


def spanning_links(values: list[int], radius: int, accept: Callable[[int, int], bool] | None = None) -> list[tuple[int, int]]:
    """Links (places of two values) that connect whatever all links within the radius connect, if accepted.

    A value is tested against the members of each group until one is accepted, and its search ends once it has met
    every group; so a group of copies costs its members few tests, not all pairs.
    """
    values = [v % (1 << BITS) for v in values]  # signed longs as the bits they hold
    tree, parent, links = BKTree(), [], []
    groups = 0

    def root(i: int) -> int:
        while parent[i] != i:
            parent[i] = parent[parent[i]]
            i = parent[i]
        return i

    for i, value in enumerate(values):
        met = set()
        for _, j in tree.near(value, radius):
            r = root(j)
            if r not in met and (accept is None or accept(i, j)):
                met.add(r)
                links.append((i, j))
                if len(met) == groups:
                    break
        parent.append(i)
        for r in met:
            parent[r] = i
        groups += 1 - len(met)
        tree.add(value)
    return links


def _blocks(shared: int, parts: int) -> list[int]:
    """Masks: the shared bits and one of so many runs of the other bits."""
    free = [b for b in range(BITS) if not shared >> b & 1]
    return [shared | sum(1 << b for b in run.tolist()) for run in np.array_split(free, parts)]


def _signed(mask: int) -> int:
    return mask - (1 << BITS) if mask >> (BITS - 1) else mask


def near_links(fps: DataFrame, radius: int = 2, shard_rows: int = SHARD_ROWS) -> DataFrame:
    """(a, b): links between distinct fingerprints (column ``fp``) that connect all those within the radius."""

    def search(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        def links(values: list[int]) -> list[tuple[int, int]]:
            return [(values[i], values[j]) for i, j in spanning_links(values, radius)] if len(values) > 1 else []

        open_key, values, found = None, [], []
        for pdf in batches:
            for mask, part, fp in zip(pdf["mask"].tolist(), pdf["part"].tolist(), pdf["fp"].tolist(), strict=True):
                if (mask, part) != open_key:
                    found += links(values)
                    open_key, values = (mask, part), []
                values.append(fp)
            yield pd.DataFrame(found, columns=["a", "b"], dtype="int64")
            found = []
        yield pd.DataFrame(links(values), columns=["a", "b"], dtype="int64")

    masks = _blocks(0, radius + 1)
    rows = fps.select("fp", F.explode(F.array(*(F.lit(_signed(m)) for m in masks))).alias("mask"))
    rows = rows.withColumn("part", F.col("fp").bitwiseAND(F.col("mask")))
    out = None
    while True:
        large = rows.groupBy("mask", "part").count().where(F.col("count") > shard_rows).select("mask", "part")
        large = written(large, "large-shards")
        split = not large.isEmpty()
        here = rows.join(large, ["mask", "part"], "left_anti") if split else rows
        dealt = here.repartition("mask", "part").sortWithinPartitions("mask", "part", "fp")
        links = dealt.mapInPandas(search, "a long, b long")
        out = links if out is None else out.unionByName(links)
        if not split:
            return out
        below = {m: [x for x in _blocks(m, radius + 1) if x != m] for m in masks}
        table = F.create_map(*(x for m, subs in below.items() for x in (F.lit(_signed(m)), F.array(*(F.lit(_signed(s)) for s in subs)))))
        rows = rows.join(large, ["mask", "part"], "left_semi").select("fp", F.explode(F.element_at(table, F.col("mask"))).alias("mask"))
        rows = written(rows.withColumn("part", F.col("fp").bitwiseAND(F.col("mask"))), "shards")
        masks = [s for subs in below.values() for s in subs]


def groups(docs: DataFrame, radius: int = 2, words_per_shingle: int = 3, shard_rows: int = SHARD_ROWS, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, fp, component_id) of every row: the smallest id that its links reach."""
    need(docs, id_col, text_col)
    prints = written(docs.select(F.col(id_col).alias("doc_id"), fingerprint(F.col(text_col), words_per_shingle).alias("fp")), "fingerprints")
    fps = written(prints.groupBy("fp").agg(F.min("doc_id").alias("least")), "distinct-fingerprints")
    roots = components(near_links(fps, radius, shard_rows)).select(F.col("node").alias("fp"), "root")
    rooted = fps.join(roots, "fp", "left").select("fp", "least", F.coalesce("root", "fp").alias("root"))
    least = rooted.groupBy("root").agg(F.min("least").alias("component_id"))
    named = rooted.join(least, "root").select("fp", "component_id")
    return prints.join(named, "fp")


def text_key(text: Column) -> Column:
    """A 128-bit hash of the text's words, whatever white space and case of A-Z: texts with equal keys are one text."""
    words = F.btrim(F.regexp_replace(ascii_lower(text), r"[\x20\x09-\x0D]+", " "), F.lit(" "))
    return F.unhex(F.md5(words))


def _alike(a: np.ndarray, b: np.ndarray, similarity: float) -> bool:
    """Whether two sets (sorted, distinct) reach the Jaccard likeness."""
    if min(len(a), len(b)) < similarity * max(len(a), len(b)):
        return False
    common = len(np.intersect1d(a, b, assume_unique=True))
    return common >= similarity * (len(a) + len(b) - common)


def rare_links(members: list[tuple[bytes, int, int, bool, np.ndarray]], similarity: float, across: bool) -> list[tuple[int, int]]:
    """Links (places of two members) between groups that a shard's texts have, whatever their fingerprints.

    A member is (group, size, rest, upper, shingles): how many shingles it has, and how many that another text holds
    from the shard's one on. Two texts can only be alike if the lesser rest makes up the likeness, where the shard's shingle is
    their first common one. With ``across``, only upper members meet lower ones.
    """
    numbers: dict[bytes, int] = {}
    group = np.array([numbers.setdefault(m[0], len(numbers)) for m in members], np.int64)
    size, rest = (np.array([m[k] for m in members], np.int64) for k in (1, 2))
    upper = np.array([m[3] for m in members], bool)
    low, links = np.flatnonzero(~upper), []
    for i in np.flatnonzero(upper).tolist() if across else range(1, len(members)):
        others = low if across else np.arange(i)
        needed = similarity / (1 + similarity) * (size[others] + size[i]) - 1e-6
        for j in others[(group[others] != group[i]) & (np.minimum(rest[others], rest[i]) >= needed)].tolist():
            if group[j] != group[i] and _alike(members[i][4], members[j][4], similarity):
                links.append((i, j))
                group[group == group[j]] = group[i]
    return links


def _rare_shards(sets: DataFrame, groups: DataFrame, similarity: float, shard_rows: int) -> DataFrame:
    """(key, low, high, upper, th, root, size, rest, shingles): a prefix-filter join of all the sets (th, shingles).

    Shingles are ordered by the number of texts that hold them, rarest first. Two sets that are alike have their first common
    shingle so early in both that what is left of each makes up the likeness; so a set goes to the shards of its
    early shingles only, and of those to the ones where another can be alike. Of shards with the same members the
    one of the first shingle is kept, and none whose members are one group (th, root) already. A shard above ``shard_rows``
    is dealt to a task for each pair of its blocks (low, high).
    """

    @F.pandas_udf("array<bigint>")
    def numbers(held: pd.Series) -> pd.Series:
        return pd.Series([np.frombuffer(h, "<i8") for h in held], dtype=object)

    share = similarity / (1 + similarity)
    each = written(sets.select("th", F.explode(numbers("shingles")).alias("key"), (F.length("shingles") / 8).cast("int").alias("size")), "shingles")
    holders = each.groupBy("key").agg(F.count("*").alias("holders")).where("holders > 1")
    order = Window.partitionBy("th").orderBy(F.desc("holders"), F.desc("key"))
    early = each.join(holders, "key").withColumn("rest", F.row_number().over(order)).where(F.col("rest") >= F.col("size") * similarity - 1e-6)
    early = written(early, "early-shingles")
    # the smaller of two alike sets has the shingle earlier still
    smaller = early.where(F.col("rest") >= F.col("size") * (2 * share) - 1e-6).groupBy("key").agg(F.min("size").alias("least"))
    able = early.join(smaller, "key").where(F.col("rest") >= (F.col("size") + F.col("least")) * share - 1e-6)
    able = written(able.join(groups, "th", "left").withColumn("root", F.coalesce("root", "th")), "able-shingles")
    members = [F.count("*").alias("n"), F.min("root").alias("a"), F.max("root").alias("b"), F.bit_xor(F.xxhash64("th")).alias("x"), F.bit_xor(F.xxhash64("th", F.lit(1))).alias("y")]
    shards = able.groupBy("key", "holders").agg(*members).where("a < b")
    shards = shards.groupBy("n", "x", "y").agg(F.min(F.struct("holders", "key")).alias("k")).select("k.key", "n")
    blocks = F.when(F.col("n") > shard_rows, F.ceil(F.col("n") * 2 / shard_rows)).otherwise(1).cast("int")
    dealt = able.join(shards, "key").withColumn("blocks", blocks).withColumn("block", F.pmod(F.xxhash64("th"), "blocks").cast("int"))
    dealt = dealt.select("*", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("other"))
    low, high = F.least("block", "other"), F.greatest("block", "other")
    dealt = dealt.select("key", low.alias("low"), high.alias("high"), (F.col("block") > F.col("other")).alias("upper"), "th", "root", "size", "rest")
    return dealt.join(sets, "th").repartition("key", "low", "high").sortWithinPartitions("key", "low", "high", "th")


def similar_groups(docs: DataFrame, similarity: float = 0.8, words_per_shingle: int = 5, radius: int = 24, keys: int = 8, shard_rows: int = SHARD_ROWS) -> DataFrame:
    """(doc_id, th, component_id) of every row, for likenesses that are too far apart for blocks of equal bits.

    Texts meet in shards by their smallest shingle under each of ``keys`` hashes: two of Jaccard likeness s share one with
    probability 1 - (1 - s)**keys. A shard's BK-tree finds fingerprints (here of distinct shingles, so that they go with
    Jaccard likeness) within ``radius``, and a link is kept if the shingle sets themselves are at least as alike as
    ``similarity``. Texts with the same words are one text, and shards with the same members are one shard.

    A shard above ``shard_rows`` has a shingle that very many texts share, such as a passage's. It is dealt to several
    tasks by a hash of text and key, which links groups of many near copies; then all texts of such shards also meet by a
    prefix-filter join of their shingle sets (:func:`_rare_shards`), which is exact: it misses no pair among them,
    whatever the passage's share and however many hold it.
    """
    need(docs, "doc_id", "text")
    small_batches(docs.sparkSession)
    text = F.coalesce(F.col("text"), F.lit(""))

    @F.pandas_udf("struct<fp:long,keys:array<long>>")
    def describe(texts: pd.Series) -> pd.DataFrame:
        """The fingerprint, and the smallest shingle under each hash."""
        fps, firsts = [], []
        for t in texts:
            h = np.unique(shingle_hashes(t, words_per_shingle))
            fps.append(_bits_to_int(h))
            firsts.append([int(((h ^ (h >> np.uint64(29))) * m >> np.uint64(1)).min()) for m in KEY_MULTIPLIERS[:keys]] if len(h) else [])
        return pd.DataFrame({"fp": np.array(fps, np.uint64).view(np.int64), "keys": pd.Series(firsts, dtype=object)})

    @F.pandas_udf(T.BinaryType())
    def shingle_set(texts: pd.Series) -> pd.Series:
        """The shingles' hashes, 64 bits of each."""
        return pd.Series([np.unique(shingle_hashes(t, words_per_shingle)).astype("<u8").tobytes() for t in texts], dtype=object)

    def search(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        def links(members: list[tuple[int, bytes, np.ndarray]]) -> list[tuple[bytes, bytes]]:
            def alike(i: int, j: int) -> bool:
                return _alike(members[i][2], members[j][2], similarity)

            found = spanning_links([m[0] for m in members], radius, alike) if len(members) > 1 else []
            return [(members[i][1], members[j][1]) for i, j in found]

        now, members, found = None, [], []
        for pdf in batches:
            for slot, key, part, fp, th, shingles in pdf[["slot", "key", "part", "fp", "th", "shingles"]].itertuples(index=False):
                if (slot, key, part) != now:
                    found += links(members)
                    now, members = (slot, key, part), []
                members.append((fp, th, np.frombuffer(shingles, "<u8")))
            yield pd.DataFrame(found, columns=["a", "b"], dtype=object)
            found = []
        yield pd.DataFrame(links(members), columns=["a", "b"], dtype=object)

    def search_rare(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        def links(now: tuple[int, int, int] | None, members: list, names: list[bytes]) -> list[tuple[bytes, bytes]]:
            return [(names[i], names[j]) for i, j in rare_links(members, similarity, now[1] != now[2])] if len(members) > 1 else []

        now, members, names, found = None, [], [], []
        for pdf in batches:
            for key, low, high, upper, th, root, size, rest, shingles in pdf[["key", "low", "high", "upper", "th", "root", "size", "rest", "shingles"]].itertuples(index=False):
                if (key, low, high) != now:
                    found += links(now, members, names)
                    now, members, names = (key, low, high), [], []
                members.append((root, size, rest, upper, np.frombuffer(shingles, "<u8")))
                names.append(th)
            yield pd.DataFrame(found, columns=["a", "b"], dtype=object)
            found = []
        yield pd.DataFrame(links(now, members, names), columns=["a", "b"], dtype=object)

    described = written(docs.select("doc_id", text_key(text).alias("th"), describe(text).alias("d")).select("doc_id", "th", "d.*"), "described")
    distinct = described.groupBy("th").agg(F.min("doc_id").alias("least"), F.first("fp").alias("fp"), F.first("keys").alias("keys"))
    distinct = written(distinct, "distinct-texts")
    at = written(distinct.select("th", "fp", F.posexplode("keys").alias("slot", "key")), "keys")
    members = [F.count("*").alias("n"), F.bit_xor(F.xxhash64("th")).alias("x"), F.bit_xor(F.xxhash64("th", F.lit(1))).alias("y")]
    shards = at.groupBy("slot", "key").agg(*members).where("n > 1").groupBy("n", "x", "y").agg(F.min(F.struct("slot", "key")).alias("k")).select("k.*", "n")
    at = written(at.join(shards, ["slot", "key"]), "shards")
    # a text is read from the row of its smallest id, or from rows without an id if only those have it
    wanted = at.select("th").distinct()
    owners = distinct.join(wanted, "th", "left_semi").select(F.col("th").alias("_sl_th"), F.col("least").alias("doc_id"))
    keyed = docs.select("doc_id", text.alias("text"))
    named_texts = keyed.join(owners.where("doc_id is not null").hint("shuffle_hash"), "doc_id").withColumn("th", text_key(F.col("text"))).where("th = _sl_th")
    other_texts = keyed.where("doc_id is null").withColumn("th", text_key(F.col("text")))
    other_texts = other_texts.join(owners.where("doc_id is null").select(F.col("_sl_th").alias("th")), "th", "left_semi")
    texts = named_texts.select("th", "text").unionByName(other_texts.select("th", "text"))
    sets = texts.select("th", shingle_set("text").alias("shingles")).dropDuplicates(["th"])
    crowded = written(at.where(F.col("n") > shard_rows).select("th").distinct(), "crowded")
    crowd = not crowded.isEmpty()
    sets = written(sets, "shingle-sets") if crowd else sets
    parts = F.ceil(F.col("n") / shard_rows).cast("int")
    dealt = at.withColumn("part", F.pmod(F.xxhash64("th", "slot"), parts)).join(sets, "th").repartition("slot", "key", "part").sortWithinPartitions("slot", "key", "part", "fp")
    links = dealt.mapInPandas(search, "a binary, b binary")
    if crowd:
        links = written(links, "links")
        linked = written(components(links).select(F.col("node").alias("th"), "root"), "linked")
        rare = _rare_shards(sets.join(crowded, "th", "left_semi"), linked, similarity, shard_rows)
        links = links.unionByName(rare.mapInPandas(search_rare, "a binary, b binary"))
    roots = components(links).select(F.col("node").alias("th"), "root")
    rooted = distinct.join(roots, "th", "left").select("th", "least", F.coalesce("root", "th").alias("root"))
    named = rooted.join(rooted.groupBy("root").agg(F.min("least").alias("component_id")), "root").select("th", "component_id")
    return described.select("doc_id", "th").join(named, "th")


def near_dedup(docs: DataFrame, **how) -> DataFrame:
    """One document of each group of similar ones: the one with the smallest id; of rows that repeat an id and a text, one.

    Rows without an id stay, one for each text, where their group has no id at all.
    """
    found = written(similar_groups(docs, **how), "groups")
    stay = found.where("doc_id = component_id").select("doc_id").distinct()
    same = Window.partitionBy("doc_id", "_sl_hash").orderBy(F.lit(1))
    first = lambda df: df.withColumn("_sl_hash", F.md5("text")).withColumn("_sl_nth", F.row_number().over(same)).where("_sl_nth = 1").drop("_sl_hash", "_sl_nth")
    named = docs.join(stay, "doc_id", "left_semi").select(docs.columns)
    alone = found.where("doc_id is null and component_id is null").select("th").distinct()
    nameless = docs.where("doc_id is null").withColumn("_sl_th", text_key(F.coalesce("text", F.lit(""))))
    nameless = nameless.join(alone, nameless["_sl_th"] == alone["th"], "left_semi").select(docs.columns)
    return first(named).unionByName(first(nameless))


def op3_simhash(spark, sf_dir: str) -> DataFrame:
    from .common import table

    found = groups(table(spark, sf_dir, "documents"))
    return found.select("doc_id", hex_digits(F.col("fp")).alias("fingerprint"), "component_id")
