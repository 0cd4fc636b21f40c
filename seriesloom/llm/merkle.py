"""Merkle manifest of a table: one tree for each group, one over the groups' roots, and a proof for every row.

Rows are hashed on the JVM, and only ids and digests go on. They are dealt to partitions by ranges of (group, id, digest) and
sorted there. Counts of each partition's first and last group (the only ones that other partitions can share; two numbers a partition)
give every row its place in its group. A task then builds all complete aligned subtrees that lie in its rows; a node
whose run of siblings is not wholly there is ragged: at most ``2 * (arity - 1)`` on each level of each of the two groups at a partition's ends.
Ragged nodes are shuffled by their coordinate (group, level, place of the parent), level by level, which
finishes the upper levels. The roots of groups are the leaves of one more tree, built in the same way.
Each task then gets back the runs of siblings above its ragged nodes and the paths of its groups, so it can return proofs.

A leaf is the SHA-256 (lowercase hex) of its fields one after another, each ``-`` if null, else its number of UTF-8 bytes, ``:`` and the
value. While a level has more than one node, every ``arity`` consecutive ones (the last run may be shorter, even one) become
the SHA-256 of their hex digests. A proof is the run of siblings of each level, left and right of the node.

Defined cases: nulls are fields like any other; a null group comes first and is not the empty group; rows without an id come
first in their group; rows that repeat an id are ordered by their leaf, and equal rows have equal leaves, so their
order does not matter: each has a proof of its own, and a column of row numbers deals out any number of them; an empty table
has no rows and no root; a group of one row is its own root, and one group's root is the whole; texts of any length are
hashed whole; extra columns, whatever their names, take no part.
"""

from __future__ import annotations

import functools
import hashlib
import itertools
from collections.abc import Callable, Iterator
from typing import Any

from pyspark import RDD
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import ascii_lower, need, shuffle_partitions, written

ARITY = 8
#: Rows of one record on their way to the task that proves them.
CHUNK = 2000
NODE_SCHEMA = "part int, g string, level int, at long, n long, digest string"
SEGMENT = -1

#: The runs of siblings from a node up to the root: those left of it and those right of it, level by level.
Path = list[tuple[list[str], list[str]]]


def digest_of(digests: list[str]) -> str:
    return hashlib.sha256("".join(digests).encode()).hexdigest()


def fold(digest: str, path: Path) -> str:
    """The root that follows from a leaf and its proof."""
    for left, right in path:
        digest = digest_of([*left, digest, *right])
    return digest


def proof_digest(path: Path) -> str:
    return digest_of([d for left, right in path for d in (*left, *right)])


def field(column: Column) -> Column:
    value = column.cast("string")
    return F.coalesce(F.concat(F.octet_length(value).cast("string"), F.lit(":"), value), F.lit("-"))


def leaf(*columns: Column) -> Column:
    return F.sha2(F.concat(*map(field, columns)), 256)


class Segment:
    """The nodes of one group that follow from the consecutive leaves ``start ...`` of ``total``."""

    def __init__(self, leaves: list[str], start: int, total: int, arity: int) -> None:
        self.arity, self.levels = arity, [(start, leaves, total)]
        while True:
            a, nodes, n = self.levels[-1]
            first, last = self._parents(a, nodes, n)
            if n == 1 or last <= first:
                break
            up = [digest_of(nodes[max(p * arity - a, 0) : (p + 1) * arity - a]) for p in range(first, last)]
            self.levels.append((first, up, -(-n // arity)))

    def _parents(self, a: int, nodes: list[str], n: int) -> tuple[int, int]:
        """The range of parents all of whose children are here."""
        end = a + len(nodes)
        return -(-a // self.arity), -(-n // self.arity) if end == n else end // self.arity

    def root(self) -> str | None:
        _, nodes, n = self.levels[-1]
        return nodes[0] if n == 1 and nodes else None

    def ragged(self) -> Iterator[tuple[int, int, int, str]]:
        """(level, place, nodes of the level, digest) of nodes whose parent is not here."""
        for level, (a, nodes, n) in enumerate(self.levels):
            if n > 1:
                first, last = self._parents(a, nodes, n)
                here = range(first * self.arity, last * self.arity)
                yield from ((level, a + k, n, d) for k, d in enumerate(nodes) if a + k not in here)

    def run(self, level: int, parent: int) -> list[str] | None:
        """The children on this level of a parent that is here."""
        if level >= len(self.levels):
            return None
        a, nodes, n = self.levels[level]
        first, last = self._parents(a, nodes, n)
        return nodes[parent * self.arity - a : (parent + 1) * self.arity - a] if first <= parent < last else None


def ancestors(level: int, at: int, n: int, arity: int) -> Iterator[tuple[int, int]]:
    """(level of the children, place of the parent) of every run from a node up to its group's root."""
    while n > 1:
        at, n = at // arity, -(-n // arity)
        yield level, at
        level += 1


def _ends(part: int, rows: Iterator[tuple]) -> Iterator[tuple]:
    """(part, first group, its rows, last group, its rows) of a partition that has rows."""
    first = last = None
    for g, group in itertools.groupby(rows, key=lambda r: r[0]):
        last = (g, sum(1 for _ in group))
        first = first or last
    if first:
        yield part, *first, *last


def _places(ends: list[tuple]) -> dict[int, tuple[int, int, int]]:
    """By partition: rows of its first group in earlier partitions, and all rows of its first and of its last group."""
    ends = sorted(ends)
    before, totals, seen = {}, {}, {}
    for part, g, n, h, m in ends:
        before[part] = seen.get(g, 0)
        totals[g] = totals.get(g, 0) + n
        if h != g:
            totals[h] = totals.get(h, 0) + m
        seen = {h: m if h != g else before[part] + n}
    return {part: (before[part], totals[g], totals[h]) for part, g, _, h, _ in ends}


def _segments(part: int, rows: Iterator[tuple], places: dict, arity: int) -> Iterator[tuple[str, list[tuple], Segment]]:
    """Each group of a partition's rows (group, digest, payload), with its rows and its nodes."""
    before, first_total, last_total = places[part]
    groups = itertools.groupby(rows, key=lambda r: r[0])
    at_first, now = True, next(((g, list(rs)) for g, rs in groups), None)
    while now:
        g, held = now
        now = next(((h, list(rs)) for h, rs in groups), None)
        total = first_total if at_first else len(held) if now else last_total
        yield g, held, Segment([r[1] for r in held], before if at_first else 0, total, arity)
        at_first = False


def _nodes(part: int, rows: Iterator[tuple], places, arity: int) -> Iterator[tuple]:
    """What a partition tells the others: one row for each of its groups (with its root, if all of it is here), and its ragged nodes."""
    for g, held, segment in _segments(part, rows, places.value, arity) if part in places.value else ():
        start, _, total = segment.levels[0]
        yield part, g, SEGMENT, start, total, segment.root()
        yield from ((part, g, level, at, n, d) for level, at, n, d in segment.ragged())


def _upper(nodes: RDD, levels: int, arity: int, tasks: int) -> tuple[RDD, RDD]:
    """Runs of siblings, by (group, level, parent), that ragged nodes form, and the roots of the groups that they belong to."""
    sc = nodes.context
    runs, roots, below = [], [], sc.emptyRDD()
    for level in range(levels + 1):
        here = nodes.filter(lambda r, level=level: r[2] == level).map(lambda r: (r[1], r[3], r[4], r[5])).union(below)
        roots.append(here.filter(lambda r: r[2] == 1).map(lambda r: (r[0], r[3])))
        if level == levels:
            break
        dealt = here.filter(lambda r: r[2] > 1).map(lambda r, level=level: ((r[0], level, r[1] // arity), (r[1], r[3], r[2])))
        run = dealt.groupByKey(tasks).mapValues(sorted)  # at most `arity` children
        runs.append(run.mapValues(lambda kids: [k[1] for k in kids]))
        below = run.map(lambda kv: (kv[0][0], kv[0][2], -(-kv[1][0][2] // arity), digest_of([k[1] for k in kv[1]])))
    return sc.union(runs) if runs else sc.emptyRDD(), sc.union(roots)


def _chunks(part: int, rows: Iterator[tuple]) -> Iterator[tuple]:
    for seq in itertools.count():
        if not (some := list(itertools.islice(rows, CHUNK))):
            return
        yield part, (0, seq, some)


def _prove(items: Iterator[tuple], places, arity: int, emit: Callable) -> Iterator[tuple]:
    """Proofs of one partition's rows from its chunks (0), the runs above its ragged nodes (1), and its groups' values (2)."""
    by_part: dict[int, tuple[list, dict, dict]] = {}
    for part, (kind, key, value) in items:
        chunks, runs, values = by_part.setdefault(part, ([], {}, {}))
        if kind == 0:
            chunks.append((key, value))
        else:
            (runs if kind == 1 else values)[key] = value
    for part, (chunks, runs, values) in by_part.items():
        rows = (r for _, some in sorted(chunks, key=lambda c: c[0]) for r in some)
        for g, held, segment in _segments(part, rows, places.value, arity):
            start, _, total = segment.levels[0]

            @functools.cache
            def above(level: int, at: int, n: int, g=g, segment=segment) -> tuple:
                """Runs of siblings from a node to the root of its group, as nested pairs that neighbours share."""
                if n == 1:
                    return ()
                parent = at // arity
                run = segment.run(level, parent) or runs[g, level, parent]
                k = at - parent * arity
                return (run[:k], run[k + 1 :]), above(level + 1, parent, -(-n // arity))

            for k, (_, digest, payload) in enumerate(held):
                path, nested = [], above(0, start + k, total)
                while nested:
                    path.append(nested[0])
                    nested = nested[1]
                yield emit(g, digest, payload, path, values.get(g))


def prove(spark: SparkSession, rows: RDD, emit: Callable, arity: int = ARITY, attach: Callable[[RDD], RDD] | None = None) -> RDD:
    """``emit(group, digest, payload, path, value)`` of each row (group, digest, payload) of a range-sorted RDD.

    ``path`` leads to the group's root. ``attach`` turns all (group, root) into (group, value), given to ``emit`` with each row.
    """
    sc, parts = rows.context, max(1, rows.getNumPartitions())
    found = _places(rows.mapPartitionsWithIndex(_ends).collect())  # one row a partition
    places = sc.broadcast(found)
    longest, levels = max((max(p[1:]) for p in found.values()), default=1), 0
    while arity**levels < longest:
        levels += 1
    told = written(spark.createDataFrame(rows.mapPartitionsWithIndex(lambda p, it: _nodes(p, it, places, arity)), NODE_SCHEMA, verifySchema=False), "merkle-nodes").rdd.map(tuple)
    segments = told.filter(lambda r: r[2] == SEGMENT)
    runs, roots = _upper(told.filter(lambda r: r[2] != SEGMENT), levels, arity, min(parts, shuffle_partitions(spark)))
    asked = told.filter(lambda r: r[2] != SEGMENT).flatMap(lambda r: [((r[1], level, parent), r[0]) for level, parent in ancestors(r[2], r[3], r[4], arity)]).distinct()
    dealt = rows.mapPartitionsWithIndex(_chunks).union(asked.join(runs).map(lambda kv: (kv[1][0], (1, kv[0], kv[1][1]))))
    if attach:
        values = attach(segments.filter(lambda r: r[5] is not None).map(lambda r: (r[1], r[5])).union(roots))
        dealt = dealt.union(segments.map(lambda r: (r[1], r[0])).join(values).map(lambda kv: (kv[1][0], (2, kv[0], kv[1][1]))))
    return dealt.partitionBy(parts, lambda p: p).mapPartitions(lambda it: _prove(it, places, arity, emit))


def range_sorted(df: DataFrame, *by: str) -> RDD:
    return df.repartitionByRange(shuffle_partitions(df.sparkSession), *by).sortWithinPartitions(*by).rdd


def manifest(docs: DataFrame, columns: list[str], group_col: str, id_col: str, emit: Callable, schema: str, changed: Column | None = None, arity: int = ARITY) -> DataFrame:
    """``emit(id, leaf, changed leaf, subroot, root, path)`` of every row as a table; ``path`` leads from the leaf to the root of all groups.

    ``changed`` is a column of a further digest that goes with each row, such as the leaf of an altered copy.
    """
    need(docs, *columns, group_col, id_col)
    spark = docs.sparkSession
    # a null group sorts before the empty one
    g = F.coalesce(F.concat(F.lit("="), F.col(group_col).cast("string")), F.lit(""))
    rows = docs.select(g.alias("g"), F.col(id_col).alias("id"), leaf(*map(F.col, columns)).alias("leaf"), (F.lit(None).cast("string") if changed is None else changed).alias("changed"), F.monotonically_increasing_id().alias("nth"))
    rows = written(rows, "merkle-leaves")

    def groups(roots: RDD) -> RDD:
        subroots = written(spark.createDataFrame(roots, "g string, digest string", verifySchema=False), "merkle-roots")
        top = range_sorted(subroots, "g").map(lambda r: ("", r["digest"], r["g"]))
        return prove(spark, top, lambda _, digest, g, path, __: (g, (path, digest, fold(digest, path))), arity)

    def one(_, digest: str, payload: tuple, path: Path, value: Any) -> tuple:
        up, subroot, root = value
        return emit(payload[0], digest, payload[1], subroot, root, path + up)

    ordered = range_sorted(rows, "g", "id", "leaf", "nth").map(lambda r: (r["g"], r["leaf"], (r["id"], r["changed"])))
    return spark.createDataFrame(prove(spark, ordered, one, arity, groups), schema, verifySchema=False)


def proofs(docs: DataFrame, columns: list[str], group_col: str, id_col: str, arity: int = ARITY) -> DataFrame:
    """(id, leaf, subroot, root, siblings): a row's whole proof, the digests left and right of its node on every level; :func:`fold` checks it."""
    kind = docs.schema[id_col].dataType.simpleString()
    schema = f"id {kind}, leaf string, subroot string, root string, siblings array<struct<left: array<string>, right: array<string>>>"
    return manifest(docs, columns, group_col, id_col, lambda i, leaf_, _, subroot, root, path: (i, leaf_, subroot, root, path), schema, arity=arity)


#: The fields of a document's leaf, in their fixed order.
COLUMNS = ["doc_id", "source", "lang", "n_chars", "text"]


def _checked(i, leaf_: str, changed: str | None, subroot: str, root: str, path: Path) -> tuple:
    folded = fold(leaf_ if changed is None else changed, path)
    return i, leaf_, subroot, root, proof_digest(path), folded, folded == root


def op13_merkle_manifest(spark, sf_dir: str) -> DataFrame:
    from .common import table

    docs = table(spark, sf_dir, "documents").select(*COLUMNS)
    tampered = leaf(*(ascii_lower(F.col(c)) if c == "text" else F.col(c) for c in COLUMNS))
    changed = F.when(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 3 == 0, tampered)
    schema = f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, leaf string, subroot string, root string, proof_sha256 string, folded_root string, verified boolean"
    return manifest(docs, COLUMNS, "lang", "doc_id", _checked, schema, changed)
