"""The filter audit and the Merkle manifest against brute force on whole small tables and on odd rows."""

import hashlib
import itertools
import random
import re
import zlib
from collections import Counter, defaultdict

import duckdb
import pytest

from seriesloom.llm import filter_audit, merkle

DIR = "/root/testdata/sf0.001"
LABELS = "doc_id long, quality int, toxic int"

# ---- op12 --------------------------------------------------------------------------------------------------------


def fails(text, same_before):
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    hit = [len(words) < 200, 100 * len(set(words)) < 50 * len(words), 100 * sum("A" <= c <= "Z" for c in text) > 3 * len(text), bool(re.search(r"[#$%&*|]", text)), same_before]
    return {x for x, h in zip("ABCDE", hit, strict=True) if h}


def brute_audit(docs, labels):
    """docs: (id, text, part); every order applied to every document, one filter after another."""
    least, good, toxic = {}, set(), set()
    for i, q, t in labels:
        if i is not None:
            good |= {i} if q == 1 else set()
            toxic |= {i} if t == 1 else set()
    for i, t, _ in docs:
        if i is not None:
            least[t or ""] = min(least.get(t or "", i), i)
    parts = defaultdict(list)
    for i, t, p in docs:
        parts[p or ""].append((fails(t or "", i is not None and least[t or ""] < i), i in good, i in toxic))
    out = {}
    for part, rows in parts.items():
        shapley = Counter()
        for order in map("".join, itertools.permutations("ABCDE")):
            left = rows
            for step, x in enumerate(order, 1):
                gone = [r for r in left if x in r[0]]
                left = [r for r in left if x not in r[0]]
                failing = [r for r in rows if x in r[0]]
                shapley[x] += len(gone)
                out[part, order, step] = [len(left), len(gone), len(failing) - len(gone), sum(r[0] == {x} for r in rows), sum(r[1] for r in gone), sum(r[2] for r in gone)]
        for (p, order, step), row in out.items():
            if p == part:
                row.append(shapley[order[step - 1]])
    return {k: tuple(v) for k, v in out.items()}


def audited(df):
    return {(r.part, r.filter_order, r.step): (r.kept, r.removed, r.redundant, r.unique_fails, r.good_lost, r.toxic_lost, r.shapley) for r in df.collect()}


def test_audit_query(spark):
    got = audited(filter_audit.op12_filter_audit(spark, DIR))
    read = lambda t: duckdb.sql(f"SELECT * FROM read_parquet('{DIR}/{t}.parquet')")
    docs, labels = read("documents").select("doc_id, text, lang").fetchall(), read("labels").select("doc_id, quality, toxic").fetchall()
    assert got == brute_audit(docs, labels)
    for t in ("documents", "labels"):
        read(t).create_view(t)
    rows = duckdb.sql(filter_audit.OP12_SQL).fetchall()
    assert {(r[0], r[1], r[2]): tuple(r[3:]) for r in rows} == got


def test_audit_odd_rows(spark, documents, odd_rows):
    rows = [*odd_rows, *((100 + k, "Same TEXT | here") for k in range(50)), (100, "Same TEXT | here"), *((None, "Same TEXT | here") for _ in range(30)), (8, "word " * 300), (9, " ".join(f"w{k}" for k in range(250)))]
    labels = [(1, 1, 0), (5, 1, 1), (6, None, 1), (None, 1, 1), (100, 1, 0), (100, 0, 1), (999, 1, 1), (101, 0, 1), (4, 1, None)]
    docs = documents(rows)
    counts = filter_audit.mask_counts(docs, spark.createDataFrame(labels, LABELS))
    assert audited(filter_audit.audit(counts)) == brute_audit([(i, t, "en") for i, t in rows], labels)
    assert filter_audit.audit(filter_audit.mask_counts(documents([]), spark.createDataFrame([], LABELS))).count() == 0
    mixed = [(i, t, random.Random(k).choice([None, "", "de"])) for k, (i, t) in enumerate(rows)]
    odd = spark.createDataFrame([(i, t, p, 1, "x") for i, t, p in mixed], "doc_id long, text string, lang string, part int, same string")
    assert audited(filter_audit.audit(filter_audit.mask_counts(odd, spark.createDataFrame(labels, LABELS)))) == brute_audit(mixed, labels)


def test_polynomial():
    counts = {m: m * m + 1 for m in range(8)}
    poly = filter_audit.RemovalPolynomial(counts, 3)
    assert all(poly.at(s) == sum(n for m, n in counts.items() if m & s) for s in range(8))
    assert [poly.shapley(i) for i in range(3)] == [sum(filter_audit.Fraction(n, m.bit_count()) for m, n in counts.items() if m >> i & 1) for i in range(3)]


# ---- op13 --------------------------------------------------------------------------------------------------------

sha = lambda s: hashlib.sha256(s.encode()).hexdigest()


def brute_leaf(row):
    return sha("".join("-" if v is None else f"{len(str(v).encode())}:{v}" for v in row))


def brute_tree(leaves, arity):
    """The root, and for each leaf the runs of its siblings."""
    paths, at, level = [[] for _ in leaves], list(range(len(leaves))), leaves
    while len(level) > 1:
        runs = [level[k : k + arity] for k in range(0, len(level), arity)]
        for k, place in enumerate(at):
            run = runs[place // arity]
            paths[k].append((run[: place % arity], run[place % arity + 1 :]))
            at[k] = place // arity
        level = [sha("".join(r)) for r in runs]
    return level[0], paths


def brute_manifest(rows, arity=8):
    """rows: (doc_id, source, lang, n_chars, text); a multiset of what the query returns."""
    groups = defaultdict(list)
    for r in rows:
        groups[r[2]].append(r)
    order = sorted(groups, key=lambda g: (g is not None, (g or "").encode()))
    trees = {}
    for g in order:
        held = sorted(groups[g], key=lambda r: (r[0] is not None, r[0] or 0, brute_leaf(r)))
        trees[g] = held, *brute_tree([brute_leaf(r) for r in held], arity)
    root, tops = brute_tree([trees[g][1] for g in order], arity) if order else (None, [])
    out = Counter()
    for g, top in zip(order, tops, strict=True):
        held, subroot, paths = trees[g]
        for r, path in zip(held, paths, strict=True):
            i, source, lang, n, text = r
            low = None if text is None else "".join(c.lower() if "A" <= c <= "Z" else c for c in text)
            leaf = brute_leaf((i, source, lang, n, low)) if i is not None and zlib.crc32(str(i).encode()) % 3 == 0 else brute_leaf(r)
            for left, right in path + top:
                leaf = sha("".join([*left, leaf, *right]))
            out[i, brute_leaf(r), subroot, root, sha("".join(d for left, right in path + top for d in (*left, *right))), leaf, leaf == root] += 1
    return out


def test_manifest_query(spark):
    got = Counter(map(tuple, merkle.op13_merkle_manifest(spark, DIR).collect()))
    rows = duckdb.sql(f"SELECT doc_id, source, lang, n_chars, text FROM read_parquet('{DIR}/documents.parquet')").fetchall()
    assert got == brute_manifest(rows) and len({r[6] for r in got}) == 2


DOCS = "doc_id long, source string, lang string, n_chars long, text string, g string, leaf int"


def checked(docs, arity):
    changed = merkle.F.when(merkle.F.crc32(docs["doc_id"].cast("string").cast("binary")) % 3 == 0, merkle.leaf(*(merkle.ascii_lower(docs[c]) if c == "text" else docs[c] for c in merkle.COLUMNS)))
    schema = "doc_id long, leaf string, subroot string, root string, proof_sha256 string, folded_root string, verified boolean"
    return Counter(map(tuple, merkle.manifest(docs, merkle.COLUMNS, "lang", "doc_id", merkle._checked, schema, changed, arity).collect()))


@pytest.mark.parametrize(("arity", "parts"), [(8, 4), (2, 7), (3, 23)])
def test_manifest_of_ragged_groups(spark, arity, parts):
    """Groups of all small sizes, one over many partitions, one of equal rows, nulls, and partitions of several groups."""
    rng = random.Random(3)
    rows = [(k, "s", f"l{g:02d}", k, f"Text {k}") for g in range(12) for k in range(g * 100, g * 100 + g)]
    rows += [(k, None, None, None, None if k % 5 == 0 else "Null lang") for k in range(9000, 9070)] + [(7, "s", "same", 1, "Equal ROW")] * 200 + [(None, "s", "", 3, "No id"), (None, "s", "", 3, "No id"), (None, "t", "", 3, "")]
    rows += [(k, "é", "zz", k, "Ü" * (k % 7)) for k in range(5000, 5400)]
    rng.shuffle(rows)
    docs = spark.createDataFrame([(*r, "x", 1) for r in rows], DOCS)
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", str(parts))
    try:
        assert checked(docs, arity) == brute_manifest(rows, arity)
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)


def test_manifest_of_few_rows(spark):
    assert checked(spark.createDataFrame([], DOCS), 8) == Counter()
    one = [(3, "s", "en", 4, "Only")]
    assert checked(spark.createDataFrame([(*one[0], "x", 1)], DOCS), 8) == brute_manifest(one)


def test_proofs_verify(spark):
    docs = spark.read.parquet(f"{DIR}/documents.parquet")
    rows = merkle.proofs(docs, merkle.COLUMNS, "lang", "doc_id").collect()
    assert len(rows) == docs.count()
    assert all(merkle.fold(r.leaf, r.siblings) == r.root and merkle.fold("0" * 64, r.siblings) != r.root for r in rows)
