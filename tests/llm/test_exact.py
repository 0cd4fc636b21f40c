"""Operators with exact contracts, against brute force and libraries on whole small tables and on odd rows."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pytest
import tiktoken
import xxhash
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from seriesloom.llm import byte_bpe, line_dedup, packing, pii, registry, simhash, suffix_dedup, topk, url_filter
from seriesloom.llm.common import components, semi_join_counted

sha = lambda b: hashlib.sha256(b).hexdigest()


# ---- op1 ---------------------------------------------------------------------------------------------------------


def brute_topk(rows, k, every):
    ints = [(i, np.floor(np.array(v, float) * 256).astype(int)) for i, v in rows if i is not None and v is not None and len(v) and all(x is not None and np.isfinite(x) for x in v)]
    out = set()
    for q, a in ints:
        if q % every == 0:
            best = sorted((-int(a @ b), j) for j, b in ints if j != q)[:k]
            out |= {(q, n + 1, j, -s) for n, (s, j) in enumerate(best)}
    return out


def test_topk(spark):
    rng = np.random.default_rng(0)
    rows = [(i, rng.normal(size=16).round(2).tolist()) for i in range(400)] + [(i, [0.5] * 16) for i in range(400, 420)] + [(500, None), (550, [float("nan")] + [1.0] * 15), (600, [None] + [1.0] * 15), (650, []), (None, [1.0] * 16), (700, [float("inf")] * 16)]
    df = spark.createDataFrame([(i, v, "x") for i, v in rows], "vec_id long, embedding array<float>, lane string")
    rows = [(r.vec_id, r.embedding) for r in df.collect()]
    got = topk.top_k(df, df.where("vec_id % 10 = 0"), k=5)
    assert {(r.query_id, r.rank, r.vec_id, r.score) for r in got.collect()} == brute_topk(rows, 5, 10)
    assert dict(got.dtypes) == {"query_id": "bigint", "rank": "int", "vec_id": "bigint", "score": "bigint"}
    small = topk.top_k(df, df.where("vec_id % 10 = 0"), k=5, group_rows=50)
    assert {(r.query_id, r.rank, r.vec_id, r.score) for r in small.collect()} == brute_topk(rows, 5, 10)
    few = df.where("vec_id < 3")
    assert topk.top_k(few, few.where("vec_id = 0")).count() == 2
    assert topk.top_k(df.limit(0), df.limit(0)).count() == 0


@pytest.mark.parametrize("gates", [4, 1024])
def test_long_vectors_shut_groups_out(spark, monkeypatch, gates):
    """Lengths over three decades, with ties and zero vectors: most groups can't reach, and none that can is passed over."""
    monkeypatch.setattr(topk, "GATES", gates)
    monkeypatch.setattr(topk, "QUERY_BLOCKS", 3)
    monkeypatch.setattr(topk, "QUERIES_PER_BLOCK", 8)
    rng = np.random.default_rng(1)
    rows = [(i, (rng.normal(size=8) * 10 ** rng.uniform(-2, 1)).round(2).tolist()) for i in range(600)] + [(i, [0.0] * 8) for i in range(600, 640)] + [(i, [1.0] + [0.0] * 7) for i in range(640, 700)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    seen = []
    meet = topk._meet
    monkeypatch.setattr(topk, "_meet", lambda q, c, *a: seen.append((q.count(), c.select("g").distinct().count())) or meet(q, c, *a))
    got = topk.top_k(df, df.where("vec_id % 3 = 0"), k=4, group_rows=40)
    assert {(r.query_id, r.rank, r.vec_id, r.score) for r in got.collect()} == brute_topk([(r.vec_id, r.embedding) for r in df.collect()], 4, 3)
    sent, groups = seen[1]
    assert sent < 0.7 * seen[0][0] * groups


# ---- op3 ---------------------------------------------------------------------------------------------------------


def brute_simhash(text, width):
    text = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    w = re.findall(r"[^\x20\x09-\x0D]+", text)
    parts = [" ".join(w[i : i + width]) for i in range(len(w) - width + 1)] or ([" ".join(w)] if w else [])
    hashes = [xxhash.xxh64_intdigest(p.encode(), 42) for p in parts]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def brute_groups(fps, radius):
    root = list(range(len(fps)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(fps)):
        for j in range(i):
            if (fps[i] ^ fps[j]).bit_count() <= radius:
                a, b = find(i), find(j)
                root[max(a, b)] = min(a, b)
    return [find(i) for i in range(len(fps))]


def test_simhash_query(spark, corpus):
    fps = [brute_simhash(t, 3) for t in corpus.text]
    roots = brute_groups(fps, 2)
    got = {(r.doc_id, r.fingerprint, r.component_id) for r in simhash.op3_simhash(spark, "/root/testdata/sf0.001").collect()}
    assert got == {(int(i), f"{f:016x}", int(corpus.doc_id[r])) for i, f, r in zip(corpus.doc_id, fps, roots, strict=True)}


@pytest.mark.parametrize("shard_rows", [4096, 3])
def test_links_of_dense_fingerprints(spark, shard_rows):
    rng = random.Random(4)
    base = [rng.getrandbits(64) for _ in range(6)] + [1 << 63, 0]
    fps = sorted({b ^ sum(1 << rng.randrange(64) for _ in range(rng.randrange(4))) % (1 << 64) for b in base for _ in range(12)})
    signed = [(f - (1 << 64) if f >> 63 else f,) for f in fps]
    links = simhash.near_links(spark.createDataFrame(signed, "fp long"), 2, shard_rows)
    found = {r.node % (1 << 64): r.root % (1 << 64) for r in components(links).collect()}
    want = defaultdict(set)
    for f, r in zip(fps, brute_groups(fps, 2), strict=True):
        want[r].add(f)
    got = defaultdict(set)
    for f in fps:
        got[found.get(f, f)].add(f)
    assert sorted(map(sorted, got.values())) == sorted(map(sorted, want.values()))


def test_simhash_odd_rows(spark, documents, odd_rows):
    got = simhash.groups(documents(odd_rows)).collect()
    assert len(got) == len(odd_rows)
    assert {r.component_id for r in got if r.fp == 0} == {1}
    assert {r.component_id for r in got if r.doc_id in (5, 6)} == {5}
    assert simhash.groups(documents([])).count() == 0


@given(st.lists(st.integers(0, 255), max_size=40, unique=True), st.integers(0, 255), st.integers(0, 4))
@settings(max_examples=50, deadline=None)
def test_bk_tree(values, query, radius):
    tree = simhash.BKTree()
    for v in values:
        tree.add(v)
    assert sorted(values[j] for _, j in tree.near(query, radius)) == sorted(v for v in values if (v ^ query).bit_count() <= radius)


def test_near_dedup_keeps_one(spark, documents):
    base = " ".join(f"w{i}" for i in range(120))
    rows = [(10, base), (11, base + " tail"), (12, base.replace("w60", "other")), (13, "something else entirely with other words"), (14, ""), (15, None), (None, base), (16, base), (16, base)]
    got = simhash.near_dedup(documents(rows))
    assert sorted(r.doc_id for r in got.collect()) == [10, 13, 14]
    assert got.columns == documents(rows).columns
    alone = simhash.near_dedup(documents([(None, base), (None, base), (1, "x")])).collect()
    assert sorted(str(r.doc_id) for r in alone) == ["1", "None"]


def test_tables_on_the_way_are_deleted(spark):
    from seriesloom.llm import common

    before = list(common._written)
    out = common.only(lambda: common.written(spark.range(5), "inner").join(common.written(spark.range(3), "other"), "id"), "outer")
    assert out.count() == 3 and len(common._written) == len(before) + 1
    common.forget(out)
    assert common._written == before


def test_hot_keys_of_a_semi_join_stay(spark):
    """Rows of hot, rare and unknown keys against a plain semi-join, repeated rows included."""
    values = [0] * 400 + [1] * 90 + list(range(2, 200)) + [5, 7, 7, None]
    rows = spark.createDataFrame([(v, k % 50) for k, v in enumerate(values)], "k long, x long")
    keys = rows.where("k is not null and k % 3 <> 2").groupBy("k").agg(F.count("*").alias("n"))
    got = sorted(tuple(r) for r in semi_join_counted(rows, keys, ["k"]).collect())
    assert got == sorted(tuple(r) for r in rows.join(keys, "k", "left_semi").collect())
    assert semi_join_counted(rows, keys.limit(0), ["k"]).count() == 0


def test_components(spark):
    rng = random.Random(1)
    edges = [(i, i + 1) for i in range(60)] + [(100, 200 + i) for i in range(50)] + [(rng.randrange(1000, 1100), rng.randrange(1000, 1100)) for _ in range(40)] + [(5, 5)]
    got = {r.node: r.root for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    root = {}

    def find(x):
        root.setdefault(x, x)
        while root[x] != x:
            x = root[x]
        return x

    for a, b in edges:
        if a != b:
            a, b = find(a), find(b)
            root[max(a, b)] = min(a, b)
    assert got == {x: find(x) for x in root}


# ---- op5 ---------------------------------------------------------------------------------------------------------

BASE = {"email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]"}


def brute_luhn(d):
    return sum((2 * int(c) - 9 if int(c) > 4 else 2 * int(c)) if i % 2 else int(c) for i, c in enumerate(reversed(d))) % 10 == 0


def brute_base(text):
    out = []
    for kind, pattern in BASE.items():
        for m in re.finditer(pattern, text):
            d = re.sub("[^0-9]", "", m[0])
            if kind == "email" or kind == "ip" and all(int(p) <= 255 for p in m[0].split(".")) or kind == "card" and 16 <= len(d) <= 19 and brute_luhn(d) or kind == "phone" and 8 <= len(d) <= 15:
                out.append((kind, m.start(), m.end()))
    return out


def of_module(text):
    found = pii.base_matches(text)
    return [(k, a, b) for k in pii.KINDS for a, b, ok in found[k] if ok]


@given(st.text(alphabet="ab@.-+ ()019%é\n", max_size=60))
@settings(max_examples=600, deadline=None)
def test_base_patterns(text):
    assert of_module(text) == brute_base(text)


def test_base_patterns_in_composed_texts():
    rng = random.Random(2)
    bits = ["a.b@c.de", "x@y", "10.0.0.1", "300.1.1.1", "4111111111111111", "4111 1111 1111 1111", "+1 (555) 555-1234", "+12345678", " ", "  ", ".", "-", "word", "@", "1.2.3.4.5", "+", "0" * 25, "é", ",", "\n"]
    for _ in range(4000):
        text = "".join(rng.choice(bits) for _ in range(rng.randrange(9)))
        assert of_module(text) == brute_base(text), text


def test_pii_query_and_added_spans(spark, documents):
    rows = [(1, "call +1 (578) 555-6437 4111111111111111 now"), (2, "nothing here 12 of 300"), (3, None), (4, "mail a.b@c.com and 10.0.0.1, card 4111 1111 1111 1111")]
    rows += [(10 + i, f"see u{i}@mail.com or 10.1.2.{i} or +1 (555) 555-12{i:02d}. paid 4111111111111111, ok") for i in range(40)]
    got = {r.doc_id: r.spans for r in pii.find_spans(documents(rows).select("doc_id", "text", "extra")).collect()}
    assert got[2] == [] and got[3] == []
    texts = dict(rows)
    kinds = [(pii.KINDS[s.kind], texts[1][s.start : s.end]) for s in got[1]]
    assert ("phone", "+1 (578) 555-6437") in kinds and ("card", "4111111111111111") in kinds
    hidden = {r.doc_id: r.text for r in pii.hide_spans(documents(rows)).collect()}
    assert hidden[3] is None and hidden[4] == "mail <EMAIL> and <IP>, card <CARD>" and hidden[2] == texts[2]
    assert pii.find_spans(documents([])).count() == 0


def test_pii_table(spark, corpus):
    got = {r.doc_id: r for r in pii.op5_pii(spark, "/root/testdata/sf0.001").collect()}
    for i, t in zip(corpus.doc_id, corpus.text, strict=True):
        base = ["%s:%d:%d" % x for x in brute_base(t)]
        assert got[i].base_sha256 == sha(",".join(base).encode())
        assert set(base) <= set(got[i].spans.split(",")) or not base
        assert (got[i].n_email, got[i].n_ip, got[i].n_card, got[i].n_phone) == tuple(sum(b.startswith(k) for b in base) for k in pii.KINDS)


def test_reliabilities_find_the_liar():
    rng = np.random.default_rng(0)
    truth = rng.random(20_000) < 0.5
    votes = np.stack([np.where(rng.random(20_000) < p, truth, ~truth) * 2 for p in (0.95, 0.9, 0.9, 0.5, 0.85)], axis=1)
    codes = (votes * 3 ** np.arange(5)).sum(axis=1)
    counts = np.zeros((4, 243))
    np.add.at(counts[1], codes, 1)
    post, table = pii.reliabilities(counts)
    assert ((post[1][codes] > 0.5) == truth).mean() > 0.97
    assert abs(table[1, 1, 3, 2] - 0.5) < 0.05 and table[1, 1, 0, 2] > 0.9


# ---- op6 and op10 ------------------------------------------------------------------------------------------------


def test_classifier_sees_more_than_votes():
    """Spans with equal votes but other shapes may be judged differently, and cells that don't occur are never taken."""
    counts = np.zeros((len(pii.KINDS), pii.SHAPES, pii.PATTERNS))
    yes, no, open_ = pii._code([1, 1, 1, 1, 1]), pii._code([-1, -1, -1, -1, -1]), pii._code([0, 1, 0, 0, 1])
    counts[3, 0, yes], counts[3, 5, no], counts[3, 0, open_], counts[3, 5, open_] = 500, 500, 40, 40
    said = pii.span_classifier(counts, pii.reliabilities(counts.sum(axis=1))[0])
    assert said[3, 0, yes] > 0.9 > said[3, 5, no] and said[3, 0, open_] > said[3, 5, open_] and said[0].max() == 0
    assert pii.span_classifier(counts * 0, pii.reliabilities(counts.sum(axis=1) * 0)[0]).max() == 0


def test_clashing_columns_are_replaced(spark, documents):
    rows = documents([(1, "a\nb"), (2, "call +49 30 1234567")])
    found = pii.find_spans(rows.withColumn("spans", F.lit("mine")))
    assert found.columns.count("spans") == 1 and dict(found.dtypes)["spans"].startswith("array")
    lines = line_dedup.line_dedup(rows.withColumns({"n_lines": F.lit("mine"), "kept_text": F.lit("mine"), "n_dropped": F.lit("mine")}))
    assert len(lines.columns) == len(set(lines.columns)) and dict(lines.dtypes)["n_lines"] == "bigint"


def test_packing_table(spark, corpus, documents, odd_rows):
    from tokenizers import Tokenizer

    path = public_tokenizers.path("word_bpe_49k.json")
    whole = Tokenizer.from_file(path)
    whole.encode_special_tokens = True
    rows = [(int(i), t) for i, t in zip(corpus.doc_id, corpus.text, strict=True)] + [(1000 + k, t) for k, (_, t) in enumerate(odd_rows)] + [(3000, "<|startoftext|> I'VE \x1c Ḁ̀ a²b ΑΣ. don't"), (3001, "x" * 20_000)]
    want = {}
    for i, t in rows:
        ids = np.array([*whole.encode(t or "", add_special_tokens=False).ids, 1], "<u4")
        for at in range(0, len(ids), 4096):
            want[i, at // 4096] = (at, len(ids[at : at + 4096]), zlib.crc32(ids[at : at + 4096].tobytes()))
    model = spark.sparkContext.broadcast(packing.WordTokenizer.from_file(path))
    got = packing.pack_documents(documents(rows), model, shard_pieces=100).toPandas()
    assert {(r.doc_id, r.piece): (r.start, r.length, r.ids_crc32) for r in got.itertuples()} == want
    for _, s in got.sort_values("offset").groupby("sequence_id"):
        assert s.length.sum() <= 4096 and (s.offset.to_numpy() == np.concatenate([[0], s.length.cumsum()[:-1]])).all()
    assert got.sequence_id.nunique() <= got.length.sum() / 4096 * 1.05 + 3
    assert packing.pack_documents(documents([]), model).count() == 0


@pytest.mark.parametrize("score", ["norm", "dot"])
def test_every_capacity_holds(score):
    rng = np.random.default_rng(1)
    lengths = -np.sort(-rng.integers(1, 320, 600))
    where, offset = packing.best_fit(lengths, 512, 4, 512.0**2 * 0.4, score=score)
    for b in np.unique(where):
        own = lengths[where == b]
        assert own.sum() <= 512 and len(own) <= 4 and (own**2).sum() <= 512.0**2 * 0.4
        assert sorted(offset[where == b]) == sorted(np.concatenate([[0], np.cumsum(own)[:-1]]))
    with pytest.raises(ValueError):
        packing.best_fit(np.array([600]), 512, 4, 1e9)


def test_rows_that_repeat_are_dealt_over_shards(spark):
    from seriesloom.llm.packing import pack

    rows = spark.createDataFrame([(7, 1500)] * 80 + [(8, 4096)] * 3, "doc_id long, length long").repartition(4)
    got = pack(rows, shard_pieces=20).toPandas()
    assert len(got) == 83 and list(got.columns) == ["doc_id", "length", "sequence_id", "offset"]
    part = got[got["length"] < 4096]
    assert part["sequence_id"].floordiv(1 << 40).nunique() > 1
    for _, one in got.groupby("sequence_id"):
        one = one.sort_values("offset")
        assert one["length"].sum() <= 4096 and one["offset"].tolist() == [0, *one["length"].cumsum().tolist()[:-1]]


def test_sequences_hold_the_ids(spark, documents):
    model = spark.sparkContext.broadcast(packing.WordTokenizer.from_file(public_tokenizers.path("word_bpe_49k.json")))
    coded = documents([(i, "a b c " * (i + 1)) for i in range(20)]).select("doc_id", packing.token_ids(model, F.col("text")).alias("ids"))
    packed = packing.pack(packing.pieces(coded, tokens=16), 16)
    rows, whole = packed.collect(), {r.sequence_id: r.ids for r in packing.sequences(packed).collect()}
    assert all(whole[r.sequence_id][4 * r.offset : 4 * (r.offset + r.length)] == r.piece_ids for r in rows)
    back = defaultdict(bytes)
    for r in sorted(rows, key=lambda r: (r.doc_id, r.piece)):
        back[r.doc_id] += bytes(r.piece_ids)
    assert back == {r.doc_id: bytes(r.ids) for r in coded.collect()}


@pytest.fixture(scope="module")
def bpe():
    return byte_bpe.ByteBpe.from_file(public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN)


def test_perfect_hash(bpe):
    keys = list(bpe.ranks)
    slots = bpe.table.slots(keys)
    assert sorted(slots.tolist()) == list(range(len(keys)))
    assert all(bpe.slot_bytes[s] == k for s, k in zip(slots, keys, strict=True))


@given(st.text(max_size=60))
@settings(max_examples=400, deadline=None)
def test_encodes_like_the_library(bpe, text):
    own = test_encodes_like_the_library
    if not hasattr(own, "library"):
        own.library = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=bpe.ranks, special_tokens={})
    (ids,) = bpe.encode([text])
    assert np.frombuffer(ids, "<u4").tolist() == own.library.encode_ordinary(text)
    assert bpe.decode(ids) == text.encode()


def test_bpe_query(spark, corpus, bpe):
    library = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=bpe.ranks, special_tokens={})
    want = set()
    for i, t in zip(corpus.doc_id, corpus.text, strict=True):
        ids = np.array(library.encode_ordinary(t), "<u4")
        want.add((int(i), len(ids), sha(ids.tobytes()), sha(t.encode())))
    got = byte_bpe.op10_byte_bpe(spark, "/root/testdata/sf0.001").collect()
    assert {tuple(r) for r in got} == want


def test_bpe_odd_rows(spark, documents, odd_rows, bpe):
    model = spark.sparkContext.broadcast(bpe)
    rows = documents(odd_rows).select("text", byte_bpe.encode(model, F.col("text")).alias("ids"))
    got = rows.select("text", "ids", byte_bpe.decode(model, F.col("ids")).alias("back"), byte_bpe.ids_array(F.col("ids")).alias("numbers")).collect()
    assert all(bytes(r.back) == (r.text or "").encode() and np.array(r.numbers, "<u4").tobytes() == bytes(r.ids) for r in got)


# ---- op7 ---------------------------------------------------------------------------------------------------------


def brute_url(url):
    rest = url.split("://", 1)[1] if url and "://" in url else ""
    host = re.match(r"[^/?#]*", rest)[0]
    path = re.match(r"[^?#]*", rest[len(host) :])[0]
    host = "".join(c.lower() if "A" <= c <= "Z" else c for c in host)
    best = None
    for says, text in url_filter.RULES:
        h, p = text.split("/", 1)
        if (host == h or host.endswith("." + h)) and path.startswith("/" + p) and (best is None or len(text) > len(best[1])):
            best = (says, text)
    return host, path, best


def test_urls(spark):
    urls = [None, "", "nothing", "http://", "https://A.Example.ORG/es/1?x#y", "http://example.org/en/12", "http://badexample.org/es/", "http://org", "http://x.com/fr/a", "http://x.com/de/a", "http://x.com/fr?/de/", "http://h#a://b/c", "s://u/p\nq/fr/", "http://net.com/frx", "http://example.org?x/es/"]
    urls += [f"http://cat{w}.com/{p}/{i}" for i, (w, p) in enumerate([("dog", "de"), ("sun", "fr")] * 30)]
    pages = spark.createDataFrame([(i, u, "<p>the cat and the dog in the sun</p><script>var x</script>", "c") for i, u in enumerate(urls)], "page_id long, url string, html string, host string")
    got = {r.page_id: r for r in url_filter.url_filter(pages).collect()}
    for i, u in enumerate(urls):
        host, path, rule = brute_url(u)
        assert (got[i].host, got[i].path, got[i].rule) == (host, path, rule and rule[1]), u
        assert got[i].verdict == rule[0] if rule else got[i].verdict in ("allow", "block")
    assert url_filter.url_filter(pages.limit(0)).count() == 0
    assert {r.verdict for r in url_filter.url_filter(pages, rules=[]).collect()} == {"allow"}


def test_rare_words_and_tokens_count(spark):
    """A host's word and a path's token that are rare among very many others are known all the same."""
    html = " ".join(f"{chr(97 + i % 26)}{chr(97 + i // 26 % 26)}{chr(97 + i // 676 % 26)}q" for i in range(60_000)) + " casino win" * 2
    rows = [(0, "http://casinowin.example.com/seldom", html), (500, "http://1/seldom", None), *((i, f"http://block.me/seldom/{chr(97 + i % 26)}", "") for i in range(1, 3)), *((i, "http://other.org/" + "/".join(f"t{i}x{k}" for k in range(1000)), "") for i in range(3, 160))]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string")
    words = url_filter.host_words(spark.createDataFrame([("casinowin.example.com",)], "host string"), url_filter.word_counts(pages)).first().words
    assert words[:2] == ["h:casino", "h:win"]
    got = {r.page_id: r for r in url_filter.url_filter(pages, rules=[("block", "me/"), ("allow", "org/")]).collect()}
    assert got[500].score > math.log(3 / 158) + 1


def test_url_query_is_brute_force(spark):
    """Word counts, segmentation, odds, scores and verdicts of the whole table, in plain Python."""
    pages = [(r.page_id, r.url, r.html) for r in spark.read.parquet("/root/testdata/sf0.001/pages.parquet").collect()]
    words = Counter()
    for _, _, html in pages:
        text = re.sub(r"(?s)<(?:script|style)\b.*?</(?:script|style)>|<[^>]*>", " ", html or "")
        words.update(w for w in re.split(r"[^a-z]+", text.lower()) if 0 < len(w) <= 24)
    total = sum(words.values())
    costs = {w: math.log(n / total) for w, n in words.items()}
    got = {r.page_id: r for r in url_filter.op7_url_filter(spark, "/root/testdata/sf0.001").collect()}

    def tokens(host, path):
        out = ["h:" + w for p in re.findall(r"[a-z]+|[0-9]+", host) for w in (url_filter.segment(p, costs) if p.isalpha() else [f"#{len(p)}"])]
        return out + [f"p:#{len(t)}" if t.isdecimal() else "p:" + t for t in re.findall(r"[^\W_]+", path.lower())]

    rows = [(i, tokens(r.host, r.path), r.rule, r.verdict) for i, r in got.items()]
    ruled = [(t, v) for _, t, rule, v in rows if rule]
    every, bad = Counter(x for t, _ in ruled for x in t), Counter(x for t, v in ruled if v == "block" for x in t)
    n, b, kinds = sum(every.values()), sum(bad.values()), len(every) + 1
    blocked = sum(v == "block" for _, v in ruled)
    prior = math.log((blocked + 1) / (len(ruled) - blocked + 1)) if ruled else 0.0
    odds = lambda x: math.log((bad[x] + 1) / (b + kinds)) - math.log((every[x] - bad[x] + 1) / (n - b + kinds)) if x in every else 0.0
    assert len(got) == len(pages) and any(not rule for _, _, rule, _ in rows)
    for i, t, rule, verdict in rows:
        if not rule:
            score = prior + sum(map(odds, t))
            assert got[i].score == pytest.approx(score, abs=1e-9) and verdict == ("block" if score > 0 else "allow")


def test_url_odd_rows(spark):
    rows = spark.createDataFrame([(1, None, None, "x"), (1, None, None, "x"), (2, "", "", "x"), (None, "a://b.org/" + "p/" * 20_000, "<p>" + "word " * 20_000, "x")], "page_id long, url string, html string, score string")
    got = url_filter.url_filter(rows).collect()
    assert sorted((r.page_id or 0, r.host, r.verdict) for r in got) == [(0, "b.org", "allow"), (1, "", "allow"), (1, "", "allow"), (2, "", "allow")]
    assert url_filter.url_filter(rows.limit(0)).count() == 0


def test_segmentation():
    import math

    words = {w: math.log(p) for w, p in {"the": 0.4, "cat": 0.2, "sat": 0.2, "hec": 0.1, "at": 0.1}.items()}
    assert url_filter.segment("thecatsat", words) == ["the", "cat", "sat"]
    assert url_filter.segment("thexcat", words) == ["the", "x", "cat"]
    assert url_filter.segment("", words) == []


def test_bayes_learns(spark):
    rows = [(["h:good", "p:a"], "allow")] * 30 + [(["h:bad", "p:a"], "block")] * 30
    odds, prior = url_filter.naive_bayes(spark.createDataFrame(rows, "tokens array<string>, verdict string"))
    assert odds["h:bad"] > 2 and odds["h:good"] < -2 and abs(odds["p:a"]) < 0.1 and prior == pytest.approx(0)


# ---- op8 ---------------------------------------------------------------------------------------------------------


def brute_lines(rows):
    where = defaultdict(set)
    key = lambda s: "".join(c.lower() if "A" <= c <= "Z" else c for c in s.strip(" \t\n\x0b\x0c\r"))
    for i, t in rows:
        if i is not None:
            for line in (t or "").split("\n"):
                if len(key(line)) >= 20:
                    where[key(line)].add(i)
    out = []
    for i, t in rows:
        lines = (t or "").split("\n")
        kept = [x for x in lines if i is None or len(where[key(x)]) < 3 or max(where[key(x)]) == i]
        out.append((i, len(lines), len(lines) - len(kept), "\n".join(kept)))
    return out


def test_lines(spark, documents, odd_rows):
    rng = random.Random(3)
    pool = ["A common line of text, number one", "  a COMMON line of text, number one\t", "another shared line that is long enough", "short", "", "É" * 20, "é" * 20] + [f"unique line number {i} with some length" for i in range(5)]
    rows = [(i, "\n".join(rng.choice(pool) for _ in range(rng.randrange(1, 120)))) for i in range(60)] + [(100 + k, t) for k, (_, t) in enumerate(odd_rows)] + [(None, pool[0]), (5, pool[0]), (5, pool[0])]
    got = line_dedup.line_dedup(documents(rows))
    assert sorted(map(str, ((r.doc_id, r.n_lines, r.n_dropped, r.kept_text) for r in got.collect()))) == sorted(map(str, brute_lines(rows)))
    assert got.columns[: len(documents(rows).columns)] == documents(rows).columns
    assert line_dedup.line_dedup(documents([])).count() == 0


def test_lines_use_no_python(spark):
    from contextlib import redirect_stdout
    from io import StringIO

    out = StringIO()
    with redirect_stdout(out):
        line_dedup.op8_line_dedup(spark, "/root/testdata/sf0.001").explain()
    assert not re.search("Python|Pandas|Arrow", out.getvalue())


# ---- op9 ---------------------------------------------------------------------------------------------------------


def brute_removed(raws, length):
    seen = Counter(r[i : i + length] for r in raws for i in range(len(r) - length + 1))
    out = []
    for r in raws:
        cover = np.zeros(len(r) + 1, int)
        for i in range(len(r) - length + 1):
            if seen[r[i : i + length]] > 1:
                cover[i] += 1
                cover[i + length] -= 1
        gone = np.cumsum(cover)[:-1] > 0
        out.append((len(r), int(gone.sum()), int((np.diff(np.concatenate([[0], gone.astype(int)])) == 1).sum()), bytes(np.frombuffer(r, np.uint8)[~gone])))
    return out


@given(st.lists(st.text(alphabet="ab", min_size=5, max_size=40), min_size=1, max_size=5))
@settings(max_examples=200, deadline=None)
def test_suffix_order(texts):
    pieces = [t.encode() for t in texts]
    raw, places = suffix_dedup.suffix_order(pieces, [len(p) - 4 for p in pieces], 5)
    strings = [raw[p : p + 5] for p in places]
    assert strings == sorted(strings) and len(places) == sum(len(p) - 4 for p in pieces)
    count = Counter(strings)
    assert suffix_dedup.repeated(raw, places, 5).tolist() == sorted(p for p, s in zip(places.tolist(), strings, strict=True) if count[s] > 1)


@pytest.mark.parametrize("group", [20_000, 2])
def test_repeats(spark, documents, group):
    rng = random.Random(9)
    word = lambda n: "".join(rng.choice("abcdeé") for _ in range(n))
    shared = [word(n) for n in (30, 45, 60, 100)]
    texts = [word(rng.randrange(40)) + "".join(rng.choice(shared) + word(rng.randrange(12)) for _ in range(rng.randrange(4))) for _ in range(60)] + ["", "a" * 200, "ab" * 80, "ab" * 90, word(35), shared[3], shared[3], shared[3]]
    rows = [*enumerate(texts), (500, None), (None, word(50)), (7, texts[7]), (7, "another text under the same id " + shared[2])]
    got = suffix_dedup.remove_runs(documents(rows), suffix_dedup.repeated_runs(documents(rows), length=24, group_stretches=group))
    want = brute_removed([(t or "").encode() for _, t in rows], 24)
    assert sorted(map(str, ((r.doc_id, r.n_bytes, r.n_removed, r.n_spans, bytes(r.kept)) for r in got.collect()))) == sorted(map(str, ((i, *w) for (i, _), w in zip(rows, want, strict=True))))
    assert suffix_dedup.remove_runs(documents([]), suffix_dedup.repeated_runs(documents([]))).count() == 0


@pytest.mark.parametrize("where", ["/root/testdata/sf0.001", "/root/testdata/sf0.01"])
def test_repeats_table(spark, where):
    corpus = spark.read.parquet(f"{where}/documents.parquet").select("doc_id", F.coalesce("text", F.lit("")).alias("text")).toPandas()
    got = {(r.doc_id, r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in suffix_dedup.op9_suffix_dedup(spark, where).collect()}
    want = brute_removed([t.encode() for t in corpus.text], 400)
    assert got == {(int(i), n, g, s, sha(k)) for i, (n, g, s, k) in zip(corpus.doc_id, want, strict=True)}


def test_repeats_leave_the_text(spark, tmp_path):
    """Planted passages of over 50 words are gone from the text that the query returns; what shares none is whole; cut characters show."""
    rng = random.Random(90)
    prose = lambda n: " ".join("".join(rng.choice("abcdefghijklmnop") for _ in range(8)) for _ in range(n))
    planted = [prose(60) for _ in range(5)]
    texts = [prose(80) + "\n" + planted[i % 5] + "\n" + prose(i) for i in range(20)] + [prose(100) for _ in range(10)] + [None, ""]
    cut = prose(60)
    texts += ["é" + cut, "\xa9" + cut]  # C3 A9 and C2 A9: the repeat begins inside the character
    spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    got = {r.doc_id: r for r in suffix_dedup.op9_suffix_dedup(spark, str(tmp_path)).collect()}
    for i, text in enumerate(texts[:20]):
        assert planted[i % 5] not in got[i].text and got[i].has_repeats and sha(got[i].text.encode()) == got[i].kept_sha256
        assert text.startswith(got[i].text[:700])
    assert all(got[i].text == (texts[i] or "") and not got[i].has_repeats for i in range(20, 32))
    assert [got[32].text, got[33].text] == ["\ufffd"] * 2
    assert [got[32].kept_sha256, got[33].kept_sha256] == [sha(b"\xc3"), sha(b"\xc2")]


def test_every_operator_is_registered():
    assert {int(m[1]) for q in registry.QUERIES if (m := re.match(r"op(\d+)_", q))} == set(range(1, 14))
    assert set(registry.SQL) <= set(registry.QUERIES) and all(isinstance(sql, str) for sql in registry.SQL.values())
