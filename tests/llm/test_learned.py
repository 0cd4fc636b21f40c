"""Operators that learn or estimate: held-out accuracy, error of estimates, and the pipeline against brute force."""

import hashlib
import math
import random
import re
from collections import Counter

import numpy as np
import pandas as pd
import pytest
import xxhash
from pyspark.sql import functions as F

import corpus_pipeline
from seriesloom.llm import minhash, pii, quality, simhash

DIR = "/root/testdata/sf0.01"


def words_of(t, n=5):
    w = (t or "").encode().lower().split()
    return {tuple(w[i : i + n]) for i in range(max(1, len(w) - n + 1))} if w else set()


def jaccard(a, b):
    return len(a & b) / len(a | b) if a | b else 1.0


def test_quality_separates_labels(spark):
    labels = pd.read_parquet(f"{DIR}/labels.parquet")
    kept = {r.doc_id for r in quality.op2_quality(spark, DIR).collect()}
    good, bad = labels[labels.quality == 1].doc_id, labels[labels.quality == 0].doc_id
    assert good.isin(kept).mean() > 0.99 and bad.isin(kept).mean() < 0.1


def test_quality_on_unlabelled_documents(spark):
    """Fitted on half of the labels, judged on the others."""
    labels = pd.read_parquet(f"{DIR}/labels.parquet")
    half = labels[labels.doc_id % 2 == 0]
    docs = spark.read.parquet(f"{DIR}/documents.parquet")
    kept = {r.doc_id for r in quality.select_quality(docs, spark.createDataFrame(half)).select("doc_id").collect()}
    rest = labels[labels.doc_id % 2 == 1]
    assert rest[rest.quality == 1].doc_id.isin(kept).mean() > 0.97 and rest[rest.quality == 0].doc_id.isin(kept).mean() < 0.15


def test_quality_odd_rows(spark, documents, odd_rows):
    labels = spark.createDataFrame([(5, 1, 0), (4, 0, 0), (None, 1, 0), (999, None, 0)], "doc_id long, quality int, toxic int")
    got = quality.select_quality(documents(odd_rows), labels)
    assert 0 < got.count() <= len(odd_rows) and got.columns[:2] == ["doc_id", "text"]
    assert quality.select_quality(documents(odd_rows), labels.limit(0)).count() == len(odd_rows)
    assert quality.select_quality(documents([]), labels).count() == 0


def brute_grams(text):
    """Buckets of a text's words, pairs of words and pairs of word shapes, with plain integers."""
    a, b, full = 0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, (1 << 64) - 1
    tokens = re.findall(r"\w+|[^\w\s]+", text or "")
    h = [xxhash.xxh64_intdigest("0" if t.isdecimal() else t.lower(), 5) >> 8 for t in tokens]
    looks = [quality._shape(t) for t in tokens]
    out = [(x * a & full) >> 50 for x in h]
    out += [(1 << 14) + (0 if x == y else ((x * a + y * b) * a & full) >> 50) for x, y in zip(h, h[1:])]
    return out + [(2 << 14) + (((x * 256 + y) * a & full) >> 52) for x, y in zip(looks, looks[1:])]


def test_quality_query_is_brute_force(spark):
    """Counts, ratios, weights, keys and the selected set of the registered query."""
    where = "/root/testdata/sf0.001"
    docs, labels = pd.read_parquet(f"{where}/documents.parquet").set_index("doc_id"), pd.read_parquet(f"{where}/labels.parquet")
    drawn = spark.read.parquet(f"{where}/documents.parquet").select("doc_id", quality.gumbel(F.col("doc_id"), 42).alias("g"), (F.pmod(F.xxhash64("doc_id", F.lit(9)), F.lit(5)) == 0).alias("held")).toPandas().set_index("doc_id")
    grams = {i: brute_grams(t) for i, t in docs.text.items()}
    good = [i for i in set(labels[labels.quality == 1].doc_id) if i in grams]
    bad = [i for i in set(labels[labels.quality == 0].doc_id) if i in grams]
    count = lambda ids: Counter(g for i in ids for g in grams[i])
    raw, target = count(grams), count([i for i in good if not drawn.held[i]])
    n_raw, n_target = sum(raw.values()), sum(target.values())

    def ratio(g):
        p = (raw[g] + 1) / (n_raw + quality.BUCKETS)
        return math.log((target[g] + quality.LEAN * p) / (n_target + quality.LEAN) / p)

    weight = {i: sum(map(ratio, gs)) for i, gs in grams.items()}
    key = {i: w + drawn.g[i] for i, w in weight.items()}
    seen = [i for i in good if drawn.held[i]]
    top = sorted(key[i] for i in seen)[int(0.002 * len(seen))]
    below = [key[i] for i in bad if key[i] < top]
    cut = (top + max(below)) / 2 if below else top - 1
    got = quality.op2_quality(spark, where).toPandas().set_index("doc_id")
    assert set(got.index) == {i for i, k in key.items() if k >= cut}
    assert np.allclose(got.log_weight, [weight[i] for i in got.index], atol=1e-6) and np.allclose(got.key, [key[i] for i in got.index], atol=1e-6)
    # the cut is Gumbel top-k of as many
    named = quality.select_quality(spark.read.parquet(f"{where}/documents.parquet"), spark.read.parquet(f"{where}/labels.parquet"), k=len(got))
    assert {r.doc_id for r in named.select("doc_id").collect()} == set(got.index)


def test_quality_replaces_clashing_columns(spark, documents):
    rows = documents([(1, "a b c"), (2, "d e f")]).withColumns({"key": F.lit("mine"), "log_weight": F.lit("mine")})
    got = quality.select_quality(rows, spark.createDataFrame([(1, 1, 0)], "doc_id long, quality int, toxic int"))
    assert dict(got.dtypes)["key"] == dict(got.dtypes)["log_weight"] == "double" and len(got.columns) == len(set(got.columns))


def test_stages_on_odd_rows(spark, documents, odd_rows, tmp_path):
    """Every stage takes nulls, ties, repeated rows and an empty table, and gives the columns of documents."""
    spark.createDataFrame([(1, 1, 0), (4, 0, 0)], "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    for rows in (odd_rows, []):
        docs = documents(rows)
        for name, stage in corpus_pipeline.STAGES:
            out = stage(spark, docs, str(tmp_path))
            assert name == "best-fit packing" or out.columns == docs.columns
            docs = corpus_pipeline.written(out, "odd-stage")
        assert (docs.count() > 0) == bool(rows)


def test_gumbel_top_k(spark):
    scored = spark.range(5000).withColumn("key", F.sin(F.col("id") * 12.9898) * 1e3)
    got = {r.id for r in quality.top_k(scored, 137).collect()}
    keys = [(np.sin(i * 12.9898) * 1e3, i) for i in range(5000)]
    assert got == {i for _, i in sorted(keys, reverse=True)[:137]}
    assert quality.top_k(scored, 9999).count() == 5000 and quality.top_k(scored, 0).count() == 0
    noise = np.array([r.g for r in spark.range(20_000).select(quality.gumbel(F.col("id"), 42).alias("g")).collect()])
    assert abs(noise.mean() - 0.5772) < 0.05 and abs(noise.var() - np.pi**2 / 6) < 0.1


def test_fingerprints(spark):
    docs = pd.read_parquet(f"{DIR}/documents.parquet", columns=["doc_id", "text"]).sort_values("doc_id", ascending=False).reset_index(drop=True)
    got = {r.doc_id: r for r in minhash.op4_minhash(spark, DIR).collect()}
    assert len(got) == len(docs)
    errors, prints = [], {}
    for k, (i, t) in enumerate(zip(docs.doc_id, docs.text, strict=True)):
        n, half = docs.text[(k + 1) % len(docs)], len(t) // 2
        edited = t[: len(t) - half] + n[:half]
        r = got[i]
        assert (r.n_chars, r.edited_sha256) == (len(t), hashlib.sha256(edited.encode()).hexdigest())
        assert prints.setdefault(t, r.fingerprint) == r.fingerprint
        errors += [r.near_edited - jaccard(words_of(t), words_of(edited)), r.near_next - jaccard(words_of(t), words_of(n))]
    assert np.abs(errors).mean() < 0.03 and np.abs(errors).max() < 0.25


@pytest.mark.parametrize("parts", [1, 3, 50])
def test_next_across_ranges(spark, documents, parts):
    rows = [(i * 7 % 101, f"text {i}") for i in range(101)] + [(None, "none"), (3, "again")]
    dealt = minhash.with_next(documents(rows), parts).toPandas()
    own = dealt[~dealt["last"]]
    assert len(own) == len(rows)
    order = sorted(((i if i is not None else -(1 << 63)), t) for i, t in rows)
    order.sort(key=lambda r: (-r[0], r[1]))
    follows = {a: b for a, b in zip(order, order[1:] + order[:1], strict=True)}
    for _, part in dealt.groupby("part"):
        part = part.assign(neg=[-i for i in part["id"].tolist()]).sort_values(["last", "neg", "text"], kind="stable")
        seen = list(zip(part["id"].tolist(), part["text"], part["last"], strict=True))
        for (a, t, last), (b, u, _) in zip(seen, seen[1:], strict=False):
            if not last:
                assert follows[(a, t)] == (b, u)


def test_fingerprints_odd_rows(spark, documents, odd_rows):
    got = minhash.edited_fingerprints(documents(odd_rows)).collect()
    assert len(got) == len(odd_rows)
    assert len({r.fingerprint for r in got if r.n_chars == 0}) == 1
    assert minhash.edited_fingerprints(documents([])).count() == 0
    one = minhash.edited_fingerprints(documents([(1, "a b c d e f g h")])).collect()
    assert len(one) == 1 and one[0].near_next == 1.0


def brute_classes(texts, threshold=0.8):
    sets = {i: words_of(t) for i, t in texts.items()}
    ids = sorted(sets)
    root = {i: i for i in ids}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    holders = {}
    for i in ids:
        for g in sets[i]:
            holders.setdefault(g, []).append(i)
    tested = set()
    for held in holders.values():
        for n, a in enumerate(held):
            for b in held[n + 1 :]:
                if (a, b) not in tested:
                    tested.add((a, b))
                    if jaccard(sets[a], sets[b]) >= threshold:
                        x, y = find(a), find(b)
                        root[max(x, y)] = min(x, y)
    empty = [i for i in ids if not sets[i]]
    return {i: find(i) if sets[i] else min(empty) for i in ids}


def test_near_duplicate_classes(spark):
    docs = pd.read_parquet(f"{DIR}/documents.parquet", columns=["doc_id", "text"])
    want = brute_classes(dict(zip(docs.doc_id, docs.text, strict=True)))
    frame = spark.read.parquet(f"{DIR}/documents.parquet")
    for got in (minhash.near_duplicates(frame).toPandas().set_index("doc_id").class_id, minhash.near_duplicates(frame, bucket_rows=2).toPandas().set_index("doc_id").class_id, simhash.similar_groups(frame).toPandas().set_index("doc_id").component_id):
        assert got.to_dict() == want


@pytest.mark.parametrize("bucket_rows", [3, 10_000])
def test_minhash_in_crowded_buckets(spark, documents, bucket_rows):
    """Lone pairs in buckets that a common passage makes: whole whatever the bucket's bound."""
    rng = random.Random(8)
    word = lambda: f"w{rng.randrange(10**6)}"
    passage, texts = " ".join(word() for _ in range(280)), {}
    for n in range(40):
        shared = " ".join(word() for _ in range(60))
        texts |= {2 * n + side: f"{passage} {shared} {' '.join(word() for _ in range(10))}" for side in (0, 1)}
    want = brute_classes(texts)
    got = minhash.near_duplicates(documents(list(texts.items())), bucket_rows=bucket_rows).toPandas().set_index("doc_id").class_id.to_dict()
    assert got == want


def test_near_copies_that_share_a_passage(spark, documents):
    """Every shard of the passage's shingles is above its bound; near copies must meet all the same."""
    rng = random.Random(4)
    word = lambda: f"w{rng.randrange(10**6)}"
    passage, texts = " ".join(word() for _ in range(300)), {}
    for n in range(40):
        own = [word() for _ in range(100)]
        twin = own[:30] + [word()] + own[31:70] + [word()] + own[71:]
        texts |= {2 * n: f"{passage} {' '.join(own)}", 2 * n + 1: f"{passage} {' '.join(twin)}"}
    # a text whose repeats outvote what it shares with its near copy
    texts |= {200: texts[0].replace(passage, "") + " again and again it says so" * 300, 201: texts[0].replace(passage, "") + " again and again it says so" * 2}
    want = brute_classes(texts)
    assert len(set(want.values())) == 41
    got = simhash.similar_groups(documents(list(texts.items())), shard_rows=8).toPandas().set_index("doc_id").component_id.to_dict()
    assert got == want


@pytest.mark.parametrize("share", [75, 80, 85])
def test_lone_pairs_that_share_a_passage(spark, documents, share):
    """Pairs just above the threshold, alike in little besides a passage that all texts hold, more than a shard takes."""
    rng = random.Random(share)
    word = lambda: f"w{rng.randrange(10**6)}"
    passage, texts = " ".join(word() for _ in range(3 * share + 4)), {}
    for n in range(60):
        shared = " ".join(word() for _ in range(273 - 3 * share + n % 5))
        texts |= {2 * n + side: f"{passage} {shared} {' '.join(word() for _ in range(27 - n % 5))}" for side in (0, 1)}
    want = brute_classes(texts)
    assert len(set(want.values())) == 60
    got = simhash.similar_groups(documents(list(texts.items())), shard_rows=8).toPandas().set_index("doc_id").component_id.to_dict()
    assert got == want


@pytest.mark.parametrize("seed", [1, 2])
def test_crowded_texts_of_any_length(spark, documents, seed):
    """Texts that hold more or less of one passage: blocks of crowded shards meet, and links are those of brute force."""
    rng = random.Random(seed)
    passage, texts = [f"p{i}" for i in range(200)], {}
    for n in range(150):
        at, long = rng.randrange(60), rng.randrange(100, 200)
        texts[n] = " ".join(passage[at : at + long] + [f"w{rng.randrange(10**6)}" for _ in range(rng.randrange(60))])
    want = brute_classes(texts)
    got = simhash.similar_groups(documents(list(texts.items())), shard_rows=4).toPandas().set_index("doc_id").component_id.to_dict()
    assert got == want


def test_pipeline(spark):
    """Each stage against brute force on what the stage before it kept."""
    from tests.llm.test_exact import brute_base, brute_lines

    docs = spark.read.parquet(f"{DIR}/documents.parquet")
    columns, kept = docs.columns, {}
    for name, stage in corpus_pipeline.STAGES:
        before = docs.toPandas()
        docs = corpus_pipeline.written(stage(spark, docs, DIR), "test-stage")
        after = docs.toPandas()
        kept[name] = after
        if name != "best-fit packing":
            assert docs.columns == columns and (after.n_chars == after.text.str.len()).all() and set(after.doc_id) <= set(before.doc_id)
        if name == "line dedup":
            assert dict(zip(after.doc_id, after.text, strict=True)) == {i: t for i, _, _, t in brute_lines(list(zip(before.doc_id, before.text, strict=True)))}
        if name == "SimHash near-dedup":
            want = set(brute_classes(dict(zip(before.doc_id, before.text, strict=True))).values())
            assert want == set(after.doc_id)
        if name == "PII":
            assert not any(brute_base(t) for t in after.text)
            clean = [i for i, t in zip(before.doc_id, before.text, strict=True) if not pii.base_matches(t)["email"] and not any(c.isdigit() for c in t)]
            assert before.set_index("doc_id").text[clean].equals(after.set_index("doc_id").text[clean])
    last = kept["best-fit packing"]
    assert set(last.doc_id) == set(kept["PII"].doc_id) and last.groupby("sequence_id").length.sum().max() <= 4096
    assert len(corpus_pipeline.run(spark, DIR).toPandas()) == len(last)


def test_resampling_draws_by_weight(spark):
    """Of three items with weights 1, 2 and 5 the one of the largest key is each as often as its weight says."""
    weights = np.log([1.0, 2.0, 5.0])
    rows = spark.range(60_000).select((F.col("id") / 3).cast("long").alias("trial"), (F.col("id") % 3).alias("item"), (F.element_at(F.array(*map(F.lit, weights.tolist())), (F.col("id") % 3 + 1).cast("int")) + quality.gumbel(F.col("id"), 7)).alias("key"))
    first = rows.groupBy("trial").agg(F.max_by("item", "key").alias("item")).groupBy("item").count().collect()
    share = {r["item"]: r["count"] / 20_000 for r in first}
    assert all(abs(share[i] - w / 8) < 0.015 for i, w in enumerate((1, 2, 5)))


def test_resample_is_brute_force(spark):
    docs, labels = (spark.read.parquet(f"{DIR}/{t}.parquet") for t in ("documents", "labels"))
    kept = {seed: {r.doc_id: (r.log_weight, r.key) for r in quality.resample(docs, labels, 50, seed=seed).collect()} for seed in (1, 2)}
    corpus = docs.select("doc_id", "text").toPandas()
    good = set(labels.where("quality = 1").toPandas().doc_id)
    hasher = quality.NgramHasher()
    found = {i: hasher.buckets(t) for i, t in zip(corpus.doc_id, corpus.text, strict=True)}
    count = lambda ids: np.bincount(np.concatenate([found[i] for i in ids]), minlength=quality.BUCKETS)
    ratios = quality.log_ratios(count(sorted(good)), count(corpus.doc_id))
    weight = {i: 20.0 * ratios[b].mean() if len(b) else 0.0 for i, b in found.items()}
    for seed, got in kept.items():
        noise = {r.id: r.g for r in docs.select(F.col("doc_id").alias("id"), quality.gumbel(F.col("doc_id"), seed).alias("g")).collect()}
        want = sorted(weight, key=lambda i: -(weight[i] + noise[i]))[:50]
        assert set(got) == set(want) and all(abs(got[i][0] - weight[i]) < 1e-9 and abs(got[i][1] - weight[i] - noise[i]) < 1e-9 for i in want)
    by_weight = set(sorted(weight, key=lambda i: -weight[i])[:50])
    # the noise matters: seeds draw different documents, and neither draws the heaviest ones only
    assert set(kept[1]) != set(kept[2]) and set(kept[1]) != by_weight
    assert np.mean([weight[i] for i in kept[1]]) > np.mean(list(weight.values()))


def test_resample_odd_rows(spark, documents, odd_rows):
    labels = spark.createDataFrame([(5, 1, 0), (2, 0, 0)], "doc_id long, quality int, toxic int")
    docs = documents(odd_rows).withColumnRenamed("extra", "key")
    assert quality.resample(docs, labels, 100).count() == len(odd_rows)
    got = quality.resample(docs, labels, 3)
    assert 3 <= got.count() <= 4 and got.columns == [c for c in docs.columns if c != "key"] + ["log_weight", "key"]
    assert quality.resample(documents([]), labels, 3).count() == 0


def test_near_duplicate_odd_rows(spark, documents, odd_rows):
    docs = documents([*odd_rows, (None, "a text that only a row without an id has, of many words")]).withColumnRenamed("words", "key").withColumnRenamed("extra", "bands")
    got = minhash.near_duplicates(docs).collect()
    assert len(got) == len(odd_rows) + 1
    classes = {}
    for r in got:
        classes.setdefault(r.doc_id, set()).add(r.class_id)
    assert classes[5] == classes[6] == {5} and classes[1] == classes[2] == classes[3] == {1} and classes[4] == {4} and classes[7] == {7}
    assert sorted(classes[None], key=str) == [1, 5, None]
    assert minhash.near_duplicates(documents([])).count() == 0
