"""Toxicity: held-out accuracy, the effect of swapped identity terms, plain rescoring, and odd rows."""

import math
import random
import re
import zlib

import numpy as np
import pandas as pd
import xxhash

from seriesloom.llm import toxicity

LABELS = "doc_id long, quality int, toxic int"


def plain_features(text):
    times = {}
    for word in set(re.findall(r"\w+", text.lower())):
        for bucket in {xxhash.xxh32_intdigest(n, 11) >> 14 for n in ["=" + word, *(word[:k] for k in (4, 5, 6) if len(word) >= k)]}:
            times[bucket] = times.get(bucket, 0) + 1
    return {b * 4 + k for b, n in times.items() for k, least in enumerate((1, 2, 3, 5)) if n >= least}


def test_held_out_accuracy_and_plain_rescoring(spark):
    folder = "/root/testdata/sf0.1"
    got = toxicity.op11_toxicity(spark, folder).toPandas()
    docs, labels = (pd.read_parquet(f"{folder}/{t}.parquet") for t in ("documents", "labels"))
    assert list(got.columns) == ["doc_id", "held_out", "score", "predicted"] and sorted(got.doc_id) == sorted(docs.doc_id)
    assert (got.held_out == [zlib.crc32(str(i).encode()) % 5 == 0 for i in got.doc_id]).all() and (got.predicted == (got.score >= 0.5)).all()
    judged = got[got.held_out].merge(labels, on="doc_id")
    assert judged[judged.toxic == 1].predicted.mean() > 0.85 and judged[judged.toxic == 0].predicted.mean() < 0.01
    # the same from the model's weights, feature by feature
    model = toxicity.train(spark.createDataFrame(docs[["doc_id", "text"]]), spark.createDataFrame(labels).where(~toxicity.held_out()))
    some = docs.sample(400, random_state=1).merge(got, on="doc_id")
    plain = [1 / (1 + math.exp(-model.constant - sum(w for f, w in model.weights.items() if f in plain_features(t)))) for t in some.text]
    assert np.allclose(plain, some.score, atol=1e-9)


def test_labels_of_held_out_rows_do_not_matter(spark, documents):
    rng = random.Random(0)
    rows = [(i, " ".join(rng.choice("one two three four five six".split()) for _ in range(20)) + (" grumpf" if i % 3 == 0 else "")) for i in range(400)]
    marks = [(i, 1, int(i % 3 == 0)) for i in range(400)]
    lies = [(i, q, 1 - t if zlib.crc32(str(i).encode()) % 5 == 0 else t) for i, q, t in marks]
    a, b = (sorted(map(tuple, toxicity.score_documents(documents(rows), spark.createDataFrame(m, LABELS)).select("doc_id", "score", "predicted").collect())) for m in (marks, lies))
    assert a == b and all(p == (i % 3 == 0) for i, _, p in a)


def test_swapped_terms_keep_neutral_mentions_clean(spark, documents):
    """Labels that go along with one group's name: without the penalty the name itself is taken for toxic."""
    rng = random.Random(5)
    filler = "the house and river stood near old stone bridge while rain fell softly over quiet green hills".split()
    say = lambda *w: " ".join([*rng.sample(filler, 6), *w, *rng.sample(filler, 6)]) + "."
    insults = ["".join(rng.choices("bcdfghklmnprst", k=7)) for _ in range(60)]
    rows, marks = [], []
    for i in range(1200):
        toxic = i % 2 == 0
        words = (rng.choice(insults), *(["muslims"] if rng.random() < 0.8 else [])) if toxic else (rng.choice(filler), *(["christians"] if rng.random() < 0.3 else []))
        rows.append((i, say(*words)))
        marks.append((i, 1, int(toxic)))
    neutral = [(10_000 + k, say(name)) for k, name in enumerate(["muslims", "christians", "jews", "people"] * 25)]
    hateful = [(20_000 + k, say(name, rng.choice(insults))) for k, name in enumerate(["muslims", "christians", "jews", "people"] * 25)]
    docs = documents(rows + neutral + hateful)
    labels = spark.createDataFrame(marks, LABELS)
    wrong, spread, caught = {}, {}, {}
    for fairness in (0.0, 20.0):
        scored = {r.doc_id: (r.score, r.predicted) for r in toxicity.score_documents(docs, labels, fairness=fairness).collect()}
        wrong[fairness] = sum(scored[i][1] for i, _ in neutral)
        caught[fairness] = sum(scored[i][1] for i, _ in hateful)
        mean = [np.mean([scored[10_000 + k][0] for k in range(j, 100, 4)]) for j in range(4)]
        spread[fairness] = max(mean) - min(mean)
    assert wrong[0.0] >= 20 and wrong[20.0] == 0  # neutral mentions of the one group
    assert spread[20.0] < 0.25 * spread[0.0]
    assert caught[20.0] == len(hateful)


def test_swaps():
    terms = {"a": ["people", "reds", "blues"], "b": ["person", "red"]}
    got = [(sorted(x - y), sorted(y - x)) for x, y in toxicity.swaps("The Reds won. Nobody spoke!\nOne red door", terms)]
    assert got == [(["reds"], ["people"]), (["reds"], ["blues"]), (["red"], ["person"])]


def test_fit_is_a_minimum():
    rng = np.random.default_rng(2)
    rows = [np.flatnonzero(rng.random(12) < 0.3) for _ in range(80)]
    toxic = np.array([(0 in r) or (1 in r and 2 in r) for r in rows])
    before, after = [np.array([3]), np.array([0, 4])], [np.array([5]), np.array([6])]
    times = np.array([3.0, 1.0])

    def loss(c, w):
        z = np.array([c + w[r].sum() for r in rows])
        share = np.where(toxic, 0.5 / toxic.sum(), 0.5 / (~toxic).sum())
        moved = [w[a].sum() - w[b].sum() for a, b in zip(before, after, strict=True)]
        return share @ np.logaddexp(0, np.where(toxic, -z, z)) + 2.0 * float(times @ np.square(moved)) / 4 + 1e-2 * np.abs(w).sum() + 5e-3 * w @ w

    c, w = toxicity.fit_weights(rows, toxic, before, after, times, 12, fairness=2.0, lasso=1e-2, ridge=1e-2, rounds=4000)
    best = loss(c, w)
    for _ in range(300):
        assert loss(c + rng.normal() * 0.02, w + rng.normal(size=12) * 0.02) > best - 1e-9
    assert (w == 0).any()


def test_odd_rows(spark, documents, odd_rows):
    labels = spark.createDataFrame([(2, 1, 0), (5, 1, 1), (6, 1, None), (None, 1, 1), (999, 0, 1), (7, 1, 0), (7, 1, 1)], LABELS)
    docs = documents(odd_rows).withColumnRenamed("extra", "score")
    got = toxicity.score_documents(docs, labels).collect()
    assert len(got) == len(odd_rows) and all(0 <= r.score <= 1 and r.held_out is not None for r in got)
    assert len({r.score for r in got if not (r.text or "").strip()}) == 1 and len({r.score for r in got if r.doc_id == 6}) == 1
    none = spark.createDataFrame([], LABELS)
    assert {r.score for r in toxicity.score_documents(docs, none).collect()} == {0.0}
    assert {r.score for r in toxicity.score_documents(docs, spark.createDataFrame([(i, 0, 1) for i in range(8)], LABELS)).collect()} == {1.0}
    assert toxicity.score_documents(documents([]), none).count() == 0
