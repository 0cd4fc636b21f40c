"""Boosting on symmetric trees against a plain one row by row, and its accuracy."""

import numpy as np
import pytest

from seriesloom.operators import boosting


def plain(bins, y, w, bucket, k, n_features, n_bins, rounds, depth, rate, penalty):
    """The same learner with loops over rows, questions and leaves."""
    trees, n = [], len(y)
    n_buckets = 4
    for _ in range(rounds):
        scores = np.zeros((n, k))
        for questions, _, ordered in trees:
            for r in range(n):
                leaf = sum((bins[r][f] > b) << j for j, (f, b) in enumerate(questions))
                scores[r] += ordered[bucket[r]][leaf]
        p = np.exp(scores) / np.exp(scores).sum(axis=1, keepdims=True)
        g, h = (np.eye(k)[y] - p) * w[:, None], p * (1 - p) * w[:, None]
        questions = []

        def leaves(questions):
            return np.array([sum((bins[r][f] > b) << j for j, (f, b) in enumerate(questions)) for r in range(n)])

        def worth(questions):
            own, total = leaves(questions), 0.0
            for leaf in set(own.tolist()):
                inside = own == leaf
                total += (g[inside].sum(axis=0) ** 2 / (h[inside].sum(axis=0) + penalty)).sum()
            return total

        for _ in range(depth):
            now = worth(questions)
            gains = [(-round(worth([*questions, (f, b)]) - now, 9), f, b) for f in range(n_features) for b in range(n_bins - 1)]
            best = min(gains)
            if -best[0] <= 0:
                break
            questions.append((best[1], best[2]))
        if not questions:
            break
        own = leaves(questions)
        value = lambda rows: rate * g[rows].sum(axis=0) / (h[rows].sum(axis=0) + penalty)  # noqa: B023, E731
        values = [value(own == leaf) for leaf in range(1 << len(questions))]
        ordered = [[value((own == leaf) & (bucket < b)) for leaf in range(1 << len(questions))] for b in range(n_buckets)]
        trees.append((questions, values, ordered))
    return trees


def data(spark, n=160, seed=0, parts=3):
    rng = np.random.default_rng(seed)
    x = rng.normal(size=(n, 3)).round(2)
    y = np.where(x[:, 0] + 0.3 * rng.normal(size=n) > 0.4, "c", np.where(x[:, 1] > 0, "a", "b"))
    rows = [(i, *map(float, v), str(c)) for i, (v, c) in enumerate(zip(x, y, strict=True))]
    rows[5] = (5, None, *rows[5][2:])
    rows.append((n, 1.0, 1.0, 1.0, None))
    return spark.createDataFrame(rows, "id long, u double, v double, z double, best string").repartition(parts)


@pytest.mark.parametrize("balanced", [False, True])
def test_trees_are_those_of_the_plain_learner(spark, balanced):
    rows = data(spark)
    model = boosting.fit_booster(rows, ["u", "v", "z"], "best", ["id"], rounds=4, depth=2, n_bins=6, buckets=4, balanced=balanced)
    model_start = model.start.copy()
    F = boosting.F
    known = rows.where("best is not null").select(model.bins().alias("bins"), "best", F.pmod(F.xxhash64("id", F.lit(42)), F.lit(4)).alias("bucket")).collect()
    y = np.array([model.classes.index(r.best) for r in known])
    counts = np.bincount(y)
    w = (len(y) / (3 * counts))[y] if balanced else np.ones(len(y))
    if not balanced:
        assert np.allclose(model_start, np.log(counts / len(y)))
        model = boosting.fit_booster(rows.where("best is not null"), ["u", "v", "z"], "best", ["id"], rounds=4, depth=2, n_bins=6, buckets=4)
        w = (len(y) / (3 * counts))[y]
    want = plain([r.bins for r in known], y, w, np.array([r.bucket for r in known]), 3, 3, 6, 4, 2, 0.3, 1.0)
    assert len(model.trees) == len(want) == 4
    for tree, (questions, values, ordered) in zip(model.trees, want, strict=True):
        assert tree.questions == questions
        assert np.allclose(tree.values, values) and np.allclose(tree.ordered, ordered)
    assert not model.trees[0].ordered[0].any()  # the first bucket has none before it


def test_accuracy_and_fixed_results(spark):
    train, test = data(spark, 1500, 1), data(spark, 500, 2)
    model = boosting.fit_booster(train, ["u", "v", "z"], "best", ["id"], rounds=15)
    said = boosting.classify(test.where("best is not null"), model)
    assert said.where("predicted = best").count() / 500 > 0.85
    again = boosting.classify(test.where("best is not null"), boosting.fit_booster(train.repartition(7), ["u", "v", "z"], "best", ["id"], rounds=15))
    a, b = ({r.id: (r.predicted, round(r.confidence, 9)) for r in df.collect()} for df in (said, again))
    assert a == b and all(1 / 3 <= c <= 1 for _, c in a.values())


def test_few_classes_and_rows(spark):
    rows = data(spark, 60)
    only = boosting.classify(rows, boosting.fit_booster(rows.where("best = 'a'"), ["u"], "best", ["id"]))
    assert {(r.predicted, r.confidence) for r in only.collect()} == {("a", 1.0)}
    none = boosting.classify(rows, boosting.fit_booster(rows.limit(0), ["u"], "best", ["id"]))
    assert {(r.predicted, r.confidence) for r in none.collect()} == {(None, None)}
    flat = rows.withColumn("u", boosting.F.lit(1.0))
    assert not boosting.fit_booster(flat, ["u"], "best", ["id"], rounds=3).trees
    assert boosting.classify(rows.limit(0), boosting.fit_booster(rows, ["u"], "best", ["id"], rounds=1)).count() == 0
