"""Multi-class boosting on symmetric trees with ordered leaf values, over a distributed table.

All leaves of a level of a tree ask the same question (is a feature's bin above a border?), so a level needs one aggregation: each
task sums gradients and curvatures by leaf, feature, bin and class, and these sums meet by feature. They are as many as
leaves, bins and classes, however many rows there are; the driver picks the best question from them. The leaves' values follow
from the sums of the last level, so a tree of depth d takes d passes.

Ordered: rows are dealt by a hash of their id to buckets, and a training row's score comes from leaf values that earlier buckets
alone determine; so its own label is not in the score from which its gradient is taken. New rows get values from all buckets.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..sources.shared import stored


@dataclass
class Tree:
    """Questions (feature, border), one a level; values by leaf and class for new rows, and by bucket for training rows."""

    questions: list[tuple[int, int]]
    values: np.ndarray
    ordered: np.ndarray

    def leaves(self, bins: np.ndarray) -> np.ndarray:
        return leaves_of(bins, self.questions)


def leaves_of(bins: np.ndarray, questions: Sequence[tuple[int, int]]) -> np.ndarray:
    """Each row's leaf: the answers, the first question's as the lowest bit."""
    leaf = np.zeros(len(bins), np.int64)
    for level, (f, border) in enumerate(questions):
        leaf |= (bins[:, f] > border).astype(np.int64) << level
    return leaf


@dataclass
class Booster:
    features: list[str]
    borders: list[list[float]]
    classes: list[str]
    start: np.ndarray
    trees: list[Tree] = field(default_factory=list)

    def bins(self) -> Column:
        """Array of each feature's bin: how many borders lie below its value; a missing value is in the lowest bin."""

        def of(name: str, borders: list[float]) -> Column:
            known = F.array(*(F.lit(float(b)) for b in borders)) if borders else F.array().cast("array<double>")
            return F.size(F.filter(known, lambda b: b < F.col(name).cast("double")))

        return F.array(*(of(f, bs) for f, bs in zip(self.features, self.borders, strict=True)))

    def scores(self, bins: np.ndarray, buckets: np.ndarray | None = None) -> np.ndarray:
        """A row's score of each class; with buckets, as a training row."""
        out = np.tile(self.start, (len(bins), 1))
        for t in self.trees:
            leaf = t.leaves(bins)
            out += t.values[leaf] if buckets is None else t.ordered[buckets, leaf]
        return out


def softmax(scores: np.ndarray) -> np.ndarray:
    e = np.exp(scores - scores.max(axis=1, keepdims=True))
    return e / e.sum(axis=1, keepdims=True)


def _best_question(sums: np.ndarray, leaves: int, penalty: float) -> tuple[tuple[int, int] | None, np.ndarray]:
    """The question of largest gain (ties: smaller feature, then border), if one gains, and the sums of both sides for it.

    sums: (feature, bucket, leaf, bin, class, gradient or curvature).
    """
    whole = sums.sum(axis=1)  # feature, leaf, bin, class, 2
    low = whole.cumsum(axis=2)[:, :, :-1]
    total = whole.sum(axis=2, keepdims=True)
    high = total - low
    worth = lambda s: (s[..., 0] ** 2 / (s[..., 1] + penalty)).sum(axis=-1)
    gain = (worth(low) + worth(high) - worth(total)).sum(axis=1)  # feature, border
    if not gain.size or not np.round(gain, 9).max() > 0:
        return None, sums[0].sum(axis=2) if len(sums) else np.zeros((0, leaves, 0, 2))
    f, border = np.unravel_index(np.round(gain, 9).argmax(), gain.shape)
    below = sums[f][:, :, : border + 1].sum(axis=2)
    above = sums[f].sum(axis=2) - below
    return (int(f), int(border)), np.concatenate([below, above], axis=1)  # bucket, leaf, class, 2


def _leaf_values(sums: np.ndarray, rate: float, penalty: float) -> tuple[np.ndarray, np.ndarray]:
    """Values for new rows, and for the rows of each bucket from those before it."""
    value = lambda s: rate * s[..., 0] / (s[..., 1] + penalty)
    before = sums.cumsum(axis=0) - sums
    return value(sums.sum(axis=0)), value(before)


def fit_booster(
    rows: DataFrame, features: Sequence[str], label: str, id_cols: Sequence[str], rounds: int = 20, depth: int = 3, rate: float = 0.3, penalty: float = 1.0, n_bins: int = 32, buckets: int = 8, balanced: bool = True, seed: int = 42
) -> Booster:
    """Fit on rows with a label; rows without one take no part. Classes are in the order of their names.

    balanced: every class weighs alike. Borders are quantiles over all rows. A tree ends early where no question gains, and the fit where
    a tree has none. Defined cases: one class gives its own name with certainty; no rows give no classes.
    """
    features = list(features)
    known = rows.where(F.col(label).isNotNull())
    counts = {r[0]: r[1] for r in known.groupBy(F.col(label).cast("string")).count().collect()}  # one row a class
    classes = sorted(counts)
    shares = [F.percentile_approx(F.col(f).cast("double"), F.array(*(F.lit(i / n_bins) for i in range(1, n_bins))), 10_000).alias(f"q{i}") for i, f in enumerate(features)]
    found = known.agg(*shares).first() if features else []
    model = Booster(features, [sorted(set(found[f"q{i}"] or [])) for i in range(len(features))], classes, np.zeros(len(classes)))
    if len(classes) < 2:
        return model
    n = sum(counts.values())
    if not balanced:
        model.start = np.log(np.array([counts[c] / n for c in classes]))
    weight = F.lit(1.0)
    for c in classes if balanced else ():
        weight = F.when(F.col(label).cast("string") == c, n / (len(classes) * counts[c])).otherwise(weight)
    number = F.array_position(F.array(*(F.lit(c) for c in classes)), F.col(label).cast("string")).cast("int") - 1
    bucket = F.pmod(F.xxhash64(*id_cols, F.lit(seed)), F.lit(buckets)).cast("int")
    data = stored(known.select(model.bins().alias("bins"), number.alias("y"), weight.alias("w"), bucket.alias("bucket")), "binned")
    k, sc = len(classes), rows.sparkSession.sparkContext

    def sums_of(questions: list[tuple[int, int]]) -> np.ndarray:
        shared = sc.broadcast((model, list(questions)))
        leaves = 1 << len(questions)
        shape = (buckets, leaves, n_bins, k, 2)

        def part(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            grown, asked = shared.value
            total = np.zeros((len(features), buckets * leaves * n_bins, k, 2))
            for pdf in batches:
                if not len(pdf):
                    continue
                bins, own = np.stack(pdf["bins"].to_numpy()).astype(np.int64), pdf["bucket"].to_numpy(np.int64)
                p, w = softmax(grown.scores(bins, own)), pdf["w"].to_numpy(float)
                g = (np.eye(k)[pdf["y"].to_numpy(np.int64)] - p) * w[:, None]
                h = p * (1 - p) * w[:, None]
                at = (own * leaves + leaves_of(bins, asked)) * n_bins
                for f in range(len(features)):
                    cell = at + bins[:, f]
                    for c in range(k):
                        total[f, :, c, 0] += np.bincount(cell, g[:, c], total.shape[1])
                        total[f, :, c, 1] += np.bincount(cell, h[:, c], total.shape[1])
            yield pd.DataFrame({"feature": range(len(features)), "sums": [t.tobytes() for t in total]})

        def add(pdf: pd.DataFrame) -> pd.DataFrame:
            # a fixed order, so that rounding does not depend on which task ended first
            parts = sorted(pdf["sums"])
            out = np.zeros(len(parts[0]) // 8)
            for s in parts:
                out += np.frombuffer(s)
            return pd.DataFrame({"feature": [pdf["feature"].iloc[0]], "sums": [out.tobytes()]})

        met = data.mapInPandas(part, "feature int, sums binary").groupBy("feature").applyInPandas(add, "feature int, sums binary")
        got = {r["feature"]: np.frombuffer(r["sums"]).reshape(shape) for r in met.collect()}  # one row a feature
        shared.unpersist()
        return np.stack([got[f] for f in range(len(features))])

    for _ in range(rounds):
        questions, sums = [], None
        for _ in range(depth):
            question, found_sums = _best_question(sums_of(questions), 1 << len(questions), penalty)
            if question is None:
                break
            questions.append(question)
            sums = found_sums
        if sums is None:
            break
        # the last question's answer is the highest bit: its two sides stand one after another
        model.trees.append(Tree(questions, *_leaf_values(sums, rate, penalty)))
    return model


def chances(model, bins: str = "bins") -> Column:
    """Each class's probability. model: a broadcast Booster; bins: a column of :meth:`Booster.bins`."""

    @F.pandas_udf(T.ArrayType(T.DoubleType()))
    def said(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for some in batches:
            x = np.stack(some.to_numpy()).astype(np.int64) if len(some) else np.zeros((0, 1), np.int64)
            yield pd.Series(list(softmax(model.value.scores(x))) if len(x) else [], dtype=object)

    return said(F.col(bins))


def classify(rows: DataFrame, model: Booster) -> DataFrame:
    """The rows with ``predicted`` and ``confidence``; both are null where the fit had no class."""
    if len(model.classes) < 2:
        only = F.lit(model.classes[0]) if model.classes else F.lit(None).cast("string")
        return rows.withColumns({"predicted": only, "confidence": F.when(only.isNotNull(), F.lit(1.0))})
    shared = rows.sparkSession.sparkContext.broadcast(model)
    names = F.array(*(F.lit(c) for c in model.classes))
    said = rows.withColumn("bins", model.bins()).withColumn("_p", chances(shared))
    best = F.array_max("_p")
    return said.withColumns({"predicted": F.element_at(names, F.array_position("_p", best).cast("int")), "confidence": best}).drop("bins", "_p")


def route_by_boosting(rows: DataFrame, features: Sequence[str], label: str = "best", **how) -> DataFrame:
    """(series_id, horizon, truth, predicted, confidence) of test rows, from a fit on training rows (column ``split``)."""
    model = fit_booster(rows.where("split = 'train'"), features, label, ["series_id", "horizon"], **how)
    said = classify(rows.where("split = 'test'"), model)
    return said.select("series_id", "horizon", F.col(label).alias("truth"), "predicted", "confidence")
