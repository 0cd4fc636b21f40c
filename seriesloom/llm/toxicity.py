"""Toxicity scores by a classifier that changes of identity terms must not move.

A text's features are its words (lower case) and their beginnings of four to six letters, hashed to buckets, each with steps for how many different
words fall into it: languages that compose words show an insult by several words of one stem, where a single one may be chance. The model is
logistic with a lasso on its weights, so a word that tells nothing weighs exactly nothing and long texts do not add up noise.

Counterfactual regularisation: every sentence of a labelled text that names an identity term is written again with each other term
of the same kind, and with the kind's neutral words; the mean squared change of the score before the link function is added to the loss,
times ``fairness``. Where labels go along with a group's name (insults about it are collected, neutral mentions are not), the
weight moves from the name to the words that insult, since the swapped sentence keeps those.

It learns from at most ``sample_rows`` labelled texts of each label, those with the smallest hashes of their ids, equal texts once. Of all
features the ``n_features`` that tell the labels apart best are kept (chi-square over the sample), and all those of identity
terms. Every text is scored whole.

Defined cases: a null or empty text has the model's constant as its score; a row without an id is scored, is not held out and is not
learned from; a document is toxic if any of its rows of labels says 1, clean if one says 0 and none 1; labels that are null or of
unknown ids count for nothing; rows that repeat get equal scores and count once; with labels of one kind only the score is
that label's (0 or 1), without any it is 0; an empty table gives no rows; very long texts are scored whole; extra columns stay, but
for ones named ``score``, ``predicted`` or ``held_out``, which are replaced.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator, Mapping, Sequence
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import need, small_batches, written

BITS = 18
BEGINNINGS = (4, 5, 6)
#: A feature says that at least so many different words of a text fall into its bucket.
STEPS = (1, 2, 3, 5)
WIDTH = len(STEPS) << BITS
SAMPLE_ROWS = 8_000
N_FEATURES = 4_096
MEMO_ENTRIES = 200_000
#: Features that join the fit at a time.
JOINING = 200

#: Names of groups of people, by kind; the first of each language are neutral words that stand for anyone.
IDENTITY_TERMS: dict[str, list[str]] = {
    "people": "people persons humans citizens neighbours muslims christians jews hindus buddhists sikhs atheists catholics immigrants refugees foreigners asians africans americans europeans mexicans indians arabs blacks whites gays lesbians women men girls boys elders teenagers".split(),
    "person": "person human citizen neighbour muslim christian jew hindu buddhist sikh atheist catholic immigrant refugee foreigner asian african american european mexican indian arab woman man girl boy elder teenager".split(),
    "adjective": "ordinary local muslim christian jewish hindu buddhist black white asian african latino arab gay lesbian bisexual straight transgender female male old young disabled deaf blind poor rich".split(),
    "menschen": "menschen leute nachbarn muslime christen juden hindus buddhisten atheisten katholiken einwanderer asiaten afrikaner amerikaner araber schwarze frauen männer mädchen jungen alte behinderte".split(),
    "personnes": "personnes gens voisins musulmans chrétiens juifs hindous bouddhistes athées catholiques immigrés réfugiés étrangers asiatiques africains américains arabes noirs blancs femmes hommes filles garçons handicapés".split(),
    "personas": "personas gente vecinos musulmanes cristianos judíos hindúes budistas ateos católicos inmigrantes refugiados extranjeros asiáticos africanos americanos árabes negros blancos mujeres hombres chicas chicos discapacitados".split(),
}

_words = re.compile(r"\w+").findall
_sentences = re.compile(r"[^.!?\n]+").findall


def word_buckets(word: str) -> list[int]:
    """Buckets of a word (lower case) and of its beginnings."""
    names = [f"={word}", *(word[:k] for k in BEGINNINGS if len(word) >= k)]
    return [xxhash.xxh32_intdigest(n, 11) >> (32 - BITS) for n in names]


class Features:
    """Features of texts, with a memory of words of bounded size. kept: numbers of the features that count; all do without."""

    def __init__(self, kept: Mapping[int, int] | None = None) -> None:
        self._memo: dict[str, tuple[int, ...]] = {}
        self._kept = kept
        self._buckets = None if kept is None else {f // len(STEPS) for f in kept}

    def _of(self, word: str) -> tuple[int, ...]:
        found = dict.fromkeys(word_buckets(word))
        return tuple(found) if self._buckets is None else tuple(b for b in found if b in self._buckets)

    def of(self, text: str) -> list[int]:
        """The text's features, each once, ascending."""
        return self.of_words(set(_words(text.lower())))

    def of_words(self, words: set[str]) -> list[int]:
        memo = self._memo
        if len(memo) + len(words) > MEMO_ENTRIES:
            memo.clear()
        times: dict[int, int] = {}
        for w in words:
            if (got := memo.get(w)) is None:
                got = memo[w] = self._of(w)
            for b in got:
                times[b] = times.get(b, 0) + 1
        found = [b * len(STEPS) + k for b, n in times.items() for k, least in enumerate(STEPS) if n >= least]
        return sorted(found if self._kept is None else [self._kept[f] for f in found if f in self._kept])


def swaps(text: str, terms: Mapping[str, Sequence[str]]) -> Iterator[tuple[set[str], set[str]]]:
    """For each sentence, identity term in it and other term of the same kind: the words before and after the swap."""
    kinds: dict[str, list[str]] = {}
    for kind, names in terms.items():
        for n in names:
            kinds.setdefault(n, []).append(kind)
    for sentence in _sentences(text.lower()):
        words = set(_words(sentence))
        for term in sorted(words & kinds.keys()):
            for kind in kinds[term]:
                for other in terms[kind]:
                    if other != term:
                        yield words, words - {term} | {other}


@dataclass
class ToxicityModel:
    """Weights by feature and the constant."""

    constant: float
    weights: dict[int, float] = field(default_factory=dict)

    def features(self) -> Features:
        return Features({f: f for f in self.weights})

    def scores(self, texts: Sequence[str | None], features: Features) -> list[float]:
        return [_link(self.constant + math.fsum(self.weights[f] for f in features.of(t or ""))) for t in texts]


def _link(z: float) -> float:
    if z == math.inf:
        return 1.0
    return 1.0 / (1.0 + math.exp(-z)) if z > -700 else 0.0


class _Rows:
    """Sparse rows of zeros and plus or minus ones, for products with a vector from either side."""

    def __init__(self, rows: list[np.ndarray], signs: list[np.ndarray] | None, width: int) -> None:
        self.at = np.concatenate(rows) if rows else np.zeros(0, np.int64)
        self.sign = np.concatenate(signs) if signs else None
        self.row = np.repeat(np.arange(len(rows)), [len(r) for r in rows]) if rows else np.zeros(0, np.int64)
        self.n, self.width = len(rows), width

    def only(self, columns: np.ndarray) -> _Rows:
        """The same rows with these columns alone, numbered anew."""
        number = np.full(self.width, -1)
        number[columns] = np.arange(len(columns))
        keep = number[self.at] >= 0
        out = _Rows([], None, len(columns))
        out.at, out.row, out.n = number[self.at[keep]], self.row[keep], self.n
        out.sign = None if self.sign is None else self.sign[keep]
        return out

    def times(self, w: np.ndarray) -> np.ndarray:
        v = w[self.at]
        return np.bincount(self.row, v if self.sign is None else v * self.sign, self.n)

    def transposed(self, g: np.ndarray) -> np.ndarray:
        v = g[self.row]
        return np.bincount(self.at, v if self.sign is None else v * self.sign, self.width)


def fit_weights(rows: list[np.ndarray], toxic: np.ndarray, before: list[np.ndarray], after: list[np.ndarray], times: np.ndarray, width: int, fairness: float = 1.0, lasso: float = 5e-4, ridge: float = 1e-4, rounds: int = 3000, least_change: float = 1e-5) -> tuple[float, np.ndarray]:
    """The constant and the weights. Both labels weigh a half in the loss; accelerated proximal steps of a fixed length, until
    a round changes no weight by more than ``least_change``; momentum starts anew where it leads uphill. The steepest features join a few at a time;
    it ends when no other's slope could move it from zero, so the result is that of all features.

    before, after: features of the sentences and of their swapped forms; times: how often each such pair stands in the sample.
    """
    gone, come = ([np.setdiff1d(a, b) for a, b in zip(one, other, strict=True)] for one, other in ((before, after), (after, before)))
    x = _Rows(rows, None, width)
    pairs = _Rows([np.concatenate(p) for p in zip(gone, come, strict=True)], [np.repeat([1.0, -1.0], [len(g), len(c)]) for g, c in zip(gone, come, strict=True)], width)
    share = np.where(toxic, 0.5 / max(toxic.sum(), 1), 0.5 / max((~toxic).sum(), 1))
    cf = fairness * times / times.sum() if len(times) else np.zeros(0)

    def slope(some: _Rows, some_pairs: _Rows, w: np.ndarray, c: float) -> tuple[np.ndarray, float]:
        z = some.times(w) + c
        g = share * (1.0 / (1.0 + np.exp(-np.clip(z, -500, 500))) - toxic)
        return some.transposed(g) + 2 * some_pairs.transposed(cf * some_pairs.times(w)) + ridge * w, float(g.sum())

    # a feature whose slope is below the lasso stays at zero; the steepest others join a few at a time, until there is none
    w, c, active = np.zeros(width), 0.0, np.zeros(width, bool)
    while True:
        steep = np.where(active, 0.0, np.abs(slope(x, pairs, w, c)[0]))
        late = np.flatnonzero(steep > lasso * 1.001)
        if not len(late) and active.any():
            return c, w
        active[late[np.argsort(-steep[late], kind="stable")][:JOINING]] = True
        at = np.flatnonzero(active)
        w[at], c = _descend(x.only(at), pairs.only(at), w[at], c, share, cf, slope, lasso, ridge, rounds, least_change)
        if not len(at):
            return c, w


def _descend(x: _Rows, pairs: _Rows, w: np.ndarray, c: float, share: np.ndarray, cf: np.ndarray, slope, lasso: float, ridge: float, rounds: int, least_change: float) -> tuple[np.ndarray, float]:
    u, d = np.random.default_rng(0).random(len(w)), 1.0
    for _ in range(30):  # the largest curvature bounds the step
        size = math.sqrt(float(u @ u) + d * d) or 1.0
        u, d = u / size, d / size
        z = 0.25 * share * (x.times(u) + d)
        u, d = x.transposed(z) + 2 * pairs.transposed(cf * pairs.times(u)) + ridge * u, float(z.sum())
    step = 1.0 / (1.1 * math.sqrt(float(u @ u) + d * d) + 1e-9)

    v, d, t = w, c, 1.0
    for _ in range(rounds):
        g, g0 = slope(x, pairs, v, d)
        u = v - step * g
        new_w, new_c = np.sign(u) * np.maximum(np.abs(u) - step * lasso, 0.0), d - step * g0
        if (v - new_w) @ (new_w - w) + (d - new_c) * (new_c - c) > 0:
            t = 1.0
        faster = (1 + math.sqrt(1 + 4 * t * t)) / 2
        v, d = new_w + (t - 1) / faster * (new_w - w), new_c + (t - 1) / faster * (new_c - c)
        moved = max(float(np.abs(new_w - w).max(initial=0.0)), abs(new_c - c))
        w, c, t = new_w, new_c, faster
        if moved < least_change:
            break
    return w, c


def labelled_sample(docs: DataFrame, labels: DataFrame, rows: int) -> DataFrame:
    """(toxic, text) of at most so many documents of each label; equal texts of a label once."""
    marks = labels.where("doc_id is not null and toxic in (0, 1)").groupBy("doc_id").agg((F.max("toxic") == 1).alias("toxic"))
    order = [F.xxhash64("doc_id", F.lit(5)), F.col("doc_id")]
    chosen = marks.where("toxic").orderBy(*order).limit(rows).unionByName(marks.where("not toxic").orderBy(*order).limit(rows))
    texts = docs.select(F.col("doc_id").alias("_sl_id"), F.coalesce("text", F.lit("")).alias("text"))
    found = texts.join(F.broadcast(chosen), F.col("_sl_id") == F.col("doc_id"))  # at most twice `rows` ids
    return found.groupBy("toxic", F.sha2("text", 256).alias("same")).agg(F.first("text").alias("text")).select("toxic", "text")


def _counts(sample: DataFrame) -> tuple[np.ndarray, int, int]:
    """Texts of each label by feature, and of each label: one vector from each task, summed by feature."""

    def part(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        features, total, texts = Features(), np.zeros((2, WIDTH), np.int32), [0, 0]
        for pdf in batches:
            for toxic, text in zip(pdf["toxic"], pdf["text"], strict=True):
                total[int(toxic), features.of(text)] += 1
                texts[int(toxic)] += 1
        at = np.flatnonzero(total.any(axis=0))
        yield pd.DataFrame({"feature": [*at, -1], "clean": [*total[0, at], texts[0]], "toxic": [*total[1, at], texts[1]]})

    out, seen = np.zeros((2, WIDTH), np.int64), (0, 0)
    for r in sample.mapInPandas(part, "feature int, clean long, toxic long").groupBy("feature").agg(F.sum("clean").alias("clean"), F.sum("toxic").alias("toxic")).collect():
        if r["feature"] < 0:
            seen = r["clean"], r["toxic"]
        else:
            out[:, r["feature"]] = r["clean"], r["toxic"]
    return out, *seen


def choose_features(counts: np.ndarray, clean: int, toxic: int, always: set[int], n: int) -> list[int]:
    """The features of largest chi-square between label and presence, and those that must be there."""
    a, b = counts[1].astype(float), counts[0].astype(float)
    held, total = a + b, clean + toxic
    off = a * (clean - b) - b * (toxic - a)
    with np.errstate(divide="ignore", invalid="ignore"):
        chi = np.nan_to_num(total * off * off / (held * (total - held) * clean * toxic))
    best = np.lexsort((np.arange(len(chi)), -chi))[:n]
    return sorted({int(k) for k in best if chi[k] > 0} | {k for k in always if held[k]})


def train(docs: DataFrame, labels: DataFrame, sample_rows: int = SAMPLE_ROWS, n_features: int = N_FEATURES, fairness: float = 1.0, terms: Mapping[str, Sequence[str]] = IDENTITY_TERMS, **options) -> ToxicityModel:
    """Fit on a bounded sample of labelled rows. Tasks find features and swapped sentences; the driver gets kept features only."""
    need(docs, "doc_id", "text")
    need(labels, "doc_id", "toxic")
    sample = written(labelled_sample(docs, labels, sample_rows), "labelled")
    counts, clean, toxic = _counts(sample)
    if not clean or not toxic:
        return ToxicityModel(math.inf if toxic else -math.inf)
    named = {f for names in terms.values() for n in names for b in word_buckets(n) for f in range(b * len(STEPS), (b + 1) * len(STEPS))}
    kept = {f: k for k, f in enumerate(choose_features(counts, clean, toxic, named, n_features))}

    def part(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        features = Features(kept)
        pack = lambda ks: np.asarray(ks, np.int32).tobytes()
        for pdf in batches:
            out = []
            for toxic, text in zip(pdf["toxic"], pdf["text"], strict=True):
                out.append((int(toxic), pack(features.of(text)), b""))
                for before, after in swaps(text, terms):
                    a, b = features.of_words(before), features.of_words(after)
                    if a != b:
                        out.append((2, pack(sorted(set(a) - set(b))), pack(sorted(set(b) - set(a)))))
            yield pd.DataFrame(out, columns=["kind", "a", "b"])

    rows = sample.mapInPandas(part, "kind int, a binary, b binary").groupBy("kind", "a", "b").count().orderBy("kind", "a", "b").collect()
    unpack = lambda v: np.frombuffer(bytes(v), np.int32).astype(np.int64)
    x = [(unpack(r["a"]), r["kind"] == 1) for r in rows if r["kind"] < 2 for _ in range(r["count"])]
    pairs = [r for r in rows if r["kind"] == 2]
    c, w = fit_weights([f for f, _ in x], np.array([t for _, t in x], bool), [unpack(r["a"]) for r in pairs], [unpack(r["b"]) for r in pairs], np.array([r["count"] for r in pairs], float), len(kept), fairness, **options)
    return ToxicityModel(c, {f: float(w[k]) for f, k in kept.items() if w[k]})


def toxicity(text: Column, model) -> Column:
    """The score of each text, from 0 to 1. model: a broadcast ToxicityModel."""

    @F.pandas_udf(T.DoubleType())
    def score(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        m = model.value
        features = m.features()
        for texts in batches:
            yield pd.Series(m.scores(texts, features), dtype=float)

    return score(text)


def held_out(id_col: str = "doc_id") -> Column:
    """Whether the checksum of the id is divisible by five: these rows are never learned from."""
    return F.coalesce(F.crc32(F.col(id_col).cast("string").cast("binary")) % 5 == 0, F.lit(False))


def score_documents(docs: DataFrame, labels: DataFrame, **options) -> DataFrame:
    """Every document with held_out, score and predicted, learned from the labels of those that are not held out."""
    small_batches(docs.sparkSession)
    model = docs.sparkSession.sparkContext.broadcast(train(docs, labels.where(~held_out()), **options))
    scored = docs.withColumn("held_out", held_out()).withColumn("score", toxicity(F.col("text"), model))
    return scored.withColumn("predicted", (F.col("score") >= 0.5).cast("int"))


def op11_toxicity(spark, sf_dir: str) -> DataFrame:
    from .common import table

    return score_documents(table(spark, sf_dir, "documents").select("doc_id", "text"), table(spark, sf_dir, "labels")).drop("text")
