"""Personal data by weak supervision: labelers vote, expectation-maximisation weighs them, a span classifier decides.

Candidates are spans of four kinds. The base patterns' valid matches always stay. Narrower patterns propose further
spans where no base span of the kind lies: numbers that a greedy base match has swallowed together with their
neighbours, phone numbers without a plus, obfuscated mail addresses. Labelers vote on every candidate of all texts:

* regex: the candidate is a base match (for), is a base match that failed its test (against), or is neither;
* form: checksum, number range, digits of a numbering plan, or a plausible top domain;
* gazetteer: known top domains, issuers' first digits, country codes, unroutable addresses;
* context: words nearby that go, or don't go, with the kind;
* edges: the span stands by itself, or is part of a longer run.

Counts of vote patterns by the spans' shapes over all documents (there are at most 4 * 3**5 * 36) go to the driver, where a
two-class model with one reliability per kind, labeler and class is fitted to the votes by expectation-maximisation. Its
posteriors, as soft labels, train a logistic span classifier over kind, votes and what no labeler sees: the span's shape
(its length, its separators, whether letters stand before it), by itself and with the kind. The classifier accepts a further span at
``threshold``; so two spans with equal votes can be judged differently.

Defined cases: null is the empty text; texts are read whole; offsets count code points, ends exclusive; rows that
repeat are handled alike, and overlapping spans of several kinds all stay; no candidates, and an empty table, give no added spans;
columns besides the text are kept, but for one named ``spans`` (:func:`find_spans`) or ``_sl_found``, which is replaced.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import need, small_batches, written

KINDS = ("email", "ip", "card", "phone")
LABELERS = ("regex", "form", "gazetteer", "context", "edges")
VOTES = 3
PATTERNS = VOTES ** len(LABELERS)
#: Parts of a span's shape: length, number of kinds of separators, what stands before.
SHAPE = (4, 3, 3)
SHAPES = SHAPE[0] * SHAPE[1] * SHAPE[2]

# Gazetteers; fixed values.
TOP_DOMAINS = frozenset("com org net edu gov info biz io de fr es it uk eu ch at nl be us ca au jp example test".split())
COUNTRY_CODES = frozenset("1 7 20 27 30 31 32 33 34 36 39 40 41 43 44 45 46 47 48 49 51 52 54 55 56 57 61 62 63 64 65 66 81 82 84 86 90 91 351 352 353 354 358".split())
NEAR_WORDS = {
    "email": frozenset("mail email e-mail contact write correo courriel kontakt".split()),
    "ip": frozenset("ip host server address addr client dirección adresse".split()),
    "card": frozenset("card visa mastercard amex credit tarjeta carte karte".split()),
    "phone": frozenset("phone tel call mobile fax teléfono téléphone telefon".split()),
}
FAR_WORDS = frozenset("version release build isbn order invoice token password key serial".split())

LOCAL = "[A-Za-z0-9._%+-]"
LOCAL_SIGNS = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-"
DOMAIN = re.compile(r"[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++")
ZONE = re.compile(r"[0-9+(][0-9+(). -]*")
IP = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}")
CARD = re.compile(r"[0-9](?:[ -]?[0-9])++")
PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
MORE = {
    "card": re.compile(r"(?<![0-9])(?:[0-9]{4}([ -])[0-9]{4}\1[0-9]{4}\1[0-9]{4}|[0-9]{16,19}|3[47][0-9]{13})(?![0-9])"),
    "phone": re.compile(r"(?:\+[0-9]{1,3}[ .-]?\(?[0-9]{2,4}\)?[ .-]?[0-9]{3,4}[ .-]?[0-9]{4}|(?<![0-9+.])(?<!\+[0-9] )(?<!\+[0-9]{2} )(?:\([2-9][0-9]{2}\) ?|[2-9][0-9]{2}[.-])[0-9]{3}[ .-][0-9]{4})(?![0-9])"),
    "ip": re.compile(r"(?<![0-9.])[0-9]{1,3}(?:\.[0-9]{1,3}){3}(?![0-9])(?!\.[0-9])"),
}
HIDDEN_MAIL = re.compile(r"([A-Za-z0-9._%+-]{1,64}) ?[\[(](?:at|AT)[\])] ?([A-Za-z0-9-]{1,63}(?: ?(?:\.|[\[(](?:dot|DOT)[\])]) ?[A-Za-z0-9-]{1,63}){1,6})")


def luhn(digits: str) -> bool:
    double = str.maketrans("0123456789", "0246813579")
    return (sum(map(int, digits[-1::-2])) + sum(map(int, digits[-2::-2].translate(double)))) % 10 == 0


def _digits(s: str) -> str:
    return "".join(filter(str.isdigit, s))


def base_matches(text: str) -> dict[str, list[tuple[int, int, bool]]]:
    """(start, end, passed) of each base pattern's matches, leftmost and not overlapping within a kind."""
    found: dict[str, list[tuple[int, int, bool]]] = {k: [] for k in KINDS}
    at, floor = text.find("@"), 0
    while at >= 0:
        start = len(text[floor:at].rstrip(LOCAL_SIGNS)) + floor
        after = at + 1
        if start < at and (m := DOMAIN.match(text, at + 1)):
            found["email"].append((start, m.end(), True))
            after = floor = m.end()
        else:
            floor = at + 1
        at = text.find("@", after)
    for zone in ZONE.finditer(text):
        a, b = zone.span()
        if b - a < 7:
            continue
        found["ip"] += [(*m.span(), all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or "0") <= 255 for p in m[0].split("."))) for m in IP.finditer(text, a, b)]
        found["card"] += [(*m.span(), 16 <= len(d) <= 19 and luhn(d)) for m in CARD.finditer(text, a, b) if (d := _digits(m[0]))]
        found["phone"] += [(*m.span(), 8 <= len(_digits(m[0])) <= 15) for m in PHONE.finditer(text, a, b)]
    return found


def further_matches(text: str, base: dict[str, list[tuple[int, int, bool]]]) -> Iterator[tuple[str, int, int]]:
    """(kind, start, end) that the narrower patterns propose, clear of base spans of their kind."""
    if "(" in text or "[" in text:
        for m in HIDDEN_MAIL.finditer(text) if re.search(r"[\[(](?:at|AT)[\])]", text) else ():
            yield "email", *m.span()
    for zone in ZONE.finditer(text):
        a, b = zone.span()
        if b - a < 7:
            continue
        for kind, pattern in MORE.items():
            held = [s for s in base[kind] if s[2] and s[0] < b and s[1] > a]
            for m in pattern.finditer(text, a, b):
                if all(m.end() <= s or m.start() >= e for s, e, _ in held):
                    yield kind, *m.span()


def votes(text: str, kind: str, start: int, end: int, regex: int) -> list[int]:
    """Each labeler's vote: 1 for, -1 against, 0 none."""
    span = text[start:end]
    digits = _digits(span)
    if kind == "email":
        top = re.split(r"[^A-Za-z0-9-]+", span.rstrip(")]"))[-1].lower()
        form, gazetteer = 1 if top.isalpha() and len(top) > 1 else -1, 1 if top in TOP_DOMAINS else 0
    elif kind == "ip":
        parts = [int(p) if len(p) < 10 else 999 for p in span.split(".")]
        form = 1 if max(parts) <= 255 and not any(len(p) > 1 and p[0] == "0" for p in span.split(".")) else -1
        gazetteer = -1 if parts[0] in (0, 255) else 1 if parts[0] in (10, 127, 172, 192) else 0
    elif kind == "card":
        form = 1 if 15 <= len(digits) <= 19 and luhn(digits) else -1
        gazetteer = 1 if digits[0] in "456" or digits[:2] in ("34", "37") else -1
    else:
        form = 1 if 10 <= len(digits) <= 15 else -1
        gazetteer = 1 if span[0] != "+" or any(digits[:n] in COUNTRY_CODES for n in (1, 2, 3)) else -1
    near = set(re.findall(r"[^\W\d_]+(?:-[^\W\d_]+)?", text[max(0, start - 40) : start].lower())[-4:])
    context = 1 if near & NEAR_WORDS[kind] else -1 if near & FAR_WORDS else 0
    before, after = text[start - 1 : start], text[end : end + 1]
    edges = -1 if before.isalnum() or after.isalnum() or before in ("=", "_", "/") else 1
    return [regex, form, gazetteer, context, edges]


def _candidates(text: str) -> list[tuple[int, int, int, bool, int, bool]]:
    """(kind, start, end, base, pattern of votes and shape, usable); failed base matches count for the statistics only."""
    base = base_matches(text)
    out = []
    code = lambda kind, start, end, regex: _code(votes(text, kind, start, end, regex)) + PATTERNS * shape(text, start, end)
    for k, kind in enumerate(KINDS):
        for start, end, passed in base[kind]:
            out.append((k, start, end, passed, code(kind, start, end, 1 if passed else -1), passed))
    for kind, start, end in further_matches(text, base):
        out.append((KINDS.index(kind), start, end, False, code(kind, start, end, 0), True))
    return out


def shape(text: str, start: int, end: int) -> int:
    """A number for the span's length, its separators, and the character before it (none or space, letter, other)."""
    span = text[start:end]
    length = min(SHAPE[0] - 1, (end - start) // 8)
    separators = min(SHAPE[1] - 1, len({c for c in span if c in " .-()"}))
    before = text[start - 1 : start]
    edge = 0 if not before or before.isspace() else 1 if before.isalpha() else 2
    return (length * SHAPE[1] + separators) * SHAPE[2] + edge


def _code(v: list[int]) -> int:
    return sum((x + 1) * VOTES**i for i, x in enumerate(v))


def candidates(text: Column) -> Column:
    """An array of structs (kind, start, end, base, pattern, usable) for each text."""

    @F.pandas_udf("array<struct<kind:int,start:int,end:int,base:boolean,pattern:int,usable:boolean>>")
    def find(texts: pd.Series) -> pd.Series:
        names = ("kind", "start", "end", "base", "pattern", "usable")
        return pd.Series([[dict(zip(names, c, strict=True)) for c in _candidates(t)] for t in texts], dtype=object)

    return find(F.coalesce(text, F.lit("")))


ALL_VOTES = np.array([[p // VOTES**i % VOTES for i in range(len(LABELERS))] for p in range(PATTERNS)])


def reliabilities(counts: np.ndarray, rounds: int = 50, prior: float = 2.0) -> tuple[np.ndarray, np.ndarray]:
    """Posteriors [kind, pattern] and vote probabilities [kind, class, labeler, vote], from counts [kind, pattern].

    Starts from each pattern's majority; the pseudo-counts say that votes for go with true spans and votes against
    with false ones.
    """
    score = (ALL_VOTES - 1).sum(axis=1)
    post = np.tile(1 / (1 + np.exp(-2.0 * score)), (len(KINDS), 1))
    onehot = (ALL_VOTES[:, :, None] == np.arange(VOTES)).astype(float)  # pattern, labeler, vote
    lean = np.array([[0.6, 0.3, 0.1], [0.1, 0.3, 0.6]]) * prior  # class, vote
    for _ in range(rounds):
        weight = np.stack([counts * (1 - post), counts * post], axis=1)  # kind, class, pattern
        table = np.einsum("kcp,plv->kclv", weight, onehot) + lean[None, :, None, :]
        table /= table.sum(axis=3, keepdims=True)
        share = weight.sum(axis=2) + prior
        share /= share.sum(axis=1, keepdims=True)
        log = np.log(share)[:, :, None] + np.einsum("kclv,plv->kcp", np.log(table), onehot)
        post = 1 / (1 + np.exp(np.clip(log[:, 0] - log[:, 1], -500, 500)))
    return post, table


def span_classifier(counts: np.ndarray, post: np.ndarray, rounds: int = 200, penalty: float = 1e-2) -> np.ndarray:
    """Probabilities [kind, shape, pattern] of the cells that occur (zero elsewhere), by logistic regression on soft labels weighted by counts.

    counts: [kind, shape, pattern]; post: [kind, pattern].
    """
    k, f, p = np.nonzero(counts)
    out = np.zeros(counts.shape)
    if not len(k):
        return out
    parts = [f // (SHAPE[1] * SHAPE[2]), f // SHAPE[2] % SHAPE[1], f % SHAPE[2]]
    own = np.eye(len(KINDS))[k]
    looks = np.hstack([np.eye(n)[v] for n, v in zip(SHAPE, parts, strict=True)])
    said = np.hstack([np.eye(VOTES)[ALL_VOTES[p, i]] for i in range(len(LABELERS))])
    x = np.hstack([own, said, looks, (own[:, :, None] * looks[:, None, :]).reshape(len(k), -1)])
    y, w = post[k, p], np.log1p(counts[k, f, p])
    theta = np.zeros(x.shape[1])
    for _ in range(rounds):
        guess = 1 / (1 + np.exp(-x @ theta))
        gradient = x.T @ (w * (guess - y)) + penalty * theta
        curve = (x * (w * guess * (1 - guess))[:, None]).T @ x + np.eye(len(theta)) * max(penalty, 1e-6)
        step = np.linalg.solve(curve, gradient)
        theta -= np.clip(step, -2, 2)
        if np.abs(step).max() < 1e-8:
            break
    out[k, f, p] = 1 / (1 + np.exp(-x @ theta))
    return out


def accepted_patterns(found: DataFrame, threshold: float = 0.9) -> list[int]:
    """Codes (kind, shape and pattern of votes) of further candidates that the classifier takes; found: rows with _sl_found."""
    seen = found.select(F.explode("_sl_found").alias("c")).groupBy("c.kind", "c.pattern").count().collect()  # at most 4 * 3**5 * 36 rows
    counts = np.zeros((len(KINDS), SHAPES, PATTERNS))
    for r in seen:
        counts[r["kind"], r["pattern"] // PATTERNS, r["pattern"] % PATTERNS] = r["count"]
    accepted = span_classifier(counts, reliabilities(counts.sum(axis=1))[0]) >= threshold
    return [int((k * SHAPES + f) * PATTERNS + p) for k, f, p in zip(*np.nonzero(accepted), strict=True)]


def chosen_spans(found: Column, codes: list[int]) -> Column:
    """The base spans and the accepted further ones, in order of kind and start."""
    added = F.array(*(F.lit(c) for c in codes)) if codes else F.array().cast("array<int>")
    keep = lambda c: c["base"] | (c["usable"] & F.array_contains(added, c["kind"] * (SHAPES * PATTERNS) + c["pattern"]))
    short = lambda c: F.struct(c["kind"].alias("kind"), c["start"].alias("start"), c["end"].alias("end"), c["base"].alias("base"))
    return F.array_sort(F.transform(F.filter(found, keep), short))


def find_spans(docs: DataFrame, text_col: str = "text", threshold: float = 0.9) -> DataFrame:
    """The rows without their text, with ``spans``: an array of (kind, start, end, base), in order of kind and start."""
    need(docs, text_col)
    small_batches(docs.sparkSession)
    rest = [c for c in docs.columns if c not in (text_col, "spans", "_sl_found")]
    found = written(docs.select(*rest, candidates(F.col(text_col)).alias("_sl_found")), "pii")
    return found.select(*rest, chosen_spans(F.col("_sl_found"), accepted_patterns(found, threshold)).alias("spans"))


def hide_spans(docs: DataFrame, text_col: str = "text", threshold: float = 0.9) -> DataFrame:
    """The rows with every span of their text replaced by its kind; candidates are found again rather than joined to texts."""
    need(docs, text_col)
    small_batches(docs.sparkSession)
    found = docs.withColumn("_sl_found", candidates(F.col(text_col)))
    codes = accepted_patterns(found.select("_sl_found"), threshold)
    return found.withColumn(text_col, mask(F.col(text_col), chosen_spans(F.col("_sl_found"), codes))).drop("_sl_found")


def span_list(spans: Column) -> Column:
    names = F.array(*(F.lit(k) for k in KINDS))
    return F.array_join(F.transform(spans, lambda c: F.concat_ws(":", F.element_at(names, c["kind"] + 1), c["start"], c["end"])), ",")


def mask(text: Column, spans: Column) -> Column:
    """The text with each span (overlapping ones together) replaced by its kind in angle brackets."""

    @F.pandas_udf("string")
    def hide(texts: pd.Series, lists: pd.Series) -> pd.Series:
        out = []
        for text, found in zip(texts, lists, strict=True):
            if text is None or found is None or not len(found):
                out.append(text)
                continue
            parts, at = [], 0
            for c in sorted(found, key=lambda c: (c["start"], -c["end"])):
                if c["start"] >= at:
                    parts += [text[at : c["start"]], f"<{KINDS[c['kind']].upper()}>"]
                at = max(at, c["end"])
            out.append("".join(parts) + text[at:])
        return pd.Series(out, dtype=object)

    return hide(text, spans)


def op5_pii(spark, sf_dir: str) -> DataFrame:
    from .common import table

    found = find_spans(table(spark, sf_dir, "documents").select("doc_id", "text"))
    base = F.filter("spans", lambda c: c["base"])
    number = lambda k: F.size(F.filter("spans", lambda c: c["base"] & (c["kind"] == k))).cast("long")
    return found.select("doc_id", *(number(k).alias(f"n_{name}") for k, name in enumerate(KINDS)), F.sha2(span_list(base), 256).alias("base_sha256"), span_list(F.col("spans")).alias("spans"))
