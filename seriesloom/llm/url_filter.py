"""URL filters: host and path rules first, then a learned verdict.

A rule is a host with a path prefix; it fits the host and all its subdomains; the longest rule that fits wins.
Where none fits, host labels are split into words by a unigram Viterbi search, and multinomial naive Bayes over the
words and the path's tokens decides; it learns from the URLs that a rule covers, all of them.

Word counts come from all pages' visible text. All words and all tokens count, however rare; neither list is collected or
broadcast: the stretches of each distinct host are joined with the word counts, and the tokens of each distinct
host and path with the tokens' odds.

Defined cases: a null URL, or one without ``://``, has empty host and path, fits no rule and is judged by the prior;
equal scores allow; rows that repeat are judged alike, and are counted by their number of times, not written out;
words and hosts may be of any length (work grows with the square of a run of letters in a host); with no URL under a rule, all others are allowed; a null page
is judged by its URL and adds no words; an empty table gives no rows; extra columns are ignored.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import ascii_lower, need, written

#: Stretches of hosts that a task yields at a time.
STRETCHES = 50_000
PIECES = re.compile(r"[a-z]+|[0-9]+")
PARTS = re.compile(r"[^\W_]+")

#: The production rules: (verdict, host and path). Fixed values.
RULES = [
    ("allow", "org/"),
    ("block", "example.org/es/"),
    ("block", "example.org/en/1"),
    ("allow", "com/fr/"),
    ("block", "com/de/"),
]


def host_and_path(url: Column) -> tuple[Column, Column]:
    at = F.instr(url, "://")
    rest = F.when(at > 0, F.substring(url, at + 3, F.length(url))).otherwise(F.lit(""))
    rest = F.coalesce(rest, F.lit(""))
    return ascii_lower(F.regexp_extract(rest, r"^[^/?#]*", 0)), F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1)


def rule_of(host: Column, path: Column, rules: list[tuple[str, str]]) -> tuple[Column, Column]:
    """The longest rule that fits and its verdict, or null."""
    rule = verdict = None
    for says, text in sorted(rules, key=lambda r: (-len(r[1]), r[1])):
        at = text.index("/")
        name, prefix = text[:at], text[at:]
        fits = ((host == name) | host.endswith("." + name)) & path.startswith(prefix)
        rule = F.when(fits, F.lit(text)) if rule is None else rule.when(fits, F.lit(text))
        verdict = F.when(fits, F.lit(says)) if verdict is None else verdict.when(fits, F.lit(says))
    none = F.lit(None).cast("string")
    return (none, none) if rule is None else (rule, verdict)


def word_counts(pages: DataFrame, html_col: str = "html") -> DataFrame:
    """(word, n): all words of the pages' visible text."""
    text = F.regexp_replace(F.coalesce(F.col(html_col), F.lit("")), r"(?s)<(?:script|style)\b.*?</(?:script|style)>|<[^>]*>", " ")
    words = pages.select(F.explode(F.split(F.lower(text), r"[^a-z]+")).alias("word")).where(F.length("word") > 0)
    return written(words.groupBy("word").agg(F.count("*").alias("n")), "words")


def segment(name: str, words: dict[str, float], unknown: float = -12.0) -> list[str]:
    """The most probable split of a name into words; letters that no word covers cost ``unknown`` each."""
    best, longest = [0.0] + [-math.inf] * len(name), max(map(len, words), default=1)
    back = [0] * (len(name) + 1)
    for end in range(1, len(name) + 1):
        for start in range(max(0, end - longest), end):
            cost = words.get(name[start:end])
            if cost is None:
                if end - start > 1:
                    continue
                cost = unknown
            if best[start] + cost > best[end]:
                best[end], back[end] = best[start] + cost, start
    parts, end = [], len(name)
    while end:
        parts.append(name[back[end] : end])
        end = back[end]
    return parts[::-1]


def host_words(hosts: DataFrame, counts: DataFrame) -> DataFrame:
    """(host, words): the words of each distinct host's labels, split by the counts (word, n) of its own stretches."""

    total, longest = counts.agg(F.sum("n"), F.max(F.length("word"))).first()

    def stretches(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        """All stretches of a host's letters that may be words: none is longer than the longest word."""
        frame = lambda rows: pd.DataFrame(rows, columns=["host", "word"], dtype=object)
        for pdf in batches:
            out: list[tuple[str, str]] = []
            for host in pdf["host"]:
                for p in {p for p in PIECES.findall(host) if p[0] > "9"}:
                    for i in range(len(p)):
                        out += [(host, p[i:j]) for j in range(i + 1, min(len(p), i + (longest or 0)) + 1)]
                        if len(out) > STRETCHES:
                            yield frame(out)
                            out = []
            yield frame(out)

    @F.pandas_udf(T.ArrayType(T.StringType()))
    def split(names: pd.Series, words: pd.Series, times: pd.Series) -> pd.Series:
        out = []
        for host, known, n in zip(names, words, times, strict=True):
            costs = {} if known is None else {w: math.log(k / total) for w, k in zip(known, n, strict=True)}
            out.append(["h:" + w for p in PIECES.findall(host) for w in (segment(p, costs) if p[0] > "9" else [f"#{len(p)}"])])
        return pd.Series(out, dtype=object)

    each = hosts.select("host").distinct()
    found = each.mapInPandas(stretches, "host string, word string").join(counts, "word")
    known = found.groupBy("host").agg(F.collect_set(F.struct("word", "n")).alias("known"))
    return each.join(known, "host", "left").select("host", split("host", F.col("known.word"), F.col("known.n")).alias("words"))


@F.pandas_udf(T.ArrayType(T.StringType()))
def path_tokens(paths: pd.Series) -> pd.Series:
    """The path's tokens, numbers by their length."""
    return pd.Series([[f"p:#{len(t)}" if t.isdecimal() else "p:" + t for t in PARTS.findall(p.lower())] for p in paths], dtype=object)


def token_odds(labelled: DataFrame) -> tuple[DataFrame, float]:
    """(token, odds): log odds of block against allow for each token; and the prior's, from rows (tokens, verdict, times)."""
    seen, blocked = F.sum("times").alias("all"), F.sum(F.when(F.col("verdict") == "block", F.col("times")).otherwise(0)).alias("block")
    prior = labelled.agg(seen, blocked).first()
    counts = labelled.select("verdict", "times", F.explode("tokens").alias("token")).groupBy("token").agg(seen, blocked)
    counts = written(counts, "tokens")
    totals = counts.agg(F.sum("all").alias("all"), F.sum("block").alias("block"), F.count("*").alias("kinds")).first()
    n, bad, v = totals["all"] or 0, totals["block"] or 0, totals["kinds"] + 1
    odds = F.log((F.col("block") + 1) / F.lit(float(bad + v))) - F.log((F.col("all") - F.col("block") + 1) / F.lit(float(n - bad + v)))
    some = prior["all"] or 0
    return counts.select("token", odds.alias("odds")), math.log(((prior["block"] or 0) + 1) / (some - (prior["block"] or 0) + 1)) if some else 0.0


def naive_bayes(labelled: DataFrame) -> tuple[dict[str, float], float]:
    """:func:`token_odds` of a small table of single rows, as a dictionary; the filter itself joins the odds."""
    odds, prior = token_odds(labelled.withColumn("times", F.lit(1)))
    return {r["token"]: r["odds"] for r in odds.collect()}, prior


def url_filter(pages: DataFrame, rules: list[tuple[str, str]] = RULES) -> DataFrame:
    """(page_id, host, path, rule, verdict, score) of every page; score: log odds of block, where no rule fits."""
    need(pages, "page_id", "url", "html")
    host, path = host_and_path(F.col("url"))
    parts = pages.select("page_id", host.alias("host"), path.alias("path"))
    rule, says = rule_of(F.col("host"), F.col("path"), rules)
    cut = written(parts.withColumns({"rule": rule, "says": says}), "urls")
    words = written(host_words(cut, word_counts(pages)), "host-words")
    same = ["host", "path"]
    urls = cut.groupBy(*same, "says").agg(F.count("*").alias("times")).join(words, "host")
    urls = written(urls.select(*same, "says", "times", F.concat("words", path_tokens("path")).alias("tokens")), "url-tokens")
    labelled = urls.where("says is not null").select("tokens", F.col("says").alias("verdict"), "times")
    odds, prior = token_odds(labelled)
    # summed in the order of the tokens, so that scores are equal whatever the order of rows
    open_urls = urls.where("says is null")
    found = open_urls.select(*same, F.posexplode("tokens").alias("at", "token")).join(odds, "token")
    found = found.groupBy(*same).agg(F.array_sort(F.collect_list(F.struct("at", "odds"))).alias("found"))
    total = F.aggregate("found", F.lit(0.0), lambda x, f: x + f["odds"])
    scores = open_urls.select(*same).join(found, same, "left").select(*same, (F.lit(prior) + F.coalesce(total, F.lit(0.0))).alias("model"))
    judged = cut.join(scores, same, "left")
    by_model = judged.withColumn("score", F.when(F.col("says").isNull(), F.col("model")))
    verdict = F.coalesce("says", F.when(F.col("score") > 0, "block").otherwise("allow"))
    return by_model.select("page_id", "host", "path", "rule", verdict.alias("verdict"), "score")


def op7_url_filter(spark, sf_dir: str) -> DataFrame:
    from .common import table

    return url_filter(table(spark, sf_dir, "pages"))
