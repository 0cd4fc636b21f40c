"""Rows that repeat very often, share an id, or have none: results against plain ones, and how they are dealt."""

import hashlib
from collections import Counter

from pyspark.sql import functions as F

from seriesloom.llm import minhash, suffix_dedup, topk, url_filter

DOCS = "doc_id long, text string, lang string"


def test_next_of_rows_that_share_an_id(spark):
    """20,000 rows without an id and 20,000 of one id, all of different texts: no part holds more than twice the mean."""
    ids = spark.range(20_000).select(F.lit(None).cast("long").alias("doc_id"), F.concat(F.lit("none "), "id").alias("text"))
    one = spark.range(20_000).select(F.lit(7).cast("long").alias("doc_id"), F.concat(F.lit("seven "), "id").alias("text"))
    docs = ids.unionByName(one).unionByName(spark.range(20_000).select(F.col("id").alias("doc_id"), F.concat(F.lit("own "), "id").alias("text")))
    dealt = minhash.with_next(docs, 24)
    sizes = [r["count"] for r in dealt.where("not last").groupBy("part").count().collect()]
    assert sum(sizes) == 60_000 and max(sizes) < 2 * 60_000 / 24
    assert dealt.where("last").count() == len(sizes)


def plain_next(rows):
    order = sorted(((i if i is not None else -(1 << 63)), t or "") for i, t in rows)
    order.sort(key=lambda r: (-r[0], r[1]))
    out = Counter()
    for (i, t), (_, n) in zip(order, order[1:] + order[:1], strict=True):
        half = len(t) // 2
        out[None if i == -(1 << 63) else i, len(t), hashlib.sha256((t[: len(t) - half] + n[:half]).encode()).hexdigest()] += 1
    return out


def test_fingerprints_of_rows_that_repeat(spark):
    rows = [(3, "three times the same old words here")] * 5000 + [(None, "nobody knows this one")] * 3001 + [(None, f"n{k}") for k in range(50)] + [(k, f"text of {k}") for k in range(200)] + [(3, "another three")] * 2
    docs = spark.createDataFrame([(*r, "en") for r in rows], DOCS)
    got = minhash.edited_fingerprints(docs)
    assert Counter((r.doc_id, r.n_chars, r.edited_sha256) for r in got.collect()) == plain_next(rows)
    dealt = minhash.with_next(docs)
    assert dealt.count() < 600 and dealt.where("not last").agg(F.sum("times")).first()[0] == len(rows)
    same = [(1, "only one text in all rows")] * 4000
    got = minhash.edited_fingerprints(spark.createDataFrame([(*r, "en") for r in same], DOCS))
    assert Counter((r.doc_id, r.n_chars, r.edited_sha256) for r in got.collect()) == plain_next(same)
    assert got.agg(F.min("near_next")).first()[0] == 1.0


def test_runs_of_rows_that_repeat(spark):
    """Thousands of equal rows bring one list of runs, as long as one row's."""
    text = "".join(f"word{k} " for k in range(200))
    rows = [(5, text)] * 3000 + [(6, text + "tail"), (7, "own " * 3)]
    docs = spark.createDataFrame([(*r, "en") for r in rows], DOCS)
    runs = suffix_dedup.repeated_runs(docs, length=100)
    few = suffix_dedup.repeated_runs(spark.createDataFrame([(*r, "en") for r in rows[2998:]], DOCS), length=100)
    most = lambda df: df.agg(F.max(F.size("runs"))).first()[0]
    assert most(runs) == most(few)
    cleaned = suffix_dedup.remove_runs(docs, runs).groupBy("doc_id", "n_bytes", "n_removed").count().collect()
    assert {tuple(r) for r in cleaned} == {(5, len(text), len(text), 3000), (6, len(text) + 4, len(text), 1), (7, 12, 0, 1)}


PAGES = "page_id long, url string, html string"


def test_urls_that_repeat(spark):
    """A URL a hundred thousand times weighs as often, without being written out."""
    many = spark.range(100_000).select(F.col("id").alias("page_id"), F.lit("http://a.bad/casino/win").alias("url"), F.lit(None).cast("string").alias("html"))
    few = spark.createDataFrame([(200_000, "http://b.good/casino/rain", None), (200_001, "http://c.open/casino", None), (200_002, "http://c.open/rain", None)], PAGES)
    rules = [("block", "bad/"), ("allow", "good/")]
    got = {r.page_id: (r.verdict, r.score) for r in url_filter.url_filter(many.unionByName(few), rules).where("page_id >= 200000").collect()}
    labelled = spark.createDataFrame([("block", [f"h:{c}" for c in "abad"] + ["p:casino", "p:win"], 100_000), ("allow", [f"h:{c}" for c in "bgood"] + ["p:casino", "p:rain"], 1)], "verdict string, tokens array<string>, times long")
    odds, prior = url_filter.token_odds(labelled)
    odds = {r.token: r.odds for r in odds.collect()}
    assert got[200_000] == ("allow", None) and odds["p:casino"] != 0
    want = prior + sum(odds.get(t, 0.0) for t in [f"h:{c}" for c in "copen"] + ["p:casino"])
    assert abs(got[200_001][1] - want) < 1e-9


def test_words_of_any_length(spark):
    word = "donaudampfschifffahrtsgesellschaftskapitaen"
    pages = spark.createDataFrame([(1, f"http://{word}online.example/x", f"<p>{word} online example</p>" * 3)], PAGES)
    counts = url_filter.word_counts(pages)
    assert {r.word: r.n for r in counts.collect()} == {word: 3, "online": 3, "example": 3}
    assert url_filter.host_words(spark.createDataFrame([(f"{word}online.example",)], "host string"), counts).first().words == [f"h:{word}", "h:online", "h:example"]


def test_first_pass_is_dealt_over_tasks(spark, monkeypatch):
    monkeypatch.setattr(topk, "FIRST_BLOCKS", 1)
    monkeypatch.setattr(topk, "QUERIES_PER_BLOCK", 4)
    seen = []
    meet = topk._meet
    monkeypatch.setattr(topk, "_meet", lambda q, c, turn, dim, k, blocks, a_task=None: seen.append((blocks, a_task)) or meet(q, c, turn, dim, k, blocks, a_task))
    df = spark.createDataFrame([(i, [float(i % 17), float(i % 5), 1.0]) for i in range(300)], "vec_id long, embedding array<float>")
    got = topk.top_k(df, df.where("vec_id % 3 = 0"), k=3)
    assert got.count() == 300 and seen[0] == (25, 1)


def test_workers_of_near_duplicates_get_few_texts_at_a_time(spark):
    """A worker held the texts, and the shingle sets, of 10,000 rows at once."""
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(name)
    spark.conf.set(name, "10000")
    try:
        docs = spark.range(3000).select(F.col("id").alias("doc_id"), F.concat(F.lit("some words of text "), F.col("id") % 2000).alias("text"))
        found = minhash.near_duplicates(docs)
        assert int(spark.conf.get(name)) <= 1000 and found.count() == 3000
    finally:
        spark.conf.set(name, before)
