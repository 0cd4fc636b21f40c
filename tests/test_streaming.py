"""Streams against the same work as a batch."""

from pyspark.sql import functions as F

from seriesloom import config
from seriesloom.streaming import events


def test_windows(spark, tmp_path):
    source = spark.read.parquet("/root/testdata/sf0.001/events.parquet")
    source.repartition(3).write.parquet(str(tmp_path / "events"))
    stream = spark.readStream.schema(source.schema).parquet(str(tmp_path / "events"))
    q = events.windowed_counts(stream).writeStream.outputMode("complete").format("memory").queryName("counts").start()
    q.processAllAvailable()
    q.stop()
    got = {(r.window.start, r.event_type): r.n for r in spark.table("counts").collect()}
    want = {(r.window.start, r.event_type): r.n for r in source.groupBy(F.window(F.col("ts").cast("timestamp"), "1 hour"), "event_type").agg(F.count("*").alias("n")).collect()}
    assert got == want and want


def test_upsert(spark, tmp_path):
    for part in ([(1, 1, 1.0), (2, 1, 1.0)], [(2, 2, 5.0), (3, 1, 3.0)]):
        spark.createDataFrame(part, "k int, o int, v double").coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        stream = spark.readStream.schema("k int, o int, v double").parquet(str(tmp_path / "in"))
        events.upsert_batches(stream, str(tmp_path / "out"), ["k"], "o", str(tmp_path / "state")).awaitTermination(60)
    assert {r.k: r.v for r in events.latest(spark, str(tmp_path / "out")).collect()} == {1: 1.0, 2: 5.0, 3: 3.0}


def test_config(tmp_path):
    (tmp_path / "a.yaml").write_text("tables: t\noutput: o\nqueries: [x]\n")
    c = config.load(str(tmp_path / "a.yaml"), {"target": 10})
    assert c.queries == ("x",) and c.target == 10 and len(c.identity()) == 64
    (tmp_path / "b.yaml").write_text("- 1\n")
    for bad in ("b.yaml",):
        try:
            config.load(str(tmp_path / bad))
            raise AssertionError("a list was accepted")
        except ValueError:
            pass
