"""What an index's segments may hold, however large the table."""

from pyspark.sql import functions as F

from folioscope.operators import impact, retrieval


def test_segments_are_bounded_and_find_the_same(spark, monkeypatch):
    rows = [(i, f"w{i % 7} w{i % 11} " * (1 + i % 3)) for i in range(300)] + [(300, "w1 " * 500), (301, None)]
    texts = spark.createDataFrame(rows, "unit_id long, body string").coalesce(1)
    asked = retrieval.term_counts(spark.createDataFrame([("q", "w1 w3"), ("r", "w5")], "qid string, text string"), ["qid"], F.col("text")).withColumnRenamed("tf", "q_tf")
    whole = impact.build(texts, "unit_id", F.col("body")).cache()
    want = sorted(map(tuple, impact.search(whole, asked, 5).collect()))
    monkeypatch.setattr(impact, "SEGMENT", 50)
    monkeypatch.setattr(impact, "SEGMENT_BYTES", 700)
    index = impact.build(texts, "unit_id", F.col("body")).cache()
    held = [r["n_units"] for r in index.collect()]
    assert sum(held) == 302 and max(held) <= 50 and len(held) > 7 and len(held) > whole.count()
    assert sorted(map(tuple, impact.search(index, asked, 5).collect())) == want
