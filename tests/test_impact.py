"""The block-maxima index against scoring every pair, and its defined cases."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from folioscope.operators import impact, retrieval


@pytest.fixture(scope="module")
def texts(spark):
    rng = np.random.default_rng(5)
    words = np.array([f"w{k}" for k in range(400)] + ["The", "İx", "é", "x-y", "K9"])
    share = 1 / np.arange(1, len(words) + 1)
    rows = [(int(i), " ".join(rng.choice(words, int(n), p=share / share.sum()))) for i, n in enumerate(rng.geometric(0.01, 900))]
    rows += [(2000, None), (2001, ""), (2002, rows[3][1]), (2003, rows[3][1])]
    return spark.createDataFrame(rows, "unit_id long, body string").repartition(3).cache()


@pytest.fixture(scope="module")
def queries(spark, texts):
    asked = [(f"q{k}", r["body"]) for k, r in enumerate(texts.orderBy("unit_id").limit(60).collect())] + [("none", "the of"), ("odd", "zzz qqq"), ("some", "w1 zzz w300")]
    return retrieval.term_counts(spark.createDataFrame(asked, "qid string, text string"), ["qid"], F.col("text")).withColumnRenamed("tf", "q_tf").cache()


def every_pair(texts, queries):
    terms = retrieval.term_counts(texts, ["unit_id"], F.col("body"))
    return retrieval.lexical_scores(queries, terms, texts.agg(F.count("*").alias("n_units")), ["unit_id"])


@pytest.mark.parametrize("parts", [1, 3])
def test_search_equals_scoring_every_pair(texts, queries, parts, tmp_path):
    impact.build(texts.coalesce(parts), "unit_id", F.col("body")).write.parquet(f"{tmp_path}/index")
    index = texts.sparkSession.read.parquet(f"{tmp_path}/index")
    want = retrieval.top_k(every_pair(texts, queries), ["qid"], [F.round("score", 6).desc(), F.col("unit_id")], 7)
    keys = lambda df, unit: sorted((r["qid"], r[unit], round(r["score"], 6), r["matched"], r["rank"]) for r in df.collect())
    assert keys(impact.search(index, queries, 7), "unit") == keys(want, "unit_id")


def test_maxima_skip_most_pairs(texts, queries):
    index = impact.build(texts.coalesce(1), "unit_id", F.col("body")).cache()
    scored, sharing = impact.scored_share(index, queries, 3)
    assert sharing == every_pair(texts, queries).count()
    assert scored < sharing / 2


def test_units_that_match_most_terms_come_whatever_their_rank(texts, queries):
    index = impact.build(texts, "unit_id", F.col("body"))
    n = queries.groupBy("qid").agg(F.count("*").alias("n"))
    want = every_pair(texts, queries).join(n, "qid").where("10 * matched >= 6 * n")
    got = impact.search(index, queries, 2, 0.6).join(n, "qid")
    assert {(r["qid"], r["unit_id"]) for r in want.collect()} == {(r["qid"], r["unit"]) for r in got.where("10 * matched >= 6 * n").collect()}
    assert got.where("rank is null and 10 * matched < 6 * n").count() == 0
    assert got.groupBy("qid", "unit").count().where("count > 1").count() == 0


def test_queries_in_several_passes(texts, queries, monkeypatch):
    index = impact.build(texts, "unit_id", F.col("body")).cache()
    want = sorted(map(tuple, impact.search(index, queries, 3).collect()))
    monkeypatch.setattr(impact, "QUERY_TERMS", 100)
    assert sorted(map(tuple, impact.search(index, queries, 3).collect())) == want


def test_empty_tables_and_profiles(spark, texts, queries):
    nothing = texts.where("unit_id < 0")
    assert impact.search(impact.build(nothing, "unit_id", F.col("body")), queries, 3).collect() == []
    assert impact.search(impact.build(texts, "unit_id", F.col("body")), queries.where("qid = 'x'"), 3).collect() == []
    one = spark.createDataFrame([("a", "do x the yes")], "unit_id string, body string")
    found = {p: sorted(impact.build(one, "unit_id", F.col("body"), p).select(F.explode(F.arrays_zip("tokens", "df")).alias("t")).where("t.df > 0").select("t.tokens").toPandas()["tokens"]) for p in ("all", "block", "page")}
    assert found == {"all": ["do", "the", "x", "yes"], "block": ["do", "x", "yes"], "page": ["yes"]}
