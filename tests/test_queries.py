"""Registered queries against their SQL on the smallest tables, and independence of partitioning."""

import duckdb
import pytest

from folioscope.plans import registry
from folioscope.plans.surrogates import sql_tokens

DIR = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{DIR}/{t}.parquet'")
    return con


def plain(rows, columns):
    return sorted(tuple(repr(round(v, 5) if isinstance(v, float) else v) for v in (r[c] for c in columns)) for r in rows)


@pytest.mark.parametrize("name", sorted(registry.oracle_sql()))
def test_matches_sql(spark, duck, name):
    got = registry.queries()[name](spark, DIR)
    found = duck.execute(registry.oracle_sql()[name])
    columns = sorted(c[0] for c in found.description)
    want = [dict(zip([c[0] for c in found.description], r, strict=True)) for r in found.fetchall()]
    assert sorted(got.columns) == columns
    assert plain([r.asDict() for r in got.collect()], columns) == plain(want, columns)


@pytest.mark.parametrize("name", ["retrieval_recall", "select_random_chars", "derangement"])
def test_partition_count_does_not_matter(spark, name):
    def run(n):
        spark.conf.set("spark.sql.shuffle.partitions", n)
        return sorted(map(repr, registry.queries()[name](spark, DIR).collect()))

    try:
        assert run("1") == run("8")
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", "4")


@pytest.mark.parametrize("name", sorted(set(registry.queries()) - set(registry.oracle_sql())))
def test_runs(spark, name):
    assert registry.queries()[name](spark, DIR).count() > 0


def test_sketches_of_every_pair_that_shares_a_token(spark, duck):
    got = registry.queries()["sketch_similarity"](spark, DIR).collect()
    words = lambda t, key: f"SELECT DISTINCT {key}, unnest({sql_tokens('text')}) AS token FROM {t}"
    want = duck.execute(f"SELECT DISTINCT doc_id, item_id FROM ({words('documents', 'doc_id')}) JOIN ({words('benchmark', 'item_id')}) USING (token)").fetchall()
    assert sorted((r["doc_id"], r["qid"]) for r in got) == sorted(want)
    assert all(-1.000001 <= r["dot"] <= 1.000001 for r in got)


def test_entry(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).count() > 0
