"""Vector search over centroid lists against scoring every pair."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from folioscope.operators import vector_lists


def tables(spark, seed, clusters, n_pages=400, n_queries=12, width=8):
    rng = np.random.default_rng(seed)
    centres = rng.normal(size=(clusters, width)) * 4 if clusters else None
    draw = lambda c: (centres[c] + rng.normal(size=width) * 0.2 if clusters else rng.normal(size=width)).round(3).tolist()
    pages = [(p, draw(p % max(1, clusters))) for p in range(n_pages) for _ in range(int(rng.integers(1, 6)))]
    queries = [(f"q{q}", k, draw(q % max(1, clusters))) for q in range(n_queries) for k in range(int(rng.integers(1, 4)))]
    return pages, queries


def plain(pages, queries, k):
    by_page: dict = {}
    for p, v in pages:
        by_page.setdefault(p, []).append(v if v is not None else None)
    by_query: dict = {}
    for q, _, v in queries:
        by_query.setdefault(q, []).append(v)
    out = []
    for q, qs in by_query.items():
        scores = [(-round(sum(max(float(np.dot(a, b)) for b in vs) for a in qs), 6) + 0.0, p) for p, vs in by_page.items()]
        out += [(q, p, -s + 0.0, r) for r, (s, p) in enumerate(sorted(scores)[:k], 1)]
    return sorted(out)


def frames(spark, pages, queries):
    return spark.createDataFrame(queries, "qid string, q_pos int, q_vec array<double>"), spark.createDataFrame(pages, "page_id long, p_vec array<double>").repartition(5)


@pytest.mark.parametrize("clusters", [0, 9])
def test_search_equals_scoring_every_pair(spark, clusters, monkeypatch):
    monkeypatch.setattr(vector_lists, "SEGMENT", 150)
    pages, queries = tables(spark, 3, clusters)
    asked, held = frames(spark, pages, queries)
    got = sorted((r["qid"], r["page_id"], r["score"], r["rank"]) for r in vector_lists.search(asked, held, 5).collect())
    want = plain(pages, queries, 5)
    assert [(g[0], g[1], g[3]) for g in got] == [(w[0], w[1], w[3]) for w in want] and [g[2] for g in got] == pytest.approx([w[2] for w in want], abs=2e-6)
    monkeypatch.setattr(vector_lists, "QUERY_VECTORS", 5)
    assert sorted((r["qid"], r["page_id"], r["score"], r["rank"]) for r in vector_lists.search(asked, held, 5).collect()) == got


def test_bounds_skip_far_clusters(spark):
    small, large = [vector_lists.scored_share(*frames(spark, *tables(spark, 4, 20, n)), 3) for n in (1_500, 6_000)]
    assert large[0] < large[1] / 3
    assert large[0] / small[0] < 0.8 * large[1] / small[1]  # work grows less than pages


def test_neighbours_and_odd_vectors(spark):
    rows = [(1, [1.0, 0.0]), (2, [2.0, 0.1]), (3, [0.0, 3.0]), (4, [0.0, 0.0]), (5, None), (6, [float("nan"), 1.0]), (7, [1.0]), (8, [2.0, 0.1])]
    vectors = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    queries = vectors.where("vec_id IN (1, 4, 5)").select(F.col("vec_id").alias("qid"), F.col("embedding").alias("a"))
    got = {}
    for r in vector_lists.nearest(vectors, queries, 4).collect():
        got.setdefault(r["qid"], []).append((r["rank"], r["vec_id"], r["cosine"]))
    near = round(2 / float(np.hypot(2, np.float32(0.1))), 6)
    assert sorted(got[1]) == [(1, 2, near), (2, 8, near), (3, 3, 0.0), (4, 4, 0.0)]
    assert sorted(got[4]) == [(1, 1, 0.0), (2, 2, 0.0), (3, 3, 0.0), (4, 7, 0.0)] and 5 not in got
    assert vector_lists.search(*frames(spark, [], [("q", 0, [1.0])]), 3).collect() == [] and vector_lists.search(*frames(spark, [(1, [1.0])], []), 3).collect() == []
