"""Block scorers: sketches of texts where the page lies, and pages of equal size together."""

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from folioscope.operators import scorers, vectors
from folioscope.operators.retrieval import term_counts
from folioscope.plans import scorers as models

TEXTS = ["Alpha beta the beta", "", None, "İx K9 of é x-y", "the of", "alpha 17 alpha"]


def test_sketches_of_texts_equal_those_of_counted_tokens(spark):
    terms = term_counts(spark.createDataFrame(list(enumerate(TEXTS)), "k long, t string"), ["k"], F.col("t"))
    want = {r["k"]: r["sketch"] for r in vectors.text_sketches(terms, "k").collect()}
    got = vectors.sketches(pa.array(TEXTS + TEXTS[:1], pa.string()))
    assert got.shape == (7, vectors.DIM) and (got[6] == got[0]).all()
    for k in range(len(TEXTS)):
        assert got[k].tolist() == pytest.approx(want.get(k, [0.0] * vectors.DIM))


def test_blocks_are_scored_from_texts(spark):
    rows = [(d, d, 1 + b // 4, f"b{b}", [float(b), 1.0, 0.5, d / 3, 0.0, 2.0], TEXTS[d % 6], TEXTS[(d + b) % 6]) for d in range(3) for b in range(6)]
    texts = spark.createDataFrame(rows, "qid long, document_id long, page_id long, block_id string, features array<double>, query_text string, block_text string")
    numbers = vectors.sketches(pa.array(TEXTS, pa.string())).tolist()
    wide = spark.createDataFrame([(*r[:5], numbers[TEXTS.index(r[5])], numbers[TEXTS.index(r[6])]) for r in rows], "qid long, document_id long, page_id long, block_id string, features array<double>, query_sketch array<double>, block_sketch array<double>")
    for model in (models.query_interaction(), models.cross_block()):
        found = [{(r["qid"], r["block_id"]): r["score"] for r in scorers.score_blocks(t, model, 6, vectors.DIM).collect()} for t in (texts, wide)]
        assert found[0] == pytest.approx(found[1]) and len(found[0]) == 18


def test_pages_of_equal_size_go_together(monkeypatch):
    pages = scorers.Segments(np.array([0, 3, 5, 8, 10]), 11)
    for most in (1, 1 << 17):
        monkeypatch.setattr(scorers, "PAIRS", most)
        met = [(held.tolist(), at.tolist()) for at, held in pages.alike()]
        assert sorted(sum((h for h, _ in met), [])) == [0, 1, 2, 3, 4] and sorted(sum((r for _, a in met for r in a), [])) == list(range(11))
        assert len(met) == (5 if most == 1 else 3)
