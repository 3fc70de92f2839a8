"""Page-aware scorers against forward passes written out block by block."""

import math

import numpy as np
import pytest

from folioscope.operators import scorers
from folioscope.plans import scorers as models

SKETCH = 5


def silu(v):
    return [a / (1 + math.exp(-a)) for a in v]


def dense(layer, x):
    bias = layer.bias if layer.bias is not None else [0.0] * len(layer.weight)
    return [sum(w * a for w, a in zip(row, x)) + b for row, b in zip(layer.weight, bias)]


def normed(layer, x):
    m = sum(x) / len(x)
    v = sum((a - m) ** 2 for a in x) / len(x)
    return [(a - m) / math.sqrt(v + 1e-5) * w + b for a, w, b in zip(x, layer.weight, layer.bias)]


def add(*vs):
    return [sum(a) for a in zip(*vs)]


def less(a, b):
    return [x - y for x, y in zip(a, b)]


def mixed(weights, rows):
    return [sum(w * r[k] for w, r in zip(weights, rows)) for k in range(len(rows[0]))]


def softmax(v):
    e = [math.exp(a - max(v)) for a in v]
    return [a / sum(e) for a in e]


def head(m, x, parts):
    return dense(m.anchor, x)[0] + dense(m.out, silu(dense(m.residual, [a for p in parts for a in p])))[0]


def plain_page(m, xs, qs, bs):
    hs = [silu(dense(m.second, silu(dense(m.first, normed(m.norm, x))))) for x in xs]
    mean, peak = mixed([1 / len(hs)] * len(hs), hs), [max(c) for c in zip(*hs)]
    return [head(m, x, [x, h, mean, peak, less(h, mean), less(h, peak)]) for x, h in zip(xs, hs)]


def plain_query(m, xs, qs, bs):
    asked = [dense(m.query, q) for q in qs]
    met = [dense(m.interaction, [a * b for a, b in zip(q, k)]) for q, k in zip(qs, bs)]
    hs = [silu(add(dense(m.feature, normed(m.norm, x)), a, dense(m.block, b), i)) for x, a, b, i in zip(xs, asked, bs, met)]
    share = softmax([sum(a * b for a, b in zip(h, q)) / math.sqrt(len(h)) for h, q in zip(hs, asked)])
    context = mixed(share, hs)
    return [head(m, x, [x, h, a, i, context, less(h, context)]) for x, h, a, i in zip(xs, hs, asked, met)]


def plain_attention(m, queries, keys):
    n, out = len(queries[0]), []
    part = lambda v, k: dense(scorers.Linear(m.inner.weight[k * n : (k + 1) * n], m.inner.bias[k * n : (k + 1) * n]), v)
    ks, vs, w = [part(k, 1) for k in keys], [part(k, 2) for k in keys], n // m.heads
    for q in (part(q, 0) for q in queries):
        row = []
        for at in range(0, n, w):
            share = softmax([sum(q[at + i] * k[at + i] for i in range(w)) / math.sqrt(w) for k in ks])
            row += mixed(share, [v[at : at + w] for v in vs])
        out.append(dense(m.outer, row))
    return out


def plain_cross(m, xs, qs, bs):
    asked = [dense(m.query, q) for q in qs]
    hs = [silu(add(dense(m.feature, normed(m.norm, x)), dense(m.block, b))) for x, b in zip(xs, bs)]
    tokens = [normed(m.token_norm, add(h, a)) for h, a in zip(hs, asked)]
    question = normed(m.query_norm, mixed([1 / len(asked)] * len(asked), asked))
    context = plain_attention(m.cross, [question], tokens)[0]
    heard = [add(t, context) for t in tokens]
    mix = [add(h, o) for h, o in zip(hs, plain_attention(m.own, heard, heard))]
    mix = [add(v, dense(m.ffn_out, silu(dense(m.ffn_in, normed(m.ffn_norm, v))))) for v in mix]
    return [head(m, x, [x, h, a, context, v, less(v, context)]) for x, h, a, v in zip(xs, hs, asked, mix)]


@pytest.mark.parametrize("make, plain, wide", [(models.page_interaction, plain_page, False), (models.query_interaction, plain_query, True), (models.cross_block, plain_cross, True)])
def test_scores_equal_plain_forward_passes(spark, make, plain, wide):
    rng = np.random.default_rng(7)
    model = make(4, SKETCH) if wide else make(4)
    rows, want = [], {}
    for qid in ("a", None):
        for doc in ("d1", "d2"):
            for page in (1, 2, None):
                n = int(rng.integers(1, 6))
                x, q, b = (rng.normal(size=(n, k)).round(3).tolist() for k in (4, SKETCH, SKETCH))
                if page == 2:
                    q[0], b[-1] = None, [1.0]  # absent, or of another length: zeros
                zeros = [0.0] * SKETCH
                scores = plain(model, x, [v if v and len(v) == SKETCH else zeros for v in q], [v if v and len(v) == SKETCH else zeros for v in b])
                for k in range(n):
                    rows.append((qid, doc, page, f"b{k}", x[k], q[k], b[k], "clash"))
                    want[qid, doc, page, f"b{k}"] = scores[k]
    schema = "qid string, document_id string, page_id long, block_id string, features array<double>, query_sketch array<double>, block_sketch array<double>, score string"
    for records in (2, 10_000):  # pages that batches cut, and pages that they don't
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", records)
        try:
            got = scorers.score_blocks(spark.createDataFrame(rows, schema), model, 4, SKETCH if wide else 0).collect()
        finally:
            spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
        assert {(r["qid"], r["document_id"], r["page_id"], r["block_id"]): pytest.approx(r["score"]) for r in got} == want and len(got) == len(rows)


def test_an_empty_table_gives_no_scores(spark):
    rows = spark.createDataFrame([], "qid long, document_id long, page_id long, block_id string, features array<double>")
    assert scorers.score_blocks(rows, models.page_interaction(), 6).collect() == []
