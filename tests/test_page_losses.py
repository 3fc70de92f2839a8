"""Page and block losses against plain loops over made samples."""

import math

import numpy as np
import pytest

from folioscope.operators import page_losses as L

M, T = 0.3, 0.5


def relu(x):
    return max(0.0, x)


def hinge(pos, neg):
    return sum(relu(M - p + n) for p in pos for n in neg) / (len(pos) * len(neg))


def ranked(xs):
    return sorted(xs, reverse=True)


def bce(p, t):
    log = lambda v: max(-100.0, math.log(v)) if v > 0 else -100.0
    return -(t * log(p) + (1 - t) * log(1 - p))


def sig(x):
    return 1 / (1 + math.exp(-x))


def hard_set(neg, n_pos, keep, topk):
    """(negatives up to the first that must not fit, whether there is a budget); none where all fit."""
    neg = ranked(neg)
    if keep is not None and keep > 0:
        fits = max(0, keep - n_pos)
        return (neg[: fits + 1], True) if len(neg) > fits else ([], True)
    return neg[: max(1, topk)], False


def boundary(neg, n_pos, keep, most):
    neg, fits = ranked(neg), max(0, keep - min(n_pos, keep))
    rest = neg[fits:]
    return rest[: most if most > 0 else max(1, keep)]


def sides(sample, at):
    return [x[at] for x in sample["pages"] if x[2]], [x[at] for x in sample["pages"] if not x[2]]


def plain_readout(s, topk, weight):
    pos, neg = sides(s, 0)
    if not pos or not neg:
        return None
    hard, budget = hard_set(neg, len(pos), s["keep"], topk)
    if not hard:
        return None
    by_score = sorted(((x[0], x[1]) for x in s["pages"] if not x[2]), reverse=True)[: len(hard)]
    focus = [x[1] for x in s["pages"] if x[2]]
    return hinge(pos, hard[-1:] if budget else hard) + weight * hinge(focus, [f for _, f in by_score])


def plain_focus(s, topk):
    pos, neg = sides(s, 1)
    if len(pos) != 1 or not neg:
        return None
    hard, budget = hard_set(neg, 1, s["keep"], topk)
    return hinge(pos, hard[-1:] if budget else hard) if hard else None


def plain_coverage(s, topk):
    pos, neg = sides(s, 0)
    if len(pos) < 2 or not neg:
        return None
    hard, _ = hard_set(neg, len(pos), s["keep"], topk)
    return relu(M - min(pos) + hard[-1]) if hard else None


def set_loss(pos, hard, every, keep, weight):
    top = ranked(every)
    edge = (top[keep - 1] + top[keep]) / 2
    target = min(len(pos), keep) / len(pos)
    loss = sum(bce(sig((p - edge) / T), target) for p in pos) / len(pos)
    return loss + (weight * sum(bce(sig((n - edge) / T), 0) for n in hard) / len(hard) if hard else 0)


def plain_set(s, weight, most):
    pos, neg = sides(s, 0)
    keep = s["keep"]
    if not pos or not neg or not keep or not 0 < keep < len(pos) + len(neg):
        return None
    return set_loss(pos, boundary(neg, len(pos), keep, most), pos + neg, keep, weight)


def plain_recovery(s, most):
    pos, neg = sides(s, 0)
    keep = s["keep"]
    if len(pos) != 1 or not neg or not keep or not 0 < keep < 1 + len(neg):
        return None
    hard = boundary(neg, 1, keep, most)
    return (hinge(pos, hard) if hard else None, sum(n > pos[0] for n in neg) < keep)


@pytest.fixture(scope="module")
def samples():
    rng = np.random.default_rng(11)
    out = {}
    for k in range(70):
        n = int(rng.integers(1, 8))
        pages = [(float(rng.normal()), float(rng.normal()), bool(rng.random() < 0.35)) for _ in range(n)]
        blocks = {p: [(float(rng.normal()), bool(pages[p][2] and rng.random() < 0.3)) for _ in range(int(rng.integers(1, 7)))] for p in range(n)}
        out[k] = {"pages": pages, "keep": [None, 0, 1, 2, 4][k % 5], "blocks": blocks}
    return out


@pytest.fixture(scope="module")
def pages(spark, samples):
    rows = [(k, p, a, f, t, s["keep"]) for k, s in samples.items() for p, (a, f, t) in enumerate(s["pages"])]
    return spark.createDataFrame(rows, "sample long, page_index int, logit double, focus double, is_target boolean, retained int").cache()


@pytest.fixture(scope="module")
def blocks(spark, samples):
    rows = [(k, p, b, x, t, s["pages"][p][2]) for k, s in samples.items() for p, held in s["blocks"].items() for b, (x, t) in enumerate(held)]
    return spark.createDataFrame(rows, "sample long, page_index int, block_index int, logit double, is_target boolean, page_is_target boolean").cache()


def check(frame, want, keys=("sample",)):
    got = {tuple(r[k] for k in keys) if len(keys) > 1 else r[keys[0]]: r["loss"] for r in frame.collect()}
    want = {k: v for k, v in want.items() if v is not None}
    assert got == {k: pytest.approx(v) for k, v in want.items()} and want


@pytest.mark.parametrize("topk", [1, 3])
def test_page_losses(pages, samples, topk):
    check(L.readout_ranking(pages, M, topk, 0.4), {k: plain_readout(s, topk, 0.4) for k, s in samples.items()})
    check(L.readout_ranking(pages.drop("focus"), M, topk), {k: plain_readout(s, topk, 0.0) for k, s in samples.items()})
    check(L.single_page_focus(pages, M, topk), {k: plain_focus(s, topk) for k, s in samples.items()})
    check(L.multi_page_coverage(pages, M, topk), {k: plain_coverage(s, topk) for k, s in samples.items()})


@pytest.mark.parametrize("most", [0, 1, 2])
def test_retained_pages(pages, samples, most):
    check(L.page_retained_set(pages, T, 0.7, most), {k: plain_set(s, 0.7, most) for k, s in samples.items()})
    want = {k: r for k, s in samples.items() if (r := plain_recovery(s, most))}
    got = {r["sample"]: (r["loss"], r["in_top"]) for r in L.retained_recovery(pages, M, most).collect()}
    assert got == {k: (None if loss is None else pytest.approx(loss), top) for k, (loss, top) in want.items()} and want


def gap(xs, topk):
    top = ranked(xs)[: max(1, topk)]
    rest = ranked(xs)[max(1, topk) :] or xs
    return relu(M - sum(top) / len(top) + sum(rest) / len(rest))


def local(pos, neg, kind, topk, keep):
    fits = max(0, keep - len(pos))
    if kind == "budget_ranking":
        return hinge(pos, [ranked(neg)[fits]]) if len(neg) > fits else None
    return hinge(pos, ranked(neg)[: max(1, topk)]) if neg else None


@pytest.mark.parametrize("kind", ["ranking", "budget_ranking", "bce"])
def test_block_focus(blocks, samples, kind):
    want = {}
    for k, s in samples.items():
        for p, held in s["blocks"].items():
            if not s["pages"][p][2]:
                continue
            pos, neg = [x for x, t in held if t], [x for x, t in held if not t]
            if not pos:
                want[k, p] = gap(neg, 2)
            elif kind == "bce":
                w = max(1, len(neg)) / len(pos)
                want[k, p] = (sum(-w * math.log(sig(x)) for x in pos) + sum(-math.log(1 - sig(x)) for x in neg)) / len(held)
            else:
                want[k, p] = local(pos, neg, kind, 2, 2)
    check(L.block_focus(blocks, kind, M, 2, 2), want, ("sample", "page_index"))
    with pytest.raises(ValueError):
        L.block_focus(blocks, "other", M, 1, 1)


def test_block_retained_set(blocks, samples):
    want = {}
    for k, s in samples.items():
        for p, held in s["blocks"].items():
            pos, neg = [x for x, t in held if t], [x for x, t in held if not t]
            if pos and len(held) > 2:
                want[k, p] = set_loss(pos, ranked(neg)[:2], pos + neg, 2, 0.7)
    check(L.block_retained_set(blocks, 2, T, 0.7), want, ("sample", "page_index"))


@pytest.mark.parametrize("budget", [False, True])
def test_block_readout(blocks, pages, samples, budget):
    want = {}
    for k, s in samples.items():
        marked = [p for p, held in s["blocks"].items() if s["pages"][p][2] and any(t for _, t in held)]
        negatives = sorted(((a, p) for p, (a, _, t) in enumerate(s["pages"]) if not t), reverse=True)
        if s["keep"]:
            fits = max(0, s["keep"] - len(marked))
            hard = negatives[: fits + 1] if len(negatives) > fits else []
        else:
            hard = negatives[:2]
        mass = sum(math.exp(a) for a, _ in hard)
        for p, held in s["blocks"].items():
            if not s["pages"][p][2]:
                continue
            pos, neg = [x for x, t in held if t], [x for x, t in held if not t]
            terms = []
            if pos:
                own = local(pos, neg, "budget_ranking" if budget else "ranking", 2, 2)
                terms += [own] if own is not None else []
                terms += [sum(math.exp(a) / mass * hinge(pos, ranked(x for x, _ in s["blocks"][q])[:2]) for a, q in hard)] if hard else []
            want[k, p] = sum(terms) if terms else gap([x for x, _ in held], 2)
    check(L.block_readout(blocks, pages, M, 2, 2, budget), want, ("sample", "page_index"))
