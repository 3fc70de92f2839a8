"""Block scorers that see a block's page: interaction, query interaction, cross-block attention.

A scorer is an anchor, linear in the features, plus a residual from what the blocks
of one page look like together. Pages are independent, so rows meet by (query,
page) and many pages are worked through at once as matrices. Weights are a trained
model's arrays, a few kilobytes, whatever the number of rows.

rows: (qid, document_id, page_id, block_id, ``features`` array<double>, and for the
two scorers that read texts ``query_sketch`` and ``block_sketch`` array<double>, or
``query_text`` and ``block_text``, whose sketches of :data:`vectors.DIM` numbers are
then made where the page lies, so that only the texts are shuffled).
A null array, or one of another length, counts as zeros.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame

from folioscope.operators.vectors import sketches

PAGE =("qid", "document_id", "page_id")
#: Pairs of rows of one page whose attention is worked out at once; a page with more goes alone.
PAIRS = 1 << 17


def silu(x: np.ndarray) -> np.ndarray:
    return x / (1.0 + np.exp(-x))


def layer_norm(x: np.ndarray, weight: np.ndarray, bias: np.ndarray, eps: float = 1e-5) -> np.ndarray:
    centred = x - x.mean(-1, keepdims=True)
    return centred / np.sqrt((centred * centred).mean(-1, keepdims=True) + eps) * weight + bias


@dataclass(frozen=True)
class Linear:
    weight: np.ndarray  # (out, in)
    bias: np.ndarray | None = None

    def __call__(self, x: np.ndarray) -> np.ndarray:
        y = x @ self.weight.T
        return y if self.bias is None else y + self.bias


@dataclass(frozen=True)
class Norm:
    weight: np.ndarray
    bias: np.ndarray

    def __call__(self, x: np.ndarray) -> np.ndarray:
        return layer_norm(x, self.weight, self.bias)


class Segments:
    """Consecutive rows of equal page as slices of a matrix."""

    def __init__(self, starts: np.ndarray, n: int):
        self.starts, self.sizes = starts, np.diff(np.append(starts, n))

    def spread(self, per_page: np.ndarray) -> np.ndarray:
        return np.repeat(per_page, self.sizes, axis=0)

    def sum(self, x: np.ndarray) -> np.ndarray:
        return np.add.reduceat(x, self.starts, axis=0)

    def max(self, x: np.ndarray) -> np.ndarray:
        return np.maximum.reduceat(x, self.starts, axis=0)

    def mean(self, x: np.ndarray) -> np.ndarray:
        return self.sum(x) / self.sizes.reshape(-1, *[1] * (x.ndim - 1))

    def softmax(self, x: np.ndarray) -> np.ndarray:
        e = np.exp(x - self.spread(self.max(x)))
        return e / self.spread(self.sum(e))

    def alike(self) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """(rows by page and place, pages) of pages of equal size, as many at once as have ``PAIRS`` pairs of rows, one at least."""
        for size in np.unique(self.sizes).tolist():
            held = np.flatnonzero(self.sizes == size)
            step = max(1, PAIRS // (size * size))
            for at in range(0, len(held), step):
                some = held[at : at + step]
                yield self.starts[some][:, None] + np.arange(size), some


@dataclass(frozen=True)
class PageInteraction:
    """Residual over a block's hidden state, its page's mean and maximum, and the differences from both."""

    anchor: Linear
    norm: Norm
    first: Linear
    second: Linear
    residual: Linear
    out: Linear

    def __call__(self, x: np.ndarray, pages: Segments, query: np.ndarray | None = None, block: np.ndarray | None = None) -> np.ndarray:
        hidden = silu(self.second(silu(self.first(self.norm(x)))))
        mean, peak = pages.spread(pages.mean(hidden)), pages.spread(pages.max(hidden))
        seen = np.concatenate([x, hidden, mean, peak, hidden - mean, hidden - peak], 1)
        return (self.anchor(x) + self.out(silu(self.residual(seen))))[:, 0]


@dataclass(frozen=True)
class QueryInteraction:
    """Hidden states take in query and block sketches; a page's context is what the query attends to."""

    anchor: Linear
    norm: Norm
    feature: Linear
    query: Linear
    block: Linear
    interaction: Linear
    residual: Linear
    out: Linear

    def __call__(self, x: np.ndarray, pages: Segments, query: np.ndarray, block: np.ndarray) -> np.ndarray:
        asked, met = self.query(query), self.interaction(query * block)
        hidden = silu(self.feature(self.norm(x)) + asked + self.block(block) + met)
        share = pages.softmax((hidden * asked).sum(1) / np.sqrt(hidden.shape[1]))
        context = pages.spread(pages.sum(share[:, None] * hidden))
        seen = np.concatenate([x, hidden, asked, met, context, hidden - context], 1)
        return (self.anchor(x) + self.out(silu(self.residual(seen))))[:, 0]


@dataclass(frozen=True)
class Attention:
    """Scaled dot-product attention of several heads: ``inner`` makes queries, keys and values, one above the other."""

    inner: Linear
    outer: Linear
    heads: int

    def __call__(self, q: np.ndarray, k: np.ndarray) -> np.ndarray:
        """Of pages of equal size: q (pages, queries, width), k (pages, blocks, width)."""
        width = q.shape[-1]
        weights, biases = np.split(self.inner.weight, 3), np.split(self.inner.bias, 3)
        cut = lambda x, i: (x @ weights[i].T + biases[i]).reshape(*x.shape[:2], self.heads, width // self.heads).transpose(0, 2, 1, 3)
        a, b, v = cut(q, 0), cut(k, 1), cut(k, 2)
        logits = a @ b.transpose(0, 1, 3, 2) / np.sqrt(width // self.heads)
        e = np.exp(logits - logits.max(-1, keepdims=True))
        mixed = (e / e.sum(-1, keepdims=True)) @ v
        return self.outer(mixed.transpose(0, 2, 1, 3).reshape(*q.shape))


@dataclass(frozen=True)
class CrossBlock:
    """The query attends to the page's blocks, and these, with what it found, to each other."""

    anchor: Linear
    norm: Norm
    feature: Linear
    query: Linear
    block: Linear
    token_norm: Norm
    query_norm: Norm
    cross: Attention
    own: Attention
    ffn_norm: Norm
    ffn_in: Linear
    ffn_out: Linear
    residual: Linear
    out: Linear

    def __call__(self, x: np.ndarray, pages: Segments, query: np.ndarray, block: np.ndarray) -> np.ndarray:
        asked = self.query(query)
        hidden = silu(self.feature(self.norm(x)) + self.block(block))
        tokens = self.token_norm(hidden + asked)
        questions = self.query_norm(pages.mean(asked))
        context, mixed = np.empty_like(hidden), np.empty_like(hidden)
        for at, held in pages.alike():  # attention is among the blocks of one page; pages of equal size go together
            context[at] = self.cross(questions[held][:, None], tokens[at])
            heard = tokens[at] + context[at]
            mixed[at] = hidden[at] + self.own(heard, heard)
        mixed = mixed + self.ffn_out(silu(self.ffn_in(self.ffn_norm(mixed))))
        seen = np.concatenate([x, hidden, asked, context, mixed, mixed - context], 1)
        return (self.anchor(x) + self.out(silu(self.residual(seen))))[:, 0]


def _matrix(column: pa.Array, width: int) -> np.ndarray:
    """Lists as rows; nulls and lists of another length as zeros."""
    fit = np.asarray(pc.fill_null(pc.equal(pc.list_value_length(column), width), False))
    out = np.zeros((len(column), width))
    if fit.any():
        flat = pc.list_flatten(column.filter(pa.array(fit))).cast(pa.float64())
        out[fit] = np.nan_to_num(np.asarray(pc.fill_null(flat, 0.0))).reshape(-1, width)
    return out


def score_blocks(rows: DataFrame, scorer, features: int, sketch: int = 0, page: tuple[str, ...] = PAGE) -> DataFrame:
    """(qid, document_id, page_id, block_id, score). Rows meet once, by page; a page's rows are held at once, in order of block_id."""
    keys = [*page, "block_id"]
    from_texts = "block_text" in rows.columns
    wide = [] if not sketch else ["query_text", "block_text"] if from_texts else ["query_sketch", "block_sketch"]
    picked = rows.select(*keys, "features", *wide).repartition(*page).sortWithinPartitions(*keys)
    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in picked.select(*keys).schema)

    def scored(held: pa.RecordBatch, starts: np.ndarray) -> pa.RecordBatch:
        x = _matrix(held.column("features"), features)
        texts = [sketches(held.column(c)) if from_texts else _matrix(held.column(c), sketch) for c in wide] or [None, None]
        found = scorer(x, Segments(starts, held.num_rows), *texts)
        return pa.RecordBatch.from_arrays([*[held.column(c) for c in keys], pa.array(found, pa.float64())], [*keys, "score"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rest: list[pa.RecordBatch] = []
        for b in batches:
            rest.append(b)
            now = pa.Table.from_batches(rest).combine_chunks().to_batches() if len(rest) > 1 else rest
            if not now or not now[0].num_rows:
                continue
            starts = _starts(now[0], page)
            if len(starts) > 1:  # the last page may go on
                done = int(starts[-1])
                yield scored(now[0].slice(0, done), starts[:-1])
                rest = [now[0].slice(done)]
            else:
                rest = [now[0]]
        last = pa.Table.from_batches(rest).combine_chunks().to_batches() if rest else []
        if last and last[0].num_rows:
            yield scored(last[0], _starts(last[0], page))

    return picked.mapInArrow(run, f"{kinds}, score double")


def _starts(batch: pa.RecordBatch, page: tuple[str, ...]) -> np.ndarray:
    """Rows at which a page begins."""
    new = np.zeros(batch.num_rows, bool)
    new[:1] = True
    for c in page:
        column = batch.column(c)
        null = np.asarray(column.is_null())
        same = np.asarray(pc.fill_null(pc.equal(column.slice(1), column.slice(0, len(column) - 1)), False))
        new[1:] |= ~(same | (null[1:] & null[:-1]))
    return np.flatnonzero(new)
