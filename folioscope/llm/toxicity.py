"""Toxicity by compression distance.

Zstandard dictionaries are trained on toxic and on ordinary text, apart and of
equal size. A text's windows (``WINDOW`` words, a new one every ``STEP``) are
compressed with both; the bytes that one saves against the other are the
evidence. A logistic calibration over their distribution gives a score between 0
and 1, shifted so that 0.5 is the threshold of the best F1.

A dictionary has two parts, both made by zstandard's trainer. Its base is trained
on ordinary windows, so that plain prose costs the same under both. What
follows is trained on the kind's own text: on the stretches whose byte strings
are held by at least ``ratio`` times the share of the other kind's rows, and by
more of them than chance explains, as whole texts of either kind are mostly prose
that tells nothing. ``PAIRS`` such pairs, of several ratios and sizes, are compared.

Training reads at most ``SAMPLE`` labelled rows and ``SAMPLE_BYTES`` of text of
each kind, those of least hash. The calibration is fitted across two halves, each
scored by the other's dictionaries; the dictionaries used are both halves'. Every
text is scored whole.

Defined cases: a null or empty text has no window and gets the calibration's
score of no evidence; rows with a null label or id are not learnt from; without
rows of both kinds in both halves the score is the share of toxic rows (0 without
rows); too little text to train on is a dictionary itself; a kind without telling
strings trains on its whole texts; a document with
unlike labels is learnt from under each; ids may repeat; other columns are not
read; an empty table of documents gives no rows. Scoring is one pass without a shuffle.
"""

from __future__ import annotations

import re
from bisect import bisect_left
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from folioscope.llm.common import bounded_sample, lean, prepare, texts

SAMPLE, SAMPLE_BYTES = 4_000, 8 << 20
WINDOW, STEP = 12, 6
#: Words of a training window of the base.
BASE_WINDOW = 20
#: Bytes of a string whose frequencies are compared.
GRAM = 6


@dataclass(frozen=True)
class Pair:
    """Bytes of the base and of a kind's own part, and the least ratio of shares of rows."""

    base: int
    own: int
    ratio: float


PAIRS = (Pair(4096, 1024, 6), Pair(8192, 1024, 4), Pair(2048, 700, 8))
#: Least G statistic of a string that tells the kinds apart, at any number of rows.
SIGNIFICANT = 20.0

_WORDS = re.compile(r"[^\W\d_]+").findall
#: Matches of six bytes and more, found greedily; nothing but the block in a frame that can be left out.
_PARAMETERS = {
    "strategy": zstandard.STRATEGY_GREEDY, "min_match": GRAM, "window_log": 17, "hash_log": 14, "chain_log": 14, "search_log": 5, "target_length": 8,
    "write_content_size": False, "write_checksum": False, "write_dict_id": False,
}


def windows(text: str | None, size: int = WINDOW, step: int = STEP) -> list[bytes]:
    words = _WORDS((text or "").lower())
    return [f" {' '.join(words[i: i + size])} ".encode() for i in range(0, max(1, len(words) - size + step), step)] if words else []


@dataclass
class Model:
    """Dictionaries and calibration; a few tens of kilobytes at any corpus size."""

    #: (ordinary, toxic) of every pair
    dictionaries: list[tuple[bytes, bytes]] = field(default_factory=list)
    centre: list[float] = field(default_factory=list)
    scale: list[float] = field(default_factory=list)
    weights: list[float] = field(default_factory=list)
    prior: float = 0.0

    def __getstate__(self):
        return {k: v for k, v in self.__dict__.items() if not k.startswith("_")}

    def _lengths(self):
        if "_pairs" not in self.__dict__:
            self._pairs = [tuple(map(_engine, pair)) for pair in self.dictionaries]
        return self._pairs

    def features(self, text: str | None) -> list[float]:
        cut = windows(text)
        out: list[float] = []
        for plain, toxic in self._lengths():
            out += _summary([a - b for a, b in zip(_sizes(plain, cut), _sizes(toxic, cut), strict=True)])
        return [*out, float(np.log1p(len(cut))) if cut else float("nan")]  # no window, no length to judge

    def score(self, rows: np.ndarray) -> np.ndarray:
        z = np.nan_to_num((rows - np.asarray(self.centre)) / np.asarray(self.scale))
        return 1 / (1 + np.exp(-np.clip(z @ np.asarray(self.weights[:-1]) + self.weights[-1], -30, 30)))


def _engine(dictionary: bytes) -> zstandard.ZstdCompressor:
    return zstandard.ZstdCompressor(dict_data=zstandard.ZstdCompressionDict(dictionary), compression_params=zstandard.ZstdCompressionParameters(**_PARAMETERS))


def _compressor(dictionary: bytes):
    return _engine(dictionary).compress


def _sizes(engine: zstandard.ZstdCompressor, cut: list[bytes]) -> list[int]:
    """Compressed lengths of windows, each one a frame of its own, in one call."""
    return [len(x) for x in engine.multi_compress_to_buffer(cut)] if cut else []


def _summary(saved: list[int]) -> list[float]:
    """The distribution of what a text's windows save. Sums are of whole or half numbers, so they are exact."""
    if not saved:
        return [0.0] * 8
    x = sorted(saved)
    n = len(x)
    median = (x[(n - 1) // 2] + x[n // 2]) / 2
    tenth = x[-max(1, n // 10):]
    last = x[-4:]
    above = sum(v - median for v in x[n // 2:] if v > median)
    shares = [(n - bisect_left(x, k)) / n for k in (2, 3, 5)]
    return [float(x[-1]), sum(last) / len(last), sum(x) / n, above / n, sum(tenth) / len(tenth), *shares]


def _logistic(rows: np.ndarray, labels: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    centre, scale = np.nanmean(rows, 0), np.nanstd(rows, 0)
    scale[scale < 1e-6] = 1.0  # a constant says nothing
    a = np.c_[np.nan_to_num((rows - centre) / scale), np.ones(len(rows))]
    w = np.zeros(a.shape[1])
    for _ in range(30):
        p = 1 / (1 + np.exp(-np.clip(a @ w, -30, 30)))
        gradient = a.T @ (p - labels) + 1e-2 * w
        w -= np.linalg.solve((a * (p * (1 - p))[:, None]).T @ a + 1e-2 * np.eye(len(w)), gradient)
    return centre, scale, w


def _threshold(scores: np.ndarray, truth: np.ndarray) -> float:
    """The logit at which precision and recall of the toxic rows balance best (F1); it becomes a score of 0.5."""
    order = np.argsort(-scores, kind="stable")
    hits = np.cumsum(truth[order])
    f1 = 2 * hits / (np.arange(1, len(order) + 1) + truth.sum())
    best = min(int(np.argmax(f1)), len(order) - 2)
    cut = float(np.clip(scores[order[best: best + 2]].mean(), 1e-6, 1 - 1e-6))
    return float(np.log(cut / (1 - cut)))


def _trained(samples: list[bytes], size: int, segment: int, string: int) -> bytes:
    """zstandard's dictionary of the samples; their last bytes where they are too few to train on."""
    samples = [x for x in samples if len(x) >= 8]
    try:
        return zstandard.train_dictionary(size, samples, k=segment, d=string, level=3).as_bytes()
    except zstandard.ZstdError:
        return b"".join(samples)[-size:]


def _strings(data: bytes) -> np.ndarray:
    """All strings of ``GRAM`` bytes as numbers."""
    raw = np.frombuffer(data, np.uint8).astype(np.uint64)
    n = max(0, len(raw) - GRAM + 1)
    out = np.zeros(n, np.uint64)
    for i in range(GRAM):
        out = (out << np.uint64(8)) | raw[i: i + n]
    return out


def _rows_with(rows: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Distinct strings and the rows that hold them, counted some hundred rows at a time."""
    keys, counts = np.zeros(0, np.uint64), np.zeros(0, np.int64)
    for i in range(0, len(rows), 400):
        found, n = np.unique(np.concatenate([np.unique(_strings(r)) for r in rows[i: i + 400]]), return_counts=True)
        keys, place = np.unique(np.concatenate([keys, found]), return_inverse=True)
        counts = np.bincount(place, weights=np.concatenate([counts, n]), minlength=len(keys)).astype(np.int64)
    return keys, counts


def _likelihood(count: np.ndarray, rows: int, share: np.ndarray) -> np.ndarray:
    share = np.clip(share, 1e-12, 1 - 1e-12)
    return count * np.log(share) + (rows - count) * np.log(1 - share)


def _telling(own: tuple[np.ndarray, np.ndarray], rows: int, other: tuple[np.ndarray, np.ndarray], rows_other: int, ratio: float) -> np.ndarray:
    """Strings held by ``ratio`` times the share of the other kind's rows, beyond chance (G test)."""
    keys, here = own
    there = np.zeros(len(keys), np.int64)
    if len(other[0]):
        at = np.minimum(np.searchsorted(other[0], keys), len(other[0]) - 1)
        there = np.where(other[0][at] == keys, other[1][at], 0)
    both = (here + there) / max(1, rows + rows_other)
    apart = _likelihood(here, rows, here / max(1, rows)) + _likelihood(there, rows_other, there / max(1, rows_other))
    gain = 2 * (apart - _likelihood(here, rows, both) - _likelihood(there, rows_other, both))
    return keys[(gain > SIGNIFICANT) & (here / max(1, rows) > ratio * (there + 0.5) / max(1, rows_other))]


def _stretches(rows: list[bytes], kept: np.ndarray) -> list[bytes]:
    """The stretches that these strings cover, a byte wider on either side; without strings, the rows."""
    if not len(kept):
        return rows
    out: list[bytes] = []
    for data in rows:
        found = _strings(data)
        hit = kept[np.minimum(np.searchsorted(kept, found), len(kept) - 1)] == found
        depth = np.zeros(len(data) + 1, np.int64)
        depth[: len(hit)] += hit
        depth[GRAM: GRAM + len(hit)] -= hit
        edge = np.flatnonzero(np.diff(np.r_[0, (np.cumsum(depth)[: len(data)] > 0).astype(np.int8), 0]))
        out += [data[max(0, a - 1): b + 1] for a, b in zip(edge[::2].tolist(), edge[1::2].tolist(), strict=True)]
    return out


def dictionaries(rows: list[tuple[str | None, int]], pairs: tuple[Pair, ...] = PAIRS) -> list[tuple[bytes, bytes]]:
    """(ordinary, toxic) dictionaries of every pair from (text, label) rows, both of one length."""
    plain = [[f" {' '.join(_WORDS((text or '').lower()))} ".encode() for text, y in rows if y == kind] for kind in (0, 1)]
    held = [_rows_with(p) for p in plain]
    prose = [w for text, y in rows if not y for w in windows(text, BASE_WINDOW, BASE_WINDOW)]
    bases = {size: _trained(prose, size, 48, 8) for size in {p.base for p in pairs}}
    out = []
    for p in pairs:
        kept = [_telling(held[k], len(plain[k]), held[1 - k], len(plain[1 - k]), p.ratio) for k in (0, 1)]
        own = [_trained(_stretches(plain[k], kept[k]), p.own, 16, 6) for k in (0, 1)]
        # Equal lengths put the base at equal distances, so that plain prose costs the same under both.
        length = max(map(len, own))
        plainly, toxic = (bases[p.base] + part.rjust(length, b"\0") for part in own)
        out.append((plainly, toxic))
    return out


def _fitted(sets: list[list[tuple[str | None, int]]], spark: SparkSession | None) -> list[list[tuple[bytes, bytes]]]:
    """:func:`dictionaries` of each set of rows, a set to a task where a session is given."""
    if spark is None:
        return [dictionaries(rows) for rows in sets]
    shared = spark.sparkContext.broadcast(sets)  # the bounded sample, in halves and whole

    def fit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for k in b.column("id").to_pylist():
                plain, toxic = zip(*dictionaries(shared.value[k]))
                yield pa.RecordBatch.from_arrays([pa.array([k] * len(plain)), pa.array(range(len(plain))), pa.array(plain, pa.binary()), pa.array(toxic, pa.binary())], ["k", "pair", "plain", "toxic"])

    found = spark.range(0, len(sets), 1, len(sets)).mapInArrow(lean(fit), "k long, pair long, plain binary, toxic binary").collect()
    shared.unpersist()
    out: list[list[tuple[bytes, bytes]]] = [[] for _ in sets]
    for r in sorted(found, key=lambda r: (r["k"], r["pair"])):
        out[r["k"]].append((bytes(r["plain"]), bytes(r["toxic"])))
    return out


def _features(model: Model, rows: list[tuple[str | None, int]], spark: SparkSession | None) -> list[list[float]]:
    """The features of each row's text, as tasks where a session is given."""
    if spark is None:
        return [model.features(text) for text, _ in rows]
    shared = spark.sparkContext.broadcast((model, [text for text, _ in rows]))

    def rate(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            ids = b.column("id").to_pylist()
            model, held = shared.value
            yield pa.RecordBatch.from_arrays([b.column("id"), pa.array([model.features(held[k]) for k in ids], pa.list_(pa.float64()))], ["id", "x"])

    found = spark.range(0, len(rows), 1, spark.sparkContext.defaultParallelism).mapInArrow(lean(rate), "id long, x array<double>").collect()
    shared.unpersist()
    return [r["x"] for r in sorted(found, key=lambda r: r["id"])]


def train(rows: list[tuple[str | None, int]], spark: SparkSession | None = None) -> Model:
    """Fit on (text, label) rows: the calibration across two halves, the dictionaries on both.

    With a session, dictionaries and features are made by Spark tasks; the driver
    solves the calibration, a few dozen numbers.
    """
    labels = [int(y) for _, y in rows]
    prior = sum(labels) / len(labels) if labels else 0.0
    kinds = [[r for r in rows if r[1] == y] for y in (0, 1)]  # both halves get half of each kind
    halves = kinds[0][::2] + kinds[1][::2], kinds[0][1::2] + kinds[1][1::2]
    if any(len({y for _, y in half}) < 2 for half in halves):
        return Model(prior=prior)
    fitted = _fitted([*halves, rows], spark)
    features, known = [], []
    for mine, other in ((fitted[0], halves[1]), (fitted[1], halves[0])):
        features += _features(Model(mine), other, spark)
        known += [y for _, y in other]
    truth = np.asarray(known, float)
    centre, scale, weights = (x.tolist() for x in _logistic(np.asarray(features), truth))
    found = Model(centre=centre, scale=scale, weights=weights).score(np.asarray(features))
    weights[-1] -= _threshold(found, truth)
    return Model(fitted[2], centre, scale, weights, prior)


def sample(docs: DataFrame, labels: DataFrame, learn: Column, most: int = SAMPLE, most_bytes: int = SAMPLE_BYTES) -> list[tuple[str | None, int]]:
    """At most ``most`` labelled rows and ``most_bytes`` of text of each kind.

    Labels name documents by id alone, so ids are chosen among the labels, ``most``
    of each kind, and broadcast to the documents.
    """
    ids = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("toxic").cast("int").alias("y")).where(learn & F.col("y").isin(0, 1))
    rank = F.row_number().over(Window.partitionBy("y").orderBy(F.xxhash64("doc_id"), "doc_id"))
    chosen = ids.distinct().withColumn("k", rank).where(F.col("k") <= most).select("doc_id", "y")
    return bounded_sample(texts(docs).join(F.broadcast(chosen), "doc_id"), most, most_bytes)


def score(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id and score of every text."""
    spark = prepare(docs.sparkSession)
    shared = spark.sparkContext.broadcast(model)

    def rate(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        for batch in batches:
            n = len(batch)
            if not m.weights:
                got = np.full(n, m.prior)
            elif n:
                got = m.score(np.asarray([m.features(t) for t in map(pa.StringScalar.as_py, batch.column("text"))]))
            else:
                got = np.zeros(0)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(got, pa.float64())], ["doc_id", "score"])

    return texts(docs).mapInArrow(lean(rate), "doc_id long, score double")
