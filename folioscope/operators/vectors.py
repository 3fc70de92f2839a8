"""Signed hashing sketches of texts."""

from __future__ import annotations

import hashlib
import re

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, IntegerType, StructType

from folioscope.functions.text import BLOCK_STOP

DIM = 64


@F.pandas_udf(StructType().add("bucket", IntegerType()).add("sign", DoubleType()))
def token_bucket(token: pd.Series) -> pd.DataFrame:
    """Bucket and sign of a token from its 8-byte BLAKE2b digest."""
    digests = [hashlib.blake2b(t.encode(), digest_size=8).digest() for t in token]
    return pd.DataFrame({"bucket": [int.from_bytes(d[:4], "little") % DIM for d in digests], "sign": [1.0 if d[4] % 2 == 0 else -1.0 for d in digests]})


def text_sketches(terms: DataFrame, key: str) -> DataFrame:
    """(key, sketch): unit vectors of signed log counts from (key, token, tf).

    Each distinct token is hashed once and joined back; buckets are summed before
    the shuffle by key.
    """
    hashed = terms.select("token").distinct().withColumn("h", token_bucket("token"))
    summed = terms.join(hashed, "token").groupBy(key, F.col("h.bucket").alias("bucket")).agg(F.sum(F.col("h.sign") * F.log1p(F.col("tf").cast("double"))).alias("v"))
    held = summed.groupBy(key).agg(F.map_from_entries(F.collect_list(F.struct("bucket", "v"))).alias("m"), F.sqrt(F.sum(F.col("v") * F.col("v"))).alias("norm"))
    dense = F.transform(F.sequence(F.lit(0), F.lit(DIM - 1)), lambda i: F.coalesce(F.try_element_at("m", i), F.lit(0.0)) / F.when(F.col("norm") > 0, F.col("norm")).otherwise(1.0))
    return held.select(key, dense.alias("sketch"))


#: Digests that a worker keeps of tokens met before.
KEPT = 200_000
_TOKENS = re.compile(r"[a-z0-9]+").findall
_digests: dict[str, tuple[int, float]] = {}


def _hashed(tokens: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Buckets and signs as of :func:`token_bucket`."""
    if len(_digests) > KEPT:
        _digests.clear()
    for t in tokens:
        if t not in _digests:
            d = hashlib.blake2b(t.encode(), digest_size=8).digest()
            _digests[t] = int.from_bytes(d[:4], "little") % DIM, 1.0 if d[4] % 2 == 0 else -1.0
    found = [_digests[t] for t in tokens]
    return np.asarray([b for b, _ in found], np.int64), np.asarray([s for _, s in found], np.float64)


def counted_tokens(texts: list[str | None], stop: tuple[str, ...] = BLOCK_STOP) -> tuple[list[str], np.ndarray, np.ndarray, np.ndarray]:
    """(tokens, text, token, tf): how often the block profile's tokens occur in each text, by text and token number."""
    number: dict[str, int] = {t: k for k, t in enumerate(stop)}
    found = [_TOKENS((t or "").lower()) for t in texts]
    owner = np.repeat(np.arange(len(found)), np.fromiter(map(len, found), np.int64, len(found)))
    codes = np.fromiter((number.setdefault(t, len(number)) for words in found for t in words), np.int64, len(owner))
    used = codes >= len(stop)
    pairs, tf = np.unique(owner[used] * len(number) + codes[used], return_counts=True)
    text, token = np.divmod(pairs, max(1, len(number)))
    return list(number)[len(stop) :], text, token - len(stop), tf


def sketched(n: int, tokens: list[str], text: np.ndarray, token: np.ndarray, tf: np.ndarray) -> np.ndarray:
    """Sketches of n texts, one a row, from what :func:`counted_tokens` found; zeros for a text without tokens."""
    buckets, signs = _hashed(tokens)
    sums = np.bincount(text * DIM + buckets[token], signs[token] * np.log1p(tf), n * DIM).reshape(n, DIM) if len(text) else np.zeros((n, DIM))
    norm = np.sqrt((sums * sums).sum(1, keepdims=True))
    return sums / np.where(norm > 0, norm, 1.0)


def sketches(texts: pa.Array) -> np.ndarray:
    """Sketches of texts as of :func:`text_sketches`, one a row; repeated texts are read once."""
    known = texts.dictionary_encode()
    made = sketched(len(known.dictionary), *counted_tokens(known.dictionary.to_pylist()))
    at = np.asarray(pc.fill_null(known.indices, len(made)), np.int64)
    return np.vstack([made, np.zeros((1, DIM))])[at]


def linear_score(features: list[Column], weights: list[float], bias: float = 0.0) -> Column:
    """A linear scorer as one expression; weights are a model's, a few numbers."""
    return sum((f * F.lit(float(w)) for f, w in zip(features, weights, strict=True)), F.lit(float(bias)))


def yes_no_margin(yes: Column, no: Column) -> Column:
    """Mean log-probability of the yes tokens less that of the no tokens; null where either has none."""
    mean = lambda a: F.when(F.size(a) > 0, F.aggregate(a, F.lit(0.0), lambda s, x: s + x.cast("double")) / F.size(a))
    return mean(yes) - mean(no)


def fit_selector(rows: DataFrame, features: list[str], label: str, rounds: int = 100):
    """Class-weighted logistic regression: (weights, bias); a positive weighs as much as there are negatives to one."""
    from pyspark.ml.classification import LogisticRegression
    from pyspark.ml.feature import VectorAssembler

    counts = rows.agg(F.sum(F.col(label).cast("long")).alias("pos"), F.count("*").alias("n")).first()
    if not counts["pos"] or counts["pos"] == counts["n"]:
        raise ValueError("both labels are needed")
    weight = F.when(F.col(label) == 1, float((counts["n"] - counts["pos"]) / counts["pos"])).otherwise(1.0)
    ready = VectorAssembler(inputCols=features, outputCol="_x").transform(rows.withColumn("_w", weight).withColumn("_y", F.col(label).cast("double")))
    model = LogisticRegression(featuresCol="_x", labelCol="_y", weightCol="_w", maxIter=rounds).fit(ready)
    return model.coefficients.toArray().tolist(), float(model.intercept)


def in_page_residual(rows: DataFrame, page: list[str], score: str, weights: tuple[float, float, float]) -> DataFrame:
    """A block's score with a residual from its page's: mean, maximum and softmax-weighted mean, each with a weight."""
    from pyspark.sql import Window

    w = Window.partitionBy(*page)
    peaked = rows.withColumn("_peak", F.max(score).over(w)).withColumn("_e", F.exp(F.col(score) - F.col("_peak")))
    soft = F.sum(F.col("_e") * F.col(score)).over(w) / F.sum("_e").over(w)
    return peaked.withColumn("context_score", F.col(score) + weights[0] * F.avg(score).over(w) + weights[1] * F.col("_peak") + weights[2] * soft).drop("_peak", "_e")
