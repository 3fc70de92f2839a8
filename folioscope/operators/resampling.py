"""Bootstrap intervals of means without gathering the values.

A resample of n rows is a multinomial draw over the distinct values, weighed by how
often each occurs. It is drawn in two steps: n draws are split over at most
``BUCKETS`` buckets of values, then each bucket's share over its values, one
conditional binomial after another. A bucket is streamed, so a task holds one number
per replicate, never the values; seeds depend on the seed, bucket and values alone, so
a task that is run again, or anywhere else, draws the same.

Defined cases: nulls and NaN don't count; without a value the bounds are null; infinite
values make infinite or NaN means, as they do in a plain mean.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Buckets at most, and distinct values that one is meant for.
BUCKETS, PER_BUCKET = 256, 2_000


def shares(totals: np.ndarray, replicates: int, seed: int) -> np.ndarray:
    """(replicates, buckets): how many of n draws fall to each bucket."""
    n = int(totals.sum())
    return np.random.default_rng([seed]).multinomial(n, totals / n, size=replicates)


class Split:
    """One bucket's draws, dealt to its values as they come."""

    def __init__(self, draws: np.ndarray, total: int, seed: int, bucket: int):
        self.left, self.mass = draws.copy(), int(total)
        self.random, self.sums = np.random.default_rng([seed, bucket + 1]), np.zeros(len(draws))

    def add(self, value: float, count: int) -> None:
        # The last value takes what is left: its share of the remaining mass is one.
        drawn = self.random.binomial(self.left, min(1.0, count / self.mass))
        self.left, self.mass = self.left - drawn, self.mass - count
        self.sums += np.where(drawn > 0, drawn * value, 0.0)


def bootstrap_means(values: DataFrame, value: str, replicates: int = 10_000, seed: int = 0) -> DataFrame:
    """(rep, mean) of every replicate."""
    spark = values.sparkSession
    v = F.col(value).cast("double")
    counted = values.select(v.alias("v")).where(v.isNotNull() & ~F.isnan(v)).groupBy("v").agg(F.count("*").alias("m"))
    distinct = counted.count()
    if not distinct:
        return spark.createDataFrame([], "rep long, mean double")
    n_buckets = min(BUCKETS, -(-distinct // PER_BUCKET))
    bucketed = counted.select(F.pmod(F.xxhash64("v"), F.lit(n_buckets)).cast("int").alias("bucket"), "v", "m")
    held = {r["bucket"]: r["n"] for r in bucketed.groupBy("bucket").agg(F.sum("m").alias("n")).collect()}  # at most BUCKETS rows
    names = sorted(held)
    totals = np.asarray([held[b] for b in names], np.int64)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        dealt, now, split = None, None, None

        def done() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(np.arange(replicates)), pa.array(split.sums)], ["rep", "s"])

        for b in batches:
            dealt = shares(totals, replicates, seed) if dealt is None else dealt
            for bucket, x, m in zip(*(c.to_pylist() for c in b.columns)):
                if bucket != now:
                    if split is not None:
                        yield done()
                    at = names.index(bucket)
                    now, split = bucket, Split(dealt[:, at], totals[at], seed, bucket)
                split.add(x, m)
        if split is not None:
            yield done()

    sums = bucketed.repartition("bucket").sortWithinPartitions("bucket", "v").mapInArrow(run, "rep long, s double")
    return sums.groupBy("rep").agg((F.sum("s") / int(totals.sum())).alias("mean"))


def bootstrap_interval(values: DataFrame, value: str, replicates: int = 10_000, seed: int = 0, level: float = 0.95) -> DataFrame:
    """One row (replicates, lo, hi): order statistics of the replicates' means."""
    means = bootstrap_means(values, value, replicates, seed).agg(F.sort_array(F.collect_list("mean")).alias("m"))  # one number a replicate
    at = lambda q: F.get("m", F.lit(min(replicates - 1, int(q * replicates))))
    return means.select(F.lit(replicates).cast("long").alias("replicates"), at((1 - level) / 2).alias("lo"), at((1 + level) / 2).alias("hi"))
