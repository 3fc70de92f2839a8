"""Paired statistics over binary and numeric arms."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType

from folioscope.session import bounded, written


def chi2_tail(x: float) -> float:
    """P(chi-squared with one degree of freedom > x)."""
    return math.erfc(math.sqrt(max(x, 0.0) / 2))


@F.pandas_udf(DoubleType())
def chi2_tail_column(x):
    """For frames of a few aggregate rows: Spark has no erfc."""
    return x.map(lambda v: None if v is None or v != v else chi2_tail(v))


@F.pandas_udf(DoubleType())
def z_tail_column(z):
    return z.map(lambda v: None if v is None or v != v else math.erfc(abs(v) / math.sqrt(2)))


def mcnemar(rows: DataFrame, base: Column, arm: Column, by: list[str] | None = None, variance: str = "exact", clamp: bool = False) -> DataFrame:
    """Discordant pairs (b: arm alone right, c: base alone right), difference, interval and chi-squared.

    ``variance`` is that of the difference, or 'null' under no difference; the
    continuity correction isn't clamped at 0 unless asked for.
    """
    if variance not in ("exact", "null"):
        raise ValueError(f"unknown variance {variance!r}")
    b = F.count_if(~base & arm)
    c = F.count_if(base & ~arm)
    counts = rows.groupBy(*(by or [])).agg(
        F.count("*").alias("n"), F.avg(base.cast("double")).alias("base_rate"), F.avg(arm.cast("double")).alias("arm_rate"), b.alias("b"), c.alias("c")
    )
    d, s, n = F.col("b") - F.col("c"), F.col("b") + F.col("c"), F.col("n")
    spread = s - d * d / n if variance == "exact" else s.cast("double")
    step = F.abs(d) - 1
    chi2 = F.when(s > 0, F.pow(F.greatest(step, F.lit(0)) if clamp else step, 2) / s).otherwise(0.0)
    se = F.sqrt(F.greatest(spread, F.lit(0.0))) / n
    out = counts.withColumn("delta", d / n).withColumn("se", se).withColumn("chi2", chi2)
    return out.withColumn("lo", F.col("delta") - 1.96 * F.col("se")).withColumn("hi", F.col("delta") + 1.96 * F.col("se"))


def with_p(rows: DataFrame) -> DataFrame:
    """p of :func:`mcnemar`; 1 without a discordant pair."""
    return rows.withColumn("p", F.when(F.col("b") + F.col("c") > 0, chi2_tail_column("chi2")).otherwise(1.0))


def bonferroni(rows: DataFrame, family: str, alpha: float = 0.05) -> DataFrame:
    """Family-wise and pooled thresholds, and which tests pass them."""
    sizes = rows.groupBy(family).agg(F.count("*").alias("family_size"))
    pooled = rows.agg(F.count("*").alias("pooled_size"))
    out = rows.join(sizes, family).crossJoin(F.broadcast(pooled))
    return out.withColumn("survives_family", F.col("p") < alpha / F.col("family_size")).withColumn("survives_pooled", F.col("p") < alpha / F.col("pooled_size"))


def paired_difference(rows: DataFrame, a: Column, b: Column, by: list[str] | None = None) -> DataFrame:
    """Mean difference b - a with its standard error, t, and wins, ties and losses."""
    d = (b - a).cast("double")
    return rows.groupBy(*(by or [])).agg(
        F.count(d).alias("n"), F.avg(d).alias("mean_diff"), F.stddev_samp(d).alias("sd"), (F.stddev_samp(d) / F.sqrt(F.count(d))).alias("se"),
        F.count_if(d > 0).alias("wins"), F.count_if(d == 0).alias("ties"), F.count_if(d < 0).alias("losses"),
    ).withColumn("t", F.when(F.col("se") > 0, F.col("mean_diff") / F.col("se")))


def two_sample(rows: DataFrame, effect: Column, is_left: Column, is_right: Column) -> DataFrame:
    """Difference of the mean effects of two disjoint strata, with unequal variances."""
    aggs = []
    for side, on in (("l", is_left), ("r", is_right)):
        v = F.when(on, effect.cast("double"))
        aggs += [F.count(v).alias(f"n_{side}"), F.avg(v).alias(f"mean_{side}"), F.var_samp(v).alias(f"var_{side}")]
    out = rows.agg(*aggs).withColumn("delta", F.col("mean_l") - F.col("mean_r"))
    out = out.withColumn("se", F.sqrt(F.col("var_l") / F.col("n_l") + F.col("var_r") / F.col("n_r")))
    return out.withColumn("z", F.when(F.col("se") > 0, F.col("delta") / F.col("se")).otherwise(0.0))


def bootstrap_index(rep: Column, i: Column, n: Column) -> Column:
    """A deterministic row number for replicate ``rep`` and place ``i``; quadratic, so that replicates aren't rotations."""
    return F.pmod(F.pmod((rep + 1) * F.lit(1103515245) + (i + 1) * F.lit(12345) + (rep + 7) * (i + 3) * (i + 3) * F.lit(7919), F.lit(2147483647)), n)


#: Values of one array of a bootstrap, and replicates that meet it at once.
CHUNK, REPLICATES = 1 << 20, 50
#: Places of a resample that are worked out at once.
_PLACES = 1 << 16
_PRIME = 2147483647


def _residue(x: np.ndarray) -> np.ndarray:
    """x mod 2^31 - 1 of whole numbers below 2^63."""
    for _ in range(2):
        x = (x & _PRIME) + (x >> 31)
    return np.where(x >= _PRIME, x - _PRIME, x)


def resample_sums(values: np.ndarray, start: int, n: int, reps: np.ndarray) -> np.ndarray:
    """Of each replicate of n values the sum of those that are ``values``, which stand at ``start`` and after.

    The row numbers are those of :func:`bootstrap_index`; every step is reduced, so that none overflows.
    """
    sums = np.zeros(len(reps))
    shifts, steps = (((reps.astype(object) + 1) * 1103515245) % _PRIME).astype(np.int64), ((reps + 7) % _PRIME).astype(np.int64)
    for at in range(0, n, _PLACES):
        i = np.arange(at, min(at + _PLACES, n), dtype=np.int64)
        square = _residue(_residue(_residue(i + 3) ** 2) * 7919)
        line = _residue(_residue(i + 1) * 12345)
        for k in range(len(reps)):
            row = _residue(square * steps[k] + (line + shifts[k]))
            if n < _PRIME:
                row = row.astype(np.uint32)
                row = row - row // np.uint32(n) * np.uint32(n)
            if start == 0 and len(values) == n:
                sums[k] += values[row].sum()
            else:
                row = row.astype(np.int64) - start
                sums[k] += values[row[(row >= 0) & (row < len(values))]].sum()
    return sums


def _placed(values: DataFrame, value: str, order: list[str]) -> tuple[DataFrame, int]:
    """(i, v) of the values that aren't null, numbered from 0 in order, and how many there are.

    Ranges of the order are numbered side by side; only their sizes, a few numbers, pass the driver.
    """
    kept = values.where(F.col(value).isNotNull()).select(*order, value).repartitionByRange(*order, value).sortWithinPartitions(*order, value)
    shards = written(kept.select(F.monotonically_increasing_id().alias("at"), F.col(value).cast("double").alias("v")), "bootstrap-values")
    shard = F.shiftrightunsigned("at", 33)
    sizes = shards.groupBy(shard.alias("shard")).agg(F.count("*").alias("n")).orderBy("shard").collect()
    before, total = [], 0
    for r in sizes:
        before += [F.lit(r["shard"]), F.lit(total)]
        total += r["n"]
    if not total:
        return shards.select(F.lit(0).alias("i"), "v"), 0
    return shards.select((F.element_at(F.create_map(*before), shard) + F.col("at").bitwiseAND((1 << 33) - 1)).alias("i"), "v"), total


def bootstrap_mean(values: DataFrame, value: str, order: list[str], replicates: int = 10_000) -> DataFrame:
    """Percentile interval of the mean from resamples.

    For a study's rows, whose resamples must equal another program's by row number:
    every replicate reads all row numbers, so the work is replicates times values. Values
    lie in arrays of at most ``CHUNK``, and a task holds one of them.
    :func:`resampling.bootstrap_interval` needs no row numbers.
    """
    spark = bounded(values.sparkSession)
    placed, n = _placed(values, value, order)
    chunks = placed.groupBy(F.floor(F.col("i") / CHUNK).alias("chunk")).agg(F.transform(F.array_sort(F.collect_list(F.struct("i", "v"))), lambda s: s.v).alias("v"))
    grid = spark.range(0, replicates, REPLICATES, max(1, -(-replicates // REPLICATES))).select(F.col("id").alias("rep"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            first, chunk, held = (b.column(c) for c in ("rep", "chunk", "v"))
            for k in range(b.num_rows):
                reps = np.arange(first[k].as_py(), min(first[k].as_py() + REPLICATES, replicates))
                sums = resample_sums(np.asarray(held[k].values, np.float64), chunk[k].as_py() * CHUNK, n, reps)
                yield pa.RecordBatch.from_arrays([pa.array(reps), pa.array(sums)], ["rep", "s"])

    sums = grid.crossJoin(chunks).select("rep", "chunk", "v").mapInArrow(run, "rep long, s double")
    means = sums.groupBy("rep").agg((F.sum("s") / max(1, n)).alias("m"))
    ordered = means.agg(F.sort_array(F.collect_list("m")).alias("m"))  # one number a replicate
    at = lambda q: F.get("m", F.lit(int(q * replicates)))
    return ordered.select(F.lit(replicates).cast("long").alias("replicates"), at(0.025).alias("lo"), at(0.975).alias("hi"))


def difference_in_differences(rows: DataFrame, sample: str, level: str, effect: Column, high, low) -> DataFrame:
    """Per-sample effect at one level less that at another, over samples with both."""
    wide = rows.groupBy(sample).agg(F.max(F.when(F.col(level) == high, effect.cast("double"))).alias("h"), F.max(F.when(F.col(level) == low, effect.cast("double"))).alias("l"))
    d = F.col("h") - F.col("l")
    out = wide.where("h IS NOT NULL AND l IS NOT NULL").agg(F.count("*").alias("n"), F.avg(d).alias("interaction"), (F.sqrt(F.var_samp(d) / F.count("*"))).alias("se"))
    return out.withColumn("z", F.when(F.col("se") > 0, F.col("interaction") / F.col("se")).otherwise(0.0))


def recovered_share(arm_gain: Column, full_gain: Column) -> Column:
    return F.when(full_gain != 0, arm_gain / full_gain)


def abstention(rows: DataFrame, unanswerable: Column, abstained: Column) -> DataFrame:
    """Hit rate on unanswerable rows, false alarms on the others, and their balance."""
    hit = F.avg(F.when(unanswerable, abstained.cast("double")))
    false = F.avg(F.when(~unanswerable, abstained.cast("double")))
    return rows.agg(hit.alias("hit_rate"), false.alias("false_alarm"), ((hit + 1 - false) / 2).alias("balanced_accuracy"))


def common_samples(arms: dict[str, DataFrame], key: str, value: str) -> DataFrame:
    """One row per sample that every arm has, an arm per column; one shuffle for any number of arms."""
    stacked = None
    for name, rows in arms.items():
        part = rows.select(key, F.lit(name).alias("arm"), F.col(value).alias("v"))
        stacked = part if stacked is None else stacked.unionByName(part)
    wide = stacked.groupBy(key).agg(F.count_distinct("arm").alias("n_arms"), *[F.max(F.when(F.col("arm") == a, F.col("v"))).alias(a) for a in arms])
    return wide.where(F.col("n_arms") == len(arms)).drop("n_arms")


def win_share(rows: DataFrame, a: Column, b: Column) -> DataFrame:
    """Over samples with both: share where b is larger, and the mean of b - a."""
    both = rows.where(a.isNotNull() & b.isNotNull())
    return both.agg(F.count("*").alias("n"), F.avg((b > a).cast("double")).alias("win_share"), F.avg((b - a).cast("double")).alias("mean_delta"))


def paired_with_interval(rows: DataFrame, a: Column, b: Column, replicates: int = 10_000, seed: int = 0) -> DataFrame:
    """:func:`paired_difference` over all rows, with the bootstrap interval of the mean."""
    from folioscope.operators.resampling import bootstrap_interval

    d = rows.select((b - a).cast("double").alias("d"))
    return paired_difference(rows, a, b).crossJoin(bootstrap_interval(d, "d", replicates, seed))  # one row each
