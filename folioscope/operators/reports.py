"""Reader reports: summaries by mode, where losses come from, what a changed prediction gained."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from folioscope.functions.text import normalize_space

LOSSES = ("retrieval_miss", "join_failure", "selector_dropped", "other")


def row_score(judge_verdict: Column, scorable: Column, score: Column, metric: str = "judge") -> Column:
    """1 or 0 by the judge's verdict, or the string-match score; null where there is no usable one."""
    if metric == "judge":
        return F.when(judge_verdict.isNotNull() & (judge_verdict != "error"), (judge_verdict == "correct").cast("double"))
    return F.when(F.coalesce(scorable, F.lit(False)), F.coalesce(score, F.lit(0.0)))


def reader_summary(rows: DataFrame, by: list[str]) -> DataFrame:
    """n, scorable rows and their mean score, per group and over all."""
    on = F.coalesce("scorable", F.lit(False))
    aggs = [F.count("*").alias("n"), F.count_if(on).alias("n_scorable"), F.avg(F.when(on, F.coalesce("score", F.lit(0.0)))).alias("score")]
    return rows.groupingSets([by, by[-1:]], *by).agg(*aggs) if len(by) > 1 else rows.groupBy(*by).agg(*aggs)


def mode_deltas(rows: DataFrame, by: str, mode: str, modes: list[str], base: str) -> DataFrame:
    """Mean scorable score of every mode as a column, and each one's difference from ``base``; null where a mode is missing."""
    on = F.coalesce("scorable", F.lit(False))
    wide = rows.groupBy(by).agg(*[F.avg(F.when(on & (F.col(mode) == m), F.col("score"))).alias(m) for m in modes])
    return wide.select("*", *[(F.col(m) - F.col(base)).alias(f"{m}_delta") for m in modes if m != base])


def loss_kind(score: Column, full_recall: Column, gold: Column, fact_pages: Column) -> Column:
    """Why an answer that isn't fully right went wrong; null for a right one.

    Not all gold pages retrieved; all of them in memory, so not joined; some of
    them dropped by the selector; or no gold at all.
    """
    g = F.array_distinct(F.coalesce(gold, F.array().cast("array<bigint>")))
    held = F.size(F.array_intersect(g, F.coalesce(fact_pages, F.array().cast("array<bigint>"))))
    kind = F.when(~F.coalesce(full_recall, F.lit(False)), "retrieval_miss").when(F.size(g) == 0, "other").when(held >= F.size(g), "join_failure").otherwise("selector_dropped")
    return F.when(score < 1.0, kind)


def decompose_losses(rows: DataFrame, by: list[str]) -> DataFrame:
    """Counts of every kind of loss, one column each. rows: score, full_recall, gold, fact_pages."""
    kind = loss_kind(F.col("score"), F.col("full_recall"), F.col("gold"), F.col("fact_pages"))
    return rows.withColumn("kind", kind).groupBy(*by).agg(F.count("kind").alias("losses"), *[F.count_if(F.col("kind") == k).alias(k) for k in LOSSES])


def genuine_split(pairs: DataFrame, by: list[str]) -> DataFrame:
    """The score difference per 100 samples, split by whether the prediction's text changed.

    pairs: treat_pred, base_pred, treat, base. What identical texts differ by is
    the grader's noise.
    """
    same = normalize_space(F.col("treat_pred")) == normalize_space(F.col("base_pred"))
    d = F.col("treat") - F.col("base")
    share = lambda on: 100 * F.sum(F.when(on, d).otherwise(0.0)) / F.count("*")
    return pairs.groupBy(*by).agg(
        F.count("*").alias("n"), F.count_if(~same).alias("n_genuine"), F.count_if(same).alias("n_same"),
        share(~same).alias("genuine_delta_per100"), share(same).alias("noise_delta_per100"),
    )


def recall_strata(pairs: DataFrame) -> DataFrame:
    """Paired means by whether the base arm had full recall; rows where that is unknown are in neither."""
    d = F.col("treat") - F.col("base")
    named = pairs.where(F.col("full_recall").isNotNull()).withColumn("stratum", F.when(F.col("full_recall"), "recall_success").otherwise("recall_miss"))
    return named.groupBy("stratum").agg(F.count("*").alias("n"), F.avg("base").alias("base"), F.avg("treat").alias("treat"), F.avg(d).alias("diff"))


def full_recall_rate(full_recall: Column) -> Column:
    """Share of rows with full recall; an unknown one counts as none."""
    return F.avg(F.coalesce(full_recall.cast("int"), F.lit(0)))


def sample_fidelity(rows: DataFrame, sample: str, value: str) -> DataFrame:
    """Worst and mean fidelity of a sample's evidence, over the known values."""
    return rows.groupBy(sample).agg(F.min(value).alias("fidelity_min"), F.avg(value).alias("fidelity_mean"), F.count(value).alias("n_evidence"))


def find_row(table: DataFrame, *parts: str) -> DataFrame:
    """The first row (by table and row) of a report whose cells hold all of ``parts``."""
    held = table
    for p in parts:
        held = held.where(F.exists(F.map_values("cells"), lambda c: F.contains(c, F.lit(p))))  # noqa: B023
    return held.orderBy("file", "table", "row").limit(1)
