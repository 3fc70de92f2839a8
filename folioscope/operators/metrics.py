"""Retrieval, evidence and ranking metrics."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def recall(gold: Column, selected: Column) -> Column:
    """Share of distinct gold items selected; null without gold, 0 without a selection."""
    g = F.array_distinct(gold)
    hit = F.size(F.array_intersect(g, F.coalesce(selected, F.array().cast("array<bigint>"))))
    return F.when(F.size(g) > 0, hit / F.size(g).cast("double"))


def full_recall(gold: Column, selected: Column) -> Column:
    g = F.array_distinct(gold)
    return F.when(F.size(g) > 0, (F.size(F.array_except(g, F.coalesce(selected, F.array().cast("array<bigint>")))) == 0).cast("double"))


def evaluate_rankings(manifest: DataFrame, predictions: DataFrame, ks: tuple[int, ...], by: str) -> DataFrame:
    """Per k, overall and by group: samples, samples with gold, mean recall, full recall and hit rate.

    manifest: (sample_id, by, gold); predictions: (sample_id, ranked). A sample
    without a prediction counts with an empty ranking; one without gold is left
    out of the means.
    """
    joined = manifest.join(predictions, "sample_id", "left")
    rows = joined.withColumn("k", F.explode(F.array(*[F.lit(k).cast("long") for k in ks])))
    cut = F.slice(F.coalesce("ranked", F.array().cast("array<bigint>")), F.lit(1), F.col("k").cast("int"))
    scored = rows.select("k", by, recall(F.col("gold"), cut).alias("r"), full_recall(F.col("gold"), cut).alias("f"))
    aggs = [
        F.count("*").alias("n"), F.count("r").alias("n_gold"), F.avg("r").alias("recall"),
        F.avg("f").alias("full_recall"), F.avg((F.col("r") > 0).cast("double")).alias("hit_rate"),
    ]
    return scored.groupingSets([["k"], ["k", by]], "k", by).agg(*aggs)


def auroc(rows: DataFrame, label: str, score: str, by: list[str] | None = None) -> DataFrame:
    """Rank-sum AUROC with mid-ranks for ties; null unless both labels occur.

    Scores are counted first, so the running total is over distinct scores.
    """
    by = by or []
    counted = rows.groupBy(*by, score).agg(F.count("*").alias("m"), F.sum(F.col(label).cast("long")).alias("pos"))
    before = F.coalesce(F.sum("m").over(Window.partitionBy(*by).orderBy(score).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    ranked = counted.withColumn("rank", before + (F.col("m") + 1) / 2.0)
    total = ranked.groupBy(*by).agg(F.sum("pos").alias("n_pos"), (F.sum("m") - F.sum("pos")).alias("n_neg"), F.sum(F.col("rank") * F.col("pos")).alias("s"))
    value = (F.col("s") - F.col("n_pos") * (F.col("n_pos") + 1) / 2.0) / (F.col("n_pos") * F.col("n_neg"))
    return total.select(*by, "n_pos", "n_neg", F.when((F.col("n_pos") > 0) & (F.col("n_neg") > 0), value).alias("auroc"))


def recall_at_budget(rows: DataFrame, group: str, label: str, order: list[Column], budget: int) -> DataFrame:
    """Over groups with gold: mean share of gold in the top ``budget``, and of groups with all of it."""
    ranked = rows.withColumn("rn", F.row_number().over(Window.partitionBy(group).orderBy(*order)))
    per = ranked.groupBy(group).agg(F.sum(label).alias("gold"), F.sum(F.when(F.col("rn") <= budget, F.col(label)).otherwise(0)).alias("hit")).where("gold > 0")
    return per.agg(F.count("*").alias("n_groups"), F.avg(F.col("hit") / F.col("gold")).alias("recall"), F.avg((F.col("hit") == F.col("gold")).cast("double")).alias("full_recall"))


def evidence_coverage(gold_pages: Column, gold_blocks: Column, pages: Column, blocks: Column) -> dict[str, Column]:
    """Page and block recall of one sample, tri-state: null without evidence or without a selection to judge."""
    judged = lambda sel, value: F.when(sel.isNotNull(), value)
    part = lambda g, s: F.when(F.size(g) > 0, F.size(F.array_intersect(g, s)) / F.size(g).cast("double"))
    whole = lambda g, s: F.when(F.size(g) > 0, (F.size(F.array_except(g, s)) == 0).cast("double"))
    gp, gb = F.array_distinct(gold_pages), F.array_distinct(gold_blocks)
    return {
        "page_recall": judged(pages, part(gp, pages)), "page_full": judged(pages, whole(gp, pages)),
        "block_recall": judged(blocks, part(gb, blocks)), "block_full": judged(blocks, whole(gb, blocks)),
    }


def evidence_aggregate(rows: DataFrame, by: list[str]) -> DataFrame:
    """Means over the rows where each metric is known, and recall per visual token."""
    return rows.groupBy(*by).agg(
        F.count("*").alias("n"), F.avg("page_recall").alias("page_recall"), F.avg("page_full").alias("page_full"),
        F.avg("block_recall").alias("block_recall"), F.avg("block_full").alias("block_full"), F.avg("visual_tokens").alias("visual_tokens"),
        (F.avg("page_recall") / F.nullif(F.avg("visual_tokens"), F.lit(0.0))).alias("efficiency"),
    )


def standardize(rows: DataFrame, columns: list[str]) -> DataFrame:
    """(x - mean) / (population deviation + 1e-6), by one small aggregate joined to all rows."""
    stats = rows.agg(*[f(c).alias(f"{n}_{c}") for c in columns for n, f in (("mean", F.avg), ("std", F.stddev_pop))])
    return rows.crossJoin(F.broadcast(stats)).select(*rows.columns, *[((F.col(c) - F.col(f"mean_{c}")) / (F.col(f"std_{c}") + 1e-6)).alias(f"{c}_z") for c in columns])
