"""Pairwise and listwise losses as grouped aggregates over (group, label, score)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def hinge_top_negatives(rows: DataFrame, group: str, label: Column, score: Column, tie: list[str], hardest: int, margin: float) -> DataFrame:
    """Mean of max(0, margin - pos + neg) over positives and the hardest negatives of each group."""
    marked = rows.select(group, *tie, label.alias("is_pos"), score.alias("s"))
    rank = F.row_number().over(Window.partitionBy(group, "is_pos").orderBy(F.col("s").desc(), *tie))
    held = marked.withColumn("r", rank).where(F.col("is_pos") | (F.col("r") <= hardest))
    negatives = held.where(~F.col("is_pos")).groupBy(group).agg(F.collect_list("s").alias("negatives"))  # at most ``hardest``
    pairs = held.where("is_pos").join(negatives, group)
    loss = F.aggregate("negatives", F.lit(0.0), lambda a, n: a + F.greatest(F.lit(0.0), F.lit(margin) - F.col("s") + n))
    return pairs.groupBy(group).agg((F.sum(loss) / F.sum(F.size("negatives"))).alias("loss"))


def softmax_nll(rows: DataFrame, group: str, label: Column, score: Column, temperature: float = 1.0) -> DataFrame:
    """-log of the positives' softmax mass (InfoNCE), shifted by the group's maximum."""
    s = score / temperature
    peak = rows.groupBy(group).agg(F.max(s).alias("peak"))
    e = F.exp(s - F.col("peak"))
    out = rows.join(peak, group).groupBy(group).agg(F.sum(F.when(label, e).otherwise(0.0)).alias("p"), F.sum(e).alias("z"))
    return out.where("p > 0").select(group, F.log(F.col("z") / F.col("p")).alias("loss"))


def softplus_margin(pos: Column, neg: Column) -> Column:
    d = neg - pos
    return F.greatest(d, F.lit(0.0)) + F.log1p(F.exp(-F.abs(d)))


def in_group_context(rows: DataFrame, group: list[str], score: str) -> DataFrame:
    """Mean, maximum and softmax weight of a score within its group."""
    w = Window.partitionBy(*group)
    peak = F.max(score).over(w)
    shifted = rows.withColumn("mean_score", F.avg(score).over(w)).withColumn("max_score", peak)
    shifted = shifted.withColumn("e", F.exp(F.col(score) - F.col("max_score")))
    return shifted.withColumn("softmax", F.col("e") / F.sum("e").over(w)).drop("e")


def budget_margin(rows: DataFrame, group: str, label: Column, score: Column, tie: list[str], budget: int, margin: float) -> DataFrame:
    """Mean of max(0, margin - pos + threshold): the threshold is the first negative that must not fit beside the positives.

    Groups without a positive, or whose negatives all fit, have no loss.
    """
    marked = rows.select(group, *tie, label.alias("is_pos"), score.alias("s"))
    rank = F.row_number().over(Window.partitionBy(group, "is_pos").orderBy(F.col("s").desc(), *tie))
    counts = marked.groupBy(group).agg(F.count_if("is_pos").alias("n_pos"), F.count_if(~F.col("is_pos")).alias("n_neg"))
    fits = F.greatest(F.lit(0).cast("long"), F.lit(budget) - F.col("n_pos"))
    edge = marked.withColumn("k", rank).where(~F.col("is_pos")).join(counts, group).where((F.col("n_pos") > 0) & (F.col("n_neg") > fits) & (F.col("k") == fits + 1))
    pairs = marked.where("is_pos").join(edge.select(group, F.col("s").alias("threshold")), group)
    return pairs.groupBy(group).agg(F.avg(F.greatest(F.lit(0.0), F.lit(margin) - F.col("s") + F.col("threshold"))).alias("loss"), F.count("*").alias("pairs"))


def softplus_ranking(rows: DataFrame, group: str, label: Column, score: Column, tie: list[str], hardest: int, margin: float) -> DataFrame:
    """Mean softplus(margin - pos + neg) over positives and the hardest negatives."""
    marked = rows.select(group, *tie, label.alias("is_pos"), score.alias("s"))
    rank = F.row_number().over(Window.partitionBy(group, "is_pos").orderBy(F.col("s").desc(), *tie))
    held = marked.withColumn("k", rank).where(F.col("is_pos") | (F.col("k") <= max(1, hardest)))
    negatives = held.where(~F.col("is_pos")).groupBy(group).agg(F.collect_list("s").alias("negatives"))  # at most ``hardest``
    pairs = held.where("is_pos").join(negatives, group)
    loss = F.aggregate("negatives", F.lit(0.0), lambda a, n: a + softplus_margin(F.col("s"), n + F.lit(margin)))
    return pairs.groupBy(group).agg((F.sum(loss) / F.sum(F.size("negatives"))).alias("loss"))


def soft_membership(rows: DataFrame, group: str, score: str, tie: list[str], keep: int, temperature: float) -> DataFrame:
    """``membership``: sigmoid of the distance from the midpoint between the last kept and the first dropped score; 1 where all are kept, 0 where none is."""
    w = Window.partitionBy(group)
    ranked = rows.withColumn("_k", F.row_number().over(w.orderBy(F.col(score).desc(), *tie))).withColumn("_n", F.count("*").over(w))
    at = lambda k: F.max(F.when(F.col("_k") == k, F.col(score))).over(w)
    threshold = 0.5 * (at(keep) + at(keep + 1))
    soft = 1.0 / (1.0 + F.exp(-(F.col(score) - threshold) / max(temperature, 1e-6)))
    value = F.lit(0.0) if keep <= 0 else F.when(F.col("_n") <= keep, 1.0).otherwise(soft)
    return ranked.withColumn("membership", value).drop("_k", "_n")


def boundary_negatives(rows: DataFrame, group: str, label: Column, score: Column, tie: list[str], keep: int, most: int) -> DataFrame:
    """The negatives just beyond those that fit beside the positives, ``most`` of them (0: as many as are kept)."""
    marked = rows.withColumn("_pos", label).withColumn("_s", score)
    n_pos = F.count_if("_pos").over(Window.partitionBy(group))
    rank = F.row_number().over(Window.partitionBy(group, "_pos").orderBy(F.col("_s").desc(), *tie))
    fits = F.greatest(F.lit(0).cast("long"), F.lit(keep) - F.least(n_pos, F.lit(keep).cast("long")))
    ranked = marked.withColumn("_k", rank).withColumn("_fits", fits).where(~F.col("_pos"))
    return ranked.where((F.col("_k") > F.col("_fits")) & (F.col("_k") <= F.col("_fits") + (most if most > 0 else max(1, keep)))).drop("_pos", "_s", "_k", "_fits")


def distillation(rows: DataFrame, group: str, student: Column, teacher: Column, temperature: float = 1.0) -> DataFrame:
    """KL divergence of the student's softmax from the teacher's over rows with a teacher score, times t * t over their count.

    Groups with fewer than two such rows have no loss.
    """
    t = max(1e-6, temperature)
    held = rows.select(group, (student / t).alias("s"), (teacher / t).alias("q")).where("q IS NOT NULL")
    peak = held.groupBy(group).agg(F.max("s").alias("ps"), F.max("q").alias("pq"), F.count("*").alias("n")).where("n >= 2")
    shifted = held.join(peak, group).select(group, "n", (F.col("s") - F.col("ps")).alias("s"), (F.col("q") - F.col("pq")).alias("q"))
    # sum p (ln p - ln s) with p = e^q / Z, from sums that combine before the shuffle
    per = shifted.groupBy(group, "n").agg(F.sum(F.exp("q")).alias("zq"), F.sum(F.exp("s")).alias("zs"), F.sum(F.exp("q") * (F.col("q") - F.col("s"))).alias("cross"))
    divergence = F.greatest(F.lit(0.0), F.col("cross") / F.col("zq") - F.log("zq") + F.log("zs"))  # rounding may go below 0
    return per.select(group, (divergence * t * t / F.col("n")).alias("loss"))


def weighted_loss(parts: DataFrame, weights: dict[str, float]) -> DataFrame:
    """(loss, n per part): the weighted sum of the means of loss columns, each over the groups that have it."""
    total = sum((F.coalesce(F.avg(c), F.lit(0.0)) * w for c, w in weights.items()), F.lit(0.0))
    return parts.agg(total.alias("loss"), *[F.count(c).alias(f"n_{c}") for c in weights])
