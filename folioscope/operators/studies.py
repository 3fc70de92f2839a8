"""Studies assembled from the paired operators: contrasts of arms, foreign memory, judge agreement, selections with reasons."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from folioscope.operators.paired import common_samples, mcnemar
from folioscope.operators.sets import Guards


def arm_contrasts(wide: DataFrame, contrasts: list[tuple[str, str]], by: list[str] | None = None, variance: str = "exact") -> DataFrame:
    """One row per contrast (base, arm) of one-row-per-sample arms: counts, rates, difference, interval and chi-squared.

    All contrasts are counted over the same samples, stacked, so there is one
    shuffle for any number of them.
    """
    stacked = [wide.select(*(by or []), F.lit(b).alias("base"), F.lit(a).alias("arm"), F.col(b).alias("_b"), F.col(a).alias("_a")) for b, a in contrasts]
    rows = reduce(DataFrame.unionByName, stacked)
    return mcnemar(rows, F.col("_b"), F.col("_a"), [*(by or []), "base", "arm"], variance)


def foreign_memory(images: DataFrame, own: DataFrame, foreign: DataFrame, level: str, guards: Guards | None = None) -> DataFrame:
    """Whose text a memory must hold to help: three arms (sample, level, correct) at every level of recall.

    Contrasts per level: own and foreign memory over images, and own over foreign;
    ``recovered`` is the foreign gain over the own one, null without a gain. Samples
    count that all three arms have; others are counted by ``guards``.
    """
    arms = {"images": images, "own": own, "foreign": foreign}
    keyed = {a: rows.select(F.struct(level, "sample").alias("key"), F.col("correct").cast("int").alias("v")) for a, rows in arms.items()}
    if guards is not None:
        stacked = reduce(DataFrame.unionByName, [rows.select("key", F.lit(1).alias("one")) for rows in keyed.values()])
        guards.watch("arms", stacked.groupBy("key").agg(F.sum("one").alias("held")), unaligned=F.col("held") != len(arms)).write.format("noop").mode("overwrite").save()
    wide = common_samples(keyed, "key", "v").select(F.col(f"key.{level}").alias(level), *[(F.col(a) == 1).alias(a) for a in arms])
    out = arm_contrasts(wide, [("images", "own"), ("images", "foreign"), ("foreign", "own")], [level])
    gains = out.where("base = 'images'").groupBy(level).agg(F.max(F.when(F.col("arm") == "own", F.col("delta"))).alias("of_own"), F.max(F.when(F.col("arm") == "foreign", F.col("delta"))).alias("of_foreign"))
    return out.join(gains.select(level, F.when(F.col("of_own") != 0, F.col("of_foreign") / F.col("of_own")).alias("recovered")), level)


def judge_agreement(rows: DataFrame, old: Column, new: Column, task: str) -> DataFrame:
    """Two judges' verdicts per task, and pooled (null task): strict rates, their difference with its interval, strict and three-way agreement."""
    strict = lambda v: F.coalesce(v == "correct", F.lit(False))
    held = rows.select(task, strict(old).alias("o"), strict(new).alias("n"), F.coalesce(old == new, F.lit(False)).alias("same"))
    count = F.count("*").cast("double")
    counted = held.groupingSets([[task], []], task).agg(
        F.count("*").alias("samples"), F.avg(F.col("o").cast("double")).alias("old_rate"), F.avg(F.col("n").cast("double")).alias("new_rate"),
        F.count_if(F.col("n") & ~F.col("o")).alias("b"), F.count_if(F.col("o") & ~F.col("n")).alias("c"),
        (F.count_if(F.col("o") == F.col("n")) / count).alias("agree"), (F.count_if("same") / count).alias("agree_three"),
    )
    n = F.col("samples").cast("double")
    return counted.withColumn("delta", (F.col("b") - F.col("c")) / n).withColumn("half", 1.96 * F.sqrt((F.col("b") + F.col("c")).cast("double")) / n)


def external_selection(ranked: Column, known: Column, k: int, fallback: int) -> Column:
    """struct(selected, used, reason, missing, n_ranked) of an outside ranking (null: the sample has none).

    The ranking is walked until ``k`` known pages are found; ``missing`` lists the
    first ten pages met on the way that the sample doesn't have, repeats included.
    Without a known page the first ``fallback`` known pages stand in, with the reason.
    """
    k, fallback = max(1, k), max(1, fallback)
    walked = F.coalesce(ranked, F.slice(known, 1, 0))
    empty = F.struct(F.slice(walked, 1, 0).alias("selected"), F.slice(walked, 1, 0).alias("missing"))

    def step(s: Column, p: Column) -> Column:
        done = (F.size(s.selected) >= k) | F.array_contains(s.selected, p)
        held = F.array_contains(known, p)
        return F.struct(
            F.when(~done & held, F.array_append(s.selected, p)).otherwise(s.selected).alias("selected"),
            F.when(~done & ~held, F.array_append(s.missing, p)).otherwise(s.missing).alias("missing"),
        )

    found = F.aggregate(walked, empty, step)
    used = F.size(found.selected) > 0
    return F.struct(
        F.when(used, found.selected).otherwise(F.slice(known, 1, fallback)).alias("selected"), used.alias("used"),
        F.when(ranked.isNull(), "missing_external_prediction").when(~used, "no_valid_external_page").alias("reason"), F.slice(found.missing, 1, 10).alias("missing"), F.size(walked).alias("n_ranked"),
    )
