"""Control experiments: degraded recall, foreign stores, leakage."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from folioscope.operators.sets import Guards


def degrade_ranking(top: Column, gold: Column, spare: Column, j: Column) -> Column:
    """Drop the j lowest gold pages and append the j lowest spare ones; the length stays."""
    drop = F.slice(F.array_sort(F.array_distinct(gold)), F.lit(1), j)
    return F.concat(F.filter(top, lambda p: ~F.array_contains(drop, p)), F.slice(F.array_sort(F.array_distinct(spare)), F.lit(1), j))


def derangement(documents: DataFrame, key: str, family: str) -> DataFrame:
    """(key, donor, same_family): every document gets another one's store.

    Documents are ordered by family, and the donor is as many places on as the
    largest family has members: never the same document, and never the same
    family unless one holds more than half of all. Places are counts before a
    document's family plus its rank within it, so only family sizes meet in one
    task.
    """
    ranked = documents.select(key, family).withColumn("r", F.row_number().over(Window.partitionBy(family).orderBy(key)) - 1)
    sizes = documents.groupBy(family).agg(F.count("*").alias("size"))
    everyone = Window.orderBy(family).rowsBetween(Window.unboundedPreceding, -1)
    bases = sizes.select(family, F.coalesce(F.sum("size").over(everyone), F.lit(0)).alias("base"))
    totals = sizes.agg(F.sum("size").alias("n"), F.max("size").alias("shift"))
    placed = ranked.join(bases, family).select(key, family, (F.col("base") + F.col("r")).alias("place"))
    wanted = placed.crossJoin(F.broadcast(totals)).select(key, family, F.pmod(F.col("place") + F.col("shift"), F.col("n")).alias("place"))
    donors = placed.select(F.col(key).alias("donor"), F.col(family).alias("donor_family"), "place")
    return wanted.join(donors, "place").select(key, "donor", (F.col(family) == F.col("donor_family")).alias("same_family"))


def donor_page(page: Column, donor_pages: Column) -> Column:
    """Recipient page i takes donor page i mod n, both from 1."""
    return F.pmod(page - 1, donor_pages) + 1


def leaked(packed: Column, answers: Column, least: int | Column) -> Column:
    """Whether any normalised answer of at least ``least`` characters is in the packed text."""
    return F.coalesce(F.exists(answers, lambda a: (F.length(a) >= least) & F.contains(packed, a)), F.lit(False))


def bins(value: Column, edges: tuple[float, ...]) -> Column:
    """0-based half-open bin of ascending edges; the last one takes the rest."""
    out = F.lit(len(edges) - 1)
    for k in range(len(edges) - 1, 0, -1):
        out = F.when(value < edges[k], k - 1).otherwise(out)
    return F.when(value.isNotNull(), out).cast("long")


def ranges(value: Column, bounds: tuple[tuple[float, float], ...]) -> Column:
    """0-based number of the first inclusive range that holds the value; null in none."""
    out = F.lit(None).cast("long")
    for k in range(len(bounds) - 1, -1, -1):
        out = F.when(value.between(*bounds[k]), F.lit(k).cast("long")).otherwise(out)
    return out


def guarded_arms(guards: Guards, name: str, arm: DataFrame, base: DataFrame, images: DataFrame, budget: int = 16, source: str = "ocr") -> DataFrame:
    """One row per id of an arm, its base and its image run, with what must hold counted as it passes.

    arm: (id, selected_page_ids, num_selected_pages, memory_block_source); base: (id);
    images: (id, selected_page_ids). Guards: ``unpaired`` (ids that not all three have),
    ``pages_moved``, ``budget_moved`` and ``other_source``. Sides meet once, by id.
    """
    sides = arm.select("id", F.lit(1).alias("side"), F.col("selected_page_ids").alias("pages"), "num_selected_pages", "memory_block_source")
    sides = sides.unionByName(base.select("id", F.lit(2).alias("side")), allowMissingColumns=True)
    sides = sides.unionByName(images.select("id", F.lit(4).alias("side"), F.col("selected_page_ids").alias("pages")), allowMissingColumns=True)
    of = lambda side, c: F.max(F.when(F.col("side") == side, F.col(c))).alias
    rows = sides.groupBy("id").agg(
        F.bit_or("side").alias("held"), of(1, "pages")("selected_page_ids"), of(4, "pages")("image_page_ids"), of(1, "num_selected_pages")("num_selected_pages"), of(1, "memory_block_source")("memory_block_source")
    )
    here = F.col("held").bitwiseAND(1) == 1
    return guards.watch(
        name, rows, unpaired=F.col("held") != 7, pages_moved=(F.col("held").bitwiseAND(5) == 5) & ~F.col("selected_page_ids").eqNullSafe(F.col("image_page_ids")),
        budget_moved=here & ~F.col("num_selected_pages").eqNullSafe(F.lit(budget)), other_source=here & ~F.col("memory_block_source").eqNullSafe(F.lit(source)),
    )
