"""Evidence coverage of what a reader was shown and kept, and grounded-answer aggregates."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from folioscope.functions import geometry
from folioscope.functions.scoring import snap
from folioscope.sources.readers import page_and_block, sorted_blocks

_NONE = "array<string>"


def coarse_id(block: Column, x0: Column, y0: Column, x1: Column, y1: Column, w: Column, h: Column, order_index: Column, n_in_page: Column) -> Column:
    """The 3 x 3 cell of a block id: given as one, by its box, by its share of the reading order, or b1 to b9 by number."""
    at = page_and_block(block)
    page, part = at["page"], at["block"]
    given = F.when(part.rlike("^g[012][012]$"), F.concat(F.lit("p"), page.cast("string"), F.lit("_"), part))
    by_order = F.when((n_in_page > 0) & (order_index >= 0), F.least(F.lit(8), F.floor(order_index * 9 / n_in_page).cast("int")))
    number = F.regexp_extract(part, r"^b(\d+)$", 1).try_cast("int") - 1
    cell = F.coalesce(geometry.coarse_cell(x0, y0, x1, y1, w, h), by_order, F.when(number.between(0, 8), number))
    return F.when(part.startswith("g"), given).when(part.startswith("b"), geometry.cell_name(page, cell))


def part(gold: Column, kept: Column) -> Column:
    """Share of distinct gold in ``kept``; null without gold, or where nothing tells what was kept."""
    g = F.array_distinct(gold)
    return F.when((F.size(g) > 0) & kept.isNotNull(), F.size(F.array_intersect(g, kept)) / F.size(g).cast("double"))


def whole(share: Column) -> Column:
    return (share >= 1.0).cast("double")


def coverage(evidence: Column, input_pages: Column, kept_pages: Column, kept_blocks: Column, gold_cells: Column, kept_cells: Column) -> dict[str, Column]:
    """Coverage of one sample's evidence (array<struct<page_id, block_id>>), null throughout without any.

    Pages and blocks are judged over all targets and over the visible ones,
    those on input pages; ``block_hit`` is whether any target cell was kept.
    """
    pages = F.array_distinct(F.filter(F.transform(evidence, lambda e: e.page_id), lambda p: p.isNotNull()))
    blocks = sorted_blocks(F.transform(evidence, lambda e: e.block_id))
    seen = F.array_intersect(pages, input_pages)
    seen_blocks = sorted_blocks(F.transform(F.filter(evidence, lambda e: F.coalesce(F.array_contains(input_pages, e.page_id), F.lit(False))), lambda e: e.block_id))
    found = {
        "input_page_recall": part(pages, input_pages), "page_recall": part(pages, kept_pages), "visible_page_recall": part(seen, kept_pages),
        "exact_block_recall": part(blocks, kept_blocks), "visible_exact_block_recall": part(seen_blocks, kept_blocks),
    }
    for name in ("page", "visible_page", "exact_block", "visible_exact_block"):
        found[f"{name}_full_recall"] = whole(found[f"{name}_recall"])
    found["block_hit"] = F.when((F.size(gold_cells) > 0) & kept_cells.isNotNull(), F.arrays_overlap(gold_cells, kept_cells).cast("double"))
    return found


MEANS = ("input_page_recall", "page_recall", "page_full_recall", "visible_page_recall", "visible_page_full_recall", "exact_block_recall", "exact_block_full_recall", "visible_exact_block_recall", "visible_exact_block_full_recall", "block_hit")


def coverage_summary(rows: DataFrame, by: list[str]) -> DataFrame:
    """Means over the samples that can be judged, how many those are, and recall per visual token."""
    judged = F.col("input_page_recall").isNotNull() & F.col("page_recall").isNotNull()
    mean = lambda c: F.avg(F.when(judged, F.col(c)))
    per_token = lambda c: mean(c) / F.nullif(F.avg("visual_tokens"), F.lit(0.0))
    return rows.groupBy(*by).agg(
        F.count_if(judged).alias("n"), F.count_if(judged & F.col("visible_page_recall").isNotNull()).alias("n_visible"), F.count_if(judged & F.col("exact_block_recall").isNotNull()).alias("n_blocks"),
        *[mean(c).alias(c) for c in MEANS], per_token("page_recall").alias("efficiency"), per_token("visible_page_recall").alias("visible_efficiency"),
    )


def target_coverage(rows: DataFrame, by: list[str]) -> DataFrame:
    """Dataset counters over (has_layout, target_pages, target_blocks, visible_blocks)."""
    some = lambda c: F.count_if(F.size(c) > 0)
    total = lambda c: F.sum(F.greatest(F.lit(0), F.size(c)).cast("long"))
    return rows.groupBy(*by).agg(
        F.count("*").alias("n"), F.count_if("has_layout").alias("n_layout"), some("target_pages").alias("n_with_pages"), some("target_blocks").alias("n_with_blocks"),
        some("visible_blocks").alias("n_with_visible"), total("target_pages").alias("pages"), total("target_blocks").alias("blocks"), total("visible_blocks").alias("visible"),
    )


def gold_stratum(n_hit: Column, n_gold: Column) -> Column:
    """Whether a question's gold items are all, in part or not covered."""
    return F.when((n_gold == 0) | (n_hit == 0), "none").when(n_hit == n_gold, "all").otherwise("part")


def expected_scores(expected: DataFrame, scores: DataFrame, key: str, missing: str) -> DataFrame:
    """(sample, key, score, reason) for every expected id: the judge's score, snapped, or 0 with ``missing`` as reason.

    Of a repeated id the last ``ordinal`` counts, where scores have that column, else the highest score.
    """
    one = F.struct(F.coalesce(snap(F.col("score")), F.lit(0.0)).alias("score"), "reason")
    given = scores.groupBy("sample", key).agg((F.max_by(one, "ordinal") if "ordinal" in scores.columns else F.max(one)).alias("g"))
    joined = expected.select("sample", key).distinct().join(given, ["sample", key], "left")
    return joined.select("sample", key, F.coalesce("g.score", F.lit(0.0)).alias("score"), F.when(F.col("g").isNull(), missing).otherwise(F.col("g.reason")).alias("reason"))


def grounding_summary(rows: DataFrame, by: list[str]) -> DataFrame:
    """Rates over available rows, judge means over validly judged ones; null terms add 0 to sums whose rows still count.

    rows: available, json_valid, citation_score, exact_rate, page_only_rate,
    judge_valid, judge, result, facts, claims, grounded, strict.
    """
    on, valid = F.coalesce("available", F.lit(False)), F.coalesce(F.col("available") & F.col("judge_valid"), F.lit(False))
    rate = lambda c, n: F.sum(F.when(n, F.coalesce(F.col(c).cast("double"), F.lit(0.0))).otherwise(0.0)) / F.nullif(F.count_if(n), F.lit(0))
    return rows.groupBy(*by).agg(
        F.count_if(on).alias("n"), *[rate(c, on).alias(c) for c in ("json_valid", "citation_score", "exact_rate", "page_only_rate")],
        F.count_if(valid).alias("n_judged"), *[rate(c, valid).alias(c) for c in ("judge", "result", "facts", "claims", "grounded", "strict")],
    )


def gold_units(samples: DataFrame) -> DataFrame:
    """(sample, evidence_id, page_id, block_id, quote): a sample's evidence numbered e1, e2, ..., quotes in their quote form."""
    from folioscope.functions.text import normalize_quote

    rows = samples.select("sample", F.posexplode("evidence").alias("i", "e"))
    return rows.select("sample", F.concat(F.lit("e"), (F.col("i") + 1).cast("string")).alias("evidence_id"), "e.page_id", F.nullif(F.trim("e.block_id"), F.lit("")).alias("block_id"), normalize_quote(F.col("e.text_excerpt")).alias("quote"))
