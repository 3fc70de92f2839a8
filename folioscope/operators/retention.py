"""Which pages and cells a scorer retains: token scores to cells, pages, budgets and summaries."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from folioscope.functions.geometry import cell_name

CELLS = 9


def top_mean(value: Column, rank: Column, count: Column, share: float = 0.25) -> Column:
    """Mean of the highest ``share`` of a group's values, at least one; rank is from 1, descending."""
    return F.avg(F.when(rank <= F.greatest(F.lit(1), F.floor(count * share)), value))


def cell_statistics(tokens: DataFrame, group: list[str], order: str) -> DataFrame:
    """Per group and cell of (cell, score): mean, mass, maximum, top-quartile mean, share of tokens and count.

    Negative scores count as 0; every cell of a group has a row.
    """
    s = F.greatest(F.col("score"), F.lit(0.0))
    own = Window.partitionBy(*group, "cell")
    ranked = tokens.withColumn("_s", s).withColumn("_k", F.row_number().over(own.orderBy(F.col("_s").desc(), order))).withColumn("_m", F.count("*").over(own))
    per = ranked.groupBy(*group, "cell").agg(F.avg("_s").alias("mean"), F.sum("_s").alias("mass"), F.max("_s").alias("max"), top_mean(F.col("_s"), F.col("_k"), F.col("_m")).alias("top_mean"), F.count("*").alias("count"))
    total = tokens.groupBy(*group).agg(F.count("*").alias("total"))
    every = total.withColumn("cell", F.explode(F.sequence(F.lit(0), F.lit(CELLS - 1))))
    out = every.join(per, [*group, "cell"], "left")
    return out.select(*group, "cell", *[F.coalesce(c, F.lit(0.0)).alias(c) for c in ("mean", "mass", "max", "top_mean")], F.coalesce("count", F.lit(0)).alias("count"), (F.coalesce("count", F.lit(0)) / F.greatest(F.lit(1), F.col("total")).cast("double")).alias("token_ratio"))


def page_logits(tokens: DataFrame, group: list[str], order: str) -> DataFrame:
    """Half the top-quartile mean of a page's token scores and half its best cell's top-quartile mean."""
    own = Window.partitionBy(*group)
    ranked = tokens.withColumn("_k", F.row_number().over(own.orderBy(F.col("score").desc(), order))).withColumn("_m", F.count("*").over(own))
    page = ranked.groupBy(*group).agg(top_mean(F.col("score"), F.col("_k"), F.col("_m")).alias("top"))
    best = cell_statistics(tokens, group, order).groupBy(*group).agg(F.max("top_mean").alias("cell_logit"))
    return page.join(best, group).select(*group, (0.5 * F.col("top") + 0.5 * F.col("cell_logit")).alias("logit"), "cell_logit")


def page_score_stats(tokens: DataFrame, group: list[str], keep: Column) -> DataFrame:
    """Count, kept count, mean, population deviation, minimum and maximum of a page's token scores."""
    n = F.count("*")
    return tokens.groupBy(*group).agg(n.alias("token_count"), keep.alias("keep_count"), F.avg("score").alias("mean"), F.stddev_pop("score").alias("std"), F.min("score").alias("min"), F.max("score").alias("max"))


def score_spread(stats: DataFrame) -> DataFrame:
    """How far the pages' mean scores lie apart."""
    return stats.agg(F.count("*").alias("pages"), (F.max("mean") - F.min("mean")).alias("mean_range"), F.stddev_pop("mean").alias("mean_std"))


def layer_page_stats(tokens: DataFrame, sample: str) -> DataFrame:
    """Per layer and page of (layer, page, token, head, score, gate, selected): selection, focus and gate figures.

    Distinct selected tokens and their share, the highest and mean top-quartile
    score over tokens (a token's score is its highest over heads), mean gate,
    share of gates below 0.5.
    """
    key = [sample, "layer", "page"]
    token = tokens.groupBy(*key, "token").agg(F.max("score").alias("_s"), F.bool_or("selected").alias("on"), F.avg("gate").alias("gate"))
    own = Window.partitionBy(*key)
    ranked = token.withColumn("_k", F.row_number().over(own.orderBy(F.col("_s").desc(), "token"))).withColumn("_m", F.count("*").over(own))
    return ranked.groupBy(*key).agg(
        F.count("*").alias("tokens"), F.count_if("on").alias("selected"), (F.count_if("on") / F.count("*").cast("double")).alias("selected_ratio"), F.max("_s").alias("peak"),
        top_mean(F.col("_s"), F.col("_k"), F.col("_m")).alias("focus"), F.avg("gate").alias("gate_mean"), F.avg((F.col("gate") < 0.5).cast("double")).alias("gate_low"),
    )


def over_layers(stats: DataFrame, sample: str, pages: DataFrame) -> DataFrame:
    """Means over a page's layers, 0 for a page without any; gates are weighted by tokens. pages: (sample, page)."""
    weighed = lambda c: F.sum(F.col(c) * F.col("tokens")) / F.sum("tokens")
    per = stats.groupBy(sample, "page").agg(F.avg("peak").alias("page_score"), F.avg("focus").alias("page_focus"), F.avg("selected_ratio").alias("selected_ratio"), weighed("gate_mean").alias("gate_mean"), weighed("gate_low").alias("gate_low"), F.count("*").alias("layers"))
    out = pages.join(per, [sample, "page"], "left")
    return out.select(sample, "page", *[F.coalesce(c, F.lit(0.0)).alias(c) for c in ("page_score", "page_focus", "selected_ratio")], "gate_mean", "gate_low", F.coalesce("layers", F.lit(0)).alias("layers"))


def retained_pages(stats: DataFrame, sample: str, ratio: float) -> DataFrame:
    """The best half-even round(n * ratio) pages of a sample, at least one, by score, focus, selected ratio and place."""
    n = F.count("*").over(Window.partitionBy(sample))
    order = [F.col("page_score").desc(), F.col("page_focus").desc(), F.col("selected_ratio").desc(), F.col("page")]
    ranked = stats.withColumn("budget", F.greatest(F.lit(1), F.least(n, F.bround(n * F.lit(ratio)).cast("long")))).withColumn("rank", F.row_number().over(Window.partitionBy(sample).orderBy(*order)).cast("long"))
    return ranked.where("rank <= budget")


def retained_blocks(pages: DataFrame, cells: DataFrame, sample: str, k: int) -> DataFrame:
    """(sample, block_ids): distinct names of the retained pages' ``k`` best cells, in order."""
    best = cells.withColumn("r", F.row_number().over(Window.partitionBy(sample, "page").orderBy(F.col("top_mean").desc(), "cell"))).where(F.col("r") <= k)
    named = pages.select(sample, "page").join(best, [sample, "page"]).select(sample, cell_name(F.col("page"), F.col("cell")).alias("b"))
    return named.groupBy(sample).agg(F.array_sort(F.collect_set("b")).alias("block_ids"))


def retained_count(n: Column, ratio: Column) -> Column:
    """Half-even round(n * ratio), from 1 to n."""
    return F.greatest(F.lit(1), F.least(n, F.bround(n * ratio).cast("long")))


def slices(values: Column, counts: Column) -> Column:
    """A flat array cut into one array a count."""
    start = lambda i: F.aggregate(F.slice(counts, F.lit(1), i), F.lit(0), lambda a, c: a + c.cast("int"))
    return F.transform(counts, lambda c, i: F.slice(values, start(i) + 1, c.cast("int")))


def pseudo_grid(tokens: Column, merge: int = 1) -> Column:
    """(rows, columns) of the most square grid of exactly that many tokens, times the merge size."""
    rows = F.array_max(F.filter(F.sequence(F.lit(1), F.floor(F.sqrt(tokens)).cast("int")), lambda r: F.pmod(tokens, r) == 0))
    return F.struct((rows * merge).alias("rows"), (tokens / rows * merge).cast("int").alias("columns"))


def tokens_per_page(t: Column, h: Column, w: Column, merge: int) -> Column:
    return F.floor(t * h * w / (merge * merge)).cast("long")


def padded(indices: Column, width: Column) -> Column:
    """Kept indices, filled up with -1."""
    return F.concat(indices, F.array_repeat(F.lit(-1).cast("bigint"), (width - F.size(indices)).cast("int")))


def lattice_cell(row: Column, column: Column) -> Column:
    """The 3 x 3 cell of a token's centred coordinates in -1 to 1."""
    at = lambda v: F.least(F.lit(2), F.greatest(F.lit(0), F.floor((v + 1.0) * 1.5))).cast("int")
    return at(row) * 3 + at(column)


def lattice(rows: int, columns: int) -> Column:
    """array<struct<row, column>> of a token grid's centred coordinates."""
    at = lambda i, n: (i + 0.5) / n * 2.0 - 1.0
    return F.transform(F.sequence(F.lit(0), F.lit(rows * columns - 1)), lambda i: F.struct(at(F.floor(i / columns), rows).alias("row"), at(F.pmod(i, F.lit(columns)), columns).alias("column")))
