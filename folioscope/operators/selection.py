"""Evidence selection under block and character budgets, and packing to text."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from folioscope.functions.text import packed_length, packed_text, stable_score, strip
from folioscope.operators.retrieval import top_k

SELECTORS = ("random", "random_chars", "all")


def select_memory(rows: DataFrame, sample: str, selector: str, k: int = 16, seed: Column | None = None, budget: str | None = None, cap: int = 0) -> DataFrame:
    """Chosen rows (sample, page_id, block_id, order_index, text, ...) with ``sel_score``.

    ``random`` takes the k highest stable scores; ``random_chars`` takes rows in
    that order until the packed characters reach the column ``budget``, the row
    that crosses it included; a budget of 0 or less is an error; ``all`` keeps every row in reading order. Lexical
    selection is :func:`lexical_selection`.
    """
    if selector not in SELECTORS:
        raise ValueError(f"unknown selector {selector!r}")
    if selector == "all":
        return rows.withColumn("sel_score", -F.col("order_index").cast("double"))
    scored = rows.withColumn("sel_score", stable_score(seed if seed is not None else F.col(sample), F.col("page_id"), F.col("block_id"), F.col("order_index")))
    order = [F.col("sel_score").desc(), F.col("page_id"), F.col("block_id")]
    if selector == "random":
        return top_k(scored, [sample], order, max(1, k)).drop("rank")
    if budget is None:
        raise ValueError("random_chars needs a budget column")
    before = F.sum(packed_length(F.col("text"), cap)).over(Window.partitionBy(sample).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1))
    return scored.withColumn("before", F.coalesce(before, F.lit(0))).where(F.when(F.col(budget) > 0, F.col("before") < F.col(budget)).otherwise(F.raise_error(F.lit("random_chars needs a budget above 0")).cast("boolean"))).drop("before")


def lexical_selection(rows: DataFrame, sample: str, k: int) -> DataFrame:
    """The k best (one at least) by lexical_score, ties in page and block order."""
    return top_k(rows.withColumn("sel_score", F.col("lexical_score")), [sample], [F.col("lexical_score").desc(), F.col("page_rank"), F.col("order_index")], max(1, k)).drop("rank")


def lexical_char_budget(rows: DataFrame, sample: str, k: int, cap: int) -> DataFrame:
    """Characters that the lexical top k packs to."""
    return lexical_selection(rows, sample, k).groupBy(sample).agg(F.sum(packed_length(F.col("text"), cap)).cast("long").alias("char_budget"))


def pack(rows: DataFrame, sample: str, cap: int) -> DataFrame:
    """Lines tagged with their page, by page position then score, joined; and the facts behind them."""
    fact = F.struct(F.col("page_rank"), (-F.col("sel_score")).alias("neg"), F.col("order_index"), F.col("page_id"), F.col("block_id"), packed_text(F.col("text"), cap).alias("line"))
    held = rows.where(strip(F.coalesce("text", F.lit(""))) != "").groupBy(sample).agg(F.array_sort(F.collect_list(fact)).alias("facts"))
    return held.select(
        sample, F.size("facts").cast("long").alias("num_facts"),
        F.array_join(F.transform("facts", lambda f: F.concat(F.lit("[第"), f.page_id.cast("string"), F.lit("页] "), f.line)), "\n").alias("memory"),
        F.transform("facts", lambda f: f.block_id).alias("block_ids"),
    )


def union_selection(first: DataFrame, second: DataFrame, sample: str, k: int) -> DataFrame:
    """Top k of both selectors without repeats; the first one's order leads."""
    keys = [sample, "page_id", "block_id"]
    ranked = first.select(*keys, F.col("rank"), F.lit(0).alias("arm")).unionByName(second.select(*keys, F.col("rank"), F.lit(1).alias("arm"))).where(F.col("rank") <= k)
    return ranked.groupBy(*keys).agg(F.min(F.struct("arm", "rank")).alias("at")).select(*keys, F.col("at.arm").alias("arm"), F.col("at.rank").alias("rank"))


def keep_ratio(rows: DataFrame, group: list[str], score: str, tie: list[str], ratio: float, least: int = 1, half_even: bool = False) -> DataFrame:
    """Per group the max(least, n * ratio) highest scores; whole numbers by floor, or half-even rounding."""
    w = Window.partitionBy(*group)
    n = F.count("*").over(w)
    keep = F.greatest(F.lit(least), (F.bround(n * ratio) if half_even else F.floor(n * ratio)).cast("long"))
    rank = F.row_number().over(w.orderBy(F.col(score).desc(), *tie))
    return rows.withColumn("kept_rank", rank.cast("long")).withColumn("keep_n", keep).where("kept_rank <= keep_n")


def block_stage(rows: DataFrame, sample: str, selector: str, k: int, rescored: str | None = None, seed: Column | None = None) -> DataFrame:
    """The blocks that a reader gets beside its pages: none, the lexical or a model's best ``k``, or random ones, ranked."""
    if selector == "none":
        return rows.limit(0).withColumn("rank", F.lit(0).cast("long"))
    order = [F.col("page_rank"), F.col("order_index")]
    if selector == "lexical":
        return top_k(rows, [sample], [F.col("lexical_score").desc(), *order], k)
    if selector in ("model", "rerank"):
        if rescored is None:
            raise ValueError(f"{selector} needs the column of its scores")
        return top_k(rows, [sample], [F.col(rescored).desc_nulls_last(), *order], k)
    if selector == "random":
        scored = rows.withColumn("_s", stable_score(seed if seed is not None else F.col(sample), F.col("page_id"), F.col("block_id")))
        return top_k(scored, [sample], [F.col("_s").desc(), *order], k).drop("_s")
    raise ValueError(f"unknown selector {selector!r}")


def choose_store(recognised: DataFrame, layer: DataFrame, document: str = "document_id", required: bool = False) -> DataFrame:
    """Blocks of the recognised store, and of the text layer for documents that it lacks, with ``source``.

    With ``required`` a document of the text layer alone is an error.
    """
    from folioscope.operators.sets import expect

    known = recognised.select(document).distinct()
    rest = layer.join(known, document, "left_anti")
    if required:
        expect(rest, unrecognised=F.lit(True))
    return recognised.withColumn("source", F.lit("ocr")).unionByName(rest.withColumn("source", F.lit("text_layer")))


def spatial_keep(tokens: DataFrame, page: list[str], row: str, column: str, rows: int, columns: int) -> DataFrame:
    """One token for each cell of a uniform rows x columns lattice over a page's grid: the first in it."""
    extent = tokens.groupBy(*page).agg((F.max(row) + 1).alias("_h"), (F.max(column) + 1).alias("_w"))
    cell = F.floor(F.col(row) * rows / F.col("_h")) * columns + F.floor(F.col(column) * columns / F.col("_w"))
    return tokens.join(extent, page).withColumn("cell", cell.cast("long")).groupBy(*page, "cell").agg(F.min(F.struct(row, column)).alias("t")).select(*page, "cell", f"t.{row}", f"t.{column}")


def spatial_keep_lines(lines: DataFrame, page: list[str], row: str, length: str, rows: int, columns: int) -> DataFrame:
    """:func:`spatial_keep` of a grid whose lines are full: (page..., row, col, cell) from one row a line.

    ``length`` is how many tokens stand in the line's columns 0, 1, ...; lines without
    any don't count. Of a line at most one token for each column of the lattice can be
    the first in a cell, and these alone are made, so tokens are never rows.
    """
    held = lines.where(F.col(length) > 0).select(*page, F.col(row).alias("_r"), F.col(length).cast("long").alias("_n"))
    extent = held.groupBy(*page).agg((F.max("_r") + 1).alias("_h"), F.max("_n").alias("_w"))
    # The first column c of the line with floor(c * columns / w) = k, where there is one.
    first = lambda k: F.floor((k * F.col("_w") + (columns - 1)) / columns)
    here = lambda k: (first(k) < F.col("_n")) & (F.floor(first(k) * columns / F.col("_w")) == k)
    ks = F.filter(F.sequence(F.lit(0).cast("long"), F.lit(columns - 1).cast("long")), here)
    met = held.join(extent, [c for c in page]).select(*page, "_r", "_w", (F.floor(F.col("_r") * rows / F.col("_h")) * columns).cast("long").alias("_c"), F.explode(ks).alias("_k"))
    best = met.groupBy(*page, (F.col("_c") + F.col("_k")).alias("cell")).agg(F.min("_r").alias(row), F.min(first(F.col("_k"))).alias("col"))
    return best
