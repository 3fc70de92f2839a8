"""Candidate blocks and pages of a question: lexical scores, features, labels, prefilters.

Names used throughout: a query is ``qid``; its pages come as (qid, document_id,
page_id, page_rank), ranks from 0; blocks as (document_id, page_id, block_id,
order_index, text, x0, y0, x1, y1, page_w, page_h).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from folioscope.functions import geometry
from folioscope.functions.text import tokens
from folioscope.operators.retrieval import idf, lexical_scores, term_counts, top_k

#: The features of a candidate, in order.
FEATURES = (
    "lexical_score_log", "lexical_overlap_ratio", "page_score", "page_focus", "selected_ratio", "coarse_block_score", "coarse_rank_score", "coarse_focus_match",
    "coarse_focus_dx", "coarse_focus_dy", "coarse_focus_l1", "page_rank_score", "bbox_cx", "bbox_cy", "bbox_w", "bbox_h", "bbox_area", "order_fraction", "token_count_log",
)
LEXICAL = ("lexical_score_log", "lexical_overlap_ratio")


def cell_rank(scores: Column, cell: Column) -> Column:
    """0-based rank of a cell by (-score, index)."""
    own = F.get(scores, cell)
    ahead = F.filter(scores, lambda s, i: (s > own) | ((s == own) & (i < cell)))
    return F.size(ahead)


def best_cell(scores: Column) -> Column:
    """Index of the highest score, the lowest index on ties."""
    return F.when(F.size(scores) > 0, F.array_position(scores, F.array_max(scores)).cast("int") - 1)


def coarse_features(scores: Column, top_blocks: Column, page: Column, cell: Column) -> tuple[Column, Column]:
    """(score, 1 / (rank + 1)) of a cell: by the page's cell scores, else by its place in ``top_blocks``, else 0."""
    inside = F.coalesce((cell >= 0) & (cell < F.size(scores)), F.lit(False))
    listed = F.array_position(F.coalesce(top_blocks, F.array().cast("array<string>")), geometry.cell_name(page, cell))
    by_list = F.when(listed > 0, 1.0 / listed).otherwise(0.0)
    score = F.when(cell.isNull(), 0.0).when(inside, F.get(scores, cell)).otherwise(by_list)
    rank = F.when(cell.isNull(), 0.0).when(inside, 1.0 / (cell_rank(scores, cell) + 1)).otherwise(by_list)
    return score, rank


def focus_features(scores: Column, cell: Column, cx: Column, cy: Column) -> dict[str, Column]:
    """Whether a block lies in the page's best cell, and how far its centre is from that cell's; 0 without scores."""
    best = best_cell(scores)
    dx, dy = cx - (F.pmod(best, F.lit(3)) + 0.5) / 3.0, cy - (F.floor(best / 3) + 0.5) / 3.0
    known = lambda v: F.when(best.isNotNull(), v).otherwise(0.0)
    return {
        "coarse_focus_match": known(F.coalesce((cell == best).cast("double"), F.lit(0.0))),
        "coarse_focus_dx": known(dx), "coarse_focus_dy": known(dy), "coarse_focus_l1": known(F.abs(dx) + F.abs(dy)),
    }


def candidate_rows(queries: DataFrame, pages: DataFrame, blocks: DataFrame, page_stats: DataFrame | None = None) -> DataFrame:
    """Every block of a query's pages with lexical score, matches, and the features of :data:`FEATURES`.

    queries: (qid, token, q_tf); a query without tokens has no rows, and blocks
    without a shared token score 0. Document frequencies and their number are
    those of the query's own candidates. page_stats: (qid, document_id, page_id,
    page_score, page_focus, selected_ratio, coarse_block_scores, top_block_ids);
    a page without any counts as 0.
    """
    key = ["qid", "document_id", "page_id", "block_id"]
    asked = queries.groupBy("qid").agg(F.count("*").alias("n_query"))
    in_page = blocks.groupBy("document_id", "page_id").agg(F.count("*").alias("n_in_page"))
    own = ["document_id", "page_id"]
    found = pages.join(blocks.where("block_id <> ''"), own).join(in_page, own).join(asked, "qid")
    units = found.groupBy("qid").agg(F.count("*").alias("n_units"))
    # A page may serve many queries: its blocks' tokens are counted once, and only those that some query has.
    counted = term_counts(blocks.join(pages.select(*own).distinct(), own, "left_semi").where("block_id <> ''"), [*own, "block_id"], F.col("text"), vocabulary=queries)
    terms = counted.join(pages.select("qid", *own), own)
    scored = lexical_scores(queries, terms, units, key[1:], scope=["qid"])
    rows = found.join(scored, key, "left").withColumn("lexical_score", F.coalesce("score", F.lit(0.0))).withColumn("matched", F.coalesce("matched", F.lit(0).cast("long"))).drop("score")
    if page_stats is not None:
        rows = rows.join(page_stats, ["qid", "document_id", "page_id"], "left")
    stat = lambda c, t="double": F.col(c) if page_stats is not None else F.lit(None).cast(t)
    box = [F.col(c) for c in ("x0", "y0", "x1", "y1")]
    w, h = F.col("page_w"), F.col("page_h")
    rows = rows.withColumn("cell", geometry.coarse_cell(*box, w, h)).withColumn("cells", stat("coarse_block_scores", "array<double>"))
    shape = geometry.box_features(*box, w, h)
    score, rank = coarse_features(F.col("cells"), stat("top_block_ids", "array<string>"), F.col("page_id"), F.col("cell"))
    values = {
        "lexical_score_log": F.log1p(F.greatest(F.lit(0.0), F.col("lexical_score"))), "lexical_overlap_ratio": F.col("matched") / F.col("n_query").cast("double"),
        **{c: F.coalesce(stat(c), F.lit(0.0)) for c in ("page_score", "page_focus", "selected_ratio")},
        "coarse_block_score": score, "coarse_rank_score": rank, **focus_features(F.col("cells"), F.col("cell"), shape["bbox_cx"], shape["bbox_cy"]),
        "page_rank_score": 1.0 / (F.col("page_rank") + 1), **shape,
        "order_fraction": F.least(F.lit(1.0), (F.col("order_index") + 1) / F.greatest(F.lit(1), F.col("n_in_page")).cast("double")),
        "token_count_log": F.log1p(F.size(tokens(F.col("text"))).cast("double")),
    }
    return rows.select(*key, "page_rank", "order_index", "text", F.col("cell").alias("coarse_index"), "lexical_score", "matched", *[values[f].cast("double").alias(f) for f in FEATURES])


def drop_lexical(rows: DataFrame, share: float, seed: Column) -> DataFrame:
    """Lexical features set to 0 for a share of the queries, all candidates of one alike."""
    out = F.pmod(F.xxhash64(seed), F.lit(1_000_000)) < int(share * 1_000_000)
    return rows.select(*[F.when(out, 0.0).otherwise(F.col(c)).alias(c) if c in LEXICAL else F.col(c) for c in rows.columns])


def lexical_pages(samples: DataFrame, page_texts: DataFrame, most: int) -> DataFrame:
    """(sample_id, selected, used, reason): the ``most`` pages of a sample that share most with its question.

    samples: (sample_id, document_id, question, pages); page_texts: (document_id,
    page_id, text), none for a document that is missing, blank ones for one
    without texts. Ties go to the earlier page, and pages are given in their own
    order. Where nothing can be selected the first pages stay, with the reason.
    """
    docs = page_texts.groupBy("document_id").agg(F.bool_or(F.col("text") != "").alias("has_text"))
    known = samples.join(docs, "document_id", "left").withColumn("q", tokens(F.coalesce("question", F.lit("")), "page"))
    early = (
        F.when(F.size("pages") <= most, "num_images_leq_budget").when(F.col("has_text").isNull(), "missing_document_json")
        .when(~F.col("has_text"), "missing_page_text").when(F.size("q") == 0, "empty_query_tokens")
    )
    known = known.withColumn("early", early)
    open_ = known.where("early IS NULL")
    query = open_.select("sample_id", F.explode("q").alias("token")).groupBy("sample_id", "token").agg(F.count("*").alias("q_tf"))
    page = open_.select("sample_id", "document_id", F.size("pages").alias("n"), F.posexplode("pages").alias("pos", "page_id"))
    # Only tokens that the question has are kept, before anything is counted or shuffled again.
    texts = page.join(page_texts, ["document_id", "page_id"]).select("sample_id", "n", "pos", F.explode(tokens(F.col("text"), "page")).alias("token"))
    hits = texts.join(query, ["sample_id", "token"]).groupBy("sample_id", "n", "token", "q_tf", "pos").agg(F.count("*").alias("tf"))
    per_token = hits.groupBy("sample_id", "n", "token", "q_tf").agg(F.collect_list(F.struct("pos", "tf")).alias("at"))
    weighed = per_token.select("sample_id", (F.col("q_tf") * idf(F.col("n"), F.size("at"))).alias("weight"), F.explode("at").alias("p"))
    scores = weighed.groupBy("sample_id", F.col("p.pos").alias("pos")).agg(F.round(F.sum(F.col("weight") * F.least(F.lit(3), F.col("p.tf"))), 9).alias("score"))
    # A page without a shared token scores 0 and fills up, in order, behind those that have one.
    best = top_k(scores, ["sample_id"], [F.col("score").desc(), F.col("pos")], most).groupBy("sample_id").agg(F.array_sort(F.collect_list("pos")).alias("top"))
    out = known.join(best, "sample_id", "left")
    first = F.slice("pages", 1, most)
    others = F.filter(F.sequence(F.lit(0), F.size("pages") - 1), lambda i: ~F.array_contains("top", i))
    chosen = F.array_sort(F.concat("top", F.slice(others, F.lit(1), most - F.size("top"))))
    reason = F.coalesce("early", F.when(F.col("top").isNull(), "all_zero_scores"), F.lit("ok"))
    picked = F.when(F.col("early") == "num_images_leq_budget", F.col("pages")).when(F.col("top").isNull(), first).otherwise(F.transform(chosen, lambda i: F.get(F.col("pages"), i)))
    return out.select("sample_id", picked.alias("selected"), (reason == "ok").alias("used"), reason.alias("reason"))


def label_candidates(rows: DataFrame, gold: DataFrame) -> DataFrame:
    """``label`` 1 for candidates whose (qid, page_id, block_id) is gold, else 0."""
    marked = gold.select("qid", "page_id", "block_id").distinct().withColumn("is_gold", F.lit(1))
    return rows.join(marked, ["qid", "page_id", "block_id"], "left").withColumn("label", F.coalesce("is_gold", F.lit(0))).drop("is_gold")


def with_gold_only(rows: DataFrame, group: str = "qid") -> DataFrame:
    """Groups that hold a gold candidate, numbered densely in order: a training matrix's rows."""
    held = rows.groupBy(group).agg(F.max("label").alias("any")).where("any = 1").select(group)
    number = held.withColumn("group", F.row_number().over(Window.orderBy(group)) - 1)  # one row a query
    return rows.join(number, group)


def block_key(page: Column, block: Column) -> Column:
    """``page::block``, null where either is missing."""
    return F.when(page.isNotNull() & (F.trim(block) != ""), F.concat(page.cast("string"), F.lit("::"), F.trim(block)))


def attach_teacher(rows: DataFrame, teacher: DataFrame) -> DataFrame:
    """``teacher_score`` from (qid, key, score), null where there is none, and its 0-based rank.

    Of a repeated key the score of the last ``ordinal`` counts, where the teacher has
    that column, else the highest.
    """
    one = F.max_by("score", "ordinal") if "ordinal" in teacher.columns else F.max("score")
    known = teacher.groupBy("qid", "key").agg(one.alias("teacher_score"))
    out = rows.withColumn("key", block_key(F.col("page_id"), F.col("block_id"))).join(known, ["qid", "key"], "left").drop("key")
    rank = F.row_number().over(Window.partitionBy("qid").orderBy(F.col("teacher_score").desc_nulls_last(), "page_rank", "order_index", "block_id")) - 1
    return out.withColumn("teacher_rank", F.when(F.col("teacher_score").isNotNull(), rank.cast("long")))


def prefilter(rows: DataFrame, most: int, positive: Column | None = None) -> DataFrame:
    """A query's ``most`` lexically best candidates, and every positive one."""
    rank = F.row_number().over(Window.partitionBy("qid").orderBy(F.col("lexical_score").desc(), "page_rank", "order_index", "block_id"))
    keep = F.col("kept_rank") <= max(1, most)
    return rows.withColumn("kept_rank", rank.cast("long")).where(keep if positive is None else keep | positive)
