"""Candidate features, page selection, labels and prefilters as queries."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from folioscope.operators import candidates as C
from folioscope.plans import retrieval as R
from folioscope.plans import surrogates as S
from folioscope.plans.registry import register
from folioscope.session import table, written

# Every page's stand-in scores are whole-number functions of document, page and cell.
_STATS = """
pages AS (SELECT DISTINCT qid, doc_id, page_id FROM c),
stats AS (SELECT qid, doc_id, page_id, (doc_id + page_id) % 10 / 10.0::DOUBLE AS page_score, (doc_id + page_id) % 7 / 7.0::DOUBLE AS page_focus, page_id % 5 / 5.0::DOUBLE AS selected_ratio,
  list_transform(range(9), lambda i: ((doc_id + page_id * 3 + i * 5) % 9)::DOUBLE) AS cells FROM pages WHERE doc_id % 3 > 0)
"""


def _asked_pages(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Blocks, the pages of each item's four best documents ranked in reading order, and the pages' scores."""
    source, blocks = R.sources(spark, sf_dir)
    blocks = written(blocks.withColumnRenamed("doc_id", "document_id"), "source-blocks")
    pages = blocks.select("document_id", "page_id").distinct().join(source.withColumnRenamed("doc_id", "document_id"), "document_id")
    order = F.row_number().over(Window.partitionBy("qid").orderBy("doc_rank", "page_id")) - 1
    pages = pages.select("qid", "document_id", "page_id", order.cast("long").alias("page_rank"))
    d, p = F.col("document_id"), F.col("page_id")
    mod = lambda c, n: F.pmod(c, F.lit(n))
    stats = pages.where(mod(d, 3) > 0).select(
        "qid", "document_id", "page_id", (mod(d + p, 10) / 10.0).alias("page_score"), (mod(d + p, 7) / 7.0).alias("page_focus"), (mod(p, 5) / 5.0).alias("selected_ratio"),
        F.transform(F.sequence(F.lit(0), F.lit(8)), lambda i: mod(d + p * 3 + i * 5, 9).cast("double")).alias("coarse_block_scores"), F.lit(None).cast("array<string>").alias("top_block_ids"),
    )
    return blocks, pages, stats


@register("candidate_features", f"""WITH {R._CANDIDATES}, {_STATS}, nq AS (SELECT qid, count(*) AS nq FROM q GROUP BY qid), np AS (SELECT doc_id, page_id, count(*) AS np FROM blocks GROUP BY ALL),
    pr AS (SELECT qid, doc_id, page_id, row_number() OVER (PARTITION BY qid ORDER BY rank, page_id) - 1 AS page_rank FROM pages JOIN (SELECT qid, doc_id, rank FROM r WHERE rank <= 4) USING (qid, doc_id)),
    g AS (SELECT c.*, coalesce(cs.score, 0) AS score, coalesce(cs.matched, 0) AS matched, nq, np, page_rank, page_score, page_focus, selected_ratio, cells, x1 > x0 AND y1 > y0 AS ok,
      CASE WHEN x1 > x0 AND y1 > y0 THEN (least(2, floor(least(page_h - 1e-6::DOUBLE, (y0 + y1) * 0.5) / page_h * 3)) * 3 + least(2, floor(least(page_w - 1e-6::DOUBLE, (x0 + x1) * 0.5) / page_w * 3)))::INT END AS cell
      FROM c LEFT JOIN cs USING (qid, doc_id, block_id) JOIN nq USING (qid) JOIN np USING (doc_id, page_id) JOIN pr USING (qid, doc_id, page_id) LEFT JOIN stats USING (qid, doc_id, page_id)),
    h AS (SELECT *, CASE WHEN ok THEN least(1, greatest(0, (x0 + x1) / 2 / page_w)) ELSE 0.5 END AS cx, CASE WHEN ok THEN least(1, greatest(0, (y0 + y1) / 2 / page_h)) ELSE 0.5 END AS cy,
      CASE WHEN ok THEN least(1, (x1 - x0) / page_w) ELSE 1 END AS bw, CASE WHEN ok THEN least(1, (y1 - y0) / page_h) ELSE 1 END AS bh, list_position(cells, list_max(cells)) - 1 AS best FROM g)
    SELECT qid, doc_id, block_id, round(score, 6) AS lexical_score, round(ln(1 + score), 6) AS lexical_score_log, round(matched / nq::DOUBLE, 6) AS lexical_overlap_ratio,
      coalesce(page_score, 0)::DOUBLE AS page_score, round(coalesce(page_focus, 0), 6)::DOUBLE AS page_focus, coalesce(selected_ratio, 0)::DOUBLE AS selected_ratio,
      coalesce(cells[cell + 1], 0)::DOUBLE AS coarse_block_score, round(CASE WHEN cells IS NULL OR cell IS NULL THEN 0 ELSE 1.0::DOUBLE / (len(list_filter(cells, lambda s, i: s > cells[cell + 1] OR (s = cells[cell + 1] AND i - 1 < cell))) + 1) END, 6)::DOUBLE AS coarse_rank_score,
      CASE WHEN cells IS NULL THEN 0 ELSE coalesce((cell = best)::INT, 0) END::DOUBLE AS coarse_focus_match,
      round(CASE WHEN cells IS NULL THEN 0 ELSE cx - (best % 3 + 0.5::DOUBLE) / 3 END, 6)::DOUBLE AS coarse_focus_dx, round(CASE WHEN cells IS NULL THEN 0 ELSE cy - (best // 3 + 0.5::DOUBLE) / 3 END, 6)::DOUBLE AS coarse_focus_dy,
      round(CASE WHEN cells IS NULL THEN 0 ELSE abs(cx - (best % 3 + 0.5::DOUBLE) / 3) + abs(cy - (best // 3 + 0.5::DOUBLE) / 3) END, 6)::DOUBLE AS coarse_focus_l1,
      round(1.0::DOUBLE / (page_rank + 1), 6) AS page_rank_score, round(cx, 6)::DOUBLE AS bbox_cx, round(cy, 6)::DOUBLE AS bbox_cy, round(bw, 6)::DOUBLE AS bbox_w, round(bh, 6)::DOUBLE AS bbox_h, round(CASE WHEN ok THEN bw * bh ELSE 1 END, 6)::DOUBLE AS bbox_area,
      round(least(1, (order_index + 1) / np::DOUBLE), 6)::DOUBLE AS order_fraction, round(ln(1 + len({S.sql_tokens('text')})), 6)::DOUBLE AS token_count_log FROM h""")
def candidate_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All features of every block on the pages of each item's four best documents."""
    blocks, pages, stats = _asked_pages(spark, sf_dir)
    rows = C.candidate_rows(S.questions(spark, sf_dir), pages, blocks, stats)
    return rows.select("qid", F.col("document_id").alias("doc_id"), "block_id", *[F.round(c, 6).alias(c) for c in ("lexical_score", *C.FEATURES)])


_ASKED = "(SELECT doc_id, CASE WHEN doc_id % 7 = 0 THEN NULL WHEN doc_id % 11 = 0 THEN 'zzzzq qqqqz' ELSE string_split(coalesce(text, ''), chr(10))[-1] END AS question FROM documents)"


@register("lexical_pages", f"""WITH {S.SQL_BLOCKS}, a AS (SELECT * FROM {_ASKED}),
    pt AS (SELECT doc_id, page_id, string_agg(text, ' ' ORDER BY n) AS text FROM (SELECT *, order_index AS n FROM blocks) GROUP BY ALL),
    s AS (SELECT a.doc_id, question, list(page_id ORDER BY page_id) AS pages, bool_or(text <> '') AS has_text FROM a JOIN pt USING (doc_id) GROUP BY ALL),
    e AS (SELECT *, {S.sql_tokens('question', 'page')} AS q, CASE WHEN len(pages) <= 2 THEN 'num_images_leq_budget' WHEN doc_id % 13 = 0 THEN 'missing_document_json' WHEN NOT has_text THEN 'missing_page_text' END AS first FROM s),
    f AS (SELECT *, coalesce(first, CASE WHEN len(q) = 0 THEN 'empty_query_tokens' END) AS early FROM e),
    qt AS (SELECT doc_id, token, count(*) AS q_tf FROM (SELECT doc_id, unnest(q) AS token FROM f WHERE early IS NULL) GROUP BY ALL),
    t AS (SELECT doc_id, page_id, token, count(*) AS tf FROM (SELECT doc_id, page_id, unnest({S.sql_tokens('text', 'page')}) AS token FROM pt) GROUP BY ALL),
    df AS (SELECT doc_id, token, count(*) AS df FROM t GROUP BY ALL), n AS (SELECT doc_id, count(*) AS n FROM pt GROUP BY ALL),
    sc AS (SELECT doc_id, page_id, round(sum(q_tf * least(3, tf) * (ln((1::DOUBLE + n) / (1::DOUBLE + df)) + 1)), 9) AS score FROM qt JOIN t USING (doc_id, token) JOIN df USING (doc_id, token) JOIN n USING (doc_id) GROUP BY ALL),
    k AS (SELECT pt.doc_id, pt.page_id, row_number() OVER (PARTITION BY pt.doc_id ORDER BY coalesce(score, 0) DESC, pt.page_id) AS rn, max(coalesce(score, 0)) OVER (PARTITION BY pt.doc_id) AS top FROM pt LEFT JOIN sc USING (doc_id, page_id)),
    g AS (SELECT doc_id, list(page_id ORDER BY page_id) AS best, any_value(top) AS top FROM k WHERE rn <= 2 GROUP BY doc_id)
    SELECT doc_id, array_to_string(CASE WHEN early = 'num_images_leq_budget' THEN pages WHEN early IS NOT NULL OR top <= 0 THEN list_slice(pages, 1, 2) ELSE best END, ',') AS selected, coalesce(early, CASE WHEN top <= 0 THEN 'all_zero_scores' ELSE 'ok' END) AS reason FROM f JOIN g USING (doc_id)""")
def lexical_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two pages of every document for a question, with the reason where nothing can be selected."""
    blocks = S.blocks(spark, sf_dir)
    texts = blocks.groupBy(F.col("doc_id").alias("document_id"), "page_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("order_index", "text"))), lambda x: x.text), " ").alias("text"))
    pages = texts.groupBy("document_id").agg(F.array_sort(F.collect_list("page_id")).alias("pages"))
    d = F.col("doc_id")
    question = F.when(F.pmod(d, F.lit(7)) == 0, F.lit(None)).when(F.pmod(d, F.lit(11)) == 0, "zzzzq qqqqz").otherwise(F.element_at(F.split(F.coalesce("text", F.lit("")), "\n"), -1))
    asked = table(spark, sf_dir, "documents").select(d.alias("document_id"), question.alias("question")).join(pages, "document_id")
    out = C.lexical_pages(asked.withColumn("sample_id", F.col("document_id")), texts.where(F.pmod("document_id", F.lit(13)) > 0), 2)
    return out.select(F.col("sample_id").alias("doc_id"), F.array_join(F.col("selected").cast("array<string>"), ",").alias("selected"), "reason")


_ROWS = "rows AS (SELECT doc_id AS qid, page_id, block_id, page_id AS page_rank, order_index, length(text) AS lexical_score, order_index IN (doc_id % 5, doc_id % 3 + 4) AS is_gold, CASE WHEN order_index % 3 > 0 THEN (order_index * 7 + doc_id) % 11 END AS teacher FROM blocks)"


def _labelled(spark: SparkSession, sf_dir: str) -> DataFrame:
    b, n = S.blocks(spark, sf_dir), F.col("order_index")
    rows = b.select(F.col("doc_id").alias("qid"), "page_id", "block_id", F.col("page_id").alias("page_rank"), "order_index", F.length("text").alias("lexical_score"))
    d = F.col("doc_id")
    gold = b.where((n == F.pmod(d, F.lit(5))) | (n == F.pmod(d, F.lit(3)) + 4)).select(d.alias("qid"), "page_id", "block_id")
    teacher = b.where(F.pmod(n, F.lit(3)) > 0).select(d.alias("qid"), C.block_key(F.col("page_id"), F.col("block_id")).alias("key"), F.pmod(n * 7 + d, F.lit(11)).alias("score"))
    return C.attach_teacher(C.label_candidates(rows, gold), teacher)


@register("labelled_candidates", f"""WITH {S.SQL_BLOCKS}, {_ROWS}
    SELECT qid, block_id, is_gold::INT AS label, teacher::BIGINT AS teacher_score, CASE WHEN teacher IS NOT NULL THEN row_number() OVER (PARTITION BY qid ORDER BY teacher DESC NULLS LAST, page_rank, order_index, block_id) - 1 END AS teacher_rank FROM rows""")
def labelled_candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Gold labels, teacher scores and teacher ranks of every block."""
    return _labelled(spark, sf_dir).select("qid", "block_id", "label", "teacher_score", "teacher_rank")


@register("prefiltered_candidates", f"""WITH {S.SQL_BLOCKS}, {_ROWS}, k AS (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY lexical_score DESC, page_rank, order_index, block_id) AS kept_rank FROM rows),
    g AS (SELECT qid, row_number() OVER (ORDER BY qid) - 1 AS grp FROM rows GROUP BY qid HAVING bool_or(is_gold))
    SELECT qid, grp, block_id, kept_rank, is_gold::INT AS label FROM k JOIN g USING (qid) WHERE kept_rank <= 3 OR is_gold""")
def prefiltered_candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each document's three longest blocks and its gold ones, as the rows of a training matrix."""
    kept = C.with_gold_only(C.prefilter(_labelled(spark, sf_dir), 3, F.col("label") == 1))
    return kept.select("qid", F.col("group").cast("long").alias("grp"), "block_id", "kept_rank", "label")
