"""Retrieval and ranking queries."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from folioscope.functions import geometry
from folioscope.functions.text import tokens
from folioscope.operators import impact, metrics, retrieval, vector_lists
from folioscope.plans import surrogates as S
from folioscope.plans.registry import register
from folioscope.session import table, written

_SCORES = f"""
q AS (SELECT item_id AS qid, token, count(*) AS q_tf FROM (SELECT item_id, unnest({S.sql_tokens('text')}) AS token FROM benchmark) GROUP BY ALL),
d AS (SELECT doc_id, token, count(*) AS tf FROM (SELECT doc_id, unnest({S.sql_tokens('text')}) AS token FROM documents) GROUP BY ALL),
f AS (SELECT token, count(*) AS df FROM d GROUP BY token),
n AS (SELECT count(*) AS n FROM documents),
s AS (SELECT qid, doc_id, sum(q_tf * least(3, tf) * (ln((1::DOUBLE + n) / (1::DOUBLE + df)) + 1)) AS score, count(*) AS matched FROM q JOIN d USING (token) JOIN f USING (token), n GROUP BY ALL),
r AS (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY round(score, 6) DESC, doc_id) AS rank FROM s)
"""


def searched(spark: SparkSession, sf_dir: str, k: int, least_share: float | None = None) -> DataFrame:
    """(qid, doc_id, score, matched, rank): each item's k best documents by the block-maxima index."""
    index = written(impact.build(table(spark, sf_dir, "documents"), "doc_id", F.col("text")), "impact-index", **impact.STORED)
    return impact.search(index, S.questions(spark, sf_dir), k, least_share).withColumnRenamed("unit", "doc_id")


@register("retrieval_topk", f"WITH {_SCORES} SELECT qid, doc_id, rank, round(score, 6) AS score, matched FROM r WHERE rank <= 16")
def topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return searched(spark, sf_dir, 16).select("qid", "doc_id", "rank", "score", "matched")


@register(
    "retrieval_recall",
    f"""WITH {_SCORES},
    nq AS (SELECT qid, count(*) AS nq FROM q GROUP BY qid),
    items AS (SELECT item_id AS qid, 'set' || (item_id % 3) AS dataset FROM benchmark),
    gold AS (SELECT qid, list(doc_id) AS gold FROM s JOIN nq USING (qid) WHERE 10 * matched >= 9 * nq GROUP BY qid),
    rk AS (SELECT qid, list(doc_id ORDER BY rank) AS ranked FROM r WHERE rank <= 16 GROUP BY qid),
    m AS (SELECT k, dataset, coalesce(gold, []) AS gold, list_slice(coalesce(ranked, []), 1, k) AS cut FROM items LEFT JOIN gold USING (qid) LEFT JOIN rk USING (qid), (VALUES (4), (8), (16)) ks(k)),
    v AS (SELECT k, dataset, CASE WHEN len(gold) > 0 THEN len(list_intersect(gold, cut)) / len(gold)::DOUBLE END AS rec FROM m)
    SELECT k::BIGINT AS k, dataset, count(*) AS n, count(rec) AS n_gold, round(avg(rec), 6) AS recall, round(avg((rec = 1)::INT), 6) AS full_recall, round(avg((rec > 0)::INT), 6) AS hit_rate
    FROM v GROUP BY GROUPING SETS ((k), (k, dataset))""",
)
def recall(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The flagship: rank documents for every item, and evaluate the rankings at 4, 8 and 16."""
    scores = written(searched(spark, sf_dir, 16, 0.9), "searched")
    n_tokens = S.questions(spark, sf_dir).groupBy("qid").agg(F.count("*").alias("nq"))
    gold = scores.join(n_tokens, "qid").where("10 * matched >= 9 * nq").groupBy("qid").agg(F.collect_list("doc_id").alias("gold"))
    ranked = scores.where("rank <= 16").groupBy("qid").agg(F.transform(F.array_sort(F.collect_list(F.struct("rank", "doc_id"))), lambda s: s.doc_id).alias("ranked"))
    items = table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("qid"), F.concat(F.lit("set"), F.pmod("item_id", F.lit(3)).cast("string")).alias("dataset"))
    manifest = items.join(gold, "qid", "left").select(F.col("qid").alias("sample_id"), "dataset", F.coalesce("gold", F.array().cast("array<bigint>")).alias("gold"))
    out = metrics.evaluate_rankings(manifest, ranked.withColumnRenamed("qid", "sample_id"), (4, 8, 16), "dataset")
    return out.select("k", "dataset", "n", "n_gold", *[F.round(c, 6).alias(c) for c in ("recall", "full_recall", "hit_rate")])


_CANDIDATES = f"""{S.SQL_BLOCKS}, {_SCORES},
src AS (SELECT qid, doc_id FROM r WHERE rank <= 4),
c AS (SELECT qid, b.* FROM src JOIN blocks b USING (doc_id)),
cn AS (SELECT qid, count(*) AS n FROM c GROUP BY qid),
ct AS (SELECT qid, doc_id, block_id, token, count(*) AS tf FROM (SELECT qid, doc_id, block_id, unnest({S.sql_tokens('text')}) AS token FROM c) GROUP BY ALL),
cf AS (SELECT qid, token, count(*) AS df FROM ct GROUP BY ALL),
cs AS (SELECT qid, doc_id, block_id, sum(q_tf * least(3, tf) * (ln((1::DOUBLE + cn.n) / (1::DOUBLE + df)) + 1)) AS score, count(*) AS matched FROM ct JOIN q USING (qid, token) JOIN cf USING (qid, token) JOIN cn USING (qid) GROUP BY ALL)
"""


def sources(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """(qid, doc_id, doc_rank) of each item's four best documents, ranked from 0, and the blocks of these documents.

    The ranking is written, so Spark knows its size and picks the join with the texts by it.
    """
    source = written(searched(spark, sf_dir, 4).select("qid", "doc_id", (F.col("rank") - 1).alias("doc_rank")), "sources")
    return source, S.blocks(spark, sf_dir, source.select("doc_id").distinct())


def candidates(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Blocks of each item's four best documents (ranked from 0), and how often they hold the items' tokens.

    A document may serve many items: its blocks' tokens are counted once and then
    meet the items.
    """
    source, blocks = sources(spark, sf_dir)
    blocks = written(blocks, "source-blocks")
    counted = retrieval.term_counts(blocks, ["doc_id", "block_id"], F.col("text"), vocabulary=S.questions(spark, sf_dir))
    terms = counted.join(source.select("qid", "doc_id"), "doc_id").join(S.questions(spark, sf_dir).select("qid", "token"), ["qid", "token"], "left_semi")
    return blocks.join(source, "doc_id"), terms


def candidate_scores(spark: SparkSession, sf_dir: str, found: DataFrame, terms: DataFrame) -> DataFrame:
    """Scores of candidates within their item's set."""
    totals = found.groupBy("qid").agg(F.count("*").alias("n_units"))
    return retrieval.lexical_scores(S.questions(spark, sf_dir), terms, totals, ["doc_id", "block_id"], scope=["qid"])


@register("block_candidates", f"""WITH {_CANDIDATES}, nq AS (SELECT qid, count(*) AS nq FROM q GROUP BY qid)
    SELECT qid, doc_id, block_id, page_id, round(score, 6) AS lexical_score, matched, round(ln(1 + score), 6) AS f_lexical, round(matched / nq::DOUBLE, 6) AS f_matched,
      round(CASE WHEN x1 > x0 AND y1 > y0 THEN least(1, greatest(0, (x0 + x1) / 2 / page_w)) ELSE 0.5 END, 6) AS bbox_cx,
      round(CASE WHEN x1 > x0 AND y1 > y0 THEN least(1, greatest(0, (x1 - x0) / page_w)) * least(1, greatest(0, (y1 - y0) / page_h)) ELSE 1 END, 6) AS bbox_area
    FROM cs JOIN c USING (qid, doc_id, block_id) JOIN nq USING (qid)""")
def block_candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    found, terms = candidates(spark, sf_dir)
    scores = candidate_scores(spark, sf_dir, found, terms)
    n_tokens = S.questions(spark, sf_dir).groupBy("qid").agg(F.count("*").alias("nq"))
    box = geometry.box_features(*[F.col(c) for c in ("x0", "y0", "x1", "y1", "page_w", "page_h")])
    return scores.join(found, ["qid", "doc_id", "block_id"]).join(n_tokens, "qid").select(
        "qid", "doc_id", "block_id", "page_id", F.round("score", 6).alias("lexical_score"), "matched",
        F.round(F.log1p("score"), 6).alias("f_lexical"), F.round(F.col("matched") / F.col("nq").cast("double"), 6).alias("f_matched"),
        F.round(box["bbox_cx"], 6).alias("bbox_cx"), F.round(box["bbox_area"], 6).alias("bbox_area"),
    )


@register("page_selection", f"""WITH {S.SQL_BLOCKS},
    t AS (SELECT doc_id, page_id, token, count(*) AS tf FROM (SELECT doc_id, page_id, unnest({S.sql_tokens('text', 'page')}) AS token FROM blocks) GROUP BY ALL),
    k AS (SELECT doc_id, page_id, count(*) AS kinds FROM t GROUP BY ALL),
    r AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY kinds DESC, page_id) AS rank FROM k)
    SELECT doc_id, page_id, kinds FROM r WHERE rank <= 2""")
def page_selection(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The two pages of each document with most distinct page-profile tokens, in page order by key."""
    terms = retrieval.term_counts(S.blocks(spark, sf_dir), ["doc_id", "page_id"], F.col("text"), "page")
    kinds = terms.groupBy("doc_id", "page_id").agg(F.count("*").alias("kinds"))
    return retrieval.top_k(kinds, ["doc_id"], [F.col("kinds").desc(), F.col("page_id")], 2).drop("rank")


@register("vector_topk", """WITH q AS (SELECT vec_id AS qid, embedding AS a FROM embeddings WHERE vec_id % 20 = 0),
    s AS (SELECT qid, vec_id, round(list_dot_product(a::DOUBLE[], embedding::DOUBLE[]) / greatest(sqrt(list_dot_product(a::DOUBLE[], a::DOUBLE[])) * sqrt(list_dot_product(embedding::DOUBLE[], embedding::DOUBLE[])), 1e-6), 6) AS cosine FROM q, embeddings WHERE qid <> vec_id)
    SELECT qid, vec_id, cosine, rank FROM (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY cosine DESC, vec_id) AS rank FROM s) WHERE rank <= 5""")
def vector_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cosine neighbours of a stated query set (ids divisible by 20) among all vectors."""
    e = table(spark, sf_dir, "embeddings")
    q = e.where("vec_id % 20 = 0").select(F.col("vec_id").alias("qid"), F.col("embedding").alias("a"))
    return vector_lists.nearest(e.select("vec_id", "embedding"), q, 5)


@register("late_interaction", """WITH q AS (SELECT label AS qid, vec_id AS q_pos, embedding AS a FROM embeddings WHERE vec_id % 20 = 0), p AS (SELECT vec_id // 10 AS page_id, embedding AS b FROM embeddings),
    b AS (SELECT qid, page_id, q_pos, max(list_dot_product(a::DOUBLE[], b::DOUBLE[])) AS s FROM q, p GROUP BY ALL),
    t AS (SELECT qid, page_id, sum(s) AS score FROM b GROUP BY ALL)
    SELECT qid, page_id, round(score, 6) AS score, rank FROM (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY round(score, 6) DESC, page_id) AS rank FROM t) WHERE rank <= 4""")
def late_interaction(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "embeddings")
    q = e.where("vec_id % 20 = 0").select(F.col("label").alias("qid"), F.col("vec_id").alias("q_pos"), F.col("embedding").alias("q_vec"))
    pages = e.select(F.floor(F.col("vec_id") / 10).cast("long").alias("page_id"), F.col("embedding").alias("p_vec"))
    return vector_lists.search(q, pages, 4).select("qid", "page_id", "score", "rank")


@register("auroc", """WITH a AS (SELECT quality AS label, n_chars AS score, lang FROM labels JOIN documents USING (doc_id)),
    r AS (SELECT *, rank() OVER (PARTITION BY lang ORDER BY score) + (count(*) OVER (PARTITION BY lang, score) - 1) / 2.0::DOUBLE AS mid FROM a),
    t AS (SELECT lang, sum(label)::BIGINT AS n_pos, sum(1 - label)::BIGINT AS n_neg, sum(mid * label) AS s FROM r GROUP BY lang)
    SELECT lang, n_pos, n_neg, CASE WHEN n_pos > 0 AND n_neg > 0 THEN round((s - n_pos * (n_pos + 1) / 2) / (n_pos * n_neg), 6) END AS auroc FROM t""")
def auroc(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "labels").join(table(spark, sf_dir, "documents"), "doc_id").select(F.col("quality").alias("label"), F.col("n_chars").alias("score"), "lang")
    return metrics.auroc(rows, "label", "score", ["lang"]).withColumn("auroc", F.round("auroc", 6))


@register("recall_at_budget", f"""WITH {S.SQL_BLOCKS}, a AS (SELECT doc_id, order_index, length(text) AS chars, len({S.sql_tokens('text')}) % 4 = 0 AS gold FROM blocks),
    r AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY chars DESC, order_index) AS rn FROM a),
    g AS (SELECT doc_id, count(*) FILTER (gold) AS gold, count(*) FILTER (gold AND rn <= 3) AS hit FROM r GROUP BY doc_id HAVING count(*) FILTER (gold) > 0)
    SELECT count(*) AS n_groups, round(avg(hit / gold::DOUBLE), 6) AS recall, round(avg((hit = gold)::INT), 6) AS full_recall FROM g""")
def recall_at_budget(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many of a document's marked lines are among its three longest."""
    rows = S.blocks(spark, sf_dir).select("doc_id", "order_index", F.length("text").alias("chars"), (F.size(tokens(F.col("text"))) % 4 == 0).cast("int").alias("gold"))
    out = metrics.recall_at_budget(rows, "doc_id", "gold", [F.col("chars").desc(), F.col("order_index")], 3)
    return out.select("n_groups", F.round("recall", 6).alias("recall"), F.round("full_recall", 6).alias("full_recall"))


@register("standardized_lengths", """SELECT doc_id, round((n_chars - m) / (s + 1e-6), 6) AS n_chars_z FROM documents, (SELECT avg(n_chars) AS m, stddev_pop(n_chars) AS s FROM documents)""")
def standardized(spark: SparkSession, sf_dir: str) -> DataFrame:
    return metrics.standardize(table(spark, sf_dir, "documents").select("doc_id", "n_chars"), ["n_chars"]).select("doc_id", F.round("n_chars_z", 6).alias("n_chars_z"))


@register("token_profiles", f"""SELECT doc_id, len({S.sql_tokens('text', 'all')})::BIGINT AS n_all, len({S.sql_tokens('text')})::BIGINT AS n_block, len({S.sql_tokens('text', 'page')})::BIGINT AS n_page FROM documents""")
def token_profiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = F.col("text")
    return table(spark, sf_dir, "documents").select("doc_id", *[F.size(tokens(t, p)).cast("long").alias(f"n_{p}") for p in ("all", "block", "page")])
