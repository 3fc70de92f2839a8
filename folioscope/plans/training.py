"""Retention and loss queries over token and block scores."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from folioscope.functions.text import tokens
from folioscope.operators import losses, retention
from folioscope.plans import surrogates as S
from folioscope.plans.registry import register
from folioscope.session import table

# A document's blocks are its tokens: cell and score are whole-number functions of their place.
_TOKENS = "tok AS (SELECT doc_id, page_id AS page, order_index, (order_index * 5 + doc_id) % 9 AS cell, ((order_index * 37 + doc_id * 11) % 41 - 10) / 10.0::DOUBLE AS score FROM blocks)"


def _tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    n, d = F.col("order_index"), F.col("doc_id")
    return S.blocks(spark, sf_dir).select("doc_id", F.col("page_id").alias("page"), "order_index", F.pmod(n * 5 + d, F.lit(9)).cast("int").alias("cell"), ((F.pmod(n * 37 + d * 11, F.lit(41)) - 10) / 10.0).alias("score"))


@register("cell_statistics", f"""WITH {S.SQL_BLOCKS}, {_TOKENS}, s AS (SELECT doc_id, cell, greatest(score, 0) AS s, order_index FROM tok), k AS (SELECT *, row_number() OVER w AS k, count(*) OVER (PARTITION BY doc_id, cell) AS m FROM s WINDOW w AS (PARTITION BY doc_id, cell ORDER BY s DESC, order_index)),
    p AS (SELECT doc_id, cell, avg(s) AS mean, sum(s) AS mass, max(s) AS max, avg(s) FILTER (k <= greatest(1, floor(m * 0.25))) AS top_mean, count(*) AS count FROM k GROUP BY ALL), t AS (SELECT doc_id, count(*) AS total FROM s GROUP BY doc_id), e AS (SELECT doc_id, total, unnest(range(9)) AS cell FROM t)
    SELECT doc_id, cell::INT AS cell, round(coalesce(mean, 0), 6)::DOUBLE AS mean, round(coalesce(mass, 0), 6)::DOUBLE AS mass, coalesce(max, 0)::DOUBLE AS max, round(coalesce(top_mean, 0), 6)::DOUBLE AS top_mean, coalesce(count, 0) AS count, round(coalesce(count, 0) / total::DOUBLE, 6) AS token_ratio FROM e LEFT JOIN p USING (doc_id, cell)""")
def cell_statistics(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = retention.cell_statistics(_tokens(spark, sf_dir), ["doc_id"], "order_index")
    return out.select("doc_id", "cell", *[F.round(c, 6).alias(c) for c in ("mean", "mass")], "max", F.round("top_mean", 6).alias("top_mean"), "count", F.round("token_ratio", 6).alias("token_ratio"))


@register("page_score_stats", f"""WITH {S.SQL_BLOCKS}, {_TOKENS} SELECT doc_id, page, count(*) AS token_count, greatest(1, floor(count(*) * 0.5))::BIGINT AS keep_count, round(avg(score), 6) AS mean, round(stddev_pop(score), 6) AS std, min(score) AS min, max(score) AS max FROM tok GROUP BY ALL""")
def page_score_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = retention.page_score_stats(_tokens(spark, sf_dir), ["doc_id", "page"], F.greatest(F.lit(1), F.floor(F.count("*") * 0.5)).cast("long"))
    return out.select("doc_id", "page", "token_count", "keep_count", F.round("mean", 6).alias("mean"), F.round("std", 6).alias("std"), "min", "max")


@register("retained_pages", f"""WITH {S.SQL_BLOCKS}, {_TOKENS}, p AS (SELECT doc_id, page, max(score) AS page_score, round(avg(score), 6) AS page_focus, count(*) / 4.0::DOUBLE AS selected_ratio, count(*) OVER (PARTITION BY doc_id) AS n FROM tok GROUP BY doc_id, page),
    k AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY page_score DESC, page_focus DESC, selected_ratio DESC, page) AS rank, greatest(1, least(n, round_even(n * 0.3::DOUBLE, 0)::BIGINT)) AS budget FROM p) SELECT doc_id, page, rank, budget FROM k WHERE rank <= budget""")
def retained_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The best three in ten of a document's pages."""
    pages = _tokens(spark, sf_dir).groupBy("doc_id", "page").agg(F.max("score").alias("page_score"), F.round(F.avg("score"), 6).alias("page_focus"), (F.count("*") / 4.0).alias("selected_ratio"))
    return retention.retained_pages(pages, "doc_id", 0.3).select("doc_id", "page", "rank", "budget")


@register("pseudo_grids", """SELECT doc_id, r.rows::INT AS rows, (n // r.rows)::INT AS columns FROM (SELECT doc_id, greatest(1, n_chars % 500)::BIGINT AS n, (SELECT max(x) AS rows FROM range(1, 23) t(x) WHERE x * x <= greatest(1, n_chars % 500) AND greatest(1, n_chars % 500) % x = 0) AS rows_ FROM documents) d, LATERAL (SELECT rows_ AS rows) r""")
def pseudo_grids(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = F.greatest(F.lit(1), F.pmod("n_chars", F.lit(500))).cast("int")
    return table(spark, sf_dir, "documents").select("doc_id", retention.pseudo_grid(n).alias("g")).select("doc_id", "g.rows", "g.columns")


# A document's lines are its candidates: longer ones score higher, those with a number of words divisible by four are positive,
# and a teacher has seen those that are wider than 20.
_SCORED = f"""{S.SQL_BLOCKS}, s AS (SELECT doc_id, order_index AS block, len({S.sql_tokens('text')}) % 4 = 0 AS pos, ln(1 + length(text))::DOUBLE AS s, CASE WHEN x1 - x0 > 20 THEN (x1 - x0) / 40 END AS teacher FROM blocks)"""


def _scored(spark: SparkSession, sf_dir: str) -> DataFrame:
    width = F.col("x1") - F.col("x0")
    return S.blocks(spark, sf_dir).select(
        "doc_id", F.col("order_index").alias("block"), (F.size(tokens(F.col("text"))) % 4 == 0).alias("pos"), F.log1p(F.length("text").cast("double")).alias("s"), F.when(width > 20, width / 40).alias("teacher")
    )


@register("budget_margin", f"""WITH {_SCORED}, c AS (SELECT doc_id, count(*) FILTER (pos) AS np, count(*) FILTER (NOT pos) AS nn FROM s GROUP BY doc_id), k AS (SELECT doc_id, s, row_number() OVER (PARTITION BY doc_id ORDER BY s DESC, block) AS k FROM s WHERE NOT pos),
    t AS (SELECT doc_id, k.s AS threshold FROM k JOIN c USING (doc_id) WHERE np > 0 AND nn > greatest(0, 2 - np) AND k = greatest(0, 2 - np) + 1) SELECT doc_id, round(avg(greatest(0, 0.5::DOUBLE - s.s + threshold)), 6) AS loss, count(*) AS pairs FROM s JOIN t USING (doc_id) WHERE pos GROUP BY doc_id""")
def budget_margin(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = losses.budget_margin(_scored(spark, sf_dir), "doc_id", F.col("pos"), F.col("s"), ["block"], 2, 0.5)
    return out.select("doc_id", F.round("loss", 6).alias("loss"), "pairs")


@register("softplus_ranking", f"""WITH {_SCORED}, n AS (SELECT doc_id, s AS neg FROM (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY s DESC, block) AS k FROM s WHERE NOT pos) WHERE k <= 3)
    SELECT doc_id, round(avg(greatest(0.2::DOUBLE - s + neg, 0) + ln(1 + exp(-abs(0.2::DOUBLE - s + neg)))), 6) AS loss FROM s JOIN n USING (doc_id) WHERE pos GROUP BY doc_id""")
def softplus_ranking(spark: SparkSession, sf_dir: str) -> DataFrame:
    return losses.softplus_ranking(_scored(spark, sf_dir), "doc_id", F.col("pos"), F.col("s"), ["block"], 3, 0.2).select("doc_id", F.round("loss", 6).alias("loss"))


@register("soft_membership", f"""WITH {_SCORED}, k AS (SELECT doc_id, block, s, row_number() OVER (PARTITION BY doc_id ORDER BY s DESC, block) AS k, count(*) OVER (PARTITION BY doc_id) AS n FROM s), t AS (SELECT doc_id, avg(s) AS threshold FROM k WHERE k IN (2, 3) GROUP BY doc_id)
    SELECT doc_id, block, round(CASE WHEN n <= 2 THEN 1 ELSE 1 / (1 + exp(-(s - threshold) / 0.5::DOUBLE)) END, 6)::DOUBLE AS membership FROM k LEFT JOIN t USING (doc_id)""")
def soft_membership(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = losses.soft_membership(_scored(spark, sf_dir), "doc_id", "s", ["block"], 2, 0.5)
    return out.select("doc_id", "block", F.round("membership", 6).alias("membership"))


@register("boundary_negatives", f"""WITH {_SCORED}, c AS (SELECT doc_id, count(*) FILTER (pos) AS np FROM s GROUP BY doc_id), k AS (SELECT doc_id, block, row_number() OVER (PARTITION BY doc_id ORDER BY s DESC, block) AS k FROM s WHERE NOT pos)
    SELECT doc_id, block FROM k JOIN c USING (doc_id) WHERE k > greatest(0, 2 - least(np, 2)) AND k <= greatest(0, 2 - least(np, 2)) + 2""")
def boundary_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    return losses.boundary_negatives(_scored(spark, sf_dir), "doc_id", F.col("pos"), F.col("s"), ["block"], 2, 2).select("doc_id", "block")


@register("distillation_loss", f"""WITH {_SCORED}, h AS (SELECT doc_id, s / 2 AS s, teacher / 2 AS q FROM s WHERE teacher IS NOT NULL), z AS (SELECT doc_id, ln(sum(exp(s))) AS zs, ln(sum(exp(q))) AS zq, count(*) AS n FROM h GROUP BY doc_id)
    SELECT doc_id, round(greatest(0, sum(exp(q - zq) * ((q - zq) - (s - zs)))) * 4 / any_value(n), 6) + 0 AS loss FROM h JOIN z USING (doc_id) WHERE n >= 2 GROUP BY doc_id""")
def distillation_loss(spark: SparkSession, sf_dir: str) -> DataFrame:
    return losses.distillation(_scored(spark, sf_dir), "doc_id", F.col("s"), F.col("teacher"), 2.0).select("doc_id", (F.round("loss", 6) + 0.0).alias("loss"))
