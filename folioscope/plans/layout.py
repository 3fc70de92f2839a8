"""Geometry, layout and sketch queries."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from folioscope.functions import geometry as G
from folioscope.operators import layout, meetings, metrics
from folioscope.plans import surrogates as S
from folioscope.plans.registry import register
from folioscope.session import table

_BOX = ("x0", "y0", "x1", "y1")


def _box() -> list:
    return [F.col(c) for c in _BOX]


@register("coarse_cells", f"""WITH {S.SQL_BLOCKS}, c AS (SELECT *, CASE WHEN x1 > x0 AND y1 > y0 THEN (least(2, greatest(0, floor(greatest(0, least(page_h - 1e-6::DOUBLE, (y0 + y1) * 0.5)) / page_h * 3))) * 3 + least(2, greatest(0, floor(greatest(0, least(page_w - 1e-6::DOUBLE, (x0 + x1) * 0.5)) / page_w * 3))))::INT END AS cell FROM blocks)
    SELECT doc_id, block_id, cell, 'p' || page_id || '_g' || (cell // 3) || (cell % 3) AS cell_name FROM c WHERE cell IS NOT NULL""")
def coarse_cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = S.blocks(spark, sf_dir).withColumn("cell", G.coarse_cell(*_box(), F.col("page_w"), F.col("page_h"))).where("cell IS NOT NULL")
    return rows.select("doc_id", "block_id", "cell", G.cell_name(F.col("page_id"), F.col("cell")).alias("cell_name"))


@register("scaled_boxes", f"""WITH {S.SQL_BLOCKS}, s AS (SELECT *, least(1, sqrt(15000 / (page_w * page_h))) AS scale FROM blocks WHERE x1 > x0 AND y1 > y0)
    SELECT doc_id, block_id, round(scale, 6) AS scale, greatest(0, floor(x0 * 100 / page_w))::BIGINT AS ix0, greatest(0, floor(y0 * 150 / page_h))::BIGINT AS iy0, least(100, ceil(x1 * 100 / page_w))::BIGINT AS ix1, least(150, ceil(y1 * 150 / page_h))::BIGINT AS iy1 FROM s""")
def scaled_boxes(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = S.blocks(spark, sf_dir).where(G.valid_box(*_box()))
    box = G.scale_box(*_box(), F.col("page_w"), F.col("page_h"), F.lit(100.0), F.lit(150.0))
    return rows.select("doc_id", "block_id", F.round(G.reader_scale(F.col("page_w"), F.col("page_h"), F.lit(15000.0)), 6).alias("scale"), box.alias("b")).select(
        "doc_id", "block_id", "scale", F.col("b.x0").alias("ix0"), F.col("b.y0").alias("iy0"), F.col("b.x1").alias("ix1"), F.col("b.y1").alias("iy1"))


@register("evidence_coverage", """WITH r AS (SELECT doc_id, lang, [doc_id % 5, doc_id % 3] AS gold, CASE WHEN doc_id % 11 > 0 THEN [doc_id % 4, 1] END AS pages, (100 + doc_id % 7)::DOUBLE AS vt FROM documents),
    m AS (SELECT lang, vt, CASE WHEN pages IS NOT NULL THEN len(list_intersect(list_distinct(gold), pages)) / len(list_distinct(gold))::DOUBLE END AS pr FROM r)
    SELECT lang, count(*) AS n, round(avg(pr), 6) AS page_recall, round(avg((pr = 1)::INT), 6) AS page_full, round(avg(vt), 6) AS visual_tokens, round(avg(pr) / avg(vt), 8) AS efficiency FROM m GROUP BY lang""")
def evidence_coverage(spark: SparkSession, sf_dir: str) -> DataFrame:
    mod = lambda n: F.pmod("doc_id", F.lit(n))
    rows = table(spark, sf_dir, "documents").select("lang", F.array(mod(5), mod(3)).alias("gold"), F.when(mod(11) > 0, F.array(mod(4), F.lit(1).cast("long"))).alias("pages"), (100 + mod(7)).cast("double").alias("visual_tokens"))
    got = metrics.evidence_coverage(F.col("gold"), F.array().cast("array<bigint>"), F.col("pages"), F.lit(None).cast("array<bigint>"))
    out = metrics.evidence_aggregate(rows.select("lang", "visual_tokens", *[c.alias(k) for k, c in got.items()]), ["lang"])
    return out.select("lang", "n", *[F.round(c, 6).alias(c) for c in ("page_recall", "page_full", "visual_tokens")], F.round("efficiency", 8).alias("efficiency"))


@register("line_blocks")
def line_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sequential grouping of recognised lines; checked against a plain version in the tests."""
    lines = S.blocks(spark, sf_dir).where(G.valid_box(*_box())).select(F.col("doc_id").alias("document_id"), "page_id", F.col("page_w").alias("page_width"), *_BOX, "text")
    return layout.line_blocks(lines)


@register("sketch_similarity")
def sketch_similarity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Signed hashing sketches of items and of every document that shares a token with them, compared."""
    docs = table(spark, sf_dir, "documents").where("doc_id IS NOT NULL").select("doc_id", "text")
    return meetings.meet(docs, "doc_id", S.questions(spark, sf_dir), sketch=True).select("doc_id", "qid", F.round("dot", 6).alias("dot"))
