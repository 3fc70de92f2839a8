"""Queries over the tables' contents for operators that no other query exercises."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from folioscope.functions import geometry
from folioscope.functions.text import snippet, tokens
from folioscope.operators import evidence, grounding, paired, retention, selection
from folioscope.plans import surrogates as S
from folioscope.plans.registry import register
from folioscope.session import table

_CELLS = f"""{S.SQL_BLOCKS},
t AS (
  SELECT doc_id, page_id AS page, order_index, ln(1 + length(text))::DOUBLE AS score,
    CASE WHEN x1 > x0 AND y1 > y0 THEN (least(2, floor(least(page_h - 1e-6::DOUBLE, (y0 + y1) * 0.5) / page_h * 3)) * 3 + least(2, floor(least(page_w - 1e-6::DOUBLE, (x0 + x1) * 0.5) / page_w * 3)))::INT END AS cell
  FROM blocks
)
"""


@register("retained_blocks", f"""WITH {_CELLS},
    p AS (SELECT doc_id, page, max(score) AS s, avg(score) AS f, count(*) / 4.0::DOUBLE AS r, count(*) OVER (PARTITION BY doc_id) AS n FROM t GROUP BY doc_id, page),
    k AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY s DESC, round(f, 9) DESC, r DESC, page) AS rank FROM p),
    c AS (SELECT doc_id, page, cell, max(score) AS top FROM t WHERE cell IS NOT NULL GROUP BY ALL),
    b AS (SELECT *, row_number() OVER (PARTITION BY doc_id, page ORDER BY top DESC, cell) AS r FROM c)
    SELECT doc_id, string_agg(DISTINCT 'p' || page || '_g' || (cell // 3) || (cell % 3), ',' ORDER BY 'p' || page || '_g' || (cell // 3) || (cell % 3)) AS block_ids
    FROM k JOIN b USING (doc_id, page) WHERE rank <= greatest(1, least(n, round_even(n * 0.3::DOUBLE, 0)::BIGINT)) AND b.r <= 2 GROUP BY doc_id""")
def retained_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The two best cells of each of a document's retained pages, by their longest lines."""
    box = [F.col(c) for c in ("x0", "y0", "x1", "y1", "page_w", "page_h")]
    rows = S.blocks(spark, sf_dir).select("doc_id", F.col("page_id").alias("page"), F.log1p(F.length("text").cast("double")).alias("score"), geometry.coarse_cell(*box).alias("cell"))
    stats = rows.groupBy("doc_id", "page").agg(F.max("score").alias("page_score"), F.round(F.avg("score"), 9).alias("page_focus"), (F.count("*") / 4.0).alias("selected_ratio"))
    cells = rows.where("cell IS NOT NULL").groupBy("doc_id", "page", "cell").agg(F.max("score").alias("top_mean"))
    found = retention.retained_blocks(retention.retained_pages(stats, "doc_id", 0.3), cells, "doc_id", 2)
    return found.select("doc_id", F.array_join("block_ids", ",").alias("block_ids"))


@register("spatial_keep", f"""WITH {S.SQL_BLOCKS},
    w AS (SELECT doc_id, page_id, order_index % 4 AS row, regexp_extract_all(text, '[A-Za-z0-9]+') AS ws FROM blocks),
    t AS (SELECT doc_id, page_id, row, unnest(range(len(ws))) AS col FROM w),
    e AS (SELECT *, max(row) OVER p + 1 AS h, max(col) OVER p + 1 AS w FROM t WINDOW p AS (PARTITION BY doc_id, page_id)),
    c AS (SELECT *, (floor(row * 3 / h::DOUBLE) * 3 + floor(col * 3 / w::DOUBLE))::BIGINT AS cell FROM e)
    SELECT doc_id, page_id, cell, row, col FROM (SELECT *, row_number() OVER (PARTITION BY doc_id, page_id, cell ORDER BY row, col) AS rn FROM c) WHERE rn = 1""")
def spatial_keep(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A page's words on the grid of its lines: the first in each cell of a 3 x 3 lattice stays."""
    words = F.regexp_count("text", F.lit("[A-Za-z0-9]+"))
    lines = S.blocks(spark, sf_dir).select("doc_id", "page_id", F.pmod("order_index", F.lit(4)).alias("row"), words.alias("length"))
    return selection.spatial_keep_lines(lines, ["doc_id", "page_id"], "row", "length", 3, 3)


@register("chosen_stores", f"""WITH {S.SQL_BLOCKS}, g AS (SELECT DISTINCT doc_id FROM labels WHERE quality = 1)
    SELECT doc_id, block_id, CASE WHEN g.doc_id IS NULL THEN 'text_layer' ELSE 'ocr' END AS source, length(text) + CASE WHEN g.doc_id IS NULL THEN 0 ELSE 1 END AS chars FROM blocks LEFT JOIN g USING (doc_id)""")
def chosen_stores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents graded as good have a store of their own, whose texts are a mark longer; the others' text layer stands in."""
    blocks = S.blocks(spark, sf_dir).select("doc_id", "block_id", "text")
    good = table(spark, sf_dir, "labels").where("quality = 1").select("doc_id").distinct()
    own = blocks.join(good, "doc_id", "left_semi").withColumn("text", F.concat("text", F.lit("!")))
    return selection.choose_store(own, blocks, "doc_id").select("doc_id", "block_id", "source", F.length("text").cast("long").alias("chars"))


#: The quote form of texts that NFKC leaves alone; hyphens go twice, as one match may end where the next begins.
_HYPHEN = r"regexp_replace({0}, '([0-9A-Za-z_À-ɏ])\s*[-‐‑‒–—]\s*([0-9A-Za-z_À-ɏ])', '\1\2', 'g')"
_PLAIN = r"trim(regexp_replace(" + _HYPHEN.format(_HYPHEN) + r", '\s+', ' ', 'g'))"


@register("quote_snippets", f"""WITH a AS (SELECT doc_id, {_PLAIN.format("coalesce(text, '')")} AS t, {_PLAIN.format("coalesce(substr(text, 400, 24), '')")} AS q FROM documents),
    b AS (SELECT *, instr(lower(t), lower(q)) AS i FROM a)
    SELECT doc_id, md5(CASE WHEN q = '' OR i <= 0 THEN substr(t, 1, 220) ELSE substr(t, greatest(0, i - 1 - 73) + 1, least(length(t), i - 1 + length(q) + 110) - greatest(0, i - 1 - 73)) END) AS snippet FROM b""")
def quote_snippets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What stands around a stretch of every document's text."""
    found = snippet(F.col("text"), F.coalesce(F.substring("text", 400, 24), F.lit("")))
    return table(spark, sf_dir, "documents").select("doc_id", F.md5(found.cast("binary")).alias("snippet"))


@register("win_shares", """WITH a AS (SELECT n_chars / 100.0::DOUBLE AS a, CASE WHEN toxic = 0 THEN 10.0 + quality END::DOUBLE AS b FROM documents JOIN labels USING (doc_id))
    SELECT count(*) AS n, round(avg((b > a)::INT), 6) AS win_share, round(avg(b - a), 6) AS mean_delta FROM a WHERE a IS NOT NULL AND b IS NOT NULL""")
def win_shares(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How often a grade beats a document's length, over documents that have both."""
    rows = table(spark, sf_dir, "documents").join(table(spark, sf_dir, "labels"), "doc_id")
    out = paired.win_share(rows, F.col("n_chars") / 100.0, F.when(F.col("toxic") == 0, F.lit(10.0) + F.col("quality")))
    return out.select("n", F.round("win_share", 6).alias("win_share"), F.round("mean_delta", 6).alias("mean_delta"))


@register("line_overlaps", f"""WITH {S.SQL_BLOCKS}, l AS (SELECT doc_id, block_id, x0, y0, x1, y1, lag(x0) OVER w AS p0, lag(x1) OVER w AS p1 FROM blocks WINDOW w AS (PARTITION BY doc_id, page_id ORDER BY order_index))
    SELECT doc_id, block_id, least(x0, x1) AS left_edge, greatest(y0, y1) AS bottom_edge, round(CASE WHEN least(x1, p1) - greatest(x0, p0) > 0 AND least(x1 - x0, p1 - p0) > 0 THEN (least(x1, p1) - greatest(x0, p0)) / least(x1 - x0, p1 - p0) ELSE 0 END, 6)::DOUBLE AS overlap
    FROM l WHERE p0 IS NOT NULL""")
def line_overlaps(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each line's box from its corners, and how far it lies below the line before."""
    w = Window.partitionBy("doc_id", "page_id").orderBy("order_index")
    rows = S.blocks(spark, sf_dir).withColumn("p0", F.lag("x0").over(w)).withColumn("p1", F.lag("x1").over(w)).where("p0 IS NOT NULL")
    corner = lambda x, y: F.array(F.col(x), F.col(y))
    box = geometry.polygon_box(F.array(corner("x1", "y0"), corner("x0", "y1"), corner("x0", "y0"), corner("x1", "y1")))
    overlap = geometry.x_overlap(F.col("x0"), F.col("x1"), F.col("p0"), F.col("p1"))
    return rows.withColumn("b", box).select("doc_id", "block_id", F.col("b.x0").alias("left_edge"), F.col("b.y1").alias("bottom_edge"), F.round(overlap, 6).alias("overlap"))


@register("canonical_predictions", """SELECT conv_id, turn, json_object('result', coalesce(text, ''), 'claims', json_array(), 'evidence', json_array(json_object('evidence_id', 'e1', 'page_id', turn + 1, 'quote', role)))::VARCHAR AS canonical,
    json_object('result', upper(role), 'claims', json_array(), 'evidence', json_array(json_object('evidence_id', 'e1', 'page_id', turn + 1, 'quote', role)))::VARCHAR AS replaced FROM conversations""")
def canonical_predictions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every turn as an answer with a field too many: its known fields, and with another result."""
    one = F.struct(F.lit("e1").alias("evidence_id"), (F.col("turn") + 1).alias("page_id"), F.col("role").alias("quote"), F.lit(1).alias("other"))
    answer = F.to_json(F.struct(F.coalesce("text", F.lit("")).alias("result"), F.array().cast("array<struct<claim_id:string,text:string>>").alias("claims"), F.array(one).alias("evidence")))
    rows = table(spark, sf_dir, "conversations").withColumn("pred", F.concat(F.lit("So: "), answer))
    return rows.select("conv_id", "turn", grounding.canonical("pred").alias("canonical"), grounding.replace_result("pred", F.upper("role")).alias("replaced"))


_EVIDENCE = f"""{S.SQL_BLOCKS},
b AS (SELECT doc_id, page_id, block_id, order_index, text, row_number() OVER (PARTITION BY doc_id ORDER BY length(text) DESC, order_index) AS rn, len({S.sql_tokens('text')}) % 5 = 0 AS gold FROM blocks),
a AS (
  SELECT doc_id, list_distinct(list(page_id) FILTER (gold)) AS gold, list_sort(list(block_id) FILTER (gold)) AS blocks, list_sort(list(block_id) FILTER (gold AND page_id <= 3)) AS seen_blocks, list_distinct(list(page_id) FILTER (page_id <= 3)) AS given,
    list_distinct(list(page_id) FILTER (rn <= 2)) AS kept, list(block_id) FILTER (rn <= 2) AS kept_blocks FROM b GROUP BY doc_id
),
v AS (SELECT lang, coalesce(gold, []) AS gold, coalesce(blocks, []) AS blocks, coalesce(seen_blocks, []) AS seen_blocks, given, kept, kept_blocks, list_filter(coalesce(gold, []), lambda p: p <= 3) AS seen, n_chars / 4.0::DOUBLE AS vt FROM a JOIN documents USING (doc_id)),
m AS (
  SELECT lang, vt, CASE WHEN len(gold) > 0 THEN len(list_intersect(gold, given)) / len(gold)::DOUBLE END AS ipr, CASE WHEN len(gold) > 0 THEN len(list_intersect(gold, kept)) / len(gold)::DOUBLE END AS pr, CASE WHEN len(seen) > 0 THEN len(list_intersect(seen, kept)) / len(seen)::DOUBLE END AS vpr,
    CASE WHEN len(blocks) > 0 THEN len(list_intersect(blocks, kept_blocks)) / len(blocks)::DOUBLE END AS br, CASE WHEN len(seen_blocks) > 0 THEN len(list_intersect(seen_blocks, kept_blocks)) / len(seen_blocks)::DOUBLE END AS vbr, CASE WHEN len(blocks) > 0 THEN list_has_any(blocks, kept_blocks)::INT END AS hit FROM v
),
j AS (SELECT *, ipr IS NOT NULL AND pr IS NOT NULL AS judged FROM m)
"""


@register("content_coverage", f"""WITH {_EVIDENCE}
    SELECT lang, count(*) FILTER (judged) AS n, count(*) FILTER (judged AND vpr IS NOT NULL) AS n_visible, count(*) FILTER (judged AND br IS NOT NULL) AS n_blocks, round(avg(ipr) FILTER (judged), 6) AS input_page_recall, round(avg(pr) FILTER (judged), 6) AS page_recall, round(avg((pr >= 1)::INT) FILTER (judged), 6) AS page_full_recall,
      round(avg(vpr) FILTER (judged), 6) AS visible_page_recall, round(avg((vpr >= 1)::INT) FILTER (judged), 6) AS visible_page_full_recall, round(avg(br) FILTER (judged), 6) AS exact_block_recall, round(avg((br >= 1)::INT) FILTER (judged), 6) AS exact_block_full_recall, round(avg(vbr) FILTER (judged), 6) AS visible_exact_block_recall,
      round(avg((vbr >= 1)::INT) FILTER (judged), 6) AS visible_exact_block_full_recall, round(avg(hit) FILTER (judged), 6) AS block_hit, round(avg(pr) FILTER (judged) / avg(vt), 8) AS efficiency, round(avg(vpr) FILTER (judged) / avg(vt), 8) AS visible_efficiency FROM j GROUP BY lang""")
def content_coverage(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How well a document's two longest lines, and their pages, cover its marked lines, by language."""
    order = F.row_number().over(Window.partitionBy("doc_id").orderBy(F.length("text").desc(), "order_index"))
    lines = S.blocks(spark, sf_dir).select("doc_id", "page_id", "block_id", order.alias("rn"), (F.size(tokens(F.col("text"))) % 5 == 0).alias("gold"))
    of = lambda on, c: F.collect_list(F.when(on, c))
    top, gold = F.col("rn") <= 2, F.col("gold")
    rows = lines.groupBy("doc_id").agg(
        of(gold, F.struct("page_id", "block_id")).alias("e"), F.array_distinct(of(F.col("page_id") <= 3, F.col("page_id"))).alias("given"), F.array_distinct(of(top, F.col("page_id"))).alias("kept"), of(top, F.col("block_id")).alias("kept_blocks")
    )
    rows = rows.join(table(spark, sf_dir, "documents").select("doc_id", "lang", (F.col("n_chars") / 4.0).alias("visual_tokens")), "doc_id")
    found = evidence.coverage(F.col("e"), F.col("given"), F.col("kept"), F.col("kept_blocks"), F.transform("e", lambda x: x.block_id), F.col("kept_blocks"))
    out = evidence.coverage_summary(rows.select("lang", "visual_tokens", *[c.alias(k) for k, c in found.items()]), ["lang"])
    digits = {"efficiency": 8, "visible_efficiency": 8}
    return out.select(*[c if c in ("lang", "n", "n_visible", "n_blocks") else F.round(c, digits.get(c, 6)).alias(c) for c in out.columns])
