"""Evidence coverage, grounding and reader reports as queries."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from folioscope.operators import evidence as E
from folioscope.operators import manifests as M
from folioscope.operators import reports
from folioscope.plans import surrogates as S
from folioscope.plans.registry import register
from folioscope.session import table


def _mod(n: int, c: str = "doc_id"):
    return F.pmod(c, F.lit(n))


@register("coarse_ids", f"""WITH {S.SQL_BLOCKS}, k AS (SELECT doc_id, page_id, order_index, CASE doc_id % 3 WHEN 0 THEN 'p' || page_id || '_g12' WHEN 1 THEN 'p' || page_id || '_b' || (order_index % 12) ELSE 'x' END AS id, CASE WHEN doc_id % 2 = 0 THEN x0 END AS x0, y0, x1, y1, page_w, page_h FROM blocks),
    c AS (SELECT *, CASE WHEN x1 > x0 AND y1 > y0 THEN (least(2, floor((y0 + y1) * 0.5 / page_h * 3)) * 3 + least(2, floor((x0 + x1) * 0.5 / page_w * 3)))::INT END AS cell FROM k)
    SELECT doc_id, order_index, CASE WHEN id LIKE '%g12' THEN id WHEN id LIKE '%b%' THEN (SELECT CASE WHEN n BETWEEN 0 AND 8 THEN 'p' || page_id || '_g' || (n // 3) || (n % 3) END FROM (SELECT coalesce(cell, CASE WHEN doc_id % 4 = 1 THEN least(8, floor((order_index % 4) * 9 / 4))::INT END, CASE WHEN order_index % 12 BETWEEN 1 AND 9 THEN order_index % 12 - 1 END) AS n)) END AS coarse FROM c""")
def coarse_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Block names as cells: given, by box, by reading order, or by number."""
    b = S.blocks(spark, sf_dir)
    page, n = F.col("page_id").cast("string"), F.col("order_index")
    name = F.when(_mod(3) == 0, F.concat(F.lit("p"), page, F.lit("_g12"))).when(_mod(3) == 1, F.concat(F.lit("p"), page, F.lit("_b"), F.pmod(n, F.lit(12)).cast("string"))).otherwise("x")
    in_page = F.when(_mod(4) == 1, F.lit(4))
    found = E.coarse_id(name, F.when(_mod(2) == 0, F.col("x0")), F.col("y0"), F.col("x1"), F.col("y1"), F.col("page_w"), F.col("page_h"), F.pmod(n, F.lit(4)), in_page)
    return b.select("doc_id", "order_index", found.alias("coarse"))


_EV = """e AS (SELECT doc_id, lang, CASE WHEN doc_id % 9 = 0 THEN [] ELSE list_distinct([doc_id % 5 + 1, doc_id % 3 + 1]) END AS gold, CASE WHEN doc_id % 9 = 0 THEN [] ELSE list_distinct(['b' || (doc_id % 5 + 1), 'b' || (doc_id % 3 + 1)]) END AS blocks,
  [1, 2, 3, doc_id % 4 + 1] AS given, CASE WHEN doc_id % 11 > 0 THEN [doc_id % 4 + 1, 1] END AS kept, CASE WHEN doc_id % 6 > 0 THEN ['b1', 'b' || (doc_id % 4 + 1)] END AS kept_blocks FROM documents)"""


@register("coverage_summary", f"""WITH {_EV}, v AS (SELECT *, list_filter(gold, lambda p: list_contains(given, p)) AS seen, list_filter(blocks, lambda b: list_contains(given, substr(b, 2)::BIGINT)) AS seen_blocks FROM e),
    m AS (SELECT lang, CASE WHEN len(gold) > 0 THEN len(list_intersect(gold, given)) / len(gold)::DOUBLE END AS ipr, CASE WHEN len(gold) > 0 AND kept IS NOT NULL THEN len(list_intersect(gold, kept)) / len(gold)::DOUBLE END AS pr,
      CASE WHEN len(seen) > 0 AND kept IS NOT NULL THEN len(list_intersect(seen, kept)) / len(seen)::DOUBLE END AS vpr, CASE WHEN len(blocks) > 0 AND kept_blocks IS NOT NULL THEN len(list_intersect(blocks, kept_blocks)) / len(blocks)::DOUBLE END AS br,
      CASE WHEN len(seen_blocks) > 0 AND kept_blocks IS NOT NULL THEN len(list_intersect(seen_blocks, kept_blocks)) / len(seen_blocks)::DOUBLE END AS vbr, CASE WHEN len(blocks) > 0 AND kept_blocks IS NOT NULL THEN list_has_any(blocks, kept_blocks)::INT END AS hit, (100 + doc_id % 7)::DOUBLE AS vt FROM v),
    j AS (SELECT *, ipr IS NOT NULL AND pr IS NOT NULL AS on_ FROM m)
    SELECT lang, count(*) FILTER (on_) AS n, count(*) FILTER (on_ AND vpr IS NOT NULL) AS n_visible, count(*) FILTER (on_ AND br IS NOT NULL) AS n_blocks, round(avg(ipr) FILTER (on_), 6) AS input_page_recall, round(avg(pr) FILTER (on_), 6) AS page_recall, round(avg((pr >= 1)::INT) FILTER (on_), 6) AS page_full_recall,
      round(avg(vpr) FILTER (on_), 6) AS visible_page_recall, round(avg((vpr >= 1)::INT) FILTER (on_), 6) AS visible_page_full_recall, round(avg(br) FILTER (on_), 6) AS exact_block_recall, round(avg((br >= 1)::INT) FILTER (on_), 6) AS exact_block_full_recall,
      round(avg(vbr) FILTER (on_), 6) AS visible_exact_block_recall, round(avg((vbr >= 1)::INT) FILTER (on_), 6) AS visible_exact_block_full_recall, round(avg(hit) FILTER (on_), 6) AS block_hit, round(avg(pr) FILTER (on_) / avg(vt), 8) AS efficiency, round(avg(vpr) FILTER (on_) / avg(vt), 8) AS visible_efficiency FROM j GROUP BY lang""")
def coverage_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Coverage of evidence pages, visible pages and blocks by what was kept, per language."""
    number = lambda n: _mod(n) + 1
    name = lambda n: F.concat(F.lit("b"), number(n).cast("string"))
    piece = lambda n: F.struct(number(n).alias("page_id"), name(n).alias("block_id"))
    evidence = F.when(_mod(9) == 0, F.array().cast("array<struct<page_id:bigint,block_id:string>>")).otherwise(F.array(piece(5), piece(3)))
    given = F.array(*[F.lit(k).cast("long") for k in (1, 2, 3)], number(4))
    kept = F.when(_mod(11) > 0, F.array(number(4), F.lit(1).cast("long")))
    kept_blocks = F.when(_mod(6) > 0, F.array(F.lit("b1"), name(4)))
    rows = table(spark, sf_dir, "documents").select("doc_id", "lang", evidence.alias("e"), given.alias("given"), kept.alias("kept"), kept_blocks.alias("kept_blocks"), (100 + _mod(7)).cast("double").alias("visual_tokens"))
    cells = F.transform("e", lambda x: x.block_id)
    found = E.coverage(F.col("e"), F.col("given"), F.col("kept"), F.col("kept_blocks"), cells, F.col("kept_blocks"))
    out = E.coverage_summary(rows.select("lang", "visual_tokens", *[c.alias(k) for k, c in found.items()]), ["lang"])
    digits = {"efficiency": 8, "visible_efficiency": 8}
    return out.select(*[c if c in ("lang", "n", "n_visible", "n_blocks") else F.round(c, digits.get(c, 6)).alias(c) for c in out.columns])


@register("target_coverage", f"""WITH {_EV} SELECT lang, count(*) AS n, count(*) FILTER (doc_id % 4 > 0) AS n_layout, count(*) FILTER (len(gold) > 0) AS n_with_pages, count(*) FILTER (len(blocks) > 0) AS n_with_blocks, count(*) FILTER (len(kept_blocks) > 0) AS n_with_visible,
    sum(len(gold))::BIGINT AS pages, sum(len(blocks))::BIGINT AS blocks, sum(coalesce(len(kept_blocks), 0))::BIGINT AS visible FROM e GROUP BY lang""")
def target_coverage(spark: SparkSession, sf_dir: str) -> DataFrame:
    number = lambda n: _mod(n) + 1
    name = lambda n: F.concat(F.lit("b"), number(n).cast("string"))
    some = lambda a: F.when(_mod(9) == 0, F.slice(a, 1, 0)).otherwise(F.array_distinct(a))
    rows = table(spark, sf_dir, "documents").select(
        "lang", (_mod(4) > 0).alias("has_layout"), some(F.array(number(5), number(3))).alias("target_pages"), some(F.array(name(5), name(3))).alias("target_blocks"), F.when(_mod(6) > 0, F.array(F.lit("b1"), name(4))).alias("visible_blocks")
    )
    return E.target_coverage(rows, ["lang"])


@register("gold_strata", """WITH r AS (SELECT source, doc_id % 3 AS hit, CASE WHEN doc_id % 10 = 0 THEN 0 ELSE 2 END AS gold FROM documents), s AS (SELECT source, CASE WHEN gold = 0 OR hit = 0 THEN 'none' WHEN hit = gold THEN 'all' ELSE 'part' END AS stratum FROM r) SELECT source, stratum, count(*) AS n FROM s GROUP BY ALL""")
def gold_strata(spark: SparkSession, sf_dir: str) -> DataFrame:
    stratum = E.gold_stratum(_mod(3), F.when(_mod(10) == 0, 0).otherwise(2))
    return table(spark, sf_dir, "documents").groupBy("source", stratum.alias("stratum")).agg(F.count("*").alias("n"))


@register("expected_scores", """WITH x AS (SELECT doc_id AS sample, unnest(['f1', 'f2', 'f3']) AS fact FROM documents)
    SELECT sample, fact, CASE WHEN fact = 'f' || (sample % 3 + 1) THEN 0.0 WHEN (sample % 5) / 4.0 < 0.125 THEN 0 WHEN (sample % 5) / 4.0 <= 0.375 THEN 0.25 WHEN (sample % 5) / 4.0 <= 0.625 THEN 0.5 WHEN (sample % 5) / 4.0 <= 0.875 THEN 0.75 ELSE 1 END::DOUBLE AS score, CASE WHEN fact = 'f' || (sample % 3 + 1) THEN 'judge_missing_fact_score' ELSE 'given' END AS reason FROM x""")
def expected_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every expected fact's score; a grader left out one in three."""
    facts = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("sample"), F.explode(F.array(*[F.lit(f"f{k}") for k in (1, 2, 3)])).alias("fact"))
    missing = F.concat(F.lit("f"), (F.pmod("sample", F.lit(3)) + 1).cast("string"))
    given = facts.where(F.col("fact") != missing).select("sample", "fact", (F.pmod("sample", F.lit(5)) / 4.0).alias("score"), F.lit("given").alias("reason"))
    return E.expected_scores(facts, given, "fact", "judge_missing_fact_score")


@register("grounding_summary", """WITH r AS (SELECT lang, doc_id % 8 > 0 AS a, doc_id % 5 > 0 AS j, doc_id % 3 > 0 AS jv, CASE WHEN doc_id % 4 > 0 THEN (doc_id % 4) / 3.0::DOUBLE END AS c, (doc_id % 2)::DOUBLE AS s FROM documents)
    SELECT lang, count(*) FILTER (a) AS n, round(sum(j::INT) FILTER (a) / count(*) FILTER (a), 6) AS json_valid, round(sum(coalesce(c, 0)) FILTER (a) / count(*) FILTER (a), 6) AS citation_score, count(*) FILTER (a AND jv) AS n_judged, round(sum(s) FILTER (a AND jv) / count(*) FILTER (a AND jv), 6) AS grounded FROM r GROUP BY lang""")
def grounding_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = F.when(_mod(4) > 0, _mod(4) / 3.0)
    s = _mod(2).cast("double")
    rows = table(spark, sf_dir, "documents").select(
        "lang", (_mod(8) > 0).alias("available"), (_mod(5) > 0).alias("json_valid"), (_mod(3) > 0).alias("judge_valid"), c.alias("citation_score"), c.alias("exact_rate"), c.alias("page_only_rate"), *[s.alias(k) for k in ("judge", "result", "facts", "claims", "grounded", "strict")]
    )
    return E.grounding_summary(rows, ["lang"]).select("lang", "n", *[F.round(k, 6).alias(k) for k in ("json_valid", "citation_score")], "n_judged", F.round("grounded", 6).alias("grounded"))


@register("loss_decomposition", """WITH r AS (SELECT lang, doc_id % 4 < 2 AS wrong, doc_id % 3 > 0 AS fr, CASE WHEN doc_id % 7 = 0 THEN [] ELSE list_distinct([doc_id % 5, doc_id % 2]) END AS gold, [doc_id % 5, doc_id % 6] AS facts FROM documents),
    k AS (SELECT lang, CASE WHEN wrong THEN CASE WHEN NOT fr THEN 'retrieval_miss' WHEN len(gold) = 0 THEN 'other' WHEN len(list_intersect(gold, facts)) >= len(gold) THEN 'join_failure' ELSE 'selector_dropped' END END AS kind FROM r)
    SELECT lang, count(kind) AS losses, count(*) FILTER (kind = 'retrieval_miss') AS retrieval_miss, count(*) FILTER (kind = 'join_failure') AS join_failure, count(*) FILTER (kind = 'selector_dropped') AS selector_dropped, count(*) FILTER (kind = 'other') AS other FROM k GROUP BY lang""")
def loss_decomposition(spark: SparkSession, sf_dir: str) -> DataFrame:
    gold = F.when(_mod(7) == 0, F.array().cast("array<bigint>")).otherwise(F.array(_mod(5), _mod(2)))
    rows = table(spark, sf_dir, "documents").select("lang", F.when(_mod(4) < 2, 0.0).otherwise(1.0).alias("score"), (_mod(3) > 0).alias("full_recall"), gold.alias("gold"), F.array(_mod(5), _mod(6)).alias("fact_pages"))
    return reports.decompose_losses(rows, ["lang"])


@register("genuine_split", r"""WITH p AS (SELECT source, CASE WHEN doc_id % 3 = 0 THEN ' A  b' ELSE 'c' END AS t, CASE WHEN doc_id % 2 = 0 THEN 'a B' ELSE 'c ' END AS b, (doc_id % 5 > 1)::INT - (doc_id % 4 > 1)::INT AS d FROM documents), s AS (SELECT *, trim(regexp_replace(lower(t), '\s+', ' ', 'g')) = trim(regexp_replace(lower(b), '\s+', ' ', 'g')) AS same FROM p)
    SELECT source, count(*) AS n, count(*) FILTER (NOT same) AS n_genuine, count(*) FILTER (same) AS n_same, round(100 * coalesce(sum(d) FILTER (NOT same), 0) / count(*)::DOUBLE, 6) AS genuine_delta_per100, round(100 * coalesce(sum(d) FILTER (same), 0) / count(*)::DOUBLE, 6) AS noise_delta_per100 FROM s GROUP BY source""")
def genuine_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    one = lambda c: c.cast("double")
    pairs = table(spark, sf_dir, "documents").select("source", F.when(_mod(3) == 0, " A  b").otherwise("c").alias("treat_pred"), F.when(_mod(2) == 0, "a B").otherwise("c ").alias("base_pred"), one(_mod(5) > 1).alias("treat"), one(_mod(4) > 1).alias("base"))
    out = reports.genuine_split(pairs, ["source"])
    return out.select("source", "n", "n_genuine", "n_same", *[F.round(c, 6).alias(c) for c in ("genuine_delta_per100", "noise_delta_per100")])


_READ = "r AS (SELECT lang AS dataset, ['pages', 'memory', 'selfask'][doc_id % 3 + 1] AS mode, doc_id % 6 > 0 AS scorable, (doc_id % 5) / 4.0::DOUBLE AS score FROM documents)"


def _read(spark: SparkSession, sf_dir: str) -> DataFrame:
    mode = F.element_at(F.array(*[F.lit(m) for m in ("pages", "memory", "selfask")]), (_mod(3) + 1).cast("int"))
    return table(spark, sf_dir, "documents").select(F.col("lang").alias("dataset"), mode.alias("mode"), (_mod(6) > 0).alias("scorable"), (_mod(5) / 4.0).alias("score"))


@register("reader_summary", f"WITH {_READ} SELECT dataset, mode, count(*) AS n, count(*) FILTER (scorable) AS n_scorable, round(avg(score) FILTER (scorable), 6) AS score FROM r GROUP BY GROUPING SETS ((dataset, mode), (mode))")
def reader_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reports.reader_summary(_read(spark, sf_dir), ["dataset", "mode"]).withColumn("score", F.round("score", 6))


@register("mode_deltas", f"""WITH {_READ}, w AS (SELECT dataset, avg(score) FILTER (scorable AND mode = 'pages') AS pages, avg(score) FILTER (scorable AND mode = 'memory') AS memory, avg(score) FILTER (scorable AND mode = 'selfask') AS selfask FROM r GROUP BY dataset)
    SELECT dataset, round(pages, 6) AS pages, round(memory, 6) AS memory, round(selfask, 6) AS selfask, round(memory - pages, 6) AS memory_delta, round(selfask - pages, 6) AS selfask_delta FROM w""")
def mode_deltas(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = reports.mode_deltas(_read(spark, sf_dir), "dataset", "mode", ["pages", "memory", "selfask"], "pages")
    return out.select("dataset", *[F.round(c, 6).alias(c) for c in out.columns[1:]])


@register("recall_strata", """WITH p AS (SELECT CASE WHEN doc_id % 7 > 0 THEN doc_id % 3 > 0 END AS fr, (doc_id % 5 > 1)::INT::DOUBLE AS t, (doc_id % 4 > 1)::INT::DOUBLE AS b FROM documents)
    SELECT CASE WHEN fr THEN 'recall_success' ELSE 'recall_miss' END AS stratum, count(*) AS n, round(avg(b), 6) AS base, round(avg(t), 6) AS treat, round(avg(t - b), 6) AS diff FROM p WHERE fr IS NOT NULL GROUP BY 1""")
def recall_strata(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "documents").select(F.when(_mod(7) > 0, _mod(3) > 0).alias("full_recall"), (_mod(5) > 1).cast("double").alias("treat"), (_mod(4) > 1).cast("double").alias("base"))
    out = reports.recall_strata(rows)
    return out.select("stratum", "n", *[F.round(c, 6).alias(c) for c in ("base", "treat", "diff")])


@register("families", """WITH d AS (SELECT doc_id, ['arxiv', 'wipo', 'nasa', 'foo'][doc_id % 4 + 1] || '_x_' || doc_id AS id FROM documents)
    SELECT doc_id, CASE WHEN doc_id % 4 = 3 THEN 'foo' ELSE split_part(id, '_', 1) END AS fidelity, CASE WHEN doc_id % 4 < 2 THEN split_part(id, '_', 1) ELSE 'other' END AS donor FROM d""")
def families(spark: SparkSession, sf_dir: str) -> DataFrame:
    name = F.element_at(F.array(*[F.lit(x) for x in ("arxiv", "wipo", "nasa", "foo")]), (_mod(4) + 1).cast("int"))
    ids = F.concat(name, F.lit("_x_"), F.col("doc_id").cast("string"))
    return table(spark, sf_dir, "documents").select("doc_id", M.family(ids).alias("fidelity"), M.family(ids, M.DONOR_FAMILIES, "other").alias("donor"))


@register("source_pages", """WITH p AS (SELECT doc_id, [3, 1, 2, 5, 4] AS given, [doc_id % 5 + 1, 9] AS kept, [doc_id % 3 + 1] AS gold FROM documents)
    SELECT doc_id, array_to_string(CASE WHEN doc_id % 5 + 1 <= 5 THEN list_filter(given, lambda x: list_contains(kept, x)) ELSE given END, ',') AS retained, array_to_string(list_filter(given, lambda x: list_contains(kept, x) OR list_contains(gold, x)), ',') AS hybrid FROM p""")
def source_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    longs = lambda *xs: F.array(*[F.lit(x).cast("long") if isinstance(x, int) else x for x in xs])
    given, kept, gold = longs(3, 1, 2, 5, 4), longs(_mod(5) + 1, 9), longs(_mod(3) + 1)
    shown = lambda c, name: F.array_join(c.cast("array<string>"), ",").alias(name)
    return table(spark, sf_dir, "documents").select("doc_id", shown(M.source_pages("retained", given, kept), "retained"), shown(M.source_pages("hybrid", given, kept, gold), "hybrid"))
