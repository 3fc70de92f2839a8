"""Studies over the tables' own texts, labels and rankings."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from folioscope.functions import judge_requests as requests
from folioscope.operators import studies
from folioscope.plans import retrieval as R
from folioscope.plans.registry import register
from folioscope.session import table, written

_THREE = """
a AS (SELECT d.doc_id AS sample, lang, quality = 1 AS images, toxic = 0 AS own, n_chars >= 1000 AS forgn FROM documents d JOIN labels USING (doc_id)),
c AS (SELECT lang, 'images' AS base, 'own' AS arm, images AS x, own AS y FROM a UNION ALL SELECT lang, 'images', 'foreign', images, forgn FROM a UNION ALL SELECT lang, 'foreign', 'own', forgn, own FROM a),
m AS (SELECT lang, base, arm, count(*) AS n, count(*) FILTER (NOT x AND y) AS b, count(*) FILTER (x AND NOT y) AS c FROM c GROUP BY ALL),
s AS (SELECT *, (b - c) / n::DOUBLE AS delta, sqrt(greatest(0, b + c - (b - c) * (b - c) / n::DOUBLE)) / n AS se FROM m),
g AS (SELECT lang, max(delta) FILTER (base = 'images' AND arm = 'own') AS o, max(delta) FILTER (base = 'images' AND arm = 'foreign') AS f FROM s GROUP BY lang)
"""


@register("foreign_memory", f"""WITH {_THREE} SELECT lang, base, arm, n, b, c, round(delta, 6) + 0 AS delta, round(delta - 1.96 * se, 6) AS lo, round(delta + 1.96 * se, 6) AS hi, round(CASE WHEN o <> 0 THEN f / o END, 6) + 0 AS recovered FROM s JOIN g USING (lang)""")
def foreign_memory(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Three verdicts of every labelled document (quality, tone, length), contrasted within languages."""
    docs = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("sample"), "lang", "n_chars").join(table(spark, sf_dir, "labels").withColumnRenamed("doc_id", "sample"), "sample")
    arm = lambda c: docs.select("sample", "lang", c.alias("correct"))
    out = studies.foreign_memory(arm(F.col("quality") == 1), arm(F.col("toxic") == 0), arm(F.col("n_chars") >= 1000), "lang")
    return out.select("lang", "base", "arm", "n", "b", "c", *[(F.round(c, 6) + 0.0).alias(c) for c in ("delta", "lo", "hi", "recovered")])


_VERDICTS = """
v AS (
  SELECT lang, CASE WHEN quality = 1 THEN 'correct' WHEN toxic = 1 THEN 'incorrect' ELSE 'partial' END AS o, CASE WHEN n_chars >= 1500 THEN 'correct' WHEN n_chars >= 600 THEN 'partial' ELSE 'incorrect' END AS n
  FROM documents JOIN labels USING (doc_id)
)
"""


@register("judge_agreement", f"""WITH {_VERDICTS}, g AS (
      SELECT lang, count(*) AS samples, avg((o = 'correct')::INT) AS old_rate, avg((n = 'correct')::INT) AS new_rate, count(*) FILTER (n = 'correct' AND o <> 'correct') AS b, count(*) FILTER (o = 'correct' AND n <> 'correct') AS c,
        avg(((o = 'correct') = (n = 'correct'))::INT) AS agree, avg((o = n)::INT) AS agree_three FROM v GROUP BY GROUPING SETS ((lang), ()))
    SELECT lang, samples, round(old_rate, 6) AS old_rate, round(new_rate, 6) AS new_rate, b, c, round(agree, 6) AS agree, round(agree_three, 6) AS agree_three, round((b - c) / samples::DOUBLE, 6) + 0 AS delta, round(1.96 * sqrt(b + c) / samples, 6) AS half FROM g""")
def judge_agreement(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two graders of every labelled document: one by its labels, one by its length."""
    rows = table(spark, sf_dir, "documents").join(table(spark, sf_dir, "labels"), "doc_id")
    old = F.when(F.col("quality") == 1, "correct").when(F.col("toxic") == 1, "incorrect").otherwise("partial")
    new = F.when(F.col("n_chars") >= 1500, "correct").when(F.col("n_chars") >= 600, "partial").otherwise("incorrect")
    out = studies.judge_agreement(rows, old, new, "lang")
    return out.select("lang", "samples", "b", "c", *[(F.round(c, 6) + 0.0).alias(c) for c in ("old_rate", "new_rate", "agree", "agree_three", "delta", "half")])


@register("selector_reasons", f"""WITH {R._SCORES},
    k AS (SELECT item_id AS qid, (SELECT list(doc_id ORDER BY doc_id) FROM documents JOIN labels USING (doc_id) WHERE quality = 1) AS known FROM benchmark),
    o AS (SELECT qid, list(doc_id ORDER BY rank) AS ranked FROM r WHERE rank <= 16 GROUP BY qid),
    w AS (SELECT qid, known, ranked, list_filter(coalesce(ranked, []), lambda p: list_contains(known, p)) AS hits FROM k LEFT JOIN o USING (qid)),
    x AS (SELECT *, CASE WHEN len(hits) >= 4 THEN list_position(ranked, hits[4]) ELSE len(coalesce(ranked, [])) END AS upto FROM w)
    SELECT qid, array_to_string(CASE WHEN len(hits) > 0 THEN hits[1:4] ELSE known[1:2] END, ',') AS selected, len(hits) > 0 AS used,
      CASE WHEN ranked IS NULL THEN 'missing_external_prediction' WHEN len(hits) = 0 THEN 'no_valid_external_page' END AS reason,
      array_to_string(list_filter(coalesce(ranked, [])[1:upto], lambda p: NOT list_contains(known, p))[1:10], ',') AS missing, len(coalesce(ranked, []))::INT AS n_ranked FROM x""")
def selector_reasons(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each item's ranking walked over the documents graded as good, which stand for the pages at hand."""
    found = written(R.searched(spark, sf_dir, 16), "searched")  # read twice below, searched once
    ranked = found.groupBy("qid").agg(F.transform(F.array_sort(F.collect_list(F.struct("rank", "doc_id"))), lambda s: s.doc_id).alias("ranked"))
    good = table(spark, sf_dir, "documents").join(table(spark, sf_dir, "labels").where("quality = 1"), "doc_id", "left_semi")
    # Only pages that some ranking names, and the first two, can matter to a sample.
    named = ranked.select(F.explode("ranked").alias("doc_id")).distinct()
    first = good.select("doc_id").orderBy("doc_id").limit(2)
    known = good.select("doc_id").join(named, "doc_id", "left_semi").unionByName(first).distinct().agg(F.array_sort(F.collect_list("doc_id")).alias("known"))
    items = table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("qid")).join(ranked, "qid", "left").crossJoin(F.broadcast(known))  # one row, 16 ids an item at most
    e = studies.external_selection(F.col("ranked"), F.col("known"), 4, 2)
    text = lambda c: F.array_join(c.cast("array<string>"), ",")
    return items.withColumn("e", e).select("qid", text(F.col("e.selected")).alias("selected"), "e.used", "e.reason", text(F.col("e.missing")).alias("missing"), "e.n_ranked")



@register("judge_requests", """SELECT conv_id, turn, json_object('model', 'gpt-5', 'instructions', 'Grade.', 'input', coalesce(text, ''), 'max_output_tokens', 8000, 'reasoning', json_object('effort', 'medium'))::VARCHAR AS body, coalesce(text, '') || '!' AS answer FROM conversations""")
def judge_requests(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A request for every turn, and the text of the answer that repeats it with a mark."""
    said = F.coalesce("text", F.lit(""))
    part = lambda t: F.struct(F.lit("output_text").alias("type"), t.alias("text"))
    response = F.to_json(F.struct(F.array(F.struct(F.array(part(said), part(F.lit("!"))).alias("content"))).alias("output")))
    rows = table(spark, sf_dir, "conversations")
    return rows.select("conv_id", "turn", requests.body("responses", "gpt-5", "Grade.", said, "medium").alias("body"), requests.answer_text("responses", response).alias("answer"))
