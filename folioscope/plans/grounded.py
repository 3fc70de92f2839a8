"""Answers that cite evidence: evaluation end to end, and the prompts around it."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from folioscope.functions import grounded
from folioscope.functions.scoring import grounded_mix
from folioscope.operators import grounding
from folioscope.plans import surrogates as S
from folioscope.plans.coverage import _CMP, _SQZ
from folioscope.plans.registry import register
from folioscope.session import table

#: What a document's answer cites, by its own lines: the right block, its neighbour, two lines' ends, a line of
#: another page that only a gold unit has, the gold unit itself by its id, and a page that is not there.
_EVIDENCE = (
    ("a1", 1, "p1_b0", "substr(l0, 3, 18)"),
    ("a2", 1, "p1_b1", "substr(l0, 3, 18)"),
    ("a3", 1, "p1_b0", "concat(substr(l0, greatest(1, length(l0) - 5), 6), ' ', substr(l1, 1, 6))"),
    ("a4", 2, "p2_b4", "substr(l0, 3, 18)"),
    ("g2", None, None, "NULL"),
    ("a6", 99, "p99_b0", "substr(l0, 3, 18)"),
)

_SQL = rf"""{S.SQL_BLOCKS},
src AS (SELECT doc_id, coalesce(ln[1], '') AS l0, coalesce(ln[2], '') AS l1, coalesce(ln[3], '') AS l2 FROM (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS ln FROM documents)),
units AS (SELECT doc_id, 1 AS n_unit, 2 AS page_id, 'p2_b4' AS block_id, l0 AS excerpt FROM src UNION ALL SELECT doc_id, 2, 1, 'p1_b2', substr(l2, 1, 30) FROM src),
ev AS ({" UNION ALL ".join(rf"SELECT doc_id, {n} AS n, {p if p is not None else 1} AS page_id, '{b or 'p1_b2'}' AS block_id, trim(regexp_replace({'substr(l2, 1, 30)' if p is None else q}, '\s+', ' ', 'g')) AS quote FROM src" for n, (_, p, b, q) in enumerate(_EVIDENCE))}),
pt AS (SELECT doc_id, page_id, string_agg(text, chr(10) ORDER BY order_index) AS text FROM blocks GROUP BY ALL),
box AS (
  SELECT doc_id, page_id, block_id, 3 AS place, order_index AS o, text FROM blocks UNION ALL SELECT doc_id, page_id, NULL, 2, 0, text FROM pt
  UNION ALL SELECT doc_id, page_id, block_id, 4, n_unit, excerpt FROM units
),
met AS (
  SELECT ev.doc_id, ev.n, box.block_id AS c_block, place, o, text, coalesce(box.block_id = ev.block_id, false) AS same FROM ev JOIN box USING (doc_id, page_id)
  WHERE quote <> '' AND trim(text) <> '' AND (contains({_SQZ.format('text')}, lower(quote)) OR ({_CMP.format('quote')} <> '' AND contains({_CMP.format('text')}, {_CMP.format('quote')})))
),
best AS (SELECT *, row_number() OVER (PARTITION BY doc_id, n ORDER BY CASE WHEN same AND place = 3 THEN 1 ELSE place END, o, c_block) AS rn FROM met),
v AS (
  SELECT ev.doc_id, ev.n, c_block, CASE WHEN b.n IS NULL THEN 'invalid' WHEN same AND place IN (3, 4) THEN 'exact_block_quote' ELSE 'page_quote_only' END AS label,
    trim(coalesce(text, ''), chr(9) || chr(10) || chr(13) || ' ') AS raw, quote
  FROM ev LEFT JOIN (SELECT * FROM best WHERE rn = 1) b USING (doc_id, n)
),
g AS (
  SELECT doc_id, count(*) AS n_evidence, avg(CASE label WHEN 'exact_block_quote' THEN 1.0 WHEN 'page_quote_only' THEN 0.5 ELSE 0.0 END::DOUBLE) AS citation_score, avg((label = 'exact_block_quote')::INT) AS exact_rate,
    avg((label = 'page_quote_only')::INT) AS page_only_rate, avg((label = 'invalid')::INT) AS invalid_rate, string_agg(label || ':' || coalesce(c_block, '-'), ',' ORDER BY n) AS labels,
    list(CASE WHEN raw <> '' THEN raw ELSE quote END ORDER BY n) AS snippets
  FROM v GROUP BY doc_id
)
"""


def _evaluated(spark: SparkSession, sf_dir: str) -> DataFrame:
    blocks = S.blocks(spark, sf_dir).withColumnRenamed("doc_id", "document_id")
    lines = F.split(F.coalesce("text", F.lit("")), "\n")
    at = lambda i: F.coalesce(F.get(lines, i), F.lit(""))
    docs = table(spark, sf_dir, "documents").select("doc_id", at(0).alias("l0"), at(1).alias("l1"), at(2).alias("l2"))
    nothing = F.lit(None).cast("array<string>")
    items = [F.struct(F.lit(e).alias("evidence_id"), F.lit(p).cast("int").alias("page_id"), F.lit(b).cast("string").alias("block_id"), F.expr(q).cast("string").alias("quote"), nothing.alias("supports")) for e, p, b, q in _EVIDENCE]
    pred = F.concat(F.lit("Answer: "), F.to_json(F.struct(F.col("l0").alias("result"), F.array().cast("array<struct<claim_id:string,text:string>>").alias("claims"), F.array(*items).alias("evidence"))))
    predictions = docs.select(F.col("doc_id").alias("sample"), F.col("doc_id").alias("document_id"), pred.alias("pred"))
    unit = lambda n, i, p, b, t: F.struct(F.lit(n).alias("n_unit"), F.lit(i).alias("evidence_id"), F.lit("").alias("fact_id"), F.lit(p).alias("page_id"), F.lit(b).alias("block_id"), t.alias("text_excerpt"))
    units = docs.select(F.col("doc_id").alias("sample"), F.explode(F.array(unit(1, "", 2, "p2_b4", F.col("l0")), unit(2, "g2", 1, "p1_b2", F.substring("l2", 1, 30)))).alias("u")).select("sample", "u.*")
    texts = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("order_index", "text"))), lambda x: x.text), "\n")
    pages = blocks.groupBy("document_id", "page_id").agg(texts.alias("page_text"))
    return grounding.hard_evaluation(predictions, units, pages, blocks)


@register("grounded_evaluation", f"""WITH {_SQL}
    SELECT doc_id, n_evidence, round(citation_score, 6) AS citation_score, round(exact_rate, 6) AS exact_rate, round(page_only_rate, 6) AS page_only_rate, round(invalid_rate, 6) AS invalid_rate, labels,
      round(0.8 * (0.4 * citation_score + 0.4 * exact_rate + 0.2 * page_only_rate) + 0.2 * citation_score, 6)::DOUBLE AS grounded FROM g""")
def grounded_evaluation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Six citations of every document's own lines, checked in blocks, pages and gold units."""
    rows = _evaluated(spark, sf_dir)
    labels = F.array_join(F.transform("verified_evidence", lambda e: F.concat(e.validation_label, F.lit(":"), F.coalesce(e.matched_block_id, F.lit("-")))), ",")
    mix = grounded_mix(F.col("citation_score"), F.col("exact_rate"), F.col("page_only_rate"), F.col("citation_score"))
    rates = [F.round(c, 6).alias(c) for c in ("citation_score", "exact_rate", "page_only_rate", "invalid_rate")]
    return rows.select(F.col("sample").alias("doc_id"), "n_evidence", *rates, labels.alias("labels"), F.round(mix["grounded"], 6).alias("grounded"))


def _quoted(text: str) -> str:
    return text.replace("'", "''")


_REFINED = f"""'{grounded.REFINE_QUESTION}' || trim(l0) || chr(10) || chr(10) || '{grounded.REFINE_EVIDENCE}' || chr(10)
    || array_to_string(list_transform(list_filter(snippets, lambda s: s <> '')[1:3], lambda s, i: '[证据' || i || '] ' || s), chr(10)) || chr(10) || chr(10) || '{grounded.REFINE_ASK}'"""


@register("refine_prompts", f"""WITH {_SQL}
    SELECT doc_id, CASE WHEN citation_score > 0 AND len(list_filter(snippets, lambda s: s <> '')) > 0 THEN '{grounded.REFINE_SYSTEM}' END AS system_text,
      CASE WHEN citation_score > 0 AND len(list_filter(snippets, lambda s: s <> '')) > 0 THEN {_REFINED} END AS user_text FROM g JOIN src USING (doc_id)""")
def refine_prompts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The second question over each document's first three verified snippets."""
    rows = _evaluated(spark, sf_dir)
    first = F.coalesce(F.get(F.split(F.coalesce("text", F.lit("")), "\n"), 0), F.lit(""))
    asked = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("sample"), first.alias("question"))
    system, user = grounded.refine_prompt(F.col("question"), grounded.refine_snippets(F.col("verified_evidence")), F.col("citation_score"), F.lit("quote_extract"))
    return rows.join(asked, "sample").select(F.col("sample").alias("doc_id"), system.alias("system_text"), user.alias("user_text"))


@register("grounded_prompts", f"""SELECT item_id, phase, 'You are asked.' || chr(10) || chr(10) || CASE phase WHEN 'plan' THEN '{_quoted(grounded.GROUNDED_SYSTEM + grounded.PLAN_SYSTEM)}' ELSE '{_quoted(grounded.GROUNDED_SYSTEM + grounded.FINAL_SYSTEM)}' END AS system_text,
    trim(coalesce(text, '')) || chr(10) || chr(10) || CASE phase WHEN 'plan' THEN '{_quoted(grounded.PLAN_USER)}' ELSE '{_quoted(grounded.FINAL_USER)}' END AS user_text, CASE phase WHEN 'plan' THEN '{{"claims":' ELSE '{{"result":' END AS prefill
    FROM benchmark, (VALUES ('plan'), ('final')) p(phase)""")
def grounded_prompts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every item asked for cited evidence, in both phases."""
    items = table(spark, sf_dir, "benchmark")
    out = []
    for phase in ("plan", "final"):
        system, user = grounded.grounded_prompt(F.lit("You are asked."), F.col("text"), phase)
        out.append(items.select("item_id", F.lit(phase).alias("phase"), system.alias("system_text"), user.alias("user_text"), F.lit(grounded.prefill(phase)).alias("prefill")))
    return out[0].unionByName(out[1])


_PAYLOAD = """'{' || chr(10) || '  "query": ' || to_json(l0) || ',' || chr(10) || '  "context": null,' || chr(10) || '  "gold_result": ' || to_json(l1) || ',' || chr(10) || '  "gold_result_text": ' || to_json(l1) || ',' || chr(10)
    || '  "gold_atomic_facts": [' || chr(10) || '    {' || chr(10) || '      "fact_id": "f1",' || chr(10) || '      "text": ' || to_json(l2) || chr(10) || '    }' || chr(10) || '  ],' || chr(10)
    || '  "pred_result": null,' || chr(10) || '  "pred_result_text": null,' || chr(10) || '  "raw_prediction_text": null,' || chr(10) || '  "pred_claims": [],' || chr(10) || '  "verified_evidence": null,' || chr(10)
    || '  "invalid_evidence_summary": null' || chr(10) || '}'"""


@register("judge_messages", f"""WITH {_SQL} SELECT doc_id, md5('{grounded.JUDGE_USER}' || {_PAYLOAD}) AS user_md5 FROM src""")
def judge_messages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What a judge is shown of every document's first lines as question, answer and fact."""
    lines = F.split(F.coalesce("text", F.lit("")), "\n")
    at = lambda i: F.coalesce(F.get(lines, i), F.lit(""))
    facts = F.array(F.struct(F.lit("f1").alias("fact_id"), at(2).alias("text")))
    _, user = grounded.judge_messages({"query": at(0), "gold_result": at(1), "gold_result_text": at(1), "gold_atomic_facts": facts, "pred_claims": F.array().cast("array<string>")})
    return table(spark, sf_dir, "documents").select("doc_id", F.md5(user.cast("binary")).alias("user_md5"))


@register("sound_predictions", """SELECT conv_id, turn, json_extract_string(answer, '$.result') AS result, json_extract_string(answer, '$.evidence[0].quote') AS quote
    FROM (SELECT conv_id, turn, json_object('result', role, 'evidence', json_array(json_object('evidence_id', 'e1', 'quote', coalesce(text, '')))) AS answer FROM conversations)""")
def sound_predictions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Answers that are JSON after some words, read without a repair."""
    one = F.struct(F.lit("e1").alias("evidence_id"), F.coalesce("text", F.lit("")).alias("quote"))
    answer = F.concat(F.lit("Well: "), F.to_json(F.struct(F.col("role").alias("result"), F.array(one).alias("evidence"))))
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", answer.alias("pred"))
    read = F.from_json(grounding.sound_json("pred"), grounding.PREDICTION)
    return rows.withColumn("p", read).select("conv_id", "turn", F.col("p.result").alias("result"), F.col("p.evidence")[0]["quote"].alias("quote"))
