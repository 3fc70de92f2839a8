"""Answer scoring and text normalisation queries."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from folioscope.functions import scoring
from folioscope.functions.text import abstains, choice_letter, final_answer, normalize_answer, normalize_leak, normalize_quote, repair_spacing
from folioscope.operators import meetings
from folioscope.plans import retrieval as R
from folioscope.plans import surrogates as S
from folioscope.plans.registry import register
from folioscope.session import table

_P, _A = S.sql_normalize("pred"), S.sql_normalize("a")


@register("answer_scores", f"""WITH {S.SQL_ANSWERS}, n AS (SELECT sample, {_P} AS p, list_transform(answers, lambda a: {_A}) AS g FROM answers),
    f AS (SELECT *, try_cast(p AS DOUBLE) AS v FROM n)
    SELECT sample, CASE WHEN p = '' THEN 0 ELSE least(1, len(list_filter(g, lambda x: x = p)) / 2::DOUBLE) END::DOUBLE AS soft, list_contains(g, p)::INT::DOUBLE AS exact,
      CASE WHEN v IS NULL THEN list_contains(g, p)::INT::DOUBLE ELSE (len(list_filter(g, lambda x: coalesce(abs(v - try_cast(x AS DOUBLE)) <= greatest(1e-4, 0.01 * greatest(1, abs(try_cast(x AS DOUBLE)))), false))) > 0)::INT::DOUBLE END AS relaxed FROM f""")
def answer_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    p, a = F.col("pred"), F.col("answers")
    return S.answers(spark, sf_dir).select("sample", scoring.soft_accuracy(p, a).alias("soft"), scoring.exact_match(p, a).alias("exact"), scoring.relaxed_numeric(p, a).alias("relaxed"))


@register("anls")
def anls(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Over whole texts; DuckDB's edit distance counts bytes, so the tests compare with a plain one by characters."""
    return S.answers(spark, sf_dir).select("sample", F.round(scoring.anls(F.col("pred"), F.col("answers")), 6).alias("anls"))


@register("normalized_answers", f"SELECT item_id, {S.sql_normalize('text')} AS answer, nullif(upper(regexp_extract(trim(text), '(?i)\\b([A-E])\\b', 1)), '') AS choice FROM benchmark")
def normalized_answers(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = F.col("text")
    return table(spark, sf_dir, "benchmark").select("item_id", normalize_answer(t).alias("answer"), choice_letter(t).alias("choice"))


@register("verdicts", r"""WITH v AS (SELECT event_id, CASE event_id % 4 WHEN 0 THEN '{"verdict": "Correct", "reason": "ok"}' WHEN 1 THEN '{"verdict": "partial", "reason": "a \c b"}' WHEN 2 THEN 'verdict: incorrect' ELSE 'unreadable' END AS t FROM events)
    SELECT CASE event_id % 4 WHEN 0 THEN 'correct' WHEN 1 THEN 'partial' WHEN 2 THEN 'incorrect' ELSE 'error' END AS verdict, count(*) AS n, sum(CASE event_id % 4 WHEN 0 THEN 1.0 WHEN 1 THEN 0.5 ELSE 0 END)::DOUBLE AS total FROM v GROUP BY ALL""")
def verdicts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Grader answers of four kinds parsed and counted."""
    kinds = ['{"verdict": "Correct", "reason": "ok"}', r'{"verdict": "partial", "reason": "a \c b"}', "verdict: incorrect", "unreadable"]
    text = F.element_at(F.array(*[F.lit(k) for k in kinds]), (F.pmod("event_id", F.lit(4)) + 1).cast("int"))
    parsed = table(spark, sf_dir, "events").select(scoring.parse_verdict(text).alias("v"))
    return parsed.groupBy(F.coalesce("v.verdict", F.lit("error")).alias("verdict")).agg(F.count("*").alias("n"), F.sum(F.coalesce("v.score", F.lit(0.0))).alias("total"))


@register("judge_mix", """WITH s AS (SELECT doc_id, (doc_id % 5) / 4::DOUBLE AS a, (doc_id % 3) / 2::DOUBLE AS b, (doc_id % 2)::DOUBLE AS c, (doc_id % 4) / 3::DOUBLE AS d FROM documents)
    SELECT doc_id, round(0.4 * a + 0.4 * b + 0.2 * c, 6)::DOUBLE AS judge, round(0.2 * d + 0.8 * (0.4 * a + 0.4 * b + 0.2 * c), 6)::DOUBLE AS grounded, least(a, b, c, d) >= 1 AS strict,
      CASE WHEN d < 0.125 THEN 0 WHEN d <= 0.375 THEN 0.25 WHEN d <= 0.625 THEN 0.5 WHEN d <= 0.875 THEN 0.75 ELSE 1 END::DOUBLE AS snapped FROM s""")
def judge_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    part = lambda n: F.pmod("doc_id", F.lit(n)) / float(n - 1)
    mix = scoring.grounded_mix(part(5), part(3), part(2), part(4))
    return table(spark, sf_dir, "documents").select("doc_id", mix.alias("m"), scoring.snap(part(4)).alias("snapped")).select(
        "doc_id", F.round("m.judge", 6).alias("judge"), F.round("m.grounded", 6).alias("grounded"), "m.strict", "snapped")


@register("token_coverage", f"""WITH {R._SCORES}, nq AS (SELECT qid, sum(q_tf) AS need FROM q GROUP BY qid)
    SELECT doc_id, qid AS item_id, round(sum(least(q_tf, tf)) / max(need)::DOUBLE, 6) AS coverage FROM q JOIN d USING (token) JOIN nq USING (qid) GROUP BY ALL""")
def coverage(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Multiset coverage of an item's tokens by every document that has one of them."""
    asked = S.questions(spark, sf_dir)
    need = asked.groupBy("qid").agg(F.sum("q_tf").alias("need"))
    hits = meetings.meet(table(spark, sf_dir, "documents").select("doc_id", "text"), "doc_id", asked)
    return hits.join(F.broadcast(need), "qid").select("doc_id", F.col("qid").alias("item_id"), F.round(F.col("shared") / F.col("need").cast("double"), 6).alias("coverage"))


@register("abstentions", """WITH t AS (SELECT conv_id, turn, lower(trim(coalesce(text, ''))) AS t FROM conversations)
    SELECT conv_id, turn, t IN ('', 'none', 'n/a') OR regexp_matches(t, 'not answerable|no information|does not (contain|provide|mention|include)|cannot be (determined|answered|found)|not (provided|mentioned|available|specified|stated)|unable to (determine|answer|find)|isn''t (any )?information|there is no') AS abstains FROM t""")
def abstentions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "conversations").select("conv_id", "turn", abstains(F.col("text")).alias("abstains"))


@register("repaired_text")
def repaired(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Normal forms that need look-around or NFKC, so have no SQL twin."""
    t = F.col("text")
    return table(spark, sf_dir, "benchmark").select("item_id", repair_spacing(t).alias("repaired"), normalize_leak(t).alias("leak_form"), normalize_quote(t).alias("quote_form"), final_answer(t).alias("final"))
