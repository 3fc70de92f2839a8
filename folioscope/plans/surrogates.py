"""Stand-ins for the evaluation's entities over the test tables, in Spark and in SQL.

A question is a benchmark item; a document's lines are its blocks, four to a
page; boxes are whole-number functions of document and line number.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from folioscope.functions.text import BLOCK_STOP, PAGE_STOP
from folioscope.operators.retrieval import term_counts
from folioscope.session import table


def sql_tokens(column: str, profile: str = "block") -> str:
    found = f"regexp_extract_all(lower(coalesce({column}, '')), '[A-Za-z0-9]+')"
    stop = {"block": BLOCK_STOP, "page": PAGE_STOP}.get(profile)
    if stop is None:
        return found
    words = ", ".join(f"'{w}'" for w in stop)
    longer = " AND length(t) >= 2" if profile == "page" else ""
    return f"list_filter({found}, lambda t: t NOT IN ({words}){longer})"


def sql_normalize(column: str) -> str:
    words = rf"string_split(trim(regexp_replace(regexp_replace(lower({column}), '[!-/:-@\[-`{{-~]', ' ', 'g'), '\s+', ' ', 'g')), ' ')"
    return f"array_to_string(list_filter({words}, lambda w: w NOT IN ('a', 'an', 'the', '')), ' ')"


def questions(spark: SparkSession, sf_dir: str, profile: str = "block") -> DataFrame:
    """(qid, token, q_tf)"""
    items = table(spark, sf_dir, "benchmark").withColumnRenamed("item_id", "qid")
    return term_counts(items, ["qid"], F.col("text"), profile).withColumnRenamed("tf", "q_tf")


def blocks(spark: SparkSession, sf_dir: str, only: DataFrame | None = None) -> DataFrame:
    """doc_id, page_id, block_id, order_index, text, x0, y0, x1, y1, page_w, page_h; with ``only`` (doc_id) of these documents."""
    docs = table(spark, sf_dir, "documents")
    if only is not None:
        docs = docs.join(only, "doc_id", "left_semi")
    lines = docs.select("doc_id", F.posexplode(F.split(F.coalesce("text", F.lit("")), "\n")).alias("n", "text"))
    n, d = F.col("n").cast("long"), F.col("doc_id")
    page = F.floor(n / 4).cast("long") + 1
    x0, y0 = F.pmod(d * 7 + n * 13, F.lit(120)), F.pmod(n, F.lit(4)) * 70 + F.pmod(d, F.lit(20))
    return lines.select(
        "doc_id", page.alias("page_id"), F.concat(F.lit("p"), page.cast("string"), F.lit("_b"), n.cast("string")).alias("block_id"), n.alias("order_index"), "text",
        x0.cast("double").alias("x0"), y0.cast("double").alias("y0"), (x0 + F.pmod(n * 31, F.lit(90))).cast("double").alias("x1"), (y0 + 10 + F.pmod(n, F.lit(40))).cast("double").alias("y1"),
        F.lit(200.0).alias("page_w"), F.lit(300.0).alias("page_h"),
    )


SQL_BLOCKS = """
lines AS (SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS text, generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) - 1 AS n FROM documents),
blocks AS (
  SELECT doc_id, n // 4 + 1 AS page_id, 'p' || (n // 4 + 1) || '_b' || n AS block_id, n AS order_index, text,
    ((doc_id * 7 + n * 13) % 120)::DOUBLE AS x0, ((n % 4) * 70 + doc_id % 20)::DOUBLE AS y0,
    ((doc_id * 7 + n * 13) % 120 + (n * 31) % 90)::DOUBLE AS x1, ((n % 4) * 70 + doc_id % 20 + 10 + n % 40)::DOUBLE AS y1, 200.0::DOUBLE AS page_w, 300.0::DOUBLE AS page_h
  FROM lines
)
"""


def arms(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, base, arm (two paired binary verdicts), lang, source"""
    labels = table(spark, sf_dir, "labels").select("doc_id", (F.col("quality") == 1).alias("base"), (F.col("toxic") == 0).alias("arm"))
    return labels.join(table(spark, sf_dir, "documents").select("doc_id", "lang", "source", "n_chars"), "doc_id")


SQL_ARMS = "arms AS (SELECT doc_id, quality = 1 AS base, toxic = 0 AS arm, lang, source, n_chars FROM labels JOIN documents USING (doc_id))"


def answers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """sample, pred, answers: a user turn is the prediction, the reply and the turn itself (every third time) the answers."""
    t = table(spark, sf_dir, "conversations").select("conv_id", "turn", "text")
    nxt = t.select("conv_id", (F.col("turn") - 1).alias("turn"), F.col("text").alias("reply"))
    joined = t.join(nxt, ["conv_id", "turn"])
    own = F.when(F.pmod(F.col("conv_id") + F.col("turn"), F.lit(3)) == 0, F.col("text")).otherwise(F.lit("17.5"))
    return joined.select(F.concat_ws("-", "conv_id", "turn").alias("sample"), F.coalesce("text", F.lit("")).alias("pred"), F.array(F.coalesce("reply", F.lit("")), F.coalesce(own, F.lit(""))).alias("answers"))


SQL_ANSWERS = """
answers AS (
  SELECT a.conv_id || '-' || a.turn AS sample, coalesce(a.text, '') AS pred,
    [coalesce(b.text, ''), coalesce(CASE WHEN (a.conv_id + a.turn) % 3 = 0 THEN a.text ELSE '17.5' END, '')] AS answers
  FROM conversations a JOIN conversations b ON a.conv_id = b.conv_id AND a.turn = b.turn - 1
)
"""
