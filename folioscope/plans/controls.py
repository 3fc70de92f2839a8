"""Control-experiment queries."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from folioscope.operators import controls
from folioscope.plans import surrogates as S
from folioscope.plans.registry import register
from folioscope.session import table

_PAGES = "sequence AS (SELECT doc_id, range(doc_id % 7 + 1, doc_id % 7 + 17) AS top, [doc_id % 7 + 2, doc_id % 7 + 5] AS gold, [40, 30, 50] AS spare FROM documents)"


@register("degraded_rankings", f"""WITH {_PAGES}, j AS (SELECT *, unnest([0, 1, 2]) AS j FROM sequence)
    SELECT doc_id, j::BIGINT AS j, array_to_string(list_concat(list_filter(top, lambda p: NOT list_contains(list_slice(list_sort(gold), 1, j), p)), list_slice(list_sort(spare), 1, j)), ',') AS ranking FROM j""")
def degraded(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Recall lowered by j gold pages at a constant page budget."""
    m = F.pmod("doc_id", F.lit(7))
    rows = table(spark, sf_dir, "documents").select(
        "doc_id", F.sequence(m + 1, m + 16).alias("top"), F.array(m + 2, m + 5).alias("gold"), F.array(*[F.lit(x).cast("long") for x in (40, 30, 50)]).alias("spare"),
        F.explode(F.array(F.lit(0), F.lit(1), F.lit(2))).alias("j"),
    )
    new = controls.degrade_ranking(F.col("top"), F.col("gold"), F.col("spare"), F.col("j"))
    return rows.select("doc_id", F.col("j").cast("long").alias("j"), F.array_join(new.cast("array<string>"), ",").alias("ranking"))


@register("derangement", """WITH s AS (SELECT source, count(*) AS size FROM documents GROUP BY source), t AS (SELECT sum(size)::BIGINT AS n, max(size) AS shift FROM s),
    p AS (SELECT doc_id, source, row_number() OVER (ORDER BY source, doc_id) - 1 AS place FROM documents)
    SELECT a.doc_id, b.doc_id AS donor, a.source = b.source AS same_family FROM p a, t JOIN p b ON b.place = (a.place + t.shift) % t.n""")
def derangement(spark: SparkSession, sf_dir: str) -> DataFrame:
    return controls.derangement(table(spark, sf_dir, "documents"), "doc_id", "source")


@register("leakage", """WITH a AS (SELECT item_id, lower(text) AS packed, [lower(list_extract(string_split(text, ' '), 2)), lower(list_extract(string_split(text, ' '), 4)) || '#'] AS answers FROM benchmark), k AS (SELECT *, unnest([3, 5, 7, 9]) AS least FROM a)
    SELECT least::BIGINT AS least, count(*) AS n, count(*) FILTER (len(list_filter(answers, lambda x: length(x) >= least AND contains(packed, x))) > 0) AS leaked FROM k GROUP BY least""")
def leakage(spark: SparkSession, sf_dir: str) -> DataFrame:
    word = lambda i: F.lower(F.try_element_at(F.split("text", " "), F.lit(i)))
    rows = table(spark, sf_dir, "benchmark").select(F.lower("text").alias("packed"), F.array(word(2), F.concat(word(4), F.lit("#"))).alias("answers"))
    cases = rows.withColumn("least", F.explode(F.array(*[F.lit(k).cast("long") for k in (3, 5, 7, 9)])))
    return cases.groupBy("least").agg(F.count("*").alias("n"), F.count_if(controls.leaked(F.col("packed"), F.col("answers"), F.col("least"))).alias("leaked"))


@register("dose_response", f"""WITH {S.SQL_ARMS}, b AS (SELECT CASE WHEN n_chars < 500 THEN 0 WHEN n_chars < 1000 THEN 1 WHEN n_chars < 2000 THEN 2 WHEN n_chars < 5000 THEN 3 ELSE 4 END::BIGINT AS bin, base, arm FROM arms)
    SELECT bin, count(*) AS n, round(avg(base::INT), 6) AS base_rate, round(avg(arm::INT), 6) AS arm_rate, round(avg(arm::INT - base::INT), 6) AS delta FROM b GROUP BY ROLLUP (bin)""")
def dose_response(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = S.arms(spark, sf_dir).withColumn("bin", controls.bins(F.col("n_chars"), (0, 500, 1000, 2000, 5000)))
    rate = lambda c: F.avg(F.col(c).cast("int"))
    return rows.rollup("bin").agg(F.count("*").alias("n"), F.round(rate("base"), 6).alias("base_rate"), F.round(rate("arm"), 6).alias("arm_rate"), F.round(F.avg(F.col("arm").cast("int") - F.col("base").cast("int")), 6).alias("delta"))


@register("store_fidelity", f"""WITH {S.SQL_BLOCKS}, p AS (SELECT doc_id, page_id, count(*) AS blocks, sum(length(text)) AS chars FROM blocks GROUP BY ALL)
    SELECT (SELECT count(*) FROM p) AS n_pages, round((SELECT avg(blocks) FROM p), 6) AS blocks_per_page, round((SELECT avg(chars) FROM p), 6) AS chars_per_page,
      round((SELECT avg(length(text)) FROM blocks), 6) AS mean_chars, (SELECT median(length(text)) FROM blocks)::DOUBLE AS median_chars""")
def store_fidelity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Block-budget figures of a document store."""
    b = S.blocks(spark, sf_dir).withColumn("chars", F.length("text"))
    pages = b.groupBy("doc_id", "page_id").agg(F.count("*").alias("blocks"), F.sum("chars").alias("chars"))
    per_page = pages.agg(F.count("*").alias("n_pages"), F.round(F.avg("blocks"), 6).alias("blocks_per_page"), F.round(F.avg("chars"), 6).alias("chars_per_page"))
    return per_page.crossJoin(b.agg(F.round(F.avg("chars"), 6).alias("mean_chars"), F.median("chars").alias("median_chars")))
