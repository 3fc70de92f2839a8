"""Selection, packing and shard-merging queries."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from folioscope.functions.text import packed_length
from folioscope.operators import selection, sets
from folioscope.plans import retrieval as R
from folioscope.plans import surrogates as S
from folioscope.plans.registry import register
from folioscope.session import table

_HASH = "('0x' || substr(sha256(concat_ws(chr(31), doc_id, page_id, block_id, order_index)), 1, 16))::UBIGINT::DOUBLE / 18446744073709551616::DOUBLE"
_LINE = "replace(trim(text), chr(10), ' ')"
_LEN = f"CASE WHEN length({_LINE}) > 300 THEN length(rtrim(substr({_LINE}, 1, 300))) + 3 ELSE length({_LINE}) END"


@register("select_random", f"""WITH {S.SQL_BLOCKS}, r AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY {_HASH} DESC, page_id, block_id) AS rank FROM blocks)
    SELECT doc_id, page_id, block_id, {_HASH} AS sel_score FROM r WHERE rank <= 3""")
def select_random(spark: SparkSession, sf_dir: str) -> DataFrame:
    return selection.select_memory(S.blocks(spark, sf_dir), "doc_id", "random", 3).select("doc_id", "page_id", "block_id", "sel_score")


@register("select_random_chars", f"""WITH {S.SQL_BLOCKS}, s AS (SELECT *, {_HASH} AS h FROM blocks),
    r AS (SELECT *, coalesce(sum({_LEN}) OVER (PARTITION BY doc_id ORDER BY h DESC, page_id, block_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM s)
    SELECT doc_id, count(*) AS n_blocks, sum({_LEN})::BIGINT AS chars FROM r WHERE before < 400 GROUP BY doc_id""")
def select_random_chars(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = S.blocks(spark, sf_dir).withColumn("budget", F.lit(400))
    picked = selection.select_memory(rows, "doc_id", "random_chars", budget="budget", cap=300)
    return picked.groupBy("doc_id").agg(F.count("*").alias("n_blocks"), F.sum(packed_length(F.col("text"), 300)).cast("long").alias("chars"))


@register("packed_quantiles", f"""WITH {S.SQL_BLOCKS}, l AS (SELECT doc_id, sum({_LEN})::BIGINT AS chars FROM blocks GROUP BY doc_id), a AS (SELECT list(chars ORDER BY chars) AS c, count(*) AS n, avg(chars) AS m FROM l)
    SELECT n, round(m, 6) AS mean, c[floor(0.1 * n)::INT + 1] AS p10, c[floor(0.5 * n)::INT + 1] AS p50, c[floor(0.9 * n)::INT + 1] AS p90 FROM a""")
def packed_quantiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Order statistics at floor(q * n), found by rank over counted values rather than by collecting them."""
    per = S.blocks(spark, sf_dir).groupBy("doc_id").agg(F.sum(packed_length(F.col("text"), 300)).cast("long").alias("chars"))
    counted = per.groupBy("chars").agg(F.count("*").alias("m"))
    # Prefix sums in two levels: within ranges of a thousand characters, and over the ranges' totals.
    from pyspark.sql import Window

    ranged = counted.withColumn("range", F.floor(F.col("chars") / 1000))
    bases = ranged.groupBy("range").agg(F.sum("m").alias("held"))
    bases = bases.select("range", (F.sum("held").over(Window.orderBy("range")) - F.col("held")).alias("base"))
    upto = ranged.withColumn("own", F.sum("m").over(Window.partitionBy("range").orderBy("chars"))).join(bases, "range").withColumn("upto", F.col("base") + F.col("own"))
    total = per.agg(F.count("*").alias("n"), F.round(F.avg("chars"), 6).alias("mean"))
    at = lambda q: F.min(F.when(F.col("upto") > F.floor(F.lit(q) * F.col("n")), F.col("chars")))
    return upto.crossJoin(F.broadcast(total)).groupBy("n", "mean").agg(at(0.1).alias("p10"), at(0.5).alias("p50"), at(0.9).alias("p90"))


@register("lexical_memory", f"""WITH {R._CANDIDATES}, src2 AS (SELECT qid, doc_id, rank - 1 AS doc_rank FROM r WHERE rank <= 4),
    o AS (SELECT cs.*, page_id, order_index, text, (doc_rank * 100000 + page_id) AS page_rank, round(score, 6) AS ls FROM cs JOIN c USING (qid, doc_id, block_id) JOIN src2 USING (qid, doc_id)),
    k AS (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY ls DESC, page_rank, order_index) AS rn FROM o)
    SELECT qid, count(*) AS num_facts, string_agg('[第' || page_id || '页] ' || CASE WHEN length({_LINE}) > 300 THEN rtrim(substr({_LINE}, 1, 300)) || '...' ELSE {_LINE} END, chr(10) ORDER BY page_rank, ls DESC, order_index) AS memory
    FROM k WHERE rn <= 8 AND trim(text) <> '' GROUP BY qid""")
def lexical_memory(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each item's eight best blocks packed to text, by page position then score."""
    found, terms = R.candidates(spark, sf_dir)
    rows = R.candidate_scores(spark, sf_dir, found, terms).join(found, ["qid", "doc_id", "block_id"])
    rows = rows.withColumn("page_rank", F.col("doc_rank") * 100000 + F.col("page_id")).withColumn("lexical_score", F.round("score", 6))
    return selection.pack(selection.lexical_selection(rows, "qid", 8), "qid", 300).select("qid", "num_facts", "memory")


@register("ratio_kept", f"""WITH {S.SQL_BLOCKS}, r AS (SELECT doc_id, block_id, row_number() OVER (PARTITION BY doc_id ORDER BY length(text) DESC, order_index) AS kept_rank, count(*) OVER (PARTITION BY doc_id) AS n FROM blocks)
    SELECT doc_id, block_id, kept_rank, greatest(2, floor(n * 0.15)::BIGINT) AS keep_n FROM r WHERE kept_rank <= greatest(2, floor(n * 0.15)::BIGINT)""")
def ratio_kept(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = S.blocks(spark, sf_dir).select("doc_id", "block_id", "order_index", F.length("text").alias("chars"))
    return selection.keep_ratio(rows, ["doc_id"], "chars", ["order_index"], 0.15, 2).select("doc_id", "block_id", "kept_rank", "keep_n")


_SHARDS = "s AS (SELECT user_id AS id, event_id % 4 AS shard, event_id, value FROM events)"


@register("merged_first", f"WITH {_SHARDS} SELECT id, event_id, shard FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY shard, event_id) AS rn FROM s) WHERE rn = 1")
def merged_first(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Four shards with repeats, merged keep-first by (shard, line)."""
    e = table(spark, sf_dir, "events").select(F.col("user_id").alias("id"), "event_id")
    shards = [e.where(F.pmod("event_id", F.lit(4)) == k) for k in range(4)]
    return sets.deduplicate(sets.union_shards(shards), "id", ["shard", "event_id"]).select("id", "event_id", F.col("shard").cast("long").alias("shard"))


@register("merged_last", f"WITH {_SHARDS} SELECT id, event_id FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY shard DESC, event_id DESC) AS rn FROM s) WHERE rn = 1")
def merged_last(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events").select(F.col("user_id").alias("id"), "event_id", F.pmod("event_id", F.lit(4)).alias("shard"))
    return sets.deduplicate(e, "id", ["shard", "event_id"], "last").select("id", "event_id")


@register("missing_extra", """SELECT coalesce(a.doc_id, b.doc_id) AS doc_id, CASE WHEN b.doc_id IS NULL THEN 'missing' ELSE 'extra' END AS side
    FROM (SELECT doc_id FROM documents) a FULL JOIN (SELECT doc_id FROM labels UNION ALL SELECT -1) b ON a.doc_id = b.doc_id WHERE a.doc_id IS NULL OR b.doc_id IS NULL""")
def missing_extra(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "labels").select("doc_id").unionByName(spark.range(1).select((F.col("id") - 1).alias("doc_id")))
    return sets.missing_and_extra(table(spark, sf_dir, "documents"), rows, "doc_id")


@register("exclusion_reasons", """SELECT CASE WHEN l.doc_id IS NULL THEN 'unlabelled' WHEN n_chars < 400 THEN 'short' WHEN toxic = 1 THEN 'toxic' WHEN quality = 0 THEN 'poor' ELSE 'eligible' END AS reason, count(*) AS n
    FROM documents d LEFT JOIN labels l USING (doc_id) GROUP BY ALL""")
def exclusion_reasons(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "documents").join(table(spark, sf_dir, "labels"), "doc_id", "left")
    why = sets.first_reason(("unlabelled", F.col("quality").isNull()), ("short", F.col("n_chars") < 400), ("toxic", F.col("toxic") == 1), ("poor", F.col("quality") == 0))
    return rows.groupBy(F.coalesce(why, F.lit("eligible")).alias("reason")).agg(F.count("*").alias("n"))


@register("patched_verdicts", """SELECT event_id, CASE WHEN (value < 10 OR value IS NULL) AND event_id % 2 = 0 THEN value + 1000 ELSE value END AS value FROM events""")
def patched(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bad rows replaced by a second run's good ones."""
    e = table(spark, sf_dir, "events").select("event_id", "value")
    fixes = e.where("event_id % 2 = 0").withColumn("value", F.col("value") + 1000)
    return sets.patch(e, fixes, "event_id", "value", F.col("value") < 10, F.col("fix").isNotNull()).select("event_id", "value")


@register("event_props", """SELECT event_type, count(*) AS n, count(try_cast(json_extract_string(props, '$.k') AS BIGINT)) AS with_k FROM events GROUP BY event_type""")
def event_props(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.get_json_object("props", "$.k").try_cast("long")
    return table(spark, sf_dir, "events").groupBy("event_type").agg(F.count("*").alias("n"), F.count(k).alias("with_k"))
