"""Queries over the smaller operators: casts, selections, prompts, pooling, citations."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from folioscope.functions import prompts as P
from folioscope.functions.text import contains_quote, packed_text
from folioscope.operators import controls, grounding, losses, retrieval, selection, sets
from folioscope.plans import retrieval as R
from folioscope.plans import surrogates as S
from folioscope.plans.registry import register
from folioscope.session import table
from folioscope.sources import readers


@register("tolerant_casts", """WITH e AS (SELECT event_id, CASE event_id % 4 WHEN 0 THEN (event_id % 5 - 1)::VARCHAR WHEN 1 THEN (event_id % 9)::VARCHAR || '.7' WHEN 2 THEN 'page' ELSE ' 12 ' END AS c FROM events)
    SELECT event_id, CASE WHEN regexp_full_match(trim(c), '[+-]?[0-9]+') AND trim(c)::INT >= 1 THEN trim(c)::INT END AS page FROM e""")
def tolerant_casts(spark: SparkSession, sf_dir: str) -> DataFrame:
    e, m = F.col("event_id"), F.pmod("event_id", F.lit(4))
    c = F.when(m == 0, (F.pmod(e, F.lit(5)) - 1).cast("string")).when(m == 1, F.concat(F.pmod(e, F.lit(9)).cast("string"), F.lit(".7"))).when(m == 2, "page").otherwise(" 12 ")
    return table(spark, sf_dir, "events").select("event_id", readers.page_number(c).alias("page"))


@register("parsed_ids", r"""WITH d AS (SELECT doc_id, 'doc' || doc_id || CASE WHEN doc_id % 3 > 0 THEN ':' || (doc_id % 7) || '-' || (doc_id % 5 + 3) ELSE '' END AS s, CASE WHEN doc_id % 2 = 0 THEN 'page_00' || (doc_id % 50) || '.png' WHEN doc_id % 5 = 0 THEN 'x_12.pdf' ELSE 'scan_' || (doc_id % 9) || '.JpeG' END AS f FROM documents)
    SELECT doc_id, CASE WHEN doc_id % 3 > 0 AND doc_id % 5 + 3 >= doc_id % 7 THEN array_to_string(range(doc_id % 7, doc_id % 5 + 4), ',') END AS pages, try_cast(regexp_extract(f, '_([0-9]+)\.(jpg|jpeg|png)$', 1, 'i') AS INT) AS page FROM d""")
def parsed_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = lambda n: F.pmod("doc_id", F.lit(n))
    text = lambda *parts: F.concat(*[p if hasattr(p, "cast") else F.lit(p) for p in parts])
    sample = text("doc", F.col("doc_id").cast("string"), F.when(m(3) > 0, text(":", m(7).cast("string"), "-", (m(5) + 3).cast("string"))).otherwise(""))
    file = F.when(m(2) == 0, text("page_00", m(50).cast("string"), ".png")).when(m(5) == 0, "x_12.pdf").otherwise(text("scan_", m(9).cast("string"), ".JpeG"))
    return table(spark, sf_dir, "documents").select("doc_id", F.array_join(readers.page_range(sample).cast("array<string>"), ",").alias("pages"), readers.image_page(file).alias("page"))


_PAGES = "p AS (SELECT doc_id, range(1, doc_id % 6 + 4) AS pages, [doc_id % 4 + 1, 3] AS gold, [doc_id % 9, doc_id % 4 + 1, doc_id % 9, 2] AS ranked FROM documents)"


def _pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = lambda n: F.pmod("doc_id", F.lit(n))
    return table(spark, sf_dir, "documents").select(
        "doc_id", F.sequence(F.lit(1).cast("long"), m(6) + 3).alias("pages"), F.array(m(4) + 1, F.lit(3).cast("long")).alias("gold"), F.array(m(9), m(4) + 1, m(9), F.lit(2).cast("long")).alias("ranked")
    )


def _joined(c):
    return F.array_join(c.cast("array<string>"), ",")


@register("baseline_rankings", f"""WITH {_PAGES} SELECT doc_id, array_to_string(pages, ',') AS first, array_to_string(list_concat(list_filter(pages, lambda x: list_contains(gold, x)), list_filter(pages, lambda x: NOT list_contains(gold, x))), ',') AS oracle,
    (SELECT string_agg(x, ',' ORDER BY sha256('7:' || x)) FROM (SELECT unnest(pages) AS x)) AS random FROM p""")
def baseline_rankings(spark: SparkSession, sf_dir: str) -> DataFrame:
    order = lambda kind: _joined(retrieval.baseline_order(kind, F.col("pages"), F.col("gold"), "7")).alias(kind)
    return _pages(spark, sf_dir).select("doc_id", order("first"), order("oracle"), order("random"))


@register("external_selection", f"""WITH {_PAGES}, f AS (SELECT doc_id, pages, list_filter([ranked[1], ranked[2], ranked[4]], lambda x, i: list_contains(pages, x) AND NOT list_contains(list_slice([ranked[1], ranked[2], ranked[4]], 1, i - 1), x)) AS found FROM p)
    SELECT doc_id, array_to_string(CASE WHEN len(found) > 0 THEN list_slice(found, 1, 2) ELSE list_slice(pages, 1, 3) END, ',') AS selected FROM f""")
def external_selection(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _pages(spark, sf_dir).select("doc_id", _joined(retrieval.select_pages(F.col("ranked"), F.col("pages"), 2, 3)).alias("selected"))


@register("union_selection", f"""WITH {S.SQL_BLOCKS}, r AS (SELECT doc_id, page_id, block_id, row_number() OVER (PARTITION BY doc_id ORDER BY length(text) DESC, order_index) AS a, row_number() OVER (PARTITION BY doc_id ORDER BY order_index) AS b FROM blocks)
    SELECT doc_id, block_id, CASE WHEN a <= 2 THEN 0 ELSE 1 END AS arm, CASE WHEN a <= 2 THEN a ELSE b END AS rank FROM r WHERE a <= 2 OR b <= 2""")
def union_selection(spark: SparkSession, sf_dir: str) -> DataFrame:
    blocks = S.blocks(spark, sf_dir)
    one = retrieval.top_k(blocks, ["doc_id"], [F.length("text").desc(), F.col("order_index")], 2)
    two = retrieval.top_k(blocks, ["doc_id"], [F.col("order_index")], 2)
    return selection.union_selection(one, two, "doc_id", 2).select("doc_id", "block_id", "arm", "rank")


@register("page_memory", f"""WITH {S.SQL_BLOCKS}, k AS (SELECT doc_id, page_id, string_agg(replace(trim(text), chr(10), ' '), ' / ' ORDER BY order_index) AS line, min(order_index) AS pos FROM blocks WHERE trim(text) <> '' GROUP BY ALL)
    SELECT doc_id, count(*) AS n_pages, string_agg('[p' || page_id || '] ' || line, chr(10) ORDER BY pos) AS memory FROM k GROUP BY doc_id""")
def page_memory(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Facts grouped by page in first-seen order."""
    rows = S.blocks(spark, sf_dir).where(F.trim("text") != "")
    page = rows.groupBy("doc_id", "page_id").agg(F.min("order_index").alias("at"), F.array_sort(F.collect_list(F.struct("order_index", packed_text(F.col("text"), 0).alias("t")))).alias("f"))
    line = F.concat(F.lit("[p"), F.col("page_id").cast("string"), F.lit("] "), F.array_join(F.transform("f", lambda x: x.t), " / "))
    held = page.groupBy("doc_id").agg(F.count("*").alias("n_pages"), F.array_sort(F.collect_list(F.struct("at", line.alias("line")))).alias("l"))
    return held.select("doc_id", "n_pages", F.array_join(F.transform("l", lambda x: x.line), "\n").alias("memory"))


@register("prompts", f"""SELECT item_id, CASE WHEN item_id % 3 = 0 THEN text ELSE '{P.TEXT_HEAD["keyword"]}{P.ANSWER_TAIL}' || chr(10) || 'note ' || item_id || chr(10) || chr(10) || text END AS prompt,
    '{P.RERANK_HEAD}' || chr(10) || chr(10) || '问题：' || chr(10) || text || chr(10) || chr(10) || '候选证据块文本：' || chr(10) || CASE WHEN item_id % 3 = 0 THEN '（无文本）' ELSE 'note ' || item_id END AS rerank FROM benchmark""")
def prompts(spark: SparkSession, sf_dir: str) -> DataFrame:
    memory = F.when(F.pmod("item_id", F.lit(3)) == 0, " ").otherwise(F.concat(F.lit("note "), F.col("item_id").cast("string")))
    return table(spark, sf_dir, "benchmark").select("item_id", P.mode_prompt(F.col("text"), memory, "pages_memory").alias("prompt"), P.rerank_prompt(F.col("text"), memory).alias("rerank"))


@register("group_context", f"""WITH {S.SQL_BLOCKS}, r AS (SELECT doc_id, block_id, ln(1 + length(text))::DOUBLE AS s FROM blocks), m AS (SELECT *, avg(s) OVER w AS mean_score, max(s) OVER w AS max_score FROM r WINDOW w AS (PARTITION BY doc_id))
    SELECT doc_id, block_id, round(mean_score, 6) AS mean_score, round(max_score, 6) AS max_score, round(exp(s - max_score) / sum(exp(s - max_score)) OVER (PARTITION BY doc_id), 6) AS softmax FROM m""")
def group_context(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = losses.in_group_context(S.blocks(spark, sf_dir).select("doc_id", "block_id", F.log1p(F.length("text").cast("double")).alias("s")), ["doc_id"], "s")
    return rows.select("doc_id", "block_id", *[F.round(c, 6).alias(c) for c in ("mean_score", "max_score", "softmax")])


@register("masked_means", """SELECT user_id, round(sum(value * (event_id % 2)) / greatest(sum(event_id % 2), 1), 9) AS masked_mean FROM events GROUP BY user_id""")
def masked_means(spark: SparkSession, sf_dir: str) -> DataFrame:
    mask = F.pmod("event_id", F.lit(2))
    return table(spark, sf_dir, "events").groupBy("user_id").agg(F.round(F.sum(F.col("value") * mask) / F.greatest(F.sum(mask), F.lit(1)), 9).alias("masked_mean"))


@register("pooled_vectors", """SELECT label, pos, round(avg(v), 5) AS v FROM (SELECT label, unnest(embedding)::DOUBLE AS v, generate_subscripts(embedding, 1)::INT - 1 AS pos FROM embeddings) GROUP BY ALL""")
def pooled_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "embeddings").select("label", F.posexplode("embedding").alias("pos", "v"))
    return rows.groupBy("label", "pos").agg(F.round(F.avg(F.col("v").cast("double")), 5).alias("v"))


@register("retained_counts", """SELECT source, count(*) AS n, greatest(1, least(count(*), round_even(count(*) * 0.25::DOUBLE, 0)::BIGINT)) AS k FROM documents GROUP BY source""")
def retained_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = F.count("*")
    return table(spark, sf_dir, "documents").groupBy("source").agg(n.alias("n"), F.greatest(F.lit(1), F.least(n, F.bround(n * F.lit(0.25)).cast("long"))).alias("k"))


@register("evenly_spaced", f"""WITH {S.SQL_BLOCKS}, c AS (SELECT *, count(*) OVER (PARTITION BY doc_id) AS n FROM blocks)
    SELECT doc_id, block_id FROM c WHERE order_index IN (floor(0.5 * n / 3)::BIGINT, floor(1.5 * n / 3)::BIGINT, floor(2.5 * n / 3)::BIGINT)""")
def evenly_spaced(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Three blocks of each document on a uniform lattice of places."""
    rows = S.blocks(spark, sf_dir).withColumn("n", F.count("*").over(Window.partitionBy("doc_id")))
    at = lambda x: F.floor(F.lit(x) * F.col("n") / 3).cast("long")
    return rows.where((F.col("order_index") == at(0.5)) | (F.col("order_index") == at(1.5)) | (F.col("order_index") == at(2.5))).select("doc_id", "block_id")


@register("store_recall", f"""WITH {R._CANDIDATES}, nq AS (SELECT qid, sum(q_tf) AS need FROM q GROUP BY qid),
    h AS (SELECT qid, doc_id, block_id, sum(least(q_tf, tf)) AS hit FROM ct JOIN q USING (qid, token) GROUP BY ALL),
    b AS (SELECT c.qid, c.doc_id, c.block_id, coalesce(hit, 0) / need::DOUBLE AS r FROM c JOIN nq USING (qid) LEFT JOIN h USING (qid, doc_id, block_id))
    SELECT doc_id, qid AS item_id, count(*) AS n_blocks, round(max(r), 6) AS best_block_recall FROM b GROUP BY ALL""")
def store_recall(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Best block recall of an item's tokens over the blocks of its best documents."""
    found, terms = R.candidates(spark, sf_dir)
    asked = S.questions(spark, sf_dir)
    key = ["qid", "doc_id", "block_id"]
    hits = terms.join(asked, ["qid", "token"]).groupBy(*key).agg(F.sum(F.least("q_tf", "tf")).alias("hit"))
    need = asked.groupBy("qid").agg(F.sum("q_tf").alias("need"))
    rows = found.select(*key).join(need, "qid").join(hits, key, "left").withColumn("r", F.coalesce("hit", F.lit(0)) / F.col("need").cast("double"))
    return rows.groupBy("doc_id", F.col("qid").alias("item_id")).agg(F.count("*").alias("n_blocks"), F.round(F.max("r"), 6).alias("best_block_recall"))


#: The quote form of texts without characters that NFKC changes, and without hyphens between word characters.
_SQZ = r"trim(regexp_replace(lower({0}), '\s+', ' ', 'g'))"
_CMP = r"regexp_replace(lower({0}), '[^0-9a-z\x{{4e00}}-\x{{9fff}}]+', '', 'g')"


@register("citations", f"""WITH {S.SQL_BLOCKS}, q AS (SELECT doc_id, page_id, substr(text, 1, 24) AS quote, CASE WHEN doc_id % 3 = 0 THEN block_id ELSE 'p1_b1' END AS cited FROM blocks WHERE order_index = 0),
    h AS (SELECT q.doc_id, cited, b.block_id, trim(quote) <> '' AND (contains({_SQZ.format('b.text')}, {_SQZ.format('quote')}) OR ({_CMP.format('quote')} <> '' AND contains({_CMP.format('b.text')}, {_CMP.format('quote')}))) AS hit FROM q JOIN blocks b USING (doc_id, page_id))
    SELECT doc_id, CASE WHEN bool_or(hit AND block_id = cited) THEN 1 WHEN bool_or(hit) THEN 0.5 ELSE 0 END::DOUBLE AS citation_score FROM h GROUP BY doc_id""")
def citations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quotes of each document's first block, cited with the right or another block."""
    blocks = S.blocks(spark, sf_dir).withColumnRenamed("doc_id", "document_id")
    first = blocks.where("order_index = 0")
    cited = F.when(F.pmod("document_id", F.lit(3)) == 0, F.col("block_id")).otherwise("p1_b1")
    evidence = first.select(F.col("document_id").alias("sample"), "document_id", F.lit(0).alias("n"), "page_id", cited.alias("block_id"), F.substring("text", 1, 24).alias("quote"))
    scored = grounding.citation_scores(grounding.citation_validity(evidence, blocks))
    return scored.select(F.col("sample").alias("doc_id"), "citation_score")


@register("structured_predictions")
def structured_predictions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cut-off JSON answers repaired and read; the repair has no SQL twin."""
    quote = F.substring("text", 1, 12)
    whole = F.to_json(F.struct(F.lit("r").alias("result"), F.array().cast("array<struct<claim_id:string,text:string>>").alias("claims"), F.array(F.struct(F.lit("e1").alias("evidence_id"), F.lit(1).alias("page_id"), F.lit("p1_b0").alias("block_id"), quote.alias("quote"), F.array(F.lit("c1")).alias("supports"))).alias("evidence")))
    cut = F.substr(whole, F.lit(1), F.length(whole) - F.pmod("item_id", F.lit(4)).cast("int"))
    rows = table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("sample"), F.lit("d").alias("document_id"), cut.alias("pred"))
    return grounding.cited(rows, "pred").select("sample", "evidence_id", "page_id", "block_id", "quote")


@register("quote_containment", f"""SELECT doc_id, coalesce({_SQZ.format("substr(text, 5, 15)")} <> '' AND (contains({_SQZ.format('text')}, {_SQZ.format("substr(text, 5, 15)")}) OR ({_CMP.format("substr(text, 5, 15)")} <> '' AND contains({_CMP.format('text')}, {_CMP.format("substr(text, 5, 15)")}))), false) AS held FROM documents""")
def quote_containment(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", contains_quote(F.col("text"), F.substring("text", 5, 15)).alias("held"))


@register("error_reasons", """SELECT reason, n FROM (SELECT left(event_type || ' failed because of a very long explanation that goes on and on', 60) AS reason, count(*) AS n FROM events WHERE event_id % 3 = 0 GROUP BY ALL ORDER BY n DESC, reason LIMIT 5)""")
def error_reasons(spark: SparkSession, sf_dir: str) -> DataFrame:
    from folioscope.operators import plugins

    rows = table(spark, sf_dir, "events").select(F.when(F.pmod("event_id", F.lit(3)) == 0, F.concat("event_type", F.lit(" failed because of a very long explanation that goes on and on"))).alias("error"))
    return plugins.error_reasons(rows)


@register("run_summary", """SELECT event_type, count(*) AS n, round(avg(value), 4) AS mean_value, round(sum(value) FILTER (event_id % 2 = 0) / sum(value), 6) AS share FROM events GROUP BY GROUPING SETS ((event_type), ())""")
def run_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    part = F.sum(F.when(F.pmod("event_id", F.lit(2)) == 0, F.col("value"))) / F.sum("value")
    return table(spark, sf_dir, "events").groupingSets([["event_type"], []], "event_type").agg(F.count("*").alias("n"), F.round(F.avg("value"), 4).alias("mean_value"), F.round(part, 6).alias("share"))


@register("strict_pairs", "SELECT doc_id, quality, toxic FROM labels")
def strict_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    labels = table(spark, sf_dir, "labels")
    return sets.strict_pair(labels.select("doc_id", "quality"), labels.select("doc_id", "toxic"), "doc_id")


@register("donor_pages", """SELECT doc_id, p::BIGINT AS page, ((p - 1) % (doc_id % 3 + 2) + 1)::BIGINT AS donor_page FROM documents, range(1, 7) t(p)""")
def donor_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "documents").select("doc_id", F.explode(F.sequence(F.lit(1).cast("long"), F.lit(6).cast("long"))).alias("page"))
    return rows.select("doc_id", "page", controls.donor_page(F.col("page"), F.pmod("doc_id", F.lit(3)) + 2).alias("donor_page"))
