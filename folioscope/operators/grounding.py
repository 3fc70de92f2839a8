"""Citations of structured predictions against a document store."""

from __future__ import annotations

import json

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from folioscope.functions.text import contains_forms, contains_normal, nfkc, normalize_quote, quote_form, search_forms, snippet_of, strip

PREDICTION = "struct<result: string, claims: array<struct<claim_id: string, text: string>>, evidence: array<struct<evidence_id: string, page_id: int, block_id: string, quote: string, supports: array<string>>>>"


def repair(text: str | None) -> str | None:
    """The JSON object in a model's answer, closed where it was cut short; null without one."""
    start = (text or "").find("{")
    if start < 0:
        return None
    body = text[start:]
    decoder = json.JSONDecoder()
    try:
        return json.dumps(decoder.raw_decode(body)[0], ensure_ascii=False)
    except ValueError:
        pass
    stack, quoted, escaped, safe = [], False, False, []
    for i, ch in enumerate(body):
        if quoted:
            quoted, escaped = (ch != '"' or escaped), (ch == "\\" and not escaped)
            if not quoted:
                safe.append((i + 1, "".join(reversed(stack))))
            continue
        if ch == '"':
            quoted = True
        elif ch in "{[":
            stack.append("}" if ch == "{" else "]")
            safe.append((i + 1, "".join(reversed(stack))))
        elif ch in "}]" and stack:
            stack.pop()
            safe.append((i + 1, "".join(reversed(stack))))
    for end, closing in reversed(safe):
        try:
            return json.dumps(json.loads(body[:end].rstrip().rstrip(",") + closing), ensure_ascii=False)
        except ValueError:
            continue
    return None


@F.pandas_udf(StringType())
def _repaired(text: pd.Series) -> pd.Series:
    return text.map(repair)


def sound_json(column: str) -> Column:
    """An answer from its first brace on, where that is JSON as it stands; null elsewhere."""
    body = F.regexp_extract(F.col(column), r"(?s)\{.*", 0)
    return F.when(F.try_parse_json(body).isNotNull() & (body != ""), body)


def repaired_json(column: str) -> Column:
    """The JSON object of an answer: sound ones as they are, read by the JVM, others repaired."""
    sound = sound_json(column)
    return F.coalesce(sound, _repaired(F.when(sound.isNull(), F.col(column))))


def cited(predictions: DataFrame, column: str) -> DataFrame:
    """One row per cited piece of evidence of (sample, document_id, column)."""
    parsed = predictions.withColumn("p", F.from_json(repaired_json(column), PREDICTION))
    return parsed.select("sample", "document_id", F.posexplode_outer("p.evidence").alias("n", "e")).select("sample", "document_id", "n", F.coalesce(F.nullif(strip(F.col("e.evidence_id")), F.lit("")), F.concat(F.lit("e"), (F.col("n") + 1).cast("string"))).alias("evidence_id"), "e.page_id", "e.block_id", "e.quote", "e.supports").where("n IS NOT NULL")


def complete(evidence: DataFrame, canonical: DataFrame) -> DataFrame:
    """Missing page, block, quote and supports from the canonical evidence of the same id; all in their quote form."""
    known = canonical.select("sample", "evidence_id", F.col("page_id").alias("k_page"), F.col("block_id").alias("k_block"), F.col("quote").alias("k_quote"), F.col("supports").alias("k_supports"))
    rows = evidence.join(known, ["sample", "evidence_id"], "left")
    form = lambda c: F.nullif(normalize_quote(F.col(c)), F.lit(""))
    held = lambda c: F.filter(F.transform(F.coalesce(c, F.array().cast("array<string>")), strip), lambda x: F.coalesce(x != "", F.lit(False)))
    return rows.select(
        "sample", "document_id", "n", "evidence_id", F.coalesce("page_id", "k_page").alias("page_id"), F.coalesce(form("block_id"), form("k_block")).alias("block_id"),
        F.coalesce(form("quote"), form("k_quote"), F.lit("")).alias("quote"), F.when(F.size(held("supports")) > 0, held("supports")).otherwise(held("k_supports")).alias("supports"),
    )


def citation_validity(evidence: DataFrame, blocks: DataFrame) -> DataFrame:
    """Per citation: 1 for a quote in the cited block, 0.5 for one elsewhere on the page, else 0.

    The join is on document and page; a page's blocks are reduced to two flags
    per citation before anything else is kept.
    """
    forms = blocks.select("document_id", "page_id", F.col("block_id").alias("b_block"), normalize_quote(F.col("text")).alias("b_norm")).withColumn("b_forms", search_forms(F.col("b_norm"))).drop("b_norm")
    rows = evidence.withColumn("q_norm", normalize_quote(F.col("quote"))).withColumn("q_forms", search_forms(F.col("q_norm"))).drop("q_norm").join(forms, ["document_id", "page_id"], "left")
    hit = contains_forms(F.col("b_forms"), F.col("q_forms"))
    flags = rows.groupBy("sample", "document_id", "n", "page_id", "block_id", "quote").agg(
        F.coalesce(F.bool_or(hit & (F.col("b_block") == F.col("block_id"))), F.lit(False)).alias("exact"), F.coalesce(F.bool_or(hit), F.lit(False)).alias("on_page")
    )
    return flags.withColumn("validity", F.when(F.col("exact"), 1.0).when(F.col("on_page"), 0.5).otherwise(0.0))


def citation_scores(validity: DataFrame) -> DataFrame:
    return validity.groupBy("sample").agg(F.count("*").alias("n_citations"), F.avg("validity").alias("citation_score"), F.avg(F.col("exact").cast("double")).alias("exact_rate"))


#: Labels of a citation and their scores, best first.
EXACT, ON_PAGE, INVALID = "exact_block_quote", "page_quote_only", "invalid"


def verified(evidence: DataFrame, pages: DataFrame, blocks: DataFrame, units: DataFrame) -> DataFrame:
    """What holds each citation, by four places in turn.

    The cited block (1); the text of the cited page (0.5); the first other block of
    that page that holds the quote (0.5); the first gold unit of the sample on that
    page, exact where its block is the cited one (1 or 0.5). Elsewhere it is invalid.

    evidence: rows of :func:`complete`; pages: (document_id, page_id, page_text);
    blocks: (document_id, page_id, block_id, order_index, text); units: (sample,
    n_unit, page_id, block_id, text_excerpt). Rows with a null page meet nothing.
    Containers meet a citation by document and page, and leave that join only where
    they hold its quote; the best one is kept before the shuffle, so a page's texts are
    not gathered.
    """
    keys = ["sample", "document_id", "n"]
    said = ["evidence_id", "page_id", "block_id", "quote", "supports"]
    own = ["document_id", "page_id"]
    rows = evidence.select(*keys, *said).withColumn("q_forms", search_forms(F.col("quote")))
    of_pages = pages.select(*own, F.lit(None).cast("string").alias("c_block"), F.lit(2).alias("place"), F.lit(0).cast("long").alias("c_order"), F.col("page_text").alias("c_text"))
    of_blocks = blocks.select(*own, F.col("block_id").alias("c_block"), F.lit(3).alias("place"), F.col("order_index").cast("long").alias("c_order"), F.col("text").alias("c_text"))
    of_units = units.select("sample", "page_id", F.col("block_id").alias("c_block"), F.lit(4).alias("place"), F.col("n_unit").cast("long").alias("c_order"), F.col("text_excerpt").alias("c_text"))

    def best(left: DataFrame, containers: DataFrame, on: list[str], name: str) -> DataFrame:
        """The first container of each citation that holds its quote, as struct ``name``; citations stay without one."""
        # Forms are made once a container; the join itself tells what holds a quote, so that nothing else comes out of it.
        # Texts are dealt by the join's keys as they are: Python, which composes them, hides from Spark how they lie, so it comes before.
        dealt = containers.withColumn("c_nfkc", nfkc(F.coalesce("c_text", F.lit("")))).repartition(*on)
        forms = dealt.withColumn("c_norm", quote_form(F.col("c_nfkc"))).withColumn("c_forms", search_forms(F.col("c_norm"))).drop("c_norm", "c_nfkc").withColumnsRenamed({c: f"c_{c}" for c in on})
        meets = contains_forms(F.col("c_forms"), F.col("q_forms"))
        for c in on:
            meets &= F.col(c) == F.col(f"c_{c}")
        met = left.join(forms, meets, "left")
        exact = F.coalesce(F.col("c_block") == F.col("block_id"), F.lit(False)) & F.col("place").isin(3, 4)
        order = F.struct(F.when(exact & (F.col("place") == 3), 1).otherwise(F.col("place")).alias("place"), "c_order", "c_block")
        found = F.struct(exact.alias("exact"), F.col("place").alias("place"), F.col("c_block").alias("block"), F.col("c_text").alias("text"))
        kept = [c for c in left.columns if c not in keys]
        out = met.groupBy(*keys).agg(F.any_value(F.struct(*kept)).alias("row"), F.min_by(found, F.when(F.col("place").isNotNull(), order)).alias(name))
        return out.select(*keys, "row.*", name)

    # The store's texts come last, so that they aren't moved on.
    in_gold = best(rows, of_units, ["sample", "page_id"], "gold")
    in_store = best(in_gold, of_pages.unionByName(of_blocks), own, "stored")
    settled = in_store.withColumn("b", F.coalesce("stored", "gold")).withColumn("raw", strip(F.coalesce("b.text", F.lit("")))).withColumn("form", normalize_quote(F.col("raw")))
    label = F.when(F.col("b").isNull(), F.lit(INVALID)).when(F.col("b.exact"), F.lit(EXACT)).otherwise(ON_PAGE)
    around = F.when(F.col("b.place") == 4, F.col("form")).otherwise(snippet_of(F.col("form"), F.col("quote")))
    return settled.withColumn("validation_label", label).select(
        *keys, *said, "validation_label", F.when(F.col("validation_label") == EXACT, 1.0).when(F.col("validation_label") == ON_PAGE, 0.5).otherwise(0.0).alias("validation_score"),
        F.when(F.col("b").isNotNull(), F.col("page_id")).alias("matched_page_id"), F.col("b.block").alias("matched_block_id"), F.when(F.col("b").isNull(), "").otherwise(around).alias("matched_snippet"), F.col("raw").alias("matched_snippet_raw"),
    )


def gold_units(units: DataFrame) -> DataFrame:
    """Canonical evidence from gold units (sample, n_unit, evidence_id, fact_id, page_id, block_id, text_excerpt); blank ids are e1, e2, ..., and f1, f2, ..."""
    named = lambda c, letter: F.coalesce(F.nullif(strip(F.col(c)), F.lit("")), F.concat(F.lit(letter), F.col("n_unit").cast("string")))
    fact = named("fact_id", "f")
    return units.select("sample", "n_unit", named("evidence_id", "e").alias("evidence_id"), fact.alias("fact_id"), "page_id", "block_id", "text_excerpt", F.col("text_excerpt").alias("quote"), F.array(fact).alias("supports"))


def hard_evaluation(predictions: DataFrame, units: DataFrame, pages: DataFrame, blocks: DataFrame) -> DataFrame:
    """One row per prediction (sample, document_id, pred): its parsed result and what became of its citations.

    available, result_text, citation_score (0 without citations, null where the
    sample has no gold units), the shares of exact, page-only and invalid citations
    (null without any), and ``verified_evidence`` in cited order. Of gold units that
    share an evidence id the last one counts.
    """
    gold = gold_units(units)
    canonical_units = gold.groupBy("sample", "evidence_id").agg(F.max_by(F.struct("page_id", "block_id", "quote", "supports"), "n_unit").alias("u")).select("sample", "evidence_id", "u.*")
    available = gold.groupBy("sample").agg(F.count("*").alias("n_units"))
    parsed = predictions.select("sample", "document_id", "pred", F.from_json(repaired_json("pred"), PREDICTION).alias("p"))
    result = F.nullif(normalize_quote(F.col("p.result")), F.lit(""))
    heads = parsed.select("sample", "document_id", F.coalesce(result, normalize_quote(F.col("pred"))).alias("result_text"), F.col("p").isNotNull().alias("structured"))
    judged = verified(complete(cited(predictions, "pred").join(available, "sample", "left_semi"), canonical_units), pages, blocks, gold)
    share = lambda label: F.avg((F.col("validation_label") == label).cast("double"))
    one = F.struct("n", "evidence_id", "page_id", "block_id", "quote", "supports", "validation_score", "validation_label", "matched_page_id", "matched_block_id", "matched_snippet", "matched_snippet_raw")
    per = judged.groupBy("sample").agg(
        F.count("*").alias("n_evidence"), F.avg("validation_score").alias("score"), share(EXACT).alias("exact_rate"), share(ON_PAGE).alias("page_only_rate"), share(INVALID).alias("invalid_rate"),
        F.array_sort(F.collect_list(one)).alias("verified_evidence"),  # as many as one answer cites
    )
    rows = heads.join(available, "sample", "left").join(per, "sample", "left")
    return rows.select(
        "sample", "document_id", F.coalesce(F.col("n_units") > 0, F.lit(False)).alias("available"), "structured", "result_text", F.coalesce("n_evidence", F.lit(0).cast("long")).alias("n_evidence"),
        F.when(F.col("n_units") > 0, F.coalesce("score", F.lit(0.0))).alias("citation_score"), "exact_rate", "page_only_rate", "invalid_rate", "verified_evidence",
    )


def canonical(column: str) -> Column:
    """A prediction's JSON with the known fields alone, in their order; null where there is no object."""
    parsed = F.from_json(repaired_json(column), PREDICTION)
    return F.when(parsed.isNotNull(), F.to_json(parsed))


def replace_result(column: str, result: Column) -> Column:
    """The prediction with another result, its claims and evidence kept."""
    parsed = F.from_json(repaired_json(column), PREDICTION)
    return F.when(parsed.isNotNull(), F.to_json(F.struct(result.cast("string").alias("result"), parsed["claims"].alias("claims"), parsed["evidence"].alias("evidence"))))


def with_gold_fallback(validity: DataFrame, units: DataFrame) -> DataFrame:
    """Citations judged by the gold unit of their page or block where the store holds none of their page's blocks.

    validity: rows of :func:`citation_validity`; units: (sample, page_id, block_id, quote).
    """
    gold = units.select("sample", "page_id", F.col("block_id").alias("g_block"), F.col("quote").alias("g_quote"))
    held = validity.join(gold, ["sample", "page_id"], "left")
    hit = contains_normal(F.col("g_quote"), normalize_quote(F.col("quote")))
    keys = ["sample", "document_id", "n", "page_id", "block_id", "quote", "exact", "on_page", "validity"]
    flags = held.groupBy(*keys).agg(F.coalesce(F.bool_or(hit & (F.col("g_block") == F.col("block_id"))), F.lit(False)).alias("gold_exact"), F.coalesce(F.bool_or(hit), F.lit(False)).alias("gold_page"))
    better = F.when(F.col("gold_exact"), 1.0).when(F.col("gold_page"), 0.5).otherwise(0.0)
    return flags.withColumn("validity", F.when(F.col("on_page"), F.col("validity")).otherwise(better)).withColumn("exact", F.col("exact") | (~F.col("on_page") & F.col("gold_exact"))).drop("gold_exact", "gold_page")
