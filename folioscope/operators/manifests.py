"""Manifests: samples, their pages and evidence, in order and without gaps."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from folioscope.functions.text import strip
from folioscope.operators.sets import expect

# The corpus families that document ids start with, in two reports.
FIDELITY_FAMILIES = ("arxiv", "docvqa", "cloudflare", "aws", "wipo", "registry", "gov", "nasa")
DONOR_FAMILIES = ("arxiv", "wipo", "cloudflare", "registry", "faa", "docvqa")


def family(document_id: Column, prefixes: tuple[str, ...] = FIDELITY_FAMILIES, other: str | None = None) -> Column:
    """The first of ``prefixes`` that an id starts with, else ``other``, else what precedes its first underscore."""
    out = F.lit(other) if other is not None else F.substring_index(document_id, "_", 1)
    for p in reversed(prefixes):
        out = F.when(document_id.startswith(p), p).otherwise(out)
    return out


def dataset_tag(benchmark: Column) -> Column:
    """The tag of a benchmark's spellings."""
    name = F.lower(strip(F.coalesce(benchmark, F.lit(""))))
    return F.when(name.isin("v-niah", "vniah"), "vniah").when(name.isin("v-mqar", "vmqar"), "vmqar").otherwise("other")


def gold_pages(evidence: Column) -> Column:
    """Distinct evidence pages, ascending."""
    return F.array_sort(F.array_distinct(F.filter(F.transform(evidence, lambda e: e.page_id), lambda p: p.isNotNull() & (p > 0))))


def gold_blocks(evidence: Column) -> Column:
    """Distinct (page_id, block_id) of the evidence that names both."""
    named = F.filter(evidence, lambda e: F.coalesce(e.page_id.isNotNull() & (strip(e.block_id) != ""), F.lit(False)))
    return F.array_distinct(F.transform(named, lambda e: F.struct(e.page_id.alias("page_id"), strip(e.block_id).alias("block_id"))))


def page_subset(pages: Column, images: Column, wanted: Column) -> Column:
    """(page_id, image) of the wanted pages in input order; empty where pages and images don't pair up."""
    pairs = F.transform(pages, lambda p, i: F.struct(p.alias("page_id"), F.get(images, i).alias("image")))
    return F.when(F.size(pages) >= F.size(images), F.filter(F.slice(pairs, F.lit(1), F.size(images)), lambda x: F.array_contains(wanted, x.page_id))).otherwise(F.slice(pairs, 1, 0))


def source_pages(kind: str, given: Column, retained: Column, selected: Column | None = None) -> Column:
    """A block selector's pages in input order: all, the retained, both, or the selected; all where none is left."""
    sets = {"input": given, "retained": retained, "selector": selected, "hybrid": F.array_union(retained, selected if selected is not None else retained)}
    if kind not in sets or sets[kind] is None:
        raise ValueError(f"unknown page source {kind!r}")
    kept = F.filter(given, lambda p: F.array_contains(sets[kind], p))
    return F.when(F.coalesce(F.size(kept) > 0, F.lit(False)), kept).otherwise(given)


def training_pages(given: Column, logits: Column, gold: Column, keep: Column) -> Column:
    """The ``keep`` best pages by logit and all gold ones, in input order; all pages where that says nothing."""
    ranked = F.slice(F.array_sort(F.transform(given, lambda p, i: F.struct((-F.get(logits, i)).alias("neg"), i.alias("i"), p.alias("p")))), F.lit(1), F.greatest(F.lit(1), keep))
    wanted = F.array_union(F.transform(ranked, lambda r: r.p), gold)
    usable = (keep > 0) & (keep < F.size(given)) & (F.size(logits) >= F.size(given))
    return F.when(F.coalesce(usable, F.lit(False)), F.filter(given, lambda p: F.array_contains(wanted, p))).otherwise(given)


def resolve_page_paths(document_id: Column, images: Column, context_pages: Column, root: str, folder: str) -> Column:
    """(page_id, image_path) of every page: the given path (relative ones under ``folder``), else the rendered page's.

    Pages are numbered by file name, else by place.
    """
    from folioscope.sources.readers import image_page

    raw = F.when(F.size(images) > 0, images).otherwise(F.transform(context_pages, lambda _: F.lit("")))

    def one(path: Column, i: Column) -> Column:
        number = F.coalesce(F.get(context_pages, i), i + 1)
        given = F.when(path.startswith("/"), path).otherwise(F.concat(F.lit(f"{folder}/"), path))
        rendered = F.concat(F.lit(f"{root}/data/render/"), document_id, F.format_string("/page_%04d.png", number))
        full = F.when(F.coalesce(strip(path), F.lit("")) != "", given).otherwise(rendered)
        return F.struct(F.coalesce(image_page(full), i + 1).alias("page_id"), full.alias("image_path"))

    return F.transform(raw, one)


def document_path(given: Column, root: str, document_id: Column) -> Column:
    """An explicit document path, else the store's by id; null without either."""
    return F.coalesce(F.nullif(strip(given), F.lit("")), F.when(strip(document_id) != "", F.concat(F.lit(f"{root}/data/documents/"), strip(document_id), F.lit(".json"))))


def manifest_path(root: str, dataset: str, split: str, exists) -> str:
    """The first of three layouts that is there; ``exists`` tells of a path."""
    options = [f"{root}/data/{dataset}/{split}.jsonl", f"{root}/{dataset}/{split}.jsonl", f"{root}/{dataset}_{split}.jsonl"]
    for path in options:
        if exists(path):
            return path
    raise FileNotFoundError(f"no manifest of {dataset}/{split}: {options}")


def export_manifest(rows: DataFrame, most: int | None = None) -> DataFrame:
    """Retrieval manifest rows of (dataset, ordinal, task_id, id, source_document_id, document_id, question, answer, evidence, pages).

    ``most`` is the feature's cap per dataset, in file order.
    """
    out = rows.select(
        "dataset", "ordinal", F.coalesce("task_id", "id", F.lit("")).alias("sample_id"), F.coalesce("source_document_id", "document_id", F.lit("")).alias("document_id"),
        strip(F.coalesce("question", F.lit(""))).alias("question"), F.when(F.col("answer").isNotNull(), F.array("answer")).otherwise(F.array().cast("array<string>")).alias("answers"),
        gold_pages(F.col("evidence")).alias("gold_page_ids"), "pages", F.size("pages").alias("num_pages"),
    )
    if most is None:
        return out
    rank = F.row_number().over(Window.partitionBy("dataset").orderBy("ordinal"))
    return out.withColumn("k", rank).where(F.col("k") <= most).drop("k")


def complete_documents(rows: DataFrame, most_pages: int) -> tuple[DataFrame, DataFrame]:
    """(rows kept, counts of why others went): documents without pages, with missing ones, or over-long ones are left out.

    rows: (sample_id, pages, n_present).
    """
    n = F.size("pages")
    why = F.when(n <= 0, "no_pages").when(F.col("n_present") < n, "missing_pages").when(n > most_pages, "too_long")
    marked = rows.withColumn("why", why)
    return marked.where("why IS NULL").drop("why"), marked.where("why IS NOT NULL").groupBy("why").agg(F.count("*").alias("n"))


def allow_only(rows: DataFrame, ids: DataFrame, key: str) -> DataFrame:
    """Rows whose id is listed."""
    return rows.join(ids.select(key).distinct(), key, "left_semi")


def unskipped(rows: DataFrame) -> DataFrame:
    return rows.where(F.coalesce(strip(F.col("skip_reason")), F.lit("")) == "")


def pooled(parts: dict[str, DataFrame], key: str) -> DataFrame:
    """All parts, ids prefixed with the part's name so that they can't clash."""
    out = None
    for name, rows in parts.items():
        one = rows.withColumn(key, F.concat(F.lit(f"{name}_"), F.col(key).cast("string")))
        out = one if out is None else out.unionByName(one)
    return out


def shard_of(ordinal: Column, shards: int) -> Column:
    """Which of ``shards`` workers a row of the running ordinal belongs to."""
    return F.pmod(ordinal, F.lit(shards))


def ordered_ids(rows: DataFrame, key: str, ordinal: str) -> DataFrame:
    """(key, ordinal) of a manifest; a blank or repeated id is an error."""
    expect(rows, blank=F.coalesce(strip(F.col(key).cast("string")), F.lit("")) == "")
    expect(rows.groupBy(key).count(), repeated=F.col("count") > 1)
    return rows.select(key, ordinal)


def in_manifest_order(rows: DataFrame, manifest: DataFrame, key: str, ordinal: str) -> DataFrame:
    """Rows in the manifest's order, those it doesn't know last, by id."""
    return rows.join(manifest.select(key, F.col(ordinal).alias("_place")), key, "left").orderBy(F.col("_place").asc_nulls_last(), key).drop("_place")


def pixel_budget(most: int | None, keep_ratio: float = 1.0) -> int | None:
    """A page's pixels under a keep ratio."""
    if most is None:
        return None
    if keep_ratio <= 0:
        raise ValueError("the keep ratio must be positive")
    return most if keep_ratio >= 0.999999 else max(1, int(most * keep_ratio))


def training_rows(questions: DataFrame, memory: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(rows, counts of skips): auxiliary questions with their memory as training examples.

    questions: (sample, question, answer, gold_pages); a row without question,
    answer, gold pages or memory is skipped, for the first of these reasons.
    """
    from folioscope.functions.prompts import text_memory

    joined = questions.join(memory.select("sample", "memory"), "sample", "left")
    blank = lambda c: F.coalesce(strip(F.col(c)), F.lit("")) == ""
    why = F.when(blank("question"), "no_question").when(blank("answer"), "no_answer").when(F.coalesce(F.size("gold_pages"), F.lit(0)) <= 0, "no_gold").when(blank("memory"), "no_memory")
    marked = joined.withColumn("why", why)
    rows = marked.where("why IS NULL").select("sample", text_memory(F.col("question"), F.col("memory")).alias("user_text"), strip(F.col("answer")).alias("answer"), "gold_pages")
    return rows, marked.where("why IS NOT NULL").groupBy("why").agg(F.count("*").alias("n"))
