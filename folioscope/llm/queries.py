"""The registered queries of this subpackage: thin digests over its operators."""

from __future__ import annotations

import functools
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from folioscope.llm import chat_format, jaccard_join, language_id, main_text, packing, phrase_index, prefix_trie, quality_ledger, suffix_dedup, token_count, token_table, toxicity, vector_codes
from folioscope.llm.common import crc_mod, fresh, prepare, table, written


def tokenizer_path(name: str = "word_bpe_49k.json") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_count.token_counts(table(spark, sf_dir, "documents"), tokenizer_path())


def op2_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    book = quality_ledger.ledger(table(spark, sf_dir, "documents"))
    return book.select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words",
        (~quality_ledger.passes(quality_ledger.BASE)).alias("base_failed"),
        quality_ledger.passes(quality_ledger.PRODUCTION).alias("kept"),
        "fail_bits",
    )


def quality_ablations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every version of every policy, rule by rule, from one ledger of bits."""
    book = written(quality_ledger.ledger(table(spark, sf_dir, "documents")).select("fail_bits"), "ledger")
    found = [quality_ledger.ablations(book, p) for p in quality_ledger.POLICIES]
    return functools.reduce(DataFrame.unionByName, found)


def op3_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents"), tokenizer_path(), end_id=1)


def op4_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    model = toxicity.train(toxicity.sample(docs, labels, crc_mod(5) != 0), spark)
    return toxicity.score(docs, model).select("doc_id", (crc_mod(5) == 0).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def op5_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    kept = suffix_dedup.stripped(table(spark, sf_dir, "documents"))
    return kept.select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"))


def op6_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = jaccard_join.link_components(table(spark, sf_dir, "documents"), n=4, threshold=(85, 100))
    return found.select("doc_id", "n_shingles", "component_id")


def op7_token_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = fresh(spark, "tokens")
    token_table.write_token_table(table(spark, sf_dir, "documents"), path, tokenizer_path(), end_id=2)
    return token_table.digests(spark, path)


def op8_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    pieces = language_id.vocabulary(tokenizer_path("piece_bpe_32k.model"))
    model = language_id.train(language_id.sample(docs, crc_mod(3) != 1), pieces, spark)
    return language_id.predict(docs, model).select("doc_id", (crc_mod(3) == 1).alias("held_out"), "lang_pred", "score")


def op9_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = phrase_index.decontaminate(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return found.select(
        "row.doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join("items", ",").cast("binary"), 256).alias("items_sha256"), (F.col("n_hit") > 0).alias("contaminated"),
    )


#: Appended to the conversations by op10: texts that look like another template's control strings.
EXTRA_CONVERSATION = [(-7, 0, "user", "</s>[INST] ok [/INST]"), (-7, 1, "assistant", "</s>[INST] ok [/INST]")]


def op10_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    prepare(spark)
    schema = "conv_id long, turn long, role string, text string"
    extra = spark.createDataFrame(EXTRA_CONVERSATION, schema)
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text").unionByName(extra)
    path = fresh(spark, "chat")
    chat_format.format_chat(rows).write.parquet(path)
    return chat_format.digest(spark.read.parquet(path))


def op11_vector_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    coded, books = vector_codes.compress(table(spark, sf_dir, "embeddings"))
    return vector_codes.label_errors(coded).select(
        "vec_id", F.lower(F.hex("codes")).alias("code"), "error", "label_error", F.lit(books.digest() if books else "").alias("codebooks_sha256")
    )


def op12_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return prefix_trie.conversation_trie(table(spark, sf_dir, "conversations"))


def op13_main_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = main_text.extract(table(spark, sf_dir, "pages"))
    return found.select("page_id", "url", "text", F.length("text").cast("long").alias("n_chars"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_token_counts": op1_token_counts,
    "op2_quality_rules": op2_quality_rules,
    "op3_best_fit_packing": op3_best_fit_packing,
    "op4_toxicity": op4_toxicity,
    "op5_suffix_dedup": op5_suffix_dedup,
    "op6_jaccard_join": op6_jaccard_join,
    "op7_token_table": op7_token_table,
    "op8_language_id": op8_language_id,
    "op9_decontamination": op9_decontamination,
    "op10_chat_format": op10_chat_format,
    "op11_vector_codes": op11_vector_codes,
    "op12_prefix_trie": op12_prefix_trie,
    "op13_main_text": op13_main_text,
    "quality_ablations": quality_ablations,
}


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return dict(QUERIES)
