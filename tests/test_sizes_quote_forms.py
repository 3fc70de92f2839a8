"""Containers are dealt as texts, and get their search forms where they meet the citations."""

from pyspark.sql import functions as F

from folioscope.functions.text import compact
from folioscope.operators import grounding


def test_forms_are_made_behind_the_only_exchange_of_texts(spark):
    evidence = spark.createDataFrame([("s", "d", 0, "e1", 1, "b0", "Alpha", ["c"]), ("s", "d", 1, "e2", 1, "b9", "beta", ["c"])], "sample string, document_id string, n int, evidence_id string, page_id int, block_id string, quote string, supports array<string>")
    pages = spark.createDataFrame([("d", 1, "ＡLPHA"), ("d", 2, None)], "document_id string, page_id int, page_text string")
    blocks = spark.createDataFrame([("d", 1, "b0", 0, "is al-pha"), ("d", 1, "b1", 1, None)], "document_id string, page_id int, block_id string, order_index int, text string")
    units = spark.createDataFrame([("s", 1, 1, "b9", "beta")], "sample string, n_unit int, page_id int, block_id string, text_excerpt string")
    found = grounding.verified(evidence, pages, blocks, units)
    lines = found._jdf.queryExecution().sparkPlan().toString().splitlines()
    physical = found._jdf.queryExecution().executedPlan().toString().splitlines()
    assert len([line for line in lines if "Exchange hashpartitioning" in line and "REPARTITION_BY_COL" in line]) == 2
    assert not [line for line in physical if "Exchange hashpartitioning(c_" in line]  # forms aren't moved again
    got = [(r["validation_label"], r["matched_block_id"], r["matched_snippet_raw"]) for r in sorted(found.collect(), key=lambda r: r["n"])]
    assert got == [(grounding.EXACT, "b0", "is al-pha"), (grounding.EXACT, "b9", "beta")]


def test_compact_keeps_what_one_class_kept(spark):
    texts = [chr(k) + "x" + chr(k) + " 9" for k in (*range(0x300), *range(0x2000, 0x2070), 0x3000, 0x4DFF, 0x4E00, 0x9FFF, 0xA000, 0xFFFD, 0xFFFF, 0x10000, 0x1F600, 0x10FFFF)]
    rows = spark.createDataFrame([(t,) for t in [*texts, "", "Été, 中 A-b"]], "t string")
    assert rows.where(~compact(F.col("t")).eqNullSafe(F.regexp_replace(F.lower("t"), r"[^0-9a-z一-鿿]+", ""))).count() == 0
