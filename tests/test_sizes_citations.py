"""Quote forms are made once a container, and what holds no quote doesn't leave the join."""

from folioscope.operators import grounding


def test_the_join_tells_what_holds_a_quote(spark):
    evidence = spark.createDataFrame([("s", "d", 0, "e1", 1, "b0", "Alpha", ["c"]), ("s", "d", 1, "e2", 1, "b0", "", ["c"])], "sample string, document_id string, n int, evidence_id string, page_id int, block_id string, quote string, supports array<string>")
    pages = spark.createDataFrame([("d", 1, "alpha - beta"), ("d", 2, None)], "document_id string, page_id int, page_text string")
    blocks = spark.createDataFrame([("d", 1, "b0", 0, " "), ("d", 1, "b1", 1, "alpha")], "document_id string, page_id int, block_id string, order_index int, text string")
    units = spark.createDataFrame([("s", 1, 1, "b0", "beta")], "sample string, n_unit int, page_id int, block_id string, text_excerpt string")
    found = grounding.verified(evidence, pages, blocks, units)
    plan = found._jdf.queryExecution().optimizedPlan().toString().splitlines()
    joins = [line for line in plan if "Join LeftOuter" in line]
    assert len(joins) == 2 and all("Contains(" in line or "contains(" in line.lower() for line in joins)
    assert not [line for line in plan if "Filter" in line and "regexp_replace" in line]  # forms made a second time
    assert [(r["validation_label"], r["matched_block_id"]) for r in sorted(found.collect(), key=lambda r: r["n"])] == [(grounding.ON_PAGE, None), (grounding.INVALID, None)]
