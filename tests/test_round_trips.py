"""Resampling, guards, late grades, readers and cited answers against values worked out by hand or by plain code."""

import json

import numpy as np
import pytest
from pyspark.sql import functions as F

from folioscope.functions import grounded
from folioscope.operators import candidates, controls, evidence, grounding, layout, resampling, selection, sets
from folioscope.sources import readers
from folioscope.streaming import judged

# Resampling -----------------------------------------------------------------


def test_bootstrap_draws_as_a_plain_version(spark, monkeypatch):
    monkeypatch.setattr(resampling, "PER_BUCKET", 10)
    rng = np.random.default_rng(2)
    values = [float(x) for x in rng.integers(-30, 30, 500)]
    rows = spark.createDataFrame([(v,) for v in [*values, None, float("nan")]], "d double").repartition(5)
    got = {r["rep"]: r["mean"] for r in resampling.bootstrap_means(rows, "d", 300, 9).collect()}
    distinct, counts = np.unique(values, return_counts=True)
    at = {r["v"]: r["b"] for r in spark.createDataFrame([(float(v),) for v in distinct], "v double").select("v", F.pmod(F.xxhash64("v"), F.lit(-(-len(distinct) // 10))).alias("b")).collect()}
    names = sorted(set(at.values()))
    totals = np.asarray([sum(int(c) for v, c in zip(distinct, counts) if at[v] == b) for b in names])
    dealt, sums = resampling.shares(totals, 300, 9), np.zeros(300)
    for k, b in enumerate(names):
        split = resampling.Split(dealt[:, k], totals[k], 9, b)
        for v, c in zip(distinct, counts):
            if at[v] == b:
                split.add(float(v), int(c))
        assert (split.left == 0).all() and split.mass == 0
        sums += split.sums
    assert [got[r] for r in range(300)] == pytest.approx(list(sums / len(values)))


def test_bootstrap_interval(spark):
    rng = np.random.default_rng(3)
    values = rng.normal(2, 5, 4000)
    rows = spark.createDataFrame([(float(v),) for v in values], "d double")
    r = resampling.bootstrap_interval(rows, "d", 2000).first()
    half = 1.96 * values.std() / np.sqrt(len(values))
    assert r["lo"] == pytest.approx(values.mean() - half, abs=0.03) and r["hi"] == pytest.approx(values.mean() + half, abs=0.03)
    assert resampling.bootstrap_interval(rows.repartition(7), "d", 2000).first() == r
    none = resampling.bootstrap_interval(rows.where("d IS NULL"), "d", 50).first()
    assert (none["replicates"], none["lo"], none["hi"]) == (50, None, None)


# Guards ---------------------------------------------------------------------


def test_guards_count_in_the_pass_that_yields_the_rows(spark, tmp_path):
    arm = spark.createDataFrame([("a", [1, 2], 16, "ocr"), ("b", [3], 15, "ocr"), ("c", None, 16, None), ("x", [9], 16, "ocr")], "id string, selected_page_ids array<int>, num_selected_pages int, memory_block_source string")
    base = spark.createDataFrame([("a",), ("b",), ("c",), ("d",)], "id string")
    images = spark.createDataFrame([("a", [1, 2]), ("b", [4]), ("c", None)], "id string, selected_page_ids array<int>")
    guards = sets.Guards()
    controls.guarded_arms(guards, "arm", arm, base, images).write.parquet(f"{tmp_path}/arm")
    assert guards.counts() == {"arm": {"rows": 5, "unpaired": 2, "pages_moved": 1, "budget_moved": 1, "other_source": 1}}
    with pytest.raises(sets.GuardError, match="arm.unpaired: 2 rows"):
        guards.check()
    with pytest.raises(ValueError):
        guards.watch("arm", base)
    sound = sets.Guards()
    controls.guarded_arms(sound, "arm", arm.where("id = 'a'"), base.where("id = 'a'"), images.where("id = 'a'")).collect()
    assert sound.check() == {"arm": {"rows": 1, "unpaired": 0, "pages_moved": 0, "budget_moved": 0, "other_source": 0}}


# Late grades ----------------------------------------------------------------


def test_a_late_good_grade_replaces_an_earlier_batch_also_after_a_restart(spark, tmp_path):
    source, path, check = f"{tmp_path}/in", f"{tmp_path}/out", f"{tmp_path}/check"
    bad = F.col("verdict") == "error"
    schema = "id string, verdict string, at long"

    def arrive(name, rows):
        (tmp_path / "in").mkdir(exist_ok=True)
        (tmp_path / "in" / name).write_text("\n".join(json.dumps(dict(zip(("id", "verdict", "at"), r))) for r in rows))
        query = judged.append_versions(judged.read_shards(spark, source, schema), path, check, "id", "verdict", bad, "at")  # each time a new query over the same checkpoint
        query.awaitTermination()

    seen = lambda: {r["id"]: (r["verdict"], r["batch"]) for r in judged.latest(spark, path, "id", "verdict", bad, "at").collect()}
    arrive("1.json", [("a", "error", 1), ("b", "correct", 1), ("c", None, 1), ("b", "error", 2)])
    assert seen() == {"a": ("error", 0), "b": ("correct", 0), "c": (None, 0)}
    arrive("2.json", [("a", "partial", 3), ("b", "error", 3)])
    assert seen() == {"a": ("partial", 1), "b": ("correct", 0), "c": (None, 0)}
    arrive("3.json", [("c", "correct", 1), ("a", "correct", 4), ("d", "error", 1)])
    want = {"a": ("correct", 2), "b": ("correct", 0), "c": ("correct", 2), "d": ("error", 2)}
    assert seen() == want
    judged.compacted(spark, path, f"{tmp_path}/small", "id", "verdict", bad, "at")
    assert {r["id"]: (r["verdict"], r["batch"]) for r in judged.latest(spark, f"{tmp_path}/small", "id", "verdict", bad, "at").collect()} == want


# Readers --------------------------------------------------------------------


def test_rankings_of_repeated_samples(spark, tmp_path):
    rows = [{"sample_id": "a", "ranked_page_ids": [9, 1]}, {"id": "b", "scores": [{"page_id": 4, "score": 1.0}, {"page_id": "0", "score": 1.0}, {"page_id": "x", "score": 9.0}]},
            {"sample_id": "a", "ranked_page_ids": ["2", 0, -1, "2", "z"]}, {"sample_id": "a", "ranked_page_ids": []}, {"sample_id": "b", "selected_page_ids": [5]}, {"sample_id": " ", "ranked_page_ids": [1]}]
    want = {"a": [2, 0, -1], "b": [0, 4]}
    for name, text in (("r.jsonl", "\n".join(map(json.dumps, rows))), ("list.json", json.dumps(rows)), ("object.json", json.dumps({"predictions": rows}))):
        (tmp_path / name).write_text(text)
        assert {r["sample_id"]: r["ranked"] for r in readers.external_rankings(spark, str(tmp_path / name)).collect()} == want
    one, two, broken = tmp_path / "1.jsonl", tmp_path / "2.jsonl", tmp_path / "3.jsonl"
    one.write_text('{"sample_id": "s", "ranked_page_ids": [4]}\n{"sample_id": "s", "ranked_page_ids": [6, 7]}\n{"sample_id": "t", "ranked_page_ids": [1]}')
    two.write_text('{"sample_id": "s", "ranked_page_ids": []}\n{"sample_id": "t", "ranked_page_ids": [3, 2]}')
    broken.write_text('{"sample_id": "s", "ranked')
    assert {r["sample_id"]: r["ranked"] for r in readers.rankings(spark, [str(one), str(two)], 1).collect()} == {"s": [6], "t": [3]}
    with pytest.raises(Exception, match="MALFORMED|FAILFAST|[Mm]alformed"):
        readers.rankings(spark, [str(one), str(broken)]).collect()


def test_broken_documents_and_page_names(spark, tmp_path):
    (tmp_path / "d.json").write_text('{"document_id": "d", "pages": [')
    with pytest.raises(Exception, match="MALFORMED|FAILFAST|[Mm]alformed"):
        readers.document_store(spark, str(tmp_path / "d.json")).collect()
    names = {"page_0012.png": 12, "PAGE_3.PNG": 3, "scan_7.jpg": 7, "scan_8.JPEG": 8, "x_12.pdf": None, "page_5.gif": None, "page12.png": None}
    got = spark.createDataFrame([(n,) for n in names], "n string").select("n", readers.image_page(F.col("n")).alias("p")).collect()
    assert {r["n"]: r["p"] for r in got} == names


def test_ids_of_any_kind_and_ordinals(spark):
    lines = spark.createDataFrame([("doc-a", "p1", 100.0, 0.0, 0.0, 40.0, 10.0, "one"), ("doc-a", "p1", 100.0, 0.0, 12.0, 40.0, 22.0, "two"), ("doc-a", "p2", 100.0, 0.0, 0.0, 9.0, 9.0, "x")], "document_id string, page_id string, page_width double, x0 double, y0 double, x1 double, y1 double, text string")
    assert {(r["document_id"], r["page_id"], r["text"]) for r in layout.line_blocks(lines).collect()} == {("doc-a", "p1", "one two"), ("doc-a", "p2", "x")}
    rows = spark.createDataFrame([(1, 1, "b", 0, 0)], "qid long, page_id long, block_id string, page_rank int, order_index int")
    teacher = spark.createDataFrame([(1, "1::b", 9.0, 1), (1, "1::b", 2.0, 2)], "qid long, key string, score double, ordinal int")
    assert candidates.attach_teacher(rows, teacher).first()["teacher_score"] == 2.0 and candidates.attach_teacher(rows, teacher.drop("ordinal")).first()["teacher_score"] == 9.0
    scores = spark.createDataFrame([("s", "f1", 1.0, "old", 1), ("s", "f1", 0.5, "new", 2)], "sample string, fact string, score double, reason string, ordinal int")
    expected = spark.createDataFrame([("s", "f1"), ("s", "f2")], "sample string, fact string")
    assert {(r["fact"], r["score"], r["reason"]) for r in evidence.expected_scores(expected, scores, "fact", "none").collect()} == {("f1", 0.5, "new"), ("f2", 0.0, "none")}
    memory = spark.createDataFrame([("s", 1, "b", 0, "text", 0, 5)], "sample string, page_id long, block_id string, order_index int, text string, budget int, lexical_score int")
    with pytest.raises(Exception, match="budget above 0"):
        selection.select_memory(memory, "sample", "random_chars", budget="budget").collect()
    assert selection.lexical_selection(memory.withColumn("page_rank", F.lit(0)), "sample", 0).count() == 1


# Cited answers --------------------------------------------------------------

PAGES = [("d", 1, "Alpha beta gamma delta epsilon"), ("d", 2, "Nothing here of note")]
BLOCKS = [("d", 1, "p1_b0", 0, "Alpha beta"), ("d", 1, "p1_b1", 1, "gamma delta epsilon"), ("d", 1, "p1_b2", 2, "only a block has zeta"), ("d", 2, "p2_b0", 0, "Nothing here of note")]
UNITS = [("s", 1, "", "", 2, "p2_b9", "Gold excerpt  of theta"), ("s", 2, "g2", "f9", 1, "p1_b1", "gamma delta"), ("s", 3, "g2", "", 1, "p1_b0", "Alpha beta")]


def answer(items, result="R"):
    return json.dumps({"result": result, "claims": [], "evidence": items}, ensure_ascii=False)


@pytest.fixture(scope="module")
def evaluate(spark):
    pages = spark.createDataFrame(PAGES, "document_id string, page_id int, page_text string")
    blocks = spark.createDataFrame(BLOCKS, "document_id string, page_id int, block_id string, order_index int, text string")
    units = spark.createDataFrame(UNITS, "sample string, n_unit int, evidence_id string, fact_id string, page_id int, block_id string, text_excerpt string")
    return lambda rows: {r["sample"]: r for r in grounding.hard_evaluation(spark.createDataFrame(rows, "sample string, document_id string, pred string"), units, pages, blocks).collect()}


def test_citations_are_looked_for_in_four_places(evaluate):
    cite = lambda e, p, b, q: {"evidence_id": e, "page_id": p, "block_id": b, "quote": q, "supports": ["c1"]}
    items = [
        cite("x1", 1, "p1_b0", "alpha  BETA"), cite("x2", 1, "p1_b1", "Alpha beta"), cite("x3", 1, "p1_b0", "beta gamma"), cite("x4", 1, "p1_b0", "has zeta"), cite("x5", 2, "p2_b9", "of theta"),
        cite("x6", 2, "p2_b0", "excerpt of"), {"evidence_id": "g2"}, cite("x8", 7, "p7_b0", "Alpha"), cite("x9", 1, "p1_b0", " "),
    ]
    got = evaluate([("s", "d", f"Sure: {answer(items)} so"), ("cut", "d", answer(items)[:-40])])
    s = got["s"]
    seen = [(e["evidence_id"], e["validation_label"], e["validation_score"], e["matched_page_id"], e["matched_block_id"], e["matched_snippet_raw"]) for e in s["verified_evidence"]]
    exact, page, no = grounding.EXACT, grounding.ON_PAGE, grounding.INVALID
    assert seen == [
        ("x1", exact, 1.0, 1, "p1_b0", "Alpha beta"), ("x2", page, 0.5, 1, None, PAGES[0][2]), ("x3", page, 0.5, 1, None, PAGES[0][2]), ("x4", page, 0.5, 1, "p1_b2", "only a block has zeta"),
        ("x5", exact, 1.0, 2, "p2_b9", "Gold excerpt  of theta"), ("x6", page, 0.5, 2, "p2_b9", "Gold excerpt  of theta"), ("g2", exact, 1.0, 1, "p1_b0", "Alpha beta"), ("x8", no, 0.0, None, None, ""), ("x9", no, 0.0, None, None, ""),
    ]
    assert s["verified_evidence"][4]["matched_snippet"] == "Gold excerpt of theta" and s["verified_evidence"][6]["supports"] == ["f3"]
    assert (s["available"], s["structured"], s["result_text"], s["n_evidence"]) == (True, True, "R", 9)
    assert (s["citation_score"], s["exact_rate"], s["page_only_rate"], s["invalid_rate"]) == pytest.approx((5.0 / 9, 3 / 9, 4 / 9, 2 / 9))
    assert not got["cut"]["available"] and got["cut"]["citation_score"] is None and got["cut"]["structured"]


def test_answers_without_citations_or_json(evaluate):
    got = evaluate([("s", "d", "just  words"), ("t", "d", None)])
    assert (got["s"]["citation_score"], got["s"]["result_text"], got["s"]["structured"], got["s"]["n_evidence"], got["s"]["exact_rate"]) == (0.0, "just words", False, 0, None)
    assert (got["t"]["available"], got["t"]["result_text"]) == (False, "")


def test_grounded_prompts(spark):
    one = lambda c: spark.range(1).select(c.alias("v")).first()["v"]
    system, user = grounded.grounded_prompt(F.lit(" S \n"), F.lit("U"), "plan")
    assert one(system).startswith("S\n\n你必须输出一个严格合法的 JSON 对象") and one(system).endswith("不输出最终答案。")
    assert one(user).startswith('U\n\n请严格输出如下 JSON 结构：\n{\n  "claims": [{"claim_id"') and one(user).endswith("但 JSON 结构仍必须完整。\n")
    assert '  "result": "... 或结构化对象 ...",\n' in one(grounded.grounded_prompt(F.lit("S"), F.lit("U"), "grounded_json")[1])
    assert (grounded.prefill("plan"), grounded.prefill(None), grounded.prefill("pref")) == ('{"claims":', '{"result":', '{"result":')
    with pytest.raises(ValueError):
        grounded.phase("other")
    wants = lambda k, m: one(grounded.wants_grounding(F.lit(k).cast("string"), F.lit(m).cast("string")))
    assert wants(None, " Grounded_JSON ") and not wants("throughput", "grounded_json") and not wants(None, None)


def test_refine_prompt(spark):
    one = lambda c: spark.range(1).select(c.alias("v")).first()["v"]
    item = lambda raw, snippet, quote: F.struct(F.lit(raw).cast("string").alias("matched_snippet_raw"), F.lit(snippet).cast("string").alias("matched_snippet"), F.lit(quote).cast("string").alias("quote"))
    snippets = grounded.refine_snippets(F.array(item(" one ", "x", "x"), item("", "", " "), item(None, "two", "x"), item("", None, "three"), item("four", "", "")))
    system, user = grounded.refine_prompt(F.lit(" Q? "), snippets, F.lit(0.5), F.lit("quote_extract"))
    assert one(user) == "问题：Q?\n\n证据：\n[证据1] one\n[证据2] two\n[证据3] three\n\n请只输出最终答案。"
    assert one(system).startswith("你是一个严格的基于证据的答案抽取器。 只能依据") and one(system).endswith("不要输出引号。")
    for score, mode in ((0.0, "quote_extract"), (None, "quote_extract"), (1.0, "other")):
        assert one(grounded.refine_prompt(F.lit("Q"), snippets, F.lit(score).cast("double"), F.lit(mode))[1]) is None


def test_judge_messages(spark):
    one = lambda c: spark.range(1).select(c.alias("v")).first()["v"]
    facts = F.array(F.struct(F.lit("f1").alias("fact_id"), F.lit("é\"\n").alias("text")))
    system, user = grounded.judge_messages({"query": F.lit("Q"), "gold_atomic_facts": facts, "pred_claims": F.array().cast("array<string>")})
    payload = {f: None for f in grounded.JUDGE_FIELDS} | {"query": "Q", "gold_atomic_facts": [{"fact_id": "f1", "text": "é\"\n"}], "pred_claims": []}
    assert one(user) == "下面是当前样本的评分输入数据（JSON）：\n" + json.dumps(payload, ensure_ascii=False, indent=2)
    assert one(system).startswith("你是一个严格的 long-document grounded benchmark judge。\n") and '\n    "所有分数只能取 0、0.25、0.5、0.75、1.0 五档。",\n' in one(system)
    assert list(json.loads(one(system).split("\n", 2)[2])) == ["role", "instructions", "required_output_schema", "scoring_rules"]
    with pytest.raises(ValueError):
        grounded.judge_messages({"other": F.lit(1)})
