"""Scalar functions, prompts, parsers and reports against values worked out by hand."""

import json
import re
import unicodedata

import pytest
from pyspark.sql import functions as F

from folioscope.functions import geometry, prompts, scoring, text
from folioscope.operators import candidates, controls, evidence, grounding, layout, losses, manifests, paired, plugins, reports, retention, selection, vectors
from folioscope.sources import readers, writers
from folioscope.streaming import judged


def one(spark, column):
    return spark.range(1).select(column.alias("v")).first()["v"]


def array(values, kind="bigint"):
    return F.array(*[F.lit(v).cast(kind) for v in values]) if values else F.array().cast(f"array<{kind}>")


@pytest.mark.parametrize(("answer", "says_none"), [
    ("Not answerable", True), ("none\n", True), (" N/A ", True), ("", True), (None, True), ("There is no chart.", True), ("The page does not mention it", True),
    ("It cannot be found", True), ("unable to answer", True), ("isn't any information", True), ("isn't information", True), ("not stated", True), ("No information given", True),
    ("unanswerable", False), ("not enough", False), ("no answer", False), ("42", False),
])
def test_abstains(spark, answer, says_none):
    assert one(spark, text.abstains(F.lit(answer).cast("string"))) is says_none


@pytest.mark.parametrize(("answer", "final"), [
    ("Final answer:\n42", "42"), ("x\nfinal answer: a\nFinal answer: b \nrest", "b"), ("最终答案：七\n八", "七"), ("最终答案: 9", "9"), ("Final answer:  ", "Final answer:  "), ("plain", "plain"),
    ("Final Answer: c\rd", "c"),
])
def test_final_answer(spark, answer, final):
    assert one(spark, text.final_answer(F.lit(answer))) == final


@pytest.mark.parametrize(("answer", "bare"), [("<think>a\nb</think>\n c\n", "c"), ("a</think>b</think>\u00a0d", "d"), ("<think>only</think>", "<think>only</think>"), ("<THINK>x</THINK> y", "<THINK>x</THINK> y"), (None, "")])
def test_strip_think(spark, answer, bare):
    assert one(spark, text.strip_think(F.lit(answer).cast("string"))) == bare


def test_normal_forms(spark):
    assert one(spark, text.normalize_leak(F.lit("Ｃafé №5—über"))) == "caf no5 ber"
    assert one(spark, text.normalize_quote(F.lit("co\u00adop  re - used — ﬁne\u2013ly a -b"))) == "coop reusedfinely ab"
    assert one(spark, text.contains_quote(F.lit("The ﬁrst-class Caf\u00e9"), F.lit("firstclass caf")))
    assert one(spark, text.contains_quote(F.lit("a.b, c"), F.lit("A B C"))) and not one(spark, text.contains_quote(F.lit("caf\u00e9s"), F.lit("cafes")))
    assert not one(spark, text.contains_quote(F.lit("abc"), F.lit("é")))
    assert one(spark, text.first_non_empty(F.lit("\n\u00a0"), F.lit(None).cast("string"), F.lit("\t x \n"))) == "x"
    assert one(spark, text.packed_text(F.lit("\n a\nb \u00a0"), 0)) == "a b" and one(spark, text.packed_length(F.lit("ab \t cd"), 4)) == 5
    assert one(spark, text.choice_letter(F.lit("the answerC here"))) == "C" and one(spark, text.choice_letter(F.lit("I pick (b)."))) == "B"
    assert one(spark, text.snippet(F.lit("x" * 200 + " needle " + "y" * 300), F.lit("needle"))) == "x" * 72 + " needle " + "y" * 109
    assert one(spark, text.snippet(F.lit("abc" * 200), F.lit("zz"))) == ("abc" * 200)[:220]
    assert tuple(one(spark, text.interval(F.lit("+0.1 [−0.5, 2]")))) == (-0.5, 2.0) and one(spark, text.interval(F.lit("1"))) is None
    assert one(spark, text.is_unanswerable(array([" Not Answerable\n"], "string"))) and not one(spark, text.is_unanswerable(array([], "string")))


@pytest.mark.parametrize(("value", "page"), [("7", 7), (" +7\n", 7), ("7.7", None), ("1e3", None), ("0", None), ("-3", None), ("x", None), (None, None), ("99999999999", None)])
def test_page_number(spark, value, page):
    assert one(spark, readers.page_number(F.lit(value).cast("string"))) == page


def test_page_lists(spark):
    assert one(spark, readers.sorted_pages(array(["9", "2", "x", "2", "0"], "string"))) == [2, 9]
    assert one(spark, readers.sorted_blocks(array([" b2", "", "b1", "b2"], "string"))) == ["b1", "b2"]
    assert one(spark, readers.whole_number(F.lit(7.9))) == 7 and one(spark, readers.page_number(F.lit("-3"), None)) == -3


def plain_anls(pred, answers):
    def form(t):
        t = re.sub(r"[!-/:-@\[-`{-~]", " ", (t or "").lower())
        return " ".join(w for w in t.split() if w not in ("a", "an", "the"))

    def distance(a, b):
        row = list(range(len(b) + 1))
        for i, x in enumerate(a, 1):
            before, row[0] = row[0], i
            for j, y in enumerate(b, 1):
                before, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, before + (x != y))
        return row[-1]

    p, best = form(pred), 0.0
    for a in answers:
        g = form(a)
        if p and g:
            far = distance(p, g) / max(len(p), len(g))
            best = max(best, 1 - far if far < 0.5 else 0.0)
    return best


def test_anls_by_characters(spark):
    rows = [("Über den Wolken", ["uber den wolken", "x"]), ("日本語", ["日本"]), ("", ["a b"]), ("the cat", ["cat"]), ("kitten", ["sitting", "mitten"]), (None, [None]), ("ééé", ["eee"])]
    got = spark.createDataFrame(rows, "p string, a array<string>").select(scoring.anls(F.col("p"), F.col("a")).alias("v")).collect()
    assert [r["v"] for r in got] == pytest.approx([plain_anls(p, [a for a in x if a is not None]) for p, x in rows])


def test_prompts(spark):
    base, memory = F.lit("Q?"), F.lit("[第1页] m")
    assert one(spark, prompts.mode_prompt(base, memory, "pages")) == "Q?"
    assert one(spark, prompts.mode_prompt(base, memory, "pages_memory", "neutral")) == f"{prompts.TEXT_HEAD['neutral']}{prompts.ANSWER_TAIL}\n[第1页] m\n\nQ?"
    assert one(spark, prompts.mode_prompt(base, F.lit("\n "), "pages_memory_assoc")) == "Q?"
    assert "Final answer:" in one(spark, prompts.mode_prompt(base, memory, "pages_memory_selfask"))
    with pytest.raises(ValueError):
        prompts.mode_prompt(base, memory, "other")
    with pytest.raises(ValueError):
        prompts.text_memory(base, memory, "other")
    assert one(spark, prompts.visual_memory(base, array([]), "pages_crops")) == "Q?"
    crops = one(spark, prompts.visual_memory(base, array([3, 1]), "pages_crops"))
    assert "另附 2 张" in crops and "第3页、第1页" in crops and crops.endswith("\n\nQ?")
    assert "第1页、第3页" in one(spark, prompts.visual_memory(base, array([3, 1, 3]), "pages_highlight"))
    packed = one(spark, prompts.block_pack(base, array(["ab  cd", " ", "x"], "string"), 4))
    assert "[候选证据块1] ab..." in packed and "[候选证据块3] x" in packed and "块2]" not in packed
    assert one(spark, prompts.rerank_prompt(base, F.lit("z" * 300))).endswith("\n" + "z" * 256)
    q = lambda c, q_, k, d: one(spark, prompts.question_prompt(*[F.lit(x).cast("string") for x in (c, q_, k, d)]))
    assert q(None, " hi ", None, None) == "hi\nAnswer:" and q("ctx", "hi", None, "X") == "Context:\nctx\n\nQuestion:\nhi\nAnswer:"
    assert q("ctx", "hi", None, "SLIDEVQA").startswith("Context:\nctx\n\nQuestion: hi\nAnswer with the shortest") and q("c", "", None, None) == prompts.IMAGE_ONLY and q("c", "x", "throughput", None) == prompts.OK_ONLY
    assert one(spark, prompts.system_prompt(F.lit(None).cast("string"), F.lit("RealWorldQA"))) == prompts.SYSTEM["choice"]
    facts = F.array(*[F.struct(F.lit(p).cast("long").alias("page_id"), F.lit(t).alias("text")) for p, t in ((2, "b\nc"), (1, "a"), (2, "d"), (3, " "))])
    assert one(spark, prompts.grouped_memory(facts)) == "【证据组1 · 第2页】\n  - b c\n  - d\n【证据组2 · 第1页】\n  - a"
    assert one(spark, prompts.grouped_memory(facts, 1)) == "【证据组1 · 第2页】\n  - b c\n  - d"


def test_cells_and_geometry(spark):
    scores = array([1.0, 5.0, 5.0, 0.0, 0.0, 0.0, 0.0, 0.0, 2.0], "double")
    none = F.lit(None).cast("array<string>")
    score, rank = candidates.coarse_features(scores, none, F.lit(4), F.lit(2))
    assert (one(spark, score), one(spark, rank)) == (5.0, 0.5)
    listed = candidates.coarse_features(F.lit(None).cast("array<double>"), array(["p4_g00", "p4_g02"], "string"), F.lit(4), F.lit(2))
    assert [one(spark, c) for c in listed] == [0.5, 0.5]
    focus = candidates.focus_features(scores, F.lit(1), F.lit(0.5), F.lit(0.5))
    assert [round(one(spark, focus[k]), 6) for k in ("coarse_focus_match", "coarse_focus_dx", "coarse_focus_dy", "coarse_focus_l1")] == [1.0, 0.0, round(0.5 - 1 / 6, 6), round(0.5 - 1 / 6, 6)]
    box = F.struct(*[F.lit(v).cast("long").alias(n) for v, n in zip((0, 10, 50, 30), ("x0", "y0", "x1", "y1"), strict=True)])
    assert tuple(one(spark, geometry.crop_box(box, F.lit(51), F.lit(100)))) == (0, 8, 51, 32)
    assert tuple(one(spark, geometry.crop_size(box, F.lit(0.5)))) == (25, 10)
    assert one(spark, geometry.cell_name(F.lit(1), F.lit(None).cast("int"))) is None
    lattice = one(spark, retention.lattice(2, 3))
    assert [(round(x["row"], 3), round(x["column"], 3)) for x in lattice] == [(r, c) for r in (-0.5, 0.5) for c in (-0.667, 0.0, 0.667)]
    assert one(spark, retention.lattice_cell(F.lit(-0.9), F.lit(0.9))) == 2 and one(spark, retention.padded(array([4]), F.lit(3))) == [4, -1, -1]
    assert one(spark, retention.slices(array([1, 2, 3, 4]), array([1, 3]))) == [[1], [2, 3, 4]] and one(spark, retention.tokens_per_page(F.lit(1), F.lit(4), F.lit(6), 2)) == 6
    assert one(spark, retention.retained_count(F.lit(5), F.lit(0.5))) == 2 and one(spark, controls.ranges(F.lit(10), ((1, 9), (10, 20)))) == 1


def test_manifests(spark):
    e = F.array(*[F.struct(F.lit(p).cast("long").alias("page_id"), F.lit(b).cast("string").alias("block_id")) for p, b in ((3, "b1"), (1, " "), (3, "b1"), (None, "b2"))])
    assert one(spark, manifests.gold_pages(e)) == [1, 3] and [tuple(x) for x in one(spark, manifests.gold_blocks(e))] == [(3, "b1")]
    subset = one(spark, manifests.page_subset(array([1, 2, 3]), array(["a", "b", "c"], "string"), array([3, 1])))
    assert [tuple(x) for x in subset] == [(1, "a"), (3, "c")] and one(spark, manifests.page_subset(array([1]), array(["a", "b"], "string"), array([1]))) == []
    logits = array([0.1, 0.9, 0.5], "double")
    assert one(spark, manifests.training_pages(array([7, 8, 9]), logits, array([7]), F.lit(1))) == [7, 8] and one(spark, manifests.training_pages(array([7, 8, 9]), logits, array([7]), F.lit(3))) == [7, 8, 9]
    paths = one(spark, manifests.resolve_page_paths(F.lit("d"), array([], "string"), array([4, 7], "int"), "/r", "/m"))
    assert [tuple(x) for x in paths] == [(4, "/r/data/render/d/page_0004.png"), (7, "/r/data/render/d/page_0007.png")]
    assert [tuple(x) for x in one(spark, manifests.resolve_page_paths(F.lit("d"), array(["i/a.png", "/b/page_0009.png"], "string"), array([], "int"), "/r", "/m"))] == [(1, "/m/i/a.png"), (9, "/b/page_0009.png")]
    assert one(spark, manifests.document_path(F.lit(" "), "/r", F.lit("d"))) == "/r/data/documents/d.json" and one(spark, manifests.document_path(F.lit("/x.json"), "/r", F.lit("d"))) == "/x.json"
    assert manifests.manifest_path("/r", "a", "dev", lambda p: p == "/r/a/dev.jsonl") == "/r/a/dev.jsonl"
    with pytest.raises(FileNotFoundError):
        manifests.manifest_path("/r", "a", "dev", lambda p: False)
    assert [one(spark, manifests.dataset_tag(F.lit(x).cast("string"))) for x in (" V-NIAH", "vmqar", None)] == ["vniah", "vmqar", "other"]
    assert manifests.pixel_budget(None) is None and manifests.pixel_budget(1000, 0.25) == 250 and manifests.pixel_budget(1000, 1.0) == 1000
    with pytest.raises(ValueError):
        manifests.pixel_budget(10, 0)
    rows = spark.createDataFrame([("b", 1, None), ("a", 0, " "), ("c", 2, "bad")], "id string, n long, skip_reason string")
    assert [r["id"] for r in manifests.in_manifest_order(rows, rows.where("id <> 'c'"), "id", "n").collect()] == ["a", "b", "c"]
    assert {r["id"] for r in manifests.unskipped(rows).collect()} == {"a", "b"} and {r["id"] for r in manifests.allow_only(rows, rows.where("n = 1"), "id").collect()} == {"b"}
    with pytest.raises(ValueError, match="repeated"):
        manifests.ordered_ids(rows.unionByName(rows), "id", "n")
    with pytest.raises(ValueError, match="blank"):
        manifests.ordered_ids(spark.createDataFrame([(" ", 1)], "id string, n long"), "id", "n")
    assert sorted(r["id"] for r in manifests.pooled({"val": rows.select("id"), "test": rows.select("id")}, "id").collect())[:2] == ["test_a", "test_b"]
    kept, why = manifests.complete_documents(spark.createDataFrame([("a", [1, 2], 2), ("b", [1, 2], 1), ("c", [1, 2, 3], 3), ("d", [], 0)], "sample_id string, pages array<long>, n_present long"), 2)
    assert [r["sample_id"] for r in kept.collect()] == ["a"] and {r["why"]: r["n"] for r in why.collect()} == {"missing_pages": 1, "too_long": 1, "no_pages": 1}
    full = spark.createDataFrame([("x", 0, "t", None, None, "d", " q ", "yes", [(2, "b")], [1]), ("x", 1, None, "i", "s", None, None, None, [], [])], "dataset string, ordinal long, task_id string, id string, source_document_id string, document_id string, question string, answer string, evidence array<struct<page_id:long,block_id:string>>, pages array<long>")
    out = sorted(manifests.export_manifest(full).collect(), key=lambda r: r["ordinal"])
    assert (out[0]["sample_id"], out[0]["question"], out[0]["answers"], out[0]["gold_page_ids"]) == ("t", "q", ["yes"], [2]) and (out[1]["document_id"], out[1]["answers"]) == ("s", [])
    assert manifests.export_manifest(full, 1).count() == 1
    q = spark.createDataFrame([("a", "q", "x", [1]), ("b", "q", " ", [1]), ("c", "q", "x", [1])], "sample string, question string, answer string, gold_pages array<long>")
    rows, why = manifests.training_rows(q, spark.createDataFrame([("a", "m")], "sample string, memory string"))
    assert [r["sample"] for r in rows.collect()] == ["a"] and {r["why"]: r["n"] for r in why.collect()} == {"no_answer": 1, "no_memory": 1}


def test_sources_of_documents(spark, tmp_path):
    lists = [{"sample_id": "a", "ranked_page_ids": ["2"]}, {"id": " b ", "scores": [{"page_id": "1", "score": 0.1}, {"page_id": "3", "score": 0.9}]}, {"id": "", "page_ids": ["1"]}, {"id": "c"}]
    (tmp_path / "x.jsonl").write_text("\n".join(map(json.dumps, lists)))
    (tmp_path / "y.json").write_text(json.dumps(lists, indent=1))
    (tmp_path / "z.json").write_text(json.dumps({"predictions": lists}, indent=1))
    for name in ("x.jsonl", "y.json", "z.json"):
        assert {r["sample_id"]: r["ranked"] for r in readers.external_rankings(spark, str(tmp_path / name)).collect()} == {"a": [2], "b": [3, 1]}
    rows = spark.createDataFrame([("d", 1, ["p/page_0002.png", "p/page_0001.png"]), ("d", 0, ["q/page_0002.png"])], "document_id string, ordinal long, image_paths array<string>")
    pages = readers.manifest_documents(rows)
    assert {(r["page_id"], r["image_path"]) for r in pages.collect()} == {(2, "q/page_0002.png"), (1, "p/page_0001.png")}
    (tmp_path / "img").mkdir()
    (tmp_path / "img" / "page_0001.png").write_bytes(b"x")
    assert [r["page_id"] for r in readers.pages_present(pages, spark, str(tmp_path / "img")).collect()] == [1]
    doc = {"document_id": "d", "pages": [{"page_id": "1", "width": 10, "height": 20, "page_text": "whole-some", "blocks": [{"block_id": "b2", "text": "re-used", "order_index": 1}, {"block_id": "b1", "text": "x", "order_index": 0}]}]}
    (tmp_path / "d.json").write_text(json.dumps(doc))
    store = readers.document_store(spark, str(tmp_path / "d.json"))
    assert {(r["block_id"], r["text"], r["page_text"]) for r in readers.document_bundle(store).collect()} == {("b2", "reused", "wholesome"), ("b1", "x", "wholesome")}
    assert readers.page_layouts(store).first()["ordered"] == ["b1", "b2"]
    rows = spark.createDataFrame([("a", ("correct",)), ("b", ("error",))], "id string, judge struct<verdict:string>")
    assert {r["id"]: r["correct"] for r in readers.judged(rows, strict=False).collect()} == {"a": True, "b": None}
    with pytest.raises(ValueError, match="unjudged"):
        readers.judged(rows)
    ev = spark.createDataFrame([("s", [(1, "b", "t")])], "sample_id string, evidence array<struct<page_id:int,block_id:string,text_excerpt:string>>")
    assert [tuple(r) for r in readers.evidence_of({"x": ev, "y": ev}).collect()] == [("x", "s", 1, "b", "t"), ("y", "s", 1, "b", "t")]
    assert readers.latest_predictions(spark, "/none", "id string, v long", False).count() == 0
    (tmp_path / "p.jsonl").write_text('{"id":"a","v":1}\n{"id":"a","v":2}')
    assert readers.latest_predictions(spark, str(tmp_path / "p.jsonl"), "id string, v long", True).first()["v"] == 2
    (tmp_path / "t.jsonl").write_text('{"id":"a","answer":"x","images":["i","j"],"input_page_ids":["4"]}\n{"id":"b","answer":" ","images":["i"]}')
    assert [(r["id"], r["input_page_ids"]) for r in readers.training_examples(spark, str(tmp_path / "t.jsonl")).collect()] == [("a", [1, 2])]
    writers.store_by_document(store, str(tmp_path / "out"), spark.createDataFrame([("d", "e")], "document_id string, donor string"))
    assert spark.read.json(str(tmp_path / "out" / "_derangement")).first()["donor"] == "e"
    table = spark.createDataFrame([("m", 0.25)], "mode string, score double")
    assert writers.report("T", [("One", table, ["mode", "score"])]) == "# T\n\n## One\n\n| mode | score |\n| --- | --- |\n| m | 0.250 |\n"
    (tmp_path / "r.md").write_text("| a | b |\n|---|---|\n| x | 1 |\n| y | 2 |\n")
    assert reports.find_row(readers.markdown_tables(spark, str(tmp_path / "r.md")), "y").first()["cells"] == {"a": "y", "b": "2"}


def test_grounding_forms(spark):
    gold = evidence.gold_units(spark.createDataFrame([("s", [(4, " ", "re-used"), (5, "b", "t")])], "sample string, evidence array<struct<page_id:long,block_id:string,text_excerpt:string>>"))
    assert [tuple(r) for r in gold.collect()] == [("s", "e1", 4, None, "reused"), ("s", "e2", 5, "b", "t")]
    pred = json.dumps({"result": "r", "claims": [], "evidence": [{"evidence_id": " ", "quote": "x", "supports": ["c1", " "]}, {"evidence_id": "e2"}], "extra": 1})
    rows = grounding.cited(spark.createDataFrame([("s", "d", pred)], "sample string, document_id string, p string"), "p")
    known = gold.withColumn("supports", F.array(F.lit("c9")))
    done = {r["evidence_id"]: r for r in grounding.complete(rows, known).collect()}
    assert (done["e1"]["page_id"], done["e1"]["quote"], done["e1"]["supports"]) == (4, "x", ["c1"]) and (done["e2"]["block_id"], done["e2"]["quote"], done["e2"]["supports"]) == ("b", "t", ["c9"])
    frame = spark.createDataFrame([(pred,), ("no json",)], "p string")
    canon = [r["v"] for r in frame.select(grounding.canonical("p").alias("v")).collect()]
    assert list(json.loads(canon[0])) == ["result", "claims", "evidence"] and canon[1] is None
    assert json.loads(frame.select(grounding.replace_result("p", F.lit("new")).alias("v")).first()["v"])["result"] == "new"
    blocks = spark.createDataFrame([("d", 4, "b1", "nothing"), ("d", 5, "b", "some t here")], "document_id string, page_id long, block_id string, text string")
    judged_rows = grounding.citation_validity(spark.createDataFrame([("s", "d", 0, 4, None, "reused"), ("s", "d", 1, 5, "b", "t")], "sample string, document_id string, n int, page_id long, block_id string, quote string"), blocks)
    out = {r["n"]: r["validity"] for r in grounding.with_gold_fallback(judged_rows, gold).collect()}
    assert out == {0: 0.5, 1: 1.0}


def test_losses_and_scorers(spark):
    rows = spark.createDataFrame([("g", i, i < 2, s) for i, s in enumerate([0.1, 0.9, 0.8, 0.5, 0.2])], "g string, i long, pos boolean, s double")
    got = losses.budget_margin(rows, "g", F.col("pos"), F.col("s"), ["i"], 3, 0.2).first()
    assert got["loss"] == pytest.approx((max(0, 0.2 - 0.1 + 0.5) + max(0, 0.2 - 0.9 + 0.5)) / 2) and got["pairs"] == 2
    assert losses.budget_margin(rows, "g", F.col("pos"), F.col("s"), ["i"], 9, 0.2).count() == 0
    got = losses.weighted_loss(spark.createDataFrame([(1.0, None), (3.0, 4.0)], "a double, b double"), {"a": 1.0, "b": 0.5}).first()
    assert (got["loss"], got["n_a"], got["n_b"]) == (4.0, 2, 1)
    assert {r["i"] for r in losses.boundary_negatives(rows, "g", F.col("pos"), F.col("s"), ["i"], 3, 1).collect()} == {3}
    assert {r["membership"] for r in losses.soft_membership(rows, "g", "s", ["i"], 0, 1.0).collect()} == {0.0}
    dropped = candidates.drop_lexical(spark.createDataFrame([("q", 1.0, 1.0, 2.0)], "qid string, lexical_score_log double, lexical_overlap_ratio double, other double"), 1.0, F.col("qid")).first()
    assert tuple(dropped) == ("q", 0.0, 0.0, 2.0)
    assert one(spark, vectors.linear_score([F.lit(2.0), F.lit(3.0)], [0.5, 1.0], 1.0)) == 5.0 and one(spark, vectors.yes_no_margin(array([-1.0, -3.0], "double"), array([-4.0], "double"))) == 2.0
    train = spark.createDataFrame([(float(i), float(i % 3), int(i > 30)) for i in range(40)], "a double, b double, y int")
    weights, bias = vectors.fit_selector(train, ["a", "b"], "y")
    assert weights[0] > 0 and len(weights) == 2
    soft = vectors.in_page_residual(spark.createDataFrame([("p", 0.0), ("p", 0.0)], "page string, s double"), ["page"], "s", (1.0, 1.0, 1.0)).collect()
    assert {r["context_score"] for r in soft} == {0.0}
    win = paired.win_share(spark.createDataFrame([(1.0, 2.0), (2.0, 1.0), (None, 3.0)], "a double, b double"), F.col("a"), F.col("b")).first()
    assert tuple(win) == (2, 0.5, 0.0)
    both = paired.paired_with_interval(spark.createDataFrame([(i, 0.0, 1.0) for i in range(9)], "i long, a double, b double"), F.col("a"), F.col("b"), 200).first()
    assert both["mean_diff"] == both["lo"] == both["hi"] == 1.0


def test_retention_over_layers(spark):
    rows = [("s", layer, 0, t, h, 0.1 * t + 0.01 * h, 0.2 * t, t > 2) for layer in (0, 1) for t in range(4) for h in (0, 1)]
    stats = retention.layer_page_stats(spark.createDataFrame(rows, "s string, layer int, page int, token int, head int, score double, gate double, selected boolean"), "s")
    r = stats.where("layer = 0").first()
    assert (r["tokens"], r["selected"], r["selected_ratio"]) == (4, 1, 0.25) and r["peak"] == pytest.approx(0.31) and r["focus"] == pytest.approx(0.31) and r["gate_low"] == 0.75
    pages = retention.over_layers(stats, "s", spark.createDataFrame([("s", 0), ("s", 1)], "s string, page int"))
    got = {r["page"]: r for r in pages.collect()}
    assert got[0]["layers"] == 2 and got[1]["page_score"] == 0.0 and got[1]["gate_mean"] is None
    tokens = spark.createDataFrame([("s", 0, i % 9, float(i)) for i in range(18)], "s string, page int, cell int, score double")
    assert retention.page_logits(tokens.withColumn("i", F.col("score")), ["s"], "i").first()["logit"] == pytest.approx(0.5 * (17 + 16 + 15 + 14) / 4 + 0.5 * 17)
    cells = retention.cell_statistics(tokens.withColumn("i", F.col("score")), ["s", "page"], "i")
    assert retention.retained_blocks(pages.where("page = 0"), cells, "s", 2).first()["block_ids"] == ["p0_g21", "p0_g22"]
    assert retention.score_spread(spark.createDataFrame([(1.0,), (3.0,)], "mean double")).first()["mean_range"] == 2.0


def test_selection_stages(spark):
    rows = spark.createDataFrame([("s", 1, f"b{i}", i, i, float(i % 3), float(-i)) for i in range(5)], "s string, page_id long, block_id string, page_rank long, order_index long, lexical_score double, model double")
    ids = lambda kind, **k: [r["block_id"] for r in selection.block_stage(rows, "s", kind, 2, **k).orderBy("rank").collect()]
    assert ids("none") == [] and ids("lexical") == ["b2", "b1"] and ids("model", rescored="model") == ["b0", "b1"] and len(ids("random")) == 2
    with pytest.raises(ValueError):
        ids("other")
    a = spark.createDataFrame([("d", "x")], "document_id string, t string")
    b = spark.createDataFrame([("d", "y"), ("e", "z")], "document_id string, t string")
    assert {(r["t"], r["source"]) for r in selection.choose_store(a, b).collect()} == {("x", "ocr"), ("z", "text_layer")}
    with pytest.raises(ValueError, match="unrecognised"):
        selection.choose_store(a, b, required=True)
    grid = spark.createDataFrame([("p", r, c) for r in range(4) for c in range(4)], "p string, r long, c long")
    assert {(x["r"], x["c"]) for x in selection.spatial_keep(grid, ["p"], "r", "c", 2, 2).collect()} == {(0, 0), (0, 2), (2, 0), (2, 2)}
    assert reports.sample_fidelity(spark.createDataFrame([("s", 0.5), ("s", 1.0), ("s", None)], "s string, v double"), "s", "v").first().asDict() == {"s": "s", "fidelity_min": 0.5, "fidelity_mean": 0.75, "n_evidence": 2}
    assert spark.createDataFrame([(True,), (None,)], "f boolean").agg(reports.full_recall_rate(F.col("f")).alias("v")).first()["v"] == 0.5
    verdict = lambda v, m="judge": one(spark, reports.row_score(F.lit(v).cast("string"), F.lit(True), F.lit(None).cast("double"), m))
    assert [verdict("correct"), verdict("partial"), verdict("error"), verdict(None, "anls")] == [1.0, 0.0, None, 0.0]


def test_plugins_and_repair(spark, tmp_path):
    tried = spark.createDataFrame([(1, "a"), (2, "b")], "id long, t string")
    from folioscope.operators.plugins import rowwise, two_call

    out = plugins.apply(tried, "up", rowwise(lambda r: {"u": r["t"].upper()}, threads=2, retries=1), ["t"], "u string")
    assert {r["u"] for r in out.collect()} == {"A", "B"}
    both = two_call(tried, ("x", rowwise(lambda r: {"e": r["t"] * 2}), "e string"), ("y", rowwise(lambda r: {"answer": r["e"] + "!"}), "answer string"), ["t"])
    assert {r["answer"] for r in both.collect()} == {"aa!", "bb!"}
    rows = spark.createDataFrame([(1, "error"), (2, "ok"), (3, None)], "id long, verdict string")
    regrade = lambda bad: bad.withColumn("verdict", F.when(F.col("id") == 1, "ok"))
    assert {r["id"]: r["verdict"] for r in judged.repair(rows, regrade, "id", "verdict", F.col("verdict") == "error").collect()} == {1: "ok", 2: "ok", 3: None}
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "a.json").write_text('{"id":1,"verdict":"error"}\n{"id":2,"verdict":"ok"}')
    stream = judged.read_shards(spark, str(tmp_path / "in"), "id long, verdict string")
    judged.append_repaired(stream, str(tmp_path / "out"), str(tmp_path / "check"), regrade, "id", "verdict", F.col("verdict") == "error").awaitTermination(60)
    assert {r["id"]: r["verdict"] for r in spark.read.parquet(str(tmp_path / "out")).collect()} == {1: "ok", 2: "ok"}
    lines = spark.createDataFrame([(1, 1, 100.0, [[0.0, 0.0], [40.0, 10.0]], "one.two", 0.9), (1, 1, 100.0, [[0.0, 12.0], [40.0, 22.0]], "three", 0.9), (1, 1, 100.0, [[0.0, 80.0], [9.0, 90.0]], "noise", 0.1)], "document_id long, page_id long, page_width double, polygon array<array<double>>, text string, score double")
    assert [(r["block_id"], r["text"]) for r in layout.recognised_blocks(lines).collect()] == [("p1_b1", "one. two three")]


def test_unicode_forms_match_python(spark):
    samples = ["ﬁx ①②", "Ａ１", "e\u0301"]
    got = spark.createDataFrame([(s,) for s in samples], "t string").select(text.nfkc("t").alias("v")).collect()
    assert [r["v"] for r in got] == [unicodedata.normalize("NFKC", s) for s in samples]
