import math

import pytest
from pyspark.sql import functions as F

from folioscope.functions import geometry, scoring, text
from folioscope.operators import controls, layout, paired, selection, sets


def one(spark, column):
    return spark.range(1).select(column.alias("v")).first()["v"]


def lit(x):
    return F.array(*[F.lit(v) for v in x]) if isinstance(x, list) else F.lit(x)


@pytest.mark.parametrize(("pred", "answers", "expected"), [("23", ["23"], 1.0), ("foo", ["foo", "foo", "bar"], 2 / 3), ("", ["x"], 0.0)])
def test_soft_accuracy(spark, pred, answers, expected):
    assert one(spark, scoring.soft_accuracy(F.lit(pred), lit(answers))) == pytest.approx(expected)


def test_soft_accuracy_without_answers(spark):
    assert one(spark, scoring.soft_accuracy(F.lit("foo"), F.array().cast("array<string>"))) == 0.0


def test_normalize_answer(spark):
    assert one(spark, text.normalize_answer(F.lit("The  quick-brown, Fox!"))) == "quick brown fox"


def test_anls_and_numeric(spark):
    assert one(spark, scoring.anls(F.lit("kitten"), lit(["sitten"]))) == pytest.approx(1 - 1 / 6)
    assert one(spark, scoring.anls(F.lit("abc"), lit(["xyz"]))) == 0.0
    assert one(spark, scoring.relaxed_numeric(F.lit("100"), lit(["100.5"]), compat=False)) == 1.0
    assert one(spark, scoring.relaxed_numeric(F.lit("3.14"), lit(["3.15"]))) == 0.0  # points are spaces in the compatible form


@pytest.mark.parametrize(("dataset", "pred", "answers", "score"), [("RealWorldQA", "B", ["b"], 1.0), ("OCRBench-v2", "it says hello world", ["hello world"], 1.0), ("other", "x", ["x", "y"], 0.5)])
def test_score_by_dataset(spark, dataset, pred, answers, score):
    assert one(spark, scoring.score_by_dataset(F.lit(dataset), F.lit(pred), lit(answers)))["score"] == score


@pytest.mark.parametrize(("answer", "verdict"), [('{"verdict": "Correct", "reason": "r"}', "correct"), (r'{"verdict": "partial", "reason": "a \c"}', "partial"), ("verdict: incorrect", "incorrect"), ("?", None)])
def test_parse_verdict(spark, answer, verdict):
    got = one(spark, scoring.parse_verdict(F.lit(answer)))
    assert (got and got["verdict"]) == verdict


def test_judge_mix(spark):
    got = one(spark, scoring.grounded_mix(F.lit(0.75), F.lit(0.75), F.lit(0.5), F.lit(0.5)))
    assert (got["judge"], got["grounded"]) == pytest.approx((0.7, 0.66))


def test_packed_length(spark):
    assert one(spark, text.packed_length(F.lit("x" * 400), 300)) == 303
    assert one(spark, text.packed_length(F.lit(None).cast("string"), 300)) == 0


def test_stable_score_matches_python(spark):
    import hashlib

    parts = ["seed", "3", "p3_b1", "7"]
    want = int.from_bytes(hashlib.sha256("\x1f".join(parts).encode()).digest()[:8], "big") / 2**64
    assert one(spark, text.stable_score(*[F.lit(p) for p in parts])) == want


def test_final_answer_and_think(spark):
    assert one(spark, text.final_answer(F.lit("why\nFinal answer: 42\nmore"))) == "42"
    assert one(spark, text.strip_think(F.lit("<think>a</think> b"))) == "b"
    assert one(spark, text.strip_think(F.lit("a</think>b"))) == "b"


def test_contains_quote_and_coverage(spark):
    assert one(spark, text.contains_quote(F.lit("The Big-Cat sat"), F.lit("bigcat")))
    assert not one(spark, text.contains_quote(F.lit("abc"), F.lit("  ")))
    assert one(spark, text.token_coverage(lit(["a", "a", "b"]), lit(["a", "b", "b"]))) == pytest.approx(2 / 3)


def test_geometry(spark):
    box = geometry.scale_box(*[F.lit(float(v)) for v in (20, 30, 60, 90, 200, 300, 100, 150)])
    assert tuple(one(spark, box)) == (10, 15, 30, 45)
    assert one(spark, geometry.reader_scale(F.lit(400.0), F.lit(600.0), F.lit(60000.0))) == 0.5
    cell = geometry.coarse_cell(*[F.lit(float(v)) for v in (220, 220, 290, 290, 300, 300)])
    assert one(spark, geometry.cell_name(F.lit(1), cell)) == "p1_g22"
    assert one(spark, geometry.coarse_cell(*[F.lit(float(v)) for v in (5, 5, 5, 9, 10, 10)])) is None


def arms_frame(spark, b, c, same):
    rows = [(False, True)] * b + [(True, False)] * c + [(True, True)] * same
    return spark.createDataFrame(rows, "x boolean, y boolean")


@pytest.mark.parametrize(("b", "c", "p"), [(18, 4, 0.005578), (11, 12, 1.0)])
def test_mcnemar_golden(spark, b, c, p):
    row = paired.with_p(paired.mcnemar(arms_frame(spark, b, c, 100), F.col("x"), F.col("y"))).first()
    assert (row["b"], row["c"]) == (b, c)
    assert row["p"] == pytest.approx(p, abs=1e-6)


def test_mcnemar_variances(spark):
    exact = paired.mcnemar(arms_frame(spark, 5, 1, 10), F.col("x"), F.col("y")).first()
    null = paired.mcnemar(arms_frame(spark, 5, 1, 10), F.col("x"), F.col("y"), variance="null").first()
    assert exact["se"] == pytest.approx(math.sqrt(6 - 16 / 16) / 16)
    assert null["se"] == pytest.approx(math.sqrt(6) / 16)
    with pytest.raises(ValueError):
        paired.mcnemar(arms_frame(spark, 1, 1, 1), F.col("x"), F.col("y"), variance="other")


def test_bootstrap_index_covers_rows():
    n, share = 399, []
    for rep in range(50):
        share.append(len({((rep + 1) * 1103515245 + (i + 1) * 12345 + (rep + 7) * (i + 3) ** 2 * 7919) % 2147483647 % n for i in range(n)}) / n)
    assert sum(share) / 50 == pytest.approx(0.632, abs=0.05)


def candidate_rows(spark):
    rows = [("s", p, f"p{p}_b{i}", i - 1, float(5 - i), "x" * 5 * i, p) for p in (1, 2, 3) for i in range(1, 6)]
    return spark.createDataFrame(rows, "sample string, page_id long, block_id string, order_index long, lexical_score double, text string, page_rank long")


def test_selectors(spark):
    rows = candidate_rows(spark)
    first = selection.select_memory(rows, "sample", "random", 4).select("block_id").collect()
    again = selection.select_memory(rows.repartition(7), "sample", "random", 4).select("block_id").collect()
    other = selection.select_memory(rows, "sample", "random", 4, seed=F.lit("other")).select("block_id").collect()
    assert sorted(first) == sorted(again) and sorted(first) != sorted(other)
    assert selection.select_memory(rows, "sample", "all").count() == 15
    chars = selection.select_memory(rows.withColumn("budget", F.lit(40)), "sample", "random_chars", budget="budget").orderBy(F.desc("sel_score")).collect()
    lengths = [len(r["text"]) for r in chars]
    assert sum(lengths) >= 40 > sum(lengths[:-1])
    for bad in ("lexical", "nope"):
        with pytest.raises(ValueError):
            selection.select_memory(rows, "sample", bad)
    with pytest.raises(ValueError):
        selection.select_memory(rows, "sample", "random_chars")


def test_packing_order_and_budget(spark):
    rows = selection.lexical_selection(candidate_rows(spark), "sample", 3)
    out = selection.pack(rows, "sample", 300).first()
    assert out["block_ids"] == ["p1_b1", "p2_b1", "p3_b1"]
    assert selection.lexical_char_budget(candidate_rows(spark), "sample", 3, 300).first()["char_budget"] == 15


def test_duplicates(spark):
    rows = spark.createDataFrame([("a", 1, "x"), ("a", 2, "y"), ("b", 3, "z")], "k string, at int, v string")
    pick = lambda how: {r["k"]: r["v"] for r in sets.deduplicate(rows, "k", ["at"], how).collect()}
    assert pick("first") == {"a": "x", "b": "z"} and pick("last") == {"a": "y", "b": "z"}
    with pytest.raises(sets.GuardError):
        sets.deduplicate(rows, "k", ["at"], "error")
    with pytest.raises(sets.GuardError):
        sets.strict_pair(rows.select("k"), rows.where("k = 'a'").select("k"), "k")


def test_degraded_ranking(spark):
    top, gold, spare = list(range(1, 17)), [3, 5], [20, 18, 19]
    for j in range(3):
        new = one(spark, controls.degrade_ranking(lit(top), lit(gold), lit(spare), F.lit(j)))
        assert len(new) == len(set(new)) == 16
        assert len(set(gold) & set(new)) == 2 - j


def test_derangement_has_no_fixed_point(spark):
    docs = spark.createDataFrame([(i, f"f{i % 4}") for i in range(40)], "k long, f string")
    rows = controls.derangement(docs, "k", "f").collect()
    assert len({r["donor"] for r in rows}) == 40
    assert all(r["k"] != r["donor"] and not r["same_family"] for r in rows)


def test_line_groups():
    lines = [(0, 0, 50, 10, "a"), (0, 12, 50, 22, "b"), (100, 0, 150, 10, "c"), (0, 80, 50, 90, "d")]
    found = layout.group_lines(lines, 1.2, 0.3)
    assert [b[4] for b in found] == [["a", "b"], ["c"], ["d"]]
