"""Assembled studies against values worked out by hand."""

import json

import pytest
from pyspark.sql import functions as F

from folioscope.operators import sets, studies


def test_foreign_memory(spark):
    rows = lambda xs: spark.createDataFrame([(s, lv, bool(v)) for s, lv, v in xs], "sample string, level string, correct boolean")
    images = rows([("a", "1", 0), ("b", "1", 0), ("c", "1", 1), ("d", "1", 1), ("a", "0", 1), ("b", "0", 0), ("x", "0", 1)])
    own = rows([("a", "1", 1), ("b", "1", 1), ("c", "1", 1), ("d", "1", 0), ("a", "0", 1), ("b", "0", 0)])
    foreign = rows([("a", "1", 1), ("b", "1", 0), ("c", "1", 1), ("d", "1", 1), ("a", "0", 0), ("b", "0", 0)])
    guards = sets.Guards()
    got = {(r["level"], r["base"], r["arm"]): (r["n"], r["b"], r["c"], r["delta"], r["recovered"]) for r in studies.foreign_memory(images, own, foreign, "level", guards).collect()}
    assert got == {
        ("1", "images", "own"): (4, 2, 1, 0.25, 1.0), ("1", "images", "foreign"): (4, 1, 0, 0.25, 1.0), ("1", "foreign", "own"): (4, 1, 1, 0.0, 1.0),
        ("0", "images", "own"): (2, 0, 0, 0.0, None), ("0", "images", "foreign"): (2, 0, 1, -0.5, None), ("0", "foreign", "own"): (2, 1, 0, 0.5, None),
    }
    with pytest.raises(sets.GuardError, match="arms.unaligned: 1 rows"):
        guards.check()


def test_judge_agreement(spark):
    rows = spark.createDataFrame([("t", "correct", "correct"), ("t", "correct", "partial"), ("t", "partial", "incorrect"), ("u", None, "correct"), ("u", "partial", "partial")], "task string, o string, n string")
    got = {r["task"]: (r["samples"], r["b"], r["c"], r["agree"], r["agree_three"], r["delta"]) for r in studies.judge_agreement(rows, F.col("o"), F.col("n"), "task").collect()}
    assert got == {"t": (3, 0, 1, pytest.approx(2 / 3), pytest.approx(1 / 3), pytest.approx(-1 / 3)), "u": (2, 1, 0, 0.5, 0.5, 0.5), None: (5, 1, 1, pytest.approx(3 / 5), pytest.approx(2 / 5), 0.0)}


def test_external_selection(spark):
    rows = spark.createDataFrame(
        [("a", [9, 2, 2, 8, 1, 7], [1, 2, 3]), ("b", [9, 8, 9], [1, 2, 3]), ("c", None, [1, 2, 3]), ("d", [], [4]), ("e", [3, 3, 5, 1, 2], [1, 2, 3]), ("f", list(range(50, 70)), [1])], "id string, ranked array<int>, known array<int>"
    )
    got = {r["id"]: tuple(r["e"]) for r in rows.select("id", studies.external_selection(F.col("ranked"), F.col("known"), 2, 2).alias("e")).collect()}
    assert got == {
        "a": ([2, 1], True, None, [9, 8], 6), "b": ([1, 2], False, "no_valid_external_page", [9, 8, 9], 3), "c": ([1, 2], False, "missing_external_prediction", [], 0),
        "d": ([4], False, "no_valid_external_page", [], 0), "e": ([3, 1], True, None, [5], 5), "f": ([1], False, "no_valid_external_page", list(range(50, 60)), 20),
    }


def test_judge_dialects(spark):
    from folioscope.functions import judge_requests as J

    one = lambda c: spark.range(1).select(c.alias("v")).first()["v"]
    assert J.endpoint("http://x/v1/", "chat") == "http://x/v1/chat/completions" and J.endpoint("http://x", "responses") == "http://x/responses"
    assert json.loads(one(J.body("responses", "GPT-5", "rules", F.lit("é\n"), "high", 9))) == {"model": "GPT-5", "instructions": "rules", "input": "é\n", "max_output_tokens": 9, "reasoning": {"effort": "high"}}
    assert "reasoning" not in one(J.body("responses", "other", "r", F.lit("u"), "high")) and "reasoning" not in one(J.body("responses", "gpt-5", "r", F.lit("u")))
    assert json.loads(one(J.body("chat", "m", "r", F.lit("u"), "low"))) == {"model": "m", "max_tokens": 8000, "messages": [{"role": "system", "content": "r"}, {"role": "user", "content": "u"}]}
    answer = {"output": [{"type": "reasoning"}, {"content": [{"type": "output_text", "text": "a"}, {"type": "refusal", "text": "x"}]}, {"content": [{"type": "output_text", "text": "b"}]}]}
    assert one(J.answer_text("responses", F.lit(json.dumps(answer)))) == "ab" and one(J.answer_text("responses", F.lit("{}"))) == ""
    assert one(J.answer_text("chat", F.lit('{"choices": [{"message": {"content": "yes"}}, {}]}'))) == "yes" and one(J.answer_text("chat", F.lit('{"choices": []}'))) == ""
    for bad in (lambda: J.endpoint("x", "other"), lambda: J.body("chat", "m", "r", F.lit("u"), "huge")):
        with pytest.raises(ValueError):
            bad()
