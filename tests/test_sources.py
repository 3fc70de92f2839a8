import gzip
import json

import pandas as pd
import pytest
from pyspark.sql import functions as F

from folioscope.operators import grounding, plugins
from folioscope.sources import readers, writers
from folioscope.streaming import judged


def write(path, lines):
    path.write_text("\n".join(x if isinstance(x, str) else json.dumps(x) for x in lines), encoding="utf-8")
    return str(path)


def test_json_lines(spark, tmp_path):
    path = write(tmp_path / "a.jsonl", [{"id": "1"}, "", {"id": "ü"}])
    for strict in (False, True):
        assert [r["id"] for r in readers.json_lines(spark, path, "id string", strict=strict).collect()] == ["1", "ü"]
    broken = write(tmp_path / "c.jsonl", [{"id": "1"}, "", "{broken", {"id": "ü"}])
    with pytest.raises(Exception, match="MALFORMED|FAILFAST|malformed"):  # a bad line is never lost
        readers.json_lines(spark, broken, "id string").collect()
    with pytest.raises(readers.BadRow, match=r"c\.jsonl:3"):
        readers.json_lines(spark, broken, "id string", strict=True)
    with pytest.raises(readers.BadRow, match=r"d\.jsonl:1"):
        readers.json_lines(spark, write(tmp_path / "d.jsonl", ["[1]"]), "id string", strict=True)
    with gzip.open(tmp_path / "b.jsonl.gz", "wt") as f:
        f.write('{"id": "z"}\n')
    assert readers.json_lines(spark, str(tmp_path / "b.jsonl.gz"), "id string").first()["id"] == "z"


def test_document_store(spark, tmp_path):
    doc = {"document_id": "d", "pages": [{"page_id": "1", "width": 10, "height": 20, "blocks": [{"block_id": "p1_b1", "bbox": [0, 0, 5, 5], "text": "x"}, {"block_id": " ", "text": "y"}, {"block_id": "p1_b2", "bbox": [3, 3, 3, 9]}]}, {"page_id": "no", "blocks": []}]}
    (tmp_path / "d.json").write_text(json.dumps(doc))
    pages = readers.document_store(spark, str(tmp_path / "d.json"))
    assert [r["page_id"] for r in pages.collect()] == [1]
    got = {r["block_id"]: r for r in readers.store_blocks(pages).collect()}
    assert set(got) == {"p1_b1", "p1_b2"} and got["p1_b2"]["bbox"] is None and got["p1_b2"]["order_index"] == 2 and got["p1_b2"]["text"] == ""
    out = f"{tmp_path}/store"
    writers.document_store(pages, out)
    assert spark.read.json(out).first()["document_id"] == "d"


def test_rankings(spark, tmp_path):
    a = write(tmp_path / "a.jsonl", [{"sample_id": "s", "ranked_page_ids": ["3", "x", "3", "7.0", " 7 ", "1e3"]}, {"id": "t", "scores": [{"page_id": "2", "score": 1.0}, {"page_id": "1", "score": 1.0}, {"page_id": "9", "score": 5}]}])
    b = write(tmp_path / "b.jsonl", [{"sample_id": "s", "page_ids": ["5", "6"]}])
    got = {r["sample_id"]: r["ranked"] for r in readers.rankings(spark, [a, b], 2).collect()}
    assert got == {"s": [5, 6], "t": [9, 1]}
    assert {r["sample_id"]: r["ranked"] for r in readers.rankings(spark, [a]).collect()}["s"] == [3, 7]


def test_small_parsers(spark):
    one = lambda c: spark.range(1).select(c.alias("v")).first()["v"]
    assert one(readers.literal_list(F.lit("['a, b', \"c\"]"))) == ["a, b", "c"]
    assert one(readers.literal_list(F.lit("nan"))) == []
    assert one(readers.page_range(F.lit("x:3-5"))) == [3, 4, 5]
    assert one(readers.page_range(F.lit("x:5-3"))) is None
    assert one(readers.image_page(F.lit("d/page_0012.png"))) == 12
    assert tuple(one(readers.page_and_block(F.lit("p12_b3")))) == (12, "b3")
    assert one(readers.numbers(F.lit("−0.5 [+1, 2e-3]"))) == [-0.5, 1.0, 0.002]


def test_markdown(spark, tmp_path):
    rows = spark.createDataFrame([("x", 1, 0.5), ("y", 2, None)], "name string, n long, v double")
    text = writers.markdown(rows, ["name", "n", "v"])
    (tmp_path / "r.md").write_text(f"# t\n\n{text}\n\nmore\n\n| a | a |\n|---|---|\n| 1 | 2 |\n")
    got = readers.markdown_tables(spark, str(tmp_path / "r.md")).orderBy("table", "row").collect()
    assert [dict(r["cells"]) for r in got] == [{"name": "x", "n": "1", "v": "0.500"}, {"name": "y", "n": "2", "v": ""}, {"a": "1", "a_2": "2"}]
    with pytest.raises(ValueError):
        writers.markdown(rows, ["name"], most=1)


def test_plugin_keeps_failing_rows(spark):
    def factory():
        def call(batch: pd.DataFrame) -> pd.DataFrame:
            if (batch["x"] == 2).any():
                raise ValueError("two")
            return pd.DataFrame({"score": batch["x"] * 10.0})

        return call

    rows = spark.createDataFrame([(1, 1), (1, 2), (1, 3)], "g int, x int")
    got = {r["x"]: (r["score"], r["error"]) for r in plugins.apply(rows, "t", factory, ["x"], "score double").collect()}
    assert got[1] == (10.0, None) and got[3] == (30.0, None) and got[2][1] == "two"
    ranked = plugins.rerank(rows.where("x <> 2"), "g", "x", 1, "t", factory, ["x"], ["x"]).collect()
    assert [(r["x"], r["score"]) for r in ranked] == [(3, 30.0)]


def test_citations(spark):
    blocks = spark.createDataFrame([("d", 2, "p2_b4", "Revenue grew by ten percent."), ("d", 2, "p2_b5", "Costs fell.")], "document_id string, page_id int, block_id string, text string")
    make = lambda block, quote: json.dumps({"result": "r", "claims": [], "evidence": [{"evidence_id": "e", "page_id": 2, "block_id": block, "quote": quote, "supports": []}]})
    preds = spark.createDataFrame(
        [("a", "d", make("p2_b4", "grew by ten")), ("b", "d", make("p2_b5", "grew by ten")), ("c", "d", make("p2_b5", "absent")), ("t", "d", "```json\n" + make("p2_b4", "grew by ten")[:-3])], "sample string, document_id string, pred string"
    )
    got = {r["sample"]: r["citation_score"] for r in grounding.citation_scores(grounding.citation_validity(grounding.cited(preds, "pred"), blocks)).collect()}
    assert got == {"a": 1.0, "b": 0.5, "c": 0.0, "t": 1.0}
    assert grounding.repair("none") is None


def test_stream_of_shards(spark, tmp_path):
    (tmp_path / "in").mkdir()
    write(tmp_path / "in" / "a.json", [{"id": "1", "ts": "2024-01-01T00:00:00", "verdict": "correct"}, {"id": "1", "ts": "2024-01-01T00:01:00", "verdict": "correct"}, {"id": "2", "ts": "2024-01-01T00:02:00", "verdict": "incorrect"}])
    rows = judged.first_of_key(judged.read_shards(spark, str(tmp_path / "in"), "id string, ts timestamp, verdict string"), "id", "ts")
    for _ in range(2):  # the second run finds nothing new
        judged.append(rows, str(tmp_path / "out"), str(tmp_path / "cp")).awaitTermination()
    assert sorted(r["id"] for r in spark.read.parquet(str(tmp_path / "out")).collect()) == ["1", "2"]
