"""The document folder as a data source: what is opened, and what a failed write leaves."""

import json
import os

import pytest
from pyspark.sql import functions as F

from folioscope.sources import document_folder as D


def body(i, text="t"):
    return json.dumps({"document_id": i, "pages": [{"page_id": "1", "page_text": text, "blocks": []}]})


@pytest.fixture
def folder(tmp_path):
    for k in range(40):
        (tmp_path / D.file_name(f"doc/{k}")).write_text(body(f"doc/{k}"))
    return str(tmp_path)


def test_a_query_of_ten_ids_opens_ten_files(spark, folder):
    for k in range(10, 40):  # any other file would end the read
        path = os.path.join(folder, D.file_name(f"doc/{k}"))
        os.remove(path)
        os.mkdir(path)
    wanted = [f"doc/{k}" for k in range(10)] + ["absent"]
    got = D.documents(spark, folder, files=3).where(F.col("document_id").isin(*wanted) & (F.length("body") > 0))
    assert sorted(r["document_id"] for r in got.collect()) == sorted(wanted[:10])
    assert D.documents(spark, folder).where("document_id = 'doc/7'").count() == 1
    with pytest.raises(Exception, match="IsADirectory|directory"):
        D.documents(spark, folder).collect()


def test_filters_name_the_files():
    reader = D.Reader("/nowhere", 4)
    left = list(reader.pushFilters([D.In(("document_id",), tuple("abcde")), D.EqualTo(("body",), "x"), D.In(("document_id",), ("b", "c", None))]))
    assert left == [D.EqualTo(("body",), "x")] and [p.names for p in reader.partitions()] == [["b.json", "c.json"]]
    reader.pushFilters([]), list(reader.pushFilters([D.EqualTo(("document_id",), "z")]))
    assert [p.names for p in reader.partitions()] == [[]] and list(reader.read(D.Names(["b.json"]))) == []


def test_pages_of_documents(spark, folder):
    pages = D.pages_of(D.documents(spark, folder).where("document_id = 'doc/3'"))
    assert [(r["document_id"], r["page_id"], r["page_text"]) for r in pages.collect()] == [("doc/3", 1, "t")]


def test_writes_replace_single_documents(spark, folder):
    D.replace_documents(spark.createDataFrame([("doc/1", body("doc/1", "new")), ("é ?/x", "{}")], "document_id string, body string"), folder)
    held = {r["document_id"]: r["body"] for r in D.documents(spark, folder).collect()}
    assert len(held) == 41 and held["doc/1"] == body("doc/1", "new") and held["doc/2"] == body("doc/2") and held["é ?/x"] == "{}"
    D.replace_documents(spark.createDataFrame([("only", "{}")], "document_id string, body string"), folder, whole=True)
    assert os.listdir(folder) == ["only.json"]


def test_a_failed_write_leaves_the_old_documents(spark, folder):
    bad = F.when(F.col("id") == 9, F.raise_error(F.lit("killed"))).otherwise(F.lit("{}")).cast("string")
    rows = spark.range(10).repartition(3).select(F.concat(F.lit("doc/"), F.col("id").cast("string")).alias("document_id"), bad.alias("body"))
    with pytest.raises(Exception, match="killed"):
        D.replace_documents(rows, folder)
    held = {r["document_id"]: r["body"] for r in D.documents(spark, folder).collect()}
    assert held == {f"doc/{k}": body(f"doc/{k}") for k in range(40)}
    # A task that was still writing when the abort cleared up may leave a pending file, which no reader sees.
    assert all(n.endswith(D.PENDING) for n in os.listdir(folder) if not n.endswith(D.SUFFIX))
    with pytest.raises(Exception, match="needs an id"):
        D.replace_documents(spark.createDataFrame([(None, "{}")], "document_id string, body string"), folder)


def test_a_write_killed_before_its_commit_is_passed_over(spark, folder):
    writer = D.Writer(folder, False)
    from pyspark.sql import Row

    writer.write(iter([Row(document_id="doc/1", body="half")]))  # and never committed
    assert {r["document_id"]: r["body"] for r in D.documents(spark, folder).collect()}["doc/1"] == body("doc/1")
    with pytest.raises(ValueError):
        D.folder_of({"path": "s3a://bucket/x"})
