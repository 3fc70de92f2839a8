"""Token ids as Parquet list columns.

``write_token_table`` sorts documents by id into range shards and writes, per
document, its ids as a list column (dictionary-encoded: a vocabulary's ids fit
one small dictionary page) beside delta-encoded metadata columns. Row groups,
pages and the page indexes' granularity are set, so that a reader of a few
documents or of metadata alone touches only their pages. A document's place in
the whole stream is its shard's base plus its place in the shard, so no task
needs the rows before its own.

Defined cases: a null or empty text holds the end id alone; a null doc_id sorts
first; rows that tie on doc_id are ordered by text; an empty table gives an
empty file; other columns are not read. Long texts are encoded stretch by
stretch. A shard's number follows from the bytes of all texts, so that no task
sorts more than a bounded share of them.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from folioscope.llm.common import lean, more_than_set, partitions, prepare, texts
from folioscope.llm.encoding import encoder

SCHEMA = "doc_id long, shard int, shard_start long, n_tokens long, ids array<int>"

#: Fixed layout of the files.
LAYOUT = {
    "compression": "zstd",
    "parquet.writer.version": "v2",
    "parquet.enable.dictionary": "false",
    "parquet.enable.dictionary#ids.list.element": "true",
    "parquet.dictionary.page.size": str(1 << 20),
    "parquet.block.size": str(8 << 20),
    "parquet.page.size": str(256 << 10),
    "parquet.page.row.count.limit": "500",
}


def write_token_table(docs: DataFrame, path: str, tokenizer: str, end_id: int) -> None:
    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc, shard, at = encoder(tokenizer), TaskContext.get().partitionId(), 0
        for batch in batches:
            for row, offsets, ids in enc.encode_batches(batch.column("text"), end_id):
                n = np.diff(offsets)
                lists = pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(ids.view("<i4")))
                yield pa.RecordBatch.from_arrays(
                    [batch.column("doc_id")[row: row + len(n)], pa.array(np.full(len(n), shard, np.int32)), pa.array(at + offsets[:-1]), pa.array(n), lists],
                    ["doc_id", "shard", "shard_start", "n_tokens", "ids"],
                )
                at += int(offsets[-1])

    rows = texts(docs)
    rows = rows.repartitionByRange(*more_than_set(rows, partitions(rows)), "doc_id").sortWithinPartitions("doc_id", "text")
    rows.mapInArrow(lean(encode), SCHEMA).write.options(**LAYOUT).parquet(path)


def shard_bases(spark: SparkSession, path: str) -> DataFrame:
    """Ids before each shard: a running sum with one row per shard, from n_tokens alone."""
    per = spark.read.schema(SCHEMA).parquet(path).groupBy("shard").agg(F.sum("n_tokens").alias("n"))
    return per.select("shard", (F.sum("n").over(Window.orderBy("shard")) - F.col("n")).alias("base"))


def read_token_table(spark: SparkSession, path: str) -> DataFrame:
    """doc_id, start, n_tokens and ids, as stored."""
    rows = spark.read.schema(SCHEMA).parquet(path)
    return rows.join(shard_bases(spark, path), "shard").select("doc_id", (F.col("base") + F.col("shard_start")).alias("start"), "n_tokens", "ids")


def digests(spark: SparkSession, path: str) -> DataFrame:
    """Per document, from the files: start, n_tokens and crc32 of its ids.

    The lists are reduced to their crc32 before any join.
    """
    prepare(spark)

    def crc(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = batch.column("ids")
            values = lists.values.to_numpy(zero_copy_only=False).astype("<u4", copy=False)
            ends = lists.offsets.to_numpy()
            sums = [zlib.crc32(values[a:b].tobytes()) for a, b in zip(ends[:-1], ends[1:], strict=True)]
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), batch.column("shard"), batch.column("shard_start"), pa.array(np.diff(ends).astype(np.int64)), pa.array(sums, pa.int64())],
                ["doc_id", "shard", "shard_start", "n_tokens", "ids_crc32"],
            )

    read = spark.read.schema(SCHEMA).parquet(path).select("doc_id", "shard", "shard_start", "ids")
    rows = read.mapInArrow(lean(crc), "doc_id long, shard int, shard_start long, n_tokens long, ids_crc32 long")
    return rows.join(shard_bases(spark, path), "shard").select("doc_id", (F.col("base") + F.col("shard_start")).alias("start"), "n_tokens", "ids_crc32")


def read_documents(spark: SparkSession, path: str, first: int, last: int) -> DataFrame:
    """The ids of the documents from first to last: row groups and pages are skipped by their statistics."""
    return spark.read.schema(SCHEMA).parquet(path).where(F.col("doc_id").between(first, last)).select("doc_id", "ids")
