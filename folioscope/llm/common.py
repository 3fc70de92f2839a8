"""What the operators of this subpackage share on the driver's side."""

from __future__ import annotations

import zlib

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from folioscope.session import discard, discard_since, fresh, mark, release, shared_dir, ship, table, written  # noqa: F401

#: Bytes of one Arrow batch handed to a Python worker.
ARROW_BYTES = 4 << 20
#: Bytes of text whose rows one shuffle partition holds.
PARTITION_BYTES = 32 << 20
#: About how many bytes of text a byte of a table's files stands for.
COMPRESSION = 2


def prepare(spark: SparkSession) -> SparkSession:
    """Bound what a Python worker is handed at once, however long the texts are."""
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(ARROW_BYTES))
    return ship(spark)


def texts(docs: DataFrame, *more: str) -> DataFrame:
    """doc_id and text alone (and ``more``), so that other columns can't clash."""
    prepare(docs.sparkSession)
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), *[docs[c] for c in more])


def partitions(docs: DataFrame, per: int = PARTITION_BYTES) -> int:
    """Shuffle partitions for the texts of ``docs``: by their bytes, the session's number at least.

    The bytes are those of the files behind ``docs``, times what text compresses
    by; only where there are no files are the texts measured.
    """
    spark, folders = docs.sparkSession, sorted({f.rsplit("/", 1)[0] for f in docs.inputFiles()})
    if folders:
        size = COMPRESSION * (spark.read.format("binaryFile").option("recursiveFileLookup", True).load(folders).agg(F.sum("length")).first()[0] or 0)
    else:
        size = docs.agg(F.sum(F.octet_length(F.col("text").cast("string")).cast("long"))).first()[0] or 0
    return max(int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-size // per))


def more_than_set(docs: DataFrame, wanted: int) -> tuple[int, ...]:
    """``wanted`` as an argument of a repartitioning where the session's number is less; else that, which Spark may coalesce."""
    return (wanted,) if wanted > int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")) else ()


def crc_mod(n: int, column: str = "doc_id") -> Column:
    """crc32 of the id as decimal text, modulo n."""
    return F.crc32(F.col(column).cast("string").cast("binary")) % n


def crc_mod_py(value: int, n: int) -> int:
    return zlib.crc32(str(value).encode()) % n


def bounded_sample(rows: DataFrame, most: int, most_bytes: int) -> list[tuple[str | None, object]]:
    """(text, y) of rows (doc_id, text, y): per y at most ``most`` rows and ``most_bytes`` of text.

    Rows are taken by hash of doc_id and text; those over an eighth of the bytes
    are passed over. Only ids, hashes and lengths are ranked, and the rank is cut
    before its shuffle. A row is then found again by id, label and text hash, and
    repeated rows beyond the bound are left out.
    """
    from pyspark.sql import Window

    key = ["doc_id", "y", "t"]
    marked = rows.withColumn("t", F.xxhash64("text")).withColumn("n", F.coalesce(F.octet_length("text"), F.lit(0)).cast("long"))
    marked = marked.where(F.col("n") <= most_bytes // 8)
    order = Window.partitionBy("y").orderBy(F.xxhash64("doc_id", "t"), *key)
    ranked = marked.select(*key, "n").withColumn("k", F.row_number().over(order)).where(F.col("k") <= most)
    upto = ranked.withColumn("upto", F.sum("n").over(order.rowsBetween(Window.unboundedPreceding, 0))).where(F.col("upto") <= most_bytes)
    chosen = upto.groupBy(*key).agg(F.count("*").alias("copies"))  # at most ``most`` rows of each y
    again = marked.join(F.broadcast(chosen), key).withColumn("copy", F.row_number().over(Window.partitionBy(*key).orderBy(F.lit(0))))
    found = again.where(F.col("copy") <= F.col("copies")).select("doc_id", "text", "y").collect()
    return [(r["text"], r["y"]) for r in sorted(found, key=lambda r: (r["y"], r["doc_id"], r["text"] or ""))]


def numbered(docs: DataFrame, *more: str) -> DataFrame:
    """rid, doc_id, text (and ``more``), where rid is unique and ordered as doc_id.

    Where doc_id is unique and never null it is the rid itself, at the cost of
    one look at the ids. Otherwise rows are sorted by (doc_id, text), null ids
    last, numbered shard by shard, and kept in the shared folder.
    """
    from pyspark.sql import Window

    rows = texts(docs, *more)
    seen = rows.select("doc_id").groupBy("doc_id").count().agg(F.max("count").alias("most"), F.count_if(F.col("doc_id").isNull()).alias("nulls")).first()
    if (seen["most"] or 0) <= 1 and not seen["nulls"]:
        return rows.select(F.col("doc_id").alias("rid"), *rows.columns)
    order = [F.col("doc_id").asc_nulls_last(), F.col("text").asc_nulls_first()]
    sorted_rows = written(
        rows.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("at", F.monotonically_increasing_id()), "numbered"
    )
    # The high bits of at name the shard, the low 33 the place in it.
    shards = sorted_rows.groupBy(F.shiftright("at", 33).alias("shard")).agg(F.count("*").alias("n"))
    bases = shards.select("shard", (F.sum("n").over(Window.orderBy("shard")) - F.col("n")).alias("base"))
    low = F.col("at").bitwiseAND(F.lit((1 << 33) - 1))
    return sorted_rows.withColumn("shard", F.shiftright("at", 33)).join(bases, "shard").select((F.col("base") + low).alias("rid"), *rows.columns)


def lean(run):
    """A worker function that gives freed memory back to the system when its task is done.

    Workers live on from task to task, and allocators keep what was freed.
    """

    def run_and_release(batches):
        try:
            yield from run(batches)
        finally:
            import ctypes
            import gc

            import pyarrow

            gc.collect()
            pyarrow.default_memory_pool().release_unused()
            try:
                ctypes.CDLL("libc.so.6").malloc_trim(0)
            except (OSError, AttributeError):  # another C library
                pass

    return run_and_release
