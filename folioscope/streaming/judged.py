"""Streams of judged rows: resumable ingest, repeats within a watermark, repair."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery


def read_shards(spark: SparkSession, path: str, schema: str, files_per_trigger: int = 100) -> DataFrame:
    """JSON-line shards as they arrive; the checkpoint remembers the files done."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_trigger).json(path)


def first_of_key(rows: DataFrame, key: str, time: str, delay: str = "1 hour") -> DataFrame:
    """The first row of a key within the watermark; state is dropped behind it."""
    return rows.withWatermark(time, delay).dropDuplicatesWithinWatermark([key])


def windowed_rates(rows: DataFrame, time: str, verdict: str, window: str = "10 minutes", delay: str = "1 hour") -> DataFrame:
    """Share of correct verdicts per time window, late rows up to the delay included."""
    return (
        rows.withWatermark(time, delay).groupBy(F.window(time, window))
        .agg(F.count("*").alias("n"), F.avg((F.col(verdict) == "correct").cast("double")).alias("rate"))
        .select(F.col("window.start").alias("start"), "n", "rate")
    )


def append(rows: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    """Write a stream as Parquet until what is there is done."""
    return rows.writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint).outputMode("append").trigger(availableNow=True).start()


def repair(rows: DataFrame, regrade: Callable[[DataFrame], DataFrame], key: str, value: str, bad: Column, passes: int = 2) -> DataFrame:
    """Bad rows graded again and replaced where the new grade is good, ``passes`` times at most. ``bad`` is over ``value``."""
    from folioscope.operators.sets import patch

    for _ in range(passes):
        failing = rows.where(bad | F.col(value).isNull())
        if failing.isEmpty():
            break
        fixes = regrade(failing)
        good = fixes.where(~F.coalesce(bad, F.lit(True)) & F.col(value).isNotNull())
        rows = patch(rows, good, key, value, bad, F.col("fix").isNotNull())
    return rows


def append_repaired(rows: DataFrame, path: str, checkpoint: str, regrade: Callable[[DataFrame], DataFrame], key: str, value: str, bad: Column, passes: int = 2) -> StreamingQuery:
    """Write a stream, every micro-batch repaired before it is written; a batch that is run again replaces itself."""

    def write(batch: DataFrame, number: int) -> None:
        held = batch.persist()
        repair(held, regrade, key, value, bad, passes).write.mode("overwrite").parquet(f"{path}/batch={number}")
        held.unpersist()

    return rows.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def append_versions(rows: DataFrame, path: str, checkpoint: str, key: str, value: str, bad: Column, ordinal: str) -> StreamingQuery:
    """Write a stream of graded rows so that a later good grade replaces an earlier batch's row.

    A micro-batch keeps one row a key, the last good one, else the last one, as
    ``batch=<number>``; a batch that is run again replaces itself, so a restart neither
    loses nor repeats rows. :func:`latest` merges batches by key and version. ``bad`` is
    over ``value``; ``ordinal`` orders the rows of a batch.
    """

    def write(batch: DataFrame, number: int) -> None:
        _best(batch.withColumn("batch", F.lit(number).cast("long")), key, value, bad, ordinal).drop("batch").write.mode("overwrite").parquet(f"{path}/batch={number}")

    return rows.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def _best(rows: DataFrame, key: str, value: str, bad: Column, ordinal: str) -> DataFrame:
    good = F.coalesce(~bad, F.lit(False)) & F.col(value).isNotNull()
    whole = F.struct(*[c for c in rows.columns if c != key])
    return rows.groupBy(key).agg(F.max_by(whole, F.struct(good, "batch", ordinal)).alias("row")).select(key, "row.*").select(rows.columns)


def latest(spark: SparkSession, path: str, key: str, value: str, bad: Column, ordinal: str) -> DataFrame:
    """One row a key over all batches of :func:`append_versions`: the last good one, else the last one, with its ``batch``."""
    rows = spark.read.option("basePath", path).parquet(path).withColumn("batch", F.col("batch").cast("long"))
    return _best(rows, key, value, bad, ordinal)


def compacted(spark: SparkSession, path: str, out: str, key: str, value: str, bad: Column, ordinal: str) -> None:
    """What :func:`latest` gives, as a table at ``out`` in the same form: one folder a batch that still has rows."""
    latest(spark, path, key, value, bad, ordinal).write.partitionBy("batch").parquet(out)
