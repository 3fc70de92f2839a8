"""Session plumbing shared by every query."""

from __future__ import annotations

import gc
import os
import uuid

from pyspark.sql import DataFrame, SparkSession

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))


def ship(spark: SparkSession) -> SparkSession:
    """Let Python workers import this package wherever the driver was started."""
    env = spark.sparkContext.environment
    paths = env.get("PYTHONPATH", "").split(os.pathsep)
    if ROOT not in paths:
        env["PYTHONPATH"] = os.pathsep.join([ROOT, *filter(None, paths)])
    return spark


#: Bytes of one Arrow batch handed to a Python worker.
ARROW_BYTES = 4 << 20


def bounded(spark: SparkSession) -> SparkSession:
    """Bound what a Python worker is handed at once, however long the rows are."""
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(ARROW_BYTES))
    return spark


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that the driver and all executors share.

    Read from ``spark.checkpoint.dir``; only where that is unset (a local
    session, as in tests) a folder under /tmp is chosen and recorded.
    """
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if not spark.sparkContext.master.startswith("local["):
            raise ValueError("spark.checkpoint.dir is unset: name a folder that all executors share")
        found = "file:///tmp/folioscope-checkpoints"
        spark.conf.set("spark.checkpoint.dir", found)
    return found.rstrip("/")


def written(df: DataFrame, label: str, **options) -> DataFrame:
    """Write ``df`` to a new table in the shared folder and read it back.

    Cuts the lineage: a lost executor re-reads these files instead of
    recomputing what led to them. :func:`discard` deletes the table.
    """
    path = fresh(df.sparkSession, label)
    df.write.options(**options).parquet(path)
    back = df.sparkSession.read.schema(df.schema).parquet(path)
    back.table_path = path
    return back


def release(spark: SparkSession) -> None:
    """Let Spark delete the shuffle files of plans that are done with.

    It does so when the driver collects their owners, which may take long where
    the driver has little to do.
    """
    gc.collect()
    spark._jvm.System.gc()


_made: list[str] = []


def fresh(spark: SparkSession, label: str) -> str:
    """A path of its own in the shared folder."""
    path = f"{shared_dir(spark)}/folioscope/{label}-{uuid.uuid4().hex}"
    _made.append(path)
    return path


def _delete(spark: SparkSession, path: str) -> None:
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)
    if path in _made:
        _made.remove(path)


def discard(*tables: DataFrame) -> None:
    """Delete tables of :func:`written` that nothing reads any more."""
    for df in tables:
        path = df.__dict__.pop("table_path", None)
        if path:
            _delete(df.sparkSession, path)


def mark() -> int:
    """A point in time for :func:`discard_since`."""
    return len(_made)


def discard_since(spark: SparkSession, at: int = 0, keep: DataFrame | None = None) -> None:
    """Delete what was written after ``at``, but for ``keep``; without ``at``, all that this session left."""
    kept = getattr(keep, "table_path", None)
    for path in [p for p in _made[at:] if p != kept]:
        _delete(spark, path)
