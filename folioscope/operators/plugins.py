"""Injected models: readers, retrievers, recognisers, graders and scorers.

A plug-in is built once per Python worker by a factory and called with a batch of
rows; it runs inside ``mapInPandas``, after filters, which Spark doesn't push
through it. Failing rows are kept with their reason rather than failing the task.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructType

Batch = Callable[[pd.DataFrame], pd.DataFrame]
_made: dict[str, Batch] = {}


def apply(rows: DataFrame, name: str, factory: Callable[[], Batch], columns: list[str], output: str) -> DataFrame:
    """``rows`` with the plug-in's output columns and ``error``.

    The plug-in sees ``columns`` and returns one row per input row.
    """
    added = StructType.fromDDL(output)
    schema = StructType([*rows.schema.fields, *added.fields]).add("error", StringType())

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        call = _made.get(name) or _made.setdefault(name, factory())
        for batch in batches:
            try:
                got, error = call(batch[columns]).reset_index(drop=True), [None] * len(batch)
            except Exception:  # one bad row must not cost the others theirs
                parts, error = [], []
                for i in range(len(batch)):
                    try:
                        parts.append(call(batch[columns].iloc[[i]]).reset_index(drop=True))
                        error.append(None)
                    except Exception as e:
                        parts.append(pd.DataFrame([{f.name: None for f in added.fields}]))
                        error.append(str(e)[:300])
                got = pd.concat(parts, ignore_index=True) if parts else pd.DataFrame({f.name: [] for f in added.fields})
            yield pd.concat([batch.reset_index(drop=True), got[[f.name for f in added.fields]]], axis=1).assign(error=error)

    return rows.mapInPandas(run, schema)


def rerank(candidates: DataFrame, group: str, cheap: str, keep: int, name: str, factory: Callable[[], Batch], columns: list[str], tie: list[str]) -> DataFrame:
    """A cheap score's top ``keep`` of each group, rescored by a plug-in that returns ``score``."""
    from folioscope.operators.retrieval import top_k

    first = top_k(candidates, [group], [F.col(cheap).desc(), *[F.col(t) for t in tie]], keep).drop("rank")
    return top_k(apply(first, name, factory, columns, "score double"), [group], [F.col("score").desc_nulls_last(), *[F.col(t) for t in tie]], keep)


def error_reasons(rows: DataFrame, most: int = 5) -> DataFrame:
    """The commonest reasons, a report."""
    return rows.where(F.col("error").isNotNull()).groupBy(F.left("error", F.lit(60)).alias("reason")).agg(F.count("*").alias("n")).orderBy(F.desc("n"), "reason").limit(most)


def rowwise(call_one: Callable[[dict], dict], threads: int = 1, retries: int = 0) -> Callable[[], Batch]:
    """A factory for a plug-in that answers row by row, on a pool of threads, each row tried ``retries`` times more."""

    def attempt(row: dict) -> dict:
        for k in range(retries + 1):
            try:
                return call_one(row)
            except Exception:
                if k == retries:
                    raise
        raise AssertionError

    def make() -> Batch:
        from concurrent.futures import ThreadPoolExecutor

        pool = ThreadPoolExecutor(threads)
        return lambda batch: pd.DataFrame(list(pool.map(attempt, batch.to_dict("records"))))

    return make


def two_call(rows: DataFrame, extract: tuple[str, Callable[[], Batch], str], combine: tuple[str, Callable[[], Batch], str], columns: list[str]) -> DataFrame:
    """A reader that first extracts, then combines: the second call sees the first one's outputs. (name, factory, output) each."""
    first = apply(rows, extract[0], extract[1], columns, extract[2]).withColumnRenamed("error", "extract_error")
    seen = [*columns, *[f.name for f in StructType.fromDDL(extract[2]).fields]]
    return apply(first, combine[0], combine[1], seen, combine[2])
