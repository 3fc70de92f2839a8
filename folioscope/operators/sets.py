"""Shard merging, duplicate policies, and guards."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F


class GuardError(ValueError):
    """A declared invariant doesn't hold."""


def expect(rows: DataFrame, **violations: Column) -> DataFrame:
    """Raise :class:`GuardError` if any row violates; one pass, counts alone reach the driver."""
    found = rows.agg(*[F.count_if(v).alias(k) for k, v in violations.items()]).first().asDict()
    bad = {k: v for k, v in found.items() if v}
    if bad:
        raise GuardError(", ".join(f"{k}: {v} rows" for k, v in bad.items()))
    return rows


class Guards:
    """Invariants of several tables, counted in the pass that yields each table's rows.

    ``watch`` returns the same rows with counters on them; once the rows have been
    written or collected, ``check`` raises for all that were broken. A
    table that is read more than once counts in its first pass.
    """

    def __init__(self) -> None:
        self._watched: dict[str, Observation] = {}

    def watch(self, name: str, rows: DataFrame, **violations: Column) -> DataFrame:
        if name in self._watched:
            raise ValueError(f"{name!r} is watched already")
        self._watched[name] = Observation(name)
        return rows.observe(self._watched[name], F.count(F.lit(1)).alias("rows"), *[F.count_if(v).alias(k) for k, v in violations.items()])

    def counts(self) -> dict[str, dict[str, int]]:
        """Rows and violations by table, once an action has read each of them: until then this waits."""
        return {n: o.get for n, o in self._watched.items()}

    def check(self) -> dict[str, dict[str, int]]:
        found = self.counts()
        bad = [f"{n}.{k}: {v} rows" for n, c in found.items() for k, v in c.items() if k != "rows" and v]
        if bad:
            raise GuardError(", ".join(bad))
        return found


def deduplicate(rows: DataFrame, key: str, ordinal: list[str], on_duplicate: str = "first") -> DataFrame:
    """One row per key: the first or last by ``ordinal``, or an error on a repeat.

    The row is carried as a struct through min/max, which combine before the
    shuffle, so a hot key needs neither a sort nor a window.
    """
    if on_duplicate not in ("first", "last", "error"):
        raise ValueError(f"unknown policy {on_duplicate!r}")
    if on_duplicate == "error":
        expect(rows.groupBy(key).count(), duplicated=F.col("count") > 1)
        return rows
    whole = F.struct(*[c for c in rows.columns if c != key])
    pick = F.min_by if on_duplicate == "first" else F.max_by
    return rows.groupBy(key).agg(pick(whole, F.struct(*ordinal)).alias("row")).select(key, "row.*").select(rows.columns)


def union_shards(shards: list[DataFrame]) -> DataFrame:
    """All shards, with shard number as ordinal."""
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), [s.withColumn("shard", F.lit(i)) for i, s in enumerate(shards)])


def missing_and_extra(manifest: DataFrame, rows: DataFrame, key: str) -> DataFrame:
    """Keys on one side only, by one shuffle of keys."""
    both = manifest.select(key, F.lit(1).alias("m"), F.lit(0).alias("p")).unionByName(rows.select(key, F.lit(0).alias("m"), F.lit(1).alias("p")))
    sides = both.groupBy(key).agg(F.max("m").alias("m"), F.max("p").alias("p")).where("m <> p")
    return sides.select(key, F.when(F.col("m") == 1, "missing").otherwise("extra").alias("side"))


def strict_pair(a: DataFrame, b: DataFrame, key: str) -> DataFrame:
    """Inner join of two arms whose key sets must be equal."""
    expect(missing_and_extra(a, b, key), unpaired=F.lit(True))
    return a.join(b, key)


def patch(rows: DataFrame, fixes: DataFrame, key: str, value: str, bad: Column, good: Column) -> DataFrame:
    """Replace ``value`` where it is bad and the fix is good; ``good`` is over the column ``fix``."""
    joined = rows.join(fixes.select(key, F.col(value).alias("fix")), key, "left")
    return joined.withColumn(value, F.when((bad | F.col(value).isNull()) & F.coalesce(good, F.lit(False)), F.col("fix")).otherwise(F.col(value))).drop("fix")


def first_reason(*rules: tuple[str, Column]) -> Column:
    """The name of the first rule that fails, or null."""
    out = F.lit(None).cast("string")
    for name, failed in reversed(rules):
        out = F.when(failed, name).otherwise(out)
    return out
