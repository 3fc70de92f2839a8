"""Connected components of an edge table, by large-star and small-star rounds.

Edges stay distributed; a round is two minima by key, which combine before the
shuffle, and two joins. Rounds are written to the shared folder, and the driver
sees only a count and a checksum.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from folioscope.llm.common import discard, written


def _star(edges: DataFrame, large: bool) -> DataFrame:
    both = edges.select(F.col("a").alias("u"), F.col("b").alias("v"))
    if large:
        both = both.unionByName(edges.select(F.col("b").alias("u"), F.col("a").alias("v")))
    least = both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"))
    joined = both.join(least, "u")
    if large:
        out = joined.where(F.col("v") > F.col("u")).select(F.col("v").alias("a"), F.col("m").alias("b"))
    else:
        out = joined.select(F.col("v").alias("a"), F.col("m").alias("b")).unionByName(least.select(F.col("u").alias("a"), F.col("m").alias("b")))
    return out.where(F.col("a") != F.col("b")).distinct()


#: Rounds grow with the logarithm of a component's width; beyond these something is wrong.
ROUNDS = 200


def components(edges: DataFrame, label: str = "components") -> DataFrame:
    """(id, component) for every id with an edge; component is the least id reachable.

    ``edges`` (a, b) are undirected; loops and repeats are allowed, rows with a
    null end are no edge, and an empty table gives no row.
    """
    now = edges.where(F.col("a") != F.col("b")).select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()
    now, before = written(now, f"{label}-0"), None
    for k in range(1, ROUNDS):
        mark = now.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if mark == before or not mark[0]:
            break
        before = mark
        now, old = written(_star(_star(now, True), False), f"{label}-{k}"), now
        discard(old)
    else:
        raise RuntimeError(f"components did not settle within {ROUNDS} rounds")
    roots = now.select(F.col("b").alias("id"), F.col("b").alias("component")).distinct()
    return now.select(F.col("a").alias("id"), F.col("b").alias("component")).unionByName(roots)
