"""Exact vector top-k over centroid lists with bounds: late interaction, and cosine neighbours.

A page's score for a query is the sum over the query's vectors of the best dot
product with one of the page's vectors. Page vectors are dealt to centroid lists. For a
query vector q no vector of a list scores above q . c + |q| r, where c is the list's
centroid and r the farthest that one of its vectors lies from c. Pages with like
vectors form blocks of ``BLOCK``; a block's bound sums, over the query's vectors, the
best bound of the lists in it. A task keeps its own k best pages of each query, blocks
of highest bound first, and skips a block that can't lift a page over the k-th best.
What remains is scored exactly, as matrix products; nothing is approximated.

How much is skipped depends on the vectors: little where they fill the sphere evenly,
most where they form clusters. :func:`scored_share` measures it.

Defined cases: null vectors, and those with null or non-finite components, are left out;
a page vector of another length than the query's counts as zeros; a query without
vectors has no rows; equal scores (to six places) are ranked by key; an empty table
gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from folioscope.operators.retrieval import top_k

#: Lists at most, vectors that the centroids are fitted on at most (by hash), and rounds.
LISTS, SAMPLE, ROUNDS = 64, 4096, 4
#: Pages of a block, vectors of a segment (whole pages), and blocks looked at before any can be skipped.
BLOCK, SEGMENT, FIRST = 32, 20_000, 2
#: Query vectors sent to the tasks at once; more are searched in several passes.
QUERY_VECTORS = 20_000


def usable(v: Column) -> Column:
    odd = F.exists(v, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    return F.coalesce(~odd, F.lit(False))


def centroids(vectors: DataFrame, column: str, width: int) -> np.ndarray:
    """Lloyd's centroids of at most ``SAMPLE`` vectors; any set of centroids gives right results."""
    fit = vectors.where(F.size(column) == width).select(F.col(column).cast("array<double>").alias("v"))
    rows = fit.orderBy(F.xxhash64("v"), "v").limit(SAMPLE).collect()
    if not rows or not width:
        return np.zeros((1, width))
    x = np.asarray([r["v"] for r in rows])
    found = x[:: max(1, len(x) // LISTS)][:LISTS].copy()
    for _ in range(ROUNDS):
        near = (x @ found.T - (found * found).sum(1) / 2).argmax(1)
        for k in range(len(found)):
            if (near == k).any():
                found[k] = x[near == k].mean(0)
    return found


class Asked:
    """Query vectors as a matrix, those of one query together."""

    def __init__(self, rows: list):
        rows = sorted(rows, key=lambda r: (r["qid"] is not None, r["qid"], r["q_pos"]))
        self.qids = list(dict.fromkeys(r["qid"] for r in rows))
        place = {q: k for k, q in enumerate(self.qids)}
        self.vectors = np.asarray([r["q_vec"] for r in rows], np.float64)
        owner = np.asarray([place[r["qid"]] for r in rows])
        self.starts = np.searchsorted(owner, np.arange(len(self.qids)))
        self.sizes = np.diff(np.append(self.starts, len(rows)))
        self.norms = np.linalg.norm(self.vectors, axis=1)


class Best:
    """The k best pages of each query that one task has seen, and how many pairs it scored."""

    def __init__(self, asked: Asked, centres: np.ndarray, k: int, unlike: bool):
        self.asked, self.centres, self.k, self.unlike = asked, centres, k, unlike
        self.pages: list[list] = [[] for _ in asked.qids]
        self.floor = np.full(len(asked.qids), -np.inf)
        self.scored = self.met = 0
        self.to_centres = asked.vectors @ centres.T

    def meet(self, names: list, x: np.ndarray, starts: np.ndarray) -> None:
        """Score a segment of whole pages: their names, vectors, and where each begins."""
        asked, n_pages = self.asked, len(starts)
        self.met += n_pages * len(asked.qids)
        sizes = np.diff(np.append(starts, len(x)))
        near = (x @ self.centres.T - (self.centres**2).sum(1) / 2).argmax(1)
        far = np.linalg.norm(x - self.centres[near], axis=1)
        means = np.add.reduceat(x, starts) / sizes[:, None]
        order = np.argsort((means @ self.centres.T - (self.centres**2).sum(1) / 2).argmax(1), kind="stable")
        block = np.empty(n_pages, np.int64)
        block[order] = np.arange(n_pages) // BLOCK
        n_blocks = int(block.max()) + 1
        radius = np.full((n_blocks, len(self.centres)), -np.inf)
        np.maximum.at(radius, (np.repeat(block, sizes), near), far)
        bound = np.empty((len(asked.qids), n_blocks))
        for b in range(n_blocks):
            held = np.flatnonzero(radius[b] > -np.inf)
            best = (self.to_centres[:, held] + asked.norms[:, None] * radius[b, held]).max(1)
            bound[:, b] = np.add.reduceat(best, asked.starts)
        first = np.argsort(np.argsort(-bound, axis=1, kind="stable"), axis=1) < FIRST
        for looked in (first, ~first):
            for b in np.flatnonzero(looked.any(0)).tolist():
                queries = np.flatnonzero(looked[:, b] & (bound[:, b] + 1e-5 >= self.floor))
                if len(queries):
                    self._score(names, x, starts, sizes, np.sort(order[b * BLOCK : (b + 1) * BLOCK]), queries)

    def _score(self, names: list, x: np.ndarray, starts: np.ndarray, sizes: np.ndarray, pages: np.ndarray, queries: np.ndarray) -> None:
        asked = self.asked
        spread = lambda begin, size: np.repeat(begin - np.concatenate([[0], np.cumsum(size)[:-1]]), size) + np.arange(size.sum())
        rows, cut = spread(asked.starts[queries], asked.sizes[queries]), np.concatenate([[0], np.cumsum(asked.sizes[queries])[:-1]])
        held, edge = spread(starts[pages], sizes[pages]), np.concatenate([[0], np.cumsum(sizes[pages])[:-1]])
        best = np.maximum.reduceat(asked.vectors[rows] @ x[held].T, edge, axis=1)
        score = np.round(np.add.reduceat(best, cut, axis=0), 6)
        self.scored += score.size
        better = score >= self.floor[queries][:, None]
        for k in np.flatnonzero(better.any(1)).tolist():
            q = int(queries[k])
            kept = self.pages[q]
            kept += [(-float(score[k, p]), names[pages[p]]) for p in np.flatnonzero(better[k]).tolist() if not (self.unlike and names[pages[p]] == asked.qids[q])]
            if len(kept) > self.k:
                kept.sort()
                del kept[self.k :]
            if len(kept) == self.k:
                self.floor[q] = -max(p[0] for p in kept)

    def rows(self) -> Iterator[tuple]:
        for q, kept in enumerate(self.pages):
            for s, page in kept:
                yield self.asked.qids[q], page, -s + 0.0


def _segments(batches: Iterator[pa.RecordBatch], width: int) -> Iterator[tuple[list, np.ndarray, np.ndarray]]:
    """(page names, vectors, starts) of about SEGMENT vectors, pages whole; rows come sorted by page."""
    names: list = []
    parts: list[np.ndarray] = []
    starts: list[int] = []
    held = 0
    for b in batches:
        lists = b.column("p_vec")
        fit = np.asarray(pc.equal(pc.list_value_length(lists), width))
        x = np.zeros((b.num_rows, width))
        if fit.any() and width:
            x[fit] = np.asarray(pc.list_flatten(lists.filter(pa.array(fit))).cast(pa.float64())).reshape(-1, width)
        pages = b.column("page_id").to_pylist()
        at = 0
        for k, page in enumerate(pages):
            if not names or page != names[-1]:
                if held + k - at >= SEGMENT:
                    parts.append(x[at:k])
                    yield names, np.concatenate(parts), np.asarray(starts)
                    names, parts, starts, held, at = [], [], [], 0, k
                names.append(page)
                starts.append(held + k - at)
        parts.append(x[at:])
        held += len(pages) - at
    if names:
        yield names, np.concatenate(parts), np.asarray(starts)


def _passes(queries: DataFrame, pages: DataFrame) -> Iterator[tuple[DataFrame, int, Asked, np.ndarray]]:
    """(sorted page vectors, width, queries, centroids) of every pass: by width, and in bounded blocks of queries."""
    asked = queries.where(usable(F.col("q_vec")))
    held = pages.select("page_id", "p_vec").where(usable(F.col("p_vec"))).repartition("page_id").sortWithinPartitions("page_id")
    for r in sorted(asked.groupBy(F.size("q_vec").alias("w")).agg(F.count("*").alias("n")).collect()):  # a row a length of vectors
        same = asked.where(F.size("q_vec") == r["w"])
        n = -(-r["n"] // QUERY_VECTORS)
        centres = centroids(pages.where(usable(F.col("p_vec"))), "p_vec", r["w"])
        for k in range(n):
            yield held, r["w"], Asked(same.where(F.pmod(F.xxhash64("qid"), F.lit(n)) == k).collect()), centres  # about QUERY_VECTORS


def search(queries: DataFrame, pages: DataFrame, k: int, unlike: bool = False) -> DataFrame:
    """(qid, page_id, score, rank): each query's k best pages, from 1, by late interaction.

    queries: (qid, q_pos, q_vec), a stated set; pages: (page_id, p_vec). Vectors of a
    page meet once, by page. With ``unlike`` a page never answers the query of its own
    name. A qid whose vectors have several lengths is a query of each.
    """
    spark, found = pages.sparkSession, None
    kinds = [queries.schema["qid"].dataType.simpleString(), pages.schema["page_id"].dataType.simpleString()]
    schema = f"qid {kinds[0]}, page_id {kinds[1]}, score double"
    arrow = {"bigint": pa.int64(), "int": pa.int32(), "string": pa.string()}
    types = [arrow[kinds[0]], arrow[kinds[1]], pa.float64()]
    for held, width, asked, centres in _passes(queries, pages):
        if not asked.qids:
            continue
        shared = spark.sparkContext.broadcast((asked, centres))

        def run(batches: Iterator[pa.RecordBatch], shared=shared, width=width) -> Iterator[pa.RecordBatch]:
            best = Best(*shared.value, k, unlike)
            for segment in _segments(batches, width):
                best.meet(*segment)
            rows = list(best.rows())
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), types)], ["qid", "page_id", "score"])

        part = held.mapInArrow(run, schema)
        found = part if found is None else found.unionByName(part)
    if found is None:
        return spark.createDataFrame([], f"{schema}, rank long")
    return top_k(found, ["qid"], [F.col("score").desc(), F.col("page_id")], k)


def unit(v: Column) -> Column:
    """A vector over its length; the zero vector as it is."""
    x = v.cast("array<double>")
    norm = F.sqrt(F.aggregate(x, F.lit(0.0), lambda s, a: s + a * a))
    return F.when(norm > 0, F.transform(x, lambda a: a / norm)).otherwise(x)


def nearest(vectors: DataFrame, queries: DataFrame, k: int) -> DataFrame:
    """(qid, vec_id, cosine, rank): exact cosine neighbours, a query itself left out.

    vectors: (vec_id, embedding); queries: (qid, a), a stated set.
    """
    pages = vectors.where(usable(F.col("embedding"))).select(F.col("vec_id").alias("page_id"), unit(F.col("embedding")).alias("p_vec"))
    asked = queries.where(usable(F.col("a"))).select("qid", F.lit(0).alias("q_pos"), unit(F.col("a")).alias("q_vec"))
    return search(asked, pages, k, unlike=True).select("qid", F.col("page_id").alias("vec_id"), F.col("score").alias("cosine"), "rank")


def scored_share(queries: DataFrame, pages: DataFrame, k: int) -> tuple[int, int]:
    """(pairs scored, all pairs) of a search: what the bounds save."""
    scored = met = 0
    for held, width, asked, centres in _passes(queries, pages):
        shared = pages.sparkSession.sparkContext.broadcast((asked, centres))

        def run(batches: Iterator[pa.RecordBatch], shared=shared, width=width) -> Iterator[pa.RecordBatch]:
            best = Best(*shared.value, k, False)
            for segment in _segments(batches, width):
                best.meet(*segment)
            yield pa.RecordBatch.from_arrays([pa.array([best.scored]), pa.array([best.met])], ["scored", "met"])

        r = held.mapInArrow(run, "scored long, met long").agg(F.sum("scored"), F.sum("met")).first()
        scored, met = scored + (r[0] or 0), met + (r[1] or 0)
    return scored, met
