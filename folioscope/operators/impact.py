"""Lexical top-k over an impact-ordered index with block maxima.

A unit's score for a query is the sum over shared tokens of weight * impact, with
impact = min(3, tf) and weight = q_tf * (ln((1 + N) / (1 + df)) + 1), as in
:func:`retrieval.lexical_scores`, which scores every pair that shares a token.

:func:`build` makes an index of any DataFrame of texts, without a shuffle. A row is a
segment: a bounded batch of texts with its dictionary. In it units of like length form
blocks of at most ``BLOCK``, and a block lists per token its postings by falling
impact, so the first is the token's maximum in the block. :func:`search` scores a
stated query set against it. A task keeps its own k best of each query: of a segment's
blocks those of highest bound come first, and a block whose maxima can't lift any unit
over the k-th best of a query is skipped for that query, before a posting is read. What
is shuffled are the tasks' k best, not the pairs.

Defined cases: a null or empty text is a unit without tokens, and counts in N; a
query without tokens has no rows; units with equal scores (to six places) are ranked
by their key; repeated units are units of their own; an empty table gives no rows.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from folioscope.functions.text import BLOCK_STOP, PAGE_STOP
from folioscope.operators.retrieval import idf, top_k
from folioscope.session import bounded

#: Units of a block (their slots are one byte), the highest impact, and rows of one output batch.
BLOCK, HIGHEST, BATCH = 16, 3, 8192
#: Units of a segment, and bytes of their text (a longer text is a segment of its own).
SEGMENT, SEGMENT_BYTES = 2048, 4 << 20
#: Options of the table that keeps an index: rows are large, so row groups are closed by their bytes from the first row on.
STORED = {"parquet.block.size": str(16 << 20), "parquet.page.size.row.check.min": "1", "parquet.page.size.row.check.max": "8"}
#: Blocks of a segment that a query looks at before any can be skipped.
FIRST = 2
#: Query terms that are sent to the tasks at once; more are searched in several passes.
QUERY_TERMS = 200_000
BLOCKS = "array<struct<units:array<{unit}>,terms:binary,counts:binary,maxima:binary,slots:binary,impacts:binary>>"
INDEX = "n_units int, tokens array<string>, df array<int>, blocks " + BLOCKS

_ARROW = {"string": pa.string(), "bigint": pa.int64(), "int": pa.int32()}
_TOKENS = re.compile(r"[a-z0-9]+").findall
_STOPS = {"all": (), "block": BLOCK_STOP, "page": PAGE_STOP}


def _segment(units: list, texts: list, stop: pa.Array, shortest: int) -> tuple:
    """(n_units, tokens, df, blocks) of a batch of texts, counted as arrays."""
    found = [_TOKENS((t or "").lower()) for t in texts]
    lengths = np.fromiter(map(len, found), np.int64, len(found))
    encoded = pa.array([t for words in found for t in words], pa.string()).dictionary_encode()
    tokens, codes = encoded.dictionary, encoded.indices.to_numpy().astype(np.int64)
    keep = ~np.asarray(pc.is_in(tokens, stop)) & (np.asarray(pc.utf8_length(tokens)) >= shortest)
    order = np.argsort(-lengths, kind="stable")
    rank = np.empty_like(order)
    rank[order] = np.arange(len(order))
    # Units are numbered by falling length; (unit, token) pairs are counted by sorting.
    owner = np.repeat(rank, lengths)
    used = keep[codes]
    pairs, tf = np.unique(owner[used] * len(tokens) + codes[used], return_counts=True)
    unit, code = np.divmod(pairs, max(1, len(tokens)))
    impact = np.minimum(tf, HIGHEST)
    by_block = np.lexsort((unit, -impact, code, unit // BLOCK))
    unit, code, impact = unit[by_block], code[by_block], impact[by_block]
    edges = np.searchsorted(unit // BLOCK, np.arange(-(-len(order) // BLOCK) + 1))
    blocks = []
    for b, (start, end) in enumerate(zip(edges[:-1], edges[1:])):
        terms, first, counts = np.unique(code[start:end], return_index=True, return_counts=True)
        blocks.append({
            "units": [units[k] for k in order[b * BLOCK : (b + 1) * BLOCK]], "terms": terms.astype("<u4").tobytes(), "counts": counts.astype("<u4").tobytes(),
            "maxima": impact[start:end][first].astype(np.uint8).tobytes(), "slots": (unit[start:end] - b * BLOCK).astype(np.uint8).tobytes(), "impacts": impact[start:end].astype(np.uint8).tobytes(),
        })
    return len(units), tokens, np.bincount(code, minlength=len(tokens)).tolist(), blocks


def _parts(batch: pa.RecordBatch, most: int, most_bytes: int) -> Iterator[pa.RecordBatch]:
    """A batch of texts as segments of so many units and bytes at most, one unit at least."""
    upto = np.cumsum(np.asarray(pc.fill_null(pc.binary_length(batch.column("text")), 0), np.int64))
    start = 0
    while start < batch.num_rows:
        before = upto[start - 1] if start else 0
        end = min(start + most, max(start + 1, int(np.searchsorted(upto, before + most_bytes, "right"))))
        yield batch.slice(start, end - start)
        start = end


def build(texts: DataFrame, unit: str, text: Column, profile: str = "block") -> DataFrame:
    """The index of ``texts``, one row per segment; write it to keep it. ``unit`` is an integer or string column."""
    stop, shortest = pa.array(_STOPS[profile], pa.string()), 2 if profile == "page" else 1
    kind = texts.schema[unit].dataType.simpleString()
    binary = [(c, pa.binary()) for c in ("terms", "counts", "maxima", "slots", "impacts")]
    blocks = pa.list_(pa.struct([("units", pa.list_(_ARROW[kind])), *binary]))
    schema = pa.schema([("n_units", pa.int32()), ("tokens", pa.list_(pa.string())), ("df", pa.list_(pa.int32())), ("blocks", blocks)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in (part for held in batches for part in _parts(held, *bounds)):
            if b.num_rows:
                n, tokens, df, found = _segment(b.column("unit").to_pylist(), b.column("text").to_pylist(), stop, shortest)
                yield pa.RecordBatch.from_arrays([pa.array([n], pa.int32()), pa.ListArray.from_arrays([0, len(tokens)], tokens), pa.array([df], schema.field("df").type), pa.array([found], blocks)], schema=schema)

    bounded(texts.sparkSession)
    bounds = SEGMENT, SEGMENT_BYTES
    rows = texts.select(F.col(unit).alias("unit"), text.cast("string").alias("text"))
    cores = texts.sparkSession.sparkContext.defaultParallelism
    if 0 < len(texts.inputFiles()) < cores:  # a few files may be a single task; many are left as they lie
        rows = rows.repartition(cores)
    return rows.mapInArrow(run, INDEX.format(unit=kind))


def weights(index: DataFrame, queries: DataFrame) -> DataFrame:
    """(qid, token, weight) of query terms that some unit holds."""
    asked = queries.select("token").distinct()
    found = index.select(F.explode(F.arrays_zip("tokens", "df")).alias("p")).select(F.col("p.tokens").alias("token"), F.col("p.df").alias("n")).where("n > 0")
    df = found.join(asked, "token", "left_semi").groupBy("token").agg(F.sum("n").alias("df"))
    n = index.agg(F.sum("n_units").alias("n_units"))
    weighed = queries.join(df, "token").crossJoin(F.broadcast(n))  # one row
    return weighed.select("qid", "token", (F.col("q_tf") * idf(F.col("n_units"), F.col("df"))).alias("weight"))


class Asked:
    """A bounded set of queries as arrays: terms of one query stand together, by token."""

    def __init__(self, rows: list):
        rows = sorted(rows, key=lambda r: (r["qid"], r["token"]))
        self.qids = list(dict.fromkeys(r["qid"] for r in rows))
        place = {q: k for k, q in enumerate(self.qids)}
        vocabulary = {t: k for k, t in enumerate(sorted({r["token"] for r in rows}))}
        self.tokens = pa.array(vocabulary, pa.string())
        self.terms = np.asarray([vocabulary[r["token"]] for r in rows], np.int64)
        self.weight = np.asarray([r["weight"] for r in rows], np.float64)
        owner = np.asarray([place[r["qid"]] for r in rows], np.int64)
        self.starts = np.searchsorted(owner, np.arange(len(self.qids)))
        self.sizes = np.diff(np.append(self.starts, len(rows)))


class Best:
    """The k best units of each query that one task has seen, and how many pairs it scored."""

    def __init__(self, asked: Asked, k: int, least: np.ndarray | None):
        self.asked, self.k, self.least = asked, k, least
        n = len(asked.qids)
        self.units: list[list] = [[] for _ in range(n)]
        self.floor = np.full(n, -np.inf)
        self.scored = 0

    def meet(self, tokens: pa.Array, blocks: list[dict]) -> Iterator[tuple]:
        """Score a segment; units that match ``least`` terms go out at once, whatever their rank."""
        asked = self.asked
        local = np.asarray(pc.fill_null(pc.index_in(tokens, value_set=asked.tokens), -1), np.int64)
        known = []
        top = np.zeros((len(asked.tokens), len(blocks)), np.uint8)
        for b, block in enumerate(blocks):
            term = local[np.frombuffer(block["terms"], "<u4")]
            known.append((term, term >= 0))
            top[term[term >= 0], b] = np.frombuffer(block["maxima"], np.uint8)[term >= 0]
        highest = top[asked.terms]
        bound = np.add.reduceat(highest * asked.weight[:, None], asked.starts)
        possible = bound > 0
        whole = None if self.least is None else np.add.reduceat((highest > 0).astype(np.int32), asked.starts) >= self.least[:, None]
        first = possible & (np.argsort(np.argsort(-bound, axis=1, kind="stable"), axis=1) < FIRST)
        if whole is not None:
            first |= possible & whole
        dense: dict[int, np.ndarray] = {}
        for looked in (first, possible & ~first):
            for b in np.flatnonzero(looked.any(0)).tolist():
                queries = np.flatnonzero(looked[:, b] & ((bound[:, b] + 1e-5 >= self.floor) | (whole[:, b] if whole is not None else False)))
                if len(queries):
                    if b not in dense:
                        dense[b] = self._impacts(blocks[b], *known[b])
                    yield from self._score(blocks[b]["units"], dense[b], queries)

    def _impacts(self, block: dict, term: np.ndarray, known: np.ndarray) -> np.ndarray:
        """Impacts by (query term, slot): the block's postings of these terms."""
        counts = np.frombuffer(block["counts"], "<u4").astype(np.int64)
        out = np.zeros((len(self.asked.tokens), len(block["units"])), np.uint8)
        asked = np.repeat(known, counts)
        slots, impacts = np.frombuffer(block["slots"], np.uint8), np.frombuffer(block["impacts"], np.uint8)
        out[np.repeat(term, counts)[asked], slots[asked]] = impacts[asked]
        return out

    def _score(self, units: list, dense: np.ndarray, queries: np.ndarray) -> Iterator[tuple]:
        asked = self.asked
        sizes = asked.sizes[queries]
        cut = np.concatenate([[0], np.cumsum(sizes)[:-1]])
        rows = np.repeat(asked.starts[queries] - cut, sizes) + np.arange(sizes.sum())
        hit = dense[asked.terms[rows]]
        score = np.round(np.add.reduceat(hit * asked.weight[rows, None], cut, axis=0), 6)
        matched = np.add.reduceat((hit > 0).astype(np.int32), cut, axis=0)
        self.scored += int((matched > 0).sum())
        if self.least is not None:
            for k, u in zip(*(x.tolist() for x in np.nonzero(matched >= self.least[queries][:, None]))):
                yield int(queries[k]), units[u], float(score[k, u]), int(matched[k, u]), True
        better = (matched > 0) & (score >= self.floor[queries][:, None])
        for k in np.flatnonzero(better.any(1)).tolist():
            q, at = int(queries[k]), np.flatnonzero(better[k]).tolist()
            best = self.units[q]
            best += [(-float(score[k, u]), units[u], int(matched[k, u])) for u in at]
            if len(best) > self.k:
                best.sort()
                del best[self.k :]
            if len(best) == self.k:
                self.floor[q] = -max(b[0] for b in best)

    def rows(self) -> Iterator[tuple]:
        for q, best in enumerate(self.units):
            for s, unit, m in best:
                yield q, unit, -s, m, False


def search(index: DataFrame, queries: DataFrame, k: int, least_share: float | None = None) -> DataFrame:
    """(qid, unit, score, matched, rank): each query's k best units, from 1.

    queries: (qid, token, q_tf). With ``least_share`` also all units that match at
    least that share of a query's tokens, whatever their rank. Scores are rounded to
    six places, as they are compared. ``index`` is read twice.
    """
    spark = bounded(index.sparkSession)
    kind = index.schema["blocks"].dataType.elementType["units"].dataType.elementType.simpleString()
    known = weights(index, queries).join(queries.groupBy("qid").agg(F.count("*").alias("n_terms")), "qid")
    n_passes = max(1, -(-queries.count() // QUERY_TERMS))
    qid = queries.schema["qid"].dataType.simpleString()
    schema = f"qid {qid}, unit {kind}, score double, matched long, whole boolean"
    found = None
    for at in range(n_passes):
        some = known if n_passes == 1 else known.where(F.pmod(F.xxhash64("qid"), F.lit(n_passes)) == at)
        rows = some.collect()  # about QUERY_TERMS at most
        if not rows:
            continue
        shared = spark.sparkContext.broadcast((Asked(rows), {r["qid"]: r["n_terms"] for r in rows}))

        def run(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            asked, sizes = shared.value
            least = None if least_share is None else np.asarray([max(1, np.ceil(least_share * sizes[q] - 1e-9)) for q in asked.qids])
            best = Best(asked, k, least)
            held: list[tuple] = []
            for tokens, blocks in _segments(batches):
                held.extend(best.meet(tokens, blocks))
                if len(held) >= BATCH:
                    yield _rows(held, asked, arrow)
                    held = []
            held.extend(best.rows())
            for start in range(0, len(held), BATCH):
                yield _rows(held[start : start + BATCH], asked, arrow)

        arrow = _schema(qid, kind)
        part = index.select("tokens", "blocks").mapInArrow(run, schema)
        found = part if found is None else found.unionByName(part)
    if found is None:
        return spark.createDataFrame([], schema.replace("whole boolean", "rank long"))
    order = [F.col("score").desc(), F.col("unit")]
    ranked = top_k(found.where("not whole").drop("whole"), ["qid"], order, k)
    if least_share is None:
        return ranked
    # A unit may be both among a task's best and whole; the rank counts if it has one.
    matching = found.where("whole").select("qid", "unit", "score", "matched", F.lit(None).cast("long").alias("rank"))
    return ranked.unionByName(matching).groupBy("qid", "unit").agg(F.max("score").alias("score"), F.max("matched").alias("matched"), F.min("rank").alias("rank"))


def _segments(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.Array, list[dict]]]:
    for b in batches:
        tokens, blocks = b.column("tokens"), b.column("blocks")
        for k in range(b.num_rows):
            yield tokens[k].values, blocks[k].as_py()


def _schema(qid: str, kind: str) -> pa.Schema:
    return pa.schema([("qid", _ARROW[qid]), ("unit", _ARROW[kind]), ("score", pa.float64()), ("matched", pa.int64()), ("whole", pa.bool_())])


def _rows(held: list[tuple], asked: Asked, schema: pa.Schema) -> pa.RecordBatch:
    q, units, scores, matched, whole = zip(*held)
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(([asked.qids[k] for k in q], units, scores, matched, whole), schema)], schema=schema)


def scored_share(index: DataFrame, queries: DataFrame, k: int) -> tuple[int, int]:
    """(pairs scored, pairs that share a token) over all tasks of a search: what the maxima save."""
    rows = weights(index, queries).collect()
    shared = index.sparkSession.sparkContext.broadcast(Asked(rows))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        skipping, all_pairs = Best(shared.value, k, None), Best(shared.value, 1 << 60, None)
        for segment in _segments(batches):
            for found in (skipping, all_pairs):
                list(found.meet(*segment))
        yield pa.RecordBatch.from_arrays([pa.array([skipping.scored]), pa.array([all_pairs.scored])], ["scored", "sharing"])

    total = index.select("tokens", "blocks").mapInArrow(run, "scored long, sharing long").agg(F.sum("scored"), F.sum("sharing")).first()
    return total[0] or 0, total[1] or 0
