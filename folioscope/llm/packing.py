"""Best-fit packing by a grouping genetic algorithm.

Documents are encoded and cut into pieces of at most ``capacity`` tokens. Full
pieces are sequences by themselves. The others are dealt at random into blocks of
bounded size; each block is packed by several islands, each with a population of
its own, which starts from random-order fits. A chromosome is a list of bins:
crossover injects whole well-filled bins of one parent into the other, drops the
bins that then hold duplicates, and best-fits the displaced pieces, longest first.
Between epochs each island gets its neighbour's elite. The fittest island's
packing is the block's; pieces of its under-filled bins are dealt and packed once
more across blocks.

Defined cases: a null or empty text is the end id alone; documents are told apart
by row, so doc_id may repeat or be null; equal lengths are ordered by piece
number; an empty table gives no piece; other columns are not read. A block holds
about ``BLOCK`` pieces at any input size, so no group grows with the data.
"""

from __future__ import annotations

import math
import zlib
from bisect import bisect_left, insort
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from folioscope.llm.common import lean, texts, written
from folioscope.llm.encoding import encoder

CAPACITY = 4096
BLOCK = 4000
ISLANDS = 2
EPOCHS = 2
POPULATION = 6
#: Generations without a gain after which an island's epoch ends.
PATIENCE = 15
#: Bins filled below this share are dealt again across blocks.
SETTLED = 0.985

PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long"


def cut(docs: DataFrame, tokenizer: str, end_id: int, capacity: int = CAPACITY) -> DataFrame:
    """The pieces of all documents, without their ids. No shuffle."""
    def pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(tokenizer)
        for batch in batches:
            for row, offsets, ids in enc.encode_batches(batch.column("text"), end_id):
                out: list[list] = [[], [], [], [], []]
                bounds = offsets.tolist()
                for k, (a, b) in enumerate(zip(bounds[:-1], bounds[1:], strict=True)):
                    for number, at in enumerate(range(a, b, capacity)):
                        to = min(at + capacity, b)
                        for column, value in zip(out, (row + k, number, at - a, to - at, zlib.crc32(ids[at:to])), strict=True):
                            column.append(value)
                types = (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64())
                columns = [pa.array(c, t) for c, t in zip(out, types, strict=True)]
                yield pa.RecordBatch.from_arrays([batch.column("doc_id").take(columns[0]), *columns[1:]], ["doc_id", "piece", "start", "length", "ids_crc32"])

    return texts(docs).mapInArrow(lean(pieces), PIECES)


# --- one block's genetic algorithm -------------------------------------------------------------


class Bins:
    """A packing: bins of piece numbers, ordered by what room they have left.

    Bins are never changed in place, so that parents and children share them.
    """

    def __init__(self, capacity: int, items: list[list[int]], room: list[int]):
        self.capacity, self.items, self.room = capacity, items, room
        self.order = sorted(r << 32 | b for b, r in enumerate(room))

    def best_fit(self, item: int, length: int) -> None:
        """Into the fullest bin that has room, else into a new one."""
        order = self.order
        at = bisect_left(order, length << 32)
        if at == len(order):
            insort(order, (self.capacity - length) << 32 | len(self.items))
            self.items.append([item])
            self.room.append(self.capacity - length)
            return
        b = order.pop(at) & 0xFFFFFFFF
        self.items[b] = [*self.items[b], item]
        self.room[b] -= length
        insort(order, self.room[b] << 32 | b)

    def fitness(self) -> tuple[int, float]:
        """Fewer bins first; then fuller bins (sum of squared rooms), which leave room to gain."""
        return -len(self.items), float(sum(r * r for r in self.room))


def fit_all(lengths: list[int], order: list[int], capacity: int) -> Bins:
    bins = Bins(capacity, [], [])
    for i in order:
        bins.best_fit(i, lengths[i])
    return bins


def crossover(a: Bins, b: Bins, lengths: list[int], rng: np.random.Generator) -> Bins:
    """Some whole well-filled bins of b, the bins of a they don't touch, best fit for the rest.

    The emptiest bins of a, and a few at random, are opened too: their pieces are
    displaced like those that lose their bin to an injected one, and are put back
    longest first.
    """
    full = [x & 0xFFFFFFFF for x in b.order[: max(1, len(b.order) // 2)]]
    injected = [full[k] for k in rng.choice(len(full), max(1, int(len(full) * rng.uniform(0.02, 0.15))), replace=False).tolist()]
    items, room, taken = [b.items[k] for k in injected], [b.room[k] for k in injected], bytearray(len(lengths))
    for held in items:
        for i in held:
            taken[i] = 1
    opened = {x & 0xFFFFFFFF for x in a.order[-max(2, int(len(a.order) * rng.uniform(0.01, 0.2))):]}
    opened.update(rng.choice(len(a.items), int(len(a.items) * rng.uniform(0, 0.2)), replace=False).tolist())
    displaced: list[int] = []
    for k, held in enumerate(a.items):
        if k in opened or any(map(taken.__getitem__, held)):
            displaced += [i for i in held if not taken[i]]
        else:
            items.append(held)
            room.append(a.room[k])
    child = Bins(a.capacity, items, room)
    for i in sorted(displaced, key=lengths.__getitem__, reverse=True):
        child.best_fit(i, lengths[i])
    return child


def from_assignment(assigned: list[int], lengths: list[int], capacity: int) -> Bins:
    groups: dict[int, list[int]] = {}
    for i, b in enumerate(assigned):
        groups.setdefault(b, []).append(i)
    return Bins(capacity, list(groups.values()), [capacity - sum(lengths[i] for i in items) for items in groups.values()])


def evolve(lengths: list[int], capacity: int, seed: int, elites: list[list[int]], population: int = POPULATION, patience: int = PATIENCE) -> tuple[Bins, int]:
    """The fittest packing and the crossovers made for it.

    Parents are the elites that came, and random-order fits. A generation crosses
    the fittest with another parent, and the child replaces the least fit if it
    is fitter. It ends after ``patience`` generations without a fitter child
    (the same number at any size); at the lower bound, which can't be beaten,
    after the first one.
    """
    rng = np.random.default_rng(seed)
    least = -(-sum(lengths) // capacity)
    people = [from_assignment(e, lengths, capacity) for e in elites]
    while len(people) < population:
        people.append(fit_all(lengths, rng.permutation(len(lengths)).tolist(), capacity))
    ranked = sorted(((p.fitness(), k, p) for k, p in enumerate(people)), reverse=True)
    made = idle = 0
    while idle < patience and (not made or -ranked[0][0][0] > least):
        other = 1 + int(rng.integers(len(ranked) - 1))
        pair = (ranked[0][2], ranked[other][2])
        child = crossover(*(pair if rng.random() < 0.7 else pair[::-1]), lengths, rng)
        made += 1
        fit = child.fitness()
        idle = 0 if fit > ranked[0][0] else idle + 1
        if fit > ranked[-1][0]:
            ranked[-1] = (fit, population + made, child)
            ranked.sort(reverse=True)
    return ranked[0][2], made


# --- islands over Spark ------------------------------------------------------------------------


def _islands(batches: Iterator[pa.RecordBatch], capacity: int) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for row in batch.to_pylist():
            lengths = [x["length"] for x in row["items"]]
            best, made = evolve(lengths, capacity, row["block"] * ISLANDS + row["island"] + (1 << 40) * len(row["elites"] or []), row["elites"] or [])
            assigned = np.empty(len(lengths), np.int32)
            for b, items in enumerate(best.items):
                assigned[items] = b
            bins, fill = best.fitness()
            yield pa.RecordBatch.from_pylist(
                [{"block": row["block"], "island": row["island"], "score": {"bins": bins, "fill": fill}, "crossovers": made, "assigned": assigned.tolist()}],
                schema=pa.schema([("block", pa.int64()), ("island", pa.int32()), ("score", pa.struct([("bins", pa.int64()), ("fill", pa.float64())])), ("crossovers", pa.int64()), ("assigned", pa.list_(pa.int32()))]),
            )


def _place(batches: Iterator[pa.RecordBatch], capacity: int) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for row in batch.to_pylist():
            pid = np.asarray([x["pid"] for x in row["items"]], np.int64)
            length = np.asarray([x["length"] for x in row["items"]], np.int64)
            of = np.asarray(row["assigned"], np.int64)
            order = np.argsort(of, kind="stable")
            sorted_of, sorted_len = of[order], length[order]
            before = np.cumsum(sorted_len) - sorted_len
            first = np.searchsorted(sorted_of, sorted_of, "left")
            load = np.bincount(of, weights=length)
            n = len(pid)
            yield pa.RecordBatch.from_arrays(
                [pa.array(pid[order]), pa.array(length[order]), pa.array(np.full(n, row["block"], np.int64)), pa.array(sorted_of), pa.array(before - before[first]), pa.array(load[sorted_of] >= SETTLED * capacity)],
                ["pid", "length", "block", "bin", "offset", "settled"],
            )


def _pack_blocks(items: DataFrame, n: int, capacity: int, label: str, salt: int) -> DataFrame:
    """(pid, length, block, bin, offset, settled) of items (pid, length)."""
    blocks = max(1, math.ceil(n / BLOCK))
    dealt = items.withColumn("block", F.pmod(F.xxhash64("pid", F.lit(salt)), F.lit(blocks).cast("long")))
    held = dealt.groupBy("block").agg(F.sort_array(F.collect_list(F.struct("pid", "length"))).alias("items"))
    held = written(held, f"{label}-blocks")
    island = F.explode(F.array(*[F.lit(i) for i in range(ISLANDS)])).alias("island")
    empty = F.lit(None).cast("array<array<int>>").alias("elites")
    state = held.select("block", island, "items", empty)
    for epoch in range(EPOCHS):
        state = state.repartition("block", "island")
        results = state.mapInArrow(lean(lambda b: _islands(b, capacity)), "block long, island int, score struct<bins:long,fill:double>, crossovers long, assigned array<int>")
        results = written(results, f"{label}-epoch{epoch}")
        if epoch + 1 < EPOCHS:
            # Elite migration: an island goes on from its own elite and its neighbour's on the ring.
            moved = results.select("block", F.explode(F.array(F.col("island"), (F.col("island") + 1) % ISLANDS)).alias("island"), "assigned")
            elites = moved.groupBy("block", "island").agg(F.collect_list("assigned").alias("elites"))
            state = held.select("block", island, "items").join(elites, ["block", "island"])
    best = results.groupBy("block").agg(F.max_by("assigned", F.struct("score", -F.col("island"))).alias("assigned"))
    return held.join(best, "block").mapInArrow(lean(lambda b: _place(b, capacity)), "pid long, length long, block long, bin long, offset long, settled boolean")


def assign(pieces: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """pid, sequence_id, offset for pieces (pid, length); sequence ids of full pieces are negative."""
    full = pieces.where(F.col("length") >= capacity).select("pid", (-1 - F.col("pid")).alias("sequence_id"), F.lit(0).cast("long").alias("offset"))
    part = pieces.where(F.col("length") < capacity).select("pid", "length")
    n = part.count()
    if not n:
        return full
    first = written(_pack_blocks(part, n, capacity, "pack", 1), "placed")
    done, again = first, None
    rest = first.where(~F.col("settled")).select("pid", "length")
    left = rest.count()
    if left:
        done = first.where("settled")
        again = _pack_blocks(rest, left, capacity, "repack", 2)
    number = lambda kind: (F.col("block") * (1 << 20) + F.col("bin")) * 2 + kind
    out = full.unionByName(done.select("pid", number(0).alias("sequence_id"), "offset"))
    return out if again is None else out.unionByName(again.select("pid", number(1).alias("sequence_id"), "offset"))


def pack(docs: DataFrame, tokenizer: str, end_id: int, capacity: int = CAPACITY) -> DataFrame:
    """Every piece with its sequence and place in it."""
    pieces = written(cut(docs, tokenizer, end_id, capacity).withColumn("pid", F.monotonically_increasing_id()), "pieces")
    return pieces.join(assign(pieces.select("pid", "length"), capacity), "pid").select("doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset")
