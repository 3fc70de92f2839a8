"""The prefix trie of conversations, by an external mergesort that knows shared turns.

A turn is a code of 20 bytes: 16 of a digest over role and text, 4 for the text's
code points. A conversation is the codes of its turns in a row, so whole texts are
read once and never shuffled again.

1. Each task sorts runs of bounded size. Equal paths of a run are one entry with
   their ids; an entry carries how many turns it shares with the one before (its
   LCP) and stores the other codes only. Sampled splitters over (path, id) deal a
   run's entries to parts; paths that many conversations have are split by id.
2. A part merges its runs with a loser tree. Entries are compared by their LCPs
   with the last winner first, so shared turns are not compared again.
3. The merged stream drives a stack of open nodes: what lies below the LCP is
   finished and goes out, its children with it, as they need its least id.
4. Nodes on a splitter's path may go on in another part. Their sums meet by key;
   there are no more of them than turns in the splitters, which the driver has
   drawn anyway. Ids that end at such a node are joined in chunks.

Defined cases: a null role or text is empty; a null turn comes first, turns that
tie are ordered by code; repeated rows are repeated turns; rows with a null
conv_id belong to no conversation; a conversation without turns ends at the root;
an empty table gives no node, not even the root; other columns are not read. The
codes of one conversation (20 bytes a turn) are held in one task.
"""

from __future__ import annotations

import hashlib
from bisect import bisect_right
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import BinaryType, LongType, StringType, StructField, StructType

from folioscope.llm.common import discard, fresh, lean, prepare, written

WIDTH = 20
#: Bytes of the paths of a run, and of a part; sampled paths of a part.
RUN_BYTES, PART_BYTES, SAMPLES = 16 << 20, 16 << 20, 16
#: Ids of a chunk of a node's ends, and rows of an output batch.
CHUNK, BATCH = 50_000, 5_000
#: Nodes on splitters' paths up to which their ids are broadcast (some 50 bytes each).
BROADCAST_NODES = 100_000
LEAST = -(1 << 63)
PIECES = "part int, lcps binary, sizes binary, codes binary, counts binary, ids binary"
#: kind 0: whole nodes; 1: whole nodes whose parent may go on elsewhere; 2: sums of such
#: nodes; 3: ids that end at such nodes.
NODES = (
    "kind int, key binary, parent_key binary, conv_id long, depth long, parent_conv_id long, n_convs long, n_children long, n_leaves long, saved_tokens long, chars long, ends string"
)
RESULT = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]
NO_ENDS = hashlib.sha256(b"").hexdigest()


def code(role: Column, text: Column) -> Column:
    digest = F.unhex(F.sha2(F.concat(F.length(role).cast("string"), F.lit(":"), role, text).cast("binary"), 256))
    return F.concat(F.substring(digest, 1, 16), F.unhex(F.lpad(F.hex(F.length(text)), 8, "0")))


def codes(conversations: DataFrame, *more: Column) -> DataFrame:
    """(conv_id, turn, code) and ``more``."""
    role, text = (F.coalesce(F.col(c).cast("string"), F.lit("")) for c in ("role", "text"))
    rows = conversations.where(F.col("conv_id").isNotNull()).select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), code(role, text).alias("code"))
    return rows.select("*", *more)


def _path(turns: Column) -> Column:
    return F.unhex(F.array_join(F.transform(turns, lambda c: F.hex(c)), ""))


def paths(conversations: DataFrame) -> DataFrame:
    """(conv_id, path): each conversation's codes in order of turn."""
    whole = codes(conversations).groupBy("conv_id").agg(F.sort_array(F.collect_list(F.struct("turn", "code"))).alias("t"))
    return whole.select("conv_id", _path(F.transform("t", lambda x: x["code"])).alias("path"))


def rebuilt_paths(conversations: DataFrame, family: int = 100, heads: int = 6) -> DataFrame:
    """(conv_id, path) after each conversation took over turns of its family's first.

    The first h turns are those of conversation c - c % family, the others its own
    after its first h, with h = crc32(c as text) % heads. Turns meet once, by family.
    """
    base = (F.col("conv_id") - F.col("conv_id") % family).alias("base")
    whole = codes(conversations, base).repartition("base").groupBy("base", "conv_id").agg(F.sort_array(F.collect_list(F.struct("turn", "code"))).alias("t"))
    own = whole.select("base", "conv_id", F.transform("t", lambda x: x["code"]).alias("own"), (F.crc32(F.col("conv_id").cast("string").cast("binary")) % heads).cast("int").alias("h"))
    first = F.max(F.when(F.col("conv_id") == F.col("base"), F.slice("own", 1, heads))).over(Window.partitionBy("base"))
    both = own.withColumn("first", F.coalesce(first, F.slice("own", 1, 0)))
    rest = F.slice("own", F.col("h") + 1, F.greatest(F.size("own") - F.col("h"), F.lit(0)))
    return both.select("conv_id", _path(F.concat(F.slice("first", F.lit(1), F.col("h")), rest)).alias("path"))


def common(a: bytes, b: bytes, at: int = 0) -> int:
    """Turns that two paths share; the first ``at`` are known to be shared."""
    most = min(len(a), len(b)) // WIDTH
    step = 1
    # Strides double while they match, then halve: few comparisons, done in C.
    while at < most:
        step = min(step, most - at)
        if a[at * WIDTH : (at + step) * WIDTH] == b[at * WIDTH : (at + step) * WIDTH]:
            at += step
            step *= 2
        elif step == 1:
            break
        else:
            step //= 2
    return at


def separators(sample: list[tuple[bytes, int]], per_part: int = SAMPLES) -> list[tuple[bytes, int]]:
    """Every ``per_part``-th of the sorted sample, cut to the turns that tell it from the one before.

    Where both have one path, the separator is the whole path and an id. Others stand
    before all ids.
    """
    rows, found = sorted(sample), []
    for k in range(per_part, len(rows), per_part):
        before, row = rows[k - 1], rows[k]
        if before[0] == row[0]:
            found.append(row)
        else:
            found.append((row[0][: (common(before[0], row[0]) + 1) * WIDTH], LEAST))
    return sorted(set(found))


def front_coded(rows: list[tuple[bytes, int]], splitters: list[tuple[bytes, int]]) -> Iterator[tuple[int, bytes, bytes, bytes, bytes, bytes]]:
    """A sorted run as pieces (part, LCPs, sizes, codes, counts, ids), the parts' ranges apart."""
    rows.sort()
    piece, part, last, k = None, -1, b"", 0
    while k < len(rows):
        path, first = rows[k]
        at = bisect_right(splitters, (path, first))
        until = splitters[at] if at < len(splitters) else None
        end = k
        while end < len(rows) and rows[end][0] == path and (until is None or rows[end] < until):
            end += 1
        if at != part:
            if piece:
                yield _packed(part, piece)
            piece, part, last = ([], [], [], [], []), at, b""
        shared = common(last, path)
        rest = path[shared * WIDTH :]
        for column, value in zip(piece, (shared, len(rest), rest, end - k, [i for _, i in rows[k:end]])):
            column.append(value)
        last, k = path, end
    if piece:
        yield _packed(part, piece)


def _packed(part: int, piece: tuple) -> tuple[int, bytes, bytes, bytes, bytes, bytes]:
    lcps, sizes, rests, counts, ids = piece
    return part, np.array(lcps, "<u4").tobytes(), np.array(sizes, "<u4").tobytes(), b"".join(rests), np.array(counts, "<u4").tobytes(), np.array([i for x in ids for i in x], "<i8").tobytes()


class Run:
    """A cursor over a piece. ``lcp`` is what ``path`` shares with the last path that won against it."""

    def __init__(self, lcps: bytes, sizes: bytes, codes: bytes, counts: bytes, ids: bytes):
        self.entries = iter(zip(np.frombuffer(lcps, "<u4").tolist(), np.frombuffer(sizes, "<u4").tolist(), np.frombuffer(counts, "<u4").tolist()))
        self.codes, self.all_ids, self.at, self.id_at = codes, np.frombuffer(ids, "<i8"), 0, 0
        self.path: bytes | None = b""
        self.advance()

    def advance(self) -> None:
        entry = next(self.entries, None)
        if entry is None:
            self.path = None
            return
        self.lcp, size, count = entry
        self.path = self.path[: self.lcp * WIDTH] + self.codes[self.at : self.at + size]
        self.ids = self.all_ids[self.id_at : self.id_at + count]
        self.at, self.id_at = self.at + size, self.id_at + count


def beats(a: Run, b: Run) -> bool:
    """Whether a comes first; the loser's LCP becomes what it shares with the winner.

    Both LCPs count from the same path: the longer one is the smaller path, and
    shared turns are only looked at where the LCPs are equal.
    """
    if a.path is None or b.path is None:
        return a.path is not None
    if a.lcp != b.lcp:
        return a.lcp > b.lcp
    shared = common(a.path, b.path, a.lcp)
    first = a.path[shared * WIDTH : (shared + 1) * WIDTH] <= b.path[shared * WIDTH : (shared + 1) * WIDTH]
    (b if first else a).lcp = shared
    return first


def merged(runs: list[Run]) -> Iterator[tuple[bytes, int, np.ndarray]]:
    """(path, LCP with the one before, ascending ids) of the distinct paths of sorted runs, by a loser tree."""
    k = len(runs)
    losers, winner = [-1] * max(k, 1), -1
    for i in range(k):
        at, node = i, (i + k) // 2
        while node and losers[node] >= 0:
            if beats(runs[losers[node]], runs[at]):
                losers[node], at = at, losers[node]
            node //= 2
        if node:
            losers[node] = at
        else:
            winner = at
    path, lcp, ids = None, 0, []
    while k and runs[winner].path is not None:
        run = runs[winner]
        if run.path == path:
            ids.append(run.ids)
        else:
            if path is not None:
                yield path, lcp, np.sort(np.concatenate(ids))
            path, lcp, ids = run.path, run.lcp, [run.ids]
        run.advance()
        at, node = winner, (winner + k) // 2
        while node:
            if beats(runs[losers[node]], runs[at]):
                losers[node], at = at, losers[node]
            node //= 2
        winner = at
    if path is not None:
        yield path, lcp, np.sort(np.concatenate(ids))


class Node:
    __slots__ = ("chars", "children", "ends", "id", "leaves", "members", "open_ended", "saved", "waiting")

    def __init__(self, chars: int, open_ended: bool):
        self.chars, self.open_ended = chars, open_ended
        self.id, self.members, self.children, self.leaves, self.saved, self.ends, self.waiting = None, 0, 0, 0, 0, NO_ENDS, []

    def meet(self, least: int, members: int) -> None:
        self.id = least if self.id is None else min(self.id, least)
        self.members += members


def key_of(path: bytes) -> bytes:
    return hashlib.sha256(path).digest()[:16]


def joined(ids: np.ndarray) -> str:
    return ",".join(map(str, ids.tolist()))


def nodes(stream: Iterator[tuple[bytes, int, np.ndarray]], low: tuple[bytes, int] | None, high: tuple[bytes, int] | None) -> Iterator[tuple]:
    """Rows of NODES of one part, whose paths lie from separator ``low`` to before ``high``."""
    edges = [(s[0], len(s[0]) // WIDTH - (s[1] == LEAST)) for s in (low, high) if s is not None]
    stack, last = [Node(0, True)], b""

    def finish() -> Iterator[tuple]:
        node, depth = stack.pop(), len(stack)
        parent = stack[-1] if stack else None
        if node.open_ended:
            yield 2, key_of(last[: depth * WIDTH]), key_of(last[: (depth - 1) * WIDTH]) if depth else None, node.id, depth, None, node.members, node.children, node.leaves, node.saved, node.chars, None
            return
        leaves = node.leaves if node.children else 1
        saved = node.saved + (node.members - 1) * node.chars
        for row in node.waiting:
            yield 0, None, None, row[0], depth + 1, node.id, *row[1:5], None, row[5]
        row = node.id, node.members, node.children, leaves, saved, node.ends
        parent.meet(node.id, node.members)
        parent.children, parent.leaves, parent.saved = parent.children + 1, parent.leaves + leaves, parent.saved + saved
        if parent.open_ended:
            yield 1, None, key_of(last[: (depth - 1) * WIDTH]), row[0], depth, None, *row[1:5], None, row[5]
        else:
            parent.waiting.append(row)

    for path, lcp, ids in stream:
        while len(stack) - 1 > lcp:
            yield from finish()
        shared = max([0, *(min(common(path, edge), most) for edge, most in edges)])
        depth, last = len(path) // WIDTH, path
        for d in range(lcp + 1, depth + 1):
            stack.append(Node(int.from_bytes(path[d * WIDTH - 4 : d * WIDTH], "big"), d <= shared))
        top = stack[-1]
        top.meet(int(ids[0]), len(ids))
        if top.open_ended:
            for k in range(0, len(ids), CHUNK):
                yield 3, key_of(path), None, int(ids[k]), depth, None, None, None, None, None, None, joined(ids[k : k + CHUNK])
        else:
            top.ends = hashlib.sha256(joined(ids).encode()).hexdigest()
    while stack:
        yield from finish()


def batched(rows: Iterator[tuple], schema: pa.Schema, size: int = BATCH) -> Iterator[pa.RecordBatch]:
    held: list[tuple] = []
    weight = 0
    for row in rows:
        held.append(row)
        weight += sum(len(x) for x in row if isinstance(x, (bytes, str)))
        if len(held) >= size or weight > 4 << 20:
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*held), schema)], schema=schema)
            held, weight = [], 0
    if held:
        yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*held), schema)], schema=schema)


def _arrow(ddl: str) -> pa.Schema:
    kinds = {"int": pa.int32(), "long": pa.int64(), "binary": pa.binary(), "string": pa.string()}
    return pa.schema([(name, kinds[kind]) for name, kind in (x.split() for x in ddl.split(","))])


def _runs(splitters: list[tuple[bytes, int]], run_bytes: int):
    @lean
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def pieces() -> Iterator[tuple]:
            rows: list[tuple[bytes, int]] = []
            held = 0
            for b in batches:
                found = b.column("path").to_pylist()
                rows += zip(found, b.column("conv_id").to_pylist())
                held += sum(map(len, found)) + 8 * len(found)
                if held >= run_bytes:
                    yield from front_coded(rows, splitters)
                    rows, held = [], 0
            yield from front_coded(rows, splitters)

        yield from batched(pieces(), _arrow(PIECES))

    return run


def _merge(splitters: list[tuple[bytes, int]]):
    @lean
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def part(at: int, pieces: list[tuple]) -> Iterator[tuple]:
            low, high = splitters[at - 1] if at else None, splitters[at] if at < len(splitters) else None
            return nodes(merged([Run(*p) for p in pieces]), low, high)

        def rows() -> Iterator[tuple]:
            now, pieces = None, []
            for b in batches:
                for at, *piece in zip(*(c.to_pylist() for c in b.columns)):
                    if at != now:
                        if pieces:
                            yield from part(now, pieces)
                        now, pieces = at, []
                    pieces.append(piece)
            if pieces:
                yield from part(now, pieces)

        yield from batched(rows(), _arrow(NODES))

    return run


@lean
def _chunks_digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(key, sha256 of its chunks, comma-joined) where chunks come sorted by key and least id."""
    schema = pa.schema([("key", pa.binary()), ("sha", pa.string())])

    def rows() -> Iterator[tuple]:
        now, digest = None, None
        for b in batches:
            for key, chunk in zip(b.column("key").to_pylist(), b.column("ends").to_pylist()):
                if key != now:
                    if now is not None:
                        yield now, digest.hexdigest()
                    now, digest = key, hashlib.sha256(chunk.encode())
                else:
                    digest.update(b"," + chunk.encode())
        if now is not None:
            yield now, digest.hexdigest()

    yield from batched(rows(), schema)


def settled(rows: list) -> list[tuple]:
    """The nodes on splitters' paths, whole: (key, conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens)."""
    found = {bytes(r["key"]): {**r.asDict(), "parent_key": r["parent_key"] and bytes(r["parent_key"])} for r in rows}
    for node in sorted(found.values(), key=lambda r: -r["depth"]):
        if not node["n_children"]:
            node["n_leaves"] = 1
        node["saved_tokens"] += (node["n_convs"] - 1) * node["chars"]
        parent = found.get(node["parent_key"])
        if parent:
            parent["n_children"] += 1
            parent["conv_id"] = node["conv_id"] if parent["conv_id"] is None else min(parent["conv_id"], node["conv_id"])
            for column in ("n_convs", "n_leaves", "saved_tokens"):
                parent[column] += node[column]
    return [
        (key, r["conv_id"], r["depth"], found[r["parent_key"]]["conv_id"] if r["parent_key"] else None, r["n_convs"], r["n_children"], r["n_leaves"], r["saved_tokens"])
        for key, r in found.items()
    ]


def trie(sequences: DataFrame, part_bytes: int = PART_BYTES, run_bytes: int = RUN_BYTES) -> DataFrame:
    """One row per node of the trie of (conv_id, path): RESULT's columns. ``sequences`` is read twice."""
    spark = prepare(sequences.sparkSession)
    about = sequences.agg(F.count("*").alias("n"), F.sum(F.octet_length("path") + F.lit(8)).alias("bytes")).first()
    kinds = [StructField(c, LongType()) for c in RESULT[:-1]]
    if not about["n"]:
        return spark.createDataFrame([], StructType([*kinds, StructField("ends_sha256", StringType())]))
    n_parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-about["bytes"] // part_bytes))
    every = max(1, about["n"] // (n_parts * SAMPLES))
    # In proportion to the parts, not to the rows
    sample = sequences.where(F.pmod(F.xxhash64("conv_id"), F.lit(every)) == 0).select("path", "conv_id").collect()
    splitters = separators([(bytes(r["path"]), r["conv_id"]) for r in sample])
    pieces = sequences.select("conv_id", "path").mapInArrow(_runs(splitters, run_bytes), PIECES)
    dealt = pieces.repartition(len(splitters) + 1, "part").sortWithinPartitions("part")
    path = fresh(spark, "trie-nodes")
    dealt.mapInArrow(_merge(splitters), NODES).write.partitionBy("kind").parquet(path)
    rows = spark.read.schema(NODES).parquet(path)

    open_rows = rows.where("kind = 2").groupBy("key", "parent_key", "depth", "chars")
    sums = [F.sum(c).alias(c) for c in ("n_convs", "n_children", "n_leaves", "saved_tokens")]
    whole = settled(open_rows.agg(F.min("conv_id").alias("conv_id"), *sums).collect())  # at most the turns of the splitters
    known = spark.createDataFrame(whole, StructType([StructField("key", BinaryType()), *kinds]))
    ends = rows.where("kind = 3").select("key", F.col("conv_id").alias("least"), "ends").repartition("key").sortWithinPartitions("key", "least")
    ends = ends.select("key", "ends").mapInArrow(_chunks_digest, "key binary, sha string")
    edge = known.join(ends, "key", "left").select(*RESULT[:-1], F.coalesce("sha", F.lit(NO_ENDS)).alias("ends_sha256"))

    parents = known.select(F.col("key").alias("parent_key"), F.col("conv_id").alias("parent"))
    below = rows.where("kind = 1").drop("parent_conv_id").join(F.broadcast(parents) if len(whole) <= BROADCAST_NODES else parents, "parent_key")
    below = below.select("conv_id", "depth", F.col("parent").alias("parent_conv_id"), *RESULT[3:-1], F.col("ends").alias("ends_sha256"))
    inner = rows.where("kind = 0").select(*RESULT[:-1], F.col("ends").alias("ends_sha256"))
    return inner.unionByName(below).unionByName(edge)


def conversation_trie(conversations: DataFrame, rebuild: bool = True) -> DataFrame:
    """The trie of conversations, rebuilt by :func:`rebuilt_paths` or as they are."""
    prepare(conversations.sparkSession)
    sequences = written(rebuilt_paths(conversations) if rebuild else paths(conversations), "trie-paths")
    found = trie(sequences)
    discard(sequences)
    return found
