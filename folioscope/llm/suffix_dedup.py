"""Exact repeats of ``span`` bytes, by sampled and range-partitioned suffixes.

Every window of ``span`` bytes chooses an anchor inside itself: the leftmost of
its ``gram``-byte strings with the least fingerprint. Equal windows choose equal
anchors at equal distances, so it is enough to sort the suffixes at anchors,
about 3 in 100 of all. One suffix stands for a run of consecutive windows.

1. Suffixes are dealt to buckets by sampled splitters over their first 16 bytes;
   equal ones are never split. Copies within a batch are settled before that, so
   that a hot passage sends one suffix per batch, not one per copy.
2. Buckets sort locally by multikey quicksort, whose characters are machine
   words: the bytes of the gram, eight at a time, then the fingerprint of the
   whole run, document, place. Neighbours whose grams and runs agree are copies:
   of equal runs all but the first are repeats, window by window.
3. Runs that share a gram but not all windows meet again at their boundaries:
   their bytes are fetched, and each window is compared with those at the same
   distance from an equal gram. A gram that more than ``HOT`` such runs share is
   compared window by window through a keyed minimum instead, which combines
   before the shuffle.

A byte is removed if a repeat covers it. All comparisons use the input texts.

Defined cases: null and empty texts, and those shorter than ``span``, lose
nothing; an invalid order can't arise, as doc_id orders documents (nulls last)
and rows that tie are ordered by text; a repeated row is a later copy of the
first and loses its windows; an empty table gives no row; other columns pass
through unread. A text longer than a chunk is worked through in pieces that overlap
by ``span`` less one bytes, so memory does not grow with it.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import BinaryType, LongType, StringType

from folioscope.llm import kernel as K
from folioscope.llm.common import lean, more_than_set, numbered, partitions, release, written

SPAN, GRAM = 100, 32
#: Rows whose suffixes are looked at for the splitters at least (about, chosen by hash),
#: suffixes that one of them gives at most, and splitters per shuffle partition, while
#: these are ``FINE`` at most; beyond that there is one a partition.
SAMPLED_ROWS, PER_ROW, PER_PARTITION, FINE = 2000, 32, 8, 64_000
#: Boundary runs of one gram compared in one task.
HOT = 100_000

def suffix_schema(gram: int) -> str:
    return "bucket int, " + ", ".join(f"w{k} long" for k in range(gram // 8)) + ", u long, rid long, at long"


def pack_at(p: np.ndarray, first: np.ndarray, last: np.ndarray) -> np.ndarray:
    """The anchor's place, and how far before it its first and last windows start."""
    return (p << 14) | (first << 7) | last


def leftmost_minima(order: np.ndarray, width: int) -> np.ndarray:
    """For each i, the leftmost index of the least of order[i : i + width]."""
    value, index, have = order, np.arange(len(order), dtype=np.int32), 1
    while have < width:
        step = min(have, width - have)
        later = value[step:] < value[:-step]
        index = np.where(later, index[step:], index[:-step])
        value = np.minimum(value[step:], value[:-step])
        have += step
    return index


def suffixes(buf: np.ndarray, offsets: np.ndarray, span: int = SPAN, gram: int = GRAM) -> tuple[np.ndarray, ...]:
    """(text, words of the gram, run's fingerprint, anchor, first, last window).

    Windows are numbered by their first byte within their text. A window's
    anchor starts at it or up to span - gram bytes later. The gram's bytes are
    one row of big-endian words, so that their order is that of the suffixes.
    """
    none = np.zeros(0, np.int64)
    nothing = none, np.zeros((0, gram // 8), K.U), none.view(K.U), none, none, none
    if len(buf) < span:
        return nothing
    prints = K.Rolling(buf, 2 * span)
    anchor = leftmost_minima((prints.every(gram) >> K.U(32)).astype(np.uint32), span - gram + 1)
    doc_of = np.repeat(np.arange(len(offsets) - 1, dtype=np.int32), np.diff(offsets))
    n = len(anchor)
    q = np.flatnonzero(doc_of[:n] == doc_of[span - 1: span - 1 + n])
    p = anchor[q].astype(np.int64)
    if not len(q):
        return nothing
    fresh = np.ones(len(q), bool)
    fresh[1:] = (p[1:] != p[:-1]) | (q[1:] != q[:-1] + 1)
    first = np.flatnonzero(fresh)
    last = np.append(first[1:], len(q)) - 1
    p, lo, hi = p[first], q[first], q[last]
    u = K.mix(prints.of(lo, hi + span) + ((p - lo) << 8 | (hi - lo)).astype(K.U))
    words = K.words_at(buf)
    lead = np.stack([words[p + 8 * k].byteswap() for k in range(gram // 8)], axis=1)
    doc = doc_of[p].astype(np.int64)
    base = offsets[doc]
    return doc, lead, u, p - base, lo - base, hi - base


def pieces(buf: np.ndarray, offsets: np.ndarray, span: int) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(first byte, bytes, offsets): a chunk as it is, or the overlapping pieces of one long text."""
    if len(offsets) != 2 or len(buf) <= 2 * K.CHUNK:
        yield 0, buf, offsets
        return
    for at in range(0, len(buf) - span + 1, K.CHUNK):
        part = buf[at: at + K.CHUNK + span - 1]
        yield at, part, np.asarray([0, len(part)])


def multikey_quicksort(keys: list[np.ndarray], small: int = 512) -> np.ndarray:
    """The order of rows as strings of the words keys[0], keys[1], ...

    Ternary partitioning by one word at a time; only rows equal in it go on to
    the next word. Short stretches are finished by one library sort.
    """
    n = len(keys[0])
    order = np.arange(n)
    todo = [(0, n, 0)]
    while todo:
        a, b, k = todo.pop()
        if b - a < 2 or k == len(keys):
            continue
        part = order[a:b]
        if b - a <= small:
            order[a:b] = part[np.lexsort([c[part] for c in reversed(keys[k:])])]
            continue
        word = keys[k][part]
        pivot = np.sort(word[:: max(1, len(word) // 9)][:9])[4]
        less, more = word < pivot, word > pivot
        same = ~(less | more)
        i = a + int(less.sum())
        j = i + int(same.sum())
        order[a:b] = np.concatenate([part[less], part[same], part[more]])
        todo += [(a, i, k), (i, j, k + 1), (j, b, k)]
    return order


def leading(lead: np.ndarray) -> np.ndarray:
    """The first 16 bytes of suffixes, in byte order."""
    return np.ascontiguousarray(lead[:, :2]).astype(">u8").view("S16").ravel()


def _emit(docs: DataFrame, splitters: list[bytes], span: int, gram: int) -> DataFrame:
    shared = docs.sparkSession.sparkContext.broadcast(splitters)
    width = gram // 8

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cuts = np.asarray(shared.value, "S16")
        names = ["bucket", *[f"w{k}" for k in range(width)], "u", "rid", "at"]
        for batch in batches:
            ids = batch.column("rid").to_numpy(zero_copy_only=False)
            for part, whole, ends in K.string_chunks(batch, "text"):
                for base, buf, offsets in pieces(whole, ends, span):
                    doc, lead, u, p, lo, hi = suffixes(buf, offsets, span, gram)
                    rid = ids[part][doc] if len(doc) else doc
                    # Of equal runs in this chunk all but the earliest are repeats already.
                    order = np.lexsort([p, rid, u])
                    again = np.zeros(len(order), bool)
                    again[order[1:]] = (u[order[1:]] == u[order[:-1]]) & (lead[order[1:]] == lead[order[:-1]]).all(1)
                    lead[again], u[again] = 0, 0  # nothing is asked of these any more
                    bucket = np.where(again, -1 - (rid & 1023), np.searchsorted(cuts, leading(lead), "right"))
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(bucket.astype(np.int32)), *[pa.array(np.ascontiguousarray(lead[:, k]).view(np.int64)) for k in range(width)],
                         pa.array(u.view(np.int64)), pa.array(rid), pa.array(pack_at(base + p, p - lo, p - hi))],
                        names,
                    )

    return docs.select("rid", "text").mapInArrow(lean(rows), suffix_schema(gram))


def _splitters(docs: DataFrame, span: int, gram: int, wanted: int) -> list[bytes]:
    """Quantiles of the leading bytes of the suffixes of rows chosen by hash.

    The executors read the rows and send leading bytes alone, ``PER_ROW`` of a
    row at most, about two for each splitter and 64,000 at least, so that the driver
    holds 32 bytes a bucket however long they are.
    """
    n = docs.count()
    every = max(1, n // max(SAMPLED_ROWS, 2 * wanted // PER_ROW))

    def heads(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for _, whole, ends in K.string_chunks(batch, "text"):
                found = []
                for _, buf, offsets in pieces(whole, ends, span):
                    doc, lead, *_ = suffixes(buf, offsets, span, gram)
                    first, last = (np.searchsorted(doc, np.arange(len(offsets) - 1), side) for side in ("left", "right"))
                    at = [np.unique(np.linspace(a, b - 1, PER_ROW).astype(np.int64)) for a, b in zip(first, last, strict=True) if b > a]
                    found += leading(lead[np.concatenate(at)]).tolist() if at else []
                step = -(-len(found) // (PER_ROW * (len(ends) - 1))) or 1
                yield pa.RecordBatch.from_arrays([pa.array(found[::step], pa.binary())], ["lead"])

    some = docs.where(F.pmod(F.xxhash64("rid"), F.lit(every)) == 0).select("text").mapInArrow(lean(heads), "lead binary")
    found = np.sort(np.asarray([bytes(r[0]) for r in some.collect()], "S16"))
    if not len(found):
        return []
    return np.unique(found[np.linspace(0, len(found) - 1, wanted + 1).astype(np.int64)[1:-1]]).tolist()


def _sorted_bucket(width: int):
    """Repeats (h null) and boundary runs of the buckets of one partition."""

    def settle(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = [b for b in batches if len(b)]
        if not held:
            return
        t = pa.Table.from_batches(held)
        del held
        get = lambda c: t.column(c).combine_chunks().to_numpy(zero_copy_only=False)
        grams, u, rid, at = [get(f"w{k}").view(K.U) for k in range(width)], get("u").view(K.U), get("rid"), get("at")
        settled = get("bucket") < 0
        del t
        open_ = np.flatnonzero(~settled)
        order = open_[multikey_quicksort([c[open_] for c in (*grams, u, rid, at)])]
        same_gram = np.ones(len(order), bool)
        same_gram[:1] = False
        for c in grams:  # neighbours' common prefix covers the gram
            c = c[order]
            same_gram[1:] &= c[1:] == c[:-1]
        us = u[order]
        same_run = same_gram.copy()
        same_run[1:] &= us[1:] == us[:-1]
        repeat = np.concatenate([np.flatnonzero(settled), order[same_run]])
        firsts = np.flatnonzero(~same_run)
        shared = same_gram[firsts]  # another run of this gram comes before
        shared[:-1] |= same_gram[firsts[1:]]
        edge = order[firsts[shared]]
        h = np.zeros(len(edge), K.U)
        for c in grams:
            h = K.mix(h * K.U(0x9FB21C651E98DF25) + c[edge])
        for rows, known in ((repeat, True), (edge, False)):
            for i in range(0, len(rows), 100_000):
                some = rows[i: i + 100_000]
                yield pa.RecordBatch.from_arrays(
                    [pa.nulls(len(some), pa.int64()) if known else pa.array(h[i: i + 100_000].view(np.int64)), pa.array(rid[some]), pa.array(at[some])], ["h", "rid", "at"]
                )

    return settle


def _contexts(span: int):
    """Windows' bytes of boundary runs; runs of hot grams as one row per window."""

    def fetch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            col = batch.column("text")
            lists = batch.column("runs")
            ends = lists.offsets.to_numpy()
            flat = lists.flatten()
            h_all, at_all, hot_all = (flat.field(i).to_numpy(zero_copy_only=False) for i in range(3))
            ids = batch.column("rid").to_numpy(zero_copy_only=False)
            ends = ends - ends[0]
            hs, rids, ats, datas, keys = [], [], [], [], []
            for i in range(len(batch)):
                data = (col[i].as_py() or "").encode()
                for j in range(ends[i], ends[i + 1]):
                    at = int(at_all[j])
                    p = at >> 14
                    lo, hi = p - ((at >> 7) & 127), p - (at & 127)
                    if not hot_all[j]:
                        hs.append(h_all[j]), rids.append(ids[i]), ats.append(at), datas.append(data[lo: hi + span]), keys.append(None)
                        continue
                    for q in range(lo, hi + 1):
                        digest = hashlib.blake2b(data[q: q + span], digest_size=16).digest()
                        hs.append(h_all[j]), rids.append(ids[i]), ats.append(q), datas.append(None), keys.append(digest)
            yield pa.RecordBatch.from_arrays(
                [pa.array(hs, pa.int64()), pa.array(rids, pa.int64()), pa.array(ats, pa.int64()), pa.array(datas, pa.binary()), pa.array(keys, pa.binary())], ["h", "rid", "at", "data", "key"]
            )

    return fetch


def _compare(span: int, gram: int):
    """Repeated windows among sorted boundary runs, streaming over grams."""
    reach = span - gram + 1

    def judge(h, rid, at, data) -> pa.RecordBatch:
        n = len(h)
        p, left, right = at >> 14, (at >> 7) & 127, at & 127
        lengths = np.asarray([len(d) for d in data], np.int64)
        offsets = np.concatenate([[0], np.cumsum(lengths)])
        prints = K.Rolling(np.frombuffer(b"".join(data), np.uint8), span)
        dup = np.zeros((n, reach + 1), bool)
        for a in range(reach):  # windows that start a bytes before their anchor
            rows = np.flatnonzero((left >= a) & (right <= a))
            if len(rows) < 2:
                continue
            start = offsets[rows] + left[rows] - a
            key = K.mix(prints.of(start, start + span) ^ h[rows].view(K.U))
            order = np.argsort(key, kind="stable")  # stable: rows come by document and place
            dup[rows[order[1:]], a] = key[order[1:]] == key[order[:-1]]
        before = np.zeros_like(dup)
        before[:, 1:] = dup[:, :-1]
        row, a0 = np.nonzero(dup & ~before)
        row1, a1 = np.nonzero(before & ~dup)
        return pa.RecordBatch.from_arrays([pa.array(rid[row]), pa.array(p[row] - (a1 - 1)), pa.array(p[row] - a0)], ["rid", "lo", "hi"])

    def stream(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        carry: list = []
        for batch in batches:
            if not len(batch):
                continue
            now = [*(batch.column(c).to_numpy(zero_copy_only=False) for c in ("h", "rid", "at")), batch.column("data").to_pylist()]
            if carry:
                now = [*(np.concatenate([x, y]) for x, y in zip(carry[:3], now[:3], strict=True)), carry[3] + now[3]]
            cut = int(np.flatnonzero(now[0] != now[0][-1])[-1]) + 1 if now[0][0] != now[0][-1] else 0
            carry = [x[cut:] for x in now]
            if cut:
                yield judge(*[x[:cut] for x in now])
        if carry:
            yield judge(*carry)

    return stream


def repeats(docs: DataFrame, span: int = SPAN, gram: int = GRAM, hot_runs: int = HOT) -> DataFrame:
    """(rid, lo, hi): runs of window starts lo..hi of ``docs`` (rid, text) that repeat an earlier window."""
    if gram % 8 or gram < 16 or not gram <= span < gram + 127:
        raise ValueError("gram must be a multiple of 8 from 16 on, and span at least gram and less than gram + 127")
    parts = partitions(docs)
    # Several buckets a partition even out small tables; large ones need no more than one.
    splitters = _splitters(docs, span, gram, max(parts, min(parts * PER_PARTITION, FINE)))
    dealt = _emit(docs, splitters, span, gram).repartition(*more_than_set(docs, parts), "bucket")
    runs = written(dealt.mapInArrow(lean(_sorted_bucket(gram // 8)), "h long, rid long, at long"), "suffix-runs")
    del dealt
    release(docs.sparkSession)  # the suffixes' shuffle is the largest, and done with
    p = F.shiftright("at", 14)
    left = F.shiftright("at", 7).bitwiseAND(F.lit(127).cast("long"))
    right = F.col("at").bitwiseAND(F.lit(127).cast("long"))
    whole = runs.where(F.col("h").isNull()).select("rid", (p - left).alias("lo"), (p - right).alias("hi"))

    edges = runs.where(F.col("h").isNotNull())
    hot = edges.groupBy("h").count().where(F.col("count") > hot_runs).select("h", F.lit(True).alias("hot"))
    by_text = (
        edges.join(hot, "h", "left")
        .groupBy("rid").agg(F.collect_list(F.struct("h", "at", F.coalesce("hot", F.lit(False)).alias("hot"))).alias("runs"))
        .join(docs.select("rid", "text"), "rid")
    )
    fetched = written(by_text.select("rid", "text", "runs").mapInArrow(lean(_contexts(span)), "h long, rid long, at long, data binary, key binary"), "suffix-edges", compression="zstd")
    release(docs.sparkSession)
    near = (
        fetched.where(F.col("key").isNull()).select("h", "rid", "at", "data")
        .repartition("h").sortWithinPartitions("h", "rid", "at")
        .mapInArrow(lean(_compare(span, gram)), "rid long, lo long, hi long")
    )
    windows = fetched.where(F.col("key").isNotNull()).select("key", "rid", F.col("at").alias("q"))
    first = windows.groupBy("key").agg(F.min(F.struct("rid", "q")).alias("first"))
    far = windows.join(first, "key").where(F.struct("rid", "q") != F.col("first")).select("rid", F.col("q").alias("lo"), F.col("q").alias("hi"))
    return whole.unionByName(near).unionByName(far)


def _strip(span: int, as_text: bool):
    def strip(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: list[list] = [[], [], [], []]
            for text, spans in zip(map(pa.StringScalar.as_py, batch.column("text")), batch.column("spans").to_pylist(), strict=True):
                data = (text or "").encode()
                at, kept, removed, n_spans = 0, [], 0, 0
                reach = -1
                for s in sorted((s["lo"], s["hi"]) for s in spans or ()):
                    lo, end = s[0], s[1] + span
                    if lo > reach:  # a run of its own
                        kept.append(data[at:lo])
                        n_spans += 1
                        removed += end - lo
                        at = reach = end
                    elif end > reach:
                        removed += end - reach
                        at = reach = end
                kept.append(data[at:])
                for column, value in zip(out, (len(data), removed, n_spans, b"".join(kept)), strict=True):
                    column.append(value)
            left = pa.array([x.decode("utf-8", "ignore") for x in out[3]], pa.string()) if as_text else pa.array(out[3], pa.binary())
            n = batch.num_columns
            keep = [batch.column(i) for i in range(n) if batch.schema.names[i] not in ("text", "spans")]
            names = [x for x in batch.schema.names if x not in ("text", "spans")]
            yield pa.RecordBatch.from_arrays([*keep, *[pa.array(c, pa.int64()) for c in out[:3]], left], [*names, "n_bytes", "n_removed", "n_spans", "kept"])

    return strip


def stripped(docs: DataFrame, span: int = SPAN, gram: int = GRAM, more: tuple[str, ...] = (), hot_runs: int = HOT, as_text: bool = False) -> DataFrame:
    """Every document with what is left of it: doc_id, more..., n_bytes, n_removed, n_spans, kept.

    What is left is bytes, or with ``as_text`` a string without the torn
    characters at the cuts. ``more`` must not name the columns added here.
    """
    rows = numbered(docs, *more)
    found = repeats(rows.select("rid", "text"), span, gram, hot_runs)
    spans = found.groupBy("rid").agg(F.collect_list(F.struct("lo", "hi")).alias("spans"))
    joined = rows.join(spans, "rid", "left").drop("rid")
    schema = joined.drop("text", "spans").schema.add("n_bytes", LongType()).add("n_removed", LongType()).add("n_spans", LongType()).add("kept", StringType() if as_text else BinaryType())
    return joined.mapInArrow(lean(_strip(span, as_text)), schema)


def deduplicated(docs: DataFrame, span: int = SPAN, gram: int = GRAM) -> DataFrame:
    """The documents, all columns kept, with their texts' repeats removed.

    Documents of which nothing is left go; n_chars, where there is one, follows
    the text. Columns travel in one struct, so that their names can't clash.
    """
    others = [c for c in docs.columns if c not in ("doc_id", "text")]
    rows = docs.select("doc_id", "text", F.struct(*others).alias("others")) if others else docs
    left = stripped(rows, span, gram, more=("others",) if others else (), as_text=True).where("n_bytes = 0 OR kept <> ''")
    columns = []
    for c in docs.columns:
        if c == "text":
            columns.append(F.col("kept").alias("text"))
        elif c == "n_chars":
            columns.append(F.length("kept").cast(docs.schema[c].dataType).alias(c))
        else:
            columns.append(F.col("doc_id") if c == "doc_id" else F.col("others")[c].alias(c))
    return left.select(columns)
