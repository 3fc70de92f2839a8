"""Exact Jaccard self-join of word-shingle sets, by universe partitioning.

Sets are banded by size, so that two linked sets are in one band or adjacent ones.
For each band the universe of shingles is hashed into ``m`` segments. Linked sets
differ in at most H elements, so of m = H + 1 + spare segments at least 1 + spare
agree; a set whose non-empty segments number H + 1 or more is therefore found
through an equal, non-empty segment. A set with more empty segments also
publishes the one-deletion neighbourhood of its segments, where a difference of
one still meets, which counts a segment twice. ``spare`` is allocated by cost:
one more signature for all, against the deletions of those that run short. A set
that falls short even so is joined under another hash of the universe, and what still
falls short after ``SEEDS`` of them by its least H + 1 elements in one order of the
universe, of which linked sets always share one.

Sets that are equal are one class from the start. Signatures meet by key; each
group pairs its members with its least member, the lead, only. Those star pairs
are filtered by a bound on the difference (counts of hashed cells) and verified
exactly on the texts. Where members of one lead are in several components
afterwards, they are compared by what each differs in from the lead: with t the
distance (1 - similarity) at which sets link, sets within 3t of the lead carry
their differences, which give exact intersections; sets beyond 2t can't link with
sets within t, and meet in their signature's group once more, filtered by the
bound and verified. No pair within a component is verified twice, none is made
for all members of a group, and no link between components can be missed, as the
Jaccard distance is a metric. Leads with very many members are compared block by
block.

Defined cases: null and empty texts have an empty set and link with nothing; a
text of fewer than n words is one shingle; ids may repeat or be null (rows are
numbered apart, null ids last, so that a component has a null id only if none of
its documents has one); equal sets link; an empty table gives no row; other
columns are not read. Texts are read whole.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from folioscope.llm import kernel as K
from folioscope.llm.common import discard, lean, numbered, release, written
from folioscope.llm.components import components

#: Hashes of the universe that are tried before sets that fall short are joined by prefix.
SEEDS = 3
#: Least cells of a set; larger sets have about half as many as elements.
CELLS = 64
#: Members of one group that are compared at once.
BLOCK = 512
#: Members of one lead compared in one task.
MEMBERS = 20_000


def sets_of(buf: np.ndarray, offsets: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(text, element) of all shingle sets, ascending; and each text's set size."""
    texts_ = len(offsets) - 1
    buf = K.LOWER[buf]
    start, end, doc = K.runs(~K.SPACE[buf], offsets)
    words = K.Fingerprints(buf).of(start, end)
    h, whole = K.shingles(words, doc, n)
    h, d = h[whole], doc[: len(h)][whole]
    count = np.bincount(doc, minlength=texts_)
    short = np.flatnonzero((count > 0) & (count < n))
    if len(short):
        first = np.searchsorted(doc, short)
        one = np.zeros(len(short), K.U)
        for k in range(n - 1):  # shorter than a shingle: the whole sequence, with its length
            has = count[short] > k
            one[has] = K.mix(one[has] * K.U(0x9FB21C651E98DF25) + words[first[has] + k] + K.U(k + 1))
        h, d = np.concatenate([h, one]), np.concatenate([d, short])
    order = np.lexsort([h, d])
    h, d = h[order], d[order]
    new = np.ones(len(h), bool)
    new[1:] = (h[1:] != h[:-1]) | (d[1:] != d[:-1])
    h, d = h[new], d[new]
    return d, h, np.bincount(d, minlength=texts_).astype(np.int64)


def most_different(s, t, num: int, den: int):
    """Elements in which sets of sizes s and t can differ and still link."""
    return (den - num) * (s + t) // (den + num)


def _short(m: int, spare: int, size: int) -> float:
    """About how many sets of this size have more than ``spare`` of m segments empty."""
    rate = m * math.exp(-size / m)
    return 0.5 * math.erfc((spare + 0.5 - rate) / math.sqrt(2 * rate + 1e-9))


@lru_cache(maxsize=8)
def bands(num: int, den: int, largest: int = 1 << 33) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(least size of each band, H + 1, segments) of every band."""
    low = [1]
    while low[-1] < largest:
        low.append(low[-1] * den // num + 1)
    need, segments = [], []
    for a, b in zip(low[:-1], low[1:], strict=True):
        s = b - 1
        least = int(most_different(s, s * den // num, num, den)) + 1
        need.append(least)
        # Few spare segments are worth trying: around the expected number of empty ones.
        expected = least * math.exp(-a / least)
        tried = {math.ceil(expected + z * math.sqrt(expected) + z / 2) for z in (0, 0.5, 1, 1.5, 2, 2.5, 3, 4, 5, 6)} | {0}
        costs = [(least + k + a * _short(least + k, k, a), least + k) for k in tried]
        best = min(costs)
        segments.append(best[1])
    return np.asarray(low[:-1], np.int64), np.asarray(need, np.int64), np.asarray(segments, np.int64)


def signatures(d: np.ndarray, h: np.ndarray, size: np.ndarray, num: int, den: int, seed: int = 0, prefix: bool = False) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(text, signature) of all sets, and the texts that fall short under this seed.

    With ``prefix`` the signatures are a set's least H + 1 elements: no set falls short.
    """
    low, need, segments = bands(num, den)
    h = K.mix(h + K.U(0x632BE59BD9B4E019 * (2 * seed + 1) % (1 << 64)))
    order = np.lexsort([h, d])  # a segment is a range of mixed values, so elements come segment by segment
    h, d = h[order], d[order]
    value = K.mix(h ^ K.U(0xA5A5A5A5A5A5A5A5))
    own = np.searchsorted(low, size, "right") - 1
    docs, sigs, short = [], [], []
    for step in (0, 1):  # as the smaller set of a pair, and as the larger of one in the band below
        level = own - step
        fit = (size > 0) & (level >= 0)
        m = np.where(fit, segments[np.maximum(level, 0)], 0)
        base = np.cumsum(m) - m
        has = fit[d]
        dd, hh, vv = d[has], h[has], value[has]
        if not len(dd):
            continue
        if prefix:
            rank = np.arange(len(dd)) - np.searchsorted(dd, dd)
            least = np.flatnonzero(rank < need[level[dd]])
            docs.append(dd[least])
            sigs.append(K.mix(vv[least] ^ K.mix(level[dd[least]].astype(K.U) + K.U(0x3C6EF372FE94F82B))))
            continue
        seg = (((hh >> K.U(32)) * m[dd].astype(K.U)) >> K.U(32)).astype(np.int64)
        key = base[dd] + seg
        first = np.ones(len(key), bool)
        first[1:] = key[1:] != key[:-1]
        at = np.flatnonzero(first)
        total = np.add.reduceat(vv, at)
        count = np.diff(np.append(at, len(key)))
        tag = K.mix((level[dd[at]].astype(K.U) << K.U(40)) + seg[at].astype(K.U) + K.U(seed) * K.U(0x5851F42D4C957F2D))
        sign = lambda t, c, s: K.mix((s + c.astype(K.U) * K.U(0x2545F4914F6CDD1D)) ^ t)
        docs.append(dd[at])
        sigs.append(sign(tag, count, total))
        used = np.bincount(dd[at], minlength=len(size))
        lack = fit & (used < need[np.maximum(level, 0)])
        if lack.any():
            group = np.cumsum(first) - 1
            more = np.flatnonzero(lack[dd] & (count[group] > 1))
            docs.append(dd[more])
            sigs.append(sign(tag[group[more]], count[group[more]] - 1, total[group[more]] - vv[more]))
            credit = used + np.bincount(dd[at], weights=count > 1, minlength=len(size)).astype(np.int64)
            short.append(np.flatnonzero(lack & (credit < need[np.maximum(level, 0)])))
    none = np.zeros(0, np.int64)
    return np.concatenate(docs or [none]), np.concatenate(sigs or [none.view(K.U)]), np.unique(np.concatenate(short or [none]))


def _describe(n: int):
    """Per text: set size, two fingerprints of the set, and its cell counts."""

    def describe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, buf, offsets in K.string_chunks(batch, "text"):
                d, h, size = sets_of(buf, offsets, n)
                rows = len(size)
                sums = [np.zeros(rows, K.U), np.zeros(rows, K.U)]
                first = np.searchsorted(d, np.flatnonzero(size))
                if len(d):
                    sums[0][size > 0] = np.add.reduceat(K.mix(h), first)
                    sums[1][size > 0] = np.add.reduceat(K.mix(h ^ K.U(0x9E6C63D0676A9A99)), first)
                width = np.maximum(CELLS, 1 << np.ceil(np.log2(np.maximum(size, 2) / 2)).astype(np.int64))
                base = np.cumsum(width) - width
                cells = np.bincount(base[d] + (h & (width[d] - 1).astype(K.U)).astype(np.int64), minlength=int(width.sum()))
                packed = np.minimum(cells, 255).astype(np.uint8).tobytes()
                out = K.batched(batch, part)
                yield pa.RecordBatch.from_arrays(
                    [out.column("rid"), out.column("doc_id"), pa.array(size), pa.array(sums[0].view(np.int64)), pa.array(sums[1].view(np.int64)),
                     pa.array([packed[i: i + w] for i, w in zip(base.tolist(), width.tolist(), strict=True)], pa.binary())],
                    ["rid", "doc_id", "n", "f1", "f2", "cells"],
                )

    return describe


def _sign(n: int, num: int, den: int, seed: int, prefix: bool):
    def sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = batch.column("rid").to_numpy(zero_copy_only=False)
            for part, buf, offsets in K.string_chunks(batch, "text"):
                d, h, size = sets_of(buf, offsets, n)
                if len(d):  # equal sets of this chunk publish once, by their least row
                    at = np.flatnonzero(size)
                    sums = np.add.reduceat(K.mix(h), np.searchsorted(d, at))
                    order = np.lexsort([ids[part][at], sums])
                    first = np.ones(len(at), bool)
                    first[1:] = sums[order[1:]] != sums[order[:-1]]
                    lead = np.zeros(len(size), bool)
                    lead[at[order[first]]] = True
                    keep = lead[d]
                    d, h, size = d[keep], h[keep], np.where(lead, size, 0)
                doc, sig, short = signatures(d, h, size, num, den, seed, prefix)
                rid = ids[part]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.concatenate([sig.view(np.int64), np.zeros(len(short), np.int64)])), pa.array(np.concatenate([rid[doc], rid[short]])),
                     pa.array(np.concatenate([np.zeros(len(sig), bool), np.ones(len(short), bool)]))],
                    ["sig", "rid", "short"],
                )

    return sign


def _groups(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Members of signatures that several sets share, with the least member; rows come sorted."""
    sig0 = lead0 = None
    for batch in batches:
        if not len(batch):
            continue
        sig = batch.column("sig").to_numpy(zero_copy_only=False)
        rid = batch.column("rid").to_numpy(zero_copy_only=False)
        joined = np.empty(len(sig), bool)
        joined[0] = sig0 is not None and sig[0] == sig0
        joined[1:] = sig[1:] == sig[:-1]
        start = np.where(joined, -1, np.arange(len(sig)))
        start = np.maximum.accumulate(start)
        lead = np.where(start >= 0, rid[start], lead0 if lead0 is not None else 0)
        out = joined & (lead != rid)
        yield pa.RecordBatch.from_arrays([pa.array(sig[out]), pa.array(lead[out]), pa.array(rid[out])], ["sig", "lead", "rid"])
        sig0, lead0 = sig[-1], lead[-1]


def folded(cells: bytes, width: int) -> np.ndarray:
    """Counts in fewer cells; both widths are powers of two."""
    return np.frombuffer(cells, np.uint8).astype(np.int32).reshape(-1, width).sum(0)


def _may_link(num: int, den: int):
    """Pairs whose cells don't prove a similarity below num / den."""

    def keep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ok = np.zeros(len(batch), bool)
            most = most_different(batch.column("n_a").to_numpy(), batch.column("n_b").to_numpy(), num, den)
            for i, (x, y) in enumerate(zip(batch.column("cells_a").to_pylist(), batch.column("cells_b").to_pylist(), strict=True)):
                width = min(len(x), len(y))
                ok[i] = np.abs(folded(x, width) - folded(y, width)).sum() <= most[i]
            where = pa.array(ok)
            yield pa.RecordBatch.from_arrays([batch.column("a").filter(where), batch.column("b").filter(where)], ["a", "b"])

    return keep


def _runs_of(key: np.ndarray) -> Iterator[tuple[int, int]]:
    edge = np.flatnonzero(np.append(True, key[1:] != key[:-1]))
    yield from zip(edge.tolist(), [*edge[1:].tolist(), len(key)], strict=True)


def _by_group(columns: tuple[str, ...], judge):
    """Whole groups of rows that come sorted by the first column, whatever the batches."""

    def stream(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        carry = None
        for batch in batches:
            if not len(batch):
                continue
            now = [np.asarray(batch.column(c).to_pylist(), object) if pa.types.is_binary(batch.column(c).type) else batch.column(c).to_numpy(zero_copy_only=False) for c in columns]
            if carry is not None:
                now = [np.concatenate([x, y]) for x, y in zip(carry, now, strict=True)]
            cut = len(now[0]) - int(np.argmax((now[0] != now[0][-1])[::-1])) if (now[0] != now[0][-1]).any() else 0
            carry = [x[cut:] for x in now]
            if cut:
                yield from judge(*[x[:cut] for x in now])
        if carry is not None:
            yield from judge(*carry)

    return stream


def _pairs(a: list, b: list) -> pa.RecordBatch:
    none = np.zeros(0, np.int64)
    return pa.RecordBatch.from_arrays([pa.array(np.concatenate([none, *a])), pa.array(np.concatenate([none, *b]))], ["a", "b"])


def _across(num: int, den: int):
    """Pairs of a signature's group in different components whose cells don't rule out a link."""

    def judge(sig, rep, comp, n, cells) -> Iterator[pa.RecordBatch]:
        a_out, b_out = [], []
        for lo, hi in _runs_of(sig):
            width = min(map(len, cells[lo:hi]))
            counts = np.stack([folded(c, width) for c in cells[lo:hi]])
            for i in range(lo, hi, BLOCK):
                for j in range(i, hi, BLOCK):
                    x, y = slice(i, min(i + BLOCK, hi)), slice(j, min(j + BLOCK, hi))
                    small, large = np.minimum(n[x][:, None], n[y][None, :]), np.maximum(n[x][:, None], n[y][None, :])
                    # Rows are sorted by rep, so a pair comes in one order only.
                    maybe = (comp[x][:, None] != comp[y][None, :]) & (rep[x][:, None] < rep[y][None, :]) & (den * small >= num * large)
                    r, c = np.nonzero(maybe)
                    step = max(1, (1 << 22) // width)
                    for k in range(0, len(r), step):
                        rr, cc = r[k: k + step] + i, c[k: k + step] + j
                        ok = np.abs(counts[rr - lo] - counts[cc - lo]).sum(1) <= most_different(n[rr], n[cc], num, den)
                        a_out.append(rep[rr[ok]])
                        b_out.append(rep[cc[ok]])
        yield _pairs(a_out, b_out)

    return _by_group(("sig", "rep", "comp", "n", "cells"), judge)


def _around(num: int, den: int):
    """Links across components among sets with known differences from one lead."""

    def judge(key, rep, comp, n, n_lead, difference, removed) -> Iterator[pa.RecordBatch]:
        a_out, b_out = [], []
        for lo, hi in _runs_of(key):
            who, where, size = rep[lo:hi], comp[lo:hi], n[lo:hi]
            parts = [np.frombuffer(d, np.int64) for d in difference[lo:hi]]
            owner = np.repeat(np.arange(hi - lo), [len(p) for p in parts])
            _, number = np.unique(np.concatenate(parts), return_inverse=True)
            order = np.argsort(number, kind="stable")
            holders = owner[order]
            ends = np.searchsorted(number[order], np.arange(number.max() + 2 if len(number) else 1))
            first = np.searchsorted(owner, np.arange(hi - lo + 1))
            values, counts = np.unique(where, return_counts=True)
            for i in np.flatnonzero(where != values[np.argmax(counts)]).tolist():
                own = number[first[i]: first[i + 1]]
                lists = [holders[ends[k]: ends[k + 1]] for k in own.tolist()]
                shared = np.bincount(np.concatenate(lists) if lists else np.zeros(0, np.int64), minlength=hi - lo)
                common = n_lead[lo] - removed[lo:hi] - removed[lo + i] + shared
                ok = (where != where[i]) & (den * common >= num * (size + size[i] - common))
                a_out.append(np.minimum(who[ok], who[i]))
                b_out.append(np.maximum(who[ok], who[i]))
        yield _pairs(a_out, b_out)

    return _by_group(("key", "rep", "comp", "n", "n_lead", "difference", "removed"), judge)


def _verify(n: int, num: int, den: int):
    """What pairs (a, b) with similarity of num / den or more share; rows come sorted by a.

    ``removed`` elements are a's alone; ``difference`` holds those of either alone.
    """

    def one(text: str | None) -> np.ndarray:
        data = np.frombuffer((text or "").encode(), np.uint8)
        return sets_of(data, np.asarray([0, len(data)]), n)[1]

    def verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, mine = None, None
        for batch in batches:
            a = batch.column("a").to_pylist()
            keep = np.zeros(len(batch), bool)
            rows: list[tuple] = []
            for i, (x, text) in enumerate(zip(a, map(pa.StringScalar.as_py, batch.column("text_b")), strict=True)):
                if x != known:
                    known, mine = x, one(batch.column("text_a")[i].as_py())
                other = one(text)
                difference = np.setxor1d(mine, other, assume_unique=True)
                common = (len(mine) + len(other) - len(difference)) // 2
                keep[i] = den * common >= num * (common + len(difference))
                if keep[i]:
                    rows.append((len(mine), len(other), common, difference.tobytes()))
            where = pa.array(keep)
            more = list(zip(*rows, strict=True)) or [(), (), (), ()]
            yield pa.RecordBatch.from_arrays(
                [batch.column("a").filter(where), batch.column("b").filter(where), *[pa.array(c, pa.int64()) for c in more[:3]], pa.array(more[3], pa.binary())],
                ["a", "b", "n_a", "n_b", "common", "difference"],
            )

    return verify


def link_components(docs: DataFrame, n: int = 5, threshold: tuple[int, int] = (80, 100)) -> DataFrame:
    """doc_id, rid, n_shingles, component_rid, component_id of every document.

    Two documents link when the Jaccard similarity of their n-word shingle sets
    is at least threshold (a fraction).
    """
    return link_rows(numbered(docs), n, threshold)


def representatives(docs: DataFrame, n: int = 5, threshold: tuple[int, int] = (80, 100)) -> DataFrame:
    """The first document of every group of linked ones, with all its columns."""
    others = [c for c in docs.columns if c not in ("doc_id", "text")]  # in a struct, so that no name clashes
    held = docs.select("doc_id", "text", F.struct(*others).alias("others")) if others else docs
    rows = numbered(held, *(["others"] if others else []))
    first = link_rows(rows, n, threshold).where("rid = component_rid").select("rid")
    kept = rows.join(first, "rid", "left_semi")
    return kept.select(*[F.col(c) if c in ("doc_id", "text") else F.col("others")[c].alias(c) for c in docs.columns])


def link_rows(rows: DataFrame, n: int, threshold: tuple[int, int]) -> DataFrame:
    """:func:`link_components` of numbered rows (rid, doc_id, text)."""
    num, den = threshold
    text = rows.select("rid", "text")
    described = written(rows.select("rid", "doc_id", "text").mapInArrow(lean(_describe(n)), "rid long, doc_id long, n long, f1 long, f2 long, cells binary"), "sets", compression="zstd")
    full = described.where(F.col("n") > 0)
    classes = full.groupBy("n", "f1", "f2").agg(F.min("rid").alias("rep"))
    # rep is the least row with the same set; its cells stand for the class.
    known = written(full.join(classes, ["n", "f1", "f2"]).select("rid", "rep", "n", "cells"), "classes", compression="zstd")
    sets = known

    groups, seed, parts = None, 0, []
    subject = text
    while True:
        signed = subject.mapInArrow(lean(_sign(n, num, den, seed, seed == SEEDS)), "sig long, rid long, short boolean")
        # Rows that fall short travel beside the groups, by one shuffle.
        keyed = signed.repartition("sig").sortWithinPartitions("short", "sig", "rid")
        live = written(keyed.mapInArrow(lean(_grouped_or_short), "sig long, lead long, rid long"), f"groups-{seed}", compression="zstd")
        found = live.where(F.col("lead").isNotNull())
        groups = found if groups is None else groups.unionByName(found)
        lacking = live.where(F.col("lead").isNull()).select("rid").distinct()
        release(rows.sparkSession)  # the signatures' shuffle is done with
        parts.append(live)
        if seed == SEEDS or lacking.isEmpty():
            break
        # Another hash of the universe, in the end the prefixes, for every set of the sizes that fell short.
        sizes = [r[0] for r in lacking.join(known, "rid").select("n").distinct().collect()]
        spans = sorted({(int(s * num // den), int(s * den // num) + 1) for s in sizes})
        within = F.lit(False)
        for lo, hi in spans:
            within = within | F.col("n").between(lo, hi)
        subject = text.join(known.where(within).select("rid"), "rid", "left_semi")
        seed += 1

    near = den - 2 * (den - num)  # a set further from the lead can't link with a set linked to it
    carried = max(1, den - 3 * (den - num))  # nor one further than this with a set that is near

    def verified(pairs: DataFrame, least: int, label: str) -> DataFrame:
        with_b = pairs.join(text.select(F.col("rid").alias("b"), F.col("text").alias("text_b")), "b")
        with_both = with_b.join(text.select(F.col("rid").alias("a"), F.col("text").alias("text_a")), "a").select("a", "b", "text_a", "text_b")
        return written(with_both.mapInArrow(lean(_verify(n, least, den)), "a long, b long, n_a long, n_b long, common long, difference binary"), label, compression="zstd")

    def similar(least: int) -> Column:
        return F.expr(f"{den} * common >= {least} * (n_a + n_b - common)")

    # Star pairs: leads and members as classes; sizes first, then cells, then texts.
    side = lambda s, *more: sets.select(F.col("rid").alias(s), F.col("rep").alias(f"rep_{s}"), F.col("n").alias(f"n_{s}"), *more)
    classed = (
        groups.select(F.col("lead").alias("a"), F.col("rid").alias("b")).distinct()
        .join(side("a"), "a").join(side("b"), "b")
        .where(f"rep_a <> rep_b AND {den} * least(n_a, n_b) >= {carried} * greatest(n_a, n_b)")
        .select(F.least("rep_a", "rep_b").alias("a"), F.greatest("rep_a", "rep_b").alias("b")).distinct()
    )
    cells = lambda s: sets.where("rid = rep").select(F.col("rep").alias(s), F.col("n").alias(f"n_{s}"), F.col("cells").alias(f"cells_{s}"))
    stars = classed.join(cells("a"), "a").join(cells("b"), "b").mapInArrow(lean(_may_link(carried, den)), "a long, b long")
    rays = verified(stars, carried, "rays")
    release(rows.sparkSession)
    links = rays.where(similar(num)).select("a", "b")
    comp = components(links, "joined")

    placed = sets.where("rid = rep").join(comp.withColumnRenamed("id", "rep"), "rep", "left").select("rep", "n", "cells", F.coalesce("component", "rep").alias("comp"))
    placed = written(placed, "placed-sets", compression="zstd")
    release(rows.sparkSession)

    # Members of one lead in several components, by their differences from it.
    member = rays.join(placed.select(F.col("rep").alias("b"), "comp"), "b").join(placed.select(F.col("rep").alias("a"), F.col("comp").alias("comp_a")), "a")
    mixed = member.groupBy("a").agg(F.min(F.least("comp", "comp_a")).alias("lo"), F.max(F.greatest("comp", "comp_a")).alias("hi"), F.count("*").alias("members")).where("lo <> hi")
    blocks = F.ceil(F.col("members") / MEMBERS).cast("int")
    block = F.pmod(F.xxhash64("b"), blocks)
    dealt = (
        member.join(mixed.select("a", "members"), "a")
        .withColumn("other", F.explode(F.sequence(F.lit(0), blocks - 1)))
        .select(
            F.xxhash64("a", F.least(block, F.col("other").cast("long")), F.greatest(block, F.col("other").cast("long"))).alias("key"),
            F.col("b").alias("rep"), "comp", F.col("n_b").alias("n"), F.col("n_a").alias("n_lead"), "difference", (F.col("n_a") - F.col("common")).alias("removed"), "a",
        )
    )
    around = dealt.repartition("key").sortWithinPartitions("key", "a", "rep").drop("a").mapInArrow(lean(_around(num, den)), "a long, b long")

    # Sets far from their lead, in what is left of their signature's group.
    found = groups.join(sets.select("rid", "rep"), "rid").join(sets.select(F.col("rid").alias("lead"), F.col("rep").alias("lead_rep")), "lead")
    found = found.where("rep <> lead_rep").select("sig", "rep", F.least("rep", "lead_rep").alias("a"), F.greatest("rep", "lead_rep").alias("b"))
    far = found.join(rays.where(similar(near)).select("a", "b"), ["a", "b"], "left_anti").select("sig", "rep").distinct()
    located = far.join(placed.select("rep", "comp"), "rep")
    several = located.groupBy("sig").agg(F.min("comp").alias("lo"), F.max("comp").alias("hi")).where("lo <> hi").select("sig")
    residue = located.join(several, "sig").join(placed.select("rep", "n", "cells"), "rep").select("sig", "rep", "comp", "n", "cells")
    across = residue.repartition("sig").sortWithinPartitions("sig", "rep").mapInArrow(lean(_across(num, den)), "a long, b long").distinct()
    rest = verified(across, num, "links-rest").select("a", "b").unionByName(around)
    rest = written(rest, "links-more")
    release(rows.sparkSession)
    if not rest.isEmpty():
        comp = components(links.unionByName(rest), "joined-all")
    discard(*parts, rays, placed)

    final = (
        described.select("rid", "doc_id", F.col("n").alias("n_shingles"))
        .join(sets.select("rid", "rep"), "rid", "left")
        .join(comp.withColumnRenamed("id", "rep"), "rep", "left")
        .select("rid", "doc_id", "n_shingles", F.coalesce("component", "rep", "rid").alias("component_rid"))
    )
    names = described.select(F.col("rid").alias("component_rid"), F.col("doc_id").alias("component_id"))
    return final.join(names, "component_rid").select("doc_id", "rid", "n_shingles", "component_rid", "component_id")


def _grouped_or_short(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Groups of shared signatures; sets that fell short come last, without a lead."""

    def grouped() -> Iterator[pa.RecordBatch]:
        for batch in batches:
            flag = batch.column("short").to_numpy(zero_copy_only=False)
            if flag.any():
                rest = batch.filter(pa.array(flag))
                lacking.append(pa.RecordBatch.from_arrays([rest.column("sig"), pa.nulls(len(rest), pa.int64()), rest.column("rid")], ["sig", "lead", "rid"]))
                batch = batch.filter(pa.array(~flag))
            yield batch

    lacking: list[pa.RecordBatch] = []
    for out in _groups(grouped()):
        yield out
        while lacking:
            yield lacking.pop()
    while lacking:
        yield lacking.pop()
