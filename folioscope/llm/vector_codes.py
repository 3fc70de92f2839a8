"""Product codes for vectors, with codebooks trained by Yinyang Lloyd rounds.

Each component x becomes the integer floor(scale * x); a vector is cut into equal
consecutive parts, and each part position has a codebook of its own, which starts
as that part of the vectors with the smallest ids.

Entries of a codebook are clustered into groups once. A part keeps one lower
bound for each group: no entry of the group, its own entry apart, is nearer than
that. When entries move, the bounds of a group fall by the farthest that one of
its entries moved, and the distance to the own entry is taken anew. Only groups
whose bound is not above that distance are scanned. Bounds are rounded down and
drifts up, and what is scanned is compared by exact integers, ties to the lower
index, so the result is that of plain Lloyd rounds.

A round reads one table of the shared folder and writes the next: id, label,
integers, codes and bounds (two bytes each). Sums are added up per task, then by
(part, entry, place); the driver holds the codebooks alone, whose size depends on
``parts``, ``entries`` and the width, never on the rows.

Defined cases: rows whose vector is null or holds null, NaN or infinity are left
out; with fewer rows than ``entries`` a codebook has one entry a row; rows that tie
on vec_id are ordered by their vectors, null ids last; repeated rows count each;
null labels are one label; an empty table gives no rows; other columns are not
read. Vectors of unequal lengths, of a length that ``parts`` does not divide,
or too large for exact distances are an error.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from folioscope.llm.common import discard, lean, prepare, written

PARTS, ENTRIES, ROUNDS, SCALE = 16, 64, 2, 256
#: Entries of a group, about.
PER_GROUP = 10
#: Lower bounds are two bytes; a larger one is as good as this.
BOUND = (1 << 16) - 1
#: Drifts and distances are held against bounds with this much to spare.
SLACK = 1e-9
STATE = "vec_id long, label {label}, ints binary, codes binary, bounds binary"


def usable(embedding: Column) -> Column:
    odd = F.exists(embedding, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    return F.coalesce(~odd, F.lit(False))


def squared(points: np.ndarray, entries: np.ndarray) -> np.ndarray:
    """Squared distances as integers. The callers' values are small enough for doubles to hold them exactly."""
    p, e = points.astype(np.float64), entries.astype(np.float64)
    return ((p * p).sum(1)[:, None] - 2 * (p @ e.T) + (e * e).sum(1)[None, :]).astype(np.int64)


def groups_of(entries: np.ndarray, per_group: int = PER_GROUP) -> np.ndarray:
    """The group of each entry of one codebook: five Lloyd rounds among the entries."""
    n = max(1, len(entries) // per_group)
    centres = entries[:: max(1, len(entries) // n)][:n].astype(np.float64)
    for _ in range(5):
        group = ((entries[:, None, :] - centres[None]) ** 2).sum(2).argmin(1)
        centres = np.array([entries[group == g].mean(0) if (group == g).any() else centres[g] for g in range(n)])
    return group


class Codebooks:
    """Integer entries (parts, entries, width), the groups of each and how far each moved last."""

    def __init__(self, entries: np.ndarray, groups: np.ndarray | None = None, moved: np.ndarray | None = None):
        self.entries = entries
        self.groups = np.stack([groups_of(e) for e in entries]) if groups is None else groups
        self.n_groups = int(self.groups.max()) + 1 if self.groups.size else 1
        far = np.zeros(entries.shape[:2]) if moved is None else moved
        self.drift = np.stack([[far[j][self.groups[j] == g].max(initial=0.0) for g in range(self.n_groups)] for j in range(len(entries))])

    def updated(self, sums: np.ndarray, counts: np.ndarray) -> Codebooks:
        """Entries become their parts' floored means; unused ones stay."""
        new = np.where(counts[..., None] > 0, sums // np.maximum(counts, 1)[..., None], self.entries)
        moved = np.sqrt(((new - self.entries).astype(np.float64) ** 2).sum(2)) * (1 + SLACK)
        return Codebooks(new, self.groups, moved)

    def first(self, j: int, points: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Codes, squared distances and group bounds of part j, all entries scanned."""
        d = squared(points, self.entries[j])
        code = d.argmin(1)
        best = d[np.arange(len(d)), code]
        d[np.arange(len(d)), code] = np.iinfo(np.int64).max
        low = np.stack([floored(d[:, self.groups[j] == g].min(1, initial=np.iinfo(np.int64).max)) for g in range(self.n_groups)], 1)
        return code, best, low

    def again(self, j: int, points: np.ndarray, code: np.ndarray, low: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, int]:
        """As :meth:`first` from the last codes and bounds; also how many distances were taken."""
        rows = np.arange(len(points))
        own = ((points - self.entries[j][code]).astype(np.int64) ** 2).sum(1)
        fallen = np.maximum(low - self.drift[j][None, :], 0.0)
        best, new = own.copy(), code.copy()
        reach = np.sqrt(own) * (1 + SLACK)
        taken = len(points)
        found = np.minimum(np.floor(fallen), BOUND).astype(np.int64)
        scanned = fallen <= reach[:, None]
        others: dict[int, tuple[np.ndarray, np.ndarray]] = {}
        for g in range(self.n_groups):
            at = rows[scanned[:, g]]
            members = np.flatnonzero(self.groups[j] == g)
            if not len(at) or not len(members):
                continue
            d = squared(points[at], self.entries[j][members])
            taken += d.size
            others[g] = at, d
            k = d.argmin(1)
            near, index = d[np.arange(len(at)), k], members[k]
            better = (near < best[at]) | ((near == best[at]) & (index < new[at]))
            best[at[better]], new[at[better]] = near[better], index[better]
        for g, (at, d) in others.items():
            members = np.flatnonzero(self.groups[j] == g)
            rest = np.where(members[None, :] == new[at][:, None], np.iinfo(np.int64).max, d)
            found[at, g] = floored(rest.min(1))
        # An entry that is no longer the own one counts for its group, scanned or not.
        left = rows[new != code]
        home = self.groups[j][code[left]]
        found[left, home] = np.minimum(found[left, home], floored(own[left]))
        return new, best, found, taken

    def digest(self) -> str:
        return hashlib.sha256(",".join(map(str, self.entries.ravel().tolist())).encode()).hexdigest()


def floored(d: np.ndarray) -> np.ndarray:
    return np.minimum(np.floor(np.sqrt(d.astype(np.float64))), BOUND).astype(np.int64)


def _integers(column: pa.Array, scale: int, parts: int, width: int) -> np.ndarray:
    flat = np.asarray(pc.list_flatten(column).to_numpy(zero_copy_only=False), np.float64)
    return np.floor(flat * scale).astype(np.int64).reshape(len(column), parts, width)


def _fixed(column: pa.Array, dtype: str, n: int) -> np.ndarray:
    """Equally long binaries as rows of an array."""
    return np.frombuffer(b"".join(column.to_pylist()), dtype).reshape(n, -1) if n else np.zeros((0, 0), dtype)


def _binary(rows: np.ndarray) -> pa.Array:
    raw, size = rows.tobytes(), rows.itemsize * int(np.prod(rows.shape[1:]))
    return pa.array([raw[k * size : (k + 1) * size] for k in range(len(rows))], pa.binary())


def _assigned(books: Codebooks, points: np.ndarray, codes: np.ndarray | None, low: np.ndarray | None):
    """Codes (n, parts), squared distances and bounds (n, parts, groups) of a batch."""
    n, parts = points.shape[:2]
    out = np.zeros((n, parts), np.uint8), np.zeros((n, parts), np.int64), np.zeros((n, parts, books.n_groups), np.uint16)
    for j in range(parts):
        if codes is None:
            found = books.first(j, points[:, j])
        else:
            found = books.again(j, points[:, j], codes[:, j].astype(np.int64), low[:, j].astype(np.int64))[:3]
        for o, f in zip(out, found):
            o[:, j] = f
    return out


def _state(batch: pa.RecordBatch, parts: int, width: int, n_groups: int):
    n = batch.num_rows
    points = _fixed(batch.column("ints"), "<i4", n).astype(np.int64).reshape(n, parts, width)
    codes = _fixed(batch.column("codes"), "u1", n).reshape(n, parts)
    return points, codes, _fixed(batch.column("bounds"), "<u2", n).reshape(n, parts, n_groups)


def _round(rows: DataFrame, books: Codebooks, shape: tuple[int, int], label: str, scale: int | None) -> DataFrame:
    """One assignment written to the shared folder; ``scale`` is given where ``rows`` are vectors still."""
    parts, width = shape

    @lean
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if not b.num_rows:
                continue
            if scale is not None:
                points, codes, low = _integers(b.column("embedding"), scale, parts, width), None, None
            else:
                points, codes, low = _state(b, parts, width, books.n_groups)
            codes, _, low = _assigned(books, points, codes, low)
            columns = [b.column("vec_id"), b.column("label"), _binary(points.astype("<i4")), _binary(codes), _binary(low.astype("<u2"))]
            yield pa.RecordBatch.from_arrays(columns, ["vec_id", "label", "ints", "codes", "bounds"])

    return written(rows.mapInArrow(run, STATE.format(label=label)), "vector-codes", compression="zstd")


def _sums(state: DataFrame, books: Codebooks) -> tuple[np.ndarray, np.ndarray]:
    """Sums (parts, entries, width) and counts of what is assigned to each entry."""
    parts, entries, width = books.entries.shape

    @lean
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, count = np.zeros((parts, entries, width), np.int64), np.zeros((parts, entries), np.int64)
        for b in batches:
            n = b.num_rows
            points = _fixed(b.column("ints"), "<i4", n).reshape(n, parts, width) if n else None
            codes = _fixed(b.column("codes"), "u1", n) if n else None
            for j in range(parts if n else 0):
                count[j] += np.bincount(codes[:, j], minlength=entries)
                for w in range(width):
                    total[j, :, w] += np.bincount(codes[:, j], points[:, j, w], entries).astype(np.int64)
        part, entry, place = (x.ravel() for x in np.indices(total.shape))
        many = np.repeat(count.ravel(), width)
        used = many > 0
        columns = [x[used].astype(t) for x, t in ((part, np.int32), (entry, np.int32), (place, np.int32), (total.ravel(), np.int64), (many, np.int64))]
        yield pa.RecordBatch.from_arrays([pa.array(x) for x in columns], ["part", "entry", "place", "s", "n"])

    partial = state.select("ints", "codes").mapInArrow(run, "part int, entry int, place int, s long, n long")
    total, count = np.zeros(books.entries.shape, np.int64), np.zeros(books.entries.shape[:2], np.int64)
    # parts x entries x width rows, however many vectors there are
    for r in partial.groupBy("part", "entry", "place").agg(F.sum("s").alias("s"), F.sum("n").alias("n")).collect():
        total[r["part"], r["entry"], r["place"]], count[r["part"], r["entry"]] = r["s"], r["n"]
    return total, count


def compress(vectors: DataFrame, parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS, scale: int = SCALE) -> tuple[DataFrame, Codebooks | None]:
    """(vec_id, label, codes, error) of each kept row, kept in the shared folder, and the final codebooks.

    ``codes`` holds one byte a part, ``error`` the squared distances summed over parts.
    Codebooks are None where no row is kept.
    """
    if not 0 < entries <= 256:
        raise ValueError("a code is one byte: 1 to 256 entries")
    prepare(vectors.sparkSession)
    kept = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), "label", F.col("embedding").cast("array<float>").alias("embedding")).where(usable(F.col("embedding")))
    label = kept.schema["label"].dataType.simpleString()
    schema = f"vec_id long, label {label}, codes binary, error long"
    size = F.size("embedding")
    about = kept.agg(F.min(size).alias("least"), F.max(size).alias("most"), F.max(F.greatest(F.abs(F.array_max("embedding")), F.abs(F.array_min("embedding")))).alias("high")).first()
    if about["most"] is None:
        return vectors.sparkSession.createDataFrame([], schema), None
    if about["least"] != about["most"] or about["most"] % parts:
        raise ValueError(f"vectors of {about['least']} to {about['most']} components can't be cut into {parts} equal parts")
    width = about["most"] // parts
    if 4 * max(width, 1) * (scale * (about["high"] or 0.0) + 1) ** 2 >= 2**53:
        raise ValueError("components are too large for exact distances")
    seeds = kept.orderBy(F.col("vec_id").asc_nulls_last(), "embedding").limit(entries).select("embedding").collect()
    start = np.floor(np.array([r["embedding"] for r in seeds], np.float64) * scale).astype(np.int64).reshape(len(seeds), parts, width)
    books = Codebooks(np.ascontiguousarray(start.transpose(1, 0, 2)))
    state = None
    for k in range(rounds):
        new = _round(kept if state is None else state, books, (parts, width), label, scale if state is None else None)
        if state is not None:
            discard(state)
        state, books = new, books.updated(*_sums(new, books))

    @lean
    def last(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if not b.num_rows:
                continue
            if rounds:
                codes, error, _ = _assigned(books, *_state(b, parts, width, books.n_groups))
            else:
                codes, error, _ = _assigned(books, _integers(b.column("embedding"), scale, parts, width), None, None)
            yield pa.RecordBatch.from_arrays([b.column("vec_id"), b.column("label"), _binary(codes), pa.array(error.sum(1))], ["vec_id", "label", "codes", "error"])

    coded = written((kept if state is None else state).mapInArrow(last, schema), "vector-codes")
    if state is not None:
        discard(state)
    return coded, books


def label_errors(coded: DataFrame) -> DataFrame:
    """``coded`` with label_error: the errors summed over equal labels, nulls together.

    Sums combine before their shuffle; the join's right side has one row a label, so
    Spark broadcasts it where it is small and splits a hot label's rows where not.
    """
    sums = coded.groupBy(F.col("label").alias("of")).agg(F.sum("error").alias("label_error"))
    return coded.join(sums, F.col("label").eqNullSafe(F.col("of")), "left").drop("of")
