"""Benchmark decontamination over a distributed positional inverted index.

The index is partitioned by documents: a segment holds about a megabyte of text
and, for each term, the ascending places of that term in the segment. Documents
of a segment follow one another with a gap, so that no phrase or proximity match
spans two. Segments are written as Parquet rows (terms, list offsets, delta-coded
places) in the shared folder; building one needs no shuffle, and no term, however
frequent, gathers postings beyond its segment's.

A phrase is found by intersecting the offset-adjusted lists of its terms, from
the rarest one in the segment; a proximity match asks for all terms within a span
of words. Test items are compiled to windows on the driver, item by item, and
broadcast in parts of about ``PART`` windows. A worker holds one part at a time:
a benchmark of any size is searched, in as many passes over a task's segments as
it has parts. Windows are looked up by their rarest term in the test set, so a
segment meets those alone whose rarest term it holds. By default the index keeps
the postings of terms that the test set uses, as the others can never be read,
while these are ``KEPT_TERMS`` at most; beyond that it keeps all postings.

Words are maximal runs of digits, letters a-z (A-Z lower-cased) and all
characters from U+0080; terms are 64-bit fingerprints of a word's bytes. Ten
consecutive terms must agree at consecutive places for a match.

Defined cases: a null or empty text has no word; an item without words, or
without an id, matches nothing; an item shorter than a window is one window; items with equal texts
each count; repeated rows are judged one by one; empty tables give empty results
(or no match); other columns are not read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, BinaryType, IntegerType, LongType, StringType, StructType

from folioscope.llm import kernel as K
from folioscope.llm.common import fresh, lean, prepare, texts

#: Words in a window.
WINDOW = 10
#: Bytes of text in an index segment.
SEGMENT = 1 << 20
#: Windows that one broadcast part holds, but for its last item's (about 150 bytes each).
PART = 200_000
#: Terms that are broadcast to restrict the index.
KEPT_TERMS = 1_000_000
#: Places between the documents of a segment; longer than any window or span.
GAP = 64

WORD = np.zeros(256, bool)
WORD[[*range(0x30, 0x3A), *range(0x61, 0x7B), *range(0x80, 0x100)]] = True



def words_of(buf: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Terms of all texts in order, and each one's text number."""
    buf = K.LOWER[buf]
    start, end, doc = K.runs(WORD[buf], offsets)
    return K.Fingerprints(buf).of(start, end), doc


def places_of(doc: np.ndarray, n_words: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Each word's place in its segment, and each document's first place."""
    base = np.cumsum(n_words + GAP) - n_words - GAP
    first = np.cumsum(n_words) - n_words
    return base[doc] + (np.arange(len(doc)) - first[doc]), base


# --- the compiled test set ----------------------------------------------------------------------


class Windows:
    """Distinct windows of one width as term rows, with the items that hold each.

    They are sorted by their rarest term, the one that fewest windows hold.
    """

    def __init__(self, width: int, rows: np.ndarray, owners: list[list[str]]):
        terms, ids, counts = np.unique(rows, return_inverse=True, return_counts=True)
        ids = ids.reshape(rows.shape)
        rarest = ids[np.arange(len(rows)), np.argmin(counts[ids], axis=1)]
        order = np.argsort(rarest, kind="stable")
        self.width, self.rows, self.owners = width, rows[order], [owners[k] for k in order.tolist()]
        anchors, first = np.unique(rarest[order], return_index=True)
        self.anchors, self.first = terms[anchors], np.append(first, len(rows))

    def met_by(self, terms: np.ndarray) -> np.ndarray:
        """Windows whose rarest term is among ``terms`` (sorted)."""
        if not len(terms):
            return np.zeros(0, np.int64)
        at = np.minimum(np.searchsorted(terms, self.anchors), len(terms) - 1)
        hit = np.flatnonzero(terms[at] == self.anchors)
        return np.concatenate([np.zeros(0, np.int64), *[np.arange(self.first[k], self.first[k + 1]) for k in hit.tolist()]])


def compile_items(items: Iterable[tuple[object, str | None]], window: int = WINDOW) -> Iterator[list[Windows]]:
    """The windows of all items, part by part; a part holds one table per width."""
    found: dict[int, dict[bytes, list[str]]] = {}

    def part() -> list[Windows]:
        return [Windows(width, np.frombuffer(b"".join(rows), K.U).reshape(len(rows), width), list(rows.values())) for width, rows in sorted(found.items())]

    for name, text in items:
        if name is None:  # no item
            continue
        data = np.frombuffer((text or "").encode(), np.uint8)
        terms, _ = words_of(data, np.asarray([0, len(data)]))
        width = min(window, len(terms))
        for at in range(len(terms) - width + 1 if width else 0):
            owners = found.setdefault(width, {}).setdefault(terms[at: at + width].tobytes(), [])
            if not owners or owners[-1] != str(name):
                owners.append(str(name))
        if sum(map(len, found.values())) >= PART:
            yield part()
            found = {}
    if found:
        yield part()


# --- building -----------------------------------------------------------------------------------


def build(docs: DataFrame, path: str, keep: np.ndarray | None, columns: tuple[str, ...] = ("doc_id",)) -> None:
    """Write the index of ``docs``; ``keep`` (sorted terms) restricts the stored postings.

    ``columns`` of each document are stored beside its words, so that a match can
    be answered, or its document kept, from the index alone.
    """
    spark = prepare(docs.sparkSession)
    rows = docs.select(F.struct(*[docs[c] for c in columns]).alias("row"), F.col("text").cast("string").alias("text"))
    shared = None if keep is None else spark.sparkContext.broadcast(keep)
    schema = (
        StructType()
        .add("row", ArrayType(rows.schema["row"].dataType))
        .add("n_words", ArrayType(LongType()))
        .add("terms", ArrayType(LongType()))
        .add("lists", ArrayType(IntegerType()))
        .add("places", BinaryType())
    )

    def segments(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = None if shared is None else shared.value
        for batch in batches:
            for part, buf, offsets in K.string_chunks(batch, "text", SEGMENT):
                terms, doc = words_of(buf, offsets)
                n_words = np.bincount(doc, minlength=len(offsets) - 1).astype(np.int64)
                places, _ = places_of(doc, n_words)
                if known is not None:
                    at = np.minimum(np.searchsorted(known, terms), max(len(known) - 1, 0))
                    held = known[at] == terms if len(known) else np.zeros(len(terms), bool)
                    terms, places = terms[held], places[held]
                order = np.argsort(terms, kind="stable")
                terms, places = terms[order], places[order]
                unique, first = np.unique(terms, return_index=True)
                steps = np.diff(places, prepend=0)
                steps[first] = places[first]
                lists = np.append(first, len(places)).astype(np.int32)
                whole = lambda a, t: pa.ListArray.from_arrays(pa.array([0, len(a)], pa.int32()), pa.array(a, t))
                held_rows = K.batched(batch, part).column("row")
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.ListArray.from_arrays(pa.array([0, len(held_rows)], pa.int32()), held_rows),
                        whole(n_words, pa.int64()), whole(unique.view(np.int64), pa.int64()), whole(lists, pa.int32()),
                        pa.array([steps.astype("<i4").tobytes()], pa.binary()),
                    ],
                    ["row", "n_words", "terms", "lists", "places"],
                )

    rows.mapInArrow(lean(segments), schema).write.option("compression", "zstd").parquet(path)


# --- searching ----------------------------------------------------------------------------------


class Segment:
    def __init__(self, terms: np.ndarray, lists: np.ndarray, steps: np.ndarray, n_words: np.ndarray):
        self.order = np.argsort(terms)
        self.terms, self.lists, self.steps, self.n_words = terms[self.order], lists, steps, n_words
        self.base = np.cumsum(n_words + GAP) - n_words - GAP
        self.known: dict[int, np.ndarray] = {}

    def lookup(self, terms: np.ndarray) -> np.ndarray:
        """Each term's list number, or -1."""
        if not len(self.terms):
            return np.full(terms.shape, -1)
        at = np.minimum(np.searchsorted(self.terms, terms), len(self.terms) - 1)
        return np.where(self.terms[at] == terms, self.order[at], -1)

    def places(self, number: int) -> np.ndarray:
        got = self.known.get(number)
        if got is None:
            got = self.known[number] = np.cumsum(self.steps[self.lists[number]: self.lists[number + 1]])
        return got

    def phrases(self, part: Windows) -> Iterator[tuple[int, np.ndarray]]:
        """(window, starting places) of the windows that occur."""
        met = part.met_by(self.terms)
        numbers = self.lookup(part.rows[met])
        alive = np.flatnonzero((numbers >= 0).all(1))
        sizes = np.diff(self.lists)
        for w, row in zip(met[alive].tolist(), numbers[alive], strict=True):
            order = np.argsort(sizes[row], kind="stable").tolist()
            starts = self.places(row[order[0]]) - order[0]
            for k in order[1:]:
                other = self.places(row[k])
                at = np.searchsorted(other, starts + k)
                at[at == len(other)] = 0
                starts = starts[other[at] == starts + k]
                if not len(starts):
                    break
            else:
                yield w, starts

    def near(self, terms: np.ndarray, span: int) -> np.ndarray:
        """Documents with all ``terms``, in any order, within ``span`` words."""
        numbers = self.lookup(terms)
        if (numbers < 0).any():
            return np.zeros(0, np.int64)
        lists = sorted((self.places(n) for n in numbers.tolist()), key=len)
        hits: set[int] = set()
        for at in lists[0].tolist():  # the span holds a place of the rarest term
            for low in range(at - span + 1, at + 1):
                if all(np.searchsorted(p, low + span) > np.searchsorted(p, low) for p in lists[1:]):
                    hits.add(int(np.searchsorted(self.base, at, "right")) - 1)
                    break
        return np.asarray(sorted(hits), np.int64)


def segments_of(batch: pa.RecordBatch) -> Iterator[tuple[Segment, pa.Array]]:
    for i in range(len(batch)):
        get = lambda c: batch.column(c)[i].values.to_numpy(zero_copy_only=False)  # noqa: B023, E731
        steps = np.frombuffer(batch.column("places")[i].as_buffer(), "<i4").astype(np.int64)
        yield Segment(get("terms").view(K.U), get("lists"), steps, get("n_words")), batch.column("row")[i].values


def matches(spark: SparkSession, path: str, parts: list[Broadcast]) -> DataFrame:
    """Per indexed document: row, n_words, n_hit, and the items that occur in it.

    Each task answers for whole segments, hence for whole documents. More than
    one part makes more than one pass over the segments inside the same task.
    """
    prepare(spark)
    stored = spark.read.parquet(path)
    row_type = stored.schema["row"].dataType.elementType

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            held = list(segments_of(batch))
            hits = [np.zeros(int((segment.n_words + GAP).sum()) + 1, bool) for segment, _ in held]
            items: list[dict[int, set[str]]] = [{} for _ in held]
            for b in parts:
                for part in b.value:
                    for (segment, _), hit, found in zip(held, hits, items, strict=True):
                        for w, starts in segment.phrases(part):
                            for k in range(part.width):
                                hit[starts + k] = True
                            for d in np.unique(np.searchsorted(segment.base, starts, "right") - 1).tolist():
                                found.setdefault(d, set()).update(part.owners[w])
                if len(parts) > 1:
                    b.__dict__.pop("_value", None)  # one part at a time; it is read again from the local copy
            for (segment, rows), hit, found in zip(held, hits, items, strict=True):
                upto = np.zeros(len(hit) + 1, np.int64)
                np.cumsum(hit, out=upto[1:])
                n_hit = upto[segment.base + segment.n_words] - upto[segment.base]
                yield pa.RecordBatch.from_arrays(
                    [rows, pa.array(segment.n_words, pa.int64()), pa.array(n_hit, pa.int64()), pa.array([sorted(found.get(d, ())) for d in range(len(n_hit))], pa.list_(pa.string()))],
                    ["row", "n_words", "n_hit", "items"],
                )

    schema = StructType().add("row", row_type).add("n_words", LongType()).add("n_hit", LongType()).add("items", ArrayType(StringType()))
    return stored.mapInArrow(lean(search), schema)


def near_matches(spark: SparkSession, path: str, phrase: str, span: int) -> DataFrame:
    """Rows of documents that hold all words of ``phrase`` within ``span`` words."""
    if span > GAP:
        raise ValueError(f"a span is at most {GAP} words")
    prepare(spark)
    data = np.frombuffer(phrase.encode(), np.uint8)
    terms = np.unique(words_of(data, np.asarray([0, len(data)]))[0])
    stored = spark.read.parquet(path)

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for segment, rows in segments_of(batch):
                yield pa.RecordBatch.from_arrays([rows.take(pa.array(segment.near(terms, span)))], ["row"])

    return stored.mapInArrow(lean(search), StructType().add("row", stored.schema["row"].dataType.elementType)).select("row.*")


def decontaminate(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, columns: tuple[str, ...] = ("doc_id",), label: str = "index") -> DataFrame:
    """Index ``docs``, search every item of ``benchmark``, and give :func:`matches`.

    The items pass through the driver one by one; it holds a part of their
    windows, and the distinct terms of all.
    """
    spark = docs.sparkSession
    items = ((r[0], r[1]) for r in benchmark.select(F.col("item_id"), F.col("text").cast("string")).toLocalIterator())
    parts, keep = [], np.zeros(0, K.U)
    for part in compile_items(items, window):
        parts.append(spark.sparkContext.broadcast(part))
        if keep is not None:
            keep = np.unique(np.concatenate([keep, *[w.rows.ravel() for w in part]]))
            keep = None if len(keep) > KEPT_TERMS else keep
    path = fresh(spark, label)
    build(docs, path, keep, columns)
    return matches(spark, path, parts)


def items_digest(names: list[str]) -> str:
    return hashlib.sha256(",".join(sorted(names)).encode()).hexdigest()
