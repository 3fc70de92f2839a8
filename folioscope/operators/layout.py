"""Recognised lines to blocks in reading order."""

from __future__ import annotations

from collections.abc import Iterator
from statistics import median

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

BLOCKS = "document_id {document}, page_id {page}, block long, x0 double, y0 double, x1 double, y1 double, n_lines long, text string"
#: Blocks sent at once, about.
ROWS = 5_000


def overlap(a: tuple, b: list) -> float:
    shared, narrow = min(a[2], b[2]) - max(a[0], b[0]), min(a[2] - a[0], b[2] - b[0])
    return shared / narrow if shared > 0 and narrow > 0 else 0.0


def group_lines(lines: list[tuple[float, float, float, float, str]], gap_factor: float, min_overlap: float) -> list[list]:
    """Blocks [x0, y0, x1, y1, texts]: a line joins the block it overlaps most, if it lies close below."""
    tall = [ln[3] - ln[1] for ln in lines if ln[3] > ln[1]]
    height = median(tall) if tall else 1.0
    blocks: list[list] = []
    for line in sorted(lines, key=lambda ln: (ln[1], ln[0])):
        fit = [(overlap(line, b), -k) for k, b in enumerate(blocks) if -0.5 * height <= line[1] - b[3] <= gap_factor * height]
        best = max((f for f in fit if f[0] >= min_overlap and f[0] > 0), default=None)
        if best is None:
            blocks.append([*line[:4], [line[4]]])
            continue
        b = blocks[-best[1]]
        b[:4] = [min(b[0], line[0]), min(b[1], line[1]), max(b[2], line[2]), max(b[3], line[3])]
        b[4].append(line[4])
    return blocks


def line_blocks(lines: DataFrame, gap_factor: float = 1.2, min_overlap: float = 0.3) -> DataFrame:
    """Blocks of every page, in two bands (left or whole width, right half), then by y.

    lines: document_id, page_id, page_width, x0, y0, x1, y1, text; ids of any kind.
    The merge is sequential, so a page's lines meet in one task; a page bounds their number.
    """
    kind = {c: lines.schema[c].dataType.simpleString() for c in ("document_id", "page_id")}
    schema = BLOCKS.format(document=kind["document_id"], page=kind["page_id"])

    columns = ["document_id", "page_id", "page_width", "x0", "y0", "x1", "y1", "text"]
    names = [c.split()[0] for c in schema.split(", ")]

    def page_rows(page: tuple, width: float | None, rows: list[tuple]) -> Iterator[tuple]:
        found = group_lines(rows, gap_factor, min_overlap)
        half = (width or 0.0) / 2
        found.sort(key=lambda b: (half > 0 and b[0] >= half, b[1]))
        for k, b in enumerate(found):
            yield *page, k, *b[:4], len(b[4]), " ".join(b[4])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, width, rows, out, kinds = None, None, [], [], None

        def block_batch() -> pa.RecordBatch:
            types = [*kinds, pa.int64(), *[pa.float64()] * 4, pa.int64(), pa.string()]
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), types)], names)

        for batch in batches:
            kinds = [batch.schema.field(c).type for c in columns[:2]]
            for d, p, w, *line in zip(*(batch.column(c).to_pylist() for c in columns)):
                if (d, p) != now:
                    if rows:
                        out.extend(page_rows(now, width, rows))
                    now, width, rows = (d, p), w, []
                rows.append(tuple(line))
            if len(out) >= ROWS:
                yield block_batch()
                out = []
        if rows:
            out.extend(page_rows(now, width, rows))
        if out:
            yield block_batch()

    # Pages stream by: a task holds the lines of one page, in order, and the blocks not yet sent.
    keys = ["document_id", "page_id"]
    kept = lines.select(*columns).where(F.trim("text") != "").repartition(*keys).sortWithinPartitions(*keys, "y0", "x0", "text")
    return kept.mapInArrow(run, schema)


def recognised_blocks(lines: DataFrame, least_score: float = 0.5) -> DataFrame:
    """Blocks of a recogniser's lines (polygon, text, score): scored, boxed, grouped, in reading order, spacing repaired, named.

    lines: (document_id, page_id, page_width, polygon, text, score). A page whose
    recognition failed has no line and no block.
    """
    from folioscope.functions.geometry import polygon_box
    from folioscope.functions.text import repair_spacing

    kept = lines.where((F.col("score") >= least_score) & (F.size("polygon") > 0)).withColumn("b", polygon_box(F.col("polygon")))
    boxed = kept.select("document_id", "page_id", "page_width", "b.x0", "b.y0", "b.x1", "b.y1", "text")
    name = F.concat(F.lit("p"), F.col("page_id").cast("string"), F.lit("_b"), (F.col("block") + 1).cast("string"))
    return line_blocks(boxed).withColumn("text", repair_spacing(F.col("text"))).withColumn("block_id", name)
