"""Layout geometry as Column arithmetic over x0, y0, x1, y1."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def valid_box(x0: Column, y0: Column, x1: Column, y1: Column) -> Column:
    return F.coalesce((x1 > x0) & (y1 > y0), F.lit(False))


def polygon_box(points: Column) -> Column:
    """The bounding box of array<array<double>>."""
    xs, ys = F.transform(points, lambda p: p[0]), F.transform(points, lambda p: p[1])
    return F.struct(F.array_min(xs).alias("x0"), F.array_min(ys).alias("y0"), F.array_max(xs).alias("x1"), F.array_max(ys).alias("y1"))


def x_overlap(a0: Column, a1: Column, b0: Column, b1: Column) -> Column:
    """Horizontal overlap over the narrower width."""
    inter, narrow = F.least(a1, b1) - F.greatest(a0, b0), F.least(a1 - a0, b1 - b0)
    return F.when((inter > 0) & (narrow > 0), inter / narrow).otherwise(0.0)


def scale_box(x0: Column, y0: Column, x1: Column, y1: Column, page_w: Column, page_h: Column, image_w: Column, image_h: Column) -> Column:
    """A page box on an image: outer whole pixels, clamped."""
    low = lambda v, page, image: F.greatest(F.lit(0), F.floor(v * image / page)).cast("long")
    high = lambda v, page, image: F.least(image.cast("long"), F.ceil(v * image / page)).cast("long")
    return F.struct(low(x0, page_w, image_w).alias("x0"), low(y0, page_h, image_h).alias("y0"), high(x1, page_w, image_w).alias("x1"), high(y1, page_h, image_h).alias("y1"))


def reader_scale(w: Column, h: Column, max_pixels: Column) -> Column:
    """At most 1: the factor that brings w x h under max_pixels."""
    return F.least(F.lit(1.0), F.sqrt(max_pixels / (w * h)))


def coarse_cell(x0: Column, y0: Column, x1: Column, y1: Column, w: Column, h: Column) -> Column:
    """0..8, the cell of a 3 x 3 grid that holds the centre; null without valid geometry."""
    at = lambda a, b, size: F.least(F.lit(2), F.greatest(F.lit(0), F.floor(F.greatest(F.lit(0.0), F.least(size - 1e-6, (a + b) * 0.5)) / size * 3.0)))
    cell = at(y0, y1, h) * 3 + at(x0, x1, w)
    return F.when(valid_box(x0, y0, x1, y1) & (w > 0) & (h > 0), cell.cast("int"))


def cell_name(page: Column, cell: Column) -> Column:
    """``p<page>_g<row><column>``; null without a cell."""
    return F.when(page.isNotNull() & cell.isNotNull(), F.format_string("p%d_g%d%d", page, F.floor(cell / 3).cast("int"), F.pmod(cell, F.lit(3)).cast("int")))


def box_features(x0: Column, y0: Column, x1: Column, y1: Column, w: Column, h: Column) -> dict[str, Column]:
    """Normalised centre, size and area; the whole page without valid geometry."""
    ok = valid_box(x0, y0, x1, y1) & (w > 0) & (h > 0)
    unit = lambda v: F.greatest(F.lit(0.0), F.least(F.lit(1.0), v))
    cx, cy = unit((x0 + x1) * 0.5 / w), unit((y0 + y1) * 0.5 / h)
    bw, bh = unit((x1 - x0) / w), unit((y1 - y0) / h)
    return {
        "bbox_cx": F.when(ok, cx).otherwise(0.5), "bbox_cy": F.when(ok, cy).otherwise(0.5),
        "bbox_w": F.when(ok, bw).otherwise(1.0), "bbox_h": F.when(ok, bh).otherwise(1.0), "bbox_area": F.when(ok, bw * bh).otherwise(1.0),
    }


def crop_box(box: Column, image_w: Column, image_h: Column, expand: float = 0.02) -> Column:
    """A whole-pixel box widened by a share of its size, two pixels at least, within the image; null where nothing is left."""
    ex = F.greatest(F.lit(2), F.bround((box["x1"] - box["x0"]) * expand).cast("long"))
    ey = F.greatest(F.lit(2), F.bround((box["y1"] - box["y0"]) * expand).cast("long"))
    x0, y0 = F.greatest(F.lit(0), box["x0"] - ex), F.greatest(F.lit(0), box["y0"] - ey)
    x1, y1 = F.least(image_w.cast("long"), box["x1"] + ex), F.least(image_h.cast("long"), box["y1"] + ey)
    return F.when((x1 > x0) & (y1 > y0), F.struct(x0.alias("x0"), y0.alias("y0"), x1.alias("x1"), y1.alias("y1")))


def crop_size(box: Column, scale: Column) -> Column:
    """(w, h) of a crop brought down by ``scale``, a pixel at least."""
    side = lambda a, b: F.when(scale < 1.0, F.greatest(F.lit(1), F.floor((b - a) * scale).cast("long"))).otherwise(b - a)
    return F.struct(side(box["x0"], box["x1"]).alias("w"), side(box["y0"], box["y1"]).alias("h"))
