"""Boxes: struct(x0, y0, x1, y1) of doubles, y growing downwards."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

SIDES = ("x0", "y0", "x1", "y1")


def box(x0: Column, y0: Column, x1: Column, y1: Column) -> Column:
    return F.struct(*(F.round(v.cast("double"), 2).alias(n) for n, v in zip(SIDES, (x0, y0, x1, y1))))


def width(b: Column) -> Column:
    return F.greatest(F.lit(0.0), b["x1"] - b["x0"])


def height(b: Column) -> Column:
    return F.greatest(F.lit(0.0), b["y1"] - b["y0"])


def area(b: Column) -> Column:
    return width(b) * height(b)


def envelope(b: Column) -> Column:
    """Aggregate: the smallest box around all boxes of a group."""
    return F.struct(F.min(b["x0"]).alias("x0"), F.min(b["y0"]).alias("y0"), F.max(b["x1"]).alias("x1"), F.max(b["y1"]).alias("y1"))


def envelope_of(boxes: Column) -> Column:
    """The smallest box around an array of boxes; null for none."""
    least = lambda n: F.array_min(F.transform(boxes, lambda b: b[n])).alias(n)
    most = lambda n: F.array_max(F.transform(boxes, lambda b: b[n])).alias(n)
    return F.when(F.size(boxes) > 0, F.struct(least("x0"), least("y0"), most("x1"), most("y1")))


def vertical_distance(a: Column, b: Column) -> Column:
    return F.greatest(F.lit(0.0), b["y0"] - a["y1"], a["y0"] - b["y1"])


def horizontal_overlap(a: Column, b: Column) -> Column:
    """Shared width over the narrower box's width (at least 1)."""
    shared = F.greatest(F.lit(0.0), F.least(a["x1"], b["x1"]) - F.greatest(a["x0"], b["x0"]))
    return shared / F.greatest(F.lit(1.0), F.least(width(a), width(b)))


def contains_y(b: Column, y: Column) -> Column:
    return y.between(b["y0"], b["y1"])


def clamp(b: Column, page_width: Column, page_height: Column, least: float = 24.0) -> Column:
    """Box cut to the page; null if a side gets shorter than ``least``."""
    inside = F.struct(
        F.greatest(F.lit(0.0), b["x0"]).alias("x0"), F.greatest(F.lit(0.0), b["y0"]).alias("y0"), F.least(page_width, b["x1"]).alias("x1"), F.least(page_height, b["y1"]).alias("y1")
    )
    return F.when((inside["x1"] - inside["x0"] >= least) & (inside["y1"] - inside["y0"] >= least), inside)
