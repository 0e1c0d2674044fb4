"""Column functions for rectangles (x, y, w, h) and boxes (x0, y0, x1, y1); ends are exclusive."""

from pyspark.sql import Column
from pyspark.sql import functions as F


def clamp(value: Column, low, high) -> Column:
    lit = lambda v: v if isinstance(v, Column) else F.lit(v)
    return F.greatest(lit(low), F.least(lit(high), value))


def half_even(value: Column) -> Column:
    """Nearest integer, halves to the even one."""
    return F.rint(value).cast("long")


def thousandths(value: Column) -> Column:
    """value to three decimals, halves to the even digit."""
    return F.rint(value * 1000) / 1000


def overlap(a: Column, b: Column) -> Column:
    """Area that two rectangles have in common."""
    wide = F.least(a["x"] + a["w"], b["x"] + b["w"]) - F.greatest(a["x"], b["x"])
    high = F.least(a["y"] + a["h"], b["y"] + b["h"]) - F.greatest(a["y"], b["y"])
    return F.when((wide > 0) & (high > 0), wide * high).otherwise(0)


def iou(a: Column, b: Column) -> Column:
    """Intersection over union; 0 where there is no overlap."""
    both = overlap(a, b)
    return F.when(both > 0, both / (a["w"] * a["h"] + b["w"] * b["h"] - both)).otherwise(0.0)


def box(x0: Column, y0: Column, x1: Column, y1: Column) -> Column:
    return F.struct(x0.alias("x0"), y0.alias("y0"), x1.alias("x1"), y1.alias("y1"))


def padded_box(r: Column, padding: int, width: int, height: int) -> Column:
    """A rectangle widened on all sides and clamped to the frame."""
    return box(
        clamp(r["x"] - padding, 0, width), clamp(r["y"] - padding, 0, height),
        clamp(r["x"] + r["w"] + padding, 0, width), clamp(r["y"] + r["h"] + padding, 0, height),
    )


def close(a: Column, b: Column, gap: int) -> Column:
    """Whether boxes are at most gap apart on both axes."""
    apart = (a["x1"] + gap < b["x0"]) | (b["x1"] + gap < a["x0"]) | (a["y1"] + gap < b["y0"]) | (b["y1"] + gap < a["y0"])
    return ~apart
