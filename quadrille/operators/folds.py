"""Folds over the regions of an image, for all images of an Arrow batch at once.

A step works on the next region of every image that has one.  An image is one row with an array, tens of regions as a rule.
"""

import numpy as np
import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql.functions import arrow_udf

REGION = "struct<ord:bigint,x:bigint,y:bigint,w:bigint,h:bigint>"
GROUP = "struct<index:bigint,x:bigint,y:bigint,w:bigint,h:bigint,region_count:bigint,ords:array<bigint>>"


def _rows(lists: pa.Array) -> tuple[pa.StructArray, np.ndarray, np.ndarray]:
    """The items of an array of lists, where each list begins in them, and how many it has."""
    count = lists.value_lengths().fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64)
    return lists.flatten(), np.cumsum(count) - count, count


def _whole(rows: pa.StructArray, *names: str) -> list[np.ndarray]:
    return [rows.field(n).fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64) for n in names]


def _lists(of: np.ndarray, n: int, items: pa.Array) -> pa.Array:
    """n lists of the items, which are sorted by the list that each is of."""
    return pa.ListArray.from_arrays(pa.array(np.searchsorted(of, np.arange(n + 1)), pa.int32()), items)


def _apart(x: np.ndarray, y: np.ndarray, w: np.ndarray, h: np.ndarray, start: np.ndarray, count: np.ndarray, threshold: float) -> np.ndarray:
    """Which rectangles of lists overlap none kept before them in their list by an IoU of threshold or more."""
    keep = np.ones(len(x), bool)
    for k in range(1, int(count.max(initial=0))):
        first = start[count > k, None]
        before, own = first + np.arange(k), first + k
        keep[own[:, 0]] = ~(keep[before] & (_iou(x, y, w, h, before, own) >= threshold)).any(1)
    return keep


def _iou(x: np.ndarray, y: np.ndarray, w: np.ndarray, h: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Intersection over union of rectangles at the places a and b; 0 where there is no overlap."""
    wide = np.minimum(x[a] + w[a], x[b] + w[b]) - np.maximum(x[a], x[b])
    high = np.minimum(y[a] + h[a], y[b] + h[b]) - np.maximum(y[a], y[b])
    both = np.where((wide > 0) & (high > 0), wide * high, 0)
    return np.divide(both, w[a] * h[a] + w[b] * h[b] - both, out=np.zeros(both.shape), where=both > 0)


def apart(regions: Column, threshold: float) -> Column:
    """regions (an array of REGION) without those that overlap one kept before them by an IoU of threshold or more."""

    @arrow_udf(f"array<{REGION}>")
    def kept(lists: pa.Array) -> pa.Array:
        rows, start, count = _rows(lists)
        place = np.flatnonzero(_apart(*_whole(rows, "x", "y", "w", "h"), start, count, threshold))
        return _lists(np.repeat(np.arange(len(count)), count)[place], len(count), rows.take(pa.array(place)))

    return kept(regions)


def crop_groups(boxes: Column, max_width: Column, max_height: Column, gap: Column) -> Column:
    """boxes (an array of structs of ord, x0, y0, x1, y1) -> an array of GROUP: each box joins the close group whose box grows least (the
    first of equals) and still fits, else it opens a group; groups are numbered from 1 by (y, x, age)."""

    @arrow_udf(f"array<{GROUP}>")
    def grouped(lists: pa.Array, most_x: pa.Array, most_y: pa.Array, near: pa.Array) -> pa.Array:
        rows, start, count = _rows(lists)
        x0, y0, x1, y1, ords = _whole(rows, "x0", "y0", "x1", "y1", "ord")
        most_x, most_y, near = (v.to_numpy(zero_copy_only=False)[:, None] for v in (most_x, most_y, near))
        gx0, gy0, gx1, gy1, of = np.zeros((5, len(rows)), np.int64)  # an image's groups begin where its boxes do
        held = np.zeros(len(count), np.int64)
        area = lambda a, b, c, d: np.maximum(0, c - a) * np.maximum(0, d - b)
        for k in range(int(count.max(initial=0))):
            image = np.flatnonzero(count > k)
            own, g = start[image] + k, np.arange(int(held[image].max()))
            at = np.minimum(start[image, None] + g, len(rows) - 1)
            a, b, c, d = (v[own, None] for v in (x0, y0, x1, y1))
            ux0, uy0, ux1, uy1 = np.minimum(gx0[at], a), np.minimum(gy0[at], b), np.maximum(gx1[at], c), np.maximum(gy1[at], d)
            room = near[image]
            fits = (gx1[at] + room >= a) & (c + room >= gx0[at]) & (gy1[at] + room >= b) & (d + room >= gy0[at])
            fits &= (g < held[image, None]) & (ux1 - ux0 <= most_x[image]) & (uy1 - uy0 <= most_y[image])
            joins = fits.any(1)
            place = start[image] + held[image]
            if joins.any():
                added = area(ux0, uy0, ux1, uy1) - area(gx0[at], gy0[at], gx1[at], gy1[at])
                best = np.where(fits, added, np.iinfo(np.int64).max).argmin(1)
                place = np.where(joins, start[image] + best, place)
            opens = ~joins
            for box, mine, pick in ((gx0, x0, np.minimum), (gy0, y0, np.minimum), (gx1, x1, np.maximum), (gy1, y1, np.maximum)):
                box[place] = np.where(opens, mine[own], pick(box[place], mine[own]))
            held[image] += opens
            of[own] = place
        image = np.repeat(np.arange(len(count)), held)
        first = np.cumsum(held) - held
        slot = np.arange(len(image)) - np.repeat(first - start, held)
        order = np.lexsort((slot, gx0[slot], gy0[slot], image))
        slot = slot[order]
        size = np.bincount(of, minlength=len(rows))[slot] if len(rows) else np.zeros(0, np.int64)
        rank = np.zeros(len(rows), np.int64)
        rank[slot] = np.arange(len(slot))
        members = np.argsort(rank[of], kind="stable")
        index = np.arange(len(slot)) - first[image] + 1
        listed = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(size)]), pa.int32()), pa.array(ords[members]))
        whole = [index, gx0[slot], gy0[slot], gx1[slot] - gx0[slot], gy1[slot] - gy0[slot], size]
        names = ["index", "x", "y", "w", "h", "region_count", "ords"]
        return _lists(image, len(count), pa.StructArray.from_arrays([*(pa.array(v, pa.int64()) for v in whole), listed], names))

    return grouped(boxes, max_width, max_height, gap)


def covered(rects: Column) -> Column:
    """The exact area under rects, an array of structs of y0, y1, x0, x1 in this order.  Edges cut an image into slabs; in each the
    part of a rectangle counts that lies beyond the end of those before it."""

    @arrow_udf("bigint")
    def area(lists: pa.Array) -> pa.Array:
        rows, start, count = _rows(lists)
        y0, y1, x0, x1 = _whole(rows, "y0", "y1", "x0", "x1")
        owner = np.repeat(np.arange(len(count)), count)
        edge, image = np.concatenate([x0, x1]), np.concatenate([owner, owner])
        order = np.lexsort((edge, image))
        edge, image = edge[order], image[order]
        inner = np.flatnonzero((image[1:] == image[:-1]) & (edge[1:] > edge[:-1]))
        left, right, image = edge[inner], edge[inner + 1], image[inner]
        end, total = np.full(len(inner), np.iinfo(np.int64).min), np.zeros(len(inner), np.int64)
        for k in range(int(count.max(initial=0))):
            slab = np.flatnonzero(count[image] > k)
            own = start[image[slab]] + k
            inside = (x0[own] < right[slab]) & (x1[own] > left[slab])
            slab, own = slab[inside], own[inside]
            total[slab] += np.maximum(0, y1[own] - np.maximum(y0[own], end[slab]))
            end[slab] = np.maximum(end[slab], y1[own])
        out = np.zeros(len(count), np.int64)
        np.add.at(out, image, (right - left) * total)
        return pa.array(out)

    return area(rects)
