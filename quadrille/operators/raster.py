"""Masks and rasters as pixel relations: pixels(image_id, y, x, v), dense, with v from 0 to 255.

Everything is partitioned by image; moving maxima and running sums are windows over a row or a column of one image, so no
window is larger than a raster's side.
"""

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.boxes import clamp, half_even, thousandths
from ..sources.shared import by_image, by_merge, cut

SOLID = 18  # a grey value from here on counts as set after a filter
#: Pixels of whole images that a task works off at a time.
SLAB = 1 << 17


def coverage(pixels: DataFrame) -> DataFrame:
    """image_id, full_ratio (share of 255), coverage (per cent over 0, three decimals) and the box of what is over 0."""
    on = F.col("v") > 0
    box = {"x0": F.min(F.when(on, F.col("x"))), "y0": F.min(F.when(on, F.col("y"))), "x1": F.max(F.when(on, F.col("x") + 1)), "y1": F.max(F.when(on, F.col("y") + 1))}
    return pixels.groupBy("image_id").agg(
        F.avg((F.col("v") == 255).cast("double")).alias("full_ratio"),
        thousandths(F.count_if(on) / F.count("*") * 100).alias("coverage"),
        *[F.coalesce(v, F.lit(0)).cast("long").alias(k) for k, v in box.items()],
    )


def histogram(pixels: DataFrame) -> DataFrame:
    return pixels.groupBy("image_id", "v").agg(F.count("*").alias("n"))


def threshold(pixels: DataFrame, level: float) -> DataFrame:
    """255 from int(level * 255) on, else 0; level is clamped to [0, 1]."""
    cutoff = int(min(1.0, max(0.0, level)) * 255)
    return pixels.withColumn("v", F.when(F.col("v") >= cutoff, 255).otherwise(0).cast("long"))


def _moving(pixels: DataFrame, radius: int, pick, column: str = "v") -> DataFrame:
    across = Window.partitionBy("image_id", "y").orderBy("x").rowsBetween(-radius, radius)
    down = Window.partitionBy("image_id", "x").orderBy("y").rowsBetween(-radius, radius)
    return pixels.withColumn(column, pick(column).over(across)).withColumn(column, pick(column).over(down))


def dilate(pixels: DataFrame, radius: int) -> DataFrame:
    """Largest value of a square around each pixel, then 255 from SOLID on and else 0; radius 0 changes nothing."""
    if radius <= 0:
        return pixels
    return _moving(pixels, radius, F.max).withColumn("v", F.when(F.col("v") >= SOLID, 255).otherwise(0).cast("long"))


def erode(pixels: DataFrame, radius: int) -> DataFrame:
    return _moving(pixels, radius, F.min) if radius > 0 else pixels


def close_gaps(pixels: DataFrame, radius: int) -> DataFrame:
    """Dilation, then erosion."""
    return erode(_moving(pixels, radius, F.max), radius)


def least_of_tied(n: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """For each of n nodes the least that it is connected to by the edges between a and b."""
    label = np.arange(n)
    while len(a):  # roots of nodes that touch are tied to the lesser one, then paths are halved
        one, two = label[a], label[b]
        np.minimum.at(label, np.maximum(one, two), np.minimum(one, two))
        while not np.array_equal(deeper := label[label], label):
            label = deeper
        differ = label[a] != label[b]
        a, b = a[differ], b[differ]
    return label


def neighbours(places: np.ndarray, wide: int) -> tuple[np.ndarray, np.ndarray]:
    """Which of ascending places, row * wide + column, touch each other, corners included, as two arrays of their indexes.  The
    last column of a row is empty, so that no place is beside one of the next row."""
    pairs = []
    for step in (1, wide - 1, wide, wide + 1):
        at = np.minimum(np.searchsorted(places, places + step), len(places) - 1)
        hit = np.flatnonzero(places[at] == places + step)
        pairs.append((hit, at[hit]))
    return tuple(np.concatenate(p) for p in zip(*pairs))


def joined(batch: pa.RecordBatch, on: np.ndarray, side: int) -> tuple[np.ndarray, np.ndarray]:
    """Which pixels of a batch are on, image by image in order of rows, and for each the first of those that it touches, directly or
    through others, as its place among them.  side is over every x."""
    held = np.flatnonzero(on)
    image, y, x = (batch.column(c).take(pa.array(held)).to_numpy() for c in ("image_id", "y", "x"))
    y = y - y.min(initial=0)
    row = np.unique(image, return_inverse=True)[1] * (int(y.max(initial=0)) + 2) + y  # an empty row between images
    order = np.lexsort((x, row))
    return held[order], least_of_tied(len(held), *neighbours(row[order] * (side + 1) + x[order], side + 1))


def whole_images(batches, rows: int = SLAB):
    """Batches of pixels that follow each other by image_id as batches of whole images, of so many pixels or, where the last
    image has them, more."""
    held, count, last = [], 0, None
    for batch in batches:
        if not batch.num_rows:
            continue
        image = batch.column("image_id").fill_null(0).to_numpy()
        ends = np.flatnonzero(image[1:] != image[:-1]) + 1
        begin = int(ends[-1]) if len(ends) else 0  # of the last image
        if count >= rows and (begin or image[0] != last):
            yield pa.concat_batches([*held, batch.slice(0, begin)])
            held, count, batch = [], 0, batch.slice(begin)
        held, count, last = [*held, batch], count + batch.num_rows, image[-1]
    if held:
        yield pa.concat_batches(held)


def component_sizes(batch: pa.RecordBatch, on: np.ndarray, side: int) -> np.ndarray:
    """Three rows: area, w and h of the component that each pixel of a batch of whole images belongs to; 0 for those that are not on."""
    held, label = joined(batch, on, side)
    order = np.argsort(label, kind="stable")
    roots, first, of = np.unique(label[order], return_index=True, return_inverse=True)
    y, x = (batch.column(c).take(pa.array(held[order])).to_numpy() for c in ("y", "x"))
    span = lambda v: np.maximum.reduceat(v, first) - np.minimum.reduceat(v, first) + 1
    out = np.zeros((3, batch.num_rows), np.int64)
    for row, size in zip(out, (np.bincount(of), span(x), span(y)) if len(roots) else ()):
        row[held[order]] = size[of]
    return out


def _with_component(side: int, kept: list[str]):
    """Batches of pixels that follow each other by image, each pixel that is on with its component's sizes."""

    def run(batches):
        for batch in whole_images(batches):
            out = component_sizes(batch, batch.column("on").to_numpy(zero_copy_only=False), side)
            yield pa.RecordBatch.from_arrays([*[batch.column(c) for c in kept], *map(pa.array, out)], [*kept, "area", "w", "h"])

    return run


def with_component(pixels: DataFrame, on: str, side: int) -> DataFrame:
    """pixels, each image in one part, with area, w and h of the component of pixels with a positive value in column on that each belongs
    to, corners included; 0 for others.  side is over every x.  A part's images are worked off one after the other."""
    told = F.col("image_id").isNotNull() & F.col("y").isNotNull() & F.col("x").isNotNull()
    rows = pixels.select("*", F.coalesce(told & (F.col(on) > 0), F.lit(False)).alias("on")).sortWithinPartitions("image_id")
    return rows.mapInArrow(_with_component(side, pixels.columns), pixels.select("*").schema.add("area", "long").add("w", "long").add("h", "long"))


def _least_labels(side: int):
    """Batches of images, each with the numbers of its pixels: all images of a batch are labelled at once."""

    def labelled(batch: pa.RecordBatch) -> pa.RecordBatch:
        local = batch.column("ids").flatten().to_numpy()
        of = np.repeat(np.arange(batch.num_rows), batch.column("ids").value_lengths().to_numpy())
        apart = int(local.max()) + side + 2  # no pixel is beside one of another image
        order = np.argsort(of * apart + local, kind="stable")
        of, local = of[order], local[order]
        ids, pairs = of * apart + local, []
        for dy, dx in ((0, 1), (1, -1), (1, 0), (1, 1)):
            fits = np.flatnonzero((local % side + dx >= 0) & (local % side + dx < side))
            near = ids[fits] + dy * side + dx
            at = np.minimum(np.searchsorted(ids, near), len(ids) - 1)
            hit = ids[at] == near
            pairs.append((fits[hit], at[hit]))
        label = least_of_tied(len(ids), *(np.concatenate(x) for x in zip(*pairs)))
        return pa.RecordBatch.from_arrays([batch.column("image_id").take(pa.array(of)), *map(pa.array, (local // side, local % side, local[label]))], ["image_id", "y", "x", "label"])

    return lambda batches: (labelled(b) for b in batches if b.num_rows)


def label_components(pixels: DataFrame, side: int) -> DataFrame:
    """image_id, y, x, label: pixels over 0 with the least pixel number (y * side + x) of those that they touch, corners
    included, directly or through others.  A pixel touches none of another image, so each image is labelled on its own, many
    in a batch; a raster's size bounds what one row holds."""
    ids = F.collect_list((F.col("y") * side + F.col("x")).cast("long")).alias("ids")
    images = pixels.filter("v > 0").groupBy(F.col("image_id").cast("long").alias("image_id")).agg(ids)
    return images.mapInArrow(_least_labels(side), "image_id long, y long, x long, label long")


def component_stats(labels: DataFrame) -> DataFrame:
    stats = labels.groupBy("image_id", "label").agg(F.count("*").alias("area"), F.min("x").alias("x"), F.min("y").alias("y"), F.max("x").alias("x1"), F.max("y").alias("y1"))
    return stats.select("image_id", "label", "area", "x", "y", (F.col("x1") - F.col("x") + 1).alias("w"), (F.col("y1") - F.col("y") + 1).alias("h"))


def text_like(width, height) -> Column:
    """Whether a component, of columns area, w and h, can be strokes of letters: neither a speck, nor too large, nor large and filled.
    width and height of the image are numbers or names of columns."""
    wide, high = (F.col(v) if isinstance(v, str) else F.lit(v) for v in (width, height))
    most = F.greatest(F.lit(120), F.floor(wide * high * 0.065))
    widest, highest = F.greatest(F.lit(36), F.floor(wide * 0.78)), F.greatest(F.lit(18), F.floor(high * 0.78))
    filled = (F.col("area") / F.greatest(F.lit(1), F.col("w") * F.col("h")) > 0.82) & (F.col("area") > 48)
    return (F.col("area") >= 4) & (F.col("area") <= most) & (F.col("w") <= widest) & (F.col("h") <= highest) & ~filled


def trim_to_projection(pixels: DataFrame, width: int, height: int) -> DataFrame:
    """Pixels outside the padded box of well-filled rows and columns become 0, others 255 from SOLID on and else 0.  Images
    without such rows or columns stay as they are."""
    on = pixels.withColumn("on", (F.col("v") > 0).cast("long"))

    def span(axis: str, share: float, pad: int, size: int) -> DataFrame:
        hits = on.groupBy("image_id", axis).agg(F.sum("on").alias("hits"))
        least = hits.groupBy("image_id").agg(F.greatest(F.lit(2), F.floor(F.max("hits") * share)).alias("least"))
        held = hits.join(least, "image_id").filter("hits >= least").groupBy("image_id").agg(F.min(axis).alias("lo"), F.max(axis).alias("hi"))
        return by_merge(held).select("image_id", clamp(F.col("lo") - pad, 0, size).alias(f"{axis}0"), clamp(F.col("hi") + 1 + pad, 0, size).alias(f"{axis}1"))

    rows = span("y", 0.16, max(3, round(height * 0.08)), height)
    columns = span("x", 0.08, max(6, round(width * 0.06)), width)
    boxed = pixels.join(rows, "image_id", "left").join(columns, "image_id", "left")
    bare = F.col("y0").isNull() | F.col("x0").isNull()
    inside = (F.col("x") >= F.col("x0")) & (F.col("x") <= F.col("x1")) & (F.col("y") >= F.col("y0")) & (F.col("y") <= F.col("y1"))
    value = F.when(bare, F.col("v")).when(inside & (F.col("v") >= SOLID), 255).otherwise(0)
    return boxed.select("image_id", "y", "x", value.cast("long").alias("v"))


def integral(pixels: DataFrame) -> DataFrame:
    """image_id, y, x, s: sum of all values up to and including row y and column x."""
    across = Window.partitionBy("image_id", "y").orderBy("x").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    down = Window.partitionBy("image_id", "x").orderBy("y").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return pixels.withColumn("s", F.sum("v").over(across)).withColumn("s", F.sum("s").over(down)).select("image_id", "y", "x", "s")


def box_sums(sums: DataFrame, boxes: DataFrame) -> DataFrame:
    """boxes(image_id, x0, y0, x1, y1) with total: the four corners of the integral; ends are exclusive."""
    out = boxes
    for name, x, y in (("s11", "x1", "y1"), ("s01", "x0", "y1"), ("s10", "x1", "y0"), ("s00", "x0", "y0")):
        corner = sums.select("image_id", (F.col("x") + 1).alias(x), (F.col("y") + 1).alias(y), F.col("s").alias(name))
        out = out.join(corner, ["image_id", x, y], "left")
    part = lambda c: F.coalesce(F.col(c), F.lit(0))
    return out.select(*boxes.columns, (part("s11") - part("s01") - part("s10") + part("s00")).alias("total"))


def best_window(pixels: DataFrame, side: int, window: int, stride: int, pull_x: float, pull_y: float) -> DataFrame:
    """image_id, x, y, score: the square window with the largest sum less its distance from the centre; the first by (y, x)."""
    starts = F.sequence(F.lit(0), F.lit(side - window), F.lit(stride))
    boxes = pixels.select("image_id").distinct().select("image_id", F.explode(starts).alias("y0")).select("image_id", "y0", F.explode(starts).alias("x0"))
    boxes = boxes.select("image_id", *[F.col(c).cast("long").alias(c) for c in ("x0", "y0")], (F.col("x0") + window).cast("long").alias("x1"), (F.col("y0") + window).cast("long").alias("y1"))
    away = lambda c: F.abs(F.col(c) + window / 2 - side / 2)
    scored = box_sums(integral(pixels), boxes).withColumn("score", F.col("total") - away("x0") * pull_x - away("y0") * pull_y)
    best = scored.groupBy("image_id").agg(F.max(F.struct("score", -F.col("y0"), -F.col("x0"))).alias("b"))
    return best.select("image_id", (-F.col("b.col3")).alias("x"), (-F.col("b.col2")).alias("y"), F.col("b.score").alias("score"))


def signal(rgb: DataFrame) -> DataFrame:
    """rgb(image_id, y, x, r, g, b; 0 to 1) -> image_id, y, x, s: bright and hardly coloured, clipped to [0, 1]."""
    top, low = F.greatest("r", "g", "b"), F.least("r", "g", "b")
    saturation = F.when(top > 1e-6, (top - low) / top).otherwise(0.0)
    value = ((F.col("r") + F.col("g") + F.col("b")) / 3 - 0.42) * 2.4 - saturation * 1.5
    return rgb.select("image_id", "y", "x", clamp(value, 0.0, 1.0).alias("s"))


def overlay(rgb: DataFrame, mask: DataFrame, alpha: int = 180) -> DataFrame:
    """Pixels under the mask blended with black of the given opacity."""
    keep = F.when(F.col("v") > 0, 1 - alpha / 255).otherwise(1.0)
    return rgb.join(mask, ["image_id", "y", "x"], "left").select("image_id", "y", "x", *[(F.col(c) * keep).alias(c) for c in "rgb"])


def rectangle_masks(regions: DataFrame, width: int, height: int) -> DataFrame:
    """image_id, ord, y, x of the cells of each rectangle; both ends belong to it, as image libraries draw them."""
    ys = F.sequence(clamp(F.col("y"), 0, height - 1), clamp(F.col("y") + F.col("h"), 0, height - 1))
    xs = F.sequence(clamp(F.col("x"), 0, width - 1), clamp(F.col("x") + F.col("w"), 0, width - 1))
    return regions.select("image_id", "ord", F.explode(ys).alias("y"), xs.alias("xs")).select("image_id", "ord", "y", F.explode("xs").alias("x"))


def merge_max(layers: DataFrame) -> DataFrame:
    """layers(image_id, ord, y, x, v): the largest value of each pixel."""
    return layers.groupBy("image_id", "y", "x").agg(F.max("v").alias("v"))


def merge_last(layers: DataFrame) -> DataFrame:
    """layers(image_id, ord, y, x, v): the value that was written last."""
    return layers.groupBy("image_id", "y", "x").agg(F.max_by("v", "ord").alias("v"))


def ensure_coverage(ratios: DataFrame, low: float, high: float) -> DataFrame:
    """ratios(image_id, own, band, core, own_band, own_core: shares of a mask, of two fallbacks, and of their unions) with
    choice: the mask if it has enough; else the first of (union, fallback) for band, then core, within [low, high]; else
    the first that is not empty, core before band; else the mask."""
    fits = lambda c: F.when(F.col(c).between(low, high), c)
    some = lambda c: F.when(F.col(c) > 0, c)
    choice = F.coalesce(
        F.when(F.col("own") >= low, "own"), fits("own_band"), fits("band"), fits("own_core"), fits("core"),
        some("own_core"), some("core"), some("own_band"), some("band"), F.lit("own"),
    )
    return ratios.withColumn("choice", choice)


def otsu(hist: DataFrame) -> DataFrame:
    """hist(image_id, v, n) -> image_id, cutoff: the value up to which pixels are dark, with the largest variance between
    the two classes; the first of equals."""
    upto = Window.partitionBy("image_id").orderBy("v").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    whole = Window.partitionBy("image_id")
    sums = hist.select(
        "image_id", "v", F.sum("n").over(upto).alias("n0"), F.sum(F.col("n") * F.col("v")).over(upto).alias("s0"), F.sum("n").over(whole).alias("n1"), F.sum(F.col("n") * F.col("v")).over(whole).alias("s1")
    )
    dark, light = F.col("n0"), F.col("n1") - F.col("n0")
    gap = F.col("s0") / dark - (F.col("s1") - F.col("s0")) / F.nullif(light, F.lit(0))
    between = F.coalesce(F.round(dark * light * gap * gap, 6), F.lit(0.0))
    best = sums.groupBy("image_id").agg(F.max(F.struct(between.alias("between"), (-F.col("v")).alias("v"))).alias("b"))
    return best.select("image_id", (-F.col("b.v")).cast("long").alias("cutoff"), F.col("b.between").alias("between"))


def percentile_cutoffs(rgb: DataFrame) -> DataFrame:
    """image_id, bright_cutoff, calm_cutoff: the 62nd percentile of the largest channel, 128 at least, and the 58th of the
    saturation (0 to 255), 110 at most."""
    top, low = F.greatest("r", "g", "b"), F.least("r", "g", "b")
    saturation = F.when(top > 0, F.floor((top - low) * 255 / top)).otherwise(0)
    return rgb.groupBy("image_id").agg(
        F.greatest(F.lit(128.0), F.percentile(top, 0.62)).alias("bright_cutoff"), F.least(F.lit(110.0), F.percentile(saturation, 0.58)).alias("calm_cutoff")
    )


def temporal_vote(hits: DataFrame, min_hits: int, low: float, high: float) -> DataFrame:
    """hits(image_id, y, x, frame, hit) -> image_id, y, x, v: 255 where enough frames agree.  An image under `low` coverage
    has none; one over `high` needs a frame more."""
    votes = by_image(hits).groupBy("image_id", "y", "x").agg(F.count_if("hit").alias("votes"), F.count("*").alias("frames"))
    needed = F.greatest(F.lit(1), F.least(F.lit(min_hits), F.col("frames")))
    votes = votes.withColumn("needed", needed)
    share = votes.groupBy("image_id").agg(F.avg((F.col("votes") >= F.col("needed")).cast("double")).alias("share"))
    raised = F.when(F.col("share") > high, F.least(F.col("frames"), F.col("needed") + 1)).otherwise(F.col("needed"))
    value = F.when((F.col("share") >= low) & (F.col("votes") >= raised), 255).otherwise(0)
    return votes.join(by_merge(share), "image_id").select("image_id", "y", "x", value.cast("long").alias("v"))


def _with_held(boxes: DataFrame, mask: DataFrame, x0: str, y0: str, x1: str, y1: str) -> DataFrame:
    """boxes, each with n, bx0, bx1, by0, by1: how many pixels of the mask lie in it, and their first and last column and row; null
    where none does.  The mask is a set of points(image_id, px, py) or runs(image_id, y, x0, x1).  Boxes are shuffled once, by image."""
    rows = mask.select("image_id", F.col("py").alias("my"), F.col("px").alias("m0"), (F.col("px") + 1).alias("m1")) if "px" in mask.columns else mask.select("image_id", F.col("y").alias("my"), F.col("x0").alias("m0"), F.col("x1").alias("m1"))
    b, m = boxes.alias("b"), rows.alias("m")
    inside = F.expr(f"b.image_id = m.image_id AND m0 < b.{x1} AND m1 > b.{x0} AND my >= b.{y0} AND my < b.{y1}")
    first, last = F.greatest("m0", f"b.{x0}"), F.least("m1", f"b.{x1}")
    both = b.join(by_merge(m), inside, "left").select("b.*", "my", F.when(F.col("my").isNotNull(), first).alias("first"), F.when(F.col("my").isNotNull(), last).alias("last"))
    return both.groupBy(*boxes.columns).agg(F.sum(F.col("last") - F.col("first")).alias("n"), F.min("first").alias("bx0"), (F.max("last") - 1).alias("bx1"), F.min("my").alias("by0"), F.max("my").alias("by1"))


def summarize_crops(groups: DataFrame, points: DataFrame, width: int, height: int) -> DataFrame:
    """groups(image_id, index, x, y, w, h, ...) with what the mask (points or runs, see _with_held) leaves free: coverage,
    margins and a status of empty, risky, tight or safe.  A side that lies at the frame's edge is no reason to be risky."""
    boxes = groups.withColumns({"x1": F.col("x") + F.col("w"), "y1": F.col("y") + F.col("h")})
    g = _with_held(boxes, points, "x", "y", "x1", "y1").drop("x1", "y1").withColumns({
        "left": F.col("bx0") - F.col("x"), "top": F.col("by0") - F.col("y"), "right": F.col("x") + F.col("w") - F.col("bx1") - 1, "bottom": F.col("y") + F.col("h") - F.col("by1") - 1,
        "short": F.greatest(F.lit(1), F.least("w", "h")),
    })
    g = g.withColumn("margin", F.least("left", "top", "right", "bottom")).withColumn("risky", F.greatest(F.lit(4), half_even(F.col("short") * 0.06)))
    g = g.withColumn("tight", F.greatest(F.col("risky") + 3, half_even(F.col("short") * 0.12)))
    g = cut(g, "margins")  # else every use of its columns works them out anew
    edges = {"left": F.col("x") <= 0, "top": F.col("y") <= 0, "right": F.col("x") + F.col("w") >= width, "bottom": F.col("y") + F.col("h") >= height}
    limited = F.lit(False)
    for side, at_edge in edges.items():
        limited = limited | ((F.col(side) == F.col("margin")) & at_edge)
    free = F.least(*[F.when(~at_edge, F.col(side)) for side, at_edge in edges.items()])
    status = (
        F.when(F.col("n").isNull(), "empty").when(limited & F.coalesce(free > F.col("tight"), F.lit(False)), "safe")
        .when(F.col("margin") <= F.col("risky"), "risky").when(F.col("margin") <= F.col("tight"), "tight").otherwise("safe")
    )
    zero = lambda c: F.coalesce(F.col(c), F.lit(0)).cast("long")
    return g.select(
        *groups.columns, status.alias("status"), thousandths(zero("n") / F.greatest(F.lit(1), F.col("w") * F.col("h")) * 100).alias("mask_coverage_pct"),
        zero("margin").alias("min_margin_px"), *[zero(c).alias(f"margin_{c}_px") for c in edges], thousandths(zero("margin") / F.col("short")).alias("margin_ratio"),
    )


def relax_crops(summaries: DataFrame, width: int, height: int, *carried: str) -> DataFrame:
    """Crops that are not safe grown to the margin that their status asks for, within the frame; with the carried columns."""
    short = F.greatest(F.lit(1), F.least("w", "h"))
    target = F.when(F.col("status") == "empty", F.greatest(F.lit(12), half_even(short * 0.18))).when(F.col("status") == "risky", F.greatest(F.lit(10), half_even(short * 0.16)))
    grown = summaries.withColumn("target", target.otherwise(F.greatest(F.lit(8), half_even(short * 0.12))))
    more = lambda side: F.greatest(F.lit(0), F.col("target") - F.col(f"margin_{side}_px"))
    grown = grown.withColumns({
        "x0": F.greatest(F.lit(0), F.col("x") - more("left")), "y0": F.greatest(F.lit(0), F.col("y") - more("top")),
        "x1": F.least(F.lit(width), F.col("x") + F.col("w") + more("right")), "y1": F.least(F.lit(height), F.col("y") + F.col("h") + more("bottom")),
    })
    keep = (F.col("status") == "safe") | (F.col("x1") <= F.col("x0")) | (F.col("y1") <= F.col("y0"))
    pick = lambda old, new: F.when(keep, F.col(old)).otherwise(new).cast("long").alias(old)
    return grown.select("image_id", "index", pick("x", F.col("x0")), pick("y", F.col("y0")), pick("w", F.col("x1") - F.col("x0")), pick("h", F.col("y1") - F.col("y0")), "status", *carried)


def tighten(regions: DataFrame, points: DataFrame, width: int, height: int) -> DataFrame:
    """Regions shrunk to the pixels of the mask (points or runs, see _with_held) in and near them, with a padding that depends on how full they
    are; regions without points are only clipped to the frame."""
    r = regions.withColumns({"x": F.greatest(F.lit(0), F.col("x")), "y": F.greatest(F.lit(0), F.col("y")), "w": F.greatest(F.lit(1), F.col("w")), "h": F.greatest(F.lit(1), F.col("h"))})
    r = r.withColumns({"x1": F.least(F.lit(width), F.col("x") + F.col("w")), "y1": F.least(F.lit(height), F.col("y") + F.col("h"))})
    around_x, around_y = clamp(half_even(F.col("w") * 0.10), 6, 24), clamp(half_even(F.col("h") * 0.18), 6, 18)
    r = r.withColumns({
        "sx0": F.greatest(F.lit(0), F.col("x") - around_x), "sy0": F.greatest(F.lit(0), F.col("y") - around_y),
        "sx1": F.least(F.lit(width), F.col("x1") + around_x), "sy1": F.least(F.lit(height), F.col("y1") + around_y),
    })
    r = cut(_with_held(r, points, "sx0", "sy0", "sx1", "sy1"), "held")
    share = F.col("n") / F.greatest(F.lit(1), (F.col("sx1") - F.col("sx0")) * (F.col("sy1") - F.col("sy0")))
    band = lambda a, b, c: F.when(share <= 0.02, a).when(share <= 0.05, b).otherwise(c)
    bw, bh = F.col("bx1") - F.col("bx0") + 1, F.col("by1") - F.col("by0") + 1
    pad_x = F.least(band(14, 18, 24), F.greatest(F.lit(4), half_even(bw * band(0.16, 0.20, 0.24))))
    pad_y = F.least(band(10, 12, 16), F.greatest(F.lit(3), half_even(bh * band(0.22, 0.26, 0.32))))
    tx0, ty0 = F.greatest(F.col("sx0"), F.col("bx0") - pad_x), F.greatest(F.col("sy0"), F.col("by0") - pad_y)
    tx1, ty1 = F.least(F.col("sx1"), F.col("bx1") + 1 + pad_x), F.least(F.col("sy1"), F.col("by1") + 1 + pad_y)
    outside = (F.col("x1") <= F.col("x")) | (F.col("y1") <= F.col("y"))
    pick = lambda name, clipped, new: F.when(outside, F.col(name)).when(F.col("n").isNull(), clipped).otherwise(new).cast("long").alias(name)
    return r.select("image_id", "ord", pick("x", F.col("x"), tx0), pick("y", F.col("y"), ty0), pick("w", F.col("x1") - F.col("x"), F.greatest(F.lit(1), tx1 - tx0)), pick("h", F.col("y1") - F.col("y"), F.greatest(F.lit(1), ty1 - ty0)))
