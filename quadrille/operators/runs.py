"""Masks as runs: runs(image_id, y, x0, x1), the set pixels of a row from x0 up to x1, which does not belong to them.

A mask of a large frame is a few runs a row, and every rule works on their ends: spreading widens and repeats them, components
tie runs that touch, projections are sums of their lengths.  Frames are cut into strips of rows, so that one frame spreads over
many tasks; what strips share at their borders is joined afterwards.
"""

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..sources.shared import by_merge, cut
from .graph import components
from .raster import least_of_tied

RUN = ["image_id", "y", "x0", "x1"]
#: Rows of a strip.
STRIP = 128


def to_runs(pixels: DataFrame) -> DataFrame:
    """The runs of pixels(image_id, y, x, v) over 0; unset pixels may be missing."""
    on = pixels.filter("v > 0").select("image_id", "y", "x")
    row = Window.partitionBy("image_id", "y").orderBy("x")
    islands = on.withColumn("island", F.col("x") - F.row_number().over(row))
    return islands.groupBy("image_id", "y", "island").agg(F.min("x").alias("x0"), (F.max("x") + 1).alias("x1")).select(*RUN)


def to_pixels(runs: DataFrame) -> DataFrame:
    """image_id, y, x, v: the set pixels."""
    return by_merge(runs.select("image_id", "y", F.explode(F.sequence("x0", F.col("x1") - 1)).alias("x"), F.lit(255).cast("long").alias("v")))


def merge(runs: DataFrame) -> DataFrame:
    """Runs of a row that overlap or meet become one."""
    row = Window.partitionBy("image_id", "y").orderBy("x0", "x1")
    before = F.max("x1").over(row.rowsBetween(Window.unboundedPreceding, -1))
    fresh = runs.select(*RUN, F.when(F.col("x0") <= before, 0).otherwise(1).alias("fresh"))
    named = fresh.withColumn("n", F.sum("fresh").over(row.rowsBetween(Window.unboundedPreceding, Window.currentRow)))
    return named.groupBy("image_id", "y", "n").agg(F.min("x0").alias("x0"), F.max("x1").alias("x1")).select(*RUN)


def spread(runs: DataFrame, radius, width: int, height: int) -> DataFrame:
    """Runs widened by radius, a number or a column of runs, on all four sides within the frame: what the largest value of a
    square around each pixel gives."""
    r = radius if isinstance(radius, Column) else F.lit(radius)
    ys = F.sequence(F.greatest(F.lit(0), F.col("y") - r), F.least(F.lit(height - 1), F.col("y") + r))
    wide = runs.select("image_id", F.explode(ys).alias("y"), F.greatest(F.lit(0), F.col("x0") - r).cast("long").alias("x0"), F.least(F.lit(width), F.col("x1") + r).cast("long").alias("x1"))
    return merge(wide.withColumn("y", F.col("y").cast("long")))


def rectangles(regions: DataFrame, width: int, height: int) -> DataFrame:
    """The runs that regions(image_id, x, y, w, h) draw; both ends belong to a rectangle.

    Between two neighbouring ends of an image's rectangles all rows are alike, so runs are merged once for each such slab, by a
    fold over the rectangles that it meets, and become rows last: no row of a rectangle is shuffled or sorted."""
    held = lambda v, most: F.greatest(F.lit(0), F.least(F.lit(most), v))
    one, other = held(F.col("y"), height - 1), held(F.col("y") + F.col("h"), height - 1)
    ends = {"x0": held(F.col("x"), width - 1), "x1": held(F.col("x") + F.col("w"), width - 1) + 1, "y0": F.least(one, other), "y1": F.greatest(one, other) + 1}
    box = F.struct(*[v.cast("long").alias(k) for k, v in ends.items()])
    images = regions.groupBy("image_id").agg(F.sort_array(F.collect_set(box)).alias("boxes"))
    images = images.withColumn("ys", F.array_sort(F.array_distinct(F.concat("boxes.y0", "boxes.y1"))))
    slabs = images.select("image_id", "boxes", "ys", F.posexplode("ys").alias("k", "top")).withColumn("bottom", F.get("ys", F.col("k") + 1)).filter("bottom IS NOT NULL")
    met = F.filter("boxes", lambda r: (r["y0"] <= F.col("top")) & (r["y1"] > F.col("top")))

    def step(runs: Column, r: Column) -> Column:
        last, run = F.try_element_at(runs, F.lit(-1)), F.struct(r["x0"].alias("x0"), r["x1"].alias("x1"))
        longer = F.struct(last["x0"].alias("x0"), F.greatest(last["x1"], r["x1"]).alias("x1"))
        return F.when(r["x0"] <= last["x1"], F.concat(F.slice(runs, 1, F.size(runs) - 1), F.array(longer))).otherwise(F.concat(runs, F.array(run)))

    merged = F.aggregate(met, F.array().cast("array<struct<x0:bigint,x1:bigint>>"), step)
    rows = slabs.select("image_id", "top", "bottom", F.inline(merged))
    return rows.select("image_id", F.explode(F.sequence("top", F.col("bottom") - 1)).alias("y"), "x0", "x1")


def coverage(runs: DataFrame) -> DataFrame:
    """image_id, n (set pixels) and their box x0, y0, x1, y1."""
    return runs.groupBy("image_id").agg(
        F.sum(F.col("x1") - F.col("x0")).alias("n"), F.min("x0").alias("x0"), F.min("y").alias("y0"), F.max("x1").alias("x1"), (F.max("y") + 1).alias("y1")
    )


def trim_to_projection(runs: DataFrame, width: int, height: int) -> DataFrame:
    """Runs cut to the padded box of well-filled rows and columns; images without such rows or columns stay as they are."""

    def span(hits: DataFrame, axis: str, share: float, pad: int, size: int) -> DataFrame:
        """hits(image_id, a, b, hits): how many pixels each row or column from a up to b has."""
        least = hits.groupBy("image_id").agg(F.greatest(F.lit(2), F.floor(F.max("hits") * share)).alias("least"))
        held = hits.join(least, "image_id").filter("hits >= least").groupBy("image_id").agg(F.min("a").alias("lo"), F.max("b").alias("hi"))
        return held.select("image_id", F.greatest(F.lit(0), F.col("lo") - pad).alias(f"{axis}_lo"), F.least(F.lit(size), F.col("hi") + pad).alias(f"{axis}_hi"))

    rows = runs.groupBy("image_id", "y").agg(F.sum(F.col("x1") - F.col("x0")).alias("hits")).select("image_id", F.col("y").alias("a"), (F.col("y") + 1).alias("b"), "hits")
    ends = runs.select("image_id", F.col("x0").alias("a"), F.lit(1).alias("step")).unionByName(runs.select("image_id", F.col("x1").alias("a"), F.lit(-1).alias("step")))
    along = Window.partitionBy("image_id").orderBy("a")  # over the distinct ends of an image, no more than its columns
    steps = ends.groupBy("image_id", "a").agg(F.sum("step").alias("step"))
    columns = steps.select("image_id", "a", F.lead("a").over(along).alias("b"), F.sum("step").over(along.rowsBetween(Window.unboundedPreceding, Window.currentRow)).alias("hits")).filter("b IS NOT NULL")
    y, x = span(rows, "y", 0.16, max(3, round(height * 0.08)), height), span(columns, "x", 0.08, max(6, round(width * 0.06)), width)
    boxed = runs.join(y, "image_id", "left").join(x, "image_id", "left")
    bare = F.col("y_lo").isNull() | F.col("x_lo").isNull()
    cut_ = boxed.filter(bare | F.col("y").between(F.col("y_lo"), F.col("y_hi")))
    x0, x1 = F.when(bare, F.col("x0")).otherwise(F.greatest("x0", "x_lo")), F.when(bare, F.col("x1")).otherwise(F.least(F.col("x1"), F.col("x_hi") + 1))
    return cut_.select("image_id", "y", x0.alias("x0"), x1.alias("x1")).filter("x0 < x1")


def _label_strips(side: int, strip: int):
    """Batches of strips, each with its runs: all strips of a batch are labelled at once."""

    def labelled(batch: pa.RecordBatch) -> pa.RecordBatch:
        runs, of = batch.column("runs").flatten(), np.repeat(np.arange(batch.num_rows), batch.column("runs").value_lengths().to_numpy())
        y, x0, x1 = (runs.field(c).to_numpy() for c in RUN[1:])
        row = of * (strip + 1) + y - batch.column("strip").to_numpy()[of] * strip  # none is the next of another strip's
        order = np.lexsort((x0, row))
        of, y, x0, x1, row = (v[order] for v in (of, y, x0, x1, row))
        wide = int(x1.max()) + 2
        # runs of the next row that touch are neighbours in order: from the first that ends at x0 or later to the last that begins at x1
        first = np.searchsorted(row * wide + x1, (row + 1) * wide + x0, "left")
        last = np.searchsorted(row * wide + x0, (row + 1) * wide + x1, "right")
        count = np.maximum(last - first, 0)
        above = np.repeat(np.arange(len(y)), count)
        below = np.arange(len(above)) - np.repeat(np.cumsum(count) - count, count) + np.repeat(first, count)
        label = (y * side + x0)[least_of_tied(len(y), above, below)]
        keys = [batch.column(c).take(pa.array(of)) for c in ("image_id", "strip")]
        return pa.RecordBatch.from_arrays([*keys, *map(pa.array, (y, x0, x1, label))], ["image_id", "strip", "y", "x0", "x1", "label"])

    return lambda batches: (labelled(b) for b in batches if b.num_rows)


def label(runs: DataFrame, side: int, strip: int = STRIP) -> DataFrame:
    """runs with label: the least pixel number (y * side + x) of the runs that each touches, corners included, directly or
    through others.  side is over every x.  Strips are labelled on their own, many in a batch; labels that touch across a border
    are the nodes of a graph."""
    rows = runs.select(*[F.col(c).cast("long").alias(c) for c in RUN], F.floor(F.col("y") / strip).alias("strip"))
    strips = rows.groupBy("image_id", "strip").agg(F.collect_list(F.struct("y", "x0", "x1")).alias("runs"))
    local = cut(strips.mapInArrow(_label_strips(side, strip), "image_id long, strip long, y long, x0 long, x1 long, label long"), "strip-labels")
    if not local.agg(F.max("strip")).first()[0]:  # frames of one strip have no borders
        return local.select(*RUN, "label")
    low = local.filter((F.col("y") + 1) % strip == 0).select("image_id", (F.col("y") + 1).alias("y"), F.col("x0").alias("a0"), F.col("x1").alias("a1"), F.col("label").alias("a"))
    high = local.filter(F.col("y") % strip == 0).select("image_id", "y", "x0", "x1", F.col("label").alias("b"))
    meet = low.join(high, ["image_id", "y"]).filter("a0 <= x1 AND x0 <= a1")
    node = lambda c: F.struct("image_id", F.col(c).alias("label"))
    joined = components(meet.select(node("a").alias("a"), node("b").alias("b"))).select("node.*", F.col("root.label").alias("root"))
    return local.join(joined, ["image_id", "label"], "left").select(*RUN, F.coalesce("root", "label").alias("label"))


def component_stats(labels: DataFrame) -> DataFrame:
    """image_id, label, area, x, y, w, h of each component."""
    return labels.groupBy("image_id", "label").agg(
        F.sum(F.col("x1") - F.col("x0")).alias("area"), F.min("x0").alias("x"), F.min("y").alias("y"), (F.max("x1") - F.min("x0")).alias("w"), (F.max("y") - F.min("y") + 1).alias("h")
    )
