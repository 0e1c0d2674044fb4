"""Edges of rasters: gradients, thinning along their direction, and hysteresis.

A gradient and its thinning are windows over the columns and rows of one image.  Hysteresis is reachability: pixels over the
lower cutoff stay if their component has one over the higher.  All of it follows in one stage on pixels that lie in parts by
image; columns that are carried need no join afterwards.
"""

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..sources.shared import by_image
from .raster import joined, whole_images

# Tangents of 22.5 and 67.5 degrees as fractions of 2**15, as image libraries have them; the second is the first
# and 2.
TAN_22, UNIT = 13573, 1 << 15
#: Orders of sums must not decide which side of a half a value is on.
DIGITS = 6


def byte(value: Column) -> Column:
    """value as an 8-bit pixel: rounded, halves to the even one, and held in 0 to 255."""
    return F.greatest(F.lit(0), F.least(F.lit(255), F.rint(F.round(value, DIGITS)))).cast("long")


def sobel(pixels: DataFrame, *carried: str) -> DataFrame:
    """image_id, y, x, gx, gy: weighted differences of the 3 by 3 cells around each; beyond the edge the edge counts.  With the
    carried columns."""
    down, across = Window.partitionBy("image_id", "x").orderBy("y"), Window.partitionBy("image_id", "y").orderBy("x")

    def near(c: str, k: int, w) -> Column:
        return F.coalesce(F.lag(c, -k).over(w), F.col(c))

    spread = lambda c, w: near(c, -1, w) + F.col(c) * 2 + near(c, 1, w)
    step = lambda c, w: near(c, 1, w) - near(c, -1, w)
    columns = pixels.select("image_id", "y", "x", "v", *carried).withColumns({"soft": spread("v", down), "rise": step("v", down)})
    return columns.select("image_id", "y", "x", step("soft", across).alias("gx"), spread("rise", across).alias("gy"), *carried)


def thin(gradients: DataFrame, *carried: str) -> DataFrame:
    """image_id, y, x, size, ridge: the gradient's size (sum of both parts), and whether it is larger than on both sides along
    its direction, one of four; beyond the edge it is 0.  Of equal sizes the one with the lower x, or y where the direction is
    upright, is the ridge; on a diagonal none is.  With the carried columns."""
    across, down = Window.partitionBy("image_id", "y").orderBy("x"), Window.partitionBy("image_id", "x").orderBy("y")
    sized = gradients.withColumn("size", F.abs("gx") + F.abs("gy"))
    beside = sized.withColumns({"left": F.lag("size", 1, 0).over(across), "right": F.lead("size", 1, 0).over(across)})
    around = beside.withColumns({f"{c}_{k}": f(c, 1, 0).over(down) for c in ("left", "size", "right") for k, f in (("up", F.lag), ("down", F.lead))})
    x, y, m = F.abs("gx") * TAN_22, F.abs("gy") * UNIT, F.col("size")
    level, upright = y < x, y > x + F.abs("gx") * 2 * UNIT
    against = ((F.col("gx") < 0) & (F.col("gy") >= 0)) | ((F.col("gx") >= 0) & (F.col("gy") < 0))
    ridge = (
        F.when(level, (m > F.col("left")) & (m >= F.col("right")))
        .when(upright, (m > F.col("size_up")) & (m >= F.col("size_down")))
        .when(against, (m > F.col("right_up")) & (m > F.col("left_down")))
        .otherwise((m > F.col("left_up")) & (m > F.col("right_down")))
    )
    return around.select("image_id", "y", "x", "size", ridge.alias("ridge"), *carried)


def _reached(side: int, kept: list[str]):
    """Batches of pixels that follow each other by image: those of many images are joined at once."""

    def reached(batch: pa.RecordBatch) -> np.ndarray:
        weak, strong = (batch.column(c).to_numpy(zero_copy_only=False) for c in ("weak", "strong"))
        on, label = joined(batch, weak, side)
        v = np.zeros(len(weak), np.int64)
        hit = np.zeros(len(on), bool)
        hit[label[strong[on]]] = True
        v[on[hit[label]]] = 255
        return v

    def run(batches):
        for batch in whole_images(batches):
            yield pa.RecordBatch.from_arrays([*[batch.column(c) for c in kept], pa.array(reached(batch))], [*kept, "v"])

    return run


def hysteresis(marks: DataFrame, side: int, *carried: str) -> DataFrame:
    """marks(image_id, y, x, weak, strong, and the carried columns), each image in one part -> image_id, y, x, carried, v: 255
    for weak pixels that touch a strong one, corners included, directly or through other weak ones; strong pixels are weak ones
    too.  A part's images are worked off one after the other, so what a task holds is an image."""
    kept = ["image_id", "y", "x", *carried]
    told = F.col("image_id").isNotNull() & F.col("y").isNotNull() & F.col("x").isNotNull()
    on = lambda c: F.coalesce(told & F.col(c), F.lit(False)).alias(c)
    rows = marks.select(*kept, on("weak"), on("strong")).sortWithinPartitions("image_id")
    return rows.mapInArrow(_reached(side, kept), rows.select(*kept).schema.add("v", "long"))


def traced(pixels: DataFrame, low: int, high: int, side: int, *carried: str) -> DataFrame:
    """canny() of pixels that lie in parts by image, with the carried columns; no pixel is shuffled."""
    sized = thin(sobel(pixels, *carried), *carried)
    over = lambda least: F.col("ridge") & (F.col("size") > least)
    return hysteresis(sized.select("image_id", "y", "x", *carried, over(low).alias("weak"), over(high).alias("strong")), side, *carried)


def canny(pixels: DataFrame, low: int, high: int, side: int) -> DataFrame:
    """image_id, y, x, v: 255 on edges of the integer raster pixels(image_id, y, x, v), else 0.  Ridges of the gradient above
    low belong to an edge if they reach one above high.  side: a number over every x."""
    return traced(by_image(pixels), low, high, side)
