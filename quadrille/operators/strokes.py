"""Finding strokes of overlaid text: colour channels, blurs, morphology, support bands, and what templates are compared on.

Images are pixel relations, so a blur is a weighted sum over a moving row and a moving column of one image.  Edges of blurs
weigh what there is; image libraries mirror the edge instead, so values within a blur's radius of it can differ slightly from
theirs.
"""

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.boxes import half_even
from ..sources.shared import by_image, by_merge, cut
from .edges import byte, canny, traced
from .raster import SOLID, _moving, close_gaps, dilate, histogram, otsu, text_like, with_component


def channels(rgb: DataFrame, *carried: str) -> DataFrame:
    """rgb(image_id, y, x, r, g, b; 0 to 255) -> image_id, y, x, value, saturation, gray, whiteness.  With the carried columns."""
    top, low = F.greatest("r", "g", "b"), F.least("r", "g", "b")
    saturation = F.when(top > 0, half_even((top - low) * 255 / top)).otherwise(0)
    gray = half_even(F.col("r") * 0.299 + F.col("g") * 0.587 + F.col("b") * 0.114)
    plain = rgb.select("image_id", "y", "x", top.cast("long").alias("value"), saturation.cast("long").alias("saturation"), gray.alias("gray"), *carried)
    return plain.withColumn("whiteness", F.floor(F.col("value") * (255 - F.col("saturation")) / 255).cast("long"))


def gauss(sigma: float) -> list[float]:
    """Weights of distances 0, 1, ... up to three sigma."""
    radius = max(1, int(3 * sigma + 0.5))
    return [math.exp(-(k * k) / (2 * sigma * sigma)) for k in range(radius + 1)]


def _smooth(pixels: DataFrame, columns: tuple[str, ...], window, weights: list[float]) -> DataFrame:
    """pixels with columns smoothed along the window.  Neighbours are columns first: written into both sums, each would be looked up
    twice."""
    name = lambda c, k: f"{c}_{k}" if k else c
    reach = range(-len(weights) + 1, len(weights))
    beside = pixels.withColumns({name(c, k): F.lag(c, -k).over(window) for c in columns for k in reach if k})

    def mean(c: str) -> Column:
        total, mass = F.lit(0.0), F.lit(0.0)
        for k in reach:
            near = F.col(name(c, k))
            total = total + F.coalesce(near * weights[abs(k)], F.lit(0.0))
            mass = mass + F.when(near.isNotNull(), weights[abs(k)]).otherwise(0.0)
        return total / mass

    return beside.select(*[mean(c).alias(c) if c in columns else F.col(c) for c in pixels.columns])


def blur(pixels: DataFrame, sigma: float, *columns: str) -> DataFrame:
    """pixels with column v, or those named, blurred, rows first."""
    weights, columns = gauss(sigma), columns or ("v",)
    across = Window.partitionBy("image_id", "y").orderBy("x")
    down = Window.partitionBy("image_id", "x").orderBy("y")
    rows = _smooth(pixels.withColumns({c: F.col(c).cast("double") for c in columns}), columns, across, weights)
    return _smooth(rows, columns, down, weights)


def top_hat(pixels: DataFrame, radius: int) -> DataFrame:
    """What an opening takes away: bright details narrower than a square of 2 * radius + 1."""
    opened = by_merge(_moving(_moving(pixels, radius, F.min), radius, F.max).withColumnRenamed("v", "o"))
    return pixels.join(opened.select("image_id", "y", "x", "o"), ["image_id", "y", "x"]).withColumn("v", F.col("v") - F.col("o")).drop("o")


def detail(gray: DataFrame, sigma: float, own: float, *carried: str) -> DataFrame:
    """gray(image_id, y, x, v: 0 to 255, and the carried columns) sharpened: own times itself less (own - 1) times its blur, as
    8-bit pixels, which lie in parts by image."""
    soft = blur(by_image(gray).withColumn("soft", F.col("v")), sigma, "soft")
    return soft.select("image_id", "y", "x", *carried, byte(F.col("v") * own - byte(F.col("soft")) * (own - 1)).alias("v"))


def match_surface(rgb: DataFrame, side: int) -> DataFrame:
    """image_id, y, x, v: whiteness with some detail and edges, what templates are compared on; 8-bit pixels.  Pixels are
    shuffled once and carry what they are made of; none is joined."""
    at = ["image_id", "y", "x"]
    sharp = detail(channels(rgb).select(*at, F.col("gray").alias("v"), "whiteness"), 3.0, 1.8, "whiteness")
    both = traced(sharp.withColumn("sharp", F.col("v")), 40, 120, side, "whiteness", "sharp")
    surface = byte(F.col("whiteness") * 0.75 + F.col("sharp") * 0.2)
    return both.select(*at, byte(surface * 0.9 + F.col("v") * 0.1).alias("v"))


def soft_box(width, height, x0, y0, x1, y1, sigma: float) -> Column:
    """Whether the pixel (x, y) is set in a rectangle whose ends belong to it, blurred and cut at SOLID; sides and ends are
    numbers or columns.  The blur of a rectangle is a product of one for its columns and one for its rows; beyond the frame its
    edge goes on."""
    weights = gauss(sigma)

    def part(axis: str, low, high, size) -> Column:
        reach, last = range(-len(weights) + 1, len(weights)), size - 1 if isinstance(size, Column) else F.lit(size - 1)
        near = [F.when(F.greatest(F.lit(0), F.least(last, F.col(axis) + k)).between(low, high), weights[abs(k)]).otherwise(0.0) for k in reach]
        return sum(near[1:], near[0]) / sum(weights[abs(k)] for k in reach)

    return F.round(part("x", x0, x1, width) * part("y", y0, y1, height) * 255, 6) >= SOLID


def grid(images: DataFrame, width: int, height: int) -> DataFrame:
    upto = lambda n: F.explode(F.sequence(F.lit(0).cast("long"), F.lit(n - 1).cast("long")))
    return by_merge(images.select("image_id", upto(height).alias("y")).select("image_id", "y", upto(width).alias("x")))


def within(pixels: DataFrame, width: int, height: int) -> DataFrame:
    return pixels.filter(F.col("x").between(0, width - 1) & F.col("y").between(0, height - 1))


def own_band() -> Column:
    """wide_band() of images of any sizes, of columns wide and high."""
    w, h = F.col("wide"), F.col("high")
    part = lambda size, share: F.floor(size * share)
    box = soft_box(w, h, part(w, 0.04), part(h, 0.30), F.least(w, part(w, 0.96)), F.least(h, part(h, 0.72)), 1.0)
    return F.when(box, 255).otherwise(0).cast("long")


# What the bands hold of the pixel (x, y), 255 or 0: it depends on nothing else, so rules read them as columns of their pixels
# and join no mask.


def _band(width: int, height: int, x0: int, y0: int, x1: int, y1: int, sigma: float) -> Column:
    return F.when(soft_box(width, height, x0, y0, x1, y1, sigma), 255).otherwise(0).cast("long")


def in_wide_band(width: int, height: int) -> Column:
    return _band(width, height, int(width * 0.04), int(height * 0.30), min(width, int(width * 0.96)), min(height, int(height * 0.72)), 1.0)


def in_text_band(width: int, height: int) -> Column:
    return _band(width, height, int(width * 0.10), int(height * 0.36), int(width * 0.90), int(height * 0.64), 1.2)


def in_text_core(width: int, height: int) -> Column:
    tall = max(10, round(height * 0.18))
    top = max(0, round((height - tall) / 2))
    return _band(width, height, int(width * 0.18), top, int(width * 0.82), min(height, top + tall), 0.8)


def spread(images: DataFrame) -> DataFrame:
    """images in as many parts as are set: they are so few bytes that Spark would merge them into one task, which then makes all
    their pixels."""
    return images.repartition(int(images.sparkSession.conf.get("spark.sql.shuffle.partitions")))


def wide_band(images: DataFrame, width: int, height: int) -> DataFrame:
    """Where a line of text can be."""
    return grid(spread(images), width, height).withColumn("v", in_wide_band(width, height))


def text_band(images: DataFrame, width: int, height: int) -> DataFrame:
    """Where a line of text usually is."""
    return grid(spread(images), width, height).withColumn("v", in_text_band(width, height))


def text_core(images: DataFrame, width: int, height: int) -> DataFrame:
    """The middle of a line of text."""
    return grid(spread(images), width, height).withColumn("v", in_text_core(width, height))


def sized(pixels: DataFrame) -> DataFrame:
    """pixels with wide and high, how large the dense raster of each is."""
    whole = Window.partitionBy("image_id")
    return pixels.withColumns({"wide": F.max("x").over(whole) + 1, "high": F.max("y").over(whole) + 1})


def keep_text_like(mask: DataFrame, side: int, width: int | None = None, height: int | None = None) -> DataFrame:
    """The mask without components that cannot be strokes of letters in a frame of this size, or of each image's own; it lies in
    parts by image."""
    rows = by_image(mask.select("image_id", "y", "x", "v"))
    like = with_component(rows if width else sized(rows), "v", side).withColumn("v", F.when(text_like(width or "wide", height or "high"), 255).otherwise(0).cast("long"))
    return by_image(cut(like.select("image_id", "y", "x", "v"), "text-like"))


def frame_candidate(rgb: DataFrame, side: int, width: int | None = None, height: int | None = None, sigma: float = 6.0) -> DataFrame:
    """image_id, y, x, v: bright, hardly coloured pixels above their surroundings, as far as they are like text, opened by a
    square of two pixels."""
    c = channels(rgb)
    soft = blur(c.withColumn("soft", F.col("gray")), sigma, "soft")
    on = (F.col("value") >= 138) & (F.col("saturation") <= 75) & (F.round(F.col("gray") - F.col("soft"), 6) >= 10)
    mask = soft.select("image_id", "y", "x", F.when(on, 255).otherwise(0).cast("long").alias("v"))
    return open_two(keep_text_like(mask, side, width, height))


def open_two(mask: DataFrame) -> DataFrame:
    """Opening by a square of two pixels: the least of each pixel and those before it, then the largest of those after."""
    across, down = Window.partitionBy("image_id", "y").orderBy("x"), Window.partitionBy("image_id", "x").orderBy("y")
    least = mask.withColumn("v", F.min("v").over(across.rowsBetween(-1, 0))).withColumn("v", F.min("v").over(down.rowsBetween(-1, 0)))
    return least.withColumn("v", F.max("v").over(across.rowsBetween(0, 1))).withColumn("v", F.max("v").over(down.rowsBetween(0, 1)))


def thickened(mask: DataFrame, *columns: str) -> DataFrame:
    """The mask, or masks of so many columns, grown by a pixel, blurred a little and cut at a low value: corners are rounded."""
    columns = columns or ("v",)
    across, down = Window.partitionBy("image_id", "y").orderBy("x").rowsBetween(-1, 1), Window.partitionBy("image_id", "x").orderBy("y").rowsBetween(-1, 1)
    for window in (down, across):  # rows last, as the blur goes on with them
        mask = mask.withColumns({c: F.max(c).over(window) for c in columns})
    mask = blur(mask, 0.8, *columns)
    return mask.withColumns({c: F.when(F.round(c, 6) >= SOLID, 255).otherwise(0).cast("long") for c in columns})


def refined_mask(rgb: DataFrame, side: int, width: int | None = None, height: int | None = None, low: float = 0.003, high: float = 0.18, carried: tuple[str, ...] = ()) -> DataFrame:
    """image_id, y, x, v: strokes in the band where text can be, by cutoffs that follow each image's own brightness.  With
    too few strokes the brighter part of the band stands in, then any strokes, then the band.  With the carried columns.  What is
    told of a pixel and of its image are columns, so pixels are shuffled twice and joined with nothing."""
    at, whole = ["image_id", "y", "x"], Window.partitionBy("image_id")
    across, down = Window.partitionBy("image_id", "y").orderBy("x").rowsBetween(-2, 2), Window.partitionBy("image_id", "x").orderBy("y").rowsBetween(-2, 2)
    c = by_image(channels(rgb, *carried)).withColumn("opened", F.min("gray").over(across))
    for pick, window in ((F.min, down), (F.max, down), (F.max, across)):
        c = c.withColumn("opened", pick("opened").over(window))
    bright, calm = F.greatest(F.lit(128.0), F.percentile("value", 0.62).over(whole)), F.least(F.lit(110.0), F.percentile("saturation", 0.58).over(whole))
    c = sized(c.withColumns({"bright": bright, "calm": calm}))
    if width:
        c = within(c, width, height)
    soft = blur(c.withColumn("soft", F.col("gray")), 6.0, "soft").withColumn("band", in_wide_band(width, height) if width else own_band())
    relaxed = (F.col("value") >= F.col("bright")) & (F.col("saturation") <= F.col("calm")) & (F.col("band") > 0)
    stroke = (F.round(F.col("gray") - F.col("soft"), 6) >= 8) | (F.col("gray") - F.col("opened") >= 10)
    mask = lambda on: F.when(on, 255).otherwise(0).cast("long")
    told = soft.select(*at, *carried, "wide", "high", mask(F.col("band") > 0).alias("band"), mask(relaxed).alias("relaxed"), mask(relaxed & stroke).alias("strict"))
    told = with_component(told, "strict", side).withColumns({"strict": mask(text_like(width or "wide", height or "high")), "loose": F.col("relaxed")})
    layers = thickened(by_image(cut(told.select(*at, *carried, "band", "loose", "relaxed", "strict"), "strokes")), "strict", "relaxed")
    share = lambda on: F.avg(on.cast("double")).over(whole)
    layers = layers.withColumns({"own": share(F.col("strict") == 255), "loose": share(F.col("loose") > 0)})
    value = (
        F.when(F.col("own").between(low, min(high, 0.085)), F.col("strict")).when((F.col("own") < low) & F.col("loose").between(low, min(high, 0.12)), F.col("relaxed"))
        .when(F.col("own") > 0, F.col("strict")).otherwise(F.col("band"))
    )
    return layers.select(*at, value.alias("v"), *carried)


def fuse(steady: DataFrame, model: DataFrame, radius: int = 1) -> DataFrame:
    """image_id, y, x, v: a mask seen in many frames and what a model's mask has near it."""
    near = by_merge(dilate(steady, radius).withColumnRenamed("v", "near"))
    both = steady.join(near, ["image_id", "y", "x"]).join(by_merge(model.withColumnRenamed("v", "m")), ["image_id", "y", "x"], "left")
    return both.select("image_id", "y", "x", F.greatest("v", F.when(F.col("near") > 0, F.coalesce("m", F.lit(0))).otherwise(0)).alias("v"))


def template_mask(rgb: DataFrame, side: int) -> DataFrame:
    """image_id, y, x, v: where a template is worth comparing: its edges and what Otsu's cutoff finds bright, thickened and
    closed.  If that is hardly anything or nearly all of it, the edges of the unsharpened image alone; templates where these
    don't fit either have no mask."""
    c = channels(rgb)
    gray = c.select("image_id", "y", "x", F.col("gray").alias("v"))
    at = ["image_id", "y", "x"]
    cutoffs = otsu(histogram(c.select("image_id", F.col("whiteness").alias("v")))).select("image_id", "cutoff")
    strong = by_merge(canny(cut(detail(gray, 2.2, 1.9), "detail"), 30, 110, side).withColumnRenamed("v", "strong"))
    weak = by_merge(canny(gray, 20, 90, side).withColumnRenamed("v", "weak"))
    marks = cut(c.select(*at, "whiteness").join(strong, at).join(weak, at).join(by_merge(cutoffs), "image_id"), "marks")
    mask = lambda on: F.when(on, 255).otherwise(0).cast("long")
    both = by_image(marks.select(*at, mask((F.col("strong") > 0) | (F.col("whiteness") > F.col("cutoff"))).alias("v"), mask(F.col("weak") > 0).alias("w")))
    both = cut(close_gaps(_moving(_moving(both, 1, F.max, "w"), 1, F.max), 1), "masks")
    share = lambda n: F.avg((F.col(n) > 0).cast("double"))
    told = both.groupBy("image_id").agg(share("v").between(0.015, 0.42).alias("fits"), share("w").between(0.01, 0.45).alias("weak_fits")).filter("fits OR weak_fits")
    return both.join(by_merge(told), "image_id").select(*at, F.when(F.col("fits"), F.col("v")).otherwise(F.col("w")).cast("long").alias("v"))
