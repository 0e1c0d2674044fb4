"""Work inside regions of frames: cutting them out, pasting their masks, moving them to the strokes that they hold, resizing, and
blending processed crops back in.

A region that is cut out is an image of its own, of its own size; its number (crop) stands for it, so rules for images serve
crops, too, and the crops of a frame spread over tasks.
"""

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.boxes import clamp, half_even
from ..sources.shared import by_image, by_merge, cut
from .edges import byte
from .geometry import XYWH
from .masks import recentre
from .raster import box_sums, dilate, integral, merge_last, rectangle_masks, signal
from .strokes import blur, frame_candidate, grid, refined_mask

AT = ["image_id", "y", "x"]
# A region's signal must reach this, and the region this size, for a window to be looked for; the window's least
# sides, their shares of the region, the step between windows, and what a pixel off the centre costs.
LEAST_SIGNAL, LEAST_WIDE, LEAST_HIGH = 0.12, 120, 48
WINDOW_WIDE, WINDOW_HIGH, SHARE_WIDE, SHARE_HIGH, STEP, PULL_X, PULL_Y = 96, 42, 0.72, 0.62, 2, 0.03, 0.05


def number(regions: DataFrame) -> DataFrame:
    """regions with crop, a number of its own for each, written so that it stays."""
    return cut(regions.withColumn("crop", F.monotonically_increasing_id()), "crops")


def cut_out(pixels: DataFrame, regions: DataFrame, *carried: str) -> DataFrame:
    """The pixels of numbered regions; image_id is the crop's number, y and x count from the region's corner.  With the carried
    columns of the regions."""
    inside = F.expr("p.image_id = r.image_id AND p.x >= r.x AND p.x < r.x + r.w AND p.y >= r.y AND p.y < r.y + r.h")
    values = [F.col(f"p.{c}") for c in pixels.columns if c not in AT] + [F.col(f"r.{c}") for c in carried]
    p, r = by_image(pixels, regions)
    return by_merge(p).alias("p").join(r.alias("r"), inside).select(F.col("r.crop").alias("image_id"), (F.col("p.y") - F.col("r.y")).alias("y"), (F.col("p.x") - F.col("r.x")).alias("x"), *values)


def draw_masks(regions: DataFrame, width: int, height: int, padding: int, spread: int, rgb: DataFrame | None = None) -> DataFrame:
    """regions(image_id, ord, x, y, w, h) -> image_id, y, x, v: the mask of each frame that has regions: they are padded,
    drawn one after the other and spread.  With rgb the refined_mask() of each padded region is pasted in place of its
    rectangle; a later region takes the pixels of earlier ones, unset ones too."""
    x0, y0 = F.greatest(F.lit(0), F.col("x") - padding), F.greatest(F.lit(0), F.col("y") - padding)
    wide = F.least(F.lit(width), F.col("x") + F.col("w") + padding) - x0
    high = F.least(F.lit(height), F.col("y") + F.col("h") + padding) - y0
    boxes = regions.select("image_id", "ord", x0.alias("x"), y0.alias("y"), wide.alias("w"), high.alias("h")).filter("w > 0 AND h > 0")
    if rgb is None:
        drawn = rectangle_masks(boxes, width, height).select(*AT, F.lit(1).cast("long").alias("ord"), F.lit(255).cast("long").alias("v"))
    else:
        boxes = number(boxes).withColumns({"frame": F.col("image_id"), "x0": F.col("x"), "y0": F.col("y")})
        told = ("frame", "ord", "x0", "y0")
        mask = refined_mask(cut(cut_out(rgb, boxes, *told), "cut-out"), width, carried=told)
        drawn = cut(mask.select(F.col("frame").alias("image_id"), (F.col("y") + F.col("y0")).alias("y"), (F.col("x") + F.col("x0")).alias("x"), "ord", "v"), "drawn")
    frames = grid(regions.select("image_id").distinct(), width, height)
    layers = frames.select(*[F.col(c).cast("long").alias(c) for c in AT], F.lit(None).cast("long").alias("ord"), F.lit(None).cast("long").alias("v")).unionByName(drawn)
    whole = merge_last(by_image(layers)).withColumn("v", F.coalesce("v", F.lit(0)).cast("long"))
    within = F.col("x").between(0, width - 1) & F.col("y").between(0, height - 1)
    return dilate(whole.filter(within), spread)


def best_signal(signals: DataFrame, patches: DataFrame, least: float = LEAST_SIGNAL, sides=(LEAST_WIDE, LEAST_HIGH), windows=(WINDOW_WIDE, WINDOW_HIGH)) -> DataFrame:
    """patches(image_id, w, h), signals(image_id, y, x, s) -> image_id, x, y, w, h: in each patch the padded window with the
    largest sum of the signal less its distance from the centre, the first by (y, x) of equals; the whole patch where the
    signal is weak, the patch small, or the window as large as the patch."""
    size = lambda c, share, floor: F.least(F.col(c), F.greatest(F.lit(floor), half_even(F.col(c) * share)))
    top = signals.groupBy("image_id").agg(F.max("s").alias("top"))
    p = patches.join(top, "image_id", "left").withColumns({"ww": size("w", SHARE_WIDE, windows[0]), "wh": size("h", SHARE_HIGH, windows[1])})
    fits = (F.col("top") >= least) & (F.col("w") >= sides[0]) & (F.col("h") >= sides[1]) & (F.col("ww") < F.col("w")) & (F.col("wh") < F.col("h"))
    p = cut(p.withColumn("fits", F.coalesce(fits, F.lit(False))), "patches")
    starts = lambda c, t: F.explode(F.sequence(F.lit(0).cast("long"), F.col(c) - F.col(t), F.lit(STEP).cast("long")))
    boxes = p.filter("fits").withColumn("y0", starts("h", "wh")).withColumn("x0", starts("w", "ww"))
    boxes = boxes.withColumns({"x1": F.col("x0") + F.col("ww"), "y1": F.col("y0") + F.col("wh")})
    sums = integral(signals.join(p.filter("fits").select("image_id"), "image_id", "left_semi").select(*AT, F.col("s").alias("v")))
    away = lambda c, t, side, pull: F.abs(F.col(c) + F.col(t) / 2 - F.col(side) / 2) * pull
    scored = box_sums(cut(sums, "sums"), boxes).withColumn("score", F.round(F.col("total") - away("x0", "ww", "w", PULL_X) - away("y0", "wh", "h", PULL_Y), 6))
    best = scored.groupBy("image_id").agg(F.max(F.struct("score", (-F.col("y0")).alias("y"), (-F.col("x0")).alias("x"))).alias("b")).select("image_id", (-F.col("b.x")).alias("bx"), (-F.col("b.y")).alias("by"))
    p = p.join(best, "image_id", "left")
    pad = lambda c, share: F.greatest(F.lit(4), half_even(F.col(c) * share))
    x0, y0 = F.greatest(F.lit(0), F.col("bx") - pad("w", 0.04)), F.greatest(F.lit(0), F.col("by") - pad("h", 0.06))
    x1, y1 = F.least(F.col("w"), F.col("bx") + F.col("ww") + pad("w", 0.04)), F.least(F.col("h"), F.col("by") + F.col("wh") + pad("h", 0.06))
    pick = lambda new, old: F.when(F.col("fits"), new).otherwise(old).cast("long")
    return p.select("image_id", pick(x0, F.lit(0)).alias("x"), pick(y0, F.lit(0)).alias("y"), pick(x1 - x0, F.col("w")).alias("w"), pick(y1 - y0, F.col("h")).alias("h"))


def tighten_to_strokes(rgb: DataFrame, regions: DataFrame, width: int, height: int) -> DataFrame:
    """regions(image_id, ord, x, y, w, h) of frames rgb(image_id, y, x, r, g, b; 0 to 255), each moved to what it holds: around
    its strokes, if they are a fair share of it, else to the window with the best signal.  Regions outside the frame stay."""
    clipped = regions.withColumns({"rx": F.greatest(F.lit(0), F.col("x")), "ry": F.greatest(F.lit(0), F.col("y"))})
    clipped = clipped.withColumns({"rw": F.least(F.lit(width), F.col("rx") + F.greatest(F.lit(1), F.col("w"))) - F.col("rx"), "rh": F.least(F.lit(height), F.col("ry") + F.greatest(F.lit(1), F.col("h"))) - F.col("ry")})
    inside = number(clipped.filter("rw > 0 AND rh > 0").select("image_id", "ord", *[F.col(f"r{c}").alias(c) for c in XYWH]))
    crops = cut(cut_out(rgb, inside), "cut-out")
    patches = inside.select(F.col("crop").alias("image_id"), F.lit(0).cast("long").alias("x"), F.lit(0).cast("long").alias("y"), "w", "h")
    strokes = cut(frame_candidate(crops, width), "strokes")
    fair = strokes.groupBy("image_id").agg(F.avg((F.col("v") > 0).cast("double")).between(0.002, 0.16).alias("fair")).filter("fair").select("image_id")
    around = recentre(patches.join(fair, "image_id", "left_semi"), strokes).drop("moved")
    tones = signal(crops.select(*AT, *[(F.col(c) / 255.0).alias(c) for c in "rgb"]))
    rest = patches.join(fair, "image_id", "left_anti").select("image_id", "w", "h")
    moved = around.select("image_id", *XYWH).unionByName(best_signal(tones.join(rest.select("image_id"), "image_id", "left_semi"), rest))
    moved = moved.select(F.col("image_id").alias("crop"), *[F.col(c).alias(f"n{c}") for c in XYWH])
    new = inside.join(moved, "crop").select("image_id", "ord", (F.col("x") + F.col("nx")).alias("x"), (F.col("y") + F.col("ny")).alias("y"), F.col("nw").alias("w"), F.col("nh").alias("h"))
    return new.unionByName(clipped.filter("rw <= 0 OR rh <= 0").select("image_id", "ord", *XYWH))


def _cubic(x: Column) -> Column:
    """Weight at a distance of x samples; the curve's parameter is -1/2."""
    x = F.abs(x)
    return F.when(x < 1, (x * 1.5 - 2.5) * x * x + 1).when(x < 2, (((x - 5) * x + 8) * x - 4) * -0.5).otherwise(0.0)


def _taps(sizes: DataFrame, have: str, want: str) -> DataFrame:
    """image_id, i, k, weight: of each sample i that is wanted the samples k that make it; weights add up to 1."""
    ratio = F.col(have) / F.col(want)
    wider, center = F.greatest(ratio, F.lit(1.0)), (F.col("i") + 0.5) * ratio
    low = F.greatest(F.lit(0), F.floor(center - wider * 2 + 0.5))
    high = F.least(F.col(have), F.floor(center + wider * 2 + 0.5))
    rows = sizes.select("*", F.explode(F.sequence(F.lit(0).cast("long"), F.col(want) - 1)).alias("i"))
    rows = rows.select("*", F.sequence(low, high - 1).alias("ks"), wider.alias("wider"), center.alias("center"))
    weigh = lambda k: _cubic((k - F.col("center") + 0.5) / F.col("wider"))
    rows = rows.withColumn("total", F.aggregate("ks", F.lit(0.0), lambda acc, k: acc + weigh(k)))
    return by_merge(rows.select("image_id", "i", F.explode("ks").alias("k"), "wider", "center", "total").select("image_id", "i", "k", (weigh(F.col("k")) / F.col("total")).alias("weight")))


def resize(pixels: DataFrame, sizes: DataFrame) -> DataFrame:
    """pixels(image_id, y, x, v), sizes(image_id, w, h) -> the images in these sizes by bicubic weights, columns first, rounded
    to 8 bits after either; a smaller image weighs all that its pixels cover."""
    have = pixels.groupBy("image_id").agg((F.max("x") + 1).alias("hw"), (F.max("y") + 1).alias("hh")).join(sizes.select("image_id", F.col("w").cast("long").alias("w"), F.col("h").cast("long").alias("h")), "image_id")
    across, down = _taps(have, "hw", "w"), _taps(have, "hh", "h")
    made = lambda df, key, other: df.groupBy("image_id", F.col(other), F.col("i").alias(key)).agg(byte(F.sum(F.col("v") * F.col("weight"))).alias("v"))
    rows = made(pixels.withColumnRenamed("x", "k").join(across, ["image_id", "k"]), "x", "y")
    return made(rows.withColumnRenamed("y", "k").join(down, ["image_id", "k"]), "y", "x").select(*AT, "v")


def compose(base: DataFrame, crops: DataFrame, processed: DataFrame, masks: DataFrame, feather: float) -> DataFrame:
    """base(image_id, y, x, v), crops(crop, image_id, index, x, y, w, h), processed and masks(image_id: the crop, y, x, v) -> base
    with each crop blended in under its mask, blurred by feather, in the order of index, each on what those before it left.
    Processed crops of another size are resized."""
    sized = processed.groupBy("image_id").agg((F.max("x") + 1).alias("pw"), (F.max("y") + 1).alias("ph")).join(crops.select(F.col("crop").alias("image_id"), "w", "h"), "image_id")
    other = sized.filter("pw <> w OR ph <> h").select("image_id", "w", "h")
    fitting = processed.join(other, "image_id", "left_anti").select(*AT, F.col("v").cast("long").alias("v"))
    every = fitting.unionByName(resize(processed.join(other, "image_id", "left_semi"), other))
    soft = blur(masks, feather) if feather > 0 else masks
    layers = every.join(by_merge(soft.select(*AT, byte(F.col("v")).alias("alpha"))), AT).withColumnRenamed("image_id", "crop")
    layers = layers.join(crops.select("crop", "image_id", "index", F.col("x").alias("x0"), F.col("y").alias("y0")), "crop")
    entry = F.struct("index", "crop", "v", "alpha")
    laid = layers.groupBy("image_id", (F.col("y") + F.col("y0")).alias("y"), (F.col("x") + F.col("x0")).alias("x")).agg(F.sort_array(F.collect_list(entry)).alias("cs"))
    blend = lambda acc, c: clamp(half_even((c["v"] * c["alpha"] + acc * (255 - c["alpha"])) / 255), 0, 255)
    value = F.aggregate("cs", F.col("v").cast("long"), blend)
    return base.join(by_merge(laid), AT, "left").select(*AT, F.when(F.col("cs").isNull(), F.col("v").cast("long")).otherwise(value).alias("v"))
