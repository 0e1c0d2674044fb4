"""Detection of repeated marks: regions of a frame as templates, where they are found again, and growth from what was found.

A pass matches only regions that were not matched before, and only of images that still grow: what a region is found at depends
on the region and its frame alone, so earlier matches are kept in a written table and joined again.
"""

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.boxes import iou
from ..sources.shared import by_merge, cut
from .crops import cut_out, number
from .edges import byte
from .geometry import DEDUPE_IOU, XYWH, clamp_regions, dedupe, merge_matches
from .strokes import match_surface, template_mask
from .templates import cut_templates, pick_peaks, scale_masks, scale_templates, template_scores

# Scales at which a region is looked for beside its own, the least side of a template, the least score, matches a
# region, and after a match how far around it none other counts (a share of the lesser side, at least so many pixels).
SCALES, LEAST_SIDE, THRESHOLD, MOST_MATCHES = (0.92, 1.08), 8, 0.44, 20
PAD_SHARE, LEAST_PAD = 3, 6
# Passes and regions of images with so many regions or more, of those with fewer, and how many may be added there.
MANY, PASSES_OF_MANY, LIMIT_OF_MANY, LIMIT_OF_FEW, MORE_OF_FEW = 3, 3, 12, 18, 12
SEED = ["seed_x", "seed_y", "seed_w", "seed_h"]
FOUND = ["image_id", *SEED, "variant", "pick", *XYWH, "score"]


def variants(surface: DataFrame, rgb: DataFrame, seeds: DataFrame, side: int) -> DataFrame:
    """seeds(image_id, crop, x, y, w, h; crop is a number of its own) -> image_id, template, dy, dx, t, m, centred: each region
    cut out of the surface, at its own size and scaled.  template is crop * 3 + 0, 1 or 2.  m is what template_mask() finds in
    the region's colours; regions without a mask are compared as differences from their mean."""
    base = cut_templates(surface, seeds.withColumnRenamed("crop", "ord"))
    mask = template_mask(cut(cut_out(rgb, seeds), "cut-out"), side).select(F.col("image_id").alias("template"), F.col("y").alias("dy"), F.col("x").alias("dx"), (F.col("v") > 0).cast("int").alias("m"))
    cells = cut(base.join(mask, ["template", "dy", "dx"], "left"), "cells")
    sizes = [cells]
    for scale in SCALES:
        masks = scale_masks(cells.filter("m IS NOT NULL").drop("t"), scale, LEAST_SIDE)
        scaled = scale_templates(cells, scale, LEAST_SIDE).withColumn("t", byte(F.col("t")))
        sizes.append(scaled.join(masks, ["image_id", "template", "dy", "dx"], "left"))
    named = [x.select("image_id", (F.col("template") * 3 + k).alias("template"), "dy", "dx", F.col("t").cast("double").alias("t"), F.coalesce("m", F.lit(1)).alias("m"), F.col("m").isNull().alias("centred")) for k, x in enumerate(sizes)]
    return named[0].unionByName(named[1]).unionByName(named[2])


def matches(surface: DataFrame, rgb: DataFrame, seeds: DataFrame, side: int, threshold: float = THRESHOLD, most: int = MOST_MATCHES) -> DataFrame:
    """seeds(image_id, x, y, w, h) -> FOUND: where each region is found in its frame, with the size that was looked for and the
    score.  Regions with a side under LEAST_SIDE are not looked for."""
    numbered = number(seeds.filter((F.col("w") >= LEAST_SIDE) & (F.col("h") >= LEAST_SIDE)).select("image_id", *XYWH).distinct())
    templates = cut(variants(surface, rgb, numbered, side), "templates")
    crop = F.floor(F.col("template") / 3)
    sizes = templates.groupBy("image_id", "template").agg((F.max("dx") + 1).alias("w"), (F.max("dy") + 1).alias("h")).withColumn("crop", crop)
    own = numbered.select("image_id", "crop", *[F.col(c).alias(f"seed_{c}") for c in XYWH], F.greatest(F.lit(LEAST_PAD), F.floor(F.least("w", "h") / PAD_SHARE)).alias("pad"))
    sizes = cut(sizes.join(own, ["image_id", "crop"]), "sizes")
    picks = pick_peaks(template_scores(surface, templates, least=threshold), sizes.select("image_id", "template", "w", "h", "pad"), threshold, max(4, most // (1 + len(SCALES))))
    return picks.join(sizes, ["image_id", "template"]).withColumn("variant", F.col("template") % 3).select(FOUND)


def combine(seeds: DataFrame, found: DataFrame) -> DataFrame:
    """seeds(image_id, ord, x, y, w, h) and FOUND -> image_id, ord, x, y, w, h: the seeds, and matches that two of an image's
    regions have (one, if it has one only), merged where they overlap and numbered by (y, x)."""
    own = seeds.select("image_id", "ord", *XYWH, F.lit(1.0).alias("score"), F.lit(None).cast("long").alias("source"), F.lit(True).alias("seed"))
    sources = seeds.select("image_id", F.col("ord").alias("source"), *[F.col(c).alias(f"seed_{c}") for c in XYWH])
    later = F.lit(1 << 40) + F.col("source") * 1000 + F.col("variant") * 100 + F.col("pick")  # seeds come first among equal scores
    theirs = found.join(sources, ["image_id", *SEED]).select("image_id", later.alias("ord"), *XYWH, "score", "source", F.lit(False).alias("seed"))
    few = seeds.groupBy("image_id").agg(F.when(F.count("*") <= 1, 1).otherwise(2).alias("least"))
    merged = merge_matches(own.unionByName(theirs), min_sources=1).join(few, "image_id").filter(F.col("seed") | (F.col("n_sources") >= F.col("least")))
    place = F.row_number().over(Window.partitionBy("image_id").orderBy("y", "x", F.desc("score"), "w", "h"))
    return merged.select("image_id", place.cast("long").alias("ord"), *XYWH)


def suggestions(base: DataFrame, candidates: DataFrame) -> DataFrame:
    """image_id, ord, x, y, w, h: candidates that overlap neither a base region nor an earlier suggestion by DEDUPE_IOU.  Images
    whose base regions overlap one another that far have none."""
    entry = lambda name: F.sort_array(F.collect_list(F.struct("ord", *XYWH))).alias(name)
    alone = by_merge(dedupe(base).groupBy("image_id").agg(F.count("*").alias("kept")))
    both = base.groupBy("image_id").agg(entry("base")).join(alone, "image_id").filter(F.size("base") == F.col("kept")).join(candidates.groupBy("image_id").agg(entry("found")), "image_id")

    def step(taken, c):
        near = F.exists(F.concat(F.col("base"), taken), lambda k: iou(k, c) >= DEDUPE_IOU)
        return F.when(near, taken).otherwise(F.concat(taken, F.array(c)))

    return both.select("image_id", F.inline(F.aggregate("found", F.slice("found", 1, 0), step)))


def autodetect(base: DataFrame, matches_of, width: int, height: int) -> DataFrame:
    """base(image_id, ord, x, y, w, h) -> image_id, ord, x, y, w, h, suggested: the base regions and what detection adds to
    them, without what overlaps an earlier one.

    A pass takes an image's regions as seeds and what combine() makes of their matches as its regions; the image leaves when
    they are no more than before, when they reach its limit, or after its last pass.  matches_of(seeds) gives FOUND for seeds
    that it has not seen; row counts alone reach the driver.
    """
    order = lambda *by: F.row_number().over(Window.partitionBy("image_id").orderBy(*by)).cast("long")
    many = F.col("n") >= MANY
    images = base.groupBy("image_id").agg(F.count("*").alias("n")).select(
        "image_id", "n", F.when(many, PASSES_OF_MANY).otherwise(1).alias("passes"),
        F.greatest("n", F.when(many, LIMIT_OF_MANY).otherwise(F.least(F.lit(LIMIT_OF_FEW), F.col("n") + MORE_OF_FEW))).alias("limit"),
    )
    current, live, found = base.select("image_id", "ord", *XYWH), cut(images, "images"), None
    for n in range(1, PASSES_OF_MANY + 1):
        live = live.filter(F.col("passes") >= n)
        seeds = cut(clamp_regions(current, width, height).join(live, "image_id", "left_semi"), "pass-seeds")
        if seeds.isEmpty():
            break
        fresh = seeds.select("image_id", *XYWH).distinct()
        if found is not None:
            fresh = fresh.join(found.select("image_id", *[F.col(f"seed_{c}").alias(c) for c in XYWH]), ["image_id", *XYWH], "left_anti")
        new = matches_of(fresh)
        found = cut(found.unionByName(new) if found is not None else new, "found")
        merged = dedupe(combine(seeds, found)).withColumn("ord", order("ord"))
        merged = cut(merged, "merged")
        grown = merged.groupBy("image_id").agg(F.count("*").alias("now")).join(live, "image_id").filter("now > n")
        grown = cut(grown.select("image_id", F.least("now", "limit").cast("long").alias("n"), "passes", "limit"), "grown")
        taken = merged.join(grown.select("image_id", "limit"), "image_id").filter("ord <= limit").drop("limit")
        current = cut(current.join(grown, "image_id", "left_anti").unionByName(taken), "current")
        live = grown.filter("n < limit")
    added = suggestions(base, current).withColumn("suggested", F.lit(True))
    every = base.select("image_id", "ord", *XYWH).withColumn("suggested", F.lit(False)).unionByName(added)
    every = cut(every.withColumn("ord", order("suggested", "ord")), "every")
    kept = dedupe(every.drop("suggested"))
    return kept.join(every.select("image_id", "ord", "suggested"), ["image_id", "ord"]).select("image_id", "ord", *XYWH, "suggested")


def detect_repeated(rgb: DataFrame, base: DataFrame, width: int, height: int) -> DataFrame:
    """autodetect() on frames rgb(image_id, y, x, r, g, b; 0 to 255) of one size."""
    surface = cut(match_surface(rgb, width), "surface")
    return autodetect(base, lambda seeds: matches(surface, rgb, seeds, width), width, height)
