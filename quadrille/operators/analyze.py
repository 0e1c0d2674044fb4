"""The quality analysis of requests on frames: regions found and moved, the mask that the engine asks for, crops and a report.

Every request has a frame and options of its own.  Options become columns, so requests with different ones are worked on
together; a branch (detection, tightening, refined or model masks, crops) sees only the requests that ask for it.
"""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.boxes import thousandths
from ..sources.shared import cut
from . import config as c
from . import crops as p
from . import detect
from . import geometry as g
from . import raster as r
from . import runs as u
from .geometry import XYWH

STATUS = ("safe", "tight", "risky", "empty")
# The options that the analysis reads, and their types.
OPTIONS = {
    "family": "string", "refine_mask": "boolean", "mask_shape": "string", "segmenter_threshold": "double", "mask_padding": "long", "mask_dilate": "long",
    "propainter_use_crops": "boolean", "propainter_tighten_regions": "boolean", "propainter_crop_padding": "long", "propainter_crop_merge_gap": "long",
    "propainter_crop_max_width": "long", "propainter_crop_max_height": "long",
}


def options(requests: DataFrame, overrides: DataFrame) -> DataFrame:
    """image_id, autodetect and the OPTIONS of each request; requests and overrides are keyed by image_id here."""
    named = lambda df: df.withColumnRenamed("image_id", "request_id")
    wide = c.resolve(named(requests), named(overrides)).filter(F.col("key").isin(*OPTIONS)).groupBy("request_id").pivot("key", list(OPTIONS)).agg(F.first("value"))
    typed = wide.select(F.col("request_id").alias("image_id"), *[F.col(k).cast(t).alias(k) for k, t in OPTIONS.items()])
    return cut(typed.join(requests.select("image_id", "autodetect"), "image_id"), "options")


def regions_of(rgb: DataFrame, base: DataFrame, asked: DataFrame, width: int, height: int) -> DataFrame:
    """image_id, ord, x, y, w, h, suggested: the base regions, what detection adds where it is asked for, moved to what they
    hold where that is, without what overlaps an earlier one."""
    searched, rest = base.join(asked.filter("autodetect"), "image_id", "left_semi"), base.join(asked.filter("autodetect"), "image_id", "left_anti")
    seen = rgb.join(asked.filter("autodetect"), "image_id", "left_semi")
    found = detect.detect_repeated(seen, searched, width, height).unionByName(g.dedupe(rest).withColumn("suggested", F.lit(False)))
    found = cut(found.select("image_id", "ord", *XYWH, "suggested"), "found")
    tight = asked.filter("family = 'propainter' AND propainter_tighten_regions").select("image_id")
    moving = found.join(tight, "image_id", "left_semi")
    moved = g.dedupe(p.tighten_to_strokes(rgb.join(tight, "image_id", "left_semi"), moving.drop("suggested"), width, height))
    moved = moved.join(moving.select("image_id", "ord", "suggested"), ["image_id", "ord"])
    return cut(found.join(tight, "image_id", "left_anti").unionByName(moved.select("image_id", "ord", *XYWH, "suggested")), "regions")


def masks_of(rgb: DataFrame, regions: DataFrame, asked: DataFrame, width: int, height: int, probability: DataFrame | None = None) -> DataFrame:
    """Runs of each request's mask: its padded regions drawn as rectangles, or as the strokes in them where the mask is to be
    refined, or what the model's probability(image_id, y, x, v: 0 to 255) passes where the shape is a model's; spread."""
    wide = regions.join(asked, "image_id").withColumns({
        "x0": F.greatest(F.lit(0), F.col("x") - F.col("mask_padding")), "y0": F.greatest(F.lit(0), F.col("y") - F.col("mask_padding")),
        "x1": F.least(F.lit(width), F.col("x") + F.col("w") + F.col("mask_padding")), "y1": F.least(F.lit(height), F.col("y") + F.col("h") + F.col("mask_padding")),
    })
    box = wide.filter("x1 > x0 AND y1 > y0").select("image_id", "ord", F.col("x0").alias("x"), F.col("y0").alias("y"), (F.col("x1") - F.col("x0")).alias("w"), (F.col("y1") - F.col("y0")).alias("h"), "mask_shape", "refine_mask")
    by_model = F.col("mask_shape") != "auto" if probability is not None else F.lit(False)
    drawn = u.rectangles(box.filter(~by_model & ~F.col("refine_mask")), width, height)
    refined = p.draw_masks(box.filter(~by_model & F.col("refine_mask")).select("image_id", "ord", *XYWH), width, height, 0, 0, rgb)
    masks = drawn.unionByName(u.to_runs(refined))
    if probability is not None:
        level = F.floor(F.least(F.lit(1.0), F.greatest(F.lit(0.0), F.col("segmenter_threshold"))) * 255)
        sure = probability.join(asked.filter(by_model).select("image_id", level.alias("level")), "image_id")
        masks = masks.unionByName(u.to_runs(sure.select("image_id", "y", "x", (F.col("v") >= F.col("level")).cast("long").alias("v"))))
    return cut(u.spread(masks.join(asked.select("image_id", "mask_dilate"), "image_id"), F.col("mask_dilate"), width, height), "mask")


def crops_of(regions: DataFrame, mask: DataFrame, asked: DataFrame, width: int, height: int) -> DataFrame:
    """The crops of requests that work in crops, relaxed where the mask comes near their sides, and what they hold then."""
    own = asked.filter("family = 'propainter' AND propainter_use_crops").select(
        "image_id", F.col("propainter_crop_max_width").alias("max_w"), F.col("propainter_crop_max_height").alias("max_h"), F.col("propainter_crop_padding").alias("pad"), F.col("propainter_crop_merge_gap").alias("apart")
    )
    tight = r.tighten(regions.join(own, "image_id", "left_semi").select("image_id", "ord", *XYWH), mask, width, height)
    planned = g.plan_crops(tight.join(own, "image_id"), width, height, "max_w", "max_h", "pad", "apart")
    relaxed = cut(r.relax_crops(cut(r.summarize_crops(planned, mask, width, height), "summed"), width, height, "region_count").drop("status"), "relaxed")
    return cut(r.summarize_crops(relaxed, mask, width, height), "crops")


def analyze(requests: DataFrame, overrides: DataFrame, base: DataFrame, rgb: DataFrame, width: int, height: int, probability: DataFrame | None = None) -> DataFrame:
    """requests(image_id, engine, autodetect), overrides(image_id, key, raw), base(image_id, ord, x, y, w, h), frames
    rgb(image_id, y, x, r, g, b; 0 to 255) -> a row for each request with regions: counts of regions, crops by status and
    their area, the mask's coverage and box, and the merged regions, suggested ones and crops as JSON."""
    asked = options(requests, overrides)
    base = base.join(requests, "image_id", "left_semi")
    regions = regions_of(rgb, base, asked, width, height)
    mask = masks_of(rgb, regions, asked, width, height, probability)
    crop = F.struct("index", *XYWH, "region_count", "status", "min_margin_px")
    held = crops_of(regions, mask, asked, width, height).groupBy("image_id").agg(
        F.count("*").alias("crop_groups"), *[F.count_if(F.col("status") == s).alias(s) for s in STATUS], F.sum(F.col("w") * F.col("h")).alias("crop_area_total"), F.to_json(F.sort_array(F.collect_list(crop))).alias("crops")
    )
    entry = F.struct("ord", *XYWH)
    listed = lambda keep: F.to_json(F.transform(F.sort_array(F.collect_list(F.when(keep, entry))), lambda e: F.struct(*[e[k].alias(k) for k in XYWH])))
    told = regions.groupBy("image_id").agg(F.count("*").alias("merged_region_count"), F.count_if("suggested").alias("suggested_region_count"), listed(F.lit(True)).alias("merged_regions"), listed(F.col("suggested")).alias("suggested_regions"))
    both = base.groupBy("image_id").agg(F.count("*").alias("base_region_count")).join(told, "image_id").join(held, "image_id", "left").join(u.coverage(mask), "image_id", "left")
    both = both.join(asked.select("image_id", "family"), "image_id")
    zero = lambda n: F.coalesce(F.col(n), F.lit(0)).cast("long")
    pct = lambda v: thousandths(v / (width * height) * 100)
    return both.select(
        "image_id", "family", "base_region_count", "suggested_region_count", "merged_region_count", *[zero(n).alias(n) for n in ("crop_groups", *STATUS, "crop_area_total")], pct(zero("crop_area_total")).alias("crop_area_pct"),
        pct(zero("n")).alias("mask_coverage"), *[zero(e).alias(f"mask_{e}") for e in ("x0", "y0", "x1", "y1")], "merged_regions", "suggested_regions", F.coalesce("crops", F.lit("[]")).alias("crops"),
    )
