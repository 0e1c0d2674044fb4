"""Rectangles of images: normalising, clamping, overlap, order-dependent suppression and crop planning, exact union area.

The order-dependent ones are folds over one image's regions in their order (tens of them), each image on its own; everything
else is projections, equi-joins on the image with a range predicate, and aggregates.
"""

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..sources.shared import cut
from ..functions.boxes import close, half_even, iou, padded_box, thousandths
from .folds import apart, covered, crop_groups

XYWH = ("x", "y", "w", "h")
MIN_SIDE = 4
DEDUPE_IOU, MERGE_IOU = 0.45, 0.38


def rect(prefix: str = "") -> Column:
    return F.struct(*[F.col(f"{prefix}{c}").alias(c) for c in XYWH])


def normalize(raw: DataFrame) -> DataFrame:
    """Rows whose x, y, w and h are all integers, as such; decimals in a string are none."""
    cast = raw.select(*[F.expr(f"try_cast({c} AS BIGINT)").alias(c) if c in XYWH else F.col(c) for c in raw.columns])
    return cast.na.drop(subset=list(XYWH))


def clamp_regions(regions: DataFrame, width: int, height: int) -> DataFrame:
    """Origins floored at 0 and sides clipped to the frame; regions of MIN_SIDE or less, before or after, go."""
    floored = regions.filter((F.col("w") > MIN_SIDE) & (F.col("h") > MIN_SIDE)).withColumns({"x": F.greatest(F.col("x"), F.lit(0)), "y": F.greatest(F.col("y"), F.lit(0))})
    clipped = floored.withColumns({"w": F.least(F.col("w"), width - F.col("x")), "h": F.least(F.col("h"), height - F.col("y"))})
    return clipped.filter((F.col("w") > MIN_SIDE) & (F.col("h") > MIN_SIDE))


def overlapping_pairs(regions: DataFrame, threshold: float = 0.0) -> DataFrame:
    """image_id, a, b, iou: pairs of an image's regions whose IoU is above threshold."""
    a, b = regions.alias("a"), regions.alias("b")
    left, right = rect("a."), rect("b.")
    on = F.expr("a.image_id = b.image_id AND a.ord < b.ord AND a.x < b.x + b.w AND b.x < a.x + a.w AND a.y < b.y + b.h AND b.y < a.y + a.h")
    return a.join(b, on).select("a.image_id", F.col("a.ord").alias("a"), F.col("b.ord").alias("b"), iou(left, right).alias("iou")).filter(F.col("iou") > threshold)


def by_image(regions: DataFrame, *carried: str) -> DataFrame:
    """image_id, rs: the regions of each image as an array in their order; and columns that have one value for each image."""
    return regions.groupBy("image_id").agg(F.sort_array(F.collect_list(F.struct("ord", *XYWH))).alias("rs"), *[F.max(c).alias(c) for c in carried])


def dedupe(regions: DataFrame, threshold: float = DEDUPE_IOU, *carried: str) -> DataFrame:
    """Regions that overlap none of the regions kept before them by threshold or more."""
    return by_image(regions, *carried).select("image_id", F.inline(apart("rs", threshold)), *carried)


def bounding_boxes(regions: DataFrame) -> DataFrame:
    """image_id, x0, y0, x1, y1, n: the box around each image's regions."""
    return regions.groupBy("image_id").agg(
        F.min("x").alias("x0"), F.min("y").alias("y0"), F.max(F.col("x") + F.col("w")).alias("x1"), F.max(F.col("y") + F.col("h")).alias("y1"), F.count("*").alias("n")
    )


def close_pairs(regions: DataFrame, gap: int, padding: int, width: int, height: int) -> DataFrame:
    """image_id, a, b: pairs whose padded boxes are at most gap apart on both axes."""
    boxed = regions.select("image_id", "ord", padded_box(rect(), padding, width, height).alias("box"))
    a, b = boxed.alias("a"), boxed.alias("b")
    on = F.expr("a.image_id = b.image_id AND a.ord < b.ord") & close(F.col("a.box"), F.col("b.box"), gap)
    return a.join(b, on).select("a.image_id", F.col("a.ord").alias("a"), F.col("b.ord").alias("b"))


def plan_crops(regions: DataFrame, width: int, height: int, max_width, max_height, padding, gap) -> DataFrame:
    """image_id, index, x, y, w, h, region_count, ords: crop groups of each image.  The last four are numbers, or names of columns
    of regions that have one value for each image.

    Regions in the order of (y, x, ord) join the close group whose box grows least (the first of equals) and still fits;
    else they open a group.  Groups are numbered from 1 by (y, x, age).
    """
    own = {n: F.col(v) if isinstance(v, str) else F.lit(v) for n, v in (("max_width", max_width), ("max_height", max_height), ("padding", padding), ("gap", gap))}
    entry = F.struct("y", "x", "ord", padded_box(rect(), own["padding"], width, height).alias("box"))
    ordered = regions.groupBy("image_id").agg(F.sort_array(F.collect_list(entry)).alias("rs"), *[F.max(v).cast("long").alias(n) for n, v in own.items()])
    boxes = F.transform("rs", lambda r: F.struct(r["ord"].alias("ord"), *[r["box"][c].alias(c) for c in ("x0", "y0", "x1", "y1")]))
    groups = crop_groups(boxes, F.greatest(F.lit(64), F.col("max_width")), F.greatest(F.lit(64), F.col("max_height")), F.col("gap"))
    return ordered.select("image_id", F.inline(groups))


def crop_area(groups: DataFrame, width: int, height: int) -> DataFrame:
    """image_id, area_total, area_pct: areas of crops, overlaps counted twice, also as a part of the frame."""
    area = F.sum(F.greatest(F.lit(0), F.col("w")) * F.greatest(F.lit(0), F.col("h"))).cast("long")
    total = groups.groupBy("image_id").agg(area.alias("area_total"))
    return total.withColumn("area_pct", thousandths(F.col("area_total") / max(1, width * height) * 100))


def fit_size(sizes: DataFrame, max_width: int, max_height: int) -> DataFrame:
    """sizes(w, h, ...) with fit_w and fit_h: scaled into the limits, multiples of 16 from 64 up."""
    w, h = F.greatest(F.lit(32), F.col("w")), F.greatest(F.lit(32), F.col("h"))
    scale = F.least(F.lit(float(max_width)) / w, F.lit(float(max_height)) / h)
    snap = lambda v, most: F.least(F.lit(most), F.greatest(F.lit(64), F.floor(F.greatest(F.lit(64), half_even(v * scale)) / 16) * 16)).cast("long")
    return sizes.withColumns({"fit_w": snap(w, max_width), "fit_h": snap(h, max_height)})


def mask_rects(regions: DataFrame, expand: int, width: int = 0, height: int = 0) -> DataFrame:
    """Regions widened by expand and clipped (not at the far side where the size is unknown, 0); empty ones go."""
    x, y = F.greatest(F.lit(0), F.col("x") - expand), F.greatest(F.lit(0), F.col("y") - expand)
    right, bottom = F.col("x") + F.col("w") + expand, F.col("y") + F.col("h") + expand
    right = F.least(F.lit(width), right) if width else right
    bottom = F.least(F.lit(height), bottom) if height else bottom
    return regions.select("image_id", "ord", x.alias("x"), y.alias("y"), (right - x).alias("w"), (bottom - y).alias("h")).filter("w > 0 AND h > 0")


def union_area(rects: DataFrame) -> DataFrame:
    """image_id, area: exact area that the rectangles of each image cover.

    Distinct x edges cut the image into slabs; in each slab the rectangles' y intervals are merged by a running maximum of
    their ends, which counts what each adds to those before it.  An image is a row, so no rectangle is a row of each slab.
    """
    entry = F.struct(F.col("y").alias("y0"), (F.col("y") + F.col("h")).alias("y1"), F.col("x").alias("x0"), (F.col("x") + F.col("w")).alias("x1"))
    packed = rects.filter("image_id IS NOT NULL AND w > 0").groupBy("image_id").agg(F.sort_array(F.collect_list(entry)).alias("rs"))
    return packed.select("image_id", covered("rs").alias("area"))


def coverage_label(areas: DataFrame, width: int, height: int) -> DataFrame:
    """areas(image_id, area) with coverage_pct (100 at most) and its label, whole from 10 up and else with one decimal."""
    pct = F.least(F.lit(100.0), F.col("area") / max(1, width * height) * 100)
    whole = F.floor(F.col("coverage_pct") + 0.5).cast("long").cast("string")
    tenths = F.floor(F.col("coverage_pct") * 10 + 0.5).cast("long")
    one = F.concat(F.floor(tenths / 10).cast("string"), F.lit("."), (tenths % 10).cast("string"))
    return areas.withColumn("coverage_pct", pct).withColumn("label", F.when(F.col("coverage_pct") >= 10, whole).otherwise(one))


def region_boxes(images: DataFrame, regions: DataFrame, padding: int, width: int, height: int) -> DataFrame:
    """image_id, ord, x0, y0, x1, y1: padded boxes of the regions that are not empty; images without regions have one box,
    the whole frame, whose ord is null."""
    boxes = regions.select("image_id", "ord", padded_box(rect(), padding, width, height).alias("b")).select("image_id", "ord", "b.*").filter("x1 > x0 AND y1 > y0")
    bare = images.select("image_id").join(regions.select("image_id").distinct(), "image_id", "left_anti")
    whole = bare.select("image_id", F.lit(None).cast("long").alias("ord"), *[F.lit(v).cast("long").alias(c) for c, v in (("x0", 0), ("y0", 0), ("x1", width), ("y1", height))])
    return boxes.unionByName(whole)


def to_crop(regions: DataFrame, groups: DataFrame) -> DataFrame:
    """image_id, index, ord, x, y, w, h: regions in the coordinates of the crop that they belong to."""
    members = groups.select("image_id", "index", F.col("x").alias("gx"), F.col("y").alias("gy"), F.explode("ords").alias("ord"))
    return members.join(regions, ["image_id", "ord"]).select("image_id", "index", "ord", (F.col("x") - F.col("gx")).alias("x"), (F.col("y") - F.col("gy")).alias("y"), "w", "h")


def commit_selection(drags: DataFrame, scale_x: float, scale_y: float, width: int, height: int) -> DataFrame:
    """drags(id, ax, ay, bx, by) of a pointer on a scaled canvas -> id, x, y, w, h in frame pixels; under two pixels none."""
    near = lambda v: F.floor(v + 0.5).cast("long")  # noqa: E731  halves up, as the client rounds
    x = F.greatest(F.lit(0), near(F.least("ax", "bx") * scale_x))
    y = F.greatest(F.lit(0), near(F.least("ay", "by") * scale_y))
    w = F.least(near(F.abs(F.col("bx") - F.col("ax")) * scale_x), width - x)
    h = F.least(near(F.abs(F.col("by") - F.col("ay")) * scale_y), height - y)
    return drags.select("id", x.alias("x"), y.alias("y"), w.alias("w"), h.alias("h")).filter("w >= 2 AND h >= 2")


def put_region(regions: DataFrame, edits: DataFrame) -> DataFrame:
    """edits(image_id, ord, x, y, w, h) replace the rows of the same ord; with a null ord they are appended if w and h are 1
    or more."""
    row = F.struct(*[F.col(c).cast("long").alias(c) for c in ("ord", *XYWH)])
    listed = lambda df, n: df.groupBy("image_id").agg(F.collect_list(row).alias(n))
    both = listed(regions, "rs").join(listed(edits, "es"), "image_id", "full")  # by image alone, in whose parts the regions lie

    def change(r):
        own = F.filter("es", lambda e: e["ord"] == r["ord"])
        new = F.transform(own, lambda e: F.struct(r["ord"].alias("ord"), *[F.coalesce(e[c], r[c]).alias(c) for c in XYWH]))
        return F.when(F.size(own) > 0, new).otherwise(F.array(r))

    fresh = F.filter("es", lambda e: e["ord"].isNull() & (e["w"] >= 1) & (e["h"] >= 1))
    ordered = F.sort_array(F.transform(fresh, lambda e: F.struct(*[e[c].alias(c) for c in XYWH])))
    last = F.coalesce(F.array_max(F.col("rs.ord")), F.lit(0).cast("long"))
    more = F.transform(ordered, lambda e, i: F.struct((last + i + 1).alias("ord"), *[e[c].alias(c) for c in XYWH]))
    put = F.when(F.col("es").isNull(), F.col("rs")).when(F.col("rs").isNull(), more).otherwise(F.concat(F.flatten(F.transform("rs", change)), more))
    return both.select("image_id", F.inline(put))


def delete_regions(regions: DataFrame, gone: DataFrame) -> DataFrame:
    """regions without those of gone(image_id, ord), numbered anew from 1."""
    left = regions.join(gone, ["image_id", "ord"], "left_anti")
    return left.withColumn("ord", F.row_number().over(Window.partitionBy("image_id").orderBy("ord")).cast("long"))


def adopt(regions: DataFrame, proposed: DataFrame) -> DataFrame:
    """image_id, ord, x, y, w, h: the proposed regions of images where they are not fewer than their own, else their own."""
    listed = lambda df, n: df.groupBy("image_id").agg(F.collect_list(F.struct("ord", *XYWH)).alias(n))
    both = listed(regions, "own").join(listed(proposed.filter("image_id IS NOT NULL"), "new"), "image_id", "full")
    better = F.col("new").isNotNull() & (F.col("own").isNull() | (F.size("new") >= F.size("own")))
    return both.select("image_id", F.inline(F.when(better, F.col("new")).otherwise(F.col("own"))))


def select_region(regions: DataFrame, chosen: DataFrame) -> DataFrame:
    """The regions that chosen(image_id, ord) names, where there are such."""
    return regions.join(chosen, ["image_id", "ord"]).select("image_id", "ord", *XYWH)


def refuse_empty(requests: DataFrame, regions: DataFrame) -> DataFrame:
    """requests(image_id) with error: null where the image has a region, else why it is not worked on."""
    some = regions.select("image_id", F.lit(True).alias("some")).distinct()
    return requests.join(some, "image_id", "left").select("image_id", F.when(F.col("some").isNull(), "no regions").alias("error"))


def merge_matches(matches: DataFrame, min_sources: int = 2, threshold: float = MERGE_IOU) -> DataFrame:
    """matches(image_id, ord, x, y, w, h, score, source, seed) -> image_id, x, y, w, h, score, seed, n_sources.

    By falling score each match is merged into the first earlier one with an IoU of threshold or more, which keeps its place
    and takes the larger score, any seed and all sources.  Seeds stay, and others with min_sources sources.
    """
    entry = F.struct((-F.col("score")).alias("key"), "ord", *XYWH, "score", "seed", F.expr("IF(seed, array(), array(source))").cast("array<bigint>").alias("sources"))
    ordered = matches.groupBy("image_id").agg(F.sort_array(F.collect_list(entry)).alias("ms"))
    kind = "struct<x:bigint,y:bigint,w:bigint,h:bigint,score:double,seed:boolean,sources:array<bigint>>"

    def step(kept, m):
        hit = F.array_min(F.transform(kept, lambda k, i: F.when(iou(k, m) >= threshold, i)))
        own = F.struct(*[m[c].alias(c) for c in (*XYWH, "score", "seed", "sources")])
        merged = F.transform(kept, lambda k, i: F.when(i == hit, F.struct(
            *[k[c].alias(c) for c in XYWH], F.greatest(k["score"], m["score"]).alias("score"), (k["seed"] | m["seed"]).alias("seed"), F.array_union(k["sources"], m["sources"]).alias("sources")
        )).otherwise(k))
        return F.when(hit.isNull(), F.concat(kept, F.array(own))).otherwise(merged)

    kept = ordered.select("image_id", F.inline(F.aggregate("ms", F.expr(f"cast(array() AS array<{kind}>)"), step)))
    sources = F.size("sources").cast("long")
    return kept.filter(F.col("seed") | (sources >= min_sources)).select("image_id", *XYWH, "score", "seed", sources.alias("n_sources"))


def suppress_peaks(scores: DataFrame, threshold: float, limit: int, size: int, pad: int) -> DataFrame:
    """scores(image_id, y, x, score) -> image_id, pick, y, x, score: repeatedly the largest score (the first by y, x of
    equals), after which its surroundings count no more, until limit picks are made or it is below threshold."""
    entry = F.struct((-F.col("score")).alias("key"), "y", "x", "score")
    ordered = scores.filter(F.col("score") >= threshold).groupBy("image_id").agg(F.sort_array(F.collect_list(entry)).alias("cs"))

    def step(acc, c):
        near = F.exists(acc, lambda k: (c["x"] >= k["x"] - pad) & (c["x"] < k["x"] + size + pad) & (c["y"] >= k["y"] - pad) & (c["y"] < k["y"] + size + pad))
        own = F.struct(*[c[k].alias(k) for k in ("y", "x", "score")])
        return F.when(near | (F.size(acc) >= limit), acc).otherwise(F.concat(acc, F.array(own)))

    none = F.expr("cast(array() AS array<struct<y:bigint,x:bigint,score:double>>)")
    picks = ordered.select("image_id", F.posexplode(F.aggregate("cs", none, step)).alias("pick", "p"))
    return picks.select("image_id", (F.col("pick") + 1).cast("long").alias("pick"), "p.*")


def grow_regions(base: DataFrame, matches_of, passes: int, limit: int) -> DataFrame:
    """Re-seed detection until nothing new is found: each pass calls matches_of(regions) and adds what does not overlap what
    is there; at most `passes` passes and `limit` regions an image.  Row counts alone reach the driver."""
    found, n = base, base.count()
    for _ in range(passes):
        fresh = matches_of(found).select("image_id", F.lit(1 << 30).cast("long").alias("ord"), *XYWH)
        order = Window.partitionBy("image_id").orderBy("ord", "y", "x", "w", "h")
        both = found.unionByName(fresh).withColumn("ord", F.row_number().over(order).cast("long"))
        found = cut(dedupe(both).filter(F.col("ord") <= limit), "regions")
        now = found.count()
        if now <= n:
            break
        n = now
    return found
