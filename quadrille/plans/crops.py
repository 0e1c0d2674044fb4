"""Queries on work inside regions: name -> (query, SQL on the same tables)."""

from pyspark.sql import functions as F

from ..operators import analyze as a
from ..operators import crops as c
from ..sources.shared import cut
from ..sources.tables import PIXELS, pixels
from . import detect
from .masks import CROP, byte, crops


def patch_signals(spark, sf_dir):
    v = (F.col("v") * 7 + F.col("x") * 31 + F.col("y") * 3) % 256 / 256.0
    return crops(spark, sf_dir).select("image_id", "y", "x", v.alias("s"))


def patches(spark, sf_dir):
    """Patches as large as their crops, but for a few that are too small to have a window."""
    side = F.when(F.col("image_id") % 5 == 0, 9).otherwise(CROP).cast("long")
    return crops(spark, sf_dir).select("image_id").distinct().select("image_id", F.lit(CROP).cast("long").alias("w"), side.alias("h"))


def new_sizes(spark, sf_dir):
    i = F.col("image_id")
    return pixels(spark, sf_dir).select("image_id").distinct().select("image_id", (i % 4 * 3 + 5).alias("w"), (i % 3 * 4 + 3).alias("h"))


def boxes(spark, sf_dir):
    """Two crops an image, which overlap; the second is processed in another size."""
    one = lambda n, x, y, w, h: F.struct(*[F.lit(v).cast("long").alias(k) for k, v in (("index", n), ("x", x), ("y", y), ("w", w), ("h", h))])
    images = pixels(spark, sf_dir).select("image_id").distinct()
    cut_ = images.select("image_id", F.explode(F.array(one(1, 1, 2, 5, 4), one(2, 3, 1, 4, 6))).alias("b")).select("image_id", "b.*")
    return cut_.withColumn("crop", F.col("image_id") * 2 + F.col("index") - 1)


def cells(spark, sf_dir, wide, high, value):
    upto = lambda n: F.explode(F.sequence(F.lit(0).cast("long"), n - 1))
    rows = boxes(spark, sf_dir).select("crop", "index", wide.alias("cw"), high.alias("ch"))
    return rows.withColumn("y", upto(F.col("ch"))).withColumn("x", upto(F.col("cw"))).select(F.col("crop").alias("image_id"), "y", "x", value.alias("v"))


def composed(spark, sf_dir):
    second = F.col("index") == 2
    processed = cells(spark, sf_dir, F.when(second, 7).otherwise(F.col("w")).cast("long"), F.when(second, 5).otherwise(F.col("h")).cast("long"), (F.col("crop") * 13 + F.col("x") * 37 + F.col("y") * 91) % 256)
    masks = cells(spark, sf_dir, F.col("w"), F.col("h"), F.when((F.col("x") + F.col("y") + F.col("crop")) % 3 > 0, 255).otherwise(0).cast("long"))
    return c.compose(pixels(spark, sf_dir), boxes(spark, sf_dir), processed, masks, 1.0)


def frame_masks(spark, sf_dir):
    """Refined masks of the regions of scenes, pasted one after the other."""
    return c.draw_masks(detect.seeds(spark, sf_dir), detect.SCENE, detect.SCENE, 2, 1, cut(detect.scenes(spark, sf_dir), "scenes"))


def tightened(spark, sf_dir):
    return c.tighten_to_strokes(cut(detect.scenes(spark, sf_dir), "scenes"), detect.seeds(spark, sf_dir), detect.SCENE, detect.SCENE)


def requests(spark, sf_dir):
    """Of scenes, every other one by the engine that works in crops; detection is asked for in every third."""
    i = F.col("image_id")
    images = detect.seeds(spark, sf_dir).select("image_id").distinct()
    return images.select("image_id", F.when(i % 2 == 0, "propainter_quality").otherwise("lama_fast").alias("engine"), (i % 3 == 0).alias("autodetect"))


def overrides(spark, sf_dir):
    """Options that suit small frames, some of them out of their limits or unknown."""
    i = F.col("image_id")
    pairs = {"mask_padding": i % 4, "mask_dilate": i % 3 - 1, "propainter_crop_padding": i % 5, "propainter_crop_merge_gap": i % 7, "refine_mask": F.when(i % 4 < 2, "yes").otherwise("no"), "propainter_tighten_regions": F.when(i % 8 < 4, "1").otherwise("off"),
             "mask_shape": F.when(i % 5 == 4, "hf_segmenter").otherwise("none such"), "segmenter_threshold": i / 40.0}
    images = detect.seeds(spark, sf_dir).select("image_id").distinct()
    return images.select("image_id", F.explode(F.create_map(*[x for k, v in pairs.items() for x in (F.lit(k), v.cast("string"))])).alias("key", "raw"))


def scene_analysis(spark, sf_dir):
    rgb = cut(detect.scenes(spark, sf_dir), "scenes")
    probability = rgb.select("image_id", "y", "x", F.col("r").cast("long").alias("v"))
    return a.analyze(requests(spark, sf_dir), overrides(spark, sf_dir), detect.seeds(spark, sf_dir), rgb, detect.SCENE, detect.SCENE, probability)


_CUBIC = "CASE WHEN {x} < 1 THEN (1.5::DOUBLE * {x} - 2.5::DOUBLE) * {x} * {x} + 1 WHEN {x} < 2 THEN -0.5::DOUBLE * ((({x} - 5) * {x} + 8) * {x} - 4) ELSE 0.0::DOUBLE END"


def taps(dst: str, have: str, want: str, src: str) -> str:
    """Weights of all samples within reach of each new one, by their distance."""
    x = "abs((k.i - (o.i + 0.5::DOUBLE) * {r} + 0.5::DOUBLE) / greatest({r}, 1.0::DOUBLE))".format(r=f"({have}::DOUBLE / {want})")
    return f"""{dst}_all AS (SELECT s.*, o.i AS i, k.i AS k, {_CUBIC.format(x=x)} AS w0 FROM {src} s, range(64) o(i), range(64) k(i) WHERE o.i < {want} AND k.i < {have}
  AND k.i >= floor((o.i + 0.5::DOUBLE) * {have} / {want} - greatest({have}::DOUBLE / {want}, 1) * 2 + 0.5::DOUBLE) AND k.i < floor((o.i + 0.5::DOUBLE) * {have} / {want} + greatest({have}::DOUBLE / {want}, 1) * 2 + 0.5::DOUBLE)),
{dst} AS (SELECT key, i, k, w0 / sum(w0) OVER (PARTITION BY key, i) AS weight FROM {dst}_all)"""


def resized(src: str, sizes: str, dst: str) -> str:
    return f"""{dst}_size AS (SELECT s.image_id AS key, max(s.x) + 1 AS hw, max(s.y) + 1 AS hh, any_value(z.w) AS w, any_value(z.h) AS h FROM {src} s JOIN {sizes} z ON z.image_id = s.image_id GROUP BY s.image_id),
{taps(dst + "_across", "hw", "w", dst + "_size")}, {taps(dst + "_down", "hh", "h", dst + "_size")},
{dst}_rows AS (SELECT image_id, y, i AS x, {byte("sum(v * weight)")} AS v FROM {src} JOIN {dst}_across ON key = image_id AND k = x GROUP BY image_id, y, i),
{dst} AS (SELECT image_id, i AS y, x, {byte("sum(v * weight)")} AS v FROM {dst}_rows JOIN {dst}_down ON key = image_id AND k = y GROUP BY image_id, i, x)"""


SIGNALS = f"signals AS (SELECT image_id, y * 2 + dy.i AS y, x * 2 + dx.i AS x, (v * 7 + (x * 2 + dx.i) * 31 + (y * 2 + dy.i) * 3) % 256 / 256.0::DOUBLE AS s FROM pixels, range(2) dy(i), range(2) dx(i))"

QUERIES = {
    "region_best_signal": (
        lambda s, d: c.best_signal(patch_signals(s, d), patches(s, d), 0.5, (10, 10), (7, 5)),
        f"""WITH {PIXELS}, {SIGNALS}, patches AS (SELECT DISTINCT image_id, {CROP}::BIGINT AS w, CASE WHEN image_id % 5 = 0 THEN 9 ELSE {CROP} END::BIGINT AS h FROM pixels),
sized AS (SELECT *, least(w, greatest(7, CAST(round_even(w * 0.72::DOUBLE, 0) AS BIGINT))) AS ww, least(h, greatest(5, CAST(round_even(h * 0.62::DOUBLE, 0) AS BIGINT))) AS wh, (SELECT max(s) FROM signals g WHERE g.image_id = p.image_id) AS top FROM patches p),
boxes AS (SELECT z.*, a.i AS x0, b.i AS y0 FROM sized z, range(0, 16, 2) a(i), range(0, 16, 2) b(i) WHERE top >= 0.5 AND w >= 10 AND h >= 10 AND ww < w AND wh < h AND a.i + ww <= w AND b.i + wh <= h),
sums AS (SELECT b.image_id, x0, y0, round(sum(s) - abs(any_value(x0 + ww / 2.0::DOUBLE - w / 2.0::DOUBLE)) * 0.03::DOUBLE - abs(any_value(y0 + wh / 2.0::DOUBLE - h / 2.0::DOUBLE)) * 0.05::DOUBLE, 6) AS score FROM boxes b JOIN signals g ON g.image_id = b.image_id AND g.x >= x0 AND g.x < x0 + ww AND g.y >= y0 AND g.y < y0 + wh GROUP BY b.image_id, x0, y0),
best AS (SELECT * FROM sums QUALIFY row_number() OVER (PARTITION BY image_id ORDER BY score DESC, y0, x0) = 1)
SELECT z.image_id, CASE WHEN b.x0 IS NULL THEN 0 ELSE greatest(0, b.x0 - 4) END AS x, CASE WHEN b.x0 IS NULL THEN 0 ELSE greatest(0, b.y0 - 4) END AS y,
  CASE WHEN b.x0 IS NULL THEN w ELSE least(w, b.x0 + ww + 4) - greatest(0, b.x0 - 4) END AS w, CASE WHEN b.x0 IS NULL THEN h ELSE least(h, b.y0 + wh + 4) - greatest(0, b.y0 - 4) END AS h FROM sized z LEFT JOIN best b USING (image_id)""",
    ),
    "image_resize": (
        lambda s, d: c.resize(pixels(s, d), new_sizes(s, d)),
        f"WITH {PIXELS}, sizes AS (SELECT DISTINCT image_id, image_id % 4 * 3 + 5 AS w, image_id % 3 * 4 + 3 AS h FROM pixels), {resized('pixels', 'sizes', 'new')} SELECT * FROM new",
    ),
    "crop_compose_feathered": (
        composed,
        f"""WITH {PIXELS}, boxes AS (SELECT DISTINCT image_id * 2 + b.index - 1 AS crop, image_id, b.index, b.x, b.y, b.w, b.h FROM pixels, (VALUES (1, 1, 2, 5, 4), (2, 3, 1, 4, 6)) b(index, x, y, w, h)),
processed AS (SELECT crop AS image_id, b.index, j.i AS y, i.i AS x, (crop * 13 + i.i * 37 + j.i * 91) % 256 AS v FROM boxes b, range(7) i(i), range(6) j(i) WHERE CASE WHEN b.index = 2 THEN j.i < 5 ELSE i.i < w AND j.i < h END),
masks AS (SELECT crop AS image_id, j.i AS y, i.i AS x, CASE WHEN (i.i + j.i + crop) % 3 > 0 THEN 255 ELSE 0 END AS v FROM boxes, range(7) i(i), range(6) j(i) WHERE i.i < w AND j.i < h),
second AS (SELECT image_id, y, x, v FROM processed WHERE index = 2), sizes AS (SELECT crop AS image_id, w, h FROM boxes), {resized("second", "sizes", "fit")},
laid AS (SELECT image_id, y, x, v FROM processed WHERE index = 1 UNION ALL SELECT image_id, y, x, v FROM fit),
soft AS (SELECT a.image_id, a.y, a.x, {byte("sum(b.v * exp(-((a.x - b.x) * (a.x - b.x) + (a.y - b.y) * (a.y - b.y)) / 2.0::DOUBLE)) / sum(exp(-((a.x - b.x) * (a.x - b.x) + (a.y - b.y) * (a.y - b.y)) / 2.0::DOUBLE))")} AS alpha
  FROM masks a JOIN masks b ON a.image_id = b.image_id AND abs(a.x - b.x) <= 3 AND abs(a.y - b.y) <= 3 GROUP BY a.image_id, a.y, a.x),
placed AS (SELECT b.image_id, b.index, l.y + b.y AS y, l.x + b.x AS x, l.v, s.alpha FROM laid l JOIN soft s USING (image_id, y, x) JOIN boxes b ON b.crop = l.image_id),
one AS (SELECT p.image_id, p.y, p.x, CAST(CASE WHEN a.v IS NULL THEN p.v ELSE round_even((a.v * a.alpha + p.v * (255 - a.alpha)) / 255.0::DOUBLE, 0) END AS BIGINT) AS v FROM pixels p LEFT JOIN placed a ON a.image_id = p.image_id AND a.y = p.y AND a.x = p.x AND a.index = 1)
SELECT o.image_id, o.y, o.x, CAST(CASE WHEN a.v IS NULL THEN o.v ELSE round_even((a.v * a.alpha + o.v * (255 - a.alpha)) / 255.0::DOUBLE, 0) END AS BIGINT) AS v FROM one o LEFT JOIN placed a ON a.image_id = o.image_id AND a.y = o.y AND a.x = o.x AND a.index = 2""",
    ),
    "region_masks_refined": (frame_masks, None),
    "region_tighten_strokes": (tightened, None),
    "request_analysis": (scene_analysis, None),
}
