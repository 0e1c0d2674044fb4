"""Queries on strokes and templates: name -> (query, SQL on the same tables)."""

from pyspark.sql import functions as F

from ..operators import strokes as k
from ..operators import templates as t
from ..sources.tables import PIXELS, SIDE, pixels
from .raster import RGB, rgb

W = f"WITH {PIXELS}"
CHANNELS = """tones AS (SELECT image_id, y, x, CAST(greatest(r, g, b) AS BIGINT) AS value, CAST(CASE WHEN greatest(r, g, b) > 0 THEN round_even((greatest(r, g, b) - least(r, g, b)) * 255 / greatest(r, g, b), 0) ELSE 0 END AS BIGINT) AS saturation,
  CAST(round_even(r * 0.299::DOUBLE + g * 0.587::DOUBLE + b * 0.114::DOUBLE, 0) AS BIGINT) AS gray FROM rgb)"""
_WEIGHT = "exp(-({d}) * ({d}) / 2.0::DOUBLE)"
BLURRED = f"""wide AS (SELECT a.image_id, a.y, a.x, sum(b.v * {_WEIGHT.format(d="a.x - b.x")}) / sum({_WEIGHT.format(d="a.x - b.x")}) AS v FROM pixels a JOIN pixels b ON a.image_id = b.image_id AND a.y = b.y AND abs(a.x - b.x) <= 3 GROUP BY a.image_id, a.y, a.x),
blurred AS (SELECT a.image_id, a.y, a.x, sum(b.v * {_WEIGHT.format(d="a.y - b.y")}) / sum({_WEIGHT.format(d="a.y - b.y")}) AS v FROM wide a JOIN wide b ON a.image_id = b.image_id AND a.x = b.x AND abs(a.y - b.y) <= 3 GROUP BY a.image_id, a.y, a.x)"""
SEEDS = "seeds AS (SELECT DISTINCT image_id, s.ord AS ord, s.x AS sx, s.y AS sy, 3 AS sw, 2 AS sh FROM pixels, (VALUES (1::BIGINT, 0::BIGINT, 1::BIGINT), (2::BIGINT, 4::BIGINT, 3::BIGINT)) s(ord, x, y))"


def seeds(spark, sf_dir):
    one = F.explode(F.array(*[F.struct(*[F.lit(v).cast("long").alias(c) for c, v in (("ord", o), ("x", x), ("y", y), ("w", 3), ("h", 2))]) for o, x, y in ((1, 0, 1), (2, 4, 3))]))
    return pixels(spark, sf_dir).select("image_id").distinct().select("image_id", one.alias("s")).select("image_id", "s.*")


def images(spark, sf_dir):
    return pixels(spark, sf_dir).select("image_id").distinct()


def soft_box(width, height, x0, y0, x1, y1, sigma, x="x", y="y") -> str:
    """A condition on x and y: the share of a blur's weights that falls on the rectangle, column by column and row by row."""
    r = len(k.gauss(sigma)) - 1

    def part(at, low, high, size):
        weigh = f"exp(-(o * o) / {2 * sigma * sigma}::DOUBLE)"
        return f"list_sum(list_transform(range({-r}, {r + 1}), lambda o: CASE WHEN greatest(0, least({size - 1}, {at} + o)) BETWEEN {low} AND {high} THEN {weigh} ELSE 0.0::DOUBLE END)) / list_sum(list_transform(range({-r}, {r + 1}), lambda o: {weigh}))"

    return f"(round({part(x, x0, x1, width)} * {part(y, y0, y1, height)} * 255, 6) >= 18)"


def _band(*box) -> str:
    return f"{W} SELECT image_id, gy.i AS y, gx.i AS x, CAST(CASE WHEN {soft_box(40, 24, *box, x='gx.i', y='gy.i')} THEN 255 ELSE 0 END AS BIGINT) AS v FROM (SELECT DISTINCT image_id FROM pixels), range(24) gy(i), range(40) gx(i)"


QUERIES = {
    "tone_channels": (lambda s, d: k.channels(rgb(s, d)), f"{W}, {RGB}, {CHANNELS} SELECT *, CAST(floor(value * (255 - saturation) / 255.0) AS BIGINT) AS whiteness FROM tones"),
    "gaussian_blur": (
        lambda s, d: k.blur(pixels(s, d), 1.0).withColumn("v", F.round("v", 6)),
        f"{W}, {BLURRED} SELECT image_id, y, x, round(v, 6) AS v FROM blurred",
    ),
    "top_hat": (
        lambda s, d: k.top_hat(pixels(s, d), 1),
        f"""{W}, low AS (SELECT a.image_id, a.y, a.x, min(b.v) AS v FROM pixels a JOIN pixels b ON a.image_id = b.image_id AND abs(a.x - b.x) <= 1 AND abs(a.y - b.y) <= 1 GROUP BY a.image_id, a.y, a.x),
opened AS (SELECT a.image_id, a.y, a.x, max(b.v) AS v FROM low a JOIN low b ON a.image_id = b.image_id AND abs(a.x - b.x) <= 1 AND abs(a.y - b.y) <= 1 GROUP BY a.image_id, a.y, a.x)
SELECT image_id, y, x, p.v - o.v AS v FROM pixels p JOIN opened o USING (image_id, y, x)""",
    ),
    "mask_open": (
        lambda s, d: k.open_two(pixels(s, d)),
        f"""{W}, low AS (SELECT a.image_id, a.y, a.x, min(b.v) AS v FROM pixels a JOIN pixels b ON a.image_id = b.image_id AND a.x - b.x BETWEEN 0 AND 1 AND a.y - b.y BETWEEN 0 AND 1 GROUP BY a.image_id, a.y, a.x)
SELECT a.image_id, a.y, a.x, max(b.v) AS v FROM low a JOIN low b ON a.image_id = b.image_id AND b.x - a.x BETWEEN 0 AND 1 AND b.y - a.y BETWEEN 0 AND 1 GROUP BY a.image_id, a.y, a.x""",
    ),
    "wide_band_mask": (lambda s, d: k.wide_band(images(s, d), 40, 24), _band(1, 7, 38, 17, 1.0)),
    "text_band_mask": (lambda s, d: k.text_band(images(s, d), 40, 24), _band(4, 8, 36, 15, 1.2)),
    "text_core_mask": (lambda s, d: k.text_core(images(s, d), 40, 24), _band(7, 7, 32, 17, 0.8)),
    "mask_fuse": (
        lambda s, d: k.fuse(pixels(s, d).withColumn("v", F.when(F.col("v") == 255, 255).otherwise(0).cast("long")), pixels(s, d)),
        f"""{W}, steady AS (SELECT image_id, y, x, CAST(CASE WHEN v = 255 THEN 255 ELSE 0 END AS BIGINT) AS v FROM pixels), near AS (SELECT a.image_id, a.y, a.x, max(b.v) AS n FROM steady a JOIN steady b ON a.image_id = b.image_id AND abs(a.x - b.x) <= 1 AND abs(a.y - b.y) <= 1 GROUP BY a.image_id, a.y, a.x)
SELECT image_id, y, x, greatest(s.v, CASE WHEN n > 0 THEN p.v ELSE 0 END) AS v FROM steady s JOIN near USING (image_id, y, x) JOIN pixels p USING (image_id, y, x)""",
    ),
    "template_scores": (
        lambda s, d: t.template_scores(pixels(s, d), t.cut_templates(pixels(s, d), seeds(s, d))).withColumn("score", F.round("score", 9)),
        f"""{W}, {SEEDS}, t AS (SELECT p.image_id, s.ord AS template, p.y - s.sy AS dy, p.x - s.sx AS dx, p.v AS t FROM pixels p JOIN seeds s ON p.image_id = s.image_id AND p.x BETWEEN sx AND sx + 2 AND p.y BETWEEN sy AND sy + 1),
o AS (SELECT a.image_id, t.template, a.y, a.x, sum(p.v * t.t) AS vt, sum(p.v * p.v) AS vv, sum(t.t * t.t) AS tt FROM pixels a JOIN t ON t.image_id = a.image_id JOIN pixels p ON p.image_id = a.image_id AND p.y = a.y + t.dy AND p.x = a.x + t.dx WHERE a.x <= {SIDE - 3} AND a.y <= {SIDE - 2} GROUP BY a.image_id, t.template, a.y, a.x)
SELECT image_id, template, y, x, round(CASE WHEN vv > 0 AND tt > 0 THEN vt::DOUBLE / sqrt(vv::DOUBLE * tt::DOUBLE) ELSE 0.0 END, 9) AS score FROM o""",
    ),
}
