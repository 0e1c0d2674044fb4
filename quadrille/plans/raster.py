"""Queries on masks and rasters: name -> (query, SQL on the same tables)."""

from pyspark.sql import functions as F

from ..operators import geometry as g
from ..operators import raster as r
from ..operators import runs as u
from ..sources.shared import in_parts
from ..sources.tables import HEIGHT, PIXELS, REGIONS, SIDE, WIDTH, pixels, table
from .geometry import CLAMPED, PLANNED, clamped, planned

W = f"WITH {PIXELS}"
WR = f"WITH {PIXELS}, {REGIONS}, {CLAMPED}"
POINTS = "points AS (SELECT image_id, x * 40 + 17 AS px, y * 25 + 9 AS py FROM pixels WHERE v > 0)"
RGB = "rgb AS (SELECT image_id, y, x, v::DOUBLE AS r, ((v * 7 + x * 31) % 256)::DOUBLE AS g, ((v * 3 + y * 29) % 256)::DOUBLE AS b FROM pixels)"


def points(spark, sf_dir):
    return pixels(spark, sf_dir).filter("v > 0").select("image_id", (F.col("x") * 40 + 17).alias("px"), (F.col("y") * 25 + 9).alias("py"))


def rgb(spark, sf_dir, scale=1.0):
    cols = {"r": F.col("v"), "g": (F.col("v") * 7 + F.col("x") * 31) % 256, "b": (F.col("v") * 3 + F.col("y") * 29) % 256}
    return pixels(spark, sf_dir).select("image_id", "y", "x", *[(c.cast("double") / scale).alias(k) for k, c in cols.items()])


def layers(spark, sf_dir):
    small = g.clamp_regions(clamped(spark, sf_dir), WIDTH, HEIGHT).select("image_id", "ord", *[F.floor(F.col(c) / 40).cast("long").alias(c) for c in ("x", "y", "w", "h")])
    return r.rectangle_masks(small, SIDE, SIDE).withColumn("v", (F.col("ord") * 37 % 256).cast("long"))


LAYERS = f"""cells AS (SELECT image_id, ord, ord * 37 % 256 AS v, x // 40 AS x, y // 40 AS y, w // 40 AS w, h // 40 AS h FROM clamped),
layers AS (SELECT c.image_id, c.ord, c.v, gy.i AS y, gx.i AS x FROM cells c, range({SIDE}) gy(i), range({SIDE}) gx(i)
  WHERE gx.i BETWEEN c.x AND c.x + c.w AND gy.i BETWEEN c.y AND c.y + c.h)"""


def hits(spark, sf_dir):
    frames = F.explode(F.sequence(F.lit(0), F.lit(4)))
    return pixels(spark, sf_dir).select("image_id", "y", "x", "v", frames.alias("frame")).select("image_id", "y", "x", "frame", ((F.col("v") + F.col("frame") * 41 + F.col("x") * 13) % 256 > 150).alias("hit"))


def ratios(spark, sf_dir):
    p = pixels(spark, sf_dir)
    band, core = F.col("y").between(3, 4), F.col("y").between(3, 4) & F.col("x").between(2, 5)
    on = (F.col("v") == 255) & (F.col("x") + F.col("y") < F.col("image_id") % 9)
    share = lambda c: F.avg(c.cast("double"))
    return p.groupBy("image_id").agg(share(on).alias("own"), share(band & (F.col("image_id") % 2 == 0)).alias("band"), share(core).alias("core"), share(on | (band & (F.col("image_id") % 2 == 0))).alias("own_band"), share(on | core).alias("own_core"))


DILATED = """dilated AS (SELECT a.image_id, a.y, a.x, CAST(CASE WHEN max(b.v) >= 18 THEN 255 ELSE 0 END AS BIGINT) AS v FROM pixels a
  JOIN pixels b ON a.image_id = b.image_id AND abs(a.x - b.x) <= 1 AND abs(a.y - b.y) <= 1 GROUP BY a.image_id, a.y, a.x)"""
SUMMED = f"""found AS (SELECT g.image_id, g."index", count(*) AS n, min(px - g.x) AS cx0, max(px - g.x) AS cx1, min(py - g.y) AS cy0, max(py - g.y) AS cy1
  FROM planned g JOIN points p ON g.image_id = p.image_id AND px >= g.x AND px < g.x + g.w AND py >= g.y AND py < g.y + g.h GROUP BY ALL),
sides AS (SELECT g.*, n, cx0 AS l, cy0 AS t, w - cx1 - 1 AS rr, h - cy1 - 1 AS bb, greatest(1, least(w, h)) AS short FROM planned g LEFT JOIN found USING (image_id, "index")),
limits AS (SELECT *, least(l, t, rr, bb) AS margin, greatest(4, CAST(round_even(short * 0.06::DOUBLE, 0) AS BIGINT)) AS risky FROM sides),
more AS (SELECT *, greatest(risky + 3, CAST(round_even(short * 0.12::DOUBLE, 0) AS BIGINT)) AS tight FROM limits),
summed AS (SELECT image_id, "index", x, y, w, h, region_count, ords,
  CASE WHEN n IS NULL THEN 'empty'
    WHEN ((l = margin AND x <= 0) OR (t = margin AND y <= 0) OR (rr = margin AND x + w >= {WIDTH}) OR (bb = margin AND y + h >= {HEIGHT}))
     AND coalesce(list_min(list_filter([CASE WHEN x > 0 THEN l END, CASE WHEN y > 0 THEN t END, CASE WHEN x + w < {WIDTH} THEN rr END, CASE WHEN y + h < {HEIGHT} THEN bb END], lambda m: m IS NOT NULL)) > tight, false) THEN 'safe'
    WHEN margin <= risky THEN 'risky' WHEN margin <= tight THEN 'tight' ELSE 'safe' END AS status,
  round_even(coalesce(n, 0)::DOUBLE / greatest(1, w * h) * 100 * 1000, 0) / 1000 AS mask_coverage_pct, coalesce(margin, 0) AS min_margin_px,
  coalesce(l, 0) AS margin_left_px, coalesce(t, 0) AS margin_top_px, coalesce(rr, 0) AS margin_right_px, coalesce(bb, 0) AS margin_bottom_px,
  round_even(coalesce(margin, 0)::DOUBLE / short * 1000, 0) / 1000 AS margin_ratio FROM more)"""
RELAXED = f"""aims AS (SELECT *, CASE status WHEN 'empty' THEN greatest(12, CAST(round_even(least(w, h) * 0.18::DOUBLE, 0) AS BIGINT)) WHEN 'risky' THEN greatest(10, CAST(round_even(least(w, h) * 0.16::DOUBLE, 0) AS BIGINT))
   ELSE greatest(8, CAST(round_even(least(w, h) * 0.12::DOUBLE, 0) AS BIGINT)) END AS aim FROM summed),
relaxed AS (SELECT image_id, "index", status, x AS ox, y AS oy, w AS ow, h AS oh, greatest(0, x - greatest(0, aim - margin_left_px)) AS x0, greatest(0, y - greatest(0, aim - margin_top_px)) AS y0,
   least({WIDTH}, x + w + greatest(0, aim - margin_right_px)) AS x1, least({HEIGHT}, y + h + greatest(0, aim - margin_bottom_px)) AS y1 FROM aims)"""

TIGHTENED = f"""near AS (SELECT *, greatest(0, x - greatest(6, least(24, CAST(round_even(w * 0.10::DOUBLE, 0) AS BIGINT)))) AS sx0, greatest(0, y - greatest(6, least(18, CAST(round_even(h * 0.18::DOUBLE, 0) AS BIGINT)))) AS sy0,
  least({WIDTH}, x + w + greatest(6, least(24, CAST(round_even(w * 0.10::DOUBLE, 0) AS BIGINT)))) AS sx1, least({HEIGHT}, y + h + greatest(6, least(18, CAST(round_even(h * 0.18::DOUBLE, 0) AS BIGINT)))) AS sy1 FROM clamped),
found AS (SELECT r.image_id, r.ord, count(*) AS n, min(px) AS bx0, max(px) AS bx1, min(py) AS by0, max(py) AS by1 FROM near r JOIN points p ON r.image_id = p.image_id AND px >= sx0 AND px < sx1 AND py >= sy0 AND py < sy1 GROUP BY r.image_id, r.ord),
both_ AS (SELECT near.*, n, bx0, bx1, by0, by1, n::DOUBLE / greatest(1, (sx1 - sx0) * (sy1 - sy0)) AS share FROM near LEFT JOIN found USING (image_id, ord)),
pads AS (SELECT *, least(CASE WHEN share <= 0.02 THEN 14 WHEN share <= 0.05 THEN 18 ELSE 24 END, greatest(4, CAST(round_even((bx1 - bx0 + 1) * CASE WHEN share <= 0.02 THEN 0.16::DOUBLE WHEN share <= 0.05 THEN 0.20::DOUBLE ELSE 0.24::DOUBLE END, 0) AS BIGINT))) AS ax,
  least(CASE WHEN share <= 0.02 THEN 10 WHEN share <= 0.05 THEN 12 ELSE 16 END, greatest(3, CAST(round_even((by1 - by0 + 1) * CASE WHEN share <= 0.02 THEN 0.22::DOUBLE WHEN share <= 0.05 THEN 0.26::DOUBLE ELSE 0.32::DOUBLE END, 0) AS BIGINT))) AS ay FROM both_),
tightened AS (SELECT image_id, ord, CASE WHEN n IS NULL THEN x ELSE greatest(sx0, bx0 - ax) END AS x, CASE WHEN n IS NULL THEN y ELSE greatest(sy0, by0 - ay) END AS y,
 CASE WHEN n IS NULL THEN w ELSE greatest(1, least(sx1, bx1 + 1 + ax) - greatest(sx0, bx0 - ax)) END AS w, CASE WHEN n IS NULL THEN h ELSE greatest(1, least(sy1, by1 + 1 + ay) - greatest(sy0, by0 - ay)) END AS h FROM pads)"""


def summed(spark, sf_dir):
    groups = in_parts(planned(spark, sf_dir), "image_id", table(spark, sf_dir, "lineitem"))
    return r.summarize_crops(groups, points(spark, sf_dir), WIDTH, HEIGHT)


QUERIES = {
    "mask_coverage_bbox": (
        lambda s, d: r.coverage(pixels(s, d)),
        f"""{W} SELECT image_id, avg((v = 255)::INT::DOUBLE) AS full_ratio, round_even(count(*) FILTER (v > 0)::DOUBLE / count(*) * 100 * 1000, 0) / 1000 AS coverage,
 coalesce(min(x) FILTER (v > 0), 0) AS x0, coalesce(min(y) FILTER (v > 0), 0) AS y0, coalesce(max(x + 1) FILTER (v > 0), 0) AS x1, coalesce(max(y + 1) FILTER (v > 0), 0) AS y1 FROM pixels GROUP BY image_id""",
    ),
    "mask_histogram": (lambda s, d: r.histogram(pixels(s, d)), f"{W} SELECT image_id, v, count(*) AS n FROM pixels GROUP BY image_id, v"),
    "mask_threshold": (lambda s, d: r.threshold(pixels(s, d), 0.5), f"{W} SELECT image_id, y, x, CAST(CASE WHEN v >= 127 THEN 255 ELSE 0 END AS BIGINT) AS v FROM pixels"),
    "mask_dilate": (lambda s, d: r.dilate(pixels(s, d), 1), f"{W}, {DILATED} SELECT * FROM dilated"),
    "mask_close": (
        lambda s, d: r.close_gaps(pixels(s, d), 1),
        f"""{W}, big AS (SELECT a.image_id, a.y, a.x, max(b.v) AS v FROM pixels a JOIN pixels b ON a.image_id = b.image_id AND abs(a.x - b.x) <= 1 AND abs(a.y - b.y) <= 1 GROUP BY a.image_id, a.y, a.x)
SELECT a.image_id, a.y, a.x, min(b.v) AS v FROM big a JOIN big b ON a.image_id = b.image_id AND abs(a.x - b.x) <= 1 AND abs(a.y - b.y) <= 1 GROUP BY a.image_id, a.y, a.x""",
    ),
    "mask_components": (
        lambda s, d: r.component_stats(r.label_components(pixels(s, d), SIDE)),
        f"""WITH RECURSIVE {PIXELS}, lit AS (SELECT image_id, y, x, y * {SIDE} + x AS id FROM pixels WHERE v > 0),
reach(image_id, id, other) AS (SELECT image_id, id, id FROM lit UNION SELECT r.image_id, r.id, b.id FROM reach r JOIN lit a ON a.image_id = r.image_id AND a.id = r.other
  JOIN lit b ON b.image_id = a.image_id AND abs(a.x - b.x) <= 1 AND abs(a.y - b.y) <= 1),
labels AS (SELECT image_id, id, min(other) AS label FROM reach GROUP BY image_id, id)
SELECT image_id, label, count(*) AS area, min(x) AS x, min(y) AS y, max(x) - min(x) + 1 AS w, max(y) - min(y) + 1 AS h FROM labels JOIN lit USING (image_id, id) GROUP BY image_id, label""",
    ),
    "mask_projection_trim": (
        lambda s, d: r.trim_to_projection(pixels(s, d), 24, 24),
        f"""{W}, hy AS (SELECT image_id, y, sum((v > 0)::INT) AS n FROM pixels GROUP BY image_id, y), hx AS (SELECT image_id, x, sum((v > 0)::INT) AS n FROM pixels GROUP BY image_id, x),
ry AS (SELECT image_id, greatest(0, min(y) - 3) AS y0, least(24, max(y) + 1 + 3) AS y1 FROM hy JOIN (SELECT image_id, greatest(2, floor(max(n) * 0.16::DOUBLE)) AS least FROM hy GROUP BY image_id) USING (image_id) WHERE n >= least GROUP BY image_id),
rx AS (SELECT image_id, greatest(0, min(x) - 6) AS x0, least(24, max(x) + 1 + 6) AS x1 FROM hx JOIN (SELECT image_id, greatest(2, floor(max(n) * 0.08::DOUBLE)) AS least FROM hx GROUP BY image_id) USING (image_id) WHERE n >= least GROUP BY image_id)
SELECT image_id, y, x, CAST(CASE WHEN y0 IS NULL OR x0 IS NULL THEN v WHEN x BETWEEN x0 AND x1 AND y BETWEEN y0 AND y1 AND v >= 18 THEN 255 ELSE 0 END AS BIGINT) AS v
FROM pixels LEFT JOIN ry USING (image_id) LEFT JOIN rx USING (image_id)""",
    ),
    "integral_image": (
        lambda s, d: r.integral(pixels(s, d)),
        f"{W} SELECT a.image_id, a.y, a.x, CAST(sum(b.v) AS BIGINT) AS s FROM pixels a JOIN pixels b ON a.image_id = b.image_id AND b.x <= a.x AND b.y <= a.y GROUP BY a.image_id, a.y, a.x",
    ),
    "box_sum": (
        lambda s, d: r.box_sums(r.integral(pixels(s, d)), pixels(s, d).filter("x < 6 AND y < 5").select("image_id", F.col("x").alias("x0"), F.col("y").alias("y0"), (F.col("x") + 2).alias("x1"), (F.col("y") + 3).alias("y1"))),
        f"{W} SELECT a.image_id, a.x AS x0, a.y AS y0, a.x + 2 AS x1, a.y + 3 AS y1, CAST(sum(b.v) AS BIGINT) AS total FROM pixels a JOIN pixels b ON a.image_id = b.image_id AND b.x >= a.x AND b.x < a.x + 2 AND b.y >= a.y AND b.y < a.y + 3 WHERE a.x < 6 AND a.y < 5 GROUP BY a.image_id, a.x, a.y",
    ),
    "best_window_argmax": (
        lambda s, d: r.best_window(pixels(s, d), SIDE, 4, 2, 0.03, 0.05),
        f"""{W}, sums AS (SELECT a.image_id, a.x, a.y, CAST(sum(b.v) AS BIGINT) AS total FROM pixels a JOIN pixels b ON a.image_id = b.image_id AND b.x >= a.x AND b.x < a.x + 4 AND b.y >= a.y AND b.y < a.y + 4
  WHERE a.x IN (0, 2, 4) AND a.y IN (0, 2, 4) GROUP BY a.image_id, a.x, a.y),
scored AS (SELECT *, total - abs(x + 2 - 4.0::DOUBLE) * 0.03::DOUBLE - abs(y + 2 - 4.0::DOUBLE) * 0.05::DOUBLE AS score FROM sums)
SELECT image_id, x, y, score FROM (SELECT *, row_number() OVER (PARTITION BY image_id ORDER BY score DESC, y, x) AS k FROM scored) WHERE k = 1""",
    ),
    "signal_map": (
        lambda s, d: r.signal(rgb(s, d, 255.0)),
        f"""{W}, {RGB}, unit AS (SELECT image_id, y, x, r / 255 AS r, g / 255 AS g, b / 255 AS b FROM rgb)
SELECT image_id, y, x, greatest(0.0, least(1.0, ((r + g + b) / 3 - 0.42::DOUBLE) * 2.4::DOUBLE - CASE WHEN greatest(r, g, b) > 1e-6 THEN (greatest(r, g, b) - least(r, g, b)) / greatest(r, g, b) ELSE 0.0 END * 1.5::DOUBLE))::DOUBLE AS s FROM unit""",
    ),
    "mask_overlay": (
        lambda s, d: r.overlay(rgb(s, d), pixels(s, d)),
        f"{W}, {RGB} SELECT image_id, y, x, r * CASE WHEN v > 0 THEN 1 - 180::DOUBLE / 255 ELSE 1.0 END AS r, g * CASE WHEN v > 0 THEN 1 - 180::DOUBLE / 255 ELSE 1.0 END AS g, b * CASE WHEN v > 0 THEN 1 - 180::DOUBLE / 255 ELSE 1.0 END AS b FROM rgb JOIN pixels USING (image_id, y, x)",
    ),
    "mask_merge_max": (lambda s, d: r.merge_max(layers(s, d)), f"{WR}, {LAYERS} SELECT image_id, y, x, max(v) AS v FROM layers GROUP BY image_id, y, x"),
    "mask_merge_lastwins": (lambda s, d: r.merge_last(layers(s, d)), f"{WR}, {LAYERS} SELECT image_id, y, x, arg_max(v, ord) AS v FROM layers GROUP BY image_id, y, x"),
    "coverage_fallback": (
        lambda s, d: r.ensure_coverage(ratios(s, d), 0.028, 0.24),
        f"""{W}, f AS (SELECT image_id, v = 255 AND x + y < image_id % 9 AS lit, y BETWEEN 3 AND 4 AND image_id % 2 = 0 AS band, y BETWEEN 3 AND 4 AND x BETWEEN 2 AND 5 AS core FROM pixels),
t AS (SELECT image_id, avg(lit::INT::DOUBLE) AS own, avg(band::INT::DOUBLE) AS band, avg(core::INT::DOUBLE) AS core, avg((lit OR band)::INT::DOUBLE) AS own_band, avg((lit OR core)::INT::DOUBLE) AS own_core FROM f GROUP BY image_id)
SELECT *, CASE WHEN own >= 0.028 THEN 'own' WHEN own_band BETWEEN 0.028 AND 0.24 THEN 'own_band' WHEN band BETWEEN 0.028 AND 0.24 THEN 'band' WHEN own_core BETWEEN 0.028 AND 0.24 THEN 'own_core'
  WHEN core BETWEEN 0.028 AND 0.24 THEN 'core' WHEN own_core > 0 THEN 'own_core' WHEN core > 0 THEN 'core' WHEN own_band > 0 THEN 'own_band' WHEN band > 0 THEN 'band' ELSE 'own' END AS choice FROM t""",
    ),
    "otsu_threshold": (
        lambda s, d: r.otsu(r.histogram(pixels(s, d))),
        f"""{W}, cuts AS (SELECT DISTINCT image_id, v FROM pixels), parts AS (SELECT c.image_id, c.v, count(*) FILTER (p.v <= c.v) AS n0, count(*) FILTER (p.v > c.v) AS n1, avg(p.v) FILTER (p.v <= c.v) AS m0, avg(p.v) FILTER (p.v > c.v) AS m1
  FROM cuts c JOIN pixels p USING (image_id) GROUP BY c.image_id, c.v), b AS (SELECT *, coalesce(round(n0 * n1 * (m0 - m1) * (m0 - m1), 6), 0.0) AS between_ FROM parts)
SELECT image_id, v AS cutoff, between_ AS "between" FROM (SELECT *, row_number() OVER (PARTITION BY image_id ORDER BY between_ DESC, v) AS k FROM b) WHERE k = 1""",
    ),
    "adaptive_percentile_cutoff": (
        lambda s, d: r.percentile_cutoffs(rgb(s, d)),
        f"{W}, {RGB}, c AS (SELECT image_id, greatest(r, g, b) AS top, least(r, g, b) AS low FROM rgb) SELECT image_id, greatest(128.0::DOUBLE, quantile_cont(top, 0.62)) AS bright_cutoff, least(110.0::DOUBLE, quantile_cont(CASE WHEN top > 0 THEN floor((top - low) * 255 / top) ELSE 0.0 END, 0.58)) AS calm_cutoff FROM c GROUP BY image_id",
    ),
    "temporal_vote": (
        lambda s, d: r.temporal_vote(hits(s, d), 2, 0.05, 0.6),
        f"""{W}, votes AS (SELECT image_id, y, x, count(*) FILTER ((v + f.i * 41 + x * 13) % 256 > 150) AS n FROM pixels, range(5) f(i) GROUP BY image_id, y, x),
s AS (SELECT image_id, avg((n >= 2)::INT::DOUBLE) AS share FROM votes GROUP BY image_id)
SELECT image_id, y, x, CAST(CASE WHEN share >= 0.05 AND n >= CASE WHEN share > 0.6 THEN 3 ELSE 2 END THEN 255 ELSE 0 END AS BIGINT) AS v FROM votes JOIN s USING (image_id)""",
    ),
    "crop_group_summary": (summed, f"{WR}, {PLANNED}, {POINTS}, {SUMMED} SELECT * FROM summed"),
    "crop_group_relax": (
        lambda s, d: r.relax_crops(summed(s, d), WIDTH, HEIGHT),
        f"""{WR}, {PLANNED}, {POINTS}, {SUMMED}, {RELAXED} SELECT image_id, "index", status, CASE WHEN status = 'safe' OR x1 <= x0 OR y1 <= y0 THEN ox ELSE x0 END AS x, CASE WHEN status = 'safe' OR x1 <= x0 OR y1 <= y0 THEN oy ELSE y0 END AS y,
 CASE WHEN status = 'safe' OR x1 <= x0 OR y1 <= y0 THEN ow ELSE x1 - x0 END AS w, CASE WHEN status = 'safe' OR x1 <= x0 OR y1 <= y0 THEN oh ELSE y1 - y0 END AS h FROM relaxed""",
    ),
    "region_tighten_to_mask": (lambda s, d: r.tighten(clamped(s, d), points(s, d), WIDTH, HEIGHT), f"{WR}, {POINTS}, {TIGHTENED} SELECT * FROM tightened"),
    "topk_suppression": (
        lambda s, d: g.suppress_peaks(pixels(s, d).select("image_id", "y", "x", ((F.col("v") + F.col("x") * 17 + F.col("y") * 5) % 251 / 251.0).alias("score")), 0.44, 4, 2, 1),
        f"""{W}, scores AS (SELECT image_id, y, x, (v + x * 17 + y * 5) % 251 / 251.0::DOUBLE AS score FROM pixels),
l AS (SELECT image_id, list([struct_pack(y := y, x := x, score := score)] ORDER BY score DESC, y, x) AS cs FROM scores WHERE score >= 0.44::DOUBLE GROUP BY image_id),
p AS (SELECT image_id, list_reduce(cs, lambda acc, c: CASE WHEN len(acc) >= 4 OR len(list_filter(acc, lambda k: c[1].x >= k.x - 1 AND c[1].x < k.x + 3 AND c[1].y >= k.y - 1 AND c[1].y < k.y + 3)) > 0 THEN acc ELSE list_concat(acc, c) END) AS picks FROM l)
SELECT image_id, i AS pick, picks[i].y AS y, picks[i].x AS x, picks[i].score AS score FROM (SELECT image_id, picks, unnest(range(1, len(picks) + 1)) AS i FROM p)""",
    ),
    "mask_runs": (
        lambda s, d: u.to_runs(pixels(s, d)),
        f"""{W}, lit AS (SELECT image_id, y, x FROM pixels WHERE v > 0)
SELECT a.image_id, a.y, a.x AS x0, (SELECT min(b.x) + 1 FROM lit b WHERE b.image_id = a.image_id AND b.y = a.y AND b.x >= a.x AND NOT EXISTS (SELECT 1 FROM lit c WHERE c.image_id = b.image_id AND c.y = b.y AND c.x = b.x + 1)) AS x1
FROM lit a WHERE NOT EXISTS (SELECT 1 FROM lit p WHERE p.image_id = a.image_id AND p.y = a.y AND p.x = a.x - 1)""",
    ),
    "runs_spread": (
        lambda s, d: u.to_pixels(u.spread(u.to_runs(pixels(s, d)), F.col("image_id") % 3, SIDE, SIDE)),
        f"""{W} SELECT a.image_id, a.y, a.x, 255::BIGINT AS v FROM pixels a JOIN pixels b ON a.image_id = b.image_id AND abs(a.x - b.x) <= a.image_id % 3 AND abs(a.y - b.y) <= a.image_id % 3 GROUP BY a.image_id, a.y, a.x HAVING max(b.v) > 0""",
    ),
    "runs_components": (
        lambda s, d: u.component_stats(u.label(u.to_runs(pixels(s, d)), SIDE, strip=4)),
        f"""WITH RECURSIVE {PIXELS}, lit AS (SELECT image_id, y, x, y * {SIDE} + x AS id FROM pixels WHERE v > 0),
reach(image_id, id, other) AS (SELECT image_id, id, id FROM lit UNION SELECT r.image_id, r.id, b.id FROM reach r JOIN lit a ON a.image_id = r.image_id AND a.id = r.other
  JOIN lit b ON b.image_id = a.image_id AND abs(a.x - b.x) <= 1 AND abs(a.y - b.y) <= 1),
labels AS (SELECT image_id, id, min(other) AS label FROM reach GROUP BY image_id, id)
SELECT image_id, label, count(*) AS area, min(x) AS x, min(y) AS y, max(x) - min(x) + 1 AS w, max(y) - min(y) + 1 AS h FROM labels JOIN lit USING (image_id, id) GROUP BY image_id, label""",
    ),
    "runs_coverage": (
        lambda s, d: u.coverage(u.to_runs(pixels(s, d))),
        f"{W} SELECT image_id, count(*) AS n, min(x) AS x0, min(y) AS y0, max(x) + 1 AS x1, max(y) + 1 AS y1 FROM pixels WHERE v > 0 GROUP BY image_id",
    ),
    "runs_projection_trim": (
        lambda s, d: u.to_pixels(u.trim_to_projection(u.to_runs(pixels(s, d).filter("(x * 3 + y * 5 + image_id) % 7 > 2")), 60, 40)),
        f"""{W}, lit AS (SELECT image_id, y, x FROM pixels WHERE v > 0 AND (x * 3 + y * 5 + image_id) % 7 > 2), hy AS (SELECT image_id, y, count(*) AS n FROM lit GROUP BY image_id, y), hx AS (SELECT image_id, x, count(*) AS n FROM lit GROUP BY image_id, x),
ry AS (SELECT image_id, greatest(0, min(y) - 3) AS y0, least(40, max(y) + 1 + 3) AS y1 FROM hy JOIN (SELECT image_id, greatest(2, floor(max(n) * 0.16::DOUBLE)) AS least FROM hy GROUP BY image_id) USING (image_id) WHERE n >= least GROUP BY image_id),
rx AS (SELECT image_id, greatest(0, min(x) - 6) AS x0, least(60, max(x) + 1 + 6) AS x1 FROM hx JOIN (SELECT image_id, greatest(2, floor(max(n) * 0.08::DOUBLE)) AS least FROM hx GROUP BY image_id) USING (image_id) WHERE n >= least GROUP BY image_id)
SELECT image_id, y, x, 255::BIGINT AS v FROM lit LEFT JOIN ry USING (image_id) LEFT JOIN rx USING (image_id) WHERE y0 IS NULL OR x0 IS NULL OR (x BETWEEN x0 AND x1 AND y BETWEEN y0 AND y1)""",
    ),
    "runs_rectangles": (
        lambda s, d: u.coverage(u.rectangles(clamped(s, d), WIDTH, HEIGHT)).select("image_id", "n"),
        f"""{WR}, spans AS (SELECT image_id, y, list([a, b + 1] ORDER BY a, b) AS rs FROM (SELECT image_id, greatest(0, least({WIDTH - 1}, x)) AS a, greatest(0, least({WIDTH - 1}, x + w)) AS b, unnest(range(greatest(0, least({HEIGHT - 1}, y)), greatest(0, least({HEIGHT - 1}, y + h)) + 1)) AS y FROM clamped) GROUP BY image_id, y)
SELECT image_id, CAST(sum(list_reduce(rs, lambda acc, r: [acc[1] + greatest(0, r[2] - greatest(r[1], acc[2])), greatest(acc[2], r[2])], [0::BIGINT, 0::BIGINT])[1]) AS BIGINT) AS n FROM spans GROUP BY image_id""",
    ),
}
