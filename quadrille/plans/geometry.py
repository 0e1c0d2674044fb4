"""Queries on rectangles: name -> (query, SQL on the same tables)."""

from pyspark.sql import functions as F

from ..functions.boxes import thousandths
from ..operators import geometry as g
from ..sources.tables import HEIGHT, REGIONS, WIDTH, regions, table

PLAN = {"width": WIDTH, "height": HEIGHT, "max_width": 200, "max_height": 150, "padding": 4, "gap": 4}

# SQL pieces
IOU = """CASE WHEN least({a}.x + {a}.w, {b}.x + {b}.w) > greatest({a}.x, {b}.x) AND least({a}.y + {a}.h, {b}.y + {b}.h) > greatest({a}.y, {b}.y)
 THEN ((least({a}.x + {a}.w, {b}.x + {b}.w) - greatest({a}.x, {b}.x)) * (least({a}.y + {a}.h, {b}.y + {b}.h) - greatest({a}.y, {b}.y)))::DOUBLE
  / ({a}.w * {a}.h + {b}.w * {b}.h - (least({a}.x + {a}.w, {b}.x + {b}.w) - greatest({a}.x, {b}.x)) * (least({a}.y + {a}.h, {b}.y + {b}.h) - greatest({a}.y, {b}.y)))
 ELSE 0.0 END"""
CLAMPED = f"""floored AS (SELECT image_id, ord, greatest(x, 0) AS x, greatest(y, 0) AS y, w, h FROM regions WHERE w > 4 AND h > 4),
clamped AS (SELECT * FROM (SELECT image_id, ord, x, y, least(w, {WIDTH} - x) AS w, least(h, {HEIGHT} - y) AS h FROM floored) WHERE w > 4 AND h > 4)"""
DEDUPED = f"""lists AS (SELECT image_id, list([{{'ord': ord, 'x': x, 'y': y, 'w': w, 'h': h}}] ORDER BY ord) AS rs FROM clamped GROUP BY image_id),
deduped AS (SELECT image_id, unnest(list_reduce(rs, lambda acc, r: CASE WHEN len(list_filter(acc, lambda k: {IOU.format(a="k", b="r[1]")} >= 0.45)) > 0
  THEN acc ELSE list_concat(acc, r) END), recursive := true) FROM lists)"""
_B = "struct_pack(x0 := greatest(0, least({w}, x - {p})), y0 := greatest(0, least({h}, y - {p})), x1 := greatest(0, least({w}, x + w + {p})), y1 := greatest(0, least({h}, y + h + {p})))"
BOX = _B.format(w=WIDTH, h=HEIGHT, p=4)
_U = "struct_pack(x0 := least(g.b.x0, r[1].b.x0), y0 := least(g.b.y0, r[1].b.y0), x1 := greatest(g.b.x1, r[1].b.x1), y1 := greatest(g.b.y1, r[1].b.y1))"
_AREA = "((greatest({a}.x1, {b}.x1) - least({a}.x0, {b}.x0)) * (greatest({a}.y1, {b}.y1) - least({a}.y0, {b}.y0)))".format(a="g.b", b="r[1].b")
_FITS = """NOT (g.b.x1 + 4 < r[1].b.x0 OR r[1].b.x1 + 4 < g.b.x0 OR g.b.y1 + 4 < r[1].b.y0 OR r[1].b.y1 + 4 < g.b.y0)
  AND greatest(g.b.x1, r[1].b.x1) - least(g.b.x0, r[1].b.x0) <= 200 AND greatest(g.b.y1, r[1].b.y1) - least(g.b.y0, r[1].b.y0) <= 150"""
_BEST = f"list_min(list_filter(list_transform(acc, lambda g, i: CASE WHEN {_FITS} THEN ({_AREA} - (g.b.x1 - g.b.x0) * (g.b.y1 - g.b.y0)) * 1000 + i END), lambda c: c IS NOT NULL))"
PLANNED = f"""entries AS (SELECT image_id, list([struct_pack(b := {BOX}, ords := [ord])] ORDER BY y, x, ord) AS rs FROM clamped GROUP BY image_id),
folded AS (SELECT image_id, list_reduce(rs, lambda acc, r: CASE WHEN {_BEST} IS NULL THEN list_concat(acc, r)
  ELSE list_transform(acc, lambda g, i: CASE WHEN i = {_BEST} % 1000 THEN struct_pack(b := {_U}, ords := list_concat(g.ords, r[1].ords)) ELSE g END) END) AS gs FROM entries),
aged AS (SELECT image_id, unnest(gs) AS g, unnest(range(len(gs))) AS age FROM folded),
planned AS (SELECT image_id, row_number() OVER (PARTITION BY image_id ORDER BY g.b.y0, g.b.x0, age) AS "index", g.b.x0 AS x, g.b.y0 AS y,
  g.b.x1 - g.b.x0 AS w, g.b.y1 - g.b.y0 AS h, len(g.ords) AS region_count, g.ords AS ords FROM aged)"""
RECTS = f"""rects AS (SELECT * FROM (SELECT image_id, ord, greatest(0, x - 12) AS x, greatest(0, y - 12) AS y,
  least({WIDTH}, x + w + 12) - greatest(0, x - 12) AS w, least({HEIGHT}, y + h + 12) - greatest(0, y - 12) AS h FROM regions) WHERE w > 0 AND h > 0)"""
# area another way: strips between distinct edges of both axes, counted once if any rectangle covers them
AREAS = """xs AS (SELECT image_id, e AS x0, lead(e) OVER (PARTITION BY image_id ORDER BY e) AS x1 FROM (SELECT image_id, x AS e FROM rects UNION SELECT image_id, x + w FROM rects)),
ys AS (SELECT image_id, e AS y0, lead(e) OVER (PARTITION BY image_id ORDER BY e) AS y1 FROM (SELECT image_id, y AS e FROM rects UNION SELECT image_id, y + h FROM rects)),
areas AS (SELECT image_id, CAST(sum((x1 - x0) * (y1 - y0)) AS BIGINT) AS area FROM xs JOIN ys USING (image_id)
  WHERE EXISTS (SELECT 1 FROM rects r WHERE r.image_id = xs.image_id AND r.x <= x0 AND r.x + r.w >= x1 AND r.y <= y0 AND r.y + r.h >= y1) GROUP BY image_id)"""


def raw_regions(spark, sf_dir):
    rows = regions(spark, sf_dir)
    return rows.select(
        "image_id", "ord", F.expr("CASE ord % 5 WHEN 0 THEN concat(x, '.5') WHEN 1 THEN concat(' ', x, ' ') ELSE cast(x AS string) END").alias("x"),
        F.expr("CASE WHEN ord % 7 = 3 THEN 'top' WHEN ord % 11 = 4 THEN NULL ELSE cast(y AS string) END").alias("y"), F.col("w").cast("string").alias("w"), F.col("h").cast("string").alias("h"),
    )


def clamped(spark, sf_dir):
    return g.clamp_regions(regions(spark, sf_dir), WIDTH, HEIGHT)


def planned(spark, sf_dir):
    return g.plan_crops(clamped(spark, sf_dir), **PLAN)


def rects(spark, sf_dir):
    return g.mask_rects(regions(spark, sf_dir), 12, WIDTH, HEIGHT)


def matches(spark, sf_dir):
    rows = clamped(spark, sf_dir)
    return rows.select("image_id", "ord", "x", "y", "w", "h", F.expr("CASE WHEN ord = 1 THEN 1.0D ELSE ((x * 7 + y * 3 + w) % 97) / 97.0D END").alias("score"), (F.col("ord") % 3).alias("source"), (F.col("ord") == 1).alias("seed"))


MATCHES = "matches AS (SELECT *, CASE WHEN ord = 1 THEN 1.0::DOUBLE ELSE ((x * 7 + y * 3 + w) % 97) / 97.0::DOUBLE END AS score, ord % 3 AS source, ord = 1 AS seed FROM clamped)"
_M = "struct_pack(x := x, y := y, w := w, h := h, score := score, seed := seed, sources := CASE WHEN seed THEN []::BIGINT[] ELSE [source] END)"
_HIT = f"list_min(list_filter(list_transform(acc, lambda k, i: CASE WHEN {IOU.format(a='k', b='m[1]')} >= 0.38 THEN i END), lambda c: c IS NOT NULL))"
MERGED = f"""mlists AS (SELECT image_id, list([{_M}] ORDER BY score DESC, ord) AS ms FROM matches GROUP BY image_id),
merged AS (SELECT image_id, unnest(list_reduce(ms, lambda acc, m: CASE WHEN {_HIT} IS NULL THEN list_concat(acc, m) ELSE list_transform(acc, lambda k, i: CASE WHEN i = {_HIT}
  THEN struct_pack(x := k.x, y := k.y, w := k.w, h := k.h, score := greatest(k.score, m[1].score), seed := k.seed OR m[1].seed, sources := list_distinct(list_concat(k.sources, m[1].sources))) ELSE k END) END)) AS k FROM mlists)"""


def drags(spark, sf_dir):
    return table(spark, sf_dir, "events").select(
        F.col("event_id").alias("id"), *[(F.col("event_id") * k % m).cast("double").alias(c) for c, k, m in (("ax", 37, 600), ("ay", 53, 330), ("bx", 71, 650), ("by", 97, 350))]
    )


def edits(spark, sf_dir):
    rows = regions(spark, sf_dir).filter("ord <= 2 AND image_id % 3 = 0")
    return rows.select("image_id", F.expr("CASE WHEN ord = 1 THEN ord END").alias("ord"), (F.col("x") + 1).alias("x"), F.col("y"), F.lit(33).cast("long").alias("w"), (F.col("h") % 5).alias("h"))


def report(spark, sf_dir):
    """The flagship: regions of an image are clamped, suppressed and measured."""
    kept = g.dedupe(clamped(spark, sf_dir))
    share = thousandths(F.col("area_total") / (WIDTH * HEIGHT) * 100)
    return kept.groupBy("image_id").agg(F.count("*").alias("regions"), F.sum(F.col("w") * F.col("h")).alias("area_total")).withColumn("area_pct", share)


W = f"WITH {REGIONS}"
QUERIES = {
    "region_quality_report": (report, f"{W}, {CLAMPED}, {DEDUPED} SELECT image_id, count(*) AS regions, CAST(sum(w * h) AS BIGINT) AS area_total, round_even(CAST(sum(w * h) AS BIGINT)::DOUBLE / {WIDTH * HEIGHT} * 100 * 1000, 0) / 1000 AS area_pct FROM deduped GROUP BY image_id"),
    "region_normalize": (
        lambda s, d: g.normalize(raw_regions(s, d)),
        rf"""{W} SELECT image_id, ord, x, y, w, h FROM regions WHERE ord % 5 <> 0 AND ord % 7 <> 3 AND ord % 11 <> 4""",
    ),
    "region_clamp": (clamped, f"{W}, {CLAMPED} SELECT * FROM clamped"),
    "region_iou_pairs": (
        lambda s, d: g.overlapping_pairs(clamped(s, d), 0.3),
        f"{W}, {CLAMPED} SELECT * FROM (SELECT a.image_id, a.ord AS a, b.ord AS b, {IOU.format(a='a', b='b')} AS iou FROM clamped a JOIN clamped b ON a.image_id = b.image_id AND a.ord < b.ord) WHERE iou > 0.3",
    ),
    "region_dedupe_greedy": (lambda s, d: g.dedupe(clamped(s, d)), f"{W}, {CLAMPED}, {DEDUPED} SELECT * FROM deduped"),
    "box_union_agg": (
        lambda s, d: g.bounding_boxes(regions(s, d)),
        f"{W} SELECT image_id, min(x) AS x0, min(y) AS y0, max(x + w) AS x1, max(y + h) AS y1, count(*) AS n FROM regions GROUP BY image_id",
    ),
    "box_close_pairs": (
        lambda s, d: g.close_pairs(clamped(s, d), 4, 4, WIDTH, HEIGHT),
        f"{W}, {CLAMPED}, boxes AS (SELECT image_id, ord, {BOX} AS b FROM clamped) SELECT p.image_id, p.ord AS a, q.ord AS b FROM boxes p JOIN boxes q ON p.image_id = q.image_id AND p.ord < q.ord AND p.b.x1 + 4 >= q.b.x0 AND q.b.x1 + 4 >= p.b.x0 AND p.b.y1 + 4 >= q.b.y0 AND q.b.y1 + 4 >= p.b.y0",
    ),
    "crop_group_plan": (planned, f"{W}, {CLAMPED}, {PLANNED} SELECT * FROM planned"),
    "crop_area_pct": (
        lambda s, d: g.crop_area(planned(s, d), WIDTH, HEIGHT),
        f"{W}, {CLAMPED}, {PLANNED} SELECT image_id, CAST(sum(w * h) AS BIGINT) AS area_total, round_even(CAST(sum(w * h) AS BIGINT)::DOUBLE / {WIDTH * HEIGHT} * 100 * 1000, 0) / 1000 AS area_pct FROM planned GROUP BY image_id",
    ),
    "fit_size": (
        lambda s, d: g.fit_size(planned(s, d).select("image_id", "index", "w", "h"), 960, 540),
        f"""{W}, {CLAMPED}, {PLANNED}, scaled AS (SELECT image_id, "index", w, h, least(960.0::DOUBLE / greatest(32, w), 540.0::DOUBLE / greatest(32, h)) AS k FROM planned)
SELECT image_id, "index", w, h, CAST(least(960, greatest(64, floor(greatest(64, round_even(greatest(32, w) * k, 0)) / 16) * 16)) AS BIGINT) AS fit_w,
       CAST(least(540, greatest(64, floor(greatest(64, round_even(greatest(32, h) * k, 0)) / 16) * 16)) AS BIGINT) AS fit_h FROM scaled""",
    ),
    "mask_rects": (rects, f"{W}, {RECTS} SELECT * FROM rects"),
    "region_union_area": (lambda s, d: g.union_area(rects(s, d)), f"{W}, {RECTS}, {AREAS} SELECT * FROM areas"),
    "mask_coverage_label": (
        lambda s, d: g.coverage_label(g.union_area(rects(s, d)), 1920, 1080),
        f"""{W}, {RECTS}, {AREAS}, pct AS (SELECT *, least(100.0::DOUBLE, area::DOUBLE / (1920 * 1080) * 100) AS coverage_pct FROM areas)
SELECT *, CASE WHEN coverage_pct >= 10 THEN CAST(CAST(floor(coverage_pct + 0.5) AS BIGINT) AS VARCHAR)
 ELSE CAST(CAST(floor(coverage_pct * 10 + 0.5) AS BIGINT) // 10 AS VARCHAR) || '.' || CAST(CAST(floor(coverage_pct * 10 + 0.5) AS BIGINT) % 10 AS VARCHAR) END AS label FROM pct""",
    ),
    "region_boxes": (
        lambda s, d: g.region_boxes(table(s, d, "orders").select(F.col("o_orderkey").alias("image_id")), clamped(s, d).filter("image_id % 4 <> 0"), 8, WIDTH, HEIGHT).fillna({"ord": 0}),
        f"""{W}, {CLAMPED}, chosen AS (SELECT * FROM clamped WHERE image_id % 4 <> 0), boxes AS (SELECT image_id, ord, {_B.format(w=WIDTH, h=HEIGHT, p=8)} AS b FROM chosen)
SELECT image_id, ord, b.x0 AS x0, b.y0 AS y0, b.x1 AS x1, b.y1 AS y1 FROM boxes WHERE b.x1 > b.x0 AND b.y1 > b.y0
UNION ALL SELECT o_orderkey, 0, 0, 0, {WIDTH}, {HEIGHT} FROM orders WHERE o_orderkey NOT IN (SELECT image_id FROM chosen)""",
    ),
    "region_translate": (
        lambda s, d: g.to_crop(clamped(s, d), planned(s, d)),
        f"""{W}, {CLAMPED}, {PLANNED}, members AS (SELECT image_id, "index", x AS gx, y AS gy, unnest(ords) AS ord FROM planned)
SELECT image_id, "index", ord, c.x - gx AS x, c.y - gy AS y, w, h FROM members JOIN clamped c USING (image_id, ord)""",
    ),
    "selection_commit": (
        lambda s, d: g.commit_selection(drags(s, d), 1.5, 1.25, 960, 420),
        """WITH p AS (SELECT event_id AS id, (event_id * 37 % 600)::DOUBLE AS ax, (event_id * 53 % 330)::DOUBLE AS ay, (event_id * 71 % 650)::DOUBLE AS bx, (event_id * 97 % 350)::DOUBLE AS by_ FROM events),
q AS (SELECT id, greatest(0, CAST(floor(least(ax, bx) * 1.5 + 0.5) AS BIGINT)) AS x, greatest(0, CAST(floor(least(ay, by_) * 1.25 + 0.5) AS BIGINT)) AS y,
  CAST(floor(abs(bx - ax) * 1.5 + 0.5) AS BIGINT) AS w, CAST(floor(abs(by_ - ay) * 1.25 + 0.5) AS BIGINT) AS h FROM p)
SELECT * FROM (SELECT id, x, y, least(w, 960 - x) AS w, least(h, 420 - y) AS h FROM q) WHERE w >= 2 AND h >= 2""",
    ),
    "region_upsert": (
        lambda s, d: g.put_region(regions(s, d), edits(s, d)),
        f"""{W}, e AS (SELECT image_id, CASE WHEN ord = 1 THEN ord END AS ord, x + 1 AS x, y, 33 AS w, h % 5 AS h FROM regions WHERE ord <= 2 AND image_id % 3 = 0)
SELECT r.image_id, r.ord, coalesce(e.x, r.x) AS x, coalesce(e.y, r.y) AS y, coalesce(e.w, r.w) AS w, coalesce(e.h, r.h) AS h FROM regions r LEFT JOIN e ON r.image_id = e.image_id AND r.ord = e.ord
UNION ALL SELECT e.image_id, m.last + row_number() OVER (PARTITION BY e.image_id ORDER BY e.x, e.y, e.w, e.h), e.x, e.y, e.w, e.h FROM e JOIN (SELECT image_id, max(ord) AS last FROM regions GROUP BY image_id) m ON e.image_id = m.image_id WHERE e.ord IS NULL AND e.w >= 1 AND e.h >= 1""",
    ),
    "region_delete": (
        lambda s, d: g.delete_regions(regions(s, d), regions(s, d).filter("ord % 4 = 2").select("image_id", "ord")),
        f"{W} SELECT image_id, row_number() OVER (PARTITION BY image_id ORDER BY ord) AS ord, x, y, w, h FROM regions WHERE ord % 4 <> 2",
    ),
    "nms_merge": (
        lambda s, d: g.merge_matches(matches(s, d)),
        f"{W}, {CLAMPED}, {MATCHES}, {MERGED} SELECT image_id, k.x AS x, k.y AS y, k.w AS w, k.h AS h, k.score AS score, k.seed AS seed, len(k.sources) AS n_sources FROM merged WHERE k.seed OR len(k.sources) >= 2",
    ),
}
