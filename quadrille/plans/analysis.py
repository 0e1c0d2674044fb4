"""The whole quality analysis of images, from raw regions to a report, in one plan: name -> (query, SQL on the same tables)."""

import re

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..operators import config as c
from ..operators import geometry as g
from ..operators import raster as r
from ..operators import reports as p
from ..sources.shared import cut, in_parts
from ..sources import files as f
from ..sources.tables import HEIGHT, PIXELS, REGIONS, WIDTH, table
from ..sources.tables import regions as table_regions
from .geometry import CLAMPED, DEDUPED, PLAN, PLANNED, raw_regions
from .raster import POINTS, RELAXED, SUMMED, TIGHTENED, points

STATUS = ("safe", "tight", "risky", "empty")


def merged(spark, sf_dir):
    return g.dedupe(g.clamp_regions(g.normalize(raw_regions(spark, sf_dir)), WIDTH, HEIGHT))


def regrouped(regions, mask):
    """Crops around the mask in each region, with more room where the mask comes near their sides, and what they hold then."""
    spread = lambda df: in_parts(df, "image_id", regions)
    planned = spread(g.plan_crops(spread(r.tighten(spread(regions), mask, WIDTH, HEIGHT)), **PLAN))
    relaxed = cut(r.relax_crops(cut(r.summarize_crops(planned, mask, WIDTH, HEIGHT), "summed"), WIDTH, HEIGHT, "region_count").drop("status"), "relaxed")
    return r.summarize_crops(spread(relaxed), mask, WIDTH, HEIGHT)


def analysis(spark, sf_dir):
    """image_id, the counts of regions and of crops by status, their area, the mask's coverage and box, and the crops as JSON."""
    raw = g.normalize(raw_regions(spark, sf_dir)).withColumn("base_region_count", F.count("*").over(Window.partitionBy("image_id")))
    regions = cut(g.dedupe(g.clamp_regions(raw, WIDTH, HEIGHT), g.DEDUPE_IOU, "base_region_count"), "merged")
    kept = in_parts(regions, "image_id").groupBy("image_id").agg(F.max("base_region_count").alias("base_region_count"), F.count("*").alias("merged_region_count"))
    crop = F.struct("index", "x", "y", "w", "h", "region_count", "status", "min_margin_px")
    crops = cut(regrouped(regions.drop("base_region_count"), points(spark, sf_dir)), "crops")
    groups = in_parts(crops, "image_id", regions).groupBy("image_id").agg(
        F.count("*").alias("crop_groups"), *[F.count_if(F.col("status") == s).alias(s) for s in STATUS], F.sum(F.col("w") * F.col("h")).alias("crop_area_total"),
        F.to_json(F.sort_array(F.collect_list(crop))).alias("crops"),
    )
    inside = points(spark, sf_dir).filter((F.col("px") < WIDTH) & (F.col("py") < HEIGHT))
    mask = inside.groupBy("image_id").agg(F.count("*").alias("n"), F.min("px").alias("mask_x0"), F.min("py").alias("mask_y0"), (F.max("px") + 1).alias("mask_x1"), (F.max("py") + 1).alias("mask_y1"))
    both = kept.join(groups, "image_id").join(mask, "image_id", "left")
    pct = lambda v: F.rint(v / (WIDTH * HEIGHT) * 100 * 1000) / 1000
    zero = lambda n: F.coalesce(F.col(n), F.lit(0)).alias(n)
    return both.select(
        "image_id", "base_region_count", "merged_region_count", "crop_groups", *STATUS, "crop_area_total", pct(F.col("crop_area_total")).alias("crop_area_pct"),
        pct(F.coalesce("n", F.lit(0))).alias("mask_coverage"), *[zero(f"mask_{e}") for e in ("x0", "y0", "x1", "y1")], "crops",
    )


def lines(spark, sf_dir):
    a = analysis(spark, sf_dir)
    return p.summary_line(a.select("image_id", F.concat(F.lit("run-"), "image_id").alias("run_dir"), F.lit("lama_fast").alias("engine"), "mask_coverage", "crop_groups", "crop_area_pct", F.col("risky").alias("risky_groups"), F.col("empty").alias("empty_groups")))


def adopted(spark, sf_dir):
    """Regions that detection proposes take the place of an image's own where they are not fewer."""
    own = g.clamp_regions(g.normalize(raw_regions(spark, sf_dir)), WIDTH, HEIGHT)
    return g.adopt(own.filter("ord % 2 = 0"), merged(spark, sf_dir))


def proposals(regions):
    """Stands for a detector: each region is found once more, further to the right."""
    return regions.select("image_id", (F.col("x") + 40).alias("x"), "y", "w", "h").filter(F.col("x") + F.col("w") <= WIDTH)


def region_json(spark, sf_dir):
    """image_id, value: an image's regions as the JSON array of a region file."""
    entry = F.struct("ord", F.struct("x", "y", "w", "h").alias("r"))
    whole = table_regions(spark, sf_dir).groupBy("image_id").agg(F.sort_array(F.collect_list(entry)).alias("rs"))
    return whole.select("image_id", F.to_json(F.transform("rs", lambda r: r["r"])).alias("value"))


def preset_json(spark, sf_dir):
    """key, value: two presets as a JSON array, or for every fifth nation an object that is none."""
    key = F.col("n_nationkey").cast("long")
    two = F.format_string('[{"name":"a%d","options":{"k":"%d","m":"x"}},{"name":"b","options":{"k":"%d"}}]', key, key, key + 1)
    return table(spark, sf_dir, "nation").select(key.alias("key"), F.when(key % 5 > 0, two).otherwise('{"name":"c"}').alias("value"))


def option_json(spark, sf_dir):
    i = F.col("o_orderkey")
    return table(spark, sf_dir, "orders").select(i.alias("request_id"), F.when(i % 3 > 0, F.format_string('{"skip":"%d"}', i % 9)).alias("file"), F.format_string('{"skip":"0","mode":"%d"}', i % 4).alias("fallback"))


def again(text: str, *names: str) -> str:
    """The same steps under other names."""
    return re.sub(rf"\b({'|'.join(names)})\b", r"\g<1>_2", text)


OWN = CLAMPED.replace("FROM regions", "FROM (SELECT * FROM regions WHERE ord % 5 <> 0 AND ord % 7 <> 3 AND ord % 11 <> 4)")
GROUPS = f"""{OWN}, {DEDUPED}, {POINTS}, {TIGHTENED.replace("FROM clamped", "FROM deduped")}, {PLANNED.replace("FROM clamped", "FROM tightened")}, {SUMMED.replace("found", "held")}, {RELAXED},
planned_2 AS (SELECT r.image_id, r."index", CASE WHEN keep THEN ox ELSE x0 END AS x, CASE WHEN keep THEN oy ELSE y0 END AS y, CASE WHEN keep THEN ow ELSE x1 - x0 END AS w, CASE WHEN keep THEN oh ELSE y1 - y0 END AS h, region_count, ords
  FROM (SELECT *, status = 'safe' OR x1 <= x0 OR y1 <= y0 AS keep FROM relaxed) r JOIN planned USING (image_id, "index")),
{again(SUMMED, "planned", "found", "sides", "limits", "more", "summed")}"""
ANALYSIS = f"""{GROUPS},
raw AS (SELECT image_id, count(*) AS base_region_count FROM regions WHERE ord % 5 <> 0 AND ord % 7 <> 3 AND ord % 11 <> 4 GROUP BY image_id),
kept AS (SELECT image_id, count(*) AS merged_region_count FROM deduped GROUP BY image_id),
grouped AS (SELECT image_id, count(*) AS crop_groups, {", ".join(f"count(*) FILTER (status = '{s}') AS {s}" for s in STATUS)}, CAST(sum(w * h) AS BIGINT) AS crop_area_total,
  CAST(to_json(list(struct_pack("index" := "index", x := x, y := y, w := w, h := h, region_count := region_count, status := status, min_margin_px := min_margin_px) ORDER BY "index")) AS VARCHAR) AS crops FROM summed_2 GROUP BY image_id),
mask AS (SELECT image_id, count(*) AS n, min(px) AS mask_x0, min(py) AS mask_y0, max(px) + 1 AS mask_x1, max(py) + 1 AS mask_y1 FROM points WHERE px < {WIDTH} AND py < {HEIGHT} GROUP BY image_id),
analysis AS (SELECT image_id, base_region_count, merged_region_count, crop_groups, {", ".join(STATUS)}, crop_area_total, round_even(crop_area_total::DOUBLE / {WIDTH * HEIGHT} * 100 * 1000, 0) / 1000 AS crop_area_pct,
  round_even(coalesce(n, 0)::DOUBLE / {WIDTH * HEIGHT} * 100 * 1000, 0) / 1000 AS mask_coverage, coalesce(mask_x0, 0) AS mask_x0, coalesce(mask_y0, 0) AS mask_y0, coalesce(mask_x1, 0) AS mask_x1, coalesce(mask_y1, 0) AS mask_y1, crops
  FROM raw JOIN kept USING (image_id) JOIN grouped USING (image_id) LEFT JOIN mask USING (image_id))"""
W = f"WITH {PIXELS}, {REGIONS}"


def grown(src: str, dst: str) -> str:
    """A pass: the regions and those found from them, without what overlaps an earlier one, six at most."""
    return f"""{dst}_all AS (SELECT image_id, row_number() OVER (PARTITION BY image_id ORDER BY o, y, x, w, h) AS ord, x, y, w, h FROM (
  SELECT image_id, ord AS o, x, y, w, h FROM {src} UNION ALL SELECT image_id, 1073741824, x + 40, y, w, h FROM {src} WHERE x + 40 + w <= {WIDTH})),
{re.sub(r"\b(lists|deduped)\b", dst + r"_\1", DEDUPED.replace("FROM clamped", f"FROM {dst}_all"))}, {dst} AS (SELECT * FROM {dst}_deduped WHERE ord <= 6)"""


QUERIES = {
    "quality_analysis": (analysis, f"{W}, {ANALYSIS} SELECT * FROM analysis"),
    "quality_summary_line": (
        lines,
        f"""{W}, {ANALYSIS} SELECT image_id, CAST(to_json(struct_pack(run_dir := 'run-' || image_id, engine := 'lama_fast', mask_coverage := mask_coverage, crop_groups := crop_groups, crop_area_pct := crop_area_pct, risky_groups := risky, empty_groups := "empty")) AS VARCHAR) AS line FROM analysis""",
    ),
    "regions_adopt": (
        adopted,
        f"""{W}, {OWN}, {DEDUPED}, own AS (SELECT * FROM clamped WHERE ord % 2 = 0), a AS (SELECT image_id, count(*) AS n FROM own GROUP BY image_id), b AS (SELECT image_id, count(*) AS m FROM deduped GROUP BY image_id),
better AS (SELECT image_id FROM b LEFT JOIN a USING (image_id) WHERE m >= coalesce(n, 0))
SELECT image_id, ord, x, y, w, h FROM own WHERE image_id NOT IN (SELECT image_id FROM better) UNION ALL SELECT image_id, ord, x, y, w, h FROM deduped WHERE image_id IN (SELECT image_id FROM better)""",
    ),
    "region_select": (
        lambda s, d: g.select_region(g.clamp_regions(g.normalize(raw_regions(s, d)), WIDTH, HEIGHT), table(s, d, "orders").select(F.col("o_orderkey").alias("image_id"), (F.col("o_orderkey") % 6 + 1).alias("ord"))),
        f"{W}, {OWN} SELECT c.* FROM clamped c JOIN orders ON o_orderkey = image_id AND ord = o_orderkey % 6 + 1",
    ),
    "requests_with_regions": (
        lambda s, d: g.refuse_empty(table(s, d, "orders").select(F.col("o_orderkey").alias("image_id")), g.clamp_regions(g.normalize(raw_regions(s, d)), WIDTH, HEIGHT)),
        f"{W}, {OWN} SELECT o_orderkey AS image_id, CASE WHEN o_orderkey IN (SELECT image_id FROM clamped) THEN NULL ELSE 'no regions' END AS error FROM orders",
    ),
    "worker_counts": (
        lambda s, d: c.worker_counts(table(s, d, "orders").select(F.col("o_orderkey").alias("request_id"), F.when(F.col("o_orderstatus") == "O", "cuda").otherwise("cpu").alias("device"), (F.col("o_orderkey") % 4).alias("override"), F.when(F.col("o_orderstatus") == "O", 8).otherwise(1).cast("long").alias("usual"))),
        "SELECT o_orderkey AS request_id, CAST(CASE WHEN o_orderstatus = 'O' AND o_orderkey % 4 > 0 THEN o_orderkey % 4 WHEN o_orderstatus = 'O' THEN 8 ELSE 1 END AS BIGINT) AS workers FROM orders",
    ),
    "region_autodetect": (
        lambda s, d: g.grow_regions(g.clamp_regions(table_regions(s, d), WIDTH, HEIGHT).filter("ord <= 2"), proposals, 2, 6),
        f"{W}, {CLAMPED}, base AS (SELECT * FROM clamped WHERE ord <= 2), {grown('base', 'one')}, {grown('one', 'two')} SELECT image_id, ord, x, y, w, h FROM two",
    ),
    "region_json_array": (lambda s, d: f.parse_regions(region_json(s, d)), f"{W} SELECT image_id, ord, x::VARCHAR AS x, y::VARCHAR AS y, w::VARCHAR AS w, h::VARCHAR AS h FROM regions"),
    "preset_json_array": (
        lambda s, d: f.parse_presets(preset_json(s, d), "key").select("key", "ord", "name", F.to_json("options").alias("options")),
        """SELECT n_nationkey::BIGINT AS key, i AS ord, CASE i WHEN 0 THEN 'a' || n_nationkey ELSE 'b' END AS name, CASE i WHEN 0 THEN '{"k":"' || n_nationkey || '","m":"x"}' ELSE '{"k":"' || (n_nationkey + 1) || '"}' END AS options FROM nation, range(2) r(i) WHERE n_nationkey % 5 > 0""",
    ),
    "option_source": (
        lambda s, d: f.chosen_options(option_json(s, d)),
        """SELECT o_orderkey AS request_id, 'skip' AS key, CASE WHEN o_orderkey % 3 > 0 THEN (o_orderkey % 9)::VARCHAR ELSE '0' END AS value FROM orders UNION ALL SELECT o_orderkey, 'mode', (o_orderkey % 4)::VARCHAR FROM orders WHERE o_orderkey % 3 = 0""",
    ),
    "painter_config": (
        lambda s, d: f.painter_config(table(s, d, "orders").select(F.col("o_orderkey").alias("request_id"), F.col("o_orderstatus").alias("hd_strategy"), (F.col("o_orderkey") % 2048).alias("resize_limit"))),
        """SELECT o_orderkey AS request_id, '{"hd_strategy":"' || o_orderstatus || '","hd_strategy_resize_limit":' || (o_orderkey % 2048) || '}' AS json FROM orders""",
    ),
}
