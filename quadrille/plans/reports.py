"""Queries on metadata and reports: name -> (query, SQL on the same tables)."""

from pyspark.sql import functions as F

from ..operators import reports as p
from ..sources.tables import table
from .geometry import PLANNED, planned
from .raster import POINTS, SUMMED, WR, summed

RUN = "struct<offset:int,mask_coverage:double,risky_groups:int>"


def probes(spark, sf_dir):
    probe = F.expr("""CASE WHEN event_id % 7 = 0 THEN '{"streams":[{"codec_type":"audio"}],"format":{}}' WHEN event_id % 11 = 0 THEN 'not json'
      ELSE concat('{"streams":[{"codec_type":"audio"},{"codec_type":"video","width":', 320 + event_id % 1600, ',"height":', 180 + event_id % 900, ',"avg_frame_rate":"', event_id % 60000, '/', event_id % 5 * 250, '"}],"format":{"duration":"', event_id % 300, '.25"}}') END""")
    return table(spark, sf_dir, "events").select(F.col("event_id").alias("id"), probe.alias("probe"))


PROBED = """probed AS (SELECT event_id AS id, 320 + event_id % 1600 AS width, 180 + event_id % 900 AS height, event_id % 300 + 0.25::DOUBLE AS duration,
  CASE WHEN event_id % 5 = 0 THEN 0.0::DOUBLE ELSE round_even((event_id % 60000)::DOUBLE / (event_id % 5 * 250) * 1000, 0) / 1000 END AS fps FROM events WHERE event_id % 7 <> 0 AND event_id % 11 <> 0)"""


def logs(spark, sf_dir):
    log = F.expr("""CASE WHEN event_id % 6 = 0 THEN 'no such file' ELSE format_string('  Duration: %02d:%02d:%02d.75, start\\n  Stream: h264, %dx%d, %d.5 fps', event_id % 3, event_id % 60, event_id % 47, 320 + event_id % 1600, 180 + event_id % 900, 20 + event_id % 40) END""")
    return table(spark, sf_dir, "events").select(F.col("event_id").alias("id"), log.alias("log"))


LOGGED = """logged AS (SELECT event_id AS id, 320 + event_id % 1600 AS width, 180 + event_id % 900 AS height, (event_id % 3) * 3600 + (event_id % 60) * 60 + event_id % 47 + 0.75::DOUBLE AS duration, 20 + event_id % 40 + 0.5::DOUBLE AS fps FROM events WHERE event_id % 6 <> 0)"""


def temp_files(spark, sf_dir):
    name = F.expr("""CASE event_id % 6 WHEN 0 THEN concat('output_', event_id, '.mp4') WHEN 1 THEN concat('ai_', event_id) WHEN 2 THEN concat(substring(md5(cast(event_id AS string)), 1, 8), '-0000-0000-0000-', substring(md5(cast(event_id AS string)), 9, 12), '.mov')
      WHEN 3 THEN concat('notes_', event_id, '.txt') WHEN 4 THEN concat('mask_preview_', event_id, '.png') ELSE concat('crop_', event_id, '.png') END""")
    return table(spark, sf_dir, "events").select(name.alias("name"), (F.col("event_id") % 6 == 1).alias("is_dir"), F.col("ts").alias("modified"))


def runs(spark, sf_dir):
    e = table(spark, sf_dir, "events")
    return e.select(
        F.col("event_id").alias("offset"), F.col("user_id").alias("clip"), (F.col("event_id") * 31 % 977 / 8.0).alias("mask_coverage"), (F.col("event_id") % 12).alias("crop_groups"),
        (F.col("event_id") * 17 % 800 / 16.0).alias("crop_area_pct"), (F.col("event_id") % 4).alias("risky_groups"), (F.col("event_id") % 3).alias("empty_groups"),
    )


RUNS = "runs AS (SELECT event_id AS \"offset\", user_id AS clip, event_id * 31 % 977 / 8.0::DOUBLE AS mask_coverage, event_id % 12 AS crop_groups, event_id * 17 % 800 / 16.0::DOUBLE AS crop_area_pct, event_id % 4 AS risky_groups, event_id % 3 AS empty_groups FROM events)"


def outputs(spark, sf_dir):
    return runs(spark, sf_dir).select(F.col("offset").alias("id"), F.concat(F.lit('start\n{"offset":'), "offset", F.lit(',"mask_coverage":'), "mask_coverage", F.lit(',"risky_groups":'), "risky_groups", F.lit("}\n  \n")).alias("stdout"))


QUERIES = {
    "probe_json_parse": (lambda s, d: p.parse_probe(probes(s, d)), f"WITH {PROBED} SELECT * FROM probed"),
    "probe_text_parse": (lambda s, d: p.parse_log(logs(s, d)), f"WITH {LOGGED} SELECT * FROM logged"),
    "video_info": (
        lambda s, d: p.first_known(table(s, d, "events").select(F.col("event_id").alias("id")), p.parse_probe(probes(s, d)), p.parse_log(logs(s, d))),
        f"""WITH {PROBED}, {LOGGED}, v AS (SELECT event_id AS id, coalesce(a.width, b.width, 0) AS width, coalesce(a.height, b.height, 0) AS height, coalesce(a.duration, b.duration, 0.0) AS duration, coalesce(a.fps, b.fps, 0.0) AS fps
  FROM events LEFT JOIN probed a ON a.id = event_id LEFT JOIN logged b ON b.id = event_id) SELECT *, width > 0 AND height > 0 AND duration > 0 AND fps > 0 AS valid FROM v""",
    ),
    "stale_files": (
        lambda s, d: p.stale(temp_files(s, d), F.lit("2024-01-15 00:00:00").cast("timestamp_ntz")),
        """WITH f AS (SELECT event_id, event_id % 6 AS k, md5(event_id::VARCHAR) AS m, ts AS modified FROM events)
SELECT CASE k WHEN 0 THEN 'output_' || event_id || '.mp4' WHEN 1 THEN 'ai_' || event_id WHEN 2 THEN substr(m, 1, 8) || '-0000-0000-0000-' || substr(m, 9, 12) || '.mov' ELSE 'mask_preview_' || event_id || '.png' END AS name, k = 1 AS is_dir, modified
FROM f WHERE k IN (0, 1, 2, 4) AND modified < TIMESTAMP '2024-01-15 00:00:00' - INTERVAL 1 HOUR""",
    ),
    "clip_cache_key": (
        lambda s, d: runs(s, d).select("offset", p.clip_key(F.concat(F.lit("/videos/"), F.col("clip"), F.lit(".mp4")), F.col("mask_coverage"), F.col("crop_area_pct")).alias("clip")),
        f"""WITH {RUNS} SELECT "offset", 'probe_v2_' || substr(md5('/videos/' || clip || '.mp4'), 1, 10) || '_o' || lpad(CAST(trunc(mask_coverage * 1000) AS INT)::VARCHAR, 6, '0') || '_d' || lpad(CAST(trunc(crop_area_pct * 1000) AS INT)::VARCHAR, 6, '0') || '.mp4' AS clip FROM runs""",
    ),
    "status_pivot": (
        lambda s, d: p.status_counts(summed(s, d)),
        f"{WR}, {PLANNED}, {POINTS}, {SUMMED} SELECT image_id, " + ", ".join(f"count(*) FILTER (status = '{x}') AS {x}" for x in p.STATUSES) + " FROM summed GROUP BY image_id",
    ),
    "sweep_summary": (
        lambda s, d: p.sweep_summary(runs(s, d)),
        f"WITH {RUNS} SELECT max(crop_area_pct) AS max_crop_area_pct, max(risky_groups) AS max_risky_groups, max(empty_groups) AS max_empty_groups, count(*) AS n_runs FROM runs",
    ),
    "sweep_markdown": (
        lambda s, d: p.sweep_markdown(runs(s, d).filter("clip = 1")),
        f"""WITH {RUNS}, r AS (SELECT * FROM runs WHERE clip = 1) SELECT '| Offset | Mask % | Crop groups | Crop area % | Risky | Empty |' || chr(10) || '|---|---:|---:|---:|---:|---:|' || chr(10)
 || coalesce(string_agg(printf('| `%ds` | `%.3f` | `%d` | `%.3f` | `%d` | `%d` |', "offset", round_even(mask_coverage * 1000, 0) / 1000, crop_groups, round_even(crop_area_pct * 1000, 0) / 1000, risky_groups, empty_groups), chr(10) ORDER BY "offset"), '')
 || printf(chr(10) || chr(10) || '- Max crop area: `%.3f%%`' || chr(10) || '- Max risky groups: `%d`' || chr(10) || '- Max empty groups: `%d`' || chr(10), coalesce(max(crop_area_pct), 0), coalesce(max(risky_groups), 0), coalesce(max(empty_groups), 0)) AS markdown FROM r""",
    ),
    "sweep_report": (
        lambda s, d: p.sweep_markdown(runs(s, d).filter("clip = 1"), "lama_fast", "5"),
        f"""WITH {RUNS}, r AS (SELECT * FROM runs WHERE clip = 1) SELECT '# Local Quality Probe Sweep' || chr(10) || chr(10) || '- Engine: `lama_fast`' || chr(10) || '- Clip duration: `5s`' || chr(10) || '- Offsets: `' || coalesce(string_agg("offset" || 's', ', ' ORDER BY "offset"), '') || '`' || chr(10) || chr(10) || '| Offset | Mask % | Crop groups | Crop area % | Risky | Empty |' || chr(10) || '|---|---:|---:|---:|---:|---:|' || chr(10)
 || coalesce(string_agg(printf('| `%ds` | `%.3f` | `%d` | `%.3f` | `%d` | `%d` |', "offset", round_even(mask_coverage * 1000, 0) / 1000, crop_groups, round_even(crop_area_pct * 1000, 0) / 1000, risky_groups, empty_groups), chr(10) ORDER BY "offset"), '')
 || printf(chr(10) || chr(10) || '- Max crop area: `%.3f%%`' || chr(10) || '- Max risky groups: `%d`' || chr(10) || '- Max empty groups: `%d`' || chr(10), coalesce(max(crop_area_pct), 0), coalesce(max(risky_groups), 0), coalesce(max(empty_groups), 0)) AS markdown FROM r""",
    ),
    "preset_cross_runs": (
        lambda s, d: p.preset_runs(table(s, d, "nation").select(F.col("n_nationkey").cast("long").alias("ord"), F.col("n_name").alias("preset")), table(s, d, "customer").select(F.col("c_custkey").alias("clip")), 18),
        "SELECT c_custkey AS clip, n_nationkey::BIGINT AS ord, n_name AS preset FROM customer, nation WHERE n_nationkey >= 18",
    ),
    "sweep_top_runs": (
        lambda s, d: p.top_runs(runs(s, d), ["clip"], 3).select("clip", "offset", "place"),
        f"""WITH {RUNS} SELECT clip, "offset", place FROM (SELECT *, row_number() OVER (PARTITION BY clip ORDER BY risky_groups, empty_groups, crop_area_pct, "offset") AS place FROM runs) WHERE place <= 3""",
    ),
    "largest_crop": (
        lambda s, d: p.largest_crop(planned(s, d)),
        f"""{WR}, {PLANNED} SELECT image_id, "index", w, h, w * h AS area FROM (SELECT *, row_number() OVER (PARTITION BY image_id ORDER BY w * h DESC, "index") AS k FROM planned) WHERE k = 1""",
    ),
    "last_json_line": (
        lambda s, d: p.last_json(outputs(s, d), RUN).select("id", "result.mask_coverage", F.col("result.risky_groups").cast("long").alias("risky_groups")),
        f'WITH {RUNS} SELECT "offset" AS id, mask_coverage, risky_groups FROM runs',
    ),
}
