"""Queries on configurations: name -> (query, SQL on the same tables)."""

from pyspark.sql import functions as F

from ..operators import config as c
from ..sources.tables import table

KEYS = ["skip", "output_quality", "segmenter_threshold", "propainter_fp16", "mask_shape", "resize_limit", "unknown_key"]


def requests(spark, sf_dir):
    engine = F.expr("CASE event_id % 3 WHEN 0 THEN 'lama_fast' WHEN 1 THEN 'propainter_quality' ELSE 'other' END")
    return table(spark, sf_dir, "events").select(F.col("event_id").alias("request_id"), engine.alias("engine"))


def overrides(spark, sf_dir):
    e = table(spark, sf_dir, "events")
    key = F.element_at(F.array(*[F.lit(k) for k in KEYS]), (F.col("event_id") % len(KEYS) + 1).cast("int"))
    raw = F.expr("CASE event_id % 5 WHEN 0 THEN cast(event_id % 3000 AS string) WHEN 1 THEN ' 7 ' WHEN 2 THEN 'hf_segmenter' WHEN 3 THEN 'no' ELSE '0.3' END")
    return e.select(F.col("event_id").alias("request_id"), key.alias("key"), raw.alias("raw"))


_KEYS = "[" + ", ".join(f"'{k}'" for k in KEYS) + "]"
_FIELDS = ", ".join(f"('{engine}', '{k}', '{v}')" for engine, own in c.ENGINES.items() for k, v in (c.COMMON | own | {"key": engine}).items())
_LIMITS = ", ".join(f"('{k}', '{kind}', {'NULL' if lo is None else lo}, {'NULL' if hi is None else hi}, {'NULL' if a is None else '[' + ', '.join(repr(x) for x in a) + ']'})" for k, kind, lo, hi, a in c.LIMITS)
REQUESTS = f"""requests AS (SELECT event_id AS request_id, CASE event_id % 3 WHEN 0 THEN 'lama_fast' WHEN 1 THEN 'propainter_quality' ELSE 'other' END AS engine FROM events),
overrides AS (SELECT event_id AS request_id, {_KEYS}[event_id % {len(KEYS)} + 1] AS key, CASE event_id % 5 WHEN 0 THEN CAST(event_id % 3000 AS VARCHAR) WHEN 1 THEN ' 7 ' WHEN 2 THEN 'hf_segmenter' WHEN 3 THEN 'no' ELSE '0.3' END AS raw FROM events),
fields(engine, key, value) AS (VALUES {_FIELDS}), limits(key, kind, lo, hi, allowed) AS (VALUES {_LIMITS})"""


def _seconds(spark, sf_dir):
    return table(spark, sf_dir, "events").select("event_id", (F.col("event_id") * 7 % 9000 - 5).cast("double").alias("seconds"))


def profiles(spark, sf_dir):
    name = lambda names, m: F.element_at(F.array(*[F.lit(n) for n in names]), (F.col("event_id") % m % len(names) + 1).cast("int"))
    return table(spark, sf_dir, "events").select(
        F.col("event_id").alias("request_id"), name(["propainter", "lama"], 5).alias("family"), name([*c.MASK_PRESETS, "x"], 11).alias("mask_profile"), name([*c.CROP_PRESETS, "y"], 7).alias("crop_profile")
    )


_MASKS = ", ".join(f"('{p}', '{k}', '{v}')" for p, o in c.MASK_PRESETS.items() for k, v in o.items())
_CROPS = ", ".join(f"('{p}', '{k}', '{v}')" for p, o in c.CROP_PRESETS.items() for k, v in o.items())
_NAMES = lambda names, m: "[" + ", ".join(f"'{n}'" for n in names) + f"][event_id % {m} % {len(names)} + 1]"

QUERIES = {
    "engine_metadata": (
        lambda s, d: c.engines_of(requests(s, d)),
        f"WITH {REQUESTS}, seen AS (SELECT engine, " + ", ".join(f"max(value) FILTER (key = '{k}') AS {k}" for k in c.METADATA) + " FROM fields GROUP BY engine) SELECT request_id, seen.* FROM requests r JOIN seen ON seen.engine = CASE r.engine WHEN 'other' THEN 'lama_fast' ELSE r.engine END",
    ),
    "config_resolve": (
        lambda s, d: c.resolve(requests(s, d), overrides(s, d)),
        rf"""WITH {REQUESTS}, good AS (SELECT request_id, key, CASE kind
   WHEN 'int' THEN CASE WHEN regexp_full_match(trim(raw), '[+-]?[0-9]+') THEN CAST(greatest(CAST(lo AS BIGINT), least(CAST(hi AS BIGINT), CAST(trim(raw) AS BIGINT))) AS VARCHAR) END
   WHEN 'float' THEN CASE WHEN regexp_full_match(trim(raw), '[+-]?([0-9]+\.?[0-9]*|\.[0-9]+)') THEN CAST(greatest(CAST(lo AS DOUBLE), least(CAST(hi AS DOUBLE), CAST(trim(raw) AS DOUBLE))) AS VARCHAR) END
   WHEN 'bool' THEN CASE WHEN lower(trim(raw)) IN ('0', 'false', 'no', 'off', '') THEN 'false' ELSE 'true' END
   ELSE CASE WHEN list_contains(allowed, raw) THEN raw END END AS value FROM overrides JOIN limits USING (key))
SELECT r.request_id, f.key, coalesce(g.value, f.value) AS value FROM (SELECT request_id, CASE WHEN engine = 'other' THEN 'lama_fast' ELSE engine END AS engine FROM requests) r JOIN fields f USING (engine)
LEFT JOIN good g ON g.request_id = r.request_id AND g.key = f.key""",
    ),
    "bool_coerce": (
        lambda s, d: overrides(s, d).select("request_id", c.truth(F.col("raw")).alias("truth")),
        f"WITH {REQUESTS} SELECT request_id, lower(trim(raw)) NOT IN ('0', 'false', 'no', 'off', '') AS truth FROM overrides",
    ),
    "preset_overlay": (
        lambda s, d: c.preset_options(profiles(s, d)),
        f"""WITH m(p, key, value) AS (VALUES {_MASKS}), c(p, key, value) AS (VALUES {_CROPS}),
r AS (SELECT event_id AS request_id, {_NAMES(["propainter", "lama"], 5)} AS family, {_NAMES([*c.MASK_PRESETS, "x"], 11)} AS mp, {_NAMES([*c.CROP_PRESETS, "y"], 7)} AS cp FROM events),
k AS (SELECT request_id, CASE WHEN mp = 'x' THEN 'hybrid_segmenter' ELSE mp END AS mp, CASE WHEN cp = 'y' THEN 'balanced' ELSE cp END AS cp FROM r WHERE family = 'propainter'),
o AS (SELECT request_id, key, value, 1 AS late FROM k JOIN m ON m.p = k.mp UNION ALL SELECT request_id, key, value, 2 FROM k JOIN c ON c.p = k.cp)
SELECT request_id, key, arg_max(value, late) AS value FROM o GROUP BY request_id, key""",
    ),
    "engine_options": (
        lambda s, d: c.engine_options(requests(s, d).withColumn("options", F.expr("""CASE request_id % 4 WHEN 0 THEN '{"skip":"2"}' WHEN 1 THEN '{"lama_fast":{"skip":3},"propainter_quality":{"skip":5}}' WHEN 2 THEN NULL ELSE '{"lama_fast":{"skip":4}}' END"""))),
        """WITH r AS (SELECT event_id AS request_id, event_id % 4 AS k, event_id % 3 AS e FROM events)
SELECT request_id, CASE WHEN k = 0 THEN '{"skip":"2"}' WHEN k = 2 THEN '{}' WHEN k = 1 THEN CASE e WHEN 0 THEN '{"skip":3}' WHEN 1 THEN '{"skip":5}' ELSE '{}' END ELSE CASE e WHEN 0 THEN '{"skip":4}' ELSE '{}' END END AS options FROM r""",
    ),
    "engine_select": (
        lambda s, d: c.pick_engine(requests(s, d), c.engine_fields(s)),
        "SELECT event_id AS request_id, CASE event_id % 3 WHEN 1 THEN 'propainter_quality' ELSE 'lama_fast' END AS engine FROM events",
    ),
    "mask_shape_label": (
        lambda s, d: overrides(s, d).select("request_id", c.shape_label(F.col("raw")).alias("label")),
        f"WITH {REQUESTS} SELECT request_id, CASE raw WHEN 'hf_segmenter' THEN 'HF Universal' ELSE 'Glyph / Auto' END AS label FROM overrides",
    ),
    "duration_label": (
        lambda s, d: _seconds(s, d).select("event_id", F.coalesce(c.duration_label(F.col("seconds")), F.lit("none")).alias("label")),
        """WITH s AS (SELECT event_id, event_id * 7 % 9000 - 5 AS s FROM events) SELECT event_id, CASE WHEN s <= 0 THEN 'none' WHEN s >= 3600 THEN (s // 3600)::VARCHAR || ' h ' || floor((s % 3600) / 60.0 + 0.5)::BIGINT::VARCHAR || ' min'
 WHEN s >= 60 THEN (s // 60)::VARCHAR || ' min ' || (s % 60)::VARCHAR || ' s' ELSE s::VARCHAR || ' s' END AS label FROM s""",
    ),
    "processing_estimate": (
        lambda s, d: c.estimate(_seconds(s, d).select(F.col("event_id").alias("video_id"), F.greatest(F.lit(1.0), "seconds").alias("duration")), c.engine_fields(s)).select("video_id", "engine", "seconds"),
        "SELECT event_id AS video_id, engine, greatest(1.0::DOUBLE, (event_id * 7 % 9000 - 5)::DOUBLE) * times AS seconds FROM events, (VALUES ('lama_fast', 4.9::DOUBLE), ('propainter_quality', 19.0::DOUBLE)) e(engine, times)",
    ),
}
