"""Engine configurations: defaults as rows, overrides checked against limits, labels."""

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

# The keys that requests may override, with their kind and limits or allowed values.
LIMITS = [
    ("skip", "int", 1, 8, None), ("mask_padding", "int", 0, 80, None), ("mask_dilate", "int", 0, 80, None), ("feather_radius", "int", 0, 24, None),
    ("worker_count_override", "int", 0, 16, None), ("resize_limit", "int", 256, 2160, None), ("output_quality", "int", 70, 100, None),
    ("propainter_width", "int", 320, 1920, None), ("propainter_height", "int", 180, 1080, None), ("propainter_subvideo_length", "int", 8, 120, None),
    ("propainter_neighbor_length", "int", 1, 60, None), ("propainter_ref_stride", "int", 1, 80, None), ("propainter_mask_dilation", "int", 0, 120, None),
    ("propainter_crop_padding", "int", 0, 320, None), ("propainter_crop_merge_gap", "int", 0, 320, None), ("propainter_crop_max_width", "int", 128, 1920, None),
    ("propainter_crop_max_height", "int", 64, 1080, None), ("temporal_mask_samples", "int", 0, 16, None), ("temporal_mask_min_hits", "int", 1, 16, None),
    ("segmenter_threshold", "float", 0.05, 0.95, None),
    ("refine_mask", "bool", None, None, None), ("blend_skipped", "bool", None, None, None), ("propainter_fp16", "bool", None, None, None),
    ("propainter_use_crops", "bool", None, None, None), ("propainter_tighten_regions", "bool", None, None, None), ("propainter_crop_mask_boost", "bool", None, None, None),
    ("hd_strategy", "enum", None, None, ["Original", "Resize", "Crop"]), ("output_suffix", "enum", None, None, [".jpg", ".jpeg", ".png"]),
    ("mask_shape", "enum", None, None, ["auto", "hf_segmenter", "hybrid_segmenter", "temporal_hf_segmenter"]),
    ("segmenter_weights", "enum", None, None, ["segmenter.pth", "segmenter_universal.pth"]),
]
# The defaults that both engines share, and what each has of its own.
COMMON = {
    "worker_count_override": "0", "hd_strategy": "Resize", "resize_limit": "1024", "output_suffix": ".jpg", "output_quality": "99", "mask_shape": "auto", "segmenter_threshold": "0.45",
    "segmenter_weights": "segmenter.pth", "propainter_width": "960", "propainter_height": "540", "propainter_subvideo_length": "30", "propainter_neighbor_length": "10",
    "propainter_ref_stride": "10", "propainter_mask_dilation": "4", "propainter_fp16": "true", "propainter_use_crops": "false", "propainter_tighten_regions": "true",
    "propainter_crop_mask_boost": "false", "propainter_crop_padding": "64", "propainter_crop_merge_gap": "64", "propainter_crop_max_width": "1120", "propainter_crop_max_height": "640",
    "temporal_mask_samples": "0", "temporal_mask_min_hits": "2",
}
ENGINES = {
    "lama_fast": {"label": "LaMa Fast", "family": "lama", "description": "Максимально быстрый режим для длинных роликов.", "estimate_multiplier": "4.9", "skip": "4", "refine_mask": "false", "mask_padding": "8", "mask_dilate": "4", "feather_radius": "2", "blend_skipped": "true", "worker_count_override": "8"},
    "propainter_quality": {"label": "ProPainter", "family": "propainter", "description": "Video-aware quality mode с лучшей temporal consistency.", "estimate_multiplier": "19.0", "skip": "1", "refine_mask": "true", "mask_padding": "4", "mask_dilate": "3", "feather_radius": "3", "blend_skipped": "false", "resize_limit": "960", "propainter_use_crops": "true"},
}
DEFAULT_ENGINE = "lama_fast"
METADATA = [
    "key", "label", "family", "description", "estimate_multiplier", "skip", "refine_mask", "mask_shape", "segmenter_threshold", "segmenter_weights",
    "propainter_use_crops", "propainter_tighten_regions", "propainter_crop_mask_boost", "temporal_mask_samples",
]
FALSY = ["0", "false", "no", "off", ""]
# Presets of the client.
MASK_PRESETS = {
    "auto": {},
    "hf_segmenter": {"mask_shape": "hf_segmenter", "segmenter_weights": "segmenter_universal.pth", "segmenter_threshold": "0.45"},
    "temporal_hf_segmenter": {"mask_shape": "temporal_hf_segmenter", "segmenter_weights": "segmenter_universal.pth", "segmenter_threshold": "0.25", "temporal_mask_samples": "6", "temporal_mask_min_hits": "2"},
    "hybrid_segmenter": {"mask_shape": "hybrid_segmenter", "segmenter_weights": "segmenter_universal.pth", "segmenter_threshold": "0.42"},
}
CROP_PRESETS = {
    "balanced": {},
    "detail": {"propainter_crop_padding": "10", "propainter_crop_merge_gap": "4", "propainter_crop_max_width": "720", "propainter_crop_max_height": "320"},
}
SHAPE_LABELS = {"hybrid_segmenter": "Hybrid + Universal HF", "hf_segmenter": "HF Universal", "temporal_hf_segmenter": "Temporal + Universal HF"}


def engine_fields(spark: SparkSession) -> DataFrame:
    """engine, key, value: every field of every engine, as text."""
    rows = [(engine, k, v) for engine, own in ENGINES.items() for k, v in (COMMON | own | {"key": engine}).items()]
    return spark.createDataFrame(rows, "engine string, key string, value string")


def limits(spark: SparkSession) -> DataFrame:
    rows = [(k, kind, None if lo is None else float(lo), None if hi is None else float(hi), allowed) for k, kind, lo, hi, allowed in LIMITS]
    return spark.createDataFrame(rows, "key string, kind string, lo double, hi double, allowed array<string>")


def metadata(spark: SparkSession) -> DataFrame:
    """One row for each engine with the fields that clients see."""
    return engine_fields(spark).groupBy("engine").pivot("key", METADATA).agg(F.first("value"))


def engines_of(requests: DataFrame) -> DataFrame:
    """requests(request_id, engine) -> request_id and what clients see of its engine; unknown engines are the default one."""
    known = F.when(F.col("engine").isin(*ENGINES), F.col("engine")).otherwise(DEFAULT_ENGINE)
    return requests.withColumn("engine", known).join(F.broadcast(metadata(requests.sparkSession)), "engine").select("request_id", "engine", *METADATA)


def truth(value: Column) -> Column:
    """Text as a truth value: all but a few words are true."""
    return ~F.lower(F.trim(value)).isin(FALSY)


def coerce(kind: Column, raw: Column, lo: Column, hi: Column, allowed: Column) -> Column:
    """A raw override as text in its limits, or null where it is to be ignored."""
    whole = F.when(F.trim(raw).rlike(r"^[+-]?\d+$"), F.trim(raw).cast("long"))
    real = F.when(F.trim(raw).rlike(r"^[+-]?(\d+\.?\d*|\.\d+)([eE][+-]?\d+)?$"), F.trim(raw).cast("double"))
    return (
        F.when(kind == "int", F.when(whole.isNotNull(), F.greatest(lo.cast("long"), F.least(hi.cast("long"), whole)).cast("string")))
        .when(kind == "float", F.when(real.isNotNull(), F.greatest(lo, F.least(hi, real)).cast("string")))
        .when(kind == "bool", truth(raw).cast("string"))
        .when(kind == "enum", F.when(F.array_contains(allowed, raw), raw))
    )


def resolve(requests: DataFrame, overrides: DataFrame) -> DataFrame:
    """requests(request_id, engine), overrides(request_id, key, raw) -> request_id, key, value.

    Unknown engines are the default one.  Overrides with unknown keys or values that don't fit are ignored; numbers are
    brought into their limits.  The engines and limits are two dozen fixed rows each, so both are broadcast.
    """
    spark = requests.sparkSession
    known = F.when(F.col("engine").isin(*ENGINES), F.col("engine")).otherwise(DEFAULT_ENGINE)
    fields = requests.withColumn("engine", known).join(F.broadcast(engine_fields(spark)), "engine").select("request_id", "key", F.col("value").alias("default"))
    good = overrides.join(F.broadcast(limits(spark)), "key").withColumn("value", coerce(F.col("kind"), F.col("raw"), F.col("lo"), F.col("hi"), F.col("allowed")))
    good = good.filter("value IS NOT NULL").select("request_id", "key", "value")
    return fields.join(good, ["request_id", "key"], "left").select("request_id", "key", F.coalesce("value", "default").alias("value"))


def _preset(presets: dict, name: Column, default: str) -> Column:
    as_map = lambda d: F.create_map(*[F.lit(x) for kv in d.items() for x in kv]) if d else F.expr("cast(map() AS map<string,string>)")
    out = as_map(presets[default])
    for key, options in presets.items():
        out = F.when(name == key, as_map(options)).otherwise(out)
    return out


def preset_options(requests: DataFrame) -> DataFrame:
    """requests(request_id, family, mask_profile, crop_profile) -> request_id, key, value: the mask preset's options, those
    of the crop preset over them; only for the family that has presets; unknown profiles are hybrid_segmenter, balanced."""
    mask, crop = _preset(MASK_PRESETS, F.col("mask_profile"), "hybrid_segmenter"), _preset(CROP_PRESETS, F.col("crop_profile"), "balanced")
    left = F.map_filter(mask, lambda k, _: ~F.map_contains_key(crop, k))
    return requests.filter(F.col("family") == "propainter").select("request_id", F.explode(F.map_concat(left, crop)).alias("key", "value"))


def engine_options(raw: DataFrame) -> DataFrame:
    """raw(request_id, engine, options: JSON text) -> request_id, options: if any value is an object the text is one map for
    each engine, else it holds for all; no object is no options."""
    nested = F.from_json("options", "map<string,string>")
    per_engine = F.exists(F.map_values(nested), lambda v: v.startswith("{"))
    picked = F.when(per_engine, F.coalesce(F.try_element_at(nested, F.col("engine")), F.lit("{}"))).otherwise(F.when(nested.isNotNull(), F.col("options")).otherwise("{}"))
    return raw.select("request_id", F.coalesce(picked, F.lit("{}")).alias("options"))


def shape_label(shape: Column) -> Column:
    out = F.lit("Glyph / Auto")
    for key, label in SHAPE_LABELS.items():
        out = F.when(shape == key, label).otherwise(out)
    return out


def duration_label(seconds: Column) -> Column:
    """Hours and minutes, minutes and seconds, or seconds; null without a duration."""
    near = lambda v: F.floor(v + 0.5).cast("string")
    whole = lambda v: F.floor(v).cast("string")
    return (
        F.when(seconds.isNull() | (seconds <= 0), None)
        .when(seconds >= 3600, F.concat(whole(seconds / 3600), F.lit(" h "), near(seconds % 3600 / 60), F.lit(" min")))
        .when(seconds >= 60, F.concat(whole(seconds / 60), F.lit(" min "), near(seconds % 60), F.lit(" s")))
        .otherwise(F.concat(near(seconds), F.lit(" s")))
    )


def pick_engine(wanted: DataFrame, engines: DataFrame) -> DataFrame:
    """wanted(request_id, engine) -> request_id, engine: itself where there is such an engine, else the first one."""
    first = engines.agg(F.min("engine").alias("first"))
    known = engines.select("engine", F.lit(True).alias("known")).distinct()
    both = wanted.join(F.broadcast(known), "engine", "left").crossJoin(F.broadcast(first))
    return both.select("request_id", F.when(F.col("known"), F.col("engine")).otherwise(F.col("first")).alias("engine"))


def estimate(videos: DataFrame, engines: DataFrame) -> DataFrame:
    """videos(video_id, duration) by engine: video_id, engine, seconds, label of the expected processing time."""
    times = engines.filter("key = 'estimate_multiplier'").select("engine", F.col("value").cast("double").alias("times"))
    both = videos.crossJoin(F.broadcast(times)).withColumn("seconds", F.col("duration") * F.col("times"))
    return both.select("video_id", "engine", "seconds", duration_label(F.col("seconds")).alias("label"))


def worker_counts(requests: DataFrame) -> DataFrame:
    """requests(request_id, device, override, usual) -> request_id, workers: an override counts only on a GPU."""
    return requests.select("request_id", F.when((F.col("override") > 0) & (F.col("device") == "cuda"), F.col("override")).otherwise(F.col("usual")).alias("workers"))


def latest_first(rows: DataFrame, keys: list[str], order: list) -> DataFrame:
    """Of each key the first row by order."""
    return rows.withColumn("__k", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).filter("__k = 1").drop("__k")
