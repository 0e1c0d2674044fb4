"""Video metadata from probe texts, cleaning rules, and summaries of runs."""

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.boxes import thousandths

PROBE = "struct<streams:array<struct<codec_type:string,width:int,height:int,avg_frame_rate:string>>,format:struct<duration:string>>"
STATUSES = ["safe", "tight", "risky", "empty"]
# Names of temporary outputs.
OUTPUTS = r"^(output_.*\.mp4|frame_.*\.jpg|reference_.*\.jpg|mask_preview_.*\.png|crop_preview_.*\.png|crop_group_.*\.png)$"
UPLOAD = r"^[0-9a-fA-F-]{36}(\.[^.]*)?$"


def parse_probe(texts: DataFrame) -> DataFrame:
    """texts(id, probe: JSON) -> id, width, height, duration, fps of the first video stream; without one no row."""
    parsed = texts.withColumn("p", F.from_json("probe", PROBE)).withColumn("s", F.filter("p.streams", lambda s: s["codec_type"] == "video"))
    first = parsed.filter(F.size("s") > 0).withColumn("s", F.element_at("s", 1)).withColumn("rate", F.split("s.avg_frame_rate", "/"))
    over, under = F.expr("try_cast(rate[0] AS INT)"), F.expr("try_cast(get(rate, 1) AS INT)")
    fps = F.when(under != 0, thousandths(over / under)).otherwise(0.0)
    return first.select(
        "id", F.coalesce("s.width", F.lit(0)).cast("long").alias("width"), F.coalesce("s.height", F.lit(0)).cast("long").alias("height"),
        F.coalesce(F.expr("try_cast(p.format.duration AS DOUBLE)"), F.lit(0.0)).alias("duration"), F.coalesce(fps, F.lit(0.0)).alias("fps"),
    )


def parse_log(texts: DataFrame) -> DataFrame:
    """texts(id, log) -> id, width, height, duration, fps from an encoder's log; without a size no row."""
    grab = lambda pattern, k: F.regexp_extract("log", pattern, k)
    size, rate, long = r"(\d{2,5})x(\d{2,5})", r"(\d+(?:\.\d+)?)\s*fps", r"Duration:\s*(\d+):(\d+):(\d+(?:\.\d+)?)"
    number = lambda c, kind: F.coalesce(F.nullif(c, F.lit("")).cast(kind), F.lit(0).cast(kind))
    duration = number(grab(long, 1), "long") * 3600 + number(grab(long, 2), "long") * 60 + number(grab(long, 3), "double")
    found = texts.select("id", number(grab(size, 1), "long").alias("width"), number(grab(size, 2), "long").alias("height"), duration.alias("duration"), number(grab(rate, 1), "double").alias("fps"))
    return found.filter("width > 0 AND height > 0")


def first_known(ids: DataFrame, probed: DataFrame, logged: DataFrame) -> DataFrame:
    """ids(id) with the probe's record, else the log's, else zeros; and whether all of it is usable."""
    fields = ("width", "height", "duration", "fps")
    pick = lambda df, tag: df.select("id", F.struct(*fields).alias(tag))
    both = ids.join(pick(probed, "a"), "id", "left").join(pick(logged, "b"), "id", "left").withColumn("v", F.coalesce("a", "b"))
    out = both.select("id", *[F.coalesce(f"v.{f}", F.lit(0)).alias(f) for f in fields])
    return out.withColumn("valid", F.expr("width > 0 AND height > 0 AND duration > 0 AND fps > 0"))


def stale(files: DataFrame, now: Column, hours: int = 1) -> DataFrame:
    """files(name, is_dir, modified) that may go: work folders, known outputs and uploads older than that."""
    old = F.col("modified") < now - F.expr(f"INTERVAL {hours} HOUR")
    known = F.when(F.col("is_dir"), F.col("name").startswith("ai_")).otherwise(F.col("name").rlike(OUTPUTS) | F.col("name").rlike(UPLOAD))
    return files.filter(old & known)


def clip_key(path: Column, offset: Column, duration: Column) -> Column:
    """Name of a cached clip: a digest of the source, and both times in milliseconds."""
    part = lambda v: F.lpad((v * 1000).cast("int").cast("string"), 6, "0")
    return F.concat(F.lit("probe_v2_"), F.substring(F.md5(path), 1, 10), F.lit("_o"), part(offset), F.lit("_d"), part(duration), F.lit(".mp4"))


def status_counts(summaries: DataFrame) -> DataFrame:
    """image_id and how many of its crops have each status, zeros included."""
    return summaries.groupBy("image_id").agg(*[F.count_if(F.col("status") == s).alias(s) for s in STATUSES])


def sweep_summary(runs: DataFrame) -> DataFrame:
    """Largest values over all runs(crop_area_pct, risky_groups, empty_groups); 0 without runs."""
    return runs.agg(*[F.coalesce(F.max(c), F.lit(0)).alias(f"max_{c}") for c in ("crop_area_pct", "risky_groups", "empty_groups")], F.count("*").alias("n_runs"))


def sweep_markdown(runs: DataFrame, engine: str = "", clip_seconds: str = "") -> DataFrame:
    """One row, markdown: a table of the runs(offset, ...) by offset, of which a sweep has a few, and the summary below; with an
    engine, also the head that names it, the clip's duration and the offsets."""
    line = F.format_string("| `%ss` | `%.3f` | `%d` | `%.3f` | `%d` | `%d` |", F.col("offset").cast("string"), thousandths(F.col("mask_coverage")), "crop_groups", thousandths(F.col("crop_area_pct")), "risky_groups", "empty_groups")
    lines = runs.select("offset", line.alias("line")).agg(F.sort_array(F.collect_list(F.struct("offset", "line"))).alias("ls"))
    head = "| Offset | Mask % | Crop groups | Crop area % | Risky | Empty |\n|---|---:|---:|---:|---:|---:|\n"
    tail = F.format_string("\n\n- Max crop area: `%.3f%%`\n- Max risky groups: `%d`\n- Max empty groups: `%d`\n", "max_crop_area_pct", "max_risky_groups", "max_empty_groups")
    both = lines.crossJoin(sweep_summary(runs))
    offsets = F.array_join(F.transform("ls", lambda x: F.concat(x["offset"].cast("string"), F.lit("s"))), ", ")
    title = F.concat(F.lit(f"# Local Quality Probe Sweep\n\n- Engine: `{engine}`\n- Clip duration: `{clip_seconds}s`\n- Offsets: `"), offsets, F.lit("`\n\n"))
    return both.select(F.concat(title if engine else F.lit(""), F.lit(head), F.array_join(F.transform("ls", lambda x: x["line"]), "\n"), tail).alias("markdown"))


def preset_runs(presets: DataFrame, clips: DataFrame, start: int = 0) -> DataFrame:
    """presets(ord, name) from start on, each with every clip."""
    return clips.crossJoin(F.broadcast(presets.filter(F.col("ord") >= start)))


def largest_crop(groups: DataFrame) -> DataFrame:
    """image_id, index, w, h, area: each image's largest crop, the first of equals."""
    best = groups.groupBy("image_id").agg(F.max(F.struct((F.col("w") * F.col("h")).alias("area"), (-F.col("index")).alias("back"), "w", "h")).alias("b"))
    return best.select("image_id", (-F.col("b.back")).alias("index"), "b.w", "b.h", "b.area")


def last_json(outputs: DataFrame, schema: str) -> DataFrame:
    """outputs(id, stdout) with result: the last line that is not blank, as JSON."""
    lines = F.filter(F.transform(F.split("stdout", "\n"), lambda x: F.trim(x)), lambda x: x != "")
    return outputs.filter(F.size(lines) > 0).select("id", F.from_json(F.element_at(lines, -1), schema).alias("result"))


def top_runs(runs: DataFrame, keys: list[str], n: int) -> DataFrame:
    """The n runs of each key with the least risky, then empty groups, then crop area."""
    order = Window.partitionBy(*keys).orderBy("risky_groups", "empty_groups", "crop_area_pct", "offset")
    return runs.withColumn("place", F.row_number().over(order).cast("long")).filter(F.col("place") <= n)


def summary_line(analyses: DataFrame) -> DataFrame:
    """analyses(image_id, ...) -> image_id, line: the seven fields of a probe's last line, as JSON."""
    fields = ("run_dir", "engine", "mask_coverage", "crop_groups", "crop_area_pct", "risky_groups", "empty_groups")
    return analyses.select("image_id", F.to_json(F.struct(*fields)).alias("line"))
