"""Files as tables: region lists, option files, folders of frames, temporary folders; and the report files written from them.

Pixels and videos are decoded by whoever has a decoder: `decoded()` hands each file's bytes to a function and takes rows.
"""

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

REGION = "x string, y string, w string, h string"


def region_file(spark: SparkSession, path: str) -> DataFrame:
    """image_id (the file), ord, x, y, w, h as text, of JSON files that are arrays of regions; ord is the place in the array.
    operators.geometry.normalize() casts them."""
    return parse_regions(spark.read.text(path, wholetext=True).select(F.input_file_name().alias("image_id"), "value"))


def parse_regions(texts: DataFrame) -> DataFrame:
    """texts(image_id, value: JSON) -> image_id, ord, x, y, w, h as text."""
    whole = texts.select("image_id", F.from_json("value", f"array<struct<{REGION.replace(' string', ':string')}>>").alias("rs"))
    return whole.select("image_id", F.posexplode("rs").alias("ord", "r")).select("image_id", (F.col("ord") + 1).cast("long").alias("ord"), "r.*")


def option_file(spark: SparkSession, path: str) -> DataFrame:
    """key, value of JSON files that are one object; values as text."""
    whole = spark.read.text(path, wholetext=True).select(F.from_json("value", "map<string,string>").alias("m"))
    return whole.select(F.explode("m").alias("key", "value"))


def preset_file(spark: SparkSession, path: str) -> DataFrame:
    """ord, name, options (a map) of JSON files that are arrays of presets."""
    return parse_presets(spark.read.text(path, wholetext=True))


def parse_presets(texts: DataFrame, *keys: str) -> DataFrame:
    """texts(value: JSON, keys...) -> keys, ord, name, options; a value that is no array has no rows."""
    lists = texts.filter(F.ltrim("value").startswith("["))  # Spark takes an object for an array of one
    whole = lists.select(*keys, F.from_json("value", "array<struct<name:string,options:map<string,string>>>").alias("ps"))
    return whole.select(*keys, F.posexplode("ps").alias("ord", "p")).select(*keys, F.col("ord").cast("long").alias("ord"), "p.name", "p.options")


def chosen_options(requests: DataFrame) -> DataFrame:
    """requests(request_id, file, fallback: JSON objects as text) -> request_id, key, value: the file's, or where it is null the
    fallback's."""
    whole = requests.select("request_id", F.from_json(F.coalesce("file", "fallback"), "map<string,string>").alias("m"))
    return whole.select("request_id", F.explode("m").alias("key", "value"))


def painter_config(configs: DataFrame) -> DataFrame:
    """configs(request_id, hd_strategy, resize_limit) -> request_id, json: what the painter's own file holds."""
    return configs.select("request_id", F.to_json(F.struct("hd_strategy", F.col("resize_limit").alias("hd_strategy_resize_limit"))).alias("json"))


def file_catalog(spark: SparkSession, path: str, pattern: str = "*") -> DataFrame:
    """name, modified, length of a folder's files; no file is read, as Spark prunes the content."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", pattern).load(path)
    return files.select(F.element_at(F.split("path", "/"), -1).alias("name"), F.col("modificationTime").alias("modified"), "length")


def frame_folder(spark: SparkSession, path: str, pattern: str = "*.png") -> DataFrame:
    """video_id (the folder), n (the number that is the file's name), content."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", pattern).option("recursiveFileLookup", "true").load(path)
    parts = F.split("path", "/")
    number = F.regexp_extract(F.element_at(parts, -1), r"^(\d+)\.", 1)
    return files.filter(number != "").select(F.element_at(parts, -2).alias("video_id"), number.cast("long").alias("n"), "content")


def decoded(files: DataFrame, decode: Callable[[bytes], list[dict]], schema: str, keys: list[str]) -> DataFrame:
    """keys and schema: the rows that decode() makes of each content, such as pixels of an image.  A file that it makes none
    of, or a null content, has no rows."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for at in range(len(batch)):
                row = batch.iloc[at]
                made = pd.DataFrame([] if row["content"] is None else decode(bytes(row["content"])))
                if len(made):
                    yield made.assign(**{k: row[k] for k in keys})[[*keys, *[c.split()[0] for c in schema.split(", ")]]]

    types = ", ".join(f"{k} {files.schema[k].dataType.simpleString()}" for k in keys)
    return files.select(*keys, "content").mapInPandas(run, f"{types}, {schema}")


def write_manifest(runs: DataFrame, path: str) -> None:
    """One JSON line for each run."""
    runs.write.mode("overwrite").json(path)


def write_report(markdown: DataFrame, path: str) -> None:
    """markdown(markdown), of one row, as a text file."""
    markdown.select("markdown").coalesce(1).write.mode("overwrite").text(path)
