"""Reading the tables, and relations derived from them that stand for regions, rasters, frames and jobs.

Each derived relation is a projection of integers (or of exact comparisons), so other engines derive the same rows; the SQL
text next to each is the same projection for an engine that has the tables as views.
"""

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .shared import in_parts

#: Frame that the derived regions lie in, and side of the derived rasters.
WIDTH, HEIGHT, SIDE = 320, 200, 8


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


LINE_ORDER = ["l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "l_extendedprice", "l_discount", "l_tax", "l_returnflag", "l_linestatus", "l_shipdate"]


def regions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """image_id, ord, x, y, w, h: the lines of an order as rectangles of an image, many of them overlapping."""
    rank = F.row_number().over(Window.partitionBy("l_orderkey").orderBy(*LINE_ORDER))
    return in_parts(table(spark, sf_dir, "lineitem").select("l_orderkey", *LINE_ORDER), "l_orderkey").select(
        F.col("l_orderkey").alias("image_id"),
        rank.cast("long").alias("ord"),
        ((F.col("l_partkey") % 5) * 48 - 10).alias("x"),
        ((F.col("l_suppkey") % 4) * 36 - 10).alias("y"),
        (F.col("l_quantity").cast("long") * 2 + 80).alias("w"),
        (F.col("l_linenumber").cast("long") * 6 + 60).alias("h"),
    )


REGIONS = f"""regions AS (
  SELECT l_orderkey AS image_id, row_number() OVER (PARTITION BY l_orderkey ORDER BY {", ".join(LINE_ORDER)}) AS ord,
         (l_partkey % 5) * 48 - 10 AS x, (l_suppkey % 4) * 36 - 10 AS y,
         CAST(l_quantity AS BIGINT) * 2 + 80 AS w, CAST(l_linenumber AS BIGINT) * 6 + 60 AS h
  FROM lineitem)"""


def pixels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """image_id, y, x, v: each vector as a raster of SIDE by SIDE values 0, 128 and 255."""
    e = F.col("e").cast("double")
    return table(spark, sf_dir, "embeddings").select("vec_id", F.posexplode("embedding").alias("pos", "e")).select(
        F.col("vec_id").alias("image_id"),
        F.floor(F.col("pos") / SIDE).cast("long").alias("y"),
        (F.col("pos") % SIDE).cast("long").alias("x"),
        F.when(e > 0.1, 255).when(e > 0.05, 128).otherwise(0).cast("long").alias("v"),
    )


PIXELS = f"""pixels AS (
  SELECT vec_id AS image_id, pos // {SIDE} AS y, pos % {SIDE} AS x,
         CAST(CASE WHEN e > 0.1 THEN 255 WHEN e > 0.05 THEN 128 ELSE 0 END AS BIGINT) AS v
  FROM (SELECT vec_id, CAST(unnest(embedding) AS DOUBLE) AS e, unnest(range(len(embedding))) AS pos FROM embeddings))"""


def frames(spark: SparkSession, sf_dir: str) -> DataFrame:
    """video_id, n, v: the events of a user as numbered frames of a video."""
    rank = F.row_number().over(Window.partitionBy("user_id").orderBy("event_id"))
    return table(spark, sf_dir, "events").select(F.col("user_id").alias("video_id"), rank.cast("long").alias("n"), F.col("value").alias("v"))


FRAMES = """frames AS (
  SELECT user_id AS video_id, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS n, value AS v FROM events)"""


def jobs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """job_id, lane, ord, status, progress, name: orders as jobs of a queue for each customer."""
    status = F.expr("""CASE WHEN o_orderstatus = 'O' THEN 'queued' WHEN o_orderstatus = 'P' THEN 'processing'
        WHEN o_orderpriority LIKE '1%' THEN 'error' WHEN o_orderpriority LIKE '2%' THEN 'cancelled' ELSE 'done' END""")
    return table(spark, sf_dir, "orders").select(
        F.col("o_orderkey").alias("job_id"),
        F.col("o_custkey").alias("lane"),
        F.row_number().over(Window.partitionBy("o_custkey").orderBy("o_orderdate", "o_orderkey")).cast("long").alias("ord"),
        status.alias("status"),
        (F.col("o_orderkey") % 101).alias("progress"),
        F.expr("CASE WHEN o_orderkey % 3 = 0 THEN NULL ELSE concat('clip-', o_orderkey, '.mp4') END").alias("name"),
    )


JOBS = """jobs AS (
  SELECT o_orderkey AS job_id, o_custkey AS lane, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) AS ord,
         CASE WHEN o_orderstatus = 'O' THEN 'queued' WHEN o_orderstatus = 'P' THEN 'processing'
              WHEN o_orderpriority LIKE '1%' THEN 'error' WHEN o_orderpriority LIKE '2%' THEN 'cancelled' ELSE 'done' END AS status,
         o_orderkey % 101 AS progress, CASE WHEN o_orderkey % 3 = 0 THEN NULL ELSE 'clip-' || o_orderkey || '.mp4' END AS name
  FROM orders)"""
