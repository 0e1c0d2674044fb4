"""Queries on sweeps: name -> (query, SQL on the same tables).  Parts stand for clips, sizes for presets."""

from pyspark.sql import functions as F

from ..operators import sweeps as w
from ..sources.tables import table
from .streams import folder


def presets(spark, sf_dir):
    n = F.col("n_nationkey").cast("long")
    return table(spark, sf_dir, "nation").filter("n_nationkey < 7").select(n.alias("ord"), F.col("n_name").alias("preset"), F.format_string('{"k":"%d"}', n).alias("options"))


def clips(spark, sf_dir):
    return table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("clip"))


def ran(todo, again: int):
    """A run fails where clip and place say so, the first time more often than the next."""
    code = F.when((F.col("clip") * 5 + F.col("ord") * 3) % 11 < 2 - again, 1).otherwise(0)
    return todo.withColumns({"returncode": code, "elapsed_seconds": (F.col("clip") % 9 + F.col("ord")) / 2.0})


def earlier(spark, sf_dir):
    return w.until_failure(ran(w.pending(presets(spark, sf_dir), clips(spark, sf_dir), None), 0)).select(*w.RUN)


def resumed(spark, sf_dir):
    """Two calls on one table of runs: the second works off what the first left."""
    at = folder(spark, "sweep")
    for again in (0, 1):
        w.sweep(presets(spark, sf_dir), clips(spark, sf_dir), lambda todo, again=again: ran(todo, again), at)
    return w.latest(spark, at)


ALL = """every AS (SELECT s_suppkey AS clip, n_nationkey::BIGINT AS ord, n_name AS preset, '{"k":"' || n_nationkey || '"}' AS options, (s_suppkey % 9 + n_nationkey) / 2.0::DOUBLE AS elapsed_seconds, CASE WHEN (s_suppkey * 5 + n_nationkey * 3) % 11 < 2 THEN 1 ELSE 0 END AS c0, CASE WHEN (s_suppkey * 5 + n_nationkey * 3) % 11 < 1 THEN 1 ELSE 0 END AS c1
  FROM supplier, nation WHERE n_nationkey < 7),
stops AS (SELECT *, min(CASE WHEN c0 > 0 THEN ord END) OVER (PARTITION BY clip) AS stop FROM every),
one AS (SELECT * FROM stops WHERE stop IS NULL OR ord <= stop),
todo AS (SELECT *, min(CASE WHEN c1 > 0 THEN ord END) OVER (PARTITION BY clip) AS stop2 FROM stops WHERE NOT (c0 = 0 AND (stop IS NULL OR ord < stop))),
two AS (SELECT * FROM todo WHERE stop2 IS NULL OR ord <= stop2)"""

QUERIES = {
    "sweep_pending": (
        lambda s, d: w.pending(presets(s, d), clips(s, d), earlier(s, d), 1),
        f"WITH {ALL} SELECT clip, ord, preset, options FROM every e WHERE ord >= 1 AND NOT EXISTS (SELECT 1 FROM one WHERE one.clip = e.clip AND one.preset = e.preset AND c0 = 0)",
    ),
    "sweep_until_failure": (earlier, f"WITH {ALL} SELECT clip, ord, preset, c0 AS returncode, elapsed_seconds FROM one"),
    "sweep_resumed": (
        resumed,
        f"""WITH {ALL}, runs AS (SELECT clip, preset, ord, c0 AS returncode, elapsed_seconds, 0 AS call FROM one UNION ALL SELECT clip, preset, ord, c1, elapsed_seconds, 1 FROM two)
SELECT clip, preset, ord, returncode, elapsed_seconds, call FROM runs QUALIFY row_number() OVER (PARTITION BY clip, preset ORDER BY call DESC) = 1""",
    ),
    "sweep_totals": (lambda s, d: w.clip_totals(earlier(s, d)), f"WITH {ALL} SELECT clip, count(*) AS runs, count(*) FILTER (c0 > 0) AS failed, round(sum(elapsed_seconds), 3) AS seconds FROM one GROUP BY clip"),
}
