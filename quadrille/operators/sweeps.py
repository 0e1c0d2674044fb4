"""Sweeps of presets over clips that can be resumed: what is left to run, where a run stops, and the table of runs.

The table of runs only grows: each call adds a folder of its own, and a manifest that is written last makes it part of the table.
"""

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.shared import cut, finished

RUN = ["clip", "ord", "preset", "returncode", "elapsed_seconds"]


def pending(presets: DataFrame, clips: DataFrame, runs: DataFrame | None, start: int = 0) -> DataFrame:
    """presets(ord, preset, options), clips(clip), runs(clip, preset, returncode, ...) -> clip, ord, preset, options of the runs
    from place `start` on that no run has finished without an error.  Presets are a few rows, so they are broadcast."""
    every = clips.select("clip").distinct().crossJoin(F.broadcast(presets.filter(F.col("ord") >= start).select("ord", "preset", "options")))
    if runs is None:
        return every
    return every.join(runs.filter("returncode = 0").select("clip", "preset").distinct(), ["clip", "preset"], "left_anti").select("clip", "ord", "preset", "options")


def until_failure(results: DataFrame) -> DataFrame:
    """results(clip, ord, returncode, ...) of each clip up to its first failure, that one included: what follows never ran."""
    first = results.filter("returncode <> 0").groupBy("clip").agg(F.min("ord").alias("stop"))
    return results.join(first, "clip", "left").filter("stop IS NULL OR ord <= stop").drop("stop")


def read_runs(spark: SparkSession, path: str) -> DataFrame | None:
    """RUN and call of all runs, or None where there are none yet."""
    calls = finished(spark, f"{path}/manifests")
    return spark.read.parquet(*[f"{path}/runs/{n}" for n in calls]) if calls else None


def latest(spark: SparkSession, path: str) -> DataFrame | None:
    """Of each clip and preset its last run."""
    runs = read_runs(spark, path)
    if runs is None:
        return None
    last = F.max_by(F.struct("ord", "returncode", "elapsed_seconds"), "call").alias("r")
    return runs.groupBy("clip", "preset").agg(last, F.max("call").alias("call")).select("clip", "preset", "r.*", "call")


def sweep(presets: DataFrame, clips: DataFrame, run: Callable[[DataFrame], DataFrame], path: str, start: int = 0) -> int:
    """Run what is pending: run() takes its rows and gives them with returncode and elapsed_seconds.  Each clip's runs are kept up
    to its first failure, and become part of the table at once; how many were added.  A call that breaks off adds none."""
    spark = presets.sparkSession
    todo = pending(presets, clips, read_runs(spark, path), start)
    done = cut(until_failure(run(todo)).select(*RUN), "sweep")
    n = done.count()
    if n:
        call = (finished(spark, f"{path}/manifests") or [-1])[-1] + 1
        done.withColumn("call", F.lit(call)).write.mode("overwrite").parquet(f"{path}/runs/{call}")
        spark.range(1).select(F.lit(n).alias("rows")).coalesce(1).write.mode("overwrite").parquet(f"{path}/manifests/{call}")
    return n


def clip_totals(runs: DataFrame) -> DataFrame:
    """clip, runs, failed, seconds of a table of runs."""
    return runs.groupBy("clip").agg(F.count("*").alias("runs"), F.count_if(F.col("returncode") != 0).alias("failed"), F.round(F.sum("elapsed_seconds"), 3).alias("seconds"))
