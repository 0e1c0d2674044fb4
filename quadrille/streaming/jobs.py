"""Live forms of the job operators, as Structured Streaming queries over an event stream."""

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..sources.shared import cut, finished

CLOSING = ("done", "error", "cancelled")
BUCKETS = 256  # of a table that is kept up to date; a trigger rewrites those that its keys are in
STATE = "status string, progress long, n_log long, last long"


def event_stream(spark: SparkSession, path: str, schema: str, per_trigger: int = 1) -> DataFrame:
    """Files of events as they appear in a folder."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", per_trigger).parquet(path)


def _advance(keep_ms: int | None):
    def run(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        """One job's events of a trigger, in their order, on top of what is known of the job; a closed job takes no more."""
        if state.hasTimedOut:
            state.remove()
            return
        status, progress, n_log, last = state.get if state.exists else ("processing", 0, 0, -1)
        events = pd.concat(list(batches)).sort_values("seq")
        for seq, kind, value in zip(events["seq"], events["kind"], events["value"]):
            if status in CLOSING:
                break
            if kind == "progress":
                progress = int(value)
            elif kind == "log":
                n_log += 1
            elif kind in CLOSING:
                status = kind
            last = int(seq)
        state.update((status, progress, n_log, last))
        if keep_ms:
            state.setTimeoutDuration(keep_ms)
        yield pd.DataFrame({"job_id": [key[0]], "status": [status], "progress": [progress], "n_log": [n_log], "last": [last]})

    return run


def live_progress(events: DataFrame, keep_ms: int | None = None) -> DataFrame:
    """events(job_id, seq, kind, value), in order from trigger to trigger -> each touched job's state; for update mode.

    With keep_ms a job that has been silent for so long is forgotten, which a query that runs on needs; one that ends with what
    is there (availableNow) must do without, as Spark would wait for the time to pass.
    """
    timeout = GroupStateTimeout.ProcessingTimeTimeout if keep_ms else GroupStateTimeout.NoTimeout
    return events.groupBy("job_id").applyInPandasWithState(_advance(keep_ms), f"job_id long, {STATE}", STATE, "update", timeout)


def live_sessions(events: DataFrame, gap: str = "30 minutes", late: str = "10 minutes") -> DataFrame:
    """events(user_id, ts) -> user_id, started, ended, n of sessions that are over; rows later than `late` are left out.
    Timestamps without a zone are taken in the session's."""
    timed = events.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", late)
    return timed.groupBy("user_id", F.session_window("ts", gap).alias("w")).agg(F.count("*").alias("n")).select("user_id", F.col("w.start").alias("started"), F.col("w.end").alias("ended"), "n")


def live_rates(events: DataFrame, window: str = "5 minutes", slide: str | None = None, late: str = "10 minutes") -> DataFrame:
    """events(event_type, ts, value) -> counts and sums by type in tumbling (or, with slide, sliding) windows."""
    timed = events.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", late)
    bounds = F.window("ts", window, slide) if slide else F.window("ts", window)
    return timed.groupBy("event_type", bounds.alias("w")).agg(F.count("*").alias("n"), F.sum("value").alias("total")).select("event_type", F.col("w.start").alias("started"), "n", "total")


def run_available(stream: DataFrame, name: str, mode: str, checkpoint: str) -> DataFrame:
    """Work off what is there now and return the rows written, from a table in memory: for tests and small results."""
    spark = stream.sparkSession
    query = stream.writeStream.outputMode(mode).format("memory").queryName(name).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    query.awaitTermination()
    return spark.table(name)


def read_kept(spark: SparkSession, path: str, version: int | None = None) -> DataFrame:
    """A table that upsert_latest() keeps, as its last (or a given) finished version has it, with bucket and epoch."""
    manifest = spark.read.parquet(f"{path}/manifests/{finished(spark, path + '/manifests')[-1] if version is None else version}")
    rows = spark.read.parquet(f"{path}/data")
    return rows.join(F.broadcast(manifest.select("bucket", "version")), ["bucket", "version"]).drop("version")


def upsert_latest(stream: DataFrame, keys: list[str], path: str, checkpoint: str, buckets: int = BUCKETS):
    """Start a query that keeps the latest row of each key in a table of buckets of keys.

    A trigger merges its rows into the buckets that they are in and writes those as a new version beside the old ones; then a
    manifest, which names the version of each bucket, makes it the table.  What breaks off before that leaves the old table and
    is written again; a trigger whose manifest is there is left out when it is repeated.  A query with a new checkpoint goes on
    with the table that it finds.  read_kept() reads the table, tidy() removes what no manifest needs any more.
    """

    def merge(batch: DataFrame, epoch: int) -> None:
        spark, mark = batch.sparkSession, f"{checkpoint}#{epoch}"
        known = finished(spark, f"{path}/manifests")
        last = spark.read.parquet(f"{path}/manifests/{known[-1]}") if known else None
        if known and last.first()["writer"] == mark:
            return
        version = known[-1] + 1 if known else 0
        # later triggers go after earlier ones, whatever their query
        rows = batch.withColumn("epoch", F.lit(version)).withColumn("bucket", F.pmod(F.xxhash64(*keys), F.lit(buckets)).cast("int"))
        rows = cut(rows, "upsert-rows")
        touched = rows.select("bucket").distinct()  # at most as many as there are buckets
        if last is not None:
            rows = read_kept(spark, path, known[-1]).join(F.broadcast(touched), "bucket").unionByName(rows)
        rest = [c for c in rows.columns if c not in (*keys, "epoch", "bucket")]
        latest = rows.groupBy("bucket", *keys).agg(F.max_by(F.struct(*rest), "epoch").alias("r"), F.max("epoch").alias("epoch"))
        latest.select(*keys, "r.*", "epoch", "bucket").repartition("bucket").write.mode("overwrite").partitionBy("bucket").parquet(f"{path}/data/version={version}")
        now = touched.select("bucket", F.lit(version).alias("version"))
        if last is not None:
            now = last.select("bucket", "version").join(touched, "bucket", "left_anti").unionByName(now)
        now.withColumn("writer", F.lit(mark)).coalesce(1).write.mode("overwrite").parquet(f"{path}/manifests/{version}")

    return stream.writeStream.outputMode("update").option("checkpointLocation", checkpoint).foreachBatch(merge).trigger(availableNow=True).start()


def tidy(spark: SparkSession, path: str, keep: int = 2) -> int:
    """Remove the manifests of a kept table but for the last ones, and the versions that these don't name; how many went.  Only
    while no query writes the table."""
    known = finished(spark, f"{path}/manifests")
    held = known[-keep:]
    if not held:
        return 0
    used = {r["version"] for n in held for r in spark.read.parquet(f"{path}/manifests/{n}").select("version").distinct().collect()}
    as_path = spark._jvm.org.apache.hadoop.fs.Path
    files = as_path(path).getFileSystem(spark._jsc.hadoopConfiguration())
    gone = [f"{path}/data/version={n}" for n in range(known[-1] + 1) if n not in used] + [f"{path}/manifests/{n}" for n in known[:-keep]]
    return sum(files.delete(as_path(p), True) for p in gone if files.exists(as_path(p)))
