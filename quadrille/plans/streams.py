"""Queries that run as streams over the tables and return what the stream has written: name -> (query, SQL on the same tables).

Each run has folders of its own in the shared folder, for its checkpoint and its table.
"""

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.shared import shared_dir
from ..streaming import jobs as live
from ..streaming import messages, queue
from .jobs import EVENTS, as_job_events


def live_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The events table, as it arrives."""
    path = f"{sf_dir}/events.parquet"
    stream = spark.readStream.schema(spark.read.parquet(path).schema)
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    if place.getFileSystem(spark._jsc.hadoopConfiguration()).getFileStatus(place).isDirectory():
        return stream.parquet(path)
    return stream.option("pathGlobFilter", "events.parquet").parquet(sf_dir)  # streams read folders


def folder(spark: SparkSession, name: str) -> str:
    """A new folder, which goes when the application ends."""
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    place.getFileSystem(spark._jsc.hadoopConfiguration()).deleteOnExit(place)
    return path


def progress(spark, sf_dir):
    """States of jobs, kept in a table by each trigger."""
    at = folder(spark, "stream-progress")
    live.upsert_latest(live.live_progress(as_job_events(live_events(spark, sf_dir))), ["job_id"], f"{at}/table", f"{at}/check").awaitTermination()
    return live.read_kept(spark, f"{at}/table").select("job_id", "status", "progress", "n_log")


def bodies(events: DataFrame) -> DataFrame:
    """Messages of all types, and some that are none, made of events."""
    i = F.col("event_id")
    body = (
        F.when(i % 7 == 0, F.format_string('{"type":"log","data":"line %d"}', i)).when(i % 7 == 1, F.format_string('{"type":"done","success":%s,"message":"m%d"}', F.when(i % 2 == 0, "true").otherwise("false"), i))
        .when(i % 7 == 2, F.format_string('{"type":"other","data":%d}', i)).when(i % 7 == 3, F.col("props")).otherwise(F.format_string('{"type":"progress","data":%d}', i % 101))
    )
    return events.select(F.col("user_id").alias("job_id"), i.alias("seq"), body.alias("body"))


def split(spark, sf_dir):
    """job_id, seq, kind and the fields of all messages, as they lie in the folders of their types."""
    at = folder(spark, "stream-messages")
    messages.split_messages(bodies(live_events(spark, sf_dir)), f"{at}/table", f"{at}/check").awaitTermination()
    parts = []
    for kind in ("progress", "log", "done", "invalid"):
        rows = messages.read_messages(spark, f"{at}/table", kind)
        value = {"progress": F.col("data").cast("string"), "log": F.col("data"), "done": F.concat_ws(" ", F.col("success").cast("string"), "message"), "invalid": F.col("body")}[kind]
        parts.append(rows.select("job_id", "seq", F.lit(kind).alias("kind"), value.alias("value")))
    return parts[0].unionByName(parts[1]).unionByName(parts[2]).unionByName(parts[3])


def lane_events(events: DataFrame) -> DataFrame:
    """Jobs of lanes that come and end, made of events."""
    i = F.col("event_id")
    kind = F.when(i % 2 == 0, "enqueue").when(i % 3 == 0, "error").when(i % 5 == 0, "cancelled").otherwise("done")
    return events.select((F.col("user_id") % 50).alias("lane"), i.alias("seq"), "ts", kind.alias("kind"), (F.floor(i / 2) % 9).alias("job_id"))


def queue_log(spark, sf_dir):
    """Starts and ends of jobs by the live queue; SQL cannot express it, tests hold it against a plain queue."""
    at = folder(spark, "stream-queue")
    before = spark.conf.get("spark.sql.streaming.stateStore.providerClass", None)
    queue.keep_state_on_disk(spark)
    try:
        log = queue.live_queue(lane_events(live_events(spark, sf_dir)), 3600)
        log.writeStream.outputMode("append").format("parquet").option("path", f"{at}/table").option("checkpointLocation", f"{at}/check").trigger(availableNow=True).start().awaitTermination()
    finally:
        spark.conf.set("spark.sql.streaming.stateStore.providerClass", before) if before else spark.conf.unset("spark.sql.streaming.stateStore.providerClass")
    return spark.read.parquet(f"{at}/table").filter("what <> 'idle'").select("lane", "nth", "what", "job_id", "status", "at")


QUERIES = {
    "stream_progress_latest": (
        progress,
        f"""WITH {EVENTS}, ends AS (SELECT job_id, min(seq) AS stop, arg_min(kind, seq) AS status FROM ev WHERE kind IN ('done', 'error') GROUP BY job_id)
SELECT ev.job_id, coalesce(any_value(status), 'processing') AS status, coalesce(arg_max(value, seq) FILTER (kind = 'progress'), 0) AS progress, count(*) FILTER (kind = 'log') AS n_log FROM ev LEFT JOIN ends USING (job_id) WHERE stop IS NULL OR seq <= stop GROUP BY ev.job_id""",
    ),
    "stream_messages_split": (
        split,
        """SELECT user_id AS job_id, event_id AS seq, CASE event_id % 7 WHEN 0 THEN 'log' WHEN 1 THEN 'done' WHEN 2 THEN 'invalid' WHEN 3 THEN 'invalid' ELSE 'progress' END AS kind,
 CASE event_id % 7 WHEN 0 THEN 'line ' || event_id WHEN 1 THEN CASE WHEN event_id % 2 = 0 THEN 'true' ELSE 'false' END || ' m' || event_id WHEN 2 THEN '{"type":"other","data":' || event_id || '}' WHEN 3 THEN props ELSE (event_id % 101)::VARCHAR END AS value FROM events""",
    ),
    "stream_queue_log": (queue_log, None),
}
