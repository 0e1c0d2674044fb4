"""Processing jobs: the queue, progress of runs, idle times.  All are batch forms; ..streaming.jobs has the live ones."""

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# States of a job that ended.
ENDED = ["done", "error", "cancelled"]


def next_jobs(jobs: DataFrame) -> DataFrame:
    """Of each lane the queued job that came first, where none of the lane is being processed."""
    busy = jobs.filter("status = 'processing'").select("lane").distinct()
    first = jobs.filter("status = 'queued'").join(busy, "lane", "left_anti").groupBy("lane").agg(F.min_by("job_id", "ord").alias("job_id"), F.min("ord").alias("ord"))
    return first.select("lane", "job_id", "ord")


def queue_view(jobs: DataFrame) -> DataFrame:
    return jobs.select("job_id", F.coalesce("name", F.substring(F.col("job_id").cast("string"), 1, 8)).alias("name"), "status", "progress", status_label(F.col("status")).alias("label"))


def status_label(status: Column) -> Column:
    out = status
    for key, label in (("queued", "waiting"), ("processing", "running"), ("done", "finished"), ("error", "failed"), ("cancelled", "cancelled")):
        out = F.when(status == key, label).otherwise(out)
    return out


def delete_jobs(jobs: DataFrame, gone: DataFrame) -> DataFrame:
    """jobs after gone(job_id) was asked to go: queued and running ones are cancelled, ended ones leave the list."""
    asked = jobs.join(gone.select("job_id", F.lit(True).alias("asked")).distinct(), "job_id", "left")
    left = asked.filter(F.col("asked").isNull() | ~F.col("status").isin(ENDED))
    return left.withColumn("status", F.when(F.col("asked"), "cancelled").otherwise(F.col("status"))).drop("asked")


def active_work(jobs: DataFrame) -> DataFrame:
    """lane, active: whether anything of a lane waits or runs."""
    return jobs.groupBy("lane").agg(F.bool_or(F.col("status").isin("queued", "processing")).alias("active"))


def latest_progress(events: DataFrame) -> DataFrame:
    """events(job_id, seq, kind, value) -> job_id, status, progress, n_log: the state that a run of events leads to; what
    follows a closing event does not count."""
    closing = F.min(F.when(F.col("kind").isin("done", "error", "cancelled"), F.col("seq"))).over(Window.partitionBy("job_id"))
    live = events.withColumn("closing", closing).filter("closing IS NULL OR seq <= closing")
    number = F.col("kind") == "progress"
    return live.groupBy("job_id").agg(
        F.coalesce(F.max_by(F.when(F.col("kind").isin("done", "error", "cancelled"), F.col("kind")), F.when(F.col("kind").isin("done", "error", "cancelled"), F.col("seq"))), F.lit("processing")).alias("status"),
        F.coalesce(F.max_by(F.when(number, F.col("value")), F.when(number, F.col("seq"))), F.lit(0)).cast("long").alias("progress"),
        F.count_if(F.col("kind") == "log").alias("n_log"),
    )


def encoder_progress(lines: DataFrame) -> DataFrame:
    """lines(job_id, seq, line, duration) with pct, from `time=H:M:S`: 99 at most; lines without a time go."""
    part = lambda k: F.regexp_extract("line", r"time=(\d+):(\d+):(\d+(?:\.\d+)?)", k)
    timed = lines.filter(part(1) != "").withColumn("elapsed", part(1).cast("int") * 3600 + part(2).cast("int") * 60 + part(3).cast("double"))
    pct = F.when(F.col("duration") > 0, F.least(F.floor(F.col("elapsed") / F.col("duration") * 100), F.lit(99))).otherwise(0)
    return timed.select("job_id", "seq", "elapsed", pct.cast("long").alias("pct"))


def mapped_progress(lines: DataFrame, start: int, end: int) -> DataFrame:
    """lines(job_id, seq, line) with pct, from `NN%|` of a progress bar, mapped to the span of the whole run."""
    found = F.regexp_extract("line", r"(\d+)%\|", 1)
    bars = lines.filter(found != "")
    return bars.select("job_id", "seq", (F.lit(start) + ((end - start) * (found.cast("int") / 100.0)).cast("int")).cast("long").alias("pct"))


def running_progress(batches: DataFrame) -> DataFrame:
    """batches(video_id, first, count) with pct: 10 and up to 75 more as frames are done."""
    w = Window.partitionBy("video_id")
    done = F.sum("count").over(w.orderBy("first").rowsBetween(Window.unboundedPreceding, Window.currentRow))
    return batches.withColumn("pct", (F.lit(10) + F.floor(done / F.sum("count").over(w) * 75)).cast("long"))


def crop_spans(groups: DataFrame) -> DataFrame:
    """groups(image_id, index) with span_start and span_end: each crop's part of the run from 20 to 88 per cent."""
    n = F.count("*").over(Window.partitionBy("image_id"))
    at = lambda k: (F.lit(20) + F.floor(F.lit(68) * k / n)).cast("long")
    return groups.select("image_id", "index", at(F.col("index") - 1).alias("span_start"), at(F.col("index")).alias("span_end"))


def changes(polls: DataFrame) -> DataFrame:
    """polls(job_id, seq, progress): those that differ from the one before, and each job's first."""
    last = F.lag("progress").over(Window.partitionBy("job_id").orderBy("seq"))
    return polls.withColumn("last", last).filter("last IS NULL OR last <> progress").drop("last")


def idle_sessions(events: DataFrame, gap_seconds: int) -> DataFrame:
    """events(user_id, ts) -> user_id, session, started, ended, n: runs of events less than gap apart."""
    w = Window.partitionBy("user_id").orderBy("ts")
    seconds = lambda c: F.unix_micros(c.cast("timestamp"))
    fresh = (seconds(F.col("ts")) - seconds(F.lag("ts").over(w)) >= gap_seconds * 1_000_000).cast("int")
    marked = events.withColumn("fresh", F.coalesce(fresh, F.lit(1)))
    marked = marked.withColumn("session", F.sum("fresh").over(w.rangeBetween(Window.unboundedPreceding, Window.currentRow)).cast("long"))
    return marked.groupBy("user_id", "session").agg(F.min("ts").alias("started"), F.max("ts").alias("ended"), F.count("*").alias("n"))


def enqueue_all(files: DataFrame, regions: DataFrame) -> DataFrame:
    """files(name, size, modified), one set of regions for all: file_key, name, n_regions.  Files of one key are one."""
    key = F.concat_ws(":", "name", "size", "modified")
    n = regions.agg(F.count("*").alias("n_regions"))
    return files.select(key.alias("file_key"), "name").dropDuplicates(["file_key"]).crossJoin(F.broadcast(n))
