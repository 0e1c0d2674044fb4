"""Frame sequences: counts, batches, sampling, neighbours, interpolation.  frames(video_id, n, ...), n from 1 without gaps."""

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.boxes import thousandths


def reference_time(duration: Column) -> Column:
    """A quarter into the video, five seconds at most."""
    return F.least(F.lit(5.0), F.greatest(F.lit(0.0), duration * 0.25))


def frame_count(duration: Column, fps: Column) -> Column:
    return F.when((duration > 0) & (fps > 0), F.ceil(duration * fps)).otherwise(0).cast("long")


def sample_times(videos: DataFrame, samples: int) -> DataFrame:
    """videos(video_id, duration) -> video_id, k, t: evenly spaced times that keep off both ends; one of them is the
    reference time; a video without duration has time 0."""
    d = F.col("duration")
    start = F.least(F.greatest(F.lit(0.3), d * 0.05), F.greatest(F.lit(0.0), d - 0.2))
    end = F.greatest(start, F.least(F.greatest(F.lit(0.6), d - 0.3), d * 0.92))
    n = max(1, samples)
    if n == 1:
        many = F.array(reference_time(d))
    else:
        many = F.transform(F.sequence(F.lit(0), F.lit(n - 1)), lambda k: thousandths(start + (end - start) / (n - 1) * k))
    times = F.when(d > 0, many).otherwise(F.array(F.lit(0.0)))
    return videos.select("video_id", F.posexplode(times).alias("k", "t")).withColumn("k", F.col("k").cast("long"))


def batches(totals: DataFrame, size: int) -> DataFrame:
    """totals(video_id, total) -> video_id, first (from 0), count: what is decoded at a time."""
    starts = totals.filter("total > 0").select("video_id", "total", F.explode(F.sequence(F.lit(0).cast("long"), F.col("total") - 1, F.lit(size).cast("long"))).alias("first"))
    return starts.select("video_id", "first", F.least(F.lit(size).cast("long"), F.col("total") - F.col("first")).alias("count"))


def in_batch(frames: DataFrame, size: int) -> DataFrame:
    return frames.withColumn("batch", F.floor((F.col("n") - 1) / size).cast("long"))


def thin(frames: DataFrame, skip: int) -> DataFrame:
    """frames(video_id, batch, n) with kept: every skip-th frame of a batch from its first."""
    rank = F.row_number().over(Window.partitionBy("video_id", "batch").orderBy("n"))
    return frames.withColumn("kept", (rank - 1) % max(1, skip) == 0)


def neighbours(frames: DataFrame) -> DataFrame:
    """frames(video_id, batch, n, kept) with before (the last kept frame ahead of it), after (the first kept one from it
    on) and nearest (the earlier of two that are as near), within the batch."""
    w = Window.partitionBy("video_id", "batch").orderBy("n")
    kept = F.when(F.col("kept"), F.col("n"))
    before = F.last(kept, ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, -1))
    after = F.first(kept, ignorenulls=True).over(w.rowsBetween(Window.currentRow, Window.unboundedFollowing))
    found = frames.withColumn("before", before).withColumn("after", after)
    nearer = (F.col("n") - F.col("before")) <= (F.col("after") - F.col("n"))
    return found.withColumn("nearest", F.when(F.col("after").isNull() | nearer, F.coalesce("before", "after")).otherwise(F.col("after")))


def interpolate(frames: DataFrame) -> DataFrame:
    """frames(video_id, batch, n, v, kept) with filled: kept values as they are, the others on the line between the kept
    neighbours of their batch, at its ends the one neighbour's."""
    w = Window.partitionBy("video_id", "batch").orderBy("n")
    back, on = w.rowsBetween(Window.unboundedPreceding, -1), w.rowsBetween(Window.currentRow, Window.unboundedFollowing)
    entry = F.when(F.col("kept"), F.struct("n", "v"))
    both = frames.withColumn("p", F.last(entry, ignorenulls=True).over(back)).withColumn("q", F.first(entry, ignorenulls=True).over(on))
    alpha = (F.col("n") - F.col("p.n")) / F.greatest(F.lit(1), F.col("q.n") - F.col("p.n"))
    line = F.col("p.v") + (F.col("q.v") - F.col("p.v")) * alpha
    return both.withColumn("filled", F.when(F.col("kept"), F.col("v")).otherwise(F.coalesce(line, F.col("p.v"), F.col("q.v")))).drop("p", "q")


def fill_forward(frames: DataFrame) -> DataFrame:
    """frames(video_id, n, v, kept) with filled: the last kept value; before the first one, that one's."""
    w = Window.partitionBy("video_id").orderBy("n")
    kept = F.when(F.col("kept"), F.col("v"))
    first = F.first(kept, ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))
    return frames.withColumn("filled", F.coalesce(F.last(kept, ignorenulls=True).over(w), first))


def chunks(frames: DataFrame, workers: int) -> DataFrame:
    """frames with chunk: runs of ceil(frames / workers) frames that follow one another."""
    w = Window.partitionBy("video_id")
    rank = F.row_number().over(w.orderBy("n"))
    return frames.withColumn("chunk", F.floor((rank - 1) / F.ceil(F.count("*").over(w) / workers)).cast("long"))
