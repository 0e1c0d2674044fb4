"""The job queue as a stream: one job of a lane runs at a time, and lanes that do nothing for a while are told."""

from collections.abc import Iterator

from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from ..operators.jobs import ENDED

LOG = "lane long, what string, job_id long, status string, ms long, nth long"
ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


class LaneQueue(StatefulProcessor):
    """State of a lane: the jobs that wait (a list), the one that runs, how many rows were told, when anything last happened, and
    whether it was told to be idle since.

    Its timer stands where the lane becomes idle; an event in between moves it on.
    """

    def __init__(self, idle_ms: int):
        self.idle_ms = idle_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.waiting = handle.getListState("waiting", "job_id long")
        self.running = handle.getValueState("running", "job_id long")
        self.told = handle.getValueState("told", "nth long, active_ms long, idle boolean")

    def handleInputRows(self, key, rows: Iterator[Row], timer_values) -> Iterator[Row]:
        (lane,) = key
        waiting = [job for (job,) in self.waiting.get()] if self.waiting.exists() else []
        running = self.running.get()[0] if self.running.exists() else None
        nth, active, idle = self.told.get() if self.told.exists() else (0, None, False)
        out = []

        def tell(what: str, job, status, ms: int) -> None:
            nonlocal nth
            nth += 1
            out.append(Row(lane=lane, what=what, job_id=job, status=status, ms=ms, nth=nth))

        for row in sorted(rows, key=lambda r: r["seq"]):
            job, kind, ms = row["job_id"], row["kind"], row["ms"]
            if running is None and active is not None and not idle and ms - active > self.idle_ms:
                tell("idle", None, None, active + self.idle_ms)
            active, idle = ms, False
            if kind == "enqueue":
                if job != running and job not in waiting:
                    waiting.append(job)
            elif kind in ENDED and job == running:
                tell("end", job, kind, ms)
                running = None
            elif kind == "cancelled" and job in waiting:
                waiting.remove(job)
                tell("end", job, kind, ms)
            if running is None and waiting:
                running = waiting.pop(0)
                tell("start", running, "processing", ms)
        self.waiting.put([(j,) for j in waiting]) if waiting else self.waiting.clear()
        self.running.update((running,)) if running is not None else self.running.clear()
        self.told.update((nth, active, idle))
        for timer in list(self.handle.listTimers()):
            self.handle.deleteTimer(timer)
        if running is None:
            self.handle.registerTimer(active + self.idle_ms)
        yield from out

    def handleExpiredTimer(self, key, timer_values, expired) -> Iterator[Row]:
        nth, active, idle = self.told.get()
        if not idle:
            self.told.update((nth + 1, active, True))
            yield Row(lane=key[0], what="idle", job_id=None, status=None, ms=active + self.idle_ms, nth=nth + 1)

    def close(self) -> None:
        pass


def keep_state_on_disk(spark: SparkSession) -> None:
    """Lists and timers need the state store that keeps its state on disk; queries that start afterwards use it."""
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKS)


def live_queue(events: DataFrame, idle: float = 1800, late: str = "10 minutes") -> DataFrame:
    """events(lane, seq, ts, kind, job_id), with seq in order from trigger to trigger -> lane, what, job_id, status, at, nth (a
    lane's rows in their order): start of the job that came first, whenever its lane is free; end with its status; idle once a
    lane without work has seen nothing for `idle` seconds of event time.  For append mode.

    kind is enqueue, done, error or cancelled.  A job is enqueued once while it waits or runs; the end of a job that neither
    waits nor runs, and one that waits but was not cancelled, says nothing.  Call keep_state_on_disk() first.
    """
    timed = events.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", late)
    rows = timed.select("lane", "seq", "ts", "kind", "job_id", F.unix_millis("ts").alias("ms"))
    told = rows.groupBy("lane").transformWithState(LaneQueue(int(idle * 1000)), LOG, "Append", "EventTime")
    return told.select("lane", "what", "job_id", "status", F.timestamp_millis("ms").alias("at"), "nth")


def idle_after(events: DataFrame, idle: float) -> DataFrame:
    """Batch form of the idle rows: events(lane, seq, ts, busy: whether work is left after it) -> lane, at: where a lane has no
    work and nothing follows for `idle` seconds; the last event of a lane counts, too."""
    from pyspark.sql import Window

    after = F.lead("ts").over(Window.partitionBy("lane").orderBy("seq"))
    due = F.timestamp_micros(F.unix_micros(F.col("ts").cast("timestamp")) + F.lit(int(idle * 1_000_000)))
    return events.withColumn("after", after).filter(~F.col("busy") & (F.col("after").isNull() | (F.col("after") > due))).select("lane", due.alias("at"))
