"""The live queue against a plain one, the batch forms, and a restart from its checkpoint."""

import datetime
import random

import pytest
from pyspark.sql import functions as F

from quadrille.operators import jobs
from quadrille.streaming import jobs as live
from quadrille.streaming import queue as q

SCHEMA = "lane long, seq long, ts timestamp_ntz, kind string, job_id long"
START, IDLE = datetime.datetime(2024, 1, 1), 600


def made(seed):
    """Events of four lanes: jobs come, end in any way, ends of unknown jobs, repeats; some pauses are long."""
    rng, clock, out = random.Random(seed), START, []
    for seq in range(240):
        clock += datetime.timedelta(seconds=rng.choice([5, 20, 60, 60, 200]))
        lane = rng.randrange(4)
        job = lane * 1000 + rng.randrange(12)
        out.append((lane, seq, clock, rng.choice(["enqueue", "enqueue", "done", "done", "error", "cancelled"]), job))
    return out


def plain(events):
    """(lane, what, job, status, at) in order, and what is left: {lane: (running, waiting)}."""
    lanes, out, last = {}, [], {}
    for lane, _, ts, kind, job in events:
        running, waiting = lanes.get(lane, (None, []))
        if lane in last and running is None and (ts - last[lane]).total_seconds() > IDLE:
            out.append((lane, "idle", None, None, last[lane] + datetime.timedelta(seconds=IDLE)))
        last[lane] = ts
        if kind == "enqueue":
            if job != running and job not in waiting:
                waiting = [*waiting, job]
        elif job == running:
            out.append((lane, "end", job, kind, ts))
            running = None
        elif kind == "cancelled" and job in waiting:
            waiting = [j for j in waiting if j != job]
            out.append((lane, "end", job, kind, ts))
        if running is None and waiting:
            running, waiting = waiting[0], waiting[1:]
            out.append((lane, "start", running, "processing", ts))
        lanes[lane] = running, waiting
    return out, lanes, last


@pytest.fixture
def on_disk(spark):
    key = "spark.sql.streaming.stateStore.providerClass"
    before = spark.conf.get(key, None)
    q.keep_state_on_disk(spark)
    yield
    spark.conf.unset(key) if before is None else spark.conf.set(key, before)


def run(spark, tmp_path, name):
    stream = q.live_queue(live.event_stream(spark, str(tmp_path / "in"), SCHEMA), IDLE, "0 seconds")
    query = stream.writeStream.outputMode("append").format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "check")).trigger(availableNow=True).start()
    query.awaitTermination()
    return query


def add(spark, tmp_path, rows):
    spark.createDataFrame(rows, SCHEMA).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))


def test_queue_over_restarts(spark, tmp_path, on_disk):
    """Four triggers in two runs of the query: the second goes on from the checkpoint of the first."""
    events = made(3)
    for part in (events[:60], events[60:100]):
        add(spark, tmp_path, part)
    run(spark, tmp_path, "first")
    half = spark.read.parquet(str(tmp_path / "out")).count()
    for part in (events[100:180], events[180:]):
        add(spark, tmp_path, part)
    end = events[-1][2] + datetime.timedelta(days=1)
    add(spark, tmp_path, [(99, 1000, end, "done", 1)])  # time goes on, so that what is idle by then is told
    add(spark, tmp_path, [(99, 1001, end + datetime.timedelta(days=1), "done", 1)])
    run(spark, tmp_path, "second")
    rows = [r for r in spark.read.parquet(str(tmp_path / "out")).collect() if r["lane"] < 99]
    assert 0 < half < len(rows)
    got = [(r["lane"], r["what"], r["job_id"], r["status"], r["at"]) for r in sorted(rows, key=lambda r: (r["lane"], r["nth"]))]
    want, left, last = plain(events)
    want += [(lane, "idle", None, None, last[lane] + datetime.timedelta(seconds=IDLE)) for lane, (running, _) in left.items() if running is None]
    assert sorted(got, key=repr) == sorted(want, key=repr)
    by_lane = lambda rs: {n: [r for r in rs if r[0] == n and r[1] != "idle"] for n in range(4)}
    assert by_lane(got) == by_lane(want) and {r[1] for r in got} == {"start", "end", "idle"}


def test_the_registered_stream(spark):
    """The query on the events table against the plain queue."""
    from quadrille.plans import streams

    sf = "/root/testdata/sf0.001"
    events = [(r["lane"], r["seq"], r["ts"], r["kind"], r["job_id"]) for r in streams.lane_events(spark.read.parquet(f"{sf}/events.parquet")).orderBy("seq").collect()]
    want = [(lane, what, job, status) for lane, what, job, status, _ in plain(events)[0] if what != "idle"]
    got = sorted(streams.queue_log(spark, sf).collect(), key=lambda r: (r["lane"], r["nth"]))
    by_lane = lambda rows: {n: [r[1:] for r in rows if r[0] == n] for n in range(50)}
    assert by_lane([(r["lane"], r["what"], r["job_id"], r["status"]) for r in got]) == by_lane(want) and len(want) > 50


def test_starts_are_the_next_jobs(spark):
    """Whenever a lane is free, what the plain queue starts is what next_jobs() names."""
    events, checked = made(5), 0
    for n in range(1, len(events)):
        out, left, _ = plain(events[:n])
        lane, _, ts, kind, job = events[n]
        running, waiting = left.get(lane, (None, []))
        started = [r for r in plain(events[: n + 1])[0][len(out) :] if r[1] == "start"]
        if not started or n % 4:
            continue
        rest = [j for j in waiting if not (kind == "cancelled" and j == job)] + ([job] if kind == "enqueue" and job not in (running, *waiting) else [])
        table = [(lane, j, k, "queued") for k, j in enumerate(rest)]
        found = jobs.next_jobs(spark.createDataFrame(table, "lane long, job_id long, ord long, status string")).collect()
        assert [(r["lane"], r["job_id"]) for r in found] == [(lane, started[0][2])]
        checked += 1
    assert checked > 3


def test_idle_rows_are_the_batch_ones(spark):
    events = made(3)
    rows = []
    for n, (lane, seq, ts, *_) in enumerate(events):
        rows.append((lane, seq, ts, plain(events[: n + 1])[1][lane][0] is not None))
    found = q.idle_after(spark.createDataFrame(rows, "lane long, seq long, ts timestamp, busy boolean"), IDLE)
    want, left, last = plain(events)
    want = [(r[0], r[4]) for r in want if r[1] == "idle"] + [(lane, last[lane] + datetime.timedelta(seconds=IDLE)) for lane, (running, _) in left.items() if running is None]
    assert sorted((r["lane"], r["at"]) for r in found.collect()) == sorted(want) and want


def test_idle_batch_agrees_with_sessions(spark):
    """Without work, a lane is idle once for each of idle_sessions()."""
    events = [(lane, seq, ts) for lane, seq, ts, *_ in made(9)]
    table = spark.createDataFrame(events, "user_id long, seq long, ts timestamp_ntz")
    sessions = jobs.idle_sessions(table, IDLE + 1)
    idle = q.idle_after(table.select(F.col("user_id").alias("lane"), "seq", F.col("ts").cast("timestamp").alias("ts"), F.lit(False).alias("busy")), IDLE)
    due = {(r["user_id"], r["ended"] + datetime.timedelta(seconds=IDLE)) for r in sessions.collect()}
    assert {(r["lane"], r["at"]) for r in idle.collect()} == due
