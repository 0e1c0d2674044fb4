"""Streams against the batch forms of the same operators."""

import pytest
from pyspark.sql import functions as F

from quadrille.operators import jobs
from quadrille.sources.shared import finished
from quadrille.streaming import jobs as live
from quadrille.streaming import messages

KINDS = ["progress", "log", "progress", "progress"]


def test_progress_is_the_batch_result(spark, tmp_path):
    rows = [(s % 7, s, "done" if s % 61 == 60 else KINDS[s % 4], s % 100) for s in range(300)]
    schema = "job_id long, seq long, kind string, value long"
    for k in range(3):
        spark.createDataFrame(rows[k * 100 : k * 100 + 100], schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    stream = live.live_progress(live.event_stream(spark, str(tmp_path / "in"), schema, per_trigger=10))
    out = live.run_available(stream, "live_progress", "update", str(tmp_path / "check"))
    last = out.groupBy("job_id").agg(F.max_by(F.struct("status", "progress", "n_log"), "last").alias("r")).select("job_id", "r.*")
    expected = jobs.latest_progress(spark.createDataFrame(rows, schema))
    assert sorted(map(tuple, last.collect())) == sorted(map(tuple, expected.collect()))


def test_sessions_that_are_over(spark, tmp_path):
    times = [(1, "2024-01-01 00:00:00"), (1, "2024-01-01 00:10:00"), (1, "2024-01-01 02:00:00"), (2, "2024-01-01 00:05:00"), (3, "2024-01-02 00:00:00")]
    events = spark.createDataFrame(times, "user_id long, ts string").select("user_id", F.col("ts").cast("timestamp_ntz").alias("ts"))
    events.coalesce(1).write.parquet(str(tmp_path / "in"))
    spark.createDataFrame([(9, "2024-01-03 00:00:00")], "user_id long, ts string").select("user_id", F.col("ts").cast("timestamp_ntz").alias("ts")).write.mode("append").parquet(str(tmp_path / "in"))
    stream = live.live_sessions(live.event_stream(spark, str(tmp_path / "in"), "user_id long, ts timestamp_ntz", per_trigger=10))
    out = {(r["user_id"], r["n"]) for r in live.run_available(stream, "live_sessions", "append", str(tmp_path / "check")).collect()}
    assert {(1, 2), (1, 1), (2, 1)} <= out
    batch = jobs.idle_sessions(events, 1800).filter("user_id < 3")
    assert {(r["user_id"], r["n"]) for r in batch.collect()} == {(1, 2), (1, 1), (2, 1)}


def kept(spark, path):
    return sorted((r["k"], r["v"]) for r in live.read_kept(spark, path).collect())


def test_upsert_keeps_the_latest(spark, tmp_path):
    schema = "k long, v long"
    for rows in ([(1, 10), (2, 20)], [(1, 11), (3, 30)]):
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    stream = live.event_stream(spark, str(tmp_path / "in"), schema)
    out = str(tmp_path / "out")
    live.upsert_latest(stream, ["k"], out, str(tmp_path / "check")).awaitTermination()
    assert kept(spark, out) == [(1, 11), (2, 20), (3, 30)]
    # another query, with a checkpoint of its own, goes on with the table
    spark.createDataFrame([(2, 21), (4, 40)], schema).write.parquet(str(tmp_path / "more"))
    live.upsert_latest(live.event_stream(spark, str(tmp_path / "more"), schema, 10), ["k"], out, str(tmp_path / "check2")).awaitTermination()
    assert kept(spark, out) == [(1, 11), (2, 21), (3, 30), (4, 40)]
    assert live.tidy(spark, out, keep=1) > 0 and kept(spark, out) == [(1, 11), (2, 21), (3, 30), (4, 40)]


def test_upsert_that_breaks_off(spark, tmp_path, monkeypatch):
    """A trigger that fails between its rows and its manifest leaves the table; run again it is written once."""
    schema, out, check = "k long, v long", str(tmp_path / "out"), str(tmp_path / "check")
    spark.createDataFrame([(1, 10), (2, 20)], schema).coalesce(1).write.parquet(str(tmp_path / "in"))
    start = lambda: live.upsert_latest(live.event_stream(spark, str(tmp_path / "in"), schema), ["k"], out, check, buckets=2)
    start().awaitTermination()
    spark.createDataFrame([(1, 11), (3, 30)], schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    coalesce = type(stand_in := spark.range(1)).coalesce
    monkeypatch.setattr(type(stand_in), "coalesce", lambda self, n: (_ for _ in ()).throw(RuntimeError("lost")))
    with pytest.raises(Exception, match="lost"):
        start().awaitTermination()
    monkeypatch.setattr(type(stand_in), "coalesce", coalesce)
    assert kept(spark, out) == [(1, 10), (2, 20)]
    start().awaitTermination()
    assert kept(spark, out) == [(1, 11), (2, 20), (3, 30)]
    assert finished(spark, f"{out}/manifests") == [0, 1]


def test_messages_are_split_by_type(spark, tmp_path):
    bodies = [
        (1, 0, '{"type": "job_id", "data": "a1"}'), (1, 1, '{"type": "progress", "data": 40}'), (1, 2, '{"type": "log", "data": "line"}'), (2, 0, '{"type": "progress", "data": 99.0}'),
        (1, 3, '{"type": "done", "success": true, "download_url": "/f"}'), (2, 1, '{"type": "done", "success": false, "message": "broken"}'),
        (3, 0, "no json"), (3, 1, '{"data": 1}'), (3, 2, '{"type": "other"}'), (3, 3, None), (3, 4, '{"type": "progress", "data": "many"}'), (3, 5, "[1]"),
    ]
    schema = "job_id long, seq long, body string"
    out = str(tmp_path / "out")
    for part in (bodies[:6], bodies[6:]):
        spark.createDataFrame(part, schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    messages.split_messages(live.event_stream(spark, str(tmp_path / "in"), schema), out, str(tmp_path / "check")).awaitTermination()

    def read(kind):
        return sorted(tuple(r) for r in messages.read_messages(spark, out, kind).collect())

    want = {
        "progress": [(1, 1, 40), (2, 0, 99)], "log": [(1, 2, "line")], "job_id": [(1, 0, "a1")],
        "done": [(1, 3, True, None, "/f"), (2, 1, False, "broken", None)],
    }
    assert {k: read(k) for k in want} == want
    assert [r[:2] for r in read("invalid")] == [(3, 0), (3, 1), (3, 2), (3, 3), (3, 4), (3, 5)]
    # a batch that comes again, after a failure, changes nothing
    messages.write_batch(spark.createDataFrame(bodies[:6], schema), 0, out)
    assert {k: read(k) for k in want} == want
