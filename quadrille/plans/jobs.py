"""Queries on jobs and their progress: name -> (query, SQL on the same tables)."""

from pyspark.sql import functions as F

from ..operators import jobs as j
from ..operators import temporal as t
from ..sources.tables import JOBS, jobs, table
from .geometry import CLAMPED, PLANNED, REGIONS, planned
from .temporal import VIDEOS, videos

W = f"WITH {JOBS}"


def as_job_events(events):
    """Events of a user as the events of a job."""
    kind = F.expr("CASE WHEN event_id % 97 = 0 THEN 'done' WHEN event_id % 89 = 0 THEN 'error' WHEN event_id % 3 = 0 THEN 'log' ELSE 'progress' END")
    return events.select(F.col("user_id").alias("job_id"), F.col("event_id").alias("seq"), kind.alias("kind"), (F.col("event_id") % 100).alias("value"))


def job_events(spark, sf_dir):
    return as_job_events(table(spark, sf_dir, "events"))


EVENTS = "ev AS (SELECT user_id AS job_id, event_id AS seq, CASE WHEN event_id % 97 = 0 THEN 'done' WHEN event_id % 89 = 0 THEN 'error' WHEN event_id % 3 = 0 THEN 'log' ELSE 'progress' END AS kind, event_id % 100 AS value FROM events)"


def lines(spark, sf_dir):
    e = table(spark, sf_dir, "events")
    s = F.col("event_id") * 11 % 7000
    clock = F.format_string("frame=%d time=%02d:%02d:%02d.50 bitrate=1", "event_id", F.floor(s / 3600), F.floor(s / 60) % 60, s % 60)
    bar = F.format_string("%d%%| ##", F.col("event_id") % 101)
    line = F.when(F.col("event_id") % 3 == 0, clock).when(F.col("event_id") % 3 == 1, bar).otherwise("warming up")
    return e.select(F.col("user_id").alias("job_id"), F.col("event_id").alias("seq"), line.alias("line"), (F.col("event_id") % 5 * 1000).cast("double").alias("duration"))


def files(spark, sf_dir):
    return table(spark, sf_dir, "part").select(F.concat(F.lit("clip"), F.col("p_size"), F.lit(".mp4")).alias("name"), (F.col("p_partkey") % 40).alias("size"), F.lit(7).alias("modified"))


def live_batches(spark, sf_dir):
    return t.batches(videos(spark, sf_dir).select("video_id", t.frame_count(F.col("duration"), F.col("fps")).alias("total")), 500)


QUERIES = {
    "queue_next_job": (
        lambda s, d: j.next_jobs(jobs(s, d)),
        f"{W} SELECT lane, job_id, ord FROM (SELECT *, row_number() OVER (PARTITION BY lane ORDER BY ord) AS k FROM jobs WHERE status = 'queued' AND lane NOT IN (SELECT lane FROM jobs WHERE status = 'processing')) WHERE k = 1",
    ),
    "queue_view": (
        lambda s, d: j.queue_view(jobs(s, d)),
        f"{W} SELECT job_id, coalesce(name, substr(job_id::VARCHAR, 1, 8)) AS name, status, progress, CASE status WHEN 'queued' THEN 'waiting' WHEN 'processing' THEN 'running' WHEN 'done' THEN 'finished' WHEN 'error' THEN 'failed' ELSE status END AS label FROM jobs",
    ),
    "queue_delete": (
        lambda s, d: j.delete_jobs(jobs(s, d), jobs(s, d).filter("job_id % 4 = 1").select("job_id")).select("job_id", "status"),
        f"{W} SELECT job_id, CASE WHEN job_id % 4 = 1 THEN 'cancelled' ELSE status END AS status FROM jobs WHERE job_id % 4 <> 1 OR status IN ('queued', 'processing')",
    ),
    "active_work_exists": (lambda s, d: j.active_work(jobs(s, d)), f"{W} SELECT lane, bool_or(status IN ('queued', 'processing')) AS active FROM jobs GROUP BY lane"),
    "job_progress_latest": (
        lambda s, d: j.latest_progress(job_events(s, d)),
        f"""WITH {EVENTS}, ends AS (SELECT job_id, min(seq) AS stop, arg_min(kind, seq) AS status FROM ev WHERE kind IN ('done', 'error') GROUP BY job_id)
SELECT ev.job_id, coalesce(any_value(status), 'processing') AS status, coalesce(arg_max(value, seq) FILTER (kind = 'progress'), 0) AS progress, count(*) FILTER (kind = 'log') AS n_log FROM ev LEFT JOIN ends USING (job_id) WHERE stop IS NULL OR seq <= stop GROUP BY ev.job_id""",
    ),
    "progress_parse": (
        lambda s, d: j.encoder_progress(lines(s, d)),
        "WITH l AS (SELECT user_id AS job_id, event_id AS seq, event_id * 11 % 7000 + 0.5::DOUBLE AS elapsed, event_id % 5 * 1000 AS duration FROM events WHERE event_id % 3 = 0) SELECT job_id, seq, elapsed, CAST(CASE WHEN duration > 0 THEN least(floor(elapsed / duration * 100), 99) ELSE 0 END AS BIGINT) AS pct FROM l",
    ),
    "progress_mapped": (
        lambda s, d: j.mapped_progress(lines(s, d), 20, 88),
        "SELECT user_id AS job_id, event_id AS seq, CAST(20 + trunc(68 * ((event_id % 101) / 100.0::DOUBLE)) AS BIGINT) AS pct FROM events WHERE event_id % 3 = 1",
    ),
    "progress_running": (
        lambda s, d: j.running_progress(live_batches(s, d)).select("video_id", "first", "pct"),
        f"WITH {VIDEOS}, n AS (SELECT video_id, CAST(ceil(duration * fps) AS BIGINT) AS total FROM videos WHERE duration > 0 AND fps > 0), b AS (SELECT video_id, total, unnest(range(0, total, 500)) AS first FROM n) SELECT video_id, first, CAST(10 + floor(least(total, first + 500)::DOUBLE / total * 75) AS BIGINT) AS pct FROM b",
    ),
    "crop_progress_spans": (
        lambda s, d: j.crop_spans(planned(s, d)),
        f"""WITH {REGIONS}, {CLAMPED}, {PLANNED}, n AS (SELECT image_id, count(*) AS n FROM planned GROUP BY image_id) SELECT image_id, "index", 20 + 68 * ("index" - 1) // n AS span_start, 20 + 68 * "index" // n AS span_end FROM planned JOIN n USING (image_id)""",
    ),
    "progress_changes": (
        lambda s, d: j.changes(job_events(s, d).select("job_id", "seq", F.floor(F.col("value") / 40).alias("progress"))),
        f"WITH {EVENTS}, p AS (SELECT job_id, seq, value // 40 AS progress, lag(value // 40) OVER (PARTITION BY job_id ORDER BY seq) AS last FROM ev) SELECT job_id, seq, progress FROM p WHERE last IS NULL OR last <> progress",
    ),
    "idle_sessions": (
        lambda s, d: j.idle_sessions(table(s, d, "events"), 1800),
        """WITH e AS (SELECT user_id, ts, lag(ts) OVER (PARTITION BY user_id ORDER BY ts) AS last FROM events), m AS (SELECT user_id, ts, sum(CASE WHEN last IS NULL OR ts - last >= INTERVAL 30 MINUTE THEN 1 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY ts) AS session FROM e)
SELECT user_id, CAST(session AS BIGINT) AS session, min(ts) AS started, max(ts) AS ended, count(*) AS n FROM m GROUP BY user_id, session""",
    ),
    "queue_all_files": (
        lambda s, d: j.enqueue_all(files(s, d), planned(s, d).filter("image_id = 1")),
        f"""WITH {REGIONS}, {CLAMPED}, {PLANNED} SELECT DISTINCT 'clip' || p_size || '.mp4:' || (p_partkey % 40) || ':7' AS file_key, 'clip' || p_size || '.mp4' AS name, (SELECT count(*) FROM planned WHERE image_id = 1) AS n_regions FROM part""",
    ),
}
