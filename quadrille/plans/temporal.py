"""Queries on frame sequences: name -> (query, SQL on the same tables)."""

from pyspark.sql import functions as F

from ..operators import temporal as t
from ..sources.tables import FRAMES, frames, table

W = f"WITH {FRAMES}"
SIZE, SKIP = 20, 3


def videos(spark, sf_dir):
    e = table(spark, sf_dir, "events")
    return e.select(F.col("event_id").alias("video_id"), ((F.col("event_id") * 13 % 400 - 20) / 4.0).alias("duration"), (F.col("event_id") % 4 * 12.5).alias("fps"))


VIDEOS = "videos AS (SELECT event_id AS video_id, (event_id * 13 % 400 - 20) / 4.0::DOUBLE AS duration, event_id % 4 * 12.5::DOUBLE AS fps FROM events)"


def thinned(spark, sf_dir):
    return t.thin(t.in_batch(frames(spark, sf_dir), SIZE), SKIP)


THINNED = f"thinned AS (SELECT *, (row_number() OVER (PARTITION BY video_id, batch ORDER BY n) - 1) % {SKIP} = 0 AS kept FROM (SELECT *, (n - 1) // {SIZE} AS batch FROM frames))"
KEPT = "kept AS (SELECT video_id, batch, n, v FROM thinned WHERE kept)"
# neighbours by as-of joins, which is another way than the windows of the operator
NEAR = """prev AS (SELECT t.video_id, t.batch, t.n, k.n AS before, k.v AS before_v FROM thinned t ASOF LEFT JOIN kept k ON t.video_id = k.video_id AND t.batch = k.batch AND t.n > k.n),
nxt AS (SELECT t.video_id, t.batch, t.n, k.n AS after, k.v AS after_v FROM thinned t ASOF LEFT JOIN kept k ON t.video_id = k.video_id AND t.batch = k.batch AND t.n <= k.n),
near AS (SELECT t.*, before, before_v, after, after_v FROM thinned t JOIN prev USING (video_id, batch, n) JOIN nxt USING (video_id, batch, n))"""

QUERIES = {
    "frame_counts": (
        lambda s, d: videos(s, d).select("video_id", t.frame_count(F.col("duration"), F.col("fps")).alias("total"), t.reference_time(F.col("duration")).alias("reference")),
        f"WITH {VIDEOS} SELECT video_id, CAST(CASE WHEN duration > 0 AND fps > 0 THEN ceil(duration * fps) ELSE 0 END AS BIGINT) AS total, least(5.0::DOUBLE, greatest(0.0::DOUBLE, duration * 0.25)) AS reference FROM videos",
    ),
    "temporal_sample_times": (
        lambda s, d: t.sample_times(videos(s, d), 6),
        f"""WITH {VIDEOS}, ends AS (SELECT video_id, duration, least(greatest(0.3::DOUBLE, duration * 0.05::DOUBLE), greatest(0.0::DOUBLE, duration - 0.2::DOUBLE)) AS a,
  least(greatest(0.6::DOUBLE, duration - 0.3::DOUBLE), duration * 0.92::DOUBLE) AS b FROM videos)
SELECT video_id, k.i AS k, round_even((a + (greatest(a, b) - a) / 5 * k.i) * 1000, 0) / 1000 AS t FROM ends, range(6) k(i) WHERE duration > 0 UNION ALL SELECT video_id, 0, 0.0 FROM ends WHERE duration <= 0""",
    ),
    "frame_batches": (
        lambda s, d: t.batches(videos(s, d).select("video_id", t.frame_count(F.col("duration"), F.col("fps")).alias("total")), 500),
        f"WITH {VIDEOS}, n AS (SELECT video_id, CAST(ceil(duration * fps) AS BIGINT) AS total FROM videos WHERE duration > 0 AND fps > 0) SELECT video_id, first, least(500, total - first) AS count FROM (SELECT video_id, total, unnest(range(0, total, 500)) AS first FROM n)",
    ),
    "frame_thin": (lambda s, d: thinned(s, d).select("video_id", "batch", "n", "kept"), f"{W}, {THINNED} SELECT video_id, batch, n, kept FROM thinned"),
    "frame_neighbors": (
        lambda s, d: t.neighbours(thinned(s, d)).select("video_id", "n", F.coalesce("before", F.lit(0)).alias("before"), F.coalesce("after", F.lit(0)).alias("after")),
        f"{W}, {THINNED}, {KEPT}, {NEAR} SELECT video_id, n, coalesce(before, 0) AS before, coalesce(after, 0) AS after FROM near",
    ),
    "frame_nearest": (
        lambda s, d: t.neighbours(thinned(s, d)).select("video_id", "n", "nearest"),
        f"{W}, {THINNED}, {KEPT} SELECT t.video_id, t.n, arg_min(k.n, abs(t.n - k.n) * 100000 + k.n) AS nearest FROM thinned t JOIN kept k ON t.video_id = k.video_id AND t.batch = k.batch GROUP BY t.video_id, t.n",
    ),
    "frame_lerp": (
        lambda s, d: t.interpolate(thinned(s, d)).select("video_id", "n", F.round("filled", 6).alias("filled")),
        f"""{W}, {THINNED}, {KEPT}, {NEAR} SELECT video_id, n, round(CASE WHEN kept THEN v ELSE coalesce(before_v + (after_v - before_v) * ((n - before)::DOUBLE / greatest(1, after - before)), before_v, after_v) END, 6) AS filled FROM near""",
    ),
    "frame_ffill": (
        lambda s, d: t.fill_forward(frames(s, d).withColumn("kept", F.col("n") % 4 == 2)).select("video_id", "n", "filled"),
        f"{W}, k AS (SELECT video_id, n, v FROM frames WHERE n % 4 = 2), f AS (SELECT video_id, arg_min(v, n) AS v FROM k GROUP BY video_id) SELECT a.video_id, a.n, coalesce(k.v, f.v) AS filled FROM frames a ASOF LEFT JOIN k ON a.video_id = k.video_id AND a.n >= k.n LEFT JOIN f ON a.video_id = f.video_id",
    ),
    "frame_chunks": (
        lambda s, d: t.chunks(frames(s, d), 8).groupBy("video_id", "chunk").agg(F.min("n").alias("first"), F.max("n").alias("last"), F.count("*").alias("frames")),
        f"{W}, m AS (SELECT video_id, max(n) AS total FROM frames GROUP BY video_id) SELECT video_id, (n - 1) // CAST(ceil(total / 8.0) AS BIGINT) AS chunk, min(n) AS first, max(n) AS last, count(*) AS frames FROM frames JOIN m USING (video_id) GROUP BY ALL",
    ),
}
