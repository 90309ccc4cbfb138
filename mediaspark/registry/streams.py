"""Queries of family J: streams over the events table, and their batch twins."""

from pyspark.sql import functions as F

from ..fixtures import define, oracle
from ..session import scratch_path
from ..streaming import transfers as tf
from . import query

EVENT_SQL = """
SELECT event_id, CAST(ts AS TIMESTAMP) AS ts, concat('file', user_id) AS file, CASE event_type WHEN 'error' THEN 'error' WHEN 'purchase' THEN 'finished' ELSE 'downloading' END AS status,
  CAST(floor(value * 1000) AS BIGINT) AS bytes, CAST(floor(value * 1000) AS BIGINT) AS downloaded_bytes, CASE WHEN event_id % 3 > 0 THEN CAST(floor(value * 1000) AS BIGINT) + event_id % 1000 END AS total_bytes,
  CASE WHEN event_id % 2 = 0 THEN CAST(5000000 AS BIGINT) END AS total_bytes_estimate, CAST(1000 AS BIGINT) AS fragment_count FROM {events}"""
define("xfer", EVENT_SQL)


def batch(t):
    return t["xfer"]


#: Files, and so micro-batches, that the stream queries cut the events into.
BATCHES = 4


def stream(t):
    """The same rows as a stream of several micro-batches in order of time."""
    return t.spark.sql(EVENT_SQL, events=tf.in_files(t["events"], "ts", BATCHES))


SECS = "epoch(ts::TIMESTAMP)"
STATE = """
WITH l AS (SELECT *, row_number() OVER (PARTITION BY file ORDER BY ts DESC, event_id DESC) AS r, min(ts) OVER (PARTITION BY file) AS t0 FROM {xfer}),
s AS (SELECT *, coalesce(nullif(total_bytes, 0), total_bytes_estimate) AS size, CASE WHEN downloaded_bytes <> 0 AND epoch(ts) - epoch(t0) >= 0.001 THEN downloaded_bytes / (epoch(ts) - epoch(t0)) END AS speed FROM l WHERE r = 1)
SELECT file, status, downloaded_bytes, round(coalesce(downloaded_bytes / size * 100, CASE WHEN downloaded_bytes = 0 THEN 0 END), 6) AS percent, round(speed, 6) AS speed,
  CASE WHEN total_bytes IS NOT NULL THEN CAST(trunc((total_bytes - downloaded_bytes) / speed) AS BIGINT) END AS eta FROM s"""


def rounded(df, *cols):
    return df.withColumns({c: F.round(c, 6) for c in cols})


@query("J01_progress_state", oracle(STATE))
def _(t):
    return rounded(tf.progress_state(batch(t)), "percent", "speed")


@query("J01_progress_stream", oracle(STATE))
def _(t):
    return rounded(tf.collect_stream(tf.progress_state(stream(t)), "update", "progress", ["file"]), "percent", "speed")


FOLD = """
WITH r AS (SELECT *, status = 'finished' AS fin, coalesce(total_bytes, 0) AS tot FROM {xfer} WHERE status <> 'error'),
w AS (SELECT *, sum(CASE WHEN fin THEN tot ELSE 0 END) OVER f AS sb, sum(CASE WHEN fin THEN 1 ELSE 0 END) OVER f AS si, min(ts) OVER (PARTITION BY file) AS t0,
  max(CASE WHEN fin THEN ts END) OVER (PARTITION BY file ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS tf FROM r WINDOW f AS (PARTITION BY file ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING)),
c AS (SELECT *, (sb - CASE WHEN fin THEN tot ELSE 0 END + tot) / (si - CASE WHEN fin THEN 1 ELSE 0 END + 1) * 1000 AS est, sb + CASE WHEN fin THEN 0 ELSE downloaded_bytes END AS done,
  epoch(ts) - epoch(coalesce(tf, t0)) AS dt, CASE WHEN fin THEN tot ELSE downloaded_bytes END AS b FROM w),
d AS (SELECT *, CASE WHEN b <> 0 AND dt >= 0.001 THEN b / dt END AS speed FROM c)
SELECT event_id, file, CAST(si AS BIGINT) AS fragment_index, CAST(done AS BIGINT) AS downloaded_bytes, round(est, 3) AS total_bytes_estimate, round(speed, 3) AS speed FROM d"""
FOLD_COLS = ["event_id", "file", "fragment_index", "downloaded_bytes", "total_bytes_estimate", "speed"]


def fold_out(df):
    return df.select(*FOLD_COLS).withColumns({"total_bytes_estimate": F.round("total_bytes_estimate", 3), "speed": F.round("speed", 3)})


@query("J02_fragment_states", oracle(FOLD))
def _(t):
    return fold_out(tf.fragment_states(batch(t)))


@query("J02_fragment_stream", oracle(FOLD))
def _(t):
    root = scratch_path(t.spark, "fragments")
    tf.run_to_end(tf.fragment_stream(stream(t), root))
    return fold_out(t.spark.read.parquet(f"{root}/out"))


RATE = """
SELECT CAST(time_bucket(INTERVAL '1 hour', ts::TIMESTAMP) AS TIMESTAMP) AS window_start, file, CAST(sum(bytes) AS BIGINT) AS bytes, count(*) AS events, CASE WHEN sum(bytes) <> 0 THEN round(sum(bytes) / 3600.0::DOUBLE, 6) END AS rate
FROM {xfer} GROUP BY 1, 2"""


@query("J03_throughput", oracle(RATE))
def _(t):
    out = tf.throughput(batch(t), "1 hour")
    return out.select(F.col("window_start").cast("timestamp_ntz").alias("window_start"), "file", "bytes", "events", F.round("rate", 6).alias("rate"))


@query("J03_throughput_stream", oracle("WITH x AS (" + RATE + ") SELECT * FROM x WHERE window_start + INTERVAL '1 hour' <= (SELECT date_trunc('milliseconds', max(ts)::TIMESTAMP) - INTERVAL '10 minutes' FROM {xfer})"))
def _(t):
    out = tf.collect_stream(tf.throughput(stream(t), "1 hour", late="10 minutes"), "append", "throughput")
    return out.select(F.col("window_start").cast("timestamp_ntz").alias("window_start"), "file", "bytes", "events", F.round("rate", 6).alias("rate"))


SESS = """
WITH g AS (SELECT *, CASE WHEN lag(ts::TIMESTAMP) OVER w + INTERVAL '30 minutes' > ts::TIMESTAMP THEN 0 ELSE 1 END AS new FROM {xfer} WINDOW w AS (PARTITION BY file ORDER BY ts, event_id)),
s AS (SELECT *, sum(new) OVER (PARTITION BY file ORDER BY ts, event_id) AS n FROM g),
x AS (SELECT min(ts)::TIMESTAMP AS session_start, max(ts)::TIMESTAMP + INTERVAL '30 minutes' AS session_end, file, CAST(sum(bytes) AS BIGINT) AS bytes, count(*) AS events FROM s GROUP BY file, n)
SELECT * FROM x"""


def sess_out(df):
    return df.select(*[F.col(c).cast("timestamp_ntz").alias(c) for c in ("session_start", "session_end")], "file", "bytes", "events")


@query("J04_sessions", oracle(SESS))
def _(t):
    return sess_out(tf.sessions(batch(t), "30 minutes"))


@query("J04_sessions_stream", oracle(SESS + " WHERE session_end <= (SELECT date_trunc('milliseconds', max(ts)::TIMESTAMP) - INTERVAL '10 minutes' FROM {xfer})"))
def _(t):
    return sess_out(tf.collect_stream(tf.sessions(stream(t), "30 minutes", late="10 minutes"), "append", "sessions"))


define("event_ids", "SELECT event_id, concat('site', user_id % 25, ' ', CAST(floor(value * 10) AS BIGINT)) AS archive_id FROM {events}")
define("known_ids", "SELECT DISTINCT archive_id FROM {event_ids} WHERE event_id % 97 = 0")
NEW = "SELECT DISTINCT archive_id FROM {event_ids} WHERE archive_id NOT IN (SELECT archive_id FROM {known_ids})"


@query("J05_new_archive_ids", oracle(NEW))
def _(t):
    return tf.new_archive_ids(t["event_ids"], t["known_ids"])


@query("J05_archive_stream", oracle(NEW))
def _(t):
    ids = tf.in_files(t["events"], "ts", BATCHES).select(F.expr("concat('site', user_id % 25, ' ', CAST(floor(value * 10) AS BIGINT))").alias("archive_id"))
    root = scratch_path(t.spark, "archive")
    tf.run_to_end(tf.archive_stream(ids, root, t["known_ids"]))
    return t.spark.read.parquet(f"{root}/archive").select("archive_id")


POLL_SQL = """SELECT concat('live', user_id % 20) AS stream, CAST(floor(event_id / 50) AS BIGINT) AS poll, CAST(floor(event_id / 50) AS BIGINT) + CAST(floor(value) AS BIGINT) % 7 AS seq FROM {events}"""
define("polls", POLL_SQL)
LIVE = """
WITH d AS (SELECT DISTINCT stream, poll, seq FROM {polls}), n AS (SELECT *, row_number() OVER (PARTITION BY stream, poll ORDER BY seq DESC) AS r FROM d), two AS (SELECT * FROM n WHERE r <= 2),
p AS (SELECT stream, poll, max(seq) AS top FROM two GROUP BY ALL), b AS (SELECT *, max(top) OVER (PARTITION BY stream ORDER BY poll ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS before FROM p)
SELECT two.stream, two.poll, two.seq FROM two JOIN b ON two.stream = b.stream AND two.poll = b.poll WHERE before IS NULL OR seq > before"""


@query("J06_live_segments", oracle(LIVE))
def _(t):
    return tf.live_segments(t["polls"])


@query("J06_live_stream", oracle(LIVE))
def _(t):
    # Events of one poll stay in one file.
    rows = t["events"].withColumn("poll", F.floor(F.col("event_id") / 50))
    root = scratch_path(t.spark, "live")
    tf.run_to_end(tf.live_stream(t.spark.sql(POLL_SQL, events=tf.in_files(rows, "poll", BATCHES)), root))
    return t.spark.read.parquet(f"{root}/out").select("stream", "poll", "seq")


define("runs", """
SELECT o_custkey AS video, o_orderkey AS run_no, o_orderkey % 9 AS segment, CASE WHEN o_custkey % 4 = 0 AND o_orderkey % 3 = 0 THEN 4294967295 ELSE o_orderkey % 5 END AS fragments,
  o_custkey % 10 AS first, o_custkey % 4 = 0 AS live FROM {orders}""")


@query("J07_expand_runs", oracle("""
WITH a AS (SELECT *, CASE WHEN fragments = 4294967295 THEN 2 ELSE fragments END AS n FROM {runs}), b AS (SELECT *, sum(n) OVER (PARTITION BY video ORDER BY run_no) - n AS lo, sum(n) OVER (PARTITION BY video) AS total FROM a),
c AS (SELECT video, segment, live, total, first, lo + unnest(range(n)) AS nth FROM b)
SELECT video, segment, CAST(first + nth AS BIGINT) AS fragment FROM c WHERE NOT live OR nth >= total - 2"""))
def _(t):
    return tf.expand_runs(t["runs"])
