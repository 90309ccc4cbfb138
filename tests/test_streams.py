"""Streams in several batches give what their batch twins give on all rows."""

import time

from pyspark.sql import functions as F

from mediaspark.session import scratch_path
from mediaspark.streaming import transfers as tf


def rows(d):
    cols = sorted(d.columns)
    return sorted(map(str, d.select(*cols).collect()))


def events(spark, n=400):
    k = F.col("id")
    return spark.range(n).select(
        k.alias("event_id"), F.timestamp_seconds(k * 7 + 1000).alias("ts"), F.concat(F.lit("f"), k % 3).alias("file"),
        F.when(k % 5 == 0, "finished").when(k % 11 == 0, "error").otherwise("downloading").alias("status"), (k * 13 % 50).alias("downloaded_bytes"),
        F.when(k % 4 > 0, k * 17 % 60).alias("total_bytes"), F.lit(9).cast("bigint").alias("fragment_count"), (k * 13 % 50).alias("bytes"))


def folders(spark, path):
    fs = spark._jvm.org.apache.hadoop.fs.Path(path).getFileSystem(spark._jsc.hadoopConfiguration())
    return sorted(f.getPath().getName() for f in fs.listStatus(spark._jvm.org.apache.hadoop.fs.Path(path)))


def test_fragment_stream(spark):
    e = events(spark).withColumn("total_bytes", F.when(F.col("event_id") == 7, 2**54 + 1).otherwise(F.col("total_bytes")))
    root = scratch_path(spark, "frag")
    tf.run_to_end(tf.fragment_stream(tf.in_files(e, "event_id", 4), root))
    assert len(folders(spark, f"{root}/out")) == 4
    out = spark.read.parquet(f"{root}/out").drop("batch")
    assert rows(out) == rows(tf.fragment_states(e))
    assert rows(tf.fragment_states(e, hot_rows=20)) == rows(tf.fragment_states(e))


def part_of(path, spark, d, n, at):
    """Add rows as one more file of a stream's folder, with a time of its own."""
    d.coalesce(1).write.mode("append").parquet(path)
    fs = spark._jvm.org.apache.hadoop.fs.Path(path).getFileSystem(spark._jsc.hadoopConfiguration())
    for f in fs.listStatus(spark._jvm.org.apache.hadoop.fs.Path(path)):
        if f.getPath().getName().startswith("part-") and f.getModificationTime() > 1_600_001_000_000:
            fs.setTimes(f.getPath(), 1_600_000_000_000 + at * 10_000, -1)


def test_streams_go_on_after_a_restart(spark):
    """The query is stopped and started again from its checkpoint, and goes on with the state that it had."""
    e = events(spark)
    k = F.col("event_id")
    polls = e.select("event_id", F.concat(F.lit("l"), k % 2).alias("stream"), F.floor(k / 20).alias("poll"), (F.floor(k / 20) + k % 5).alias("seq"))
    ids = e.select("event_id", F.concat(F.lit("s "), k % 150).alias("archive_id"))
    root = scratch_path(spark, "again")
    jobs = {"frag": (e, tf.fragment_stream, "out", tf.fragment_states), "live": (polls, tf.live_stream, "out", tf.live_segments),
            "arch": (ids, tf.archive_stream, "archive", lambda d: d.select("archive_id").distinct())}
    for name, (d, job, out, twin) in jobs.items():
        for i, (a, z) in enumerate([(0, 100), (100, 200), (200, 400)]):
            part_of(f"{root}/{name}-in", spark, d.filter((k >= a) & (k < z)), 3, i)
            src = spark.readStream.schema(d.schema).option("maxFilesPerTrigger", 1).parquet(f"{root}/{name}-in")
            tf.run_to_end(job(src, f"{root}/{name}"))
        got = spark.read.parquet(f"{root}/{name}/{out}").drop("batch")
        assert rows(got) == rows(twin(d)), name


def test_idle_files_are_forgotten(spark):
    # File f1 comes back within the time, f2 only long after it: its second fragment is again its first.
    times = [(0, 10, "f1"), (1, 20, "f2"), (2, 500, "f1"), (3, 3000, "f1"), (4, 9000, "f1"), (5, 9010, "f2"), (6, 9020, "f1")]
    e = spark.createDataFrame(times, "event_id bigint, s int, file string").select(
        "event_id", F.timestamp_seconds("s").alias("ts"), "file", F.lit("finished").alias("status"), F.lit(5).alias("downloaded_bytes"),
        F.lit(5).alias("total_bytes"), F.lit(9).alias("fragment_count"))
    for idle, second in (("1 hour", 1), (None, 2)):
        root = scratch_path(spark, "idle")
        tf.run_to_end(tf.fragment_stream(tf.in_files(e, "event_id", 7), root, idle=idle))
        got = {r.event_id: r.fragment_index for r in spark.read.parquet(f"{root}/out").collect()}
        assert (got[1], got[5]) == (1, second) and got[3] == 3


def test_archive_stream_remembers(spark):
    n = 25
    ids = spark.range(1200).select("id", F.when(F.col("id") % 50 > 0, F.concat(F.lit("s "), F.col("id") % 700)).alias("archive_id"))
    old = spark.createDataFrame([("s 5",), ("s 5",), ("s 6",), (None,)], "archive_id string")
    before = spark.conf.get("spark.sql.shuffle.partitions")
    try:
        spark.conf.set("spark.sql.shuffle.partitions", 2)
        for initial in (None, old):
            root = scratch_path(spark, "arch")
            tf.run_to_end(tf.archive_stream(tf.in_files(ids, "id", n), root, initial))
            assert len(folders(spark, f"{root}/archive")) == n
            got = sorted(r.archive_id for r in spark.read.parquet(f"{root}/archive").collect())
            want = tf.new_archive_ids(ids, ids.limit(0) if initial is None else initial).collect()
            assert got == sorted(r.archive_id for r in want)
            # A batch reads no earlier one: all that it has is its own file and the state.
            assert len(folders(spark, f"{root}")) == 2
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)


def test_live_stream(spark):
    k = F.col("id")
    polls = spark.range(240).select(k.alias("n"), F.concat(F.lit("l"), k % 2).alias("stream"), F.floor(k / 12).alias("poll"), (F.floor(k / 12) + k % 5).alias("seq"))
    root = scratch_path(spark, "live")
    tf.run_to_end(tf.live_stream(tf.in_files(polls, "poll", 5), root))
    assert rows(spark.read.parquet(f"{root}/out").drop("batch")) == rows(tf.live_segments(polls))
    root = scratch_path(spark, "live")
    timed = polls.withColumn("ts", F.timestamp_seconds(F.col("poll") * 60 + 60))
    tf.run_to_end(tf.live_stream(tf.in_files(timed, "poll", 5), root, idle="2 minutes"))
    assert rows(spark.read.parquet(f"{root}/out").drop("batch")) == rows(tf.live_segments(polls))


def test_late_rows_are_dropped(spark):
    path = scratch_path(spark, "late")
    schema = "ts timestamp, file string, bytes bigint"
    for secs in (10, 5000, 5001, 20):
        d = spark.createDataFrame([(secs, "f", 1)], "s int, file string, bytes bigint").select(F.timestamp_seconds("s").alias("ts"), "file", "bytes")
        d.coalesce(1).write.mode("append").parquet(path)
        time.sleep(1.1)
    src = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(path)
    out = tf.collect_stream(tf.throughput(src, "60 seconds", late="60 seconds"), "append", "late")
    # Second 5000 closed the window of second 10; rows count as late from the batch after that on.
    assert [(r["bytes"], r["events"]) for r in out.collect()] == [(1, 1)]


def test_expand_runs_live(spark):
    d = spark.createDataFrame([("a", 1, 1, 3, 10, False), ("a", 2, 2, 2, 10, False), ("b", 1, 1, 5, 1, True), ("b", 2, 2, 4294967295, 1, True)],
                              "video string, run_no int, segment int, fragments bigint, first bigint, live boolean")
    got = sorted(tuple(r) for r in tf.expand_runs(d).collect())
    assert got == [("a", 1, 10), ("a", 1, 11), ("a", 1, 12), ("a", 2, 13), ("a", 2, 14), ("b", 2, 6), ("b", 2, 7)]
