"""Transfer progress and live arrivals, as streams with batch twins (family J).

``progress_state``, ``throughput`` and ``sessions`` are the same code on a table and on a stream.
The jobs that must remember something for ever keep it as keyed state (``keyed``), so a micro-batch works on what it brings.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from .. import skew
from ..session import scratch_path
from .keyed import NIL, Archive, Fragments, LivePolls


def _speed(start: Column, now: Column, done: Column) -> Column:
    """Bytes per second, null under a millisecond or at zero bytes."""
    secs = now.cast("double") - start.cast("double")
    return F.when((done != 0) & (secs >= 0.001), done / secs)


def progress_state(events: DataFrame) -> DataFrame:
    """Latest status per file with percent, speed and remaining seconds.

    ``events(event_id, ts, file, status, downloaded_bytes, total_bytes, total_bytes_estimate)``. One
    arg-max aggregate, so a stream of it runs in update mode and a hot file is combined on the map side.
    """
    latest = F.max_by(F.struct("ts", "status", "downloaded_bytes", "total_bytes", "total_bytes_estimate"), F.struct("ts", "event_id"))
    g = events.groupBy("file").agg(latest.alias("s"), F.min("ts").alias("started"))
    done, total = F.col("s.downloaded_bytes"), F.col("s.total_bytes")
    size = F.coalesce(F.nullif(total, F.lit(0)), F.nullif("s.total_bytes_estimate", F.lit(0)))
    speed = _speed(F.col("started"), F.col("s.ts"), done)
    percent = F.coalesce(done / size * 100, F.when(done == 0, F.lit(0.0)))
    # Without a total or a rate there is no estimate of the remaining time.
    eta = F.when(total.isNotNull() & speed.isNotNull(), ((total - done) / speed).cast("bigint"))
    return g.select("file", F.col("s.status").alias("status"), done.alias("downloaded_bytes"), percent.alias("percent"),
                    speed.alias("speed"), eta.alias("eta"))


def _fragment_rows(d: DataFrame) -> DataFrame:
    """Fold columns of fragment events that carry their running sums."""
    finished = F.col("status") == "finished"
    total = F.coalesce("total_bytes", F.lit(0))
    before_bytes = F.col("sum_bytes") - F.when(finished, total).otherwise(0)
    before_index = F.col("sum_index") - F.when(finished, 1).otherwise(0)
    estimate = (before_bytes + total) / (before_index + 1) * F.col("fragment_count")
    done = F.col("sum_bytes") + F.when(finished, 0).otherwise(F.col("downloaded_bytes"))
    speed = _speed(F.coalesce("frag_started", "started"), F.col("ts"), F.when(finished, total).otherwise(F.col("downloaded_bytes")))
    eta = F.when(~finished & speed.isNotNull(), ((estimate - done) / speed).cast("bigint"))
    return d.select("event_id", "ts", "file", F.col("sum_index").alias("fragment_index"), done.alias("downloaded_bytes"),
                    estimate.alias("total_bytes_estimate"), speed.alias("speed"), eta.alias("eta"))


def fragment_states(events: DataFrame, hot_rows: int | None = None) -> DataFrame:
    """State of a fragmented transfer after each of its events.

    ``events(event_id, ts, file, status, downloaded_bytes, total_bytes, fragment_count)``; the bytes of an
    unfinished fragment count while it lasts and are replaced by its total when it is finished, so all
    counters are running sums over the file's events.
    """
    fin = F.col("status") == "finished"
    rel = events.filter(F.col("status").isin("downloading", "finished"))
    d = skew.running(rel, "file", [F.col("ts"), F.col("event_id")], {
        "sum_bytes": ("sum", F.when(fin, F.coalesce("total_bytes", F.lit(0))).otherwise(F.lit(0)).cast("bigint")),
        "sum_index": ("sum", F.when(fin, F.lit(1)).otherwise(F.lit(0)).cast("bigint")),
        "frag_started": ("max_before", F.when(fin, F.col("ts")))}, hot_rows)
    firsts = rel.groupBy("file").agg(F.min("ts").alias("started"))
    return _fragment_rows(d.join(firsts, "file"))


def _put(df: DataFrame, root: str, batch_id: int) -> None:
    df.write.mode("overwrite").parquet(f"{root}/batch={batch_id}")


def _written(out: DataFrame, root: str, results: str, mode: str = "append"):
    """A stream whose micro-batches are folders under ``root/results``; a repeated batch overwrites its own."""
    return (out.writeStream.outputMode(mode).foreachBatch(lambda df, batch_id: _put(df, f"{root}/{results}", batch_id))
            .option("checkpointLocation", f"{root}/checkpoint"))


def _microseconds(duration: str | None) -> int | None:
    """A fixed duration such as ``2 hours`` in microseconds."""
    if duration is None:
        return None
    n, unit = duration.split()
    return int(float(n) * {"millisecond": 1, "second": 1000, "minute": 60_000, "hour": 3_600_000, "day": 86_400_000}[unit.rstrip("s")]) * 1000


def _keyed(events: DataFrame, key: str, processor, schema: str, initial=None) -> DataFrame:
    time_mode = "None" if processor.idle is None else "EventTime"
    return events.groupBy(key).transformWithStateInPandas(processor, schema, "append", time_mode, initialState=initial)


def fragment_stream(events: DataFrame, root: str, late: str = "10 minutes", idle: str | None = None):
    """Fragment fold of a stream of events in time order (J02); results under ``root/out``.

    The sums of each file are keyed state: a batch touches the files that it has events of, whatever the stream has seen before. With ``idle``
    a file without events for longer starts anew; its state is dropped when the watermark (``late`` behind the newest event) has passed that time.
    """
    numbers = ("downloaded_bytes", "total_bytes", "fragment_count")
    rel = (events.withWatermark("ts", late) if idle else events).filter(F.col("status").isin("downloading", "finished"))
    rel = rel.select(*["ts"] * bool(idle), "file", "event_id", F.unix_micros("ts").alias("us"), "status", *[F.coalesce(F.col(c).cast("bigint"), F.lit(NIL)).alias(c) for c in numbers])
    schema = (("ts timestamp, " if idle else "") + "file string, event_id bigint, us bigint, status string, downloaded_bytes bigint, total_bytes bigint, "
              "fragment_count bigint, sum_bytes bigint, sum_index bigint, frag_started bigint, started bigint")
    d = _keyed(rel, "file", Fragments(_microseconds(idle)), schema)
    back = {c: F.nullif(F.col(c), F.lit(NIL)) for c in (*numbers, "frag_started")}
    d = d.withColumns(back).withColumns({c: F.timestamp_micros(s) for c, s in (("ts", "us"), ("frag_started", "frag_started"), ("started", "started"))})
    return _written(_fragment_rows(d), root, "out")


def throughput(events: DataFrame, width: str, by: str = "file", late: str | None = None) -> DataFrame:
    """Bytes and rate per fixed window and file (J03); ``late`` sets the watermark on a stream."""
    d = events.withWatermark("ts", late) if late else events
    g = d.groupBy(F.window("ts", width).alias("w"), by).agg(F.sum("bytes").alias("bytes"), F.count(F.lit(1)).alias("events"))
    secs = F.col("w.end").cast("double") - F.col("w.start").cast("double")
    return g.select(F.col("w.start").alias("window_start"), F.col("w.end").alias("window_end"), by, "bytes", "events",
                    F.when(F.col("bytes") != 0, F.col("bytes") / secs).alias("rate"))


def sessions(events: DataFrame, gap: str, by: str = "file", late: str | None = None) -> DataFrame:
    """Runs of a file's events without a gap, with byte totals."""
    d = events.withWatermark("ts", late) if late else events
    g = d.groupBy(F.session_window("ts", gap).alias("w"), by).agg(F.sum("bytes").alias("bytes"), F.count(F.lit(1)).alias("events"))
    return g.select(F.col("w.start").alias("session_start"), F.col("w.end").alias("session_end"), by, "bytes", "events")


def new_archive_ids(ids: DataFrame, archive: DataFrame) -> DataFrame:
    """Ids not yet in the archive, each once: the batch form of J05."""
    return ids.select("archive_id").filter(F.col("archive_id").isNotNull()).distinct().join(archive.select("archive_id"), "archive_id", "left_anti")


def archive_stream(ids: DataFrame, root: str, initial: DataFrame | None = None):
    """Emit each archive id once and remember it for ever (J05); the new ids are under ``root/archive``.

    The memory is the state store, which is spread and sorted by id and filtered by a Bloom filter: a batch looks up its own ids, and nothing
    of the archive is read again or shuffled. ``initial`` (an archive from elsewhere) is loaded into the state before the first batch.
    """
    ids = ids.select("archive_id").filter(F.col("archive_id").isNotNull())
    if initial is None:
        return _written(ids.dropDuplicates(["archive_id"]), root, "archive")
    known = initial.select("archive_id").filter(F.col("archive_id").isNotNull()).distinct().groupBy("archive_id")
    return _written(_keyed(ids, "archive_id", Archive(), "archive_id string", known), root, "archive")


def recent_ids(ids: DataFrame, late: str) -> DataFrame:
    """Bounded-memory form of J05: an id is dropped only if it was seen within the watermark."""
    return ids.withWatermark("ts", late).dropDuplicatesWithinWatermark(["archive_id"])


def _last_two(polls: DataFrame) -> DataFrame:
    """The two highest segment numbers of each poll; equal rows go first, combined on the map side."""
    d = polls.dropDuplicates(["stream", "poll", "seq"])
    n = F.row_number().over(W.partitionBy("stream", "poll").orderBy(F.col("seq").desc()))
    return d.withColumn("__n", n).filter("__n <= 2").drop("__n")


def live_segments(polls: DataFrame, hot_rows: int | None = None) -> DataFrame:
    """Segments that are new at each poll of a live stream: of its last two, those above all before (J06). ``polls(stream, poll, seq)``."""
    two = _last_two(polls)
    per_poll = two.groupBy("stream", "poll").agg(F.max("seq").alias("top"))
    prior = skew.running(per_poll, "stream", [F.col("poll")], {"before": ("max_before", F.col("top"))}, hot_rows)
    out = two.join(prior.select("stream", "poll", "before"), ["stream", "poll"])
    return out.filter(F.col("before").isNull() | (F.col("seq") > F.col("before"))).select("stream", "poll", "seq")


def live_stream(polls: DataFrame, root: str, late: str = "10 minutes", idle: str | None = None):
    """Live segments of a stream of polls in order (J06), each poll within one batch; results under ``root/out``.

    The highest number of each live stream is keyed state. With ``idle`` (then ``polls`` has a time ``ts``) a stream without polls for
    longer starts anew.
    """
    polls = polls.filter("stream IS NOT NULL AND poll IS NOT NULL AND seq IS NOT NULL")
    own = ["stream", F.col("poll").cast("bigint").alias("poll"), F.col("seq").cast("bigint").alias("seq")]
    d = polls.withWatermark("ts", late).select("ts", F.unix_micros("ts").alias("us"), *own) if idle else polls.select(*own)
    return _written(_keyed(d, "stream", LivePolls(_microseconds(idle)), "stream string, poll bigint, seq bigint"), root, "out")


def expand_runs(runs: DataFrame, hot_rows: int | None = None) -> DataFrame:
    """Segment runs into (segment, fragment) rows.

    ``runs(video, run_no, segment, fragments, first, live)``; a live stream's unbounded run counts as two
    fragments, and only the last two rows of a live stream are kept.
    """
    n = F.when(F.col("live") & (F.col("fragments") == 4294967295), F.lit(2)).otherwise(F.col("fragments")).cast("bigint")
    d = skew.running(runs.withColumn("n", n), "video", [F.col("run_no")], {"upto": ("sum", F.col("n"))}, hot_rows, runs)
    # The total is one more window over the rows that the running sums have already gathered.
    d = skew.with_totals(d, "video", {"total": F.max("upto")}, runs, hot_rows).withColumn("from", F.col("upto") - F.col("n"))
    # A live stream's rows before its last two are never made.
    lo = F.when(F.col("live"), F.greatest(F.col("from"), F.col("total") - 2)).otherwise(F.col("from"))
    d = d.withColumn("lo", lo).filter("lo < upto")
    at = F.explode(F.sequence(F.col("lo"), F.col("upto") - 1)).alias("at")
    return d.select("video", "segment", "first", at).select("video", "segment", (F.col("first") + F.col("at")).alias("fragment"))


def in_files(df: DataFrame, order: str, n: int) -> DataFrame:
    """``df`` as a stream of about ``n`` micro-batches in the order of a column: range-sorted files in the shared folder, one file a batch.

    Rows with equal ``order`` stay together. A file stream takes files by their time, so the files get times in their order.
    """
    spark = df.sparkSession
    path = scratch_path(spark, "in")
    df.repartitionByRange(n, order).sortWithinPartitions(order).write.parquet(path)
    jvm = spark._jvm
    fs = jvm.org.apache.hadoop.fs.Path(path).getFileSystem(spark._jsc.hadoopConfiguration())
    files = sorted(str(f.getPath()) for f in fs.listStatus(jvm.org.apache.hadoop.fs.Path(path)) if f.getPath().getName().startswith("part-"))
    for i, f in enumerate(files):
        fs.setTimes(jvm.org.apache.hadoop.fs.Path(f), 1_600_000_000_000 + 10_000 * i, -1)
    return spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 1).parquet(path)


def run_to_end(writer) -> None:
    """Run a stream over what is there now and stop."""
    writer.trigger(availableNow=True).start().awaitTermination()


def collect_stream(df: DataFrame, mode: str, name: str, keys=None) -> DataFrame:
    """Run a stream over what is there and give its output as a table; of updates the last per key."""
    root = scratch_path(df.sparkSession, name)
    schema = df.schema

    def batch(out, batch_id):
        _put(out, f"{root}/out", batch_id)
    run_to_end(df.writeStream.outputMode(mode).foreachBatch(batch).option("checkpointLocation", f"{root}/checkpoint"))
    out = df.sparkSession.read.schema(schema).option("basePath", f"{root}/out").parquet(f"{root}/out/batch=*")
    if mode == "update" and keys:
        out = skew.first_per_group(out.withColumn("batch", F.col("_metadata.file_path")).withColumn(
            "batch", -F.regexp_extract("batch", r"batch=(\d+)", 1).cast("bigint")), keys, [F.col("batch")])
    return out.select(*schema.names)
