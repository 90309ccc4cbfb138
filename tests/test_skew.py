"""The path for hot groups must give exactly what the plain window gives."""

from pyspark.sql import Window as W, functions as F

from mediaspark import skew
from mediaspark.operators import formats as fm, playlists as pl, records as rc


def rows(spark, n=3000):
    d = spark.range(n).withColumn("k", F.when(F.col("id") % 3 == 0, F.lit(None).cast("bigint")).otherwise(F.col("id") % 40))
    return d.withColumn("a", (F.col("id") * 7919) % 101).withColumn("v", F.col("id") % 13)


def same(a, b):
    cols = sorted(a.columns)
    key = lambda d: sorted(map(str, d.select(*cols).collect()))
    assert key(a) == key(b)


def test_numbered_hot_equals_plain(spark):
    d = rows(spark)
    plain = d.withColumn("n", F.row_number().over(W.partitionBy("k").orderBy("a", "id")).cast("bigint"))
    same(skew.numbered(d, "k", [F.col("a"), F.col("id")], "n", hot_rows=20), plain)


def test_hot_groups_are_split(spark):
    _, warm = skew.split_hot(rows(spark), "k", 500)
    sliced = skew._sliced(warm, ["k"], [F.col("a"), F.col("id")], 50)
    sizes = [r["count"] for r in sliced.groupBy("__slice").count().collect()]
    assert sum(sizes) == 1000 and len(sizes) >= 18 and max(sizes) <= 100


def test_many_hot_groups_and_one_over_the_whole_table(spark, monkeypatch):
    d = spark.range(12_000).withColumn("k", F.col("id") % 1000).withColumn("a", (F.col("id") * 7919) % 101)
    plain = d.withColumn("n", F.row_number().over(W.partitionBy("k").orderBy("a", "id")).cast("bigint"))
    same(skew.numbered(d, "k", [F.col("a"), F.col("id")], "n", hot_rows=5), plain)
    monkeypatch.setattr(skew, "MAX_BROADCAST_KEYS", 10)
    same(skew.numbered(d, "k", [F.col("a"), F.col("id")], "n", hot_rows=5), plain)
    monkeypatch.setattr(skew, "HOT_ROWS", 500)
    one = d.withColumn("autonumber", F.row_number().over(W.orderBy("a", "id")).cast("bigint"))
    same(rc.autonumbered(d, [F.col("a"), F.col("id")]), one)
    assert sorted(r["id"] for r in pl.cap(d, 700, [F.col("a"), F.col("id")]).collect()) == sorted(r["id"] for r in one.filter("autonumber <= 700").collect())


def test_running_hot_equals_plain(spark):
    d = rows(spark)
    w = W.partitionBy("k").orderBy("a", "id")
    plain = d.withColumn("s", F.sum("v").over(w.rowsBetween(W.unboundedPreceding, 0))) \
        .withColumn("m", F.max("v").over(w.rowsBetween(W.unboundedPreceding, -1)))
    got = skew.running(d, "k", [F.col("a"), F.col("id")], {"s": ("sum", F.col("v")), "m": ("max_before", F.col("v"))}, hot_rows=30)
    same(got, plain)


def test_totals_and_first(spark):
    d = rows(spark)
    same(skew.with_totals(d, "k", {"c": F.count(F.lit(1))}), d.withColumn("c", F.count(F.lit(1)).over(W.partitionBy("k"))))
    first = skew.first_per_group(d, "k", [F.col("a"), F.col("id")], ["k", "id"])
    assert first.count() == d.select("k").distinct().count()


def test_prepare_formats_hot_equals_plain(spark):
    d = spark.range(600).select(
        (F.col("id") % 3).alias("media_id"), F.col("id").alias("pos"), F.when(F.col("id") % 4 > 0, F.concat(F.lit("f/"), F.col("id") % 5)).alias("format_id"),
        F.lit("//u.example.com/x.mp4").alias("url"), F.lit("mp4").alias("ext"), F.lit(None).cast("string").alias("vcodec"),
        F.lit(None).cast("string").alias("acodec"), ((F.col("id") * 37) % 50).cast("double").alias("tbr"))
    cols = ["media_id", "pos", "rank", "format_id", "url", "protocol"]
    same(fm.prepare_formats(d, hot_rows=50).select(*cols), fm.prepare_formats(d).select(*cols))


def test_totals_by_window_and_by_join(spark):
    d = spark.range(300).select(F.when(F.col("id") % 3 > 0, "hot").otherwise(F.concat(F.lit("k"), F.col("id") % 20)).alias("k"), "id")
    aggs = {"top": F.max("id"), "n": F.count(F.lit(1))}
    want = sorted(map(tuple, skew.with_totals(d, "k", aggs).collect()))
    for hot in (None, 50, 1):
        assert sorted(map(tuple, skew.with_totals(d, "k", aggs, d, hot).select("k", "id", "top", "n").collect())) == want
