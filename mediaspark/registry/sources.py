"""Queries of family A: files written from the tables by Spark, read back."""

from pyspark.sql import functions as F

from ..fixtures import define, oracle
from ..operators import formats as fm
from ..session import scratch_path
from ..sources import io
from . import query


@query("A01_read_url_list", "SELECT url FROM pages WHERE page_id % 5 < 3")
def _(t):
    path = scratch_path(t.spark, "urls")
    k, u = F.col("page_id") % 5, F.col("url")
    line = (F.when(k == 0, F.concat(F.lit("﻿"), u)).when(k == 1, F.concat(F.lit("  "), u, F.lit("\t"))).when(k == 2, u)
            .when(k == 3, F.concat(F.lit("# "), u)).otherwise(F.concat(F.lit(" ;"), u, F.lit("\n \n]"), u)))
    t["pages"].select(line.alias("value")).write.text(path)
    return io.read_url_list(t.spark, path)


define("records", """
SELECT media_id, id, title, view_count, age_limit, CASE WHEN media_id % 3 = 0 THEN 'x' END AS mood FROM {media}""")


@query("A02_read_info_json", oracle("""
SELECT id, title, view_count, concat_ws(',', 'age_limit', CASE WHEN media_id % 3 = 0 THEN 'mood=x' END) AS extra FROM {records}
""".replace("concat_ws(',', 'age_limit', ", "concat_ws(',', CASE WHEN age_limit IS NOT NULL THEN 'age_limit=' || age_limit END, ")))
def _(t):
    path = scratch_path(t.spark, "info")
    d = t["records"].drop("media_id").withColumn("__private", F.lit(1)).withColumn("requested_formats", F.array(F.lit("a")))
    d.select(F.to_json(F.struct("*"), {"ignoreNullFields": "false"}).alias("value")).write.text(path)
    r = io.read_info_json(t.spark, path, "id string, title string, view_count bigint")
    pairs = F.transform(F.array_sort(F.transform(F.map_entries("extra"), lambda e: F.concat(e["key"], F.lit("="), e["value"].cast("string")))), lambda x: x)
    return r.select("id", "title", "view_count", F.array_join(pairs, ",").alias("extra"))


@query("A03_read_pages", "SELECT page_id, url FROM pages")
def _(t):
    return io.read_pages(t.spark, f"{t.folder}/pages.parquet").select("page_id", "url")


@query("A04_read_manifests", oracle("SELECT s_suppkey AS no, '#EXTM3U' || chr(10) || s_name || '.ts' || chr(10) AS body FROM {supplier}"))
def _(t):
    path = scratch_path(t.spark, "manifests")
    # Folders and files take the time here, one of each for a manifest: all cores create them, and those of one task share a folder, which the commit moves as one.
    tasks = 8 * t.spark.sparkContext.defaultParallelism
    t["supplier"].select(F.col("s_suppkey").alias("no"), F.concat(F.lit("#EXTM3U\n"), "s_name", F.lit(".ts")).alias("value")) \
        .withColumn("shelf", F.pmod(F.hash("no"), F.lit(tasks))).repartitionById(tasks, "shelf") \
        .write.partitionBy("shelf", "no").options(**io.MANY_FILES).text(path)
    d = io.read_manifests(t.spark, path, "https://m.example.com/")
    return d.select(F.regexp_extract("manifest_id", r"/no=(\d+)/", 1).cast("bigint").alias("no"), "body")


define("stored_lists", """
SELECT media_id, concat('https://m.example.com/', media_id, '.m3u8') AS url, concat('s', pos, '.ts') AS line, pos FROM {formats}""")


@query("A04_read_packed_manifests", oracle("""
SELECT url AS manifest_id, url, '#EXTM3U' || chr(10) || string_agg(line, chr(10) ORDER BY pos, line) AS body FROM {stored_lists} GROUP BY url"""))
def _(t):
    path = scratch_path(t.spark, "packed")
    lines = t["stored_lists"].groupBy("url").agg(F.array_sort(F.collect_list(F.struct("pos", "line"))).alias("x"))
    io.write_packed_manifests(lines.select("url", F.concat(F.lit("#EXTM3U\n"), F.array_join(F.transform("x", lambda r: r["line"]), "\n")).alias("body")), path)
    return io.read_packed_manifests(t.spark, path)


define("feed_items", """
SELECT o_custkey AS feed_id, o_orderkey, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) - 1 AS pos FROM {orders}""")


def feeds(t):
    item = F.expr("""concat('<item><title>Item &amp; ', o_orderkey, '</title>', CASE o_orderkey % 4 WHEN 0 THEN concat('<enclosure url=""/><enclosure url="https://f.example.com/', o_orderkey, '.mp3?a=1&b=2"/><link>no</link>') WHEN 1 THEN concat('<link>https://l.example.com/', o_orderkey, '</link>')
      WHEN 2 THEN '<enclosure/>' ELSE concat('<enclosure url="https://g.example.com/', o_orderkey, '"/>') END, '<pubDate>Wed, 03 Feb 2021 04:05:06 +0100</pubDate><itunes:duration>', CASE WHEN o_orderkey % 2 = 0 THEN '1:02:03' ELSE '75' END, '</itunes:duration><itunes:explicit>',
      CASE o_orderkey % 3 WHEN 0 THEN 'Yes' WHEN 1 THEN 'no' ELSE 'clean' END, '</itunes:explicit><itunes:episode>', o_orderkey % 9, '</itunes:episode><itunes:image href="https://i.example.com/x.jpg"/></item>')""")
    # A feed of more than 500 items is spread over several documents.
    from .. import skew
    d = skew.numbered(t["orders"].select(F.col("o_custkey").alias("cust"), "o_orderkey"), "cust", [F.col("o_orderkey")], "n")
    # The documents of a customer stay where its rows already are.
    d = d.select("cust", F.floor((F.col("n") - 1) / 500).alias("part"), "o_orderkey", item.alias("line"))
    g = d.groupBy("cust", "part").agg(F.sort_array(F.collect_list(F.struct("o_orderkey", "line"))).alias("x"))
    g = g.withColumn("feed_id", F.concat_ws("-", F.col("cust").cast("string"), F.col("part").cast("string")))
    body = F.concat(F.lit('<?xml version="1.0"?><rss version="2.0" xmlns:itunes="http://www.itunes.com/dtds/podcast-1.0.dtd"><channel><title>Feed</title>'),
                    F.array_join("x.line", ""), F.lit("</channel></rss>"))
    return g.select("feed_id", F.lit("https://f.example.com/rss").alias("url"), body.alias("body"))


@query("A05_parse_rss", oracle("""
SELECT concat(feed_id, '-', pos // 500) AS feed_id, CAST(pos % 500 AS INTEGER) AS pos, CASE o_orderkey % 4 WHEN 0 THEN concat('https://f.example.com/', o_orderkey, '.mp3?a=1&b=2') WHEN 1 THEN concat('https://l.example.com/', o_orderkey) ELSE concat('https://g.example.com/', o_orderkey) END AS url,
  concat('Item & ', o_orderkey) AS title, CAST(1612321506 AS BIGINT) AS timestamp, CASE WHEN o_orderkey % 2 = 0 THEN 3723 ELSE 75 END::DOUBLE AS duration, o_orderkey % 9 AS episode_number, CASE o_orderkey % 3 WHEN 0 THEN 18 WHEN 1 THEN 0 END AS age_limit, 'https://i.example.com/x.jpg' AS thumbnail
FROM {feed_items} WHERE o_orderkey % 4 <> 2"""))
def _(t):
    return io.parse_rss(feeds(t)).select("feed_id", "pos", "url", "title", "timestamp", "duration", "episode_number", "age_limit", "thumbnail")


@query("A06_read_archive", oracle("SELECT DISTINCT archive_id FROM {archive}"))
def _(t):
    path = scratch_path(t.spark, "archive")
    a = t["archive"].select(F.concat(F.lit(" "), "archive_id", F.lit(" ")).alias("value"))
    a.unionByName(a.select(F.trim("value").alias("value"))).write.text(path)
    missing = io.read_archive(t.spark, path + "-none")
    return io.read_archive(t.spark, path).unionByName(missing)


@query("A07_write_info_json", oracle("""
SELECT m.id, m.title, m.view_count, f.n, f.ids FROM {media} m LEFT JOIN (SELECT media_id, count(*) AS n, string_agg(coalesce(format_id, '-'), ',' ORDER BY pos) AS ids FROM {formats} GROUP BY media_id) f USING (media_id)"""))
def _(t):
    path = scratch_path(t.spark, "records")
    io.write_info_json(t["media"].withColumn("__secret", F.lit("s")), path, {"formats": t["formats"]})
    r = io.read_info_json(t.spark, path, "id string, title string, view_count bigint, formats array<struct<format_id:string,ext:string>>")
    ids = F.array_join(F.transform("formats", lambda f: F.coalesce(f["format_id"], F.lit("-"))), ",")
    return r.select("id", "title", "view_count", F.nullif(F.size("formats"), F.lit(-1)).cast("bigint").alias("n"), ids.alias("ids"))


@query("A08_append_archive", oracle("SELECT DISTINCT lower(extractor_key) || ' ' || id AS archive_id FROM {media} UNION SELECT archive_id FROM {archive}"))
def _(t):
    from ..operators.playlists import skip_archived
    path = scratch_path(t.spark, "grown")
    io.append_archive(t["archive"], path)
    new = skip_archived(t["media"], io.read_archive(t.spark, path))
    io.append_archive(new, path)
    return io.read_archive(t.spark, path)


@query("A09_export_fields", oracle("""
WITH d AS (SELECT * FROM {default_picks} WHERE error IS NULL), p AS (SELECT m.media_id, m.title, d.format_id, d.parts, v.url AS vurl, a.url AS aurl, b.url AS burl
  FROM {media} m JOIN d USING (media_id) LEFT JOIN {best_v} v ON d.parts = 2 AND v.media_id = m.media_id LEFT JOIN {best_a} a ON d.parts = 2 AND a.media_id = m.media_id LEFT JOIN {best_pick} b ON d.parts = 1 AND b.media_id = m.media_id)
SELECT media_id, 0 AS place, 'title' AS field, coalesce(title, 'NA') AS value FROM p UNION ALL SELECT media_id, 1000, 'url', coalesce(vurl, burl) FROM p UNION ALL SELECT media_id, 1001, 'url', aurl FROM p WHERE parts = 2
UNION ALL SELECT media_id, 2000, 'format_id', format_id FROM p"""))
def _(t):
    f = t["formats"]
    picks = fm.default_selection(fm.prepare_formats(f, sizes=f), t["media"])
    chosen = fm.apply_selection(t["media"], picks).filter("format_id IS NOT NULL")
    return io.export_fields(chosen, ["title", "url", "format_id"])
