"""Queries of family E: record shaping."""

from pyspark.sql import functions as F

from ..fixtures import define, oracle
from ..functions.paths import FIRST, of_type
from ..operators import records as rc
from . import query

define("doc_json", """
SELECT o_orderkey AS media_id, concat('{"id": "', o_orderkey, '", "stats": {"Views": ', CAST(floor(o_totalprice) AS BIGINT),
  ', "likes": null}, "tags": ["', lower(o_orderstatus), '", "t', o_orderkey % 7, '", ', o_orderkey % 3, '], "urls": [{"index": 0, "url": "u', o_orderkey,
  '"}, {"index": 1}, {"index": 2, "url": "v', o_orderkey, '"}], "empty": {}', CASE WHEN o_orderkey % 4 = 0 THEN concat(', "alt": "a', o_custkey, '"') ELSE '' END, '}') AS body
FROM {orders}""")


@query("E01_extract_paths", oracle("""
SELECT o_orderkey AS media_id, CAST(o_orderkey AS VARCHAR) AS id, CASE WHEN o_orderkey % 4 = 0 THEN concat('a', o_custkey) ELSE concat('v', o_orderkey) END AS name,
  CAST(floor(o_totalprice) AS BIGINT) AS views, concat('u', o_orderkey, ',v', o_orderkey) AS urls,
  concat(lower(o_orderstatus), ',t', o_orderkey % 7) AS words, concat('u', o_orderkey) AS first_url, '1,2' AS later, CAST(NULL AS VARCHAR) AS nothing
FROM {orders}"""))
def _(t):
    wanted = {
        "id": ([["id"]], "string"), "name": ([["alt"], ["urls", -1, "url"]], "string"),
        "urls": ([["urls", ..., "url"]], "string"), "words": ([["tags", ..., of_type("STRING")]], "string"),
        "first_url": ([["urls", lambda k, v: F.try_variant_get(v, "$.url", "string").isNotNull(), "url", FIRST]], "string"),
        "later": ([["urls", slice(1, None), "index"]], "bigint"), "nothing": ([["empty"], ["stats", "likes"]], "string")}
    out = rc.extract_paths(t["doc_json"], "body", wanted)
    out = rc.extract_paths(out, "body", {"views": ([["STATS", "views"]], "bigint")}, casesense=False)
    join = lambda c: F.array_join(F.transform(c, lambda x: x.cast("string")), ",").alias(c)
    return out.select("media_id", "id", "name", "views", join("urls"), join("words"), "first_url", join("later"), "nothing")


define("pair_a", """
SELECT o_orderkey AS media_id, CASE o_orderkey % 4 WHEN 0 THEN NULL WHEN 1 THEN '' ELSE concat('a', o_orderkey) END AS title,
  CASE WHEN o_orderkey % 5 > 0 THEN o_custkey * (o_orderkey % 3) END AS views FROM {orders} WHERE o_orderkey % 6 > 0""")
define("pair_b", """
SELECT o_orderkey AS media_id, CASE o_orderkey % 3 WHEN 0 THEN NULL WHEN 1 THEN '' ELSE concat('b', o_orderkey) END AS title,
  CAST(7 AS BIGINT) AS views, o_orderstatus AS state FROM {orders} WHERE o_orderkey % 7 > 0""")
define("pair_joined", """
SELECT media_id, a.title AS t1, b.title AS t2, a.views AS v1, b.views AS v2, b.state FROM {pair_a} a FULL JOIN {pair_b} b USING (media_id)""")


@query("E02_first_of", oracle("""
SELECT media_id, coalesce(nullif(t1, ''), nullif(t2, '')) AS title, coalesce(nullif(v1, 0), nullif(v2, 0)) AS views,
  coalesce(t1, t2) AS kept FROM {pair_joined}"""))
def _(t):
    j = t["pair_joined"]
    out = rc.first_of(rc.first_of(j, "title", ["t1", "t2"]), "views", ["v1", "v2"])
    return rc.first_of(out, "kept", ["t1", "t2"], skip_false=False).select("media_id", "title", "views", "kept")


@query("E03_merge_records", oracle("""
SELECT media_id, coalesce(nullif(t1, ''), nullif(t2, ''), t1, t2) AS title, coalesce(v1, v2) AS views, state FROM {pair_joined}"""))
def _(t):
    return rc.merge_records([t["pair_a"], t["pair_b"]], "media_id")


@query("E04_add_defaults", oracle("""
SELECT media_id, coalesce(title, 'untitled') AS title, extractor_key, concat('https://', lower(extractor_key), '.example.com/watch/', id) AS webpage_url,
  id AS webpage_url_basename FROM {media}"""))
def _(t):
    m = t["media"]
    url = F.concat(F.lit("https://"), F.lower("extractor_key"), F.lit(".example.com/watch/"), F.col("id"))
    from ..functions.urls import basename
    out = rc.add_defaults(m, {"title": "untitled", "extractor_key": "Generic", "webpage_url": url})
    return rc.add_defaults(out, {"webpage_url_basename": basename(F.col("webpage_url"))}).select(
        "media_id", "title", "extractor_key", "webpage_url", "webpage_url_basename")


@query("E05_validate", oracle("""
SELECT m.media_id, CASE WHEN id IS NULL THEN 'missing "id"' WHEN title IS NULL THEN 'missing "title"'
  WHEN m.media_id NOT IN (SELECT l_orderkey FROM lineitem) THEN 'no formats found' END AS reason FROM {media} m"""))
def _(t):
    return rc.validate(t["media"], t["formats"]).select("media_id", "reason")


define("loose_numbers", """
SELECT o_orderkey AS media_id, CASE o_orderkey % 4 WHEN 0 THEN CAST(o_custkey AS VARCHAR(20)) WHEN 1 THEN concat(' ', o_custkey, ' ')
  WHEN 2 THEN concat(o_custkey, ' px') END AS width,
  CASE WHEN o_orderkey % 3 = 0 THEN '12.5' WHEN o_orderkey % 3 = 1 THEN concat('-', o_orderkey) END AS view_count FROM {orders}""")
define("loose_values", """
SELECT o_orderkey AS media_id, CASE WHEN o_orderkey % 4 < 2 THEN o_custkey END AS width,
  CASE WHEN o_orderkey % 3 = 1 THEN -o_orderkey END AS view_count FROM {orders}""")


@query("E06_coerce_numeric", oracle("SELECT * FROM {loose_values}"))
def _(t):
    return rc.coerce_numeric(t["loose_numbers"])


@query("E06_coercion_failures", oracle("""
SELECT 'width' AS field, count(l.width) AS present, count(*) FILTER (l.width IS NOT NULL AND v.width IS NULL) AS failed
FROM {loose_numbers} l JOIN {loose_values} v USING (media_id) UNION ALL
SELECT 'view_count', count(l.view_count), count(*) FILTER (l.view_count IS NOT NULL AND v.view_count IS NULL)
FROM {loose_numbers} l JOIN {loose_values} v USING (media_id)"""))
def _(t):
    return rc.coercion_failures(t["loose_numbers"])


define("numbered_items", """
SELECT o_orderkey AS media_id, CAST(o_orderkey AS VARCHAR(20)) AS id, CASE WHEN o_orderkey % 5 > 0 THEN 852076800 + o_orderkey * 86399 END AS timestamp,
  CASE WHEN o_orderkey % 3 = 0 THEN '19990101' END AS upload_date, CASE WHEN o_orderkey % 4 > 0 THEN o_orderkey % 30 END AS episode_number,
  CASE o_orderkey % 7 WHEN 0 THEN '' WHEN 1 THEN 'Pilot' END AS episode FROM {orders}""")


@query("E07_fill_common", oracle("""
SELECT media_id, coalesce(upload_date, strftime(to_timestamp(timestamp) AT TIME ZONE 'UTC', '%Y%m%d')) AS upload_date,
  CASE WHEN coalesce(episode, '') = '' AND episode_number IS NOT NULL THEN 'Episode ' || episode_number ELSE episode END AS episode,
  id AS display_id FROM {numbered_items}"""))
def _(t):
    return rc.fill_common(t["numbered_items"]).select("media_id", "upload_date", "episode", "display_id")


define("thumbs", """
SELECT media_id, pos, CASE WHEN pos % 3 > 0 THEN concat('t', pos % 5) END AS id, concat('//img.example.com/', pos % 97, '.jpg') AS url,
  CASE WHEN pos % 4 > 0 THEN height END AS height, CASE WHEN pos % 5 > 0 THEN CAST(pos % 9 * 160 AS INT) END AS width FROM {formats}""")
define("thumbs_ranked", """
SELECT *, row_number() OVER (PARTITION BY media_id ORDER BY coalesce(width, -1), coalesce(height, -1), coalesce(id, ''), url, pos) - 1 AS rank FROM {thumbs}""")


@query("E08_rank_thumbnails", oracle("""
SELECT media_id, rank, coalesce(id, CAST(rank AS VARCHAR)) AS id, concat('http:', url) AS url,
  CASE WHEN width <> 0 AND height <> 0 THEN width || 'x' || height END AS resolution FROM {thumbs_ranked}"""))
def _(t):
    return rc.rank_thumbnails(t["thumbs"]).select("media_id", "rank", "id", "url", "resolution")


@query("E08_choose_thumbnail", oracle("""
SELECT m.media_id, concat('http:', max_by(r.url, r.rank)) AS thumbnail FROM {media} m LEFT JOIN {thumbs_ranked} r USING (media_id)
GROUP BY m.media_id""".replace("concat('http:', max_by(r.url, r.rank))", "'http:' || max_by(r.url, r.rank)")))
def _(t):
    return rc.choose_thumbnail(t["media"], rc.rank_thumbnails(t["thumbs"])).select("media_id", "thumbnail")


define("song_titles", """
SELECT media_id, CASE WHEN media_id % 3 = 0 THEN concat('Band ', media_id % 50, ' - ', coalesce(title, 'x')) ELSE title END AS title,
  CASE WHEN media_id % 2 = 0 THEN 'old' END AS artist FROM {media}""")


@query("E09_fields_from_title", oracle("""
SELECT media_id, CASE WHEN media_id % 3 = 0 THEN coalesce(m.title, 'x') ELSE m.title END AS title,
  CASE WHEN media_id % 3 = 0 THEN concat('Band ', media_id % 50) WHEN media_id % 2 = 0 THEN 'old' END AS artist FROM {media} m"""))
def _(t):
    return rc.fields_from_title(t["song_titles"], "%(artist)s - %(title)s")


define("tag_sources", """
SELECT media_id, title, CASE WHEN media_id % 4 = 0 THEN concat('track ', media_id) END AS track, CAST(NULL AS VARCHAR(10)) AS artist,
  CASE WHEN media_id % 3 = 0 THEN 'maker' END AS creator, extractor_key AS uploader, CAST(media_id % 12 AS INT) AS track_number,
  CASE WHEN media_id % 5 = 0 THEN 'about' END AS description FROM {media}""")


@query("E10_map_tags", oracle("""
SELECT * FROM (SELECT media_id, unnest(['title', 'description', 'comment', 'track', 'artist']) AS tag,
  unnest([coalesce(track, title), description, description, CAST(track_number AS VARCHAR), coalesce(creator, uploader)]) AS value
FROM {tag_sources}) WHERE value IS NOT NULL"""))
def _(t):
    return rc.map_tags(t["tag_sources"])


define("raw_chapters", """
SELECT l_orderkey AS media_id, CAST(row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_quantity, l_shipdate) - 1 AS BIGINT) AS pos,
  CASE WHEN l_partkey % 6 > 0 THEN l_linenumber * 60.5 + l_quantity END AS start_time, concat('part ', l_partkey) AS title FROM {lineitem}""")
define("durations", "SELECT o_orderkey AS media_id, CASE WHEN o_orderkey % 5 > 0 THEN o_totalprice END AS duration FROM {orders}")


@query("E11_build_chapters", oracle("""
SELECT * FROM (SELECT r.media_id, pos, CAST(start_time AS DOUBLE) AS start_time, CAST(CASE WHEN lead(pos) OVER w IS NULL THEN duration ELSE lead(start_time) OVER w END AS DOUBLE) AS end_time, title
FROM {raw_chapters} r LEFT JOIN {durations} d USING (media_id) WINDOW w AS (PARTITION BY r.media_id ORDER BY pos))
WHERE start_time IS NOT NULL AND end_time IS NOT NULL"""))
def _(t):
    raw = t["raw_chapters"].withColumn("start_time", F.col("start_time").cast("double"))
    return rc.build_chapters(raw, t["durations"])


define("path_items", """
SELECT e.media_id, e.pos, e.playlist_id, m.title, m.id, 'mp4' AS ext, CAST(CASE WHEN m.media_id % 3 > 0 THEN 640 END AS INT) AS width,
  CAST(CASE WHEN m.media_id % 2 > 0 THEN 360 END AS INT) AS height, row_number() OVER (PARTITION BY e.playlist_id ORDER BY e.pos) AS playlist_index,
  count(*) OVER (PARTITION BY e.playlist_id) AS n_entries FROM {playlist_entries} e JOIN {media} m USING (media_id)""")


@query("E12_build_paths", oracle("""
SELECT media_id, concat(lpad(CAST(playlist_index AS VARCHAR), CAST(greatest(length(CAST(n_entries AS VARCHAR)), length(CAST(playlist_index AS VARCHAR))) AS INTEGER), '0'), '-',
  lpad(CAST(row_number() OVER (ORDER BY playlist_id, pos) AS VARCHAR), 5, '0'), '-', coalesce(replace(title, '-', '-'), 'NA'), '-', id, '.',
  coalesce(width || 'x' || height, height || 'p', width || 'x', 'NA'), '.', ext) AS path FROM {path_items}"""
  .replace("lpad(CAST(row_number() OVER (ORDER BY playlist_id, pos) AS VARCHAR), 5, '0')", "printf('%05d', row_number() OVER (ORDER BY playlist_id, pos))")))
def _(t):
    d = rc.autonumbered(t["path_items"], [F.col("playlist_id"), F.col("pos")])
    parts = [("index",), ("text", "-"), ("autonumber",), ("text", "-"), ("field", "title"), ("text", "-"), ("field", "id"),
             ("text", "."), ("resolution",), ("text", "."), ("field", "ext")]
    return rc.build_paths(d, parts).select("media_id", "path")


define("odd_names", """
SELECT media_id, concat(CASE media_id % 6 WHEN 0 THEN '-lead: ' WHEN 1 THEN '.dot/' WHEN 2 THEN 'at 12:30:05 ' WHEN 3 THEN 'why? "' WHEN 4 THEN '__a__' ELSE 'Éa & b|' END,
  coalesce(title, ''), CASE WHEN media_id % 2 = 0 THEN '_' ELSE '' END) AS name FROM {media}""")


@query("E13_safe_names", oracle("""
WITH s AS (SELECT media_id, regexp_replace(name, '([0-9]):([0-9])', '\\1_\\2', 'g') AS s FROM {odd_names}),
a AS (SELECT media_id, replace(replace(replace(s, '?', ''), '"', ''''), ':', ' -') AS f, replace(replace(replace(replace(s, 'É', 'E'), '?', ''), '"', ''), ':', '_-') AS r FROM s),
b AS (SELECT media_id, regexp_replace(f, '[\\\\/|*<>]', '_', 'g') AS f, regexp_replace(regexp_replace(r, '[\\\\/|*<>]', '_', 'g'), '[ &''()]', '_', 'g') AS r FROM a),
c AS (SELECT media_id, regexp_replace(regexp_replace(f, '__+', '_', 'g'), '^_+|_+$', '', 'g') AS f, regexp_replace(regexp_replace(regexp_replace(r, '__+', '_', 'g'), '^_+|_+$', '', 'g'), '^-_', '') AS r FROM b),
d AS (SELECT media_id, regexp_replace(regexp_replace(f, '^-', '_'), '^\\.+', '') AS f, regexp_replace(regexp_replace(r, '^-', '_'), '^\\.+', '') AS r FROM c)
SELECT media_id, CASE WHEN f = '' THEN '_' ELSE f END AS name, CASE WHEN r = '' THEN '_' ELSE r END AS ascii_name FROM d"""))
def _(t):
    d = t["odd_names"].withColumn("ascii_name", F.col("name"))
    return rc.safe_names(rc.safe_names(d, "name"), "ascii_name", restricted=True)


@query("E14_path_collisions", oracle("""
SELECT concat(coalesce(title, 'NA'), '.mp4') AS path, count(*) AS n, min(media_id) AS first_item FROM (
  SELECT media_id, CASE WHEN media_id % 3 = 0 THEN concat('clip ', media_id % 200) ELSE title END AS title FROM {media}) GROUP BY ALL HAVING count(*) > 1"""))
def _(t):
    m = t.sql("SELECT media_id, CASE WHEN media_id % 3 = 0 THEN concat('clip ', media_id % 200) ELSE title END AS title FROM {media}")
    return rc.path_collisions(rc.build_paths(m, [("field", "title"), ("text", ".mp4")]))


def _releases(t):
    asset = lambda n, s, d: F.struct(n.alias("name"), s.alias("size"), d.alias("download_count"))
    k = F.col("o_orderkey")
    return t["orders"].select(k.cast("string").alias("tag"), F.array(
        asset(F.lit("tool"), (k * 7919 + 512).cast("bigint"), F.col("o_custkey")),
        asset(F.concat(F.lit("tool-"), k.cast("string"), F.lit(".zip")), (k * 3 + 1000).cast("bigint"), F.lit(2).cast("bigint"))).alias("assets"))


define("assets", """
SELECT CAST(o_orderkey AS VARCHAR) AS tag, 'tool' AS name, o_orderkey * 7919 + 512 AS size, o_custkey AS downloads FROM {orders} UNION ALL
SELECT CAST(o_orderkey AS VARCHAR), concat('tool-', o_orderkey, '.zip'), o_orderkey * 3 + 1000, 2 FROM {orders}""")
SIZE = """CASE WHEN {0} < 1024 THEN printf('%.2fB', {0} / 1.0) WHEN {0} < 1048576 THEN printf('%.2fKiB', {0} / 1024.0)
  WHEN {0} < 1073741824 THEN printf('%.2fMiB', {0} / 1048576.0) WHEN {0} < 1099511627776 THEN printf('%.2fGiB', {0} / 1073741824.0)
  ELSE printf('%.2fTiB', {0} / 1099511627776.0) END"""


@query("E15_release_assets", oracle(f"SELECT tag, name, {SIZE.format('size')} AS size_text, downloads FROM {{assets}} WHERE name = 'tool'"))
def _(t):
    return rc.release_assets(_releases(t), "tool$")


@query("E15_release_traffic", oracle(f"""
SELECT total_bytes, {SIZE.format('total_bytes')} AS total_text FROM (SELECT CAST(sum(size * downloads) AS BIGINT) AS total_bytes FROM {{assets}})"""))
def _(t):
    # The SQL has a bigint; a total beyond it is null there, and its text says it.
    return rc.release_traffic(_releases(t)).withColumn("total_bytes", F.col("total_bytes").try_cast("bigint"))
