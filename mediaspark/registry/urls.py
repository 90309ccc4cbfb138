"""Queries of family B: URLs."""

from pyspark.sql import functions as F

from ..fixtures import define, oracle
from ..functions.patterns import java_pattern
from ..operators import urls as ur
from ..operators.routing import route
from . import query

CATALOG = [
    (0, "Farm", r"https?://spam-farm\.example\.org/(?P<lang>[a-z]{2})/(?P<id>\d+)", "example.org"),
    (1, "BlogCom", r"https?://blog\.[a-z]+\.example\.com/[a-z]{2}/(?P<id>\d+)", "example.com"),
    (2, "BlogNet", r"https?://blog\.[a-z]+\.example\.net/[a-z]{2}/(?P<id>\d+)", "example.net"),
    (3, "MobileHtml", r"https?://m\.[a-z]+\.example\.(?:com|net|org)/[a-z]{2}/(?P<id>\d+)\.html", None),
    (4, "Mobile", r"https?://m\.[^/]+/[a-z]{2}/(?P<id>\d+)", None),
    (5, "French", r"https?://[^/]+/fr/(?P<id>\d+)(?:$|[?#])", None),
    (6, "Tracked", r"https?://[^?]+\?(?:[^#]*&)?utm_source=(?P<id>\w+)", None),
    (7, "Org", r"https?://[^/]+\.example\.org/[a-z]{2}/(?P<id>[^?#]+)", "example.org"),
    (8, "Secure", r"https://(?P<host>[^/]+)/(?P<id>[^#?]*)", None),
    (9, "Generic", r".*", None)]


def catalog(t):
    return t.spark.createDataFrame(CATALOG, "ord int, extractor_key string, url_regex string, host_token string")


def _plain(p):
    return java_pattern(p)[0].replace("'", "''")


ROUTED = ("SELECT page_id, url, CASE " + " ".join(f"WHEN regexp_matches(url, '^(?:{_plain(p)})') THEN {o}" for o, _, p, _ in CATALOG)
          + " END AS ord FROM pages")
ROUTE_SQL = (f"SELECT page_id, ord, CASE ord " + " ".join(f"WHEN {o} THEN '{k}'" for o, k, _, _ in CATALOG) + " END AS extractor_key FROM (" + ROUTED + ")")


@query("B01_route", ROUTE_SQL)
def _(t):
    return route(t["pages"].select("page_id", "url"), catalog(t)).select("page_id", "ord", "extractor_key")


@query("B02_route_prefiltered", ROUTE_SQL)
def _(t):
    return route(t["pages"].select("page_id", "url"), catalog(t), prefilter=True).select("page_id", "ord", "extractor_key")


@query("B03_extract_id", "SELECT page_id, CASE ord " + " ".join(
    f"WHEN {o} THEN regexp_extract(url, '^(?:{_plain(p)})', {java_pattern(p)[1]})" for o, _, p, _ in CATALOG if java_pattern(p)[1])
    + " END AS media_id FROM (" + ROUTED + ")")
def _(t):
    return route(t["pages"].select("page_id", "url"), catalog(t)).select("page_id", "media_id")


# A catalogue with one pattern for each customer, two for every third, and a catch-all; links that name a customer in several spellings.
define("shops", r"""
SELECT CAST(2 * c_custkey AS INT) AS ord, concat('Shop', c_custkey) AS extractor_key,
  concat('https?://(?:www[.])?shop', c_custkey, '[.]example[.]net/(?:watch|v)/(?P<id>[0-9]+)') AS url_regex, 'example.net' AS host_token FROM {customer}
UNION ALL SELECT CAST(2 * c_custkey + 1 AS INT), concat('Any', c_custkey), concat('https?://(?:[^/]+[.])?(?:shop', c_custkey, '|outlet', c_custkey, ')[.]example[.](?:net|org)/'),
  CAST(NULL AS VARCHAR(20)) FROM {customer} WHERE c_custkey % 3 = 0
UNION ALL SELECT 2000000000, 'Generic', '.*', CAST(NULL AS VARCHAR(20))""")

define("shop_links", """
SELECT o_orderkey AS link_id, concat(CASE o_orderkey % 3 WHEN 0 THEN 'http://www.' ELSE 'https://' END, CASE o_orderkey % 5 WHEN 4 THEN 'outlet' ELSE 'shop' END, o_custkey,
  CASE WHEN o_orderkey % 7 = 0 THEN '.example.org' ELSE '.example.net' END, CASE o_orderkey % 4 WHEN 0 THEN '/watch/' WHEN 1 THEN '/v/' ELSE '/list/' END, o_orderkey) AS url FROM {orders}""")

SHOP_SQL = oracle(r"""
WITH p AS (SELECT link_id, url, regexp_extract(url, '(shop|outlet)(\d+)[.]example[.](net|org)/(\w+)/(\d+)', ['kind', 'shop', 'top', 'path', 'id']) AS x FROM {shop_links}),
q AS (SELECT link_id, x, CAST(x.shop AS INT) AS shop, x.kind = 'shop' AND x.top = 'net' AND x.path IN ('watch', 'v') AS own FROM p)
SELECT link_id, CASE WHEN own THEN 2 * shop WHEN shop % 3 = 0 THEN 2 * shop + 1 ELSE 2000000000 END AS ord,
  CASE WHEN own THEN 'Shop' || shop WHEN shop % 3 = 0 THEN 'Any' || shop ELSE 'Generic' END AS extractor_key, CASE WHEN own THEN x.id END AS media_id FROM q""")


@query("B01_route_table", SHOP_SQL)
def _(t):
    return route(t["shop_links"], t["shops"]).drop("url")


@query("B02_route_table_prefiltered", SHOP_SQL)
def _(t):
    return route(t["shop_links"], t["shops"], prefilter=True).drop("url")


define("broken_urls", """
SELECT page_id, CASE page_id % 6 WHEN 0 THEN regexp_replace(url, '^https?:', '') WHEN 1 THEN regexp_replace(url, '^https?:', 'httpss:')
  WHEN 2 THEN regexp_replace(url, '^https?:', 'rmtpe:') WHEN 3 THEN concat(' ', url) WHEN 4 THEN concat('ftp2', url) ELSE url END AS url FROM {pages}""")


@query("B04_sanitize_urls", oracle("""
SELECT page_id, CASE page_id % 6 WHEN 0 THEN regexp_replace(url, '^https?:', 'http:') WHEN 1 THEN regexp_replace(url, '^https?:', 'https:')
  WHEN 2 THEN regexp_replace(url, '^https?:', 'rtmpe:') WHEN 3 THEN ' ' || url WHEN 4 THEN 'ftp2' || url ELSE url END AS url FROM {pages}"""))
def _(t):
    return ur.sanitize_urls(t["broken_urls"], "url")


@query("B05_valid_urls", oracle("""
SELECT page_id, CASE page_id % 6 WHEN 0 THEN regexp_replace(url, '^https?:', '') WHEN 3 THEN url WHEN 5 THEN url END AS url FROM {pages}"""))
def _(t):
    return ur.valid_urls(t["broken_urls"], "url")


define("links", """
SELECT page_id, CASE WHEN page_id % 11 = 0 THEN concat('mailto:', page_id) ELSE url END AS url, CASE page_id % 8 WHEN 0 THEN 'clip.mp4' WHEN 1 THEN '../up/./clip.mp4?x=1' WHEN 2 THEN '/top/a/../clip.mp4'
  WHEN 3 THEN '//cdn.example.com/c.mp4' WHEN 4 THEN '?only=query' WHEN 5 THEN 'https://other.example.com/../z' WHEN 6 THEN '' ELSE 'sub/' END AS link FROM {pages}""")


@query("B06_resolve_links", oracle("""
WITH x AS (SELECT *, regexp_extract(url, '^(https?://[^/]+)', 1) AS origin, regexp_extract(url, '^(https?://[^?#]*/)', 1) AS dir FROM {links})
SELECT page_id, CASE page_id % 8 WHEN 3 THEN link WHEN 5 THEN link WHEN 6 THEN NULL ELSE CASE WHEN url LIKE 'mailto%' THEN NULL ELSE
  CASE page_id % 8 WHEN 0 THEN dir || 'clip.mp4' WHEN 1 THEN regexp_replace(dir, '[^/]+/$', '') || 'up/clip.mp4?x=1' WHEN 2 THEN origin || '/top/clip.mp4'
  WHEN 4 THEN regexp_extract(url, '^([^?#]*)', 1) || '?only=query' ELSE dir || 'sub/' END END END AS resolved FROM x"""))
def _(t):
    return ur.resolve_links(t["links"], "url", "link").select("page_id", "resolved")


define("wild_urls", """
SELECT page_id, concat('https://www.example.com/a/./b', page_id % 3, '/../c d/', CASE page_id % 4 WHEN 0 THEN 'é' WHEN 1 THEN '%20' WHEN 2 THEN '日本' ELSE '~x' END,
  '/../e', page_id, '/', '?q=', CASE page_id % 2 WHEN 0 THEN 'ü|1' ELSE 'a+b' END, '#f"g') AS url FROM {pages}""")


@query("B07_normalise_urls", oracle("""
SELECT page_id, concat('https://www.example.com/a/c%20d/e', page_id, '/?q=', CASE page_id % 2 WHEN 0 THEN '%C3%BC%7C1' ELSE 'a+b' END, '#f%22g') AS url FROM {pages}"""))
def _(t):
    return ur.normalise_urls(t["wild_urls"], "url")


define("query_urls", """
SELECT page_id, concat('https://e.com/w', page_id % 5, CASE page_id % 3 WHEN 0 THEN '?id=7&list=a%20b&id=8&x=' WHEN 1 THEN '?list=z+y&t=*~' ELSE '' END, '#top') AS url FROM {pages}""")


@query("B08_update_query", oracle("""
SELECT page_id, concat('https://e.com/w', page_id % 5, CASE page_id % 3 WHEN 0 THEN '?id=7&id=8&list=new+1&v=2' WHEN 1 THEN '?list=new+1&t=%2A~&v=2' ELSE '?list=new+1&v=2' END, '#top') AS url,
  CASE page_id % 3 WHEN 0 THEN '7,8' ELSE '' END AS ids FROM {pages}"""))
def _(t):
    out = ur.update_query(t["query_urls"], "url", {"list": "new 1", "v": "2"})
    return ur.query_values(out, "url", "id", "ids").select("page_id", "url", F.array_join("ids", ",").alias("ids"))


@query("B10_url_parts", """
WITH x AS (SELECT page_id, url, regexp_extract(url, '^https?://[^/]+([^?#]*)', 1) AS path, regexp_extract(regexp_replace(url, '/+$', ''), '([^/]*)$', 1) AS tail FROM pages),
y AS (SELECT *, regexp_extract(regexp_replace(path, '/+$', ''), '([^/]*)$', 1) AS basename FROM x)
SELECT page_id, basename, regexp_extract(url, '^(https?://[^?#&]+/)', 1) AS base_url, regexp_replace(tail, '\\.[^.]*$', '') AS generic_id,
  regexp_replace(basename, '\\.[^.]*$', '') AS generic_title FROM y""")
def _(t):
    return ur.url_parts(t["pages"].select("page_id", "url"), "url").drop("url")


define("media_urls", """
SELECT page_id, CASE page_id % 7 WHEN 0 THEN concat(url, '/v.mp4?token=a.b') WHEN 1 THEN 'rtmp://s.example.com/live/x' WHEN 2 THEN 'https://e.com/master.m3u8'
  WHEN 3 THEN 'https://e.com/v.webm/?download' WHEN 4 THEN 'https://e.com/x.y/z' WHEN 5 THEN 'mms://m.example.com/manifest.f4m' ELSE 'nodots' END AS url,
  CASE WHEN page_id % 10 = 0 THEN 'dash' END AS protocol FROM {pages}""")


@query("B11_infer_ext", oracle("""
SELECT page_id, CASE page_id % 7 WHEN 0 THEN CASE WHEN url LIKE '%?%?%' THEN CASE WHEN regexp_matches(url, '^[^?]*\\.html') THEN 'html' ELSE 'unk' END ELSE 'mp4' END
  WHEN 1 THEN 'unk' WHEN 2 THEN 'm3u8' WHEN 3 THEN 'webm' WHEN 4 THEN 'unk' WHEN 5 THEN 'f4m' ELSE 'unk' END AS ext FROM {media_urls}"""))
def _(t):
    return ur.infer_ext(t["media_urls"], "url", "unk").select("page_id", "ext")


@query("B12_infer_protocol", oracle("""
SELECT page_id, coalesce(protocol, CASE page_id % 7 WHEN 0 THEN regexp_extract(url, '^(https?):', 1) WHEN 1 THEN 'rtmp' WHEN 2 THEN 'm3u8' WHEN 3 THEN 'https' WHEN 4 THEN 'https' WHEN 5 THEN 'mms' ELSE '' END) AS protocol FROM {media_urls}"""))
def _(t):
    return ur.infer_protocol(t["media_urls"]).select("page_id", "protocol")


define("podcasts", """
SELECT o_orderkey AS id, concat('https://', CASE o_orderkey % 6 WHEN 0 THEN 'chtbl.com/track/123/' WHEN 1 THEN 'www.podtrac.com/pts/redirect.mp3/' WHEN 2 THEN 'flex.acast.com/'
  WHEN 3 THEN 'pdst.fm/e/chtbl.com/track/9A/' WHEN 4 THEN 'media.blubrry.com/show/' ELSE '' END, 'pod.example.com/', o_custkey, '/', o_orderkey % 2, '.mp3') AS url FROM {orders}""")


@query("B13_strip_trackers", oracle("""
SELECT concat('https://pod.example.com/', o_custkey, '/', o_orderkey % 2, '.mp3') AS url, min(o_orderkey) AS id, count(*) AS copies FROM {orders} GROUP BY ALL"""))
def _(t):
    return ur.strip_trackers(t["podcasts"], "url", "id")


define("searches", """
SELECT c_custkey, concat('clips', CASE c_custkey % 5 WHEN 0 THEN '' WHEN 1 THEN 'all' WHEN 2 THEN '3' WHEN 3 THEN '99' ELSE '0' END, ':brand', c_custkey % 25) AS text FROM {customer}""")
define("search_results", """
SELECT 'clips' AS search_key, concat('brand', substring(p_brand, 7, 3)) AS query, p_partkey AS pos, concat('https://e.com/p/', p_partkey) AS url FROM {part}""")


@query("B14_expand_search", oracle("""
WITH r AS (SELECT *, row_number() OVER (PARTITION BY query ORDER BY pos) AS place FROM {search_results}),
q AS (SELECT c_custkey, text, concat('brand', c_custkey % 25) AS query, CASE c_custkey % 5 WHEN 0 THEN 1 WHEN 1 THEN 20 WHEN 2 THEN 3 WHEN 3 THEN 20 ELSE 0 END AS n FROM {searches})
SELECT c_custkey, place, url AS result_url, TRUE AS valid FROM q JOIN r USING (query) WHERE place <= n UNION ALL
SELECT c_custkey, NULL, NULL, FALSE FROM q WHERE n = 0"""))
def _(t):
    return ur.expand_search(t["searches"], t["search_results"], 20).select("c_custkey", "place", "result_url", "valid")


define("site_tests", """
SELECT concat('Customer#', lpad(CAST(o_custkey AS VARCHAR(9)), 9, '0')) AS extractor_key, CASE WHEN o_orderkey % 4 > 0 THEN CAST(18 AS INT) WHEN o_orderkey % 8 = 0 THEN 12 END AS age_limit FROM {orders}""")


@query("B15_list_suitable", oracle("""
SELECT c_name AS extractor_key FROM {customer} c WHERE NOT EXISTS (SELECT 1 FROM {site_tests} s WHERE s.extractor_key = c_name)
  OR EXISTS (SELECT 1 FROM {site_tests} s WHERE s.extractor_key = c_name AND (age_limit IS NULL OR age_limit <= 16))"""))
def _(t):
    return ur.list_suitable(t["customer"].select(F.col("c_name").alias("extractor_key")), t["site_tests"], 16)


define("cdn_urls", """
SELECT page_id, CASE page_id % 4 WHEN 0 THEN concat('https://h.akamaihd.net/i/v', page_id, '/master.m3u8?b=100-2000&__a__=off') WHEN 1 THEN concat('http://h.net/z/v', page_id, '/manifest.f4m?hdnea=x&b=1')
  WHEN 2 THEN concat('https://w.net/vod/smil:', page_id, '.smil/playlist.m3u8?t=1') ELSE concat('rtmp://w.net/vod/mp4:', page_id, '.mp4') END AS url FROM {pages}""")


@query("B16_derive_manifest_urls", oracle("""
SELECT page_id, kind, derived_url FROM (
SELECT page_id, unnest(['hds', 'hls']) AS kind, unnest(CASE page_id % 4
  WHEN 0 THEN [concat('https://h.akamaihd.net/z/v', page_id, '/manifest.f4m?hdcore=3.7.0'), concat('https://h.akamaihd.net/i/v', page_id, '/master.m3u8')]
  ELSE [concat('http://h.net/z/v', page_id, '/manifest.f4m?hdnea=x&b=1&hdcore=3.7.0'), concat('http://h.net/i/v', page_id, '/master.m3u8?hdnea=x&b=1')] END) AS derived_url FROM {pages} WHERE page_id % 4 < 2
UNION ALL SELECT page_id, unnest(['hls', 'hds', 'dash', 'smil']), unnest([concat('https://w.net/vod/smil:', page_id, '.smil/', f, '?t=1') FOR f IN ['playlist.m3u8', 'manifest.f4m', 'manifest.mpd', 'jwplayer.smil']]) FROM {pages} WHERE page_id % 4 = 2
UNION ALL SELECT page_id, unnest(['hls', 'hds', 'dash', 'rtmp', 'rtsp']), unnest([concat('http://w.net/vod/mp4:', page_id, '.mp4/playlist.m3u8'), concat('http://w.net/vod/mp4:', page_id, '.mp4/manifest.f4m'),
  concat('http://w.net/vod/mp4:', page_id, '.mp4/manifest.mpd'), concat('rtmp://w.net/vod/mp4:', page_id, '.mp4'), concat('rtsp://w.net/vod/mp4:', page_id, '.mp4')]) FROM {pages} WHERE page_id % 4 = 3)"""))
def _(t):
    d = t["cdn_urls"]
    a, w = ur.derive_akamai(d.filter("page_id % 4 < 2")), ur.derive_wowza(d.filter("page_id % 4 >= 2"))
    return a.unionByName(w).select("page_id", "kind", "derived_url")
