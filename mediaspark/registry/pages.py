"""Queries of family C: page metadata. Pages get extra markup whose values follow from ``page_id``."""

from pyspark.sql import functions as F

from ..fixtures import define, oracle
from ..operators import pages as pg
from . import query

VIDEO_LD = """concat('<script type="application/ld+json">{"@context":"http://schema.org","@type":"VideoObject","name":"Video &amp; ', page_id,
 '","description":"About ', page_id, '","duration":"PT1M', page_id % 60, 'S","uploadDate":"2019-01-02T03:04:05Z","contentUrl":"https://c.example.com/', page_id,
 '.mp4","width":"640","height":360,"author":{"name":"A', page_id, '"},"interactionCount":"', page_id, '","interactionStatistic":[{"@type":"InteractionCounter","interactionType":"http://schema.org/LikeAction","userInteractionCount":"1,',
 100 + page_id % 900, '"},{"@type":"InteractionCounter","interactionType":{"@type":"LikeAction"},"userInteractionCount":5}]}</script>')"""
LIST_LD = """concat('<script type=application/ld+json>[{"@context":"x","@type":"Episode","name":"Ep ', page_id, '","episodeNumber":', page_id % 9,
 ',"partOfSeason":{"@type":"TVSeason","seasonNumber":2,"name":"S2"},"partOfSeries":{"@type":"TVSeries","name":"Show ', page_id % 5, '"}}', CASE WHEN page_id % 8 = 0 THEN concat(
 ',{"@context":"x","@type":"NewsArticle","headline":"H ', page_id, '","datePublished":"2020-02-03T04:05:06Z","articleBody":"Body","video":{"@type":"VideoObject","contentUrl":"https://n.example.com/',
 page_id, '.mp4"}}') ELSE '' END, ']</script><script type="application/ld+json">{broken</script>')"""
HEAD = f"""concat(
 CASE WHEN page_id % 2 = 0 THEN concat('<meta property="og:title" content="OG &amp; ', page_id, '">') WHEN page_id % 4 = 1 THEN concat('<meta content=''Alt ', page_id, ''' name="og-title">') ELSE '' END,
 '<meta name="description" content="Desc ', page_id, '"><meta property="og:image" content="https://i.example.com/', page_id, '.jpg">',
 '<meta property="og:video" content="http://v.example.com/', page_id, '.mp4">', CASE WHEN page_id % 3 = 0 THEN concat('<meta content="https://v.example.com/', page_id, '.mp4" property="og:video:secure_url">') ELSE '' END,
 CASE page_id % 5 WHEN 0 THEN '<meta name="rating" content="RTA-5042-1996-1400-1577-RTA">' WHEN 1 THEN '<meta name="rating" content="Mature">' ELSE '' END,
 CASE page_id % 6 WHEN 0 THEN '<meta itemprop="isFamilyFriendly" content="true">' WHEN 1 THEN '<meta itemprop=isFamilyFriendly content=''False''>' ELSE '' END,
 CASE WHEN page_id % 10 = 0 THEN '<meta http-equiv="refresh" content="0; url=/moved?a=1&amp;b=2">' WHEN page_id % 10 = 5 THEN concat('<meta http-equiv="refresh" content="0; URL=', url, '">') ELSE '' END,
 CASE WHEN page_id % 4 < 3 THEN {VIDEO_LD} ELSE '' END, CASE WHEN page_id % 2 = 0 THEN {LIST_LD} ELSE '' END,
 '<script id="__NEXT_DATA__" type="application/json">{{"props":{{"id":', page_id, ',"t":"a}}b"}}}}</script>')"""
BODY = """concat(CASE WHEN page_id % 7 = 0 THEN '<p>you acknowledge you are at least 21 years old</p>' WHEN page_id % 7 = 1 THEN '<p> 18 USC 2257 </p>' ELSE '' END,
 '<div class="box main wide" id="m', page_id, '">Main &lt;', page_id, '&gt;</div><span class="box">Second</span><b class="boxer">no</b>',
 '<form id="login"><!-- <input type="hidden" name="no" value="1"> --><input type="hidden" name="tok" value="t', page_id, '"><input type=submit id=go value="Go &amp; see"><input type="text" name="q" value="z"></form>',
 '<input name="tok" type="hidden" value="late">')"""
define("aug_pages", f"""
SELECT page_id, url, concat(replace(replace(html, '</head>', concat({HEAD}, '</head>')), '</body>', ''), {BODY}, '</body>') AS html FROM {{pages}}""")

TITLE = r"regexp_extract(html, '<title>([^<]*)</title>', 1)"


def _unent(e):
    for a, b in (("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "''"), ("&copy;", "©"), ("&middot;", "·"), ("&amp;", "&")):
        e = f"replace({e}, '{a}', '{b}')"
    return e


@query("C01_extract_fields", r"""
SELECT page_id, nullif(regexp_extract(html, '<html lang="([^"]+)"', 1), '') AS lang, coalesce(nullif(regexp_extract(html, '<h7>([^<]*)</h7>', 1), ''), nullif(regexp_extract(html, '<h1>([^<]*)</h1>', 1), ''), 'none') AS heading,
  CASE WHEN regexp_matches(html, 'class="ad">[^<]') THEN '' ELSE 'ad' END AS missing FROM pages""")
def _(t):
    spec = {"lang": (r'<html lang="([^"]+)"', None, False), "heading": ([r"<h7>([^<]*)</h7>", r"<h1>([^<]*)</h1>"], "none", False),
            "ad": (r'class="ad">([^<]+)', None, True)}
    return pg.extract_fields(t["pages"], spec).select("page_id", "lang", "heading", F.array_join("missing", ",").alias("missing"))


@query("C02_clean_text", "SELECT page_id, " + "trim(" + _unent(
    r"regexp_replace(regexp_replace(regexp_replace(replace(html, chr(10), ' '), '\s*<\s*br\s*/?\s*>\s*', chr(10), 'g'), '<\s*/\s*p\s*>\s*<\s*p[^>]*>', chr(10), 'g'), '<[^\n]*?>', '', 'g')")
    + ", chr(32) || chr(9) || chr(10)) AS html FROM pages")
def _(t):
    return pg.clean_text(t["pages"].select("page_id", "html"), "html")


@query("C03_open_graph", oracle("""
SELECT page_id, CASE WHEN page_id % 2 = 0 THEN 'OG & ' || page_id WHEN page_id % 4 = 1 THEN 'Alt ' || page_id END AS title, concat('https://i.example.com/', page_id, '.jpg') AS thumbnail,
  concat(CASE WHEN page_id % 3 = 0 THEN 'https' ELSE 'http' END, '://v.example.com/', page_id, '.mp4') AS video FROM {pages}"""))
def _(t):
    return pg.open_graph(t["aug_pages"], {"title": "title", "thumbnail": ["nothing", "image"], "video": "video"}).select(
        "page_id", "title", "thumbnail", "video")


@query("C04_meta_tags", oracle("""
SELECT page_id, concat('Desc ', page_id) AS description, CASE page_id % 6 WHEN 0 THEN 'true' WHEN 1 THEN 'False' ELSE concat('https://i.example.com/', page_id, '.jpg') END AS family FROM {pages}"""))
def _(t):
    return pg.meta_tags(t["aug_pages"], {"description": "description", "family": ["isFamilyFriendly", "og:image"]}).select(
        "page_id", "description", "family")


@query("C05_meta_counts", oracle("""
WITH p AS (SELECT page_id, lower(regexp_extract(url, '^https?://([^/:]+)', 1)) AS site FROM {pages}), n AS (
SELECT site, unnest(list_filter(['description', 'og:image', 'og:video', CASE WHEN page_id % 2 = 0 THEN 'og:title' WHEN page_id % 4 = 1 THEN 'og-title' END, CASE WHEN page_id % 3 = 0 THEN 'og:video:secure_url' END,
  CASE WHEN page_id % 5 < 2 THEN 'rating' END, CASE WHEN page_id % 6 < 2 THEN 'isFamilyFriendly' END, CASE WHEN page_id % 5 = 0 THEN 'refresh' END], lambda x: x IS NOT NULL)) AS name FROM p)
SELECT site, name, count(*) AS n FROM n GROUP BY ALL"""))
def _(t):
    return pg.meta_counts(t["aug_pages"])


@query("C06_page_summary", oracle(f"""
SELECT page_id, CASE WHEN page_id % 2 = 0 THEN 'OG & ' || page_id WHEN page_id % 4 = 1 THEN 'Alt ' || page_id ELSE trim({_unent(TITLE)}) END AS title,
  'https:' AS uploader, CAST(NULL AS VARCHAR) AS description, concat('https://i.example.com/', page_id, '.jpg') AS thumbnail FROM {{pages}}""".replace("'https:' AS uploader", "regexp_extract(url, '^(?:https?://)?([^/]*)/.*', 1) AS uploader")))
def _(t):
    return pg.page_summary(t["aug_pages"])


@query("C07_age_markers", oracle("""
SELECT page_id, CAST(greatest(CASE WHEN page_id % 5 = 0 THEN 18 ELSE 0 END, CASE page_id % 7 WHEN 0 THEN 21 WHEN 1 THEN 18 ELSE 0 END) AS INTEGER) AS age_limit,
  CASE WHEN page_id % 5 = 1 THEN 17 END AS media_rating, CASE page_id % 6 WHEN 0 THEN 0 WHEN 1 THEN 18 END AS family_rating FROM {pages}"""))
def _(t):
    return pg.age_markers(t["aug_pages"])


V1 = "page_id % 4 < 3"
LD = f"""
SELECT page_id, CASE WHEN page_id % 8 = 0 THEN NULL WHEN {V1} THEN 'Video & ' || page_id END AS title,
  CASE WHEN page_id % 2 = 0 THEN NULL WHEN {V1} THEN 'About ' || page_id END AS description,
  CASE WHEN page_id % 8 = 0 THEN 'https://n.example.com/' || page_id || '.mp4' WHEN {V1} THEN 'https://c.example.com/' || page_id || '.mp4' END AS url,
  CASE WHEN page_id % 8 > 0 AND {V1} THEN CAST(60 + page_id % 60 AS DOUBLE) END AS duration, CASE WHEN page_id % 8 > 0 AND {V1} THEN 1546398245 END AS timestamp,
  CASE WHEN page_id % 8 > 0 AND {V1} THEN 'A' || page_id END AS uploader, CASE WHEN page_id % 8 > 0 AND {V1} THEN 640 END AS width,
  CASE WHEN page_id % 8 > 0 AND {V1} THEN page_id END AS view_count, CASE WHEN {V1} THEN 1000 + 100 + page_id % 900 END AS like_count,
  CASE WHEN page_id % 2 = 0 THEN 'Ep ' || page_id END AS episode, CASE WHEN page_id % 2 = 0 THEN page_id % 9 END AS episode_number,
  CASE WHEN page_id % 2 = 0 THEN 'S2' END AS season, CASE WHEN page_id % 2 = 0 THEN 2 END AS season_number, CASE WHEN page_id % 2 = 0 THEN 'Show ' || page_id % 5 END AS series FROM {{pages}}"""
LD_COLS = ["page_id", "title", "description", "url", "duration", "timestamp", "uploader", "width", "view_count", "like_count",
           "episode", "episode_number", "season", "season_number", "series"]


@query("C08_json_ld", oracle(LD.replace("THEN 1546398245 END", "THEN CAST(1546398245 AS BIGINT) END").replace("THEN 640 END", "THEN CAST(640 AS BIGINT) END").replace("THEN 2 END", "THEN CAST(2 AS BIGINT) END")))
def _(t):
    return pg.json_ld(t["aug_pages"]).select(*LD_COLS)


@query("C08_json_ld_expected", oracle(f"""
SELECT page_id, CASE WHEN {V1} THEN 'Video & ' || page_id END AS title, CASE WHEN {V1} THEN 'https://c.example.com/' || page_id || '.mp4' END AS url, CASE WHEN {V1} THEN page_id END AS view_count,
  CAST(NULL AS VARCHAR) AS episode FROM {{pages}}"""))
def _(t):
    return pg.json_ld(t["aug_pages"], "VideoObject").select("page_id", "title", "url", "view_count", "episode")


@query("C09_embedded_json", oracle("SELECT page_id, page_id AS id, 'a}b' AS t FROM {pages}"))
def _(t):
    d = pg.embedded_json(t["aug_pages"], pg.NEXT_DATA)
    return d.select("page_id", F.try_variant_get("data", "$.props.id", "bigint").alias("id"), F.try_variant_get("data", "$.props.t", "string").alias("t"))


@query("C10_select_elements", oracle("""
SELECT page_id, 0 AS pos, concat('Main <', page_id, '>') AS content, 'class' AS by FROM {pages} UNION ALL SELECT page_id, 1, 'Second', 'class' FROM {pages} UNION ALL
SELECT page_id, 0, concat('Main <', page_id, '>'), 'id' FROM {pages}"""))
def _(t):
    p = t["aug_pages"]
    # Each page has an id of its own; here all have the same one.
    same = p.withColumn("html", F.regexp_replace("html", F.concat(F.lit("(id=.?)m"), "page_id", F.lit(r"\b")), F.lit("$1main")))
    return pg.select_elements(p, "class", "box").withColumn("by", F.lit("class")).unionByName(
        pg.select_elements(same, "id", "main").withColumn("by", F.lit("id")))


define("tags", """
SELECT page_id, concat('<el a="foo', page_id, '" B=''b"r'' c=&#98;az', page_id % 3, ' empty= noval blank="" bare entity="&amp;" a="last', page_id, '" d = "x y=z">') AS tag FROM {pages}""")


@query("C11_tag_attributes", oracle("""
SELECT page_id, concat('a=last', page_id, '|b=b"r|bare=NULL|blank=|c=baz', page_id % 3, '|d=x y=z|empty=noval|entity=&') AS shown FROM {pages}"""))
def _(t):
    d = pg.tag_attributes(t["tags"], "tag")
    pairs = F.transform(F.map_entries("attributes"), lambda e: F.concat(e["key"], F.lit("="), F.coalesce(e["value"], F.lit("NULL"))))
    return d.select("page_id", F.array_join(F.array_sort(pairs), "|").alias("shown"))


@query("C12_hidden_inputs", oracle("""
SELECT page_id, 'form' AS scope, 'tok' AS name, concat('t', page_id) AS value FROM {pages} UNION ALL SELECT page_id, 'form', 'go', 'Go & see' FROM {pages} UNION ALL
SELECT page_id, 'page', 'tok', 'late' FROM {pages} UNION ALL SELECT page_id, 'page', 'go', 'Go & see' FROM {pages}"""))
def _(t):
    p = t["aug_pages"]
    return pg.hidden_inputs(p, "login").withColumn("scope", F.lit("form")).unionByName(
        pg.hidden_inputs(p).withColumn("scope", F.lit("page")))


define("page_entries", """
SELECT c_nationkey AS page_id, c_custkey AS pos, concat('p', c_nationkey) AS id, CASE WHEN c_custkey % 3 > 0 THEN concat('Page ', c_nationkey) END AS title FROM {customer} UNION ALL
SELECT 1000 + n_nationkey, CAST(1 AS BIGINT), concat('solo', n_nationkey), 'Solo' FROM {nation}""")


@query("C18_number_entries", oracle("""
WITH n AS (SELECT *, row_number() OVER (PARTITION BY page_id ORDER BY pos) AS n, count(*) OVER (PARTITION BY page_id) AS c FROM {page_entries})
SELECT page_id, pos, CASE WHEN c > 1 THEN id || '-' || n ELSE id END AS id, CASE WHEN c > 1 THEN title || ' (' || n || ')' ELSE title END AS title FROM n"""))
def _(t):
    return pg.number_entries(t["page_entries"]).select("page_id", "pos", "id", "title")


@query("C19_redirect_edges", oracle("""
SELECT page_id, url AS src, concat(regexp_extract(url, '^(https?://[^/]+)', 1), '/moved?a=1&b=2') AS dst FROM {pages} WHERE page_id % 10 = 0"""))
def _(t):
    return pg.redirect_edges(t["aug_pages"])


define("bodies", """
SELECT page_id, CASE page_id % 9 WHEN 0 THEN html WHEN 1 THEN concat('#EXTM3U', chr(10), url) WHEN 2 THEN '<?xml version="1.0"?><!-- c --><rss version="2.0"><channel/></rss>'
  WHEN 3 THEN ' <smil xmlns="x"><body/></smil>' WHEN 4 THEN '<playlist version="1" xmlns="http://xspf.org/ns/0/"></playlist>' WHEN 5 THEN '<MPD xmlns="urn:mpeg:dash:schema:mpd:2011"></MPD>'
  WHEN 6 THEN '<manifest xmlns="http://ns.adobe.com/f4m/1.0"></manifest>' WHEN 7 THEN '<SmoothStreamingMedia MajorVersion="2"></SmoothStreamingMedia>' ELSE 'ID3 binary' END AS body,
  CASE page_id % 4 WHEN 0 THEN 'text/html; charset=latin-1' WHEN 1 THEN 'text/html' END AS content_type FROM {pages}""")


@query("C20_sniff", oracle("""
SELECT page_id, CASE page_id % 9 WHEN 0 THEN 'html' WHEN 1 THEN 'm3u8' WHEN 2 THEN 'rss' WHEN 3 THEN 'smil' WHEN 4 THEN 'xspf' WHEN 5 THEN 'mpd' WHEN 6 THEN 'f4m' WHEN 7 THEN 'ism' ELSE 'direct' END AS kind FROM {pages}"""))
def _(t):
    return pg.sniff(t["bodies"], "body").select("page_id", "kind")


@query("C21_detect_charset", oracle("""
SELECT page_id, CASE WHEN page_id % 4 = 0 THEN 'latin-1' ELSE coalesce(nullif(regexp_extract(body, '<meta charset="([^"]+)"', 1), ''), 'utf-8') END AS charset FROM {bodies}"""))
def _(t):
    return pg.detect_charset(t["bodies"], "body").select("page_id", "charset")


define("filtered_pages", """
SELECT page_id, CASE page_id % 5 WHEN 0 THEN concat('Websense <title>Access to this site is blocked</title>', html) WHEN 1 THEN concat('<title>The URL you requested has been blocked</title>', html)
  WHEN 2 THEN concat(html, '<title>TTK :: Доступ к ресурсу ограничен</title>blocklist.rkn.gov.ru') WHEN 3 THEN concat(html, 'Websense <title>Access to this site is blocked</title>') ELSE html END AS html FROM {pages}""")


@query("C22_split_blocked", oracle("""
SELECT page_id, CASE page_id % 5 WHEN 0 THEN 'filtering software' WHEN 1 THEN 'national censorship' WHEN 2 THEN 'government decision' WHEN 3 THEN CASE WHEN instr(substring(html, 1, 512), 'Websense') > 0 THEN 'filtering software' END END AS blocked FROM {filtered_pages}"""))
def _(t):
    good, bad = pg.split_blocked(t["filtered_pages"])
    return good.select("page_id", F.lit(None).cast("string").alias("blocked")).unionByName(bad.select("page_id", "blocked"))
