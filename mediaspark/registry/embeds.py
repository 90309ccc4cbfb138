"""Queries of family C, C13–C17: media found on pages with added players."""

from pyspark.sql import functions as F

from ..fixtures import define, oracle
from ..operators import embeds as em
from . import query

MEDIA = """concat(CASE WHEN page_id % 2 = 0 THEN concat('<video poster="/p/', page_id, '.jpg" src="main.mp4" type="video/mp4; codecs=&quot;avc1.42,mp4a.40.2&quot;">',
 '<source src="//cdn.example.com/a/', page_id, '.webm" type="video/webm; codecs=&quot;vp8, vorbis&quot;" label="720p"><source data-src="/b.m3u8"><source title="1500 kbps" src="/c.mp4" width="640" height="480"><source label="x">',
 '<track kind="captions" srclang="en" src="/en.vtt"><track src="/x.vtt" label="zz" kind="chapters"><track src="/de.vtt" label="de"></video>') ELSE '' END,
 CASE WHEN page_id % 3 = 0 THEN concat('<audio src="//cdn.example.com/', page_id, '.mp3"/>') ELSE '' END)"""
define("html5_pages", f"SELECT page_id, url, concat(html, {MEDIA}) AS html FROM {{pages}}")
# The self-closed audio tag comes first where both are present.
BASE = "regexp_extract(url, '^(https?://[^?#]*/)', 1)"
ORIGIN = "regexp_extract(url, '^(https?://[^/]+)', 1)"
NO = "CASE WHEN page_id % 6 = 0 THEN 1 ELSE 0 END"


@query("C13_html5_formats", oracle(f"""
SELECT page_id, 0 AS media_no, 0 AS source_no, concat('http://cdn.example.com/', page_id, '.mp3') AS url, 'mp3' AS ext, FALSE AS is_manifest, 'none' AS vcodec, NULL AS acodec, CAST(NULL AS INTEGER) AS width, CAST(NULL AS INTEGER) AS height, CAST(NULL AS INTEGER) AS tbr, NULL AS format_id FROM {{pages}} WHERE page_id % 3 = 0 UNION ALL
SELECT page_id, {NO}, 0, concat({BASE}, 'main.mp4'), 'mp4', FALSE, NULL, NULL, NULL, NULL, NULL, NULL FROM {{pages}} WHERE page_id % 2 = 0 UNION ALL
SELECT page_id, {NO}, 1, concat('http://cdn.example.com/a/', page_id, '.webm'), 'webm', FALSE, NULL, 'vorbis', NULL, 720, NULL, '720p' FROM {{pages}} WHERE page_id % 2 = 0 UNION ALL
SELECT page_id, {NO}, 2, concat({ORIGIN}, '/b.m3u8'), 'm3u8', TRUE, NULL, NULL, NULL, NULL, NULL, NULL FROM {{pages}} WHERE page_id % 2 = 0 UNION ALL
SELECT page_id, {NO}, 3, concat({ORIGIN}, '/c.mp4'), 'mp4', FALSE, NULL, NULL, 640, 480, 1500, '1500 kbps' FROM {{pages}} WHERE page_id % 2 = 0""".replace("'http://cdn", "'//cdn")))
def _(t):
    return em.html5_formats(t["html5_pages"]).drop("referer")


@query("C13_html5_tracks", oracle(f"""
SELECT page_id, {NO} AS media_no, pos, lang, concat({ORIGIN}, link) AS url, concat({ORIGIN}, '/p/', page_id, '.jpg') AS thumbnail
FROM {{pages}}, (VALUES (0, 'en', '/en.vtt'), (2, 'de', '/de.vtt')) v(pos, lang, link) WHERE page_id % 2 = 0"""))
def _(t):
    p = t["html5_pages"]
    return em.html5_subtitles(p).join(em.html5_posters(p), ["page_id", "media_no"])


SETUP = """concat('<script>jwplayer("p1").setup(', CASE page_id % 4
 WHEN 0 THEN concat('{"playlist":[{"mediaid":"m', page_id, '","title":"T &amp; ', page_id, '","duration":"', page_id, '.5","image":"//i.example.com/x.jpg","sources":[{"file":"/v/', page_id, '.mp4","label":"720p","bitrate":1500999},{"file":"/v/', page_id, '.mp4"},{"file":"/v/master.m3u8"},{"file":"a.mp3","type":"audio/mp3"}],"tracks":[{"kind":"Captions","file":"/en.vtt","label":"English"},{"kind":"thumbnails","file":"/t.vtt"}]},{"mediaid":"second","file":"https://www.youtube.com/watch?v=abc"}]}')
 WHEN 1 THEN concat('{"playlist":{"mediaid":"one","title":"Solo","sources":[{"file":"rtmp://s.example.com/app/mp4:clip', page_id, '","height":"360"}]}}')
 WHEN 2 THEN concat('{"mediaid":"bare","file":"/bare/', page_id, '.mpd","season":"3"}') ELSE concat('{mediaid: "js", /* a literal */ title: ''It\\\\''s ', page_id, ''', season: 0x10, nothing: void 0,}') END, ');</script>')"""
define("player_pages", f"SELECT page_id, url, concat(html, {SETUP}) AS html FROM {{pages}}")


@query("C14_player_entries", oracle("""
SELECT page_id, 0 AS item_no, CASE page_id % 4 WHEN 0 THEN 'm' || page_id WHEN 1 THEN 'one' WHEN 2 THEN 'bare' ELSE 'js' END AS id, CASE page_id % 4 WHEN 0 THEN 'T & ' || page_id WHEN 1 THEN 'Solo' WHEN 3 THEN 'It''s ' || page_id END AS title,
  CASE WHEN page_id % 4 = 0 THEN page_id + CAST(0.5 AS DOUBLE) END AS duration, CASE WHEN page_id % 4 = 0 THEN 'http://i.example.com/x.jpg' END AS thumbnail, CASE page_id % 4 WHEN 2 THEN CAST(3 AS BIGINT) WHEN 3 THEN CAST(16 AS BIGINT) END AS season_number FROM {pages}
UNION ALL SELECT page_id, 1, 'second', NULL, NULL, NULL, NULL FROM {pages} WHERE page_id % 4 = 0"""))
def _(t):
    return em.player_entries(em.player_items(em.find_players(t["player_pages"]))).select(
        "page_id", "item_no", "id", "title", "duration", "thumbnail", "season_number")


@query("C14_player_formats", oracle(f"""
SELECT page_id, 0 AS item_no, 0 AS source_no, 'file' AS route, concat({ORIGIN}, '/v/', page_id, '.mp4') AS url, 'mp4' AS ext, NULL AS vcodec, CAST(720 AS BIGINT) AS height, CAST(1500 AS BIGINT) AS tbr, '720p' AS format_id, CAST(NULL AS VARCHAR) AS play_path FROM {{pages}} WHERE page_id % 4 = 0 UNION ALL
SELECT page_id, 0, 1, 'm3u8', concat({ORIGIN}, '/v/master.m3u8'), 'm3u8', NULL, NULL, NULL, NULL, NULL FROM {{pages}} WHERE page_id % 4 = 0 UNION ALL
SELECT page_id, 0, 2, 'file', concat({BASE}, 'a.mp3'), 'mp3', 'none', NULL, NULL, NULL, NULL FROM {{pages}} WHERE page_id % 4 = 0 UNION ALL
SELECT page_id, 1, 0, 'embed', 'https://www.youtube.com/watch?v=abc', 'com/watch', NULL, NULL, NULL, NULL, NULL FROM {{pages}} WHERE page_id % 4 = 0 UNION ALL
SELECT page_id, 0, 0, 'file', 'rtmp://s.example.com/app/', 'flv', NULL, 360, NULL, NULL, concat('mp4:clip', page_id) FROM {{pages}} WHERE page_id % 4 = 1 UNION ALL
SELECT page_id, 0, 0, 'mpd', concat({ORIGIN}, '/bare/', page_id, '.mpd'), 'mpd', NULL, NULL, NULL, NULL, NULL FROM {{pages}} WHERE page_id % 4 = 2""".replace("'com/watch'", "'unknown_video'")))
def _(t):
    return em.player_formats(em.player_items(em.find_players(t["player_pages"]))).select(
        "page_id", "item_no", "source_no", "route", "url", "ext", "vcodec", "height", "tbr", "format_id", "play_path")


@query("C14_player_tracks", oracle(f"""
SELECT page_id, 0 AS item_no, 0 AS pos, 'English' AS lang, concat({ORIGIN}, '/en.vtt') AS url FROM {{pages}} WHERE page_id % 4 = 0"""))
def _(t):
    return em.player_tracks(em.player_items(em.find_players(t["player_pages"])))


VJS = """concat('<script>videojs("v").ready(); p.src(', CASE page_id % 4 WHEN 0 THEN concat('[{"src":"/a/', page_id, '.webm","type":"video/WEBM"},{"type":"video/mp4"},{"src":"/m.m3u8"},{"src":"/d","type":"application/dash+xml"}]')
 WHEN 1 THEN '{"src":"clip.bin"}' WHEN 2 THEN '{"src":"//www.youtube.com/watch?v=q","type":"video/youtube"}' ELSE '{src: "loose"}' END, ');</script>')"""
define("videojs_pages", f"SELECT page_id, url, concat(html, {VJS}) AS html FROM {{pages}}")


@query("C15_videojs_sources", oracle(f"""
SELECT page_id, 0 AS source_no, concat({ORIGIN}, '/a/', page_id, '.webm') AS url, 'file' AS route, 'webm' AS ext FROM {{pages}} WHERE page_id % 4 = 0 UNION ALL
SELECT page_id, 2, concat({ORIGIN}, '/m.m3u8'), 'm3u8', NULL FROM {{pages}} WHERE page_id % 4 = 0 UNION ALL SELECT page_id, 3, concat({ORIGIN}, '/d'), 'mpd', NULL FROM {{pages}} WHERE page_id % 4 = 0 UNION ALL
SELECT page_id, 0, concat({BASE}, 'clip.bin'), 'file', 'mp4' FROM {{pages}} WHERE page_id % 4 = 1 UNION ALL SELECT page_id, 0, '//www.youtube.com/watch?v=q', 'embed', NULL FROM {{pages}} WHERE page_id % 4 = 2
UNION ALL SELECT page_id, 0, concat({BASE}, 'loose'), 'file', 'mp4' FROM {{pages}} WHERE page_id % 4 = 3"""))
def _(t):
    return em.videojs_sources(t["videojs_pages"])


EMB = """concat(CASE WHEN page_id % 3 = 0 THEN concat('<iframe width=1 src="//player.vimeo.com/video/', page_id, '?a=1&amp;b=2"></iframe><iframe src="//player.vimeo.com/video/9"></iframe><iframe src=''//player.vimeo.com/video/9''></iframe>') ELSE '' END,
 CASE page_id % 4 WHEN 0 THEN concat('<embed src="https://www.youtube.com/v/abcdefgh', 100 + page_id % 900, '"><iframe src=''//youtube-nocookie.com/embed/ABCDEFGHIJK''></iframe>') WHEN 1 THEN concat('<div class="lazyYT" data-youtube-id="id', page_id, '">') ELSE '' END)"""
define("embed_pages", f"SELECT page_id, url, concat(html, {EMB}) AS html FROM {{pages}}")


# Vimeo is tried before Youtube, and the first rule that finds anything ends the search.
@query("C16_find_embeds", oracle("""
SELECT page_id, 0 AS pos, 'Youtube' AS extractor_key, concat('https://www.youtube.com/v/abcdefgh', 100 + page_id % 900) AS url FROM {pages} WHERE page_id % 4 = 0 AND page_id % 3 > 0 UNION ALL
SELECT page_id, 1, 'Youtube', 'http://youtube-nocookie.com/embed/ABCDEFGHIJK' FROM {pages} WHERE page_id % 4 = 0 AND page_id % 3 > 0 UNION ALL
SELECT page_id, 0, 'Youtube', concat('id', page_id) FROM {pages} WHERE page_id % 4 = 1 AND page_id % 3 > 0 UNION ALL
SELECT page_id, 0, 'Vimeo', concat('http://player.vimeo.com/video/', page_id, '?a=1&b=2') FROM {pages} WHERE page_id % 3 = 0 UNION ALL
SELECT page_id, 1, 'Vimeo', 'http://player.vimeo.com/video/9' FROM {pages} WHERE page_id % 3 = 0"""))
def _(t):
    return em.find_embeds(t["embed_pages"])


# One page for each rule: (key, markup, URL); # stands for the page's number.
EMBED_SAMPLES = [
    ("RtlNl", '<iframe width=9 src="//static.rtl.nl/embed?uuid=#">', "http://static.rtl.nl/embed?uuid=#"),
    ("Vimeo", '<iframe src="https://player.vimeo.com/video/#?x=1">', "https://player.vimeo.com/video/#?x=1"),
    ("Vidme", '<img src="https://vid.me/e/#"> <img src="https://vid.me/e/second">', "https://vid.me/e/#"),
    ("Youtube", '<embed type="x" src="http://www.youtube.com/v/abcdefghijk?n=#">', "http://www.youtube.com/v/abcdefghijk?n=#"),
    ("Dailymotion", '<iframe src="//www.dailymotion.com/embed/video/x#">', "http://www.dailymotion.com/embed/video/x#"),
    ("Bandcamp", '<meta property="og:url" content="https://band.bandcamp.com/track/#">', "https://band.bandcamp.com/track/#"),
    ("Vevo", '<iframe src="http://cache.vevo.com/m/#">', "http://cache.vevo.com/m/#"),
    ("Viddler", '<param name="movie" value="//www.viddler.com/player/#/">', "http://www.viddler.com/player/#/"),
    ("NYTimes", '<iframe src="http://graphics8.nytimes.com/bcvideo/1/iframe/embed.html?id=#">', "http://graphics8.nytimes.com/bcvideo/1/iframe/embed.html?id=#"),
    ("Libsyn", '<iframe src="//html5-player.libsyn.com/embed/#/x">', "http://html5-player.libsyn.com/embed/#/x"),
    ("Aparat", '<iframe id=a src="http://www.aparat.com/video/#">', "http://www.aparat.com/video/#"),
    ("Mpora", '<iframe id=a src="http://mpora.de/videos/#">', "http://mpora.de/videos/#"),
    ("Facebook", '<iframe src="https://www.facebook.com/plugins/video.php?a=#&amp;b=1">', "https://www.facebook.com/plugins/video.php?a=#&b=1"),
    ("VK", '<iframe src="http://vk.com/video_ext.php?oid=#">', "http://vk.com/video_ext.php?oid=#"),
    ("Ivi", '<embed src="http://www.ivi.ru/video/player?id=#">', "http://www.ivi.ru/video/player?id=#"),
    ("HuffPost", '<iframe src="http://embed.live.huffingtonpost.com/HPLEmbedPlayer/?segmentId=#">', "http://embed.live.huffingtonpost.com/HPLEmbedPlayer/?segmentId=#"),
    ("Embedly", '<a class="embedly-card" href="http://e.example.com/#">', "http://e.example.com/#"),
    ("FunnyOrDie", '<iframe src="http://www.funnyordie.com/embed/#">', "http://www.funnyordie.com/embed/#"),
    ("Tvigle", '<iframe src="//cloud.tvigle.ru/video/#">', "http://cloud.tvigle.ru/video/#"),
    ("TED", '<iframe src="https://embed-ssl.ted.com/talks/#.html">', "https://embed-ssl.ted.com/talks/#.html"),
    ("FranceTV", '<iframe src="http://embed.francetv.fr/?ue=#">', "http://embed.francetv.fr/?ue=#"),
    ("Soundcloud", '<iframe src="https://w.soundcloud.com/player/?url=#">', "https://w.soundcloud.com/player/?url=#"),
    ("Yahoo", '<iframe src="https://screen.yahoo.com/a/#.html?format=embed">', "https://screen.yahoo.com/a/#.html?format=embed"),
    ("SBS", '<meta property="og:video" content="http://www.sbs.com.au/ondemand/video/#/x">', "http://www.sbs.com.au/ondemand/video/#/x"),
    ("Cinchcast", '<iframe src="http://player.cinchcast.com/?id=#">', "http://player.cinchcast.com/?id=#"),
    ("MLB", '<a data-video-link="http://m.mlb.com/video/v#">', "http://m.mlb.com/video/v#"),
    ("Livestream", '<iframe src="https://new.livestream.com/accounts/1/player?x=#">', "https://new.livestream.com/accounts/1/player?x=#"),
    ("Zapiks", '<iframe src="https://www.zapiks.fr/index.php?action=playerIframe&amp;id=#">', "https://www.zapiks.fr/index.php?action=playerIframe&id=#"),
    ("EaglePlatform", '<iframe src="https://media.clipyou.ru/index/player?a=1&record_id=#">', "eagleplatform:media.clipyou.ru:#"),
    ("Playwire", '<script data-config="//config.playwire.com/1/#.json">', "http://config.playwire.com/1/#.json"),
    ("FiveMin", '<meta property="og:video" content="http://embed.5min.com/#/">', "5min:#"),
    ("CrooksAndLiars", '<iframe src="//embed.crooksandliars.com/embed/#">', "http://embed.crooksandliars.com/embed/#"),
    ("NBCNews", '<iframe src="http://www.nbcnews.com/widget/video-embed/#">', "http://www.nbcnews.com/widget/video-embed/#"),
    ("AdobeTVVideo", '<iframe src="//video.tv.adobe.com/v/#/x">', "http://video.tv.adobe.com/v/#/x"),
    ("Vine", '<iframe src="https://vine.co/v/#/embed/simple?audio=1">', "https://vine.co/v/#/embed/simple"),
    ("VODPlatform", '<iframe src="//embed.kwikmotion.com/embed/#/x">', "http://embed.kwikmotion.com/embed/#/x"),
    ("Mangomolo", '<iframe src="//player.mangomolo.com/v1/video?a=1&id=#&b=2">', "http://player.mangomolo.com/v1/video?a=1&id=#&b=2"),
    ("Twitch", '<iframe src="https://player.twitch.tv/?channel=c#">', "https://player.twitch.tv/?channel=c#")]


def _sample(column: int) -> str:
    whens = " ".join(f"WHEN {i} THEN replace('{r[column]}', '#', CAST(page_id AS VARCHAR(20)))" for i, r in enumerate(EMBED_SAMPLES))
    return f"CASE page_id % {len(EMBED_SAMPLES) + 1} {whens} END"


define("embed_rule_pages", f"SELECT page_id, concat(html, coalesce({_sample(1)}, '')) AS html FROM {{pages}}")


@query("C16_embed_rules", oracle(f"""
SELECT page_id, 0 AS pos, {_sample(0)} AS extractor_key, {_sample(2)} AS url FROM {{pages}} WHERE page_id % {len(EMBED_SAMPLES) + 1} < {len(EMBED_SAMPLES)}"""))
def _(t):
    return em.find_embeds(t["embed_rule_pages"])


LINKS = """concat(CASE WHEN page_id % 5 = 0 THEN concat('<script>x flashvars: "a=1&file=http://f.example.com/', page_id, '.png"</script>') ELSE '' END,
 CASE page_id % 4 WHEN 0 THEN concat('<a href="?file=http://s.example.com/a%20b', page_id, '.mp4">x</a> source=http://s.example.com/a%20b', page_id, '.mp4" source=http://s.example.com/two.m3u8"')
 WHEN 1 THEN concat('video_url: "http://u.example.com/w.flv?x=', page_id, '"') WHEN 2 THEN '<meta property="twitter:player:stream" content="/st/x.mpd">' ELSE '' END)"""
define("link_pages", f"SELECT page_id, url, concat(html, {LINKS}) AS html FROM {{pages}}")


@query("C17_scrape_media_links", oracle(f"""
SELECT page_id, 2 AS rule, 0 AS pos, concat('http://s.example.com/a%20b', page_id, '.mp4') AS url, concat('a b', page_id) AS id, 'file' AS route FROM {{pages}} WHERE page_id % 4 = 0 UNION ALL
SELECT page_id, 2, 1, 'http://s.example.com/two.m3u8', 'two', 'm3u8' FROM {{pages}} WHERE page_id % 4 = 0 UNION ALL
SELECT page_id, 3, 0, concat('http://u.example.com/w.flv?x=', page_id), 'w', 'file' FROM {{pages}} WHERE page_id % 4 = 1 UNION ALL
SELECT page_id, 6, 0, concat({ORIGIN}, '/st/x.mpd'), 'x', 'mpd' FROM {{pages}} WHERE page_id % 4 = 2"""))
def _(t):
    return em.scrape_media_links(t["link_pages"])
