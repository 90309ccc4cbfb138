"""Media on stored pages (family C, C13–C17): players, sources, embeds and plain links.

One page is one row, so everything is found by per-row expressions and exploded at the end; a page's
rules are tried in order and stop at the first that gives something, without a shuffle.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from ..functions import html as hx, js, text as tx, urls as ux, values as vx
from ..functions.core import let

# The names of media elements, and what a self-closed and a paired one looks like.
_TAG = r"(?:(?:amp|dl8(?:-live)?)-)?(video(?:-js)?|audio)"
_CLOSED = rf"(?s)<{_TAG}[^>]*/>"
_PAIRED = rf"(?s)<((?:(?:amp|dl8(?:-live)?)-)?(?:video(?:-js)?|audio))((?:\s+[^>]*)?)>(.*?)</\1>"


def _media(html: Column) -> Column:
    """array<struct<kind, tag, body>>: self-closed media tags first, then paired ones."""
    kind = lambda x: F.when(F.regexp_extract(x, "^<?([a-z0-9-]+)", 1).rlike("audio$"), F.lit("audio")).otherwise(F.lit("video"))
    closed = F.transform(F.regexp_extract_all(html, F.lit(_CLOSED), F.lit(0)),
                         lambda x: F.struct(kind(x).alias("kind"), x.alias("tag"), F.lit("").alias("body")))
    whole = F.regexp_extract_all(html, F.lit(_PAIRED), F.lit(0))
    paired = F.transform(whole, lambda x: F.struct(
        kind(x).alias("kind"), F.regexp_extract(x, r"(?s)^(<[^>]*>)", 1).alias("tag"),
        F.regexp_extract(x, r"(?s)^<[^>]*>(.*)</[^<]*$", 1).alias("body")))
    return F.concat(closed, paired)


def _media_rows(pages: DataFrame) -> DataFrame:
    rows = pages.select("page_id", "url", F.posexplode(_media(F.col("html"))).alias("media_no", "m"))
    return rows.select("page_id", "url", "media_no", "m.kind", hx.attributes(F.col("m.tag")).alias("a"), "m.body")


def _type_info(mime: Column):
    """(extension, codecs struct) of a source's type attribute."""
    kind = F.regexp_extract(mime, r"([^/]+/[^;]+)", 1)
    codecs = F.regexp_extract(mime, r"""[^/]+/[^;]+;\s*codecs="?([^"]+)""", 1)
    return F.nullif(vx.mime_ext(F.nullif(kind, F.lit(""))), F.lit("")), codecs


def html5_formats(pages: DataFrame) -> DataFrame:
    """Renditions of ``<video>`` and ``<audio>`` elements, their own source first.

    Sources that are manifests are flagged and carry no further fields. ``referer`` is the page.
    """
    m = _media_rows(pages)
    trimmed = lambda c: F.nullif(F.trim(c), F.lit(""))
    # The element's own attributes and those of its nested sources, from one reading of the page.
    tags = F.regexp_extract_all("body", F.lit(r"(<source[^>]+>)"), F.lit(1))
    every = F.concat(F.array("a"), F.coalesce(F.transform(tags, lambda t: hx.attributes(t)), F.expr("slice(array(a), 1, 0)")))
    s = m.select("page_id", "url", "media_no", "kind", F.posexplode(every).alias("n", "a")).withColumn("own", F.col("n") == 0)
    nested = F.coalesce(*[F.nullif(hx.get(F.col("a"), k), F.lit("")) for k in ("src", "data-video-src", "data-src")])
    s = s.withColumn("src", trimmed(F.when(F.col("own"), hx.get(F.col("a"), "src")).otherwise(nested))).filter(F.col("src").isNotNull())
    a = F.col("a")
    mime_ext, codecs = _type_info(hx.get(a, "type"))
    full = ux.resolve(F.col("url"), F.col("src"))
    s = s.withColumn("media_url", full).withColumn("ext", F.coalesce(mime_ext, ux.ext_of(F.col("media_url")))) \
        .withColumn("codecs", vx.codecs(F.nullif(codecs, F.lit("")))).withColumn("is_manifest", F.col("ext").isin("m3u8", "mpd"))
    plain = ~F.col("own") & ~F.col("is_manifest")
    number = lambda k: F.nullif(vx.int_or_null(hx.get(a, k)), F.lit(0))
    labels = [hx.get(a, "label"), hx.get(a, "title")]
    seen = [vx.resolution(x) for x in labels]
    width = F.coalesce(number("width"), *[r["width"] for r in seen])
    height = F.coalesce(number("height"), number("res"), *[r["height"] for r in seen])
    # Labels are read only where width or height is missing.
    both = number("width").isNotNull() & F.coalesce(number("height"), number("res")).isNotNull()
    only = lambda c: F.when(plain, c)
    return s.select(
        "page_id", "media_no", F.col("n").alias("source_no"), F.col("media_url").alias("url"), "ext", "is_manifest",
        F.when((F.col("kind") == "audio") & ~F.col("is_manifest"), F.lit("none")).alias("vcodec"),
        only(F.col("codecs.acodec")).alias("acodec"),
        only(F.when(both, number("width")).otherwise(width).cast("int")).alias("width"),
        only(F.when(both, F.coalesce(number("height"), number("res"))).otherwise(height).cast("int")).alias("height"),
        only(F.coalesce(*[F.nullif(vx.bitrate(x), F.lit(0)) for x in labels])).alias("tbr"),
        only(F.coalesce(*[F.nullif(x, F.lit("")) for x in labels])).alias("format_id"), F.col("url").alias("referer"))


def html5_subtitles(pages: DataFrame) -> DataFrame:
    """Caption and subtitle tracks of media elements."""
    m = _media_rows(pages)
    tags = F.regexp_extract_all("body", F.lit(r"(<track[^>]+>)"), F.lit(1))
    tr = m.select("page_id", "url", "media_no", F.posexplode(tags).alias("pos", "t")).withColumn("a", hx.attributes(F.col("t")))
    a, kind = F.col("a"), hx.get(F.col("a"), "kind")
    src = F.nullif(F.trim(hx.get(a, "src")), F.lit(""))
    lang = F.coalesce(*[F.nullif(hx.get(a, k), F.lit("")) for k in ("srclang", "lang", "label")])
    rows = tr.filter(F.coalesce(kind, F.lit("")).isin("", "subtitles", "captions") & src.isNotNull())
    return rows.select("page_id", "media_no", "pos", lang.alias("lang"), ux.resolve(F.col("url"), src).alias("url"))


def html5_posters(pages: DataFrame) -> DataFrame:
    """Poster image per media element."""
    return _media_rows(pages).select("page_id", "media_no", ux.resolve(F.col("url"), hx.get(F.col("a"), "poster")).alias("thumbnail"))


# --- player configurations ----------------------------------------------------------------------

# Fixed value: where a player is set up or given a list, up to the end of the script.
_SETUP = r"""(?s)(?<!-)\bjwplayer\s*\(\s*(?:"[^"]+"|'[^']+')\s*\).*?\.\s*(?:setup|load)\s*\(\s*([{\[].*?)</script>"""


def _v(x: Column, path: str, kind: str = "string") -> Column:
    return F.try_variant_get(x, path, kind)


def _listed(v: Column) -> Column:
    """An array as it is, any other value as an array of one."""
    return F.coalesce(_v(v, "$", "array<variant>"), F.when(v.isNotNull(), F.array(v)))


def player_items(pages: DataFrame, col: str = "config") -> DataFrame:
    """Playlist items of player configurations: a list, one item, or the bare configuration (C14).

    ``pages`` has the configuration as VARIANT in ``config``; see ``find_players``.
    """
    c = F.col(col)
    many = F.coalesce(_listed(_v(c, "$.playlist", "variant")), _v(c, "$", "array<variant>"), F.array(c))
    rows = pages.select("page_id", "url", F.posexplode(many).alias("item_no", "item"))
    return rows.filter(rows["item"].isNotNull())


def find_players(pages: DataFrame) -> DataFrame:
    """Add the first player configuration of each page as VARIANT ``config``, null without one (C14).

    It may be JSON or a JavaScript literal, the argument of ``setup`` or the list given to ``load``; its own brackets bound it.
    """
    return pages.withColumn("config", F.try_parse_json(js.to_json(F.nullif(F.regexp_extract("html", _SETUP, 1), F.lit("")))))


def player_entries(items: DataFrame) -> DataFrame:
    """Record fields of player items (C14)."""
    i = F.col("item")
    whole = lambda k: vx.int_or_null(_v(i, f"$.{k}"))
    clean = lambda *ks: let(F.coalesce(*[F.nullif(_v(i, f"$.{k}"), F.lit("")) for k in ks]), tx.clean_html)
    return items.select(
        "page_id", "item_no", _v(i, "$.mediaid").alias("id"), let(_v(i, "$.title"), tx.unescape).alias("title"),
        clean("description").alias("description"), ux.resolve(F.col("url"), ux.sanitize(_v(i, "$.image"))).alias("thumbnail"),
        whole("pubdate").alias("timestamp"), vx.float_or_null(_v(i, "$.duration")).alias("duration"),
        clean("subtitle").alias("alt_title"), clean("genre").alias("genre"), clean("category", "channel").alias("channel"),
        whole("season").alias("season_number"), whole("episode").alias("episode_number"),
        whole("releasedate").alias("release_year"), whole("age_restriction").alias("age_limit"))


def player_formats(items: DataFrame) -> DataFrame:
    """Renditions of player items; repeated source URLs of an item are dropped (C14).

    ``route`` is ``m3u8``, ``mpd`` or ``smil`` for manifests, ``embed`` for the lone source of an item
    that is a known player page, else ``file``.
    """
    i = F.col("item")
    sources = F.coalesce(_v(i, "$.sources", "array<variant>"), F.array(i))
    link = lambda s: ux.resolve(F.col("url"), ux.sanitize(_v(s, "$.file")))
    rows = F.transform(sources, lambda s: F.struct(link(s).alias("u"), s.alias("s")))
    rows = F.filter(rows, lambda r: r["u"].isNotNull())
    firsts = let(rows, lambda rs: F.filter(rs, lambda r, k: F.array_position(F.transform(rs, lambda q: q["u"]), r["u"]) == k + 1))
    d = items.withColumn("__f", firsts).select("page_id", "url", "item_no", F.size("__f").alias("n"), F.posexplode("__f").alias("source_no", "r"))
    s, u = F.col("r.s"), F.col("r.u")
    kind = F.coalesce(_v(s, "$.type"), F.lit(""))
    ext = F.coalesce(F.nullif(vx.mime_ext(F.nullif(kind, F.lit(""))), F.lit("")), ux.ext_of(u))
    hls = (kind == "hls") | (ext == "m3u8") | u.contains("format=m3u8-aapl")
    dash = (kind == "dash") | (ext == "mpd") | u.contains("format=mpd-time-csf")
    lone = (F.col("n") == 1) & u.rlike(r"^(?:http|//).*(?:youtube\.com|youtu\.be)/.+")
    route = (F.when(lone, F.lit("embed")).when(hls, F.lit("m3u8")).when(dash, F.lit("mpd")).when(ext == "smil", F.lit("smil"))
             .otherwise(F.lit("file")))
    audio = kind.startswith("audio") | ext.isin("oga", "aac", "mp3", "mpeg", "vorbis")
    rtmp = u.startswith("rtmp")
    play = F.nullif(F.regexp_extract(u, r"((?:mp4|mp3|flv):.*)$", 1), F.lit(""))
    label = _v(s, "$.label")
    file_ = route == "file"
    only = lambda c: F.when(file_ & ~audio, c)
    height = F.coalesce(vx.int_or_null(_v(s, "$.height")), vx.resolution(label)["height"].cast("bigint"))
    return d.select(
        "page_id", "item_no", "source_no", route.alias("route"),
        F.when(file_ & ~audio & rtmp & play.isNotNull(), F.regexp_extract(u, r"^(.*?)(?:mp4|mp3|flv):", 1)).otherwise(u).alias("url"),
        F.when(file_ & ~audio & rtmp, F.lit("flv")).otherwise(ext).alias("ext"), F.when(file_ & audio, F.lit("none")).alias("vcodec"),
        only(vx.int_or_null(_v(s, "$.width"))).alias("width"), only(height).alias("height"),
        only(vx.int_or_null(_v(s, "$.bitrate"), scale=1000)).alias("tbr"), only(vx.int_or_null(_v(s, "$.filesize"))).alias("filesize"),
        only(label).alias("format_id"), only(F.when(rtmp, play)).alias("play_path"))


def player_tracks(items: DataFrame) -> DataFrame:
    """Caption tracks of player items (C14)."""
    rows = items.select("page_id", "url", "item_no", F.posexplode(_v(F.col("item"), "$.tracks", "array<variant>")).alias("pos", "t"))
    t = F.col("t")
    link = ux.sanitize(ux.resolve(F.col("url"), _v(t, "$.file")))
    rows = rows.filter(F.lower(_v(t, "$.kind")).isin("captions", "subtitles") & link.isNotNull())
    return rows.select("page_id", "item_no", "pos", F.coalesce(F.nullif(_v(t, "$.label"), F.lit("")), F.lit("en")).alias("lang"), link.alias("url"))


# Fixed value: where this player is given its sources.
_VIDEOJS = r"(?s)\bvideojs\s*\(.+?\.src\s*\(\s*((?:\[.+?\]|\{.+?\}))\s*\)\s*;"


def videojs_sources(pages: DataFrame) -> DataFrame:
    """Sources given to a video.js player: an object or a list, also as a JavaScript literal; ones without a text ``src`` are skipped."""
    conf = F.try_parse_json(js.to_json(F.nullif(F.regexp_extract("html", _VIDEOJS, 1), F.lit(""))))
    rows = pages.select("page_id", "url", F.posexplode(_listed(conf)).alias("source_no", "s"))
    s = F.col("s")
    src = F.when(F.schema_of_variant(_v(s, "$.src", "variant")) == "STRING", F.nullif(_v(s, "$.src"), F.lit("")))
    rows = rows.withColumn("src", F.coalesce(ux.resolve(F.col("url"), src), src)).filter(F.col("src").isNotNull())
    kind, ext = F.lower(_v(s, "$.type")), F.lower(ux.ext_of(F.col("src")))
    route = (F.when(kind == "video/youtube", F.lit("embed")).when((kind == "application/dash+xml") | (ext == "mpd"), F.lit("mpd"))
             .when((kind == "application/x-mpegurl") | (ext == "m3u8"), F.lit("m3u8")).otherwise(F.lit("file")))
    # The extension rule keeps its odd grouping: the type or the URL's extension only where the latter is known.
    file_ext = F.when(ext.isin(ux.KNOWN_EXTS), F.coalesce(vx.mime_ext(kind), ext)).otherwise(F.lit("mp4"))
    out = rows.withColumn("route", route).withColumn("ext", F.when(route == "file", file_ext))
    return out.select("page_id", "source_no", F.col("src").alias("url"), "route", "ext")


# --- embeds and links ---------------------------------------------------------------------------

# Players whose embeds are known, in order of trial: (key, text that the page must hold, pattern, group, text put before the match, whether
# all matches count or the first one only).
EMBED_RULES = [
    ("RtlNl", "rtl.nl/", r"""<iframe[^>]+?src="((?:https?:)?//(?:(?:www|static)\.)?rtl\.nl/(?:system/videoplayer/[^"]+(?:video_)?)?embed[^"]+)\"""", 1, "", True),
    ("Vimeo", "player.vimeo.com/video/", r"""<iframe[^>]+?src=(["'])((?:https?:)?//player\.vimeo\.com/video/\d+.*?)\1""", 2, "", True),
    ("Vidme", "://vid.me/", r"""src=['"](https?://vid\.me/[^'"]+)['"]""", 1, "", False),
    ("Youtube", "youtube", r"""(?:<iframe[^>]+?src=|data-video-url=|<embed[^>]+?src=|<object[^>]+data=|new\s+SWFObject\()(["'])((?:https?:)?//(?:www\.)?youtube(?:-nocookie)?\.com/(?:embed|v|p)/[0-9A-Za-z_-]{11}.*?)\1""", 2, "", True),
    ("Youtube", "lazyYT", r"""class="lazyYT" data-youtube-id="([^"]+)\"""", 1, "", True),
    ("Dailymotion", "dailymotion.com/", r"""<(?:(?:embed|iframe)[^>]+?src=|input[^>]+id=['"]dmcloudUrlEmissionSelect['"][^>]+value=)(["'])((?:https?:)?//(?:www\.)?dailymotion\.com/(?:embed|swf)/video/.+?)\1""", 2, "", True),
    ("Bandcamp", "bandcamp.com", r"""<meta property="og:url"[^>]*?content="(.*?bandcamp\.com.*?)\"""", 1, "", False),
    ("Vevo", "vevo.com/", r"""<iframe[^>]+?src=(["'])((?:https?:)?//(?:cache\.)?vevo\.com/.+?)\1""", 2, "", False),
    ("Viddler", "viddler.com/", r"""<(?:iframe[^>]+?src|param[^>]+?value)=(["'])((?:https?:)?//(?:www\.)?viddler\.com/(?:embed|player)/.+?)\1""", 2, "", False),
    ("NYTimes", "graphics8.nytimes.com/bcvideo/", r"""<iframe[^>]+src=(["'])((?:https?:)?//graphics8\.nytimes\.com/bcvideo/[^/]+/iframe/embed\.html.+?)\1>""", 2, "", False),
    ("Libsyn", "html5-player.libsyn.com/embed/", r"""<iframe[^>]+src=(["'])((?:https?:)?//html5-player\.libsyn\.com/embed/.+?)\1""", 2, "", False),
    ("Aparat", "www.aparat.com/video/", r"""<iframe .*?src="(http://www\.aparat\.com/video/[^"]+)\"""", 1, "", False),
    ("Mpora", "://mpora.", r"""<iframe .*?src="(http://mpora\.(?:com|de)/videos/[^"]+)\"""", 1, "", False),
    ("Facebook", "www.facebook.com/", r"""<iframe[^>]+?src=(["'])(https?://www\.facebook\.com/(?:video/embed|plugins/video\.php).+?)\1""", 2, "", True),
    ("VK", "vk.com/video_ext.php", r"""<iframe[^>]+?src=(["'])(https?://vk\.com/video_ext\.php.+?)\1""", 2, "", False),
    ("Ivi", "ivi.ru/video/player", r"""<embed[^>]+?src=(["'])(https?://(?:www\.)?ivi\.ru/video/player.+?)\1""", 2, "", False),
    ("HuffPost", "embed.live.huffingtonpost.com/", r"""<iframe[^>]+?src=(["'])(https?://embed\.live\.huffingtonpost\.com/.+?)\1""", 2, "", False),
    ("Embedly", "embedly-card", r"""class=["']embedly-card["'][^>]href=["']([^"']+)""", 1, "", False),
    ("FunnyOrDie", "funnyordie.com/embed/", r"""<iframe[^>]+?src="(https?://(?:www\.)?funnyordie\.com/embed/[^"]+)\"""", 1, "", True),
    ("BBCCoUk", "www.bbc.co.uk/iplayer/", r"""setPlaylist\("(https?://www\.bbc\.co\.uk/iplayer/[^/]+/[\da-z]{8})"\)""", 1, "", True),
    ("Tvigle", "cloud.tvigle.ru/video/", r"""<iframe[^>]+?src=(["'])((?:https?:)?//cloud\.tvigle\.ru/video/.+?)\1""", 2, "", False),
    ("TED", ".ted.com/", r"""<iframe[^>]+?src=(["'])(https?://embed(?:-ssl)?\.ted\.com/.+?)\1""", 2, "", False),
    ("FranceTV", "embed.francetv.fr/", r"""<iframe[^>]+?src=(["'])((?:https?://)?embed\.francetv\.fr/\?ue=.+?)\1""", 2, "", False),
    ("Soundcloud", "soundcloud.com/player", r"""<iframe[^>]+src=(["'])((?:https?://)?(?:w\.)?soundcloud\.com/player.+?)\1""", 2, "", True),
    ("Yahoo", ".yahoo.com/", r"""<iframe[^>]+?src=(["'])(https?://(?:screen|movies)\.yahoo\.com/.+?\.html\?format=embed)\1""", 2, "", False),
    ("SBS", "sbs.com.au/ondemand/video/", r"""(?:<meta\s+property="og:video"\s+content=|<iframe[^>]+?src=)(["'])(https?://(?:www\.)?sbs\.com\.au/ondemand/video/.+?)\1""", 2, "", False),
    ("Cinchcast", "player.cinchcast.com/", r"""<iframe[^>]+?src=(["'])(https?://player\.cinchcast\.com/.+?)\1""", 2, "", False),
    ("MLB", ".mlb.com/shared/video/embed/", r"""<iframe[^>]+?src=(["'])(https?://m(?:lb)?\.mlb\.com/shared/video/embed/embed\.html\?.+?)\1""", 2, "", False),
    ("MLB", "m.mlb.com/video/", r"""data-video-link=["'](http://m\.mlb\.com/video/[^"']+)""", 1, "", False),
    ("Livestream", "livestream.com/", r"""<iframe[^>]+src="(https?://(?:new\.)?livestream\.com/[^"]+/player[^"]+)\"""", 1, "", False),
    ("Zapiks", "zapiks.fr/index.php", r"""<iframe[^>]+src="(https?://(?:www\.)?zapiks\.fr/index\.php\?.+?)\"""", 1, "", False),
    ("EaglePlatform", "media.clipyou.ru/index/player", r"""<iframe[^>]+src="https?://media\.clipyou\.ru/index/player\?.*\brecord_id=(\d+).*\"""", 1, "eagleplatform:media.clipyou.ru:", False),
    ("Playwire", "config.playwire.com/", r"""<script[^>]+data-config=(["'])((?:https?:)?//config\.playwire\.com/.+?)\1""", 2, "", False),
    ("FiveMin", "embed.5min.com/", r"""<meta[^>]+property="og:video"[^>]+content="https?://embed\.5min\.com/([0-9]+)/?""", 1, "5min:", False),
    ("CrooksAndLiars", "embed.crooksandliars.com/", r"""<(?:iframe[^>]+src|param[^>]+value)=(["'])((?:https?:)?//embed\.crooksandliars\.com/(?:embed|v)/.+?)\1""", 2, "", False),
    ("NBCNews", "www.nbcnews.com/widget/video-embed/", r"""<iframe[^>]+src=(["'])((?:https?:)?//www\.nbcnews\.com/widget/video-embed/[^"']+)\1""", 2, "", False),
    ("AdobeTVVideo", "video.tv.adobe.com/v/", r"""<iframe[^>]+src=['"]((?:https?:)?//video\.tv\.adobe\.com/v/\d+[^"]+)['"]""", 1, "", False),
    ("Vine", "vine.co/v/", r"""<iframe[^>]+src=["']((?:https?:)?//(?:www\.)?vine\.co/v/[^/]+/embed/(?:simple|postcard))""", 1, "", False),
    ("VODPlatform", "mbed/", r"""<iframe[^>]+src=(["'])((?:https?:)?//(?:(?:www\.)?vod-platform\.net|embed\.kwikmotion\.com)/[eE]mbed/.+?)\1""", 2, "", False),
    ("Mangomolo", "mangomolo.com/", r"""<iframe[^>]+src=(["'])((?:https?:)?//(?:admin\.mangomolo\.com/analytics/index\.php/customers/embed|player\.mangomolo\.com/v1)/(?:video\?.*?\bid=\d+|(?:index|live)\?.*?\bchannelid=(?:[A-Za-z0-9+/=]|%2B|%2F|%3D)+).+?)\1""", 2, "", False),
    ("Twitch", "player.twitch.tv/", r"""<iframe[^>]+?src=(["'])((?:https?:)?//player\.twitch\.tv/\?.+?)\1""", 2, "", True)]


def find_embeds(pages: DataFrame, rules=EMBED_RULES) -> DataFrame:
    """Entries of the first rule that finds embeds on a page, in page order, each URL once.

    A rule's pattern is only tried on pages that hold its plain text, so a page without players costs one search for each text.
    """
    tries = []
    for key, needs, pattern, group, prefix, every in rules:
        found = F.regexp_extract_all("html", F.lit(pattern), F.lit(group))
        urls = F.array_distinct(found if every else F.slice(found, 1, 1))
        tries.append(F.when(F.contains("html", F.lit(needs)), let(urls, _entries(key, prefix))))
    out = pages.select("page_id", F.posexplode(F.coalesce(*tries)).alias("pos", "e"))
    return out.select("page_id", "pos", "e.extractor_key", "e.url")


def _entries(key, prefix):
    tidy = lambda x: F.concat(F.lit(prefix), F.when(x.startswith("//"), F.concat(F.lit("http:"), tx.unescape(x))).otherwise(tx.unescape(x)))
    return lambda us: F.when(F.size(us) > 0, F.array_distinct(F.transform(
        us, lambda x: F.struct(F.lit(key).alias("extractor_key"), tidy(x).alias("url")))))


# Patterns of plain media links, in order of trial; the flag tells whether links are checked.
LINK_RULES = [
    (r"""flashvars: ['"](?:.*&)?file=(http[^'"&]*)""", True),
    (r"""(?s)(?:jw_plugins|JWPlayerOptions|jwplayer\s*\(\s*["'][^'"]+["']\s*\)\s*\.setup).*?['"]?file['"]?\s*:\s*["'](.*?)["']""", True),
    (r"""[^A-Za-z0-9]?(?:file|source)=(http[^'"&]*)""", True),
    (r"""[^A-Za-z0-9]?(?:file|video_url)["']?:\s*["'](http(?![^'"]+\.[0-9]+['"])[^'"]+)["']""", True),
    (r"""(?s)flowplayer\("[^"]+",\s*\{[^}]+?\}\s*,\s*\{[^}]+?["']?clip["']?\s*:\s*\{\s*["']?url["']?\s*:\s*["']([^"']+)["']""", True),
    (r"""cinerama\.embedPlayer\(\s*'[^']+',\s*'([^']+)'""", False),
    (r"""<meta (?:property|name)="twitter:player:stream" (?:content|value)="(.+?)\"""", True),
    (r"""<meta.*?property="og:(?:video|audio)".*?content="(.*?)\"""", True)]
# Extensions of things that are no media.
NOT_MEDIA = ["swf", "png", "jpg", "srt", "sbv", "sub", "vtt", "ttml", "js", "xml"]
# Fixed value: addresses of player pages.
_PLAYER_PAGE = r"^(?:https?:)?//(?:www\.)?(?:youtube(?:-nocookie)?\.com/(?:embed/|v/|watch\?)|youtu\.be/)"


def acceptable(link: Column) -> Column:
    """Whether a link may be media: a player page, a stream, or a path with a media-like extension."""
    path = ux.path_of(link)
    return link.rlike(_PLAYER_PAGE) | link.rlike("(?i)^rtmp") | (path.contains(".") & ~ux.ext_of(path).isin(NOT_MEDIA))


def scrape_media_links(pages: DataFrame) -> DataFrame:
    """Links of the first pattern that gives at least one acceptable link, in page order, each once (C17)."""
    tries = []
    for n, (pattern, checked) in enumerate(LINK_RULES):
        found = F.regexp_extract_all("html", F.lit(pattern), F.lit(1))
        good = F.filter(found, acceptable) if checked else found
        tries.append(let(good, _ruled(n)))
    # A player that the page names for cards comes last.
    card = hx.meta(F.col("html"), "twitter:player")
    tries.append(F.when(card != F.col("url"), F.struct(F.lit(len(LINK_RULES)).alias("rule"), F.array(card).alias("links"))))
    d = pages.withColumn("__r", F.coalesce(*tries))
    d = d.select("page_id", "url", F.col("__r.rule").alias("rule"), F.posexplode(F.array_distinct("__r.links")).alias("pos", "link"))
    link = F.replace(tx.unescape(F.col("link")), F.lit("\\/"), F.lit("/"))
    d = d.withColumn("link", F.coalesce(ux.resolve(F.col("url"), link), link))
    name = F.substring_index(F.col("link"), "/", -1)
    stem = F.regexp_replace(F.coalesce(F.try_url_decode(name), name), r"^(.*[^.].*)\.[^.]*$", "$1")
    ext = ux.ext_of(F.col("link"))
    route = (F.when(F.col("link").rlike(_PLAYER_PAGE) | (F.col("rule") == len(LINK_RULES)), F.lit("embed")).when(F.col("link").rlike("(?i)^rtmp"), F.lit("rtmp"))
             .when(ext.isin("smil", "xspf", "m3u8", "mpd", "f4m"), ext)
             .when(F.col("link").rlike(r"(?i)\.(?:ism|smil)/manifest"), F.lit("generic")).otherwise(F.lit("file")))
    return d.select("page_id", "rule", "pos", F.col("link").alias("url"), stem.alias("id"), route.alias("route"))


def _ruled(n):
    return lambda good: F.when(F.size(good) > 0, F.struct(F.lit(n).alias("rule"), good.alias("links")))
