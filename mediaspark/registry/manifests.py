"""Queries of family D. Manifests are written from ``formats`` rows, parsed back, and compared with the rows.

An item's rows are spread over manifests of at most 200 rows, so no manifest grows with an item.
"""

from pyspark.sql import functions as F

from .. import skew
from ..fixtures import define, oracle
from ..operators import dash, hls, manifests as mf
from . import query

define("mlines", """
SELECT *, concat(media_id, '-', rn // 200) AS manifest_id, CAST(rn % 200 AS INTEGER) AS i FROM (SELECT *, row_number() OVER (PARTITION BY media_id ORDER BY pos) - 1 AS rn FROM {formats})""")
define("bw", "SELECT *, CAST(floor(coalesce(tbr, 0)) AS BIGINT) * 1000 + 500 AS bw, coalesce(height, 100) AS h FROM {mlines}")


PART = ["media_id", "part"]


def rows(t):
    f = skew.numbered(t["formats"], "media_id", [F.col("pos")], "rn", sizes=t["formats"]).withColumn("rn", F.col("rn") - 1)
    f = f.withColumn("part", F.floor(F.col("rn") / 200)).withColumn("manifest_id", F.concat_ws("-", F.col("media_id").cast("string"), F.col("part").cast("string")))
    return f.withColumn("i", (F.col("rn") % 200).cast("int")).withColumn("bw", F.floor(F.coalesce("tbr", F.lit(0.0))).cast("bigint") * 1000 + 500) \
        .withColumn("h", F.coalesce("height", F.lit(100)))


def gathered(d):
    """The rows of each manifest as a sorted array ``x``. The item is part of the key, by which the rows are already spread: no further shuffle."""
    g = d.groupBy(*PART).agg(F.sort_array(F.collect_list(F.struct("sec", "i", "line"))).alias("x"))
    return g.withColumn("manifest_id", F.concat_ws("-", F.col("media_id").cast("string"), F.col("part").cast("string")))


def text(t, name, line, head="", tail="", section=None, sep="\n", keep=None):
    """manifests(manifest_id, url, body): the lines of each manifest in order, between head and tail."""
    d = rows(t)
    d = d.filter(keep) if keep is not None else d
    g = gathered(d.select(*PART, (section if section is not None else F.lit(0)).alias("sec"), "i", line.alias("line")))
    body = F.concat(F.lit(head), F.array_join("x.line", sep), F.lit(tail))
    return g.select("manifest_id", F.concat(F.lit("https://m.example.com/v/"), "manifest_id", F.lit(f"/{name}")).alias("url"), body.alias("body"))


def S(sql):
    return F.expr(sql)


# --- HLS ----------------------------------------------------------------------------------------

def hls_master(t):
    media = S("""concat('#EXT-X-MEDIA:TYPE=AUDIO,GROUP-ID="aud', i % 3, '",NAME="n', i, ', x",LANGUAGE="en"', if(i % 7 = 3, '', concat(',URI="audio/', i, '.m3u8"')))""")
    stream = S("""concat(if(i % 11 = 5, '#EXT-X-NOTE', concat('#EXT-X-STREAM-INF:BANDWIDTH=', bw, if(i % 2 = 0, concat(',AVERAGE-BANDWIDTH=', bw + 1000), ''), ',RESOLUTION=', h * 2, 'x', h,
      CASE i % 3 WHEN 0 THEN ',CODECS="avc1.4d401f,mp4a.40.2"' WHEN 1 THEN ',CODECS="mp4a.40.2"' ELSE '' END, ',AUDIO="aud', i % 3, '"', if(i % 4 = 0, concat(',NAME="nm', i, '"'), ''),
      if(i % 5 = 0, concat(',PROGRESSIVE-URI="http://p.example.com/', i, '.mp4"'), ''), ',FRAME-RATE=25')), '\\n# comment\\n', if(i % 6 = 1, concat('https://x.example.com/', i, '-audio=64000-video=900000.m3u8'), concat('../s/', i, '.m3u8')))""")
    return text(t, "master.m3u8", F.when(F.col("vcodec").eqNullSafe("none"), media).otherwise(stream), head="#EXTM3U\n")


@query("D01_hls_variants", oracle("""
WITH b AS (SELECT *, coalesce(vcodec, '') = 'none' AS is_media, i % 11 <> 5 AS inf, i % 5 = 0 AS prog FROM {bw}),
g AS (SELECT manifest_id, i % 3 AS grp, arg_min(i, i) AS first_i FROM b WHERE is_media GROUP BY ALL),
c AS (SELECT b.*, g.first_i % 7 <> 3 AS grp_uri, count(*) FILTER (is_media AND b.i % 7 <> 3) OVER (PARTITION BY b.manifest_id) AS n_media,
  coalesce(sum(CASE WHEN is_media THEN 0 WHEN inf AND prog THEN 2 ELSE 1 END) OVER (PARTITION BY b.manifest_id ORDER BY b.i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before,
  coalesce(sum(CASE WHEN is_media AND b.i % 7 <> 3 THEN 1 ELSE 0 END) OVER (PARTITION BY b.manifest_id ORDER BY b.i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS mbefore
  FROM b LEFT JOIN g ON b.manifest_id = g.manifest_id AND b.i % 3 = g.grp),
d AS (SELECT *, CASE WHEN inf THEN (bw + CASE WHEN i % 2 = 0 THEN 1000 ELSE 0 END) / 1000 END AS t, concat('https://m.example.com/v/', manifest_id) AS base FROM c),
e AS (SELECT manifest_id, n_media + before AS pos, 'stream' AS kind, concat('hls-', CASE WHEN inf AND i % 4 = 0 THEN 'nm' || i ELSE CAST(CASE WHEN coalesce(t, 0) = 0 THEN n_media + before ELSE CAST(floor(t) AS BIGINT) END AS VARCHAR) END) AS format_id,
  CASE WHEN i % 6 = 1 THEN concat('https://x.example.com/', i, '-audio=64000-video=900000.m3u8') ELSE concat('https://m.example.com/v/s/', i, '.m3u8') END AS url, CAST(t AS DOUBLE) AS tbr,
  CASE WHEN inf THEN CAST(h * 2 AS INTEGER) END AS width, CASE WHEN inf THEN CAST(h AS INTEGER) END AS height, CASE WHEN i % 6 = 1 THEN CAST(64 AS DOUBLE) END AS abr,
  CASE WHEN inf THEN CASE i % 3 WHEN 0 THEN 'avc1.4d401f' WHEN 1 THEN 'none' END END AS vcodec,
  CASE WHEN inf THEN CASE i % 3 WHEN 0 THEN CASE WHEN grp_uri THEN 'none' ELSE 'mp4a.40.2' END WHEN 1 THEN 'mp4a.40.2' END END AS acodec, CAST(NULL AS VARCHAR) AS language, inf AND prog AS twin, i FROM d WHERE NOT is_media)
SELECT manifest_id, CAST(mbefore AS INTEGER) AS pos, 'media' AS kind, concat('hls-aud', i % 3, '-n', i, ', x') AS format_id, concat(base, '/audio/', i, '.m3u8') AS url, NULL AS tbr, NULL AS width, NULL AS height, NULL AS abr, 'none' AS vcodec, NULL AS acodec, 'en' AS language FROM d WHERE is_media AND i % 7 <> 3
UNION ALL SELECT manifest_id, CAST(pos AS INTEGER), kind, format_id, url, tbr, width, height, abr, vcodec, acodec, language FROM e
UNION ALL SELECT manifest_id, CAST(pos + 1 AS INTEGER), 'progressive', replace(format_id, 'hls-', 'http-'), concat('http://p.example.com/', i, '.mp4'), tbr, width, height, abr, vcodec, acodec, language FROM e WHERE twin"""))
def _(t):
    return hls.hls_variants(hls_master(t), "hls").select("manifest_id", "pos", "kind", "format_id", "url", "tbr", "width", "height", "abr",
                                                         "vcodec", "acodec", "language")


@query("D02_audio_groups", oracle("""
WITH b AS (SELECT *, coalesce(vcodec, '') = 'none' AS is_media FROM {bw} ), g AS (SELECT manifest_id, i % 3 AS grp, min(i) AS first_i FROM b WHERE is_media GROUP BY ALL)
SELECT b.manifest_id, sum(CASE WHEN b.i % 3 = 0 AND b.i % 11 <> 5 AND coalesce(g.first_i % 7 <> 3, FALSE) THEN CASE WHEN b.i % 5 = 0 THEN 2 ELSE 1 END ELSE 0 END)::BIGINT AS split_off, count(*) AS streams
FROM b LEFT JOIN g ON b.manifest_id = g.manifest_id AND b.i % 3 = g.grp WHERE NOT is_media GROUP BY ALL"""))
def _(t):
    v = hls.hls_variants(hls_master(t), "hls").filter("kind <> 'media'")
    return v.groupBy("manifest_id").agg(F.count_if(F.col("acodec").eqNullSafe("none")).alias("split_off"), F.count_if(F.col("kind") == "stream").alias("streams"))


@query("D03_hls_extras", oracle("""
SELECT DISTINCT manifest_id, 'playlist' AS kind, concat('https://m.example.com/v/', manifest_id, '/master.m3u8') AS url FROM {mlines} WHERE media_id % 3 = 0 UNION ALL
SELECT manifest_id, 'stream', CASE WHEN i % 6 = 1 THEN concat('https://x.example.com/', i, '-audio=64000-video=900000.m3u8') ELSE concat('https://m.example.com/v/s/', i, '.m3u8') END
FROM {mlines} WHERE media_id % 3 = 1 AND coalesce(vcodec, '') <> 'none'"""))
def _(t):
    m = hls_master(t)
    k = F.substring_index("manifest_id", "-", 1).cast("bigint") % 3
    lock = F.when(k == 2, F.lit("#EXT-X-FAXS-CM:x\n")).when(k == 0, F.lit("#EXT-X-TARGETDURATION:9\n")).otherwise(F.lit(""))
    v = hls.hls_variants(m.withColumn("body", F.concat(lock, F.col("body"))))
    return v.filter("kind IN ('playlist', 'stream')").select("manifest_id", "kind", "url")


@query("D04_hls_attributes", oracle("""
SELECT media_id, pos, concat(coalesce(format_id, '?'), ', quoted') AS name, concat('x', protocol) AS other, coalesce(CAST(height AS VARCHAR), '1') AS height FROM {formats}"""))
def _(t):
    f = t["formats"].withColumn("line", S(
        """concat('#EXT-X-MEDIA:NAME="', coalesce(format_id, '?'), ', quoted",HEIGHT=1,X-OTHER=x', protocol, if(height IS NULL, '', concat(',HEIGHT=', height)))"""))
    a = hls.hls_attributes(f, "line")
    at = lambda k: F.try_element_at("attributes", F.lit(k))
    return a.select("media_id", "pos", at("NAME").alias("name"), at("X-OTHER").alias("other"), at("HEIGHT").alias("height"))


def hls_media(t):
    line = S("""concat(if(i % 4 = 1, concat('#EXT-X-KEY:METHOD=AES-128,URI="k', i, '.bin",IV=0x', i, '\\n'), if(i % 4 = 3, '#EXT-X-KEY:METHOD=NONE\\n', '')), if(i % 5 = 2, '#ANVATO-SEGMENT-INFO: type=ad\\n', if(i % 5 = 4, '#UPLYNK-SEGMENT:x,segment\\n', '')),
      if(i = 0, '#EXT-X-BYTERANGE:100@50\\n', concat('#EXT-X-BYTERANGE:', 10 + i, if(i % 3 = 0, concat('@', i * 1000), ''), '\\n')), '#EXTINF:4,\\n', if(i % 2 = 0, concat('seg', i, '.ts'), concat('http://c.example.com/', i, '.ts')), '  ')""")
    return text(t, "media.m3u8", line, head="#EXTM3U\n#EXT-X-TARGETDURATION:4\n#EXT-X-MEDIA-SEQUENCE:7\n")


SEG = """
WITH a AS (SELECT manifest_id, i, CASE WHEN i % 5 IN (2, 3) THEN TRUE ELSE FALSE END AS ad, i - i % 3 AS run, 10 + i AS len, CASE WHEN i = 0 THEN 50 WHEN i % 3 = 0 THEN i * 1000 END AS off FROM {mlines}),
b AS (SELECT *, CASE WHEN i = 0 THEN 100 ELSE len END AS ln FROM a),
c AS (SELECT *, first_value(off) OVER (PARTITION BY manifest_id, run ORDER BY i) + sum(ln) OVER (PARTITION BY manifest_id, run ORDER BY i) AS stop,
  CASE WHEN i % 4 IN (1, 2) THEN i - (i - 1) % 4 END AS k FROM b),
d AS (SELECT *, row_number() OVER (PARTITION BY manifest_id ORDER BY i) AS n FROM c WHERE NOT ad)
"""


@query("D05_hls_segments", oracle(SEG + """
SELECT manifest_id, n AS frag_index, n + 6 AS media_sequence, CASE WHEN i % 2 = 0 THEN concat('https://m.example.com/v/', manifest_id, '/seg', i, '.ts') ELSE concat('http://c.example.com/', i, '.ts') END AS url,
  CASE WHEN k IS NULL THEN 'NONE' ELSE 'AES-128' END AS key_method, 'https://m.example.com/v/' || manifest_id || '/k' || k || '.bin' AS key_url, '0x' || k AS key_iv,
  CAST(stop - ln AS BIGINT) AS range_start, CAST(stop AS BIGINT) AS range_end FROM d"""))
def _(t):
    return hls.hls_segments(hls_media(t))


@query("D05_hls_counts", oracle("""
SELECT manifest_id, count(*) FILTER (i % 5 NOT IN (2, 3)) AS media_frags, count(*) FILTER (i % 5 IN (2, 3)) AS ad_frags FROM {mlines} GROUP BY ALL"""))
def _(t):
    return hls.hls_counts(hls_media(t))


@query("D06_hls_supported", oracle("""
SELECT manifest_id, CASE media_id % 5 WHEN 0 THEN 'key method' WHEN 1 THEN 'media map' WHEN 2 THEN CASE WHEN count(*) >= 2 THEN 'encrypted byte ranges' END ELSE CASE WHEN count(*) >= 2 THEN 'encrypted byte ranges' WHEN media_id % 5 = 4 THEN 'live' END END AS unsupported FROM {mlines} GROUP BY manifest_id, media_id"""))
def _(t):
    k = F.substring_index("manifest_id", "-", 1).cast("bigint") % 5
    extra = F.when(k == 0, F.lit("#EXT-X-KEY:METHOD=SAMPLE-AES,URI=\"x\"\n")).when(k == 1, F.lit("#EXT-X-MAP:URI=\"i\"\n")).otherwise(F.lit(""))
    m = hls_media(t).withColumn("is_live", k == 4).withColumn("body", F.concat(extra, F.col("body")))
    return hls.hls_supported(m).select("manifest_id", "unsupported")


# --- DASH ---------------------------------------------------------------------------------------

DASH_HEAD = """<?xml version="1.0"?><MPD xmlns="urn:mpeg:dash:schema:mpd:2011" xmlns:yt="http://youtube.com/yt/2012/10/10" type="static" mediaPresentationDuration="PT1M"><Period><BaseURL>media/</BaseURL>"""
DASH_KIND = "CASE WHEN i % 9 = 8 THEN 3 WHEN i % 4 < 2 THEN 0 WHEN i % 4 = 2 THEN 1 ELSE 2 END"


def dash_manifest(t):
    rep = S(f"""concat('<Representation id="r', i, '" bandwidth="', bw, '"', if(({DASH_KIND}) IN (0, 3), concat(' width="', h * 2, '" height="', h, '" frameRate="25" codecs="avc1.42"'), if(({DASH_KIND}) = 1, ' audioSamplingRate="44100" codecs="mp4a.40.2"', '')), '>',
      CASE {DASH_KIND} WHEN 0 THEN CASE WHEN i % 8 = 1 THEN concat('<SegmentList timescale="10" duration="20"><Initialization range="0-9"/><SegmentURL media="a', i, '.m4s" mediaRange="10-19"/><SegmentURL media="http://c.example.com/b.m4s" mediaRange="20-29"/></SegmentList>')
        WHEN i % 8 = 4 THEN '<SegmentTemplate duration="25"/>' ELSE concat('<SegmentTemplate><SegmentTimeline><S t="0" d="', i + 2, '" r="2"/><S d="5"/><S t="100" d="3"/></SegmentTimeline></SegmentTemplate>') END
        WHEN 1 THEN concat('<BaseURL yt:contentLength="', i * 10, '">a', i % 2, '.mp4</BaseURL>') WHEN 2 THEN concat('<BaseURL>t', i, '.vtt</BaseURL>') ELSE '' END, '</Representation>')""")
    g = gathered(rows(t).select(*PART, S(DASH_KIND).alias("sec"), "i", rep.alias("line")))
    part = lambda n: F.array_join(F.transform(F.filter("x", lambda r: r["sec"] == n), lambda r: r["line"]), "")
    body = F.concat(
        F.lit(DASH_HEAD + '<AdaptationSet mimeType="video/mp4"><SegmentTemplate timescale="10" startNumber="3" media="$RepresentationID$/$Number%05d$-$Time$-$Bandwidth$.m4s" initialization="$RepresentationID$/init-$Bandwidth$.mp4"/>'), part(0),
        F.lit('</AdaptationSet><AdaptationSet mimeType="audio/mp4" lang="und">'), part(1),
        F.lit('</AdaptationSet><AdaptationSet mimeType="text/vtt" lang="de">'), part(2),
        F.lit('</AdaptationSet><AdaptationSet mimeType="video/mp4"><ContentProtection schemeIdUri="urn:x"/>'), part(3), F.lit("</AdaptationSet></Period></MPD>"))
    return g.select("manifest_id", F.concat(F.lit("https://m.example.com/v/"), "manifest_id", F.lit("/dash.mpd")).alias("url"), body.alias("body"))


define("reps", f"""SELECT *, {DASH_KIND} AS k, concat('https://m.example.com/v/', manifest_id, '/dash.mpd') AS mpd, concat('https://m.example.com/v/', manifest_id, '/media/') AS base FROM {{bw}}""")


@query("D07_dash_formats", oracle("""
SELECT manifest_id, concat('dash-r', i) AS format_id, CASE k WHEN 0 THEN mpd ELSE concat(base, 'a', i % 2, '.mp4') END AS url, CASE k WHEN 0 THEN 'mp4' ELSE 'm4a' END AS ext, CASE WHEN k = 0 THEN CAST(h * 2 AS INTEGER) END AS width,
  CASE WHEN k = 0 THEN CAST(h AS INTEGER) END AS height, bw / 1000 AS tbr, CASE WHEN k = 1 THEN 44100 END AS asr, CASE WHEN k = 0 THEN 25 END AS fps, CAST(NULL AS VARCHAR) AS language, CASE WHEN k = 1 THEN CAST(i * 10 AS BIGINT) END AS filesize,
  CASE k WHEN 0 THEN 'avc1.42' ELSE 'none' END AS vcodec, CASE k WHEN 0 THEN 'none' ELSE 'mp4a.40.2' END AS acodec, CASE WHEN k = 0 THEN 'http_dash_segments' END AS protocol,
  CAST(row_number() OVER (PARTITION BY manifest_id, k, CASE WHEN k = 1 THEN i % 2 END ORDER BY i) - 1 AS INTEGER) AS manifest_stream_number FROM {reps} WHERE k < 2"""))
def _(t):
    return dash.dash_formats(dash_manifest(t), "dash").select("manifest_id", "format_id", "url", "ext", "width", "height", "tbr", "asr", "fps", "language",
                                                              "filesize", "vcodec", "acodec", "protocol", "manifest_stream_number")


@query("D07_dash_subtitles", oracle("SELECT manifest_id, 'de' AS lang, 'vtt' AS ext, concat(base, 't', i, '.vtt') AS url FROM {reps} WHERE k = 2"))
def _(t):
    return dash.dash_subtitles(dash_manifest(t)).select("manifest_id", "lang", "ext", "url")


@query("D08_dash_segments", oracle("""
WITH v AS (SELECT *, concat('r', i) AS rid FROM {reps} WHERE k = 0)
SELECT manifest_id, rid AS format_id, CAST(0 AS BIGINT) AS seq, concat(rid, '/init-', bw, '.mp4') AS location, CAST(NULL AS DOUBLE) AS duration, CASE WHEN i % 8 = 1 THEN '0-9' END AS range FROM v UNION ALL
SELECT manifest_id, rid, s, CASE s WHEN 1 THEN concat('a', i, '.m4s') ELSE 'http://c.example.com/b.m4s' END, 2.0, CASE s WHEN 1 THEN '10-19' ELSE '20-29' END FROM v, (VALUES (1), (2)) x(s) WHERE i % 8 = 1 UNION ALL
SELECT manifest_id, rid, s + 1, concat(rid, '/', lpad(CAST(s + 3 AS VARCHAR), 5, '0'), '-', '$Time$', '-', bw, '.m4s'), 2.5, NULL FROM v, range(24) x(s) WHERE i % 8 = 4 UNION ALL
SELECT manifest_id, rid, s + 1, concat(rid, '/', lpad(CAST(s + 3 AS VARCHAR), 5, '0'), '-', CASE WHEN s < 4 THEN s * (i + 2) ELSE 100 END, '-', bw, '.m4s'), CASE WHEN s < 3 THEN i + 2 WHEN s = 3 THEN 5 ELSE 3 END / 10, NULL FROM v, range(5) x(s) WHERE i % 8 NOT IN (1, 4)"""))
def _(t):
    return dash.dash_segments(dash_manifest(t)).select("manifest_id", "format_id", "seq", "location", "duration", "range")


@query("D09_expand_template", oracle("""
SELECT manifest_id, i, concat('x', i, '/n', printf('%04d', rn + 1), '_', bw, '_t', rn * 7, '%20.m4s') AS name FROM {bw}"""))
def _(t):
    d = rows(t).select("manifest_id", "i", F.concat(F.lit("x"), F.col("i").cast("string")).alias("rep_id"), F.col("bw").alias("bandwidth"),
                       (F.col("rn") + 1).alias("number"), (F.col("rn") * 7).alias("time"), F.lit("$RepresentationID$/n$Number%04d$_$Bandwidth$_t$Time$%20.m4s").alias("tpl"))
    return dash.expand_template(d, "tpl", "name", "number", "time").select("manifest_id", "i", "name")


# --- Smooth Streaming, F4M, SMIL, XSPF ----------------------------------------------------------

def ism_manifest(t):
    q = S("""concat('<QualityLevel Bitrate="', bw, '" FourCC="', CASE i % 4 WHEN 0 THEN 'WVC1' ELSE 'H264' END, '" MaxWidth="', h * 2, '" MaxHeight="', h, '"/>')""")
    tail = ('<c t="0" d="40" r="2"/><c d="60"/><c t="500"/></StreamIndex><StreamIndex Type="audio" Name="aud" TimeScale="100" Url="A({bitrate})/{start_time}"><QualityLevel Bitrate="64999" AudioTag="255" SamplingRate="44100"/>'
            '<c d="30" r="3"/></StreamIndex><StreamIndex Type="text" Url="x"><QualityLevel Bitrate="1"/></StreamIndex></SmoothStreamingMedia>')
    return text(t, "v.ism/Manifest", q, head='<SmoothStreamingMedia Duration="700" TimeScale="10"><StreamIndex Type="video" Url="Q({Bitrate})/F(v={start time})">', tail=tail, sep="")


@query("D10_ism_formats", oracle("""
SELECT manifest_id, concat('mss-', bw // 1000) AS format_id, 'ismv' AS ext, CAST(h * 2 AS INTEGER) AS width, CAST(h AS INTEGER) AS height, bw // 1000 AS tbr, CAST(NULL AS INTEGER) AS asr, 'H264' AS vcodec, 'none' AS acodec FROM {bw} WHERE i % 4 > 0 UNION ALL
SELECT DISTINCT manifest_id, 'mss-aud-64', 'isma', NULL::INTEGER, NULL::INTEGER, CAST(64 AS BIGINT), 44100, 'none', 'AACL' FROM {bw}"""))
def _(t):
    return mf.ism_formats(ism_manifest(t), "mss").select("manifest_id", "format_id", "ext", "width", "height", "tbr", "asr", "vcodec", "acodec")


@query("D11_ism_segments", oracle("""
SELECT manifest_id, i AS track_no, CAST(n AS BIGINT) AS seq, concat('https://m.example.com/v/', manifest_id, '/v.ism/Q(', bw, ')/F(v=', off, ')') AS url, d AS duration
FROM {bw}, (VALUES (1, 0, 4.0::DOUBLE), (2, 40, 4.0), (3, 80, 6.0), (4, 500, 20.0)) s(n, off, d) WHERE i % 4 > 0 UNION ALL
SELECT manifest_id, 0, n, concat('https://m.example.com/v/', manifest_id, '/v.ism/A(64999)/', off), 0.3 FROM (SELECT DISTINCT manifest_id FROM {bw}), (VALUES (1, 0), (2, 30), (3, 60)) s(n, off)"""))
def _(t):
    return mf.ism_segments(ism_manifest(t)).select("manifest_id", "track_no", "seq", "url", "duration")


def f4m_manifest(t):
    m = S("""concat('<media ', if(i % 5 = 4, 'drmAdditionalHeaderId="x" ', ''), if(i % 3 = 0, '', concat('bitrate="', bw, '" ')), 'height="', h, '" url="', CASE i % 4 WHEN 0 THEN concat('http://h.example.com/s', i) WHEN 1 THEN concat('sub', i, '/child.f4m?a&b') WHEN 2 THEN concat('rel', i) ELSE concat('x', i, '.m3u8') END, '"/>')""")
    return text(t, "set.f4m", m, head='<?xml version="1.0"?><manifest xmlns="http://ns.adobe.com/f4m/1.0"><mimeType>audio/mp4</mimeType>', tail="</manifest>", sep="")


F4M = """
WITH RECURSIVE o AS (SELECT *, row_number() OVER (PARTITION BY manifest_id ORDER BY i) - 1 AS n FROM {bw} WHERE i % 5 <> 4),
w AS (SELECT o.*, CASE i % 4 WHEN 0 THEN concat('http://h.example.com/s', i) WHEN 1 THEN concat('https://m.example.com/v/', manifest_id, '/sub', i, '/child.f4m?a&b') WHEN 2 THEN concat('https://m.example.com/v/', manifest_id, '/rel', i) ELSE concat('https://m.example.com/v/', manifest_id, '/x', i, '.m3u8') END AS u FROM o WHERE n = 0
UNION ALL SELECT o.*, CASE o.i % 4 WHEN 0 THEN concat('http://h.example.com/s', o.i) ELSE concat(regexp_replace(w.u, '/[^/]*$', ''), CASE o.i % 4 WHEN 1 THEN concat('/sub', o.i, '/child.f4m?a&b') WHEN 2 THEN concat('/rel', o.i) ELSE concat('/x', o.i, '.m3u8') END) END
FROM o JOIN w ON o.manifest_id = w.manifest_id AND o.n = w.n + 1)
"""


@query("D12_f4m_formats", oracle(F4M.strip() + """
SELECT manifest_id, CAST(n AS INTEGER) AS pos, CASE i % 4 WHEN 1 THEN 'f4m' WHEN 3 THEN 'm3u8' ELSE 'format' END AS route, concat('hds-', CASE WHEN i % 3 = 0 THEN n ELSE bw END) AS format_id, u AS url,
  CASE WHEN i % 3 > 0 THEN bw END AS tbr, CAST(h AS INTEGER) AS height, 'none' AS vcodec FROM w"""))
def _(t):
    return mf.f4m_formats(f4m_manifest(t), "hds").select("manifest_id", "pos", "route", "format_id", "url", "tbr", "height", "vcodec")


def smil_manifest(t):
    v = S("""concat('<', if(i % 2 = 0, 'video', 'audio'), ' src="', CASE i % 5 WHEN 0 THEN concat('v', i - i % 10, '.mp4') WHEN 1 THEN concat('h', i, '.m3u8') WHEN 2 THEN concat('http://o.example.com/', i, '.f4m') WHEN 3 THEN concat('mp4:', i) ELSE concat('http://d.example.com/', i, '.webm') END, '"',
      if(i % 5 = 3, ' proto="rtmp" streamer="rtmp://r.example.com/app"', ''), if(i % 3 = 0, concat(' systemBitrate="', bw, '"'), ''), ' height="', h, '"/><textstream src="s', i % 3, '.srt" systemLanguage="l', i % 3, '"/><image type="th" src="i', i, '.jpg" width="10" height="20"/>')""")
    return text(t, "clip.smil", v, head='<smil xmlns="http://www.w3.org/2001/SMIL20/Language"><head><meta name="title" content="T &amp; x"/><meta name="abstract" content="D"/><meta name="date" content="2001-02-03"/><meta base="http://b.example.com/m/"/></head><body><switch>', tail="</switch></body></smil>", sep="")


SMIL = """
WITH a AS (SELECT *, CASE i % 5 WHEN 0 THEN 'v' || (i - i % 10) || '.mp4' ELSE CAST(i AS VARCHAR) END AS src FROM {bw}),
b AS (SELECT *, row_number() OVER (PARTITION BY manifest_id, src ORDER BY i % 2, i) AS dup FROM a),
c AS (SELECT *, row_number() OVER (PARTITION BY manifest_id ORDER BY i % 2, i) - 1 AS spot, CASE WHEN i % 3 = 0 THEN bw / 1000 END AS t, CASE i % 5 WHEN 0 THEN 'http' WHEN 1 THEN 'm3u8' WHEN 2 THEN 'f4m' WHEN 3 THEN 'rtmp' ELSE 'http' END AS route FROM b WHERE dup = 1),
d AS (SELECT *, row_number() OVER (PARTITION BY manifest_id, route ORDER BY spot) AS n FROM c)
"""


@query("D13_smil_formats", oracle(SMIL + """
SELECT manifest_id, CAST(spot AS INTEGER) AS pos, route, CASE i % 5 WHEN 0 THEN 'http://b.example.com/m/' || src WHEN 1 THEN 'http://b.example.com/m/h' || i || '.m3u8' WHEN 2 THEN 'http://o.example.com/' || i || '.f4m' WHEN 3 THEN 'rtmp://r.example.com/app' ELSE 'http://d.example.com/' || i || '.webm' END AS url,
  CASE WHEN route = 'rtmp' THEN 'mp4:' || i END AS play_path, t AS tbr, CAST(h AS INTEGER) AS height, CASE WHEN route = 'rtmp' THEN 'flv' WHEN route = 'http' THEN CASE i % 5 WHEN 0 THEN 'mp4' ELSE 'webm' END END AS ext,
  CASE WHEN route IN ('rtmp', 'http') THEN route || '-' || CAST(floor(coalesce(t, n)) AS BIGINT) END AS format_id FROM d"""))
def _(t):
    return mf.smil_formats(smil_manifest(t)).select("manifest_id", "pos", "route", "url", "play_path", "tbr", "height", "ext", "format_id")


@query("D13_smil_subtitles", oracle("""
SELECT manifest_id, concat('l', i % 3) AS lang, concat('s', i % 3, '.srt') AS url, 'srt' AS ext FROM {mlines} GROUP BY ALL"""))
def _(t):
    return mf.smil_subtitles(smil_manifest(t)).select("manifest_id", "lang", "url", "ext")


@query("D13_smil_info", oracle("""
SELECT manifest_id, 'clip' AS id, 'T & x' AS title, 'D' AS description, '20010203' AS upload_date, count(*) AS images, concat('i', max(i), '.jpg') AS last_image FROM {mlines} GROUP BY ALL"""))
def _(t):
    m = smil_manifest(t)
    pics = mf.smil_thumbnails(m).groupBy("manifest_id").agg(F.count(F.lit(1)).alias("images"), F.max_by("url", "pos").alias("last_image"))
    return mf.smil_info(m).join(pics, "manifest_id")


def xspf_manifest(t):
    tr = S("""concat('<track>', if(i % 3 = 0, '', concat('<title>Track ', i, '</title>')), '<annotation>About & more</annotation><image>p.jpg</image><duration>', i * 500, '</duration><location s1:label="l', i, '" s1:width="', h * 2, '">a', i, '.mp3</location><location s1:width="1">http://z.example.com/', i, '</location><location></location></track>')""")
    return text(t, "list.xspf", tr, head='<playlist version="1" xmlns="http://xspf.org/ns/0/" xmlns:s1="http://static.streamone.nl/player/ns/0"><trackList>', tail="</trackList></playlist>", sep="")


@query("D14_xspf_entries", oracle("""
SELECT manifest_id, i AS pos, CASE WHEN i % 3 = 0 THEN manifest_id ELSE concat('Track ', i) END AS title, 'About & more' AS description, 'p.jpg' AS thumbnail, i / 2 AS duration FROM {mlines}"""))
def _(t):
    return mf.xspf_entries(xspf_manifest(t))


@query("D14_xspf_formats", oracle("""
SELECT manifest_id, i AS track, 0 AS pos, concat('https://m.example.com/v/', manifest_id, '/a', i, '.mp3') AS url, concat('l', i) AS format_id, CAST(h * 2 AS INTEGER) AS width, CAST(2 AS BIGINT) AS rank FROM {bw} UNION ALL
SELECT manifest_id, i, 1, concat('http://z.example.com/', i), NULL, 1, 1 FROM {bw}"""))
def _(t):
    from ..operators.formats import rank_formats
    f = mf.xspf_formats(xspf_manifest(t)).withColumn("media_id", F.concat_ws("#", "manifest_id", F.col("track").cast("string")))
    # The locations of one track come from one stored document.
    return rank_formats(f, hot_rows=0).select("manifest_id", "track", "pos", "url", "format_id", "width", "rank")


define("edge_formats", """
SELECT media_id, pos, CASE WHEN pos % 3 = 0 THEN 'format' ELSE 'f4m' END AS route, concat('p', pos % 100) AS format_id, CASE WHEN pos % 3 = 0 THEN url ELSE concat('m', pos % 7) END AS url,
  CASE WHEN pos % 2 = 0 THEN CAST(pos % 1000 AS BIGINT) END AS tbr, CAST(NULL AS INT) AS width, height FROM {formats}""")
define("edge_children", """
SELECT concat('m', n_nationkey % 6) AS manifest_url, CAST(n_nationkey AS BIGINT) AS pos, CASE WHEN n_nationkey % 6 = 1 THEN 'm3u8' ELSE 'format' END AS route, concat('c', n_nationkey) AS format_id,
  CASE WHEN n_nationkey % 6 = 1 THEN 'solo' ELSE concat('http://k.example.com/', n_nationkey) END AS url, CAST(NULL AS BIGINT) AS tbr, CAST(NULL AS INT) AS width, CAST(NULL AS INT) AS height FROM {nation}
UNION ALL SELECT concat('h', r_regionkey), CAST(r_regionkey AS BIGINT), CASE WHEN r_regionkey = 4 THEN 'format' ELSE 'm3u8' END, r_name, concat('h', r_regionkey + 1), CAST(NULL AS BIGINT), CAST(r_regionkey AS INT), CAST(NULL AS INT) FROM {region}
UNION ALL SELECT 'h1', CAST(99 AS BIGINT), 'f4m', concat('back', r_regionkey), concat('h', r_regionkey), CAST(NULL AS BIGINT), CAST(NULL AS INT), CAST(NULL AS INT) FROM {region} WHERE r_regionkey < 2
UNION ALL SELECT 'solo', CAST(r_regionkey AS BIGINT), 'm3u8', concat('s', r_regionkey), 'm0', CAST(NULL AS BIGINT), CAST(NULL AS INT), CAST(NULL AS INT) FROM {region}
UNION ALL SELECT 'm6', CAST(r_regionkey AS BIGINT), 'm3u8', concat('x', r_regionkey), concat('h', r_regionkey), CAST(NULL AS BIGINT), CAST(NULL AS INT), CAST(NULL AS INT) FROM {region}""")


@query("D15_resolve_manifest_edges", oracle("""
WITH RECURSIVE k AS (SELECT *, count(*) OVER (PARTITION BY manifest_url) AS n FROM {edge_children}),
w AS (SELECT media_id, CAST(pos AS VARCHAR) AS path, route, format_id, url, tbr, width, height, [url] AS seen FROM {edge_formats} UNION ALL
  SELECT w.media_id, w.path || '/' || k.pos, CASE WHEN k.route <> 'format' AND list_contains(w.seen, k.url) THEN 'cycle' ELSE k.route END, CASE WHEN k.n = 1 AND coalesce(w.tbr, 0) <> 0 THEN w.format_id ELSE k.format_id END, k.url,
    CASE WHEN k.n = 1 THEN coalesce(nullif(k.tbr, 0), w.tbr) ELSE k.tbr END, CASE WHEN k.n = 1 THEN coalesce(nullif(k.width, 0), w.width) ELSE k.width END,
    CASE WHEN k.n = 1 THEN coalesce(nullif(k.height, 0), w.height) ELSE k.height END, list_append(w.seen, k.url)
  FROM w JOIN k ON w.url = k.manifest_url WHERE w.route NOT IN ('format', 'cycle'))
SELECT media_id, path, route, format_id, url, tbr, width, height FROM w WHERE route IN ('format', 'cycle')"""))
def _(t):
    out = mf.resolve_manifest_edges(t["edge_formats"], t["edge_children"])
    return out.withColumn("path", F.array_join(F.transform("path", lambda x: x.cast("string")), "/"))


@query("D16_fix_ampersands", oracle("""
SELECT media_id, pos, concat('<a u="', url, '?x&amp;y=1&amp;z&#38;&lt;&amp;nbsp;"/>') AS body FROM {formats}"""))
def _(t):
    f = t["formats"].select("media_id", "pos", S("""concat('<a u="', url, '?x&y=1&amp;z&#38;&lt;&nbsp;"/>')""").alias("body"))
    return mf.fix_ampersands(f, "body")
