"""Value texts and rules whose odd corners must stay as they are."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from mediaspark.functions import html as hx, text as tx, urls as ux, values as vx
from mediaspark.operators import embeds as em, manifests as mf, pages as pg, playlists as pl, records as rc, routing, subtitles as sb


def run(spark, fn, values):
    d = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i int, t string")
    return [r["v"] for r in d.select("i", fn(F.col("t")).alias("v")).orderBy("i").collect()]


@pytest.mark.parametrize("fn,cases", [
    (vx.duration, {"1": 1, "3:33:45": 12825, "1:23": 83, "1:234": 1.234, "6 hours, 2 minutes": 21720, "PT1H0.040S": 3600.04, "3 days 1 hour": None,
                   "P0Y0M0DT0H4M20.880S": 260.88, "1.5 hours": 5400, "x": None, "": None, "01:02:03:04": 93784, "00:01:15.25Z": 75.25}),
    (vx.filesize, {"91 B": 91, "1.2Tb": 1200000000000, "1,24 KB": 1240, "1.9GiB": 2040109465, "foobar": None, "2 MiB": 2097152, "5 YB": None}),
    (vx.count, {"1000": 1000, "1.000": 1000, "1.1k": 1100, "1.1kk": 1100000, "1.1kk views": 1100000, "1,000": 1000, "": None, "test": None}),
    (vx.bitrate, {"300 kbps": 300, "x 96kbps": 96, "96 bps": None}),
    (vx.strdate, {"December 21, 2010": "20101221", "8/7/2009": "20090708", "Dec 14, 2012": "20121214", "2012/10/11 01:56:38 +0000": "20121011", "1968 12 10": "19681210",
                  "1968-12-10": "19681210", "31-07-2022 20:00": "20220731", "20141126": "20141126", "Feb 7, 2016 at 6:35 pm": "20160207", "junk": None}),
    (vx.timestamp, {"December 21, 2010": 1292889600, "8/7/2009": 1247011200, "2012/10/11 01:56:38 +0000": 1349920598, "May 16, 2016 11:15 PM": 1463440500,
                    "2014-03-23T23:04:26+0100": 1395612266, "2011/12/31 12:30 PM": 1325334600 + 43200}),
    (vx.iso8601, {"2014-03-23T23:04:26+0100": 1395612266, "2014-03-23T22:04:26Z": 1395612266, "2014-03-23T22:04:26.1234Z": 1395612266, "2014-03-23": None}),
    (vx.age_limit, {"18+": 18, "18": 18, "21": 21, "22": None, "PG-13": 13, "TV-14": 14, "TV_MA": 17, "99+": 99, "X": None}),
    (vx.mime_ext, {"audio/mp4": "m4a", "video/x-flv": "flv", "application/x-mpegURL": "m3u8", "text/vtt;charset=utf-8": "vtt", "audio/x-wav": "wav", None: None}),
    (vx.jsonp, {'cb({"a": 1});': '{"a": 1}', 'parseMetadata({"s":"O"})\n\n\n//epc': '{"s":"O"}', 'window.cb && cb({"s": 1});': '{"s": 1}', '({"s": 1});': '{"s": 1}'}),
    (tx.unescape, {"%20;": "%20;", "&#x2F;": "/", "&#47;": "/", "&eacute;": "é", "&a&quot;": '&a"', "&#2013266066;": "&#2013266066;", "&unknown;": "&unknown;"}),
    (tx.clean_html, {"a:\nb": "a: b", 'a:\n   "b"': 'a:    "b"', "a<br>\xa0b": "a\nb", "<p>x</p> <p class=1>y</p>": "x\ny"}),
    (ux.ext_of, {"http://e.com/foo/bar.mp4/?download": "mp4", "http://e.com/foo/bar/?download": "unknown_video", "http://e.com/foo/bar.nonext/?d": "unknown_video", "foobar": "unknown_video",
                 "http://e.com/foo/bar.m3u8//?d": "m3u8"}),
    (ux.valid, {"http://foo.de": "http://foo.de", "//foo.de": "//foo.de", "rtmpte://foo.de": "rtmpte://foo.de", "mms://f": "mms://f", "s3://x": None, "foo.de": None, " ftps://x ": "ftps://x"}),
    (lambda c: rc.safe_name(c), {"abc/def": "abc_def", "yes? no": "yes no", "this: that": "this - that", 'T "x"': "T 'x'", "-abc": "_abc", ".git": "git", "12:30": "12_30", "???": "_", "__a__b": "a_b"}),
    (sb.seconds, {"0.1": 0.1, "0.1s": 0.1, "00:00:01": 1, "00:00:01.100": 1.1, "00:00:01:100": 1.1, "x": None}),
])
def test_values(spark, fn, cases):
    got = run(spark, fn, list(cases))
    for (text, want), have in zip(cases.items(), got):
        assert have == (pytest.approx(want) if isinstance(want, float) else want), (text, want, have)


def test_resolution_and_codecs(spark):
    d = spark.createDataFrame([("1280x720", "avc1.77.30, mp4a.40.2"), ("720p", "theora, vorbis"), ("4k", "unknownvcodec, unknownacodec"), ("x", "unknown")], "r string, c string")
    rows = d.select(vx.resolution(F.col("r")).alias("r"), vx.codecs(F.col("c")).alias("c")).collect()
    assert [tuple(r["r"]) for r in rows] == [(1280, 720), (None, 720), (None, 2160), (None, None)]
    assert [tuple(r["c"])[:2] for r in rows] == [("avc1.77.30", "mp4a.40.2"), ("theora", "vorbis"), ("unknownvcodec", "unknownacodec"), (None, None)]


def test_floor_scale(spark):
    d = spark.createDataFrame([("-7",), ("7",), ("x",)], "t string")
    assert [r[0] for r in d.select(vx.int_or_null(F.col("t"), scale=2)).collect()] == [-4, 3, None]


def test_merge_blank_text_yields(spark):
    a = spark.createDataFrame([(1, "", 0), (2, None, None)], "k int, t string, n int")
    b = spark.createDataFrame([(1, "b", 5), (2, "", 6)], "k int, t string, n int")
    assert sorted(map(tuple, rc.merge_records([a, b], "k").collect())) == [(1, "b", 0), (2, "", 6)]


def test_item_list(spark):
    assert pl.item_list("5,1-3,2,0") == [5, 1, 2, 3, 0]
    d = spark.createDataFrame([(1, i, f"m{i}") for i in range(1, 5)], "playlist_id int, pos int, media string")
    out = pl.pick_items(d, "2,9,0").orderBy("out_pos").collect()
    # The number 9 gives nothing, so the last entry takes its index.
    assert [(r["media"], r["playlist_index"]) for r in out] == [("m2", 2), ("m4", 9)]


def test_relative_days():
    today = dt.date(2020, 3, 1)
    assert pl.day_of("today-1month", today) == today - dt.timedelta(days=30)
    assert pl.day_of("now+2years", today) == today + dt.timedelta(days=730)
    assert pl.day_of("20190105", today) == dt.date(2019, 1, 5)


def test_json_ld_counters_and_nulls(spark):
    html = ('<script type="application/ld+json">[{"@context":"x","@type":"VideoObject","name":"A","duration":"PT5S","interactionStatistic":[{"@type":"InteractionCounter","interactionType":"LikeAction",'
            '"userInteractionCount":"1,5"},{"@type":"InteractionCounter","interactionType":"LikeAction","userInteractionCount":9}]},{"@context":"x","@type":"Movie","name":null},{"@type":"Movie","name":"no context"}]</script>')
    r = pg.json_ld(spark.createDataFrame([(1, html)], "page_id int, html string")).collect()[0]
    assert (r["like_count"], r["title"], r["duration"]) == (15, None, None)


def test_cue_numbers_have_gaps(spark):
    body = '<tt><body><div><p begin="1" end="2">a</p><p end="3">b</p><p begin="3" dur="1">c<br/>d</p><p begin="4"/></div></body></tt>'
    cues = sb.ttml_cues(spark.createDataFrame([(1, body)], "file_id int, body string"))
    assert [(r["idx"], r["begin"], r["end"], r["text"]) for r in cues.orderBy("idx").collect()] == [(1, 1.0, 2.0, "a"), (3, 3.0, 4.0, "c\nd")]
    srt = "".join(r["block"] for r in sb.render_srt(cues).orderBy("idx").collect())
    assert srt == "1\n00:00:01,000 --> 00:00:02,000\na\n\n3\n00:00:03,000 --> 00:00:04,000\nc\nd\n\n"


def test_comments_and_cdata_are_no_tags(spark):
    body = '<tt><body><div><!-- <p begin="0" end="1">no</p> --><p begin="1" end="2"><![CDATA[a <b> & c]]></p></div></body></tt>'
    cues = sb.ttml_cues(spark.createDataFrame([(1, body)], "file_id int, body string")).collect()
    assert [(r["idx"], r["text"]) for r in cues] == [(1, "a <b> & c")]
    smil = '<smil><head><!-- <meta base="http://no/"/> --></head><body><!-- <video src="no.mp4"/> --><video src="http://x/a.mp4"/></body></smil>'
    df = spark.createDataFrame([(1, "http://m/x.smil", smil)], "manifest_id int, url string, body string")
    assert [r["url"] for r in mf.smil_formats(df).collect()] == ["http://x/a.mp4"]


def test_long_chains_and_cycles(spark):
    styles = [(1, f"s{i}", f"s{i - 1}" if i else None, i) for i in range(70)] + [(1, "x", "y", 0), (1, "y", "x", 0), (1, "z", "none", 0)]
    df = spark.createDataFrame(styles, "file_id int, style_id string, parent string, n int")
    own = F.struct(*[(F.when(F.col("n") == 0, F.lit(p)) if p == "color" else F.lit(None).cast("string")).alias(p) for p in sb.PROPS])
    got = {r["style_id"]: r["style"]["color"] for r in sb.resolve_styles(df.withColumn("style", own)).collect()}
    assert got == {f"s{i}": "color" for i in range(70)}
    hop = [(f"m{i}", 0, "m3u8" if i < 8 else "format", f"f{i}", f"m{i + 1}") for i in range(9)] + [("c", 0, "m3u8", "c", "d"), ("d", 0, "m3u8", "d", "c")]
    kids = spark.createDataFrame(hop, "manifest_url string, pos bigint, route string, format_id string, url string")
    top = spark.createDataFrame([(1, 0, "m3u8", "a", "m0"), (2, 0, "m3u8", "b", "c")], "media_id int, pos bigint, route string, format_id string, url string")
    none = {c: F.lit(None).cast("bigint") for c in ("tbr", "width", "height")}
    out = mf.resolve_manifest_edges(top.withColumns(none), kids.withColumns(none)).collect()
    assert {(r["media_id"], r["route"], r["url"], len(r["path"])) for r in out} == {(1, "format", "m9", 10), (2, "cycle", "c", 3)}


def test_hostile_pages(spark):
    many = " ".join(f'a{i}="{i}"' for i in range(20_000))
    html = f'<div {many} id="x">in</div><meta {many} http-equiv="refresh" content="1; URL=/to">'
    df = spark.createDataFrame([(1, "http://h/a", html, None), (2, "http://h/b", "<p>", "0; url=http://h/c")], "page_id int, url string, html string, refresh string")
    assert [r["content"] for r in pg.select_elements(df, "id", "x").collect()] == ["in"]
    assert {(r["page_id"], r["dst"]) for r in pg.redirect_edges(df).collect()} == {(1, "http://h/to"), (2, "http://h/c")}


def test_charset_of_bytes_and_player_card(spark):
    df = spark.createDataFrame([(1, bytearray(b"\xff\xfeh\x00"), None), (2, bytearray(b"\xe9" * 1020 + b'<meta charset="x">'), None), (3, bytearray(b'<meta charset="latin-1">'), None)],
                               "page_id int, html binary, content_type string")
    assert [r["charset"] for r in pg.detect_charset(df).orderBy("page_id").collect()] == ["utf-16", "utf-8", "latin-1"]
    card = spark.createDataFrame([(1, "http://h/a", '<meta name="twitter:player" content="https://p.example.com/1">')], "page_id int, url string, html string")
    assert [(r["url"], r["route"]) for r in em.scrape_media_links(card).collect()] == [("https://p.example.com/1", "embed")]


def test_routing_first_match_and_limit(spark):
    cat = spark.createDataFrame([(1, "B", r"https?://b\.com/(?P<id>\d+)", "b.com"), (0, "A", r"https?://b\.com/1(?P<id>\d)", "b.com"), (2, "G", ".*", None)],
                                "ord int, extractor_key string, url_regex string, host_token string")
    u = spark.createDataFrame([("http://b.com/12",), ("http://b.com/22",), ("x http://b.com/1",)], "url string")
    want = [("http://b.com/12", "A", "2"), ("http://b.com/22", "B", "22"), ("x http://b.com/1", "G", None)]
    for pre in (False, True):
        assert sorted((r["url"], r["extractor_key"], r["media_id"]) for r in routing.route(u, cat, prefilter=pre).collect()) == want


def test_attribute_map(spark):
    d = spark.createDataFrame([('<e x=1 X="2" y=\'a&amp;b\' z >',)], "t string")
    assert d.select(hx.attribute_map(F.col("t"))).collect()[0][0] == {"x": "2", "y": "a&b", "z": None}


def test_javascript_literals(spark):
    import json

    from mediaspark.functions import js
    cases = {
        "{a: 1, 'b': \"c\", }": {"a": 1, "b": "c"}, "[1, 2, /* no */ 3,] tail": [1, 2, 3], "{a: 'it\\'s \"x\"', b: !0, c: !1, d: void 0}": {"a": 'it\'s "x"', "b": True, "c": False, "d": None},
        "{x: 0x1F, y: 010, 3: 'k', true: 1} // end": {"x": 31, "y": 8, "3": "k", "true": 1}, '{"u": "\\/\\u00e9", "h": "\\x41"}': {"u": "/é", "h": "A"},
        "{u: 'http://h/a', // note }\n v: [{w: -1.5e3}]})": {"u": "http://h/a", "v": [{"w": -1500.0}]}, "{a: undefined, b: name}": {"a": None, "b": "name"}}
    got = run(spark, js.to_json, [*cases, "no literal", "{open", None])
    assert [g and json.loads(g) for g in got] == [*cases.values(), None, None, None]


def test_player_literals(spark):
    pages = [(1, "http://h/p", "<script>jwplayer('p').setup({file: 'x.mp4', /* c */ title: 'T',});</script>"),
             (2, "http://h/p", "<script>jwplayer(\"p\").load([{file: 'a.m3u8'}, {file: 'b.mp4'}]); other({});</script>"), (3, "http://h/p", "<script>jwplayer('p')</script>")]
    df = spark.createDataFrame(pages, "page_id int, url string, html string")
    items = em.player_items(em.find_players(df))
    assert sorted((r["page_id"], r["url"], r["route"]) for r in em.player_formats(items).collect()) == [
        (1, "http://h/x.mp4", "file"), (2, "http://h/a.m3u8", "m3u8"), (2, "http://h/b.mp4", "file")]
    v = spark.createDataFrame([(1, "http://h/p", "<script>videojs('v').src({src: 'a.mp4', type: 'video/mp4'});</script>")], "page_id int, url string, html string")
    assert [r["url"] for r in em.videojs_sources(v).collect()] == ["http://h/a.mp4"]


def test_compatibility_letters_in_restricted_names(spark):
    names = ["\uff46\uff55\uff4c\uff4c \ufb01ne", "x\u00b2 \u2122", "e\u0301t\u00e9", "\u65e5a", "\U0001d400b", "plain"]
    assert run(spark, lambda c: rc.safe_name(c, restricted=True), names) == ["full_fine", "x2_TM", "ete", "a", "Ab", "plain"]
    assert run(spark, lambda c: rc.safe_name(c, restricted=True, is_id=True), ["\uff46"]) == ["_"]
