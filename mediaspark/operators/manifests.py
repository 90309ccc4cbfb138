"""Smooth Streaming, F4M, SMIL and XSPF manifests, and manifests that point to others."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from ..functions import html as hx, urls as ux, values as vx
from ..functions.core import filled, let, once, pack, scan
from ..session import cut

XML_OPTIONS = {"ignoreNamespace": "true"}


def fixed(xml: Column) -> Column:
    """XML text with bare ampersands escaped."""
    return F.regexp_replace(xml, r"&(?!amp;|lt;|gt;|apos;|quot;|#x[0-9a-fA-F]{0,4};|#[0-9]{0,4};)", "&amp;")


def fix_ampersands(df: DataFrame, col: str) -> DataFrame:
    return df.withColumn(col, fixed(F.col(col)))


_ISM = ("_IsLive string,_Duration bigint,_TimeScale bigint,Protection array<struct<_VALUE string>>,StreamIndex array<struct<_Type string,_Url string,_Name string,"
        "_TimeScale bigint,c array<struct<_t bigint,_d bigint,_r bigint>>,QualityLevel array<struct<_Bitrate bigint,_FourCC string,"
        "_AudioTag string,_MaxWidth int,_Width int,_MaxHeight int,_Height int,_SamplingRate int>>>>")
# Codecs of Smooth Streaming that can be used.
ISM_CODECS = ["H264", "AVC1", "AACL"]


def _ism_tracks(manifests: DataFrame, chunks: bool = False) -> DataFrame:
    x = manifests.select("manifest_id", "url", once(F.from_xml(fixed(F.col("body")), _ISM, XML_OPTIONS)).alias("x"))
    # Only the exact word TRUE marks a live stream; any Protection element closes the manifest.
    x = x.filter(~F.coalesce(F.col("x._IsLive") == "TRUE", F.lit(False)) & F.col("x.Protection").isNull())
    scale = F.coalesce(F.nullif("x._TimeScale", F.lit(0)), F.lit(10000000))
    s = x.select("manifest_id", "url", F.col("x._Duration").alias("total"), scale.alias("scale"), F.posexplode("x.StreamIndex").alias("stream_no", "s"))
    s = s.filter(F.col("s._Type").isin("video", "audio")).withColumn("scale", F.coalesce(F.nullif("s._TimeScale", F.lit(0)), F.col("scale")))
    if chunks:  # the same for all tracks of a stream
        s = s.withColumn("chunks", _ism_chunks(F.col("s.c"), F.col("total")))
    t = s.select("*", F.posexplode("s.QualityLevel").alias("track_no", "q"))
    fourcc = F.coalesce("q._FourCC", F.when(F.col("q._AudioTag") == "255", F.lit("AACL")))
    return t.withColumn("fourcc", fourcc).filter(fourcc.isin(ISM_CODECS)).withColumn("tbr", F.floor(F.col("q._Bitrate") / 1000).cast("bigint"))


def ism_formats(manifests: DataFrame, ism_id: str | None = None) -> DataFrame:
    """Quality levels of video and audio streams."""
    t = _ism_tracks(manifests)
    video = F.col("s._Type") == "video"
    size = lambda a, b: F.coalesce(F.nullif(a, F.lit(0)), F.col(b))
    return t.select(
        "manifest_id", "stream_no", "track_no", F.concat_ws("-", F.lit(ism_id).cast("string"), F.nullif("s._Name", F.lit("")), F.col("tbr").cast("string")).alias("format_id"),
        "url", F.when(video, F.lit("ismv")).otherwise(F.lit("isma")).alias("ext"), size("q._MaxWidth", "q._Width").alias("width"),
        size("q._MaxHeight", "q._Height").alias("height"), "tbr", F.col("q._SamplingRate").alias("asr"),
        F.when(video, F.col("fourcc")).otherwise(F.lit("none")).alias("vcodec"), F.when(video, F.lit("none")).otherwise(F.col("fourcc")).alias("acodec"))


_CHUNK = "struct<t:bigint,span:bigint,reps:bigint,d:bigint>"


def _ism_chunks(c: Column, total: Column) -> Column:
    """Entries of a stream as array<struct<start, len, rep, before>>, by running values over them."""
    rep = lambda x: F.coalesce(F.nullif(x["_r"], F.lit(0)), F.lit(1))
    dur = lambda x: F.nullif(x["_d"], F.lit(0))

    def entry(x, i):
        # After an entry without a duration time stands at the total.
        stands = (i > 0) & dur(F.get(c, i - 1)).isNull()
        return pack(t=F.coalesce(F.nullif(x["_t"], F.lit(0)), F.when(stands, total)), span=F.coalesce(dur(x) * rep(x), F.lit(0)), reps=rep(x), d=dur(x))
    add = lambda x, y: pack(t=F.coalesce(y["t"], x["t"]), span=F.when(y["t"].isNotNull(), y["span"]).otherwise(x["span"] + y["span"]), reps=x["reps"] + y["reps"], d=y["d"])

    def placed(x, y):
        start = F.coalesce(y["t"], F.lit(0)) + y["span"] - x["span"]
        length = F.coalesce(x["d"].cast("double"), (total - start) / x["reps"])
        return pack(start=start, len=length, rep=x["reps"], before=y["reps"] - x["reps"])
    return let(F.transform(c, entry), lambda own: F.zip_with(own, scan(own, _CHUNK, add), placed))


def ism_segments(manifests: DataFrame) -> DataFrame:
    """Fragments of each quality level; a start of 0 or none continues, a missing duration fills up the total.

    The entries are placed within the row, once the XML is read; nothing is shuffled."""
    t = _ism_tracks(manifests, chunks=True)
    key = ["manifest_id", "stream_no", "track_no"]
    pattern = F.regexp_replace("s._Url", r"\{[Bb]itrate\}", F.col("q._Bitrate").cast("string"))
    # Links are resolved once per track, before its fragments become rows.
    t = t.select(*key, "scale", let(pack(base=F.col("url"), link=pattern), lambda p: F.coalesce(ux.resolve(p["base"], p["link"]), p["link"])).alias("full"), "chunks")
    c = t.select(*key, "scale", "full", F.inline("chunks"))
    c = c.select("*", F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("rep") - 1)).alias("k"))
    at = (F.col("start") + F.col("k") * F.col("len")).cast("bigint").cast("string")
    return c.select(*key, (F.col("before") + F.col("k") + 1).alias("seq"), F.regexp_replace("full", r"\{start[ _]time\}", at).alias("url"),
                    (F.col("len") / F.col("scale")).alias("duration"))


_F4M = ("`pv-2.0` string,baseURL string,mimeType string,bootstrapInfo array<struct<_id string,_url string,_VALUE string>>,media array<struct<_bitrate string,_width string,_height string,_href string,"
        "_url string,_drmAdditionalHeaderId string,_drmAdditionalHeaderSetId string>>")


def f4m_formats(manifests: DataFrame, f4m_id: str | None = None) -> DataFrame:
    """Media entries of F4M manifests (D12). ``route`` is ``format``, or ``f4m``/``m3u8`` for entries that point to a manifest.

    A relative entry without a base URL is taken from the folder of the URL worked on last, so the
    entries of one manifest are folded in order.
    """
    # Whether links come from either attribute is asked once per manifest, below the generator.
    second = (~F.col("body").contains("ns.adobe.com/f4m/1.0")).alias("second")
    x = manifests.select("manifest_id", "url", second, once(F.from_xml(F.trim(fixed(F.col("body"))), _F4M, XML_OPTIONS)).alias("x"))
    locked = F.coalesce(F.col("x.`pv-2.0`").contains(";") & (F.trim(F.substring_index(F.col("x.`pv-2.0`"), ";", 1)) != ""), F.lit(False))
    open_ = F.filter("x.media", lambda m: m["_drmAdditionalHeaderId"].isNull() & m["_drmAdditionalHeaderSetId"].isNull())
    base = F.nullif(F.trim("x.baseURL"), F.lit(""))
    stream_level = F.col("x.bootstrapInfo").isNotNull()
    link = lambda m: F.when(F.col("second"), F.coalesce(m["_href"], m["_url"])).otherwise(m["_url"])
    nodes = F.transform(open_, lambda m, i: F.struct(
        i.alias("i"), F.nullif(link(m), F.lit("")).alias("link"), m["_bitrate"].try_cast("bigint").alias("tbr"),
        m["_width"].try_cast("int").alias("width"), m["_height"].try_cast("int").alias("height")))
    d = x.filter(~locked).select("manifest_id", "url", base.alias("base"), stream_level.alias("stream_level"), nodes.alias("nodes"),
                                 F.coalesce(F.col("x.mimeType").startswith("audio/"), F.lit(False)).alias("audio"))
    folder = lambda u: F.regexp_replace(u, "/[^/]*$", "")

    def place(n):
        # Where an entry points to: a place of its own (fixed), or one in the folder of the URL before it; without a link it changes nothing.
        whole = n["link"].rlike("^https?://")
        link = F.when(F.col("stream_level"), None).when(whole, n["link"]).otherwise(F.concat(F.coalesce(F.concat("base", F.lit("/")), F.lit("")), n["link"]))
        return pack(fixed=F.coalesce(whole | F.col("base").isNotNull(), F.lit(False)), v=link)

    def after(x, y):
        within = F.when(x["fixed"] | x["v"].contains("/"), F.concat(folder(x["v"]), F.lit("/"), y["v"])).otherwise(y["v"])
        return F.when(y["v"].isNull(), x).when(y["fixed"] | x["v"].isNull(), y).otherwise(pack(fixed=x["fixed"], v=within))
    places = F.concat(F.array(pack(fixed=F.lit(True), v=F.col("url"))), F.transform("nodes", place))
    at = scan(places, "struct<fixed:boolean,v:string>", after)
    d = d.withColumn("urls", let(at, lambda x: F.transform(F.slice(x, F.lit(2), F.size("nodes")), lambda p: p["v"])))
    zipped = F.zip_with("nodes", "urls", lambda n, u: F.struct(n.alias("n"), u.alias("u")))
    d = d.select("manifest_id", "stream_level", "audio", F.inline(zipped))
    d = d.filter(F.col("stream_level") | F.col("n.link").isNotNull())
    ext = ux.ext_of(F.col("u"))
    route = F.when(~F.col("stream_level") & ext.isin("f4m", "m3u8"), ext).otherwise(F.lit("format"))
    n = F.col("n")
    return d.select("manifest_id", n["i"].alias("pos"), route.alias("route"),
                    F.concat_ws("-", F.lit(f4m_id).cast("string"), F.coalesce(n["tbr"].cast("string"), n["i"].cast("string"))).alias("format_id"),
                    F.col("u").alias("url"), F.when(F.col("stream_level"), F.lit("flv")).alias("ext"), n["tbr"].alias("tbr"), n["width"].alias("width"),
                    n["height"].alias("height"), F.when(F.col("audio"), F.lit("none")).alias("vcodec"))


def _tags(name: str) -> Column:
    return F.transform(F.regexp_extract_all(hx.without_comments(F.col("body")), F.lit(rf"(?is)(<(?:[a-z0-9]+:)?{name}\b[^>]*>)"), F.lit(1)), hx.attributes)


def _sources(tags: Column) -> Column:
    """array<struct<src, a>> of tags with a source, each source once."""
    rows = F.filter(F.transform(tags, lambda a: pack(src=_any(a, "src"), a=a)), lambda m: m["src"].isNotNull())
    return let(rows, lambda ms: let(F.transform(ms, lambda m: m["src"]), lambda srcs: F.filter(
        ms, lambda m, i: F.array_position(srcs, m["src"]) == i + 1)))


def _any(a: Column, *names) -> Column:
    return F.coalesce(*[filled(hx.get(a, n.lower())) for n in names])


def smil_formats(manifests: DataFrame) -> DataFrame:
    """Media of SMIL files, videos first, repeated sources dropped.

    ``route`` is ``rtmp`` or ``http`` for renditions, else the kind of manifest the entry points to;
    rtmp and http renditions without a bitrate are numbered in order.
    """
    d = manifests.select("manifest_id", "url", hx.without_comments(F.col("body")).alias("body"))
    head = F.regexp_extract("body", r"(?is)<(?:[a-z0-9]+:)?head\b[^>]*>(.*?)</(?:[a-z0-9]+:)?head>", 1)
    # Attributes are read of those tags only that hold the name.
    based = F.filter(F.regexp_extract_all(head, F.lit(r"(?is)(<(?:[a-z0-9]+:)?meta\b[^>]*>)"), F.lit(1)), lambda t: F.lower(t).contains("base"))
    metas = F.transform(based, lambda t: let(hx.attributes(t), lambda a: _any(a, "base", "httpBase")))
    base = F.coalesce(F.try_element_at(F.filter(metas, lambda b: b.isNotNull()), F.lit(1)), F.col("url"))
    tags = lambda name: F.regexp_extract_all("body", F.lit(rf"(?is)(<(?:[a-z0-9]+:)?{name}\b[^>]*>)"), F.lit(1))
    # Within the row tags are cut into attributes, and each source stays once; the other attributes are read row by row, by plain columns, which Spark compiles.
    d = d.select("manifest_id", base.alias("base"), F.transform(F.concat(tags("video"), tags("audio")), lambda t: pack(**hx.tokens(t))).alias("tags"))
    src_of = lambda t: let(hx.bare(hx.raw_of(t["names"], t["raw"], "src")), lambda v: filled(hx.unescape(v)))
    d = d.select("manifest_id", "base", "tags", F.transform("tags", src_of).alias("srcs"))
    pairs = F.zip_with("tags", "srcs", lambda t, src: pack(src=src, names=t["names"], raw=t["raw"]))
    firsts = F.filter(pairs, lambda m, i: m["src"].isNotNull() & (F.array_position("srcs", m["src"]) == i + 1))
    d = d.select("manifest_id", "base", F.posexplode(firsts).alias("pos", "m"))
    names = ["proto", "streamer", "system-bitrate", "systembitrate", "size", "filesize", "width", "height", "ext"]
    d = d.select("manifest_id", "pos", "base", F.col("m.src").alias("src"), F.array(*[hx.bare(hx.raw_of(F.col("m.names"), F.col("m.raw"), n)) for n in names]).alias("a"))
    d = d.withColumn("a", F.transform("a", lambda v: filled(hx.unescape(v))))
    a = lambda *of: F.coalesce(*[F.get("a", F.lit(names.index(n))) for n in of])
    src = F.col("src")
    d = d.withColumns({"proto": F.coalesce(a("proto"), F.lit("")), "streamer": F.coalesce(a("streamer"), F.col("base")), "src_ext": ux.ext_of(src),
                       "full": F.trim(F.when(src.startswith("http"), src).otherwise(F.coalesce(ux.resolve(F.col("base"), src), src)))})
    proto, streamer, full, src_ext = F.col("proto"), F.col("streamer"), F.col("full"), F.col("src_ext")
    route = (F.when((proto == "rtmp") | streamer.startswith("rtmp"), F.lit("rtmp"))
             .when((proto == "m3u8") | (src_ext == "m3u8"), F.lit("m3u8")).when(src_ext == "f4m", F.lit("f4m"))
             .when(src_ext == "mpd", F.lit("mpd")).when(full.rlike(r"\.ism/[Mm]anifest"), F.lit("ism")).when(full.startswith("http"), F.lit("http")))
    # The filter by the route stays above, so that nothing is worked out for it again.
    d = d.select("manifest_id", "pos", "src", "a", "streamer", "src_ext", "full", once(route).alias("route"))
    route = F.col("route")
    tbr = a("system-bitrate", "systembitrate").try_cast("double") / 1000
    d = d.select("manifest_id", "pos", "route", F.when(route == "rtmp", streamer).otherwise(full).alias("url"),
                 F.when(route == "rtmp", src).alias("play_path"), tbr.alias("tbr"), a("size", "filesize").try_cast("bigint").alias("filesize"),
                 a("width").try_cast("int").alias("width"), a("height").try_cast("int").alias("height"),
                 F.when(route == "rtmp", F.lit("flv")).when(route == "http", F.coalesce(a("ext"), src_ext)).alias("ext"))
    d = d.filter(F.col("route").isNotNull())
    # The count of entries of one kind so far, within one stored file.
    n = F.row_number().over(W.partitionBy("manifest_id", "route").orderBy("pos"))
    shown = F.when(F.col("route") == "http", F.coalesce(F.nullif("tbr", F.lit(0.0)), n)).otherwise(F.coalesce("tbr", n)).cast("bigint")
    return d.withColumn("format_id", F.when(F.col("route").isin("rtmp", "http"), F.concat("route", F.lit("-"), shown.cast("string"))))


def smil_subtitles(manifests: DataFrame, lang: str = "en") -> DataFrame:
    """Text streams of SMIL files by language."""
    d = manifests.select("manifest_id", F.posexplode(_sources(_tags("textstream"))).alias("pos", "m"))
    a = F.col("m.a")
    return d.select("manifest_id", "pos", F.coalesce(_any(a, "systemLanguage", "systemLanguageName", "lang"), F.lit(lang)).alias("lang"),
                    _any(a, "src").alias("url"), F.coalesce(_any(a, "ext"), vx.mime_ext(_any(a, "type")), ux.ext_of(_any(a, "src"))).alias("ext"))


def smil_info(manifests: DataFrame) -> DataFrame:
    """Title, description and date of SMIL files."""
    head = F.regexp_extract(hx.without_comments(F.col("body")), r"(?is)<(?:[a-z0-9]+:)?head\b[^>]*>(.*?)</(?:[a-z0-9]+:)?head>", 1)
    metas = F.transform(F.regexp_extract_all(head, F.lit(r"(?is)(<(?:[a-z0-9]+:)?meta\b[^>]*>)"), F.lit(1)), lambda t: let(
        hx.attributes(t), lambda a: pack(n=_any(a, "name"), c=_any(a, "content"))))
    d = manifests.select("manifest_id", "url", metas.alias("m"))
    first = lambda *names: F.try_element_at(F.filter("m", lambda x: x["n"].isin(*names) & x["c"].isNotNull()), F.lit(1))["c"]
    name = F.regexp_replace(ux.basename(F.col("url")), r"^(.*[^.].*)\.[^.]*$", "$1")
    dates = F.filter(F.transform(F.filter("m", lambda x: x["n"] == "date"), lambda x: vx.strdate(x["c"])), lambda x: x.isNotNull())
    return d.select("manifest_id", name.alias("id"), F.coalesce(first("title"), name).alias("title"),
                    first("description", "abstract").alias("description"), F.try_element_at(dates, F.lit(1)).alias("upload_date"))


def smil_thumbnails(manifests: DataFrame) -> DataFrame:
    """Images of SMIL files."""
    d = manifests.select("manifest_id", F.posexplode(F.filter(_tags("image"), lambda a: _any(a, "src").isNotNull())).alias("pos", "a"))
    a = F.col("a")
    return d.select("manifest_id", "pos", hx.get(a, "type").alias("id"), _any(a, "src").alias("url"),
                    hx.get(a, "width").try_cast("int").alias("width"), hx.get(a, "height").try_cast("int").alias("height"))


_XSPF = ("trackList struct<track array<struct<title string,annotation string,image string,duration string,"
         "location array<struct<_VALUE string,_label string,_width string,_height string>>>>>")


def xspf_tracks(manifests: DataFrame) -> DataFrame:
    x = manifests.select("manifest_id", "url", once(F.from_xml(fixed(F.col("body")), _XSPF, XML_OPTIONS)).alias("x"))
    return x.select("manifest_id", "url", F.posexplode("x.trackList.track").alias("pos", "t"))


def xspf_entries(manifests: DataFrame) -> DataFrame:
    """Tracks of XSPF playlists."""
    t = F.col("t")
    return xspf_tracks(manifests).select("manifest_id", "pos", F.coalesce(t["title"], F.col("manifest_id").cast("string")).alias("title"),
                                         t["annotation"].alias("description"), t["image"].alias("thumbnail"),
                                         (t["duration"].try_cast("double") / 1000).alias("duration"))


def xspf_formats(manifests: DataFrame) -> DataFrame:
    """One rendition per location of a track; rank them with ``rank_formats``."""
    d = xspf_tracks(manifests).select("manifest_id", ux.base_url(F.col("url")).alias("base"), F.col("pos").alias("track"), F.posexplode("t.location").alias("pos", "l"))
    full = ux.resolve(F.col("base"), F.trim("l._VALUE"))
    return d.select("manifest_id", "track", "pos", full.alias("url"), F.col("l._label").alias("format_id"),
                    F.col("l._width").try_cast("int").alias("width"), F.col("l._height").try_cast("int").alias("height")).filter(F.col("url").isNotNull())


#: Rows of the closure of manifests that are broadcast; more are joined by a shuffle.
MAX_BROADCAST_ROWS = 100_000


def resolve_manifest_edges(formats: DataFrame, children: DataFrame) -> DataFrame:
    """Replace entries that point to a manifest by that manifest's renditions, over any number of hops.

    ``formats(media_id, pos, route, url, format_id, tbr, width, height)``: a row whose ``route`` is not
    ``format`` is an edge to ``children(manifest_url, pos, route, ...)``. An only child takes size and
    bitrate it lacks from its parent. ``path`` keeps the order; an edge without a target gives nothing. An edge to a
    manifest that is already on its own path ends with the route ``cycle``; the rounds end when no edge is left.

    The rounds work on manifests, not on rows: what stands behind an edge depends on its URL, and on whether it has a bitrate. Each round
    writes only the edges that are left; renditions are joined to them, and to the rows, when the result is read.
    """
    sizes = ["tbr", "width", "height"]
    fields = ["format_id", "url", *sizes]
    rated = F.coalesce("tbr", F.lit(0)) != 0
    many = children.groupBy("manifest_url").agg(F.count(F.lit(1)).alias("__n"))
    kids = children.join(many, "manifest_url")
    kids = kids.select(F.col("manifest_url").alias("k_manifest"), (F.col("__n") == 1).alias("only"), F.col("route").alias("k_route"),
                       F.col("pos").cast("bigint").alias("k_pos"), *[F.col(c).alias(f"k_{c}") for c in fields])
    edges = formats.filter("route <> 'format'").withColumn("rated", rated)
    # own_x: the row behind the edge takes x from the edge itself, as long as only children that lack it follow each other.
    live = edges.select("url", "rated").distinct()
    live = live.select(F.col("url").alias("root"), "rated", F.expr("CAST(array() AS ARRAY<BIGINT>)").alias("tail"), "url", F.array("url").alias("seen"),
                       F.lit(None).cast(_type(children, "format_id")).alias("format_id"), F.lit(True).alias("own_format_id"),
                       *[x for c in sizes for x in (F.lit(None).cast(_type(children, c)).alias(c), F.lit(True).alias(f"own_{c}"))])
    live = cut(live)
    state = ["root", "rated", "tail", "url", *[x for c in ("format_id", *sizes) for x in (c, f"own_{c}")]]

    def step(live, kids):
        j = live.join(kids, live["url"] == kids["k_manifest"])
        lacks = lambda c: F.nullif(F.col(f"k_{c}"), F.lit(0)).isNull()
        take = lambda c: F.when(F.col("only"), F.coalesce(F.nullif(F.col(f"k_{c}"), F.lit(0)), F.col(c))).otherwise(F.col(f"k_{c}")).alias(c)
        # The parent's name stays with its only child where the parent has a bitrate.
        keeps = F.col("only") & F.when(F.col("own_tbr"), F.col("rated")).otherwise(rated)
        again = (F.col("k_route") != "format") & F.array_contains("seen", F.col("k_url"))
        return j.select("root", "rated", F.concat("tail", F.array("k_pos")).alias("tail"), F.col("k_url").alias("url"),
                        F.when(again, F.lit("cycle")).otherwise(F.col("k_route")).alias("route"), F.concat("seen", F.array("k_url")).alias("seen"),
                        F.when(keeps, F.col("format_id")).otherwise(F.col("k_format_id")).alias("format_id"), (F.col("own_format_id") & keeps).alias("own_format_id"),
                        *[x for c in sizes for x in (take(c), (F.col(f"own_{c}") & F.col("only") & lacks(c)).alias(f"own_{c}"))])
    ends, inner = kids.filter("k_route = 'format'"), kids.filter("k_route <> 'format'")
    done = []
    while True:
        done.append(step(live, ends).select(*state, "route"))
        further = cut(step(live, inner))
        done.append(further.filter("route = 'cycle'").select(*state, "route"))
        live = further.filter("route <> 'cycle'")
        if live.isEmpty():
            break
    behind = reduce(DataFrame.unionByName, done)
    behind = behind.select(*[F.col(c).alias(f"b_{c}") for c in behind.columns])
    if behind.limit(MAX_BROADCAST_ROWS + 1).count() <= MAX_BROADCAST_ROWS:
        behind = F.broadcast(behind)
    j = edges.join(behind, (edges["url"] == behind["b_root"]) & (edges["rated"] == behind["b_rated"]))
    own = lambda c: F.when(F.col(f"b_own_{c}"), F.col(c)).otherwise(F.col(f"b_{c}")).alias(c)
    at = F.array(F.col("pos").cast("bigint"))
    found = j.select("media_id", F.concat(at, "b_tail").alias("path"), F.col("b_route").alias("route"), own("format_id"), F.col("b_url").alias("url"), *[own(c) for c in sizes])
    return formats.filter("route = 'format'").select("media_id", at.alias("path"), "route", *fields).unionByName(found)


def _type(df: DataFrame, col: str):
    return df.schema[col].dataType
