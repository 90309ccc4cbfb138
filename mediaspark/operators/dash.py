"""DASH manifests into renditions, subtitles and segments.

The XML is read by ``from_xml``; everything down to the representation is nested explodes within the
row, and segment timelines are running values over their entries.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from ..functions import urls as ux, values as vx
from ..functions.core import let, once, pack, scan
from .manifests import XML_OPTIONS, fixed

_COMMON = ("SegmentTimeline struct<S array<struct<_t bigint,_d bigint,_r bigint>>>, _startNumber bigint, _timescale bigint, "
           "_duration double, Initialization struct<_sourceURL string,_range string>")
_LIST = f"SegmentList struct<{_COMMON}, SegmentURL array<struct<_media string,_mediaRange string>>>"
_TEMPLATE = f"SegmentTemplate struct<{_COMMON}, _media string, _initialization string>"
_BASE = "BaseURL array<struct<_VALUE string,_contentLength bigint>>"
_ATTRS = ("_mimeType string,_contentType string,_codecs string,_id string,_lang string,_bandwidth bigint,_width int,_height int,"
          "_audioSamplingRate int,_frameRate string")
_NAMES = [f"_{n}" for n in ("mimeType", "contentType", "codecs", "id", "lang", "bandwidth", "width", "height", "audioSamplingRate", "frameRate")]
_DRM = "ContentProtection array<struct<_schemeIdUri string>>"
_REP = f"Representation array<struct<{_ATTRS},{_BASE},{_LIST},{_TEMPLATE},{_DRM}>>"
_SET = f"AdaptationSet array<struct<{_ATTRS},{_BASE},{_LIST},{_TEMPLATE},{_DRM},{_REP}>>"
SCHEMA = f"_type string,_mediaPresentationDuration string,{_BASE},Period array<struct<_duration string,{_BASE},{_LIST},{_TEMPLATE},{_SET}>>"


def _join_base(parent: Column, element: Column) -> Column:
    """Base URL of an element within its parent's."""
    own = F.nullif(F.try_element_at(element["BaseURL"], F.lit(1))["_VALUE"], F.lit(""))
    folder = F.when(parent.rlike("[/:]$"), parent).otherwise(F.concat(parent, F.lit("/")))
    joined = F.when(own.rlike(r"^[a-zA-Z][a-zA-Z0-9+.-]*://"), own).otherwise(F.coalesce(ux.resolve(folder, own), own))
    return F.when(own.isNull(), parent).when(parent.isNull(), own).otherwise(joined)


def _segment_info(e: Column, base: Column) -> dict:
    """Segment settings an element states itself; a list hides a template of the same element."""
    lst, tpl = e["SegmentList"], e["SegmentTemplate"]
    both = lambda f: F.when(lst.isNotNull(), f(lst)).otherwise(f(tpl))
    only = lambda f: F.when(lst.isNull(), f(tpl))
    init = lambda s: s["Initialization"]
    # A template's initialisation pattern hides its Initialization element.
    start = F.when(lst.isNotNull(), init(lst)).when(tpl["_initialization"].isNull(), init(tpl))
    urls = F.transform(F.filter(lst["SegmentURL"], lambda u: u["_media"].isNotNull()), lambda u: u["_media"])
    ranges = F.filter(F.transform(lst["SegmentURL"], lambda u: F.nullif(F.regexp_extract(u["_mediaRange"], r"^(\d+-\d+)$", 1), F.lit(""))),
                      lambda r: r.isNotNull())
    filled = lambda a: F.when(F.size(a) > 0, a)
    urls, ranges = filled(urls), filled(ranges)
    return {"s": filled(both(lambda x: x["SegmentTimeline"]["S"])), "start_number": both(lambda x: x["_startNumber"]),
            "timescale": both(lambda x: x["_timescale"]), "segment_duration": both(lambda x: x["_duration"]),
            "init_url": F.when(start.isNotNull(), F.coalesce(start["_sourceURL"], base)), "init_range": start["_range"],
            "urls": F.coalesce(urls, F.transform(ranges, lambda r: base)), "ranges": ranges,
            "media": only(lambda x: F.nullif(x["_media"], F.lit(""))), "init_template": only(lambda x: F.nullif(x["_initialization"], F.lit("")))}


def representations(manifests: DataFrame, mpd_id: str | None = None) -> DataFrame:
    """One row per unprotected representation with inherited attributes and segment settings."""
    x = manifests.select("manifest_id", "url", once(F.from_xml(fixed(F.col("body")), SCHEMA, XML_OPTIONS)).alias("x"))
    x = x.filter(~F.coalesce(F.col("x._type") == "dynamic", F.lit(False)))
    # Relative bases start at the folder of the manifest.
    folder = F.regexp_replace("url", "/[^/]*$", "")
    seconds = lambda c: let(vx.duration(c), lambda v: F.when(v != 0, v))
    p = x.select("manifest_id", "url", _join_base(folder, F.col("x")).alias("b0"), seconds(F.col("x._mediaPresentationDuration")).alias("total"),
                 F.posexplode("x.Period").alias("period", "p"))
    # What a level states itself is worked out once per element of that level.
    p = p.withColumn("b1", _join_base(F.col("b0"), F.col("p"))).withColumn("total", F.coalesce(seconds(F.col("p._duration")), F.col("total")))
    p = p.select("manifest_id", "url", "period", "b1", "total", pack(**_segment_info(F.col("p"), F.col("b1"))).alias("ip"), F.col("p.AdaptationSet").alias("sets"))
    a = p.select("manifest_id", "url", "period", "b1", "total", "ip", F.posexplode("sets").alias("set_no", "a")).filter(F.col("a.ContentProtection").isNull())
    a = a.withColumn("b2", _join_base(F.col("b1"), F.col("a")))
    own_a, up = _segment_info(F.col("a"), F.col("b2")), F.col("ip")
    a = a.select("manifest_id", "url", "period", "set_no", "b2", "total", pack(**{k: F.coalesce(c, up[k]) for k, c in own_a.items()}).alias("ia"),
                 pack(**{n: F.col(f"a.{n}") for n in _NAMES}).alias("a"), F.col("a.Representation").alias("reps"))
    r = a.select("manifest_id", "url", "period", "set_no", "b2", "total", "ia", "a", F.posexplode("reps").alias("rep_no", "r")).filter(F.col("r.ContentProtection").isNull())
    r = r.withColumn("b3", _join_base(F.col("b2"), F.col("r")))
    info = {k: F.coalesce(c, F.col("ia")[k]) for k, c in _segment_info(F.col("r"), F.col("b3")).items()}
    at = lambda n: F.coalesce(F.col(f"r.{n}"), F.col(f"a.{n}"))
    mime, ct = at("_mimeType"), at("_contentType")
    codec_text = F.nullif(at("_codecs"), F.lit(""))
    known = lambda c: F.coalesce(c, F.lit("none")) != "none"

    def kind(p):
        mime = p["mime"]
        ct = F.coalesce(F.nullif(p["ct"], F.lit("")), F.substring_index(mime, "/", 1))
        told = lambda: let(vx.codecs(p["codecs"]), lambda cs: F.when(known(cs["vcodec"]), F.lit("video")).when(known(cs["acodec"]), F.lit("audio")))
        # Codecs are read only where nothing else tells the kind.
        return (F.when(ct.isin("video", "audio", "text"), ct).when(mime == "image/jpeg", mime)
                .otherwise(F.coalesce(told(), F.when((mime == "application/x-rawcc") | vx.mime_ext(mime).isin("tt", "dfxp", "ttml", "xml", "json"), F.lit("text")))))
    # All is worked out once per representation; what is filtered by it later is not worked out again for the filter.
    x = pack(base_url=F.col("b3"), period_duration=F.col("total"), mime_type=mime, content_type=let(pack(mime=mime, ct=ct, codecs=codec_text), kind), codecs=codec_text,
             rep_id=at("_id"), lang=at("_lang"), bandwidth=at("_bandwidth"), width=at("_width"), height=at("_height"), asr=at("_audioSamplingRate"),
             fps=at("_frameRate").try_cast("int"), filesize=F.try_element_at("r.BaseURL", F.lit(1))["_contentLength"],
             **{k: F.coalesce(c, F.lit(1)) if k in ("start_number", "timescale") else c for k, c in info.items()})
    out = r.select("manifest_id", F.col("url").alias("manifest_url"), "period", "set_no", "rep_no", x.alias("x"))
    # A generator would interpret the expression, so it gets the column that a compiled projection has made.
    out = out.select("manifest_id", "manifest_url", "period", "set_no", "rep_no", once(F.col("x")).alias("x"))
    out = out.select("manifest_id", "manifest_url", "period", "set_no", "rep_no", "x.*").filter(F.col("content_type").isNotNull())
    out = out.withColumn("cs", vx.codecs(F.col("codecs"))).drop("codecs")
    fragmented = F.col("urls").isNotNull() | F.col("media").isNotNull()
    fid = F.concat_ws("-", F.lit(mpd_id).cast("string"), F.col("rep_id")) if mpd_id else F.col("rep_id")
    storyboard = F.concat_ws("-", F.coalesce(F.col("rep_id"), F.col("content_type")), F.lit(mpd_id).cast("string"))
    return (out.withColumn("fragmented", fragmented)
            .withColumn("format_id", F.when(F.col("content_type") == "image/jpeg", storyboard).otherwise(fid))
            .withColumn("url", F.when(fragmented, F.col("manifest_url")).otherwise(F.col("base_url"))))


def dash_formats(manifests: DataFrame, mpd_id: str | None = None) -> DataFrame:
    """Video, audio and storyboard renditions (D07); ``manifest_stream_number`` counts per URL of a manifest."""
    r = representations(manifests, mpd_id).filter(F.col("content_type") != "text")
    image = F.col("content_type") == "image/jpeg"
    ext = vx.mime_ext(F.col("mime_type"))
    no = F.row_number().over(W.partitionBy("manifest_id", "url").orderBy("period", "set_no", "rep_no")) - 1
    plain = lambda c: F.when(~image, c)
    return r.select(
        "manifest_id", "period", "set_no", "rep_no", "format_id", "url", "manifest_url", F.when(image, F.lit("mhtml")).otherwise(ext).alias("ext"),
        plain(F.col("width")).alias("width"), plain(F.col("height")).alias("height"), plain(F.col("bandwidth") / 1000).alias("tbr"),
        plain(F.col("asr")).alias("asr"), plain(F.col("fps")).alias("fps"),
        plain(F.when(F.col("lang").isin("mul", "und", "zxx", "mis"), F.lit(None)).otherwise(F.col("lang"))).alias("language"),
        F.when(image, F.lit("DASH storyboards (jpeg)")).otherwise(F.concat(F.lit("DASH "), "content_type")).alias("format_note"),
        plain(F.col("filesize")).alias("filesize"), plain(F.concat(ext, F.lit("_dash"))).alias("container"),
        F.when(image, F.lit("none")).otherwise(F.col("cs.vcodec")).alias("vcodec"),
        F.when(image, F.lit("none")).otherwise(F.col("cs.acodec")).alias("acodec"),
        F.when(F.col("fragmented"), F.lit("http_dash_segments")).alias("protocol"), no.cast("int").alias("manifest_stream_number"))


def dash_subtitles(manifests: DataFrame) -> DataFrame:
    """Text representations by language."""
    r = representations(manifests).filter(F.col("content_type") == "text")
    return r.select("manifest_id", "period", "set_no", "rep_no", F.coalesce(F.nullif("lang", F.lit("")), F.lit("und")).alias("lang"),
                    vx.mime_ext(F.col("mime_type")).alias("ext"), "url", "filesize")


def template(text: Column, rep_id: Column, bandwidth: Column, number: Column | None = None, time: Column | None = None) -> Column:
    """Fill a segment template, with or without zero-padded widths."""
    out = F.replace(text, F.lit("$RepresentationID$"), rep_id)
    for name, value in (("Number", number), ("Bandwidth", bandwidth), ("Time", time)):
        if value is not None:
            out = let(pack(t=out, v=F.coalesce(value.cast("string"), F.lit(""))), _fill(name))
    return out


def _filled(df: DataFrame, col: str, number: Column, time: Column, timed: Column) -> DataFrame:
    """``template`` in steps of plain columns, which Spark compiles; a function over an array it would interpret. Rows that are not ``timed`` keep their ``$Time$``."""
    df = df.withColumns({col: F.replace(F.col(col), F.lit("$RepresentationID$"), F.col("rep_id")), "__number": number, "__time": time})
    for name, value in (("Number", "__number"), ("Bandwidth", "bandwidth"), ("Time", "__time")):
        full = _fill(name)({"t": F.col(col), "v": F.col("__v")})
        df = df.withColumn("__v", F.coalesce(F.col(value).cast("string"), F.lit("")))
        df = df.withColumn(col, F.when(timed, full).otherwise(F.col(col)) if name == "Time" else full)
    return df.drop("__v", "__number", "__time")


def _or_null(c: Column | None, kind: str) -> Column:
    return (F.lit(None) if c is None else c).cast(kind)


def _fill(name):
    def fill(p):
        text, shown = p["t"], p["v"]
        mark = rf"\${name}%(0?)(\d+)d\$"
        width = F.greatest(F.regexp_extract(text, mark, 2).try_cast("int"), F.length(shown))
        padded = F.lpad(shown, width, F.when(F.regexp_extract(text, mark, 1) == "0", F.lit("0")).otherwise(F.lit(" ")))
        plain = F.replace(text, F.lit(f"${name}$"), shown)
        return F.when(text.contains(f"${name}%"), F.regexp_replace(plain, F.lit(mark), padded)).otherwise(plain)
    return fill


def expand_template(df: DataFrame, col: str, out: str, number: str | None = None, time: str | None = None) -> DataFrame:
    """Fill templates of a table with ``rep_id`` and ``bandwidth`` columns."""
    opt = lambda n: F.col(n) if n else None
    return df.withColumn(out, template(F.col(col), F.col("rep_id"), F.col("bandwidth"), opt(number), opt(time)))


_KEY = ["manifest_id", "period", "set_no", "rep_no"]


_ENTRY = "struct<t:bigint,span:bigint,n:bigint,d:bigint>"


def _timeline(s: Column) -> Column:
    """Timeline entries as array<struct<start, d, again, before>>: a start of 0 or none continues at the end of the entry before."""
    again = lambda e: F.coalesce(e["_r"], F.lit(0))
    own = F.transform(s, lambda e: pack(t=F.when(e["_t"] != 0, e["_t"]), span=e["_d"] * (again(e) + 1), n=again(e) + 1, d=e["_d"]))
    sum_ = lambda a, b: F.coalesce(a + b, a, b)
    add = lambda x, y: pack(t=F.coalesce(y["t"], x["t"]), span=F.when(y["t"].isNotNull(), y["span"]).otherwise(sum_(x["span"], y["span"])), n=x["n"] + y["n"], d=y["d"])
    return let(own, lambda a: F.zip_with(a, scan(a, _ENTRY, add), lambda x, y: pack(
        start=F.coalesce(y["t"], F.lit(0)) + y["span"] - x["span"], d=x["d"], again=x["n"] - 1, before=y["n"] - x["n"])))


def dash_segments(manifests: DataFrame) -> DataFrame:
    """All segments of fragmented representations, initialisation (``seq`` 0) first.

    Within the row segments are only numbers, and addresses that the manifest states; templates are filled once segments are rows, by plain columns.
    """
    out = [*_KEY, "format_id", "seq", "location", "duration", "range"]
    row = lambda seq, at=None, dur=None, loc=None, rng=None: pack(
        seq=seq.cast("bigint"), at=_or_null(at, "bigint"), duration=_or_null(dur, "double"), location=_or_null(loc, "string"), range=_or_null(rng, "string"))
    # Everything comes from one reading of the XML, within the row: initialisation, numbered templates, lists, timelines.
    r = representations(manifests).filter("fragmented")
    rep, bw = F.col("rep_id"), F.col("bandwidth")
    name = F.coalesce(template(F.col("init_template"), rep, bw), F.col("init_url"), F.col("base_url"))
    init = F.when(F.coalesce("init_template", "init_url", "init_range").isNotNull(), F.array(row(F.lit(0), loc=name, rng=F.col("init_range"))))
    total = F.ceil(F.col("period_duration") / F.col("seg_len"))
    # A numbered template without a timeline has as many segments as fit the period.
    plain = F.when(total > 0, F.transform(F.sequence(F.lit(0).cast("bigint"), total - 1), lambda k: row(k + 1, dur=F.col("seg_len"))))
    # A list with ranges has only as many segments as there are ranges.
    pairs = F.when(F.col("ranges").isNotNull(), F.slice("urls", 1, F.least(F.size("urls"), F.size("ranges")))).otherwise(F.col("urls"))
    lists = F.transform(pairs, lambda u, k: row(k + 1, dur=F.col("seg_len"), loc=u, rng=F.try_element_at("ranges", k + 1)))

    def timeline(entries):
        # Entries with their place in time and in the order of segments. A timeline over listed URLs takes them in order.
        def segments(e):
            def segment(k):
                seq = e["before"] + k + 1
                return row(seq, e["start"] + k * e["d"], e["d"] / F.col("timescale"), F.when(F.col("urls").isNotNull(), F.get("urls", (seq - 1).cast("int"))))
            return F.transform(F.sequence(F.lit(0).cast("bigint"), e["again"]), segment)
        return F.flatten(F.transform(entries, segments))
    rest = F.when(F.col("s").isNull(), F.when(F.col("urls").isNotNull(), lists).otherwise(plain)).otherwise(let(_timeline(F.col("s")), timeline))
    empty = F.filter(F.array(row(F.lit(0))), lambda x: F.lit(False))
    r = r.withColumn("seg_len", F.col("segment_duration") / F.col("timescale")).withColumns({"listed": F.col("urls").isNotNull(), "timed": F.col("s").isNotNull()})
    keep = [*_KEY, "format_id", "listed", "timed", "media", "rep_id", "bandwidth", "start_number"]
    r = r.select(*keep, F.coalesce(init, empty).alias("init"), F.coalesce(rest, empty).alias("rest"))
    # Two arrays, not one: of a column alone Spark would ask the size first, and work it out twice.
    d = r.select(*keep, F.inline(F.concat("init", "rest")))
    stated = F.col("listed") | (F.col("seq") == 0)
    d = _filled(d.withColumn("text", F.when(~stated, F.col("media"))), "text", F.col("start_number") + F.col("seq") - 1, F.col("at"), F.col("timed"))
    d = d.withColumn("location", F.when(stated, F.col("location")).otherwise(F.col("text"))).select(*out)
    return d.withColumn("is_url", F.col("location").rlike("^https?://"))
