"""HLS playlists into renditions and segments (D01–D06), over ``manifests(manifest_id, url, body)``.

A manifest is one row and all work on it happens within the row, in time n log n of its lines.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from ..functions import urls as ux, values as vx
from ..functions.core import let, once, pack, scan

_ATTR = r'([A-Z0-9-]+)=("[^"]+"|[^",]+)(?:,|$)'
_CUT = "\u0001"


def attributes(line: Column) -> Column:
    """Attribute list of a tag line as array<struct<k, v>>; quoted values may hold commas."""
    keys = F.regexp_extract_all(line, F.lit(_ATTR), F.lit(1))
    vals = F.regexp_extract_all(line, F.lit(_ATTR), F.lit(2))
    bare = lambda v: F.when(v.startswith('"'), F.substring(v, F.lit(2), F.length(v) - 2)).otherwise(v)
    return F.zip_with(keys, vals, lambda k, v: F.struct(k.alias("k"), bare(v).alias("v")))


def hls_attributes(df: DataFrame, col: str, out: str = "attributes") -> DataFrame:
    """Attribute list of a tag line as a map; of repeated keys the last counts."""
    def as_map(a):
        keys = F.array_distinct(F.transform(a, lambda x: x["k"]))
        return F.map_from_arrays(keys, F.transform(keys, lambda k: F.element_at(F.filter(a, lambda x: x["k"] == k), -1)["v"]))
    return df.withColumn(out, let(attributes(F.col(col)), as_map))


def value(attrs: Column, key: str) -> Column:
    """Value of an attribute; the pattern admits no empty ones."""
    return F.try_element_at(F.filter(attrs, lambda a: a["k"] == key), F.lit(-1))["v"]


def _lines(body: Column) -> Column:
    return F.split(body, r"\r\n|\r|\n")


def _blocks(body: Column) -> Column:
    """Text cut after every URI line: each block is the tags before a URI, then the URI."""
    plain = F.regexp_replace(body, r"\r\n?", "\n")
    marked = F.regexp_replace(plain, r"(?m)^([^#\S\n]*[^#\s][^\n]*)$", "$1" + _CUT)
    return F.filter(F.split(marked, _CUT), lambda b: b.rlike(r"(?m)^[^#\S\n]*[^#\s][^\n]*\z"))


_ROW = ("array<struct<kind:string,format_id:string,url:string,tbr:double,fps:double,width:int,height:int,vbr:double,abr:double,"
        "vcodec:string,acodec:string,dynamic_range:string,language:string,protocol:string>>")


def _row(**cols) -> Column:
    names = [("kind", "string"), ("format_id", "string"), ("url", "string"), ("tbr", "double"), ("fps", "double"),
             ("width", "int"), ("height", "int"), ("vbr", "double"), ("abr", "double"), ("vcodec", "string"),
             ("acodec", "string"), ("dynamic_range", "string"), ("language", "string"), ("protocol", "string")]
    return F.struct(*[cols.get(n, F.lit(None)).cast(k).alias(n) for n, k in names])


def _join_id(*parts) -> Column:
    return F.concat_ws("-", *[F.nullif(p, F.lit("")) for p in parts])


def hls_variants(manifests: DataFrame, m3u8_id: str | None = None, ext: str | None = "mp4", live: bool = False,
                 entry_protocol: str = "m3u8") -> DataFrame:
    """Renditions of HLS playlists (D01–D03), worked out within each row.

    Rendition tags with a URI come first, then one row per URI line with the stream tag before it; an
    audio group whose first member has a URI takes the audio out of its video streams. A media playlist
    gives itself, a protected one nothing.
    """
    prefix = F.lit(m3u8_id).cast("string")
    body, base = F.col("body"), F.col("url")
    full = lambda u: F.when(u.rlike("^https?://"), u).otherwise(F.coalesce(ux.resolve(base, u), u))
    media = F.transform(F.filter(_lines(body), lambda l: l.startswith("#EXT-X-MEDIA:")), attributes)
    media = F.transform(media, lambda a: F.struct(
        *[value(a, k).alias(n) for k, n in (("TYPE", "type"), ("GROUP-ID", "grp"), ("NAME", "name"), ("URI", "uri"), ("LANGUAGE", "lang"))]))
    media = F.filter(media, lambda m: m["type"].isNotNull() & m["grp"].isNotNull() & m["name"].isNotNull())
    # The stream tag in force at a URI line is the last one since the previous URI line.
    blocks = F.transform(_blocks(body), lambda b: F.struct(
        F.trim(F.substring_index(b, "\n", -1)).alias("uri"),
        attributes(F.regexp_extract(b, r"(?s)^(?:.*\n)?#EXT-X-STREAM-INF:([^\n]*)", 1)).alias("a")))
    keys = ["NAME", "VIDEO", "AUDIO", "CODECS", "RESOLUTION", "FRAME-RATE", "PROGRESSIVE-URI"]
    tag = lambda k: k.lower().replace("-", "_")
    blocks = F.transform(blocks, lambda b: F.struct(
        b["uri"].alias("uri"), *[value(b["a"], k).alias(tag(k)) for k in keys],
        (F.coalesce(value(b["a"], "AVERAGE-BANDWIDTH"), value(b["a"], "BANDWIDTH")).try_cast("double") / 1000).alias("tbr"),
        vx.codecs(value(b["a"], "CODECS")).alias("cs")))
    work = manifests.select(
        "manifest_id", "url", media.alias("m"), blocks.alias("b"),
        body.contains("#EXT-X-TARGETDURATION").alias("is_media"),
        (body.contains("#EXT-X-FAXS-CM:") | body.rlike(r'#EXT-X-SESSION-KEY:.*?URI="skd://')).alias("locked"))
    work = work.filter(~F.col("locked"))
    m, b, tracks = F.col("m"), F.col("b"), F.col("tracks")
    made = F.transform(F.filter(m, lambda x: x["type"].isin("VIDEO", "AUDIO") & x["uri"].isNotNull()), lambda x: _row(
        kind=F.lit("media"), format_id=_join_id(prefix, x["grp"], x["name"]), url=full(x["uri"]), language=x["lang"],
        protocol=F.lit(entry_protocol), vcodec=F.when(x["type"] == "AUDIO", F.lit("none"))))
    work = work.withColumn("tracks", made)
    # The first member of each group (of equal keys the last one counts), and the progressive twins up to each stream.
    work = work.withColumns({"first": F.map_from_arrays(F.transform(F.reverse(m), lambda x: x["grp"]), F.reverse(m)),
                             "twins": scan(F.transform(b, lambda x: F.when(x["progressive_uri"].isNotNull(), 1).otherwise(0)), "int", lambda x, y: x + y)})
    group = lambda g: F.try_element_at(F.col("first"), g)
    usp = r"audio.*?(?:%3D|=)(\d+)(?:-video.*?(?:%3D|=)(\d+))?"

    def stream(x, i):
        return let(pack(x=x, i=i, url=full(x["uri"])), rows_of)

    def rows_of(p):
        x, i, url = p["x"], p["i"], p["url"]
        # Rows before this one: the tracks, the earlier streams and their progressive twins.
        before = F.size(tracks) + i + F.get("twins", i) - F.when(x["progressive_uri"].isNotNull(), 1).otherwise(0)
        # A named rendition group gives its first member's name, an unknown one its own.
        name = F.coalesce(x["name"], F.when(x["video"].isNotNull(), F.coalesce(group(x["video"])["name"], x["video"])))
        number = F.when(F.coalesce(x["tbr"], F.lit(0.0)) != 0, x["tbr"].cast("bigint")).otherwise(before).cast("string")
        fid = _join_id(prefix) if live else F.concat_ws("-", prefix, F.coalesce(name, number))
        known = x["cs"]["vcodec"].isNotNull()
        drop_audio = x["audio"].isNotNull() & known & (x["cs"]["vcodec"] != "none") & group(x["audio"])["uri"].isNotNull()
        abr = F.nullif(F.regexp_extract(url, usp, 1), F.lit("")).try_cast("double") / 1000
        vbr = F.nullif(F.regexp_extract(url, usp, 2), F.lit("")).try_cast("double") / 1000
        size = r"(\d+)[xX](\d+)"
        row = dict(kind=F.lit("stream"), format_id=fid, url=url, tbr=x["tbr"], fps=x["frame_rate"].try_cast("double"),
                   width=ux.hit(x["resolution"], size, 1).try_cast("int"), height=ux.hit(x["resolution"], size, 2).try_cast("int"),
                   vbr=vbr, abr=abr, vcodec=x["cs"]["vcodec"], acodec=F.when(drop_audio, F.lit("none")).otherwise(x["cs"]["acodec"]),
                   dynamic_range=x["cs"]["dynamic_range"], protocol=F.lit(entry_protocol))
        twin = dict(row, kind=F.lit("progressive"), format_id=F.replace(fid, F.lit("hls-"), F.lit("http-")),
                    protocol=F.lit("http"), url=x["progressive_uri"])
        return F.when(x["progressive_uri"].isNotNull(), F.array(_row(**row), _row(**twin))).otherwise(F.array(_row(**row)))
    itself = F.array(_row(kind=F.lit("playlist"), format_id=prefix, url=base, protocol=F.lit(entry_protocol)))
    rows = F.when(F.col("is_media"), itself).otherwise(F.concat(tracks, F.flatten(F.transform(b, stream))))
    out = work.select("manifest_id", F.col("url").alias("manifest_url"), F.posexplode(rows).alias("pos", "f"))
    return out.select("manifest_id", "pos", "f.*", F.when(F.col("f.kind") != "playlist", F.col("manifest_url")).alias("manifest_url"),
                      F.lit(ext).cast("string").alias("ext"))


_MARK = "struct<uri:string,key:struct<method:string,uri:string,iv:string>,ad:boolean,seq:bigint,at:bigint,len:bigint>"
_SUMS = "struct<seq:bigint,kept:bigint,at:bigint,total:bigint,len:bigint>"


def _marks(body: Column) -> Column:
    """The lines of a media playlist that matter, in order: URIs, and the tags that hold for the URIs behind them."""
    def read(l):
        spec = F.when(l.startswith("#EXT-X-BYTERANGE"), F.substring(l, F.lit(18), F.length(l)))
        ad_on = (l.startswith("#ANVATO-SEGMENT-INFO") & l.contains("type=ad")) | (l.startswith("#UPLYNK-SEGMENT") & l.endswith(",ad"))
        ad_off = (l.startswith("#ANVATO-SEGMENT-INFO") & l.contains("type=master")) | (l.startswith("#UPLYNK-SEGMENT") & l.endswith(",segment"))
        key = lambda a: pack(method=value(a, "METHOD"), uri=value(a, "URI"), iv=value(a, "IV"))
        return pack(uri=F.when(~l.startswith("#"), l), key=F.when(l.startswith("#EXT-X-KEY"), let(attributes(F.substring(l, F.lit(12), F.length(l))), key)),
                    ad=F.when(ad_on, True).when(ad_off, False),
                    seq=F.when(l.startswith("#EXT-X-MEDIA-SEQUENCE"), F.substring(l, F.lit(23), F.length(l)).try_cast("bigint")),
                    at=F.when(spec.contains("@"), F.substring_index(spec, "@", -1)).try_cast("bigint"),
                    len=F.substring_index(spec, "@", 1).try_cast("bigint"))
    lines = F.filter(F.transform(_lines(body), lambda l: F.trim(l)), lambda l: l.rlike(r"^(?:[^#]|#EXT-X-(?:KEY|MEDIA-SEQUENCE|BYTERANGE)|#ANVATO-SEGMENT-INFO|#UPLYNK-SEGMENT)"))
    # The key and the ad span in force are the last ones told.
    latest = lambda x, y: pack(uri=y["uri"], key=F.coalesce(y["key"], x["key"]), ad=F.coalesce(y["ad"], x["ad"]), seq=y["seq"], at=y["at"], len=y["len"])
    return scan(F.transform(lines, read), _MARK, latest)


def _kept(m: Column) -> Column:
    return m["uri"].isNotNull() & ~F.coalesce(m["ad"], F.lit(False))


def hls_segments(manifests: DataFrame) -> DataFrame:
    """Media segments of HLS playlists (D05): number, key in force, byte range; ad spans are left out.

    A byte range without a start continues at the end of the previous range. All is worked out within the row, as running values over the lines.
    """
    add = lambda a, b: F.coalesce(a + b, a, b)

    def total(x, y):
        # Segments since the last media sequence tag; bytes since the last range with a start.
        seq, at = y["seq"].isNotNull(), y["at"].isNotNull()
        return pack(seq=F.coalesce(y["seq"], x["seq"]), kept=F.when(seq, y["kept"]).otherwise(x["kept"] + y["kept"]),
                    at=F.coalesce(y["at"], x["at"]), total=F.when(at, y["total"]).otherwise(add(x["total"], y["total"])), len=F.coalesce(y["len"], x["len"]))

    def numbered(marks):
        sums = F.transform(marks, lambda m: pack(seq=m["seq"], kept=F.when(_kept(m), 1).otherwise(0), at=m["at"], total=m["len"], len=m["len"]))
        both = F.zip_with(marks, scan(sums, _SUMS, total), lambda m, s: pack(m=m, s=s))
        return F.filter(both, lambda x: _kept(x["m"]))
    d = manifests.select("manifest_id", F.col("url").alias("base"), F.posexplode(let(_marks(F.col("body")), numbered)).alias("pos", "x"))
    m, s, key = F.col("x.m"), F.col("x.s"), F.col("x.m.key")
    aes = key["method"] == "AES-128"
    full = lambda u: F.when(u.rlike("^https?://"), u).otherwise(F.coalesce(ux.resolve(F.col("base"), u), u))
    stop = F.when(s["len"].isNotNull(), F.coalesce(s["at"], F.lit(0)) + s["total"])
    return d.select("manifest_id", (F.col("pos") + 1).cast("bigint").alias("frag_index"), (F.coalesce(s["seq"], F.lit(0)) + s["kept"] - 1).alias("media_sequence"),
                    full(m["uri"]).alias("url"), F.coalesce(key["method"], F.lit("NONE")).alias("key_method"), F.when(aes, full(key["uri"])).alias("key_url"),
                    F.when(aes, key["iv"]).alias("key_iv"), (stop - s["len"]).alias("range_start"), stop.alias("range_end"))


def hls_counts(manifests: DataFrame) -> DataFrame:
    """Numbers of media and ad segments per playlist."""
    def counts(marks):
        return pack(media_frags=F.size(F.filter(marks, _kept)), n=F.size(F.filter(marks, lambda m: m["uri"].isNotNull())))
    d = manifests.select("manifest_id", once(let(_marks(F.col("body")), counts)).alias("c"))
    return d.select("manifest_id", F.col("c.media_frags").cast("bigint").alias("media_frags"), (F.col("c.n") - F.col("c.media_frags")).cast("bigint").alias("ad_frags"))


def hls_supported(manifests: DataFrame, can_decrypt: bool = True) -> DataFrame:
    """Why a playlist cannot be taken segment by segment, null if it can."""
    b = F.col("body")
    aes = b.contains("#EXT-X-KEY:METHOD=AES-128")
    live = F.col("is_live") if "is_live" in manifests.columns else F.lit(False)
    reason = (F.when(b.rlike(r"#EXT-X-KEY:METHOD=(?!NONE|AES-128)"), F.lit("key method")).when(b.contains("#EXT-X-MAP:"), F.lit("media map"))
              .when(aes & F.lit(not can_decrypt), F.lit("no decryption")).when(aes & b.contains("#EXT-X-BYTERANGE"), F.lit("encrypted byte ranges"))
              .when(F.coalesce(live, F.lit(False)), F.lit("live")))
    return manifests.withColumn("unsupported", reason)
