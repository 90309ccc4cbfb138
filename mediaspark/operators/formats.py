"""Rendition ranking and selection (family F), over ``formats(media_id, pos, ...)`` rows."""

from __future__ import annotations

from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from .. import skew
from ..functions import text as tx, urls as ux
from ..functions.core import let

# File types ordered from least to most wanted, with and without preferring free ones.
VIDEO_ORDER = {False: ["webm", "flv", "mp4"], True: ["flv", "mp4", "webm"]}
AUDIO_ORDER = {False: ["webm", "opus", "ogg", "mp3", "aac", "m4a"], True: ["aac", "mp3", "m4a", "webm", "ogg", "opus"]}
# Extensions that may be named in place of a rendition id.
NAMED_EXTS = ["mp4", "flv", "webm", "3gp", "m4a", "mp3", "ogg", "aac", "wav"]


def opt(df: DataFrame, name: str, kind: str = "double") -> Column:
    """The named column, or a null of the given type where the table lacks it."""
    return F.col(name) if name in df.columns else F.lit(None).cast(kind)


def _place(values, col: Column) -> Column:
    return (F.array_position(F.array(*[F.lit(v) for v in values]), F.coalesce(col, F.lit(""))) - 1).cast("int")


def is_none(codec: Column) -> Column:
    """True only for the mark 'none'; an unknown codec is not 'none'."""
    return codec.eqNullSafe(F.lit("none"))


def rank_key(df: DataFrame, prefer_free: bool = False, by=None) -> list[Column]:
    """Ascending sort columns, worst rendition first; ties go by original position."""
    if by is not None:
        keys = [F.coalesce(opt(df, c, "string"), F.lit("")) if c == "format_id" else F.coalesce(opt(df, c), F.lit(-1))
                for c in by]
        return keys + [F.col("pos")]
    # What the URL tells is worked out only for rows that do not say it themselves.
    given_ext, given_proto = opt(df, "ext", "string"), opt(df, "protocol", "string")
    ext = F.when(given_ext != "", given_ext).otherwise(let(F.col("url"), lambda u: ux.ext_of(u)))
    proto = F.when(given_proto != "", given_proto).otherwise(let(F.col("url"), lambda u: ux.protocol_of(F.lit(None), u)))
    no_video, no_audio = is_none(opt(df, "vcodec", "string")), is_none(opt(df, "acodec", "string"))
    given = F.coalesce(opt(df, "preference").cast("double"),
                       F.when(ext.isin("f4f", "f4m"), F.lit(-0.5)).otherwise(F.lit(0.0)))
    pref = given + F.when(no_video, F.lit(-50.0)).when(no_audio, F.lit(-40.0)).otherwise(F.lit(0.0))
    minus1 = lambda c: F.coalesce(c.cast("double"), F.lit(-1.0))
    known = lambda *names: [minus1(opt(df, n)) for n in names if n in df.columns]
    tbr = F.coalesce(opt(df, "tbr"), opt(df, "abr") + opt(df, "vbr"))
    return [pref, *known("language_preference", "quality"), minus1(tbr), *known("filesize", "vbr", "height", "width"),
            F.when(proto.isin("http", "https"), F.lit(0.0)).when(proto == "rtsp", F.lit(-0.5)).otherwise(F.lit(-0.1)),
            F.when(no_video, F.lit(0)).otherwise(_place(VIDEO_ORDER[prefer_free], ext)),
            *known("abr"),
            F.when(no_video, _place(AUDIO_ORDER[prefer_free], ext)).otherwise(F.lit(0)),
            *known("fps", "filesize_approx", "source_preference"),
            F.coalesce(opt(df, "format_id", "string"), F.lit("")), F.col("pos")]


def rank_formats(df: DataFrame, prefer_free: bool = False, by=None, hot_rows: int | None = None,
                 sizes: DataFrame | None = None) -> DataFrame:
    """Number the renditions of each item from worst (1) to best in ``rank``."""
    return skew.numbered(df, "media_id", rank_key(df, prefer_free, by), "rank", hot_rows, sizes)


def usable(df: DataFrame) -> DataFrame:
    """Drop renditions without a URL and repair the URLs of the others."""
    return df.filter(F.col("url").isNotNull() & (F.col("url") != "")).withColumn("url", ux.sanitize(F.col("url")))


def resolution_text(df: DataFrame) -> Column:
    w, h = opt(df, "width", "int").cast("int").cast("string"), opt(df, "height", "int").cast("int").cast("string")
    return (F.when(is_none(opt(df, "vcodec", "string")), F.lit("audio only"))
            .otherwise(F.coalesce(opt(df, "resolution", "string"), F.concat(w, F.lit("x"), h), F.concat(h, F.lit("p")),
                                  F.concat(w, F.lit("x?")), F.lit("unknown"))))


def prepare_formats(df: DataFrame, prefer_free: bool = False, hot_rows: int | None = None,
                    sizes: DataFrame | None = None) -> DataFrame:
    """Rank usable renditions and give every one a unique id, an extension, a protocol and a label.

    A missing id becomes the 0-based place in the ranked list; ids that occur more than once in an
    item get ``-0``, ``-1``, ... in ranked order. Both windows share one shuffle on the item.
    """
    df = usable(df)
    cold, warm = skew.split_hot(df, "media_id", hot_rows, sizes)
    key = rank_key(df, prefer_free)
    clean = F.regexp_replace("format_id", r"[\s,/+\[\]()]", "_")
    named = F.coalesce(F.nullif(clean, F.lit("")), (F.col("rank") - 1).cast("string"))

    def label(d, dup, n):
        return d.withColumn("format_id", F.when(n > 1, F.concat("__id", F.lit("-"), (dup - 1).cast("string")))
                            .otherwise(F.col("__id")))

    same = W.partitionBy("media_id", "__id")
    out = (cold.withColumn("rank", F.row_number().over(W.partitionBy("media_id").orderBy(*key)).cast("bigint"))
           .withColumn("__id", named))
    out = label(out.withColumn("__d", F.row_number().over(same.orderBy("rank")))
                .withColumn("__c", F.count(F.lit(1)).over(same)), F.col("__d"), F.col("__c"))
    if warm is not None:
        hot = skew.numbered(warm.drop("__n"), "media_id", key, "rank", hot_rows).withColumn("__id", named)
        hot = skew.numbered(hot, ["media_id", "__id"], [F.col("rank")], "__d", hot_rows)
        hot = skew.with_totals(hot, ["media_id", "__id"], {"__c": F.count(F.lit(1))})
        out = out.unionByName(label(hot, F.col("__d"), F.col("__c")))
    out = out.drop("__id", "__d", "__c")
    out = (out.withColumn("ext", F.coalesce(opt(df, "ext", "string"), let(F.col("url"), lambda u: F.lower(ux.ext_of(u)))))
           .withColumn("protocol", F.coalesce(opt(df, "protocol", "string"), let(F.col("url"), lambda u: ux.protocol_of(F.lit(None), u)))))
    note = F.coalesce(F.concat(F.lit(" ("), opt(df, "format_note", "string"), F.lit(")")), F.lit(""))
    text = F.concat("format_id", F.lit(" - "), resolution_text(out), note)
    return out.withColumn("format", F.coalesce(opt(df, "format", "string"), text))


def dedupe_formats(df: DataFrame) -> DataFrame:
    """Keep the first rendition of each URL of an item."""
    return skew.first_per_group(df, ["media_id", "url"], [F.col("pos")], df.columns).select(*df.columns)


_OPS = {"<": Column.__lt__, "<=": Column.__le__, ">": Column.__gt__, ">=": Column.__ge__,
        "=": Column.__eq__, "!=": Column.__ne__}


def cmp(col, op: str, value, or_null: bool = False) -> Column:
    """Numeric predicate that rejects null unless told otherwise."""
    c = F.col(col) if isinstance(col, str) else col
    return F.coalesce(_OPS[op](c, F.lit(value)), F.lit(or_null))


def str_cmp(col, op: str, value: str, negate: bool = False, or_null: bool = False) -> Column:
    """String predicate ``=``, ``^=``, ``$=`` or ``*=``, possibly negated."""
    c = F.col(col) if isinstance(col, str) else col
    p = {"=": c == value, "^=": c.startswith(value), "$=": c.endswith(value), "*=": c.contains(value)}[op]
    return F.coalesce(~p if negate else p, F.lit(or_null))


def size_bounds(df: DataFrame, lo=None, hi=None) -> DataFrame:
    """Reject renditions known to be smaller or larger than the bounds; unknown size passes."""
    ok = F.lit(True)
    if lo is not None:
        ok = ok & F.coalesce(F.col("filesize") >= lo, F.lit(True))
    if hi is not None:
        ok = ok & F.coalesce(F.col("filesize") <= hi, F.lit(True))
    return df.filter(ok)


def incomplete_flags(df: DataFrame) -> DataFrame:
    """(media_id, incomplete): true where all renditions are video-only, or all are audio-only (F16)."""
    v, a = is_none(F.col("vcodec")), is_none(F.col("acodec"))
    return df.groupBy("media_id").agg((F.bool_and(~v & a) | F.bool_and(v & ~a)).alias("incomplete"))


def flag_incomplete(df: DataFrame) -> DataFrame:
    v, a = is_none(F.col("vcodec")), is_none(F.col("acodec"))
    return skew.with_totals(df, "media_id", {"incomplete": F.bool_and(~v & a) | F.bool_and(v & ~a)})


# --- selectors ----------------------------------------------------------------------------------

@dataclass(frozen=True)
class Selector:
    """A selector tree. Leaves with one pick per item are evaluated by a single aggregate."""
    kind: str
    args: tuple = ()
    last: bool = True
    want: str = ""
    container: str | None = None
    preds: tuple = field(default=(), compare=False)


def best() -> Selector:
    return Selector("combined", last=True)


def worst() -> Selector:
    return Selector("combined", last=False)


def best_audio() -> Selector:
    return Selector("only", want="vcodec", last=True)


def worst_audio() -> Selector:
    return Selector("only", want="vcodec", last=False)


def best_video() -> Selector:
    return Selector("only", want="acodec", last=True)


def worst_video() -> Selector:
    return Selector("only", want="acodec", last=False)


def by_ext(ext: str) -> Selector:
    return Selector("equal", want="ext", args=(ext,))


def by_id(format_id: str) -> Selector:
    return Selector("equal", want="format_id", args=(format_id,))


def named(name: str) -> Selector:
    """By extension if ``name`` is a known one, else by rendition id."""
    return by_ext(name) if name in NAMED_EXTS else by_id(name)


def all_formats() -> Selector:
    return Selector("all")


def prefer(*alts: Selector) -> Selector:
    """The first alternative that gives something, decided per item."""
    return Selector("prefer", args=alts)


def each(*parts: Selector) -> Selector:
    """All parts, in order, duplicates kept."""
    return Selector("each", args=parts)


def where(sel: Selector, *preds: Column) -> Selector:
    """Narrow the candidates before the inner selection."""
    return Selector("where", args=(sel,), preds=preds)


def merge(video: Selector, audio: Selector, container: str | None = None) -> Selector:
    """Product of video picks and audio picks."""
    return Selector("merge", args=(video, audio), container=container)


PICK = ["format_id", "ext", "vcodec", "acodec", "tbr", "height", "filesize", "url"]
_EXTRA = ["error", "parts", "part_exts", "part_urls"]
# Fields that a merged pick takes from its video part, even when they are null there.
_FROM_VIDEO = ["width", "height", "resolution", "fps", "vcodec", "vbr", "stretched_ratio"]


def _uses_all(s: Selector) -> bool:
    return s.kind == "all" or any(isinstance(a, Selector) and _uses_all(a) for a in s.args)


def _single(fields):
    one = [F.col(c) for c in fields]
    none = F.lit(None).cast("string")
    strings = F.lit(None).cast("array<string>")
    return F.struct(*one, none.alias("error"), F.lit(1).alias("parts"), strings.alias("part_exts"),
                    strings.alias("part_urls"))


def _merged(v: Column, a: Column, fields, container) -> Column:
    """One merged rendition, or an error mark if the two do not go together."""
    reason = (F.when(is_none(v["vcodec"]), F.lit("the first format must contain the video"))
              .when(is_none(v["acodec"]) & is_none(a["acodec"]), F.lit("both formats are video-only")))
    take = []
    for c in fields:
        if c == "format_id":
            value = F.concat(v["format_id"], F.lit("+"), a["format_id"])
        elif c == "ext":
            value = F.lit(container) if container else v["ext"]
        elif c in _FROM_VIDEO:
            value = v[c]
        elif c in ("acodec", "abr"):
            value = a[c]
        else:
            value = F.when(F.lit(False), v[c])
        take.append(value.alias(c))
    pair = lambda x, y: F.when(reason.isNull(), F.array(x, y))
    return F.struct(*take, reason.alias("error"), F.lit(2).alias("parts"), pair(v["ext"], a["ext"]).alias("part_exts"),
                    pair(v["url"], a["url"]).alias("part_urls"))


class _Leaves:
    """Collects the aggregates that the leaves of one tree need."""

    def __init__(self, fields):
        self.fields, self.aggs = fields, {}

    def add(self, expr: Column) -> Column:
        name = f"__p{len(self.aggs)}"
        self.aggs[name] = expr
        return F.col(name)

    def pick(self, cond: Column, last: bool) -> Column:
        arg = F.max_by if last else F.min_by
        return self.add(arg(_single(self.fields), F.when(cond, F.col("rank"))))

    def build(self, s: Selector, cond: Column) -> Column:
        """Array of the picks of ``s``; ``cond`` holds the filters around it."""
        one = lambda c: F.when(c.isNotNull(), F.array(c)).otherwise(F.filter(F.array(c), lambda x: F.lit(False)))
        if s.kind == "combined":
            both = ~is_none(F.col("vcodec")) & ~is_none(F.col("acodec"))
            p, any_ = self.pick(cond & both, s.last), self.pick(cond, s.last)
            return one(F.coalesce(p, F.when(F.col("incomplete"), any_)))
        if s.kind == "only":
            return one(self.pick(cond & is_none(F.col(s.want)), s.last))
        if s.kind == "equal":
            return one(self.pick(cond & F.coalesce(F.col(s.want) == s.args[0], F.lit(False)), True))
        if s.kind == "where":
            return self.build(s.args[0], reduce(lambda x, y: x & y, s.preds, cond))
        parts = [self.build(a, cond) for a in s.args]
        if s.kind == "prefer":
            return reduce(lambda rest, p: F.when(F.size(p) > 0, p).otherwise(rest), reversed(parts[:-1]), parts[-1])
        if s.kind == "each":
            return F.concat(*parts)
        if s.kind == "merge":
            v, a = parts
            return F.flatten(F.transform(v, lambda x: F.transform(
                a, lambda y: _merged(x, y, self.fields, s.container))))
        raise ValueError(s.kind)


def _eval(df: DataFrame, flags: DataFrame, s: Selector, cond: Column, fields) -> DataFrame:
    """(media_id, ord array, pick) rows of a tree; parts with ``all`` stay row-wise, the rest aggregates."""
    if not _uses_all(s):
        leaves = _Leaves(fields)
        picks = leaves.build(s, cond)
        v, a = is_none(F.col("vcodec")), is_none(F.col("acodec"))
        inc = (F.bool_and(~v & a) | F.bool_and(v & ~a)).alias("incomplete")
        per_item = df.groupBy("media_id").agg(inc, *[e.alias(n) for n, e in leaves.aggs.items()])
        out = per_item.select("media_id", F.posexplode(picks).alias("__i", "__pick"))
        return out.select("media_id", F.array(F.col("__i").cast("bigint")).alias("__ord"), "__pick")
    if s.kind == "all":
        return df.filter(cond).select("media_id", F.array(F.col("rank")).alias("__ord"), _single(fields).alias("__pick"))
    if s.kind == "where":
        return _eval(df, flags, s.args[0], reduce(lambda x, y: x & y, s.preds, cond), fields)
    parts = [_eval(df, flags, a, cond, fields) for a in s.args]
    if s.kind == "each":
        tag = lambda i, d: d.withColumn("__ord", F.concat(F.array(F.lit(i).cast("bigint")), F.col("__ord")))
        return reduce(DataFrame.unionByName, [tag(i, d) for i, d in enumerate(parts)])
    if s.kind == "prefer":
        out = parts[0]
        for nxt in parts[1:]:
            out = out.unionByName(nxt.join(out.select("media_id").distinct(), "media_id", "left_anti"))
        return out
    if s.kind == "merge":
        v, a = parts[0], parts[1].select("media_id", F.col("__ord").alias("__ord2"), F.col("__pick").alias("__pick2"))
        both = v.join(a, "media_id")
        return both.select("media_id", F.concat("__ord", "__ord2").alias("__ord"),
                           _merged(F.col("__pick"), F.col("__pick2"), fields, s.container).alias("__pick"))
    raise ValueError(s.kind)


def select_formats(df: DataFrame, selector: Selector, fields=None) -> DataFrame:
    """Apply a selector per item to prepared, ranked rows.

    Without ``all_formats`` in the tree this is one aggregate on the item (arg-max per leaf, combined
    on the map side), whatever the number of alternatives, so a hot item costs no more than others.
    Result: ``media_id, ord`` (1-based order of the picks of an item) and the pick's fields.
    """
    fields = [c for c in (fields or PICK) if c in df.columns]
    out = _eval(df, None, selector, F.lit(True), fields)
    if _uses_all(selector):
        out = skew.numbered(out, "media_id", [F.col("__ord")], "ord", sizes=df)
    else:
        out = out.withColumn("ord", F.element_at("__ord", 1) + 1)
    return out.select("media_id", "ord", *[F.col(f"__pick.{c}").alias(c) for c in [*fields, *_EXTRA]])


# Extensions that can share one container without remuxing to mkv. The last member is
# one text, so membership in it is a substring test (an ``m`` or ``web`` would count as well).
SAME_FAMILY = ["mp3", "mp4", "m4a", "m4p", "m4b", "m4r", "m4v", "ismv", "isma"]
SAME_TEXT = "webm"


def merged_container(df: DataFrame) -> DataFrame:
    """Container of merged picks: the video's own, or mkv where the parts do not fit it."""
    v, a = F.col("part_exts")[0], F.col("part_exts")[1]
    given = (v != "") & (a != "")
    fits = (v.isin(SAME_FAMILY) & a.isin(SAME_FAMILY)) | (F.lit(SAME_TEXT).contains(v) & F.lit(SAME_TEXT).contains(a))
    out = (F.when(F.col("parts") != 2, F.col("ext")).when(F.coalesce(given & fits, F.lit(False)), F.col("ext"))
           .otherwise(F.lit("mkv")))
    return df.withColumn("container_ext", F.when(F.col("error").isNull(), out))


def default_selection(df: DataFrame, media: DataFrame, can_merge: bool = True, to_stdout: bool = False,
                      fields=None) -> DataFrame:
    """Merged best else best; the other way round for live items, stdout output or without a merger."""
    merged_first = prefer(merge(best_video(), best_audio()), best())
    best_first = prefer(best(), merge(best_video(), best_audio()))
    if to_stdout or not can_merge:
        return select_formats(df, best_first, fields)
    fields = [c for c in (fields or PICK) if c in df.columns]
    leaves = _Leaves(fields)
    a, b = leaves.build(merged_first, F.lit(True)), leaves.build(best_first, F.lit(True))
    v, s = is_none(F.col("vcodec")), is_none(F.col("acodec"))
    inc = (F.bool_and(~v & s) | F.bool_and(v & ~s)).alias("incomplete")
    per_item = df.groupBy("media_id").agg(inc, *[e.alias(n) for n, e in leaves.aggs.items()])
    live = media.select("media_id", "is_live")
    picked = per_item.join(live, "media_id", "left").select(
        "media_id", F.posexplode(F.when(F.col("is_live"), b).otherwise(a)).alias("__i", "__pick"))
    return picked.select("media_id", (F.col("__i") + 1).cast("bigint").alias("ord"),
                         *[F.col(f"__pick.{c}").alias(c) for c in [*fields, *_EXTRA]])


def unselected(media: DataFrame, picks: DataFrame) -> DataFrame:
    """Items for which nothing was picked."""
    return (media.join(picks.select("media_id"), "media_id", "left_anti")
            .withColumn("reason", F.lit("requested format not available")))


def apply_selection(media: DataFrame, picks: DataFrame) -> DataFrame:
    """Put the fields of the last pick onto its item.

    A field that the pick carries overrides the item's; a merged pick overrides the fields it lists
    even with null.
    """
    fields = [c for c in picks.columns if c not in ("media_id", "ord", *_EXTRA)]
    listed = {"format_id", "ext", "acodec", "abr", *_FROM_VIDEO}
    good = picks.filter(F.col("error").isNull())
    last = good.groupBy("media_id").agg(
        F.max_by(F.struct(*[F.col(c) for c in picks.columns if c != "media_id"]), "ord").alias("__p"))
    out = media.join(last, "media_id", "left")
    cols = []
    for c in fields:
        p = F.col(f"__p.{c}")
        if c not in media.columns:
            value = p
        elif c in listed:
            value = F.when(F.col("__p.parts") == 2, p).otherwise(F.coalesce(p, media[c]))
        else:
            value = F.coalesce(p, media[c])
        cols.append(value.alias(c))
    rest = [media[c] for c in media.columns if c not in fields]
    return out.select(*rest, *cols, F.col("__p.part_urls").alias("part_urls"))


def _codec_text(df, codec, other, alone):
    short = F.substring_index(codec, ".", 4)
    return (F.when(codec.isNull() | (codec == ""), F.lit("unknown")).when(~is_none(codec), short)
            .when(is_none(other), F.lit(None)).otherwise(F.lit(alone)))


def note_text(df: DataFrame) -> Column:
    """The descriptive note of a rendition listing."""
    whole = lambda c: F.when(c >= 0, F.floor(c)).otherwise(F.ceil(c)).cast("bigint")
    s = lambda n: opt(df, n, "string")
    skip = F.lit(None).cast("string")
    filled = lambda c, t: F.when(c.isNotNull() & (c.cast("string") != "") & (c.cast("string") != "0"), t).otherwise(skip)
    have = lambda c, t: F.when(c.isNotNull(), t).otherwise(skip)
    tbr, vbr, abr = opt(df, "tbr"), opt(df, "vbr"), opt(df, "abr")
    padded = lambda c, n: F.lpad(whole(c).cast("string"), F.greatest(F.lit(n), F.length(whole(c).cast("string"))), F.lit(" "))
    head = F.concat_ws(" ", F.when(s("ext").isin("f4f", "f4m"), F.lit("(unsupported)")),
                       filled(s("language"), F.concat(F.lit("["), s("language"), F.lit("]"))),
                       F.nullif(s("format_note"), F.lit("")), have(tbr, F.concat(padded(tbr, 4), F.lit("k"))))
    vcodec, acodec = s("vcodec"), s("acodec")
    known_v = vcodec.isNotNull() & ~is_none(vcodec)
    vtext = F.when(known_v, F.concat(_codec_text(df, vcodec, acodec, "audio only"),
                                     F.when(vbr.isNotNull(), F.lit("@")).otherwise(F.lit("")))) \
        .when(vbr.isNotNull() & abr.isNotNull(), F.lit("video@"))
    video = F.concat(F.coalesce(vtext, F.lit("")), F.coalesce(have(vbr, F.concat(padded(vbr, 4), F.lit("k"))), F.lit("")))
    atext = F.when(acodec.isNotNull(), _codec_text(df, acodec, vcodec, "video only")).when(abr.isNotNull(), F.lit("audio"))
    atext = F.concat(atext, F.when(F.coalesce(abr, F.lit(0.0)) != 0, F.concat(F.lit("@"), padded(abr, 3), F.lit("k")))
                     .otherwise(F.lit("")))
    asr = opt(df, "asr")
    audio = F.concat_ws(" ", F.rpad(atext, F.greatest(F.lit(4), F.length(atext)), F.lit(" ")),
                        F.when(F.coalesce(asr, F.lit(0.0)) != 0, F.concat(F.lit("("), padded(asr, 5), F.lit("Hz)"))))
    size, approx = opt(df, "filesize", "bigint"), opt(df, "filesize_approx", "bigint")
    fps = opt(df, "fps").cast("string")
    return F.concat_ws(
        ", ", F.nullif(head, F.lit("")), have(s("container"), F.concat(s("container"), F.lit(" container"))),
        F.nullif(video, F.lit("")), have(fps, F.concat(fps, F.lit("fps"))),
        F.when(atext.isNotNull(), audio),
        F.coalesce(have(size, tx.human_bytes(size)), have(approx, F.concat(F.lit("~"), tx.human_bytes(approx)))))


def list_formats(df: DataFrame, sizes: DataFrame | None = None, hot_rows: int | None = None) -> DataFrame:
    """Listing rows of ranked renditions; the last shown one is marked when there are several.

    ``sizes`` may name the table that the ranked rows come from (``skew.split_hot``); the ranking is then worked out once.
    """
    keep = opt(df, "preference").isNull() | (opt(df, "preference") >= -1000)
    out = skew.with_totals(df, "media_id", {"__top": F.max(F.when(keep, F.col("rank"))), "__all": F.count(F.lit(1))}, sizes, hot_rows).filter(keep)
    note = note_text(df)
    mark = (F.col("rank") == F.col("__top")) & (F.col("__all") > 1)
    note = F.when(mark, F.concat(note, F.when(note != "", F.lit(" ")).otherwise(F.lit("")), F.lit("(best)"))).otherwise(note)
    return out.select("media_id", "rank", "format_id", "ext", resolution_text(df).alias("resolution"), note.alias("note"))
