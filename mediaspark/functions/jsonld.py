"""Linked-data blocks of a page as one record."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from . import values as vx
from .text import unescape
from .urls import valid
from .core import let

_BLOCK = r"""(?is)<script[^>]+type=(["']?)application/ld\+json\1[^>]*>(.+?)</script>"""
# Interaction types and the counters they stand for.
COUNTERS = {"CommentAction": "comment", "AgreeAction": "like", "DisagreeAction": "dislike", "LikeAction": "like",
            "DislikeAction": "dislike", "ListenAction": "view", "WatchAction": "view", "ViewAction": "view"}
EPISODE, ARTICLE = ["TVEpisode", "Episode"], ["Article", "NewsArticle"]
SEASON, SERIES = ["TVSeason", "Season", "CreativeWorkSeason"], ["TVSeries", "Series", "CreativeWorkSeries"]


def _v(x: Column, path: str, kind: str = "string") -> Column:
    return F.try_variant_get(x, path, kind)


def _list(v: Column) -> Column:
    """The members of an array, or the value itself as one member."""
    many = _v(v, "$", "array<variant>")
    return F.coalesce(many, F.array(v))


def items(html: Column) -> Column:
    """All objects with an ``@context`` of all blocks, in page order."""
    blocks = F.regexp_extract_all(html, F.lit(_BLOCK), F.lit(2))
    parsed = F.filter(F.transform(blocks, lambda b: F.try_parse_json(b)), lambda v: v.isNotNull())
    flat = F.flatten(F.transform(parsed, _list))
    return F.filter(flat, lambda v: _v(v, "$['@context']", "variant").isNotNull())


def events(found: Column, expected: str | None) -> Column:
    """array<struct<kind, v>>: every object that sets fields, nested videos right after their owner."""
    kind = lambda v: F.coalesce(_v(v, "$['@type']"), F.lit(""))
    if expected is not None:
        found = F.slice(F.filter(found, lambda v: kind(v) == expected), 1, 1)
    one = lambda k, v: F.struct(k.alias("kind"), v.alias("v"))

    def expand(v):
        video = _v(v, "$.video", "variant")
        nested = (kind(v) != "VideoObject") & F.coalesce(_v(video, "$['@type']") == "VideoObject", F.lit(False))
        return F.when(nested, F.array(one(kind(v), v), one(F.lit("VideoObject"), video))).otherwise(F.array(one(kind(v), v)))
    return F.flatten(F.transform(found, expand))


def _last(ev: Column, setters: dict) -> Column:
    """Value a field has after all events: that of the last object which sets it, even if null."""
    kinds = [k for ks in setters for k in ks]
    last = F.try_element_at(F.filter(ev, lambda e: e["kind"].isin(kinds)), F.lit(-1))

    def value(e):
        out = None
        for ks, get in setters.items():
            out = F.when(e["kind"].isin(list(ks)), get(e["v"])) if out is None else out.when(e["kind"].isin(list(ks)), get(e["v"]))
        return out
    return let(last, value)


def _counters(v: Column) -> Column:
    """array<struct<kind, n>> of the interaction counters of an object."""
    stats = F.filter(_list(_v(v, "$.interactionStatistic", "variant")), lambda s: F.coalesce(_v(s, "$['@type']") == "InteractionCounter", F.lit(False)))
    table = F.create_map(*[F.lit(x) for kv in COUNTERS.items() for x in kv])

    def read(s):
        name = F.coalesce(_v(s, "$.interactionType['@type']"), _v(s, "$.interactionType"))
        n = F.regexp_replace(_v(s, "$.userInteractionCount"), r"[,.+]", "").try_cast("bigint")
        return F.struct(F.try_element_at(table, F.substring_index(name, "/", -1)).alias("kind"), n.alias("n"))
    return F.filter(F.transform(stats, read), lambda c: c["kind"].isNotNull() & c["n"].isNotNull())


VIDEO = ("VideoObject",)
FIELDS = ["url", "title", "description", "thumbnail", "duration", "timestamp", "uploader", "filesize", "tbr", "width",
          "height", "view_count", "like_count", "dislike_count", "comment_count", "episode", "episode_number", "season",
          "season_number", "series"]


def record(ev: Column) -> list[Column]:
    """The record's fields, from the events of one page."""
    text = lambda path: lambda v: unescape(_v(v, path))
    whole = lambda path: lambda v: vx.int_or_null(_v(v, path))
    ep, movie, art = tuple(EPISODE), ("Movie",), tuple(ARTICLE)

    def title():
        # An episode's name counts only where no title stands yet.
        start = F.lit(None).cast("string")
        sets = F.filter(ev, lambda e: e["kind"].isin([*EPISODE, "Movie", *ARTICLE, "VideoObject"]))
        name = lambda e: unescape(F.when(e["kind"].isin(ARTICLE), _v(e["v"], "$.headline")).otherwise(_v(e["v"], "$.name")))
        named = F.transform(sets, lambda e: F.struct(e["kind"].isin(EPISODE).alias("soft"), name(e).alias("n")))
        return F.aggregate(named, start, lambda acc, e: F.when(
            e["soft"], F.when((F.coalesce(acc, F.lit("")) == "") & (e["n"] != ""), e["n"]).otherwise(acc)).otherwise(e["n"]))

    def first_count(kind):
        every = F.flatten(F.transform(F.filter(ev, lambda e: e["kind"] == "VideoObject"), lambda e: _counters(e["v"])))
        return F.try_element_at(F.filter(every, lambda c: c["kind"] == kind), F.lit(1))["n"]

    def part(owner, name, kinds, value):
        """A field of a nested part, from the last episode that has such a part."""
        get = lambda v: F.coalesce(*[_v(v, f"$.{o}", "variant") for o in owner])
        having = F.filter(ev, lambda e: e["kind"].isin(EPISODE) & F.coalesce(_v(get(e["v"]), "$['@type']").isin(kinds), F.lit(False)))
        return let(F.try_element_at(having, F.lit(-1)), lambda e: value(get(e["v"])))

    views = lambda v: F.coalesce(vx.int_or_null(_v(v, "$.interactionCount")),
                                 F.try_element_at(F.filter(_counters(v), lambda c: c["kind"] == "view"), F.lit(1))["n"])
    author = lambda v: F.coalesce(_v(v, "$.author.name"), F.when(F.schema_of_variant(_v(v, "$.author", "variant")) == "STRING", _v(v, "$.author")))
    thumb = lambda v: valid(F.coalesce(F.nullif(_v(v, "$.thumbnailUrl"), F.lit("")), _v(v, "$.thumbnailURL")))
    out = {
        "url": _last(ev, {VIDEO: lambda v: valid(_v(v, "$.contentUrl"))}),
        "title": title(),
        "description": _last(ev, {ep: text("$.description"), movie: text("$.description"), art: text("$.articleBody"), VIDEO: text("$.description")}),
        "thumbnail": _last(ev, {VIDEO: thumb}),
        "duration": _last(ev, {movie: lambda v: vx.duration(_v(v, "$.duration")), VIDEO: lambda v: vx.duration(_v(v, "$.duration"))}),
        "timestamp": _last(ev, {movie: lambda v: vx.timestamp(_v(v, "$.dateCreated")), art: lambda v: vx.iso8601(_v(v, "$.datePublished")),
                                VIDEO: lambda v: vx.timestamp(_v(v, "$.uploadDate"))}),
        "uploader": _last(ev, {VIDEO: author}),
        "filesize": _last(ev, {VIDEO: lambda v: vx.float_or_null(_v(v, "$.contentSize"))}),
        "tbr": _last(ev, {VIDEO: whole("$.bitrate")}), "width": _last(ev, {VIDEO: whole("$.width")}),
        "height": _last(ev, {VIDEO: whole("$.height")}), "view_count": _last(ev, {VIDEO: views}),
        "like_count": first_count("like"), "dislike_count": first_count("dislike"), "comment_count": first_count("comment"),
        "episode": _last(ev, {ep: text("$.name")}), "episode_number": _last(ev, {ep: whole("$.episodeNumber")}),
        "season": part(["partOfSeason"], "name", SEASON, text("$.name")),
        "season_number": part(["partOfSeason"], "seasonNumber", SEASON, whole("$.seasonNumber")),
        "series": part(["partOfSeries", "partOfTVSeries"], "name", SERIES, text("$.name")),
    }
    return [out[f].alias(f) for f in FIELDS]
