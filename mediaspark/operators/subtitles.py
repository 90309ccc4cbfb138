"""Subtitle choice, merging and rendering (family H), over
``subtitles(media_id, kind, lang, lang_no, pos, ext, url)`` rows; ``kind`` is ``manual`` or ``auto``."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F

from .. import skew
from ..functions import html as hx, text as tx, urls as ux
from ..functions.core import hit, let, pack
from ..session import cut


def available_subs(subs: DataFrame) -> DataFrame:
    """Manual tracks, and automatic ones for languages without a manual track."""
    manual = subs.filter("kind = 'manual'")
    auto = subs.filter("kind <> 'manual'").join(manual.select("media_id", "lang").distinct(), ["media_id", "lang"], "left_anti")
    return manual.unionByName(auto.select(*manual.columns))


def choose_langs(subs: DataFrame, langs=None, everything: bool = False) -> DataFrame:
    """Requested languages, else English where there is some, else an item's first language."""
    if everything:
        return subs
    if langs:
        return subs.filter(F.col("lang").isin(list(langs)))
    order = F.struct(F.col("lang") != "en", F.col("kind") != "manual", F.col("lang_no"))
    pick = subs.groupBy("media_id").agg(F.min_by("lang", order).alias("lang"))
    return subs.join(pick, ["media_id", "lang"], "left_semi").select(*subs.columns)


def choose_sub_files(subs: DataFrame, prefs=("best",)) -> DataFrame:
    """One file per language by extension preference; the last match counts.

    ``fallback`` marks files taken although no preference matched.
    """
    prefs = list(prefs)
    stop = prefs.index("best") if "best" in prefs else len(prefs)
    named = prefs[:stop]
    place = F.array_position(F.array(*[F.lit(p) for p in named]), F.col("ext")) if named else F.lit(0)
    rank = F.when(place > 0, place - 1).otherwise(F.lit(stop)).cast("int")
    best = F.max_by(F.struct("ext", "url", rank.alias("rank")), F.struct(-rank, F.col("pos"))).alias("b")
    out = subs.groupBy("media_id", "lang").agg(best)
    missed = F.lit(False) if "best" in prefs else F.col("b.rank") == stop
    return out.select("media_id", "lang", F.col("b.ext").alias("ext"), F.col("b.url").alias("url"), missed.alias("fallback"))


def merge_subs(first: DataFrame, second: DataFrame) -> DataFrame:
    """Tracks of both sides language by language; items of the second whose URL the first has are dropped."""
    extra = second.join(first.select("media_id", "lang", "url").distinct(), ["media_id", "lang", "url"], "left_anti")
    both = first.withColumn("__side", F.lit(0)).unionByName(extra.select(*first.columns).withColumn("__side", F.lit(1)))
    out = skew.numbered(both, ["media_id", "lang"], [F.col("__side"), F.col("pos")], "__n")
    return out.withColumn("pos", F.col("__n") - 1).drop("__n", "__side")


def group_subs(tracks: DataFrame, lang: str | None = "und", ext: str | None = None) -> DataFrame:
    """Track rows as per-language lists in order of quality.

    ``tracks(media_id, pos, id, url, data, ext, quality)``; a track needs a usable URL or data, a
    missing language or extension takes the default.
    """
    url = ux.valid(F.col("url"))
    ok = tracks.withColumn("url", url).filter(F.col("url").isNotNull() | (F.col("data") != ""))
    ok = ok.withColumn("lang", F.coalesce("id", F.lit(lang).cast("string"))).filter(F.col("lang").isNotNull())
    ok = ok.withColumn("ext", F.coalesce("ext", F.lit(ext).cast("string")))
    out = skew.numbered(ok, ["media_id", "lang"], [F.coalesce("quality", F.lit(0)), F.col("pos")], "__n")
    return out.select("media_id", "lang", (F.col("__n") - 1).alias("pos"), "ext", "url", "data")


# --- timed text ---------------------------------------------------------------------------------

_PARA = r"(?s)(<(?:\w+:)?p(?:\s[^>]*)?/>|<(?:\w+:)?p(?:\s[^>]*)?>.*?</(?:\w+:)?p>)"


def seconds(expr: Column) -> Column:
    """Time of ``12.5``, ``12.5s``, ``h:mm:ss``, ``h:mm:ss.f`` or ``h:mm:ss:f``."""
    plain = hit(expr, r"^(\d+(?:\.\d+)?)s?$").try_cast("double")
    full = r"^(\d+):(\d\d):(\d\d(?:(?:\.|:)\d+)?)$"
    sec = F.replace(F.regexp_extract(expr, full, 3), F.lit(":"), F.lit(".")).try_cast("double")
    long = F.regexp_extract(expr, full, 1).try_cast("double") * 3600 + F.regexp_extract(expr, full, 2).try_cast("double") * 60 + sec
    return F.coalesce(plain, F.when(expr.rlike(full), long))


def ttml_cues(files: DataFrame) -> DataFrame:
    """Cues of timed-text files ``(file_id, body)``.

    A cue without a begin, or without end and duration, is dropped but keeps its number.
    """
    d = files.select("file_id", F.posexplode(F.regexp_extract_all(hx.without_comments(F.col("body")), F.lit(_PARA), F.lit(1))).alias("i", "para"))
    d = d.withColumn("a", hx.attributes(F.regexp_extract("para", r"(?s)^(<[^>]*>)", 1)))
    at = lambda n: seconds(hx.get(F.col("a"), n))
    d = d.select("file_id", (F.col("i") + 1).alias("idx"), at("begin").alias("begin"), F.nullif(at("end"), F.lit(0.0)).alias("end"),
                 F.nullif(at("dur"), F.lit(0.0)).alias("dur"), "para")
    d = d.withColumn("end", F.coalesce("end", F.col("begin") + F.col("dur"))).filter("begin IS NOT NULL AND end IS NOT NULL")
    inner = F.regexp_replace(F.regexp_replace(F.regexp_replace("para", r"(?s)^<[^>]*>", ""), r"(?s)</[^<>]*>\s*$", ""), r"(?i)<(?:\w+:)?br\s*/?>", "\n")
    plain = tx.unescape(F.regexp_replace(inner, "(?s)<[^>]*>", ""))
    return d.select("file_id", "idx", "begin", "end", F.regexp_replace(plain, r"(?U)^\s+|\s+$", "").alias("text"), "para")


# Style properties that reach the output, in order of their names, and their attributes.
PROPS = ["color", "fontFamily", "fontSize", "fontStyle", "fontWeight", "textDecoration"]
_STYLE = "struct<" + ",".join(f"{p}:string" for p in PROPS) + ">"


def _style_of(a: Column) -> Column:
    """Own style properties of a tag."""
    own = lambda p: F.nullif(F.try_element_at(F.filter(a, lambda x: F.regexp_replace(x["k"], r"^\w+:", "") == p.lower()), F.lit(-1))["v"], F.lit(""))
    return pack(**{p: own(p) for p in PROPS})


def _over(top: Column, base: Column) -> Column:
    return pack(**{p: F.coalesce(top[p], base[p]) for p in PROPS})


def ttml_styles(files: DataFrame) -> DataFrame:
    """Style definitions ``(file_id, style_id, parent, style)`` of timed-text files."""
    tags = F.regexp_extract_all(hx.without_comments(F.col("body")), F.lit(r"(?s)(<(?:\w+:)?style\s[^>]*>)"), F.lit(1))
    d = files.select("file_id", F.posexplode(tags).alias("n", "t")).withColumn("a", hx.attributes(F.col("t")))
    sid = F.coalesce(F.nullif(hx.get(F.col("a"), "id"), F.lit("")), hx.get(F.col("a"), "xml:id"))
    d = d.select("file_id", "n", sid.alias("style_id"), F.nullif(hx.get(F.col("a"), "style"), F.lit("")).alias("parent"), _style_of(F.col("a")).alias("style"))
    # Of definitions with one id the last counts.
    d = d.filter("style_id IS NOT NULL AND style_id <> ''")
    return d.groupBy("file_id", "style_id").agg(F.max_by(F.struct("parent", "style"), "n").alias("s")).select("file_id", "style_id", "s.parent", "s.style")


def resolve_styles(styles: DataFrame) -> DataFrame:
    """Each style with what it inherits along its parents, however many (H07); one whose parents never end or are missing is dropped.

    Pointer doubling: each round joins the styles with themselves, so that a round takes in as many parents as all before it together.
    """
    state, span, n = cut(styles.select("file_id", "style_id", "parent", "style")), 1, styles.count()
    while span <= n and not state.filter("parent IS NOT NULL").isEmpty():
        up = state.select(F.col("file_id").alias("f"), F.col("style_id").alias("up"), F.col("parent").alias("up_parent"), F.col("style").alias("up_style"))
        live = state.filter("parent IS NOT NULL")
        j = live.join(up, (live["file_id"] == up["f"]) & (live["parent"] == up["up"]))
        step = j.select("file_id", "style_id", F.col("up_parent").alias("parent"), _over(F.col("style"), F.col("up_style")).alias("style"))
        state, span = cut(state.filter("parent IS NULL").unionByName(step)), span * 2
    return state.filter("parent IS NULL").select("file_id", "style_id", "style")


def style_cues(cues: DataFrame, files: DataFrame) -> DataFrame:
    """Cue texts with font, bold, italic and underline marks from their styles.

    Body and div defaults, the named style and own properties apply in that order; nested elements mark
    only what changes. The styles of one file travel with its cues as a map.
    """
    styles = resolve_styles(ttml_styles(files))
    maps = styles.groupBy("file_id").agg(F.map_from_entries(F.collect_list(F.struct("style_id", "style"))).alias("styles"))
    first = lambda tag: hx.attr(F.regexp_extract(hx.without_comments(F.col("body")), rf"(?s)(<(?:\w+:)?{tag}(?:\s[^>]*)?>)", 1), "style")
    used = files.select("file_id", first("body").alias("__b"), first("div").alias("__d"))
    d = cues.join(used, "file_id", "left").join(maps, "file_id", "left")
    none = F.lit(None).cast(_STYLE)
    named = lambda c: F.try_element_at("styles", c)
    d = d.withColumn("default", let(pack(top=named(F.col("__d")), base=named(F.col("__b"))), lambda p: _over(p["top"], p["base"])))
    tokens = F.regexp_extract_all("para", F.lit(r"(?s)(<[^>]+>|[^<]+)"), F.lit(1))
    start = F.expr(f"named_struct('out', '', 'opens', CAST(array() AS ARRAY<STRING>), 'applied', CAST(array() AS ARRAY<{_STYLE}>))")

    def step(acc, tok):
        tag = F.regexp_extract(tok, r"^</?(?:\w+:)?(\w+)", 1)
        text = F.struct(F.concat(acc["out"], tx.unescape(tok)).alias("out"), acc["opens"].alias("opens"), acc["applied"].alias("applied"))
        line = F.struct(F.when(tok.startswith("</"), acc["out"]).otherwise(F.concat(acc["out"], F.lit("\n"))).alias("out"),
                        acc["opens"].alias("opens"), acc["applied"].alias("applied"))
        return (F.when(~tok.startswith("<"), text).when(tag == "br", line).when(tok.startswith("</"), _end(acc))
                .when(tok.endswith("/>"), let(_begin(acc, tok), _end)).otherwise(_begin(acc, tok)))

    def _begin(acc, tok):
        a = hx.attributes(tok)
        style = let(pack(own=_style_of(a), name=named(hx.get(a, "style"))),
                    lambda s: pack(**{p: F.coalesce(s["own"][p], s["name"][p], F.col("default")[p]) for p in PROPS}))
        return let(pack(acc=acc, st=style), _mark)

    def _mark(p):
        acc, st = p["acc"], p["st"]
        last = F.try_element_at(acc["applied"], F.lit(-1))
        fresh = lambda k: st[k].isNotNull() & ~(st[k].eqNullSafe(last[k]) & (F.size(acc["applied"]) > 0))
        attr = lambda k, n: F.when(fresh(k), F.concat(F.lit(f' {n}="'), st[k], F.lit('"'))).otherwise(F.lit(""))
        font = F.concat(attr("color", "color"), attr("fontFamily", "face"), attr("fontSize", "size"))
        on = {"i": fresh("fontStyle") & (st["fontStyle"] == "italic"), "b": fresh("fontWeight") & (st["fontWeight"] == "bold"),
              "u": fresh("textDecoration") & (st["textDecoration"] == "underline")}
        opened = F.concat(*[F.when(c, F.lit(f"<{t}>")).otherwise(F.lit("")) for t, c in on.items()],
                          F.when(font != "", F.concat(F.lit("<font"), font, F.lit(">"))).otherwise(F.lit("")))
        closed = F.concat(F.when(font != "", F.lit("</font>")).otherwise(F.lit("")),
                          *[F.when(on[t], F.lit(f"</{t}>")).otherwise(F.lit("")) for t in ("u", "b", "i")])
        any_ = reduce(lambda x, y: x | y, [st[k].isNotNull() for k in PROPS])
        merged = pack(**{k: F.coalesce(st[k], last[k]) for k in PROPS})
        return F.struct(F.concat(acc["out"], opened).alias("out"), F.concat(acc["opens"], F.array(closed)).alias("opens"),
                        F.when(any_, F.concat(acc["applied"], F.array(merged))).otherwise(acc["applied"]).alias("applied"))

    def _end(acc):
        close = F.coalesce(F.try_element_at(acc["opens"], F.lit(-1)), F.lit(""))
        drop = lambda x: F.slice(x, F.lit(1), F.greatest(F.size(x) - 1, F.lit(0)))
        # Only an element that was marked takes its style off again.
        return F.struct(F.concat(acc["out"], close).alias("out"), drop(acc["opens"]).alias("opens"),
                        F.when(close != "", drop(acc["applied"])).otherwise(acc["applied"]).alias("applied"))
    styled = F.aggregate(tokens, start, step, lambda acc: F.regexp_replace(acc["out"], r"(?U)^\s+|\s+$", ""))
    return d.withColumn("text", styled).drop("__b", "__d", "styles", "default")


def timecode(secs: Column) -> Column:
    """``hh:mm:ss,mmm``, truncated."""
    two = lambda c: F.lpad(c.cast("string"), F.greatest(F.lit(2), F.length(c.cast("string"))), F.lit("0"))
    whole = lambda c: F.floor(c).cast("bigint")
    return F.concat(two(whole(secs / 3600)), F.lit(":"), two(whole((secs % 3600) / 60)), F.lit(":"), two(whole(secs % 60)), F.lit(","),
                    F.lpad(whole((secs % 1) * 1000).cast("string"), 3, "0"))


def render_srt(cues: DataFrame) -> DataFrame:
    """SRT blocks ``(file_id, idx, block)``, one per cue whatever the size of a file (H08); a file's text is its blocks by ``idx``."""
    block = F.concat(F.col("idx").cast("string"), F.lit("\n"), timecode(F.col("begin")), F.lit(" --> "), timecode(F.col("end")), F.lit("\n"),
                     F.col("text"), F.lit("\n\n"))
    return cues.select("file_id", "idx", block.alias("block"))


def write_srt(cues: DataFrame, path: str) -> None:
    """Write blocks as text, one folder per file, in order over its parts (H08). Range partitions also split a file of any size."""
    d = render_srt(cues).select("file_id", "idx", "block").repartitionByRange("file_id", "idx").sortWithinPartitions("file_id", "idx")
    d.select("file_id", F.col("block").alias("value")).write.mode("overwrite").option("lineSep", "").partitionBy("file_id").text(path)


def list_subs(subs: DataFrame) -> DataFrame:
    """The extensions of each language, best first, as one row each: ``media_id, lang, n, ext``."""
    return skew.numbered(subs, ["media_id", "lang"], [-F.col("pos")], "n").select("media_id", "lang", "n", "ext")


def list_thumbnails(ranked: DataFrame) -> DataFrame:
    """Thumbnail listing rows with ``unknown`` for missing sizes."""
    size = lambda c: F.coalesce(F.col(c).cast("string"), F.lit("unknown"))
    return ranked.select("media_id", "rank", "id", size("width").alias("width"), size("height").alias("height"), "url")
