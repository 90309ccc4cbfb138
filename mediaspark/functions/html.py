"""Column expressions that read stored pages."""

from __future__ import annotations

import re

from pyspark.sql import Column, functions as F

from .text import clean_html, unescape
from .core import hit, let


def search(text: Column, patterns, clean: bool = False) -> Column:
    """First non-empty group of the first pattern that gives one."""
    tries = []
    for p in [patterns] if isinstance(patterns, str) else patterns:
        groups = max(1, re.compile(p).groups) if "(" in p else 0
        first = range(1, groups + 1) if groups else [0]
        tries += [hit(text, p, i) for i in first]
    found = F.coalesce(*tries)
    return let(found, clean_html) if clean else found


def og_patterns(prop: str):
    """Open Graph tags in either attribute order, ``og:`` or ``og-``."""
    p = re.escape(prop)
    # The accepted spellings of the two attributes.
    name = rf"""(?:name|property)=(?:'og[:-]{p}'|"og[:-]{p}"|\s*og[:-]{p}\b)"""
    content = r"""content=(?:"([^"]+?)"|'([^']+?)'|\s*([^\s"'=<>`]+?)(?=\s|/?>))"""
    return [rf"(?s)<meta[^>]+?{name}[^>]+?{content}", rf"(?s)<meta[^>]+?{content}[^>]+?{name}"]


def og(text: Column, props) -> Column:
    props = [props] if isinstance(props, str) else props
    return let(search(text, [p for prop in props for p in og_patterns(prop)]), unescape)


def og_video(text: Column) -> Column:
    pats = [p for prop in ("video:secure_url", "video", "video:url") for p in og_patterns(prop)]
    return search(text, pats, clean=True)


def meta(text: Column, names) -> Column:
    """Content of the first meta tag found under one of the names."""
    tries = []
    for n in [names] if isinstance(names, str) else names:
        p = (rf"""(?is)<meta(?=[^>]+(?:itemprop|name|property|id|http-equiv)=(["']?){re.escape(n)}\1)"""
             r"""[^>]+?content=(["'])(.*?)\2""")
        tries.append(hit(text, p, 3))
    return let(F.coalesce(*tries), clean_html)


_ATTR = r"""\s([^\s=>"'/]+)((?:\s*=\s*(?:"[^"]*"|'[^']*'|[^\s"'>]*))?)"""


def attributes(tag: Column) -> Column:
    """array<struct<k, v>> of a start tag: lower-cased names, unescaped values, null where there is none."""
    names = F.regexp_extract_all(tag, F.lit(_ATTR), F.lit(1))
    raw = F.regexp_extract_all(tag, F.lit(_ATTR), F.lit(2))
    value = lambda r: F.when(r != "", unescape(_unquoted(r)))
    return F.zip_with(names, raw, lambda n, r: F.struct(F.lower(n).alias("k"), value(r).alias("v")))


def _unquoted(raw: Column) -> Column:
    return F.regexp_replace(raw, r"""^\s*=\s*(?:"([^"]*)"|'([^']*)'|(.*))$""", "$1$2$3")


def bare(raw: Column) -> Column:
    """What stands behind a name, without equals sign and quotes, still escaped; null where there is no value."""
    return F.when(raw != "", _unquoted(raw))


def tokens(tag: Column) -> dict:
    """Lower-cased names of a start tag's attributes, and what stands behind each; ``raw_of`` and ``bare`` read single ones without the others."""
    return {"names": F.regexp_extract_all(F.lower(tag), F.lit(_ATTR), F.lit(1)), "raw": F.regexp_extract_all(tag, F.lit(_ATTR), F.lit(2))}


def raw_of(names: Column, raw: Column, name: str) -> Column:
    """What stands behind a name, of repeated ones the last; null where the tag does not have it."""
    return F.get(raw, F.size(raw) - F.array_position(F.reverse(names), name).cast("int"))


def attr(tag: Column, name: str) -> Column:
    """Value of one attribute of a start tag; of repeated ones the last."""
    return get(attributes(tag), name)


def get(attrs: Column, name: str) -> Column:
    return F.try_element_at(F.filter(attrs, lambda a: a["k"] == name), F.lit(-1))["v"]


def attribute_map(tag: Column) -> Column:
    """Attributes of a start tag as a map."""
    return let(attributes(tag), lambda a: F.transform_values(
        F.map_from_arrays(F.array_distinct(F.transform(a, lambda x: x["k"])),
                          F.array_distinct(F.transform(a, lambda x: x["k"]))),
        lambda k, v: F.element_at(F.filter(a, lambda x: x["k"] == k), -1)["v"]))


def without_comments(text: Column) -> Column:
    """Markup without comments; what a CDATA section holds becomes escaped text."""
    bare = F.when(text.contains("<!--"), F.regexp_replace(text, r"(?s)<!--.*?-->", "")).otherwise(text)
    escape = lambda c: F.replace(F.replace(c, F.lit("&"), F.lit("&amp;")), F.lit("<"), F.lit("&lt;"))
    close = F.lit("]]>")
    part = lambda c, i: F.when((i == 0) | (F.locate("]]>", c) == 0), c).otherwise(
        F.concat(escape(F.substring_index(c, "]]>", 1)), F.substr(c, F.locate("]]>", c) + F.length(close))))
    return let(bare, lambda b: F.when(b.contains("<![CDATA["), F.array_join(F.transform(F.split(b, r"<!\[CDATA\["), part), "")).otherwise(b))


def elements(text: Column, name: str, value: str, whole_word: bool = False) -> Column:
    """Inner HTML of the elements with an attribute value, up to the first closing tag of the same name.

    The pattern is flat, so that no number of attributes makes the matcher recurse; the attributes of what it finds are then read one by one.
    """
    v = rf"""[^'">]*\b{re.escape(value)}\b[^'">]*""" if whole_word else re.escape(value)
    pattern = rf"""(?s)(<([a-zA-Z0-9:._-]+)(?=\s(?:[^>]*\s)?{re.escape(name)}=['"]?{v}['"]?[\s>])[^>]*>)(.*?)</\2>"""
    tags, inner = (F.regexp_extract_all(text, F.lit(pattern), F.lit(i)) for i in (1, 3))
    own = lambda tag: get(attributes(tag), name.lower())
    fits = lambda tag: own(tag).rlike(rf"\b{re.escape(value)}\b") if whole_word else own(tag) == value
    both = F.filter(F.zip_with(tags, inner, lambda t, c: F.struct(t.alias("t"), c.alias("c"))), lambda x: fits(x["t"]))
    return F.transform(both, lambda x: let(x["c"], lambda r: unescape(F.when(r.rlike("""^["']"""), F.substring(r, F.lit(2), F.length(r) - 2)).otherwise(r))))


_ROOT = r"(?s)^\x{FEFF}?\s*(?:<\?.*?\?>\s*|<!--.*?-->\s*|<!DOCTYPE[^>]*>\s*)*<((?:[A-Za-z_][\w.-]*:)?([A-Za-z_][\w.-]*))([^>]*)>"


def sniff(body: Column) -> Column:
    """Kind of a stored body: ``m3u8``, ``rss``, ``ism``, ``smil``, ``xspf``, ``mpd``, ``f4m``, ``html`` or ``direct``."""
    root, rest = F.regexp_extract(body, _ROOT, 2), F.regexp_extract(body, _ROOT, 3)
    return (F.when(body.startswith("#EXTM3U"), F.lit("m3u8"))
            .when(~body.rlike(r"^\x{FEFF}?\s*<"), F.lit("direct"))
            .when(root == "rss", F.lit("rss")).when(root == "SmoothStreamingMedia", F.lit("ism"))
            .when(root == "smil", F.lit("smil"))
            .when((root == "playlist") & rest.contains("http://xspf.org/ns/0/"), F.lit("xspf"))
            .when(F.lower(root) == "mpd", F.lit("mpd"))
            .when((root == "manifest") & rest.rlike(r"http://ns\.adobe\.com/f4m/[12]\.0"), F.lit("f4m"))
            .otherwise(F.lit("html")))
