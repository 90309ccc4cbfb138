"""Metadata out of stored pages (family C, without media embeds).

All of these are per-row expressions over ``pages(page_id, url, html)``: nothing is shuffled unless a
job counts over pages.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from .. import skew
from ..functions import html as hx, jsonld, text as tx, urls as ux
from ..functions.core import let

HTML = F.col


def extract_fields(pages: DataFrame, spec: dict) -> DataFrame:
    """Add fields by ordered patterns.

    ``spec`` maps a name to ``(patterns, default, required)``; ``missing`` lists required fields that no
    pattern gave, so that rows can be split into good ones and dead letters.
    """
    out = pages.withColumns({n: hx.search(F.col("html"), pats) for n, (pats, _, _) in spec.items()})
    need = [F.when(F.col(n).isNull(), F.lit(n)) for n, (_, _, required) in spec.items() if required]
    out = out.withColumn("missing", F.filter(F.array(*need), lambda x: x.isNotNull()) if need else F.array().cast("array<string>"))
    return out.withColumns({n: F.coalesce(F.col(n), F.lit(d)) for n, (_, d, _) in spec.items() if d is not None})


def split_missing(df: DataFrame):
    """(complete rows, dead letters) of ``extract_fields``."""
    return df.filter(F.size("missing") == 0).drop("missing"), df.filter(F.size("missing") > 0)


def clean_text(df: DataFrame, col: str) -> DataFrame:
    """Readable text of an HTML column."""
    return df.withColumn(col, tx.clean_html(F.col(col)))


def open_graph(pages: DataFrame, props: dict) -> DataFrame:
    """Add Open Graph fields; ``props`` maps a name to one property or several to fall back on."""
    return pages.withColumns({n: hx.og_video(F.col("html")) if p == "video" else hx.og(F.col("html"), p) for n, p in props.items()})


def meta_tags(pages: DataFrame, names: dict) -> DataFrame:
    """Add meta tag contents by name, with fallbacks."""
    return pages.withColumns({n: hx.meta(F.col("html"), ns) for n, ns in names.items()})


def explode_meta(pages: DataFrame, keep=()) -> DataFrame:
    """One row per named meta tag of each page, with other columns of the page if named."""
    tags = F.regexp_extract_all("html", F.lit(r"(?is)(<meta\s[^>]*>)"), F.lit(1))
    attrs = pages.select("page_id", *keep, F.posexplode(tags).alias("pos", "tag")).withColumn("a", hx.attributes(F.col("tag")))
    name = F.coalesce(*[hx.get(F.col("a"), n) for n in ("itemprop", "name", "property", "id", "http-equiv")])
    out = attrs.select("page_id", *keep, "pos", name.alias("name"), hx.get(F.col("a"), "content").alias("content"))
    return out.filter(F.col("name").isNotNull() & F.col("content").isNotNull())


def meta_counts(pages: DataFrame) -> DataFrame:
    """How many pages of each site carry each meta name."""
    named = explode_meta(pages.withColumn("site", ux.host(F.col("url"))), keep=["site"])
    return named.groupBy("site", "name").agg(F.count(F.lit(1)).alias("n"))


def page_summary(pages: DataFrame) -> DataFrame:
    """Title, uploader, description and thumbnail a page has without site knowledge."""
    h = F.col("html")
    title = F.coalesce(hx.og(h, "title"), hx.search(h, r"(?s)<title>(.*?)</title>", clean=True), F.lit("video"))
    return pages.select("page_id", title.alias("title"), ux.hit(F.col("url"), r"^(?:https?://)?([^/]*)/.*").alias("uploader"),
                        hx.og(h, "description").alias("description"), hx.og(h, "image").alias("thumbnail"))


# Page marks of adult content, and rating words with their ages.
RTA = r"""(?i)<meta\s+name="rating"\s+content="RTA-5042-1996-1400-1577-RTA\""""
MARKS = [r'Proudly Labeled <a href="http://www\.rtalabel\.org/" title="Restricted to Adults">RTA</a>',
         r">[^<]*you acknowledge you are at least (\d+) years old",
         r">\s*(?:18\s+U(?:\.S\.C\.|SC)\s+)?(?:§+\s*)?2257\b"]
RATINGS = {"safe for kids": 0, "general": 8, "14 years": 14, "mature": 17, "restricted": 19}
FRIENDLY = {"1": 0, "true": 0, "0": 18, "false": 18}


def age_markers(pages: DataFrame) -> DataFrame:
    """Age limit from labels and text marks, and the two rating tables."""
    h = F.col("html")
    marks = [F.when(h.rlike(RTA), 18).otherwise(0), F.when(h.rlike(MARKS[0]), 18).otherwise(0),
             F.when(h.rlike(MARKS[1]), F.coalesce(ux.hit(h, MARKS[1]).try_cast("int"), F.lit(18))).otherwise(0),
             F.when(h.rlike(MARKS[2]), 18).otherwise(0)]
    table = lambda d, c: F.try_element_at(F.create_map(*[F.lit(x) for kv in d.items() for x in kv]), F.lower(c))
    return pages.select("page_id", F.greatest(*marks).alias("age_limit"),
                        table(RATINGS, hx.meta(h, "rating")).alias("media_rating"),
                        table(FRIENDLY, hx.meta(h, "isFamilyFriendly")).alias("family_rating"))


def json_ld(pages: DataFrame, expected_type: str | None = None) -> DataFrame:
    """One record per page from its linked-data blocks."""
    ev = pages.select("page_id", jsonld.events(jsonld.items(F.col("html")), expected_type).alias("__ev"))
    return ev.select("page_id", *jsonld.record(F.col("__ev")))


def embedded_json(pages: DataFrame, marker: str, end: str = "</script>", out: str = "data") -> DataFrame:
    """Parsed JSON object that follows a marker and is bounded by an end mark."""
    text = F.nullif(F.regexp_extract("html", rf"(?s)(?:{marker})\s*(\{{.*?\}})\s*(?:;\s*)?(?:{end})", 1), F.lit(""))
    return pages.withColumn(out, F.try_parse_json(text))


NEXT_DATA = r"""<script\s[^>]*?\bid\s*=\s*(?:"__NEXT_DATA__"|'__NEXT_DATA__')[^>]*>"""


def select_elements(pages: DataFrame, attr: str, value: str) -> DataFrame:
    """Rows of the inner HTML of elements by id, class (a whole word) or any attribute."""
    found = hx.elements(F.col("html"), attr, value, whole_word=attr == "class")
    return pages.select("page_id", F.posexplode(found).alias("pos", "content"))


def tag_attributes(df: DataFrame, col: str, out: str = "attributes") -> DataFrame:
    """Attributes of a start tag column as a map (C11)."""
    return df.withColumn(out, hx.attribute_map(F.col(col)))


def hidden_inputs(pages: DataFrame, form_id: str | None = None) -> DataFrame:
    """Name and value rows of hidden and submit inputs, comments left out, within one form if asked."""
    h = F.col("html")
    if form_id:
        h = F.regexp_extract(h, rf"""(?is)<form[^>]+?id=(["']){form_id}\1[^>]*>(.+?)</form>""", 2)
    h = F.regexp_replace(h, "<!--(?:(?!<!--).)*-->", "")
    tags = F.regexp_extract_all(h, F.lit("(?i)(<input[^>]+>)"), F.lit(1))
    a = pages.select("page_id", F.posexplode(tags).alias("pos", "tag")).withColumn("a", hx.attributes(F.col("tag")))
    name = F.coalesce(F.nullif(hx.get(F.col("a"), "name"), F.lit("")), hx.get(F.col("a"), "id"))
    rows = a.filter(hx.get(F.col("a"), "type").isin("hidden", "submit")).select(
        "page_id", "pos", name.alias("name"), hx.get(F.col("a"), "value").alias("value"))
    rows = rows.filter((F.col("name") != "") & F.col("value").isNotNull())
    # Of inputs with one name the last counts.
    return rows.groupBy("page_id", "name").agg(F.max_by("value", "pos").alias("value"))


def number_entries(df: DataFrame, key: str = "page_id", order: str = "pos") -> DataFrame:
    """``id-n`` and ``title (n)`` where a page has more than one entry."""
    out = skew.with_totals(skew.numbered(df, key, [F.col(order)], "n"), key, {"__c": F.count(F.lit(1))})
    many = F.col("__c") > 1
    n = F.col("n").cast("string")
    return (out.withColumn("id", F.when(many, F.concat("id", F.lit("-"), n)).otherwise(F.col("id")))
            .withColumn("title", F.when(many, F.concat("title", F.lit(" ("), n, F.lit(")"))).otherwise(F.col("title"))).drop("__c"))


# Fixed value: delay and target of a refresh, in a meta tag or in the response header.
_REFRESH = r"""[0-9]{0,2};\s*(?:URL|url)='?([^'"]+)"""


def redirect_edges(pages: DataFrame) -> DataFrame:
    """(page_id, src, dst) of pages that refresh to another URL, by a meta tag or else by a ``refresh`` column with the response header."""
    tags = F.regexp_extract_all("html", F.lit(r"(?i)(<meta\s[^>]*>)"), F.lit(1))
    is_refresh = lambda a: F.lower(F.coalesce(hx.get(a, "http-equiv"), F.lit(""))) == "refresh"
    found = F.transform(tags, lambda t: let(hx.attributes(t), lambda a: F.when(is_refresh(a), ux.hit(hx.get(a, "content"), "^" + _REFRESH))))
    link = F.try_element_at(F.filter(found, lambda x: x.isNotNull()), F.lit(1))
    if "refresh" in pages.columns:
        link = F.coalesce(link, let(ux.hit(F.col("refresh"), _REFRESH), tx.unescape))
    out = pages.select("page_id", F.col("url").alias("src"), link.alias("__l")).filter(F.col("__l").isNotNull())
    out = out.withColumn("dst", F.coalesce(ux.resolve(F.col("src"), F.col("__l")), F.col("__l"))).drop("__l")
    return out.filter(F.col("src") != F.col("dst"))


def sniff(df: DataFrame, col: str) -> DataFrame:
    """Kind of each stored body (C20)."""
    return df.withColumn("kind", hx.sniff(F.col(col)))


def detect_charset(df: DataFrame, body: str = "html", content_type: str = "content_type") -> DataFrame:
    """Charset by content type, a meta mark in the first 1024 bytes, a UTF-16 mark, else utf-8 (C21); the body is binary, or text taken as UTF-8."""
    raw = F.col(body) if dict(df.dtypes)[body] == "binary" else F.encode(F.col(body), "UTF-8")
    given = ux.hit(F.col(content_type), r"^[a-zA-Z0-9_.-]+/[a-zA-Z0-9_.-]+\s*;\s*charset=(.+)")
    head = F.decode(F.substring(raw, 1, 1024), "ISO-8859-1")
    marked = ux.hit(head, r"""<meta[^>]+charset=['"]?([^'")]+)[ /'">]""")
    utf16 = F.when(F.hex(F.substring(raw, 1, 2)) == "FFFE", F.lit("utf-16"))
    return df.withColumn("charset", F.coalesce(given, marked, utf16, F.lit("utf-8")))


# What block pages of filters look like.
BLOCKED = [("<title>Access to this site is blocked</title>", "Websense", "filtering software"),
           ("<title>The URL you requested has been blocked</title>", None, "national censorship"),
           ("<title>TTK :: Доступ к ресурсу ограничен</title>", "blocklist.rkn.gov.ru", "government decision")]


def block_reason(pages: DataFrame) -> DataFrame:
    """Add ``blocked``: why a page is a block page, null for real pages."""
    h, first = F.col("html"), F.substring("html", 1, 512)
    (a1, a2, ra), (b1, _, rb), (c1, c2, rc) = BLOCKED
    return pages.withColumn("blocked", F.when(h.contains(a1) & first.contains(a2), F.lit(ra)).when(first.contains(b1), F.lit(rb))
                            .when(h.contains(c1) & h.contains(c2), F.lit(rc)))


def split_blocked(pages: DataFrame):
    """(real pages, block pages with their reason)."""
    marked = block_reason(pages)
    return marked.filter(F.col("blocked").isNull()).drop("blocked"), marked.filter(F.col("blocked").isNotNull())
