"""URL jobs (family B)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from .. import skew
from ..functions import urls as ux


def sanitize_urls(df: DataFrame, col: str) -> DataFrame:
    """Repair scheme-less and mistyped URLs."""
    return df.withColumn(col, ux.sanitize(F.col(col)))


def valid_urls(df: DataFrame, col: str) -> DataFrame:
    """Null for anything that is not a fetchable URL."""
    return df.withColumn(col, ux.valid(F.col(col)))


def resolve_links(df: DataFrame, base: str, link: str, out: str = "resolved") -> DataFrame:
    """Absolute form of links found on pages."""
    return df.withColumn(out, ux.resolve(F.col(base), F.col(link)))


def normalise_urls(df: DataFrame, col: str) -> DataFrame:
    """Remove dot segments and escape characters that URLs may not hold."""
    c = F.col(col)
    origin = F.regexp_extract(c, r"^([a-zA-Z][a-zA-Z0-9+.-]*:(?://[^/?#]*)?)", 1)
    path, tail = ux.path_of(c), F.regexp_extract(c, r"^[^?#]*(.*)$", 1)
    tidy = F.when(path.startswith("/"), ux.tidy_path(path)).otherwise(path)
    return df.withColumn(col, F.concat(origin, ux.escape(tidy), ux.escape(tail)))


def _decode(c: Column) -> Column:
    return F.coalesce(F.try_url_decode(c), c)


def _encode(c: Column) -> Column:
    return F.replace(F.replace(F.url_encode(c), F.lit("*"), F.lit("%2A")), F.lit("%7E"), F.lit("~"))


def _query_pairs(url: Column) -> Column:
    """array<struct<k, v>> of a URL's query; blank values are dropped."""
    query = F.regexp_extract(url, r"^[^?#]*\?([^#]*)", 1)
    pairs = F.filter(F.split(query, "&"), lambda p: p.contains("="))
    split = F.transform(pairs, lambda p: F.struct(
        _decode(F.substring_index(p, "=", 1)).alias("k"), _decode(F.regexp_extract(p, "^[^=]*=(.*)$", 1)).alias("v")))
    return F.filter(split, lambda p: p["v"] != "")


def query_values(df: DataFrame, col: str, key: str, out: str) -> DataFrame:
    """All values of one query key as an array."""
    found = F.filter(_query_pairs(F.col(col)), lambda p: p["k"] == key)
    return df.withColumn(out, F.transform(found, lambda p: p["v"]))


def update_query(df: DataFrame, col: str, params: dict) -> DataFrame:
    """Replace or add query keys and keep the others, in their order."""
    c = F.col(col)
    pairs = _query_pairs(c)
    given = F.create_map(*[F.lit(x) for kv in params.items() for x in kv])
    old = F.array_distinct(F.transform(pairs, lambda p: p["k"]))
    show = lambda k, v: F.concat(_encode(k), F.lit("="), _encode(v))
    kept = F.flatten(F.transform(old, lambda k: F.when(
        F.map_contains_key(given, k), F.array(show(k, F.element_at(given, k)))).otherwise(
        F.transform(F.filter(pairs, lambda p: p["k"] == k), lambda p: show(k, p["v"])))))
    new = F.transform(F.array_except(F.array(*[F.lit(k) for k in params]), old), lambda k: show(k, F.element_at(given, k)))
    query = F.array_join(F.concat(kept, new), "&")
    head, frag = F.regexp_extract(c, r"^([^?#]*)", 1), F.regexp_extract(c, r"^[^#]*(#.*)?$", 1)
    return df.withColumn(col, F.concat(head, F.when(query != "", F.concat(F.lit("?"), query)).otherwise(F.lit("")), frag))


def _stem(name: Column) -> Column:
    """A file name without its last extension."""
    return F.regexp_replace(name, r"^(.*[^.].*)\.[^.]*$", "$1")


def url_parts(df: DataFrame, col: str) -> DataFrame:
    """Basename, base URL, and the id and title a page gets when nothing better is known."""
    c = F.col(col)
    tail = F.substring_index(F.regexp_replace(c, "/+$", ""), "/", -1)
    return (df.withColumn("basename", ux.basename(c)).withColumn("base_url", ux.base_url(c))
            .withColumn("generic_id", _decode(_stem(tail))).withColumn("generic_title", _decode(_stem(ux.basename(c)))))


def infer_ext(df: DataFrame, col: str, default: str | None = "unknown_video") -> DataFrame:
    """File extension of each URL."""
    return df.withColumn("ext", ux.ext_of(F.col(col), default))


def infer_protocol(df: DataFrame, col: str = "url") -> DataFrame:
    """Protocol of each URL, keeping one that is given."""
    given = F.col("protocol") if "protocol" in df.columns else F.lit(None).cast("string")
    return df.withColumn("protocol", ux.protocol_of(given, F.col(col)))


def strip_trackers(df: DataFrame, col: str, key: str) -> DataFrame:
    """Clean podcast URLs and collapse those that become equal, keeping the smallest key."""
    clean = df.withColumn(col, ux.strip_trackers(F.col(col)))
    return clean.groupBy(col).agg(F.min(key).alias(key), F.count(F.lit(1)).alias("copies"))


def expand_search(queries: DataFrame, results: DataFrame, max_results: int = 50) -> DataFrame:
    """Top results of search-query texts ``key:words``, ``keyN:words``, ``keyall:words``.

    ``results(search_key, query, pos, url)``. N beyond the maximum is clamped, 0 is rejected (a row
    with ``valid`` false and no result).
    """
    pattern = r"(?s)^([a-z]+?)(|[0-9]+|all):(.+)$"
    many = F.regexp_extract("text", pattern, 2)
    n = F.when(many == "", 1).when(many == "all", max_results).otherwise(F.least(many.try_cast("int"), F.lit(max_results)))
    q = queries.withColumn("search_key", F.regexp_extract("text", pattern, 1)).withColumn("query", F.regexp_extract("text", pattern, 3))
    q = q.withColumn("n", n).withColumn("valid", F.col("text").rlike(r"(?s)^[a-z]+?(|[1-9][0-9]*|all):.+$"))
    ranked = skew.numbered(results.join(q.select("search_key", "query").distinct(), ["search_key", "query"], "left_semi"),
                           ["search_key", "query"], [F.col("pos")], "place", sizes=results)
    top = ranked.filter(F.col("place") <= max_results).select("search_key", "query", "place", F.col("url").alias("result_url"))
    out = q.join(top, ["search_key", "query"], "left")
    keep = (F.col("place") <= F.col("n")) & F.col("valid")
    hits = out.filter(keep)
    bad = q.filter(~F.col("valid")).select(*q.columns, F.lit(None).cast("bigint").alias("place"),
                                           F.lit(None).cast("string").alias("result_url"))
    return hits.unionByName(bad)


def list_suitable(catalog: DataFrame, tests: DataFrame, age: int | None) -> DataFrame:
    """Catalogue entries fit for an age: without tests, or with any unrestricted one; by name."""
    limit = F.col("age_limit")
    free = F.lit(True) if age is None else F.coalesce(limit <= age, F.lit(True))
    t = tests.groupBy("extractor_key").agg(F.bool_or(free).alias("__free"))
    out = catalog.join(t, "extractor_key", "left").filter(F.coalesce("__free", F.lit(True))).drop("__free")
    return out.orderBy(F.lower("extractor_key"), "extractor_key")


def derive_akamai(df: DataFrame, col: str = "url") -> DataFrame:
    """HDS and HLS manifest URLs of an Akamai-style manifest URL."""
    c = F.col(col)
    plain = F.regexp_replace(F.regexp_replace(c, r"(?:b=[\d,-]+|(?:__a__|attributes)=off|__b__=\d+)&?", ""), r"^\?+|\?+$", "")
    u = F.when(c.contains("hdnea="), c).otherwise(plain)
    sign = "hdcore=3.7.0"
    hds = F.replace(F.regexp_replace(u, r"(https?://[^/]+)/i/", "$1/z/"), F.lit("/master.m3u8"), F.lit("/manifest.f4m"))
    hds = F.when(hds.contains("hdcore="), hds).otherwise(
        F.concat(hds, F.when(hds.contains("?"), F.lit("&")).otherwise(F.lit("?")), F.lit(sign)))
    hls = F.replace(F.regexp_replace(u, r"(https?://[^/]+)/z/", "$1/i/"), F.lit("/manifest.f4m"), F.lit("/master.m3u8"))
    row = lambda k, x: F.struct(F.lit(k).alias("kind"), x.alias("derived_url"))
    return df.select("*", F.inline(F.array(row("hds", hds), row("hls", hls))))


def derive_wowza(df: DataFrame, col: str = "url") -> DataFrame:
    """Manifest and stream URLs of a Wowza-style URL."""
    c = F.regexp_replace(F.col(col), r"/(?:manifest|playlist|jwplayer)\.(?:m3u8|f4m|mpd|smil)", "")
    query = F.regexp_extract(F.col(col), r"^[^?#]*\?([^#]*)", 1)
    base = F.regexp_extract(c, r"(?:(?:http|rtmp|rtsp)s?:)?(//[^?]+)", 1)
    secure = F.regexp_extract(c, r"(?:http|rtmp|rtsp)(s?)://", 1)
    web = F.concat(F.lit("http"), secure, F.lit(":"), base)
    m = lambda kind, name: F.struct(F.lit(kind).alias("kind"), F.concat(
        web, F.lit("/" + name), F.when(query != "", F.concat(F.lit("?"), query)).otherwise(F.lit(""))).alias("derived_url"))
    s = lambda p: F.struct(F.lit(p).alias("kind"), F.concat(F.lit(p + ":"), base).alias("derived_url"))
    common = [m("hls", "playlist.m3u8"), m("hds", "manifest.f4m"), m("dash", "manifest.mpd")]
    with_smil = F.array(*common, m("smil", "jwplayer.smil"))
    rows = F.when(base.rlike(r"(?:/smil:|\.smil)"), with_smil).otherwise(F.array(*common, s("rtmp"), s("rtsp")))
    return df.select("*", F.inline(rows))
