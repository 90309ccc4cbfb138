"""Reading and writing stored records, pages, manifests, feeds and archives (family A)."""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession, functions as F, types as T

from ..functions import urls as ux, values as vx
from ..functions.core import once
from ..operators.manifests import XML_OPTIONS, fixed


def read_url_list(spark: SparkSession, path: str) -> DataFrame:
    """URLs of a batch list: marks, blanks and lines that start with ``#``, ``;`` or ``]`` are left out."""
    line = F.regexp_replace("value", r"^(?:\x{FEFF}|\x{EF}\x{BB}\x{BF})", "")
    line = F.regexp_replace(line, r"(?U)^\s+|\s+$", "")
    return spark.read.text(path).select(line.alias("url")).filter((F.col("url") != "") & ~F.col("url").rlike(r"^[#;\]]"))


_PRIVATE = ("requested_formats", "requested_subtitles")


def read_info_json(spark: SparkSession, path: str, schema: T.StructType | str) -> DataFrame:
    """Stored records, one JSON object per line.

    Fields of the schema become columns; other keys stay in ``extra MAP<STRING, VARIANT>``, without null
    values, keys that start with two underscores, and bookkeeping fields.
    """
    fields = (T._parse_datatype_string(schema) if isinstance(schema, str) else schema).fields
    raw = spark.read.option("singleVariantColumn", "v").json(path)
    cols = [F.try_variant_get("v", f"$.{f.name}", f.dataType.simpleString()).alias(f.name) for f in fields]
    known = F.array(*[F.lit(f.name) for f in fields])
    every = F.try_variant_get("v", "$", "map<string,variant>")
    extra = F.map_filter(every, lambda k, v: ~F.array_contains(known, k) & ~k.startswith("__") & ~k.isin(*_PRIVATE)
                         & v.isNotNull() & (F.schema_of_variant(v) != "VOID"))
    return raw.select(*cols, extra.alias("extra"))


def read_pages(spark: SparkSession, path: str) -> DataFrame:
    """Stored pages ``(page_id, url, html)``; the parquet scan reads only the columns a job uses."""
    return spark.read.parquet(path)


#: Options for writing very many small files: in a local or mounted folder no checksum file beside each, as Hadoop starts a process
#: for every file that it creates there without its native library. They change nothing for other stores.
MANY_FILES = {"fs.file.impl": "org.apache.hadoop.fs.RawLocalFileSystem", "fs.file.impl.disable.cache": "true"}
#: Tasks a core that read a folder of manifests, at most.
READ_TASKS = 32


def read_manifests(spark: SparkSession, path: str, base: str = "") -> DataFrame:
    """One row per manifest file: its path as id, and ``base`` with the file's name as URL.

    Spark gives a task a few files only, however small they are; beyond ``READ_TASKS`` tasks a core they are put together.
    """
    name = F.col("_metadata.file_path")
    d = spark.read.option("recursiveFileLookup", "true").text(path, wholetext=True)
    d = d.select(name.alias("manifest_id"), F.concat(F.lit(base), F.regexp_extract(name, r"([^/]+)$", 1)).alias("url"),
                 F.col("value").alias("body"))
    most = READ_TASKS * spark.sparkContext.defaultParallelism
    return d.coalesce(most) if d.rdd.getNumPartitions() > most else d


def write_packed_manifests(manifests: DataFrame, path: str) -> None:
    """Manifests (``url``, ``body``) as JSON lines, many to a file and spread evenly: a corpus of small texts without as many small files."""
    manifests.select("url", "body").write.option("compression", "gzip").json(path)


def read_packed_manifests(spark: SparkSession, path: str) -> DataFrame:
    """One row per line of such files; the URL is the id (A04). Lines that are no JSON object give no row."""
    d = spark.read.schema("url string, body string").option("mode", "DROPMALFORMED").json(path)
    return d.filter("url IS NOT NULL AND body IS NOT NULL").select(F.col("url").alias("manifest_id"), "url", "body")


_RSS = ("channel struct<title string,description string,item array<struct<title string,description string,link string,pubDate string,"
        "enclosure array<struct<_url string>>,`itunes:duration` string,`itunes:explicit` string,`itunes:title` string,`itunes:episode` string,"
        "`itunes:season` string,`itunes:image` struct<_href string>>>>")


def parse_rss(feeds: DataFrame) -> DataFrame:
    """Feed items as ``url_transparent`` rows (A05), over ``feeds(feed_id, url, body)``.

    The first enclosure with a URL counts, else the link; an item with neither is dropped.
    """
    x = feeds.select("feed_id", F.col("url").alias("feed_url"), once(F.from_xml(fixed(F.col("body")), _RSS, {})).alias("x"))
    d = x.select("feed_id", "feed_url", F.col("x.channel.title").alias("playlist_title"), F.posexplode("x.channel.item").alias("pos", "i"))
    i = F.col("i")
    urls = F.filter(i["enclosure"], lambda e: F.coalesce(e["_url"], F.lit("")) != "")
    link = F.coalesce(F.try_element_at(urls, F.lit(1))["_url"], F.nullif(i["link"], F.lit("")))
    explicit = F.lower(F.coalesce(i["itunes:explicit"], F.lit("")))
    whole = lambda k: vx.int_or_null(i[k])
    length = F.coalesce(F.nullif(whole("itunes:duration"), F.lit(0)).cast("double"), vx.duration(i["itunes:duration"]))
    return d.select(
        "feed_id", "playlist_title", "pos", F.lit("url_transparent").alias("type"), link.alias("url"), i["title"].alias("title"),
        i["description"].alias("description"), vx.timestamp(i["pubDate"]).alias("timestamp"), length.alias("duration"),
        ux.valid(i["itunes:image"]["_href"]).alias("thumbnail"), i["itunes:title"].alias("episode"), whole("itunes:episode").alias("episode_number"),
        whole("itunes:season").alias("season_number"),
        F.when(explicit.isin("true", "yes"), 18).when(explicit.isin("false", "no"), 0).alias("age_limit")).filter(F.col("url").isNotNull())


def read_archive(spark: SparkSession, path: str) -> DataFrame:
    """Set of archive ids; a missing file is an empty set."""
    try:
        lines = spark.read.text(path)
    except AnalysisException as e:
        if "PATH_NOT_FOUND" not in str(e):
            raise
        return spark.createDataFrame([], "archive_id string")
    ids = F.regexp_replace("value", r"(?U)^\s+|\s+$", "")
    return lines.select(ids.alias("archive_id")).filter("archive_id <> ''").distinct()


def append_archive(df: DataFrame, path: str) -> None:
    """Append archive ids of accepted items, one per line (A08); filter known ones with ``skip_archived`` first."""
    from ..operators.playlists import archive_key
    ids = df.select(F.col("archive_id").alias("value")) if "archive_id" in df.columns else df.select(archive_key(df).alias("value"))
    ids.filter("value IS NOT NULL").write.mode("append").text(path)


def nest_records(media: DataFrame, parts: dict) -> DataFrame:
    """Records with nested lists, one JSON text per item whatever the size of its lists.

    ``parts`` maps a field to a long table ``(media_id, pos, ...)``. Null values, keys that start with two
    underscores and bookkeeping fields are left out. A record is a cell: its lists must fit into a task's memory.
    """
    keep = [c for c in media.columns if not c.startswith("__") and c not in _PRIVATE]
    out = media.select(*keep)
    for name, d in parts.items():
        cols = [c for c in d.columns if c not in ("media_id", "pos") and not c.startswith("__")]
        g = d.groupBy("media_id").agg(F.array_sort(F.collect_list(F.struct("pos", F.struct(*cols).alias("v")))).alias("l"))
        out = out.join(g.select("media_id", F.transform("l", lambda x: x["v"]).alias(name)), "media_id", "left")
    fields = [c for c in out.columns if c != "media_id"]
    return out.select("media_id", F.to_json(F.struct(*fields), {"ignoreNullFields": "true"}).alias("value"))


def write_info_json(media: DataFrame, path: str, parts: dict | None = None) -> None:
    """Write records as JSON lines."""
    nest_records(media, parts or {}).select("value").write.mode("overwrite").text(path)


def export_fields(df: DataFrame, fields) -> DataFrame:
    """Chosen fields of items as ``(media_id, place, field, value)`` rows in the order asked for.

    Optional fields that are null give no row. ``incomplete`` items also skip mandatory ones that are null
    and have no URL; a merged item (``part_urls``) gives one URL row per part.
    """
    from ..functions.text import clock
    have = set(df.columns)
    shown = []
    for place, name in enumerate(fields):
        if name == "url":
            play = F.coalesce(F.col("play_path"), F.lit("")) if "play_path" in have else F.lit("")
            one = F.array(F.concat(F.col("url"), play)) if "url" in have else F.array().cast("array<string>")
            urls = F.coalesce(F.col("part_urls"), one) if "part_urls" in have else one
            if "incomplete" in have:
                urls = F.when(F.col("incomplete"), F.array().cast("array<string>")).otherwise(urls)
            values = F.filter(urls, lambda u: u.isNotNull())
        else:
            value = clock(F.col(name)) if name == "duration" else F.col(name).cast("string")
            values = F.filter(F.array(value), lambda v: v.isNotNull())
            if name in ("title", "id", "format"):
                full = ~F.coalesce(F.col("incomplete"), F.lit(False)) if "incomplete" in have else F.lit(True)
                values = F.when(full & F.col(name).isNull(), F.array(F.lit("NA"))).otherwise(values)
        shown.append(F.transform(values, _line(place, name)))
    return df.select("media_id", F.explode(F.flatten(F.array(*shown))).alias("r")).select("media_id", "r.place", "r.field", "r.value")


def _line(place, name):
    return lambda v, i: F.struct((F.lit(place * 1000) + i).alias("place"), F.lit(name).alias("field"), v.alias("value"))
