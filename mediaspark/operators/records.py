"""Cleaning, merging and checking metadata records (family E)."""

from __future__ import annotations

import re
import unicodedata
from functools import cache, reduce

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from .. import skew
from ..functions import paths as px, text as tx, urls as ux, values as vx
from ..functions.core import let

# Fields that hold numbers.
NUMERIC_FIELDS = ["width", "height", "tbr", "abr", "asr", "vbr", "fps", "filesize", "filesize_approx", "timestamp",
                  "upload_year", "upload_month", "upload_day", "available_at", "duration", "view_count", "like_count",
                  "dislike_count", "repost_count", "average_rating", "comment_count", "age_limit", "start_time",
                  "end_time", "chapter_number", "season_number", "episode_number", "track_number", "disc_number",
                  "release_year", "playlist_index"]


def extract_paths(df: DataFrame, col: str, wanted: dict, casesense: bool = True) -> DataFrame:
    """Add one column per name from alternative paths into a JSON column.

    ``wanted`` maps a name to ``(paths, type)``. The JSON is parsed once per row.
    """
    v = df.withColumn("__v", F.try_parse_json(F.col(col)))
    return v.select(*df.columns, *[px.extract(F.col("__v"), ps, kind, casesense=casesense).alias(n)
                                   for n, (ps, kind) in wanted.items()])


def first_of(df: DataFrame, name: str, keys, skip_false: bool = True) -> DataFrame:
    """First usable value among columns; empty text and zero are passed over too if told so."""
    def usable(k):
        c, kind = F.col(k), dict(df.dtypes)[k]
        if not skip_false:
            return c
        if kind == "string":
            return F.nullif(c, F.lit(""))
        return F.nullif(c, F.lit(False)) if kind == "boolean" else F.when(c != 0, c)
    return df.withColumn(name, F.coalesce(*[usable(k) for k in keys]))


def merge_records(dfs, key: str) -> DataFrame:
    """Merge records of several sources by precedence.

    Per field the first non-null value wins, but an empty text yields to a later non-empty one. One
    aggregate over the stacked sources, combined on the map side.
    """
    cols = list(dict.fromkeys(c for d in dfs for c in d.columns if c != key))
    stacked = reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True),
                     [d.withColumn("__ord", F.lit(i)) for i, d in enumerate(dfs)])
    kinds = dict(stacked.dtypes)

    def pick(c):
        blank = F.when(F.col(c) == "", 1).otherwise(0) if kinds[c] == "string" else F.lit(0)
        return F.min_by(F.col(c), F.when(F.col(c).isNotNull(), F.struct(blank, F.col("__ord")))).alias(c)
    return stacked.groupBy(key).agg(*[pick(c) for c in cols])


def add_defaults(df: DataFrame, defaults: dict) -> DataFrame:
    """Set fields only where they are absent (E04); values are columns or literals."""
    out = df
    for name, value in defaults.items():
        value = value if isinstance(value, Column) else F.lit(value)
        out = out.withColumn(name, F.coalesce(F.col(name), value) if name in df.columns else value)
    return out


def validate(media: DataFrame, formats: DataFrame) -> DataFrame:
    """Add ``reason``: null for records that have id, title and a usable rendition."""
    good = formats.filter(F.col("url").isNotNull() & (F.col("url") != "")).select(F.col("media_id").alias("__m")).distinct()
    out = media.join(good, media["media_id"] == good["__m"], "left")
    reason = (F.when(F.col("id").isNull(), F.lit('missing "id"')).when(F.col("title").isNull(), F.lit('missing "title"'))
              .when(F.col("__m").isNull(), F.lit("no formats found")))
    return out.withColumn("reason", reason).drop("__m")


def coerce_numeric(df: DataFrame, fields=None) -> DataFrame:
    """Force text in numeric fields to whole numbers, or null."""
    kinds = dict(df.dtypes)
    names = [c for c in (fields or NUMERIC_FIELDS) if kinds.get(c) == "string"]
    return df.withColumns({c: vx.int_or_null(F.col(c)) for c in names}) if names else df


def coercion_failures(df: DataFrame, fields=None) -> DataFrame:
    """Per numeric field: values present, and values that could not be read as numbers."""
    kinds = dict(df.dtypes)
    names = [c for c in (fields or NUMERIC_FIELDS) if kinds.get(c) == "string"]
    aggs = [F.struct(F.lit(c).alias("field"), F.count(c).alias("present"),
                     F.count_if(F.col(c).isNotNull() & vx.int_or_null(F.col(c)).isNull()).alias("failed")).alias(c)
            for c in names]
    return df.agg(F.array(*aggs).alias("a")).select(F.inline("a"))


def fill_common(df: DataFrame) -> DataFrame:
    """Fields that follow from others: dates from timestamps, numbered titles, display id."""
    have = set(df.columns)
    text = lambda c: F.col(c) if c in have else F.lit(None).cast("string")
    new = {}
    for ts, day in (("timestamp", "upload_date"), ("release_timestamp", "release_date")):
        if ts in have:
            moment = F.timestamp_seconds(F.col(ts))
            new[day] = F.coalesce(text(day), F.date_format(moment, "yyyyMMdd"))
    for name in ("chapter", "season", "episode"):
        n = f"{name}_number"
        if n in have:
            made = F.concat(F.lit(f"{name.capitalize()} "), F.col(n).cast("bigint").cast("string"))
            new[name] = F.coalesce(F.nullif(text(name), F.lit("")), made, text(name))
    if "id" in have:
        new["display_id"] = F.coalesce(text("display_id"), F.col("id"))
    return df.withColumns(new)


def rank_thumbnails(df: DataFrame) -> DataFrame:
    """Number thumbnails from worst (0), repair URLs, name the nameless and tell the resolution."""
    opt = lambda c, kind: F.col(c) if c in df.columns else F.lit(None).cast(kind)
    order = [F.coalesce(opt(c, "int"), F.lit(-1)) for c in ("preference", "width", "height")]
    order += [F.coalesce(opt("id", "string"), F.lit("")), F.col("url"), F.col("pos")]
    out = skew.numbered(df, "media_id", order, "rank")
    w, h = opt("width", "int"), opt("height", "int")
    size = F.when((w != 0) & (h != 0), F.concat(w.cast("string"), F.lit("x"), h.cast("string")))
    return (out.withColumn("rank", F.col("rank") - 1).withColumn("url", ux.sanitize(F.col("url")))
            .withColumn("id", F.coalesce(opt("id", "string"), F.col("rank").cast("string")))
            .withColumn("resolution", size))


def choose_thumbnail(media: DataFrame, ranked: DataFrame) -> DataFrame:
    """The item's own thumbnail, else the best ranked one."""
    best = ranked.groupBy("media_id").agg(F.max_by("url", "rank").alias("__t"))
    own = ux.sanitize(F.nullif(F.col("thumbnail"), F.lit(""))) if "thumbnail" in media.columns else F.lit(None).cast("string")
    return media.join(best, "media_id", "left").withColumn("thumbnail", F.coalesce(own, F.col("__t"))).drop("__t")


def fields_from_title(df: DataFrame, pattern: str) -> DataFrame:
    """Fields read from titles by a spelled pattern, ``%(artist)s - %(title)s``, or a regex with named groups."""
    if re.search(r"%\(\w+\)s", pattern):
        pieces = re.split(r"%\((\w+)\)s", pattern)
        names = pieces[1::2]
        regex = "".join(re.escape(p) if i % 2 == 0 else "(.+)" for i, p in enumerate(pieces))
        groups = {n: i for i, n in enumerate(names, 1)}
    else:
        regex = pattern
        groups = re.compile(pattern).groupindex
        regex = re.sub(r"\(\?P<\w+>", "(", regex)
    regex = "^(?:" + regex + ")"
    hit = F.col("title").rlike(regex)
    got = {n: F.nullif(F.regexp_extract("title", regex, i), F.lit("")) for n, i in groups.items()}
    return df.withColumns({n: F.when(F.coalesce(hit, F.lit(False)), F.coalesce(c, F.col(n) if n in df.columns else F.lit(None)))
                           .otherwise(F.col(n) if n in df.columns else F.lit(None)) for n, c in got.items()})


# Container tags and the record fields they are taken from, in order of choice.
TAGS = {"title": ["track", "title"], "date": ["upload_date"], "description": ["description"], "comment": ["description"],
        "purl": ["webpage_url"], "track": ["track_number"], "artist": ["artist", "creator", "uploader", "uploader_id"],
        "genre": ["genre"], "album": ["album"], "album_artist": ["album_artist"], "disc": ["disc_number"],
        "show": ["series"], "season_number": ["season_number"], "episode_id": ["episode", "episode_id"],
        "episode_sort": ["episode_number"]}


def map_tags(df: DataFrame, key: str = "media_id") -> DataFrame:
    """Tag rows ``(key, tag, value)`` of each record; every tag takes its first present field."""
    pairs = [F.struct(F.lit(tag).alias("tag"), F.coalesce(*[F.col(c).cast("string") for c in cols if c in df.columns])
                      .alias("value")) for tag, cols in TAGS.items() if any(c in df.columns for c in cols)]
    return df.select(key, F.inline(F.array(*pairs))).filter(F.col("value").isNotNull())


def build_chapters(raw: DataFrame, media: DataFrame) -> DataFrame:
    """Chapters with ends: the start of the next raw entry, or the item's duration for the last.

    ``raw(media_id, pos, start_time, title)`` with dense 0-based ``pos``. The next entry is found by an
    equi-join on ``(media_id, pos)``, so no item's chapters have to meet in one task.
    """
    nxt = raw.select("media_id", (F.col("pos") - 1).alias("pos"), F.col("start_time").alias("__next"), F.lit(True).alias("__has"))
    out = raw.join(nxt, ["media_id", "pos"], "left").join(media.select("media_id", "duration"), "media_id", "left")
    end = F.when(F.col("__has"), F.col("__next")).otherwise(F.col("duration"))
    return (out.withColumn("end_time", end).filter(F.col("start_time").isNotNull() & F.col("end_time").isNotNull())
            .select("media_id", "pos", "start_time", "end_time", "title"))


# Letters with marks and what stands for them in plain ASCII names.
ACCENTS = "ÂÃÄÀÁÅÇÈÉÊËÌÍÎÏÐÑÒÓÔÕÖŐØÙÚÛÜŰÝàáâãäåçèéêëìíîïðñòóôõöőøùúûüűýÿ"
ACCENTS_PLAIN = "AAAAAACEEEEIIIIDNOOOOOOOUUUUUYaaaaaaceeeeiiiionooooooouuuuuyy"
LIGATURES = {"Æ": "AE", "Œ": "OE", "Þ": "TH", "ß": "ss", "æ": "ae", "œ": "oe", "þ": "th"}


@cache
def _look_alikes() -> tuple[str, str, dict[str, str]]:
    """Compatibility forms by rule: letters that stand for one plain letter each, and ligatures and signs that stand for several.

    Other compatibility forms end outside ASCII and are replaced like any other letter.
    """
    one, many = {}, {}
    for c in map(chr, [*range(0xA0, 0xD800), *range(0xF900, 0xFFF0), *range(0x1D400, 0x1D800)]):
        plain = unicodedata.normalize("NFKC", c)
        if plain != c and all(x.isascii() or x in ACCENTS for x in plain):
            if len(plain) == 1:
                one[c] = plain
            elif unicodedata.category(c) in ("Ll", "Lu", "So", "Po"):
                many[c] = plain
    latin = {c: p for c, p in many.items() if c <= "\u2122" or "\ufb00" <= c <= "\ufb06"}
    return "".join(one), "".join(one.values()), latin


def _plain_forms(s: Column) -> Column:
    source, plain, several = _look_alikes()
    out = F.translate(s, source, plain)
    for a, b in several.items():
        out = F.replace(out, F.lit(a), F.lit(b))
    return F.when(s.rlike(r"[^\x00-\x7f]"), out).otherwise(s)


def safe_name(text: Column, restricted: bool = False, is_id: bool = False) -> Column:
    """A text as a file name part."""
    if restricted and not is_id:
        text = let(text, _plain_forms)
    s = F.regexp_replace(text, r"(?<=[0-9]):(?=[0-9])", "_")
    if restricted:
        s = F.translate(s, ACCENTS, ACCENTS_PLAIN)
        for a, b in LIGATURES.items():
            s = F.replace(s, F.lit(a), F.lit(b))
    s = F.regexp_replace(s, r"[?\x00-\x1f\x7f]", "")
    s = F.regexp_replace(s, '"', "" if restricted else "'")
    s = F.regexp_replace(s, ":", "_-" if restricted else " -")
    s = F.regexp_replace(s, r"[\\/|*<>]", "_")
    if restricted:
        s = F.regexp_replace(s, r"(?U)[!&'()\[\]{}$;`^,#\s]", "_")
        s = F.regexp_replace(F.regexp_replace(s, r"[[^\x00-\x7f]&&[\p{C}\p{M}]]", ""), r"[^\x00-\x7f]", "_")
    if is_id:
        return s
    s = F.regexp_replace(F.regexp_replace(s, "__+", "_"), "^_+|_+$", "")
    if restricted:
        s = F.regexp_replace(s, "^-_", "")
    s = F.regexp_replace(F.regexp_replace(s, "^-", "_"), r"^\.+", "")
    return F.when(s == "", F.lit("_")).otherwise(s)


def safe_names(df: DataFrame, col: str, restricted: bool = False) -> DataFrame:
    is_id = col == "id" or col.endswith("_id")
    return df.withColumn(col, safe_name(F.col(col), restricted, is_id))


def autonumbered(df: DataFrame, order, start: int = 1) -> DataFrame:
    """Number all rows of a run in an explicit order; large runs are numbered slice by slice."""
    out = skew.numbered_all(df, order, "autonumber")
    return out.withColumn("autonumber", F.col("autonumber") + (start - 1))


def build_paths(df: DataFrame, parts, restricted: bool = False, missing: str = "NA") -> DataFrame:
    """Add ``path`` made of parts: ``("text", t)``, ``("field", name)``, ``("resolution",)``, ``("index",)`` or
    ``("autonumber",)`` (E12). Missing values give ``NA``, texts are made safe for file names."""
    kinds = dict(df.dtypes)
    opt = lambda c, kind: F.col(c) if c in kinds else F.lit(None).cast(kind)

    def field(name):
        c = F.col(name)
        if kinds[name] == "string":
            return safe_name(c, restricted, name == "id" or name.endswith("_id"))
        return c.cast("string")

    def padded(c, width):
        s = c.cast("string")
        return F.lpad(s, F.greatest(width, F.length(s)), F.lit("0"))
    w, h = F.nullif(opt("width", "int"), F.lit(0)), F.nullif(opt("height", "int"), F.lit(0))
    made = F.coalesce(F.concat(w.cast("string"), F.lit("x"), h.cast("string")), F.concat(h.cast("string"), F.lit("p")),
                      F.concat(w.cast("string"), F.lit("x?")))
    def piece(p):
        if p[0] == "text":
            return F.lit(p[1])
        if p[0] == "resolution":
            return safe_name(F.coalesce(opt("resolution", "string"), made), restricted)
        if p[0] == "index":
            # Without a known list length the width is that of the placeholder text.
            return padded(F.col("playlist_index"), F.length(F.coalesce(opt("n_entries", "bigint").cast("string"), F.lit(missing))))
        if p[0] == "autonumber":
            return padded(F.col("autonumber"), F.lit(5))
        return field(p[1]) if p[1] in kinds else F.lit(None).cast("string")
    return df.withColumn("path", F.concat(*[F.coalesce(piece(p), F.lit(missing)) for p in parts]))


def path_collisions(df: DataFrame, key: str = "media_id") -> DataFrame:
    """Paths built for more than one item."""
    return (df.groupBy("path").agg(F.count(F.lit(1)).alias("n"), F.min(key).alias("first_item"))
            .filter(F.col("n") > 1))


def release_assets(df: DataFrame, names: str = ".*") -> DataFrame:
    """Asset rows of nested releases with size text and download count."""
    a = df.select("tag", F.explode("assets").alias("a")).select("tag", "a.*")
    return a.filter(F.col("name").rlike(f"^(?:{names})")).select(
        "tag", "name", tx.human_bytes(F.col("size")).alias("size_text"), F.col("download_count").alias("downloads"))


def release_traffic(df: DataFrame) -> DataFrame:
    """Total bytes sent for all releases (E15); a decimal, because the sum passes the range of bigint long before its terms do."""
    a = df.select(F.explode("assets").alias("a")).select("a.*")
    total = F.sum(F.col("download_count").cast("decimal(19,0)") * F.col("size").cast("decimal(19,0)")).cast("decimal(38,0)")
    return a.agg(total.alias("total_bytes"), tx.human_bytes(total).alias("total_text"))


def normalise_fields(df: DataFrame, kinds: dict) -> DataFrame:
    """Add ``<col>_value`` for each column by its kind of text."""
    return df.withColumns({f"{c}_value": vx.KINDS[k](F.col(c)) for c, k in kinds.items()})


def parse_rates(df: DataFrame, kinds: dict, source: str) -> DataFrame:
    """Per source and column: texts present and texts that gave a value."""
    rows = F.array(*[F.struct(F.lit(c).alias("field"), F.col(c).isNotNull().alias("p"),
                              vx.usable(k, vx.KINDS[k](F.col(c))).alias("ok")) for c, k in kinds.items()])
    return (df.select(source, F.inline(rows)).groupBy(source, "field")
            .agg(F.count_if("p").alias("present"), F.count_if(F.col("p") & F.col("ok")).alias("parsed")))


def language_table(spark) -> DataFrame:
    """(code2, code3) of the JVM's ISO 639 list, about 190 rows."""
    loc = spark._jvm.java.util.Locale
    rows = []
    for c in loc.getISOLanguages():
        if len(c) == 2:
            rows.append((c, loc.forLanguageTag(c).getISO3Language()))
    return spark.createDataFrame(rows, "code2 string, code3 string")


def country_table(spark) -> DataFrame:
    """(code, name) of the JVM's ISO 3166 list, about 250 rows; any table of this shape may take its place."""
    loc = spark._jvm.java.util.Locale
    rows = [(c, loc.forLanguageTag(f"und-{c}").getDisplayCountry(loc.ENGLISH)) for c in loc.getISOCountries()]
    return spark.createDataFrame(rows, "code string, name string")


def language_codes(df: DataFrame, col: str, table: DataFrame) -> DataFrame:
    """Add ``<col>_3`` (from a code that starts with two letters) and ``<col>_2`` (from three letters)."""
    a = table.select(F.col("code2").alias("__a"), F.col("code3").alias(f"{col}_3"))
    b = table.select(F.col("code3").alias("__b"), F.col("code2").alias(f"{col}_2"))
    out = df.join(a, F.substring(df[col], 1, 2) == a["__a"], "left")
    return out.join(b, F.substring(out[col], 1, 3) == b["__b"], "left").drop("__a", "__b")


def country_names(df: DataFrame, col: str, table: DataFrame) -> DataFrame:
    """Add ``<col>_name`` from a country code in any case."""
    t = table.select(F.col("code").alias("__c"), F.col("name").alias(f"{col}_name"))
    return df.join(t, F.upper(df[col]) == t["__c"], "left").drop("__c")


def ordered_distinct(df: DataFrame, by, value: str, order) -> DataFrame:
    """First occurrence of each value per group."""
    by = [by] if isinstance(by, str) else list(by)
    return skew.first_per_group(df, [*by, value], order, df.columns).select(*df.columns)
