"""Queries of the field normalisers E20–E35: texts built from known numbers, read back."""

from pyspark.sql import functions as F

from ..fixtures import define, oracle
from ..functions import text as tx, values as vx
from ..operators import records as rc
from . import query

define("nums", """
SELECT o_orderkey AS k, o_custkey AS c, o_orderkey % 30 AS h, (o_orderkey * 7) % 60 AS m, (o_orderkey * 13) % 60 AS s, o_orderdate AS d,
  concat('site', o_orderkey % 4) AS source FROM {orders}""")


def value_query(name, kind, text_sql, value_sql, finish=None):
    """Register a query that builds texts from numbers, normalises them, and whose SQL knows the numbers."""
    table = f"text_{name.lower()}"
    define(table, f"SELECT k, {text_sql} AS txt FROM {{nums}}")
    cols = value_sql if isinstance(value_sql, dict) else {"value": value_sql}

    @query(name, oracle(f"SELECT k, {', '.join(f'{v} AS {c}' for c, v in cols.items())} FROM {{nums}}"))
    def _(t):
        out = rc.normalise_fields(t[table], {"txt": kind})
        return finish(out) if finish else out.select("k", F.col("txt_value").alias("value"))


CLOCK = "h * 3600 + m * 60 + s"
value_query("E20_duration", "duration", """CASE k % 8 WHEN 0 THEN concat(h, ':', lpad(CAST(m AS VARCHAR(2)), 2, '0'), ':', lpad(CAST(s AS VARCHAR(2)), 2, '0'))
  WHEN 1 THEN concat('PT', h, 'H', m, 'M', s, 'S') WHEN 2 THEN concat(h, ' hours ', m, ' mins ', s, ' secs') WHEN 3 THEN concat(m, '.5 mins')
  WHEN 4 THEN concat('P3Y2M1W', h, 'DT', m, 'H') WHEN 5 THEN concat(' ', s, '.25 ') WHEN 6 THEN concat(m, ':', lpad(CAST(s AS VARCHAR(2)), 2, '0'), '.5') ELSE 'n/a' END""",
            f"""CAST(CASE k % 8 WHEN 0 THEN {CLOCK} WHEN 1 THEN {CLOCK} WHEN 2 THEN {CLOCK} WHEN 3 THEN (m + 0.5) * 60
  WHEN 4 THEN h * 86400 + m * 3600 WHEN 5 THEN s + 0.25 WHEN 6 THEN m * 60 + s + 0.5 END AS DOUBLE)""")
value_query("E21_filesize", "filesize", """CASE k % 7 WHEN 0 THEN concat(c, ' MiB') WHEN 1 THEN concat(c, 'KB') WHEN 2 THEN concat(c, ',5 GB') WHEN 3 THEN concat(c, ' kilobytes')
  WHEN 4 THEN concat(c, '.25kB left') WHEN 5 THEN concat(c, ' b') ELSE concat('about ', c, 'MB') END""",
            """CAST(CASE k % 7 WHEN 0 THEN c * 1048576 WHEN 1 THEN c * 1000 WHEN 2 THEN (c + 0.5) * 1000000000 WHEN 3 THEN c * 1000 WHEN 4 THEN (c + 0.25) * 1024 WHEN 5 THEN c END AS BIGINT)""")
value_query("E22_count", "count", """CASE k % 6 WHEN 0 THEN concat(c, ',', lpad(CAST(m AS VARCHAR(3)), 3, '0')) WHEN 1 THEN concat(c, '.5k') WHEN 2 THEN concat(c, 'M views')
  WHEN 3 THEN concat(' ', c, 'kk') WHEN 4 THEN concat(c, '.000') ELSE concat(c, ' views') END""",
            """CAST(CASE k % 6 WHEN 0 THEN c * 1000 + m WHEN 1 THEN (c + 0.5) * 1000 WHEN 2 THEN c * 1000000 WHEN 3 THEN c * 1000000 WHEN 4 THEN c * 1000 END AS BIGINT)""")
value_query("E23_resolution", "resolution", """CASE k % 5 WHEN 0 THEN concat('HD ', c, 'x', m) WHEN 1 THEN concat(c, ' × ', m) WHEN 2 THEN concat('webm ', m, 'p60? ', m, 'p') WHEN 3 THEN '4K (best)' ELSE 'audio' END""",
            {"width": "CAST(CASE WHEN k % 5 < 2 THEN c END AS INTEGER)", "height": "CAST(CASE k % 5 WHEN 0 THEN m WHEN 1 THEN m WHEN 2 THEN m WHEN 3 THEN 2160 END AS INTEGER)"},
            lambda d: d.select("k", "txt_value.width", "txt_value.height"))
value_query("E24_bitrate", "bitrate", "CASE k % 3 WHEN 0 THEN concat('mp3 ', c, 'kbps') WHEN 1 THEN concat(c, ' kbps stereo') ELSE concat(c, ' bps') END",
            "CAST(CASE WHEN k % 3 < 2 THEN c END AS INTEGER)")
DAY, MON = "lpad(CAST(day(d) AS VARCHAR(2)), 2, '0')", "lpad(CAST(month(d) AS VARCHAR(2)), 2, '0')"
NAME = "CASE month(d) " + " ".join(f"WHEN {i} THEN '{m.capitalize()}'" for i, m in enumerate(vx.MONTHS, 1)) + " END"
DATE_TEXT = f"""CASE k % 8 WHEN 0 THEN concat(year(d), '-', {MON}, '-', {DAY}) WHEN 1 THEN concat(day(d), ' ', {NAME}, ' ', year(d))
  WHEN 2 THEN concat({NAME}, ' ', day(d), ', ', year(d)) WHEN 3 THEN concat(day(d), '.', month(d), '.', year(d)) WHEN 4 THEN concat({DAY}, '/', {MON}, '/', year(d))
  WHEN 5 THEN concat(substring({NAME}, 1, 3), ' ', day(d), 'th ', year(d)) WHEN 6 THEN concat(year(d), '/', {MON}, '/', {DAY}, ' 10:15 PM') ELSE 'soon' END"""
value_query("E25_strdate", "strdate", DATE_TEXT, f"CASE WHEN k % 8 < 7 THEN concat(year(d), {MON}, {DAY}) END")
EPOCH = "epoch(CAST(CAST(d AS DATE) AS TIMESTAMP))"
value_query("E26_timestamp", "timestamp", f"""CASE k % 7 WHEN 0 THEN concat(year(d), '-', {MON}, '-', {DAY}, ' 05:06:07') WHEN 1 THEN concat(year(d), '-', {MON}, '-', {DAY}, 'T05:06:07.123456789Z')
  WHEN 2 THEN concat('Sun, ', {DAY}, ' ', substring({NAME}, 1, 3), ' ', year(d), ' 05:06:07 +0200') WHEN 3 THEN concat({NAME}, ' ', day(d), ', ', year(d), ' at 05:06')
  WHEN 4 THEN concat(year(d), '/', {MON}, '/', {DAY}, ' 12:30 PM') WHEN 5 THEN concat(year(d), '-', {MON}, '-', {DAY}, ' 05:06 EST') ELSE concat({DAY}, '/', {MON}, '/', year(d)) END""",
            f"""CAST(CASE k % 7 WHEN 0 THEN {EPOCH} + 18367 WHEN 1 THEN {EPOCH} + 18367 WHEN 2 THEN {EPOCH} + 18367 - 7200 WHEN 3 THEN {EPOCH} + 18360
  WHEN 4 THEN {EPOCH} + 45000 + 43200 WHEN 5 THEN {EPOCH} + 18360 + 18000 ELSE {EPOCH} END AS BIGINT)""")
value_query("E27_iso8601", "iso8601", f"""CASE k % 4 WHEN 0 THEN concat(year(d), '-', {MON}, '-', {DAY}, 'T05:06:07Z') WHEN 1 THEN concat(year(d), '-', {MON}, '-', {DAY}, 'T05:06:07.99+01:30')
  WHEN 2 THEN concat(year(d), '-', {MON}, '-', {DAY}, 'T05:06:07') ELSE concat(year(d), '-', {MON}, '-', {DAY}) END""",
            f"CAST(CASE k % 4 WHEN 0 THEN {EPOCH} + 18367 WHEN 1 THEN {EPOCH} + 18367 - 5400 WHEN 2 THEN {EPOCH} + 18367 END AS BIGINT)")
value_query("E28_codecs", "codecs", """CASE k % 7 WHEN 0 THEN 'avc1.77.30, mp4a.40.2' WHEN 1 THEN concat('mp4a.40.', c) WHEN 2 THEN 'av01.0.05M.10' WHEN 3 THEN concat('x', c, ', y', c)
  WHEN 4 THEN 'vp09.02.10, Opus' WHEN 5 THEN 'dvh1.05.01,ec-3' ELSE 'unknown' END""",
            {"vcodec": "CASE k % 7 WHEN 0 THEN 'avc1.77.30' WHEN 1 THEN 'none' WHEN 2 THEN 'av01.0.05M.10' WHEN 3 THEN concat('x', c) WHEN 4 THEN 'vp09.02.10' WHEN 5 THEN 'dvh1.05.01' END",
             "acodec": "CASE k % 7 WHEN 0 THEN 'mp4a.40.2' WHEN 1 THEN concat('mp4a.40.', c) WHEN 2 THEN 'none' WHEN 3 THEN concat('y', c) WHEN 4 THEN 'opus' WHEN 5 THEN 'ec-3' END",
             "dynamic_range": "CASE k % 7 WHEN 2 THEN 'HDR10' WHEN 4 THEN 'HDR10' WHEN 5 THEN 'DV' END"},
            lambda d: d.select("k", "txt_value.*"))
value_query("E29_mime_ext", "mime_ext", """CASE k % 6 WHEN 0 THEN 'audio/mp4' WHEN 1 THEN 'application/x-mpegURL' WHEN 2 THEN 'video/mp4; charset=x' WHEN 3 THEN concat('video/x', c) WHEN 4 THEN 'text/ttml+xml;codecs="a"' ELSE 'audio/mpeg' END""",
            "CASE k % 6 WHEN 0 THEN 'm4a' WHEN 1 THEN 'm3u8' WHEN 2 THEN 'mp4' WHEN 3 THEN concat('x', c) WHEN 4 THEN 'ttml' ELSE 'mp3' END")
value_query("E30_age_limit", "age_limit", "CASE k % 7 WHEN 0 THEN CAST(h AS VARCHAR(3)) WHEN 1 THEN concat(h, '+') WHEN 2 THEN 'PG-13' WHEN 3 THEN 'TV-14' WHEN 4 THEN 'TV_MA' WHEN 5 THEN 'X' ELSE 'NC' END",
            "CAST(CASE k % 7 WHEN 0 THEN CASE WHEN h <= 21 THEN h END WHEN 1 THEN h WHEN 2 THEN 13 WHEN 3 THEN 14 WHEN 4 THEN 17 WHEN 6 THEN 18 END AS INTEGER)")

define("coded", """
SELECT doc_id, lang, CASE lang WHEN 'en' THEN 'eng' WHEN 'de' THEN 'deu' WHEN 'fr' THEN 'fra' WHEN 'es' THEN 'spa' ELSE 'zzz' END AS lang3,
  CASE lang WHEN 'en' THEN 'gb' WHEN 'de' THEN 'DE' WHEN 'fr' THEN 'fr' WHEN 'es' THEN 'Es' ELSE 'zz' END AS country FROM {documents}""")


@query("E31_language_codes", oracle("""
SELECT doc_id, CASE WHEN lang3 <> 'zzz' THEN lang3 END AS long_code, CASE WHEN lang3 <> 'zzz' THEN lang END AS short_code,
  CASE lower(country) WHEN 'gb' THEN 'United Kingdom' WHEN 'de' THEN 'Germany' WHEN 'fr' THEN 'France' WHEN 'es' THEN 'Spain' END AS country_name FROM {coded}"""))
def _(t):
    langs = rc.language_table(t.spark)
    out = rc.language_codes(rc.language_codes(t["coded"], "lang", langs), "lang3", langs)
    out = rc.country_names(out, "country", rc.country_table(t.spark))
    return out.select("doc_id", F.col("lang_3").alias("long_code"), F.col("lang3_2").alias("short_code"), "country_name")


@query("E32_human_text", oracle("""
SELECT k, CASE WHEN n IS NULL THEN 'N/A' WHEN n < 1024 THEN printf('%.2fB', n / 1.0) WHEN n < 1048576 THEN printf('%.2fKiB', n / 1024.0) WHEN n < 1073741824 THEN printf('%.2fMiB', n / 1048576.0) ELSE printf('%.2fGiB', n / 1073741824.0) END AS size,
  CASE WHEN c > 3600 THEN printf('%d:%02d:%02d', c // 3600, c % 3600 // 60, c % 60) WHEN c > 60 THEN printf('%d:%02d', c // 60, c % 60) ELSE CAST(c AS VARCHAR) END AS clock
FROM (SELECT k, c * 40 AS c, CASE k % 4 WHEN 0 THEN k WHEN 1 THEN k * 1000 WHEN 2 THEN k * 1000000 END AS n FROM {nums})"""))
def _(t):
    d = t.sql("SELECT k, c * 40 AS c, CASE k % 4 WHEN 0 THEN k WHEN 1 THEN k * 1000 WHEN 2 THEN k * 1000000 END AS n FROM {nums}")
    return d.select("k", tx.human_bytes(F.col("n")).alias("size"), tx.clock(F.col("c")).alias("clock"))


value_query("E33_jsonp", "jsonp", """CASE k % 4 WHEN 0 THEN concat('cb', c, '({"k": ', k, '});') WHEN 1 THEN concat('window.a && a({"k": ', k, '})') WHEN 2 THEN concat('$.f ( {"k": ', k, '} ) // end') ELSE concat('{"k": ', k, '}') END""",
            "CAST(k AS BIGINT)", lambda d: d.select("k", F.get_json_object("txt_value", "$.k").cast("bigint").alias("value")))


@query("E34_safe_cast", oracle("""
SELECT k, CASE k % 4 WHEN 0 THEN CAST(floor(-c / 7.0) AS BIGINT) WHEN 1 THEN CAST(floor(c / 7.0) AS BIGINT) END AS whole,
  CASE k % 4 WHEN 0 THEN CAST('-' || c AS DOUBLE) / 10.0 WHEN 1 THEN c / 10.0 WHEN 2 THEN (c + 0.5) / 10.0 END::DOUBLE AS real,
  CASE k % 4 WHEN 0 THEN '-' || c WHEN 1 THEN '' || c WHEN 2 THEN c || '.5' END AS plain, CASE k % 5 WHEN 0 THEN TRUE WHEN 1 THEN FALSE END AS flag FROM {nums}"""))
def _(t):
    d = t.sql("""SELECT k, CASE k % 4 WHEN 0 THEN concat('-', c) WHEN 1 THEN concat(' ', c) WHEN 2 THEN concat(c, '.5') ELSE ' ' END AS txt,
  CASE k % 5 WHEN 0 THEN 'true' WHEN 1 THEN 'false' ELSE '1' END AS word FROM {nums}""")
    return d.select("k", vx.int_or_null(F.col("txt"), scale=7).alias("whole"), vx.float_or_null(F.col("txt"), scale=10).alias("real"),
                    vx.text_or_null(F.col("txt")).alias("plain"), vx.bool_or_null(F.col("word")).alias("flag"))


@query("E35_quality_rank", oracle("""
SELECT media_id, pos, CASE protocol WHEN 'http' THEN 0 WHEN 'https' THEN 1 WHEN 'm3u8' THEN 2 ELSE -1 END AS quality,
  CASE WHEN length(url) > 30 THEN concat(substring(url, 1, 27), '...') ELSE url END AS short FROM {formats}"""))
def _(t):
    return t["formats"].select("media_id", "pos", vx.rank_in(F.col("protocol"), ["http", "https", "m3u8"]).alias("quality"),
                               tx.shorten(F.col("url"), 30).alias("short"))


@query("E35_ordered_distinct", oracle("SELECT media_id, ext, min(pos) AS pos FROM {formats} GROUP BY ALL"))
def _(t):
    return rc.ordered_distinct(t["formats"].select("media_id", "ext", "pos"), "media_id", "ext", [F.col("pos")])


@query("E20_parse_rates", oracle("""
SELECT source, field, count(*) AS present, count(*) FILTER (ok) AS parsed FROM (
  SELECT source, 'len' AS field, k % 3 > 0 AS ok FROM {nums} UNION ALL SELECT source, 'size', k % 2 = 0 FROM {nums}) GROUP BY ALL"""))
def _(t):
    d = t.sql("""SELECT source, CASE WHEN k % 3 > 0 THEN concat(m, ':30') ELSE 'x' END AS len,
  CASE WHEN k % 2 = 0 THEN concat(c, ' MB') ELSE '?' END AS size FROM {nums}""")
    return rc.parse_rates(d, {"len": "duration", "size": "filesize"}, "source")
