"""Queries of family H: subtitles."""

from pyspark.sql import functions as F

from ..fixtures import define, oracle
from ..operators import records as rc, subtitles as sb
from . import query

LANG = "CASE pos % 5 WHEN 0 THEN 'de' WHEN 1 THEN 'en' WHEN 2 THEN 'fr' WHEN 3 THEN 'ja' ELSE 'es' END"
define("subs", f"""
SELECT media_id, CASE WHEN pos % 3 = 0 THEN 'manual' ELSE 'auto' END AS kind, {LANG} AS lang, CAST(pos % 5 AS INT) AS lang_no, pos,
  CASE pos % 4 WHEN 0 THEN 'vtt' WHEN 1 THEN 'srt' WHEN 2 THEN 'ttml' ELSE 'ass' END AS ext, concat('https://s.example.com/', media_id, '/', pos % 11) AS url FROM {{formats}}""")
define("subs_av", """
SELECT * FROM {subs} s WHERE kind = 'manual' OR NOT EXISTS (SELECT 1 FROM {subs} m WHERE m.kind = 'manual' AND m.media_id = s.media_id AND m.lang = s.lang)""")


@query("H01_available_subs", oracle("SELECT media_id, kind, lang, pos FROM {subs_av}"))
def _(t):
    return sb.available_subs(t["subs"]).select("media_id", "kind", "lang", "pos")


@query("H02_choose_langs", oracle("""
WITH p AS (SELECT media_id, lang, row_number() OVER (PARTITION BY media_id ORDER BY lang <> 'en', kind <> 'manual', lang_no) AS r FROM {subs_av})
SELECT s.media_id, s.lang, s.pos FROM {subs_av} s JOIN p ON p.r = 1 AND p.media_id = s.media_id AND p.lang = s.lang"""))
def _(t):
    return sb.choose_langs(sb.available_subs(t["subs"])).select("media_id", "lang", "pos")


@query("H02_requested_langs", oracle("SELECT media_id, lang, pos FROM {subs_av} WHERE lang IN ('de', 'ja')"))
def _(t):
    return sb.choose_langs(sb.available_subs(t["subs"]), ["de", "ja"]).select("media_id", "lang", "pos")


@query("H03_choose_sub_files", oracle("""
WITH r AS (SELECT *, CASE ext WHEN 'srt' THEN 0 WHEN 'ass' THEN 1 ELSE 2 END AS k FROM {subs_av}), o AS (SELECT *, row_number() OVER (PARTITION BY media_id, lang ORDER BY k, pos DESC) AS n FROM r)
SELECT media_id, lang, ext, url, k = 2 AS fallback FROM o WHERE n = 1"""))
def _(t):
    return sb.choose_sub_files(sb.available_subs(t["subs"]), ["srt", "ass"])


@query("H04_merge_subs", oracle("""
WITH a AS (SELECT * FROM {subs} WHERE kind = 'manual'), b AS (SELECT * FROM {subs} WHERE kind = 'auto'), u AS (SELECT 0 AS side, * FROM a UNION ALL
SELECT 1, * FROM b WHERE NOT EXISTS (SELECT 1 FROM a WHERE a.media_id = b.media_id AND a.lang = b.lang AND a.url = b.url))
SELECT media_id, lang, url, row_number() OVER (PARTITION BY media_id, lang ORDER BY side, pos) - 1 AS pos FROM u"""))
def _(t):
    s = t["subs"]
    return sb.merge_subs(s.filter("kind = 'manual'"), s.filter("kind = 'auto'")).select("media_id", "lang", "url", "pos")


define("tracks", """
SELECT media_id, pos, CASE WHEN pos % 4 > 0 THEN concat('l', pos % 3) END AS id, CASE WHEN pos % 5 > 1 THEN url WHEN pos % 5 = 1 THEN 'bad:url' END AS url, CASE WHEN pos % 3 = 0 THEN 'text' END AS data,
  CASE WHEN pos % 2 = 0 THEN ext END AS ext, CASE WHEN pos % 7 > 0 THEN CAST(pos % 7 - 3 AS INT) END AS quality FROM {formats}""")


@query("H05_group_subs", oracle("""
SELECT media_id, coalesce(id, 'und') AS lang, row_number() OVER (PARTITION BY media_id, coalesce(id, 'und') ORDER BY coalesce(quality, 0), pos) - 1 AS pos, coalesce(ext, 'vtt') AS ext, CASE WHEN pos % 5 > 1 THEN url END AS url, data
FROM {tracks} WHERE pos % 5 > 1 OR data = 'text'"""))
def _(t):
    return sb.group_subs(t["tracks"], "und", "vtt")


# A conversation with more than 200 turns is spread over several files.
define("turns", "SELECT concat(conv_id, '-', CAST(floor(turn / 200) AS BIGINT)) AS file_id, CAST(turn % 200 AS INT) AS i, role, text FROM {conversations}")
# A file's lines are numbered from its first turn on, also where turns are missing.
define("lines_no", "SELECT *, CAST(row_number() OVER (PARTITION BY file_id ORDER BY i) AS INT) AS idx FROM {turns}")
HEAD = """<tt xmlns="http://www.w3.org/ns/ttml" xmlns:tts="http://www.w3.org/ns/ttml#styling"><head><styling><style id="s3" style="s2" tts:color="red"/><style id="s1" tts:color="white" tts:fontSize="10" tts:fontWeight="bold"/><style id="s2" style="s1" tts:fontFamily="Arial"/><style id="lost" style="nowhere" tts:color="x"/></styling></head><body style="s1"><div>"""


def ttml(t):
    line = F.expr("""concat('<p ', CASE i % 6 WHEN 4 THEN '' ELSE concat('begin="', CASE WHEN i % 2 = 0 THEN concat(i * 2, '.5s') ELSE concat('0:', lpad(floor(i * 2 / 60), 2, '0'), ':', lpad(i * 2 % 60, 2, '0'), ':25') END, '"') END,
      CASE i % 5 WHEN 3 THEN '' WHEN 2 THEN ' dur="1.25"' ELSE concat(' end="', i * 2 + 2, '"') END, CASE i % 3 WHEN 1 THEN ' style="s3"' WHEN 2 THEN ' tts:fontStyle="italic"' ELSE '' END, '>  A &amp; B ', i, '<br/>', role, ' <span tts:color="red">x</span></p>')""")
    g = t["turns"].select("file_id", "i", line.alias("line")).groupBy("file_id").agg(F.array_sort(F.collect_list(F.struct("i", "line"))).alias("x"))
    return g.select("file_id", F.concat(F.lit(HEAD), F.array_join(F.transform("x", lambda r: r["line"]), ""), F.lit("</div></body></tt>")).alias("body"))


BEGIN = "CASE WHEN i % 6 <> 4 THEN i * 2 + CASE WHEN i % 2 = 0 THEN 0.5::DOUBLE ELSE 0.25::DOUBLE END END"
define("cue_times", f"""SELECT *, {BEGIN} AS b, CASE i % 5 WHEN 3 THEN NULL WHEN 2 THEN {BEGIN} + 1.25::DOUBLE ELSE (i * 2 + 2)::DOUBLE END AS e FROM {{lines_no}}""")


@query("H06_ttml_cues", oracle("""
SELECT file_id, idx, b AS "begin", e AS "end", 'A & B ' || i || chr(10) || role || ' x' AS text FROM {cue_times} WHERE b IS NOT NULL AND e IS NOT NULL"""))
def _(t):
    return sb.ttml_cues(ttml(t)).drop("para")


@query("H07_style_cues", oracle("""
SELECT file_id, idx, CASE i % 3 WHEN 0 THEN '<b><font color="white" size="10">' WHEN 1 THEN '<b><font color="red" face="Arial" size="10">' ELSE '<i><b><font color="white" size="10">' END || '  A & B ' || i || chr(10) || role || ' ' ||
  CASE i % 3 WHEN 0 THEN '<font color="red">x</font>' WHEN 1 THEN '<font color="white">x</font>' ELSE '<font color="red">x</font>' END || CASE i % 3 WHEN 0 THEN '</font></b>' WHEN 1 THEN '</font></b>' ELSE '</font></b></i>' END AS text
FROM {cue_times} WHERE b IS NOT NULL AND e IS NOT NULL""".replace("WHEN 1 THEN '<font color=\"white\">x</font>'", "WHEN 1 THEN '<font size=\"10\">x</font>'").replace("<font size=\"10\">x</font>", "x")))
def _(t):
    f = ttml(t)
    return sb.style_cues(sb.ttml_cues(f), f).select("file_id", "idx", "text")


@query("H08_render_srt", oracle("""
SELECT file_id, idx, idx || chr(10) || printf('%02d:%02d:%02d,%03d', CAST(floor(b / 3600) AS INT), CAST(floor(b % 3600 / 60) AS INT), CAST(floor(b % 60) AS INT), CAST(floor(b % 1 * 1000) AS INT)) || ' --> ' ||
  printf('%02d:%02d:%02d,%03d', CAST(floor(e / 3600) AS INT), CAST(floor(e % 3600 / 60) AS INT), CAST(floor(e % 60) AS INT), CAST(floor(e % 1 * 1000) AS INT)) || chr(10) || 'A & B ' || i || chr(10) || role || ' x' || chr(10) || chr(10) AS block
FROM {cue_times} WHERE b IS NOT NULL AND e IS NOT NULL"""))
def _(t):
    return sb.render_srt(sb.ttml_cues(ttml(t)))


@query("H09_list_subs", oracle("""
SELECT media_id, lang, row_number() OVER (PARTITION BY media_id, lang ORDER BY pos DESC) AS n, ext FROM {subs}"""))
def _(t):
    return sb.list_subs(t["subs"])


@query("H09_list_thumbnails", oracle("""
SELECT media_id, rank, coalesce(id, CAST(rank AS VARCHAR)) AS id, coalesce(CAST(width AS VARCHAR), 'unknown') AS width, coalesce(CAST(height AS VARCHAR), 'unknown') AS height, concat('http:', url) AS url FROM {thumbs_ranked}"""))
def _(t):
    return sb.list_thumbnails(rc.rank_thumbnails(t["thumbs"]))
