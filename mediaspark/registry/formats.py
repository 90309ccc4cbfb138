"""Queries of family F: ranking and choosing renditions."""

from pyspark.sql import functions as F

from ..fixtures import define, oracle
from ..operators import formats as fm
from . import query

# Ranked and prepared renditions as plain SQL windows; only the SQL counterparts use these.
define("ranked", """
SELECT *, row_number() OVER (PARTITION BY media_id ORDER BY
  coalesce(preference, 0) + CASE WHEN coalesce(vcodec, '') = 'none' THEN -50 WHEN coalesce(acodec, '') = 'none' THEN -40 ELSE 0 END,
  coalesce(tbr, -1), coalesce(filesize, -1), coalesce(height, -1),
  CASE protocol WHEN 'http' THEN 0 WHEN 'https' THEN 0 WHEN 'rtsp' THEN -0.5 ELSE -0.1 END,
  CASE WHEN coalesce(vcodec, '') = 'none' THEN 0 ELSE CASE ext WHEN 'webm' THEN 0 WHEN 'flv' THEN 1 WHEN 'mp4' THEN 2 ELSE -1 END END,
  CASE WHEN coalesce(vcodec, '') = 'none' THEN CASE ext WHEN 'webm' THEN 0 WHEN 'm4a' THEN 5 ELSE -1 END ELSE 0 END,
  coalesce(format_id, ''), pos) AS rank
FROM {formats}""")
define("named_ids", "SELECT *, coalesce(format_id, CAST(rank - 1 AS VARCHAR)) AS fid FROM {ranked}")
define("prepared", """
SELECT media_id, pos, rank, url, ext, vcodec, acodec, tbr, height, filesize, protocol, preference,
  CASE WHEN count(*) OVER (PARTITION BY media_id, fid) > 1
       THEN concat(fid, '-', row_number() OVER (PARTITION BY media_id, fid ORDER BY rank) - 1) ELSE fid END AS format_id
FROM {named_ids}""")
define("flags", """
SELECT media_id, bool_and(coalesce(vcodec, '') <> 'none' AND coalesce(acodec, '') = 'none')
  OR bool_and(coalesce(vcodec, '') = 'none' AND coalesce(acodec, '') <> 'none') AS incomplete
FROM {formats} GROUP BY media_id""")


def _leaf(cond, last=True, src="prepared", filt="TRUE"):
    """SQL of one arg-max pick per item."""
    d = "DESC" if last else ""
    return (f"SELECT * EXCLUDE (rn) FROM (SELECT *, row_number() OVER (PARTITION BY media_id ORDER BY rank {d}) rn "
            f"FROM {{{src}}} WHERE ({cond}) AND ({filt})) WHERE rn = 1")


BOTH = "coalesce(vcodec, '') <> 'none' AND coalesce(acodec, '') <> 'none'"
define("best_both", _leaf(BOTH))
define("worst_both", _leaf(BOTH, False))
define("best_any", _leaf("TRUE"))
define("worst_any", _leaf("TRUE", False))
define("best_pick", "SELECT * FROM {best_both} UNION ALL SELECT a.* FROM {best_any} a JOIN {flags} f USING (media_id) "
       "WHERE f.incomplete AND a.media_id NOT IN (SELECT media_id FROM {best_both})")
define("worst_pick", "SELECT * FROM {worst_both} UNION ALL SELECT a.* FROM {worst_any} a JOIN {flags} f USING (media_id) "
       "WHERE f.incomplete AND a.media_id NOT IN (SELECT media_id FROM {worst_both})")
define("best_a", _leaf("vcodec = 'none'"))
define("worst_a", _leaf("vcodec = 'none'", False))
define("best_v", _leaf("acodec = 'none'"))
define("worst_v", _leaf("acodec = 'none'", False))
define("merged", """
SELECT v.media_id, concat(v.format_id, '+', a.format_id) AS format_id, v.ext AS ext, v.vcodec, a.acodec, v.height,
  CASE WHEN v.vcodec = 'none' THEN 'the first format must contain the video'
       WHEN v.acodec = 'none' AND a.acodec = 'none' THEN 'both formats are video-only' END AS error,
  v.ext AS vext, a.ext AS aext
FROM {best_v} v JOIN {best_a} a USING (media_id)""")

ONE = "1 AS parts, CAST(NULL AS VARCHAR) AS error"
COLS = ["media_id", "ord", "format_id", "ext", "vcodec", "acodec", "height", "parts", "error"]
SHOW = "media_id, 1 AS ord, format_id, ext, vcodec, acodec, height, " + ONE


def show(df):
    return df.select("media_id", F.col("ord").cast("int"), *COLS[2:])


def prepared(t, **kw):
    f = t["formats"]
    return fm.prepare_formats(f, sizes=f, **kw)


def pick(t, selector):
    return show(fm.select_formats(prepared(t), selector))


@query("F01_prepare_formats", oracle("SELECT media_id, rank, format_id, url, ext, protocol, "
       "concat(format_id, ' - ', CASE WHEN vcodec = 'none' THEN 'audio only' ELSE coalesce(concat(CAST(height AS VARCHAR), 'p'), 'unknown') END) AS format "
       "FROM {prepared}").replace("concat(CAST(height AS VARCHAR), 'p')", "CAST(height AS VARCHAR) || 'p'"))
def _(t):
    return prepared(t).select("media_id", "rank", "format_id", "url", "ext", "protocol", "format")


@query("F02_rank_formats", oracle("SELECT media_id, pos, rank FROM {ranked}"))
def _(t):
    f = t["formats"]
    return fm.rank_formats(f, sizes=f).select("media_id", "pos", "rank")


@query("F03_rank_by_fields", oracle("""
SELECT media_id, pos, row_number() OVER (PARTITION BY media_id ORDER BY coalesce(height, -1), coalesce(tbr, -1),
  coalesce(format_id, ''), pos) AS rank FROM {formats}"""))
def _(t):
    f = t["formats"]
    return fm.rank_formats(f, by=["height", "tbr", "format_id"], sizes=f).select("media_id", "pos", "rank")


define("split_rates", """SELECT media_id, pos, CASE WHEN pos % 2 = 0 THEN tbr END AS tbr, CAST(height AS DOUBLE) / 4 AS abr,
  CAST(filesize / 1000000 AS DOUBLE) AS vbr, url, 'mp4' AS ext, 'http' AS protocol FROM {formats}""")


@query("F04_total_bitrate", oracle("""
SELECT media_id, pos, row_number() OVER (PARTITION BY media_id ORDER BY coalesce(tbr, abr + vbr, -1),
  coalesce(vbr, -1), coalesce(abr, -1), pos) AS rank FROM {split_rates}"""))
def _(t):
    f = t["split_rates"]
    return fm.rank_formats(f, sizes=t["formats"]).select("media_id", "pos", "rank")


@query("F05_dedupe_formats", oracle("""
SELECT media_id, url, min(pos) AS pos, min_by(ext, pos) AS ext FROM {formats} GROUP BY media_id, url"""))
def _(t):
    return fm.dedupe_formats(t["formats"]).select("media_id", "url", "pos", "ext")


@query("F06_numeric_predicates", oracle("""
SELECT media_id, pos, height, tbr, filesize FROM {formats}
WHERE height >= 360 AND (tbr < 5000 OR tbr IS NULL) AND filesize <> 1000000"""))
def _(t):
    return t["formats"].filter(fm.cmp("height", ">=", 360) & fm.cmp("tbr", "<", 5000, or_null=True)
                               & fm.cmp("filesize", "!=", 1000000)).select("media_id", "pos", "height", "tbr", "filesize")


@query("F07_string_predicates", oracle("""
SELECT media_id, pos, ext, vcodec, protocol FROM {formats}
WHERE ext <> 'flv' AND (starts_with(vcodec, 'avc1') OR vcodec IS NULL) AND contains(protocol, 'tt') AND NOT (protocol = 'http')"""))
def _(t):
    return t["formats"].filter(
        fm.str_cmp("ext", "=", "flv", negate=True) & fm.str_cmp("vcodec", "^=", "avc1", or_null=True)
        & fm.str_cmp("protocol", "*=", "tt") & fm.str_cmp("protocol", "=", "http", negate=True)
    ).select("media_id", "pos", "ext", "vcodec", "protocol")


@query("F08_best_combined", oracle(f"SELECT {SHOW} FROM {{best_pick}}"))
def _(t):
    return pick(t, fm.best())


@query("F08_worst_combined", oracle(f"SELECT {SHOW} FROM {{worst_pick}}"))
def _(t):
    return pick(t, fm.worst())


@query("F09_single_stream", oracle(f"""
SELECT {SHOW} FROM {{best_a}} UNION ALL SELECT {SHOW.replace('1 AS ord', 'CASE WHEN media_id IN (SELECT media_id FROM {best_a}) THEN 2 ELSE 1 END AS ord')} FROM {{best_v}}"""))
def _(t):
    return pick(t, fm.each(fm.best_audio(), fm.best_video()))


@query("F09_worst_single_stream", oracle(f"""
SELECT {SHOW} FROM {{worst_a}} UNION ALL SELECT {SHOW.replace('1 AS ord', 'CASE WHEN media_id IN (SELECT media_id FROM {worst_a}) THEN 2 ELSE 1 END AS ord')} FROM {{worst_v}}"""))
def _(t):
    return pick(t, fm.each(fm.worst_audio(), fm.worst_video()))


define("last_webm", _leaf("ext = 'webm'"))
define("last_f3", _leaf("format_id = 'f3'"))


@query("F10_by_ext_or_id", oracle(f"""
SELECT {SHOW} FROM {{last_webm}} UNION ALL
SELECT {SHOW} FROM {{last_f3}} WHERE media_id NOT IN (SELECT media_id FROM {{last_webm}})"""))
def _(t):
    return pick(t, fm.prefer(fm.named("webm"), fm.named("f3")))


@query("F10_all_formats", oracle(f"SELECT {SHOW.replace('1 AS ord', 'CAST(rank AS INT) AS ord')} FROM {{prepared}}"))
def _(t):
    return pick(t, fm.all_formats())


define("last_mp4", _leaf("ext = 'mp4'"))


@query("F11_fallback", oracle(f"""
SELECT {SHOW} FROM {{last_mp4}} UNION ALL
SELECT {SHOW} FROM {{best_a}} WHERE media_id NOT IN (SELECT media_id FROM {{last_mp4}}) UNION ALL
SELECT {SHOW} FROM {{worst_pick}} WHERE media_id NOT IN (SELECT media_id FROM {{last_mp4}} UNION SELECT media_id FROM {{best_a}})"""))
def _(t):
    return pick(t, fm.prefer(fm.by_ext("mp4"), fm.best_audio(), fm.worst()))


@query("F12_several_selections", oracle(f"""
SELECT media_id, CAST(row_number() OVER (PARTITION BY media_id ORDER BY o) AS INT) AS ord, format_id, ext, vcodec, acodec, height, {ONE}
FROM (SELECT 1 AS o, * FROM {{best_pick}} UNION ALL SELECT 2, * FROM {{worst_pick}} UNION ALL SELECT 3, * FROM {{best_pick}})"""))
def _(t):
    return pick(t, fm.each(fm.best(), fm.worst(), fm.best()))


F13 = "height <= 720 AND (tbr > 1000 OR tbr IS NULL)"
define("best_small_both", _leaf(BOTH, filt=F13))
define("best_small_any", _leaf("TRUE", filt=F13))


@query("F13_filtered_selection", oracle(f"""
SELECT {SHOW} FROM {{best_small_both}} UNION ALL SELECT {SHOW} FROM {{best_small_any}} a
WHERE media_id IN (SELECT media_id FROM {{flags}} WHERE incomplete) AND media_id NOT IN (SELECT media_id FROM {{best_small_both}})"""))
def _(t):
    return pick(t, fm.where(fm.where(fm.best(), fm.cmp("height", "<=", 720)), fm.cmp("tbr", ">", 1000, or_null=True)))


MERGED = "media_id, 1 AS ord, format_id, ext, vcodec, acodec, height, 2 AS parts, error"


@query("F14_merge", oracle(f"SELECT {MERGED} FROM {{merged}}"))
def _(t):
    return pick(t, fm.merge(fm.best_video(), fm.best_audio()))


@query("F14_merge_all_videos", oracle("""
SELECT v.media_id, CAST(row_number() OVER (PARTITION BY v.media_id ORDER BY v.rank) AS INT) AS ord,
  concat(v.format_id, '+', a.format_id) AS format_id, 'mkv' AS ext, v.vcodec, a.acodec, v.height, 2 AS parts,
  CASE WHEN v.vcodec = 'none' THEN 'the first format must contain the video'
       WHEN v.acodec = 'none' AND a.acodec = 'none' THEN 'both formats are video-only' END AS error
FROM {prepared} v JOIN {best_a} a USING (media_id) WHERE v.height > 360"""))
def _(t):
    return pick(t, fm.merge(fm.where(fm.all_formats(), fm.cmp("height", ">", 360)), fm.best_audio(), "mkv"))


@query("F15_merged_container", oracle("""
SELECT media_id, format_id, CASE WHEN error IS NOT NULL THEN NULL
  WHEN (vext IN ('mp4', 'm4a') AND aext IN ('mp4', 'm4a')) OR (vext = 'webm' AND aext = 'webm') THEN ext ELSE 'mkv' END AS container_ext
FROM {merged}"""))
def _(t):
    p = fm.select_formats(prepared(t), fm.merge(fm.best_video(), fm.best_audio()))
    return fm.merged_container(p).select("media_id", "format_id", "container_ext")


@query("F16_incomplete", oracle("SELECT f.media_id, f.pos, g.incomplete FROM {formats} f JOIN {flags} g USING (media_id)"))
def _(t):
    return fm.flag_incomplete(t["formats"]).select("media_id", "pos", "incomplete")


define("live_ids", "SELECT media_id FROM {media} WHERE is_live")
define("default_picks", f"""
SELECT {MERGED} FROM {{merged}} WHERE media_id NOT IN (SELECT media_id FROM {{live_ids}}) UNION ALL
SELECT {SHOW} FROM {{best_pick}} WHERE media_id NOT IN (SELECT media_id FROM {{live_ids}}) AND media_id NOT IN (SELECT media_id FROM {{merged}}) UNION ALL
SELECT {SHOW} FROM {{best_pick}} WHERE media_id IN (SELECT media_id FROM {{live_ids}}) UNION ALL
SELECT {MERGED} FROM {{merged}} WHERE media_id IN (SELECT media_id FROM {{live_ids}}) AND media_id NOT IN (SELECT media_id FROM {{best_pick}})""")


@query("F17_default_selection", oracle("SELECT * FROM {default_picks}"))
def _(t):
    return show(fm.default_selection(prepared(t), t["media"]))


@query("F18_unselected", oracle("""
SELECT media_id, title, 'requested format not available' AS reason FROM {media}
WHERE media_id NOT IN (SELECT media_id FROM {best_pick})"""))
def _(t):
    return fm.unselected(t["media"], fm.select_formats(prepared(t), fm.best())).select("media_id", "title", "reason")


@query("F19_apply_selection", oracle("""
SELECT m.media_id, m.title, p.format_id, p.ext, p.vcodec, p.acodec, p.height
FROM {media} m LEFT JOIN (SELECT * FROM {default_picks} WHERE error IS NULL) p USING (media_id)"""))
def _(t):
    picks = fm.default_selection(prepared(t), t["media"])
    return fm.apply_selection(t["media"], picks).select("media_id", "title", "format_id", "ext", "vcodec", "acodec", "height")


@query("F20_size_bounds", oracle("""
SELECT media_id, pos, filesize FROM {formats}
WHERE filesize IS NULL OR (filesize >= 20000000 AND filesize <= 60000000)"""))
def _(t):
    return fm.size_bounds(t["formats"], 20_000_000, 60_000_000).select("media_id", "pos", "filesize")


@query("F22_list_formats", oracle("""
WITH x AS (SELECT *, max(rank) OVER (PARTITION BY media_id) AS top, count(*) OVER (PARTITION BY media_id) AS n,
    CAST(trunc(tbr) AS BIGINT) AS k FROM {prepared}),
y AS (SELECT *, concat_ws(', ', lpad(CAST(k AS VARCHAR), CAST(greatest(4, length(CAST(k AS VARCHAR))) AS INTEGER), ' ') || 'k',
  CASE WHEN vcodec <> 'none' THEN vcodec END,
  CASE WHEN acodec = 'none' THEN CASE WHEN coalesce(vcodec, '') = 'none' THEN NULL ELSE 'video only' END ELSE acodec END,
  CASE WHEN filesize < 1048576 THEN printf('%.2fKiB', filesize / 1024.0) ELSE printf('%.2fMiB', filesize / 1048576.0) END) AS note FROM x)
SELECT media_id, rank, format_id, ext,
  CASE WHEN vcodec = 'none' THEN 'audio only' ELSE coalesce(CAST(height AS VARCHAR) || 'p', 'unknown') END AS resolution,
  CASE WHEN rank = top AND n > 1 THEN CASE WHEN note = '' THEN '(best)' ELSE concat(note, ' (best)') END ELSE note END AS note
FROM y"""))
def _(t):
    return fm.list_formats(prepared(t), sizes=t["formats"])
