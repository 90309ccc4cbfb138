"""Queries of family G: playlists, filters, archive, references."""

import datetime as dt

from pyspark.sql import functions as F

from ..fixtures import define, oracle
from ..operators import playlists as pl
from . import query

define("playlists", """
SELECT c_custkey AS playlist_id, CASE WHEN c_custkey % 9 = 0 THEN NULL ELSE c_name END AS title, c_mktsegment AS uploader,
  concat('Site', c_nationkey) AS extractor_key, concat('https://www.example.com/list/', c_custkey, '?all=1') AS webpage_url
FROM {customer}""")
define("entries_full", """
SELECT e.playlist_id, e.pos, e.media_id, CASE WHEN e.media_id % 2 = 0 THEN m.extractor_key END AS extractor_key
FROM {playlist_entries} e JOIN {media} m USING (media_id)""")
define("items", """
SELECT m.*, e.playlist_id FROM {media} m JOIN {playlist_entries} e USING (media_id)""")
NUM = "row_number() OVER (PARTITION BY playlist_id ORDER BY pos)"


@query("G01_expand_playlists", oracle(f"""
SELECT e.playlist_id, e.media_id, {NUM.replace('playlist_id', 'e.playlist_id')} AS playlist_index,
  count(*) OVER (PARTITION BY e.playlist_id) AS n_entries, coalesce(p.title, CAST(e.playlist_id AS VARCHAR)) AS playlist,
  p.uploader AS playlist_uploader, coalesce(e.extractor_key, p.extractor_key) AS extractor_key,
  CAST(e.playlist_id AS VARCHAR) AS webpage_url_basename
FROM {{entries_full}} e JOIN {{playlists}} p USING (playlist_id)"""))
def _(t):
    return pl.expand_playlists(t["playlists"], t["entries_full"]).select(
        "playlist_id", "media_id", "playlist_index", "n_entries", "playlist", "playlist_uploader", "extractor_key",
        "webpage_url_basename")


@query("G02_slice_entries", oracle(f"""
SELECT * FROM (SELECT playlist_id, media_id, {NUM} AS playlist_index FROM {{playlist_entries}}) WHERE playlist_index BETWEEN 3 AND 7"""))
def _(t):
    return pl.slice_entries(t["playlist_entries"], 3, 7).select("playlist_id", "media_id", "playlist_index")


@query("G03_pick_items", oracle(f"""
WITH n AS (SELECT playlist_id, media_id, {NUM} AS no, count(*) OVER (PARTITION BY playlist_id) AS cnt FROM {{playlist_entries}}),
req(ord, item) AS (VALUES (1, 5), (2, 12), (3, 1), (4, 2), (5, 3), (6, 0), (7, 9)),
h AS (SELECT playlist_id, media_id, row_number() OVER (PARTITION BY playlist_id ORDER BY ord) AS out_pos
  FROM n JOIN req ON no = CASE WHEN item = 0 THEN cnt ELSE item END)
SELECT playlist_id, media_id, CAST(out_pos AS INT) AS out_pos, CAST(item AS BIGINT) AS playlist_index FROM h JOIN req ON ord = out_pos"""))
def _(t):
    return pl.pick_items(t["playlist_entries"], "5,12,1-3,2,0,9").select("playlist_id", "media_id", "out_pos", "playlist_index")


@query("G04_reverse_entries", oracle("""
SELECT playlist_id, media_id, row_number() OVER (PARTITION BY playlist_id ORDER BY pos DESC) AS playlist_index FROM {playlist_entries}"""))
def _(t):
    return pl.reverse_entries(t["playlist_entries"]).select("playlist_id", "media_id", "playlist_index")


@query("G05_shuffle_entries", oracle("""
SELECT playlist_id, media_id, row_number() OVER (PARTITION BY playlist_id ORDER BY md5(concat('s1-', media_id)), pos) AS playlist_index
FROM {playlist_entries}"""))
def _(t):
    return pl.shuffle_entries(t["playlist_entries"], "s1").select("playlist_id", "media_id", "playlist_index")


@query("G06_cap", oracle("""
SELECT media_id, title, view_count FROM {media} WHERE view_count IS NULL OR view_count >= 100000 ORDER BY upload_day, media_id LIMIT 500"""))
def _(t):
    kept = t["media"].filter(pl.view_filter(lo=100000))
    return pl.cap(kept, 500, ["upload_day", "media_id"]).select("media_id", "title", "view_count")


@query("G07_title_filter", oracle("""
SELECT media_id, title FROM {media} WHERE title IS NULL OR (regexp_matches(title, '(?i)CLIP [1-5]') AND NOT regexp_matches(title, '(?i)urgent'))"""))
def _(t):
    return t["media"].filter(pl.title_filter("CLIP [1-5]", "urgent")).select("media_id", "title")


@query("G08_date_filter", oracle("""
SELECT media_id, upload_day FROM {media} WHERE upload_day IS NULL OR upload_day BETWEEN DATE '1998-12-31' - 60 AND DATE '1998-12-31' + 365"""))
def _(t):
    ok = pl.date_filter("today-2months", "now+1year", today=dt.date(1998, 12, 31))
    return t["media"].filter(ok).select("media_id", "upload_day")


@query("G09_view_filter", oracle("SELECT media_id, view_count FROM {media} WHERE view_count IS NULL OR view_count BETWEEN 100000 AND 300000"))
def _(t):
    return t["media"].filter(pl.view_filter(100000, 300000)).select("media_id", "view_count")


@query("G10_age_filter", oracle("SELECT media_id, age_limit FROM {media} WHERE age_limit IS NULL OR age_limit <= 16"))
def _(t):
    return t["media"].filter(pl.age_filter(16)).select("media_id", "age_limit")


@query("G11_skip_archived", oracle("""
SELECT media_id, extractor_key, id FROM {media} m WHERE NOT EXISTS (
  SELECT 1 FROM {archive} a WHERE a.archive_id = concat(lower(m.extractor_key), ' ', m.id))"""))
def _(t):
    return pl.skip_archived(t["media"], t["archive"]).select("media_id", "extractor_key", "id")


@query("G12_attribute_match", oracle("""
SELECT media_id, view_count, extractor_key FROM {media}
WHERE (view_count > 150000 OR view_count IS NULL) AND extractor_key <> 'Site3' AND title IS NOT NULL AND is_live = FALSE"""))
def _(t):
    m = t["media"]
    return pl.match(m, [pl.attr(m, "view_count", ">", "150k", or_null=True), pl.attr(m, "extractor_key", "!=", "Site3"),
                        pl.present(m, "title"), pl.absent(m, "is_live")]).select("media_id", "view_count", "extractor_key")


RULES = dict(title="clip", reject="urgent", dates=("19960101", "19991231"), views=(50000, 450000), age=16)
define("reasons", """
SELECT i.*, CASE WHEN NOT regexp_matches(title, '(?i)clip') THEN 'title does not match'
  WHEN regexp_matches(title, '(?i)urgent') THEN 'title rejected'
  WHEN NOT (upload_day BETWEEN DATE '1996-01-01' AND DATE '1999-12-31') THEN 'upload date out of range'
  WHEN view_count < 50000 THEN 'too few views' WHEN view_count > 450000 THEN 'too many views'
  WHEN age_limit > 16 THEN 'age restricted'
  WHEN concat(lower(extractor_key), ' ', id) IN (SELECT archive_id FROM {archive}) THEN 'in archive'
  WHEN NOT coalesce(is_live = FALSE, FALSE) THEN 'attributes' END AS reason FROM {items} i""")


@query("G13_audit", oracle("SELECT playlist_id, coalesce(reason, 'accepted') AS reason, count(*) AS n FROM {reasons} GROUP BY ALL"))
def _(t):
    i = t["items"]
    return pl.audit(i, t["archive"], by=["playlist_id"], preds=[pl.absent(i, "is_live")], **RULES)


@query("G13_reject_reason", oracle("SELECT media_id, playlist_id, reason FROM {reasons}"))
def _(t):
    i = t["items"]
    return pl.reject_reason(i, t["archive"], preds=[pl.absent(i, "is_live")], **RULES).select("media_id", "playlist_id", "reason")


define("refs_once", """
SELECT concat('c/', c_custkey) AS url,
  CASE c_custkey % 3 WHEN 0 THEN 'url' WHEN 1 THEN 'url_transparent' ELSE 'video' END AS type,
  CASE WHEN c_custkey % 3 < 2 THEN concat('n/', CASE WHEN c_custkey % 50 = 1 THEN 99 ELSE c_nationkey END) END AS target,
  concat('c', c_custkey) AS id, CASE WHEN c_custkey % 5 > 0 THEN c_name END AS title, c_mktsegment AS uploader, c_custkey % 2 = 0 AS in_playlist
FROM {customer} UNION ALL
SELECT concat('n/', n_nationkey), CASE WHEN n_nationkey % 7 = 0 THEN 'video' WHEN n_nationkey % 2 = 0 THEN 'url' ELSE 'url_transparent' END,
  CASE WHEN n_nationkey % 7 > 0 THEN concat('r/', n_regionkey) END, concat('n', n_nationkey), n_name,
  CASE WHEN n_nationkey % 4 = 1 THEN 'nation' END, FALSE FROM {nation} UNION ALL
SELECT concat('r/', r_regionkey), CASE WHEN r_regionkey >= 3 THEN 'url' ELSE 'video' END,
  CASE WHEN r_regionkey >= 3 THEN concat('r/', 7 - r_regionkey) END, concat('r', r_regionkey), r_name, 'region', FALSE FROM {region} UNION ALL
SELECT concat('k/', s_suppkey), CASE WHEN s_suppkey % 97 = 0 THEN 'video' WHEN s_suppkey % 3 = 0 THEN 'url_transparent' ELSE 'url' END, CASE WHEN s_suppkey % 97 > 0 THEN concat('k/', s_suppkey - 1) END,
  concat('k', s_suppkey), CASE WHEN s_suppkey % 4 = 0 THEN s_name END, CASE WHEN s_suppkey % 11 = 0 THEN s_name END, FALSE FROM {supplier}""")

# Some rows come twice: every reference to them still leads to one node.
define("refs", "SELECT * FROM {refs_once} UNION ALL SELECT * FROM {refs_once} WHERE id LIKE '%5' OR id LIKE '%0'")


def _walk(flat=""):
    return f"""
WITH RECURSIVE w AS (SELECT url AS source, url, type, target, id, title, uploader, CASE WHEN type NOT IN ('url', 'url_transparent') THEN 'resolved' {flat} END AS status, [url] AS seen FROM {{refs}}
UNION ALL SELECT w.source, coalesce(r.url, w.url), CASE WHEN r.url IS NULL THEN w.type WHEN w.type = 'url_transparent' AND r.type = 'url' THEN 'url_transparent' ELSE r.type END,
  CASE WHEN r.url IS NULL THEN w.target ELSE r.target END, coalesce(r.id, w.id),
  CASE WHEN r.url IS NULL OR w.type = 'url_transparent' THEN coalesce(w.title, r.title) ELSE r.title END,
  CASE WHEN r.url IS NULL OR w.type = 'url_transparent' THEN coalesce(w.uploader, r.uploader) ELSE r.uploader END,
  CASE WHEN r.url IS NULL THEN 'missing' WHEN r.type NOT IN ('url', 'url_transparent') THEN 'resolved' WHEN list_contains(w.seen, r.url) THEN 'cycle' END, list_append(w.seen, r.url)
FROM w LEFT JOIN {{refs_once}} r ON w.target = r.url WHERE w.status IS NULL)
SELECT w.source, CASE WHEN status = 'cycle' THEN s.url ELSE w.url END AS url, CASE WHEN status = 'cycle' THEN s.type ELSE w.type END AS type, CASE WHEN status = 'cycle' THEN s.id ELSE w.id END AS id,
  CASE WHEN status = 'cycle' THEN s.title ELSE w.title END AS title, CASE WHEN status = 'cycle' THEN s.uploader ELSE w.uploader END AS uploader, status
FROM w JOIN {{refs_once}} s ON s.url = w.source WHERE status IS NOT NULL"""


REF_COLS = ["source", "url", "type", "id", "title", "uploader", "status"]


@query("G14_resolve_refs", oracle(_walk()))
def _(t):
    return pl.resolve_refs(t["refs"].drop("in_playlist")).select(*REF_COLS)


@query("G16_flat_in_playlist", oracle(_walk("WHEN in_playlist THEN 'kept'")))
def _(t):
    return pl.resolve_refs(t["refs"], mode="flat_in_playlist").select(*REF_COLS)


@query("G16_flat", oracle("""
SELECT url AS source, url, type, id, title, uploader, CASE WHEN type IN ('url', 'url_transparent') THEN 'kept' ELSE 'resolved' END AS status FROM {refs}"""))
def _(t):
    return pl.resolve_refs(t["refs"], mode="flat").select(*REF_COLS)


define("nested", """
SELECT concat('r/', n_regionkey) AS parent, CAST(n_nationkey AS BIGINT) AS pos, concat('n/', n_nationkey) AS child FROM {nation} UNION ALL
SELECT concat('n/', c_nationkey), c_custkey, concat('c/', c_custkey) FROM {customer} UNION ALL
SELECT concat('n/', n_nationkey), -1, concat('r/', n_regionkey) FROM {nation} WHERE n_nationkey % 4 = 0 UNION ALL
SELECT concat('n/', n_nationkey), -2, concat('n/', (n_nationkey + 1) % 25) FROM {nation} WHERE n_nationkey % 3 = 0""")
define("nested_roots", "SELECT concat('r/', r_regionkey) AS root FROM {region}")


@query("G15_expand_nested", oracle("""
WITH RECURSIVE e AS (SELECT * FROM {nested} WHERE child IN (SELECT parent FROM {nested})),
p AS (SELECT root, root AS playlist, CAST(NULL AS VARCHAR) AS parent, CAST([] AS BIGINT[]) AS path, [root] AS nodes FROM {nested_roots} UNION ALL
  SELECT p.root, e.child, e.parent, list_append(p.path, e.pos), list_append(p.nodes, e.child) FROM p JOIN e ON e.parent = p.playlist WHERE NOT list_contains(p.nodes, e.child)),
v AS (SELECT root, playlist, min({'path': path, 'nodes': nodes, 'parent': parent}) AS x FROM p GROUP BY root, playlist)
SELECT v.root, v.playlist, x.parent AS parent, CAST(len(x.path) AS INTEGER) AS level, array_to_string(x.path, '/') AS path, n.pos, n.child AS item
FROM v JOIN {nested} n ON n.parent = v.playlist WHERE n.child NOT IN (SELECT parent FROM {nested})"""))
def _(t):
    d = pl.expand_nested(t["nested"], t["nested_roots"])
    return d.withColumn("path", F.array_join(F.transform("path", lambda x: x.cast("string")), "/"))


define("entry_rows", """
SELECT e.playlist_id, e.pos, e.media_id, CASE WHEN e.media_id % 3 = 0 THEN NULL ELSE m.title END AS title, m.extractor_key, m.id,
  CASE WHEN e.media_id % 2 = 0 THEN m.upload_day END AS upload_day, CAST(NULL AS BIGINT) AS view_count, CAST(NULL AS INT) AS age_limit
FROM {playlist_entries} e JOIN {media} m USING (media_id)""")


@query("G17_two_stage_filter", oracle("""
WITH early AS (SELECT e.* FROM {entry_rows} e WHERE coalesce(NOT regexp_matches(title, '(?i)urgent'), TRUE)
  AND coalesce(upload_day >= DATE '1996-01-01', TRUE) AND concat(lower(extractor_key), ' ', id) NOT IN (SELECT archive_id FROM {archive}))
SELECT e.playlist_id, m.media_id, m.title, m.view_count FROM early e JOIN {media} m USING (media_id)
WHERE coalesce(NOT regexp_matches(m.title, '(?i)urgent'), TRUE) AND coalesce(m.upload_day >= DATE '1996-01-01', TRUE)
  AND coalesce(m.view_count >= 100000, TRUE) AND coalesce(m.age_limit <= 16, TRUE) AND m.is_live = FALSE"""))
def _(t):
    rules = dict(reject="urgent", dates=("19960101", None), views=(100000, None), age=16)
    early = pl.filter_early(t["entry_rows"], t["archive"], **rules).select("playlist_id", "media_id")
    full = early.join(t["media"], "media_id")
    return pl.filter_full(full, t["archive"], preds=[pl.absent(full, "is_live")], **rules).select(
        "playlist_id", "media_id", "title", "view_count")


define("paged", """
SELECT media_id, CAST(floor(media_id / 40) AS BIGINT) AS page, media_id % 40 AS page_pos FROM {media}""")


@query("G18_pages_for_slice", oracle("""
SELECT media_id, page, page * 40 + page_pos + 1 AS item FROM {paged} WHERE page * 40 + page_pos + 1 BETWEEN 95 AND 1333"""))
def _(t):
    return pl.pages_for_slice(t["paged"], 40, 95, 1333).select("media_id", "page", "item")


define("scheduled", """
SELECT media_id, CASE WHEN media_id % 3 > 0 THEN 1700000000 + media_id END AS available_at FROM {media}""")


@query("G20_available", oracle("SELECT media_id, available_at FROM {scheduled} WHERE available_at IS NULL OR available_at <= 1700005000"))
def _(t):
    return t["scheduled"].filter(pl.available(1700005000))
