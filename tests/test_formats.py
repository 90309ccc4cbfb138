from pyspark.sql import functions as F

from mediaspark.operators import formats as fm

SCHEMA = "media_id int, pos int, format_id string, url string, ext string, vcodec string, acodec string, tbr double, height int, preference double"


def table(spark, rows):
    num = lambda x: None if x is None else float(x)
    full = [(m, i, f, u, e, v, a, num(t), h, num(p)) for i, (m, f, u, e, v, a, t, h, p) in enumerate(rows)]
    return spark.createDataFrame(full, SCHEMA)


def f(m, fid, v=None, a=None, ext="mp4", tbr=None, height=None, pref=None, url="http://e.com/v"):
    return (m, fid, url, ext, v, a, tbr, height, pref)


def picks(d, sel):
    out = fm.select_formats(fm.prepare_formats(d), sel).orderBy("media_id", "ord").collect()
    return [(r["media_id"], r["format_id"], r["error"]) for r in out]


def test_unknown_codec_is_not_none(spark):
    d = table(spark, [f(1, "a", None, None, tbr=1), f(1, "b", "none", "mp4a", tbr=9)])
    assert picks(d, fm.best()) == [(1, "a", None)]


def test_best_on_incomplete_items_only(spark):
    d = table(spark, [f(1, "v1", "avc", "none", tbr=1), f(1, "v2", "avc", "none", tbr=2),
                      f(2, "v", "avc", "none"), f(2, "a", "none", "mp4a")])
    assert picks(d, fm.best()) == [(1, "v2", None)]
    assert picks(d, fm.worst()) == [(1, "v1", None)]


def test_merge_and_errors(spark):
    d = table(spark, [f(1, "v", "avc", "none"), f(1, "a", "none", "mp4a", ext="m4a")])
    assert picks(d, fm.merge(fm.best_video(), fm.best_audio())) == [(1, "v+a", None)]
    assert picks(d, fm.merge(fm.best_audio(), fm.best_video()))[0][2].startswith("the first format")
    assert picks(d, fm.merge(fm.best_video(), fm.best_video()))[0][2].startswith("both formats")


def test_ids_are_made_unique_in_rank_order(spark):
    d = table(spark, [f(1, "x", tbr=9), f(1, "x", tbr=1), f(1, None, tbr=5), f(1, "a/b [c]", tbr=7), f(1, "gone", url="")])
    out = {r["format_id"]: r["tbr"] for r in fm.prepare_formats(d).collect()}
    assert out == {"x-0": 1.0, "1": 5.0, "a_b__c_": 7.0, "x-1": 9.0}


def test_rank_prefers(spark):
    d = table(spark, [f(1, "flv", ext="f4f"), f(1, "best", pref=1.0), f(1, "audio", "none", "x", tbr=999), f(1, "video", "x", "none", tbr=1)])
    order = [r["format_id"] for r in fm.rank_formats(d).orderBy("rank").collect()]
    assert order == ["audio", "video", "flv", "best"]


def test_container_substring_quirk(spark):
    d = spark.createDataFrame([(2, None, ["webm", "webm"], "webm"), (2, None, ["web", "m"], "web"), (2, None, ["mp4", "webm"], "mp4"),
                               (2, None, ["mp4", "m4a"], "mp4"), (1, None, None, "flv")], "parts int, error string, part_exts array<string>, ext string")
    assert [r["container_ext"] for r in fm.merged_container(d).collect()] == ["webm", "web", "mkv", "mp4", "flv"]


def test_note_text(spark):
    d = spark.createDataFrame([(1, 1, "a", "mp4", "avc1.1.2.3.4", "none", 1234.0, None, 1152, "en", 2), (1, 2, "b", "f4m", None, "mp4a", None, 96.0, None, None, None)],
                              "media_id int, rank int, format_id string, ext string, vcodec string, acodec string, tbr double, abr double, filesize bigint, language string, fps int")
    notes = [r["note"] for r in fm.list_formats(d).orderBy("rank").collect()]
    assert notes == ["[en] 1234k, avc1.1.2.3, 2fps, video only, 1.12KiB", "(unsupported), mp4a@ 96k (best)"]


def test_null_predicates(spark):
    d = spark.createDataFrame([(None,), (5,)], "h int")
    assert d.filter(fm.cmp("h", "!=", 9)).count() == 1
    assert d.filter(fm.cmp("h", "!=", 9, or_null=True)).count() == 2
