"""SMIL: filters repeat no work, attributes are read row by row."""

import re

from mediaspark.operators import manifests as mf

URL = "https://m.example.com/v/"


def filters(df):
    """The filters of the plan, each as one text."""
    return [l for l in df._jdf.queryExecution().executedPlan().toString().split("\n") if re.match(r"[\s:+*()0-9-]*Filter ", l)]


def one(spark, body, name):
    return spark.createDataFrame([("m", URL + name, body)], "manifest_id string, url string, body string")


def test_smil_filters_repeat_no_work(spark):
    found = filters(mf.smil_formats(one(spark, "", "x.smil")))
    assert found and all("lambda" not in l and len(l) < 2000 for l in found)


def test_smil_attributes_row_by_row(spark):
    body = ('<smil><head><meta name="x" httpBase="http://b.example.com/m/"/></head><body>'
            """<video SRC='a&amp;b.mp4?x="1"' width=640 alt=' src="no.mp4"' src="c&amp;d.mp4" system-bitrate="" systemBitrate="64000"/>"""
            '<video src=""/><video/><video src="c&#38;d.mp4" width="1"/><audio src="e.webm" ext="weba" fileSize="12"/>'
            '<x:audio src="rtmp:f" proto="rtmp" streamer="rtmp://r.example.com/a?x&amp;y"/><video src="e.webm"/></body></smil>')
    got = [(r.pos, r.route, r.url, r.play_path, r.tbr, r.filesize, r.width, r.ext, r.format_id) for r in mf.smil_formats(one(spark, body, "x.smil")).orderBy("pos").collect()]
    assert got == [
        (0, "http", "http://b.example.com/m/c&d.mp4", None, 64.0, None, 640, "mp4", "http-64"),
        (1, "http", "http://b.example.com/m/e.webm", None, None, None, None, "webm", "http-2"),
        (2, "rtmp", "rtmp://r.example.com/a?x&y", "rtmp:f", None, None, None, "flv", "rtmp-1")]
