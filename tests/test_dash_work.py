"""DASH: filters repeat no work, templates are filled row by row."""

import re

from mediaspark.operators import dash

URL = "https://m.example.com/v/"


def filters(df):
    """The filters of the plan, each as one text."""
    return [l for l in df._jdf.queryExecution().executedPlan().toString().split("\n") if re.match(r"[\s:+*()0-9-]*Filter ", l)]


def one(spark, body, name):
    return spark.createDataFrame([("m", URL + name, body)], "manifest_id string, url string, body string")


def test_dash_filters_repeat_no_work(spark):
    found = filters(dash.dash_segments(one(spark, "", "x.mpd")))
    assert found and all("lambda" not in l and len(l) < 2000 for l in found)


def test_dash_templates_row_by_row(spark):
    def rep(name, inner):
        return f'<Representation id="{name}" bandwidth="7">{inner}</Representation>'
    media = 'media="$RepresentationID$/$Number%03d$-$Number$-$Bandwidth$-$Time$-$Time%4d$"'
    line = '<SegmentTimeline><S t="5" d="10" r="1"/><S d="3"/></SegmentTimeline>'
    body = ('<MPD mediaPresentationDuration="PT4S"><Period><AdaptationSet mimeType="video/mp4">'
            + rep("plain", f'<SegmentTemplate timescale="1" duration="2" startNumber="9" {media}/>')
            + rep("line", f'<SegmentTemplate timescale="10" {media}>{line}</SegmentTemplate>')
            + rep("none", f'<SegmentTemplate {media}><SegmentTimeline><S t="5"/></SegmentTimeline></SegmentTemplate>')
            + rep("list", f'<SegmentList timescale="10">{line}<SegmentURL media="a$Time$"/><SegmentURL media="b"/></SegmentList>') + "</AdaptationSet></Period></MPD>")
    got = [(r.format_id, r.seq, r.location, r.duration) for r in dash.dash_segments(one(spark, body, "x.mpd")).orderBy("rep_no", "seq").collect()]
    assert got == [
        # Without a timeline the marks of time stay.
        ("plain", 1, "plain/009-9-7-$Time$-$Time%4d$", 2.0), ("plain", 2, "plain/010-10-7-$Time$-$Time%4d$", 2.0),
        ("line", 1, "line/001-1-7-5-   5", 1.0), ("line", 2, "line/002-2-7-15-  15", 1.0), ("line", 3, "line/003-3-7-25-  25", 0.3),
        ("none", 1, "none/001-1-7--    ", None),
        ("list", 1, "a$Time$", 1.0), ("list", 2, "b", 1.0), ("list", 3, None, 0.3)]
