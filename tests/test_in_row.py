"""Manifests are worked on within their row: no shuffle, one reading, and time in proportion to their lines."""

import random
import re
import time

import pytest
from pyspark.sql import functions as F

from mediaspark.functions import values as vx
from mediaspark.functions.core import scan
from mediaspark.operators import dash, hls, manifests as mf

URL = "https://m.example.com/v/"


def one(spark, body, name="x"):
    return spark.createDataFrame([("m", URL + name, body)], "manifest_id string, url string, body string")


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("n", [0, 1, 2, 3, 7, 8, 9, 100])
def test_scan(spark, n):
    rng = random.Random(n)
    v = [rng.randrange(100) if rng.random() < 0.5 else None for _ in range(n)]
    kind = "struct<last:bigint,n:bigint,text:string>"
    d = spark.createDataFrame([(v,)], "v array<bigint>").withColumn("x", F.transform("v", lambda x: F.struct(x.alias("last"), F.lit(1).alias("n"), x.cast("string").alias("text"))))
    add = lambda x, y: F.struct(F.coalesce(y["last"], x["last"]).alias("last"), (x["n"] + y["n"]).alias("n"), F.nullif(F.concat_ws(",", x["text"], y["text"]), F.lit("")).alias("text"))
    got = d.select(scan(F.col("x"), kind, add)).first()[0]
    told = [[x for x in v[:i + 1] if x is not None] for i in range(n)]
    # The text shows that all elements were combined, each once and in order.
    assert [(r.last, r.n, r.text or "") for r in got] == [(t[-1] if t else None, i + 1, ",".join(map(str, t))) for i, t in enumerate(told)]


def segments_by_hand(body):
    """The rules of a media playlist, line by line."""
    out, key, ad, seq, kept, at, total, size = [], {}, False, None, 0, None, None, None
    for l in re.split(r"\r\n|\r|\n", body):
        l = l.strip(" ")
        if l.startswith("#EXT-X-KEY:"):
            key = dict(re.findall(r'([A-Z0-9-]+)="?([^",]+)"?', l[11:]))
        elif l.startswith("#EXT-X-MEDIA-SEQUENCE:"):
            seq, kept = int(l[22:]), 0
        elif l.startswith("#EXT-X-BYTERANGE:"):
            n, _, start = l[17:].partition("@")
            at, total = (int(start), int(n)) if start else (at, (total or 0) + int(n))
            size = int(n)
        elif l.startswith("#UPLYNK-SEGMENT"):
            ad = True if l.endswith(",ad") else False if l.endswith(",segment") else ad
        elif l and not l.startswith("#"):
            if not ad:
                kept += 1
                stop = (at or 0) + total if size is not None else None
                out.append((len(out) + 1, (seq or 0) + kept - 1, URL + l, key.get("METHOD", "NONE"), None if stop is None else stop - size, stop))
    return out


def test_segments_by_hand(spark):
    rng = random.Random(3)
    bodies = ["", "#EXTM3U\n", "a.ts"]
    for _ in range(40):
        lines = ["#EXTM3U"]
        for i in range(rng.randrange(40)):
            lines.append(rng.choice(["#EXT-X-KEY:METHOD=AES-128,URI=\"k\"", "#EXT-X-KEY:METHOD=NONE", f"#EXT-X-MEDIA-SEQUENCE:{rng.randrange(99)}", f"#EXT-X-BYTERANGE:{rng.randrange(1, 9)}",
                                     f"#EXT-X-BYTERANGE:{rng.randrange(1, 9)}@{rng.randrange(99)}", "#UPLYNK-SEGMENT:x,ad", "#UPLYNK-SEGMENT:x,segment", "#EXTINF:9,", "", f" s{i}.ts ", f"s{i}.ts", f"t{i}.ts"]))
        bodies.append(rng.choice(["\n", "\r\n", "\r"]).join(lines))
    d = spark.createDataFrame([(i, URL + "x.m3u8", b) for i, b in enumerate(bodies)], "manifest_id int, url string, body string")
    got = {}
    for r in hls.hls_segments(d).orderBy("manifest_id", "frag_index").collect():
        got.setdefault(r.manifest_id, []).append((r.frag_index, r.media_sequence, r.url, r.key_method, r.range_start, r.range_end))
    want = {i: segments_by_hand(b) for i, b in enumerate(bodies)}
    assert got == {i: w for i, w in want.items() if w}
    counts = {r.manifest_id: (r.media_frags, r.media_frags + r.ad_frags) for r in hls.hls_counts(d).collect()}
    assert counts == {i: (len(want[i]), sum(bool(l.strip(" ")) and l.strip(" ")[0] != "#" for l in re.split(r"\r\n|\r|\n", b))) for i, b in enumerate(bodies)}


def test_no_shuffle_and_one_reading(spark):
    d = one(spark, "")
    jobs = {"segments": hls.hls_segments(d), "counts": hls.hls_counts(d), "dash": dash.dash_segments(d), "ism": mf.ism_segments(d), "f4m": mf.f4m_formats(d)}
    for name, out in jobs.items():
        p = plan(out)
        assert "Exchange" not in p and "Window" not in p, name
        assert p.count("from_xml") <= 1, name


def timed(job, body):
    start = time.time()
    rows = job(body)
    return time.time() - start, rows


def test_large_manifests_take_time_in_proportion(spark):
    def variants(n):
        lines = "".join(f'#EXT-X-STREAM-INF:BANDWIDTH={i}000,AUDIO="a{i % 3}",PROGRESSIVE-URI="p{i}"\ns{i}.m3u8\n' for i in range(n))
        tracks = "".join(f'#EXT-X-MEDIA:TYPE=AUDIO,GROUP-ID="a{i % 3}",NAME="n{i}",URI="u{i}"\n' for i in range(n // 4))
        return hls.hls_variants(one(spark, "#EXTM3U\n" + tracks + lines)).agg(F.count("*"), F.max("pos")).first()

    def media(n):
        return mf.f4m_formats(one(spark, "<manifest>" + "".join(f'<media url="f{i}.mp4" bitrate="{i}"/>' for i in range(n)) + "</manifest>")).agg(F.count("*"), F.max("pos")).first()

    def parts(n):
        return hls.hls_segments(one(spark, "#EXTM3U\n" + "".join(f"#EXT-X-BYTERANGE:10\ns{i}.ts\n" for i in range(n)))).agg(F.count("*"), F.max("range_end")).first()
    for job, rows in ((variants, lambda n: (2 * n + n // 4, 2 * n + n // 4 - 1)), (media, lambda n: (n, n - 1)), (parts, lambda n: (n, 10 * n))):
        job(2000)
        small, got = timed(job, 4000)
        assert tuple(got) == rows(4000)
        large, got = timed(job, 20_000)
        assert tuple(got) == rows(20_000)
        # Five times the lines, and a second for what the machine does besides.
        assert large < 5 * small * 1.5 + 1, (job.__name__, small, large)


def test_relative_places_follow_each_other(spark):
    links = ["a.mp4", "sub/b.mp4", "c.mp4", "https://o.example.com/x/d.mp4", "e.mp4", "deep/er/f.mp4", "", "g.mp4"]
    body = "<manifest>" + "".join(f'<media url="{u}"/>' for u in links) + "</manifest>"
    at, want = URL + "m.f4m", []
    for u in links:
        if u:
            at = u if u.startswith("http") else re.sub("/[^/]*$", "", at) + "/" + u
            want.append(at)
    assert [r.url for r in mf.f4m_formats(one(spark, body, "m.f4m")).orderBy("pos").collect()] == want


def dates(seed=1):
    rng = random.Random(seed)
    out = []
    for fmt in vx.DATE_FORMATS + vx.DAY_FIRST + vx.MONTH_FIRST:
        for _ in range(8):
            fill = {"d": rng.choice(["1", "09", "31", " 7", "0", "32"]), "m": rng.choice(["1", "09", "12", "13"]), "Y": rng.choice(["2012", "1968"]), "y": rng.choice(["09", "70"]),
                    "H": rng.choice(["0", "23", "7", "24"]), "I": rng.choice(["12", "1", "03"]), "M": rng.choice(["00", "5", "59"]), "S": rng.choice(["0", "61", "30"]), "f": rng.choice(["1", "123456"]),
                    "B": rng.choice(["May", "january", "AUGUST", "Septem"]), "b": rng.choice(["may", "Jan", "DEC", "xyz"])}
            t = re.sub("%(.)", lambda m: fill[m[1]], fmt)
            out.append(rng.choice([t, t, t, t.replace(" ", "  "), t.replace(" ", "\t"), t + "\n", " " + t, t + " ", t.upper(), t + "x", t.replace("0", "é", 1)]))
    return out + ["", "soon", "12", "2012", "20101221", None]


def test_dates_of_one_shape_try_few_spellings(spark):
    """The spellings that a text's shape leaves give what all spellings in their order give."""
    texts = dates()
    formats = vx.DATE_FORMATS + vx.DAY_FIRST
    for fits in (formats, formats[::-1]):
        by_shape = {}
        for f in fits:
            for s in vx._shapes(f):
                by_shape.setdefault(s, []).append(f)
        assert max(map(len, by_shape.values())) <= 3
        d = spark.createDataFrame(list(enumerate(texts)), "n int, t string")
        full = None
        for f in fits:
            pattern, repl = vx._date_rule(f)
            hit = F.col("t").rlike(pattern)
            full = F.when(hit, F.regexp_replace("t", pattern, repl)) if full is None else full.when(hit, F.regexp_replace("t", pattern, repl))
        got = d.select("t", vx._moment(F.col("t"), fits).alias("a"), vx._from_parts(full).alias("b")).collect()
        assert [r for r in got if r.a != r.b] == [] and sum(r.a is not None for r in got) > 100
