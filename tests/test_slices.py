import random

import pytest
from pyspark.sql import functions as F

from mediaspark.operators import playlists as pl


def wanted(text):
    spans = [tuple(map(int, p.split("-"))) if "-" in p else (int(p),) * 2 for p in text.split(",")]
    return list(dict.fromkeys(i for lo, hi in spans for i in range(lo, hi + 1)))


def spelled(spans):
    return [i for _, a, z in spans for i in range(a, z + 1)]


def test_spans_are_what_the_request_says():
    rng = random.Random(1)
    for _ in range(500):
        text = ",".join(f"{a}-{a + rng.randrange(6)}" if rng.random() < 0.5 else str(a) for a in (rng.randrange(0, 20) for _ in range(rng.randrange(1, 9))))
        spans = pl.item_spans(text)
        assert spelled(spans) == wanted(text), text
        assert [n for n, _, _ in spans] == [sum(z - a + 1 for _, a, z in spans[:i]) for i in range(len(spans))]
    assert pl.item_spans("1-5000000") == [(0, 1, 5_000_000)] and pl.item_spans("7,8,9-11,3") == [(0, 7, 11), (5, 3, 3)]


def lists(spark, n=400):
    return spark.range(n).select((F.col("id") % 3).alias("playlist_id"), F.col("id").alias("pos"), F.concat(F.lit("m"), "id").alias("media_id"))


def by_hand(text, n=400):
    out = []
    for p in range(3):
        own = [i for i in range(n) if i % 3 == p]
        want = wanted(text)
        hits = [own[-1] if i == 0 else own[i - 1] for i in want if i <= len(own)]
        out += [(p, f"m{h}", k, want[k - 1]) for k, h in enumerate(hits, 1)]
    return sorted(out)


@pytest.mark.parametrize("hot", [None, 30])
def test_requests(spark, hot):
    many = ",".join(str(i) for i in range(1, 400, 2)) + ",0,2-4"
    for text in ("5,12,1-3,2,0,9", "0", "1-5000000", "130-140,3", "900", many):
        got = pl.pick_items(lists(spark), text, hot).select("playlist_id", "media_id", "out_pos", "playlist_index").collect()
        assert sorted(map(tuple, got)) == by_hand(text), text


@pytest.mark.parametrize("hot", [None, 30])
def test_slices(spark, hot):
    for a, z in ((1, None), (3, 7), (100, -1), (40, 400), (1, 1)):
        got = pl.slice_entries(lists(spark), a, z, hot).collect()
        want = [(p, i + 1) for p in range(3) for i in range(len(range(p, 400, 3))) if a <= i + 1 <= (10**9 if z in (None, -1) else z)]
        assert sorted((r.playlist_id, r.playlist_index) for r in got) == want
        assert all(r.pos == (r.playlist_index - 1) * 3 + r.playlist_id for r in got)


def test_a_slice_keeps_few_rows_before_the_shuffle(spark):
    assert "WindowGroupLimit" in pl.slice_entries(lists(spark), 3, 7)._jdf.queryExecution().executedPlan().toString()
    assert "Limit" in pl.cap(lists(spark), 5, ["pos"])._jdf.queryExecution().optimizedPlan().toString()
