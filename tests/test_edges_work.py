"""Edges between manifests are followed once a manifest, not once a row."""

import random

from mediaspark.operators import manifests as mf


def behind(rows, kids):
    """Row by row: what stands behind the edges."""
    out, live = [], []
    for r in rows:
        new = (r[0], [r[1]], r[2], r[3], list(r[4:]), [r[3]])
        (out if r[2] == "format" else live).append(new)
    while live:
        media, path, _, url, (fid, tbr, width, height), seen = live.pop()
        found = [k for k in kids if k[0] == url and url is not None]
        for _, pos, route, k_url, k_fid, *k_sizes in found:
            if route is None:
                continue
            only = len(found) == 1
            sizes = [k or own if only and (k or own) is not None else (own if only and not k else k) for k, own in zip(k_sizes, (tbr, width, height))]
            name = fid if only and (tbr or 0) != 0 else k_fid
            kind = "cycle" if route != "format" and k_url in seen else route
            new = (media, path + [pos], kind, k_url, [name, *sizes], seen + [k_url])
            (out if kind in ("format", "cycle") else live).append(new)
    return [(m, p, r, u, *v) for m, p, r, u, v, _ in out]


def test_edges_follow_manifests_not_rows(spark, monkeypatch):
    rng = random.Random(4)
    some = lambda: rng.choice([None, 0, rng.randrange(1, 9)])
    kids = []
    for name in [f"m{i}" for i in range(12)]:
        for pos in range(rng.choice([1, 1, 1, 2, 3])):
            kids.append((name, pos, *rng.choice([("format", f"u{rng.randrange(5)}"), ("m3u8", f"m{rng.randrange(14)}")]), f"k{name}{pos}", some(), some(), some()))
    rows = [(i, i, rng.choice(["format", "f4m", "m3u8"]), rng.choice([None, *[f"m{j}" for j in range(13)]]), f"p{i}", some(), some(), some()) for i in range(400)]
    sizes = "format_id string, tbr bigint, width int, height int"
    f = spark.createDataFrame([(r[0], r[1], r[2], r[3], r[4], r[5], r[6], r[7]) for r in rows], f"media_id bigint, pos bigint, route string, url string, {sizes}")
    c = spark.createDataFrame(kids, f"manifest_url string, pos bigint, route string, url string, {sizes}")
    written, cut = [], mf.cut

    def counted(df):
        df = cut(df)
        written.append(df.count())
        return df
    monkeypatch.setattr(mf, "cut", counted)
    key = lambda r: [(x is not None, x) if not isinstance(x, list) else (True, str(x)) for x in r]
    for most in (100_000, 0):
        monkeypatch.setattr(mf, "MAX_BROADCAST_ROWS", most, raising=False)
        got = [tuple(r) for r in mf.resolve_manifest_edges(f, c).select("media_id", "path", "route", "url", "format_id", "tbr", "width", "height").collect()]
        assert sorted(got, key=key) == sorted(behind(rows, kids), key=key) and len(got) > 400
    # Equal rows in any number write no more.
    first = sum(written) // 2
    written.clear()
    many = f.crossJoin(spark.range(50)).drop("id")
    assert mf.resolve_manifest_edges(many, c).count() == 50 * len(got)
    assert sum(written) == first
