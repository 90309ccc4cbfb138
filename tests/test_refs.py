import random

from pyspark.sql import functions as F

from mediaspark.operators import playlists as pl

SCHEMA = "url string, type string, target string, id string, title string, uploader string"


def by_hand(rows):
    """Each row followed step by step over the nodes, one per url."""
    nodes = {}
    text = lambda r: "{" + ",".join(f'"{k}":"{v}"' for k, v in zip(("type", "target", "id", "title", "uploader"), r[1:]) if v is not None) + "}"
    for r in rows:
        if r[0] is not None and (r[0] not in nodes or text(r) < text(nodes[r[0]])):
            nodes[r[0]] = r
    out = []
    for r in rows:
        now, seen, status = r, 0, None
        while now[1] in ("url", "url_transparent"):
            t = nodes.get(now[2])
            if t is None:
                status = "missing"
                break
            if seen > len(nodes):
                status = "cycle"
                break
            seen += 1
            if now[1] == "url_transparent":
                kind = "url_transparent" if t[1] == "url" else t[1]
                now = (t[0], kind, t[2], t[3], now[4] if now[4] is not None else t[4], now[5] if now[5] is not None else t[5])
            else:
                now = t
        out.append((r[0], *(r if status == "cycle" else now), status or "resolved"))
    return sorted(out, key=str)


def check(spark, rows):
    got = pl.resolve_refs(spark.createDataFrame(rows, SCHEMA)).select("source", *SCHEMA.replace(" string", "").split(", "), "status").collect()
    assert len(got) == len(rows)
    assert sorted(map(tuple, got), key=str) == by_hand(rows)


def test_repeated_rows_do_not_multiply(spark):
    a, b, c = ("a", "url", "b", "1", None, None), ("b", "url", "c", "2", None, None), ("c", "video", None, "3", "end", None)
    check(spark, [a, a, b, b, c])
    check(spark, [a] * 3 + [b] * 2 + [c] * 4 + [("a", "url_transparent", "c", "9", "other", "me")])


def test_chains_by_hand(spark):
    rng = random.Random(5)
    for n in (1, 8, 40):
        names = [f"u{i}" for i in range(n)]
        rows = []
        for _ in range(2 * n):
            kind = rng.choice(["url", "url", "url_transparent", "video"])
            target = None if kind == "video" else rng.choice([*names, "gone", None])
            rows.append((rng.choice([*names, None]), kind, target, rng.choice("xyz"), rng.choice([None, "t1", "t2"]), rng.choice([None, "v1"])))
        check(spark, rows)


def test_long_chain_and_cycle(spark):
    chain = [(f"k{i}", "url_transparent" if i % 3 == 0 else "url", f"k{i + 1}", str(i), f"t{i}" if i % 5 == 0 else None, None) for i in range(70)]
    ring = [(f"r{i}", "url", f"r{(i + 1) % 4}", str(i), "ring", None) for i in range(4)]
    check(spark, chain + [("k70", "video", None, "70", "end", "who")] + ring + [("in", "url_transparent", "r2", "0", None, None)])
