import random
import zlib

from corpus_cases import empty, odd_rows, prose, table
from pyspark.sql import functions as F

from mediaspark.llm import sharding
from mediaspark.llm.queries import prepare


def many(seed=1, n=2000):
    rng = random.Random(seed)
    texts = [" ".join(prose(rng, rng.randrange(1, 60))) for _ in range(n)]
    texts[::9] = ["the same text every time"] * len(texts[::9])
    return [(i, t, rng.choice(["en", "de"]), f"src{min(rng.randrange(12), 6)}", len(t)) for i, t in enumerate(texts)]


def placed(spark, rows, **kw):
    return sharding.shard(table(spark, rows), **kw).collect()


def check(got, rows, shards):
    assert len(got) == len(rows)
    want = [(i, len((t or "").encode()) + 1, zlib.crc32((t or "").encode())) for i, t, *_ in rows]
    assert sorted(((r.doc_id, r["size"], r.text_crc32) for r in got), key=str) == sorted(want, key=str)
    sizes = {}
    for s in range(shards):
        own = [r for r in got if r.shard == s]
        assert sorted(r.slot for r in own) == list(range(len(own)))
        sizes[s] = sum(r["size"] for r in own)
    return sizes


def test_bytes_are_near_equal(spark):
    rows = many()
    prepare(spark)
    for shards in (2, 5, 8):
        got = placed(spark, rows, shards=shards)
        sizes = check(got, rows, shards)
        mean = sum(sizes.values()) / shards
        assert all(abs(s - mean) < 0.08 * mean for s in sizes.values()), sizes
    assert sorted(map(tuple, got)) == sorted(map(tuple, placed(spark, rows[::-1], shards=8)))


def test_groups_of_equal_texts_stay_together(spark):
    rng = random.Random(2)
    texts = [" ".join(prose(rng, 40)) for _ in range(600)]
    rows = [(i, texts[i % 600], "en", f"s{i % 7}", 0) for i in range(1200)]
    got = placed(prepare(spark), rows, shards=4)
    by = {}
    for r in got:
        by.setdefault(r.text_crc32, set()).add(r.shard)
    assert all(len(s) == 1 for s in by.values())


def test_first_cut_is_the_weighted_median(spark):
    rows = [(i, "x" * (i % 50 + 1), "en", "same", 0) for i in range(1000)]
    got = placed(prepare(spark), rows, shards=2)
    low, high = ([r["size"] for r in got if r.shard == s] for s in (0, 1))
    assert max(low) <= min(high)
    assert abs(sum(low) - sum(high)) <= 2 * 20 * 51


def tree(points, shards):
    """{point: shard} of a k-d tree over [(point, weight, (x0, x1, x2), (c0, c1, c2), tie)], split by sorting each node."""
    span = [max(p[2][d] for p in points) - min(p[2][d] for p in points) or 1.0 for d in range(3)]
    out = {}

    def split(node, first, k):
        if k == 1 or not node:
            out.update((p[0], first) for p in node)
            return
        width = [(max(p[2][d] for p in node) - min(p[2][d] for p in node)) / span[d] for d in range(3)]
        dim, left, total = width.index(max(width)), k // 2, sum(p[1] for p in node)
        goal, upto = total * left / k, 0
        node = sorted(node, key=lambda p: (p[3][dim], p[4]))
        for i, p in enumerate(node):
            upto += p[1]
            if upto >= goal:
                break
        at = i + 1 if upto - goal <= goal - (upto - p[1]) else i
        split(node[:at], first, left)
        split(node[at:], first + left, k - left)
    split(points, 0, shards)
    return out


def test_whole_tree_by_hand(spark, monkeypatch):
    monkeypatch.setattr(sharding, "WHOLE", 0.001)  # no text is so large that it is cut into parts
    rng = random.Random(11)
    # Sources with a long common start, languages, a few null ones; sizes of any kind.
    names = [f"commoncrawl-20{y}" for y in range(10, 40)] + [None]
    rows = [(i, " ".join(prose(rng, int(rng.expovariate(0.05)) + 1)), rng.choice(["en", "de", "pt-BR", "pt-PT", None]), rng.choice(names), 0) for i in range(700)]
    df = table(prepare(spark), rows)
    ties = {r.doc_id: (r.x, r.t) for r in sharding.described(df).select("doc_id", F.ln("size").alias("x"), F.xxhash64("th", F.lit(0).cast("bigint")).bitwiseAND(F.lit(0xFFFFFFFF).cast("bigint")).alias("t")).collect()}
    number = [{v: i for i, v in enumerate(sorted({r[c] for r in rows if r[c] is not None}), 1)} for c in (3, 2)]
    points = []
    for i, t, lang, source, _ in rows:
        size, x1, x2 = len(t) + 1, number[0].get(source, 0), number[1].get(lang, 0)
        points.append((i, size, (ties[i][0], x1, x2), (size, x1, x2), ties[i][1]))
    assert len({t for *_, t in points}) == len(rows)
    for shards in (2, 5, 8):
        assert {r.doc_id: r.shard for r in sharding.shard(df, shards=shards).collect()} == tree(points, shards)


def test_target_bytes(spark):
    rows = many(3, 400)
    total = sum(len(r[1]) + 1 for r in rows)
    got = placed(prepare(spark), rows, target_bytes=total // 6 + 1)
    assert {r.shard for r in got} == set(range(6))


def test_odd_rows(spark):
    rows = odd_rows()
    check(placed(prepare(spark), rows, shards=8), rows, 8)
    same = [(1, None, None, None, None)] * 5
    check(placed(spark, same, shards=8), same, 8)
    assert sharding.shard(empty(spark), shards=8).collect() == []
    clash = sharding.shard(table(spark, rows).withColumn("size", F.lit("x")).withColumn("shard", F.lit("y")), shards=2)
    check(clash.collect(), rows, 2)
