import hashlib
import random
import zlib
from fractions import Fraction

import numpy as np
from corpus_cases import WORD, empty, odd_rows, table
from pyspark.sql import functions as F

from mediaspark.llm import periodic
from mediaspark.llm.queries import QUERIES, prepare


def by_hand(w, min_length=24, min_power=3):
    """Every period at every place; a run's period is its smallest one."""
    out = []
    for q in range(1, len(w) // min_power + 1):
        i = 0
        while i < len(w) - q:
            if w[i] != w[i + q]:
                i += 1
                continue
            start = i
            while i < len(w) - q and w[i] == w[i + q]:
                i += 1
            x = w[start:i + q]
            if len(x) >= max(min_length, min_power * q) and not any(x[d:] == x[:-d] for d in range(1, q)):
                out.append((start, len(x), q))
    return sorted(out, key=lambda r: (r[0], r[2]))


def repeats(rng):
    out = []
    for _ in range(rng.randrange(1, 6)):
        letters = rng.choice([1, 2, 3, 50])
        base = [b"%d" % rng.randrange(letters) for _ in range(rng.randrange(1, 60))]
        out += base * rng.choice([1, 1, 3, 4, 7]) + base[:rng.randrange(len(base) + 1)]
    out = out * rng.choice([1, 1, 1, 2, 3, 4])
    if rng.random() < 0.3:
        out[rng.randrange(len(out))] = b"other"
    return out[:900]


def test_runs_by_hand():
    rng = random.Random(3)
    texts = [repeats(rng) for _ in range(200)]
    texts += [[], [b"a"], [b"a"] * 23, [b"a"] * 24, [b"a", b"b"] * 12, [b"a", b"b"] * 300, [b"%d" % (i % 8) for i in range(24)]]
    # Runs of one word between others, whose blocks recur at every distance; periods at the borders of the scales.
    texts += [([b"x"] * k + [b"y"]) * 6 for k in (7, 8, 15, 16, 40, 70)]
    texts += [[b"%d" % (i % q) for i in range(3 * q + e)] for q in (7, 8, 9, 15, 16, 17, 31, 32, 33, 64) for e in (-1, 0, 5)]
    assert periodic.runs_of(texts) == [by_hand(t) for t in texts]
    assert [periodic.runs_of([t])[0] for t in texts[:60]] == [by_hand(t) for t in texts[:60]]


def test_transform_is_exact():
    rng = np.random.default_rng(1)
    for size in (8, 64):
        blocks, wide = (rng.integers(0, periodic.PRIME, (3, n), dtype=np.uint64) for n in (size, 2 * size))
        got = periodic.products(blocks, wide)
        for r in range(3):
            for d in range(size + 1):
                assert int(got[r, d]) == sum(int(a) * int(b) for a, b in zip(blocks[r], wide[r, d:])) % periodic.PRIME


def test_long_repeats_stay_fast():
    assert periodic.runs_of([[b"a"] * 60_000]) == [[(0, 60_000, 1)]]
    found = periodic.runs_of([([b"a"] * 20_000 + [b"b"]) * 4])[0]
    assert (0, 80_004, 20_001) in found and len(found) == 5


def trial(doc_id, text):
    w = WORD.findall(text or "")
    h = zlib.crc32(str(doc_id).encode())
    g, n = h // 10, len(w)
    if h % 10 == 0 and n:
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        w = [x if i < a else w[a + (i - a) % p] for i, x in enumerate(w)]
    return w


def answer(doc_id, w):
    runs = by_hand(w)
    gone = {i for s, n, q in runs for i in range(s + q, s + n)}
    best = min(runs, key=lambda r: (-Fraction(r[1], r[2]), r[0], r[2]), default=None)
    top = (*best, 1000 * best[1] // best[2]) if best else (None,) * 4
    return (doc_id, len(runs), *top, hashlib.sha256("".join(f"{s},{n},{q}\n" for s, n, q in runs).encode()).hexdigest(),
            hashlib.sha256(" ".join(x for i, x in enumerate(w) if i not in gone).encode()).hexdigest())


def test_query_by_hand(spark):
    folder = "/root/testdata/sf0.001"
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{folder}/documents.parquet").select("doc_id", "text").collect()]
    got = sorted(tuple(r) for r in QUERIES["op13_periodic_runs"](spark, folder).collect())
    assert got == sorted(answer(i, trial(i, t)) for i, t in rows)
    assert any(r[1] for r in got)


def test_odd_rows(spark):
    df = table(prepare(spark), [*odd_rows(), (950, "la " * 30 + "end", "en", "s1", 0)]).withColumn("period", F.lit("clash")).withColumn("__other", F.lit(1))
    got = periodic.periodic_runs(df, with_text=True).collect()
    assert len(got) == len(odd_rows()) + 1
    for r in got:
        w = WORD.findall(r.text or "")
        if r.doc_id == 950:
            assert (r.n_runs, r.start, r.length, r.period, r.exponent_milli, r.collapsed) == (1, 0, 30, 1, 30_000, "la end")
        else:
            assert (r.n_runs, r.period, r.collapsed) == (0, None, " ".join(w))
    again = [r for r in got if r.doc_id == 903]
    assert len(again) == 2 and again[0] == again[1]
    assert periodic.periodic_runs(periodic.planted(empty(spark))).collect() == []
    assert periodic.planted(df).select("text").collect() and "clash" in {r.period for r in periodic.planted(df).collect()}
