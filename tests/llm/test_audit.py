import random
import re
from collections import Counter
from itertools import permutations

import numpy as np
from corpus_cases import WORD, empty, odd_rows, prose, table
from pyspark.sql import functions as F

from mediaspark.llm import audit
from mediaspark.llm.queries import prepare

LABELS = "doc_id bigint, quality int, toxic int"


def fails(text):
    t = text or ""
    w = WORD.findall(t)
    return {f for f, x in zip("ABCD", (len(w) < 50, 100 * len(set(w)) < 65 * len(w), 100 * len(re.findall("[A-Z]", t)) > 5 * len(t), re.search(r"[#$%&*|]", t))) if x}


def by_hand(rows, labels):
    """Every order applied filter by filter to every row; rows are (id, text, lang, source, n_chars)."""
    good = {i for i, q, _ in labels if q == 1 and i is not None}
    toxic = {i for i, _, t in labels if t == 1 and i is not None}
    least = {}
    for i, t, *_ in rows:
        if i is not None:
            least[t or ""] = min(i, least.get(t or "", i))
    docs = [(i, s or "", fails(t) | ({"E"} if i is not None and least[t or ""] < i else set())) for i, t, _, s, _ in rows]
    out, total = {}, Counter()
    for part in {s for _, s, _ in docs}:
        own = [(i, f) for i, s, f in docs if s == part]
        for order in permutations("ABCDE"):
            left, gone = list(own), []
            for step, x in enumerate(order, 1):
                hit = [d for d in left if x in d[1]]
                late = sum(x in d[1] for d in gone)
                left = [d for d in left if x not in d[1]]
                gone += hit
                total[part, x] += len(hit)
                out[part, "".join(order), step] = [len(left), len(hit), late, sum(d[1] == {x} for d in own), sum(d[0] in good for d in hit), sum(d[0] in toxic for d in hit)]
    return {k: (*v, total[k[0], k[1][k[2] - 1]]) for k, v in out.items()}


def texts(seed=2, n=120):
    rng = random.Random(seed)
    out = []
    for _ in range(n):
        w = prose(rng, rng.randrange(0, 120), rng.choice([5, 400, 4000]))
        if rng.random() < 0.3:
            w = [x.upper() if rng.random() < 0.2 else x for x in w]
        out.append(" ".join(w) + rng.choice(["", "", " $", " a|b"]))
    return out + out[:30] + out[:10] * 3 + ["", "", None]


def got(df, labels, **options):
    rows = audit.interactions(df, labels, **options).collect()
    out = {(r.part, r.filter_order, r.step): (r.kept, r.removed, r.redundant, r.unique_fails, r.good_lost, r.toxic_lost, r.shapley) for r in rows}
    assert len(out) == len(rows)
    return out


def data(spark):
    rng = random.Random(8)
    rows = [(i, t, "en", rng.choice(["s1", "s2", "", None]), 0) for i, t in enumerate(texts())]
    rng.shuffle(rows)
    # Repeated rows, rows without an id, ids with two texts.
    rows += rows[:8] + [(None, r[1], "en", "s1", 0) for r in rows[:6]] + [(r[0], "other text", "en", "s2", 0) for r in rows[8:12]]
    labels = [(i, rng.randrange(2), rng.randrange(2)) for i in range(0, 150, 2)] + [(0, 1, 0), (2, None, None), (None, 1, 1), (99_999, 1, 1)]
    return rows, labels, table(prepare(spark), rows), spark.createDataFrame(labels, LABELS)


def test_by_hand(spark):
    rows, labels, df, said = data(spark)
    want = by_hand(rows, labels)
    assert got(df, said) == want and len(want) == 3 * 600


def test_hashes_that_texts_share(spark):
    rows, labels, df, said = data(spark)
    assert got(df, said, hashed=lambda c: F.xxhash64(F.coalesce(F.col(c), F.lit(""))) % 7) == by_hand(rows, labels)


def test_sketch_clears_only_unique_texts(spark):
    rng = np.random.default_rng(5)
    unique = rng.integers(-2**63, 2**63 - 1, 20_000)
    twice = rng.integers(-2**63, 2**63 - 1, 500)
    rows = prepare(spark).createDataFrame([(int(h),) for h in [*unique, *twice, *twice, *[twice[0]] * 2000]], "h bigint").repartition(16)
    size = audit.sketch_size(rows.count())
    maybe = audit.may_repeat(rows, size)
    kept = {r.h for r in rows.filter(maybe("h")).collect()}
    assert set(twice.tolist()) <= kept and len(kept) < 500 + 0.02 * len(unique)
    # A sketch that is far too small clears less, but never a text that repeats.
    small = audit.may_repeat(rows, audit.PIECE)
    assert set(twice.tolist()) <= {r.h for r in rows.filter(small("h")).collect()}
    assert audit.sketch_size(0) == audit.PIECE and audit.sketch_size(10**12) == audit.MAX_PLACES


def test_odd_rows(spark):
    df = table(prepare(spark), odd_rows()).withColumn("mask", F.lit("clash")).withColumn("h", F.lit("clash")).withColumn("part", F.lit("clash"))
    assert got(df, spark.createDataFrame([], LABELS)) == by_hand(odd_rows(), [])
    assert audit.interactions(empty(spark), spark.createDataFrame([(1, 1, 1)], LABELS)).collect() == []
