import random

import pytest
from corpus_cases import components, empty, near_copies, odd_rows, shingles, table

from mediaspark.llm import jaccard
from mediaspark.llm.queries import prepare


@pytest.mark.parametrize("width,percent", [(3, 90), (5, 80)])
def test_against_all_pairs(spark, width, percent):
    texts = near_copies()
    got = jaccard.join(table(prepare(spark), texts).repartition(5), width, percent).collect()
    want = components(list(enumerate(texts)), width, percent)
    assert {(r.doc_id, r.n_shingles, r.component_id) for r in got} == want
    assert len(got) == len(texts)
    assert len({c for _, _, c in want}) < len(texts) - 20


def test_lists_too_long_to_broadcast(spark, monkeypatch):
    monkeypatch.setattr(jaccard, "MAX_BROADCAST_IDS", 0)
    texts = near_copies(6)[:40]
    got = jaccard.join(table(prepare(spark), texts)).collect()
    assert {(r.doc_id, r.n_shingles, r.component_id) for r in got} == components(list(enumerate(texts)), 3, 90)


def test_odd_rows(spark):
    rows = odd_rows()
    got = sorted(((r.doc_id, r.n_shingles, r.component_id) for r in jaccard.join(table(prepare(spark), rows)).collect()), key=str)
    want = sorted(((i, len(shingles(t, 3)), None if i is None else {906: 905}.get(i, i)) for i, t, *_ in rows), key=str)
    assert got == want
    assert jaccard.join(empty(spark)).collect() == []


def test_keep_one(spark):
    rows = [(*r[:4], r[4]) for r in odd_rows()]
    kept = jaccard.keep_one(table(prepare(spark), rows)).collect()
    # Null ids stay both, the repeated row once, and the second spelling goes.
    assert sorted(r.doc_id for r in kept if r.doc_id is not None) == [900, 901, 902, 903, 904, 905, 907]
    assert sum(r.doc_id is None for r in kept) == 2
    assert kept[0].__fields__ == ["doc_id", "text", "lang", "source", "n_chars"]
    assert jaccard.keep_one(empty(spark)).collect() == []


def test_keep_one_where_ids_repeat(spark):
    rng = random.Random(2)
    t1, t2, t3 = (" ".join(f"{k}{rng.randrange(50)}" for _ in range(60)) for k in "abc")
    near = t1 + " end"

    def kept(*rows):
        out = jaccard.keep_one(table(prepare(spark), [(i, t, "en", s, 0) for i, t, s in rows])).collect()
        return sorted(((r.doc_id, r.text, r.source) for r in out), key=str)
    # The unrelated text of a document whose other text is a copy stays, as do unrelated texts of one id.
    assert kept((1, t1, "s"), (2, t1, "s"), (2, t2, "s")) == sorted([(1, t1, "s"), (2, t2, "s")])
    assert kept((1, t1, "s"), (1, t2, "s"), (1, t2, "s"), (None, t1, "s"), (None, t1, "s")) == sorted([(1, t1, "s"), (1, t2, "s"), (None, t1, "s"), (None, t1, "s")], key=str)
    # Near copies under one id: one of them, always the same; of equal texts with other columns the first.
    one = kept((3, t1, "s"), (3, near, "s"), (4, near, "s"), (9, t3, "s"), (5, t3, "b"), (5, t3, "a"))
    assert len(one) == 2 and one[0][0] == 3 and one[1] == (5, t3, "a")
    assert one == kept((5, t3, "a"), (4, near, "s"), (5, t3, "b"), (3, near, "s"), (9, t3, "s"), (3, t1, "s"))


def test_bounds_lose_no_pair():
    rng = random.Random(3)
    for percent in (80, 90):
        m = jaccard.Measure(3, percent)
        for _ in range(2000):
            a, b = rng.randrange(1, 300), rng.randrange(1, 300)
            need = -(-percent * (a + b) // (100 + percent))
            if need <= min(a, b):
                # The worst case puts all unshared columns first.
                assert min(m.block(a) - (a - need), m.block(b) - (b - need)) >= min(m.bound(a), m.bound(b), need)


@pytest.mark.parametrize("size", [2, 7])
def test_many_blocks(spark, monkeypatch, size):
    monkeypatch.setattr(jaccard, "BLOCK_ROWS", size)
    rng = random.Random(9)
    base, texts = [f"b{i}" for i in range(150)], []
    for i in range(60):  # edits that leave some pairs just above the threshold and some just below
        t = list(base)
        for _ in range(rng.randrange(0, 5)):
            t[rng.randrange(len(t))] = f"e{rng.randrange(12)}"
        texts.append(" ".join(t))
    got = jaccard.join(table(prepare(spark), texts)).collect()
    want = components(list(enumerate(texts)), 3, 90)
    assert {(r.doc_id, r.n_shingles, r.component_id) for r in got} == want and len({c for *_, c in want}) > 5
