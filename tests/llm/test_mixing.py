import random

import pytest
from corpus_cases import empty, mix as by_hand, odd_rows, prose, table
from pyspark.sql import functions as F

from mediaspark.llm import mixing
from mediaspark.llm.queries import prepare


def rows_of(seed):
    rng = random.Random(seed)
    out = []
    for i in range(300):
        s = rng.choice(["big"] * 6 + ["a", "b", "é", "z", None])
        out.append((i, " ".join(prose(rng, rng.choice([0, 1, 5, 30, 80]))), "en", s, 0))
    return out


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_by_hand(spark, seed):
    rows = rows_of(seed) + (odd_rows() if seed == 2 else [])
    if seed == 3:
        # A third of all words in one row that repeats, and rows without an id.
        rows += [(7000, " ".join(prose(random.Random(1), 10)), "en", "a", 0)] * 300 + [(None, "x y z", "en", s, 0) for s in ("a", "b", None) * 20]
    taken, goal, total = by_hand([(r[0], r[3], r[1]) for r in rows])
    got = mixing.mix(table(prepare(spark), rows).withColumn("size", F.lit("clash"))).collect()
    assert len(got) == len(rows)
    found = {}
    for r in got:
        assert r.source_size == total[r.source] and r.target == pytest.approx(goal[r.source]) and r.taken <= 2 * r["size"]
        if r.taken:
            found[r.doc_id, r.source, r["size"]] = found.get((r.doc_id, r.source, r["size"]), 0) + r.taken
    assert found == {k: n for k, n in taken.items() if n}
    assert sum(r.taken for r in got) <= 1.5 * sum(total.values())
    for s in goal:
        # Each source comes near its target: what is missing is less than one document of each source.
        assert abs(sum(r.taken for r in got if r.source == s) - goal[s]) <= 6 * 80 + (60_000 if seed == 2 else 0)


def test_rows_of_the_mix(spark):
    rows = rows_of(3)
    df = table(prepare(spark), rows)
    out = mixing.mixed(df)
    assert out.columns == df.columns
    copies = {r.doc_id: r["copies"] for r in mixing.mix(df).collect()}
    got = {}
    for r in out.collect():
        got[r.doc_id] = got.get(r.doc_id, 0) + 1
    assert got == {i: n for i, n in copies.items() if n}


def test_empty_and_wordless(spark):
    assert mixing.mix(empty(prepare(spark))).collect() == []
    assert mixing.mixed(empty(spark)).collect() == []
    none = table(spark, [(1, None, "en", "s", 0), (2, " ", "en", None, 1)])
    assert {(r.doc_id, r.taken) for r in mixing.mix(none).collect()} == {(1, 0), (2, 0)}


def test_repeated_rows_count_each(spark):
    rows = [(7, "a b c", "en", "s", 0)] * 3 + [(8, "d", "en", "s", 0)]
    got = mixing.mix(table(prepare(spark), rows)).collect()
    assert len(got) == 4 and {r.source_size for r in got} == {10}
    assert sum(r.taken for r in got) <= 15
    # Every row of the mix comes as often as it is taken, also where the cut falls between equal rows.
    df = table(spark, [(7, "a b c", "en", "s", 0)] * 200 + [(i, "a b", "en", "t", 0) for i in range(100, 140)])
    mix = mixing.mix(df).collect()
    assert sum(r.taken for r in mix) <= 1.5 * 680 and len({r.taken for r in mix if r.doc_id == 7}) == 2
    out = [r.doc_id for r in mixing.mixed(df).collect()]
    assert all(out.count(i) == sum(r["copies"] for r in mix if r.doc_id == i) for i in {r.doc_id for r in mix})
