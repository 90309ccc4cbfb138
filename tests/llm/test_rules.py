import random
import re
from collections import Counter

from corpus_cases import WORD, empty, odd_rows, prose, table
from pyspark.sql import functions as F

from mediaspark.llm import rules
from mediaspark.llm.queries import prepare


def measure(text):
    t = text or ""
    w = WORD.findall(t)
    wins = [tuple(w[i:i + 3]) for i in range(len(w) - 2)]
    n = Counter(wins)
    covered = {i + k for i, x in enumerate(wins) if n[x] > 1 for k in range(3)}
    lines = [x for x in t.split("\n") if WORD.search(x)]
    return {"n_words": len(w), "word_chars": sum(map(len, w)), "n_symbols": len(re.findall(r"[#*$%&|<>]", t)), "n_dup_lines": len(lines) - len(set(lines)),
            "n_repeat_words": len(covered), "n_lines": len(lines)}


def texts(seed=1):
    rng = random.Random(seed)
    out = []
    for _ in range(150):
        w = prose(rng, rng.randrange(0, 120), rng.choice([3, 30, 1000]))
        out.append("".join(x + rng.choice([" ", " ", "\n", "\t\x0b ", "###", " ", " | "]) for x in w).replace("a1", rng.choice(["a1", "É😀"])))
    return out


def test_measures_by_hand(spark):
    all_ = texts() + [t for _, t, *_ in odd_rows()]
    rows = [(i, t, "en", "s", 0) for i, t in enumerate(all_)]
    for r in rules.apply_policy(rules.ledger(table(prepare(spark), rows))).collect():
        want = measure(all_[r.doc_id])
        assert {k: r[k] for k in want} == want
        failed = want["n_words"] < 50 or 100 * want["n_repeat_words"] > 50 * want["n_words"]
        assert (r.failure_bits & rules.mask(rules.POLICIES["base"]) != 0) == failed
        assert not (failed and r.kept)


def test_policies_and_ablation(spark):
    book = rules.ledger(table(prepare(spark), texts(2)))
    bits = [r.failure_bits for r in book.collect()]
    for policy, names in rules.POLICIES.items():
        mask = rules.mask(names)
        assert rules.apply_policy(book, policy).filter("kept").count() == sum(not b & mask for b in bits)
        for r in rules.ablation(book, policy).collect():
            bit = rules.mask([r.rule])
            assert (r.n_failed, r.n_only) == (sum(bool(b & bit) for b in bits), sum(b & mask == bit for b in bits))


def test_filter_stays_above_the_measurements(spark):
    plan = rules.apply_policy(rules.ledger(table(prepare(spark), ["a"]))).filter("kept")._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("xxhash64") == 1 and "Python" not in plan


def test_odd_rows(spark):
    df = table(prepare(spark), odd_rows()).withColumn("n_words", F.lit("clash")).withColumn("failure_bits", F.lit(-1))
    got = rules.ledger(df).collect()
    assert len(got) == len(odd_rows())
    assert all(r.failure_bits == 1 for r in got if r.doc_id in (900, 901, 902))
    assert rules.ledger(empty(spark)).collect() == []
    assert {(r.n_failed, r.n_only) for r in rules.ablation(rules.ledger(empty(spark))).collect()} <= {(0, 0)}
