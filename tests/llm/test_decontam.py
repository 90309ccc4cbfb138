import random
import re

import numpy as np
from corpus_cases import WORD, empty, odd_rows, prose, table

from mediaspark.llm import decontam, jaccard
from mediaspark.llm.queries import prepare

ITEM = "A train leaves Berlin with 120 people at 45 km per hour. How many people does the train of Berlin carry after 3 days if 120 people stay on board?"
OTHER = ("A train leaves Lisbon with 950 people at 80 km per hour. How many people does the train of Lisbon carry after 9 days if 950 people stay on board?")
BROKEN = ("A train leaves Lisbon with 950 people at 80 km per hour. How many people does the train of Madrid carry after 9 days if 17 people stay on board?")
FILL = "and so the quiet river went along its stony bed for many a mile without a sound."


def items(spark, *texts):
    return prepare(spark).createDataFrame(list(enumerate(texts)), "item_id bigint, text string")


def found(spark, texts, bench):
    return {(r.doc_id, r.item_id): r for r in decontam.contaminated(table(spark, texts), bench).collect()}


def test_templates(spark):
    texts = [f"{FILL} {ITEM} {FILL}", f"{FILL} {OTHER} {FILL}", f"{FILL} {BROKEN} {FILL}", f"{FILL} {FILL}", ITEM.upper(),
             " ".join(w + "###" for w in ITEM.split()), ITEM.replace("120 people at 45 km", "7 people at 45km"), ITEM[:30], "People stay on board after 3 days."]
    got = found(spark, texts, items(spark, ITEM))
    assert {0, 1, 5} <= {d for d, _ in got} and not {3, 7, 8} & {d for d, _ in got}
    assert got[0, 0].exact and not got[1, 0].exact
    # One name of the item may not stand for two; only the few windows without slots are left.
    assert (2, 0) not in got


def test_one_edited_value_cancels_only_its_windows(spark):
    texts = [f"{FILL} {t} {FILL}" for t in (ITEM.replace("if 120", "if 130"), ITEM.replace("of Berlin", "of Berlim"), ITEM.replace("3 days", "3 weeks"), BROKEN)]
    assert set(found(spark, texts, items(spark, ITEM))) == {(0, 0), (1, 0), (2, 0)}
    assert [r.text for r in decontam.clean(table(spark, texts), items(spark, ITEM)).collect()] == texts[3:]


def test_exact_copies_whatever_their_signs_and_numbers(spark):
    heavy = "Compute 3 + 5 * 7 - 12 / 4 + 81 * 9 - 6 and 2 plus 40 minus 17."
    bench = [ITEM, "What is 12 times 9?", heavy, "7 times 8?", "Anna Karla Berta met Otto Emil in Paris, Texas and Rome"]
    copies = [(0, ITEM.upper()), (0, ITEM.lower()), (0, ITEM.replace(".", "").replace("?", "")), (0, ITEM.replace(".", "!").replace("45 km", "45km").upper()), (1, bench[1]),
              (1, "WHAT IS 12 TIMES 9"), (2, heavy), (2, heavy.lower()), (3, "7 times 8? " * 3), (4, bench[4]), (4, bench[4].lower())]
    others = ["What is 13 times 9?", re.sub(r"\d+", lambda m: f"{m[0]}1", heavy), "7 times 9", "Otto Emil met Anna Karla Berta"]
    got = found(spark, [f"{FILL} {t} {FILL}" for _, t in copies] + others, items(spark, *bench))
    assert set(got) == {(d, i) for d, (i, _) in enumerate(copies)} and all(r.exact for r in got.values())
    assert all(r.covered == r.n_tokens for r in got.values())


def test_plain_tokens_split_numbers_from_units():
    known = decontam.Words()
    a, b = decontam.Template("It weighs 5 KG or 12lb today", known), decontam.Template("it weighs 5kg Or 12 lb. Today", known)
    assert (a.plain == b.plain).all() and len(set(a.plain)) == 8


def test_units_behind_numbers():
    known = decontam.Words()
    a, b = decontam.Template("it weighs 5 kg or 12lb today, and", known), decontam.Template("it weighs 5kg or 12 lb today and", known)
    assert (a.hashes == b.hashes).all() and a.slots(0, 8) == b.slots(0, 8) == ["5", "kg", "12", "lb"]


def plain_pairs(docs, bench):
    """(doc, item) pairs by literal windows of eight lower-case cores, for texts without slots."""
    grams = {}
    for i, t in bench:
        w = [decontam.core(x).lower() for x in WORD.findall(t)]
        for k in range(len(w) - 7):
            grams.setdefault(tuple(w[k:k + 8]), []).append((i, k, len(w)))
    out = set()
    for d, t in docs:
        w = [x for x in (decontam.core(x).lower() for x in WORD.findall(t)) if x]
        at = {}
        for k in range(len(w) - 7):
            for i, p, n in grams.get(tuple(w[k:k + 8]), ()):
                at.setdefault((i, n), set()).update(range(p, p + 8))
        out |= {(d, i) for (i, n), s in at.items() if len(s) >= 12 or len(s) >= 0.4 * n}
    return out


def test_against_plain_windows(spark):
    rng = random.Random(4)
    bench = [" ".join(prose(rng, rng.randrange(8, 60), 3000)) for _ in range(40)]
    texts = []
    for i in range(300):
        w = prose(rng, rng.randrange(0, 200), 3000)
        if i % 3 == 0:
            b = rng.choice(bench).split()
            a = rng.randrange(len(b) - 4)
            w[len(w) // 2:len(w) // 2] = b[a:a + rng.randrange(4, 60)]
        texts.append(" ".join(w))
    texts += texts[:10]
    got = set(found(spark, texts, items(spark, *bench)))
    assert got == plain_pairs(list(enumerate(texts)), list(enumerate(bench))) and len(got) > 40


def test_words_in_bytes_are_what_the_text_rules_say():
    words = ["He", "HE", "he,", "(Rome)", "a", "A", "I.", "\"No!\"", "km", "KM.", "x3", "3x", "5kg", "12,", "...", "$", "end.)*", "U.S.A.", "don't", "-", "mm#", "Zoë", "é."]
    fast, slow = decontam.Words(), decontam.Words()
    for w in words:
        # Behind a letter that is not ASCII, which core() takes off again as an outer sign, the rules for texts apply.
        assert fast[w.encode()] == slow[("\u00bf" + w).encode()], w


def test_windows_of_many_items(spark):
    """A prompt that all items share makes no pairs; with a copy of an item behind it, it counts for that item."""
    rng = random.Random(7)
    prompt = "read the question below with care and then choose the one best answer"
    own = [" ".join(prose(rng, 20, 3000)) for _ in range(60)]
    bench = items(spark, *[f"{prompt} {t}" for t in own], f"{prompt} {own[3]}")
    texts = [f"{FILL} {prompt} {FILL}"] * 50 + [f"{FILL} {prompt} {own[i]}" for i in range(20)] + [f"{FILL} {own[i]}" for i in range(20)]
    got = found(spark, texts, bench)
    assert set(got) == {(50 + i, i) for i in range(20)} | {(70 + i, i) for i in range(20)}
    assert all(r.covered == r.n_tokens for (d, _), r in got.items() if d < 70) and all(r.covered == 20 for (d, _), r in got.items() if d >= 70)
    classes = {r.item_id: r.class_id for r in decontam.item_classes(bench).collect()}
    assert classes == {**{i: i for i in range(60)}, 60: 3}


def test_items_of_one_template_stand_together(spark):
    bench = items(spark, *[f"how many apples does the farmer keep if {i} people each take {i + 7} of them" for i in range(40)])
    texts = [f"{FILL} how many apples does the farmer keep if {n} people each take {n + 1} of them {FILL}" for n in range(500, 520)]
    texts.append(f"{FILL} how many apples does the farmer keep if 21 people each take 28 of them {FILL}")
    got = found(spark, texts, bench)
    # Other numbers are found by the smallest item; a copy of an item also by its own.
    assert {d for d, _ in got} == set(range(21)) and len(got) <= 2 * len(texts)


def test_odd_rows(spark):
    rows = odd_rows() + [(None, ITEM, None, None, 1), (910, ITEM, "en", "s", 1), (910, ITEM, "en", "s", 1), (910, FILL, "en", "s", 1)]
    bench = prepare(spark).createDataFrame([(1, ITEM, "x"), (1, ITEM, "x"), (2, None, "x"), (3, "", "x"), (None, "too short", "x"), (4, "five words are one window", "x")],
                                           "item_id bigint, text string, doc_id string")
    assert {(r.doc_id, r.item_id) for r in decontam.contaminated(table(spark, rows), bench).collect()} == {(None, 1), (910, 1)}
    kept = decontam.clean(table(spark, rows), bench)
    assert kept.columns == ["doc_id", "text", "lang", "source", "n_chars"]
    assert sorted((r.doc_id for r in kept.collect()), key=str) == sorted([r[0] for r in odd_rows()] + [910], key=str)
    assert decontam.contaminated(empty(spark), bench).collect() == []
    none = spark.createDataFrame([], bench.schema)
    assert decontam.contaminated(table(spark, rows), none).collect() == []
    assert decontam.clean(table(spark, rows), none).count() == len(rows)


def test_short_items_match_whole(spark):
    got = found(spark, ["see: Five words are one window!", "five words are one door"], items(spark, "five words are one window"))
    assert set(got) == {(0, 0)}


def test_bitmap_is_exact_on_its_bits(spark):
    h = [0, 1, -1, 2**62, -(2**63), 12345678901234567]
    may = decontam.bitmap(prepare(spark).createDataFrame([(x,) for x in h], "hash bigint"))
    top = {(x & (2**64 - 1)) >> 41 for x in h}
    assert {c * 64 + b for c in np.flatnonzero(may) for b in range(64) if int(may[c]) >> b & 1} == top


def test_long_list_of_contaminated(spark, monkeypatch):
    monkeypatch.setattr(jaccard, "MAX_BROADCAST_IDS", 0)
    assert decontam.clean(table(prepare(spark), [ITEM, FILL]), items(spark, ITEM)).collect()[0].text == FILL


def test_shared_windows_count_for_the_class_that_stands(spark):
    """A prompt of more items than a window may have: the document that holds it alone is found, by one item that stands for all."""
    rng = random.Random(7)
    prompt = "read the question below with care and then choose the one best answer"
    own = [" ".join(prose(rng, 20 + i % 2, 3000)) for i in range(30)]
    bench = items(spark, *[f"{prompt} {t}" for t in own], *[f"{t} {prompt}" for t in own[:15]])
    texts = [f"{FILL} {prompt} {FILL}", f"{FILL} {prompt} {own[4]}", f"{FILL} {own[7]}", FILL]
    docs = table(prepare(spark), texts)
    got = {(r.doc_id, r.item_id): r for r in decontam.contaminated(docs, bench, shared=True).collect()}
    # Wherever it stands in an item, the prompt is one part.
    assert {d for d, _ in got} == {0, 1, 2} and [i for d, i in got if d == 0] == [0] and got[0, 0].covered == 13
    assert got[1, 4].covered == got[1, 4].n_tokens == 33 and got[2, 7].covered == 21
    members = decontam.shared_members(bench).collect()
    assert {r.item_id for r in members} == {0} and {r.stands_for for r in members} == set(range(45))
    assert [r.text for r in decontam.clean(docs, bench, shared=True).collect()] == [FILL]
    # Without it the rule of common windows holds.
    assert {r.doc_id for r in decontam.contaminated(docs, bench).collect()} == {1, 2}
