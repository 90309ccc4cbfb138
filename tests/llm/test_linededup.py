import hashlib
import random
from collections import defaultdict

import pyarrow as pa
from corpus_cases import empty, odd_rows, table
from pyspark.sql import functions as F

from mediaspark.llm import linededup
from mediaspark.llm.queries import prepare

SHARED = [f"this line of more than forty characters is shared, number {i}" for i in range(40)]


def key(line):
    return line.strip(" \t\n\x0b\x0c\r").translate({c: c + 32 for c in range(65, 91)})


def by_hand(rows, min_chars=40, min_docs=5):
    """[(id, lines, lost lines, text that is left)] of (id, text) rows."""
    holders = defaultdict(set)
    for i, t in rows:
        for x in (t or "").split("\n"):
            if i is not None and len(key(x)) >= min_chars:
                holders[key(x)].add(i)
    shared = {k: max(v) for k, v in holders.items() if len(v) >= min_docs}
    out = []
    for i, t in rows:
        lines = (t or "").split("\n")
        left = [x for x in lines if key(x) not in shared or i == shared[key(x)]]
        out.append((i, len(lines), len(lines) - len(left), "\n".join(left)))
    return out


def texts(seed=1, n=150):
    rng = random.Random(seed)
    out = []
    for i in range(n):
        lines = []
        for _ in range(rng.randrange(0, 12)):
            x = rng.choice(SHARED[:rng.choice([3, 40])]) if rng.random() < 0.6 else rng.choice(["", "short", f"own line number {i} of this document, with forty characters"])
            x = rng.choice([x, x.upper(), "  " + x + "\t", x + "\r", " " + x])
            lines += [x] * rng.choice([1, 1, 1, 2, 9])
        out.append("\n".join(lines))
    return out


def check(spark, rows):
    got = linededup.dedup_lines(table(prepare(spark), rows)).collect()
    key_ = (lambda r: (r[0] is None, r[0] or 0, *map(str, r[1:])))
    want = by_hand([(r[0], r[1]) for r in rows])
    assert sorted(((r.doc_id, r.n_lines, r.n_dropped, r.text) for r in got), key=key_) == sorted(want, key=key_)
    assert all(r.kept_sha256 == hashlib.sha256(r.text.encode()).hexdigest() for r in got)
    return want


def test_by_hand(spark):
    rows = [(i, t, "en", "s", 0) for i, t in enumerate(texts())]
    # Ids that repeat, with equal and with other texts; rows without an id; a document that holds one line thousands of times.
    rows += rows[:20] + [(r[0], t, "en", "s", 0) for r, t in zip(rows[30:50], texts(9, 20))]
    rows += [(None, "\n".join([SHARED[0], "own", SHARED[1]]), "en", "s", 0)] * 7 + [(7000, "\n".join([SHARED[2]] * 3000), "en", "s", 0)]
    rows += [(i, SHARED[39] + " and only here", "en", "s", 0) for i in (8001, 8001, 8002, 8003, 8004, None)]
    want = check(spark, rows)
    assert sum(w[2] for w in want) > 500 and all(w[2] == 0 for w in want if w[0] and w[0] > 8000)


def test_one_key_over_many_ranges(spark):
    # One line in all documents, so that its rows fill most ranges, at every number of partitions.
    rows = [(i, f"{SHARED[0]}\nown line number {i} of this document, with forty characters", "en", "s", 0) for i in range(400)]
    before = spark.conf.get("spark.sql.shuffle.partitions")
    try:
        for n in (1, 3, 31):
            spark.conf.set("spark.sql.shuffle.partitions", n)
            want = check(spark, rows)
            assert sum(w[2] for w in want) == 399
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)


def test_ranges_and_batches_of_any_size():
    """The stream over a sorted range, cut at any place into ranges and batches, finds the same lines."""
    rng = random.Random(4)
    rows = []
    for k in range(60):
        ids = sorted({rng.randrange(50) for _ in range(rng.choice([1, 3, 5, 6, 20]))}, reverse=True) + [None] * rng.choice([0, 0, 2])
        rows += [(k // 2, k, i, 0, at) for i in ids for at in range(rng.choice([1, 1, 3]))]
    names = ["h1", "h2", "doc_id", "mark", "at"]
    types = [pa.int64()] * 4 + [pa.int32()]
    holders = defaultdict(set)
    for r in rows:
        holders[r[:2]] |= {r[2]} - {None}
    want = sorted((r for r in rows if len(holders[r[:2]]) >= 5 and r[2] != max(holders[r[:2]])), key=str)
    for _ in range(60):
        # Ranges never part the rows of one document in one key.
        cuts = [i for i in range(1, len(rows)) if rows[i][:3] != rows[i - 1][:3] and rng.random() < 0.1]
        lost, seen, left = [], defaultdict(list), []
        for a, z in zip([0, *cuts], [*cuts, len(rows)]):
            r, out, at = linededup.Range(5), [], a
            while at < z:
                to = min(z, at + rng.choice([1, 2, 5, 40]))
                out += r.add(pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows[at:to]), types)], names))
                at = to
            for b in [*out, *r.over()]:
                for x in b.to_pylist():
                    row = tuple(x[c] for c in names)
                    {linededup.LOST: lost, linededup.OPEN: left}.get(x["kind"], seen[row[:2]]).append(row if x["kind"] != linededup.SEEN else (x["n"], row[2]))
        for row in left:
            total = sum(n for n, _ in seen[row[:2]])
            if total >= 5 and row[2] != max(i for _, i in seen[row[:2]] if i is not None):
                lost.append(row)
        assert sorted(lost, key=str) == want


def test_bitmaps(spark):
    rows = [(i, f"own {i}\n{SHARED[0]}\n" * 3, "en", "s", 0) for i in range(6)]
    maps = linededup.shared_lines(table(prepare(spark), rows)).collect()
    assert sorted(m.doc_id for m in maps) == [0, 1, 2, 3, 4] and {m.n_dropped for m in maps} == {3}
    assert linededup.stays(bytes(maps[0].keep), 7).tolist() == [True, False, True, False, True, False, True]
    assert linededup.stays(bytes(maps[0].keep), 20).tolist()[7:] == [True] * 13


def test_odd_rows(spark):
    check(spark, odd_rows())
    rows = [(i, SHARED[0], "en", "s", 0) for i in range(6)]
    df = table(prepare(spark), rows).withColumn("n_dropped", F.lit("clash")).withColumn("mark", F.lit("other")).withColumn("keep", F.lit(1))
    got = linededup.dedup_lines(df).collect()
    assert [r.n_dropped for r in sorted(got)] == [1] * 5 + [0] and {(r.mark, r.keep) for r in got} == {("other", 1)}
    assert linededup.dedup_lines(empty(spark)).collect() == []
