"""Small documents with every odd case, and plain versions of the rules to compare with."""

import random
import re

WORD = re.compile(r"[^\x20\x09-\x0D]+")
SCHEMA = "doc_id bigint, text string, lang string, source string, n_chars bigint"


def table(spark, texts, start=0):
    rows = [(start + i, t, "en", f"src{i % 4}", len(t)) if isinstance(t, str) else t for i, t in enumerate(texts)]
    return spark.createDataFrame(rows, SCHEMA)


def odd_rows():
    """Null ids, texts, sources and languages, empty and blank texts, repeated rows, one very long text."""
    long = " ".join(f"w{i % 997}x{i // 997}" for i in range(60_000))
    return [(900, None, "en", "s1", 0), (901, "", None, "s1", 0), (902, " \t\n\x0b\x0c\r", "en", None, 6), (None, "one two three four", "en", "s2", 18),
            (None, None, None, None, None), (903, "one", "de", "s2", 3), (903, "one", "de", "s2", 3), (904, long, "fr", "s3", len(long)),
            (905, "one two three four", "en", "s2", 18), (906, "One two THREE four", "en", "s2", 18), (907, "é\u00a0è\u2003x \u0085y", "fr", "s3", 8)]


def empty(spark):
    return spark.createDataFrame([], SCHEMA)


def prose(rng, n, words=400):
    return [f"{rng.choice('abcdefgh')}{rng.randrange(words)}" for _ in range(n)]


def near_copies(seed=5):
    """Bases with copies that differ in a few words, chains of small edits, exact copies, and other texts that share passages."""
    rng = random.Random(seed)
    out = []
    passage = prose(rng, 60)
    for _ in range(12):
        base = prose(rng, rng.randrange(20, 300))
        out.append(" ".join(base))
        for _ in range(rng.randrange(0, 6)):
            edit = list(base)
            for _ in range(rng.randrange(0, 1 + len(base) // 40)):
                edit[rng.randrange(len(edit))] = "edit" + str(rng.randrange(10_000))
            out.append(" ".join(edit).upper() if rng.random() < 0.2 else " ".join(edit))
    chain = prose(rng, 200)
    for i in range(12):
        chain = chain[4:] + prose(rng, 4)
        out.append(" ".join(chain))
    for _ in range(8):
        out.append(" ".join(prose(rng, 100) + passage))
    out += ["a b c"] * 3 + ["a b", "A B", "a"]
    rng.shuffle(out)
    return out


def shingles(text, width):
    low = (text or "").translate({c: c + 32 for c in range(65, 91)})
    w = WORD.findall(low)
    if len(w) < width:
        return {tuple(w)} if w else set()
    return {tuple(w[i:i + width]) for i in range(len(w) - width + 1)}


def components(rows, width, percent):
    """{id: (size, smallest id reachable)} by all pairs."""
    sets = [(i, shingles(t, width)) for i, t in rows if i is not None]
    root = {i: i for i, _ in sets}

    def find(a):
        while root[a] != a:
            a = root[a]
        return a
    for x in range(len(sets)):
        for y in range(x):
            (i, a), (j, b) = sets[x], sets[y]
            if a and b and 100 * len(a & b) >= percent * len(a | b):
                i, j = find(i), find(j)
                root[max(i, j)] = min(i, j)
    return {(i, len(s), find(i)) for i, s in sets}


def mix(rows, weights=(3, 1, 2), share=1.5, repeats=2):
    """{(id, size): taken} and {source: target} by hand; rows are (id, source, text)."""
    import hashlib
    sized = [(i, s, len(WORD.findall(t or ""))) for i, s, t in rows]
    sources = sorted({s for _, s, _ in sized}, key=lambda s: (s is None, (s or "").encode()))
    total = {s: sum(n for _, t, n in sized if t == s) for s in sources}
    weight = {s: weights[k % len(weights)] for k, s in enumerate(sources)}
    budget, goal, free = share * sum(total.values()), {}, set(sources)
    while free:
        rest, w = budget - sum(goal.values()), sum(weight[s] for s in free)
        over = {s for s in free if rest * weight[s] / w >= repeats * total[s]}
        goal |= {s: repeats * total[s] for s in over} if over else {s: rest * weight[s] / w for s in free}
        free = free - over if over else set()
    copies = []
    for s in sources:
        upto = 0
        own = sorted(((hashlib.md5(("" if i is None else str(i)).encode()).hexdigest(), -1 if i is None else i, n, i) for i, t, n in sized if t == s))
        for lap in range(repeats):
            for h, _, n, i in own:
                upto += n
                if goal[s] > 0:
                    copies.append((upto / goal[s], n, s, i))
    copies.sort(key=lambda c: c[0])
    taken, spent, k = {}, 0, 0
    while k < len(copies):
        z = k
        while z < len(copies) and copies[z][0] == copies[k][0]:
            z += 1
        if spent + sum(c[1] for c in copies[k:z]) > budget:
            break
        for _, n, s, i in copies[k:z]:
            spent += n
            taken[i, s, n] = taken.get((i, s, n), 0) + n
        k = z
    return taken, goal, total
