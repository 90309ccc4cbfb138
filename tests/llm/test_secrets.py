import hashlib
import math
import random
import re
import time
import string

from corpus_cases import empty, odd_rows, table
from pyspark.sql import functions as F

from mediaspark.llm import secrets
from mediaspark.llm.queries import QUERIES, prepare


def base(text):
    out = []
    for k, (p, need, g) in enumerate([(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 6, 2),
                                      (r"AKIA[A-Z0-9]+", 20, 0), (r"[0-9a-f]+", 24, 0)]):
        flags = re.I | re.A if k == 0 else 0
        out += [(m.start(), k, m.end()) for m in re.finditer(p, text, flags) if len(m[g]) >= need]
    return ",".join(f"{['assign', 'access', 'hex'][k]}:{a}:{z}" for a, k, z in sorted(out))


def entropy(text):
    """Every window counted anew."""
    out = []
    for m in re.finditer(r"[A-Za-z0-9+/_=-]{20,}", text):
        run = m[0]
        if any(a(run) if callable(a) else re.fullmatch(a, run) for a in secrets.ALLOW):
            continue
        hits = []
        for i in range(len(run) - 19):
            w = run[i:i + 20]
            bits = -sum(w.count(c) / 20 * math.log2(w.count(c) / 20) for c in set(w))
            digits, low, up = (sum(f(c) for c in w) for f in (str.isdigit, str.islower, str.isupper))
            af = sum(c in "abcdef" for c in w)
            if digits + af == 20:
                hit = digits >= 3 and af >= 3 and bits >= secrets.HEX_BITS - 1e-12
            else:
                hit = digits >= 2 and low >= 2 and up >= 2 and bits >= secrets.MIXED_BITS - 1e-12
            if hit:
                hits.append(i)
        if hits:
            out.append((m.start() + hits[0], m.start() + hits[-1] + 20))
    return out


def texts(seed=1):
    rng = random.Random(seed)
    pick = lambda s, n: "".join(rng.choices(s, k=n))
    full = string.ascii_letters + string.digits + "+/"
    out = []
    for _ in range(300):
        parts = [pick("thanes ", 30), "é😀 ", f"Token = \"{pick(full, rng.randrange(3, 40))}\"", " AKIA" + pick("ABC0123", rng.randrange(10, 20)) + " ",
                 pick("0123456789abcdef", rng.randrange(18, 50)), " api_key:" + pick("ab.", 7), " ſecret=abcdefgh ", "pass" + "word: 'x' ", pick(full, rng.randrange(15, 80)),
                 " a/path/of/some-words/in_here ", "A" * 40, " 12345678901234567890123 "]
        rng.shuffle(parts)
        out.append("".join(parts[:rng.randrange(12)]))
    return out


def test_against_plain_scan(spark):
    all_ = texts()
    got = {r.doc_id: r for r in secrets.scan_secrets(table(prepare(spark), all_)).collect()}
    found = 0
    for i, t in enumerate(all_):
        assert got[i].base_spans == base(t)
        assert got[i].base_sha256 == hashlib.sha256(base(t).encode()).hexdigest()
        own = [(s.start, s.end) for s in got[i].secrets if s.kind == "entropy"]
        assert own == entropy(t)
        found += len(own)
        rest = [s for s in got[i].secrets if s.kind != "entropy"]
        assert ",".join(f"{s.kind}:{s.start}:{s.end}" for s in rest) == base(t)
    assert found > 100


def test_allow_list_never_hides_a_base_span(spark):
    got = secrets.scan_secrets(table(prepare(spark), ["token=example1234567890abcdefABCDEF99"])).first()
    assert [s.kind for s in got.secrets] == ["assign"]


def test_clean_text_has_no_spans(spark):
    clean = ["Antidisestablishmentarianism and internationalization-of-things at https://example.org/some/long-path/2024/article_name.html",
             "550e8400-e29b is short; version 1.2.3; 2024-01-01T00:00:00; ISBN 9780306406157", "x" * 100_000, "the_function_name_in_snake_case_is_long"]
    assert [r.all_spans for r in secrets.scan_secrets(table(prepare(spark), clean)).collect()] == [""] * 4


def test_odd_rows(spark):
    rows = odd_rows()
    df = table(prepare(spark), rows).withColumn("secrets", F.lit(1)).withColumn("base_spans", F.lit(1))
    got = secrets.scan_secrets(df).collect()
    assert len(got) == len(rows) and {r.all_spans for r in got} == {""}
    assert secrets.scan_secrets(empty(spark)).collect() == []
    assert secrets.scan_secrets(df, keep=["doc_id"]).columns == ["doc_id", "secrets", "base_spans", "all_spans", "base_sha256"]


def test_query(spark):
    d = "/root/testdata/sf0.001"
    rows = {r.doc_id: r.text for r in spark.read.parquet(f"{d}/documents.parquet").collect()}
    for r in QUERIES["op7_scan_secrets"](spark, d).collect():
        b = base(rows[r.doc_id])
        assert r.base_sha256 == hashlib.sha256(b.encode()).hexdigest()
        assert (r.n_assign, r.n_access, r.n_hex) == tuple(b.count(k) for k in ("assign:", "access:", "hex:"))


def test_secrets_of_every_alphabet(spark):
    lower, upper = string.ascii_lowercase, string.ascii_uppercase
    rng = random.Random(7)
    planted = ["sk_live_4f9d8s7g6h5j4k3l2z1x", "4f9d8s7g6h5j4k3l2z1x-prod", "550e8400-e29b-41d4-a716-446655440000", "550E8400-E29B-41D4-A716-446655440000",
               "wJalrXUtnFEMIsK7MDENGabPxRfiCYqTzLwQk", "example-9tQ3vX7mKp2LzR8wBn4YcD6s"]
    for alphabet in (upper + "234567", lower + string.digits, string.digits + "ABCDEF", lower + upper):
        planted += ["".join(rng.choices(alphabet, k=48)) for _ in range(20)]
    words = ["AbstractSingletonProxyFactoryBean", "getElementsByTagNameAndClassName", "MAX_BUFFER_SIZE_2048_BYTES", "article-2024-01-15-part-2-name", "token-example1234567890abcdefABCDEF99",
             "Donaudampfschifffahrtsgesellschaft", "your_api_key_goes_here_12345", "YOUR-SECRET-TOKEN-HERE", "12345678901234567890123", upper + lower + string.digits]
    got = secrets.scan_secrets(table(prepare(spark), [f"see {w} there" for w in planted + words]), narrow=True).collect()
    found = {r.doc_id for r in got if any(s.kind == "entropy" for s in r.secrets)}
    assert found == set(range(len(planted)))


def test_query_looks_at_every_alphabet(spark, tmp_path):
    table(prepare(spark), ["key sk_live_4f9d8s7g6h5j4k3l2z1x", "no key"]).write.parquet(f"{tmp_path}/documents.parquet")
    assert {r.doc_id: r.spans for r in QUERIES["op7_scan_secrets"](spark, str(tmp_path)).collect()} == {0: "entropy:4:32", 1: ""}


def test_near_repeats_take_linear_time():
    """Runs of 10,000 characters that are almost a series or a placeholder, of every series and part, each in well under a second."""
    scanner = secrets.Scanner(narrow=True)
    for u in [*secrets.SERIES, *secrets.PARTS, "your", "ab-", "your-key-", "x0", "0x1", "1234567890abcdef"]:
        body = u * (10_000 // len(u))
        for run in (body, body + "Q", body + "1Z9", "your" + body + "Q", "your-" + body, "a-" * 20 + body + "!"):
            start = time.time()
            scanner.entropy(run)
            assert time.time() - start < 0.5, run[:30]


def test_series_and_placeholders_are_what_their_grammars_say():
    series = r"(?:" + "|".join(secrets.SERIES) + ")"
    as_series = re.compile(rf"(?i)(?:{series}[-_=+/]*)+")
    as_placeholder = re.compile(rf"(?i)(?:[a-z]{{1,12}}[-_=])*(?:{'|'.join(secrets.PLACEHOLDERS)})(?:[-_]?(?:{'|'.join(secrets.PARTS)}|{series}|[0-9]{{1,4}}(?![0-9])))*[-_=]*")
    rng = random.Random(6)
    pieces = [*secrets.SERIES, *secrets.PARTS, *secrets.PLACEHOLDERS, *"-_=+/", "1", "22", "7777", "12345", "Q", "foo", "Your", "KEY", "XX"]
    seen = [0, 0]
    for _ in range(20_000):
        run = "".join(rng.choice(pieces) for _ in range(rng.randrange(1, 6)))[:30]
        if rng.random() < 0.4:
            run = rng.choice(secrets.PLACEHOLDERS) + run
        want = bool(as_series.fullmatch(run)), bool(as_placeholder.fullmatch(run))
        assert (secrets.is_series(run), secrets.is_placeholder(run)) == want, run
        seen = [seen[0] + want[0], seen[1] + want[1]]
    assert min(seen) > 500
