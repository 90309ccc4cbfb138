import random
import zlib

import numpy as np
import pytest
from corpus_cases import empty, odd_rows, prose, table
from pyspark.sql import functions as F

from mediaspark.llm import lengths, tokens
from mediaspark.llm.queries import prepare, starts_from_files
from mediaspark.session import scratch_path

PATH = tokens.vocabulary_path()
HARD = ["it's I'LL 'tis don't.", "Straße ſ ª º", "été x\u0085y z w", "<|endoftext|>a <|startoftext|> b", "日本語 テスト 123 ١٢", "ΟΔΟΣ ΣΑΣ.", "\x1c a\x1fb \x00",
        "ŉ Ǆ ĳ ÿ Ÿ İ", "á ́b", "....,, ;;'s 's! x's!?", "Å K", "😀😀 ok👍🏽", "ab" * 5000, "don’t", "x‍cd ﻿x", "| a || <b> {c}", "A.B.C, U.S.A.!"]


def whole(text):
    ids = tokens.encoder(PATH).tokenizer.encode(text or "", add_special_tokens=False).ids
    return np.array(ids, "<u4").tobytes()


def test_words_equal_whole_texts():
    e = tokens.encoder(PATH)
    assert e.by_word
    rng = random.Random(1)
    letters = "abcXYZéßÀñ.,!?'\"#|-_0129 \t\n ́日"
    texts = HARD + [" ".join(prose(rng, 50)) for _ in range(20)] + ["".join(rng.choices(letters, k=80)) for _ in range(1500)]
    for t in texts:
        assert e.ids(t) == whole(t), t[:80]


@pytest.mark.parametrize("name", ["byte_bpe_50k.json"])
def test_other_tokenizers_get_whole_texts(name):
    e = tokens.Encoder(tokens.vocabulary_path(name))
    assert not e.by_word
    assert np.frombuffer(e.ids("a  b\nc"), "<u4").tolist() == e.tokenizer.encode("a  b\nc", add_special_tokens=False).ids


def test_files_round_trip(spark):
    rng = random.Random(2)
    rows = [(i, " ".join(prose(rng, rng.randrange(0, 60))), "en", "s", 0) for i in rng.sample(range(10_000), 300)] + odd_rows()
    folder = tokens.write_tokens(table(prepare(spark), rows), scratch_path(spark, "test-tokens"), PATH)
    got = sorted((tuple(r) for r in starts_from_files(spark, folder).select("doc_id", "start", "n_tokens", "ids_crc32").collect()), key=lambda r: r[1])
    blobs = [(i, whole(t) + np.array([2], "<u4").tobytes()) for i, t, *_ in rows]
    blobs.sort(key=lambda b: (b[0] is not None, b[0] or 0, len(b[1]), zlib.crc32(b[1])))
    start, want = 0, []
    for i, b in blobs:
        want.append((i, start, len(b) // 4, zlib.crc32(b)))
        start += len(b) // 4
    assert got == want


def test_files_prune(spark):
    folder = tokens.write_tokens(table(prepare(spark), ["a b", "c"] * 500), scratch_path(spark, "test-tokens"), PATH)
    one = tokens.read_tokens(spark, folder, F.col("doc_id") == 501)
    assert [r.ids for r in one.collect()] == [[*np.frombuffer(whole("c"), "<u4").tolist(), 2]]
    assert "EqualTo(doc_id,501)" in one._jdf.queryExecution().toString()
    low = [r[0] for r in spark.read.orc(folder).groupBy(F.input_file_name()).agg(F.min("doc_id"), F.max("doc_id")).select("min(doc_id)").collect()]
    assert len(low) == len(set(low))


def test_empty_table_of_files(spark):
    folder = tokens.write_tokens(empty(prepare(spark)), scratch_path(spark, "test-tokens"), PATH)
    assert starts_from_files(spark, folder).collect() == []


def test_lengths_by_hand(spark):
    rng = random.Random(3)
    rows = [(i, " ".join(prose(rng, rng.choice([0, 1, 7, 40, 3000]))), "en", "s", 0) for i in range(120)] + odd_rows()
    n = [len(whole(t)) // 4 for _, t, *_ in rows]
    df = table(prepare(spark), rows).withColumn("n_tokens", F.lit("clash"))
    for block in (1, 64, 1024):
        sums = lengths.suffix_sums(lengths.histogram(df, PATH), block)
        got = sums.collect()
        assert {r["length"] for r in got} == set(n)
        for r in got:
            x = r["length"]
            assert (r.n_docs, r.n_tokens) == (n.count(x), x * n.count(x))
            assert (r.docs_from, r.tokens_from) == (sum(v >= x for v in n), sum(v for v in n if v >= x))
            assert (r.docs_to, r.truncated) == (sum(v <= x for v in n), sum(min(v, x) for v in n))
            assert (r.docs_all, r.tokens_all) == (len(n), sum(n))
    limits = [0, 1, 50, 4096, 10**9]
    assert {r.context: r.tokens for r in lengths.truncated_totals(sums, limits).collect()} == {x: sum(min(v, x) for v in n) for x in limits}
    for r in lengths.quantiles(sums, [0.1, 0.5, 1.0]).collect():
        assert r["length"] == min(v for v in n if sum(w <= v for w in n) >= r.p * len(n))


def test_lengths_of_nothing(spark):
    sums = lengths.suffix_sums(lengths.histogram(empty(prepare(spark)), PATH))
    assert sums.collect() == []
    assert {(r.context, r.tokens) for r in lengths.truncated_totals(sums, [5, 10]).collect()} == {(5, 0), (10, 0)}
