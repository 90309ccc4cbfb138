import zlib

import corpus_pipeline
import numpy as np
from corpus_cases import components, empty, mix, odd_rows, table
from test_decontam import plain_pairs
from test_rules import measure

from mediaspark.llm import tokens
from mediaspark.llm.queries import QUERIES, ORACLES, prepare

D = "/root/testdata/sf0.001"


def rejected(t):
    m = measure(t)
    letters = [c for c in t if c.isalpha()]
    return (m["n_words"] < 50 or 100 * m["n_repeat_words"] > 50 * m["n_words"] or 100 * m["n_symbols"] > 25 * m["n_words"]
            or 100 * m["n_dup_lines"] > 50 * m["n_lines"] or 100 * sum(c.isupper() for c in t) > 50 * len(letters))


def test_against_plain_stages(spark):
    docs = [(r.doc_id, r.source, r.text) for r in spark.read.parquet(f"{D}/documents.parquet").collect()]
    bench = [(r.item_id, r.text) for r in spark.read.parquet(f"{D}/benchmark.parquet").collect()]
    docs = [d for d in docs if not rejected(d[2])]
    least = {i: c for i, _, c in components([(d[0], d[2]) for d in docs], 5, 80)}
    docs = [d for d in docs if least[d[0]] == d[0]]
    bad = {d for d, _ in plain_pairs([(d[0], d[2]) for d in docs], bench)}
    docs = [d for d in docs if d[0] not in bad]
    taken, _, _ = mix(docs)
    rows = sorted((i, t) for i, s, t in docs for k, n in taken.items() if k[0] == i for _ in range(n // k[2]))
    start, want = 0, []
    for i, t in rows:
        ids = np.array(tokens.encoder(tokens.vocabulary_path()).tokenizer.encode(t, add_special_tokens=False).ids + [2], "<u4")
        want.append((i, start, len(ids), zlib.crc32(ids.tobytes())))
        start += len(ids)
    got = sorted(tuple(r) for r in corpus_pipeline.run(spark, D).select("doc_id", "start", "n_tokens", "ids_crc32").collect())
    assert got == want and bad and len(docs) > 50


def test_stages_take_odd_rows(spark):
    prepare(spark)
    for rows in (table(spark, odd_rows()), empty(spark)):
        for name, stage in corpus_pipeline.STAGES:
            out = stage(spark, rows, D)
            if name != "token_files":
                assert out.columns == rows.columns
            out.collect()


def test_names():
    assert [n.split("_")[0] for n in sorted(QUERIES, key=lambda n: int(n[2:].split("_")[0]))] == [f"op{i}" for i in range(1, 11)]
    assert set(ORACLES) <= set(QUERIES)
