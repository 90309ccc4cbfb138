"""Registered queries against their SQL on the smallest data (a sample of each family; check.py runs all)."""

import os

import duckdb
import pytest

import __spark_entry__ as entry
from check import TABLES, norm

FOLDER = "/root/testdata/sf0.001"
SAMPLE = ["A09_export_fields", "B06_resolve_links", "C04_meta_tags", "D09_expand_template", "E03_merge_records", "F17_default_selection",
          "G13_audit", "G14_resolve_refs", "H03_choose_sub_files", "J01_progress_stream"]


def test_every_query_has_sql():
    assert set(entry.registry.QUERIES) == set(entry.registry.ORACLES)
    assert len(entry.registry.QUERIES) > 170


@pytest.mark.skipif(not os.path.isdir(FOLDER), reason="no test data")
@pytest.mark.parametrize("name", SAMPLE)
def test_against_sql(spark, name):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{FOLDER}/{t}.parquet'")
    res = con.execute(entry.oracle_sql()[name])
    names = [c[0] for c in res.description]
    want = sorted(tuple(norm(dict(zip(names, r))[c]) for c in sorted(names)) for r in res.fetchall())
    df = entry.queries()[name](spark, FOLDER)
    cols = sorted(df.columns)
    assert cols == sorted(names)
    assert sorted(tuple(norm(r[c]) for c in cols) for r in df.collect()) == want
