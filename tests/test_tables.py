"""Derived tables: each name stands for one table."""

import pytest

import __spark_entry__ as entry
from mediaspark import fixtures

PAGES = "page_id bigint, url string, html string"


class Given(fixtures.Tables):
    """Derived tables over rows given by a test."""

    def __init__(self, spark, **raw):
        super().__init__(spark, "")
        self.raw = raw

    def __getitem__(self, name):
        return self.raw[name] if name in self.raw else super().__getitem__(name)


def test_a_name_is_defined_once():
    assert entry.queries()
    with pytest.raises(ValueError):
        fixtures.define("player_pages", "SELECT 1 AS page_id")


def test_player_pages_hold_players(spark):
    from mediaspark.operators import embeds as em
    rows = [(i, f"https://e.example.com/a/{i}", "<p>x</p>") for i in range(4)]
    t = Given(spark, pages=spark.createDataFrame(rows, PAGES))
    items = em.player_items(em.find_players(t["player_pages"]))
    got = em.player_entries(items).select("page_id", "item_no", "id").collect()
    assert sorted(map(tuple, got)) == [(0, 0, "m0"), (0, 1, "second"), (1, 0, "one"), (2, 0, "bare"), (3, 0, "js")]
    assert {(r.page_id, r.url) for r in em.player_tracks(items).collect()} == {(0, "https://e.example.com/en.vtt")}
    assert em.player_formats(items).filter("page_id = 2").first().route == "mpd"
    assert em.find_embeds(t["embed_rule_pages"]).filter("page_id = 1").first().extractor_key == "Vimeo"


def test_release_traffic_beyond_bigint(spark):
    from mediaspark.operators import records as rc
    kind = "tag string, assets array<struct<name:string,size:bigint,download_count:bigint>>"
    big = 2**62
    rows = [(str(i), [("a", big, 3 + i), ("b", None, 1)]) for i in range(3)] + [("x", None)]
    got = rc.release_traffic(spark.createDataFrame(rows, kind)).first()
    assert (int(got.total_bytes), got.total_text) == (big * 12, "48.00EiB")
    assert rc.release_traffic(spark.createDataFrame([("t", [("a", big, 2048)])], kind)).first().total_text == "8.00ZiB"
    orders = lambda n: Given(spark, orders=spark.createDataFrame([(n, n)], "o_orderkey bigint, o_custkey bigint"))
    from mediaspark.registry import records as registered
    few = rc.release_traffic(registered._releases(orders(5))).first()
    assert (int(few.total_bytes), few.total_text) == ((5 * 7919 + 512) * 5 + 2 * 1015, "197.82KiB")


FORMATS = ("media_id bigint, pos bigint, format_id string, url string, ext string, vcodec string, acodec string, tbr double, height int, filesize bigint, "
           "protocol string, preference int")


def test_manifests_are_made_with_one_shuffle(spark):
    from mediaspark.registry import manifests as registered
    rows = [(m, p, f"f{p}", "u", "mp4", None, None, 10.0 + p, 100, 1, "http", None) for m in (1, 2, None) for p in range(450)]
    t = Given(spark, formats=spark.createDataFrame(rows, FORMATS))
    made = registered.xspf_manifest(t)
    assert made._jdf.queryExecution().executedPlan().toString().count("Exchange hashpartitioning") == 1
    got = {r.manifest_id: r.body for r in made.collect()}
    assert set(got) == {f"{m}{k}" for m in ("1-", "2-", "") for k in range(3)} and got["1-2"].count("<track>") == 50
    assert got["2-1"].index(">a0.mp3<") < got["2-1"].index(">a9.mp3<") < got["2-1"].index(">a10.mp3<") < got["2-1"].index(">a199.mp3<")


def test_plain_links_resolve_as_all_links_do(spark):
    from pyspark.sql import functions as F
    from mediaspark.functions import urls as ux
    from mediaspark.functions.core import let, pack
    bases = ["http://h.e/a/b.html", "https://h.e/", "http://h.e", "//h.e/a/b", "http://h.e/a/./b/c", "http://h.e/a/b?q=1", "http://h.e/a#f", "mailto:x", "", None, "http://h.e/a b/c", "HTTP://h.e/a/b"]
    links = ["x.m3u8", "s/x.ts", "../x", "a/../b", "a/.x", "/x", "//c.e/x", "?q", "#f", "x?y=1", "x#f", "x:y", "http://c.e/x", "", None, "~x", "1", "é", "x\n", "a b"]
    d = spark.createDataFrame([(b, l) for b in bases for l in links], "base string, link string")
    plain, all_ = ux.resolve(F.col("base"), F.col("link")), let(pack(base=F.col("base"), link=F.col("link")), ux._resolve)
    assert [r for r in d.select("base", "link", plain.alias("a"), all_.alias("b")).collect() if r.a != r.b] == []


def test_all_rows_are_numbered_without_a_search_for_other_groups(spark):
    from pyspark.sql import functions as F
    from mediaspark import skew
    d = spark.range(1000).select((F.col("id") * 7 % 1000).alias("v"))
    for hot in (10, 300, 1000):
        out = skew.numbered_all(d, [F.col("v")], "n", hot)
        assert out.columns == ["v", "n"] and "LeftAnti" not in out._jdf.queryExecution().executedPlan().toString()
        assert sorted((r.v, r.n) for r in out.collect()) == [(i, i + 1) for i in range(1000)]


def test_manifests_of_one_task_share_a_folder(spark, tmp_path):
    """The commit of a folder of manifests moves one folder a task, not one a manifest; rows of one number are one file."""
    from pathlib import Path
    from mediaspark import session
    rows = [(i, f"S {i}") for i in range(200)] + [(7, "S 7")]
    spark.createDataFrame(rows, "s_suppkey bigint, s_name string").write.parquet(f"{tmp_path}/supplier.parquet")
    got = entry.queries()["A04_read_manifests"](spark, str(tmp_path)).collect()
    one = lambda i: f"#EXTM3U\nS {i}.ts\n"
    assert sorted((r.no, r.body) for r in got) == [(i, one(i) * (2 if i == 7 else 1)) for i in range(200)]
    path = Path(session._made[spark.sparkContext.applicationId][-1].removeprefix("file:"))
    assert 1 < len([d for d in path.iterdir() if d.is_dir()]) <= 8 * spark.sparkContext.defaultParallelism
    assert not list(path.rglob(".part*.crc"))


def test_many_small_manifests_are_read_by_few_tasks(spark, tmp_path):
    from mediaspark.sources import io
    n = io.READ_TASKS * spark.sparkContext.defaultParallelism + 40
    for i in range(n):
        (tmp_path / f"{i}.m3u8").write_text(f"#EXTM3U\n{i}.ts\n")
    before = spark.conf.get("spark.sql.files.openCostInBytes")
    spark.conf.set("spark.sql.files.openCostInBytes", "128m")
    try:
        d = io.read_manifests(spark, str(tmp_path), "https://m.example.com/")
        assert d.rdd.getNumPartitions() < n
        rows = d.collect()
    finally:
        spark.conf.set("spark.sql.files.openCostInBytes", before)
    assert sorted((r.url, r.body) for r in rows) == sorted((f"https://m.example.com/{i}.m3u8", f"#EXTM3U\n{i}.ts\n") for i in range(n))
