import random
import re

from mediaspark.functions.patterns import java_pattern, required
from mediaspark.operators import routing

SCHEMA = "ord int, extractor_key string, url_regex string, host_token string"


def first_match(catalog, url):
    return next(((o, k, ((m.groupdict()["id"] or "") if "(?P<id>" in p else None)) for o, k, p, _ in sorted(catalog) if url is not None and (m := re.match(p, url))), (None, None, None))


def check(spark, catalog, urls, prefilter=False):
    cat = spark.createDataFrame(catalog, SCHEMA)
    got = routing.route(spark.createDataFrame(list(enumerate(urls)), "n int, url string"), cat, prefilter=prefilter).collect()
    assert sorted((r.n, r.ord, r.extractor_key, r.media_id) for r in got) == [(n, *first_match(catalog, u)) for n, u in enumerate(urls)]


def test_first_match_of_overlapping_patterns(spark):
    catalog = [(o, f"k{o}", rf"https?://{h}\.example\.com/(?P<id>\d+)" if o % 2 else rf"https?://{h}\.example\.com/", "example.com" if o % 3 else None)
               for o, h in enumerate("abacdbe")]
    urls = [f"http://{h}.example.com/{i}" for i, h in enumerate("abcdez")] + [None, "", "http://a.example.com/1", "http://a.example.com/1"]
    for pre in (False, True):
        check(spark, catalog, urls, pre)


def test_patterns_of_every_kind(spark):
    patterns = [
        r"https?://(?:www\.)?(?:one|two|three)\.(?:com|net)/v/(?P<id>[a-z]{2})", r"(?i)https?://UPPER\.Example\.org/(?P<id>\w+)",
        "(?x)https?://   # a comment\n (?:deep\\.)*verbose\\.example/ (?P<id>\\d+) # the end", r"(?:https?:)?//(?:[^/]+\.)?cdn(?P<n>\d)\.test/(?P=n)/(?P<id>.+)",
        r"https?://x\.y/(?P<id>\d+)", r"https?://[^/]+/(?:watch|embed)/(?P<id>\d+)(?:$|[?#])", r"(?:short:(?P<id>\d{,3})|longer-prefix:)", r"https?://(?=strange)[a-z]+\.io/",
        r"https?://(?:a|[b-d])\.opt(?:ional)?\.example/x*(?:end)?$", r"(?:rtmp|mms)s?://", r"https?://(?:(?:eins|zwei)\.de/(?:e/)?|drei\.at/)(?P<id>\d+)", r"[a-z]+:(?P<id>\w*)", r".*"]
    catalog = [(i, f"k{i}", p, None) for i, p in enumerate(patterns)]
    urls = ["http://www.two.net/v/ab", "https://three.com/v/xy", "http://one.org/v/ab", "HTTP://upper.example.ORG/zZ", "https://upper.example.org/q", "http://deep.deep.verbose.example/77",
            "https://verbose.example/5", "//a.cdn4.test/4/name", "//cdn4.test/5/name", "http://x.y/1", "http://h.example/embed/12?x", "http://h.example/embed/12/", "short:123",
            "short:", "longer-prefix:1", "https://strange.io/", "http://other.io/", "http://c.opt.example/xxend", "http://a.optional.example/", "mms://h", "rtmps://h/1",
            "http://zwei.de/e/4", "http://drei.at/9", "http://drei.at/x", "x", "", "  http://x.y/1", "ftp:file", "http://www.two.net/v/äb", None]
    check(spark, catalog, urls)
    rng = random.Random(2)
    rng.shuffle(catalog)
    check(spark, [(i, k, p, h) for i, (_, k, p, h) in enumerate(catalog)], urls)


def test_required_literals():
    assert required(r"https?://(?:www\.)?(?:foo|barbaz)\.com/v", 5) == [["barbaz.com/v", "foo.com/v"]]
    assert required(r"https?://(?:www\.)?(?:(?:foo|barbaz)\.com/v|other\.[a-z]+)/", 5) == [["barbaz.com/v", "foo.com/v", "other."]]
    assert required(r"(?:abcdef)?x{3}(?:ghijkl)+", 5) == [["ghijkl"]]
    assert required(r".*|abcdef", 5) == [] and required("[Aa]bcd", 5) == []
    assert java_pattern(r"(?P<a>x)(?P<id>y)(?P=a){,3}") == (r"(x)(y)\1{0,3}", 2)


def test_100_000_patterns_in_one_pass(spark):
    n = 100_000
    cat = spark.range(n).selectExpr("CAST(id AS INT) AS ord", "concat('k', id) AS extractor_key",
                                    r"concat('https?://(?:www\\.)?h', id, '\\.example\\.com/(?P<id>\\d+)') AS url_regex", "CAST(NULL AS STRING) AS host_token")
    urls = spark.range(4000).selectExpr(f"concat('http://h', (id * 7919) % {2 * n}, '.example.com/', id) AS url")
    out = routing.route(urls, cat)
    plan = out._jdf.queryExecution().toString()
    assert len(plan) < 60_000 and "h4711" not in plan
    rows = out.collect()
    assert len(rows) == 4000
    for r in rows:
        h, i = map(int, re.findall(r"\d+", r.url))
        assert (r.ord, r.extractor_key, r.media_id) == ((h, f"k{h}", str(i)) if h < n else (None, None, None))


def test_patterns_of_one_host_stand_apart(spark):
    """A host that all patterns name does not make every URL of it meet every pattern, and numbers of any length keep the patterns apart."""
    n = 30_000
    cat = spark.range(n).selectExpr("CAST(id AS INT) AS ord", "concat('k', id) AS extractor_key",
                                    "concat('https?://(?:www[.])?shop', 1000000 + id, '[.]example[.]net/(?:watch|v)/(?P<id>[0-9]+)') AS url_regex", "'example.net' AS host_token")
    rules = routing.analysed(cat).withColumnRenamed("host_token", "host")
    listed = routing.index(rules).groupBy("piece").count()
    assert listed.filter("piece IS NULL").count() == 0 and listed.agg({"count": "max"}).first()[0] <= 2


def test_pieces_of_a_literal_are_in_every_text_that_holds_it():
    from mediaspark.functions.patterns import piece_keys
    rng = random.Random(5)
    word = lambda k: "".join(rng.choice("ab1./-é") for _ in range(rng.randrange(k)))
    for _ in range(200):
        literals = [w.encode() for w in (word(20).replace("é", "e") for _ in range(5)) if len(w) >= 5]
        texts = [word(9).encode() + x + word(9).encode() for x in literals]
        if literals:
            (a, k), (b, m) = piece_keys(literals, 5, literal=True), piece_keys(texts, 5)
            assert set(a) == set(range(len(literals))) and set(zip(a, k)) <= set(zip(b, m))


def test_host_patterns_without_a_literal(spark):
    catalog = [(0, "a", r"https?://[a-z.]+/(?P<id>\d+)", "one.net"), (1, "b", r"https?://\w+\.one\.net/", "one.net"), (2, "c", ".*", None), (3, "d", "x", "")]
    urls = ["http://a.one.net/5", "http://a.one.net/x", "http://a.two.net/5", "x", None]
    cat = spark.createDataFrame(catalog, SCHEMA)
    got = routing.route(spark.createDataFrame(list(enumerate(urls)), "n int, url string"), cat, prefilter=True).collect()
    assert sorted((r.n, r.ord, r.media_id) for r in got) == [(0, 0, "5"), (1, 1, None), (2, 2, None), (3, 2, None), (4, None, None)]


def test_urls_meet_a_catch_all_once(spark):
    """A few patterns without a literal are sent to the URLs; these are not read again for each part of an index beyond the size of a broadcast."""
    n = 20_000
    cat = spark.range(0, n, 1, 8).selectExpr("CAST(id AS INT) AS ord", "concat('k', id) AS extractor_key", "concat('https?://h', id, '[.]example[.]com/') AS url_regex", "CAST(NULL AS STRING) AS host_token")
    cat = cat.unionByName(spark.createDataFrame([(n, "Generic", ".*", None)], SCHEMA))
    urls = spark.range(20_000).selectExpr("concat('http://h', id * 2, '.example.com/', id) AS url")
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "64k")
    try:
        out = routing.route(urls, cat)
        rows = out.collect()
        plan = out._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
    assert "CartesianProduct" not in plan and "BroadcastNestedLoopJoin" in plan
    assert len(rows) == 20_000
    for r in rows:
        h = int(re.findall(r"\d+", r.url)[0])
        assert (r.ord, r.extractor_key) == ((h, f"k{h}") if h < n else (n, "Generic"))
