import random

from mediaspark.llm.queries import URL_RULES, prepare
from mediaspark.llm.urlfilter import filter_urls


def plain(url, rules, default="allow"):
    if not url or "://" not in url:
        return "", "", None, default
    rest = url.split("://", 1)[1]
    for c in "?#":
        rest = rest.split(c, 1)[0]
    host, slash, path = rest.partition("/")
    host, path = "".join(c.lower() if c.isascii() else c for c in host), slash + path
    best = None
    for rule, verdict in rules:
        h, s, p = rule.partition("/")
        if host and (host == h or host.endswith("." + h)) and path.startswith(s + p):
            key = (h.count("."), len(s + p), verdict == "block")
            best = max(best, (key, rule, verdict)) if best else (key, rule, verdict)
    return host, path, best and best[1], best[2] if best else default


URLS = [None, "", "no scheme", "http://", "http://net", "http://net/", "HTTP://WWW.Example.NET/en/1?x#y", "http://example.net/en", "http://a.example.net/de/",
        "x://example.com/de/?", "x://example.com/de", "http://fr.org/fr/1://2", "http://org/fr/", "http://u@org:80/fr/", "http://annet/x", "http://É.net/é",
        "http://a.b.c.net//en/", "http://?q", "http://h#f", "http://example.net?/en/", "http://x.net/" + "a/" * 5000]


def both_ways(spark, urls, rules):
    df = prepare(spark).createDataFrame(list(enumerate(urls)), "page_id bigint, url string")
    df = df.selectExpr("*", "'old' AS host", "'old' AS verdict", "1 AS rest")
    r = spark.createDataFrame(rules, "rule string, verdict string")
    for limit in (1000, 0):
        yield {x.page_id: (x.host, x.path, x.rule, x.verdict) for x in filter_urls(df, r, max_broadcast=limit).collect()}


def test_odd_urls(spark):
    for got in both_ways(spark, URLS + URLS[:3], URL_RULES):
        assert got == {i: plain(u, URL_RULES) for i, u in enumerate(URLS + URLS[:3])}


def test_random_rules(spark):
    rng = random.Random(1)
    labels, parts = ["a", "b", "com", "x"], ["p", "q", "pq", ""]
    rules = {}
    for _ in range(60):
        rule = ".".join(rng.choices(labels, k=rng.randrange(1, 4))) + rng.choice(["", "/", "/p", "/p/", "/p/q", "/pq/p/"])
        rules[rule] = rng.choice(["allow", "block"])
    urls = [f"http://{'.'.join(rng.choices(labels, k=rng.randrange(1, 5)))}/{'/'.join(rng.choices(parts, k=rng.randrange(0, 4)))}" for _ in range(400)]
    for got in both_ways(spark, urls, list(rules.items())):
        assert got == {i: plain(u, rules.items()) for i, u in enumerate(urls)}


def test_empty_tables(spark):
    df = prepare(spark).createDataFrame([], "page_id bigint, url string")
    rules = spark.createDataFrame([], "rule string, verdict string")
    assert filter_urls(df, rules).collect() == []
    one = spark.createDataFrame([(1, "http://a.net/")], "page_id bigint, url string")
    assert [(r.rule, r.verdict) for r in filter_urls(one, rules, default="block").collect()] == [(None, "block")]
    nulls = spark.createDataFrame([(None, "block"), ("net/", None), ("net/", "block"), ("net/", "allow")], "rule string, verdict string")
    assert [(r.rule, r.verdict) for r in filter_urls(one, nulls).collect()] == [("net/", "block")]
