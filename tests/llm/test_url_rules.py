from __future__ import annotations

import random

from codeweft.llm import url_rules

RULES = [("com", "/", "allow"), ("example.com", "/en/", "block"), ("www.example.com", "/en/", "allow"), ("net", "/es/", "block"), ("b.net", "/x", "block"), ("b.net", "/x", "allow"), (None, "/", "block")]


def brute(url):
    low = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    if url is None or "://" not in url:
        return "", "", None, "allow"
    rest = url.split("://", 1)[1]
    at = min([i for i in map(rest.find, "/?#") if i >= 0], default=len(rest))
    host, rest = rest[:at].translate(low), rest[at:]
    path = rest[: min([i for i in map(rest.find, "?#") if i >= 0], default=len(rest))]
    fits = [(len(h + p), len(h), v == "block", h + p, v) for h, p, v in RULES if h and (host == h or host.endswith("." + h)) and path.startswith(p)]
    best = max(fits, default=(0, 0, False, None, "allow"))
    return host, path, best[3], best[4]


def test_equals_brute_force(spark):
    r = random.Random(4)
    hosts = ["Example.com", "www.EXAMPLE.com", "a.www.example.com", "x.net", "net", "b.net", "a.b.net", "example.org", "com", "notexample.com", "İ.com", "a.com:80", "", ".com", "example.com."]
    paths = ["", "/", "/en/", "/en", "/en/1?q=/es/", "/es/#x", "?a=/en/", "#/en/", "/x", "/xy/z", "/EN/", "/en/\u2028a", "/en/a://b"]
    urls = [f"{r.choice(['http', 'https', ''])}://{h}{p}" for h in hosts for p in paths] + [None, "", "nothing", "http:/x.com/", "http://x.com/en/" + "y" * 5000, "http://example.com/en/"]
    rows = [(i, u, "h", "p") for i, u in enumerate(urls)] + [(0, urls[0], "h", "p"), (None, urls[3], "h", "p")]
    rules = spark.createDataFrame(RULES, "host string, path string, verdict string")
    table = spark.createDataFrame(rows, "page_id long, url string, host string, rule string")
    got = url_rules.judge(table, rules)
    assert got.columns[:4] == table.columns
    key = lambda x: tuple("" if v is None else str(v) for v in x)
    assert sorted([(x.page_id, x.url_host, x.url_path, x.url_rule, x.url_verdict) for x in got.collect()], key=key) == sorted([(i, *brute(u)) for i, u, _, _ in rows], key=key)


def test_no_rules_and_no_urls(spark):
    none = spark.createDataFrame([], "host string, path string, verdict string")
    urls = spark.createDataFrame([(1, "http://a.com/x")], "page_id long, url string")
    assert [r.url_verdict for r in url_rules.judge(urls, none, default="block").collect()] == ["block"]
    assert url_rules.judge(urls.limit(0), none).count() == 0


def test_columns_named_like_the_result_are_replaced(spark):
    urls = spark.createDataFrame([("http://a.example.com/en/x", 1, 2)], "url string, url_host int, URL_Verdict int")
    rules = spark.createDataFrame([("example.com", "/en/", "block")], "host string, path string, verdict string")
    got = url_rules.judge(urls, rules)
    assert got.columns == ["url", "url_host", "url_path", "url_rule", "url_verdict"]
    assert tuple(got.first()) == ("http://a.example.com/en/x", "a.example.com", "/en/x", "example.com/en/", "block")
