import pytest
from tasklode.llm import url_filter

RULES = url_filter.parse_rules(("allow org/", "block example.org/es/", "block example.org/en/1", "allow com/fr/", "block com/de/"))
URLS = [
    None, "", "example.org/es/x", "https://example.org", "https://example.org/", "http://A.Example.ORG/es/1?x=/de/", "http://notexample.org/es/1",
    "http://example.org/en/10/a", "http://example.org/en/2", "http://example.org/en/1", "http://x.com/fr/", "http://x.com/fr", "http://com/de/#a",
    "http://ÄB.com/de/", "://org/x", "http://a?b://c/d", "http://x.com//de/", "http://org./x", "http://x.net/de/",
]


def brute(url, default="allow"):
    host, path = url_filter.split_url(url)
    fits = [(len(h), len(p), h + p, v) for v, h, p in RULES if (host == h or host.endswith("." + h)) and path.startswith(p)]
    return (host, path, max(fits)[2], max(fits)[3]) if fits else (host, path, None, default)


@pytest.mark.parametrize("most", [100, 0])
def test_against_brute_force(spark, most):
    df = spark.createDataFrame([*enumerate(URLS), (None, URLS[5]), (3, URLS[3])], "page_id long, url string").selectExpr("*", "'z' AS host", "1 AS rule")
    out = url_filter.judge(df, RULES, most_broadcast=most).collect()
    want = [(i, *brute(u)) for i, u in [*enumerate(URLS), (None, URLS[5]), (3, URLS[3])]]
    key = lambda r: tuple(map(str, r))
    assert sorted(map(tuple, out), key=key) == sorted(want, key=key)


def test_longer_host_then_longer_path():
    trie = url_filter.Trie(url_filter.parse_rules(("allow com/", "block a.com/x", "allow a.com/xy/", "block a.com/xy/z", "allow a.com/x")))
    assert trie.match("b.com", "/x") == ("allow", "com/")
    assert trie.match("b.a.com", "/xz") == ("block", "a.com/x")
    assert trie.match("a.com", "/xy/q") == ("allow", "a.com/xy/")
    assert trie.match("a.com", "/xy/zz") == ("block", "a.com/xy/z")
    assert trie.match("net", "/") is None


def test_split_and_empty(spark):
    assert url_filter.split_url("HTTP://Host.COM:80/P?q#f") == ("host.com:80", "/P")
    assert url_filter.split_url("x://h#/a") == ("h", "")
    assert url_filter.judge(spark.createDataFrame([], "page_id long, url string"), RULES).count() == 0
    with pytest.raises(ValueError, match="no rule"):
        url_filter.parse_rules(["deny org/"])
