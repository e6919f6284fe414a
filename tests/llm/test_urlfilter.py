import re

import pytest

from claimloom.llm import urlfilter

URLS = [
    "http://www.Example.ORG/es/1?x#y", "https://example.org/en/12", "https://example.org/en/2", "http://badexample.org/es/1", "http://a.com/fr/x", "http://com/fr/x", "http://xcom/de/", "http://a.com/de/",
    "http://a.com/de", "http://a.net/ads/x", "http://cheap-pills.net/", "http://cheap-pills.org/", "http://a.net/loginpage", "http://a.net/login", "http://a.net/cart/7/checkout?a", "no scheme", "", None, "http://", "http://org", "http://org/", "ftp://x.ÉXAMPLE.org:80/%", "x://http://a.com/fr/",
    "http://doubleclick.net/", "http://xdoubleclick.net/", "http://a.net/wp-login.php?x", "http://a.net/?PHPSESSID=3", "http://a.net?phpsessid=3", "http://torrent", "http://" + "a" * 9000 + ".org/es/",
]


def _plain(url):
    if url is None or "://" not in url:
        return "", "", None, None, "allow"
    after = url[url.index("://") + 3 :]
    host = re.match(r"[^/?#]*", after)[0]
    path = re.match(r"[^?#]*", after[len(host) :])[0]
    rest = after[len(host) + len(path) :]
    host = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in host)
    rules = [("allow", "org", "/"), ("block", "example.org", "/es/"), ("block", "example.org", "/en/1"), ("allow", "com", "/fr/"), ("block", "com", "/de/")]
    fits = [r for r in rules if (host == r[1] or host.endswith("." + r[1])) and path.startswith(r[2])]
    if fits:
        verdict, h, p = max(fits, key=lambda r: len(r[1] + r[2]))
        return host, path, h + p, None, verdict
    names = [r.name for r in urlfilter.RULES if r.tier == 0 and re.search(r.regex, host + path + rest)]
    if names:
        return host, path, None, max(names, key=lambda n: (len(n), n)), "block"
    return host, path, None, None, "allow"


@pytest.mark.parametrize("at_once", [20_000, 4])
def test_equals_running_every_rule(spark, monkeypatch, at_once):
    monkeypatch.setattr(urlfilter, "RULES_AT_ONCE", at_once)
    frame = spark.createDataFrame([(i, u, "c") for i, u in enumerate(URLS)], "page_id long, url string, host string")
    found = urlfilter.judge(frame)
    assert found.columns == ["page_id", "url", "host", "path", "rule", "pattern", "verdict"]
    for r in found.collect():
        assert (r.host, r.path, r.rule, r.pattern, r.verdict) == _plain(r.url), r.url
    assert urlfilter.judge(frame.limit(0)).count() == 0


def test_tokens_of_rules_are_whole():
    assert urlfilter.wildcard_rule("block", "ab*cd^ef.gh").tokens == ("ef",)
    assert urlfilter.host_rule("block", "example.org", "/en/1").tokens == ("example", "org", "en")


def test_only_fetched_rules_run_and_plan_is_native(spark):
    rules = (urlfilter.wildcard_rule("block", "^rare^common^"), urlfilter.wildcard_rule("block", "*x*"))
    frame = spark.createDataFrame([("http://common/common/rare/common/",), ("http://qxq/",)], "url string")
    counts = urlfilter.token_counts(frame, rules)
    assert counts == {"common": 1, "rare": 1}
    found = [r.pattern for r in urlfilter.judge(frame, rules=rules).collect()]
    assert found == ["^rare^common^", "*x*"]
    plan = urlfilter.judge(frame, rules=rules)._jdf.queryExecution().executedPlan().toString()
    assert not re.search("Python|Arrow|Exchange", plan)


def test_a_host_rule_without_a_path_ends_with_the_host(spark):
    rules = (urlfilter.host_rule("block", "example.org", ""), urlfilter.host_rule("block", "cdn.net", "/a"))
    urls = ["http://example.org", "http://a.example.org/x", "http://example.organic/x", "http://example.org:80/", "http://example.org?x", "http://cdn.net/ab"]
    found = urlfilter.judge(spark.createDataFrame([(u,) for u in urls], "url string"), rules=rules).collect()
    assert [r.rule is not None for r in found] == [True, True, False, False, True, True]


def test_token_counts_by_join(spark, monkeypatch):
    rules = tuple(urlfilter.wildcard_rule("block", f"^word{i}^cart^") for i in range(3000))
    texts = spark.createDataFrame([("a.net/word7/cart/cart",), ("b.net/cart",), ("",)], "t string")
    for most in (urlfilter.BROADCAST_CHARS, 0):
        monkeypatch.setattr(urlfilter, "BROADCAST_CHARS", most)
        assert urlfilter.token_counts(texts, rules) == {"word7": 1, "cart": 2}
    assert urlfilter.token_counts(texts, ()) == {}
