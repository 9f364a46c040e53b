import re

from burstlens.llm import urls
from burstlens.llm.queries import URL_RULES

URLS = [
    None, "", "no scheme", "http://", "https://net/", "http://x.NET", "http://x.net/", "http://a.example.net/en/1?q#f", "http://example.net/en", "https://Example.com/de/x",
    "http://b.example.org/fr/", "http://example.org/FR/", "http://spam-farm.example.org/en/1", "http://www.cheap-pills.example.com/", "http://x.example.com/casino/1",
    "http://examplexnet/en/", "ftp://a://b.net/c", "http://host.net:80/", "http://x.net?y/", "http://é.net/ü\n/", "http://x.net/", "x" * 5000 + "://y.net/" + "z/" * 3000,
]


def restated(url):
    m = re.match(r"(?s).*?://([^/?#]*)([^?#]*)", url or "")
    host, path = (m[1].translate({i: i + 32 for i in range(65, 91)}), m[2]) if m else ("", "")
    fits = lambda h, p: (host == h or host.endswith("." + h)) and path.startswith(p)
    for rule, verdict in (("example.net/en/", "allow"), ("example.com/de/", "block"), ("org/fr/", "allow"), ("net/", "block")):
        if fits(*re.match("([^/]*)(.*)", rule).groups()):
            return host, path, "||" + rule, verdict
    bad = any(x in host + path for x in ("-farm.", "cheap-pills.", "casino-win.", "adult-x.", "free-bets.", "ads-track.", "/casino/", "/porn/", "/viagra/"))
    return host, path, None, "block" if bad else "allow"


def test_verdicts(spark):
    rows = [(i if i % 5 else None, u, "x", "y") for i, u in enumerate(URLS * 2)]
    pages = spark.createDataFrame(rows, "page_id long, url string, rule string, token string")
    got = [tuple(r) for r in urls.judge(pages, URL_RULES).collect()]
    assert sorted(got, key=repr) == sorted(((i, *restated(u)) for i, u, *_ in rows), key=repr)
    assert urls.judge(pages.limit(0), URL_RULES).count() == 0


def test_rules_and_their_tokens(spark):
    assert urls.Rule("||a.b/c", "block").tokens == ["a", "b"]  # c may go on
    assert urls.Rule("*bad*|", "block").tokens == [] and urls.Rule("^ads^", "block").tokens == ["ads"]
    rules = [urls.Rule("*bad*", "block", 1), urls.Rule("^ads^", "block", 1), urls.Rule("|x.org/|", "allow")]
    pages = spark.createDataFrame([(1, "http://q.org/isbad!"), (2, "http://q.org/ads"), (3, "http://q.org/adsy"), (4, "http://x.org/"), (5, "http://x.org/bad")], "page_id long, url string")
    got = {r.page_id: (r.rule, r.verdict) for r in urls.judge(pages, rules).collect()}
    assert got == {1: (None, "block"), 2: (None, "block"), 3: (None, "allow"), 4: ("|x.org/|", "allow"), 5: (None, "block")}


def test_filed_under_the_rarest_token(spark):
    pages = spark.createDataFrame([(i, f"http://common.org/{i}") for i in range(9)] + [(9, "http://common.org/rare/x")], "page_id long, url string")
    index = urls.index_rules(spark, [urls.Rule("||common.org/rare/", "block")], urls.subjects(pages)).collect()
    assert [r.token for r in index] == ["rare"]
