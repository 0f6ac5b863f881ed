import random

from readqc.llm.url_filter import RULES, judge


def brute(rules, url, default="allow"):
    host = path = ""
    if url is not None and "://" in url:
        rest = url.split("://", 1)[1]
        end = min([rest.find(c) for c in "/?#" if c in rest], default=len(rest))
        host, path = "".join(c.lower() if "A" <= c <= "Z" else c for c in rest[:end]), rest[end:].split("#")[0].split("?")[0]
    fits = [(len(h), len(p), v == "block", h + p, v) for v, h, p in rules if (host == h or host.endswith("." + h)) and path.startswith(p)]
    return (host, path, max(fits)[3], max(fits)[4]) if fits else (host, path, None, default)


URLS = [None, "", "x", "http://", "HTTP://Example.ORG", "http://example.org/", "http://a.example.org/es/1?x#y", "http://notexample.org/es/", "http://example.org/en/1", "http://example.org/en/123/x", "http://example.org/en/2", "ftp://u@b.com:80/fr/", "http://b.com/fr/x", "http://b.com/de", "http://b.com/de/", "http://É.com/de/é", "http://a/b://c/d", "http://.org/x", "http://org./x", "http://org?x=/y", "http://x.com#/fr/", "http://ex.com//fr/", "http://x.org/a\nb"]


def test_fixed_rules_and_random_rules(spark):
    r = random.Random(3)
    hosts = ["org", "example.org", "a.example.org", "com", "b.com"]
    more = {(h, p) for h in hosts for p in ["", "/", "/e", "/es", "/es/", "/es/1", "/fr//", "/de/x/"] if r.random() < 0.6}
    mine = [(r.choice(["allow", "block"]), h, p) for h, p in sorted(more)] + [("block", "com", "/fr/"), ("allow", "com", "/fr/")]
    urls = URLS + [f"http://{r.choice(['', 'x.'])}{r.choice(hosts)}{r.choice(['', '/', '/e', '/es', '/es/1', '/es/12', '/fr//z', '/de/x', '/de/x/'])}" for _ in range(200)]
    frame = spark.createDataFrame([(i, u, "h") for i, u in enumerate(urls)], "page_id long, url string, host string")
    for rules in (RULES, mine):
        want = [(i, *brute(rules, u)) for i, u in enumerate(urls)]
        assert sorted(map(tuple, judge(frame, rules).collect())) == want
        assert sorted(map(tuple, judge(frame, rules, max_broadcast_rules=0).collect())) == want


def test_empty(spark):
    assert judge(spark.createDataFrame([], "page_id long, url string")).count() == 0


def test_join_on_shuffled_pages(spark):
    """The join's helper numbers are taken once, whatever stands above."""
    urls = [f"http://{h}.example.{t}/{p}/{i}" for i in range(200) for h in ("a", "b") for t in ("org", "com") for p in ("es", "en", "fr")]
    frame = spark.createDataFrame(list(enumerate(urls)), "page_id long, url string").repartition(7).groupBy("page_id").agg({"url": "max"}).toDF("page_id", "url").repartition(5)
    assert sorted(map(tuple, judge(frame, RULES, max_broadcast_rules=0).collect())) == [(i, *brute(RULES, u)) for i, u in enumerate(urls)]
