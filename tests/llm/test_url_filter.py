import math
from collections import Counter

from pyspark.sql import functions as F

from vimarsha.llm.url_filter import Rule, _entropy, judge_urls, lexical, split_url

RULES = [Rule("allow", "org/"), Rule("block", "example.org/es/"), Rule("block", "example.org/en/1"), Rule("allow", "com/fr/"), Rule("block", "com/de/")]


def brute(url):
    if url is None or "://" not in url:
        return "", "", None, None
    rest = url.split("://", 1)[1]
    cut = lambda s, cs: s[:min([len(s), *(s.find(c) for c in cs if c in s)])]
    host = cut(rest, "/?#")
    path = cut(rest[len(host):], "?#")
    host = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in host)
    fits = [r for r in RULES if (host == r.host or host.endswith("." + r.host)) and path.startswith(r.path)]
    best = max(fits, key=lambda r: len(r.rule), default=None)
    return host, path, best and best.rule, best and best.verdict


URLS = [None, "", "no scheme", "http://", "http://ORG/", "http://x.org", "http://x.org/", "https://A.Example.org/es/1?x=/en/", "http://example.org/en/12",
        "http://notexample.org/es/", "http://example.org/en/2#f", "http://a.com/fr/", "http://a.com/fr", "http://com/de/x", "http://a.comm/de/", "a://b://c/d",
        "http://x.com?q=/fr/", "http://É.ORG/É", "http://x\n.org/a\nb", "http://x.net/a%20b-c_d.html?a=1&b=2#z"] + [
        f"http://s{i}.example.{t}/{lang}/{i}" for i in range(30) for t in ("org", "com", "net") for lang in ("en", "es", "fr", "de")]


def test_rules_equal_brute_force_and_every_url_is_judged(spark):
    rows = [(i, u, "x") for i, u in enumerate(URLS + URLS[:20])]
    df = spark.createDataFrame(rows, "page_id long, url string, HOST string")
    out = {x.page_id: x for x in judge_urls(df, RULES).collect()}
    assert len(out) == len(rows)
    for i, u, _ in rows:
        host, path, rule, verdict = brute(u)
        assert (out[i].host, out[i].path, out[i].rule) == (host, path, rule), u
        assert out[i].verdict == verdict if verdict else out[i].verdict in ("allow", "block")
    assert all(out[i].verdict == out[len(URLS) + i].verdict for i in range(20))


def test_trees_learn_from_labelled_urls(spark):
    bad = [(f"http://x{i}.bad.biz/{i}{i}{i}/{i * 7919}?a={i}&b=2", 0) for i in range(120)]
    good = [(f"https://news{i % 7}.good.info/story/some-words-here", 1) for i in range(120)] + [(f"https://good.info/page-{'abcdefghij'[i % 10]}", 1) for i in range(50)]
    labels = spark.createDataFrame(bad + good + [("http://q.z/", None)], "url string, label int")
    ask = spark.createDataFrame([(1, "http://y.bad.biz/55/66?c=1&d=5"), (2, "https://good.info/page-z")], "page_id long, url string")
    got = {x.page_id: x.verdict for x in judge_urls(ask, [], labels=labels).collect()}
    assert got == {1: "block", 2: "allow"}


def test_one_class_none_and_empty(spark):
    one = spark.createDataFrame([(1, "http://a.org/"), (2, "http://a.net/")], "page_id long, url string")
    assert {x.verdict for x in judge_urls(one, RULES).collect()} == {"allow"}
    assert {x.verdict for x in judge_urls(one, [Rule("block", "org/")]).collect()} == {"block"}
    assert judge_urls(one, []).first().verdict == "allow" and judge_urls(one.limit(0), RULES).count() == 0


def test_lexical_features(spark):
    u = "https://a.b.co.uk/x1/y-2.html?p=1&q=%20#z"
    df = spark.createDataFrame([(u,), (None,)], "url string")
    x = lexical(split_url(df)).filter("url is not null").first()
    assert (x.length, x.depth, x.labels, x.parameters, x.fragment, x.extension, x.secure, x.dots) == (len(u), 2, 4, 2, 1, 1, 1, 1)
    assert (x._s1, x._s2, x._s3) == ("uk", "co.uk", "b.co.uk")
    for t in ("", "a", "aab", "abcabc", "ééa"):
        got = spark.createDataFrame([(t,)], "t string").select(_entropy(F.col("t"))).first()[0]
        want = -sum(n / len(t) * math.log2(n / len(t)) for n in Counter(t).values()) if t else 0
        assert abs(got - want) < 1e-9
