import random
import re

import pytest

from tidegauge.llm import url_filter as u

URLS = [
    None, "", "no scheme", "http://", "http://EXAMPLE.com/en/x?q=1", "https://www.example.com/en/", "https://notexample.com/en/",
    "http://a.b.net/es/1#f", "http://net/fr/", "http://x.net/FR/", "http://a.com", "http://a.com/", "ftp://spam-farm.example.org/en/1",
    "http://www.cheap-pills.example.com:80/en/9", "http://x.org/http://a.com/", "http://x.org?u=http://a.com/", "http://exämple.net/es/ß",
    "http://net.example/es/", "http://a.casino/", "http://com/", "http://xcom/", "://com/", "http://user@a.net/fr/é",
]


def brute(url, rules=u.SITE_RULES, words=u.BLOCKED_LABELS):
    rest = url.split("://", 1)[1] if url and "://" in url else ""
    host = re.match(r"[^/?#]*", rest).group()
    path = re.match(r"[^?#]*", rest[len(host) :]).group()
    host = "".join(c.lower() if "A" <= c <= "Z" else c for c in host)
    fits = []
    for verdict, spec in rules:
        rhost, _, rpath = spec.partition("/")
        if (host == rhost or host.endswith("." + rhost)) and path.startswith("/" + rpath):
            fits.append((len(spec), spec, verdict))
    if fits:
        return host, path, max(fits)[1], max(fits)[2]
    label = any(f".{w}." in f".{host}." or f".{w}:" in f".{host}" for w in words)
    return host, path, None, "block" if label else "allow"


def test_as_brute_force(spark):
    rnd = random.Random(5)
    hosts = ["example.com", "www.example.com", "a.net", "spam-farm.org", "casino", "b.org"]
    urls = URLS + [f"http://{rnd.choice(hosts)}/{rnd.choice(['en', 'es', 'fr', 'eng', ''])}{rnd.choice(['/', '', '/x'])}" for _ in range(200)]
    df = spark.createDataFrame([(i, x, "r") for i, x in enumerate(urls)], "page_id long, url string, rule string")
    got = {r["page_id"]: (r["host"], r["path"], r["rule"], r["verdict"]) for r in u.filter_urls(df).collect()}
    assert got == {i: brute(x) for i, x in enumerate(urls)}
    assert u.filter_urls(df.limit(0)).count() == 0


def test_only_candidates_run_and_no_shuffle(spark):
    df = spark.createDataFrame([(1, "http://a.net/es/")], "page_id long, url string")
    plan = u.filter_urls(df)._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan and "Python" not in plan.replace("PythonRDD", "")
    assert u.site_rule("block", "a.com/en").tokens == ("a", "com")
    assert u.site_rule("block", "a.com/en/").tokens == ("a", "com", "en")


def test_rules_without_tokens_and_no_rules(spark):
    df = spark.createDataFrame([(1, "http://a.net/%%%/"), (2, "http://b.org/x")], "page_id long, url string")
    loose = u.Rule("percent", "block", "%%%", ())
    assert {r["page_id"]: r["verdict"] for r in u.filter_urls(df, [loose]).collect()} == {1: "block", 2: "allow"}
    assert {r["verdict"] for r in u.filter_urls(df, []).collect()} == {"allow"}


def test_thousands_of_rules_as_brute_force(spark):
    rnd = random.Random(9)
    sites = [f"site{k}.{rnd.choice(['com', 'net', 'org'])}" for k in range(4000)]
    rules = [(rnd.choice(["allow", "block"]), f"{s}/{rnd.choice(['', 'en/', 'es/a/', 'fr'])}") for s in sites] + list(u.SITE_RULES)
    words = [f"word{k}" for k in range(500)] + ["it's", "a\\b", 'say"so']
    every = [u.site_rule(*x) for x in rules] + [u.host_word_rule(w) for w in words]
    urls = [f"http://{rnd.choice(['', 'www.', 'word7.', 'x'])}{rnd.choice(sites)}/{rnd.choice(['', 'en/', 'es/a/b', 'fr/x', 'en'])}" for _ in range(400)] + URLS
    urls += ["http://it's.org/", "http://a\\b.org/", 'http://say"so.org/']
    df = spark.createDataFrame(list(enumerate(urls)), "page_id long, url string")
    got = {r["page_id"]: (r["host"], r["path"], r["rule"], r["verdict"]) for r in u.filter_urls(df, every).collect()}
    assert got == {i: brute(x, rules, words) for i, x in enumerate(urls)}


def test_too_many_rules(spark, monkeypatch):
    monkeypatch.setattr(u, "MAX_RULES", 3)
    with pytest.raises(ValueError, match="rules"):
        u.filter_urls(spark.createDataFrame([(1, "http://a.net/")], "page_id long, url string"))
