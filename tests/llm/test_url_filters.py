import itertools

from quarry.llm import url_filters

RULES = [("net", "/", "block"), ("example.net", "/en/", "allow"), ("b.example.net", None, "block"), ("EXAMPLE.com", "/de/", "block"), ("example.com", "/de/", "allow"), (None, "/", "block"), ("", "/", "block"), ("org", "/fr/", "allow")]
URLS = [None, "", "no scheme", "http://", "https://M.Example.NET/en/1?x#y", "http://net", "http://net/", "http://notexample.net/en/", "http://b.example.net", "http://a.b.example.net/en/x", "http://example.com/de/", "http://x.example.com/de", "http://xexample.com/de/1", "http://é.org/fr/#a", "http://a..net/", "http://net./", "x://org/fr/://net/", "http://example.com:80/de/"]


def brute(url, rules, default="allow"):
    rest = url.split("://", 1)[1] if url and "://" in url else ""
    cut = min([rest.find(c) for c in "/?#" if c in rest], default=len(rest))
    host = "".join(c.lower() if "A" <= c <= "Z" else c for c in rest[:cut])
    path = rest[cut:]
    path = path[: min([path.find(c) for c in "?#" if c in path], default=len(path))]
    fits = []
    for h, p, v in rules:
        h, p = (h or "").lower(), p or ""
        if h and (host == h or host.endswith("." + h)) and path.startswith(p):
            fits.append((len(h + p), len(h), v, h + p))
    best = max(fits, default=(0, 0, default, None))
    return host, path, best[3], best[2]


def run(spark, urls, rules):
    pages = spark.createDataFrame([(i, u, "clash", "clash") for i, u in enumerate(urls)], "page_id long, url string, host string, key string")
    rows = url_filters.judge_urls(pages, spark.createDataFrame(rules, url_filters.RULE_SCHEMA)).collect()
    return {r.page_id: (r.host, r.path, r.rule, r.verdict) for r in rows}


def test_against_brute_force(spark):
    urls = URLS + URLS[:6]
    assert run(spark, urls, RULES) == {i: brute(u, RULES) for i, u in enumerate(urls)}


def test_many_blocks(spark, monkeypatch):
    monkeypatch.setattr(url_filters, "BLOCK_BOUNDARIES", 4)
    names = ["a", "b", "c-d"]
    hosts = [".".join(x) for n in (1, 2, 3) for x in itertools.product(names, repeat=n)]
    rules = [(h, p, "block" if i % 3 else "allow") for i, h in enumerate(hosts[::2]) for p in ("/", "/x/")[: 1 + i % 2]]
    urls = [f"http://{h}/{p}" for h in hosts + ["z", "a.z", "z.c-d"] for p in ("", "x/1", "y")]
    assert run(spark, urls, rules) == {i: brute(u, rules) for i, u in enumerate(urls)}


def test_empty(spark):
    pages = spark.createDataFrame([], "page_id long, url string")
    rules = spark.createDataFrame([], url_filters.RULE_SCHEMA)
    assert url_filters.judge_urls(pages, rules).count() == 0
    assert run(spark, ["http://a/"], []) == {0: ("a", "/", None, "allow")}
