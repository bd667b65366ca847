import random

import scenekiln.llm.url_filter as uf
from scenekiln.llm.queries import URL_RULES
from scenekiln.llm.url_filter import Rule, filter_urls


def brute(url, rules, default="allow"):
    host = path = ""
    if url is not None and "://" in url:
        rest = url.split("://", 1)[1]
        end = min((i for i in map(rest.find, "/?#") if i >= 0), default=len(rest))
        host = "".join(c.lower() if "A" <= c <= "Z" else c for c in rest[:end])
        path = rest[end:].split("?")[0].split("#")[0]
    fits = [r for r in rules if (host == r.host or host.endswith("." + r.host)) and path.startswith(r.path)]
    best = min(fits, key=lambda r: (-len(r.text), -len(r.host), r.verdict == "allow"), default=None)
    return host, path, best and best.text, best.verdict if best else default


URLS = [None, "", "nothing", "http://", "HTTP://ORG/x", "http://a.Example.org/es/1?x=/en", "https://b.example.org/en/12#q",
        "http://example.org", "http://xexample.org/es/", "http://a.com/de/", "http://a.com/fr/?p", "x://y://example.org/es/",
        "http://example.org?/es/", "http://.org/", "http://org./", "http://a\nb.org/\n?x", "http://É.com/de/", "http://com/de/" + "x" * 9000]


def test_against_brute_force(spark, monkeypatch):
    rng = random.Random(3)
    hosts = ["org", "example.org", "a.example.org", "b.a.example.org", "com", "x.com", "net"]
    paths = ["/", "/e", "/en", "/en/", "/en/1", "/de/"]
    rules = URL_RULES + [Rule(rng.choice(["allow", "block"]), rng.choice(hosts), rng.choice(paths)) for _ in range(12)]
    urls = URLS * 2 + [f"http://{rng.choice(['', 'w.', 'v.w.'])}{rng.choice(hosts)}{rng.choice(paths)}{rng.choice(['', 'z', '?q'])}" for _ in range(400)]
    df = spark.createDataFrame([(i, u, "old", {"k": 1}) for i, u in enumerate(urls)], "page_id long, url string, rule string, m map<string,int>")
    for size in (200_000, 5):
        monkeypatch.setattr(uf, "MAX_RULES", size)
        for given in (rules, URL_RULES, []):
            rows = {r.page_id: (r.host, r.path, r.rule, r.verdict) for r in filter_urls(df, given).collect()}
            assert rows == {i: brute(u, given) for i, u in enumerate(urls)}
    assert filter_urls(df.limit(0), rules).count() == 0


def test_a_hot_host_over_many_tasks(spark):
    """Most pages of one host, repeated rows among them: its rows are judged in several tasks, and rules that open before them count."""
    rng = random.Random(4)
    urls = [f"http://hot.example.org{rng.choice(['/es/', '/en/', '/en/1', '/'])}{i % 50}" for i in range(4000)] + [f"http://{h}/x" for h in ("a.org", "z.org", "example.org", "i.example.org", "hot.com")] * 20
    rules = URL_RULES + [Rule("block", "hot.example.org", "/es/4"), Rule("allow", "hot.example.org", "/")]
    df = spark.createDataFrame([(i, u) for i, u in enumerate(urls)], "page_id long, url string").repartition(7)
    before = spark.conf.get("spark.sql.adaptive.coalescePartitions.enabled")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        rows = filter_urls(df, rules).collect()
    finally:
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", before)
    assert {r.page_id: (r.host, r.path, r.rule, r.verdict) for r in rows} == {i: brute(u, rules) for i, u in enumerate(urls)}
