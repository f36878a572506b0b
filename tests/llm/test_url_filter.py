from panelfx.llm.queries import URL_RULES
from panelfx.llm.url_filter import filter_urls

URLS = [
    "https://www.example.com/en/1",
    "HTTP://WWW.Example.COM/en/1?x=/fr/",
    "http://sub.a.net/fr/x#y",
    "http://net/es/",
    "http://fakenet/es/",
    "http://example.com",
    "http://example.com/EN/",
    "no scheme/en/",
    "",
    None,
    "http://a.com?u=http://b.net/es/",
    "http://user@x.com:80/p",
    "://com/",
    "http://x..net/es/1",
    "http://a.b.c.d.e.f.net/fr/" + "d/" * 500,
]


def expected(url, rules):
    rest = url.split("://", 1)[1] if url and "://" in url else ""
    cut = min([rest.find(c) for c in "/?#" if c in rest] or [len(rest)])
    host = "".join(c.lower() if "A" <= c <= "Z" else c for c in rest[:cut])
    path = rest[cut:]
    path = path[: min([path.find(c) for c in "?#" if c in path] or [len(path)])]
    fits = [
        (len(h + p), h + p, v)
        for h, p, v in rules
        if h and (host == h or host.endswith("." + h)) and path.startswith(p)
    ]
    best = max(fits) if fits else (0, None, "allow")
    return host, path, best[1], best[2]


def judged(spark, urls, rules):
    table = spark.createDataFrame(rules, "host string, path string, verdict string")
    pages = spark.createDataFrame([(k, u, "mine") for k, u in enumerate(urls)], "page_id int, url string, rule string")
    rows = filter_urls(pages, table).orderBy("page_id").collect()
    return [(r.host, r.path, r.rule, r.verdict) for r in rows]


def test_rules_of_the_query(spark):
    assert judged(spark, URLS, URL_RULES) == [expected(u, URL_RULES) for u in URLS]


def test_rules_that_end_within_a_path_part(spark):
    rules = [("example.com", "/en", "block"), ("www.example.com", "", "allow"), ("com", "/en/1", "block"), ("net", "/e", "allow")]
    assert judged(spark, URLS, rules) == [expected(u, rules) for u in URLS]


def test_repeated_rows_and_rules(spark):
    rules = [("com", "/", "allow"), ("COM", "/", "block"), (None, "/", "block"), ("", "/", "block"), ("net", None, "block")]
    rows = judged(spark, ["http://a.com/"] * 3 + ["http://b.net"], rules)
    assert [r[2:] for r in rows] == [("com/", "block")] * 3 + [("net", "block")]


def test_empty_tables(spark):
    assert judged(spark, [], URL_RULES) == []
    assert judged(spark, ["http://a.com/"], [])[0] == ("a.com", "/", None, "allow")
