from vouch.llm import url_filter as uf

SCHEMA = "page_id long, url string, host string"


def judged(spark, urls, rules, monkeypatch=None):
    pages = spark.createDataFrame([(i, u, "old") for i, u in enumerate(urls)], SCHEMA)
    out = uf.judge(pages, spark.createDataFrame(rules, "verdict string, host string, path string"))
    return [(r.host, r.path, r.rule, r.verdict) for r in out.orderBy("page_id").collect()]


URLS = ["http://A.Example.org/en/12?x", "https://example.org/es/a#b", "http://x.fr.com/fr/", "nothing", None, "http://org", "ftp://com/de/x://y", "http://é.ORG/", "http:///de/"]


def test_cases(spark):
    assert judged(spark, URLS, uf.RULES) == [
        ("a.example.org", "/en/12", "example.org/en/1", "block"), ("example.org", "/es/a", "example.org/es/", "block"), ("x.fr.com", "/fr/", "com/fr/", "allow"),
        ("", "", None, "allow"), ("", "", None, "allow"), ("org", "", None, "allow"), ("com", "/de/x://y", "com/de/", "block"), ("é.org", "/", "org/", "allow"), ("", "/de/", None, "allow"),
    ]


def test_precedence_and_odd_rules(spark):
    rules = [("allow", "a.b", "/"), ("block", "b", "/xy"), ("block", "B", "/"), ("allow", "b", "/"), ("block", None, "/"), ("maybe", "b", "/z"), ("block", "", "/")]
    assert [r[2:] for r in judged(spark, ["http://a.b/xyz", "http://b/q", "http://c/"], rules)] == [("a.b/", "allow"), ("b/", "block"), (None, "allow")]
    assert [r[3] for r in judged(spark, ["http://b/"], [])] == ["allow"] and judged(spark, [], rules) == []


def test_many_rules_take_the_shuffled_way(spark, monkeypatch):
    want = judged(spark, URLS * 3, uf.RULES)
    monkeypatch.setattr(uf, "BROADCAST_RULES", 0)
    assert judged(spark, URLS * 3, uf.RULES) == want


def test_query(twin):
    twin(uf, "op8_url_filter")


def test_very_long_hosts(spark):
    import time

    pages = spark.createDataFrame([(1, "http://" + "a." * 100_000 + "example.org/en/1"), (2, "http://" + "b" * 1_000_000 + ".com/de/x"), (3, "http://" + "." * 50_000 + "com/de/")], "page_id long, url string")
    rules = uf.rule_table(spark)
    uf.judge(pages.where("page_id = 3"), rules).collect()
    began = time.time()
    got = uf.judge(pages, rules).orderBy("page_id").select("rule", "verdict").collect()
    assert [tuple(r) for r in got] == [("example.org/en/1", "block"), ("com/de/", "block"), ("com/de/", "block")]
    assert time.time() - began < 15
