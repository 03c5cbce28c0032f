import random
from itertools import combinations, product

import pytest
from pyspark.sql import functions as F

from sequela.llm import urlrules as U

ROWS = [
    ("http://A.Example.NET/en/1?x=1", "a.example.net", "/en/1", "example.net/en/", "allow"),
    ("https://example.net/EN/1", "example.net", "/EN/1", "net/", "block"),
    ("http://notexample.com/de/", "notexample.com", "/de/", None, None),
    ("http://www.example.com/de/x#f", "www.example.com", "/de/x", "example.com/de/", "block"),
    ("ftp://b.org/fr/?q", "b.org", "/fr/", "org/fr/", "allow"),
    ("http://b.org/fr", "b.org", "/fr", None, None),
    ("http://x.net", "x.net", "", None, None),
    ("http://x.net?a=/en/", "x.net", "", None, None),
    ("x.net/en/", "", "", None, None),
    ("http://u://v.net/", "u:", "//v.net/", None, None),
    ("", "", "", None, None),
    (None, "", "", None, None),
    ("http://É.net/ä", "É.net", "/ä", "net/", "block"),
    ("http://net/", "net", "/", "net/", "block"),
    ("http://a.net\n/b", "a.net\n", "/b", None, None),
]


@pytest.fixture(scope="module")
def none(spark):
    urls = spark.createDataFrame([], "url string")
    return U.mine(urls, spark.createDataFrame([], "number long, bad boolean"))


def test_hosts_paths_and_fixed_rules(spark, none):
    pages = spark.createDataFrame([(i, r[0], "x", "y") for i, r in enumerate(ROWS)], "page_id long, url string, host string, rule string")
    got = {r.page_id: tuple(r)[1:] for r in U.judge(pages, none).collect()}
    assert got == {i: (h, p, rule, verdict or "allow") for i, (_, h, p, rule, verdict) in enumerate(ROWS)}


def test_page_numbers_and_tokens(spark):
    urls = ["http://m.a.com/en/12.html?p=2&utm=x#top", "http://a.com/12/", "http://a.com/", None, "http://a.com/x/" + "9" * 30]
    df = spark.createDataFrame([(u,) for u in urls], "url string")
    got = df.select(U.page_number(F.col("url")).alias("n"), U.tokens(F.col("url")).alias("t")).collect()
    assert [r.n for r in got] == [12, 12, None, None, None]
    assert got[0].t == ["e:html", "h:a", "h:com", "h:m", "p:en", "q:p", "q:utm"] and got[3].t == []


def plain_rules(baskets, support, confidence):
    """Rules by counting all subsets of all token sets."""
    whole, bad = {}, {}
    for tokens, is_bad in baskets:
        for k in range(1, len(tokens) + 1):
            for s in combinations(sorted(tokens), k):
                whole[s] = whole.get(s, 0) + 1
                bad[s] = bad.get(s, 0) + is_bad
    good = {
        s: bad[s] / n
        for s, n in whole.items()
        if bad[s] >= -(-support * len(baskets) // 1) and bad[s] / n >= confidence
    }
    return good


def test_mined_verdicts_equal_all_subsets(spark):
    rng = random.Random(3)
    urls, labels = [], []
    for i in range(600):
        host = rng.choice(("pills.a", "news.a", "blog.b", "shop.b"))
        lang = rng.choice(("en", "de"))
        urls.append((i, f"http://{host}.com/{lang}/{i}" + rng.choice(("", "?ref=x", ".html"))))
        bad = (host == "pills.a" and rng.random() < 0.95) or (host == "shop.b" and lang == "de") or rng.random() < 0.05
        if i % 3:
            labels.append((i, bool(bad)))
    pages = spark.createDataFrame(urls, "page_id long, url string")
    table = spark.createDataFrame(labels, "number long, bad boolean")
    mined = U.mine(pages, table, 0.02, 0.8)
    tokens = {r.page_id: tuple(r.t) for r in pages.select("page_id", U.tokens(F.col("url")).alias("t")).collect()}
    rules = plain_rules([(tokens[i], b) for i, b in labels], 0.02, 0.8)
    want = {i: "block" if any(set(s) <= set(t) for s in rules) else "allow" for i, t in tokens.items()}
    got = {r.page_id: r.verdict for r in U.judge(pages, mined, rules=()).collect()}
    assert got == want and set(want.values()) == {"allow", "block"}
    for r in mined.collect():
        for rule in product(*r.rule):  # any token of an item stands for the others
            assert r.confidence == pytest.approx(rules[tuple(sorted(rule))])


def test_a_template_of_many_names_is_one_item(spark):
    names = "&".join(f"name{k}=1" for k in range(40))
    urls = [(i, f"http://a.com/{i}?{names}" if i % 4 == 0 else f"http://a.com/{i}?x=1") for i in range(40)]
    pages = spark.createDataFrame([*urls, (99, "http://b.com/x?name7=2"), (100, "http://b.com/x?other=2")], "page_id long, url string")
    table = spark.createDataFrame([(i, i % 4 == 0) for i in range(40)], "number long, bad boolean")
    mined = U.mine(pages, table).collect()
    assert [len(r.rule) for r in mined] == [1] and sum("q:name" in t for t in mined[0].rule[0]) == 40
    verdicts = {r.page_id: r.verdict for r in U.judge(pages, U.mine(pages, table), rules=()).collect()}
    assert verdicts == {i: "block" if i % 4 == 0 and i < 40 or i == 99 else "allow" for i in [*range(40), 99, 100]}


def test_a_single_labelled_url_makes_no_rule(spark):
    pages = spark.createDataFrame([(1, "http://a.com/1?x=1"), (2, "http://b.com/2")], "page_id long, url string")
    assert U.mine(pages, spark.createDataFrame([(1, True), (2, False)], "number long, bad boolean")).collect() == []
    assert U.mine(pages, spark.createDataFrame([(1, True)], "number long, bad boolean")).collect() == []


def test_empty_tables_and_equal_rows(spark, none):
    empty = spark.createDataFrame([], "page_id long, url string")
    assert U.judge(empty, none).collect() == []
    twice = spark.createDataFrame([(None, "http://x.net/a")] * 2, "page_id long, url string")
    assert [r.verdict for r in U.judge(twice, none).collect()] == ["block"] * 2
