from __future__ import annotations

import re

from roomtide.llm import url_rules
from tests.llm.cases import sorted_rows

URLS = [
    "https://example.net/en/1",
    "https://example.net/en",
    "https://www.Example.NET/en/x?y#z",
    "http://net/",
    "http://net",
    "http://anet/",
    "http://a.b.c.net/q",
    "http://example.com/de/1",
    "http://xexample.com/de/1",
    "http://m.example.com/de/",
    "http://example.com/DE/1",
    "https://fr.org/fr/",
    "https://fr.org/fr",
    "https://org/fr/x",
    "x://y://example.net/en/",
    "://net/",
    "http://?q",
    "http:///de/",
    "http://example.net#/en/",
    "http://example.net:80/en/",
    "http://.net/",
    "http://net./",
    "http://a..net/",
    "no scheme",
    "",
    None,
    "http://net/\n/x",
    "http://bücher.net/é\U0010ffff",
    "http://net/\U0010ffff",
    "HTTP://EXAMPLE.COM/de/" + "a/" * 3000,
    "http://" + "a." * 500 + "net/en/",
]
MORE_RULES = (
    *url_rules.RULES,
    ("net", "/en/", "allow"),
    ("net", "/en/private/", "block"),
    ("example.net", "/", "allow"),
    ("example.net", "/", "block"),
    ("b.c.net", "/q", "allow"),
    ("net", "/longer/path/", "allow"),
    ("c.net", "/longer/p", "block"),
    (None, "/", "block"),
    ("com", None, "block"),
)


def plain_verdict(url, rules):
    host = path = ""
    if url is not None and "://" in url:
        rest = url.split("://", 1)[1]
        host = re.match(r"[^/?#]*", rest)[0]
        path = re.match(r"[^?#]*", rest[len(host) :])[0]
        host = "".join(c.lower() if "A" <= c <= "Z" else c for c in host)
    fitting = [
        (len(h) + len(p), len(h), v, h + p)
        for h, p, v in rules
        if h is not None and p is not None
        if (host == h or host.endswith("." + h)) and path.startswith(p)
    ]
    *_, verdict, rule = max(fitting, default=(0, 0, "allow", None))
    return host, path, rule, verdict


def check(spark, urls, rules):
    rows = [(k if k % 7 else None, u, "x", "y") for k, u in enumerate(urls)]
    pages = spark.createDataFrame(rows, "page_id bigint, url string, host string, rule string")
    found = url_rules.apply_rules(pages.repartition(3), url_rules.rule_table(spark, rules))
    expected = [(k, *plain_verdict(u, rules)) for k, u, *_ in rows]
    assert sorted_rows(found.collect()) == sorted_rows(expected)


def test_the_query_rules(spark):
    check(spark, URLS * 2, url_rules.RULES)


def test_nested_and_repeated_rules_over_many_ranges(spark):
    paths = ["/", "/en/", "/en/private/", "/en/private/a", "/q", "/longer/path/x", "/longer/p"]
    hosts = ["net", "example.net", "b.c.net", "a.b.c.net", "c.net", "com", "org"]
    urls = [f"http://{h}{p}{n}" for h in hosts for p in paths for n in range(4)]
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    spark.conf.set("spark.sql.shuffle.partitions", "40")
    try:
        check(spark, URLS + urls, MORE_RULES)
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "true")


def test_no_rules_and_no_pages(spark):
    check(spark, URLS, [("net", None, "block")])
    pages = spark.createDataFrame([], "page_id bigint, url string")
    assert url_rules.apply_rules(pages, url_rules.rule_table(spark)).collect() == []


def test_plan_has_no_python(spark):
    pages = spark.createDataFrame([(1, URLS[0])], "page_id bigint, url string")
    plan = url_rules.apply_rules(pages, url_rules.rule_table(spark))
    text = plan._jdf.queryExecution().toString()
    assert "Python" not in text and "NestedLoop" not in text and "Cartesian" not in text
