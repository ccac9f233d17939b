"""Addresses and crawl rules: unit vectors on one small frame each."""

import pytest
from pyspark.sql import functions as F

from sitewarp.functions import urls as U
from sitewarp.operators import robots as R


def values(spark, inputs, function):
    frame = spark.createDataFrame([(i, x) for i, x in enumerate(inputs)], "i int, url string").coalesce(1)
    return [r.v for r in frame.select("i", function(F.col("url")).alias("v")).orderBy("i").collect()]


def test_normalised(spark):
    cases = {"HTTP://A.Example:80/x/../y/./z/?b=2&a=1&utm_source=q#f": "http://a.example/y/z/?a=1&b=2", "https://a.example:443": "https://a.example/", "https://a.example:8443/p": "https://a.example:8443/p", "mailto:x@y.z": None, "/rel": None, None: None, "": None, "https://a.example//x": "https://a.example/x", "https://a.example/?k": "https://a.example/?k="}
    assert values(spark, list(cases), U.normalised) == list(cases.values())


def test_traps(spark):
    trapped = {"https://a.example/x.pdf": "non_html_extension", "https://a.example/" + "/".join("abcdefghi"): "excessive_depth", "https://a.example/a/a/": "repeating_segment", "https://a.example/a/b/a/c/A": "repeating_segment", "https://a.example/page/9": "deep_pagination", "https://a.example/feed/": "feed_endpoint", "https://a.example/wp-json/x": "wordpress_infrastructure", "https://a.example/2024/01/05/": "date_archive_leaf", "https://a.example/x?q=1": "search_results", "https://a.example/x?a=1&b=2&c=3&d=4": "excessive_query_params", "https://a.example/x?Color=red": "faceted_param", "https://a.example/x?page=7": "deep_pagination", "https://a.example/login": "authenticated_area"}
    safe = ["https://a.example/", "https://a.example/page/2", "https://a.example/x?page=3", "https://a.example/blog/a-post", "https://a.example/x.y/z", None]
    assert values(spark, list(trapped), U.trap_reason) == list(trapped.values())
    assert values(spark, safe, U.trap_reason) == [None] * len(safe)


def test_href_kinds(spark):
    cases = {"#top": "fragment", "": "fragment", "javascript:x": "non_http", "mailto:a@b.c": "non_http", "a@b.example": "malformed", "+44 20 1234 5678": "malformed", "12 High Street, Town Hall": "malformed", "/x": "internal", "x/y": "internal", "//shop.a.example/": "internal", "https://b.example/": "external", "https://a.example/": "internal"}
    assert values(spark, list(cases), lambda c: U.href_kind(c, F.lit("https://a.example/dir/page"))) == list(cases.values())


def test_types_and_ancestors(spark):
    cases = {"https://a.example": "home", "https://a.example/contact": "contact", "https://a.example/docs/x": "docs", "https://a.example/blog/x": "article", "https://a.example/blog/": "category", "https://a.example/collections/x": "category", "https://a.example/p/x": "product", "https://a.example/cart": "utility", "https://a.example/zzz": None}
    assert values(spark, list(cases), lambda c: U.path_type(c)["page_type"]) == list(cases.values())
    assert values(spark, ["https://a.example/x/y/z?q#f", "https://a.example/"], U.ancestors) == [["https://a.example/", "https://a.example/x/", "https://a.example/x/y/"], []]


RULES = "site string, group_no int, agent string, allow boolean, pattern string, line_no int, raw string, crawl_delay double"


@pytest.mark.parametrize(
    ("pattern", "yes", "no"),
    [("/fish", ["/fish", "/fish.html", "/fish/salmon"], ["/Fish", "/catfish"]), ("/fish*", ["/fishheads"], ["/x"]), ("/*.php", ["/a.php", "/a/b.php?x"], ["/a.PHP", "/"]), ("/*.php$", ["/a.php"], ["/a.php?x", "/a.php/"]), ("/a$b", ["/a$bc"], ["/a"]), ("/q?x=", ["/q?x=1"], ["/q"]), ("/a.b[1]+", ["/a.b[1]+"], ["/axb[1]+"])],
)
def test_patterns(spark, pattern, yes, no):
    rules = spark.createDataFrame([("s", 0, "*", False, pattern, 1, "", None)], RULES)
    paths = spark.createDataFrame([("s", p) for p in yes + no], "site string, path string")
    got = {r.path: r.allowed for r in R.decisions(paths, rules, ["Bot"]).collect()}
    assert got == {p: False for p in yes} | {p: True for p in no}


def test_groups_and_precedence(spark):
    rules = spark.createDataFrame([("s", 0, "*", False, "/", 1, "", None), ("s", 1, "Applebot", False, "/x", 2, "", None), ("s", 1, "Applebot", True, "/x", 3, "", None), ("s", 1, "Applebot", True, "/x/y", 4, "", None), ("s", 2, "Applebot-Extended", False, "/", 5, "", None), ("s", 3, "other", False, "", 6, "", None)], RULES)
    paths = spark.createDataFrame([("s", "/x"), ("s", "/x/y/z"), ("s", "/z"), ("t", "/x"), ("s", "/x")], "site string, path string")
    got = {(r.site, r.path, r.token): r.allowed for r in R.decisions(paths, rules, ["Applebot", "Applebot-Extended", "OtherBot", "Nobody"]).collect()}
    assert got[("s", "/x", "Applebot")] and got[("s", "/z", "Applebot")] and not got[("s", "/z", "Applebot-Extended")]
    assert got[("s", "/z", "OtherBot")] and not got[("s", "/z", "Nobody")] and got[("t", "/x", "Nobody")] and len(got) == 16
    assert R.blanket_disallows(rules).collect()[0].site == "s"
    assert R.decisions(paths.limit(0), rules, ["x"]).count() == 0


def test_parse(spark):
    text = "﻿User-agent: A\nUser-agent: B # two\nDisallow: /x\nCrawl-delay: 5\nnonsense\n\nUser-Agent: *\r\nallow: /\r\nSitemap: https://s/\n"
    got = sorted((r.agent, r.group_no, r.allow, r.pattern, r.line_no, r.crawl_delay) for r in R.parse(spark.createDataFrame([("s", text), ("t", None), ("u", "Disallow: /")], "site string, text string")).collect())
    assert got == [("*", 1, True, "/", 8, None), ("A", 0, False, "/x", 3, 5.0), ("B", 0, False, "/x", 3, 5.0)]
