"""Orphan references on a small fixture with every kind of null, tie and repeated row."""

from datetime import datetime as D

from sitewarp.operators import orphans as O

RAW = "fetch_id bigint, url string, status int, seq int, fetched_at timestamp, ingested_at timestamp, key string"
PAGE = "page_id bigint, crawled_at timestamp, links struct<internal array<string>>, key string"


def raw(spark, rows):
    return spark.createDataFrame([(i, u, s, 0, f, g, "clash") for i, (u, s, f, g) in enumerate(rows)], RAW)


def test_orphans(spark):
    jan, feb, mar = D(2025, 1, 10), D(2025, 2, 10), D(2025, 3, 10)
    delivered = raw(spark, [("HTTP://A.example/x/", 200, jan, jan), ("http://a.example/x", 200, jan, jan), ("http://a.example/late", 200, jan, feb), ("http://a.example/gone", 200, jan, jan), ("http://a.example/gone", 410, feb, feb), ("http://a.example/null", None, jan, jan), ("http://a.example/back", 404, jan, jan), ("http://a.example/back", 200, feb, feb), (None, 200, jan, jan), ("http://a.example/Case", 200, jan, jan)])
    links = ["http://a.example/x#top", "http://a.example/x#top", "http://a.example/late", "http://a.example/gone", "http://a.example/null", None, "http://a.example/back", "http://a.example/case", ""]
    page = spark.createDataFrame([(1, jan, (links,), "clash"), (2, mar, (links,), None), (3, jan, (None,), None), (4, jan, None, None), (5, None, (links,), None)], PAGE)
    got = {(r.src_id, r.target_url, r.period) for r in O.orphan_references(O.page_references(page), delivered).collect()}
    base = "http://a.example/"
    assert got == {(1, base + "late", "2025-01"), (1, base + "null", "2025-01"), (1, base + "back", "2025-01"), (1, base + "case", "2025-01"), (1, "", "2025-01"), (2, base + "gone", "2025-03"), (2, base + "null", "2025-03"), (2, base + "case", "2025-03"), (2, "", "2025-03")}
    report = {r.period: (r.n_references, r.n_orphans, r.n_targets) for r in O.orphan_report(O.page_references(page), delivered).collect()}
    assert report == {"2025-01": (7, 5, 5), "2025-03": (7, 4, 4)}


def test_empty_tables(spark):
    page, delivered = spark.createDataFrame([], PAGE), raw(spark, [])
    assert O.orphan_references(O.page_references(page), delivered).count() == 0
    one = spark.createDataFrame([(1, D(2025, 1, 1), (["/rel"],), None)], PAGE)
    assert O.orphan_references(O.page_references(one), delivered).count() == 1
    assert O.orphan_report(O.page_references(page), delivered).count() == 0
