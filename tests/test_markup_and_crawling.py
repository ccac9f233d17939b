"""Structured data, preflight, observation, render budget, SQL functions and the rule catalogue."""

from datetime import datetime

from pyspark.sql import functions as F
from test_audit import finding, frame

from sitewarp.functions import register
from sitewarp.operators import content, crawling, markup, shredding
from sitewarp.plans import checks, legacy_checks
from sitewarp.sources import html


def test_markup(spark):
    blocks = ['{"@id": "#a", "name": "A", "sameAs": ["https://x.example/1", "https://y.example/2"], "author": {"@id": "#b"}, "org": {"@id": "#a"}}', '{"@graph": [{"@id": "#c", "@type": ["Thing", "https://schema.org/Product"]}, {"item": {"@id": "#c"}}]}', "{bad"]
    page = spark.createDataFrame([(1, "s", (blocks,)), (2, "s", (None,)), (3, "t", None)], "page_id bigint, site string, markup struct<jsonld array<string>>")
    leaves = shredding.page_leaves(page)
    assert [tuple(r) for r in markup.dangling_references(leaves).collect()] == [(1, "#b")]
    assert sorted(r.type for r in markup.declared(leaves).collect()) == ["product", "thing"]
    assert [tuple(r) for r in markup.profile_hosts(leaves, page).collect()] == [("s", 2)]
    assert markup.dangling_references(leaves.limit(0)).count() == 0


def test_at_path(spark):
    docs = ['{"offers": [{"price": 5}, {"price": 6}], "n": {"a": "x"}}', "{bad", None, "[]"]
    frame_ = spark.createDataFrame(list(enumerate(docs)), "i int, t string")
    got = {r.i: (r.a, r.b) for r in frame_.select("i", markup.at_path(F.col("t"), "offers.price").alias("a"), markup.at_path(F.col("t"), "n.a").alias("b")).collect()}
    assert got == {0: ("5", "x"), 1: (None, None), 2: (None, None), 3: (None, None)}


def test_preflight(spark):
    at = datetime(2025, 1, 1)
    rows = [("a", "https://a/", 200, "text/html", "https://a/"), ("b", "https://b/", None, None, None), ("c", "https://c", 503, "text/html", None), ("d", "https://d/", 200, "application/pdf", None), ("e", "https://e/", 200, "text/html", "https://other/"), ("f", "https://f/", 200, "text/HTML", "https://www.f/"), ("g", "https://g/x", 200, "text/html", None)]
    raw = spark.createDataFrame([(i, *r[:3], r[3], r[4], 0, at) for i, r in enumerate(rows)], "fetch_id bigint, site string, url string, status int, content_type string, final_url string, seq int, fetched_at timestamp")
    assert {r.site: r.verdict for r in crawling.preflight(raw).collect()} == {"a": "ok", "b": "unreachable", "c": "error_status", "d": "not_html", "e": "other_host", "f": "ok"}


def test_withheld(spark):
    rows = frame(spark, [finding(1, "act.orient.no_wayfinding", urls=["a"]), finding(2, "act.form.unlabelled_inputs", urls=["b", "a"]), finding(3, "reach.x", urls=["a"]), finding(4, "act.form.unlabelled_inputs", urls=[])])
    stands, gone = crawling.withheld(rows, spark.createDataFrame([("s", "a"), ("s", "a")], "site string, url string"))
    assert {r.seq: r.affected_urls for r in stands.collect()} == {2: ["b"], 3: ["a"], 4: []}
    assert [(r.site, r.check_id) for r in gone.collect()] == [("s", "act.orient.no_wayfinding")]


def test_edge_and_budget(spark):
    probes = spark.createDataFrame([("s", "A", 403, False, 200), ("s", "B", 200, True, 200), ("s", "C", 403, False, 403), ("s", "D", 200, False, 200)], "site string, bot string, status int, challenged boolean, baseline_status int")
    assert {r.bot: r.verdict for r in crawling.edge_reach(probes).collect()} == {"A": "blocked", "B": "challenged", "C": "baseline_refused", "D": "open"}
    pages = spark.createDataFrame([("s", f"a{i}", "article") for i in range(9)] + [("s", "h", "home"), ("s", "x", None)], "site string, url string, provisional_type string")
    assert sorted(r.url for r in crawling.render_budget(pages, 4).collect()) == ["a0", "a1", "h", "x"]


def test_sql_functions(spark):
    register.register(spark)
    row = spark.sql("select url_key('HTTP://A/x/#f') a, url_host('http://A:80/x') b, path_type('https://a/docs/x') c, cast(any_date('22 April 2025') as string) d, word_count('a b') e").first()
    assert tuple(row) == ("http://a/x", "a", "docs", "2025-04-22", 2)


def test_catalogue():
    ids = [c.check_id for c in (*checks.PAGE_CHECKS, *checks.SITE_CHECKS, *legacy_checks.CHECKS)]
    assert len(ids) == len(set(ids)) and all(c.severity in ("info", "low", "medium", "high", "critical") for c in checks.CATALOGUE.values())


def test_content(spark):
    h = "array<struct<level int, text string, pos int>>"
    page = spark.createDataFrame([(1, "s", "Red lamps for homes - Acme", "Lamps that are red and bright", [(1, "Red lamps for homes", 0), (2, "Why red lamps last longer", 1)], "Red lamps last. They fit homes. Why red lamps last longer is told here."), (2, "s", "About | Acme", None, None, None), (3, "t", None, "", [], "")], f"page_id bigint, site string, title string, meta_description string, headings {h}, main_text string")
    assert [tuple(r) for r in content.site_brands(page).collect()] == [("s", "Acme", 2)]
    assert [(r.page_id, r.place, r.fact) for r in content.page_facts(page).orderBy("place").collect()] == [(1, 0, "Red lamps for homes"), (1, 1, "Why red lamps last longer"), (1, 2, "Lamps that are red and bright")]
    assert [r.supported for r in content.supported_facts(page).orderBy("place").collect()] == [True, True, True]
    w = spark.createDataFrame([(0, "It is red.", None), (1, "The lamp, as noted above, is red.", None), (2, "", None), (3, "The lamp is red.", "Acme Lamps"), (4, "Acme is here.", "Acme Lamps"), (5, None, None)], "i int, w string, n string")
    assert [r.r for r in w.select("i", content.self_contained(F.col("w"), F.col("n")).alias("r")).orderBy("i").collect()] == ["opener", "back_reference", "empty", "unnamed", None, "empty"]
    parsed = html.parsed_pages(spark.createDataFrame([(1, "<main><p>" + "w " * 30 + "<a href=/b>Buy now</a><a href=/c>See</a><img src=a.png><img src=icon.png><img src=b.png alt=B></main><nav><a href=/a>Buy all</a></nav>")], "k int, html string"), ["k"])
    assert [(r.place, r.label) for r in content.calls_to_action(parsed, ["k"]).orderBy("place").collect()] == [(0, "Buy now"), (1, "Buy all")]
    assert tuple(content.missing_alternatives(parsed, ["k"]).first()) == (1, 2, 1)
