"""Findings, samples, windows, HTML, evidence, reports and streams on small fixtures."""

import json
from datetime import datetime, timedelta

from pyspark.sql import functions as F

from sitewarp.functions import text as T
from sitewarp.operators import findings as O
from sitewarp.operators import sampling as S
from sitewarp.plans import report
from sitewarp.sources import evidence, html
from sitewarp.streaming import pages


def finding(seq, check, severity="medium", scope="url", urls=("u1",), confidence="confirmed", site="s", **more):
    stage = check.split(".")[0]
    row = {"site": site, "seq": seq, "check_id": check, "title": "t", "severity": severity, "confidence": confidence, "stage": stage, "category": "engagement" if stage == "act" else "discoverability", "scope": scope, "affected_urls": list(urls), "evidence": f"e{seq}", "effort": "low", "summary": "do", "mechanism": "m"}
    return row | more


def frame(spark, rows):
    return spark.createDataFrame([tuple(r[c.split()[0]] for c in O.FINDING.split(", ")) for r in rows], O.FINDING)


def test_cascade(spark):
    rows = [
        finding(1, "reach.robots.ai_search_bot_blocked", "critical", "site", ()),
        finding(2, "extract.sd.absent", "high"),
        finding(3, "act.cta.absent", "high"),
        finding(4, "read.render.empty_spa_shell", "high", site="t", urls=["a"]),
        finding(5, "trust.date.absent", "high", site="t", urls=["a"]),
        finding(6, "trust.date.other", "high", site="t", urls=["a", "b"]),
        finding(7, "reach.a", "high", "site", (), site="v"),
        finding(8, "reach.b", "high", "site", (), site="v"),
        finding(9, "read.c", "high", site="v"),
    ]
    got = {r.seq: r for r in O.gated(frame(spark, rows)).collect()}
    assert (got[2].severity, got[2].blocked_seq, got[2].confidence) == ("medium", 1, "confirmed")
    assert got[1].blocked_seq is None and (got[3].severity, got[3].blocked_seq) == ("high", None)
    assert (got[5].severity, got[5].blocked_seq, got[5].confidence) == ("medium", 4, "likely")
    assert got[6].blocked_seq is None and got[9].blocked_seq == 7
    assert got[1].ice == 9.3
    ranked = {r.seq: (r.finding_id, r.blocked_by) for r in O.ranked(O.gated(frame(spark, rows)).withColumn("seq", F.col("seq"))).collect()}
    assert ranked[1] == ("F-001", None) and ranked[2] == ("F-003", "F-001")


def test_validate_absorb_collapse(spark):
    rows = [finding(i, "extract.x", "high" if i == 3 else "low", urls=[f"u{i}"]) for i in range(1, 6)]
    rows += [finding(10, "extract.ans.fact_coverage_gap", urls=["a", "b"]), finding(11, "extract.ans.chunk_not_self_contained", urls=["b"]), finding(12, "extract.ans.chunk_not_self_contained", urls=["z"]), finding(13, "reach.y", evidence=""), finding(14, "reach.z", summary=None)]
    fine, limits = O.validated(frame(spark, rows))
    assert {(r.check_id, r.reason) for r in limits.collect()} == {("reach.y", "missing evidence"), ("reach.z", "missing summary")}
    merged = {r.seq: r for r in O.absorbed(fine).collect()}
    assert 11 not in merged and merged[10].merged_from == ["extract.ans.chunk_not_self_contained"] and merged[10].evidence == "e10 Also: e11" and 12 in merged
    sites = spark.createDataFrame([("s", 8)], "site string, n_pages bigint")
    one = O.collapsed(fine, sites).where("check_id = 'extract.x'").collect()
    assert len(one) == 1 and (one[0].seq, one[0].severity, one[0].scope, one[0].n_collapsed) == (3, "high", "site", 5) and one[0].affected_urls == [f"u{i}" for i in range(1, 6)]
    assert O.collapsed(fine, spark.createDataFrame([("s", 40)], "site string, n_pages bigint")).where("check_id = 'extract.x'").count() == 5
    empty = frame(spark, [])
    ranked, limits = O.reported(empty, sites)
    assert ranked.count() == limits.count() == O.counts(ranked).count() == 0


def test_report(spark, tmp_path):
    ranked, limits = O.reported(frame(spark, [finding(1, "reach.robots.blanket_disallow", "critical", "site", ()), finding(2, "extract.x", title="<b>")]), spark.createDataFrame([("s", 3)], "site string, n_pages bigint"))
    skips = spark.createDataFrame([("s", "c", "r", 2)], "site string, check_id string, reason string, n bigint")
    reports = report.site_reports(ranked, spark.createDataFrame([("s", 3), ("t", 1)], "site string, n_pages bigint"), skips, limits)
    report.write_pages(reports, str(tmp_path))
    whole = json.loads((tmp_path / "s.json").read_text())
    assert whole["n_findings"] == 2 and whole["findings"][1]["blocked_by"] == "F-001" and whole["status"] == "complete"
    assert "Held back by F-001" in (tmp_path / "s.md").read_text() and "&lt;b&gt;" in (tmp_path / "s.html").read_text()
    assert json.loads((tmp_path / "t.json").read_text())["n_findings"] == 0


def test_samples(spark):
    rows = [("s", f"https://s/blog/{i:03}", 1 + i % 3, i % 7, "article") for i in range(400)] + [("s", f"https://s/p/{i}", 2, 1, "product") for i in range(6)] + [("s", "https://s/", 0, 99, "home"), ("s", "https://s/contact", 1, 5, "contact")]
    rows += [("t", f"https://t/{i}", None, None, None) for i in range(50)]
    frontier = spark.createDataFrame(rows, "site string, url string, depth int, inlinks int, provisional_type string")
    got = S.stratified_sample(frontier).groupBy("site", "page_type").count().collect()
    assert {(r.site, r.page_type): r["count"] for r in got} == {("s", "article"): 17, ("s", "product"): 6, ("s", "home"): 1, ("s", "contact"): 1, ("t", "unknown"): 25}
    assert sorted(r.url for r in S.stratified_sample(frontier.orderBy(F.rand(7))).collect()) == sorted(r.url for r in S.stratified_sample(frontier).collect())
    assert S.prominence_sample(frontier, 3).where("site = 's'").orderBy("url").first().url == "https://s/"


def test_windows_against_python(spark):
    texts = ["One two three. Four five! Six seven eight nine ten? Eleven. " * k for k in range(6)] + [None, "", "no end", "a b c d e f g h i j k l. m n. o p q."]

    def windows(text, target, least):
        import re

        sentences = [s.strip() for s in re.split(r"(?<=[.!?])\s+", text or "") if s.strip()]
        out, open_, n = [], [], 0
        for s in sentences:
            k = len(re.findall(r"[A-Za-z0-9][A-Za-z0-9'’\-]*", s))
            if n + k > target and open_:
                out.append(" ".join(open_))
                back, n = [], 0
                for p in reversed(open_):
                    back.insert(0, p)
                    n += len(re.findall(r"[A-Za-z0-9][A-Za-z0-9'’\-]*", p))
                    if n >= least:
                        break
                open_ = back
            open_.append(s)
            n += k
        return out + ([" ".join(open_)] if open_ else [])

    frame_ = spark.createDataFrame(list(enumerate(texts)), "i int, text string")
    got = {r.i: r.w for r in frame_.select("i", T.greedy_windows(F.col("text"), 10, 0.15).alias("w")).collect()}
    assert got == {i: windows(t, 10, 1) for i, t in enumerate(texts)}


def test_dates(spark):
    cases = {"2025-03-14": "2025-03-14", "2025-07-06T03:00:00Z": "2025-07-06", "Tue, 25 Mar 2025 08:00:00 GMT": "2025-03-25", "22 April 2025": "2025-04-22", "April 2, 2026": "2026-04-02", "05/20/2025": "2025-05-20", "": None, "soon": None, None: None}
    rows = spark.createDataFrame([(i, x) for i, x in enumerate(cases)], "i int, x string").select("i", T.any_date(F.col("x")).cast("string").alias("d")).orderBy("i").collect()
    assert [r.d for r in rows] == list(cases.values())


PAGE = "<!doctype html><html><head><title>T &amp; x</title><meta name=Description content=d><meta property='og:title' content=o><link rel=canonical href=/c></head><body><nav><a href=/>Home</a></nav><main id=m><h1>Hi <b>you</b></h1><p>" + "word " * 30 + "<form action=/f method=POST><input name=q><label>Name <input name=n required></label><input type=hidden name=h></form><img src=a.png alt=A width=10px></main><script type='application/ld+json'>{bad</script><noscript>Enable JavaScript</noscript><footer>legal</footer></body></html>"


def test_html(spark):
    raw = spark.createDataFrame([(1, PAGE, "x"), (2, None, None), (3, "", None), (4, "<div>" * 3000 + "deep", None), (5, "<p>a<b>c</p></i>", None), (6, "<body><div id=root></div><script src=a.js></script>", None)], "fetch_id bigint, html string, title string")
    got = {r.fetch_id: r for r in html.parsed_pages(raw, ["fetch_id"]).collect()}
    assert set(got) == {1, 3, 4, 5, 6}
    p = got[1]
    assert (p.title, p.canonical, p.main_selector, p.n_main_words, p.noscript_text) == ("T & x", "/c", "main#m", 33, "Enable JavaScript")
    assert p.meta == {"description": "d"} and p.opengraph == {"og:title": "o"} and [(h.level, h.text) for h in p.headings] == [(1, "Hi you")]
    assert [(f.name, f.required, f.labelled) for f in p.forms[0].fields] == [("q", False, False), ("n", True, True)] and p.forms[0].method == "post" and p.images[0].width == 10
    assert [e.line for e in p.parse_errors] == [1] and p.anchors[0].in_chrome and got[4].text == "deep" and got[6].empty_shell and not p.empty_shell
    assert html.parsed_pages(raw.limit(0), ["fetch_id"]).count() == 0


def test_evidence(spark, tmp_path):
    site = tmp_path / "a"
    site.mkdir()
    (site / "x.html").write_text("<title>é</title>")
    (site / "_meta.json").write_text(json.dumps({"origin": "https://a.example", "default_status": 404, "ttfb_ms": [1.5], "routes": {"/": {"status": 200, "file": "x.html"}, "/r": {"status": 301, "redirect_to": "/"}, "/b": {"status": 200, "body": "hi"}}}))
    rows = {r.url: r for r in evidence.fixture_sites(spark, str(tmp_path)).collect()}
    assert rows["https://a.example/"].html == "<title>é</title>" and rows["https://a.example/b"].html == "hi" and rows["https://a.example/r"].final_url == "https://a.example/" and rows["https://a.example/r"].hops[0].location == "/"
    (tmp_path / "pages.jsonl").write_text('{"url": "u", "status": 200}\n{bad\n')
    bundle = evidence.read_bundle(spark, str(tmp_path))
    assert bundle["page"].where("url = 'u'").count() == 1 and bundle["sitemap_entry"].count() == 0
    maps = spark.createDataFrame([("s", "m1", 200, "<urlset><url><loc> https://s/a?x=1&amp;y </loc><lastmod>2025-01-01</lastmod></url><url><loc></loc></url></urlset>"), ("s", "m2", 200, "<sitemapindex><sitemap><loc>https://s/m1</loc></sitemap></sitemapindex>"), ("s", "m3", 404, "x"), ("s", "m4", 200, "<urlset><url>")], "site string, url string, status int, text string")
    assert [tuple(r) for r in evidence.sitemap_entries(maps).collect()] == [("s", "https://s/a?x=1&y", "2025-01-01")]
    assert [tuple(r) for r in evidence.sitemap_children(maps).collect()] == [("s", "https://s/m1")]
    assert {r.url: r.parse_error for r in evidence.sitemap_documents(maps).collect()} == {"m1": None, "m2": None, "m3": "http_error", "m4": "truncated"}
    probes = evidence.probe_addresses(spark.createDataFrame([("a.example",)], "site string"))
    assert sorted(r.probe_url for r in probes.collect()) == sorted(r.probe_url for r in probes.collect()) and probes.count() == 3


def test_streams(spark, tmp_path):
    at = datetime(2025, 1, 1)
    rows = [("s", "https://s/a", at + timedelta(hours=i), 200 if i < 3 else 410) for i in range(4)]
    schema = "site string, url string, fetched_at timestamp, status int"
    for i, part in enumerate((rows[:2], rows[2:])):
        spark.createDataFrame(part, schema).coalesce(1).write.parquet(str(tmp_path / "in" / f"p{i}"))
    stream = pages.stream_table(spark, str(tmp_path / "in" / "*"), spark.createDataFrame([], schema).schema)
    pages.upsert_latest(stream, str(tmp_path / "out"), str(tmp_path / "ckpt")).awaitTermination(60)
    last = max((tmp_path / "out").iterdir(), key=lambda p: int(p.name[2:]))
    assert [(r.key, r.status) for r in spark.read.parquet(str(last)).collect()] == [("https://s/a", 410)]
    query = pages.answers_per_window(stream).writeStream.format("memory").queryName("windows").outputMode("complete").trigger(availableNow=True).start()
    query.awaitTermination(60)
    assert [(r.n, r.n_failed) for r in spark.sql("select * from windows").collect()] == [(4, 1)]
    paced = pages.host_pacing(stream.select("site", "url", F.col("fetched_at").alias("at")), 2 * 3_600_000).writeStream.format("memory").queryName("paced").outputMode("append").trigger(availableNow=True).start()
    paced.awaitTermination(60)
    assert spark.sql("select sum(wait_ms) as w from paced").first().w > 0
