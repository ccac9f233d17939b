"""Main body and residue: minimum cuts by brute force, fixtures with every kind of null, held-out accuracy."""

import itertools
import random
import re
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from sitewarp.llm import main_body, residue
from sitewarp.llm.mincut import min_cut


def energy(labels, unary, edges):
    return sum(abs(u) for x, u in zip(labels, unary, strict=True) if x != (u > 0) and u) + sum(w for a, b, w in edges if labels[a] != labels[b])


def test_min_cut_is_minimal():
    rng = random.Random(11)
    for _ in range(300):
        n = rng.randint(1, 9)
        unary = [rng.choice([0.0, rng.uniform(-3, 3)]) for _ in range(n)]
        edges = [(rng.randrange(n), rng.randrange(n), rng.uniform(0, 2)) for _ in range(rng.randint(0, 14))]
        edges = [e for e in edges if e[0] != e[1]]
        best = min(energy(x, unary, edges) for x in itertools.product([False, True], repeat=n))
        assert energy(min_cut(unary, edges), unary, edges) == pytest.approx(best)
    assert min_cut([], []) == []


HTML = "<html><head><title>x</title></head><body><nav><ul><li><a href=/>Home</a></li><li><a>Shop</a></li></ul></nav><div id=c><h1>A fine lamp</h1><p>By Ada Byron</p><p>2025-01-02</p><p>The lamp holds 3 litres; it is fine.<p>It is also &amp; always red, as many say here.</div><aside><h3>Related reading</h3><li><a>Why we like lamps</a></li><p>Many lamps are red and hold 3 litres each.</p></aside><footer><p>© 2025 X. All rights reserved.</p></footer><script>var a = '<p>no</p>'</script></body></html>"
TEXT = "Home | Shop\n\nA fine lamp\nBy Ada Byron\n2025-01-02\nThe lamp holds 3 litres; it is fine.\nIt is also & always red, as many say here.\nRelated reading\nWhy we like lamps\nMany lamps are red and hold 3 litres each.\n© 2025 X. All rights reserved."
RAW = "url string, fetched_at timestamp, html string, fetch_id bigint, title string"
PAGE = "page_id bigint, url string, crawled_at timestamp, status int, title string, text string, noscript_text string, html string"


def test_body_lines():
    assert main_body.body_lines("A fine lamp - X", TEXT, HTML) == [3, 6, 7]
    odd = TEXT.replace("By Ada Byron", "Tell  a ｆｒｉｅｎｄ about this")
    assert main_body.body_lines("A fine lamp - X", odd, HTML.replace("By Ada Byron", "Tell  a ｆｒｉｅｎｄ about this")) == [3, 6, 7]
    assert main_body.body_lines(None, None, None) == main_body.body_lines("t", "", HTML) == main_body.body_lines("t", " \n\t", None) == []
    assert main_body.body_lines("t", "a b c", "<p>") is not None
    assert 1 <= len(main_body.body_lines("t", "\n".join(["The lamp holds 3 litres and it is a fine red lamp for all of us."] * 3000), None)) <= 3000


def tables(spark):
    at = datetime(2025, 3, 1, 12, 0, 9)
    raw = [("u1", at + timedelta(seconds=s), HTML if s != 40 else "<body><div><h1>Other</h1></div>", i, "clash") for i, s in enumerate((1, 1, 40))] + [("u2", at, None, 9, None), (None, at, HTML, 10, None)]
    pages = [(1, "u1", at, 200, "A fine lamp - X", TEXT, None, "clash"), (2, "u2", at, None, None, None, None, None), (3, None, None, 404, "t", "", None, None), (4, "u4", at, 200, "{{ name }} - X", "Some text that stands here for real.", None, None), (1, "u1", at, 200, "A fine lamp - X", TEXT, None, "clash")]
    pages += [(5, "u5", at, 404, "404", "Page not found\nSorry, we could not find that page.", None, None), (6, "u6", at, 200, None, None, "Please enable JavaScript to view this page.", None), (7, "u7", at, 200, "x", "The lamp is red and it is fine.", "Please enable JavaScript to view this page.", None)]
    return spark.createDataFrame(pages, PAGE), spark.createDataFrame(raw, RAW)


def test_operators(spark):
    page, raw = tables(spark)
    got = sorted(tuple(r) for r in main_body.main_body_lines(page, raw).where("page_id = 1").collect())
    assert got == [(1, 3), (1, 6), (1, 7)]
    assert main_body.pages_with_html(page, raw, ["title"]).where("page_id > 1").count() == 6
    reasons = {r.page_id: r.reason for r in residue.residue_pages(page, raw).collect()}
    assert reasons[4] == "slot" and reasons[6] == "scripts" and {1, 2, 3, 7}.isdisjoint(reasons)
    none = page.limit(0)
    assert main_body.main_body_lines(none, raw).count() == residue.residue_pages(none, raw.limit(0)).count() == residue.message_templates(none, raw).count() == 0


SLOTS = ["Hello {{ name }},", "[CITY] – X", "${a.b}", "<?php echo $x; ?>", "__HEADLINE__ | X", "((headline)) ((subline))", "undefined | X", "null - X", "X: [object Object]", "We ship to %CITY% in %(DAYS)s days", "@Model.price - X", "<<ITEM>>", "Hello ,  your order", "[Page title] - X", "Pay {0} now"]
SLOTS += ["%%title%% %%sep%% X", "XXXX reasons to visit us in XX/XX/XXXX", "TODO: add copy for this section", "[insert " + "x" * 500 + "]"]
NO_SLOTS = ["Size XXX or XXL, chapter XXX", "Tim's todo list", "A tag such as {{ name }} that is still visible means the field was empty.", "See the note [1].", "It is 5 % off, 10% more", "f(x) = {x | x > 0}", "Price: $5", "The undefined past", "C# and #hash", "a_b_c __init", "Null Toleranz", "", "Use [square brackets] for optional words."]


def test_slots():
    assert [x for x in SLOTS if not residue.unfilled(x)] == []
    assert [x for x in NO_SLOTS if residue.unfilled(x)] == []


CASES = {
    "filler": [("Lamp", "Lorem ipsum dolor sit amet, consectetur adipiscing elit sed do."), ("Lamp", "The lamp\nYour text goes here. Click edit to change this text."), ("x", "foo bar asdf test\nasdf qwer")],
    "status": [
        ("Oops", "Ups Fatal error\nUncaught TypeError: cannot read property of x in a.b on line 5"),
        ("x", "The page you are looking for might have been removed. It may have moved or never existed. Please try again later, and thank you for your patience while we look for it in every corner of this old and very large shop."),
        ("x", "The item has been removed by our team"),
    ],
    "scripts": [("x", "JavaScript is required. Sorry about that!")],
    "slot": [("Title goes here | X", "A lamp is red and fine."), ("Hier Titel eintragen", "x y z")],
    None: [
        ("How to write a notice", "How to write a notice\nA good “page not found” notice says what happened, offers a search box and never blames the visitor."),
        ("Lorem", "Printers have used lorem ipsum as filler since the days of lead type, long before anyone designed a website."),
        ("x", "A tag  such as {{ name }} that is still ｖｉｓｉｂｌｅ means the field was empty and nothing else is wrong here."),
        ("The title here is fine", "The item has been reviewed by our team"),
        ("x", "A heading of some words\nThe lamp holds three litres and stands on the table of the house. Page not found."),
    ],
}
SIX = "page_id bigint, url string, crawled_at timestamp, status int, title string, text string, noscript_text string, key int"


def test_verdicts_in_any_order(spark):
    rows, want = [], {}
    for reason, cases in CASES.items():
        for title, text in cases:
            want[len(rows)] = reason
            rows.append((len(rows), None, None, 200, title, text, None, 1))
    want |= {100: "scripts", 101: None, 102: None}
    rows += [(100, None, None, None, None, None, "Please  enable Jаvascript to view this page.", 1), (101, None, None, 404, None, None, None, 1), (102, None, None, 200, None, "", "Video cannot be shown without scripts.", 1)]
    # wording that no list has: what pages with an error status say is learnt, names in it are no hindrance, and error-free pages inherit it
    said = "Ohje das Regal mit {} ist leider ganz leer heute"
    rows += [(200 + i, None, None, 404 if i < 4 else 200, "x", said.format(n), None, 1) for i, n in enumerate(("Lampen", "Tassen", "Tellern", "Dosen", "Besen", "Stühlen"))]
    want |= {200 + i: "status" for i in range(6)}
    rows += [(300 + i, None, None, 404 if i < 2 else 200, "x", "Ein ganz anderer Satz mit Inhalt ist dieser hier", None, 1) for i in range(6)]
    want |= dict.fromkeys(range(300, 306))
    at = datetime(2025, 3, 1)
    rows = [(i, f"u{i}", at, *r) for i, _, _, *r in rows]
    html = lambda text: "<body><div>" + "".join(f"<{'p' if k else 'h1'}>{x}</{'p' if k else 'h1'}>" for k, x in enumerate(text.split("\n"))) + "</div>"
    raw = spark.createDataFrame([(r[1], at, html(r[5]), r[0], None) for r in rows if r[5]], RAW)
    want = {k: v for k, v in want.items() if v}
    for n, order in ((1, "page_id"), (16, "page_id desc")):
        page = spark.createDataFrame(rows, SIX).orderBy(F.expr(order)).repartition(n)
        assert {r.page_id: r.reason for r in residue.residue_pages(page, raw).collect()} == want
    templates = {(r.template, r.verdict): r.n_pages for r in residue.message_templates(page, raw).collect()}
    assert templates[("ohje das regal mit <*> ist leider ganz leer heute", "status")] == 6


def test_templates_of_a_leaf():
    leaf = residue.Leaf(6)
    a, b = leaf.add("error <*> backend fetch failed now".split()), leaf.add("error <*> backend fetch failed again".split())
    assert a == b and leaf.shapes[a] == ["error", "<*>", "backend", "fetch", "failed", "<*>"]
    assert leaf.add("error <*> frontend fetch worked well".split()) != a
    rng = random.Random(3)
    for size in (1, 2, 3, 7, 20):
        leaf, plain_ = residue.Leaf(size), []
        for _ in range(300):
            tokens = [rng.choice("abc") if rng.random() < 0.3 else str(k) for k in range(size)]
            near = [t for t, f in enumerate(plain_) if sum(map(str.__eq__, f, tokens)) >= residue.SIMILAR * size]
            assert leaf.add(tokens) == (near[0] if near else len(plain_))
            if not near:
                plain_.append(tokens)


def test_shared_tokens_change_no_template():
    rng = random.Random(4)
    for size in (2, 3, 4, 7, 12, 20, 110):
        shared = min(residue.DEPTH, size - 1)
        leaf, founders = residue.Leaf(size, shared=shared), []
        for _ in range(200):
            tokens = ["x"] * shared + [rng.choice("abc") if rng.random() < 0.4 else str(k) for k in range(shared, size)]
            near = [t for t, f in enumerate(founders) if sum(map(str.__eq__, f, tokens)) >= residue.SIMILAR * size]
            assert leaf.add(tokens) == (near[0] if near else len(founders))
            if not near:
                founders.append(tokens)


def test_the_size_of_a_leaf_changes_no_verdict(spark):
    """A message with a name in its first half is learnt in a leaf of any size, and so are the templates of the others."""
    text = lambda i: F.format_string(f"{i}", F.col("id"))
    said = lambda first, n, failed, message: spark.range(n).select((F.col("id") + first).alias("page_id"), F.expr(failed).alias("failed"), F.array(F.struct((F.col("id") + first).alias("key"), F.lit(9).alias("n"), F.lit(0).alias("lead"), F.lit("none").alias("reading"), message.alias("message"))).alias("messages"))
    learnt = said(0, 6, "id < 4", text("ohje das n%d ist leider ganz leer heute"))
    want = {(i, "ohje das <*> ist leider ganz leer heute", "status", 1) for i in range(6)}
    for others in (10, 50_001):
        both = learnt.union(said(1_000_000, others, "false", text("ohje das %1$dist nun a%1$d b%1$d c%1$d d%1$d")))
        assert {tuple(r) for r in residue.learned_messages(both).collect()} == want
    names = said(0, 50_001, "id % 3 = 0", text("ohje das n%d ist leider ganz leer heute"))
    assert [tuple(r) for r in residue.learned_messages(names).groupBy("template", "verdict").agg(F.sum("n_pages")).collect()] == [("ohje das <*> ist leider ganz leer heute", "status", 50_001)]


def test_phrases_are_those_of_the_patterns():
    from sitewarp.llm.phrases import Phrases

    rng = random.Random(9)
    patterns = {"a": r"ab+c|^de", "b": r"(?:foo|ba[rz]) *x", "c": r"^\d+$", "d": r"(?:(?!no)yes)? ?ok\b"}
    phrases = Phrases(patterns)
    for _ in range(3000):
        text = "".join(rng.choice(["a", "b", "c", "d", "e", "foo", "bar", "baz", "x", " ", "1", "yes", "ok", "no"]) for _ in range(rng.randint(0, 8)))
        assert phrases.matching(text) == [k for k, p in patterns.items() if re.search(p, text)]


def test_the_cut_goes_against_the_line_classifier():
    """Short lines of the content container are kept, and a teaser's prose beside it is not, which no line shows by itself."""
    html = "<body><div><h1>Index of /files</h1><p>Parent directory</p><p>By Ada Byron</p></div><div><h3>Related reading</h3><p>Many lamps are red, and each of them holds three litres of oil.</p><a>More</a></div>"
    lines = ["Index of /files", "Parent directory", "By Ada Byron", "Related reading", "Many lamps are red, and each of them holds three litres of oil.", "More"]
    assert main_body.labels("Index of /files", lines, html) == [True, True, False, False, False, False]
    assert main_body.labels("Index of /files", lines, html, cut=False) != main_body.labels("Index of /files", lines, html)


def test_long_lines_take_linear_time():
    for line in ("{{" * 60_000, "[[" * 60_000, "__a" * 60_000, "<a" * 60_000, "x" * 400_000, "% " * 60_000):
        assert residue.unfilled(line) is False
        main_body.body_lines("t", line, f"<body><div><p>{line}</p></div>")
