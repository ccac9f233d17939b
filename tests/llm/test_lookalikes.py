"""Plain characters: unit vectors, edge cases of the operator."""

import unicodedata

from sitewarp.llm import lookalikes as L
from sitewarp.llm.characters import fold, plain

N = {"ZWSP": chr(0x200B), "ZWNJ": chr(0x200C), "ZWJ": chr(0x200D), "LRM": chr(0x200E), "SHY": chr(0xAD), "NBSP": chr(0xA0), "BOM": chr(0xFEFF)}
DECOMPOSED = unicodedata.normalize("NFD", "récolte")
ODD = {DECOMPOSED: "récolte", f"se{N['ZWSP']}gundo": "segundo", f"332{N['NBSP']}visits": "332 visits", "ﬁltre": "filtre", "Ａｎｄｏ": "Ando", "３９": "39", "Τаmsіn": "Tamsin", "rοm": "rom", "аuѕ": "aus", "ѕtaуѕ": "stays", "мaгaзин": "магазин", f"N{N['SHY']}imdor": "Nimdor", f"Bordor{N['LRM']}": "Bordor", f"{N['BOM']}x": "x", "\U0001d400bc": "Abc", f"rest{chr(0x3000)}chose": "rest chose"}
PLAIN = ["récolte", "магазин", "ελληνικά", "naïve", "“quoted”", "a–b", "Ærøskøbing,", "Łódź", f"می{N['ZWNJ']}رسند", f"👩{N['ZWJ']}🔧", "❤️", "☀️", "नमस्ते", "新しい棚（木製）が！", "שלום,", "Σ=1", "АГБ", "m²", "½", "№5", "", "plain"]


def test_vectors():
    assert {k: plain(k) for k in ODD} == ODD
    assert [plain(x) for x in PLAIN] == PLAIN
    assert all(plain(v) == v for v in ODD.values())
    assert all(fold(k) == fold(v) for k, v in ODD.items())
    assert fold("ＧＲＯＳＳＥ") == fold("große")


def test_operator(spark):
    rows = [(i, odd, f"a {good} {odd}\n\tz", None) for i, (odd, good) in enumerate(ODD.items())] + [(100 + i, p, f"{p}\n {p}", "x") for i, p in enumerate(PLAIN)] + [(900, None, None, None), (901, "", "x" * 50_000 + chr(0x200B), "y"), (0, *next((o, f"a {g} {o}\n\tz") for o, g in ODD.items()), None)]
    page = spark.createDataFrame(rows, "page_id bigint, title string, text string, token string")
    got = {(r.page_id, r.field) for r in L.odd_fields(page, "page_id", ["title", "text"]).collect()}
    assert got == {(i, f) for i in range(len(ODD)) for f in ("title", "text")} | {(901, "text")}
    clean = {r.page_id: (r.title, r.text) for r in L.consistent_text(page, "page_id", ["title", "text"]).collect()}
    for i, good in enumerate(ODD.values()):
        assert clean[i] == (good, f"a {good} {good}\n\tz")
    assert all(clean[100 + i] == (p, f"{p}\n {p}") for i, p in enumerate(PLAIN))
    assert clean[900] == (None, None) and clean[901] == ("", "x" * 50_000)
    assert L.consistent_text(page, "page_id", ["title", "text"]).count() == len(rows)
    assert L.odd_fields(spark.createDataFrame([], page.schema), "page_id", ["title", "text"]).count() == 0


def test_case_of_other_alphabets_does_not_matter():
    for word in ("когда", "вкмнт", "τμήμα", "βζημ"):
        assert fold(word) == fold(word.upper())
    assert fold("Вооk Тhe") == fold("Book The") == "book the"


def test_needed_joiners_do_not_depend_on_other_texts(spark):
    """Tokens that differ only in a joiner, selector or tag which one of them needs: alone or together, none is changed."""
    zwnj, zwj, vs = N["ZWNJ"], N["ZWJ"], chr(0xFE0F)
    england, scotland = ("\U0001f3f4" + "".join(chr(0xE0000 + ord(c)) for c in name) + chr(0xE007F) for name in ("gbeng", "gbsct"))
    tokens = [f"👁{vs}{zwj}🗨{vs}", f"👁{zwj}🗨", f"می{zwnj}رسند", "میرسند", f"ميـ{zwnj}ر{zwnj}سند", f"क्{zwj}ष", "क्ष", f"क्{zwnj}ष", f"1{vs}", "1", f"❤{vs}", "❤", england, scotland, "\U0001f3f4"]
    rows = spark.createDataFrame(list(enumerate(tokens)), "page_id bigint, title string")
    assert L.odd_fields(rows, "page_id", ["title"]).count() == 0
    for i in range(0, len(tokens), 5):
        assert L.odd_fields(rows.where(f"page_id = {i}"), "page_id", ["title"]).count() == 0
    assert {r.page_id: r.title for r in L.consistent_text(rows, "page_id", ["title"]).collect()} == dict(enumerate(tokens))
    # an odd member beside them still comes out as its own plain form
    odd = rows.unionByName(spark.createDataFrame([(90, f"{N['ZWSP']}می{zwnj}رسند"), (91, "میر" + N["SHY"] + "سند")], "page_id bigint, title string"))
    got = {r.page_id: r.title for r in L.consistent_text(odd, "page_id", ["title"]).collect()}
    assert got[90] == f"می{zwnj}رسند" and got[91] == "میرسند" and all(got[i] == t for i, t in enumerate(tokens))
