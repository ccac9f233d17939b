"""Repeated lines, near-duplicates and leakage against brute force, with edge cases."""

import random

from sitewarp.llm import leakage, near_duplicates, repeated_lines
from sitewarp.llm.words import shingles, word_hashes, words

PAGE = "page_id bigint, site string, text string, form string, word bigint"


def test_repeated_lines(spark):
    rows = [(i, "s", f"Home\n  COOKIE  no {i} \n\nbody {chr(97 + i % 26)}{i // 26}x", "clash", 1) for i in range(70)]
    rows += [(100 + i, "t", "only four", None, None) for i in range(4)] + [(200 + i, "u", "rare" if i < 5 else "other", None, None) for i in range(20)]
    rows += [(300, "s", None, None, None), (301, None, "Home", None, None), (302, "s", "", None, None), rows[0], (303, "s", "x" * 100_000, None, None)]
    page = spark.createDataFrame(rows, PAGE)
    got = {(r.page_id, r.line_no) for r in repeated_lines.repeated_lines(page).collect()}
    assert got == {(i, n) for i in range(70) for n in (1, 2)} | {(205 + i, 1) for i in range(15)}
    clean = {r.page_id: r.text for r in repeated_lines.without_repeated_lines(page).collect()}
    assert clean[30] == "\nbody ebx".replace("ebx", "e1x") and clean[300] is None and clean[302] == "" and clean[301] == "Home" and len(clean[303]) == 100_000
    assert repeated_lines.without_repeated_lines(page).count() == len(rows)
    assert repeated_lines.repeated_lines(spark.createDataFrame([], PAGE)).count() == 0


def _corpus():
    rng = random.Random(5)
    vocabulary = [f"w{i}" for i in range(400)]
    docs = []
    for i in range(60):
        base = [rng.choice(vocabulary) for _ in range(rng.randint(45, 200))]
        docs.append(base)
        for _ in range(2):
            edited = list(base)
            for _ in range(rng.randint(0, len(base) // 8)):
                edited[rng.randrange(len(edited))] = rng.choice(vocabulary)
            docs.append(edited)
    docs += [docs[0]] * 40
    return [(i, " ".join(d)) for i, d in enumerate(docs)]


def test_near_duplicates_against_brute_force(spark):
    docs = _corpus()
    rows = spark.createDataFrame([(i, t, "n") for i, t in docs] + [(900, None, "n"), (901, "", "n"), (902, "a b c", "n"), docs[1] + ("n",), (903, "z " * 50_000, "n")], "page_id bigint, t string, n string")
    pairs, classes = near_duplicates.near_duplicates(rows, "page_id", "t", size=3, threshold=0.6, least_words=40)
    rep = {r.id: r.rep for r in classes.collect()}
    got = {(r.a, r.b) for r in pairs.collect()}
    sets = {i: set(shingles(word_hashes(words(t)), 3).tolist()) for i, t in docs}
    reps = sorted(set(rep.values()) - {903})
    assert got == {(a, b) for a in reps for b in reps if a < b and len(sets[a] & sets[b]) >= 0.6 * len(sets[a] | sets[b])}
    assert all(rep[180 + k] == 0 for k in range(40)) and rep[903] == 903 and 902 not in rep
    expanded = {(r.a, r.b) for r in near_duplicates.expanded_pairs(pairs, classes).collect()}
    assert {(0, 180 + k) for k in range(40)} <= expanded and all(a < b for a, b in expanded)
    wide = {(r.a, r.b) for r in near_duplicates.expanded_pairs(pairs, classes, expand=100).collect()}
    ids = [i for i in rep if i != 903]
    assert wide == {(a, b) for a in ids for b in ids if a < b and len(sets[a] & sets[b]) >= 0.6 * len(sets[a] | sets[b])}


def test_large_classes_are_written_out(spark):
    """Forty texts with equal shingles in eight spellings, and an edited one: every pair is a case."""
    text = [f"w{i}" for i in range(60)]
    spelt = [" ".join(text), ", ".join(text), " ".join(text).upper(), "-".join(text), ". ".join(text), "\n".join(text), "  ".join(text), " ".join(text) + "!"]
    rows = [(i, spelt[i % 8]) for i in range(40)] + [(40, " ".join([*text[:-1], "other"]))]
    pairs, classes = near_duplicates.near_duplicates(spark.createDataFrame(rows, "page_id bigint, t string"), "page_id", "t", size=3, threshold=0.6, least_words=40)
    got = [(r.a, r.b) for r in near_duplicates.expanded_pairs(pairs, classes).collect()]
    assert sorted(got) == [(a, b) for a in range(41) for b in range(a + 1, 41)]


def test_near_duplicates_of_nothing(spark):
    pairs, classes = near_duplicates.near_duplicates(spark.createDataFrame([], "page_id bigint, t string"), "page_id", "t")
    assert pairs.count() == classes.count() == near_duplicates.expanded_pairs(pairs, classes).count() == 0


def test_leakage(spark):
    rng = random.Random(3)
    vocabulary = [f"v{i}" for i in range(30)]
    items = [(i, " ".join(rng.choice(vocabulary) for _ in range(rng.randint(5, 40)))) for i in range(25)] + [(90, None), (91, "")]
    items.append((92, items[1][1]))
    docs = []
    for i in range(120):
        w = [rng.choice(vocabulary) for _ in range(60)]
        source = rng.choice(items[:25])[1].split()
        n = rng.randint(9, 16)
        at = rng.randint(0, max(0, len(source) - n))
        w[20:20] = source[at : at + n]
        docs.append((i, (" " if i % 2 else ", ").join(x.upper() if i % 3 else x for x in w)))
    docs += [(500, None), (501, ""), docs[0], (502, ("x " * 300_000) + items[1][1])]
    want = set()
    for d, t in docs:
        w = leakage.folded_words(t or "")
        runs = {tuple(w[k : k + 13]) for k in range(len(w) - 12)}
        for i, s in items:
            v = leakage.folded_words(s or "")
            if runs & {tuple(v[k : k + 13]) for k in range(len(v) - 12)}:
                want.add((d, i))
    documents = spark.createDataFrame([(d, t, 1) for d, t in docs], "doc_id bigint, text string, item_id int")
    evaluation = spark.createDataFrame([(i, t, 2) for i, t in items], "item_id bigint, text string, doc_id int")
    assert {(r.doc_id, r.item_id) for r in leakage.leaked_items(documents, evaluation).collect()} == want and len(want) > 20
    assert leakage.leaked_items(documents, evaluation.limit(0)).count() == 0
    old, leakage.PASS_CHARS = leakage.PASS_CHARS, 100
    try:
        assert {(r.doc_id, r.item_id) for r in leakage.leaked_items(documents, evaluation).collect()} == want
    finally:
        leakage.PASS_CHARS = old


def test_altered_forms_leak():
    passage = "During the 2009 survey at Nimbeck, Jessamy Brisko noted that 377 of the reliable shops had already translated"
    tables = leakage.BlockShiftTables([(7, passage)])
    wide = passage.replace("survey", "ｓｕｒｖｅｙ").replace("Jessamy", "Jes" + chr(0x200B) + "samy").replace(" at ", chr(0xA0) + "at -- ").replace("noted", "nоted")
    assert tables.search(wide.upper()) == tables.search(passage.lower()) == [7]
    assert tables.search(passage.replace("noted", "says")) == []


def test_components_and_groups(spark):
    """A chain, a hub, a loop, repeated edges; no edges at all."""
    edges = [(i, i + 1) for i in range(100, 160)] + [(7, 1000 + i) for i in range(300)] + [(5, 5), (3, 2), (2, 3), (2, 3), (3, 1), (None, 4)]
    got = {r.id: r.group for r in near_duplicates.components(spark.createDataFrame(edges, "a bigint, b bigint")).collect()}
    assert got == {i: 100 for i in range(100, 161)} | {i: 7 for i in (7, *range(1000, 1300))} | {1: 1, 2: 1, 3: 1}
    assert near_duplicates.components(spark.createDataFrame([], "a bigint, b bigint")).count() == 0
    pairs = spark.createDataFrame([(1, 2, 0.9), (2, 5, 0.7)], "a bigint, b bigint, similarity double")
    classes = spark.createDataFrame([(1, 1, 2), (3, 1, 2), (2, 2, 1), (5, 5, 1), (9, 9, 1)], "id bigint, rep bigint, n bigint")
    assert {(r.id, r.group, r.n_group) for r in near_duplicates.grouped(pairs, classes).collect()} == {(1, 1, 4), (3, 1, 4), (2, 1, 4), (5, 1, 4), (9, 9, 1)}
