"""Nested records: brute force, property test and defined edge cases."""

import json

from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import Row

from sitewarp.operators import shredding as S

VALUES = st.recursive(st.none() | st.booleans() | st.integers(-9, 9) | st.text("ab/", max_size=3), lambda kids: st.lists(kids, max_size=3) | st.dictionaries(st.sampled_from(["a", "b", "@c", "d/e"]), kids, max_size=3), max_leaves=25)


def walk(v, path=(), parent=None):
    if isinstance(v, dict):
        here = "/".join(path)
        yield here, parent
        for k, x in v.items():
            yield from walk(x, (*path, k), here)
    elif isinstance(v, list):
        for i, x in enumerate(v):
            yield from walk(x, (*path, str(i)), parent)


def scalars(v, path=()):
    if isinstance(v, dict):
        for k, x in v.items():
            yield from scalars(x, (*path, k))
    elif isinstance(v, list):
        for i, x in enumerate(v):
            yield from scalars(x, (*path, str(i)))
    elif v is not None:
        yield "/".join(path), repr(v)


@settings(max_examples=400, deadline=None)
@given(VALUES)
def test_tables_equal_a_recursive_walk(value):
    columns = S.shred(value)
    assert sorted((p, q is None, q or "") for p, q, _ in S.object_rows(columns)) == sorted((p, q is None, q or "") for p, q in walk(value))
    assert sorted((p, repr(v)) for p, v in S.leaf_values(columns)) == sorted(scalars(value))
    assert all(len(c.reps) == len(c.defs) == len(c.values) for c in columns)


def test_headings_take_the_nearest_smaller_level():
    h = [{"level": lv, "pos": p} for lv, p in ((2, 3), (1, 0), (3, 1), (3, 2), (4, 4), (1, 5))] + [None, {"level": 2, "pos": None}, {"level": None, "pos": 6}]
    assert dict(x for x in S.heading_parents(h) if x[0]) == {"0": "", "1": "0", "2": "0", "3": "0", "4": "3", "5": "", "6": ""}


def test_page_objects_edge_cases(spark):
    schema = "page_id bigint, kind string, path string, markup struct<jsonld array<string>>, forms array<struct<action string, fields array<struct<name string>>>>, headings array<struct<level int, text string, pos int>>"
    rows = [
        Row(1, "x", "y", Row(['{"a": {}}', "{bad", None, '[{"a": NaN}]', '{"a": [1, {"b": [{}]}]} ', "[[{}]]", "3", '{"a": {}}']), [Row("/", [Row("q"), None, Row("r")]), None, Row("/2", None)], [Row(1, "t", 0)]),
        Row(2, None, None, None, None, None),
        Row(3, None, None, Row(None), [], []),
    ]
    got = sorted(tuple(r) for r in S.page_objects(spark.createDataFrame(rows, schema)).collect())
    assert got == sorted([(1, "jsonld", p, q) for p, q in (("0", ""), ("0/a", "0"), ("4", ""), ("4/a/1", "4"), ("4/a/1/b/0", "4/a/1"), ("5/0/0", ""), ("7", ""), ("7/a", "7"))] + [(1, "form", "0", ""), (1, "field", "0/0", "0"), (1, "field", "0/2", "0"), (1, "form", "2", ""), (1, "heading", "0", "")])
    assert S.page_objects(spark.createDataFrame([], schema)).count() == 0


def test_shredded_columns_hold_every_value(spark):
    page = spark.createDataFrame([(1, (['{"a": [{"b": 1}, {}, {"b": 2}], "t": "x"}'],))], "page_id bigint, markup struct<jsonld array<string>>")
    got = {r.leaf_path: (r.repetition, r.definition, r.value) for r in S.shredded_jsonld(page).collect()}
    assert got == {"{}.a[]{}.b$": ([0, 1, 1], [6, 4, 6], ["1", None, "2"]), "{}.t$": ([0], [3], ["x"])}
    assert json.loads(S.page_leaves(page).where("path = '0/a/2/b'").first().value) == 2


def test_deep_nesting_and_long_numbers():
    deep = "[" * 700 + '{"a": ' * 200 + "{}" + "}" * 200 + "]" * 700
    rows = list(S.object_rows(S.shred(S.strict_json(deep))))
    assert len(rows) == 201 and rows[0][1] is None and max(len(p) for p, _, _ in rows) > 1400
    assert len(list(S.object_rows(S.shred(S.strict_json('{"n": ' + "9" * 6000 + "}"))))) == 1
    try:
        S.strict_json("[" * 10**6)
    except ValueError:
        pass
    else:
        raise AssertionError


def test_deep_blocks_parse_like_shallow_ones():
    import json
    import random

    from sitewarp.operators.shredding import _deep_json, page_objects, strict_json  # noqa: F401

    rng = random.Random(8)

    def value(depth):
        kind = rng.randint(0, 6 if depth else 4)
        if kind == 5:
            return {rng.choice("abc\"é\\"): value(depth - 1) for _ in range(rng.randint(0, 3))}
        if kind == 6:
            return [value(depth - 1) for _ in range(rng.randint(0, 3))]
        return [None, True, rng.randint(-9, 10**6), rng.uniform(-1, 1), "x\n\"y€"][kind if kind < 5 else 0]

    for _ in range(500):
        v = value(5)
        text = json.dumps(v, indent=rng.choice([None, 1]), ensure_ascii=rng.random() < 0.5)
        assert _deep_json(text, int) == v
        broken = text[: rng.randrange(len(text) + 1)] + rng.choice(["", "}", "]", ",", "x", '"', "01", "NaN"]) + text[rng.randrange(len(text) + 1) :]
        try:
            want = json.loads(broken, parse_constant=lambda name: 1 / 0)
        except (ValueError, ZeroDivisionError):
            want = ValueError
        try:
            got = _deep_json(broken, int)
        except ValueError:
            got = ValueError
        assert got == want
    deep = 30_000
    assert strict_json("[" * deep + "]" * deep) is not None
    for bad in ("[" * deep, "[" * deep + "]" * (deep - 1), '{"a":' * deep + "}" * deep):
        try:
            strict_json(bad)
        except ValueError:
            continue
        raise AssertionError


def test_deep_blocks_give_rows(spark):
    block = '{"a":' * 1500 + "1" + "}" * 1500
    page = spark.createDataFrame([(1, (["[" * 20_000 + "]" * 20_000, block],), None, None)], "page_id bigint, markup struct<jsonld:array<string>>, forms array<struct<fields:array<struct<name:string>>>>, headings array<struct<level:int,text:string,pos:int>>")
    from sitewarp.operators.shredding import page_objects

    assert page_objects(page).count() == 1500
