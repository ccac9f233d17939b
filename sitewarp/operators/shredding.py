"""Columnar shredding of nested records and their reassembly into related flat tables.

A record is dissected into one column per leaf path. Every entry of a column carries a repetition
level (at which repeated step of the path the entry repeats) and a definition level (how many
optional or repeated steps of the path are present). The tables per repeated or nested ancestor
are rebuilt from these level sequences alone, so the columns may be stored, moved or pruned
independently of each other.

A path is a tuple of steps: ``.key`` for an object's member, ``{}`` for "is an object", ``[]`` for
an element of an array. Records without a fixed schema may hold an object in one place and a
scalar or an array in the same place elsewhere: each kind is a branch of its own, hence the
``{}`` step has its own definition level.
"""

from __future__ import annotations

import json
import re
from collections.abc import Iterator
from json.decoder import scanstring

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

OBJECT, ELEMENT, SCALAR = "{}", "[]", "$"


def strict_json(text: str):
    """The value of a block that is one well-formed JSON text; ``ValueError`` otherwise.
    NaN and infinities are no JSON; of a repeated member the last counts; numbers of any length stay as they are written
    if they are longer than the interpreter converts; blocks may be nested to any depth."""

    def refuse(name: str):
        raise ValueError(name)

    whole = lambda digits: int(digits) if len(digits) < 4000 else digits
    try:
        return json.loads(text, parse_constant=refuse, parse_int=whole)
    except RecursionError:
        return _deep_json(text, whole)


_NUMBER = re.compile(r"(-?(?:0|[1-9][0-9]*))((?:\.[0-9]+)?(?:[eE][+-]?[0-9]+)?)")
_BLANK = re.compile(r"[ \t\n\r]*")
_WORDS = {"t": ("true", True), "f": ("false", False), "n": ("null", None)}


def _deep_json(text: str, whole):
    """What ``strict_json`` returns, for texts nested beyond the interpreter's stack: open objects and arrays are kept in a list."""
    skip = lambda at: _BLANK.match(text, at).end()

    def member(at: int) -> tuple[str, int]:
        if text[at : at + 1] != '"':
            raise ValueError(f"no name at {at}")
        name, at = scanstring(text, at + 1, True)
        at = skip(at)
        if text[at : at + 1] != ":":
            raise ValueError(f"no colon at {at}")
        return name, skip(at + 1)

    stack: list[tuple] = []
    at = skip(0)
    while True:
        first = text[at : at + 1]
        if first in ("{", "["):
            value = {} if first == "{" else []
            at = skip(at + 1)
            if text[at : at + 1] != ("}" if first == "{" else "]"):
                name = None
                if first == "{":
                    name, at = member(at)
                stack.append((value, name))
                continue
            at += 1
        elif first == '"':
            value, at = scanstring(text, at + 1, True)
        elif first in _WORDS and text.startswith(_WORDS[first][0], at):
            value, at = _WORDS[first][1], at + len(_WORDS[first][0])
        elif m := _NUMBER.match(text, at):
            value, at = float(m.group()) if m.group(2) else whole(m.group(1)), m.end()
        else:
            raise ValueError(f"no value at {at}")
        while stack:
            at = skip(at)
            holder, name = stack[-1]
            if name is None:
                holder.append(value)
            else:
                holder[name] = value
            after = text[at : at + 1]
            if after == ",":
                at = skip(at + 1)
                if name is not None:
                    name, at = member(at)
                    stack[-1] = (holder, name)
                break
            if after != ("]" if name is None else "}"):
                raise ValueError(f"not closed at {at}")
            value = stack.pop()[0]
            at += 1
        else:
            if skip(at) != len(text):
                raise ValueError(f"more at {at}")
            return value


class Column:
    """One leaf column: parallel repetition levels, definition levels and values."""

    __slots__ = ("defs", "path", "reps", "values")

    def __init__(self, path: tuple[str, ...]):
        self.path, self.reps, self.defs, self.values = path, [], [], []


class _Node:
    """A step of the record's schema. ``depth`` is its definition level, ``rep`` its repetition level."""

    __slots__ = ("column", "depth", "kids", "parent", "rep", "step")

    def __init__(self, parent: _Node | None, step: str, depth: int, rep: int):
        self.parent, self.step, self.depth, self.rep, self.kids, self.column = parent, step, depth, rep, {}, None

    @property
    def path(self) -> tuple[str, ...]:
        steps, node = [], self
        while node.parent is not None:
            steps.append(node.step)
            node = node.parent
        return tuple(reversed(steps))

    def kid(self, step: str) -> _Node:
        if (found := self.kids.get(step)) is None:
            found = self.kids[step] = _Node(self, step, self.depth + 1, self.rep + (step == ELEMENT))
        return found


def _schema(node: _Node, value) -> None:
    """Extends the schema below ``node`` with the branches that ``value`` takes."""
    stack = [(node, value)]
    while stack:
        at, v = stack.pop()
        if isinstance(v, dict):
            branch = at.kid(OBJECT)
            stack.extend((branch.kid("." + k), x) for k, x in v.items())
        elif isinstance(v, list):
            branch = at.kid(ELEMENT)
            stack.extend((branch, x) for x in v)
        elif v is not None:
            at.kid(SCALAR)


def _leaves(node: _Node, out: list[Column]) -> None:
    stack = [node]
    while stack:
        at = stack.pop()
        if at.kids:
            stack.extend(reversed(at.kids.values()))
        else:
            at.column = Column(at.path)
            out.append(at.column)


def _missing(node: _Node, rep: int, depth: int) -> None:
    """An absent branch: every leaf below gets one entry that is defined up to ``depth`` only."""
    stack = [node]
    while stack:
        at = stack.pop()
        if at.column is not None:
            at.column.reps.append(rep)
            at.column.defs.append(depth)
            at.column.values.append(None)
        else:
            stack.extend(at.kids.values())


def _dissect(root: _Node, record) -> None:
    """Writes the entries of a record to its columns, parents before children and elements in order; without recursion, so
    records may be nested to any depth."""
    stack = [(root, record, 0)]
    while stack:
        node, value, rep = stack.pop()
        if node.column is not None:  # a step with no branch below it: null, or an empty object or array
            node.column.reps.append(rep)
            node.column.defs.append(node.depth)
            node.column.values.append(None)
            continue
        later = []
        for step, kid in node.kids.items():
            if step == OBJECT and isinstance(value, dict):
                if kid.column is not None:
                    later.append((kid, None, rep))
                for name, member in kid.kids.items():
                    if name[1:] in value:
                        later.append((member, value[name[1:]], rep))
                    else:
                        _missing(member, rep, kid.depth)
            elif step == ELEMENT and isinstance(value, list) and value:
                later.extend((kid, x, kid.rep if i else rep) for i, x in enumerate(value))
            elif step == SCALAR and value is not None and not isinstance(value, (dict, list)):
                kid.column.reps.append(rep)
                kid.column.defs.append(kid.depth)
                kid.column.values.append(value)
            else:
                _missing(kid, rep, node.depth)
        stack.extend(reversed(later))


def shred(record) -> list[Column]:
    """Leaf columns of one record, any JSON value."""
    root = _Node(None, "", 0, 0)
    _schema(root, record)
    columns: list[Column] = []
    _leaves(root, columns)
    _dissect(root, record)
    return columns


def object_rows(columns: list[Column]) -> Iterator[tuple[str, str | None, tuple[str, ...]]]:
    """(path, parent's path or None, schema path) of every object, rebuilt from the level sequences.

    The first column below an object step tells all its instances: an entry begins a new instance
    if it is defined at least up to that step and repeats at most at the step's own level.
    """
    seen: set[tuple[str, ...]] = set()
    for column in columns:
        path = column.path
        ends = [i for i, step in enumerate(path) if step == OBJECT and path[: i + 1] not in seen]
        if not ends:
            continue
        seen.update(path[: i + 1] for i in ends)
        slots = [i for i, step in enumerate(path) if step == ELEMENT]
        above = {i: max((j for j in range(i) if path[j] == OBJECT), default=None) for i in ends}
        reps_at = {i: sum(s < i for s in slots) for i in ends}
        steps = [None if step == OBJECT else step[1:] if step[0] == "." else step for step in path]
        at = [0] * (len(slots) + 1)
        for rep, level in zip(column.reps, column.defs, strict=True):
            if rep:
                at[rep] += 1
            for k in range(rep + 1, len(at)):
                at[k] = 0
            filled = None
            for i in ends:
                if level > i and rep <= reps_at[i]:
                    if filled is None:
                        filled = list(steps)
                        for k, s in enumerate(slots, 1):
                            filled[s] = str(at[k])
                    parent = above[i]
                    yield "/".join(x for x in filled[:i] if x is not None), None if parent is None else "/".join(x for x in filled[:parent] if x is not None), path[: i + 1]


def leaf_values(columns: list[Column]) -> Iterator[tuple[str, object]]:
    """(path, value) of every present scalar, rebuilt from the levels."""
    for column in columns:
        if not column.path or column.path[-1] != SCALAR:
            continue
        slots = [i for i, step in enumerate(column.path) if step == ELEMENT]
        at = [0] * (len(slots) + 1)
        full = len(column.path)
        for rep, level, value in zip(column.reps, column.defs, column.values, strict=True):
            if rep:
                at[rep] += 1
            for k in range(rep + 1, len(at)):
                at[k] = 0
            if level == full:
                index = iter(at[1:])
                yield "/".join(str(next(index)) if s == ELEMENT else s[1:] for s in column.path[:-1] if s != OBJECT), value


def heading_parents(headings: list[dict | None]) -> Iterator[tuple[str, str]]:
    """(pos, pos of the nearest earlier heading with a smaller level). Order is by pos, ties by place in
    the array; headings without a pos have an empty path and no parent; without a pos or level they are no one's parent."""
    known = sorted((h for h in headings if h and h.get("pos") is not None), key=lambda h: h["pos"])
    open_: list[dict] = []
    for h in known:
        if (level := h.get("level")) is None:
            yield str(h["pos"]), ""
            continue
        while open_ and open_[-1]["level"] >= level:
            open_.pop()
        yield str(h["pos"]), str(open_[-1]["pos"]) if open_ else ""
        open_.append(h)
    for h in headings:
        if h and h.get("pos") is None:
            yield "", ""


def _page_objects(page_id: int, jsonld, forms, headings) -> Iterator[tuple]:
    for i, block in enumerate(jsonld if jsonld is not None else ()):
        if block is None:
            continue
        try:
            columns = shred(strict_json(block))
        except ValueError:
            continue
        for path, parent, _ in object_rows(columns):
            yield page_id, "jsonld", _under(i, path), "" if parent is None else _under(i, parent)
    if forms:
        for path, parent, schema in object_rows(shred(json.loads(forms))):
            if len(schema) == 2:
                yield page_id, "form", path, ""
            else:
                place = path.split("/")
                yield page_id, "field", f"{place[0]}/{place[-1]}", parent
    if headings:
        for path, parent in heading_parents(json.loads(headings)):
            yield page_id, "heading", path, parent


def _under(block: int, path: str) -> str:
    return f"{block}/{path}" if path else str(block)


OBJECT_SCHEMA = "page_id bigint, kind string, path string, parent_path string"


def page_objects(page: DataFrame) -> DataFrame:
    """One row per JSON-LD object, form, form field and heading of every page, keyed to page and parent.

    Malformed JSON-LD blocks and null blocks give no rows but keep their place in the numbering; null
    or empty arrays give none; repeated blocks are rows of their own; a null form or field is skipped
    and keeps its place. No shuffle: pages are shredded where they are read.
    """
    flat = page.select("page_id", F.col("markup.jsonld").alias("jsonld"), F.to_json("forms").alias("forms"), F.to_json(F.transform("headings", lambda h: F.when(h.isNotNull(), F.struct(h["level"].alias("level"), h["pos"].alias("pos"))))).alias("headings"))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = [r for x in zip(batch.page_id, batch.jsonld, batch.forms, batch.headings, strict=True) for r in _page_objects(*x)]
            yield pd.DataFrame(rows, columns=["page_id", "kind", "path", "parent_path"])

    return flat.mapInPandas(run, OBJECT_SCHEMA)


LEVEL_SCHEMA = "page_id bigint, block int, leaf_path string, repetition array<int>, definition array<int>, value array<string>"


def shredded_jsonld(page: DataFrame) -> DataFrame:
    """The columnar form itself: one row per page, JSON-LD block and leaf path, with its level sequences."""
    flat = page.select("page_id", F.col("markup.jsonld").alias("jsonld"))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            for page_id, blocks in zip(batch.page_id, batch.jsonld, strict=True):
                for i, block in enumerate(blocks if blocks is not None else ()):
                    try:
                        columns = shred(strict_json(block)) if block is not None else []
                    except ValueError:
                        continue
                    rows += [(page_id, i, "".join(c.path), c.reps, c.defs, [None if v is None else v if isinstance(v, str) else json.dumps(v) for v in c.values]) for c in columns]
            yield pd.DataFrame(rows, columns=["page_id", "block", "leaf_path", "repetition", "definition", "value"])

    return flat.mapInPandas(run, LEVEL_SCHEMA)


def page_leaves(page: DataFrame) -> DataFrame:
    """(page_id, path, value): every scalar of the well-formed JSON-LD blocks, rebuilt from its column."""
    flat = page.select("page_id", F.col("markup.jsonld").alias("jsonld"))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            for page_id, blocks in zip(batch.page_id, batch.jsonld, strict=True):
                for i, block in enumerate(blocks if blocks is not None else ()):
                    try:
                        columns = shred(strict_json(block)) if block is not None else []
                    except ValueError:
                        continue
                    rows += [(page_id, f"{i}/{p}" if p else str(i), v if isinstance(v, str) else json.dumps(v)) for p, v in leaf_values(columns)]
            yield pd.DataFrame(rows, columns=["page_id", "path", "value"])

    return flat.mapInPandas(run, "page_id bigint, path string, value string")


def form_table(page: DataFrame) -> DataFrame:
    """(page_id, path, action, method, in_main, n_fields): every form, keyed as in ``page_objects``. Null forms keep their place."""
    rows = page.select("page_id", F.posexplode("forms").alias("at", "f")).where("f is not null")
    return rows.select("page_id", F.col("at").cast("string").alias("path"), "f.action", "f.method", "f.in_main", F.coalesce(F.size("f.fields"), F.lit(0)).alias("n_fields"))


def field_table(page: DataFrame) -> DataFrame:
    """(page_id, path, parent_path, name, type, required, labelled, placeholder): every form field, linked to its form."""
    forms = page.select("page_id", F.posexplode("forms").alias("at", "f")).where("f is not null")
    rows = forms.select("page_id", "at", F.posexplode("f.fields").alias("field", "x")).where("x is not null")
    return rows.select("page_id", F.concat_ws("/", "at", "field").alias("path"), F.col("at").cast("string").alias("parent_path"), "x.name", "x.type", "x.required", "x.labelled", "x.placeholder")


def heading_table(page: DataFrame) -> DataFrame:
    """(page_id, path, parent_path, level, text): every heading with the nearest earlier one of a smaller level, from its page's row alone."""
    h = F.filter("headings", lambda x: x.isNotNull())
    rows = page.select("page_id", h.alias("all"), F.explode(h).alias("h"))
    above = F.filter("all", lambda x: (x["pos"] < F.col("h.pos")) & (x["level"] < F.col("h.level")))
    parent = F.array_max(F.transform(above, lambda x: x["pos"]))
    return rows.select("page_id", F.col("h.pos").cast("string").alias("path"), F.coalesce(parent.cast("string"), F.lit("")).alias("parent_path"), "h.level", "h.text")
