"""Test passages inside a corpus, by Wu-Manber search over words.

The patterns are all runs of ``SPAN`` consecutive words of every test item. A table of word blocks says
how far the search may skip; blocks that can end a pattern lead, by the hash of the block, to the few
test strings that are then compared word by word.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce
from uuid import uuid4

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sitewarp.llm.characters import fold
from sitewarp.llm.words import WORD

SPAN, BLOCK = 13, 3
#: Characters of test items searched for in one pass over the corpus; more items take further passes.
PASS_CHARS = 4_000_000


def folded_words(text: str) -> list[str]:
    return WORD.findall(fold(text))


class BlockShiftTables:
    """Shift and bucket tables over the ``span``-word runs of the items."""

    def __init__(self, items: list[tuple[int, str]], span: int = SPAN, block: int = BLOCK):
        self.span, self.block, self.items = span, block, []
        self.shift: dict[tuple[str, ...], int] = {}
        self.bucket: dict[tuple[str, ...], list[tuple[int, int]]] = {}
        for item, text in items:
            w = folded_words(text)
            if len(w) < span:
                continue
            at = len(self.items)
            self.items.append((item, w))
            for i in range(len(w) - block + 1):
                key = tuple(w[i : i + block])
                far = max(0, span - block - i)
                if far < self.shift.get(key, span):
                    self.shift[key] = far
                if not far:
                    self.bucket.setdefault(key, []).append((at, i + block))

    def search(self, text: str) -> list[int]:
        """The items, in order, that share a run of ``span`` words with ``text``."""
        w = folded_words(text)
        span, block, found = self.span, self.block, set()
        skip, shift, bucket = span - block + 1, self.shift.get, self.bucket
        end, n = span, len(w)
        while end <= n:
            key = tuple(w[end - block : end])
            far = shift(key, skip)
            if far:
                end += far
                continue
            for at, stop in bucket[key]:
                if at not in found and w[end - span : end] == self.items[at][1][stop - span : stop]:
                    found.add(at)
            end += 1
        return [self.items[at][0] for at in sorted(found)]


#: The tables of the last pass that this worker process took part in.
_LAST: dict[str, BlockShiftTables] = {}


def _tables(name: str, sent, span: int) -> BlockShiftTables:
    """The tables of the pass ``name``, built once per worker process rather than once per task."""
    if name not in _LAST:
        _LAST.clear()
        _LAST[name] = BlockShiftTables(sent.value, span)
    return _LAST[name]


def leaked_items(documents: DataFrame, eval_items: DataFrame, span: int = SPAN) -> DataFrame:
    """(doc_id, item_id): every document and test item that share at least ``span`` consecutive words.

    Words are runs of letters and digits, compared without case and look-alike characters. Null and short texts
    share nothing; repeated rows give one row. The test set does not grow with the corpus: it is sent to the
    executors in passes of bounded size, so any number of items is searched for. One narrow pass over the corpus each.
    """
    corpus = documents.where("text is not null and doc_id is not null").select("doc_id", "text")
    context = documents.sparkSession.sparkContext

    def one_pass(items: list[tuple[int, str]]) -> DataFrame:
        sent, name = context.broadcast(items), uuid4().hex

        def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            tables = _tables(name, sent, span)
            for batch in batches:
                rows = [(d, i) for d, t in zip(batch.doc_id, batch.text, strict=True) for i in tables.search(t)]
                yield pd.DataFrame(rows, columns=["doc_id", "item_id"])

        return corpus.mapInPandas(run, "doc_id bigint, item_id bigint")

    passes, waiting, size = [], [], 0
    for r in eval_items.where("text is not null and item_id is not null").select("item_id", "text").distinct().orderBy("item_id").toLocalIterator():
        waiting.append((r.item_id, r.text))
        size += len(r.text)
        if size > PASS_CHARS:
            passes.append(one_pass(waiting))
            waiting, size = [], 0
    if waiting or not passes:
        passes.append(one_pass(waiting))
    return reduce(DataFrame.unionByName, passes).distinct()


def leak_report(leaks: DataFrame) -> DataFrame:
    """Per test item: documents it leaked into."""
    return leaks.groupBy("item_id").agg(F.count("*").alias("n_documents"))
