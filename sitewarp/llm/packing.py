"""Texts into containers of fixed token capacity, by lexical retrieval packing.

Texts are spread over partitions by hash. Every partition is packed in shards, each with its own BM25 inverted index over
the texts waiting to be packed; windows that a shard cannot fill stay open for the next. The longest waiting
text is the seed of a container; its best-scoring unused neighbours fill the window down to the last gap, passing over
those that would leave a gap which no other neighbours close. Only what no neighbour fits is closed by size alone.
Document frequencies and lengths are counted over all texts. Texts longer than a container are cut at the capacity, all others stay whole.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sitewarp.llm.token_counts import VOCABULARY, count_tokens
from sitewarp.llm.words import word_hashes, words
from sitewarp.session import cut_lineage

CAPACITY = 2048
#: Document frequencies are exact for terms in at least this share of the texts; one that is rarer weighs as if it had just that
#: share. A text of m distinct terms adds m to all frequencies, so at most (mean m / RARE) terms are sent to the tasks.
RARE = 1e-5
#: Items indexed at once; windows that they do not fill stay open.
SHARD = 4096
#: Tokens that a window may lack and still count as closed.
SLACK = 2
#: BM25's saturation and length normalisation.
K1, B = 1.2, 0.75
#: A container this full is closed even if the shard may still get items that fit.
FULL = 0.995

ITEM = "doc_id bigint, n_tokens int, n_words int, terms binary, counts binary"
ASSIGNMENT = "container_id bigint, doc_id bigint, piece int, start_token int, n_tokens int, place int"


def measured(documents: DataFrame, vocabulary: str = VOCABULARY) -> DataFrame:
    """Tokens, words and the term vector of every text; a term is 32 bits of its word's hash."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = []
            for doc_id, text in zip(batch.doc_id, batch.text, strict=True):
                w = words(text)
                terms, counts = np.unique((word_hashes(w) >> np.uint64(32)).astype(np.uint32), return_counts=True)
                out.append((doc_id, count_tokens(text, vocabulary), len(w), terms.tobytes(), counts.astype(np.uint32).tobytes()))
            yield pd.DataFrame(out, columns=["doc_id", "n_tokens", "n_words", "terms", "counts"])

    return documents.select("doc_id", "text").where("text is not null and text <> ''").mapInPandas(run, ITEM)


class Frequencies:
    """Inverse document frequencies: those of the known ``terms``, in rising order, and ``rare`` for all others."""

    def __init__(self, terms: np.ndarray, idf: np.ndarray, rare: float):
        self.terms, self.idf, self.rare = terms, idf, rare

    def of(self, terms: np.ndarray) -> np.ndarray:
        if not len(self.terms):
            return np.full(len(terms), self.rare, dtype=np.float32)
        at = np.minimum(np.searchsorted(self.terms, terms), len(self.terms) - 1)
        return np.where(self.terms[at] == terms, self.idf[at], np.float32(self.rare))


def document_frequencies(items: DataFrame, rare: float = RARE) -> tuple[Frequencies, float]:
    """(inverse document frequencies, mean words) of all texts. Texts per term are counted in each batch before the shuffle."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            found = [np.frombuffer(t, dtype=np.uint32) for t in batch.terms]
            if found:
                terms, n = np.unique(np.concatenate(found), return_counts=True)
                yield pd.DataFrame({"term": terms.astype(np.int64), "n": n})

    n, length = items.agg(F.count("*"), F.sum("n_words")).first()
    least = rare * n
    known = items.select("terms").mapInPandas(run, "term bigint, n bigint").groupBy("term").agg(F.sum("n").alias("n")).where(F.col("n") >= F.lit(least)).toPandas().sort_values("term")
    idf = lambda df: np.log1p((n - df + 0.5) / (df + 0.5)).astype(np.float32)
    return Frequencies(known.term.to_numpy().astype(np.uint32), idf(known.n.to_numpy()), float(idf(np.array([least]))[0])), (length or 0) / max(n, 1)


def closable(sizes: np.ndarray, gap: int) -> np.ndarray:
    """Whether a gap of 0, 1, ... ``gap`` tokens is closed, but for SLACK, by none, one or two of ``sizes``, or holds any two with room to spare."""
    present = np.zeros(gap + 1, dtype=np.uint8)
    present[sizes] = 1
    one = int.from_bytes(np.packbits(present, bitorder="little").tobytes(), "little")
    whole = 1 | one
    for s in sizes.tolist():
        whole |= one << s
    near = whole
    for k in range(1, SLACK + 1):
        near |= whole << k
    out = np.unpackbits(np.frombuffer((near & ((1 << gap + 1) - 1)).to_bytes(gap // 8 + 1, "little"), dtype=np.uint8), bitorder="little")[: gap + 1].astype(bool)
    out[whole.bit_length() :] = True
    return out


class Shard:
    """Waiting items and their inverted index. The first ``opened`` items are open windows: seeds, but never neighbours."""

    def __init__(self, items: list[tuple], idf: Frequencies, mean_words: float, opened: int = 0):
        self.items, self.opened = items, opened
        self.room = np.array([x[3] for x in items], dtype=np.int64)
        self.waiting = np.arange(len(items)) >= opened
        vectors = [np.frombuffer(x[5], dtype=np.uint32) for x in items]
        sizes = np.array([len(v) for v in vectors], dtype=np.int64)
        owner = np.repeat(np.arange(len(items)), sizes)
        terms = np.concatenate(vectors) if len(items) else np.empty(0, dtype=np.uint32)
        tf = np.concatenate([np.frombuffer(x[6], dtype=np.uint32) for x in items]).astype(np.float32) if len(items) else np.empty(0, dtype=np.float32)
        norm = K1 * (1 - B + B * np.array([x[4] for x in items], dtype=np.float32) / max(mean_words, 1.0))
        weight = idf.of(terms) * tf * (K1 + 1) / (tf + norm[owner])
        order = np.argsort(terms, kind="stable")
        order = order[owner[order] >= opened]
        self._index(terms[order], owner[order], weight[order].astype(np.float64))
        self.vectors, self.tf = vectors, tf
        # waiting items by size, longest last in each list
        self.by_size: list[list[int]] = [[] for _ in range(CAPACITY + 1)]
        for i in reversed(range(opened, len(items))):
            self.by_size[self.room[i]].append(i)
        self.available = np.array([len(x) for x in self.by_size], dtype=np.int64)

    def _index(self, term: np.ndarray, owner: np.ndarray, weight: np.ndarray) -> None:
        """Postings in the order of their terms."""
        self.term, self.owner, self.weight = term, owner, weight
        self.terms, self.starts = np.unique(term, return_index=True)
        self.stops = np.append(self.starts[1:], len(term))
        self.indexed = int(self.waiting.sum())

    def neighbours(self, seed: int) -> np.ndarray:
        """Waiting items by falling BM25 score against the seed, over all of the seed's terms."""
        if 2 * self.waiting.sum() < self.indexed:  # postings of packed items are of no more use
            keep = self.waiting[self.owner]
            self._index(self.term[keep], self.owner[keep], self.weight[keep])
        terms = self.vectors[seed]
        if not len(self.terms):
            return np.empty(0, dtype=np.int64)
        at = np.minimum(np.searchsorted(self.terms, terms), len(self.terms) - 1)
        at = at[self.terms[at] == terms]
        spans = list(zip(self.starts[at].tolist(), self.stops[at].tolist(), strict=True))
        if not spans:
            return np.empty(0, dtype=np.int64)
        score = np.bincount(np.concatenate([self.owner[a:b] for a, b in spans]), np.concatenate([self.weight[a:b] for a, b in spans]), len(self.items))
        score[~self.waiting] = 0
        found = np.flatnonzero(score)
        return found[np.argsort(-score[found], kind="stable")]

    def take(self, i: int) -> None:
        self.waiting[i] = False
        self.available[self.room[i]] -= 1

    def pop(self, size: int) -> int:
        stack = self.by_size[size]
        while not self.waiting[stack[-1]]:
            stack.pop()
        i = stack.pop()
        self.take(i)
        return i

    def closing(self, gap: int) -> list[int]:
        """The one or two waiting sizes that fill ``gap`` best; a single one wins a tie."""
        present = self.available > 0
        ones = np.flatnonzero(present[1 : gap + 1]) + 1
        best = int(ones[-1]) if len(ones) else 0
        for total in range(gap, best, -1):
            half = total // 2
            pairs = present[1 : half + 1] & present[total - half : total][::-1]
            if not total % 2 and half and pairs[half - 1] and self.available[half] < 2:
                pairs = pairs.copy()
                pairs[half - 1] = False
            if pairs.any():
                small = int(np.flatnonzero(pairs)[0]) + 1
                return [small, total - small]
        return [best] if best else []

    def retrieve(self, seed: int, gap: int) -> list[int]:
        """The neighbours that fill ``gap``: each the best-scoring one that leaves no gap, or one that one or two others close,
        or room for more; where there is none such, the longest that fits."""
        found, out = self.neighbours(seed), []
        found = found[self.room[found] <= gap]
        closed = closable(np.unique(self.room[found]), gap)
        while gap > SLACK and len(found):
            fit = closed[gap - self.room[found]]
            i = int(found[np.argmax(fit) if fit.any() else np.argmax(self.room[found])])
            out.append(i)
            self.take(i)
            gap -= int(self.room[i])
            found = found[(self.room[found] <= gap) & (found != i)]
        return out

    def pack(self, last: bool) -> tuple[list[list[int]], list[int]]:
        """(full containers, items left in others). With ``last`` nothing is left."""
        out = []
        for seed in np.lexsort((np.arange(len(self.items)), -self.room)):
            if seed >= self.opened:
                if not self.waiting[seed]:
                    continue
                self.take(seed)
            window, gap = [int(seed)], CAPACITY - int(self.room[seed])
            if self.available[: gap + 1].any():
                near = self.retrieve(int(seed), gap)
                window += near
                gap -= int(self.room[near].sum())
            while self.available[: gap + 1].any() and (sizes := self.closing(gap)):
                for size in sizes:
                    window.append(self.pop(size))
                    gap -= size
            out.append(window)
        self.windows = out
        if last:
            return out, []
        full = [w for w in out if self.room[w].sum() >= FULL * CAPACITY]
        return full, [i for w in out if self.room[w].sum() < FULL * CAPACITY for i in w]

    def loose(self, left: list[int]) -> list[list[int]]:
        """The containers that the items left were put into."""
        kept = set(left)
        return [w for w in self.windows if w[0] in kept]


def filled(batches: Iterator[pd.DataFrame], idf: Frequencies, mean_words: float, number: int = 0) -> Iterator[pd.DataFrame]:
    """The containers of a partition, numbered from ``number``.

    A window that its shard cannot fill stays open, with its members' places and the terms of its seed, until a later shard
    fills it or the partition ends. Of two windows that stay open the one's members never fit the other, so at most
    one is half empty or more: its texts wait again.
    """
    waiting: list[tuple] = []
    opened: list[tuple] = []

    def flush(last: bool) -> pd.DataFrame:
        nonlocal number, waiting, opened
        items, n = [*opened, *waiting], len(opened)
        shard = Shard(items, idf, mean_words, n)
        windows, left = shard.pack(last)
        members = lambda window: [m for i in window for m in (items[i][0] if i < n else [items[i][:4]])]
        rows = []
        for window in windows:
            rows += [(number, *m, place) for place, m in enumerate(members(window))]
            number += 1
        waiting, opened = [], []
        for window in shard.loose(left):
            size = int(shard.room[window].sum())
            if 2 * size <= CAPACITY and window[0] >= n:
                waiting += [items[i] for i in window]
            else:
                opened.append((members(window), 0, 0, size, *items[window[0]][4:]))
        return pd.DataFrame(rows, columns=["container_id", "doc_id", "piece", "start_token", "n_tokens", "place"])

    for batch in batches:
        for doc_id, tokens, n_words, terms, counts in batch.itertuples(index=False):
            for piece, start in enumerate(range(0, tokens, CAPACITY)):
                waiting.append((doc_id, piece, start, min(CAPACITY, tokens - start), n_words, terms, counts))
            if len(waiting) >= SHARD:
                yield flush(last=False)
    if waiting or opened:
        yield flush(last=True)


def packed(documents: DataFrame, vocabulary: str = VOCABULARY) -> DataFrame:
    """(container_id, doc_id, piece, start_token, n_tokens, place): where every text, or piece of a text, stands.

    Pieces of a text longer than a container are numbered from 0 and start at ``start_token``; whole texts are piece 0.
    Null and empty texts take no room and have no row; repeated rows are items of their own. Texts themselves are not
    shuffled, only their sizes and terms.
    """
    items = cut_lineage(measured(documents, vocabulary))
    idf, mean_words = document_frequencies(items)
    sent = documents.sparkSession.sparkContext.broadcast(idf)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        return filled(batches, sent.value, mean_words, TaskContext.get().partitionId() << 33)

    # sizes that lie together in the files would leave room in one place that texts of another fill
    order = F.xxhash64("doc_id", "terms")
    spread = items.withColumn("order", order).repartition(max(items.rdd.getNumPartitions(), 1), "order").sortWithinPartitions("order", "doc_id", "n_tokens")
    return spread.drop("order").mapInPandas(run, ASSIGNMENT)


def fill_report(assignment: DataFrame) -> DataFrame:
    """Containers, tokens and the share of room used."""
    return assignment.agg(F.count_distinct("container_id").alias("n_containers"), F.sum("n_tokens").alias("n_tokens")).withColumn("filled", F.col("n_tokens") / (F.col("n_containers") * CAPACITY))
