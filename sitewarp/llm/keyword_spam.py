"""Keyword-stuffed and link-list documents, by pointwise mutual information of neighbouring words.

Segments without the words that hold sentences together form runs. Each run is judged by corpus counts: the
mean PMI of its neighbouring words, without the occurrences in the document and its copies, tells word salad from ordinary
terse entries; collocations repeated over and over within the run and bare links tell keyword stuffing. A
document is spam if flagged runs hold more than half of its words.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sitewarp.llm.words import scramble, word_hashes
from sitewarp.operators.joins import salted_join
from sitewarp.session import cut_lineage

# Closed-class words of the corpus's languages.
GLUE = frozenset(
    """the a an of and to in on at by for with from is was are were be been it its that this these which as or but not no so if when while after before over under than then there you we our your they their has have had will would can may into out up down about i he she his her what why how who where also only more
der die das den dem des ein eine einen einem einer und oder nicht von zu mit im am an auf bei für aus ist war sind hat haben wie dass weil falls bis zum zur als auch nur wer was wenn kein keine jeden jede jeder man sich sie wir ihr ihre über
le la les un une des du de et ou ne que qui dans sur au aux par pour avec est ce cette ces si il elle nous vous leur son sa ses aucun aucune plus quand comment
el los las una y o al del con por para es se su sus en lo que cuando hasta desde ningún ninguna cada hay muy más tanto
и в не на с со по к ко у из за от до что как так ни для о об же то это если когда чтобы хотя пока под над при или но""".split()
)
#: A segment with a smaller share of closed-class words holds no sentence.
LEAST_GLUE = 0.08
#: A run is judged from this many words on.
LEAST_RUN = 5
#: Below this mean PMI (natural logarithm) neighbouring words are put together at random. A pair counts at most MOST, so
#: that a few set phrases do not carry a run, and UNSEEN if no other text has it.
SALAD, MOST, UNSEEN = 2.25, 3.0, -1.0
#: Share of neighbouring pairs that stand at least three times in the run, and of words in links, from which a run is stuffing.
REPEATED, LINKED = 0.2, 0.5
#: Words of the filter of wanted keys (16 MB), a power of two, and the shifts at which a key's bits are read for it.
FILTER_WORDS, PROBES = 1 << 21, (0, 32)

_LINK = re.compile(r"(?:https?://|www\.)[^\s)\]>]+|#\w{3,}")
_NUMBER = re.compile(r"\d+(?:[.,:]\d+)*")
_TOKEN = re.compile(r"[^\W_]+")
_SENTENCE = re.compile(r"(?<=[.!?…])\s+|\n")
_PAIR_A, _PAIR_B, _WORD = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F), np.uint64(0x165667B19E3779F9)

RUN = "doc_id bigint, digest bigint, words int, run int, run_words int, stuffed boolean, pair bigint, left bigint, right bigint, n int, own_pair int, own_left int, own_right int"


def tokens(text: str) -> list[str]:
    return _TOKEN.findall(_NUMBER.sub("0", text.lower()))


def _keys(hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    return scramble(hashes * _WORD), scramble(hashes[:-1] * _PAIR_A + hashes[1:] * _PAIR_B)


def wanted_filter(wanted: DataFrame) -> np.ndarray:
    """A Bloom filter of the distinct keys, FILTER_WORDS words of 64 bits and so of fixed size however many they are: its words are
    OR-ed before they reach the driver. A full one only lets more keys through to the exact join."""
    probes = F.array(*(F.shiftrightunsigned("key", at).bitwiseAND(64 * FILTER_WORDS - 1) for at in PROBES))
    words = wanted.select(F.explode(probes).alias("bit")).groupBy(F.shiftright("bit", 6).alias("word")).agg(F.bit_or(F.expr("shiftleft(1L, cast(bit & 63 as int))")).alias("bits")).toPandas()
    out = np.zeros(FILTER_WORDS, dtype=np.uint64)
    out[words.word.to_numpy()] = words.bits.to_numpy().view(np.uint64)
    return out


def _may_hold(bloom: np.ndarray, keys: np.ndarray) -> np.ndarray:
    hit = np.ones(len(keys), dtype=bool)
    for at in PROBES:
        bit = (keys >> np.uint64(at)) & np.uint64(64 * FILTER_WORDS - 1)
        hit &= (bloom[(bit >> np.uint64(6)).astype(np.int64)] >> (bit & np.uint64(63)) & np.uint64(1)).astype(bool)
    return hit


def corpus_counts(documents: DataFrame, wanted: DataFrame) -> DataFrame:
    """(key, n): occurrences in all documents of every wanted word and pair of neighbouring words, and under key 0 of all words.
    Counted per batch; what nobody wants is dropped before the shuffle."""
    sent = documents.sparkSession.sparkContext.broadcast(wanted_filter(wanted))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            parts, total = [], 0
            for text in batch.text:
                t = tokens(text)
                total += len(t)
                if t:
                    parts += _keys(word_hashes(t))
            if total:
                keys = np.concatenate(parts)
                keys, n = np.unique(keys[_may_hold(sent.value, keys)], return_counts=True)
                yield pd.DataFrame({"key": np.append(keys.view(np.int64), 0), "n": np.append(n, total)})

    counts = documents.select("text").where("text is not null").mapInPandas(run, "key bigint, n bigint").groupBy("key").agg(F.sum("n").alias("n"))
    return counts.join(wanted, "key", "left_semi")


def loose_runs(text: str) -> tuple[int, list[tuple[list[str], int]]]:
    """(words of the text, [(words of a run, of them in links)]): the runs of consecutive segments that hold no sentence."""
    total, runs, open_ = 0, [], False
    for segment in _SENTENCE.split(text):
        t = tokens(segment)
        if not t:
            continue
        total += len(t)
        if sum(w in GLUE for w in t) < LEAST_GLUE * len(t):
            links = sum(len(tokens(m)) for m in _LINK.findall(segment))
            if open_:
                runs[-1][0].extend(t)
                runs[-1][1] += links
            else:
                runs.append([t, links])
                open_ = True
        else:
            open_ = False
    return total, [(t, links) for t, links in runs]


def run_pairs(documents: DataFrame) -> DataFrame:
    """One row per distinct neighbouring pair of each run, of the documents whose runs hold more than half of
    their words; no other document can be spam."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = []
            for doc_id, digest, text in zip(batch.doc_id, batch.digest, batch.text, strict=True):
                total, runs = loose_runs(text)
                runs = [r for r in runs if len(r[0]) >= LEAST_RUN]
                if 2 * sum(len(t) for t, _ in runs) <= total:
                    continue
                own_words, own_pairs = (dict(zip(*(x.tolist() for x in np.unique(k, return_counts=True)), strict=True)) for k in _keys(word_hashes(tokens(text))))
                for i, (t, links) in enumerate(runs):
                    w, p = _keys(word_hashes(t))
                    distinct, first, n = np.unique(p, return_index=True, return_counts=True)
                    stuffed = links >= LINKED * len(t) or bool(n[n > 2].sum() >= REPEATED * len(p))
                    for key, at, k in zip(distinct, first, n, strict=True):
                        a, b = w[at], w[at + 1]
                        out.append((doc_id, digest, total, i, len(t), stuffed, key, a, b, k, own_pairs.get(int(key), 0), own_words[int(a)], own_words[int(b)]))
            frame = pd.DataFrame(out, columns=[c.split()[0] for c in RUN.split(", ")])
            for c in ("pair", "left", "right"):
                frame[c] = frame[c].astype("uint64").astype("int64")
            yield frame

    return documents.select("doc_id", F.xxhash64("text").alias("digest"), "text").where("text is not null and doc_id is not null").mapInPandas(run, RUN)


def judged_runs(documents: DataFrame) -> DataFrame:
    """(doc_id, words, run, run_words, stuffed, pmi) of the runs that may make their document spam."""
    pairs = cut_lineage(run_pairs(documents))
    wanted = pairs.select(F.explode(F.array("pair", "left", "right", F.lit(0).cast("bigint"))).alias("key")).distinct()
    counts = cut_lineage(corpus_counts(documents, wanted))
    total = counts.where("key = 0").first()
    total = total.n if total else 0
    copies = documents.where("text is not null").select(F.xxhash64("text").alias("digest")).groupBy("digest").agg(F.count("*").alias("copies"))
    rows = pairs.join(copies.join(pairs.select("digest").distinct(), "digest", "left_semi"), "digest")
    for c in ("pair", "left", "right"):
        rows = salted_join(rows, counts.select(F.col("key").alias(c), F.col("n").alias(f"n_{c}")), [c], spread="doc_id")
    others = {c: F.greatest(F.col(f"n_{c}") - F.col("copies") * F.col(f"own_{c}"), F.lit(0)).cast("double") for c in ("pair", "left", "right")}
    pmi = F.when(others["pair"] > 0, F.least(F.log(others["pair"] * F.lit(float(total)) / (others["left"] * others["right"])), F.lit(MOST))).otherwise(F.lit(UNSEEN))
    return rows.groupBy("doc_id", "words", "run", "run_words", "stuffed").agg((F.sum(pmi * F.col("n")) / F.sum("n")).alias("pmi"))


def keyword_documents(documents: DataFrame) -> DataFrame:
    """(doc_id, words, spam_words, pmi) of the spam documents.

    Null and empty texts are none; texts of fewer than five words are never judged; repeated rows give one row
    (the least, should texts differ); an empty table gives an empty result.
    """
    runs = judged_runs(documents).dropDuplicates(["doc_id", "words", "run"])
    flagged = runs.where(F.col("stuffed") | (F.col("pmi") < SALAD))
    docs = flagged.groupBy("doc_id", "words").agg(F.sum("run_words").cast("int").alias("spam_words"), F.min("pmi").alias("pmi"))
    return docs.where("2 * spam_words > words").groupBy("doc_id").agg(F.min(F.struct("words", "spam_words", "pmi")).alias("x")).select("doc_id", "x.words", "x.spam_words", "x.pmi")
