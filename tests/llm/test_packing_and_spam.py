"""Packing and keyword spam: exact properties, brute force and edge cases."""

import math
import random
from collections import Counter, defaultdict

import numpy as np
import pandas as pd
import pytest

from sitewarp.llm import keyword_spam, packing
from sitewarp.llm.token_counts import count_tokens, encoding

VOCABULARY = [f"word{i}" for i in range(300)]
FLAT = packing.Frequencies(np.empty(0, dtype=np.uint32), np.empty(0, dtype=np.float32), 1.0)


def test_assignment_is_exact(spark):
    rng = random.Random(2)
    texts = [" ".join(rng.choices(VOCABULARY, k=rng.randint(1, 300))) for _ in range(300)] + ["x y " * 6000, None, "", " ", "same", "same"]
    docs = spark.createDataFrame([(i, t, 1) for i, t in enumerate(texts)] + [(0, texts[0], 2)], "doc_id bigint, text string, piece int").repartition(2)
    rows = packing.packed(docs).collect()
    load, pieces = Counter(), defaultdict(list)
    for r in rows:
        load[r.container_id] += r.n_tokens
        pieces[r.doc_id].append((r.start_token, r.n_tokens))
    assert max(load.values()) <= packing.CAPACITY
    for i, t in enumerate(texts):
        n = count_tokens(t) if t else 0
        want = [(a, min(packing.CAPACITY, n - a)) for a in range(0, n, packing.CAPACITY)]
        assert sorted(pieces[i]) == sorted(want * (2 if i == 0 else 1))
    fill = packing.fill_report(packing.packed(docs)).first()
    assert fill.n_tokens == sum(load.values()) and fill.filled > 0.95
    assert packing.packed(docs.limit(0)).count() == 0


def _item(i, size, terms):
    return (i, 0, 0, size, len(terms), np.array(sorted(terms), dtype=np.uint32).tobytes(), np.ones(len(terms), dtype=np.uint32).tobytes())


def test_neighbours_follow_bm25():
    rng = random.Random(4)
    items = [_item(i, 100, rng.sample(range(60), rng.randint(3, 20))) for i in range(50)]
    idf = np.linspace(0.1, 3, 1000).astype(np.float32)
    mean = sum(x[4] for x in items) / 50
    shard = packing.Shard(items, packing.Frequencies(np.arange(1000, dtype=np.uint32), idf, 0.0), mean)
    shard.take(7)
    vectors = [set(np.frombuffer(x[5], dtype=np.uint32).tolist()) for x in items]
    score = {i: sum(float(idf[t]) * (packing.K1 + 1) / (1 + packing.K1 * (1 - packing.B + packing.B * len(v) / mean)) for t in v & vectors[7]) for i, v in enumerate(vectors) if i != 7 and v & vectors[7]}
    got = shard.neighbours(7).tolist()
    assert set(got) == set(score) and all(score[a] >= score[b] - 1e-4 for a, b in zip(got, got[1:], strict=False))


def test_closing_fills_best():
    rng = random.Random(6)
    for _ in range(50):
        items = [_item(i, rng.randint(1, 120), [1]) for i in range(rng.randint(1, 12))]
        shard = packing.Shard(items, FLAT, 1.0)
        gap, sizes = rng.randint(1, 150), [x[3] for x in items]
        sums = [s for s in sizes if s <= gap] + [a + b for i, a in enumerate(sizes) for b in sizes[:i] if a + b <= gap]
        assert sum(shard.closing(gap)) == max(sums, default=0)


def test_sizes_that_do_not_combine(monkeypatch):
    monkeypatch.setattr(packing, "SHARD", 8)
    shard = packing.Shard([_item(i, 1100, [1]) for i in range(8)], FLAT, 1.0)
    full, left = shard.pack(last=False)
    assert not full and sorted(x for w in shard.loose(left) for x in w) == list(range(8))


def test_neighbours_fill_the_last_gap():
    """Every seed gets the neighbour that shares its terms, however long the seed and whichever of its terms they share."""
    seeds = [_item(i, 1148, range(100 * i, 100 * i + 40)) for i in range(10)]
    texts = [_item(10 + i, 900, range(100 * (9 - i) + 30, 100 * (9 - i) + 50)) for i in range(10)]
    idf = np.ones(2000, dtype=np.float32)
    idf[[100 * i + k for i in range(10) for k in range(30)]] = 2
    shard = packing.Shard(seeds + texts, packing.Frequencies(np.arange(2000, dtype=np.uint32), idf, 1.0), 30.0)
    assert sorted(shard.pack(last=True)[0]) == [[i, 19 - i] for i in range(10)]


def test_open_windows_wait_for_later_texts(monkeypatch):
    """Texts of 1,100 tokens that lie together leave room for those of 948 tokens that follow shards later."""
    monkeypatch.setattr(packing, "SHARD", 64)
    rows = [(i, 1100 if i < 320 else 948, 1, np.array([i % 320], dtype=np.uint32).tobytes(), np.ones(1, dtype=np.uint32).tobytes()) for i in range(640)]
    batches = (pd.DataFrame(rows[i : i + 50], columns=["doc_id", "n_tokens", "n_words", "terms", "counts"]) for i in range(0, 640, 50))
    got = pd.concat(packing.filled(batches, FLAT, 1.0))
    load = got.groupby("container_id").n_tokens.sum()
    assert len(load) == 320 and (load == 2048).all() and sorted(got.doc_id) == list(range(640))


def test_token_counts():
    for t in ("", "Hello  world's 123", "Ünï 中文 👩‍🔧", "a" * 5000, " " * 3000 + "x"):
        assert count_tokens(t) == len(encoding().encode_ordinary(t)) and encoding().decode(encoding().encode_ordinary(t)) == t


PROSE = ["The lamp from {} holds {} litres and it is fine for all of us.", "We sold {} of the red lamps in {} before the winter came to the town.", "Nobody in {} would trade a kettle for {} chairs, as we know."]


def spam_corpus():
    rng = random.Random(9)
    places = [f"Place{i}" for i in range(40)]
    prose = [(i, " ".join(rng.choice(PROSE).format(rng.choice(places), rng.randint(2, 99)) for _ in range(12))) for i in range(200)]
    goods = ["lamp", "kettle", "chair", "sofa", "watch", "drone", "paint", "boots", "ladder", "loan", "curtain", "mattress"] + places
    spam = [(1000, "cheap lamp buy lamp cheap lamp deal lamp " * 20), (1001, "\n".join(f"https://{w}.example/buy-{w}" for w in goods)), (1002, "Tags: " + " | ".join(rng.choice(goods) for _ in range(120))), (1003, PROSE[0].format("x", 3) + "\n" + ", ".join(rng.choice(goods) for _ in range(90)))]
    honest = [(2000, prose[0][1] + "\nTags: lamp, kettle, chair"), (2001, "\n".join(f"Width: {rng.randint(1, 99)} cm" for _ in range(3)) + "\n" + prose[1][1]), (2002, None), (2003, ""), (2004, "lamp"), (2005, "\n".join([PROSE[1].format(5, "May")] * 30)), (2006, "\n".join(f"https://{p}.example/\n{prose[i][1][:160]}" for i, p in enumerate(places[:6])))]
    return prose + spam + honest + [spam[0]]


def test_keyword_documents(spark):
    corpus = spam_corpus()
    docs = spark.createDataFrame([(d, t, 1, "x") for d, t in corpus], "doc_id bigint, text string, words int, pair string")
    assert sorted(r.doc_id for r in keyword_spam.keyword_documents(docs).collect()) == [1000, 1001, 1002, 1003]
    assert keyword_spam.keyword_documents(docs.limit(0)).count() == 0
    # brute-force PMI of one run
    words, pairs = Counter(), Counter()
    for _, t in corpus:
        w = keyword_spam.tokens(t or "")
        words.update(w)
        pairs.update(zip(w, w[1:], strict=False))
    n, own = sum(words.values()), keyword_spam.tokens(dict(corpus)[1002])
    ow, op = Counter(own), Counter(zip(own, own[1:], strict=False))

    def pmi(a, b):
        both = pairs[a, b] - op[a, b]
        return min(keyword_spam.MOST, math.log(both * n / ((words[a] - ow[a]) * (words[b] - ow[b])))) if both > 0 else keyword_spam.UNSEEN

    run = next(t for t, _ in keyword_spam.loose_runs(dict(corpus)[1002])[1])
    want = sum(pmi(a, b) for a, b in zip(run, run[1:], strict=False)) / (len(run) - 1)
    assert keyword_spam.judged_runs(docs).where("doc_id = 1002").first().pmi == pytest.approx(want)


def test_document_frequencies(spark):
    texts = [" ".join(f"t{k}" for k in range(60) if i % (k + 1) == 0) for i in range(1, 241)]
    items = packing.measured(spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string").repartition(3))
    df = Counter(t for text in texts for t in set(text.split()))
    term = {t: (packing.word_hashes([t]) >> np.uint64(32)).astype(np.uint32) for t in df}
    for rare in (1e-5, 0.1):
        idf, mean = packing.document_frequencies(items, rare)
        assert mean == sum(len(t.split()) for t in texts) / 240
        for t, h in term.items():
            n = max(df[t], rare * 240)
            assert idf.of(h)[0] == pytest.approx(math.log1p((240 - n + 0.5) / (n + 0.5)), rel=1e-5)


def test_counts_of_wanted_keys(spark):
    corpus = spam_corpus()
    words, pairs = Counter(), Counter()
    for _, t in corpus:
        w = keyword_spam.tokens(t or "")
        words.update(w)
        pairs.update(zip(w, w[1:], strict=False))
    want = {0: sum(words.values())}
    for a, b in (("lamp", "kettle"), ("we", "sold"), ("of", "the"), ("nobody", "lamp")):
        x, y = keyword_spam._keys(keyword_spam.word_hashes([a, b]))
        want |= dict(zip((*x.view(np.int64).tolist(), *y.view(np.int64).tolist()), (words[a], words[b], pairs[a, b]), strict=True))
    wanted = spark.createDataFrame([(k,) for k in want], "key bigint")
    got = {r.key: r.n for r in keyword_spam.corpus_counts(spark.createDataFrame(corpus, "doc_id bigint, text string"), wanted).collect()}
    assert got == {k: n for k, n in want.items() if n}
