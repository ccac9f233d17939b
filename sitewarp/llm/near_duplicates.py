"""Near-duplicate records by b-bit MinHash.

Every text becomes a set of word shingles and ``BANDS * ROWS`` minima. Bands of full minima make
candidates; only the low ``BITS`` bits of the minima travel on, packed into bit planes, and the
similarity of a candidate pair is estimated from bit counts, corrected for chance collisions. Pairs
whose estimate is not clearly below the threshold are settled by their shingle sets.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sitewarp.llm.words import scramble, shingles, word_hashes, words
from sitewarp.operators.joins import salted_join
from sitewarp.session import cut_lineage

#: 64 bands of 4 minima: a pair of similarity 0.6 shares a band with probability 1 - (1 - 0.6**4)**64 > 0.9998.
BANDS, ROWS, BITS = 64, 4, 2
#: Estimates have a standard deviation under 0.04 with 256 minima of 2 bits: five of them below the threshold is "clearly".
SLACK = 0.2

_SEED = np.random.default_rng(20240229)
_A = _SEED.integers(1, 2**63, BANDS * ROWS, dtype=np.uint64) | np.uint64(1)
_B = _SEED.integers(0, 2**63, BANDS * ROWS, dtype=np.uint64)
_BLOCK = 4096
#: Texts of one band key that a task pairs with all others of the key.
SPREAD = 512

SIGNATURE = "id bigint, digest binary, bands array<bigint>, planes array<bigint>"


def minima(sets: np.ndarray) -> np.ndarray:
    """The least value of every hash function over a shingle set, long sets in blocks."""
    out = None
    for i in range(0, len(sets), _BLOCK):
        least = scramble(sets[i : i + _BLOCK, None] * _A + _B).min(axis=0)
        out = least if out is None else np.minimum(out, least)
    return out


def signature(sets: np.ndarray) -> tuple[bytes, np.ndarray, np.ndarray]:
    """(digest of the set, band keys, bit planes of the minima's low bits)."""
    least = minima(sets)
    bands = np.zeros(BANDS, dtype=np.uint64)
    for k in range(ROWS):
        bands = scramble((bands + least.reshape(BANDS, ROWS)[:, k]) * np.uint64(0xC2B2AE3D27D4EB4F))
    bands = scramble(bands + np.arange(BANDS, dtype=np.uint64))
    low = least & np.uint64((1 << BITS) - 1)
    planes = np.concatenate([np.packbits(((low >> np.uint64(b)) & np.uint64(1)).astype(np.uint8)).view(np.int64) for b in range(BITS)])
    return xxhash.xxh3_128_digest(sets.tobytes()), bands.view(np.int64), planes


def signatures(rows: DataFrame, key: str, text: str, size: int, least_words: int) -> DataFrame:
    """One signature per row with at least ``least_words`` words. Null, empty and shorter texts have none."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = []
            for key_, text_ in zip(batch["id"], batch["text"], strict=True):
                tokens = words(text_)
                if len(tokens) >= max(least_words, size):
                    out.append((key_, *signature(shingles(word_hashes(tokens), size))))
            yield pd.DataFrame(out, columns=["id", "digest", "bands", "planes"])

    return rows.select(F.col(key).alias("id"), F.col(text).alias("text")).where("id is not null and text is not null").mapInPandas(run, SIGNATURE)


def _shingle_sets(rows: DataFrame, key: str, text: str, size: int) -> DataFrame:
    @F.pandas_udf("array<bigint>")
    def sets(texts: pd.Series) -> pd.Series:
        return texts.map(lambda t: shingles(word_hashes(words(t)), size).view(np.int64))

    return rows.select(F.col(key).alias("id"), sets(text).alias("set"))


def estimated_similarity(a: str, b: str):
    """Collision-corrected Jaccard similarity from two columns of bit planes."""
    longs = BANDS * ROWS // 64
    differ = [" | ".join(f"({a}[{p * longs + i}] ^ {b}[{p * longs + i}])" for p in range(BITS)) for i in range(longs)]
    mismatches = " + ".join(f"bit_count({d})" for d in differ)
    chance = 2.0**-BITS
    return F.expr(f"(1 - ({mismatches}) / {BANDS * ROWS}.0D - {chance}D) / (1 - {chance}D)")


def copy_classes(signed: DataFrame) -> DataFrame:
    """(id, rep, n): the class of exact copies of each row, its least id and size. Repeated ids count once."""
    classes = signed.groupBy("digest").agg(F.min("id").alias("rep"), F.countDistinct("id").alias("n"))
    return signed.select("id", "digest").distinct().join(classes, "digest").select("id", "rep", "n")


def similar_representatives(rows: DataFrame, key: str, text: str, size: int, threshold: float, signed: DataFrame, classes: DataFrame) -> DataFrame:
    """(a, b, similarity), a < b: pairs of class representatives with a shingle similarity of at least ``threshold``."""
    reps = signed.join(classes.where("id = rep").select("id"), "id", "left_semi").dropDuplicates(["id"])
    # Only keys that two texts share make pairs; the texts of a key are spread over one task for every SPREAD of them.
    banded = reps.select("id", F.explode("bands").alias("band"))
    shared = banded.groupBy("band").agg(F.count("*").alias("n")).where("n > 1").select("band", F.ceil(F.col("n") / SPREAD).cast("int").alias("salts"))
    banded = banded.join(shared, "band")
    left = banded.select("band", F.pmod(F.xxhash64("id"), "salts").cast("int").alias("salt"), F.col("id").alias("a"))
    right = banded.select("band", F.explode(F.sequence(F.lit(0), F.col("salts") - 1)).alias("salt"), F.col("id").alias("b"))
    pairs = left.join(right, ["band", "salt"]).where("a < b").select("a", "b").distinct()
    planes = reps.select("id", "planes")
    near = pairs.join(planes.select(F.col("id").alias("a"), F.col("planes").alias("pa")), "a").join(planes.select(F.col("id").alias("b"), F.col("planes").alias("pb")), "b")
    near = cut_lineage(near.where(estimated_similarity("pa", "pb") >= threshold - SLACK).select("a", "b"))
    wanted = near.select(F.explode(F.array("a", "b")).alias(key)).distinct()
    sets = _shingle_sets(rows.where(f"`{text}` is not null").select(key, text).join(wanted, key, "left_semi").dropDuplicates([key]), key, text, size)
    both = near.join(sets.select(F.col("id").alias("a"), F.col("set").alias("sa")), "a").join(sets.select(F.col("id").alias("b"), F.col("set").alias("sb")), "b")
    shared = F.size(F.array_intersect("sa", "sb"))
    return both.withColumn("similarity", shared / (F.size("sa") + F.size("sb") - shared)).where(F.col("similarity") >= threshold).select("a", "b", "similarity")


def near_duplicates(rows: DataFrame, key: str, text: str, size: int = 5, threshold: float = 0.8, least_words: int = 1) -> tuple[DataFrame, DataFrame]:
    """(pairs between class representatives, membership of every row).

    ``pairs`` is (a, b, similarity), ``membership`` (id, rep, n): exact copies (equal shingle sets) are one class.
    Null or short texts take no part; ties and repeated rows collapse into one member; an empty table gives empty results.
    """
    signed = cut_lineage(signatures(rows, key, text, size, least_words))
    classes = copy_classes(signed)
    return similar_representatives(rows, key, text, size, threshold, signed, classes), classes


def expanded_pairs(pairs: DataFrame, classes: DataFrame, expand: int | None = None) -> DataFrame:
    """(a, b), a < b: every pair of members, within classes and across them.

    As many rows as there are such pairs: a class of n copies has n * (n - 1) / 2 of its own. Members of a class are spread over
    tasks. With ``expand``, classes of more copies are not written out: each copy is tied to its representative, which
    carries the class's links to other texts.
    """
    few = classes if expand is None else classes.where(f"n <= {expand} or id = rep")
    members = few.select("rep", "id")
    a, b = members.select(F.col("rep").alias("a"), F.col("id").alias("ia")), members.select(F.col("rep").alias("b"), F.col("id").alias("ib"))
    across = salted_join(pairs.join(a, "a"), b, ["b"], spread="ia", how="inner").select("ia", "ib")
    small = classes.where("n > 1" if expand is None else f"n > 1 and n <= {expand}").select("rep", "id")
    within = salted_join(small.withColumnRenamed("id", "ia"), small.withColumnRenamed("id", "ib"), ["rep"], spread="ia", how="inner").where("ia < ib").select("ia", "ib")
    out = across.unionByName(within)
    if expand is not None:
        out = out.unionByName(classes.where(f"n > {expand} and id <> rep").select(F.col("rep").alias("ia"), F.col("id").alias("ib")))
    return out.select(F.least("ia", "ib").alias("a"), F.greatest("ia", "ib").alias("b"))


def components(edges: DataFrame) -> DataFrame:
    """(id, group) of every id in ``edges`` (a, b): the least id that it is linked to over any number of edges.

    Large and small stars in turn until no edge changes, which takes about the logarithm of a component's size in rounds; every
    round is checkpointed. Links of a hub are spread over tasks and never gathered in one row. Repeated edges, loops and
    nulls are dropped.
    """
    out = cut_lineage(edges.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct())
    before = None
    while True:
        both = out.unionByName(out.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"))
        large = salted_join(both.where("v > u"), least, ["u"], spread="v").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = salted_join(large, least, ["u"], spread="v").select(F.explode(F.array(F.struct(F.col("v").alias("u"), F.col("m").alias("v")), F.struct("u", F.col("m").alias("v")))).alias("e")).select("e.u", "e.v").where("u <> v").distinct()
        out = cut_lineage(small)
        now = out.agg(F.count("*"), F.bit_xor(F.xxhash64("u", "v"))).first()
        if now == before:
            break
        before = now
    return out.select(F.col("u").alias("id"), F.col("v").alias("group")).unionByName(out.select(F.col("v").alias("id"), F.col("v").alias("group")).distinct())


def grouped(pairs: DataFrame, classes: DataFrame) -> DataFrame:
    """(id, rep, group, n_group): every row's class of copies, and the group of all rows linked to it through similar ones.
    A row similar to no other is a group of its own."""
    linked = components(pairs).withColumnRenamed("id", "rep")
    rows = salted_join(classes, linked, ["rep"], spread="id", how="left").select("id", "rep", F.coalesce("group", "rep").alias("group"))
    return salted_join(rows, rows.groupBy("group").agg(F.count("*").alias("n_group")), ["group"], spread="id")
