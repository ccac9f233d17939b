"""Lines repeated across the documents of one source, by compressed bitmaps.

A bitmap of documents is kept as its non-zero 64-bit words only: (word number, bits). Bits are OR-ed with
map-side combination, so a line on every document of the largest source still is a short list of words, spread
over reducers. The bitmaps of a line's variants are united, exact cardinalities are compared with
the thresholds, and a document's lines are deleted by looking the document up in the bitmaps of its block.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

LEAST_DOCUMENTS, LEAST_SHARE = 5, 0.3


def line_form(line: Column) -> Column:
    """The form under which lines are the same: outer spaces and tabs dropped, lower case, runs of spaces and
    tabs one space, runs of digits a single 0."""
    bare = F.lower(F.regexp_replace(line, r"^[ \t]+|[ \t]+\z", ""))
    return F.regexp_replace(F.regexp_replace(bare, r"[ \t]+", " "), "[0-9]+", "0")


def document_lines(pages: DataFrame, source: str = "site", key: str = "page_id", text: str = "text") -> DataFrame:
    """(source, doc, line_no, variant, form): the non-blank lines, as 64-bit hashes of the line as it stands and of its form."""
    lines = pages.where(F.col(source).isNotNull() & F.col(key).isNotNull()).select(F.col(source).alias("source"), F.col(key).alias("doc"), F.posexplode(F.split(text, "\n", -1)).alias("at", "line"))
    return lines.where(r"line rlike '[^ \\t]'").select("source", "doc", (F.col("at") + 1).alias("line_no"), F.xxhash64("line").alias("variant"), F.xxhash64(line_form(F.col("line"))).alias("form"))


def line_bitmaps(lines: DataFrame) -> DataFrame:
    """(source, form, word, bits): the united bitmaps of every line's variants."""
    bit = F.expr("shiftleft(1L, cast(doc & 63 as int))")
    word = F.expr("shiftright(doc, 6)")
    variants = lines.groupBy("source", "form", "variant", word.alias("word")).agg(F.bit_or(bit).alias("bits"))
    return variants.groupBy("source", "form", "word").agg(F.bit_or("bits").alias("bits"))


def repeated_bitmaps(pages: DataFrame, least: int = LEAST_DOCUMENTS, share: float = LEAST_SHARE, source: str = "site", key: str = "page_id", text: str = "text") -> DataFrame:
    """The bitmaps (source, form, word, bits) of the lines on at least ``least`` documents and ``share`` of the source's documents."""
    bitmaps = line_bitmaps(document_lines(pages, source, key, text))
    counts = bitmaps.groupBy("source", "form").agg(F.sum(F.bit_count("bits")).alias("n"))
    sizes = pages.where(F.col(source).isNotNull() & F.col(key).isNotNull()).groupBy(F.col(source).alias("source")).agg(F.countDistinct(key).alias("size"))
    hot = counts.where(F.col("n") >= least).join(sizes, "source").where(F.col("n") >= F.lit(share) * F.col("size")).select("source", "form")
    return bitmaps.join(hot, ["source", "form"], "left_semi")


def _looked_up(pages: DataFrame, least: int, share: float, source: str, key: str, text: str) -> DataFrame:
    """``pages`` with ``__forms``, the repeated lines whose bitmap has the page's bit.

    The lookup joins on (source, word): a word is 64 documents, so the block of a hot source is never large.
    A document has at most (its lines) repeated lines; the sum over a source is bounded by its mean lines / share.
    """
    blocks = repeated_bitmaps(pages, least, share, source, key, text).groupBy("source", "word").agg(F.collect_list(F.struct("form", "bits")).alias("maps"))
    rows = pages.select(F.col(source).alias("source"), F.col(key).alias("doc"), F.col(text).alias("text"), F.expr(f"shiftright(`{key}`, 6)").alias("word"))
    hits = F.transform(F.filter("maps", lambda m: F.expr("shiftleft(1L, cast(doc & 63 as int))").bitwiseAND(m["bits"]) != 0), lambda m: m["form"])
    return rows.join(blocks, ["source", "word"], "left").select("source", "doc", "text", hits.alias("__forms"))


def repeated_lines(pages: DataFrame, least: int = LEAST_DOCUMENTS, share: float = LEAST_SHARE, source: str = "site", key: str = "page_id", text: str = "text") -> DataFrame:
    """(key, line_no) of every repeated line, numbered from 1. A null text has no lines; repeated rows count once."""
    found = _looked_up(pages, least, share, source, key, text).where("__forms is not null and size(__forms) > 0")
    lines = found.select(F.col("doc").alias(key), "__forms", F.posexplode(F.split("text", "\n", -1)).alias("at", "line")).where(r"line rlike '[^ \\t]'")
    return lines.where(F.array_contains("__forms", F.xxhash64(line_form(F.col("line"))))).select(key, (F.col("at") + 1).alias("line_no")).distinct()


def without_repeated_lines(pages: DataFrame, least: int = LEAST_DOCUMENTS, share: float = LEAST_SHARE, source: str = "site", key: str = "page_id", text: str = "text") -> DataFrame:
    """(key, text): every row's text without its repeated lines. Null stays null; a null source repeats nothing."""
    rows = _looked_up(pages, least, share, source, key, text)
    kept = F.array_join(F.filter(F.split("text", "\n", -1), lambda line: ~(line.rlike(r"[^ \t]") & F.array_contains("__forms", F.xxhash64(line_form(line))))), "\n")
    return rows.select(F.col("doc").alias(key), F.when(F.col("__forms").isNull(), F.col("text")).otherwise(kept).alias("text"))
