"""What a page says about itself: names, facts, calls to action, informative images, windows that stand alone."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sitewarp.functions import text as T

# Separators of title parts, words that carry no fact, file names of decorations.
TITLE_PARTS = r" [|\-–—·:] "
STOP_WORDS = "the a an and or of to in on at by for with from is are was were be it its this that we you our your how what why who all".split()
DECORATIONS = r"(?i)(spacer|pixel|blank|icon|logo|sprite|divider|arrow|bullet|avatar|placeholder|tracking)"


def title_parts(title: Column) -> Column:
    return F.filter(F.transform(F.split(title, TITLE_PARTS), F.trim), lambda p: p != "")


def site_brands(page: DataFrame) -> DataFrame:
    """(site, brand, n_pages): the title part that most of a site's pages share, the shortest and then the first by name of equals.
    Titles of one part name no brand. Counted per part before the ranks, so a large site is a short list of parts."""
    parts = page.where("title is not null").select("site", "page_id", title_parts(F.col("title")).alias("p")).where("size(p) > 1")
    counted = parts.select("site", "page_id", F.explode(F.array_distinct("p")).alias("part")).groupBy("site", "part").agg(F.count_distinct("page_id").alias("n_pages"))
    best = F.row_number().over(Window.partitionBy("site").orderBy(F.desc("n_pages"), F.length("part"), "part"))
    return counted.withColumn("r", best).where("r = 1").select("site", F.col("part").alias("brand"), "n_pages")


def content_words(text: Column) -> Column:
    """Distinct lower-case tokens that are no stop words."""
    return F.array_except(F.array_distinct(F.transform(T.tokens(text), F.lower)), F.array(*map(F.lit, STOP_WORDS)))


def statements(most: int = 12) -> Column:
    """What a page row says about itself, from title parts, first headlines, second headlines and the description, in that order;
    eight characters and three content words at least, each once, the first ``most``."""
    heads = lambda level, n: F.slice(F.transform(F.filter(F.coalesce("headings", F.array().cast("array<struct<level:int,text:string,pos:int>>")), lambda h: h["level"] == level), lambda h: h["text"]), 1, n)
    said = F.concat(F.coalesce(title_parts(F.col("title")), F.array().cast("array<string>")), heads(1, 2), heads(2, 4), F.array("meta_description"))
    fit = F.filter(said, lambda x: x.isNotNull() & (F.length(x) >= 8) & (F.size(content_words(x)) >= 3))
    lowered = F.transform(fit, F.lower)
    once = F.filter(F.transform(fit, lambda x, i: F.when(F.array_position(lowered, F.lower(x)) == i + 1, x)), lambda x: x.isNotNull())
    return F.slice(once, 1, most)


def page_facts(page: DataFrame, most: int = 12) -> DataFrame:
    """(page_id, place, fact) of every page row's statements."""
    return page.select("page_id", F.posexplode(statements(most)).alias("place", "fact"))


def supported_facts(page: DataFrame, target: int = 300, share: float = 0.6) -> DataFrame:
    """(page_id, place, support, supported): the best share of a fact's content words that one window of the main text carries.
    Facts and windows stand in one row, so nothing is joined."""
    rows = page.select("page_id", statements().alias("facts"), F.transform(T.greedy_windows(F.col("main_text"), target), content_words).alias("windows"))
    facts = rows.select("page_id", "windows", F.posexplode(F.transform("facts", content_words)).alias("place", "words"))
    best = F.array_max(F.transform("windows", lambda w: F.size(F.array_intersect("words", w)) / F.size("words")))
    return facts.select("page_id", "place", F.round(F.coalesce(best, F.lit(0.0)), 4).alias("support")).withColumn("supported", F.col("support") >= share)


def self_contained(window: Column, name: Column | None = None) -> Column:
    """Why a window does not stand alone: empty, opener, back_reference, unnamed; null if it does."""
    bare = F.trim(F.coalesce(window, F.lit("")))
    reason = F.when(bare == "", F.lit("empty")).when(T.matches(bare, "pronoun_opener"), F.lit("opener")).when(T.matches(bare, "back_reference"), F.lit("back_reference"))
    if name is None:
        return reason
    distinctive = F.filter(content_words(name), lambda w: F.length(w) > 3)
    named = F.exists(distinctive, lambda w: F.contains(F.lower(bare), w)) | (F.size(distinctive) == 0)
    return reason.when(~F.coalesce(named, F.lit(True)), F.lit("unnamed"))


def calls_to_action(parsed: DataFrame, keys: list[str]) -> DataFrame:
    """``keys``, place, label: anchors of at most 60 characters that name an action, those in the main part first, those in the
    chrome last, then by label."""
    hits = F.filter("anchors", lambda a: (F.length(a["text"]) <= 60) & T.matches(a["text"], "action_verb"))
    order = F.array_sort(F.transform(hits, lambda a: F.struct((~a["in_main"]).alias("outside"), a["in_chrome"].alias("chrome"), a["text"].alias("label"))))
    return parsed.select(*keys, F.posexplode(F.array_distinct(F.transform(order, lambda x: x["label"]))).alias("place", "label"))


def informative_images(images: Column) -> Column:
    """Images that tell something: in the main part, no decoration by role, name or size."""
    small = lambda x: (F.coalesce(x["width"], F.lit(100)) < 100) | (F.coalesce(x["height"], F.lit(100)) < 100)
    return F.filter(images, lambda x: x["in_main"] & ~x["in_chrome"] & ~F.coalesce(F.lower(x["role"]).isin("presentation", "none"), F.lit(False)) & ~F.coalesce(x["src"].rlike(DECORATIONS), F.lit(False)) & ~small(x))


def missing_alternatives(parsed: DataFrame, keys: list[str]) -> DataFrame:
    """``keys``, n_images, n_missing: informative images and those without a text alternative."""
    told = informative_images(F.col("images"))
    return parsed.select(*keys, F.size(told).cast("bigint").alias("n_images"), F.size(F.filter(told, lambda x: F.coalesce(F.trim(x["alt"]), F.lit("")) == "")).cast("bigint").alias("n_missing"))
