"""Queries over page and document texts: patterns, dates, counts, windows and facts, with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from sitewarp.functions import text as T
from sitewarp.operators.joins import salted_join
from sitewarp.session import spread, table

FLAGS = ("price", "phone", "email", "postal_code", "opening_hours", "byline", "trial", "cart", "street_address", "injection", "statistic", "quotation", "citation", "definition", "pronoun_opener", "back_reference", "audience_hint", "action_verb", "social_proof", "free_offer", "volatile", "superlative", "question_words", "iso_date", "text_date", "copyright_year", "script_notice")
MARKUP = ("hidden_css", "viewport_meta", "autoplay", "mount_root", "injection")


def text_patterns(spark: SparkSession, d: str) -> DataFrame:
    return spread(table(spark, d, "documents")).where("text is not null").select("doc_id", *(T.matches(F.col("text"), n).alias(n) for n in FLAGS))


def page_patterns(spark: SparkSession, d: str) -> DataFrame:
    body = F.coalesce(F.nullif("main_text", F.lit("")), F.nullif("text", F.lit("")), F.lit(""))
    return spread(table(spark, d, "page")).select("page_id", *(T.occurrences(body, n).alias(n) for n in ("price", "superlative", "statistic", "citation", "volatile")), T.matches(F.trim("title"), "generic_title").alias("generic_title"))


def markup_patterns(spark: SparkSession, d: str) -> DataFrame:
    rows = spread(table(spark, d, "page_raw")).where("html is not null").select("fetch_id", "html").dropDuplicates(["fetch_id"])
    return rows.select("fetch_id", *(T.occurrences(F.col("html"), n).alias(n) for n in MARKUP))


def word_counts(spark: SparkSession, d: str) -> DataFrame:
    p = table(spark, d, "page").select("page_id", T.word_count(F.col("text")).alias("words"), T.word_count(F.col("main_text")).alias("main_words"))
    return p.withColumn("boilerplate", F.round(T.boilerplate_ratio(F.col("main_words"), F.col("words")), 6))


def token_counts(spark: SparkSession, d: str) -> DataFrame:
    t = T.tokens(F.col("text"))
    return table(spark, d, "documents").where("text is not null").select("doc_id", F.size(t).cast("bigint").alias("n_tokens"), F.size(F.array_distinct(F.transform(t, F.lower))).cast("bigint").alias("n_distinct"))


def sentence_counts(spark: SparkSession, d: str) -> DataFrame:
    s = T.sentences(F.col("text"))
    return table(spark, d, "documents").where("text is not null").select("doc_id", F.size(s).cast("bigint").alias("n_sentences"), F.coalesce(F.array_max(F.transform(s, F.length)), F.lit(0)).cast("bigint").alias("longest"))


def invisible_characters(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "page").select("page_id", T.invisible_count(F.col("text")).alias("n")).where("n > 0")


def parsed_dates(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "sitemap_entry").where("lastmod is not null and lastmod <> ''").select("entry_id", T.any_date(F.col("lastmod")).alias("day"))


def date_spread(spark: SparkSession, d: str) -> DataFrame:
    """Pages with two or more known dates, and the days between the first and the last."""
    days = [T.any_date(F.col(f"dates.{c}")).alias(c) for c in ("http_last_modified", "sitemap_lastmod", "schema_published", "schema_modified", "visible")]
    rows = table(spark, d, "page").select("page_id", F.array_compact(F.array(*days)).alias("days")).where("size(days) >= 2")
    return rows.select("page_id", F.size("days").cast("bigint").alias("n_dates"), F.datediff(F.array_max("days"), F.array_min("days")).cast("bigint").alias("spread"))


def title_groups(spark: SparkSession, d: str) -> DataFrame:
    """Titles that several pages of a site share, and the least page of each."""
    rows = table(spark, d, "page").where("title is not null and trim(title) <> ''")
    return rows.groupBy("site", F.lower(F.trim("title")).alias("name")).agg(F.count("*").alias("n_pages"), F.min("page_id").alias("first_page")).where("n_pages > 1")


def heading_skips(spark: SparkSession, d: str) -> DataFrame:
    """Headings that stand more than one level below the one before them, in document order."""
    h = table(spark, d, "page").select("page_id", F.explode("headings").alias("h")).select("page_id", "h.level", "h.pos")
    before = F.lag("level").over(Window.partitionBy("page_id").orderBy("pos"))
    return h.withColumn("before", before).where("level - before > 1").select("page_id", "pos", "before", "level")


def heading_levels(spark: SparkSession, d: str) -> DataFrame:
    """Per page: headings, first-level headings, and whether a level is left out between two that occur."""
    levels = F.array_sort(F.array_distinct(F.transform(F.coalesce("headings", F.array().cast("array<struct<level:int,text:string,pos:int>>")), lambda h: h["level"])))
    gap = F.exists(F.zip_with(levels, F.slice(levels, F.lit(2), F.size(levels)), lambda a, b: b - a > 1), lambda x: x)
    n = F.size(F.coalesce("headings", F.array().cast("array<struct<level:int,text:string,pos:int>>"))).cast("bigint")
    return table(spark, d, "page").select("page_id", n.alias("n_headings"), F.coalesce(F.size(F.filter("headings", lambda h: h["level"] == 1)), F.lit(0)).cast("bigint").alias("n_h1"), F.coalesce(gap, F.lit(False)).alias("has_gap"))


def form_fields(spark: SparkSession, d: str) -> DataFrame:
    f = table(spark, d, "page").select("page_id", F.posexplode("forms").alias("form_no", "form")).where("form is not null")
    return f.select("page_id", "form_no", F.upper("form.method").alias("method"), F.size("form.fields").cast("bigint").alias("n_fields"), F.size(F.filter("form.fields", lambda x: ~x["labelled"])).cast("bigint").alias("n_unlabelled"), F.size(F.filter("form.fields", lambda x: x["required"])).cast("bigint").alias("n_required"))


def chunk_windows(spark: SparkSession, d: str) -> DataFrame:
    w = T.greedy_windows(F.col("text"), 60, 0.15)
    return spread(table(spark, d, "documents")).where("text is not null").select("doc_id", F.posexplode(w).alias("window_no", "window")).select("doc_id", "window_no", F.size(T.tokens(F.col("window"))).cast("bigint").alias("n_tokens"))


def headline_support(spark: SparkSession, d: str) -> DataFrame:
    """Pages whose first headline is a fact (three content words or more) and the best share of its words that one window of
    the main text carries; 0.6 and more is support."""
    words = lambda c: F.array_distinct(F.filter(F.transform(T.tokens(c), F.lower), lambda w: F.length(w) > 3))
    head = F.get(F.filter("headings", lambda h: h["level"] == 1), F.lit(0))["text"]
    rows = spread(table(spark, d, "page")).where("main_text is not null").select("page_id", words(head).alias("fact"), T.greedy_windows(F.col("main_text"), 60, 0.15).alias("windows")).where("size(fact) >= 3")
    share = F.array_max(F.transform("windows", lambda w: F.size(F.array_intersect("fact", words(w))) / F.size("fact")))
    return rows.select("page_id", F.round(F.coalesce(share, F.lit(0.0)), 4).alias("support")).withColumn("supported", F.col("support") >= 0.6)


def contact_facts(spark: SparkSession, d: str) -> DataFrame:
    """Distinct phone numbers per site: digits of lines that begin with Tel, with the number of pages and the first of them."""
    lines = table(spark, d, "page").select("site", "page_id", F.explode(F.split("text", "\n")).alias("line")).where(r"line rlike '^Tel\\. '")
    found = lines.select("site", "page_id", F.regexp_replace("line", "[^0-9]", "").alias("digits")).distinct()
    return found.groupBy("site", "digits").agg(F.count("*").alias("n_pages"), F.min("page_id").alias("first_page"))


def word_gap(spark: SparkSession, d: str) -> DataFrame:
    """Share of the distinct words of four letters or more in a page's text that its main text lacks."""
    words = lambda c: F.array_distinct(F.regexp_extract_all(F.lower(F.coalesce(c, F.lit(""))), F.lit("[a-z]{4,}"), F.lit(0)))
    rows = table(spark, d, "page").select("page_id", words(F.col("text")).alias("a"), words(F.col("main_text")).alias("b")).where("size(a) > 0")
    return rows.select("page_id", F.size("a").cast("bigint").alias("n_words"), F.round(F.size(F.array_except("a", "b")) / F.size("a"), 6).alias("missing"))


def titles_of_documents(spark: SparkSession, d: str) -> DataFrame:
    """Documents whose title is the headline of a page, with the number of such pages."""
    heads = table(spark, d, "page").select(F.explode("headings").alias("h")).where("h.level = 1").groupBy(F.lower(F.trim("h.text")).alias("name")).agg(F.count("*").alias("n_pages"))
    docs = table(spark, d, "documents").where("title is not null").select("doc_id", F.lower(F.trim("title")).alias("name"))
    return salted_join(docs, heads, ["name"], spread="doc_id").select("doc_id", "n_pages")


QUERIES = {f.__name__: f for f in (text_patterns, page_patterns, markup_patterns, word_counts, token_counts, sentence_counts, invisible_characters, parsed_dates, date_spread, title_groups, heading_skips, heading_levels, form_fields, chunk_windows, headline_support, contact_facts, word_gap, titles_of_documents)}


def _match(column: str, name: str) -> str:
    pattern = T.PATTERNS[name].replace("'", "''")
    return f"coalesce(regexp_matches({column}, '{pattern}'{'' if name in T.CASED else ", 'i'"}), false)"


def _count(column: str, name: str) -> str:
    pattern = T.PATTERNS[name].replace("'", "''")
    return f"coalesce(len(regexp_extract_all({column}, '{'' if name in T.CASED else '(?i)'}{pattern}')), 0)"


_BODY = "coalesce(nullif(main_text, ''), nullif(text, ''), '')"
_WORDS = "coalesce(len(regexp_extract_all({}, '[^ \\t\\r\\n]+')), 0)"
_TOKENS = "regexp_extract_all({}, '[A-Za-z0-9][A-Za-z0-9''’\\-]*')"
_SENTENCES = "list_filter(list_transform(string_split(regexp_replace({}, '([.!?])[ \\t\\r\\n]+', '\\1' || chr(1), 'g'), chr(1)), lambda s: regexp_replace(s, '^[ \\t\\r\\n]+|[ \\t\\r\\n]+$', '', 'g')), lambda s: s <> '')"


def _date(x: str) -> str:
    bare = f"trim(regexp_replace(regexp_replace({x}, '^[A-Za-z]{{3}}, *', ''), '[T ][0-9]{{1,2}}:[0-9]{{2}}.*$', ''))"
    forms = ("%Y-%m-%d", "%d %B %Y", "%B %d, %Y", "%d %b %Y", "%m/%d/%Y", "%d.%m.%Y", "%Y/%m/%d")
    return "coalesce(" + ", ".join(f"try_strptime({bare}, '{f}')" for f in forms) + ")::DATE"


_DAYS = "list_filter([" + ", ".join(_date(f"dates.{c}") for c in ("http_last_modified", "sitemap_lastmod", "schema_published", "schema_modified", "visible")) + "], lambda x: x IS NOT NULL)"
_LEVELS = "list_sort(list_distinct(list_transform(coalesce(headings, []), lambda h: h.level)))"
_INVISIBLE = "length(text) - length(translate(text, " + " || ".join(f"chr({ord(c)})" for c in T.INVISIBLE) + ", ''))"

SQL = {
    "text_patterns": "SELECT doc_id, " + ", ".join(f"{_match('text', n)} AS {n}" for n in FLAGS) + " FROM documents WHERE text IS NOT NULL",
    "page_patterns": "SELECT page_id, " + ", ".join(f"{_count(_BODY, n)} AS {n}" for n in ("price", "superlative", "statistic", "citation", "volatile")) + f", {_match('trim(title)', 'generic_title')} AS generic_title FROM page",
    "markup_patterns": "SELECT fetch_id, " + ", ".join(f"{_count('html', n)} AS {n}" for n in MARKUP) + " FROM (SELECT DISTINCT ON (fetch_id) * FROM page_raw WHERE html IS NOT NULL)",
    "word_counts": f"SELECT page_id, {_WORDS.format('text')} AS words, {_WORDS.format('main_text')} AS main_words, round(CASE WHEN {_WORDS.format('text')} > 0 THEN 1 - {_WORDS.format('main_text')}::DOUBLE / {_WORDS.format('text')} ELSE 0 END, 6) AS boilerplate FROM page",
    "token_counts": f"SELECT doc_id, len({_TOKENS.format('text')}) AS n_tokens, len(list_distinct(list_transform({_TOKENS.format('text')}, lambda t: lower(t)))) AS n_distinct FROM documents WHERE text IS NOT NULL",
    "sentence_counts": f"SELECT doc_id, len({_SENTENCES.format('text')}) AS n_sentences, coalesce(list_max(list_transform({_SENTENCES.format('text')}, lambda s: length(s))), 0) AS longest FROM documents WHERE text IS NOT NULL",
    "invisible_characters": f"SELECT page_id, {_INVISIBLE} AS n FROM page WHERE {_INVISIBLE} > 0",
    "parsed_dates": f"SELECT entry_id, {_date('lastmod')} AS day FROM sitemap_entry WHERE lastmod IS NOT NULL AND lastmod <> ''",
    "date_spread": f"SELECT page_id, len({_DAYS}) AS n_dates, date_diff('day', list_min({_DAYS}), list_max({_DAYS})) AS spread FROM page WHERE len({_DAYS}) >= 2",
    "title_groups": "SELECT site, lower(trim(title)) AS name, count(*) AS n_pages, min(page_id) AS first_page FROM page WHERE title IS NOT NULL AND trim(title) <> '' GROUP BY 1, 2 HAVING count(*) > 1",
    "heading_skips": "SELECT page_id, pos, before, level FROM (SELECT page_id, h.pos AS pos, h.level AS level, lag(h.level) OVER (PARTITION BY page_id ORDER BY h.pos) AS before FROM (SELECT page_id, unnest(headings) AS h FROM page)) WHERE level - before > 1",
    "heading_levels": f"SELECT page_id, len(coalesce(headings, [])) AS n_headings, len(list_filter(coalesce(headings, []), lambda h: h.level = 1)) AS n_h1, len(list_filter(range(1, len({_LEVELS})), lambda i: {_LEVELS}[i + 1] - {_LEVELS}[i] > 1)) > 0 AS has_gap FROM page",
    "form_fields": "SELECT page_id, (i - 1)::INT AS form_no, upper(f.method) AS method, len(f.fields) AS n_fields, len(list_filter(f.fields, lambda x: NOT x.labelled)) AS n_unlabelled, len(list_filter(f.fields, lambda x: x.required)) AS n_required FROM (SELECT page_id, unnest(forms) AS f, generate_subscripts(forms, 1) AS i FROM page) WHERE f IS NOT NULL",
    "contact_facts": "SELECT site, digits, count(*) AS n_pages, min(page_id) AS first_page FROM (SELECT DISTINCT site, page_id, regexp_replace(l, '[^0-9]', '', 'g') AS digits FROM (SELECT site, page_id, unnest(string_split(text, chr(10))) AS l FROM page) WHERE regexp_matches(l, '^Tel\\. ')) GROUP BY 1, 2",
    "word_gap": "SELECT page_id, len(a) AS n_words, round(len(list_filter(a, lambda x: NOT list_contains(b, x)))::DOUBLE / len(a), 6) AS missing FROM (SELECT page_id, list_distinct(regexp_extract_all(lower(coalesce(text, '')), '[a-z]{4,}')) AS a, list_distinct(regexp_extract_all(lower(coalesce(main_text, '')), '[a-z]{4,}')) AS b FROM page) WHERE len(a) > 0",
    "titles_of_documents": "SELECT doc_id, n_pages FROM (SELECT doc_id, lower(trim(title)) AS name FROM documents WHERE title IS NOT NULL) JOIN (SELECT lower(trim(h.text)) AS name, count(*) AS n_pages FROM (SELECT unnest(headings) AS h FROM page) WHERE h.level = 1 GROUP BY 1) USING (name)",
}
