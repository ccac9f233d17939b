"""The older, flat rule set: one aggregated row per site, one condition per rule."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sitewarp.plans.catalogue import Check

#: (fact, condition over the page facts that is counted per site)
COUNTED = (
    ("n_ok", "status = 200"), ("n_error", "status >= 400"), ("n_noindex", "noindex"), ("n_insecure", "insecure"), ("n_canonical", "has_canonical"), ("n_data", "n_types > 0"), ("n_invalid", "n_parse_errors > 0"),
    ("n_untitled", "title_length = 0"), ("n_described", "has_description"), ("n_graph", "has_graph"), ("n_no_h1", "n_h1 = 0"), ("n_many_h1", "n_h1 > 1"), ("n_title_band", "title_length > 0 AND (title_length < 10 OR title_length > 65)"), ("n_gap", "has_gap"),
    ("n_undated", "page_type = 'article' AND n_dates = 0"), ("n_articles", "page_type = 'article'"), ("n_thin", "main_words < 80"), ("n_invisible", "n_invisible >= 5"), ("n_no_viewport", "NOT has_viewport"), ("n_heavy", "bytes > 2000000"), ("n_sparse", "n_internal < 5"), ("n_contact", "has_contact"),
)
CHECKS = (
    Check("v1.access.noindex", "Pages ask not to be indexed", "high", "confirmed", "site", "n_noindex > 0", "n_noindex"),
    Check("v1.access.error_statuses", "Pages answer with errors", "high", "confirmed", "site", "n_error > 0", "n_error"),
    Check("v1.access.no_canonical", "No page names its canonical address", "low", "confirmed", "site", "n_canonical = 0", "n_pages"),
    Check("v1.access.insecure", "Pages are served without encryption", "high", "confirmed", "site", "n_insecure > 0", "n_insecure"),
    Check("v1.data.none", "No structured data", "high", "confirmed", "site", "n_data = 0", "n_pages"),
    Check("v1.data.partial", "Structured data on some pages only", "medium", "confirmed", "site", "n_data > 0 AND n_data < n_pages", "n_data"),
    Check("v1.data.invalid", "Structured data does not parse", "high", "confirmed", "site", "n_invalid > 0", "n_invalid"),
    Check("v1.data.missing_title", "Pages without title", "high", "confirmed", "site", "n_untitled > 0", "n_untitled"),
    Check("v1.data.no_descriptions", "No page has a description", "medium", "confirmed", "site", "n_described = 0", "n_pages"),
    Check("v1.data.no_open_graph", "No page has Open Graph data", "low", "confirmed", "site", "n_graph = 0", "n_pages"),
    Check("v1.data.no_h1", "Pages without first headline", "medium", "confirmed", "site", "n_no_h1 > 0", "n_no_h1"),
    Check("v1.data.multiple_h1", "Pages with several first headlines", "low", "confirmed", "site", "n_many_h1 > 0", "n_many_h1"),
    Check("v1.data.title_length", "Titles too short or too long", "low", "confirmed", "site", "n_title_band > 0", "n_title_band"),
    Check("v1.data.heading_gap", "Heading levels left out", "low", "confirmed", "site", "n_gap > 0", "n_gap"),
    Check("v1.data.duplicate_titles", "Pages share a title", "medium", "confirmed", "site", "n_pages >= 3 AND n_same_title > 0", "n_same_title"),
    Check("v1.data.duplicate_descriptions", "Pages share a description", "low", "confirmed", "site", "n_pages >= 3 AND n_same_description > 0", "n_same_description"),
    Check("v1.freshness.undated_articles", "No article has a date", "medium", "likely", "site", "n_articles > 0 AND n_undated = n_articles", "n_articles"),
    Check("v1.answers.thin_pages", "Thin pages", "medium", "confirmed", "site", "n_thin > 0", "n_thin"),
    Check("v1.answers.no_contact", "No way to get in touch", "low", "likely", "site", "n_contact = 0", "n_pages"),
    Check("v1.integrity.zero_width", "Invisible characters", "medium", "confirmed", "site", "n_invisible > 0", "n_invisible"),
    Check("v1.engagement.no_viewport", "Pages without viewport", "medium", "confirmed", "site", "n_no_viewport > 0", "n_no_viewport"),
    Check("v1.engagement.heavy", "Heavy pages", "medium", "confirmed", "site", "n_heavy > 0", "n_heavy"),
    Check("v1.engagement.sparse_navigation", "Most pages have few links", "low", "likely", "site", "2 * n_sparse > n_pages", "n_sparse"),
)


def site_counts(facts: DataFrame, page: DataFrame) -> DataFrame:
    """One row of counts per site: one shuffle of partial counts, and two of grouped texts for the repeated ones."""
    rows = facts.groupBy("site").agg(F.count("*").alias("n_pages"), *(F.count_if(F.expr(c)).alias(n) for n, c in COUNTED))

    def repeated(column, name):
        text = page.where(F.trim(column) != "").groupBy("site", F.lower(F.trim(column)).alias("t")).agg(F.count("*").alias("n")).where("n > 1")
        return text.groupBy("site").agg(F.sum("n").alias(name))

    return rows.join(repeated(F.col("title"), "n_same_title"), "site", "left").join(repeated(F.col("meta_description"), "n_same_description"), "site", "left").fillna(0, ["n_same_title", "n_same_description"])
