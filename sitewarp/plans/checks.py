"""Rules over pages and sites as data: one wide row of facts per page and one per site, all rules evaluated on it at once.

A rule's condition is an SQL expression over the facts, so the catalogue is a table and adding a rule adds no scan, join or
branch to the plan. Conditions keep to comparisons that every engine reads alike.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sitewarp.functions import text as T
from sitewarp.functions import urls as U
from sitewarp.operators import crawling, links, profile, robots
from sitewarp.plans import deep_checks, parsed_checks
from sitewarp.plans.catalogue import Check, fired
from sitewarp.session import cut_lineage


LISTS = "('home', 'product', 'contact', 'category', 'utility')"
PAGE_CHECKS = (
    Check("reach.index.noindex_on_content", "Content page asks not to be indexed", "critical", "confirmed", "url", "noindex AND page_type <> 'utility'", "status", "low"),
    Check("reach.http.error_status", "Page answers with an error", "high", "confirmed", "url", "status >= 400", "status"),
    Check("reach.http.insecure_scheme", "Page is served without encryption", "high", "confirmed", "url", "insecure", "status"),
    Check("extract.sd.invalid_syntax", "Structured data does not parse", "high", "confirmed", "url", "n_parse_errors > 0", "n_parse_errors", "low"),
    Check("extract.sd.absent_on_eligible_page", "No structured data", "high", "confirmed", "url", "status = 200 AND n_types = 0 AND words >= 200 AND page_type <> 'utility'", "words"),
    Check("extract.ans.title_not_entity_bearing", "Title says nothing", "medium", "confirmed", "url", "status = 200 AND page_type <> 'utility' AND (title_length < 15 OR generic_title)", "title_length", "low"),
    Check("extract.ans.heading_structure_unusable", "Headings do not structure the page", "low", "confirmed", "url", "status = 200 AND page_type <> 'utility' AND (n_h1 = 0 OR has_gap OR (words > 800 AND n_h2 = 0))", "n_headings"),
    Check("extract.ans.boilerplate_dominant", "Page is mostly boilerplate", "medium", "likely", "url", "status = 200 AND boilerplate > boilerplate_limit AND words >= 300 AND page_type NOT IN ('home', 'category')", "words"),
    Check("extract.ans.thin_content_for_page_type", "Thin content for its kind of page", "medium", "confirmed", "url", "status = 200 AND main_words > 0 AND main_words < thin_limit AND page_type NOT IN ('category') AND n_in_main < 15", "main_words"),
    Check("extract.ans.no_evidence_markers", "Long text without evidence", "low", "confirmed", "url", f"status = 200 AND main_words >= evidence_words AND n_evidence = 0 AND page_type NOT IN {LISTS}", "main_words"),
    Check("trust.date.absent_on_dated_content", "No date on dated content", "medium", "confirmed", "url", "status = 200 AND page_type IN ('article', 'docs') AND n_dates = 0", "n_dates", "low"),
    Check("trust.date.signals_disagree", "Date signals disagree", "medium", "confirmed", "url", "n_dates >= 2 AND date_spread > 2", "date_spread", "low"),
    Check("trust.integrity.invisible_unicode", "Invisible characters in the text", "medium", "confirmed", "url", "n_invisible >= 5", "n_invisible", "low"),
    Check("act.orient.no_wayfinding", "No way up from a deep page", "medium", "likely", "url", "status = 200 AND depth >= 2 AND NOT links_up AND page_type NOT IN ('home', 'utility')", "depth"),
    Check("act.form.field_count_excessive", "Form asks for much", "medium", "confirmed", "url", "most_fields > fields_limit AND page_type <> 'utility'", "most_fields"),
    Check("act.form.unlabelled_inputs", "Form fields without labels", "medium", "confirmed", "url", "n_unlabelled > 0", "n_unlabelled", "low"),
    Check("act.context.no_onward_path", "Content leads nowhere", "medium", "confirmed", "url", "status = 200 AND page_type IN ('article', 'docs', 'product', 'other') AND n_in_main < 3 AND words >= 80", "n_in_main"),
    Check("act.blocker.not_mobile_ready", "No viewport declared", "high", "confirmed", "url", "status = 200 AND NOT has_viewport", "status", "low"),
)
SITE_CHECKS = (
    Check("reach.robots.blanket_disallow", "Crawl rules shut everyone out", "critical", "confirmed", "site", "blanket_disallow", "n_pages", "low"),
    Check("reach.robots.crawl_delay_excessive", "Crawl delay slows every crawler", "low", "confirmed", "site", "crawl_delay > 2", "n_pages", "low"),
    Check("reach.http.broken_internal_links", "Internal links are broken", "medium", "confirmed", "site", "n_broken > 0 AND (broken_rate > 0.02 OR n_broken > 5)", "n_broken"),
    Check("reach.perf.slow_median_ttfb", "Slow first byte", "low", "confirmed", "site", "median_ms > 800", "n_samples", "high"),
    Check("reach.sitemap.absent_or_invalid", "No sitemap", "medium", "confirmed", "site", "n_pages >= 15 AND n_listed = 0", "n_listed", "low"),
    Check("reach.sitemap.coverage_gap", "Sitemap leaves pages out", "low", "confirmed", "site", "n_listed > 0 AND (missing_share > 0.4 OR (n_listed > 3 AND n_lastmods <= 1))", "n_missing"),
    Check("trust.entity.nap_inconsistent", "Several phone numbers", "medium", "likely", "site", "n_phones > 1 AND n_pages >= 4", "n_phones"),
    Check("act.trust.no_policy_or_contact_path", "No policy or contact path", "medium", "confirmed", "site", "NOT has_policy_path", "n_pages", "low"),
    Check("extract.sd.site_without_data", "No page has structured data", "high", "confirmed", "site", "n_with_data = 0", "n_pages"),
    Check("extract.meta.no_descriptions", "No page has a description", "medium", "confirmed", "site", "n_with_description = 0", "n_pages", "low"),
    Check("extract.meta.no_open_graph", "No page has Open Graph data", "low", "confirmed", "site", "n_with_graph = 0", "n_pages", "low"),
    Check("reach.index.no_canonicals", "No page names its canonical address", "low", "confirmed", "site", "n_with_canonical = 0", "n_pages", "low"),
    Check("extract.meta.duplicate_titles", "Pages share a title", "medium", "confirmed", "site", "n_pages >= 3 AND n_shared_titles > 0", "n_shared_titles"),
    Check("extract.ans.thin_site", "Most pages are thin", "medium", "confirmed", "site", "2 * n_thin > n_pages", "n_thin"),
    Check("act.nav.sparse_navigation", "Most pages have few links", "low", "likely", "site", "2 * n_sparse > n_pages", "n_sparse"),
    Check("trust.contact.no_contact_facts", "No page states how to get in touch", "low", "likely", "site", "n_with_contact = 0", "n_pages", "low"),
)
CATALOGUE = {c.check_id: c for c in (*PAGE_CHECKS, *SITE_CHECKS, *deep_checks.PAGE_CHECKS, *deep_checks.SITE_CHECKS, *parsed_checks.CHECKS)}
EMPTY_HEADINGS = "array<struct<level:int,text:string,pos:int>>"


def page_facts(page: DataFrame) -> DataFrame:
    """One row of comparable facts per page row, from that row alone: no join, no shuffle. Nulls count as empty; missing statuses as 0."""
    page = profile.with_kind(page)
    h = F.coalesce("headings", F.array().cast(EMPTY_HEADINGS))
    levels = F.array_sort(F.array_distinct(F.transform(h, lambda x: x["level"])))
    days = F.array_compact(F.array(*(T.any_date(F.col(f"dates.{c}")) for c in ("http_last_modified", "sitemap_lastmod", "schema_published", "schema_modified", "visible"))))
    forms = F.coalesce("forms", F.from_json(F.lit("[]"), page.schema["forms"].dataType.simpleString()))
    up = F.array_union(U.ancestors(F.col("url")), F.transform(U.ancestors(F.col("url")), lambda a: F.regexp_replace(a, "/$", "")))
    body, none = F.coalesce("main_text", F.lit("")), F.array().cast("array<string>")
    number = lambda c: F.coalesce(c, F.lit(0)).cast("bigint")
    return page.select(
        "page_id", "site", "url", number(F.col("status")).alias("status"), number(F.col("bytes")).alias("bytes"), T.word_count(F.col("text")).alias("words"), T.word_count(F.col("main_text")).alias("main_words"),
        F.round(T.boilerplate_ratio(T.word_count(F.col("main_text")), T.word_count(F.col("text"))), 6).alias("boilerplate"),
        F.coalesce(F.lower("meta_robots").contains("noindex"), F.lit(False)).alias("noindex"), F.coalesce(F.lower("url").startswith("http://"), F.lit(False)).alias("insecure"),
        number(F.size("markup.jsonld")).alias("n_blocks"), F.greatest(number(F.size("markup.parse_errors")), F.lit(0)).alias("n_parse_errors"), F.size(profile.declared_types(page)).cast("bigint").alias("n_types"),
        number(F.length(F.trim("title"))).alias("title_length"), T.matches(F.trim("title"), "generic_title").alias("generic_title"),
        F.size(h).cast("bigint").alias("n_headings"), F.size(F.filter(h, lambda x: x["level"] == 1)).cast("bigint").alias("n_h1"), F.size(F.filter(h, lambda x: x["level"] == 2)).cast("bigint").alias("n_h2"),
        F.coalesce(F.exists(F.zip_with(levels, F.slice(levels, F.lit(2), F.size(levels)), lambda a, b: b - a > 1), lambda x: x), F.lit(False)).alias("has_gap"),
        (T.occurrences(body, "statistic") + T.occurrences(body, "quotation") + T.occurrences(body, "citation")).alias("n_evidence"),
        F.size(days).cast("bigint").alias("n_dates"), number(F.datediff(F.array_max(days), F.array_min(days))).alias("date_spread"), T.invisible_count(F.col("text")).alias("n_invisible"),
        U.depth(F.coalesce("url", F.lit(""))).cast("bigint").alias("depth"), F.coalesce(F.arrays_overlap("links.internal", up), F.lit(False)).alias("links_up"),
        number(F.array_max(F.transform(forms, lambda f: F.size(f["fields"])))).alias("most_fields"), number(F.aggregate(forms, F.lit(0), lambda a, f: a + F.coalesce(F.size(F.filter(f["fields"], lambda x: ~x["labelled"])), F.lit(0)))).alias("n_unlabelled"),
        F.size(F.coalesce("links.internal_in_main", none)).cast("bigint").alias("n_in_main"), F.size(F.coalesce("links.internal", none)).cast("bigint").alias("n_internal"),
        F.coalesce(F.map_contains_key("meta", F.lit("viewport")), F.lit(False)).alias("has_viewport"), (F.coalesce("meta_description", F.lit("")) != "").alias("has_description"), F.coalesce(F.size(F.map_keys("markup.opengraph")) > 0, F.lit(False)).alias("has_graph"),
        F.col("canonical").isNotNull().alias("has_canonical"), (T.matches(F.col("text"), "email") | F.coalesce(F.col("text").rlike(r"(^|\n)Tel\. "), F.lit(False))).alias("has_contact"),
        F.coalesce(F.exists("links.internal", lambda x: x.rlike("(?i)" + T.PATTERNS["policy_path"])), F.lit(False)).alias("has_policy"), F.lower(F.trim(F.coalesce("title", F.lit("")))).alias("name"), profile.kind_of(page)["page_type"].alias("page_type"),
    )


def limited_facts(page: DataFrame, archetypes: DataFrame | None = None) -> DataFrame:
    """The facts of every page with the limits of its site's archetype."""
    return profile.with_limits(page_facts(page), profile.archetypes(profile.site_signals(page)) if archetypes is None else archetypes)


def site_facts(page: DataFrame, page_raw: DataFrame, sitemap_entry: DataFrame, robots_rule: DataFrame, facts: DataFrame | None = None, crawlers: dict | None = None) -> DataFrame:
    """One row of facts per site that has pages."""
    facts = page_facts(page) if facts is None else facts
    rows = facts.groupBy("site").agg(
        F.count("*").alias("n_pages"), F.count_if(F.col("n_types") > 0).alias("n_with_data"), F.count_if("has_description").alias("n_with_description"), F.count_if("has_graph").alias("n_with_graph"), F.count_if("has_canonical").alias("n_with_canonical"),
        F.count_if(F.col("main_words") < 80).alias("n_thin"), F.count_if(F.col("n_internal") < 5).alias("n_sparse"), F.count_if("has_contact").alias("n_with_contact"), F.bool_or("has_policy").alias("has_policy_path"),
    )
    shared = facts.where("name <> ''").groupBy("site", "name").agg(F.count("*").alias("n")).where("n > 1").groupBy("site").agg(F.sum("n").alias("n_shared_titles"))
    phones = page.select("site", F.explode(F.split("text", "\n")).alias("l")).where(r"l rlike '^Tel\\. '").groupBy("site").agg(F.count_distinct(F.regexp_replace("l", "[^0-9]", "")).alias("n_phones"))
    delays = robots_rule.where((F.col("agent") == "*") | (robots.category(F.col("agent"), crawlers) == "retrieval")).groupBy("site").agg(F.max("crawl_delay").alias("crawl_delay"))
    closed = robots.blanket_disallows(robots_rule).withColumn("blanket_disallow", F.lit(True))
    broken = links.broken_links(page, page_raw).select("site", "n_broken", F.col("rate").alias("broken_rate"))
    coverage = links.sitemap_coverage(page, sitemap_entry).select("site", "n_listed", "n_missing", "missing_share", "n_lastmods")
    for other in (shared, phones, delays, closed, broken, coverage, links.response_times(page_raw)):
        rows = rows.join(other, "site", "left")
    whole = ("n_shared_titles", "n_phones", "n_broken", "n_listed", "n_missing", "n_lastmods", "n_samples")
    return rows.fillna(0, whole).fillna(0.0, ["crawl_delay", "broken_rate", "missing_share", "median_ms"]).fillna(False, ["blanket_disallow"])


def suppressed(facts: DataFrame) -> DataFrame:
    """(site, check_id, reason, n): rules that were not assessed on pages, as an output of its own."""
    rows = [(F.col("status") != 200, "*", "page did not answer 200"), (F.col("page_type") == "utility", "extract.ans.thin_content_for_page_type", "utility page"), (F.col("words") < 200, "extract.sd.absent_on_eligible_page", "below the word floor"), (F.col("main_words") < 400, "extract.ans.no_evidence_markers", "below the word floor"), (F.col("n_dates") < 2, "trust.date.signals_disagree", "fewer than two dates")]
    skips = F.array_compact(F.array(*(F.when(c, F.struct(F.lit(i).alias("check_id"), F.lit(r).alias("reason"))) for c, i, r in rows)))
    return facts.select("site", F.explode(skips).alias("x")).groupBy("site", "x.check_id", "x.reason").agg(F.count("*").alias("n"))


def findings(page: DataFrame, page_raw: DataFrame, sitemap_entry: DataFrame, robots_rule: DataFrame, crawlers: dict | None = None, parsed: bool = False) -> DataFrame:
    """Findings of the whole catalogue in the shape of ``operators.findings``; ``seq`` orders them by rule and page. With ``parsed``
    the rules that parse html take part; those about visible content then leave out pages that are empty shells."""
    # facts are narrow and read twice, by page and by site: they are kept, so texts and markup are read once
    archetypes = cut_lineage(profile.archetypes(profile.site_signals(page)))
    facts = cut_lineage(limited_facts(page, archetypes))
    deep = cut_lineage(deep_checks.deep_facts(page, page_raw, archetypes))
    on_pages = fired(facts, PAGE_CHECKS, ["site", "page_id", "url"]).select("site", "check_id", F.col("page_id").alias("at"), F.array("url").alias("affected_urls"), "measure")
    on_sites = fired(site_facts(page, page_raw, sitemap_entry, robots_rule, facts, crawlers), SITE_CHECKS, ["site"]).select("site", "check_id", F.lit(0).cast("bigint").alias("at"), F.array().cast("array<string>").alias("affected_urls"), "measure")
    more_on_pages, more_on_sites = deep_checks.raised(page, page_raw, robots_rule, crawlers, deep)
    more_on_pages = more_on_pages.select("site", "check_id", F.col("page_id").alias("at"), F.array("url").alias("affected_urls"), "measure")
    more_on_sites = more_on_sites.select("site", "check_id", F.lit(0).cast("bigint").alias("at"), F.array().cast("array<string>").alias("affected_urls"), "measure")
    rows = on_pages.unionByName(on_sites).unionByName(more_on_pages).unionByName(more_on_sites)
    if parsed:
        seen = cut_lineage(parsed_checks.parsed_findings(page, page_raw))
        rows = rows.unionByName(seen.select("site", "check_id", F.col("page_id").alias("at"), F.array("url").alias("affected_urls"), "measure"))
        shells = seen.where("check_id = 'read.render.empty_spa_shell'").select("site", F.col("page_id").alias("at")).distinct()
        unseen = F.col("check_id").isin(*crawling.NEEDS_VISIBLE)
        rows = rows.where(~unseen).unionByName(rows.where(unseen).join(shells, ["site", "at"], "left_anti"))
    order = F.create_map(*(x for i, c in enumerate(CATALOGUE) for x in (F.lit(c), F.lit(i))))
    value = lambda field: F.element_at(F.create_map(*(x for c in CATALOGUE.values() for x in (F.lit(c.check_id), F.lit(getattr(c, field))))), F.col("check_id"))
    seq = F.element_at(order, F.col("check_id")).cast("bigint") * F.lit(1 << 48) + F.col("at")
    return rows.select(
        "site", seq.alias("seq"), "check_id", *(value(f).alias(f) for f in ("title", "severity", "confidence", "stage", "category", "scope")), "affected_urls",
        F.format_string("%s: measured %d", "check_id", "measure").alias("evidence"), value("effort").alias("effort"), F.concat(F.lit("Resolve: "), value("title")).alias("summary"), F.lit("The rule's condition no longer holds on the next crawl").alias("mechanism"),
    )
