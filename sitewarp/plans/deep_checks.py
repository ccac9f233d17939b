"""Rules over what pages say, what their markup does and what crawlers are told: further facts, joined to a page by its address
or to a site, and the rules on them. Texts and markup are read once each; only facts are shuffled."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sitewarp.functions import text as T
from sitewarp.functions import urls as U
from sitewarp.operators import content, links, profile, robots
from sitewarp.plans.catalogue import Check, fired

# Required fields that put people off, hosts that vouch for an entity, names that many share, what types a page type
# accepts, and types that state an identity.
FRICTION = "phone tel company organisation organization job_title jobtitle dob date_of_birth birthday address1 address_line_1 street postcode zip fax".split()
AUTHORITIES = "wikipedia.org wikidata.org crunchbase.com linkedin.com github.com companieshouse.gov.uk sec.gov opencorporates.com gov.uk europa.eu doi.org orcid.org scholar.google.com bloomberg.com reuters.com".split()
COLLIDING = """apex atlas anchor arbor aurora beacon bridge canvas cedar circle clarity compass core delta domain drift echo ember flow forge fusion grove harbor harbour haven horizon impact ion keystone
lattice ledger lens lift loop lumen matrix meridian mint north nova oak onyx orbit origin pace pattern peak pillar pivot pulse quest range relay ridge river scope shift signal slate solstice spark sphere spring stack
summit surge tempo terra thread tide torch trail vantage vertex vista vault wave zenith""".split()
ACCEPTED = {
    "product": "product offer productgroup softwareapplication service", "pricing": "product offer service softwareapplication webpage itemlist", "article": "article newsarticle blogposting techarticle report",
    "docs": "techarticle article howto apireference webpage blogposting", "home": "organization website localbusiness person webpage corporation ngo store", "contact": "contactpage organization localbusiness webpage person",
    "about": "aboutpage organization localbusiness person webpage", "category": "collectionpage itemlist webpage breadcrumblist product", "other": "webpage",
}
#: Member names of which each page type needs one per list.
NEEDED = {"product": (("name", "headline", "legalName"), ("price", "lowPrice", "highPrice"), ("priceCurrency",)), "pricing": (("name", "headline", "legalName"),), "article": (("headline", "name", "title"), ("datePublished", "dateCreated", "uploadDate")), "docs": (("headline", "name", "title"),), "home": (("name", "headline", "legalName"),)}
IDENTITY = ("organization", "localbusiness", "corporation", "website")
OFFERS = ("get started", "sign up", "start free", "try ", "buy ", "book ", "contact", "subscribe", "download", "request", "learn more", "demo", "order", "shop")
SAYS_WHAT = ("we ", "our ", "provides", "helps", "platform", "software", "service", "company", "for ", "solution", "tool", "app")

PAGE_CHECKS = (
    Check("trust.integrity.prompt_injection", "Text speaks to language models", "critical", "confirmed", "url", "directs OR markup_directs", "n_words", "low"),
    Check("trust.integrity.cloaked_text", "Markup hides text", "medium", "likely", "url", "n_hidden >= 3", "n_hidden"),
    Check("trust.date.stale_volatile_facts", "Facts that change stand on an old page", "medium", "likely", "url", "changes AND newest_age > stale_days", "newest_age"),
    Check("trust.authorship.unattributed", "Article names no author", "low", "confirmed", "url", "page_type = 'article' AND NOT authored AND archetype NOT IN ('e-commerce', 'saas-marketing')", "n_words", "low"),
    Check("extract.ans.no_direct_answer_block", "Nothing near the top says what this is", "medium", "likely", "url", "page_type NOT IN ('category', 'utility', 'contact') AND n_tokens >= 80 AND NOT defined AND NOT described", "n_tokens", "low"),
    Check("extract.sd.expected_type_missing", "Structured data is of another kind than the page", "high", "confirmed", "url", "n_types > 0 AND confidence >= 0.6 AND page_type <> 'utility' AND NOT accepted", "n_types"),
    Check("extract.sd.required_props_missing", "Structured data lacks what its kind of page needs", "medium", "confirmed", "url", "accepted AND lacks_property", "n_types"),
    Check("reach.index.canonical_conflict", "Canonical address leads elsewhere", "high", "confirmed", "url", "canonical_conflict", "n_words", "low"),
    Check("act.orient.no_value_proposition", "The first screen does not say for whom", "high", "likely", "url", "page_type IN ('home', 'product', 'other') AND n_words >= 30 AND NOT speaks", "n_words", "low"),
    Check("act.trust.no_social_proof", "Nothing shows that others use it", "medium", "likely", "url", "page_type IN ('home', 'product', 'pricing') AND n_words >= 60 AND NOT proven", "n_words"),
    Check("act.form.high_friction_required_fields", "Form demands what puts people off", "medium", "confirmed", "url", "n_friction > 0 AND page_type <> 'utility'", "n_friction", "low"),
    Check("act.context.assumes_prior_context", "Page assumes an earlier visit", "medium", "likely", "url", "assumes", "n_words", "low"),
    Check("act.blocker.load_time_interstitial", "Something covers the page on load", "medium", "likely", "url", "interrupts", "n_words"),
    Check("act.blocker.content_gated_by_interaction", "Prose is folded away", "medium", "likely", "url", "n_gated >= 3 AND main_words >= 150", "n_gated"),
)
SITE_CHECKS = (
    Check("reach.robots.ai_search_bot_blocked", "Search crawlers are shut out by name", "critical", "confirmed", "site", "n_retrieval > 0", "n_retrieval", "low"),
    Check("reach.robots.ai_training_bot_blocked", "Training crawlers are shut out by name", "info", "confirmed", "site", "n_training > 0", "n_training", "low"),
    Check("reach.robots.dual_purpose_bot_blocked", "Crawlers of two purposes are shut out by name", "medium", "likely", "site", "n_dual_purpose > 0", "n_dual_purpose", "low"),
    Check("reach.robots.unparseable", "Crawl rules cannot be read", "medium", "confirmed", "site", "robots_answers AND (robots_is_html OR NOT has_rules)", "n_pages", "low"),
    Check("reach.index.redirect_chain_or_loop", "Redirects in chains", "medium", "confirmed", "site", "n_chains > 0", "n_chains"),
    Check("reach.http.insecure_or_mixed_scheme", "Pages or certificates are not secure", "high", "confirmed", "site", "n_insecure + n_tls_errors > 0", "n_insecure + n_tls_errors"),
    Check("reach.agent.llms_txt_absent", "No guide for language models", "low", "confirmed", "site", "archetype IN ('docs', 'developer-platform') AND NOT has_llms", "n_pages", "low"),
    Check("extract.sd.identity_graph_weak", "Home page does not state who this is", "medium", "confirmed", "site", "has_home AND (NOT home_identity OR NOT home_same_as)", "n_pages"),
    Check("trust.entity.no_external_corroboration", "Few authorities vouch for the entity", "medium", "likely", "site", "has_home AND n_authorities < 2", "n_authorities"),
    Check("trust.entity.name_collision", "Many share the name", "medium", "likely", "site", "has_home AND shared_name AND NOT home_described", "n_pages"),
)
LEGACY_CHECKS = (
    Check("v1.access.no_robots", "No robots.txt", "low", "confirmed", "site", "NOT robots_answers", "n_pages"),
    Check("v1.access.ai_crawlers_blocked", "Crawlers are shut out by name", "critical", "confirmed", "site", "n_retrieval + n_training + n_dual_purpose > 0", "n_retrieval + n_training + n_dual_purpose"),
    Check("v1.access.mixed_content", "Pages load parts without encryption", "medium", "confirmed", "site", "n_mixed > 0", "n_mixed"),
    Check("v1.access.no_llms_txt", "No guide for language models", "low", "confirmed", "site", "NOT has_llms", "n_pages"),
    Check("v1.render.near_empty", "Pages without text in their markup", "critical", "confirmed", "site", "n_near_empty > 0", "n_near_empty"),
    Check("v1.render.images_lack_alt", "Images without alternative text", "medium", "confirmed", "site", "n_no_alt > 0", "n_no_alt"),
    Check("v1.data.home_lacks_identity", "Home page states no identity", "high", "confirmed", "site", "has_home AND NOT home_identity", "n_pages"),
    Check("v1.data.no_same_as", "Identity names no profiles", "medium", "confirmed", "site", "home_identity AND NOT home_same_as", "n_pages"),
    Check("v1.freshness.stale_copyright", "Copyright year is old", "medium", "likely", "site", "n_old_copyright > 0", "n_old_copyright"),
    Check("v1.freshness.weak_corroboration", "Home page names no profiles", "medium", "likely", "site", "has_home AND NOT home_same_as", "n_pages"),
    Check("v1.freshness.no_about", "Home page does not say who this is", "low", "likely", "site", "has_home AND NOT home_about", "n_pages"),
    Check("v1.freshness.superlatives", "Claims without support", "low", "likely", "site", "n_superlatives >= 3", "n_superlatives"),
    Check("v1.answers.no_faq_markup", "No markup for questions", "medium", "confirmed", "site", "n_faq = 0", "n_pages"),
    Check("v1.answers.vague_home", "Home page is vague", "high", "likely", "site", "has_home AND home_vague", "n_pages"),
    Check("v1.answers.walls_of_text", "Walls of text", "medium", "confirmed", "site", "n_substantial > 0 AND n_walls >= greatest(1, floor(n_substantial / 2))", "n_walls"),
    Check("v1.integrity.prompt_injection", "Text speaks to language models", "critical", "confirmed", "site", "n_directing > 0", "n_directing"),
    Check("v1.integrity.hidden_text", "Markup hides text", "medium", "likely", "site", "n_hiding > 0", "n_hiding"),
    Check("v1.engagement.slow", "Slow answers", "medium", "confirmed", "site", "slowest_ms > 3000", "n_pages"),
    Check("v1.engagement.no_call_to_action", "Pages name no next step", "medium", "likely", "site", "2 * n_no_offer > n_pages", "n_no_offer"),
    Check("v1.engagement.intrusive", "Pages interrupt", "low", "likely", "site", "n_intrusive > 0", "n_intrusive"),
)


def _any(text: Column, words) -> Column:
    out = F.lit(False)
    for w in words:
        out = out | F.contains(text, F.lit(w))
    return out


def _lacking(kind: Column, blob: Column) -> Column:
    out = F.lit(False)
    for name, lists in NEEDED.items():
        for names in lists:
            out = out | ((kind == name) & ~_any(blob, (f'"{n}"' for n in names)))
    return out


def content_facts(page: DataFrame) -> DataFrame:
    """What each page says, from its row alone. Nulls count as empty; a page without dates has age -1."""
    page = profile.with_kind(page)
    body = F.coalesce(F.nullif("main_text", F.lit("")), F.nullif("text", F.lit("")), F.lit(""))
    whole, blob = F.coalesce("text", F.lit("")), F.coalesce(F.array_join("markup.jsonld", "\n"), F.lit(""))
    types, kind = profile.declared_types(page), profile.kind_of(page)
    days = F.array_compact(F.array(*(T.any_date(F.col(f"dates.{c}")) for c in ("http_last_modified", "sitemap_lastmod", "schema_published", "schema_modified", "visible"))))
    fields = F.flatten(F.coalesce(F.transform("forms", lambda f: F.coalesce(f["fields"], F.array().cast("array<struct<name:string,type:string,required:boolean,labelled:boolean,placeholder:string>>"))), F.array().cast("array<array<struct<name:string,type:string,required:boolean,labelled:boolean,placeholder:string>>>")))
    wanted = F.create_map(*(x for k, v in ACCEPTED.items() for x in (F.lit(k), F.array(*map(F.lit, v.split())))))
    low, years = F.lower(whole), F.transform(F.regexp_extract_all(whole, F.lit(r"(?i)(?:©|copyright|\(c\)) ?([0-9]{4})"), F.lit(1)), lambda y: y.cast("int"))
    head = F.substring(low, 1, 600)
    return page.select(
        "page_id", "site", "url", kind["page_type"].alias("page_type"), kind["confidence"].alias("confidence"), F.coalesce("status", F.lit(0)).alias("status"), T.word_count(body).alias("n_words"), T.word_count(F.col("main_text")).alias("main_words"), F.size(T.tokens(body)).cast("bigint").alias("n_tokens"),
        (T.matches(F.substring(body, 1, 400), "speaks_to") & ~T.matches(F.substring(body, 1, 400), "vague_opener")).alias("speaks"), T.matches(body, "proof").alias("proven"), T.matches(body, "volatile_fact").alias("changes"),
        F.coalesce(F.datediff("crawled_at", F.array_max(days)), F.lit(-1)).cast("bigint").alias("newest_age"), (T.matches(body, "author_hint") | F.contains(blob, F.lit('"author"'))).alias("authored"),
        T.matches(whole, "directive").alias("directs"), T.matches(body, "prior_context").alias("assumes"), F.size(F.filter(fields, lambda x: F.coalesce(x["required"], F.lit(False)) & F.coalesce(F.lower(x["name"]).isin(FRICTION), F.lit(False)))).cast("bigint").alias("n_friction"),
        F.exists(F.slice(T.sentences(F.substring(body, 1, 900)), 1, 5), lambda s: T.matches(s, "definitional") & (F.size(T.tokens(s)) <= 50)).alias("defined"), T.matches(F.col("meta_description"), "definitional").alias("described"),
        F.size(types).cast("bigint").alias("n_types"), F.coalesce(F.arrays_overlap(types, F.try_element_at(wanted, kind["page_type"])), F.lit(False)).alias("accepted"), F.array_contains(types, "faqpage").alias("faq"), _lacking(kind["page_type"], blob).alias("lacks_property"),
        F.arrays_overlap(types, F.array(*map(F.lit, IDENTITY))).alias("identity"), F.contains(blob, F.lit('"sameAs"')).alias("same_as"), F.contains(blob, F.lit('"description"')).alias("blob_described"),
        F.size(F.filter(F.array(*map(F.lit, AUTHORITIES)), lambda h: F.contains(blob, h))).cast("bigint").alias("n_authorities"), _any(low, ("about", "who we are", "what we do")).alias("about"), _any(low, OFFERS).alias("offers"),
        ((F.length(head) < 120) | (F.size(F.filter(F.array(*map(F.lit, SAYS_WHAT)), lambda w: F.contains(head, w))) < 2)).alias("vague"), T.occurrences(whole, "superlative").alias("n_superlatives"),
        F.coalesce(F.exists(years, lambda y: (y > 2000) & (y < F.year("crawled_at") - 1)), F.lit(False)).alias("old_copyright"), F.length(whole).cast("bigint").alias("n_chars"),
        F.coalesce(F.exists("headings", lambda h: F.endswith(F.trim(h["text"]), F.lit("?"))), F.lit(False)).alias("asks"), F.coalesce(F.lower("url").startswith("http://"), F.lit(False)).alias("insecure"),
    )


def markup_facts(page_raw: DataFrame) -> DataFrame:
    """What the markup behind each address does, the most of all requests for it. Repeated requests count once."""
    h = F.col("html")
    images = F.regexp_count(h, F.lit(r"(?i)<img[ \t\r\n/>]"))
    described = F.regexp_count(h, F.lit(r"(?i)<img[^>]* alt=[\"'][^\"']*[^\"' ][^\"']*[\"']"))
    rows = page_raw.where("html is not null and url is not null").dropDuplicates(["fetch_id"]).select(
        "url", T.matches(h, "directive").alias("markup_directs"), T.occurrences(h, "hidden_style").alias("n_hidden"), T.matches(h, "modal_on_load").alias("interrupts"), T.occurrences(h, "gated").alias("n_gated"), T.matches(h, "plain_source").alias("mixed"),
        ((images >= 3) & (images - described > 0.6 * images)).alias("no_alt"), T.matches(h, "autoplay").alias("intrusive"), h.rlike("(?i)<(ul|ol|table)[ >]").alias("structured"), F.length(h).cast("bigint").alias("n_markup"),
    )
    flags, numbers = ("markup_directs", "interrupts", "mixed", "no_alt", "intrusive", "structured"), ("n_hidden", "n_gated", "n_markup")
    return rows.groupBy("url").agg(*(F.bool_or(c).alias(c) for c in flags), *(F.max(c).alias(c) for c in numbers))


def deep_facts(page: DataFrame, page_raw: DataFrame, archetypes: DataFrame | None = None) -> DataFrame:
    """Page facts of content and markup, the limits of the site's archetype, and whether the canonical address conflicts."""
    rows = content_facts(page).join(markup_facts(page_raw), "url", "left").fillna(False, ["markup_directs", "interrupts", "mixed", "no_alt", "intrusive", "structured"]).fillna(0, ["n_hidden", "n_gated", "n_markup"])
    conflicts = links.canonical_conflicts(page, page_raw).select("page_id", F.lit(True).alias("canonical_conflict")).distinct()
    rows = rows.join(conflicts, "page_id", "left").fillna(False, ["canonical_conflict"])
    return profile.with_limits(rows, profile.archetypes(profile.site_signals(page)) if archetypes is None else archetypes)


def access_facts(page: DataFrame, page_raw: DataFrame, robots_rule: DataFrame, facts: DataFrame, crawlers: dict | None = None) -> DataFrame:
    """One row of facts per site: crawlers shut out by name, well-known files, redirects, certificates, the home page."""
    paths = page.where("url is not null").select("site", U.path(F.col("url")).alias("path")).distinct()
    shut = robots.named_blocks(paths, robots_rule, crawlers).groupBy("site").agg(*(F.coalesce(F.max(F.when(F.col("category") == c, F.col("n_crawlers"))), F.lit(0)).alias(f"n_{c}") for c in ("retrieval", "training", "dual_purpose")))
    ok = F.col("status").between(200, 299)
    files = page_raw.where("url is not null").groupBy("site").agg(
        F.coalesce(F.bool_or(ok & F.col("url").rlike("/robots\\.txt$")), F.lit(False)).alias("robots_answers"), F.coalesce(F.bool_or(ok & F.col("url").rlike("/robots\\.txt$") & F.coalesce(F.lower("content_type").contains("html"), F.lit(False))), F.lit(False)).alias("robots_is_html"),
        F.coalesce(F.bool_or(ok & F.col("url").rlike("/llms\\.txt$")), F.lit(False)).alias("has_llms"), F.count_distinct(F.when(F.col("tls_error").isNotNull(), F.col("url"))).alias("n_tls_errors"), F.coalesce(F.max(F.array_max("ttfb_ms")), F.lit(0.0)).alias("slowest_ms"),
    )
    chains = links.redirect_chains(page_raw).groupBy("site").agg(F.count_distinct("url").alias("n_chains"))
    brands = content.site_brands(page).select("site", F.regexp_extract_all(F.lower("brand"), F.lit("[a-z]+"), F.lit(0)).alias("w"))
    shared = brands.select("site", (F.arrays_overlap("w", F.array(*map(F.lit, COLLIDING))) | ((F.size("w") == 1) & (F.length(F.get("w", F.lit(0))) < 6))).alias("shared_name"))
    home = F.col("page_type") == "home"
    at_home = lambda c, name: F.coalesce(F.bool_or(home & F.col(c)), F.lit(False)).alias(name)
    walls = (F.col("n_chars") >= 800) & ~F.col("structured") & ~F.col("asks")
    rows = facts.groupBy("site").agg(
        F.count("*").alias("n_pages"), F.first("archetype").alias("archetype"), F.bool_or(home).alias("has_home"), at_home("identity", "home_identity"), at_home("same_as", "home_same_as"), at_home("blob_described", "home_described"), at_home("about", "home_about"), at_home("vague", "home_vague"),
        F.coalesce(F.max(F.when(home, F.col("n_authorities"))), F.lit(0)).alias("n_authorities"), F.count_if("insecure").alias("n_insecure"), F.count_if("mixed").alias("n_mixed"), F.count_if("no_alt").alias("n_no_alt"), F.count_if((F.col("n_chars") < 300) & (F.col("n_markup") > 1500)).alias("n_near_empty"),
        F.count_if("old_copyright").alias("n_old_copyright"), F.sum("n_superlatives").alias("n_superlatives"), F.count_if("faq").alias("n_faq"), F.count_if(F.col("n_chars") >= 800).alias("n_substantial"), F.count_if(walls).alias("n_walls"), F.count_if(F.col("directs") | F.col("markup_directs")).alias("n_directing"),
        F.count_if(F.col("n_hidden") >= 3).alias("n_hiding"), F.count_if(~F.col("offers")).alias("n_no_offer"), F.count_if("intrusive").alias("n_intrusive"),
    )
    ruled = robots_rule.select("site", F.lit(True).alias("has_rules")).distinct()
    for other in (shut, files, chains, shared, ruled):
        rows = rows.join(other, "site", "left")
    return rows.fillna(0, ["n_retrieval", "n_training", "n_dual_purpose", "n_tls_errors", "n_chains"]).fillna(0.0, ["slowest_ms"]).fillna(False, ["robots_answers", "robots_is_html", "has_llms", "shared_name", "has_rules"])


def raised(page: DataFrame, page_raw: DataFrame, robots_rule: DataFrame, crawlers: dict | None = None, facts: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """((site, page_id, url, check_id, measure), (site, check_id, measure)) of the rules that hold."""
    facts = deep_facts(page, page_raw) if facts is None else facts
    return fired(facts.where("status = 200"), PAGE_CHECKS, ["site", "page_id", "url"]), fired(access_facts(page, page_raw, robots_rule, facts, crawlers), SITE_CHECKS, ["site"])
