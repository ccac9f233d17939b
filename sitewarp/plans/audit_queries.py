"""Queries of the audit: page types, profiles, facts, rules, gates, ranks and reports, with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sitewarp.functions import text as T
from sitewarp.operators import findings as O
from sitewarp.operators import profile, robots
from sitewarp.plans import checks, deep_checks, parsed_checks, report
from sitewarp.plans import crawl_queries as C
from sitewarp.plans import text_queries as X
from sitewarp.session import cut_lineage, spread, table
from sitewarp.sources import html


#: The crawlers that the test tables name, beside the known ones.
NAMED = {"retrieval": ["CiteCrawler"], "training": ["IndexMoth"], "dual_purpose": ["NarrowBot"]}
CRAWLERS = {c: [*tokens, *NAMED[c]] for c, tokens in robots.BOTS.items()}


def _tables(spark, d):
    return [_page(spark, d), *(table(spark, d, n) for n in ("page_raw", "sitemap_entry", "robots_rule"))]


def _page(spark, d):
    """Wide facts cost much more than reading, so a small table is spread first."""
    return spread(table(spark, d, "page"))


def page_types(spark: SparkSession, d: str) -> DataFrame:
    return profile.page_type(table(spark, d, "page")).select("page_id", "page_type", "confidence")


def site_signals(spark: SparkSession, d: str) -> DataFrame:
    return profile.site_signals(_page(spark, d))


def site_archetypes(spark: SparkSession, d: str) -> DataFrame:
    return profile.archetypes(site_signals(spark, d))


def page_facts(spark: SparkSession, d: str) -> DataFrame:
    return checks.page_facts(_page(spark, d)).drop("url", "name")


def page_findings(spark: SparkSession, d: str) -> DataFrame:
    return checks.fired(checks.limited_facts(_page(spark, d)), checks.PAGE_CHECKS, ["page_id"])


def deep_facts(spark: SparkSession, d: str) -> DataFrame:
    return deep_checks.deep_facts(_page(spark, d), table(spark, d, "page_raw")).drop("url")


def deep_page_findings(spark: SparkSession, d: str) -> DataFrame:
    page, raw, _, rules = _tables(spark, d)
    return deep_checks.raised(page, raw, rules, CRAWLERS)[0].select("page_id", "check_id", "measure")


def access_facts(spark: SparkSession, d: str) -> DataFrame:
    page, raw, _, rules = _tables(spark, d)
    return deep_checks.access_facts(page, raw, rules, deep_checks.deep_facts(page, raw), CRAWLERS)


def deep_site_findings(spark: SparkSession, d: str) -> DataFrame:
    page, raw, _, rules = _tables(spark, d)
    return deep_checks.raised(page, raw, rules, CRAWLERS)[1]


def legacy_deep_findings(spark: SparkSession, d: str) -> DataFrame:
    return checks.fired(access_facts(spark, d), deep_checks.LEGACY_CHECKS, ["site"])


def site_facts(spark: SparkSession, d: str) -> DataFrame:
    return checks.site_facts(*_tables(spark, d), crawlers=CRAWLERS)


def site_findings(spark: SparkSession, d: str) -> DataFrame:
    return checks.fired(site_facts(spark, d), checks.SITE_CHECKS, ["site"])


def suppression_counts(spark: SparkSession, d: str) -> DataFrame:
    return checks.suppressed(checks.page_facts(_page(spark, d)))


def _pages(spark, d):
    return table(spark, d, "page").groupBy("site").agg(F.count("*").alias("n_pages"))


def _findings(spark, d):
    return checks.findings(*_tables(spark, d), crawlers=CRAWLERS)


def collapsed_findings(spark: SparkSession, d: str) -> DataFrame:
    return O.collapsed(cut_lineage(_findings(spark, d)), _pages(spark, d)).select("site", "check_id", "severity", "scope", "n_collapsed", F.size("affected_urls").cast("bigint").alias("n_urls"))


def ranked_findings(spark: SparkSession, d: str) -> DataFrame:
    ranked, _ = O.reported(_findings(spark, d), _pages(spark, d))
    return ranked.select("site", "finding_id", "check_id", "severity", "confidence", "scope", "ice", "priority", "blocked_by", F.coalesce(F.get("affected_urls", F.lit(0)), F.lit("")).alias("first_url"))


def finding_counts(spark: SparkSession, d: str) -> DataFrame:
    ranked, _ = O.reported(_findings(spark, d), _pages(spark, d))
    return O.counts(ranked)


def gate_notes(spark: SparkSession, d: str) -> DataFrame:
    ranked, _ = O.reported(_findings(spark, d), _pages(spark, d))
    return O.gate_notes(ranked)


def site_reports(spark: SparkSession, d: str) -> DataFrame:
    ranked, limits = O.reported(_findings(spark, d), _pages(spark, d))
    return report.site_reports(cut_lineage(ranked), _pages(spark, d), suppression_counts(spark, d), limits).select("site", "status", "n_pages", "n_findings", F.to_json("findings").alias("findings"), F.to_json("suppressions").alias("suppressions"))


def parsed_findings(spark: SparkSession, d: str) -> DataFrame:
    return parsed_checks.parsed_findings(_page(spark, d), table(spark, d, "page_raw")).select("page_id", "check_id", "measure")


def whole_report(spark: SparkSession, d: str) -> DataFrame:
    """The findings of all rules, those of parsed pages among them, in report order."""
    page, raw, entries, rules = _tables(spark, d)
    found = checks.findings(page, raw, entries, rules, CRAWLERS, parsed=True)
    ranked, _ = O.reported(found, _pages(spark, d))
    return ranked.select("site", "finding_id", "check_id", "severity", "confidence", "scope", "blocked_by", F.size(F.coalesce("merged_from", F.array().cast("array<string>"))).alias("n_merged"))


def parsed_pages(spark: SparkSession, d: str) -> DataFrame:
    raw = table(spark, d, "page_raw").where("html is not null").dropDuplicates(["fetch_id"])
    p = html.parsed_pages(raw, ["fetch_id"])
    return p.select("fetch_id", "title", F.size("headings").cast("bigint").alias("n_headings"), F.size("anchors").cast("bigint").alias("n_anchors"), F.size("jsonld").cast("bigint").alias("n_blocks"), F.col("n_scripts").cast("bigint").alias("n_scripts"))


def parsed_main(spark: SparkSession, d: str) -> DataFrame:
    raw = table(spark, d, "page_raw").where("html is not null").dropDuplicates(["fetch_id"])
    return html.parsed_pages(raw, ["fetch_id"]).select("fetch_id", "main_selector", "n_words", "n_main_words", F.size(F.filter("anchors", lambda a: a["in_main"])).alias("n_in_main"), "empty_shell", F.size("parse_errors").alias("n_errors"))


QUERIES = {f.__name__: f for f in (page_types, site_signals, site_archetypes, page_facts, page_findings, deep_facts, deep_page_findings, access_facts, deep_site_findings, legacy_deep_findings, site_facts, site_findings, suppression_counts, collapsed_findings, ranked_findings, finding_counts, gate_notes, site_reports, parsed_findings, whole_report, parsed_pages, parsed_main)}

_BLOCKS = "coalesce(array_to_string(markup.jsonld, chr(10)), '')"
_DECLARED = f"""list_sort(list_distinct(list_filter(list_transform(flatten(list_transform(regexp_extract_all({_BLOCKS}, '"@type"[ \\t\\r\\n]*:[ \\t\\r\\n]*(\\[[^\\]]*\\]|"[^"]*")', 1), lambda v: regexp_extract_all(v, '"([^"]*)"', 1))), lambda t: lower(regexp_extract(t, '([^/#:]*)$', 1))), lambda t: t <> '')))"""
_HINT_MAP = "MAP {" + ", ".join(f"'{k}': '{v}'" for k, v in profile.DECLARED.items()) + "}"
_HINT = f"list_filter(list_transform({_DECLARED}, lambda t: {_HINT_MAP}[t]), lambda x: x IS NOT NULL)[1]"
_URL = "coalesce(url, '')"


def _path_case(least: float, value: int, other: str) -> str:
    return "CASE" + "".join(f" WHEN regexp_matches({C._path(_URL)}, '{p}', 'i') THEN {repr(n) if value == 0 else c}" for p, n, c in C.U.PATH_TYPES if c >= least) + f" ELSE {other} END"


_FIELDS = "coalesce(list_sum(list_transform(forms, lambda f: coalesce(len(f.fields), 0))), 0)"
_SHAPE = f"CASE WHEN coalesce(status, 0) <> 200 THEN {{'t': 'utility', 'c': 0.5}} WHEN wordcount >= 400 AND coalesce(dates.schema_published, '') <> '' THEN {{'t': 'article', 'c': 0.65}} WHEN wordcount >= 500 THEN {{'t': 'article', 'c': 0.5}} WHEN {_FIELDS} >= 3 THEN {{'t': 'contact', 'c': 0.45}} ELSE {{'t': 'other', 'c': 0.35}} END"
_KIND = f"""SELECT page_id, coalesce({_path_case(0.9, 0, 'NULL')}, {_HINT}, {_path_case(0, 0, 'NULL')}, ({_SHAPE}).t) AS page_type,
 coalesce({_path_case(0.9, 1, 'NULL')}::DOUBLE, CASE WHEN {_HINT} IS NOT NULL THEN 0.92::DOUBLE END, ({_path_case(0, 1, 'NULL')})::DOUBLE, (({_SHAPE}).c)::DOUBLE) AS confidence FROM page"""
_HAS = lambda *names: f"list_has_any({_DECLARED}, [{', '.join(repr(n) for n in names)}])"
_MAIN = "coalesce(main_text, '')"
_LOW = f"lower({C._path(_URL)})"
_SIGNALS = f"""SELECT site, count(*) AS n_pages,
 bool_or({_HAS('product', 'offer')}) AS schema_product, bool_or({_HAS('article', 'newsarticle', 'blogposting')}) AS schema_article, bool_or({_HAS('techarticle', 'apireference', 'howto')}) AS schema_techarticle,
 bool_or({_HAS('localbusiness', 'store', 'restaurant', 'dentist', 'medicalclinic')}) AS schema_localbusiness, bool_or({_HAS('softwareapplication', 'saas')}) AS schema_softwareapp,
 bool_or({X._match(_MAIN, 'price')}) AS has_price, bool_or(regexp_matches({_LOW}, '/cart|/checkout|/basket')) AS cart_path, bool_or({X._match(_MAIN, 'cart')}) AS add_to_cart_text, bool_or(contains({_LOW}, '/api')) AS api_path,
 bool_or(regexp_matches({_MAIN}, 'npm install|pip install|INFORMATION_SCHEMA')) AS code_blocks, bool_or(len(list_filter(coalesce(links.external, []), lambda x: contains(x, 'github.com'))) > 0) AS github_link,
 bool_or({X._match(_MAIN, 'byline')}) AS bylines, bool_or({X._match(_MAIN, 'postal_code')}) AS postal_address, bool_or({X._match(_MAIN, 'phone')}) AS phone_number, bool_or({X._match(_MAIN, 'opening_hours')}) AS opening_hours,
 bool_or({X._match(_MAIN, 'trial')}) AS trial_cta, bool_or(regexp_matches({_LOW}, '/feature|/solution|/platform')) AS feature_pages,
 avg((page_type = 'product')::INT) >= 0.25 AS many_product_urls, avg((page_type = 'article')::INT) >= 0.35 AS many_article_urls, avg(regexp_matches({_LOW}, '/doc|/guide|/reference')::INT) >= 0.25 AS docs_path_share, avg((coalesce(dates.schema_published, '') <> '')::INT) >= 0.3 AS dated_pages,
 avg((coalesce(main_wordcount, 0) > 400)::INT) >= 0.4 AS long_pages, count(*) <= 8 AS small_site, bool_or(page_type = 'pricing') AS pricing_page, NOT bool_or(regexp_matches({_LOW}, '/cart|/checkout|/basket')) AS no_cart
FROM page JOIN ({_KIND}) kinds USING (page_id) GROUP BY 1"""


def _scores() -> str:
    out = []
    for name, weights in profile.WEIGHTS.items():
        total = " + ".join(f"CASE WHEN {s} THEN {w}::DOUBLE ELSE 0 END" for s, w in weights.items())
        if name in profile.NEEDS:
            total = f"CASE WHEN {' OR '.join(profile.NEEDS[name])} THEN {total} ELSE 0 END"
        out.append(f"{{'minus': -({total}), 'name': '{name}'}}")
    return f"list_sort([{', '.join(out)}])"


_NUM = lambda x: f"coalesce({x}, 0)"
_WC, _MWC = X._WORDS.format("text"), X._WORDS.format("main_text")
_FORMS = "coalesce(forms, [])"
_UP = f"list_concat({C._ANCESTORS}, list_transform({C._ANCESTORS}, lambda a: regexp_replace(a, '/$', '')))"
_POLICY = T.PATTERNS["policy_path"]
_FACTS = f"""SELECT page_id, site, url, {_NUM('status')} AS status, {_NUM('bytes')} AS bytes, {_WC} AS words, {_MWC} AS main_words,
 round(CASE WHEN {_WC} > 0 THEN 1 - {_MWC}::DOUBLE / {_WC} ELSE 0 END, 6) AS boilerplate, coalesce(contains(lower(meta_robots), 'noindex'), false) AS noindex, coalesce(starts_with(lower(url), 'http://'), false) AS insecure,
 {_NUM('len(markup.jsonld)')} AS n_blocks, {_NUM('len(markup.parse_errors)')} AS n_parse_errors, len({_DECLARED}) AS n_types, {_NUM('length(trim(title))')} AS title_length, {X._match('trim(title)', 'generic_title')} AS generic_title,
 len(coalesce(headings, [])) AS n_headings, len(list_filter(coalesce(headings, []), lambda h: h.level = 1)) AS n_h1, len(list_filter(coalesce(headings, []), lambda h: h.level = 2)) AS n_h2,
 len(list_filter(range(1, len({X._LEVELS})), lambda i: {X._LEVELS}[i + 1] - {X._LEVELS}[i] > 1)) > 0 AS has_gap, {X._count(_MAIN, 'statistic')} + {X._count(_MAIN, 'quotation')} + {X._count(_MAIN, 'citation')} AS n_evidence,
 len({X._DAYS}) AS n_dates, {_NUM(f"date_diff('day', list_min({X._DAYS}), list_max({X._DAYS}))")} AS date_spread, {_NUM(X._INVISIBLE)} AS n_invisible, len({C._segments(_URL)}) AS depth, coalesce(list_has_any(links.internal, {_UP}), false) AS links_up,
 {_NUM(f'list_max(list_transform({_FORMS}, lambda f: len(f.fields)))')} AS most_fields, {_NUM(f'list_sum(list_transform({_FORMS}, lambda f: len(list_filter(f.fields, lambda x: NOT x.labelled))))')} AS n_unlabelled,
 len(coalesce(links.internal_in_main, [])) AS n_in_main, len(coalesce(links.internal, [])) AS n_internal, coalesce(list_contains(map_keys(meta), 'viewport'), false) AS has_viewport, coalesce(meta_description, '') <> '' AS has_description,
 coalesce(len(map_keys(markup.opengraph)) > 0, false) AS has_graph, canonical IS NOT NULL AS has_canonical, {X._match('text', 'email')} OR coalesce(regexp_matches(text, '(^|\\n)Tel\\. '), false) AS has_contact,
 coalesce(len(list_filter(links.internal, lambda x: regexp_matches(x, '{_POLICY}', 'i'))) > 0, false) AS has_policy, lower(trim(coalesce(title, ''))) AS name, page_type
FROM page JOIN (SELECT page_id, page_type FROM ({_KIND})) kinds USING (page_id)"""
_SCORED = f"""SELECT site, CASE WHEN -s[1].minus >= 3 THEN s[1].name ELSE 'other' END AS archetype, -s[1].minus AS score, CASE WHEN -s[1].minus >= 3 THEN round(least(0.95, 0.55 + 0.45 * (-s[1].minus + s[2].minus) / -s[1].minus), 2) ELSE 0.3 END::DOUBLE AS confidence
FROM (SELECT site, {_scores()} AS s FROM ({_SIGNALS}))"""
_LIMITS = """coalesce(a.archetype, 'other') AS archetype,
 CASE coalesce(a.archetype, 'other') || ' ' || page_type WHEN 'docs docs' THEN 150 WHEN 'docs article' THEN 250 WHEN 'docs category' THEN 40 WHEN 'developer-platform docs' THEN 150 WHEN 'developer-platform article' THEN 250 WHEN 'saas-marketing home' THEN 100
  WHEN 'saas-marketing pricing' THEN 100 WHEN 'saas-marketing product' THEN 100 WHEN 'saas-marketing other' THEN 120 WHEN 'e-commerce product' THEN 80 WHEN 'e-commerce category' THEN 40 WHEN 'e-commerce home' THEN 100 WHEN 'publisher article' THEN 350 WHEN 'publisher category' THEN 50
  WHEN 'publisher home' THEN 100 WHEN 'local-business home' THEN 80 WHEN 'local-business about' THEN 60 WHEN 'local-business contact' THEN 30 WHEN 'local-business other' THEN 80
  ELSE CASE page_type WHEN 'home' THEN 120 WHEN 'product' THEN 120 WHEN 'category' THEN 60 WHEN 'article' THEN 300 WHEN 'docs' THEN 200 WHEN 'pricing' THEN 120 WHEN 'contact' THEN 40 WHEN 'about' THEN 100 WHEN 'utility' THEN 0 ELSE 150 END END AS thin_limit,
 CASE coalesce(a.archetype, 'other') || ' ' || page_type WHEN 'saas-marketing contact' THEN 7 WHEN 'saas-marketing pricing' THEN 4 WHEN 'saas-marketing home' THEN 4 ELSE CASE page_type WHEN 'contact' THEN 8 WHEN 'pricing' THEN 5 WHEN 'home' THEN 5 WHEN 'product' THEN 6 WHEN 'utility' THEN 30 ELSE 7 END END AS fields_limit,
 CASE coalesce(a.archetype, 'other') WHEN 'docs' THEN 730 WHEN 'publisher' THEN 365 ELSE 540 END AS stale_days, CASE WHEN a.archetype IN ('docs', 'developer-platform') THEN 800 ELSE 400 END AS evidence_words, CASE WHEN a.archetype = 'e-commerce' THEN 0.8 ELSE 0.7 END::DOUBLE AS boilerplate_limit"""
_LIMITED = f"SELECT f.*, {_LIMITS} FROM ({_FACTS}) f LEFT JOIN ({_SCORED}) a USING (site)"
_SITE = f"""SELECT a.site, n_pages, n_with_data, n_with_description, n_with_graph, n_with_canonical, n_thin, n_sparse, n_with_contact, has_policy_path, {_NUM('n_shared_titles')} AS n_shared_titles, {_NUM('n_phones')} AS n_phones,
 {_NUM('crawl_delay')} AS crawl_delay, z.site IS NOT NULL AS blanket_disallow, {_NUM('n_broken')} AS n_broken, {_NUM('broken_rate')} AS broken_rate, {_NUM('n_listed')} AS n_listed, {_NUM('n_missing')} AS n_missing, {_NUM('missing_share')} AS missing_share, {_NUM('n_lastmods')} AS n_lastmods, {_NUM('n_samples')} AS n_samples, {_NUM('median_ms')} AS median_ms
FROM (SELECT site, count(*) AS n_pages, count(*) FILTER (n_types > 0) AS n_with_data, count(*) FILTER (has_description) AS n_with_description, count(*) FILTER (has_graph) AS n_with_graph, count(*) FILTER (has_canonical) AS n_with_canonical,
 count(*) FILTER (main_words < 80) AS n_thin, count(*) FILTER (n_internal < 5) AS n_sparse, count(*) FILTER (has_contact) AS n_with_contact, bool_or(has_policy) AS has_policy_path FROM ({_FACTS}) GROUP BY 1) a
LEFT JOIN (SELECT site, sum(n)::BIGINT AS n_shared_titles FROM (SELECT site, name, count(*) AS n FROM ({_FACTS}) WHERE name <> '' GROUP BY 1, 2 HAVING count(*) > 1) GROUP BY 1) b USING (site)
LEFT JOIN (SELECT site, count(DISTINCT digits) AS n_phones FROM ({X.SQL['contact_facts']}) GROUP BY 1) c USING (site)
LEFT JOIN (SELECT site, max(crawl_delay) AS crawl_delay FROM robots_rule WHERE agent IN ('*', 'CiteCrawler', 'Googlebot', 'Bingbot') GROUP BY 1) e USING (site) LEFT JOIN ({C.SQL['robots_blanket']}) z USING (site)
LEFT JOIN (SELECT site, n_broken, rate AS broken_rate FROM ({C.SQL['broken_links']})) f USING (site) LEFT JOIN (SELECT * EXCLUDE (n_pages) FROM ({C.SQL['sitemap_coverage']})) g USING (site) LEFT JOIN ({C.SQL['response_times']}) h USING (site)"""


def _fired(rules, source: str, key: str) -> str:
    return " UNION ALL ".join(f"SELECT {key}, '{c.check_id}' AS check_id, CAST({c.measure} AS BIGINT) AS measure FROM {source} WHERE {c.condition}" for c in rules)


def _field(name: str) -> str:
    return "CASE check_id " + " ".join(f"WHEN '{c.check_id}' THEN '{getattr(c, name)}'" for c in checks.CATALOGUE.values()) + " END"


_ORDER = "CASE check_id " + " ".join(f"WHEN '{c.check_id}' THEN {i}" for i, c in enumerate(checks.CATALOGUE.values())) + " END"
_RX = C._RX
_BLOB = _BLOCKS
_OBSERVED = X._BODY
_HEAD = f"substr({_OBSERVED}, 1, 400)"
_LOWER = "lower(coalesce(text, ''))"
_FLAT_FIELDS = "flatten(list_transform(coalesce(forms, []), lambda f: coalesce(f.fields, [])))"
_YEARS = r"list_transform(regexp_extract_all(coalesce(text, ''), '(?i)(?:©|copyright|\(c\)) ?([0-9]{4})', 1), lambda y: y::INT)"
_ACCEPTED = "MAP {" + ", ".join(f"'{k}': [{', '.join(repr(t) for t in v.split())}]" for k, v in deep_checks.ACCEPTED.items()) + "}"
_ANY = lambda text, words: "(" + " OR ".join(f"contains({text}, '{w}')" for w in words) + ")"
_CONTENT = f"""SELECT page_id, site, url, page_type, confidence, coalesce(status, 0) AS status, {X._WORDS.format(_OBSERVED)} AS n_words, {_MWC} AS main_words, len({X._TOKENS.format(_OBSERVED)}) AS n_tokens,
 {X._match(_HEAD, 'speaks_to')} AND NOT {X._match(_HEAD, 'vague_opener')} AS speaks, {X._match(_OBSERVED, 'proof')} AS proven, {X._match(_OBSERVED, 'volatile_fact')} AS changes, coalesce(date_diff('day', list_max({X._DAYS}), crawled_at::DATE), -1) AS newest_age,
 {X._match(_OBSERVED, 'author_hint')} OR contains({_BLOB}, '"author"') AS authored, {X._match("coalesce(text, '')", 'directive')} AS directs, {X._match(_OBSERVED, 'prior_context')} AS assumes,
 len(list_filter({_FLAT_FIELDS}, lambda x: coalesce(x.required, false) AND coalesce(lower(x.name) IN ('phone', 'tel', 'company', 'organisation', 'organization', 'job_title', 'jobtitle', 'dob', 'date_of_birth', 'birthday', 'address1', 'address_line_1', 'street', 'postcode', 'zip', 'fax'), false))) AS n_friction,
 len(list_filter(({X._SENTENCES.format(f'substr({_OBSERVED}, 1, 900)')})[1:5], lambda s: {X._match('s', 'definitional')} AND len({X._TOKENS.format('s')}) <= 50)) > 0 AS defined, {X._match('meta_description', 'definitional')} AS described,
 len({_DECLARED}) AS n_types, coalesce(list_has_any({_DECLARED}, {_ACCEPTED}[page_type]), false) AS accepted, list_contains({_DECLARED}, 'faqpage') AS faq,
 CASE page_type WHEN 'product' THEN NOT (regexp_matches({_BLOB}, '"(name|headline|legalName)"') AND regexp_matches({_BLOB}, '"(price|lowPrice|highPrice)"') AND contains({_BLOB}, '"priceCurrency"')) WHEN 'article' THEN NOT (regexp_matches({_BLOB}, '"(headline|name|title)"') AND regexp_matches({_BLOB}, '"(datePublished|dateCreated|uploadDate)"'))
  WHEN 'docs' THEN NOT regexp_matches({_BLOB}, '"(headline|name|title)"') WHEN 'home' THEN NOT regexp_matches({_BLOB}, '"(name|headline|legalName)"') WHEN 'pricing' THEN NOT regexp_matches({_BLOB}, '"(name|headline|legalName)"') ELSE false END AS lacks_property, {_HAS('organization', 'localbusiness', 'corporation', 'website')} AS identity, contains({_BLOB}, '"sameAs"') AS same_as, contains({_BLOB}, '"description"') AS blob_described,
 len(list_filter(['wikipedia.org', 'wikidata.org', 'crunchbase.com', 'linkedin.com', 'github.com', 'companieshouse.gov.uk', 'sec.gov', 'opencorporates.com', 'gov.uk', 'europa.eu', 'doi.org', 'orcid.org', 'scholar.google.com', 'bloomberg.com', 'reuters.com'], lambda h: contains({_BLOB}, h))) AS n_authorities,
 {_ANY(_LOWER, ('about', 'who we are', 'what we do'))} AS about, {_ANY(_LOWER, ('get started', 'sign up', 'start free', 'try ', 'buy ', 'book ', 'contact', 'subscribe', 'download', 'request', 'learn more', 'demo', 'order', 'shop'))} AS offers,
 length(substr({_LOWER}, 1, 600)) < 120 OR len(list_filter(['we ', 'our ', 'provides', 'helps', 'platform', 'software', 'service', 'company', 'for ', 'solution', 'tool', 'app'], lambda w: contains(substr({_LOWER}, 1, 600), w))) < 2 AS vague, {X._count("coalesce(text, '')", 'superlative')} AS n_superlatives,
 len(list_filter({_YEARS}, lambda y: y > 2000 AND y < year(crawled_at) - 1)) > 0 AS old_copyright, length(coalesce(text, '')) AS n_chars, len(list_filter(coalesce(headings, []), lambda h: coalesce(ends_with(trim(h.text), '?'), false))) > 0 AS asks, coalesce(starts_with(lower(url), 'http://'), false) AS insecure
FROM page JOIN ({_KIND}) kinds USING (page_id)"""
_IMAGES, _ALTS = "len(regexp_extract_all(html, '(?i)<img[ \\t\\r\\n/>]'))", "len(regexp_extract_all(html, '(?i)<img[^>]* alt=[\"''][^\"'']*[^\"'' ][^\"'']*[\"'']'))"
_MARKUP = f"""SELECT url, bool_or({X._match('html', 'directive')}) AS markup_directs, max({X._count('html', 'hidden_style')}) AS n_hidden, bool_or({X._match('html', 'modal_on_load')}) AS interrupts, max({X._count('html', 'gated')}) AS n_gated, bool_or({X._match('html', 'plain_source')}) AS mixed,
 bool_or({_IMAGES} >= 3 AND {_IMAGES} - {_ALTS} > 0.6 * {_IMAGES}) AS no_alt, bool_or({X._match('html', 'autoplay')}) AS intrusive, bool_or(regexp_matches(html, '<(ul|ol|table)[ >]', 'i')) AS structured, max(length(html)) AS n_markup FROM (SELECT DISTINCT ON (fetch_id) * FROM page_raw WHERE html IS NOT NULL AND url IS NOT NULL) GROUP BY 1"""
_FALSE = lambda *names: ", ".join(f"coalesce({n}, false) AS {n}" for n in names)
_DEEP = f"""SELECT c.*, {_FALSE('markup_directs', 'interrupts', 'mixed', 'no_alt', 'intrusive', 'structured')}, {_NUM('n_hidden')} AS n_hidden, {_NUM('n_gated')} AS n_gated, {_NUM('n_markup')} AS n_markup, k.page_id IS NOT NULL AS canonical_conflict, {_LIMITS}
FROM ({_CONTENT}) c LEFT JOIN ({_MARKUP}) m USING (url) LEFT JOIN (SELECT DISTINCT page_id FROM ({C.SQL['canonical_conflicts']})) k ON k.page_id = c.page_id LEFT JOIN ({_SCORED}) a ON a.site = c.site"""
_SHUT = f"""SELECT site, count(DISTINCT agent) FILTER (agent = 'CiteCrawler') AS n_retrieval, count(DISTINCT agent) FILTER (agent = 'IndexMoth') AS n_training, count(DISTINCT agent) FILTER (agent = 'NarrowBot') AS n_dual_purpose FROM (
 SELECT p.site, p.path, o.agent, arg_max(r.allow, (length(r.pattern), r.allow::INT, -r.line_no)) AS allow FROM (SELECT DISTINCT site, {C._path()} AS path FROM page WHERE url IS NOT NULL) p
 JOIN (SELECT site, agent, min(group_no) AS group_no FROM robots_rule WHERE agent IN ('CiteCrawler', 'IndexMoth', 'NarrowBot') GROUP BY 1, 2) o USING (site) JOIN (SELECT *, {_RX} AS rx FROM robots_rule WHERE pattern <> '') r ON r.site = o.site AND r.group_no = o.group_no AND regexp_matches(p.path, r.rx) GROUP BY 1, 2, 3) WHERE NOT allow GROUP BY 1"""
_FILES = """SELECT site, coalesce(bool_or(status BETWEEN 200 AND 299 AND regexp_matches(url, '/robots\\.txt$')), false) AS robots_answers, coalesce(bool_or(status BETWEEN 200 AND 299 AND regexp_matches(url, '/robots\\.txt$') AND coalesce(contains(lower(content_type), 'html'), false)), false) AS robots_is_html,
 coalesce(bool_or(status BETWEEN 200 AND 299 AND regexp_matches(url, '/llms\\.txt$')), false) AS has_llms, count(DISTINCT url) FILTER (tls_error IS NOT NULL) AS n_tls_errors, coalesce(max(list_max(ttfb_ms)), 0) AS slowest_ms FROM page_raw WHERE url IS NOT NULL GROUP BY 1"""
_CHAINS = "SELECT site, count(DISTINCT url) AS n_chains FROM page_raw WHERE len(hops) > 2 OR len(list_distinct(list_transform(hops, lambda h: h.url))) < len(hops) GROUP BY 1"
_NAMES = f"SELECT site, list_has_any(w, [{', '.join(repr(x) for x in deep_checks.COLLIDING)}]) OR (len(w) = 1 AND length(w[1]) < 6) AS shared_name FROM (SELECT site, regexp_extract_all(lower(brand), '[a-z]+') AS w FROM ({{brands}}))"
_BRANDS = r"""SELECT site, part AS brand, n AS n_pages FROM (SELECT *, row_number() OVER (PARTITION BY site ORDER BY n DESC, length(part), part) AS r FROM (
 SELECT site, part, count(DISTINCT page_id) AS n FROM (SELECT site, page_id, unnest(p) AS part FROM (SELECT site, page_id, list_filter(list_transform(string_split_regex(title, ' [|\-–—·:] '), lambda x: trim(x)), lambda x: x <> '') AS p FROM page WHERE title IS NOT NULL) WHERE len(p) > 1) GROUP BY 1, 2)) WHERE r = 1"""
_HOME = lambda c, name: f"coalesce(bool_or(page_type = 'home' AND {c}), false) AS {name}"
_ACCESS = f"""SELECT b.*, {_NUM('n_retrieval')} AS n_retrieval, {_NUM('n_training')} AS n_training, {_NUM('n_dual_purpose')} AS n_dual_purpose, {_FALSE('robots_answers', 'robots_is_html', 'has_llms', 'shared_name')}, {_NUM('n_tls_errors')} AS n_tls_errors, {_NUM('slowest_ms')} AS slowest_ms, {_NUM('n_chains')} AS n_chains, r.site IS NOT NULL AS has_rules
FROM (SELECT site, count(*) AS n_pages, first(archetype) AS archetype, bool_or(page_type = 'home') AS has_home, {_HOME('identity', 'home_identity')}, {_HOME('same_as', 'home_same_as')}, {_HOME('blob_described', 'home_described')}, {_HOME('about', 'home_about')}, {_HOME('vague', 'home_vague')},
 coalesce(max(n_authorities) FILTER (page_type = 'home'), 0) AS n_authorities, count(*) FILTER (insecure) AS n_insecure, count(*) FILTER (mixed) AS n_mixed, count(*) FILTER (no_alt) AS n_no_alt, count(*) FILTER (n_chars < 300 AND n_markup > 1500) AS n_near_empty, count(*) FILTER (old_copyright) AS n_old_copyright,
 sum(n_superlatives)::BIGINT AS n_superlatives, count(*) FILTER (faq) AS n_faq, count(*) FILTER (n_chars >= 800) AS n_substantial, count(*) FILTER (n_chars >= 800 AND NOT structured AND NOT asks) AS n_walls, count(*) FILTER (directs OR markup_directs) AS n_directing, count(*) FILTER (n_hidden >= 3) AS n_hiding,
 count(*) FILTER (NOT offers) AS n_no_offer, count(*) FILTER (intrusive) AS n_intrusive FROM ({_DEEP}) GROUP BY 1) b
LEFT JOIN ({_SHUT}) s USING (site) LEFT JOIN ({_FILES}) f USING (site) LEFT JOIN ({_CHAINS}) h USING (site) LEFT JOIN ({_NAMES.format(brands=_BRANDS)}) n USING (site) LEFT JOIN (SELECT DISTINCT site FROM robots_rule) r ON r.site = b.site"""
_RAISED = f"""facts AS ({_LIMITED}), sites AS ({_SITE}), deep AS (SELECT * FROM ({_DEEP}) WHERE status = 200), access AS ({_ACCESS}), raised AS (
 SELECT site, check_id, page_id AS spot, url, 'url' AS scope FROM ({_fired(checks.PAGE_CHECKS, 'facts', 'site, url, page_id')})
 UNION ALL SELECT site, check_id, 0, NULL, 'site' FROM ({_fired(checks.SITE_CHECKS, 'sites', 'site')})
 UNION ALL SELECT site, check_id, page_id, url, 'url' FROM ({_fired(deep_checks.PAGE_CHECKS, 'deep', 'site, url, page_id')})
 UNION ALL SELECT site, check_id, 0, NULL, 'site' FROM ({_fired(deep_checks.SITE_CHECKS, 'access', 'site')})),
numbered AS (SELECT *, {_ORDER} * 281474976710656 + spot AS seq, {_field('severity')} AS severity, {_field('confidence')} AS confidence, {_field('stage')} AS stage, {_field('effort')} AS effort FROM raised),
sized AS (SELECT site, count(*) AS n_pages FROM page GROUP BY 1),
wide AS (SELECT site, check_id, min(seq) AS speaker, count(*) AS n, count(DISTINCT url) AS n_urls, min(url) AS first_url FROM numbered JOIN sized USING (site) WHERE scope = 'url' AND n_pages >= 5 GROUP BY site, check_id, n_pages HAVING count(*) >= 5 AND count(DISTINCT url) >= 0.5 * n_pages),
kept AS (SELECT numbered.* EXCLUDE (scope, url), CASE WHEN w.n IS NULL THEN scope ELSE 'site' END AS scope, coalesce(w.n, 1) AS n_collapsed, CASE WHEN w.n IS NOT NULL THEN w.n_urls WHEN url IS NULL THEN 0 ELSE 1 END AS n_urls, coalesce(w.first_url, url) AS first_url
 FROM numbered LEFT JOIN wide w ON w.site = numbered.site AND w.check_id = numbered.check_id WHERE w.n IS NULL OR seq = w.speaker)"""
_STAGE = "CASE stage WHEN 'reach' THEN 0 WHEN 'read' THEN 1 WHEN 'extract' THEN 2 WHEN 'trust' THEN 3 ELSE 4 END"
_SEV = "CASE severity WHEN 'critical' THEN 4 WHEN 'high' THEN 3 WHEN 'medium' THEN 2 WHEN 'low' THEN 1 ELSE 0 END"
_ICE = "round((CASE severity WHEN 'critical' THEN 10 WHEN 'high' THEN 8 WHEN 'medium' THEN 5 WHEN 'low' THEN 3 ELSE 1 END + CASE confidence WHEN 'confirmed' THEN 9 WHEN 'likely' THEN 6 ELSE 3 END + CASE effort WHEN 'low' THEN 9 WHEN 'medium' THEN 5 ELSE 2 END) / 3.0::DOUBLE, 1)"
_PLACE = f"ORDER BY {_SEV} DESC, ice DESC, {_STAGE}, check_id, coalesce(first_url, ''), seq"
_URL_LIST = "CASE WHEN kept.n_collapsed > 1 THEN (SELECT list(DISTINCT url) FROM numbered x WHERE x.site = kept.site AND x.check_id = kept.check_id) WHEN kept.first_url IS NULL THEN [] ELSE [kept.first_url] END"
_RANKED = f"""{_RAISED},
scored AS (SELECT kept.*, {_ICE} AS ice, {_STAGE} AS sr, {_URL_LIST} AS urls FROM kept),
placed AS (SELECT *, row_number() OVER (PARTITION BY site {_PLACE}) AS place FROM scored),
always AS (SELECT site, sr, arg_min(seq, place) AS blocker FROM placed WHERE stage <> 'act' AND severity = 'critical' AND (check_id IN {O.SITE_CLOSERS} OR (check_id NOT IN {O.URL_CLOSERS} AND scope = 'site')) GROUP BY 1, 2),
highs AS (SELECT site, sr, arg_min(seq, (check_id, place)) AS blocker FROM placed WHERE stage <> 'act' AND severity = 'high' AND scope = 'site' AND check_id NOT IN {O.URL_CLOSERS} GROUP BY 1, 2 HAVING count(*) >= 2),
bysite AS (SELECT site, sr, coalesce(always.blocker, highs.blocker) AS blocker FROM always FULL JOIN highs USING (site, sr)),
byurl AS (SELECT site, u, sr, arg_min(seq, place) AS blocker FROM (SELECT site, sr, seq, place, unnest(urls) AS u FROM placed WHERE check_id IN {O.URL_CLOSERS} AND severity IN ('critical', 'high')) GROUP BY 1, 2, 3),
moot AS (SELECT site, seq, arg_min(blocker, (csr, is_url)) AS blocked_seq, min(csr) AS csr FROM (
 SELECT p.site, p.seq, b.sr AS csr, 0 AS is_url, b.blocker FROM placed p JOIN bysite b ON b.site = p.site AND b.sr < p.sr WHERE p.stage <> 'act'
 UNION ALL SELECT p.site, p.seq, b.sr, 1, arg_min(b.blocker, b.u) FROM (SELECT site, seq, sr, len(urls) AS n, unnest(urls) AS u FROM placed WHERE stage <> 'act') p JOIN byurl b ON b.site = p.site AND b.u = p.u AND b.sr < p.sr GROUP BY p.site, p.seq, b.sr, p.n HAVING count(*) = p.n) GROUP BY 1, 2),
capped AS (SELECT placed.* EXCLUDE (severity, confidence, ice, place), b.blocked_seq, CASE WHEN b.blocked_seq IS NOT NULL AND severity IN ('high', 'critical') THEN 'medium' ELSE severity END AS severity,
 CASE WHEN b.blocked_seq IS NOT NULL AND b.csr = 1 AND stage IN ('extract', 'trust') THEN CASE confidence WHEN 'confirmed' THEN 'likely' ELSE 'hypothesis' END ELSE confidence END AS confidence
 FROM placed LEFT JOIN moot b ON b.site = placed.site AND b.seq = placed.seq AND b.blocked_seq <> placed.seq),
rescored AS (SELECT *, {_ICE} AS ice FROM capped), final AS (SELECT *, 'F-' || lpad(CAST(row_number() OVER (PARTITION BY site {_PLACE}) AS VARCHAR), 3, '0') AS finding_id FROM rescored)"""

SQL = {
    "page_types": _KIND,
    "site_signals": _SIGNALS,
    "site_archetypes": _SCORED,
    "page_facts": f"SELECT * EXCLUDE (url, name) FROM ({_FACTS})",
    "page_findings": f"WITH facts AS ({_LIMITED}) {_fired(checks.PAGE_CHECKS, 'facts', 'page_id')}",
    "site_facts": _SITE,
    "deep_facts": f"SELECT * EXCLUDE (url) FROM ({_DEEP})",
    "deep_page_findings": f"WITH deep AS (SELECT * FROM ({_DEEP}) WHERE status = 200) {_fired(deep_checks.PAGE_CHECKS, 'deep', 'page_id')}",
    "access_facts": _ACCESS,
    "deep_site_findings": f"WITH access AS ({_ACCESS}) {_fired(deep_checks.SITE_CHECKS, 'access', 'site')}",
    "legacy_deep_findings": f"WITH access AS ({_ACCESS}) {_fired(deep_checks.LEGACY_CHECKS, 'access', 'site')}",
    "site_findings": f"WITH sites AS ({_SITE}) {_fired(checks.SITE_CHECKS, 'sites', 'site')}",
    "suppression_counts": f"""WITH facts AS ({_FACTS}) SELECT site, check_id, reason, count(*) AS n FROM (SELECT site, '*' AS check_id, 'page did not answer 200' AS reason FROM facts WHERE status <> 200
 UNION ALL SELECT site, 'extract.ans.thin_content_for_page_type', 'utility page' FROM facts WHERE page_type = 'utility' UNION ALL SELECT site, 'extract.sd.absent_on_eligible_page', 'below the word floor' FROM facts WHERE words < 200
 UNION ALL SELECT site, 'extract.ans.no_evidence_markers', 'below the word floor' FROM facts WHERE main_words < 400 UNION ALL SELECT site, 'trust.date.signals_disagree', 'fewer than two dates' FROM facts WHERE n_dates < 2) GROUP BY 1, 2, 3""",
    "collapsed_findings": f"WITH {_RAISED} SELECT site, check_id, severity, scope, n_collapsed, n_urls FROM kept",
    "ranked_findings": f"WITH {_RANKED} SELECT f.site, f.finding_id, f.check_id, f.severity, f.confidence, f.scope, f.ice, CASE WHEN f.severity = 'info' THEN 'low' ELSE f.severity END AS priority, b.finding_id AS blocked_by, coalesce(f.first_url, '') AS first_url FROM final f LEFT JOIN final b ON b.site = f.site AND b.seq = f.blocked_seq",
    "finding_counts": f"WITH {_RANKED}, c AS (SELECT *, CASE WHEN stage = 'act' THEN 'engagement' ELSE 'discoverability' END AS category FROM final) SELECT site, 'severity' AS dimension, severity AS value, count(*) AS n FROM c GROUP BY ALL UNION ALL SELECT site, 'stage', stage, count(*) FROM c GROUP BY ALL UNION ALL SELECT site, 'category', category, count(*) FROM c GROUP BY ALL",
    "gate_notes": f"WITH {_RANKED} SELECT f.site, b.finding_id AS blocked_by, count(*) AS n_blocked FROM final f JOIN final b ON b.site = f.site AND b.seq = f.blocked_seq GROUP BY 1, 2",
    "parsed_pages": """SELECT fetch_id, trim(regexp_replace(replace(replace(replace(replace(replace(regexp_extract(html, '<title>([^<]*)</title>', 1), '&lt;', '<'), '&gt;', '>'), '&quot;', '"'), '&#x27;', chr(39)), '&amp;', '&'), '[ \\t\\r\\n\\f\\v\\x{a0}\\x{1680}\\x{2000}-\\x{200a}\\x{2028}\\x{2029}\\x{202f}\\x{205f}\\x{3000}]+', ' ', 'g')) AS title,
 len(regexp_extract_all(html, '<h[1-6]>')) AS n_headings, len(regexp_extract_all(html, '<a href=')) AS n_anchors, len(regexp_extract_all(html, '<script type="application/ld.json">')) - len(regexp_extract_all(html, '<script type="application/ld.json">[ \\t\\r\\n]*</script>')) AS n_blocks, len(regexp_extract_all(html, '<script')) AS n_scripts
FROM (SELECT DISTINCT ON (fetch_id) * FROM page_raw WHERE html IS NOT NULL)""",
}
