"""Site profiles: page types, archetype scores and thresholds."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sitewarp.functions import text as T
from sitewarp.functions import urls as U

# Page types by declared type, weights of site signals, what an archetype needs, and thresholds.
DECLARED = {"product": "product", "offer": "product", "itemlist": "category", "article": "article", "newsarticle": "article", "blogposting": "article", "techarticle": "docs", "apireference": "docs", "howto": "docs", "contactpage": "contact", "aboutpage": "about", "faqpage": "other", "collectionpage": "category"}
WEIGHTS = {
    "e-commerce": {"schema_product": 3.0, "has_price": 2.0, "cart_path": 2.5, "many_product_urls": 2.0, "add_to_cart_text": 2.0},
    "docs": {"docs_path_share": 3.0, "schema_techarticle": 2.0, "code_blocks": 1.5, "long_pages": 1.0},
    "developer-platform": {"docs_path_share": 1.5, "api_path": 2.5, "code_blocks": 2.0, "github_link": 1.5, "schema_techarticle": 1.0},
    "publisher": {"schema_article": 2.5, "many_article_urls": 2.5, "bylines": 2.0, "dated_pages": 1.5},
    "local-business": {"schema_localbusiness": 3.5, "opening_hours": 2.5, "postal_address": 1.0, "phone_number": 0.5, "small_site": 0.5},
    "saas-marketing": {"pricing_page": 2.0, "trial_cta": 2.0, "schema_softwareapp": 2.0, "feature_pages": 1.0, "no_cart": 0.5},
}
NEEDS = {"e-commerce": ("cart_path", "add_to_cart_text", "many_product_urls"), "local-business": ("schema_localbusiness", "opening_hours"), "publisher": ("many_article_urls",), "docs": ("docs_path_share", "schema_techarticle")}
LEAST_SCORE, UNDECIDED = 3.0, 0.3
THIN = {"home": 120, "product": 120, "category": 60, "article": 300, "docs": 200, "pricing": 120, "contact": 40, "about": 100, "utility": 0, "other": 150}
THIN_BY_ARCHETYPE = {"docs": {"docs": 150, "article": 250, "category": 40}, "developer-platform": {"docs": 150, "article": 250}, "saas-marketing": {"home": 100, "pricing": 100, "product": 100, "other": 120}, "e-commerce": {"product": 80, "category": 40, "home": 100}, "publisher": {"article": 350, "category": 50, "home": 100}, "local-business": {"home": 80, "about": 60, "contact": 30, "other": 80}}

FIELDS = {"contact": 8, "pricing": 5, "home": 5, "product": 6, "utility": 30, "other": 7}
FIELDS_BY_ARCHETYPE = {"saas-marketing": {"contact": 7, "pricing": 4, "home": 4}, "e-commerce": {"utility": 30, "contact": 8}}
STALE_DAYS, STALE_BY_ARCHETYPE = 540, {"docs": 730, "publisher": 365}
EVIDENCE_WORDS, EVIDENCE_BY_ARCHETYPE = 400, {"docs": 800, "developer-platform": 800}
BOILERPLATE, BOILERPLATE_BY_ARCHETYPE = 0.7, {"e-commerce": 0.8}


#: Columns of ``with_kind``.
TYPES, KIND = "__types", "__kind"


def with_kind(page: DataFrame) -> DataFrame:
    """``page`` with its declared types and kind as columns, for readers that need them more than once: each is worked out once a row."""
    typed = page.withColumn(TYPES, declared_types(page))
    return typed.withColumn(KIND, kind_of(typed))


def declared_types(page: DataFrame, column: str = "markup") -> Column:
    """Lower-cased distinct ``@type`` values of a page's JSON-LD texts, single or in arrays, without their vocabulary's address; by
    pattern, so blocks need not be well-formed."""
    if TYPES in page.columns:
        return F.col(TYPES)
    blocks = F.coalesce(F.array_join(F.col(f"{column}.jsonld"), "\n"), F.lit(""))
    values = F.regexp_extract_all(blocks, F.lit(r'"@type"[ \t\r\n]*:[ \t\r\n]*(\[[^\]]*\]|"[^"]*")'), F.lit(1))
    names = F.flatten(F.transform(values, lambda v: F.regexp_extract_all(v, F.lit('"([^"]*)"'), F.lit(1))))
    found = F.transform(names, lambda t: F.lower(F.regexp_extract(t, r"([^/#:]*)\z", 1)))
    return F.array_sort(F.array_distinct(F.filter(found, lambda t: t != "")))


def kind_of(page: DataFrame) -> Column:
    """struct(page_type, confidence) of a page row: sure paths first, then declared types, softer paths, and the page's shape."""
    if KIND in page.columns:
        return F.col(KIND)
    url, types = F.coalesce("url", F.lit("")), declared_types(page)
    table = F.create_map(*(F.lit(x) for kv in DECLARED.items() for x in kv))
    hint = F.get(F.filter(F.transform(types, lambda t: F.element_at(table, t)), lambda x: x.isNotNull()), F.lit(0))
    fields = F.aggregate(F.coalesce(F.transform("forms", lambda f: F.coalesce(F.size(f["fields"]), F.lit(0))), F.array().cast("array<int>")), F.lit(0), lambda a, b: a + b)
    typed = lambda name, confidence: F.struct(name.alias("page_type"), F.lit(confidence).alias("confidence"))
    shape = F.when(F.coalesce(F.col("status"), F.lit(0)) != 200, typed(F.lit("utility"), 0.5)).when((F.col("wordcount") >= 400) & (F.coalesce("dates.schema_published", F.lit("")) != ""), typed(F.lit("article"), 0.65)).when(F.col("wordcount") >= 500, typed(F.lit("article"), 0.5)).when(fields >= 3, typed(F.lit("contact"), 0.45)).otherwise(typed(F.lit("other"), 0.35))
    return F.coalesce(U.path_type(url, U.SURE), F.when(hint.isNotNull(), typed(hint, 0.92)), U.path_type(url), shape)


def page_type(page: DataFrame) -> DataFrame:
    """(page_id, site, url, page_type, confidence) of every page row."""
    kind = kind_of(page)
    return page.select("page_id", "site", "url", kind["page_type"].alias("page_type"), kind["confidence"].alias("confidence"))


def site_signals(page: DataFrame) -> DataFrame:
    """One row of booleans per site. Per-page facts are folded with partial aggregation: one shuffle of one row per task and site."""
    page = with_kind(page)
    typed = page.withColumn("page_type", kind_of(page)["page_type"])
    body, p, types = F.coalesce("main_text", F.lit("")), F.lower(U.path(F.coalesce("url", F.lit("")))), declared_types(page)
    has = lambda *names: F.arrays_overlap(types, F.array(*map(F.lit, names)))
    facts = typed.select(
        "site", "page_type", "main_wordcount", (F.coalesce("dates.schema_published", F.lit("")) != "").alias("dated"),
        has("product", "offer").alias("schema_product"), has("article", "newsarticle", "blogposting").alias("schema_article"), has("techarticle", "apireference", "howto").alias("schema_techarticle"),
        has("localbusiness", "store", "restaurant", "dentist", "medicalclinic").alias("schema_localbusiness"), has("softwareapplication", "saas").alias("schema_softwareapp"),
        T.matches(body, "price").alias("has_price"), p.rlike("/cart|/checkout|/basket").alias("cart_path"), T.matches(body, "cart").alias("add_to_cart_text"), p.rlike("/doc|/guide|/reference").alias("docs_path"), p.contains("/api").alias("api_path"),
        body.rlike("npm install|pip install|INFORMATION_SCHEMA").alias("code_blocks"), F.coalesce(F.exists("links.external", lambda x: x.contains("github.com")), F.lit(False)).alias("github_link"), T.matches(body, "byline").alias("bylines"),
        T.matches(body, "postal_code").alias("postal_address"), T.matches(body, "phone").alias("phone_number"), T.matches(body, "opening_hours").alias("opening_hours"), T.matches(body, "trial").alias("trial_cta"), p.rlike("/feature|/solution|/platform").alias("feature_pages"),
    )
    any_of = ("schema_product", "schema_article", "schema_techarticle", "schema_localbusiness", "schema_softwareapp", "has_price", "cart_path", "add_to_cart_text", "api_path", "code_blocks", "github_link", "bylines", "postal_address", "phone_number", "opening_hours", "trial_cta", "feature_pages")
    share = lambda c: F.avg(c.cast("double"))
    return facts.groupBy("site").agg(
        F.count("*").alias("n_pages"), *(F.coalesce(F.bool_or(c), F.lit(False)).alias(c) for c in any_of),
        (share(F.col("page_type") == "product") >= 0.25).alias("many_product_urls"), (share(F.col("page_type") == "article") >= 0.35).alias("many_article_urls"), (share(F.col("docs_path")) >= 0.25).alias("docs_path_share"), (share(F.col("dated")) >= 0.3).alias("dated_pages"),
        (share(F.coalesce(F.col("main_wordcount"), F.lit(0)) > 400) >= 0.4).alias("long_pages"), (F.count("*") <= 8).alias("small_site"), F.bool_or(F.col("page_type") == "pricing").alias("pricing_page"), (~F.coalesce(F.bool_or("cart_path"), F.lit(False))).alias("no_cart"),
    )


def archetypes(signals: DataFrame) -> DataFrame:
    """(site, archetype, score, confidence): the best weighted archetype, ``other`` below the least score; ties by name."""
    scored = []
    for name, weights in WEIGHTS.items():
        total = sum((F.when(F.col(s), F.lit(w)).otherwise(F.lit(0.0)) for s, w in weights.items()), F.lit(0.0))
        if name in NEEDS:
            needed = F.col(NEEDS[name][0])
            for other in NEEDS[name][1:]:
                needed = needed | F.col(other)
            total = F.when(needed, total).otherwise(F.lit(0.0))
        scored.append(F.struct((-total).alias("minus"), F.lit(name).alias("name")))
    ranks = F.array_sort(F.array(*scored))
    best, second = -ranks[0]["minus"], -ranks[1]["minus"]
    sure = best >= LEAST_SCORE
    confidence = F.round(F.least(F.lit(0.95), 0.55 + 0.45 * (best - second) / best), 2)
    return signals.select("site", F.when(sure, ranks[0]["name"]).otherwise(F.lit("other")).alias("archetype"), best.alias("score"), F.when(sure, confidence).otherwise(F.lit(UNDECIDED)).alias("confidence"))


def _by_kind(archetype: Column, kind: Column, own: dict[str, dict[str, int]], common: dict[str, int]) -> Column:
    entries = {f"{a} {k}": n for a, t in own.items() for k, n in t.items()} | common
    table = F.create_map(*(F.lit(x) for kv in entries.items() for x in kv))
    return F.coalesce(F.try_element_at(table, F.concat_ws(" ", archetype, kind)), F.try_element_at(table, kind), F.lit(common["other"])).cast("bigint")


def _by_archetype(archetype: Column, own: dict, common) -> Column:
    return F.coalesce(F.try_element_at(F.create_map(*(F.lit(x) for kv in own.items() for x in kv)), archetype), F.lit(common))


def with_limits(rows: DataFrame, archetypes: DataFrame) -> DataFrame:
    """``rows`` (site, page_type, ...) with their site's archetype and the limits that go with it and the page type. A site without
    archetype is ``other``. Archetypes are one row per site."""
    out = rows.join(archetypes.select("site", "archetype"), "site", "left").withColumn("archetype", F.coalesce("archetype", F.lit("other")))
    a, k = F.col("archetype"), F.col("page_type")
    return out.withColumns({
        "thin_limit": _by_kind(a, k, THIN_BY_ARCHETYPE, THIN), "fields_limit": _by_kind(a, k, FIELDS_BY_ARCHETYPE, FIELDS), "stale_days": _by_archetype(a, STALE_BY_ARCHETYPE, STALE_DAYS).cast("bigint"),
        "evidence_words": _by_archetype(a, EVIDENCE_BY_ARCHETYPE, EVIDENCE_WORDS).cast("bigint"), "boilerplate_limit": _by_archetype(a, BOILERPLATE_BY_ARCHETYPE, BOILERPLATE),
    })
