"""Queries of the flat rule set, structured data, preflight and render budget, with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sitewarp.functions import text as T
from sitewarp.operators import content, crawling, links, markup, shredding
from sitewarp.plans import audit_queries as A
from sitewarp.plans import checks, legacy_checks
from sitewarp.plans import crawl_queries as C
from sitewarp.session import table
from sitewarp.sources import html


def legacy_site_counts(spark: SparkSession, d: str) -> DataFrame:
    page = table(spark, d, "page")
    return legacy_checks.site_counts(checks.page_facts(page), page)


def legacy_findings(spark: SparkSession, d: str) -> DataFrame:
    return checks.fired(legacy_site_counts(spark, d), legacy_checks.CHECKS, ["site"])


def jsonld_types(spark: SparkSession, d: str) -> DataFrame:
    """Pages per declared type."""
    return markup.declared(shredding.page_leaves(table(spark, d, "page"))).groupBy("type").agg(F.count("*").alias("n_pages"))


def dangling_ids(spark: SparkSession, d: str) -> DataFrame:
    return markup.dangling_references(shredding.page_leaves(table(spark, d, "page")))


def profile_hosts(spark: SparkSession, d: str) -> DataFrame:
    page = table(spark, d, "page")
    return markup.profile_hosts(shredding.page_leaves(page), page)


def jsonld_headlines(spark: SparkSession, d: str) -> DataFrame:
    """Name or headline at the top of each page's blocks that parse."""
    blocks = table(spark, d, "page").select("page_id", F.posexplode("markup.jsonld").alias("block", "text"))
    name = F.coalesce(markup.at_path(F.col("text"), "headline"), markup.at_path(F.col("text"), "name"))
    return blocks.select("page_id", "block", name.alias("name")).where("name is not null")


def site_preflight(spark: SparkSession, d: str) -> DataFrame:
    return crawling.preflight(table(spark, d, "page_raw"))


def render_budget(spark: SparkSession, d: str) -> DataFrame:
    return crawling.render_budget(links.merged_frontier(table(spark, d, "frontier")))


QUERIES = {f.__name__: f for f in (legacy_site_counts, legacy_findings, jsonld_types, dangling_ids, profile_hosts, jsonld_headlines, site_preflight, render_budget)}

_COUNTS = f"""SELECT a.*, coalesce(t.n, 0)::BIGINT AS n_same_title, coalesce(e.n, 0)::BIGINT AS n_same_description FROM (SELECT site, count(*) AS n_pages, {', '.join(f'count(*) FILTER ({c}) AS {n}' for n, c in legacy_checks.COUNTED)} FROM ({A._FACTS}) GROUP BY 1) a
LEFT JOIN (SELECT site, sum(n) AS n FROM (SELECT site, lower(trim(title)) AS t, count(*) AS n FROM page WHERE trim(title) <> '' GROUP BY 1, 2 HAVING count(*) > 1) GROUP BY 1) t USING (site)
LEFT JOIN (SELECT site, sum(n) AS n FROM (SELECT site, lower(trim(meta_description)) AS t, count(*) AS n FROM page WHERE trim(meta_description) <> '' GROUP BY 1, 2 HAVING count(*) > 1) GROUP BY 1) e USING (site)"""
_BARE = lambda c: f"regexp_replace({C._host(c)}, '^www\\.', '')"

SQL = {
    "legacy_site_counts": _COUNTS,
    "legacy_findings": f"WITH counts AS ({_COUNTS}) {A._fired(legacy_checks.CHECKS, 'counts', 'site')}",
    "site_preflight": f"""SELECT site, CASE WHEN s = -1 THEN 'unreachable' WHEN s >= 400 THEN 'error_status' WHEN NOT coalesce(contains(lower(x.content_type), 'html'), false) THEN 'not_html' WHEN x.final_url IS NOT NULL AND {_BARE('x.final_url')} <> {_BARE('x.url')} THEN 'other_host' ELSE 'ok' END AS verdict
FROM (SELECT site, arg_max({{'content_type': content_type, 'url': url, 'final_url': final_url}}, (fetched_at, seq, fetch_id)) AS x, arg_max(coalesce(status, -1), (fetched_at, seq, fetch_id)) AS s FROM page_raw WHERE regexp_matches(url, '^[a-zA-Z]+://[^/]+/?$') GROUP BY 1)""",
    "render_budget": f"""WITH t AS (SELECT *, row_number() OVER (PARTITION BY site, page_type ORDER BY url) AS turn FROM (SELECT *, coalesce(provisional_type, 'unknown') AS page_type FROM ({C._FRONTIER})))
SELECT site, url, page_type FROM (SELECT *, row_number() OVER (PARTITION BY site ORDER BY turn, coalesce(nullif(coalesce(list_position([{', '.join(repr(x) for x in crawling.RENDER_ORDER)}], page_type), 0), 0), {len(crawling.RENDER_ORDER) + 1}), page_type) AS place FROM t WHERE turn <= 6) WHERE place <= 6""",
}


def site_brands(spark: SparkSession, d: str) -> DataFrame:
    return content.site_brands(table(spark, d, "page"))


def page_statements(spark: SparkSession, d: str) -> DataFrame:
    return content.page_facts(table(spark, d, "page"))


def statement_support(spark: SparkSession, d: str) -> DataFrame:
    return content.supported_facts(table(spark, d, "page"))


def window_defects(spark: SparkSession, d: str) -> DataFrame:
    """Windows of documents that do not stand alone, by reason."""
    w = table(spark, d, "documents").where("text is not null").select(F.explode(T.greedy_windows(F.col("text"), 60)).alias("w"))
    return w.groupBy(F.coalesce(content.self_contained(F.col("w")), F.lit("none")).alias("reason")).agg(F.count("*").alias("n"))


def calls_to_action(spark: SparkSession, d: str) -> DataFrame:
    raw = table(spark, d, "page_raw").where("html is not null").dropDuplicates(["fetch_id"])
    return content.calls_to_action(html.parsed_pages(raw, ["fetch_id"]), ["fetch_id"])


def missing_alternatives(spark: SparkSession, d: str) -> DataFrame:
    raw = table(spark, d, "page_raw").where("html is not null").dropDuplicates(["fetch_id"])
    return content.missing_alternatives(html.parsed_pages(raw, ["fetch_id"]), ["fetch_id"])


QUERIES |= {f.__name__: f for f in (site_brands, page_statements, statement_support, window_defects, calls_to_action, missing_alternatives)}
SQL["site_brands"] = """SELECT site, part AS brand, n AS n_pages FROM (SELECT *, row_number() OVER (PARTITION BY site ORDER BY n DESC, length(part), part) AS r FROM (
 SELECT site, part, count(DISTINCT page_id) AS n FROM (SELECT site, page_id, unnest(p) AS part FROM (SELECT site, page_id, list_filter(list_transform(string_split_regex(title, ' [|\\-–—·:] '), lambda x: trim(x)), lambda x: x <> '') AS p FROM page WHERE title IS NOT NULL) WHERE len(p) > 1) GROUP BY 1, 2)) WHERE r = 1"""
