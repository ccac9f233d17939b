"""Queries over addresses, links, fetches, sitemaps, crawl rules and samples, with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sitewarp.functions import urls as U
from sitewarp.operators import links, robots, sampling
from sitewarp.session import table

#: The crawlers of the rule tables, and one that none of them names.
CRAWLERS = ["NarrowBot", "shopfeed-bot", "IndexMoth", "CiteCrawler", "GPTBot"]


def _u(spark, d):
    return table(spark, d, "page").where("url is not null")


def url_parts(spark: SparkSession, d: str) -> DataFrame:
    u = F.col("url")
    return _u(spark, d).select("page_id", U.scheme(u).alias("scheme"), U.host(u).alias("host"), U.path(u).alias("path"), U.query(u).alias("query"), U.depth(u).cast("bigint").alias("depth"), U.bare_host(U.host(u)).alias("bare_host"))


def url_normalised(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "page_raw").where("url is not null").select("url").distinct().select("url", U.normalised(F.col("url")).alias("address"))


def url_duplicates(spark: SparkSession, d: str) -> DataFrame:
    return links.repeated_addresses(table(spark, d, "page_raw"))


def trap_reasons(spark: SparkSession, d: str) -> DataFrame:
    seen = table(spark, d, "page_raw").select("url").union(table(spark, d, "sitemap_entry").select("loc")).union(_u(spark, d).select(F.explode("links.internal"))).where("url is not null").distinct()
    return seen.select("url", U.trap_reason(F.col("url")).alias("reason")).where("reason is not null")


def href_kinds(spark: SparkSession, d: str) -> DataFrame:
    hrefs = _u(spark, d).select(F.col("url").alias("base"), F.explode(F.concat("links.internal", "links.external")).alias("href"))
    return hrefs.groupBy(U.href_kind(F.col("href"), F.col("base")).alias("kind")).agg(F.count("*").alias("n"))


def page_path_types(spark: SparkSession, d: str) -> DataFrame:
    kind = U.path_type(F.col("url"))
    return _u(spark, d).select("page_id", F.coalesce(kind["page_type"], F.lit("other")).alias("page_type"), F.coalesce(kind["confidence"], F.lit(0.35)).alias("confidence"))


def ancestor_urls(spark: SparkSession, d: str) -> DataFrame:
    return _u(spark, d).select("page_id", F.explode(U.ancestors(F.col("url"))).alias("ancestor"))


def wayfinding(spark: SparkSession, d: str) -> DataFrame:
    """Pages two levels deep or more that link to none of their ancestors."""
    known = F.array_union(U.ancestors(F.col("url")), F.transform(U.ancestors(F.col("url")), lambda a: F.regexp_replace(a, "/$", "")))
    rows = _u(spark, d).where(U.depth(F.col("url")) >= 2)
    return rows.where(~F.coalesce(F.arrays_overlap("links.internal", known), F.lit(False))).select("page_id", U.depth(F.col("url")).cast("bigint").alias("depth"))


def url_slugs(spark: SparkSession, d: str) -> DataFrame:
    return _u(spark, d).select("page_id", U.digest_slug(F.col("url")).alias("digest"), U.path_slug(F.col("url")).alias("slug"))


def latest_fetches(spark: SparkSession, d: str) -> DataFrame:
    return links.latest_fetch(table(spark, d, "page_raw")).select("key", "status", "n_fetches")


def link_inlinks(spark: SparkSession, d: str) -> DataFrame:
    return links.inlinks(table(spark, d, "page"))


def broken_links(spark: SparkSession, d: str) -> DataFrame:
    return links.broken_links(table(spark, d, "page"), table(spark, d, "page_raw"))


def canonical_conflicts(spark: SparkSession, d: str) -> DataFrame:
    return links.canonical_conflicts(table(spark, d, "page"), table(spark, d, "page_raw"))


def redirect_chains(spark: SparkSession, d: str) -> DataFrame:
    return links.redirect_chains(table(spark, d, "page_raw"), most=0)


def response_times(spark: SparkSession, d: str) -> DataFrame:
    return links.response_times(table(spark, d, "page_raw"))


def fetch_errors(spark: SparkSession, d: str) -> DataFrame:
    """Requests per site by outcome: answered well, redirected or unchanged, refused, failed, never answered; insecure ones."""
    r = table(spark, d, "page_raw").dropDuplicates(["fetch_id"])
    outcome = F.when(F.col("status").isNull(), "unanswered").when(F.col("status") >= 500, "server_error").when(F.col("status") >= 400, "client_error").when(F.col("status") >= 300, "redirected").otherwise("ok")
    insecure = F.count_if(F.col("tls_error").isNotNull() | F.lower("url").startswith("http://"))
    return r.groupBy("site", outcome.alias("outcome")).agg(F.count("*").alias("n"), insecure.alias("n_insecure"))


def sitemap_coverage(spark: SparkSession, d: str) -> DataFrame:
    return links.sitemap_coverage(table(spark, d, "page"), table(spark, d, "sitemap_entry"))


def frontier_merged(spark: SparkSession, d: str) -> DataFrame:
    return links.merged_frontier(table(spark, d, "frontier")).select("site", "url", "depth", "inlinks", "provisional_type")


def frontier_discovered(spark: SparkSession, d: str) -> DataFrame:
    return links.discovered_frontier(table(spark, d, "page"), table(spark, d, "sitemap_entry"))


def stratified_sample(spark: SparkSession, d: str) -> DataFrame:
    return sampling.stratified_sample(links.merged_frontier(table(spark, d, "frontier")))


def prominence_sample(spark: SparkSession, d: str) -> DataFrame:
    return sampling.prominence_sample(links.merged_frontier(table(spark, d, "frontier"))).select("site", "url")


def robots_groups(spark: SparkSession, d: str) -> DataFrame:
    return robots.applicable(table(spark, d, "robots_rule"), CRAWLERS)


def robots_decisions(spark: SparkSession, d: str) -> DataFrame:
    paths = _u(spark, d).select("site", F.concat(U.path(F.col("url")), F.when(U.query(F.col("url")) == "", "").otherwise(F.concat(F.lit("?"), U.query(F.col("url"))))).alias("path"))
    return robots.decisions(paths, table(spark, d, "robots_rule"), CRAWLERS).select("site", "path", "token", "allowed", "pattern")


def robots_blanket(spark: SparkSession, d: str) -> DataFrame:
    return robots.blanket_disallows(table(spark, d, "robots_rule"))


def robots_reparsed(spark: SparkSession, d: str) -> DataFrame:
    """Each site's rule lines written out as a text and parsed again: distinct agents and rules survive."""
    r = table(spark, d, "robots_rule")
    lines = r.select("site", "line_no", F.concat(F.lit("User-agent: "), "agent", F.lit("\n"), "raw").alias("x"))
    text = lines.groupBy("site").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("line_no", "x"))), lambda s: s["x"]), "\n").alias("text"))
    return robots.parse(text).groupBy("site", "agent").agg(F.count_if("allow").alias("n_allow"), F.count_if(~F.col("allow")).alias("n_disallow"))


QUERIES = {f.__name__: f for f in (url_parts, url_normalised, url_duplicates, trap_reasons, href_kinds, page_path_types, ancestor_urls, wayfinding, url_slugs, latest_fetches, link_inlinks, broken_links, canonical_conflicts, redirect_chains, response_times, fetch_errors, sitemap_coverage, frontier_merged, frontier_discovered, stratified_sample, prominence_sample, robots_groups, robots_decisions, robots_blanket, robots_reparsed)}


def _key(x: str) -> str:
    head = f"regexp_extract(split_part({x}, '#', 1), '^([A-Za-z][A-Za-z0-9+.\\-]*://[^/?]*)', 1)"
    return f"regexp_replace(lower({head}) || substr(split_part({x}, '#', 1), length({head}) + 1), '/$', '')"


def _scheme(x: str = "url") -> str:
    return f"lower(regexp_extract({x}, '^([A-Za-z][A-Za-z0-9+.\\-]*):', 1))"


def _auth(x: str = "url") -> str:
    return f"lower(regexp_extract({x}, '^[A-Za-z][A-Za-z0-9+.\\-]*://([^/?#]*)', 1))"


def _host(x: str = "url") -> str:
    return f"regexp_replace(regexp_replace({_auth(x)}, '^[^@]*@', ''), ':[0-9]*$', '')"


def _path(x: str = "url") -> str:
    bare = f"regexp_replace(regexp_replace({x}, '[?#].*$', '', 's'), '^[A-Za-z][A-Za-z0-9+.\\-]*://[^/]*', '')"
    return f"CASE WHEN {bare} = '' THEN '/' ELSE {bare} END"


def _query(x: str = "url") -> str:
    return f"regexp_extract({x}, '\\?([^#]*)', 1)"


def _segments(x: str = "url") -> str:
    return f"list_filter(string_split({_path(x)}, '/'), lambda s: s <> '')"


def _pairs(x: str = "url") -> str:
    return f"list_filter(list_transform(string_split({_query(x)}, '&'), lambda p: {{'k': split_part(p, '=', 1), 'v': CASE WHEN contains(p, '=') THEN substr(p, strpos(p, '=') + 1) ELSE '' END}}), lambda p: p.k <> '')"


_ADDRESS = f"""CASE WHEN {_scheme()} IN ('http', 'https') AND {_host()} <> '' THEN
 {_scheme()} || '://' || regexp_replace({_auth()}, CASE WHEN {_scheme()} = 'http' THEN ':80$' ELSE ':443$' END, '')
 || '/' || array_to_string({_segments()}, '/') || CASE WHEN {_path()} LIKE '%/' AND len({_segments()}) > 0 THEN '/' ELSE '' END
 || coalesce('?' || nullif(array_to_string(list_transform(list_sort(list_filter({_pairs()}, lambda p: NOT regexp_matches(p.k, '^(utm_|ga_|gclid|fbclid|msclkid|mc_|ref|referrer|source)', 'i'))), lambda p: p.k || '=' || p.v), '&'), ''), '') END"""


def _types() -> str:
    out = "CASE"
    for pattern, name, _ in U.PATH_TYPES:
        out += f" WHEN regexp_matches({_path()}, '{pattern}', 'i') THEN '{name}'"
    return out + " ELSE 'other' END"


def _sure() -> str:
    return "CASE" + "".join(f" WHEN regexp_matches({_path()}, '{p}', 'i') THEN {c}" for p, _, c in U.PATH_TYPES) + " ELSE 0.35 END"


def _traps() -> str:
    keys = f"list_transform({_pairs()}, lambda p: lower(p.k))"
    low = f"list_filter(string_split(lower({_path()}), '/'), lambda s: s <> '')"
    quoted = lambda xs: ", ".join(f"'{x}'" for x in xs)
    out = f"CASE WHEN regexp_extract(lower({_path()}), '[^/]\\.([a-z0-9]+)$', 1) IN ({quoted(U.NON_PAGE_EXTENSIONS)}) THEN 'non_html_extension' WHEN len({low}) > 8 THEN 'excessive_depth'"
    out += f" WHEN len(list_filter(range(1, len({low})), lambda i: {low}[i] = {low}[i + 1])) > 0 OR len(list_filter({low}, lambda s: len(list_filter({low}, lambda t: t = s)) >= 3)) > 0 THEN 'repeating_segment'"
    out += f" WHEN try_cast(regexp_extract(lower({_path()}), '/page/([0-9]+)', 1) AS INT) > 3 THEN 'deep_pagination'"
    out += "".join(f" WHEN regexp_matches(url, '{p}', 'i') THEN '{n}'" for n, p in U.NON_PAGES)
    return out + f" WHEN len({keys}) > 3 THEN 'excessive_query_params' WHEN list_has_any({keys}, [{quoted(U.FACETS)}]) THEN 'faceted_param' WHEN len(list_filter({_pairs()}, lambda p: lower(p.k) IN ('page', 'paged', 'p') AND try_cast(p.v AS INT) > 3)) > 0 THEN 'deep_pagination' END"


_SITE_ROOT = f"{_scheme()} || '://' || {_auth()}"
_ANCESTORS = f"list_transform(range(0, len({_segments()})), lambda n: {_SITE_ROOT} || CASE WHEN n = 0 THEN '/' ELSE '/' || array_to_string({_segments()}[1:n], '/') || '/' END)"
_LINKS = f"SELECT DISTINCT site, page_id, {_key('t')} AS key FROM (SELECT site, page_id, unnest(links.internal) AS t FROM page) WHERE t IS NOT NULL"
_LATEST = f"SELECT key, arg_max(coalesce(status, -1), ((status IS NOT NULL)::INT, fetched_at, seq, fetch_id)) AS s, count(DISTINCT fetch_id) AS n_fetches FROM (SELECT {_key('url')} AS key, * FROM page_raw WHERE url IS NOT NULL) GROUP BY 1"
_FRONTIER = "SELECT site, url, min(depth) AS depth, max(inlinks) AS inlinks, min(provisional_type) AS provisional_type FROM frontier WHERE url IS NOT NULL GROUP BY 1, 2"
_PROMINENT = "coalesce(depth, 99), coalesce(inlinks, 0) DESC, url"
_APPLICABLE = """SELECT site, token, arg_max(group_no, rank) AS group_no, arg_max(agent, rank) AS matched_agent FROM (
 SELECT site, token, group_no, agent, ((agent = lower(token))::INT, CASE WHEN agent = '*' THEN 0 ELSE length(agent) END, -group_no) AS rank
 FROM (SELECT DISTINCT site, group_no, lower(agent) AS agent FROM robots_rule WHERE agent IS NOT NULL), (SELECT unnest([{tokens}]) AS token)
 WHERE agent = '*' OR contains(lower(token), agent)) GROUP BY 1, 2""".format(tokens=", ".join(f"'{t}'" for t in CRAWLERS))
_RX = r"""'^' || regexp_replace(regexp_replace(regexp_replace(pattern, '([\\.^+?()\[\]{}|$])', '\\\1', 'g'), '\*', '.*', 'g'), '\\\$$', '$')"""

SQL = {
    "url_parts": f"SELECT page_id, {_scheme()} AS scheme, {_host()} AS host, {_path()} AS path, {_query()} AS query, len({_segments()}) AS depth, regexp_replace({_host()}, '^www\\.', '') AS bare_host FROM page WHERE url IS NOT NULL",
    "url_normalised": f"SELECT DISTINCT url, {_ADDRESS} AS address FROM page_raw WHERE url IS NOT NULL",
    "url_duplicates": f"SELECT address, count(*) AS n_spellings FROM (SELECT DISTINCT url, {_ADDRESS} AS address FROM page_raw WHERE url IS NOT NULL) GROUP BY 1 HAVING count(*) > 1",
    "trap_reasons": f"SELECT * FROM (SELECT url, {_traps()} AS reason FROM (SELECT url FROM page_raw UNION SELECT loc FROM sitemap_entry UNION SELECT unnest(links.internal) FROM page) WHERE url IS NOT NULL) WHERE reason IS NOT NULL",
    "href_kinds": f"""SELECT CASE WHEN {_host('h')} = {_host('b')} OR ends_with({_host('h')}, '.' || {_host('b')}) THEN 'internal' ELSE 'external' END AS kind, count(*) AS n
FROM (SELECT url AS b, unnest(list_concat(links.internal, links.external)) AS h FROM page WHERE links.internal IS NOT NULL AND links.external IS NOT NULL) GROUP BY 1""",
    "page_path_types": f"SELECT page_id, {_types()} AS page_type, ({_sure()})::DOUBLE AS confidence FROM page WHERE url IS NOT NULL",
    "ancestor_urls": f"SELECT page_id, unnest({_ANCESTORS}) AS ancestor FROM page WHERE url IS NOT NULL",
    "wayfinding": f"SELECT page_id, len({_segments()}) AS depth FROM page WHERE url IS NOT NULL AND len({_segments()}) >= 2 AND NOT coalesce(list_has_any(links.internal, list_concat({_ANCESTORS}, list_transform({_ANCESTORS}, lambda a: regexp_replace(a, '/$', '')))), false)",
    "url_slugs": f"SELECT page_id, substr(sha1(url), 1, 16) AS digest, coalesce(nullif(substr(regexp_replace(regexp_replace({_path()} || coalesce('-' || nullif({_query()}, ''), ''), '[^A-Za-z0-9]+', '-', 'g'), '^-+|-+$', '', 'g'), 1, 80), ''), 'index') AS slug FROM page WHERE url IS NOT NULL",
    "latest_fetches": f"SELECT key, nullif(s, -1) AS status, n_fetches FROM ({_LATEST})",
    "link_inlinks": f"SELECT site, key, count(*) AS n_pages FROM ({_LINKS}) GROUP BY 1, 2",
    "broken_links": f"""SELECT site, count(*) AS n_targets, count(b.key) AS n_broken, round(count(b.key)::DOUBLE / count(*), 6) AS rate
FROM (SELECT DISTINCT site, key FROM ({_LINKS})) t LEFT JOIN (SELECT key FROM ({_LATEST}) WHERE s >= 400) b ON t.key = b.key GROUP BY 1""",
    "canonical_conflicts": f"""WITH mine AS (SELECT page_id, {_key('url')} AS k, {_key('canonical')} AS t, {_host('url')} AS h, {_host('canonical')} AS th FROM page WHERE canonical IS NOT NULL AND url IS NOT NULL AND {_key('url')} <> {_key('canonical')})
SELECT DISTINCT page_id, reason FROM (SELECT page_id, CASE WHEN h <> th THEN 'cross_host' WHEN l.s >= 400 THEN 'target_error' WHEN EXISTS (SELECT 1 FROM mine m WHERE m.k = mine.t AND m.t = mine.k) THEN 'mutual' END AS reason
FROM mine LEFT JOIN ({_LATEST}) l ON l.key = mine.t) WHERE reason IS NOT NULL""",
    "redirect_chains": "SELECT DISTINCT site, url, len(hops) AS n_hops, len(list_distinct(list_transform(hops, lambda h: h.url))) < len(hops) AS looped FROM page_raw WHERE len(hops) > 0",
    "response_times": "SELECT site, count(*) AS n_samples, median(ms) AS median_ms FROM (SELECT site, unnest(ttfb_ms) AS ms FROM (SELECT DISTINCT ON (fetch_id) * FROM page_raw)) WHERE ms IS NOT NULL GROUP BY 1 HAVING count(*) >= 3",
    "fetch_errors": """SELECT site, CASE WHEN status IS NULL THEN 'unanswered' WHEN status >= 500 THEN 'server_error' WHEN status >= 400 THEN 'client_error' WHEN status >= 300 THEN 'redirected' ELSE 'ok' END AS outcome, count(*) AS n,
count(*) FILTER (tls_error IS NOT NULL OR lower(url) LIKE 'http://%') AS n_insecure FROM (SELECT DISTINCT ON (fetch_id) * FROM page_raw) GROUP BY 1, 2""",
    "sitemap_coverage": f"""WITH p AS (SELECT DISTINCT site, {_key('url')} AS k FROM page WHERE url IS NOT NULL), l AS (SELECT site, {_key('loc')} AS k, nullif(lastmod, '') AS m FROM sitemap_entry WHERE loc IS NOT NULL)
SELECT a.site, n_pages, coalesce(n_listed, 0) AS n_listed, n_missing, round(n_missing::DOUBLE / n_pages, 6) AS missing_share, coalesce(n_lastmods, 0) AS n_lastmods
FROM (SELECT site, count(*) AS n_pages, count(*) FILTER (NOT EXISTS (SELECT 1 FROM l WHERE l.site = p.site AND l.k = p.k)) AS n_missing FROM p GROUP BY 1) a
LEFT JOIN (SELECT site, count(DISTINCT k) AS n_listed, count(DISTINCT m) AS n_lastmods FROM l GROUP BY 1) b USING (site)""",
    "frontier_merged": _FRONTIER,
    "frontier_discovered": f"""WITH links AS ({_LINKS}), f AS (SELECT site, 'https://' || site AS key, 0 AS depth FROM page UNION ALL SELECT site, {_key('loc')}, 1 FROM sitemap_entry WHERE loc IS NOT NULL
 UNION ALL SELECT links.site, links.key, CASE WHEN regexp_matches(page.url, '^[a-zA-Z]+://[^/]+/?$') THEN 1 ELSE 2 END FROM links JOIN page USING (page_id))
SELECT a.site, a.key, a.depth, coalesce(b.n, 0) AS inlinks FROM (SELECT site, key, min(depth) AS depth FROM f GROUP BY 1, 2) a LEFT JOIN (SELECT site, key, count(*) AS n FROM links GROUP BY 1, 2) b USING (site, key)""",
    "prominence_sample": f"SELECT site, url FROM (SELECT *, row_number() OVER (PARTITION BY site ORDER BY {_PROMINENT}) AS r FROM ({_FRONTIER})) WHERE r <= 25",
    "stratified_sample": f"""WITH c AS (SELECT *, coalesce(provisional_type, 'unknown') AS page_type FROM ({_FRONTIER})), t AS (SELECT *, row_number() OVER (PARTITION BY site, page_type ORDER BY {_PROMINENT}) AS turn FROM c),
v AS (SELECT t.*, n_types FROM t JOIN (SELECT site, count(DISTINCT page_type) AS n_types FROM c GROUP BY 1) USING (site)),
r AS (SELECT *, row_number() OVER (PARTITION BY site, turn <= 10 ORDER BY turn, page_type) AS robin FROM v),
f AS (SELECT *, n_types >= 3 AND turn <= 10 AND robin <= 25 AS first FROM r)
SELECT site, url, page_type, CASE WHEN n_types >= 3 THEN 'stratified' ELSE 'prominence' END AS strategy FROM (SELECT *, row_number() OVER (PARTITION BY site ORDER BY first DESC, {_PROMINENT}) AS place FROM f) WHERE place <= 25""",
    "robots_groups": _APPLICABLE,
    "robots_decisions": f"""WITH chosen AS ({_APPLICABLE}), p AS (SELECT DISTINCT site, {_path()} || CASE WHEN {_query()} = '' THEN '' ELSE '?' || {_query()} END AS path FROM page WHERE url IS NOT NULL),
live AS (SELECT site, group_no, allow, pattern, line_no, {_RX} AS rx FROM robots_rule WHERE pattern IS NOT NULL AND pattern <> ''),
best AS (SELECT site, path, token, arg_max(allow, (length(pattern), allow::INT, -line_no)) AS allow, arg_max(pattern, (length(pattern), allow::INT, -line_no)) AS pattern FROM p JOIN chosen USING (site) JOIN live USING (site, group_no) WHERE regexp_matches(path, rx) GROUP BY 1, 2, 3)
SELECT e.site, e.path, e.token, coalesce(allow, true) AS allowed, pattern FROM (SELECT p.*, token FROM p, (SELECT unnest([{", ".join(f"'{t}'" for t in CRAWLERS)}]) AS token)) e LEFT JOIN best USING (site, path, token)""",
    "robots_blanket": "SELECT site FROM robots_rule WHERE agent = '*' GROUP BY 1 HAVING bool_or(NOT allow AND pattern = '/') AND NOT coalesce(bool_or(allow AND length(pattern) > 1), false)",
    "robots_reparsed": "SELECT site, agent, count(*) FILTER (allow) AS n_allow, count(*) FILTER (NOT allow) AS n_disallow FROM robots_rule GROUP BY 1, 2",
}
