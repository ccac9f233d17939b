"""Readers and writers of evidence: fixture sites, evidence bundles, sitemap documents and probes."""

from __future__ import annotations

from pathlib import Path

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from sitewarp.functions.urls import normalised

ROUTE = "struct<status:int,file:string,body:string,content_type:string,headers:map<string,string>,redirect_to:string,error:string>"
SITE_META = f"origin string, default_status int, not_found_file string, ttfb_ms array<double>, routes map<string,{ROUTE}>"
BUNDLE_PAGE = "url string, status int, bytes bigint, title string, meta_description string, meta_robots string, canonical string, wordcount int, main_wordcount int, main_selector string, text string, main_text string, boilerplate_ratio double, links struct<internal:array<string>,external:array<string>,nofollow:array<string>,internal_in_main:array<string>>"


def fixture_sites(spark: SparkSession, folder: str) -> DataFrame:
    """Requests of fixture sites: one row per route of every ``*/_meta.json`` below the local ``folder``.

    (site, url, final_url, status, content_type, headers, hops, html, ttfb_ms, bytes, error). A route's body is given inline or
    as a file beside it; files are read as one distributed scan and joined. Unlisted routes have no row. The route tables are read
    here, as Spark's file sources skip names that begin with an underscore; a fixture has one small table per site.
    """
    metas = [(p.parent.resolve().as_uri(), p.read_text(encoding="utf-8")) for p in sorted(Path(folder).glob("*/_meta.json"))]
    meta = spark.createDataFrame(metas, "folder string, text string").select("folder", F.from_json("text", SITE_META).alias("m")).select("folder", "m.*")
    routes = meta.select("folder", "origin", "ttfb_ms", F.explode("routes").alias("route", "r"))
    bodies = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(folder).select(F.col("path").alias("place"), F.decode("content", "utf-8").alias("from_file"))
    placed = routes.withColumn("place", F.concat("folder", F.lit("/"), "r.file"))
    same = lambda c: F.regexp_replace(c, "^file:/+", "file:/")
    rows = placed.join(bodies.withColumn("place", same(F.col("place"))).withColumnRenamed("place", "p"), same(F.col("place")) == F.col("p"), "left")
    url = F.concat(F.regexp_replace("origin", "/$", ""), "route")
    body = F.coalesce("r.body", "from_file")
    target = F.concat(F.regexp_replace("origin", "/$", ""), "r.redirect_to")
    hop = F.when(F.col("r.redirect_to").isNotNull(), F.array(F.struct(url.alias("url"), F.col("r.status").alias("status"), F.col("r.redirect_to").alias("location"))))
    return rows.select(
        F.regexp_extract("origin", "//([^/]+)", 1).alias("site"), url.alias("url"), F.coalesce(target, url).alias("final_url"), F.col("r.status").alias("status"), F.col("r.content_type").alias("content_type"), F.col("r.headers").alias("headers"),
        F.coalesce(hop, F.array().cast("array<struct<url:string,status:int,location:string>>")).alias("hops"), body.alias("html"), "ttfb_ms", F.coalesce(F.octet_length(body), F.lit(0)).cast("bigint").alias("bytes"), F.col("r.error").alias("error"),
    )


def read_bundle(spark: SparkSession, folder: str) -> dict[str, DataFrame]:
    """The tables of an evidence bundle: pages from ``pages.jsonl``, robots text, sitemap entries. Unreadable lines of the pages
    are dropped and counted by nobody: the schema is fixed and permissive; missing optional files are empty tables."""
    pages = spark.read.schema(BUNDLE_PAGE).json(f"{folder}/pages.jsonl")
    tables = {"page": pages}
    for name, file, schema in (("sitemap_entry", "sitemap.json", "entries array<struct<loc:string,lastmod:string>>"), ("meta", "meta.json", "seed string, origin string, status string, audited_at string")):
        try:
            tables[name] = spark.read.schema(schema).option("multiLine", True).json(f"{folder}/{file}")
        except Exception as missing:  # Spark raises its own type if the path does not exist
            if "PATH_NOT_FOUND" not in str(missing):
                raise
            tables[name] = spark.createDataFrame([], schema)
    tables["sitemap_entry"] = tables["sitemap_entry"].select(F.explode("entries").alias("e")).select("e.*")
    return tables


def write_bundle(page: DataFrame, folder: str) -> None:
    """Pages as JSON lines, one folder per site, through Spark's commit protocol: a failed job leaves no half-written table."""
    page.repartition("site").sortWithinPartitions("site", "url").write.mode("overwrite").partitionBy("site").json(f"{folder}/pages")


# Entities of XML text.
ENTITIES = (("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&apos;", "'"), ("&amp;", "&"))


def _plain(text: Column) -> Column:
    for entity, sign in ENTITIES:
        text = F.replace(text, F.lit(entity), F.lit(sign))
    return F.trim(F.regexp_replace(text, r"^\s*<!\[CDATA\[|\]\]>\s*$", ""))


def sitemap_documents(documents: DataFrame) -> DataFrame:
    """(site, url, kind, n_entries, parse_error) of sitemap texts (site, url, status, text): urlset, index or neither."""
    kind = F.when(F.col("text").rlike(r"(?i)<sitemapindex[\s>]"), F.lit("index")).when(F.col("text").rlike(r"(?i)<urlset[\s>]"), F.lit("urlset"))
    closed = F.col("text").rlike(r"(?i)</(sitemapindex|urlset)>\s*$")
    error = F.when(F.col("status") != 200, F.lit("http_error")).when(kind.isNull(), F.lit("not_a_sitemap")).when(~closed, F.lit("truncated"))
    return documents.select("site", "url", kind.alias("kind"), F.coalesce(F.regexp_count("text", F.lit("(?i)<loc>")), F.lit(0)).cast("bigint").alias("n_entries"), error.alias("parse_error"))


def sitemap_entries(documents: DataFrame) -> DataFrame:
    """(site, loc, lastmod) of the url sets among sitemap texts, entries without an address dropped."""
    sets = documents.where("status = 200").where(F.col("text").rlike(r"(?i)<urlset[\s>]"))
    blocks = sets.select("site", F.explode(F.regexp_extract_all("text", F.lit(r"(?is)<url>(.*?)</url>"), F.lit(1))).alias("b"))
    one = lambda tag: _plain(F.regexp_extract("b", rf"(?is)<{tag}>(.*?)</{tag}>", 1))
    return blocks.select("site", one("loc").alias("loc"), F.nullif(one("lastmod"), F.lit("")).alias("lastmod")).where("loc <> ''")


def sitemap_children(documents: DataFrame) -> DataFrame:
    """(site, url) of the sitemaps that index documents name: the next level to fetch."""
    index = documents.where("status = 200").where(F.col("text").rlike(r"(?i)<sitemapindex[\s>]"))
    return index.select("site", F.explode(F.regexp_extract_all("text", F.lit(r"(?is)<loc>(.*?)</loc>"), F.lit(1))).alias("u")).select("site", _plain(F.col("u")).alias("url")).distinct()


def probe_addresses(sites: DataFrame, count: int = 3) -> DataFrame:
    """(site, probe_url): addresses that cannot exist, the same on every run."""
    digest = F.sha2(F.concat(F.lit("https://"), "site"), 256)
    return sites.select("site").distinct().select("site", F.explode(F.transform(F.sequence(F.lit(0), F.lit(count - 1)), lambda i: F.concat(F.lit("https://"), "site", F.lit("/no-such-page-"), F.substr(digest, i * 8 + 1, F.lit(8)), F.lit("/")))).alias("probe_url"))


def soft_404(probes: DataFrame) -> DataFrame:
    """(site, probe_url, verdict) of probes (site, probe_url, status, body, known_404_body): an address that cannot exist must not
    answer 200; the same body as a known error page is the milder case."""
    same = F.trim("body") == F.trim("known_404_body")
    verdict = F.when(F.col("status").isNull(), "unanswered").when(F.col("status") != 200, "proper").when(F.coalesce(same, F.lit(False)), "same_as_404").otherwise("soft_404")
    return probes.select("site", "probe_url", verdict.alias("verdict"))


def retry_delay(value: Column, now: Column, most: int = 30) -> Column:
    """Seconds of a Retry-After header: a number or an HTTP date, between 0 and ``most``; null if neither."""
    moment = F.try_to_timestamp(F.regexp_replace(value, r"^[A-Za-z]{3}, | GMT$", ""), F.lit("dd MMM yyyy HH:mm:ss"))
    seconds = F.coalesce(F.trim(value).try_cast("double"), (F.unix_timestamp(moment) - F.unix_timestamp(now)).cast("double"))
    return F.greatest(F.lit(0.0), F.least(F.lit(float(most)), seconds))


def addresses_once(frame: DataFrame, column: str) -> DataFrame:
    """Rows with distinct normalised addresses, the least spelling of each."""
    return frame.where(F.col(column).isNotNull()).groupBy(normalised(F.col(column)).alias("address")).agg(F.min(column).alias(column)).where("address is not null")
