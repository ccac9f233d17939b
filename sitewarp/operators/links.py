"""Link graph, fetch log, canonical addresses, sitemap coverage and crawl frontier."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sitewarp.functions.urls import host, normalised, reference_key
from sitewarp.operators.joins import salted_join


def latest_fetch(page_raw: DataFrame) -> DataFrame:
    """(key, site, url, status, n_fetches): the last answer per address; repeated rows count once. Unanswered requests
    count as fetches with a null status only where nothing else is known."""
    rank = F.struct(F.col("status").isNotNull().alias("answered"), "fetched_at", "seq", "fetch_id")
    rows = page_raw.where("url is not null").withColumn("key", reference_key(F.col("url")))
    return rows.groupBy("key").agg(F.max(F.struct(rank.alias("rank"), "site", "url", "status")).alias("x"), F.count_distinct("fetch_id").alias("n_fetches")).select("key", "x.site", "x.url", "x.status", "n_fetches")


def page_links(page: DataFrame) -> DataFrame:
    """(site, page_id, key): distinct internal targets per page."""
    return page.select("site", "page_id", F.explode("links.internal").alias("target")).where("target is not null").select("site", "page_id", reference_key(F.col("target")).alias("key")).distinct()


def inlinks(page: DataFrame) -> DataFrame:
    """(site, key, n_pages): pages of a site that link to an address."""
    return page_links(page).groupBy("site", "key").agg(F.count("*").alias("n_pages"))


def broken_links(page: DataFrame, page_raw: DataFrame) -> DataFrame:
    """(site, n_targets, n_broken, rate): distinct internal targets of a site and those whose last answer is 400 or more.
    Targets never fetched are not broken."""
    targets = inlinks(page)
    bad = latest_fetch(page_raw).where("status >= 400").select("key", F.lit(1).alias("bad"))
    joined = targets.join(bad, "key", "left")
    out = joined.groupBy("site").agg(F.count("*").alias("n_targets"), F.count("bad").alias("n_broken"))
    return out.withColumn("rate", F.round(F.col("n_broken") / F.col("n_targets"), 6))


def canonical_conflicts(page: DataFrame, page_raw: DataFrame) -> DataFrame:
    """(page_id, reason): canonical addresses on another host, with an error status, or pointing back at each other.
    Pages whose canonical is their own address have no conflict."""
    mine = page.where("canonical is not null and url is not null").select("page_id", reference_key(F.col("url")).alias("key"), reference_key(F.col("canonical")).alias("target"), host(F.col("url")).alias("h"), host(F.col("canonical")).alias("t")).where("key <> target")
    status = latest_fetch(page_raw).select(F.col("key").alias("target"), "status")
    back = mine.select(F.col("target").alias("key"), F.col("key").alias("target"), F.lit(True).alias("mutual")).distinct()
    joined = mine.join(status, "target", "left").join(back, ["key", "target"], "left")
    reason = F.when(F.col("h") != F.col("t"), F.lit("cross_host")).when(F.col("status") >= 400, F.lit("target_error")).when(F.col("mutual"), F.lit("mutual"))
    return joined.select("page_id", reason.alias("reason")).where("reason is not null").distinct()


def redirect_chains(page_raw: DataFrame, most: int = 2) -> DataFrame:
    """(site, url, n_hops, looped) of requests with more than ``most`` hops or with a hop met twice."""
    rows = page_raw.select("site", "url", F.size(F.coalesce("hops", F.array().cast("array<struct<url:string,status:int,location:string>>"))).cast("bigint").alias("n_hops"), F.transform("hops", lambda h: h["url"]).alias("u"))
    looped = F.coalesce(F.size(F.array_distinct("u")) < F.size("u"), F.lit(False))
    return rows.select("site", "url", "n_hops", looped.alias("looped")).where((F.col("n_hops") > most) | F.col("looped")).distinct()


def response_times(page_raw: DataFrame, least: int = 3) -> DataFrame:
    """(site, n_samples, median_ms) of sites with at least ``least`` time samples; exact median of all samples of distinct requests."""
    samples = page_raw.select("fetch_id", "site", "ttfb_ms").dropDuplicates(["fetch_id"]).select("site", F.explode("ttfb_ms").alias("ms")).where("ms is not null")
    return samples.groupBy("site").agg(F.count("*").alias("n_samples"), F.median("ms").alias("median_ms")).where(F.col("n_samples") >= least)


def sitemap_coverage(page: DataFrame, sitemap_entry: DataFrame) -> DataFrame:
    """(site, n_pages, n_listed, n_missing, missing_share, n_lastmods): crawled pages of a site that its sitemap does not list."""
    pages = page.where("url is not null").select("site", reference_key(F.col("url")).alias("key")).distinct()
    listed = sitemap_entry.where("loc is not null").select("site", reference_key(F.col("loc")).alias("key")).distinct()
    missing = pages.join(listed, ["site", "key"], "left_anti").groupBy("site").agg(F.count("*").alias("n_missing"))
    listing = sitemap_entry.where("loc is not null").groupBy("site").agg(F.count_distinct(reference_key(F.col("loc"))).alias("n_listed"), F.count_distinct(F.nullif("lastmod", F.lit(""))).alias("n_lastmods"))
    out = pages.groupBy("site").agg(F.count("*").alias("n_pages")).join(listing, "site", "left").join(missing, "site", "left").fillna(0, ["n_listed", "n_lastmods", "n_missing"])
    return out.withColumn("missing_share", F.round(F.col("n_missing") / F.col("n_pages"), 6))


def merged_frontier(frontier: DataFrame) -> DataFrame:
    """(site, url, depth, inlinks, provisional_type): one row per address; least depth, most inlinks, first known type by name."""
    return frontier.where("url is not null").groupBy("site", "url").agg(F.min("depth").alias("depth"), F.max("inlinks").alias("inlinks"), F.min("provisional_type").alias("provisional_type"))


def discovered_frontier(page: DataFrame, sitemap_entry: DataFrame) -> DataFrame:
    """(site, key, depth, inlinks): addresses found at the site root (0), in sitemaps or links of the root page (1), or links
    elsewhere (2); least depth and the number of pages that link to it."""
    roots = page.select("site", F.concat(F.lit("https://"), "site").alias("key"), F.lit(0).alias("depth"))
    listed = sitemap_entry.where("loc is not null").select("site", reference_key(F.col("loc")).alias("key"), F.lit(1).alias("depth"))
    from_pages = salted_join(page_links(page), page.select("page_id", F.when(F.col("url").rlike(r"^[a-zA-Z]+://[^/]+/?$"), 1).otherwise(2).alias("depth")).dropDuplicates(["page_id"]), ["page_id"], spread="key", salts=2)
    found = roots.distinct().unionByName(listed).unionByName(from_pages.select("site", "key", "depth")).groupBy("site", "key").agg(F.min("depth").cast("bigint").alias("depth"))
    return found.join(inlinks(page), ["site", "key"], "left").select("site", "key", "depth", F.coalesce("n_pages", F.lit(0)).cast("bigint").alias("inlinks"))


def repeated_addresses(page_raw: DataFrame) -> DataFrame:
    """(address, n_spellings): normalised addresses that stand in the fetch log in more than one spelling."""
    return page_raw.where("url is not null").select("url").distinct().groupBy(normalised(F.col("url")).alias("address")).agg(F.count("*").alias("n_spellings")).where("n_spellings > 1")
