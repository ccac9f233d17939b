"""References to records that do not exist (or no longer do).

Distinct non-null foreign keys are anti-joined against the parent keys that are alive, and the
orphans are joined back to the references for rows and for counts per table and period.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sitewarp.functions.urls import reference_key
from sitewarp.operators.joins import salted_join

GONE = (404, 410)


def page_references(page: DataFrame) -> DataFrame:
    """One row per distinct entry of ``links.internal``. Null entries and pages without links give none."""
    rows = page.select(F.col("page_id").alias("src_id"), F.date_format("crawled_at", "yyyy-MM").alias("period"), F.explode("links.internal").alias("target_url"))
    return rows.where("target_url is not null").distinct().select(F.lit("page").alias("src_table"), "src_id", "target_url", "period")


def sitemap_references(sitemap_entry: DataFrame) -> DataFrame:
    rows = sitemap_entry.select(F.lit("sitemap_entry").alias("src_table"), F.col("entry_id").alias("src_id"), F.col("loc").alias("target_url"), F.date_format("listed_at", "yyyy-MM").alias("period"))
    return rows.where("target_url is not null")


def delivery_states(page_raw: DataFrame, key: Column | None = None) -> DataFrame:
    """(key, month of ingestion, last): the latest answer among the rows ingested in that month.

    ``last`` orders by fetched_at; rows fetched at the same moment fall back to the later ingestion,
    then seq, then fetch_id. Pre-aggregated map-side, so duplicate and hot urls shrink before the shuffle.
    """
    key = reference_key(F.col("url")) if key is None else key
    rows = page_raw.where("status is not null and ingested_at is not null and url is not null")
    last = F.struct("fetched_at", "ingested_at", "seq", "fetch_id", "status")
    return rows.groupBy(key.alias("key"), F.date_format("ingested_at", "yyyy-MM").alias("seen")).agg(F.max(last).alias("last"))


def alive_keys(wanted: DataFrame, states: DataFrame) -> DataFrame:
    """The (key, period) of ``wanted`` whose latest answer known by the end of the period is not gone."""
    known = wanted.join(states, "key").where("seen <= period")
    latest = known.groupBy("key", "period").agg(F.max("last").alias("last"))
    return latest.where(~F.col("last.status").isin(*GONE)).select("key", "period")


def orphan_references(references: DataFrame, page_raw: DataFrame) -> DataFrame:
    """The references (src_table, src_id, target_url, period) whose target was never delivered by the
    end of their month, or whose latest known answer is 404/410.

    Null targets and null periods are no references and give no rows. Repeated references stay one
    row each per distinct (src_table, src_id, target_url, period). Empty inputs give an empty result;
    with an empty ``page_raw`` every reference is an orphan.
    """
    rows = references.where("target_url is not null and period is not null").withColumn("key", reference_key(F.col("target_url")))
    wanted = rows.select("key", "period").distinct()
    orphans = wanted.join(alive_keys(wanted, delivery_states(page_raw)), ["key", "period"], "left_anti")
    return salted_join(rows, orphans, ["key", "period"], spread="src_id", how="left_semi").select("src_table", "src_id", "target_url", "period")


def orphan_report(references: DataFrame, page_raw: DataFrame) -> DataFrame:
    """Per table and period: references, orphan references, distinct orphan targets and the orphan share."""
    total = references.where("target_url is not null and period is not null").groupBy("src_table", "period").agg(F.count("*").alias("n_references"))
    orphans = orphan_references(references, page_raw)
    per_target = orphans.groupBy("src_table", "period", "target_url").agg(F.count("*").alias("n"))
    lost = per_target.groupBy("src_table", "period").agg(F.sum("n").alias("n_orphans"), F.count("*").alias("n_targets"))
    joined = total.join(lost, ["src_table", "period"], "left").fillna(0, ["n_orphans", "n_targets"])
    return joined.withColumn("orphan_share", F.round(F.col("n_orphans") / F.col("n_references"), 6))
