"""Deterministic page samples per site."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

CAP, LEAST_TYPES, MOST_SHARE = 25, 3, 0.4


def prominence_order() -> list:
    """Least depth first (unknown last), most inlinks first, then the address."""
    return [F.coalesce("depth", F.lit(99)), F.desc(F.coalesce("inlinks", F.lit(0))), F.col("url")]


def prominence_sample(candidates: DataFrame, cap: int = CAP) -> DataFrame:
    """The ``cap`` most prominent addresses of every site."""
    rank = F.row_number().over(Window.partitionBy("site").orderBy(*prominence_order()))
    return candidates.withColumn("rank", rank).where(F.col("rank") <= cap).drop("rank")


def stratified_sample(candidates: DataFrame, cap: int = CAP, least_types: int = LEAST_TYPES, most_share: float = MOST_SHARE) -> DataFrame:
    """(site, url, page_type, strategy): up to ``cap`` addresses per site.

    With ``least_types`` types or more: round-robin over the types in name order, no type above ``most_share`` of the cap,
    the rest filled by prominence. Otherwise by prominence alone. A null type counts as ``unknown``. Ranks use windows that
    keep only the first rows per group, so a site of any size is cut down before it is sorted as a whole.
    """
    rows = candidates.withColumn("page_type", F.coalesce("provisional_type", F.lit("unknown")))
    types = rows.groupBy("site").agg(F.count_distinct("page_type").alias("n_types"))
    per_type = max(1, int(cap * most_share))
    in_type = F.row_number().over(Window.partitionBy("site", "page_type").orderBy(*prominence_order()))
    kept = rows.withColumn("turn", in_type).where(F.col("turn") <= cap).join(types, "site")
    by_turn = F.row_number().over(Window.partitionBy("site", F.col("turn") <= per_type).orderBy("turn", "page_type"))
    kept = kept.withColumn("robin", by_turn)
    varied = F.col("n_types") >= least_types
    first = varied & (F.col("turn") <= per_type) & (F.col("robin") <= cap)
    final = F.row_number().over(Window.partitionBy("site").orderBy(F.desc("first"), *prominence_order()))
    chosen = kept.withColumn("first", first).withColumn("rank", final).where(F.col("rank") <= cap)
    return chosen.select("site", "url", "page_type", F.when(varied, F.lit("stratified")).otherwise(F.lit("prominence")).alias("strategy"))
