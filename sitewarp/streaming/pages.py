"""Pages and fetches as streams: the batch columns, kept up to date."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from sitewarp.functions.urls import reference_key


def stream_table(spark: SparkSession, folder: str, schema, files_per_trigger: int = 1) -> DataFrame:
    """Parquet files of a folder as a stream with a fixed schema."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_trigger).parquet(folder)


def upsert_latest(answers: DataFrame, target: str, checkpoint: str):
    """Keeps ``target`` as the latest answer per address: each micro-batch is merged into the next version of the table.

    The version number is the batch id, so a replayed batch writes the same version again: the sink is idempotent.
    """

    def merge(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        new = batch.where("url is not null").withColumn("key", reference_key(F.col("url"))).select("key", "fetched_at", "status")
        if number:
            new = new.unionByName(spark.read.parquet(f"{target}/v={number - 1}"))
        new.groupBy("key").agg(F.max(F.struct("fetched_at", "status")).alias("x")).select("key", "x.fetched_at", "x.status").write.mode("overwrite").parquet(f"{target}/v={number}")

    return answers.writeStream.foreachBatch(merge).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def answers_per_window(answers: DataFrame, size: str = "1 day", late: str = "60 days") -> DataFrame:
    """Requests, failures and distinct sites per window of the fetch; rows may come ``late``."""
    return answers.withWatermark("fetched_at", late).groupBy(F.window("fetched_at", size)).agg(F.count("*").alias("n"), F.count_if(F.col("status").isNull() | (F.col("status") >= 400)).alias("n_failed"), F.approx_count_distinct("site").alias("n_sites")).select(F.col("window.start").alias("start"), "n", "n_failed", "n_sites")


def sessions(events: DataFrame, gap: str = "30 minutes", late: str = "1 hour") -> DataFrame:
    """Sessions of users: events less than ``gap`` apart."""
    return events.withWatermark("ts", late).groupBy("user_id", F.session_window("ts", gap).alias("s")).agg(F.count("*").alias("n_events")).select("user_id", F.col("s.start").alias("start"), F.col("s.end").alias("end"), "n_events")


def host_pacing(requests: DataFrame, delay_ms: int = 400) -> DataFrame:
    """(site, url, wait_ms) of a stream of requests (site, url, at): how long each must wait so that requests to one host are
    ``delay_ms`` apart. The only state per host is when it is free again."""

    def pace(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        free = state.get[0] if state.exists else 0
        out = []
        for batch in batches:
            for url, at in zip(batch.url, batch.at_ms, strict=True):
                start = max(free, at)
                out.append((key[0], url, start - at))
                free = start + delay_ms
        state.update((int(free),))
        yield pd.DataFrame(out, columns=["site", "url", "wait_ms"])

    timed = requests.select("site", "url", F.unix_millis("at").alias("at_ms"))
    return timed.groupBy("site").applyInPandasWithState(pace, "site string, url string, wait_ms bigint", "free bigint", "append", GroupStateTimeout.NoTimeout)
