"""Windows and sessions over the event table in batch: the same results as the streams give when all is in."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from sitewarp.session import table


def event_windows(spark: SparkSession, d: str) -> DataFrame:
    """Tumbling hours per event type."""
    return table(spark, d, "events").groupBy(F.window("ts", "1 hour").alias("w"), "event_type").agg(F.count("*").alias("n"), F.round(F.sum("value"), 4).alias("total")).select(F.col("w.start").cast("string").alias("start"), "event_type", "n", "total")


def event_sessions(spark: SparkSession, d: str) -> DataFrame:
    """Sessions of users: events less than half an hour apart."""
    order = Window.partitionBy("user_id").orderBy("ts", "event_id")
    rows = table(spark, d, "events").select("user_id", "ts", "event_id", F.lag("ts").over(order).alias("before"))
    rows = rows.withColumn("session", F.sum((F.coalesce(F.col("ts") - F.col("before") >= F.expr("interval 30 minutes"), F.lit(True))).cast("int")).over(order))
    return rows.groupBy("user_id", "session").agg(F.count("*").alias("n_events"), F.min("ts").cast("string").alias("start"))


def fetch_days(spark: SparkSession, d: str) -> DataFrame:
    """Distinct requests and failures per day."""
    r = table(spark, d, "page_raw").dropDuplicates(["fetch_id"])
    return r.groupBy(F.to_date("fetched_at").alias("day")).agg(F.count("*").alias("n"), F.count_if(F.col("status").isNull() | (F.col("status") >= 400)).alias("n_failed"))


QUERIES = {f.__name__: f for f in (event_windows, event_sessions, fetch_days)}

SQL = {
    "event_windows": "SELECT strftime(date_trunc('hour', ts), '%Y-%m-%d %H:%M:%S') AS start, event_type, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY 1, 2",
    "event_sessions": """SELECT user_id, session, count(*) AS n_events, CAST(min(ts) AS VARCHAR) AS start FROM (SELECT *, sum(fresh) OVER (PARTITION BY user_id ORDER BY ts, event_id)::BIGINT AS session
 FROM (SELECT *, CASE WHEN ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id) < INTERVAL 30 MINUTE THEN 0 ELSE 1 END AS fresh FROM events)) GROUP BY 1, 2""",
    "fetch_days": "SELECT CAST(fetched_at AS DATE) AS day, count(*) AS n, count(*) FILTER (status IS NULL OR status >= 400) AS n_failed FROM (SELECT DISTINCT ON (fetch_id) * FROM page_raw) GROUP BY 1",
}
