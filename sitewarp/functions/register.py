"""The column functions under names that SQL can call."""

from __future__ import annotations

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from sitewarp.functions import text as T
from sitewarp.functions import urls as U

#: Those without lambdas: an expression tree with lambdas has no SQL text.
FUNCTIONS = {
    "url_key": ("url STRING", "STRING", U.reference_key), "url_host": ("url STRING", "STRING", U.host), "url_path": ("url STRING", "STRING", U.path), "url_digest": ("url STRING", "STRING", U.digest_slug),
    "path_type": ("url STRING", "STRING", lambda u: F.coalesce(*(F.when(U.path(u).rlike("(?i)" + pattern), F.lit(name)) for pattern, name, _ in U.PATH_TYPES))), "word_count": ("text STRING", "BIGINT", T.word_count), "any_date": ("text STRING", "DATE", T.any_date),
}


def register(spark: SparkSession) -> list[str]:
    """Creates temporary SQL functions. Their bodies are the columns' own expressions, so Catalyst inlines them: no UDF runs."""
    for name, (argument, kind, build) in FUNCTIONS.items():
        column = argument.split()[0]
        body = spark.range(1).select(F.lit(None).cast("string").alias(column)).select(build(F.col(column)).alias("x"))
        text = body._jdf.queryExecution().analyzed().expressions().head().child().sql()
        spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {name}({argument}) RETURNS {kind} RETURN {text}")
    return list(FUNCTIONS)
