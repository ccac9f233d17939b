"""Queries of the general data problems (nested records, orphan references) and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sitewarp.operators import orphans, shredding
from sitewarp.session import table


def p5_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shredding.page_objects(table(spark, sf_dir, "page"))


def p5_leaf_values(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shredding.page_leaves(table(spark, sf_dir, "page"))


def p5_leaf_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per leaf path of the corpus: how many blocks have it, entries and values."""
    c = shredding.shredded_jsonld(table(spark, sf_dir, "page"))
    return c.groupBy("leaf_path").agg(F.count("*").alias("n_blocks"), F.sum(F.size("value").cast("bigint")).alias("n_entries"), F.sum(F.size(F.filter("value", lambda v: v.isNotNull())).cast("bigint")).alias("n_values"), F.max(F.array_max("repetition")).cast("bigint").alias("max_repetition"))


def p5_forms(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shredding.form_table(table(spark, sf_dir, "page"))


def p5_fields(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shredding.field_table(table(spark, sf_dir, "page"))


def p5_headings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shredding.heading_table(table(spark, sf_dir, "page"))


def _references(spark: SparkSession, sf_dir: str) -> DataFrame:
    return orphans.page_references(table(spark, sf_dir, "page")).unionByName(orphans.sitemap_references(table(spark, sf_dir, "sitemap_entry")))


def p6_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return orphans.orphan_references(_references(spark, sf_dir), table(spark, sf_dir, "page_raw"))


def p6_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    return orphans.orphan_report(_references(spark, sf_dir), table(spark, sf_dir, "page_raw"))


QUERIES = {f.__name__: f for f in (p5_found, p5_leaf_values, p5_leaf_columns, p5_forms, p5_fields, p5_headings, p6_found, p6_report)}

_KEY = r"""regexp_replace(lower(regexp_extract(split_part({0}, '#', 1), '^([A-Za-z][A-Za-z0-9+.\-]*://[^/?]*)', 1))
 || substr(split_part({0}, '#', 1), length(regexp_extract(split_part({0}, '#', 1), '^([A-Za-z][A-Za-z0-9+.\-]*://[^/?]*)', 1)) + 1), '/$', '')"""

_ORPHANS = f"""
refs AS (
  SELECT DISTINCT 'page' AS src_table, page_id AS src_id, target_url, strftime(crawled_at, '%Y-%m') AS period
  FROM (SELECT page_id, crawled_at, unnest(links.internal) AS target_url FROM page) WHERE target_url IS NOT NULL
  UNION ALL
  SELECT 'sitemap_entry', entry_id, loc, strftime(listed_at, '%Y-%m') FROM sitemap_entry WHERE loc IS NOT NULL),
keyed AS (SELECT *, {_KEY.format("target_url")} AS k FROM refs WHERE period IS NOT NULL),
answers AS (SELECT {_KEY.format("url")} AS k, strftime(ingested_at, '%Y-%m') AS seen, fetched_at, ingested_at, seq, fetch_id, status FROM page_raw
  WHERE status IS NOT NULL AND url IS NOT NULL AND ingested_at IS NOT NULL),
state AS (SELECT w.k, w.period, arg_max(a.status, (a.fetched_at, a.ingested_at, a.seq, a.fetch_id)) AS status
  FROM (SELECT DISTINCT k, period FROM keyed) w JOIN answers a ON a.k = w.k AND a.seen <= w.period GROUP BY 1, 2),
orphan AS (SELECT src_table, src_id, target_url, keyed.period FROM keyed LEFT JOIN state ON keyed.k = state.k AND keyed.period = state.period
  WHERE state.status IS NULL OR state.status IN (404, 410))"""

_FORMS = "(SELECT page_id, generate_subscripts(forms, 1) - 1 AS i, unnest(forms) AS f FROM page)"

SQL = {
    "p5_forms": f"SELECT page_id, i::VARCHAR AS path, f.action AS action, f.method AS method, f.in_main AS in_main, coalesce(len(f.fields), 0)::INTEGER AS n_fields FROM {_FORMS} WHERE f IS NOT NULL",
    "p5_fields": f"SELECT page_id, i || '/' || k AS path, i::VARCHAR AS parent_path, x.name AS name, x.type AS type, x.required AS required, x.labelled AS labelled, x.placeholder AS placeholder FROM (SELECT page_id, i, generate_subscripts(f.fields, 1) - 1 AS k, unnest(f.fields) AS x FROM {_FORMS} WHERE f IS NOT NULL) WHERE x IS NOT NULL",
    "p5_headings": """WITH t AS (SELECT page_id, x.pos AS pos, x.level AS level, x.text AS text FROM (SELECT page_id, unnest(headings) AS x FROM page) WHERE x IS NOT NULL)
SELECT a.page_id, a.pos::VARCHAR AS path, coalesce((SELECT max(b.pos) FROM t b WHERE b.page_id = a.page_id AND b.pos < a.pos AND b.level < a.level)::VARCHAR, '') AS parent_path, a.level, a.text FROM t a""",
    "p6_found": f"WITH {_ORPHANS.strip()} SELECT src_table, src_id, target_url, period FROM orphan",
    "p6_report": f"""WITH {_ORPHANS.strip()}
SELECT t.src_table, t.period, t.n AS n_references, coalesce(o.n, 0) AS n_orphans, coalesce(o.d, 0) AS n_targets, round(coalesce(o.n, 0)::DOUBLE / t.n, 6) AS orphan_share
FROM (SELECT src_table, period, count(*) AS n FROM keyed GROUP BY 1, 2) t
LEFT JOIN (SELECT src_table, period, count(*) AS n, count(DISTINCT target_url) AS d FROM orphan GROUP BY 1, 2) o USING (src_table, period)""",
}
