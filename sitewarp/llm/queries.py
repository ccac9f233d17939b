"""Queries of the text problems and, where SQL can state their results, the SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sitewarp.llm import keyword_spam, leakage, lookalikes, main_body, near_duplicates, packing, repeated_lines, residue
from sitewarp.session import table


def p1_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lookalikes.odd_fields(table(spark, sf_dir, "page"), "page_id", ["title", "text"])


def p1_consistent_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lookalikes.consistent_text(table(spark, sf_dir, "page"), "page_id", ["title", "text"])


def p2_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repeated_lines.repeated_lines(table(spark, sf_dir, "page"))


def p2_cleaned_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repeated_lines.without_repeated_lines(table(spark, sf_dir, "page"))


def p3_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return main_body.main_body_lines(table(spark, sf_dir, "page"), table(spark, sf_dir, "page_raw"))


def p4_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return residue.residue_pages(table(spark, sf_dir, "page"), table(spark, sf_dir, "page_raw")).select("page_id")


def p4_templates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return residue.message_templates(table(spark, sf_dir, "page"), table(spark, sf_dir, "page_raw"))


def _similar_pages(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    return near_duplicates.near_duplicates(table(spark, sf_dir, "page"), "page_id", "main_text", size=3, threshold=0.6, least_words=40)


def p7_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates.expanded_pairs(*_similar_pages(spark, sf_dir)).select(F.col("a").alias("page_id_a"), F.col("b").alias("page_id_b"))


def p7_membership(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per page: the class of its exact copies, their number, and the links of the class to other texts."""
    pairs, classes = _similar_pages(spark, sf_dir)
    links = pairs.select(F.explode(F.array("a", "b")).alias("rep")).groupBy("rep").agg(F.count("*").alias("n_links"))
    return classes.join(links, "rep", "left").select(F.col("id").alias("page_id"), F.col("rep").alias("class_id"), F.col("n").alias("n_copies"), F.coalesce("n_links", F.lit(0)).cast("bigint").alias("n_links"))


def p7_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per page: its group of pages linked by similarity, directly or through others, and the group's size."""
    return near_duplicates.grouped(*_similar_pages(spark, sf_dir)).select(F.col("id").alias("page_id"), F.col("group").alias("group_id"), F.col("n_group").alias("n_pages"))


def p8_containers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.packed(table(spark, sf_dir, "documents"))


def p8_fill(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.fill_report(p8_containers(spark, sf_dir))


def p9_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return leakage.leaked_items(table(spark, sf_dir, "documents"), table(spark, sf_dir, "eval_item"))


def p9_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    return leakage.leak_report(p9_found(spark, sf_dir))


def p10_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return keyword_spam.keyword_documents(table(spark, sf_dir, "documents")).select("doc_id")


def p10_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return keyword_spam.judged_runs(table(spark, sf_dir, "documents"))


QUERIES = {f.__name__: f for f in (p1_found, p1_consistent_pages, p2_found, p2_cleaned_pages, p3_found, p4_found, p4_templates, p7_found, p7_membership, p7_groups, p8_containers, p8_fill, p9_found, p9_report, p10_found, p10_runs)}

_LINES = r"""lines AS (
  SELECT site, page_id, i AS line_no, l, regexp_replace(regexp_replace(lower(regexp_replace(l, '^[ \t]+|[ \t]+$', '', 'g')), '[ \t]+', ' ', 'g'), '[0-9]+', '0', 'g') AS form
  FROM (SELECT site, page_id, unnest(string_split(text, chr(10))) AS l, generate_subscripts(string_split(text, chr(10)), 1) AS i FROM page WHERE site IS NOT NULL)),
hot AS (SELECT site, form FROM (SELECT site, form, count(DISTINCT page_id) AS n FROM lines WHERE regexp_matches(l, '[^ \t]') GROUP BY 1, 2)
  JOIN (SELECT site, count(*) AS size FROM page GROUP BY 1) USING (site) WHERE n >= 5 AND n >= 0.3::DOUBLE * size),
marked AS (SELECT lines.*, hot.form IS NOT NULL AND regexp_matches(l, '[^ \t]') AS repeated FROM lines LEFT JOIN hot USING (site, form))"""

_PAIRS = r"""words AS (
  SELECT page_id, regexp_extract_all(lower(main_text), '[\p{L}\p{N}]+') AS w FROM page WHERE main_text IS NOT NULL),
shingle AS (SELECT DISTINCT page_id, w[i] || ' ' || w[i + 1] || ' ' || w[i + 2] AS s
  FROM (SELECT page_id, w, unnest(range(1, len(w) - 1)) AS i FROM words WHERE len(w) >= 40)),
size AS (SELECT page_id, count(*) AS n FROM shingle GROUP BY 1),
shared AS (SELECT a.page_id AS a, b.page_id AS b, count(*) AS n FROM shingle a JOIN shingle b ON a.s = b.s AND a.page_id < b.page_id GROUP BY 1, 2),
pairs AS (SELECT a, b FROM shared JOIN size x ON x.page_id = a JOIN size y ON y.page_id = b WHERE shared.n >= 0.6::DOUBLE * (x.n + y.n - shared.n))"""

_CLASSES = _PAIRS + """,
shape AS (SELECT page_id, string_agg(s, chr(10) ORDER BY s) AS whole FROM shingle GROUP BY 1),
classed AS (SELECT page_id, min(page_id) OVER (PARTITION BY whole) AS class_id, (count(*) OVER (PARTITION BY whole))::BIGINT AS n_copies FROM shape),
rep_pairs AS (SELECT a, b FROM pairs WHERE a IN (SELECT class_id FROM classed) AND b IN (SELECT class_id FROM classed))"""

SQL = {
    "p2_found": f"WITH {_LINES} SELECT page_id, line_no::INTEGER AS line_no FROM marked WHERE repeated",
    "p2_cleaned_pages": f"""WITH {_LINES}, kept AS (SELECT page_id, string_agg(l, chr(10) ORDER BY line_no) AS t FROM marked WHERE NOT repeated GROUP BY 1)
SELECT page.page_id, CASE WHEN text IS NULL THEN NULL ELSE coalesce(t, '') END AS text FROM page LEFT JOIN kept USING (page_id)""",
    "p7_found": f"WITH {_PAIRS} SELECT a AS page_id_a, b AS page_id_b FROM pairs",
    "p7_membership": f"""WITH {_CLASSES}, links AS (SELECT id, count(*) AS n_links FROM (SELECT a AS id, b AS other FROM rep_pairs UNION ALL SELECT b, a FROM rep_pairs) GROUP BY 1)
SELECT page_id, class_id, n_copies, coalesce(n_links, 0)::BIGINT AS n_links FROM classed LEFT JOIN links ON links.id = class_id""",
    "p7_groups": f"""WITH RECURSIVE {_PAIRS}, edges AS (SELECT a AS x, b AS y FROM pairs UNION ALL SELECT b, a FROM pairs),
reach AS (SELECT page_id AS x, page_id AS y FROM size UNION SELECT reach.x, edges.y FROM reach JOIN edges ON edges.x = reach.y),
least AS (SELECT x AS page_id, min(y) AS group_id FROM reach GROUP BY 1)
SELECT page_id, group_id, (count(*) OVER (PARTITION BY group_id))::BIGINT AS n_pages FROM least""",
}
