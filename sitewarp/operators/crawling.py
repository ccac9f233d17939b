"""What a crawl decides from data: whether a site can be audited, what is observed, what to render."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from sitewarp.functions.urls import bare_host, host

# Page types in the order in which they get the render budget, and rules that need visible content.
RENDER_ORDER = ("home", "product", "pricing", "article", "docs", "category", "contact", "about")
NEEDS_VISIBLE = ("act.orient.no_value_proposition", "act.orient.no_wayfinding", "act.cta.absent_for_page_type", "act.cta.ambiguous_primary_label", "act.cta.competing_primaries", "act.form.field_count_excessive", "act.form.high_friction_required_fields", "act.form.unlabelled_inputs", "act.context.no_onward_path", "act.context.assumes_prior_context", "act.blocker.content_gated_by_interaction", "act.trust.no_social_proof", "act.trust.no_cost_signal")
BLOCKED = (401, 403, 405, 406, 429, 451, 503)


def preflight(page_raw: DataFrame) -> DataFrame:
    """(site, verdict) from the latest request for a site's root: ok, unreachable, error_status, not_html or other_host.
    A site whose root was never requested has no row."""
    roots = page_raw.where("url rlike '^[a-zA-Z]+://[^/]+/?$'")
    last = roots.groupBy("site").agg(F.max(F.struct("fetched_at", "seq", "fetch_id", "status", "content_type", "url", "final_url")).alias("x")).select("site", "x.*")
    elsewhere = F.col("final_url").isNotNull() & (bare_host(host(F.col("final_url"))) != bare_host(host(F.col("url"))))
    verdict = F.when(F.col("status").isNull(), "unreachable").when(F.col("status") >= 400, "error_status").when(~F.coalesce(F.lower("content_type").contains("html"), F.lit(False)), "not_html").when(elsewhere, "other_host").otherwise("ok")
    return last.select("site", verdict.alias("verdict"))


def edge_reach(probes: DataFrame) -> DataFrame:
    """(site, bot, verdict) of probes (site, bot, status, challenged, baseline_status): a bot is blocked at the edge if it is refused
    where the baseline is answered."""
    refused = F.col("status").isin(*BLOCKED)
    verdict = F.when(F.col("baseline_status").isin(*BLOCKED), "baseline_refused").when(refused, "blocked").when(F.col("challenged"), "challenged").otherwise("open")
    return probes.select("site", "bot", verdict.alias("verdict"))


def render_budget(candidates: DataFrame, cap: int = 6) -> DataFrame:
    """(site, url, page_type): the pages to render per site: one of each type in a fixed order, again and again, up to ``cap``."""
    rows = candidates.withColumn("page_type", F.coalesce("provisional_type", F.lit("unknown")))
    priority = F.coalesce(F.nullif(F.array_position(F.array(*map(F.lit, RENDER_ORDER)), F.col("page_type")), F.lit(0)), F.lit(len(RENDER_ORDER) + 1))
    turn = F.row_number().over(Window.partitionBy("site", "page_type").orderBy("url"))
    kept = rows.withColumn("turn", turn).where(F.col("turn") <= cap).withColumn("priority", priority)
    place = F.row_number().over(Window.partitionBy("site").orderBy("turn", "priority", "page_type"))
    return kept.withColumn("place", place).where(F.col("place") <= cap).select("site", "url", "page_type")


def withheld(findings: DataFrame, unobserved: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(findings that stand, limitations (site, check_id, reason)): rules about visible content say nothing of pages that were not
    observed, ``unobserved`` being (site, url). A finding keeps its observed addresses; without any it is withheld."""
    about = F.col("check_id").isin(*NEEDS_VISIBLE) & (F.size("affected_urls") > 0)
    spots = findings.where(about).select("site", "seq", F.posexplode("affected_urls").alias("at", "url"))
    seen = spots.join(unobserved.select("site", "url").distinct(), ["site", "url"], "left_anti")
    seen = seen.groupBy("site", "seq").agg(F.transform(F.array_sort(F.collect_list(F.struct("at", "url"))), lambda x: x["url"]).alias("seen"))
    marked = findings.join(seen, ["site", "seq"], "left").withColumn("about", about)
    gone = marked.where("about and seen is null").select("site", "check_id", F.lit("page content was not observed").alias("reason")).distinct()
    stands = marked.where("not about or seen is not null").withColumn("affected_urls", F.when(F.col("about"), F.col("seen")).otherwise(F.col("affected_urls")))
    return stands.select(*findings.columns), gone
