"""From findings to a report: validate, absorb, collapse, gate, score and rank."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sitewarp.session import cut_lineage

FINDING = "site string, seq bigint, check_id string, title string, severity string, confidence string, stage string, category string, scope string, affected_urls array<string>, evidence string, effort string, summary string, mechanism string"

# Ranks, scores and gate rules.
SEVERITY = {"info": 0, "low": 1, "medium": 2, "high": 3, "critical": 4}
CONFIDENCE = {"hypothesis": 0, "likely": 1, "confirmed": 2}
IMPACT = {"critical": 10.0, "high": 8.0, "medium": 5.0, "low": 3.0, "info": 1.0}
CERTAINTY = {"confirmed": 9.0, "likely": 6.0, "hypothesis": 3.0}
EASE = {"low": 9.0, "medium": 5.0, "high": 2.0}
STAGE = {"reach": 0, "read": 1, "extract": 2, "trust": 3, "act": 4}
GATED = ("reach", "read", "extract", "trust")
SITE_CLOSERS = ("reach.robots.blanket_disallow", "reach.robots.ai_search_bot_blocked", "reach.edge.bot_ua_blocked")
URL_CLOSERS = ("reach.index.noindex_on_content", "read.render.raw_text_gap", "read.render.empty_spa_shell")
NEVER_CLOSES = ("reach.agent.llms_txt_absent",)
ABSORBED = {"extract.ans.chunk_not_self_contained": "extract.ans.fact_coverage_gap"}
CEILING = "medium"
COLLAPSE_LEAST, COLLAPSE_SHARE = 5, 0.5


def lookup(value: Column, table: dict, default) -> Column:
    return F.coalesce(F.element_at(F.create_map(*(F.lit(x) for kv in table.items() for x in kv)), F.coalesce(value, F.lit(""))), F.lit(default))


def rejected(findings: DataFrame) -> Column:
    """Why a finding may not ship, or null: something it must state is missing or empty."""
    reason = None
    for field in ("check_id", "title", "severity", "evidence", "confidence", "summary", "mechanism"):
        empty = F.coalesce(F.col(field), F.lit("")) == ""
        reason = F.when(empty, F.lit(f"missing {field}")) if reason is None else reason.when(empty, F.lit(f"missing {field}"))
    return reason


def validated(findings: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(findings that ship, limitations (site, check_id, reason))."""
    marked = findings.withColumn("reason", rejected(findings))
    return marked.where("reason is null").drop("reason"), marked.where("reason is not null").select("site", "check_id", "reason")


def absorbed(findings: DataFrame) -> DataFrame:
    """Findings with ``merged_from``: an absorbed check is folded into the first finding of its host check on the same
    site that shares an address with it; its evidence is appended. Without a host it stands alone."""
    target = F.element_at(F.create_map(*(F.lit(x) for kv in ABSORBED.items() for x in kv)), F.col("check_id"))
    guests = findings.where(F.col("check_id").isin(list(ABSORBED))).withColumn("target", target)
    guests = guests.select("site", F.col("seq").alias("guest"), F.col("check_id").alias("guest_check"), F.col("evidence").alias("guest_evidence"), F.col("target").alias("check_id"), F.col("affected_urls").alias("guest_urls"))
    # by shared address instead of all pairs of a site
    spots = guests.select("site", "guest", "check_id", F.explode("guest_urls").alias("url")).distinct()
    hosts = findings.where(F.col("check_id").isin(list(ABSORBED.values()))).select("site", "check_id", "seq", F.explode("affected_urls").alias("url")).distinct()
    folded = spots.join(hosts, ["site", "check_id", "url"]).groupBy("site", "guest").agg(F.min("seq").alias("host"))
    told = folded.join(guests.select("site", "guest", "guest_check", "guest_evidence"), ["site", "guest"])
    per_host = told.groupBy("site", F.col("host").alias("seq")).agg(F.array_sort(F.collect_set("guest_check")).alias("merged_from"), F.array_sort(F.collect_list(F.struct("guest", "guest_evidence"))).alias("more"))
    kept = findings.join(folded.select("site", F.col("guest").alias("seq")), ["site", "seq"], "left_anti").join(per_host, ["site", "seq"], "left")
    evidence = F.concat(F.rtrim("evidence"), F.coalesce(F.array_join(F.transform("more", lambda m: F.concat(F.lit(" Also: "), m["guest_evidence"])), ""), F.lit("")))
    return kept.withColumn("evidence", F.when(F.col("more").isNull(), F.col("evidence")).otherwise(evidence)).drop("more")


def collapsed(findings: DataFrame, pages: DataFrame) -> DataFrame:
    """One finding for a check that stands on most pages of a site. ``pages`` is (site, n_pages).

    A check with ``COLLAPSE_LEAST`` page findings or more that covers ``COLLAPSE_SHARE`` of the site's pages becomes
    site-wide: the most severe finding (the first of equals) speaks for all and lists every address.
    """
    sized = findings.join(pages, "site", "left").withColumn("n_pages", F.coalesce("n_pages", F.lit(0)))
    alone = (F.col("scope") == "site") | (F.col("n_pages") < COLLAPSE_LEAST)
    paged = sized.where(~alone)
    urls = paged.select("site", "check_id", F.explode("affected_urls").alias("url")).distinct().groupBy("site", "check_id").agg(F.count("*").alias("n_urls"), F.array_sort(F.collect_list("url")).alias("urls"))
    rank = F.struct(lookup(F.col("severity"), SEVERITY, 0).alias("rank"), (-F.col("seq")).alias("first"))
    groups = paged.groupBy("site", "check_id", "n_pages").agg(F.count("*").alias("n"), F.max_by("seq", rank).alias("seq")).join(urls, ["site", "check_id"])
    wide = groups.where((F.col("n") >= COLLAPSE_LEAST) & (F.col("n_urls") >= COLLAPSE_SHARE * F.col("n_pages"))).select("site", "check_id", F.col("seq").alias("speaker"), "n", "n_urls", "urls")
    out = sized.join(wide, ["site", "check_id"], "left")
    spread = ~alone & F.col("speaker").isNotNull()
    out = out.where(~spread | (F.col("seq") == F.col("speaker")))
    title = F.format_string("%s - on %d of %d crawled pages", "title", "n_urls", "n_pages")
    return out.select(
        *(c for c in findings.columns if c not in ("scope", "affected_urls", "title")),
        F.when(spread, F.lit("site")).otherwise(F.col("scope")).alias("scope"),
        F.when(spread, F.col("urls")).otherwise(F.col("affected_urls")).alias("affected_urls"),
        F.when(spread, title).otherwise(F.col("title")).alias("title"),
        F.when(spread, F.col("n")).otherwise(F.lit(1)).cast("bigint").alias("n_collapsed"),
    )


def ice(severity: Column, confidence: Column, effort: Column) -> Column:
    total = lookup(severity, IMPACT, 5.0) + lookup(confidence, CERTAINTY, 6.0) + lookup(effort, EASE, 5.0)
    return F.round(total / 3, 1)


def report_order() -> list:
    return [F.desc(lookup(F.col("severity"), SEVERITY, 0)), F.desc("ice"), lookup(F.col("stage"), STAGE, 9), F.col("check_id"), F.coalesce(F.get("affected_urls", F.lit(0)), F.lit("")), F.col("seq")]


def _closers(findings: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(site closers (site, closer_rank, blocker), url closers (site, url, closer_rank, blocker)); the first by provisional order."""
    gated = findings.where(F.col("stage").isin(*GATED) & ~F.col("check_id").isin(*NEVER_CLOSES))
    order = F.row_number().over(Window.partitionBy("site").orderBy(*report_order()))
    gated = gated.withColumn("place", order).withColumn("closer_rank", lookup(F.col("stage"), STAGE, 9))
    fixed = F.col("check_id").isin(*SITE_CLOSERS) & (F.col("severity") == "critical")
    by_url = F.col("check_id").isin(*URL_CLOSERS) & F.col("severity").isin("critical", "high")
    generic = (F.col("severity") == "critical") & (F.col("scope") == "site")
    site = gated.where(fixed | (~by_url & generic)).groupBy("site", "closer_rank").agg(F.min_by("seq", "place").alias("blocker"))
    highs = gated.where(~fixed & ~by_url & (F.col("severity") == "high") & (F.col("scope") == "site")).groupBy("site", "closer_rank").agg(F.count("*").alias("n"), F.min_by("seq", F.struct("check_id", "place")).alias("second"))
    site = site.join(highs.where("n >= 2"), ["site", "closer_rank"], "full").select("site", "closer_rank", F.coalesce("blocker", "second").alias("blocker"))
    url = gated.where(by_url).select("site", "closer_rank", "place", "seq", F.explode("affected_urls").alias("url")).groupBy("site", "url", "closer_rank").agg(F.min_by("seq", "place").alias("blocker"))
    return site, url


def gated(findings: DataFrame) -> DataFrame:
    """Findings with ``blocked_seq``: the seq of the most upstream finding that makes them moot, or null.

    Only discoverability findings are capped, at medium and never removed. A closed site stage blocks every later stage; a
    finding on pages is blocked if all of its addresses are closed in one earlier stage. Confidence falls one step if the
    blocker is of stage read and the finding of extract or trust.
    """
    scored = findings.withColumn("ice", ice(F.col("severity"), F.col("confidence"), F.col("effort"))).withColumn("stage_rank", lookup(F.col("stage"), STAGE, 9))
    site, url = _closers(scored)
    subject = scored.where((F.col("category") == "discoverability") & F.col("stage").isin(*GATED)).select("site", "seq", "stage_rank", "affected_urls")
    by_site = subject.join(site, "site").where("closer_rank < stage_rank").select("site", "seq", "closer_rank", F.lit(0).alias("is_url"), "blocker")
    spots = subject.select("site", "seq", "stage_rank", F.size(F.array_distinct("affected_urls")).alias("n_urls"), F.explode(F.array_distinct("affected_urls")).alias("url"))
    covered = spots.join(url, ["site", "url"]).where("closer_rank < stage_rank").groupBy("site", "seq", "closer_rank", "n_urls").agg(F.count("*").alias("n"), F.min_by("blocker", "url").alias("blocker"))
    by_url = covered.where("n = n_urls").select("site", "seq", "closer_rank", F.lit(1).alias("is_url"), "blocker")
    blocked = by_site.unionByName(by_url).groupBy("site", "seq").agg(F.min(F.struct("closer_rank", "is_url", "blocker")).alias("b"))
    blocked = blocked.where("b.blocker <> seq").select("site", "seq", F.col("b.blocker").alias("blocked_seq"), F.col("b.closer_rank").alias("blocker_rank"))
    out = scored.join(blocked, ["site", "seq"], "left")
    moot = F.col("blocked_seq").isNotNull()
    above = lookup(F.col("severity"), SEVERITY, 0) > SEVERITY[CEILING]
    lower = F.when(F.col("confidence") == "confirmed", F.lit("likely")).otherwise(F.lit("hypothesis"))
    softer = moot & (F.col("blocker_rank") == STAGE["read"]) & F.col("stage").isin("extract", "trust")
    out = out.withColumn("severity", F.when(moot & above, F.lit(CEILING)).otherwise(F.col("severity"))).withColumn("confidence", F.when(softer, lower).otherwise(F.col("confidence")))
    return out.withColumn("ice", ice(F.col("severity"), F.col("confidence"), F.col("effort"))).drop("stage_rank", "blocker_rank")


def ranked(findings: DataFrame) -> DataFrame:
    """Findings with ``finding_id`` (F-001 ...) in report order per site, ``priority``, and ``blocked_by`` as an id."""
    place = F.row_number().over(Window.partitionBy("site").orderBy(*report_order()))
    out = findings.withColumn("finding_id", F.format_string("F-%03d", place)).withColumn("priority", F.when(F.col("severity") == "info", F.lit("low")).otherwise(F.col("severity")))
    ids = out.select("site", F.col("seq").alias("blocked_seq"), F.col("finding_id").alias("blocked_by"))
    return out.join(ids, ["site", "blocked_seq"], "left").drop("blocked_seq")


def reported(findings: DataFrame, pages: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(ranked findings, limitations): the whole way, in the order validate, absorb, collapse, gate, score, rank.
    Every step reads its input several times, so the findings, small beside the pages, are kept between the steps."""
    fine, limitations = validated(cut_lineage(findings))
    merged = cut_lineage(collapsed(cut_lineage(absorbed(fine)), pages))
    return ranked(cut_lineage(gated(merged))), limitations


def counts(findings: DataFrame) -> DataFrame:
    """(site, dimension, value, n): findings by severity, stage and category in one pass over grouping sets."""
    sets = findings.groupingSets([["site", "severity"], ["site", "stage"], ["site", "category"]], "site", "severity", "stage", "category").agg(F.count("*").alias("n"), F.grouping_id().alias("g"))
    dimension = F.when(F.col("g") == 3, F.lit("severity")).when(F.col("g") == 5, F.lit("stage")).otherwise(F.lit("category"))
    value = F.when(F.col("g") == 3, F.col("severity")).when(F.col("g") == 5, F.col("stage")).otherwise(F.col("category"))
    return sets.select("site", dimension.alias("dimension"), value.alias("value"), "n")


def gate_notes(findings: DataFrame) -> DataFrame:
    """(site, blocked_by, n_blocked): how many findings each blocker holds back."""
    return findings.where("blocked_by is not null").groupBy("site", "blocked_by").agg(F.count("*").alias("n_blocked"))
