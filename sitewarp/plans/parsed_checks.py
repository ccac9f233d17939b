"""Rules that need the parsed page: images, calls to action, empty shells, what windows of the text carry, and pairs of raw and
rendered markup; and rules on probes. Each html is parsed once."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sitewarp.functions import text as T
from sitewarp.operators import content, crawling, profile
from sitewarp.plans.catalogue import Check, fired
from sitewarp.sources import evidence, html

# Labels that name no object, and labels that law or custom fixes.
AMBIGUOUS = r"(?i)^\s*(submit|send|click here|click|continue|next|go|ok|learn more|read more|more|find out more|discover|explore|here|view|see more|details)\s*$"
CONSENT = r"(?i)^\s*(accept|accept all|reject|reject all|decline|agree|i agree|manage preferences)\s*$"
CHECKS = (
    Check("read.render.empty_spa_shell", "Markup is an empty shell", "high", "likely", "url", "empty_shell", "n_words"),
    Check("read.nontext.informative_image_no_alt", "Images that tell something have no text", "medium", "confirmed", "url", "n_missing >= 2 OR (n_missing > 0 AND n_images >= 4)", "n_missing", "low"),
    Check("extract.ans.fact_coverage_gap", "No passage carries what the page states", "medium", "likely", "url", "n_facts >= 2 AND n_windows > 0 AND n_missed > 0", "n_missed"),
    Check("extract.ans.chunk_not_self_contained", "Passages do not stand alone", "medium", "likely", "url", "n_windows >= 3 AND n_defects >= 0.2 * n_windows", "n_defects"),
    Check("act.cta.absent_for_page_type", "Page of decision names no action", "high", "likely", "url", "page_type IN ('home', 'product', 'pricing', 'contact') AND n_labels = 0 AND n_fields = 0", "n_words"),
    Check("act.cta.ambiguous_primary_label", "First action names no object", "medium", "confirmed", "url", "ambiguous", "n_labels", "low"),
    Check("act.cta.competing_primaries", "Many actions compete", "medium", "likely", "url", "n_main_labels > 3", "n_main_labels"),
)
RENDERED_CHECKS = (
    Check("read.render.raw_text_gap", "Text appears only when rendered", "critical", "confirmed", "url", "rendered_words >= 200 AND raw_words < 0.3 * rendered_words", "rendered_words"),
    Check("read.render.nav_links_js_only", "Links appear only when rendered", "high", "confirmed", "url", "rendered_links >= 5 AND raw_links < 0.6 * rendered_links", "rendered_links"),
)


def parsed_facts(page: DataFrame, page_raw: DataFrame, target: int = 300) -> DataFrame:
    """One row of facts per page row with html at its address; of several requests for an address the latest counts."""
    raw = page_raw.where("html is not null and url is not null").groupBy("url").agg(F.max_by("html", F.struct("fetched_at", "seq", "fetch_id")).alias("html"))
    p = html.parsed_pages(raw, ["url"])
    told = content.informative_images(F.col("images"))
    hits = F.filter("anchors", lambda a: (F.length(a["text"]) <= 60) & T.matches(a["text"], "action_verb"))
    ranked = F.array_sort(F.transform(hits, lambda a: F.struct((~a["in_main"]).alias("outside"), a["in_chrome"].alias("chrome"), a["text"].alias("label"))))
    labels = F.transform(ranked, lambda x: x["label"])
    first = F.get(F.filter(labels, lambda x: ~x.rlike(CONSENT)), F.lit(0))
    seen = p.select(
        "url", "empty_shell", F.col("n_words").cast("bigint").alias("n_words"), F.size(told).cast("bigint").alias("n_images"), F.size(F.filter(told, lambda x: F.coalesce(F.trim(x["alt"]), F.lit("")) == "")).cast("bigint").alias("n_missing"),
        F.size(F.array_distinct(labels)).cast("bigint").alias("n_labels"), F.size(F.array_distinct(F.transform(F.filter(ranked, lambda x: ~x["outside"]), lambda x: x["label"]))).cast("bigint").alias("n_main_labels"), F.coalesce(first.rlike(AMBIGUOUS), F.lit(False)).alias("ambiguous"),
        F.aggregate("forms", F.lit(0), lambda a, f: a + F.size(f["fields"])).cast("bigint").alias("n_fields"),
    )
    typed = profile.with_kind(page)
    windows = T.greedy_windows(F.col("main_text"), target)
    said = typed.select("page_id", "site", "url", F.col("status"), profile.kind_of(typed)["page_type"].alias("page_type"), F.transform(content.statements(), content.content_words).alias("facts"), windows.alias("w"))
    said = said.withColumn("carried", F.transform("w", content.content_words))
    support = lambda f: F.coalesce(F.array_max(F.transform("carried", lambda w: F.size(F.array_intersect(f, w)) / F.size(f))), F.lit(0.0))
    said = said.select("page_id", "site", "url", "status", "page_type", F.size("facts").cast("bigint").alias("n_facts"), F.size(F.filter("facts", lambda f: support(f) < 0.6)).cast("bigint").alias("n_missed"), F.size("w").cast("bigint").alias("n_windows"), F.size(F.filter("w", lambda w: content.self_contained(w).isNotNull())).cast("bigint").alias("n_defects"))
    return said.join(seen, "url")


def parsed_findings(page: DataFrame, page_raw: DataFrame) -> DataFrame:
    """(site, page_id, url, check_id, measure) of the rules that hold on pages that answered 200."""
    return fired(parsed_facts(page, page_raw).where("status = 200"), CHECKS, ["site", "page_id", "url"])


def rendered_findings(pairs: DataFrame) -> DataFrame:
    """(site, url, check_id, measure) of pairs (site, url, raw, rendered) of markup: what only a browser sees. A missing side is no pair."""
    both = pairs.where("raw is not null and rendered is not null")
    side = lambda column: html.parsed_pages(both.select("site", "url", F.col(column).alias("html")), ["site", "url"]).select("site", "url", F.col("n_main_words").alias(f"{column}_words"), F.size(F.array_distinct(F.transform("anchors", lambda a: a["href"]))).alias(f"{column}_links"))
    return fired(side("raw").join(side("rendered"), ["site", "url"]), RENDERED_CHECKS, ["site", "url"])


def probe_findings(bots: DataFrame, impossible: DataFrame) -> DataFrame:
    """(site, check_id, severity, measure) of probes: crawlers refused or challenged at the edge where others are not, and
    addresses that cannot exist but answer 200. One row per site and rule."""
    edge = crawling.edge_reach(bots).where("verdict in ('blocked', 'challenged')").groupBy("site", "verdict").agg(F.count_distinct("bot").alias("measure"))
    edge = edge.select("site", F.concat(F.lit("reach.edge.bot_ua_"), "verdict").alias("check_id"), F.when(F.col("verdict") == "blocked", "critical").otherwise("high").alias("severity"), "measure")
    soft = evidence.soft_404(impossible).where("verdict in ('soft_404', 'same_as_404')").groupBy("site").agg(F.count("*").alias("measure"), F.bool_or(F.col("verdict") == "soft_404").alias("other"))
    return edge.unionByName(soft.select("site", F.lit("reach.http.soft_404").alias("check_id"), F.when(F.col("other"), "medium").otherwise("low").alias("severity"), "measure"))
