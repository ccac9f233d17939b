"""Crawl rules: parsing robots texts and deciding paths (RFC 9309)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

MOST_BYTES = 500 * 1024
MARK = chr(0xFEFF)

# Crawlers by what they fetch for.
BOTS = {
    "retrieval": "OAI-SearchBot ChatGPT-User PerplexityBot Perplexity-User Claude-User Claude-SearchBot Google-CloudVertexBot Bingbot Googlebot Applebot Amazonbot MistralAI-User DuckAssistBot meta-externalfetcher".split(),
    "training": "GPTBot ClaudeBot CCBot anthropic-ai cohere-ai Bytespider Diffbot Omgilibot Timpibot img2dataset".split(),
    "dual_purpose": "Google-Extended Applebot-Extended Meta-ExternalAgent FacebookBot PetalBot".split(),
}


def category(token: Column, bots: dict[str, list[str]] | None = None) -> Column:
    """What a known crawler fetches for, or null. Names are compared without case; ``bots`` replaces the known ones."""
    out, token = None, F.lower(token)
    for name, tokens in (bots or BOTS).items():
        tokens = [t.lower() for t in tokens]
        out = F.when(token.isin(tokens), F.lit(name)) if out is None else out.when(token.isin(tokens), F.lit(name))
    return out


def _each(crawlers: list[str]) -> Column:
    return F.explode(F.array(*map(F.lit, crawlers))).alias("token")


def parse(robots: DataFrame) -> DataFrame:
    """Rule rows (site, group_no, agent, allow, pattern, line_no, raw, crawl_delay) of robots texts (site, text).

    Texts are cut at 500 KiB. Agent lines that follow each other share a group; a rule line opens the way for the next group;
    rules before any agent are dropped. A group without rules has one row with a null pattern.
    """
    text = F.regexp_replace(F.substring("text", 1, MOST_BYTES), "^" + MARK, "")
    lines = robots.select("site", F.posexplode(F.split(text, r"\r\n|\r|\n")).alias("at", "raw"))
    bare = F.trim(F.regexp_replace("raw", r"#.*$", ""))
    field = F.lower(F.trim(F.regexp_extract(bare, r"^([A-Za-z\-]+) *:", 1)))
    rows = lines.select("site", (F.col("at") + 1).alias("line_no"), "raw", field.alias("field"), F.trim(F.regexp_extract(bare, r"^[^:]*:(.*)$", 1)).alias("value"))
    rows = rows.where(F.col("field").isin("user-agent", "allow", "disallow", "crawl-delay"))
    in_order = Window.partitionBy("site").orderBy("line_no")
    rows = rows.withColumn("before", F.lag("field").over(in_order))
    opens = (F.col("field") == "user-agent") & (F.coalesce("before", F.lit("")) != "user-agent")
    rows = rows.withColumn("group_no", F.sum(opens.cast("int")).over(in_order) - 1).where("group_no >= 0")
    delay = F.max(F.when(F.col("field") == "crawl-delay", F.col("value").try_cast("double"))).alias("crawl_delay")
    groups = rows.groupBy("site", "group_no").agg(F.collect_set(F.when(F.col("field") == "user-agent", F.col("value"))).alias("agents"), delay)
    rules = rows.where(F.col("field").isin("allow", "disallow")).select("site", "group_no", (F.col("field") == "allow").alias("allow"), F.col("value").alias("pattern"), "line_no", "raw")
    return groups.join(rules, ["site", "group_no"], "left").select("site", "group_no", F.explode("agents").alias("agent"), "allow", "pattern", "line_no", "raw", "crawl_delay")


def pattern_regex(pattern: Column) -> Column:
    """A path pattern as an anchored regex: ``*`` any characters, a final ``$`` the end, everything else literal."""
    escaped = F.regexp_replace(pattern, r"([\\.^+?()\[\]{}|$])", r"\\$1")
    return F.concat(F.lit("^"), F.regexp_replace(F.regexp_replace(escaped, r"\*", ".*"), r"\\\$\z", r"\\z"))


def octets(path: Column) -> Column:
    """The path with escapes of unreserved letters and digits undone where they are common; reserved ones stay."""
    out = path
    for code in ("2D", "2E", "5F", "7E"):
        out = F.regexp_replace(out, f"(?i)%{code}", chr(int(code, 16)))
    return out


def applicable(rules: DataFrame, crawlers: list[str]) -> DataFrame:
    """(site, token, group_no) that applies to each crawler: the longest agent name contained in its token, a full match
    before all, else ``*``; of several groups for the same name the first."""
    agents = rules.where("agent is not null").select("site", "group_no", F.lower("agent").alias("agent")).distinct()
    pairs = agents.select("*", _each(crawlers)).where((F.col("agent") == "*") | F.contains(F.lower("token"), F.col("agent")))
    rank = F.struct((F.col("agent") == F.lower("token")).alias("exact"), F.when(F.col("agent") == "*", 0).otherwise(F.length("agent")).alias("length"), (-F.col("group_no")).alias("first"))
    best = pairs.groupBy("site", "token").agg(F.max(F.struct(rank.alias("rank"), "group_no", "agent")).alias("best"))
    return best.select("site", "token", "best.group_no", F.col("best.agent").alias("matched_agent"))


def _decided(paths: DataFrame, rules: DataFrame, chosen: DataFrame) -> DataFrame:
    """(site, path, token, best) for the paths that a rule of the crawler's group ``chosen`` (site, token, group_no) matches. Rules
    are few per site and joined on it, so no path meets another site's rules."""
    live = rules.where("pattern is not null and pattern <> ''").select("site", "group_no", "allow", "pattern", "line_no", pattern_regex(octets(F.col("pattern"))).alias("rx"), F.length("pattern").alias("n"))
    met = paths.select("site", "path").distinct().join(chosen, "site").join(live, ["site", "group_no"]).where(F.expr("path rlike rx"))
    return met.groupBy("site", "path", "token").agg(F.max(F.struct("n", "allow", (-F.col("line_no")).alias("early"), "pattern", "line_no")).alias("best"))


def decisions(paths: DataFrame, rules: DataFrame, crawlers: list[str]) -> DataFrame:
    """(site, path, token, allowed, pattern, line_no) for every path of ``paths`` (site, path) and crawler.

    The longest matching pattern decides, Allow wins a tie, empty patterns never match, no match allows.
    """
    matched = _decided(paths, rules, applicable(rules, crawlers))
    everything = paths.select("site", "path").distinct().select("*", _each(crawlers))
    return everything.join(matched, ["site", "path", "token"], "left").select("site", "path", "token", F.coalesce("best.allow", F.lit(True)).alias("allowed"), "best.pattern", "best.line_no")


def blanket_disallows(rules: DataFrame) -> DataFrame:
    """Sites whose ``*`` group disallows ``/`` and allows nothing longer than one character."""
    star = rules.where("agent = '*'").groupBy("site").agg(F.bool_or((~F.col("allow")) & (F.col("pattern") == "/")).alias("closed"), F.bool_or(F.col("allow") & (F.length("pattern") > 1)).alias("opened"))
    return star.where("closed and not coalesce(opened, false)").select("site")


def named_blocks(paths: DataFrame, rules: DataFrame, bots: dict[str, list[str]] | None = None) -> DataFrame:
    """(site, category, n_crawlers, n_paths): known crawlers whose own group, not only ``*``, keeps them from paths of ``paths`` (site, path)."""
    own = rules.where(category(F.col("agent"), bots).isNotNull()).groupBy("site", F.lower("agent").alias("token")).agg(F.min("group_no").alias("group_no"))
    shut = _decided(paths, rules, own).where("not best.allow")
    return shut.groupBy("site", category(F.col("token"), bots).alias("category")).agg(F.count_distinct("token").alias("n_crawlers"), F.count_distinct("path").alias("n_paths"))
