"""Text measures and patterns. Patterns use explicit ASCII classes, so that other engines agree on them."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

# Named patterns. They hold in Java and in RE2; matching ignores case unless noted.
PATTERNS = {
    "price": r"[$£€¥] ?[0-9][0-9,.]*|\b[0-9][0-9,.]* ?(usd|eur|gbp|inr)\b",
    "phone": r"(\+[0-9]{1,3}[ .\-]?)?(\([0-9]{2,4}\)[ .\-]?)?[0-9]{3,4}[ .\-]?[0-9]{3,4}",
    "email": r"[a-z0-9._%+\-]+@[a-z0-9.\-]+\.[a-z]{2,}",
    "postal_code": r"\b[0-9]{4,6}\b|\b[A-Z]{1,2}[0-9]{1,2}[A-Z]? ?[0-9][A-Z]{2}\b",
    "opening_hours": r"\b(mon|tue|wed|thu|fri|sat|sun)[a-z]*[^a-z.][^.]{0,29}[0-9]{1,2}[:.]?[0-9]{0,2} *(am|pm|-)",
    "byline": r"\bby[ \t\r\n]+[A-Z][a-z]+[ \t\r\n]+[A-Z][a-z]+",
    "trial": r"\b(free trial|start (a |an )?([0-9]+[ \-]day )?(free )?trial|book a demo|request a demo|get started free|try it free|start free)\b",
    "cart": r"\b(add to (cart|basket|bag)|buy now|checkout)\b",
    "street_address": r"\b[0-9]{1,5} [a-z]+( [a-z]+)? (street|st|road|rd|avenue|ave|lane|ln|drive|dr|boulevard|blvd)\b",
    "injection": r"ignore (all )?(previous|prior|above) (instructions|prompts)|disregard (all )?(previous|prior|above)|you are now|system prompt|as an ai (language )?model|do not (tell|reveal)|new instructions:",
    "statistic": r"\b[0-9][0-9,.]* ?(%|percent|per cent|million|billion)",
    "quotation": r"[\"“][^\"”]{40,}[\"”]",
    "citation": r"\b(according to|study (by|from)|research (by|from)|survey (by|of)|published in|source:)",
    "definition": r"\b(is|are) (a|an|the) [a-z]+",
    "pronoun_opener": r"^(it|this|that|these|those|they|he|she|its|their|such)\b",
    "back_reference": r"\b(as (mentioned|noted|described|discussed) (above|earlier|before|previously)|see above|the (above|former|latter|aforementioned)|earlier in this)\b",
    "audience_hint": r"\b(for|helps?|built for|designed for|made for) [a-z]+",
    "action_verb": r"\b(buy|order|shop|get|start|try|book|contact|call|sign up|subscribe|download|learn more|request|join|register|add to)\b",
    "social_proof": r"\b(testimonials?|reviews?|rated [0-9]|customers?|case stud(y|ies)|trusted by|stars?)\b",
    "policy_path": r"/(privacy|terms|legal|imprint|refund|returns?|shipping|contact|about)\b",
    "free_offer": r"\b(free|no cost|open source)\b",
    "volatile": r"\b(currently|as of|this year|latest|newest|now available|recently|today)\b",
    "superlative": r"\b(best|leading|world-class|number one|premier|top-rated|cutting-edge|unrivall?ed|unmatched|revolutionary)\b",
    "question_words": r"\b(faq|frequently asked|how do i|how to|what is|why )\b",
    "iso_date": r"\b[0-9]{4}-[0-9]{2}-[0-9]{2}\b",
    "text_date": r"\b[0-9]{1,2} (january|february|march|april|may|june|july|august|september|october|november|december) [0-9]{4}\b",
    "copyright_year": r"(©|copyright|\(c\)) ?[0-9]{4}",
    "generic_title": r"^(home|homepage|welcome|untitled|index|page|new page|default)$",
    "script_notice": r"enable javascript|javascript is required|requires javascript",
    "hidden_css": r"display: ?none|visibility: ?hidden|font-size: ?0|opacity: ?0[^.]|text-indent: ?-[0-9]{3,}|left: ?-[0-9]{4,}",
    "viewport_meta": r"<meta[^>]+name=[\"']?viewport",
    "autoplay": r"<(video|audio)[^>]+autoplay|popup|interstitial",
    "speaks_to": r"\b(for|helps?|help you|built (for|to)|designed (for|to)|made (for|to)|used by|trusted by|lets? you|so you can|gives? you|we help|(is|are) (a|an|the)|(meet|join) the|(tools?|software|platform) (for|to)|system for) ",
    "vague_opener": r"^[ \t\r\n]*(welcome|hello|hi there|about us|home|introducing us|our website)\b",
    "proof": r"\b(testimonial|review|rated|rating|stars?|trusted by|used by|join(ed)? (over )?[0-9,]+|[0-9,]+\+? (customers|companies|teams|users)|case stud(y|ies)|success story)\b|[“\"][^”\"]{40,}[”\"][ \t\r\n]*[\-—][ \t\r\n]*[A-Z]",
    "volatile_fact": r"\b(price|pricing|per month|per year|currently|as of|latest|newest|this year|opening hours|in stock|available now|current version|roadmap)\b",
    "author_hint": r"\b(by [A-Z][a-z]+ [A-Z][a-z]+|author|written by|posted by)\b",
    "definitional": r"\b(is|are|provides|offers|helps|lets you|enables|delivers|means|specialises|specializes)\b",
    "prior_context": r"\b(your (selected|chosen|current|existing) [a-z ]{2,20}|as (we )?(discussed|mentioned|agreed|noted) |as (mentioned|described|explained) above|continue where you left off|welcome back|(resume|return to) your|the (above|aforementioned) [a-z]{3,20})\b",
    "directive": r"ignore[ \t\r\n]+(all[ \t\r\n]+)?(previous|prior|above)[ \t\r\n]+instructions|disregard[ \t\r\n]+(the[ \t\r\n]+)?(above|previous|earlier)|as an ai language model|you are (chatgpt|claude|gemini|an ai|a large language model)|system[ \t\r\n]*prompt|prompt[ \t\r\n]*injection|(do not|don'?t) (mention|reveal|disclose) (this|the following|that)|(instructions?|note|message) (to|for) (the )?(ai|assistant|llm|chatbot|model)|<!--[ \t\r\n]*(ai|llm|assistant|gpt)[: ]",
    "hidden_style": r"style *= *[\"'][^\"']*(display *: *none|visibility *: *hidden|opacity *: *0(\.0+)?[^0-9.]|font-size *: *0|text-indent *: *- *[0-9]{3,}|(left|top) *: *- *[0-9]{4,})",
    "zoom_off": r"user-scalable *= *(no|0)|maximum-scale *= *1(\.0)?[^0-9.]",
    "modal_on_load": r"data-(modal|popup|overlay)-(trigger|on)=[\"']?(load|onload|pageload|scroll)|class=[\"'][^\"']*(newsletter-popup|exit-intent|interstitial|modal--auto)|window\.onload *= *[^;]{0,80}(modal|popup|overlay)",
    "gated": r"<details[ >]|class=[\"'][^\"']*(accordion|collapse|read-more)",
    "plain_source": r"(src|srcset|data) *= *[\"']http://",
    "mount_root": r"id=[\"'](root|app|__next|__nuxt)[\"']",
}
#: Patterns in which case matters.
CASED = ("byline", "postal_code", "author_hint")
#: Signs of which every match holds at least one: a quick search that spares most texts the pattern. Letters do not pay, since
#: texts would have to be lowered first.
NEEDED = {"email": ("@",), "quotation": ('"', "“"), "iso_date": ("-",), "plain_source": ("://",), "zoom_off": ("=",), "viewport_meta": ("<",), "mount_root": ("=",)}
# Engines differ on what \b means beside letters outside ASCII, so it is spelled out.
PATTERNS = {name: re.sub(r"\\b(?=[(\[a-z])(?<![)\]*+].)", "(?:^|[^A-Za-z0-9_])", p) for name, p in PATTERNS.items()}
PATTERNS = {name: p.replace(r"\b", "(?:[^A-Za-z0-9_]|$)") for name, p in PATTERNS.items()}

#: Zero-width and direction characters.
INVISIBLE = "".join(map(chr, (0x200B, 0x200C, 0x200D, 0x200E, 0x200F, 0x202A, 0x202B, 0x202C, 0x202D, 0x202E, 0x2060, 0x2066, 0x2069, 0xFEFF)))


def _regex(name: str) -> str:
    return PATTERNS[name] if name in CASED else "(?i)" + PATTERNS[name]


def _worth(text: Column, name: str) -> Column | None:
    """Whether the text holds what the pattern cannot do without, or null where nothing is known."""
    out = None
    for literal in NEEDED.get(name, ()):
        out = F.contains(text, F.lit(literal)) if out is None else out | F.contains(text, F.lit(literal))
    return out


def matches(text: Column, name: str) -> Column:
    worth, hit = _worth(text, name), text.rlike(_regex(name))
    return F.coalesce(hit if worth is None else worth & hit, F.lit(False))


def occurrences(text: Column, name: str) -> Column:
    worth, n = _worth(text, name), F.regexp_count(text, F.lit(_regex(name)))
    return F.coalesce(n if worth is None else F.when(worth, n), F.lit(0)).cast("bigint")


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(r"[^ \t\r\n]+")), F.lit(0)).cast("bigint")


def tokens(text: Column) -> Column:
    return F.coalesce(F.regexp_extract_all(text, F.lit(r"[A-Za-z0-9][A-Za-z0-9'’\-]*"), F.lit(0)), F.array().cast("array<string>"))


def invisible_count(text: Column) -> Column:
    return F.coalesce(F.length(text) - F.length(F.translate(text, INVISIBLE, "")), F.lit(0)).cast("bigint")


def sentences(text: Column) -> Column:
    """Non-empty sentences; a sentence ends with . ! or ? and white space."""
    marked = F.regexp_replace(text, r"([.!?])[ \t\r\n]+", "$1\x01")
    return F.filter(F.transform(F.split(marked, "\x01"), lambda s: F.regexp_replace(s, r"^[ \t\r\n]+|[ \t\r\n]+$", "")), lambda s: s != "")


def boilerplate_ratio(main_words: Column, all_words: Column) -> Column:
    return F.when(all_words > 0, 1 - main_words / all_words).otherwise(F.lit(0.0))


# Date forms, tried in this order.
DATE_FORMS = ("yyyy-MM-dd", "d MMMM yyyy", "MMMM d, yyyy", "d MMM yyyy", "MM/dd/yyyy", "dd.MM.yyyy", "yyyy/MM/dd")


def any_date(text: Column) -> Column:
    """A date from ISO, long, RFC 1123 or numeric forms; null if none fits. A weekday, time and zone are ignored."""
    bare = F.trim(F.regexp_replace(F.regexp_replace(text, r"^[A-Za-z]{3}, *", ""), r"[T ][0-9]{1,2}:[0-9]{2}.*$", ""))
    return F.coalesce(*(F.try_to_date(bare, form) for form in DATE_FORMS))


def greedy_windows(text: Column, target: int = 300, overlap: float = 0.15) -> Column:
    """Overlapping windows of whole sentences: a window is closed when the next sentence would exceed ``target``
    tokens; the next begins with its last sentences that hold at least ``overlap`` of the target."""
    least = max(1, int(target * overlap))
    sized = F.transform(sentences(text), lambda s: F.struct(s.alias("s"), F.size(tokens(s)).alias("n")))
    row = "array<struct<s:string,n:int>>"
    start = F.struct(F.array().cast("array<string>").alias("done"), F.array().cast(row).alias("open"), F.lit(0).alias("n"))

    def step(acc: Column, x: Column) -> Column:
        full = (acc["n"] + x["n"] > target) & (F.size(acc["open"]) > 0)
        back = F.aggregate(
            F.reverse(acc["open"]),
            F.struct(F.array().cast(row).alias("kept"), F.lit(0).alias("n")),
            lambda b, y: F.when(b["n"] >= least, b).otherwise(F.struct(F.concat(F.array(y), b["kept"]).alias("kept"), (b["n"] + y["n"]).alias("n"))),
        )
        window = F.array_join(F.transform(acc["open"], lambda y: y["s"]), " ")
        return F.when(
            full,
            F.struct(F.concat(acc["done"], F.array(window)).alias("done"), F.concat(back["kept"], F.array(x)).alias("open"), (back["n"] + x["n"]).alias("n")),
        ).otherwise(F.struct(acc["done"].alias("done"), F.concat(acc["open"], F.array(x)).alias("open"), (acc["n"] + x["n"]).alias("n")))

    def finish(acc: Column) -> Column:
        last = F.array_join(F.transform(acc["open"], lambda y: y["s"]), " ")
        return F.when(F.size(acc["open"]) > 0, F.concat(acc["done"], F.array(last))).otherwise(acc["done"])

    return F.coalesce(F.aggregate(sized, start, step, finish), F.array().cast("array<string>"))
