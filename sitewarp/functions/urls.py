"""URL algebra on columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def reference_key(url: Column) -> Column:
    """The key under which two addresses are the same reference: everything from ``#`` dropped,
    scheme and host lower-cased, one final ``/`` dropped. Null stays null; relative addresses have no host."""
    bare = F.substring_index(url, "#", 1)
    head = F.regexp_extract(bare, r"^([A-Za-z][A-Za-z0-9+.\-]*://[^/?]*)", 1)
    whole = F.concat(F.lower(head), F.substr(bare, F.length(head) + F.lit(1)))
    return F.regexp_replace(whole, r"/\z", "")


def scheme(url: Column) -> Column:
    return F.lower(F.regexp_extract(url, r"^([A-Za-z][A-Za-z0-9+.\-]*):", 1))


def authority(url: Column) -> Column:
    return F.lower(F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.\-]*://([^/?#]*)", 1))


def host(url: Column) -> Column:
    """The lower-cased host without user and port; empty for relative addresses."""
    return F.regexp_replace(F.regexp_replace(authority(url), r"^[^@]*@", ""), r":[0-9]*\z", "")


def path(url: Column) -> Column:
    """The path, ``/`` if there is none."""
    bare = F.regexp_replace(F.regexp_replace(url, r"(?s)[?#].*\z", ""), r"^[A-Za-z][A-Za-z0-9+.\-]*://[^/]*", "")
    return F.when(bare == "", F.lit("/")).otherwise(bare)


def query(url: Column) -> Column:
    return F.regexp_extract(url, r"\?([^#]*)", 1)


def segments(url: Column) -> Column:
    return F.filter(F.split(path(url), "/"), lambda s: s != "")


def depth(url: Column) -> Column:
    return F.size(segments(url))


def bare_host(name: Column) -> Column:
    """A host without a leading ``www.``, for comparing sites."""
    return F.regexp_replace(name, r"^www\.", "")


def collapsed_path(p: Column) -> Column:
    """Dot segments and empty segments resolved; a final slash stays."""
    folded = F.aggregate(
        F.split(p, "/"),
        F.array().cast("array<string>"),
        lambda acc, s: F.when(s.isin("", "."), acc).when(s == "..", F.slice(acc, 1, F.greatest(F.size(acc) - 1, F.lit(0)))).otherwise(F.concat(acc, F.array(s))),
    )
    ending = F.when(p.endswith("/") & (F.size(folded) > 0), F.lit("/")).otherwise(F.lit(""))
    return F.concat(F.lit("/"), F.array_join(folded, "/"), ending)


def parameters(url: Column) -> Column:
    """Array of (key, value) of the query; blank values kept, pairs without a key dropped."""
    pairs = F.transform(F.split(query(url), "&"), lambda x: F.struct(F.substring_index(x, "=", 1).alias("key"), F.when(x.contains("="), F.regexp_replace(x, r"^[^=]*=", "")).otherwise(F.lit("")).alias("value")))
    return F.filter(pairs, lambda x: x["key"] != "")


# What tracking parameters begin with.
TRACKING = r"(?i)^(utm_|ga_|gclid|fbclid|msclkid|mc_|ref|referrer|source)"


def normalised(url: Column) -> Column:
    """One spelling per http(s) address: scheme and host lower-cased, default port, fragment and tracking parameters
    dropped, dot segments resolved, parameters sorted. Null for anything else."""
    kept = F.array_sort(F.filter(parameters(url), lambda x: ~x["key"].rlike(TRACKING)))
    text = F.array_join(F.transform(kept, lambda x: F.concat(x["key"], F.lit("="), x["value"])), "&")
    name = F.regexp_replace(authority(url), r"^[^@]*@", "")
    name = F.when(scheme(url) == "http", F.regexp_replace(name, r":80\z", "")).otherwise(F.regexp_replace(name, r":443\z", ""))
    whole = F.concat(scheme(url), F.lit("://"), name, collapsed_path(path(url)), F.when(text == "", F.lit("")).otherwise(F.concat(F.lit("?"), text)))
    return F.when(scheme(url).isin("http", "https") & (host(url) != ""), whole)


def resolved(href: Column, base: Column) -> Column:
    """``href`` against the address it stands on, before normalisation."""
    root = F.concat(scheme(base), F.lit("://"), authority(base))
    folder = F.regexp_replace(path(base), r"[^/]*\z", "")
    return (
        F.when(href.rlike(r"^[A-Za-z][A-Za-z0-9+.\-]*:"), href)
        .when(href.startswith("//"), F.concat(scheme(base), F.lit(":"), href))
        .when(href.startswith("/"), F.concat(root, href))
        .when(href.startswith("?"), F.concat(root, path(base), href))
        .otherwise(F.concat(root, folder, href))
    )


# Wording of href kinds, in the order in which they are tried.
HREF_KINDS = (
    ("fragment", r"^(#.*)?$"),
    ("non_http", r"(?i)^(javascript|data|vbscript|about|mailto|tel|sms|callto|ftp|file):"),
    ("malformed", r"^[^@\s/][^@\s]*@[^@\s]+\.[A-Za-z]{2,}$"),
    ("malformed", r"^[+()\d][\d\s()+.\-]{6,}$"),
    ("malformed", r"^[^/:?#.,]*,\s*\S+.*$"),
)


def href_kind(href: Column, base: Column) -> Column:
    """fragment, non_http, malformed, internal or external."""
    raw = F.trim(F.coalesce(href, F.lit("")))
    address = normalised(resolved(raw, base))
    own = (host(address) == host(base)) | host(address).endswith(F.concat(F.lit("."), host(base)))
    kind = F.when(address.isNull(), F.lit("malformed")).when(own, F.lit("internal")).otherwise(F.lit("external"))
    for name, pattern in reversed(HREF_KINDS):
        plain_text = ~raw.contains("://") if name == "malformed" else F.lit(True)
        spaced = raw.contains(" ") if pattern.startswith(r"^[^/:?#.,]*,") else F.lit(True)
        kind = F.when(raw.rlike(pattern) & plain_text & spaced, F.lit(name)).otherwise(kind)
    return kind


# File extensions that are no pages, facet parameters and paths that multiply without new content.
NON_PAGE_EXTENSIONS = "jpg jpeg png gif webp avif svg ico bmp tiff css js mjs map json xml txt csv tsv pdf doc docx xls xlsx ppt pptx odt rtf zip gz tar rar 7z dmg exe msi apk mp3 mp4 avi mov wmv webm ogg wav m4a woff woff2 ttf eot otf".split()
FACETS = "filter filters facet refine refinement sort sortby orderby order colour color size brand price price_min price_max min_price max_price rating availability view layout display columns per_page perpage limit offset start from cursor sid sessionid session_id phpsessid replytocom share print amp".split()
NON_PAGES = (
    ("feed_endpoint", r"/feed/?$|/rss/?$|/atom/?$|/feed\.xml$"),
    ("wordpress_infrastructure", r"/wp-json/|/wp-admin/|/wp-includes/|/xmlrpc\.php"),
    ("uploads_directory", r"/wp-content/uploads/"),
    ("woocommerce_ajax", r"[?&]wc-ajax="),
    ("cart_mutation_endpoint", r"[?&]add-to-cart="),
    ("cart_or_checkout", r"/cart/?$|/checkout|/basket/?$|/order-received"),
    ("session_scoped_list", r"/wishlist|/compare/?$"),
    ("authenticated_area", r"/(login|signin|sign-in|logout|signout|register|my-account|account/)"),
    ("admin_area", r"/admin(/|$)|/administrator(/|$)|/cpanel"),
    ("non_page_path", r"/cgi-bin/|/\.git/|/\.env$"),
    ("date_archive_leaf", r"/(20\d{2})/(0?[1-9]|1[0-2])/(0?[1-9]|[12]\d|3[01])/?$"),
    ("taxonomy_pagination", r"/tag/|/tags/|/author/|/category/page/"),
    ("search_results", r"/search/?$|[?&](q|s|query|keyword)="),
)
MOST_SEGMENTS, MOST_PARAMETERS, MOST_PAGES = 8, 3, 3


def trap_reason(url: Column) -> Column:
    """The first rule by which an address is a crawl trap, or null: extension, depth, repeated segments, deep
    pagination, non-page paths, number of parameters, facets."""
    low, keys = F.lower(path(url)), F.transform(parameters(url), lambda x: F.lower(x["key"]))
    parts = F.filter(F.split(low, "/"), lambda s: s != "")
    extension = F.regexp_extract(low, r"[^/]\.([a-z0-9]+)$", 1)
    twice = F.exists(F.zip_with(parts, F.slice(parts, F.lit(2), F.size(parts)), lambda a, b: a == b), lambda x: x)
    thrice = F.exists(parts, lambda s: F.size(F.filter(parts, lambda t: t == s)) >= 3)
    page_no = F.regexp_extract(low, r"/page/(\d+)", 1).try_cast("int")
    paged = F.exists(parameters(url), lambda x: F.lower(x["key"]).isin("page", "paged", "p") & (x["value"].try_cast("int") > MOST_PAGES))
    rule = F.when(extension.isin(NON_PAGE_EXTENSIONS), F.lit("non_html_extension"))
    rule = rule.when(F.size(parts) > MOST_SEGMENTS, F.lit("excessive_depth")).when(twice | thrice, F.lit("repeating_segment")).when(page_no > MOST_PAGES, F.lit("deep_pagination"))
    for name, pattern in NON_PAGES:
        rule = rule.when(url.rlike("(?i)" + pattern), F.lit(name))
    return rule.when(F.size(keys) > MOST_PARAMETERS, F.lit("excessive_query_params")).when(F.arrays_overlap(keys, F.array(*map(F.lit, FACETS))), F.lit("faceted_param")).when(paged, F.lit("deep_pagination"))


# Page types by path, with the confidence of the path. Those of 0.9 and more come before declared types.
PATH_TYPES = (
    (r"^/?$", "home", 0.95),
    (r"/(contact|contact-us|get-in-touch)/?$", "contact", 0.9),
    (r"/(about|about-us|team|company|our-story|who-we-are)(/|$)", "about", 0.85),
    (r"/(pricing|plans|price|subscribe)/?$", "pricing", 0.9),
    (r"/(docs|documentation|guide|guides|reference|api|manual|handbook)(/|$)", "docs", 0.85),
    (r"/(blog|news|article|post|insights|stories)/[^/]+/?$", "article", 0.85),
    (r"/(blog|news|insights|stories|resources)/?$", "category", 0.8),
    (r"/(collections|category|categories|catalogue|catalog|range|shop-all)/[^/]+/?$", "category", 0.85),
    (r"/(product|products|item|p)/[^/]+/?$", "product", 0.85),
    (r"/(product|products|shop|store|collections|category|catalogue|catalog)/?$", "category", 0.8),
    (r"/(login|signin|sign-in|register|signup|cart|checkout|account|search|404)(/|$)", "utility", 0.9),
    (r"/(privacy|terms|legal|cookies?|imprint|gdpr|accessibility)(/|$)", "utility", 0.85),
)
SURE = 0.9


def path_type(url: Column, least: float = 0.0) -> Column:
    """struct(page_type, confidence) of the first path rule of at least ``least`` confidence, or null."""
    p, chosen = path(url), None
    for pattern, name, confidence in PATH_TYPES:
        if confidence >= least:
            value = F.struct(F.lit(name).alias("page_type"), F.lit(confidence).alias("confidence"))
            chosen = F.when(p.rlike("(?i)" + pattern), value) if chosen is None else chosen.when(p.rlike("(?i)" + pattern), value)
    return chosen


def ancestors(url: Column) -> Column:
    """The addresses of all path prefixes above an address, each with a final slash."""
    parts = segments(url)
    root = F.concat(scheme(url), F.lit("://"), authority(url))
    levels = F.when(F.size(parts) > 0, F.sequence(F.lit(0), F.size(parts) - 1)).otherwise(F.array().cast("array<int>"))
    return F.transform(levels, lambda n: F.concat(root, F.when(n == 0, F.lit("/")).otherwise(F.concat(F.lit("/"), F.array_join(F.slice(parts, F.lit(1), n), "/"), F.lit("/")))))


def digest_slug(url: Column) -> Column:
    return F.substring(F.sha1(url), 1, 16)


def path_slug(url: Column) -> Column:
    """A readable name of at most 80 characters; different addresses may share it, so it is never a key."""
    text = F.concat_ws("-", path(url), F.nullif(query(url), F.lit("")))
    name = F.substring(F.regexp_replace(F.regexp_replace(text, r"[^A-Za-z0-9]+", "-"), r"^-+|-+$", ""), 1, 80)
    return F.when(name == "", F.lit("index")).otherwise(name)
