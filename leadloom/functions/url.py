"""URLs and hosts as column expressions."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from leadloom import refdata as R
from leadloom.functions.text import alternation, col, group, null_if_empty, text_or_empty

HOST = r"(?i)^\s*https?://(?:[^/?#@]*@)?([^/?#:\s]+)"
PATH = r"(?i)^\s*https?://[^/?#]*([^?#]*)"
SOCIAL_HOST = "(" + "|".join(rf"{p}\.({tlds})" for p, tlds in R.SOCIAL_HOSTS) + ")"
SOCIAL_TEXT = (
    "(" + alternation([p for p, _ in R.SOCIAL_HOSTS if p != "x"]) + r"|x\.com)\.(com|org|net|io|gg|me|tv)"
)
QUERY_LINK = "google.com/search"


def bare_domain(url: Column | str) -> Column:
    """Host without scheme, ``www.``, port, path and trailing dot, in lower case; '' for no URL."""
    u = F.lower(F.trim(text_or_empty(url)))
    host = F.regexp_extract(u, r"^(?:https?://)?(?:www\.)?([^/?#:]*)", 1)
    return F.regexp_replace(host, r"\.$", "")


def same_domain(a: Column | str, b: Column | str) -> Column:
    return (bare_domain(a) == bare_domain(b)) & (bare_domain(a) != "")


def url_host(url: Column | str) -> Column:
    """Lower-case host of an absolute http(s) URL without ``www.``, NULL otherwise."""
    return F.regexp_replace(F.lower(group(HOST, col(url))), r"^www\.", "")


def url_path(url: Column | str) -> Column:
    return F.lower(F.regexp_extract(col(url), PATH, 1))


def url_origin(url: Column | str) -> Column:
    return F.lower(group(r"(?i)^\s*(https?://[^/?#]+)", col(url)))


def absolute_url(href: Column, base: Column) -> Column:
    """``href`` against the origin of ``base``; other schemes (mailto, tel, javascript) give NULL."""
    origin = url_origin(base)
    return (
        F.when(href.rlike("(?i)^https?://"), href)
        .when(href.startswith("//"), F.concat(F.lit("https:"), href))
        .when(href.rlike(r"^[a-zA-Z][a-zA-Z0-9+.-]*:"), F.lit(None).cast("string"))
        .when(href.startswith("/"), F.concat(origin, href))
        .otherwise(F.concat(origin, F.lit("/"), href))
    )


def social_platform(url: Column | str) -> Column:
    """First matching platform name of the host, NULL when none."""
    host = url_host(url)
    ladder = F.when(F.lit(False), F.lit(None).cast("string"))
    for name, _ in R.SOCIAL_HOSTS:
        if name == "x":
            continue
        pattern = r"twitter|x\.com" if name == "twitter" else name
        ladder = ladder.when(host.rlike(pattern), F.lit(name))
    return ladder


def is_query_link(url: Column | str) -> Column:
    return text_or_empty(url).contains(QUERY_LINK)


def query_link_text(url: Column | str) -> Column:
    """The decoded ``q`` parameter of a search link."""
    q = group(r"[?&]q=([^&]+)", col(url))
    return F.coalesce(F.try_url_decode(q), q)


def query_link_location(url: Column | str) -> Column:
    return F.trim(group(r"(?i)\s+(?:in|at|near|around)\s+([^,]+)", query_link_text(url)))


def query_link_name(url: Column | str) -> Column:
    """Business name guessed from a search link: first part, trade words removed, title case."""
    raw = F.coalesce(query_link_text(url), F.lit(""))
    first = null_if_empty(F.trim(F.regexp_extract(raw, r"^([^,]*)", 1)))
    name = F.coalesce(first, F.lit("Unknown Business"))
    noise = r"(?i)\b(" + alternation(R.QUERY_LINK_NAME_NOISE) + r")\b"
    cleaned = F.trim(F.regexp_replace(F.regexp_replace(name, noise, ""), r"\s+", " "))
    return F.initcap(F.lower(F.when(F.length(cleaned) >= 3, cleaned).otherwise(name)))


def careers_path(url: Column | str) -> Column:
    return F.regexp_replace(url_path(url), "/$", "").isin(R.CAREERS_PATHS)
