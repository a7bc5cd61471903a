"""Site and name classification predicates over hosts, URLs, titles and company names."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from leadloom import refdata as R
from leadloom.functions.text import alternation, col, has_any, let, text_or_empty, whole_word
from leadloom.functions.url import SOCIAL_HOST, SOCIAL_TEXT, url_host, url_path


def placeholder_host_pattern(allow: tuple[str, ...] = ()) -> str:
    """Exact host or subdomain of a listed domain, a listed first label, or a listed last label.

    ``allow`` removes entries by their first label, e.g. ``("example",)`` keeps example.* pages.
    """
    domains = [d for d in R.PLACEHOLDER_DOMAINS if d.split(".")[0] not in allow]
    prefixes = [p for p in R.PLACEHOLDER_PREFIXES if p.rstrip(".") not in allow]
    return (
        rf"(^|\.)({alternation(domains)})$|^({alternation(prefixes)})|\.({alternation(R.PLACEHOLDER_TLDS)})$"
    )


def is_placeholder_host(host: Column | str, allow: tuple[str, ...] = ()) -> Column:
    h = F.lower(text_or_empty(host))
    return (h == "") | h.rlike(placeholder_host_pattern(allow))


def is_blocked_platform(host: Column | str) -> Column:
    return F.regexp_replace(F.lower(text_or_empty(host)), r"^www\.", "").isin(R.BLOCKED_PLATFORMS)


def is_social_host(host: Column | str) -> Column:
    return F.lower(text_or_empty(host)).rlike(SOCIAL_HOST)


def is_social_url(url: Column | str) -> Column:
    """Host test; text that is not an absolute URL is searched for platform domains instead."""
    raw = F.lower(text_or_empty(url))
    return let(url_host(url), lambda h: F.when(h.isNotNull(), is_social_host(h)).otherwise(raw.rlike(SOCIAL_TEXT)))


def is_known_directory(host: Column | str) -> Column:
    return has_any(F.lower(text_or_empty(host)), R.KNOWN_DIRECTORIES)


DIRECTORY_HOST = "(" + "|".join(R.DIRECTORY_HOST_WORDS) + ")"
NOT_DIRECTORY = "(" + "|".join(R.NOT_DIRECTORY_WORDS) + ")"
DIRECTORY_PATH = r"/(directory|listings?|companies|businesses|agencies|providers)"
CLEAR_DIRECTORY = (
    r"^(business|company|service|provider).*(directory|listings?|marketplace)"
    r"|(directory|listings?|marketplace).*(business|company|service|provider)"
)
MARKET = "(" + "|".join(R.DOMAIN_MARKET_PATTERNS) + ")"
LIST_PATH = "(" + "|".join(R.LIST_PATHS) + ")"
LIST_PATH_NO_TITLE = "(" + "|".join(R.LIST_PATHS_NO_TITLE) + ")"
DIRECTORY_HOST_NO_TITLE = "(" + "|".join(R.DIRECTORY_HOST_WORDS_NO_TITLE) + ")"
LIST_TITLE = "(" + "|".join(R.MARKET_TITLES + R.LIST_TITLES) + ")"


def _keyword_host(host: Column, path: Column) -> Column:
    return (
        host.rlike(DIRECTORY_HOST)
        & ~host.rlike(NOT_DIRECTORY)
        & (path.rlike(DIRECTORY_PATH) | host.rlike(CLEAR_DIRECTORY))
    )


def is_directory_site(url: Column | str, title: Column | str | None = None) -> Column:
    """List page, marketplace or known directory, by URL and optional title. NULL/relative URL: false."""
    def test(host: Column, path: Column) -> Column:
        hit = (
            _keyword_host(host, path) | F.lower(text_or_empty(url)).rlike(MARKET) | path.rlike(LIST_PATH)
            | is_known_directory(host)
        )
        if title is not None:
            hit = hit | F.lower(text_or_empty(title)).rlike(LIST_TITLE)
        return F.coalesce(host.isNotNull() & hit, F.lit(False))

    return let(url_host(url), lambda h: let(url_path(url), lambda p: test(h, p)))


def is_directory_url(url: Column | str) -> Column:
    """Variant without a title: also blocked platforms and map/place style hosts."""
    def test(host: Column, path: Column) -> Column:
        hit = (
            is_blocked_platform(host)
            | _keyword_host(host, path)
            | F.lower(text_or_empty(url)).rlike(MARKET)
            | path.rlike(LIST_PATH_NO_TITLE)
            | host.rlike(DIRECTORY_HOST_NO_TITLE)
        )
        return F.coalesce(host.isNotNull() & hit, F.lit(False))

    return let(url_host(url), lambda h: let(url_path(url), lambda p: test(h, p)))


GENERIC_PATTERN = "(" + "|".join(R.GENERIC_NAME_PATTERNS) + ")"
GENERIC_WORDS = (
    rf"^({alternation(R.GENERIC_NAMES)})( .*)?$|^.* ({alternation(R.GENERIC_NAMES)})$"
    r"|is\s+for\s+sale|for\s+sale|domain\s+sale|buy\s+domain|premium\s+domain"
    r"|hugedomains|domain.*profile|domain.*marketplace"
)


def is_generic_name(name: Column | str) -> Column:
    """Page titles and for-sale texts that are no company name (pattern rules)."""
    n = F.lower(F.trim(text_or_empty(name)))
    return (F.length(text_or_empty(name)) < 2) | n.rlike(GENERIC_PATTERN) | n.isin("web")


def is_generic_page_name(name: Column | str) -> Column:
    """Stricter variant used on page text: equals, starts with or ends with a listed name."""
    n = F.lower(F.trim(text_or_empty(name)))
    return (F.length(text_or_empty(name)) < 2) | n.rlike(GENERIC_WORDS) | n.isin("web")


def is_place_id(name: Column | str) -> Column:
    n = text_or_empty(name)
    return n.rlike("^ChIJ[A-Za-z0-9_-]+$") & (F.length(n) > 20)


def is_valid_company_name(name: Column | str, relaxed: Column | None = None) -> Column:
    """2-200 characters, not only digits and punctuation, no null word.

    Rows where ``relaxed`` holds (query links carry little data) need two characters only.
    """
    n = F.trim(text_or_empty(name))
    strict = (
        F.length(n).between(2, 200) & ~n.rlike(r"^[\d\s\-_.]+$") & ~F.lower(n).isin("unknown", "n/a", "null")
    )
    return strict if relaxed is None else F.when(relaxed, F.length(n) >= 2).otherwise(strict)


ARTICLE_WORDS = (
    r"(?i)\b(how to|guide|tips|advice|starting a|launching a|getting started|learn|tutorial|article|blog|post|"
    r"licenses?|permits?|requirements?|legal|steps?|process)\b"
)
TRADE_WORDS = r"(?i)\b(restaurant|business|company|store|shop|hospital|clinic|school|university)\b"
ARTICLE_PATH = r"(?i)/(blog|article|post|guide|how-to|tips|advice|learn|tutorial)/"


def is_article(title: Column | str, url: Column | str) -> Column:
    """Blog post, article or guide by title words plus a trade word or an article path."""
    t = text_or_empty(title)
    return t.rlike(ARTICLE_WORDS) & (t.rlike(TRADE_WORDS) | text_or_empty(url).rlike(ARTICLE_PATH))


IRRELEVANT = [
    r"domain.*marketplace|domain.*sale|hugedomains|sortlist",
    r"example\.com|localhost|test\.com|placeholder",
    r"\b(how to|guide|tips|advice|starting a|launching a|getting started|learn|tutorial|article|blog|post)\b.*\b(restaurant|business|company|store|shop)\b",
    r"\b(licenses?|permits?|requirements?|legal|steps?|process)\b.*\b(restaurant|business|company|store|shop)\b",
    r"\b(restaurant|business|company|store|shop)\b.*\b(licenses?|permits?|requirements?|legal|guide|how to|tips)\b",
]
IRRELEVANT_PATTERN = "(" + "|".join(IRRELEVANT) + ")"


def relevance(name: Column | str, about: Column | str, signals: Column | str, industry: Column | str) -> Column:
    """struct(is_relevant, reason, confidence) from the lead text and the wanted industry."""
    joined = F.lower(
        F.concat_ws(" ", F.nullif(col(name), F.lit("")), F.nullif(col(about), F.lit("")),
                    F.array_join(F.coalesce(col(signals), F.array().cast("array<string>")), " "))
    )
    wanted = F.lower(text_or_empty(industry))

    def verdict(ok: bool, reason: str, confidence: float) -> Column:
        return F.struct(
            F.lit(ok).alias("is_relevant"), F.lit(reason).alias("reason"), F.lit(confidence).alias("confidence")
        )

    return let(joined, lambda text: (
        F.when(text.rlike(IRRELEVANT_PATTERN), verdict(False, "Obvious irrelevant business type (domain marketplace, placeholder, etc.)", 0.8))
        .when(F.length(F.trim(wanted)) == 0, verdict(True, "Generic query, accepting any legitimate business", 0.6))
        .when(text.contains(wanted) | F.exists(F.split(wanted, " "), lambda w: text.contains(w)),
              verdict(True, "Contains industry keywords", 0.7))
        .otherwise(verdict(False, "No industry keywords found", 0.5))
    ))


def keep_relevant(verdict: Column) -> Column:
    return ~(~verdict["is_relevant"] & (verdict["confidence"] > 0.7))


def is_person_query(query: Column | str) -> Column:
    q = F.trim(text_or_empty(query))
    return q.rlike(
        r"^[A-Z][a-z]+\s+[A-Z][a-z]+(\s+[A-Z][a-z]+)?$"
        r"|^[A-Z][a-z]+\s+[A-Z][a-z]+\s*[-|]\s*[A-Z]+"
        r"|^(?i:(Mr|Mrs|Ms|Dr|Prof)\.?\s+[A-Z][a-z]+)"
    )


def is_plausible_site(query: Column | str, url: Column | str) -> Column:
    """A resolved site fits a query: no placeholder, directory, .gov/.mil; some query word overlaps the host."""
    host = url_host(url)
    text = F.regexp_replace(F.lower(text_or_empty(query)), r"\s+official\s+site", "")
    text = F.regexp_replace(text, whole_word(
        ["in", "at", "near", "around", "within", "from", "the", "a", "an", "and", "or", "of", "for", "to"]), "")
    words = F.filter(F.split(text, r"\s+"), lambda w: F.length(w) > 2)
    parts = F.filter(F.split(host, r"\."), lambda p: F.length(p) > 2)
    overlap = F.exists(words, lambda w: F.exists(parts, lambda p: p.contains(w) | w.contains(p)))
    unrelated = (F.size(words) > 0) & ~overlap & F.exists(words, lambda w: F.length(w) > 3)
    return F.coalesce(
        host.isNotNull()
        & ~is_directory_url(url)
        & ~host.rlike(rf"(^|\.)({alternation(R.RESULT_PLACEHOLDER_DOMAINS)})$")
        & ~host.rlike(r"\.(mil|gov)$")
        & ~unrelated,
        F.lit(False),
    )
