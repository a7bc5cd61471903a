"""Search results: union of providers, dedup, batches, telemetry, official site, saved result pages, raw bytes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from leadloom import refdata as R
from leadloom.functions import nodes as N
from leadloom.functions.domain import is_directory_site, is_placeholder_host, is_social_host, is_social_url
from leadloom.functions.text import all_groups, null_if_empty, text_or_empty
from leadloom.functions.url import is_query_link, url_host
from leadloom.operators.skew import first_per_key, top_per_key
from leadloom.sources.html_nodes import read_nodes


def provider_rank(provider: Column | str = "provider") -> Column:
    c = F.col(provider) if isinstance(provider, str) else provider
    return F.array_position(R.literal_array(R.PROVIDER_ORDER), c).cast("int")


def merge_providers(results: DataFrame, limit: int | None = None) -> DataFrame:
    """First result per (search, link) by provider priority and position; at most ``limit`` per search."""
    ranked = results.filter(text_or_empty("link") != "").withColumn("provider_rank", provider_rank())
    first = first_per_key(ranked, ["search_id", "link"], ["provider_rank", "pos"])
    if limit is not None:
        first = top_per_key(first, ["search_id"], [F.asc("provider_rank"), F.asc("pos"), F.asc("link")], limit)
    return first


def dedup_key() -> Column:
    """What makes two results the same: place id, else name and place, else host; NULL for other links."""
    is_place = F.col("link").startswith("places:") | F.coalesce(F.col("is_place"), F.lit(False))
    place_id = F.coalesce(
        null_if_empty(F.col("place_id")),
        F.when(F.col("link").startswith("places:"), null_if_empty(F.trim(F.regexp_replace("link", "^places:", "")))))
    title = F.lower(F.trim(text_or_empty("title")))

    def named(where: Column) -> Column:
        return F.concat(F.lit("name:"), title, F.lit("_"), F.lower(F.trim(where)))

    snippet = text_or_empty("snippet")
    place_key = F.coalesce(
        F.concat(F.lit("id:"), place_id), named(F.coalesce(null_if_empty(snippet), text_or_empty("address"))))
    return (
        F.when(is_place, place_key)
        .when(is_query_link("link"), named(snippet))
        .otherwise(F.concat(F.lit("host:"), url_host("link"))))


def dedup_results(results: DataFrame, order: list[str] | None = None) -> DataFrame:
    """First result per search and key; results whose link is no URL always stay.

    Those get a key of their own from ``order``, which is unique within a search.
    """
    order = order or ["pos"]
    own = F.concat_ws(":", F.lit("row"), *order)
    keyed = results.withColumn("dedup_key", F.coalesce(dedup_key(), own))
    return first_per_key(keyed, ["search_id", "dedup_key"], order).drop("dedup_key")


def split_batches(results: DataFrame, searches: DataFrame, order: list[str], initial: int = R.INITIAL_BATCH,
                  largest: int = R.LARGEST_RESULT_COUNT) -> DataFrame:
    """Batch of each result: the first ``initial`` per search, then backfill up to the wanted count; others drop.

    ``largest`` bounds the wanted counts, so that the rank filter has a constant bound; a search that wants more fails
    the job instead of losing rows.
    """
    ranked = top_per_key(results, ["search_id"], [F.asc(c) for c in order], max(largest, initial), "rank")
    too_large = F.raise_error(F.concat(F.lit("result_count above the bound: "), F.col("result_count").cast("string")))
    wanted = searches.select("search_id", F.when(F.col("result_count") > largest, too_large.cast("int")).otherwise(F.col("result_count")).alias("result_count"))
    out = ranked.join(wanted, "search_id").filter((F.col("rank") <= F.col("result_count")) | (F.col("rank") <= initial))
    return out.withColumn("batch", F.when(F.col("rank") <= initial, "initial").otherwise("backfill"))


def provider_telemetry(results: DataFrame, max_results: int, min_results: int, bing_key: bool = True,
                       places_key: bool = True) -> DataFrame:
    """Counts per provider and search, merged total, and why a search fell short."""
    counts = [F.count_if(F.col("provider") == p).alias(p) for p in R.PROVIDER_ORDER]
    table = results.groupBy("search_id").agg(*counts, F.count_distinct(F.when(F.col("link") != "", F.col("link"))).alias("links"))
    free = sum((F.col(p) for p in R.PROVIDER_ORDER if p != "places"), F.lit(0))
    reasons = F.concat_ws(
        "; ",
        F.lit(None if bing_key else "Bing API key missing").cast("string"),
        F.lit(None if places_key else "Places disabled").cast("string"),
        F.when((F.col("ddg") == 0) & (free < min_results), "DuckDuckGo rate-limited/blocked"),
        F.when(F.col("overpass") == 0, "Overpass timed out or no results"))
    total = F.least("links", F.lit(max_results))
    return table.select(
        "search_id", *R.PROVIDER_ORDER, total.alias("total"),
        F.when(total < max_results, reasons).otherwise("").alias("reason_shortfall"))


def official_sites(companies: DataFrame, results: DataFrame, allow: tuple[str, ...] = ()) -> DataFrame:
    """Site of each company from its search results: the first whose title or snippet names it, else the first.

    ``companies``: ``lead_id, search_id, company_name``; ``results`` hold the look-up of each lead (``lead_id``).
    Social links never count; a placeholder host gives NULL.
    """
    name = F.lower(F.trim("company_name"))
    usable = results.filter((text_or_empty("link") != "") & ~is_social_url("link")).select(
        "lead_id", "link", "pos", F.lower(text_or_empty("title")).alias("t"), F.lower(text_or_empty("snippet")).alias("s"))
    joined = companies.select("lead_id", "company_name").join(usable, "lead_id")
    miss = ~(F.col("t").contains(name) | F.col("s").contains(name))
    picked = joined.groupBy("lead_id").agg(F.min_by("link", F.struct(miss, F.col("pos"))).alias("link"))
    site = F.when(url_host("link").isNotNull() & ~is_placeholder_host(url_host("link"), allow), F.col("link"))
    return picked.select("lead_id", site.alias("website"))


BAD_RESULT_PATH = r"(?i)(/shareArticle|/user/|/profile/|/@)"


def saved_page_results(pages: DataFrame) -> DataFrame:
    """Result blocks of a saved search page; when a page has none, all its links with a longer title."""
    p = read_nodes(pages.select("page_id", "url", "html"))
    blocks = N.select(N.has_class("result", "web-result", "result__body"))

    def block(b: Column) -> Column:
        within = N.inside(b)
        link = F.coalesce(
            N.first(N.has_class("result__a"), within),
            N.first(N.has_tag("a"), N.inside(N.first(N.has_tag("h2"), within))))
        snippet = N.first(N.has_class("result__snippet", "result__body"), within)
        return F.struct(N.text_of(link).alias("title"), N.attr(link, "href").alias("link"),
                        F.coalesce(N.text_of(snippet), F.lit("")).alias("snippet"))

    def anchor(a: Column) -> Column:
        return F.struct(F.substring(N.text_of(a), 1, 100).alias("title"), N.attr(a, "href").alias("link"),
                        F.lit("").alias("snippet"))


    def resolved(r: Column) -> Column:
        to = F.regexp_extract(r["link"], "uddg=([^&]+)", 1)
        link = F.when(to != "", F.coalesce(F.try_url_decode(to), to)).otherwise(r["link"])
        return F.struct(r["title"].alias("title"), link.alias("link"), r["snippet"].alias("snippet"))

    def usable(r: Column) -> Column:
        return (text_or_empty(r["title"]) != "") & r["link"].startswith("http") & ~r["link"].rlike(BAD_RESULT_PATH)

    main = F.filter(F.transform(F.transform(blocks, block), resolved), usable)
    links = N.select(lambda n: (n["tag"] == "a") & N.attr(n, "href").startswith("http"))
    other = F.filter(F.transform(links, anchor),
                     lambda r: (F.length(r["title"]) > 10) & ~r["link"].contains("duckduckgo.com"))
    rows = p.select("page_id", "url", (F.size(main) == 0).alias("fallback"),
                    F.posexplode(F.when(F.size(main) > 0, main).otherwise(other)).alias("pos", "r"))
    rows = rows.select("page_id", "url", "fallback", "pos", "r.title", "r.link", "r.snippet")
    first = first_per_key(rows, ["page_id", "link"], ["pos"])
    return first.withColumn("is_directory", is_directory_site("link", "title"))


def raw_byte_links(files: DataFrame, limit: int = 25) -> DataFrame:
    """URLs in raw bytes (``path, content``), such as PDF files: distinct, without social hosts, first ``limit``."""
    text = F.decode("content", "ISO-8859-1")
    urls = all_groups(r'https?://[^\s<>()"]+', text)
    rows = files.select("path", F.posexplode(F.array_distinct(urls)).alias("pos", "link"))
    host = url_host("link")
    blocked = ["facebook.com", "instagram.com", "twitter.com", "x.com", "linkedin.com", "youtube.com", "wikipedia.org"]
    rows = rows.filter(host.isNotNull() & ~host.rlike("(" + "|".join(b.replace(".", r"\.") for b in blocked) + ")"))
    top = top_per_key(rows, ["path"], [F.asc("pos")], limit)
    return top.select("path", "pos", host.alias("title"), "link", F.concat(F.lit("From PDF: "), "path").alias("snippet"))


def external_host(href: Column, own_host: Column) -> Column:
    """Host of an absolute link to another site that is neither social nor a blocked platform, else NULL."""
    host = url_host(href)
    return F.when((host != own_host) & ~is_social_host(host) & ~host.isin(R.BLOCKED_PLATFORMS), host)
