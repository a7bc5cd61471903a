"""What can be read off fetched pages: links, contacts, company fields, site classification, list pages."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from leadloom import refdata as R
from leadloom.functions import domain as D, nodes as N
from leadloom.functions.company import cleaned_aggregator_title, employee_count, employee_range, founded_year, profile_name
from leadloom.functions.phone import extract_phones, strip_code
from leadloom.functions.text import all_groups, alternation, col, has_any, let, null_if_empty, text_or_empty
from leadloom.functions.url import absolute_url, url_host, url_origin, url_path
from leadloom.operators.results import external_host
from leadloom.operators.skew import first_per_key, top_per_key
from leadloom.sources.html_nodes import read_nodes

LINK = r"""(?is)<a\s[^>]*?href\s*=\s*["']([^"']*)["'][^>]*>(.*?)</a>"""
HREF = r"""(?is)<a\s[^>]*?href\s*=\s*["']([^"']*)["']"""


def distinct_pages(pages: DataFrame) -> DataFrame:
    """One page per URL, so that each is read once; the lowest page id stands for the URL.

    Repeats are found on the narrow columns and taken out by id. HTML moves through a shuffle only when the list of
    repeats is too large for the size Spark broadcasts by itself.
    """
    ids = pages.select("page_id", "url")
    repeated = ids.groupBy("url").agg(F.min("page_id").alias("keep"), F.count(F.lit(1)).alias("n")).filter("n > 1")
    losers = ids.join(repeated.select("url", "keep"), "url").filter("page_id > keep").select("page_id")
    return pages.select("page_id", "url", "html").join(losers, "page_id", "left_anti")


# --- links ---------------------------------------------------------------------------------------

def page_links(pages: DataFrame) -> DataFrame:
    """One row per anchor: position, href, text, host, and whether it leaves the site."""
    whole = all_groups(LINK, F.col("html"))
    rows = pages.select("page_id", "url", F.posexplode(whole).alias("pos", "a"))
    href = F.trim(F.regexp_extract("a", LINK, 1))
    text = F.trim(F.regexp_replace(F.regexp_replace(F.regexp_extract("a", LINK, 2), "(?s)<[^>]*>", " "), r"\s+", " "))
    host = url_host(href)
    external = F.coalesce(href.rlike("(?i)^https?://") & (host != url_host("url")), F.lit(False))
    return rows.select("page_id", "url", "pos", href.alias("href"), text.alias("text"), host.alias("host"),
                       external.alias("is_external"))


#: Place of the fixed paths, behind any link that a page can hold.
FIXED_PATHS = 1 << 30
REGION = r"(?is)<(?:nav|footer)[^>]*>.*?</(?:nav|footer)>"


def team_page_candidates(pages: DataFrame, limit: int = 10) -> DataFrame:
    """Pages that may list people: navigation and footer links with team words, then fixed paths; ten per page."""
    region = F.array_join(all_groups(REGION, F.col("html")), " ")
    linked = page_links(pages.select("page_id", "url", region.alias("html")))
    words = "(?i)(" + alternation(R.TEAM_LINK_WORDS) + ")"
    linked = linked.filter(F.col("href").rlike(words) | F.col("text").rlike(words)).select(
        "page_id", "url", "pos", absolute_url(F.col("href"), F.col("url")).alias("candidate"))
    paths = pages.select("page_id", "url", F.posexplode(R.literal_array(R.TEAM_PATHS)).alias("i", "path")).select(
        "page_id", "url", (F.col("i") + FIXED_PATHS).alias("pos"), F.concat(url_origin("url"), "path").alias("candidate"))
    both = linked.unionByName(paths).filter("candidate IS NOT NULL")
    first = first_per_key(both, ["page_id", "candidate"], ["pos"])
    return top_per_key(first, ["page_id"], [F.asc("pos")], limit)


def page_key(url: Column | str) -> Column:
    """Host and path of a page without ``www.``, port, query, fragment and closing slash; NULL for no absolute URL."""
    return F.concat(url_host(url), F.regexp_replace(url_path(url), "/+$", ""))


def team_pages(pages: DataFrame, limit: int = 10) -> DataFrame:
    """(page_id, team_page_id, url, place): the candidates of each page that are among ``pages``, in order of place.

    Candidates and pages meet by their key; only ids and URLs move. Of pages with one key the lowest id stands for it.
    """
    wanted = team_page_candidates(pages, limit).select("page_id", F.col("pos").alias("place"), page_key("candidate").alias("key"))
    wanted = wanted.groupBy("page_id", "key").agg(F.min("place").alias("place"))
    known = pages.select(page_key("url").alias("key"), F.struct("page_id", "url").alias("p")).filter("key IS NOT NULL")
    known = known.join(wanted.select("key").distinct(), "key", "left_semi").groupBy("key").agg(F.min("p").alias("p"))
    found = wanted.join(known, "key").filter(F.col("p.page_id") != F.col("page_id"))
    return found.select("page_id", F.col("p.page_id").alias("team_page_id"), F.col("p.url").alias("url"), "place")


def sitemap_team_pages(sitemaps: DataFrame, limit: int = 10) -> DataFrame:
    """Team page URLs of sitemap texts (``site_id, xml``)."""
    rows = sitemaps.select("site_id", F.posexplode(all_groups(r"(?i)<loc>(.*?)</loc>", F.col("xml"), 1)).alias("pos", "url"))
    rows = rows.withColumn("url", F.trim("url")).filter(has_any(F.lower("url"), R.SITEMAP_WORDS))
    return top_per_key(rows, ["site_id"], [F.asc("pos")], limit)


# --- contacts ------------------------------------------------------------------------------------

DOT = r"(?:\s*[\[(]\s*dot\s*[\])]\s*|\s+dot\s+)"
AT = r"(?:\s*[\[(]\s*at\s*[\])]\s*|\s+at\s+)"
#: Addresses begin where a run of their letters begins, or behind the address before: each run is scanned once.
AT_RUN = r"(?:(?<![a-zA-Z0-9._%+-])|\G)"
DOT_ADDRESS = rf"(?i){AT_RUN}[a-zA-Z0-9._%+-]+@[a-zA-Z0-9.-]+{DOT}[a-zA-Z]{{2,}}"
AT_ADDRESS = rf"(?i){AT_RUN}[a-zA-Z0-9._%+-]+{AT}[a-zA-Z0-9.-]+{DOT}[a-zA-Z]{{2,}}"


def page_emails(html: Column | str, allow: tuple[str, ...] = ()) -> Column:
    """array<struct(email, source, confidence)>: plain, entity, dot/at and base64 forms, false positives dropped."""
    h = text_or_empty(html)
    decoded = F.regexp_replace(F.regexp_replace(h, "(?i)&#64;|&#x40;|&commat;", "@"), "(?i)&#46;|&#x2e;|&period;", ".")

    def clean(c: Column) -> Column:
        return F.lower(F.regexp_replace(F.regexp_replace(c, f"(?i){AT}", "@"), f"(?i){DOT}", "."))

    packed = F.transform(
        all_groups(r'(?i)data-email="([^"]+)"', h, 1),
        lambda x: F.coalesce(F.decode(F.try_to_binary(x, F.lit("base64")), "UTF-8"), F.lit("")))
    none = F.array().cast("array<string>")

    def searched(d: Column) -> Column:
        """Each form is sought only where the letters it cannot do without occur."""
        at = d.contains("@")
        dot = F.lower(d).contains("dot")
        plain = F.when(at, all_groups(AT_RUN + R.EMAIL_PATTERN, d)).otherwise(none)
        spoken = F.concat(F.when(at & dot, all_groups(DOT_ADDRESS, d)).otherwise(none), F.when(dot, all_groups(AT_ADDRESS, d)).otherwise(none))
        return F.concat(plain, F.transform(spoken, clean), packed)

    found = let(decoded, searched)
    noise = [w for w in R.PAGE_EMAIL_NOISE if not any(a in w for a in allow)]
    hosts = "|".join(w for w in ("localhost", r"127\.0\.0\.1", "example", "test", "placeholder") if w not in allow)

    def ok(e: Column) -> Column:
        return (
            e.rlike(f"^{R.EMAIL_PATTERN}$") & ~has_any(e, noise) & ~e.rlike(rf"^[a-z0-9._%+-]+@({hosts})")
            & F.length(e).between(6, 99))

    kept = F.filter(F.array_distinct(F.transform(found, lambda e: F.lower(e))), ok)

    def row(e: Column) -> Column:
        mailto = h.contains(F.concat(F.lit("mailto:"), e))
        data = h.contains(F.concat(F.lit('data-email="'), e, F.lit('"'))) | h.contains(
            F.concat(F.lit('data-contact="'), e, F.lit('"')))
        structured = h.rlike("data-email|data-contact")
        return F.struct(
            e.alias("email"),
            F.when(mailto, "mailto_link").when(data, "data_attribute").when(structured, "structured_data")
            .otherwise("website").alias("source"),
            F.when(mailto | data, 0.95).when(structured, 0.9).otherwise(0.8).alias("confidence"))

    return F.transform(kept, row)


def whatsapp_links(html: Column | str) -> Column:
    return F.array_distinct(all_groups(
        r"(?i)https?://wa\.me/[\d+]+|https?://api\.whatsapp\.com/send\?phone=[\d+]+", text_or_empty(html)))


def social_links(html: Column | str, url: Column | str) -> Column:
    """struct(linkedin, twitter, facebook, instagram): the last link of each platform."""
    links = F.transform(all_groups(HREF, text_or_empty(html), 1), lambda h: absolute_url(F.trim(h), col(url)))
    platform = lambda u: (
        F.when(u.contains("linkedin.com"), "linkedin").when(u.contains("twitter.com") | u.contains("x.com"), "twitter")
        .when(u.contains("facebook.com"), "facebook").when(u.contains("instagram.com"), "instagram"))
    return F.struct(*[
        F.try_element_at(F.filter(links, lambda u: platform(u) == p), F.lit(-1)).alias(p)  # noqa: B023
        for p in ("linkedin", "twitter", "facebook", "instagram")])


def meta(html: Column | str, name: str, value: str) -> Column:
    """Content of the first meta tag whose attribute ``name`` is ``value``, in either attribute order."""
    h = text_or_empty(html)
    q = "[\"']"
    v = value.replace(".", r"\.")
    return F.coalesce(
        null_if_empty(F.regexp_extract(h, rf"(?is)<meta[^>]*\b{name}={q}{v}{q}[^>]*\bcontent=\"([^\"]*)\"", 1)),
        null_if_empty(F.regexp_extract(h, rf"(?is)<meta[^>]*\b{name}={q}{v}{q}[^>]*\bcontent='([^']*)'", 1)),
        null_if_empty(F.regexp_extract(h, rf"(?is)<meta[^>]*\bcontent=\"([^\"]*)\"[^>]*\b{name}={q}{v}{q}", 1)))


def canonical_link(html: Column | str) -> Column:
    h = text_or_empty(html)
    return F.coalesce(
        null_if_empty(F.regexp_extract(h, r"""(?is)<link[^>]*\brel=["']canonical["'][^>]*\bhref=["']([^"']*)["']""", 1)),
        null_if_empty(F.regexp_extract(h, r"""(?is)<link[^>]*\bhref=["']([^"']*)["'][^>]*\brel=["']canonical["']""", 1)))


def page_website(url: Column | str, canonical: Column, og_url: Column, allow: tuple[str, ...] = ()) -> Column:
    """Canonical URL, else the social one, else the origin of the page; NULL when all are placeholders."""
    def valid(u: Column) -> Column:
        return F.when(u.startswith("http") & url_host(u).isNotNull() & ~D.is_placeholder_host(url_host(u), allow), u)

    origin = url_origin(url)
    return F.coalesce(
        valid(canonical), valid(og_url),
        F.when(~D.is_placeholder_host(url_host(url), allow), origin))


def tag_text(html: Column | str, tag: str) -> Column:
    """Text of the first ``tag`` element, inner tags removed."""
    raw = F.regexp_extract(text_or_empty(html), rf"(?is)<{tag}(?:\s[^>]*)?>(.*?)</{tag}>", 1)
    return null_if_empty(F.trim(F.regexp_replace(F.regexp_replace(raw, "(?s)<[^>]*>", ""), r"\s+", " ")))


def page_company_name(url: Column | str, og: Column, title: Column, h1: Column) -> Column:
    """Social-profile rules, social title, page title up to a dash or bar, heading, first host label."""
    host = text_or_empty(url_host(url))

    def named(c: Column) -> Column:
        return F.when(c.isNotNull() & ~D.is_generic_page_name(c), c)

    cut = lambda c: F.trim(F.regexp_replace(c, r"(?s)\s*[-|]\s*.*$", ""))
    off = lambda c: F.trim(F.regexp_replace(c, r"(?is)\s*on\s+tiktok.*$", ""))
    user = null_if_empty(F.regexp_extract(text_or_empty(url), "@([^/?#]+)", 1))

    def capital(c: Column) -> Column:
        return F.concat(F.upper(F.substring(c, 1, 1)), F.substr(c, F.lit(2)))

    tiktok_title = off(cut(title))
    tiktok = F.coalesce(
        F.when(~F.lower(og).contains("tiktok"), named(off(og))),
        F.when(~F.lower(tiktok_title).contains("tiktok"), named(tiktok_title)), capital(user))
    social = named(cut(og))
    page = F.coalesce(
        named(F.trim(og)), named(cut(title)), F.when(F.length(h1).between(4, 99), named(h1)),
        F.when((host != "") & ~D.is_directory_url(url), capital(F.regexp_extract(host, r"^([^.]*)", 1))))
    return F.coalesce(
        F.when(host.contains("tiktok.com"), tiktok),
        F.when(host.rlike(r"(instagram|facebook|linkedin)\.com"), social), page)


def is_review_site(url: Column | str) -> Column:
    return text_or_empty(url_host(url)).rlike(r"(tripadvisor|opentable|zomato|yelp|restaurantguru)\.")


def venue_name(url: Column | str, og: Column, title: Column) -> Column:
    """Venue behind a review-site page, from its title."""
    name = cleaned_aggregator_title(F.coalesce(og, title))
    return F.when(is_review_site(url) & (F.length(name) > 2), name)


def visible_text(html: Column | str) -> Column:
    """Text of the page without code and tags."""
    return F.regexp_replace(strip_code(html), "(?s)<[^>]*>", " ")


def category_signals(text: Column | str) -> Column:
    return let(F.lower(text_or_empty(text)), lambda t: F.filter(R.literal_array(R.CATEGORY_WORDS), lambda w: t.contains(w)))


def address_text() -> Column:
    """Over ``read_nodes`` columns: itemprop, class, id, then any class holding 'address'."""
    rules = [N.attr_is("itemprop", "address"), N.has_class("address"), N.attr_is("id", "address"),
             N.class_contains("address")]
    return N.text_of(F.coalesce(*[N.first(r) for r in rules]))


def about_text() -> Column:
    """Over ``read_nodes`` columns: description meta, itemprop, about block, else the first paragraph (500)."""
    rules = [lambda n: (n["tag"] == "meta") & (N.attr(n, "name") == "description"), N.attr_is("itemprop", "description"),
             N.has_class("about"), N.attr_is("id", "about"), N.class_contains("about")]
    hit = F.coalesce(*[N.first(r) for r in rules])
    return F.when(hit.isNotNull(), F.coalesce(null_if_empty(N.attr(hit, "content")), N.text_of(hit))).otherwise(
        F.substring(N.text_of(N.first(N.has_tag("p"))), 1, 500))


def extract_contacts(pages: DataFrame, country: str | None = None, allow: tuple[str, ...] = ()) -> DataFrame:
    """Contacts and company fields of each distinct page URL."""
    read = read_nodes(distinct_pages(pages), keep_html=True)
    default = F.lit(country).cast("string")

    def content(name: str, value: str) -> Column:
        return null_if_empty(N.attr(N.first(lambda n: (n["tag"] == "meta") & (N.attr(n, name) == value)), "content"))

    def text(tag: str) -> Column:
        return null_if_empty(F.regexp_replace(N.text_of(N.first(N.has_tag(tag))), r"\s+", " "))

    canonical = null_if_empty(N.attr(N.first(lambda n: (n["tag"] == "link") & (N.attr(n, "rel") == "canonical")), "href"))
    facts = read.select(
        "*", content("property", "og:title").alias("og"), content("property", "og:url").alias("og_url"),
        text("title").alias("title"), text("h1").alias("h1"), canonical.alias("canonical"),
        N.text_of(N.first(N.has_tag("body"))).alias("body"), address_text().alias("address"),
        about_text().alias("about_text"))
    og, title = F.col("og"), F.col("title")
    return facts.select(
        "page_id", "url", url_host("url").alias("domain"),
        F.coalesce(page_company_name("url", og, title, F.col("h1")), venue_name("url", og, title)).alias("company_name"),
        page_website("url", F.col("canonical"), F.col("og_url"), allow).alias("website"),
        page_emails("html", allow).alias("emails"),
        extract_phones("html", "url", default).alias("phones"),
        whatsapp_links("html").alias("whatsapp_links"),
        social_links("html", "url").alias("socials"), "address", "about_text",
        category_signals("body").alias("category_signals"))


def contact_page_emails(pages: DataFrame) -> DataFrame:
    """Addresses on contact pages per domain, without no-reply forms."""
    hits = pages.filter(F.regexp_replace(url_path("url"), "/$", "").isin("/contact", "/contact-us"))
    rows = hits.select(
        url_host("url").alias("domain"),
        F.explode(all_groups(r"\b[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Z|a-z]{2,}\b", F.col("html"))).alias("email"))
    rows = rows.withColumn("email", F.lower("email")).filter(~F.col("email").rlike("noreply|no-reply|donotreply"))
    return rows.distinct()


def profile_pages(pages: DataFrame, current_year: int) -> DataFrame:
    """Company facts on profile pages: name, description, size, founding year, place."""
    n = employee_count("html")
    place = F.coalesce(meta("html", "property", "og:locality"), null_if_empty(F.trim(F.regexp_extract(
        "html", r"""(?is)<[^>]*(?:data-test-id=["']company-location["']|class=["'][^"']*org-top-card-summary-info-list__info-item[^"']*["'])[^>]*>([^<]*)<""", 1))))
    return pages.select(
        "page_id", "url", profile_name(meta("html", "property", "og:title"), tag_text("html", "title")).alias("name"),
        F.coalesce(meta("html", "property", "og:description"), meta("html", "name", "description"), F.lit("")).alias(
            "description"),
        n.alias("employee_count"), employee_range(n).alias("employee_count_range"),
        founded_year("html", current_year).alias("founded_year"), place.alias("location"))


# --- JSON-LD -------------------------------------------------------------------------------------

LD_SCRIPT = r"""(?is)<script[^>]*type=["']application/ld\+json["'][^>]*>(.*?)</script>"""
LD_ELEMENT = (
    "struct<item:string,`@type`:string,name:string,legalName:string,description:string,url:string,sameAs:string,"
    "website:string>")
LD_ITEM = (
    "struct<`@type`:string,name:string,legalName:string,description:string,url:string,sameAs:string,website:string,"
    "jobTitle:string,roleName:string,founder:string,employee:string,worksFor:string,itemListElement:string>")


def ld_bodies(html: Column | str) -> Column:
    """Bodies of the JSON-LD scripts of a page."""
    return all_groups(LD_SCRIPT, text_or_empty(html), 1)


def ld_items(bodies: Column) -> Column:
    """JSON-LD objects of a page; a single object counts as a list of one, bad JSON as none.

    Nested values stay JSON text and are read by the rule that needs them.
    """
    none = F.array().cast(f"array<{LD_ITEM}>")
    items = F.flatten(F.transform(bodies, lambda b: F.coalesce(F.from_json(F.trim(b), f"array<{LD_ITEM}>"), none)))
    return F.filter(items, lambda i: i.isNotNull())


# --- site classification -------------------------------------------------------------------------

PROFILE_BUTTON = r"view\s+(profile|website|site)|visit\s+(website|site)|learn\s+more|see\s+details"
COMPANY_LINE = r"^[A-Z][a-zA-Z\s&]+[-|]\s*[A-Z]"
#: Entries from which any structured list marks a list page.
LIST_ENTRIES = 5
DIRECTORY_HINT = r"directory|listing|business.*list|company.*list|ranking|rankings"


def page_structure(pages: DataFrame) -> DataFrame:
    """Counts that tell list pages from company sites, one row per page."""
    read = read_nodes(pages.select("page_id", "url", "html"))
    links = F.transform(N.select(lambda n: (n["tag"] == "a") & F.map_contains_key(n["attrs"], "href")),
                        lambda n: F.trim(N.attr(n, "href")))
    own = url_host("url")
    hosts = F.transform(F.filter(links, lambda h: h.startswith("http")), url_host)
    outside = F.filter(hosts, lambda h: h.isNull() | (h != own))
    listed = N.select(N.has_tag("ul", "ol"))
    items = N.select(N.has_tag("li"))
    things = ld_items(F.col("ld"))
    types = F.lower(F.array_join(F.transform(things, lambda i: i["@type"]), " "))
    long_list = F.exists(things, lambda i: F.coalesce(F.size(F.from_json(i["itemListElement"], "array<string>")), F.lit(0)) >= LIST_ENTRIES)
    return read.select(
        "page_id", "url", F.lower(text_or_empty(N.text_of(N.first(N.has_tag("title"))))).alias("title"),
        F.size(outside).alias("external_links"), (F.size(links) - F.size(outside)).alias("internal_links"),
        F.size(F.array_distinct(F.array_compact(outside))).alias("external_hosts"),
        F.size(items).alias("list_items"), F.size(listed).alias("lists"),
        N.count(N.class_contains("card", "grid", "item", "listing")).alias("cards"),
        F.size(N.select(lambda n: n["tag"].isin("a", "button") & F.lower(N.text_of(n)).rlike(PROFILE_BUTTON))).alias(
            "profile_buttons"),
        F.size(N.select(lambda n: (n["b"] - n["a"]).between(4, 99) & N.text_of(n).rlike(COMPANY_LINE))).alias(
            "company_lines"),
        (types.rlike("itemlist|collectionpage") | long_list).alias("has_item_list"),
        types.rlike("localbusiness|organization").alias("has_organization"))


def site_score(url: Column | str = "url") -> Column:
    """struct(score, reasons, is_first_party) over ``page_structure`` columns; negative means list page."""
    host, path = text_or_empty(url_host(url)), text_or_empty(url_path(url))
    c = F.col
    hinted = c("title").rlike(DIRECTORY_HINT) | path.rlike(DIRECTORY_HINT)
    # fixed values: host words of this rule and its exceptions
    keyword = host.rlike("directory|listing|marketplace|aggregator|bizinfo|yellow|businesslist|companylist|database")
    keyword = keyword & ~host.rlike("hubspot|hubdoc|hubstaff|hubpages")
    rules: list[tuple[Column, int, str | None]] = [
        (keyword, -3, "domain:keyword"),
        (keyword & path.rlike(r"/(directory|listings?|companies|businesses|ranking|rankings|rank)"), -2, None),
        (path.rlike(r"(^|/)(category|tags|companies|agencies|directory|list|locations|explore|ranking|rankings|rank)(/|$)"),
         -2, "path:listlike"),
        (path.rlike(r"top-\d+|best|list-of|the-\d+-best|/ranking|/rankings|/rank\b"), -2, "path:ranked"),
        (F.lower(text_or_empty(url)).rlike(D.MARKET), -5, "domain:marketplace"),
        (c("title").rlike(r"\b(top\s*\d+|\d+\s*best|list of|directory|ranking|rankings|rank)\b"), -2, "title:listlike"),
        (c("title").rlike(r"is\s+for\s+sale|for\s+sale|domain\s+sale|buy\s+domain|premium\s+domain|hugedomains|domain.*profile|domain.*marketplace"),
         -5, "title:domain_sale"),
        ((c("external_hosts") >= 10) & (c("external_links") > c("internal_links")) & hinted, -2, "links:many-external"),
        ((c("external_hosts") >= 20) & (c("external_links") > c("internal_links") * 2), -3, "links:very-many-external"),
        ((c("list_items") >= 100) & (c("lists") >= 5) & hinted, -2, "structure:many-lists"),
        ((c("cards") >= 20) & hinted, -1, "structure:card-layout"),
        (c("profile_buttons") >= 5, -2, "content:profile-buttons"),
        (c("company_lines") >= 10, -2, "content:company-patterns"),
        (c("has_item_list"), -3, "schema:itemList"),
        (c("has_organization"), 2, "schema:localbusiness"),
    ]
    score = sum((F.when(cond, points).otherwise(0) for cond, points, _ in rules), F.lit(0))
    reasons = F.array_compact(F.array(*[F.when(cond, F.lit(r)) for cond, _, r in rules if r]))
    return F.struct(score.alias("score"), reasons.alias("reasons"), (score > 0).alias("is_first_party"))


def classify_sites(pages: DataFrame) -> DataFrame:
    s = page_structure(pages).withColumn("s", site_score())
    return s.select(*[c for c in s.columns if c != "s"], "s.score", "s.reasons", "s.is_first_party")


# --- list pages ----------------------------------------------------------------------------------

LISTICLE = r"^(top|best|leading|list|directory|guide|roundup|compilation)"
LISTICLE_NOUNS = ["companies", "providers", "businesses", "firms", "agencies", "services"]
CONTAINERS = [
    N.has_tag("article"), N.has_class("company"), N.has_class("business"), N.has_class("organization"),
    N.class_contains("company"), N.class_contains("business"), N.class_contains("organization"),
    N.class_contains("listing"), N.class_contains("card"), N.class_contains("item"), N.has_tag("li"), N.has_tag("tr"),
    N.has_class("row"), N.attr_is("role", "listitem"),
]


def is_listicle_title(title: Column) -> Column:
    t = F.lower(title)
    return t.rlike(LISTICLE) & has_any(t, LISTICLE_NOUNS)


def expansion_cap(result_count: Column | int) -> Column:
    wanted = F.lit(result_count) if isinstance(result_count, int) else result_count
    return F.greatest(F.lit(30), F.least(F.lit(50), F.floor(wanted * 0.6))).cast("int")


def expand_directories(pages: DataFrame, result_count: Column | int = 50) -> DataFrame:
    """Company links of list pages: structured data, then the first link of each container, then all anchors.

    The first find of a host on a page wins; listicle titles are dropped after they claim their host, as are hits
    that are list pages themselves after the cap of 30 to 50 per page. ``pages`` may carry ``result_count``.
    """
    wanted = F.col("result_count") if "result_count" in pages.columns else F.lit(result_count)
    base = pages.select("page_id", "url", "html", expansion_cap(wanted).alias("cap"))
    own = url_host("url")

    def organisation(i: Column, order: Column) -> Column:
        same_as = F.coalesce(F.get(F.from_json(i["sameAs"], "array<string>"), F.lit(0)),
                             F.when(i["sameAs"].startswith("http"), i["sameAs"]))
        link = F.coalesce(null_if_empty(i["url"]), null_if_empty(same_as), null_if_empty(i["website"]))
        title = F.coalesce(null_if_empty(i["name"]), null_if_empty(i["legalName"]), url_host(link))
        return F.struct(F.lit(1).alias("strategy"), order.cast("int").alias("pos"), F.struct(
            title.alias("title"), link.alias("link"), text_or_empty(i["description"]).alias("snippet"),
            link.startswith("http").alias("ok")).alias("r"))

    def members(i: Column) -> Column:
        """The item itself when it is an organisation, or the organisations of an item list."""
        listed = F.transform(
            F.from_json(i["itemListElement"], f"array<{LD_ELEMENT}>"),
            lambda e: F.coalesce(F.from_json(e["item"], LD_ITEM), F.from_json(F.to_json(e), LD_ITEM)))
        listed = F.filter(listed, lambda o: o["@type"].isin("Organization", "LocalBusiness"))
        none = F.array().cast(f"array<{LD_ITEM}>")
        return (F.when(i["@type"].isin("Organization", "LocalBusiness", "Corporation"), F.array(i))
                .when(i["@type"] == "ItemList", F.coalesce(listed, none)).otherwise(none))

    structured = F.transform(F.flatten(F.transform(ld_items(F.col("ld")), members)), organisation)

    read = read_nodes(base)
    is_link = lambda n: (n["tag"] == "a") & N.attr(n, "href").rlike("^\\s*http")

    def from_container(box: Column) -> Column:
        return let(N.inside(box), lambda within: let(N.first(is_link, within), lambda a: described(box, within, a)))

    def described(box: Column, within: Column, a: Column) -> Column:
        heading = N.first(N.any_of(N.has_tag("h1", "h2", "h3", "h4"), N.has_class("title"), N.class_contains("name")), within)
        href = F.trim(N.attr(a, "href"))
        return F.struct(
            F.coalesce(null_if_empty(N.text_of(a)), null_if_empty(N.text_of(heading)), url_host(href)).alias("title"),
            href.alias("link"), F.trim(F.substring(N.text_of(box), 1, 150)).alias("snippet"), a.isNotNull().alias("ok"))

    boxes = F.concat(*[F.filter(F.transform(N.select(rule), from_container), lambda r: r["ok"]) for rule in CONTAINERS])
    anchors = F.transform(N.select(is_link), lambda a: F.struct(
        F.coalesce(null_if_empty(N.text_of(a)), url_host(N.attr(a, "href"))).alias("title"),
        F.trim(N.attr(a, "href")).alias("link"), F.lit("").alias("snippet"), F.lit(True).alias("ok")))
    found = F.concat(
        F.filter(structured, lambda x: F.coalesce(x["r"]["ok"], F.lit(False))),
        F.transform(boxes, lambda r, i: F.struct(F.lit(2).alias("strategy"), i.alias("pos"), r.alias("r"))),
        F.transform(anchors, lambda r, i: F.struct(F.lit(3).alias("strategy"), i.alias("pos"), r.alias("r"))))
    from_html = read.select("page_id", "url", "cap", F.explode(found).alias("f")).select(
        "page_id", "url", "cap", "f.strategy", F.col("f.pos").cast("long").alias("pos"), F.col("f.r.title").alias("title"),
        F.col("f.r.link").alias("link"), F.col("f.r.snippet").alias("snippet"))
    every = from_html.filter((F.col("strategy") == 1) | ~F.col("link").rlike(R.EXPANSION_BAD_PATH))
    every = every.withColumn("host", external_host(F.col("link"), own)).filter("host IS NOT NULL")
    first = first_per_key(every, ["page_id", "host"], ["strategy", "pos"])
    first = first.filter((F.col("strategy") == 1) | ~is_listicle_title(F.col("title")))
    top = top_per_key(first, ["page_id"], [F.asc("strategy"), F.asc("pos")], 50, "rank").filter("rank <= cap")
    return top.filter(~D.is_directory_site("link", "title")).drop("cap")
