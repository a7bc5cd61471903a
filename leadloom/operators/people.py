"""People named on pages, in search results, press texts, registries and signatures, merged per site."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from leadloom import refdata as R
from leadloom.functions import nodes as N
from leadloom.functions.person import first_email_for, is_person_name, is_search_person_name
from leadloom.functions.text import all_groups, let, null_if_empty, text_or_empty
from leadloom.functions.title import title_relevance
from leadloom.functions.url import url_host, url_path
from leadloom.operators.pages import ld_bodies, ld_items, visible_text
from leadloom.operators.skew import attach_per_key, first_per_key, top_per_key
from leadloom.session import checkpointed
from leadloom.sources.html_nodes import read_nodes

PEOPLE_PER_PAGE = 10
PEOPLE_PER_SITE = 12
ENOUGH_PEOPLE = 5
PERSON_COLUMNS = ["name", "title", "email", "source", "confidence"]
RULE_PERSON = "struct<rule:int,name:string,title:string,email:string,source:string,confidence:double>"
LD_PERSON = "array<struct<`@type`:string,name:string,jobTitle:string,worksFor:struct<jobTitle:string>>>"


def _person(name: Column, title: Column, source: str, confidence: float, email: Column | None = None) -> list[Column]:
    mail = F.lit(None).cast("string") if email is None else email
    return [name.alias("name"), title.alias("title"), mail.alias("email"), F.lit(source).alias("source"),
            F.lit(confidence).alias("confidence")]


# --- on pages ------------------------------------------------------------------------------------

def _struct(name: Column, title: Column, confidence: float, source: str, order: int) -> Column:
    return F.struct(F.lit(order).alias("rule"), name.alias("name"), title.alias("title"),
                    F.lit(None).cast("string").alias("email"), F.lit(source).alias("source"),
                    F.lit(confidence).alias("confidence"))


def ld_people(bodies: Column) -> Column:
    """Founders (.95), employees, employee roles and persons (.9) in structured data, in order of the objects."""
    def listed(i: Column, field: str, title, confidence: float) -> Column:
        return F.transform(F.from_json(i[field], LD_PERSON),
                           lambda p: _struct(p["name"], title(p), confidence, "structured_data", 0))

    def job(p: Column) -> Column:
        return null_if_empty(p["jobTitle"])

    def one(i: Column) -> Column:
        kind = i["@type"]
        organisation = F.concat(
            F.coalesce(listed(i, "founder", lambda p: F.coalesce(job(p), F.lit("Founder")), 0.95), none),
            F.coalesce(listed(i, "employee", lambda p: F.coalesce(
                job(p), p["worksFor"]["jobTitle"], F.lit("Employee")), 0.9), none))
        role = listed(i, "employee", lambda p: F.coalesce(null_if_empty(i["roleName"]), job(p), F.lit("Employee")), 0.9)
        title = F.coalesce(job(i), F.get_json_object(i["worksFor"], "$.jobTitle"), F.lit("Team Member"))
        person = F.array(_struct(i["name"], title, 0.9, "structured_data", 0))
        return (F.when(kind == "Organization", organisation).when(kind == "EmployeeRole", F.coalesce(role, none))
                .when(kind == "Person", person).otherwise(none))

    none = F.array().cast(f"array<{RULE_PERSON}>")
    return F.flatten(F.transform(ld_items(bodies), one))


def jsonld_people(pages: DataFrame) -> DataFrame:
    """People in the structured data of each page; needs no HTML reader."""
    rows = pages.select("page_id", "url", F.posexplode(ld_people(ld_bodies("html"))).alias("pos", "p"))
    return rows.select("page_id", "url", "pos", *[F.col(f"p.{c}").alias(c) for c in PERSON_COLUMNS]).filter(
        is_person_name("name"))


def _first_text(rules: list, nodes: Column, ok) -> Column:
    """Text of the first rule whose first node passes ``ok``."""
    texts = F.array(*[N.text_of(N.first(r, nodes)) for r in rules])
    return F.get(F.filter(texts, lambda t: ok(t)), F.lit(0))


ABOUT_PATH = r"about|team|leadership|management|founders|executives|staff|people|directors"
CARD_MARKS = ["team-member", "team-member-card", "staff-member", "executive-card", "leadership-card"]
CARD_CLASSES = CARD_MARKS + ["person-card", "member-card", "employee-card"]
TITLE_WORD = (
    r"\b(ceo|cto|cfo|director|manager|president|founder|owner|head|lead|vp|vice president|chief|executive|coordinator|"
    r"supervisor|administrator|officer)\b")


def microdata_people() -> Column:
    def one(e: Column) -> Column:
        return let(N.inside(e), described)

    def described(within: Column) -> Column:
        name = F.coalesce(null_if_empty(N.text_of(N.first(N.attr_is("itemprop", "name"), within))),
                          N.text_of(N.first(N.has_tag("h2", "h3", "h4"), within)))
        title = F.coalesce(null_if_empty(N.text_of(N.first(N.attr_is("itemprop", "jobTitle"), within))),
                           null_if_empty(N.text_of(N.first(N.has_class("title", "role", "position"), within))),
                           F.lit("Team Member"))
        return _struct(name, title, 0.85, "structured_data", 1)

    return F.transform(N.select(lambda n: N.attr(n, "itemtype").contains("Person")), one)


def profile_meta_people() -> Column:
    role = null_if_empty(N.attr(N.first(lambda n: (n["tag"] == "meta") & N.attr(n, "property").rlike("title|role")), "content"))
    tags = N.select(lambda n: (n["tag"] == "meta") & N.attr(n, "property").startswith("og:")
                    & N.attr(n, "property").contains("profile"))
    return F.transform(tags, lambda n: _struct(
        N.attr(n, "content"), F.coalesce(role, F.lit("Team Member")), 0.8, "structured_data", 2))


def team_card_people() -> Column:
    """Cards of team pages: name from name classes, data, headings or image text; title likewise."""
    relevant = F.coalesce(url_path("url").rlike(ABOUT_PATH), F.lit(False)) | (
        N.count(N.any_of(N.has_class(*CARD_MARKS), N.has_attr("data-team-member"))) > 0)

    def one(e: Column) -> Column:
        return let(N.inside(e), lambda within: described(e, within))

    def described(e: Column, within: Column) -> Column:
        name = F.coalesce(
            _first_text([N.has_class("name"), N.has_class("person-name"), N.has_class("member-name"), N.has_attr("data-name"),
                         N.has_tag("h3"), N.has_tag("h4")], within, is_person_name),
            N.attr(N.first(N.has_tag("img"), within), "alt"))
        title = F.coalesce(
            _first_text([N.has_class("title"), N.has_class("role"), N.has_class("position"), N.has_class("job-title"),
                         N.has_attr("data-title"), N.has_attr("data-role")], within, lambda t: F.length(t).between(3, 99)),
            null_if_empty(F.regexp_extract(F.lower(N.text_of(e)), TITLE_WORD, 1)), F.lit("Team Member"))
        return _struct(name, title, 0.85, "website", 3)

    cards = N.select(N.any_of(N.has_class(*CARD_CLASSES), N.has_attr("data-team-member", "data-person")))
    return F.when(relevant, F.transform(cards, one)).otherwise(F.array().cast(f"array<{RULE_PERSON}>"))


def title_case_free(titles: str) -> str:
    return f"(?i:{titles})"


NAME_TITLE = rf"({R.NAME_CAPTURE})\s*[,\-–—]\s*({title_case_free(R.TEAM_TITLES)})"
TITLE_NAME = rf"({title_case_free(R.TEAM_TITLES)})\s*:\s*({R.NAME_CAPTURE})"


def named_in_text(text: Column, pattern: str, name_group: int, title_group: int, source: str, confidence: float,
                  order: int) -> Column:
    return F.transform(all_groups(pattern, text), lambda m: _struct(
        F.trim(F.regexp_extract(m, pattern, name_group)), F.trim(F.regexp_extract(m, pattern, title_group)), confidence,
        source, order))


def text_people() -> Column:
    """'Name, Title' and 'Title: Name' in the page text of about and team pages."""
    relevant = F.coalesce(url_path("url").rlike(ABOUT_PATH), F.lit(False))
    found = F.concat(named_in_text(F.col("page_text"), NAME_TITLE, 1, 2, "website", 0.8, 4),
                     named_in_text(F.col("page_text"), TITLE_NAME, 2, 1, "website", 0.8, 5))
    return F.filter(found, lambda p: relevant)


def page_people(pages: DataFrame, limit: int = PEOPLE_PER_PAGE) -> DataFrame:
    """People of each page, most reliable rule first: structured data, microdata, profile meta, cards, text.

    Structured rules count a name once; cards and text count a name once per title. At most ``limit`` per page.
    """
    marked = read_nodes(pages.select("page_id", "url", "html"))
    found = F.concat(ld_people(F.col("ld")), microdata_people(), profile_meta_people(), team_card_people(), text_people())
    rows = marked.select("page_id", "url", F.posexplode(found).alias("pos", "p"))
    every = rows.select(
        "page_id", "url", F.col("p.rule").alias("rule"), "pos", *[F.col(f"p.{c}").alias(c) for c in PERSON_COLUMNS])
    every = every.filter(is_person_name("name")).withColumn(
        "key", F.when(F.col("rule") <= 2, F.lower("name")).otherwise(
            F.concat_ws("-", F.lower("name"), F.lower("title"))))
    first = first_per_key(every, ["page_id", "key"], ["rule", "pos"]).drop("key")
    return top_per_key(first, ["page_id"], [F.asc("rule"), F.asc("pos")], limit)


PROFILE_BLOCKS = ["team-member", "member", "leadership", "executive", "profile", "person", "board-member", "management",
                  "staff", "director"]
DASH_NAME = (
    r"([A-ZÁÉÍÓÚÑ][a-záéíóúñ]+(?:\s+[A-ZÁÉÍÓÚÑ][a-záéíóúñ]+){1,3})\s*[-–|,]\s*([A-Za-zÀ-ÿ&/\s]{3,60})")


def page_executives(pages: DataFrame) -> DataFrame:
    """Executives on company pages: profile blocks (.85) and 'Name - Title' lines (.65), one row per find."""
    read = read_nodes(pages.select("page_id", "url", "html"))

    def block(e: Column) -> Column:
        return let(N.inside(e), block_person)

    def block_person(within: Column) -> Column:
        name = N.text_of(N.first(N.any_of(N.has_tag("h2", "h3"), N.has_class("name")), within))
        title = N.text_of(N.first(N.any_of(N.has_tag("h4"), N.has_class("title", "role", "position")), within))
        return F.struct(name.alias("name"), title.alias("title"), F.lit(0.85).alias("confidence"),
                        ((F.length(name) > 3) & (F.length(title) > 2)).alias("ok"))

    def line(e: Column) -> Column:
        return let(F.regexp_replace(N.text_of(e), r"\s+", " "), line_person)

    def line_person(t: Column) -> Column:
        name, title = F.trim(F.regexp_extract(t, DASH_NAME, 1)), F.trim(F.regexp_extract(t, DASH_NAME, 2))
        return F.struct(name.alias("name"), title.alias("title"), F.lit(0.65).alias("confidence"),
                        ((name != "") & (title != "")).alias("ok"))

    found = F.concat(*[F.transform(N.select(N.has_class(c)), block) for c in PROFILE_BLOCKS],
                     F.transform(N.select(N.has_tag("h1", "h2", "h3", "h4", "p", "li")), line))
    rows = read.select("page_id", "url", F.posexplode(found).alias("pos", "p")).filter("p.ok")
    return rows.select("page_id", "url", "pos", F.col("p.name").alias("name"), F.col("p.title").alias("title"),
                       F.col("url").alias("source"), F.col("p.confidence").alias("confidence"))


def site_executives(executives: DataFrame, limit: int = 10) -> DataFrame:
    """Best find per name and domain, executive titles only, ten per domain by confidence."""
    rows = executives.withColumn("domain", url_host("url")).filter("domain IS NOT NULL").withColumn("key", F.lower("name"))
    rows = rows.withColumn("less", -F.col("confidence"))
    best = first_per_key(rows, ["domain", "key"], ["less", "page_id", "pos"]).drop("key", "less")
    best = best.filter(F.lower("title").rlike(f"({R.EXECUTIVE_WORDS})")).withColumn(
        "confidence", F.coalesce("confidence", title_relevance("title")))
    return top_per_key(best, ["domain"], [F.desc("confidence"), F.asc("page_id"), F.asc("pos")], limit)


# --- in other texts ------------------------------------------------------------------------------

_T = title_case_free(R.PRESS_TITLES)
PRESS_RULES = [
    (rf"({_T})\s+({R.NAME_CAPTURE})\s+(?i:said|announced|stated|commented|explained|noted)", 2, 1),
    (rf"({R.NAME_CAPTURE}),\s*({_T})", 1, 2),
    (rf"(?i:announced|led|spearheaded|headed)\s+(?i:by)\s+({R.NAME_CAPTURE}),\s*({_T})", 1, 2),
    (rf"[\"'”’]\s*[-–—]\s*({R.NAME_CAPTURE}),\s*({_T})", 1, 2),
]
ENCYCLOPEDIA_RULES = [
    (rf"\|\s*({_T})\s*=\s*({R.NAME_CAPTURE})", 2, 1),
    (rf"(?s)==\s*Leadership\s*==.*?\*\s*({R.NAME_CAPTURE})\s*\(([^)]+)\)", 1, 2),
    (rf"({R.NAME_CAPTURE})\s+is\s+the\s+({_T})", 1, 2),
]


def text_rule_people(texts: DataFrame, key: str, text: Column, rules: list[tuple[str, int, int]], source: str,
                     confidence: float, limit: int = PEOPLE_PER_PAGE) -> DataFrame:
    """People named by an ordered list of patterns; each name once per ``key``, the first ``limit``."""
    found = F.concat(*[named_in_text(text, p, n, t, source, confidence, i) for i, (p, n, t) in enumerate(rules)])
    rows = texts.select(key, F.posexplode(found).alias("pos", "p")).select(
        key, "pos", *[F.col(f"p.{c}").alias(c) for c in PERSON_COLUMNS])
    rows = rows.filter(F.length("name").between(3, 50)).withColumn("lower_name", F.lower("name"))
    first = first_per_key(rows, [key, "lower_name"], ["pos"]).drop("lower_name")
    return top_per_key(first, [key], [F.asc("pos")], limit)


def press_people(texts: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    return text_rule_people(texts, key, F.col(text), PRESS_RULES, "press_release", 0.85)


def encyclopedia_people(texts: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    return text_rule_people(texts, key, F.col(text), ENCYCLOPEDIA_RULES, "wikipedia", 0.9)


CLOSING = r"(?i:best\s+regards|sincerely|thanks|thank\s+you|cheers|warm\s+regards)"
SIGNATURE_RULES = [
    rf"{CLOSING}[,\s]+({R.NAME_CAPTURE})[,\s]+({_T})",
    rf"({R.NAME_CAPTURE})\s*\n\s*({_T})",
]


def signature_people(messages: DataFrame, key: str = "message_id", body: str = "body", email: str = "email") -> DataFrame:
    """Person behind an address: from a signature (.9), else from a two-part local part (.6)."""
    b, e = F.col(body), F.col(email)
    signed = F.coalesce(*[
        F.when(F.length(F.regexp_extract(b, p, 1)).between(3, 50),
               F.struct(F.regexp_extract(b, p, 1).alias("name"), F.regexp_extract(b, p, 2).alias("title"),
                        F.lit("email_signature").alias("source"), F.lit(0.9).alias("confidence")))
        for p in SIGNATURE_RULES])
    local = F.regexp_extract(e, "^([^@]*)@", 1)
    guess = F.initcap(F.lower(F.regexp_replace(local, "[._-]", " ")))
    inferred = F.when(
        local.rlike("[._-]") & F.length(guess).between(1, 50),
        F.struct(guess.alias("name"), F.lit(None).cast("string").alias("title"), F.lit("email_inference").alias("source"),
                 F.lit(0.6).alias("confidence")))
    rows = messages.filter((text_or_empty(body) != "") & (text_or_empty(email) != "")).select(
        key, e.alias("email"), F.coalesce(signed, inferred).alias("p"))
    return rows.filter("p IS NOT NULL").select(
        key, F.col("p.name").alias("name"), F.col("p.title").alias("title"), "email", F.col("p.source").alias("source"),
        F.col("p.confidence").alias("confidence"))


def registry_people(dumps: DataFrame, key: str = "search_id") -> DataFrame:
    """Officers of the first company of a registry payload, at most five (.95)."""
    schema = (
        "struct<results:struct<companies:array<struct<company:struct<officers:array<struct<officer:struct<"
        "name:string,position:string>>>>>>>>")
    officers = F.get(F.from_json("payload", schema)["results"]["companies"], F.lit(0))["company"]["officers"]
    rows = dumps.select(key, F.posexplode(F.slice(officers, 1, 5)).alias("pos", "o"))
    rows = rows.filter(text_or_empty("o.officer.name") != "")
    return rows.select(key, "pos", *_person(
        F.col("o.officer.name"), F.coalesce(null_if_empty(F.col("o.officer.position")), F.lit("Director")),
        "opencorporates", 0.95))


_S = title_case_free(R.SEARCH_TITLES)
SEARCH_NAME = r"[A-Z][a-z]+(?:\s+[A-Z][a-z]+)+"
SEARCH_RULES = [(rf"({SEARCH_NAME})\s*[,\-–]\s*({_S})", 1, 2), (rf"({_S})\s*[:\-]\s*({SEARCH_NAME})", 2, 1)]
RESULT_EMAIL = r"\b[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Z|a-z]{2,}\b"


def result_text() -> Column:
    return F.concat_ws(" ", text_or_empty("title"), text_or_empty("snippet"), text_or_empty("link"))


def result_emails(results: DataFrame) -> DataFrame:
    """Distinct addresses in search results per search."""
    return results.select(
        "search_id", F.explode(all_groups(RESULT_EMAIL, result_text())).alias("email")).select(
        "search_id", F.lower("email").alias("email")).distinct()


def result_people(results: DataFrame, source: str = "google_search") -> DataFrame:
    """'Name - Title' people in search results with a fitting address (.8 with, .6 without); once per name and title."""
    text = result_text()
    emails = F.array_distinct(F.transform(all_groups(RESULT_EMAIL, text), lambda e: F.lower(e)))
    found = F.concat(*[named_in_text(text, p, n, t, source, 0.6, i) for i, (p, n, t) in enumerate(SEARCH_RULES)])
    kept = results.filter(~F.lower(text_or_empty("link")).contains("wikidata.org"))
    rows = kept.select("search_id", F.col("pos").alias("result_pos"), emails.alias("emails"),
                       F.posexplode(found).alias("i", "p")).filter(is_search_person_name("p.name"))
    mail = first_email_for("p.name", "emails")
    rows = rows.select(
        "search_id", "result_pos", "i", F.col("p.name").alias("name"), F.col("p.title").alias("title"), mail.alias("email"),
        F.lit(source).alias("source"), F.when(mail.isNotNull(), 0.8).otherwise(0.6).alias("confidence"),
        F.concat_ws("-", F.lower("p.name"), F.lower("p.title")).alias("key"))
    return first_per_key(rows, ["search_id", "key"], ["result_pos", "i"]).drop("key")


# --- merged per site -----------------------------------------------------------------------------

SOURCE_ORDER = ["main_page", "team_pages", "search_results", "press", "signatures", "registry", "encyclopedia"]


def merge_people(people: DataFrame, limit: int = PEOPLE_PER_SITE, enough: int = ENOUGH_PEOPLE) -> DataFrame:
    """People per ``site`` from ordered sources: a later source counts only while fewer than ``enough`` are known.

    ``people``: ``site, source_rank, pos`` and the person columns. A person is a name and title, once per site.
    """
    keyed = people.withColumn("key", F.concat_ws("-", F.lower("name"), text_or_empty(F.lower("title"))))
    # people are few next to the pages they come from; keep them, so that pages are read once
    first = checkpointed(first_per_key(keyed, ["site", "key"], ["source_rank", "pos"]).drop("key"))
    sizes = first.groupBy("site", "source_rank").agg(F.count(F.lit(1)).alias("n"))
    earlier = F.coalesce(
        F.sum("n").over(W.partitionBy("site").orderBy("source_rank").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    sizes = sizes.withColumn("known", earlier)
    open_rows = attach_per_key(first, sizes, ["site", "source_rank"], "n").filter(F.col("known") < enough).drop("known")
    return top_per_key(open_rows, ["site"], [F.asc("source_rank"), F.asc("pos"), F.asc("name")], limit)


def site_people(pages: DataFrame, others: DataFrame | None = None) -> DataFrame:
    """Pages of one domain: the start page is source 0, about/team pages source 1; ``others`` add later sources.

    ``pos`` of the result is a struct of page_id and place on the page, which order by page whatever ids are.
    """
    found = page_people(pages).withColumn("site", url_host("url")).filter("site IS NOT NULL")
    start = F.regexp_replace(url_path("url"), "/$", "") == ""
    rows = found.select(
        "site", F.when(start, 0).otherwise(1).alias("source_rank"),
        F.struct("page_id", "pos").alias("pos"), *PERSON_COLUMNS)
    if others is not None:
        page = F.lit(0).cast(pages.schema["page_id"].dataType)
        rows = rows.unionByName(others.withColumn("pos", F.struct(page.alias("page_id"), F.col("pos").cast("int").alias("pos"))))
    return merge_people(rows)


def page_text_people(pages: DataFrame) -> DataFrame:
    """Press-style people in the visible text of pages."""
    return text_rule_people(pages, "page_id", visible_text("html"), PRESS_RULES, "press_release", 0.85)


@dataclass(frozen=True)
class Stage:
    """A source of people: ``rows`` with a ``site``, and what makes (site, at, person columns) of them; ``at`` orders
    the finds of a site."""

    rows: DataFrame
    people: Callable[[DataFrame], DataFrame]


def people_in_stages(stages: list[Stage], limit: int = PEOPLE_PER_SITE, enough: int = ENOUGH_PEOPLE) -> DataFrame:
    """(site, source_rank, pos, person columns): each source is only read for sites that earlier ones left with fewer
    than ``enough`` people.

    A person is a name and title, once per site, from the first source that has it. Rows of sites that have enough are
    taken out before the rules of a source run. Sites are null-free; rows without one are left out.
    """
    known: DataFrame | None = None
    for rank, stage in enumerate(stages):
        rows = stage.rows.filter("site IS NOT NULL")
        if known is not None:
            done = known.groupBy("site").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") >= enough).select("site")
            rows = rows.join(done, "site", "left_anti")
        found = stage.people(rows).select("site", "at", *PERSON_COLUMNS)
        keyed = found.withColumn("key", F.concat_ws("-", F.lower("name"), text_or_empty(F.lower("title"))))
        fresh = first_per_key(keyed, ["site", "key"], ["at", "name", "title"])
        if known is not None:
            fresh = fresh.join(known.select("site", "key"), ["site", "key"], "left_anti")
        fresh = top_per_key(fresh, ["site"], [F.asc("at"), F.asc("key")], limit, "pos").drop("at")
        fresh = fresh.withColumn("source_rank", F.lit(rank))
        known = checkpointed(fresh if known is None else known.unionByName(fresh))
    out = top_per_key(known, ["site"], [F.asc("source_rank"), F.asc("pos")], limit)
    return out.select("site", "source_rank", "pos", *PERSON_COLUMNS)


def mail_contexts(pages: DataFrame, limit: int = 5) -> DataFrame:
    """(site, at, email, body): the first mail links of a page with the text of the element around each."""
    read = read_nodes(pages.select("site", "page_id", "url", "html"))
    links = F.slice(N.select(lambda n: (n["tag"] == "a") & F.lower(N.attr(n, "href")).startswith("mailto:")), 1, limit)

    def context(a: Column) -> Column:
        around = F.try_element_at(F.filter(N.all_nodes(), lambda n: (n["seq"] < a["seq"]) & (n["stop"] > a["seq"])), F.lit(-1))
        address = F.regexp_extract(N.attr(a, "href"), "(?i)^mailto:([^?]*)", 1)
        return F.struct(F.lower(F.trim(address)).alias("email"), N.text_of(around).alias("body"))
    rows = read.select("site", "page_id", F.posexplode(F.transform(links, context)).alias("i", "m"))
    return rows.select("site", F.struct("page_id", "i").alias("at"), "m.email", "m.body")


def site_people_stages(pages: DataFrame, sites: DataFrame, results: DataFrame, registry: DataFrame, articles: DataFrame) -> list[Stage]:
    """The sources of ``SOURCE_ORDER`` for ``people_in_stages``.

    ``pages``: page_id, url, html. ``sites`` (site, company_id) gives rows that have no page their site: ``results``
    (company_id, pos, title, snippet, link), ``registry`` (company_id, payload), ``articles`` (company_id, text).
    """
    own = pages.select("page_id", "url", "html", url_host("url").alias("site"))
    is_start = F.regexp_replace(text_or_empty(url_path("url")), "/$", "") == ""
    start, others = own.filter(is_start), own.filter(~is_start)
    with_site = lambda df: df.join(sites.select("site", "company_id"), "company_id")

    def on_pages(rows: DataFrame) -> DataFrame:
        return page_people(rows).select(url_host("url").alias("site"), F.struct("page_id", "pos").alias("at"), *PERSON_COLUMNS)

    def in_results(rows: DataFrame) -> DataFrame:
        found = result_people(rows.drop("search_id").withColumnRenamed("site", "search_id"))
        return found.filter(text_or_empty("title") != "").select(F.col("search_id").alias("site"), F.struct("result_pos", "i").alias("at"), *PERSON_COLUMNS)

    def in_press(rows: DataFrame) -> DataFrame:
        return text_rule_people(rows, "site", visible_text("html"), PRESS_RULES, "press_release", 0.85).withColumnRenamed("pos", "at")

    def in_signatures(rows: DataFrame) -> DataFrame:
        contexts = mail_contexts(rows).withColumn("key", F.struct("site", "at"))
        return signature_people(contexts, "key", "body", "email").select("key.site", "key.at", *PERSON_COLUMNS)

    def in_registry(rows: DataFrame) -> DataFrame:
        return registry_people(rows, "site").withColumnRenamed("pos", "at")

    def in_articles(rows: DataFrame) -> DataFrame:
        return encyclopedia_people(rows, "site").withColumnRenamed("pos", "at")
    return [Stage(start, on_pages), Stage(others, on_pages), Stage(with_site(results), in_results), Stage(start, in_press),
            Stage(start, in_signatures), Stage(with_site(registry), in_registry), Stage(with_site(articles), in_articles)]


def new_people(existing: DataFrame, found: DataFrame, key: str, limit: int = PEOPLE_PER_SITE) -> DataFrame:
    """Existing people plus found ones whose lower-cased name is not there yet, up to ``limit`` per ``key``."""
    both = existing.withColumn("__s", F.lit(0)).unionByName(found.withColumn("__s", F.lit(1)))
    both = both.filter(F.length(text_or_empty("name")) > 2).withColumn("__k", F.lower("name"))
    first = first_per_key(both, [key, "__k"], ["__s", "pos"])
    return top_per_key(first, [key], [F.asc("__s"), F.asc("pos")], limit).drop("__s", "__k")
