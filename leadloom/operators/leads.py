"""Leads from results and extraction, and their enrichment and scores."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from leadloom import schemas as S
from leadloom.functions import domain as D
from leadloom.functions.company import (
    contacts_from_people, default_contacts, employee_range, employees, hiring_signals)
from leadloom.functions.email import is_business_email, merge_emails, usable_template, verify_emails
from leadloom.functions.location import location_distance_km, parse_location
from leadloom.functions.person import is_not_noise, is_placeholder_person
from leadloom.functions.phone import format_phone, is_sane_phone, phone_country
from leadloom.functions.score import quality_score, verification
from leadloom.functions.text import filled, null_if_empty, text_or_empty
from leadloom.functions.title import enrich_people
from leadloom.functions.url import bare_domain, careers_path, is_query_link, url_host
from leadloom.operators.skew import lookup_per_key
from leadloom.session import checkpointed

UNKNOWN = ("unknown business", "unknown company")


# --- names and sites -----------------------------------------------------------------------------

def lead_name(extracted: Column, title: Column, link: Column) -> Column:
    """Company name of a result: the extracted name, or the title up to ' - ' when the extracted one is a place id,
    unknown, or only repeats the domain; for person pages the domain is the last resort. NULL when none is left."""
    name = null_if_empty(F.trim(text_or_empty(extracted)))
    short = null_if_empty(F.regexp_extract(text_or_empty(title), r"(?s)^(.*?)(?: - .*)?$", 1))
    short = F.coalesce(short, title)
    person_page = text_or_empty(title).contains(" - ")
    label = F.regexp_extract(text_or_empty(url_host(link)), r"^([^.]*)", 1)
    plain = F.regexp_replace(F.lower(name), "[^a-z0-9]", "")
    from_domain = (
        ~name.contains(" ") & (F.length(name) < 20) & (plain != "") & (label != "")
        & (plain.startswith(label) | label.startswith(plain)))
    weak = F.coalesce(F.lower(name).isin(*UNKNOWN) | from_domain, F.lit(False))
    use_title = weak & ~person_page & (F.length(F.trim(short)) > 2)
    placed = D.is_place_id(name)
    chosen = F.when(name.isNull() | placed | use_title, short).otherwise(name)
    domain_name = F.concat(F.upper(F.substring(label, 1, 1)), F.substr(label, F.lit(2)))
    return F.coalesce(null_if_empty(F.trim(text_or_empty(chosen))),
                      F.when(person_page & (F.length(label) > 2), domain_name))


def lead_website(extracted: Column, link: Column, allow: tuple[str, ...] = ()) -> Column:
    """Extracted site, else the link; social, placeholder, search and place links give NULL."""
    def usable(u: Column) -> Column:
        return F.when((text_or_empty(u) != "") & ~D.is_social_url(u) & ~is_query_link(u) & ~u.startswith("places:"), u)

    site = F.coalesce(usable(extracted), usable(link))
    return F.when(url_host(site).isNotNull() & ~D.is_placeholder_host(url_host(site), allow), site)


def merge_extractions(leads: DataFrame, site: DataFrame) -> DataFrame:
    """Place data and a later reading of the site: the site wins for people, e-mails, about text, signals and socials;
    phone and address of the place win. Both sides have one row per ``lead_id``."""
    s = site.select("lead_id", *[F.col(c).alias("s_" + c) for c in (
        "decision_makers", "emails", "phones", "address", "about_text", "category_signals", "socials")])
    j = leads.join(s, "lead_id", "left")

    def full(c: str) -> Column:
        return F.size(F.coalesce(F.col(c), F.array())) > 0

    pick = {
        "decision_makers": F.when(full("s_decision_makers"), F.col("s_decision_makers")).otherwise(F.col("decision_makers")),
        "emails": F.when(full("s_emails"), F.col("s_emails")).otherwise(F.col("emails")),
        "phones": F.when(full("s_phones") & ~full("phones"), F.col("s_phones")).otherwise(F.col("phones")),
        "address": F.coalesce(null_if_empty(F.col("address")), F.col("s_address")),
        "about_text": F.coalesce(null_if_empty(F.col("s_about_text")), F.col("about_text")),
        "category_signals": F.coalesce(F.col("s_category_signals"), F.col("category_signals")),
        "socials": F.coalesce(F.col("s_socials"), F.col("socials")),
    }
    return j.select(*[pick[c].alias(c) if c in pick else F.col(c) for c in leads.columns])


# --- build ---------------------------------------------------------------------------------------

def build_leads(results: DataFrame, contacts: DataFrame, people: DataFrame, searches: DataFrame,
                sites: DataFrame | None = None, allow: tuple[str, ...] = ()) -> DataFrame:
    """Leads from results, page contacts (by URL), people (by site) and searches, with all lead gates applied.

    ``results``: search-result rows with ``lead_id``; ``contacts``: output of ``extract_contacts``; ``people``: output of
    ``site_people``; ``sites``: output of ``classify_sites``. These come from HTML and are read more than once here, so
    hand them over as tables or checkpointed. Cheap filters run before the joins.
    """
    r = results.filter(~D.is_social_url("link") & ~D.is_article("title", "link") & ~D.is_directory_site("link", "title"))
    c = contacts.select(*[F.col(x).alias("x_" + x) for x in contacts.columns if x not in ("page_id", "url")],
                        F.col("url").alias("link"))
    j = lookup_per_key(r, c, ["link"])
    j = j.join(searches.select("search_id", "query", "country", F.col("location").alias("wanted_place"), "industry"), "search_id")
    j = j.withColumn("company_name", lead_name(F.col("x_company_name"), F.col("title"), F.col("link")))
    j = j.filter(
        F.col("company_name").isNotNull() & ~D.is_generic_name("company_name")
        & D.is_valid_company_name("company_name", is_query_link("link")))
    trade = text_or_empty("query").rlike(
        r"(?i)\b(restaurant|hospital|clinic|school|university|store|shop|company|business|agency|firm)\b")
    checked = (F.length(F.trim(text_or_empty("industry"))) > 0) | trade
    wanted = F.coalesce(null_if_empty(F.trim(text_or_empty("industry"))), F.col("query"))
    verdict = D.relevance("company_name", "x_about_text", "x_category_signals", wanted)
    j = j.filter(~checked | D.keep_relevant(verdict))

    site = lead_website(F.col("x_website"), F.col("link"), allow)
    rich = (F.length(F.trim("company_name")) > 2) & (
        filled("address") | filled("phone") | filled("x_address")
        | (F.size(F.coalesce(F.col("x_phones"), F.array())) > 0))
    j = j.withColumn("website", site).filter(F.col("website").isNotNull() | rich)
    j = j.filter(~D.is_directory_site("website", "company_name"))
    if sites is not None:
        bad = sites.filter("score <= -3").select("url").distinct()
        j = j.join(bad.withColumnRenamed("url", "website"), "website", "left_anti")

    j = j.withColumn("site", bare_domain("website"))
    grouped = people.groupBy("site").agg(F.array_sort(F.collect_list(
        F.struct("source_rank", "pos", "name", "title", "email", "source", "confidence"))).alias("found"))
    # the gates above run once; at most twelve people per site
    j = lookup_per_key(checkpointed(j), grouped, ["site"])
    none_person = F.array().cast(f"array<{S.PERSON}>")
    makers = F.transform("found", lambda p: F.struct(
        p["name"].alias("name"), p["title"].alias("title"), F.lit(None).cast("string").alias("normalized_title"),
        F.lit(None).cast("string").alias("seniority"), F.lit(None).cast("string").alias("department"),
        p["email"].alias("email"), p["source"].alias("source"), p["confidence"].alias("confidence")))
    makers = F.coalesce(makers, none_person)
    plain = F.transform(makers, lambda p: F.struct(
        p["name"].alias("name"), p["title"].alias("title"), p["email"].alias("email"), p["source"].alias("source"),
        p["confidence"].alias("confidence")))
    emails = F.filter(merge_emails("x_emails", plain), lambda e: is_business_email(e["email"]))
    emails = verify_emails(F.transform(emails, lambda e: F.struct(
        e["email"].alias("email"), F.coalesce(e["source"], F.lit("website")).alias("source"),
        F.coalesce(e["confidence"], F.lit(0.8)).alias("confidence"))))

    fp = format_phone("phone", "country")
    own_phone = F.array(F.struct(
        fp.alias("phone"), phone_country(fp, "country").alias("country"), fp.alias("formatted"),
        F.when(F.col("is_place"), "google_places_api").otherwise("search_result").alias("source"),
        F.when(F.col("is_place"), 0.95).otherwise(0.8).alias("confidence")))
    read_phones = F.filter(F.coalesce(F.col("x_phones"), F.array().cast(f"array<{S.PHONE}>")), lambda p: is_sane_phone(p["phone"]))
    phones = F.when(filled("phone") & (F.coalesce(F.col("is_place"), F.lit(False)) | (F.size(read_phones) == 0)), own_phone).otherwise(read_phones)
    address = F.when(F.coalesce(F.col("is_place"), F.lit(False)), F.coalesce(null_if_empty(F.col("address")), F.col("x_address"))).otherwise(
        F.coalesce(null_if_empty(F.col("x_address")), F.col("address")))
    lead = j.select(
        "lead_id", "search_id", F.col("title").alias("raw_title"), F.col("snippet").alias("raw_snippet"),
        F.col("link").alias("raw_link"), "company_name", "website", emails.alias("emails"), phones.alias("phones"),
        F.coalesce("x_whatsapp_links", F.array().cast("array<string>")).alias("whatsapp_links"), address.alias("address"),
        F.col("x_socials").alias("socials"), F.col("x_about_text").alias("about_text"),
        F.coalesce("x_category_signals", F.array().cast("array<string>")).alias("category_signals"),
        makers.alias("decision_makers"), "wanted_place",
        F.lit("extracted").alias("extraction_status"), F.lit("pending").alias("enrichment_status"), "created_at")
    return lead.withColumn("quality_score", quality_score()).withColumn(
        "distance_km", location_distance_km("wanted_place", "address")).drop("wanted_place")


# --- enrich --------------------------------------------------------------------------------------

def careers_domains(pages: DataFrame) -> DataFrame:
    """Domains that have a careers page among the pages."""
    return pages.filter(careers_path("url")).select(bare_domain("url").alias("domain")).distinct()


def with_careers_page(leads: DataFrame, pages: DataFrame) -> DataFrame:
    marked = leads.withColumn("domain", bare_domain("website"))
    known = careers_domains(pages).withColumn("has_careers_page", F.lit(True))
    out = lookup_per_key(marked, known, ["domain"])
    return out.select(*leads.columns, F.coalesce("has_careers_page", F.lit(False)).alias("has_careers_page"))


def enrichment_defaults(enrichment: DataFrame) -> DataFrame:
    """Missing values filled, unusable e-mail templates dropped."""
    def text(c: str, default: str) -> Column:
        return F.coalesce(null_if_empty(F.col(c)), F.lit(default)).alias(c)

    fixed = {
        "business_summary": text("business_summary", ""), "company_size": text("company_size", "unknown"),
        "revenue_bracket": text("revenue_bracket", "unknown"), "industry": text("industry", "unknown"),
        "email_pattern": F.coalesce(usable_template("email_pattern"), F.lit("")).alias("email_pattern"),
        "contact_relevance": F.coalesce(F.nullif("contact_relevance", F.lit(0)), F.lit(50)).alias("contact_relevance"),
        "signal_strength": F.coalesce(F.nullif("signal_strength", F.lit(0)), F.lit(50)).alias("signal_strength"),
    }
    return enrichment.select(*[fixed.get(c, F.col(c)) for c in enrichment.columns])


def merge_decision_makers(own: Column, enriched: Column) -> Column:
    """Extracted people first, then enriched ones with new names that are no placeholders; noise dropped."""
    extra = F.filter(enriched, lambda p: ~is_placeholder_person(p))
    both = F.concat(own, extra)
    names = F.transform(both, lambda p: F.lower(F.trim(text_or_empty(p["name"]))))
    unique = F.filter(both, lambda p, i: F.array_position(names, F.lower(F.trim(text_or_empty(p["name"])))) == i + 1)
    return F.filter(unique, is_not_noise)


def enrich_leads(leads: DataFrame, enrichment: DataFrame, pages: DataFrame | None = None) -> DataFrame:
    """Leads joined with their enrichment row: sizes, location, hiring, people with titles and e-mails, scores.

    Contact fields found by extraction stay; contacts add people and e-mails that are new. One row per lead on both
    sides, so the join key is unique.
    """
    e = enrichment_defaults(enrichment)
    clash = [c for c in e.columns if c in leads.columns and c != "lead_id"]
    j = (with_careers_page(leads, pages) if pages is not None else leads.withColumn("has_careers_page", F.lit(False)))
    j = j.join(e.drop(*clash), "lead_id", "left")
    count = employees("employee_count", "company_size")
    contacts = F.coalesce(F.col("contacts"), F.array().cast(f"array<{S.CONTACT}>"))
    own = F.coalesce(F.col("decision_makers"), F.array().cast(f"array<{S.PERSON}>"))
    from_contacts = F.transform(contacts, lambda c: F.struct(
        c["name"].alias("name"), F.coalesce(null_if_empty(c["title"]), F.lit("Executive")).alias("title"),
        F.lit(None).cast("string").alias("normalized_title"), F.lit(None).cast("string").alias("seniority"),
        F.lit(None).cast("string").alias("department"), c["suggested_email"].alias("email"),
        F.lit("linkedin").alias("source"), F.lit(0.7).alias("confidence")))
    people = enrich_people(merge_decision_makers(own, from_contacts), F.col("email_pattern"), F.col("website"))
    have = F.transform("emails", lambda m: F.lower(m["email"]))
    new_mail = F.filter(contacts, lambda c: (text_or_empty(c["suggested_email"]) != "")
                        & ~F.array_contains(have, F.lower(c["suggested_email"])))
    new_mail = F.transform(new_mail, lambda c: F.struct(
        c["suggested_email"].alias("email"), F.lit("linkedin").alias("source"), F.lit(0.7).alias("confidence"),
        F.lit(None).cast("struct<score:int,status:string,reason:string,method:string>").alias("deliverability")))
    emails = F.when(F.size("emails") > 0, F.concat(F.col("emails"), new_mail)).otherwise(F.col("emails"))
    out = j.withColumns({
        "employee_count": count, "employee_count_range": F.coalesce("employee_count_range", employee_range(count)),
        "location": parse_location("address", "website"),
        "hiring": hiring_signals("has_careers_page", "about_text", "website"),
        "decision_makers": people, "emails": emails,
        "contacts": F.when(F.size(contacts) > 0, contacts).otherwise(contacts_from_people(people, "company_name")),
        "enrichment_status": F.lit("enriched"),
    }).drop("has_careers_page")
    v = verification({"contacts": contacts})
    scored = out.withColumn("__v", v)
    return scored.withColumn("verification_score", F.col("__v.score")).withColumn(
        "verification_sources", F.col("__v.sources")).drop("__v")


def refundable(leads: DataFrame) -> DataFrame:
    """Enriched leads without a person that has an e-mail."""
    reachable = F.exists(F.coalesce(F.col("decision_makers"), F.array().cast(f"array<{S.PERSON}>")),
                         lambda p: text_or_empty(p["email"]) != "")
    return leads.filter((F.col("enrichment_status") == "enriched") & ~F.coalesce(reachable, F.lit(False)))


def suggested_roles(leads: DataFrame) -> DataFrame:
    """One row per default role to look for, by company size."""
    rows = leads.select("lead_id", F.posexplode(default_contacts("company_size")).alias("pos", "c"))
    return rows.select("lead_id", "pos", "c.*")


def with_distance(leads: DataFrame, searches: DataFrame) -> DataFrame:
    """Leads with the distance between the place of their search and their address."""
    s = searches.select("search_id", F.col("location").alias("__place"))
    j = leads.drop("distance_km").join(s, "search_id", "left")
    return j.withColumn("distance_km", location_distance_km("__place", "address")).drop("__place")
