"""Quality and verification scores, labels, progress and status."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from leadloom.functions.person import names_overlap
from leadloom.functions.text import col, filled, text_or_empty
from leadloom.functions.url import url_host

GENERIC_SHORT_NAME = "(business|company|enterprise|corporation|inc|llc)"


def _size(c: Column) -> Column:
    return F.coalesce(F.size(c), F.lit(0))


def _point(c: Column) -> Column:
    return F.when(c, 1).otherwise(0)


def quality_points(name: Column, website: Column, has_contact: Column, has_person: Column, has_more: Column) -> Column:
    n = F.lower(F.trim(text_or_empty(name)))
    host = url_host(website)
    good_name = (n != "") & ~(n.rlike(GENERIC_SHORT_NAME) & (F.length(n) < 20))
    good_site = host.isNotNull() & (host != "localhost") & ~host.contains("example.com")
    return (_point(good_name) + _point(good_site) + _point(has_contact) + _point(has_person)
            + _point(has_more)).cast("int")


def quality_score(lead: dict[str, Column] | None = None) -> Column:
    """0-5: name, site, e-mail or phone, named person, and address or socials or about text."""
    c = {k: F.col(k) for k in ("company_name", "website", "emails", "phones", "decision_makers", "address", "socials",
                               "about_text")} | (lead or {})
    person = F.exists(c["decision_makers"], lambda p: F.length(F.trim(text_or_empty(p["name"]))).between(1, 99))
    s = c["socials"]
    socials = filled(s["linkedin"]) | filled(s["twitter"]) | filled(s["facebook"]) | filled(s["instagram"])
    return quality_points(
        c["company_name"], c["website"], (_size(c["emails"]) > 0) | (_size(c["phones"]) > 0),
        F.coalesce(person, F.lit(False)),
        filled(c["address"]) | F.coalesce(socials, F.lit(False)) | (F.length(F.trim(text_or_empty(c["about_text"]))) > 20))


def quality_label(score: Column | str) -> Column:
    s = col(score)
    return F.when(s >= 5, "high").when(s >= 3, "medium").when(s >= 1, "low").otherwise("very_low")


def verification_label(score: Column | str) -> Column:
    s = col(score)
    return (F.when(s >= 5, "highly_verified").when(s >= 3, "verified").when(s >= 1, "partially_verified")
            .otherwise("unverified"))


def verification(lead: dict[str, Column] | None = None) -> Column:
    """struct(score 0-5, sources): name, company page, people, e-mail domain and further signals agree.

    Points are kept in integer tenths; half points round up.
    """
    c = {k: F.col(k) for k in (
        "company_name", "website", "emails", "decision_makers", "address", "socials", "industry", "company_size",
        "email_pattern", "linkedin_company_url", "contacts")} | (lead or {})
    name, page = text_or_empty(c["company_name"]), text_or_empty(c["linkedin_company_url"])
    host = F.coalesce(url_host(c["website"]), F.lit(""))
    people, contacts = _size(c["decision_makers"]), _size(c["contacts"])
    slug = F.substring(F.regexp_replace(F.lower(name), "[^a-z0-9]", ""), 1, 10)

    name_page = (name != "") & (page != "") & F.lower(page).contains(slug)
    name_site = (
        (name != "") & (page == "") & (host != "")
        & F.exists(F.split(F.lower(name), r"\s+"), lambda w: (F.length(w) > 3) & host.contains(w)))
    has_page = page != ""
    social = c["socials"]
    social_page = ~has_page & (text_or_empty(social["linkedin"]) != "")
    both = (people > 0) & (contacts > 0)
    people_match = both & F.coalesce(names_overlap(c["decision_makers"], c["contacts"]), F.lit(False))
    people_only = (people > 0) & ~(contacts > 0)
    pattern = text_or_empty(c["email_pattern"])
    pattern_hit = (host != "") & pattern.contains("@") & (F.regexp_extract(pattern, "@([^@]*)", 1) == host)
    mail_hit = (
        (host != "") & (pattern != "") & ~pattern.contains("@")
        & F.coalesce(F.exists(c["emails"], lambda e: F.regexp_extract(e["email"], "@([^@]*)", 1) == host), F.lit(False)))
    deliverable = F.coalesce(
        F.exists(c["emails"], lambda e: (e["deliverability"]["status"] == "valid") & (e["deliverability"]["score"] >= 80)),
        F.lit(False))
    social_count = sum(
        (F.when(text_or_empty(social[k]) != "", 1).otherwise(0) for k in ("linkedin", "twitter", "facebook", "instagram")),
        F.lit(0))
    extra = (
        F.when(~text_or_empty(c["industry"]).isin("", "unknown"), 3).otherwise(0)
        + F.when(~text_or_empty(c["company_size"]).isin("", "unknown"), 3).otherwise(0)
        + F.when(filled(c["address"]), 2).otherwise(0)
        + F.when(social_count >= 2, 2).otherwise(0)
        + F.when(deliverable, 2).otherwise(0))
    signals = [
        (name_page, 10, "company_name_match"), (name_site, 10, "website_name_match"),
        (has_page, 10, "linkedin_company_page"), (social_page, 10, "linkedin_social_link"),
        (people_match, 10, "decision_maker_match"), (people_only, 5, "website_decision_makers"),
        (pattern_hit, 10, "email_pattern_verified"), (mail_hit, 10, "email_domain_verified"),
        (deliverable, 0, "email_deliverability_verified"), (extra >= 7, 10, "additional_signals"),
    ]
    tenths = sum((F.when(cond, pts).otherwise(0) for cond, pts, _ in signals), F.lit(0))
    sources = F.array_compact(F.array(*[F.when(cond, F.lit(label)) for cond, _, label in signals]))
    score = F.least(F.lit(5), F.floor((tenths + 5) / 10)).cast("int")
    return F.struct(score.alias("score"), sources.alias("sources"))


def percent(part: Column, whole: Column, cap: int = 100) -> Column:
    """Share in percent against at least one, cut at ``cap``."""
    return F.least(part * 100.0 / F.greatest(F.coalesce(whole, F.lit(1)), F.lit(1)), F.lit(float(cap)))


def remaining_time_text(status: Column, total: Column, extracted: Column, enriched: Column) -> Column:
    """Text such as '~40 seconds' from 2.5 s per extraction and 6 s per enrichment."""
    def text(seconds: Column) -> Column:
        return F.when(seconds < 60, F.concat(F.lit("~"), F.ceil(seconds).cast("string"), F.lit(" seconds"))).otherwise(
            F.concat(F.lit("~"), F.ceil(seconds / 60).cast("string"), F.lit(" minutes")))

    return (
        F.when(status.isin("searching", "queued"), "Calculating...")
        .when((status == "extracting") & (extracted > 0) & (total > 0), text((total - extracted) * 2.5))
        .when((status == "enriching") & (enriched > 0) & (extracted > 0), text((extracted - enriched) * 6.0))
    )


def in_progress(status: Column, total: Column, extracted: Column, enriched: Column) -> Column:
    """Leads still being worked on in the current phase."""
    return (
        F.when(status == "extracting", F.greatest(F.lit(0), total - extracted))
        .when(status.isin("enriching", "processing_backfill"), F.greatest(F.lit(0), extracted - enriched))
        .otherwise(F.lit(0))
    )


def status_from_counts(total_results: Column, expanded: Column, extracted: Column, wanted: Column) -> Column:
    """completed for no results, fewer than twenty, or the wanted count reached; else processing_backfill."""
    return (
        F.when(F.coalesce(total_results, F.lit(0)) == 0, "completed")
        .when(expanded < 20, "completed")
        .when(extracted >= wanted, "completed")
        .otherwise("processing_backfill")
    )
