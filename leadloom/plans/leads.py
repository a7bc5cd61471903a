"""Lead lists, scores, build and enrichment, exports."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, functions as F

from leadloom import refdata as R
from leadloom.functions.email import merge_emails
from leadloom.functions.score import (
    in_progress, percent, quality_label, quality_score, remaining_time_text, status_from_counts, verification, verification_label)
from leadloom.functions.url import bare_domain
from leadloom.operators import dedup, leads as LD, ledger, listing, pages as PG, people as PP
from leadloom.plans import ORACLES, query
from leadloom.plans.sql import LEAD_QUALITY, domain, host, mail_score, phone_format, with_views
from leadloom.session import checkpointed, new_folder, stored
from leadloom.sources import lead_fixture as L, tables
from leadloom.sources.fixtures import view

_SCORED = f"scored AS (SELECT l.*, {LEAD_QUALITY} AS quality_score FROM v_leads l)"
_ORDER = "quality_score DESC NULLS LAST, verification_score DESC NULLS LAST, signal_strength DESC NULLS LAST, lead_id"


def scored_leads(spark, sf):
    return L.leads(spark, sf, scored=True)


def _sort_columns(spark, sf):
    """What the lists of leads are sorted by, worked out once for all of them."""
    return stored(scored_leads(spark, sf).select("lead_id", "company_name", "created_at", "quality_score", "verification_score", "signal_strength"), "sorts")


@query(with_views(("v_leads",), f"""
SELECT lead_id, search_id, company_name, {domain('website')} AS domain, quality_score, verification_score, signal_strength FROM (
  SELECT *, row_number() OVER (PARTITION BY search_id, CASE WHEN {domain('website')} <> '' THEN {domain('website')} ELSE CAST(lead_id AS STRING) || '#' END ORDER BY created_date, lead_id) AS r FROM scored) a
WHERE r = 1 ORDER BY {_ORDER} LIMIT 50""", _SCORED))
def ranked_leads(spark, sf):
    """Canonical leads by quality, verification and signal: the best fifty."""
    leads = stored(scored_leads(spark, sf).select(
        "lead_id", "search_id", "company_name", "website", "created_at", "quality_score", "verification_score", "signal_strength"), "ranked")
    kept = dedup.first_by_domain(leads).filter("NOT is_duplicate")
    top = listing.page_of(kept, listing.lead_order(), 1, 50)
    return top.select("lead_id", "search_id", "company_name", "domain", "quality_score", "verification_score", "signal_strength")


@query(with_views(("v_leads",), f"""
SELECT lead_id, quality_score, CASE WHEN quality_score >= 5 THEN 'high' WHEN quality_score >= 3 THEN 'medium' WHEN quality_score >= 1 THEN 'low' ELSE 'very_low' END AS label FROM scored""", _SCORED))
def quality_scores(spark, sf):
    return scored_leads(spark, sf).select("lead_id", "quality_score", quality_label("quality_score").alias("label"))


_S, _ST, _ = mail_score("email")
_VERIFY = f"""v AS (SELECT *, {host('website')} AS h, lower(company_name) AS n, substr(regexp_replace(lower(company_name), '[^a-z0-9]', '', 'g'), 1, 10) AS slug,
  linkedin_company_url IS NOT NULL AS pg, lead_id % 10 = 0 AS li, title IS NOT NULL AS dm, lead_id % 3 = 0 AS ct,
  coalesce({_ST} = 'valid' AND {_S} >= 80, false) AS deliv FROM v_leads JOIN v_enrichment USING (lead_id)),
w AS (SELECT *, coalesce(pg AND contains(lower(linkedin_company_url), slug), false) AS s1,
  NOT pg AND h IS NOT NULL AND len([x FOR x IN string_split(n, ' ') IF length(x) > 3 AND contains(h, x)]) > 0 AS s2, NOT pg AND li AS s4, dm AND ct AS s5, dm AND NOT ct AS s6,
  coalesce(h IS NOT NULL AND contains(email_pattern, '@') AND string_split(email_pattern, '@')[2] = h, false) AS s7,
  coalesce(h IS NOT NULL AND NOT contains(email_pattern, '@') AND email IS NOT NULL AND string_split(email, '@')[2] = h, false) AS s8,
  (CASE WHEN coalesce(industry, 'unknown') <> 'unknown' THEN 3 ELSE 0 END) + (CASE WHEN company_size IS NOT NULL THEN 3 ELSE 0 END) + (CASE WHEN address IS NOT NULL THEN 2 ELSE 0 END)
   + (CASE WHEN lead_id % 30 = 0 THEN 2 ELSE 0 END) + (CASE WHEN deliv THEN 2 ELSE 0 END) AS extra FROM v)"""


@query(with_views(("v_leads", "v_enrichment"), """
SELECT lead_id, score, CASE WHEN score >= 5 THEN 'highly_verified' WHEN score >= 3 THEN 'verified' WHEN score >= 1 THEN 'partially_verified' ELSE 'unverified' END AS label, sources FROM (
SELECT lead_id, least(5, CAST(floor((10 * (CAST(s1 AS INT) + CAST(s2 AS INT) + CAST(pg AS INT) + CAST(s4 AS INT) + CAST(s5 AS INT) + CAST(s7 AS INT) + CAST(s8 AS INT) + CAST(extra >= 7 AS INT)) + 5 * CAST(s6 AS INT) + 5) / 10) AS INT)) AS score,
  concat_ws(',', CASE WHEN s1 THEN 'company_name_match' END, CASE WHEN s2 THEN 'website_name_match' END, CASE WHEN pg THEN 'linkedin_company_page' END, CASE WHEN s4 THEN 'linkedin_social_link' END,
   CASE WHEN s5 THEN 'decision_maker_match' END, CASE WHEN s6 THEN 'website_decision_makers' END, CASE WHEN s7 THEN 'email_pattern_verified' END, CASE WHEN s8 THEN 'email_domain_verified' END,
   CASE WHEN deliv THEN 'email_deliverability_verified' END, CASE WHEN extra >= 7 THEN 'additional_signals' END) AS sources FROM w) x""", _VERIFY))
def verification_scores(spark, sf):
    v = L.leads(spark, sf).select("lead_id", verification().alias("v"))
    return v.select("lead_id", "v.score", verification_label("v.score").alias("label"), F.array_join("v.sources", ",").alias("sources"))


_FULL = f"full_leads AS (SELECT s.*, lead_id % 17 = 0 AS is_duplicate, industry FROM scored s JOIN v_enrichment USING (lead_id))"


@query(with_views(("v_leads", "v_enrichment"), f"""
SELECT lead_id, search_id, company_name, quality_score FROM full_leads WHERE NOT is_duplicate AND signal_strength >= 30 AND starts_with(phone, '+234') AND contains(lower(industry), 'food')
ORDER BY {_ORDER} LIMIT 25 OFFSET 25""", _SCORED + ",\n" + _FULL))
def lead_filter_page(spark, sf):
    leads = listing.filter_leads(scored_leads(spark, sf), min_signal=30, country="ng", industry="FOOD")
    return listing.page_of(leads, listing.lead_order(), 2, 25).select("lead_id", "search_id", "company_name", "quality_score")


@query(with_views(("v_leads", "v_enrichment"), """
SELECT 2 AS page, 25 AS "limit", count(*) AS total, CAST(ceil(count(*) / 25) AS BIGINT) AS pages FROM full_leads WHERE NOT is_duplicate""", _SCORED + ",\n" + _FULL))
def lead_page_info(spark, sf):
    return listing.page_info(listing.filter_leads(L.leads(spark, sf)), 2, 25)


@query(with_views(("v_leads",), f"""
SELECT 'name' AS sort, lead_id FROM (SELECT lead_id FROM scored ORDER BY company_name, lead_id LIMIT 20) a
UNION ALL SELECT 'created', lead_id FROM (SELECT lead_id FROM scored ORDER BY created_date DESC, lead_id LIMIT 20) b
UNION ALL SELECT 'quality', lead_id FROM (SELECT lead_id FROM scored ORDER BY quality_score NULLS LAST, verification_score DESC NULLS LAST, signal_strength DESC NULLS LAST, lead_id LIMIT 20) c
UNION ALL SELECT 'signal', lead_id FROM (SELECT lead_id FROM scored ORDER BY signal_strength NULLS LAST, quality_score DESC NULLS LAST, verification_score DESC NULLS LAST, lead_id LIMIT 20) d""", _SCORED))
def lead_sorts(spark, sf):
    leads = _sort_columns(spark, sf)
    out = None
    for name, by, asc in (("name", "company_name", True), ("created", "created_at", False), ("quality", "quality_score", True), ("signal", "signal_strength", True)):
        top = listing.page_of(leads, listing.lead_order(by, asc), 1, 20).select(F.lit(name).alias("sort"), "lead_id")
        out = top if out is None else out.unionByName(top)
    return out


_VISIBLE = """visible AS (SELECT s.search_id FROM v_searches s JOIN v_users u ON u.user_id = s.user_id
  JOIN (SELECT u.user_id AS viewer, u.company_id, c.share_searches FROM v_users u JOIN v_companies c ON c.company_id = u.company_id WHERE u.user_id = {viewer}) v
  ON u.company_id = v.company_id AND (v.share_searches OR u.user_id = v.viewer))"""


@query(with_views(("v_leads", "v_searches", "v_users", "v_companies"), "SELECT lead_id FROM v_leads WHERE search_id IN (SELECT search_id FROM visible)", _VISIBLE.format(viewer=8)))
def visible_leads(spark, sf):
    """Leads seen from a company that shares."""
    return listing.visible_to(L.leads(spark, sf), 8, L.searches(spark, sf), L.users(spark, sf), L.companies(spark, sf), "share_leads").select("lead_id")


@query(with_views(("v_searches", "v_users", "v_companies"), """
SELECT search_id, query FROM (SELECT search_id, 'software companies in ' || coalesce(location, 'Accra') AS query, created_date FROM v_searches
  WHERE search_id IN (SELECT search_id FROM visible) AND search_id % 6 = 0) a""", _VISIBLE.format(viewer=8)))
def visible_templates(spark, sf):
    """Templates seen from a company that shares."""
    s = listing.templates(L.searches(spark, sf))
    return listing.visible_to(s, 8, L.searches(spark, sf), L.users(spark, sf), L.companies(spark, sf), "share_templates").select("search_id", "query")


@query(with_views(("v_searches",), """
SELECT search_id, status, total_results FROM v_searches ORDER BY created_date DESC, search_id DESC LIMIT 5"""))
def recent_searches(spark, sf):
    return listing.recent_searches(L.searches(spark, sf)).select("search_id", "status", "total_results")


@query(with_views(("v_users",), "SELECT user_id, role FROM v_users WHERE company_id = 3"))
def company_members(spark, sf):
    return listing.members(L.users(spark, sf), 3).select("user_id", "role")


@query(with_views(("v_leads",), "SELECT lead_id, company_name FROM v_leads WHERE lead_id IN (SELECT l_orderkey FROM lineitem WHERE l_quantity > 49)"))
def bulk_select(spark, sf):
    ids = spark.read.parquet(f"{sf}/lineitem.parquet").filter("l_quantity > 49").select(F.col("l_orderkey").alias("lead_id"))
    return listing.bulk_select(L.leads(spark, sf), ids).select("lead_id", "company_name")


@query(with_views(("v_searches",), """
SELECT 'today' AS period, count(*) FILTER (created_date >= DATE '2024-02-10') AS n FROM v_searches UNION ALL SELECT 'week', count(*) FILTER (created_date >= DATE '2024-02-03') FROM v_searches
UNION ALL SELECT 'month', count(*) FILTER (created_date >= DATE '2024-01-10') FROM v_searches UNION ALL SELECT 'range', count(*) FILTER (created_date BETWEEN DATE '2024-01-05' AND DATE '2024-01-07') FROM v_searches
UNION ALL SELECT 'all', count(*) FROM v_searches"""))
def period_counts(spark, sf):
    s, now = L.searches(spark, sf), F.to_timestamp(F.lit("2024-02-10"))
    out = None
    for p in ("today", "week", "month", "range", "all"):
        one = listing.period_filter(s, p, now, F.to_timestamp(F.lit("2024-01-05")), F.to_timestamp(F.lit("2024-01-07"))) if p == "range" else listing.period_filter(s, p, now)
        one = one.agg(F.lit(p).alias("period"), F.count(F.lit(1)).alias("n"))
        out = one if out is None else out.unionByName(one)
    return out


@query(with_views(("v_leads",), f"""
SELECT search_id, lead_id, lag(lead_id) OVER w AS previous_id, lead(lead_id) OVER w AS next_id, row_number() OVER w AS position, count(*) OVER (PARTITION BY search_id) AS total FROM scored
WINDOW w AS (PARTITION BY search_id ORDER BY {_ORDER})""", _SCORED))
def lead_neighbours(spark, sf):
    return listing.neighbours(scored_leads(spark, sf))


_BALANCE = """balances AS (SELECT company_id, sum(delta) - least(0, min(s)) AS balance FROM (SELECT *, sum(delta) OVER (PARTITION BY company_id ORDER BY seq) AS s FROM v_ledger) a GROUP BY company_id)"""


@query(with_views(("v_leads", "v_enrichment", "v_searches", "v_users", "v_ledger"), f"""
SELECT search_id, lead_id FROM (SELECT f.search_id, f.lead_id, coalesce(b.balance, 0) <= 3 AS limited, row_number() OVER (PARTITION BY f.search_id ORDER BY f.quality_score DESC NULLS LAST, f.verification_score DESC NULLS LAST, f.signal_strength DESC NULLS LAST, f.lead_id) AS r
  FROM full_leads f JOIN v_searches s ON s.search_id = f.search_id JOIN v_users u ON u.user_id = s.user_id LEFT JOIN balances b ON b.company_id = u.company_id WHERE NOT is_duplicate) x WHERE NOT limited OR r <= 10""",
    _SCORED + ",\n" + _FULL + ",\n" + _BALANCE))
def preview_cut(spark, sf):
    from leadloom.operators.ledger import balances

    b = balances(L.ledger(spark, sf)).withColumn("balance", F.col("balance") - 3)
    return listing.preview(scored_leads(spark, sf), L.searches(spark, sf), L.users(spark, sf), b).select("search_id", "lead_id")


def _export_input(spark, sf):
    return L.leads(spark, sf).withColumns({
        "business_summary": F.lit(""), "location": F.struct(*[F.lit(None).cast("string").alias(k) for k in ("city", "state", "country", "formatted")]),
        "hiring": F.struct(*[F.lit(None).cast("boolean").alias(k) for k in ("is_hiring", "has_careers_page", "has_job_postings")]),
        "employee_count_range": F.lit(None).cast("string"), "revenue_bracket": F.lit("unknown"), "founded_year": F.lit(None).cast("int"),
        "contact_relevance": F.lit(50), "quality_score": quality_score(), "distance_km": F.lit(None).cast("double")})


@query(with_views(("v_leads", "v_enrichment"), f"""
SELECT lead_id, company_name, coalesce(website, '') AS website, coalesce(email, '') AS primary_email, CASE WHEN email IS NULL THEN '' ELSE {_ST} END AS primary_email_status,
  CASE WHEN email IS NULL THEN '' WHEN {_S} = 0 THEN email || ' (' || {_ST} || ')' ELSE email || ' (' || {_ST} || ' ' || CAST({_S} AS STRING) || ')' END AS all_emails,
  coalesce(address, '') AS location, CASE WHEN title IS NULL THEN '' ELSE 'John Baker (' || title || ')' END AS all_people, CASE WHEN title IS NULL THEN 0 ELSE 1 END AS person_count,
  CASE WHEN lead_id % 3 = 0 THEN 'Jane Baker (Director)' ELSE '' END AS contacts, coalesce(industry, '') AS industry, CASE WHEN coalesce(employee_count, 0) = 0 THEN '' ELSE CAST(employee_count AS STRING) END AS employee_count,
  coalesce(signal_strength, 0) AS signal_strength, CASE WHEN coalesce(verification_score, 0) = 0 THEN '' ELSE CAST(verification_score AS STRING) END AS verification_score, CASE WHEN lead_id % 10 = 0 THEN 'https://linkedin.com/company/x' ELSE '' END AS linkedin
FROM (SELECT * FROM v_leads JOIN v_enrichment USING (lead_id) WHERE lead_id % 17 <> 0 ORDER BY signal_strength DESC NULLS LAST, lead_id LIMIT 10000) a"""))
def export_flat(spark, sf):
    return listing.export_leads(_export_input(spark, sf)).select(
        "lead_id", "company_name", "website", "primary_email", "primary_email_status", "all_emails", "location", "all_people", "person_count",
        "contacts", "industry", "employee_count", "signal_strength", "verification_score", "linkedin")


@query(with_views(("v_leads", "v_searches", "v_users"), """
SELECT lead_id FROM v_leads WHERE search_id NOT IN (SELECT s.search_id FROM v_searches s JOIN v_users o ON o.user_id = s.user_id, v_users v
  WHERE v.user_id = 5 AND s.search_id <= 200 AND (s.user_id = 5 OR (v.role = 'admin' AND o.company_id = v.company_id)))"""))
def delete_searches(spark, sf):
    """Leads left after an admin deletes the company's searches among the first two hundred."""
    doomed = tables.deletable_searches(L.searches(spark, sf), L.users(spark, sf), 5, list(range(201)))
    return tables.without_searches(L.leads(spark, sf), doomed).select("lead_id")


@query(with_views(("v_leads", "v_searches"), "SELECT l.lead_id, l.company_name, 'software companies in ' || coalesce(s.location, 'Accra') AS query FROM v_leads l JOIN v_searches s ON s.search_id = l.search_id WHERE l.lead_id = 42"))
def point_read(spark, sf):
    return tables.point_read(L.leads(spark, sf), L.searches(spark, sf), 42).select("lead_id", "company_name", "query")


# --- build and enrich ----------------------------------------------------------------------------

_PLACES = {c: (la, lo) for c, la, lo in R.CITY_COORDINATES if c in ("lagos", "nairobi", "london")}
_FROM_LAGOS = "CASE location " + " ".join(
    f"WHEN '{c.capitalize()}' THEN round(2 * 6371 * atan2(sqrt(h), sqrt(1 - h)), 1)".replace("h)", f"(pow(sin(radians({la} - {_PLACES['lagos'][0]}) / 2), 2) + cos(radians({la})) * cos(radians({_PLACES['lagos'][0]})) * pow(sin(radians({lo} - {_PLACES['lagos'][1]}) / 2), 2)))").replace("- h", "- ")
    for c, (la, lo) in _PLACES.items()) + " END"


@query(with_views(("v_site_pages", "v_searches"), f"""
SELECT page_id AS lead_id, page_id % 1500 AS search_id, 'C' || CAST(page_id AS VARCHAR) || ' Trading' AS company_name, 'https://www.c' || CAST(page_id AS VARCHAR) || '.com/' AS website,
  2 AS emails, 1 AS phones, 2 AS people, 5 AS quality_score, {_FROM_LAGOS} AS distance_km FROM v_site_pages JOIN v_searches ON search_id = page_id % 1500"""))
def build_leads(spark, sf):
    """Search results over the site pages, from raw HTML to scored leads."""
    pages = L.site_pages(spark, sf)
    base = pages.select((F.col("page_id") % 1500).alias("search_id"), F.col("page_id").alias("lead_id"), F.col("url").alias("link"))
    null = F.lit(None).cast("string")
    results = base.select(
        "lead_id", "search_id", F.lit("bing").alias("provider"), F.lit(0).alias("pos"), F.concat(F.lit("Site "), "lead_id", F.lit(" - Home")).alias("title"), "link",
        null.alias("snippet"), null.alias("phone"), null.alias("address"), null.alias("place_id"), F.lit(False).alias("is_place"),
        F.to_timestamp(F.lit("2024-01-01")).alias("created_at"))
    contacts, sites = checkpointed(PG.extract_contacts(pages)), checkpointed(PG.classify_sites(pages).select("url", "score"))
    leads = LD.build_leads(results, contacts, PP.site_people(pages), L.searches(spark, sf).withColumn("industry", F.lit(None).cast("string")),
                           sites)
    return leads.select("lead_id", "search_id", "company_name", "website", F.size("emails").alias("emails"), F.size("phones").alias("phones"),
                        F.size("decision_makers").alias("people"), "quality_score", "distance_km")


@query(with_views(("v_leads", "v_enrichment"), f"""
SELECT lead_id, coalesce(industry, 'unknown') AS industry, coalesce(company_size, 'unknown') AS company_size, coalesce(employee_count, CASE company_size WHEN 'micro' THEN 5 WHEN 'small' THEN 25 WHEN 'medium' THEN 125 WHEN 'large' THEN 500 END) AS employee_count,
  (CASE WHEN title IS NULL THEN 0 ELSE 1 END) + (CASE WHEN lead_id % 3 = 0 THEN 1 ELSE 0 END) AS people, (CASE WHEN email IS NULL THEN 0 ELSE 1 END) AS emails,
  CASE WHEN lead_id % 3 = 0 AND {host('website')} IS NOT NULL AND email_pattern IS NOT NULL THEN 'jane.baker@c' || CAST(lead_id % 40 AS STRING) || '.com' END AS contact_email, signal_strength
FROM (SELECT v.*, industry, company_size, email_pattern, employee_count FROM v_leads v JOIN v_enrichment USING (lead_id)) a"""))
def enrich_leads(spark, sf):
    leads = L.leads(spark, sf).drop("industry", "company_size", "email_pattern", "linkedin_company_url", "employee_count", "contacts", "verification_score")
    base = L.leads(spark, sf)
    null = F.lit(None).cast("string")
    enrichment = base.select(
        "lead_id", null.alias("business_summary"), "company_size", "employee_count", null.alias("employee_count_range"), null.alias("revenue_bracket"), "industry",
        "email_pattern", F.lit(None).cast("int").alias("contact_relevance"), F.lit(None).cast("int").alias("founded_year"), "linkedin_company_url", "contacts")
    enrichment = enrichment.withColumn("signal_strength", F.lit(None).cast("int"))
    out = LD.enrich_leads(leads, enrichment)
    contact = F.get(F.filter("decision_makers", lambda p: p["source"] == "linkedin"), F.lit(0))
    return out.select("lead_id", "industry", "company_size", "employee_count", F.size("decision_makers").alias("people"), F.size("emails").alias("emails"),
                      contact["email"].alias("contact_email"), "signal_strength")


@query(with_views(("v_leads",), """
SELECT lead_id FROM v_leads WHERE enrichment_status = 'enriched'"""))
def refundable_leads(spark, sf):
    return LD.refundable(L.leads(spark, sf)).select("lead_id")


_NAMED = """SELECT o_orderkey AS id, CASE o_orderkey % 6 WHEN 0 THEN 'ChIJ9TCVpbKNOxARdEJJj7-rgEE' WHEN 1 THEN 'Unknown Company' WHEN 2 THEN 'Acme' WHEN 3 THEN 'Real Name Ltd' WHEN 4 THEN '' END AS extracted,
  CASE o_orderkey % 4 WHEN 0 THEN 'Acme Trading - Lagos' ELSE 'Acme Trading ' || CAST(o_custkey AS STRING) END AS title, 'https://www.acme.com/x' AS link FROM orders"""


@query(f"""
SELECT id, CASE WHEN extracted = 'Real Name Ltd' THEN extracted WHEN extracted IN ('Unknown Company', 'Acme') AND id % 4 = 0 THEN extracted ELSE CASE WHEN id % 4 = 0 THEN 'Acme Trading' ELSE title END END AS name FROM ({_NAMED}) a""")
def lead_names(spark, sf):
    rows = spark.sql(_NAMED.replace("FROM orders", f"FROM parquet.`{sf}/orders.parquet`"))
    return rows.select("id", LD.lead_name(F.col("extracted"), F.col("title"), F.col("link")).alias("name"))


@query(with_views(("v_leads",), """
SELECT lead_id, CASE WHEN lead_id % 2 = 0 THEN 'site about' END AS about_text, CASE WHEN address IS NOT NULL THEN address WHEN lead_id % 2 = 0 THEN 'site address' END AS address,
  CASE WHEN lead_id % 2 = 0 THEN 'site@x.com' ELSE coalesce(email, '') END AS emails FROM v_leads"""))
def merged_extractions(spark, sf):
    base = L.leads(spark, sf)
    mail = base.schema["emails"].dataType.elementType.simpleString()
    site = base.filter("lead_id % 2 = 0").select(
        "lead_id", "decision_makers", F.array(F.from_json(F.lit('{"email": "site@x.com"}'), mail)).alias("emails"), "phones", F.lit("site address").alias("address"),
        F.lit("site about").alias("about_text"), "category_signals", "socials")
    out = LD.merge_extractions(base, site)
    return out.select("lead_id", "about_text", "address", F.array_join(F.transform("emails", lambda m: m["email"]), ";").alias("emails"))


@query(with_views(("v_searches",), """
SELECT search_id, least(extracted * 100.0 / greatest(total_results, 1), 95) AS progress, CASE status WHEN 'extracting' THEN greatest(0, total_results - extracted) WHEN 'enriching' THEN greatest(0, extracted - enriched) ELSE 0 END AS working,
  CASE WHEN status = 'searching' THEN 'Calculating...' WHEN status = 'extracting' AND extracted > 0 AND total_results > 0 THEN CASE WHEN (total_results - extracted) * 2.5 < 60 THEN '~' || CAST(CAST(ceil((total_results - extracted) * 2.5) AS BIGINT) AS STRING) || ' seconds'
    ELSE '~' || CAST(CAST(ceil((total_results - extracted) * 2.5 / 60) AS BIGINT) AS STRING) || ' minutes' END
   WHEN status = 'enriching' AND enriched > 0 AND extracted > 0 THEN CASE WHEN (extracted - enriched) * 6 < 60 THEN '~' || CAST((extracted - enriched) * 6 AS STRING) || ' seconds' ELSE '~' || CAST(CAST(ceil((extracted - enriched) * 6.0 / 60) AS BIGINT) AS STRING) || ' minutes' END END AS remaining,
  CASE WHEN total_results = 0 THEN 'completed' WHEN total_results < 20 THEN 'completed' WHEN extracted >= 30 THEN 'completed' ELSE 'processing_backfill' END AS next_status
FROM (SELECT search_id, total_results, CASE search_id % 3 WHEN 0 THEN 'searching' WHEN 1 THEN 'extracting' ELSE 'enriching' END AS status, CAST(total_results * 2 / 3 AS INT) AS extracted, CAST(total_results / 4 AS INT) AS enriched FROM v_searches) a"""))
def search_progress(spark, sf):
    c = F.col
    s = view(spark, sf, "v_searches").select(
        "search_id", "total_results", F.when(c("search_id") % 3 == 0, "searching").when(c("search_id") % 3 == 1, "extracting").otherwise("enriching").alias("status"),
        F.round(c("total_results") * 2 / 3).cast("int").alias("extracted"), F.bround(c("total_results") / 4).cast("int").alias("enriched"))
    args = (c("status"), c("total_results"), c("extracted"), c("enriched"))
    return s.select("search_id", percent(c("extracted"), c("total_results"), 95).alias("progress"), in_progress(*args).alias("working"),
                    remaining_time_text(*args).alias("remaining"), status_from_counts(c("total_results"), c("total_results"), c("extracted"), F.lit(30)).alias("next_status"))


@query(ORACLES["mark_duplicates"].replace("SELECT lead_id, dup IS NOT NULL AS is_duplicate, dup AS duplicate_of FROM fold", f"""SELECT l.lead_id, l.search_id, {domain('website')} AS domain, {LEAD_QUALITY} AS quality_score,
  row_number() OVER (PARTITION BY l.search_id ORDER BY {LEAD_QUALITY} DESC, coalesce(verification_score, -1) DESC, coalesce(signal_strength, -1) DESC, l.lead_id) AS rank FROM v_leads l JOIN (SELECT lead_id AS id, dup FROM fold) f ON id = lead_id WHERE dup IS NULL"""))
def lead_batch_job(spark, sf):
    """Score, mark duplicates and rank within each search: the whole batch path on lead rows."""
    leads = stored(scored_leads(spark, sf).select(
        "lead_id", "search_id", "company_name", "website", "created_at", "quality_score", "verification_score", "signal_strength"), "batch")
    marked = dedup.mark_duplicates(leads)
    ranked = listing.ranked_within_search(marked.filter("NOT is_duplicate"))
    return ranked.select("lead_id", "search_id", bare_domain("website").alias("domain"), "quality_score", "rank")




@query(with_views(("v_leads", "v_searches", "v_users", "v_companies"), """
SELECT l.lead_id, s.status, u.role, c.currency FROM v_leads l LEFT JOIN v_searches s ON s.search_id = l.search_id LEFT JOIN v_users u ON u.user_id = s.user_id LEFT JOIN v_companies c ON c.company_id = u.company_id"""))
def lead_parents(spark, sf):
    """Search, user and company of each lead."""
    return tables.with_parents(L.leads(spark, sf).select("lead_id", "search_id"), L.searches(spark, sf), L.users(spark, sf), L.companies(spark, sf)).select(
        "lead_id", "status", "role", "currency")


_DEEP = [("rank", False, 40), ("quality_score", True, 25), ("signal_strength", True, 30), ("created_at", False, 33), ("company_name", True, 20), ("rank", False, 100_000)]
_DEEP_ORDER = {"rank": "quality_score DESC NULLS LAST, verification_score DESC NULLS LAST, signal_strength DESC NULLS LAST, lead_id",
               "quality_score": "quality_score NULLS LAST, verification_score DESC NULLS LAST, signal_strength DESC NULLS LAST, lead_id",
               "signal_strength": "signal_strength NULLS LAST, quality_score DESC NULLS LAST, verification_score DESC NULLS LAST, lead_id",
               "created_at": "created_date DESC, lead_id", "company_name": "company_name, lead_id"}


@query(with_views(("v_leads",), " UNION ALL ".join(
    f"SELECT '{by}' AS sort, {page} AS page, lead_id FROM (SELECT lead_id FROM scored ORDER BY {_DEEP_ORDER[by]} LIMIT 25 OFFSET {(page - 1) * 25}) d{i}" for i, (by, _, page) in enumerate(_DEEP)), _SCORED))
def deep_pages(spark, sf):
    """Pages far down each list, found by counts per range."""
    leads = _sort_columns(spark, sf)
    pages = [listing.deep_page(leads, by, ascending, page, 25).select(F.lit(by).alias("sort"), F.lit(page).alias("page"), "lead_id") for by, ascending, page in _DEEP]
    return reduce(DataFrame.unionByName, pages)


@query(with_views(("v_leads",), """
SELECT search_id, lead_id, CASE WHEN again THEN upper(company_name) ELSE company_name END AS company_name FROM (
  SELECT *, search_id % 3 = 0 AND count(*) FILTER (lead_id % 2 = 0) OVER (PARTITION BY search_id) > 0 AS again FROM v_leads) a
WHERE search_id % 5 <> 0 AND (NOT again OR lead_id % 2 = 0)"""))
def lead_table(spark, sf):
    """Written, replaced for a third of the searches, deleted for a fifth, and read back."""
    root, ddl = new_folder(spark, "lead-table"), "lead_id long, search_id long, company_name string"
    leads = view(spark, sf, "v_leads").select("lead_id", "search_id", "company_name")
    tables.commit_leads(leads, root)
    tables.commit_leads(leads.filter("search_id % 3 = 0 AND lead_id % 2 = 0").withColumn("company_name", F.upper("company_name")), root)
    tables.delete_leads(spark, leads.filter("search_id % 5 = 0"), root)
    return tables.read_leads(spark, root, ddl).select("search_id", "lead_id", "company_name")


# --- each gate of a lead decides a row ------------------------------------------------------------

_GATED = """SELECT s_suppkey AS lead_id, s_suppkey % 7 AS search_id, 'Acme Foods ' || CAST(s_suppkey AS STRING) || CASE WHEN s_suppkey % 12 = 8 THEN '' ELSE ' - Home' END AS raw, s_suppkey % 12 AS k,
  CASE s_suppkey % 12 WHEN 0 THEN 'places:p' || CAST(s_suppkey AS STRING) WHEN 1 THEN 'https://www.facebook.com/acme' || CAST(s_suppkey AS STRING) WHEN 2 THEN 'https://www.yellowpages.com/acme' || CAST(s_suppkey AS STRING)
    WHEN 4 THEN 'places:q' || CAST(s_suppkey AS STRING) WHEN 6 THEN 'https://example.com/' || CAST(s_suppkey AS STRING) WHEN 7 THEN 'https://www.google.com/search?q=acme' || CAST(s_suppkey AS STRING)
    ELSE 'https://acme' || CAST(s_suppkey AS STRING) || '.com/' END AS link,
  CASE WHEN s_suppkey % 12 IN (0, 7) THEN '0803 123 4567' END AS phone, CASE WHEN s_suppkey % 12 = 6 THEN '12 Marina, Lagos' END AS address FROM supplier"""


@query(f"""
WITH g AS ({_GATED})
SELECT lead_id, 'Acme Foods ' || CAST(lead_id AS VARCHAR) AS company_name, CASE WHEN k IN (0, 6, 7) THEN NULL ELSE link END AS website, CAST(CASE WHEN k IN (0, 7) THEN 1 ELSE 0 END AS INT) AS phones, address
FROM g WHERE k NOT IN (1, 2, 4, 5, 9)""")
def lead_gates(spark, sf):
    """Results of which a social profile, a directory, a place without data, a generic name and a site that scores as a
    list are left out, and links that are no site leave a lead without one."""
    rows = spark.sql(_GATED.replace("FROM supplier", f"FROM parquet.`{sf}/supplier.parquet`"))
    null = F.lit(None).cast("string")
    results = rows.select(
        "lead_id", "search_id", F.lit("bing").alias("provider"), F.lit(0).alias("pos"), F.when(F.col("k") == 5, "Home").otherwise(F.col("raw")).alias("title"), "link",
        null.alias("snippet"), "phone", "address", null.alias("place_id"), (F.col("k") == 0).alias("is_place"), F.to_timestamp(F.lit("2024-01-01")).alias("created_at"))
    pages = L.site_pages(spark, sf).limit(0)
    sites = rows.select(F.col("link").alias("url"), F.when(F.col("k") == 9, -3).otherwise(-2).alias("score"))
    searches = spark.range(7).select(F.col("id").alias("search_id"), F.lit("acme").alias("query"), F.lit("ng").alias("country"), F.lit("Lagos").alias("location"), null.alias("industry"))
    leads = LD.build_leads(results, PG.extract_contacts(pages), PP.site_people(pages), searches, sites)
    return leads.select("lead_id", "company_name", "website", F.size("phones").alias("phones"), "address")


@query("""
SELECT o_orderkey AS lead_id, CASE o_orderkey % 4 WHEN 0 THEN 'info@a.com:0.8,jane@a.com:0.9' WHEN 1 THEN 'Jane@A.com:0.8' WHEN 2 THEN 'jane@a.com:0.9' ELSE 'info@a.com:0.8' END AS emails FROM orders""")
def merged_emails(spark, sf):
    """Addresses of pages and of people, each once whatever its case."""
    o = spark.read.parquet(f"{sf}/orders.parquet").select(F.col("o_orderkey").alias("lead_id"), (F.col("o_orderkey") % 4).alias("k"))
    mail = lambda e: F.struct(F.lit(e).alias("email"), F.lit("website").alias("source"), F.lit(0.8).alias("confidence"))
    one = F.struct(F.lit("Jane Baker").alias("name"), F.lit("CEO").alias("title"), F.when(F.col("k") == 3, "no address").otherwise("JANE@a.com").alias("email"), F.lit("x").alias("source"), F.lit(0.5).alias("confidence"))
    found = F.when(F.col("k").isin(0, 3), F.array(mail("info@a.com"))).when(F.col("k") == 1, F.array(mail("Jane@A.com")))
    merged = o.select("lead_id", merge_emails(found, F.array(one)).alias("m"))
    return merged.select("lead_id", F.array_join(F.transform("m", lambda e: F.concat(e["email"], F.lit(":"), e["confidence"].cast("string"))), ",").alias("emails"))


_PHONE = phone_format("phone")


@query(with_views(("v_leads", "v_enrichment"), f"""
SELECT CAST(lead_id AS VARCHAR) AS lead_id, CASE WHEN email IS NULL OR {_S} = 0 THEN '' ELSE CAST({_S} AS VARCHAR) END AS primary_email_score, CASE WHEN phone IS NULL THEN '' ELSE {_PHONE} END AS primary_phone,
  CASE WHEN phone IS NULL THEN '' ELSE {_PHONE} END AS all_phones, coalesce(address, '') AS location_formatted, CASE WHEN title IS NULL THEN '' ELSE 'John Baker' END AS person_name, coalesce(title, '') AS person_title,
  CASE WHEN title IS NULL THEN '' ELSE 'website' END AS person_source, CASE WHEN title IS NULL THEN '' ELSE '1%' END AS person_confidence, CASE WHEN lead_id % 3 = 0 THEN '1' ELSE '0' END AS contact_count,
  coalesce(linkedin_company_url, '') AS linkedin_company_url, coalesce(company_size, '') AS company_size, 'unknown' AS revenue_bracket, coalesce(email_pattern, '') AS email_pattern, '50' AS contact_relevance,
  CASE WHEN {LEAD_QUALITY} = 0 THEN '' ELSE CAST({LEAD_QUALITY} AS VARCHAR) END AS quality_score, CASE WHEN lead_id % 15 = 0 THEN 'https://x.com/x' ELSE '' END AS twitter, '' AS empty
FROM (SELECT * FROM v_leads JOIN v_enrichment USING (lead_id) WHERE lead_id % 17 <> 0 ORDER BY signal_strength DESC NULLS LAST, lead_id LIMIT 10000) a"""))
def export_csv(spark, sf):
    """The other columns of the flat export, written as CSV and read again."""
    path = new_folder(spark, "export")
    tables.write_csv(listing.export_leads(_export_input(spark, sf)), path)
    rows = spark.read.option("header", True).csv(path).na.fill("")
    none = ["about", "whatsapp", "all_whatsapp", "location_city", "location_state", "location_country", "person_email", "founded_year", "facebook", "instagram", "distance_km", "category_signals"]
    return rows.select("lead_id", "primary_email_score", "primary_phone", "all_phones", "location_formatted", "person_name", "person_title", "person_source", "person_confidence",
                       "contact_count", "linkedin_company_url", "company_size", "revenue_bracket", "email_pattern", "contact_relevance", "quality_score", "twitter", F.concat(*none).alias("empty"))


@query(with_views(("v_leads", "v_searches", "v_users"), """
SELECT u.company_id, lead_id, 1 AS delta, 'refund_invalid' AS reason FROM v_leads l JOIN v_searches s ON s.search_id = l.search_id JOIN v_users u ON u.user_id = s.user_id
WHERE enrichment_status = 'enriched' AND (title IS NULL OR lead_id % 3 <> 0)"""))
def refund_ledger(spark, sf):
    """Credits of leads without a person that can be reached, appended to the ledger and read from it."""
    root = new_folder(spark, "ledger")
    made = F.transform("decision_makers", lambda p: p.withField("email", F.when(F.col("lead_id") % 3 == 0, "john.baker@c.com").otherwise("")))
    owed = LD.refundable(L.leads(spark, sf).withColumn("decision_makers", made)).select("lead_id", "search_id")
    owners = L.searches(spark, sf).select("search_id", "user_id").join(L.users(spark, sf).select("user_id", "company_id"), "user_id")
    rows = owed.join(owners, "search_id").withColumns({"seq": F.col("lead_id") + 10_000_000, "ts": F.to_timestamp(F.lit("2024-02-01")), "currency": F.lit("usd")})
    null = F.lit(None)
    old = L.ledger(spark, sf).select("company_id", "seq", F.col("ts").cast("timestamp").alias("ts"), F.col("delta").cast("int").alias("delta"), "reason", null.cast("long").alias("search_id"),
                                     null.cast("long").alias("lead_id"), null.cast("string").alias("currency"), "pack_id")
    tables.append_ledger(old, root)
    tables.append_ledger(ledger.refund_entries(rows), root)
    return tables.scan(spark, root, "ledger").filter("lead_id IS NOT NULL").select("company_id", "lead_id", "delta", "reason")
