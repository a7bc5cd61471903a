"""Table schemas of the library."""

from __future__ import annotations

EMAIL = (
    "struct<email:string,source:string,confidence:double,"
    "deliverability:struct<score:int,status:string,reason:string,method:string>>"
)
PHONE = "struct<phone:string,country:string,formatted:string,source:string,confidence:double>"
PERSON = (
    "struct<name:string,title:string,normalized_title:string,seniority:string,department:string,email:string,"
    "source:string,confidence:double>"
)
SOCIALS = "struct<linkedin:string,twitter:string,facebook:string,instagram:string>"
LOCATION = "struct<city:string,state:string,country:string,formatted:string>"
HIRING = "struct<is_hiring:boolean,has_careers_page:boolean,has_job_postings:boolean>"
CONTACT = (
    "struct<name:string,title:string,normalized_title:string,seniority:string,department:string,relevance:int,"
    "suggested_email:string,profile_query:string,notes:string>"
)

SEARCH_RESULTS = (
    "search_id long, provider string, pos int, title string, link string, snippet string, phone string, "
    "address string, place_id string, is_place boolean"
)
PAGES = "page_id long, url string, html string"
LEADS = (
    "lead_id long, search_id long, raw_title string, raw_snippet string, raw_link string, company_name string, "
    f"website string, emails array<{EMAIL}>, phones array<{PHONE}>, whatsapp_links array<string>, address string, "
    f"socials {SOCIALS}, about_text string, category_signals array<string>, decision_makers array<{PERSON}>, "
    "quality_score int, distance_km double, extraction_status string, enrichment_status string, "
    "is_duplicate boolean, duplicate_of long, created_at timestamp"
)
ENRICHMENT = (
    "lead_id long, business_summary string, company_size string, employee_count int, employee_count_range string, "
    "revenue_bracket string, industry string, email_pattern string, contact_relevance int, signal_strength int, "
    f"founded_year int, location {LOCATION}, hiring {HIRING}, linkedin_company_url string, contacts array<{CONTACT}>, "
    "verification_score int, verification_sources array<string>"
)
SEARCHES = (
    "search_id long, user_id long, query string, country string, location string, industry string, "
    "result_count int, status string, priority int, total_results int, extracted_count int, enriched_count int, "
    "is_template boolean, template_name string, started_at timestamp, completed_at timestamp, created_at timestamp"
)
USERS = "user_id long, company_id long, email string, name string, role string, user_role string, created_at timestamp"
COMPANIES = (
    "company_id long, name string, normalized_name string, company_type string, share_searches boolean, "
    "share_leads boolean, share_templates boolean, credit_balance long, currency string, created_at timestamp"
)
LEDGER = (
    "company_id long, seq long, ts timestamp, delta int, reason string, search_id long, lead_id long, "
    "currency string, pack_id string"
)

EXTRACTION_STATUSES = ["pending", "extracting", "extracted", "failed"]
ENRICHMENT_STATUSES = ["pending", "enriching", "enriched", "failed", "skipped"]
SEARCH_STATUSES = [
    "pending", "queued", "searching", "extracting", "enriching", "processing_backfill", "completed", "failed",
]
WAITING_STATUSES = ["pending", "queued", "searching", "extracting", "enriching", "processing_backfill"]
RESULT_COUNTS = [50, 100, 200]
