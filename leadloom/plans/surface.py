"""Queries written as SQL over the registered functions."""

from __future__ import annotations

from leadloom import refdata as R
from leadloom import sqlapi
from leadloom.plans import query
from leadloom.plans.sql import department, domain, ex, host, mail_score, normal_title, phone_country, phone_format, q, rx, seniority, with_views
from leadloom.sources.fixtures import table, view

_SCORE, _, _REASON = mail_score("email")
_COUNTRY = "CASE " + " ".join(f"WHEN {rx('coalesce(address, chr(0))', rf'(?i)\b({w})\b')} THEN {q(c)}" for c, w in R.ADDRESS_COUNTRIES) + " END"


@query(with_views(("v_leads",), f"""
SELECT lead_id, {domain('website')} AS domain, {host('website')} AS host, trim(regexp_replace(regexp_replace(trim(lower(company_name)), '\\s+', ' ', 'g'), '[^a-zA-Z0-9_\\s]', '', 'g')) AS company,
  {phone_format('phone', "'ng'")} AS phone, {phone_country(phone_format('phone', "'ng'"))} AS phone_country, CAST({_SCORE} AS INT) AS email_score, {_REASON} AS email_reason,
  {normal_title('title')} AS title, {seniority('title')} AS seniority, {department('title')} AS department, {_COUNTRY} AS country FROM v_leads"""))
def sql_lead_rules(spark, sf):
    sqlapi.register(spark)
    return spark.sql("""
        SELECT lead_id, bare_domain(website) AS domain, url_host(website) AS host, normalize_company(company_name) AS company,
               format_phone(phone, 'ng') AS phone, phone_country(format_phone(phone, 'ng')) AS phone_country, email_score(email) AS email_score,
               email_reason(email) AS email_reason, normalize_title(title) AS title, seniority(title) AS seniority,
               department(title) AS department, address_country(address) AS country
        FROM {leads}""", leads=view(spark, sf, "v_leads"))


_A = r"""(?is)<a\s[^>]*?href\s*=\s*["']([^"']*)["'][^>]*>(.*?)</a>"""
_LINKS = f"""SELECT page_id, url, {ex('a', _A)} AS href, trim(regexp_replace(regexp_replace({ex('a', _A, 2)}, '(?s)<[^>]*>', ' ', 'g'), '\\s+', ' ', 'g')) AS text
  FROM (SELECT page_id, url, unnest(regexp_extract_all(html, {q(_A)})) AS a FROM pages) x"""
_ABSOLUTE = f"""CASE WHEN {rx('href', '(?i)^https?://')} THEN href WHEN starts_with(href, '//') THEN 'https:' || href WHEN {rx('href', '^[a-zA-Z][a-zA-Z0-9+.-]*:')} THEN NULL
  WHEN starts_with(href, '/') THEN lower({ex('url', r'(?i)^\s*(https?://[^/?#]+)')}) || href ELSE lower({ex('url', r'(?i)^\s*(https?://[^/?#]+)')}) || '/' || href END"""


@query(f"""
WITH l AS ({_LINKS}), a AS (SELECT page_id, {host('url')} AS own, {host(_ABSOLUTE)} AS host, text FROM l),
m AS (SELECT host, 'page' AS kind, own <> host AS external, text FROM a UNION ALL SELECT {domain("'https://www.c' || CAST(o_custkey % 50 AS VARCHAR) || '.com/'")}, 'order', true, o_orderstatus FROM orders)
SELECT host, kind, count(*) AS mentions, count(*) FILTER (external) AS external, count(DISTINCT text) AS texts FROM m WHERE host IS NOT NULL GROUP BY host, kind""")
def sql_site_mentions(spark, sf):
    """Sites by what mentions them: anchors of pages, through the table function, and orders."""
    sqlapi.register(spark)
    return spark.sql("""
        WITH links AS (SELECT p.page_id, url_host(p.url) AS own, url_host(absolute_url(trim(l.href), p.url)) AS host, l.text
                       FROM {pages} p, LATERAL page_links(p.html) l),
        mentions AS (SELECT host, 'page' AS kind, own <> host AS external, text FROM links
                     UNION ALL SELECT bare_domain('https://www.c' || o_custkey % 50 || '.com/'), 'order', TRUE, o_orderstatus FROM {orders})
        SELECT host, kind, count(*) AS mentions, count_if(external) AS external, count(DISTINCT text) AS texts
        FROM mentions WHERE host IS NOT NULL GROUP BY host, kind""",
        pages=table(spark, sf, "pages").select("page_id", "url", "html"), orders=table(spark, sf, "orders").select("o_custkey", "o_orderstatus"))
