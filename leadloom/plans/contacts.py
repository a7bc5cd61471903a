"""E-mails, phones, titles and places of leads and pages."""

from __future__ import annotations

from pyspark.sql import functions as F

from leadloom import refdata as R
from leadloom.functions import email as M, location as G, phone as P, title as T
from leadloom.functions.person import drop_noise, drop_placeholders, drop_unvalidated, is_department_name, is_person_name, is_search_person_name
from leadloom.operators import pages, patterns
from leadloom.operators.leads import with_distance
from leadloom.plans import query
from leadloom.plans.sql import department, e, ex, host, mail_score, normal_title, phone_country, phone_format, q, rx, seniority, with_views
from leadloom.sources import lead_fixture as L
from leadloom.sources.fixtures import table, view

_SCORE, _STATUS, _REASON = mail_score("email")


@query(with_views(("v_leads",), f"SELECT lead_id, {_SCORE} AS score, {_STATUS} AS status, {_REASON} AS reason FROM v_leads"))
def email_scores(spark, sf):
    v = view(spark, sf, "v_leads").select("lead_id", M.syntax_check("email").alias("v"))
    return v.select("lead_id", "v.score", "v.status", "v.reason")


@query(with_views(("v_leads",), f"SELECT {_STATUS} AS status, count(*) AS n FROM v_leads WHERE email IS NOT NULL GROUP BY 1"))
def email_status_counts(spark, sf):
    return patterns.deliverability_summary(view(spark, sf, "v_leads").filter("email IS NOT NULL"))


_HOLDER = " OR ".join([f"starts_with(lower(m), {q(w + '@')})" for w in R.FORMAT_PLACEHOLDER_MAILBOXES]
                      + [f"contains(lower(m), {q('@' + w + '.')})" for w in R.FORMAT_PLACEHOLDER_HOSTS])
_MAILS = """SELECT lead_id AS id, CASE WHEN lead_id % 3 = 0 THEN upper(email) WHEN lead_id % 7 = 0 THEN 'user@test.io' WHEN lead_id % 11 = 0 THEN 'bob@tempmail.com' ELSE email END AS m FROM v_leads"""


@query(with_views(("v_leads",), f"""
SELECT id, reason = 'Format valid' AS valid, reason, m IS NOT NULL AND NOT {rx(f'lower({e("m")})', 'noreply|no-reply|donotreply|example[.]com')} AS business FROM (
  SELECT id, m, CASE WHEN {e('m')} = '' THEN 'Invalid input' WHEN NOT {rx('m', '^[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+[.][A-Z|a-z]{2,}$')} THEN 'Invalid email format'
   WHEN {_HOLDER} THEN 'Placeholder email pattern detected' WHEN list_contains({R.FORMAT_DISPOSABLE_DOMAINS!r}, lower(string_split(m, '@')[2])) THEN 'Disposable email domain' ELSE 'Format valid' END AS reason
  FROM ({_MAILS}) a) b"""))
def email_format(spark, sf):
    c = F.col
    m = (F.when(c("lead_id") % 3 == 0, F.upper("email")).when(c("lead_id") % 7 == 0, "user@test.io")
         .when(c("lead_id") % 11 == 0, "bob@tempmail.com").otherwise(c("email")))
    v = view(spark, sf, "v_leads").select(c("lead_id").alias("id"), m.alias("m"))
    return v.select("id", "m", M.format_check("m").alias("v")).select("id", "v.valid", "v.reason", M.is_business_email("m").alias("business"))


@query(with_views(("v_leads",), f"""
SELECT status, coalesce(kept, 0) AS kept, n FROM (SELECT {_STATUS} AS status, sum(CASE WHEN {_SCORE} >= 50 AND {_STATUS} <> 'invalid' THEN 1 ELSE 0 END) AS kept, count(*) AS n
FROM v_leads WHERE email IS NOT NULL GROUP BY 1) a"""))
def deliverable_counts(spark, sf):
    one = L.leads(spark, sf).select("emails", M.deliverable("emails").alias("kept"))
    rows = one.select(F.explode("emails").alias("m"), F.size("kept").alias("k"))
    return rows.groupBy(F.col("m.deliverability.status").alias("status")).agg(F.sum("k").alias("kept"), F.count(F.lit(1)).alias("n"))


_FORMATTED = phone_format("phone", "c")


@query(with_views(("v_leads",), f"""
SELECT lead_id, f AS formatted, CASE WHEN {phone_country('f')} = 'US' AND c = 'ca' THEN 'CA' ELSE {phone_country('f')} END AS country, sane FROM (
  SELECT lead_id, c, {_FORMATTED} AS f, length(regexp_replace({e('phone')}, '\\D', '', 'g')) >= 10 AS sane
  FROM (SELECT *, CASE lead_id % 4 WHEN 0 THEN 'us' WHEN 1 THEN 'ng' WHEN 2 THEN 'ca' END AS c FROM v_leads WHERE phone IS NOT NULL) a) b"""))
def phone_formats(spark, sf):
    k = F.col("lead_id") % 4
    v = view(spark, sf, "v_leads").filter("phone IS NOT NULL").withColumn("c", F.when(k == 0, "us").when(k == 1, "ng").when(k == 2, "ca"))
    f = P.format_phone("phone", "c")
    return v.select("lead_id", f.alias("formatted"), P.phone_country(f, "c").alias("country"), P.is_sane_phone("phone").alias("sane"))


_TEXTS = """SELECT s_suppkey AS page_id, 'https://www.c' || CAST(s_suppkey AS STRING) || CASE s_suppkey % 3 WHEN 0 THEN '.co.ke' WHEN 1 THEN '.com' ELSE '.com.ng' END || '/' AS url,
  '<script>var x = 5551234567890;</script><p>Phone: ' || CASE s_suppkey % 4 WHEN 0 THEN '+254 712 345 6' WHEN 1 THEN '(212) 555-01' WHEN 2 THEN '0803 123 45' ELSE '2125550' END
  || CAST(10 + s_suppkey % 89 AS STRING) || '</p><a href="tel:+44207946' || CAST(1000 + s_suppkey % 9000 AS STRING) || '">t</a>' AS html FROM supplier"""


@query(f"""
SELECT page_id, phone, {phone_country('phone')} AS country, CASE WHEN contains(tel, d) THEN 0.9 ELSE 0.7 END AS confidence FROM (
  SELECT page_id, tel, d, {phone_format('d', 'c')} AS phone FROM (
    SELECT *, '+44207946' || CAST(1000 + page_id % 9000 AS STRING) AS tel, CASE page_id % 3 WHEN 0 THEN 'ke' WHEN 2 THEN 'ng' END AS c FROM (
      SELECT s_suppkey AS page_id, '+44207946' || CAST(1000 + s_suppkey % 9000 AS STRING) AS d FROM supplier
      UNION ALL SELECT s_suppkey, CASE s_suppkey % 4 WHEN 0 THEN '+2547123456' WHEN 1 THEN '21255501' ELSE '2125550' END || CAST(10 + s_suppkey % 89 AS STRING) FROM supplier WHERE s_suppkey % 4 IN (0, 1)) a
    ) b WHERE length(d) BETWEEN 10 AND 15) c""")
def phone_extract(spark, sf):
    t = spark.sql(_TEXTS.replace("FROM supplier", f"FROM parquet.`{sf}/supplier.parquet`"))
    rows = t.select("page_id", F.explode(P.extract_phones("html", "url")).alias("p"))
    return rows.select("page_id", "p.phone", "p.country", "p.confidence")


_MAIL = "[a-zA-Z0-9._%+-]+@[a-zA-Z0-9.-]+[.][a-zA-Z]{2,}"


@query(f"""
SELECT DISTINCT doc_id, lower(m) AS email, 'website' AS source, 0.8 AS confidence FROM (
  SELECT doc_id, unnest(regexp_extract_all(text, '{_MAIL}')) AS m FROM documents) a
WHERE length(m) BETWEEN 6 AND 99 AND NOT {rx('lower(m)', 'test@|placeholder|your-email|email@|sample@|demo@|noreply@|no-reply@|@(localhost|127[.]0[.]0[.]1|test|placeholder)')}""")
def document_emails(spark, sf):
    d = table(spark, sf, "documents").select("doc_id", F.explode(pages.page_emails("text", ("example",))).alias("m"))
    return d.select("doc_id", "m.email", "m.source", "m.confidence")


@query(with_views(("v_site_pages",), """
SELECT page_id, 'jane.smith@c' || CAST(page_id AS STRING) || '.com' AS email, 'mailto_link' AS source, 0.95 AS confidence FROM v_site_pages
UNION ALL SELECT page_id, 'sales@c' || CAST(page_id AS STRING) || '.com', 'website', 0.8 FROM v_site_pages"""))
def page_emails(spark, sf):
    rows = L.site_pages(spark, sf).select("page_id", F.explode(pages.page_emails("html")).alias("m"))
    return rows.select("page_id", "m.email", "m.source", "m.confidence")


_SHAPED = """mails AS (SELECT lead_id, 'c' || CAST(k AS STRING) || '.com' AS domain, CASE k % 4 WHEN 0 THEN 'jane' WHEN 1 THEN 'j' WHEN 2 THEN 'jane' ELSE 'josephine' END
  || CASE WHEN lead_id % 5 = 0 THEN '' WHEN k % 3 = 0 THEN '-smith' WHEN k % 3 = 1 THEN '.s' ELSE '_smith' END || '@c.com' AS email FROM v_leads)"""


def _shaped(spark, sf):
    k = F.col("k")
    first = F.when(k % 4 == 0, "jane").when(k % 4 == 1, "j").when(k % 4 == 2, "jane").otherwise("josephine")
    rest = F.when(F.col("lead_id") % 5 == 0, "").when(k % 3 == 0, "-smith").when(k % 3 == 1, ".s").otherwise("_smith")
    return view(spark, sf, "v_leads").select(
        "lead_id", F.concat(F.lit("c"), k.cast("string"), F.lit(".com")).alias("domain"), F.concat(first, rest, F.lit("@c.com")).alias("email"))


_PATTERN = """shapes AS (SELECT domain, CASE len(p) WHEN 2 THEN (CASE WHEN length(p[1]) > 1 THEN 'first' ELSE 'firstInitial' END) || '.' || (CASE WHEN length(p[2]) > 1 THEN 'last' ELSE 'lastInitial' END)
    WHEN 1 THEN CASE WHEN length(local) < 5 THEN 'first' ELSE 'last' END END AS shape,
    CASE WHEN len(p) = 2 THEN CASE WHEN contains(local, '-') THEN '-' WHEN contains(local, '_') THEN '_' ELSE '.' END END AS sep
  FROM (SELECT domain, local, regexp_split_to_array(local, '[._-]') AS p FROM (SELECT domain, string_split(email, '@')[1] AS local FROM mails) a) b),
patterns AS (SELECT s.domain, shape, n, emails, CASE WHEN h > d THEN '-' WHEN u > d THEN '_' ELSE '.' END AS separator FROM (
    SELECT *, row_number() OVER (PARTITION BY domain ORDER BY n DESC, list_position(['first.last', 'first.lastInitial', 'firstInitial.last', 'firstInitial.lastInitial', 'first', 'last'], shape)) AS r
    FROM (SELECT domain, shape, count(*) AS n FROM shapes WHERE shape IS NOT NULL GROUP BY ALL) a) s
  JOIN (SELECT domain, count(*) AS emails, count(*) FILTER (sep = '-') AS h, count(*) FILTER (sep = '_') AS u, count(*) FILTER (sep = '.') AS d FROM shapes GROUP BY domain) t ON t.domain = s.domain WHERE r = 1)"""


@query(with_views(("v_leads",), """
SELECT domain, shape, separator, n / emails AS confidence, n AS sample_count, replace(shape, '.', separator) AS format FROM patterns""", _SHAPED + ",\n" + _PATTERN))
def email_pattern_by_domain(spark, sf):
    return patterns.discover_patterns(_shaped(spark, sf))


@query(with_views(("v_leads",), """
SELECT lead_id, l.domain, name, CASE WHEN given IS NOT NULL THEN given WHEN two THEN (CASE shape WHEN 'first' THEN f WHEN 'last' THEN la WHEN 'first.lastInitial' THEN f || separator || la[1]
    WHEN 'firstInitial.last' THEN f[1] || separator || la WHEN 'firstInitial.lastInitial' THEN f[1] || separator || la[1] ELSE f || separator || la END) || '@' || l.domain END AS email,
  CASE WHEN given IS NULL AND two THEN 'pattern_generated' END AS email_source, CASE WHEN given IS NULL AND two THEN round(n / emails * 0.8, 6) END AS email_confidence
FROM (SELECT lead_id, domain, CASE WHEN lead_id % 9 = 0 THEN email END AS given, CASE WHEN lead_id % 13 = 0 THEN 'Madonna' ELSE 'Mary Q Stone' END AS name, lead_id % 13 <> 0 AS two, 'mary' AS f, 'stone' AS la FROM mails) l
LEFT JOIN patterns p ON p.domain = l.domain""", _SHAPED + ",\n" + _PATTERN))
def generated_emails(spark, sf):
    m = _shaped(spark, sf)
    people = m.select("lead_id", "domain", F.when(F.col("lead_id") % 13 == 0, "Madonna").otherwise("Mary Q Stone").alias("name"),
                      F.when(F.col("lead_id") % 9 == 0, F.col("email")).alias("email"))
    return patterns.generate_emails(people, patterns.discover_patterns(m))


@query(with_views(("v_leads", "v_enrichment"), f"""
SELECT lead_id, CASE WHEN t NOT LIKE '%@%' AND {host('website')} IS NULL THEN NULL WHEN {host('website')} IS NULL THEN NULL WHEN lead_id % 4 IN (2, 3) THEN NULL WHEN t LIKE '%@%' THEN t ELSE t || '@' || {host('website')} END AS email,
   CASE WHEN NOT regexp_matches(replace(replace(replace(replace(raw, '{{firstname}}', ''), '{{lastname}}', ''), '{{firstinitial}}', ''), '{{lastinitial}}', ''), 'firstname|lastname|firstinitial|lastinitial') THEN raw END AS usable
FROM (SELECT l.lead_id, website, email_pattern || CASE WHEN l.lead_id % 5 = 0 THEN '.lastname' ELSE '' END AS raw,
  replace(replace(replace(email_pattern, '{{firstname}}', 'john'), '{{lastname}}', 'baker'), '{{firstinitial}}', 'j') AS t FROM v_leads l JOIN v_enrichment n ON n.lead_id = l.lead_id) a"""))
def template_emails(spark, sf):
    v = view(spark, sf, "v_leads").join(view(spark, sf, "v_enrichment"), "lead_id")
    k = F.col("lead_id") % 4
    name = F.when(k == 0, "John Baker").when(k == 1, "Dr. John Baker").when(k == 2, "Madonna").otherwise("Book Now")
    raw = F.concat("email_pattern", F.when(F.col("lead_id") % 5 == 0, ".lastname").otherwise(""))
    return v.select("lead_id", M.email_from_template(name, "email_pattern", "website").alias("email"), M.usable_template(raw).alias("usable"))


# --- titles and people ---------------------------------------------------------------------------

@query(with_views(("v_leads",), f"""
SELECT title, {normal_title('title')} AS normal, {seniority('title')} AS seniority, {department('title')} AS department,
  CASE WHEN {rx(f'lower({e("title")})', R.EXECUTIVE_WORDS)} THEN 1.0 WHEN {rx(f'lower({e("title")})', 'executive')} THEN 0.85 WHEN {rx(f'lower({e("title")})', 'lead|supervisor')} THEN 0.7 ELSE 0.5 END AS relevance, count(*) AS n
FROM v_leads GROUP BY ALL"""))
def title_normalize(spark, sf):
    v = view(spark, sf, "v_leads").groupBy("title").agg(F.count(F.lit(1)).alias("n"))
    return v.select("title", T.normalize_title("title").alias("normal"), T.seniority("title").alias("seniority"),
                    T.department("title").alias("department"), T.title_relevance("title").alias("relevance"), "n")


@query(with_views(("v_leads",), f"SELECT {seniority('title')} AS seniority, {department('title')} AS department, count(*) AS n FROM v_leads GROUP BY ALL"))
def seniority_department_counts(spark, sf):
    v = view(spark, sf, "v_leads")
    return v.groupBy(T.seniority("title").alias("seniority"), T.department("title").alias("department")).agg(F.count(F.lit(1)).alias("n"))


_PEOPLE = """SELECT c_custkey AS id, CASE c_custkey % 14 WHEN 0 THEN 'John Baker' WHEN 1 THEN 'Andrew Hill' WHEN 2 THEN 'Corporate Banking' WHEN 3 THEN 'Jane Doe' WHEN 4 THEN 'MARY STONE' WHEN 5 THEN 'The Team'
   WHEN 6 THEN 'Madonna' WHEN 7 THEN 'Dr. Mary Stone' WHEN 8 THEN 'Monday Friday' WHEN 9 THEN 'Book Your Call' WHEN 10 THEN 'CEO/Founder' WHEN 11 THEN 'Head Office (Lagos)' WHEN 12 THEN 'April Jones' ELSE 'information' END AS name,
   CASE c_custkey % 5 WHEN 0 THEN 'CEO' WHEN 1 THEN 'Madonna' ELSE 'Director' END AS title, CASE WHEN c_custkey % 3 = 0 THEN 'john.smith@a.com' WHEN c_custkey % 3 = 1 THEN 'mary@a.com' END AS email,
   0.5 + (c_custkey % 4) * 0.1 AS confidence FROM customer"""


@query(f"""
SELECT id, name IN ('John Baker', 'Andrew Hill', 'Dr. Mary Stone', 'April Jones', 'Jane Doe', 'Corporate Banking') AS page_name, name IN ('John Baker', 'Andrew Hill', 'Jane Doe', 'Monday Friday', 'April Jones', 'The Team', 'Book Your Call') AS search_name,
  name IN ('Corporate Banking', 'information') AS department,
  CASE WHEN name IN ('MARY STONE', 'The Team', 'Head Office (Lagos)', 'information', 'CEO/Founder') AND name <> 'CEO/Founder' THEN 0 WHEN email = 'john.smith@a.com' THEN 0 ELSE 1 END AS not_noise,
  CASE WHEN name IN ('Jane Doe', 'CEO/Founder') OR lower(name) = lower(title) THEN 0 ELSE 1 END AS not_placeholder,
  CASE WHEN name IN ('Corporate Banking', 'information') OR confidence < 0.6 OR email = 'john.smith@a.com' THEN 0 ELSE 1 END AS validated
FROM ({_PEOPLE}) a""")
def person_filters(spark, sf):
    p = spark.sql(_PEOPLE.replace("FROM customer", f"FROM parquet.`{sf}/customer.parquet`"))
    one = F.array(F.struct("name", "title", "email", F.col("confidence").cast("double").alias("confidence")))
    rows = p.select("id", "name", one.alias("people"))
    return rows.select(
        "id", is_person_name("name").alias("page_name"), is_search_person_name("name").alias("search_name"),
        is_department_name("name").alias("department"), F.size(drop_noise("people")).alias("not_noise"),
        F.size(drop_placeholders("people")).alias("not_placeholder"), F.size(drop_unvalidated("people")).alias("validated"))


# --- places --------------------------------------------------------------------------------------

@query(with_views(("v_leads",), f"""
SELECT lead_id, nullif(trim({ex(f'trim({e("address")})', '^([^,]+),')}), '') AS city, CASE WHEN len(p) >= 3 THEN p[-2] END AS state,
  coalesce(CASE WHEN address LIKE '%Nigeria%' THEN 'NG' WHEN address LIKE '%Kenya%' THEN 'KE' WHEN address LIKE '%USA%' THEN 'US' WHEN address LIKE '%United Kingdom%' THEN 'GB' END,
           CASE list_last(string_split({host('website')}, '.')) WHEN 'ng' THEN 'NG' WHEN 'ke' THEN 'KE' WHEN 'uk' THEN 'GB' END) AS country, address AS formatted
FROM (SELECT *, [trim(x) FOR x IN string_split(address, ',')] AS p FROM v_leads) a"""))
def location_parse(spark, sf):
    v = view(spark, sf, "v_leads").select("lead_id", G.parse_location("address", "website").alias("l"))
    return v.select("lead_id", "l.*")


_CITY = "(VALUES " + ", ".join(f"({i}, {q(n)}, {la}, {lo})" for i, (n, la, lo) in enumerate(R.CITY_COORDINATES)) + ") c(i, n, la, lo)"


@query(with_views(("v_leads", "v_searches"), """
SELECT lead_id, round(2 * 6371 * atan2(sqrt(h), sqrt(1 - h)), 1) AS distance_km FROM (
  SELECT lead_id, pow(sin(radians(b.la - a.la) / 2), 2) + cos(radians(a.la)) * cos(radians(b.la)) * pow(sin(radians(b.lo - a.lo) / 2), 2) AS h
  FROM (SELECT lead_id, lower(location) AS place, CASE WHEN address LIKE '%Lagos%' THEN 'lagos' WHEN address LIKE 'Nairobi%' THEN 'nairobi' WHEN address LIKE 'Manchester%' THEN 'manchester' END AS city
        FROM v_leads l LEFT JOIN v_searches s ON s.search_id = l.search_id) x LEFT JOIN cities a ON a.n = x.place LEFT JOIN cities b ON b.n = x.city) y""",
    f"cities AS (SELECT * FROM {_CITY})"))
def lead_distance(spark, sf):
    leads = view(spark, sf, "v_leads").select("lead_id", "search_id", "address")
    return with_distance(leads, view(spark, sf, "v_searches")).select("lead_id", "distance_km")
