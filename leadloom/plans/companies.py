"""Company names, duplicates and attributes."""

from __future__ import annotations

from pyspark.sql import functions as F

from leadloom.functions import company as C
from leadloom.operators import dedup, leads as LD, pages
from leadloom.plans import query
from leadloom.plans.sql import domain, ex, with_views
from leadloom.sources import lead_fixture as L
from leadloom.sources.fixtures import table, view


@query(with_views(("v_leads",), """
SELECT lead_id, trim(regexp_replace(regexp_replace(trim(lower(n)), '\\s+', ' ', 'g'), '[^a-zA-Z0-9_\\s]', '', 'g')) AS name
FROM (SELECT lead_id, CASE WHEN lead_id % 3 = 0 THEN '  ' || company_name || ', (Int''l)  Inc.' ELSE company_name END AS n FROM v_leads) a"""))
def normalize_companies(spark, sf):
    n = F.when(F.col("lead_id") % 3 == 0, F.concat(F.lit("  "), "company_name", F.lit(", (Int'l)  Inc."))).otherwise(F.col("company_name"))
    return view(spark, sf, "v_leads").select("lead_id", C.normalize_company(n).alias("name"))


# names written with a few edits against all registered names
_KNOWN = """known AS (SELECT min(p_partkey) AS company_id, lower(p_name || ' ' || replace(p_brand, '#', ' ') || ' ' || p_type) AS other FROM part GROUP BY 2),
wanted AS (SELECT DISTINCT CASE s_suppkey % 5 WHEN 0 THEN other WHEN 1 THEN 'the ' || other WHEN 2 THEN replace(other, 'a', 'e') WHEN 3 THEN other || 'x' ELSE substr(other, 3) END AS name
  FROM supplier JOIN known ON company_id = s_suppkey)"""


@query(f"""WITH {_KNOWN},
exact AS (SELECT name, company_id FROM wanted JOIN known ON other = name),
close AS (SELECT name, company_id, similarity, row_number() OVER (PARTITION BY name ORDER BY similarity DESC, company_id) AS rank FROM (
  SELECT name, company_id, 1 - levenshtein(name, other) / greatest(length(name), length(other)) AS similarity FROM wanted, known
  WHERE name NOT IN (SELECT name FROM exact)) a WHERE similarity >= 0.85)
SELECT name, company_id, 1.0 AS similarity, 'exact' AS match_type, 1 AS rank FROM exact
UNION ALL SELECT name, company_id, similarity, 'similar', rank FROM close WHERE rank <= 3
UNION ALL SELECT name, NULL, 0.0, 'none', 0 FROM wanted WHERE name NOT IN (SELECT name FROM exact) AND name NOT IN (SELECT name FROM close)""")
def similar_companies(spark, sf):
    part = table(spark, sf, "part")
    known = part.groupBy(F.lower(F.concat_ws(" ", "p_name", F.replace("p_brand", F.lit("#"), F.lit(" ")), "p_type")).alias("normalized_name")).agg(F.min("p_partkey").alias("company_id"))
    k, o = F.col("s_suppkey") % 5, F.col("normalized_name")
    name = (F.when(k == 0, o).when(k == 1, F.concat(F.lit("the "), o)).when(k == 2, F.replace(o, F.lit("a"), F.lit("e")))
            .when(k == 3, F.concat(o, F.lit("x"))).otherwise(F.substr(o, F.lit(3))))
    wanted = table(spark, sf, "supplier").join(known, F.col("company_id") == F.col("s_suppkey")).select(name.alias("name"))
    return dedup.match_companies(wanted, known)


_DOMAIN = f"CASE WHEN {domain('website')} <> '' AND NOT contains(coalesce(website, ''), 'google.com/search') THEN {domain('website')} END"


@query(with_views(("v_leads",), f"""
SELECT lead_id, domain, coalesce(first <> lead_id, false) AS is_duplicate, CASE WHEN first <> lead_id THEN first END AS duplicate_of FROM (
  SELECT lead_id, domain, CASE WHEN domain IS NOT NULL THEN first_value(lead_id) OVER (PARTITION BY search_id, domain ORDER BY created_date, lead_id) END AS first
  FROM (SELECT *, {_DOMAIN} AS domain FROM v_leads) a) b"""))
def dup_by_domain(spark, sf):
    v = L.leads(spark, sf).select("lead_id", "search_id", "website", "created_at")
    return dedup.first_by_domain(v).select("lead_id", "domain", "is_duplicate", "duplicate_of")


# The counterpart takes the leads of each search one after the other and keeps a list of those kept so far.
_FOLD = f"""rows_in AS (SELECT lead_id, search_id, lower(company_name) AS name, {_DOMAIN} AS domain,
    row_number() OVER (PARTITION BY search_id ORDER BY created_date, lead_id) AS i FROM v_leads)"""


def _fold(match: str) -> str:
    return with_views(("v_leads",), """
SELECT lead_id, dup IS NOT NULL AS is_duplicate, dup AS duplicate_of FROM fold""", _FOLD + f""",
fold AS (SELECT * FROM (WITH RECURSIVE step AS (
  SELECT search_id, i, lead_id, CAST(NULL AS BIGINT) AS dup, [{{'id': lead_id, 'name': name, 'domain': domain}}] AS kept FROM rows_in WHERE i = 1
  UNION ALL
  SELECT r.search_id, r.i, r.lead_id, m.dup, CASE WHEN m.dup IS NULL THEN list_append(s.kept, {{'id': r.lead_id, 'name': r.name, 'domain': r.domain}}) ELSE s.kept END
  FROM step s JOIN rows_in r ON r.search_id = s.search_id AND r.i = s.i + 1, LATERAL (SELECT {match} AS dup) m)
 SELECT search_id, lead_id, dup FROM step) z)""")


_BY_NAME = "list_filter(s.kept, lambda k: length(r.name) > 3 AND contains(k.name, r.name) AND length(r.name) / length(k.name) > 0.85)[1].id"
_BY_DOMAIN = "list_filter(s.kept, lambda k: k.domain = r.domain)[1].id"


@query(_fold(_BY_NAME))
def dup_by_name(spark, sf):
    v = L.leads(spark, sf).select("lead_id", "search_id", "company_name", "website", "created_at")
    return dedup.mark_duplicates(v, ("name",)).select("lead_id", "is_duplicate", "duplicate_of")


@query(_fold(f"coalesce({_BY_DOMAIN}, {_BY_NAME})"))
def mark_duplicates(spark, sf):
    v = L.leads(spark, sf).select("lead_id", "search_id", "company_name", "website", "created_at")
    return dedup.mark_duplicates(v).select("lead_id", "is_duplicate", "duplicate_of")


@query(with_views(("v_leads",), """
SELECT a.name AS new_name, b.name AS old_name FROM names a JOIN names b
ON contains(b.name, a.name) AND a.name <> b.name AND length(a.name) > 3 AND length(a.name) / length(b.name) > 0.85""",
    """names AS (SELECT DISTINCT lower(company_name) AS name FROM v_leads UNION SELECT DISTINCT 'a' || lower(company_name) || 's' FROM v_leads)"""))
def contained_names(spark, sf):
    plain = view(spark, sf, "v_leads").select(F.lower("company_name").alias("name"))
    longer = plain.select(F.concat(F.lit("a"), "name", F.lit("s")).alias("name"))
    return dedup.name_matches(plain.union(longer).distinct(), []).select("new_name", "old_name")


_TEXT = """SELECT s_suppkey AS id, CASE s_suppkey % 6 WHEN 0 THEN 'We have ' || CAST(s_suppkey * 7 AS STRING) || ' employees' WHEN 1 THEN '1,2' || CAST(10 + s_suppkey % 89 AS STRING) || ' people'
   WHEN 2 THEN '{"numberOfEmployees": "' || CAST(s_suppkey AS STRING) || '"}' WHEN 3 THEN 'Founded in 19' || CAST(10 + s_suppkey % 89 AS STRING) WHEN 4 THEN 'since 1' || CAST(s_suppkey % 9 AS STRING) || '12, now hiring' ELSE 'none' END AS t,
   CASE s_suppkey % 5 WHEN 0 THEN 'micro' WHEN 1 THEN 'Small' WHEN 2 THEN 'large' WHEN 3 THEN 'other' END AS size FROM supplier"""


@query(f"""
SELECT id, employees, CASE WHEN employees IS NULL OR employees <= 0 THEN NULL WHEN employees <= 10 THEN '1-10' WHEN employees <= 50 THEN '11-50' WHEN employees <= 200 THEN '51-200'
   WHEN employees <= 500 THEN '201-500' WHEN employees <= 1000 THEN '501-1000' ELSE '1000+' END AS employee_range, founded, hiring FROM (
 SELECT id, coalesce(n, CASE lower(size) WHEN 'micro' THEN 5 WHEN 'small' THEN 25 WHEN 'medium' THEN 125 WHEN 'large' THEN 500 END) AS employees, CASE WHEN y BETWEEN 1800 AND 2026 THEN y END AS founded, hiring FROM (
  SELECT id, size, CASE WHEN c > 0 AND c < 1000000 THEN c END AS n, TRY_CAST({ex('t', '(?:Founded in|since) ([0-9]{4})')} AS INT) AS y, contains(t, 'now hiring') AS hiring FROM (
    SELECT *, coalesce(TRY_CAST(replace({ex('t', '([0-9,]+) (?:employees|people)')}, ',', '') AS INT), TRY_CAST({ex('t', '"numberOfEmployees": "([0-9]+)"')} AS INT)) AS c FROM ({_TEXT}) a) b) c) d""")
def company_facts(spark, sf):
    t = spark.sql(_TEXT.replace("FROM supplier", f"FROM parquet.`{sf}/supplier.parquet`"))
    n = C.employees(C.employee_count("t"), "size")
    return t.select("id", n.alias("employees"), C.employee_range(n).alias("employee_range"), C.founded_year("t", 2026).alias("founded"),
                    C.has_hiring_words("t").alias("hiring"))


@query(with_views(("v_leads", "v_enrichment"), """
SELECT size, x.t AS title, x.d AS department, x.r AS relevance, count(*) AS n FROM (
  SELECT size, unnest(CASE size WHEN 'large' THEN [{'t': 'Chief Executive Officer', 'd': 'Executive', 'r': 95}, {'t': 'Business Development Manager', 'd': 'Sales', 'r': 85}, {'t': 'Operations Director', 'd': 'Operations', 'r': 75}]
     WHEN 'medium' THEN [{'t': 'Founder or CEO', 'd': 'Executive', 'r': 90}, {'t': 'Operations Manager', 'd': 'Operations', 'r': 80}] ELSE [{'t': 'Owner or Founder', 'd': 'Executive', 'r': 95}] END) AS x
  FROM (SELECT coalesce(company_size, 'small') AS size FROM v_enrichment) a) b GROUP BY ALL"""))
def suggested_roles(spark, sf):
    rows = LD.suggested_roles(view(spark, sf, "v_enrichment").select("lead_id", F.coalesce("company_size", F.lit("small")).alias("company_size")))
    sized = rows.join(view(spark, sf, "v_enrichment").select("lead_id", F.coalesce("company_size", F.lit("small")).alias("size")), "lead_id")
    return sized.groupBy("size", "title", "department", "relevance").agg(F.count(F.lit(1)).alias("n"))


@query(with_views(("v_leads",), """
SELECT lead_id, 'Hi, I noticed ' || company_name || ' and thought you might be interested in...' AS intro,
  length('Subject: Partnership opportunity' || chr(10) || chr(10) || 'Hi there,' || chr(10) || chr(10) || 'I noticed ' || company_name || '...') AS email_length FROM v_leads"""))
def outreach_texts(spark, sf):
    v = view(spark, sf, "v_leads").select("lead_id", C.outreach_texts("company_name").alias("o"))
    return v.select("lead_id", "o.intro", F.length("o.email").alias("email_length"))


_CAREERS = """SELECT s_suppkey AS page_id, 'https://www.c' || CAST(s_suppkey % 45 AS STRING) || '.com/' || CASE s_suppkey % 4 WHEN 0 THEN 'careers/' WHEN 1 THEN 'about' WHEN 2 THEN 'jobs' ELSE 'job/42' END AS url, '' AS html FROM supplier"""


@query(with_views(("v_leads",), f"""
SELECT l.lead_id, c.domain IS NOT NULL AS has_careers_page FROM v_leads l LEFT JOIN (
  SELECT DISTINCT 'c' || CAST(s_suppkey % 45 AS STRING) || '.com' AS domain FROM supplier WHERE s_suppkey % 4 IN (0, 2)) c ON c.domain = {domain('l.website')}"""))
def careers_pages(spark, sf):
    p = spark.sql(_CAREERS.replace("FROM supplier", f"FROM parquet.`{sf}/supplier.parquet`"))
    leads = view(spark, sf, "v_leads").select("lead_id", "website")
    return LD.with_careers_page(leads, p).select("lead_id", "has_careers_page")


@query(with_views(("v_site_pages",), """
SELECT page_id, 'C' || CAST(page_id AS STRING) || ' Trading | Home' AS name, 120 AS employee_count, '51-200' AS employee_count_range, 1999 AS founded_year,
  'We sell software and retail services. Now hiring. 120 employees. Founded in 1999.' AS description FROM v_site_pages"""))
def profile_pages(spark, sf):
    return pages.profile_pages(L.site_pages(spark, sf), 2026).select(
        "page_id", "name", "employee_count", "employee_count_range", "founded_year", "description")


