"""People on pages and in texts, merged per site."""

from __future__ import annotations

from pyspark.sql import functions as F

from leadloom.operators import people as P
from leadloom.plans import query
from leadloom.plans.sql import with_views
from leadloom.sources import lead_fixture as L
from leadloom.sources.fixtures import view


def _from(spark, sf, sql: str, name: str):
    return spark.sql(sql.replace(f"FROM {name}", f"FROM parquet.`{sf}/{name}.parquet`"))


@query(with_views(("v_site_pages",), "SELECT page_id, 'Mary Stone' AS name, 'Founder' AS title, 0.95 AS confidence FROM v_site_pages"))
def page_jsonld_people(spark, sf):
    return P.jsonld_people(L.site_pages(spark, sf)).select("page_id", "name", "title", "confidence")


_LD = """SELECT s_suppkey AS page_id, 'https://s.com/' AS url, '<script type="application/ld+json">[{"@type": "EmployeeRole", "roleName": "Buyer", "employee": {"name": "Anna Field"}}, {"@type": "Person", "name": "Peter Long", "worksFor": {"jobTitle": "Chair"}}, {"@type": "Organization", "employee": [{"name": "Ruth Kent", "jobTitle": "Clerk"}, {"name": "our team"}]}]</script><script type="application/ld+json">{broken</script>' AS html FROM supplier"""


@query("""SELECT s_suppkey AS page_id, n AS name, t AS title FROM supplier, (VALUES ('Anna Field', 'Buyer'), ('Peter Long', 'Chair'), ('Ruth Kent', 'Clerk')) v(n, t)""")
def jsonld_people_kinds(spark, sf):
    return P.jsonld_people(_from(spark, sf, _LD, "supplier")).select("page_id", "name", "title")


@query(with_views(("v_site_pages",), """
SELECT page_id, 'Mary Stone' AS name, 'Founder' AS title, 'structured_data' AS source, 0.95 AS confidence FROM v_site_pages
UNION ALL SELECT page_id, 'John Baker', 'Operations Manager', 'website', 0.85 FROM v_site_pages"""))
def page_team_people(spark, sf):
    return P.page_people(L.site_pages(spark, sf)).select("page_id", "name", "title", "source", "confidence")


_TEAM = """SELECT s_suppkey AS page_id, 'https://s' || CAST(s_suppkey % 10 AS STRING) || '.com/' || CASE s_suppkey % 3 WHEN 0 THEN 'team' WHEN 1 THEN '' ELSE 'shop' END AS url,
  '<meta property="og:profile:name" content="Paul Price"><div itemscope itemtype="http://schema.org/Person"><span itemprop="name">Nora Green</span><b itemprop="jobTitle">Chair</b></div><div class="person-card"><img alt="Karl Young"><p>He is director of all.</p></div><p>Maria Lopez, CEO</p><p>CFO: Hugo Frank</p>' AS html FROM supplier"""


@query("""
SELECT s_suppkey AS page_id, n AS name, t AS title, c AS confidence FROM supplier, (VALUES ('Paul Price', 'Team Member', 0.8, 1), ('Nora Green', 'Chair', 0.85, 1), ('Karl Young', 'director', 0.85, 0), ('Maria Lopez', 'CEO', 0.8, 0), ('Hugo Frank', 'CFO', 0.8, 0)) v(n, t, c, everywhere)
WHERE everywhere = 1 OR s_suppkey % 3 = 0""")
def page_people_rules(spark, sf):
    return P.page_people(_from(spark, sf, _TEAM, "supplier")).select("page_id", "name", "title", "confidence")


@query("""
SELECT site, name, title, source_rank FROM (
  SELECT *, row_number() OVER (PARTITION BY site ORDER BY source_rank, page_id, rule) AS r, sum(CASE WHEN source_rank = 0 THEN 1 ELSE 0 END) OVER (PARTITION BY site) AS known FROM (
    SELECT *, row_number() OVER (PARTITION BY site, name, title ORDER BY source_rank, page_id) AS dup FROM (
      SELECT 's' || CAST(s_suppkey % 10 AS STRING) || '.com' AS site, s_suppkey AS page_id, n AS name, t AS title, rule, CASE WHEN s_suppkey % 3 = 1 THEN 0 ELSE 1 END AS source_rank
      FROM supplier, (VALUES ('Paul Price', 'Team Member', 2, 1), ('Nora Green', 'Chair', 1, 1), ('Karl Young', 'director', 3, 0), ('Maria Lopez', 'CEO', 4, 0), ('Hugo Frank', 'CFO', 5, 0)) v(n, t, rule, everywhere)
      WHERE everywhere = 1 OR s_suppkey % 3 = 0) a) b WHERE dup = 1) c WHERE r <= 12 AND (source_rank = 0 OR known < 5)""")
def site_people(spark, sf):
    return P.site_people(_from(spark, sf, _TEAM, "supplier")).select("site", "name", "title", "source_rank")


# people rows of seven sources per site, as the single extractors deliver them
_SOURCES = """SELECT 'c' || CAST(o_custkey % 300 AS STRING) || '.com' AS site, CAST(o_orderkey % 7 AS INT) AS source_rank, o_orderkey AS pos, 'P' || CAST(o_orderkey % 9 AS STRING) AS name,
  CASE o_orderkey % 4 WHEN 0 THEN 'CEO' WHEN 1 THEN 'Director' ELSE 'Clerk' END AS title, CAST(NULL AS STRING) AS email, 'x' AS source, 0.5 AS confidence FROM orders"""


@query(f"""
SELECT site, source_rank, pos, name, title FROM (
  SELECT *, row_number() OVER (PARTITION BY site ORDER BY source_rank, pos) AS r FROM (
    SELECT a.*, (SELECT count(*) FROM firsts b WHERE b.site = a.site AND b.source_rank < a.source_rank) AS known FROM firsts a) c WHERE known < 5) d WHERE r <= 12
""".replace("SELECT site, source_rank, pos, name, title FROM (", f"""WITH firsts AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY site, name, title ORDER BY source_rank, pos) AS dup FROM ({_SOURCES}) z) y WHERE dup = 1)
SELECT site, source_rank, pos, name, title FROM (""", 1))
def merged_people(spark, sf):
    rows = _from(spark, sf, _SOURCES, "orders").withColumn("confidence", F.col("confidence").cast("double"))
    return P.merge_people(rows).select("site", "source_rank", "pos", "name", "title")


@query(with_views(("v_site_pages",), "SELECT 'c' || CAST(page_id AS STRING) || '.com' AS domain, 'John Baker' AS name, 'Operations Manager' AS title, 0.85 AS confidence FROM v_site_pages"))
def site_executives(spark, sf):
    return P.site_executives(P.page_executives(L.site_pages(spark, sf))).select("domain", "name", "title", "confidence")


_PRESS = """SELECT c_custkey AS doc_id, CASE c_custkey % 5 WHEN 0 THEN 'Today CEO Anna Field said: yes. Peter Long, Director of Sales, left.' WHEN 1 THEN 'It was led by Ruth Kent, Manager of it. ' || c_name
  WHEN 2 THEN '"Good news" - Hugo Frank, VP' WHEN 3 THEN 'ceo anna field said' ELSE c_name END AS text FROM customer"""


@query("""
SELECT c_custkey AS doc_id, n AS name, t AS title FROM customer JOIN (VALUES (0, 'Anna Field', 'CEO'), (0, 'Peter Long', 'Director'), (1, 'Ruth Kent', 'Manager'), (2, 'Hugo Frank', 'VP')) v(k, n, t) ON c_custkey % 5 = k""")
def press_people(spark, sf):
    return P.press_people(_from(spark, sf, _PRESS, "customer")).select("doc_id", "name", "title")


_WIKI = """SELECT c_custkey AS doc_id, CASE c_custkey % 4 WHEN 0 THEN '| CEO = Anna Field' WHEN 1 THEN '== Leadership ==' || chr(10) || '* Peter Long (Chair)' WHEN 2 THEN 'Ruth Kent is the Founder of ' || c_name ELSE c_name END AS text FROM customer"""


@query("""
SELECT c_custkey AS doc_id, n AS name, t AS title FROM customer JOIN (VALUES (0, 'Anna Field', 'CEO'), (1, 'Peter Long', 'Chair'), (2, 'Ruth Kent', 'Founder')) v(k, n, t) ON c_custkey % 4 = k""")
def encyclopedia_people(spark, sf):
    return P.encyclopedia_people(_from(spark, sf, _WIKI, "customer")).select("doc_id", "name", "title")


_MAIL = """SELECT c_custkey AS message_id, CASE c_custkey % 4 WHEN 0 THEN 'Best regards, Anna Field, CEO' WHEN 1 THEN 'Peter Long' || chr(10) || 'Director' ELSE 'bye' END AS body,
  CASE c_custkey % 4 WHEN 2 THEN 'ruth.kent@a.com' ELSE 'info' || CAST(c_custkey AS STRING) || '@a.com' END AS email FROM customer"""


@query("""
SELECT c_custkey AS message_id, n AS name, t AS title, c AS confidence FROM customer JOIN (VALUES (0, 'Anna Field', 'CEO', 0.9), (1, 'Peter Long', 'Director', 0.9), (2, 'Ruth Kent', NULL, 0.6)) v(k, n, t, c) ON c_custkey % 4 = k""")
def signature_people(spark, sf):
    return P.signature_people(_from(spark, sf, _MAIL, "customer")).select("message_id", "name", "title", "confidence")


_REG = """SELECT s_suppkey AS search_id, '{"results": {"companies": [{"company": {"officers": [' || CASE WHEN s_suppkey % 4 = 0 THEN '' ELSE '{"officer": {"name": "Anna ' || s_name || '", "position": "Chair"}}, ' END
  || '{"officer": {"name": "Peter Long"}}, {"officer": {"name": ""}}, {"officer": {"name": "C"}}, {"officer": {"name": "D"}}, {"officer": {"name": "E"}}]}}]}}' AS payload FROM supplier"""


@query("""
SELECT s_suppkey AS search_id, CASE n WHEN 'A' THEN 'Anna ' || s_name ELSE n END AS name, CASE n WHEN 'A' THEN 'Chair' ELSE 'Director' END AS title FROM supplier, (VALUES ('A'), ('Peter Long'), ('C'), ('D'), ('E')) v(n)
WHERE (n <> 'A' OR s_suppkey % 4 <> 0) AND (n <> 'E' OR s_suppkey % 4 = 0)""")
def registry_people(spark, sf):
    return P.registry_people(_from(spark, sf, _REG, "supplier")).select("search_id", "name", "title")


_FOUND = """SELECT o_custkey AS search_id, o_orderkey AS pos, CASE o_orderkey % 4 WHEN 0 THEN 'Anna Field - CEO' WHEN 1 THEN 'Director: Peter Long' WHEN 2 THEN 'Corporate Banking - Manager' ELSE 'Shop' END AS title,
  CASE o_orderkey % 3 WHEN 0 THEN 'write to anna@a.com or PETER@B.ORG' ELSE '' END AS snippet, CASE WHEN o_orderkey % 10 = 0 THEN 'https://www.wikidata.org/x' ELSE 'https://a.com' END AS link FROM orders"""


@query(f"""
SELECT search_id, name, title, email, CASE WHEN email IS NULL THEN 0.6 ELSE 0.8 END AS confidence FROM (
  SELECT search_id, CASE pos % 4 WHEN 0 THEN 'Anna Field' ELSE 'Peter Long' END AS name, CASE pos % 4 WHEN 0 THEN 'CEO' ELSE 'Director' END AS title,
    CASE WHEN pos % 3 = 0 THEN CASE pos % 4 WHEN 0 THEN 'anna@a.com' ELSE 'peter@b.org' END END AS email, row_number() OVER (PARTITION BY search_id, pos % 4 ORDER BY pos) AS r
  FROM ({_FOUND}) a WHERE pos % 10 <> 0 AND pos % 4 < 2) b WHERE r = 1""")
def result_people(spark, sf):
    return P.result_people(_from(spark, sf, _FOUND, "orders")).select("search_id", "name", "title", "email", "confidence")


@query(f"""SELECT DISTINCT search_id, m AS email FROM ({_FOUND}) a, (VALUES ('anna@a.com'), ('peter@b.org')) v(m) WHERE pos % 3 = 0""")
def result_emails(spark, sf):
    return P.result_emails(_from(spark, sf, _FOUND, "orders"))


@query(with_views(("v_leads",), """
SELECT search_id, name FROM (SELECT search_id, name, row_number() OVER (PARTITION BY search_id ORDER BY s, pos) AS r FROM (
  SELECT search_id, name, s, pos, row_number() OVER (PARTITION BY search_id, lower(name) ORDER BY s, pos) AS d FROM (
    SELECT search_id, title AS name, 0 AS s, lead_id AS pos FROM v_leads WHERE lead_id % 2 = 0 AND title IS NOT NULL UNION ALL SELECT search_id, upper(title), 1, lead_id FROM v_leads WHERE lead_id % 2 = 1 AND length(title) > 2) a) b WHERE d = 1) c WHERE r <= 12"""))
def people_not_known(spark, sf):
    v = view(spark, sf, "v_leads").filter("title IS NOT NULL")
    old = v.filter("lead_id % 2 = 0").select("search_id", F.col("title").alias("name"), F.col("lead_id").alias("pos"))
    new = v.filter("lead_id % 2 = 1").select("search_id", F.upper("title").alias("name"), F.col("lead_id").alias("pos"))
    return P.new_people(old, new, "search_id").select("search_id", "name")


# --- all sources of a site, one after the other ---------------------------------------------------

_LAST = ["Adams", "Baker", "Clark", "Davis", "Evans", "Grant", "Hayes"]
_NAMED = "(VALUES " + ", ".join(f"({i}, '{n}')" for i, n in enumerate(_LAST)) + ") v(i, n)"


def _cards(first: str, count: str) -> str:
    """``count`` cards of people with one first name."""
    each = " || ".join(f"CASE WHEN {count} > {i} THEN '<div class=\"team-member\"><h3>{first} {n}</h3><span class=\"title\">CEO</span></div>' ELSE '' END" for i, n in enumerate(_LAST))
    return f"({each})"


_SITE_PAGES = f"""SELECT s_suppkey * 2 AS page_id, 'https://c' || CAST(s_suppkey AS STRING) || '.com/' AS url, '<html><body>' || {_cards('Anna', 's_suppkey % 7')}
  || CASE WHEN s_suppkey % 2 = 0 THEN '<p>CEO David Adams said: yes.</p>' ELSE '' END
  || CASE WHEN s_suppkey % 5 < 2 THEN '<div>Emma Adams\nDirector <a href="mailto:office@c' || CAST(s_suppkey AS STRING) || '.com">mail</a></div>' WHEN s_suppkey % 5 = 2 THEN '<div>Write <a href="MAILTO:emma.baker@c.com?subject=x">us</a></div>' ELSE '' END || '</body></html>' AS html FROM supplier
UNION ALL SELECT s_suppkey * 2 + 1, 'https://www.c' || CAST(s_suppkey AS STRING) || '.com/team', '<div>' || {_cards('Anna', 'least(s_suppkey % 7, 1)')} || {_cards('Boris', 's_suppkey % 3')} || '</div>' FROM supplier"""
_SITES = "SELECT s_suppkey AS company_id, 'c' || CAST(s_suppkey AS STRING) || '.com' AS site FROM supplier"
_SITE_RESULTS = f"SELECT s_suppkey AS company_id, i AS pos, 'Clara ' || n || ' - CEO' AS title, '' AS snippet, 'https://a.com' AS link FROM supplier, {_NAMED} WHERE i < CAST(floor(s_suppkey / 3) AS INT) % 3"
_SITE_REGISTRY = """SELECT s_suppkey AS company_id, '{"results": {"companies": [{"company": {"officers": [{"officer": {"name": "Felix Adams", "position": "Chair"}}, {"officer": {"name": "Felix Baker"}}]}}]}}' AS payload FROM supplier WHERE s_suppkey % 4 = 0"""
_SITE_ARTICLES = "SELECT s_suppkey AS company_id, '| CEO = Grace Adams' AS text FROM supplier"


@query(f"""
WITH s AS (SELECT s_suppkey AS k FROM supplier), p AS (
  SELECT k, 0 AS source_rank, i AS pos, 'Anna ' || n AS name, 'CEO' AS title FROM s, {_NAMED} WHERE i < k % 7
  UNION ALL SELECT k, 1, i, 'Boris ' || n, 'CEO' FROM s, {_NAMED} WHERE i < k % 3
  UNION ALL SELECT k, 2, i, 'Clara ' || n, 'CEO' FROM s, {_NAMED} WHERE i < k // 3 % 3
  UNION ALL SELECT k, 3, 0, 'David Adams', 'CEO' FROM s WHERE k % 2 = 0
  UNION ALL SELECT k, 4, 0, CASE WHEN k % 5 = 2 THEN 'Emma Baker' ELSE 'Emma Adams' END, CASE WHEN k % 5 < 2 THEN 'Director' END FROM s WHERE k % 5 < 3
  UNION ALL SELECT k, 5, i, 'Felix ' || n, CASE i WHEN 0 THEN 'Chair' ELSE 'Director' END FROM s, {_NAMED} WHERE k % 4 = 0 AND i < 2
  UNION ALL SELECT k, 6, 0, 'Grace Adams', 'CEO' FROM s),
q AS (SELECT *, (SELECT count(*) FROM p b WHERE b.k = a.k AND b.source_rank < a.source_rank) AS known FROM p a)
SELECT 'c' || CAST(k AS VARCHAR) || '.com' AS site, source_rank, name, title FROM q WHERE known < 5""")
def staged_people(spark, sf):
    read = lambda sql: _from(spark, sf, sql, "supplier")
    stages = P.site_people_stages(read(_SITE_PAGES), read(_SITES), read(_SITE_RESULTS), read(_SITE_REGISTRY), read(_SITE_ARTICLES))
    return P.people_in_stages(stages).select("site", "source_rank", "name", "title")
