"""Deterministic lead, search, ledger, result and site tables derived from the driver tables.

Every view is plain SQL that Spark and DuckDB read alike. ``{table}`` marks a driver table.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from leadloom.session import spread

TABLES = (
    "region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents", "embeddings",
    "pages", "benchmark", "labels", "conversations",
)

VIEWS: dict[str, str] = {}

VIEWS["v_users"] = r"""
SELECT user_id, user_id % 8 AS company_id, CASE WHEN user_id % 5 = 0 THEN 'admin' ELSE 'member' END AS role,
       DATE '2024-01-01' + CAST(user_id % 30 AS INT) AS created_date
FROM (SELECT DISTINCT c_custkey % 40 AS user_id FROM {customer}) t
"""

VIEWS["v_companies"] = r"""
SELECT company_id, CASE WHEN company_id % 2 = 0 THEN TRUE ELSE FALSE END AS share_searches,
       CASE WHEN company_id % 3 = 0 THEN 'ngn' ELSE 'usd' END AS currency
FROM (SELECT DISTINCT c_custkey % 8 AS company_id FROM {customer}) t
"""

VIEWS["v_searches"] = r"""
SELECT c_custkey AS search_id, c_custkey % 40 AS user_id,
       CASE c_mktsegment WHEN 'HOUSEHOLD' THEN 'pending' WHEN 'MACHINERY' THEN 'failed' WHEN 'BUILDING' THEN 'processing_backfill' ELSE 'completed' END AS status,
       CASE WHEN c_custkey % 3 = 0 THEN 0 ELSE 10 END AS priority, CAST(c_custkey % 7 AS INT) * 10 AS total_results,
       CASE c_custkey % 4 WHEN 0 THEN 'Lagos' WHEN 1 THEN 'Nairobi' WHEN 2 THEN 'London' END AS location,
       DATE '2024-01-01' + CAST(c_custkey % 45 AS INT) AS created_date
FROM {customer}
"""

VIEWS["v_leads"] = r"""
SELECT o.o_orderkey AS lead_id, o.o_custkey AS search_id, k,
       upper(substr(p.p_name,1,1)) || substr(p.p_name,2) || ' ' || CASE k % 5 WHEN 0 THEN 'Ltd' WHEN 1 THEN 'Group' WHEN 2 THEN 'Foods Company' WHEN 3 THEN 'Inc' ELSE 'Partners International' END AS company_name,
       CASE k % 8 WHEN 0 THEN NULL WHEN 1 THEN 'http://www.c' || CAST(k AS STRING) || '.co.uk/x' WHEN 2 THEN 'https://C' || CAST(k AS STRING) || '.com'
            WHEN 3 THEN 'c' || CAST(k AS STRING) || '.com.ng' WHEN 4 THEN 'https://facebook.com/c' || CAST(k AS STRING) WHEN 5 THEN 'https://businessdirectory' || CAST(k AS STRING) || '.com/listings/1'
            WHEN 6 THEN 'HTTPS://WWW.C' || CAST(k AS STRING) || '.IO/?a=1' ELSE 'https://www.c' || CAST(k AS STRING) || '.co.ke:8080/p#t' END AS website,
       CASE o.o_orderkey % 7 WHEN 0 THEN NULL WHEN 1 THEN 'info@c' WHEN 2 THEN 'jane.smith@c' WHEN 3 THEN 'j.smith@c' WHEN 4 THEN 'jane@c' WHEN 5 THEN 'jane99@c' ELSE 'a@mailinator.com#' END || CAST(k AS STRING) || '.com' AS email,
       CASE o.o_orderkey % 6 WHEN 0 THEN NULL WHEN 1 THEN '+234 803 123 4567' WHEN 2 THEN '(212) 555-0101' WHEN 3 THEN '0803 123 4567' WHEN 4 THEN '+44 20 7946 0958' ELSE '254712345678' END AS phone,
       CASE o.o_orderkey % 5 WHEN 0 THEN NULL WHEN 1 THEN '12 Marina, Lagos, Nigeria' WHEN 2 THEN 'Nairobi, Kenya' WHEN 3 THEN 'Milwaukee, WI, USA' ELSE 'Manchester, United Kingdom' END AS address,
       CASE o.o_orderkey % 9 WHEN 0 THEN 'Director' WHEN 1 THEN 'Vice President of Sales' WHEN 2 THEN 'Co-Founder' WHEN 3 THEN 'Marketing Coordinator' WHEN 4 THEN 'Head of Sales' WHEN 5 THEN 'CTO' WHEN 6 THEN 'Junior Accountant' WHEN 7 THEN 'Operations Manager' END AS title,
       CASE WHEN o.o_orderkey % 11 = 0 THEN NULL ELSE o.o_orderkey * 37 % 101 END AS signal_strength,
       CASE WHEN o.o_orderkey % 13 = 0 THEN NULL ELSE o.o_orderkey % 6 END AS verification_score,
       CASE o.o_orderstatus WHEN 'F' THEN 'enriched' WHEN 'O' THEN 'skipped' ELSE 'failed' END AS enrichment_status,
       CAST(o.o_orderdate AS DATE) AS created_date
FROM (SELECT *, (o_orderkey * 7 + o_custkey) % 40 AS k FROM {orders}) o JOIN {part} p ON p.p_partkey = o.k
"""

VIEWS["v_ledger"] = r"""
SELECT user_id % 8 AS company_id, event_id AS seq, ts,
       CASE event_type WHEN 'purchase' THEN CAST(event_id % 2 AS INT) + 1 WHEN 'error' THEN 1 ELSE -1 END AS delta,
       CASE event_type WHEN 'purchase' THEN 'purchase' WHEN 'error' THEN 'refund_invalid' ELSE 'reserve' END AS reason,
       CASE event_type WHEN 'purchase' THEN CASE event_id % 3 WHEN 0 THEN 'pack_100' WHEN 1 THEN 'pack_500' ELSE 'pack_2000' END END AS pack_id
FROM {events}
"""

VIEWS["v_results"] = r"""
SELECT o_custkey AS search_id, CASE o_orderkey % 3 WHEN 0 THEN 'overpass' WHEN 1 THEN 'bing' ELSE 'places' END AS provider, o_orderkey AS pos,
       CASE WHEN o_orderkey % 3 = 2 THEN 'places:p' || CAST(o_orderkey % 50 AS STRING) ELSE 'https://www.c' || CAST(o_orderkey % 30 AS STRING) || '.com/p' || CAST(o_orderkey % 4 AS STRING) END AS link,
       'Company ' || CAST(o_orderkey % 30 AS STRING) || CASE WHEN o_orderkey % 10 = 0 THEN ' - CEO' ELSE '' END AS title
FROM {orders}
"""

VIEWS["v_site_pages"] = r"""
SELECT s_suppkey AS page_id, 'https://www.c' || CAST(s_suppkey AS STRING) || '.com/about' AS url,
  '<html><head><title>C' || CAST(s_suppkey AS STRING) || ' Trading | Home</title><link rel="canonical" href="https://www.c' || CAST(s_suppkey AS STRING) || '.com/">' ||
  '<meta name="description" content="We sell software and retail services. Now hiring. 120 employees. Founded in 1999.">' ||
  '<script type="application/ld+json">{"@type":"Organization","name":"C' || CAST(s_suppkey AS STRING) || '","founder":{"@type":"Person","name":"Mary Stone","jobTitle":"Founder"}}</script></head><body><nav><a href="/team">Team</a></nav>' ||
  '<div class="team-member"><h3>John Baker</h3><span class="title">Operations Manager</span></div><p class="address">' || n_name || ', Lagos, Nigeria</p>' ||
  '<a href="mailto:jane.smith@c' || CAST(s_suppkey AS STRING) || '.com">mail</a><a href="tel:+2348031234567">call</a><a href="https://linkedin.com/company/c' || CAST(s_suppkey AS STRING) || '">in</a>' ||
  '<a href="https://partner' || CAST(s_suppkey % 9 AS STRING) || '.com/x">Partner</a> sales [at] c' || CAST(s_suppkey AS STRING) || ' [dot] com</body></html>' AS html
FROM {supplier} JOIN {nation} ON n_nationkey = s_nationkey
"""


# what enrichment would have returned for a lead, from its id alone
ENRICHMENT = {
    "industry": "CASE lead_id % 4 WHEN 0 THEN NULL WHEN 1 THEN 'unknown' WHEN 2 THEN 'software' ELSE 'food' END",
    "company_size": "CASE lead_id % 5 WHEN 0 THEN NULL WHEN 1 THEN 'micro' WHEN 2 THEN 'small' WHEN 3 THEN 'medium' ELSE 'large' END",
    "email_pattern": "CASE lead_id % 3 WHEN 0 THEN '{firstname}.{lastname}@c' || CAST(lead_id % 40 AS STRING) || '.com' "
                     "WHEN 1 THEN '{firstinitial}{lastname}' ELSE NULL END",
    "linkedin_company_url": "CASE WHEN lead_id % 6 = 0 THEN 'https://linkedin.com/company/c' || CAST(lead_id % 40 AS STRING) END",
    "employee_count": "CASE WHEN lead_id % 8 = 0 THEN CAST(lead_id % 1200 AS INT) END",
}
VIEWS["v_enrichment"] = (
    "SELECT lead_id, " + ", ".join(f"{sql} AS {name}" for name, sql in ENRICHMENT.items())
    + " FROM (SELECT o_orderkey AS lead_id FROM {orders}) t")


def _fill(sql: str, names: dict[str, str]) -> str:
    for table, target in names.items():
        sql = sql.replace("{" + table + "}", target)
    return sql


def sql_for_spark(name: str, sf_dir: str) -> str:
    return _fill(VIEWS[name], {t: f"parquet.`{sf_dir}/{t}.parquet`" for t in TABLES})


def sql_for_duckdb(name: str) -> str:
    return _fill(VIEWS[name], {t: t for t in TABLES})


def view(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    if name == "v_leads":
        orders = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", "o_orderstatus", "o_orderdate")
        return spark.sql(VIEWS[name], orders=spread(orders, "o_orderkey"), part=table(spark, sf_dir, "part"))
    if name == "v_results":
        orders = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey")
        return spark.sql(VIEWS[name], orders=spread(orders, "o_orderkey"))
    df = spark.sql(sql_for_spark(name, sf_dir))
    # pages go through costly rules
    return spread(df, "page_id") if name == "v_site_pages" else df


def with_enrichment(leads: DataFrame) -> DataFrame:
    """Leads with the columns of ``v_enrichment``, which depend on the id alone."""
    return leads.select("*", *[F.expr(sql).alias(name) for name, sql in ENRICHMENT.items()])


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def ctes(*names: str) -> str:
    """``WITH`` clause that defines the named views for DuckDB."""
    return "WITH " + ",\n".join(f"{n} AS ({sql_for_duckdb(n).strip()})" for n in names) + "\n"
