"""Provider payloads, result union and dedup, batches."""

from __future__ import annotations

from pyspark.sql import functions as F

from leadloom import refdata as R
from leadloom.functions.query import expansions
from leadloom.operators import results as RS
from leadloom.plans import query
from leadloom.plans.sql import host, q, rx, with_views
from leadloom.sources import lead_fixture as L, payloads as P
from leadloom.sources.fixtures import table


def _payloads(spark, sf, sql: str, table_name: str):
    return spark.sql(sql.replace(f"FROM {table_name}", f"FROM parquet.`{sf}/{table_name}.parquet`"))


# --- map elements --------------------------------------------------------------------------------

_OSM = """SELECT c_custkey % 50 AS search_id, CASE c_custkey % 50 % 4 WHEN 0 THEN 'food charity' WHEN 1 THEN 'credit services' ELSE 'shops' END AS query, 'ng' AS country, 'Lagos' AS location, c_custkey AS payload_no,
  '{"elements": [{"type": "node", "id": ' || CAST(c_custkey AS STRING) || ', "tags": {"name": "' || c_name || CASE c_custkey % 3 WHEN 0 THEN ' Bank' WHEN 1 THEN ' Soup Kitchen' ELSE '' END || '"'
  || CASE c_custkey % 5 WHEN 0 THEN ', "website": "www.c' || CAST(c_custkey AS STRING) || '.com"' WHEN 1 THEN ', "contact:website": "https://yelp.com/x"' WHEN 2 THEN ', "brand:wikidata": "Q' || CAST(c_custkey AS STRING) || '"'
       WHEN 3 THEN ', "url": "http://c' || CAST(c_custkey AS STRING) || '.org/"' ELSE '' END
  || ', "addr:street": "Marina", "addr:town": "Lagos", "phone:mobile": "080' || CAST(c_custkey AS STRING) || '"}}, {"type": "way", "id": 1, "tags": {"name": "ab"}}]}' AS payload FROM customer"""


@query(f"""
SELECT search_id, pos, title, link, address, phone FROM (
  SELECT id % 50 AS search_id, id * 100000 AS pos, name AS title, CASE id % 5 WHEN 0 THEN 'https://www.c' || CAST(id AS STRING) || '.com' WHEN 2 THEN 'https://www.wikidata.org/wiki/Q' || CAST(id AS STRING) WHEN 3 THEN 'http://c' || CAST(id AS STRING) || '.org/' END AS link,
    'Marina, Lagos' AS address, '080' || CAST(id AS STRING) AS phone, CASE id % 50 % 4 WHEN 0 THEN id % 3 = 0 WHEN 1 THEN id % 3 = 1 ELSE false END AS mismatch
  FROM (SELECT c_custkey AS id, c_name || CASE c_custkey % 3 WHEN 0 THEN ' Bank' WHEN 1 THEN ' Soup Kitchen' ELSE '' END AS name FROM customer) a) b WHERE link IS NOT NULL AND NOT mismatch""")
def overpass_results(spark, sf):
    return P.overpass_results(_payloads(spark, sf, _OSM, "customer")).select("search_id", "pos", "title", "link", "address", "phone")


# --- places with class and address ---------------------------------------------------------------

_NOM = """SELECT c_custkey % 50 AS search_id, CASE c_custkey % 50 % 2 WHEN 0 THEN 'companies' ELSE 'pharmacy stores' END AS query, 'ng' AS country, CASE c_custkey % 50 % 3 WHEN 0 THEN 'Lagos' END AS location, c_custkey AS payload_no,
  '[{"osm_type": "node", "osm_id": "' || CAST(c_custkey % 1000 AS STRING) || '", "name": ' || CASE c_custkey % 7 WHEN 0 THEN 'null' WHEN 1 THEN '"Taiwo Road"' ELSE '"Shop ' || CAST(c_custkey AS STRING) || '"' END
  || ', "display_name": "' || CASE c_custkey % 7 WHEN 0 THEN 'Health Pharmacy' WHEN 1 THEN 'Taiwo Road' WHEN 2 THEN 'Barber Lake' ELSE 'Shop ' || CAST(c_custkey AS STRING) END || ', ' || CASE c_custkey % 2 WHEN 0 THEN 'Lagos' ELSE 'Abuja' END || ', ' || CASE c_custkey % 11 WHEN 0 THEN 'Ghana' ELSE 'Nigeria' END
  || '", "class": "' || CASE c_custkey % 5 WHEN 0 THEN 'natural' WHEN 1 THEN 'highway' ELSE 'shop' END || '", "type": "' || CASE WHEN c_custkey % 7 = 1 THEN '' ELSE 'yes' END || '", "address": {"road": "Marina", "city": "' || CASE c_custkey % 2 WHEN 0 THEN 'Lagos' ELSE 'Abuja' END
  || '"}, "extratags": {' || CASE c_custkey % 4 WHEN 0 THEN '"website": "c' || CAST(c_custkey AS STRING) || '.com", "phone": "1"' ELSE '' END || '}}]' AS payload FROM customer"""


@query("""
SELECT search_id, title, link, address, phone FROM (
  SELECT *, row_number() OVER (PARTITION BY search_id, id % 1000 ORDER BY id) AS r,
    CASE id % 7 WHEN 0 THEN 'Health Pharmacy' WHEN 1 THEN 'Taiwo Road' WHEN 2 THEN 'Barber Lake' ELSE 'Shop ' || CAST(id AS STRING) END AS shown,
    CASE id % 7 WHEN 0 THEN 'Health Pharmacy' WHEN 1 THEN 'Taiwo Road' ELSE 'Shop ' || CAST(id AS STRING) END AS title, city, 'Marina, ' || city AS address,
    CASE id % 4 WHEN 0 THEN '1' END AS phone, id % 4 = 0 AS site,
    CASE id % 4 WHEN 0 THEN 'https://c' || CAST(id AS STRING) || '.com' ELSE 'https://www.google.com/search?q=' || replace(replace(CASE id % 7 WHEN 0 THEN 'Health Pharmacy' WHEN 1 THEN 'Taiwo Road' ELSE 'Shop ' || CAST(id AS STRING) END || ' Marina, ' || city, ',', '%2C'), ' ', '+') END AS link
  FROM (SELECT c_custkey AS id, c_custkey % 50 AS search_id, CASE c_custkey % 2 WHEN 0 THEN 'Lagos' ELSE 'Abuja' END AS city FROM customer) a) b
WHERE r = 1 AND id % 7 <> 2 AND id % 5 <> 0 AND id % 11 <> 0 AND (search_id % 3 <> 0 OR city = 'Lagos')
  AND NOT (id % 7 = 1 AND id % 5 = 1 AND NOT site) AND (search_id % 2 = 0 OR id % 7 = 0)""")
def nominatim_results(spark, sf):
    return P.nominatim_results(_payloads(spark, sf, _NOM, "customer")).select("search_id", "title", "link", "address", "phone")


@query("""
SELECT search_id, title, link FROM (
  SELECT id, search_id, city, row_number() OVER (PARTITION BY search_id, id % 1000 ORDER BY id) AS r, CASE id % 7 WHEN 0 THEN 'Health Pharmacy' WHEN 1 THEN 'Taiwo Road' ELSE 'Shop ' || CAST(id AS VARCHAR) END AS title,
    CASE id % 4 WHEN 0 THEN 'https://c' || CAST(id AS VARCHAR) || '.com' ELSE 'https://www.google.com/search?q=Health+Pharmacy+Marina%2C+' || city END AS link
  FROM (SELECT c_custkey AS id, c_custkey % 50 AS search_id, CASE c_custkey % 2 WHEN 0 THEN 'Lagos' ELSE 'Abuja' END AS city FROM customer) a) b
WHERE r = 1 AND id % 5 <> 0 AND id % 11 <> 0 AND (search_id % 3 <> 0 OR city = 'Lagos') AND search_id % 2 = 1 AND id % 7 = 0""")
def nominatim_results_by_terms(spark, sf):
    """The same with expanded terms deciding the intent."""
    return P.nominatim_results(_payloads(spark, sf, _NOM, "customer"), expansions("query", "country")).select("search_id", "title", "link")


_PLACES = """SELECT s_suppkey % 10 AS search_id, CASE s_suppkey % 10 % 3 WHEN 0 THEN 'food bank' WHEN 1 THEN 'investment firm' ELSE 'bank' END AS query, 'ng' AS country, 'Lagos' AS location, s_suppkey AS payload_no,
  '{"results": [{"name": "' || CASE s_suppkey % 4 WHEN 0 THEN 'First Bank ' WHEN 1 THEN 'Food Pantry ' ELSE 'Shop ' END || CAST(s_suppkey AS STRING) || '", "place_id": "p' || CAST(s_suppkey AS STRING) || '", "types": ["' || CASE s_suppkey % 4 WHEN 0 THEN 'bank' WHEN 1 THEN 'meal_takeaway' ELSE 'store' END
  || '"], "vicinity": "Marina", "international_phone_number": "+234 1"' || CASE WHEN s_suppkey % 5 = 0 THEN ', "website": "https://s' || CAST(s_suppkey AS STRING) || '.com"' WHEN s_suppkey % 5 = 1 THEN ', "website": "https://sedo.com/x"' ELSE '' END || '}]}' AS payload FROM supplier"""


@query("""
SELECT id % 10 AS search_id, CASE id % 4 WHEN 0 THEN 'First Bank ' WHEN 1 THEN 'Food Pantry ' ELSE 'Shop ' END || CAST(id AS STRING) AS title, CASE WHEN id % 5 = 0 THEN 'https://s' || CAST(id AS STRING) || '.com' ELSE 'places:p' || CAST(id AS STRING) END AS link,
  'Marina' AS address, '+234 1' AS phone, 'p' || CAST(id AS STRING) AS place_id FROM (SELECT s_suppkey AS id FROM supplier) a
WHERE id % 5 <> 1 AND NOT (id % 10 % 3 = 0 AND id % 4 = 0) AND NOT (id % 10 % 3 = 1 AND id % 4 = 1) AND NOT (id % 10 % 3 = 2 AND id % 4 = 1)""")
def places_results(spark, sf):
    return P.places_results(_payloads(spark, sf, _PLACES, "supplier")).select("search_id", "title", "link", "address", "phone", "place_id")


_WEB = """SELECT p_partkey % 20 AS search_id, 'x' AS query, 'ng' AS country, 'Lagos' AS location, p_partkey AS payload_no,
  CASE p_partkey % 3 WHEN 0 THEN '{"results": [{"url": "' || u || '", "title": "' || p_name || '", "content": "c"}]}' WHEN 1 THEN '{"items": [{"link": "' || u || '", "title": "' || p_name || '", "snippet": "s"}]}'
    ELSE '{"webPages": {"value": [{"url": "' || u || '", "name": "' || p_name || '", "description": "d"}]}}' END AS payload
  FROM (SELECT *, CASE p_partkey % 4 WHEN 0 THEN 'https://p' || CAST(p_partkey AS STRING) || '.com/' WHEN 1 THEN 'ftp://x' WHEN 2 THEN 'https://p.com/listings' ELSE 'http://q' || CAST(p_partkey AS STRING) || '.org' END AS u FROM part) a"""


@query("""
SELECT p_partkey % 20 AS search_id, p_name AS title, CASE p_partkey % 4 WHEN 0 THEN 'https://p' || CAST(p_partkey AS STRING) || '.com/' ELSE 'http://q' || CAST(p_partkey AS STRING) || '.org' END AS link,
  CASE p_partkey % 3 WHEN 0 THEN 'c' WHEN 1 THEN 's' ELSE 'd' END AS snippet FROM part WHERE p_partkey % 4 IN (0, 3)""")
def web_results(spark, sf):
    return P.web_results(_payloads(spark, sf, _WEB, "part"), "searxng").select("search_id", "title", "link", "snippet")


# --- union, dedup, batches -----------------------------------------------------------------------

_RANK = "list_position(" + repr(R.PROVIDER_ORDER) + ", provider)"
_MERGED = f"""merged AS (SELECT * EXCLUDE (r, s) FROM (SELECT *, row_number() OVER (PARTITION BY search_id ORDER BY provider_rank, pos, link) AS s FROM (
  SELECT *, {_RANK} AS provider_rank, row_number() OVER (PARTITION BY search_id, link ORDER BY {_RANK}, pos) AS r FROM v_results) a WHERE r = 1) b WHERE s <= 8)"""


@query(with_views(("v_results",), "SELECT search_id, provider, pos, link, title, provider_rank FROM merged", _MERGED))
def merged_results(spark, sf):
    return RS.merge_providers(L.results(spark, sf), 8).select("search_id", "provider", "pos", "link", "title", "provider_rank")


_DEDUP = f"""keyed AS (SELECT *, CASE WHEN starts_with(link, 'places:') THEN link ELSE {host('link')} END AS k FROM v_results),
deduped AS (SELECT search_id, provider, pos, link, title FROM (SELECT *, row_number() OVER (PARTITION BY search_id, k ORDER BY pos) AS r FROM keyed) a WHERE r = 1)"""


@query(with_views(("v_results",), "SELECT * FROM deduped", _DEDUP))
def dedup_results(spark, sf):
    return RS.dedup_results(L.results(spark, sf)).select("search_id", "provider", "pos", "link", "title")


_COUNTS = ", ".join(f"count(*) FILTER (provider = {q(p)}) AS \"{p}\"" for p in R.PROVIDER_ORDER)


@query(with_views(("v_results",), f"""
SELECT CAST(search_id AS BIGINT) AS search_id, {_COUNTS},
  least(count(DISTINCT link), 12) AS total, CASE WHEN least(count(DISTINCT link), 12) < 12 THEN concat_ws('; ', 'Places disabled',
    CASE WHEN count(*) FILTER (provider <> 'places') < 20 THEN 'DuckDuckGo rate-limited/blocked' END, CASE WHEN count(*) FILTER (provider = 'overpass') = 0 THEN 'Overpass timed out or no results' END) ELSE '' END AS reason_shortfall
FROM v_results GROUP BY search_id"""))
def provider_telemetry(spark, sf):
    return RS.provider_telemetry(L.results(spark, sf), 12, 20, places_key=False)


@query(with_views(("v_results",), """
SELECT search_id, provider, pos, link, r AS rank, CASE WHEN r <= 5 THEN 'initial' ELSE 'backfill' END AS batch FROM (
  SELECT search_id % 40 AS search_id, provider, pos, link, row_number() OVER (PARTITION BY search_id % 40 ORDER BY pos) AS r FROM v_results) a
WHERE r <= CASE WHEN search_id % 3 = 0 THEN 50 ELSE 100 END"""))
def batch_split(spark, sf):
    r = L.results(spark, sf).withColumn("search_id", F.col("search_id") % 40).select("search_id", "provider", "pos", "link")
    return RS.split_batches(r, L.searches(spark, sf), ["pos"], 5).select("search_id", "provider", "pos", "link", "rank", "batch")


@query(with_views(("v_results",), f"""
SELECT search_id AS lead_id, CASE WHEN {host('link')} IS NOT NULL THEN link END AS website FROM (
  SELECT search_id, link, row_number() OVER (PARTITION BY search_id ORDER BY CASE WHEN contains(lower(title), 'company ' || CAST(search_id % 30 AS STRING)) THEN 0 ELSE 1 END, pos) AS r FROM v_results) a WHERE r = 1"""))
def official_sites(spark, sf):
    res = L.results(spark, sf).withColumn("lead_id", F.col("search_id")).drop("search_id")
    comp = res.select("lead_id").distinct().select(
        "lead_id", F.col("lead_id").alias("search_id"), F.concat(F.lit("Company "), (F.col("lead_id") % 30).cast("string")).alias("company_name"))
    return RS.official_sites(comp, res)


_SAVED = """SELECT s_suppkey AS page_id, 'https://search.example.com/' AS url, CASE WHEN s_suppkey % 3 < 2 THEN
  '<div class="result"><h2><a class="result__a" href="/l/?kh=-1&amp;uddg=https%3A%2F%2Fc' || CAST(s_suppkey AS STRING) || '.com%2F">Company ' || CAST(s_suppkey AS STRING) || '</a></h2><div class="result__snippet">About it</div></div><div class="web-result"><h2><a href="https://social.com/user/x">User</a></h2></div>'
  ELSE '<ul><li><a href="https://d' || CAST(s_suppkey AS STRING) || '.com/listings">Directory of companies</a></li><li><a href="https://s.com">short</a></li></ul>' END AS html FROM supplier"""


@query("""
SELECT s_suppkey AS page_id, CASE WHEN s_suppkey % 3 < 2 THEN 'Company ' || CAST(s_suppkey AS STRING) ELSE 'Directory of companies' END AS title,
  CASE WHEN s_suppkey % 3 < 2 THEN 'https://c' || CAST(s_suppkey AS STRING) || '.com/' ELSE 'https://d' || CAST(s_suppkey AS STRING) || '.com/listings' END AS link,
  CASE WHEN s_suppkey % 3 < 2 THEN 'About it' ELSE '' END AS snippet, s_suppkey % 3 = 2 AS fallback, s_suppkey % 3 = 2 AS is_directory FROM supplier""")
def saved_page_results(spark, sf):
    p = _payloads(spark, sf, _SAVED, "supplier")
    return RS.saved_page_results(p).select("page_id", "title", "link", "snippet", "fallback", "is_directory")


_URL = r'https?://[^\s<>()"]+'


@query(f"""
SELECT path, pos, title, link FROM (SELECT path, pos, link, {host('link')} AS title, row_number() OVER (PARTITION BY path ORDER BY pos) AS r FROM (
  SELECT path, link, min(pos) - 1 AS pos FROM (SELECT CAST(page_id AS STRING) AS path, unnest(l) AS link, unnest(range(1, len(l) + 1)) AS pos FROM (
    SELECT page_id, list_filter(l0, lambda x, i: list_position(l0, x) = i) AS l FROM (SELECT page_id, regexp_extract_all(url || ' ' || html, {q(_URL)}) AS l0 FROM pages) z) a) b GROUP BY path, link) c
  WHERE {host('link')} IS NOT NULL AND NOT {rx(host('link'), r'(facebook\.com|instagram\.com|twitter\.com|x\.com|linkedin\.com|youtube\.com|wikipedia\.org)')}) d WHERE r <= 25""")
def raw_byte_links(spark, sf):
    files = table(spark, sf, "pages").select(
        F.col("page_id").cast("string").alias("path"), F.encode(F.concat_ws(" ", "url", "html"), "UTF-8").alias("content"))
    return RS.raw_byte_links(files).select("path", F.col("pos").cast("long").alias("pos"), "title", "link")


