"""Hosts, site flags and names."""

from __future__ import annotations

from pyspark.sql import functions as F

from leadloom import refdata as R
from leadloom.functions import domain as D, url as U
from leadloom.functions.query import category_terms, concept, country_name, expansions, locale, map_tags, parse_query, places_phrase, search_phrase, template_name
from leadloom.plans import query
from leadloom.plans.sql import directory_site, directory_url, domain, e, ex, host, path, placeholder_host, q, rx, social_url, with_views
from leadloom.sources import lead_fixture as L
from leadloom.sources.fixtures import table, view


@query(with_views(("v_leads",), f"""
SELECT lead_id, {domain('website')} AS domain, {host('website')} AS host, {path('website')} AS path,
       {domain('website')} = {domain("'https://www.c' || CAST(k AS STRING) || '.com'")} AND {domain('website')} <> '' AS is_main_site
FROM v_leads"""))
def normalize_urls(spark, sf):
    v = view(spark, sf, "v_leads")
    main = F.concat(F.lit("https://www.c"), F.col("k").cast("string"), F.lit(".com"))
    return v.select("lead_id", U.bare_domain("website").alias("domain"), U.url_host("website").alias("host"),
                    F.when(F.col("website").isNotNull(), U.url_path("website")).alias("path"),
                    U.same_domain("website", main).alias("is_main_site"))


_BLOCKED = ", ".join(q(b) for b in R.BLOCKED_PLATFORMS)
_KNOWN = " OR ".join(f"contains(h, {q(k)})" for k in R.KNOWN_DIRECTORIES)


@query(with_views(("v_leads",), f"""
SELECT src, id, {placeholder_host('h')} AS placeholder, {placeholder_host('h', ('example',))} AS placeholder_no_example,
       coalesce(h IN ({_BLOCKED}), false) AS blocked, coalesce({_KNOWN}, false) AS known_directory, {social_url('u')} AS social
FROM (SELECT *, {host('u')} AS h FROM (
    SELECT 'lead' AS src, lead_id AS id, website AS u FROM v_leads UNION ALL SELECT 'page', page_id, url FROM pages) a) b"""))
def domain_flags(spark, sf):
    u = view(spark, sf, "v_leads").select(F.lit("lead").alias("src"), F.col("lead_id").alias("id"), F.col("website").alias("u"))
    u = u.unionByName(table(spark, sf, "pages").select(F.lit("page").alias("src"), F.col("page_id").alias("id"), F.col("url").alias("u")))
    h = U.url_host("u")
    return u.select("src", "id", D.is_placeholder_host(h).alias("placeholder"),
                    D.is_placeholder_host(h, ("example",)).alias("placeholder_no_example"),
                    D.is_blocked_platform(h).alias("blocked"), D.is_known_directory(h).alias("known_directory"),
                    D.is_social_url("u").alias("social"))


_TITLED = """SELECT 'lead' AS src, lead_id AS id, website AS u, company_name AS t FROM v_leads
    UNION ALL SELECT 'page', page_id, url, NULL FROM pages
    UNION ALL SELECT 'part', p_partkey, 'https://www.c' || CAST(p_partkey % 50 AS STRING) || '.com/top-' || CAST(p_partkey % 3 AS STRING) || '/' || p_type,
        CASE p_partkey % 4 WHEN 0 THEN 'Top 10 ' || p_name || ' companies in Lagos' WHEN 1 THEN p_name || ' ranking' ELSE p_name END FROM part
    UNION ALL SELECT 'supplier', s_suppkey, 'https://' || CASE s_suppkey % 6 WHEN 0 THEN 'businessdirectory' WHEN 1 THEN 'hubspot' WHEN 2 THEN 'www.yelp'
        WHEN 3 THEN 'sedo' WHEN 4 THEN 'mapplaces' ELSE 'acme' END || CAST(s_suppkey % 7 AS STRING) || '.com/about', s_name || ' is for sale' FROM supplier"""


@query(with_views(("v_leads",), f"""
SELECT src, id, {directory_site('u')} AS by_url, {directory_site('u', 't')} AS by_title, {directory_url('u')} AS by_url_strict
FROM ({_TITLED}) x"""))
def directory_flags(spark, sf):
    c, s = F.col, F.lit
    lead = view(spark, sf, "v_leads").select(s("lead").alias("src"), c("lead_id").alias("id"), c("website").alias("u"), c("company_name").alias("t"))
    page = table(spark, sf, "pages").select(s("page").alias("src"), c("page_id").alias("id"), c("url").alias("u"), F.lit(None).cast("string").alias("t"))
    k = c("p_partkey")
    part = table(spark, sf, "part").select(
        s("part").alias("src"), k.alias("id"),
        F.concat(s("https://www.c"), (k % 50).cast("string"), s(".com/top-"), (k % 3).cast("string"), s("/"), c("p_type")).alias("u"),
        F.when(k % 4 == 0, F.concat(s("Top 10 "), c("p_name"), s(" companies in Lagos")))
        .when(k % 4 == 1, F.concat(c("p_name"), s(" ranking"))).otherwise(c("p_name")).alias("t"))
    n = c("s_suppkey")
    label = (F.when(n % 6 == 0, "businessdirectory").when(n % 6 == 1, "hubspot").when(n % 6 == 2, "www.yelp").when(n % 6 == 3, "sedo")
             .when(n % 6 == 4, "mapplaces").otherwise("acme"))
    supplier = table(spark, sf, "supplier").select(
        s("supplier").alias("src"), n.alias("id"), F.concat(s("https://"), label, (n % 7).cast("string"), s(".com/about")).alias("u"),
        F.concat(c("s_name"), s(" is for sale")).alias("t"))
    rows = lead.unionByName(page).unionByName(part).unionByName(supplier)
    return rows.select("src", "id", D.is_directory_site("u").alias("by_url"), D.is_directory_site("u", "t").alias("by_title"),
                       D.is_directory_url("u").alias("by_url_strict"))


_PLATFORMS = [p for p, _ in R.SOCIAL_HOSTS if p != "x"]


@query(f"""
SELECT platform, count(*) AS n FROM (
  SELECT CASE {' '.join(f"WHEN {rx('h', p if p != 'twitter' else 'twitter|x[.]com')} THEN {q(p)}" for p in _PLATFORMS)} END AS platform
  FROM (SELECT {host('u')} AS h FROM (SELECT 'https://www.' || CASE l_orderkey % 7 WHEN 0 THEN 'facebook' WHEN 1 THEN 'x' WHEN 2 THEN 'linkedin'
        WHEN 3 THEN 'discord' WHEN 4 THEN 'acme' WHEN 5 THEN 'tiktok' ELSE 'm.youtube' END || '.com/p' || CAST(l_linenumber AS STRING) AS u FROM lineitem) a) b) c
GROUP BY platform""")
def social_platform_counts(spark, sf):
    k = F.col("l_orderkey") % 7
    label = (F.when(k == 0, "facebook").when(k == 1, "x").when(k == 2, "linkedin").when(k == 3, "discord").when(k == 4, "acme")
             .when(k == 5, "tiktok").otherwise("m.youtube"))
    u = F.concat(F.lit("https://www."), label, F.lit(".com/p"), F.col("l_linenumber").cast("string"))
    return table(spark, sf, "lineitem").select(U.social_platform(u).alias("platform")).groupBy("platform").agg(F.count(F.lit(1)).alias("n"))


_NAMES = """SELECT c_custkey AS id, CASE c_custkey % 12 WHEN 0 THEN 'Home' WHEN 1 THEN c_name WHEN 2 THEN 'ChIJ9TCVpbKNOxARdEJJj7-rgEE'
   WHEN 3 THEN 'Coming Soon' WHEN 4 THEN 'N/A' WHEN 5 THEN '12-34.5' WHEN 6 THEN 'domain for sale' WHEN 7 THEN 'Welcome to ' || c_name
   WHEN 8 THEN 'How to open a restaurant' WHEN 9 THEN 'x' WHEN 10 THEN 'John Smith' ELSE c_name || ' company' END AS name,
   CASE WHEN c_custkey % 3 = 0 THEN 'https://acme.com/blog/a' ELSE 'https://acme.com/about' END AS url FROM customer"""


def _names(spark, sf):
    return spark.sql(_NAMES.replace("FROM customer", f"FROM parquet.`{sf}/customer.parquet`"))


_WORDS = " OR ".join(f"n = {q(w)} OR starts_with(n, {q(w + ' ')}) OR ends_with(n, {q(' ' + w)})" for w in R.GENERIC_NAMES)


@query(f"""
SELECT id, length(name) < 2 OR {rx('n', D.GENERIC_PATTERN)} OR n = 'web' AS generic,
  length(name) < 2 OR {_WORDS} OR {rx('n', r'is\s+for\s+sale|for\s+sale|domain\s+sale|buy\s+domain|premium\s+domain|hugedomains|domain.*profile|domain.*marketplace')} OR n = 'web' AS generic_page,
  starts_with(name, 'ChIJ') AND length(name) > 20 AND {rx('name', '^[A-Za-z0-9_-]+$')} AS place_id,
  length(trim(name)) BETWEEN 2 AND 200 AND NOT {rx('trim(name)', r'^[\d\s\-_.]+$')} AND n NOT IN ('unknown', 'n/a', 'null') AS valid,
  {rx('name', D.ARTICLE_WORDS)} AND ({rx('name', D.TRADE_WORDS)} OR contains(url, '/blog/')) AS article,
  {rx('name', '^[A-Z][a-z]+ [A-Z][a-z]+( [A-Z][a-z]+)?$')} AS person
FROM (SELECT *, lower(trim(name)) AS n FROM ({_NAMES}) a) b""")
def company_name_flags(spark, sf):
    return _names(spark, sf).select(
        "id", D.is_generic_name("name").alias("generic"), D.is_generic_page_name("name").alias("generic_page"),
        D.is_place_id("name").alias("place_id"), D.is_valid_company_name("name").alias("valid"),
        D.is_article("name", "url").alias("article"), D.is_person_query("name").alias("person"))


@query(f"""
SELECT reason, is_relevant, confidence, keep, count(*) AS n FROM (
  SELECT *, NOT (NOT is_relevant AND confidence > 0.7) AS keep FROM (
    SELECT CASE WHEN bad THEN 'Obvious irrelevant business type (domain marketplace, placeholder, etc.)' WHEN i = '' THEN 'Generic query, accepting any legitimate business'
             WHEN hit THEN 'Contains industry keywords' ELSE 'No industry keywords found' END AS reason,
           CASE WHEN bad THEN false WHEN i = '' THEN true ELSE hit END AS is_relevant,
           CASE WHEN bad THEN 0.8 WHEN i = '' THEN 0.6 WHEN hit THEN 0.7 ELSE 0.5 END AS confidence
    FROM (SELECT {rx('t', D.IRRELEVANT_PATTERN)} AS bad, i, contains(t, i) OR list_bool_or([contains(t, w) FOR w IN string_split(i, ' ')]) AS hit
      FROM (SELECT lower(name) AS t, CASE id % 5 WHEN 0 THEN '' WHEN 1 THEN 'restaurant food' WHEN 2 THEN 'customer' ELSE 'smith works' END AS i FROM ({_NAMES}) a) b) c) d) e
GROUP BY ALL""")
def relevance_counts(spark, sf):
    k = F.col("id") % 5
    wanted = F.when(k == 0, "").when(k == 1, "restaurant food").when(k == 2, "customer").otherwise("smith works")
    v = D.relevance("name", F.lit(None).cast("string"), F.array().cast("array<string>"), wanted)
    rows = _names(spark, sf).select(v.alias("v"))
    return rows.select("v.*", D.keep_relevant(F.col("v")).alias("keep")).groupBy("reason", "is_relevant", "confidence", "keep").agg(
        F.count(F.lit(1)).alias("n"))


_LINKS = """SELECT p_partkey AS id, 'https://www.google.com/search?q=' || replace(p_name, ' ', '+') || '+store+in+Lagos,Nigeria' AS link FROM part"""


@query(f"""
SELECT id, loc AS location, list_aggregate(list_transform(string_split(n2, ' '), lambda w: upper(w[1]) || lower(w[2:])), 'string_agg', ' ') AS name FROM (
  SELECT id, trim({ex('t', r'(?i)\s+(?:in|at|near|around)\s+([^,]+)')}) AS loc,
         trim(regexp_replace(regexp_replace({ex('t', '^([^,]*)')}, '(?i)\\b({'|'.join(R.QUERY_LINK_NAME_NOISE)})\\b', '', 'g'), '\\s+', ' ', 'g')) AS n2
  FROM (SELECT id, replace({ex('link', '[?&]q=([^&]+)')}, '+', ' ') AS t FROM ({_LINKS}) a) b) c""")
def query_link_parts(spark, sf):
    rows = spark.sql(_LINKS.replace("FROM part", f"FROM parquet.`{sf}/part.parquet`"))
    return rows.select("id", U.query_link_location("link").alias("location"), U.query_link_name("link").alias("name"))


_PLAUSIBLE = """SELECT s_suppkey AS id, CASE s_suppkey % 3 WHEN 0 THEN s_name || ' official site' WHEN 1 THEN 'acme trading in lagos' ELSE 'ab' END AS query,
  CASE s_suppkey % 5 WHEN 0 THEN 'https://www.supplier' || CAST(s_suppkey AS STRING) || '.com' WHEN 1 THEN 'https://acme.co' WHEN 2 THEN 'https://navy.mil'
    WHEN 3 THEN 'https://example.com' ELSE 'https://other.org/x' END AS url FROM supplier"""


@query(f"""
SELECT id, h IS NOT NULL AND NOT {directory_url('url')} AND NOT {rx('h', r'(^|\.)(localhost|127\.0\.0\.1|0\.0\.0\.0|example\.com|test\.com|placeholder\.com|domain\.com|website\.com|site\.com)$')}
  AND NOT {rx('h', r'\.(mil|gov)$')}
  AND NOT (len(ws) > 0 AND len([w FOR w IN ws IF len([p FOR p IN ps IF contains(p, w) OR contains(w, p)]) > 0]) = 0 AND len([w FOR w IN ws IF length(w) > 3]) > 0) AS plausible
FROM (SELECT *, [w FOR w IN regexp_split_to_array(regexp_replace(regexp_replace(lower(query), '\\s+official\\s+site', '', 'g'), '\\b(in|at|near|around|within|from|the|a|an|and|or|of|for|to)\\b', '', 'g'), '\\s+') IF length(w) > 2] AS ws,
        [p FOR p IN string_split(h, '.') IF length(p) > 2] AS ps
      FROM (SELECT *, {host('url')} AS h FROM ({_PLAUSIBLE}) a) b) c""")
def plausible_sites(spark, sf):
    rows = spark.sql(_PLAUSIBLE.replace("FROM supplier", f"FROM parquet.`{sf}/supplier.parquet`"))
    return rows.select("id", D.is_plausible_site("query", "url").alias("plausible"))


# --- queries -------------------------------------------------------------------------------------

_SEARCH = with_views(("v_searches",), "{body}", """qs AS (SELECT search_id, location, CASE search_id % 6 WHEN 0 THEN 'coffee shops in New York' WHEN 1 THEN 'real estate companies near Lagos, Nigeria'
  WHEN 2 THEN 'food bank' WHEN 3 THEN 'hospitals' WHEN 4 THEN 'credit union bank' ELSE 'the plumbers of Accra' END AS query,
  CASE search_id % 4 WHEN 0 THEN 'ng' WHEN 1 THEN 'pt' WHEN 2 THEN 'mx' ELSE 'fr' END AS country FROM v_searches)""")


def _search_rows(spark, sf):
    v = view(spark, sf, "v_searches").select("search_id", "location")
    k, c = F.col("search_id") % 6, F.col("search_id") % 4
    return v.select(
        "*", F.when(k == 0, "coffee shops in New York").when(k == 1, "real estate companies near Lagos, Nigeria").when(k == 2, "food bank")
        .when(k == 3, "hospitals").when(k == 4, "credit union bank").otherwise("the plumbers of Accra").alias("query"),
        F.when(c == 0, "ng").when(c == 1, "pt").when(c == 2, "mx").otherwise("fr").alias("country"))


@query(_SEARCH.replace("{body}", f"""
SELECT search_id, coalesce(location, nullif(loc, '')) AS location, nullif({ex('lower(rest)', '(companies|businesses|firms|organizations|enterprises)')}, '') AS industry,
  CASE WHEN length(cleaned) < 3 THEN query ELSE cleaned END AS cleaned_query
FROM (SELECT *, array_to_string([w FOR w IN regexp_split_to_array(trim(regexp_replace(rest, '(?i)(companies|businesses|firms|organizations|enterprises)', '', 'g')), '\\s+')
        IF w <> '' AND NOT list_contains({R.QUERY_STOPWORDS!r}, lower(w))], ' ') AS cleaned
  FROM (SELECT *, trim({ex('query', r'(?i)^.*\b(?:in|at|near|around|within|from)\s+([A-Za-z][A-Za-z\s]*)')}) AS loc,
          trim(regexp_replace(query, '(?i)^(.*)\\b(?:in|at|near|around|within|from)\\s+[A-Za-z][A-Za-z\\s]*,?', '\\1')) AS rest FROM qs) a) b"""))
def parsed_queries(spark, sf):
    none = F.lit(None).cast("string")
    rows = _search_rows(spark, sf).select("search_id", parse_query("query", "country", "location", none).alias("p"))
    return rows.select("search_id", "p.location", "p.industry", "p.cleaned_query")


@query(_SEARCH.replace("{body}", """
SELECT search_id, CASE WHEN contains(query, 'coffee') THEN 'Cafe' WHEN contains(query, 'real estate') THEN 'RealEstateAgency' WHEN contains(query, 'bank') THEN 'Bank'
    WHEN contains(query, 'hospital') THEN 'Hospital' END AS concept,
  CASE country WHEN 'pt' THEN 'pt' WHEN 'mx' THEN 'es' WHEN 'fr' THEN 'fr' ELSE 'en' END AS locale,
  query || coalesce(' ' || location, '') || ' site:' || country || ' business company' AS search_phrase,
  CASE WHEN contains(query, ' ') THEN '"' || query || '"' ELSE query END || coalesce(' ' || location, '') || ' ' ||
    CASE country WHEN 'ng' THEN 'Nigeria' WHEN 'pt' THEN 'Portugal' WHEN 'mx' THEN 'Mexico' ELSE 'France' END AS places_phrase,
  CASE country WHEN 'ng' THEN 'Nigeria' WHEN 'pt' THEN 'Portugal' WHEN 'mx' THEN 'Mexico' ELSE 'France' END AS country_name,
  query || coalesce(' - ' || location, '') AS template_name,
  CASE search_id % 6 WHEN 1 THEN 'office=estate_agent' WHEN 2 THEN 'social_facility=food_bank,social_facility=soup_kitchen' WHEN 3 THEN 'amenity=hospital,healthcare=hospital,building=hospital'
    WHEN 4 THEN 'amenity=bank' ELSE '' END AS map_tags
FROM qs"""))
def query_terms(spark, sf):
    return _search_rows(spark, sf).select(
        "search_id", concept("query").alias("concept"), locale("country").alias("locale"),
        search_phrase("query", "country", "location").alias("search_phrase"),
        places_phrase("query", "country", "location").alias("places_phrase"), country_name("country").alias("country_name"),
        template_name(F.lit(None).cast("string"), "query", "location").alias("template_name"),
        F.array_join(map_tags("query"), ",").alias("map_tags"))


@query(_SEARCH.replace("{body}", """
SELECT search_id, unnest(list_slice(list_distinct_ordered, 1, 8)) AS term, generate_subscripts(list_slice(list_distinct_ordered, 1, 8), 1) AS rank FROM (
  SELECT search_id, list_filter(l3, lambda x, i: list_position(l3, x) = i) AS list_distinct_ordered FROM (
    SELECT search_id, list_concat(l2, list_transform(l2, lambda x: strip_accents(lower(x)))) AS l3 FROM (
      SELECT search_id, CASE WHEN base IS NULL THEN [query] ELSE list_concat(l1, [x || 's' FOR x IN l1 IF NOT ends_with(x, 's')]) END AS l2 FROM (
        SELECT *, list_filter(l0, lambda x, i: list_position(l0, x) = i) AS l1 FROM (
          SELECT search_id, query, base, list_concat([query], coalesce(base, []), coalesce(CASE country
              WHEN 'pt' THEN CASE search_id % 6 WHEN 0 THEN ['café', 'cafeteria', 'torrefação'] WHEN 1 THEN ['imobiliária', 'agência imobiliária', 'corretor'] WHEN 3 THEN ['hospital', 'centro médico', 'clínica'] WHEN 5 THEN [] ELSE ['banco'] END
              WHEN 'mx' THEN CASE search_id % 6 WHEN 0 THEN ['cafetería', 'tostaduría'] WHEN 1 THEN ['inmobiliaria', 'agencia inmobiliaria', 'corredor'] WHEN 3 THEN ['hospital', 'centro médico', 'clínica'] WHEN 5 THEN [] ELSE ['banco'] END
              WHEN 'fr' THEN CASE search_id % 6 WHEN 0 THEN ['café', 'cafétéria'] ELSE [] END END, [])) AS l0
          FROM (SELECT *, CASE search_id % 6 WHEN 0 THEN ['coffee shop', 'cafe', 'café', 'cafeteria', 'roastery', 'espresso bar'] WHEN 1 THEN ['real estate', 'estate agent', 'realtor', 'property agency']
                 WHEN 3 THEN ['hospital', 'medical center', 'clinic'] WHEN 5 THEN NULL ELSE ['bank', 'commercial bank', 'retail bank'] END AS base FROM qs) a) b) c) d) e) f"""))
def query_expansions(spark, sf):
    rows = _search_rows(spark, sf)
    return rows.select("search_id", F.posexplode(expansions("query", "country")).alias("i", "term")).select(
        "search_id", "term", (F.col("i") + 1).alias("rank"))


@query(_SEARCH.replace("{body}", f"""
SELECT search_id, len(l) AS terms, array_to_string(l, '|') AS list FROM (
  SELECT search_id, list_concat([query], CASE search_id % 6 WHEN 3 THEN list_concat(['medical center', 'healthcare group'], CASE country WHEN 'pt' THEN {R.CATEGORY_TERMS[0][3]!r} WHEN 'mx' THEN {R.CATEGORY_TERMS[0][2]!r} ELSE [] END)
    WHEN 1 THEN list_concat({R.CATEGORY_TERMS[2][1]!r}, CASE country WHEN 'pt' THEN {R.CATEGORY_TERMS[2][3]!r} WHEN 'mx' THEN {R.CATEGORY_TERMS[2][2]!r} ELSE [] END) ELSE [] END) AS l FROM qs) a"""))
def category_term_lists(spark, sf):
    t = category_terms("query", "country")
    return _search_rows(spark, sf).select("search_id", F.size(t).alias("terms"), F.array_join(t, "|").alias("list"))


