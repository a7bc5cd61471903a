"""Links, contacts and classification of pages."""

from __future__ import annotations

from pyspark.sql import functions as F

from leadloom import refdata as R
from leadloom.operators import pages as P
from leadloom.plans import query
from leadloom.plans.sql import directory_site, ex, host, path, q, rx, with_views
from leadloom.sources import lead_fixture as L
from leadloom.sources.fixtures import table


def _from(spark, sf, sql: str, name: str):
    return spark.sql(sql.replace(f"FROM {name}", f"FROM parquet.`{sf}/{name}.parquet`"))


_ALL = """all_pages AS (SELECT page_id, url, html FROM pages UNION ALL SELECT page_id + 10000000, url, html FROM v_site_pages)"""
_A = r"""(?is)<a\s[^>]*?href\s*=\s*["']([^"']*)["'][^>]*>(.*?)</a>"""


@query(with_views(("v_site_pages",), f"""
SELECT page_id, pos, href, text, {host('href')} AS host, coalesce({rx('href', '(?i)^https?://')} AND {host('href')} <> {host('url')}, false) AS is_external FROM (
  SELECT page_id, url, pos, trim({ex('a', _A)}) AS href, trim(regexp_replace(regexp_replace({ex('a', _A, 2)}, '(?s)<[^>]*>', ' ', 'g'), '\\s+', ' ', 'g')) AS text FROM (
    SELECT page_id, url, unnest(l) AS a, CAST(unnest(range(0, len(l))) AS INT) AS pos FROM (SELECT page_id, url, regexp_extract_all(html, {q(_A)}) AS l FROM all_pages) x) y) z""", _ALL))
def page_links(spark, sf):
    return P.page_links(L.all_pages(spark, sf)).select("page_id", "pos", "href", "text", "host", "is_external")


@query(with_views(("v_site_pages",), f"""
SELECT page_id, candidate FROM (
  SELECT page_id, candidate, row_number() OVER (PARTITION BY page_id ORDER BY pos) AS r FROM (
    SELECT page_id, candidate, min(pos) AS pos FROM (
      SELECT page_id, 0 AS pos, 'https://www.c' || CAST(page_id AS STRING) || '.com/team' AS candidate FROM v_site_pages
      UNION ALL SELECT page_id, 1000000 + p.i, 'https://www.c' || CAST(page_id AS STRING) || '.com' || p.path FROM v_site_pages,
        (SELECT unnest({R.TEAM_PATHS!r}) AS path, unnest(range(0, {len(R.TEAM_PATHS)})) AS i) p) a GROUP BY ALL HAVING true) b) c WHERE r <= 10""").replace(" GROUP BY ALL HAVING true", " GROUP BY page_id, candidate"))
def team_page_candidates(spark, sf):
    return P.team_page_candidates(L.site_pages(spark, sf)).select("page_id", "candidate")


_MAPS = """SELECT s_suppkey AS site_id, '<urlset><loc>https://s' || CAST(s_suppkey AS STRING) || '.com/About</loc><loc>https://s' || CAST(s_suppkey AS STRING) || '.com/p</loc><loc> https://s' || CAST(s_suppkey AS STRING) || '.com/our-team </loc></urlset>' AS xml FROM supplier"""


@query("""SELECT s_suppkey AS site_id, 'https://s' || CAST(s_suppkey AS STRING) || '.com/About' AS url FROM supplier
UNION ALL SELECT s_suppkey, 'https://s' || CAST(s_suppkey AS STRING) || '.com/our-team' FROM supplier""")
def sitemap_team_pages(spark, sf):
    return P.sitemap_team_pages(_from(spark, sf, _MAPS, "supplier")).select("site_id", "url")


@query(with_views(("v_site_pages",), """
SELECT page_id, 'c' || CAST(page_id AS STRING) || '.com' AS domain, 'C' || CAST(page_id AS STRING) || ' Trading' AS company_name, 'https://www.c' || CAST(page_id AS STRING) || '.com/' AS website,
  'jane.smith@c' || CAST(page_id AS STRING) || '.com;sales@c' || CAST(page_id AS STRING) || '.com' AS emails, '+2348031234567' AS phones, 'https://linkedin.com/company/c' || CAST(page_id AS STRING) AS linkedin,
  trim(regexp_extract(html, 'class="address">([^<]*)<', 1)) AS address, regexp_extract(html, 'name="description" content="([^"]*)"', 1) AS about_text FROM v_site_pages"""))
def page_contacts(spark, sf):
    c = P.extract_contacts(L.site_pages(spark, sf))
    return c.select("page_id", "domain", "company_name", "website", F.array_join(F.transform("emails", lambda m: m["email"]), ";").alias("emails"),
                    F.array_join(F.transform("phones", lambda p: p["phone"]), ";").alias("phones"), F.col("socials.linkedin").alias("linkedin"),
                    "address", "about_text")


@query()
def crawled_page_contacts(spark, sf):
    """All fields over the driver's crawl, where placeholder hosts are allowed."""
    c = P.extract_contacts(L.all_pages(spark, sf), allow=("example",))
    return c.select("page_id", "domain", "company_name", "website", F.size("emails").alias("emails"), F.size("phones").alias("phones"),
                    "address", F.length("about_text").alias("about_length"), F.size("category_signals").alias("signals"))


_TEXT = r"regexp_replace(regexp_replace(regexp_replace({h}, '(?is)<script[^>]*>.*?</script>', '', 'g'), '(?is)<style[^>]*>.*?</style>', '', 'g'), '(?s)<[^>]*>', ' ', 'g')"


@query(f"""
SELECT page_id, array_to_string([w FOR w IN {R.CATEGORY_WORDS!r} IF contains(t, w)], ',') AS signals, title FROM (
  SELECT page_id, lower({_TEXT.format(h='html')}) AS t, nullif(trim(regexp_replace(regexp_replace({ex('html', r'(?is)<title(?:\s[^>]*)?>(.*?)</title>')}, '(?s)<[^>]*>', '', 'g'), '\\s+', ' ', 'g')), '') AS title FROM pages) a""")
def page_text_fields(spark, sf):
    p = table(spark, sf, "pages")
    return p.select("page_id", F.array_join(P.category_signals(P.visible_text("html")), ",").alias("signals"), P.tag_text("html", "title").alias("title"))


@query(with_views(("v_site_pages",), """
SELECT page_id, 2 AS score, 'schema:localbusiness' AS reasons, true AS is_first_party, 2 AS external_links, 3 AS internal_links, 2 AS external_hosts FROM v_site_pages"""))
def site_classification(spark, sf):
    c = P.classify_sites(L.site_pages(spark, sf))
    return c.select("page_id", "score", F.array_join("reasons", ",").alias("reasons"), "is_first_party", "external_links", "internal_links", "external_hosts")


_RELATIVE = f"""SELECT page_id, url, lower({ex('html', '(?is)<title>(.*?)</title>')}) AS title, len(regexp_extract_all(html, '(?i)<li[ >]')) AS list_items,
  len(regexp_extract_all(html, '(?i)<(ul|ol)[ >]')) AS lists, len(regexp_extract_all(html, '(?i)<a [^>]*href')) AS internal_links FROM pages"""


@query(f"""
SELECT page_id, list_items, lists, internal_links, {rx(path('url'), r'(^|/)(category|tags|companies|agencies|directory|list|locations|explore|ranking|rankings|rank)(/|$)')} AS list_path FROM ({_RELATIVE}) a""")
def page_structure(spark, sf):
    s = P.page_structure(table(spark, sf, "pages"))
    from leadloom.functions.url import url_path
    return s.select("page_id", "list_items", "lists", "internal_links",
                    url_path("url").rlike(r"(^|/)(category|tags|companies|agencies|directory|list|locations|explore|ranking|rankings|rank)(/|$)").alias("list_path"))


_LISTS = """SELECT s_suppkey AS page_id, 'https://top.example.org/list/' || CAST(s_suppkey AS STRING) AS url, 30 + s_suppkey AS result_count,
  '<script type="application/ld+json">{"@type": "ItemList", "itemListElement": [{"@type": "ListItem", "item": {"@type": "Organization", "name": "Org ' || CAST(s_suppkey AS STRING) || '", "url": "https://org' || CAST(s_suppkey AS STRING) || '.com/a"}}]}</script><div class="card"><h3>Card</h3><a href="https://card' || CAST(s_suppkey AS STRING) || '.com/x"></a></div>'
  || '<ul><li><a href="https://org' || CAST(s_suppkey AS STRING) || '.com/b">Again</a></li><li><a href="https://facebook.com/x">fb</a></li><li><a href="https://li' || CAST(s_suppkey AS STRING) || '.com/">Top companies</a></li><li><a href="https://yelp.com/z">Y</a></li></ul>'
  || '<p><a href="/own">own</a> <a href="https://free' || CAST(s_suppkey AS STRING) || '.com/">Free ' || CAST(s_suppkey AS STRING) || '</a> <a href="https://bad.com/best/x">bad</a></p>' AS html FROM supplier"""


@query("""
SELECT s_suppkey AS page_id, 1 AS strategy, 'Org ' || CAST(s_suppkey AS STRING) AS title, 'https://org' || CAST(s_suppkey AS STRING) || '.com/a' AS link FROM supplier
UNION ALL SELECT s_suppkey, 2, 'Card', 'https://card' || CAST(s_suppkey AS STRING) || '.com/x' FROM supplier
UNION ALL SELECT s_suppkey, 3, 'Free ' || CAST(s_suppkey AS STRING), 'https://free' || CAST(s_suppkey AS STRING) || '.com/' FROM supplier""")
def directory_expansion(spark, sf):
    return P.expand_directories(_from(spark, sf, _LISTS, "supplier")).select("page_id", "strategy", "title", "link")


@query(with_views(("v_site_pages",), f"""
SELECT page_id, 'Partner' AS title, 'https://partner' || CAST(page_id % 9 AS STRING) || '.com/x' AS link FROM v_site_pages
WHERE NOT {directory_site("'https://partner.com/x'", "'Partner'")}"""))
def expanded_site_links(spark, sf):
    return P.expand_directories(L.site_pages(spark, sf)).select("page_id", "title", "link")


@query(f"""
SELECT DISTINCT domain, lower(m) AS email FROM (SELECT {host('url')} AS domain, unnest(regexp_extract_all(html, '\\b[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\\.[A-Za-z]{{2,}}\\b')) AS m
  FROM (SELECT 'https://www.s' || CAST(doc_id % 20 AS STRING) || '.com/' || CASE doc_id % 3 WHEN 0 THEN 'contact/' WHEN 1 THEN 'contact-us' ELSE 'about' END AS url, text AS html FROM documents) a WHERE NOT ends_with(url, 'about')) b
WHERE NOT {rx('lower(m)', 'noreply|no-reply|donotreply')}""")
def contact_page_emails(spark, sf):
    k = F.col("doc_id") % 3
    d = table(spark, sf, "documents").select(
        F.concat(F.lit("https://www.s"), (F.col("doc_id") % 20).cast("string"), F.lit(".com/"),
                 F.when(k == 0, "contact/").when(k == 1, "contact-us").otherwise("about")).alias("url"), F.col("text").alias("html"))
    return P.contact_page_emails(d)


@query("""
SELECT min(page_id) AS page_id, url FROM (SELECT page_id, regexp_replace(url, '[0-9]+', '', 'g') AS url FROM pages) a GROUP BY url""")
def distinct_pages(spark, sf):
    p = table(spark, sf, "pages").select("page_id", F.regexp_replace("url", "[0-9]+", "").alias("url"), "html")
    return P.distinct_pages(p).select("page_id", "url")


_CRAWLED = """SELECT s_suppkey * 4 AS page_id, 'https://www.c' || CAST(s_suppkey AS STRING) || '.com/' AS url, '<nav><a href="/our-people?x=1">People</a><a href="https://partner.org/team/">Partner team</a><a href="/shop">Shop</a></nav><p><a href="/staff-list">staff</a></p>' AS html FROM supplier
UNION ALL SELECT s_suppkey * 4 + 1, 'http://c' || CAST(s_suppkey AS STRING) || '.com/Our-People/', '' FROM supplier WHERE s_suppkey % 2 = 0
UNION ALL SELECT s_suppkey * 4 + 2, 'https://c' || CAST(s_suppkey AS STRING) || '.com/team#top', '' FROM supplier WHERE s_suppkey % 3 = 0
UNION ALL SELECT s_suppkey * 4 + 3, 'https://c' || CAST(s_suppkey AS STRING) || '.com/staff-list', '' FROM supplier
UNION ALL SELECT -1, 'https://partner.org/team', '' FROM supplier WHERE s_suppkey = 1 UNION ALL SELECT -2, 'http://www.partner.org:80/team?q=2', '' FROM supplier WHERE s_suppkey = 1"""


@query("""
SELECT s_suppkey * 4 AS page_id, s_suppkey * 4 + 1 AS team_page_id FROM supplier WHERE s_suppkey % 2 = 0
UNION ALL SELECT s_suppkey * 4, s_suppkey * 4 + 2 FROM supplier WHERE s_suppkey % 3 = 0
UNION ALL SELECT s_suppkey * 4 + CAST(d AS BIGINT), s_suppkey * 4 + 2 FROM supplier, (VALUES (1), (3)) v(d) WHERE s_suppkey % 3 = 0 AND (d = 3 OR s_suppkey % 2 = 0)
UNION ALL SELECT s_suppkey * 4, -2 FROM supplier UNION ALL SELECT -1, -2 FROM supplier WHERE s_suppkey = 1""")
def chosen_team_pages(spark, sf):
    """Team pages that were crawled, by links in navigation and by fixed paths."""
    return P.team_pages(_from(spark, sf, _CRAWLED, "supplier")).select("page_id", "team_page_id")


# --- pages on which one rule each decides ----------------------------------------------------------

def _many(n: int, piece: str) -> str:
    """``piece`` n times, with the number in place of #."""
    return "".join(piece.replace("#", str(i)) for i in range(n))


_OUT = '<a href="https://h#.org/">x</a>'
_RULE_PAGES = [  # host and path, html, score, reasons
    ("bizinfo.org/", "", -3, "domain:keyword"),
    ("yellowbook.org/directory/x", "", -7, "domain:keyword,path:listlike"),
    ("plain.org/category/a", "", -2, "path:listlike"),
    ("plain.org/top-10-shops", "", -2, "path:ranked"),
    ("www.sedo.com/x", "", -5, "domain:marketplace"),
    ("plain.org/5", "<title>List of shops</title>", -2, "title:listlike"),
    ("plain.org/6", "<title>acme is for sale</title>", -5, "title:domain_sale"),
    ("plain.org/7", "<title>Shop directory</title>" + _many(12, _OUT), -4, "title:listlike,links:many-external"),
    ("plain.org/8", _many(21, _OUT), -3, "links:very-many-external"),
    ("plain.org/9", "<title>Shop directory</title>" + _many(5, "<ul>" + "<li>y</li>" * 20 + "</ul>"), -4, "title:listlike,structure:many-lists"),
    ("plain.org/10", "<title>Shop directory</title>" + _many(20, '<div class="my-card">z</div>'), -3, "title:listlike,structure:card-layout"),
    ("plain.org/11", _many(5, "<button>View profile</button>"), -2, "content:profile-buttons"),
    ("plain.org/12", _many(10, "<p>Acme Foods - Lagos</p>"), -2, "content:company-patterns"),
    ("plain.org/13", '<script type="application/ld+json">{"@type":"CollectionPage"}</script>', -3, "schema:itemList"),
    ("plain.org/14", '<script type="application/ld+json">{"@type":"WebPage","itemListElement":[{"a":1},{"a":2},{"a":3},{"a":4},{"a":5}]}</script>', -3, "schema:itemList"),
    ("plain.org/15", '<script type="application/ld+json">{"@type":"WebPage","itemListElement":[{"a":1},{"a":2},{"a":3},{"a":4}]}</script>', 0, ""),
    ("plain.org/16", '<script type="application/ld+json">{"@type":"LocalBusiness"}</script>', 2, "schema:localbusiness"),
]


@query("WITH r AS (SELECT * FROM (VALUES " + ", ".join(f"({i}, {s}, {q(r)})" for i, (_, _, s, r) in enumerate(_RULE_PAGES)) + f""") v(k, score, reasons))
SELECT s_suppkey AS page_id, score, reasons, score > 0 AS is_first_party FROM supplier JOIN r ON k = s_suppkey % {len(_RULE_PAGES)}""")
def site_rules(spark, sf):
    """Each rule that tells list pages from company sites decides a page."""
    cases = spark.createDataFrame([(i, f"https://{u}", f"<html><body>{h}</body></html>") for i, (u, h, _, _) in enumerate(_RULE_PAGES)], "k long, url string, html string")
    pages = table(spark, sf, "supplier").select(F.col("s_suppkey").alias("page_id"), (F.col("s_suppkey") % len(_RULE_PAGES)).alias("k")).join(F.broadcast(cases), "k").drop("k")
    return P.classify_sites(pages).select("page_id", "score", F.array_join("reasons", ",").alias("reasons"), "is_first_party")


_FORMS = [  # html with N for the page, addresses, source, confidence, messenger link
    ("<p>joeN&#64;shopN&#46;com</p>", "joeN@shopN.com", "website", 0.8, ""),
    ("<p>joeN&commat;shopN&period;com</p> https://wa.me/2348N", "joeN@shopN.com", "website", 0.8, "https://wa.me/2348N"),
    ("<p>joeN [at] shopN [dot] com</p>", "joeN@shopN.com", "website", 0.8, ""),
    ("<p>joeN at shopN dot com</p>", "joeN@shopN.com", "website", 0.8, ""),
    ("<p>joeN@shopN (dot) org</p>", "joeN@shopN.org", "website", 0.8, ""),
    ("<p>joeN@shopN.com</p><a href='mailto:joeN@shopN.com'>m</a>", "joeN@shopN.com", "mailto_link", 0.95, ""),
    ("<b data-contact=\"joeN@shopN.com\">c</b>", "joeN@shopN.com", "data_attribute", 0.95, ""),
    ("<b data-contact='x'>JOEN@shopN.com</b> https://api.whatsapp.com/send?phone=+44N", "joeN@shopN.com", "structured_data", 0.9, "https://api.whatsapp.com/send?phone=+44N"),
    ("<p>noreply@shopN.com user@example.com joe@localhost joe@@shop</p>", "", "", None, ""),
]


@query("WITH f AS (SELECT * FROM (VALUES " + ", ".join(f"({i}, {q(e)}, {q(s)}, {c if c else 'NULL'}, {q(w)})" for i, (_, e, s, c, w) in enumerate(_FORMS)) + f""") v(k, e, s, c, w))
SELECT s_suppkey AS page_id, replace(e, 'N', n) AS email, s AS source, CAST(c AS DOUBLE) AS confidence, replace(w, 'N', n) AS messenger FROM (
  SELECT s_suppkey, CAST(s_suppkey AS VARCHAR) AS n, s_suppkey % {len(_FORMS) + 1} AS k FROM supplier) s JOIN f USING (k)
UNION ALL SELECT s_suppkey, 'info' || CAST(s_suppkey AS VARCHAR) || '@packed.com', 'structured_data', 0.9, '' FROM supplier WHERE s_suppkey % {len(_FORMS) + 1} = {len(_FORMS)}""")
def page_contact_forms(spark, sf):
    """Addresses in every form that pages hide them in, and messenger links."""
    forms = spark.createDataFrame([(i, h) for i, (h, *_) in enumerate(_FORMS)], "k long, html string")
    n = F.col("s_suppkey").cast("string")
    packed = F.concat(F.lit('<i data-email="'), F.base64(F.concat(F.lit("info"), n, F.lit("@packed.com")).cast("binary")), F.lit('"></i>'))
    s = table(spark, sf, "supplier").select("s_suppkey", (F.col("s_suppkey") % (len(_FORMS) + 1)).alias("k")).join(F.broadcast(forms), "k", "left")
    pages = s.select(F.col("s_suppkey").alias("page_id"), F.coalesce(F.replace("html", F.lit("N"), n), packed).alias("html"))
    found = pages.select("page_id", P.page_emails("html").alias("e"), F.array_join(P.whatsapp_links("html"), ",").alias("messenger"))
    return found.select("page_id", F.array_join(F.transform("e", lambda e: e["email"]), ",").alias("email"), F.coalesce(F.get("e", F.lit(0))["source"], F.lit("")).alias("source"),
                        F.get("e", F.lit(0))["confidence"].alias("confidence"), "messenger")
