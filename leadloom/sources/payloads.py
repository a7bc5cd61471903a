"""Provider payload dumps (JSON text) to rows of the search-result table.

A dump has ``search_id, query, country, location, payload_no, payload``; one search may have many payloads, taken
in order of ``payload_no``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from leadloom import refdata as R
from leadloom.functions.domain import is_directory_site
from leadloom.functions.query import country_name
from leadloom.functions.text import has_any, null_if_empty, text_or_empty
from leadloom.functions.url import url_host
from leadloom.operators.skew import first_per_key

PER_PAYLOAD = 100_000  # room for positions inside one payload


def _pos(index: str = "i") -> Column:
    return (F.col("payload_no") * PER_PAYLOAD + F.col(index)).cast("long").alias("pos")


def _tag(tags: Column, *names: str) -> Column:
    """First non-empty tag."""
    return F.coalesce(*[null_if_empty(F.try_element_at(tags, F.lit(n))) for n in names])


def _with_scheme(url: Column) -> Column:
    return F.when(url.startswith("http"), url).when(url.isNotNull(), F.concat(F.lit("https://"), url))


def _address(*parts: Column) -> Column:
    return F.concat_ws(", ", *parts)


def _row(provider: str, title: Column, link: Column, snippet: Column, phone: Column | None = None,
         address: Column | None = None, place_id: Column | None = None, is_place: bool = False) -> list[Column]:
    null = F.lit(None).cast("string")
    return [
        F.col("search_id"), F.lit(provider).alias("provider"), _pos(), title.alias("title"), link.alias("link"),
        snippet.alias("snippet"), (null if phone is None else phone).alias("phone"),
        (null if address is None else address).alias("address"),
        (null if place_id is None else place_id).alias("place_id"), F.lit(is_place).alias("is_place")]


def _has(words: list[str], c: Column) -> Column:
    return has_any(c, words)


def food_finance_mismatch(query: Column, name: Column, link: Column) -> Column:
    """A food or charity query met a finance result, or the other way round (by name and link)."""
    q, n, site = F.lower(text_or_empty(query)), F.lower(text_or_empty(name)), F.lower(text_or_empty(link))
    food, finance = _has(R.FOOD_WORDS, q), _has(R.FINANCE_WORDS, q)
    name_finance = n.rlike(R.FINANCE_NAME) & ~_has(["food", "charity", "nonprofit"], n)
    site_finance = _has(["bank", "financial"], site) & ~_has(["food", "charity", "nonprofit"], site)
    name_food = n.rlike(R.FOOD_NAME) & ~_has(["bank", "financial"], n)
    return (food & ~finance & (name_finance | site_finance)) | (finance & ~food & name_food)


def place_type_mismatch(query: Column, name: Column, types: Column) -> Column:
    """The same by place types, names only confirming."""
    q, n = F.lower(text_or_empty(query)), F.lower(text_or_empty(name))
    t = F.transform(F.coalesce(types, F.array().cast("array<string>")), lambda x: F.lower(x))
    food, finance = _has(R.FOOD_WORDS, q), _has(R.FINANCE_WORDS, q)
    is_finance = F.arrays_overlap(t, R.literal_array(R.FINANCE_PLACE_TYPES))
    is_food = F.exists(t, lambda x: has_any(x, R.FOOD_WORDS + ["social_service"]))
    return (
        (food & is_finance & ~is_food & n.rlike(R.FINANCE_NAME) & ~n.contains("food"))
        | (finance & is_food & ~is_finance & n.rlike(R.FOOD_NAME))
        | (q.contains("bank") & ~food & ~finance & is_food & ~is_finance))


def overpass_results(dumps: DataFrame) -> DataFrame:
    """Map elements: website or wikidata link, address from five tags, phone from three."""
    schema = "struct<elements:array<struct<type:string,id:long,tags:map<string,string>>>>"
    rows = dumps.select(
        "*", F.posexplode(F.from_json("payload", schema)["elements"]).alias("i", "el"))
    tags = F.coalesce(F.col("el.tags"), F.create_map().cast("map<string,string>"))
    website = _with_scheme(_tag(tags, "website", "contact:website", "url"))
    wikidata = F.concat(F.lit("https://www.wikidata.org/wiki/"), _tag(tags, "brand:wikidata"))
    own_page = F.concat_ws("/", F.lit("https://www.openstreetmap.org"), F.col("el.type"), F.col("el.id"))
    address = _address(
        _tag(tags, "addr:street"), _tag(tags, "addr:housenumber"), _tag(tags, "addr:city", "addr:town", "addr:village"),
        _tag(tags, "addr:state"), _tag(tags, "addr:country"))
    flat = rows.select(
        "query", *_row("overpass", F.coalesce(_tag(tags, "name"), F.lit("Unknown")),
                       F.coalesce(website, wikidata, own_page), address,
                       _tag(tags, "phone", "contact:phone", "phone:mobile"), address))
    kept = flat.filter(
        (F.length("title") > 2)
        & ~text_or_empty(url_host("link")).contains("openstreetmap.org")
        & ~is_directory_site("link")
        & ~food_finance_mismatch(F.col("query"), F.col("title"), F.col("link")))
    return kept.drop("query")


PLACE = (
    "struct<osm_type:string,osm_id:string,name:string,display_name:string,class:string,type:string,"
    "address:map<string,string>,extratags:map<string,string>>"
)


def country_aliases(country: Column) -> Column:
    """Spellings of a country accepted in an address: its name, its code and a few others."""
    code = F.lower(country)
    extra = F.when(F.lit(False), F.array().cast("array<string>"))
    for c, words in R.COUNTRY_ALIASES.items():
        extra = extra.when(code == c, R.literal_array(words))
    return F.array_compact(F.flatten(F.array(
        F.array(F.lower(country_name(code)), code), F.coalesce(extra, F.array().cast("array<string>")))))


def nominatim_places(dumps: DataFrame) -> DataFrame:
    """Places of all search terms of a search, the first of each map object. Needs a column ``terms``."""
    rows = dumps.select(
        "search_id", "query", "country", "location", "payload_no", "terms",
        F.posexplode(F.from_json("payload", f"array<{PLACE}>")).alias("i", "place"))
    rows = rows.withColumn(
        "object", F.concat_ws(":", text_or_empty(F.col("place.osm_type")), text_or_empty(F.col("place.osm_id"))))
    rows = rows.withColumn("place", F.to_json("place"))
    first = first_per_key(rows, ["search_id", "object"], ["payload_no", "i"]).drop("object")
    return first.withColumn("place", F.from_json("place", PLACE))


def is_wanted_place() -> Column:
    """Business place that fits the search: no water or land, right place and country, no bare street, right intent.

    Over columns ``query, country, location, place`` and ``terms``, the expanded search terms (may be empty).
    """
    p, terms = F.col("place"), F.col("terms")
    website = F.coalesce(_tag(p["extratags"], "website", "url"), F.lit(""))
    name_all = text_or_empty(p["display_name"])
    shown = F.lower(name_all)
    kind, cls = F.lower(text_or_empty(p["type"])), text_or_empty(p["class"])
    addr = F.coalesce(p["address"], F.create_map().cast("map<string,string>"))

    def part(k: str) -> Column:
        return F.lower(F.coalesce(F.try_element_at(addr, F.lit(k)), F.lit("")))

    place = F.lower(text_or_empty("location"))
    in_place = (place == "") | shown.contains(place) | part("city").contains(place) | part("state").contains(
        place) | part("region").contains(place)
    country = text_or_empty("country")
    in_country = (country == "") | F.exists(
        country_aliases(F.col("country")), lambda a: part("country").contains(a) | shown.contains(a))

    wanted = F.transform(terms, lambda t: F.lower(t))
    intent = F.exists(wanted, lambda t: F.exists(
        F.filter(F.split(t, r"\s+"), lambda w: F.length(w) > 2), lambda w: shown.contains(w))
        | kind.contains(t) | F.lower(cls).contains(t))
    business = cls.isin(R.BUSINESS_CLASSES)
    short = F.lower(F.trim(F.coalesce(null_if_empty(p["name"]), F.regexp_extract(name_all, "^([^,]*)", 1))))
    street = short.rlike("(^| )(" + "|".join(R.STREET_SUFFIXES) + ")$")
    bare_street = street & ~(business | (website != "") | (kind != ""))

    words = F.filter(F.split(F.lower(F.trim(text_or_empty("query"))), r"\s+"), lambda w: F.length(w) > 2)
    specific = F.exists(words, lambda w: (F.length(w) > 3) & ~w.isin(R.INTENT_STOPWORDS + R.GENERIC_QUERY_TERMS)) | (
        F.size(terms) > 0)
    keywords = F.exists(words, lambda w: shown.contains(w) | kind.contains(w))
    has_site, scoped = website != "", (place != "") | (country != "")
    fits = (
        F.when(intent, True)
        .when(specific & ~keywords & ~has_site, False)
        .when(~specific & business, True)
        .when(~scoped & ~has_site & ~keywords, False)
        .when(has_site | scoped, ~specific | keywords)
        .otherwise(False))
    return (
        ~is_directory_site(website) & ~name_all.rlike(R.WATER_NAME) & ~cls.isin(R.NON_BUSINESS_CLASSES)
        & in_place & in_country & (F.length(name_all) >= 3) & ~bare_street & fits)


def nominatim_results(dumps: DataFrame, terms: Column | None = None) -> DataFrame:
    """Wanted places as results; places without a site link to a search for name and address."""
    none = F.array().cast("array<string>")
    places = nominatim_places(dumps.withColumn("terms", none if terms is None else terms)).filter(is_wanted_place())
    p = F.col("place")
    addr = p["address"]
    website = _with_scheme(_tag(p["extratags"], "website", "url"))
    address = _address(
        _tag(addr, "road"), _tag(addr, "house_number"), _tag(addr, "city", "town", "village", "municipality"),
        _tag(addr, "state", "state_district"), _tag(addr, "country"))
    title = F.coalesce(null_if_empty(p["name"]), null_if_empty(F.regexp_extract(p["display_name"], "^([^,]*)", 1)),
                       F.lit("Unknown Business"))
    where = F.coalesce(null_if_empty(address), null_if_empty(F.col("location")), null_if_empty(F.col("country")), F.lit(""))
    search = F.concat(F.lit("https://www.google.com/search?q="), F.url_encode(F.trim(F.concat_ws(" ", title, where))))
    link = F.when(website.isNotNull() & ~website.contains("openstreetmap.org"), website).otherwise(search)
    rows = places.select(*_row(
        "osm", title, link, F.coalesce(null_if_empty(address), p["display_name"]),
        _tag(p["extratags"], "phone", "contact:phone", "phone:mobile"), null_if_empty(address)))
    return rows.filter(~is_directory_site("link"))


def places_results(dumps: DataFrame) -> DataFrame:
    """Places payload: link is the website or ``places:<id>``."""
    schema = (
        "struct<results:array<struct<name:string,place_id:string,types:array<string>,formatted_address:string,"
        "vicinity:string,website:string,formatted_phone_number:string,international_phone_number:string>>>")
    rows = dumps.select("*", F.posexplode(F.from_json("payload", schema)["results"]).alias("i", "p"))
    p = F.col("p")
    rows = rows.filter(
        ~is_directory_site(p["website"]) & ~place_type_mismatch(F.col("query"), p["name"], p["types"]))
    address = F.coalesce(null_if_empty(p["formatted_address"]), null_if_empty(p["vicinity"]))
    place_id = null_if_empty(p["place_id"])
    link = F.coalesce(null_if_empty(p["website"]), F.concat(F.lit("places:"), F.coalesce(place_id, p["name"])))
    return rows.select(*_row(
        "places", p["name"], link, F.coalesce(address, F.lit("")),
        F.coalesce(null_if_empty(p["formatted_phone_number"]), null_if_empty(p["international_phone_number"])),
        address, place_id, True))


def web_results(dumps: DataFrame, provider: str, drop_directories: bool = True) -> DataFrame:
    """Web search payload, one of ``{results: [...]}``, ``{items: [...]}`` or ``{webPages: {value: [...]}}``.

    Items carry url or link, title or name, and content, snippet or description. Kept: http links with a title.
    """
    item = "struct<url:string,link:string,title:string,name:string,content:string,snippet:string,description:string>"
    schema = f"struct<results:array<{item}>,items:array<{item}>,webPages:struct<value:array<{item}>>>"
    body = F.from_json("payload", schema)
    found = F.coalesce(body["results"], body["items"], body["webPages"]["value"])
    rows = dumps.select("*", F.posexplode(found).alias("i", "r"))
    r = F.col("r")
    out = rows.select(*_row(
        provider, F.coalesce(null_if_empty(r["title"]), F.when(F.length(F.trim(r["name"])) >= 3, r["name"])),
        F.coalesce(null_if_empty(r["url"]), r["link"]),
        F.coalesce(null_if_empty(r["content"]), null_if_empty(r["snippet"]), r["description"], F.lit(""))))
    out = out.filter((text_or_empty("title") != "") & F.col("link").startswith("http"))
    return out.filter(~is_directory_site("link")) if drop_directories else out
