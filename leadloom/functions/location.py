"""Addresses, countries, city lookup and distance."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from leadloom import refdata as R
from leadloom.functions.text import col, null_if_empty, text_or_empty
from leadloom.functions.url import url_host

TLD_COUNTRY = {c.lower(): c for c, _ in R.ADDRESS_COUNTRIES if c != "GB"} | {"uk": "GB"}


def tld_country(website: Column | str) -> Column:
    """Country of the last host label, NULL for others and for text that is no absolute URL."""
    last = F.element_at(F.split(F.coalesce(url_host(website), F.lit("")), r"\."), -1)
    return F.try_element_at(R.literal_map(TLD_COUNTRY), last)


def address_country(address: Column | str) -> Column:
    a = text_or_empty(address)
    ladder = F.when(F.lit(False), F.lit(None).cast("string"))
    for code, words in R.ADDRESS_COUNTRIES:
        ladder = ladder.when(a.rlike(rf"(?i)\b({words})\b"), F.lit(code))
    return ladder


def parse_location(address: Column | str, website: Column | str) -> Column:
    """struct(city, state, country, formatted); state only with three or more parts."""
    a = F.trim(text_or_empty(address))
    parts = F.transform(F.split(a, ","), lambda p: F.trim(p))
    city = F.trim(F.regexp_replace(F.regexp_extract(a, "^([^,]+),", 1), r"(?i)^\s*(city\s+of|town\s+of)\s+", ""))
    state = F.when(F.size(parts) >= 3, F.try_element_at(parts, F.lit(-2)))
    return F.struct(
        null_if_empty(city).alias("city"),
        null_if_empty(F.when(F.length(state) <= 20, state)).alias("state"),
        F.coalesce(address_country(a), tld_country(website)).alias("country"),
        null_if_empty(a).alias("formatted"),
    )


def _city_table() -> Column:
    return F.array(*[
        F.struct(F.lit(n).alias("city"), F.lit(la).alias("lat"), F.lit(lo).alias("lon"))
        for n, la, lo in R.CITY_COORDINATES])


def find_city(text: Column | str) -> Column:
    """First table city equal to the text, else the first one containing it or contained in it."""
    t = F.lower(F.trim(text_or_empty(text)))
    table = _city_table()
    exact = F.get(F.filter(table, lambda c: c["city"] == t), F.lit(0))
    close = F.get(F.filter(table, lambda c: t.contains(c["city"]) | c["city"].contains(t)), F.lit(0))
    return F.when(t != "", F.coalesce(exact, close))


def find_address_city(address: Column | str) -> Column:
    """City of the first address part that names one; an address without a known part gives NULL."""
    parts = F.filter(F.transform(F.split(text_or_empty(address), "[,;|]"), lambda p: F.lower(F.trim(p))),
                     lambda p: p != "")
    return F.get(F.filter(F.transform(parts, find_city), lambda c: c.isNotNull()), F.lit(0))


def haversine_km(lat1: Column, lon1: Column, lat2: Column, lon2: Column) -> Column:
    d_lat, d_lon = F.radians(lat2 - lat1), F.radians(lon2 - lon1)
    a = F.pow(F.sin(d_lat / 2), 2) + F.cos(F.radians(lat1)) * F.cos(F.radians(lat2)) * F.pow(F.sin(d_lon / 2), 2)
    return F.round(2 * 6371 * F.atan2(F.sqrt(a), F.sqrt(1 - a)), 1)


def location_distance_km(search_location: Column | str, address: Column | str) -> Column:
    """Kilometres between the city of a search and the city of an address, NULL when either is unknown."""
    a, b = find_city(search_location), find_address_city(address)
    return haversine_km(a["lat"], a["lon"], b["lat"], b["lon"])
