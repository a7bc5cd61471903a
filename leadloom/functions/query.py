"""Search text: location, business terms, concept, locale, expansions, provider phrases."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from leadloom import refdata as R
from leadloom.functions.text import alternation, col, fold_accents, has_any, let, null_if_empty, text_or_empty, words_of

PLACE_AFTER = r"(?i)^.*\b(?:in|at|near|around|within|from)\s+([A-Za-z][A-Za-z\s]*)"


def query_location(query: Column | str) -> Column:
    """Text after the last preposition up to the end or a comma."""
    return null_if_empty(F.trim(F.regexp_extract(text_or_empty(query), PLACE_AFTER, 1)))


def query_without_location(query: Column | str) -> Column:
    q = text_or_empty(query)
    cut = F.regexp_replace(q, r"(?i)^(.*)\b(?:in|at|near|around|within|from)\s+[A-Za-z][A-Za-z\s]*,?", "$1")
    return F.trim(cut)


def parse_query(query: Column | str, country: Column | str, location: Column | str, industry: Column | str) -> Column:
    """struct(industry, location, country, cleaned_query); given values win over parsed ones."""
    q = text_or_empty(query)
    rest = query_without_location(q)
    term = null_if_empty(F.regexp_extract(F.lower(rest), "(" + alternation(R.QUERY_BUSINESS_TERMS) + ")", 1))
    bare = F.regexp_replace(rest, "(?i)(" + alternation(R.QUERY_BUSINESS_TERMS) + ")", "")
    kept = F.filter(words_of(bare), lambda w: ~F.lower(w).isin(R.QUERY_STOPWORDS))
    cleaned = F.array_join(kept, " ")
    given = (text_or_empty(industry) != "") & (text_or_empty(location) != "")
    final = F.when(given | (F.length(cleaned) < 3), F.trim(q)).otherwise(cleaned)
    return F.struct(
        F.coalesce(null_if_empty(col(industry)), F.when(~given, term)).alias("industry"),
        F.coalesce(null_if_empty(col(location)), F.when(~given, query_location(q))).alias("location"),
        null_if_empty(col(country)).alias("country"),
        final.alias("cleaned_query"))


def _plain(words: list[str]) -> list[str]:
    table = str.maketrans(R.ACCENTED, R.UNACCENTED)
    return list(dict.fromkeys(w.lower().translate(table) for w in words))


def concept(query: Column | str) -> Column:
    """Business concept whose label, else whose hint, the query contains."""
    return let(fold_accents(query), _concept)


def _concept(q: Column) -> Column:
    ladder = F.when(F.lit(False), F.lit(None).cast("string"))
    for name, labels, _ in R.CONCEPTS:
        ladder = ladder.when(has_any(q, _plain(labels)), F.lit(name))
    for name, hints in R.CONCEPT_FALLBACKS:
        ladder = ladder.when(has_any(q, hints), F.lit(name))
    return ladder


def locale(country: Column | str) -> Column:
    c = F.lower(text_or_empty(country))
    return (F.when(c.isin(R.PORTUGUESE_COUNTRIES), "pt").when(c.isin(R.SPANISH_COUNTRIES), "es")
            .when(c == "fr", "fr").otherwise("en"))


def expansions(query: Column | str, country: Column | str, limit: int = 8) -> Column:
    """Query, concept labels, locale labels, plurals, then accent-free forms; distinct, first ``limit``."""
    terms = let(concept(query), lambda which: let(locale(country), lambda loc: _terms(text_or_empty(query), which, loc)))
    folded = let(terms, lambda t: F.array_distinct(F.concat(t, F.transform(t, lambda x: fold_accents(x)))))
    return F.slice(folded, 1, limit)


def _terms(q: Column, which: Column, loc: Column) -> Column:
    none = F.array().cast("array<string>")
    extra = F.when(F.lit(False), none)
    for name, labels, by_locale in R.CONCEPTS:
        for code in ("pt", "es", "fr"):
            words = labels + by_locale.get(code, [])
            extra = extra.when((which == name) & (loc == code), R.literal_array(words))
        extra = extra.when(which == name, R.literal_array(labels))
    base = F.array_distinct(F.concat(F.array(q), F.coalesce(extra, none)))

    def with_plurals(terms: Column) -> Column:
        plurals = F.transform(F.filter(terms, lambda t: ~t.endswith("s")), lambda t: F.concat(t, F.lit("s")))
        return F.array_distinct(F.concat(terms, F.when(which.isNotNull(), plurals).otherwise(none)))

    return let(base, with_plurals)


def category_terms(query: Column | str, country: Column | str) -> Column:
    """Query plus trade terms, with Spanish or Portuguese ones by country; distinct ignoring case."""
    q = F.lower(F.trim(text_or_empty(query)))
    loc = locale(country)
    none = F.array().cast("array<string>")
    parts = [F.array(text_or_empty(query))]
    for triggers, common, spanish, portuguese in R.CATEGORY_TERMS:
        words = (F.when(loc == "es", R.literal_array(common + spanish))
                 .when(loc == "pt", R.literal_array(common + portuguese)).otherwise(R.literal_array(common)))
        parts.append(F.when(has_any(q, triggers), words).otherwise(none))
    def first_of_each(terms: Column) -> Column:
        keys = F.transform(terms, lambda t: F.lower(t))
        return let(keys, lambda k: F.filter(terms, lambda t, i: F.array_position(k, F.lower(t)) == i + 1))

    return let(F.concat(*parts), first_of_each)


def search_phrase(query: Column | str, country: Column | str, location: Column | str) -> Column:
    """Query, location, 'site:' country and the business words."""
    return F.concat_ws(
        " ", text_or_empty(query), null_if_empty(col(location)),
        F.when(text_or_empty(country) != "", F.concat(F.lit("site:"), F.lower(col(country)))),
        F.lit("business company"))


def places_phrase(query: Column | str, country: Column | str, location: Column | str) -> Column:
    """Quoted multi-word query, location and country name."""
    q, c = text_or_empty(query), F.lower(col(country))
    multi = (F.size(F.split(q, r"\s+")) > 1) & ~q.rlike("^[\"'].*[\"']$")
    return F.concat_ws(
        " ", F.when(multi, F.concat(F.lit('"'), q, F.lit('"'))).otherwise(q), null_if_empty(col(location)),
        null_if_empty(country_name(c)))


def country_name(code: Column | str) -> Column:
    """Name of a country code; unknown codes stay as they are."""
    c = F.lower(col(code))
    return F.coalesce(F.try_element_at(R.literal_map(R.COUNTRY_NAMES), c), c)


def map_tags(query: Column | str) -> Column:
    """Map tags worth searching for a query; 'bank' depends on food or finance words around it."""
    q = F.lower(text_or_empty(query))
    food = has_any(q, R.FOOD_WORDS)
    bank = q.contains("bank")
    tags = [
        F.when(bank & food, "social_facility=food_bank"), F.when(bank & food, "social_facility=soup_kitchen"),
        F.when(bank & ~food, "amenity=bank")]
    tags += [F.when(has_any(q, words), tag) for words, tag in R.MAP_TAGS]
    tags += [F.when(q.contains("hospital"), "healthcare=hospital"), F.when(q.contains("hospital"), "building=hospital")]
    return F.array_compact(F.array(*tags))


def template_name(name: Column | str, query: Column | str, location: Column | str) -> Column:
    return F.coalesce(null_if_empty(col(name)), F.concat_ws(" - ", col(query), null_if_empty(col(location))))
