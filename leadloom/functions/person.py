"""Person-name validity and the filters that keep placeholders and departments out."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from leadloom import refdata as R
from leadloom.functions.text import alternation, col, let, text_or_empty

NAME_REJECT_FIRST_WORDS = [*R.ACTION_FIRST_WORDS, *R.PAGE_FIRST_WORDS, *R.CONTROL_FIRST_WORDS, *R.TRADE_FIRST_WORDS,
                           *R.PHRASE_FIRST_WORDS, *R.TIME_AND_PLACE_FIRST_WORDS]
NAME_REJECT_WORDS = [*R.DETERMINERS, *R.HURRY_WORDS, *R.GROWTH_VERBS, *R.BUSINESS_TERMS, *R.ANSWER_WORDS, *R.PROMISE_VERBS]
REJECT_NAME = (
    rf"(?i)^({alternation(NAME_REJECT_FIRST_WORDS)})\b|\b({alternation(NAME_REJECT_WORDS)})\b"
    rf"|^({alternation(R.CALENDAR_WORDS)})(\s+({alternation(R.CALENDAR_WORDS)}))*$|@|\d"
    r"|(http|https|www|\.com|\.net|\.org|\.io|\.co)"
)
DEPARTMENT_NAME = (
    rf"(?i)^({alternation(R.DEPARTMENT_WORDS)})\s+({alternation(R.DEPARTMENT_WORDS + R.DEPARTMENT_SECOND_EXTRA)})$"
    rf"|^({alternation(R.META_WORDS + R.SMALL_WORDS + R.NAME_FRAGMENTS)})$"
)
PLACEHOLDER_MAIL = "(" + "|".join(R.PERSON_PLACEHOLDER_MAIL) + ")"


def is_person_name(name: Column | str) -> Column:
    """Page-text variant: 3-50 characters, two or more capitalised words, no copy or business words."""
    return let(F.trim(text_or_empty(name)), _person_name)


def _person_name(n: Column) -> Column:
    words = F.split(F.regexp_replace(n, R.TITLE_PREFIX, ""), r"\s+")
    lower = F.lower(n)
    hits = F.aggregate(
        R.literal_array(R.NAME_BUSINESS_WORDS), F.lit(0), lambda acc, w: acc + lower.contains(w).cast("int"))
    return (
        F.length(n).between(3, 50)
        & n.rlike(R.PROPER_NAME)
        & ~n.rlike(REJECT_NAME)
        & (F.size(words) >= 2)
        & F.forall(words, lambda w: w.rlike("^[A-Z][a-z]+$"))
        & (hits < 2)
    )


def is_department_name(name: Column | str) -> Column:
    return F.trim(text_or_empty(name)).rlike(DEPARTMENT_NAME)


def is_search_person_name(name: Column | str) -> Column:
    """Search-result variant: plain capitalised words that are no department or meta word."""
    n = F.trim(text_or_empty(name))
    return (
        F.length(n).between(3, 50) & ~is_department_name(n) & n.rlike(R.PLAIN_NAME)
        & F.forall(F.split(n, r"\s+"), lambda w: w.rlike("^[A-Z][a-z]+$"))
    )


def has_placeholder_mail(email: Column | str) -> Column:
    return F.lower(text_or_empty(email)).rlike(PLACEHOLDER_MAIL)


def is_not_noise(p: Column) -> Column:
    """Basic filter for one person struct when no model has validated it."""
    n = F.trim(text_or_empty(p["name"]))
    return (
        (F.length(n) >= 3) & ~n.rlike(R.NOISE_NAME) & ~((n == F.upper(n)) & (F.length(n) > 5))
        & ~has_placeholder_mail(p["email"]) & (F.size(F.split(n, r"\s+")) <= 4) & (F.length(n) <= 50)
    )


def passes_validation(p: Column, min_confidence: float = 0.6) -> Column:
    """Filter for one person struct that a model has scored."""
    n = text_or_empty(p["name"])
    return (
        F.length(n).between(3, 50) & (F.coalesce(p["confidence"], F.lit(0.0)) >= min_confidence)
        & ~is_department_name(n) & ~has_placeholder_mail(p["email"])
    )


def is_placeholder_person(p: Column) -> Column:
    """Known invented names, role names, names with '/', or a name equal to its title."""
    n = F.lower(F.trim(text_or_empty(p["name"])))
    return (
        n.isin(R.PLACEHOLDER_PEOPLE + R.PLACEHOLDER_ROLES) | n.contains("/")
        | (n == F.lower(F.trim(text_or_empty(p["title"]))))
    )


def drop_noise(people: Column | str) -> Column:
    return F.filter(col(people), lambda p: is_not_noise(p))


def drop_unvalidated(people: Column | str) -> Column:
    return F.filter(col(people), lambda p: passes_validation(p))


def drop_placeholders(people: Column | str) -> Column:
    return F.filter(col(people), lambda p: ~is_placeholder_person(p))


def first_email_for(name: Column | str, emails: Column | str) -> Column:
    """First address holding the first or last word of the name."""
    parts = F.split(F.lower(F.trim(col(name))), " ")
    first, last = parts[0], F.element_at(parts, -1)
    return F.get(F.filter(col(emails), lambda e: e.contains(first) | e.contains(last)), F.lit(0))


def names_overlap(a: Column | str, b: Column | str) -> Column:
    """Two arrays of person structs share a full name or a name part longer than two letters."""
    def names(c: Column | str) -> Column:
        return F.filter(F.transform(col(c), lambda p: F.lower(F.trim(text_or_empty(p["name"])))),
                        lambda n: F.length(n) > 0)

    def parts(ns: Column) -> Column:
        return F.filter(F.flatten(F.transform(ns, lambda n: F.split(n, r"\s+"))), lambda w: F.length(w) > 2)

    na, nb = names(a), names(b)
    return F.arrays_overlap(na, nb) | F.arrays_overlap(parts(na), parts(nb))
