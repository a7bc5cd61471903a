"""Phone formatting, country and extraction from page text."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from leadloom import refdata as R
from leadloom.functions.text import all_groups, col, let, literal_lower_map, text_or_empty
from leadloom.functions.url import url_host


def _country_by_code() -> dict[str, str]:
    """'+code' -> country; the shared code 1 reads as US (CA only by default country)."""
    out: dict[str, str] = {}
    for country, code in R.DIAL_CODES.items():
        out.setdefault("+" + code, country)
    return out


def digits(phone: Column | str) -> Column:
    return F.regexp_replace(text_or_empty(phone), r"[^\d+]", "")


def format_phone(phone: Column | str, country: Column | str | None = None) -> Column:
    """Digits with '+' and, where missing, the dial code of the default country."""
    c = F.lower(col(country)) if country is not None else F.lit(None).cast("string")
    code = F.try_element_at(literal_lower_map(R.DIAL_CODES), F.coalesce(c, F.lit("")))
    return let(digits(phone), lambda d: let(code, lambda k: _prefixed(d, c, k)))


def _prefixed(d: Column, c: Column, code: Column) -> Column:
    plus = F.concat(F.lit("+"), d)
    return (
        F.when(d.startswith("+"), d)
        .when((F.length(d) == 10) & F.coalesce(c.isin("us", "ca"), F.lit(False)), F.concat(F.lit("+1"), d))
        .when((F.length(d) == 11) & d.startswith("1"), plus)
        .when(code.isNotNull() & ~d.startswith(F.coalesce(code, F.lit(""))), F.concat(F.lit("+"), code, d))
        .otherwise(plus)
    )


def phone_country(formatted: Column | str, country: Column | str | None = None) -> Column:
    """Country of the longest dial code the number starts with, 'Unknown' when none."""
    table = R.literal_map(_country_by_code())
    found = let(digits(formatted), lambda d: F.coalesce(
        *[F.try_element_at(table, F.substring(d, 1, n)) for n in (4, 3, 2)], F.lit("Unknown")))
    if country is None:
        return found
    return F.when((found == "US") & (F.lower(text_or_empty(country)) == "ca"), "CA").otherwise(found)


def is_sane_phone(phone: Column | str) -> Column:
    """At least ten digits and not all zeros or all ones."""
    d = F.regexp_replace(text_or_empty(phone), r"\D", "")
    return (F.length(d) >= 10) & ~d.rlike("^(0+|1+)$")


def host_country(url: Column | str) -> Column:
    """Default country guessed from the host of the page."""
    host = url_host(url)
    ladder = F.when(F.lit(False), F.lit(None).cast("string"))
    for hint, country in R.HOST_COUNTRY_HINTS:
        ladder = ladder.when(host.contains(hint), F.lit(country))
    return ladder


SAME_DIGIT = "^(" + "|".join(f"{i}{{9,}}" for i in range(10)) + ")$"
LABELLED = [rf"(?i){word}[:\s]*([+\d\s\-\(\)]{{10,20}})" for word in ("phone", "call", "contact", "tel")]
GENERAL = [r"\+?\d{1,4}[-.\s]?\(?\d{1,4}\)?[-.\s]?\d{1,4}[-.\s]?\d{1,9}", r"\+?\d{10,15}"]


def plausible_digits(d: Column) -> Column:
    n = F.length(d)
    north_american = (d.startswith("1") & (n == 11)) | (d.startswith("+1") & (n == 12)) | (
        (n == 10) & ~d.startswith("1"))
    bad_long = ~north_american & (n > 11) & ~d.startswith("+") & ~d.rlike(r"^[1-9]\d{9,14}$")
    return (
        n.between(10, 15) & ~d.rlike(SAME_DIGIT) & ~d.rlike("^(0{8,}|1{8,})$") & ~bad_long
        & ~d.rlike(r"^0\d{9,}$") & ~d.rlike("^[1-9]0{8,}$")
    )


def strip_code(html: Column | str) -> Column:
    """HTML without script and style elements."""
    return F.regexp_replace(
        F.regexp_replace(text_or_empty(html), r"(?is)<script[^>]*>.*?</script>", ""),
        r"(?is)<style[^>]*>.*?</style>", "")


def extract_phones(html: Column | str, url: Column | str, country: Column | str | None = None) -> Column:
    """array<struct(phone, country, formatted, source, confidence)>: tel links, labels, general shapes.

    First three distinct plausible numbers, in that order; confidence .9 when a tel link holds the digits.
    """
    raw = text_or_empty(html)
    tel = F.filter(F.transform(all_groups(r"(?i)tel:([+\d\s\-\(\)]+)", raw, 1), lambda t: F.trim(t)),
                   lambda t: F.length(t) >= 10)

    def shapes(text: Column) -> Column:
        labelled = F.concat(*[
            F.filter(F.transform(all_groups(p, text, 1), lambda t: F.trim(t)), lambda t: F.length(t).between(10, 20))
            for p in LABELLED])
        return F.concat(labelled, *[all_groups(p, text) for p in GENERAL])

    found = F.transform(F.concat(tel, let(strip_code(html), shapes)), lambda t: F.regexp_replace(t, r"[^\d+]", ""))
    kept = F.slice(F.array_distinct(F.filter(found, plausible_digits)), 1, 3)
    tel_digits = F.transform(tel, lambda t: F.regexp_replace(t, r"[^\d+]", ""))
    default = host_country(url) if country is None else F.coalesce(F.lower(col(country)), host_country(url))

    def row(d: Column) -> Column:
        return let(format_phone(d, default), lambda f: described(d, f))

    def described(d: Column, f: Column) -> Column:
        return F.struct(
            f.alias("phone"), phone_country(f, default).alias("country"), f.alias("formatted"),
            F.lit("website").alias("source"),
            F.when(F.exists(tel_digits, lambda t: t.contains(d)), 0.9).otherwise(0.7).alias("confidence"))

    return F.transform(kept, row)
