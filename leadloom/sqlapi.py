"""The rules as SQL: scalar functions whose bodies are SQL, and one table function.

``register(spark)`` makes them known to a session. A scalar function is inlined by the optimizer, so a query that uses
it runs in the JVM as if its body had been written out. ``page_links`` reads HTML in Python workers and is called with
a lateral join. Names, arguments and results are those of the column functions in ``leadloom.functions``.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from typing import NamedTuple

from pyspark.sql import SparkSession
from pyspark.sql.functions import udtf

from leadloom import refdata as R
from leadloom.functions import company, domain, email, title, url
from leadloom.functions.text import alternation


class Function(NamedTuple):
    name: str
    arguments: str
    returns: str
    body: str


def text(value: str) -> str:
    """``value`` as a SQL literal."""
    return "'" + value.replace("\\", "\\\\").replace("'", "\\'") + "'"


def _words(values) -> str:
    return ", ".join(text(v) for v in values)


def _group(c: str, pattern: str, n: int = 1) -> str:
    return f"nullif(regexp_extract({c}, {text(pattern)}, {n}), '')"


def _ladder(c: str, rules: list[tuple[str, str]], otherwise: str) -> str:
    return "CASE " + " ".join(f"WHEN {c} RLIKE {text('(?i)' + p)} THEN {text(v)}" for p, v in rules) + f" ELSE {otherwise} END"


def _social() -> str:
    names = [n for n, _ in R.SOCIAL_HOSTS if n != "x"]
    return "CASE " + " ".join(f"WHEN url_host(url) RLIKE {text(r'twitter|x\.com' if n == 'twitter' else n)} THEN {text(n)}" for n in names) + " END"


def _count(c: str, pattern: str) -> str:
    n = f"try_cast(regexp_replace(regexp_extract({c}, {text(pattern)}, 1), ',', '') AS BIGINT)"
    return f"CASE WHEN {n} > 0 AND {n} < 1000000 THEN CAST({n} AS INT) END"


def _employee_count() -> str:
    n = company.NUMBER
    patterns = [rf"(?i){n}\s+employees?", rf"(?i){n}\s+people", r'(?i)"numberOfEmployees"\s*:\s*"?(\d+)"?',
                r"""(?i)<meta[^>]*property=["']og:description["'][^>]*content=["'][^"']*?""" + n + r"\s+employees?"]
    return "coalesce(" + ", ".join(_count("coalesce(html, '')", p) for p in patterns) + ")"


def _founded_year() -> str:
    patterns = [r"(?i)(?:founded|established|since|started)\s+(?:in\s+)?(\d{4})", r'(?i)"foundingDate"\s*:\s*"?(\d{4})"?',
                r"(?i)(?:since|from|established|founded)\s+(\d{4})"]
    year = lambda p: f"try_cast(regexp_extract(coalesce(html, ''), {text(p)}, 1) AS INT)"
    return "coalesce(" + ", ".join(f"CASE WHEN {year(p)} BETWEEN 1800 AND current_year THEN {year(p)} END" for p in patterns) + ")"


def _dial(country: str) -> str:
    return "CASE " + " ".join(f"WHEN {country} = {text(c.lower())} THEN {text(code)}" for c, code in R.DIAL_CODES.items()) + " END"


def _phone_country() -> str:
    first: dict[str, str] = {}
    for c, code in R.DIAL_CODES.items():
        first.setdefault(code, c)
    longest = sorted(first.items(), key=lambda kv: -len(kv[0]))
    return "CASE " + " ".join(f"WHEN startswith(phone_digits(phone), {text('+' + code)}) THEN {text(c)}" for code, c in longest) + " ELSE 'Unknown' END"


def _email_reason() -> str:
    a = "lower(trim(coalesce(email, '')))"
    return (f"CASE WHEN {a} = '' THEN 'Invalid input' WHEN NOT {a} RLIKE {text(f'^{R.EMAIL_PATTERN}$')} THEN 'Invalid email format' "
            f"WHEN {a} RLIKE {text(email.ROLE_ADDRESS)} THEN 'Generic or placeholder email' "
            f"WHEN regexp_extract({a}, '@(.*)$', 1) RLIKE {text(email.DISPOSABLE)} THEN 'Disposable email domain' "
            f"WHEN {a} RLIKE {text(email.SUSPICIOUS)} THEN 'Suspicious email pattern' "
            f"WHEN email_base_score(email) >= 80 THEN 'Valid email format' ELSE 'Needs verification' END")


def _email_base_score() -> str:
    a = "lower(trim(coalesce(email, '')))"
    tld = text(rf"\.({alternation(R.COMMON_MAIL_TLDS)})$")
    return (f"70 + CASE WHEN {a} RLIKE {text(r'^[a-z]+\.[a-z]+@')} THEN 10 ELSE 0 END + CASE WHEN {a} RLIKE {text(r'^[a-z]\.[a-z]+@')} THEN 5 ELSE 0 END "
            f"+ CASE WHEN regexp_extract({a}, '@(.*)$', 1) RLIKE {tld} THEN 5 ELSE 0 END "
            f"- CASE WHEN length({a}) > 50 THEN 10 ELSE 0 END - CASE WHEN length({a}) < 10 THEN 5 ELSE 0 END")


def _address_country() -> str:
    return "CASE " + " ".join(f"WHEN coalesce(address, '') RLIKE {text(rf'(?i)\b({w})\b')} THEN {text(c)}" for c, w in R.ADDRESS_COUNTRIES) + " END"


#: In an order in which each body finds the functions it calls.
FUNCTIONS = [
    Function("bare_domain", "url STRING", "STRING",
             f"regexp_replace(regexp_extract(lower(trim(coalesce(url, ''))), {text(r'^(?:https?://)?(?:www\.)?([^/?#:]*)')}, 1), {text(r'\.$')}, '')"),
    Function("same_domain", "a STRING, b STRING", "BOOLEAN", "bare_domain(a) = bare_domain(b) AND bare_domain(a) <> ''"),
    Function("url_host", "url STRING", "STRING", f"regexp_replace(lower({_group('url', url.HOST)}), {text(r'^www\.')}, '')"),
    Function("url_path", "url STRING", "STRING", f"lower(regexp_extract(url, {text(url.PATH)}, 1))"),
    Function("url_origin", "url STRING", "STRING", f"lower({_group('url', r'(?i)^\s*(https?://[^/?#]+)')})"),
    Function("absolute_url", "href STRING, base STRING", "STRING",
             "CASE WHEN href RLIKE '(?i)^https?://' THEN href WHEN startswith(href, '//') THEN 'https:' || href "
             f"WHEN href RLIKE {text(r'^[a-zA-Z][a-zA-Z0-9+.-]*:')} THEN NULL WHEN startswith(href, '/') THEN url_origin(base) || href "
             "ELSE url_origin(base) || '/' || href END"),
    Function("social_platform", "url STRING", "STRING", _social()),
    Function("is_social_host", "host STRING", "BOOLEAN", f"lower(coalesce(host, '')) RLIKE {text(url.SOCIAL_HOST)}"),
    Function("is_query_link", "url STRING", "BOOLEAN", f"contains(coalesce(url, ''), {text(url.QUERY_LINK)})"),
    Function("query_link_text", "url STRING", "STRING",
             f"coalesce(try_url_decode({_group('url', '[?&]q=([^&]+)')}), {_group('url', '[?&]q=([^&]+)')})"),
    Function("query_link_location", "url STRING", "STRING", f"trim({_group('query_link_text(url)', r'(?i)\s+(?:in|at|near|around)\s+([^,]+)')})"),
    Function("is_placeholder_host", "host STRING", "BOOLEAN",
             f"lower(coalesce(host, '')) = '' OR lower(coalesce(host, '')) RLIKE {text(domain.placeholder_host_pattern())}"),
    Function("is_blocked_platform", "host STRING", "BOOLEAN",
             f"regexp_replace(lower(coalesce(host, '')), {text(r'^www\.')}, '') IN ({_words(R.BLOCKED_PLATFORMS)})"),
    Function("is_known_directory", "host STRING", "BOOLEAN", f"lower(coalesce(host, '')) RLIKE {text('(' + alternation(R.KNOWN_DIRECTORIES) + ')')}"),
    Function("normalize_company", "name STRING", "STRING",
             f"trim(regexp_replace(regexp_replace(trim(lower(coalesce(name, ''))), {text(r'\s+')}, ' '), {text(r'[^a-zA-Z0-9_\s]')}, ''))"),
    Function("company_similarity", "a STRING, b STRING", "DOUBLE",
             "CASE WHEN greatest(length(a), length(b)) = 0 THEN 1.0D ELSE (greatest(length(a), length(b)) - levenshtein(a, b)) / greatest(length(a), length(b)) END"),
    Function("employee_count", "html STRING", "INT", _employee_count()),
    Function("employee_range", "n INT", "STRING",
             "CASE WHEN n IS NULL OR n <= 0 THEN NULL WHEN n <= 10 THEN '1-10' WHEN n <= 50 THEN '11-50' WHEN n <= 200 THEN '51-200' "
             "WHEN n <= 500 THEN '201-500' WHEN n <= 1000 THEN '501-1000' ELSE '1000+' END"),
    Function("employees_from_size", "size STRING", "INT",
             "CASE lower(size) WHEN 'micro' THEN 5 WHEN 'small' THEN 25 WHEN 'medium' THEN 125 WHEN 'large' THEN 500 END"),
    Function("founded_year", "html STRING, current_year INT", "INT", _founded_year()),
    Function("has_hiring_words", "html STRING", "BOOLEAN", f"coalesce(html, '') RLIKE {text(company.HIRING)}"),
    Function("phone_digits", "phone STRING", "STRING", f"regexp_replace(coalesce(phone, ''), {text(r'[^\d+]')}, '')"),
    Function("dial_code", "country STRING", "STRING", _dial("lower(country)")),
    Function("format_phone", "phone STRING, country STRING", "STRING",
             "CASE WHEN startswith(phone_digits(phone), '+') THEN phone_digits(phone) "
             "WHEN length(phone_digits(phone)) = 10 AND coalesce(lower(country) IN ('us', 'ca'), FALSE) THEN '+1' || phone_digits(phone) "
             "WHEN length(phone_digits(phone)) = 11 AND startswith(phone_digits(phone), '1') THEN '+' || phone_digits(phone) "
             "WHEN dial_code(country) IS NOT NULL AND NOT startswith(phone_digits(phone), dial_code(country)) THEN '+' || dial_code(country) || phone_digits(phone) "
             "ELSE '+' || phone_digits(phone) END"),
    Function("phone_country", "phone STRING", "STRING", _phone_country()),
    Function("is_sane_phone", "phone STRING", "BOOLEAN",
             f"length(regexp_replace(coalesce(phone, ''), {text(r'\D')}, '')) >= 10 AND NOT regexp_replace(coalesce(phone, ''), {text(r'\D')}, '') RLIKE '^(0+|1+)$'"),
    Function("email_base_score", "email STRING", "INT", _email_base_score()),
    Function("email_reason", "email STRING", "STRING", _email_reason()),
    Function("email_score", "email STRING", "INT",
             "CASE email_reason(email) WHEN 'Invalid input' THEN 0 WHEN 'Invalid email format' THEN 0 WHEN 'Generic or placeholder email' THEN 20 "
             "WHEN 'Disposable email domain' THEN 10 WHEN 'Suspicious email pattern' THEN 30 ELSE email_base_score(email) END"),
    Function("is_business_email", "email STRING", "BOOLEAN",
             f"lower(coalesce(email, '')) <> '' AND NOT lower(coalesce(email, '')) RLIKE {text(r'(noreply|no-reply|donotreply|example\.com)')}"),
    Function("normalize_title", "title STRING", "STRING",
             f"CASE WHEN coalesce(title, '') <> '' THEN {_ladder('title', title.TITLE_LADDER, 'trim(title)')} END"),
    Function("seniority", "title STRING", "STRING", _ladder("coalesce(title, '')", title.SENIORITY_LADDER, "'mid'")),
    Function("department", "title STRING", "STRING", _ladder("coalesce(title, '')", title.DEPARTMENT_LADDER, "'General'")),
    Function("address_country", "address STRING", "STRING", _address_country()),
    Function("distance_km", "lat1 DOUBLE, lon1 DOUBLE, lat2 DOUBLE, lon2 DOUBLE", "DOUBLE",
             "round(2 * 6371 * atan2(sqrt(pow(sin(radians(lat2 - lat1) / 2), 2) + cos(radians(lat1)) * cos(radians(lat2)) * pow(sin(radians(lon2 - lon1) / 2), 2)), "
             "sqrt(1 - (pow(sin(radians(lat2 - lat1) / 2), 2) + cos(radians(lat1)) * cos(radians(lat2)) * pow(sin(radians(lon2 - lon1) / 2), 2)))), 1)"),
]

_ANCHOR = re.compile(r"""<a\s[^>]*?href\s*=\s*["']([^"']*)["'][^>]*>(.*?)</a>""", re.I | re.S)
_TAG, _BLANKS = re.compile(r"<[^>]*>"), re.compile(r"\s+")


@udtf(returnType="pos: int, href: string, text: string", useArrow=True)
class PageLinks:
    """One row per anchor of a page: place, address and text without markup. NULL and empty pages have none."""

    def eval(self, html: str) -> Iterator[tuple[int, str, str]]:
        for pos, found in enumerate(_ANCHOR.finditer(html or "")):
            yield pos, found[1].strip(" "), _BLANKS.sub(" ", _TAG.sub(" ", found[2])).strip(" ")


def register(spark: SparkSession) -> None:
    """Make every function of ``FUNCTIONS`` and ``page_links(html)`` known to the session, replacing those of an earlier call."""
    for f in FUNCTIONS:
        spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {f.name}({f.arguments}) RETURNS {f.returns} RETURN {f.body}")
    spark.udtf.register("page_links", PageLinks)
