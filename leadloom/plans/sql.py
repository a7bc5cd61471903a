"""Pieces of DuckDB SQL used by several counterparts. Written on its own, sharing only fixed values and patterns."""

from __future__ import annotations

from leadloom import refdata as R
from leadloom.functions import domain as D
from leadloom.functions.text import alternation
from leadloom.functions.title import DEPARTMENT_LADDER, SENIORITY_LADDER, TITLE_LADDER
from leadloom.functions.url import SOCIAL_HOST, SOCIAL_TEXT
from leadloom.sources.fixtures import ctes


def q(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


def rx(c: str, pattern: str) -> str:
    return f"regexp_matches({c}, {q(pattern)})"


def ex(c: str, pattern: str, group: int = 1) -> str:
    return f"regexp_extract({c}, {q(pattern)}, {group})"


def e(c: str) -> str:
    return f"coalesce({c}, '')"


def domain(url: str) -> str:
    host = ex(f"lower(trim({e(url)}))", r"^(?:https?://)?(?:www\.)?([^/?#:]*)")
    return f"regexp_replace({host}, '\\.$', '')"


def host(url: str) -> str:
    raw = ex(f"lower({url})", r"^\s*https?://(?:[^/?#@]*@)?([^/?#:\s]+)")
    return f"nullif(regexp_replace({raw}, '^www\\.', ''), '')"


def path(url: str) -> str:
    return f"lower({ex(url, r'(?i)^\s*https?://[^/?#]*([^?#]*)')})"


def social_url(url: str) -> str:
    return (f"(CASE WHEN {host(url)} IS NOT NULL THEN {rx(host(url), SOCIAL_HOST)} "
            f"ELSE {rx(f'lower({e(url)})', SOCIAL_TEXT)} END)")


def placeholder_host(h: str, allow: tuple[str, ...] = ()) -> str:
    return f"({e(h)} = '' OR {rx(f'lower({e(h)})', D.placeholder_host_pattern(allow))})"


def _keyword(h: str, p: str) -> str:
    return f"({rx(h, D.DIRECTORY_HOST)} AND NOT {rx(h, D.NOT_DIRECTORY)} AND ({rx(p, D.DIRECTORY_PATH)} OR {rx(h, D.CLEAR_DIRECTORY)}))"


def directory_site(url: str, title: str | None = None) -> str:
    h, p = host(url), path(url)
    known = rx(h, "(" + alternation(R.KNOWN_DIRECTORIES) + ")")
    hit = f"{_keyword(h, p)} OR {rx(f'lower({url})', D.MARKET)} OR {rx(p, D.LIST_PATH)} OR {known}"
    if title:
        hit += f" OR {rx(f'lower({e(title)})', D.LIST_TITLE)}"
    return f"coalesce({h} IS NOT NULL AND ({hit}), false)"


def directory_url(url: str) -> str:
    h, p = host(url), path(url)
    blocked = ", ".join(q(b) for b in R.BLOCKED_PLATFORMS)
    hit = (f"{h} IN ({blocked}) OR {_keyword(h, p)} OR {rx(f'lower({url})', D.MARKET)} OR {rx(p, D.LIST_PATH_NO_TITLE)} "
           f"OR {rx(h, D.DIRECTORY_HOST_NO_TITLE)}")
    return f"coalesce({h} IS NOT NULL AND ({hit}), false)"


def _ladder(c: str, rules: list[tuple[str, str]], default: str) -> str:
    whens = " ".join(f"WHEN {rx(c, '(?i)' + p)} THEN {q(v)}" for p, v in rules)
    return f"(CASE {whens} ELSE {default} END)"


def normal_title(t: str) -> str:
    return f"(CASE WHEN {e(t)} <> '' THEN {_ladder(t, TITLE_LADDER, f'trim({t})')} END)"


def seniority(t: str) -> str:
    return _ladder(e(t), SENIORITY_LADDER, "'mid'")


def department(t: str) -> str:
    return _ladder(e(t), DEPARTMENT_LADDER, "'General'")


def quality(name: str, website: str, contact: str, person: str, more: str) -> str:
    n = f"lower(trim({e(name)}))"
    return (
        f"((CASE WHEN {n} <> '' AND NOT (length({n}) < 20 AND ({' OR '.join(f'contains({n}, {q(w)})' for w in ('business', 'company', 'enterprise', 'corporation', 'inc', 'llc'))})) THEN 1 ELSE 0 END)"
        f" + (CASE WHEN {host(website)} IS NOT NULL AND {host(website)} <> 'localhost' AND NOT contains({host(website)}, 'example.com') THEN 1 ELSE 0 END)"
        f" + (CASE WHEN {contact} THEN 1 ELSE 0 END) + (CASE WHEN {person} THEN 1 ELSE 0 END) + (CASE WHEN {more} THEN 1 ELSE 0 END))")


LEAD_QUALITY = quality(
    "company_name", "website", "email IS NOT NULL OR phone IS NOT NULL", "title IS NOT NULL",
    "address IS NOT NULL OR lead_id % 10 = 0 OR lead_id % 15 = 0")

MAIL_DOMAIN = "regexp_extract({m}, '@(.*)$', 1)"


def mail_score(m: str) -> tuple[str, str, str]:
    """SQL of score, status and reason of an address."""
    a = f"lower(trim({e(m)}))"
    d = MAIL_DOMAIN.format(m=a)
    base = (
        f"(70 + (CASE WHEN {rx(a, '^[a-z]+[.][a-z]+@')} THEN 10 ELSE 0 END) + (CASE WHEN {rx(a, '^[a-z][.][a-z]+@')} THEN 5 ELSE 0 END)"
        f" + (CASE WHEN list_contains({R.COMMON_MAIL_TLDS!r}, list_last(string_split({d}, '.'))) THEN 5 ELSE 0 END)"
        f" - (CASE WHEN length({a}) > 50 THEN 10 ELSE 0 END) - (CASE WHEN length({a}) < 10 THEN 5 ELSE 0 END))")
    role = " OR ".join([f"starts_with({a}, {q(w + '@')})" for w in R.ROLE_MAILBOXES]
                       + [f"ends_with({a}, {q('@' + w)})" for w in R.ROLE_MAIL_DOMAINS])
    gone = " OR ".join(f"contains({d}, {q(w)})" for w in R.DISPOSABLE_DOMAINS)
    odd = rx(a, r"^[0-9]+@|^[a-z]+\d+@|\.{2,}|@{2,}|^\.|\.$|@\.|\.@")
    shape = rx(a, "^" + R.EMAIL_PATTERN + "$")

    def ladder(empty, shapeless, role_v, gone_v, odd_v, rest):
        return (f"(CASE WHEN {e(m)} = '' THEN {empty} WHEN NOT {shape} THEN {shapeless} WHEN {role} THEN {role_v} "
                f"WHEN {gone} THEN {gone_v} WHEN {odd} THEN {odd_v} ELSE {rest} END)")

    score = ladder(0, 0, 20, 10, 30, base)
    status = ladder("'invalid'", "'invalid'", "'risky'", "'risky'", "'risky'",
                    f"CASE WHEN {base} >= 80 THEN 'valid' WHEN {base} >= 50 THEN 'risky' ELSE 'invalid' END")
    reason = ladder("'Invalid input'", "'Invalid email format'", "'Generic or placeholder email'", "'Disposable email domain'",
                    "'Suspicious email pattern'", f"CASE WHEN {base} >= 80 THEN 'Valid email format' ELSE 'Needs verification' END")
    return score, status, reason


def phone_format(phone: str, country: str = "NULL") -> str:
    d = f"regexp_replace({e(phone)}, '[^\\d+]', '', 'g')"
    codes = " ".join(f"WHEN {q(c.lower())} THEN {q(code)}" for c, code in R.DIAL_CODES.items())
    code = f"(CASE lower({country}) {codes} END)"
    return (
        f"(CASE WHEN starts_with({d}, '+') THEN {d} WHEN length({d}) = 10 AND lower({country}) IN ('us', 'ca') THEN '+1' || {d} "
        f"WHEN length({d}) = 11 AND starts_with({d}, '1') THEN '+' || {d} "
        f"WHEN {code} IS NOT NULL AND NOT starts_with({d}, {code}) THEN '+' || {code} || {d} ELSE '+' || {d} END)")


def phone_country(formatted: str) -> str:
    seen: dict[str, str] = {}
    for c, code in R.DIAL_CODES.items():
        seen.setdefault(code, c)
    whens = " ".join(f"WHEN starts_with({formatted}, {q('+' + code)}) THEN {q(c)}"
                     for code, c in sorted(seen.items(), key=lambda kv: -len(kv[0])))
    return f"(CASE {whens} ELSE 'Unknown' END)"


def with_views(names: tuple[str, ...], body: str, extra: str = "") -> str:
    """``body`` with the fixture views, and optionally further CTEs, in front."""
    head = ctes(*names).rstrip()
    return head + (",\n" + extra if extra else "") + "\n" + body
