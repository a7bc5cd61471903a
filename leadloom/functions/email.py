"""E-mail checks, shapes and generated addresses as column expressions."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from leadloom import refdata as R
from leadloom.functions.person import NAME_REJECT_FIRST_WORDS, NAME_REJECT_WORDS
from leadloom.functions.text import alternation, col, let, null_if_empty, text_or_empty

ROLE_ADDRESS = rf"^({alternation(R.ROLE_MAILBOXES)})@|@({alternation(R.ROLE_MAIL_DOMAINS)})$"
SUSPICIOUS = r"^[0-9]+@|^[a-z]+\d+@|\.{2,}|@{2,}|^\.|\.$|@\.|\.@"
DISPOSABLE = "(" + alternation(R.DISPOSABLE_DOMAINS) + ")"


def _verdict(score: Column | int, status: Column | str, reason: Column | str) -> Column:
    def lit(x):
        return x if isinstance(x, Column) else F.lit(x)

    score = lit(score).cast("int")
    return F.struct(
        score.alias("score"), lit(status).alias("status"), lit(reason).alias("reason"),
        F.lit("syntax").alias("method"), (lit(status).isin("valid", "risky") & (score >= 50)).alias("valid"),
    )


def syntax_check(email: Column | str) -> Column:
    """struct(score 0-100, status, reason, method, valid) from the address alone."""
    return let(F.lower(F.trim(text_or_empty(email))), _checked_syntax)


def _checked_syntax(e: Column) -> Column:
    domain = F.regexp_extract(e, "@(.*)$", 1)
    score = (
        F.lit(70)
        + F.when(e.rlike(r"^[a-z]+\.[a-z]+@"), 10).otherwise(0)
        + F.when(e.rlike(r"^[a-z]\.[a-z]+@"), 5).otherwise(0)
        + F.when(domain.rlike(rf"\.({alternation(R.COMMON_MAIL_TLDS)})$"), 5).otherwise(0)
        - F.when(F.length(e) > 50, 10).otherwise(0)
        - F.when(F.length(e) < 10, 5).otherwise(0)
    )
    status = F.when(score >= 80, "valid").when(score >= 50, "risky").otherwise("invalid")
    reason = F.when(score >= 80, "Valid email format").otherwise("Needs verification")
    return (
        F.when(e == "", _verdict(0, "invalid", "Invalid input"))
        .when(~e.rlike(f"^{R.EMAIL_PATTERN}$"), _verdict(0, "invalid", "Invalid email format"))
        .when(e.rlike(ROLE_ADDRESS), _verdict(20, "risky", "Generic or placeholder email"))
        .when(domain.rlike(DISPOSABLE), _verdict(10, "risky", "Disposable email domain"))
        .when(e.rlike(SUSPICIOUS), _verdict(30, "risky", "Suspicious email pattern"))
        .otherwise(_verdict(score, status, reason))
    )


def format_check(email: Column | str) -> Column:
    """struct(valid, reason): shape, placeholder mailboxes and hosts, disposable domains."""
    e = text_or_empty(email)
    placeholder = (
        rf"(?i)^({alternation(R.FORMAT_PLACEHOLDER_MAILBOXES)})@|@({alternation(R.FORMAT_PLACEHOLDER_HOSTS)})\."
    )
    reason = (
        F.when(e == "", "Invalid input")
        .when(~e.rlike(r"^[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Z|a-z]{2,}$"), "Invalid email format")
        .when(e.rlike(placeholder), "Placeholder email pattern detected")
        .when(F.lower(F.regexp_extract(e, "@([^@]*)", 1)).isin(R.FORMAT_DISPOSABLE_DOMAINS), "Disposable email domain")
        .otherwise("Format valid")
    )
    return F.struct((reason == "Format valid").alias("valid"), reason.alias("reason"))


def is_business_email(email: Column | str) -> Column:
    e = F.lower(text_or_empty(email))
    return (e != "") & ~e.rlike(r"(noreply|no-reply|donotreply|example\.com)")


def verify_emails(emails: Column | str) -> Column:
    """Array of e-mail structs with their deliverability filled in; entries without an address drop."""
    present = F.filter(col(emails), lambda e: text_or_empty(e["email"]) != "")

    def checked(e: Column) -> Column:
        v = syntax_check(e["email"])
        d = F.struct(v["score"].alias("score"), v["status"].alias("status"), v["reason"].alias("reason"),
                     v["method"].alias("method"))
        return F.struct(e["email"].alias("email"), e["source"].alias("source"),
                        e["confidence"].alias("confidence"), d.alias("deliverability"))

    return F.transform(present, checked)


def deliverable(emails: Column | str, min_score: int = 50) -> Column:
    """Keep addresses scored at least ``min_score`` and not invalid; unscored ones stay."""
    def ok(e: Column) -> Column:
        d = e["deliverability"]
        return d.isNull() | ((d["score"] >= min_score) & (d["status"] != "invalid"))

    return F.filter(col(emails), ok)


def merge_emails(page_emails: Column | str, people: Column | str) -> Column:
    """Page e-mails, then people's e-mails (confidence 0.9) not yet present, ignoring case.

    Rows of one lead only, so the array stays small.
    """
    base = F.coalesce(col(page_emails), F.array().cast("array<struct<email:string,source:string,confidence:double>>"))
    extra = F.transform(
        F.filter(F.coalesce(col(people), F.array().cast(
            "array<struct<name:string,title:string,email:string,source:string,confidence:double>>")),
            lambda p: text_or_empty(p["email"]).contains("@")),
        lambda p: F.struct(F.lower(p["email"]).alias("email"), F.lit("decision_maker").alias("source"),
                           F.lit(0.9).alias("confidence")),
    )
    both = F.concat(base, extra)
    keys = F.transform(both, lambda e: F.lower(e["email"]))
    return F.filter(both, lambda e, i: F.array_position(keys, F.lower(e["email"])) == i + 1)


# --- shapes of local parts -----------------------------------------------------------------------

SHAPES = ["first.last", "first.lastInitial", "firstInitial.last", "firstInitial.lastInitial", "first", "last"]


def local_part_shape(email: Column | str) -> Column:
    """Shape of the local part (separator written as '.'), NULL for three or more parts or no '@'."""
    e = text_or_empty(email)
    local = F.lower(F.regexp_extract(e, "^([^@]*)@", 1))
    parts = F.split(local, "[._-]")
    a, b = F.length(parts[0]), F.length(F.get(parts, F.lit(1)))
    two = (
        F.when((a > 1) & (b > 1), "first.last")
        .when((a > 1) & (b == 1), "first.lastInitial")
        .when((a == 1) & (b > 1), "firstInitial.last")
        .when((a == 1) & (b == 1), "firstInitial.lastInitial")
    )
    one = F.when(F.length(local) < 5, "first").otherwise("last")
    return F.when(e.contains("@"), F.when(F.size(parts) == 2, two).when(F.size(parts) == 1, one))


def local_part_separator(email: Column | str) -> Column:
    """Separator of a two-part local part: '-', '_' or '.'; NULL for one part."""
    local = F.regexp_extract(text_or_empty(email), "^([^@]*)@", 1)
    two = F.size(F.split(local, "[._-]")) == 2
    return F.when(two, F.when(local.contains("-"), "-").when(local.contains("_"), "_").otherwise("."))


def email_from_shape(name: Column | str, shape: Column | str, separator: Column | str, domain: Column | str) -> Column:
    """Address of a person under a discovered shape; NULL for one-word names."""
    parts = F.split(F.lower(F.trim(col(name))), r"\s+")
    first, last = parts[0], F.element_at(parts, -1)
    i_first, i_last, sep = F.substring(first, 1, 1), F.substring(last, 1, 1), col(separator)
    kind = F.regexp_replace(col(shape), "[-_]", ".")
    local = (
        F.when(kind == "first.lastInitial", F.concat(first, sep, i_last))
        .when(kind == "firstInitial.last", F.concat(i_first, sep, last))
        .when(kind == "firstInitial.lastInitial", F.concat(i_first, sep, i_last))
        .when(kind == "first", first)
        .when(kind == "last", last)
        .otherwise(F.concat(first, sep, last))
    )
    clean = F.regexp_replace(local, "[^a-z0-9._-]", "")
    clean = F.regexp_replace(clean, lit_pattern("[._-]{2,}"), sep)
    return F.when((F.size(parts) >= 2) & filled_all(domain, shape), F.concat(clean, F.lit("@"), col(domain)))


def lit_pattern(p: str) -> Column:
    return F.lit(p)


def filled_all(*cs: Column | str) -> Column:
    out = F.lit(True)
    for c in cs:
        out = out & (text_or_empty(c) != "")
    return out


# --- templates -----------------------------------------------------------------------------------

PLACEHOLDER_TERM = r"(firstname|lastname|firstinitial|lastinitial)"
LITERAL_PLACEHOLDER = rf"(?i)(?<!\{{){PLACEHOLDER_TERM}(?!\}})"


def usable_template(template: Column | str) -> Column:
    """The template, or NULL when it carries a placeholder word outside braces."""
    t = col(template)
    return F.when(~t.rlike(LITERAL_PLACEHOLDER), null_if_empty(t))


def strip_honorific(name: Column | str) -> Column:
    return F.trim(F.regexp_replace(F.trim(text_or_empty(name)), rf"(?i)^({alternation(R.HONORIFICS)})\.?\s+", ""))


NAME_IS_COPY = r"(?i)^(" + alternation(NAME_REJECT_FIRST_WORDS) + r")\b|\b(" + alternation(NAME_REJECT_WORDS) + r")\b"


def email_from_template(name: Column | str, template: Column | str, website: Column | str) -> Column:
    """Fill ``{firstname}``-style templates for a person; NULL when name or result is not usable."""
    from leadloom.functions.url import url_host

    def fill(first: Column, last: Column) -> Column:
        values = {
            "firstinitial": F.substring(first, 1, 1), "lastinitial": F.substring(last, 1, 1),
            "firstname": first, "lastname": last,
        }
        out = col(template)
        for word, value in values.items():
            out = F.regexp_replace(out, F.lit(r"(?i)\{?" + word + r"\}?"), value)
        return F.lower(out)

    def address(bare: Column) -> Column:
        words = F.transform(F.split(bare, r"\s+"), lambda w: F.regexp_replace(F.lower(w), "[^a-z]", ""))
        named = bare.rlike(r"^[A-Z][a-z]+(?:\s+[A-Z][a-z]+)+") & ~bare.rlike(NAME_IS_COPY)
        made = let(words, lambda p: F.when(
            (F.size(p) >= 2) & (F.length(p[0]) >= 2) & (F.length(F.element_at(p, -1)) >= 2), fill(p[0], F.element_at(p, -1))))
        whole = let(made, lambda m: F.when(m.contains("@"), m).otherwise(F.concat(m, F.lit("@"), url_host(website))))
        return let(whole, lambda w: F.when(named & w.rlike(f"^{R.EMAIL_PATTERN}$"), w))

    return F.when(url_host(website).isNotNull(), let(strip_honorific(name), address))
