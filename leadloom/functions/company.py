"""Company attributes: names, sizes, founding year, hiring signals, defaults, texts."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from leadloom.functions.text import col, group, text_or_empty


def normalize_company(name: Column | str) -> Column:
    """Lower case, single blanks, only letters, digits, underscore and blanks."""
    n = F.regexp_replace(F.trim(F.lower(text_or_empty(name))), r"\s+", " ")
    return F.trim(F.regexp_replace(n, r"[^a-zA-Z0-9_\s]", ""))


def similarity(a: Column | str, b: Column | str) -> Column:
    """1 - edit distance / longer length; 1.0 for two empty texts."""
    x, y = col(a), col(b)
    longer = F.greatest(F.length(x), F.length(y))
    return F.when(longer == 0, 1.0).otherwise((longer - F.levenshtein(x, y)) / longer)


#: A whole number, with or without thousands separators; never the tail of a longer one.
NUMBER = r"(?<![\d,])(\d{1,3}(?:,\d{3})+|\d+)"


def _count(pattern: str, text: Column) -> Column:
    n = F.regexp_replace(F.regexp_extract(text, pattern, 1), ",", "").try_cast("long")
    return F.when((n > 0) & (n < 1_000_000), n).cast("int")


def employee_count(html: Column | str) -> Column:
    """'N employees', 'N people', the JSON field, or the social description; 1..999999."""
    t = text_or_empty(html)
    return F.coalesce(
        _count(rf"(?i){NUMBER}\s+employees?", t),
        _count(rf"(?i){NUMBER}\s+people", t),
        _count(r'(?i)"numberOfEmployees"\s*:\s*"?(\d+)"?', t),
        _count(r"""(?i)<meta[^>]*property=["']og:description["'][^>]*content=["'][^"']*?""" + NUMBER + r"\s+employees?", t),
    )


def employee_range(count: Column | str) -> Column:
    n = col(count)
    return (
        F.when(n.isNull() | (n <= 0), F.lit(None).cast("string"))
        .when(n <= 10, "1-10").when(n <= 50, "11-50").when(n <= 200, "51-200").when(n <= 500, "201-500")
        .when(n <= 1000, "501-1000").otherwise("1000+")
    )


def employees_from_size(size: Column | str) -> Column:
    s = F.lower(col(size))
    return F.when(s == "micro", 5).when(s == "small", 25).when(s == "medium", 125).when(s == "large", 500)


def employees(extracted: Column | str, size: Column | str) -> Column:
    """Extracted count, else the middle of the size class."""
    return F.coalesce(col(extracted), employees_from_size(size))


def founded_year(text: Column | str, current_year: int) -> Column:
    """Year 1800..current after founded/established/since/started, in JSON, or after since/from."""
    t = text_or_empty(text)

    def year(pattern: str) -> Column:
        y = F.regexp_extract(t, pattern, 1).try_cast("int")
        return F.when(y.between(1800, current_year), y)

    return F.coalesce(
        year(r"(?i)(?:founded|established|since|started)\s+(?:in\s+)?(\d{4})"),
        year(r'(?i)"foundingDate"\s*:\s*"?(\d{4})"?'),
        year(r"(?i)(?:since|from|established|founded)\s+(\d{4})"),
    )


HIRING = (
    r"(?i)(we['’]?re\s+hiring|now\s+hiring|join\s+our\s+team|open\s+positions|job\s+openings|"
    r"career\s+opportunities|we\s+are\s+hiring|come\s+work\s+with\s+us|open\s+roles|vacancies|apply\s+now)"
)


def has_hiring_words(text: Column | str) -> Column:
    return text_or_empty(text).rlike(HIRING)


def hiring_signals(has_careers_page: Column | str, about: Column | str, website: Column | str) -> Column:
    """struct(is_hiring, has_careers_page, has_job_postings); all false without a website."""
    site = text_or_empty(website) != ""
    careers = site & F.coalesce(col(has_careers_page), F.lit(False))
    postings = site & has_hiring_words(about)
    return F.struct((careers | postings).alias("is_hiring"), careers.alias("has_careers_page"),
                    postings.alias("has_job_postings"))


def cleaned_aggregator_title(title: Column | str) -> Column:
    """Venue name from a review-site title."""
    return F.trim(F.regexp_replace(text_or_empty(title), r"(?i)\s*[-|]\s*(tripadvisor|zomato|yelp).*", ""))


def default_contacts(size: Column | str) -> Column:
    """Roles to look for by company size: array<struct(name, title, department, relevance, notes)>."""
    def c(name, title, department, relevance, notes):
        return F.struct(F.lit(name).alias("name"), F.lit(title).alias("title"), F.lit(department).alias("department"),
                        F.lit(relevance).alias("relevance"), F.lit(notes).alias("notes"))

    # fixed values
    large = F.array(
        c("CEO/Founder", "Chief Executive Officer", "Executive", 95, "Top decision maker"),
        c("Business Development Manager", "Business Development Manager", "Sales", 85,
          "Handles partnerships and growth"),
        c("Operations Director", "Operations Director", "Operations", 75, "Manages day-to-day operations"))
    medium = F.array(
        c("Founder/CEO", "Founder or CEO", "Executive", 90, "Primary decision maker"),
        c("Operations Manager", "Operations Manager", "Operations", 80, "Key operational contact"))
    small = F.array(c("Owner/Founder", "Owner or Founder", "Executive", 95, "Main decision maker for small business"))
    s = F.coalesce(col(size), F.lit("small"))
    return F.when(s == "large", large).when(s == "medium", medium).otherwise(small)


def contacts_from_people(people: Column | str, company: Column | str) -> Column:
    """Contact structs made from extracted people when no model ranks them."""
    from leadloom.functions.title import department, seniority

    def one(p: Column) -> Column:
        title = F.coalesce(F.nullif(p["title"], F.lit("")), F.lit("Executive"))
        return F.struct(
            p["name"].alias("name"), title.alias("title"), title.alias("normalized_title"),
            seniority(title).alias("seniority"), department(title).alias("department"), F.lit(95).alias("relevance"),
            p["email"].alias("suggested_email"),
            F.concat_ws(" ", p["name"], col(company), F.lit("LinkedIn")).alias("profile_query"),
            F.lit("Real contact extracted from company website").alias("notes"))

    return F.slice(F.transform(col(people), one), 1, 5)


def outreach_texts(company: Column | str) -> Column:
    """struct(intro, whatsapp, email, call_script) used when no model writes them."""
    name = text_or_empty(company)
    return F.struct(
        F.concat(F.lit("Hi, I noticed "), name, F.lit(" and thought you might be interested in...")).alias("intro"),
        F.lit("Hi! I came across your business and wanted to reach out about...").alias("whatsapp"),
        F.concat(F.lit("Subject: Partnership opportunity\n\nHi there,\n\nI noticed "), name, F.lit("...")).alias("email"),
        F.lit("Hi, this is [Your Name] calling about a potential partnership opportunity...").alias("call_script"))


def profile_name(og_title: Column | str, title: Column | str) -> Column:
    cleaned = F.regexp_replace(text_or_empty(title), r" \| LinkedIn", "")
    return F.coalesce(F.nullif(col(og_title), F.lit("")), F.nullif(cleaned, F.lit("")))


def first_group(pattern: str, text: Column | str) -> Column:
    return group(pattern, text_or_empty(text))
