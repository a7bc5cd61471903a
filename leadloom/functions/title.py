"""Job titles: standard form, seniority, department, relevance."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from leadloom.functions.text import col, text_or_empty

# Fixed values: (pattern, standard title), first match wins. Acronyms are whole words, and the
# vice-president rule stands before the president rule.
TITLE_LADDER = [
    (r"vice\s+president|\bvp\s+of|\bv\.p\.|vice\s+pres", "Vice President"),
    (r"chief\s+executive|\bceo\b|founder|president|owner|proprietor", "Chief Executive Officer"),
    (r"chief\s+tech|\bcto\b", "Chief Technology Officer"),
    (r"chief\s+financ|\bcfo\b", "Chief Financial Officer"),
    (r"chief\s+operati(ng|ons)|\bcoo\b", "Chief Operating Officer"),
    (r"chief\s+marketing|\bcmo\b", "Chief Marketing Officer"),
    (r"exec(utive)?\s+director", "Executive Director"),
    (r"managing\s+director|\bmd\b", "Managing Director"),
    (r"^\s*director\b|director\s+of|head\s+of", "Director"),
    (r"general\s+manager|\bgm\b|country\s+manager", "General Manager"),
    (r"(senior|\bsr)\s+manager", "Senior Manager"),
    (r"^\s*manager\b|manager\s+of", "Manager"),
    (r"team\s+lead|lead\s+developer|lead\s+engineer|technical\s+lead", "Team Lead"),
    (r"supervisor|supervising", "Supervisor"),
    (r"coordinator|co-ordinator", "Coordinator"),
    (r"specialist|expert|consultant", "Specialist"),
    (r"sales\s+director", "Sales Director"),
    (r"sales\s+manager", "Sales Manager"),
    (r"business\s+development|\bbd\s+manager|\bbdm\b", "Business Development Manager"),
    (r"marketing\s+director", "Marketing Director"),
    (r"marketing\s+manager", "Marketing Manager"),
    (r"operations\s+director", "Operations Director"),
    (r"operations\s+manager", "Operations Manager"),
]
SENIORITY_LADDER = [
    (r"chief|\b(ceo|cto|cfo|coo|cmo|vp)\b|president|founder|owner|executive\s+director|managing\s+director",
     "executive"),
    (r"senior|\bsr\b|head\s+of|director|lead|principal", "senior"),
    (r"junior|\bjr\b|intern|trainee|assistant|associate", "junior"),
]
DEPARTMENT_LADDER = [
    (r"sales|business\s+development|\bbd\b", "Sales"),
    (r"marketing|brand|advertising|promotion", "Marketing"),
    (r"tech|engineering|software|development|\bit\b", "Technology"),
    (r"operations|\bops\b|logistics|supply\s+chain", "Operations"),
    (r"financ|accounting|accountant|\bcfp\b", "Finance"),
    (r"\bhr\b|human\s+resources|recruiting|talent|people", "Human Resources"),
    (r"customer\s+success|customer\s+service|support|client\s+services", "Customer Success"),
    (r"product|\bpm\b", "Product"),
    (r"executive|\bceo\b|president|founder|owner|board", "Executive"),
    (r"legal|compliance|regulatory", "Legal"),
]


def ladder(c: Column, rules: list[tuple[str, str]], default: Column) -> Column:
    out = F.when(c.rlike("(?i)" + rules[0][0]), F.lit(rules[0][1]))
    for pattern, value in rules[1:]:
        out = out.when(c.rlike("(?i)" + pattern), F.lit(value))
    return out.otherwise(default)


def normalize_title(title: Column | str) -> Column:
    """Standard title, the trimmed original when no rule fits, NULL for no title."""
    t = text_or_empty(title)
    return F.when(t != "", ladder(t, TITLE_LADDER, F.trim(t)))


def seniority(title: Column | str) -> Column:
    return ladder(text_or_empty(title), SENIORITY_LADDER, F.lit("mid"))


def department(title: Column | str) -> Column:
    return ladder(text_or_empty(title), DEPARTMENT_LADDER, F.lit("General"))


def title_relevance(title: Column | str) -> Column:
    from leadloom import refdata as R

    t = F.lower(text_or_empty(title))
    return (
        F.when(t.rlike(f"({R.EXECUTIVE_WORDS})"), 1.0)
        .when(t.rlike("(executive)"), 0.85)
        .when(t.rlike("(lead|supervisor)"), 0.7)
        .otherwise(0.5)
    )


def enrich_person(p: Column, template: Column, website: Column) -> Column:
    """Person struct with normal title, seniority, department and, where missing, a template e-mail."""
    from leadloom.functions.email import email_from_template

    mail = F.coalesce(F.nullif(p["email"], F.lit("")), email_from_template(p["name"], template, website))
    return F.struct(
        p["name"].alias("name"), p["title"].alias("title"),
        F.coalesce(normalize_title(p["title"]), p["title"]).alias("normalized_title"),
        seniority(p["title"]).alias("seniority"), department(p["title"]).alias("department"),
        mail.alias("email"), F.coalesce(p["source"], F.lit("ai_inferred")).alias("source"),
        F.coalesce(p["confidence"], F.lit(0.75)).alias("confidence"),
    )


def enrich_people(people: Column | str, template: Column | str, website: Column | str) -> Column:
    named = F.filter(col(people), lambda p: text_or_empty(p["name"]) != "")
    return F.transform(named, lambda p: enrich_person(p, col(template), col(website)))
