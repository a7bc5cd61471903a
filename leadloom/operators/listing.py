"""Lists a viewer sees: visibility, filters, ranking, pages, neighbours, previews, exports."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from leadloom import refdata as R
from leadloom.functions.text import null_if_empty, text_or_empty
from leadloom.operators.skew import bucketed_rank, top_per_key
from leadloom.session import checkpointed

SHARE_FLAGS = ("share_searches", "share_leads", "share_templates")


def visible_searches(viewer_id: int, searches: DataFrame, users: DataFrame, companies: DataFrame, share: str) -> DataFrame:
    """Searches one viewer may see: those of the whole company where the flag ``share`` is set, else the own ones.

    People without a company see nothing. The viewer is one row; colleagues meet searches on the user id.
    """
    viewer = users.filter((F.col("user_id") == viewer_id) & F.col("company_id").isNotNull()).select("company_id").join(
        companies.select("company_id", F.coalesce(F.col(share), F.lit(False)).alias("shared")), "company_id")
    seen_users = users.select("user_id", "company_id").join(viewer, "company_id").filter(
        F.col("shared") | (F.col("user_id") == viewer_id)).select("user_id")
    return searches.select("search_id", "user_id").join(seen_users, "user_id", "left_semi").select("search_id")


def visible_to(table: DataFrame, viewer_id: int, searches: DataFrame, users: DataFrame, companies: DataFrame, share: str) -> DataFrame:
    """Rows of a table with ``search_id`` that one viewer may see."""
    ids = visible_searches(viewer_id, searches, users, companies, share)
    return table.join(ids, "search_id", "left_semi").select(*table.columns)


def filter_leads(leads: DataFrame, search_id: int | None = None, min_signal: int | None = None, country: str | None = None,
                 industry: str | None = None, max_distance: float | None = None) -> DataFrame:
    """Non-duplicates by search, signal, country of any phone (any case), industry text and distance."""
    out = leads.filter(~F.coalesce("is_duplicate", F.lit(False)))
    if search_id is not None:
        out = out.filter(F.col("search_id") == search_id)
    if min_signal is not None:
        out = out.filter(F.col("signal_strength") >= min_signal)
    if country is not None:
        out = out.filter(F.exists("phones", lambda p: F.upper(p["country"]) == country.upper()))
    if industry is not None:
        out = out.filter(F.col("industry").rlike("(?i)" + re.escape(industry)))
    if max_distance is not None and max_distance > 0:
        out = out.filter(F.col("distance_km") <= max_distance)
    return out


def bulk_select(leads: DataFrame, ids: DataFrame) -> DataFrame:
    """Leads in an id list. The list's size is not known here, so Spark chooses the join by its statistics."""
    return leads.join(ids.select("lead_id").distinct(), "lead_id", "left_semi").select(*leads.columns)


def period_filter(table: DataFrame, period: str, now: Column, start: Column | None = None, end: Column | None = None,
                  at: str = "created_at") -> DataFrame:
    """Rows of today, the last week, the last month, or a closed range; 'all' keeps everything."""
    t = F.col(at)
    if period == "today":
        return table.filter(t >= F.date_trunc("day", now))
    if period == "week":
        return table.filter(t >= now - F.expr("INTERVAL 7 DAYS"))
    if period == "month":
        return table.filter(t >= now - F.expr("INTERVAL 1 MONTH"))
    if start is not None and end is not None:
        return table.filter((t >= start) & (t <= end))
    return table


ID_WIDTH = 1_000_000


def lead_order(by: str = "rank", ascending: bool = False) -> list[Column]:
    """Sort of a lead list, NULLs last, ties by lead id.

    rank: quality, verification, signal. quality_score: quality in the wanted direction, then the others down.
    signal_strength: like rank when descending; signal first when ascending. company_name and created_at: that column.
    """
    down = [F.desc_nulls_last("quality_score"), F.desc_nulls_last("verification_score"), F.desc_nulls_last("signal_strength")]
    if by in ("company_name", "created_at"):
        first = [F.asc_nulls_last(by) if ascending else F.desc_nulls_last(by)]
    elif ascending and by == "quality_score":
        first = [F.asc_nulls_last("quality_score"), *down[1:]]
    elif ascending and by == "signal_strength":
        first = [F.asc_nulls_last("signal_strength"), *down[:2]]
    else:
        first = down
    return [*first, F.asc("lead_id")]


def page_of(table: DataFrame, order: list[Column], page: int, size: int) -> DataFrame:
    """Rows of one page; Spark keeps only the first page*size rows per task."""
    return table.orderBy(*order).limit(page * size).offset((page - 1) * size)


def _ranges(by: str, ascending: bool) -> list[list[Column]]:
    """Coarse forms of ``lead_order`` as ascending columns, in levels: a row of an earlier range sorts earlier."""
    def up(c: str) -> list[Column]:
        return [F.col(c).isNull(), F.coalesce(F.col(c), F.lit(0))]

    def down(c: str) -> list[Column]:
        return [F.col(c).isNull(), -F.coalesce(F.col(c), F.lit(0))]

    if by == "created_at":
        day = F.floor(F.unix_micros(F.col(by).cast("timestamp")) / 86_400_000_000)
        return [[F.col(by).isNull(), F.coalesce(day if ascending else -day, F.lit(0))]]
    if by == "company_name":
        return [[F.col(by).isNull(), F.coalesce(F.substring(by, 1, n), F.lit(""))] for n in (2, 8)]
    scores = ["quality_score", "verification_score", "signal_strength"]
    if ascending and by in ("quality_score", "signal_strength"):
        levels = up(by) + [x for c in scores if c != by for x in down(c)]
    else:
        levels = [x for c in scores for x in down(c)]
    return [levels, [F.floor(F.col("lead_id") / ID_WIDTH)]]


def deep_page(table: DataFrame, by: str, ascending: bool, page: int, size: int) -> DataFrame:
    """Rows of one page, however deep: rows are counted per range of the sort key, level by level, and only the ranges
    that the page touches are counted finer and at last sorted.

    ``lead_id`` is unique. A level has few ranges: combinations of scores, days, beginnings of names; ranges of ids
    only inside the combinations left. Names in descending order are cut by ``page_of``.
    """
    if by == "company_name" and not ascending:
        return page_of(table, lead_order(by, ascending), page, size)
    rows, first, names = table, (page - 1) * size, []
    for level, columns in enumerate(_ranges(by, ascending)):
        rows = rows.withColumns({f"__r{level}_{i}": c for i, c in enumerate(columns)})
        names += [f"__r{level}_{i}" for i in range(len(columns))]
        counts = rows.groupBy(*names).agg(F.count(F.lit(1)).alias("n"))
        ends = counts.withColumn("end", F.sum("n").over(W.orderBy(*names).rowsBetween(W.unboundedPreceding, W.currentRow)))
        touched = checkpointed(ends.filter((F.col("end") > first) & (F.col("end") - F.col("n") < first + size)))
        first -= touched.agg(F.min(F.col("end") - F.col("n"))).first()[0] or 0
        rows = rows.join(F.broadcast(touched.select(*names)), names, "left_semi")  # at most one range per row of the page
    return rows.drop(*names).orderBy(*lead_order(by, ascending)).offset(first).limit(size)


def page_info(table: DataFrame, page: int, size: int) -> DataFrame:
    return table.agg(F.count(F.lit(1)).alias("total")).select(
        F.lit(page).alias("page"), F.lit(size).alias("limit"), "total",
        F.ceil(F.col("total") / size).cast("long").alias("pages"))


def ranked_within_search(leads: DataFrame, rank: str = "rank") -> DataFrame:
    """Position of every lead in its search. Buckets are the three scores and ranges of ids, so that one large search
    is ranked by many tasks."""
    def score(c: str) -> Column:
        return F.coalesce(F.col(c), F.lit(-1))

    buckets = [("__q", score("quality_score"), False), ("__v", score("verification_score"), False),
               ("__s", score("signal_strength"), False), ("__i", F.floor(F.col("lead_id") / ID_WIDTH), True)]
    return bucketed_rank(leads, ["search_id"], lead_order(), buckets, rank)


def neighbours(leads: DataFrame) -> DataFrame:
    """Previous and next lead, position and total in the ranked list of each search.

    Every lead is sent to its own position and to those next to it; one grouping by position brings them together.
    """
    ranked = ranked_within_search(leads.select(
        "lead_id", "search_id", "quality_score", "verification_score", "signal_strength")).select("search_id", "lead_id", "rank")
    sent = ranked.select(
        "search_id", "lead_id", F.explode(F.array(*[
            F.struct((F.col("rank") + d).alias("position"), F.lit(-d).alias("role")) for d in (0, 1, -1)])).alias("t"))
    at = sent.groupBy("search_id", "t.position").agg(*[
        F.max(F.when(F.col("t.role") == role, F.col("lead_id"))).alias(name)
        for role, name in ((0, "lead_id"), (-1, "previous_id"), (1, "next_id"))])
    totals = leads.groupBy("search_id").agg(F.count(F.lit(1)).alias("total"))
    return at.filter("lead_id IS NOT NULL").join(totals, "search_id").select(
        "search_id", "lead_id", "previous_id", "next_id", "position", "total")


def preview(leads: DataFrame, searches: DataFrame, users: DataFrame, balances: DataFrame, limit: int = R.PREVIEW_LIMIT) -> DataFrame:
    """Leads shown per search: all, or the best ``limit`` when the owner's company has no credits.

    Only searches with a preview are ranked, and by a rank filter with a constant bound.
    """
    owner = searches.select("search_id", "user_id").join(users.select("user_id", "company_id"), "user_id", "left").join(
        balances.select("company_id", "balance"), "company_id", "left")
    # owners without a company are not limited
    owner = owner.select("search_id", (F.col("company_id").isNotNull() & (F.coalesce("balance", F.lit(0)) <= 0)).alias("limited"))
    marked = leads.filter(~F.coalesce("is_duplicate", F.lit(False))).join(owner, "search_id")
    cut = top_per_key(marked.filter("limited"), ["search_id"], lead_order(), limit)
    return marked.filter("NOT limited").unionByName(cut)


def recent_searches(searches: DataFrame, limit: int = 5) -> DataFrame:
    """Newest searches with the dashboard columns."""
    wanted = ["search_id", "query", "country", "location", "status", "created_at", "total_results", "extracted_count",
              "enriched_count"]
    cols = [c for c in wanted if c in searches.columns]
    return searches.select(*cols).orderBy(F.desc("created_at"), F.desc("search_id")).limit(limit)


def templates(searches: DataFrame) -> DataFrame:
    return searches.filter("is_template").orderBy(F.desc("created_at"), F.desc("search_id"))


def members(users: DataFrame, company_id: int) -> DataFrame:
    """People of a company by join date, without secrets."""
    return users.drop("password").filter(F.col("company_id") == company_id).orderBy("created_at", "user_id")


# --- export --------------------------------------------------------------------------------------

def _joined(array: Column) -> Column:
    return F.coalesce(F.array_join(array, "; "), F.lit(""))


def _flag(c: Column) -> Column:
    return F.when(c, "Yes").when(~c, "No").otherwise("")


def _number(c: Column) -> Column:
    """Text of a number; missing and zero give ''."""
    return F.coalesce(F.when(c != 0, c.cast("string")), F.lit(""))


def export_columns() -> list[Column]:
    """The 45 export columns of a lead with its enrichment; missing values are ''."""
    c = F.col
    d = lambda e: e["deliverability"]
    mail = F.get("emails", F.lit(0))
    person = F.get("decision_makers", F.lit(0))
    phones = F.filter(F.transform("phones", lambda p: F.coalesce(null_if_empty(p["formatted"]), p["phone"])),
                      lambda p: text_or_empty(p) != "")
    mails = F.transform("emails", lambda e: F.when(
        text_or_empty(d(e)["status"]) != "",
        F.concat(text_or_empty(e["email"]), F.lit(" ("), d(e)["status"],
                 F.when(F.coalesce(d(e)["score"], F.lit(0)) != 0, F.concat(F.lit(" "), d(e)["score"].cast("string"))).otherwise(""),
                 F.lit(")"))).otherwise(text_or_empty(e["email"])))

    def described(p: Column, mail_field: str, extra: Column | None = None) -> Column:
        def optional(value: Column, before: str, after: str = "") -> Column:
            return F.when(text_or_empty(value) != "", F.concat(F.lit(before), value, F.lit(after)))
        parts = [text_or_empty(p["name"]), optional(p["title"], "(", ")"), optional(p[mail_field], "- ")]
        return F.concat_ws(" ", *parts, *([optional(extra, "[", "]")] if extra is not None else []))

    people = F.transform("decision_makers", lambda p: described(p, "email"))
    contacts = F.transform("contacts", lambda p: described(p, "suggested_email", p["seniority"]))
    size = F.coalesce(F.when(c("employee_count") != 0, c("employee_count").cast("string")), c("employee_count_range"), F.lit(""))
    n = lambda a: F.coalesce(F.size(a), F.lit(0))
    cols = {
        "company_name": text_or_empty("company_name"), "website": text_or_empty("website"),
        "about": F.coalesce(null_if_empty(c("business_summary")), c("about_text"), F.lit("")),
        "primary_email": text_or_empty(mail["email"]), "primary_email_status": text_or_empty(d(mail)["status"]),
        "primary_email_score": _number(d(mail)["score"]), "all_emails": _joined(mails),
        "primary_phone": text_or_empty(F.get(phones, F.lit(0))), "all_phones": _joined(phones),
        "whatsapp": text_or_empty(F.get("whatsapp_links", F.lit(0))), "all_whatsapp": _joined(c("whatsapp_links")),
        "location": text_or_empty("address"), "location_city": text_or_empty("location.city"),
        "location_state": text_or_empty("location.state"), "location_country": text_or_empty("location.country"),
        "location_formatted": F.coalesce(null_if_empty(c("location.formatted")), c("address"), F.lit("")),
        "person_name": text_or_empty(person["name"]), "person_title": text_or_empty(person["title"]),
        "person_email": text_or_empty(person["email"]), "person_source": text_or_empty(person["source"]),
        "person_confidence": F.coalesce(F.when(person["confidence"] != 0, F.concat(
            F.round(person["confidence"]).cast("int").cast("string"), F.lit("%"))), F.lit("")),
        "all_people": _joined(people), "person_count": n("decision_makers"), "contacts": _joined(contacts),
        "contact_count": n("contacts"), "linkedin_company_url": text_or_empty("linkedin_company_url"),
        "industry": text_or_empty("industry"), "company_size": text_or_empty("company_size"), "employee_count": size,
        "revenue_bracket": text_or_empty("revenue_bracket"), "founded_year": _number(c("founded_year")),
        "email_pattern": text_or_empty("email_pattern"), "is_hiring": _flag(c("hiring.is_hiring")),
        "has_careers_page": _flag(c("hiring.has_careers_page")), "has_job_postings": _flag(c("hiring.has_job_postings")),
        "signal_strength": F.coalesce("signal_strength", F.lit(0)), "verification_score": _number(c("verification_score")),
        "quality_score": _number(c("quality_score")), "contact_relevance": _number(c("contact_relevance")),
        "linkedin": text_or_empty("socials.linkedin"), "twitter": text_or_empty("socials.twitter"),
        "facebook": text_or_empty("socials.facebook"), "instagram": text_or_empty("socials.instagram"),
        "distance_km": _number(c("distance_km")), "category_signals": _joined(c("category_signals")),
    }
    return [v.alias(k) for k, v in cols.items()]


def export_leads(leads: DataFrame, ids: DataFrame | None = None, search_id: int | None = None, limit: int = R.EXPORT_LIMIT) -> DataFrame:
    """Flat export of non-duplicates by signal, the first ``limit``; rows are cut before they are flattened."""
    rows = filter_leads(leads, search_id=search_id)
    if ids is not None:
        rows = bulk_select(rows, ids)
    top = rows.orderBy(F.desc_nulls_last("signal_strength"), F.asc("lead_id")).limit(limit)
    return top.select("lead_id", *export_columns())
