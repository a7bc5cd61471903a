"""Dashboard numbers: one conditional aggregate per table, joined where needed."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column, DataFrame, functions as F

from leadloom.schemas import ENRICHMENT_STATUSES, WAITING_STATUSES


def is_kept(c: str = "is_duplicate") -> Column:
    return ~F.coalesce(F.col(c), F.lit(False))


def share(part: Column, whole: Column, digits: int = 2) -> Column:
    """Percentage, 0 for an empty whole."""
    return F.when(whole > 0, F.round(part * 100.0 / whole, digits)).otherwise(0.0)


def per(part: Column, whole: Column, digits: int = 1) -> Column:
    return F.when((whole > 0) & (part > 0), F.round(part * 1.0 / whole, digits)).otherwise(0.0)


def search_counts(searches: DataFrame, in_period: Column | None = None) -> DataFrame:
    """Searches in total and, within the period, by outcome; success rate, mean results, mean minutes."""
    p = F.lit(True) if in_period is None else in_period
    done = p & (F.col("status") == "completed")
    minutes = (F.unix_millis("completed_at") - F.unix_millis("started_at")) / 60000 if "completed_at" in searches.columns else F.lit(None).cast("double")
    t = searches.agg(
        F.count(F.lit(1)).alias("total_searches"), F.count_if(p).alias("searches_in_period"),
        F.count_if(done).alias("completed_searches"), F.count_if(p & (F.col("status") == "failed")).alias("failed_searches"),
        F.count_if(p & F.col("status").isin(WAITING_STATUSES)).alias("pending_searches"),
        F.coalesce(F.round(F.avg(F.when(done, F.col("total_results")))), F.lit(0)).cast("long").alias("avg_results"),
        F.coalesce(F.round(F.avg(F.when(done, minutes))), F.lit(0)).cast("long").alias("avg_minutes"))
    return t.withColumn("success_rate", share(F.col("completed_searches"), F.col("searches_in_period")))


def user_counts(users: DataFrame, in_period: Column | None = None) -> DataFrame:
    p = F.lit(True) if in_period is None else in_period
    return users.agg(
        F.count(F.lit(1)).alias("total_users"), F.count_if(p).alias("new_users"),
        F.count_if(F.col("role") == "admin").alias("admin_users"), F.count_if(F.col("role") == "member").alias("member_users"))


def company_counts(companies: DataFrame, in_period: Column | None = None) -> DataFrame:
    p = F.lit(True) if in_period is None else in_period
    return companies.agg(F.count(F.lit(1)).alias("total_companies"), F.count_if(p).alias("new_companies"))


def lead_funnel(leads: DataFrame, in_period: Column | None = None) -> DataFrame:
    """Leads by stage without duplicates, contact coverage, and rates; duplicates are rated against kept leads."""
    p = F.lit(True) if in_period is None else in_period
    kept = is_kept()
    mail = F.coalesce(F.size("emails"), F.lit(0)) > 0
    phone = F.coalesce(F.size("phones"), F.lit(0)) > 0
    t = leads.agg(
        F.count_if(kept).alias("total_leads"), F.count_if(p & kept).alias("leads_in_period"),
        F.count_if(p & kept & (F.col("extraction_status") == "extracted")).alias("extracted"),
        F.count_if(p & kept & (F.col("enrichment_status") == "enriched")).alias("enriched"),
        F.count_if(p & ~kept).alias("duplicates"), F.count_if(p & kept & mail).alias("with_email"),
        F.count_if(p & kept & phone).alias("with_phone"), F.count_if(p & kept & (mail | phone)).alias("with_contact"))
    c = F.col
    return t.select(
        "*", share(c("extracted"), c("leads_in_period")).alias("extraction_rate"),
        share(c("enriched"), c("extracted")).alias("enrichment_rate"),
        share(c("duplicates"), c("leads_in_period")).alias("duplicate_rate"),
        share(c("with_contact"), c("leads_in_period")).alias("contact_quality_rate"))


def health(rate: Column, good: float, fair: float) -> Column:
    return F.when(rate >= good, "healthy").when(rate >= fair, "warning").otherwise("critical")


def overview(users: DataFrame, companies: DataFrame, searches: DataFrame, leads: DataFrame, ledger_totals: DataFrame) -> DataFrame:
    """All single-row metrics side by side, with derived ratios and health. Every input is one row by construction."""
    one = F.lit(1).alias("k")
    parts = [user_counts(users), company_counts(companies), search_counts(searches), lead_funnel(leads), ledger_totals]
    out = parts[0].select("*", one)
    for p in parts[1:]:
        out = out.join(p.select("*", one), "k")
    c = F.col
    return out.drop("k").select(
        "*", per(c("leads_in_period"), c("searches_in_period")).alias("leads_per_search"),
        per(c("enriched"), c("searches_in_period")).alias("enriched_per_search"),
        share(c("searches_in_period"), c("total_users")).alias("user_engagement_rate"),
        per(c("total_searches"), c("total_users")).alias("searches_per_user"),
        per(c("total_leads"), c("total_users")).alias("leads_per_user"),
        per(c("revenue_usd"), c("total_users"), 2).alias("revenue_per_user"),
        per(c("leads_in_period"), c("consumed"), 2).alias("leads_per_credit"),
        health(c("success_rate"), 80, 60).alias("search_health"),
        health(c("extraction_rate"), 70, 50).alias("extraction_health"),
        health(c("enrichment_rate"), 60, 40).alias("enrichment_health"))


def calendar(spark, last: dt.date, days: int = 30) -> DataFrame:
    return spark.sql(
        "SELECT explode(sequence(date_sub(:d, :n - 1), CAST(:d AS DATE))) AS day", args={"d": last, "n": days})


def daily_trend(last: dt.date, users: DataFrame, searches: DataFrame, leads: DataFrame, companies: DataFrame, days: int = 30) -> DataFrame:
    """New users, searches, kept leads and companies per day, zero-filled. Each table is counted per day first."""
    out = calendar(users.sparkSession, last, days)
    first = last - dt.timedelta(days=days - 1)
    measures = [(users, "users"), (searches, "searches"), (leads.filter(is_kept()), "leads"), (companies, "companies")]
    for table, name in measures:
        day = F.to_date("created_at")
        counted = table.filter(day.between(F.lit(first), F.lit(last))).groupBy(day.alias("day")).agg(F.count(F.lit(1)).alias(name))
        out = out.join(counted, "day", "left").withColumn(name, F.coalesce(name, F.lit(0)))
    return out


def by_status(searches: DataFrame) -> DataFrame:
    return searches.groupBy("status").agg(F.count(F.lit(1)).alias("n"))


def top_industries(leads: DataFrame, limit: int = 10) -> DataFrame:
    """Most frequent industries of kept leads; ties by name."""
    rows = leads.filter(is_kept() & (F.coalesce("industry", F.lit("")) != ""))
    return rows.groupBy("industry").agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "industry").limit(limit)


def company_sizes(leads: DataFrame) -> DataFrame:
    rows = leads.filter(is_kept() & (F.coalesce("company_size", F.lit("")) != ""))
    return rows.groupBy("company_size").agg(F.count(F.lit(1)).alias("n"))


def user_activity(users: DataFrame, searches: DataFrame, leads: DataFrame) -> DataFrame:
    """Searches and leads per user, leads counted through their search. Leads are counted per search before the join."""
    per_search = leads.groupBy("search_id").agg(F.count(F.lit(1)).alias("leads"))
    per_user = searches.select("search_id", "user_id").join(per_search, "search_id", "left").groupBy("user_id").agg(
        F.count(F.lit(1)).alias("total_searches"), F.coalesce(F.sum("leads"), F.lit(0)).alias("total_leads"))
    return users.join(per_user, "user_id", "left").select(
        *users.columns, F.coalesce("total_searches", F.lit(0)).alias("total_searches"),
        F.coalesce("total_leads", F.lit(0)).alias("total_leads"))


def top_users(users: DataFrame, searches: DataFrame, leads: DataFrame, limit: int = 10) -> DataFrame:
    return user_activity(users, searches, leads).orderBy(F.desc("total_searches"), "user_id").limit(limit)


def company_activity(companies: DataFrame, users: DataFrame, searches: DataFrame, leads: DataFrame) -> DataFrame:
    """Members, searches and leads per company."""
    totals = user_activity(users.select("user_id", "company_id"), searches, leads).groupBy("company_id").agg(
        F.count(F.lit(1)).alias("members"), F.sum("total_searches").alias("searches"), F.sum("total_leads").alias("leads"))
    return companies.join(totals, "company_id", "left").select(
        *companies.columns, *[F.coalesce(c, F.lit(0)).alias(c) for c in ("members", "searches", "leads")])


def viewer_dashboard(users: DataFrame, companies: DataFrame, searches: DataFrame, leads: DataFrame) -> DataFrame:
    """Dashboard of every user: the company's numbers where searches are shared, else the own ones.

    Leads are counted per search, searches per user, users per company; then each user takes one of two rows, so no
    (viewer, search) pairs arise.
    """
    kept = leads.filter(is_kept())
    per_search = kept.groupBy("search_id").agg(
        F.count(F.lit(1)).alias("leads"), F.count_if(F.col("enrichment_status") == "enriched").alias("enriched"),
        F.count_if(F.col("signal_strength") >= 70).alias("high_signal"))
    template = F.col("is_template") if "is_template" in searches.columns else F.lit(False)
    names = ["searches", "completed", "leads", "enriched", "high_signal", "templates"]
    per_user = searches.join(per_search, "search_id", "left").groupBy("user_id").agg(
        F.count(F.lit(1)).alias("searches"), F.count_if(F.col("status") == "completed").alias("completed"),
        *[F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in ("leads", "enriched", "high_signal")],
        F.count_if(template).alias("templates"))
    own = users.select("user_id", "company_id").join(per_user, "user_id", "left").select(
        "user_id", "company_id", *[F.coalesce(c, F.lit(0)).alias(c) for c in names])
    whole = own.groupBy("company_id").agg(*[F.sum(c).alias("all_" + c) for c in names])
    share_templates = "share_templates" if "share_templates" in companies.columns else "share_searches"
    flags = companies.select("company_id", "share_searches", F.col(share_templates).alias("share_templates"))
    j = own.join(whole.join(flags, "company_id"), "company_id")

    def pick(c: str) -> Column:
        flag = "share_templates" if c == "templates" else "share_searches"
        return F.when(F.col(flag), F.col("all_" + c)).otherwise(F.col(c)).alias(c)

    return j.select("user_id", "company_id", *[pick(c) for c in names])


def enrichment_breakdown(leads: DataFrame) -> DataFrame:
    """Kept leads per search by enrichment status."""
    return leads.filter(is_kept()).groupBy("search_id").agg(
        *[F.count_if(F.col("enrichment_status") == s).alias(s) for s in ENRICHMENT_STATUSES])


def search_counters(leads: DataFrame) -> DataFrame:
    return leads.filter(is_kept()).groupBy("search_id").agg(
        F.count(F.lit(1)).alias("total"), F.count_if(F.col("extraction_status") == "extracted").alias("extracted"),
        F.count_if(F.col("enrichment_status") == "enriched").alias("enriched"))
