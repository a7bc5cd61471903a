"""The fixture views as tables of the library's schemas."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from leadloom import schemas as S
from leadloom.functions.email import verify_emails
from leadloom.functions.phone import format_phone, phone_country
from leadloom.functions.score import quality_score
from leadloom.session import spread
from leadloom.sources.fixtures import table, view, with_enrichment


def leads(spark: SparkSession, sf_dir: str, scored: bool = False) -> DataFrame:
    """Leads with one e-mail, phone and person each at most, joined with their flat enrichment.

    ``scored`` adds ``quality_score``. The score asks for the number of e-mails and phones only, so it is taken from the
    lists before their entries are verified and formatted; a job that reads no entries does not pay for them.
    """
    v = with_enrichment(view(spark, sf_dir, "v_leads"))
    c = F.col

    def one_if(present: Column, item: Column, ddl: str) -> Column:
        return F.when(present, F.array(item)).otherwise(F.array().cast(f"array<{ddl}>"))

    mail = F.struct(c("email").alias("email"), F.lit("website").alias("source"), F.lit(0.8).alias("confidence"))
    formatted = format_phone("phone")
    phone = F.struct(c("phone").alias("phone"), phone_country(formatted).alias("country"), formatted.alias("formatted"),
                     F.lit("website").alias("source"), F.lit(0.7).alias("confidence"))
    null = F.lit(None).cast("string")
    person = F.struct(
        F.lit("John Baker").alias("name"), c("title").alias("title"), null.alias("normalized_title"), null.alias("seniority"),
        null.alias("department"), null.alias("email"), F.lit("website").alias("source"), F.lit(0.85).alias("confidence"))
    socials = F.struct(
        F.when(c("lead_id") % 10 == 0, "https://linkedin.com/company/x").alias("linkedin"),
        F.when(c("lead_id") % 15 == 0, "https://x.com/x").alias("twitter"), null.alias("facebook"), null.alias("instagram"))
    contact = F.struct(*[
        F.lit({"name": "Jane Baker", "title": "Director"}.get(f.split(":")[0])).cast(f.split(":")[1]).alias(f.split(":")[0])
        for f in S.CONTACT[len("struct<"):-1].split(",")])
    mails = one_if(c("email").isNotNull(), mail, "struct<email:string,source:string,confidence:double>")
    people = one_if(c("title").isNotNull(), person, S.PERSON)
    score = quality_score({"emails": mails, "phones": one_if(c("phone").isNotNull(), c("phone"), "string"),
                           "decision_makers": people, "socials": socials, "about_text": null})
    return v.select(
        "lead_id", "search_id", "company_name", "website", verify_emails(mails).alias("emails"),
        one_if(c("phone").isNotNull(), phone, S.PHONE).alias("phones"), F.array().cast("array<string>").alias("whatsapp_links"),
        "address", socials.alias("socials"), null.alias("about_text"), F.array().cast("array<string>").alias("category_signals"),
        people.alias("decision_makers"),
        F.lit("extracted").alias("extraction_status"), "enrichment_status",
        F.when(c("lead_id") % 17 == 0, True).otherwise(False).alias("is_duplicate"),
        "signal_strength", "verification_score", "industry", "company_size", "email_pattern", "linkedin_company_url",
        "employee_count", one_if(c("lead_id") % 3 == 0, contact, S.CONTACT).alias("contacts"),
        c("created_date").cast("timestamp").alias("created_at"), *([score.alias("quality_score")] if scored else []))


def searches(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = view(spark, sf_dir, "v_searches")
    start = F.col("created_date").cast("timestamp")
    return v.withColumns({
        "created_at": start, "started_at": start,
        "completed_at": F.timestamp_seconds(F.unix_seconds(start) + 60 * (F.col("search_id") % 50)),
        "result_count": F.when(F.col("search_id") % 3 == 0, 50).otherwise(100),
        "is_template": F.col("search_id") % 6 == 0,
        "query": F.concat(F.lit("software companies in "), F.coalesce("location", F.lit("Accra"))),
        "country": F.when(F.col("search_id") % 2 == 0, "ng").otherwise("pt"),
        "industry": F.when(F.col("search_id") % 5 == 0, "software"),
    })


def users(spark: SparkSession, sf_dir: str) -> DataFrame:
    return view(spark, sf_dir, "v_users").withColumn("created_at", F.col("created_date").cast("timestamp"))


def companies(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = view(spark, sf_dir, "v_companies")
    return c.withColumns({"share_leads": F.col("share_searches"), "share_templates": F.col("share_searches"),
                          "created_at": F.to_timestamp(F.lit("2024-01-10"))})


def ledger(spark: SparkSession, sf_dir: str) -> DataFrame:
    return view(spark, sf_dir, "v_ledger")


def results(spark: SparkSession, sf_dir: str) -> DataFrame:
    null = F.lit(None).cast("string")
    v = view(spark, sf_dir, "v_results")
    return v.select("search_id", "provider", "pos", "title", "link", null.alias("snippet"), null.alias("phone"),
                    null.alias("address"), null.alias("place_id"), (F.col("provider") == "places").alias("is_place"))


def site_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return view(spark, sf_dir, "v_site_pages")


def all_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Driver pages and contact-rich site pages; the latter get ids above all others."""
    site = site_pages(spark, sf_dir).select((F.col("page_id") + 10_000_000).alias("page_id"), "url", "html")
    crawl = table(spark, sf_dir, "pages").select("page_id", "url", "html")
    return spread(crawl, "page_id").unionByName(site)


def events(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events")
    return e.withColumn("ts", F.col("ts").cast("timestamp"))
