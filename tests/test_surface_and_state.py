"""SQL functions against column functions, and stateful streams against plain folds."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from leadloom import sqlapi
from leadloom.functions import company, domain, email, location, phone, title, url
from leadloom.operators import queue
from leadloom.streaming import live

c = F.col
def rules():
    return {
        "bare_domain(url)": url.bare_domain("url"), "url_host(url)": url.url_host("url"), "url_path(url)": url.url_path("url"), "url_origin(url)": url.url_origin("url"),
        "same_domain(url, other)": url.same_domain("url", "other"), "absolute_url(other, url)": url.absolute_url(c("other"), c("url")),
        "social_platform(url)": url.social_platform("url"), "is_social_host(url_host(url))": domain.is_social_host(url.url_host("url")),
        "is_query_link(url)": url.is_query_link("url"), "query_link_text(url)": url.query_link_text("url"), "query_link_location(url)": url.query_link_location("url"),
        "is_placeholder_host(url_host(url))": domain.is_placeholder_host(url.url_host("url")), "is_blocked_platform(url_host(url))": domain.is_blocked_platform(url.url_host("url")),
        "is_known_directory(url_host(url))": domain.is_known_directory(url.url_host("url")),
        "normalize_company(text)": company.normalize_company("text"), "company_similarity(text, mail)": company.similarity("text", "mail"),
        "employee_count(text)": company.employee_count("text"), "employee_range(employee_count(text))": company.employee_range(company.employee_count("text")),
        "employees_from_size(size)": company.employees_from_size("size"), "founded_year(text, 2026)": company.founded_year("text", 2026),
        "has_hiring_words(text)": company.has_hiring_words("text"), "format_phone(tel, country)": phone.format_phone("tel", "country"),
        "phone_country(format_phone(tel, country))": phone.phone_country(phone.format_phone("tel", "country")), "is_sane_phone(tel)": phone.is_sane_phone("tel"),
        "email_score(mail)": email.syntax_check("mail")["score"], "email_reason(mail)": email.syntax_check("mail")["reason"], "is_business_email(mail)": email.is_business_email("mail"),
        "normalize_title(text)": title.normalize_title("text"), "seniority(text)": title.seniority("text"), "department(text)": title.department("text"),
        "address_country(text)": location.address_country("text"),
        "distance_km(6.5, 3.4, 51.5, -0.1)": location.haversine_km(F.lit(6.5), F.lit(3.4), F.lit(51.5), F.lit(-0.1)),
    }


VALUES = {
    "url": [None, "", "https://www.A.com:80/x?q=1#f", "http://user@b.co.uk./p", "google.com/search?q=Joe%27s+Bar+in+Lagos%2C+NG", "https://m.facebook.com/x",
            "https://x.com/y", "https://example.com/", "https://www.yellowpages.com/a", "ftp://q", " HTTPS://C.io ", "https://google.com/search?q=%zz"],
    "other": ["/a", "//h.com/b", "mailto:x@y.z", "rel/page", "https://Q.com/z", None, "", "https://www.a.com/"],
    "text": [None, "", "  Acme   Ltd! ", "we have 1,200 employees", "5 people", '"numberOfEmployees": "77"', "Founded in 1999", "since 3000 from 1850", "We're hiring: CTO",
             "Vice President of Sales", "Senior IT manager", "junior accountant", "12 Marina, Lagos, Nigeria", "Milwaukee, WI, USA", "people and talent"],
    "size": [None, "micro", "Small", "MEDIUM", "large", "x"],
    "tel": [None, "", "+234 803 123 4567", "(212) 555-0101", "12125550101", "0803 123 4567", "0000000000", "44 20 7946 0958", "+1"],
    "country": [None, "ng", "US", "ca", "GB", "zz"],
    "mail": [None, "", "jane.smith@c1.com", "j.smith@c.co", "info@x.com", "a@mailinator.com", "99@x.com", "jane99@c.com", "no-at", "noreply@x.org", "x" * 50 + "@long.org"],
}


def test_sql_functions_equal_column_functions(spark):
    sqlapi.register(spark)
    columns = rules()
    n = max(map(len, VALUES.values()))
    rng = random.Random(1)
    rows = [tuple(rng.choice(v) for v in VALUES.values()) for _ in range(40)] + [tuple(v[i % len(v)] for v in VALUES.values()) for i in range(n)]
    d = spark.createDataFrame(rows, ", ".join(f"{k} string" for k in VALUES))
    both = d.select(*[F.expr(sql).alias(f"s{i}") for i, sql in enumerate(columns)], *[r.alias(f"c{i}") for i, r in enumerate(columns.values())]).collect()
    for i, sql in enumerate(columns):
        assert [r[f"s{i}"] for r in both] == [r[f"c{i}"] for r in both], sql
    called = " ".join(columns) + " ".join(f.body for f in sqlapi.FUNCTIONS)
    assert all(f.name + "(" in called for f in sqlapi.FUNCTIONS)


def test_scalar_rules_run_without_python(spark, sf):
    from leadloom import plans

    plans.load()
    text = lambda name: plans.QUERIES[name](spark, sf)._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in text("sql_lead_rules") and "ArrowEval" not in text("sql_lead_rules")
    assert "PythonUDTF" in text("sql_site_mentions")


def test_page_links_of_odd_pages(spark):
    sqlapi.register(spark)
    d = spark.createDataFrame([(1, None), (2, ""), (3, "<a href='x'>A <b> b</b></a><A HREF=\"y\">\n</A><a>no</a>")], "id int, html string")
    got = spark.sql("SELECT id, l.* FROM {d}, LATERAL page_links(html) l", d=d).collect()
    assert [tuple(r) for r in got] == [(3, 0, "x", "A b"), (3, 1, "y", "")]


def fold(times, gap):
    out, last = [], None
    for t in times:
        out.append(last is None or t - last >= gap)
        last = t if out[-1] else last
    return out


def test_buckets_compose_to_the_fold(spark):
    """One key has a third of all submissions; its buckets are tasks of their own."""
    rng = random.Random(2)
    rows = [(i, 0 if i % 3 == 0 else rng.randrange(9), rng.randrange(60_000)) for i in range(3000)] + [(3000, None, 5), (3001, None, 6), (3002, 1, None)]
    d = spark.createDataFrame(rows, "event_id long, k int, ms long").withColumn("ts", F.timestamp_millis("ms"))
    out = queue.accepted_submissions(d, ["k"], seconds=0.25, bucket_seconds=1.5)
    got = {r["event_id"]: r["accepted"] for r in out.collect()}
    want = {}
    for k in {r[1] for r in rows}:
        own = sorted((r[2], r[0]) for r in rows if r[1] == k and r[2] is not None)
        want |= dict(zip([i for _, i in own], fold([t for t, _ in own], 250)))
    assert got == want and 0 < sum(want.values()) < len(want)
    assert queue.accepted_submissions(d.limit(0), ["k"]).collect() == []
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert plan.count("bucket") > 3


def test_bucket_steps():
    rng = np.random.RandomState(0)
    for _ in range(300):
        times, gap = np.sort(rng.randint(100, 200, rng.randint(1, 40))), int(rng.randint(1, 60))
        leave, step = queue.bucket_steps(times, gap, 100)
        for carry in range(60, 100):
            at = int(np.searchsorted(times, carry + gap))
            entries = times[step]
            k = int(np.searchsorted(entries, carry + gap))
            assert (k == len(entries)) == (at == len(times)) and (k == len(entries) or leave[step][k] == leave[at])


def write(spark, rows, schema, path):
    spark.createDataFrame(rows, schema).withColumn("ts", F.timestamp_seconds(F.col("s") + 1000)).coalesce(1).write.mode("append").parquet(path)


def test_stalls_over_restarts(spark, tmp_path):
    """Reports that come out of order, in two runs of one stream, give the spans of one sorted pass."""
    src, keep = str(tmp_path / "in"), str(tmp_path / "kept")
    schema = "search_id long, s double, status string, extracted_count long, enriched_count long"
    first = [(1, 20.0, "extracting", 2, 0), (1, 0.0, "extracting", 1, 0), (1, 15.0, "extracting", 1, 0), (2, 0.0, "enriching", None, None), (3, 0.0, "completed", 1, 1), (4, 3.0, "processing", 0, 0)]
    second = [(1, 40.0, "extracting", 3, 0), (2, 60.0, "completed", 0, 0), (4, 5.0, "extracting", 0, 1), (4, 14.0, "extracting", 0, 2), (9, 200.0, "completed", 0, 0), (3, 190.0, "extracting", 1, 1)]
    run = lambda: live.drain(live.stalled_spans(
        live.file_stream(spark, src, "*.parquet").drop("s"), 10.0, "20 seconds"), "stalls", folder=keep)
    write(spark, first, schema, src)
    early = {tuple(r)[:4] for r in run().select("search_id", "extracted_count", "enriched_count", F.unix_millis("since")).collect()}
    assert early == set()
    write(spark, second, schema, src)
    got = [tuple(r) for r in run().select("search_id", "extracted_count", "enriched_count", F.unix_millis("since")).collect()]
    assert len(got) == len(set(got))
    assert set(got) == {(1, 1, 0, 1_000_000), (1, 2, 0, 1_020_000), (1, 3, 0, 1_040_000), (2, 0, 0, 1_000_000), (4, 0, 2, 1_014_000)}


@pytest.mark.parametrize("width", [3, 1000])
def test_balances_of_a_hot_company_over_restarts(spark, tmp_path, width):
    rng = random.Random(7)
    rows = [(0 if i % 3 else rng.randrange(1, 6), i, rng.choice([-2, -1, 1, 2])) for i in range(90)]
    src, keep = str(tmp_path / "in"), str(tmp_path / "kept")
    for a, b in ((0, 40), (40, 41), (41, 90)):
        spark.createDataFrame(rows[a:b], "company_id long, seq long, delta int").coalesce(1).write.mode("append").parquet(src)
        out = live.running_balances(live.file_stream(spark, src, "*.parquet"), width, keep)
        got = {r["seq"]: (r["balance"], r["refused"]) for r in out.collect()}
    want, held = {}, {}
    for k, seq, delta in rows:
        before = held.get(k, 0)
        refused = delta < 0 and before + delta < 0
        held[k] = max(0, before + delta)
        want[seq] = held[k], refused
    assert got == want
    assert {r["n"] for r in spark.read.parquet(f"{keep}/out").groupBy("batch").agg(F.count("*").alias("n")).collect()} == {40, 1, 49}  # a batch writes its own entries only
