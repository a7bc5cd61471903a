"""Streams run over everything available, against what a batch gives."""

from __future__ import annotations

from pyspark.sql import functions as F

from leadloom.functions.url import bare_domain
from leadloom.plans import query
from leadloom.plans.sql import domain, with_views
from leadloom.streaming import live

_SITES = "'https://www.c' || CAST(o_custkey % 50 AS STRING) || '.com/' || CAST(o_orderkey AS STRING)"


def _lead_stream(spark, sf):
    """Orders as a stream of leads."""
    o = live.file_stream(spark, sf, "orders.parquet")
    c = F.col
    return o.select(
        c("o_orderkey").alias("lead_id"), (c("o_custkey") % 200).alias("search_id"), c("o_orderdate").cast("timestamp").alias("ts"),
        F.concat(F.lit("https://www.c"), (c("o_custkey") % 50).cast("string"), F.lit(".com/"), c("o_orderkey").cast("string")).alias("website"),
        F.when(c("o_orderkey") % 5 == 0, "failed").otherwise("extracted").alias("extraction_status"),
        F.when(c("o_orderstatus") == "F", "enriched").otherwise("skipped").alias("enrichment_status"))


@query("""
SELECT o_custkey % 200 AS search_id, count(*) AS total, count(*) FILTER (o_orderkey % 5 <> 0) AS extracted, count(*) FILTER (o_orderstatus = 'F') AS enriched FROM orders GROUP BY 1""")
def stream_progress(spark, sf):
    return live.latest(live.drain(live.live_counters(_lead_stream(spark, sf)), "progress", "update"), ["search_id"])


@query(f"""
SELECT search_id, domain FROM (SELECT o_custkey % 200 AS search_id, {domain(_SITES)} AS domain FROM orders) a GROUP BY ALL""")
def stream_dedup(spark, sf):
    """One first arrival per search and site (a watermark longer than the data keeps all keys)."""
    first = live.first_arrivals(_lead_stream(spark, sf), "20000 days")
    return live.drain(first, "dedup").select("search_id", bare_domain("website").alias("domain"))


@query("""
SELECT CAST(date_trunc('day', ts) AS DATE) AS day, event_type, count(*) AS n, round(sum(value), 2) AS value FROM events
WHERE date_trunc('day', ts) + INTERVAL 1 DAY <= (SELECT max(ts) - INTERVAL 1 DAY FROM events) GROUP BY ALL""")
def stream_daily(spark, sf):
    """Days closed by the watermark; the last day and a bit stay open."""
    e = live.file_stream(spark, sf, "events.parquet").withColumn("ts", F.col("ts").cast("timestamp"))
    return live.drain(live.daily_activity(e), "daily").select("day", "event_type", "n", "value")


@query(with_views(("v_ledger",), """
SELECT company_id, seq, CAST(s - least(0, m) AS BIGINT) AS balance, delta < 0 AND s < least(0, before) AS refused FROM (
  SELECT *, min(s) OVER (PARTITION BY company_id ORDER BY seq) AS m, coalesce(min(s) OVER (PARTITION BY company_id ORDER BY seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM (
    SELECT *, sum(delta) OVER (PARTITION BY company_id ORDER BY seq) AS s FROM v_ledger) a) b"""))
def stream_balance(spark, sf):
    e = live.file_stream(spark, sf, "events.parquet")
    c = F.col
    entries = e.select(
        (c("user_id") % 8).alias("company_id"), c("event_id").alias("seq"),
        F.when(c("event_type") == "purchase", (c("event_id") % 2).cast("int") + 1).when(c("event_type") == "error", 1).otherwise(-1).alias("delta"))
    return live.running_balances(entries, width=500).select("company_id", "seq", "balance", "refused")


@query("""
WITH RECURSIVE e AS (SELECT event_id, event_type, epoch_us(ts) AS t, row_number() OVER (PARTITION BY event_type ORDER BY ts, event_id) AS i FROM events),
step AS (SELECT event_type, i, event_id, t AS last, true AS accepted FROM e WHERE i = 1
  UNION ALL SELECT e.event_type, e.i, e.event_id, CASE WHEN e.t - s.last >= 300000000 THEN e.t ELSE s.last END, e.t - s.last >= 300000000 FROM step s JOIN e ON e.event_type = s.event_type AND e.i = s.i + 1)
SELECT event_id, accepted FROM step""")
def stream_repeats(spark, sf):
    """Submissions within five minutes of the last accepted one of their kind."""
    e = live.file_stream(spark, sf, "events.parquet").select("event_id", "event_type", F.col("ts").cast("timestamp").alias("ts"))
    return live.drain(live.suppress_repeats(e, ["event_type"], 300.0), "repeats").select("event_id", "accepted")




_STALL, _DELAY = 14_400, 3_600


@query(f"""
WITH w AS (SELECT (epoch_us(max(ts)) // 1000 - {_DELAY * 1000}) * 1000 AS w FROM events),
p AS (SELECT user_id AS search_id, epoch_us(ts) AS t, event_type IN ('click', 'view') AS busy, epoch_us(ts) // 86400000000 AS extracted_count FROM events, w WHERE epoch_us(ts) <= w),
c AS (SELECT *, coalesce(busy AND lag(busy) OVER o AND lag(extracted_count) OVER o = extracted_count, FALSE) AS same FROM p WINDOW o AS (PARTITION BY search_id ORDER BY t)),
i AS (SELECT *, count(*) FILTER (NOT same) OVER (PARTITION BY search_id ORDER BY t) AS island FROM c),
s AS (SELECT search_id, island, bool_and(busy) AS busy, extracted_count, min(t) AS since FROM i GROUP BY search_id, island, extracted_count),
n AS (SELECT *, lead(since) OVER (PARTITION BY search_id ORDER BY island) AS until FROM s)
SELECT search_id, CAST(extracted_count AS BIGINT) AS extracted_count, since AS since_us FROM n, w WHERE busy AND coalesce(until, w) - since > {_STALL * 1000000}""")
def stream_stalls(spark, sf):
    """Spans of more than four hours without a change, told up to the watermark, an hour behind the newest event."""
    e = live.file_stream(spark, sf, "events.parquet").withColumn("ts", F.col("ts").cast("timestamp"))
    progress = e.select(F.col("user_id").alias("search_id"), "ts", F.when(F.col("event_type").isin("click", "view"), "extracting").otherwise("completed").alias("status"),
                        F.floor(F.unix_micros("ts") / 86_400_000_000).alias("extracted_count"), F.lit(0).cast("long").alias("enriched_count"))
    told = live.drain(live.stalled_spans(progress, _STALL, f"{_DELAY} seconds"), "stalls")
    return told.select("search_id", "extracted_count", F.unix_micros("since").alias("since_us"))


#: Events of a month squeezed into minutes, a third of them by one user.
_SUBMITTED = "SELECT event_id, CASE WHEN event_id % 3 = 0 THEN 0 ELSE user_id END AS user_id, event_type, {micros} AS t FROM {events}"
_WIDTH, _LATE = 10, 20


@query(f"""
WITH RECURSIVE e AS (SELECT event_id, user_id, event_type, t, row_number() OVER (PARTITION BY user_id, event_type ORDER BY t, event_id) AS i FROM ({_SUBMITTED.format(micros='1704067200000000 + (epoch_us(ts) - 1704067200000000) // 5000', events='events')}) x),
step AS (SELECT user_id, event_type, i, event_id, t, t AS last, true AS accepted FROM e WHERE i = 1
  UNION ALL SELECT e.user_id, e.event_type, e.i, e.event_id, e.t, CASE WHEN e.t - s.last >= 2000000 THEN e.t ELSE s.last END, e.t - s.last >= 2000000 FROM step s JOIN e ON e.user_id = s.user_id AND e.event_type = s.event_type AND e.i = s.i + 1),
w AS (SELECT max(t) // 1000 - {_LATE * 1000} AS w FROM e)
SELECT event_id, accepted FROM step, w WHERE (t // {_WIDTH * 1000000} + 1) * {_WIDTH * 1000} <= w""")
def stream_submissions(spark, sf):
    """Submissions within two seconds of the last accepted one of their user and kind, in buckets that are over."""
    e = live.file_stream(spark, sf, "events.parquet")
    t = F.floor((F.unix_micros(F.col("ts").cast("timestamp")) - 1704067200000000) / 5000) + 1704067200000000
    s = e.select("event_id", F.when(F.col("event_id") % 3 == 0, 0).otherwise(F.col("user_id")).cast("long").alias("user_id"), "event_type", F.timestamp_micros(t).alias("ts"))
    out = live.accepted_submissions(s, ["user_id", "event_type"], 2.0, delay=f"{_LATE} seconds", bucket_seconds=_WIDTH)
    return out.select("event_id", "accepted")
