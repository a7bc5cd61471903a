"""Dashboards, ledger and queue."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import functions as F

from leadloom import refdata as R
from leadloom.operators import ledger as LG, metrics as M, queue as Q
from leadloom.plans import ORACLES, query
from leadloom.plans.sql import with_views
from leadloom.schemas import ENRICHMENT_STATUSES
from leadloom.sources import lead_fixture as L

_FROM = dt.datetime(2024, 1, 15)
_PERIOD = "created_date >= DATE '2024-01-15'"


def _in_period():
    return F.col("created_at") >= F.lit(_FROM)


@query(with_views(("v_users", "v_companies", "v_searches"), f"""
SELECT * FROM (SELECT count(*) AS total_users, count(*) FILTER ({_PERIOD}) AS new_users, count(*) FILTER (role = 'admin') AS admin_users, count(*) FILTER (role = 'member') AS member_users FROM v_users) u,
 (SELECT count(*) AS total_companies FROM v_companies) c,
 (SELECT *, CASE WHEN searches_in_period > 0 THEN round(completed_searches * 100.0 / searches_in_period, 2) ELSE 0 END AS success_rate FROM (
   SELECT count(*) AS total_searches, count(*) FILTER ({_PERIOD}) AS searches_in_period, count(*) FILTER ({_PERIOD} AND status = 'completed') AS completed_searches, count(*) FILTER ({_PERIOD} AND status = 'failed') AS failed_searches,
     count(*) FILTER ({_PERIOD} AND status IN ('pending', 'processing_backfill')) AS pending_searches, CAST(round(avg(total_results) FILTER ({_PERIOD} AND status = 'completed')) AS BIGINT) AS avg_results,
     CAST(round(avg(search_id % 50) FILTER ({_PERIOD} AND status = 'completed')) AS BIGINT) AS avg_minutes FROM v_searches) z) s"""))
def admin_counts(spark, sf):
    one = F.lit(1).alias("k")
    u = M.user_counts(L.users(spark, sf), _in_period()).select("*", one)
    c = M.company_counts(L.companies(spark, sf)).select("total_companies", one)
    s = M.search_counts(L.searches(spark, sf), _in_period()).select("*", one)
    return u.join(c, "k").join(s, "k").drop("k")


_LEADS = "kept AS (SELECT l.*, lead_id % 17 = 0 AS dup, industry, company_size FROM v_leads l JOIN v_enrichment USING (lead_id))"


@query(with_views(("v_leads", "v_enrichment"), """
SELECT *, 100.0 AS extraction_rate, round(enriched * 100.0 / extracted, 2) AS enrichment_rate, round(duplicates * 100.0 / leads_in_period, 2) AS duplicate_rate, round(with_contact * 100.0 / leads_in_period, 2) AS contact_quality_rate FROM (
  SELECT count(*) FILTER (NOT dup) AS total_leads, count(*) FILTER (NOT dup) AS leads_in_period, count(*) FILTER (NOT dup) AS extracted, count(*) FILTER (NOT dup AND enrichment_status = 'enriched') AS enriched, count(*) FILTER (dup) AS duplicates,
    count(*) FILTER (NOT dup AND email IS NOT NULL) AS with_email, count(*) FILTER (NOT dup AND phone IS NOT NULL) AS with_phone, count(*) FILTER (NOT dup AND (email IS NOT NULL OR phone IS NOT NULL)) AS with_contact FROM kept) a""", _LEADS))
def lead_funnel(spark, sf):
    return M.lead_funnel(L.leads(spark, sf))


@query(with_views(("v_leads", "v_searches", "v_users"), """
SELECT day, coalesce(users, 0) AS users, coalesce(searches, 0) AS searches, coalesce(leads, 0) AS leads, CASE WHEN day = DATE '2024-01-10' THEN (SELECT count(DISTINCT c_custkey % 8) FROM customer) ELSE 0 END AS companies
FROM (SELECT CAST(unnest(range(DATE '2024-01-01', DATE '2024-01-31', INTERVAL 1 DAY)) AS DATE) AS day) d
LEFT JOIN (SELECT created_date AS day, count(*) AS users FROM v_users GROUP BY 1) u USING (day) LEFT JOIN (SELECT created_date AS day, count(*) AS searches FROM v_searches GROUP BY 1) s USING (day)
LEFT JOIN (SELECT created_date AS day, count(*) AS leads FROM v_leads WHERE lead_id % 17 <> 0 GROUP BY 1) l USING (day)"""))
def daily_trend(spark, sf):
    return M.daily_trend(dt.date(2024, 1, 30), L.users(spark, sf), L.searches(spark, sf), L.leads(spark, sf), L.companies(spark, sf))


@query(with_views(("v_searches",), "SELECT status, count(*) AS n FROM v_searches GROUP BY status"))
def status_breakdown(spark, sf):
    return M.by_status(L.searches(spark, sf))


@query(with_views(("v_leads", "v_enrichment"), "SELECT industry, count(*) AS n FROM kept WHERE NOT dup AND industry IS NOT NULL GROUP BY industry ORDER BY n DESC, industry LIMIT 10", _LEADS))
def top_industries(spark, sf):
    return M.top_industries(L.leads(spark, sf))


@query(with_views(("v_leads", "v_enrichment"), "SELECT company_size, count(*) AS n FROM kept WHERE NOT dup AND company_size IS NOT NULL GROUP BY company_size", _LEADS))
def company_sizes(spark, sf):
    return M.company_sizes(L.leads(spark, sf))


_ACTIVITY = """activity AS (SELECT u.user_id, u.company_id, u.role, count(DISTINCT s.search_id) AS total_searches, count(l.lead_id) AS total_leads FROM v_users u
  LEFT JOIN v_searches s ON s.user_id = u.user_id LEFT JOIN v_leads l ON l.search_id = s.search_id GROUP BY ALL)"""


@query(with_views(("v_leads", "v_searches", "v_users"), "SELECT user_id, total_searches, total_leads FROM activity ORDER BY total_searches DESC, user_id LIMIT 10", _ACTIVITY))
def top_users(spark, sf):
    return M.top_users(L.users(spark, sf), L.searches(spark, sf), L.leads(spark, sf)).select("user_id", "total_searches", "total_leads")


@query(with_views(("v_leads", "v_searches", "v_users"), "SELECT company_id, count(*) AS members, sum(total_searches) AS searches, sum(total_leads) AS leads FROM activity GROUP BY company_id", _ACTIVITY))
def per_company_counts(spark, sf):
    return M.company_activity(L.companies(spark, sf), L.users(spark, sf), L.searches(spark, sf), L.leads(spark, sf)).select("company_id", "members", "searches", "leads")


@query(with_views(("v_leads", "v_searches", "v_users", "v_companies"), """
SELECT v.user_id, v.company_id, count(DISTINCT s.search_id) AS searches, count(DISTINCT s.search_id) FILTER (status = 'completed') AS completed, count(l.lead_id) AS leads, count(l.lead_id) FILTER (enrichment_status = 'enriched') AS enriched,
  count(l.lead_id) FILTER (signal_strength >= 70) AS high_signal, count(DISTINCT s.search_id) FILTER (s.search_id % 6 = 0) AS templates
FROM v_users v JOIN v_companies c ON c.company_id = v.company_id JOIN v_users u ON u.company_id = v.company_id AND (c.share_searches OR u.user_id = v.user_id)
LEFT JOIN v_searches s ON s.user_id = u.user_id LEFT JOIN (SELECT * FROM v_leads WHERE lead_id % 17 <> 0) l ON l.search_id = s.search_id GROUP BY v.user_id, v.company_id"""))
def company_dashboard(spark, sf):
    return M.viewer_dashboard(L.users(spark, sf), L.companies(spark, sf), L.searches(spark, sf), L.leads(spark, sf))


@query(with_views(("v_leads",), "SELECT search_id, " + ", ".join(f"count(*) FILTER (enrichment_status = '{s}') AS {s}" for s in ENRICHMENT_STATUSES) + " FROM v_leads WHERE lead_id % 17 <> 0 GROUP BY search_id"))
def enrichment_breakdown(spark, sf):
    return M.enrichment_breakdown(L.leads(spark, sf))


_COUNTERS = "SELECT search_id, count(*) AS total, count(*) AS extracted, count(*) FILTER (enrichment_status = 'enriched') AS enriched FROM v_leads WHERE lead_id % 17 <> 0 GROUP BY search_id"


@query(with_views(("v_leads",), _COUNTERS))
def search_counters(spark, sf):
    return M.search_counters(L.leads(spark, sf))


# --- ledger --------------------------------------------------------------------------------------

# the counterpart folds the entries of each company one after the other
_FOLD = """entries AS (SELECT company_id, seq, delta, row_number() OVER (PARTITION BY company_id ORDER BY seq) AS i FROM v_ledger),
fold AS (SELECT * FROM (WITH RECURSIVE step AS (
  SELECT company_id, i, seq, CASE WHEN delta < 0 THEN 0 ELSE delta END AS balance, delta < 0 AS refused FROM entries WHERE i = 1
  UNION ALL SELECT e.company_id, e.i, e.seq, CASE WHEN e.delta < 0 AND s.balance <= 0 THEN s.balance ELSE s.balance + e.delta END, e.delta < 0 AND s.balance <= 0
  FROM step s JOIN entries e ON e.company_id = s.company_id AND e.i = s.i + 1) SELECT * FROM step) z)"""


@query(with_views(("v_ledger",), "SELECT company_id, seq, balance, refused FROM fold", _FOLD))
def running_balance(spark, sf):
    return LG.running_balance(L.ledger(spark, sf), width=500).select("company_id", "seq", "balance", "refused")


@query(with_views(("v_ledger",), "SELECT company_id, CAST(arg_max(balance, i) AS BIGINT) AS balance FROM fold GROUP BY company_id", _FOLD))
def company_balances(spark, sf):
    return LG.balances(L.ledger(spark, sf))


@query(with_views(("v_ledger", "v_companies"), """
SELECT CAST(sum(l.delta) FILTER (reason = 'purchase') AS BIGINT) AS purchased, CAST(sum(abs(l.delta)) FILTER (reason IN ('reserve', 'consume') AND NOT refused) AS BIGINT) AS consumed, CAST(sum(l.delta) FILTER (starts_with(reason, 'refund')) AS BIGINT) AS refunded,
  CAST(sum(CASE pack_id WHEN 'pack_100' THEN 29 WHEN 'pack_500' THEN 129 WHEN 'pack_2000' THEN 399 END) FILTER (currency = 'usd') AS BIGINT) AS revenue_usd,
  CAST(sum(CASE pack_id WHEN 'pack_100' THEN 46400 WHEN 'pack_500' THEN 206400 WHEN 'pack_2000' THEN 638400 END) FILTER (currency = 'ngn') AS BIGINT) AS revenue_ngn,
  (SELECT CAST(sum(b) AS BIGINT) FROM (SELECT arg_max(balance, i) AS b FROM fold GROUP BY company_id) z) AS active_credits
FROM v_ledger l JOIN v_companies c ON c.company_id = l.company_id JOIN fold f ON f.company_id = l.company_id AND f.seq = l.seq""", _FOLD))
def ledger_totals(spark, sf):
    return LG.ledger_totals(L.ledger(spark, sf), L.companies(spark, sf))


@query(with_views(("v_ledger",), "SELECT company_id, seq, position FROM (SELECT *, row_number() OVER (PARTITION BY company_id ORDER BY seq DESC) AS position FROM v_ledger) a WHERE position <= 100"))
def ledger_tail(spark, sf):
    return LG.statement(L.ledger(spark, sf)).select("company_id", "seq", "position")


@query(with_views(("v_ledger", "v_searches", "v_users"), """
SELECT s.search_id, CASE WHEN p.paid THEN 10 ELSE 0 END AS queue_priority FROM v_searches s LEFT JOIN v_users u ON u.user_id = s.user_id
LEFT JOIN (SELECT company_id, bool_or(reason = 'purchase' AND delta > 0) AS paid FROM v_ledger GROUP BY company_id) p ON p.company_id = u.company_id"""))
def search_priority(spark, sf):
    return LG.search_priority(L.searches(spark, sf), L.users(spark, sf), L.ledger(spark, sf)).select("search_id", "queue_priority")


@query(with_views(("v_ledger", "v_companies"), """
SELECT l.company_id, l.seq, CASE pack_id WHEN 'pack_100' THEN 100 WHEN 'pack_500' THEN 500 ELSE 2000 END AS delta, CASE WHEN currency = 'usd' THEN CASE pack_id WHEN 'pack_100' THEN 29 WHEN 'pack_500' THEN 129 ELSE 399 END
  ELSE CASE pack_id WHEN 'pack_100' THEN 46400 WHEN 'pack_500' THEN 206400 ELSE 638400 END END AS price FROM v_ledger l JOIN v_companies c ON c.company_id = l.company_id WHERE pack_id IS NOT NULL"""))
def purchase_entries(spark, sf):
    led = L.ledger(spark, sf).join(L.companies(spark, sf).select("company_id", "currency"), "company_id")
    bought = LG.purchase_entries(led)
    packs = F.broadcast(R.ref_credit_pack(spark))  # three fixed rows
    return bought.join(packs, "pack_id").select("company_id", "seq", "delta", F.when(F.col("currency") == "usd", F.col("usd").cast("long")).otherwise(F.col("ngn")).alias("price"))


# --- queue ---------------------------------------------------------------------------------------

@query(with_views(("v_searches",), """
SELECT search_id, user_id, turn, first_value(search_id) OVER (PARTITION BY user_id ORDER BY created_date, search_id) AS user_arrival FROM (
  SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY priority DESC, created_date, search_id) AS turn FROM v_searches WHERE status IN ('pending', 'queued')) a"""))
def fair_queue(spark, sf):
    return Q.fair_order(L.searches(spark, sf)).select("search_id", "user_id", "turn", "user_arrival")


@query(with_views(("v_searches",), "SELECT user_id, count(*) AS queued FROM v_searches WHERE status IN ('pending', 'queued') GROUP BY user_id"))
def queue_status(spark, sf):
    return Q.queue_status(L.searches(spark, sf))


@query(with_views(("v_searches",), "SELECT count(*) AS queue_length, count(DISTINCT user_id) AS active_users FROM v_searches WHERE status IN ('pending', 'queued')"))
def queue_summary(spark, sf):
    return Q.queue_summary(L.searches(spark, sf))


@query("""
SELECT event_id, gap_seconds FROM (SELECT event_id, round((epoch_us(ts) - lag(epoch_us(ts)) OVER (PARTITION BY event_type ORDER BY ts, event_id)) / 1000000, 6) AS gap_seconds FROM events) a WHERE gap_seconds < 120""")
def repeat_submissions(spark, sf):
    return Q.repeat_submissions(L.events(spark, sf), ["event_type"], seconds=120.0).select("event_id", "gap_seconds")


@query("""
SELECT event_id, round((epoch_us(ts) - lag(epoch_us(ts)) OVER (PARTITION BY user_id ORDER BY ts, event_id)) / 1000000, 6) AS gap_seconds FROM events""")
def stall_gaps(spark, sf):
    return Q.gaps(L.events(spark, sf), ["user_id"], "ts", "event_id").select("event_id", "gap_seconds")


@query("""
SELECT user_id AS search_id, extracted_count, (epoch_us(max(ts)) - epoch_us(min(ts))) / 1000000 AS stalled_seconds FROM (
  SELECT user_id, ts, CAST(epoch_us(ts) // 86400000000 AS BIGINT) AS extracted_count FROM events WHERE event_type IN ('click', 'view')) a GROUP BY ALL HAVING (epoch_us(max(ts)) - epoch_us(min(ts))) / 1000000 > 30""")
def stalled_searches(spark, sf):
    return Q.stalled(_progress(L.events(spark, sf))).select("search_id", "extracted_count", "stalled_seconds")


def _progress(e):
    return e.select(F.col("user_id").alias("search_id"), "ts", F.when(F.col("event_type").isin("click", "view"), "extracting").otherwise("completed").alias("status"),
                    F.floor(F.unix_micros("ts") / 86_400_000_000).alias("extracted_count"), F.lit(0).alias("enriched_count"))


@query("""
WITH p AS (SELECT user_id AS search_id, ts, event_type IN ('click', 'view') AS busy, CAST(epoch_us(ts) // 86400000000 AS BIGINT) AS extracted_count FROM events),
l AS (SELECT p.search_id, last_ts, bool_or(busy) AS busy FROM p JOIN (SELECT search_id, max(ts) AS last_ts FROM p GROUP BY 1) m ON m.search_id = p.search_id AND ts = last_ts GROUP BY ALL),
s AS (SELECT search_id, extracted_count, epoch_us(min(ts)) AS since, max(ts) AS until FROM p WHERE busy GROUP BY ALL),
h AS (SELECT s.search_id, extracted_count, (CASE WHEN l.busy AND until = last_ts THEN (SELECT epoch_us(max(ts)) + 40000000 FROM events) ELSE epoch_us(until) END - since) / 1000000 AS stalled_seconds FROM s JOIN l USING (search_id))
SELECT * FROM h WHERE stalled_seconds > 30""")
def stalled_now(spark, sf):
    """Also searches that were busy when last heard of, 40 seconds after the newest event."""
    e = L.events(spark, sf)
    now = e.agg((F.max(F.col("ts").cast("timestamp")) + F.expr("INTERVAL 40 SECONDS")).alias("now")).scalar()
    return Q.stalled(_progress(e), now=now).select("search_id", "extracted_count", "stalled_seconds")


def _health(rate: str, good: int, fair: int) -> str:
    return f"CASE WHEN {rate} >= {good} THEN 'healthy' WHEN {rate} >= {fair} THEN 'warning' ELSE 'critical' END"


@query(with_views(("v_users", "v_companies", "v_searches", "v_leads", "v_enrichment", "v_ledger"), f"""
SELECT *, CASE WHEN searches_in_period > 0 AND leads_in_period > 0 THEN round(leads_in_period / searches_in_period, 1) ELSE 0 END AS leads_per_search, CASE WHEN searches_in_period > 0 AND enriched > 0 THEN round(enriched / searches_in_period, 1) ELSE 0 END AS enriched_per_search,
  round(searches_in_period * 100.0 / total_users, 2) AS user_engagement_rate, round(total_searches / total_users, 1) AS searches_per_user, round(total_leads / total_users, 1) AS leads_per_user,
  round(revenue_usd / total_users, 2) AS revenue_per_user, CASE WHEN consumed > 0 THEN round(leads_in_period / consumed, 2) ELSE 0 END AS leads_per_credit,
  {_health('success_rate', 80, 60)} AS search_health, {_health('extraction_rate', 70, 50)} AS extraction_health, {_health('enrichment_rate', 60, 40)} AS enrichment_health FROM
(SELECT count(*) AS total_users, count(*) AS new_users, count(*) FILTER (role = 'admin') AS admin_users, count(*) FILTER (role = 'member') AS member_users FROM v_users) u,
(SELECT count(*) AS total_companies, count(*) AS new_companies FROM v_companies) c,
(SELECT *, round(completed_searches * 100.0 / searches_in_period, 2) AS success_rate FROM (
   SELECT count(*) AS total_searches, count(*) AS searches_in_period, count(*) FILTER (status = 'completed') AS completed_searches, count(*) FILTER (status = 'failed') AS failed_searches, count(*) FILTER (status IN ('pending', 'processing_backfill')) AS pending_searches,
     CAST(round(avg(total_results) FILTER (status = 'completed')) AS BIGINT) AS avg_results, CAST(round(avg(search_id % 50) FILTER (status = 'completed')) AS BIGINT) AS avg_minutes FROM v_searches) z) s,
({{funnel}}) f, ({{ledger}}) l""".replace("{funnel}", "SELECT *, 100.0 AS extraction_rate, round(enriched * 100.0 / extracted, 2) AS enrichment_rate, round(duplicates * 100.0 / leads_in_period, 2) AS duplicate_rate, round(with_contact * 100.0 / leads_in_period, 2) AS contact_quality_rate FROM ("
    "SELECT count(*) FILTER (NOT dup) AS total_leads, count(*) FILTER (NOT dup) AS leads_in_period, count(*) FILTER (NOT dup) AS extracted, count(*) FILTER (NOT dup AND enrichment_status = 'enriched') AS enriched, count(*) FILTER (dup) AS duplicates, "
    "count(*) FILTER (NOT dup AND email IS NOT NULL) AS with_email, count(*) FILTER (NOT dup AND phone IS NOT NULL) AS with_phone, count(*) FILTER (NOT dup AND (email IS NOT NULL OR phone IS NOT NULL)) AS with_contact FROM kept) k").replace(
    "{ledger}", ORACLES["ledger_totals"][ORACLES["ledger_totals"].index("SELECT CAST(sum(l.delta)"):]), _LEADS + ",\n" + _FOLD))
def admin_overview(spark, sf):
    """Every single-row metric side by side."""
    return M.overview(L.users(spark, sf), L.companies(spark, sf), L.searches(spark, sf), L.leads(spark, sf),
                      LG.ledger_totals(L.ledger(spark, sf), L.companies(spark, sf)))
