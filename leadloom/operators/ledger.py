"""Credit ledger: packs, running balances with refusal at zero, totals, statements, refunds."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from leadloom import refdata as R
from leadloom.operators.skew import bucketed_running, top_per_key

SEQ_WIDTH = 1_000_000  # ledger numbers per bucket of the running sums


def _checked(ledger: DataFrame) -> DataFrame:
    """The ledger; an entry that takes more than one credit fails the job, as the closed form of balances has no place for it."""
    wrong = F.raise_error(F.concat(F.lit("reservation of more than one credit: "), F.col("delta").cast("string")))
    return ledger.withColumn("delta", F.when(F.col("delta") < -1, wrong.cast(ledger.schema["delta"].dataType)).otherwise(F.col("delta")))


def running_balance(ledger: DataFrame, width: int = SEQ_WIDTH) -> DataFrame:
    """Balance after each entry and whether a reservation was refused at zero.

    With S the running sum of all deltas, the balance is S - min(0, lowest S so far), and an entry is refused exactly
    when it makes that minimum fall. Reservations must be -1. Sums are composed over ranges of ``seq``, so a company
    with most of the entries is spread over many tasks.
    """
    run = bucketed_running(_checked(ledger), ["company_id"], "seq", "delta", width)
    refused = (F.col("delta") < 0) & (F.col("run_sum") < F.least(F.lit(0), F.coalesce("run_min_before", F.lit(0))))
    return run.select(
        *ledger.columns, (F.col("run_sum") - F.least(F.lit(0), F.col("run_min"))).cast("long").alias("balance"),
        refused.alias("refused"))


def balances(ledger: DataFrame, width: int = SEQ_WIDTH) -> DataFrame:
    """Balance per company: total minus the lowest running sum below zero; refused reservations cost nothing."""
    run = bucketed_running(_checked(ledger), ["company_id"], "seq", "delta", width)
    last = run.groupBy("company_id").agg(F.sum("delta").alias("total"), F.min("run_min").alias("low"))
    return last.select("company_id", (F.col("total") - F.least(F.lit(0), F.col("low"))).cast("long").alias("balance"))


def credit_packs(spark, ngn_per_usd: float = R.NGN_PER_USD) -> DataFrame:
    return R.ref_credit_pack(spark, ngn_per_usd)


def _price(ngn_per_usd: float) -> Column:
    """Price of the pack in the company's currency; three packs, so a map instead of a join."""
    usd = R.literal_map({p: str(u) for p, _, u in R.CREDIT_PACKS})
    ngn = R.literal_map({p: str(round(u * ngn_per_usd)) for p, _, u in R.CREDIT_PACKS})
    pack = F.coalesce("pack_id", F.lit(""))
    return F.when(F.col("currency") == "usd", F.try_element_at(usd, pack)).otherwise(F.try_element_at(ngn, pack)).cast("long")


def ledger_totals(ledger: DataFrame, companies: DataFrame, ngn_per_usd: float = R.NGN_PER_USD) -> DataFrame:
    """Credits bought, used and refunded, revenue per currency, and the credit balance of all companies.

    Refused reservations use no credit, so purchased - consumed + refunded is the balance. Ledger rows are reduced per company, reason and pack before they meet the company table.
    """
    small = running_balance(ledger).groupBy("company_id", "reason", "pack_id").agg(
        F.sum("delta").alias("delta"), F.sum(F.when(~F.col("refused"), F.abs("delta"))).alias("used"), F.count(F.lit(1)).alias("n"))
    j = small.join(companies.select("company_id", "currency"), "company_id")
    buy, use = F.col("reason") == "purchase", F.col("reason").isin("reserve", "consume")
    back = F.col("reason").startswith("refund")
    price, usd = _price(ngn_per_usd) * F.col("n"), F.col("currency") == "usd"

    def total(cond: Column, value: Column | str) -> Column:
        return F.coalesce(F.sum(F.when(cond, F.col(value) if isinstance(value, str) else value)), F.lit(0)).cast("long")

    sums = j.agg(
        total(buy, "delta").alias("purchased"), total(use, "used").alias("consumed"), total(back, "delta").alias("refunded"),
        total(buy & usd, price).alias("revenue_usd"), total(buy & ~usd, price).alias("revenue_ngn"))
    active = balances(ledger).agg(F.coalesce(F.sum("balance"), F.lit(0)).cast("long").alias("active_credits"))
    return sums.withColumn("active_credits", active.select("active_credits").scalar())


def statement(ledger: DataFrame, last: int = 100) -> DataFrame:
    """The newest entries per company, newest first."""
    return top_per_key(ledger, ["company_id"], [F.desc("seq")], last, "position")


def has_purchased(ledger: DataFrame) -> DataFrame:
    return ledger.groupBy("company_id").agg(
        F.bool_or((F.col("reason") == "purchase") & (F.col("delta") > 0)).alias("has_purchased"))


def search_priority(searches: DataFrame, users: DataFrame, ledger: DataFrame) -> DataFrame:
    """Priority of each search: paying companies first."""
    paid = users.select("user_id", "company_id").join(has_purchased(ledger), "company_id", "left")
    j = searches.join(paid.select("user_id", "has_purchased"), "user_id", "left")
    return j.select(*searches.columns, F.when(F.col("has_purchased"), R.PAID_PRIORITY).otherwise(0).alias("queue_priority"))


def purchase_entries(orders: DataFrame) -> DataFrame:
    """Ledger rows for bought packs (``company_id, seq, ts, currency, pack_id``)."""
    credits = R.literal_map({p: str(c) for p, c, _ in R.CREDIT_PACKS})
    return orders.select(
        "company_id", "seq", "ts", F.try_element_at(credits, F.col("pack_id")).cast("int").alias("delta"),
        F.lit("purchase").alias("reason"), F.lit(None).cast("long").alias("search_id"), F.lit(None).cast("long").alias("lead_id"),
        "currency", "pack_id").filter("delta IS NOT NULL")


def refund_entries(leads: DataFrame, reason: str = "refund_invalid") -> DataFrame:
    """Ledger rows that give back the credit of leads (``company_id, seq, ts, search_id, lead_id, currency``)."""
    return leads.select(
        "company_id", "seq", "ts", F.lit(1).alias("delta"), F.lit(reason).alias("reason"), "search_id", "lead_id", "currency",
        F.lit(None).cast("string").alias("pack_id"))
