"""E-mail patterns per domain and generated addresses."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from leadloom import refdata as R
from leadloom.functions.email import SHAPES, email_from_shape, local_part_separator, local_part_shape, syntax_check
from leadloom.operators.skew import lookup_per_key


def discover_patterns(emails: DataFrame) -> DataFrame:
    """Most frequent local-part shape per ``domain`` (ties by declared order), its separator, share and count.

    ``emails``: ``domain, email``. Counts are per domain and shape, so a large domain is reduced before the shuffle.
    """
    marked = emails.select("domain", local_part_shape("email").alias("shape"), local_part_separator("email").alias("sep"))
    order = F.array_position(R.literal_array(SHAPES), F.col("shape"))
    by_shape = marked.groupBy("domain", "shape", "sep").agg(F.count(F.lit(1)).alias("n"))
    totals = by_shape.groupBy("domain").agg(
        F.sum("n").alias("emails"),
        F.sum(F.when(F.col("sep") == "-", F.col("n")).otherwise(0)).alias("hyphens"),
        F.sum(F.when(F.col("sep") == "_", F.col("n")).otherwise(0)).alias("underscores"),
        F.sum(F.when(F.col("sep") == ".", F.col("n")).otherwise(0)).alias("dots"))
    shapes = by_shape.filter("shape IS NOT NULL").groupBy("domain", "shape").agg(F.sum("n").alias("n"))
    best = shapes.groupBy("domain").agg(
        F.max_by(F.struct("shape", "n"), F.struct(F.col("n"), -order)).alias("b"))
    sep = (F.when(F.col("hyphens") > F.col("dots"), "-").when(F.col("underscores") > F.col("dots"), "_").otherwise("."))
    out = best.join(totals, "domain").select(
        "domain", F.col("b.shape").alias("shape"), sep.alias("separator"),
        (F.col("b.n") / F.col("emails")).alias("confidence"), F.col("b.n").alias("sample_count"))
    return out.withColumn("format", F.replace("shape", F.lit("."), F.col("separator")))


def generate_emails(people: DataFrame, patterns: DataFrame) -> DataFrame:
    """Address for people (``domain, name, email``) without one, by the pattern of their domain (confidence x 0.8)."""
    p = patterns.select("domain", F.col("shape").alias("__shape"), F.col("separator").alias("__sep"),
                        F.col("confidence").alias("__conf"))
    joined = lookup_per_key(people, p, ["domain"])
    made = email_from_shape("name", "__shape", "__sep", "domain")
    missing = F.coalesce(F.col("email"), F.lit("")) == ""
    return joined.select(
        *[c for c in people.columns if c != "email"],
        F.when(missing, made).otherwise(F.col("email")).alias("email"),
        F.when(missing & made.isNotNull(), "pattern_generated").alias("email_source"),
        F.when(missing & made.isNotNull(), F.round(F.col("__conf") * 0.8, 6)).alias("email_confidence"))


def deliverability_summary(emails: DataFrame) -> DataFrame:
    """Number of addresses by status."""
    return emails.groupBy(syntax_check("email")["status"].alias("status")).agg(F.count(F.lit(1)).alias("n"))
