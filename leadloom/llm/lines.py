"""Removal of boilerplate lines by their frequency within a site."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from leadloom.llm.shared import sent_if_small, unused

#: A line is boilerplate if it stands on more than this share of the pages of its site, in percent, ...
BOILERPLATE_PERCENT = 5
#: ... and on this many of them at least, so that small sites keep their lines.
MIN_PAGES = 5


def _lines(text: Column) -> Column:
    return F.split(F.coalesce(text, F.lit("")), "\n", -1)


def _digest(line: Column) -> Column:
    """128 bits that stand for a line; blank lines have none."""
    return F.when(F.length(F.trim(line)) > 0, F.struct(F.xxhash64(line).alias("x"), F.xxhash64(F.lit("line"), line).alias("y")))


def boilerplate_lines(
    docs: DataFrame, site: str = "source", text: str = "text", percent: int = BOILERPLATE_PERCENT, min_pages: int = MIN_PAGES
) -> DataFrame:
    """(site, lines): digests of the boilerplate lines of each site that has any.

    A row is a page, and a line counts once on it. With L lines on a page of a site on average, at most
    100 L / percent of its lines can pass, so a row stays small however many pages the site has.
    """
    pages = docs.select(F.col(site).alias("site"), F.array_distinct(F.transform(_lines(F.col(text)), _digest)).alias("lines"))
    totals = pages.groupBy("site").agg(F.count("*").alias("n_pages"))
    seen = pages.select("site", F.explode("lines").alias("line")).filter("line IS NOT NULL")
    seen = seen.groupBy("site", "line").agg(F.count("*").alias("n")).filter(F.col("n") >= min_pages)
    common = seen.join(totals, seen["site"].eqNullSafe(totals["site"])).filter(100 * F.col("n") > percent * F.col("n_pages"))
    return common.groupBy(seen["site"]).agg(F.collect_list("line").alias("lines"))


def without_boilerplate(
    docs: DataFrame, site: str = "source", text: str = "text", percent: int = BOILERPLATE_PERCENT, min_pages: int = MIN_PAGES,
    length: str | None = None, counts: tuple[str, str] | None = None,
) -> DataFrame:
    """``docs`` with ``text`` freed from boilerplate lines; ``counts`` names two more columns for lines and lines dropped.

    Lines are what ``\\n`` separates, compared exactly. Blank lines stay. Null texts count as empty and become empty
    ones; rows without a site form a site of their own. ``length`` names a column to set to the new number of characters. A page may lose all its lines, but never its row.
    """
    name, common, kept, n = unused(docs, "site_", "common_", "kept_", "n_")
    found = sent_if_small(boilerplate_lines(docs, site, text, percent, min_pages).select(F.col("site").alias(name), F.col("lines").alias(common)))
    joined = docs.join(found, F.col(site).eqNullSafe(F.col(name)), "left")
    lines = _lines(F.col(text))
    left = F.when(F.col(common).isNull(), lines).otherwise(
        F.filter(lines, lambda x: ~F.coalesce(F.array_contains(F.col(common), _digest(x)), F.lit(False))))
    out = joined.withColumns({kept: left, n: F.size(lines)}).withColumn(text, F.array_join(kept, "\n"))
    if length:
        out = out.withColumn(length, F.length(text).cast(docs.schema[length].dataType))
    more = [F.col(n).alias(counts[0]), (F.col(n) - F.size(kept)).alias(counts[1])] if counts else []
    return out.select(*docs.columns, *more)
