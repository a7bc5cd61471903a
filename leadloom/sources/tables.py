"""Reading and writing the lead tables."""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from leadloom import schemas as S
from leadloom.operators.skew import lookup_per_key

TABLE_SCHEMAS = {
    "leads": S.LEADS, "searches": S.SEARCHES, "users": S.USERS, "companies": S.COMPANIES, "ledger": S.LEDGER,
    "enrichment": S.ENRICHMENT, "search_results": S.SEARCH_RESULTS, "pages": S.PAGES,
}


def scan(spark: SparkSession, root: str, name: str) -> DataFrame:
    """Table with its declared schema; filters and columns reach the Parquet scan. Secrets are never read."""
    return spark.read.schema(TABLE_SCHEMAS[name]).parquet(f"{root}/{name}").drop("password")


def text_pages(spark: SparkSession, path: str) -> DataFrame:
    """HTML files of a folder as pages: the path is the URL, its hash the id."""
    raw = spark.read.text(path, wholetext=True).select(F.col("_metadata.file_path").alias("url"), F.col("value").alias("html"))
    return raw.select(F.xxhash64("url").alias("page_id"), "url", "html")


def raw_files(spark: SparkSession, path: str, pattern: str = "*.pdf") -> DataFrame:
    return spark.read.format("binaryFile").option("pathGlobFilter", pattern).load(path).select("path", "content")


def point_read(leads: DataFrame, searches: DataFrame, lead_id: int) -> DataFrame:
    """One lead with query and country of its search."""
    lead = leads.filter(F.col("lead_id") == lead_id)
    return lead.join(searches.select("search_id", "query", "country"), "search_id", "left")


def with_parents(leads: DataFrame, searches: DataFrame, users: DataFrame, companies: DataFrame) -> DataFrame:
    """Leads with their search, its user and the company of the user.

    The parents are joined with each other first, so that leads move once; a search with most leads is spread.
    """
    owner = users.select("user_id", "company_id", "role").join(companies.select("company_id", "currency"), "company_id", "left")
    parents = searches.select("search_id", "user_id", "status").join(owner, "user_id", "left")
    return lookup_per_key(leads, parents, ["search_id"])


def write_leads(leads: DataFrame, root: str) -> None:
    """Replace the leads of the searches present in ``leads``; other searches stay."""
    (leads.repartition("search_id", F.pmod(F.xxhash64("lead_id"), F.lit(16)))
     .sortWithinPartitions("search_id", "lead_id").write.mode("overwrite")
     .option("partitionOverwriteMode", "dynamic").partitionBy("search_id").parquet(f"{root}/leads"))


# --- leads by bucket, with versions ---------------------------------------------------------------

LEAD_BUCKETS = 64


def _bucket(buckets: int) -> Column:
    return F.pmod(F.xxhash64("search_id"), F.lit(buckets)).cast("int")


def _versions(spark: SparkSession, root: str) -> DataFrame:
    """Versions that are in force."""
    return _read_or_empty(spark, f"{root}/versions", "version long")


def _read_or_empty(spark: SparkSession, path: str, ddl: str) -> DataFrame:
    try:
        return spark.read.schema(ddl).parquet(path)
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
    return spark.createDataFrame([], ddl)


def commit_leads(leads: DataFrame, root: str, buckets: int = LEAD_BUCKETS) -> int:
    """Replace the leads of the searches present in ``leads`` in the table at ``root``; returns the new version.

    Rows are appended to the buckets of their searches, the searches they replace go to a table of deletions, and the
    version comes into force with its line in ``versions``, which is written last: a writer that dies before leaves
    nothing that readers see. Old rows are neither read nor written. There is one writer at a time.
    """
    return _commit(leads.sparkSession, root, leads, leads.select("search_id").distinct(), buckets)


def delete_leads(spark: SparkSession, doomed: DataFrame, root: str, buckets: int = LEAD_BUCKETS) -> int:
    """Delete the leads of the searches in ``doomed`` (search_id), which may be of any size."""
    return _commit(spark, root, None, doomed.select("search_id").distinct(), buckets)


def _commit(spark: SparkSession, root: str, leads: DataFrame | None, gone: DataFrame, buckets: int) -> int:
    version = (_versions(spark, root).agg(F.max("version")).first()[0] or 0) + 1
    marked = gone.select("search_id", F.lit(version).cast("long").alias("version"))
    if leads is not None:
        rows = leads.withColumn("version", F.lit(version).cast("long")).withColumn("bucket", _bucket(buckets))
        # a bucket is one file of a version, however many searches there are; large buckets come in several
        rows = rows.repartition(buckets, "bucket").sortWithinPartitions("bucket", "search_id", "lead_id")
        rows.write.mode("append").option("maxRecordsPerFile", 1_000_000).partitionBy("bucket").parquet(f"{root}/leads")
    marked.coalesce(1).write.mode("append").parquet(f"{root}/deleted")
    spark.range(1).select(F.lit(version).cast("long").alias("version")).coalesce(1).write.mode("append").parquet(f"{root}/versions")
    return version


def read_leads(spark: SparkSession, root: str, ddl: str, searches: DataFrame | None = None, buckets: int = LEAD_BUCKETS) -> DataFrame:
    """Leads in force, with the columns of ``ddl``; with ``searches`` (search_id) only theirs, from their buckets alone.

    A row counts if its version is in force and no later one has replaced or deleted its search.
    """
    rows = _read_or_empty(spark, f"{root}/leads", f"{ddl}, version long, bucket int")
    if searches is not None:
        wanted = [r[0] for r in searches.select(_bucket(buckets)).distinct().collect()]  # at most ``buckets`` numbers
        rows = rows.filter(F.col("bucket").isin(wanted)).join(searches.select("search_id").distinct(), "search_id", "left_semi")
    versions = _versions(spark, root).distinct()
    gone = _read_or_empty(spark, f"{root}/deleted", "search_id long, version long").join(versions, "version", "left_semi")
    gone = gone.groupBy("search_id").agg(F.max("version").alias("since"))
    live = rows.join(versions, "version", "left_semi")
    return lookup_per_key(live, gone, ["search_id"]).filter("since IS NULL OR version >= since").drop("version", "bucket", "since")


def compact_leads(spark: SparkSession, root: str, target: str, ddl: str, buckets: int = LEAD_BUCKETS) -> int:
    """The leads in force as the first version of a new table at ``target``."""
    return commit_leads(read_leads(spark, root, ddl), target, buckets)


def deletable_searches(searches: DataFrame, users: DataFrame, viewer_id: int, wanted: list[int]) -> DataFrame:
    """Ids the viewer may delete: own searches, or those of company colleagues when the viewer is an admin."""
    owner = users.select("user_id", "company_id")
    viewer = users.filter(F.col("user_id") == viewer_id).select(
        F.col("company_id").alias("viewer_company"), (F.col("role") == "admin").alias("is_admin"))
    asked = searches.filter(F.col("search_id").isin(wanted)).select("search_id", "user_id")
    own = asked.filter(F.col("user_id") == viewer_id).select("search_id")
    theirs = asked.join(owner, "user_id").join(
        viewer.filter("is_admin"), F.col("company_id") == F.col("viewer_company")).select("search_id")
    return own.union(theirs).distinct()


def without_searches(table: DataFrame, doomed: DataFrame) -> DataFrame:
    """Rows of a table with ``search_id`` that survive the deletion."""
    return table.join(doomed.select("search_id"), "search_id", "left_anti").select(*table.columns)


def append_ledger(entries: DataFrame, root: str) -> None:
    entries.write.mode("append").parquet(f"{root}/ledger")


def write_csv(frame: DataFrame, path: str) -> None:
    """One header per file; small exports come as one file, larger ones as several."""
    frame.write.mode("overwrite").option("header", True).csv(path)
