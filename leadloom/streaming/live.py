"""Streams over leads, events and ledger entries.

Sources are append-only. ``drain`` runs a stream over everything available and returns what it wrote.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from contextlib import contextmanager

import pandas as pd
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession, Window as W, functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout
from pyspark.sql.types import NumericType

from leadloom.operators.dedup import dedup_domain
from leadloom.operators.queue import part_of, resolve_buckets
from leadloom.session import new_folder
from leadloom.streaming.stateful import BUSY, ClosedBuckets, RangeSums, StallAlerts


def file_stream(spark: SparkSession, folder: str, name: str, files_per_trigger: int = 100) -> DataFrame:
    """Parquet files ``name`` of a folder as a stream with the schema of the files."""
    schema = spark.read.parquet(f"{folder}/{name}").schema
    return (spark.readStream.schema(schema).option("pathGlobFilter", name)
            .option("maxFilesPerTrigger", files_per_trigger).parquet(folder))


@contextmanager
def rocks(spark: SparkSession) -> Iterator[None]:
    """Streams started here keep their state in RocksDB, which timers and keyed state need."""
    name = "spark.sql.streaming.stateStore.providerClass"
    before = spark.conf.get(name, None)
    spark.conf.set(name, "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    try:
        yield
    finally:
        spark.conf.set(name, before) if before else spark.conf.unset(name)


def drain(stream: DataFrame, name: str, mode: str = "append",
          each: Callable[[DataFrame, int], DataFrame] | None = None, folder: str | None = None) -> DataFrame:
    """Run ``stream`` once over all available input; each micro-batch is written as its own folder, so a batch that
    is run again after a failure replaces itself. The result has a ``batch`` column.

    ``folder`` keeps state and output: a later call with the same one goes on where the last one stopped, and returns
    the output of all. Without it a new one is taken. A source without data gives no rows.
    """
    spark = stream.sparkSession
    folder = folder or new_folder(spark, name)

    def write(batch: DataFrame, number: int) -> None:
        out = batch if each is None else each(batch, number)
        out.write.mode("overwrite").parquet(f"{folder}/out/batch={number}")

    with rocks(spark):
        query = (stream.writeStream.outputMode(mode).option("checkpointLocation", f"{folder}/state")
                 .foreachBatch(write).trigger(availableNow=True).start())
    query.awaitTermination()
    try:
        return spark.read.option("basePath", f"{folder}/out").parquet(f"{folder}/out")
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
    nothing = spark.createDataFrame([], stream.schema)
    return (nothing if each is None else each(nothing, 0)).withColumn("batch", F.lit(0))


# --- counters, dedup, trend ----------------------------------------------------------------------

def live_counters(leads: DataFrame) -> DataFrame:
    """Extracted and enriched leads per search, for update mode; tasks count their own rows first."""
    return leads.groupBy("search_id").agg(
        F.count(F.lit(1)).alias("total"), F.count_if(F.col("extraction_status") == "extracted").alias("extracted"),
        F.count_if(F.col("enrichment_status") == "enriched").alias("enriched"))


def latest(updates: DataFrame, keys: list[str]) -> DataFrame:
    """Last update of each key from the output of an update-mode stream."""
    values = [c for c in updates.columns if c not in (*keys, "batch")]
    last = updates.groupBy(*keys).agg(F.max_by(F.struct(*values), "batch").alias("v"))
    return last.select(*keys, "v.*")


def first_arrivals(leads: DataFrame, delay: str = "1 hour") -> DataFrame:
    """First lead per (search, domain) among those within ``delay`` of each other; leads without a domain all pass."""
    d = leads.withColumn("domain", F.coalesce(dedup_domain("website"), F.concat(F.lit("lead:"), F.col("lead_id"))))
    return d.withWatermark("ts", delay).dropDuplicatesWithinWatermark(["search_id", "domain"])


def daily_activity(events: DataFrame, delay: str = "1 day") -> DataFrame:
    """Events per type and day; days close when the watermark passes them."""
    return (events.withWatermark("ts", delay).groupBy(F.window("ts", "1 day").alias("w"), "event_type")
            .agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("value"), 2).alias("value"))
            .select(F.to_date("w.start").alias("day"), "event_type", "n", "value"))


# --- keyed state ---------------------------------------------------------------------------------

def accepted_positions(times: list[float], last: float | None, seconds: float) -> tuple[list[bool], float | None]:
    """Which of the ordered times come at least ``seconds`` after the last accepted one."""
    out = []
    for t in times:
        ok = last is None or t - last >= seconds
        out.append(ok)
        last = t if ok else last
    return out, last


def suppress_repeats(events: DataFrame, keys: list[str], seconds: float = 2.0, at: str = "ts", delay: str = "1 hour") -> DataFrame:
    """Submissions with the flag ``accepted``: one of the same key within ``seconds`` of the last accepted is not.

    State is one time per key and is dropped once the watermark has passed it by ``seconds``. Input of a key comes in
    order of time from batch to batch; inside a batch it is sorted.
    """
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in events.schema.fields)

    def run(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        last = state.get[0] if state.exists else None
        rows = pd.concat(list(frames)).sort_values(at, kind="stable")
        micros = rows[at].astype("datetime64[us]").astype("int64")
        flags, last = accepted_positions((micros / 1e6).tolist(), last, seconds)
        state.update((last,))
        state.setTimeoutTimestamp(max(int((last + seconds) * 1000) + 1, state.getCurrentWatermarkMs() + 1))
        yield rows.assign(accepted=flags)

    return events.withWatermark(at, delay).groupBy(*keys).applyInPandasWithState(
        run, f"{schema}, accepted boolean", "last double", "append", GroupStateTimeout.EventTimeTimeout)


def accepted_submissions(events: DataFrame, keys: list[str], seconds: float = 2.0, at: str = "ts", tie: str = "event_id",
                         delay: str = "1 hour", bucket_seconds: float = 600.0, folder: str | None = None) -> DataFrame:
    """(keys, tie, t, accepted) over a stream, by the rule of ``queue.accepted_submissions``; ``tie`` is a long.

    A bucket of time of one part of the keys is a key in the state store and comes out once the watermark has passed it;
    its rows carry what the bucket does with any earlier decision. Reading composes the buckets, so no task holds a whole
    key. Rows without a time are left out. Numbers among the keys wait as text, which holds nulls and every digit.
    """
    width, gap = int(bucket_seconds * 1_000_000), int(seconds * 1_000_000)
    t = F.unix_micros(F.col(at))
    types = {f.name: f.dataType for f in events.schema.fields}
    texts = {k: F.col(k).cast("string") for k in keys if isinstance(types[k], NumericType)}
    rows = events.withWatermark(at, delay).filter(F.col(at).isNotNull()).select(
        part_of(keys).alias("part"), F.floor(t / F.lit(width)).alias("bucket"), *[texts.get(k, F.col(k)).alias(k) for k in keys], tie, t.alias("t"), at)
    fields = {f.name: f.dataType.simpleString() for f in rows.schema.fields}
    schema = ", ".join(f"`{c}` {fields[c]}" for c in [*keys, "bucket", tie, "t"]) + ", leave long, step boolean"
    closed = rows.groupBy("part", "bucket").transformWithStateInPandas(ClosedBuckets(keys, tie, width, gap), schema, "Append", "EventTime")
    out = drain(closed, "submissions", folder=folder).drop("batch")
    return resolve_buckets(out.withColumns({k: F.col(k).cast(types[k]) for k in texts}), keys, tie, seconds)


def stall_alerts(progress: DataFrame, seconds: float = 30.0) -> DataFrame:
    """One alert per search whose counters do not move for ``seconds`` of processing time while it is busy.

    ``progress``: ``search_id, status, extracted_count, enriched_count``, in order of arrival. Reports with a time of
    their own are judged by ``stalled_spans``.
    """
    def run(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            extracted, enriched, _ = state.get
            state.remove()
            yield pd.DataFrame({"search_id": [key[0]], "extracted_count": [extracted], "enriched_count": [enriched]})
            return
        now = state.getCurrentProcessingTimeMs()
        extracted, enriched, since = state.get if state.exists else (-1, -1, now)
        active = False
        for frame in frames:
            top = max(extracted, int(frame.extracted_count.max())), max(enriched, int(frame.enriched_count.max()))
            since = since if top == (extracted, enriched) else now
            extracted, enriched = top
            active = bool(frame.status.iloc[-1] in BUSY)
        if active:
            state.update((extracted, enriched, since))
            state.setTimeoutDuration(max(1, int(seconds * 1000) - (now - since)))
        elif state.exists:
            state.remove()

    return progress.groupBy("search_id").applyInPandasWithState(
        run, "search_id long, extracted_count long, enriched_count long", "extracted long, enriched long, since long", "update",
        GroupStateTimeout.ProcessingTimeTimeout)


def stalled_spans(progress: DataFrame, seconds: float = 30.0, delay: str = "1 hour", keep: float = 86_400.0) -> DataFrame:
    """One alert per span in which the counters of a busy search do not move for more than ``seconds`` of event time.

    ``progress``: ``search_id, ts, status, extracted_count, enriched_count``. Reports are judged in order of time, once
    the watermark has passed them; null counters count as 0.
    """
    none = F.col("search_id").isNull()
    reports = progress.withWatermark("ts", delay).select(
        part_of(["search_id"]).alias("part"), none.alias("none"), F.coalesce("search_id", F.lit(0)).cast("long").alias("search_id"),
        "ts", "status", "extracted_count", "enriched_count")
    return reports.groupBy("part").transformWithStateInPandas(
        StallAlerts(seconds, keep), "search_id long, extracted_count long, enriched_count long, since timestamp", "Append", "EventTime")


# --- running balance -----------------------------------------------------------------------------

def running_balances(entries: DataFrame, width: int = 1_000_000, folder: str | None = None) -> DataFrame:
    """Balance after each ledger entry and refusals, over a stream of entries in ``seq`` order from batch to batch.

    The state store holds (sum, lowest) per company and range of ``width`` entry numbers; a batch touches and writes
    what belongs to its own entries only. Reading composes the ranges: one row per range meets per company, and entries
    meet the sums of earlier ranges by (company, range), so a company with most of the entries is no single task.
    """
    ranged = entries.withColumn("__range", F.floor(F.col("seq") / F.lit(width)))
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in ranged.schema.fields) + ", in_sum long, in_low long"
    summed = ranged.groupBy("company_id", "__range").transformWithStateInPandas(
        RangeSums(["company_id", "__range"], "seq", "delta"), schema, "Append", "None")
    rows = drain(summed, "balances", folder=folder).drop("batch")
    parts = rows.groupBy("company_id", "__range").agg(F.sum("delta").alias("total"), F.min("in_sum").alias("low"))
    before = W.partitionBy("company_id").orderBy("__range").rowsBetween(W.unboundedPreceding, -1)
    parts = parts.withColumn("start", F.coalesce(F.sum("total").over(before), F.lit(0)))
    parts = parts.withColumn("low_before", F.min(F.col("start") + F.col("low")).over(before))
    s = F.col("start") + F.col("in_sum")
    lowest = F.least("low_before", F.col("start") + F.col("in_low"))
    return rows.join(parts.select("company_id", "__range", "start", "low_before"), ["company_id", "__range"]).select(
        *entries.columns, (s - F.least(F.lit(0), lowest, s)).cast("long").alias("balance"),
        ((F.col("delta") < 0) & (s < F.least(F.lit(0), F.coalesce(lowest, F.lit(0))))).alias("refused"))
