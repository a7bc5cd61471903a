"""Order of waiting searches, repeated submissions and stalled progress."""

from __future__ import annotations

from bisect import bisect_left
from functools import reduce
from operator import and_

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from leadloom.operators.skew import attach_per_key, bucketed_lag, bucketed_rank

ID_WIDTH = 1_000_000
WAITING = ("pending", "queued")


def fair_order(searches: DataFrame) -> DataFrame:
    """Waiting searches in turn order: each user's by priority and arrival, users one after the other.

    ``turn`` is the round, ``user_arrival`` the first arrival of the user; sort by both. Ranking is split by priority,
    day and id range, so a user with most of the searches is ranked by many tasks.
    """
    waiting = searches.filter(F.col("status").isin(*WAITING))
    buckets = [("__p", F.coalesce("priority", F.lit(0)), False), ("__d", F.to_date("created_at"), True),
               ("__i", F.floor(F.col("search_id") / ID_WIDTH), True)]
    order = [F.desc(F.coalesce("priority", F.lit(0))), F.asc(F.to_date("created_at")), F.asc("search_id")]
    ranked = bucketed_rank(waiting, ["user_id"], order, buckets, "turn")
    arrivals = waiting.groupBy("user_id").agg(F.min(F.struct("created_at", "search_id")).alias("a"), F.count(F.lit(1)).alias("n"))
    arrivals = arrivals.select("user_id", F.col("a.search_id").alias("user_arrival"), "n")
    return attach_per_key(ranked, arrivals, ["user_id"], "n")


def queue_status(searches: DataFrame) -> DataFrame:
    """Waiting searches per user."""
    return searches.filter(F.col("status").isin(*WAITING)).groupBy("user_id").agg(F.count(F.lit(1)).alias("queued"))


def queue_summary(searches: DataFrame) -> DataFrame:
    return queue_status(searches).agg(
        F.coalesce(F.sum("queued"), F.lit(0)).alias("queue_length"), F.count(F.lit(1)).alias("active_users"))


def repeat_submissions(events: DataFrame, keys: list[str], at: str = "ts", seconds: float = 2.0, tie: str = "event_id") -> DataFrame:
    """Events that follow one of the same key within ``seconds``, with the gap.

    Work is split into ten-minute buckets; the last event before a bucket is carried into it.
    """
    t = F.col(at).cast("timestamp")
    b = events.withColumn("__t", F.unix_micros(t))
    bucket = F.floor(F.col("__t") / F.lit(600_000_000))
    lagged = bucketed_lag(b, keys, ["__t", tie], ["__t"], bucket)
    gap = (F.col("__t") - F.col("prev___t")) / 1_000_000
    return lagged.filter(gap < seconds).select(*events.columns, F.round(gap, 6).alias("gap_seconds"))


#: Keys are dealt into so many parts; the keys of a part are worked on together.
PARTS = 128


def part_of(keys: list[str]) -> Column:
    return F.pmod(F.xxhash64(*keys), F.lit(PARTS)).cast("int")


def key_codes(table: pa.Table, keys: list[str]) -> np.ndarray:
    """A number for each row that equal keys share; nulls are equal."""
    code = np.zeros(table.num_rows, np.int64)
    for k in keys:
        values = table[k].combine_chunks().dictionary_encode("encode")
        code = code * (len(values.dictionary) + 1) + values.indices.to_numpy(zero_copy_only=False)
        code = np.unique(code, return_inverse=True)[1]
    return code


def ordered(table: pa.Table, keys: list[str], tie: str) -> tuple[pa.Table, np.ndarray]:
    """The rows by key, time and tie, and the numbers of their keys."""
    table = table.append_column("__code", pa.array(key_codes(table, keys))).sort_by(
        [("__code", "ascending"), ("t", "ascending"), (tie, "ascending")])
    return table.drop_columns(["__code"]), table["__code"].to_numpy()


def _laid_out(code: np.ndarray, times: np.ndarray, gap: int) -> tuple[np.ndarray, int, int, np.ndarray]:
    """(line, base, stride, ends): the ordered times of each key one after the other on a single line, further apart than
    ``gap``, and for each key where its rows end."""
    base = int(times.min())
    stride = int(times.max()) - base + gap + 1
    ends = np.append(np.flatnonzero(code[1:] != code[:-1]) + 1, len(code))
    return times - base + code * stride, base, stride, ends


def bucket_steps(times: np.ndarray, gap: int, start: int, code: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """(leave, step) of the ordered times of a bucket that begins at ``start``, for each key that ``code`` numbers.

    ``leave`` is the last time accepted if a time is the first accepted. A decision before the bucket only bears on times
    below ``start + gap``, so the first time beyond is the last that can be the first accepted. ``step`` marks these
    possible entries, the last of each run that leaves at one time.
    """
    code = np.zeros(len(times), np.int64) if code is None else np.unique(code, return_inverse=True)[1]
    line, base, stride, ends = _laid_out(code, times, gap)
    following = np.searchsorted(line, line + gap, "left")
    to = np.where(following == ends[code], np.arange(len(times)), np.minimum(following, len(times) - 1))
    while (to[to] != to).any():  # twice as far in each round
        to = to[to]
    leave = times[to]
    within = min(max(start + gap - base, 0), stride)
    last = np.minimum(np.searchsorted(line, np.arange(len(ends)) * stride + within, "left"), ends - 1)
    step = np.append((leave[1:] != leave[:-1]) | (code[1:] != code[:-1]), True)
    step[np.arange(len(times)) >= last[code]] = False
    step[last] = True
    return leave, step


def _carried(steps: pa.Table, keys: list[str], gap: int) -> pa.Table:
    """The last time accepted before each bucket of each key; ``steps`` has (bucket, leave, entry) of all of them."""
    code = key_codes(steps, keys)
    order = np.lexsort((steps["entry"].to_numpy(), steps["bucket"].to_numpy(), code))
    code, bucket = code[order], steps["bucket"].to_numpy()[order]
    entry, leave = (steps[c].to_numpy()[order].tolist() for c in ("entry", "leave"))
    new_key = np.append(True, code[1:] != code[:-1])
    first = np.flatnonzero(new_key | np.append(True, bucket[1:] != bucket[:-1]))
    carry, before = None, []
    for a, b, new in zip(first.tolist(), [*first[1:].tolist(), len(bucket)], new_key[first].tolist()):
        carry = None if new else carry
        before.append(carry)
        k = a if carry is None else bisect_left(entry, carry + gap, a, b)
        carry = carry if k == b else leave[k]
    out = steps.select(keys).take(pa.array(order[first]))
    return out.append_column("bucket", pa.array(bucket[first])).append_column("carry", pa.array(before, pa.int64()))


def _accepted(code: np.ndarray, times: np.ndarray, carry: pa.Array, gap: int) -> np.ndarray:
    """Which of the ordered times of each key are accepted after ``carry``, the key's last time accepted before."""
    code = np.unique(code, return_inverse=True)[1]
    line, base, stride, ends = _laid_out(code, times, gap)
    following = np.searchsorted(line, line + gap, "left")
    begin = np.append(0, ends[:-1])
    known = carry.is_valid().to_numpy(zero_copy_only=False)[begin]
    free = np.where(known, carry.fill_null(0).to_numpy()[begin] + gap - base, 0)
    at = np.searchsorted(line, np.arange(len(ends)) * stride + np.clip(free, 0, stride - 1), "left")
    accepted, key = np.zeros(len(times), bool), np.arange(len(ends))
    while len(at):  # all keys go on to their next accepted time
        inside = at < ends[key]
        at, key = at[inside], key[inside]
        accepted[at] = True
        at = following[at]
    return accepted


def resolve_buckets(rows: DataFrame, keys: list[str], tie: str, seconds: float) -> DataFrame:
    """(keys, tie, t, accepted) of rows (keys, bucket, tie, t, leave, step): buckets are composed from left to right.

    A bucket is a function from the last time accepted before it to the last one accepted in it. Its steps are few rows
    however many the bucket has; only these meet per part of the keys, rows meet per part and bucket.
    """
    gap = int(seconds * 1_000_000)
    steps = rows.filter("step").select(part_of(keys).alias("__part"), *keys, "bucket", "leave", F.col("t").alias("entry"))
    fields = {f.name: f.dataType.simpleString() for f in rows.schema.fields}
    key_schema = ", ".join(f"`{k}` {fields[k]}" for k in keys)
    carried = steps.groupBy("__part").applyInArrow(lambda t: _carried(t, keys, gap), f"{key_schema}, bucket long, carry long")

    def flags(table: pa.Table) -> pa.Table:
        table, code = ordered(table, keys, tie)
        accepted = _accepted(code, table["t"].to_numpy(), table["carry"].combine_chunks(), gap)
        return table.select([*keys, tie, "t"]).append_column("accepted", pa.array(accepted))
    same = reduce(and_, [F.col(f"r.{k}").eqNullSafe(F.col(f"c.{k}")) for k in [*keys, "bucket"]])
    joined = rows.alias("r").join(carried.alias("c"), same).select("r.*", "c.carry")
    return joined.withColumn("__part", part_of(keys)).groupBy("__part", "bucket").applyInArrow(
        flags, f"{key_schema}, `{tie}` {fields[tie]}, t long, accepted boolean")


def accepted_submissions(events: DataFrame, keys: list[str], at: str = "ts", seconds: float = 2.0, tie: str = "event_id",
                         bucket_seconds: float = 600.0) -> DataFrame:
    """(keys, tie, t, accepted): a submission within ``seconds`` of the last accepted one of its key is not accepted.

    Unlike a gap to the previous one, this depends on all earlier decisions. Buckets of time are worked on apart and
    composed, so a key with most of the rows is many tasks. ``t`` is the time in microseconds; rows without a time are
    left out; keys that are null form a key.
    """
    width, gap = int(bucket_seconds * 1_000_000), int(seconds * 1_000_000)
    t = F.unix_micros(F.col(at).cast("timestamp"))
    rows = events.filter(F.col(at).isNotNull()).select(*keys, F.floor(t / F.lit(width)).alias("bucket"), tie, t.alias("t"))
    fields = {f.name: f.dataType.simpleString() for f in rows.schema.fields}

    def leaving(table: pa.Table) -> pa.Table:
        table, code = ordered(table.drop_columns(["__part"]), keys, tie)
        leave, step = bucket_steps(table["t"].to_numpy(), gap, table["bucket"][0].as_py() * width, code)
        return table.append_column("leave", pa.array(leave)).append_column("step", pa.array(step))
    schema = ", ".join(f"`{c}` {fields[c]}" for c in rows.columns) + ", leave long, step boolean"
    parted = rows.withColumn("__part", part_of(keys)).groupBy("__part", "bucket")
    return resolve_buckets(parted.applyInArrow(leaving, schema), keys, tie, seconds)


def gaps(events: DataFrame, keys: list[str], at: str, tie: str) -> DataFrame:
    """Seconds since the previous event of the key; days are worked on apart and joined by their last event."""
    b = events.withColumn("__t", F.unix_micros(F.col(at).cast("timestamp")))
    lagged = bucketed_lag(b, keys, ["__t", tie], ["__t"], F.floor(F.col("__t") / F.lit(86_400_000_000)))
    return lagged.select(*events.columns, F.round((F.col("__t") - F.col("prev___t")) / 1_000_000, 6).alias("gap_seconds"))


BUSY = ("processing", "extracting", "enriching")


def stalled(progress: DataFrame, seconds: float = 30.0, now: Column | None = None) -> DataFrame:
    """Spans in which a processing search did not move for ``seconds``.

    ``progress``: ``search_id, ts, status, extracted_count, enriched_count``. Counters only grow, so a span without
    change is the group of equal counters: one aggregate, no ordering. With ``now``, the last span of a search that was
    busy when last heard of lasts until then, so one that stopped reporting is found as well.
    """
    busy = progress.filter(F.col("status").isin(*BUSY))
    spans = busy.groupBy("search_id", "extracted_count", "enriched_count").agg(
        F.min("ts").alias("since"), F.max("ts").alias("until"))
    if now is not None:
        last = progress.groupBy("search_id").agg(F.max(F.struct("ts", F.col("status").isin(*BUSY).alias("busy"))).alias("last"))
        going_on = F.col("last.busy") & (F.col("until") == F.col("last.ts"))
        until = F.when(going_on, F.greatest("until", now.cast("timestamp").cast(progress.schema["ts"].dataType))).otherwise(F.col("until"))
        spans = spans.join(last, "search_id").withColumn("until", until).drop("last")
    held = (F.unix_micros(F.col("until").cast("timestamp")) - F.unix_micros(F.col("since").cast("timestamp"))) / 1_000_000
    return spans.withColumn("stalled_seconds", held).filter(held > seconds)
