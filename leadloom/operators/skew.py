"""Per-key work that stays spread out when one key holds a large share of all rows.

* ``first_per_key`` is an aggregate, so every task reduces its own rows first.
* ``top_per_key`` is a rank filter, which Spark cuts per task before the shuffle.
* ``attach_per_key`` and ``lookup_per_key`` look one value per key up; the keys with most rows go through a broadcast
  of fixed size, and their rows are scattered instead of meeting in one task.
* ``bucketed_rank``, ``bucketed_lag`` and ``bucketed_running`` cut a group into ordered buckets, work inside the
  buckets and add what earlier buckets contribute.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window as W, functions as F

HOT_KEYS = 1000
SCATTER = 4096


def first_per_key(df: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """The first row of each key by ``order``, which must be unique within the key."""
    rest = [c for c in df.columns if c not in keys]
    picked = df.groupBy(*keys).agg(
        F.min_by(F.struct(*rest), F.struct(*order)).alias("__row"))
    return picked.select(*keys, "__row.*").select(*df.columns)


def top_per_key(df: DataFrame, keys: list[str], order: list[Column], k: int, rank: str | None = None) -> DataFrame:
    """The first ``k`` rows of each key, with their rank if a column name is given."""
    name = rank or "__rank"
    out = df.withColumn(name, F.row_number().over(W.partitionBy(*keys).orderBy(*order))).filter(F.col(name) <= k)
    return out if rank else out.drop(name)


def attach_per_key(df: DataFrame, keyed: DataFrame, keys: list[str], count: str) -> DataFrame:
    """Left join ``df`` with ``keyed`` (one row per key, ``count`` = rows of the key in ``df``).

    The ``HOT_KEYS`` keys with most rows are broadcast: a fixed number of rows whatever the data size. Every other key
    holds less than 1/HOT_KEYS of the rows and meets its value in a normal shuffle. Rows without a key get NULLs.
    """
    values = [c for c in keyed.columns if c not in keys and c != count]
    packed = keyed.dropna(subset=keys).select(*keys, F.struct(*values, count).alias("__value"))
    hot = packed.orderBy(F.desc(f"__value.{count}"), *keys).limit(HOT_KEYS).withColumnRenamed("__value", "__hot")
    return _scatter_join(df, hot, packed.withColumnRenamed("__value", "__cold"), keys, values)


def lookup_per_key(df: DataFrame, table: DataFrame, keys: list[str]) -> DataFrame:
    """Left join ``df`` with ``table`` (at most one row per key) in the same way; the hot keys are those of ``df``."""
    values = [c for c in table.columns if c not in keys]
    top = df.dropna(subset=keys).groupBy(*keys).agg(F.count(F.lit(1)).alias("__n")).orderBy(F.desc("__n"), *keys).limit(HOT_KEYS).select(*keys)
    packed = table.select(*keys, F.struct(*values).alias("__cold"))
    present = packed.join(F.broadcast(top), keys, "left_semi").withColumnRenamed("__cold", "__hot")
    hot = top.join(present, keys, "left")
    return _scatter_join(df, hot, packed, keys, values)


def _scatter_join(df: DataFrame, hot: DataFrame, cold: DataFrame, keys: list[str], values: list[str]) -> DataFrame:
    """Rows with a hot key take their value from the broadcast side and then go to any task, the others join ``cold``."""
    left = df.join(F.broadcast(hot.withColumn("__is_hot", F.lit(True))), keys, "left")
    elsewhere = F.col("__is_hot")
    for k in keys:
        elsewhere = elsewhere | F.col(k).isNull()
    spread = F.pmod(F.xxhash64(*df.columns), F.lit(SCATTER)).cast("int") + 1
    left = left.withColumn("__slot", F.when(F.coalesce(elsewhere, F.lit(False)), spread).otherwise(0))
    # always 0, but no constant: the optimizer would take a constant out of the join key and hot rows would meet again
    zero = F.pmod(F.xxhash64(*keys), F.lit(1)).cast("int")
    joined = left.join(cold.withColumn("__slot", zero), [*keys, "__slot"], "left")
    found = F.coalesce("__hot", "__cold")
    return joined.select(*df.columns, *[found[v].alias(v) for v in values])


def bucketed_rank(
    df: DataFrame, keys: list[str], order: list[Column], buckets: list[tuple[str, Column, bool]], rank: str
) -> DataFrame:
    """Row number per key. ``buckets`` are (name, coarse order column, ascending), in order of precedence.

    The coarse columns must be non-null and agree with ``order``: a row of an earlier bucket sorts earlier.
    """
    names = [b[0] for b in buckets]
    b = df.select("*", *[c.alias(n) for n, c, _ in buckets])
    direction = [F.col(n).asc() if asc else F.col(n).desc() for n, _, asc in buckets]
    sizes = b.groupBy(*keys, *names).agg(F.count(F.lit(1)).alias("__n"))
    before = sizes.withColumn(
        "__before",
        F.coalesce(F.sum("__n").over(
            W.partitionBy(*keys).orderBy(*direction).rowsBetween(W.unboundedPreceding, -1)), F.lit(0))).drop("__n")
    inside = b.withColumn("__in", F.row_number().over(W.partitionBy(*keys, *names).orderBy(*order)))
    return inside.join(before, [*keys, *names]).select(
        *df.columns, (F.col("__before") + F.col("__in")).alias(rank))


def bucketed_lag(
    df: DataFrame, keys: list[str], order: list[str], values: list[str], bucket: Column, prefix: str = "prev_"
) -> DataFrame:
    """Values of the previous row per key as ``prev_*``; ``bucket`` is a non-null coarse form of ``order[0]``."""
    b = df.withColumn("__b", bucket)
    previous = F.struct(*values)
    inside = b.withColumn("__prev", F.lag(previous).over(W.partitionBy(*keys, "__b").orderBy(*order)))
    last = b.groupBy(*keys, "__b").agg(F.max_by(previous, F.struct(*order)).alias("__last"))
    carried = last.select(
        *keys, "__b", F.lag("__last").over(W.partitionBy(*keys).orderBy("__b")).alias("__carried"))
    found = F.coalesce(F.col("__prev"), F.col("__carried"))
    return inside.join(carried, [*keys, "__b"], "left").select(
        *df.columns, *[found[v].alias(prefix + v) for v in values])


def bucketed_running(df: DataFrame, keys: list[str], order: str, value: str, width: int) -> DataFrame:
    """Running sum and its running minimum per key: ``run_sum``, ``run_min``, and the minimum before the row.

    ``order`` is an integer unique within the key, so a bucket holds at most ``width`` rows. A bucket hands on its
    sum and its lowest inner sum; both compose from left to right.
    """
    b = df.withColumn("__b", F.floor(F.col(order) / width))
    w = W.partitionBy(*keys, "__b").orderBy(order)
    inner = b.withColumn("__s", F.sum(value).over(w.rowsBetween(W.unboundedPreceding, 0)))
    inner = inner.withColumn("__m", F.min("__s").over(w.rowsBetween(W.unboundedPreceding, -1)))
    parts = inner.groupBy(*keys, "__b").agg(F.sum(value).alias("__sum"), F.min("__s").alias("__low"))
    before = W.partitionBy(*keys).orderBy("__b").rowsBetween(W.unboundedPreceding, -1)
    parts = parts.withColumn("__off", F.coalesce(F.sum("__sum").over(before), F.lit(0)))
    parts = parts.withColumn("__low_before", F.min(F.col("__off") + F.col("__low")).over(before))
    joined = inner.join(parts.select(*keys, "__b", "__off", "__low_before"), [*keys, "__b"])
    run_sum, low_before = F.col("__off") + F.col("__s"), F.least("__low_before", F.col("__off") + F.col("__m"))
    return joined.select(
        *df.columns, run_sum.alias("run_sum"), F.least(low_before, run_sum).alias("run_min"),
        low_before.alias("run_min_before"))
