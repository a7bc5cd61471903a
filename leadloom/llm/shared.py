"""Helpers of the operators in this subpackage."""

from __future__ import annotations

from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession, functions as F

from leadloom.session import checkpointed, new_folder, stored

#: Tables of at most this many bytes, measured after they are written, may be sent to every executor.
BROADCAST_BYTES = 8 << 20
#: Whole texts that go to a Python worker at once, and about as many bytes.
BATCH_ROWS, BATCH_BYTES = 500, 4 << 20


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


@contextmanager
def small_batches(spark: SparkSession) -> Iterator[None]:
    """Jobs run here hand whole texts to Python a few at a time: a batch is held by the JVM and by the worker, and ten
    thousand long texts are more than either should hold."""
    wanted = {"spark.sql.execution.arrow.maxRecordsPerBatch": BATCH_ROWS, "spark.sql.execution.arrow.maxBytesPerBatch": BATCH_BYTES}
    before = {name: spark.conf.get(name, None) for name in wanted}
    for name, most in wanted.items():
        spark.conf.set(name, str(most))
    try:
        yield
    finally:
        for name, value in before.items():
            spark.conf.set(name, value) if value else spark.conf.unset(name)


def labelled_sample(docs: DataFrame, labels: DataFrame, doc_id: str, text: str, rows: int) -> DataFrame:
    """(y, text) of at most ``rows`` documents that have a label, those of the smallest hashes of their ids.

    ``labels`` has id and y. Ids are chosen first; the texts of the chosen ones are then found by a broadcast of at
    most ``rows`` ids, so other texts do not move. Null ids and labels are left out, repeated ids count once.
    """
    labels = labels.dropna().groupBy("id").agg(F.max("y").alias("y"))
    ids = docs.select(F.col(doc_id).alias("id")).distinct().join(labels, "id").orderBy(F.xxhash64("id"), "id").limit(rows)
    ids = stored(ids, "sample")
    found = docs.select(F.col(doc_id).alias("id"), F.col(text).alias("text")).join(F.broadcast(ids), "id")
    return found.groupBy("id").agg(F.first("y").alias("y"), F.first("text").alias("text")).select("y", "text")


def unused(df: DataFrame, *names: str) -> list[str]:
    """The names, lengthened until ``df`` has no such columns."""
    taken = {c.lower() for c in df.columns}
    out = []
    for n in names:
        while n.lower() in taken:
            n += "_"
        taken.add(n.lower())
        out.append(n)
    return out


def sent_if_small(df: DataFrame) -> DataFrame:
    """``df``, written and with a broadcast hint if its measured size allows it; beyond that Spark shuffles it."""
    kept = stored(df, "small")
    size = kept._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()
    return F.broadcast(kept) if int(str(size)) <= BROADCAST_BYTES else kept


__all__ = ["BROADCAST_BYTES", "checkpointed", "labelled_sample", "new_folder", "read", "sent_if_small", "small_batches", "stored", "unused"]
