"""What filters remove, alone and after each other, for every order in which they may run.

A document is a row of a mask matrix: 0 for a filter it fails, infinity for one it passes. An order is a row of
positions, the inverse of its permutation. The min-plus product of both is the step at which the order removes the
document. As that step depends on the mask alone, documents are first counted per part and mask; the counts are then
scattered over steps.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import permutations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

#: Letters of the filters; bit i of a mask is the i-th.
FILTERS = "ABCDE"
MIN_WORDS, MIN_DISTINCT_PERCENT, MAX_CAPITALS_PERCENT, SYMBOLS = 200, 50, 2, "[#$%&*|]"
#: Rows of the result that a task holds at once.
ROWS_AT_ONCE = 1 << 16


def text_masks(docs: DataFrame, doc_id: str, text: str, part: str) -> DataFrame:
    """(doc_id, part, digest, mask) of each row, with the filters that look at one text."""
    own = F.coalesce(F.col(text), F.lit(""))
    split = docs.select(F.col(doc_id).alias("doc_id"), F.coalesce(F.col(part).cast("string"), F.lit("")).alias("part"), own.alias("text"),
                        F.array_remove(F.split(own, r"[\x20\x09-\x0D]+"), "").alias("words"))
    n, distinct = F.size("words"), F.size(F.array_distinct("words"))
    capitals = F.length(F.regexp_replace("text", "[^A-Z]", ""))
    fails = [n < MIN_WORDS, 100 * distinct < MIN_DISTINCT_PERCENT * n,
             100 * capitals > MAX_CAPITALS_PERCENT * F.length("text"), F.col("text").rlike(SYMBOLS)]
    mask = sum((f.cast("int") * (1 << i) for i, f in enumerate(fails)), F.lit(0))
    return split.select("doc_id", "part", F.unhex(F.sha2("text", 256)).alias("digest"), mask.alias("mask"))


def _with_labels(rows: DataFrame, labels: DataFrame) -> DataFrame:
    """``rows`` with good and toxic of their doc_id; rows without an id have neither and are dealt to any task."""
    y = labels.dropna(subset=["doc_id"]).groupBy("doc_id").agg(
        F.max(F.coalesce(F.col("quality") == 1, F.lit(False))).alias("good"), F.max(F.coalesce(F.col("toxic") == 1, F.lit(False))).alias("toxic"))
    # not a constant: the optimizer would take a constant out of the join key, and rows without an id would meet
    slot = F.when(F.col("doc_id").isNull(), F.xxhash64("digest")).otherwise(F.pmod(F.xxhash64("doc_id"), F.lit(1)))
    joined = rows.withColumn("slot", slot).join(y.withColumn("slot", F.pmod(F.xxhash64("doc_id"), F.lit(1))), ["doc_id", "slot"], "left")
    return joined.withColumns({c: F.coalesce(c, F.lit(False)) for c in ("good", "toxic")}).drop("slot")


def mask_counts(docs: DataFrame, labels: DataFrame, doc_id: str = "doc_id", text: str = "text", part: str = "source") -> DataFrame:
    """(part, mask, n, good, toxic): rows per part and mask, and how many of them have either label.

    Copies are counted per text, part and labels before any of them meet, so a text that a third of all rows share is
    a few rows. Only then the smallest id of each text over the whole table decides the last filter.
    """
    rows = text_masks(docs, doc_id, text, part).groupBy("doc_id", "part", "digest", "mask").agg(F.count("*").alias("n"))
    first = F.min(F.when(F.col("doc_id").isNotNull(), F.struct("doc_id", "n"))).alias("first")
    groups = _with_labels(rows, labels).groupBy("digest", "part", "mask", "good", "toxic").agg(
        F.sum("n").alias("n"), first, F.sum(F.when(F.col("doc_id").isNull(), F.col("n")).otherwise(0)).alias("free"))
    lowest = groups.groupBy("digest").agg(F.min("first.doc_id").alias("lowest"))
    kept = F.col("free") + F.when(F.col("first.doc_id") == F.col("lowest"), F.col("first.n")).otherwise(0)
    split = F.explode(F.array(F.struct(F.col("mask"), kept.alias("n")),
                              F.struct(F.col("mask").bitwiseOR(F.lit(1 << FILTERS.index("E"))).alias("mask"), (F.col("n") - kept).alias("n"))))
    each = groups.join(lowest, "digest").select("part", "good", "toxic", split.alias("s")).select("part", "good", "toxic", "s.*")
    return each.groupBy("part", "mask").agg(
        F.sum("n").alias("n"), *[F.sum(F.when(F.col(c), F.col("n")).otherwise(0)).alias(c) for c in ("good", "toxic")])


def removal_steps(n_filters: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(orders, positions, steps): ``steps[order, mask]`` is the step that removes a row of that mask, infinity if none."""
    orders = np.array(list(permutations(range(n_filters))))
    positions = np.argsort(orders, axis=1) + 1.0
    fails = np.arange(1 << n_filters)[:, None] >> np.arange(n_filters) & 1
    masks = np.where(fails == 1, 0.0, np.inf)
    return orders, positions, (masks[None] + positions[:, None, :]).min(axis=2)


def _tables(batch: pa.RecordBatch, names: str) -> Iterator[pa.RecordBatch]:
    k = len(names)
    orders, positions, steps = removal_steps(k)
    at = np.arange(1, k + 1)
    removed = (steps[:, None, :] == at[:, None]).reshape(-1, 1 << k)
    left = (steps[:, None, :] > at[:, None]).reshape(-1, 1 << k)
    fails = (np.arange(1 << k) >> orders[:, :, None] & 1).reshape(-1, 1 << k) == 1
    late = fails & (steps[:, None, :] < at[:, None]).reshape(-1, 1 << k)
    filters, letters = orders.ravel(), np.array(list(names))
    order_names = np.repeat(["".join(letters[o]) for o in orders], k)
    parts = batch.column(batch.schema.get_field_index("part"))
    counts = batch.column(batch.schema.get_field_index("counts"))
    flat, first = counts.flatten(), np.asarray(counts.offsets)
    size = max(1, ROWS_AT_ONCE // len(filters))
    for lo in range(0, batch.num_rows, size):
        hi = min(lo + size, batch.num_rows)
        row = np.repeat(np.arange(hi - lo), np.diff(first[lo:hi + 1]))
        own = flat.slice(first[lo] - first[0], first[hi] - first[lo])
        mask = np.asarray(own.field("mask"))
        weights = {c: np.zeros((hi - lo, 1 << k), np.int64) for c in ("n", "good", "toxic")}
        for c, w in weights.items():
            np.add.at(w, (row, mask), np.asarray(own.field(c)))
        gone = weights["n"] @ removed.T
        by_filter = np.stack([gone[:, filters == f].sum(axis=1) for f in range(k)], axis=1)
        columns = {
            "kept": weights["n"] @ left.T, "removed": gone, "redundant": weights["n"] @ late.T, "unique_fails": weights["n"][:, 1 << filters],
            "good_lost": weights["good"] @ removed.T, "toxic_lost": weights["toxic"] @ removed.T, "shapley": by_filter[:, filters]}
        yield pa.RecordBatch.from_pydict({
            "part": pa.array(parts.slice(lo, hi - lo).to_numpy(zero_copy_only=False).repeat(len(filters)), pa.string()),
            "filter_order": pa.array(np.tile(order_names, hi - lo)), "step": pa.array(np.tile(at, (hi - lo) * len(orders)).astype(np.int32)),
            **{c: pa.array(v.ravel().astype(np.int64)) for c, v in columns.items()}})


RESULT = ("part string, filter_order string, step int, kept long, removed long, redundant long, unique_fails long, "
          "good_lost long, toxic_lost long, shapley long")


def interactions(counts: DataFrame, names: str = FILTERS) -> DataFrame:
    """The audit table from (part, mask, n, good, toxic): one row per part, order of ``names`` and step.

    A part is one row of at most ``2 ** len(names)`` masks; the tables of all orders are worked out where it lies. The
    result has ``len(names) * factorial(len(names))`` rows a part, which bounds how many filters are of use.
    """
    packed = counts.groupBy("part").agg(F.collect_list(F.struct("mask", "n", "good", "toxic")).alias("counts"))

    def tables(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield from _tables(b, names)
    return packed.mapInArrow(tables, RESULT)


def audit(docs: DataFrame, labels: DataFrame, doc_id: str = "doc_id", text: str = "text", part: str = "source") -> DataFrame:
    """Counts per part, order and step: see ``RESULT``.

    Null text is the empty text and equal to it; a null part is the empty string. A row without an id is no copy of
    others and makes none of them a copy; it has no label. Rows that repeat an id and text are all counted, none of
    them a copy of the other; ids with several labels count as labelled if one of them says so. Nulls in labels say
    nothing. Other columns are not read. An empty table gives no rows.
    """
    return interactions(mask_counts(docs, labels, doc_id, text, part))
