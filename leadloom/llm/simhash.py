"""Near-duplicate groups by SimHash fingerprints, linked by deletion variants of their segments."""

from __future__ import annotations

from itertools import repeat

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, functions as F

from leadloom.llm import similar
from leadloom.llm.components import components
from leadloom.llm.shared import checkpointed, small_batches, stored, unused
from leadloom.operators.skew import lookup_per_key

SHINGLE, SEED, BITS = 4, 42, 64
HASHES_AT_ONCE = 1 << 15

#: Fingerprints link at this many differing bits or fewer.
MAX_BITS = 4
#: (lowest bit, width). With three segments, one of them holds at most one of four differing bits.
SEGMENTS = ((0, 22), (22, 21), (43, 21))
#: Fingerprints of one variant beyond which they are compared block by block, each block pair giving a forest only.
CROWD = 2048


def fingerprint(text: bytes) -> int:
    """SimHash of one text: a bit is 1 if it is set in over half of the hashes of its word shingles, repeats included."""
    words = text.lower().split()
    if not words:
        return 0
    joined = b" ".join(words)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    starts = np.concatenate([[0], ends[:-1] + 1])
    width = min(SHINGLE, len(words))
    lo, hi = starts[:len(words) - width + 1].tolist(), ends[width - 1:].tolist()
    ones = np.zeros(BITS, np.int64)
    for i in range(0, len(lo), HASHES_AT_ONCE):
        pieces = map(joined.__getitem__, map(slice, lo[i:i + HASHES_AT_ONCE], hi[i:i + HASHES_AT_ONCE]))
        h = np.fromiter(map(xxhash.xxh64_intdigest, pieces, repeat(SEED)), np.uint64)
        ones += np.unpackbits(h.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * ones > len(lo), bitorder="little").tobytes(), "little")


def fingerprints(text: Column) -> Column:
    """Fingerprint as a signed long; null and texts without words give 0."""
    @F.arrow_udf("long")
    def of(texts: pa.Array) -> pa.Array:
        found = (fingerprint(t.as_buffer().to_pybytes()) if t.is_valid else 0 for t in texts)
        return pa.array(np.fromiter(found, np.uint64, len(texts)).view(np.int64))
    return of(text)


def _segment_bits(x: Column, low: int, width: int) -> Column:
    return F.shiftrightunsigned(x, low).bitwiseAND(F.lit((1 << width) - 1))


def variants(fp: Column) -> Column:
    """One key per bit: its segment without that bit, with the number of the bit above."""
    keys = []
    for low, width in SEGMENTS:
        for i in range(width):
            rest = F.lit(((1 << width) - 1) & ~(1 << i))
            keys.append(_segment_bits(fp, low, width).bitwiseAND(rest).bitwiseOR(F.lit((low + i) << 22)))
    return F.array(*keys)


def _linked(a: Column, b: Column) -> Column:
    return F.bit_count(a.bitwiseXOR(b)) <= MAX_BITS


def _first_shared(a: Column, b: Column) -> Column:
    """Number of the lowest bit whose variant two linked fingerprints share, so that each pair comes out once."""
    out = F.lit(None).cast("long")
    for low, width in reversed(SEGMENTS):
        x = _segment_bits(a.bitwiseXOR(b), low, width)
        lowest = F.when(x == 0, F.lit(low)).otherwise(F.bit_count(x - 1) + low)
        out = F.when(F.bit_count(x) <= 1, lowest).otherwise(out)
    return out


def _forest(fps: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Edges that connect the given fingerprints exactly as all links between them do: a breadth-first forest."""
    left = np.arange(len(fps))
    a, b = [], []
    while len(left):
        queue, left = [left[0]], left[1:]
        while queue and len(left):
            at = queue.pop()
            near = np.bitwise_count(fps[left] ^ fps[at]) <= MAX_BITS
            found, left = left[near], left[~near]
            a.append(np.full(len(found), fps[at])), b.append(fps[found])
            queue.extend(found.tolist())
    none = np.zeros(0, fps.dtype)
    return np.concatenate([none, *a]), np.concatenate([none, *b])


def _crowded_links(crowded: DataFrame, crowd: int) -> DataFrame:
    """Links within variants of more than ``crowd`` fingerprints.

    Their fingerprints are dealt into blocks of about ``crowd``; a task holds two blocks, and every two blocks of a
    variant meet once, so no task depends on how many share the variant.
    """
    n_blocks = F.ceil(F.col("n") / crowd).cast("int")
    block = F.pmod(F.xxhash64("fp"), n_blocks).cast("int")
    dealt = crowded.withColumn("block", block).select("key", "fp", "block", F.explode(F.sequence(F.lit(0), n_blocks - 1)).alias("other"))
    dealt = dealt.select("key", "fp", F.least("block", "other").alias("x"), F.greatest("block", "other").alias("y"))

    def links(table: pa.Table) -> pa.Table:
        a, b = _forest(table["fp"].to_numpy().view(np.uint64))
        return pa.table({"a": a.view(np.int64), "b": b.view(np.int64)})
    return dealt.groupBy("key", "x", "y").applyInArrow(links, "a long, b long")


def links(fps: DataFrame, crowd: int = CROWD) -> DataFrame:
    """(a, b) between distinct fingerprints (column fp): enough links of at most ``MAX_BITS`` bits to connect all that
    are connected; every link but for crowded variants."""
    keyed = fps.select("fp", F.explode(variants(F.col("fp"))).alias("key"))
    crowds = stored(keyed.groupBy("key").agg(F.count("*").alias("n")).filter(F.col("n") > crowd), "crowds")
    few, many = keyed, None
    if not crowds.isEmpty():
        few, many = keyed.join(crowds, "key", "left_anti"), _crowded_links(keyed.join(crowds, "key"), crowd)
    a, b = few.select("key", F.col("fp").alias("a")), few.select("key", F.col("fp").alias("b"))
    pairs = a.join(b, "key").filter((F.col("a") < F.col("b")) & _linked(F.col("a"), F.col("b"))
                                    & (F.shiftright("key", 22) == _first_shared(F.col("a"), F.col("b")))).select("a", "b")
    return pairs.unionByName(many) if many else pairs


def _groups(marked: DataFrame, crowd: int, more: DataFrame | None = None) -> DataFrame:
    """(fp, group, component_id) of each distinct fingerprint of ``marked`` (doc_id, fp), with ``more`` links if given."""
    distinct = checkpointed(marked.groupBy("fp").agg(F.min("doc_id").alias("low")))
    edges = links(distinct.select("fp"), crowd)
    roots = checkpointed(components(edges.unionByName(more) if more is not None else edges))
    linked = stored(distinct.join(roots, distinct["fp"] == roots["node"]).select("fp", "root", "low"), "linked")
    lowest = stored(linked.groupBy("root").agg(F.min("low").alias("lowest")), "lowest")
    better = lookup_per_key(linked.select("fp", "root"), lowest, ["root"])  # a component may hold a third of all
    return stored(distinct.join(better, "fp", "left").select(
        "fp", F.coalesce("root", "fp").alias("group"), F.coalesce("lowest", "low").alias("component_id")), "groups")


def near_duplicates(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", crowd: int = CROWD) -> DataFrame:
    """(doc_id, fingerprint, component_id) for each row of ``docs``.

    component_id is the smallest doc_id reachable over links of fingerprints. Null, empty and blank texts have
    fingerprint zero and are linked with each other. Repeated rows come out as often as they go in. Null ids stay null
    and are no candidate for component_id, unless the whole component has none. An empty table gives no rows; other
    columns are not read.
    """
    with small_batches(docs.sparkSession):
        marked = checkpointed(docs.select(F.col(doc_id).alias("doc_id"), fingerprints(F.col(text)).alias("fp")))
    return lookup_per_key(marked, _groups(marked, crowd).select("fp", "component_id"), ["fp"]).select(
        "doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def one_per_group(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", shingled: bool = False) -> DataFrame:
    """``docs`` with one row of each group, of its smallest doc_id; rows that repeat a doc_id in another group stay.

    A row without a doc_id stays if nothing with an id is in its group, one for each such group. With ``shingled``,
    texts of Jaccard similarity 0.8 or more on five-word shingles are linked too.
    """
    head, key, own = unused(docs, "__head", "__key", "__own")
    sketch = [similar.sketches(F.col(text)).alias("s")] if shingled else []
    with small_batches(docs.sparkSession):
        marked = checkpointed(docs.select(
            F.col(doc_id).alias("doc_id"), fingerprints(F.col(text)).alias("fp"), F.xxhash64(F.col(text)).alias("key"), *sketch))
    more = similar.links(docs, text, marked.withColumnRenamed("fp", "node"), doc_id=doc_id) if shingled else None
    first = F.min(F.struct(F.col("doc_id").isNull().alias("missing"), "doc_id", "key")).alias("h")
    own_heads = marked.groupBy("fp").agg(first)  # one row per fingerprint, however many copies share it
    heads = own_heads.join(_groups(marked, CROWD, more).select("fp", "group"), "fp").groupBy("group").agg(F.min("h").alias("h"))
    heads = heads.select(F.col("h.doc_id").alias(head), F.col("h.key").alias(key))
    keyed = docs.withColumn(own, F.xxhash64(F.col(text)))
    chosen = keyed.join(heads, keyed[doc_id].eqNullSafe(F.col(head)) & (F.col(own) == F.col(key)), "left_semi")
    return chosen.dropDuplicates([doc_id, own]).drop(own)
