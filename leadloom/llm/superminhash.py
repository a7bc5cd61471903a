"""Near-duplicate groups by SuperMinHash signatures, banding, exact verification and union-find.

1. A text is the set of its five-word shingles. Equal sets are one node from here on, so exact copies cost nothing more.
2. SuperMinHash: every shingle draws a random permutation of the slots, one slot a step; step j offers the value
   j + (a fraction) to its slot, which keeps the lowest. Slots of a set are so correlated that their estimate varies
   less than that of independent MinHashes. Once all slots of a set are below j, later steps cannot lower any.
3. Sets that agree on a band are candidates. A bucket is never compared pair by pair: in a first round each bucket
   offers its smallest set as head, the others are verified against it, and sets that became one component are not
   compared again. What is left undecided meets in blocks, each two blocks once, with a union-find in the task.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from leadloom.llm.components import components
from leadloom.llm.shared import checkpointed, sent_if_small, stored
from leadloom.llm.similar import shingles
from leadloom.llm.words import blocks, mix
from leadloom.operators.skew import lookup_per_key

#: Similarity from which documents are linked, as a fraction.
SIMILAR = (85, 100)
#: Sets at the limit share no band with probability (1 - 0.85 ** ROWS) ** BANDS, some 4 in ten million.
BANDS, ROWS = 25, 5
SLOTS = BANDS * ROWS
#: Pairs that agree on fewer slots are not verified; at the limit that happens once in 3e10 pairs.
MIN_SLOTS = 75
#: Rounds in which buckets offer heads; sets verified in one task; sets of a block of what is left.
HEAD_ROUNDS, BATCH, BLOCK = 1, 128, 512

_STEP = np.uint64(0x9E3779B97F4A7C15)
_UNSET = np.uint64(SLOTS << 56)
SKETCH = "struct<set: binary, n: int, slots: binary, bands: array<long>>"


def signatures(owner: np.ndarray, gram: np.ndarray, n: int) -> np.ndarray:
    """SuperMinHash of sets 0..n-1, given as (owner, element): one row of slots each, step in the top byte."""
    h = np.full(n * SLOTS, _UNSET, np.uint64)
    places = None  # the permutation of each element that is still at work, as far as it is drawn
    with np.errstate(over="ignore"):
        for j in range(SLOTS):
            draw = mix(gram + np.uint64(2 * j + 1) * _STEP)
            value = (mix(gram + np.uint64(2 * j + 2) * _STEP) >> np.uint64(8)) | np.uint64(j << 56)
            k = j + (draw % np.uint64(SLOTS - j)).astype(np.int64)
            if places is None:
                slot = k
            else:
                row = np.arange(len(gram))
                slot = places[row, k].astype(np.int64)
                places[row, k], places[row, j] = places[row, j], slot
            np.minimum.at(h, owner * SLOTS + slot, value)
            left = (h.reshape(n, SLOTS).max(axis=1) >= np.uint64((j + 1) << 56))[owner]
            if not left.any():
                break
            if places is None:
                places = np.repeat(np.arange(SLOTS, dtype=np.uint8)[None], np.count_nonzero(left), axis=0)
                row = np.arange(len(places))
                places[row, k[left]], places[row, 0] = 0, k[left]
            elif not left.all():
                places = places[left]
            owner, gram = owner[left], gram[left]
    return h.reshape(n, SLOTS)


def _sketches(texts: pa.Array) -> pa.Array:
    size = np.zeros(len(texts), np.int32)
    some = np.zeros(len(texts), bool)
    ids, slots, bands = [np.zeros((0, 2), np.uint64)], [np.zeros((0, SLOTS), np.uint8)], [np.zeros((0, BANDS), np.uint64)]
    with np.errstate(over="ignore"):
        for lo, data, offsets in blocks(texts):
            owner, gram = shingles(data, offsets)
            if not len(owner):
                continue
            at = np.flatnonzero(np.append(True, owner[1:] != owner[:-1]))
            some[lo + owner[at]] = True
            size[lo + owner[at]] = np.diff(np.append(at, len(owner)))
            ids.append(np.stack([mix(np.add.reduceat(mix(gram + np.uint64(c) * _STEP), at)) for c in (0, 1)], axis=1))
            h = signatures(np.cumsum(np.append(True, owner[1:] != owner[:-1])) - 1, gram, len(at))
            slots.append(h.astype(np.uint8))
            key = np.zeros((len(at), BANDS), np.uint64)
            for r in range(ROWS):
                key = mix(key * np.uint64(0xD6E8FEB86659FD93) + h[:, r::ROWS])
            bands.append(mix(key + np.arange(BANDS, dtype=np.uint64)))
    given = np.concatenate([[0], np.cumsum(some)])

    def fixed(rows: np.ndarray) -> pa.Array:
        width = rows.shape[1] * rows.itemsize
        ends = (given * width).astype(np.int32)
        valid = pa.py_buffer(np.packbits(some, bitorder="little").tobytes())
        return pa.Array.from_buffers(pa.binary(), len(texts), [valid, pa.py_buffer(ends.tobytes()), pa.py_buffer(rows.tobytes())])
    keys = pa.ListArray.from_arrays(pa.array((given * BANDS).astype(np.int32)), pa.array(np.concatenate(bands).view(np.int64).ravel()))
    return pa.StructArray.from_arrays([fixed(np.concatenate(ids)), pa.array(size), fixed(np.concatenate(slots)), keys], ["set", "n", "slots", "bands"])


def sketches(text: Column) -> Column:
    """Set number, size, slots (their low bytes) and band keys; a text without words has no set."""
    return F.arrow_udf(_sketches, SKETCH)(text)


def _close(a: Column, b: Column) -> Column:
    """Whether two sets (n, slots) may be similar."""
    @F.arrow_udf("int")
    def agreeing(x: pa.Array, y: pa.Array) -> pa.Array:
        rows = [np.frombuffer(b"".join(v.as_buffer().to_pybytes() for v in z), np.uint8).reshape(len(z), SLOTS) for z in (x, y)]
        return pa.array((rows[0] == rows[1]).sum(axis=1).astype(np.int32))
    fits = SIMILAR[1] * F.least(a["n"], b["n"]) >= SIMILAR[0] * F.greatest(a["n"], b["n"])
    return fits & (agreeing(a["slots"], b["slots"]) >= MIN_SLOTS)


def _candidates(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """The pairs (head, set) that sizes and slots do not rule out. Slots join the pairs, they do not go through buckets."""
    slots = sets.select("set", F.struct("n", "slots").alias("sketch"))
    heads = slots.join(pairs.select(F.col("head").alias("set")).distinct(), "set")
    both = slots.join(pairs, "set").withColumnRenamed("sketch", "own").join(heads.withColumnRenamed("set", "head"), "head")
    return stored(both.filter(_close(F.col("own"), F.col("sketch"))).select("head", "set"), "pairs")


def _texts(table: pa.Table) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Shingles of the table's texts as numbers from 0, where each text's begin, and how many it has."""
    owners, grams = [np.zeros(0, np.int64)], [np.zeros(0, np.uint64)]
    for lo, data, offsets in blocks(table["text"].combine_chunks()):
        owner, gram = shingles(data, offsets)
        owners.append(owner + lo), grams.append(gram)
    owner = np.concatenate(owners)
    code = np.unique(np.concatenate(grams), return_inverse=True)[1]
    first = np.searchsorted(owner, np.arange(table.num_rows + 1))
    return owner, code, first


def _near(at: int, owner: np.ndarray, code: np.ndarray, first: np.ndarray, member: np.ndarray) -> np.ndarray:
    """Of which texts the one at ``at`` is similar to."""
    size = np.diff(first)
    member[code[first[at]:first[at + 1]]] = True
    both = np.bincount(owner[member[code]], minlength=len(size))
    member[code[first[at]:first[at + 1]]] = False
    return SIMILAR[1] * both >= SIMILAR[0] * (size + size[at] - both)


LINK = pa.schema([("a", pa.binary()), ("b", pa.binary())])


def _verified(table: pa.Table) -> pa.Table:
    """Links of the head (its row has no ``b``) to the sets of its batch."""
    owner, code, first = _texts(table)
    head = table["b"].combine_chunks().is_null().to_numpy(zero_copy_only=False)
    near = _near(int(np.flatnonzero(head)[0]), owner, code, first, np.zeros(len(code) + 1, bool)) & ~head
    return table.select(["a", "b"]).filter(pa.array(near)).cast(LINK)


def _connected(table: pa.Table) -> pa.Table:
    """Links that connect what all links between the sets of two blocks connect; sets of one root are one from the start."""
    owner, code, first = _texts(table)
    node = table["node"].to_pylist()
    root = np.unique(np.array([r.hex() for r in table["root"].to_pylist()]), return_inverse=True)[1]
    left, member = np.ones(len(node), bool), np.zeros(len(code) + 1, bool)
    a, b = [], []
    while left.any():
        queue = np.flatnonzero(left & (root == root[np.argmax(left)])).tolist()
        left[queue] = False
        while queue and left.any():
            at = queue.pop()
            near = np.flatnonzero(left & _near(at, owner, code, first, member))
            a += [node[at]] * len(near)
            b += [node[i] for i in near.tolist()]
            reached = np.flatnonzero(left & np.isin(root, root[near]))
            left[reached] = False
            queue += reached.tolist()
    return pa.table({"a": a, "b": b}, schema=LINK)


def _verify(pairs: DataFrame, texts: DataFrame) -> DataFrame:
    """The pairs (head, set) that are similar as (a, b). A head's text goes once to each ``BATCH`` of its sets."""
    n = pairs.groupBy("head").agg(F.ceil(F.count("*") / BATCH).cast("int").alias("batches"))
    dealt = pairs.join(n, "head").select("head", "set", F.pmod(F.xxhash64("set"), F.col("batches")).cast("int").alias("batch"))
    own = dealt.join(texts, "set").select(F.col("head").alias("a"), "batch", F.col("set").alias("b"), "text")
    heads = dealt.select(F.col("head").alias("set"), "batch").distinct().join(texts, "set").select(
        F.col("set").alias("a"), "batch", F.lit(None).cast("binary").alias("b"), "text")
    return own.unionByName(heads).groupBy("a", "batch").applyInArrow(_verified, "a binary, b binary")


def _labelled(rows: DataFrame, links: DataFrame) -> DataFrame:
    """``rows`` (set) with a root: the smallest head each set is linked to, or itself.

    Sets of one root are connected; that is all that is needed to spare comparisons, so no components are worked out.
    """
    heads = links.groupBy(F.col("b").alias("set")).agg(F.min("a").alias("root"))
    return rows.join(heads, "set", "left").withColumn("root", F.coalesce("root", "set"))


def links(docs: DataFrame, doc_id: str, text: str, sets: DataFrame, rounds: int = HEAD_ROUNDS, block: int = BLOCK) -> DataFrame:
    """(a, b) between sets: similar pairs, enough to connect all sets that similar pairs connect.

    ``sets`` has set, n, slots, bands and ``row``, the (doc_id, xxhash64 of the text) of a row with that set.
    """
    banded = sets.select("set", F.explode("bands").alias("band"))
    crowds = sent_if_small(banded.groupBy("band").agg(F.count("*").alias("held")).filter("held > 1").select("band"))
    shared = stored(banded.join(crowds, "band"), "buckets").withColumn("root", F.col("set"))
    wanted = sent_if_small(shared.select("set").distinct().join(sets.select("set", "row.id", "row.key"), "set"))
    rows = docs.select(F.col(doc_id).alias("own"), F.xxhash64(F.col(text)).alias("hash"), F.col(text).alias("text"))
    one = rows.join(wanted, (F.col("hash") == F.col("key")) & F.col("own").eqNullSafe(F.col("id")))  # copies do not meet
    texts = stored(one.dropDuplicates(["set"]).select("set", "text"), "texts")
    found = docs.sparkSession.createDataFrame([], "a binary, b binary")
    tested = docs.sparkSession.createDataFrame([], "head binary, set binary")
    for _ in range(rounds):
        head = F.min(F.struct("set", "root")).alias("head")
        open_ = shared.groupBy("band").agg(head, F.min("root").alias("low"), F.max("root").alias("high")).filter("low < high").select("band", "head")
        left = stored(shared.join(open_, "band").filter("set <> head.set"), "left")
        pairs = left.filter(F.col("root") != F.col("head.root")).select(F.col("head.set").alias("head"), "set").distinct()
        pairs = _candidates(sent_if_small(pairs.join(tested, ["head", "set"], "left_anti")), sets)
        tested = tested.unionByName(pairs)
        found = stored(found.unionByName(_verify(pairs, texts)), "links")
        shared = stored(_labelled(left.select("band", "set"), found), "buckets")
        if shared.isEmpty():
            break
    head = F.min("set").alias("head")
    open_ = shared.groupBy("band").agg(head, F.min("root").alias("low"), F.max("root").alias("high")).filter("low < high").select("band", "head")
    ties = shared.join(open_, "band").filter("set <> head").select(F.col("set").alias("a"), F.col("head").alias("b")).distinct()
    clusters = stored(components(ties).select(F.col("node").alias("set"), F.col("root").alias("cluster")), "clusters")
    if clusters.isEmpty():
        return found
    sizes = clusters.groupBy("cluster").agg(F.ceil(F.count("*") / block).cast("int").alias("blocks"))
    known = _labelled(clusters, found).join(sizes, "cluster").join(texts, "set")
    at = F.pmod(F.xxhash64("set"), F.col("blocks")).cast("int")
    dealt = known.withColumn("at", at).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    dealt = dealt.select("cluster", F.col("set").alias("node"), "root", "text", F.least("at", "other").alias("x"), F.greatest("at", "other").alias("y"))
    return found.unionByName(dealt.groupBy("cluster", "x", "y").applyInArrow(_connected, "a binary, b binary"))


def near_duplicates(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", rounds: int = HEAD_ROUNDS, block: int = BLOCK) -> DataFrame:
    """(doc_id, n_shingles, component_id, kept) for each row of ``docs``.

    Null, empty and blank texts have no shingles, are linked with nothing and are their own component. Repeated rows
    come out as often as they go in; rows of one id with different texts are judged apart. Null ids stay null and are
    no candidate for component_id, unless the whole component has none; then its rows are all kept. Other columns are
    not read. An empty table gives no rows.
    """
    marked = checkpointed(docs.select(
        F.col(doc_id).alias("doc_id"), F.xxhash64(F.col(text)).alias("key"), sketches(F.col(text)).alias("s")).select(
        "doc_id", "key", "s.*"))
    row = F.min(F.struct(F.col("doc_id").isNull().alias("none"), F.col("doc_id").alias("id"), "key")).alias("row")
    sets = stored(marked.filter("set IS NOT NULL").groupBy("set").agg(row, *[F.first(c).alias(c) for c in ("n", "slots", "bands")]), "sets")
    near = stored(components(links(docs, doc_id, text, sets, rounds, block)), "roots")
    linked = sets.select("set", F.col("row.id").alias("low")).join(near.withColumnRenamed("node", "set"), "set")
    lowest = linked.groupBy("root").agg(F.min("low").alias("lowest"))
    grouped = linked.join(lowest, "root").select("set", "lowest")
    heads = stored(sets.select("set", F.col("row.id").alias("low")).join(grouped, "set", "left").select("set", F.coalesce("lowest", "low").alias("component")), "heads")
    out = lookup_per_key(marked.select("doc_id", "n", "set"), heads, ["set"])
    component = F.when(F.col("set").isNull(), F.col("doc_id")).otherwise(F.col("component"))
    out = out.select("doc_id", F.col("n").cast("long").alias("n_shingles"), component.alias("component_id"))
    return out.withColumn("kept", F.col("doc_id").eqNullSafe(F.col("component_id")))
