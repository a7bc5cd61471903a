"""Links between texts whose sets of five-word shingles have a Jaccard similarity of 0.8 or more.

1. A text becomes the set of its shingles' hashes; equal sets are one node. MinHash bands of a set are its keys: two
   sets of similarity s share one with probability 1 - (1 - s ** ROWS) ** BANDS, at 0.8 that is 0.99995.
2. Sets that share a key are tied to the smallest of its sets; the components of these ties are clusters. Pairs that
   share a key are always in one cluster, so no bucket is compared pair by pair.
3. Texts of a cluster meet in blocks, every two blocks once. The similarity is counted exactly on their shingles, and
   a breadth-first forest connects what all links of the two blocks connect.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from leadloom.llm.components import components
from leadloom.llm.shared import checkpointed, sent_if_small, stored
from leadloom.llm.words import blocks, gram_hashes, hashes, mix, spans

SHINGLE = 5
#: Similarity from which texts are linked, as a fraction.
SIMILAR = (4, 5)
BANDS, ROWS = 25, 5
#: Texts of a block.
BLOCK = 256

_LOWER = np.array([b + 32 if 0x41 <= b <= 0x5A else b for b in range(256)], np.uint8)
_RANDOM = np.random.RandomState(11).randint(1, 1 << 62, (2, BANDS * ROWS), dtype=np.int64).astype(np.uint64)
_FACTORS, _ADDED = _RANDOM[0] * np.uint64(2) + np.uint64(1), _RANDOM[1]
SKETCH = "struct<set: long, keys: array<long>>"


def shingles(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(text, shingle) of the distinct shingles of each text, in order of the text; a text of fewer words is one shingle."""
    data = _LOWER[data]
    starts, ends, first = spans(data, offsets)
    h = hashes(data, starts, ends)
    n = np.diff(first)
    text = np.repeat(np.arange(len(n)), n)
    grams = gram_hashes(h, SHINGLE)
    whole = np.flatnonzero(np.arange(len(grams)) + SHINGLE <= first[text[:len(grams)] + 1])
    few = np.flatnonzero((n > 0) & (n < SHINGLE))
    short = [gram_hashes(h[first[i]:first[i + 1]], int(n[i])) for i in few.tolist()]
    owner, gram = np.concatenate([text[whole], few]), np.concatenate([grams[whole], *short])
    order = np.lexsort((gram, owner))
    owner, gram = owner[order], gram[order]
    new = np.ones(len(gram), bool)
    new[1:] = (owner[1:] != owner[:-1]) | (gram[1:] != gram[:-1])
    return owner[new], gram[new]


def _sketches(texts: pa.Array) -> pa.Array:
    sets = np.zeros(len(texts), np.int64)
    keys, some = [np.zeros((0, BANDS), np.int64)], np.zeros(len(texts), bool)
    with np.errstate(over="ignore"):
        for lo, data, offsets in blocks(texts):
            owner, gram = shingles(data, offsets)
            if not len(owner):
                continue
            at = np.flatnonzero(np.append(True, owner[1:] != owner[:-1]))
            sets[lo + owner[at]] = mix(np.add.reduceat(mix(gram), at)).view(np.int64)
            some[lo + owner[at]] = True
            own = np.zeros((len(at), BANDS), np.uint64)
            for j in range(BANDS * ROWS):
                low = np.minimum.reduceat(gram * _FACTORS[j] + _ADDED[j], at)
                own[:, j // ROWS] = mix(own[:, j // ROWS] * np.uint64(0xD6E8FEB86659FD93) + low + np.uint64(j // ROWS))
            keys.append(own.view(np.int64))
    offsets = np.concatenate([[0], np.cumsum(some * BANDS)]).astype(np.int32)
    flat = pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.concatenate(keys).ravel()))
    return pa.StructArray.from_arrays([pa.array(sets), flat], ["set", "keys"])


def sketches(text: Column) -> Column:
    """The number of the text's set of shingles and its keys; no keys for null and texts without words."""
    return F.arrow_udf(_sketches, SKETCH)(text)


def _forest(table: pa.Table) -> pa.Table:
    texts = table["text"].combine_chunks()
    node, owners, grams = table["node"].to_numpy(), [], []
    for lo, data, offsets in blocks(texts):
        owner, gram = shingles(data, offsets)
        owners.append(owner + lo), grams.append(gram)
    owner, code = np.concatenate(owners), np.unique(np.concatenate(grams), return_inverse=True)[1]
    first = np.searchsorted(owner, np.arange(len(node) + 1))
    size = np.diff(first)
    left, member = np.ones(len(node), bool), np.zeros(len(code) + 1, bool)
    a, b = [], []
    for begin in range(len(node)):
        if not left[begin]:
            continue
        left[begin], queue = False, [begin]
        while queue and left.any():
            at = queue.pop()
            own = code[first[at]:first[at + 1]]
            member[own] = True
            both = np.bincount(owner[member[code]], minlength=len(node))
            member[own] = False
            near = np.flatnonzero(left & (SIMILAR[1] * both >= SIMILAR[0] * (size + size[at] - both)))
            left[near] = False
            a.append(np.full(len(near), node[at])), b.append(node[near])
            queue.extend(near.tolist())
    none = np.zeros(0, np.int64)
    return pa.table({"a": np.concatenate([none, *a]), "b": np.concatenate([none, *b])})


def links(docs: DataFrame, text: str, marked: DataFrame, block: int = BLOCK, doc_id: str | None = None) -> DataFrame:
    """(a, b) between nodes: enough links to connect all nodes whose texts are similar.

    ``marked`` has for each row of ``docs`` its node (long), its sketch ``s`` and ``key``, the xxhash64 of its text.
    With ``doc_id``, which ``marked`` then has under that name as doc_id, the row that gives a set its text is chosen
    here by id and key, so that no other copy of the text moves; without it copies meet by key.
    """
    ids = [F.col("doc_id").alias("id")] if doc_id else []
    row = F.min(F.struct(*[i.isNull().alias("none") for i in ids], *ids, "key")).alias("row")
    sets = checkpointed(marked.filter("size(s.keys) > 0").groupBy(F.col("s.set").alias("set")).agg(
        F.min("node").alias("node"), row, F.first("s.keys").alias("keys")))
    equal = marked.filter("size(s.keys) > 0").select(F.col("node").alias("a"), F.col("s.set").alias("set")).distinct()
    equal = equal.join(sets.select("set", F.col("node").alias("b")), "set").filter("a != b").select("a", "b")
    banded = sets.select("set", F.explode("keys").alias("band"))
    heads = banded.groupBy("band").agg(F.min("set").alias("head"), F.max("set").alias("other")).filter("head < other").select("band", "head")
    ties = banded.join(heads, "band").filter("set > head").select(F.col("set").alias("a"), F.col("head").alias("b")).distinct()
    clusters = stored(components(ties), "clusters")
    sizes = clusters.groupBy("root").agg(F.ceil(F.count("*") / block).cast("int").alias("n"))
    chosen = sets.select(F.col("set").alias("member"), F.col("node").alias("own"), "row")
    known = clusters.join(sizes, "root").join(chosen, F.col("node") == F.col("member"))
    at = F.pmod(F.xxhash64("member"), F.col("n")).cast("int").alias("at")
    known = sent_if_small(known.select("root", "n", F.col("own").alias("node"), "row.*", at))
    rows = docs.select(F.xxhash64(F.col(text)).alias("hash"), F.col(text).alias("text"), *[F.col(doc_id).alias("own_id") for _ in ids])
    same = F.col("hash") == F.col("key")
    found = rows.join(known, same & F.col("own_id").eqNullSafe(F.col("id")) if ids else same).dropDuplicates(["key"])
    dealt = found.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("n") - 1)))
    dealt = dealt.select("root", "node", "text", F.least("at", "other").alias("x"), F.greatest("at", "other").alias("y"))
    return equal.unionByName(dealt.groupBy("root", "x", "y").applyInArrow(_forest, "a long, b long"))
