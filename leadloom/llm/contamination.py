"""Benchmark passages in documents, found by one scan with an Aho-Corasick automaton."""

from __future__ import annotations

import hashlib
from collections import defaultdict
from functools import reduce

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from leadloom.llm.words import spans

#: Consecutive words of an item that make a hit.
WINDOW = 13
#: Share of hit words, as one in so many, from which a document is contaminated.
ONE_IN = 20
#: Bytes of item text per automaton; larger benchmarks are scanned for with several, one after another.
ITEM_BYTES = 16 << 20

#: Words are ``[^\x00-\x2F\x3A-\x60\x7B-\x7F]+`` after A-Z are lower-cased.
SEPARATOR = np.array([b <= 0x2F or 0x3A <= b <= 0x40 or 0x5B <= b <= 0x60 or 0x7B <= b <= 0x7F for b in range(256)])
_PLAIN = bytes(0x20 if SEPARATOR[b] else b + 32 if 0x41 <= b <= 0x5A else b for b in range(256))

HIT = "struct<item_id: string, first_word: int, end_word: int, first_byte: long, end_byte: long>"


def normal_words(text: bytes) -> list[bytes]:
    return text.translate(_PLAIN).split()


def windows(text: bytes) -> list[bytes]:
    """The passages of an item: 13 words each, or all words of a shorter one."""
    words = normal_words(text)
    return [b" ".join(words[i:i + WINDOW]) for i in range(max(1, len(words) - WINDOW + 1))] if words else []


def _by_id(item_id: str | None) -> tuple[bool, str]:
    return item_id is not None, item_id or ""


class Passages:
    """Automaton over the windows of some items. Built where it is used: tasks receive the items' texts only."""

    def __init__(self, items: list[tuple[str | None, bytes]]):
        self.items, self.automaton = items, None

    def __getstate__(self):
        return {"items": self.items, "automaton": None}

    def build(self) -> None:
        owners: dict[bytes, set[str | None]] = defaultdict(set)
        for item_id, text in self.items:
            for w in windows(text):
                owners[w].add(item_id)
        self.owners = [sorted(ids, key=_by_id) for ids in owners.values()]
        self.lengths = np.array([w.count(b" ") + 1 for w in owners], np.int64)
        self.automaton = ahocorasick.Automaton(ahocorasick.STORE_INTS)
        for k, w in enumerate(owners):
            self.automaton.add_word(f" {w.decode('latin-1')} ", k)
        self.automaton.make_automaton()

    def hits(self, text: bytes) -> list[dict]:
        """Maximal runs of words covered by overlapping windows of one item, with byte offsets in the original text."""
        if self.automaton is None:
            self.build()
        if not self.owners:
            return []
        plain = b" " + b" ".join(normal_words(text)) + b" "
        found = list(self.automaton.iter(plain.decode("latin-1")))
        if not found:
            return []
        blanks = np.flatnonzero(np.frombuffer(plain, np.uint8) == 0x20)
        data = np.frombuffer(text, np.uint8)
        first_byte, end_byte, _ = spans(data, np.array([0, len(data)]), SEPARATOR)
        runs: dict[str | None, list[list[int]]] = {}
        for end, (_, k) in zip(np.searchsorted(blanks, [at for at, _ in found]).tolist(), found):
            start = end - int(self.lengths[k])
            for item in self.owners[k]:
                own = runs.setdefault(item, [])
                if own and start <= own[-1][1]:
                    own[-1][0], own[-1][1] = min(own[-1][0], start), max(own[-1][1], end)
                else:
                    own.append([start, end])
        return [{"item_id": item, "first_word": a, "end_word": b, "first_byte": int(first_byte[a]), "end_byte": int(end_byte[b - 1])}
                for item, own in sorted(runs.items(), key=lambda x: _by_id(x[0])) for a, b in own]


def _bytes(t: pa.Scalar) -> bytes:
    return t.as_buffer().to_pybytes() if t.is_valid else b""


def item_blocks(items: DataFrame, item_id: str, text: str, limit: int) -> list[Passages]:
    """Automata over all items, each of at most ``limit`` bytes of text (or one longer item)."""
    rows = items.select(F.col(item_id).cast("string").alias("i"), F.col(text).cast("binary").alias("t")).dropna(subset=["t"])
    out, size = [[]], 0
    for r in rows.distinct().toLocalIterator():
        if size and size + len(r["t"]) > limit:
            out.append([])
            size = 0
        out[-1].append((r["i"], bytes(r["t"])))
        size += len(r["t"])
    return [Passages(sorted(block, key=lambda x: (x[0] or "", x[1]))) for block in out]


def hits(spark: SparkSession, blocks: list[Passages], text: Column) -> Column:
    """Array of ``HIT``: the benchmark passages in a text, all automata one after another."""
    def scan(block: Passages) -> Column:
        sent = spark.sparkContext.broadcast(block)

        @F.arrow_udf(f"array<{HIT}>")
        def of(texts: pa.Array) -> pa.Array:
            kind = pa.list_(pa.struct([("item_id", pa.string()), ("first_word", pa.int32()), ("end_word", pa.int32()),
                                       ("first_byte", pa.int64()), ("end_byte", pa.int64())]))
            return pa.array([sent.value.hits(_bytes(t)) for t in texts], kind)
        return of(text)
    return reduce(F.concat, [scan(b) for b in blocks])


SUMMARY = "struct<n_words: long, n_hit: long, n_items: long, items_sha256: string>"


def _summarise(texts: pa.Array, found: pa.Array) -> pa.Array:
    out = []
    for t, own in zip(texts, found):
        own = own.as_py() or []
        edges = sorted((h["first_word"], h["end_word"]) for h in own)
        n, end = 0, 0
        for a, b in edges:
            n += max(0, b - max(a, end))
            end = max(end, b)
        ids = sorted({h["item_id"] for h in own} - {None})
        out.append({"n_words": len(normal_words(_bytes(t))), "n_hit": n, "n_items": len(ids),
                    "items_sha256": hashlib.sha256(",".join(ids).encode()).hexdigest()})
    return pa.array(out, pa.struct([("n_words", pa.int64()), ("n_hit", pa.int64()), ("n_items", pa.int64()), ("items_sha256", pa.string())]))


def find_passages(docs: DataFrame, items: DataFrame, doc_id: str = "doc_id", text: str = "text",
                  item_id: str = "item_id", item_text: str = "text", limit: int = ITEM_BYTES) -> DataFrame:
    """(doc_id, hits): where benchmark passages stand in each document, by item, with word and byte offsets.

    Null and empty texts have no hits; items without words are never found. Repeated rows come out as often as they go
    in, repeated items count once. Items without an id are found under a null item_id, all as one item. An empty table
    of items gives empty arrays.
    """
    return docs.select(F.col(doc_id).alias("doc_id"), hits(docs.sparkSession, item_blocks(items, item_id, item_text, limit), F.col(text)).alias("hits"))


def summary(docs: DataFrame, items: DataFrame, text: str = "text", item_id: str = "item_id", item_text: str = "text",
            limit: int = ITEM_BYTES) -> Column:
    """Per text: n_words, n_hit (words inside passages), n_items and the digest of the sorted item ids.

    Passages of items without an id count in n_hit, but a null id is neither in n_items nor in the digest.
    """
    return F.arrow_udf(_summarise, SUMMARY)(F.col(text), hits(docs.sparkSession, item_blocks(items, item_id, item_text, limit), F.col(text)))


def is_contaminated(found: Column) -> Column:
    return (found["n_hit"] > 0) & (found["n_hit"] * ONE_IN >= found["n_words"])


def without_contaminated(docs: DataFrame, items: DataFrame, text: str = "text", **names: str) -> DataFrame:
    """``docs`` without the contaminated rows."""
    return docs.filter(~is_contaminated(summary(docs, items, text, **names)))
