"""Repeated passages of documents, found with an FM-index per shard.

1. Each window of 20 words has an anchor: the run of 8 words with the smallest hash in it. Consecutive windows with the
   anchor at the same place make a segment. Equal windows have equal anchors, and two of them are never in one segment.
2. Anchors are counted; only segments whose anchor occurs again can repeat anything.
3. Segments go to shards by anchor; windows of very frequent anchors are dealt further by their own hash, so that a
   shard stays small however often a passage occurs. Equal segments of a batch are reduced to the first one; the same
   place of a repeated row is dropped.
4. A shard indexes its distinct segments and streams them over the index: backward search of each window gives its
   occurrences. A window that starts earlier elsewhere is reported, and reported intervals go back to their documents.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from math import ceil

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, functions as F

from leadloom.llm.fmindex import FMIndex
from leadloom.llm.shared import stored
from leadloom.llm.words import blocks, gram_hashes, hashes, mix, spans

WINDOW, ANCHOR, STRIDE = 20, 8, 4
#: Segments of one anchor beyond which its windows are dealt to several shards.
CROWD = 2000
#: Segments of a shard, about.
SHARD_SEGMENTS = 20_000

_SEGMENT = "shard int, doc_id long, start int, n int, words binary"
_MARK = "doc_id long, start int, n int, mask int"


def _segments(first: np.ndarray, h: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """First window, number of windows and anchor of each segment; ``first`` is the first word of each text."""
    none = np.zeros(0, np.int64)
    if len(h) < WINDOW:
        return none, none, none
    grams = gram_hashes(h, ANCHOR)
    at = np.lib.stride_tricks.sliding_window_view(grams, WINDOW - ANCHOR + 1).argmin(1) + np.arange(len(h) - WINDOW + 1)
    end = np.repeat(first[1:], np.diff(first))[:len(at)]
    inside = np.arange(len(at)) + WINDOW <= end
    change = np.ones(len(at), bool)
    change[1:] = (at[1:] != at[:-1]) | (end[1:] != end[:-1])
    begin = np.flatnonzero(inside & change)
    last = np.flatnonzero(inside & np.append(change[1:] | ~inside[1:], True))
    return begin, last - begin + 1, grams[at[begin]].view(np.int64)


def _rows(of: str, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        ids = batch["doc_id"].to_numpy(zero_copy_only=False)
        for lo, data, offsets in blocks(batch[of]):
            starts, ends, first = spans(data, offsets)
            begin, n, anchor = _segments(first, hashes(data, starts, ends))
            doc = np.searchsorted(first, begin, "right") - 1
            yield pa.RecordBatch.from_arrays([pa.array(anchor), pa.array(ids[lo + doc]), pa.array((begin - first[doc]).astype(np.int32))], ["anchor", "doc_id", "start"])


def _shards(anchor: np.ndarray, part: np.ndarray, n_shards: int) -> np.ndarray:
    with np.errstate(over="ignore"):
        return (mix(anchor.view(np.uint64) + mix(part.astype(np.uint64) + np.uint64(1))) % np.uint64(n_shards)).astype(np.int32)


def _by_window(h: np.ndarray, at: np.ndarray, size: np.ndarray, parts: np.ndarray) -> tuple[np.ndarray, ...]:
    """Segments cut where the part of their windows, dealt by the windows' own hashes, changes: source, place, size, part."""
    plain = np.flatnonzero(parts == 1)
    cut = [(plain, at[plain], size[plain], np.zeros(len(plain), np.int64))]
    for i in np.flatnonzero(parts > 1):
        own = (gram_hashes(h[at[i]:at[i] + size[i] + WINDOW - 1], WINDOW) % np.uint64(parts[i])).astype(np.int64)
        begin = np.concatenate([[0], np.flatnonzero(np.diff(own)) + 1])
        cut.append((np.full(len(begin), i), at[i] + begin, np.diff(np.append(begin, len(own))), own[begin]))
    return tuple(np.concatenate(c) for c in zip(*cut))


def _cut(n_shards: int, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Segments with repeated anchors: of equal ones the first with its text, the others as done (without)."""
    for batch in batches:
        ids = batch["k"].to_numpy()
        per_text = np.concatenate([[0], np.cumsum(pc.list_value_length(batch["found"]).to_numpy())])
        found = pc.list_flatten(batch["found"])
        start, anchor, parts = (pc.struct_field(found, c).to_numpy() for c in ("start", "anchor", "parts"))
        for lo, data, offsets in blocks(batch["text"]):
            starts, ends, first = spans(data, offsets)
            h = hashes(data, starts, ends)
            begin, size, _ = _segments(first, h)
            own = slice(per_text[lo], per_text[lo + len(offsets) - 1])
            doc = np.repeat(np.arange(len(offsets) - 1), np.diff(per_text[lo:lo + len(offsets)]))
            at = first[doc] + start[own]
            where = np.searchsorted(begin, at)
            real = where < len(begin)
            real[real] = begin[where[real]] == at[real]
            real[real] = at[real] < first[doc[real] + 1]
            doc, at, anchors, many = doc[real], at[real], anchor[own][real], parts[own][real]
            source, place, n, part = _by_window(h, at, size[where[real]], many)
            doc = doc[source]
            order = np.lexsort((place - first[doc], ids[lo + doc]))
            source, place, n, part, doc = source[order], place[order], n[order], part[order], doc[order]
            own_id, own_start = ids[lo + doc], place - first[doc]
            raw, known = data.tobytes(), {}
            texts, of = [], np.zeros(len(place), np.int64)
            for i, (a, b) in enumerate(zip(starts[place].tolist(), ends[place + n + WINDOW - 2].tolist())):
                t = raw[a:b]
                of[i] = known.setdefault(t, i)
                texts.append(t if of[i] == i else None)
            done = of != np.arange(len(of))  # these only pass through, so any shard will do
            same = done & (own_id == own_id[of]) & (own_start == own_start[of])  # the first one's place in a repeated row
            shard = np.where(done, np.arange(len(done)) % n_shards, _shards(anchors[source], part, n_shards)).astype(np.int32)
            cut = pa.RecordBatch.from_arrays(
                [pa.array(shard), pa.array(own_id), pa.array(own_start.astype(np.int32)),
                 pa.array(n.astype(np.int32)), pa.array(texts, pa.binary())], ["shard", "doc_id", "start", "n", "words"])
            yield cut.filter(pa.array(~same)) if same.any() else cut


def _symbols(segments: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Text to index, and the segment and window of each place in it (-1 where no window starts).

    A symbol is a run of ``STRIDE`` words; the runs that start at each of ``STRIDE`` remainders follow one another, so
    a window is WINDOW / STRIDE symbols. Words are compared by their bytes.
    """
    segments = segments.cast(pa.large_binary())
    offsets = np.frombuffer(segments.buffers()[1], np.int64)[segments.offset:segments.offset + len(segments) + 1]
    data = np.frombuffer(segments.buffers()[2], np.uint8)[offsets[0]:offsets[-1]]
    starts, ends, first = spans(data, offsets - offsets[0])
    length = ends - starts
    to = np.concatenate([[0], np.cumsum(length)])
    packed = data[np.arange(to[-1]) + np.repeat(starts - to[:-1], length)]
    words = pa.Array.from_buffers(pa.large_binary(), len(length), [None, pa.py_buffer(to.astype(np.int64)), pa.py_buffer(packed)])
    run = words.dictionary_encode().indices.to_numpy(zero_copy_only=False).astype(np.int64)
    width = 1
    while width < STRIDE:
        run = np.unique(run[:-width] * (int(run.max()) + 1) + run[width:], return_inverse=True)[1]
        width *= 2
    n = np.diff(first)
    segment = np.repeat(np.arange(len(n)), n)
    place = np.arange(len(segment)) - first[segment]
    whole = place + STRIDE <= n[segment]
    segment, place = segment[whole], place[whole]
    symbol = run[np.flatnonzero(whole)] + 1
    order = np.lexsort((place, place % STRIDE, segment))
    segment, place, symbol = segment[order], place[order], symbol[order]
    last = np.append((np.diff(segment) != 0) | (np.diff(place % STRIDE) != 0), True)
    to = np.arange(len(symbol)) + np.concatenate([[0], np.cumsum(last)[:-1]])
    text, owner, window = np.zeros(len(symbol) + last.sum(), np.int64), np.full(len(symbol) + last.sum(), -1), np.full(len(symbol) + last.sum(), -1)
    text[to], owner[to] = symbol, segment
    window[to] = np.where(place + WINDOW <= n[segment], place, -1)
    return text, owner, window


def _index_shard(table: pa.Table) -> pa.Table:
    table = table.combine_chunks()
    done = table.filter(table["words"].is_null())
    rows = table.filter(table["words"].is_valid()).sort_by([("doc_id", "ascending"), ("start", "ascending")])
    doc, start, n = (rows[c].to_numpy() for c in ("doc_id", "start", "n"))
    mask = np.zeros(len(doc), np.int64)
    if len(doc):
        coded = rows["words"].combine_chunks().dictionary_encode()
        code = coded.indices.to_numpy(zero_copy_only=False)
        firsts = np.unique(code, return_index=True)[1]
        text, owner, window = _symbols(coded.dictionary)
        index = FMIndex(text, WINDOW // STRIDE)
        at = np.flatnonzero(window >= 0)
        patterns = text[at[:, None] + np.arange(WINDOW // STRIDE)]
        lo, hi = index.search(patterns)
        of = firsts[owner[at]]
        order = np.lexsort((start[of] + window[at], doc[of]))
        rank = np.full(len(text) + 1, len(text), np.int64)
        rank[at[order]] = np.arange(len(at))
        by_suffix = np.append(rank[index.suffixes], len(text))
        distinct, back = np.unique(lo, return_inverse=True)
        ends = np.zeros(len(distinct), np.int64)
        ends[back] = hi
        earliest = np.minimum.reduceat(by_suffix, np.stack([distinct, ends], 1).ravel())[::2][back]
        where = at[order][earliest]
        key = lambda p: (doc[firsts[owner[p]]], start[firsts[owner[p]]] + window[p])
        (d1, s1), (d2, s2) = key(where), key(at)
        again = (d1 < d2) | ((d1 == d2) & (s1 < s2))
        np.bitwise_or.at(mask, of[again], 1 << window[at[again]])
        later = np.ones(len(doc), bool)
        later[firsts] = False
        same = (doc == doc[firsts[code]]) & (start == start[firsts[code]])
        mask[later & ~same] = (1 << n[later & ~same]) - 1
    full = (1 << done["n"].to_numpy().astype(np.int64)) - 1
    marks = np.concatenate([mask, full])
    keep = marks != 0
    column = lambda c, own: pa.array(np.concatenate([own, done[c].to_numpy()])[keep])
    return pa.table({"doc_id": column("doc_id", doc), "start": column("start", start), "n": column("n", n), "mask": pa.array(marks[keep].astype(np.int32))})


def _removed(n_words: int, marks: list[dict]) -> np.ndarray:
    edges = np.zeros(n_words + 1, np.int64)
    for m in marks:
        for j in range(m["n"]):
            if m["mask"] >> j & 1 and m["start"] + j + WINDOW <= n_words:
                edges[m["start"] + j] += 1
                edges[m["start"] + j + WINDOW] -= 1
    return np.cumsum(edges)[:n_words] > 0


def _report(texts: pa.Array, marks: pa.Array) -> pa.Array:
    out = []
    for t, own in zip(texts, marks.to_pylist()):
        words = t.as_buffer().to_pybytes() if t.is_valid else b""
        words = words.split()
        gone = _removed(len(words), own) if own else np.zeros(len(words), bool)
        kept = b" ".join(w for w, g in zip(words, gone.tolist()) if not g) if own else b" ".join(words)
        edges = np.flatnonzero(np.diff(np.concatenate([[0], gone, [0]])))
        out.append({"n_words": len(words), "n_removed": int(gone.sum()), "kept_sha256": hashlib.sha256(kept).hexdigest(),
                    "spans": [{"first": int(a), "end": int(b)} for a, b in edges.reshape(-1, 2)]})
    return pa.array(out, pa.struct([("n_words", pa.int64()), ("n_removed", pa.int64()), ("kept_sha256", pa.string()),
                                    ("spans", pa.list_(pa.struct([("first", pa.int64()), ("end", pa.int64())])))]))


def repeated_passages(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", crowd: int = CROWD, shard_segments: int = SHARD_SEGMENTS) -> DataFrame:
    """(doc_id, n_words, n_removed, kept_sha256, spans) for each row of ``docs``; doc_id must be an integer.

    ``spans`` are the removed words (first, end): all words in windows of 20 that also start earlier, that is in a
    smaller doc_id or earlier in the same document. kept_sha256 is the digest of the other words joined by spaces.
    Null texts have no words. Rows that repeat a doc_id are one document: places with the same start are the same
    place. Rows without a doc_id are not compared and lose nothing. An empty table gives no rows; other columns are
    not read.
    """
    d = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text"))
    known = d.filter("doc_id IS NOT NULL")
    rows = known.mapInArrow(lambda b: _rows("text", b), "anchor long, doc_id long, start int")
    counts = rows.groupBy("anchor").agg(F.count("*").alias("n")).filter("n > 1")
    counts = stored(counts.select("anchor", F.ceil(F.col("n") / crowd).cast("int").alias("parts"), "n"), "anchors")
    n_shards = max(1, ceil((counts.agg(F.sum("n")).first()[0] or 0) / shard_segments))
    found = rows.join(counts.drop("n"), "anchor").groupBy("doc_id").agg(F.collect_list(F.struct("start", "anchor", "parts")).alias("found"))
    # one shuffle of the texts serves both joins; with a key that is never null, neither join adds a filter below it
    missing = F.lit(-(1 << 63))
    texts = d.select(F.coalesce("doc_id", missing).alias("k"), "text").repartition(int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")), "k")
    segments = texts.join(found.select(F.coalesce("doc_id", missing).alias("k"), "found"), "k").mapInArrow(lambda b: _cut(n_shards, b), _SEGMENT)
    marks = segments.groupBy("shard").applyInArrow(_index_shard, _MARK)
    marks = marks.groupBy(F.coalesce("doc_id", missing).alias("k")).agg(F.collect_list(F.struct("start", "n", "mask")).alias("marks"))
    report = F.arrow_udf(_report, "struct<n_words: long, n_removed: long, kept_sha256: string, spans: array<struct<first: long, end: long>>>")
    out = texts.join(marks, "k", "left").select("k", report("text", "marks").alias("r"))
    return out.select(F.when(F.col("k") != missing, F.col("k")).alias("doc_id"), "r.*")
