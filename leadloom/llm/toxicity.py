"""Severity of toxicity by cumulative-link ordinal regression on sparse word features."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute
from pyspark.sql import Column, DataFrame, functions as F

from leadloom.llm.contamination import SEPARATOR
from leadloom.llm.shared import labelled_sample
from leadloom.llm.words import blocks, hashes, spans

#: Grades: 0 not toxic, then ever more severe.
GRADES = 4
#: The model is fitted on this many labelled rows, those of the smallest hashes of their ids.
SAMPLE_ROWS = 6_000
#: Words of fewer documents of the sample are no features.
MIN_DOCUMENTS = 5
#: A document is rejected from this probability of a grade above 0.
REJECT_AT = 0.2
#: Words whose share among rows of grade 0 and among the others differs by fewer standard errors are no features.
MIN_ERRORS = 5.0
STEPS, RATE, L1 = 300, 2.0, 2e-5

_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[0x41:0x5B] += 32


def word_sets(texts: pa.Array) -> list[np.ndarray]:
    """Sorted distinct word hashes of each text; case and punctuation do not count."""
    out: list[np.ndarray] = []
    for _, data, offsets in blocks(texts):
        data = _LOWER[data]
        starts, ends, first = spans(data, offsets, SEPARATOR)
        h = hashes(data, starts, ends)
        out += [np.unique(h[a:b]) for a, b in zip(first[:-1], first[1:])]
    return out


@dataclass
class Model:
    words: np.ndarray
    weights: np.ndarray
    thresholds: np.ndarray

    def exceed(self, docs: list[np.ndarray]) -> np.ndarray:
        """Probability of a grade above each threshold, one row per text."""
        score = np.zeros(len(docs))
        if len(self.words):
            for i, own in enumerate(docs):
                at = np.searchsorted(own, self.words)
                found = at < len(own)
                found[found] = own[at[found]] == self.words[found]
                score[i] = self.weights[found].sum()
        return _sigmoid(score[:, None] - self.thresholds)


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -40, 40)))


def _errors(inside: np.ndarray, counts: np.ndarray, marked: int, rows: int) -> np.ndarray:
    """Standard errors between each word's share of the marked and of the other rows."""
    a, b = max(1, marked), max(1, rows - marked)
    share = counts / (a + b)
    return np.abs(inside / a - (counts - inside) / b) / np.sqrt(np.maximum(share * (1 - share), 1e-12) * (1 / a + 1 / b))


def fit(words: np.ndarray, before: np.ndarray, grades: np.ndarray, n_grades: int = GRADES) -> Model:
    """Shared weights and ordered thresholds by proximal gradient steps on the cumulative-link likelihood.

    ``words`` holds the distinct words of all texts one after another, ``before`` how many stand before each text. The
    loss is the sum over thresholds of the logistic losses of 'grade above it'; small weights become zero. Without rows
    nothing is toxic; a grade without rows above it keeps its threshold high.
    """
    n = len(grades)
    if not n:
        return Model(np.zeros(0, np.uint64), np.zeros(0), np.arange(1, n_grades) * 5.0)
    vocabulary, column, counts = np.unique(words, return_inverse=True, return_counts=True)
    row = np.repeat(np.arange(n), np.diff(before))
    inside = np.bincount(column, grades[row] > 0, len(vocabulary))
    wanted = (counts >= MIN_DOCUMENTS) & (_errors(inside, counts, int((grades > 0).sum()), n) >= MIN_ERRORS)
    number = np.cumsum(wanted) - 1
    used = wanted[column]
    row, column, vocabulary = row[used], number[column[used]], vocabulary[wanted]
    above = grades[:, None] > np.arange(n_grades - 1)
    share = (above.sum(0) + 0.5) / (n + 1)
    thresholds, weights = -np.log(share / (1 - share)), np.zeros(len(vocabulary))
    seen_w, seen_t = np.full(len(weights), 1e-8), np.full(len(thresholds), 1e-8)
    for _ in range(STEPS):
        score = np.bincount(row, weights[column], n)
        slope = (_sigmoid(score[:, None] - thresholds) - above) / n
        grad_w = np.bincount(column, slope.sum(1)[row], len(weights))
        grad_t = -slope.sum(0)
        seen_w, seen_t = seen_w + grad_w ** 2, seen_t + grad_t ** 2
        step = RATE / np.sqrt(seen_w)
        weights = weights - step * grad_w
        weights = np.sign(weights) * np.maximum(np.abs(weights) - step * L1, 0)
        thresholds = np.sort(thresholds - RATE / np.sqrt(seen_t) * grad_t)
    kept = weights != 0
    return Model(vocabulary[kept], weights[kept], thresholds)


def graded_by_words(words: np.ndarray, before: np.ndarray, toxic: np.ndarray) -> np.ndarray:
    """Grades for labels that only say toxic or not: toxic rows are split by their number of words that stand at least
    twenty times as often in toxic rows as in others (one or fewer, two to three, more)."""
    if not toxic.any():
        return np.zeros(len(toxic), np.int64)
    row = np.repeat(np.arange(len(toxic)), np.diff(before))
    _, at = np.unique(words, return_inverse=True)
    inside, outside = np.bincount(at, toxic[row]), np.bincount(at, ~toxic[row])
    marks = (inside >= MIN_DOCUMENTS) & (inside / toxic.sum() >= 0.01) & (inside / toxic.sum() >= 20 * (outside + 0.5) / max(1, (~toxic).sum()))
    n = np.bincount(row, marks[at], len(toxic))
    return np.where(toxic, 1 + np.digitize(n, [2, 4]), 0)


def train(docs: DataFrame, labels: DataFrame, doc_id: str = "doc_id", text: str = "text", toxic: str = "toxic",
          grade: str | None = None, rows: int = SAMPLE_ROWS) -> Model:
    """Model from at most ``rows`` labelled documents, chosen by the hashes of their ids.

    ``labels`` has ``toxic`` (0 or 1) or, if named, ``grade`` (0 to GRADES - 1). Null labels and ids are left out.
    """
    chosen = labels.select(F.col(doc_id).alias("id"), F.col(grade or toxic).cast("int").alias("y"))

    @F.arrow_udf("array<long>")
    def words(texts: pa.Array) -> pa.Array:
        return pa.array([w.view(np.int64) for w in word_sets(texts)], pa.list_(pa.int64()))
    found = labelled_sample(docs, chosen, doc_id, text, rows).select("y", words("text").alias("w")).toArrow().combine_chunks()
    y = found["y"].to_numpy().astype(np.int64)
    before = np.concatenate([[0], np.cumsum(pa.compute.list_value_length(found["w"]).to_numpy())]).astype(np.int64)
    flat = pa.compute.list_flatten(found["w"]).to_numpy().view(np.uint64)
    return fit(flat, before, np.clip(y, 0, GRADES - 1) if grade else graded_by_words(flat, before, y > 0))


def severity(model: Model, text: Column) -> Column:
    """Struct of p_toxic (probability of a grade above 0), severity (expected grade) and grade (the most likely one)."""
    @F.arrow_udf("struct<p_toxic: double, severity: double, grade: int>")
    def of(texts: pa.Array) -> pa.Array:
        p = model.exceed(word_sets(texts)) if len(texts) else np.zeros((0, GRADES - 1))
        each = -np.diff(np.concatenate([np.ones((len(p), 1)), p, np.zeros((len(p), 1))], axis=1), axis=1)
        return pa.StructArray.from_arrays([pa.array(p[:, 0]), pa.array(p.sum(1)), pa.array(each.argmax(1).astype(np.int32))], ["p_toxic", "severity", "grade"])
    return of(text)


def without_toxic(docs: DataFrame, labels: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """``docs`` without rows whose probability of a grade above 0 reaches ``REJECT_AT``; null and empty texts stay
    unless most labelled rows are toxic."""
    return docs.filter(severity(train(docs, labels, doc_id, text), F.col(text))["p_toxic"] < REJECT_AT)
