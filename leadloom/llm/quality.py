"""Quality of documents by attention over their passages (multiple-instance learning)."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute
from pyspark.sql import Column, DataFrame, functions as F

from leadloom.llm.shared import labelled_sample
from leadloom.llm.words import blocks, hashes, spans

#: Words of a passage; the last one of a text may be shorter.
PASSAGE = 64
#: The model is fitted on this many labelled rows, those of the smallest hashes of their ids.
SAMPLE_ROWS = 4_000
PREDICT_AT = 0.3
HIDDEN, ATTENTION, STEPS, RATE, DECAY = 16, 8, 150, 0.03, 1e-4

_CLASS = {
    "symbol": np.isin(np.arange(256), list(b"#*$%&|<>")), "upper": np.isin(np.arange(256), range(0x41, 0x5B)),
    "digit": np.isin(np.arange(256), range(0x30, 0x3A)), "exclaim": np.isin(np.arange(256), list(b"!?")),
    "stop": np.isin(np.arange(256), list(b".,;:")), "other": np.isin(np.arange(256), list(b"()[]{}\"'=_/\\+@~^`-")),
    "high": np.arange(256) >= 0x80,
}
N_FEATURES = len(_CLASS) + 8


def passages(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Features of all passages of the texts, and the number of passages before each text. A text without words has
    one passage of zeros."""
    parts, counts = [], []
    for _, data, offsets in blocks(texts):
        starts, ends, first = spans(data, offsets)
        n = np.diff(first)
        own = np.maximum(1, -(-n // PASSAGE))
        rows = np.zeros((own.sum(), N_FEATURES))
        counts.append(own)
        parts.append(rows)
        if not len(starts):
            continue
        doc = np.repeat(np.arange(len(n)), n)
        before = np.concatenate([[0], np.cumsum(own)])
        row = before[doc] + (np.arange(len(starts)) - first[doc]) // PASSAGE
        h, length = hashes(data, starts, ends), ends - starts
        words = np.bincount(row, minlength=len(rows)).astype(float)
        mean = lambda v: np.bincount(row, v, len(rows)) / np.maximum(words, 1)
        byte_row = np.repeat(row, length)
        inside = np.arange(len(byte_row)) + np.repeat(starts - np.concatenate([[0], np.cumsum(length)[:-1]]), length)
        kinds = data[inside]
        size = np.bincount(row, length, len(rows))
        for k, table in enumerate(_CLASS.values()):
            rows[:, k] = np.bincount(byte_row, table[kinds], len(rows)) / np.maximum(size, 1)
        same = np.zeros(len(h), bool)
        same[1:] = (h[1:] == h[:-1]) & (row[1:] == row[:-1])
        order = np.lexsort((h, row))
        fresh = np.ones(len(h), bool)
        fresh[1:] = (h[order][1:] != h[order][:-1]) | (row[order][1:] != row[order][:-1])
        breaks = np.concatenate([[0], np.cumsum(data == 0x0A)])
        new_line = breaks[np.append(starts[1:], len(data))] - breaks[ends]
        k = len(_CLASS)
        rows[:, k] = mean(length) / 10
        rows[:, k + 1] = np.sqrt(np.maximum(0, mean(length.astype(float) ** 2) - mean(length) ** 2)) / 10
        rows[:, k + 2] = mean(same)
        rows[:, k + 3] = np.bincount(row[order], fresh, len(rows)) / np.maximum(words, 1)
        rows[:, k + 4] = mean(new_line > 0)
        rows[:, k + 5] = mean(length <= 3)
        rows[:, k + 6] = mean(length >= 15)
        rows[:, k + 7] = words / PASSAGE
    rows = np.concatenate([np.zeros((0, N_FEATURES)), *parts])
    return rows, np.concatenate([[0], np.cumsum(np.concatenate([np.zeros(0, np.int64), *counts]))]).astype(np.int64)


@dataclass
class Model:
    """Passage encoder, gated attention and classifier; ``shift`` and ``scale`` standardise the features."""

    shift: np.ndarray
    scale: np.ndarray
    p: dict[str, np.ndarray]

    def forward(self, rows: np.ndarray, before: np.ndarray) -> dict[str, np.ndarray]:
        p, x = self.p, (rows - self.shift) / self.scale
        h = np.tanh(x @ p["W"] + p["b"])
        gate_a, gate_b = np.tanh(h @ p["V"]), _sigmoid(h @ p["U"])
        e = (gate_a * gate_b) @ p["w"]
        bag = np.repeat(np.arange(len(before) - 1), np.diff(before))
        top = np.maximum.reduceat(e, before[:-1])
        weight = np.exp(e - top[bag])
        weight = weight / np.add.reduceat(weight, before[:-1])[bag]
        z = np.add.reduceat(weight[:, None] * h, before[:-1], axis=0)
        return {"x": x, "h": h, "A": gate_a, "B": gate_b, "bag": bag, "weight": weight, "z": z, "y": _sigmoid(z @ p["u"] + p["c"])}

    def scores(self, texts: pa.Array) -> np.ndarray:
        return self.forward(*passages(texts))["y"] if len(texts) else np.zeros(0)


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -40, 40)))


def fit(rows: np.ndarray, before: np.ndarray, labels: np.ndarray) -> Model:
    """Adam steps on the log loss of the documents, all rows at once. Without rows every score is 0.5."""
    random = np.random.RandomState(3)
    shape = {"W": (N_FEATURES, HIDDEN), "b": (HIDDEN,), "V": (HIDDEN, ATTENTION), "U": (HIDDEN, ATTENTION), "w": (ATTENTION,), "u": (HIDDEN,), "c": ()}
    p = {k: random.normal(0, 0.3, s) if len(s) == 2 or k in "wu" else np.zeros(s) for k, s in shape.items()}
    if not len(labels):
        return Model(np.zeros(N_FEATURES), np.ones(N_FEATURES), {**p, "u": np.zeros(HIDDEN)})
    model = Model(rows.mean(0), rows.std(0) + 1e-3, p)
    m, v = {k: np.zeros(s) for k, s in shape.items()}, {k: np.zeros(s) for k, s in shape.items()}
    for t in range(1, STEPS + 1):
        f = model.forward(rows, before)
        dy = (f["y"] - labels) / len(labels)
        dz = dy[:, None] * p["u"]
        bag, weight, h = f["bag"], f["weight"], f["h"]
        along = (dz[bag] * h).sum(1)
        de = weight * (along - np.add.reduceat(weight * along, before[:-1])[bag])
        da, db = de[:, None] * p["w"] * f["B"] * (1 - f["A"] ** 2), de[:, None] * p["w"] * f["A"] * f["B"] * (1 - f["B"])
        dh = weight[:, None] * dz[bag] + da @ p["V"].T + db @ p["U"].T
        dx = dh * (1 - h ** 2)
        grads = {"W": f["x"].T @ dx, "b": dx.sum(0), "V": h.T @ da, "U": h.T @ db, "w": (f["A"] * f["B"]).T @ de, "u": f["z"].T @ dy, "c": dy.sum()}
        for k, g in grads.items():
            g = g + DECAY * p[k]
            m[k], v[k] = 0.9 * m[k] + 0.1 * g, 0.999 * v[k] + 0.001 * g * g
            p[k] = p[k] - RATE * (m[k] / (1 - 0.9 ** t)) / (np.sqrt(v[k] / (1 - 0.999 ** t)) + 1e-8)
    return model


def held_out(doc_id: Column) -> Column:
    """Rows that are never learned from."""
    return F.crc32(doc_id.cast("string").cast("binary")) % 5 == 0


def train(docs: DataFrame, labels: DataFrame, doc_id: str = "doc_id", text: str = "text", label: str = "quality", rows: int = SAMPLE_ROWS) -> Model:
    """Model from at most ``rows`` labelled documents that are not held out, chosen by the hashes of their ids.

    Passages are encoded in Spark tasks; the driver receives their features. Null labels and ids are left out.
    """
    chosen = labels.select(F.col(doc_id).alias("id"), F.col(label).cast("double").alias("y")).filter(~held_out(F.col("id")))

    @F.arrow_udf("array<float>")
    def encoded(texts: pa.Array) -> pa.Array:
        x, before = passages(texts)
        return pa.ListArray.from_arrays(pa.array((before * N_FEATURES).astype(np.int32)), pa.array(x.astype(np.float32).ravel()))
    found = labelled_sample(docs, chosen, doc_id, text, rows).select("y", encoded("text").alias("x")).toArrow().combine_chunks()
    sizes = pa.compute.list_value_length(found["x"]).to_numpy() // N_FEATURES
    flat = pa.compute.list_flatten(found["x"]).to_numpy().reshape(-1, N_FEATURES).astype(float)
    return fit(flat, np.concatenate([[0], np.cumsum(sizes)]).astype(np.int64), found["y"].to_numpy())


def score(model: Model, text: Column) -> Column:
    @F.arrow_udf("double")
    def of(texts: pa.Array) -> pa.Array:
        return pa.array(model.scores(texts))
    return of(text)


def score_documents(docs: DataFrame, labels: DataFrame, doc_id: str = "doc_id", text: str = "text", label: str = "quality") -> DataFrame:
    """(doc_id, held_out, score, predicted) per row of ``docs``.

    Null and blank texts are one empty passage and get its score. A null doc_id is not held out. Repeated rows come out
    as often as they go in; other columns are not read.
    """
    model = train(docs, labels, doc_id, text, label)
    out = docs.select(F.col(doc_id).alias("doc_id"), F.coalesce(held_out(F.col(doc_id)), F.lit(False)).alias("held_out"), score(model, F.col(text)).alias("score"))
    return out.withColumn("predicted", (F.col("score") >= PREDICT_AT).cast("int"))
