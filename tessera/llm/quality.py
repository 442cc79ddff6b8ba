"""Quality classifier: logistic regression on hashed word n-grams, learned by follow-the-regularised-leader.

A text's features are its tokens' and token shapes' n-grams, hashed into ``BITS`` bits, as square
roots of counts scaled to unit length. Learning passes over a bounded sample of labelled rows one at
a time; a score is a sparse dot product with the learned weights, inside Arrow batches.

A null or empty text has no features and scores as the bias does. Repeated rows score alike; an empty
table gives no rows; without labels of both classes every score is the share of label 1 (or 0.5).
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm.common import mix, plain_rows, text_steps, utf8
from tessera.llm.labelled import held_out, joined, sample, tokens_and_shapes

BITS = 18
#: The bound of the labelled sample that is learned from.
TRAIN_ROWS = 6000
EPOCHS = 3
THRESHOLD = 0.3


def features(raw: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, slot, value) of all rows' hashed n-grams, by row."""
    token, shape, first = tokens_and_shapes(raw, off)
    n = len(first) - 1
    row = np.repeat(np.arange(n), np.diff(first))
    found = []
    for salt, stream, longest in ((1, token, 2), (101, shape, 3)):
        for size in range(1, longest + 1):
            if len(stream) < size:
                continue
            h = np.full(len(stream) - size + 1, salt * 7919 + size, np.uint64)
            for k in range(size):
                h = mix(h * np.uint64(0x9E3779B97F4A7C15) + stream[k : len(stream) - size + 1 + k])
            inside = row[: len(h)] == row[size - 1 :]
            found.append((row[: len(h)][inside].astype(np.uint64) << np.uint64(BITS)) | (h[inside] >> np.uint64(64 - BITS)))
    if not found:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0)
    keys, counts = np.unique(np.concatenate(found), return_counts=True)
    where, slot = (keys >> np.uint64(BITS)).astype(np.int64), (keys & np.uint64((1 << BITS) - 1)).astype(np.int64)
    value = np.sqrt(counts)
    norm = np.sqrt(np.bincount(where, counts, n))
    return where, slot, value / norm[where]


def learn(texts: list[str], y: list[int], alpha: float = 1.0, beta: float = 1.0, l1: float = 0.02, l2: float = 0.1) -> tuple[np.ndarray, float]:
    """(weights, bias) by FTRL-proximal (McMahan et al., 2013)."""
    share = float(np.mean(y)) if y else 0.5
    if not 0 < share < 1:
        return np.zeros(1 << BITS, np.float32), 8.0 * (share > 0.5) - 8.0 * (share < 0.5)
    rows: list[tuple[np.ndarray, np.ndarray]] = []
    for begin in range(0, len(texts), 256):
        part = texts[begin : begin + 256]
        where, slot, value = features(*joined(part))
        cut = np.searchsorted(where, np.arange(len(part) + 1))
        rows += [(slot[a:b], value[a:b]) for a, b in zip(cut, cut[1:])]
    z, n = np.zeros(1 << BITS), np.zeros(1 << BITS)
    bias_z, bias_n = 0.0, 0.0
    scale = 4.0  # unit-length rows; a larger step for the few slots that tell

    def solved(z: np.ndarray, n: np.ndarray) -> np.ndarray:
        return np.where(np.abs(z) <= l1, 0.0, -(z - np.sign(z) * l1) / ((beta + np.sqrt(n)) / alpha + l2))

    for epoch in range(EPOCHS):
        for i in np.random.default_rng(epoch).permutation(len(rows)):
            slot, value = rows[i]
            x = value * scale
            w = solved(z[slot], n[slot])
            b = -bias_z / ((beta + bias_n**0.5) / alpha)
            p = 1 / (1 + np.exp(-np.clip(w @ x + b, -35, 35)))
            g = p - y[i]
            step = g * x
            z[slot] += step - (np.sqrt(n[slot] + step * step) - np.sqrt(n[slot])) / alpha * w
            n[slot] += step * step
            bias_z += g - ((bias_n + g * g) ** 0.5 - bias_n**0.5) / alpha * b
            bias_n += g * g
    return (solved(z, n) * scale).astype(np.float32), float(-bias_z / ((beta + bias_n**0.5) / alpha))


def _score(weights: np.ndarray, bias: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for step in text_steps(batches):
            where, slot, value = features(*utf8(step.column(1)))
            sums = np.bincount(where, value * weights[slot], step.num_rows) + bias
            yield pa.RecordBatch.from_arrays([step.column(0), pa.array(1 / (1 + np.exp(-np.clip(sums, -35, 35))))], ["doc_id", "score"])

    return run


def score_quality(docs: DataFrame, labels: DataFrame, train_rows: int = TRAIN_ROWS, threshold: float = THRESHOLD) -> DataFrame:
    """doc_id, held_out, score, predicted of docs (doc_id, text), learned from labels (doc_id, quality)."""
    got = sample(docs, labels, "quality", train_rows)
    weights, bias = learn([t for t, _, _ in got], [y for _, _, y in got])
    scored = plain_rows(docs, "doc_id", "text").mapInArrow(_score(weights, bias), "doc_id long, score double")
    return scored.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))


def op7_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The contract's columns for every document."""
    return score_quality(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/labels.parquet"))
