"""Packing: token sequences of one window, filled by combinations of document lengths.

1. **Tokens.** Every whole text becomes token ids plus an end id, written once. The tokenizer's added
   tokens are cut out of the text first and have ids of their own.
2. **Combinations.** A document is cut into whole windows and a rest shorter than a window. The rests'
   lengths make a histogram of at most ``window`` bins. Shallow combinations (two or three lengths)
   that fill a window exactly are enumerated, and non-negative least squares finds how often each is
   repeated to come closest to the histogram; the counts are rounded down.
3. **Residuals.** Rests that no combination took are packed greedily one after another and cut at
   window borders; what is left at the end becomes sequences of powers of two. So nothing is padded.

A rest's place follows from its number within its length, so numbering needs no order over all
documents: rests are numbered in salted groups of one length, and group offsets are added.

A null or empty text is the end id alone. Repeated rows are packed each; an empty table gives no
rows; extra columns are ignored.
"""

from __future__ import annotations

import json
import re
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tessera.llm.common import plain_rows, text_steps, written

WINDOW = 2048
END_ID = 1
#: White space, in characters on end, from which a text is cut into words before it is encoded: the encoder's stack ends at a million.
LONG_RUN = 1 << 16
#: Rests of one length that are numbered together, about.
GROUP_ROWS = 250_000


def default_files() -> tuple[str, str]:
    """Paths of the tokenizer and of the same vocabulary as ranks."""
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("byte_bpe_50k.tiktoken")


class TextEncoder:
    """Ids of whole texts as little-endian 16-bit bytes, from the vocabulary's ranks."""

    def __init__(self, tokenizer_file: str, ranks_file: str):
        import base64

        import public_tokenizers
        import regex
        import tiktoken

        with open(ranks_file, "rb") as lines:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
        self.encode = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={}).encode_ordinary
        # What the pattern has cut already, whatever its length.
        self.encode_word = tiktoken.Encoding("word", pat_str="(?s).+", mergeable_ranks=ranks, special_tokens={}).encode_ordinary
        self.words = regex.compile(public_tokenizers.PATTERN).finditer
        self.long_run = re.compile(r"(?<!\s)\s{%d}" % LONG_RUN).search
        with open(tokenizer_file, encoding="utf-8") as file:
            added = json.load(file).get("added_tokens") or []
        if any(t.get(flag) for t in added for flag in ("single_word", "lstrip", "rstrip")):
            raise ValueError("added tokens that take in their surroundings are not supported")
        self.added = {t["content"]: np.array([t["id"]], "<u2").tobytes() for t in added}
        self.marks = list(self.added)
        # Of tokens that start at one place the longest counts, as in the tokenizer.
        self.cut = re.compile("(" + "|".join(map(re.escape, sorted(self.added, key=len, reverse=True))) + ")").split if added else lambda text: [text]

    def plain(self, text: str) -> bytes:
        """All ids of a text without added tokens."""
        if len(text) >= LONG_RUN and self.long_run(text):
            return b"".join(np.array(self.encode_word(word.group()), "<u2").tobytes() for word in self.words(text))
        return np.array(self.encode(text), "<u2").tobytes()

    def ids(self, text: str) -> bytes:
        """All ids of a text; equal to encoding it whole, since added tokens, then the pattern, cut before any merge."""
        if not any(mark in text for mark in self.marks):
            return self.plain(text)
        parts = self.cut(text)
        return b"".join(self.added[part] if i % 2 else self.plain(part) for i, part in enumerate(parts))


_ENCODERS: dict[tuple[str, str], TextEncoder] = {}


def _tokens(files: tuple[str, str], end_id: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = _ENCODERS.get(files) or _ENCODERS.setdefault(files, TextEncoder(*files))
        end = np.array([end_id], "<u2").tobytes()
        at = TaskContext.get().partitionId() << 40
        for step in text_steps(batches):
            ids = [encoder.ids(t or "") + end for t in step.column(1).to_pylist()]
            n = len(ids)
            yield pa.RecordBatch.from_arrays(
                [step.column(0), pa.array(np.arange(at, at + n)), pa.array([len(x) // 2 for x in ids], pa.int64()), pa.array(ids, pa.binary())],
                ["doc_id", "rid", "n", "ids"],
            )
            at += n

    return run


# ---------------------------------------------------------------- 2. combinations


def combinations_of(histogram: np.ndarray, window: int, often: int = 64) -> np.ndarray:
    """Rows of three lengths (0: none) that fill the window, of lengths that occur."""
    have = np.flatnonzero(histogram)
    have = have[have > 0]
    rows = [(a, window - a, 0) for a in have.tolist() if a <= window - a and histogram[window - a]]
    top = np.sort(have[np.argsort(-histogram[have], kind="stable")[:often]]).tolist()
    rows += sorted({tuple(sorted((a, b, window - a - b), reverse=True)) for i, a in enumerate(top) for b in top[i:] if a + b < window and histogram[window - a - b]})
    return np.array(rows, np.int64).reshape(-1, 3)


def repeats(rows: np.ndarray, histogram: np.ndarray, steps: int = 400) -> np.ndarray:
    """Non-negative least squares by accelerated projected gradient, rounded down to what the histogram holds."""
    if len(rows) == 0:
        return np.zeros(0, np.int64)
    want = histogram.astype(float)
    want[0] = 0

    def used(x: np.ndarray) -> np.ndarray:
        out = np.bincount(rows.ravel(), np.repeat(x, 3), len(want))
        out[0] = 0
        return out

    # The largest eigenvalue of A'A is at most its largest row sum.
    weight = np.bincount(rows.ravel(), np.repeat((rows > 0).sum(1), 3), len(want)).astype(float)
    weight[0] = 0
    rate = 1 / max(weight[rows].sum(1).max(), 1.0)
    x = z = np.zeros(len(rows))
    t = 1.0
    for _ in range(steps):
        rest = want - used(z)
        rest[0] = 0
        new = np.maximum(z + rate * rest[rows].sum(1), 0)
        u = (1 + (1 + 4 * t * t) ** 0.5) / 2
        z, x, t = new + (t - 1) / u * (new - x), new, u
    left = histogram.astype(np.int64).copy()
    counts = np.zeros(len(rows), np.int64)
    for i in np.argsort(-x, kind="stable"):
        lengths, times = np.unique(rows[i][rows[i] > 0], return_counts=True)
        counts[i] = min(int(x[i]), int((left[lengths] // times).min()))
        left[lengths] -= counts[i] * times
    return counts


class Layout:
    """Where the k-th rest of each length goes: slots of combinations, then the residual stream."""

    def __init__(self, histogram: np.ndarray, window: int):
        rows = combinations_of(histogram, window)
        counts = repeats(rows, histogram)
        self.window = window
        taken = np.zeros(window, np.int64)
        slots, base = [], 0
        for lengths, count in zip(rows.tolist(), counts.tolist()):
            if count == 0:
                continue
            offset = 0
            for length in lengths:
                if length:
                    slots.append((length, int(taken[length]), base, offset))
                    taken[length] += count
                    offset += length
            base += count
        slots.sort()
        self.slots = np.array(slots, np.int64).reshape(-1, 4)
        self.slot_key = self.slots[:, 0] << 40 | self.slots[:, 1]
        self.taken = taken
        rest = (histogram - taken) * np.arange(window)
        self.stream = np.cumsum(rest) - rest
        total = int(rest.sum())
        self.residual_base = base
        whole = total // window
        # The tail's sequences are the powers of two that make up its length.
        sizes = [1 << b for b in range(window.bit_length() - 1, -1, -1) if total % window >> b & 1]
        self.cuts = np.concatenate([[whole * window], whole * window + np.cumsum(sizes)]).astype(np.int64)
        self.whole_base = base + whole + len(sizes)

    def pieces(self, n: int, before: int, k: int) -> list[tuple[int, int, int, int]]:
        """(start, length, sequence, offset) of a document of n tokens; before: whole windows of documents before it."""
        w = self.window
        out = [(i * w, w, self.whole_base + before + i, 0) for i in range(n // w)]
        r, start = n % w, n - n % w
        if r == 0:
            return out
        if k < self.taken[r]:
            _, low, base, offset = self.slots[np.searchsorted(self.slot_key, r << 40 | k, "right") - 1].tolist()
            return [*out, (start, r, base + k - low, offset)]
        at = int(self.stream[r]) + (k - int(self.taken[r])) * r
        end = at + r
        while at < end:
            if at < self.cuts[0]:
                sequence, low, high = at // w, at // w * w, (at // w + 1) * w
            else:
                j = int(np.searchsorted(self.cuts, at, "right")) - 1
                sequence, low, high = int(self.cuts[0]) // w + j, int(self.cuts[j]), int(self.cuts[j + 1])
            take = min(end, high) - at
            out.append((start, take, self.residual_base + sequence, at - low))
            start, at = start + take, at + take
        return out


def _cut(layout: Layout):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for step in text_steps(batches, "ids"):
            out = []
            for doc, n, ids, before, k in zip(*(step.column(i).to_pylist() for i in range(5))):
                wide = np.frombuffer(ids, "<u2").astype("<u4")
                out += [(doc, s, length, zlib.crc32(wide[s : s + length]), n, q, o) for s, length, q, o in layout.pieces(n, before, k)]
            names = ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"]
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in (zip(*out) if out else [[]] * 7)], names)

    return run


def pack(docs: DataFrame, window: int = WINDOW, end_id: int = END_ID, files: tuple[str, str] | None = None) -> DataFrame:
    """The pieces of docs (doc_id, text): doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset."""
    rows = plain_rows(docs, "doc_id", "text")
    tokens = written(rows.mapInArrow(_tokens(tuple(files or default_files()), end_id), "doc_id long, rid long, n long, ids binary"), "tokens", compression="zstd")
    lengths = tokens.select("rid", (F.col("n") % window).cast("int").alias("r"), F.floor(F.col("n") / window).cast("long").alias("q"))
    groups = max(64, -(-tokens.count() // GROUP_ROWS))
    salted = lengths.withColumn("salt", F.expr(f"pmod(xxhash64(rid), {groups})").cast("int"))
    # At most window x groups rows, and as many numbers: sums of what each group holds.
    sums = written(salted.groupBy("r", "salt").agg(F.count("*").alias("size"), F.sum("q").alias("q")), "sums")
    histogram = np.zeros(window, np.int64)
    for r, size in sums.groupBy("r").agg(F.sum("size")).collect():  # one row for each length below the window
        histogram[r] = size
    before = Window.partitionBy("r").orderBy("salt").rowsBetween(Window.unboundedPreceding, -1)
    at_r = sums.groupBy("r").agg(F.sum("q").alias("q"))
    over_r = Window.partitionBy(F.lit(0)).orderBy("r").rowsBetween(Window.unboundedPreceding, -1)
    starts = sums.select("r", "salt", F.coalesce(F.sum("size").over(before), F.lit(0)).alias("k0"), F.coalesce(F.sum("q").over(before), F.lit(0)).alias("q0")).join(
        at_r.select("r", F.coalesce(F.sum("q").over(over_r), F.lit(0)).alias("q1")), "r"
    )
    group = Window.partitionBy("r", "salt").orderBy("rid")
    running = group.rowsBetween(Window.unboundedPreceding, 0)
    numbered = salted.select("rid", "r", "salt", (F.row_number().over(group) - 1).alias("k"), (F.sum("q").over(running) - F.col("q")).alias("b"))
    placed = written(numbered.join(starts, ["r", "salt"]).select("rid", (F.col("k") + F.col("k0")).alias("k"), (F.col("b") + F.col("q0") + F.col("q1")).alias("before")), "placed")
    schema = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"
    return tokens.join(placed, "rid").select("doc_id", "n", "ids", "before", "k").mapInArrow(_cut(Layout(histogram, window)), schema)


def op10_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The contract's columns for every piece."""
    return pack(spark.read.parquet(f"{sf_dir}/documents.parquet"))
