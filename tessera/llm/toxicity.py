"""Toxicity: a convolutional text classifier over hashed word embeddings, trained in numpy inside Spark's tasks.

A word's embedding is the sum of those of its whole form and its first 4 and 5 bytes, each hashed into
``BITS`` bits; buckets that at least ``MIN_DOCS`` training documents hold have one, others are zero. Filters of several widths slide over the words, the largest response
of each over the whole text feeds a logistic unit. All labelled rows outside the held-out fold are learned
from: each half of them by a net of its own, in which learners of parts are mixed after each round. A text's
logit is the mean of both nets'. Thresholds are calibrated by language on all these rows, each scored by the net
that hasn't seen it: the smallest threshold whose false alarms stay within ``ALARMS``, but not
below 0.5; languages with few rows take the threshold of all. The score itself sees only the text.
Where a half has labels of one class alone, one net learns all rows and scores them for the thresholds.

A null or empty text responds as no words do. Repeated rows score alike; an empty table gives no
rows; without labels of both classes every score is near 0 or 1, as the labels are, or 0.5.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from copy import deepcopy
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm.common import passing, shuffles_go, text_steps, utf8
from tessera.llm.labelled import held_out, joined, labelled_parts, words

BITS = 20
#: Labelled rows of a part, which one learner passes over in a round.
PART_ROWS = 4096
WIDTHS = (1, 2, 3)
FILTERS = 8
SIZE = 8
EPOCHS = 5
#: Texts of a mini-batch, and Adagrad's rate.
BATCH = 32
RATE = 0.08
#: Words whose responses a step of learning computes at a time.
STEP_WORDS = 1 << 17
#: Changes of weights are summed as whole multiples of 1 / UNIT.
UNIT = float(1 << 32)
#: Bytes of text that are scored at a time.
SCORE_BYTES = 1 << 19
MIN_DOCS = 3
ALARMS = 0.002
THRESHOLD = 0.5
#: The highest threshold, and steps of thresholds in 1.
MOST = 0.9
GRID = 4096


@dataclass
class Net:
    """Embeddings of the buckets in ``keys`` (row 0 is zero), filters by width, and the output unit."""

    keys: np.ndarray
    table: np.ndarray
    filters: list[np.ndarray]
    shifts: list[np.ndarray]
    out: np.ndarray
    bias: float
    thresholds: dict = field(default_factory=dict)
    #: The table's row of each bucket, made where it is used.
    places: np.ndarray | None = None

    def rows_of(self, bucket: np.ndarray) -> np.ndarray:
        if self.places is None:
            self.places = np.zeros(1 << BITS, np.int32)
            self.places[self.keys] = np.arange(1, len(self.keys) + 1)
        return self.places[bucket]

    def dense(self) -> np.ndarray:
        """Filters, shifts, output weights and bias in one array."""
        return np.concatenate([x.ravel() for x in (*self.filters, *self.shifts, self.out)] + [[self.bias]]).astype(np.float32)

    def set_dense(self, flat: np.ndarray) -> None:
        at = 0
        for x in (*self.filters, *self.shifts, self.out):
            x[...] = flat[at : at + x.size].reshape(x.shape)
            at += x.size
        self.bias = float(flat[at])

    def padded(self, rows: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Table rows (3 x words) with zeros after each text, as many as the widest filter needs, and the texts' starts."""
        pad = max(WIDTHS)
        sizes = np.diff(first)
        starts = np.concatenate([[0], np.cumsum(sizes + pad)])
        out = np.zeros((len(rows), starts[-1] + pad), np.int32)
        out[:, np.arange(rows.shape[1]) + np.repeat(np.arange(len(sizes)) * pad, sizes)] = rows
        return out, starts[:-1]

    def responses(self, flat: np.ndarray, starts: np.ndarray, pick: bool = False):
        """The largest response of each filter in each text and, if asked, its place."""
        emb = self.table[flat[0]]
        for part in flat[1:]:
            emb += self.table[part]
        n = len(emb) - max(WIDTHS)
        top, places = [], []
        for width, kernel, shift in zip(WIDTHS, self.filters, self.shifts):
            x = np.concatenate([emb[k : n + k] for k in range(width)], 1) @ kernel + shift
            # The first place after a text sees zeros alone; from the next ones a filter would reach into the text that follows.
            x[(np.append(starts[1:], n)[:, None] - np.arange(1, max(WIDTHS))).ravel()] = -np.inf
            most = np.maximum.reduceat(x, starts)
            top.append(np.maximum(most, 0))
            if pick:
                ends = np.append(starts[1:], n)
                places.append(np.stack([a + x[a:b].argmax(0) for a, b in zip(starts, ends)]))
        return (np.concatenate(top, 1), places, emb) if pick else np.concatenate(top, 1)

    def score(self, raw: np.ndarray, off: np.ndarray) -> np.ndarray:
        hashes, first = words(raw, off)
        flat, starts = self.padded(self.rows_of(buckets(hashes)), first)
        return 1 / (1 + np.exp(-np.clip(self.responses(flat, starts) @ self.out + self.bias, -35, 35)))


def buckets(hashes: np.ndarray) -> np.ndarray:
    return (hashes >> np.uint64(64 - BITS)).astype(np.uint32)


@dataclass
class Learner:
    """A net and Adagrad's sums of squares: ``dense`` holds filters, shifts, output weights and bias, rows are those of the table."""

    net: Net
    square: np.ndarray
    dense_square: np.ndarray
    share: float

    def step(self, rows: list[np.ndarray], y: np.ndarray) -> np.ndarray:
        """One step on a mini-batch of texts' table rows (3 x words each); the touched rows of the table."""
        net = self.net
        tops, inputs, streams = [], [], []
        for part in _by_size(rows):
            flat, starts = net.padded(np.concatenate(part, 1), np.cumsum([0, *(r.shape[1] for r in part)]))
            top, places, emb = net.responses(flat, starts, pick=True)
            seen_at = [at[:, :, None] + np.arange(width) for at, width in zip(places, WIDTHS)]  # text x filter x width
            tops.append(top)
            inputs.append([emb[at].reshape(*at.shape[:2], -1) for at in seen_at])
            streams.append([[stream[at] for stream in flat] for at in seen_at])
        top = np.concatenate(tops)
        weight = np.where(y == 1, min(0.5 / self.share, 4.0), 1.0)
        p = 1 / (1 + np.exp(-np.clip(top @ net.out + net.bias, -35, 35)))
        g = ((p - y) * weight / len(y)).astype(np.float32)
        back = g[:, None] * net.out[None, :] * (top > 0)
        kernels, shifts, hit_rows, hit_grads = [], [], [], []
        for j, width in enumerate(WIDTHS):
            mine = back[:, j * FILTERS : (j + 1) * FILTERS]
            x = np.concatenate([part[j] for part in inputs])
            kernels.append(np.einsum("bf,bfk->kf", mine, x) + 1e-4 * net.filters[j])
            shifts.append(mine.sum(0))
            dx = (mine[:, :, None] * net.filters[j].T[None]).reshape(-1, SIZE)
            for k in range(3):
                hit_rows.append(np.concatenate([part[j][k] for part in streams]).reshape(-1))
                hit_grads.append(dx)
        touched, inverse = np.unique(np.concatenate(hit_rows), return_inverse=True)
        dt = np.zeros((len(touched), SIZE), np.float32)
        np.add.at(dt, inverse, np.concatenate(hit_grads))
        dt += 1e-4 * net.table[touched]
        self.square[touched] += dt * dt
        net.table[touched] -= RATE * dt / np.sqrt(self.square[touched])
        net.table[0] = 0
        grad = np.concatenate([x.ravel() for x in (*kernels, *shifts, top.T @ g + 1e-4 * net.out)] + [[g.sum()]]).astype(np.float32)
        self.dense_square += grad * grad
        net.set_dense(net.dense() - RATE * grad / np.sqrt(self.dense_square))
        return touched


def _by_size(rows: list[np.ndarray]) -> Iterator[list[np.ndarray]]:
    """Runs of texts with about ``STEP_WORDS`` words (a longer text goes alone)."""
    now, size = [], 0
    for row in rows:
        if now and size + row.shape[1] > STEP_WORDS:
            yield now
            now, size = [], 0
        now.append(row)
        size += row.shape[1]
    if now:
        yield now


def fresh(keys: np.ndarray, share: float, seed: int = 7) -> Learner:
    """A learner before its first step; where all labels are alike its net says so and needs none."""
    rng = np.random.default_rng(seed)
    net = Net(
        keys,
        np.concatenate([np.zeros((1, SIZE)), rng.normal(0, 0.1, (len(keys), SIZE))]).astype(np.float32),
        [rng.normal(0, 0.4, (w * SIZE, FILTERS)).astype(np.float32) for w in WIDTHS],
        [np.zeros(FILTERS, np.float32) for _ in WIDTHS],
        rng.normal(0, 0.3, FILTERS * len(WIDTHS)).astype(np.float32),
        0.0,
    )
    if not 0 < share < 1:
        net.out[:] = 0
        net.bias = 8.0 * (share > 0.5) - 8.0 * (share < 0.5)
    return Learner(net, np.full(net.table.shape, 1e-3, np.float32), np.full(len(net.dense()), 1e-3, np.float32), share)


def combined(nets: list[Net]) -> Net:
    """One net whose logit is the mean of those of the given ones."""
    size, count = SIZE * len(nets), FILTERS * len(nets)
    keys = np.unique(np.concatenate([net.keys for net in nets]))
    table = np.zeros((len(keys) + 1, size), np.float32)
    filters = [np.zeros((w, size, count), np.float32) for w in WIDTHS]
    shifts = [np.zeros(count, np.float32) for _ in WIDTHS]
    out = np.zeros((len(WIDTHS), count), np.float32)
    for i, net in enumerate(nets):
        mine, own = slice(i * SIZE, (i + 1) * SIZE), slice(i * FILTERS, (i + 1) * FILTERS)
        table[1 + np.searchsorted(keys, net.keys), mine] = net.table[1:]
        for j, w in enumerate(WIDTHS):
            filters[j][:, mine, own] = net.filters[j].reshape(w, SIZE, FILTERS)
            shifts[j][own] = net.shifts[j]
            out[j, own] = net.out[j * FILTERS : (j + 1) * FILTERS] / len(nets)
    return Net(keys, table, [f.reshape(-1, count) for f in filters], shifts, out.ravel(), sum(net.bias for net in nets) / len(nets))


def learn(texts: list[str], y: np.ndarray, seed: int = 7) -> Net:
    """A net fitted to a few texts where it is called: one part, without Spark."""
    hashed = [buckets(words(*joined([t]))[0]) for t in texts]
    keys, docs = np.unique(np.concatenate([np.unique(h) for h in hashed]) if hashed else np.zeros(0, np.uint32), return_counts=True)
    learner = fresh(keys[docs >= MIN_DOCS], float(y.mean()) if len(y) else 0.5, seed)
    if 0 < learner.share < 1:
        rows = [learner.net.rows_of(h) for h in hashed]
        for _ in range(EPOCHS):
            for begin in range(0, len(rows), BATCH):
                learner.step(rows[begin : begin + BATCH], y[begin : begin + BATCH])
    return learner.net


# ---------------------------------------------------------------- learning from all labelled rows


def _document_counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(bucket, docs): the task's texts that hold the bucket."""
    docs = np.zeros(1 << BITS, np.int64)
    for step in text_steps(batches, step=SCORE_BYTES):
        hashes, first = words(*utf8(step.column(0)))
        found = buckets(hashes)
        for a, b in zip(first, first[1:]):
            docs[np.unique(found[:, a:b])] += 1
    held = np.flatnonzero(docs)
    yield pa.RecordBatch.from_arrays([pa.array(held), pa.array(docs[held])], ["bucket", "docs"])


def _pass(learner: Learner):
    """Rows (part, y, text), a part's rows together: what a pass over each part adds to each row of the table and of the dense weights.

    Changes are whole multiples of 1 / ``UNIT``, so that sums don't depend on their order.
    """
    names = ["row", "parts", *(f"v{k}" for k in range(2 * SIZE))]

    def told(mine: Learner, touched: np.ndarray) -> pa.RecordBatch:
        at = np.flatnonzero(touched)
        change = np.concatenate([mine.net.table[at] - learner.net.table[at], mine.square[at] - learner.square[at]], 1)
        dense = np.stack([mine.net.dense() - learner.net.dense(), mine.dense_square - learner.dense_square])
        dense = np.pad(dense, ((0, 0), (0, -dense.shape[1] % SIZE)))
        change = np.concatenate([change, np.concatenate(dense.reshape(2, -1, SIZE), 1)])
        row = np.concatenate([at, -1 - np.arange(dense.shape[1] // SIZE)])
        whole = np.rint(change.astype(np.float64) * UNIT).astype(np.int64)
        return pa.RecordBatch.from_arrays([pa.array(row), pa.array(np.ones(len(row), np.int64)), *(pa.array(c) for c in whole.T)], names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, mine, rows, y = None, None, [], []
        for step in text_steps(batches, step=SCORE_BYTES):
            hashes, first = words(*utf8(step.column(2)))
            found = learner.net.rows_of(buckets(hashes))
            for i, (part, label) in enumerate(zip(step.column(0).to_pylist(), step.column(1).to_pylist())):
                if part != now or len(y) == BATCH:
                    if y:
                        touched[mine.step(rows, np.array(y))] = True
                        rows, y = [], []
                    if part != now:
                        if mine:
                            yield told(mine, touched)
                        now, mine, touched = part, deepcopy(learner), np.zeros(len(learner.square), bool)
                rows.append(found[:, first[i] : first[i + 1]])
                y.append(label)
        if mine:
            touched[mine.step(rows, np.array(y))] = True
            yield told(mine, touched)

    return run


def fitted(fit: DataFrame, share: float) -> Net:
    """A net from all rows (part, y, text) of fit, by ``EPOCHS`` rounds of parameter mixing (McDonald et al., 2010).

    In a round each part's learner starts from the common net and passes over the part's rows; then
    every weight moves by the mean of its changes in the parts that touched it. What comes to the driver are
    counts and changes by row of the table, which has at most ``2 ** BITS`` rows, however many texts there are.
    """
    if not 0 < share < 1:
        return fresh(np.zeros(0, np.uint32), share).net
    counts = fit.select("text").mapInArrow(_document_counts, "bucket long, docs long").groupBy("bucket").agg(F.sum("docs").alias("docs"))
    keys = counts.where(F.col("docs") >= MIN_DOCS).select("bucket").toArrow().column(0).to_numpy()
    learner = fresh(np.sort(keys).astype(np.uint32), share)
    columns = [f"v{k}" for k in range(2 * SIZE)]
    for _ in range(EPOCHS):
        changes = fit.select("part", "y", "text").mapInArrow(_pass(learner), ", ".join(f"{c} long" for c in ["row", "parts", *columns]))
        means = [(F.sum(c) / UNIT / F.sum("parts")).cast("float").alias(c) for c in columns]
        got = changes.groupBy("row").agg(*means).select(F.col("row").cast("int"), *columns).toArrow()
        row = got.column(0).to_numpy()
        sparse, late = row >= 0, np.flatnonzero(row < 0)
        late = late[np.argsort(-row[late])]
        dense = np.empty((2, len(late), SIZE), np.float32)
        # A column at a time: what the driver holds beside the weights is one round's means.
        for k in range(2 * SIZE):
            column = got.column(1 + k).to_numpy()
            (learner.net.table if k < SIZE else learner.square)[row[sparse], k % SIZE] += column[sparse]
            dense[k // SIZE, :, k % SIZE] = column[late]
        del got, column, changes
        learner.net.table[0] = 0
        n = len(learner.dense_square)
        learner.net.set_dense(learner.net.dense() + dense[0].ravel()[:n])
        learner.dense_square += dense[1].ravel()[:n]
        shuffles_go(fit.sparkSession)
    return learner.net


def calibrated(net: Net, rows: DataFrame) -> dict:
    """Threshold by language (None: all) from a net's scores of all rows (y, text, lang)."""
    return thresholds(judged(net, rows))


def judged(net: Net, rows: DataFrame) -> DataFrame:
    """(y, lang, toxicity_score) of rows (y, text, lang)."""
    return scored(rows.select("y", "text", F.coalesce("lang", F.lit("")).alias("lang")), net).select("y", "lang", "toxicity_score")


def thresholds(rows: DataFrame) -> dict:
    """Threshold by language (None: all) from all rows (y, lang, toxicity_score).

    Counts of clean rows by language and grid step of the score come to the driver; steps are 1 / ``GRID`` wide.
    """
    at = F.floor(F.greatest(F.lit(THRESHOLD), F.least(F.col("toxicity_score"), F.lit(MOST))) * GRID)
    clean = (F.col("y") == 0).cast("long")
    got = rows.groupBy("lang", at.alias("step")).agg(F.count("*").alias("n"), F.sum(F.when(F.col("toxicity_score") >= THRESHOLD, clean).otherwise(0)).alias("alarms"), F.sum(clean).alias("clean")).collect()

    def least(mine: list) -> float:
        allowed, alarms = int(ALARMS * sum(r["clean"] for r in mine)), Counter()
        for r in mine:
            alarms[r["step"]] += r["alarms"]
        for step in sorted(alarms, reverse=True):
            allowed -= alarms[step]
            if allowed < 0:
                return min((step + 1) / GRID, MOST)
        return THRESHOLD

    by_lang: dict = {}
    for r in got:
        by_lang.setdefault(r["lang"], []).append(r)
    return {None: least(got)} | {g: least(mine) for g, mine in sorted(by_lang.items()) if g and sum(r["n"] for r in mine) >= 50}


def train(docs: DataFrame, labels: DataFrame) -> Net:
    """A net from every labelled row outside the held-out fold; every such row is fitted and calibrates."""
    with passing(docs.sparkSession):
        rows = labelled_parts(docs, labels, "toxic", PART_ROWS)
        shuffles_go(docs.sparkSession)
        half = F.pmod("part", F.lit(2))
        sizes = {h: (n, y) for h, n, y in rows.groupBy(half.alias("half")).agg(F.count("*"), F.sum("y")).collect()}
        halves = [rows.where(half == h) for h in sorted(sizes)]
        if len(sizes) == 2 and all(0 < y < n for n, y in sizes.values()):
            nets = [fitted(mine, sizes[h][1] / sizes[h][0]) for h, mine in enumerate(halves)]
            net = combined(nets)
            net.thresholds = thresholds(judged(nets[0], halves[1]).unionByName(judged(nets[1], halves[0])))
        else:
            n, positive = (sum(x) for x in zip((0, 0), *sizes.values()))
            net = fitted(rows, positive / n) if n else fresh(np.zeros(0, np.uint32), 0.5).net
            net.thresholds = calibrated(net, rows)
    return net


def _score(net: Net):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for step in text_steps(batches, step=SCORE_BYTES):
            score = net.score(*utf8(step.column(step.schema.get_field_index("text"))))
            yield pa.RecordBatch.from_arrays([*step.columns, pa.array(score, pa.float64())], [*step.schema.names, "toxicity_score"])

    return run


def scored(docs: DataFrame, net: Net) -> DataFrame:
    """docs with toxicity_score."""
    schema = ", ".join(f"`{n}` {t}" for n, t in docs.dtypes) + ", toxicity_score double"
    return docs.mapInArrow(_score(net), schema)


def threshold_of(net: Net, lang):
    """The calibrated threshold of a language column."""
    out = F.lit(float(net.thresholds[None]))
    for g, t in net.thresholds.items():
        if g is not None:
            out = F.when(lang == g, F.lit(float(t))).otherwise(out)
    return out


def score_toxicity(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, held_out, score, predicted and rejected (score above its language's threshold) of docs (doc_id, text, lang)."""
    lang = F.col("lang") if "lang" in docs.columns else F.lit(None).cast("string")
    rows = docs.select("doc_id", "text", lang.alias("lang"))
    net = train(rows, labels)
    out = scored(rows, net).withColumnRenamed("toxicity_score", "score")
    return out.select(
        "doc_id",
        held_out(F.col("doc_id")).alias("held_out"),
        "score",
        (F.col("score") >= THRESHOLD).cast("int").alias("predicted"),
        (F.col("score") >= threshold_of(net, F.col("lang"))).alias("rejected"),
    )


def op8_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The contract's columns for every document, and whether its language's threshold rejects it."""
    return score_toxicity(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/labels.parquet"))
