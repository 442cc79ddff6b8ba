"""What the two classifiers share: the labelled rows and the words of whole texts."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import Prefixes, mix, plain_rows, runs_of, written

FOLDS = 5
#: The bound of the labelled texts that reach the driver, in bytes.
TRAIN_BYTES = 48 << 20

#: Byte classes: 0 white space and control, 1 part of a word, 2 other marks.
_CLASS = np.full(256, 2, np.uint8)
_CLASS[:0x21] = 0
_CLASS[0x7F:] = 1
_CLASS[[*range(48, 58), *range(65, 91), *range(97, 123), 0x5F]] = 1
_UPPER = np.zeros(256, bool)
_UPPER[65:91] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32


def held_out(doc_id: Column) -> Column:
    """Whether a row is kept from learning: crc32 of doc_id as text, modulo 5, is 0."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % FOLDS == 0, F.lit(False))


def sample(docs: DataFrame, labels: DataFrame, label: str, rows: int, size: int = TRAIN_BYTES) -> list[tuple[str, str, int]]:
    """(text, lang, label) of at most ``rows`` labelled documents and ``size`` bytes outside the held-out fold, in hash order.

    The ids are chosen from the labels alone, so what is broadcast has at most ``rows`` rows. Of rows with
    one doc_id the smallest text counts. Texts go whole to the driver; one that passes what is left of ``size`` is left out, and the next ones follow.
    """
    marked = plain_rows(labels, "doc_id", label).where(f"doc_id is not null and `{label}` in (0, 1)").where(~held_out(F.col("doc_id")))
    marked = marked.groupBy("doc_id").agg(F.max(label).alias("y")).withColumn("turn", F.xxhash64("doc_id", F.lit(label)))
    chosen = marked.orderBy("turn", "doc_id").limit(rows)
    text = docs.select(F.col("doc_id"), F.col("text"), (F.col("lang") if "lang" in docs.columns else F.lit(None).cast("string")).alias("lang"))
    one = text.join(F.broadcast(chosen), "doc_id").groupBy("turn", "doc_id", "y").agg(F.min(F.struct(F.coalesce("text", F.lit("")).alias("text"), "lang")).alias("t"))
    one = written(one.select("turn", "doc_id", "y", "t.text", "t.lang"), "sample")
    # At most ``rows`` lengths.
    lengths = one.select("turn", "doc_id", F.octet_length("text").alias("n")).toPandas().sort_values(["turn", "doc_id"], kind="stable")
    fit, left = [], size
    for turn, doc_id, n in lengths.itertuples(index=False):
        if n <= left:
            fit.append((int(turn), int(doc_id)))
            left -= n
    fit = docs.sparkSession.createDataFrame(fit, "turn long, doc_id long")
    got = one.join(F.broadcast(fit), ["turn", "doc_id"]).select("turn", "doc_id", "text", "lang", "y").toPandas()
    got = got.sort_values(["turn", "doc_id"], kind="stable")
    return [(t or "", g, int(y)) for t, g, y in zip(got["text"], got["lang"], got["y"])]


def labelled_parts(docs: DataFrame, labels: DataFrame, label: str, part_rows: int) -> DataFrame:
    """A written table (part, turn, doc_id, y, text, lang) of every labelled document outside the held-out fold.

    A part has at most about ``part_rows`` rows, is in one file and lies there in the order of ``turn``; there are as
    many even as odd parts. Of rows with one doc_id the smallest text counts.
    """
    marked = plain_rows(labels, "doc_id", label).where(f"doc_id is not null and `{label}` in (0, 1)").where(~held_out(F.col("doc_id")))
    marked = marked.groupBy("doc_id").agg(F.max(label).cast("int").alias("y"))
    parts = 2 * max(1, -(-marked.count() // (2 * part_rows)))
    lang = F.col("lang") if "lang" in docs.columns else F.lit(None).cast("string")
    texts = docs.where("doc_id is not null").where(~held_out(F.col("doc_id"))).select("doc_id", F.struct(F.coalesce("text", F.lit("")).alias("text"), lang.alias("lang")).alias("t"))
    # Texts and labels of a part meet where the part is written: texts are shuffled once.
    both = texts.unionByName(marked, allowMissingColumns=True)
    both = both.withColumn("part", F.pmod(F.xxhash64("doc_id", F.lit("part")), F.lit(parts)).cast("int")).repartitionById(parts, "part")
    one = both.groupBy("part", "doc_id").agg(F.max("y").alias("y"), F.min("t").alias("t")).where("y is not null and t is not null")
    rows = one.select("part", F.xxhash64("doc_id", F.lit(label)).alias("turn"), "doc_id", "y", "t.text", "t.lang")
    return written(rows.sortWithinPartitions("part", "turn", "doc_id"), "labelled", compression="zstd")


def joined(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Texts as one byte array with row offsets."""
    raw = [t.encode("utf-8", "surrogatepass") for t in texts]
    return np.frombuffer(b"".join(raw), np.uint8), np.cumsum([0, *map(len, raw)])


def words(raw: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the lower-cased words of all rows (whole, first 4 and first 5 bytes: 3 x words), and each row's first word (n + 1 offsets)."""
    begin, end = runs_of(_CLASS[raw] == 1, off)
    sums = Prefixes(_LOWER[raw])
    parts = [sums.hash(begin, end)] + [mix(sums.hash(begin, np.minimum(begin + n, end)) + np.uint64(n)) for n in (4, 5)]
    return np.stack(parts), np.searchsorted(begin, off)


def tokens_and_shapes(raw: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(token hashes, shape hashes, each row's first token): words and runs of marks, case kept.

    A word's shape is its case pattern, or that it repeats the word before; a mark's shape is itself.
    """
    kind = _CLASS[raw]
    b1, e1 = runs_of(kind == 1, off)
    b2, e2 = runs_of(kind == 2, off)
    begin = np.concatenate([b1, b2])
    order = np.argsort(begin, kind="stable")
    begin, end = begin[order], np.concatenate([e1, e2])[order]
    is_word = order < len(b1)
    token = Prefixes(raw).hash(begin, end)
    upper = np.concatenate([[0], np.cumsum(_UPPER[raw])])
    caps = upper[end] - upper[begin]
    digit = (raw[begin] >= 48) & (raw[begin] <= 57) if len(begin) else np.zeros(0, bool)
    shape = 1 + (caps > 0) + (caps > 1).astype(np.int64) + 4 * digit
    at = np.flatnonzero(is_word)
    again = np.zeros(len(token), bool)
    again[at[1:]] = token[at[1:]] == token[at[:-1]]
    shape = np.where(again, 16, shape).astype(np.uint64)
    return token, np.where(is_word, shape, token), np.searchsorted(begin, off)
