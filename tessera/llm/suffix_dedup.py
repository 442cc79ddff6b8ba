"""Suffix-array dedup: remove every byte that a long string covers which also starts earlier.

The method merges Burrows-Wheeler transforms. Spark deals the work so that a merge is local:

1. **Deal.** Every window of ``length`` bytes has a minimiser, the smallest hash of its
   ``gram``-byte substrings. Equal windows have equal minimisers, so neighbouring windows with one
   minimiser make a segment, and all copies of a window meet in the bucket of that minimiser.
   Minimisers that occur once cannot hold a repeat and go no further. A minimiser is dealt once
   from each step of a task, and equal segments are one row (the earliest place) from each, so a
   passage that a third of the rows hold doesn't gather in one task. A minimiser with over ``HOT``
   segments is split: its windows are dealt by where they hold the minimiser, in steps of ``PART``, and
   by the hash of the bytes that all windows of such a step share, on which equal windows agree.
2. **Merge.** In a bucket, runs of segments are shards. A shard's transform lists, for every round,
   the symbol before each of its sorted suffixes; a symbol is ``length / 5`` bytes. The merge
   refines an interleave (which shard does the next suffix come from): a round reads the next symbol
   of each shard in the interleave's order and deals the shards' numbers out by symbol, stably. Five
   rounds order all suffixes by their first ``length`` bytes; no suffixes are sorted again. Borders
   that never rose are common prefixes of at least ``length`` bytes, and the runs between borders
   are the repeated intervals.
3. **Remove.** In each interval the smallest (doc_id, start) stays; every other window is covered.

A null or empty text has nothing to remove. Rows with one doc_id count as one document each, and the
smaller text comes first among them; a row without doc_id takes no part and keeps its text. An empty table gives no rows; extra columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm.common import Prefixes, hand_back, mix, passing, text_steps, utf8, written

LENGTH = 100
GRAM = 24
#: Windows that one merge takes at a time; a larger minimiser group goes alone.
MERGE_WINDOWS = 1 << 16
SHARDS = 4
ROUNDS = 5
HOT = 1 << 14
PART = 26


# ---------------------------------------------------------------- 1. deal


def segments_of(raw: np.ndarray, off: np.ndarray, length: int = LENGTH, gram: int = GRAM) -> tuple[np.ndarray, ...]:
    """(row, start in row, windows, minimiser) of the segments of every row, in order."""
    span = length - gram + 1
    n = len(raw)
    none = np.zeros(0, np.int64)
    if n < length:
        return none, none, none, np.zeros(0, np.uint64)
    marks = Prefixes(raw).grams(gram)
    # The place in the low half: the leftmost of equal minima, so a run has one occurrence of it.
    low = (marks & np.uint64(0xFFFFFFFF00000000)) | np.arange(len(marks), dtype=np.uint64)
    width = 1
    while width * 2 <= span:
        low = np.minimum(low[: len(low) - width], low[width:])
        width *= 2
    if width < span:
        low = np.minimum(low[: len(low) - (span - width)], low[span - width :])
    sizes = np.diff(off)
    counts = np.maximum(sizes - length + 1, 0)
    rows = np.repeat(np.arange(len(sizes)), counts)
    if len(rows) == 0:
        return none, none, none, np.zeros(0, np.uint64)
    place = np.arange(len(rows)) - np.repeat(np.cumsum(counts) - counts, counts)
    low = low[off[rows] + place]
    fresh = np.ones(len(rows), bool)
    fresh[1:] = (low[1:] != low[:-1]) | (rows[1:] != rows[:-1])
    begin = np.flatnonzero(fresh)
    size = np.diff(np.append(begin, len(rows)))
    return rows[begin], place[begin], size, marks[low[begin] & np.uint64(0xFFFFFFFF)]


#: Kinds of a dealt block: minimisers that occur once in their step, the first places of those that
#: occur more often there, and these ones' other places.
ONCE, OFTEN, REST = 0, 1, 2


def _deal(length: int, gram: int, buckets: int):
    """Blocks of (minimiser, row_id, place), one for each bucket, kind and step.

    What occurs twice in a step is known to be shared: one place of it goes to the bucket of the
    minimiser, so that others learn of it, and the rest to a bucket of the step's own.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for step in text_steps(batches):
            raw, off = utf8(step.column(1))
            row, start, size, low = segments_of(raw, off, length, gram)
            if len(row) == 0:
                continue
            ids = step.column(0).to_numpy(zero_copy_only=False)[row]
            place = (start << 8) | size
            order = np.argsort(low, kind="stable")
            low, ids, place = low[order], ids[order], place[order]
            first = np.ones(len(low), bool)
            first[1:] = low[1:] != low[:-1]
            alone = first & np.append(first[1:], True)
            kind = np.where(alone, ONCE, np.where(first, OFTEN, REST))
            bucket = np.where(kind == REST, int(low[len(low) // 2] % np.uint64(buckets)), (low % np.uint64(buckets)).astype(np.int64))
            part = bucket * 3 + kind
            order = np.argsort(part, kind="stable")
            names, begin = np.unique(part[order], return_index=True)
            cuts = [order[a:b] for a, b in zip(begin, np.append(begin[1:], len(order)))]
            columns = [pa.array([x[c].tobytes() for c in cuts], pa.binary()) for x in (low.view(np.int64), ids.astype(np.int64), place)]
            yield pa.RecordBatch.from_arrays([pa.array(names // 3), pa.array(names % 3), *columns], ["bucket", "kind", "h", "row_id", "place"])

    return run


def _shared(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The places whose minimiser occurs more than once, of blocks in bucket order."""

    def out(held: list[tuple]) -> pa.RecordBatch:
        kind = np.concatenate([np.full(len(h) // 8, k, np.int8) for k, h, _, _ in held])
        h, ids, place = (np.frombuffer(b"".join(x[i] for x in held), np.int64) for i in (1, 2, 3))
        order = np.argsort(h, kind="stable")
        s = h[order]
        begin = np.flatnonzero(np.append(True, s[1:] != s[:-1]))
        size = np.diff(np.append(begin, len(s)))
        many = (size > 1) | np.maximum.reduceat(kind[order] == OFTEN, begin)
        take = order[np.repeat(many, size)]
        return pa.RecordBatch.from_arrays([pa.array(ids[take]), pa.array(place[take]), pa.array(h[take])], ["row_id", "place", "h"])

    now, held = None, []
    for batch in batches:
        for bucket, kind, h, ids, place in zip(*(batch.column(i).to_pylist() for i in range(5))):
            if bucket != now and held:
                yield out(held)
                held = []
            now = bucket
            if kind == REST:
                yield pa.RecordBatch.from_arrays([pa.array(np.frombuffer(x, np.int64)) for x in (ids, place, h)], ["row_id", "place", "h"])
            else:
                held.append((kind, h, ids, place))
    if held:
        yield out(held)
    del held
    hand_back()


def _cut(length: int):
    """Rows (row_id, text, places) to the segments' bytes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for step in text_steps(batches):
            raw, off = utf8(step.column(1))
            ids = step.column(0).to_numpy(zero_copy_only=False)
            lists = step.column(2)
            places = lists.flatten().field("place").to_numpy(zero_copy_only=False)
            marks = lists.flatten().field("h").to_numpy(zero_copy_only=False)
            row = np.repeat(np.arange(step.num_rows), lists.value_lengths().to_numpy(zero_copy_only=False))
            begin = off[row] + (places >> 8)
            end = begin + (places & 255) + length - 1
            inside = end <= off[row + 1]  # a row that shares its doc_id with a longer one
            row, places, marks, begin, end = row[inside], places[inside], marks[inside], begin[inside], end[inside]
            if len(row) == 0:
                continue
            same = Prefixes(raw).hash(begin, end).view(np.int64)
            # The earliest of equal segments in this step stays (rows come in no order).
            order = np.lexsort((places, ids[row], same, marks))
            first = np.ones(len(order), bool)
            first[1:] = (same[order][1:] != same[order][:-1]) | (marks[order][1:] != marks[order][:-1])
            take = order[first]
            size = (end - begin)[take]
            to = np.concatenate([[0], np.cumsum(size)])
            data = raw[np.repeat(begin[take] - to[:-1], size) + np.arange(to[-1])]
            seg = pa.Array.from_buffers(pa.binary(), len(take), [None, pa.py_buffer(to.astype(np.int32).tobytes()), pa.py_buffer(data.tobytes())])
            yield pa.RecordBatch.from_arrays([pa.array(marks[take]), pa.array(same[take]), pa.array(ids[row][take]), pa.array(places[take]), seg], ["h", "same", "row_id", "place", "seg"])

    return run


def _split(length: int, gram: int):
    """Rows (h, same, row_id, place, seg, hot) to the same with orig (the place as dealt): a hot minimiser's windows under keys of their own."""

    def parts(mark: int, row: int, place: int, seg: bytes) -> Iterator[tuple]:
        raw = np.frombuffer(seg, np.uint8)
        start, size = place >> 8, place & 255
        sums = Prefixes(raw)
        at = np.arange(len(raw) - gram + 1)
        # The minimiser is the first place of its hash in the segment.
        m = int(np.argmax(sums.hash(at, at + gram).view(np.int64) == mark))
        for k in range((m - size + 1) // PART, m // PART + 1):
            low, high = max(m - PART * k - PART + 1, 0), min(m - PART * k, size - 1)
            a, b = np.array([m - PART * k, low]), np.array([m - PART * k - PART + 1 + length, high + length])
            key, same = sums.hash(a, b).view(np.int64).tolist()
            new = int(mix(np.array([(key ^ mark) & 0xFFFFFFFFFFFFFFFF], np.uint64) + np.uint64(k))[0].astype(np.int64))
            yield new, same, row, (start + low) << 8 | (high - low + 1), raw[low : high + length].tobytes(), place

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["h", "same", "row_id", "place", "seg", "orig"]
        for batch in batches:
            hot = batch.column(5).is_valid()
            cool = batch.filter(pa.compute.invert(hot))
            if cool.num_rows:
                yield pa.RecordBatch.from_arrays([*cool.columns[:5], cool.column(3)], names)
            for begin in range(0, batch.num_rows, 256):
                some = batch.slice(begin, 256).filter(hot.slice(begin, 256))
                out = [p for h, r, s, g in zip(*(some.column(i).to_pylist() for i in (0, 2, 3, 4))) for p in parts(h, r, s, g)]
                if out:
                    kinds = [pa.int64()] * 4 + [pa.binary(), pa.int64()]
                    yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out), kinds)], names)

    return run


# ---------------------------------------------------------------- 2. merge


def _named(values: np.ndarray) -> np.ndarray:
    """Dense names of the values, in 16 bits where they fit: short sort keys."""
    names = np.unique(values, return_inverse=True)[1]
    return names.astype(np.uint16 if len(names) < 65536 else np.uint32)


def block_names(raw: np.ndarray, size: int) -> np.ndarray:
    """For each place, the name of the ``size`` bytes from there: equal names, equal bytes."""

    def joined(a: np.ndarray, b: np.ndarray) -> np.ndarray:
        return _named((a.astype(np.uint64) << np.uint64(32)) | b)

    padded = np.concatenate([raw, np.zeros(size, np.uint8)])
    names, width, rest, done = padded.astype(np.uint64), 1, None, 0
    names = _named(padded)
    while True:
        if size & width:
            rest, done = (names, width) if rest is None else (joined(rest[: len(rest) - width], names[done:][: len(rest) - width]), done + width)
        if width * 2 > size:
            break
        names = joined(names[: len(names) - width], names[width:])
        width *= 2
    return rest[: len(raw)]


def shard_transform(names: np.ndarray, starts: np.ndarray, symbol: int, rounds: int) -> tuple[np.ndarray, np.ndarray]:
    """(transform, order) of one shard: its suffixes' preceding symbols in every round, and the final order of its windows."""
    order = np.arange(len(starts))
    columns = np.empty((rounds, len(starts)), names.dtype)
    for k in range(rounds):
        before = names[starts[order] + symbol * (rounds - 1 - k)]
        columns[k] = before
        order = order[np.argsort(before, kind="stable")]
    return columns, order


def merge_transforms(parts: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """(interleave, fresh) of the shards' transforms: whose window comes next, and whether it differs from the one before.

    The interleave starts as the shards one after another, for suffixes of no bytes. A round reads the
    symbols in the interleave's order and deals the shard numbers out by symbol; a border rises
    between suffixes of unequal symbols or whose rests had a border between them.
    """
    sizes = [x.shape[1] for x in parts]
    interleave = np.repeat(np.arange(len(parts), dtype=np.uint8), sizes)
    group = np.zeros(len(interleave), np.int64)
    for k in range(parts[0].shape[0]):
        symbols = np.empty(len(interleave), parts[0].dtype)
        for s, part in enumerate(parts):
            symbols[interleave == s] = part[k]
        order = np.argsort(symbols, kind="stable")
        interleave, symbols, group = interleave[order], symbols[order], group[order]
        fresh = np.ones(len(order), bool)
        fresh[1:] = (symbols[1:] != symbols[:-1]) | (group[1:] != group[:-1])
        group = np.cumsum(fresh)
    return interleave, fresh


def repeated_windows(raw: np.ndarray, starts: np.ndarray, key: np.ndarray, shard_of: np.ndarray, length: int) -> np.ndarray:
    """True for each window (starts, in key order) that is not the first of its interval; keys rise within a shard and between shards."""
    symbol = length // ROUNDS
    names = block_names(raw, symbol)
    parts, finals = [], []
    for s in np.unique(shard_of):
        mine = np.flatnonzero(shard_of == s)
        columns, order = shard_transform(names, starts[mine], symbol, ROUNDS)
        parts.append(columns)
        finals.append(mine[order])
    interleave, fresh = merge_transforms(parts)
    merged = np.empty(len(starts), np.int64)
    for s, final in enumerate(finals):
        merged[interleave == s] = final
    interval = np.cumsum(fresh) - 1
    least = np.minimum.reduceat(key[merged], np.flatnonzero(fresh))
    out = np.empty(len(starts), bool)
    out[merged] = key[merged] != least[interval]
    return out


def _flush(rows: pa.Table, length: int) -> pa.RecordBatch:
    """Rows (row_id, place, begin, end): each first segment's place, with no span, and the spans of its repeated windows."""
    ids, place = rows.column("row_id").to_numpy(), rows.column("place").to_numpy()
    marks, same = rows.column("h").to_numpy(), rows.column("same").to_numpy()
    # Equal segments from several steps: the earliest stands for all.
    order = np.lexsort((place, ids, same, marks))
    first = np.ones(len(order), bool)
    first[1:] = (same[order][1:] != same[order][:-1]) | (marks[order][1:] != marks[order][:-1])
    # A part of a segment says that the segment isn't covered as a whole, and is covered itself if an equal one is earlier.
    orig = rows.column("orig").to_numpy()
    part = np.flatnonzero(orig != place)
    told_ids, told = ids[part], orig[part]
    twice = order[~first]
    twice = twice[orig[twice] != place[twice]]
    twice_ids, twice_begin = ids[twice], place[twice] >> 8
    twice_end = twice_begin + (place[twice] & 255) + length - 1
    rows = rows.take(pa.array(np.sort(order[first])))
    ids, place = rows.column("row_id").to_numpy(), rows.column("place").to_numpy()
    raw, off = utf8(rows.column("seg"))
    size = place & 255
    order = np.lexsort((place, ids))  # earliest first; shards are runs of this order
    seg = np.repeat(order, size[order])
    inner = np.arange(len(seg)) - np.repeat(np.cumsum(size[order]) - size[order], size[order])
    real = (place[seg] >> 8) + inner
    # A window's key is its rank by (document, start).
    rank = np.lexsort((real, ids[seg]))
    key = np.empty(len(seg), np.int64)
    key[rank] = np.arange(len(seg))
    shard_of = (np.arange(len(seg)) * SHARDS) // max(len(seg), 1)
    hit = repeated_windows(raw, off[seg] + inner, key, shard_of, length)
    hits = rank[hit[rank]]
    doc, at = ids[seg][hits], real[hits]
    new = np.ones(len(hits), bool)
    new[1:] = (doc[1:] != doc[:-1]) | (at[1:] != at[:-1] + 1)
    begin = np.flatnonzero(new)
    last = np.append(begin[1:], len(hits))[: len(begin)] - 1
    none = lambda x: np.full(len(x), -1)
    columns = [
        np.concatenate(x)
        for x in (
            (ids, told_ids, doc[begin], twice_ids),
            (place, told, none(begin), none(twice)),
            (none(ids), none(told), at[begin], twice_begin),
            (none(ids), none(told), at[last] + length, twice_end),
        )
    ]
    return pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in columns], ["row_id", "place", "begin", "end"])


def _merge(length: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        windows = 0
        for batch in batches:
            if batch.num_rows == 0:
                continue
            marks = batch.column(0).to_numpy()
            sizes = np.cumsum(batch.column(3).to_numpy() & 255)
            borders = np.flatnonzero(marks[1:] != marks[:-1]) + 1  # groups are never split
            begin = 0
            if held and held[-1].column(0)[-1].as_py() != marks[0]:
                borders = np.concatenate([[0], borders])
            for end in borders.tolist():
                here = int(sizes[end - 1] - (sizes[begin - 1] if begin else 0)) if end else 0
                if windows + here >= MERGE_WINDOWS:
                    held.append(batch.slice(begin, end - begin))
                    yield _flush(pa.Table.from_batches(held), length)
                    held, windows, begin = [], 0, end
            if begin < batch.num_rows:
                held.append(batch.slice(begin))
                windows += int(sizes[-1] - (sizes[begin - 1] if begin else 0))
        if held:
            yield _flush(pa.Table.from_batches(held), length)
        del held
        hand_back()

    return run


# ---------------------------------------------------------------- 3. remove


def _strip(length: int, carry: list[str]):
    """Rows (doc_id, text, places, firsts, spans, carried) to the removal's figures and, if columns are carried, the kept text and these."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for step in text_steps(batches):
            raw, off = utf8(step.column(1))
            whole, firsts, spans = (step.column(k).to_pylist() for k in (2, 3, 4))
            figures, texts = [], []
            for i in range(step.num_rows):
                text = raw[off[i] : off[i + 1]]
                n = len(text)
                own = set(firsts[i] or [])
                covers = [(c["begin"], c["end"]) for c in spans[i] or []]
                covers += [(p >> 8, (p >> 8) + (p & 255) + length - 1) for p in whole[i] or [] if p not in own]
                rise = np.zeros(n + 1, np.int64)
                if covers:
                    begin, end = np.minimum(np.array(covers).T, n)
                    np.add.at(rise, begin, 1)
                    np.add.at(rise, end, -1)
                gone = np.cumsum(rise)[:n] > 0
                runs = int(gone[0] + (gone[1:] & ~gone[:-1]).sum()) if n else 0
                kept = text[~gone].tobytes() if runs else text.tobytes()
                figures.append((n, int(gone.sum()), runs, hashlib.sha256(kept).hexdigest()))
                texts.append(kept.decode("utf-8", "ignore"))
            columns = [step.column(0), *map(pa.array, zip(*figures))]
            names = ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"]
            if carry:
                columns += [pa.array(texts, pa.string()), *step.columns[5:]]
                names += ["kept", *carry]
            yield pa.RecordBatch.from_arrays(columns, names)

    return run


def remove_repeats(docs: DataFrame, length: int = LENGTH, gram: int = GRAM, carry: list[str] | None = None, hot_segments: int = HOT) -> DataFrame:
    """Per row of docs (doc_id, text): doc_id, n_bytes, n_removed, n_spans, kept_sha256 and, if columns are carried, the kept text and these.

    Removal is by bytes, so a kept text drops the bytes of characters that a
    border cuts through; ``kept_sha256`` is of the exact bytes.
    """
    if not gram < length or length % ROUNDS or length - gram + 1 > 255:
        raise ValueError("length must be a multiple of 5, above gram, and at most gram + 254")
    carry = carry or []
    every = docs.select("doc_id", "text", *[F.col(f"`{c}`").alias(f"carried_{c}") for c in carry])
    named = every.where("doc_id is not null")
    if named.groupBy("doc_id").count().where("count > 1").isEmpty():
        every = every.withColumn("row_id", F.col("doc_id"))
    else:
        # Numbers in the order of doc_id and text, written once.
        order = named.repartitionByRange("doc_id", "text").sortWithinPartitions("doc_id", "text")
        numbered = order.withColumn("row_id", F.monotonically_increasing_id()).unionByName(every.where("doc_id is null").withColumn("row_id", F.lit(None).cast("long")))
        every = written(numbered, "numbered")
    rows = every.where("row_id is not null").select("row_id", "text")
    buckets = 4 * int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    blocks = rows.where(F.octet_length("text") >= length).mapInArrow(_deal(length, gram, buckets), "bucket long, kind long, h binary, row_id binary, place binary")
    hits = blocks.repartition("bucket").sortWithinPartitions("bucket").mapInArrow(_shared, "row_id long, place long, h long")
    with passing(docs.sparkSession, "covers"):
        covers = _covers(rows, hits, length, gram, hot_segments)
    kinds = dict(docs.dtypes)
    schema = f"doc_id {kinds['doc_id']}, n_bytes long, n_removed long, n_spans long, kept_sha256 string" + ", kept string" * bool(carry) + "".join(f", `{c}` {kinds[c]}" for c in carry)
    joined = every.join(covers, "row_id", "left").select("doc_id", "text", "places", "firsts", "spans", *[f"carried_{c}" for c in carry])
    return joined.mapInArrow(_strip(length, carry), schema)


def _covers(rows: DataFrame, hits: DataFrame, length: int, gram: int, hot_segments: int) -> DataFrame:
    """A written table (row_id, places, firsts, spans) of rows (row_id, text) and the shared places (row_id, place, h)."""
    places = written(hits.groupBy("row_id").agg(F.collect_list(F.struct("place", "h")).alias("places")), "places")
    cut = rows.join(places, "row_id").select("row_id", "text", "places").mapInArrow(_cut(length), "h long, same long, row_id long, place long, seg binary")
    hot = written(places.select(F.explode("places.h").alias("h")).groupBy("h").agg(F.count("*").alias("hot")).where(F.col("hot") > hot_segments), "hot")
    marked = cut.join(hot, "h", "left").select("h", "same", "row_id", "place", "seg", "hot")
    parts = marked.mapInArrow(_split(length, gram), "h long, same long, row_id long, place long, seg binary, orig long")
    merged = parts.repartition("h").sortWithinPartitions("h").mapInArrow(_merge(length), "row_id long, place long, begin long, end long")
    found = merged.groupBy("row_id").agg(
        F.collect_list(F.when(F.col("place") >= 0, F.col("place"))).alias("firsts"),
        F.collect_list(F.when(F.col("place") < 0, F.struct("begin", "end"))).alias("spans"),
    )
    covers = places.select("row_id", F.transform("places", lambda p: p["place"]).alias("places")).join(found, "row_id", "left")
    return written(covers, "covers")


def op2_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The contract's columns for every document."""
    out = remove_repeats(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return out.select("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256")
