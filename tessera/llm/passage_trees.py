"""Substring dedup by words: remove the words of every long passage that a document with a smaller doc_id holds too.

The method is that of prefix-partitioned suffix trees. A window is ``length`` consecutive words.

1. **Anchors.** A window's anchor is its ``gram``-word string with the smallest hash, so the copies of a
   window have their anchors at one offset, and the suffixes there share a prefix. Neighbouring windows
   with one anchor are a segment. Equal segments are one leaf (the smallest doc_id stands for it: partial
   minima in each task), and a segment of a later document is removed whole. A prefix of which only one document,
   or only one kind of segment, is left needs no tree.
2. **Prefixes of variable length.** The suffixes of one prefix are a group. A prefix with more than
   ``group`` different segments is made longer: its windows are dealt into parts by a third of the
   offsets from the anchor, each by all the words that the windows of such a part have in common, and at last by
   all words of a window. Only such segments are dealt again, so no group grows with the table.
3. **Subtrees.** A task takes groups up to ``WINDOWS`` suffixes at a time, names their words' strings of 1, 2, 4, ...
   32 words, orders the suffixes by these names and measures the common prefixes of neighbours.
   Internal nodes at a depth of ``length`` words or more are the repeats; at each of them the suffixes of the smallest doc_id stay.

Words are compared by 64-bit hashes. A null or empty text has no words. Rows that share a doc_id are
judged against smaller doc_ids only, never against each other; a row without doc_id takes no part and keeps its words. An
empty table gives no rows; extra columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm.common import Prefixes, runs_of, text_steps, utf8, written

LENGTH = 50
GRAM = 10
#: Different segments that the suffixes of one prefix may have before it is made longer.
GROUP = 512
#: Suffixes that one subtree takes; a larger group goes alone.
WINDOWS = 1 << 16

_SPACE = np.zeros(256, bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True
#: Bytes above which a word has a cryptographic hash: polynomials can be made to agree on long words.
_LONG = 256


def words_of(raw: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Hashes of all rows' words, where each begins and ends, and each row's first word (n + 1 offsets)."""
    begin, end = runs_of(~_SPACE[raw], off)
    found = Prefixes(raw).hash(begin, end)
    for i in np.flatnonzero(end - begin > _LONG).tolist():
        found[i] = int.from_bytes(hashlib.blake2b(raw[begin[i] : end[i]].tobytes(), digest_size=8).digest(), "little")
    return found, begin, end, np.searchsorted(begin, off)


def segments_of(hashes: np.ndarray, first: np.ndarray, length: int, gram: int) -> tuple[np.ndarray, ...]:
    """(row, first window, windows, anchor's place, anchor's hash) of each row's segments, in order; places count all rows' words."""
    n = len(hashes)
    counts = np.maximum(np.diff(first) - length + 1, 0)
    rows = np.repeat(np.arange(len(counts)), counts)
    if len(rows) == 0:
        return (np.zeros(0, np.int64),) * 4 + (np.zeros(0, np.uint64),)
    at = np.arange(n - gram + 1)
    marks = Prefixes(hashes).hash(at, at + gram)
    # The place in the low half: the leftmost of equal minima.
    low = (marks & np.uint64(0xFFFFFFFF00000000)) | at.astype(np.uint64)
    span, width = length - gram + 1, 1
    while width * 2 <= span:
        low = np.minimum(low[: len(low) - width], low[width:])
        width *= 2
    if width < span:
        low = np.minimum(low[: len(low) - (span - width)], low[span - width :])
    start = first[rows] + np.arange(len(rows)) - np.repeat(np.cumsum(counts) - counts, counts)
    low = low[start]
    fresh = np.ones(len(rows), bool)
    fresh[1:] = (low[1:] != low[:-1]) | (rows[1:] != rows[:-1])
    lead = np.flatnonzero(fresh)
    anchor = (low[lead] & np.uint64(0xFFFFFFFF)).astype(np.int64)
    return rows[lead], start[lead], np.diff(np.append(lead, len(rows))), anchor, marks[anchor]


_PLACES = "h long, same long, doc_id long, version long, place long"


def _anchors(length: int, gram: int):
    """Rows (doc_id, version, text) to their segments: anchor's hash, hash of all words, place (first word << 8 | windows)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for step in text_steps(batches):
            raw, off = utf8(step.column(2))
            hashes, _, _, first = words_of(raw, off)
            row, start, size, _, mark = segments_of(hashes, first, length, gram)
            if len(row) == 0:
                continue
            same = Prefixes(hashes).hash(start, start + size + length - 1)
            ids, versions = (step.column(i).to_numpy(zero_copy_only=False)[row] for i in (0, 1))
            place = (start - first[row]) << 8 | size
            yield pa.RecordBatch.from_arrays([pa.array(x) for x in (mark.view(np.int64), same.view(np.int64), ids, versions, place)], ["h", "same", "doc_id", "version", "place"])

    return run


def _judged(segments: DataFrame, group: int) -> DataFrame:
    """Segments whose prefix several documents share, with lo, the smallest doc_id of their kind, and fate.

    fate: 'gone' (the same words are in a smaller doc_id), 'tree' (others share the prefix), 'long' (more than group kinds share it).
    """
    kinds = segments.groupBy("h", "same").agg(F.min("doc_id").alias("lo"), F.max("doc_id").alias("hi"))
    shared = kinds.groupBy("h").agg(F.count("*").alias("kinds"), F.min("lo").alias("least"), F.max("hi").alias("most")).where("least < most")
    # Written, so that a prefix with very many kinds is a plain side of the join, which Spark can split.
    shared = written(shared, "shared")
    told = kinds.join(shared, "h").select("h", "same", "lo", "kinds")
    fate = F.when(F.col("doc_id") > F.col("lo"), "gone").when(F.col("kinds") > group, "long").when(F.col("kinds") > 1, "tree")
    return segments.join(told, ["h", "same"]).withColumn("fate", fate).where("fate is not null").drop("lo", "kinds", "same")


def _cut(length: int):
    """Rows (doc_id, version, text, places) to the segments' bytes, of those not gone."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for step in text_steps(batches):
            raw, off = utf8(step.column(2))
            _, begin, end, first = words_of(raw, off)
            lists = step.column(3)
            fields = lists.flatten()
            marks, place = (fields.field(k).to_numpy(zero_copy_only=False) for k in ("h", "place"))
            row = np.repeat(np.arange(step.num_rows), lists.value_lengths().to_numpy(zero_copy_only=False))
            if len(row) == 0:
                continue
            lead = first[row] + (place >> 8)
            a, b = begin[lead], end[lead + (place & 255) + length - 2]
            to = np.concatenate([[0], np.cumsum(b - a)])
            data = raw[np.repeat(a - to[:-1], b - a) + np.arange(to[-1])]
            seg = pa.Array.from_buffers(pa.binary(), len(row), [None, pa.py_buffer(to.astype(np.int32).tobytes()), pa.py_buffer(data.tobytes())])
            ids, versions = (step.column(i).to_numpy(zero_copy_only=False)[row] for i in (0, 1))
            columns = [pa.array(marks), pa.array(ids), pa.array(versions), pa.array(place), seg, fields.field("fate")]
            yield pa.RecordBatch.from_arrays(columns, ["h", "doc_id", "version", "place", "seg", "fate"])

    return run


def _longer(length: int, gram: int, width: int):
    """Segments to parts of ``width`` offsets from the anchor, under the hash of the words that all windows of such a part hold."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for step in text_steps(batches, "seg"):
            raw, off = utf8(step.column(4))
            hashes, begin, end, first = words_of(raw, off)
            row, start, size, anchor, _ = segments_of(hashes, first, length, gram)
            back = anchor - start  # of the first window; the anchor of each next one is a word nearer
            lowest = (back - size + 1) // width
            parts = back // width - lowest + 1
            of = np.repeat(np.arange(len(row)), parts)
            k = np.arange(len(of)) - np.repeat(np.cumsum(parts) - parts, parts) + lowest[of]
            lead = np.maximum(anchor[of] - k * width - width + 1, start[of])
            last = np.minimum(anchor[of] - k * width, start[of] + size[of] - 1)
            held = Prefixes(hashes)
            common = anchor[of] - k * width
            mark = held.hash(common, common + length - width + 1) + (k % 256).astype(np.uint64)
            same = held.hash(lead, last + length)
            ids, versions, place = (step.column(i).to_numpy(zero_copy_only=False)[row[of]] for i in (1, 2, 3))
            place = ((place >> 8) + lead - first[row[of]]) << 8 | (last - lead + 1)
            seg = [raw[a:b].tobytes() for a, b in zip(begin[lead].tolist(), end[last + length - 1].tolist())]
            columns = [pa.array(x) for x in (mark.view(np.int64), same.view(np.int64), ids, versions, place)]
            yield pa.RecordBatch.from_arrays([*columns, pa.array(seg, pa.binary())], ["h", "same", "doc_id", "version", "place", "seg"])

    return run


def names_by_doubling(hashes: np.ndarray, most: int) -> dict[int, np.ndarray]:
    """For each power of two up to ``most``, names of the strings of so many words from each place: equal names, equal words."""
    names = {1: np.unique(hashes, return_inverse=True)[1].astype(np.int64)}
    width = 1
    while width * 2 <= most:
        now = names[width]
        after = np.full(len(now), -1)
        after[: len(now) - width] = now[width:]
        width *= 2
        names[width] = np.unique(now * (len(now) + 1) + after, return_inverse=True)[1]
    return names


def subtree(hashes: np.ndarray, starts: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray]:
    """(order, depth): the suffixes' order by their first ``length`` words, and how many words each shares with the one before it there.

    An internal node of the tree is a run of the order between smaller depths.
    """
    names = names_by_doubling(hashes, length)
    widths = sorted(names, reverse=True)
    keys, at = [], starts
    for w in widths:
        if length & w:
            keys.append(names[w][at])
            at = at + w
    order = np.lexsort(keys[::-1])
    a, b = starts[order][:-1], starts[order][1:]
    depth = np.zeros(len(order), np.int64)
    for w in widths:
        inside = np.maximum(a, b) + depth[1:] + w <= len(hashes)
        i, j = np.minimum(a + depth[1:], len(hashes) - 1), np.minimum(b + depth[1:], len(hashes) - 1)
        depth[1:] += w * (inside & (names[w][i] == names[w][j]))
    return order, depth


def _flush(rows: pa.Table, length: int) -> pa.RecordBatch:
    """Rows (doc_id, version, begin, end): the spans of words that a smaller doc_id holds too."""
    ids, versions, place = (rows.column(c).to_numpy() for c in ("doc_id", "version", "place"))
    raw, off = utf8(rows.column("seg"))
    hashes, _, _, first = words_of(raw, off)
    size = place & 255
    seg = np.repeat(np.arange(len(size)), size)
    inner = np.arange(len(seg)) - np.repeat(np.cumsum(size) - size, size)
    order, depth = subtree(hashes, first[seg] + inner, length)
    node = np.flatnonzero(depth < length)  # the deep nodes begin where little is shared with the suffix before
    doc = ids[seg][order]
    least = np.minimum.reduceat(doc, node)
    hit = order[doc > np.repeat(least, np.diff(np.append(node, len(order))))]
    of, at = seg[hit], (place[seg[hit]] >> 8) + inner[hit]
    by = np.lexsort((at, versions[of], ids[of]))
    of, at = of[by], at[by]
    new = np.ones(len(at), bool)
    new[1:] = (ids[of][1:] != ids[of][:-1]) | (versions[of][1:] != versions[of][:-1]) | (at[1:] > at[:-1] + 1)
    begin = np.flatnonzero(new)
    last = np.append(begin[1:], len(at))[: len(begin)] - 1
    return pa.RecordBatch.from_arrays([pa.array(x) for x in (ids[of[begin]], versions[of[begin]], at[begin], at[last] + length)], ["doc_id", "version", "begin", "end"])


def _trees(length: int):
    """Segments in the order of their prefixes to spans, a subtree for every ``WINDOWS`` suffixes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        suffixes = 0
        for batch in batches:
            marks = batch.column(0).to_numpy()
            sizes = np.cumsum(batch.column(3).to_numpy() & 255)
            cuts = (np.flatnonzero(marks[1:] != marks[:-1]) + 1).tolist()  # a prefix is never cut
            if held and len(marks) and held[-1].column(0)[-1].as_py() != marks[0]:
                cuts = [0, *cuts]
            begin = 0
            for cut in cuts:
                here = int(sizes[cut - 1] - (sizes[begin - 1] if begin else 0)) if cut else 0
                if suffixes + here >= WINDOWS:
                    yield _flush(pa.Table.from_batches([*held, batch.slice(begin, cut - begin)]), length)
                    held, suffixes, begin = [], 0, cut
            if begin < batch.num_rows:
                held.append(batch.slice(begin))
                suffixes += int(sizes[-1] - (sizes[begin - 1] if begin else 0))
        if held:
            yield _flush(pa.Table.from_batches(held), length)

    return run


def _strip(texts: bool):
    """Rows (doc_id, text, spans) to the contract's columns and, if asked for, the removed spans and the kept text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for step in text_steps(batches):
            raw, off = utf8(step.column(1))
            data = raw.tobytes()
            counts, gone, hashes, merged, kept = [], [], [], [], []
            for i, spans in enumerate(step.column(2).to_pylist()):
                words = data[off[i] : off[i + 1]].split()
                runs: list[list[int]] = []
                for s in sorted((s["begin"], s["end"]) for s in spans or []):
                    if runs and s[0] <= runs[-1][1]:
                        runs[-1][1] = max(runs[-1][1], s[1])
                    else:
                        runs.append([*s])
                counts.append(len(words))
                gone.append(sum(b - a for a, b in runs))
                if runs:
                    edges = [0, *(x for r in runs for x in r), len(words)]
                    words = [w for a, b in zip(edges[::2], edges[1::2]) for w in words[a:b]]
                text = b" ".join(words)
                hashes.append(hashlib.sha256(text).hexdigest())
                if texts:
                    merged.append([{"begin": a, "end": b} for a, b in runs])
                    kept.append(text.decode("utf-8"))
            columns = [step.column(0), pa.array(counts, pa.int64()), pa.array(gone, pa.int64()), pa.array(hashes, pa.string())]
            names = ["doc_id", "n_words", "n_removed", "kept_sha256"]
            if texts:
                spans_type = pa.list_(pa.struct([("begin", pa.int64()), ("end", pa.int64())]))
                columns += [pa.array(merged, spans_type), pa.array(kept, pa.string())]
                names += ["removed", "kept"]
            yield pa.RecordBatch.from_arrays(columns, names)

    return run


def remove_passages(docs: DataFrame, length: int = LENGTH, gram: int = GRAM, group: int = GROUP, texts: bool = True) -> DataFrame:
    """Per row of docs (doc_id, text): doc_id, n_words, n_removed, kept_sha256 and, if texts, removed (spans of words) and kept (text)."""
    if not 0 < gram < length or length - gram + 1 > 255:
        raise ValueError("gram must be positive and below length, which is at most gram + 254")
    every = docs.select(F.col("`doc_id`").cast("long").alias("doc_id"), "text")
    repeated = not every.where("doc_id is not null").groupBy("doc_id").count().where("count > 1").isEmpty()
    # Where a doc_id repeats, its different texts are versions; equal ones are judged once.
    every = every.withColumn("version", F.when(F.lit(repeated), F.xxhash64("text")).otherwise(F.lit(0)).cast("long"))
    rows = every.where("doc_id is not null").where(F.octet_length("text") >= 2 * length - 1).select("doc_id", "version", "text")
    if repeated:
        rows = rows.dropDuplicates(["doc_id", "version"])
    anchors = written(rows.mapInArrow(_anchors(length, gram), _PLACES), "anchors")
    judged = _judged(anchors, group)
    by_text = judged.groupBy("doc_id", "version").agg(F.collect_list(F.struct("h", "place", "fate")).alias("places"))
    by_text = written(by_text, "places")
    apart = F.filter("places", lambda p: p["fate"] != "gone")
    wanted = by_text.select("doc_id", "version", apart.alias("places")).where(F.size("places") > 0)
    cut = rows.join(wanted, ["doc_id", "version"]).select("doc_id", "version", "text", "places")
    pieces = written(cut.mapInArrow(_cut(length), "h long, doc_id long, version long, place long, seg binary, fate string"), "pieces")
    gone = [by_text.select("doc_id", "version", F.explode("places").alias("p")).where("p.fate = 'gone'").select("doc_id", "version", "p.place")]
    trees = [pieces.where("fate = 'tree'").drop("fate")]
    long = pieces.where("fate = 'long'").drop("fate")
    for width in (max((length - gram + 1) // 3, 1), 1):
        if long.isEmpty():
            break
        parts = written(long.mapInArrow(_longer(length, gram, width), _PLACES + ", seg binary"), "parts")
        finer = written(_judged(parts, group).select("h", "doc_id", "version", "place", "seg", "fate"), "finer")
        gone.append(finer.where("fate = 'gone'").select("doc_id", "version", "place"))
        trees.append(finer.where("fate = 'tree'").drop("fate"))
        long = finer.where("fate = 'long'").drop("fate")
    spans = None
    for part in trees:
        found = part.repartition("h").sortWithinPartitions("h").mapInArrow(_trees(length), "doc_id long, version long, begin long, end long")
        spans = found if spans is None else spans.unionByName(found)
    for part in gone:
        begin = F.shiftright("place", 8)
        whole = part.select("doc_id", "version", begin.alias("begin"), (begin + F.col("place").bitwiseAND(255) + (length - 1)).alias("end"))
        spans = spans.unionByName(whole)
    covered = spans.groupBy("doc_id", "version").agg(F.collect_list(F.struct("begin", "end")).alias("spans"))
    schema = "doc_id long, n_words long, n_removed long, kept_sha256 string" + ", removed array<struct<begin: long, end: long>>, kept string" * texts
    return every.join(covered, ["doc_id", "version"], "left").select("doc_id", "text", "spans").mapInArrow(_strip(texts), schema)


def op13_passage_trees(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The contract's columns for every document."""
    return remove_passages(spark.read.parquet(f"{sf_dir}/documents.parquet"), texts=False)


OP13_SQL = r"""
with d as (
  select row_number() over () as r, doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') as w from documents
),
windows as (
  select r, doc_id, i, array_to_string(w[i:i + 49], ' ') as s
  from (select r, doc_id, w, unnest(range(1, len(w) - 48)) as i from d where len(w) >= 50 and doc_id is not null)
),
earliest as (select s, min(doc_id) as lo from windows group by s),
gone as (select distinct r, unnest(range(i, i + 50)) as i from windows join earliest using (s) where doc_id > lo),
spread as (select r, unnest(range(1, len(w) + 1)) as i, unnest(w) as word from d),
left_over as (
  select r, count(*) as n, string_agg(word, ' ' order by i) as kept
  from spread anti join gone using (r, i) group by r
)
select doc_id, len(w)::bigint as n_words, (len(w) - coalesce(n, 0))::bigint as n_removed, sha256(coalesce(kept, '')) as kept_sha256
from d left join left_over using (r)
"""
