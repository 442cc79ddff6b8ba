"""Ranked lexical search with the three-phase uniform threshold (TPUT) over term-partitioned postings.

A posting is (term, document, value): what the term adds to the document's score. The lists are one written
table, dealt by ranges of (term, falling value), so a long list is spread over many files and a
threshold on the value skips most of them.

1. **Heads.** Each list gives its ``k`` largest values. Summed by (item, document) they bound scores from
   below. The ``PROBES * k`` documents of an item's largest sums are looked up, and the k-th largest of their scores is its first threshold t.
2. **Uniform threshold.** One value T for all of an item's lists, as high as it can be while values below T in every list,
   none above its list's largest, can't sum up to t / ``SHARE``: t / SHARE / m, if no list's largest value is below that (a SHARE
   above 1 fetches more, but hides less, so fewer documents are left to look up). Each list gives all values from T on. Their sums are better lower bounds, and with the largest values that lists still
   hide, upper bounds; documents whose upper bound misses the k-th largest lower bound go.
3. **Look-up.** The hidden values of the documents left are looked up by (term, document), which makes their scores exact.

All is integer arithmetic. Terms are compared by 64-bit hashes, cryptographic ones for words of over 256 bytes. Every row of
``documents`` is a document (ties of equal doc_ids in any order, null doc_ids last); a null or empty text has
no terms and isn't counted. Rows of one item_id are one item; an item without terms, or whose terms no document
holds, returns no rows. An empty table gives no rows; extra columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tessera.llm.common import Prefixes, plain_rows, runs_of, text_steps, utf8, written

#: Documents returned for each item.
TOP = 50
#: Documents, as times the number returned, that are looked up for the first threshold; more of them raise it, none changes a result.
PROBES = 8
#: What is hidden of an item's lists sums up to less than this part of its first threshold.
SHARE = 4
#: Bits of the filter of asked-for terms, the same at every size; the join with the terms themselves follows.
FILTER_BITS = 1 << 22

_TERM = np.zeros(256, bool)
_TERM[[*range(0x30, 0x3A), *range(0x41, 0x5B), *range(0x61, 0x7B), *range(0x80, 0x100)]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_LONG = 256


def term_counts(raw: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(row, term, occurrences) of each row's different terms, and each row's number of terms."""
    raw = _LOWER[raw]
    begin, end = runs_of(_TERM[raw], off)
    terms = Prefixes(raw).hash(begin, end)
    for i in np.flatnonzero(end - begin > _LONG).tolist():
        terms[i] = int.from_bytes(hashlib.blake2b(raw[begin[i] : end[i]].tobytes(), digest_size=8).digest(), "little")
    first = np.searchsorted(begin, off)
    sizes = np.diff(first)
    row = np.repeat(np.arange(len(sizes)), sizes)
    order = np.lexsort((terms, row))
    row, terms = row[order], terms[order].view(np.int64)
    new = np.ones(len(terms), bool)
    new[1:] = (terms[1:] != terms[:-1]) | (row[1:] != row[:-1])
    lead = np.flatnonzero(new)
    return row[lead], terms[lead], np.diff(np.append(lead, len(terms))), sizes


_COUNTS = "row_id long, doc_id long, n long, term long, tf long"


def _counts(asked: np.ndarray | None):
    """Rows (row_id, doc_id, text) to (row_id, doc_id, n, term, tf) of terms that pass the filter, and one row without term for each with terms."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits = None if asked is None else np.unpackbits(asked).view(bool)
        for step in text_steps(batches):
            row, term, tf, n = term_counts(*utf8(step.column(2)))
            if bits is not None:
                keep = bits[term & (FILTER_BITS - 1)]
                row, term, tf = row[keep], term[keep], tf[keep]
            whole = np.flatnonzero(n)
            row = np.concatenate([row, whole])
            none = np.zeros(len(row), bool)
            none[len(term) :] = True
            ids = step.column(1).take(pa.array(row))
            pad = np.zeros(len(whole), np.int64)
            terms, tfs = (pa.array(np.concatenate([x, pad]), pa.int64(), mask=none) for x in (term, tf))
            yield pa.RecordBatch.from_arrays([step.column(0).take(pa.array(row)), ids, pa.array(n[row]), terms, tfs], ["row_id", "doc_id", "n", "term", "tf"])

    return run


def _numbered(table: DataFrame, key: str) -> DataFrame:
    rows = plain_rows(table, key, "text")
    return rows.select(F.monotonically_increasing_id().alias("row_id"), F.col(key).cast("long").alias("doc_id"), "text")


def _first(sums: DataFrame, k: int) -> DataFrame:
    """The k rows of each item's largest ``low``, with their place."""
    return sums.withColumn("place", F.row_number().over(Window.partitionBy("item_id").orderBy(F.desc("low")))).where(F.col("place") <= k)


def _values(lists: DataFrame, pairs: DataFrame, wanted: DataFrame) -> DataFrame:
    """Look-up: pairs (item_id, row_id) with term, value and wanted's columns for each list of the item that holds the row."""
    rows = written(pairs.select("row_id").distinct(), "rows")
    held = lists.select("term", "row_id", "value").join(rows, "row_id", "left_semi")
    return pairs.join(wanted, "item_id").join(held, ["term", "row_id"])


def search(docs: DataFrame, items: DataFrame, k: int = TOP) -> DataFrame:
    """The k best rows of docs (doc_id, text) for each of items (item_id, text): item_id, rank, doc_id, score."""
    asked = _numbered(items, "item_id").mapInArrow(_counts(None), _COUNTS).where("term is not null")
    asked = written(asked.select(F.col("doc_id").alias("item_id"), "term").distinct(), "asked")
    on = [r[0] for r in asked.select(F.col("term").bitwiseAND(FILTER_BITS - 1)).distinct().collect()]  # FILTER_BITS at most
    bits = np.zeros(FILTER_BITS, bool)
    bits[np.array(on, np.int64)] = True
    counts = written(_numbered(docs, "doc_id").mapInArrow(_counts(np.packbits(bits)), _COUNTS), "counts")
    postings = counts.where("term is not null").join(asked.select("term").distinct(), "term")
    total, length = counts.where("term is null").agg(F.count("*"), F.coalesce(F.sum("n"), F.lit(0))).first()
    frequency = postings.groupBy("term").agg(F.count("*").alias("df"))
    weight = F.floor(1000 * F.log(F.lit(2 * total + 2).cast("double") / (2 * F.col("df") + 1).cast("double"))).cast("long")
    weights = written(frequency.select("term", weight.alias("w")).where("w > 0"), "weights")
    m = f"50 + (50 * n * {total}L) div {max(length, 1)}L"
    value = F.expr(f"w * ((1000000000L * tf) div (1000 * tf + 20 * ({m})))")
    lists = postings.join(weights, "term").select("term", value.alias("value"), "row_id", "doc_id").where("value > 0")
    lists = written(lists.repartitionByRange("term", F.desc("value"), "row_id").sortWithinPartitions("term", F.desc("value")), "lists")

    # 1. Heads of the lists, one each for all items that ask for it.
    place = F.row_number().over(Window.partitionBy("term").orderBy(F.desc("value")))
    heads = written(lists.withColumn("place", place).where(F.col("place") <= k), "heads")
    tops = heads.groupBy("term").agg(F.max("value").alias("top"))
    wanted = written(asked.join(tops, "term"), "wanted")
    partial = heads.join(wanted, "term").groupBy("item_id", "row_id").agg(F.sum("value").alias("low"))
    best = written(_first(partial, PROBES * k).select("item_id", "row_id"), "best")
    exact = _values(lists, best, wanted).groupBy("item_id", "row_id").agg(F.sum("value").alias("low"))
    least = written(_first(exact, k).where(F.col("place") == k).select("item_id", F.col("low").alias("least")), "least")

    # 2. All values from T on, by item. In the order of the lists' largest values, those that T passes count with these.
    order = Window.partitionBy("item_id").orderBy("top", "term")
    lower = F.coalesce(F.sum("top").over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    left = F.count("*").over(Window.partitionBy("item_id")) - F.row_number().over(order) + 1
    levels = wanted.withColumns({"lower": lower, "lists": left}).join(least, "item_id", "left")
    levels = levels.withColumn("level", F.expr(f"(greatest(coalesce(least, 1) div {SHARE}, 1) - 1 - lower) div lists")).where("level < top")
    levels = levels.groupBy("item_id").agg(F.max("level").alias("level"))
    bounds = wanted.join(levels, "item_id").select("item_id", "term", (F.col("level") + 1).alias("need"), F.least("level", "top").alias("rest"))
    bounds = written(bounds, "bounds")
    lowest = bounds.groupBy("term").agg(F.min("need").alias("lowest"))
    # Postings are dealt by document before they meet the items that ask for their terms: there, sums need no other shuffle.
    above = lists.join(lowest, "term").where("value >= lowest").drop("lowest").repartition("row_id")
    seen = above.join(bounds, "term").where("value >= need").groupBy("item_id", "row_id").agg(F.sum("value").alias("low"), F.sum("rest").alias("told"), F.first("doc_id").alias("doc_id"))
    hidden = written(bounds.groupBy("item_id").agg(F.sum("rest").alias("hidden")).join(least, "item_id", "left"), "hidden")
    seen = seen.join(hidden, "item_id").withColumn("high", F.expr("low + hidden - told")).where("high >= coalesce(least, 0)")
    seen = written(seen.select("item_id", "row_id", "doc_id", "low", "high"), "seen")
    limits = _first(seen, k).where(F.col("place") == k).select("item_id", F.col("low").alias("limit"))
    left = seen.join(limits, "item_id", "left").where("high >= coalesce(limit, 0)").select("item_id", "row_id", "doc_id", "low")
    left = written(left, "left")

    # 3. The values below an item's threshold, of the documents left.
    extra = _values(lists, left.select("item_id", "row_id"), bounds.where("rest > 0")).where("value < need")
    added = extra.groupBy("item_id", "row_id").agg(F.sum("value").alias("more"))
    scored = left.join(added, ["item_id", "row_id"], "left").select("item_id", "row_id", "doc_id", (F.col("low") + F.coalesce("more", F.lit(0))).alias("score"))
    order = Window.partitionBy("item_id").orderBy(F.desc("score"), F.asc_nulls_last("doc_id"), "row_id")
    return scored.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("item_id", "rank", "doc_id", "score")


def op12_threshold_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The contract's rows for every item of benchmark."""
    return search(*(spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in ("documents", "benchmark")))


_TERMS = r"regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')"
OP12_SQL = f"""
with d as (select row_number() over () as r, doc_id, {_TERMS} as t from documents),
total as (select count(*) as n_docs, sum(len(t)) as n_terms from d where len(t) > 0),
items as (select distinct item_id, unnest({_TERMS}) as term from benchmark),
postings as (select r, doc_id, len(t) as n, unnest(t) as term from d),
counted as (select r, doc_id, n, term, count(*) as tf from postings where term in (select term from items) group by all),
weights as (
  select term, floor(1000 * ln((2 * any_value(n_docs) + 2)::double / (2 * count(*) + 1)::double))::bigint as w
  from counted, total group by term
),
scores as (
  select item_id, r, any_value(doc_id) as doc_id,
    sum(w * ((1000000000 * tf) // (1000 * tf + 20 * (50 + (50 * n * n_docs) // n_terms::bigint))))::bigint as score
  from counted join weights using (term) join items using (term), total group by item_id, r
),
ranked as (select *, row_number() over (partition by item_id order by score desc, doc_id asc nulls last, r) as rank from scores where score > 0)
select item_id, rank::int as rank, doc_id, score from ranked where rank <= 50
"""
