"""Searches over streams: limits and the stop at a repeated page hold over all micro-batches of a search."""

from __future__ import annotations

import json
from collections.abc import Iterator
from contextlib import contextmanager
from dataclasses import replace

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle, StreamingQuery

from tessera.plans.query import ExtractQuery, best_records

_RECORD = "pos int, url string, title string, summary string, date string"
#: One row for each page, also for one without records: a JSON list of them.
PAGE_RESULTS = "search string, page_no int, records string"
_OUT = f"search string, page_no int, {_RECORD}"
_PROVIDER = "spark.sql.streaming.stateStore.providerClass"


def page_results(records: DataFrame, pages: DataFrame) -> DataFrame:
    """PAGE_RESULTS of pages (search, page_no) and their records (search, page_no, pos, url, title, summary, date)."""
    row = F.struct(*[F.col(c.split()[0]).cast(c.split()[1]).alias(c.split()[0]) for c in _RECORD.split(", ")])
    lists = records.groupBy(F.col("search").cast("string").alias("search"), F.col("page_no").cast("int").alias("page_no")).agg(F.to_json(F.array_sort(F.collect_list(row))).alias("records"))
    all_ = pages.select(F.col("search").cast("string").alias("search"), F.col("page_no").cast("int").alias("page_no")).distinct()
    return all_.join(lists, ["search", "page_no"], "left").select("search", "page_no", F.coalesce("records", F.lit("[]")).alias("records"))


class _Search(StatefulProcessor):
    """One search: which page comes next, how many records it gave, the last page's records, and pages that came early."""

    def __init__(self, pages: int, results: int, share: float):
        self.pages, self.results, self.share = pages, results, share

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.place = handle.getValueState("place", "next int, given long, ended boolean")
        self.last = handle.getValueState("last", "records string")
        self.early = handle.getMapState("early", "page_no int", "records string")

    def repeats(self, now: list[dict], before: list[dict]) -> bool:
        if not now or len(now) != len(before):
            return False
        held = {r.get("pos"): r for r in before}
        same = sum(all(r.get(c) == held.get(r.get("pos"), {"url": self}).get(c) for c in ("url", "title", "summary")) for r in now)
        return (len(now) - same) / len(now) <= self.share

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        number, given, ended = self.place.get() if self.place.exists() else (1, 0, False)
        for batch in rows:
            for page_no, records in zip(batch["page_no"], batch["records"]):
                if not ended and page_no >= number:
                    self.early.updateValue((int(page_no),), (records,))
        out: list[dict] = []
        before = json.loads(self.last.get()[0]) if self.last.exists() else []
        while not ended and self.early.containsKey((number,)):
            now = json.loads(self.early.getValue((number,))[0])
            self.early.removeKey((number,))
            ended = self.repeats(now, before)
            if not ended:
                kept = sorted(now, key=lambda r: r.get("pos", 0))[: self.results - given if self.results > 0 else None]
                out += [{"page_no": number, **r} for r in kept]
                given += len(kept)
                before, number = now, number + 1
                ended = 0 < self.results <= given or 0 < self.pages < number
        if ended:
            self.early.clear()
            self.last.clear()
        else:
            self.last.update((json.dumps(before),))
        self.place.update((number, given, ended))
        names = [c.split()[0] for c in _OUT.split(", ")]
        table = pd.DataFrame([{"search": key[0], **r} for r in out], columns=names, dtype=object).where(lambda t: t.notna(), None)
        yield table.astype({"page_no": "int32", "pos": "int32"})

    def close(self) -> None:
        pass


def limited(results: DataFrame, pages: int = 0, records: int = 0, share: float = 0.15) -> DataFrame:
    """A stream of PAGE_RESULTS to one of records (search, page_no, pos, url, title, summary, date): at most ``records`` of each search, none of
    its pages from the first on that repeats the one before.

    A search's pages are numbered from 1 without gaps. They may come in any order and batch: one that comes early waits in the state
    until those before it have come, and one that comes again is ignored. The state of a search is its last page, a
    count, and what waits; of one that has ended, the count. Needs the RocksDB state store (see ``with_state``).
    """
    return results.groupBy("search").transformWithStateInPandas(_Search(pages, records, share), _OUT, "Append", "None")


@contextmanager
def with_state(spark: SparkSession) -> Iterator[None]:
    """Queries that are started within keep their state in RocksDB."""
    before = spark.conf.get(_PROVIDER)
    spark.conf.set(_PROVIDER, "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    try:
        yield
    finally:
        spark.conf.set(_PROVIDER, before)


def extract_results(pages: DataFrame, out: str, checkpoint: str, query: ExtractQuery | None = None) -> StreamingQuery:
    """PAGE_RESULTS of a stream of pages (search, page_no, page_id, url, html), a folder of out for each micro-batch; one that is run again replaces itself.

    Each page is judged by itself here; ``limited``, over a stream of out, does the rest. A nested query isn't run.
    """
    each = replace(query or ExtractQuery(), pages=0, results=0, nested=None)

    def write(batch: DataFrame, number: int) -> None:
        about = batch.select("page_id", F.col("search").alias("of"), F.col("page_no").alias("number"))
        alone = batch.withColumn("search", F.col("page_id"))
        found = best_records(alone, each).drop("search", "trail").join(about, "page_id")
        told = page_results(found.select(F.col("of").alias("search"), F.col("number").alias("page_no"), "pos", "url", "title", "summary", "date"), batch)
        told.write.mode("overwrite").parquet(f"{out}/batch={number}")

    return pages.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def read_results(spark: SparkSession, path: str, files: int = 0) -> DataFrame:
    """A stream of what extract_results wrote, ``files`` at a time (0: all there are)."""
    reader = spark.readStream.schema(PAGE_RESULTS).option("recursiveFileLookup", "true")
    return (reader.option("maxFilesPerTrigger", files) if files else reader).parquet(path)
