"""Extraction over streams: every stage up to scoring is keyed by page, so a stream of pages runs by micro-batches."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from tessera.plans.query import ExtractQuery, best_records

PAGES = "page_id long, url string, html string"


def read_pages(spark: SparkSession, path: str) -> DataFrame:
    """A stream of page files (parquet) in a folder."""
    return spark.readStream.schema(PAGES).parquet(path)


def extract_stream(pages: DataFrame, out: str, checkpoint: str, query: ExtractQuery | None = None) -> StreamingQuery:
    """Best records of every micro-batch, appended to out; a batch that is run again replaces itself."""

    def write(batch: DataFrame, number: int) -> None:
        best_records(batch, query).withColumn("batch", F.lit(number)).write.mode("overwrite").parquet(f"{out}/batch={number}")

    return pages.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def fresh_tokens(requests: DataFrame, window: str = "10 minutes") -> DataFrame:
    """Requests (token, ts) whose token was not seen within the window: replay protection by watermark."""
    return requests.withWatermark("ts", window).dropDuplicatesWithinWatermark(["token"])


def stream_counts(events: DataFrame, late: str = "10 minutes", size: str = "5 minutes") -> DataFrame:
    """Events (ts, kind) counted in tumbling windows; later ones than the watermark are dropped."""
    return events.withWatermark("ts", late).groupBy(F.window("ts", size), "kind").agg(F.count("*").alias("n"))
