"""Readers and writers of result rows: CSV, JSON, spreadsheets with links, binaries, captured media."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.functions.urls import is_valid


def csv_row(columns: Sequence[str]) -> Column:
    """A CSV line: every field quoted, quotes doubled, null as empty."""
    quoted = [F.concat(F.lit('"'), F.replace(F.coalesce(F.col(c).cast("string"), F.lit("")), F.lit('"'), F.lit('""')), F.lit('"')) for c in columns]
    return F.concat_ws(",", *quoted)


def json_row(columns: Sequence[str]) -> Column:
    return F.to_json(F.struct(*columns), {"ignoreNullFields": "false"})


def hyperlink(c: Column) -> Column:
    """A spreadsheet formula for a URL, other text as it is."""
    return F.when(is_valid(c), F.concat(F.lit('=HYPERLINK("'), c, F.lit('")'))).otherwise(c)


def write_csv(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").option("header", True).option("escape", '"').csv(path)


def write_json(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").json(path)


def read_csv(spark: SparkSession, path: str, schema: str) -> DataFrame:
    return spark.read.option("header", True).option("escape", '"').option("multiLine", True).schema(schema).csv(path)


#: Leading bytes (hex) of common formats.
MAGIC = {"25504446": "application/pdf", "89504E47": "image/png", "FFD8FF": "image/jpeg", "47494638": "image/gif", "504B0304": "application/zip", "1F8B": "application/gzip"}


def mime_of(content: Column, reported: Column | None = None) -> Column:
    """The reported type unless it is missing or of octets, else by leading bytes, else the reported one."""
    found = F.lit(None).cast("string")
    for magic, mime in MAGIC.items():
        found = F.when(F.hex(F.substring(content, 1, len(magic) // 2)) == magic, mime).otherwise(found)
    if reported is None:
        return F.coalesce(found, F.lit("application/octet-stream"))
    return F.when(reported.isNotNull() & ~reported.contains("octet"), reported).otherwise(F.coalesce(found, reported))


def read_binaries(spark: SparkSession, path: str) -> DataFrame:
    """file_name, extension, mime, content (base64) of downloaded files."""
    files = spark.read.format("binaryFile").load(path)
    name = F.substring_index("path", "/", -1)
    return files.select(F.regexp_extract(name, r"^(.*?)(\.[^.]*)?$", 1).alias("file_name"), F.regexp_extract(name, r"\.([^.]*)$", 1).alias("extension"), mime_of(F.col("content")).alias("mime"), F.base64("content").alias("content"))


def media_of(sources: DataFrame, captured: DataFrame) -> DataFrame:
    """page_id and maps media_binaries, media_mime_types of captured (url, content, mime) whose url ends with a page's src.

    The join is by the last path part, then by the whole suffix.
    """
    last = lambda c: F.regexp_extract(c, r"([^/]*)$", 1)
    left = sources.select("page_id", "src", last(F.col("src")).alias("part")).distinct()
    right = captured.select("url", "content", mime_of(F.col("content"), F.col("mime")).alias("mime"), last(F.col("url")).alias("part"))
    met = left.join(right, "part").where(F.col("url").endswith(F.col("src"))).groupBy("page_id", "src").agg(F.min(F.struct("url", F.base64("content").alias("content"), "mime")).alias("m"))
    entry = lambda c: F.map_from_entries(F.array_sort(F.collect_list(F.struct("src", f"m.{c}"))))
    return met.groupBy("page_id").agg(entry("content").alias("media_binaries"), entry("mime").alias("media_mime_types"))
