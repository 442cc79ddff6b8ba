"""URL filters: a temporal list join of captures with dated list entries.

A list is a log: a pattern (a host, meaning itself and all below it, with an optional path prefix), an
action (a verdict that starts to hold, or ``remove``) and the day from which it counts. Each pattern's
log becomes validity intervals by its next entry. A capture is joined with the entries of its host and
of every parent domain, and those active at its fetch time are weighed: the longest pattern decides,
then the latest entry.

A host is what stands after any user information, lower-cased, without a final dot; paths keep their
case. A capture without host, time or active entry is ``allowed``. Of entries of one pattern and day
the one with the greatest action counts. Repeated captures are judged each by its own URL and time;
empty tables give no rows; extra columns are ignored. The join is by host, so one busy host is split by Spark's skew handling: the
entries of one host are few.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def host_of(url: Column) -> Column:
    """The lower-cased host of a URL with a scheme, '' if there is none."""
    host = F.regexp_extract(F.coalesce(url, F.lit("")), r"^[a-zA-Z][a-zA-Z0-9+.-]*://(?:[^/?#]*@)?([^/?#:@]+)", 1)
    return F.lower(F.regexp_replace(host, r"\.$", ""))


def intervals(entries: DataFrame) -> DataFrame:
    """pattern, verdict, valid_from, valid_to (null: open) of entries (pattern, action, day)."""
    named = F.concat(F.lower(F.regexp_extract("pattern", "^[^/]*", 0)), F.regexp_extract("pattern", "^[^/]*(.*)$", 1))
    last = entries.where("pattern is not null and day is not null and action is not null").select(named.alias("pattern"), "action", "day").groupBy("pattern", "day").agg(F.max("action").alias("action"))
    turn = Window.partitionBy("pattern").orderBy("day")
    spans = last.withColumn("valid_to", F.lead("day").over(turn)).where("action <> 'remove'")
    return spans.select("pattern", F.col("action").alias("verdict"), F.col("day").alias("valid_from"), "valid_to")


def judged(captures: DataFrame, entries: DataFrame) -> DataFrame:
    """capture_id, host, verdict, pattern, valid_from of captures (capture_id, url, day)."""
    host = captures.select("capture_id", "url", "day", host_of(F.col("url")).alias("host"))
    labels = F.split("host", r"\.")
    parents = F.transform(F.sequence(F.lit(1), F.size(labels)), lambda i: F.array_join(F.slice(labels, i, F.size(labels)), "."))
    path = F.regexp_extract("url", r"^[a-zA-Z][a-zA-Z0-9+.-]*://[^/?#]*([^?#]*)", 1)
    keyed = host.where("host <> '' and day is not null").select("capture_id", "url", "day", path.alias("path"), F.explode(parents).alias("key"))
    spans = intervals(entries).select(
        F.regexp_extract("pattern", "^[^/]*", 0).alias("entry_key"), F.regexp_extract("pattern", "^[^/]*(.*)$", 1).alias("prefix"), "pattern", "verdict", "valid_from", "valid_to"
    )
    active = keyed.join(spans, F.col("key") == F.col("entry_key")).where(
        (F.col("valid_from") <= F.col("day")) & (F.col("valid_to").isNull() | (F.col("day") < F.col("valid_to"))) & F.col("path").startswith(F.col("prefix"))
    )
    best = active.groupBy("capture_id", "url", "day").agg(F.max(F.struct(F.length("pattern").alias("n"), "valid_from", "pattern", "verdict")).alias("best"))
    out = host.select("capture_id", "url", "day", "host").join(best, ["capture_id", "url", "day"], "left")
    return out.select("capture_id", "host", F.coalesce("best.verdict", F.lit("allowed")).alias("verdict"), F.col("best.pattern").alias("pattern"), F.col("best.valid_from").alias("valid_from"))


def op4_url_lists(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every page, fetched on a day that follows from its id, against the demonstration list."""
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", "url")
    sites = pages.select(F.regexp_extract(F.lower("url"), "^https?://(www[.]|m[.]|blog[.])?([^/?#]+)", 2).alias("site")).where("site <> ''").distinct()
    k = sites.selectExpr("site", "ascii(site) * 7 + length(site) * 13 + ascii(substr(site, length(site) - 12, 1)) * 3 as k")
    log = "date_add(DATE'2024-01-01', cast({} as int)) as day"
    entries = k.selectExpr("site as pattern", "'blocked' as action", log.format("k % 300"))
    for pattern, action, day, where in (
        ("site", "remove", "k % 300 + 30 + k % 90", "k % 3 <> 0"),
        ("site", "review", "k % 300 + 130", "k % 5 = 0"),
        ("'blog.' || site", "review", "k % 200", "k % 2 = 0"),
        ("site || '/en/'", "trusted", "k % 150", "k % 7 = 0"),
    ):
        entries = entries.unionByName(k.where(where).selectExpr(f"{pattern} as pattern", f"'{action}' as action", log.format(day)))
    captures = pages.selectExpr("page_id as capture_id", "url", "date_add(DATE'2024-01-01', cast(page_id % 366 as int)) as day")
    out = judged(captures, entries)
    return out.select(F.col("capture_id").alias("page_id"), "host", "verdict", "pattern", F.col("valid_from").cast("string").alias("valid_from"))


OP4_SQL = r"""
WITH h AS (
  SELECT DISTINCT regexp_extract(lower(url), '^https?://(www[.]|m[.]|blog[.])?([^/?#]+)', 2) AS site FROM pages
), k AS (
  SELECT site, ascii(site) * 7 + length(site) * 13 + ascii(substr(site, length(site) - 12, 1)) * 3 AS k FROM h WHERE site <> ''
), log AS (
  SELECT site AS pattern, 'blocked' AS action, DATE '2024-01-01' + CAST(k % 300 AS INT) AS day FROM k
  UNION ALL SELECT site, 'remove', DATE '2024-01-01' + CAST(k % 300 + 30 + k % 90 AS INT) FROM k WHERE k % 3 <> 0
  UNION ALL SELECT site, 'review', DATE '2024-01-01' + CAST(k % 300 + 130 AS INT) FROM k WHERE k % 5 = 0
  UNION ALL SELECT 'blog.' || site, 'review', DATE '2024-01-01' + CAST(k % 200 AS INT) FROM k WHERE k % 2 = 0
  UNION ALL SELECT site || '/en/', 'trusted', DATE '2024-01-01' + CAST(k % 150 AS INT) FROM k WHERE k % 7 = 0
), one AS (
  SELECT pattern, day, max(action) AS action FROM log GROUP BY pattern, day
), spans AS (
  SELECT pattern, action AS verdict, day AS valid_from, lead(day) OVER (PARTITION BY pattern ORDER BY day) AS valid_to FROM one
), active AS (
  SELECT *, regexp_extract(pattern, '^[^/]*') AS key, regexp_extract(pattern, '^[^/]*(.*)$', 1) AS prefix FROM spans WHERE verdict <> 'remove'
), c AS (
  SELECT page_id, url, DATE '2024-01-01' + CAST(page_id % 366 AS INT) AS day,
    lower(regexp_replace(regexp_extract(coalesce(url, ''), '^[a-zA-Z][a-zA-Z0-9+.-]*://(?:[^/?#]*@)?([^/?#:@]+)', 1), '\.$', '')) AS host,
    regexp_extract(url, '^[a-zA-Z][a-zA-Z0-9+.-]*://[^/?#]*([^?#]*)', 1) AS path FROM pages
), met AS (
  SELECT page_id, verdict, pattern, valid_from,
    row_number() OVER (PARTITION BY page_id ORDER BY length(pattern) DESC, valid_from DESC, pattern DESC, verdict DESC) AS turn
  FROM c JOIN active ON (host = key OR host LIKE '%.' || key) AND valid_from <= day AND (valid_to IS NULL OR day < valid_to) AND starts_with(path, prefix)
)
SELECT c.page_id, host, coalesce(verdict, 'allowed') AS verdict, pattern, CAST(valid_from AS VARCHAR) AS valid_from
FROM c LEFT JOIN (SELECT * FROM met WHERE turn = 1) m ON c.page_id = m.page_id
"""
