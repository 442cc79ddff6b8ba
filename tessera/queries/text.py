"""Queries of the scalar functions: text, maps, JSON, URLs."""

from __future__ import annotations

from pyspark.sql import functions as F

from tessera.functions import text as T
from tessera.functions import urls as U
from tessera.functions.urls import UrlRule
from tessera.sources import exports


def _read(table):
    return lambda spark, sf: spark.read.parquet(f"{sf}/{table}.parquet")


_pages, _docs, _events, _nation, _orders = (_read(t) for t in ("pages", "documents", "events", "nation", "orders"))

QUERIES, ORACLES = {}, {}


def query(name: str, sql: str | None):
    def add(f):
        QUERIES[name] = f
        if sql:
            ORACLES[name] = sql
        return f

    return add


@query("pages_scan", "SELECT page_id, url, length(html) AS n FROM pages")
def _(s, d):
    return _pages(s, d).select("page_id", "url", F.length("html").alias("n"))


@query("url_valid", "SELECT page_id, regexp_matches(url, '^https?://') AND trim(url) <> '' AS ok FROM pages")
def _(s, d):
    return _pages(s, d).select("page_id", U.is_valid(F.col("url")).alias("ok"))


_CUT = "regexp_replace(url, '[?#&].*$', '')"


@query(
    "url_origin_folder",
    f"SELECT page_id, regexp_extract({_CUT}, '^((?:.*?://)?[^/]*)', 1) || '/' AS origin, regexp_extract({_CUT}, '^(.*/)', 1) AS folder FROM pages",
)
def _(s, d):
    return _pages(s, d).select("page_id", U.origin(F.col("url")).alias("origin"), U.folder(F.col("url")).alias("folder"))


@query("url_canonical_base", f"SELECT page_id, '//' || regexp_extract(regexp_replace({_CUT}, '^[A-Za-z0-9]*:?(?://)?', ''), '^[^/]*') AS base FROM pages")
def _(s, d):
    return _pages(s, d).select("page_id", U.canonical_base(F.col("url")).alias("base"))


@query(
    "url_absolute",
    f"""SELECT page_id, href, CASE WHEN href LIKE '//%' THEN CASE WHEN url LIKE 'https:%' THEN 'https:' ELSE 'http:' END || href
  WHEN href LIKE 'http://localhost/%' THEN regexp_extract({_CUT}, '^((?:.*?://)?[^/]*)', 1) || '/' || substr(href, 17)
  WHEN href LIKE '/%' THEN regexp_extract({_CUT}, '^((?:.*?://)?[^/]*)', 1) || '/' || substr(href, 2)
  WHEN href NOT LIKE '%://%' THEN regexp_extract({_CUT}, '^(.*/)', 1) || href ELSE href END AS absolute
FROM pages, (VALUES ('//h.example/x'), ('http://localhost/p'), ('/a/b'), ('c?d=1'), ('https://o.example/z')) v(href)""",
)
def _(s, d):
    hrefs = F.array(*[F.lit(h) for h in ("//h.example/x", "http://localhost/p", "/a/b", "c?d=1", "https://o.example/z")])
    rows = _pages(s, d).select("page_id", "url", F.explode(hrefs).alias("href"))
    return rows.select("page_id", "href", U.absolute(F.col("href"), F.col("url")).alias("absolute"))


@query("url_cache_rewrite", "SELECT page_id, 'http://' || split_part(split_part(url, '://', 2), '/', 1) || '.cache.example:8080/' || regexp_extract(split_part(url, '://', 2), '^[^/]*/(.*)$', 1) AS cached FROM pages")
def _(s, d):
    return _pages(s, d).select("page_id", U.cached(F.col("url"), ".cache.example:8080").alias("cached"))


@query("url_rewrite_first", "SELECT page_id, regexp_replace(url, 'e', 'E') AS url2 FROM pages")
def _(s, d):
    return _pages(s, d).select("page_id", U.rewrite(F.col("url"), [UrlRule("e", "E")]).alias("url2"))


@query("url_rewrite_all", "SELECT page_id, regexp_replace(url, '[?&]utm_[a-z]+=[a-z]+', '', 'g') AS url2 FROM pages")
def _(s, d):
    return _pages(s, d).select("page_id", U.rewrite(F.col("url"), [UrlRule("[?&]utm_[a-z]+=[a-z]+", "", replace_all=True)]).alias("url2"))


@query("url_rewrite_recursive", "SELECT page_id, regexp_replace(repeat('a', 9) || 'b' || url, 'a+b', 'b', 'g') AS url2 FROM pages")
def _(s, d):
    return _pages(s, d).select("page_id", U.rewrite(F.concat(F.lit("aaaaaaaaab"), "url"), [UrlRule("aab|ab", "b", replace_all=True, recursive=True)]).alias("url2"))


@query(
    "url_rewrite_chain",
    "SELECT page_id, CASE WHEN url LIKE '%#top' THEN regexp_replace(url, '#top$', '') WHEN url LIKE '%/' THEN regexp_replace(url, '/$', '') ELSE url END AS url2 FROM pages",
)
def _(s, d):
    return _pages(s, d).select("page_id", U.rewrite(F.col("url"), [UrlRule("#top$", ""), UrlRule("/$", "")]).alias("url2"))


@query("url_filter_whitelist", "SELECT page_id FROM pages WHERE contains(lower(url), 'blog.') OR contains(lower(url), '/de/')")
def _(s, d):
    return _pages(s, d).where(U.passes(F.col("url"), ("BLOG.", "/de/"))).select("page_id")


@query("url_filter_pattern", "SELECT page_id FROM pages WHERE regexp_full_match(lower(url), 'https?://[^/]*[.]net/.*')")
def _(s, d):
    return _pages(s, d).where(U.passes(F.col("url"), (), ("HTTPS?://[^/]*[.]NET/.*",))).select("page_id")


@query("text_strip", r"SELECT doc_id, trim(regexp_replace(text, '(&nbsp;|&amp;nbsp;|&#160;|[\x00-\x20 ])+', ' ', 'g')) AS t FROM documents")
def _(s, d):
    return _docs(s, d).select("doc_id", T.strip(F.col("text")).alias("t"))


@query("text_collapsed_length", r"SELECT doc_id, length(regexp_replace(regexp_replace(text, '^[\x00-\x20]+|[\x00-\x20]+$', '', 'g'), '[\x09-\x0D\x1C-\x20]+', ' ', 'g')) AS n FROM documents")
def _(s, d):
    return _docs(s, d).select("doc_id", T.collapsed_length(F.col("text")).alias("n"))


@query("html_strip_attributes", r"SELECT page_id, regexp_replace(html, '<([A-Za-z][A-Za-z0-9]*)\s[^>]*>', '<\1>', 'g') AS h FROM pages")
def _(s, d):
    return _pages(s, d).select("page_id", T.strip_attributes(F.col("html")).alias("h"))


@query(
    "entity_decode",
    "SELECT page_id, replace(replace(replace(replace(regexp_extract(html, '<title>([^<]*)', 1), '&quot;', '\"'), '&copy;', '©'), '&middot;', '·'), '&amp;', '&') AS title FROM pages",
)
def _(s, d):
    return _pages(s, d).select("page_id", T.decode_entities(F.regexp_extract("html", "<title>([^<]*)", 1)).alias("title"))


@query("entity_encode", "SELECT doc_id, replace(replace(replace(replace(text, '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), '\"', '&quot;') AS t FROM documents")
def _(s, d):
    return _docs(s, d).select("doc_id", T.encode_entities(F.col("text")).alias("t"))


@query("sha256_text", "SELECT doc_id, sha256(text) AS h FROM documents")
def _(s, d):
    return _docs(s, d).select("doc_id", F.sha2("text", 256).alias("h"))


@query("map_hash", "SELECT n_nationkey, sha256('key:' || n_nationkey || ',name:' || n_name || ',') AS h FROM nation")
def _(s, d):
    pairs = F.create_map(F.lit("name"), F.col("n_name"), F.lit("key"), F.col("n_nationkey").cast("string"))
    return _nation(s, d).select("n_nationkey", T.map_hash(pairs).alias("h"))


@query("map_merge", "SELECT n_nationkey, n_name AS a, 'x' AS b, 'c' AS c FROM nation")
def _(s, d):
    left = F.create_map(F.lit("a"), F.lit("old"), F.lit("c"), F.lit("c"))
    merged = T.merge_maps(left, F.create_map(F.lit("a"), F.col("n_name"), F.lit("b"), F.lit("x")))
    return _nation(s, d).select("n_nationkey", *[merged[k].alias(k) for k in "abc"])


@query("csv_rows", "SELECT n_nationkey, '\"' || n_nationkey || '\",\"' || n_name || '\"' AS line FROM nation")
def _(s, d):
    return _nation(s, d).select("n_nationkey", exports.csv_row(["n_nationkey", "n_name"]).alias("line"))


@query("json_rows", "SELECT n_nationkey, '{\"n_nationkey\":' || n_nationkey || ',\"n_name\":\"' || n_name || '\"}' AS line FROM nation")
def _(s, d):
    return _nation(s, d).select("n_nationkey", exports.json_row(["n_nationkey", "n_name"]).alias("line"))


@query("hyperlink_cells", "SELECT page_id, '=HYPERLINK(\"' || url || '\")' AS cell FROM pages")
def _(s, d):
    return _pages(s, d).select("page_id", exports.hyperlink(F.col("url")).alias("cell"))


@query("epoch_day", "SELECT event_id, strftime(ts, '%Y-%m-%d') AS day FROM events")
def _(s, d):
    millis = F.unix_millis(F.col("ts").cast("timestamp"))
    return _events(s, d).select("event_id", T.day_of_millis(millis).alias("day"))


@query("to_int", "SELECT event_id, CAST(trunc(value) AS INT) AS v FROM events")
def _(s, d):
    return _events(s, d).select("event_id", T.to_int(F.col("value").cast("string")).alias("v"))


@query("levenshtein_nations", "SELECT a.n_name AS a, b.n_name AS b, levenshtein(a.n_name, b.n_name) AS d FROM nation a, nation b WHERE a.n_regionkey = b.n_regionkey AND a.n_nationkey < b.n_nationkey")
def _(s, d):
    a, b = (_nation(s, d).select(F.col("n_nationkey").alias(f"k{x}"), F.col("n_name").alias(x), F.col("n_regionkey").alias("r")) for x in "ab")
    return a.join(b, "r").where("ka < kb").select("a", "b", F.levenshtein("a", "b").cast("long").alias("d"))


@query("sort_numeric_desc", "SELECT o_orderkey, o_totalprice AS price FROM orders ORDER BY price DESC, o_orderkey")
def _(s, d):
    return _orders(s, d).select("o_orderkey", F.col("o_totalprice").cast("string").cast("double").alias("price")).orderBy(F.desc("price"), "o_orderkey")


@query("contact_email", r"""SELECT doc_id, nullif(regexp_extract(text, '[^&"'':><\s@]+@[^&"'':><\s@.]+\.[^&"'':><\s@]*[^&"'':><\s@.]'), '') AS email FROM documents""")
def _(s, d):
    from tessera.operators.fields import email_of

    return _docs(s, d).select("doc_id", email_of(F.col("text")).alias("email"))


@query(
    "contact_phone",
    r"""SELECT doc_id, trim(list_filter(regexp_extract_all(text, '[-+().0-9\s]{8,20}[0-9]'), lambda r: length(regexp_replace(r, '[^0-9]', '', 'g')) BETWEEN 7 AND 15)[1]) AS phone FROM documents""",
)
def _(s, d):
    from tessera.operators.fields import phone_of

    return _docs(s, d).select("doc_id", phone_of(F.col("text")).alias("phone"))
