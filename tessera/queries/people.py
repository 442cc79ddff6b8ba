"""Queries of names and contacts, sign-in forms and encrypted columns, with their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from tessera.functions import vault
from tessera.operators import fields, names
from tessera.operators.staged import staged
from tessera.sources.html import parse_pages

QUERIES, ORACLES = {}, {}


def query(name: str, sql: str | None):
    def add(f):
        QUERIES[name] = f
        if sql:
            ORACLES[name] = sql
        return f

    return add


def _read(s, d, table):
    return s.read.parquet(f"{d}/{table}.parquet")


#: First names are the capitalised words that texts begin with, last names those that sentences do: tables as large as the corpus makes them.
_NAMES = r"""first AS (SELECT name, count(*) > 1 AS popular FROM (SELECT regexp_extract(text, '^[A-Z][a-z]+') AS name FROM documents) WHERE name <> '' GROUP BY name),
last AS (SELECT DISTINCT upper(unnest(regexp_extract_all(text, '\. ([A-Z][a-z]+)', 1))) AS family FROM documents)"""
_PAIRS = r"""SELECT {by}, regexp_extract_all(text, '[\p{{L}}''’-]+|[^\p{{L}}''’\s-]+') AS t FROM {of}"""
_FOUND = """p{k} AS ({pairs}), q{k} AS (SELECT {by}, t[i] AS a, CASE WHEN regexp_matches(t[i + 1], '^\\p{{Lu}}') THEN t[i + 1] END AS b FROM (SELECT {by}, t, unnest(range(1, len(t) + 1)) AS i FROM p{k}) WHERE regexp_matches(t[i], '^\\p{{Lu}}')),
m{k} AS (SELECT {by}, CASE WHEN family IS NOT NULL THEN a || ' ' || b END AS f, CASE WHEN family IS NULL THEN a END AS s FROM q{k} JOIN first ON a = name {strict} LEFT JOIN last ON upper(b) = family),
n{k} AS (SELECT {by}, CASE WHEN count(DISTINCT f) = 1 THEN min(f) {other} END AS name FROM m{k} GROUP BY ALL)"""
_EMAIL, _PHONE = fields.EMAIL.replace("'", "''"), fields.PHONE


def _found(k: int, by: str, of: str, strict: bool) -> str:
    other = "" if strict else "WHEN count(DISTINCT s) = 1 THEN min(s)"
    return _FOUND.format(k=k, by=by, pairs=_PAIRS.format(by=by, of=of), strict="AND popular" if strict else "", other=other)


_RUNS = f"list_filter(regexp_extract_all(x, '{_PHONE}'), lambda r: length(regexp_replace(r, '[^0-9]', '', 'g')) BETWEEN 7 AND 15)"


@query(
    "contact_names",
    f"""WITH {_NAMES}, l AS (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS l FROM documents),
near AS (SELECT doc_id, 0 AS part, list_filter(l, lambda x: regexp_matches(x, '{_EMAIL}'))[1] AS text FROM l UNION ALL SELECT doc_id, 1, list_filter(l, lambda x: len({_RUNS}) > 0)[1] FROM l),
{_found(0, "doc_id, part", "near", False)}, {_found(1, "doc_id", "documents", True)},
o AS (SELECT doc_id, min(name) AS name FROM n0 WHERE name IS NOT NULL GROUP BY doc_id HAVING count(DISTINCT name) = 1)
SELECT d.doc_id, coalesce(o.name, n1.name) AS name, nullif(regexp_extract(text, '{_EMAIL}'), '') AS email FROM documents d LEFT JOIN o USING (doc_id) LEFT JOIN n1 USING (doc_id)""",
)
def _(s, d):
    docs = _read(s, d, "documents")
    first = docs.select(F.regexp_extract("text", "^[A-Z][a-z]+", 0).alias("name")).where("name <> ''").groupBy("name").agg((F.count("*") > 1).alias("popular"))
    last = docs.select(F.explode(F.regexp_extract_all("text", F.lit(r"\. ([A-Z][a-z]+)"), 1)).alias("name")).distinct()
    return names.contacts(docs, "doc_id", "text", staged(first, "first"), staged(last, "last")).select("doc_id", "name", "email")




@query("login_hint", """SELECT page_id, CASE WHEN regexp_matches(html, '(?i)log(ged)?\\s?-?in|sign(ed)?\\s?-?in|remember\\s?me|tabindex') THEN NULL ELSE CASE WHEN page_id % 3 = 0 THEN 'p1' WHEN page_id % 3 = 1 THEN 'p2' ELSE 'p1' END END AS box FROM pages""")
def _(s, d):
    """A form to register before each page's own source and one to sign in after it: the hint stands in the first, after the second, or nowhere."""
    pages = _read(s, d, "pages").withColumn("own", F.col("html"))
    one = F.concat(F.lit("<form><input type=text name=u1><p>"), F.expr("if(page_id % 3 = 0, 'Sign in here', 'Join us')"), F.lit("</p><input type=password name=p1></form>"))
    two = F.concat(F.lit("<form><input type=text name=u2><input type=password name=p2></form><p>"), F.expr("if(page_id % 3 = 1, 'Log-in above', 'Bye')"), F.lit("</p>"))
    made = staged(pages.select("page_id", "url", F.concat(one, "own", two).alias("html"), "own"), "forms")
    nodes = staged(parse_pages(made.select("page_id", "url", "html")), "nodes")
    found = fields.login_of(nodes, made).join(nodes.select("page_id", "node_id", "attrs"), ["page_id", "node_id"]).join(made.select("page_id", "own"), "page_id")
    return found.select("page_id", F.when(~F.col("own").rlike(r"(?i)log(ged)?\s?-?in|sign(ed)?\s?-?in|remember\s?me|tabindex"), F.try_element_at("attrs", F.lit("name"))).alias("box"))


@query("key_rotation", "SELECT c_custkey, c_name, CASE WHEN c_custkey % 10 = 0 THEN NULL ELSE c_name END AS rotated, CASE WHEN c_custkey % 10 = 0 THEN 7 ELSE 3 END AS key_number, CASE WHEN c_custkey % 2 = 0 AND c_custkey % 10 <> 0 THEN c_name END AS old_key_only FROM customer")
def _(s, d):
    """Values under two keys, some under one that is lost: read back, rotated to the newest, and read with the old keys alone."""
    keys = s.createDataFrame([(1, "0123456789abcdef"), (2, "fedcba9876543210"), (3, "0123456789abcdeffedcba9876543210")], "number int, key string")
    lost = s.createDataFrame([(7, "aaaaaaaaaaaaaaaa")], "number int, key string")
    c = _read(s, d, "customer").select("c_custkey", "c_name", F.col("c_name").alias("hidden"))
    one, two, gone = c.where("c_custkey % 10 <> 0 and c_custkey % 2 = 0"), c.where("c_custkey % 10 <> 0 and c_custkey % 2 = 1"), c.where("c_custkey % 10 = 0")
    rows = vault.seal(one, ["hidden"], keys.where("number = 1")).unionByName(vault.seal(two, ["hidden"], keys.where("number <= 2"))).unionByName(vault.seal(gone, ["hidden"], lost))
    rows = staged(rows, "sealed")
    turned = staged(vault.rotate(rows, ["hidden"], keys).select("c_custkey", "c_name", F.col("hidden").alias("rotated")), "rotated")
    old = vault.unseal(rows, ["hidden"], keys.where("number = 1")).select("c_custkey", F.col("hidden").alias("old_key_only"))
    read = vault.unseal(turned.withColumn("key_number", vault.key_of(F.col("rotated"))), ["rotated"], keys)
    return read.join(old, "c_custkey").select("c_custkey", "c_name", "rotated", "key_number", "old_key_only")
