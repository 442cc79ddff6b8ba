"""Queries of the DOM, record, ranking and paging operators."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from tessera.functions import dom
from tessera.operators import clean, features, fields, paging, rank, score, tuning
from tessera.operators.staged import scratch_path, staged
from tessera.plans.query import best_records, containers
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


# ---------------------------------------------------------------- nodes and links

_LINKS = """links AS (
  SELECT page_id, url, unnest(regexp_extract_all(html, '<a href="([^"]*)">[^<]*</a>', 1)) AS href,
    unnest(regexp_extract_all(html, '<a href="[^"]*">([^<]*)</a>', 1)) AS title,
    unnest(generate_series(1, len(regexp_extract_all(html, '<a href="')))) AS pos FROM pages
)"""


def _links(s, d):
    pages = _read(s, d, "pages")
    return fields.links(parse_pages(pages), pages)


@query("links_extract", f"WITH {_LINKS} SELECT page_id, pos, href, replace(title, '&amp;', '&') AS title FROM links")
def _(s, d):
    return _links(s, d).select("page_id", F.col("pos").cast("long").alias("pos"), "href", "title")


@query("links_absolute", f"WITH {_LINKS} SELECT page_id, pos, regexp_extract(url, '^(https?://[^/?#&]*)', 1) || href AS absolute FROM links")
def _(s, d):
    return _links(s, d).select("page_id", F.col("pos").cast("long").alias("pos"), F.col("url").alias("absolute"))


@query("tag_counts", """SELECT page_id, len(regexp_extract_all(html, '<p[ >]')) AS n_p, len(regexp_extract_all(html, '<li[ >]')) AS n_li, len(regexp_extract_all(html, '<a ')) AS n_a, len(regexp_extract_all(html, '<br')) AS n_br FROM pages""")
def _(s, d):
    nodes = parse_pages(_read(s, d, "pages"))
    return nodes.groupBy("page_id").agg(*[F.count_if(F.col("tag") == t).alias(f"n_{t}") for t in ("p", "li", "a", "br")])


_TAGS = "tags AS (SELECT page_id, unnest(regexp_extract_all(html, '<([a-z][a-z0-9]*)[ >/]', 1)) AS tag FROM pages)"
_IS = {k: "tag IN (" + ", ".join(f"'{t}'" for t in v) + ")" for k, v in dom.CLASSES.items()}


@query("tag_classes", f"WITH {_TAGS} SELECT page_id, {', '.join(f'count(*) FILTER ({v}) AS {k}' for k, v in _IS.items())} FROM tags GROUP BY page_id")
def _(s, d):
    nodes = parse_pages(_read(s, d, "pages")).where("substr(tag, 1, 1) <> '#'")
    return nodes.groupBy("page_id").agg(*[F.count_if(dom.is_tag(k)).alias(k) for k in dom.CLASSES])


@query("subtree_counts", """SELECT page_id, len(regexp_extract_all(html, '<a ')) AS n_anchors, len(regexp_extract_all(html, '<li>')) AS n_li FROM pages""")
def _(s, d):
    nodes = parse_pages(_read(s, d, "pages"))
    lists = features.subtree_counts(nodes).where("tag = 'ul'")
    return lists.select("page_id", F.col("n_anchors").cast("long").alias("n_anchors"), F.col("n_items").cast("long").alias("n_li"))


@query("child_statistics", f"""WITH {_LINKS}, l AS (SELECT page_id, length(title) AS n FROM links)
SELECT page_id, count(*) AS n, round(avg(n), 6) AS mean, round(coalesce(stddev_samp(n), 0), 6) AS dev,
  CASE WHEN count(*) < 3 OR stddev_samp(n) = 0 THEN 0 ELSE round(skewness(n), 6) + 0.0 END AS skew FROM l GROUP BY page_id""")
def _(s, d):
    out = features.group_statistics(_links(s, d).withColumn("m", F.length("title")), ["page_id"], ["m"])
    return out.select("page_id", "n", F.round("m_mean", 6).alias("mean"), F.round("m_stddev", 6).alias("dev"), (F.round("m_skew", 6) + 0.0).alias("skew"))


@query("page_signatures", None)
def _(s, d):
    return features.signatures(parse_pages(_read(s, d, "pages")))


@query("candidate_features", None)
def _(s, d):
    return features.candidate_features(staged(parse_pages(_read(s, d, "pages")), "nodes")).select("page_id", "node_id", "features")


@query("elected_containers", "SELECT page_id, 'ul' AS tag FROM pages")
def _(s, d):
    nodes = staged(parse_pages(_read(s, d, "pages")), "nodes")
    return containers(nodes).join(nodes.select("page_id", "node_id", "tag"), ["page_id", "node_id"]).select("page_id", "tag")


@query("best_records", f"""WITH {_LINKS}, u AS (
  SELECT page_id, regexp_extract(url, '^(https?://[^/?#&]*)', 1) || href AS url, title, pos FROM links
), k AS (SELECT *, row_number() OVER (PARTITION BY page_id, url ORDER BY pos DESC) AS turn, min(pos) OVER (PARTITION BY page_id, url) AS first FROM u)
SELECT page_id, first AS pos, url, replace(title, '&amp;', '&') AS title FROM k WHERE turn = 1""")
def _(s, d):
    return best_records(_read(s, d, "pages")).select("page_id", F.col("pos").cast("long").alias("pos"), "url", "title")


@query("fixed_point", "SELECT p_partkey, CAST(trunc(p_retailprice / p_size * 1000) AS INT) AS r, CASE WHEN p_size <> 0 AND p_size % 5 = 0 THEN -1 ELSE 1 END AS five, least(abs(p_size - greatest(p_size // 10, 1) * 10), (p_size // 10 + 1) * 10 - p_size) AS ten FROM part")
def _(s, d):
    p = _read(s, d, "part")
    return p.select("p_partkey", features.ratio(F.col("p_retailprice"), F.col("p_size")).alias("r"), features.divides(F.col("p_size"), 5).alias("five"), features.distance_to_multiple(F.col("p_size"), 10).alias("ten"))


# ---------------------------------------------------------------- ranking

_CMP = "CASE WHEN {a} > 0 AND {b} > 0 AND abs({a} - {b}) / ({a} + {b}) < 0.125 THEN 0 ELSE sign({a} - {b}) END"


@query("compare_tolerant", "SELECT a.s_suppkey AS a, b.s_suppkey AS b, CAST(" + _CMP.format(a="a.s_acctbal", b="b.s_acctbal") + " AS INT) AS c FROM supplier a JOIN supplier b USING (s_nationkey)")
def _(s, d):
    a, b = (_read(s, d, "supplier").select(F.col("s_suppkey").alias(x), F.col("s_acctbal").alias(f"v{x}"), "s_nationkey") for x in "ab")
    return rank.pairs(a, b, "s_nationkey").select("a", "b", rank.compare(F.col("va"), F.col("vb")).alias("c"))


_NET = f"sign(2 * ({_CMP.format(a='a.p_size', b='b.p_size')}) - 3 * ({_CMP.format(a='a.p_retailprice', b='b.p_retailprice')}))"
_PART = "p AS (SELECT p_partkey, p_brand AS g, CAST(p_size AS DOUBLE) AS p_size, p_retailprice FROM part)"


def _parts(s, d):
    return _read(s, d, "part").select("p_partkey", F.col("p_brand").alias("g"), F.array(F.col("p_size").cast("double"), "p_retailprice").alias("features"))


#: Weights of a part's size and price.
_WEIGHTS = (2.0, -3.0)


@query("tournament_losses", f"WITH {_PART} SELECT a.g, a.p_partkey, CAST(sum(CASE WHEN a.p_partkey = b.p_partkey OR {_NET} <> -1 THEN 1 ELSE 0 END) AS BIGINT) AS loss FROM p a JOIN p b ON a.g = b.g GROUP BY 1, 2")
def _(s, d):
    return rank.losses(_parts(s, d), ["g"], "p_partkey", _WEIGHTS)


@query(
    "tournament_winner",
    f"""WITH {_PART}, l AS (
  SELECT a.g, a.p_partkey, sum(CASE WHEN a.p_partkey = b.p_partkey OR {_NET} <> -1 THEN 1 ELSE 0 END) AS loss FROM p a JOIN p b ON a.g = b.g GROUP BY 1, 2
), m AS (SELECT *, min(loss) OVER (PARTITION BY g) AS low FROM l), t AS (SELECT p.* FROM p JOIN m USING (p_partkey) WHERE loss = low),
n AS (SELECT g, count(*) AS n FROM t GROUP BY g),
f AS (SELECT a.g, a.p_partkey, sum(CASE WHEN a.p_partkey = b.p_partkey OR {_NET} <> -1 THEN 1 ELSE 0 END) AS loss FROM t a JOIN t b ON a.g = b.g GROUP BY 1, 2)
SELECT f.g, f.p_partkey FROM f JOIN n USING (g) WHERE n = 1 OR loss = 1""",
)
def _(s, d):
    return rank.tournament(_parts(s, d), ["g"], "p_partkey", _WEIGHTS)


#: Three inputs, two hidden neurons, one output that also hears the third input.
_LAYERED = "3;3;3;0,0:1,0,2+0,1:1,0,-1+0,1:1,1,3+0,2:1,1,1+0,2:2,0,-2+1,0:2,0,3+1,1:2,0,1"
_SIGN = "CASE WHEN {a} > 0 AND {b} > 0 AND abs({a} - {b}) < 0.125 * ({a} + {b}) THEN 0 ELSE sign({a} - {b}) END"


@query(
    "layered_net_losses",
    f"""WITH {_LINKS}, f AS (SELECT page_id, pos, length(replace(title, '&amp;', '&')) AS x, length(href) AS y, pos AS z FROM links),
c AS (SELECT a.page_id, a.pos, a.pos = b.pos AS self, {_SIGN.format(a="a.x", b="b.x")} AS x, {_SIGN.format(a="a.y", b="b.y")} AS y, {_SIGN.format(a="a.z", b="b.z")} AS z
  FROM f a JOIN f b USING (page_id)),
h AS (SELECT *, sign(2 * x - y) AS h0, sign(3 * y + z) AS h1 FROM c)
SELECT page_id, pos, count(*) FILTER (WHERE sign(3 * h0 + h1 - 2 * z) <> -1) AS loss FROM h GROUP BY page_id, pos""",
)
def _(s, d):
    (net,) = rank.collected(rank.nets_of(s.createDataFrame([(_LAYERED,)], "value string")))
    links = _links(s, d).select("page_id", F.col("pos").cast("long").alias("pos"), F.array(F.length("title"), F.length("href"), "pos").alias("features"))
    return rank.net_losses(links, ["page_id"], "pos", net)


_RIGHT = "count(*) FILTER (WHERE sign({0} * x + {1} * y) = -1)"


@query(
    "population_scores",
    f"""WITH n AS (SELECT p_brand, p_size AS s, p_retailprice AS r, lead(p_size) OVER w AS ns, lead(p_retailprice) OVER w AS nr FROM part WINDOW w AS (PARTITION BY p_brand ORDER BY p_partkey)),
c AS (SELECT {_SIGN.format(a="s", b="ns")} AS x, {_SIGN.format(a="r", b="nr")} AS y FROM n WHERE ns IS NOT NULL)
SELECT 0 AS copy, {_RIGHT.format(3, -1)} AS right, count(*) AS total FROM c UNION ALL SELECT 1, {_RIGHT.format(-2, 1)}, count(*) FROM c
UNION ALL SELECT 2, count(*) FILTER (WHERE (sign(3 * x - y) = -1)::INT + (sign(-2 * x + y) = -1)::INT + (sign(x + 4 * y) = -1)::INT >= 2), count(*) FROM c""",
)
def _(s, d):
    """Each part against the next of its brand: two nets alone, and with a third one as a committee."""
    after = Window.partitionBy("p_brand").orderBy("p_partkey")
    both = F.array(F.col("p_size").cast("double"), "p_retailprice")
    pairs = _read(s, d, "part").select(both.alias("left"), F.lead(both).over(after).alias("right")).where("right is not null")
    nets = [rank.Net(2, 2, 2, ((0, 0, 1, 0, a), (0, 1, 1, 0, b))) for a, b in ((3, -1), (-2, 1), (1, 4))]
    return tuning.population_scores(tuning.sign_table(pairs), [nets[:1], nets[1:2], nets]).select(F.col("copy").cast("long").alias("copy"), "right", "total")


@query("vote_majority", """WITH v AS (SELECT o_orderpriority AS g, o_custkey % 5 AS c FROM orders), n AS (SELECT g, c, count(*) AS votes FROM v GROUP BY 1, 2)
SELECT g, c, votes, votes >= 4 // 2 + 1 AS elected FROM n QUALIFY votes = max(votes) OVER (PARTITION BY g)""")
def _(s, d):
    return rank.majority(_read(s, d, "orders").select(F.col("o_orderpriority").alias("g"), (F.col("o_custkey") % 5).alias("c")), ["g"], "c", 4)


@query("argmax_group", "SELECT o_custkey, o_orderkey FROM orders QUALIFY row_number() OVER (PARTITION BY o_custkey ORDER BY o_totalprice DESC, o_orderkey) = 1")
def _(s, d):
    return rank.best_of(_read(s, d, "orders"), ["o_custkey"], "o_totalprice", "o_orderkey").select("o_custkey", "o_orderkey")


# ---------------------------------------------------------------- cleaning

_RECORDS = """r AS (
  SELECT source AS g, row_number() OVER (PARTITION BY source ORDER BY doc_id) AS pos, doc_id,
    CASE WHEN doc_id % 9 = 0 THEN '/r' || doc_id % 40 ELSE 'http://h.example/' || doc_id % 40 END AS url,
    CASE WHEN doc_id % 5 = 0 THEN lang ELSE split_part(text, '. ', 1) END AS title,
    CASE WHEN doc_id % 11 = 0 THEN '' ELSE 'Read more: ' || text || ' of ' || lang END AS summary, CAST(NULL AS VARCHAR) AS date
  FROM documents
)"""


def _records(s, d):
    docs = _read(s, d, "documents")
    pos = F.row_number().over(Window.partitionBy("source").orderBy("doc_id"))
    return docs.select(
        F.col("source").alias("g"),
        pos.cast("long").alias("pos"),
        "doc_id",
        F.expr("case when doc_id % 9 = 0 then concat('/r', doc_id % 40) else concat('http://h.example/', doc_id % 40) end").alias("url"),
        F.expr("case when doc_id % 5 = 0 then lang else split_part(text, '. ', 1) end").alias("title"),
        F.expr("case when doc_id % 11 = 0 then '' else concat('Read more: ', text, ' of ', lang) end").alias("summary"),
        F.lit(None).cast("string").alias("date"),
    )


_TRIM = r"regexp_replace({}, '^[\x00-\x20]+|[\x00-\x20]+$', '', 'g')"
_AVG = f"a AS (SELECT *, avg(length({_TRIM.format('title')})) OVER (PARTITION BY g) AS avg_title, avg(length({_TRIM.format('summary')})) OVER (PARTITION BY g) AS avg_summary FROM r)"


def _ids(df):
    return df.select("g", "pos", "doc_id")


@query("group_averages", f"WITH {_RECORDS}, {_AVG} SELECT g, pos, round(avg_title, 6) AS avg_title, round(avg_summary, 6) AS avg_summary FROM a")
def _(s, d):
    return clean.group_averages(_records(s, d), ["g"]).select("g", "pos", F.round("avg_title", 6).alias("avg_title"), F.round("avg_summary", 6).alias("avg_summary"))


@query("swap_fields", f"""WITH {_RECORDS}, {_AVG}, w AS (SELECT *, (avg_title < 1 AND avg_summary > 1) OR (avg_title > avg_summary AND avg_summary > 10) AS sw FROM a)
SELECT g, pos, CASE WHEN sw THEN summary ELSE title END AS title, CASE WHEN sw THEN title ELSE summary END AS summary FROM w""")
def _(s, d):
    return clean.swap_fields(_records(s, d), ["g"]).select("g", "pos", "title", "summary")


@query("short_row_filter", f"""WITH {_RECORDS}, {_AVG} SELECT g, pos, doc_id FROM a WHERE NOT ((avg_summary > 60 OR avg_title > 60) AND length(title) < 20
  AND length({_TRIM.format("regexp_replace(summary, '[0-9.…]', '', 'g')")}) < 20)""")
def _(s, d):
    return _ids(clean.drop_short(_records(s, d), ["g"]))


@query("distinct_last_at_first", f"""WITH {_RECORDS}, k AS (SELECT *, row_number() OVER (PARTITION BY g, url ORDER BY pos DESC) AS turn, min(pos) OVER (PARTITION BY g, url) AS first FROM r)
SELECT g, first AS pos, doc_id FROM k WHERE turn = 1""")
def _(s, d):
    return _ids(clean.distinct_urls(_records(s, d), ["g"]))


@query("heavy_duplicate_filter", f"""WITH {_RECORDS}, {_AVG}, k AS (SELECT *, count(*) OVER (PARTITION BY g, title, summary, date) / count(*) OVER (PARTITION BY g) AS share FROM a)
SELECT g, pos, doc_id FROM k WHERE NOT ((avg_summary > 10 OR avg_title > 10) AND share > 0.4)""")
def _(s, d):
    return _ids(clean.drop_repeated(_records(s, d), ["g"]))


@query("relative_minority_filter", f"""WITH {_RECORDS}, k AS (SELECT *, NOT (url LIKE '//%' OR url LIKE '%://%') AS rel FROM r), w AS (SELECT *, count(*) OVER (PARTITION BY g) > 2 AND avg(CAST(rel AS INT)) OVER (PARTITION BY g) < 0.495 AS few FROM k)
SELECT g, pos, doc_id FROM w WHERE NOT (few AND rel)""")
def _(s, d):
    return _ids(clean.drop_relative_minority(_records(s, d), ["g"]))


@query("contained_url_filter", f"""WITH {_RECORDS}, n AS (SELECT g, count(*) AS n FROM r GROUP BY g)
SELECT g, pos, doc_id FROM r x JOIN n USING (g) WHERE NOT (n > 2 AND NOT EXISTS (SELECT 1 FROM r y WHERE y.g = x.g AND y.pos <> x.pos AND NOT contains(y.url, x.url)))""")
def _(s, d):
    return _ids(clean.drop_contained_urls(_records(s, d), ["g"]))


@query("edge_symbol_trim", f"""WITH {_RECORDS}, b AS (SELECT *, pos % 50 = 1 AS banned, row_number() OVER (PARTITION BY g ORDER BY pos) AS place, count(*) OVER (PARTITION BY g) AS n FROM r),
w AS (SELECT *, max(CASE WHEN place > 1 AND place < n AND banned THEN 1 ELSE 0 END) OVER (PARTITION BY g) AS inside FROM b)
SELECT g, pos, doc_id FROM w WHERE NOT (n > 2 AND inside = 0 AND (place = 1 OR place = n) AND banned)""")
def _(s, d):
    marked = _records(s, d).withColumn("title", F.when(F.col("pos") % 50 == 1, F.lit("» 2")).otherwise(F.lit("t")))
    return _ids(clean.trim_banned_edges(marked, ["g"]))


@query("edge_empty_trim", f"""WITH {_RECORDS}, b AS (SELECT *, trim(summary) = '' AS blank FROM r), w AS (SELECT *, min(CASE WHEN NOT blank THEN pos END) OVER (PARTITION BY g) AS low, max(CASE WHEN NOT blank THEN pos END) OVER (PARTITION BY g) AS high,
  count(*) OVER (PARTITION BY g) > 2 AND avg(CAST(blank AS INT)) OVER (PARTITION BY g) < 0.4 AS few FROM b) SELECT g, pos, doc_id FROM w WHERE NOT (few AND (pos < low OR pos > high))""")
def _(s, d):
    return _ids(clean.trim_empty_edges(_records(s, d), ["g"]))


@query("alternating_merge", None)
def _(s, d):
    return clean.merge_alternating(_records(s, d), ["g"]).select("g", "pos", "title", "summary")


@query("affix_strip", """WITH r AS (SELECT source AS g, doc_id, 'Read more: ' || lang || ' ' || (doc_id % 7) || ' of the page' AS s FROM documents)
SELECT g, doc_id, regexp_replace(regexp_replace(s, '^Read more: ', ''), ' of the page$', '') AS summary FROM r""")
def _(s, d):
    docs = _read(s, d, "documents").selectExpr("source as g", "doc_id", "concat('Read more: ', lang, ' ', doc_id % 7, ' of the page') as summary")
    return clean.strip_affixes(docs, ["g"]).select("g", "doc_id", "summary")


@query("outlier_trim", """WITH z AS (SELECT source, doc_id, (n_chars - avg(n_chars) OVER w) / stddev_samp(n_chars) OVER w AS z FROM documents WINDOW w AS (PARTITION BY source))
SELECT source, doc_id FROM z WHERE coalesce(z <= 4, true)""")
def _(s, d):
    return clean.drop_outliers(_read(s, d, "documents"), ["source"], "n_chars").select("source", "doc_id")


# ---------------------------------------------------------------- scores, dates, forms, paging


@query("first_non_empty", "SELECT o_custkey, o_orderkey, o_orderpriority FROM orders QUALIFY o_orderpriority = min(o_orderpriority) OVER (PARTITION BY o_custkey)")
def _(s, d):
    return score.first_non_empty(_read(s, d, "orders"), ["o_custkey"], "o_orderpriority").select("o_custkey", "o_orderkey", "o_orderpriority")


@query("trim_choice", "SELECT c_custkey, c_acctbal / 2 <= round_even(1.05 * (c_acctbal - 1000), 0) AS trim FROM customer")
def _(s, d):
    c = _read(s, d, "customer")
    both = c.select("c_custkey", F.lit(True).alias("trim"), (F.col("c_acctbal") - 1000).alias("naive")).unionByName(c.select("c_custkey", F.lit(False).alias("trim"), (F.col("c_acctbal") / 2).alias("naive")))
    return score.trimmed_or_not(both, ["c_custkey"])


@query("field_scores", None)
def _(s, d):
    parts = _read(s, d, "part").select(F.col("p_brand").alias("g"), F.col("p_partkey").alias("pos"), F.lit("http://h.example/x").alias("url"), F.col("p_name").alias("title"), F.col("p_type").alias("summary"), F.lit(None).cast("string").alias("date"))
    return score.field_scores(parts, ["g"], "small")


@query("dates_by_group", """WITH o AS (SELECT o_custkey, o_orderkey, strftime(o_orderdate, '%d/%m/%Y') AS t FROM orders)
SELECT o_custkey, o_orderkey, substr(t, 7) || '-' || substr(t, 4, 2) || '-' || substr(t, 1, 2) AS date FROM o""")
def _(s, d):
    o = _read(s, d, "orders").select("o_custkey", "o_orderkey", F.concat(F.lit("On "), F.date_format("o_orderdate", "dd/MM/yyyy"), F.lit(" it was")).alias("t"))
    return fields.dates(o, ["o_custkey"], "t").select("o_custkey", "o_orderkey", "date")


@query("nearest_before", """SELECT e.user_id, e.event_id, max(p.event_id) AS anchor FROM events e JOIN events p ON p.user_id = e.user_id AND p.event_id < e.event_id AND p.event_type = 'click' WHERE e.event_type = 'purchase' GROUP BY 1, 2""")
def _(s, d):
    e = _read(s, d, "events").select("user_id", "event_id", "event_type")
    out = fields.nearest_before(e, ["user_id"], "event_id", F.col("event_type") == "click", F.col("event_type") == "purchase", "event_type")
    return out.select("user_id", "event_id", F.col("anchor_at").alias("anchor")).where("anchor is not null")


_TURNS = "t AS (SELECT conv_id AS g, turn AS page_no, 1 AS pos, role AS url, text AS title, CAST(NULL AS VARCHAR) AS summary FROM conversations)"


def _turns(s, d):
    return _read(s, d, "conversations").selectExpr("conv_id as g", "turn as page_no", "1 as pos", "role as url", "text as title", "cast(null as string) as summary")


@query("page_limit", f"WITH {_TURNS} SELECT g, page_no FROM t WHERE page_no <= 2 QUALIFY row_number() OVER (PARTITION BY g ORDER BY page_no, pos) <= 2")
def _(s, d):
    return paging.limit_results(_turns(s, d), ["g"], pages=2, results=2).select("g", "page_no")


@query("duplicate_page_stop", f"""WITH {_TURNS}, m AS (SELECT *, lag(url) OVER w AS bu, lag(title) OVER w AS bt, lag(page_no) OVER w AS bp FROM t WINDOW w AS (PARTITION BY g ORDER BY page_no)),
st AS (SELECT g, min(page_no) AS stop FROM m WHERE bp = page_no - 1 AND url = bu AND title = bt GROUP BY g) SELECT t.g, page_no FROM t LEFT JOIN st USING (g) WHERE stop IS NULL OR page_no < stop""")
def _(s, d):
    return paging.stop_at_repeat(_turns(s, d), ["g"]).select("g", "page_no")


@query("pages_union", "SELECT conv_id, count(*) AS n FROM conversations GROUP BY conv_id")
def _(s, d):
    c = _read(s, d, "conversations")
    return c.where("turn % 2 = 0").unionByName(c.where("turn % 2 = 1")).groupBy("conv_id").agg(F.count("*").alias("n"))


@query("nested_query", "SELECT o_orderkey, l_linenumber FROM orders JOIN lineitem ON l_orderkey = o_orderkey WHERE o_orderstatus = 'F'")
def _(s, d):
    outer = _read(s, d, "orders").where("o_orderstatus = 'F'").select("o_orderkey")
    return paging.nested(outer, _read(s, d, "lineitem").select(F.col("l_orderkey").alias("o_orderkey"), "l_linenumber"), "o_orderkey")


@query("fetch_enrich", "SELECT page_id, url, length(html) AS n FROM pages")
def _(s, d):
    p = _read(s, d, "pages")
    return paging.enriched(p.select("page_id", "url"), p, on=["page_id", "url"]).select("page_id", "url", F.length("page_html").alias("n"))


@query("collapse_expand", "SELECT doc_id, text FROM documents")
def _(s, d):
    path = scratch_path(s, "collapsed")
    return paging.expand(paging.collapse(_read(s, d, "documents"), path), path).select("doc_id", "text")


@query("form_controls", """SELECT page_id, c.tag, c.name, c.type, c.label, CASE WHEN c.tag = 'select' THEN CAST(page_id AS VARCHAR) END AS first_option FROM pages,
  (VALUES ('input', 'user', 'text', 'User'), ('input', 'pw', 'password', NULL), ('select', 's', NULL, NULL), ('button', NULL, NULL, NULL)) AS c(tag, name, type, label)""")
def _(s, d):
    html = "concat('<form><label for=\"u\">User</label><input id=\"u\" name=\"user\" type=\"text\"><input name=\"pw\" type=\"password\"><select name=\"s\"><option value=\"', page_id, '\">x</option></select><button>Go</button></form>')"
    nodes = staged(parse_pages(_read(s, d, "pages").selectExpr("page_id", f"{html} as html")), "nodes")
    found = fields.named_controls(fields.form_controls(nodes))
    return found.select("page_id", "tag", "name", "type", "label", F.try_element_at("options", F.lit(1)).alias("first_option"))


@query("next_page_control", "SELECT page_id, page_id % 2 = 0 AS by_number FROM pages")
def _(s, d):
    html = "case when page_id % 2 = 0 then '<p><a>1</a> <a>2</a> <a>3</a></p>' else '<p><a href=x>Home</a><a href=y>Next</a></p>' end"
    nodes = staged(parse_pages(_read(s, d, "pages").selectExpr("page_id", f"{html} as html")), "nodes")
    found = fields.next_page(nodes, 1).join(nodes.select("page_id", "node_id", "end_id"), ["page_id", "node_id"])
    text = fields.subtree_text(nodes, found)
    return text.select("page_id", (F.col("text") == "2").alias("by_number"))
