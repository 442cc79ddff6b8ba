"""A declarative extraction query and the plan it makes: written stages, all keyed by page."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.functions import dom
from tessera.functions.dom import NodeMatch
from tessera.functions.text import is_blank
from tessera.functions.urls import UrlRule, absolute, is_valid, passes, rewrite
from tessera.operators import clean, extract, features, fields, nodes as N, paging, rank, score, segment
from tessera.operators.staged import spread, staged
from tessera.sources.html import parse_pages


@dataclass(frozen=True)
class ExtractQuery:
    """What to extract: keywords, record and container examples, URL filters and rewrites, limits, a nested query.

    ``proactive`` takes links that no filter passes out of the pages before extraction;
    ``require_anchor`` wants a link in every record; without ``extract`` pages are returned as they are.
    """

    keywords: str = ""
    match_result: NodeMatch | None = None
    match_parent: NodeMatch | None = None
    whitelist: tuple[str, ...] = ()
    patterns: tuple[str, ...] = ()
    rules: tuple[UrlRule, ...] = ()
    pages: int = 0
    results: int = 0
    nested: ExtractQuery | None = None
    proactive: bool = False
    require_anchor: bool = True
    extract: bool = True
    voters: tuple = field(default_factory=lambda: tuple(features.VOTERS))


#: How strictly links become records, in turn: titles of images count; only texts; URLs of any attribute.
LENIENCY = ({"lenient_title": True, "lenient_url": False}, {"lenient_title": False, "lenient_url": False}, {"lenient_title": False, "lenient_url": True})
COLUMNS = ["page_id", "cand", "pos", "src", "url", "title", "summary", "date"]


def prepared_nodes(pages: DataFrame, query: ExtractQuery) -> DataFrame:
    """Typed nodes of pages, without hidden subtrees and, if asked for, without links that no filter passes."""
    found = N.drop_hidden(staged(parse_pages(spread(pages, "page_id")), "parsed"))
    if query.proactive:
        columns = found.columns
        marked = staged(N.mark_filtered(found, pages, query.whitelist, query.patterns, lambda u: rewrite(u, list(query.rules))), "marked")
        found = N.without(marked.select(*columns, "filtered", "filtered_lenient"), F.col("filtered"))
    return staged(features.typed(found, query.match_result, query.match_parent), "nodes")


def candidates(kinds: DataFrame, query: ExtractQuery | None = None) -> DataFrame:
    """page_id, cand, cand_depth, cand_pos of each page's elected containers, at most eight or as many as tie."""
    query = query or ExtractQuery()
    won = rank.elected(features.candidate_features(kinds), [features.voter_weights(v) for v in query.voters])
    return won.join(kinds.select("page_id", "node_id", "depth"), ["page_id", "node_id"]).select("page_id", F.col("node_id").alias("cand"), F.col("depth").alias("cand_depth"), F.col("turn").alias("cand_pos"))


def containers(nodes: DataFrame, query: ExtractQuery | None = None) -> DataFrame:
    """page_id, node_id of each page's first elected container."""
    query = query or ExtractQuery()
    kinds = nodes if "is_item" in nodes.columns else features.typed(nodes, query.match_result, query.match_parent)
    return candidates(kinds, query).where("cand_pos = 0").select("page_id", F.col("cand").alias("node_id"))


def pager_nodes(kinds: DataFrame, page_no: int | DataFrame = 1) -> DataFrame:
    """page_id, node_id, end_id of each page's control for the next page, or of the list that holds it where that says little else.

    ``page_no`` is that of all pages, or a table (page_id, page_no).
    """
    control = staged(fields.next_page(kinds, page_no), "control")
    ends = kinds.select("page_id", "node_id", "end_id")
    text = N.whole_text(kinds, control.select("page_id", F.col("holder_id").alias("node_id"))).withColumnRenamed("node_id", "holder_id")
    met = control.join(text, ["page_id", "holder_id"], "left")
    node = F.when(fields.is_removable(F.col("text")), F.col("holder_id")).otherwise(F.col("node_id"))
    return met.select("page_id", node.alias("node_id")).join(ends, ["page_id", "node_id"])


def extracted(kinds: DataFrame, ready: DataFrame, tops: DataFrame, query: ExtractQuery, lenient_title: bool, lenient_url: bool) -> tuple[DataFrame, DataFrame]:
    """(records, parts) of candidates: records by page_id, cand, pos with src (pos as it was) and size."""
    parts = segment.segments(ready, tops.select("page_id", "cand", "cand_depth"), lenient_url, query.require_anchor)
    told = extract.records_of(extract.events(kinds, parts, lenient_title, lenient_url))
    sizes = parts.groupBy("page_id", "cand", "pos").agg(F.sum("size").alias("size"))
    dated = extract.group_dates(told, ["page_id", "cand"])
    empty = is_blank(F.col("title")) & is_blank(F.col("summary"))
    if query.require_anchor:
        empty = empty | is_blank(F.col("url"))
    rows = dated.where(~empty).join(sizes, ["page_id", "cand", "pos"])
    # Of the group's records those of an outlying size go first, before any average.
    return staged(clean.drop_outliers(rows, ["page_id", "cand"]).withColumn("src", F.col("pos")), "records"), parts


def chosen(rows: DataFrame, parts: DataFrame, pager: DataFrame, tops: DataFrame, query: ExtractQuery) -> DataFrame:
    """COLUMNS, naive: each page's best-scored candidate, cleaned, or as it was where that scores over 1.05 times as much."""
    by = ["page_id", "cand"]
    base = staged(clean.untrimmed(rows, by), "untrimmed")
    cut = staged(clean.trimmed(base, by), "trimmed")
    both = base.select(*COLUMNS, F.lit(False).alias("trim")).unionByName(cut.select(*COLUMNS, F.lit(True).alias("trim")))
    on = N.overlapping(parts, pager).select("page_id", "cand", F.col("pos").alias("src")).distinct()
    both = staged(both.join(on, ["page_id", "cand", "src"], "left_anti").join(tops.select("page_id", "cand", "cand_pos"), by), "both")
    scores = score.field_scores(both, ["page_id", "cand", "trim"], query.keywords, (F.col("cand_pos") == 0) & F.col("trim"))
    scores = staged(scores.join(tops.select("page_id", "cand", "cand_pos"), by), "scores")
    best = rank.best_of(scores, ["page_id", "trim"], "score", "cand_pos")
    side = score.trimmed_or_not(best, ["page_id"])
    kept = best.join(side, ["page_id", "trim"]).select("page_id", "cand", "trim", "naive")
    return both.join(kept, ["page_id", "cand", "trim"]).select(*COLUMNS, "naive")


#: The records, outermost first, that led to an inner search.
TRAIL = "array<struct<page_id: bigint, pos: int>>"


def best_records(pages: DataFrame, query: ExtractQuery | None = None) -> DataFrame:
    """page_id, pos, url, title, summary, date, naive: the records that a query keeps of pages (page_id, url, html).

    Pages may have ``search`` (what they are results of) and ``page_no`` (which of its pages): limits then hold for each
    search, a search ends where a page repeats the one before, and the control of the next number is taken for the pager. Without these each page is a search.
    With a nested query every record is a search of its own in the page that its url names (of several captures of one url, one):
    a search's inner records take the place of its outer ones, if there are any. Rows of pages with ``search``, and those of
    nested queries, also have search and trail (page_id and pos of the records that led to them).
    Rows that share a page_id, or have none, are pages of their own; a page without html has no records.
    """
    query = query or ExtractQuery()
    if not query.extract:
        return raw_pages(pages)
    paged = pages if "page_no" in pages.columns else pages.withColumn("page_no", F.lit(1))
    paged = paged if "search" in pages.columns else paged.withColumn("search", F.col("page_id"))
    paged = paged.select(F.col("page_id").cast("long").alias("own"), "search", F.col("page_no").cast("int").alias("page_no"), "url", "html")
    unclear = paged.groupBy("own").count().where("count > 1 or own is null")
    if unclear.isEmpty():
        paged = paged.withColumn("page_id", F.col("own"))
    else:
        paged = staged(paged.withColumn("page_id", F.monotonically_increasing_id()), "numbered")
    about = paged.select("page_id", "own", "search", "page_no", F.col("url").alias("base"), F.array().cast(TRAIL).alias("trail"))
    out = _searched(paged, about, query, paged, 0, "page_no" in pages.columns)
    out = out.drop("page_no").withColumn("page_id", F.col("own")).drop("own")
    return staged(out.select("page_id", "pos", "url", "title", "summary", "date", "naive", *(["search", "trail"] if "search" in pages.columns or query.nested is not None else [])), "found")


def _searched(source: DataFrame, about: DataFrame, query: ExtractQuery, captured: DataFrame, depth: int, numbered: bool) -> DataFrame:
    """Records of searches: source are their pages (page_id, page_no, url, html), once each, and about says which search and trail wants which page."""
    if query.pages > 0:
        about, source = about.where(F.col("page_no") <= query.pages), source.where(F.col("page_no") <= query.pages)
    kinds = prepared_nodes(source.select("page_id", "url", "html"), query)
    tops = staged(candidates(kinds, query), "tops")
    ready, pager = staged(segment.prepared(kinds), "ready"), staged(pager_nodes(kinds, source.select("page_id", "page_no")), "pager")
    found, rest = None, tops
    for leniency in LENIENCY:
        rows, parts = extracted(kinds, ready, rest, query, **leniency)
        got = staged(chosen(rows, parts, pager, rest, query), "chosen")
        found = got if found is None else found.unionByName(got)
        rest = staged(rest.join(got.select("page_id").distinct(), "page_id", "left_anti"), "rest")
        if rest.isEmpty():
            break
    by = ["search", "trail"]
    out = found.join(about, "page_id").withColumn("url", absolute(F.col("url"), F.col("base")))
    out = out.withColumn("url", rewrite(F.col("url"), list(query.rules))).where(passes(F.col("url"), query.whitelist, query.patterns))
    if numbered:
        out = paging.stop_at_repeat(out.withColumn("row", F.col("pos")), by).drop("row")
    if query.results > 0:
        out = paging.limit_results(out, by, results=query.results)
    out = out.withColumn("url", rewrite(F.col("url"), list(query.rules), export=True))
    out = out.select("page_id", "own", *by, "page_no", "pos", "url", "title", "summary", "date", "naive")
    if query.nested is None:
        return out
    out = staged(out, "outer")
    known = captured.groupBy("url").agg(F.min_by(F.struct("page_id", "own"), "page_id").alias("p"))
    step = F.array(F.struct(F.col("own").alias("page_id"), F.col("pos").cast("int").alias("pos")))
    inner = out.where(is_valid(F.col("url"))).select("search", F.concat("trail", step).cast(TRAIL).alias("trail"), "url").join(known, "url")
    inner = staged(inner.select("p.page_id", "p.own", "search", F.lit(1).alias("page_no"), F.col("url").alias("base"), "trail"), "inner")
    wanted = captured.join(inner.select("page_id").distinct(), "page_id", "left_semi").withColumn("page_no", F.lit(1))
    deeper = _searched(wanted, inner, query.nested, captured, depth + 1, False)
    return _instead(out, deeper, depth)


def _instead(outer: DataFrame, inner: DataFrame, depth: int) -> DataFrame:
    """outer records, of searches whose trail has ``depth`` steps, or the inner ones that they led to."""
    led = inner.withColumnRenamed("trail", "deep").withColumn("trail", F.slice("deep", 1, depth) if depth else F.array().cast(TRAIL))
    out = paging.replaced(outer, led, ["search", "trail"])
    return out.withColumn("trail", F.coalesce("deep", "trail")).drop("deep")


def raw_pages(pages: DataFrame) -> DataFrame:
    """page_id, url, page_html: pages without extraction, without the marks of a capture."""
    marks = "|".join([dom.NODE_MARK, dom.HIDDEN_MARK, *dom.FILTER_MARKS])
    return pages.select("page_id", "url", F.regexp_replace("html", marks, "").alias("page_html"))


def keyword_pages(pages: DataFrame, keywords: str) -> DataFrame:
    """Captured pages whose text shares a stem with the keywords: what a search for them would give."""
    from tessera.functions.text import has_stem

    text = F.regexp_replace("html", r"(?s)<(script|style)\b.*?</\1>|<[^>]*>", " ")
    return pages.where(has_stem(F.lit(keywords), text))


def named(column: str, match: NodeMatch) -> Column:
    """A node predicate as a named column."""
    return match.column().alias(column)
