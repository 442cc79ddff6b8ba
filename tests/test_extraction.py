"""Segmentation, competing links, elections, scores, sources and streams on hand-made rows."""

import base64
import tempfile

import numpy as np
from pyspark.sql import functions as F

from tessera.functions.dom import NodeMatch
from tessera.operators import clean, extract, features, nodes as N, paging, rank, score, segment, staged
from tessera.plans.query import ExtractQuery, best_records
from tessera.queries import nodes as nodes_queries, records as records_queries
from tessera.sources import exports
from tessera.sources.html import page_rows, parse_pages
from tessera.streaming import extract as stream


def typed(spark, *html):
    pages = spark.createDataFrame([(i, f"http://h.example/p{i}", h) for i, h in enumerate(html)], "page_id long, url string, html string")
    return pages, features.typed(parse_pages(pages)).cache()


def test_places_of_outer_html():
    html = "<div><p>a<b>c</b> d<br></div><!-- x --><i>z"
    cut = {r[6]: html[r[10] : r[11]] for r in page_rows(html)}
    assert cut["p"] == "<p>a<b>c</b> d<br>" and cut["b"] == "<b>c</b>" and cut["div"] == "<div><p>a<b>c</b> d<br></div>" and cut["i"] == "<i>z"


def odd_headings(spark):
    """Pages as a table of a new folder: cut references, other tags first, no heading, no html."""
    html = ["<article><h1> A&amp;B &quot;c&quot; d&amp</h1></article>", "<article><h1 id=x>no</h1><h1><b>n</b>o</h1><h1>yes</h1></article>", "<article><p>x</article>", "<article><h1></h1></article>", None]
    folder = tempfile.mkdtemp()
    spark.createDataFrame([(i, f"http://h.example/p{i}", h) for i, h in enumerate(html)], "page_id long, url string, html string").write.parquet(f"{folder}/pages.parquet")
    return folder, {0: 'A&B "c" d&amp', 1: "yes", 2: "", 3: "", 4: None}


def test_first_heading_of_odd_pages(spark):
    folder, wanted = odd_headings(spark)
    assert {r["page_id"]: r["title"] for r in nodes_queries.QUERIES["first_heading"](spark, folder).collect()} == wanted


def test_child_text_of_odd_pages(spark):
    folder, wanted = odd_headings(spark)
    assert {r["page_id"]: r["title"] for r in nodes_queries.QUERIES["child_text"](spark, folder).collect()} == wanted


def twice_captured(spark):
    """Pages as a table of a new folder: a url captured three times, no url, no html."""
    rows = [(0, "http://h.example/a", "x"), (1, "http://h.example/a", "yy"), (2, "http://h.example/a", "zzz"), (3, None, "vvvv"), (4, None, "wwwww"), (6, "http://h.example/b", None)]
    folder = tempfile.mkdtemp()
    pages = spark.createDataFrame(rows, "page_id long, url string, html string")
    pages.write.parquet(f"{folder}/pages.parquet")
    return folder, pages


def test_pages_are_enriched_by_their_own_captures(spark):
    folder, pages = twice_captured(spark)
    got = [tuple(r) for r in records_queries.QUERIES["fetch_enrich"](spark, folder).select("page_id", "n").orderBy("page_id").collect()]
    assert got == [(0, 1), (1, 2), (2, 3), (3, 4), (4, 5), (6, None)]
    # By url alone, a record meets one of the captures.
    one = paging.enriched(spark.createDataFrame([("http://h.example/a",)], "url string"), pages).collect()
    assert [tuple(r) for r in one] == [("http://h.example/a", "x")]


def test_fallback_is_for_pages_without_a_capture(spark):
    folder, _ = twice_captured(spark)
    got = [tuple(r) for r in nodes_queries.QUERIES["fetch_fallback"](spark, folder).select("page_id", "n").orderBy("page_id").collect()]
    assert got == [(0, 1), (1, 6), (2, 3), (3, 6), (4, 5), (6, None)]


def test_small_files_are_not_broadcast_unmeasured(spark, tmp_path):
    """Rows that are many times as large in memory as in their files; the session's own limits are kept."""
    spark.range(100000).selectExpr("id div 100000 as page_id", "repeat('x', 100) as a").write.parquet(f"{tmp_path}/like")
    like = spark.read.parquet(f"{tmp_path}/like")
    plan = lambda: spark.range(10).withColumnRenamed("id", "page_id").join(like, "page_id", "left")._jdf.queryExecution().executedPlan().toString()
    limits = [spark.conf.get(f"spark.sql.{k}autoBroadcastJoinThreshold", None) for k in ("", "adaptive.")]
    assert "Broadcast" in plan(), plan()
    with staged.measured_joins(spark):
        assert "Broadcast" not in plan()
    assert [spark.conf.get(f"spark.sql.{k}autoBroadcastJoinThreshold", None) for k in ("", "adaptive.")] == limits


def test_python_work_is_spread(spark):
    assert staged.spread(spark.range(100).coalesce(1), "id").rdd.getNumPartitions() >= 4


def test_equal_groups_of_texts_are_scored_alike(spark):
    rows = [(g, i, f"http://h.example/{i}", f"word{i} of some title", "s" if g else f"summary {i} of that", None) for g in range(3) for i in range(4)] + [(5, 0, "u", "one", None, None), (6, 0, "u", "", "", None)]
    got = {r["g"]: r["distance"] for r in score.field_scores(spark.createDataFrame(rows, "g int, pos int, url string, title string, summary string, date string"), ["g"]).collect()}
    assert got[1] == got[2] > 0 and got[0] > 0 and got[5] == got[6] == 0
    # Titles without their common words: stems are one edit apart, of 6 pairs.
    text = ["word0 of some title", "word1 of some title"]
    assert abs(got[1] - 1 / len(score_stem(spark, text[0]))) < 1e-12


def score_stem(spark, text):
    return spark.range(1).select(score.stemmed(F.lit(text)).alias("x")).first()["x"]


def test_pages_without_hidden_nodes_are_not_rebuilt(spark):
    """The nodes are those that the removal of no subtree leaves, roots numbered; the plan has no join."""
    pages = spark.createDataFrame([(0, "<p>a</p> b <ul><li>c<li>d</ul>"), (1, "x<i>y</i><!-- z --><b></b>")], "page_id long, html string")
    nodes = parse_pages(pages).cache()
    left = N.drop_hidden(nodes)
    assert sorted(map(str, left.collect())) == sorted(map(str, N.without(nodes, F.lit(False)).collect()))
    assert "Join" not in left._jdf.queryExecution().optimizedPlan().toString()
    hidden = parse_pages(spark.createDataFrame([(0, "<p hidden>a<b>b</b></p><i>c</i>")], "page_id long, html string")).cache()
    assert [r["tag"] for r in N.drop_hidden(hidden).orderBy("node_id").collect()] == ["i", "#text"]


def test_records_of_tables_and_split_rows(spark):
    """A table's rows are records; a definition list's records are a term and what follows it."""
    table = "<table><tbody>" + "".join(f"<tr><td><a href='/t{i}'>Row title {i}</a></td><td>cell {i}</td></tr>" for i in range(6)) + "</tbody></table>"
    split = "<dl>" + "".join(f"<h3><a href='/s{i}'>Head {i}</a></h3><span>about {i}</span>" for i in range(6)) + "</dl>"
    pages, kinds = typed(spark, table, split)
    tops = kinds.where("tag in ('tbody', 'dl')").select("page_id", F.col("node_id").alias("cand"), F.col("depth").alias("cand_depth"))
    parts = segment.segments(segment.prepared(kinds), tops).join(kinds.select("page_id", "node_id", "tag"), ["page_id", "node_id"])
    got = {}
    for r in parts.orderBy("page_id", "pos", "node_id").collect():
        got.setdefault((r["page_id"], r["pos"]), []).append(r["tag"])
    assert [got[(0, i)] for i in range(1, 7)] in ([["tr"]] * 6, [["td", "td"]] * 6)
    assert [got[(1, i)] for i in range(1, 7)] == [["h3", "span"]] * 6


def test_backfill_and_nesting(spark):
    html = "<div>" + "".join(f"<p class='r item'><a href='/{i}'>t{i}</a></p>" for i in range(4)) + "</div><p class='r item'>more</p><p class='r'>not</p>"
    _, kinds = typed(spark, html)
    ready = segment.prepared(kinds)
    rows = kinds.where("tag = 'p' and n_children > 0 and depth = 1").select("page_id", F.lit(0).alias("cand"), F.lit(0).alias("cand_depth"), "node_id")
    assert segment.backfilled(ready, rows).count() == 5


EVENT = "o int, k int, node int, url string, text string, ts boolean, as boolean, lone boolean, image boolean, block int, any string, day string, is_day boolean"


def event(o, url, text, **more):
    return {"o": o, "k": 0, "node": o, "url": url, "text": text, "ts": False, "as": False, "lone": False, "image": False, "block": 1, "any": None, "day": None, "is_day": False} | more


def told(spark, *records):
    """What hand-made records are read as."""
    kind = "page_id long, cand int, pos int, events array<struct<" + ", ".join(p.replace(" ", ": ", 1) for p in EVENT.split(", ")) + ">>"
    rows = [(1, 1, i, None if r is None else [tuple(e.values()) for e in r]) for i, r in enumerate(records)]
    return extract.records_of(spark.createDataFrame(rows, kind)).orderBy("pos").collect()


def test_competition_of_links(spark):
    out, image, dated, empty, none = told(
        spark,
        [event(1, "/a", "short"), event(2, "/b", "a much longer title than that"), event(3, None, "and some words"), event(4, "/b", "again")],
        [event(1, "/p.png", "p", image=True), event(2, "/x", "title")],
        [event(1, None, "25/12/2014", day="2014-12-25", is_day=True), event(2, None, "1.5"), event(3, None, "two words")],
        [],
        None,
    )
    assert (out["url"], out["title"]) == ("/b", "a much longer title than that") and out["prior_url"] == "/a"
    assert tuple(out["fallbacks"][0]) == ("/a", "short") and "and some words" in out["summary"] and "short" in out["summary"] and "again" not in out["summary"]
    assert (image["alt_url"], image["url"]) == ("/p.png", "/x")
    assert dated["date_day"] == "2014-12-25" and dated["is_day"] and dated["summary"] == "two words"
    assert empty["url"] is None and none["url"] is None and none["summary"] == "" and none["fallbacks"] == []


def test_claims_of_links(spark):
    """A claim of 2 takes a record, one of 1 or 0 is a fallback, a lower one is text only."""
    base = event(1, "/a", "a title of words")
    cases = {
        "marked title": ([event(1, "/a", "- more"), event(2, "/b", "plain words")], "/b", 1),  # 9 for the holder's mark
        "poor": ([base, event(2, "/b", "other title here", ts=True, **{"as": True})], "/a", 0),  # -2 and -1
        "fragment": ([event(1, "/a#x", "a title of words"), event(2, "/b", "other title here")], "/b", 1),  # 2
        "nearer": ([event(1, "/a", "a title of words", block=3), event(2, "/b", "other title here", block=2)], "/b", 1),  # 2
        "equal": ([base, event(2, "/b", "other title here", lone=True), event(3, "/c", "third title here")], "/b", 1),  # 2, then -2
        "brief": ([base, event(2, "/b", "short")], "/a", 0),  # -2
        "same": ([base, event(2, "/b", "other title here")], "/a", 1),  # 0: a fallback
    }
    for got, (name, (_, url, kept)) in zip(told(spark, *[c[0] for c in cases.values()]), cases.items()):
        assert (got["url"], len(got["fallbacks"])) == (url, kept), name


def test_reading_of_texts(spark):
    """Words with dots and single words after them go; a link's node tells once; a date is taken once a day is known."""
    rows = [
        [event(1, None, "site.com"), event(2, None, "Home"), event(3, None, "two words"), event(4, None, "word"), event(5, None, "...")],
        [event(1, "/a", "a title of words"), event(2, "/b", "tiny", node=9, k=0), event(2, "/b", "small", node=9, k=1), event(4, None, "end")],
        [event(1, None, "maybe", any="2014-01-02"), event(2, None, "surely", day="2014-02-01", is_day=True), event(3, None, "late date", day="2015-01-01")],
    ]
    first, second, third = told(spark, *rows)
    assert first["summary"] == "two words word ..."
    assert second["summary"] == "tiny end" and second["url"] == "/a"
    assert (third["date_any"], third["date_day"], third["summary"]) == (None, "2014-02-01", "late date")


def test_elections_against_plain_python(spark):
    rng = np.random.default_rng(4)
    rows = [(p, n, rng.integers(0, 30, 3).tolist()) for p in range(6) for n in range(9)]
    weights = [[1.0, -2.0, 0.0], [0.0, 1.0, 1.0], [-1.0, 0.0, 2.0]]
    got = {}
    for r in rank.elected(spark.createDataFrame(rows, "page_id long, node_id int, features array<int>"), weights, 3).orderBy("turn").collect():
        got.setdefault(r["page_id"], []).append(r["node_id"])

    def cmp(a, b):
        return 0 if a > 0 and b > 0 and abs(a - b) / (a + b) < 0.125 else (a > b) - (a < b)

    for p in range(6):
        alive, want = {n: f for q, n, f in rows if q == p}, []
        while alive and len(want) < 3:
            votes = []
            for w in weights:
                beats = {a: {b for b in alive if sum(x * cmp(i, j) for x, i, j in zip(w, alive[a], alive[b])) < 0} for a in alive}
                low = [a for a in alive if len(beats[a]) == max(len(b) for b in beats.values())]
                won = low if len(low) == 1 else [a for a in low if all(b == a or b in beats[a] for b in low)]
                if len(won) == 1 and (len(alive) == 1 or beats[won[0]]):
                    votes += won
            if not votes:
                break
            top = max(votes.count(v) for v in votes)
            round_ = sorted({v for v in votes if votes.count(v) == top})
            want += round_
            for v in round_:
                del alive[v]
        assert got.get(p, []) == want


def test_nets_load_and_tuning(spark, tmp_path):
    (tmp_path / "nets").write_text("3;2;3;0,0:1,0,5+0,1:1,0,0+0,2:1,0,-7\n")
    assert rank.load_nets(spark, str(tmp_path / "nets")).first()["weights"] == [5.0, 0.0, -7.0]
    pairs = spark.createDataFrame([([i + 5, 1], [i, 9]) for i in range(20)], "left array<int>, right array<int>")
    weights, share = rank.tuned(pairs, [1.0, 0.0])
    assert share > 0.9 and len(weights) == 2


def test_scores_by_the_formula(spark):
    rows = [(1, i, f"http://h/{i}", t, s, None) for i, (t, s) in enumerate([("alpha beta gamma", "x" * 50), ("delta epsilon zeta", "y" * 60), ("eta theta", "z")])]
    df = spark.createDataFrame(rows, "g int, pos int, url string, title string, summary string, date string")
    r = score.field_scores(df, ["g"], "alphas", F.lit(True)).first()
    assert (r["n"], r["base"]) == (3, 4 * 2 + 4 * 2 + 3) and abs(r["share"] - 1 / 3) < 1e-9
    raw = r["base"] * (r["distance"] + r["share"] + 1) / 3
    assert r["naive"] == round(10 * raw / 3 ** (2 / 3)) and 0.5 < r["distance"] <= 1
    one = score.field_scores(df.limit(1), ["g"]).first()
    assert one["naive"] == 0 and one["score"] == 0
    line = score.rendered(df.limit(1), ["g"]).first()["line"]
    assert line.startswith("1 <> null <> http://h/0 <> alpha")


def test_alternates_and_fallbacks(spark):
    schema = "g int, pos int, url string, title string, summary string, date string, alt_url string, alt_title string, fallbacks array<struct<url:string,title:string>>"
    rows = [(1, i, f"/u{i}", "same", "words here", None, None, None, [(f"/f{i}", f"a longer fallback title {i}")]) for i in range(6)]
    out = clean.untrimmed(spark.createDataFrame(rows, schema), ["g"]).orderBy("pos").collect()
    assert [(r["url"], r["title"]) for r in out] == [(f"/f{i}", f"a longer fallback title {i}") for i in range(6)]
    used = [(1, i, f"/a{i}" if i < 2 else "/x", f"alt {i}" if i < 2 else "main", "s", None, f"/a{i}", f"alt {i}", []) for i in range(3)]
    alt = clean.use_alternates(spark.createDataFrame(used, schema), ["g"]).orderBy("pos").collect()
    assert [r["url"] for r in alt] == ["/a0", "/a1", "/a2"]


def test_limits_and_repeated_pages(spark):
    html = lambda k: "<ul>" + "".join(f"<li><a href='/{k}-{i}'>Title number {i} of page {k}</a> with some more words {i}</li>" for i in range(5)) + "</ul>"
    rows = [(p, f"http://h.example/{p}", html(min(p, 2)), 7, p) for p in (1, 2, 3)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string, search int, page_no int")
    out = best_records(pages, ExtractQuery(match_parent=NodeMatch(tag="ul"), pages=3, results=8)).collect()
    assert {r["page_id"] for r in out} == {1, 2} and len(out) == 8


def test_hidden_and_overlap(spark):
    _, kinds = typed(spark, "<div><ul><li>a</li><li hidden>b<i>c</i></li></ul></div>")
    left = N.drop_hidden(kinds)
    assert {r["tag"] for r in left.collect()} == {"div", "ul", "li", "#text"} and left.where("tag = 'ul'").first()["end_id"] == left.agg(F.max("node_id")).first()[0]
    assert N.overlapping(kinds.where("tag = 'i'"), kinds.where("tag = 'ul'")).count() == 1
    assert N.overlapping(kinds.where("tag = 'ul'"), kinds.where("tag = 'i'")).count() == 1
    assert N.overlapping(kinds.where("tag = 'i'"), kinds.where("tag = 'i' and node_id < 0")).count() == 0


def test_collapse_keeps_repeats(spark, tmp_path):
    rows = spark.createDataFrame([(1, "a"), (1, "a"), (2, "b")], "k int, t string")
    path = f"file://{tmp_path}/collapsed"
    keys = paging.collapse(rows, path)
    assert sorted(tuple(r) for r in paging.expand(keys, path).select("k", "t").collect()) == [(1, "a"), (1, "a"), (2, "b")]


def test_binaries_media_and_json(spark, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "a.b.pdf").write_bytes(b"%PDF-1")
    got = exports.read_binaries(spark, f"file://{tmp_path}/in").first()
    assert got["mime"] == "application/pdf" and got["extension"] == "pdf" and base64.b64decode(got["content"]) == b"%PDF-1"
    sources = spark.createDataFrame([(1, "/img/a.png"), (1, "/img/none.png")], "page_id long, src string")
    captured = spark.createDataFrame([("http://h/img/a.png", bytearray(b"\x89PNG"), "application/octet-stream")], "url string, content binary, mime string")
    media = exports.media_of(sources, captured).first()
    assert media["media_mime_types"] == {"/img/a.png": "image/png"}
    exports.write_json(sources, f"file://{tmp_path}/json")
    assert spark.read.json(f"file://{tmp_path}/json").count() == 2


def test_streams(spark, tmp_path):
    html = "<ul>" + "".join(f"<li><a href='/{i}'>Title number {i} of this</a> and words {i}</li>" for i in range(5)) + "</ul>"
    spark.createDataFrame([(1, "http://h.example/1", html)], stream.PAGES).write.parquet(f"{tmp_path}/pages")
    run = stream.extract_stream(stream.read_pages(spark, f"{tmp_path}/pages"), f"{tmp_path}/out", f"{tmp_path}/check")
    run.awaitTermination(240)
    assert spark.read.parquet(f"{tmp_path}/out").count() == 5
    rows = spark.createDataFrame([("a", 0), ("a", 1), ("b", 2)], "token string, s int").selectExpr("token", "timestamp_seconds(1700000000 + s) as ts", "'x' as kind")
    rows.write.parquet(f"{tmp_path}/tokens")
    source = lambda: spark.readStream.schema(rows.schema).parquet(f"{tmp_path}/tokens")
    for name, df, want in (("fresh", stream.fresh_tokens(source()), 2), ("counts", stream.stream_counts(source()), 1)):
        q = df.writeStream.format("memory").queryName(name).outputMode("complete" if name == "counts" else "append").trigger(availableNow=True).start()
        q.awaitTermination(120)
        assert spark.table(name).count() == want
